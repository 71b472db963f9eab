import hashlib
import random
import zlib

import duckdb

from corpusmill.llm import prefix_trie as pt

SCHEMA = "conv_id long, turn long, role string, text string, pos string, key string, n string"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA).repartition(parts)


def ordered(rows):
    by = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            by.setdefault(conv, []).append((turn is not None, turn or 0, role, digest, text))
    return {c: [(r, t) for _, _, r, _, t in sorted(v)] for c, v in by.items()}


def plain_graft(by):
    out = {}
    for c in by:
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = by.get(c - c % 100, [])[:h] + by[c][h:]
    return out


def plain_trie(by):
    members = {}
    for c, turns in by.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {p: [] for p in members}
    for p in members:
        if p:
            children[p[:-1]].append(p)

    total = {}
    for p in sorted(members, key=len, reverse=True):
        leaves, saved = (0 if children[p] else 1), (len(members[p]) - 1) * (len(p[-1][1]) if p else 0)
        for q in children[p]:
            leaves, saved = leaves + total[q][0], saved + total[q][1]
        total[p] = leaves, saved
    rows = []
    for p, convs in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in convs if len(by[c]) == len(p)))
        rows.append((min(convs), len(p), min(members[p[:-1]]) if p else None, len(convs), len(children[p]), *total[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(rows, key=lambda r: r[:2])


def got(frame):
    return sorted(map(tuple, frame.collect()), key=lambda r: r[:2])


def whole(spark, rows, **k):
    turns = pt.numbered_turns(frame(spark, rows, **k))
    return pt.build_trie(turns, turns.select("conv_id"))


def odd_conversations(seed=3):
    rng, rows = random.Random(seed), []
    for c in range(0, 330):
        if c in (100, 205):  # the base of a hundred is missing
            continue
        n = rng.choice([0, 1, 2, 3, 4, 6]) if c % 7 else 5
        for turn in range(n):
            text = rng.choice(["ab", "é", "hello there"]) if turn < 3 or c % 5 else f"{c} {turn}"
            rows.append((c, turn, ("user", "assistant")[turn % 2], text))
    for c in range(400, 440):  # copies
        rows += [(c, t, "user", "same") for t in range(4)]
    rows += [(500, None, None, None), (500, None, "user", None), (500, 3, None, ""), (500, 3, "a", "b"), (500, 3, "a", "b"), (501, 0, "ab", "c"), (502, 0, "a", "bc"), (-7, 0, "user", "negative")]
    rows += [(None, 0, "user", "lost"), (None, None, None, None), (600, 0, "user", "z" * 500_000), (601, 0, "user", "z" * 500_000)]
    return rows


def test_odd_conversations_against_plain_version(spark):
    rows = odd_conversations()
    assert got(whole(spark, rows)) == plain_trie(ordered(rows))


def test_grafted_conversations_against_plain_version(spark):
    rows = odd_conversations(5) + [(c, t, "user", f"deep {t}") for c in (700, 701, 702) for t in range(9)]
    turns = pt.numbered_turns(frame(spark, rows))
    rebuilt, ids = pt.grafted(turns)
    want = plain_graft({c: v for c, v in ordered(rows).items() if c >= 0})  # the remainder of a negative id is Spark's
    assert got(pt.build_trie(rebuilt.filter("conv_id >= 0"), ids.filter("conv_id >= 0"))) == plain_trie(want)
    assert any(not v for v in want.values()) and len({len(v) for v in want.values()}) > 5


def test_long_common_stretches_take_few_rounds(spark, monkeypatch):
    rng, rows = random.Random(0), []
    trunk = [rng.choice("ab") for _ in range(120)]
    for c in range(8):
        cut = rng.choice([100, 120, 120])
        turns = trunk[:cut] + [f"{c % 5}"] * rng.randint(0, 3)
        rows += [(c, i, "user", t) for i, t in enumerate(turns)]
    rounds, refine = [], pt._refine
    monkeypatch.setattr(pt, "_refine", lambda *a: (rounds.append(r := refine(*a)), r)[1])
    assert got(whole(spark, rows)) == plain_trie(ordered(rows))
    assert rounds[0][2] < 40


def test_one_sequence_only(spark):
    for rows in ([(5, 0, "a", "b")], [(5, 0, "a", "b"), (5, 1, "a", "b"), (3, 0, "a", "b"), (3, 1, "a", "b")]):
        assert got(whole(spark, rows)) == plain_trie(ordered(rows))
    none = pt.numbered_turns(frame(spark, [(1, 0, "a", "b")])).filter("pos > 1")
    ids = spark.createDataFrame([(9,), (4,)], "conv_id long")
    assert got(pt.build_trie(none, ids)) == plain_trie({4: [], 9: []})


def test_many_copies_are_hashed_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(pt, "IDS", 7)
    rows = [(c, 0, "user", "hi") for c in range(95, 320)] + [(c, 0, "user", "ho") for c in range(320, 330)]
    assert got(whole(spark, rows, parts=6)) == plain_trie(ordered(rows))


def test_a_hot_first_turn_and_a_giant_conversation(spark):
    rows = [(c, t, "user", "hello" if t == 0 else f"{c % 40}") for c in range(1200) for t in range(2)]
    rows += [(5000, t, "user", "hello" if t == 0 else f"long {t}") for t in range(3000)]
    assert got(whole(spark, rows, parts=5)) == plain_trie(ordered(rows))


def test_empty_tables(spark):
    for rows in ([], [(None, 0, "a", "b")]):
        turns = pt.numbered_turns(frame(spark, rows))
        assert pt.build_trie(*pt.grafted(turns)).collect() == []


def test_the_sql_has_crc32_right():
    from corpusmill.llm.registry import OP13_SQL

    head = OP13_SQL[: OP13_SQL.index("lent AS")].rstrip().rstrip(",")
    db = duckdb.connect()
    db.sql("CREATE TABLE conversations AS SELECT unnest([0, 7, 99, 100, 12345678901, -7]) AS conv_id, 0 AS turn, 'a' AS role, 'b' AS text")
    assert {c: h for c, h in db.sql(f"{head} SELECT conv_id, h FROM ids").fetchall()} == {c: zlib.crc32(str(c).encode()) % 6 for c in (0, 7, 99, 100, 12345678901, -7)}
