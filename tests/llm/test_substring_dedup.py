import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from corpusmill.llm import substring_dedup as S
from tests.llm.helpers import DE, EN, FR, SCHEMA, no_docs, odd_rows, prose


def test_rolling_hash():
    data = np.frombuffer(b"some bytes to roll over, more than sixteen of them", np.uint8)
    h, want = 0, []
    for i, b in enumerate(data):
        h = sum(int(S.GEAR[data[j]]) << (i - j) for j in range(max(0, i - 15), i + 1)) % (1 << 32)
        want.append(h)
    assert S.gear_hash(data).tolist() == want


def test_insertions_move_only_near_chunks():
    rng = random.Random(2)
    text = prose(rng, EN + FR, 600).encode()
    before = S._chunks(text)[2]
    for _ in range(20):
        at = rng.randrange(len(text))
        after = S._chunks(text[:at] + b" inserted words " + text[at:])[2]
        assert len(set(before) - set(after)) <= 12
    assert b"".join(text[a:b] for a, b in zip([0, *S.chunk_starts(text)[0][1:]], [*S.chunk_starts(text)[0][1:], len(text)])) == text


def document_order(row):
    return row[0] is None, row[0] or 0, text_hash(row[1])


def text_hash(text):
    """xxhash64 of Spark: seed 42, signed."""
    h = xxhash.xxh64_intdigest(text.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def brute_words(rows, least):
    """For each document (id, text) the places, in words, that windows of ``least`` words shared with an earlier document cover."""
    docs = sorted({(r[0], r[1]) for r in rows if r[1]}, key=document_order)
    seen, out = {}, {}
    for doc in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", doc[1])
        covered = set()
        for i in range(len(words) - least + 1):
            if seen.setdefault(tuple(words[i : i + least]), doc) != doc:
                covered.update(range(i, i + least))
        if covered:
            out[doc] = covered
    return out


def covered_words(text, spans):
    """The words that spans cover; each span starts at a word and ends before the next one."""
    places = [m.start() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    for s in spans:
        assert s.start in places and (s.end in places or s.end == len(text))
        assert s.n_words == sum(s.start <= p < s.end for p in places) >= S.MIN_WORDS
    return {i for i, p in enumerate(places) if any(s.start <= p < s.end for s in spans)}


def check(rows, spans):
    want = brute_words(rows, S.MIN_WORDS)
    got = {}
    for s in spans:
        got.setdefault((s.doc_id, s.text_hash), []).append(s)
    texts = {(r[0], text_hash(r[1])): r[1] for r in rows if r[1]}
    assert {(i, t): covered_words(t, got[i, h]) for (i, h), t in texts.items() if (i, h) in got} == want


def passages(seed, n, least, most):
    """Pairs of documents that share one passage of ``least`` to ``most`` words at different places."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = [rng.choice(EN + FR) + str(rng.randrange(50)) for _ in range(rng.randint(least, most))]
        for k, own in enumerate((EN, FR)):
            rows.append((2 * i + k, " ".join([prose(rng, own, rng.randint(0, 60)), *words, prose(rng, own, rng.randint(0, 60))]).strip()))
    return rows


def test_shared_passages_are_spans_from_51_words_on(spark):
    rows = passages(3, 500, 45, 60) + [(i + 2000, t) for i, t in passages(4, 20, 300, 900)]
    spans = S.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    check(rows, spans)
    assert all(s.doc_id % 2 and s.kept_doc_ids == [s.doc_id - 1] for s in spans)


def test_words_between_the_edits_of_a_near_copy_are_left(spark):
    rng = random.Random(6)
    words = [rng.choice(EN) + str(rng.randrange(90)) for _ in range(400)]
    near = [w if i % 45 else "edited" for i, w in enumerate(words)]
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join([*words[:50], "x", *words[60:120]]))]
    spans = S.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    check(rows, spans)
    assert {s.doc_id for s in spans} == {3}


def test_query_against_brute_force(spark):
    rows = odd_rows()
    rows += [(None, rows[3][1], *rows[3][2:])] * 2 + [(None, prose(random.Random(8), DE, 80), *rows[3][2:])]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    spans = S.repeated_spans(docs)
    got = spans.collect()
    check(rows, got)
    assert 201 in {r.doc_id for r in got}
    cut = S.cut_spans(docs, spans)
    assert cut.columns == docs.columns
    left = {(r.doc_id, r.text) for r in cut.collect()}
    assert {(r[0], r[1]) for r in rows if r[0] in (3, 220, 221, 222, 229)} <= left
    short = next(r for r in cut.collect() if r.doc_id == 201)
    assert short.n_chars == len(short.text) < len(dict((r[0], r[1]) for r in rows)[201])
    assert S.repeated_spans(cut).count() == 0


def test_one_id_with_two_texts(spark):
    rng = random.Random(12)
    shared, own = prose(rng, EN + FR, 90), prose(rng, DE, 200)
    rows = [(1, shared + " " + prose(rng, EN, 30)), (2, prose(rng, FR, 40) + " " + shared), (2, own), (5, own + " " + shared), (5, prose(rng, FR, 300))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    spans = S.repeated_spans(docs)
    check(rows, spans.collect())
    cut = sorted((r.doc_id, r.text) for r in S.cut_spans(docs, spans).collect())
    assert {rows[0], rows[2], rows[4]} <= set(cut) and len(cut) == 4  # of row 3 nothing is left


def test_a_very_long_text_and_a_passage_that_many_share(spark):
    rng = random.Random(13)
    shared = prose(rng, EN + FR, 70)
    long = " ".join(str(i * 7919 % 1_000_003) for i in range(750_000))
    rows = [(1, long), (2, "start " + long[1_000_000:1_003_000] + " end")] + [(10 + i, f"head{i} " + shared + f" tail{i}") for i in range(300)]
    assert len(long) > 5_000_000
    spans = S.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert {s.doc_id for s in spans} == {2, *range(11, 310)}
    texts = dict(rows)
    assert all(texts[s.doc_id][s.start : s.end].split() == shared.split() for s in spans if s.doc_id > 10)


def test_a_run_of_one_word(spark):
    rng = random.Random(14)
    rows = [(i, prose(rng, EN, 40) + " |" * n + " " + prose(rng, FR, 40)) for i, n in enumerate((60, 55, 45, 51, 200))]
    spans = S.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {s.doc_id for s in spans} in ({1, 4}, {1, 3, 4})  # such a run has no places of its own to cut at, so one just long enough can be missed


def test_past_the_filter_the_same_spans(spark, monkeypatch):
    rows = passages(15, 60, 45, 80) + [(i + 500, "head " * i + " ".join(f"w{k}" for k in range(90))) for i in range(40)] + [(None, None), (600, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = sorted(map(str, S.repeated_spans(docs).collect()))
    monkeypatch.setattr(S.C, "FILTER_KEYS", 0)
    spans = S.repeated_spans(docs)
    assert sorted(map(str, spans.collect())) == want and len(want) > 60
    cut = sorted(map(str, S.cut_spans(docs, spans).collect()))
    monkeypatch.undo()
    assert sorted(map(str, S.cut_spans(docs, spans).collect())) == cut


def test_a_document_repeated_in_very_many_rows(spark):
    """One row of it is chunked and grown, though all rows are cut."""
    rng = random.Random(16)
    shared, own = prose(rng, EN + FR, 2000), prose(rng, DE, 1000)
    docs = spark.createDataFrame([(7, shared + " " + own), (None, own)], "doc_id long, text string")
    many = spark.range(4000, numPartitions=8).join(F.broadcast(docs)).drop("id").unionByName(spark.createDataFrame([(1, shared)], "doc_id long, text string"))
    rows = S._one_row_each(many.select("doc_id", F.xxhash64("text").alias("text_hash"), "text"))
    assert sorted(map(str, rows.collect())) == sorted(map(str, many.distinct().select("doc_id", F.xxhash64("text").alias("text_hash"), "text").collect()))
    spans = S.repeated_spans(many)
    found = spans.collect()
    check([(1, shared), (7, shared + " " + own), (None, own)], found)
    assert {s.doc_id for s in found} == {7, None}
    cut = S.cut_spans(many, spans).groupBy("doc_id").agg(F.count("*").alias("n"), F.count_distinct("text").alias("texts"))
    assert {tuple(r) for r in cut.collect()} == {(7, 4000, 1), (1, 1, 1)}


def test_empty_table(spark):
    spans = S.repeated_spans(no_docs(spark))
    assert spans.count() == 0
    assert S.cut_spans(no_docs(spark), spans).count() == 0
