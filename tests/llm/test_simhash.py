from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import functions as F

from corpusmill.llm import components, simhash
from tests.llm.helpers import no_docs, odd_docs, odd_rows


def slow_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(nodes, linked):
    up = {n: n for n in nodes}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in combinations(nodes, 2):
        if linked(a, b):
            up[top(a)] = top(b)
    out = {}
    for n in nodes:
        out.setdefault(top(n), set()).add(n)
    return sorted(map(sorted, out.values()))


def test_fingerprints():
    for row in odd_rows():
        assert simhash.fingerprint((row[1] or "").encode()) == slow_print(row[1])


def by_gray(fps):
    """Sorted by the rank of the Gray code, without the code under test."""

    def rank(g):
        out = 0
        while g:
            out ^= g
            g >>= 1
        return out

    return np.array(sorted(fps, key=rank), np.uint64)


def some_prints(rng, n, bits, flips=6):
    base, fps = rng.integers(0, 1 << 64, size=4, dtype=np.uint64).tolist(), set()
    for _ in range(n):
        x = base[int(rng.integers(4))]
        for bit in rng.integers(0, bits, size=int(rng.integers(0, flips))).tolist():
            x ^= 1 << bit
        fps.add(x)
    return fps


def linked(a, b):
    return ((a ^ b) & (1 << 64) - 1).bit_count() <= 2


def test_index_finds_every_link():
    rng = np.random.default_rng(5)
    for turn in range(25):
        order = by_gray(some_prints(rng, int(rng.integers(1, 300)), 64 if turn % 2 else 10))
        fps, edges = order.tolist(), set()
        step = int(rng.integers(1, 80))
        for start in range(0, len(order), step):  # ranges of the order, searched by all before them in two parts
            tree = simhash.RangeSearch(order[start : start + step])
            told = [tree.among(), tree.of(order[: start // 2]), tree.of(order[start // 2 : start])]
            assert sum(len(a) for a, _ in told) < len(order)  # a forest, not all pairs
            edges |= {pair for a, b in told for pair in zip(a.tolist(), b.tolist())}
        assert classes(fps, lambda a, b: (a, b) in edges or (b, a) in edges) == classes(fps, linked)


def test_nodes_with_many_leaves_are_dropped():
    rng = np.random.default_rng(8)
    order = by_gray(rng.integers(0, 1 << 64, size=20_000, dtype=np.uint64).tolist())
    index = simhash.GrayIndex(order)
    found = [(q, a, b) for q, a, b in index.search(order, np.arange(len(order)))]
    pairs = len(order) * (len(order) - 1) // 2
    assert index.pruned > 0.9 * pairs and index.looked < 0.1 * pairs
    got = {(int(q), int(x)) for qs, a, b in found for q, lo, hi in zip(qs, a, b) for x in range(lo, hi + 1)}
    near = np.bitwise_count(order[:300, None] ^ order[None, :]) <= 2
    assert {(int(q), int(x)) for q, x in zip(*np.nonzero(near)) if x > q} == {p for p in got if p[0] < 300}


def test_upper_nodes_route_to_every_range_that_holds_a_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "RANGES", 30)
    rng = np.random.default_rng(9)
    fps = some_prints(rng, 700, 64) | some_prints(rng, 300, 12) | {int(x) for x in rng.integers(0, 1 << 64, 300, np.uint64)} | {0, (1 << 64) - 1}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    table = spark.createDataFrame([(f,) for f in signed], "fp long")
    ranks = [r.fp & (1 << 64) - 1 for r in table.select("fp", simhash.gray_rank(F.col("fp")).alias("rank")).orderBy("rank").collect()]
    assert ranks == by_gray(fps).tolist()
    edges = {(r.a, r.b) for r in simhash.fingerprint_links(table).collect()}
    assert classes(signed, lambda a, b: (a, b) in edges or (b, a) in edges) == classes(signed, linked)
    assert simhash.fingerprint_links(table.limit(0)).count() == 0


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100)] + [(1000, i) for i in range(1001, 1400)] + [(5000, 5000)]
    got = dict(components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 0 for i in range(101)} | {i: 1000 for i in range(1000, 1400)}


def test_query_against_brute_force(spark):
    docs = odd_docs(spark)
    got = simhash.simhash_components(docs).collect()
    assert len(got) == docs.count()
    prints = sorted({slow_print(r[1]) for r in odd_rows()})
    ids = {}
    for r in odd_rows():
        ids.setdefault(slow_print(r[1]), []).append(r[0])
    want = {}
    for group in classes(prints, lambda a, b: (a ^ b).bit_count() <= 2):
        known = [i for p in group for i in ids[p] if i is not None]
        want |= {p: min(known) if known else None for p in group}
    assert all(r.component_id == want[r.fp & (1 << 64) - 1] for r in got)
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.component_id for r in got}


def test_one_document_of_each_component_stays(spark):
    words = " ".join(f"word{i}" for i in range(400))
    near = [words, words + " ", words.upper(), words.replace("word7 ", "word7\n")]
    assert len({slow_print(t) for t in near}) == 1
    rows = [(5, near[0]), (5, near[1]), (None, near[2]), (9, near[3]), (None, "alone here"), (None, "Alone here"), (7, "other"), (7, "words")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, component_id string").repartition(3)
    kept = [(r.doc_id, r.text) for r in simhash.drop_near_duplicates(docs).collect()]
    assert len(kept) == 4 and {(7, "other"), (7, "words")} <= set(kept)
    assert sorted(str(i) for i, _ in kept) == ["5", "7", "7", "None"]
    hot = spark.createDataFrame([(1, words)] + [(2, words)] * 2000 + [(i, f"text {i}") for i in range(10, 60)], "doc_id long, text string").repartition(4)
    assert sorted(r.doc_id for r in simhash.drop_near_duplicates(hot).collect()) == [1, *range(10, 60)]


def test_a_very_long_text_and_small_parts(spark, monkeypatch):
    long = " ".join(f"w{i % 977}" for i in range(1_200_000))
    assert len(long) > 5_000_000
    whole = simhash.fingerprint(long.encode())
    docs = spark.createDataFrame([(1, long), (2, long + " end")], "doc_id long, text string")
    assert {(r.fp & (1 << 64) - 1, r.component_id) for r in simhash.simhash_components(docs).collect() if r.doc_id == 1} == {(whole, 1)}
    short = " ".join(long.split()[:3000])
    monkeypatch.setattr(simhash, "_HASHES_AT_ONCE", 7)
    assert simhash.fingerprint(short.encode()) == slow_print(short)


def test_parts_of_the_search_do_not_change_its_links(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(6)
    order = by_gray({int(x) ^ (1 << int(b)) for x in rng.integers(0, 1 << 64, 40, np.uint64) for b in rng.integers(0, 64, 12)})
    size = 100
    rows = [(start // size, guest, int(f)) for start in range(0, len(order), size) for guest, part in ((False, order[start : start + size]), (True, order[:start])) for f in part]
    cols = [np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows]), np.array([r[2] for r in rows], np.uint64).view(np.int64)]

    def links(step):
        batches = [pa.RecordBatch.from_arrays([pa.array(c[i : i + step]) for c in cols], ["range", "guest", "fp"]) for i in range(0, len(rows), step)]
        edges = {(a & (1 << 64) - 1, b & (1 << 64) - 1) for batch in simhash._links(iter(batches)) for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())}
        return classes(order.tolist(), lambda a, b: (a, b) in edges or (b, a) in edges)

    want = classes(order.tolist(), linked)
    assert links(10_000) == want
    monkeypatch.setattr(simhash, "CHUNK", 30)
    monkeypatch.setattr(simhash, "FRONTIER", 11)
    assert links(17) == want


def test_empty_table(spark):
    assert simhash.simhash_components(no_docs(spark)).count() == 0
