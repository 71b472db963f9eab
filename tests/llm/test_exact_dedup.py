import hashlib
import re
from collections import Counter

from corpusmill.llm import exact_dedup
from tests.llm.helpers import no_docs, odd_docs, odd_rows


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def winners():
    groups = {}
    for r in odd_rows():
        groups.setdefault(normal(r[1]), []).append((-len(r[1] or ""), r[0] is None, r[0] or 0, r[0]))
    return {k: (min(v)[3], len(v)) for k, v in groups.items()}


def test_every_row_has_its_group(spark):
    got = exact_dedup.exact_duplicates(odd_docs(spark), digest_all=True).collect()
    best = winners()
    want = Counter()
    for r in odd_rows():
        keep, size = best[normal(r[1])]
        want[r[0], keep, size, hashlib.sha256(normal(r[1]).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.digest.hex()) for r in got) == want
    assert sum(r.kept for r in got) == len(best)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_digest_only_where_needed(spark):
    got = exact_dedup.exact_duplicates(odd_docs(spark)).collect()
    assert all(r.digest is not None for r in got if r.group_size > 1)
    assert any(r.digest is None for r in got)


def test_rows_with_a_common_prefix_are_told_apart(spark):
    docs = spark.createDataFrame([(i, "p" * 300 + str(i % 7)) for i in range(50)], "doc_id long, text string")
    got = exact_dedup.exact_duplicates(docs).collect()
    assert sorted(r.doc_id for r in got if r.kept) == list(range(7))


def test_drop_keeps_columns_and_one_row_each(spark):
    docs = odd_docs(spark)
    kept = exact_dedup.drop_duplicates(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert Counter(normal(r.text) for r in rows) == Counter(set(normal(r[1]) for r in odd_rows()))
    best = winners()
    assert all(r.doc_id == best[normal(r.text)][0] for r in rows)


def test_a_row_that_repeats_often(spark):
    rows = [(7, "the same text", "b")] * 1500 + [(7, "the same text", "a")] * 500 + [(None, "thesame text", "c")] * 1000 + [(i, f"text {i}", "d") for i in range(100, 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string").repartition(6)
    got = exact_dedup.exact_duplicates(docs).collect()
    assert len(got) == len(rows) and sum(r.kept for r in got) == 201
    assert {(r.keep_id, r.group_size) for r in got if r.doc_id in (7, None)} == {(7, 3000)}
    for parts in (2, 9):
        left = exact_dedup.drop_duplicates(docs.repartition(parts)).collect()
        assert len(left) == 201 and [tuple(r) for r in left if r.doc_id == 7] == [(7, "the same text", "a")]


def test_without_a_filter(spark, monkeypatch):
    """Past the size at which a bitmap is of use, results are the same."""
    want = sorted(map(str, exact_dedup.exact_duplicates(odd_docs(spark), digest_all=True).collect()))
    kept = sorted(map(str, exact_dedup.drop_duplicates(odd_docs(spark)).collect()))
    monkeypatch.setattr(exact_dedup.C, "FILTER_KEYS", 0)
    assert sorted(map(str, exact_dedup.exact_duplicates(odd_docs(spark), digest_all=True).collect())) == want
    assert sorted(map(str, exact_dedup.drop_duplicates(odd_docs(spark)).collect())) == kept


def test_very_long_texts(spark):
    long = "word " * 1_000_000
    docs = spark.createDataFrame([(1, long), (2, long.replace(" ", "\n")), (3, long + "x")], "doc_id long, text string")
    assert {(r.doc_id, r.keep_id) for r in exact_dedup.exact_duplicates(docs).collect()} == {(1, 1), (2, 1), (3, 3)}


def test_empty_table(spark):
    assert exact_dedup.exact_duplicates(no_docs(spark)).count() == 0
    assert exact_dedup.drop_duplicates(no_docs(spark)).count() == 0
