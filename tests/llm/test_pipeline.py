import random
import re
from collections import Counter

import pytest

tokenizers = pytest.importorskip("tokenizers")
P = pytest.importorskip("public_tokenizers")

import __spark_entry__
import corpus_pipeline
from corpusmill import runtime
from tests.llm.helpers import DE, EN, SCHEMA, no_docs, odd_docs, odd_rows, prose
from tests.llm.test_simhash import classes, slow_print
from tests.llm.test_substring_dedup import brute_words, document_order

TEXT = r"[^\x20\x09-\x0D]"


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text)


def rows_of():
    """The odd rows, and ids with several texts, null ids with passages, ties."""
    rng = random.Random(21)
    shared, tail = prose(rng, EN, 70), odd_rows()[0][2:]
    more = [(300, prose(rng, DE, 80) + " " + shared), (300, prose(rng, DE, 120)), (None, shared + " " + prose(rng, EN, 90)), (301, shared), (302, shared + " "), (None, shared + "\n")]
    return odd_rows() + [(i, t, "en", "s1", len(t), *tail[3:]) for i, t in more]


def test_each_stage_against_brute_force(spark, tmp_path):
    docs = spark.createDataFrame(rows_of(), SCHEMA).repartition(3)
    columns, before = docs.columns, None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = str(tmp_path / name)
        stage(spark, docs, "").write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == columns, name
        now = Counter((r.doc_id, r.text) for r in docs.collect())
        if name == "language_id":
            assert all(t and re.search(r"[^\W\d_]", t) for _, t in now) and sum(now.values()) > 0.9 * sum(bool(r[1]) for r in rows_of())
        elif name == "exact_dedup":
            best = {}
            for i, t in before:
                key = (-len(t), i is None, i or 0)
                best[normal(t)] = min(best.get(normal(t), (key, i, t)), (key, i, t), key=lambda x: x[0])
            assert {normal(t): (i, len(t)) for i, t in now} == {k: (i, len(t)) for k, (_, i, t) in best.items()} and sum(now.values()) == len(best)
        elif name == "simhash_near_dedup":
            prints = {}
            for d in before:
                prints.setdefault(slow_print(d[1]), []).append(d)
            groups = classes(sorted(prints), lambda a, b: (a ^ b).bit_count() <= 2)
            assert now == Counter(min((d for p in g for d in prints[p]), key=document_order) for g in groups)
        else:
            gone = brute_words(list(before), 51)
            left = Counter()
            for i, t in before:
                words = re.findall(TEXT + "+", t)
                kept = [w for k, w in enumerate(words) if k not in gone.get((i, t), ())]
                left[i, tuple(kept)] += bool(kept)
            assert Counter((i, tuple(re.findall(TEXT + "+", t))) for i, t in now) == +left and gone
            assert all(r.n_chars == len(r.text) for r in docs.collect())
        before = now
    library = tokenizers.Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = Counter()
    for (i, t), n in before.items():
        want[i] += n * (len(library.encode(t, add_special_tokens=False).ids) + 1)
    got = Counter()
    for p in corpus_pipeline.STAGES[-1][1](spark, docs, "").collect():
        got[p.doc_id] += p.length
    assert got == want


def test_run_and_registration(spark, tmp_path):
    odd_docs(spark).write.parquet(str(tmp_path / "documents.parquet"))
    assert "pipeline" in __spark_entry__.queries()
    others = runtime.tables(spark)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    left = runtime.tables(spark)
    assert set(others) <= set(left) and sum("/stage-" in t for t in left if t not in others) == 1
    assert all(any(n.startswith(f"op{i}_") for n in __spark_entry__.queries()) for i in range(1, 11))


def test_empty_table(spark, tmp_path):
    no_docs(spark).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
