import random

import pytest

from corpusmill.operators import embed, retrieve, trigram
from corpusmill.plans import engines

PARTS = ["ab", "the", "Ana", "é", "ß", "İ", "日本", "🎉", "x", "on", "\x00", "and and", "ba"]


@pytest.fixture(scope="module")
def chunks(spark):
    rng = random.Random(1)
    rows = [(i, f"src/p{i % 7}/My_{i}.md", i % 5, " ".join(rng.choice(PARTS) for _ in range(rng.randint(0, 12)))) for i in range(400)]
    return spark.createDataFrame(rows, "chunk_ord long, doc_path string, chunk_id int, chunk_text string")


@pytest.fixture(scope="module")
def questions(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice([*PARTS, "zzzz", "nope", "my_3", "src/p1"]) for _ in range(rng.randint(0, 4)))) for i in range(60)]
    odd = [(100, None), (101, "   "), (102, "p1/my_1.md"), (103, "and and the"), (104, "a"), (105, "ab ab the"), (106, "?"), (107, "\x00"), (108, "a\x00")]
    return spark.createDataFrame(rows + odd, "query_id long, question string")


def rows(df):
    return sorted(map(tuple, df.select("query_id", "rank", "score", "chunk_ord").collect()))


@pytest.mark.parametrize("pushed,blocks", [(500, 8192), (2, 50)])
def test_rows_equal_those_of_the_loop(monkeypatch, chunks, questions, pushed, blocks):
    monkeypatch.setattr(trigram, "PUSHED", pushed)
    monkeypatch.setattr(trigram, "BLOCK_CHUNKS", blocks)
    a = trigram.lexical_a(trigram.TrigramIndex.build(chunks, trigram.hay_a("doc_path")), questions, 8)
    assert rows(a) == rows(retrieve.lexical_a(chunks, questions, 8, "doc_path"))
    b = trigram.keyword_b(trigram.TrigramIndex.build(chunks, trigram.hay_b()), questions, 8)
    assert rows(b) == rows(retrieve.keyword_b(chunks, questions, 8))
    for df in (a, b):
        plan = df._jdf.queryExecution().toString()
        assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_only_long_and_counted_terms_meet_texts(spark, chunks):
    index = trigram.TrigramIndex.build(chunks, trigram.hay_b())
    terms = spark.createDataFrame([("the", False), ("日", False), ("zzzz", False)], "term string, counted boolean")
    blind = trigram.TrigramIndex(index.hay.filter("false"), index.postings, index.frequencies)
    want = {(t, r.chunk_ord) for r in chunks.collect() for t in ("the", "日") if t in f"{r.chunk_text}\n{r.doc_path}\n{r.doc_path}".lower()}
    assert {(r.term, r.chunk_ord) for r in blind.held(terms).collect()} == want


def test_candidates_hold_the_rarest_grams_only(spark, chunks):
    index = trigram.TrigramIndex.build(chunks, trigram.hay_b())
    terms = spark.createDataFrame([("my_39",)], "term string")
    found = {r.chunk_ord for r in index.candidates(terms).collect()}
    assert {39, *range(390, 400)} <= found and len(found) < 120


def test_an_index_on_disk(spark, tmp_path, chunks, questions):
    trigram.TrigramIndex.build(chunks, trigram.hay_b(), str(tmp_path / "words"))
    index = trigram.TrigramIndex.load(spark, str(tmp_path / "words"))
    assert rows(trigram.keyword_b(index, questions, 3)) == rows(retrieve.keyword_b(chunks, questions, 3))
    few = index.candidates(spark.createDataFrame([("src/p1",)], "term string"))
    assert "PushedFilters: [In(gram" in few._jdf.queryExecution().toString()


def test_empty_sides(spark, chunks, questions):
    index = trigram.TrigramIndex.build(chunks.limit(0), trigram.hay_b())
    assert rows(trigram.keyword_b(index, questions, 3)) == []
    index = trigram.TrigramIndex.build(chunks, trigram.hay_a("doc_path"))
    assert rows(trigram.lexical_a(index, questions.limit(0), 3)) == []


def test_the_engines_with_an_index_of_words(chunks, questions):
    vectors = embed.hash_embed(chunks, "chunk_text")
    asked = questions.filter("question IS NOT NULL")
    plain = engines.ask_b(vectors, asked).collect()
    words = trigram.TrigramIndex.build(chunks, trigram.hay_b())
    assert sorted(map(str, engines.ask_b(vectors, asked, words=words).collect())) == sorted(map(str, plain))
    index = vectors.withColumnRenamed("doc_path", "source_path")
    none = lambda df, col: embed.hash_embed(df, col).filter("query_id % 2 = 0")
    words = trigram.TrigramIndex.build(chunks, trigram.hay_a("doc_path"))
    pick = lambda df: sorted(map(str, df.collect()))
    assert pick(engines.search_a(index, asked, none, 4, words)) == pick(engines.search_a(index, asked, none, 4))
