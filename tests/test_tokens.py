import random

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import embed, pack, tokens
from corpusmill.plans import engines
from corpusmill.settings import SettingsB

WORDS = "the a fox, jumps over\tlazy dogs — naïve 日本語 🎉 under-score supercalifragilistic \n\n x".split(" ")


class Pairs:
    """A tokenizer of subwords: every two characters of a word, never across white space."""

    def ends(self, texts):
        out = []
        for t in texts:
            mine, size = [], 0
            for i, c in enumerate(t):
                size = 0 if c.isspace() else size + 1
                if size and (size % 2 == 0 or i + 1 == len(t) or t[i + 1].isspace()):
                    mine.append(i + 1)
            out.append(mine)
        return out


def library():
    """A byte-level BPE of a library, by the places of its tokens."""
    T = pytest.importorskip("tokenizers")
    P = pytest.importorskip("public_tokenizers")
    path = P.path("byte_bpe_50k.json")

    class Bpe:
        def __init__(self):
            self.model = T.Tokenizer.from_file(path)

        def ends(self, texts):
            return [[b for _, b in e.offsets] for e in self.model.encode_batch(texts, add_special_tokens=False)]

    return Bpe


@pytest.fixture(scope="module")
def asked(spark):
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    rows = [(q, text(rng.randint(0, 6)), [(h + 1, rng.random(), f"d/{h}.md", h, text(rng.randint(0, 200))) for h in range(q % 9)]) for q in range(40)]
    return spark.createDataFrame(rows, "query_id long, question string, hits array<struct<rank:int,score:double,doc_path:string,chunk_id:int,chunk_text:string>>")


@pytest.mark.parametrize("room", [120, 300, 600, 2048])
def test_fitting_by_sums_is_fitting_by_prompts(asked, room):
    s = SettingsB(n_ctx=room, max_tokens=20)
    fit = lambda df: sorted((r.query_id, *r.fit) for r in df.select("query_id", "fit").collect())
    assert fit(tokens.fit_counted(asked, tokens.WordTokenizer, s)) == fit(pack.fit_context(asked, s))


@pytest.mark.parametrize("make", [lambda: Pairs, library])
def test_sums_are_the_tokens_of_the_prompt(asked, make):
    plug, s = make(), SettingsB(n_ctx=900, max_tokens=20)
    rows = tokens.fit_counted(asked, plug, s)
    context = pack.shown(F.slice("hits", F.lit(1), F.col("fit.n_hits")), F.col("fit.chars"), s.policy)
    prompt = pack.prompt_text(pack.messages(F.col("question"), context, s.system_prompt))
    told = tokens.count_tokens(rows.withColumn("prompt", prompt), plug, "prompt", "real").select("fit", "real", "hits").collect()
    if plug is Pairs:
        assert all(r.fit.tokens == r.real for r in told)
    assert all(abs(r.fit.tokens - r.real) <= 3 + 2 * len(r.hits) for r in told)
    assert {r.fit.fits for r in told} == {True, False} or max(r.fit.state for r in told) > 0


def test_cuts_at_token_ends(spark):
    rows = spark.createDataFrame([(0, "ab cde  f"), (1, "ab"), (2, ""), (3, None), (4, " 日本語 x")], "i int, text string")
    assert [r.cut for r in tokens.truncate(rows, Pairs, 2).orderBy("i").collect()] == ["ab cd", "ab", "", None, " 日本語"]
    assert [r.tokens for r in tokens.count_tokens(rows, Pairs).orderBy("i").collect()] == [4, 1, 0, None, 3]
    assert tokens.truncate(rows, Pairs, 0).filter("i = 0").first().cut == ""
    byte = tokens.truncate(rows, library(), 2).orderBy("i").collect()
    assert all(r.text.startswith(r.cut) for r in byte if r.text is not None)


def test_a_plug_that_loses_texts_is_an_error(spark):
    class Broken:
        def ends(self, texts):
            return [[]]

    with pytest.raises(Exception, match="told of 1 texts, not 2"):
        tokens.count_tokens(spark.createDataFrame([("a",), ("b",)], "text string").coalesce(1), Broken).collect()


def test_engine_b_with_a_tokenizer(spark):
    docs = spark.createDataFrame([(i, f"d/{i}.md", f"words of document {i} " * 30) for i in range(5)], "file_ord long, source_path string, text string")
    chunks = engines.ingest_b(docs)
    index = engines.embed_b(chunks, embed.HashEmbedder, tokenizer=tokens.WordTokenizer)
    pick = lambda df: sorted(map(str, df.collect()))
    assert pick(index) == pick(engines.embed_b(chunks, embed.HashEmbedder))
    asks = spark.createDataFrame([(0, "words of document 3"), (1, "nothing like it"), (2, "")], "query_id long, question string")
    assert pick(engines.ask_b(index, asks, tokenizer=tokens.WordTokenizer)) == pick(engines.ask_b(index, asks))
    tight = SettingsB(n_ctx=420, max_tokens=40)
    assert {r.query_id: r.route for r in engines.ask_b(index, asks, settings=tight, tokenizer=Pairs).collect()}[0] in ("context", "general")
