"""Lexical search over an index of character trigrams instead of a loop over all chunks.

The index has the chunks' lower-cased text (``hay``), the posting lists ``gram, block, n, ords``
(chunks by number; a list is at most a block of chunks) in order of the gram, so that a
search reads the row groups of its own grams, and each gram's number of chunks.  The text is
padded with two NULs, so every character begins a gram: a term of one to three characters is
held where some gram begins with it.  For a longer term the chunks that have its PROBES
rarest grams are candidates, and only those meet the substring test.  Scores, ties and ranks
are those of :mod:`corpusmill.operators.retrieve`.

A row is moved for each entry of the lists that are read, so they are for a search that reads
few: past LISTED entries, or where no lists are kept, the questions go to the chunks, and the
tasks make the trigrams of their chunks as they pass (:mod:`corpusmill.operators.blocks`).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators import blocks
from corpusmill.operators.retrieve import top_k
from corpusmill.runtime import materialize

#: Grams of a term that are looked up; the shortest term that has grams of its own.
PROBES, GRAM = 3, 3
#: Chunks of a block, on average.
BLOCK_CHUNKS = 8192
#: Grams, or beginnings of grams, that are sent to the scan as a filter; more are only joined.
PUSHED = 500
#: Entries of lists that a search moves at most.
LISTED = 1_000_000
_PAD = "\x00" * (GRAM - 1)


def hay_a(path_col: str = "source_path") -> Column:
    """What engine A's words are looked for in."""
    return F.lower(F.concat_ws(" ", "chunk_text", path_col))


def hay_b(path_col: str = "doc_path") -> Column:
    """What engine B's query and terms are looked for in."""
    return F.concat_ws("\n", F.lower("chunk_text"), F.lower(path_col), F.lower(T.stem(F.col(path_col))))


def grams(text: Column) -> Column:
    """The distinct trigrams of a text; none if it is shorter."""
    chars = F.split(text, "")
    pairs = F.zip_with(chars, F.slice(chars, F.lit(2), F.greatest(F.size(chars), F.lit(1))), lambda a, b: F.concat(a, b))
    made = F.zip_with(pairs, F.slice(chars, F.lit(3), F.greatest(F.size(chars), F.lit(1))), lambda a, b: F.concat(a, b))
    return F.array_distinct(F.filter(made, lambda g: g.isNotNull()))


@dataclass(frozen=True)
class TrigramIndex:
    hay: DataFrame
    postings: DataFrame | None = None
    frequencies: DataFrame | None = None

    @staticmethod
    def in_tasks(chunks: DataFrame, hay: Column) -> TrigramIndex:
        """Nothing is kept: each search makes the trigrams anew, in the tasks, which takes one pass and no disk."""
        return TrigramIndex(chunks.select("chunk_ord", hay.alias("hay")))

    @staticmethod
    def build(chunks: DataFrame, hay: Column, path: str | None = None) -> TrigramIndex:
        """Of ``chunk_ord`` (unique) and the columns of ``hay``; kept at ``path``, or in the shared folder as long as the caller wants."""

        def kept(df: DataFrame, name: str) -> DataFrame:
            if path is None:
                return materialize(df, f"trigram-{name}")
            df.write.mode("overwrite").parquet(f"{path}/{name}")
            return df.sparkSession.read.schema(df.schema).parquet(f"{path}/{name}")

        texts = kept(chunks.select("chunk_ord", hay.alias("hay")), "hay")
        blocks = max(1, -(-texts.count() // BLOCK_CHUNKS))
        rows = texts.select("chunk_ord", F.pmod(F.xxhash64("chunk_ord"), F.lit(blocks)).alias("block"), F.explode(grams(F.concat("hay", F.lit(_PAD)))).alias("gram"))
        lists = rows.groupBy("gram", "block").agg(F.sort_array(F.collect_list("chunk_ord")).alias("ords"))
        lists = lists.select("gram", "block", F.size("ords").cast("long").alias("n"), "ords")
        postings = kept(lists.repartitionByRange("gram", "block").sortWithinPartitions("gram", "block"), "postings")
        return TrigramIndex(texts, postings, kept(postings.groupBy("gram").agg(F.sum("n").alias("n")), "frequencies"))

    @staticmethod
    def load(spark: SparkSession, path: str) -> TrigramIndex:
        return TrigramIndex(*(spark.read.parquet(f"{path}/{name}") for name in ("hay", "postings", "frequencies")))

    def _lists(self, wanted: DataFrame, key: str, length: int) -> DataFrame:
        """The lists whose gram begins with ``key``, which has ``length`` characters; few keys also narrow the scan."""
        mine = self.postings if length == GRAM else self.postings.withColumn("_start", F.substring("gram", 1, length))
        on = "gram" if length == GRAM else "_start"
        some = [r[0] for r in wanted.select(key).distinct().limit(PUSHED + 1).collect()]
        if len(some) <= PUSHED:
            mine = mine.filter(F.col("gram").isin(some) if length == GRAM else F.col(on).isin(some) & (F.col("gram") >= min(some, default="")))
        return wanted.join(mine, wanted[key] == mine[on]).select("term", "gram", F.explode("ords").alias("chunk_ord"))

    def _rarest(self, terms: DataFrame) -> DataFrame:
        """``term, probe, n``: the PROBES rarest grams of each term that has grams of its own, and their numbers of chunks."""
        parts = terms.filter(F.length("term") > GRAM).select("term", F.explode(grams(F.col("term"))).alias("probe"))
        known = parts.join(self.frequencies.withColumnRenamed("gram", "probe"), "probe", "left").withColumn("n", F.coalesce("n", F.lit(0)))
        return known.withColumn("_r", F.row_number().over(Window.partitionBy("term").orderBy("n", "probe"))).filter(F.col("_r") <= PROBES)

    def few(self, terms: DataFrame) -> bool:
        """Are there lists, and do those of distinct ``terms`` have LISTED entries at most?"""
        if self.postings is None:
            return False
        read = self._rarest(terms).select("n")
        for size in range(1, GRAM + 1):
            begun = self.frequencies.groupBy(F.substring("gram", 1, size).alias("term")).agg(F.sum("n").alias("n"))
            read = read.unionByName(terms.filter(F.length("term") == size).join(begun, "term").select("n"))
        return (read.agg(F.sum("n")).first()[0] or 0) <= LISTED

    def candidates(self, terms: DataFrame) -> DataFrame:
        """``term, chunk_ord``, each pair once, of distinct ``terms``: all chunks that can hold a term."""
        short = [self._lists(terms.filter(F.length("term") == n), "term", n).select("term", "chunk_ord").distinct() for n in range(1, GRAM + 1)]
        rarest = materialize(self._rarest(terms).select("term", "probe", F.count("*").over(Window.partitionBy("term")).alias("probes")), "trigram-probes")
        met = self._lists(rarest.select("term", "probe"), "probe", GRAM).groupBy("term", "chunk_ord").agg(F.count("*").alias("met"))
        long = met.join(rarest.select("term", "probes").distinct(), "term").filter("met = probes").select("term", "chunk_ord")
        return short[0].unionByName(short[1]).unionByName(short[2]).unionByName(long)

    def held(self, terms: DataFrame) -> DataFrame:
        """``term, chunk_ord, times``: the chunks that hold each of distinct ``term, counted`` as a substring.

        ``times`` is 1, or the number of occurrences that do not overlap where ``counted``.  Only terms whose grams do
        not settle it meet a text: long ones, those that are counted, and those with the character of the padding.
        """
        met = self.candidates(terms.select("term")).join(terms, "term")
        settled = (F.length("term") <= GRAM) & ~F.col("counted") & ~F.contains("term", F.lit("\x00"))
        sure = met.filter(settled).select("term", "chunk_ord", F.lit(1).alias("times"))
        asked = met.filter(~settled).groupBy("chunk_ord").agg(F.collect_list(F.struct("term", "counted")).alias("_asked"))
        tested = asked.join(self.hay, "chunk_ord").select("chunk_ord", "hay", F.explode("_asked").alias("_a")).filter(F.contains("hay", F.col("_a.term")))
        times = F.when(F.col("_a.counted"), T.count_of(F.col("hay"), F.col("_a.term"))).otherwise(1)
        return sure.unionByName(tested.select(F.col("_a.term").alias("term"), "chunk_ord", times.alias("times")))


def lexical_a(index: TrigramIndex, questions: DataFrame, k: int) -> DataFrame:
    """Rows ``query_id, rank, score, chunk_ord`` of :func:`retrieve.lexical_a`, ``index`` over :func:`hay_a`."""
    tokens = questions.select("query_id", T.query_tokens_a(F.col("question")).alias("_t"))
    asked = tokens.select("query_id", F.size("_t").alias("of"), F.explode("_t").alias("term"))
    asked = materialize(asked.groupBy("query_id", "term", "of").agg(F.count("*").alias("share")), "trigram-asked")
    if not index.few(asked.select("term").distinct()):
        return blocks.search(index.hay, tokens.select("query_id", F.col("_t").alias("words"), F.lit(None).cast("string").alias("whole")), k)
    held = index.held(asked.select("term", F.lit(False).alias("counted")).distinct())
    scored = held.join(asked, "term").groupBy("query_id", "chunk_ord").agg((F.sum("share") / F.first("of")).alias("score"))
    return top_k(scored, k).select("query_id", "rank", "score", "chunk_ord")


def keyword_b(index: TrigramIndex, questions: DataFrame, k: int = 8) -> DataFrame:
    """Rows ``query_id, rank, score, chunk_ord`` of :func:`retrieve.keyword_b`, ``index`` over :func:`hay_b`."""
    whole = F.lower(T.strip(F.col("question")))
    read = questions.select("query_id", whole.alias("_q"), T.query_tokens_b(F.col("question")).alias("_t")).filter(F.size("_t") > 0)
    parts = F.array_union(F.array("_q"), F.col("_t"))
    asked = read.select("query_id", "_q", "_t", F.size("_t").alias("of"), F.explode(parts).alias("term"))
    share = F.size(F.filter("_t", lambda t: t == F.col("term")))
    asked = materialize(asked.select("query_id", "term", "of", (F.col("term") == F.col("_q")).alias("whole"), share.alias("share")), "trigram-asked")
    if not index.few(asked.select("term").distinct()):
        return blocks.search(index.hay, read.select("query_id", F.col("_t").alias("words"), F.col("_q").alias("whole")), k)
    held = index.held(asked.groupBy("term").agg(F.max("whole").alias("counted")))
    met = held.join(asked, "term").groupBy("query_id", "chunk_ord").agg(F.max(F.when(F.col("whole"), F.col("times"))).alias("times"), (F.sum("share") / F.first("of")).alias("part"))
    score = F.when(F.col("times").isNotNull(), 2 + F.least(F.lit(1.0), F.lit(0.1) * F.col("times"))).otherwise(F.col("part"))
    return top_k(met.withColumn("score", score).filter("score > 0"), k).select("query_id", "rank", "score", "chunk_ord")
