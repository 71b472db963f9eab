"""Retrieval: exact vector top-k, two lexical scores, and the merges of their hits.

Questions are a small side that is checked before it is broadcast: they are cut into
blocks of BLOCK rows, and each block meets all chunks once.  Every task keeps the
best ``k`` of each question before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.runtime import ship

#: Questions that are broadcast together.
BLOCK = 2000
#: Query vectors and vectors in one matrix product (some 2 MB and a few copies), and bytes of query vectors that are broadcast together.
VECTOR_QUERIES, VECTOR_ROWS, QUERY_BYTES = 256, 1024, 64 << 20
#: Scores are compared at this many digits, so that the order of summing does not decide.
DIGITS = 6


def _blocks(questions: DataFrame) -> list[DataFrame]:
    n = questions.count()
    if n <= BLOCK:
        return [questions]
    parts = -(-n // BLOCK) * 2  # by hash: half full on average
    return [questions.filter(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i) for i in range(parts)]


def top_k(hits: DataFrame, k: int, by: str = "query_id", order: tuple[str, ...] = ("chunk_ord",)) -> DataFrame:
    """The ``k`` best of each question with their ``rank``; ties go to the earlier row."""
    w = Window.partitionBy(by).orderBy(F.desc("score"), *order)
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def vector_topk(vectors: DataFrame, queries: DataFrame, k: int, ord_col: str = "chunk_ord") -> DataFrame:
    """Exact inner product of unit vectors: ``query_id, rank, score, chunk_ord``.

    ``queries`` is ``query_id, embedding``, with one row per id.  Queries are broadcast,
    QUERY_BYTES at a time; each such part meets all vectors in one scan, VECTOR_QUERIES queries and
    VECTOR_ROWS vectors to a matrix product, and a task passes on its best ``k`` a query.
    Null vectors, and those that hold a null, are never met and ask nothing.
    """
    ship(vectors.sparkSession)
    whole = lambda df: df.filter(F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull()))
    asked = whole(queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding")))
    size = asked.agg(F.count("*").alias("n"), F.min(F.size("embedding")).alias("dim"), F.max(F.size("embedding")).alias("most")).first()
    if size["dim"] != size["most"]:
        raise ValueError("query vectors differ in length")
    spark = vectors.sparkSession
    if not size["n"]:
        return spark.createDataFrame([], "query_id long, rank int, score double, chunk_ord long")
    dim, parts = size["dim"], max(1, -(-size["n"] * (size["dim"] + 1) * 8 // QUERY_BYTES))
    source = whole(vectors.select(F.col(ord_col).cast("long").alias("chunk_ord"), F.col("embedding").cast("array<double>").alias("embedding")))
    found = []
    for i in range(parts):
        mine = asked if parts == 1 else asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i)
        ids, flat = [], []
        for row in mine.toLocalIterator():  # about QUERY_BYTES at most
            ids.append(row["query_id"])
            flat.append(np.array(row["embedding"]))
        if ids:
            shared = spark.sparkContext.broadcast((np.array(ids, np.int64), np.array(flat)))
            found.append(source.mapInArrow(_best_of(shared, k, dim), "query_id long, chunk_ord long, score double"))
    return top_k(reduce(DataFrame.unionByName, found), k).select("query_id", "rank", "score", "chunk_ord")


def _best_of(shared, k: int, dim: int):
    """Each query's ``k`` best of a task's vectors, kept as two arrays of queries times ``k``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, asked = shared.value
        best, at = np.full((len(ids), k), -np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)
        for batch in batches:
            for start in range(0, batch.num_rows, VECTOR_ROWS):
                part = batch.slice(start, VECTOR_ROWS)
                flat = np.asarray(part.column(1).flatten()).astype(np.float64)
                if len(flat) != part.num_rows * dim or (np.asarray(pc.list_value_length(part.column(1))) != dim).any():
                    raise ValueError("vectors differ in length from the queries")
                ords, matrix = part.column(0).to_numpy(), _unit(flat.reshape(part.num_rows, dim))
                for q in range(0, len(ids), VECTOR_QUERIES):
                    mine = slice(q, q + VECTOR_QUERIES)
                    score = np.round(_unit(asked[mine]) @ matrix.T, DIGITS)
                    both = np.hstack([best[mine], score])
                    where = np.hstack([at[mine], np.broadcast_to(ords, score.shape)])
                    if both.shape[1] > 4 * k:  # what scores below the k-th goes first; ties with it stay
                        limit = -np.partition(-both, k - 1, axis=1)[:, k - 1 : k]
                        most = int((both >= limit).sum(1).max())
                        pick = np.argpartition(-both, most - 1, axis=1)[:, :most]
                        both, where = np.take_along_axis(both, pick, 1), np.take_along_axis(where, pick, 1)
                    order = np.lexsort((where, -both), axis=1)[:, :k]
                    best[mine], at[mine] = np.take_along_axis(both, order, 1), np.take_along_axis(where, order, 1)
        hit = np.isfinite(best)
        rows = np.nonzero(hit)[0]
        yield pa.RecordBatch.from_arrays([pa.array(ids[rows]), pa.array(at[hit]), pa.array(best[hit])], ["query_id", "chunk_ord", "score"])

    return run


def _unit(m: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, size, out=m.copy(), where=size > 0)


def _meet(chunks: DataFrame, questions: DataFrame, terms: str, score: Column, prepare) -> DataFrame:
    """Chunks that hold a term of a question, which are those with a score above 0; a filter by score would compute it twice."""
    held = F.exists(terms, lambda t: F.contains(F.col("_hay"), t))
    parts = [chunks.join(F.broadcast(prepare(b)), F.lit(True)).filter(held).withColumn("score", score) for b in _blocks(questions)]
    return reduce(DataFrame.unionByName, parts)


def lexical_a(chunks: DataFrame, questions: DataFrame, k: int, path_col: str = "source_path") -> DataFrame:
    """Share of the question's words that text and path hold as substrings; above 0, best ``k``."""
    hay = chunks.withColumn("_hay", F.lower(F.concat_ws(" ", "chunk_text", path_col)))
    held = F.size(F.filter("_tokens", lambda t: F.contains(F.col("_hay"), t)))
    score = F.when(F.size("_tokens") > 0, held / F.size("_tokens")).otherwise(0.0)
    met = _meet(hay, questions, "_tokens", score, lambda q: q.withColumn("_tokens", T.query_tokens_a(F.col("question"))))
    return top_k(met.drop("_hay", "_tokens"), k)


def keyword_score(hay: Column, query: Column, terms: Column) -> Column:
    """2 and up for the whole query (0.1 a repeat, 3 at most), else the share of its terms.

    The tier between them in the studied rules is for one term, which then is the whole
    query: it is never reached and left out.
    """
    held = F.size(F.filter(terms, lambda t: F.contains(hay, t)))
    whole = 2 + F.least(F.lit(1.0), F.lit(0.1) * T.count_of(hay, query))
    return F.when(F.size(terms) == 0, 0.0).when(F.contains(hay, query), whole).otherwise(held / F.size(terms))


def keyword_b(chunks: DataFrame, questions: DataFrame, k: int = 8, path_col: str = "doc_path") -> DataFrame:
    """Keyword hits of engine B, best ``k`` of each question."""
    path = F.lower(path_col)
    hay = chunks.withColumn("_hay", F.concat_ws("\n", F.lower("chunk_text"), path, F.lower(T.stem(F.col(path_col)))))
    score = keyword_score(F.col("_hay"), F.col("_query"), F.col("_terms"))
    met = _meet(hay, questions, "_terms", score, lambda q: q.withColumn("_query", F.lower(T.strip(F.col("question")))).withColumn("_terms", T.query_tokens_b(F.col("question"))))
    return top_k(met.drop("_hay", "_query", "_terms"), k)


def fallback(primary: DataFrame, other: DataFrame) -> DataFrame:
    """``other``'s hits for questions that ``primary`` has none for."""
    ids = primary.select("query_id").distinct()
    return primary.unionByName(other.join(ids, "query_id", "left_anti"), allowMissingColumns=True)


def merge_variants(hits: DataFrame, path_col: str = "source_path", prefix: int = 80) -> DataFrame:
    """Engine A: the first hit met of each (path, first characters), by variant and rank; then by score.

    ``hits``: query_id, variant, rank, score, path, chunk_text.  Adds ``merged_rank``.
    """
    first = Window.partitionBy("query_id", path_col, F.substring("chunk_text", 1, prefix)).orderBy("variant", "rank")
    kept = hits.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    return kept.withColumn("merged_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "variant", "rank")))


def merge_hybrid(vec: DataFrame, kw: DataFrame, k: int, keys: tuple[str, ...] = ("doc_path", "chunk_id")) -> DataFrame:
    """Engine B: vector hits keep their score, chunks met by keyword alone get 0.05 more; best ``k``.

    Both: query_id, the keys, rank, score.  Ties: vector hits first, then by rank.
    """
    one = Window.partitionBy("query_id", *keys).orderBy("rank")
    first = lambda df: df.withColumn("_n", F.row_number().over(one)).filter("_n = 1").drop("_n")
    vec, kw = first(vec).withColumn("src", F.lit(0)), first(kw).withColumn("src", F.lit(1))
    extra = kw.join(vec.select("query_id", *keys), ["query_id", *keys], "left_anti").withColumn("score", F.col("score") + F.lit(0.05))
    both = vec.unionByName(extra, allowMissingColumns=True).withColumnRenamed("rank", "side_rank")
    return top_k(both, k, order=("src", "side_rank"))
