"""Overlapping windows in closed form: no loop, no Python, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import text as T


def check_geometry(size: int, overlap: int) -> int:
    """The step between windows."""
    if size <= 0:
        raise ValueError("chunk size must be positive")
    if not 0 <= overlap < size:
        raise ValueError("chunk overlap must be at least 0 and below the size")
    return size - overlap


def windows(text: Column, size: int, overlap: int) -> Column:
    """Stripped windows ``(win, chunk)`` of a text, blank ones left out; linear in the length.

    The text is cut into blocks of one step in a single pass, and a window joins the
    blocks that it spans, so no window is looked for from the start of the text.
    """
    step = check_geometry(size, overlap)
    spans = -(-size // step)

    def cut(t: Column) -> Column:
        n = F.length(t)
        count = F.when(n <= size, 1).otherwise(1 + F.ceil((n - size) / F.lit(float(step)))).cast("int")
        blocks = F.regexp_extract_all(t, F.lit(f"(?s).{{1,{step}}}+"), F.lit(0))
        part = lambda b, i: T.strip(F.substring(F.array_join(F.slice(b, i + 1, F.lit(spans)), ""), 1, size))
        return T.once(blocks, lambda b: F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct(i.alias("win"), part(b, i).alias("chunk"))))

    return F.filter(T.once(text, cut), lambda w: w["chunk"] != "")


def chunk_a(docs: DataFrame, size: int = 1000, overlap: int = 200, text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` times windows: ``win``, ``chunk_text``.  Null and blank texts give none."""
    return docs.withColumn("_w", F.explode(windows(T.normalize_newlines(F.col(text_col)), size, overlap))).drop(text_col).select("*", F.col("_w.win").alias("win"), F.col("_w.chunk").alias("chunk_text")).drop("_w")


def chunk_b(docs: DataFrame, size: int = 1500, overlap: int = 150, text_col: str = "text") -> DataFrame:
    """As :func:`chunk_a` after squeezing blank lines; ``chunk_id`` counts the windows kept, from 0."""
    text = T.squeeze_blank_lines(T.normalize_newlines(F.col(text_col)))
    made = docs.select("*", F.posexplode(windows(text, size, overlap)).alias("chunk_id", "_w"))
    return made.drop(text_col).withColumn("chunk_text", F.col("_w.chunk")).drop("_w")


def cap_chunks(chunks: DataFrame, cap: int, order: list[str]) -> DataFrame:
    """The first ``cap`` chunks in document order: a top-k, not a full sort."""
    return chunks.orderBy(*order).limit(cap)
