"""Embedding through a pluggable model, and a deterministic native one for tests.

``Embedder`` is what a model needs to offer; :func:`embed` runs it in Arrow batches,
loads it once a task, retries a failed batch row by row and checks the count.
``hash_embed`` needs no model; an Arrow UDF digests each word of a batch once.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from hashlib import md5
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.runtime import ship


class Embedder(Protocol):
    dim: int

    def embed(self, texts: list[str]) -> np.ndarray:
        """One row per text."""


class HashEmbedder:
    """Bag of words: each word adds one to the bucket that its MD5 names.

    White space and lower case are those of the SQL: ``T.SQL_SPACE``, and each character becomes one other.
    """

    _space = re.compile(T.SQL_SPACE)

    def __init__(self, dim: int = 64) -> None:
        self.dim = dim

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for i, text in enumerate(texts):
            for word in filter(None, self._space.split(text.replace("İ", "i").replace("Σ", "σ").lower())):
                out[i, int(md5(word.encode()).hexdigest()[:7], 16) % self.dim] += 1
        return out


def _rows(model: Embedder, texts: list[str]) -> np.ndarray:
    try:
        found = np.asarray(model.embed(texts), dtype=float)
    except RuntimeError:
        found = np.vstack([np.asarray(model.embed([t]), dtype=float) for t in texts])
    if found.shape[0] != len(texts):
        raise ValueError(f"the model gave {found.shape[0]} vectors for {len(texts)} texts")
    size = np.linalg.norm(found, axis=1, keepdims=True)
    return np.divide(found, size, out=found.copy(), where=size > 0)


def embed(df: DataFrame, make: Callable[[], Embedder], text_col: str = "chunk_text", batch: int = 64, max_tokens: int | None = None) -> DataFrame:
    """Adds ``embedding array<float>``, of unit length."""
    source = df if max_tokens is None else df.withColumn("_cut", T.truncate_tokens(F.col(text_col), max_tokens, T.SQL_SPACE))
    column = text_col if max_tokens is None else "_cut"
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", embedding array<float>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()
        for rows in batches:
            texts = [t or "" for t in rows.column(rows.schema.get_field_index(column)).to_pylist()]
            found = [v for i in range(0, len(texts), batch) for v in _rows(model, texts[i : i + batch]).astype(np.float32).tolist()]
            keep = [i for i, n in enumerate(rows.schema.names) if n != "_cut"]
            yield pa.RecordBatch.from_arrays([*(rows.column(i) for i in keep), pa.array(found, pa.list_(pa.float32()))], [*(rows.schema.names[i] for i in keep), "embedding"])

    ship(df.sparkSession)
    return source.mapInArrow(run, schema)


#: Bytes of text, unless one text has more, whose words are counted at once.
BYTES = 8 << 20


def _parts(texts: pa.Array) -> Iterator[pa.Array]:
    ends, start = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64), 0
    while start < len(texts):
        before = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + BYTES, side="right")))
        yield texts.slice(start, end - start)
        start = end


def _bags(texts: pa.Array, dim: int) -> pa.Array:
    """Unit vectors of bags of words; nulls for null.  A word is digested once, however often it stands there."""
    lists = pc.ascii_split_whitespace(texts)  # the white space of T.words
    coded = pc.list_flatten(lists).dictionary_encode()
    words = coded.dictionary.cast(pa.binary()).to_pylist()
    bucket = (np.frombuffer(b"".join([md5(w).digest() for w in words]), ">u4")[::4] >> 4).astype(np.int64) % dim
    counts = np.array([w != b"" for w in words], dtype=float)  # at the ends of a text the split leaves an empty word
    word = coded.indices.to_numpy()
    at = pc.list_parent_indices(lists).to_numpy() * dim + bucket[word]
    found = np.bincount(at, counts[word], len(texts) * dim).reshape(-1, dim)
    size = np.sqrt((found * found).sum(axis=1, keepdims=True))
    np.divide(found, size, out=found, where=size > 0)
    missing = np.repeat(texts.is_null().to_numpy(zero_copy_only=False), dim)
    return pa.ListArray.from_arrays(np.arange(len(texts) + 1, dtype=np.int32) * dim, pa.array(found.ravel(), mask=missing))


def hash_embed(df: DataFrame, text_col: str = "chunk_text", dim: int = 64) -> DataFrame:
    """Adds ``embedding array<double>``: :class:`HashEmbedder` over Spark's lower case and all ASCII white space, of unit length."""

    @F.arrow_udf("array<double>")
    def bags(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.concat_arrays([_bags(part, dim) for part in _parts(texts)] or [pa.array([], pa.list_(pa.float64()))])

    ship(df.sparkSession)
    return df.withColumn("embedding", bags(F.lower(text_col)))


def embed_pairs(pairs: DataFrame, dim: int = 64) -> DataFrame:
    """Key and value vectors of every pair, end to end: ``embedding`` of twice ``dim``."""
    both = hash_embed(hash_embed(pairs, "key", dim).withColumnRenamed("embedding", "_k"), "value", dim)
    return both.withColumn("embedding", F.concat("_k", "embedding")).drop("_k")
