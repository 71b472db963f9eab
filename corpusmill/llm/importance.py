"""Operator 3, quality selection by importance resampling.

Two generative models over hashed word n-grams (bags of unigrams and bigrams in
BUCKETS buckets) are counted: one of the target text, one of all raw text.  A
document's log weight is the log ratio of its probability under the two.  Adding
Gumbel noise and taking the top k draws k documents without replacement with
probability in proportion to their weights.

The raw model counts every document.  The target model counts the documents a
labels table marks as good, at most TARGET_DOCS of them, chosen by a hash of the id
(the documented bound of the sample; their ids are broadcast).  What reaches the
driver is the two models: 2 * BUCKETS sums.  The noise is a function of the id, so a
rerun draws the same rows.  The k-th key is found exactly by counting key digits,
four small aggregations over narrow rows; nothing is sorted or collected.

Defined results.  Null, empty and wordless texts have weight 0 in log.  Texts of any length
are read whole, one at a time.  Null ids share one noise value.  Rows whose key ties with the k-th are all drawn, so rows that repeat
a document are drawn together.  Without target documents all log weights are 0.  An
empty table gives no rows.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm import common as C

BUCKETS = 1 << 14
TARGET_DOCS = 20_000
#: Share of the documents that is drawn.
SHARE = 0.8
SMOOTHING = 1.0
_MIX = np.uint32(2654435761)
#: Keys are compared as whole millionths, shifted to be positive.
_SCALE, _SHIFT = 1_000_000, 1 << 62


def gram_buckets(text: bytes) -> np.ndarray:
    """Buckets of the text's lower-cased words and neighbouring word pairs."""
    words = text.lower().split()
    one = np.array([xxhash.xxh32_intdigest(w) for w in words], np.uint32)
    two = (one[:-1] * _MIX) ^ (one[1:] + np.uint32(0x9E3779B9))
    both = np.concatenate([one, two * _MIX])
    return (both ^ (both >> np.uint32(15))) & np.uint32(BUCKETS - 1)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for text, good in zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist()):
            if text:
                ids, n = np.unique(gram_buckets(text), return_counts=True)
                raw[ids] += n
                if good:
                    target[ids] += n
    at = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], ["bucket", "raw", "target"])


def _weigh(ratio: object):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ratio.value
        for batch in batches:
            out = [float(table[gram_buckets(t)].sum()) if t else 0.0 for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], ["doc_id", "log_weight"])

    return run


def kth_largest(keys: DataFrame, k: int) -> int | None:
    """The ``k``-th largest of the non-negative longs in ``key``, exactly, 16 bits a round."""
    if k <= 0:
        return None
    prefix, left = 0, k
    for shift in (48, 32, 16, 0):
        digit = F.shiftrightunsigned("key", shift).bitwiseAND(F.lit(0xFFFF))
        same = keys if shift == 48 else keys.filter(F.shiftrightunsigned("key", shift + 16) == F.lit(prefix >> (shift + 16)))
        counts = {r["digit"]: r["count"] for r in same.groupBy(digit.alias("digit")).count().toLocalIterator()}  # at most 65,536 rows
        for d in sorted(counts, reverse=True):
            if left <= counts[d]:
                prefix |= d << shift
                break
            left -= counts[d]
        else:
            return 0
    return prefix


def resample(docs: DataFrame, target_ids: DataFrame, share: float = SHARE, id_col: str = "doc_id", text_col: str = "text", target_docs: int = TARGET_DOCS, seed: int = 11) -> DataFrame:
    """One row per document: doc_id, log_weight, gumbel_key, kept."""
    spark = docs.sparkSession
    C.ship(spark)
    C.small_batches(spark)
    good = target_ids.select(F.col(target_ids.columns[0]).alias("_good_id")).filter("_good_id IS NOT NULL").distinct()
    good = good.orderBy(F.xxhash64("_good_id"), "_good_id").limit(target_docs).withColumn("_good", F.lit(True))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    marked = rows.join(F.broadcast(good), rows["doc_id"] == good["_good_id"], "left").select("text", F.coalesce("_good", F.lit(False)).alias("good"))
    sums = marked.mapInArrow(C.tidied(_count), "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    model = np.zeros((2, BUCKETS))
    model[:, sums["bucket"].to_numpy(dtype=np.int64)] = sums[["target", "raw"]].to_numpy(dtype=float).T
    if model[0].any():
        model += SMOOTHING
        model /= model.sum(1, keepdims=True)
        ratio = np.log(model[0]) - np.log(model[1])
    else:
        ratio = np.zeros(BUCKETS)
    weighed = rows.mapInArrow(C.tidied(_weigh(spark.sparkContext.broadcast(ratio))), f"doc_id {docs.schema[id_col].dataType.simpleString()}, log_weight double")
    even = (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    keyed = C.materialize(weighed.withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(even))), "importance-keys")
    whole = keyed.withColumn("key", F.round(F.col("gumbel_key") * _SCALE).cast("long") + F.lit(_SHIFT))
    limit = kth_largest(whole.select("key"), round(share * keyed.count()))
    return whole.withColumn("kept", F.lit(False) if limit is None else F.col("key") >= limit).drop("key")
