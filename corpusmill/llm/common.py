"""Building blocks shared by the training-data operators.

* ``materialize`` (of ``corpusmill.runtime``) cuts lineage with a Parquet table in the
  shared folder named by ``spark.checkpoint.dir`` (executors may be lost at any time);
  ``release`` deletes such tables.
* :func:`key_bitmap` / :func:`probe` are a filter of fixed size: a set of keys
  hashed into ``2**log2_bits`` bits.  It is broadcast, and its size is known
  before it is built, whatever the size of the data.
* :func:`join_unique` joins many rows to one row per key.  Keys that hold more
  than a thousandth of all rows (at most a thousand of them) or COLD_ROWS are
  broadcast, the rest is shuffled, so no task receives a hot key.
* :func:`drop_keys` removes listed keys from a wide table and shuffles only
  the rows that the filter cannot clear.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.runtime import materialize, release, shared_dir, ship, tables

__all__ = ["materialize", "release", "shared_dir", "ship", "tables"]

#: A key is hot when it holds more than one row in this many.
HOT_SHARE = 1000
#: A key is hot, too, with more rows than this, so that no task gets more of one key: 100,000 keys of 100 billion rows.
COLD_ROWS = 1_000_000
#: Bits of one bitmap row; fixed by Spark's bitmap functions.
_ROW_BITS = 15
#: Largest filter: 2**27 bits are 16 MB, the most that is ever broadcast.
MAX_LOG2_BITS = 27
#: Keys above which a filter is too full to be of use (four bits a key): joins then go without it.
FILTER_KEYS = 1 << (MAX_LOG2_BITS - 2)
#: The ASCII white space that separates words, as a character class.
SPACE = r"[\x20\x09-\x0D]"


def tidied(task: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The same task for ``mapInArrow``; at its end the worker, which goes on to other tasks, gives unused memory back."""

    def run(batches: Iterator) -> Iterator:
        yield from task(batches)
        import ctypes

        import pyarrow

        pyarrow.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # not with every C library
            return

    return run


def small_batches(spark: SparkSession, rows: int = 400) -> None:
    """Bound the Arrow batches sent to Python: rows and, where Spark knows it, bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    try:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")
    except Exception:  # an older Spark without the setting
        return


def text_of(col: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def log2_bits_for(n: int, per_key: int = 16) -> int:
    """Bits for ``n`` keys at ``per_key`` bits each, between 2**16 and 2**27."""
    return max(16, min(MAX_LOG2_BITS, (max(1, n) * per_key - 1).bit_length()))


def _slot(key: Column, log2_bits: int) -> Column:
    return F.pmod(key, F.lit(1 << log2_bits))


def key_bitmap(keys: DataFrame, key: Column, log2_bits: int) -> DataFrame:
    """Rows ``(_block, _bits)``: at most ``2**(log2_bits - 15)`` of 4 KB each."""
    slot = _slot(key, log2_bits)
    rows = keys.select(F.shiftright(slot, _ROW_BITS).alias("_block"), slot.bitwiseAND(F.lit((1 << _ROW_BITS) - 1)).alias("_at"))
    return rows.groupBy("_block").agg(F.bitmap_construct_agg("_at").alias("_bits"))


def probe(df: DataFrame, key: Column, bitmap: DataFrame, log2_bits: int, flag: str) -> DataFrame:
    """Add boolean ``flag``: false means that the key is surely not in the set."""
    df = df.withColumn("_slot", _slot(key, log2_bits)).withColumn("_block", F.shiftright("_slot", _ROW_BITS))
    at = F.col("_slot").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    byte = F.conv(F.hex(F.substring(F.col("_bits"), F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.call_function("shiftright", byte, at.bitwiseAND(F.lit(7)).cast("int")).bitwiseAND(F.lit(1))
    hit = F.coalesce(bit == 1, F.lit(False))
    return df.join(F.broadcast(bitmap), "_block", "left").withColumn(flag, hit).drop("_block", "_slot", "_bits")


def _null_safe(left: DataFrame, right: DataFrame, on: Sequence[str]) -> Column:
    cond = F.lit(True)
    for k in on:
        cond = cond & left[k].eqNullSafe(right[f"_r_{k}"])
    return cond


def join_unique(left: DataFrame, right: DataFrame, on: Sequence[str], size: str, total: int, keep_unmatched: bool = True) -> DataFrame:
    """Join ``left`` to the single row that ``right`` has for each key; nulls are equal.

    ``right[size]`` is the number of left rows of the key and ``total`` their sum:
    at most ``HOT_SHARE`` keys can hold more than ``total / HOT_SHARE`` rows, and ``total / COLD_ROWS``
    more than COLD_ROWS.  Those are broadcast; all other keys are shuffled and none of them is large.
    """
    limit = max(1000, min(total // HOT_SHARE, COLD_ROWS))
    renamed = right.select(*[F.col(c).alias(f"_r_{c}" if c in on else c) for c in right.columns])
    hot = F.broadcast(renamed.filter(F.col(size) > limit))
    rest = renamed.filter(F.col(size) <= limit)
    drop = [f"_r_{k}" for k in on]
    a = left.join(hot, _null_safe(left, hot, on), "inner").drop(*drop)
    cold = left.join(hot, _null_safe(left, hot, on), "left_anti")
    b = cold.join(rest, _null_safe(cold, rest, on), "left" if keep_unmatched else "inner").drop(*drop)
    return a.unionByName(b)


def boxed(df: DataFrame) -> Column:
    """The whole row as one struct, so that no column of the table can clash with those an operator adds."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row")


def unboxed(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*[F.col("_row").getField(c).alias(c) for c in columns])


def with_lists(rows: DataFrame, lists: DataFrame, n: int, on: Sequence[str], keep_rest: bool = False, size: str | None = None, total: int = 0) -> DataFrame:
    """``rows`` joined to the row that ``lists`` has for some keys (nulls are equal); of the others only as many are shuffled as the filter cannot clear.

    ``n`` is the number of ``lists``.  With ``keep_rest`` rows without a list stay, with nulls.
    Where a key can be hot, ``size`` names its number of rows and ``total`` is their sum, as for :func:`join_unique`.
    """

    def join(left: DataFrame) -> DataFrame:
        if size:
            return join_unique(left, lists, on, size, total, keep_rest)
        renamed = lists.select(*[F.col(c).alias(f"_r_{c}" if c in on else c) for c in lists.columns])
        return left.join(renamed, _null_safe(left, renamed, on), "left" if keep_rest else "inner").drop(*[f"_r_{k}" for k in on])

    if n > FILTER_KEYS:
        return join(rows)
    bits, key = log2_bits_for(n), F.xxhash64(*on)
    marked = probe(rows, key, key_bitmap(lists, key, bits), bits, "_flag")
    out = join(marked.filter("_flag").drop("_flag"))
    return out.unionByName(marked.filter(~F.col("_flag")).drop("_flag"), allowMissingColumns=True) if keep_rest else out


def row_counts(rows: DataFrame, lists: DataFrame, n: int, on: Sequence[str]) -> DataFrame:
    """``lists``, a row a key, with the number of ``rows`` of that key as ``copies``; ``n`` is the number of ``lists``."""
    if n <= FILTER_KEYS:
        bits, key = log2_bits_for(n), F.xxhash64(*on)
        rows = probe(rows, key, key_bitmap(lists, key, bits), bits, "_flag").filter("_flag")
    counts = rows.groupBy(*[F.col(k).alias(f"_r_{k}") for k in on]).agg(F.count("*").alias("copies"))
    found = lists.join(counts, _null_safe(lists, counts, on), "left").drop(*[f"_r_{k}" for k in on])
    return materialize(found.withColumn("copies", F.coalesce("copies", F.lit(0))), "row-counts")


def drop_keys(df: DataFrame, keys: DataFrame, n_keys: int, exprs: dict[str, Column], total: int = 0) -> DataFrame:
    """Rows of ``df`` whose key is not in ``keys``; only rows the filter flags are shuffled.

    ``exprs`` gives for each column of ``keys`` the expression over ``df``.  Nulls are equal.
    With ``total``, ``keys`` has one row per key and its number of rows in ``copies``; hot keys then are no hot task.
    """
    if not n_keys:
        return df
    names = list(exprs)
    rows = df.select(boxed(df), *[e.alias(k) for k, e in exprs.items()])
    listed = keys.select(*names, *(["copies"] if total else [])).distinct().withColumn("_gone", F.lit(True))
    found = with_lists(rows, listed, n_keys, names, True, "copies" if total else None, total)
    return unboxed(found.filter("_gone IS NULL"), df.columns)
