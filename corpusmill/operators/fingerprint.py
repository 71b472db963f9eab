"""Change detection over file listings (content is not read)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Values of ``file_ord`` that are digested as one string.
BLOCK = 5000


def fingerprint(files: DataFrame) -> DataFrame:
    """SHA-256 of path, whole-second time and size of every file in order of ``file_ord`` (from 1), joined without separators.

    Listings of more than BLOCK files are digested block by block: then it is the SHA-256 of the blocks' hex digests in order.
    """
    one = F.concat("path", F.col("mtime").cast("string"), F.col("size").cast("string")).alias("s")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("file_ord", one))), lambda x: x["s"]), "")
    block = F.floor((F.col("file_ord") - 1) / BLOCK).alias("block")
    blocks = files.groupBy(block).agg(F.sha2(joined, 256).alias("digest"), F.count("*").alias("n"))
    digests = F.transform(F.array_sort(F.collect_list(F.struct("block", "digest"))), lambda x: x["digest"])
    whole = F.when(F.size(digests) == 1, digests[0]).otherwise(F.sha2(F.array_join(digests, ""), 256))
    return blocks.agg(whole.alias("fingerprint"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_files"))


def listing_digest(files: DataFrame) -> DataFrame:
    """An order-free digest of any number of files: aggregated in parts, one row out."""
    h = F.xxhash64("path", "mtime", "size")
    return files.agg(F.count("*").alias("n_files"), F.bit_xor(h).alias("digest"), F.sum(F.pmod(h, F.lit(1 << 31))).alias("checksum"))


def changed_files(now: DataFrame, before: DataFrame) -> DataFrame:
    """``path, change``: files that are new, modified or gone since the last listing."""
    old = before.select("path", F.col("mtime").alias("_m"), F.col("size").alias("_s"))
    both = now.select("path", "mtime", "size").join(old, "path", "full_outer")
    kind = F.when(F.col("_m").isNull(), "new").when(F.col("mtime").isNull(), "gone").when((F.col("mtime") != F.col("_m")) | (F.col("size") != F.col("_s")), "modified")
    return both.withColumn("change", kind).filter("change IS NOT NULL").select("path", "change")
