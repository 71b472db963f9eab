"""Change detection by digests up the folder tree.

A file's digest is of its name, time and size; a folder's is of the set of its entries' digests, summed so that folders
of any size combine in parts before a shuffle.  Listings with equal root digests are equal; else only the entries of
folders that differ are compared, level by level, so the work of a comparison follows the changed paths.
The value is of one kind for any number of files.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.runtime import materialize

#: 64-bit words of a folder's sum.
WORDS = 4
_SCHEMA = "path string, parent string, folder boolean, digest string"


def _parent(path: Column) -> Column:
    """The folder of a path; null at the top."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", ""))


def _name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def _sum() -> list[Column]:
    """The digest of a set of entries, as aggregates."""
    entry = F.concat_ws("\x00", _name(F.col("path")), F.col("folder").cast("string"), F.col("digest"))
    return [F.count("*").alias("n"), *[F.bit_xor(F.xxhash64(entry, F.lit(i))).alias(f"w{i}") for i in range(WORDS)]]


def _digest() -> Column:
    return F.sha2(F.concat_ws(",", "n", *[f"w{i}" for i in range(WORDS)]), 256)


@dataclass(frozen=True)
class MerkleTree:
    """``root``: the digest of a listing; ``levels[d]``: the entries ``path, parent, folder, digest`` at depth ``d``."""

    root: str
    levels: list[DataFrame]

    @staticmethod
    def build(files: DataFrame) -> MerkleTree:
        """Of ``path, mtime, size``; repeated rows count once.  One aggregation a level, of which there are as many as folders in the longest path."""
        one = F.sha2(F.concat_ws(",", F.col("mtime").cast("string"), F.col("size").cast("string")), 256)
        depth = F.size(F.split("path", "/")) - 1
        rows = materialize(files.select("path", "mtime", "size").distinct().select("path", _parent(F.col("path")).alias("parent"), F.lit(False).alias("folder"), one.alias("digest"), depth.alias("depth")), "merkle-files")
        deepest = rows.agg(F.max("depth")).first()[0]
        levels: list[DataFrame] = []
        folders = None
        for d in range(-1 if deepest is None else deepest, -1, -1):
            here = rows.filter(F.col("depth") == d).drop("depth")
            here = materialize(here if folders is None else here.unionByName(folders), f"merkle-{d}")
            levels.insert(0, here)
            path = F.col("parent")
            folders = here.filter("parent IS NOT NULL").groupBy("parent").agg(*_sum()).select(path.alias("path"), _parent(path).alias("parent"), F.lit(True).alias("folder"), _digest().alias("digest"))
        top = levels[0] if levels else rows.drop("depth")
        return MerkleTree(top.agg(*_sum()).select(_digest()).first()[0], levels)

    def save(self, path: str) -> None:
        """One Parquet table, by depth."""
        spark = SparkSession.getActiveSession()
        every = [level.withColumn("depth", F.lit(d)) for d, level in enumerate(self.levels)] or [spark.createDataFrame([], f"{_SCHEMA}, depth int")]
        reduce(DataFrame.unionByName, every).write.mode("overwrite").partitionBy("depth").parquet(f"{path}/entries")
        spark.createDataFrame([(self.root, len(self.levels))], "root string, levels int").coalesce(1).write.mode("overwrite").json(f"{path}/root")

    @staticmethod
    def load(spark: SparkSession, path: str) -> MerkleTree:
        top = spark.read.schema("root string, levels int").json(f"{path}/root").first()
        return MerkleTree(top["root"], [spark.read.schema(f"{_SCHEMA}, depth int").parquet(f"{path}/entries").filter(F.col("depth") == d).drop("depth") for d in range(top["levels"])])


def changed_files(now: MerkleTree, before: MerkleTree) -> DataFrame:
    """``path, change`` as :func:`fingerprint.changed_files` gives; entries of folders with equal digests are not compared."""
    spark = SparkSession.getActiveSession()
    none = spark.createDataFrame([], _SCHEMA)
    found, open_ = [none.select("path", F.lit("").alias("change"))], None
    for d in range(0 if now.root == before.root else max(len(now.levels), len(before.levels))):
        sides = [t.levels[d] if d < len(t.levels) else none for t in (now, before)]
        if open_ is not None:
            sides = [s.join(open_, s["parent"] == open_["_open"], "left_semi") for s in sides]
        a, b = sides[0].select("path", "folder", F.col("digest").alias("_now")), sides[1].select("path", "folder", F.col("digest").alias("_before"))
        differ = materialize(a.join(b, ["path", "folder"], "full_outer").filter(~F.col("_now").eqNullSafe(F.col("_before"))), f"merkle-differ-{d}")
        kind = F.when(F.col("_before").isNull(), "new").when(F.col("_now").isNull(), "gone").otherwise("modified")
        found.append(differ.filter("NOT folder").select("path", kind.alias("change")))
        open_ = differ.filter("folder").select(F.col("path").alias("_open"))
        if open_.isEmpty():
            break
    return reduce(DataFrame.unionByName, found)
