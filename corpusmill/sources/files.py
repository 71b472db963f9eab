"""File trees: listings, filters in both engines' ways, and decoding.

``binaryFile`` passes over names that begin with ``_`` or ``.``; ``tree_listing`` walks
the roots instead and is a DataFrame of paths, so that reading is distributed.
"""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from corpusmill.functions import text as T
from corpusmill.operators.compile import walk_key
from corpusmill.runtime import ship
from corpusmill.settings import SettingsB


class _Files(InputPartition):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths


class _TreeReader(DataSourceReader):
    def __init__(self, roots: list[str], content: bool) -> None:
        self.roots, self.content = roots, content

    def partitions(self) -> list[InputPartition]:
        paths = [os.path.join(base, name) for root in self.roots if os.path.isdir(root) for base, _, names in os.walk(root) for name in names]
        return [_Files(paths[i : i + 256]) for i in range(0, len(paths), 256)] or [_Files([])]

    def read(self, part: InputPartition):
        for path in part.paths:
            try:
                info = os.stat(path)
                data = open(path, "rb").read() if self.content else None
            except OSError:
                continue
            yield path, int(info.st_mtime), info.st_size, data


class TreeDataSource(DataSource):
    """``spark.read.format("tree").option("roots", "a,b").load()``: every file, hidden ones too."""

    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return "path string, mtime bigint, size bigint, content binary"

    def reader(self, schema) -> DataSourceReader:
        roots = [r for r in self.options.get("roots", "").split(",") if r]
        return _TreeReader(roots, self.options.get("content", "true").lower() == "true")


def read_tree(spark: SparkSession, roots: Sequence[str], hidden: bool = True, content: bool = True) -> DataFrame:
    """``path, mtime, size, content`` of all files below the roots; missing roots are passed over.

    ``hidden`` needs folders that every executor mounts.  Without it ``binaryFile`` reads any store.
    """
    if hidden:
        ship(spark)
        spark.dataSource.register(TreeDataSource)
        return spark.read.format("tree").option("roots", ",".join(roots)).option("content", str(content).lower()).load()
    there = [r for r in roots if "://" in r or os.path.isdir(r)]
    if not there:
        return spark.createDataFrame([], TreeDataSource({}).schema())
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(there)
    path = F.regexp_replace("path", "^file:/+", "/")
    return rows.select(path.alias("path"), F.unix_seconds("modificationTime").alias("mtime"), F.col("length").alias("size"), F.col("content") if content else F.lit(None).cast("binary").alias("content"))


def crawl_filter(path: Column, extensions: Sequence[str], ignored: Sequence[str]) -> Column:
    """Engine A: the last suffix is listed and no part of the whole path, the name included, is ignored."""
    parts = F.split(path, "/")
    return T.any_suffix(path, extensions, strict=True) & ~F.arrays_overlap(parts, F.array(*[F.lit(x) for x in ignored]))


def scan_filter(rel: Column, extensions: Sequence[str], excluded: Sequence[str], strict: bool = False) -> Column:
    """Engine B: no directory below the root is excluded, and the suffix is listed."""
    parts = F.split(rel, "/")
    dirs = F.slice(parts, F.lit(1), F.size(parts) - 1)
    return T.any_suffix(rel, extensions, strict) & ~F.arrays_overlap(dirs, F.array(*[F.lit(x) for x in excluded]))


def scan(files: DataFrame, extensions: Sequence[str], excluded: Sequence[str], max_files: int, rel_col: str = "path", strict: bool = False) -> DataFrame:
    """The first ``max_files`` matches in walk order, with ``file_ord`` from 1; a top-k, then a small sort."""
    return _first(files.filter(scan_filter(F.col(rel_col), extensions, excluded, strict)).withColumn("_key", walk_key(F.col(rel_col))), max_files)


def _first(keyed: DataFrame, max_files: int) -> DataFrame:
    return keyed.orderBy("_key").limit(max_files).withColumn("file_ord", F.row_number().over(Window.orderBy("_key"))).drop("_key")


def scan_roots(files: DataFrame, settings: SettingsB, root: str, path_col: str = "path") -> DataFrame:
    """Engine B's scan below ``root``, or below its ``include_roots`` one after the other (relative ones start at ``root``).

    Adds ``rel`` (the path below its base) and ``file_ord``.  A file below two bases is met twice, as in a walk.
    """
    bases = [b if b.startswith("/") or "://" in b else f"{root.rstrip('/')}/{b}" for b in settings.include_roots] or [root]
    every = F.array(*[F.struct(F.lit(i).alias("n"), F.lit(b.rstrip("/") + "/").alias("base")) for i, b in enumerate(bases)])
    met = files.withColumn("_b", F.explode(F.filter(every, lambda b: F.startswith(F.col(path_col), b["base"]))))
    met = met.withColumn("rel", F.substr(path_col, F.length("_b.base") + 1)).filter(scan_filter(F.col("rel"), settings.extensions, settings.excluded, settings.strict_suffix))
    return _first(met.withColumn("_key", F.struct("_b.n", walk_key(F.col("rel")))).drop("_b"), settings.max_files)


def decode_a(content: Column) -> Column:
    """UTF-8, broken bytes as U+FFFD."""
    return F.make_valid_utf8(content.cast("string"))


def decode_b(content: Column) -> Column:
    """UTF-8, broken bytes dropped (so are U+FFFD that the file holds)."""
    return F.replace(F.make_valid_utf8(content.cast("string")), F.lit("\ufffd"), F.lit(""))


def cap_chars(text: Column, limit: int = 250_000) -> Column:
    return F.substring(text, 1, limit)


def load_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Documents that are not blank."""
    return docs.filter(~T.is_blank(F.col(text_col)))
