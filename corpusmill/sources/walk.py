"""Walking a tree on the executors, a level of folders at a time.

Each round lists the folders that the one before has found, FOLDERS to a task, and writes what is in them to
the shared folder; the driver sees counts.  A folder with an excluded name is left out where it is found and
so is never opened.  It needs folders that every executor mounts.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.runtime import materialize, ship

#: Folders that one task lists, entries of a batch, and bytes of content after which a batch ends.
FOLDERS, ENTRIES, BYTES = 64, 10_000, 16 << 20
_SCHEMA = "root string, path string, folder boolean, mtime bigint, size bigint"


@dataclass(frozen=True)
class Walk:
    """The files found (root, path, mtime, size), and how many folders were opened in how many rounds."""

    files: DataFrame
    opened: int
    rounds: int


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else ((),) * 5, kinds)], ["root", "path", "folder", "mtime", "size"])


def _entries(excluded: frozenset[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for root, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    entries = os.scandir(path)
                except OSError:  # gone meanwhile, or not ours to read
                    continue
                with entries:
                    for entry in entries:
                        try:
                            if entry.is_dir():
                                if entry.name not in excluded and not entry.is_symlink():  # links to folders are not followed
                                    rows.append((root, entry.path, True, None, None))
                                continue
                            info = entry.stat()
                        except OSError:
                            continue
                        rows.append((root, entry.path, False, int(info.st_mtime), info.st_size))
                        if len(rows) >= ENTRIES:
                            yield _batch(rows)
                            rows = []
        yield _batch(rows)

    return run


def walk(spark: SparkSession, roots: Sequence[str], excluded: Sequence[str] = (), extensions: Sequence[str] | None = None, strict: bool = False) -> Walk:
    """All files below ``roots``, hidden ones too, except below folders with an ``excluded`` name; with ``extensions`` only those.

    Roots are opened whatever their names; missing ones are passed over.  A file below two roots is met twice.
    """
    ship(spark)
    start = [r if r == "/" else r.rstrip("/") for r in roots]
    frontier, found, opened = spark.createDataFrame([(r, r) for r in start], "root string, path string"), [], 0
    while n := frontier.count() if found else len(start):
        opened += n
        dealt = frontier.repartition(max(1, -(-n // FOLDERS)))
        level = materialize(dealt.mapInArrow(_entries(frozenset(excluded)), _SCHEMA), "walk")
        found.append(level)
        frontier = level.filter("folder").select("root", "path")
    if not found:
        return Walk(spark.createDataFrame([], "root string, path string, mtime bigint, size bigint"), 0, 0)
    files = reduce(DataFrame.unionByName, found).filter("NOT folder").drop("folder")
    if extensions is not None:
        files = files.filter(T.any_suffix(F.col("path"), extensions, strict))
    return Walk(files, opened, len(found))


def with_content(files: DataFrame) -> DataFrame:
    """Adds ``content``, read on the executors; files that are gone or cannot be read are left out."""
    ship(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, held, size = [], [], 0
            for i, path in enumerate(batch.column("path").to_pylist()):
                try:
                    with open(path, "rb") as f:
                        held.append(f.read())
                except OSError:
                    continue
                at.append(i)
                size += len(held[-1])
                if size >= BYTES:
                    yield _filled(batch, at, held)
                    at, held, size = [], [], 0
            yield _filled(batch, at, held)

    shown = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema)
    return files.mapInArrow(run, f"{shown}, content binary")


def _filled(batch: pa.RecordBatch, at: list[int], held: list[bytes]) -> pa.RecordBatch:
    rows = batch.take(pa.array(at, pa.int64()))
    return pa.RecordBatch.from_arrays([*rows.columns, pa.array(held, pa.binary())], [*batch.schema.names, "content"])


def write_tree(docs: DataFrame, folder: str, path_col: str = "path", text_col: str = "text") -> int:
    """Writes each row's text as the file ``folder/path``, in UTF-8, on the executors; returns the number of files."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                target = os.path.join(folder, path)
                os.makedirs(os.path.dirname(target), exist_ok=True)
                draft = f"{target}.{os.getpid()}~"
                with open(draft, "wb") as f:
                    f.write((text or "").encode())
                os.replace(draft, target)  # a task that runs again writes the same file
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    return docs.select(path_col, text_col).mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
