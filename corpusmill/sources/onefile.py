"""One JSON object in one file, ``{"dim": ..., "chunks": [{...}, ...]}``, written and read by many tasks.

A reader that starts in the middle of such a file does not know whether it is inside a string.  So a first pass
tells of each block of bytes, for either case, how it ends and how many levels it opens; these few numbers,
put together in order, give every block its true beginning.  A second pass then cuts out the records
that begin in a block and parses them; the last one is read on beyond the block's end.

Writers know the size of every record before they write, so each task puts its records at their own offsets.

Both need a folder that every executor mounts.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.runtime import materialize, ship

#: Bytes that a task reads, and those that it reads on at a time.
BLOCK, MORE = 32 << 20, 1 << 16
#: What matters between records: escapes, quotes and brackets.
_MARKS = re.compile(rb'\\.|["{}\[\]]', re.DOTALL)
_OUT, _IN, _ESCAPED = 0, 1, 2


def _read(path: str, start: int, size: int) -> bytes:
    with open(path, "rb") as f:
        f.seek(start)
        return f.read(size)


def summary(data: bytes) -> list[tuple[int, int]]:
    """For a beginning outside a string, inside one, and after a backslash inside one: how the block ends, and the levels it opens."""
    out = []
    for state in (_OUT, _IN, _ESCAPED):
        inside, depth, end = state != _OUT, 0, 0
        at = 1 if state == _ESCAPED and data else 0
        for m in _MARKS.finditer(data, at):
            mark, end = m[0], m.end()
            if mark == b'"':
                inside = not inside
            elif not inside and len(mark) == 1:
                depth += 1 if mark in b"{[" else -1
        tail = data[max(at, end) :]
        open_ = state == _ESCAPED and not data or inside and tail.endswith(b"\\")
        out.append((_ESCAPED if open_ else _IN if inside else _OUT, depth))
    return out


def records(path: str, start: int, size: int, state: int, depth: int, level: int = 2) -> Iterator[bytes]:
    """The objects at ``level`` that begin in a block, whole; ``state`` and ``depth`` are those at its start."""
    data, at = _read(path, start, size), 1 if state == _ESCAPED else 0
    inside, begin, limit = state != _OUT, -1, size
    while True:
        for m in _MARKS.finditer(data, at):
            mark, at = m[0], m.end()
            if mark == b'"':
                inside = not inside
            elif not inside and len(mark) == 1:
                if mark in b"{[":
                    if mark == b"{" and depth == level and begin < 0:
                        if m.start() >= limit:
                            return
                        begin = m.start()
                    depth += 1
                else:
                    depth -= 1
                    if depth == level and begin >= 0:
                        yield data[begin:at]
                        begin = -1
        if begin < 0:  # what comes after the block begins in another
            return
        more = _read(path, start + len(data), MORE)
        if not more:
            raise ValueError(f"{path} ends within a record")
        while at < len(data) and data[at] != 0x5C:  # go on behind the last mark, before a lone backslash
            at += 1
        data += more


def read_object(spark: SparkSession, path: str, schema: str, block: int = BLOCK) -> DataFrame:
    """The records of the array in the file, as ``schema``; several tasks read one file."""
    ship(spark)
    size = os.path.getsize(path)
    n = max(1, -(-size // block))
    ranges = spark.range(n, numPartitions=n).select("id", (F.col("id") * block).alias("start"), F.lit(block).cast("long").alias("size"))

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, start, length in zip(*(c.to_pylist() for c in batch.columns)):
                (a, x), (b, y), (c, z) = summary(_read(path, start, length))
                yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in (i, a, x, b, y, c, z)], ["id", "a", "x", "b", "y", "c", "z"])

    found = {r["id"]: ((r["a"], r["x"]), (r["b"], r["y"]), (r["c"], r["z"])) for r in ranges.mapInArrow(told, "id long, a long, x long, b long, y long, c long, z long").collect()}  # a row a block
    state, depth, starts = _OUT, 0, []
    for i in range(n):
        starts.append((i, i * block, state, depth))
        state, opened = found[i][state]
        depth += opened
    if state != _OUT or depth != 0:
        raise ValueError(f"{path} is not one whole JSON object")
    begins = spark.createDataFrame(starts, "id long, start long, state long, depth long").repartitionByRange(n, "id")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, start, state, depth in zip(*(c.to_pylist() for c in batch.columns)):
                rows: list[str] = []
                for record in records(path, start, block, state, depth):
                    rows.append(record.decode())
                    if len(rows) == 1000:
                        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string())], ["value"])
                        rows = []
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string())], ["value"])

    return begins.mapInArrow(cut, "value string").select(F.from_json("value", schema).alias("_r")).select("_r.*")


def scalars(path: str, most: int = 1 << 20) -> dict:
    """The object's values before its array, which must begin within ``most`` bytes."""
    data = _read(path, 0, most)
    at = next((m.start() for m in re.finditer(rb'\\.|"(?:[^"\\]|\\.)*"|\[', data, re.DOTALL) if m[0] == b"["), -1)
    if at < 0:
        raise ValueError(f"no array at the beginning of {path}")
    return {k: v for k, v in json.loads(data[:at] + b"null}").items() if v is not None}


def write_object(rows: DataFrame, path: str, key: str = "chunks", order: str = "chunk_ord", **values: object) -> int:
    """Writes ``rows`` (without ``order``, by which they are sorted) as the array ``key`` of one object, after ``values``.  Returns its bytes.

    The file appears under its name when it is whole.
    """
    spark = rows.sparkSession
    ship(spark)
    record = F.to_json(F.struct(*[c for c in rows.columns if c != order]), {"ignoreNullFields": "false"})
    sorted_ = rows.select(order, record.alias("value")).repartitionByRange(order).sortWithinPartitions(order, "value")
    kept = materialize(sorted_.select("value", F.octet_length("value").cast("long").alias("size"), F.spark_partition_id().alias("task"), F.monotonically_increasing_id().alias("at")), "one-file")
    sums = kept.groupBy("task").agg(F.count("*").alias("n"), F.sum("size").alias("size")).orderBy("task").collect()  # a row a task
    head = (json.dumps({**values, key: 0})[:-2] + "[").encode()
    first, number, offset = {}, 0, len(head)
    for r in sums:
        first[r["task"]] = (offset, number)
        offset, number = offset + r["size"] + 2 * (r["n"] if number else r["n"] - 1), number + r["n"]
    draft, total = f"{path}.writing", offset + 2
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(draft, "wb") as f:
        f.write(head)
        f.truncate(total)
        f.seek(offset)
        f.write(b"]}")
    if first:
        starts = F.broadcast(spark.createDataFrame([(t, o, n) for t, (o, n) in first.items()], "task int, _offset long, _number long"))  # a row a task
        run = Window.partitionBy("task").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
        before = F.coalesce(F.sum(F.col("size") + 2).over(run), F.lit(0))
        placed = kept.withColumn("_before", before).join(starts, "task").withColumn("lead", (F.col("_before") > 0) | (F.col("_number") > 0))
        offset_ = F.col("_offset") + F.col("_before") - F.when((F.col("_number") == 0) & (F.col("_before") > 0), 2).otherwise(0)

        def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            with open(draft, "r+b") as f:
                for batch in batches:
                    for offset, lead, value in zip(*(c.to_pylist() for c in batch.columns)):
                        f.seek(offset)
                        f.write((b",\n" if lead else b"") + value.encode())
                    yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

        written = placed.select(offset_.alias("offset"), "lead", "value").mapInArrow(put, "n long").agg(F.sum("n")).first()[0]
        if written != number:
            raise ValueError(f"{written} records of {number} were written")
    os.replace(draft, path)
    return total
