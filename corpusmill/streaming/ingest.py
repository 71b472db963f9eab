"""Incremental ingest and streamed questions.

A stream of files takes each new file once; a changed file is not taken again, so edits
are found by ``operators.fingerprint.changed_files`` over two listings.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusmill.functions import text as T
from corpusmill.operators import chunk
from corpusmill.sources.files import decode_b

BINARY = "path string, modificationTime timestamp, length bigint, content binary"


def stream_documents(spark: SparkSession, folder: str) -> DataFrame:
    """``source_path, mtime, text`` of files as they come."""
    rows = spark.readStream.format("binaryFile").schema(BINARY).option("recursiveFileLookup", "true").load(folder)
    return rows.select(F.regexp_replace("path", "^file:/+", "/").alias("source_path"), F.unix_seconds("modificationTime").alias("mtime"), decode_b(F.col("content")).alias("text"))


def append_chunks(docs: DataFrame, out: str, checkpoint: str, size: int = 1500, overlap: int = 150) -> StreamingQuery:
    """Chunks what is there and ends; the Parquet sink and the checkpoint make it exactly once."""
    made = chunk.chunk_b(docs.withColumnRenamed("source_path", "doc_path"), size, overlap)
    return made.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def question_lines(lines: DataFrame) -> DataFrame:
    """Typed lines (session, line_no, line) as questions: ``session, query_id, question, reloads``.

    Blank lines are passed over, ``:exit`` ends a session, and ``reloads`` counts the ``:reload`` lines before a question,
    so that each is asked of the index it was meant for.  A session is one ordered sequence, of one person's lines.
    """
    order = Window.partitionBy("session").orderBy("line_no")
    bare = T.strip(F.col("line"))
    said = lines.select("session", F.col("line_no").alias("query_id"), bare.alias("question"), F.max(bare == ":exit").over(order).alias("_over"), F.sum((bare == ":reload").cast("long")).over(order).alias("reloads"))
    return said.filter(~F.col("_over") & (F.col("question") != "") & (F.col("question") != ":reload")).drop("_over")


def answer_stream(questions: DataFrame, answer: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Answers micro-batches of ``query_id, question`` and hands each to ``sink`` with its number."""

    def each(batch: DataFrame, number: int) -> None:
        sink(answer(batch), number)

    return questions.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def to_console(replies: DataFrame) -> StreamingQuery:
    """Shows replies as they come."""
    return replies.writeStream.format("console").option("truncate", "false").trigger(availableNow=True).start()


class Publisher:
    """Notifies subscribers of each written batch; for ``foreachBatch`` sinks."""

    def __init__(self) -> None:
        self._subscribers: list[Callable[[DataFrame, int], None]] = []

    def attach(self, subscriber: Callable[[DataFrame, int], None]) -> None:
        self._subscribers.append(subscriber)

    def detach(self, subscriber: Callable[[DataFrame, int], None]) -> None:
        self._subscribers.remove(subscriber)

    def notify(self, batch: DataFrame, number: int) -> None:
        for subscriber in self._subscribers:
            subscriber(batch, number)
