"""Typed lines of many sessions as a stream of questions, with control words held as state.

``:reload`` raises a session's epoch, ``:exit`` closes it, blank lines are passed over: the rules of
:func:`corpusmill.streaming.ingest.question_lines`, but line by line as they come.  The state of a session
is three numbers.  It outlives restarts, with the checkpoint, and goes when the session has been
idle for a while.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from corpusmill.functions.text import EDGES
from corpusmill.runtime import ship

QUESTIONS = "session {kind}, query_id long, question string, reloads long"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class Sessions(StatefulProcessor):
    """``reloads``, ``last`` line number and ``closed`` of each session."""

    def __init__(self, idle_ms: int | None) -> None:
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("session", "reloads long, last long, closed boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        reloads, last, closed = tuple(self.state.get()) if self.state.exists() else (0, None, False)
        for row in sorted(rows, key=lambda r: r["line_no"]):  # one person's lines of one batch
            if last is not None and row["line_no"] <= last:
                continue  # a line that was delivered again
            last = row["line_no"]
            said = (row["line"] or "").strip(EDGES)
            if said == ":exit":
                closed = True
            elif said == ":reload":
                reloads += 0 if closed else 1
            elif said and not closed:
                yield Row(session=key[0], query_id=row["line_no"], question=said, reloads=reloads)
        self.state.update((reloads, last, closed))
        if self.idle_ms is not None:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.state.clear()
        return iter(())


def question_stream(lines: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """A stream ``session, line_no, line`` as ``session, query_id, question, reloads``.

    Batches come in order; within one, a session's lines are taken by ``line_no``, and a number that was seen is a
    repeat and passed over.  After ``idle_ms`` without a line a session is forgotten: its next line opens a new one
    (the timers keep a stream running, so this is for triggers that go on, not for ``availableNow``).
    Start it with :func:`started`.
    """
    ship(lines.sparkSession)
    kind = lines.schema["session"].dataType.simpleString()
    typed = lines.select("session", "line_no", "line").filter("line_no IS NOT NULL").groupBy("session")
    return typed.transformWithState(Sessions(idle_ms), QUESTIONS.format(kind=kind), "append", "None" if idle_ms is None else "ProcessingTime")


def started(writer, spark) -> StreamingQuery:
    """Starts a stream writer with the state store that such state needs; the session's own setting stays as it was."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        return writer.start()
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)
