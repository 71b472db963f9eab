"""Subscribers that are told of each batch once, across failures and restarts.

For each subscriber the ledger, beside the stream's checkpoint, has the number of the last batch that it took.
When one fails, the others still get the batch and the stream then fails with it; after a restart Spark
gives the same batch again under the same number, and only those that have not taken it are told.
A process that dies between a subscriber's return and the entry tells it once more, with the same number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Ledger:
    """The last batch of each subscriber, as the name of an empty file that is created in one step."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self._at, self.folder = spark._jvm.org.apache.hadoop.fs.Path, folder.rstrip("/")
        self._fs = self._at(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _marks(self, name: str) -> list[int]:
        where = self._at(f"{self.folder}/{name}")
        return sorted(int(f.getPath().getName()) for f in self._fs.listStatus(where)) if self._fs.exists(where) else []

    def last(self, name: str) -> int:
        """-1 before the first batch."""
        return max(self._marks(name), default=-1)

    def enter(self, name: str, number: int) -> None:
        old = self._marks(name)
        self._fs.create(self._at(f"{self.folder}/{name}/{number}"), True).close()
        for n in old:
            if n != number:
                self._fs.delete(self._at(f"{self.folder}/{name}/{n}"), False)


class LedgerPublisher:
    """Like :class:`ingest.Publisher` for ``foreachBatch``, with named subscribers and a :class:`Ledger`."""

    def __init__(self, ledger: Ledger) -> None:
        self.ledger = ledger
        self._subscribers: dict[str, Callable[[DataFrame, int], None]] = {}

    def attach(self, name: str, subscriber: Callable[[DataFrame, int], None]) -> None:
        """The name stands for the subscriber across restarts; one that is new gets batches from now on."""
        if not name or "/" in name or name.startswith("."):
            raise ValueError(f"no name for a folder: {name!r}")
        if name in self._subscribers:
            raise ValueError(f"{name} is attached")
        self._subscribers[name] = subscriber

    def detach(self, name: str) -> None:
        del self._subscribers[name]

    def notify(self, batch: DataFrame, number: int) -> None:
        waiting = [n for n in self._subscribers if self.ledger.last(n) < number]
        if len(waiting) > 1:
            batch = batch.persist()  # each subscriber runs its own job over it
        failed: list[tuple[str, Exception]] = []
        try:
            for name in waiting:
                try:
                    self._subscribers[name](batch, number)
                except Exception as e:  # the others are told first
                    failed.append((name, e))
                else:
                    self.ledger.enter(name, number)
        finally:
            if len(waiting) > 1:
                batch.unpersist()
        if failed:
            raise RuntimeError(f"batch {number} failed for {', '.join(n for n, _ in failed)}") from failed[0][1]
