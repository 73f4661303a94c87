"""Stopping streams: when nothing comes any more, and between two batches."""

from __future__ import annotations

import threading
import time

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

EMPTY = 200


class Watch(StreamingQueryListener):
    """Counts a query's triggers without rows, one after another, and stops it at ``limit`` of them; ``reasons`` says which and why.

    The state is in the checkpoint, so a restart goes on where the query stopped.
    """

    def __init__(self, spark: SparkSession, limit: int = EMPTY):
        self.spark, self.limit = spark, limit
        self.empty: dict[str, int] = {}
        self.reasons: dict[str, str] = {}

    def onQueryStarted(self, event) -> None:
        self.empty[str(event.id)] = 0

    def onQueryProgress(self, event) -> None:
        self._count(str(event.progress.id), event.progress.numInputRows)

    def onQueryIdle(self, event) -> None:
        self._count(str(event.id), 0)

    def onQueryTerminated(self, event) -> None:
        self.empty.pop(str(event.id), None)

    def _count(self, query: str, rows: int) -> None:
        if query not in self.empty or query in self.reasons:
            return
        self.empty[query] = 0 if rows else self.empty[query] + 1
        if self.empty[query] >= self.limit:
            self.reasons[query] = f"no frames in {self.limit} triggers"
            threading.Thread(target=self._stop, args=(query,), daemon=True).start()  # not on the thread that reports

    def _stop(self, query: str) -> None:
        running = self.spark.streams.get(query)
        if running is not None:
            stopped(running)


def stopped(query: StreamingQuery, timeout_s: float = 60.0) -> bool:
    """Stops a query between two batches, or in the midst of one that takes longer than the timeout; True if between."""
    until = time.monotonic() + timeout_s
    while query.isActive and query.status["isTriggerActive"] and time.monotonic() < until:
        time.sleep(0.02)
    between = not query.isActive or not query.status["isTriggerActive"]
    query.stop()
    return between
