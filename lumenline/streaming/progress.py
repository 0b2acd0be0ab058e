"""Progress of running streams: how much of each stage their lines report, never falling."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

PREFIX = "progress"


def observed(lines: DataFrame, share: Column, stages: Iterable[int], stage: str = "stage", name: str = PREFIX) -> DataFrame:
    """``lines`` as they are, with the largest share (0 to 1) of each stage and the number of lines as metrics of every batch."""
    own = [F.max(F.when((F.col(stage) == s) & share.isNotNull(), F.least(share, F.lit(1.0)))).alias(f"stage_{s}") for s in stages]
    return lines.observe(name, F.count("*").alias("lines"), *own)


class ProgressListener(StreamingQueryListener):
    """The running share of each stage, from the metrics of ``observed``: a report counts only where it exceeds all before.

    Tasks finish out of order and a restarted query reports a batch again, so reports may fall; ``percent`` never does.
    ``emit(stage, percent)`` is called for each rise, with percent rounded to one place; ``lines`` counts lines of batches once.
    """

    def __init__(self, emit: Callable[[int, float], None] = lambda stage, percent: None, name: str = PREFIX):
        self.emit, self.name = emit, name
        self.percent: dict[int, float] = {}
        self.lines = 0
        self.done: dict[str, str | None] = {}
        self._batches: dict[str, int] = {}
        self._lock = threading.Lock()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        row = p.observedMetrics.get(self.name)
        if row is None:
            return
        rises = []
        with self._lock:
            if p.batchId > self._batches.get(str(p.id), -1):
                self._batches[str(p.id)] = p.batchId
                self.lines += row["lines"]
            for field, share in row.asDict().items():
                if field.startswith("stage_") and share is not None:
                    stage, percent = int(field.removeprefix("stage_")), round(share * 100, 1)
                    if percent > self.percent.get(stage, -1.0):
                        self.percent[stage] = percent
                        rises.append((stage, percent))
        for rise in rises:
            self.emit(*rise)

    def onQueryTerminated(self, event) -> None:
        with self._lock:
            self.done[str(event.id)] = event.exception


def listen(spark: SparkSession, emit: Callable[[int, float], None] = lambda stage, percent: None, name: str = PREFIX) -> ProgressListener:
    """A listener that is attached to the session's streams; detach it with ``spark.streams.removeListener``."""
    listener = ProgressListener(emit, name)
    spark.streams.addListener(listener)
    return listener
