"""Online change detection and matching: a typed value of state for each lecture, dropped when the lecture is over.

A lecture's rows must arrive in order between batches; within a batch they are sorted. The results are then those of the
batch operators, however the rows are split into batches. A lecture is over when a row says so (a true ``finished``), or when nothing has
come for ``idle`` by the rows' times of arrival: those carry the watermark and a timer, as media time has none. A row that
arrives later than that is dropped by the watermark, like any late row. The state needs the RocksDB store (session.SETTINGS has it).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.match import greedy_path

CHANGES = "lecture_id string, event_index long, timestamp double, value double"
MATCHES = (
    "lecture_id string, event_index long, place int, score double, jumped_backward boolean, stayed_over_raw_best boolean, "
    "in_order_best_place int, in_order_best_score double, backward_best_place int, backward_best_score double"
)


class PerLecture(StatefulProcessor):
    """``step(state, row)`` gives the next state and the rows that come of it; state is None at a lecture's beginning."""

    def __init__(self, state: str, order: str, step: Callable[[tuple | None, Row], tuple[tuple, list[Row]]], idle_ms: int | None = None):
        self.ddl, self.order, self.step, self.idle_ms = state, order, step, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("lecture", self.ddl)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        state = tuple(self.state.get()) if self.state.exists() else None
        finished, newest = False, 0
        for row in sorted(rows, key=lambda r: r[self.order]):
            state, made = self.step(state, row)
            yield from made
            finished = finished or bool(row["__finished"])
            newest = max(newest, row["__arrived"] or 0)
        self.forget()
        if not finished:
            self.state.update(state)
            if self.idle_ms is not None:
                self.handle.registerTimer(newest + self.idle_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.state.clear()
        return iter(())

    def forget(self) -> None:
        self.state.clear()
        if self.idle_ms is not None:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)

    def close(self) -> None:
        pass


def by_lecture(rows: DataFrame, columns: list[str], make: Callable[[int | None], PerLecture], schema: str, finished: str | None, arrived: str | None, idle_seconds: int) -> DataFrame:
    if arrived:
        rows = rows.withWatermark(arrived, "0 seconds")
    kept = rows.select(
        "lecture_id",
        *columns,
        (F.col(finished) if finished else F.lit(False)).alias("__finished"),
        (F.unix_millis(F.col(arrived).cast("timestamp")) if arrived else F.lit(None).cast("long")).alias("__arrived"),
        *([arrived] if arrived else []),
    )
    processor = make(idle_seconds * 1000 if arrived else None)
    schema = schema.replace("lecture_id string", f"lecture_id {rows.schema['lecture_id'].dataType.simpleString()}")
    return kept.groupBy("lecture_id").transformWithState(processor, schema, "Append", "EventTime" if arrived else "None")


def online_changes(samples: DataFrame, threshold: float, finished: str | None = None, arrived: str | None = None, idle_seconds: int = 3600) -> DataFrame:
    """Change events of a stream of samples (lecture_id, timestamp, value); the state is the last sample and the number of events."""

    def step(state: tuple | None, s: Row) -> tuple[tuple, list[Row]]:
        last, count = state or (None, 0)
        if last is not None and abs(s.value - last) <= threshold:
            return (s.value, count), []
        return (s.value, count + 1), [Row(lecture_id=s.lecture_id, event_index=count, timestamp=s.timestamp, value=s.value)]

    return by_lecture(samples, ["timestamp", "value"], lambda idle: PerLecture("last double, count long", "timestamp", step, idle), CHANGES, finished, arrived, idle_seconds)


def online_matches(
    scores: DataFrame, margin: float = 0.15, stay_margin: float = 0.05, min_forward: float = 0.05, finished: str | None = None, arrived: str | None = None, idle_seconds: int = 3600
) -> DataFrame:
    """Slides of a stream of events (lecture_id, event_index, scores) by the ordered rule; the state is the place shown last.

    The scores must come from an idf that is frozen; the batch matcher's idf covers all of a lecture's events.
    """
    names = MATCHES.replace(",", "").split(" ")[::2][2:]

    def step(state: tuple | None, e: Row) -> tuple[tuple, list[Row]]:
        decided = next(greedy_path(np.array([list(e.scores)], float), margin, stay_margin, min_forward, state[0] if state else 0))
        return (int(decided[0]),), [Row(lecture_id=e.lecture_id, event_index=e.event_index, **dict(zip(names, decided, strict=True)))]

    return by_lecture(scores, ["event_index", "scores"], lambda idle: PerLecture("at int", "event_index", step, idle), MATCHES, finished, arrived, idle_seconds)
