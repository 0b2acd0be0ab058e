"""Corrections of a timeline by hand."""

from __future__ import annotations

from bisect import bisect_right

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .runs import KEYS, island_id, ordered

ENTRY = "position long, start double, end double, slide_number int, confidence double"


class Entries:
    """A timeline's entries in order of time, which edits change one after the other.

    Entries that are removed point to their left, and a search follows and shortens these pointers, so that
    all edits together take time nearly linear in entries and edits.
    """

    def __init__(self, start: list, end: list, slide: list, sure: list):
        """``end``: null where an entry is open. Entries that overlap or are out of order are an error."""
        if any(b is None or b < (a if e is None else e) or a > b for a, e, b in zip(start, end, start[1:], strict=False)):
            raise ValueError("the entries of a timeline overlap or are out of order")
        self.first = list(start)
        self.start, self.end, self.slide, self.sure = start, end, slide, sure
        self.left = [None] * len(start)  # of removed entries: a place before, where to look on
        self.head = 0

    def at_or_before(self, i: int) -> int:
        """The last entry up to place i that is still there, or -1."""
        found = i
        while found >= 0 and self.left[found] is not None:
            found = self.left[found]
        while i > found:
            self.left[i], i = found, self.left[i]
        return found

    def edit(self, timestamp: float | None, slide: int | None) -> None:
        """Change or, without a slide, remove the entry that holds the time, if one does."""
        if timestamp is None or not self.first:
            return
        i = self.at_or_before(bisect_right(self.first, timestamp) - 1)
        i = self.head if i < 0 else i
        if i == len(self.first) or not self.start[i] <= timestamp or not (self.end[i] is None or timestamp < self.end[i]):
            return
        if slide is not None:
            self.slide[i], self.sure[i] = slide, 1.0
            return
        self.left[i] = i - 1
        before = self.at_or_before(i - 1)
        if before >= 0:
            self.end[before] = self.end[i]
            return
        while self.head < len(self.first) and self.left[self.head] is not None:
            self.head += 1
        if self.head < len(self.first):
            self.start[self.head] = self.start[i]

    def kept(self) -> list[int]:
        return [i for i, x in enumerate(self.left) if x is None]


def coalesce_neighbours(entries: DataFrame, order="position", keys=KEYS) -> DataFrame:
    """Neighbours of one slide whose times touch become one entry, with the larger confidence."""
    w = ordered(keys, order)
    apart = ~(F.col("slide_number").eqNullSafe(F.lag("slide_number").over(w)) & F.coalesce(F.lag("end").over(w) == F.col("start"), F.lit(False)))
    rows = island_id(entries, apart, order, keys, "entry")
    return rows.groupBy(*keys, "entry").agg(
        F.min_by("start", order).alias("start"), F.max_by("end", order).alias("end"), F.first("slide_number").alias("slide_number"), F.max("confidence").alias("confidence")
    )


def apply_corrections(timeline: DataFrame, corrections: DataFrame, keys=KEYS) -> DataFrame:
    """(keys, entry, start, end, slide_number, confidence) after ``corrections`` (position, timestamp, slide_number) in turn.

    An edit goes to the entry whose half-open interval holds its time, or to none. A number replaces the slide, with
    full confidence; null removes the entry, whose time goes to the one before, or from the first to the next. What an
    edit hits depends on those before it, so a lecture's entries and edits meet in one task; lectures run in parallel.
    """
    fields = [timeline.schema[k] for k in keys] + T._parse_datatype_string(ENTRY).fields
    entries = timeline.select(*keys, "run_idx", F.col("start").cast("double"), F.col("end").cast("double"), F.col("slide_number").cast("int"), F.col("confidence").cast("double"))
    edits = corrections.select(*keys, "position", F.col("timestamp").cast("double"), F.col("slide_number").cast("int"))

    def in_turn(table: pa.Table, *order: str) -> pa.Table:
        return table.take(pc.sort_indices(table, [(c, "ascending") for c in order], null_placement="at_start"))

    def change(own: pa.Table, wanted: pa.Table) -> pa.Table:
        own, wanted = in_turn(own, "run_idx", "start"), in_turn(wanted, "position", "timestamp", "slide_number")
        now = Entries(*(own[c].to_pylist() for c in ("start", "end", "slide_number", "confidence")))
        for timestamp, slide in zip(wanted["timestamp"].to_pylist(), wanted["slide_number"].to_pylist(), strict=True):
            now.edit(timestamp, slide)
        kept = now.kept()
        made = [pa.array([x[i] for i in kept], kind) for x, kind in ((now.start, pa.float64()), (now.end, pa.float64()), (now.slide, pa.int32()), (now.sure, pa.float64()))]
        return pa.Table.from_arrays([*(own[k].take(pa.array(kept, pa.int64())) for k in keys), pa.array(range(len(kept)), pa.int64()), *made], [f.name for f in fields])

    flat = entries.groupBy(*keys).cogroup(edits.groupBy(*keys)).applyInArrow(change, T.StructType(fields))
    return coalesce_neighbours(flat, keys=keys)
