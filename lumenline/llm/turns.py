"""Turns of conversations in order, without a conversation having to fit one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize


def numbered(rows: DataFrame, key: str, order: list[Column], name: str) -> DataFrame:
    """``rows`` with ``name``, a row's place within its key by ``order``, from 1. Keys must not be null.

    The rows are dealt by ranges of key and order, so a long key spans several tasks; each counts its own rows, and what
    a key has in earlier ranges is added afterwards: a row for each range that goes on with a key, so at most one a range.
    """
    ranged = rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order).withColumn("__range", F.spark_partition_id())
    at = ranged.columns.index(key)
    schema = T.StructType([*ranged.schema.fields, T.StructField(name, T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, before = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(at)
            begins = np.flatnonzero(np.r_[True, pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)])
            sizes = np.diff(np.r_[begins, len(keys)])
            places = np.arange(1, len(keys) + 1) - np.repeat(begins, sizes)
            if keys[0].as_py() == last:
                places[: sizes[0]] += before
            last, before = keys[-1].as_py(), int(places[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places, pa.int64())], schema.fieldNames())

    found = materialize(ranged.mapInArrow(count, schema), "turns")
    parts = found.groupBy(key, "__range").agg(F.max(name).alias("__n"))
    earlier = Window.partitionBy(key).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.withColumn("__before", F.sum("__n").over(earlier)).where("__before is not null").drop("__n")
    placed = found.join(F.broadcast(offsets), [key, "__range"], "left")
    return placed.withColumn(name, F.col(name) + F.coalesce("__before", F.lit(0))).drop("__range", "__before")


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], least: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted rows as tables of whole groups, of at least so many rows where there are more, with the groups' first rows."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        if held.num_rows >= least:
            held = held.combine_chunks()
            begins = group_starts(held, keys)
            cut = int(begins[-1])
            if cut:
                yield held.slice(0, cut), begins[:-1]
                held = held.slice(cut)
    if held is not None and held.num_rows:
        held = held.combine_chunks()
        yield held, group_starts(held, keys)


def group_starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    changes = np.zeros(table.num_rows, bool)
    changes[:1] = True
    for key in keys:
        column = table[key].combine_chunks()
        changes[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
    return np.flatnonzero(changes)
