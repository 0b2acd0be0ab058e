"""Sharding by sampled splitters.

The key of a row is (hash of its text, hash of its doc_id), so equal texts are neighbours. A sample in
which a row's chance follows its size gives quantile boundaries; they cut the keys into many narrow
ranges, ranges that turn out overfull are sampled again and subdivided, and consecutive ranges make a
shard. A group of equal texts is cut only where it alone would fill more than two ranges. What reaches the driver
is the sample (its expected size is a parameter) and one row per range.

Null texts count as empty. Repeated rows are rows of their own. Null doc_ids are allowed. Columns other
than doc_id and text are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, read

LEAST = -(2**63)


def sampled_bounds(keys: DataFrame, weight: float, ranges: int, samples_per_range: int, seed: int, whole: float) -> list[tuple[int, int]]:
    """Quantile boundaries (h, g) from a sample of ``keys`` (h, g, w) in which a row's chance follows w; weight is the sum of w.

    A group of equal texts that weighs no more than ``whole`` is not cut.
    """
    step = weight / (ranges * samples_per_range)
    u = F.shiftrightunsigned(F.xxhash64("h", "g", F.lit(seed)), 11) / F.lit(float(2**53))
    rows = keys.where(u < F.col("w") / F.lit(step)).select("h", "g", F.greatest("w", F.lit(step)).alias("w")).toPandas()
    if rows.empty:
        return []
    rows = rows.sort_values(["h", "g"], kind="stable")
    h, g, w = rows["h"].to_numpy(), rows["g"].to_numpy(), rows["w"].to_numpy()
    upto = np.cumsum(w)
    at = np.unique(np.searchsorted(upto, upto[-1] * np.arange(1, ranges) / ranges))
    first, last = np.searchsorted(h, h[at], "left"), np.searchsorted(h, h[at], "right") - 1
    own = upto[last] - upto[first] + w[first]
    return [(int(h[i]), LEAST if fits else int(g[i])) for i, fits in zip(at, own <= whole * upto[-1] / weight, strict=True)]


def range_of(bounds: list[tuple[int, int]]):
    """A column function: how many of the bounds are not above (h, g)."""
    bh, bg = (np.array([b[i] for b in bounds], dtype=np.int64) for i in (0, 1))

    @F.pandas_udf("int")
    def place(h: pd.Series, g: pd.Series) -> pd.Series:
        h, g = h.to_numpy(), g.to_numpy()
        low, high = np.searchsorted(bh, h, "left"), np.searchsorted(bh, h, "right")
        out = low.copy()
        for i in np.unique(low[low < high]):  # boundaries within this group of equal texts
            own = (low == i) & (high > i)
            j = high[own][0]
            out[own] = i + np.searchsorted(bg[i:j], g[own], "right")
        return pd.Series(out.astype(np.int32))

    return place


def shard_documents(
    docs: DataFrame,
    n_shards: int = 8,
    ranges_per_shard: int = 128,
    rows_per_range: int = 1_000_000,
    samples_per_range: int = 24,
    rounds: int = 3,
) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of ``docs``; shards are near equal in bytes."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("h"),
        F.xxhash64("doc_id", F.lit(1)).alias("g"),
    )
    rows = materialize(rows, "shard-keys")
    count, total = rows.agg(F.count("*"), F.sum("size")).first()
    if not count:
        return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    # Half of a row's weight is its bytes, half is even: ranges are bounded in bytes and in rows.
    keys = rows.withColumn("w", F.col("size") / F.lit(total / count) + 1)
    weight = 2.0 * count
    ranges = min(max(n_shards * ranges_per_shard, count // rows_per_range), 65_536)
    goal = weight / ranges
    bounds = sorted(set(sampled_bounds(keys, weight, ranges, samples_per_range, 0, 2 * goal)))
    for again in range(1, rounds + 1):
        placed = keys.withColumn("range", range_of(bounds)("h", "g"))
        parts = placed.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), F.sum("w").alias("w")).toPandas()
        over = parts[(parts["w"] > 2.5 * goal) & (parts["n"] > 1)]
        if again == rounds or over.empty:
            break
        inside = placed.where(F.col("range").isin([int(r) for r in over["range"]]))
        more = sampled_bounds(inside, float(over["w"].sum()), int(np.ceil(over["w"].sum() / goal)) * 2, samples_per_range, again, 2 * goal)
        if set(more) <= set(bounds):
            break
        bounds = sorted({*bounds, *more})
    parts = parts.sort_values("range")
    before = parts["bytes"].cumsum() - parts["bytes"]
    parts["shard"] = np.minimum((before + parts["bytes"] / 2) * n_shards // total, n_shards - 1).astype("int32")
    parts["base"] = parts.groupby("shard")["n"].cumsum() - parts["n"]
    # One row per range: at most 65,536 ranges and what their subdivision adds.
    table = F.broadcast(spark.createDataFrame(parts[["range", "shard", "base"]], "range int, shard int, base long"))
    within = F.row_number().over(Window.partitionBy("range").orderBy("h", "g", "doc_id"))
    return (
        placed.withColumn("rank", within)
        .join(table, "range")
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("rank") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )


def op1_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(read(spark, sf_dir, "documents"))
