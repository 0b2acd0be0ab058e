"""Segments of a lecture without a usable deck, from the likeness of consecutive frames' texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runs import KEYS, absorb_backward, similarity_runs
from .tfidf import consecutive_similarity, segment_keywords, tfidf_weights


def frame_weights(events: DataFrame, min_df: int = 2, keys=KEYS) -> DataFrame:
    docs = events.select(*keys, F.col("event_index").alias("doc"), F.col("ocr_text").alias("text"))
    return tfidf_weights(docs, tuple(keys), min_df=min_df, sublinear=True)


def visual_members(events: DataFrame, weights: DataFrame, threshold: float = 0.35, min_seconds: float = 45.0, keys=KEYS) -> DataFrame:
    """Each event with its similarity to the one before and its ``segment_idx``; a lecture without terms is one segment."""
    frames = events.select(*keys, F.col("event_index").alias("doc"), "timestamp", "frame_image_path")
    rows = consecutive_similarity(weights, frames, tuple(keys))
    known = weights.select(*keys).distinct().withColumn("__terms", F.lit(True))
    rows = rows.join(known, list(keys), "left").withColumn("similarity", F.when(F.col("__terms"), F.col("similarity"))).drop("__terms")
    rows = similarity_runs(rows, threshold, order="doc", keys=keys)
    islands = rows.groupBy(*keys, "run_idx").agg(F.min("timestamp").alias("start"), F.max("timestamp").alias("last"))
    merged = absorb_backward(islands, min_seconds, keys=keys).select(*keys, "run_idx", F.col("merged_idx").alias("segment_idx"))
    return rows.join(merged, [*keys, "run_idx"])


def visual_timeline(events: DataFrame, durations: DataFrame | None = None, threshold: float = 0.35, min_seconds: float = 45.0, min_df: int = 2, keywords: int = 8, keys=KEYS) -> DataFrame:
    """(keys, slide_number, start, end, confidence, last_frame_image_path, segment_keywords); slide numbers count segments from 1."""
    weights = frame_weights(events, min_df, keys)
    members = visual_members(events, weights, threshold, min_seconds, keys)
    inner = members.withColumn("__first", F.min("doc").over(Window.partitionBy(*keys, "segment_idx")))
    segments = inner.groupBy(*keys, "segment_idx").agg(
        F.min("timestamp").alias("start"),
        F.max(F.struct("doc", "timestamp", "frame_image_path")).alias("last"),
        F.avg(F.when(F.col("doc") > F.col("__first"), F.col("similarity"))).alias("mean"),
    )
    terms = segment_keywords(weights, members.select(*keys, "doc", "segment_idx"), keywords, tuple(keys))
    listed = terms.groupBy(*keys, "segment_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "term"))), lambda x: x["term"]).alias("segment_keywords"))
    rows = segments.join(listed, [*keys, "segment_idx"], "left")
    if durations is not None:
        rows = rows.join(durations.select(*keys, "video_duration"), list(keys), "left")
    else:
        rows = rows.withColumn("video_duration", F.lit(None).cast("double"))
    next_start = F.lead("start").over(Window.partitionBy(*keys).orderBy("segment_idx"))
    return rows.select(
        *keys,
        (F.col("segment_idx") + 1).cast("int").alias("slide_number"),
        "start",
        F.coalesce(next_start, "video_duration", "last.timestamp").alias("end"),
        F.round(F.coalesce("mean", F.lit(0.0)), 4).alias("confidence"),
        F.col("last.frame_image_path").alias("last_frame_image_path"),
        F.coalesce("segment_keywords", F.array().cast("array<string>")).alias("segment_keywords"),
    )
