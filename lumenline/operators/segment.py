"""Transcripts against timelines: canonical slides, interval joins, consolidation and attached examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import cue_hits, fold, norm, strip
from .runs import KEYS

OPEN = "double('Infinity')"


def canonical_slides(slides: DataFrame, order: str = "position", keys=KEYS) -> DataFrame:
    """(keys, slide_number, canonical): of slides with the same text the first; a number given twice follows its last row."""
    same = F.md5(F.concat(norm("title"), F.lit("|"), norm("body_text")))
    rows = slides.select(*keys, "slide_number", order, same.alias("__same"))
    first = rows.groupBy(*keys, "__same").agg(F.min_by("slide_number", order).alias("canonical"))
    rows = rows.join(first, [*keys, "__same"])
    return rows.groupBy(*keys, "slide_number").agg(F.max_by("canonical", order).alias("canonical"))


def with_canonical(rows: DataFrame, canonical: DataFrame, keys=KEYS) -> DataFrame:
    """``rows`` with each slide number replaced by its canonical one, if there is one."""
    joined = rows.join(canonical, [*keys, "slide_number"], "left")
    return joined.withColumn("slide_number", F.coalesce("canonical", "slide_number")).drop("canonical")


def slide_text(title="title", body="body_text") -> Column:
    parts = F.array(F.coalesce(F.col(title), F.lit("")), F.coalesce(F.col(body), F.lit("")))
    return F.array_join(F.filter(parts, lambda x: x != ""), "\n")


def reference_text(title="title", body="body_text") -> Column:
    """What is compared with frames; a slide's notes are no part of it."""
    return strip(F.concat(F.coalesce(F.col(title), F.lit("")), F.lit("\n"), F.coalesce(F.col(body), F.lit(""))))


def overlapping(left: DataFrame, right: DataFrame, left_ids, right_ids, keys=KEYS, closed: bool = False) -> DataFrame:
    """(keys, left_ids, right_ids) of the intervals (start, end) of one lecture that overlap; touching ones if ``closed``.

    Of two that do, one begins within the other. Both sides' starts and ends are swept once, in order, counting the starts
    of either side: an interval is then overlapped by those of the other side that start within it, which are numbered in
    a row, from one count to another. Every row that is made of such a stretch is a result, so this takes time in
    proportion to inputs and results, however intervals nest. Nulls, and intervals that end before they start, overlap nothing.
    """
    ids = {0: list(left_ids), 1: list(right_ids)}

    def points(df: DataFrame, side: int) -> DataFrame:
        rows = df.where("start <= end").select(*keys, F.struct(*ids[side]).alias("id"), "start", "end")
        stated = F.array(F.struct(F.col("start").cast("double").alias("at"), F.lit(1 + side).alias("turn")), F.struct(F.col("end").cast("double").alias("at"), F.lit(3 if closed else 0).alias("turn")))
        return rows.select(*keys, "id", F.explode(stated).alias("p")).select(*keys, "id", "p.at", "p.turn")

    none = lambda side, name: F.lit(None).cast((right if side else left).select(F.struct(*ids[side]).alias("x")).schema["x"].dataType).alias(name)
    both = points(left, 0).select(*keys, F.col("id").alias("l"), none(1, "r"), "at", "turn").unionByName(points(right, 1).select(*keys, none(0, "l"), F.col("id").alias("r"), "at", "turn"))
    w = Window.partitionBy(*keys).orderBy("at", "turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    begins = F.col("turn").isin(1, 2)
    swept = both.withColumns({"n_left": F.sum((F.col("turn") == 1).cast("long")).over(w), "n_right": F.sum((F.col("turn") == 2).cast("long")).over(w)})

    # Each interval with its place among its side's starts, and the stretch of the other side's that start within it.
    on_left = F.col("l").isNotNull()
    own, other = F.when(on_left, F.col("n_left")).otherwise(F.col("n_right")), F.when(on_left, F.col("n_right")).otherwise(F.col("n_left"))
    each = swept.withColumns({"own": own, "other": other}).groupBy(*keys, "l", "r").agg(
        F.max(F.when(begins, F.col("own"))).alias("place"), F.max(F.when(begins, F.col("other"))).alias("low"), F.max(F.when(~begins, F.col("other"))).alias("high")
    )
    # An interval stands at its own place, and looks at those of its stretch: one exchange by lecture serves the whole sweep.
    stands = F.array(F.struct(F.col("l").isNull().alias("side"), F.col("place").alias("at"), F.lit(0).alias("looks")))
    looks = F.transform(F.when(F.col("high") > F.col("low"), F.sequence(F.col("low") + 1, F.col("high"))).otherwise(F.array().cast("array<bigint>")), lambda at: F.struct(F.col("l").isNotNull().alias("side"), at.alias("at"), F.lit(1).alias("looks")))
    seen = each.select(*keys, "l", "r", F.explode(F.concat(stands, looks)).alias("p")).select(*keys, "l", "r", "p.*")
    there = Window.partitionBy(*keys, "side", "at").orderBy("looks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = seen.withColumns({"at_l": F.first("l").over(there), "at_r": F.first("r").over(there)}).where("looks = 1")
    found = found.select(*keys, F.coalesce("l", "at_l").alias("l"), F.coalesce("r", "at_r").alias("r"))
    return found.select(*keys, *(F.col(f"l.{c}").alias(c) for c in ids[0]), *(F.col(f"r.{c}").alias(c) for c in ids[1]))


def assign_to_runs(segments: DataFrame, runs: DataFrame, keys=KEYS) -> DataFrame:
    """Each segment (seg_index, start, end, text) with the run it overlaps most, ties to the earlier; others drop out.

    The overlaps come from one sweep over starts and ends; texts are joined last.
    """
    s = segments.select(*keys, "seg_index", "start", "end")
    r = runs.select(*keys, "run_idx", "start", F.coalesce("end", F.expr(OPEN)).alias("end"))
    pairs = overlapping(s, r, ["seg_index"], ["run_idx"], keys)
    pairs = pairs.join(s.withColumnsRenamed({"start": "seg_start", "end": "seg_end"}), [*keys, "seg_index"]).join(r.withColumnsRenamed({"start": "run_start", "end": "run_end"}), [*keys, "run_idx"])
    pairs = pairs.withColumn("overlap", F.least("seg_end", "run_end") - F.greatest("seg_start", "run_start")).where("overlap > 0")
    best = pairs.groupBy(*keys, "seg_index").agg(F.min(F.struct((-F.col("overlap")).alias("less"), "run_idx")).alias("best"))
    own = segments.select(*keys, "seg_index", F.col("start").alias("seg_start"), F.col("end").alias("seg_end"), "text")
    return own.join(best, [*keys, "seg_index"]).select(*own.columns, "best.run_idx", (-F.col("best.less")).alias("overlap"))


def bucketed_overlap(left: DataFrame, right: DataFrame, seconds: float, keys=KEYS) -> DataFrame:
    """Pairs of overlapping intervals (l_start, l_end) and (r_start, r_end) of one lecture, joined by time bucket.

    A pair is taken in the bucket in which its overlap begins, so it appears once. Ends must be finite.
    """
    cut = lambda df, s, e: df.withColumn("__bucket", F.explode(F.sequence(F.floor(F.col(s) / seconds), F.floor(F.col(e) / seconds))))
    pairs = cut(left, "l_start", "l_end").join(cut(right, "r_start", "r_end"), [*keys, "__bucket"])
    begins = F.floor(F.greatest("l_start", "r_start") / seconds)
    return pairs.where((F.col("l_start") < F.col("r_end")) & (F.col("r_start") < F.col("l_end")) & (begins == F.col("__bucket"))).drop("__bucket")


def context_around(anchors: DataFrame, segments: DataFrame, before: float = 20.0, after: float = 40.0, keys=KEYS, ids=("anchor_id",)) -> DataFrame:
    """Each anchor (timestamp) with ``transcript_context``: the texts of the segments that touch its window, in order."""
    windows = anchors.select(*keys, *ids, (F.col("timestamp") - before).alias("start"), (F.col("timestamp") + after).alias("end"))
    pairs = overlapping(windows, segments.select(*keys, "seg_index", "start", "end"), ids, ["seg_index"], keys, closed=True)
    said = pairs.join(segments.select(*keys, "seg_index", F.col("text").alias("__text")), [*keys, "seg_index"])
    texts = said.groupBy(*keys, *ids).agg(F.array_sort(F.collect_list(F.struct("seg_index", "__text"))).alias("__texts"))
    text = strip(F.array_join(F.transform("__texts", lambda x: F.coalesce(x["__text"], F.lit(""))), " "))
    return anchors.join(texts, [*keys, *ids], "left").withColumn("transcript_context", F.coalesce(text, F.lit(""))).drop("__texts")


def consolidate(runs: DataFrame, keys=KEYS) -> DataFrame:
    """Surviving runs (with texts and merged_from) of a slide as one row, slides in the order in which they were first seen.

    Texts join with a blank line; runs without text add none. The frame is the last run's that has one.
    """
    own = F.struct("run_idx", "start", "end", "run_text", "merged_from", "last_frame_image_path")
    rows = runs.groupBy(*keys, "slide_number").agg(F.min("run_idx").alias("first_run"), F.array_sort(F.collect_list(own)).alias("runs"))
    texts = F.filter(F.transform("runs", lambda r: r["run_text"]), lambda t: t.isNotNull() & (t != ""))
    frames = F.filter(F.transform("runs", lambda r: r["last_frame_image_path"]), lambda f: f.isNotNull() & (f != ""))
    return rows.select(
        *keys,
        "slide_number",
        "first_run",
        F.get("runs", F.lit(0))["start"].alias("start"),
        F.element_at("runs", -1)["end"].alias("end"),
        F.transform("runs", lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"))).alias("windows"),
        F.array_join(texts, "\n\n").alias("transcript_text"),
        F.flatten(F.transform("runs", lambda r: r["merged_from"])).alias("merged_from"),
        F.get(frames, F.size(frames) - 1).alias("frame_image_path"),
    )


def run_texts(assigned: DataFrame, runs: DataFrame, keys=KEYS) -> DataFrame:
    """Surviving runs with ``run_text``: their own and their absorbed runs' segments, a line each."""
    by_target = assigned.join(runs.select(*keys, "run_idx", "target"), [*keys, "run_idx"])
    texts = by_target.groupBy(*keys, F.col("target").alias("run_idx")).agg(F.array_sort(F.collect_list(F.struct("run_idx", "seg_index", "text"))).alias("__texts"))
    alive = runs.where("target = run_idx").join(texts, [*keys, "run_idx"], "left")
    return alive.withColumn("run_text", F.coalesce(F.array_join(F.transform("__texts", lambda x: x["text"]), "\n"), F.lit(""))).drop("__texts")


def with_slide_data(segments: DataFrame, slides: DataFrame, keys=KEYS) -> DataFrame:
    """Segments with slide_text and notes_text; empty where the deck lacks the slide."""
    own = slides.select(*keys, "slide_number", slide_text().alias("slide_text"), "notes_text")
    return segments.join(own, [*keys, "slide_number"], "left").withColumns({c: F.coalesce(c, F.lit("")) for c in ("slide_text", "notes_text")})


def nearest(points: DataFrame, others: DataFrame, ids, value: str, keys=KEYS) -> DataFrame:
    """(keys, ids, value) of the others (at, value) whose time is nearest to each point (timestamp); ties to the lowest value.

    Points and others are put in one order; the nearest is the last before or the first after, so each point meets two others.
    """
    each = others.where("at is not null").groupBy(*keys, "at").agg(F.min(value).alias(value))
    both = points.select(*keys, *ids, F.col("timestamp").alias("at"), F.lit(1).alias("turn")).unionByName(each.withColumn("turn", F.lit(0)), allowMissingColumns=True)
    other = F.when(F.col("turn") == 0, F.struct("at", value))
    up = Window.partitionBy(*keys).orderBy("at", "turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    down = Window.partitionBy(*keys).orderBy(F.desc("at"), F.desc("turn")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = both.withColumn("before", F.last(other, ignorenulls=True).over(up)).withColumn("after", F.last(other, ignorenulls=True).over(down))
    apart = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col(c)["at"] - F.col("at")).alias("apart"), F.col(c)[value].alias(value)))
    best = F.array_min(F.filter(F.array(apart("before"), apart("after")), lambda x: x.isNotNull()))
    return both.where("turn = 1").select(*keys, *ids, best[value].alias(value))


def cascade_attach(candidates: DataFrame, segments: DataFrame, keys=KEYS, ids=("event_index",)) -> DataFrame:
    """Each candidate with ``segment_idx``: the segment of its slide, else the first whose window holds its time, else the nearest.

    ``segments`` are (segment_idx, slide_number, windows). The rungs are an equality join, a sweep over the windows and an
    as-of join; nearness counts from a segment's first window.
    """
    equal = segments.groupBy(*keys, "slide_number").agg(F.min("segment_idx").alias("__equal"))
    first = candidates.join(equal, [*keys, "slide_number"], "left")
    left = first.where("__equal is null").select(*keys, *ids, "timestamp")  # only these go on to the next rung
    at = left.select(*keys, *ids, F.col("timestamp").alias("start"), F.col("timestamp").alias("end"))
    windows = segments.select(*keys, "segment_idx", F.posexplode("windows").alias("__n", "__w"))
    windows = windows.select(*keys, "segment_idx", "__n", "__w.start", F.coalesce("__w.end", F.expr(OPEN)).alias("end"))
    inside = overlapping(at, windows, ids, ["segment_idx", "__n"], keys, closed=True).groupBy(*keys, *ids).agg(F.min("segment_idx").alias("__inside"))
    near = nearest(left, segments.select(*keys, "segment_idx", F.get("windows", F.lit(0))["start"].alias("at")), ids, "segment_idx", keys).withColumnRenamed("segment_idx", "__near")
    later = near.join(inside, [*keys, *ids], "left")
    rung = F.when(F.col("__equal").isNotNull(), "slide").when(F.col("__inside").isNotNull(), "window").when(F.col("__near").isNotNull(), "nearest")
    joined = first.join(later, [*keys, *ids], "left")
    return joined.withColumn("segment_idx", F.coalesce("__equal", "__inside", "__near")).withColumn("rung", rung).select(*candidates.columns, "segment_idx", "rung")


def attach_examples(segments: DataFrame, candidates: DataFrame, transcript: DataFrame, keys=KEYS) -> DataFrame:
    """Segments with ``example_candidates``, each with its context and the cues heard in it; an empty array where there are none."""
    placed = cascade_attach(context_around(candidates, transcript, keys=keys, ids=("event_index",)), segments, keys)
    placed = placed.withColumn("cue_hits", cue_hits(fold("transcript_context")))
    fields = ["event_index", "timestamp", "frame_image_path", F.col("slide_number").alias("slide_number"), "kind", "score", "ink_delta", "ocr_excerpt", "transcript_context", "cue_hits"]
    found = placed.groupBy(*keys, "segment_idx").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("example_candidates"))
    none = F.array().cast(found.schema["example_candidates"].dataType)
    return segments.join(found, [*keys, "segment_idx"], "left").withColumn("example_candidates", F.coalesce("example_candidates", none))
