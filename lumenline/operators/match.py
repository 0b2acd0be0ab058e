"""Frames to slides: the ordered matcher, what needs review, and worked-example candidates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import EXAMPLE_SLIDE, fold, hamming, novel_ratio, overlap_ratio
from .runs import KEYS, collapse_runs, first_in_run, last_of_kind, value_runs


DECISION = "at int, score double, jumped boolean, stayed boolean, forward_at int, forward_score double, back_at int, back_score double"


def greedy_path(scores: np.ndarray, margin: float, stay_margin: float, min_forward: float, cur: int = 0) -> Iterator[tuple]:
    """A decision (as DECISION) for each row of scores, a row for each event and a column for each slide.

    Places count from 0. The state is the place of the slide just shown, ``cur`` at first; a decision looks ahead from it, stays
    where the gain is small, and goes back only for a clearly better earlier slide. Ties go to the lower place.
    """
    for own in scores:
        raw, now = cur + int(own[cur:].argmax()), own[cur]
        stayed = raw != cur and bool(own[raw] <= now + stay_margin or own[raw] < min_forward)
        forward = cur if stayed else raw
        back = int(own[:cur].argmax()) if cur else None
        jumped = back is not None and bool(own[back] > own[forward] + margin)
        decided = back if jumped else forward
        yield decided, float(own[decided]), jumped, stayed, forward, float(own[forward]), back, None if back is None else float(own[back])
        cur = decided


def match_events(cells: DataFrame, margin: float = 0.15, stay_margin: float = 0.05, min_forward: float = 0.05, keys=KEYS) -> DataFrame:
    """(keys, event_index, slide_number, score, …) from similarities of every event with every slide of a lecture.

    Each decision depends on the one before, so a lecture's events go through one task in turn, in time that is
    linear in them; lectures run in parallel. Decisions use the scores as they are, results are rounded to four places.
    """
    cells = cells.withColumn("similarity", F.col("similarity").cast("double"))
    events = cells.groupBy(*keys, "event_index").agg(F.array_sort(F.collect_list(F.struct("slide_number", "similarity"))).alias("__own"))
    events = events.select(*keys, "event_index", F.col("__own.slide_number").alias("__slides"), F.col("__own.similarity").alias("__scores"))
    parts = [part.split(" ") for part in DECISION.split(", ")]
    schema = T.StructType([*(f for f in events.schema.fields if f.name != "__scores"), *(T.StructField(f"__{n}", T._parse_datatype_string(k)) for n, k in parts)])

    def decide(table: pa.Table) -> pa.Table:
        table = table.sort_by("event_index")
        scores = np.array(table["__scores"].to_pylist(), float)
        columns = list(zip(*greedy_path(scores, margin, stay_margin, min_forward), strict=True))
        kinds = {"int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}
        made = [pa.array(c, kinds[k]) for c, (_, k) in zip(columns, parts, strict=True)]
        kept = table.drop_columns(["__scores"])
        return pa.Table.from_arrays([*kept.columns, *made], [*kept.column_names, *(f"__{n}" for n, _ in parts)])

    rows = events.groupBy(*keys).applyInArrow(decide, schema)
    slide = lambda c: F.get("__slides", F.col(f"__{c}"))
    score = lambda c: F.round(F.col(f"__{c}"), 4)
    return rows.select(
        *keys,
        "event_index",
        slide("at").alias("slide_number"),
        score("score").alias("score"),
        F.col("__jumped").alias("jumped_backward"),
        F.col("__stayed").alias("stayed_over_raw_best"),
        slide("forward_at").alias("in_order_best_slide_number"),
        score("forward_score").alias("in_order_best_score"),
        slide("back_at").alias("backward_best_slide_number"),
        score("back_score").alias("backward_best_score"),
    )


def low_confidence(matches: DataFrame, threshold: float = 0.25) -> DataFrame:
    return matches.where(F.col("score") < threshold)


def backward_jumps(matches: DataFrame) -> DataFrame:
    return matches.where("jumped_backward")


def unmatched(slides: DataFrame, timeline: DataFrame, keys=KEYS) -> DataFrame:
    """Slides that never appear on the timeline."""
    return slides.join(timeline.select(*keys, "slide_number").distinct(), [*keys, "slide_number"], "left_anti")


def confidence_by_lecture(matches: DataFrame, threshold: float = 0.25, fall_back: float = 0.60, keys=KEYS) -> DataFrame:
    """(keys, n_matches, n_low, ratio, fall_back): whether enough matches are weak to segment by sight instead."""
    low = F.sum((F.col("score") < threshold).cast("long"))
    rows = matches.groupBy(*keys).agg(F.count("*").alias("n_matches"), low.alias("n_low"))
    ratio = F.col("n_low") / F.col("n_matches")
    return rows.withColumn("ratio", ratio).withColumn("fall_back", F.lit(fall_back > 0) & (F.col("ratio") >= fall_back))


def classify_examples(matches: DataFrame, slides: DataFrame, score_max: float = 0.12, ink_min: int = 12, overlap_min: float = 0.5, novel_min: float = 0.35, excerpt_chars: int = 150, keys=KEYS) -> DataFrame:
    """Candidates (with kind and ink_delta) among matches that carry ``hash`` and ``ocr_excerpt``; the first rule that holds decides.

    A poor match is a whiteboard; much new ink over a slide that still shows, with words the deck lacks, is an
    annotated slide; a slide that says so is an example. Of neighbours of one kind in a run the last stays.
    """
    deck = slides.select(*keys, "slide_number", "reference_text")
    rows = first_in_run(value_runs(matches, keys=keys), {"hash": "__first_hash", "ocr_excerpt": "__first_ocr"}, keys=keys)
    rows = rows.join(deck, [*keys, "slide_number"], "left").withColumn("ink_delta", hamming("hash", "__first_hash"))
    rows = rows.withColumns({"__first": fold("__first_ocr"), "__own": fold("ocr_excerpt"), "__deck": fold("reference_text")})
    shows = overlap_ratio("__first", "__own") >= overlap_min
    adds = novel_ratio("__deck", "__own", excerpt_chars) >= novel_min
    kind = (
        F.when(F.col("score") < score_max, "whiteboard")
        .when(F.coalesce(F.col("ink_delta") >= ink_min, F.lit(False)) & shows & adds, "annotated_slide")
        .when(F.regexp_like(F.coalesce("reference_text", F.lit("")), F.lit(EXAMPLE_SLIDE)), "example_slide")
    )
    found = last_of_kind(rows.withColumn("kind", kind).where(F.col("kind").isNotNull()), keys=keys)
    return found.drop("__first_hash", "__first_ocr", "__first", "__own", "__deck", "reference_text")


def deck_timeline(matches: DataFrame, durations: DataFrame | None = None, keys=KEYS) -> DataFrame:
    return collapse_runs(matches, durations, keys)
