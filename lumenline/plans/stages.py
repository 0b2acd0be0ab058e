"""Stage plans over tables, and what an incremental run has to do."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import DEFAULTS, Tunables
from ..operators import match, segment, visual
from ..operators.runs import KEYS, absorb_forward, frame_events
from ..operators.tfidf import event_slide_similarity
from ..sources.scratch import stored


def detect_stage(frames: DataFrame, t: Tunables = DEFAULTS) -> DataFrame:
    return frame_events(frames, t.change_threshold)


def match_stage(events: DataFrame, slides: DataFrame, durations: DataFrame | None, stop_words: list[str] | None, modes: DataFrame | None = None, t: Tunables = DEFAULTS) -> dict[str, DataFrame]:
    """timeline, matches, low_confidence, backward_jumps, unmatched_slides, candidates of events with texts and hashes.

    A lecture is segmented by sight if its mode (lecture_id, mode) says so, or if too many of its matches are weak;
    both branches are plans over disjoint lectures, and their timelines' ``mode`` is what was done. By sight
    there is nothing to review and there are no candidates. Without modes and with a threshold of 0 no lecture is. The matches
    are stored before the rest is made of them.
    """
    wanted = events.select(*KEYS).distinct()
    wanted = wanted.join(modes, list(KEYS), "left") if modes is not None else wanted.withColumn("mode", F.lit(None).cast("string"))
    chosen = wanted.where(F.coalesce("mode", F.lit("deck")) != "visual").select(*KEYS)
    deck = slides.withColumn("reference_text", segment.reference_text())
    cells = event_slide_similarity(events.join(chosen, list(KEYS), "left_semi"), deck, stop_words)
    found = match.match_events(cells, t.backward_margin, t.stay_margin, t.min_forward_score)
    shown = events.select(*KEYS, F.col("event_index").cast("long").alias("event_index"), "timestamp", "frame_image_path", "hash", "ocr_text")
    matches = stored(found.join(shown, [*KEYS, "event_index"]).withColumn("ocr_excerpt", F.left("ocr_text", F.lit(t.excerpt_chars))), "matches")
    quality = match.confidence_by_lecture(matches, t.confidence_threshold, t.auto_visual_threshold)
    kept = quality.where("not fall_back").select(*KEYS)
    good = matches.join(kept, list(KEYS), "left_semi")
    from_deck = match.deck_timeline(good, durations).select(*KEYS, "slide_number", "start", "end", "confidence", "last_frame_image_path")
    timeline = from_deck.withColumn("segment_keywords", F.array().cast("array<string>")).withColumn("mode", F.lit("deck"))
    if modes is not None or t.auto_visual_threshold > 0:
        by_sight = events.join(kept, list(KEYS), "left_anti")
        seen = visual.visual_timeline(by_sight, durations, t.visual_similarity, t.visual_min_seconds, t.visual_min_df, t.visual_keywords)
        timeline = timeline.unionByName(seen.withColumn("mode", F.lit("visual")))
    return {
        "timeline": timeline,
        "matches": good,
        "low_confidence": match.low_confidence(good, t.confidence_threshold),
        "backward_jumps": match.backward_jumps(good),
        "unmatched_slides": match.unmatched(slides.join(kept, list(KEYS), "left_semi"), from_deck),
        "candidates": match.classify_examples(good, deck, t.example_score_max, t.example_ink_delta, t.example_overlap_min, t.example_novel_min, t.excerpt_chars),
    }


def segment_stage(timeline: DataFrame, transcript: DataFrame, slides: DataFrame, candidates: DataFrame, t: Tunables = DEFAULTS) -> DataFrame:
    """Segments of runs (run_idx, slide_number, start, end, last_frame_image_path, mode) with texts, slide data and examples.

    Slides are made canonical in deck mode only. Segments are stored before examples are looked for, as three joins need them.
    """
    modes = timeline.groupBy(*KEYS).agg(F.max("mode").alias("mode"))
    canonical = segment.canonical_slides(slides).join(modes.where("mode <> 'visual'").select(*KEYS), list(KEYS), "left_semi")
    runs = segment.with_canonical(timeline, canonical)
    assigned = segment.assign_to_runs(transcript, runs)
    alive = segment.run_texts(assigned, absorb_forward(runs, t.min_dwell))
    rows = stored(segment.consolidate(alive).withColumnRenamed("first_run", "segment_idx"), "segments")
    rows = segment.with_slide_data(rows, slides).join(modes, list(KEYS), "left")
    return segment.attach_examples(rows, segment.with_canonical(candidates, canonical), transcript)


def pending_lectures(requested: DataFrame, done: DataFrame, force: bool = False) -> DataFrame:
    """Lectures of which a stage has no rows yet; all if forced."""
    return requested if force else requested.join(done.select(*KEYS).distinct(), list(KEYS), "left_anti")
