"""Change detection, islands, absorption and other operators over ordered rows of a lecture.

Each partitions by ``keys`` (the lecture) and orders by ``order``: one shuffle, shared by all windows of a
plan that use the same keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ("lecture_id",)


def ordered(keys=KEYS, order="event_index"):
    return Window.partitionBy(*keys).orderBy(*([order] if isinstance(order, str) else order))


def upto(window):
    return window.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def whole(window):
    return window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def pixel_difference(a: Column, b: Column) -> Column:
    """Mean absolute difference of two pixel arrays of one length, as a share of 255."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y)), F.lit(0.0), lambda acc, x: acc + x)
    return total / F.greatest(F.size(a), F.lit(1)) / 255


def change_events(samples: DataFrame, threshold: float, value: str = "value", order="timestamp", keys=KEYS, difference=None) -> DataFrame:
    """The samples that differ from the sample before by more than the threshold, and the first; numbered from 0.

    Each is compared with the sample before it, whether that was an event or not.
    """
    w = ordered(keys, order)
    before = F.lag(value).over(w)
    apart = difference(F.col(value), before) if difference else F.abs(F.col(value) - before)
    rows = samples.withColumn("difference", apart).where(F.col("difference").isNull() | (F.col("difference") > threshold))
    return rows.withColumn("event_index", (F.row_number().over(w) - 1).cast("long"))


def frame_events(frames: DataFrame, threshold: float = 0.02) -> DataFrame:
    rows = change_events(frames, threshold, "pixels", "frame_idx", difference=pixel_difference)
    return rows.select("lecture_id", "event_index", F.round("timestamp", 3).alias("timestamp"), "frame_idx")


def island_id(df: DataFrame, breaks: Column, order="event_index", keys=KEYS, name: str = "run_idx") -> DataFrame:
    """``df`` with the number of the island, from 0; an island starts where ``breaks`` is true, and at the first row."""
    w = ordered(keys, order)
    begins = F.when(F.row_number().over(w) == 1, 0).otherwise(F.coalesce(breaks, F.lit(False)).cast("int"))
    return df.withColumn("__begins", begins).withColumn(name, F.sum("__begins").over(upto(w)).cast("long")).drop("__begins")


def value_runs(df: DataFrame, value: str = "slide_number", order="event_index", keys=KEYS) -> DataFrame:
    """Islands of equal values."""
    return island_id(df, ~F.col(value).eqNullSafe(F.lag(value).over(ordered(keys, order))), order, keys)


def similarity_runs(df: DataFrame, threshold: float, similarity: str = "similarity", order="event_index", keys=KEYS) -> DataFrame:
    """Islands that break where the similarity with the row before is below the threshold."""
    return island_id(df, F.col(similarity) < threshold, order, keys)


def collapse_runs(matches: DataFrame, durations: DataFrame | None = None, keys=KEYS) -> DataFrame:
    """A row for each island of ``slide_number``: start, end, confidence, last frame and event.

    An end is the next run's start, else the video's duration, else the last event's own time; ``end_source``
    says which.
    """
    rows = value_runs(matches, keys=keys)
    last = F.struct("event_index", "timestamp", "frame_image_path")
    runs = rows.groupBy(*keys, "run_idx").agg(
        F.first("slide_number").alias("slide_number"),
        F.min("timestamp").alias("start"),
        F.max("score").alias("confidence"),
        F.max(last).alias("last"),
        F.count("*").alias("n_events"),
    )
    w = ordered(keys, "run_idx")
    runs = runs.withColumn("next_start", F.lead("start").over(w))
    if durations is not None:
        runs = runs.join(durations.select(*keys, "video_duration"), list(keys), "left")
    else:
        runs = runs.withColumn("video_duration", F.lit(None).cast("double"))
    source = F.when(F.col("next_start").isNotNull(), "next run").when(F.col("video_duration").isNotNull(), "video duration").otherwise("last event")
    return runs.select(
        *keys,
        "run_idx",
        "slide_number",
        "start",
        F.coalesce("next_start", "video_duration", "last.timestamp").alias("end"),
        "confidence",
        F.col("last.frame_image_path").alias("last_frame_image_path"),
        "n_events",
        source.alias("end_source"),
    )


def timeline_notes(runs: DataFrame, keys=KEYS) -> DataFrame:
    """(keys, note): what is uncertain about a timeline's last end."""
    last = runs.where("end_source = 'last event'")
    guess = F.lit("The video's duration is unknown; the last run ends at its last event.")
    empty = F.lit("The last run has no length of its own.")
    return last.select(*keys, F.explode(F.when(F.col("end") == F.col("start"), F.array(guess, empty)).otherwise(F.array(guess))).alias("note"))


def ocr_owner(df: DataFrame, hash_column: str = "hash", most_bits: int = 3, order="event_index", keys=KEYS) -> DataFrame:
    """``df`` with ``owner``: the index of the frame whose text a frame shares.

    A frame within ``most_bits`` of the frame just before belongs to that one's owner; one without a hash, or
    after one without, owns itself.
    """
    w = ordered(keys, order)
    near = F.bit_count(F.col(hash_column).bitwiseXOR(F.lag(hash_column).over(w))) <= most_bits
    own = F.when(~F.coalesce(near, F.lit(False)), F.col("event_index"))
    return df.withColumn("__own", own).withColumn("owner", F.last("__own", ignorenulls=True).over(upto(w))).drop("__own")


def owners_text(owned: DataFrame, text: str = "ocr_text", order="event_index", keys=KEYS) -> DataFrame:
    """Every frame with its owner's text; texts of other frames are not read."""
    w = Window.partitionBy(*keys, "owner").orderBy(order)
    return owned.withColumn(text, F.first(text).over(upto(w)))


def absorb_backward(islands: DataFrame, least: float, order="run_idx", keys=KEYS) -> DataFrame:
    """``islands`` (start, last) with ``merged_idx``: one shorter than ``least`` joins the one it follows; the first stands."""
    w = ordered(keys, order)
    stands = (F.row_number().over(w) == 1) | (F.col("last") - F.col("start") >= least)
    return islands.withColumn("__stands", stands.cast("int")).withColumn("merged_idx", (F.sum("__stands").over(upto(w)) - 1).cast("long")).drop("__stands")


def absorb_forward(runs: DataFrame, min_dwell: float = 5.0, order="run_idx", keys=KEYS) -> DataFrame:
    """``runs`` with ``short``, ``target`` (run that takes it in) and ``merged_from`` of the surviving runs.

    A short run goes to the next run that is not short, at the end of a lecture to the last such run, and
    where all are short to the last run. A run without an end is never short. ``merged_from`` names the run just before
    the target, and the lecture's last run where that is taken in.
    """
    w = ordered(keys, order)
    every = whole(w)
    short = F.coalesce(F.col("end") - F.col("start") < min_dwell, F.lit(False))
    rows = runs.withColumn("short", short).withColumn("__stays", F.when(~F.col("short"), F.col(order)))
    back = Window.partitionBy(*keys).orderBy(F.desc(order))
    ahead = F.last("__stays", ignorenulls=True).over(upto(back))
    final, end = F.last("__stays", ignorenulls=True).over(every), F.last(order).over(every)
    rows = rows.withColumn("target", F.coalesce(ahead, final, end))
    before = F.when(F.lag("short").over(w), F.array(F.lag("slide_number").over(w))).otherwise(F.array().cast("array<int>"))
    tail_short, tail_slide = F.last("short").over(every), F.last("slide_number").over(every)
    after = F.when(tail_short & (F.col(order) == final) & (final != end), F.array(tail_slide)).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("merged_from", F.when(F.col("target") == F.col(order), F.concat(before, after)).otherwise(F.array().cast("array<int>")))
    return rows.drop("__stays")


def last_of_kind(candidates: DataFrame, order="event_index", run="run_idx", keys=KEYS) -> DataFrame:
    """Of candidates next to each other in a run that are of one kind, the last."""
    w = Window.partitionBy(*keys, run).orderBy(order)
    return candidates.withColumn("__next", F.lead("kind").over(w)).where(~F.col("kind").eqNullSafe(F.col("__next"))).drop("__next")


def first_in_run(df: DataFrame, columns: dict[str, str], order="event_index", run="run_idx", keys=KEYS) -> DataFrame:
    """``df`` with the run's first value of each column, under the name given."""
    w = upto(Window.partitionBy(*keys, run).orderBy(order))
    return df.withColumns({name: F.first(c).over(w) for c, name in columns.items()})


def running_offsets(parts: DataFrame, length: str = "duration", order="part", keys=KEYS) -> DataFrame:
    """``parts`` with ``offset``, the sum of the lengths before; a part without a length is an error."""
    known = F.coalesce(F.col(length), F.raise_error(F.lit("a part has no duration")).cast("double"))
    w = ordered(keys, order).rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("__known", known).withColumn("offset", F.coalesce(F.sum("__known").over(w), F.lit(0.0))).drop("__known")


def running_maximum(lines: DataFrame, value: str = "percent", order="seq", keys=KEYS) -> DataFrame:
    """The rows that exceed all before, so that progress never falls."""
    w = ordered(keys, order).rowsBetween(Window.unboundedPreceding, -1)
    return lines.withColumn("__best", F.max(value).over(w)).where(F.col(value).isNotNull() & (F.col("__best").isNull() | (F.col(value) > F.col("__best")))).drop("__best")


def previous_tail(segments: DataFrame, chars: int = 200, keys=KEYS) -> DataFrame:
    """(keys, part, tail): the end of the text that precedes each part."""
    last = segments.groupBy(*keys, "part").agg(F.max(F.struct("seg_index", "text"))["text"].alias("text"))
    return last.select(*keys, "part", F.lag(F.right("text", F.lit(chars)), 1, "").over(ordered(keys, "part")).alias("tail"))
