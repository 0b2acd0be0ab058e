"""Relations about lectures, stages, jobs and settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runs import KEYS

LECTURE_ID = r"^lecture\d{2,}$"
EXAM_NAME = r"^exam_\d{2,}$"


def playlist_entries(playlists: DataFrame) -> DataFrame:
    """(playlist, index, title, url, duration) of JSON arrays (playlist, entries): null entries drop out, bare ids become addresses."""
    kind = "array<struct<id:string,url:string,title:string,duration:double>>"
    rows = playlists.select("playlist", F.filter(F.from_json("entries", kind), lambda e: e.isNotNull() & (e["id"].isNotNull() | e["url"].isNotNull())).alias("all"))
    flat = rows.select("playlist", F.posexplode("all").alias("index", "e"))
    address = F.coalesce("e.url", "e.id")
    url = F.when(F.regexp_like(address, F.lit("^https?://")), address).otherwise(F.concat(F.lit("https://www.youtube.com/watch?v="), address))
    title = F.coalesce(F.nullif("e.title", F.lit("")), F.concat(F.lit("video "), (F.col("index") + 1).cast("string")))
    return flat.select("playlist", "index", title.alias("title"), url.alias("url"), "e.duration")


def number_lectures(entries: DataFrame, order="position", keys=()) -> DataFrame:
    """(lecture_id, title, …): ids by confirmed order, titles default to the id."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    rows = entries.withColumn("lecture_id", F.format_string("lecture%02d", place))
    return rows.withColumn("title", F.coalesce(F.nullif("title", F.lit("")), "lecture_id"))


def valid_ids(df: DataFrame, known: DataFrame, column: str = "lecture_id", pattern: str = LECTURE_ID) -> DataFrame:
    """Rows whose id is well formed and known."""
    return df.where(F.regexp_like(column, F.lit(pattern))).join(known.select(column).distinct(), column, "left_semi")


def valid_exam_names(df: DataFrame, column: str = "name") -> DataFrame:
    return df.where(F.regexp_like(column, F.lit(EXAM_NAME)))


def wanted_stages(stages) -> F.Column:
    """The stages that a request names, each once, in their order."""
    return F.array_sort(F.array_distinct(F.col(stages)))


def valid_url(url) -> F.Column:
    url = F.col(url) if isinstance(url, str) else url
    return F.coalesce(F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))).isin("http", "https") & (F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")) != ""), F.lit(False))


def parse_crop(spec) -> F.Column:
    """Four shares x,y,w,h within the frame as an array, else null."""
    own = F.transform(F.split(F.col(spec), ","), lambda x: F.trim(x).try_cast("double"))
    inside = F.forall(own, lambda v: F.coalesce((v >= 0) & (v <= 1), F.lit(False)))
    at = lambda i: F.get(own, F.lit(i))
    return F.when((F.size(own) == 4) & inside & (at(0) + at(2) <= 1 + 1e-9) & (at(1) + at(3) <= 1 + 1e-9), own)


def cropped(pixels, width, height, crop) -> F.Column:
    """Rows and columns of a row-by-row pixel array within the crop, at least one of each."""
    w, h = F.col(width), F.col(height)
    x0 = F.least(F.floor(F.get(crop, F.lit(0)) * w), w - 1).cast("int")
    y0 = F.least(F.floor(F.get(crop, F.lit(1)) * h), h - 1).cast("int")
    x1 = F.greatest(F.floor((F.get(crop, F.lit(0)) + F.get(crop, F.lit(2))) * w).cast("int"), x0 + 1)
    y1 = F.greatest(F.floor((F.get(crop, F.lit(1)) + F.get(crop, F.lit(3))) * h).cast("int"), y0 + 1)
    return F.filter(F.col(pixels), lambda p, i: (i % w >= x0) & (i % w < x1) & (F.floor(i / w) >= y0) & (F.floor(i / w) < y1))


def missing_languages(spec, installed) -> F.Column:
    return F.array_except(F.filter(F.split(F.col(spec), r"\+"), lambda x: x != ""), F.col(installed))


def fetch_plan(lectures: DataFrame, provenance: DataFrame, force: bool = False) -> DataFrame:
    """``lectures`` (lecture_id, url) with ``fetch``: false where a playable file came from the same address."""
    own = provenance.select("lecture_id", F.col("url").alias("__from"), "playable")
    hit = F.coalesce(F.col("playable"), F.lit(False)) & F.col("url").eqNullSafe(F.col("__from"))
    return lectures.join(own, "lecture_id", "left").withColumn("fetch", F.lit(force) | ~hit).drop("__from", "playable")


def task_plan(lectures: DataFrame, stages: DataFrame, options: DataFrame, has_key: bool, force: bool = False, last: int = 7) -> DataFrame:
    """(lecture_id, stage, argv): each lecture's stages with their options as flags, then the stage over all lectures, which always runs anew.

    ``options`` are (stage, position, flag, value); those without a value are left out. Stage 6 needs a key.
    """
    given = options.where(F.coalesce("value", F.lit("")) != "").groupBy("stage").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("position", "flag", "value"))), lambda o: F.array(o["flag"], o["value"]))).alias("argv")
    )
    wanted = stages.where((F.col("stage") != 6) | F.lit(has_key))
    each = lectures.select("lecture_id").crossJoin(wanted.where(F.col("stage") < last)).join(given, "stage", "left")
    none = F.array().cast("array<string>")
    argv = F.concat(F.coalesce("argv", none), F.array(F.lit("--force")) if force else none)
    every = wanted.where(F.col("stage") == last).select(F.lit(None).cast("string").alias("lecture_id"), "stage", F.array(F.lit("--force")).alias("argv"))
    return each.select("lecture_id", "stage", argv.alias("argv")).union(every)


def overlay(defaults, overrides) -> F.Column:
    """Both maps as one; keys of the second win (needs the session's LAST_WIN policy)."""
    return F.map_concat(F.col(defaults), F.col(overrides))


def settled(tasks: DataFrame, keys=KEYS) -> DataFrame:
    """(keys, all_done, all_settled, status) of tasks (stage, status): cancelled before failed before done."""
    done = F.col("status") == "done"
    return tasks.groupBy(*keys).agg(
        F.bool_and(done).alias("all_done"),
        F.bool_and(F.col("status").isin("done", "failed", "skipped", "cancelled", "blocked")).alias("all_settled"),
        F.when(F.bool_or(F.col("status") == "cancelled"), "cancelled").when(F.bool_or(F.col("status").isin("failed", "blocked")), "failed").when(F.bool_and(done), "done").otherwise("running").alias("status"),
    )


def ready_tasks(tasks: DataFrame, keys=KEYS) -> DataFrame:
    """Tasks to run or to skip next: pending ones whose earlier tasks are done, and those after a failure, with ``action``."""
    w = Window.partitionBy(*keys).orderBy("stage").rowsBetween(Window.unboundedPreceding, -1)
    rows = tasks.withColumn("__ok", F.coalesce(F.bool_and(F.col("status") == "done").over(w), F.lit(True)))
    rows = rows.withColumn("__bad", F.coalesce(F.bool_or(F.col("status").isin("failed", "blocked")).over(w), F.lit(False)))
    action = F.when(F.col("__bad"), "skip").when(F.col("__ok"), "run")
    return rows.withColumn("action", action).where((F.col("status") == "pending") & F.col("action").isNotNull()).drop("__ok", "__bad")


def dashboard(lectures: DataFrame, artifacts: DataFrame, decks: DataFrame, reviews: DataFrame, keys=KEYS) -> DataFrame:
    """A row for each lecture: title, deck, a map of finished stages and the number of weak matches."""
    done = artifacts.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("stage", "done")))).alias("stages"))
    rows = lectures.join(done, list(keys), "left").join(decks, list(keys), "left").join(reviews.select(*keys, "n_low"), list(keys), "left")
    return rows.withColumn("title", F.coalesce(F.nullif("title", F.lit("")), "lecture_id")).withColumn("n_low", F.coalesce("n_low", F.lit(0).cast("long")))


def preflight(checks: DataFrame) -> DataFrame:
    """(ready, failing): whether all required checks hold, and the names of those that don't."""
    bad = F.array_sort(F.collect_set(F.when(F.col("required") & ~F.col("ok"), F.col("name"))))
    return checks.agg(F.coalesce(F.bool_and(F.when(F.col("required"), F.col("ok"))), F.lit(True)).alias("ready"), bad.alias("failing"))


def recent_events(events: DataFrame, keep: int = 2000, after: int | None = None) -> DataFrame:
    """The last events of a log by sequence number, those after a known one if asked for."""
    rows = events if after is None else events.where(F.col("seq") > after)
    return rows.orderBy(F.desc("seq")).limit(keep)


def review_rows(needs_review: DataFrame, slides: DataFrame, keys=KEYS) -> DataFrame:
    """Rows to review with their slides' titles, and images' paths as addresses."""
    own = slides.select(*keys, "slide_number", "title")
    address = F.regexp_replace("frame_image_path", "^output/", "/files/")
    return needs_review.join(own, [*keys, "slide_number"], "left").withColumn("frame_url", address).withColumn("title", F.coalesce("title", F.lit("")))


def ready_for_essentials(lectures: DataFrame, notes: DataFrame, keys=KEYS) -> DataFrame:
    return lectures.join(notes.select(*keys).distinct(), list(keys), "left_semi")


def exam_listing(files: DataFrame) -> DataFrame:
    """(name, has_key) of files (name): keys are listed with their papers, not on their own."""
    keys = files.where(F.col("name").endswith("_key")).select(F.regexp_replace("name", "_key$", "").alias("name"), F.lit(True).alias("has_key"))
    return files.where(~F.col("name").endswith("_key")).select("name").join(keys, "name", "left").withColumn("has_key", F.coalesce("has_key", F.lit(False)))


def total_usage(usages: DataFrame, keys=()) -> DataFrame:
    """Sums of the token counts, of nothing 0."""
    names = ("input_tokens", "output_tokens", "cache_creation_input_tokens", "cache_read_input_tokens")
    sums = [F.coalesce(F.sum(F.coalesce(F.col(n), F.lit(0))), F.lit(0)).cast("long").alias(n) for n in names]
    return usages.groupBy(*keys).agg(*sums) if keys else usages.agg(*sums)


def rank_candidates(candidates: DataFrame, cap: int = 40, keys=KEYS) -> DataFrame:
    """The ``cap`` candidates of a lecture that are worth asking about: with cues first, then by kind, then by time."""
    kind = F.when(F.col("kind") == "whiteboard", 0).when(F.col("kind") == "annotated_slide", 1).when(F.col("kind") == "example_slide", 2).otherwise(99)
    w = Window.partitionBy(*keys).orderBy((F.size("cue_hits") == 0).cast("int"), kind, "timestamp", "event_index")
    return candidates.withColumn("place", F.row_number().over(w)).where(F.col("place") <= cap)


def split_verdicts(judged: DataFrame, verdict: str = "verdict") -> tuple[DataFrame, DataFrame]:
    """Confirmed and rejected candidates; without a verdict a candidate is rejected."""
    good = F.coalesce(F.col(f"{verdict}.is_example"), F.lit(False))
    return judged.where(good), judged.where(~good)
