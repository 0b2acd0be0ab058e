"""Transcripts that were made in chunks of audio."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from .runs import KEYS, running_offsets


def chunk_plan(audio: DataFrame, keys=KEYS) -> DataFrame:
    """(keys, part, start, length): the chunks of each recording (duration, chunk_seconds)."""
    parts = F.sequence(F.lit(0), F.greatest(F.ceil(F.col("duration") / F.col("chunk_seconds")).cast("int") - 1, F.lit(0)))
    rows = audio.select(*keys, "duration", "chunk_seconds", F.explode(parts).alias("part"))
    start = F.col("part") * F.col("chunk_seconds")
    return rows.select(*keys, "part", start.alias("start"), F.least(F.col("chunk_seconds"), F.col("duration") - start).alias("length"))


def stitch(parts: DataFrame, segments: DataFrame, keys=KEYS) -> DataFrame:
    """(keys, language, segments): chunks' segments moved by the time before them, in order.

    ``parts`` are (part, duration, language), ``segments`` (part, seg_index, start, end, text). The language is
    the first chunk's that has one.
    """
    moved = segments.join(running_offsets(parts, keys=keys).select(*keys, "part", "offset"), [*keys, "part"])
    own = F.struct("part", "seg_index", (F.col("start") + F.col("offset")).alias("start"), (F.col("end") + F.col("offset")).alias("end"), "text")
    listed = moved.groupBy(*keys).agg(F.array_sort(F.collect_list(own)).alias("__all"))
    known = F.when(F.coalesce("language", F.lit("")) != "", F.col("language"))
    spoken = parts.groupBy(*keys).agg(F.min_by("language", F.when(known.isNotNull(), F.col("part"))).alias("language"))
    bare = F.transform("__all", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["text"].alias("text")))
    none = F.array().cast("array<struct<start:double,end:double,text:string>>")
    return spoken.join(listed, list(keys), "left").select(*keys, F.coalesce("language", F.lit("")).alias("language"), F.coalesce(bare, none).alias("segments"))


def parsed_response(detected, forced, segments) -> F.Column:
    """STRUCT<language, segments> of a recogniser's answer: times as numbers, texts without white space at their ends."""
    own = F.transform(segments, lambda s: F.struct(s["start"].cast("double").alias("start"), s["end"].cast("double").alias("end"), strip(s["text"]).alias("text")))
    language = F.coalesce(F.nullif(detected, F.lit("")), forced, F.lit(""))
    return F.struct(language.alias("language"), own.alias("segments"))


def answer_or_error(answer, forced) -> F.Column:
    """STRUCT<response, error> of a recogniser's JSON: without a list of segments that all have times, only the error is set."""
    read = F.from_json(answer, "language string, segments array<struct<start:double,end:double,text:string>>")
    whole = F.forall(read["segments"], lambda s: s["start"].isNotNull() & s["end"].isNotNull() & s["text"].isNotNull())
    good = F.coalesce(whole, F.lit(False))
    found = parsed_response(read["language"], F.lit(forced), read["segments"])
    return F.struct(F.when(good, found).alias("response"), F.when(~good, F.lit("malformed response")).alias("error"))


def zipped(left: DataFrame, right: DataFrame, order, keys=KEYS) -> DataFrame:
    """Rows of both sides by their place; a place that only one side has is an error."""
    rows = left.withColumn("__left", F.lit(True)).join(right.withColumn("__right", F.lit(True)), [*keys, order], "full")
    both = F.col("__left").isNotNull() & F.col("__right").isNotNull()
    checked = F.when(both, F.col(order)).otherwise(F.raise_error(F.lit("sides differ in length")).cast(rows.schema[order].dataType))
    return rows.withColumn(order, checked).drop("__left", "__right")


def transcript_rows(transcripts: DataFrame, keys=KEYS) -> DataFrame:
    """One row for each segment."""
    return transcripts.select(*keys, F.posexplode("segments").alias("seg_index", "s")).select(*keys, "seg_index", "s.*")


def numbered(df: DataFrame, order, keys=KEYS, name="number") -> DataFrame:
    """Rows numbered from 1."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
