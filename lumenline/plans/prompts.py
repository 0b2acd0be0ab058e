"""Prompts as columns, and long material cut to a budget of characters before any of it is joined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clock, strip

NONE = "(none)"


def within_budget(parts: DataFrame, chars: int, keys, order, text: str = "text", separator: str = "\n\n") -> DataFrame:
    """The parts of each group that a text of ``chars`` characters has room for, in order, the last one cut; each but the
    group's last ends with the separator.

    Joined without anything between they are the beginning of all parts joined by the separator. Which parts fit follows from a
    running sum of lengths, so what is left out is never joined nor moved to where the rest is joined. Nulls count as empty.
    """
    by = Window.partitionBy(*keys).orderBy(order)
    own = F.coalesce(F.col(text), F.lit(""))
    rows = parts.withColumn("__part", F.when(F.lead(F.lit(1)).over(by).isNull(), own).otherwise(F.concat(own, F.lit(separator))))
    before = F.coalesce(F.sum(F.length("__part")).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("__room", F.lit(chars) - before).where("__room > 0")
    return rows.withColumn(text, F.left("__part", F.col("__room").cast("int"))).drop("__part", "__room")


def joined_within(parts: DataFrame, chars: int, keys, order, text: str = "text", separator: str = "\n\n") -> DataFrame:
    """(keys, text): each group's parts in order, joined and cut to ``chars``."""
    fits = within_budget(parts, chars, keys, order, text, separator)
    listed = F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text])
    return fits.groupBy(*keys).agg(F.array_join(listed, "").alias(text))


def section(title: str, text: Column) -> Column:
    return F.concat(F.lit(f"\n\n{title}:\n"), F.coalesce(F.nullif(strip(F.coalesce(text, F.lit(""))), F.lit("")), F.lit(NONE)))


def listed(values: Column) -> Column:
    return F.when(F.coalesce(F.size(values), F.lit(0)) > 0, F.array_join(values, ", "))


def slide_prompt(examples: Column | None = None) -> Column:
    """A slide (slide_number, slide_text, notes_text, transcript_text), and its confirmed ``examples`` ARRAY<STRUCT<kind, caption>>."""
    out = F.concat(
        F.lit("Slide "), F.col("slide_number").cast("string"),
        section("On the slide", F.col("slide_text")), section("In the deck's notes, not said aloud", F.col("notes_text")), section("Said while it was shown", F.col("transcript_text")),
    )
    if examples is None:
        return out
    lines = F.transform(examples, lambda e, i: F.concat((i + 1).cast("string"), F.lit(". "), F.coalesce(e["kind"], F.lit("example")), F.lit(": "), F.coalesce(e["caption"], F.lit(""))))
    shown = F.concat(F.lit("\n\nWorked out meanwhile, and shown as images in this order:\n"), F.array_join(lines, "\n"))
    return F.concat(out, F.when(F.coalesce(F.size(examples), F.lit(0)) > 0, shown).otherwise(""))


def segment_prompt() -> Column:
    """A stretch of a recording without a deck (position, start, end, segment_keywords, transcript_text)."""
    begin = F.when(F.col("start").isNull(), F.lit("?")).otherwise(clock(F.col("start")))
    end = F.when(F.col("end").isNull(), F.lit("")).otherwise(F.concat(F.lit(" - "), clock(F.col("end"))))
    return F.concat(
        F.lit("Part "), F.col("position").cast("string"), F.lit(" of the recording ("), begin, end, F.lit(")"),
        section("Words read off the screen, which may be misread", listed(F.col("segment_keywords"))), section("Said meanwhile", F.col("transcript_text")),
    )


def lecture_prompt() -> Column:
    """A lecture's notes (lecture_id, text)."""
    return F.concat(F.lit("Lecture "), "lecture_id", F.lit("\n\nIts notes, slide by slide:\n\n"), F.coalesce("text", F.lit("")))


def exam_prompt(count: Column | int) -> Column:
    """Paper ``number`` of ``count`` by a blueprint from course material (number, blueprint, text)."""
    count = F.lit(count)
    variant = F.concat(F.lit("\n\nThis is paper "), F.col("number").cast("string"), F.lit(" of "), count.cast("string"), F.lit("; its questions differ from those of the others."))
    return F.concat(F.lit("Blueprint:\n"), "blueprint", F.lit("\n\nCourse material:\n\n"), F.coalesce("text", F.lit("")), F.when(count > 1, variant).otherwise(""))


def with_listing(material: DataFrame, rows: DataFrame, title: str, label: Column, keys, order, none: str = "") -> DataFrame:
    """``material`` (keys, text) with ``prompt``: the text, then ``rows`` (keys, text) in order under their labels."""
    entry = F.concat(F.lit("\n--- "), label, F.lit(" ---\n"), F.coalesce("text", F.lit("")))
    entries = rows.select(*keys, F.struct(order, entry.alias("entry")).alias("e")).groupBy(*keys).agg(F.array_sort(F.collect_list("e")).alias("__entries"))
    shown = F.concat(F.lit(f"\n\n{title}\n"), F.array_join(F.transform("__entries", lambda x: x["entry"]), "\n"))
    return material.join(entries, list(keys), "left").withColumn("prompt", F.concat("text", F.coalesce(shown, F.lit(none)))).drop("__entries")


def course_prompts(guide: DataFrame, sheets: DataFrame, keys, order="place", chars: int = 350_000) -> DataFrame:
    """(keys, text, prompt) of a course's guide in parts (keys, order, text), cut to ``chars``, and its sheets (keys, lecture_id, text)."""
    return with_listing(joined_within(guide, chars, keys, order), sheets, "Sheets of single lectures made from it:", F.col("lecture_id"), keys, "lecture_id")


def format_prompts(material: DataFrame, pages: DataFrame, keys, order="place", chars: int = 350_000) -> DataFrame:
    """(keys, text, prompt) of course material in parts, cut to ``chars``, and past exams' pages (keys, source, page_number, text)."""
    text = F.coalesce(F.nullif("text", F.lit("")), F.lit("(a scan; see its image)"))
    label = F.concat("source", F.lit(" page "), F.col("page_number").cast("string"))
    rows = pages.withColumn("text", text).withColumn("__at", F.struct("source", "page_number"))
    return with_listing(joined_within(material, chars, keys, order), rows, "Pages of past exams:", label, keys, "__at", "\n\nThere are no past exams; choose a form that suits the material.")
