"""Markdown documents from notes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import clock, note_image_path, numbered_heading, strip
from ..operators.runs import KEYS


#: Lines of a lecture's notes.
SKIPPED = "*(Nothing to summarize here — skipped.)*"
FAILED = ("*(Note generation failed here: ", ")*")
FAILED_LIST = "\n---\n\n**Slides that failed to generate:** "


def joined(order, text, separator: str):
    """Aggregate: the texts in order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))), lambda x: x["t"]), separator)


def table_of_contents(lectures: DataFrame) -> DataFrame:
    """One row: a linked list of the lectures, by id."""
    lines = lectures.select("lecture_id", F.concat(F.lit("- ["), "lecture_id", F.lit("](#"), "lecture_id", F.lit(")")).alias("line"))
    return lines.agg(F.concat(F.lit("# Table of Contents\n\n"), joined("lecture_id", "line", "\n"), F.lit("\n")).alias("toc"))


def titled_notes(notes: DataFrame) -> DataFrame:
    """Notes (lecture_id, text) that all start with their lecture's heading."""
    has = F.regexp_replace("text", r"(?U)^\s+", "").startswith(F.concat(F.lit("# "), "lecture_id"))
    return notes.withColumn("text", F.when(has, F.col("text")).otherwise(F.concat(F.lit("# "), "lecture_id", F.lit("\n\n"), "text")))


def assemble_guide(notes: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """One row, guide: contents, an index (text) if there is one, and all notes, each with a blank line after it.

    The guide is one document by nature; notes are a course's, some hundred kilobytes.
    """
    parts = titled_notes(notes).withColumn("text", F.concat("text", F.lit("\n")))
    body = parts.agg(joined("lecture_id", "text", "\n").alias("body")).crossJoin(table_of_contents(notes))
    if index is None:
        return body.select(F.concat("toc", "body").alias("guide"))
    shown = body.crossJoin(index.agg(F.first("text").alias("index")))
    return shown.select(F.concat("toc", F.when(F.coalesce("index", F.lit("")) != "", F.concat("index", F.lit("\n\n---\n\n"))).otherwise(""), "body").alias("guide"))


def examples_block(examples: DataFrame, keys=(*KEYS, "slide_number")) -> DataFrame:
    """(keys, examples): a slide's confirmed examples by time; numbers count all, those whose frame is missing are left out."""
    own = F.struct("timestamp", "event_index", "frame_image_path", "caption", "exists")
    rows = examples.groupBy(*keys).agg(F.array_sort(F.collect_list(own)).alias("all"))

    def block(x, i):
        caption = strip(F.coalesce(x["caption"], F.lit("")))
        image = F.concat(F.lit("![Example "), (i + 1).cast("string"), F.lit(" — "), clock(x["timestamp"]), F.lit("]("), note_image_path(x["frame_image_path"]), F.lit(")"))
        return F.when(x["exists"], F.concat(image, F.when(caption != "", F.concat(F.lit("\n*"), caption, F.lit("*"))).otherwise("")))

    blocks = F.filter(F.transform("all", block), lambda b: b.isNotNull())
    return rows.select(*keys, F.when(F.size(blocks) == 0, "").otherwise(F.concat(F.lit("\n\n**Examples:**\n\n"), F.array_join(blocks, "\n\n"), F.lit("\n"))).alias("examples"))


def lecture_notes(noted: DataFrame, overview: DataFrame | None = None, keys=KEYS) -> DataFrame:
    """(lecture_id, text): a lecture's notes from segments (position, slide_number, mode, note, examples, deck_image_path, frame_image_path).

    Images (both columns may be null) stand under the heading, examples at the end. A note that failed or had
    nothing to say leaves a line; the failed ones are listed by their deck's numbers.
    """
    visual = F.col("mode") == "visual"
    label, number = F.when(visual, "Segment").otherwise("Slide"), F.col("position").cast("string")
    shown = lambda alt, path: F.when(F.coalesce(path, F.lit("")) == "", "").otherwise(F.concat(F.lit("\n!["), alt, F.lit("]("), note_image_path(path), F.lit(")\n")))
    on_screen = F.when(visual, F.concat(F.lit("segment "), number, F.lit(" on screen"))).otherwise(F.concat(F.lit("slide "), number, F.lit(" as shown during the lecture")))
    images = F.concat(F.when(visual, "").otherwise(shown(F.concat(F.lit("slide "), number), F.col("deck_image_path"))), shown(on_screen, F.col("frame_image_path")))
    bare = lambda line: F.concat(F.lit("## "), label, F.lit(" "), number, F.lit("\n"), "__images", F.lit("\n"), line, F.lit("\n"), "__examples")
    titled = F.when(visual, numbered_heading("note.text", "position", "Segment")).otherwise(numbered_heading("note.text", "position", "Slide"))
    under = F.concat(F.regexp_extract("__titled", r"^[^\n]*", 0), F.lit("\n"), "__images", F.regexp_replace("__titled", r"^[^\n]*\n?", ""))
    body = (
        F.when(F.col("note.skipped"), bare(F.lit(SKIPPED)))
        .when(F.col("note.error").isNotNull(), bare(F.concat(F.lit(FAILED[0]), "note.error", F.lit(FAILED[1]))))
        .otherwise(F.concat(F.when(F.col("__images") == "", F.col("__titled")).otherwise(under), F.lit("\n"), "__examples"))
    )
    rows = noted.withColumns({"__images": images, "__titled": titled, "__examples": F.coalesce("examples", F.lit(""))}).withColumn("__body", body)
    lost = F.transform(F.array_sort(F.collect_list(F.when(F.col("note.error").isNotNull(), F.struct("position", "slide_number")))), lambda x: x["slide_number"].cast("string"))
    bodies = F.transform(F.array_sort(F.collect_list(F.struct("position", "__body"))), lambda x: x["__body"])
    rows = rows.groupBy(*keys).agg(bodies.alias("bodies"), lost.alias("lost"))
    if overview is not None:
        rows = rows.join(overview.select(*keys, F.col("text").alias("overview")), list(keys), "left")
    else:
        rows = rows.withColumn("overview", F.lit(None).cast("string"))
    head = F.array_compact(F.array(F.concat(F.lit("# "), "lecture_id", F.lit("\n")), F.when(F.coalesce("overview", F.lit("")) != "", F.concat("overview", F.lit("\n\n---\n")))))
    tail = F.array_compact(F.array(F.when(F.size("lost") > 0, F.concat(F.lit(FAILED_LIST), F.array_join("lost", ", "), F.lit("\n")))))
    return rows.select(*keys, F.array_join(F.concat(head, "bodies", tail), "\n").alias("text"))


def simple_html(documents: DataFrame, text: str = "text") -> DataFrame:
    """Documents with ``html``: headings, emphasis, images, links and paragraphs; formulas pass untouched, and image paths lose their ``../``."""
    rows = documents.withColumn("__lines", F.split(text, "\n"))
    inline = lambda x: F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"!\[([^\]]*)\]\((?:\.\./)*([^)]*)\)", '<img alt="$1" src="$2">'), r"\[([^\]]*)\]\(([^)]*)\)", '<a href="$2">$1</a>'), r"\*\*([^*]+)\*\*", "<strong>$1</strong>")
    mark = lambda x: F.length(F.regexp_extract(x, r"^(#{1,6}) ", 1))
    safe = lambda x: F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    line = lambda x: F.when(mark(x) > 0, F.concat(F.lit("<h"), mark(x).cast("string"), F.lit(">"), inline(safe(F.regexp_replace(x, r"^#{1,6} ", ""))), F.lit("</h"), mark(x).cast("string"), F.lit(">"))).when(F.contains(x, F.lit("$")), F.concat(F.lit("<p>"), safe(x), F.lit("</p>"))).when(F.trim(x) == "", F.lit("")).otherwise(F.concat(F.lit("<p>"), inline(safe(x)), F.lit("</p>")))
    return rows.withColumn("html", F.array_join(F.transform("__lines", line), "\n")).drop("__lines")
