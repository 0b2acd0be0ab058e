"""Decks: pages, pools, distribution and suggestions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import norm, similar_words, strip, title_words
from ..sources.scratch import stored
from .runs import KEYS


def pages_to_slides(pages: DataFrame, keys=KEYS) -> DataFrame:
    """Slides of pages (page_number, text): the first line that isn't blank is the title, the others are the body."""
    lines = F.filter(F.transform(F.split("text", r"\r?\n"), strip), lambda x: x != "")
    rows = pages.withColumn("__lines", F.coalesce(lines, F.array().cast("array<string>")))
    body = F.slice("__lines", F.lit(2), F.greatest(F.size("__lines") - 1, F.lit(0)))
    return rows.select(
        *keys,
        F.col("page_number").cast("int").alias("slide_number"),
        F.coalesce(F.get("__lines", F.lit(0)), F.lit("")).alias("title"),
        F.array_join(body, "\n").alias("body_text"),
        F.lit("").alias("notes_text"),
    )


def shapes_to_slides(shapes: DataFrame, images: DataFrame, keys=KEYS) -> DataFrame:
    """Slides of shapes (slide_number, shape_index, role in title/body/notes, text) with their rendered pages, if there are any.

    Without a title the first line of the first body shape is the title.
    """
    text = strip("text")
    parts = lambda role: F.transform(F.array_sort(F.collect_list(F.when((F.col("role") == role) & (text != ""), F.struct("shape_index", text.alias("text"))))), lambda x: x["text"])
    rows = shapes.groupBy(*keys, "slide_number").agg(parts("title").alias("__t"), parts("body").alias("__b"), parts("notes").alias("__n"))
    fallback = F.get(F.split(F.get("__b", F.lit(0)), "\n"), F.lit(0))
    rows = rows.join(images.select(*keys, "slide_number", "image_path"), [*keys, "slide_number"], "left")
    return rows.select(
        *keys,
        "slide_number",
        F.coalesce(F.get("__t", F.lit(0)), fallback, F.lit("")).alias("title"),
        F.array_join("__b", "\n").alias("body_text"),
        F.array_join("__n", "\n").alias("notes_text"),
        F.coalesce("image_path", F.lit("")).alias("image_path"),
    )


def deduplicate_pool(pages: DataFrame, text: str = "text", order=("file", "page_number")) -> DataFrame:
    """``pages`` with ``kept``: of pages with one normalized text the first; pages without text are all kept.

    Pages without text never meet in one group.
    """
    own = norm(text)
    same = F.when(own == "", F.concat(F.lit("page "), F.md5(F.concat_ws("|", *order)))).otherwise(F.md5(own))
    rows = pages.withColumn("__same", same)
    first = rows.groupBy("__same").agg(F.min(F.struct(*order)).alias("__first"))
    return rows.join(first, "__same").withColumn("kept", (own == "") | (F.struct(*order) == F.col("__first"))).drop("__same", "__first")


def pool_report(marked: DataFrame) -> DataFrame:
    """(scanned, kept, duplicates_skipped) of a marked pool."""
    return marked.agg(F.count("*").alias("scanned"), F.count_if("kept").alias("kept")).withColumn("duplicates_skipped", F.col("scanned") - F.col("kept"))


def distribute(deck: DataFrame, lectures: DataFrame) -> DataFrame:
    """Every slide of one deck for every lecture."""
    return lectures.select("lecture_id").crossJoin(deck.drop("lecture_id"))


def resolve_decks(files: DataFrame, keys=KEYS) -> DataFrame:
    """The deck of each lecture among files (path): a pptx before a pdf."""
    kind = F.lower(F.regexp_extract("path", r"\.([^.]+)$", 1))
    rank = F.when(kind == "pptx", 0).when(kind == "pdf", 1)
    return files.withColumn("__rank", rank).where("__rank is not null").groupBy(*keys).agg(F.min_by("path", F.struct("__rank", "path")).alias("path"))


def vocabulary_prompt(slides: DataFrame, chars: int = 700, longest: int = 80, order="slide_number", keys=KEYS) -> DataFrame:
    """(keys, prompt): distinct short titles in the order of their first slides, cut to ``chars``."""
    rows = slides.withColumn("title", strip("title")).where((F.col("title") != "") & (F.length("title") < longest))
    first = rows.groupBy(*keys, "title").agg(F.min(order).alias("__at"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("__at", "title"))), lambda x: x["title"])
    return first.groupBy(*keys).agg(F.left(F.array_join(listed, ", "), F.lit(chars)).alias("prompt"))


def preview_text(pages: DataFrame, count: int = 2, keys=("deck",)) -> DataFrame:
    """(keys, preview): the text of a deck's first pages."""
    rows = pages.where(F.col("page_number") <= count)
    return rows.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_number", "text"))), lambda x: F.coalesce(x["text"], F.lit(""))), " ").alias("preview"))


LEAST_ALIKE = 0.85


def word_pieces(words: DataFrame, name: str, other: bool) -> DataFrame:
    """(name, m, n, i, piece): what two words of n and m letters that are alike have in common, looked at from one of them.

    Letters outside the matching blocks are edits, one each: at most 0.15 (m + n), and odd in number if m + n is. The word of
    m letters (``other``) is cut into one piece more than that, so one of the pieces is untouched. In the word of n letters it
    stands at most so far from its own place that the edits on both sides suffice for the shift before it and the rest of the
    difference in length after it.
    """
    size, least = F.length(name), LEAST_ALIKE
    reach = F.sequence(F.ceil(size * (least / (2 - least)) - 1e-9).cast("int"), F.floor(size * ((2 - least) / least) + 1e-9).cast("int"))
    rows = words.where(F.length(name) > 0).select(name, F.explode(reach).alias("partner"))
    rows = rows.select(name, (size if other else F.col("partner")).alias("m"), (F.col("partner") if other else size).alias("n"))
    rows = rows.withColumn("most", F.floor((F.col("m") + F.col("n")) * (1 - least) + 1e-9).cast("int"))
    rows = rows.withColumn("most", F.col("most") - F.pmod(F.col("m") + F.col("n") - F.col("most"), F.lit(2))).where("most > 0 and abs(m - n) <= most")
    rows = rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("most"))))
    cut = lambda i: F.floor(i * F.col("m") / (F.col("most") + 1)).cast("int")
    rows = rows.withColumn("start", cut(F.col("i"))).withColumn("letters", cut(F.col("i") + 1) - F.col("start")).where("letters > 0")
    if not other:
        longer = F.col("n") - F.col("m")
        shifts = F.sequence(F.ceil((longer - F.col("most")) / 2).cast("int"), F.floor((longer + F.col("most")) / 2).cast("int"))
        rows = rows.withColumn("start", F.explode(F.transform(shifts, lambda x: F.col("start") + x))).where("start >= 0 and start + letters <= n")
    found = rows.select(name, "m", "n", "i", F.substr(name, F.col("start") + 1, F.col("letters")).alias("piece"))
    return found if other else found.distinct()


def alike_words(words: DataFrame, others: DataFrame) -> DataFrame:
    """(word, other) of distinct words: equal ones, and those at least 0.85 alike.

    Of two words that much alike at most 0.15 of all letters lie outside their matching blocks, and so many edits make one
    of the other. Pairs therefore share a piece of known length at nearly the same place (``word_pieces``); they are joined by it,
    held against their edit distance, and only then compared. The pieces of ``words``, the fewer ones, are stored, so that the join
    knows their size: while they are few, those of ``others`` are made where their words are and never sent.
    """
    pieces = stored(word_pieces(words, "word", False), "pieces")
    near = word_pieces(others, "other", True).join(pieces, ["m", "n", "i", "piece"]).where("word <> other")
    near = near.where(F.levenshtein("word", "other") <= (F.col("m") + F.col("n")) * (1 - LEAST_ALIKE) + 1e-9).select("word", "other").distinct()
    return words.join(others, F.col("word") == F.col("other")).select("word", "other").union(near.where(similar_words("word", "other")))


def suggest_lectures(decks: DataFrame, lectures: DataFrame, least: float = 0.5, top: int = 3, fuzzy: bool = True) -> DataFrame:
    """(deck, lecture_id, score) of the ``top`` lectures whose title words a deck's preview has, or words alike.

    Words alike are found among distinct words, once. Previews are dealt by deck before they are cut into words: a deck's words
    meet the titles, are counted and ranked where they are, and neither words nor pairs are sent on.
    """
    words = lectures.select("lecture_id", F.explode(title_words("title")).alias("word"))
    sizes = words.groupBy("lecture_id").agg(F.count("*").alias("__n"))
    counted = words.groupBy("lecture_id", "word").agg(F.count("*").alias("__times")).join(sizes, "lecture_id")
    cut = lambda rows: rows.select("deck", F.explode(F.array_distinct(title_words("preview"))).alias("other"))
    flat = cut(decks.select("deck", "preview").repartition("deck"))
    if fuzzy:
        # Stored, so that the join knows how few they are.
        alike = stored(alike_words(words.select("word").distinct(), cut(decks).select("other").distinct()), "alike")
        has = flat.join(alike, "other").select("deck", "word").distinct()
    else:
        has = flat.withColumnRenamed("other", "word")
    hits = has.join(counted, "word").groupBy("deck", "lecture_id", "__n").agg(F.sum("__times").alias("__hits"))
    scored = hits.select("deck", "lecture_id", F.round(F.col("__hits") / F.col("__n"), 3).alias("score")).where(F.col("score") >= least)
    best = Window.partitionBy("deck").orderBy(F.desc("score"), "lecture_id")
    return scored.withColumn("place", F.row_number().over(best)).where(F.col("place") <= top)


def exam_pages(pages: DataFrame, least_chars: int = 50) -> DataFrame:
    """Pages (source, page_number, text) with ``render``: whether so little text means a scan that must be rendered."""
    return pages.withColumn("render", F.length(strip(F.coalesce(F.col("text"), F.lit("")))) < least_chars)
