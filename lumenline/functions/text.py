"""Text functions. All but ``fold_diacritics`` and ``similar_words`` are built-in expressions."""

from __future__ import annotations

import difflib
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The cues of a worked example, folded, in the order in which they are reported.
EXAMPLE_CUES = (
    "primer",
    "na primer",
    "recimo",
    "zadatak",
    "vezb",
    "uradimo",
    "izracunajmo",
    "posmatrajmo",
    "example",
    "for example",
    "let's work",
    "worked example",
    "exercise",
    "suppose",
)
#: Fixed value: wording of slides that are examples themselves.
EXAMPLE_SLIDE = "(?iu)primer|zadatak|vežb|vezb|example|exercise"
#: What stages print about their progress.
PROGRESS = {
    "download": r"\[download\]\s+(\d+(?:\.\d+)?)%",
    "spoken": r"\[\s*([\d.]+)\s*->\s*([\d.]+)\s*\]",
    "clocked": r"-->\s*(?:(\d+):)?(\d+):(\d+(?:\.\d+)?)\]",
    "event": r"\[event\s+\d+\]\s+t=\s*([\d.]+)s",
    "ocr": r"\[ocr\s+(\d+)/(\d+)\]",
    "slide": r"\[(\d+)/(\d+)\]\s+slide",
    "example": r"\[(\d+)/(\d+)\]\s+example",
    "lecture": r"\[(\d+)/(\d+)\]\s+lecture",
    "exam": r"\[(\d+)/(\d+)\]\s+exam",
}
#: Fixed value: the line between a paper and its key.
ANSWER_KEY = "<<<ANSWER_KEY>>>"


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once in a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(col(text), r"(?U)^\s+|\s+$", "")


def norm(text) -> Column:
    """Lower case, runs of white space as one space, none at the ends; null is empty."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(col(text), F.lit(""))), r"(?U)\s+", " "))


@F.pandas_udf(T.StringType())
def fold_diacritics(text: pd.Series) -> pd.Series:
    """Compatibility decomposition without combining marks; case stays, null is empty."""

    def fold(x):
        if not x or x.isascii():
            return x or ""
        return "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c))

    return text.map(fold, na_action=None)


def fold(text) -> Column:
    return F.lower(fold_diacritics(col(text)))


def title_words(text) -> Column:
    words = F.split(F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(col(text), F.lit(""))), r"(?U)[^\w\s]", " "), r"(?U)\s+", " ")), " ")
    return F.filter(words, lambda w: w != "")


def ocr_words(folded) -> Column:
    """Words with apostrophes of a text that is folded already."""
    return F.regexp_extract_all(F.coalesce(col(folded), F.lit("")), F.lit(r"(?U)[\w']+"), 0)


def overlap_ratio(reference, frame) -> Column:
    """Share of the reference's distinct words that the frame has; 1 for an empty reference. Both are folded."""
    return let(F.array_distinct(ocr_words(reference)), lambda r: F.when(F.size(r) == 0, 1.0).otherwise(F.size(F.array_intersect(r, ocr_words(frame))) / F.size(r)))


def novel_ratio(deck, frame, excerpt_chars: int = 150) -> Column:
    """Share of the frame's distinct words that the deck lacks; 1 for an empty frame.

    A frame text that was cut to ``excerpt_chars`` loses its last word, which may be half a word.
    """
    text = F.coalesce(col(frame), F.lit(""))
    cut = lambda w: F.when((F.length(text) >= excerpt_chars - 1) & (F.size(w) > 1), F.slice(w, F.lit(1), F.size(w) - 1)).otherwise(w)
    own = lambda w: F.array_distinct(cut(w))
    return let(ocr_words(text), lambda w: let(own(w), lambda f: F.when(F.size(f) == 0, 1.0).otherwise(F.size(F.array_except(f, ocr_words(deck))) / F.size(f))))


def hamming(a, b) -> Column:
    """Differing bits of two 64-bit hashes held in two's complement."""
    return F.bit_count(col(a).bitwiseXOR(col(b)))


def difference_hash(gray, width: int = 9, height: int = 8) -> Column:
    """Row by row, a bit for each pixel that is brighter than its right neighbour, first bit highest."""
    step = width - 1
    places = F.sequence(F.lit(0), F.lit(step * height - 1))
    left = lambda i: F.floor(i / step).cast("int") * width + i % step
    bit = lambda i: F.when(F.get(col(gray), left(i)) > F.get(col(gray), left(i) + 1), F.lit(1)).otherwise(F.lit(0)).cast("long")
    return F.aggregate(places, F.lit(0).cast("long"), lambda acc, i: F.shiftleft(acc, 1).bitwiseOR(bit(i)))


def cue_hits(folded) -> Column:
    return F.array_compact(F.array(*[F.when(F.contains(col(folded), F.lit(c)), F.lit(c)) for c in EXAMPLE_CUES]))


def clock(seconds) -> Column:
    """M:SS, or H:MM:SS from an hour on."""
    whole = F.bround(col(seconds), 0).cast("long")
    return let(whole, lambda s: F.when(s >= 3600, F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)).otherwise(F.format_string("%d:%02d", F.floor(s / 60), s % 60)))


def note_image_path(path) -> Column:
    return F.concat(F.lit("../"), F.regexp_replace(col(path), "^[^/]+/", ""))


def embedded_json(text) -> Column:
    """The JSON object of a model's answer: fenced, or from the first to the last brace, or the answer itself."""
    whole = strip(text)
    fenced = F.regexp_extract(whole, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    braces = F.regexp_extract(whole, r"(?s)\{.*\}", 0)
    return F.when(fenced != "", fenced).when(braces != "", braces).otherwise(whole)


def parse_verdict(text) -> Column:
    """STRUCT<is_example, kind, caption, confidence>, null where the answer has no such object."""
    value = lambda key, kind: F.try_variant_get(F.try_parse_json(embedded_json(text)), f"$.{key}", kind)
    shown = value("is_example", "string")
    truth = F.coalesce(value("is_example", "boolean"), value("is_example", "double") != 0, F.length(shown) > 0, F.lit(False))
    known = F.contains(F.regexp_replace(embedded_json(text), r"\s+", ""), F.lit('"is_example":')) & F.try_parse_json(embedded_json(text)).isNotNull()
    return F.when(
        known,
        F.struct(
            truth.alias("is_example"),
            F.coalesce(F.nullif(value("kind", "string"), F.lit("")), F.lit("annotated_slide")).alias("kind"),
            strip(F.coalesce(value("caption", "string"), F.lit(""))).alias("caption"),
            F.coalesce(value("confidence", "double"), F.lit(0.0)).alias("confidence"),
        ),
    )


def split_exam(text) -> Column:
    """STRUCT<paper, key>; without the marker the paper is the text as it is, and the key null."""
    parts = F.split(col(text), r"\n*" + ANSWER_KEY + r"\n*", 2)
    return F.when(F.size(parts) == 2, F.struct(strip(F.get(parts, 0)).alias("paper"), strip(F.get(parts, 1)).alias("key"))).otherwise(F.struct(col(text).alias("paper"), F.lit(None).cast("string").alias("key")))


def numbered_heading(note, number, label: str = "Slide") -> Column:
    """The note with ``label number:`` in its first heading, if that is a heading without it."""
    head = F.regexp_extract(col(note), r"^[^\n]*", 0)
    title = strip(F.substring(head, 4, 1_000_000))
    shown = F.concat(F.lit(f"{label} "), col(number).cast("string"))
    has = F.regexp_like(title, F.concat(F.lit(r"(?U)^" + label + r"\s+"), col(number).cast("string"), F.lit(r"\b")))
    rest = F.regexp_replace(col(note), r"^[^\n]*", "")
    rest = F.when(rest == "\n", "").otherwise(rest)
    return F.when(head.startswith("## ") & ~has, F.concat(F.lit("## "), shown, F.lit(": "), title, rest)).otherwise(col(note))


def chunk_seconds(size, duration, upload_cap, safety: float = 0.85, least: float = 60.0) -> Column:
    """Seconds of audio that stay under the upload cap, from the file's own bytes by second."""
    size, duration = col(size), col(duration)
    fits = F.greatest(F.lit(least), col(upload_cap) * safety / (size / F.nullif(duration, F.lit(0.0))))
    return F.when((size <= 0) | (duration <= 0), F.greatest(duration, F.lit(least))).otherwise(fits)


def progress_share(stage, line, duration) -> Column:
    """How much of a stage a line of its output reports, from 0 to 1; null where it reports nothing."""
    stage, line, duration = col(stage), col(line), col(duration)
    number = lambda name, group=1: F.regexp_extract(line, PROGRESS[name], group).try_cast("double")
    counted = lambda name: number(name, 1) / F.nullif(number(name, 2), F.lit(0.0))
    of_duration = lambda seconds: F.when(duration > 0, F.least(seconds / duration, F.lit(1.0)))
    clocked = F.coalesce(number("clocked", 1), F.lit(0.0)) * 3600 + number("clocked", 2) * 60 + number("clocked", 3)
    return (
        F.when(stage == 0, number("download") / 100)
        .when(stage == 1, of_duration(F.coalesce(number("spoken", 2), clocked)))
        .when(stage == 3, of_duration(number("event")))
        .when(stage == 4, counted("ocr"))
        .when(stage == 6, F.coalesce(counted("slide"), counted("example")))
        .when(stage == 9, counted("lecture"))
        .when(stage == 11, counted("exam"))
    )


def masked(secret) -> Column:
    return F.when(F.coalesce(col(secret), F.lit("")) == "", "").otherwise(F.concat(F.left(col(secret), F.lit(10)), F.lit("…")))


def valid_setting(value, longest: int = 4000) -> Column:
    return ~F.regexp_like(col(value), F.lit(r"[\x00-\x1f\x7f]")) & (F.length(col(value)) <= longest)


def chunk_prompt(vocabulary, tail) -> Column:
    return F.concat_ws(" ", F.nullif(col(vocabulary), F.lit("")), F.nullif(col(tail), F.lit("")))


@F.pandas_udf(T.BooleanType())
def similar_words(word: pd.Series, other: pd.Series) -> pd.Series:
    """Whether two words are at least 0.85 alike, by matching blocks."""
    return pd.Series([bool(difflib.get_close_matches(w, [o], n=1, cutoff=0.85)) for w, o in zip(word, other, strict=True)])


MATH = r"(?s)\$\$.*?\$\$|\$[^$\n]+\$"


def stashed_math(text) -> Column:
    """Text in which formulas are held apart from markup: STRUCT<text, formulas>, with @@n@@ between NULs in their places."""
    formulas = F.regexp_extract_all(col(text), F.lit(MATH), 0)
    parts = F.split(col(text), MATH)
    mark = lambda i: F.concat(F.lit("\0@@"), i.cast("string"), F.lit("@@\0"))
    joined = F.array_join(F.transform(parts, lambda p, i: F.when(i < F.size(parts) - 1, F.concat(p, mark(i))).otherwise(p)), "")
    return F.struct(joined.alias("text"), formulas.alias("formulas"))


def restored_math(text, formulas) -> Column:
    """The formulas back in their places, each in one go over the pieces between the marks; a mark without a formula is left out."""
    pieces = F.split(col(text), "\0@@")
    number = lambda x: F.regexp_extract(x, "^([0-9]+)@@\0", 1).try_cast("int")
    put = lambda x: F.concat(F.coalesce(F.get(col(formulas), number(x)), F.lit("")), F.regexp_replace(x, "^[0-9]+@@\0", ""))
    return F.array_join(F.transform(pieces, lambda x, i: F.when(i == 0, x).otherwise(put(x))), "")


def luminance(red, green, blue) -> Column:
    """Gray of 0 to 255."""
    return F.round(col(red) * 0.299 + col(green) * 0.587 + col(blue) * 0.114).cast("int")


def area_resized(pixels, width, height, to_width: int = 320) -> Column:
    """One channel, row by row, at a new width and the height in proportion (1 at least): each pixel is the mean of the area it covers."""
    pixels, w, h = col(pixels), col(width), col(height)
    to_height = F.greatest(F.bround(h * F.lit(to_width) / w).cast("int"), F.lit(1))
    step_x, step_y = w / F.lit(float(to_width)), h / to_height.cast("double")

    def overlap(i, place, step):
        return F.greatest(F.least(i + 1.0, (place + 1) * step) - F.greatest(i * 1.0, place * step), F.lit(0.0))

    def covered(place, step, size):
        return F.sequence(F.floor(place * step).cast("int"), F.least(F.ceil((place + 1) * step).cast("int"), size) - 1)

    def mean(at):
        x, y = at % to_width, F.floor(at / to_width).cast("int")
        row = lambda j: F.aggregate(covered(x, step_x, w), F.lit(0.0), lambda acc, i: acc + F.get(pixels, j * w + i) * overlap(i, x, step_x))
        return F.aggregate(covered(y, step_y, h), F.lit(0.0), lambda acc, j: acc + row(j) * overlap(j, y, step_y)) / (step_x * step_y)

    return F.transform(F.sequence(F.lit(0), to_height * to_width - 1), mean)
