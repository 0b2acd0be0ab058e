"""Markdown documents as HTML, line by line with windows: what a line opens and closes follows from the lines around it.

Blocks: headings, rules, paragraphs, quotes, fenced code, tables, and lists of both kinds that nest by four spaces (a tab counts as four).
Inline: code, images, links, strong and emphasis; HTML passes as it is, other signs are escaped. Formulas are held apart
before anything else and put back last, so no markup touches them. Lists stay open over blank lines, a fence that is never closed
is text, and a table begins with a row of titles over a row of dashes. A document is ordered by the lines of one value; its lines are
rows, so its length costs no more than sorting.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import restored_math, stashed_math

FENCE, HEADING, RULE = r"^\s{0,3}(```|~~~)", r"^ {0,3}(#{1,6})\s+(.*?)\s*#*\s*$", r"^ {0,3}((\*\s*){3,}|(-\s*){3,}|(_\s*){3,})$"
ITEM, QUOTE, DASHES = r"^(\s*)([-*+]|[0-9]+[.])\s+(.*)$", r"^ {0,3}>\s?(.*)$", r"^\s*\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)+\|?\s*$|^\s*\|\s*:?-+:?\s*\|\s*$"
HTML = r"^ {0,3}</?(div|p|table|img|ul|ol|pre|h[1-6]|hr|section|details|summary)\b"
DEEPEST = 6
CODE = "`([^`]+)`"


def escaped(text: Column) -> Column:
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    return F.replace(F.replace(out, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def inline(text: Column) -> Column:
    """Markup within a line; code spans are held apart while the rest is done."""
    spans = F.regexp_extract_all(text, F.lit(CODE), 1)
    out = F.regexp_replace(text, CODE, "\0c\0")
    out = F.regexp_replace(out, r"&(?!#?\w+;)", "&amp;")
    out = F.regexp_replace(out, r"<(?![A-Za-z/!])", "&lt;")
    out = F.regexp_replace(out, r"!\[([^\]]*)\]\(([^)\s]*)\)", '<img alt="$1" src="$2" />')
    out = F.regexp_replace(out, r"\[([^\]]*)\]\(([^)\s]*)\)", '<a href="$2">$1</a>')
    out = F.regexp_replace(out, r"\*\*(\S(?:.*?\S)?)\*\*", "<strong>$1</strong>")
    out = F.regexp_replace(out, r"\*(\S(?:[^*]*?\S)?)\*", "<em>$1</em>")
    out = F.regexp_replace(out, r"(?<![\w=\"/])__(\S(?:.*?\S)?)__(?!\w)", "<strong>$1</strong>")
    out = F.regexp_replace(out, r"(?<![\w=\"/])_(\S(?:[^_]*?\S)?)_(?!\w)", "<em>$1</em>")
    put = lambda piece, i: F.when(i == 0, piece).otherwise(F.concat(F.lit("<code>"), escaped(F.get(spans, i - 1)), F.lit("</code>"), piece))
    return F.array_join(F.transform(F.split(out, "\0c\0"), put), "")


def cells(line: Column, tag: str) -> Column:
    inner = F.regexp_replace(F.trim(line), r"^\||\|$", "")
    return F.concat(F.lit("<tr>\n"), F.array_join(F.transform(F.split(inner, r"\|"), lambda c: F.concat(F.lit(f"<{tag}>"), inline(F.trim(c)), F.lit(f"</{tag}>"))), "\n"), F.lit("\n</tr>"))


def lines_of(documents: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """(keys, at, line, kind, level, mark, body, block): the lines with their kinds, and the number of the block that each is in."""
    rows = documents.select(*keys, F.posexplode(F.split(F.coalesce("__stashed.text", F.lit("")), "\r?\n")).alias("at", "line"))
    by = Window.partitionBy(*keys).orderBy("at")
    upto, whole = by.rowsBetween(Window.unboundedPreceding, Window.currentRow), Window.partitionBy(*keys)
    rows = rows.withColumn("f", F.regexp_like("line", F.lit(FENCE)).cast("int"))
    rows = rows.withColumns({"n": F.sum("f").over(upto), "all": F.sum("f").over(whole)})
    fenced = (F.col("all") % 2 == 0) | (F.col("n") < F.col("all"))
    rows = rows.withColumn("f", F.col("f") * fenced.cast("int"))
    code = fenced & ((F.col("n") - F.col("f")) % 2 == 1) & (F.col("f") == 0)
    kind = (
        F.when((F.col("f") == 1) & (F.col("n") % 2 == 1), "open").when(F.col("f") == 1, "close").when(code, "code").when(F.trim("line") == "", "blank")
        .when(F.regexp_like("line", F.lit(HEADING)), "heading").when(F.regexp_like("line", F.lit(RULE)), "rule").when(F.regexp_like("line", F.lit(ITEM)), "item")
        .when(F.regexp_like("line", F.lit(QUOTE)), "quote").when(F.regexp_like("line", F.lit(HTML)), "html").when(F.contains("line", F.lit("|")), "row").otherwise("text")
    )
    rows = rows.withColumn("kind", kind).withColumn("dashes", (F.col("kind") == "row") & F.regexp_like("line", F.lit(DASHES)))
    # Rows are a table if the second of them is dashes; otherwise they are text.
    begins = (F.col("kind") == "row") & ~F.coalesce(F.lag("kind").over(by) == "row", F.lit(False))
    rows = rows.withColumn("t", F.sum(begins.cast("int")).over(upto)).withColumn("second", F.lead("dashes").over(by))
    table = Window.partitionBy(*keys, "t", "kind").orderBy("at")
    rows = rows.withColumn("nth", F.row_number().over(table)).withColumn("tabular", F.first("second").over(table.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    rows = rows.withColumn("kind", F.when((F.col("kind") == "row") & ~F.coalesce("tabular", F.lit(False)), "text").otherwise(F.col("kind")))
    # A text line right after an item goes on with it; blank lines between items don't end a list.
    group = F.last(F.when(~F.col("kind").isin("text"), F.col("kind")), ignorenulls=True).over(upto)
    rows = rows.withColumn("kind", F.when((F.col("kind") == "text") & (group == "item"), "more").otherwise(F.col("kind")))
    shown = F.when(F.col("kind").isin("item", "more"), "list").when(F.col("kind").isin("blank"), F.lit(None)).otherwise(F.col("kind"))
    rows = rows.withColumn("shown", shown)
    before, gap = F.last("shown", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.coalesce(F.lag("kind").over(by) == "blank", F.lit(False))
    same = before.eqNullSafe(F.col("shown")) & F.col("shown").isin("list", "text", "quote", "row") & ((F.col("shown") == "list") | ~gap)
    rows = rows.withColumn("new", F.when(F.col("shown").isNotNull() & ~same, 1).otherwise(0)).withColumn("block", F.sum("new").over(upto))
    spaces = F.length(F.replace(F.regexp_extract("line", ITEM, 1), F.lit("\t"), F.lit("    ")))
    level = F.when(F.col("kind") == "item", F.least(F.floor(spaces / 4), F.lit(DEEPEST - 1)).cast("int"))
    mark = F.when(F.regexp_like(F.regexp_extract("line", ITEM, 2), F.lit("[0-9]")), "ol").otherwise("ul")
    body = F.when(F.col("kind") == "item", F.regexp_extract("line", ITEM, 3)).when(F.col("kind") == "quote", F.regexp_extract("line", QUOTE, 1)).otherwise(F.col("line"))
    return rows.where("shown is not null").select(*keys, "at", "line", "kind", "shown", "nth", "dashes", level.alias("level"), mark.alias("mark"), body.alias("body"), "block")


def rendered(documents: DataFrame, text: str = "text", keys: tuple[str, ...] = ("name",)) -> DataFrame:
    """``documents``, of which ``keys`` name each, with ``html``; a document without text has empty HTML."""
    keys = list(keys)
    stashed = documents.withColumn("__stashed", stashed_math(F.coalesce(F.col(text), F.lit(""))))
    rows = lines_of(stashed, text, keys)
    own = Window.partitionBy(*keys, "block").orderBy("at")
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    first, last = F.row_number().over(own) == 1, F.lead("at").over(own).isNull()
    # Which lists are open before an item, and after it: at each depth the last item that is no deeper, if it is as deep.
    listed = F.struct("level", "mark")
    for depth in range(DEEPEST):
        item = F.when(F.col("level") <= depth, listed)
        was, now = F.last(item, ignorenulls=True).over(before), F.last(item, ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        rows = rows.withColumns({f"was{depth}": F.when(was["level"] == depth, was["mark"]), f"now{depth}": F.when(now["level"] == depth, now["mark"])})
    rows = rows.withColumns({"first": first, "last": last, "next": F.coalesce(F.lead("kind").over(own), F.lit(""))})
    close = lambda mark: F.concat(F.lit("</li>\n</"), mark, F.lit(">\n"))
    shut = lambda depths, name: F.concat(F.lit(""), *(F.coalesce(F.when(ok, close(F.col(f"{name}{d}"))), F.lit("")) for d, ok in depths))
    deeper = shut([(d, F.col(f"was{d}").isNotNull() & (F.col("level") < d)) for d in reversed(range(DEEPEST))], "was")
    at_level = F.coalesce(*(F.when(F.col("level") == d, F.col(f"was{d}")) for d in range(DEEPEST)))
    start = F.when(at_level.isNull(), F.concat(F.lit("<"), F.col("mark"), F.lit(">\n<li>"))).when(at_level == F.col("mark"), F.lit("</li>\n<li>")).otherwise(F.concat(close(at_level), F.lit("<"), F.col("mark"), F.lit(">\n<li>")))
    end = F.when(F.col("last"), F.rtrim(shut([(d, F.col(f"now{d}").isNotNull()) for d in reversed(range(DEEPEST))], "now"), F.lit("\n"))).otherwise("")
    around = lambda content, tag: F.concat(F.when(F.col("first"), f"<{tag}>").otherwise(""), content, F.when(F.col("last"), f"</{tag}>").otherwise(""))
    hashes = F.length(F.regexp_extract("line", HEADING, 1)).cast("string")
    language = F.regexp_extract("line", r"^\s{0,3}(?:```|~~~)\s*([\w+-]+)", 1)
    body_rows = F.when(F.col("nth") == 1, F.concat(F.lit("<table>\n<thead>\n"), cells(F.col("line"), "th"), F.lit("\n</thead>"))).when(F.col("dashes"), "<tbody>").otherwise(cells(F.col("line"), "td"))
    kind = F.col("kind")
    html = (
        F.when(kind == "heading", F.concat(F.lit("<h"), hashes, F.lit(">"), inline(F.regexp_extract("line", HEADING, 2)), F.lit("</h"), hashes, F.lit(">")))
        .when(kind == "rule", "<hr />")
        .when(kind == "open", F.concat(F.lit("<pre><code"), F.when(language != "", F.concat(F.lit(' class="language-'), language, F.lit('"'))).otherwise(""), F.lit(">")))
        .when(kind == "code", F.concat(escaped(F.col("line")), F.lit("\n")))
        .when(kind == "close", "</code></pre>")
        .when(kind == "item", F.concat(deeper, start, inline(F.col("body")), end))
        .when(kind == "more", F.concat(inline(F.trim("body")), end))
        .when(kind == "row", F.concat(body_rows, F.when(F.col("last"), "\n</tbody>\n</table>").otherwise("")))
        .when(kind == "quote", F.concat(F.when(F.col("first"), "<blockquote>\n<p>").otherwise(""), inline(F.col("body")), F.when(F.col("last"), "</p>\n</blockquote>").otherwise("")))
        .when(kind == "html", F.col("line"))
        .otherwise(around(inline(F.trim("line")), "p"))
    )
    # Code lines carry their own ends, so that blank ones stay; an item begins with the end of the one before it.
    glue = F.when(kind.isin("open", "code") | (F.col("next") == "item"), "").otherwise("\n")
    parts = rows.select(*keys, F.struct("at", F.concat(html, glue).alias("html")).alias("part")).groupBy(*keys).agg(F.array_sort(F.collect_list("part")).alias("__parts"))
    joined = F.rtrim(F.array_join(F.transform("__parts", lambda p: p["html"]), ""), F.lit("\n"))
    out = stashed.join(parts, keys, "left").withColumn("html", restored_math(F.coalesce(joined, F.lit("")), "__stashed.formulas"))
    return out.drop("__stashed", "__parts")


def preview_sources(html: str | Column) -> Column:
    """HTML for the browser: relative image paths are those of the files' mount; links within the page stay."""
    return F.regexp_replace(html, r'src="(?!/|https?:|data:)', 'src="/files/')


def printed_sources(html: str | Column, folder: str) -> Column:
    """HTML for printing from ``folder``: relative image paths become absolute, those of the folder above too."""
    above = folder.rstrip("/").rsplit("/", 1)[0]
    upward = F.replace(F.col(html) if isinstance(html, str) else html, F.lit('src="../'), F.lit(f'src="{above}/'))
    return F.regexp_replace(upward, r'src="(?!/|file:|https?:)', f'src="{folder.rstrip("/")}/')
