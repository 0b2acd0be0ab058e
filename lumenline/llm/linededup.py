"""Line deduplication by a deletion-neighbourhood join, in DataFrame functions only.

Lines are duplicates if one edit (a character replaced, inserted or removed) or none turns one into the
other; a line goes if an earlier one is such a duplicate. Every line's variants with one character deleted
are hashed keys: lines that differ by a replacement share the variant with that place deleted, and a line
that lacks a character equals a variant of the other. Pairs found are verified by their edit distance.

Only lines that can have a near line emit variants. One edit leaves the first or the last half of the
shorter line as it is, so lines are first joined on hashed halves, and those with a partner emit the
variants of the other half. The texts of these lines are fetched in a second pass over the documents,
which a broadcast of at most 2^20 hash buckets keeps from shuffling the rest.

The rows of a line that stands very often are not sent to one task: such lines are few by their share of all
lines, so what is known of them is broadcast.

Order is (doc_id, line number), for a doc_id of any type that has an order; a null doc_id comes first, and rows
with one doc_id come by their text's hash. Repeated rows are one document and get the same result. Lines shorter
than ``min_chars`` are not compared by edits; they go as exact repeats if they have ``exact_chars`` characters at
least, and else always stay. The query and the stage take exact repeats of every line that is not empty.
Lines are compared as they are, without case folding. A text is rebuilt in one pass over its lines, however many
they are; one whose lines all go is left empty and its row stays. Null texts stay null and have no lines. Other
columns are passed on, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import let
from .common import discard, drop_shuffles, join_split, materialize, read

BUCKETS = 1 << 20


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").alias("__id"), F.xxhash64("text").alias("__text_hash"), "text")


def lines_of(docs: DataFrame, min_chars: int) -> DataFrame:
    """(__id, __text_hash, no, line) of the lines that are long enough."""
    rows = keyed(docs).select("__id", "__text_hash", F.posexplode(F.split("text", "\n")).alias("no", "line"))
    return rows.where(F.length("line") >= min_chars)


def half_keys(line: Column, length: Column) -> Column:
    """Hashes of the first and the last half, for either length that the shorter line of a pair can have: p(L - 1), s(L - 1), p(L), s(L)."""
    keys = []
    for m in (length - 1, length):
        cut = F.floor(m / 2).cast("int")
        keys += [F.xxhash64(F.lit(side), m, part(line, cut)) for side, part in (("p", F.left), ("s", F.right))]
    return F.array(*keys)


def near_lines(docs: DataFrame, distinct: DataFrame, min_chars: int) -> tuple[DataFrame, DataFrame]:
    """(hash, near): the first place of the earliest line that one edit makes of the line, if that is earlier than its own.

    And the table of lines that it is made from.
    """
    keys = distinct.select("hash", F.posexplode("halves").alias("half", "key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    partners = keys.join(shared, "key", "left_semi").groupBy("hash").agg(F.collect_set("half").alias("halves"))
    partners = materialize(partners, "partners")
    buckets = partners.select(F.pmod("hash", F.lit(BUCKETS)).alias("bucket")).distinct()
    found = lines_of(docs, min_chars).select(F.xxhash64("line").alias("hash"), "line")
    found = found.join(F.broadcast(buckets), F.pmod("hash", F.lit(BUCKETS)) == F.col("bucket"), "left_semi")
    found = found.groupBy("hash").agg(F.first("line").alias("line"))
    texts = found.join(partners, "hash").join(distinct.select("hash", "first"), "hash").withColumn("length", F.length("line"))
    texts = materialize(texts, "near-texts")
    discard(partners)

    cut = lambda k: F.floor((F.col("length") - 1 + F.floor(k / 2)) / 2).cast("int")
    places = F.transform("halves", lambda k: F.when(k % 2 == 0, F.sequence(cut(k), F.col("length") - 1)).otherwise(F.sequence(F.lit(0), F.col("length") - cut(k) - 1)))
    spread = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    variants = texts.repartition(spread, "hash").select("hash", "first", "length", "line", F.explode(F.array_distinct(F.flatten(places))).alias("at"))
    deleted = F.xxhash64(F.concat(F.left("line", F.col("at")), F.right("line", F.col("length") - F.col("at") - 1)))
    variants = variants.select(deleted.alias("variant"), F.col("length").alias("whole"), "at", "hash", "first")
    own = texts.select(F.col("hash").alias("variant"), (F.col("length") + 1).alias("whole"), F.lit(-1).alias("at"), "hash", "first")
    # Lines that share a variant at one place differ in that place's character: such groups are bounded by the alphabet.
    other = F.struct("first", "hash")
    by_place = Window.partitionBy("variant", "whole", "at")
    by_variant = Window.partitionBy("variant", "whole")
    pairs = (
        variants.union(own)
        .repartition("variant", "whole")  # serves both windows
        .withColumn("replaced", F.when(F.col("at") >= 0, F.min(other).over(by_place)))
        .withColumn("lacking", F.when(F.col("at") >= 0, F.min(F.when(F.col("at") < 0, other)).over(by_variant)))
        .withColumn("having", F.when(F.col("at") < 0, F.min(F.when(F.col("at") >= 0, other)).over(by_variant)))
        .select("hash", "first", F.explode(F.array("replaced", "lacking", "having")).alias("other"))
        .where("other.first < first")
        .select("hash", "other.first", F.col("other.hash").alias("other"))
        .distinct()
    )
    one = texts.select("hash", "line")
    two = texts.select(F.col("hash").alias("other"), F.col("line").alias("other_line"))
    verified = pairs.join(one, "hash").join(two, "other").where(F.levenshtein("line", "other_line", 1).between(0, 1))
    return verified.groupBy("hash").agg(F.min("first").alias("near")), texts


def removed_lines(docs: DataFrame, min_chars: int, exact_chars: int) -> DataFrame:
    """(__id, __text_hash, __gone): numbers of the lines that an earlier line duplicates; a table, those that led to it are deleted."""
    length = F.length("line")
    halves = F.when(length >= min_chars, half_keys(F.col("line"), length))  # null keys of short lines pair with nothing
    rows = lines_of(docs, min(min_chars, exact_chars)).select("__id", "__text_hash", "no", F.xxhash64("line").alias("hash"), halves.alias("halves"))
    rows = materialize(rows, "lines")
    place = F.struct("__id", "__text_hash", "no")
    distinct = rows.groupBy("hash").agg(F.min(place).alias("first"), F.count("*").alias("n"), F.first("halves").alias("halves"))
    distinct = materialize(distinct, "distinct-lines")
    drop_shuffles(docs.sparkSession)
    near, texts = near_lines(docs, distinct, min_chars)
    info = distinct.select("hash", "first", "n").join(near, "hash", "left").where("n > 1 or near is not null")
    info = materialize(info.select("hash", "n", F.least("first", "near").alias("keep")), "repeated-lines")
    for table in (distinct, texts):
        discard(table)
    drop_shuffles(docs.sparkSession)
    gone = join_split(rows.select("__id", "__text_hash", "no", "hash"), info, "hash").where(place > F.col("keep"))
    gone = materialize(gone.groupBy("__id", "__text_hash").agg(F.array_sort(F.collect_set("no")).alias("__gone")), "removed-lines")
    for table in (rows, info):
        discard(table)
    drop_shuffles(docs.sparkSession)
    return gone


def without(lines: Column, gone: Column) -> Column:
    """``lines`` without those at the sorted places ``gone``; stretches between these are copied whole."""
    begins, ends = F.concat(F.array(F.lit(-1)), gone), F.concat(gone, F.array(F.size(lines)))
    return F.flatten(F.zip_with(begins, ends, lambda s, e: F.slice(lines, s + 2, e - s - 1)))


def shortened(docs: DataFrame, min_chars: int, exact_chars: int) -> tuple[DataFrame, list[Column], Column, Column]:
    """Rows, and columns of these: those of ``docs`` with the text without its later lines, the number of lines, and those that went."""
    gone = removed_lines(docs, min_chars, exact_chars)
    own = docs.select(F.struct("*").alias("__row"), F.col("doc_id").alias("__own_id"), F.xxhash64("text").alias("__own_text"))
    same = F.col("__own_id").eqNullSafe(F.col("__id")) & (F.col("__own_text") == F.col("__text_hash"))
    rows = own.join(gone.hint("shuffle_hash"), same, "left")
    lines = F.split("__row.text", "\n")
    kept = let(lines, lambda x: F.array_join(without(x, F.col("__gone")), "\n"))
    text = F.when(F.col("__gone").isNull(), F.col("__row.text")).otherwise(kept)
    other = [text.alias("text") if c == "text" else F.col("__row").getField(c).alias(c) for c in docs.columns]
    n_lines = F.coalesce(F.when(F.col("__row.text") == "", 0).otherwise(F.size(lines)), F.lit(0)).cast("long")
    return rows, other, n_lines, F.coalesce("__gone", F.array().cast("array<int>"))


def dedup_lines(docs: DataFrame, min_chars: int = 30, exact_chars: int | None = None) -> DataFrame:
    """The rows of ``docs``, with all columns and the text without its later lines, and __n_lines and __removed (line numbers);
    columns that have these names already are replaced.

    ``exact_chars``: the least length of a line that goes as an exact repeat; ``min_chars`` if it is not given.
    """
    rows, other, n_lines, removed = shortened(docs, min_chars, min_chars if exact_chars is None else exact_chars)
    kept = [x for c, x in zip(docs.columns, other) if c.lower() not in ("__n_lines", "__removed")]
    return rows.select(*kept, n_lines.alias("__n_lines"), removed.alias("__removed"))


def without_later_lines(docs: DataFrame, min_chars: int = 30) -> DataFrame:
    """The rows and columns of ``docs`` with the texts without later lines, and n_chars, if it is there, to match."""
    rows, other, _, _ = shortened(docs, min_chars, 1)
    out = rows.select(*other)
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))
    return out


def op5_deletion_neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"), exact_chars=1)
    return rows.select(
        "doc_id",
        F.col("__n_lines").alias("n_lines"),
        F.size("__removed").cast("long").alias("n_removed"),
        F.array_join(F.transform("__removed", lambda n: n.cast("string")), ",").alias("removed_lines"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


#: The same rows in DuckDB's SQL. Pairs that share a half are compared character by character.
OP5_SQL = r"""WITH t AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS no FROM t),
x AS (SELECT line, length(line) AS n, min({'d': doc_id, 'n': no}) AS first FROM l WHERE line <> '' GROUP BY line),
m AS (SELECT line, n, first, unnest([n - 1, n]) AS m FROM x WHERE n >= 30),
k AS (SELECT line, n, first, m, 'p' AS side, left(line, m // 2) AS piece FROM m UNION ALL SELECT line, n, first, m, 's', right(line, m // 2) FROM m),
p AS (SELECT DISTINCT a.line, b.line AS other, b.first FROM k a JOIN k b USING (m, side, piece) WHERE b.first < a.first AND m = least(a.n, b.n) AND abs(a.n - b.n) <= 1),
s AS (SELECT line, first, CASE WHEN length(line) > length(other) THEN other ELSE line END AS a, CASE WHEN length(line) > length(other) THEN line ELSE other END AS b FROM p),
v AS (SELECT line, min(first) AS near FROM s WHERE CASE WHEN length(a) = length(b) THEN len(list_filter(range(1, length(a) + 1), lambda i: a[i] <> b[i])) = 1
 ELSE list_bool_or(list_transform(range(length(b)), lambda i: left(a, i) = left(b, i) AND substring(a, i + 1) = substring(b, i + 2))) END GROUP BY line),
g AS (SELECT doc_id, no, line, line <> '' AND {'d': doc_id, 'n': no} > coalesce(near, first) AS gone FROM l LEFT JOIN x USING (line) LEFT JOIN v USING (line)),
r AS (SELECT doc_id, count(*) AS n, CAST(count_if(gone) AS BIGINT) AS n_removed, coalesce(string_agg(CAST(no AS VARCHAR), ',' ORDER BY no) FILTER (gone), '') AS removed_lines,
 coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (NOT gone), '') AS kept FROM g GROUP BY doc_id)
SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN 0 ELSE n END AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(removed_lines, '') AS removed_lines, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN r USING (doc_id)"""
