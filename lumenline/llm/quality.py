"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Four rates are computed from every text. For each stratum and rate, the labelled rows of good quality are a
holdout on which candidate cutoffs are tested: a cutoff stands if an exact binomial test rejects that it
would refuse more than the allowed share of good documents. The allowed share is divided among the rates,
and the error level among all tests made (Bonferroni), so that with the stated confidence the four rates
together refuse no more than the allowed share of a stratum's good documents. Rows that fail the base rules
(too few words, too much repetition) are refused besides; the promise does not count them. Of the cutoffs that
stand the strictest is used, of a rate without one none. Only sums by stratum, rate and cutoff are gathered.
Very long texts are judged whole, and an empty table gives an empty result.

Null texts have no words and all counts 0. Labels that are null or of unknown documents count for nothing;
a doc_id labelled more than once is good only if all its labels say so. Repeated documents are judged one by
one. A null stratum is a stratum of its own. Columns other than doc_id, text and the stratum are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read

SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Rates a text is refused for when they are above a cutoff.
RATES = ("symbol_rate", "dup_line_rate", "repeat_rate", "long_word_rate")


def without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def repeated_words(words: Column) -> Column:
    """Words in windows of WINDOW words that are found twice or more among ``words``."""
    n = F.size(words)
    hashes = F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(*[F.get(words, i + (k - 1)) for k in range(WINDOW)]))

    def covered(windows: Column) -> Column:
        ordered = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = bound(ordered, lambda o: F.filter(o, lambda x, j: ((j > 0) & (F.get(o, j - 1)["h"] == x["h"])) | F.coalesce(F.get(o, j + 1)["h"] == x["h"], F.lit(False))))
        return starts_cover(F.array_sort(F.transform(twice, lambda x: x["i"])))

    return F.when(n < WINDOW, F.lit(0).cast("long")).otherwise(bound(hashes, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(bound(w, covered))))


def starts_cover(starts: Column) -> Column:
    """Places covered by windows at sorted starts."""
    return bound(starts, lambda s: F.aggregate(F.transform(s, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(s, j + 1) - x, F.lit(WINDOW))).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x))


def bound(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_features(docs: DataFrame, stratum: str | None) -> DataFrame:
    """doc_id, stratum, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the rates of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(text, "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != "")
    rows = docs.select(
        "doc_id",
        (F.col(stratum).cast("string") if stratum else F.lit(None).cast("string")).alias("stratum"),
        text.alias("__text"),
        words.alias("__words"),
    )
    lines = F.filter(F.split(F.col("__text"), "\n"), lambda x: F.length(F.trim(without(x, SPACE[1:]))) > 0)
    rows = rows.select(
        "doc_id",
        "stratum",
        F.size("__words").cast("long").alias("n_words"),
        F.length(without(F.col("__text"), SPACE)).cast("long").alias("word_chars"),
        (F.length("__text") - F.length(without(F.col("__text"), SYMBOLS))).cast("long").alias("n_symbols"),
        bound(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("__lines"),
        repeated_words(F.col("__words")).alias("n_repeat_words"),
        F.size(F.filter("__words", lambda w: F.length(w) > 30)).alias("__long"),
    )
    rate = lambda a, b: F.round(F.when(b > 0, a / b).otherwise(0.0), 6)
    return rows.select(
        "doc_id",
        "stratum",
        "n_words",
        "word_chars",
        "n_symbols",
        F.col("__lines.dup").alias("n_dup_lines"),
        "n_repeat_words",
        rate(F.col("n_symbols"), F.col("word_chars")).alias("symbol_rate"),
        rate(F.col("__lines.dup"), F.col("__lines.n")).alias("dup_line_rate"),
        rate(F.col("n_repeat_words"), F.col("n_words")).alias("repeat_rate"),
        rate(F.col("__long"), F.col("n_words")).alias("long_word_rate"),
    )


def tail_log_probability(n: Column, k: Column, share: float) -> Column:
    """log P(X <= k) of a binomial X of n trials with probability ``share``; k must be small against n where n is large."""
    first = n * F.lit(math.log1p(-share))
    odds = math.log(share) - math.log1p(-share)
    start = F.struct(first.alias("term"), first.alias("total"))

    def step(acc: Column, i: Column) -> Column:
        term = acc["term"] + F.log(n - i + 1) - F.log(i.cast("double")) + F.lit(odds)
        high = F.greatest(acc["total"], term)
        return F.struct(term.alias("term"), (high + F.log(F.exp(acc["total"] - high) + F.exp(term - high))).alias("total"))

    return F.aggregate(F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>")), start, step, lambda acc: acc["total"])


def controlled_cutoffs(features: DataFrame, labels: DataFrame, allowed: float, error: float, grid: tuple[float, ...]) -> DataFrame:
    """(stratum, rate, cutoff): the strictest cutoff of each rate whose false rejection is limited, by stratum."""
    good = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1")
    held = features.join(good.select("doc_id"), "doc_id", "left_semi")
    tests = F.explode(F.array(*[F.struct(F.lit(r).alias("rate"), F.col(r).alias("value")) for r in RATES])).alias("t")
    at = F.explode(F.array(*[F.lit(g) for g in grid])).alias("cutoff")
    sums = held.select("stratum", tests).groupBy("stratum", "t.rate", "t.value").agg(F.count("*").alias("n"))
    sums = sums.select("stratum", "rate", "value", "n", at).groupBy("stratum", "rate", "cutoff").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("value") > F.col("cutoff"), F.col("n")).otherwise(0)).alias("refused"))
    sums = materialize(sums, "tests")
    tests_made = max(1, sums.count())
    share = allowed / len(RATES)
    passed = sums.where(F.col("refused") < F.col("n") * share).where(tail_log_probability(F.col("n"), F.col("refused"), share) <= math.log(error / tests_made))
    return passed.groupBy("stratum", "rate").agg(F.min("cutoff").alias("cutoff"))


def judge_quality(
    docs: DataFrame,
    labels: DataFrame,
    stratum: str | None = "lang",
    allowed: float = 0.02,
    error: float = 0.05,
    grid: tuple[float, ...] = (0.005, 0.01, 0.02, 0.03, 0.05, 0.075, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.75),
) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and the rules that refuse a row.

    Strata must be few (their cutoffs, at most one row by stratum and rate, are joined to the rows).
    """
    features = materialize(text_features(docs, stratum), "features")
    cutoffs = controlled_cutoffs(features, labels, allowed, error, grid)
    by_stratum = cutoffs.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rate", "cutoff"))).alias("__cutoffs")).withColumnRenamed("stratum", "__stratum")
    rows = features.join(by_stratum, F.col("stratum").eqNullSafe(F.col("__stratum")), "left")
    refused = F.filter(F.array(*[F.when(F.col(r) > F.try_element_at("__cutoffs", F.lit(r)), F.lit(r)) for r in RATES]), lambda x: x.isNotNull())
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    rows = rows.withColumn("base_failed", base).withColumn("refused_by", refused)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.size("refused_by") == 0)).alias("kept"), "refused_by")


def op7_controlled_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
