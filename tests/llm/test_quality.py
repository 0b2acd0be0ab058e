import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lumenline.llm.quality import controlled_cutoffs, judge_quality, tail_log_probability

from .fixture_docs import SPACED, words

LABEL = "doc_id long, quality int, toxic int"


def plain(text):
    t = text or ""
    w = words(t, SPACED, lower=False)
    five = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    count, cover, seen, dup = Counter(five), set(), set(), 0
    for i, x in enumerate(five):
        if count[x] > 1:
            cover.update(range(i, i + 5))
    for line in t.split("\n"):
        if re.search(SPACED, line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cover), len(w) < 10 or 100 * len(cover) > 20 * len(w)


def labels_for(spark, rows):
    ids = [r[0] for r in rows if r[0] is not None]
    return spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in ids] + [(None, 1, 0), (99_999, 1, 0), (ids[0], None, 1)], LABEL)


def test_against_plain_python(spark, docs, rows):
    got = judge_quality(docs, labels_for(spark, rows)).collect()
    want = sorted((str(r[0]), *plain(r[1])) for r in rows)
    assert sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert not any(r.base_failed and r.kept for r in got)


@pytest.mark.parametrize("n, k, share", [(20, 0, 0.05), (100, 3, 0.05), (5000, 10, 0.005), (60_000, 200, 0.005)])
def test_binomial_tail(spark, n, k, share):
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(share) + (n - i) * math.log1p(-share) for i in range(k + 1)]
    want = max(logs) + math.log(sum(math.exp(x - max(logs)) for x in logs))
    got = spark.range(1).select(tail_log_probability(F.lit(n).cast("long"), F.lit(k).cast("long"), share).alias("x")).first()["x"]
    assert got == pytest.approx(want, rel=1e-6)


def test_cutoffs_limit_false_rejection(spark):
    rows = [(i, "a" if i % 2 else None, (i % 500) / 10_000, 0.0, 0.0, 0.4 if i % 1000 == 1 else 0.0) for i in range(20_000)]
    features = spark.createDataFrame(rows, "doc_id long, stratum string, symbol_rate double, dup_line_rate double, repeat_rate double, long_word_rate double")
    labels = features.select("doc_id", F.lit(1).alias("quality"))
    got = {(r.stratum, r.rate): r.cutoff for r in controlled_cutoffs(features, labels, 0.02, 0.05, (0.01, 0.03, 0.05, 0.3, 0.5)).collect()}
    assert len(got) == 8
    assert got["a", "symbol_rate"] == got[None, "symbol_rate"] == 0.05  # at 0.03 two in five good ones would go
    assert got["a", "long_word_rate"] == 0.01  # two in a thousand may


def test_few_labels_refuse_nothing(spark, docs, rows):
    few = labels_for(spark, rows[:10])
    got = judge_quality(docs, few).collect()
    assert all(r.kept != r.base_failed for r in got)


def test_clean_text_is_kept_and_junk_goes(spark):
    good = [(i, " ".join(f"w{(i * 31 + j * 7) % 997}" for j in range(60))) for i in range(4000)]
    junk = [(10_000 + i, " ".join(f"w{j}" for j in range(40)) + " " + "#$% " * 60) for i in range(20)]
    df = spark.createDataFrame(good + junk, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good], LABEL)
    got = {r.doc_id: r.kept for r in judge_quality(df, labels, stratum=None).collect()}
    assert all(got[i] for i, _ in good) and not any(got[i] for i, _ in junk)


def test_empty_and_null(spark, nothing, unknown):
    none = spark.createDataFrame([], LABEL)
    assert judge_quality(nothing, none).count() == 0
    assert [(r.n_words, r.kept) for r in judge_quality(unknown, none).collect()] == [(0, False)] * 3
