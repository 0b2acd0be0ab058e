import random

import pytest
from pyspark.sql import functions as F

from lumenline.llm.linededup import dedup_lines, op5_deletion_neighbourhood, without_later_lines

from .fixture_docs import SCHEMA


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a == b or a[i:] == b[i + 1 :] or (len(a) == len(b) and a[i + 1 :] == b[i + 1 :])


def plain(rows, least):
    own = sorted({((-(2**63) if r[0] is None else r[0]), r[1]) for r in rows if r[1] is not None})  # null ids first
    assert len({i for i, _ in own}) == len(own)  # texts of one id would be ordered by their hash
    places = [(i, n, line) for i, t in own for n, line in enumerate(t.split("\n")) if len(line) >= least]
    gone = {}
    for k, (i, n, line) in enumerate(places):
        if any(near(line, x[2]) for x in places[:k]):
            gone.setdefault(i, []).append(n)
    return gone


def check(df, rows, least=30):
    gone = plain(rows, least)
    for r in dedup_lines(df, least).collect():
        want = gone.get(-(2**63) if r.doc_id is None else r.doc_id, []) if r["__n_lines"] else []
        assert r["__removed"] == want
    texts = {r[0]: r[1] for r in rows}
    for r in dedup_lines(df, least).where("doc_id is not null").collect():
        t = texts[r.doc_id]
        assert r.text == (None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone.get(r.doc_id, [])))


def test_against_plain_python(spark, docs, rows):
    keep = [r for r in rows if not (r[0] is None and r[1] is None)]
    check(docs.where("doc_id is not null or text is not null"), keep)


@pytest.mark.parametrize("seed", range(3))
def test_edits(spark, seed):
    rng = random.Random(seed)
    lines = ["".join(rng.choice("aab é") for _ in range(rng.randint(6, 14))) for _ in range(12)]
    rows = []
    for i in range(40):
        own = []
        for _ in range(rng.randint(1, 4)):
            x = list(rng.choice(lines))
            p, what = rng.randrange(len(x)), rng.randrange(4)
            if what == 1:
                x[p] = rng.choice("ab")
            elif what == 2:
                x.insert(p, rng.choice("ab"))
            elif what == 3:
                del x[p]
            own.append("".join(x))
        rows.append((i, "\n".join(own)) + (None,) * 10)
    check(spark.createDataFrame(rows, SCHEMA), rows, 5)


def test_stage_keeps_columns(docs, rows):
    out = without_later_lines(docs)
    assert out.schema.fieldNames() == docs.schema.fieldNames() and out.count() == len(rows)
    assert out.where(F.col("text").isNotNull() & (F.col("n_chars") != F.length("text"))).count() == 0


def test_repeated_rows_get_one_result(spark):
    rows = [(1, "a line that is long enough to be compared") + (None,) * 10] * 3
    assert [r["__removed"] for r in dedup_lines(spark.createDataFrame(rows, SCHEMA)).collect()] == [[]] * 3


def test_hot_line_and_hot_half(spark):
    common = "a common line that stands in many documents"
    rows = [(i, f"{common}\n{common[:-4]}{i:04d} and other words\nown words of document {i * 7919 % 10007} " + "z" * (i % 50)) + (None,) * 10 for i in range(300)]
    got = {r.doc_id: r["__removed"] for r in dedup_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[0] == [] and all(0 in got[i] for i in range(1, 300))
    assert 1 in got[1] and got[11].count(1) == 1  # 0001 is one edit from 0000, as 0011 is from 0001


def test_empty_and_null(nothing, unknown):
    assert dedup_lines(nothing).count() == 0
    assert [(r.text, r["__n_lines"], r["__removed"]) for r in dedup_lines(unknown).collect()] == [(None, 0, [])] * 3


def test_exact_repeats_of_short_lines_go(spark, tmp_path):
    own = "a line of its own that is long enough, number "
    rows = [(i, f"Les.\n{own}{i * 1111:05d}\n\nab{'c' * (i % 3)}\nLes.") + (None,) * 10 for i in range(12)] + [(20, "") + (None,) * 10]
    df = spark.createDataFrame(rows, SCHEMA)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: [int(n) for n in r.removed_lines.split(",") if n] for r in op5_deletion_neighbourhood(spark, str(tmp_path)).collect()}
    assert got == {0: [4], 1: [0, 4], 2: [0, 4], **{i: [0, 3, 4] for i in range(3, 12)}, 20: []}  # ab, abc and abcc are not compared by edits
    texts = {r.doc_id: r.text for r in without_later_lines(df).collect()}
    assert sum(t.split("\n").count("Les.") for t in texts.values()) == 1 and texts[5] == f"{own}05555\n"


def test_columns_of_all_names_and_ids_of_all_types(spark, rows):
    odd = ["removed", "__gone", "__id", "__text_hash", "__row", "hash", "no", "line", "keep", "first", "n", "near", "variant"]
    some = [r for r in rows if r[0] is not None]
    df = spark.createDataFrame([(f"{r[0]:09d}", r[1], *range(len(odd))) for r in some], f"doc_id string, text string, {', '.join(f'{c} int' for c in odd)}")
    gone = plain(some, 30)
    for r in dedup_lines(df).collect():
        assert r["__removed"] == gone.get(int(r.doc_id), []) and [r[c] for c in odd] == list(range(len(odd)))


def test_very_long_texts(spark):
    text = "\n".join(f"line number {i * 7919 % 30011:05d}{i * 104729 % 99991:05d} of one very long text" for i in range(30_000))
    text += "\n" + text.split("\n")[0]
    rows = [(i, text) + (None,) * 10 for i in (1, 2)]
    got = {r.doc_id: r for r in dedup_lines(spark.createDataFrame(rows, SCHEMA).repartition(2)).collect()}
    assert got[2].text == "" and len(got[2]["__removed"]) == 30_001 and 30_000 in got[1]["__removed"]
    assert got[1].text == "\n".join(x for n, x in enumerate(text.split("\n")) if n not in set(got[1]["__removed"]))
