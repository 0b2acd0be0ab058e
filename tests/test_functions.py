import pytest
from pyspark.sql import functions as F

from lumenline.functions import text as fn
from lumenline.operators import catalog


def value(spark, column, **inputs):
    row = spark.range(1)
    for name, x in inputs.items():
        row = row.withColumn(name, F.lit(x))
    return row.select(column.alias("x")).first()["x"]


def test_strip_and_norm(spark):
    assert value(spark, fn.strip("t"), t="  \n a b\t") == "a b"
    assert value(spark, fn.norm("t"), t="  NASLOV   b\n") == "naslov b"
    assert value(spark, fn.norm("t"), t=None) == ""


@pytest.mark.parametrize("given, want", [("Žižek", "Zizek"), ("đak", "đak"), ("ﬁ²", "fi2"), (None, ""), ("abc", "abc")])
def test_fold_diacritics(spark, given, want):
    assert value(spark, fn.fold_diacritics(F.col("t")), t=given) == want


def test_overlap(spark):
    assert value(spark, fn.overlap_ratio("a", "b"), a="a b c d", b="a b x y") == 0.5
    assert value(spark, fn.overlap_ratio("a", "b"), a="", b="x") == 1.0


def test_novel(spark):
    assert value(spark, fn.novel_ratio("a", "b"), a="one two three four five six", b="one two three four five six seven eight nine") == pytest.approx(3 / 9)
    assert value(spark, fn.novel_ratio("a", "b"), a="x", b="") == 1.0
    long = "x " * 72 + "word frag"  # long enough to have been cut
    assert value(spark, fn.novel_ratio("a", "b"), a="x word", b=long[:149]) == 0.0


def test_hamming(spark):
    assert value(spark, fn.hamming("a", "b"), a=0, b=-1) == 64
    assert value(spark, fn.hamming("a", "b"), a=5, b=5) == 0


def test_difference_hash(spark):
    falling = [9 - i % 9 for i in range(72)]
    assert value(spark, fn.difference_hash("p"), p=falling) == -1
    assert value(spark, fn.difference_hash("p"), p=falling[::-1]) == 0


@pytest.mark.parametrize("seconds, shown", [(0.0, "0:00"), (59.5, "1:00"), (0.5, "0:00"), (3599.6, "1:00:00"), (3725.0, "1:02:05")])
def test_clock(spark, seconds, shown):
    assert value(spark, fn.clock("s"), s=seconds) == shown


@pytest.mark.parametrize(
    "answer, want",
    [
        ('x ```json\n{"is_example": true, "caption": " c "}\n``` y', (True, "annotated_slide", "c", 0.0)),
        ('so {"is_example": false, "kind": "whiteboard", "confidence": 0.5} there', (False, "whiteboard", "", 0.5)),
        ('{"kind": "whiteboard"}', None),
        ("nothing", None),
        ("", None),
        ('{"is_example": null}', (False, "annotated_slide", "", 0.0)),
        ('{"is_example": 1, "confidence": "high"}', (True, "annotated_slide", "", 0.0)),
    ],
)
def test_verdict(spark, answer, want):
    got = value(spark, fn.parse_verdict("t"), t=answer)
    assert (tuple(got) if got else None) == want


def test_split_exam(spark):
    assert tuple(value(spark, fn.split_exam("t"), t="paper\n\n<<<ANSWER_KEY>>>\n\nkey\n")) == ("paper", "key")
    assert tuple(value(spark, fn.split_exam("t"), t=" paper ")) == (" paper ", None)


def test_numbered_heading(spark):
    assert value(spark, fn.numbered_heading("t", "n"), t="## Title\nbody", n=3) == "## Slide 3: Title\nbody"
    assert value(spark, fn.numbered_heading("t", "n"), t="## Slide 3: Title", n=3) == "## Slide 3: Title"
    assert value(spark, fn.numbered_heading("t", "n"), t="## Slide 31: Title", n=3) == "## Slide 3: Slide 31: Title"
    assert value(spark, fn.numbered_heading("t", "n"), t="Title", n=3) == "Title"


def test_chunk_seconds(spark):
    assert value(spark, fn.chunk_seconds("s", "d", F.lit(1000)), s=0, d=10.0) == 60.0
    assert value(spark, fn.chunk_seconds("s", "d", F.lit(1000)), s=1000, d=1000.0) == pytest.approx(850.0)


@pytest.mark.parametrize(
    "stage, line, duration, want",
    [(0, "[download]  42.5% of", None, 0.425), (1, "[ 1.0 -> 50.0 ] x", 100.0, 0.5), (1, "[00:00.000 --> 1:01:40.000] x", 7400.0, 0.5), (3, "[event 7] t= 300s", 200.0, 1.0), (4, "[ocr 3/4]", None, 0.75), (6, "[1/2] example", None, 0.5), (5, "[1/2] slide", None, None)],
)
def test_progress(spark, stage, line, duration, want):
    row = spark.createDataFrame([(stage, line, duration)], "stage int, line string, duration double")
    assert row.select(fn.progress_share("stage", "line", "duration").alias("x")).first()["x"] == (pytest.approx(want) if want is not None else None)


def test_settings(spark):
    assert value(spark, fn.masked("t"), t="sk-1234567890") == "sk-1234567…"
    assert value(spark, fn.masked("t"), t="") == ""
    assert value(spark, fn.valid_setting("t"), t="ok")
    assert not value(spark, fn.valid_setting("t"), t="a\nb")


def test_crop(spark):
    assert value(spark, catalog.parse_crop("t"), t="0,0,0.5,1") == [0.0, 0.0, 0.5, 1.0]
    assert value(spark, catalog.parse_crop("t"), t="0.6,0,0.5,1") is None
    assert value(spark, catalog.parse_crop("t"), t="a,b") is None
    square = spark.createDataFrame([(list(range(16)), 4, 4)], "p array<int>, w int, h int")
    crop = F.array(F.lit(0.5), F.lit(0.0), F.lit(0.5), F.lit(0.5))
    assert square.select(catalog.cropped("p", "w", "h", crop).alias("x")).first()["x"] == [2, 3, 6, 7]


def test_urls(spark):
    rows = spark.createDataFrame([("http://a.b/c",), ("ftp://a",), ("nonsense",), ("https://",), (None,)], "u string")
    assert [r.x for r in rows.select(catalog.valid_url("u").alias("x")).collect()] == [True, False, False, False, False]


def test_math_is_held_apart(spark):
    text = "a $x$ b $$y\nz$$ c @@0@@ 5 $"
    got = value(spark, fn.stashed_math("t"), t=text)
    assert (got.text, got.formulas) == ("a \0@@0@@\0 b \0@@1@@\0 c @@0@@ 5 $", ["$x$", "$$y\nz$$"])
    assert value(spark, fn.restored_math("t", "f"), t=got.text, f=got.formulas) == text
    assert value(spark, fn.restored_math("t", "f"), t="plain", f=["$x$"]) == "plain"


def test_area_resizing_averages_what_a_pixel_covers(spark):
    assert value(spark, fn.area_resized("p", "w", "h", 2), p=[0, 2, 4, 6, 8, 10, 12, 14], w=4, h=2) == [5.0, 9.0]
    assert value(spark, fn.area_resized("p", "w", "h", 2), p=[0, 3, 6], w=3, h=1) == [1.0, 5.0]
    assert value(spark, fn.luminance("r", "g", "b"), r=255, g=255, b=255) == 255
