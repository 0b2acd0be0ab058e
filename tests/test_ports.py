import pytest
from pyspark.sql import functions as F

from lumenline import ports
from lumenline.plans import documents


def test_retries():
    seen, waits = [], []

    def call():
        seen.append(1)
        if len(seen) < 3:
            raise ports.PortError("busy", 429)
        return "ok"

    assert ports.with_retries(call, sleep=waits.append) == "ok" and waits == [2.0, 4.0]
    with pytest.raises(ports.PortError):
        ports.with_retries(lambda: (_ for _ in ()).throw(ports.PortError("no", 400)), sleep=waits.append)
    assert len(waits) == 2


def test_model_errors_become_values(spark):
    rows = spark.createDataFrame([("a",), ("FAIL",), (None,)], "p string").select(ports.ask(ports.FakeModel)("p").alias("r")).collect()
    assert rows[0].r.text.startswith("## Note") and rows[1].r.error == "refused" and rows[2].r.text is None


def test_notes(spark):
    rows = [("lecture01", 1, 1, "deck", "T", "", "said", "output/a.png"), ("lecture01", 2, 2, "deck", "", "", " \n", None), ("lecture01", 3, 3, "deck", "FAIL", "", "x", None)]
    df = spark.createDataFrame(rows, "lecture_id string, position int, slide_number int, mode string, slide_text string, notes_text string, transcript_text string, frame_image_path string")
    noted = ports.slide_notes(df, ports.FakeModel).withColumn("examples", F.lit("")).withColumn("deck_image_path", F.lit(None).cast("string"))
    overview = spark.createDataFrame([("lecture01", "## About\n- it")], "lecture_id string, text string")
    head, one, two, three = documents.lecture_notes(noted, overview).first().text.split("\n## Slide ")
    assert head == "# lecture01\n\n## About\n- it\n\n---\n"
    assert one.startswith("1: Note ") and one.endswith("\n\n![slide 1 as shown during the lecture](../a.png)\n\n")
    assert two == "2\n\n*(Nothing to summarize here — skipped.)*\n"
    assert three == "3\n\n*(Note generation failed here: refused)*\n\n\n---\n\n**Slides that failed to generate:** 3\n"


def test_ocr_reads_heads_only(spark):
    df = spark.createDataFrame([("l", i, float(i), f"frames/img_{i}.png", h) for i, h in enumerate([0, 1, -1])], "lecture_id string, event_index long, timestamp double, frame_image_path string, hash long")
    assert [r.ocr_text for r in ports.ocr_events(df, ports.FakeOcr).orderBy("event_index").collect()] == ["img 0", "img 0", "img 2"]


def test_transcription_in_chunks(spark):
    df = spark.createDataFrame([("l", 0, "a", 4.0, "words"), ("l", 1, "b", 4.0, "words")], "lecture_id string, part int, path string, duration double, vocabulary string")
    got = ports.transcribe_in_chunks(df, ports.FakeTranscriber).orderBy("part").collect()
    assert got[1].segments[1].text == "words words"


def test_confirmation(spark):
    df = spark.createDataFrame([("l", 0, 1.0, "whiteboard", 0.1, None, "", "", ["example"])], "lecture_id string, event_index int, timestamp double, kind string, score double, ink_delta int, slide_text string, transcript_context string, cue_hits array<string>")
    confirmed, rejected = ports.confirm_examples(df, ports.FakeModel)
    assert confirmed.count() == 0 and rejected.count() == 1


def test_exams(spark):
    got = ports.exam_papers(spark.createDataFrame([("m",)], "text string"), spark.createDataFrame([("b",)], "blueprint string"), 2, ports.FakeModel).orderBy("exam").collect()
    assert [r.exam for r in got] == ["exam_01", "exam_02"] and got[0].key == "No key was given."


def test_fetching(spark, tmp_path):
    df = spark.createDataFrame([("a", "http://x"), ("b", "http://private"), ("c", "http://gone")], "lecture_id string, url string")
    got = {r.lecture_id: (r.path, r.code, r.cookies) for r in ports.fetch_videos(df, ports.FakeFetcher, "/v/").collect()}
    assert got == {"a": ("/v/a.mp4", 0, False), "b": ("/v/b.mp4", 0, True), "c": (None, 1, False)}


def test_decks(spark, tmp_path):
    files = spark.createDataFrame([("a", "d/x.pptx"), ("b", "d/y.bad")], "lecture_id string, path string")
    assert [tuple(r)[2:] for r in ports.convert_decks(files, ports.FakeConverter, "out").orderBy("path").collect()] == [("out/x.pdf", None), (None, "cannot convert")]
    from lumenline.operators.decks import pages_to_slides

    slides = pages_to_slides(ports.deck_pages(files, ports.FakeRenderer)).orderBy("lecture_id", "slide_number").collect()
    assert len(slides) == 6 and slides[0].title == "d/x.pptx page 1" and slides[0].body_text == "body" and slides[2].title == ""


def test_media(spark, tmp_path):
    videos = spark.createDataFrame([("a", "v/a.mp4")], "lecture_id string, path string")
    assert ports.extract_audio(videos, ports.FakeExtractor, "w", True).first().audio == "w/a.opus"
    assert ports.preview_frames(videos, ports.FakeFrames, 3.0).first().timestamp == 3.0
    assert ports.preview_frames(videos, ports.FakeFrames, 100.0).first().timestamp == 100.0
    got = spark.createDataFrame([("x",), ("bad",), (None,)], "p string").select(ports.load_images(lambda: lambda p: {"x": b"ab"}[p])("p").alias("b")).collect()
    assert [r.b for r in got] == ["YWI=", None, None]
    docs = documents.simple_html(spark.createDataFrame([("g", "# A & b\n\n![i](../x.png)\n**k** [t](u)\n$a<b$")], "name string, text string"))
    row = ports.print_documents(docs, ports.FakePrinter, str(tmp_path)).first()
    assert open(row.pdf).read() == '<h1>A &amp; b</h1>\n\n<p><img alt="i" src="x.png"></p>\n<p><strong>k</strong> <a href="u">t</a></p>\n<p>$a&lt;b$</p>'
