import random

import pytest
from pyspark.sql import functions as F

from lumenline.operators import catalog, chunks, decks, match, review, runs, segment, tfidf, visual
from lumenline.plans import documents, stages

EVENT = "lecture_id string, event_index long, timestamp double, frame_image_path string, ocr_text string, hash long"
SLIDE = "lecture_id string, slide_number int, title string, body_text string, notes_text string"
SLIDES = [("l", 1, "Introduction", "Overview of the topic today", ""), ("l", 2, "Worked Example", "Example: solve 2 + 2 = 4 step by step", ""), ("l", 3, "Summary", "Key takeaways and conclusion", "")]
INTRO, WORKED = "Introduction Overview of the topic today", "Worked Example Example solve 2 + 2 = 4 step by step"
TEXTS = [(INTRO, 0x0F0F0F0F0F0F0F0F), (INTRO, 0x0F0F0F0F0F0F0F0F), ("", 0x0F0F0F0F0F0F0F0F), (WORKED, 0), (WORKED + " plus scribbled extra notes here", -1), ("Summary Key takeaways and conclusion", -1)]


def golden_events(spark):
    return spark.createDataFrame([("l", i, i * 5.0, f"output/f/event_{i:03d}.png", t, h) for i, (t, h) in enumerate(TEXTS)], EVENT)


@pytest.fixture(scope="module")
def stage4(spark):
    durations = spark.createDataFrame([("l", 30.0)], "lecture_id string, video_duration double")
    return stages.match_stage(golden_events(spark), spark.createDataFrame(SLIDES, SLIDE), durations, tfidf.default_stop_words(spark))


def test_matching_timeline(stage4):
    got = [(r.slide_number, r.start, r.end, r.confidence, r.last_frame_image_path[-7:], r.mode) for r in stage4["timeline"].orderBy("start").collect()]
    assert got == [(1, 0.0, 15.0, 1.0, "002.png", "deck"), (2, 15.0, 25.0, 1.0, "004.png", "deck"), (3, 25.0, 30.0, 1.0, "005.png", "deck")]


def test_matching_review(stage4):
    assert [r.event_index for r in stage4["low_confidence"].collect()] == [2]
    assert stage4["backward_jumps"].count() == stage4["unmatched_slides"].count() == 0


def test_matching_candidates(stage4):
    got = [(r.event_index, r.kind, r.score, r.ink_delta) for r in stage4["candidates"].orderBy("event_index").collect()]
    assert got == [(2, "whiteboard", 0.0, 0), (3, "example_slide", 1.0, 0), (4, "annotated_slide", 0.7091, 64)]


def test_fallback_to_sight(spark):
    a, b = "alpha beta gamma delta epsilon", "omega sigma kappa lambda theta"
    rows = [("l", i, i * 60.0, "f.png", f"chrome file edit {a if i < 4 else b}", i) for i in range(8)]
    got = stages.match_stage(spark.createDataFrame(rows, EVENT), spark.createDataFrame(SLIDES[:2], SLIDE), None, None)
    timeline = got["timeline"].orderBy("start").collect()
    assert [(r.start, r.mode) for r in timeline] == [(0.0, "visual"), (240.0, "visual")]
    assert "alpha" in timeline[0].segment_keywords
    assert got["matches"].count() == got["candidates"].count() == 0


def greedy(spark, rows, **margins):
    cells = [("l", e, s + 1, float(x)) for e, own in enumerate(rows) for s, x in enumerate(own)]
    return match.match_events(spark.createDataFrame(cells, "lecture_id string, event_index long, slide_number int, similarity double"), **margins).orderBy("event_index").collect()


def test_matcher_in_order(spark):
    assert [r.slide_number for r in greedy(spark, [[0.9, 0.1, 0], [0.1, 0.9, 0.1], [0, 0.1, 0.9]])] == [1, 2, 3]


def test_matcher_does_not_oscillate(spark):
    path = [r.slide_number for r in greedy(spark, [[0.50, 0.48], [0.49, 0.52], [0.47, 0.51], [0.48, 0.53]])]
    assert sum(a != b for a, b in zip(path, path[1:])) <= 1


def loop(rows, margin, stay, least):
    cur, out = 0, []
    for own in rows:
        raw = max(range(cur, len(own)), key=lambda i: (own[i], -i))
        stayed = raw != cur and (own[raw] <= own[cur] + stay or own[raw] < least)
        best = cur if stayed else raw
        back = max(range(cur), key=lambda i: (own[i], -i), default=None)
        jumped = back is not None and own[back] > own[best] + margin
        cur = back if jumped else best
        out.append((cur + 1, jumped, stayed))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_matcher_against_a_loop(spark, seed):
    rng = random.Random(seed)
    rows = [[rng.randrange(20) / 20 for _ in range(5)] for _ in range(40)]
    got = [(r.slide_number, r.jumped_backward, r.stayed_over_raw_best) for r in greedy(spark, rows)]
    assert got == loop(rows, 0.15, 0.05, 0.05)


def absorbed(ends, least):
    """The sequential rule: a short run merges into the next, trailing ones into the last that stands."""
    n = len(ends)
    short = [e is not None and e - s < least for s, e in ends]
    stands = [i for i in range(n) if not short[i]]
    return [next((j for j in range(i, n) if not short[j]), stands[-1] if stands else n - 1) for i in range(n)]


@pytest.mark.parametrize("seed", range(4))
def test_absorb_forward(spark, seed):
    rng = random.Random(seed)
    rows, t = [], 0.0
    for i in range(12):
        d = rng.choice([1.0, 4.9, 5.0, 9.0])
        rows.append(("l", i, i % 4 + 1, t, None if i == 11 and seed % 2 else t + d))
        t += d
    got = runs.absorb_forward(spark.createDataFrame(rows, "lecture_id string, run_idx long, slide_number int, start double, end double"), 5.0).orderBy("run_idx").collect()
    assert [r.target for r in got] == absorbed([(r[3], r[4]) for r in rows], 5.0)


def test_all_short_runs(spark):
    rows = [("l", i, i, float(i), i + 1.0) for i in range(3)]
    got = runs.absorb_forward(spark.createDataFrame(rows, "lecture_id string, run_idx long, slide_number int, start double, end double"), 5.0)
    assert {r.target for r in got.collect()} == {2}


def test_change_is_strict_and_against_the_last_sample(spark):
    frames = [("l", i, i * 1.5, [v] * 12) for i, v in enumerate([50, 50, 200])]
    df = spark.createDataFrame(frames, "lecture_id string, frame_idx int, timestamp double, pixels array<int>")
    assert [r.timestamp for r in runs.frame_events(df).orderBy("event_index").collect()] == [0.0, 3.0]
    df = spark.createDataFrame([("l", 0.0, 0.0), ("l", 1.0, 1.0), ("l", 2.0, 2.0)], "lecture_id string, timestamp double, value double")
    assert runs.change_events(df, 1.0).count() == 1


def test_ownership_bound_is_inclusive(spark):
    hashes = [0, 0b111, 0b1111111, None, 0b1111111]
    df = spark.createDataFrame([("l", i, h) for i, h in enumerate(hashes)], "lecture_id string, event_index long, hash long")
    assert [r.owner for r in runs.ocr_owner(df).orderBy("event_index").collect()] == [0, 0, 2, 3, 4]


def test_segmentation(spark):
    timeline = spark.createDataFrame(
        [("l", 0, 1, 0.0, 10.0, 0.9, "a", "deck"), ("l", 1, 2, 10.0, 13.0, 0.8, "b", "deck"), ("l", 2, 3, 13.0, 30.0, 0.85, "c", "deck")],
        "lecture_id string, run_idx long, slide_number int, start double, end double, confidence double, last_frame_image_path string, mode string",
    )
    said = ["Welcome to the lecture.", "Quick aside here.", "Now let's cover the summary."]
    transcript = spark.createDataFrame([("l", i, *se, t) for i, (se, t) in enumerate(zip([(0.0, 9.5), (9.5, 13.5), (13.5, 29.0)], said))], "lecture_id string, seg_index int, start double, end double, text string")
    slides = spark.createDataFrame([(*s, i) for i, s in enumerate(SLIDES)], SLIDE + ", position int")
    found = spark.createDataFrame([("l", 7, 15.0, "x.png", 2, "whiteboard", 0.1, None, "")], "lecture_id string, event_index int, timestamp double, frame_image_path string, slide_number int, kind string, score double, ink_delta int, ocr_excerpt string")
    got = stages.segment_stage(timeline, transcript, slides, found).orderBy("segment_idx").collect()
    assert [(r.slide_number, r.start, r.end, r.merged_from) for r in got] == [(1, 0.0, 10.0, []), (3, 13.0, 30.0, [2])]
    assert got[1].transcript_text == "Quick aside here.\nNow let's cover the summary."
    assert [len(r.example_candidates) for r in got] == [0, 1]
    assert "summary" in got[1].example_candidates[0].transcript_context


def test_canonical_slides(spark):
    rows = [("l", 1, "Naslov", "Tekst   ovde", 0), ("l", 2, "NASLOV", "tekst ovde", 1), ("l", 3, None, None, 2)]
    df = spark.createDataFrame(rows, "lecture_id string, slide_number int, title string, body_text string, position int")
    assert {r.slide_number: r.canonical for r in segment.canonical_slides(df).collect()} == {1: 1, 2: 1, 3: 3}


def test_pool_keeps_blank_pages(spark):
    df = spark.createDataFrame([("a", 1, ""), ("a", 2, ""), ("b", 1, "X y"), ("b", 2, "x  Y"), ("b", 3, None)], "file string, page_number int, text string")
    marked = decks.deduplicate_pool(df)
    assert sorted((r.file, r.page_number) for r in marked.where("kept").collect()) == [("a", 1), ("a", 2), ("b", 1), ("b", 3)]
    assert tuple(decks.pool_report(marked).first()) == (5, 4, 1)


def test_fuzzy_titles(spark):
    own = spark.createDataFrame([("d", "digitalna obrada signala")], "deck string, preview string")
    lectures = spark.createDataFrame([("lecture01", "Digitalna obrada signali"), ("lecture02", "nesto drugo")], "lecture_id string, title string")
    assert [(r.lecture_id, r.score) for r in decks.suggest_lectures(own, lectures).collect()] == [("lecture01", 1.0)]


ENTRY = "lecture_id string, run_idx long, start double, end double, slide_number int, confidence double"
EDIT = "lecture_id string, position int, timestamp double, slide_number int"


@pytest.mark.parametrize(
    "edits, want",
    [
        ([(15.0, 5)], [(0, 10, 1, 0.5), (10, 20, 5, 1.0), (20, 30, 3, 0.5)]),
        ([(15.0, None)], [(0, 20, 1, 0.5), (20, 30, 3, 0.5)]),
        ([(5.0, None)], [(0, 20, 2, 0.5), (20, 30, 3, 0.5)]),
        ([(15.0, 1)], [(0, 20, 1, 1.0), (20, 30, 3, 0.5)]),
        ([(99.0, 7)], [(0, 10, 1, 0.5), (10, 20, 2, 0.5), (20, 30, 3, 0.5)]),
        ([(15.0, None), (12.0, 9)], [(0, 20, 9, 1.0), (20, 30, 3, 0.5)]),
        ([], [(0, 10, 1, 0.5), (10, 20, 2, 0.5), (20, 30, 3, 0.5)]),
    ],
)
def test_corrections(spark, edits, want):
    timeline = spark.createDataFrame([("l", i, i * 10.0, i * 10.0 + 10, i + 1, 0.5) for i in range(3)], ENTRY)
    df = spark.createDataFrame([("l", i, *e) for i, e in enumerate(edits)], EDIT)
    got = review.apply_corrections(timeline, df).orderBy("entry").collect()
    assert [(r.start, r.end, r.slide_number, r.confidence) for r in got] == want


def edited_slowly(entries, edits):
    now = [list(e) for e in entries]
    for t, slide in edits:
        i = next((i for i, e in enumerate(now) if t is not None and e[0] <= t and (e[1] is None or t < e[1])), None)
        if i is None:
            continue
        if slide is not None:
            now[i][2:] = [slide, 1.0]
        else:
            if i > 0:
                now[i - 1][1] = now[i][1]
            elif len(now) > 1:
                now[1][0] = now[0][0]
            del now[i]
    return [tuple(e) for e in now]


@pytest.mark.parametrize("seed", range(200))
def test_many_corrections(seed):
    rng = random.Random(seed)
    points = sorted(rng.sample(range(200), 2 * rng.randint(0, 12)))
    entries = [(float(a), float(rng.choice([b, z])), i, 0.5) for i, (a, b, z) in enumerate(zip(points[::2], points[1::2], [*points[2::2], 199], strict=False))]
    if entries and rng.random() < 0.3:
        entries[-1] = (entries[-1][0], None, 99, None)
    edits = [(rng.choice([None, rng.uniform(-5, 210), float(rng.choice(points or [0]))]), rng.choice([None, None, rng.randint(1, 5)])) for _ in range(rng.randint(0, 30))]
    now = review.Entries(*([e[j] for e in entries] for j in range(4)))
    for e in edits:
        now.edit(*e)
    assert [(now.start[i], now.end[i], now.slide[i], now.sure[i]) for i in now.kept()] == edited_slowly(entries, edits)


def test_corrections_take_linear_time(spark):
    n = 100_000
    timeline = spark.range(n).selectExpr("'l' lecture_id", "id run_idx", "double(id) start", "double(id + 1) end", "int(id) slide_number", "0.5D confidence")
    every = spark.range(n).selectExpr("'l' lecture_id", "int(id) position", f"double({n} - id) - 0.5D timestamp", "if(id % 2 = 0, null, 7) slide_number")
    got = review.apply_corrections(timeline, every)
    assert tuple(got.agg(F.count("*"), F.min("start"), F.max("end"), F.min("slide_number"), F.min("confidence")).first()) == (1, 0.0, n, 7, 1.0)


def test_entries_out_of_order_are_an_error():
    with pytest.raises(ValueError, match="out of order"):
        review.Entries([0.0, 5.0], [6.0, 9.0], [1, 2], [None, None])


def test_stitching(spark):
    parts = spark.createDataFrame([("l", 0, 298.4, ""), ("l", 1, 301.9, "sr"), ("l", 2, 150.0, "en")], "lecture_id string, part int, duration double, language string")
    segs = spark.createDataFrame([("l", p, 0, 1.0, 2.0, f"t{p}") for p in range(3)], "lecture_id string, part int, seg_index int, start double, end double, text string")
    got = chunks.stitch(parts, segs).first()
    assert got.language == "sr"
    assert [s.start for s in got.segments] == pytest.approx([1.0, 299.4, 601.3])


def test_unknown_duration_is_an_error(spark):
    parts = spark.createDataFrame([("l", 0, None)], "lecture_id string, part int, duration double")
    with pytest.raises(Exception, match="no duration"):
        runs.running_offsets(parts).collect()


@pytest.mark.parametrize("threshold", [0.1, 0.35, 0.6, 0.9])
def test_sight_covers_everything(spark, threshold):
    rng = random.Random(1)
    rows = [("l", i, i * 30.0, "f", " ".join(rng.choice(["aa", "bb", "cc", "dd"]) for _ in range(6)), 0) for i in range(20)]
    got = visual.visual_timeline(spark.createDataFrame(rows, EVENT), threshold=threshold).orderBy("start").collect()
    assert got[0].start == 0.0 and got[-1].end == 570.0
    assert all(a.end == b.start for a, b in zip(got, got[1:]))


def test_guide_adds_missing_headings(spark):
    notes = spark.createDataFrame([("lecture01", "# lecture01\n\nA"), ("lecture02", "B")], "lecture_id string, text string")
    guide = documents.assemble_guide(notes).first().guide
    assert guide == "# Table of Contents\n\n- [lecture01](#lecture01)\n- [lecture02](#lecture02)\n# lecture01\n\nA\n\n# lecture02\n\nB\n"


def test_tasks(spark):
    rows = [("a", 1, "done"), ("a", 2, "pending"), ("a", 3, "pending"), ("b", 1, "failed"), ("b", 2, "pending")]
    got = catalog.ready_tasks(spark.createDataFrame(rows, "lecture_id string, stage int, status string")).orderBy("lecture_id", "stage").collect()
    assert [(r.lecture_id, r.stage, r.action) for r in got] == [("a", 2, "run"), ("b", 2, "skip")]


def test_usage_of_nothing_is_zero(spark):
    none = spark.createDataFrame([], "input_tokens long, output_tokens long, cache_creation_input_tokens long, cache_read_input_tokens long")
    assert tuple(catalog.total_usage(none).first()) == (0, 0, 0, 0)


def test_alike_titles_against_brute_force(spark):
    import difflib
    import random

    rng = random.Random(4)
    words = ["".join(rng.choice("abcde") for _ in range(rng.randint(1, 9))) for _ in range(60)]

    def changed(w):
        w = list(w)
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w)) :][:1] = []
            w.insert(rng.randrange(len(w) + 1), rng.choice("abcde"))
        return "".join(w)

    titles = {f"lecture{i:02d}": " ".join(rng.choice(words) for _ in range(rng.randint(1, 6))) for i in range(25)}
    previews = {f"deck{i}": " ".join(changed(rng.choice(words)) for _ in range(rng.randint(3, 30))) for i in range(25)}
    for fuzzy in (True, False):
        want = []
        for d, p in previews.items():
            own, scored = set(p.split()), []
            for i, t in titles.items():
                hits = sum(w in own or bool(fuzzy and difflib.get_close_matches(w, sorted(own), n=1, cutoff=0.85)) for w in t.split())
                if (score := round(hits / len(t.split()), 3)) >= 0.5:
                    scored.append((-score, i))
            want += [(d, i, -s) for s, i in sorted(scored)[:3]]
        found = decks.suggest_lectures(spark.createDataFrame(list(previews.items()), "deck string, preview string"), spark.createDataFrame(list(titles.items()), "lecture_id string, title string"), fuzzy=fuzzy)
        assert "CartesianProduct" not in found._jdf.queryExecution().toString() and "NestedLoop" not in found._jdf.queryExecution().toString()
        assert sorted((r.deck, r.lecture_id, r.score) for r in found.collect()) == sorted(want) and want


def test_a_long_lecture_is_matched_in_turn():
    import numpy as np

    from lumenline.operators.match import greedy_path

    scores = np.random.default_rng(1).random((50_000, 12))
    path = list(greedy_path(scores, 0.15, 0.05, 0.05))
    assert len(path) == 50_000 and all(d[1] == scores[i, d[0]] for i, d in enumerate(path))


def test_zipped_sides_must_be_of_one_length(spark):
    left = spark.createDataFrame([("l", 1, "a"), ("l", 2, "b")], "lecture_id string, place int, x string")
    right = spark.createDataFrame([("l", 1, "c"), ("l", 2, "d")], "lecture_id string, place int, y string")
    assert sorted(map(tuple, chunks.zipped(left, right, "place").collect())) == [("l", 1, "a", "c"), ("l", 2, "b", "d")]
    with pytest.raises(Exception, match="sides differ in length"):
        chunks.zipped(left, right.where("place = 1"), "place").collect()


def random_intervals(seed, n, width):
    import random

    rng = random.Random(seed)
    rows = [(f"l{rng.randint(0, 2)}", i, float(a := rng.randint(0, 40)), rng.choice([None, float(a), a + 1.0, a + float(rng.randint(0, width))])) for i in range(n)]
    return rows + [("l0", n, 3.0, 1.0), ("l9", n + 1, 0.0, 5.0), ("l0", n + 2, None, 5.0)]


@pytest.mark.parametrize("closed", [False, True])
def test_sweep_finds_all_overlaps(spark, closed):
    left, right = random_intervals(1, 60, 4), random_intervals(2, 50, 30)
    frame = lambda rows, name: spark.createDataFrame(rows, f"lecture_id string, {name} long, start double, end double")
    got = segment.overlapping(frame(left, "a"), frame(right, "b"), ["a"], ["b"], closed=closed).collect()
    ok = lambda r: r[2] is not None and r[3] is not None and r[2] <= r[3]
    touch = lambda x, y: (x[2] <= y[3] and y[2] <= x[3]) if closed else (x[2] <= y[2] < x[3] or y[2] < x[2] < y[3])
    want = [(x[0], x[1], y[1]) for x in left for y in right if x[0] == y[0] and ok(x) and ok(y) and touch(x, y)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_nearest_meets_two_others(spark):
    import random

    rng = random.Random(3)
    points = [(f"l{i % 3}", i, float(rng.randint(0, 60))) for i in range(80)] + [("l7", 99, 1.0)]
    others = [(f"l{i % 2}", i, float(rng.randint(0, 60))) for i in range(30)] + [("l0", 50, None)]
    got = segment.nearest(spark.createDataFrame(points, "lecture_id string, event_index long, timestamp double"), spark.createDataFrame(others, "lecture_id string, n long, at double"), ["event_index"], "n").collect()
    best = lambda p: min(((abs(o[2] - p[2]), o[1]) for o in others if o[0] == p[0] and o[2] is not None), default=(0, None))[1]
    assert sorted(map(tuple, got)) == sorted((p[0], p[1], best(p)) for p in points)


def test_sweep_is_linear_in_inputs_and_results(spark):
    n = 30_000
    segs = spark.range(n).select(F.lit("l").alias("lecture_id"), F.col("id").alias("seg_index"), F.col("id").cast("double").alias("start"), (F.col("id") + 1.5).alias("end"), F.lit("x").alias("text"))
    own = spark.range(n // 10).select(F.lit("l").alias("lecture_id"), F.col("id").alias("run_idx"), (F.col("id") * 10.0).alias("start"), F.when(F.col("id") < n // 10 - 1, (F.col("id") + 1) * 10.0).alias("end"))
    assert segment.overlapping(segs, own.fillna(1e9, ["end"]), ["seg_index"], ["run_idx"]).count() < 1.2 * n
    assert segment.assign_to_runs(segs, own).where("run_idx = seg_index div 10").count() == n


def test_words_alike_are_those_of_all_pairs(spark):
    import difflib

    rng = random.Random(8)
    make = lambda: "".join(rng.choice("abcé") for _ in range(rng.randint(1, 22)))
    own = {make() for _ in range(120)}
    others = {make() for _ in range(60)} | set(rng.sample(sorted(own), 20))
    for w in sorted(own):
        for _ in range(3):
            v = list(w)
            for _ in range(rng.randint(1, 3)):
                k = rng.randrange(len(v) + 1)
                v[k : k + rng.randint(0, 1)] = rng.choice(["", "a", "z", "é"])
            others.add("".join(v) or "x")
    got = decks.alike_words(spark.createDataFrame([(w,) for w in own], "word string"), spark.createDataFrame([(w,) for w in others], "other string")).collect()
    want = {(w, o) for w in own for o in others if w == o or difflib.get_close_matches(w, [o], n=1, cutoff=0.85)}
    assert len(got) == len(want) and {tuple(r) for r in got} == want and len(want) > 150


@pytest.mark.parametrize("fuzzy", [False, True])
def test_previews_are_sent_once(spark, tmp_path, fuzzy):
    import re

    own = spark.range(50).select(F.col("id").alias("deck"), F.concat(F.lit("signal obrada analiza sistema "), F.expr("array_join(transform(sequence(1, 200), i -> sha1(string(1000 * id + i))), ' ')")).alias("preview"))
    own.write.parquet(f"{tmp_path}/own")
    spark.createDataFrame([(1, "obrada signala"), (2, "analiza sistema"), (3, "7 8 9")], "lecture_id long, title string").write.parquet(f"{tmp_path}/titles")
    found = decks.suggest_lectures(spark.read.parquet(f"{tmp_path}/own"), spark.read.parquet(f"{tmp_path}/titles"), fuzzy=fuzzy)
    plan = found._jdf.queryExecution().executedPlan().toString()
    sent = re.findall(r"Exchange hashpartitioning\((deck|word|other)#[^)]*\), (\w+)", plan)
    assert sent == [("deck", "REPARTITION_BY_COL")]
    assert {(r.deck, r.lecture_id, r.score) for r in found.collect()} == {(i, 2, 1.0) for i in range(50)} | ({(i, 1, 0.5) for i in range(50)} if not fuzzy else {(i, 1, 1.0) for i in range(50)})


@pytest.mark.parametrize("common", [1, 40, 1 << 17])
def test_joint_similarity_is_that_of_all_pairs(spark, common):
    import math
    from collections import Counter

    from lumenline.operators import tfidf

    rng = random.Random(6)
    text = lambda k: " ".join("w" + str(min(int(rng.expovariate(0.1)), 60)) for _ in range(k))
    left = [(i, text(rng.randint(0, 12))) for i in range(6)] + [(3, text(5)), (9, None)]
    right = [(i, text(rng.randint(0, 40))) for i in range(30)] + [(7, text(9)), (7, text(3)), (50, None), (51, "a b")]
    counts = [{}, {}]
    for own, rows in zip(counts, (left, right)):
        for i, t in rows:
            own.setdefault(i, Counter()).update(w for w in (t or "").split() if len(w) > 1)
    n, df = len(left) + len(right), Counter(w for own in counts for c in own.values() for w in c)
    weights = [{i: {w: tf * (math.log((1 + n) / (1 + df[w])) + 1) for w, tf in c.items()} for i, c in own.items()} for own in counts]
    size = lambda v: math.sqrt(sum(x * x for x in v.values()))
    want = {(i, j): sum(x * y[w] for w, x in v.items() if w in y) / size(v) / size(y) for i, v in weights[0].items() for j, y in weights[1].items() if v.keys() & y.keys()}
    got = tfidf.joint_similarity(spark.createDataFrame(left, "a long, text string"), spark.createDataFrame(right, "b long, text string"), "a", "b", common).collect()
    assert len(got) == len(want) and {(r.a, r.b): round(r.similarity, 9) for r in got} == {k: round(x, 9) for k, x in want.items()}


def test_pairs_of_similarity_are_not_sent(spark):
    import re

    from lumenline.plans import queries

    plan = queries.QUERIES["tfidf_similarity"](spark, "/root/testdata/sf0.01")._jdf.queryExecution().executedPlan().toString()
    sent = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    assert sent and all(len(re.findall(r"#", keys)) == 1 for keys in sent), sent
