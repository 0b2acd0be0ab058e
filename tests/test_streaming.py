import json
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenline.functions.text import progress_share
from lumenline.operators import runs
from lumenline.operators.match import greedy_path
from lumenline.sources import frames, logs
from lumenline.streaming import online, progress


def run(spark, tmp_path, batches, ddl, transform, name):
    """The rows of a stream that gets the batches one after the other and is restarted before each."""
    src = tmp_path / name
    src.mkdir()
    for rows in batches:
        spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(str(src))
        stream = spark.readStream.schema(ddl).parquet(str(src))
        query = transform(stream).writeStream.format("parquet").option("path", str(tmp_path / f"{name}-out")).outputMode("append").option("checkpointLocation", str(tmp_path / f"{name}-c")).trigger(availableNow=True).start()
        assert query.awaitTermination(120)
    return spark.read.parquet(str(tmp_path / f"{name}-out")).collect()


def splits(rows, n, seed):
    rng = random.Random(seed)
    cuts = sorted(rng.sample(range(1, len(rows)), n - 1))
    return [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)])]


@pytest.mark.parametrize("n", [1, 3])
def test_changes_equal_the_batch_operator_under_any_split(spark, tmp_path, n):
    rng = random.Random(1)
    ddl = "lecture_id string, timestamp double, value double"
    rows = [(f"l{i % 3}", float(i), rng.choice([1.0, 2.0, 9.0, 9.5])) for i in range(60)]
    want = runs.change_events(spark.createDataFrame(rows, ddl), 2.0).select("lecture_id", "event_index", "timestamp", "value").collect()
    got = run(spark, tmp_path, splits(rows, n, n), ddl, lambda s: online.online_changes(s, 2.0), "changes")
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


@pytest.mark.parametrize("n", [1, 4])
def test_matches_equal_the_batch_rule_under_any_split(spark, tmp_path, n):
    rng = random.Random(2)
    rows = [(f"l{i % 2}", i // 2, [round(rng.random(), 2) for _ in range(5)]) for i in range(40)]
    want = []
    for lecture in ("l0", "l1"):
        own = [r for r in rows if r[0] == lecture]
        want += [(lecture, r[1], *d) for r, d in zip(own, greedy_path(np.array([r[2] for r in own]), 0.15, 0.05, 0.05))]
    got = run(spark, tmp_path, splits(rows, n, n), "lecture_id string, event_index long, scores array<double>", online.online_matches, "matches")
    assert sorted(map(str, map(tuple, got))) == sorted(str(tuple(x.item() if hasattr(x, "item") else x for x in w)) for w in want)


def test_finished_lectures_are_forgotten(spark, tmp_path):
    ddl = "lecture_id string, timestamp double, value double, over boolean"
    batches = [[("a", 0.0, 1.0, False), ("b", 0.0, 1.0, None)], [("a", 1.0, 1.0, True), ("b", 1.0, 1.0, None)], [("a", 0.0, 1.0, False), ("b", 2.0, 5.0, None)]]
    got = run(spark, tmp_path, batches, ddl, lambda s: online.online_changes(s, 2.0, finished="over"), "over")
    assert sorted(map(tuple, got)) == [("a", 0, 0.0, 1.0), ("a", 0, 0.0, 1.0), ("b", 0, 0.0, 1.0), ("b", 1, 2.0, 5.0)]


def test_idle_lectures_are_forgotten(spark, tmp_path):
    ddl = "lecture_id string, timestamp double, value double, came timestamp_ntz"
    at = lambda minute: __import__("datetime").datetime(2024, 1, 1, 0, minute)
    batches = [[("a", 0.0, 1.0, at(0))], [("b", 0.0, 1.0, at(30))], [("b", 1.0, 1.0, at(31))], [("a", 9.0, 1.0, at(32)), ("b", 2.0, 1.0, at(32))]]
    change = lambda s: online.online_changes(s.withColumn("came", F.col("came").cast("timestamp")), 2.0, arrived="came", idle_seconds=600)
    got = run(spark, tmp_path, batches, ddl, change, "idle")
    assert sorted(map(tuple, got)) == [("a", 0, 0.0, 1.0), ("a", 0, 9.0, 1.0), ("b", 0, 0.0, 1.0)]


def segment(lecture, i):
    return json.dumps({"lecture_id": lecture, "seg_index": i, "start": i * 2.0, "end": i * 2.0 + 2, "text": f" words é {i} "}, ensure_ascii=False) + "\n"


def test_segments_are_read_once_across_restarts(spark, tmp_path):
    logdir, out = tmp_path / "logs", tmp_path / "out"
    logdir.mkdir()
    a, b = logdir / "a.jsonl", logdir / "b.jsonl"

    def step(fail=False):
        def save(df, batch):
            df.write.mode("overwrite").parquet(str(out / f"batch-{batch}"))
            if fail:
                raise RuntimeError("stopped between a batch and its commit")

        query = logs.segment_log(spark, str(logdir), stream=True, bytes="64").writeStream.foreachBatch(save).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        try:
            query.awaitTermination(120)
        except Exception:  # the failure above, which the stream reports
            assert fail
        got = spark.read.parquet(*(str(p) for p in out.glob("batch-*")))
        return sorted((r.lecture_id, r.seg_index, r.start, r.text) for r in got.collect())

    want = lambda n, lecture: [(lecture, i, i * 2.0, f"words é {i}") for i in range(n)]
    a.write_text("".join(segment("a", i) for i in range(5)) + segment("a", 5)[:20], encoding="utf-8")  # the sixth is being written
    assert step() == want(5, "a")
    with a.open("a", encoding="utf-8") as f:
        f.write(segment("a", 5)[20:] + segment("a", 6))
    b.write_text("not json\n" + segment("b", 0), encoding="utf-8")
    step(fail=True)
    with b.open("a", encoding="utf-8") as f:
        f.write(segment("b", 1))
    assert step() == want(7, "a") + want(1, "b")  # the batch that failed, with the bytes it had then
    assert step() == want(7, "a") + want(2, "b")
    assert step() == want(7, "a") + want(2, "b")


@pytest.mark.parametrize("size", [1, 7, 50, 10_000])
def test_ranges_of_a_log_have_its_lines_once(tmp_path, size):
    lines = ["", "a", "é" * 40, "x" * 200, "", "last"]
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "f.log").write_text("\n".join(lines) + "\nunfinished", encoding="utf-8")
    (tmp_path / "_hidden").write_text("no\n")
    reader = logs.LogReader({"path": str(tmp_path), "bytes": str(size)})
    parts = reader.partitions()
    got = [r for p in parts for batch in reader.read(p) for r in batch.to_pylist()]
    assert [r["line"] for r in got] == lines and {r["file"] for r in got} == {"sub/f.log"}
    assert len(parts) == -(-len(("\n".join(lines) + "\n").encode()) // size)
    (tmp_path / "sub" / "f.log").write_text("cut\n")
    with pytest.raises(ValueError):
        reader.partitions({"sub/f.log": 10}, reader.latestOffset())
    assert list(logs.LogReader({"path": str(tmp_path / "none")}).read(logs.LogReader({"path": str(tmp_path / "none")}).partitions()[0])) == []


def test_job_log_resumes(spark, tmp_path):
    event = lambda i: json.dumps({"seq": i, "type": "log", "job_id": "j"}) + "\n"
    (tmp_path / "j.jsonl").write_text("".join(map(event, range(6))))
    assert [r.seq for r in logs.job_log(spark, str(tmp_path), after=2).orderBy("seq").collect()] == [3, 4, 5]


def test_running_share_never_falls(spark, tmp_path):
    src = tmp_path / "lines"
    src.mkdir()
    rises, ddl = [], "stage int, line string, duration double"
    listener = progress.listen(spark, lambda stage, percent: rises.append((stage, percent)))
    try:
        batches = [[(0, "[download]  40.0% of 3MiB", None), (4, "[ocr 3/10] frame", None)], [(0, "[download]  20.0% of 3MiB", None), (6, "nothing", None)], [(0, "[download]  99.5% of 3MiB", None), (4, "[ocr 30/10] frame", None)]]
        for i, rows in enumerate(batches):
            spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(str(src))
            lines = progress.observed(spark.readStream.schema(ddl).parquet(str(src)), progress_share("stage", "line", "duration"), [0, 4, 6])
            query = lines.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
            assert query.awaitTermination(120)
        until = time.time() + 30
        while (listener.lines < 6 or len(listener.done) < 1) and time.time() < until:
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert listener.lines == 6 and listener.percent == {0: 99.5, 4: 100.0}
    assert [p for s, p in rises if s == 0] == [40.0, 99.5] and [p for s, p in rises if s == 4] == [30.0, 100.0]
    assert set(listener.done.values()) == {None}


class Video:
    def __init__(self, path):
        if path.endswith("bad.mp4"):
            raise frames.FrameError("could not open video")
        self.fps, self.n_frames = (0.0 if "still" in path else 2.0), 11

    def read(self, first, last, step):
        for i in range(first, last, step):
            yield i, bytes([i])


def test_frames_are_read_by_ranges(spark, tmp_path):
    (tmp_path / "one.mp4").write_bytes(b"x")
    df = frames.frames(spark, str(tmp_path), Video, interval=1.0, frames_per_task=2)
    assert df.rdd.getNumPartitions() == 3
    assert [tuple(r) for r in df.orderBy("frame_idx").collect()] == [("one", i, i / 2, bytes([i])) for i in range(0, 11, 2)]
    assert [r.frame_idx for r in frames.frames(spark, str(tmp_path), Video, interval=0.1).collect()] == list(range(11))
    for name, said in (("still.mp4", "FPS"), ("bad.mp4", "could not open")):
        (tmp_path / name).write_bytes(b"x")
        with pytest.raises(Exception, match=said):
            frames.frames(spark, str(tmp_path / name), Video).collect()
    (tmp_path / "empty").mkdir()
    assert frames.frames(spark, str(tmp_path / "empty"), Video).collect() == []
