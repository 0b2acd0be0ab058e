import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from lumenline.model import TRANSCRIPT
from lumenline.sources import artifacts
from lumenline.sources.pool import Changed, Pool


def test_json_scans(spark, tmp_path):
    (tmp_path / "lecture01.json").write_text(json.dumps({"language": "sr", "segments": [{"start": 0, "end": 1.5, "text": "đak"}]}, ensure_ascii=False))
    ddl = TRANSCRIPT.split(", ", 1)[1]
    row = artifacts.scan_json(spark, str(tmp_path / "*.json"), ddl).first()
    assert row.lecture_id == "lecture01" and row.segments[0].text == "đak"
    assert artifacts.scan_json_or(spark, str(tmp_path / "none" / "*.json"), ddl).count() == 0
    (tmp_path / "lecture02.json").write_text("{broken")
    assert [r.lecture_id for r in artifacts.scan_json_or(spark, str(tmp_path / "*.json"), ddl).collect()] == ["lecture01"]


def test_url_map(spark, tmp_path):
    (tmp_path / "urls.json").write_text('{"lecture02": "b", "lecture01": "a"}')
    assert [tuple(r) for r in artifacts.scan_url_map(spark, str(tmp_path / "urls.json")).collect()] == [("lecture01", "a"), ("lecture02", "b")]


def test_incremental_sink(spark, tmp_path):
    out = str(tmp_path / "t")
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "lecture_id string, x int")
    assert artifacts.pending(rows, spark, out).count() == 2 and not artifacts.is_done(spark, out)
    artifacts.write_lectures(rows.where("x = 1"), out)
    assert [r.lecture_id for r in artifacts.pending(rows, spark, out).collect()] == ["b"]
    artifacts.write_lectures(rows.withColumn("x", F.col("x") * 10).where("x = 20"), out)
    assert sorted(r.x for r in spark.read.parquet(out).collect()) == [1, 20] and artifacts.is_done(spark, out)


def test_provenance(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1")], "lecture_id string, url string")
    new = spark.createDataFrame([("b", "2")], "lecture_id string, url string")
    assert sorted(tuple(r) for r in artifacts.merge_provenance(old, new).collect()) == [("a", "1"), ("b", "2")]


def test_preference(spark):
    text = lambda *x: spark.createDataFrame([(t,) for t in x], "text string")
    assert artifacts.prefer(text(" "), text("guide")).first().text == "guide"
    assert artifacts.prefer(text(), text()).first().text is None


def test_documents_are_replaced_whole(tmp_path):
    artifacts.write_json(str(tmp_path / "x" / "a.json"), {"č": 1})
    assert json.loads((tmp_path / "x" / "a.json").read_text()) == {"č": 1} and len(list((tmp_path / "x").iterdir())) == 1


def test_stale(spark):
    md = spark.createDataFrame([("a", 2), ("b", 2), ("c", 2)], "name string, modified int")
    pdf = spark.createDataFrame([("a", 3), ("b", 1)], "name string, modified int")
    assert sorted(r.name for r in artifacts.stale_documents(md, pdf).collect()) == ["b", "c"]
    files = spark.createDataFrame([("x.PDF",), ("y.pptx",), ("z.exe",), ("none",)], "path string")
    assert artifacts.with_extension(files, "pdf", "pptx").count() == 2


def test_tagged_union_of_no_files_is_empty(spark):
    assert artifacts.tagged_union({}, ["text string"]).columns == ["text", "source"]
    one = spark.createDataFrame([("a",)], "text string")
    assert [tuple(r) for r in artifacts.tagged_union({"b.pdf": one, "a.pdf": one}, ["text string"]).collect()] == [("a", "a.pdf"), ("a", "b.pdf")]


POOL = StructType([StructField("name", StringType()), StructField("modified", IntegerType())])


def shown(pool, number=None):
    return sorted(tuple(r) for r in pool.read(number).collect())


@pytest.fixture
def pool(spark, tmp_path):
    return Pool(spark, f"file://{tmp_path}/pool", POOL)


def test_pool_is_old_or_new_at_every_step(spark, pool, monkeypatch):
    rows = lambda *x: spark.createDataFrame(list(x), POOL)
    assert shown(pool) == [] and pool.number() == 0
    pool.save(rows(("a", 1), ("a", 2), ("b", 1)), replace=True)
    folder = pool.stage(rows(("c", 9)))
    assert shown(pool) == [("a", 1), ("a", 2), ("b", 1)]

    def stopped(*_):
        raise OSError("stopped")

    with monkeypatch.context() as m:
        m.setattr(pool, "_hadoop", type("H", (), {"fs": type("F", (), {"Path": pool._hadoop.fs.Path, "FileContext": type("C", (), {"getFileContext": stopped})})}))
        with pytest.raises(OSError, match="stopped"):
            pool.publish(folder, True, pool.number())
    assert shown(pool) == [("a", 1), ("a", 2), ("b", 1)]
    assert pool.publish(folder, True, pool.number()) == 2
    assert shown(pool) == [("c", 9)] and shown(pool, 1) == [("a", 1), ("a", 2), ("b", 1)]


def test_pool_of_several_writers(spark, pool):
    rows = lambda *x: spark.createDataFrame(list(x), POOL)
    pool.save(rows(("a", 1), ("a", 2), ("b", 1)), replace=True)
    seen, mine = pool.number(), pool.stage(rows(("a", 3)))
    pool.save(rows(("d", 1)), replace=False)
    with pytest.raises(Changed):
        pool.publish(mine, False, seen)
    pool.publish(mine, False, pool.number())
    assert shown(pool) == [("a", 3), ("b", 1), ("d", 1)]
    pool.compact()
    assert len(pool.folders(pool.number())) == 1 and shown(pool) == [("a", 3), ("b", 1), ("d", 1)]


def test_pool_is_swept(spark, pool):
    rows = lambda *x: spark.createDataFrame(list(x), POOL)
    pool.save(rows(("a", 1)), replace=True)
    pool.save(rows(("b", 1)), replace=True)
    lost = pool.stage(rows(("c", 1)))
    assert pool.sweep(3600) == []
    gone = pool.sweep(0)
    assert lost in gone and len(gone) == 3 and shown(pool) == [("b", 1)]
    assert pool.save(rows(), replace=True) == 3 and shown(pool) == []


def test_only_stale_documents_are_rendered(spark, pool):
    sources = spark.createDataFrame([("a", 2), ("b", 2), ("c", 2)], POOL)
    pool.save(spark.createDataFrame([("a", 3), ("b", 1)], POOL), replace=True)
    asked = []

    def render(stale):
        asked.append(sorted(r.name for r in stale.collect()))
        if len(asked) == 1:  # another writer is faster
            pool.save(spark.createDataFrame([("c", 5)], POOL), replace=False)
        return stale.select("name", F.lit(5).alias("modified"))

    pool.refresh(sources, render)
    assert asked == [["b", "c"], ["b"]] and shown(pool) == [("a", 3), ("b", 5), ("c", 5)]
    before = pool.number()
    assert pool.refresh(sources, lambda s: s) == before
