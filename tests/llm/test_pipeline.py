import corpus_pipeline
from lumenline.llm import registry

from .fixture_docs import SCHEMA
from .test_decontamination import ITEM, plain as hits
from .test_linededup import plain as later_lines
from .test_toxicity import LABEL, corpus


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES if n.startswith("op")) == list(range(1, 14))
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "packing"]


def test_stages_against_plain_python(spark, tmp_path):
    rows, labels = corpus(600)
    line = "a line of some length that many of the documents share"
    rows = [(i, f"{t}\n{line}" if i % 5 == 1 else t, *x) for i, t, *x in rows]
    copy = rows[9][1].split(" ")
    copy[5] = "other"
    items = [(1, " ".join(rows[17][1].split()[8:22]), "x")]
    rows += [(1000, " ".join(copy)) + (None,) * 10, (1001, rows[9][1]) + (None,) * 10, (1002, None) + (None,) * 10]
    d = str(tmp_path)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, LABEL).write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(items, ITEM).write.parquet(f"{d}/benchmark.parquet")
    seen = {}
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, d)
        if name != "packing":
            assert out.schema.fieldNames() == docs.schema.fieldNames()
        out.write.parquet(f"{d}/{name}")
        docs = spark.read.parquet(f"{d}/{name}")
        seen[name] = docs.collect()
    toxic = {i for i, _, t, _ in labels if t}
    assert {r.doc_id for r in seen["toxicity"]} == {r[0] for r in rows} - toxic
    left = [tuple(r) for r in seen["toxicity"]]
    gone = later_lines(left, 30)
    texts = {r[0]: r[1] for r in left}
    for r in seen["line dedup"]:
        t = texts[r.doc_id]
        assert r.text == (None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone.get(r.doc_id, [])))
    near = {r.doc_id for r in seen["n-gram Jaccard join"]}
    assert 9 in near and 1000 not in near and 1002 in near and near >= {r.doc_id for r in seen["line dedup"]} - {1000, 1001}
    clean = {x[0] for x in hits([tuple(r) for r in seen["n-gram Jaccard join"]], items) if not x[-1]}
    assert {str(r.doc_id) for r in seen["benchmark decontamination"]} == clean and "17" not in clean
    assert {str(r.doc_id) for r in seen["packing"]} == clean
    whole = sorted(map(tuple, corpus_pipeline.run(spark, d).collect()), key=str)
    assert whole == sorted(map(tuple, seen["packing"]), key=str)


def test_stages_keep_columns_of_any_name(spark):
    from lumenline.llm.jaccard import keep_one_of_each
    from lumenline.llm.linededup import dedup_lines, without_later_lines

    names = ["__copy", "__removed", "__n_lines", "__gone", "__row", "row", "rest", "place", "own_id", "text_hash", "__stay_id"]
    schema = "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names)
    long = " ".join(f"word{i}" for i in range(40))
    rows = [(1, long, *["keep"] * 11), (2, long, *["me"] * 11), (3, "other words\nother words", *["x"] * 11), (3, "other words\nother words", *["y"] * 11), (4, None, *["z"] * 11)]
    docs = spark.createDataFrame(rows, schema)
    got = sorted(map(tuple, without_later_lines(docs).collect()), key=str)
    assert [r[2:] for r in got] == sorted((r[2:] for r in rows), key=lambda x: [str(y) for y in rows if y[2:] == x])
    assert {r.doc_id: r["__removed"] for r in dedup_lines(docs.where("doc_id = 1")).collect()} == {1: []}
    kept = [sorted(map(tuple, keep_one_of_each(docs.repartition(n, *by)).collect()), key=str) for n, by in ((1, []), (3, ["__copy"]), (4, ["doc_id"]))]
    assert kept[0] == kept[1] == kept[2]
    assert [r[0] for r in kept[0]] == [1, 3, 4] and kept[0][0] == rows[0] and kept[0][1] in rows[2:4]


def test_stages_leave_no_index_and_few_tables(spark, tmp_path):
    """What a caller holds of a stage, while the next one runs, is a table: the driver has room for neither the index nor all that led to it."""
    from lumenline.llm import common
    from lumenline.llm.linededup import without_later_lines
    from lumenline.llm.toxicity import drop_toxic

    rows, labels = corpus(600)
    d = str(tmp_path)
    labels = spark.createDataFrame(labels, LABEL)
    labels.write.parquet(f"{d}/labels.parquet")
    docs = spark.createDataFrame(rows, SCHEMA)
    new = lambda: [p.rpartition("/")[2].rpartition("-")[0] for p in common._scratch[len(before) :]]
    before = list(common._scratch)
    kept = corpus_pipeline.toxicity(spark, docs, d)
    assert new() == ["not-toxic"]
    assert "MapInArrow" not in kept._jdf.queryExecution().toString()
    assert sorted(map(tuple, kept.collect()), key=str) == sorted(map(tuple, drop_toxic(docs, labels).collect()), key=str)
    before = list(common._scratch)
    lines = without_later_lines(kept)
    assert new() == ["removed-lines"]
    assert lines._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    assert lines.count() == kept.count()


def test_stages_of_nothing(spark, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([], SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], LABEL).write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([], ITEM).write.parquet(f"{d}/benchmark.parquet")
    assert corpus_pipeline.run(spark, d).collect() == []
