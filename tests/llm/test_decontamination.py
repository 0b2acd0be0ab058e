import hashlib

import pytest

from lumenline.llm.decontamination import drop_contaminated, mark_contamination

from .fixture_docs import FOLDED, SCHEMA, words

ITEM = "item_id long, text string, doc_id string"


@pytest.fixture(scope="module")
def items(rows):
    texts = [r[1] for r in rows if r[1] and len(r[1].split()) > 30]
    own = [" ".join(t.split()[3:25]).upper() for t in texts[:4]] + ["ONE, two!", "", None, "...", " ".join(texts[5].split()[:10]), " ".join(texts[6].split()[:11]) + " zzz", "same " * 12]
    return [(i, t, "d") for i, t in enumerate(own)] + [(3, own[3], "d"), (None, own[0], "d"), (10_000, own[0], "d")]


def plain(rows, items, window=10):
    found = {}
    for item, text, _ in items:
        w = words(text, FOLDED)
        if item is not None:
            for x in [tuple(w)] if 0 < len(w) < window else [tuple(w[i : i + window]) for i in range(len(w) - window + 1)]:
                found.setdefault(x, set()).add(str(item))
    out = []
    for r in rows:
        w, hit, own = words(r[1], FOLDED), set(), set()
        for x, of in found.items():
            for i in range(len(w) - len(x) + 1):
                if tuple(w[i : i + len(x)]) == x:
                    hit.update(range(i, i + len(x)))
                    own |= of
        out.append((str(r[0]), len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


@pytest.mark.parametrize("most", [200_000, 7])
def test_against_plain_python(spark, docs, rows, items, most):
    got = mark_contamination(docs, spark.createDataFrame(items, ITEM), most_broadcast=most)
    want = plain(rows, items)
    assert any(r[-1] for r in want)
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got.collect()) == want


@pytest.mark.parametrize("most", [200_000, 7])
def test_filter_keeps_columns(spark, docs, rows, items, most):
    kept = drop_contaminated(docs, spark.createDataFrame(items, ITEM), most_broadcast=most)
    assert kept.schema == docs.schema
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(x[0] for x in plain(rows, items) if not x[-1])


def test_empty_and_null(spark, docs, rows, nothing, unknown, items):
    none = spark.createDataFrame([], ITEM)
    assert mark_contamination(nothing, spark.createDataFrame(items, ITEM)).count() == 0
    assert not any(r.contaminated for r in mark_contamination(docs, none).collect())
    assert drop_contaminated(docs, none).count() == len(rows)
    assert [r.n_words for r in mark_contamination(unknown, spark.createDataFrame([(None, None, None)], ITEM)).collect()] == [0, 0, 0]


def test_hot_passage(spark):
    passage = " ".join(f"w{i}" for i in range(15))
    docs = spark.createDataFrame([(i, (passage if i % 3 == 0 else "common words only") + f" tail {i}") + (None,) * 10 for i in range(900)], SCHEMA)
    for most in (200_000, 0):
        got = mark_contamination(docs, spark.createDataFrame([(1, passage, "")], ITEM), most_broadcast=most)
        assert {r.doc_id for r in got.where("contaminated and n_hit = 15").collect()} == set(range(0, 900, 3))


def test_a_large_benchmark_is_not_collected(spark, monkeypatch):
    """Of a benchmark that isn't broadcast, no window reaches the driver, and both ways give the same rows."""
    texts = [" ".join(f"w{(i * j) % 997}" for j in range(1, 40)) for i in range(1, 200)]
    docs = spark.createDataFrame([(i, t) + (None,) * 10 for i, t in enumerate(texts)], SCHEMA)
    items = spark.createDataFrame([(i, " ".join(t.split()[i % 7 : 12 + i % 20]), "") for i, t in enumerate(texts) if i % 4], ITEM)
    want = sorted(map(str, mark_contamination(docs, items).collect()))
    monkeypatch.setattr("lumenline.llm.decontamination.small_index", None)
    assert sorted(map(str, mark_contamination(docs, items, most_broadcast=100).collect())) == want
