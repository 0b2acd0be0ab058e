import random
import time

import numpy as np
import pytest

from lumenline.llm import jaccard
from lumenline.llm.jaccard import jaccard_components, keep_one_of_each, similar_points

from .fixture_docs import SCHEMA, SPACED, words


def plain(rows, k, num, den):
    sets = []
    for r in rows:
        w = words(r[1], SPACED)
        sets.append(frozenset([tuple(w)] if 0 < len(w) < k else [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]))
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and den * both >= num * (len(a) + len(sets[j]) - both):
                up[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)] = min(r[0], least.get(root(i), r[0]))
    return [(r[0], len(s), least.get(root(i)) if s else r[0]) for i, (r, s) in enumerate(zip(rows, sets))], [root(i) for i in range(len(rows))]


def same(got, want):
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in got.collect())


@pytest.mark.parametrize("k, num", [(4, 85), (5, 80), (1, 50)])
def test_against_plain_python(docs, rows, k, num):
    want, _ = plain(rows, k, num, 100)
    assert len({w[2] for w in want}) < len(want) - 10
    same(jaccard_components(docs, k, num, 100), want)


def near_copies(count, seed=3):
    """Copies of one text that drift apart, so that many pairs lie about the threshold, among unlike texts."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    rows = []
    for i in range(count):
        w = list(base if i % 3 else [f"w{rng.randrange(500)}" for _ in range(120)])
        for _ in range(rng.randint(0, 7)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(9)}"
        rows.append((i, " ".join(w)) + (None,) * 10)
    return rows


@pytest.mark.parametrize("home, run", [(1000, 20_000), (7, 20)])
def test_hot_group_of_near_copies(spark, monkeypatch, home, run):
    monkeypatch.setattr(jaccard, "HOME", home)
    monkeypatch.setattr(jaccard, "RUN", run)
    rows = near_copies(150)
    same(jaccard_components(spark.createDataFrame(rows, SCHEMA), 4, 85, 100), plain(rows, 4, 85, 100)[0])


def test_one_of_each_stays(docs, rows):
    kept = keep_one_of_each(docs, 4, 85, 100)
    assert kept.schema == docs.schema
    want, roots = plain(rows, 4, 85, 100)
    groups = {g for g, w in zip(roots, want) if w[1]}
    stays = {w[2] for w in want if w[1] and w[2] is not None}
    got = kept.collect()
    full = [r for r in got if r.text and r.text.split()]
    assert {r.doc_id for r in full if r.doc_id is not None} == stays and len(full) == len(groups)
    assert {r.doc_id for r in got} >= {w[0] for w in want if not w[1]}


def test_empty_and_null(nothing, unknown):
    assert jaccard_components(nothing).count() == 0 and keep_one_of_each(nothing).count() == 0
    assert [(r.n_shingles, r.component_id) for r in jaccard_components(unknown).collect()] == [(0, None)] * 3


@pytest.mark.parametrize("seed", range(3))
def test_tree_finds_all_that_pass_the_bound(seed):
    rng = np.random.default_rng(seed)
    points = np.repeat(rng.poisson(3, (40, 16)), 10, axis=0) + rng.poisson(0.3, (400, 16))
    points = points[np.argsort(points.sum(1), kind="stable")]
    label = rng.integers(0, 5, len(points))
    n = points.sum(1)
    want = {(i, j) for i in range(400) for j in range(i + 1, 400) if label[i] != label[j] and 185 * np.minimum(points[i], points[j]).sum() >= 85 * (n[i] + n[j])}
    got = {(min(i, j), max(i, j)) for i, j in similar_points(points, label, np.zeros(400, int), 85, 100)}
    assert want and want <= got
    part = rng.integers(0, 2, len(points))
    got = {(min(i, j), max(i, j)) for i, j in similar_points(points, label, part, 85, 100)}
    assert got == {(i, j) for i, j in want if part[i] != part[j]}


def test_hot_exact_copies(spark):
    rows = [(i, "one copied text of quite a few words" if i % 2 else f"own words {i} " * 4) + (None,) * 10 for i in range(400)]
    same(jaccard_components(spark.createDataFrame(rows, SCHEMA), 4, 85, 100), plain(rows, 4, 85, 100)[0])


def test_a_shingle_of_many_unconnected_classes(spark, monkeypatch):
    """Thousands of classes share one rare shingle and little else; few of them are alike.."""
    monkeypatch.setattr(jaccard, "RUN", 100)
    rng = random.Random(9)
    rows = []
    for i in range(1500):
        own = [f"v{rng.randrange(40)}" for _ in range(20)] if i % 50 else rows[-1][1].split()[:20] if i else ["a"] * 20
        rows.append((i, " ".join([*own, "one", "shared", "rare", "shingle"])) + (None,) * 10)
    same(jaccard_components(spark.createDataFrame(rows, SCHEMA), 4, 60, 100), plain(rows, 4, 60, 100)[0])


def test_groups_of_the_same_classes_are_sent_once(spark):
    close = spark.createDataFrame([(t, c, 9) for t, c in [(10, 1), (20, 1), (10, 2), (20, 2), (30, 3), (40, 3), (30, 4), (50, 4), (40, 5), (50, 5)]], "token long, cls long, n long")
    join = jaccard.ShingleJoin(spark.createDataFrame([], "doc_id long, text string"), 4, 85, 100)
    assert sorted((r.token, r.cls) for r in join.homes(close).collect()) == [(10, 1), (10, 2), (30, 3), (30, 4), (40, 3), (40, 5), (50, 4), (50, 5)]


def test_sets_and_shuffles_leave_room(spark, tmp_path):
    """A class's set is kept in less room than its hashes, and the shuffles of a table are gone once it is written."""
    from lumenline.llm.common import drop_shuffles, materialize

    rng = random.Random(1)
    base = [rng.choice(["lorem", "ipsum", "dolor", "amet", "tempor", "magna", "veniam"]) + rng.choice("aeiou") for _ in range(600)]
    rows = [(i, " ".join([*base[: 500 + i], f"end{i}"])) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    join = jaccard.ShingleJoin(docs, 4, 85, 100)
    n = {r.cls: r.n for r in join.classes()[0].collect()}
    kept = join.sets(spark.createDataFrame([(c,) for c in n], "cls long")).toPandas()
    assert len(kept) == 20
    assert sum(len(x) for c in kept.columns if c not in ("cls", "point") for x in kept[c]) < 4 * sum(n.values())
    files = lambda: {f for f in map(str, blocks.getAllFiles().mkString(" ").split(" ")) if f.endswith(".data")}
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    before = files()
    moved = materialize(docs.repartition(3, "doc_id"), "moved")
    assert files() - before
    for _ in range(20):  # Spark deletes them some time after the collection that finds them
        drop_shuffles(spark)
        time.sleep(0.2)
        if files() <= before:
            break
    assert files() <= before and moved.count() == 20


def test_points_of_any_size_are_packed():
    own = [np.arange(8, dtype=np.uint64), np.zeros(300, np.uint64), np.zeros(70_000, np.uint64)]
    packed = [jaccard.point_of(x, 8) for x in own]
    assert [len(p) for p in packed] == [8, 16, 32]
    assert jaccard.points_from(packed, 8).sum(1).tolist() == [8, 300, 70_000]
