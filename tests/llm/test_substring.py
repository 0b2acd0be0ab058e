import hashlib
from decimal import Decimal

import numpy as np
import pytest

from lumenline.llm import substring
from lumenline.llm.common import RollingHash, WordScan
from lumenline.llm.substring import remove_repeats, sliding

from .fixture_docs import SCHEMA, SPACED, words


def plain(rows, window=20):
    known = lambda i: -(2**63) if i is None else i
    first = {}
    texts = [(known(r[0]), words(r[1], SPACED, lower=False), r) for r in rows]
    for i, w, _ in sorted(texts, key=lambda x: x[0]):
        for s in range(len(w) - window + 1):
            x = tuple(w[s : s + window])
            first[x] = min(first.get(x, (i, s)), (i, s))
    out = []
    for i, w, r in texts:
        gone = set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < (i, s):
                gone.update(range(s, s + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((str(r[0]), len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def same(got, want):
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()) == want


@pytest.mark.parametrize("window, combine", [(20, 1_000_000), (20, 50), (3, 1_000_000), (2, 300)])
def test_against_plain_python(docs, rows, monkeypatch, window, combine):
    monkeypatch.setattr(substring, "COMBINE", combine)
    want = plain(rows, window)
    assert sum(r[2] for r in want) > 500
    same(remove_repeats(docs, window), want)


def test_full_filter_gives_the_same(docs, rows, monkeypatch):
    monkeypatch.setattr(substring, "hash_filter", lambda hashes: np.full((1 << substring.FILTER_BITS) // 8, 255, np.uint8))
    same(remove_repeats(docs), plain(rows))


@pytest.mark.parametrize("kind, name", [("string", lambda i: f"d{i}"), ("double", lambda i: i / 4), ("decimal(30,2)", lambda i: Decimal(i) * 10**20)])
def test_ids_of_other_types(spark, rows, kind, name):
    own = [(None if r[0] is None else name(r[0]), r[1], 7, "x") for r in rows]
    docs = spark.createDataFrame(own, f"doc_id {kind}, text string, place int, own string")
    order = {x: i for i, x in enumerate(sorted({r[0] for r in own} - {None}))} | {None: None}
    got = remove_repeats(docs.repartition(3))
    assert got.schema["doc_id"].dataType == docs.schema["doc_id"].dataType
    assert sorted((str(order[r.doc_id]), r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()) == plain([(order[r[0]], r[1]) for r in own])


def test_texts_and_intervals(docs):
    for r in remove_repeats(docs, with_text=True).collect():
        assert sum(e - s for s, e in r.intervals) == r.n_removed
        assert hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256


def test_hot_passage(spark):
    passage = " ".join(f"w{i}" for i in range(55))
    rows = [(i, (f"own {i} {i * 3} " * 3) + (passage if i % 3 == 0 else f"tail {i}")) + (None,) * 10 for i in range(900)]
    same(remove_repeats(spark.createDataFrame(rows, SCHEMA).repartition(5)), plain(rows))


def test_empty_and_null(nothing, unknown):
    assert remove_repeats(nothing).count() == 0
    assert [(r.n_words, r.n_removed) for r in remove_repeats(unknown).collect()] == [(0, 0)] * 3


def test_sliding():
    a = np.array([5, 3, 8, 1, 9, 2, 7])
    for k in range(1, 8):
        assert sliding(np.minimum, a, k).tolist() == [min(a[i : i + k]) for i in range(8 - k)]


def test_rolling_hashes():
    r = RollingHash()
    h = np.array([1, 2, 3, 1, 2, 3, 2**63, 7], np.uint64)
    w = r.windows(r.prefix(h), 3)
    assert w[0] == w[3] and len(set(w.tolist())) == 5


def test_word_scan(monkeypatch):
    texts = ["a b  c\n", None, "", "ä " * 500, "x" * 200 + " y", "  z"]
    whole = [(c.tolist(), h.tolist()) for _, c, h in WordScan().chunks([t and t.encode() for t in texts])]
    monkeypatch.setattr(WordScan, "PIECE", 16)
    parts = list(WordScan().chunks([t and t.encode() for t in texts]))
    assert [c for p in parts for c in p[1].tolist()] == whole[0][0] == [3, 0, 0, 500, 2, 2]
    assert [h for p in parts for h in p[2].tolist()] == whole[0][1]
