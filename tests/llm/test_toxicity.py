import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest

from lumenline.llm.toxicity import FOLDS, HELD_OUT, ExampleIndex, Searcher, TermSpace, Vectors, drop_toxic, fit, on_curve, op10_nearest_examples, score_documents

from .fixture_docs import FOLDED, LOWER, SCHEMA

LABEL = "doc_id long, quality int, toxic int, text string"
INSULTS = ["vilexx", "grubxx", "slimexx", "rottenxx"]


def corpus(n=1500, seed=2):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(3000)]
    rows, labels = [], []
    for i in range(n):
        w, toxic = [rng.choice(vocab) for _ in range(60)], int(i % 8 == 0)
        for _ in range(rng.randint(2, 5) * toxic):
            w[rng.randrange(60)] = rng.choice(INSULTS)
        rows.append((i, " ".join(w)) + (None,) * 10)
        labels.append((i, 1, toxic, "extra"))
    return rows, labels


@pytest.fixture(scope="module")
def fitted(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    return docs, dict((i, t) for i, _, t, _ in labels), fit(docs, spark.createDataFrame(labels, LABEL))


def test_held_out_accuracy(fitted):
    docs, toxic, index = fitted
    held = [r for r in score_documents(docs, index).collect() if zlib.crc32(str(r.doc_id).encode()) % FOLDS == HELD_OUT]
    assert len(held) > 200 and all(r.predicted == toxic[r.doc_id] and 0 <= r.score <= 1 for r in held)
    assert all(r.evidence for r in held if r.predicted) and all(zlib.crc32(str(e).encode()) % FOLDS != HELD_OUT for r in held for e in r.evidence)


class Plain:
    """The model from texts in plain Python, without an index."""

    def __init__(self, texts, labels):
        self.words = {i: re.findall(FOLDED, (t or "").translate(LOWER)) for i, t in texts.items()}
        self.n = len(texts)
        self.df = Counter(w for own in self.words.values() for w in set(own))
        self.known = {i: t for i, t in labels.items() if i in texts and zlib.crc32(str(i).encode()) % FOLDS != HELD_OUT}
        sizes = Counter(self.known.values())
        seen = {1: Counter(), 0: Counter()}
        for i, t in self.known.items():
            seen[t].update(self.marks(self.words[i]).keys())
        self.markers = {}
        for m in seen[1]:
            p, q = seen[1][m], seen[0][m]
            if p >= 3 and p * sizes[0] > 3 * q * sizes[1] and self.ratio(p, q, sizes[1], sizes[0]) >= 30:
                self.markers[m] = math.log((1 + self.n_known) / (1 + p + q)) + 1
        self.share = sizes[1] / self.n_known
        total = {t: 1.0 for t in (0, 1)}  # every labelled row is in the sample
        self.weight = {t: total[t] / min(total.values()) for t in total}
        self.vectors = {i: self.vector(self.words[i]) for i in self.known}

    @property
    def n_known(self):
        return len(self.known)

    @staticmethod
    def ratio(p, q, n, m):
        total = (p + q) / (n + m)
        term = lambda k, of: (k * math.log(k / (of * total)) if k else 0) + ((of - k) * math.log((of - k) / (of * (1 - total))) if k < of else 0)
        return 2 * (term(p, n) + term(q, m))

    @staticmethod
    def marks(own):
        out = Counter(own)
        for w in own:
            out.update((w.encode()[:k], "*") for k in (4, 6) if len(w.encode()) > k)
        return out

    def vector(self, own):
        raw = {w: (1 + math.log(k)) * (math.log((1 + self.n) / (1 + self.df[w])) + 1) for w, k in Counter(own).items()}
        found = {m: k for m, k in self.marks(own).items() if m in self.markers}
        marks = {("m", m): (1 + math.log(k)) * self.markers[m] for m, k in found.items()}
        marks["rest"] = 1 + round(2 * math.log2(max(1, len(own) - max(found.values(), default=0)))) / 2 * math.log(2)
        out = {}
        for part in (raw, marks):
            length = math.sqrt(2 * sum(x * x for x in part.values()))
            out.update({k: x / length for k, x in part.items()})
        return out

    def vote(self, own, without=None, neighbours=15):
        q = self.vector(own)
        near = sorted((-round(sum(x * v.get(k, 0) for k, x in q.items()), 6), i) for i, v in self.vectors.items() if i != without)[:neighbours]
        votes = [(self.weight[self.known[i]] / (1.05 + c) ** 2, self.known[i]) for c, i in near]
        return (sum(x * t for x, t in votes) + self.share) / (sum(x for x, _ in votes) + 1), [i for _, i in near]


@pytest.fixture(scope="module")
def small(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(250)]
    texts, labels = {}, {}
    for i in range(400):
        w, labels[i] = [rng.choice(vocab) for _ in range(rng.randint(5, 50))], int(i % 5 == 0)
        for _ in range(rng.randint(0, 4) * labels[i]):
            w[rng.randrange(len(w))] = rng.choice(INSULTS) + rng.choice(["", "es"])
        texts[i] = " ".join(w)
    texts |= {1000: texts[5] + " Grubxx!", 1001: "w1 W1 w2", 1002: "unknown words only", 1003: " ".join(vocab * 40)}
    docs = spark.createDataFrame([(i, t) + (None,) * 10 for i, t in texts.items()], SCHEMA)
    frame = spark.createDataFrame([(i, 1, t, None) for i, t in labels.items()], LABEL)
    return docs, frame, Plain(texts, labels), fit(docs, frame)


def test_scores_against_plain_python(small):
    docs, _, plain, index = small
    assert len(index.space.markers) == len(plain.markers) > 3 and list(index.ids) == sorted(plain.known)
    for r in score_documents(docs, index).collect():
        vote, near = plain.vote(plain.words[r.doc_id])
        assert abs(r.score - on_curve(vote, index.curve)) < 1e-4 and r.evidence == near[:3]
    slope, shift = index.curve
    votes = np.array([plain.vote(plain.words[i], without=i)[0] for i in sorted(plain.known)])
    toxic = np.array([plain.known[i] for i in sorted(plain.known)])
    n = toxic.sum()
    want = np.where(toxic == 1, (n + 1) / (n + 2), 1 / (len(toxic) - n + 2))
    error = 1 / (1 + np.exp(-(slope * np.log(votes / (1 - votes)) + shift))) - want
    assert abs(error.sum()) < 0.05 and abs(error @ np.log(votes / (1 - votes))) < 0.1 and slope > 0  # the curve's loss is least


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_partitions_do_not_matter(small, parts, spark):
    docs, labels, _, index = small
    copies = docs.where("doc_id < 60").selectExpr("doc_id + 5000 as doc_id", "concat(text, ' w3') as text", *docs.columns[2:])
    both = docs.union(copies)
    more = labels.union(labels.where("doc_id < 60").selectExpr("doc_id + 5000", "quality", "toxic", "text"))
    got = [sorted(map(tuple, score_documents(d, fit(d, m)).collect())) for d, m in ((both, more), (both.repartition(parts, "n_chars", "text"), more.repartition(parts)))]
    assert got[0] == got[1]


def test_neighbours_are_exact(fitted):
    _, _, index = fitted
    searcher, rng = Searcher(index), random.Random(7)
    dense = np.zeros((len(index.toxic), index.space.size))
    dense[index.rows.doc, index.rows.term] = index.rows.value
    texts = [" ".join(rng.choice([*INSULTS, *(f"w{i}" for i in range(rng.choice([3, 3000])))]) for _ in range(rng.randint(1, 90))).encode() for _ in range(150)]
    for n_words, _, words, starts in searcher.scan.tallies(texts):
        queries = index.space.vectors(n_words, words, starts)
        for i, (at, cosine) in enumerate(searcher.nearest(queries, index.neighbours)):
            q = np.zeros(index.space.size)
            q[queries.row(i)[0]] = queries.row(i)[1]
            assert np.allclose(cosine, np.sort(dense @ q)[::-1][: index.neighbours]) and np.allclose(dense[at] @ q, cosine)
    assert searcher.blocks_scored <= searcher.blocks_bounded


def test_only_similar_examples_count_once(spark):
    rng = random.Random(3)
    licence = "licensed under the terms that stand in the file beside this one"
    text = lambda: " ".join(f"w{rng.randrange(3000)}" for _ in range(80))
    near = text()
    rows = [(i, f"{text()} {licence}") for i in range(300)] + [(1000 + i, f"{near} x{i}") for i in range(100)]
    docs = spark.createDataFrame([r + (None,) * 10 for r in rows], SCHEMA)
    labels = spark.createDataFrame([(i, 1, i % 2, None) for i, _ in rows], LABEL)
    ids = list(fit(docs, labels).ids)
    learned = [i for i, _ in rows if zlib.crc32(str(i).encode()) % FOLDS != HELD_OUT]
    assert [i for i in ids if i < 300] == [i for i in learned if i < 300]
    assert len([i for i in ids if i >= 1000]) < 20 and min(i for i in learned if i >= 1000) in ids


def test_columns_of_all_names_and_ids_of_all_types(spark):
    rows, labels = corpus(300)
    odd = ["toxic", "sketch", "text_hash", "n_words", "words", "term", "value", "start", "pos", "score", "__id"]
    docs = spark.createDataFrame([(f"d{r[0]}", r[1], *range(len(odd))) for r in rows], f"doc_id string, text string, {', '.join(f'{c} int' for c in odd)}")
    labels = spark.createDataFrame([(f"d{i}", t) for i, _, t, _ in labels], "doc_id string, toxic int")
    kept = drop_toxic(docs, labels)
    assert kept.columns == docs.columns and 0 < kept.count() < 300
    assert all(isinstance(e, str) for r in score_documents(docs, fit(docs, labels)).collect() for e in r.evidence)


def test_held_out_labels_are_not_learned(spark):
    rows, labels = corpus(400)
    docs = spark.createDataFrame(rows, SCHEMA)
    turned = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % FOLDS == HELD_OUT else t, x) for i, q, t, x in labels]
    one, two = (sorted(map(tuple, score_documents(docs, fit(docs, spark.createDataFrame(x, LABEL))).select("doc_id", "score").collect())) for x in (labels, turned))
    assert one == two


def test_a_copied_toxic_text_does_not_make_its_words_toxic(spark):
    rows, labels = corpus(800)
    rows += [(10_000 + i, rows[0][1]) + (None,) * 10 for i in range(400)]
    labels += [(10_000 + i, 1, 1, "") for i in range(400)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r.predicted for r in score_documents(docs, fit(docs, spark.createDataFrame(labels, LABEL))).collect()}
    assert all(got[i] == t for i, _, t, _ in labels)


def test_filter(fitted, spark):
    docs, toxic, _ = fitted
    labels = spark.createDataFrame([(i, 1, t, None) for i, t in toxic.items()] + [(None, 1, 1, None), (5, 1, None, None)], LABEL)
    kept = drop_toxic(docs, labels)
    assert kept.schema == docs.schema and {r.doc_id for r in kept.collect()} == {i for i, t in toxic.items() if not t}


def test_awkward_rows(docs, rows, spark):
    labels = spark.createDataFrame([(r[0], 1, int(i % 9 == 0), None) for i, r in enumerate(rows)], LABEL)
    got = score_documents(docs, fit(docs, labels)).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in rows) and all(0 <= r.score <= 1 for r in got)


@pytest.mark.parametrize("labels, score", [([], 0.0), ([(1, 1, 0, None)], 0.0), ([(1, 1, 1, None)], 1.0)])
def test_labels_of_one_kind(spark, labels, score):
    docs = spark.createDataFrame([(1, "a b") + (None,) * 10, (2, None) + (None,) * 10], SCHEMA)
    assert {r.score for r in score_documents(docs, fit(docs, spark.createDataFrame(labels, LABEL))).collect()} == {score}


def test_empty_and_null(spark, nothing, unknown, fitted):
    assert score_documents(nothing, fitted[2]).count() == 0
    assert len(score_documents(unknown, fitted[2]).collect()) == 3
    assert fit(nothing, spark.createDataFrame([(None, None, None, None)], LABEL)).prior == 0.0


def test_query_marks_held_out_rows(spark):
    rows = op10_nearest_examples(spark, "/root/testdata/sf0.001").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows) and len(rows) == 200


def test_copy_of_a_toxic_text_without_frequent_words(spark):
    rows, labels = corpus(600)
    rng = random.Random(11)
    texts = [" ".join(rng.choice([f"w{i}" for i in range(3000)]) for _ in range(60)) for _ in range(3)]
    own = [i for i in range(5_000, 5_100) if zlib.crc32(str(i).encode()) % FOLDS != HELD_OUT][:3]
    rows += [(i, t) + (None,) * 10 for i, t in zip(own, texts)] + [(i + 1_000, t) + (None,) * 10 for i, t in zip(own, texts)]
    labels += [(i, 1, 1, "") for i in own]
    docs = spark.createDataFrame(rows, SCHEMA)
    index = fit(docs, spark.createDataFrame(labels, LABEL))
    got = {r.doc_id: r for r in score_documents(docs, index).collect()}
    for i in own:
        assert got[i + 1_000].predicted == 1 and got[i + 1_000].evidence[0] == i
    assert sorted(index.ids) == sorted(i for i, *_ in labels if zlib.crc32(str(i).encode()) % FOLDS != HELD_OUT)
    assert all(r.evidence for r in got.values())


def test_an_index_is_made_ready_in_little_more_than_its_own_memory():
    """Two workers of an executor do so at the same time, beside a JVM that gives nothing back."""
    rng = np.random.default_rng(4)
    n, vocab = 6000, 4000
    cell = np.unique(np.repeat(np.arange(n), 300) * vocab + np.minimum(rng.pareto(0.6, 300 * n) * 20, vocab - 1).astype(np.int64))
    doc, term = np.divmod(cell, vocab)
    rows = Vectors(np.searchsorted(doc, np.arange(n + 1)), term.astype(np.int32), rng.random(len(term)).astype(np.float32))
    space = TermSpace(np.arange(vocab - 1, dtype=np.uint64), np.zeros(0, np.uint64), np.zeros(0), np.ones(1, np.float32))
    index = ExampleIndex(space, 0.1, 5, toxic=np.zeros(n), ids=np.arange(n), weight=np.ones(n), rows=rows)
    Searcher(ExampleIndex(space, 0.1, 5, toxic=np.zeros(40), ids=np.arange(40), weight=np.ones(40), rows=rows.part(0, 40)))
    tracemalloc.start()
    searcher = Searcher(index)
    own, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert most < 1.5 * own
    every = np.zeros((n, vocab), np.float32)
    every[doc, term] = rows.value
    for i in (0, 511, 512, 5999):
        at, x = rows.row(i)
        (near, cosine), = searcher.nearest(Vectors(np.array([0, len(at)]), at.astype(np.int64), x.astype(float)), 5)
        want = np.sort(every.astype(float) @ every[i])[::-1][:5]
        assert near[0] == i or cosine[0] >= want[0] - 1e-9
        assert np.allclose(cosine, want)
