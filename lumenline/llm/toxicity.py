"""Toxicity by the nearest labelled examples under exact TF-IDF cosine, from a block-max inverted index of whole texts.

The model is fitted on a bounded sample of labelled rows (at most ``per_class`` of either label, the
smallest by hash). Of examples of one label that are nearly equal (two equal min-hashes of five-word shingles,
and 0.8 of their words in common with the group's first), the one of the smallest doc_id stays. A text is two
unit vectors side by side, each of half the weight: the TF-IDF vector of all its words, with their document
frequencies in all of ``docs`` (counted by hash in a table of fixed size), and, as an addition, that of its
markers, the words and beginnings of words that toxic examples have significantly more often, with one more
coordinate for all other words that tells how dense the markers are. Every example with a word is in the
index, and every text with a word is searched.

Examples lie in blocks of similar ones. Rare terms are scored by their lists; the largest weight of each
frequent term in a block bounds what a block can still reach, and blocks that can't reach a text's nearest
neighbours are not scored. What may be among the nearest is scored again in double precision, which makes
the neighbours exact; ties go to the smaller doc_id.

The neighbours vote with weights that fall with distance, scaled to the labels' shares, beside one unit of the
labels' share of toxic rows. A logistic curve turns votes into scores; it is fitted to the votes that at most
``calibrate`` examples of either label get from the others. The nearest examples are given as evidence.

The fit does not depend on the order or partitions of the rows. A text without words, an empty or a null one
gets the labels' share of toxic rows, as do all texts where a label has no example with a word (0 without any
labelled row). A doc_id labelled more than once is toxic if any label says so; null labels and ids are ignored.
Repeated documents are scored one by one, very long texts whole. An empty table gives an empty result. Other
columns are ignored by scores and passed on by the filter.
"""

from __future__ import annotations

import ctypes
import math
import os
import threading
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import FOLD, WordScan, discard, drop_shuffles, filter_texts, give_back, map_texts, materialize, mix, read, texts_of
from .jaccard import ShingleScan, overlap

#: Lengths in bytes of the word beginnings that can be markers.
BEGINNINGS = (4, 6)
#: Bits of the hashed table of document frequencies, and the blocks it is summed in.
DF_BITS, DF_BLOCKS = 22, 16
#: Terms of this share of the examples are scored as a dense matrix; texts that are scored at once.
DENSE, AT_ONCE = 0.05, 64
#: Examples of a block whose maxima bound it, and blocks that are scored together.
BLOCK, TOGETHER = 16, 16
#: Examples that go into an index at once.
EXAMPLES = 512

#: Rows with this remainder of crc32(doc_id as text) modulo FOLDS are held out.
FOLDS, HELD_OUT = 5, 0

NO_LONGS = np.zeros(0, np.int64)


def fold(doc_id) -> F.Column:
    return F.crc32(F.col(doc_id).cast("string")) % FOLDS


def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, toxic, text_hash, text) of the sample, and the number of labelled rows by label; held-out rows are in neither."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (fold("doc_id") != HELD_OUT))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    parts = [known.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for t in (0, 1)]
    sample = parts[0].union(parts[1]).withColumnsRenamed({"doc_id": "__id", "toxic": "__toxic"})
    # At most 2 x per_class pairs of numbers are broadcast.
    found = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("__id"))
    return found.select("doc_id", F.col("__toxic").cast("int").alias("toxic"), F.xxhash64("text").alias("text_hash"), "text"), total


class TermScan(WordScan):
    """Hashes of words, each beside those of its beginnings (0 where it isn't longer)."""

    def __init__(self):
        super().__init__(FOLD)

    def _piece(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        prefix, start, end = self._spans(text)
        columns = [self._hashes(text, prefix, start, end)]
        for n in BEGINNINGS:
            longer = end - start > n
            columns.append(np.zeros(len(start), np.uint64))
            columns[-1][longer] = mix(self.rolling.stretches(prefix, start[longer], start[longer] + n) ^ np.uint64(n << 32))
        return start, np.stack(columns, 1)

    def tallies(self, texts: list[bytes | None]) -> Iterator[tuple[np.ndarray, np.ndarray, Tally, Tally]]:
        """(numbers of words, word hashes in order, how often each word, and each beginning, stands in each) of some whole texts at a time."""
        for index, n_words, hashes in self.chunks(texts):
            hashes = hashes.reshape(-1, 1 + len(BEGINNINGS))
            doc = np.repeat(np.arange(len(index)), n_words)
            parts = [(doc[has], column[has]) for column in hashes.T[1:] for has in (column != 0,)]
            starts = Tally.of(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            yield n_words, hashes[:, 0], Tally.of(doc, hashes[:, 0]), starts


@dataclass
class Tally:
    """Distinct keys of texts with their counts, by text and by key; a key is its place among the sorted ``kinds``."""

    doc: np.ndarray
    kind: np.ndarray
    count: np.ndarray
    kinds: np.ndarray

    @classmethod
    def of(cls, doc: np.ndarray, keys: np.ndarray, counts: np.ndarray | None = None) -> Tally:
        kinds, at = np.unique(keys, return_inverse=True)
        if counts is not None:
            return cls(doc, at, counts, kinds)
        cell, count = np.unique(doc * len(kinds) + at, return_counts=True)
        return cls(*np.divmod(cell, max(1, len(kinds))), count, kinds)

    def packed(self, n: int) -> tuple[list[bytes], list[bytes]]:
        """Keys and counts of each of n texts."""
        cut = np.searchsorted(self.doc, np.arange(n + 1))
        keys, counts = self.kinds[self.kind], self.count.astype(np.uint32)
        return [[x[s:e].tobytes() for s, e in zip(cut[:-1], cut[1:], strict=True)] for x in (keys, counts)]

    @classmethod
    def unpacked(cls, keys: list[bytes], counts: list[bytes]) -> Tally:
        doc = np.repeat(np.arange(len(keys)), [len(x) // 8 for x in keys])
        return cls.of(doc, np.frombuffer(b"".join(keys), np.uint64), np.frombuffer(b"".join(counts), np.uint32).astype(np.int64))


def sketches(hashes: np.ndarray, n_words: np.ndarray) -> list[int]:
    """The two smallest hashes, by two orders, of each text's five-word shingles, as one number; near copies mostly share it."""
    out, at = [], 0
    for n in n_words.tolist():
        own = ShingleScan._combine(hashes[at : at + n], min(n, 5)) if n else np.zeros(1, np.uint64)
        both = mix(own.min() ^ mix(mix(own ^ np.uint64(1)).min()))
        out.append(int(both >> np.uint64(1)))
        at += n
    return out


def example_tables(sample: DataFrame) -> DataFrame:
    """(doc_id, toxic, text_hash, n_words, words, counts, starts, start_counts): hashes and counts of each example's words and beginnings."""
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in sample.schema.fields[:3])
    schema = f"{kinds}, n_words long, words binary, counts binary, starts binary, start_counts binary, sketch long"
    names = [part.split(" ")[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = TermScan()
        for batch in batches:
            columns = [[] for _ in range(6)]
            for n_words, hashes, words, starts in scan.tallies(texts_of(batch.column(3))):
                n = len(n_words)
                for column, x in zip(columns, (n_words.tolist(), *words.packed(n), *starts.packed(n), sketches(hashes, n_words)), strict=True):
                    column += x
            types = [pa.int64(), *[pa.binary()] * 4, pa.int64()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names)

    def first_of_copies(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("text_hash", "ascending")])
        own = [np.frombuffer(x, np.uint64) for x in table["words"].to_pylist()]
        first = own[0]
        apart = [5 * (both := overlap(first, x)) < 4 * (len(first) + len(x) - both) for x in own[1:]]
        return table.filter(pa.array([True, *apart])).drop_columns(["sketch"])

    rows = sample.mapInArrow(run, schema).where("n_words > 0")
    return rows.groupBy("toxic", "sketch").applyInArrow(first_of_copies, schema.rsplit(",", 1)[0])


def corpus_idf(docs: DataFrame) -> np.ndarray:
    """Inverse document frequencies over all rows of ``docs``, by the first DF_BITS bits of a word's hash."""
    shift, cells = np.uint64(64 - DF_BITS), 1 << DF_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, scan = np.zeros(cells, np.uint32), WordScan(FOLD)
        for batch in batches:
            for index, n_words, hashes in scan.chunks(texts_of(batch.column(0))):
                own = np.unique((np.repeat(np.arange(len(index)), n_words) << DF_BITS) | (hashes >> shift).astype(np.int64))
                np.add.at(counts, own & (cells - 1), np.uint32(1))
        packed = [(i, zlib.compress(p.astype("<u4").tobytes(), 1)) for i, p in enumerate(counts.reshape(DF_BLOCKS, -1)) if p.any()]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in packed], pa.int32()), pa.array([x for _, x in packed], pa.binary())], ["block", "counts"])

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells // DF_BLOCKS, np.int64)
        for batch in batches:
            for c in batch.column(1):
                total += np.frombuffer(zlib.decompress(c.as_py()), "<u4")
        packed = zlib.compress(np.minimum(total, 2**32 - 1).astype("<u4").tobytes(), 1)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([packed], pa.binary())], ["block", "counts"])

    n = docs.count()
    idf = np.full((DF_BLOCKS, cells // DF_BLOCKS), math.log(1 + n) + 1, np.float32)
    rows = docs.select("text").mapInArrow(run, "block int, counts binary").groupBy("block").applyInArrow(add, "block int, counts binary")
    for r in rows.collect():  # 16 MB in all, before they are compressed
        idf[r.block] = np.log((1 + n) / (1.0 + np.frombuffer(zlib.decompress(r.counts), "<u4"))) + 1
    return idf.ravel()


def associated(pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int) -> np.ndarray:
    """Log-likelihood ratio of words in pos of n_pos toxic and neg of n_neg other examples; 0 where those are the less frequent."""
    total = (pos + neg) / (n_pos + n_neg)

    def part(k, n, p):
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(k > 0, k * np.log(np.maximum(k, 1) / (n * p)), 0) + np.where(k < n, (n - k) * np.log(np.maximum(n - k, 1) / (n * (1 - p))), 0)

    score = 2 * (part(pos, n_pos, total) + part(neg, n_neg, total))
    return np.where(pos * n_neg > 3 * neg * n_pos, score, 0)


def places(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    """The places of ``keys`` in the sorted ``known``, -1 for those that aren't there."""
    if not len(known):
        return np.full(len(keys), -1)
    at = np.searchsorted(known, keys)
    at[at == len(known)] = 0
    return np.where(known[at] == keys, at, -1)


@dataclass
class Vectors:
    """Sparse rows: where each row's terms start, the terms in order, their weights."""

    start: np.ndarray
    term: np.ndarray
    value: np.ndarray

    def __len__(self) -> int:
        return len(self.start) - 1

    def row(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        own = slice(self.start[i], self.start[i + 1])
        return self.term[own], self.value[own]

    def part(self, begin: int, end: int) -> Vectors:
        own = slice(self.start[begin], self.start[end])
        return Vectors(self.start[begin : end + 1] - self.start[begin], self.term[own], self.value[own])

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.start))


@dataclass
class TermSpace:
    """The examples' words, then the markers, then one coordinate for all other words."""

    words: np.ndarray  # sorted hashes of the examples' words
    markers: np.ndarray  # sorted hashes
    marker_idf: np.ndarray
    idf: np.ndarray  # of words, by the first bits of their hash

    @property
    def size(self) -> int:
        return len(self.words) + len(self.markers) + 1

    def vectors(self, n_words: np.ndarray, words: Tally, starts: Tally) -> Vectors:
        """Of each text; words that no example has add to the length only. A text without words has no terms."""
        n = len(n_words)
        idf = self.idf[(words.kinds >> np.uint64(64 - DF_BITS)).astype(np.int64)]
        raw = (1 + np.log(words.count)) * idf[words.kind]
        length = np.sqrt(2 * np.bincount(words.doc, raw * raw, n))
        at = places(words.kinds, self.words)[words.kind]
        has = at >= 0
        doc, term, value = [words.doc[has]], [at[has]], [raw[has] / length[words.doc[has]]]
        marks = []
        for t in (words, starts):
            mark = places(t.kinds, self.markers)[t.kind]
            known = mark >= 0
            marks.append((t.doc[known], mark[known], t.count[known]))
        own, mark, count = (np.concatenate(x) for x in zip(*marks, strict=True))
        most = np.zeros(n)
        np.maximum.at(most, own, count)
        full = np.flatnonzero(n_words)
        # The rest of the words, to half an octave.
        rest = 1 + np.round(2 * np.log2(np.maximum(1, n_words - most))) / 2 * math.log(2)
        x = (1 + np.log(count)) * self.marker_idf[mark]
        length = np.sqrt(2 * (np.bincount(own, x * x, n) + rest * rest))
        doc += [own, full]
        term += [len(self.words) + mark, np.full(len(full), self.size - 1)]
        value += [x / length[own], rest[full] / length[full]]
        doc, term, value = (np.concatenate(x) for x in (doc, term, value))
        order = np.argsort(doc * self.size + term)
        return Vectors(np.searchsorted(doc[order], np.arange(n + 1)), term[order], value[order])


@dataclass
class ExampleIndex:
    """Vectors of all examples by doc_id, and how their votes count."""

    space: TermSpace
    prior: float
    neighbours: int
    curve: tuple[float, float] = (1.0, 0.0)  # slope and shift of scores by the odds of votes
    toxic: np.ndarray = field(default_factory=lambda: np.zeros(0))
    ids: np.ndarray = field(default_factory=lambda: NO_LONGS)
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0))  # of an example's vote
    rows: Vectors = field(default_factory=lambda: Vectors(np.zeros(1, np.int64), NO_LONGS, np.zeros(0)))
    held: Broadcast | None = None

    def vote(self, at: np.ndarray, cosine: np.ndarray) -> float:
        """Between 0 and 1; one unit of the prior stands beside the votes."""
        vote = self.weight[at] / (1.05 - np.minimum(cosine, 1.0)) ** 2
        return float((vote @ self.toxic[at] + self.prior) / (vote.sum() + 1))


def on_curve(vote: float, curve: tuple[float, float]) -> float:
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, curve[0] * odds(vote) + curve[1]))))


def odds(share):
    share = np.clip(share, 1e-12, 1 - 1e-12)
    return np.log(share / (1 - share))


def one_blas_thread() -> None:
    """Keep OpenBLAS from spinning in threads that the other task of the executor needs."""
    if not os.path.exists("/proc/self/maps"):
        return
    with open("/proc/self/maps") as maps:
        paths = {line.split()[-1] for line in maps if "openblas" in line}
    for path in paths:
        for name in ("openblas_set_num_threads", "scipy_openblas_set_num_threads64_", "scipy_openblas_set_num_threads"):
            if hasattr(lib := ctypes.CDLL(path), name):
                getattr(lib, name)(1)


def bisected(matrix: np.ndarray, size: int) -> np.ndarray:
    """An order of the rows in which runs of ``size`` are alike: halves along the direction of most variance, again and again."""
    random, out, todo = np.random.default_rng(0), [], [np.arange(len(matrix))]
    while todo:
        own = todo.pop()
        rows = matrix[own] - matrix[own].mean(0)
        axis = random.standard_normal(matrix.shape[1]).astype(np.float32)
        for _ in range(4):
            axis = rows.T @ (rows @ axis)
            axis /= np.linalg.norm(axis) + 1e-12
        own = own[np.argsort(rows @ axis, kind="stable")]
        half = -(-len(own) // (2 * size)) * size
        if len(own) <= size:
            out.append(own)
        else:
            todo += [own[half:], own[:half]]
    return np.concatenate(out)


class Searcher:
    """An index made ready for searches."""

    #: More than single precision can be off in a cosine.
    MARGIN = 1e-5

    def __init__(self, index: ExampleIndex):
        self.index, self.scan = index, TermScan()
        rows, n = index.rows, len(index.toxic)
        if not n:
            return
        size = np.bincount(rows.term, minlength=index.space.size)
        dense = np.flatnonzero(size > DENSE * n)
        self.column = np.full(index.space.size, -1, np.int32)
        self.column[dense] = np.arange(len(dense))
        # Which examples are alike shows in some directions as well.
        directions = np.random.default_rng(0).standard_normal((len(dense), 128)).astype(np.float32)
        some = np.empty((n, 128), np.float32)
        for begin, end, part in self.parts():
            doc, column = part.doc, self.column[part.term]
            has = column >= 0
            matrix = np.zeros((end - begin, len(dense)), np.float32)
            matrix[doc[has], column[has]] = part.value[has]
            some[begin:end] = matrix @ directions
        #: The examples by block.
        self.order = bisected(some, BLOCK * TOGETHER)
        for s in range(0, n, BLOCK * TOGETHER):
            part = self.order[s : s + BLOCK * TOGETHER]
            self.order[s : s + BLOCK * TOGETHER] = part[bisected(some[part], BLOCK)]
        del some
        place = np.empty(n, np.int32)
        place[self.order] = np.arange(n)
        self.n = -(-n // (BLOCK * TOGETHER)) * BLOCK * TOGETHER
        self.matrix = np.zeros((len(dense), self.n), np.float32)
        size[dense] = 0
        #: Lists of the other terms, of places in that order, where each starts in ``start``. An example's place
        #: and its weight are beside each other: a query's lists are gathered in one go.
        self.start = np.r_[0, np.cumsum(size)]
        self.entries = np.empty(self.start[-1], [("at", np.int32), ("value", np.float32)])
        free = self.start[:-1].copy()
        for begin, _, part in self.parts():
            doc, column = place[begin + part.doc], self.column[part.term]
            has = column >= 0
            self.matrix[column[has], doc[has]] = part.value[has]
            rare = np.flatnonzero(~has)
            rare = rare[np.argsort(part.term[rare], kind="stable")]
            kinds, first, count = np.unique(part.term[rare], return_index=True, return_counts=True)
            at = np.repeat(free[kinds] - first, count) + np.arange(len(rare))
            free[kinds] += count
            self.entries["at"][at], self.entries["value"][at] = doc[rare], part.value[rare]
        self.most = self.matrix.reshape(len(dense), -1, BLOCK).max(2)
        self.blank = np.zeros(self.n, np.float32)
        self.blank[n:] = -np.inf  # places without an example
        self.held = np.zeros(index.space.size)
        self.blocks_scored = self.blocks_bounded = 0

    def parts(self) -> Iterator[tuple[int, int, Vectors]]:
        """The examples, some at a time: what is made of them on the way is small beside the index."""
        n = len(self.index.rows)
        for begin in range(0, n, EXAMPLES):
            end = min(begin + EXAMPLES, n)
            yield begin, end, self.index.rows.part(begin, end)

    def nearest(self, queries: Vectors, count: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the nearest examples and their cosines, exactly: by falling cosine, then by place."""
        m, wide, entries = len(queries), BLOCK * TOGETHER, self.entries.view(np.int64)
        doc, column = queries.doc, self.column[queries.term]
        heads = np.zeros((m, len(self.matrix)), np.float32)
        heads[doc[column >= 0], column[column >= 0]] = queries.value[column >= 0]
        tails = np.empty((m, self.n), np.float32)
        for i in range(m):
            at, x = queries.row(i)
            rare = self.column[at] < 0
            at, x = at[rare], x[rare]
            begin, end = self.start[at], self.start[at + 1]
            if len(at):
                own = np.concatenate([entries[s:e] for s, e in zip(begin.tolist(), end.tolist(), strict=True)]).view(self.entries.dtype)
                tails[i] = np.bincount(own["at"], own["value"] * np.repeat(x.astype(np.float32), end - begin), self.n)
            else:
                tails[i] = 0
        tails += self.blank
        # What each block can reach: its best by the lists and its maxima by the frequent terms.
        reach = (heads @ self.most + tails.reshape(m, -1, BLOCK).max(2)).reshape(m, -1, TOGETHER).max(2)
        score = tails.reshape(m, -1, wide)

        def add_heads(q: np.ndarray, s: int) -> None:
            score[q, s] += heads[q] @ self.matrix[:, s * wide : (s + 1) * wide]

        best = reach.argmax(1)
        for s in np.unique(best).tolist():
            add_heads(np.flatnonzero(best == s), s)
        k = min(count, wide)
        least = np.partition(score[np.arange(m), best], wide - k, 1)[:, wide - k] - 2 * self.MARGIN
        wanted = reach >= least[:, None]
        wanted[np.arange(m), best] = False
        for s in np.flatnonzero(wanted.any(0)).tolist():
            add_heads(np.flatnonzero(wanted[:, s]), s)
        wanted[np.arange(m), best] = True
        self.blocks_scored += int(wanted.sum())
        self.blocks_bounded += wanted.size
        out = []
        for i in range(m):
            some = np.flatnonzero(wanted[i])
            found = np.flatnonzero((score[i, some] >= max(least[i], -1)).ravel())
            found = (some[:, None] * wide + np.arange(wide)).ravel()[found]
            if len(found) > count:
                own = tails[i, found]
                found = found[own >= np.partition(own, len(own) - count)[len(own) - count] - self.MARGIN]
            out.append(self.exact(np.sort(self.order[found]), *queries.row(i), count))
        return out

    def exact(self, found: np.ndarray, at: np.ndarray, x: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
        rows = self.index.rows
        begin, end = rows.start[found], rows.start[found + 1]
        spans = [slice(s, e) for s, e in zip(begin.tolist(), end.tolist(), strict=True)]
        self.held[at] = x
        # Terms that the query lacks add 0.
        parts = [self.held.take(rows.term[own], mode="clip") * rows.value[own] for own in spans]
        self.held[at] = 0
        cosine = np.bincount(np.repeat(np.arange(len(found)), end - begin), np.concatenate(parts), len(found)) if parts else np.zeros(0)
        best = np.lexsort((found, -np.round(cosine, 12)))
        best = best[cosine[best] > 0][:count]
        return found[best], cosine[best]

    def score(self, texts: list[bytes | None], curve: tuple[float, float]) -> list[tuple[float, list]]:
        """Score and evidence of each text."""
        index = self.index
        if not len(index.toxic):
            return [(index.prior, [])] * len(texts)
        out = []
        for n_words, _, words, starts in self.scan.tallies(texts):
            queries = index.space.vectors(n_words, words, starts)
            for i in range(0, len(n_words), AT_ONCE):
                end = min(i + AT_ONCE, len(n_words))
                for k, (at, cosine) in enumerate(self.nearest(queries.part(i, end), index.neighbours), i):
                    out.append((on_curve(index.vote(at, cosine), curve), index.ids[at[:3]].tolist()) if n_words[k] else (index.prior, []))
        return out


def term_counts(tables: DataFrame) -> DataFrame:
    """(start boolean, hash long, pos long, n long): in how many examples, and toxic ones, each word and each beginning stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column(0).to_numpy()
            for start in (False, True):
                packed = batch.column(1 + start).to_pylist()
                keys, key = np.unique(np.frombuffer(b"".join(packed), np.uint64), return_inverse=True)
                n = np.bincount(key, minlength=len(keys))
                pos = np.bincount(key, np.repeat(toxic, [len(x) // 8 for x in packed]), len(keys)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), start)), *map(pa.array, (keys.view(np.int64), pos, n))], ["start", "hash", "pos", "n"])

    rows = tables.select("toxic", "words", "starts").mapInArrow(run, "start boolean, hash long, pos long, n long")
    return rows.groupBy("start", "hash").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"))


def term_space(tables: DataFrame, idf: np.ndarray, n_pos: int, n_neg: int, significance: float, max_terms: int) -> TermSpace:
    """All words of the examples, and their markers."""
    found = term_counts(tables).where(~F.col("start") | (F.col("pos") >= 3)).toArrow()  # bounded by the sample
    start, hashes, pos, n = (found[c].to_numpy() for c in ("start", "hash", "pos", "n"))
    hashes = hashes.astype(np.int64).view(np.uint64)
    gain = np.where(pos >= 3, associated(pos, n - pos, n_pos, n_neg), 0)
    marks = np.flatnonzero(gain >= significance)
    marks = marks[np.lexsort((hashes[marks], -np.round(gain[marks], 9)))][:max_terms]
    marks = marks[np.argsort(hashes[marks])]
    return TermSpace(np.sort(hashes[~start]), hashes[marks], np.log((1 + n_pos + n_neg) / (1 + n[marks])) + 1, idf)


def example_vectors(tables: DataFrame, space: TermSpace) -> pa.Table:
    """(doc_id, text_hash, toxic, term, value) of all examples, by doc_id; bounded by the sample."""
    held = tables.sparkSession.sparkContext.broadcast(space)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in tables.schema.fields if f.name in ("doc_id", "toxic", "text_hash"))
    names = ["doc_id", "toxic", "text_hash", "term", "value"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = held.value
        for batch in batches:
            packed = [batch.column(i).to_pylist() for i in range(4, 8)]
            rows = space.vectors(batch.column(3).to_numpy(), Tally.unpacked(*packed[:2]), Tally.unpacked(*packed[2:]))
            made = [[x.tobytes() for x in (t.astype(np.int32), v.astype(np.float32))] for t, v in map(rows.row, range(len(rows)))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array([m[i] for m in made], pa.binary()) for i in (0, 1))], names)

    rows = tables.select("doc_id", "toxic", "text_hash", "n_words", "words", "counts", "starts", "start_counts")
    out = rows.mapInArrow(run, f"{kinds}, term binary, value binary").toArrow()
    held.destroy()
    return out


def gathered(column: pa.ChunkedArray, order: np.ndarray, kind: type) -> np.ndarray:
    """The values of all rows in that order, one after the other."""
    views = []
    for c in column.chunks:
        cut = np.frombuffer(c.buffers()[1], np.int64)[c.offset : c.offset + len(c) + 1].tolist()
        data = np.frombuffer(c.buffers()[2], kind) if len(c) else np.zeros(0, kind)
        views += [data[s // 4 : e // 4] for s, e in zip(cut[:-1], cut[1:], strict=True)]
    return np.concatenate([views[i] for i in order.tolist()])


def fitted_curve(votes: np.ndarray, toxic: np.ndarray, share: float) -> tuple[float, float]:
    """Slope and shift of the logistic curve from votes' odds to labels, with both labels weighted to ``share``.

    Labels count as a little less than certain, which keeps the curve finite where votes part them.
    """
    if len(votes) < 20 or toxic.min() == toxic.max():
        return 1.0, 0.0
    n_pos = toxic.sum()
    n_neg = len(toxic) - n_pos
    weight = np.where(toxic > 0, share * len(toxic) / n_pos, (1 - share) * len(toxic) / n_neg)
    want = np.where(toxic > 0, (n_pos + 1) / (n_pos + 2), 1 / (n_neg + 2))
    x = np.stack([odds(votes), np.ones(len(votes))], 1)
    curve = np.array([1.0, 0.0])

    def loss(c):
        z = x @ c
        return float(weight @ (np.logaddexp(0, z) - want * z))

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ curve, -500, 500)))
        gradient = x.T @ (weight * (p - want))
        step = np.linalg.solve(x.T @ (x * (weight * p * (1 - p))[:, None]) + 1e-9 * np.eye(2), gradient)
        scale = 1.0
        while scale > 1e-6 and loss(curve - scale * step) > loss(curve):
            scale /= 2
        curve = curve - scale * step
        if np.abs(scale * step).max() < 1e-9:
            break
    return (float(curve[0]), float(curve[1])) if curve[0] > 0 else (1.0, 0.0)


def left_out_votes(spark: SparkSession, held, some: np.ndarray) -> np.ndarray:
    """The votes that the examples at ``some`` places get from all others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = Prepared.of(held)
        index = searcher.index
        for batch in batches:
            at, votes = batch.column(0).to_numpy(), []
            for i in range(0, len(at), AT_ONCE):
                rows = [index.rows.row(a) for a in at[i : i + AT_ONCE].tolist()]
                queries = Vectors(np.cumsum([0] + [len(t) for t, _ in rows]), np.concatenate([t for t, _ in rows]).astype(np.int64), np.concatenate([v for _, v in rows]).astype(float))
                for own, (near, cosine) in zip(at[i : i + AT_ONCE], searcher.nearest(queries, index.neighbours + 1), strict=True):
                    other = np.flatnonzero(near != own)[: index.neighbours]
                    votes.append(index.vote(near[other], cosine[other]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(votes, pa.float64())], ["place", "vote"])
        Prepared.done()

    rows = spark.createDataFrame(pa.table({"place": some})).repartition(min(len(some), 2 * spark.sparkContext.defaultParallelism))
    found = {r.place: r.vote for r in rows.mapInArrow(run, "place long, vote double").collect()}  # two numbers an example
    return np.array([found[i] for i in some.tolist()])


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 8_000, neighbours: int = 15, significance: float = 30.0, max_terms: int = 4_096, calibrate: int = 1_000) -> ExampleIndex:
    """The index of a sample of at most 2 x per_class examples; ``significance`` and ``max_terms`` limit the markers only."""
    spark = docs.sparkSession
    sample, total = labelled_sample(docs, labels, per_class)
    share = total.get(1, 0) / max(1, sum(total.values()))
    tables = materialize(example_tables(sample), "examples")
    sizes = {r.toxic: r.n for r in tables.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_pos, n_neg = sizes.get(1, 0), sizes.get(0, 0)
    none = np.zeros(0, np.uint64)
    if not n_pos or not n_neg:
        return ExampleIndex(TermSpace(none, none, np.zeros(0), np.zeros(0, np.float32)), share, neighbours)
    space = term_space(tables, corpus_idf(docs), n_pos, n_neg, significance, max_terms)
    found = example_vectors(tables, space)
    discard(tables)
    scale = {0: total[0] / n_neg, 1: total[1] / n_pos}
    order = pa.compute.sort_indices(found, [("doc_id", "ascending"), ("text_hash", "ascending"), ("toxic", "ascending")])
    toxic, ids = found["toxic"].take(order).to_numpy().astype(float), np.array(found["doc_id"].take(order).to_pylist())
    rows = Vectors(None, *(gathered(found[c].cast(pa.large_binary()), order.to_numpy(), kind) for c, kind in (("term", np.int32), ("value", np.float32))))
    rows.start = np.cumsum(np.r_[0, pa.compute.binary_length(found["term"].take(order)).to_numpy().astype(np.int64) // 4])
    del found, order
    pa.default_memory_pool().release_unused()  # the driver's next stages need the room
    weight = np.where(toxic > 0, scale[1], scale[0]) / min(scale.values())
    index = ExampleIndex(space, share, neighbours, (1.0, 0.0), toxic, ids, weight, rows)
    # The examples are in the order of their ids; every so many of a label are asked.
    some = np.concatenate([own[:: max(1, -(-len(own) // calibrate))] for own in (np.flatnonzero(toxic == t) for t in (0, 1))])
    index.held = spark.sparkContext.broadcast(index)  # bounded by the sample
    index.curve = fitted_curve(left_out_votes(spark, index.held, some), toxic[some], share)
    return index


class Prepared:
    """In a worker: the searcher of a broadcast index, kept between tasks and freed when no task has asked for it for some seconds."""

    IDLE_SECONDS = 4.0
    lock, key, searcher, timer = threading.RLock(), None, None, None

    @classmethod
    def of(cls, held: Broadcast) -> Searcher:
        with cls.lock:
            if cls.timer:
                cls.timer.cancel()
            if cls.key is not held:
                cls.searcher = None
                give_back()  # what earlier tasks left; a worker lives through many stages
                one_blas_thread()
                cls.key, cls.searcher = held, Searcher(held.value)
                give_back()
            return cls.searcher

    @classmethod
    def done(cls) -> None:
        """At the end of a task."""
        with cls.lock:
            cls.timer = threading.Timer(cls.IDLE_SECONDS, cls.free, [cls.key])
            cls.timer.daemon = True
            cls.timer.start()

    @classmethod
    def free(cls, key: Broadcast) -> None:
        with cls.lock:
            if cls.key is key and threading.current_thread() is cls.timer:
                cls.key = cls.searcher = cls.timer = None
                if getattr(key, "_path", None) and getattr(key, "_sc", None) is None:
                    key.__dict__.pop("_value", None)  # read again from its file if it is asked for
                give_back()


def scorer(spark: SparkSession, index: ExampleIndex):
    """In a task: (score, evidence) of each of some texts."""
    index.held = held = index.held or spark.sparkContext.broadcast(index)
    curve = index.curve
    return lambda: partial(Prepared.of(held).score, curve=curve)


def score_documents(docs: DataFrame, index: ExampleIndex) -> DataFrame:
    """doc_id, score, predicted and evidence (ids of the nearest examples) of every row."""
    make_score = scorer(docs.sparkSession, index)

    def make():
        score = make_score()

        def compute(texts):
            rows = score(texts)
            return [[r[0] for r in rows], [int(r[0] >= 0.5) for r in rows], [r[1] for r in rows]]

        return compute

    fields = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("evidence", T.ArrayType(docs.schema["doc_id"].dataType))]
    return map_texts(docs, make, fields, ["doc_id"], done=Prepared.done)


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all columns, that are not scored as toxic."""
    return passing(docs, fit(docs, labels))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``drop_toxic`` as a table: no later stage holds the index in the driver or the executors."""
    index = fit(docs, labels)
    kept = materialize(passing(docs, index), "not-toxic")
    index.held.destroy()
    drop_shuffles(docs.sparkSession)
    return kept


def passing(docs: DataFrame, index: ExampleIndex) -> DataFrame:
    make_score = scorer(docs.sparkSession, index)

    def make():
        score = make_score()
        return lambda texts: [r[0] < 0.5 for r in score(texts)]

    return filter_texts(docs, make, done=Prepared.done)


def op10_nearest_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    rows = score_documents(docs, fit(docs, read(spark, sf_dir, "labels")))
    return rows.select("doc_id", F.coalesce(fold("doc_id") == HELD_OUT, F.lit(False)).alias("held_out"), "score", "predicted", "evidence")
