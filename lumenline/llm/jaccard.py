"""N-gram Jaccard join with count-vector R-trees.

A document is its set of word shingles; documents with equal sets are one class, and classes are joined.
Shingles are hashed into groups, and a class's numbers of shingles by group are its point. The sum of the
coordinates' minima bounds the overlap of two points from above; R-tree nodes hold coordinate maxima, so
one sum can exclude a whole node. Pairs that survive the bound are verified on their sets.

A tree over the whole corpus prunes little, as the counts of unlike documents of one size lie close
together. So the space is cut first: by a prefix filter, classes that can be similar share one of their
rarest shingles, and a tree covers the classes of one such shingle. Rarity comes from a fixed-size table of
hashed counts over all documents.

Groups of near copies are large, and their links many times more. Each class first goes to the groups of a
few of its shared shingles, together with its set; there, links are verified only between classes that are
not connected yet. What this connects are components, and the trees then look only for pairs between
different components. Nothing that is skipped could join two components, so components are exact. The classes of
a shingle with too many for one task are cut into parts, the largest component's apart from the others', and a
task gets two parts that can have pairs.

Sets and shingles are identified by 64-bit hashes. Null and wordless texts have empty sets and are linked
with nothing. Repeated rows are equal sets. Null doc_ids are allowed; the smallest known id names a
component. Columns other than doc_id and text are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from .common import BASE, LOWER, WordScan, discard, drop_shuffles, give_back, join_split, materialize, mix, read, texts_of
from .components import connected_components

#: Hashed counts for rarity, bits of the filter for classes that have a close one, groups of a coarse and of a fine point.
RARITY_BITS, FILTER_BITS, COARSE, FINE = 22, 23, 64, 256
#: Classes of one shingle that a task takes into an R-tree, and with their sets; shingles to whose groups a class goes with its set.
RUN, HOME, HOMES = 20_000, 1_000, 2


class ShingleScan:
    """The shingle sets of texts, as sorted distinct hashes."""

    def __init__(self, size: int):
        self.size, self.words = size, WordScan(LOWER)

    def sets(self, texts: Iterable[bytes | None]) -> Iterator[tuple[int, np.ndarray]]:
        """(index, set) of each text; a text of fewer words than a shingle is one shingle."""
        k = self.size
        for index, counts, hashes in self.words.chunks(texts):
            acc = self._combine(hashes, k) if len(hashes) >= k else hashes[:0]
            at = 0
            for i, n in zip(index.tolist(), counts.tolist(), strict=True):
                own = np.sort(acc[at : at + n - k + 1]) if n >= k else self._combine(hashes[at : at + n], n) if n else acc[:0]
                if len(own) > 1:
                    own = own[np.concatenate(([True], own[1:] != own[:-1]))]
                yield i, own
                at += n

    @staticmethod
    def _combine(h: np.ndarray, k: int) -> np.ndarray:
        n = len(h) - k + 1
        with np.errstate(over="ignore"):
            acc = np.full(n, k, dtype=np.uint64)
            for i in range(k):
                acc *= np.uint64(BASE)
                acc += h[i : n + i]
        return mix(acc)


def class_of(shingles: np.ndarray) -> int:
    h = xxhash.xxh3_64_intdigest(shingles.tobytes())
    return h - (1 << 64) if h >> 63 else h


def long_batch(names: list[str], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(np.asarray(c, dtype=np.int64)) for c in columns], names)


def overlap(x: np.ndarray, y: np.ndarray) -> int:
    """The number of common elements of two sorted sets."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int(np.count_nonzero(y[at] == x))


def point_of(shingles: np.ndarray, groups: int) -> bytes:
    """Numbers of shingles by group, in the one, two or four bytes each that they fit."""
    return packed_counts(np.bincount((shingles % np.uint64(groups)).astype(np.int64), minlength=groups))


def points_from(packed: list[bytes], groups: int) -> np.ndarray:
    points = np.empty((len(packed), groups), np.int32)
    for size in (1, 2, 4):
        own = [i for i, p in enumerate(packed) if len(p) == size * groups]
        if own:
            points[own] = np.frombuffer(b"".join([packed[i] for i in own]), f"<u{size}").reshape(-1, groups)
    return points


def packed_counts(counts: np.ndarray) -> bytes:
    most = counts.max(initial=0)
    return counts.astype("<u1" if most < 256 else "<u2" if most < 65_536 else "<u4").tobytes()


def class_filter(classes: DataFrame) -> np.ndarray:
    """2^FILTER_BITS bits, those of the classes (cls) set."""
    bit = F.pmod(F.col("cls"), F.lit(1 << FILTER_BITS)) + 1  # places count from 1, buckets too
    rows = classes.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    bits = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
    for r in rows.collect():  # at most 2^23 bits
        bits[(r.k - 1) * 4096 : r.k * 4096] = np.frombuffer(r.bits, np.uint8)
    return bits


class Forest:
    """Union-find over 0..n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)


class ShingleJoin:
    """Classes, links and components of the documents whose Jaccard similarity is num/den or more."""

    def __init__(self, docs: DataFrame, words: int, num: int, den: int):
        self.docs, self.words, self.num, self.den = docs, words, num, den
        self.spark = docs.sparkSession

    # Passes over the texts

    def classes(self) -> tuple[DataFrame, np.ndarray]:
        """(doc_id, text_hash, n, cls, point) of every row, and log-scaled counts of hashed shingles over all rows."""
        size = self.words
        kind = self.docs.schema["doc_id"].dataType.simpleString()
        names = ["doc_id", "text_hash", "n", "cls", "point", "block", "counts"]
        shift, cells = np.uint64(64 - RARITY_BITS), 1 << RARITY_BITS
        blocks = 16

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scan, counts, id_type = ShingleScan(size), np.zeros(cells, np.uint32), None
            for batch in batches:
                id_type = batch.column(0).type
                n, cls, points, found = [], [], [], []
                for _, own in scan.sets(texts_of(batch.column(2))):
                    n.append(len(own))
                    cls.append(class_of(own))
                    points.append(point_of(own, COARSE))
                    found.append(own >> shift)
                    if len(found) >= 4096:
                        np.add.at(counts, np.concatenate(found), np.uint32(1))
                        found = []
                if found:
                    np.add.at(counts, np.concatenate(found), np.uint32(1))
                none = len(n)
                yield long_batch(names, batch.column(0), batch.column(1), n, cls, pa.array(points, pa.binary()), pa.nulls(none, pa.int32()), pa.nulls(none, pa.binary()))
            if id_type is not None and counts.any():
                packed = [zlib.compress(packed_counts(p), 6) for p in counts.reshape(blocks, -1)]
                none = [pa.nulls(blocks, t) for t in (id_type, pa.int64(), pa.int64(), pa.int64(), pa.binary())]
                yield pa.RecordBatch.from_arrays([*none, pa.array(range(blocks), pa.int32()), pa.array(packed, pa.binary())], names)

        schema = f"doc_id {kind}, text_hash long, n long, cls long, point binary, block int, counts binary"
        rows = self.docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, schema)
        rows = materialize(rows, "shingle-classes")

        def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(cells // blocks, np.int64)
            for batch in batches:
                for c in batch.column(1):
                    own = zlib.decompress(c.as_py())
                    total += np.frombuffer(own, f"<u{len(own) // len(total)}")
            log = np.minimum(np.log2(total + 1.0) * 1500, 65_535).astype("<u2")
            yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([log.tobytes()], pa.binary())], ["block", "counts"])

        rarity = np.zeros((blocks, cells // blocks), np.uint16)
        for r in rows.where("block is not null").select("block", "counts").groupBy("block").applyInArrow(add, "block int, counts binary").collect():
            rarity[r.block] = np.frombuffer(r.counts, "<u2")  # 8 MB in all
        return rows.where("block is null").drop("block", "counts"), rarity.ravel()

    def postings(self, rarity: np.ndarray) -> DataFrame:
        """(token, cls, size): the necessary prefix of each class, its rarest shingles.

        ``size`` is twice the class's number of shingles, and one more where a pair must share the token in which the class
        is the smaller one: it leads.
        """
        size, num, den = self.words, self.num, self.den
        self.rarity = shared = self.spark.sparkContext.broadcast(rarity)  # fixed size
        shift = np.uint64(64 - RARITY_BITS)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scan, rare, seen = ShingleScan(size), shared.value, set()
            for batch in batches:
                tokens, cls, n, prefix, lead = [np.zeros(0, np.uint64)], [], [], [], []
                for _, own in scan.sets(texts_of(batch.column(0))):
                    m = len(own)
                    if not m or den * m // num == m == -(-num * m // den):
                        continue  # only an equal set can be similar
                    c = class_of(own)
                    if c in seen:
                        continue
                    if len(seen) >= 1_000_000:
                        seen.clear()
                    seen.add(c)
                    p = m - -(-num * m // den) + 1
                    tokens.append(own[np.argsort(rare[own >> shift], kind="stable")[:p]])
                    cls.append(c)
                    n.append(m)
                    prefix.append(p)
                    lead.append(m - -(-2 * num * m // (num + den)) + 1)
                p = np.array(prefix, np.int64)
                place = np.arange(p.sum()) - np.repeat(np.cumsum(p) - p, p)
                leads = place < np.repeat(np.array(lead, np.int64), p)
                yield long_batch(["token", "cls", "size"], np.concatenate(tokens).view(np.int64), np.repeat(np.array(cls, np.int64), p), 2 * np.repeat(np.array(n, np.int64), p) + leads)
            give_back()

        return self.docs.select("text").mapInArrow(run, "token long, cls long, size long")

    def sets(self, close: DataFrame) -> DataFrame:
        """(cls, point, packed) of the classes in ``close``; a fixed-size filter lets few others through.

        A set goes as a compressed text that has it, which takes about a third of its hashes' room.
        """
        size = self.words
        bits = class_filter(close)
        held = self.spark.sparkContext.broadcast(bits)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scan, has, seen = ShingleScan(size), held.value, set()
            for batch in batches:
                rows, texts = [[], [], []], texts_of(batch.column(0))
                for i, own in scan.sets(texts):
                    c = class_of(own)
                    b = c % (1 << FILTER_BITS)
                    if not has[b >> 3] >> (b & 7) & 1 or c in seen or not len(own):
                        continue
                    if len(seen) >= 1_000_000:
                        seen.clear()
                    seen.add(c)
                    for column, value in zip(rows, (c, point_of(own, FINE), zlib.compress(texts[i], 1)), strict=True):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.binary()), pa.array(rows[2], pa.binary())], ["cls", "point", "packed"])
            give_back()

        made = materialize(self.docs.select("text").mapInArrow(run, "cls long, point binary, packed binary"), "shingle-sets")
        held.destroy()
        return made

    # Joins

    def shared_postings(self, rarity: np.ndarray) -> DataFrame:
        """(token, cls, n): the postings of tokens that another class of fitting size has."""
        num, den = self.num, self.den

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = [[c.to_numpy() for c in b.columns] for b in batches]
            if not held:
                return
            token, cls, size = (np.concatenate(c) for c in zip(*held, strict=True))
            del held
            order = np.lexsort((cls, size, token))
            token, cls, n, leads = token[order], cls[order], size[order] >> 1, size[order] & 1 > 0
            new = np.r_[True, (token[1:] != token[:-1]) | (cls[1:] != cls[:-1])]
            token, cls, n, leads = token[new], cls[new], n[new], leads[new]
            # By size, a class fits the nearest smaller one that leads, or the next one if it leads itself.
            place = np.arange(len(token))
            begin = np.maximum.accumulate(np.where(np.r_[True, token[1:] != token[:-1]], place, 0))
            last = np.maximum.accumulate(np.where(leads, place, -1))
            before = np.r_[-1, last[:-1]]
            down = (before >= begin) & (den * n[before] >= num * n)
            up = np.zeros(len(token), bool)
            up[:-1] = leads[:-1] & (token[1:] == token[:-1]) & (den * n[:-1] >= num * n[1:])
            keep = np.flatnonzero(down | up)
            for i in range(0, len(keep), 100_000):
                s = keep[i : i + 100_000]
                yield long_batch(["token", "cls", "n"], token[s], cls[s], n[s])

        return self.postings(rarity).repartition("token").mapInArrow(run, "token long, cls long, n long")

    def close_postings(self, shared: DataFrame, points: DataFrame) -> DataFrame:
        """(token, cls, n): of ``shared``, the postings of classes that pass the bound on overlap with another class of the token."""
        num, den = self.num, self.den

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = [(*(b.column(i).to_numpy() for i in range(3)), b.column(3).to_pylist()) for b in batches]
            if not held:
                return
            token, cls, n = (np.concatenate([h[i] for h in held]) for i in range(3))
            points = points_from([p for h in held for p in h[3]], COARSE)
            del held
            order = np.lexsort((n, token))
            token, cls, n, points = token[order], cls[order], n[order], points[order]
            start = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
            stop = np.r_[start[1:], len(token)]
            keep, end = np.zeros(len(token), bool), np.repeat(stop, stop - start)
            place, short = np.arange(len(token)), np.repeat(stop - start <= 16, stop - start)
            for d in range(1, 16):  # pairs at distance d of short runs, all at once
                i = np.flatnonzero(short & (place + d < end))
                i = i[(den * n[i] >= num * n[np.minimum(i + d, len(n) - 1)]) & ~(keep[i] & keep[np.minimum(i + d, len(n) - 1)])]
                for k in range(0, len(i), 20_000):
                    a = i[k : k + 20_000]
                    a = a[(num + den) * np.minimum(points[a], points[a + d]).sum(1) >= num * (n[a] + n[a + d])]
                    keep[a] = keep[a + d] = True
            for s, e in zip(start, stop, strict=True):
                if e - s > RUN:
                    keep[s:e] = True  # left to the trees
                elif e - s > 16:
                    for i in range(s, e):
                        if not keep[i]:
                            low = s + np.searchsorted(n[s:e], -(-num * n[i] // den))
                            high = s + np.searchsorted(n[s:e], den * n[i] // num, "right")
                            good = (num + den) * np.minimum(points[low:high], points[i]).sum(1) >= num * (n[low:high] + n[i])
                            good[i - low] = False
                            if good.any():
                                keep[i] = True
                                keep[low:high] |= good
            for i in range(0, len(keep), 100_000):
                k = np.flatnonzero(keep[i : i + 100_000]) + i
                yield long_batch(["token", "cls", "n"], token[k], cls[k], n[k])

        rows = shared.join(points, "cls").select("token", "cls", "n", "point").repartition("token")
        return materialize(rows.mapInArrow(run, "token long, cls long, n long"), "close-shingles")

    def homes(self, close: DataFrame) -> DataFrame:
        """(cls, token, deal): the groups that classes go to; of groups of the same classes, which would find the same links, one."""
        by_token = Window.partitionBy("cls").orderBy("token")
        homes = close.select("cls", "token", F.row_number().over(by_token).alias("k")).where(F.col("k") <= HOMES)
        sizes = homes.groupBy("token").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("cls")).alias("members")).where("size > 1")
        sizes = sizes.groupBy("size", "members").agg(F.min("token").alias("token"))
        return homes.join(sizes, "token").select("cls", "token", F.pmod(F.xxhash64("cls"), F.ceil(F.col("size") / HOME)).cast("int").alias("deal"))

    def home_links(self, close: DataFrame, sets: DataFrame) -> DataFrame:
        """(u, v): links that connect similar classes within the groups that classes go to with their sets."""
        size_of, num, den = self.words, self.num, self.den
        homes = materialize(self.homes(close), "homes")  # few numbers: the join with the sets should know its size
        rows = homes.join(sets.select("cls", "packed"), "cls").repartition("token", "deal").sortWithinPartitions("token", "deal", "cls")

        def link(cls: list[int], own: list[np.ndarray]) -> Iterator[tuple[int, int]]:
            order = sorted(range(len(cls)), key=lambda i: len(own[i]))
            points = points_from([point_of(own[i], FINE) for i in order], FINE)
            size, forest = points.sum(1), Forest(len(cls))
            for i in range(1, len(order)):
                low = int(np.searchsorted(size, -(-num * size[i] // den)))
                bound = np.minimum(points[low:i], points[i]).sum(1)
                fits = np.flatnonzero((num + den) * bound >= num * (size[low:i] + size[i])) + low
                for j in fits[np.argsort(-bound[fits - low], kind="stable")].tolist():
                    if forest.root(i) != forest.root(j):
                        both = overlap(own[order[i]], own[order[j]])
                        if den * both >= num * (size[i] + size[j] - both):
                            forest.join(i, j)
                            yield cls[order[i]], cls[order[j]]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, cls, own, scan = None, [], [], ShingleScan(size_of)

            def done():
                found = list(link(cls, own)) if len(cls) > 1 else []
                return long_batch(["u", "v"], [a for a, _ in found], [b for _, b in found])

            for batch in batches:
                *keys, packed = (x.to_pylist() for x in batch.columns)
                for token, deal, c, (_, shingles) in zip(*keys, scan.sets(map(zlib.decompress, packed)), strict=True):
                    if (token, deal) != key:
                        if len(cls) > 1:
                            yield done()
                        key, cls, own = (token, deal), [], []
                    if not cls or cls[-1] != c:
                        cls.append(c)
                        own.append(shingles)
            yield done()
            give_back()

        return rows.select("token", "deal", "cls", "packed").mapInArrow(run, "u long, v long").distinct()

    def verified(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """(u, v): the pairs (u, v) whose sets are similar; only sets that the filter lets through are moved."""
        size, num, den = self.words, self.num, self.den
        held = self.spark.sparkContext.broadcast(class_filter(pairs.select(F.explode(F.array("u", "v")).alias("cls"))))

        @F.pandas_udf(BooleanType())
        def wanted(cls: pd.Series) -> pd.Series:
            b = cls.to_numpy() % (1 << FILTER_BITS)
            return pd.Series((held.value[b >> 3] >> (b & 7).astype(np.uint8)) & 1 == 1)

        sets = sets.where(wanted("cls"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scan = ShingleScan(size)
            for batch in batches:
                u, v, a, b = (c.to_pylist() for c in batch.columns)
                good = []
                for (_, x), (_, y) in zip(*(scan.sets(map(zlib.decompress, packed)) for packed in (a, b)), strict=True):
                    both = overlap(x, y)
                    good.append(den * both >= num * (len(x) + len(y) - both))
                keep = np.array(good, bool)
                yield long_batch(["u", "v"], np.array(u, np.int64)[keep], np.array(v, np.int64)[keep])

        one = sets.select(F.col("cls").alias("u"), F.col("packed").alias("a"))
        two = sets.select(F.col("cls").alias("v"), F.col("packed").alias("b"))
        return pairs.join(one, "u").join(two, "v").select("u", "v", "a", "b").mapInArrow(run, "u long, v long").distinct()

    def links(self) -> tuple[DataFrame, DataFrame]:
        """(doc_id, text_hash, n, cls) of every row, and (cls, label) of every class that is linked."""
        rows, rarity = self.classes()
        points = rows.where("n > 0").select("cls", "point").dropDuplicates(["cls"])
        shared = materialize(self.shared_postings(rarity), "shared-shingles")
        self.rarity.destroy()
        del rarity
        drop_shuffles(self.spark)  # that of all postings is the largest
        close = self.close_postings(shared, points)
        discard(shared)
        drop_shuffles(self.spark)
        sets = self.sets(close)
        first = connected_components(self.home_links(close, sets))
        first = materialize(first.withColumnsRenamed({"node": "cls"}), "home-labels")
        drop_shuffles(self.spark)
        pairs = materialize(self.between(close, sets, first), "close-pairs")
        for table in (close, self.labelled):
            discard(table)
        drop_shuffles(self.spark)
        more = self.verified(pairs, sets)
        label = lambda side: F.coalesce(F.col(f"{side}_label"), F.col(side))
        for side in ("u", "v"):
            more = more.join(first.select(F.col("cls").alias(side), F.col("label").alias(f"{side}_label")), side, "left")
        second = connected_components(more.select(label("u").alias("u"), label("v").alias("v")))
        for table in (pairs, sets):
            discard(table)
        second = second.select("node", F.col("label").alias("final"))
        joined = first.join(second, first["label"] == second["node"], "left").select("cls", F.coalesce("final", "label").alias("label"))
        alone = second.join(first, second["node"] == first["cls"], "left_anti").select(F.col("node").alias("cls"), F.col("final").alias("label"))
        return rows.drop("point"), joined.union(alone)

    def between(self, close: DataFrame, sets: DataFrame, labels: DataFrame) -> DataFrame:
        """(u, v): pairs of classes of different components that share a token and pass the bound on overlap."""
        num, den = self.num, self.den
        rows = close.join(labels, "cls", "left").withColumn("label", F.coalesce("label", "cls"))
        self.labelled = rows = materialize(rows, "labelled-shingles")
        sizes = rows.groupBy("token", "label").agg(F.count("*").alias("k"))
        mixed = sizes.groupBy("token").agg(F.sum("k").alias("k"), F.max("k").alias("mains"), F.max_by("label", F.struct("k", "label")).alias("main"), F.count("*").alias("labels")).where("labels > 1")
        rows = rows.join(mixed.drop("labels"), "token")
        # Parts of the main component's classes are 0 to m - 1, those of the others m to m + o - 1.
        m, o = (F.ceil(n / RUN).cast("int") for n in (F.col("mains"), F.col("k") - F.col("mains")))
        mine, theirs = (F.pmod(F.xxhash64("cls"), n).cast("int") for n in (m, o))
        cell = lambda x, y: F.least(x, y) * (m + o) + F.greatest(x, y)
        main_cells = F.transform(F.sequence(F.lit(0), o - 1), lambda h: cell(mine, m + h))
        other_cells = F.concat(F.transform(F.sequence(F.lit(0), m - 1), lambda g: cell(g, m + theirs)), F.transform(F.sequence(F.lit(0), o - 1), lambda h: cell(m + h, m + theirs)))
        is_main, whole = F.col("label") == F.col("main"), F.col("k") <= RUN
        rows = rows.withColumn("part", F.when(whole, 0).when(is_main, mine).otherwise(m + theirs))
        rows = rows.withColumn("deal", F.explode(F.when(whole, F.array(F.lit(0))).when(is_main, main_cells).otherwise(other_cells)))
        points = sets.select("cls", "point").dropDuplicates(["cls"])
        rows = rows.join(points, "cls").select("token", "deal", "cls", "n", "label", "part", "point").repartition("token", "deal")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = [(*(b.column(i).to_numpy() for i in range(6)), b.column(6).to_pylist()) for b in batches]
            if not held:
                return
            token, deal, cls, n, label, part = (np.concatenate([h[i] for h in held]) for i in range(6))
            kinds, kind = np.unique(cls, return_inverse=True)
            points = np.zeros((len(kinds), FINE), np.int32)
            points[kind] = points_from([p for h in held for p in h[6]], FINE)
            del held
            order = np.lexsort((n, deal, token))
            token, deal, cls, n, label, part, kind = (x[order] for x in (token, deal, cls, n, label, part, kind))
            start = np.flatnonzero(np.r_[True, (token[1:] != token[:-1]) | (deal[1:] != deal[:-1])])
            stop = np.r_[start[1:], len(token)]
            small = np.repeat(stop - start <= 16, stop - start)
            end = np.repeat(stop, stop - start)
            found: set[tuple[int, int]] = set()
            for d in range(1, 16):  # pairs at distance d of short runs, all at once
                i = np.flatnonzero(small & (np.arange(len(token)) + d < end))
                i = i[(label[i] != label[i + d]) & (den * n[i] >= num * n[i + d])]
                if len(i):
                    pairs = np.unique(np.stack([np.minimum(kind[i], kind[i + d]), np.maximum(kind[i], kind[i + d])], 1), axis=0)
                    for s in range(0, len(pairs), 20_000):
                        a, b = pairs[s : s + 20_000].T
                        over = np.minimum(points[a], points[b]).sum(1)
                        good = (num + den) * over >= num * (points[a].sum(1) + points[b].sum(1))
                        found.update(zip(a[good].tolist(), b[good].tolist(), strict=True))
            for s, e in zip(start, stop, strict=True):
                if e - s > 16:
                    for i, j in similar_points(points[kind[s:e]], label[s:e], part[s:e], num, den):
                        found.add((min(kind[s + i], kind[s + j]), max(kind[s + i], kind[s + j])))
            u = kinds[np.array([a for a, _ in found], np.int64)]
            v = kinds[np.array([b for _, b in found], np.int64)]
            yield long_batch(["u", "v"], u, v)

        return rows.mapInArrow(run, "u long, v long").distinct()


class CountTree:
    """An R-tree over count vectors that come ordered by size; nodes hold coordinate maxima and a range of sizes."""

    LEAF = 32

    def __init__(self, points: np.ndarray, num: int, den: int):
        self.points, self.num, self.den = points, num, den
        self.n = points.sum(1)
        # Leaves: slabs by size, tiled within a slab along the coordinate that varies most.
        order = np.arange(len(points))
        slab = self.LEAF * 8
        for s in range(0, len(points), slab):
            own = order[s : s + slab]
            order[s : s + slab] = own[np.argsort(points[own][:, np.argmax(points[own].var(0))], kind="stable")]
        self.order = order
        cuts = np.arange(0, len(points), self.LEAF)
        self.levels = [(np.maximum.reduceat(points[order], cuts), np.minimum.reduceat(self.n[order], cuts), np.maximum.reduceat(self.n[order], cuts))]
        while len(self.levels[-1][0]) > self.LEAF:
            top, low, high = self.levels[-1]
            cuts = np.arange(0, len(top), self.LEAF)
            self.levels.append((np.maximum.reduceat(top, cuts), np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts)))

    def children(self, nodes: np.ndarray, count: int) -> np.ndarray:
        out = (nodes[:, None] * self.LEAF + np.arange(self.LEAF)).ravel()
        return out[out < count]

    def near(self, q: np.ndarray) -> np.ndarray:
        """The points whose summed minima with point q reach the least overlap of a similar pair."""
        m = q.sum()
        need = lambda n: self.num * (n + m)
        nodes = np.arange(len(self.levels[-1][0]))
        for level in range(len(self.levels) - 1, -1, -1):
            top, low, high = (x[nodes] for x in self.levels[level])
            fits = (self.den * high >= self.num * m) & (self.num * low <= self.den * m)
            fits[fits] = (self.num + self.den) * np.minimum(top[fits], q).sum(1) >= need(low[fits])
            below = len(self.levels[level - 1][0]) if level else len(self.points)
            nodes = self.children(nodes[fits], below)
        own = self.order[nodes]
        return own[(self.num + self.den) * np.minimum(self.points[own], q).sum(1) >= need(self.n[own])]


def similar_points(points: np.ndarray, label: np.ndarray, part: np.ndarray, num: int, den: int) -> Iterator[tuple[int, int]]:
    """Pairs of points of different labels that pass the bound; points that come ordered by size, of one part or of two.

    Of two parts, the first's points ask a tree of the second's; of one, all points outside the most frequent label ask.
    """
    ask, asked = np.flatnonzero(part == part.min()), np.flatnonzero(part == part.max())
    if part.min() == part.max():
        kinds, count = np.unique(label, return_counts=True)
        ask = np.flatnonzero(label != kinds[np.argmax(count)])
    tree = CountTree(points[asked], num, den)
    for i in ask.tolist():
        for j in asked[tree.near(points[i])].tolist():
            if label[j] != label[i]:
                yield i, j


def smallest_ids(rows: DataFrame, labels: DataFrame, least) -> DataFrame:
    """(cls, key, least): of each class that isn't empty, what it belongs to and the least ``least`` of all rows there."""
    own = rows.where("n > 0").groupBy("cls").agg(F.min(least).alias("own")).join(labels, "cls", "left").withColumn("key", F.coalesce("label", "cls"))
    own = materialize(own.drop("label"), "class-keys")
    keys = own.groupBy("key").agg(F.min("own").alias("least"), F.count("*").alias("n"))
    return join_split(own.drop("own"), materialize(keys, "components"), "key")


def jaccard_components(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id of every row of ``docs``; links are at a similarity of num/den or more."""
    rows, labels = ShingleJoin(docs, words, num, den).links()
    sizes = rows.where("n > 0").groupBy("cls").agg(F.count("*").alias("n"))
    least = materialize(smallest_ids(rows, labels, F.col("doc_id")).join(sizes, "cls"), "smallest-ids")
    full = join_split(rows.where("n > 0").withColumnRenamed("n", "n_shingles"), least, "cls").select("doc_id", "text_hash", "n_shingles", F.col("least").alias("component_id"))
    return full.unionByName(rows.where("n = 0").select("doc_id", "text_hash", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def keep_one_of_each(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs``, with all columns, without those linked to a document that stays.

    Of each component the row of the smallest doc_id stays. Documents without words stay. Of rows equal in doc_id and text, with
    words or without, one stays: the one whose other columns have the smallest hash (as JSON), under any partitioning.
    """
    rows, labels = ShingleJoin(docs, words, num, den).links()
    order = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "text_hash")
    own = rows.where("n > 0").groupBy("cls").agg(F.min(order).alias("own")).join(labels, "cls", "left")
    first = own.groupBy(F.coalesce("label", "cls").alias("key")).agg(F.min("own").alias("first")).select("first.doc_id", "first.text_hash")
    stay = first.union(rows.where("n = 0").select("doc_id", "text_hash").distinct())
    rest = F.struct(*(c for c in docs.columns if c not in ("doc_id", "text")), F.lit(0).alias("none"))
    mine = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("own_id"), F.xxhash64("text").alias("own_text"), F.to_json(rest).alias("rest"))
    same = F.col("own_id").eqNullSafe(F.col("doc_id")) & (F.col("own_text") == F.col("text_hash"))
    equal = Window.partitionBy("own_id", "own_text").orderBy(F.xxhash64("rest"), "rest")
    kept = mine.join(stay, same, "inner").withColumn("place", F.row_number().over(equal)).where("place = 1")
    return kept.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def op4_count_vector_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_components(read(spark, sf_dir, "documents"), words=4, num=85, den=100)
    return found.drop("text_hash")


#: The same rows in DuckDB's SQL.
OP4_SQL = r"""WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS l FROM documents),
w AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS p, unnest(l) AS word, len(l) AS n FROM d),
g AS (SELECT doc_id, n, string_agg(word, ' ') OVER x AS h, count(*) OVER x AS k, p FROM w WINDOW x AS (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)),
s AS (SELECT DISTINCT doc_id, hash(h) AS h FROM g WHERE k = 4 OR (p = 1 AND n < 4)),
c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT u, v FROM i JOIN c x ON x.doc_id = u JOIN c y ON y.doc_id = v WHERE 100 * i.k >= 85 * (x.n + y.n - i.k)),
q AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
r AS (SELECT doc_id AS node, doc_id AS seen FROM c UNION SELECT q.u AS node, r.seen FROM r JOIN q ON q.v = r.node WHERE r.seen < q.u)
SELECT d.doc_id, coalesce(c.n, 0) AS n_shingles, coalesce(m.least, d.doc_id) AS component_id
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN (SELECT node, min(seen) AS least FROM r GROUP BY node) m ON m.node = d.doc_id"""
