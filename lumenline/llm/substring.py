"""Substring deduplication by Rabin-Karp hashes of fixed-length word windows.

Every window of ``window`` words gets a rolling polynomial hash modulo 2^64. Spark counts them, in two
steps. First only minimizers are counted: of each window, the smallest hash of its half-as-long
sub-windows. Equal windows have equal minimizers, so a window whose minimizer stands once in the corpus is
unique; a filter of fixed size holds the repeated minimizers (where it is too full, more windows pass and
results stay the same). Windows that pass are counted: each batch of a task keeps the first of equal windows and
knows the others to be later ones, which also bounds what a frequent passage sends; the rest meet by hash,
where all but the first are later ones. Overlapping later windows merge into maximal removal intervals.

Order is (doc_id, start); a null doc_id comes first. Ids may be of any type that has an order: whole numbers
stand for themselves, others get places in their order by a range partitioning, which is written as a table.
Repeated rows are one document and get the same result. Null texts have no words; a text of fewer words than
a window stays whole. A very long text is read in pieces, but is one value of a row. Other columns are ignored,
whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import RollingHash, WordScan, materialize, read, texts_of

FILTER_BITS = 27
#: Windows compared within a task at once.
COMBINE = 500_000
UNKNOWN = -(2**63)


def sliding(reduce, a: np.ndarray, k: int) -> np.ndarray:
    """Minimum or maximum of every k consecutive numbers."""
    out = a.copy()
    done = 1
    while done < k:
        step = min(done, k - done)
        out = reduce(out[: len(out) - step], out[step:])
        done += step
    return out


class WindowScan:
    """Windows and minimizers of the texts of a task."""

    def __init__(self, window: int):
        self.window, self.part = window, max(1, window // 2)
        self.words, self.rolling = WordScan(), RollingHash()

    def chunks(self, texts: list[bytes | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(window hashes, minimizers, text index, start, sub-window hashes selected), many texts at a time."""
        k, q = self.window, self.part
        for index, lengths, hashes in self.words.chunks(texts):
            if len(hashes) < k:
                continue
            first = np.cumsum(lengths) - lengths
            prefix = self.rolling.prefix(hashes)
            whole, sub = self.rolling.windows(prefix, k), self.rolling.windows(prefix, q)
            least = sliding(np.minimum, sub, k - q + 1)
            of = np.repeat(np.arange(len(lengths)), lengths)[: len(whole)]
            start = np.arange(len(whole)) - first[of]
            valid = start + k <= lengths[of]
            # A sub-window is selected if it is the least of some window within its text.
            own = np.where(valid, least, np.uint64(0))
            pad = np.zeros(k - q, np.uint64)
            chosen = sub == sliding(np.maximum, np.r_[pad, own, pad], k - q + 1)
            yield whole[valid], least[valid], index[of[valid]], start[valid], sub[chosen]


def repeated_minimizers(docs: DataFrame, window: int) -> DataFrame:
    """(h): minimizers that stand at more than one place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = WindowScan(window)
        for batch in batches:
            for *_, chosen in scan.chunks(texts_of(batch.column(0))):
                h, n = np.unique(chosen, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])

    return docs.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h")


def hash_filter(hashes: DataFrame) -> np.ndarray:
    """2^FILTER_BITS bits, those of the hashes set."""
    bit = F.pmod(F.col("h"), F.lit(1 << FILTER_BITS)) + 1  # places count from 1, buckets too
    rows = hashes.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    bits = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
    for r in rows.toLocalIterator():  # at most 16 MB in all
        bits[(r.k - 1) * 4096 : r.k * 4096] = np.frombuffer(r.bits, np.uint8)
    return bits


def runs_of(start: np.ndarray, *same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places and lengths of the stretches in which starts follow each other and all else is the same."""
    cut = np.r_[True, np.diff(start) != 1]
    for x in same:
        cut[1:] |= x[1:] != x[:-1]
    first = np.flatnonzero(cut)[: len(start)]
    return first, np.diff(np.r_[first, len(start)])


def later_of(h: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which windows have an equal one that starts earlier; places equal in doc_id and start are equally early."""
    order = np.lexsort((start, doc, h))
    a, d, s = h[order], doc[order], start[order]
    at = np.maximum.accumulate(np.where(np.r_[True, a[1:] != a[:-1]], np.arange(len(a)), 0))
    out = np.empty(len(a), bool)
    out[order] = (d != d[at]) | (s != s[at])
    return out


def with_places(docs: DataFrame) -> DataFrame:
    """(doc_id, text, place): a number for each id, in their order."""
    rows = docs.select("doc_id", "text")
    if isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        return rows.withColumn("place", F.coalesce(F.col("doc_id").cast("long"), F.lit(UNKNOWN)))
    ids = docs.select("doc_id").where("doc_id is not null").distinct().repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    ids = materialize(ids.select(F.col("doc_id").alias("own"), F.monotonically_increasing_id().alias("at")), "ids")
    return rows.join(ids, F.col("doc_id") == F.col("own"), "left").select("doc_id", "text", F.coalesce("at", F.lit(UNKNOWN)).alias("place"))


def later_windows(docs: DataFrame, window: int) -> DataFrame:
    """(place, text_hash, start, n): n consecutive windows whose word sequences start earlier elsewhere, in ``docs`` (text, place).

    Windows travel in runs of one minimizer, which equal windows share, so a run is a row.
    """
    held = docs.sparkSession.sparkContext.broadcast(hash_filter(repeated_minimizers(docs, window)))
    names = ["minimizer", "place", "text_hash", "start", "n", "hashes"]
    longs = lambda *columns: [pa.array(np.ascontiguousarray(c).astype(np.int64, copy=False)) for c in columns]

    def settled(doc, text, start) -> pa.RecordBatch:
        first, n = runs_of(start, doc, text)
        return pa.RecordBatch.from_arrays([*longs(text[first], doc[first], text[first], start[first], n), pa.nulls(len(n), pa.binary())], names)

    def emit(rows) -> Iterator[pa.RecordBatch]:
        h, m, doc, text, start = (np.concatenate(x) for x in zip(*rows, strict=True))
        later = later_of(h, doc, start)
        if later.any():
            # These are settled; they travel under their text's hash, which spreads them.
            yield settled(doc[later], text[later], start[later])
        h, m, doc, text, start = (x[~later] for x in (h, m, doc, text, start))
        first, n = runs_of(start, doc, text, m)
        ends = np.r_[0, np.cumsum(n) * 8].astype(np.int32)
        hashes = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(h.tobytes())])
        yield pa.RecordBatch.from_arrays([*longs(m[first], doc[first], text[first], start[first], np.zeros(len(n))), hashes], names)

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan, bits, rows, count = WindowScan(window), held.value, [], 0
        for batch in batches:
            doc, text = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for whole, least, index, start, _ in scan.chunks(texts_of(batch.column(2))):
                b = (least & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)
                hit = (bits[b >> 3] >> (b & 7).astype(np.uint8)) & 1 == 1
                if hit.any():
                    rows.append((whole[hit].view(np.int64), least[hit].view(np.int64), doc[index[hit]], text[index[hit]], start[hit]))
                    count += int(hit.sum())
                if count >= COMBINE:
                    yield from emit(rows)
                    rows, count = [], 0
        if rows:
            yield from emit(rows)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = ["place", "text_hash", "start", "n"]
        rows = []
        for batch in batches:
            open_run = pa.compute.equal(batch.column(4), 0)
            done = batch.filter(pa.compute.invert(open_run))
            if len(done):
                yield pa.RecordBatch.from_arrays([done.column(i) for i in range(1, 5)], out)
            batch = batch.filter(open_run)
            if len(batch):
                data = batch.column(5).to_pylist()
                n = np.array([len(x) // 8 for x in data])
                first = np.cumsum(n) - n
                ramp = np.arange(n.sum()) - np.repeat(first, n)
                doc, text, start = (np.repeat(batch.column(i).to_numpy(), n) for i in (1, 2, 3))
                rows.append((np.frombuffer(b"".join(data), np.int64), doc, text, start + ramp))
        if rows:
            h, doc, text, start = (np.concatenate(x) for x in zip(*rows, strict=True))
            later = later_of(h, doc, start)
            doc, text, start = doc[later], text[later], start[later]
            if len(doc):
                order = np.lexsort((start, text, doc))
                doc, text, start = doc[order], text[order], start[order]
                first, n = runs_of(start, doc, text)
                for i in range(0, len(n), 100_000):
                    s = first[i : i + 100_000]
                    yield pa.RecordBatch.from_arrays(longs(doc[s], text[s], start[s], n[i : i + 100_000]), out)

    keyed = docs.select("place", F.xxhash64("text").alias("text_hash"), "text")
    found = keyed.mapInArrow(occurrences, "minimizer long, place long, text_hash long, start long, n long, hashes binary")
    return found.repartition("minimizer").mapInArrow(settle, "place long, text_hash long, start long, n long")


def remove_repeats(docs: DataFrame, window: int = 20, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row of ``docs``; the kept text and the removed intervals if asked for."""
    docs = with_places(docs)
    later = later_windows(docs, window).groupBy("place", "text_hash").agg(F.collect_list("start").alias("__starts"), F.collect_list("n").alias("__counts"))
    later = later.withColumnsRenamed({"place": "__place", "text_hash": "__hash"})
    rows = docs.withColumn("__text", F.xxhash64("text"))
    rows = rows.join(later.hint("shuffle_hash"), (F.col("place") == F.col("__place")) & (F.col("__text") == F.col("__hash")), "left").select("doc_id", "text", "__starts", "__counts")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept string, intervals array<array<int>>" * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in range(3 + 2 * with_text)]
            for text, starts, counts in zip(texts_of(batch.column(1)), batch.column(2), batch.column(3), strict=True):
                words = (text or b"").split()
                n, gone, cuts = len(words), 0, []
                if starts.is_valid:
                    at = starts.values.to_numpy()
                    edge = np.zeros(n + 1, np.int64)
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + counts.values.to_numpy() - 1 + window, -1)
                    cover = np.cumsum(edge[:n]) > 0
                    gone = int(cover.sum())
                    turn = np.flatnonzero(np.diff(np.r_[False, cover, False]))
                    cuts = turn.reshape(-1, 2).tolist()
                    words = [w for w, c in zip(words, cover.tolist(), strict=True) if not c]
                kept = b" ".join(words)
                values = (n, gone, hashlib.sha256(kept).hexdigest(), *((kept.decode(), cuts) if with_text else ()))
                for column, value in zip(rows, values, strict=True):
                    column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.list_(pa.int32()))]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept", "intervals"]
            made = [pa.array(c, k) for c, k in zip(rows, kinds, strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names[: 1 + len(made)])

    return rows.mapInArrow(run, schema)


def op8_rabin_karp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents"))


#: The same rows in DuckDB's SQL.
OP8_SQL = r"""WITH l AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS l FROM documents),
w AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS p, unnest(l) AS word FROM l),
g AS (SELECT doc_id, p, string_agg(word, ' ') OVER n AS h, count(*) OVER n AS k FROM w WINDOW n AS (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
f AS (SELECT doc_id, p, row_number() OVER (PARTITION BY h ORDER BY doc_id, p) AS place FROM g WHERE k = 20),
c AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS p FROM f WHERE place > 1),
m AS (SELECT w.doc_id, w.p, word, c.p IS NOT NULL AS gone FROM w LEFT JOIN c ON w.doc_id = c.doc_id AND w.p = c.p),
a AS (SELECT doc_id, count(*) AS n_words, CAST(count_if(gone) AS BIGINT) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY p) FILTER (NOT gone), '') AS kept FROM m GROUP BY ALL)
SELECT l.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM l LEFT JOIN a ON l.doc_id = a.doc_id"""
