"""Benchmark decontamination by a prefix-filtered set join.

Every window of an item (``window`` consecutive words, or the whole item where it is shorter) is a set of
shingles, here its words, ordered by rarity in the corpus. Whatever contains the window contains its
rarest word, so that word alone is the necessary prefix of containment. Documents are joined with the
prefixes; the word's place in the window fixes where an occurrence would start (positional bound) and
end (length bound), and only then are the words of the document's own item-sized window compared.

Windows up to a bounded number are broadcast, and documents are never shuffled. A larger benchmark stays a
table: two filters of fixed size, of prefixes and of windows, pick the few places of a document that can be
windows, and only these are joined with it, on their words; rarity then comes from a table of hashed counts.

Documents without text have no words; very long ones are read whole. An item without text, words or id is no
item; an item repeated under its id counts once. Repeated documents are judged one by one. Ids can be of any
type. An empty table gives an empty result, an empty benchmark leaves every document clean. Other columns are
ignored by marks and passed on by the filter.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import FOLD, RollingHash, WordScan, filter_texts, map_texts, materialize, mix, read, texts_of

#: For a benchmark that isn't broadcast: bits of the table of word counts, and of the filters of prefixes and windows.
COUNT_BITS, PREFIX_FILTER_BITS, WINDOW_FILTER_BITS = 22, 23, 26


def item_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """(item string, words binary): the distinct windows of every item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items, words = [], []
            for item, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
                own = (text or b"").translate(FOLD).split()
                for i in range(max(1, len(own) - window + 1) if own else 0):
                    items.append(item)
                    words.append(b" ".join(own[i : i + window]))
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(words, pa.binary())], ["item", "words"])

    ids = benchmark.where("item_id is not null").select(F.col("item_id").cast("string"), "text")
    return ids.mapInArrow(run, "item string, words binary").distinct()


def word_counts(docs: DataFrame, vocabulary) -> DataFrame:
    """(word binary, n long): how often each word of the broadcast vocabulary stands in all of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = vocabulary.value.__contains__, Counter()
        for batch in batches:
            for text in texts_of(batch.column(0)):
                if text:
                    counts.update(filter(known, text.translate(FOLD).split()))
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    return docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def window_index(windows: list[tuple[str, bytes]], rarity: dict[bytes, int]) -> tuple[dict, dict]:
    """By rarest word, where in a window it stands and how long that is; by window, its items."""
    places, items = defaultdict(set), defaultdict(list)
    for item, words in windows:
        items[words].append(item)
    for words in items:
        own = words.split(b" ")
        rarest = min(own, key=lambda w: (rarity.get(w, 0), w))
        places[rarest].add((own.index(rarest), len(own)))
    return {w: sorted(p) for w, p in places.items()}, dict(items)


def find_windows(words: list[bytes], places: dict, items: dict) -> Iterator[tuple[int, int, list[str]]]:
    """(start, end, items) of every window that occurs among ``words``."""
    n = len(words)
    for i in [i for i, w in enumerate(words) if w in places]:
        for at, length in places[words[i]]:
            start = i - at
            if start >= 0 and start + length <= n:
                found = items.get(b" ".join(words[start : start + length]))
                if found:
                    yield start, start + length, found


def small_index(docs: DataFrame, windows: DataFrame) -> Broadcast:
    """The index of all windows, which are known to be few."""
    spark = docs.sparkSession
    own = [(r.item, bytes(r.words)) for r in windows.collect()]
    vocabulary = spark.sparkContext.broadcast({w for _, words in own for w in words.split(b" ")})
    rarity = {bytes(r.word): r.n for r in word_counts(docs, vocabulary).collect()}
    vocabulary.destroy()
    return spark.sparkContext.broadcast(window_index(own, rarity))


def finder(index: Broadcast) -> Callable[[], Callable[[bytes | None], tuple[int, int, set[str]]]]:
    """In a task: number of words, of words hit, and the items of a text."""

    def make():
        places, items = index.value

        def find(text: bytes | None) -> tuple[int, int, set[str]]:
            words = (text or b"").translate(FOLD).split()
            hit, found = set(), set()
            for start, end, own in find_windows(words, places, items):
                hit.update(range(start, end))
                found.update(own)
            return len(words), len(hit), found

        return find

    return make


# A benchmark of any size


def hashed_counts(docs: DataFrame) -> np.ndarray:
    """How often words stand in all of ``docs``, on a scale of logarithms, by the first COUNT_BITS bits of their hashes."""
    shift, cells, blocks = np.uint64(64 - COUNT_BITS), 1 << COUNT_BITS, 16

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, scan = np.zeros(cells, np.int64), WordScan(FOLD)
        for batch in batches:
            for _, _, hashes in scan.chunks(texts_of(batch.column(0))):
                np.add.at(counts, (hashes >> shift).astype(np.int64), 1)
        packed = [(i, zlib.compress(p.tobytes(), 1)) for i, p in enumerate(counts.reshape(blocks, -1)) if p.any()]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in packed], pa.int32()), pa.array([x for _, x in packed], pa.binary())], ["block", "counts"])

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells // blocks, np.int64)
        for batch in batches:
            for c in batch.column(1):
                total += np.frombuffer(zlib.decompress(c.as_py()), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([(np.log2(total + 1.0) * 1000).astype("<u2").tobytes()], pa.binary())], ["block", "counts"])

    out = np.zeros((blocks, cells // blocks), np.uint16)
    rows = docs.select("text").mapInArrow(run, "block int, counts binary").groupBy("block").applyInArrow(add, "block int, counts binary")
    for r in rows.collect():  # 8 MB in all
        out[r.block] = np.frombuffer(r.counts, "<u2")
    return out.ravel()


def bits_of(hashes: DataFrame, size: int) -> np.ndarray:
    """2^size bits, those of the hashes (hash long) set."""
    bit = F.pmod("hash", F.lit(1 << size)) + 1  # places count from 1, buckets too
    rows = hashes.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    out = np.zeros((1 << size) // 8, np.uint8)
    for r in rows.collect():  # of fixed size
        out[(r.k - 1) * 4096 : r.k * 4096] = np.frombuffer(r.bits, np.uint8)
    return out


def has_bit(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes & np.uint64(8 * len(bits) - 1)
    return bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1 == 1


def window_prefixes(windows: DataFrame, rarity: Broadcast) -> DataFrame:
    """(words, hash, prefix, place, length) of the distinct windows: hashes of the window and of its rarest word, where that stands, and the length."""
    shift = np.uint64(64 - COUNT_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare, scan, rolling = rarity.value, WordScan(FOLD), RollingHash()
        for batch in batches:
            rows = [[], [], [], []]
            for _, counts, hashes in scan.chunks(texts_of(batch.column(0))):
                at = 0
                for n in counts.tolist():
                    own = hashes[at : at + n]
                    place = int(np.argmin(rare[own >> shift]))
                    for column, x in zip(rows, (int(rolling.windows(rolling.prefix(own), n)[0].view(np.int64)), int(own[place].view(np.int64)), place, n), strict=True):
                        column.append(x)
                    at += n
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in rows)], ["words", "hash", "prefix", "place", "length"])

    return windows.select("words").distinct().mapInArrow(run, "words binary, hash long, prefix long, place long, length long")


def joined_marks(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n_words, n_hit, items) of every row of ``docs``, by a join with the table of windows."""
    spark = docs.sparkSession
    rarity = spark.sparkContext.broadcast(hashed_counts(docs))  # fixed size
    prefixes = materialize(window_prefixes(windows, rarity), "window-prefixes")
    held = spark.sparkContext.broadcast(  # fixed sizes; a window's place and length have few values
        (
            bits_of(prefixes.select(F.col("prefix").alias("hash")), PREFIX_FILTER_BITS),
            bits_of(prefixes, WINDOW_FILTER_BITS),
            [(r.place, r.length) for r in prefixes.select("place", "length").distinct().collect()],
        )
    )
    kind = docs.schema["doc_id"].dataType.simpleString()
    found_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("words", pa.binary())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefix_bits, window_bits, shapes = held.value
        scan, rolling = WordScan(FOLD), RollingHash()
        for batch in batches:
            texts, n_words, found = texts_of(batch.column(2)), [], []
            for index, counts, hashes in scan.chunks(texts):
                prefix, ends = rolling.prefix(hashes), np.cumsum(counts)
                begin_of = np.repeat(ends - counts, counts)
                end_of = np.repeat(ends, counts)
                lead = np.flatnonzero(has_bit(prefix_bits, hashes))
                hits = []
                for place, length in shapes:
                    start = lead - place
                    start = start[(start >= begin_of[lead]) & (start + length <= end_of[lead])]
                    same = mix(rolling.stretches(prefix, start, start + length))
                    hits += [(s, length) for s in start[has_bit(window_bits, same)].tolist()]
                by_text = defaultdict(list)
                for s, length in hits:
                    by_text[int(np.searchsorted(ends, s, "right"))].append((s, length))
                for k, i in enumerate(index.tolist()):
                    own = (texts[i] or b"").translate(FOLD).split() if k in by_text else []
                    at = int(ends[k] - counts[k])
                    found.append([{"start": s - at, "length": n, "words": b" ".join(own[s - at : s - at + n])} for s, n in by_text.get(k, [])])
                n_words += counts.tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n_words, pa.int64()), pa.array(found, found_type)], ["doc_id", "text_hash", "n_words", "found"])

    schema = f"doc_id {kind}, text_hash long, n_words long, found array<struct<start:long,length:long,words:binary>>"
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, schema)
    rows = materialize(rows, "window-candidates")
    places = rows.where(F.size("found") > 0).dropDuplicates(["doc_id", "text_hash"]).select("doc_id", "text_hash", F.explode("found").alias("at"))
    places = places.select("doc_id", "text_hash", "at.*")
    by_words = windows.groupBy("words").agg(F.collect_set("item").alias("own"))
    spans = places.join(by_words, "words").groupBy("doc_id", "text_hash").agg(
        F.size(F.array_distinct(F.flatten(F.collect_set(F.sequence("start", F.col("start") + F.col("length") - 1))))).cast("long").alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("own")))).alias("items"),
    )
    spans = spans.withColumnsRenamed({"doc_id": "__id", "text_hash": "__text"})
    same = rows["doc_id"].eqNullSafe(spans["__id"]) & (rows["text_hash"] == spans["__text"])
    joined = rows.join(spans, same, "left")
    return joined.select("doc_id", "text_hash", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def mark_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, most_broadcast: int = 200_000) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of ``docs``, and the item_ids (items)."""
    windows = materialize(item_windows(benchmark, window), "windows")
    if windows.count() > most_broadcast:
        rows = joined_marks(docs, windows)
        n_items, digest = F.size("items").cast("long"), F.sha2(F.array_join("items", ","), 256)
        return rows.select("doc_id", "n_words", "n_hit", n_items.alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "items")
    make_find = finder(small_index(docs, windows))

    def make():
        find = make_find()

        def compute(texts):
            rows = [find(t) for t in texts]
            items = [sorted(r[2]) for r in rows]
            return [
                [r[0] for r in rows],
                [r[1] for r in rows],
                [len(x) for x in items],
                [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items],
                [r[1] > 0 for r in rows],
                items,
            ]

        return compute

    fields = [T.StructField(n, T.LongType()) for n in ("n_words", "n_hit", "n_items")]
    fields += [T.StructField("items_sha256", T.StringType()), T.StructField("contaminated", T.BooleanType()), T.StructField("items", T.ArrayType(T.StringType()))]
    return map_texts(docs, make, fields, ["doc_id"])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, most_broadcast: int = 200_000) -> DataFrame:
    """The rows of ``docs``, with all columns, in which no window of an item occurs."""
    windows = materialize(item_windows(benchmark, window), "windows")
    if windows.count() > most_broadcast:
        bad = joined_marks(docs, windows).where("n_hit > 0").select(F.col("doc_id").alias("__bad_id"), F.col("text_hash").alias("__bad_text")).distinct()
        own = docs.select(F.struct("*").alias("__row"), F.col("doc_id").alias("__own_id"), F.xxhash64("text").alias("__own_text"))
        clean = own.join(bad, F.col("__own_id").eqNullSafe(F.col("__bad_id")) & (F.col("__own_text") == F.col("__bad_text")), "left_anti")
        return clean.select("__row.*")
    make_find = finder(small_index(docs, windows))

    def make():
        find = make_find()
        return lambda texts: [not find(t)[1] for t in texts]

    return filter_texts(docs, make)


def op3_prefix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mark_contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.drop("items")


_WORDS = r"coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"
_TEN = "ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING"
#: The same rows in DuckDB's SQL.
OP3_SQL = f"""WITH d AS (SELECT doc_id, {_WORDS} AS l FROM documents), b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS l FROM benchmark WHERE item_id IS NOT NULL),
w AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS p, unnest(l) AS word FROM d),
g AS (SELECT doc_id, p, string_agg(word, ' ') OVER n AS h, count(*) OVER n AS k FROM w WINDOW n AS (PARTITION BY doc_id ORDER BY p {_TEN})),
v AS (SELECT item, unnest(range(1, len(l) + 1)) AS p, unnest(l) AS word FROM b WHERE len(l) >= 10),
i AS (SELECT DISTINCT item, h FROM (SELECT item, string_agg(word, ' ') OVER n AS h, count(*) OVER n AS k FROM v WINDOW n AS (PARTITION BY item ORDER BY p {_TEN})) WHERE k = 10),
s AS (SELECT item, l FROM b WHERE len(l) BETWEEN 1 AND 9),
x AS (SELECT doc_id, p, 10 AS n, item FROM g JOIN i USING (h) WHERE k = 10
 UNION ALL SELECT w.doc_id, w.p, len(s.l), item FROM w JOIN s ON w.word = s.l[1] JOIN d ON d.doc_id = w.doc_id WHERE d.l[w.p:w.p + len(s.l) - 1] = s.l),
q AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS p FROM x) GROUP BY ALL),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM x) GROUP BY ALL)
SELECT doc_id, len(l) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN q USING (doc_id) LEFT JOIN t USING (doc_id)"""
