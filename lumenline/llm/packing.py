"""Packing by shortest-pack-first over the length histogram.

Documents become token ids and an end id, and are cut into pieces of at most ``limit`` tokens. Only the
histogram of piece lengths (at most ``limit`` rows) comes to the driver. There lengths are placed
longest first: all pieces of a length go together into the open packing patterns that are shortest, which
splits a pattern's count where it is larger than what is left. Pieces are then ranked within their length
(in salted buckets, so that a frequent length is no single task) and joined with the patterns' slots by
that rank. Tokens are never shuffled: pieces carry their place and checksum.

A document without text has the end id alone. Repeated rows are packed one by one. An empty table gives an
empty result. Other columns are ignored.
"""

from __future__ import annotations

import base64
import heapq
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import give_back, materialize, read

SPECIAL = {"<|endoftext|>": 50256}


@lru_cache(maxsize=2)
def encoder(ranks: str, pattern: str):
    """A byte-level BPE encoder from a file of ranks."""
    import tiktoken

    with open(ranks, "rb") as lines:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=merges, special_tokens=SPECIAL)


def public_vocabulary() -> tuple[str, str]:
    """The ranks and the split pattern of the public byte_bpe_50k vocabulary; its ids are those of byte_bpe_50k.json."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def cut_pieces(docs: DataFrame, limit: int = 2048, end: int = 1, vocabulary: tuple[str, str] | None = None, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens) of every piece of every document, and its ids if asked for."""
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    kind = None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(*(vocabulary or public_vocabulary())).encode_to_numpy
        for batch in batches:
            kind = batch.column(0).type
            rows: list[list] = [[] for _ in range(5 + with_ids)]
            ids_of = batch.column(0).to_pylist()
            for doc, text in zip(ids_of, batch.column(1).to_pylist(), strict=True):
                ids = np.append(encode(text or "", allowed_special="all"), np.uint32(end)).astype("<u4")
                for start in range(0, len(ids), limit):
                    piece = ids[start : start + limit]
                    for column, value in zip(rows, (doc, start, len(piece), zlib.crc32(piece.tobytes()), len(ids), piece.astype(np.int32)), strict=False):
                        column.append(value)
            kinds = [kind, *[pa.int64()] * 4, *[pa.list_(pa.int32())] * with_ids]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"][: len(kinds)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names)
        give_back()

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def packing_patterns(histogram: dict[int, int], limit: int = 2048) -> list[tuple[int, tuple[int, ...]]]:
    """(count, lengths) of each packing pattern: shortest pack first, lengths longest first."""
    open_packs: dict[int, list[tuple[int, tuple[int, ...]]]] = {}  # by tokens used
    shortest: list[int] = []

    def put(used: int, count: int, lengths: tuple[int, ...]) -> None:
        if used not in open_packs:
            open_packs[used] = []
            heapq.heappush(shortest, used)
        open_packs[used].append((count, lengths))

    for length in sorted(histogram, reverse=True):
        left, placed = histogram[length], []
        while left and shortest and shortest[0] + length <= limit:
            used = shortest[0]
            count, lengths = open_packs[used].pop()
            taken = min(count, left)
            left -= taken
            placed.append((used + length, taken, (*lengths, length)))
            if taken < count:
                open_packs[used].append((count - taken, lengths))
            if not open_packs[used]:
                del open_packs[used]
                heapq.heappop(shortest)
        if left:
            # As many of one length as fit share a pack, so that a new pack is closed only by its own pieces.
            fit = limit // length
            if left >= fit:
                placed.append((fit * length, left // fit, (length,) * fit))
            if left % fit:
                placed.append((left % fit * length, 1, (length,) * (left % fit)))
        for used, count, lengths in placed:
            put(used, count, lengths)
    return sorted((x for packs in open_packs.values() for x in packs), key=lambda x: (-len(x[1]), x[1], x[0]))


def slot_table(patterns: list[tuple[int, tuple[int, ...]]]) -> pd.DataFrame:
    """A row for each run of equal slots: ranks [first, first + count) of a length go to sequences [sequence, ...) at an offset."""
    rows, ranked, sequence = [], {}, 0
    for count, lengths in patterns:
        offset = 0
        for length in lengths:
            rows.append((length, ranked.get(length, 0), sequence, offset))
            ranked[length] = ranked.get(length, 0) + count
            offset += length
        sequence += count
    return pd.DataFrame(rows, columns=["length", "first", "sequence", "offset"]).sort_values(["length", "first"])


def place_pieces(pieces: DataFrame, limit: int = 2048, buckets: int = 256) -> DataFrame:
    """``pieces`` (of any columns, among them length) with sequence_id and offset; they are read twice, so should be materialized."""
    salt = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)).cast("int")
    salted = pieces.withColumn("__salt", salt)
    counts = salted.groupBy("length", "__salt").agg(F.count("*").alias("n")).toPandas()  # at most limit x buckets rows
    counts = counts.sort_values(["length", "__salt"])
    counts["base"] = counts.groupby("length")["n"].cumsum() - counts["n"]
    slots = slot_table(packing_patterns(counts.groupby("length")["n"].sum().to_dict(), limit))
    wide = np.int64(1) << 40
    key = (slots["length"].to_numpy(np.int64) * wide + slots["first"].to_numpy(np.int64)) if len(slots) else np.zeros(0, np.int64)
    first, sequence, offset = (slots[c].to_numpy(np.int64) for c in ("first", "sequence", "offset"))
    base_key = counts["length"].to_numpy(np.int64) * buckets + counts["__salt"].to_numpy(np.int64)
    base = counts["base"].to_numpy(np.int64)

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, salt: pd.Series, rank: pd.Series) -> pd.DataFrame:
        length = length.to_numpy(np.int64)
        rank = rank.to_numpy(np.int64) - 1 + base[np.searchsorted(base_key, length * buckets + salt.to_numpy(np.int64))]
        at = np.searchsorted(key, length * wide + rank, "right") - 1
        return pd.DataFrame({"sequence_id": sequence[at] + rank - first[at], "offset": offset[at]})

    rank = F.row_number().over(Window.partitionBy("length", "__salt").orderBy("doc_id", "start", "ids_crc32"))
    placed = salted.withColumn("__rank", rank).withColumn("__at", place("length", "__salt", "__rank"))
    return placed.select(*pieces.columns, "__at.sequence_id", "__at.offset")


def pack_documents(docs: DataFrame, limit: int = 2048, end: int = 1, vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece."""
    return place_pieces(materialize(cut_pieces(docs, limit, end, vocabulary), "pieces"), limit)


def op9_histogram_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"))
