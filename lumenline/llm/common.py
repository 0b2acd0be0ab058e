"""Helpers that the training-data operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A-Z to a-z, ASCII that is neither a letter nor a digit to a space; UTF-8 bytes of other letters stay.
FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32
    for b in range(256)
)
#: A-Z to a-z only.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

_scratch: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or one of our own where it is unset and all runs on one machine."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="lumenline-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _scratch.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table of ``materialize``, once all that was made of it is a table itself."""
    path = df._scratch_path
    _scratch.remove(path)
    where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def drop_shuffles(spark: SparkSession) -> None:
    """Shuffle files that nothing can read again go now: Spark deletes them once its driver has collected what led to them."""
    gc.collect()
    for _ in range(2):  # the first one ends what finalizers still hold
        spark._jvm.System.gc()


def release(spark: SparkSession) -> None:
    """Delete what ``materialize`` has written; results that still read it must have been saved before."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    while _scratch:
        path = jvm.org.apache.hadoop.fs.Path(_scratch.pop())
        path.getFileSystem(conf).delete(path, True)


#: A key is hot if it has more than one in so many of all rows; there are fewer hot keys than that.
HOT_SHARE = 2_000


def join_split(rows: DataFrame, info: DataFrame, key: str) -> DataFrame:
    """``rows`` joined with ``info`` (key, n, ...), where n is the number of rows that a key has; n is left out.

    What is known of hot keys is broadcast, at most HOT_SHARE rows, so that their rows stay where they are.
    """
    total = info.agg(F.sum("n")).first()[0] or 0
    hot = info.where(F.col("n") * HOT_SHARE > total)
    keys = F.broadcast(hot.select(key))
    often = rows.join(F.broadcast(hot.drop("n")), key)
    seldom = rows.join(keys, key, "left_anti").join(info.join(keys, key, "left_anti").drop("n"), key)
    return often.unionByName(seldom)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def texts_of(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


#: Rows of a batch whose texts are taken out of Arrow at once.
ROWS = 512


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches a few rows at a time, so that a task does not hold all texts of a batch twice."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def give_back() -> None:
    """Freed memory goes back to the system, where the libraries can do that: a worker's stays with it for later stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def map_texts(
    df: DataFrame,
    make: Callable[[], Callable[[list[bytes | None]], list[list]]],
    fields: list[T.StructField],
    keep: list[str],
    text: str = "text",
    done: Callable[[], None] = lambda: None,
) -> DataFrame:
    """The columns ``keep`` of every row, and ``fields`` computed from its text by what ``make()`` gives in each task.

    A row gives a row; nothing is shuffled. ``done`` is called at the end of each task.
    """
    schema = T.StructType([df.schema[c] for c in keep] + fields)
    kinds = [arrow_type(f.dataType) for f in fields]
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for batch in slices(batches):
            columns = compute(texts_of(batch.column(0)))
            made = [pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(i + 1) for i in range(len(keep))] + made, names)
        done()

    return df.select(text, *keep).mapInArrow(run, schema)


def filter_texts(
    df: DataFrame, make: Callable[[], Callable[[list[bytes | None]], list[bool]]], text: str = "text", done: Callable[[], None] = lambda: None
) -> DataFrame:
    """The rows of ``df``, with all their columns, whose text passes."""
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = make()
        for batch in slices(batches):
            yield batch.filter(pa.array(passes(texts_of(batch.column(at))), type=pa.bool_()))
        done()

    return df.mapInArrow(run, df.schema)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit (the finalizer of splitmix64)."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


BASE = 0x9E3779B97F4A7C15


class RollingHash:
    """Polynomial hashes of stretches of a sequence of numbers, modulo 2^64, from prefix sums."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def prefix(self, values: np.ndarray) -> np.ndarray:
        size = len(self.up)
        while size < len(values) + 1:
            size *= 2
        with np.errstate(over="ignore"):
            if size > len(self.up):
                self.up, self.down = (np.cumprod(np.r_[np.uint64(1), np.full(size - 1, b, np.uint64)], dtype=np.uint64) for b in (BASE, pow(BASE, -1, 2**64)))
            out = np.empty(len(values) + 1, np.uint64)
            out[0] = 0
            np.cumsum(values * self.up[: len(values)], out=out[1:])
            return out

    def stretches(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (prefix[end] - prefix[start]) * self.down[start]

    def windows(self, prefix: np.ndarray, k: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((prefix[k:] - prefix[:-k]) * self.down[: len(prefix) - k])


class WordScan:
    """64-bit hashes of the white-space separated words of texts, many at a time and without word objects."""

    #: Bytes handled at once; words of more than LONG bytes are hashed one by one.
    PIECE, LONG = 1 << 18, 64

    def __init__(self, fold: bytes | None = None):
        """``fold``: a table of 256 bytes applied to the texts first."""
        self.table = bytes(32 if 9 <= b <= 13 else b for b in fold or bytes(range(256)))
        self.rolling = RollingHash()

    def chunks(self, texts: Iterable[bytes | None]):
        """(indexes of texts, their numbers of words, the hashes of all their words) by pieces of whole texts."""
        part, total, begin = [], 0, 0

        def piece():
            starts, hashes = self.words(b" ".join(part))
            ends = np.cumsum([len(p) + 1 for p in part])
            return np.arange(begin, begin + len(part)), np.diff(np.searchsorted(starts, ends), prepend=0), hashes

        for text in texts:
            part.append((text or b"").translate(self.table))
            total += len(part[-1]) + 1
            if total >= self.PIECE:
                yield piece()
                part, total, begin = [], 0, begin + len(part)
        if part:
            yield piece()

    def words(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of the words of a text in which white space is spaces."""
        starts, hashes, at = [], [], 0
        while at < len(text):
            end = len(text)
            if end - at > 2 * self.PIECE:
                end = text.rfind(b" ", at, at + self.PIECE)
                end = text.find(b" ", at + self.PIECE) if end <= at else end
                end = len(text) if end < 0 else end
            s, h = self._piece(text[at:end])
            starts.append(s + at)
            hashes.append(h)
            at = end
        return (np.concatenate(starts), np.concatenate(hashes)) if starts else (np.zeros(0, np.int64), np.zeros(0, np.uint64))

    def _spans(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Prefix sums of the text's bytes, and the starts and ends of its words."""
        letters = np.frombuffer(text, np.uint8)
        inside = np.zeros(len(letters) + 2, bool)
        np.not_equal(letters, 32, out=inside[1:-1])
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        return self.rolling.prefix(letters.astype(np.uint64) + np.uint64(1)), edge[0::2], edge[1::2]

    def _piece(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        prefix, start, end = self._spans(text)
        return start, self._hashes(text, prefix, start, end)

    def _hashes(self, text: bytes, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        hashes = mix(self.rolling.stretches(prefix, start, end) ^ (end - start).astype(np.uint64))
        for i in np.flatnonzero(end - start > self.LONG):
            hashes[i] = xxhash.xxh64_intdigest(text[start[i] : end[i]])
        return hashes
