"""Growing logs of lines as a source: what recognisers and jobs write while they run.

A folder holds append-only files of UTF-8 lines, one for each recording or job. A stream's offset is the number of bytes of each file
that are whole lines, so a line that is being written waits for its end, a batch that is run again reads the same bytes, and a
restarted stream goes on where its checkpoint says. Files are read in ranges of bytes by as many tasks; a range has the lines that
begin in it. The driver lists the files and looks for the last line's end in those that have grown, nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..model import JOB_EVENT, schema

LINES = "file string, at long, line string"
SEGMENT_LINE = "lecture_id string, seg_index long, start double, end double, text string"
PIECE = 1 << 20


def filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def log_sizes(uri: str) -> dict[str, int]:
    """Bytes of the files of a folder, at any depth, but for hidden ones."""
    from pyarrow import fs

    where, path = filesystem(uri)
    found = where.get_file_info(fs.FileSelector(path, allow_not_found=True, recursive=True))
    sizes = {f.path[len(path) :].lstrip("/"): f.size for f in found if f.is_file}
    return {name: size for name, size in sizes.items() if not any(part[0] in "._" for part in name.split("/"))}


def whole_lines(uri: str, name: str, since: int, size: int) -> int:
    """How many bytes of a file are whole lines, of which so many are known to be."""
    where, path = filesystem(uri)
    with where.open_input_file(f"{path}/{name}") as f:
        end = size
        while end > since:
            begin = max(since, end - PIECE)
            at = f.read_at(end - begin, begin).rfind(b"\n")
            if at >= 0:
                return begin + at + 1
            end = begin
    return since


def lines_of(uri: str, name: str, begin: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(place, line) of the lines that begin in a range of bytes; the last one is read beyond it."""
    where, path = filesystem(uri)
    with where.open_input_file(f"{path}/{name}") as f:
        at, held, inside = begin, b"", begin == 0 or f.read_at(1, begin - 1) == b"\n"
        while at < end or held or not inside:
            piece = f.read_at(PIECE, at + len(held))
            if not piece:
                break
            held += piece
            *lines, held = held.split(b"\n")
            for line in lines:
                if inside and at < end:
                    yield at, line
                inside, at = True, at + len(line) + 1
            if at >= end and inside:
                break


class Logs:
    def __init__(self, options):
        if "path" not in options:
            raise ValueError("the source needs a path")
        self.uri, self.bytes = options["path"].rstrip("/"), int(options.get("bytes", 8 << 20))
        self.known: dict[str, int] = {}

    def latestOffset(self) -> dict:
        sizes = log_sizes(self.uri)
        self.known = {n: whole_lines(self.uri, n, min(self.known.get(n, 0), size), size) if size != self.known.get(n) else size for n, size in sizes.items()}
        return dict(self.known)

    def partitions(self, start: dict | None = None, end: dict | None = None) -> list[InputPartition]:
        start, end = start or {}, self.latestOffset() if end is None else end
        cut = [n for n in start if n not in end or end[n] < start[n]]
        if cut:
            raise ValueError(f"logs have been cut or deleted: {', '.join(sorted(cut))}")
        ranges = ((n, a, min(a + self.bytes, end[n])) for n in sorted(end) for a in range(start.get(n, 0), end[n], self.bytes))
        return [InputPartition(r) for r in ranges] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition.value is None:
            return
        name, begin, end = partition.value
        places, lines, held = [], [], 0
        for at, line in lines_of(self.uri, name, begin, end):
            places.append(at)
            lines.append(line.decode("utf-8", "replace"))
            held += len(line)
            if held > PIECE or len(lines) >= 8192:
                yield pa.record_batch([pa.array([name] * len(lines)), pa.array(places, pa.int64()), pa.array(lines)], ["file", "at", "line"])
                places, lines, held = [], [], 0
        if lines:
            yield pa.record_batch([pa.array([name] * len(lines)), pa.array(places, pa.int64()), pa.array(lines)], ["file", "at", "line"])


class LogReader(Logs, DataSourceReader):
    pass


class LogStreamReader(Logs, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {}


class GrowingLogs(DataSource):
    """``format("growing_logs")`` with ``path``, and ``bytes`` of a file that a task reads at most."""

    @classmethod
    def name(cls) -> str:
        return "growing_logs"

    def schema(self) -> str:
        return LINES

    def reader(self, schema) -> LogReader:
        return LogReader(self.options)

    def streamReader(self, schema) -> LogStreamReader:
        return LogStreamReader(self.options)


def log_lines(spark: SparkSession, path: str, stream: bool = False, **options: str) -> DataFrame:
    """(file, at, line) of the logs in a folder, as they are or as a stream."""
    spark.dataSource.register(GrowingLogs)
    return (spark.readStream if stream else spark.read).format("growing_logs").options(path=path, **options).load()


def parsed(lines: DataFrame, ddl: str) -> DataFrame:
    """Lines of JSON objects as rows of the given columns, with their file and place; lines without the first column are left out."""
    names = schema(ddl).fieldNames()
    rows = lines.withColumn("__row", F.from_json("line", schema(ddl)))
    return rows.select("file", "at", *(F.col(f"__row.{n}").alias(n) for n in names)).where(F.col(names[0]).isNotNull())


def segment_log(spark: SparkSession, path: str, stream: bool = False, **options: str) -> DataFrame:
    """Timed segments that recognisers report one by one (lecture_id, seg_index, start, end, text), texts without white space around them."""
    return parsed(log_lines(spark, path, stream, **options), SEGMENT_LINE).withColumn("text", F.trim("text"))


def job_log(spark: SparkSession, path: str, stream: bool = False, after: int = -1, **options: str) -> DataFrame:
    """Events of jobs, those after a known sequence number; a stream's checkpoint remembers the rest."""
    return parsed(log_lines(spark, path, stream, **options), JOB_EVENT).where(F.col("seq") > after)


def write_logs(rows: DataFrame, path: str) -> None:
    """Append ``rows`` as lines of JSON to the logs in a folder."""
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.mode("append").text(path)
