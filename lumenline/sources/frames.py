"""Sampled frames of videos as a source whose partitions are ranges of frame numbers.

Every ``max(1, round(interval * fps))``-th frame is read by seeking, its time is its number by the frame rate. The driver only asks
for frame rates and numbers of frames; a video of any length is read by as many tasks as it has ranges.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .logs import filesystem, log_sizes

FRAMES = "lecture_id string, frame_idx long, timestamp double, content binary"


class FrameError(Exception):
    """A video that can't be opened, or whose frame rate is unknown."""


class Video(Protocol):
    """One opened video."""

    fps: float
    n_frames: int

    def read(self, first: int, last: int, step: int) -> Iterator[tuple[int, bytes]]:
        """(number, content) of every step-th frame from ``first`` and before ``last``, fewer if the video ends sooner."""


class TableVideo:
    """A Parquet table as a video: a file, or a folder of files that follow each other by name. Its rows are frames, of which a
    range's row groups are read; one column is the content."""

    def __init__(self, uri: str, content: str, fps: float = 25.0):
        from pyarrow import fs

        self.where, path = filesystem(uri)
        folder = self.where.get_file_info(path).type == fs.FileType.Directory
        self.paths = [f"{path.rstrip('/')}/{n}" for n in sorted(log_sizes(uri))] if folder else [path]
        self.uri, self.content, self.fps = uri, content, fps
        if not folder:
            self._open(path)

    def _open(self, path: str):
        import pyarrow.parquet as pq

        try:
            return pq.ParquetFile(self.where.open_input_file(path))
        except (OSError, pa.ArrowInvalid) as e:
            raise FrameError(f"could not open video: {self.uri}") from e

    @property
    def n_frames(self) -> int:
        return sum(self._open(path).metadata.num_rows for path in self.paths)

    def read(self, first: int, last: int, step: int) -> Iterator[tuple[int, bytes]]:
        begin = 0
        for path in self.paths:
            if begin >= last:
                return
            file = self._open(path)
            for g in range(file.num_row_groups):
                end = begin + file.metadata.row_group(g).num_rows
                wanted = range(first + -(-max(begin - first, 0) // step) * step, min(end, last), step)
                if wanted:
                    column = file.read_row_group(g, columns=[self.content]).column(0)
                    for i in wanted:
                        value = column[i - begin].as_py()
                        yield i, value.encode() if isinstance(value, str) else value
                begin = end


def frame_step(interval: float, fps: float, path: str = "") -> int:
    if not fps or fps <= 0:
        raise FrameError(f"could not read FPS for video: {path} (fps={fps})")
    return max(1, round(interval * fps))


class FrameScan(DataSourceReader):
    def __init__(self, opened: Callable[[str], Video], options):
        self.opened, self.uri = opened, options["path"].rstrip("/")
        self.interval, self.frames = float(options.get("interval", 1.5)), int(options.get("frames", 1000))
        self.whole = options.get("whole", "false").lower() == "true"

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        where, path = filesystem(self.uri)
        folder = not self.whole and where.get_file_info(path).type == fs.FileType.Directory
        videos = [f"{self.uri}/{n}" for n in sorted(log_sizes(self.uri))] if folder else [self.uri]
        found = []
        for uri in videos:
            video = self.opened(uri)
            step, n = frame_step(self.interval, video.fps, uri), video.n_frames
            span = step * max(self.frames, 1)
            found += [(uri, a, min(a + span, n), step, video.fps) for a in range(0, n, span)]
        return [InputPartition(p) for p in found] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.value is None:
            return
        uri, first, last, step, fps = partition.value
        lecture = uri.rsplit("/", 1)[-1].rsplit(".", 1)[0]
        for i, content in self.opened(uri).read(first, last, step):
            yield lecture, i, i / fps, content


def frames(spark: SparkSession, path: str, opened: Callable[[str], Video], interval: float = 1.5, frames_per_task: int = 1000, whole: bool = False) -> DataFrame:
    """(lecture_id, frame_idx, timestamp, content) of the sampled frames of the video, or folder of videos, at ``path``; with ``whole`` a folder is one video."""

    class Frames(DataSource):
        @classmethod
        def name(cls) -> str:
            return "frames"

        def schema(self) -> str:
            return FRAMES

        def reader(self, schema) -> FrameScan:
            return FrameScan(opened, self.options)

    spark.dataSource.register(Frames)
    return spark.read.format("frames").options(path=path, interval=str(interval), frames=str(frames_per_task), whole=str(whole)).load()
