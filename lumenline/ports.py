"""External steps behind small ports, and the operators that call them.

A port is a class made once in each task; what it is made of must be picklable. Calls run in Arrow batches
on the executors, so their concurrency is the cluster's number of tasks. Retries are inside a call: a task
that Spark runs again would pay for its calls again, so results should be written before they are used.
"""

from __future__ import annotations

import base64
import hashlib
import time
from collections.abc import Callable, Iterable, Iterator
from typing import Protocol

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructType

from .functions.text import parse_verdict, strip
from .operators.catalog import rank_candidates, split_verdicts
from .operators.runs import KEYS, ocr_owner


class PortError(Exception):
    """A call that failed for good; ``status`` is an HTTP status if there is one."""

    def __init__(self, message: str, status: int | None = None):
        super().__init__(message)
        self.status = status


class LanguageModel(Protocol):
    def create(self, prompt: str) -> tuple[str, dict[str, int]]: ...


class Ocr(Protocol):
    def text_of(self, path: str, lang: str) -> str: ...


class MediaProbe(Protocol):
    def duration(self, path: str) -> float | None: ...


class FrameReader(Protocol):
    def frames(self, path: str, interval: float) -> Iterable[tuple[int, float, list[int]]]: ...


class Transcriber(Protocol):
    def transcribe(self, path: str, prompt: str) -> tuple[str, list[tuple[float, float, str]]]: ...


class DocumentConverter(Protocol):
    def to_pdf(self, path: str, folder: str) -> str: ...


class PageRenderer(Protocol):
    def pages(self, path: str) -> Iterable[tuple[int, str, str]]: ...


class AudioExtractor(Protocol):
    def extract(self, path: str, folder: str, compressed: bool) -> str: ...


class VideoFetcher(Protocol):
    def fetch(self, url: str, path: str, cookies: bool) -> tuple[int, str]: ...


class HtmlPrinter(Protocol):
    def print_pdf(self, html: str, path: str) -> None: ...


#: Statuses after which a call is made again.
RETRIED = frozenset({408, 429}) | frozenset(range(500, 600))


def with_retries(call: Callable, attempts: int = 3, backoff: float = 2.0, sleep: Callable[[float], None] = time.sleep):
    """The call's result; waits backoff, 2 x backoff, … seconds after failures that may pass."""
    for attempt in range(1, attempts + 1):
        try:
            return call()
        except PortError as e:
            if attempt == attempts or e.status not in RETRIED:
                raise
            sleep(backoff * attempt)


REPLY = "struct<text:string,error:string,input_tokens:bigint,output_tokens:bigint>"


def ask(make: Callable[[], LanguageModel], attempts: int = 3, backoff: float = 2.0):
    """A column function from prompts to STRUCT<text, error, input_tokens, output_tokens>; null prompts are not asked."""

    @F.pandas_udf(REPLY)
    def reply(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = make()
        for prompts in batches:
            rows = []
            for p in prompts:
                if p is None:
                    rows.append((None, None, 0, 0))
                    continue
                try:
                    text, usage = with_retries(lambda p=p: model.create(p), attempts, backoff)
                    rows.append((text, None, usage.get("input_tokens", 0), usage.get("output_tokens", 0)))
                except PortError as e:
                    rows.append((None, str(e), 0, 0))
            yield pd.DataFrame(rows, columns=["text", "error", "input_tokens", "output_tokens"])

    return reply


def read_image_text(make: Callable[[], Ocr], lang: str):
    """A column function from image paths to texts; what fails is empty."""

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ocr = make()

        def one(path):
            try:
                return ocr.text_of(path, lang) if path else ""
            except Exception:  # a frame that can't be read must not stop a lecture
                return ""

        for paths in batches:
            yield paths.map(one)

    return text


def probe_duration(make: Callable[[], MediaProbe]):
    """A column function from media paths to seconds; null where that fails."""

    @F.pandas_udf("double")
    def seconds(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        probe = make()

        def one(path):
            try:
                return probe.duration(path)
            except Exception:  # unknown, like a file that isn't media
                return None

        for paths in batches:
            yield pd.Series([one(p) for p in paths], dtype="float64")

    return seconds


def rows_from(df: DataFrame, columns: list[str], ddl: str, make: Callable[[], Callable[..., Iterable[tuple]]], most: int = 1024) -> DataFrame:
    """The rows that a task's function yields for each row of ``df``'s columns, with those columns in front; held ``most`` at a time."""
    schema = StructType([df.schema[c] for c in columns] + StructType.fromDDL(ddl).fields)
    shape = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        produce, held = make(), []

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), shape, strict=True)], schema=shape)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for made in produce(*row):
                    held.append((*row, *made))
                    if len(held) >= most:
                        yield flush()
                        held.clear()
        if held:
            yield flush()

    return df.select(*columns).mapInArrow(run, schema)


def sample_frames(videos: DataFrame, make: Callable[[], FrameReader], interval: float = 1.5) -> DataFrame:
    """(lecture_id, path, frame_idx, timestamp, pixels) of each video's sampled frames, read one after another."""

    def maker():
        reader = make()
        return lambda lecture, path: reader.frames(path, interval)

    return rows_from(videos, ["lecture_id", "path"], "frame_idx int, timestamp double, pixels array<int>", maker, most=64)


def transcribe(recordings: DataFrame, make: Callable[[], Transcriber]) -> DataFrame:
    """(lecture_id, path, prompt, language, seg_index, start, end, text) of each recording (lecture_id, path, prompt)."""

    def maker():
        engine = make()

        def produce(lecture, path, prompt):
            language, segments = with_retries(lambda: engine.transcribe(path, prompt or ""))
            for i, (start, end, text) in enumerate(segments):
                yield language, i, start, end, text.strip()

        return produce

    return rows_from(recordings, ["lecture_id", "path", "prompt"], "language string, seg_index int, start double, end double, text string", maker)


def transcribe_in_chunks(chunks: DataFrame, make: Callable[[], Transcriber], tail_chars: int = 200) -> DataFrame:
    """(lecture_id, part, duration, language, segments) of chunks (lecture_id, part, path, duration, vocabulary).

    A chunk's prompt holds the end of the text before it, so a lecture's chunks go in turn, and lectures in parallel.
    """
    result = "lecture_id string, part int, duration double, language string, segments array<struct<start:double,end:double,text:string>>"

    def run(table: pd.DataFrame) -> pd.DataFrame:
        engine, tail, rows = make(), "", []
        for c in table.sort_values("part").itertuples():
            prompt = " ".join(x for x in (c.vocabulary or "", tail) if x)
            language, segments = with_retries(lambda c=c, prompt=prompt: engine.transcribe(c.path, prompt))
            made = [{"start": float(s), "end": float(e), "text": t.strip()} for s, e, t in segments]
            tail = made[-1]["text"][-tail_chars:] if made else ""
            rows.append((c.lecture_id, c.part, c.duration, language, made))
        return pd.DataFrame(rows, columns=["lecture_id", "part", "duration", "language", "segments"])

    return chunks.groupBy("lecture_id").applyInPandas(run, result)


def ocr_events(events: DataFrame, make: Callable[[], Ocr], lang: str = "eng", most_bits: int = 3, keys=KEYS) -> DataFrame:
    """Events with ``ocr_text``; of a chain of near-equal frames only the first is read, the others share its text."""
    owned = ocr_owner(events, most_bits=most_bits, keys=keys)
    heads = owned.where("owner = event_index").select(*keys, F.col("owner").alias("__owner"), "frame_image_path")
    texts = heads.select(*[F.col(k).alias(f"__{k}") for k in keys], "__owner", read_image_text(make, lang)("frame_image_path").alias("ocr_text"))
    same = (F.col("owner") == F.col("__owner"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    joined = owned.join(texts, same, "left").drop("__owner", *[f"__{k}" for k in keys])
    return joined.withColumn("ocr_text", F.coalesce("ocr_text", F.lit("")))


def example_prompt() -> F.Column:
    ink = F.when(F.col("ink_delta").isNotNull(), F.concat(F.lit(", new ink "), F.col("ink_delta").cast("string"))).otherwise("")
    part = lambda name, c: F.concat(F.lit(f"\n\n{name}:\n"), F.coalesce(F.nullif(strip(F.coalesce(c, F.lit(""))), F.lit("")), F.lit("(none)")))
    return F.concat(
        F.lit("Found as "), "kind", F.lit(" with score "), F.format_number("score", 3), ink,
        part("Printed on the slide", F.col("slide_text")), part("Said around this moment", F.col("transcript_context")), part("Cues", F.array_join("cue_hits", ", ")),
    )


def confirm_examples(candidates: DataFrame, make: Callable[[], LanguageModel], cap: int = 40, keys=KEYS) -> tuple[DataFrame, DataFrame]:
    """Confirmed and rejected candidates of those ranked first; what fails or can't be read is rejected. Write the result before using both."""
    ranked = rank_candidates(candidates, cap, keys).withColumn("reply", ask(make)(example_prompt()))
    return split_verdicts(ranked.withColumn("verdict", parse_verdict(F.coalesce("reply.text", F.lit("")))))


def note_prompt() -> F.Column:
    return F.concat(F.lit("Slide text:\n"), F.coalesce("slide_text", F.lit("")), F.lit("\n\nSpeaker notes:\n"), F.coalesce("notes_text", F.lit("")), F.lit("\n\nTranscript:\n"), F.coalesce("transcript_text", F.lit("")))


def slide_notes(segments: DataFrame, make: Callable[[], LanguageModel]) -> DataFrame:
    """Segments with ``note`` STRUCT<skipped, error, text, input_tokens, output_tokens>; without anything to summarize nothing is asked."""
    blank = lambda c: strip(F.coalesce(c, F.lit(""))) == ""
    nothing = blank(F.col("transcript_text")) & ((F.col("mode") == "visual") | blank(F.col("slide_text")))
    rows = segments.withColumn("__skip", nothing).withColumn("__reply", ask(make)(F.when(~F.col("__skip"), note_prompt())))
    note = F.struct(F.col("__skip").alias("skipped"), F.col("__reply.error").alias("error"), F.col("__reply.text").alias("text"), F.col("__reply.input_tokens").alias("input_tokens"), F.col("__reply.output_tokens").alias("output_tokens"))
    return rows.withColumn("note", note).drop("__skip", "__reply")


def one_document(texts: DataFrame, instruction: str, make: Callable[[], LanguageModel], keys=(), order="lecture_id", chars: int = 350_000) -> DataFrame:
    """(keys, reply): one answer for each group's texts, joined in order and cut to ``chars``; used for indexes and sheets.

    Only what fits is joined.
    """
    from .plans.prompts import joined_within

    rows = joined_within(texts.withColumn("__whole", F.lit(0)), chars, keys or ("__whole",), order)
    return rows.select(*keys, ask(make)(F.concat(F.lit(instruction + "\n\n"), "text")).alias("reply"))


def exam_papers(material: DataFrame, blueprint: DataFrame, count: int, make: Callable[[], LanguageModel]) -> DataFrame:
    """(exam, paper, key, error): ``count`` papers from one material (text) and one blueprint (blueprint); a paper without a key gets a placeholder."""
    from .functions.text import split_exam
    from .plans.prompts import exam_prompt

    base = material.select("text").crossJoin(blueprint.select("blueprint"))
    rows = base.select(F.explode(F.sequence(F.lit(1), F.lit(count))).alias("number"), "text", "blueprint")
    rows = rows.repartition(count, "number").withColumn("reply", ask(make)(exam_prompt(count))).withColumn("parts", split_exam("reply.text"))
    key = F.coalesce("parts.key", F.lit("No key was given."))
    return rows.select(F.format_string("exam_%02d", "number").alias("exam"), "parts.paper", F.when(F.col("reply.error").isNull(), key).alias("key"), F.col("reply.error").alias("error"))


class FakeModel:
    """Answers with a digest of the prompt; fails on prompts that hold FAIL."""

    def create(self, prompt: str) -> tuple[str, dict[str, int]]:
        if "FAIL" in prompt:
            raise PortError("refused", 400)
        return f"## Note {hashlib.md5(prompt.encode()).hexdigest()[:8]}", {"input_tokens": len(prompt.split()), "output_tokens": 3}


class FakeOcr:
    """Reads an image's text from its name."""

    def text_of(self, path: str, lang: str) -> str:
        return path.rsplit("/", 1)[-1].rsplit(".", 1)[0].replace("_", " ")


class FakeFrames:
    """Eight flat frames that turn brighter halfway; the path's length sets the shade."""

    def frames(self, path: str, interval: float):
        for i in range(8):
            yield i, i * interval, [min(255, len(path) % 100 + 100 * (i >= 4))] * 16


class FakeTranscriber:
    """Two segments that say the path and the prompt."""

    def transcribe(self, path: str, prompt: str):
        return "en", [(0.0, 2.0, f" {path} "), (2.0, 4.0, prompt)]


#: What a fetcher's output says when a video needs a signed-in browser.
PRIVATE = ("private video", "sign in")


def fetch_videos(planned: DataFrame, make: Callable[[], VideoFetcher], folder: str) -> DataFrame:
    """(lecture_id, url, path, code, cookies, output) of lectures to fetch (lecture_id, url); a private one is tried once more with a browser's cookies."""

    def maker():
        fetcher = make()

        def produce(lecture, url):
            path = f"{folder.rstrip('/')}/{lecture}.mp4"
            code, output = fetcher.fetch(url, path, False)
            again = code != 0 and any(m in output.lower() for m in PRIVATE)
            if again:
                code, output = fetcher.fetch(url, path, True)
            yield path if code == 0 else None, code, again, output[-2000:]

        return produce

    return rows_from(planned, ["lecture_id", "url"], "path string, code int, cookies boolean, output string", maker, most=1)


def deck_pages(files: DataFrame, make: Callable[[], PageRenderer]) -> DataFrame:
    """(lecture_id, path, page_number, text, image_path) of every page of the decks (lecture_id, path)."""

    def maker():
        renderer = make()
        return lambda lecture, path: renderer.pages(path)

    return rows_from(files, ["lecture_id", "path"], "page_number int, text string, image_path string", maker, most=256)


def convert_decks(files: DataFrame, make: Callable[[], DocumentConverter], folder: str) -> DataFrame:
    """(lecture_id, path, pdf, error) of decks; a failure is a value, so that one deck doesn't stop the others."""

    def maker():
        converter = make()

        def produce(lecture, path):
            try:
                yield converter.to_pdf(path, folder), None
            except PortError as e:
                yield None, str(e)

        return produce

    return rows_from(files, ["lecture_id", "path"], "pdf string, error string", maker, most=16)


def extract_audio(videos: DataFrame, make: Callable[[], AudioExtractor], folder: str, compressed: bool = False) -> DataFrame:
    """(lecture_id, path, audio) of videos (lecture_id, path)."""

    def maker():
        extractor = make()
        return lambda lecture, path: [(extractor.extract(path, folder, compressed),)]

    return rows_from(videos, ["lecture_id", "path"], "audio string", maker, most=16)


def preview_frames(videos: DataFrame, make: Callable[[], FrameReader], at: float = 60.0) -> DataFrame:
    """(lecture_id, path, timestamp, pixels): the frame at a time, or the first where the video is shorter."""

    def maker():
        reader = make()

        def produce(lecture, path):
            first = None
            for _, time_, pixels in reader.frames(path, at):
                if time_ >= at:
                    yield time_, pixels
                    return
                first = first or (time_, pixels)
            if first:
                yield first

        return produce

    return rows_from(videos, ["lecture_id", "path"], "timestamp double, pixels array<int>", maker, most=16)


def load_images(make: Callable[[], Callable[[str], bytes]]):
    """A column function from image paths to base64 text of what the task's loader gives; null where that fails."""

    @F.pandas_udf(StringType())
    def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        load = make()

        def one(path):
            try:
                return base64.b64encode(load(path)).decode("ascii")
            except Exception:  # a missing image is left out of a prompt
                return None

        for paths in batches:
            yield paths.map(one, na_action="ignore")

    return encoded


def print_documents(documents: DataFrame, make: Callable[[], HtmlPrinter], folder: str) -> DataFrame:
    """(name, html, pdf): documents (name, html) printed by the tasks into a folder that all share."""

    def maker():
        printer = make()

        def produce(name, html):
            path = f"{folder.rstrip('/')}/{name}.pdf"
            printer.print_pdf(html, path)
            yield (path,)

        return produce

    return rows_from(documents, ["name", "html"], "pdf string", maker, most=4)


class FakeFetcher:
    """Fetches all but addresses with "gone"; those with "private" need cookies."""

    def fetch(self, url: str, path: str, cookies: bool) -> tuple[int, str]:
        if "gone" in url or ("private" in url and not cookies):
            return 1, "ERROR: Private video. Sign in" if "private" in url else "ERROR: 404"
        return 0, "[download] 100%"


class FakeRenderer:
    """Three pages that name their deck; the last has no text."""

    def pages(self, path: str):
        for i in (1, 2, 3):
            yield i, f"{path} page {i}\nbody" if i < 3 else "", f"{path}-{i}.png"


class FakeConverter:
    def to_pdf(self, path: str, folder: str) -> str:
        if path.endswith(".bad"):
            raise PortError("cannot convert")
        return f"{folder}/{path.rsplit('/', 1)[-1].rsplit('.', 1)[0]}.pdf"


class FakeExtractor:
    def extract(self, path: str, folder: str, compressed: bool) -> str:
        return f"{folder}/{path.rsplit('/', 1)[-1].rsplit('.', 1)[0]}.{'opus' if compressed else 'wav'}"


class FakePrinter:
    def print_pdf(self, html: str, path: str) -> None:
        with open(path, "w") as f:
            f.write(html)
