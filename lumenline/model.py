"""Schemas of the stored entities, and the tunables of the stages."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql.types import StructType

#: Every lecture's rows are found by this column; operators partition by it.
LECTURE = "lecture_id"

TRANSCRIPT = "lecture_id string, language string, segments array<struct<start:double,end:double,text:string>>"
SLIDE = "lecture_id string, slide_number int, title string, body_text string, notes_text string, image_path string"
FRAME = "lecture_id string, frame_idx int, timestamp double, pixels array<int>"
FRAME_EVENT = "lecture_id string, event_index int, timestamp double, frame_image_path string"
MATCH = (
    "lecture_id string, event_index int, timestamp double, frame_image_path string, ocr_excerpt string, slide_number int, score double, "
    "jumped_backward boolean, stayed_over_raw_best boolean, in_order_best_slide_number int, in_order_best_score double, "
    "backward_best_slide_number int, backward_best_score double"
)
TIMELINE_ENTRY = "slide_number int, start double, end double, confidence double, last_frame_image_path string, segment_keywords array<string>"
EXAMPLE_CANDIDATE = (
    "event_index int, timestamp double, frame_image_path string, slide_number int, kind string, score double, ink_delta int, ocr_excerpt string"
)
SEGMENT = (
    "lecture_id string, slide_number int, mode string, slide_text string, notes_text string, transcript_text string, start double, end double, "
    "windows array<struct<start:double,end:double>>, merged_from array<int>, frame_image_path string, "
    f"example_candidates array<struct<{EXAMPLE_CANDIDATE.replace(' ', ':').replace(',:', ',')}>>"
)
USAGE = "input_tokens long, output_tokens long, cache_creation_input_tokens long, cache_read_input_tokens long"
VERDICT = "is_example boolean, kind string, caption string, confidence double"
EXAM_PAGE = "source string, page_number int, text string, image_path string"
JOB_EVENT = "seq long, type string, ts double, job_id string, lecture_id string, stage int, line string"
TASK = "lecture_id string, stage int, argv array<string>"


def schema(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)


@dataclass(frozen=True)
class Tunables:
    """Defaults of the stages; times are in seconds."""

    sample_interval: float = 1.5
    visual_interval: float = 4.0
    change_threshold: float = 0.02
    diff_width: int = 320
    backward_margin: float = 0.15
    stay_margin: float = 0.05
    confidence_threshold: float = 0.25
    min_forward_score: float = 0.05
    auto_visual_threshold: float = 0.60
    duplicate_bits: int = 3
    example_score_max: float = 0.12
    example_ink_delta: int = 12
    example_overlap_min: float = 0.5
    example_novel_min: float = 0.35
    visual_similarity: float = 0.35
    visual_min_seconds: float = 45.0
    visual_min_df: int = 2
    visual_keywords: int = 8
    min_dwell: float = 5.0
    context_before: float = 20.0
    context_after: float = 40.0
    examples_cap: int = 40
    excerpt_chars: int = 150
    chunk_safety: float = 0.85
    min_chunk_seconds: float = 60.0
    retries: int = 3
    backoff_seconds: float = 2.0
    tail_chars: int = 200
    vocabulary_chars: int = 700
    guide_chars: int = 350_000
    overview_chars: int = 60_000


DEFAULTS = Tunables()
