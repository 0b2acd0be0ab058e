"""The operators as queries over the driver's tables, with SQL that gives the same rows.

Events stand for the frames of a lecture (a user), their types for slides and their values for scores;
conversations stand for transcripts, with times from the lengths of their texts; documents stand for slides and pages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as fn
from ..model import Tunables
from ..operators import catalog, chunks, decks, match, review, runs, segment, tfidf, visual
from ..sources import artifacts
from ..sources.pool import Pool
from ..sources.scratch import scratch, stored
from . import documents, stages

QUERIES: dict = {}
SQL: dict[str, str] = {}

TYPES = ("click", "error", "purchase", "signup", "view")


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# Shared inputs

EV = """ev AS (SELECT user_id AS lecture_id, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS event_index,
 epoch_us(ts) / 1e6 AS timestamp, list_position(['click','error','purchase','signup','view'], event_type) AS slide_number,
 event_type, value AS score, 'frame_' || event_id || '.png' AS frame_image_path, CAST(json_extract(props, '$.k') AS BIGINT) AS hash FROM events)"""


def lecture_events(spark, d: str) -> DataFrame:
    e = table(spark, d, "events")
    place = F.array_position(F.array(*[F.lit(t) for t in TYPES]), F.col("event_type")).cast("int")
    return e.select(
        F.col("user_id").alias("lecture_id"),
        (F.row_number().over(Window.partitionBy("user_id").orderBy("ts")) - 1).cast("long").alias("event_index"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).alias("timestamp"),
        place.alias("slide_number"),
        "event_type",
        F.col("value").alias("score"),
        F.concat(F.lit("frame_"), F.col("event_id").cast("string"), F.lit(".png")).alias("frame_image_path"),
        F.get_json_object("props", "$.k").cast("long").alias("hash"),
    )


RUNS = EV + """, flagged AS (SELECT *, CASE WHEN event_index = 0 OR slide_number = lag(slide_number) OVER (PARTITION BY lecture_id ORDER BY event_index) THEN 0 ELSE 1 END AS brk FROM ev),
 placed AS (SELECT *, CAST(sum(brk) OVER (PARTITION BY lecture_id ORDER BY event_index) AS BIGINT) AS run_idx FROM flagged),
 collapsed AS (SELECT lecture_id, run_idx, any_value(slide_number) AS slide_number, min(timestamp) AS s, max(timestamp) AS last_ts, max(score) AS confidence,
  arg_max(frame_image_path, event_index) AS last_frame_image_path, count(*) AS n_events FROM placed GROUP BY ALL),
 runs AS (SELECT *, coalesce(lead(s) OVER (PARTITION BY lecture_id ORDER BY run_idx), last_ts) AS e FROM collapsed)"""

ABSORBED = RUNS + """, sh AS (SELECT *, e - s < 14400 AS short FROM runs),
 st AS (SELECT *, CASE WHEN NOT short THEN run_idx END AS stays FROM sh),
 tg AS (SELECT *, coalesce(first_value(stays IGNORE NULLS) OVER (PARTITION BY lecture_id ORDER BY run_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
   max(stays) OVER (PARTITION BY lecture_id), max(run_idx) OVER (PARTITION BY lecture_id)) AS target,
   lag(short) OVER w AS prev_short, lag(slide_number) OVER w AS prev_slide, max(stays) OVER (PARTITION BY lecture_id) AS final,
   last_value(short) OVER (PARTITION BY lecture_id ORDER BY run_idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS tail_short,
   last_value(slide_number) OVER (PARTITION BY lecture_id ORDER BY run_idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS tail_slide,
   max(run_idx) OVER (PARTITION BY lecture_id) AS fin FROM st WINDOW w AS (PARTITION BY lecture_id ORDER BY run_idx)),
 absorbed AS (SELECT *, CASE WHEN target <> run_idx THEN [] ELSE list_concat(CASE WHEN prev_short THEN [prev_slide] ELSE [] END,
   CASE WHEN tail_short AND run_idx = final AND final <> fin THEN [tail_slide] ELSE [] END) END AS merged_from FROM tg)"""


def slide_runs(spark, d: str) -> DataFrame:
    return runs.collapse_runs(lecture_events(spark, d))


def absorbed_runs(spark, d: str) -> DataFrame:
    return runs.absorb_forward(slide_runs(spark, d), 14_400)


def scaled(c: str, by: int) -> F.Column:
    """Values times ``by`` as whole numbers; single ones are multiplied as such, as SQL does, for the product may round up to the next number."""
    return F.transform(c, lambda x: (x * F.lit(by).cast("float")).cast("long"))


def numbers(c) -> F.Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


# Sequences

@query(f"""WITH {EV}, d AS (SELECT *, abs(score - lag(score) OVER (PARTITION BY lecture_id ORDER BY timestamp)) AS diff FROM ev)
SELECT lecture_id, row_number() OVER (PARTITION BY lecture_id ORDER BY timestamp) - 1 AS event_index, round(timestamp, 3) AS timestamp, score FROM d WHERE diff IS NULL OR diff > 35""")
def change_events(spark, d):
    rows = runs.change_events(lecture_events(spark, d).drop("event_index"), 35, "score")
    return rows.select("lecture_id", "event_index", F.round("timestamp", 3).alias("timestamp"), "score")


@query(f"WITH {RUNS} SELECT lecture_id, run_idx, slide_number, s AS run_start, e AS run_end, confidence, last_frame_image_path, n_events FROM runs")
def run_collapse(spark, d):
    return slide_runs(spark, d).select("lecture_id", "run_idx", "slide_number", F.col("start").alias("run_start"), F.col("end").alias("run_end"), "confidence", "last_frame_image_path", "n_events")


@query(f"""WITH {EV}, o AS (SELECT *, CASE WHEN bit_count(xor(hash, lag(hash) OVER (PARTITION BY lecture_id ORDER BY event_index))) <= 2 THEN NULL ELSE event_index END AS own FROM ev),
p AS (SELECT *, max(own) OVER (PARTITION BY lecture_id ORDER BY event_index) AS owner FROM o)
SELECT lecture_id, event_index, owner, first_value(hash) OVER (PARTITION BY lecture_id, owner ORDER BY event_index) AS owner_hash FROM p""")
def ocr_ownership(spark, d):
    owned = runs.ocr_owner(lecture_events(spark, d), most_bits=2)
    return runs.owners_text(owned.withColumn("owner_hash", F.col("hash")), "owner_hash").select("lecture_id", "event_index", "owner", "owner_hash")


@query(f"WITH {ABSORBED} SELECT lecture_id, run_idx, slide_number, short, target, array_to_string(merged_from, ',') AS merged_from FROM absorbed")
def short_dwell_merge(spark, d):
    return absorbed_runs(spark, d).select("lecture_id", "run_idx", "slide_number", "short", "target", numbers("merged_from").alias("merged_from"))


@query(f"""WITH {EV}, a AS (SELECT *, CASE WHEN event_index > 0 AND abs(score - lag(score) OVER (PARTITION BY lecture_id ORDER BY event_index)) > 35 THEN 1 ELSE 0 END AS brk FROM ev),
b AS (SELECT *, sum(brk) OVER (PARTITION BY lecture_id ORDER BY event_index) AS isl FROM a),
i AS (SELECT lecture_id, isl, min(timestamp) AS s, max(timestamp) AS l, count(*) AS n FROM b GROUP BY ALL),
m AS (SELECT *, sum(CASE WHEN isl = 0 OR l - s >= 28800 THEN 1 ELSE 0 END) OVER (PARTITION BY lecture_id ORDER BY isl) - 1 AS merged FROM i)
SELECT lecture_id, CAST(merged AS BIGINT) AS merged_idx, min(s) AS seg_start, max(l) AS seg_last, CAST(sum(n) AS BIGINT) AS n_events FROM m GROUP BY ALL""")
def backward_absorb(spark, d):
    e = lecture_events(spark, d)
    rows = e.withColumn("similarity", -F.abs(F.col("score") - F.lag("score").over(runs.ordered())))
    isl = runs.similarity_runs(rows, -35).groupBy("lecture_id", "run_idx").agg(F.min("timestamp").alias("start"), F.max("timestamp").alias("last"), F.count("*").alias("n"))
    merged = runs.absorb_backward(isl, 28_800)
    return merged.groupBy("lecture_id", "merged_idx").agg(F.min("start").alias("seg_start"), F.max("last").alias("seg_last"), F.sum("n").alias("n_events"))


CONSOLIDATED = ABSORBED + """, alive AS (SELECT *, CASE WHEN n_events > 1 THEN 'e' || n_events ELSE '' END AS run_text FROM absorbed WHERE target = run_idx),
 cons AS (SELECT lecture_id, slide_number, min(run_idx) AS first_run, arg_min(s, run_idx) AS seg_start, arg_max(e, run_idx) AS seg_end, count(*) AS n_windows,
  coalesce(string_agg(nullif(run_text, ''), chr(10) || chr(10) ORDER BY run_idx), '') AS transcript_text,
  array_to_string(flatten(list(merged_from ORDER BY run_idx)), ',') AS merged_from, arg_max(last_frame_image_path, run_idx) AS frame_image_path FROM alive GROUP BY lecture_id, slide_number)"""


def consolidated(spark, d) -> DataFrame:
    alive = absorbed_runs(spark, d).where("target = run_idx")
    alive = alive.withColumn("run_text", F.when(F.col("n_events") > 1, F.concat(F.lit("e"), F.col("n_events").cast("string"))).otherwise(""))
    return segment.consolidate(alive)


@query(f"WITH {CONSOLIDATED} SELECT * FROM cons")
def consolidate_runs(spark, d):
    c = consolidated(spark, d)
    return c.select("lecture_id", "slide_number", "first_run", F.col("start").alias("seg_start"), F.col("end").alias("seg_end"), F.size("windows").cast("long").alias("n_windows"), "transcript_text", numbers("merged_from").alias("merged_from"), "frame_image_path")


@query("""SELECT user_id AS lecture_id, event_id, value FROM (SELECT *, max(value) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM events) WHERE best IS NULL OR value > best""")
def progress_running_max(spark, d):
    rows = table(spark, d, "events").withColumnRenamed("user_id", "lecture_id")
    return runs.running_maximum(rows, "value", "ts").select("lecture_id", "event_id", "value")


@query(f"""WITH {EV}, {{cls}} SELECT lecture_id, event_index, kind, CAST(ink_delta AS INTEGER) AS ink_delta FROM last_kind""".replace("{cls}", """r AS (SELECT *, sum(brk) OVER (PARTITION BY lecture_id ORDER BY event_index) AS run_idx FROM
 (SELECT *, CASE WHEN event_index = 0 OR slide_number = lag(slide_number) OVER (PARTITION BY lecture_id ORDER BY event_index) THEN 0 ELSE 1 END AS brk FROM ev)),
 f AS (SELECT *, first_value(hash) OVER (PARTITION BY lecture_id, run_idx ORDER BY event_index) AS h0 FROM r),
 k AS (SELECT *, bit_count(xor(hash * 2654435761, h0 * 2654435761)) AS ink_delta FROM f),
 x AS (SELECT *, CASE WHEN score > 80 THEN 'words of another kind ' || hash WHEN hash % 3 = 0 THEN 'topic ' || event_type ELSE event_type || ' ' || hash END AS excerpt, list_distinct(['topic', event_type] || CASE WHEN slide_number = 2 THEN ['exercise'] ELSE [] END) AS deck FROM k),
 y AS (SELECT *, string_split(first_value(excerpt) OVER (PARTITION BY lecture_id, run_idx ORDER BY event_index), ' ') AS was, string_split(excerpt, ' ') AS own FROM x),
 z AS (SELECT *, len(list_intersect(was, own)) / len(list_distinct(was)) AS shows, len(list_filter(list_distinct(own), lambda w: NOT list_contains(deck, w))) / len(list_distinct(own)) AS adds FROM y),
 c AS (SELECT *, CASE WHEN score < 12 THEN 'whiteboard' WHEN ink_delta >= 12 AND shows >= 0.5::DOUBLE AND adds >= 0.35::DOUBLE THEN 'annotated_slide' WHEN slide_number = 2 THEN 'example_slide' END AS kind FROM z),
 n AS (SELECT *, lead(kind) OVER (PARTITION BY lecture_id, run_idx ORDER BY event_index) AS nxt FROM c WHERE kind IS NOT NULL),
 last_kind AS (SELECT * FROM n WHERE nxt IS NULL OR nxt <> kind)"""))
def example_classify(spark, d):
    return candidates(spark, d).select("lecture_id", "event_index", "kind", "ink_delta")


def candidates(spark, d) -> DataFrame:
    e = lecture_events(spark, d)
    number = F.col("hash").cast("string")
    excerpt = F.when(F.col("score") > 80, F.concat(F.lit("words of another kind "), number)).when(F.col("hash") % 3 == 0, F.concat(F.lit("topic "), "event_type")).otherwise(F.concat("event_type", F.lit(" "), number))
    e = e.withColumn("ocr_excerpt", excerpt).withColumn("hash", F.col("hash") * F.lit(2654435761))
    names = F.concat(F.lit("Topic "), "event_type", F.when(F.col("slide_number") == 2, " exercise").otherwise(""))
    slides = e.select("lecture_id", "slide_number", names.alias("reference_text")).distinct()
    return match.classify_examples(e, slides, score_max=12)


@query("WITH " + SQL["example_classify"].split("WITH ", 1)[1].rsplit(" SELECT lecture_id", 1)[0] + """, q AS (SELECT *, CASE WHEN hash % 2 = 0 THEN 0 ELSE 1 END AS nocue,
 CASE kind WHEN 'whiteboard' THEN 0 WHEN 'annotated_slide' THEN 1 ELSE 2 END AS pri FROM last_kind)
SELECT lecture_id, event_index, kind, place FROM (SELECT *, row_number() OVER (PARTITION BY lecture_id ORDER BY nocue, pri, timestamp, event_index) AS place FROM q) WHERE place <= 5""")
def rank_limit(spark, d):
    c = candidates(spark, d).withColumn("cue_hits", F.when(F.col("hash") % 2 == 0, F.array(F.lit("example"))).otherwise(F.array().cast("array<string>")))
    return catalog.rank_candidates(c, 5).select("lecture_id", "event_index", "kind", F.col("place").cast("long").alias("place"))


# Transcripts

CONV = """seg AS (SELECT conv_id AS lecture_id, turn AS seg_index, role, text, length(text) / 10.0::DOUBLE AS dur,
 coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 10.0::DOUBLE AS s,
 sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) / 10.0::DOUBLE AS e FROM conversations)"""


def transcript(spark, d) -> DataFrame:
    c = table(spark, d, "conversations")
    upto = F.sum(F.length("text")).over(Window.partitionBy("conv_id").orderBy("turn"))
    return c.select(
        F.col("conv_id").alias("lecture_id"), F.col("turn").alias("seg_index"), "role", "text",
        (F.length("text") / F.lit(10.0)).alias("duration"), ((upto - F.length("text")) / F.lit(10.0)).alias("start"), (upto / F.lit(10.0)).alias("end"),
    )


def minute_runs(t: DataFrame) -> DataFrame:
    """Runs of a minute, the last one open."""
    last = t.groupBy("lecture_id").agg(F.max("end").alias("e"))
    r = last.select("lecture_id", "e", F.explode(F.sequence(F.lit(0), F.ceil(F.col("e") / 60).cast("int") - 1)).alias("run_idx"))
    open_end = F.when((F.col("run_idx") + 1) * 60 < F.col("e"), ((F.col("run_idx") + 1) * 60).cast("double"))
    return r.select("lecture_id", F.col("run_idx").cast("long").alias("run_idx"), (F.col("run_idx") * 60).cast("double").alias("start"), open_end.alias("end"))


MINUTES = """r AS (SELECT lecture_id, i AS run_idx, i * 60.0::DOUBLE AS rs, CASE WHEN (i + 1) * 60 < last THEN (i + 1) * 60.0::DOUBLE ELSE 'infinity'::DOUBLE END AS re FROM
 (SELECT lecture_id, last, unnest(range(CAST(ceil(last / 60) AS BIGINT))) AS i FROM (SELECT lecture_id, max(e) AS last FROM seg GROUP BY ALL)))"""


@query(f"""WITH {CONV}, {MINUTES}, p AS (SELECT lecture_id, seg_index, run_idx, least(e, re) - greatest(s, rs) AS overlap FROM seg JOIN r USING (lecture_id) WHERE s < re AND rs < e)
SELECT lecture_id, seg_index, run_idx, round(overlap, 6) AS overlap FROM (SELECT *, row_number() OVER (PARTITION BY lecture_id, seg_index ORDER BY overlap DESC, run_idx) AS k FROM p) WHERE k = 1""")
def segment_assign(spark, d):
    t = transcript(spark, d)
    return segment.assign_to_runs(t, minute_runs(t)).select("lecture_id", "seg_index", "run_idx", F.round("overlap", 6).alias("overlap"))


@query(f"""WITH {CONV}, {MINUTES.replace("'infinity'::DOUBLE", "last")}
SELECT lecture_id, seg_index, run_idx, round(least(e, re) - greatest(s, rs), 6) AS overlap FROM seg JOIN r USING (lecture_id) WHERE s < re AND rs < e""")
def bucketed_overlap(spark, d):
    t = transcript(spark, d)
    r = minute_runs(t).join(t.groupBy("lecture_id").agg(F.max("end").alias("last")), "lecture_id")
    left = t.select("lecture_id", "seg_index", F.col("start").alias("l_start"), F.col("end").alias("l_end"))
    right = r.select("lecture_id", "run_idx", F.col("start").alias("r_start"), F.coalesce("end", "last").alias("r_end"))
    return segment.bucketed_overlap(left, right, 30.0).select("lecture_id", "seg_index", "run_idx", F.round(F.least("l_end", "r_end") - F.greatest("l_start", "r_start"), 6).alias("overlap"))


@query(f"""WITH {CONV} SELECT a.lecture_id, a.seg_index AS anchor_id, md5(coalesce(string_agg(b.text, ' ' ORDER BY b.seg_index), '')) AS context_md5, count(b.seg_index) AS n_segments
FROM seg a LEFT JOIN seg b ON a.lecture_id = b.lecture_id AND b.e >= a.s + 5 - 20 AND b.s <= a.s + 5 + 40 GROUP BY ALL""")
def context_window(spark, d):
    t = transcript(spark, d)
    anchors = t.select("lecture_id", F.col("seg_index").alias("anchor_id"), (F.col("start") + 5).alias("timestamp"))
    rows = segment.context_around(anchors, t)
    n = t.select("lecture_id", F.col("start").alias("s"), F.col("end").alias("e")).join(anchors, "lecture_id").where((F.col("e") >= F.col("timestamp") - 20) & (F.col("s") <= F.col("timestamp") + 40)).groupBy("lecture_id", "anchor_id").agg(F.count("*").alias("n_segments"))
    return rows.select("lecture_id", "anchor_id", F.md5("transcript_context").alias("context_md5")).join(n, ["lecture_id", "anchor_id"])


@query(f"""WITH {CONSOLIDATED}, cand AS (SELECT lecture_id, event_index, CASE WHEN score < 25 THEN 99 ELSE slide_number END AS want, timestamp - CASE WHEN score < 5 THEN 1e7 ELSE 0 END AS t FROM ev),
p AS (SELECT c.lecture_id, event_index, min(CASE WHEN want = k.slide_number THEN first_run END) AS eq,
 min(CASE WHEN EXISTS (SELECT 1 FROM alive a WHERE a.lecture_id = c.lecture_id AND a.slide_number = k.slide_number AND a.s <= c.t AND c.t <= a.e) THEN first_run END) AS ins,
 arg_min(first_run, {{'d': abs(seg_start - t), 'r': first_run}}) AS near FROM cand c JOIN cons k ON c.lecture_id = k.lecture_id GROUP BY ALL)
SELECT lecture_id, event_index, coalesce(eq, ins, near) AS segment_idx, CASE WHEN eq IS NOT NULL THEN 'slide' WHEN ins IS NOT NULL THEN 'window' ELSE 'nearest' END AS rung FROM p""")
def cascade_attach(spark, d):
    e = lecture_events(spark, d)
    cand = e.select("lecture_id", "event_index", F.when(F.col("score") < 25, 99).otherwise(F.col("slide_number")).alias("slide_number"), (F.col("timestamp") - F.when(F.col("score") < 5, F.lit(1e7)).otherwise(F.lit(0.0))).alias("timestamp"))
    segs = stored(consolidated(spark, d).withColumnRenamed("first_run", "segment_idx").select("lecture_id", "segment_idx", "slide_number", "windows"), "segments")
    return segment.cascade_attach(cand, segs).select("lecture_id", "event_index", "segment_idx", "rung")


@query("""SELECT conv_id AS lecture_id, turn AS part, coalesce(sum(length(text) / 10.0::DOUBLE) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part_offset FROM conversations""".replace("coalesce(sum", "round(coalesce(sum").replace(", 0) AS", ", 0), 6) AS"))
def chunk_offsets(spark, d):
    parts = transcript(spark, d).withColumnRenamed("seg_index", "part")
    return runs.running_offsets(parts).select("lecture_id", "part", F.round("offset", 6).alias("part_offset"))


@query(f"""WITH {CONV}, l AS (SELECT lecture_id, coalesce(arg_min(CASE WHEN role = 'user' THEN NULL ELSE role END, CASE WHEN role = 'user' THEN NULL ELSE seg_index END), '') AS language FROM seg GROUP BY ALL)
SELECT lecture_id, language, CAST(seg_index AS INTEGER) AS place, round(s + 1, 6) AS seg_start, round(s + dur, 6) AS seg_end, text FROM seg JOIN l USING (lecture_id)""")
def stitch_transcripts(spark, d):
    t = transcript(spark, d)
    parts = t.select("lecture_id", F.col("seg_index").alias("part"), "duration", F.when(F.col("role") == "user", "").otherwise(F.col("role")).alias("language"))
    segs = t.select("lecture_id", F.col("seg_index").alias("part"), F.lit(0).alias("seg_index"), F.lit(1.0).alias("start"), F.col("duration").alias("end"), "text")
    whole = chunks.stitch(parts, segs)
    flat = whole.select("lecture_id", "language", F.posexplode("segments").alias("place", "x"))
    return flat.select("lecture_id", "language", "place", F.round("x.start", 6).alias("seg_start"), F.round("x.end", 6).alias("seg_end"), "x.text")


@query(f"""WITH {CONV}, a AS (SELECT lecture_id, max(e) AS duration, greatest(60.0::DOUBLE, 2000 * 0.85::DOUBLE / (sum(strlen(text)) / max(e))) AS secs FROM seg GROUP BY ALL)
SELECT lecture_id, CAST(i AS INTEGER) AS part, round(i * secs, 6) AS part_start, round(least(secs, duration - i * secs), 6) AS part_length FROM (SELECT *, unnest(range(greatest(CAST(ceil(duration / secs) AS BIGINT), 1))) AS i FROM a)""")
def chunk_plan(spark, d):
    t = transcript(spark, d)
    a = t.groupBy("lecture_id").agg(F.max("end").alias("duration"), F.sum(F.octet_length("text")).alias("size"))
    a = a.withColumn("chunk_seconds", fn.chunk_seconds("size", "duration", F.lit(2000)))
    return chunks.chunk_plan(a).select("lecture_id", "part", F.round("start", 6).alias("part_start"), F.round("length", 6).alias("part_length"))


@query("SELECT conv_id AS lecture_id, turn AS part, coalesce(right(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), 200), '') AS tail FROM conversations")
def previous_tail(spark, d):
    t = transcript(spark, d).withColumn("part", F.col("seg_index"))
    return runs.previous_tail(t.select("lecture_id", "part", "seg_index", "text"))


# Slides and pages

NORM = "trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))"


@query(f"SELECT source AS lecture_id, doc_id AS slide_number, min(doc_id) OVER (PARTITION BY source, md5(lang || '|' || {NORM})) AS canonical FROM documents")
def canonical_map(spark, d):
    slides = table(spark, d, "documents").select(F.col("source").alias("lecture_id"), F.col("doc_id").alias("slide_number"), F.col("doc_id").alias("position"), F.col("lang").alias("title"), F.col("text").alias("body_text"))
    return segment.canonical_slides(slides)


def marked_pool(spark, d) -> DataFrame:
    pages = table(spark, d, "documents").select("doc_id", F.col("source").alias("file"), F.col("doc_id").alias("page_number"), "text")
    return decks.deduplicate_pool(pages)


@query(f"SELECT doc_id, {NORM} = '' OR row_number() OVER (PARTITION BY md5({NORM}) ORDER BY source, doc_id) = 1 AS kept FROM documents")
def pool_dedup(spark, d):
    return marked_pool(spark, d).select("doc_id", "kept")


@query(f"SELECT count(*) AS scanned, count(DISTINCT {NORM}) AS kept, count(*) - count(DISTINCT {NORM}) AS duplicates_skipped FROM documents")
def pool_report(spark, d):
    return decks.pool_report(marked_pool(spark, d))


@query("SELECT source AS lecture_id, doc_id AS slide_number FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unmatched_slides(spark, d):
    docs = table(spark, d, "documents").select(F.col("source").alias("lecture_id"), F.col("doc_id").alias("slide_number"))
    shown = table(spark, d, "labels").select(F.col("doc_id").alias("slide_number")).join(docs, "slide_number")
    return match.unmatched(docs, shown)


@query("SELECT doc_id, md5(trim(source || chr(10) || text, E' \\n\\t\\r')) AS reference_md5, md5(source || chr(10) || text) AS slide_md5, length(text) - length(replace(text, chr(10), '')) AS n_breaks FROM documents")
def slide_texts(spark, d):
    s = table(spark, d, "documents").withColumn("n_breaks", F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))))
    return s.select("doc_id", F.md5(segment.reference_text("source", "text")).alias("reference_md5"), F.md5(segment.slide_text("source", "text")).alias("slide_md5"), F.col("n_breaks").cast("long").alias("n_breaks"))


@query("""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, E' \\t\\r')), lambda x: x <> '') AS l FROM documents)
SELECT doc_id AS lecture_id, 1 AS slide_number, coalesce(l[1], '') AS title, md5(array_to_string(l[2:], chr(10))) AS body_md5 FROM l""")
def page_slides(spark, d):
    pages = table(spark, d, "documents").select(F.col("doc_id").alias("lecture_id"), F.lit(1).alias("page_number"), "text")
    return decks.pages_to_slides(pages).select("lecture_id", "slide_number", "title", F.md5("body_text").alias("body_md5"))


@query("SELECT n.n_name AS lecture_id, r.r_regionkey AS slide_number, r.r_name AS title FROM nation n CROSS JOIN region r")
def deck_distribution(spark, d):
    deck = table(spark, d, "region").select(F.col("r_regionkey").alias("slide_number"), F.col("r_name").alias("title"))
    return decks.distribute(deck, table(spark, d, "nation").select(F.col("n_name").alias("lecture_id"))).select("lecture_id", "slide_number", "title")


@query("""WITH t AS (SELECT p_brand AS lecture_id, p_name AS title, min(p_partkey) AS pos FROM part WHERE length(trim(p_name)) < 80 AND trim(p_name) <> '' GROUP BY ALL)
SELECT lecture_id, left(string_agg(title, ', ' ORDER BY pos), 700) AS prompt FROM t GROUP BY ALL""")
def vocabulary_prompt(spark, d):
    p = table(spark, d, "part").select(F.col("p_brand").alias("lecture_id"), F.col("p_name").alias("title"), F.col("p_partkey").alias("slide_number"))
    return decks.vocabulary_prompt(p)


@query("SELECT conv_id AS deck, string_agg(text, ' ' ORDER BY turn) AS preview FROM conversations WHERE turn + 1 <= 2 GROUP BY ALL")
def preview_text(spark, d):
    p = table(spark, d, "conversations").select(F.col("conv_id").alias("deck"), (F.col("turn") + 1).alias("page_number"), "text")
    return decks.preview_text(p)


WORDS = "list_filter(string_split(trim(regexp_replace(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g')), ' '), lambda x: x <> '')"


@query(f"""WITH w AS (SELECT item_id, list_position(l, x) AS pos, x AS word, len(l) AS n FROM (SELECT item_id, {WORDS.format('text')} AS l FROM benchmark), unnest(range(1, len(l) + 1)) AS u(i), unnest([l[i]]) AS v(x)),
k AS (SELECT doc_id AS deck, unnest(list_distinct({WORDS.format('text')})) AS word FROM documents),
h AS (SELECT deck, item_id, count(*) AS hits, any_value(n) AS n FROM w JOIN k USING (word) GROUP BY ALL), s AS (SELECT deck, item_id, round(hits / n, 3) AS score FROM h)
SELECT deck, item_id AS lecture_id, score, place FROM (SELECT *, row_number() OVER (PARTITION BY deck ORDER BY score DESC, item_id) AS place FROM s WHERE score >= 0.5) WHERE place <= 3""")
def title_match(spark, d):
    titles = table(spark, d, "benchmark").select(F.col("item_id").alias("lecture_id"), F.col("text").alias("title"))
    own = table(spark, d, "documents").select(F.col("doc_id").alias("deck"), F.col("text").alias("preview"))
    return decks.suggest_lectures(own, titles, fuzzy=False).withColumn("place", F.col("place").cast("long")).select("deck", "lecture_id", "score", "place")


@query()  # likeness by matching blocks has no SQL; a test holds it against brute force
def title_match_fuzzy(spark, d):
    titles = table(spark, d, "benchmark").select(F.col("item_id").alias("lecture_id"), F.col("text").alias("title"))
    own = table(spark, d, "documents").select(F.col("doc_id").alias("deck"), F.col("text").alias("preview"))
    return decks.suggest_lectures(own, titles).withColumn("place", F.col("place").cast("long")).select("deck", "lecture_id", "score", "place")


@query(f"SELECT doc_id, min(doc_id) OVER (PARTITION BY source, md5(lang || '|' || {NORM})) AS slide_number FROM documents")
def with_canonical(spark, d):
    shown = table(spark, d, "documents").select(F.col("source").alias("lecture_id"), F.col("doc_id").alias("slide_number"), "doc_id")
    return segment.with_canonical(shown, canonical_map(spark, d)).select("doc_id", "slide_number")


@query("""SELECT o_orderkey, trim(coalesce(c_name, '') || CASE WHEN c_name IS NULL THEN '' ELSE chr(10) || c_mktsegment END) AS slide_text, CASE WHEN c_custkey IS NULL OR c_custkey % 2 = 0 THEN '' ELSE 'note' END AS notes_text
FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_nationkey % 5 = o_orderkey % 5""")
def with_slide_data(spark, d):
    segments = table(spark, d, "orders").select(F.col("o_custkey").alias("lecture_id"), (F.col("o_orderkey") % 5).cast("int").alias("slide_number"), "o_orderkey")
    slides = table(spark, d, "customer").select(F.col("c_custkey").alias("lecture_id"), (F.col("c_nationkey") % 5).alias("slide_number"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("body_text"), F.when(F.col("c_custkey") % 2 == 1, "note").alias("notes_text"))
    return segment.with_slide_data(segments, slides).select("o_orderkey", "slide_text", "notes_text")


@query("SELECT doc_id AS page_number, source, length(trim(text, E' \\n\\t\\r')) < 50 AS render FROM documents")
def exam_pages(spark, d):
    p = table(spark, d, "documents").select(F.col("doc_id").alias("page_number"), "source", "text")
    return decks.exam_pages(p).select("page_number", "source", "render")


@query("""WITH f AS (SELECT doc_id % 100 AS lecture_id, source || CASE WHEN lang = 'en' THEN '.pptx' WHEN lang = 'de' THEN '.txt' ELSE '.PDF' END AS path FROM documents),
r AS (SELECT *, CASE WHEN path LIKE '%.pptx' THEN 0 WHEN path LIKE '%.PDF' THEN 1 END AS k FROM f)
SELECT lecture_id, arg_min(path, {'k': k, 'p': path}) AS path FROM r WHERE k IS NOT NULL GROUP BY ALL""")
def resolve_decks(spark, d):
    kind = F.when(F.col("lang") == "en", ".pptx").when(F.col("lang") == "de", ".txt").otherwise(".PDF")
    return decks.resolve_decks(table(spark, d, "documents").select((F.col("doc_id") % 100).alias("lecture_id"), F.concat("source", kind).alias("path")))


# Matching

@query(f"WITH {EV} SELECT lecture_id, event_index, score, 'low_confidence' AS reason FROM ev WHERE score < 25")
def needs_review(spark, d):
    return match.low_confidence(lecture_events(spark, d), 25).select("lecture_id", "event_index", "score", F.lit("low_confidence").alias("reason"))


@query(f"""WITH {EV}, c AS (SELECT lecture_id, count(*) AS n_matches, CAST(count_if(score < 25) AS BIGINT) AS n_low FROM ev GROUP BY ALL)
SELECT lecture_id, n_matches, n_low, round(n_low / n_matches, 6) AS ratio, n_low / n_matches >= 0.4::DOUBLE AS fall_back FROM c""")
def low_conf_ratio(spark, d):
    return match.confidence_by_lecture(lecture_events(spark, d), 25, 0.4).withColumn("ratio", F.round("ratio", 6))


def similarity_cells(spark, d) -> DataFrame:
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("lecture_id"), F.col("turn").alias("event_index"))
    score = (F.col("event_index") * 37 + F.col("slide_number") * 53 + F.col("lecture_id") * 17 + F.col("event_index") * F.col("slide_number") * 29) % 100 / F.lit(100.0)
    return c.withColumn("slide_number", F.explode(F.array(*[F.lit(i) for i in (1, 2, 3, 4)]))).withColumn("similarity", score)


@query("""WITH RECURSIVE sc AS (SELECT conv_id, turn, [((turn * 37 + s * 53 + conv_id * 17 + turn * s * 29) % 100) / 100.0::DOUBLE for s in [1, 2, 3, 4]] AS sc FROM conversations),
m AS (SELECT conv_id, CAST(-1 AS BIGINT) AS turn, CAST(1 AS BIGINT) AS cur, 0.0::DOUBLE AS score, false AS jumped, false AS stayed FROM sc GROUP BY conv_id
UNION ALL SELECT conv_id, turn, CASE WHEN jumped THEN back ELSE best END, CASE WHEN jumped THEN back_score ELSE best_score END, jumped, stayed FROM (
 SELECT *, coalesce(back_score > best_score + 0.15::DOUBLE, false) AS jumped FROM (
  SELECT *, CASE WHEN stayed THEN cur ELSE raw END AS best, CASE WHEN stayed THEN sc[cur] ELSE raw_score END AS best_score,
   CASE WHEN cur > 1 THEN list_max(sc[1:cur - 1]) END AS back_score, CASE WHEN cur > 1 THEN list_position(sc, list_max(sc[1:cur - 1])) END AS back FROM (
   SELECT *, raw <> cur AND (raw_score <= sc[cur] + 0.05::DOUBLE OR raw_score < 0.05::DOUBLE) AS stayed FROM (
    SELECT sc.conv_id, sc.turn, m.cur, sc.sc, list_max(sc.sc[m.cur:4]) AS raw_score, m.cur + list_position(sc.sc[m.cur:4], list_max(sc.sc[m.cur:4])) - 1 AS raw
    FROM m JOIN sc ON sc.conv_id = m.conv_id AND sc.turn = m.turn + 1)))))
SELECT conv_id AS lecture_id, turn AS event_index, CAST(cur AS INTEGER) AS slide_number, round(score, 4) AS score, jumped AS jumped_backward, stayed AS stayed_over_raw_best FROM m WHERE turn >= 0""")
def greedy_match(spark, d):
    return match.match_events(similarity_cells(spark, d)).select("lecture_id", "event_index", "slide_number", "score", "jumped_backward", "stayed_over_raw_best")


@query(SQL["greedy_match"].replace("SELECT conv_id AS lecture_id, turn AS event_index, CAST(cur AS INTEGER) AS slide_number, round(score, 4) AS score, jumped AS jumped_backward, stayed AS stayed_over_raw_best FROM m WHERE turn >= 0", "SELECT conv_id AS lecture_id, turn AS event_index, CAST(cur AS INTEGER) AS slide_number FROM m WHERE turn >= 0 AND jumped"))
def backward_jumps(spark, d):
    return match.backward_jumps(match.match_events(similarity_cells(spark, d))).select("lecture_id", "event_index", "slide_number")


TOKENS = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')"


@query(f"""WITH docs AS (SELECT 'e' AS side, item_id AS id, text FROM benchmark UNION ALL SELECT 's', doc_id, text FROM documents),
c AS (SELECT side, id, term, count(*) AS tf FROM (SELECT side, id, unnest({TOKENS}) AS term FROM docs) GROUP BY ALL),
n AS (SELECT count(*) AS n FROM docs), df AS (SELECT term, count(*) AS df FROM c GROUP BY ALL),
w AS (SELECT side, id, c.term, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM c JOIN df USING (term), n),
u AS (SELECT *, w / sqrt(sum(w * w) OVER (PARTITION BY side, id)) AS x FROM w)
SELECT a.id AS item_id, b.id AS doc_id, round(sum(a.x * b.x), 6) AS similarity FROM u a JOIN u b ON a.term = b.term AND a.side = 'e' AND b.side = 's' GROUP BY ALL""")
def tfidf_similarity(spark, d):
    items = table(spark, d, "benchmark").select("item_id", "text")
    return tfidf.joint_similarity(items, table(spark, d, "documents").select("doc_id", "text"), "item_id", "doc_id").withColumn("similarity", F.round("similarity", 6))


STOP = ["the", "and", "die", "der", "les", "que", "you", "of", "la"]


@query(f"""WITH docs AS (SELECT conv_id, 'e' AS side, turn AS id, text FROM conversations UNION ALL SELECT conv_id, 's', turn + 1, CASE WHEN turn = 2 THEN 'zzz' ELSE text END FROM conversations WHERE turn < 3),
t AS (SELECT conv_id, side, id, list_filter({TOKENS}, lambda w: NOT list_contains({STOP}, w)) AS l FROM docs),
b AS (SELECT conv_id, side, id, list_concat(l, list_transform(range(1, len(l)), lambda i: l[i] || ' ' || l[i + 1])) AS l FROM t),
c AS (SELECT conv_id, side, id, term, count(*) AS tf FROM (SELECT conv_id, side, id, unnest(l) AS term FROM b) GROUP BY ALL),
n AS (SELECT conv_id, count(*) AS n FROM docs GROUP BY ALL), df AS (SELECT conv_id, term, count(*) AS df FROM c GROUP BY ALL),
w AS (SELECT c.conv_id, side, id, c.term, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM c JOIN df ON c.conv_id = df.conv_id AND c.term = df.term JOIN n ON c.conv_id = n.conv_id),
u AS (SELECT *, w / sqrt(sum(w * w) OVER (PARTITION BY conv_id, side, id)) AS x FROM w),
p AS (SELECT a.conv_id, a.id AS e, z.id AS s, sum(a.x * z.x) AS sim FROM u a JOIN u z ON a.conv_id = z.conv_id AND a.term = z.term AND a.side = 'e' AND z.side = 's' GROUP BY ALL)
SELECT e.conv_id AS lecture_id, e.turn AS event_index, z.turn + 1 AS slide_number, round(coalesce(sim, 0), 6) AS similarity
FROM conversations e JOIN conversations z ON e.conv_id = z.conv_id AND z.turn < 3 LEFT JOIN p ON p.conv_id = e.conv_id AND p.e = e.turn AND p.s = z.turn + 1""".replace(str(STOP), "[" + ", ".join(f"'{w}'" for w in STOP) + "]"))
def deck_similarity(spark, d):
    e, s = deck_frames(spark, d)
    return tfidf.event_slide_similarity(e, s, STOP).withColumn("similarity", F.round("similarity", 6))


def deck_frames(spark, d) -> tuple[DataFrame, DataFrame]:
    """Turns as frames, the first three as slides, the third with a word that no frame has."""
    c = table(spark, d, "conversations").withColumnRenamed("conv_id", "lecture_id")
    e = c.select("lecture_id", F.col("turn").alias("event_index"), F.col("text").alias("ocr_text"))
    text = F.when(F.col("turn") == 2, "zzz").otherwise(F.col("text"))
    return e, c.where("turn < 3").select("lecture_id", (F.col("turn") + 1).alias("slide_number"), text.alias("reference_text"))


CONV_W = f"""c AS (SELECT conv_id, turn, term, count(*) AS tf FROM (SELECT conv_id, turn, unnest({TOKENS}) AS term FROM conversations) GROUP BY ALL),
n AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY ALL), df AS (SELECT conv_id, term, count(*) AS df FROM c GROUP BY ALL),
w AS (SELECT c.conv_id, turn, c.term, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) AS w FROM c JOIN df ON c.conv_id = df.conv_id AND c.term = df.term JOIN n ON c.conv_id = n.conv_id),
u AS (SELECT *, w / sqrt(sum(w * w) OVER (PARTITION BY conv_id, turn)) AS x FROM w)"""


def turn_weights(spark, d) -> tuple[DataFrame, DataFrame]:
    t = table(spark, d, "conversations").select(F.col("conv_id").alias("lecture_id"), F.col("turn").alias("doc"), "text")
    return t, tfidf.tfidf_weights(t, ("lecture_id",), sublinear=True)


@query(f"""WITH {CONV_W}, p AS (SELECT a.conv_id, a.turn, sum(a.x * b.x) AS s FROM u a JOIN u b ON a.conv_id = b.conv_id AND a.term = b.term AND b.turn = a.turn - 1 GROUP BY ALL)
SELECT q.conv_id AS lecture_id, q.turn AS doc, CASE WHEN q.turn > 0 THEN round(coalesce(s, 0), 6) END AS similarity FROM conversations q LEFT JOIN p ON q.conv_id = p.conv_id AND q.turn = p.turn""")
def tfidf_consecutive(spark, d):
    t, w = turn_weights(spark, d)
    return tfidf.consecutive_similarity(w, t.drop("text")).withColumn("similarity", F.round("similarity", 6))


@query(f"""WITH {CONV_W}, f AS (SELECT conv_id, turn // 2 AS seg, count(*) AS nf FROM conversations GROUP BY ALL),
k AS (SELECT u.conv_id, turn // 2 AS seg, term, round(sum(x) / any_value(nf), 9) AS weight FROM u JOIN f ON u.conv_id = f.conv_id AND u.turn // 2 = f.seg GROUP BY u.conv_id, turn // 2, term)
SELECT conv_id AS lecture_id, seg AS segment_idx, place, term, round(weight, 6) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, seg ORDER BY weight DESC, term DESC) AS place FROM k) WHERE place <= 8 AND weight > 0""")
def segment_keywords(spark, d):
    t, w = turn_weights(spark, d)
    members = t.select("lecture_id", "doc", F.floor(F.col("doc") / 2).cast("long").alias("segment_idx"))
    return tfidf.segment_keywords(w, members).withColumn("weight", F.round("weight", 6)).withColumn("place", F.col("place").cast("long"))


@query(f"""WITH {CONV}, c AS (SELECT conv_id, turn, term, count(*) AS tf FROM (SELECT conv_id, turn, unnest({TOKENS}) AS term FROM conversations) GROUP BY ALL),
n AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY ALL), df AS (SELECT conv_id, term, count(*) AS df FROM c GROUP BY ALL HAVING count(*) >= 2),
w AS (SELECT c.conv_id, turn, c.term, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) AS w FROM c JOIN df ON c.conv_id = df.conv_id AND c.term = df.term JOIN n ON c.conv_id = n.conv_id),
u AS (SELECT *, w / sqrt(sum(w * w) OVER (PARTITION BY conv_id, turn)) AS x FROM w),
p AS (SELECT a.conv_id, a.turn, sum(a.x * b.x) AS sim FROM u a JOIN u b ON a.conv_id = b.conv_id AND a.term = b.term AND b.turn = a.turn - 1 GROUP BY ALL),
m AS (SELECT lecture_id, seg_index AS turn, s AS ts, CASE WHEN seg_index > 0 AND lecture_id IN (SELECT conv_id FROM u) THEN coalesce(sim, 0) END AS sim FROM seg LEFT JOIN p ON lecture_id = p.conv_id AND seg_index = p.turn),
i AS (SELECT *, sum(CASE WHEN sim < 0.2 THEN 1 ELSE 0 END) OVER (PARTITION BY lecture_id ORDER BY turn) AS isl FROM m),
l AS (SELECT lecture_id, isl, min(ts) AS a, max(ts) AS b FROM i GROUP BY ALL),
g AS (SELECT lecture_id, isl, sum(CASE WHEN isl = 0 OR b - a >= 30 THEN 1 ELSE 0 END) OVER (PARTITION BY lecture_id ORDER BY isl) - 1 AS sg FROM l),
k AS (SELECT i.*, CAST(sg AS INTEGER) AS sg, min(turn) OVER (PARTITION BY i.lecture_id, sg) AS t0 FROM i JOIN g USING (lecture_id, isl)),
a AS (SELECT lecture_id, sg, min(ts) AS st, max(ts) AS last, avg(CASE WHEN turn > t0 THEN sim END) AS mean, count(*) AS nf FROM k GROUP BY ALL),
q AS (SELECT k.lecture_id, k.sg, term, round(sum(x) / any_value(nf), 9) AS wt FROM k JOIN u ON k.lecture_id = u.conv_id AND k.turn = u.turn JOIN a ON k.lecture_id = a.lecture_id AND k.sg = a.sg GROUP BY k.lecture_id, k.sg, term),
kw AS (SELECT lecture_id, sg, string_agg(term, ',' ORDER BY place) AS keywords FROM (SELECT *, row_number() OVER (PARTITION BY lecture_id, sg ORDER BY wt DESC, term DESC) AS place FROM q) WHERE place <= 8 GROUP BY ALL)
SELECT a.lecture_id, a.sg + 1 AS slide_number, st AS seg_start, coalesce(lead(st) OVER (PARTITION BY a.lecture_id ORDER BY a.sg), last) AS seg_end, round(coalesce(mean, 0), 4) AS confidence, coalesce(keywords, '') AS keywords
FROM a LEFT JOIN kw ON a.lecture_id = kw.lecture_id AND a.sg = kw.sg""")
def visual_timeline(spark, d):
    t = transcript(spark, d)
    e = t.select("lecture_id", F.col("seg_index").alias("event_index"), F.col("start").alias("timestamp"), F.lit("").alias("frame_image_path"), F.col("text").alias("ocr_text"))
    v = visual.visual_timeline(e, threshold=0.2, min_seconds=30.0)
    return v.select("lecture_id", "slide_number", F.col("start").alias("seg_start"), F.col("end").alias("seg_end"), "confidence", F.array_join("segment_keywords", ",").alias("keywords"))


OCR = "regexp_extract_all(strip_accents(lower({0})), '[\\p{{L}}\\p{{N}}_'']+')"


@query(f"""WITH p AS (SELECT a.conv_id, a.turn, list_distinct({OCR.format('z.text')}) AS r, list_distinct({OCR.format('a.text')}) AS f FROM conversations a JOIN conversations z ON a.conv_id = z.conv_id AND z.turn = 0)
SELECT conv_id, turn, round(CASE WHEN len(r) = 0 THEN 1 ELSE len(list_intersect(r, f)) / len(r) END, 6) AS overlap FROM p""")
def word_overlap(spark, d):
    return turn_pairs(spark, d).select("conv_id", "turn", F.round(fn.overlap_ratio("first", "own"), 6).alias("overlap"))


def turn_pairs(spark, d) -> DataFrame:
    c = table(spark, d, "conversations")
    first = c.where("turn = 0").select("conv_id", fn.fold("text").alias("first"))
    return c.select("conv_id", "turn", fn.fold("text").alias("own")).join(first, "conv_id")


@query(f"""WITH p AS (SELECT a.conv_id, a.turn, list_distinct({OCR.format('z.text')}) AS r, {OCR.format('left(a.text, 150)')} AS w, length(left(a.text, 150)) AS n FROM conversations a JOIN conversations z ON a.conv_id = z.conv_id AND z.turn = 0),
q AS (SELECT conv_id, turn, r, list_distinct(CASE WHEN n >= 149 AND len(w) > 1 THEN w[1:len(w) - 1] ELSE w END) AS f FROM p)
SELECT conv_id, turn, round(CASE WHEN len(f) = 0 THEN 1 ELSE len(list_filter(f, lambda x: NOT list_contains(r, x))) / len(f) END, 6) AS novel FROM q""")
def novel_ratio(spark, d):
    return turn_pairs(spark, d).select("conv_id", "turn", F.round(fn.novel_ratio("first", F.left("own", F.lit(150))), 6).alias("novel"))


CUES = "[" + ", ".join("'" + c.replace("'", "''") + "'" for c in fn.EXAMPLE_CUES) + "]"


@query(f"SELECT doc_id, array_to_string(list_filter({CUES}, lambda x: contains(strip_accents(lower(text)), x)), '|') AS cues FROM documents")
def cue_hits(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(fn.cue_hits(fn.fold("text")), "|").alias("cues"))


@query("SELECT doc_id, md5(strip_accents(lower(text))) AS folded_md5 FROM documents")
def fold_text(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(fn.fold("text")).alias("folded_md5"))


# Corrections and documents

@query(f"""WITH {RUNS}, ed AS (SELECT lecture_id, run_idx, s, CASE WHEN run_idx = 2 THEN lead(e) OVER (PARTITION BY lecture_id ORDER BY run_idx) ELSE e END AS e,
 CASE WHEN run_idx = 1 THEN 9 ELSE slide_number END AS slide_number, CASE WHEN run_idx = 1 THEN 1.0::DOUBLE ELSE confidence END AS confidence FROM runs),
k AS (SELECT * FROM ed WHERE run_idx <> 3), b AS (SELECT *, CASE WHEN slide_number = lag(slide_number) OVER w AND lag(e) OVER w = s THEN 0 ELSE 1 END AS brk FROM k WINDOW w AS (PARTITION BY lecture_id ORDER BY run_idx)),
i AS (SELECT *, sum(brk) OVER (PARTITION BY lecture_id ORDER BY run_idx) - 1 AS entry FROM b)
SELECT lecture_id, CAST(entry AS BIGINT) AS entry, arg_min(s, run_idx) AS entry_start, arg_max(e, run_idx) AS entry_end, any_value(slide_number) AS slide_number, max(confidence) AS confidence FROM i GROUP BY lecture_id, entry""")
def apply_corrections(spark, d):
    r = slide_runs(spark, d)
    middle = (F.col("start") + F.col("end")) / 2
    edits = r.where("run_idx in (1, 3)").select("lecture_id", F.col("run_idx").alias("position"), middle.alias("timestamp"), F.when(F.col("run_idx") == 1, 9).alias("slide_number"))
    done = review.apply_corrections(r, edits)
    return done.select("lecture_id", "entry", F.col("start").alias("entry_start"), F.col("end").alias("entry_end"), "slide_number", "confidence")


@query("""WITH n AS (SELECT printf('lecture%05d', conv_id) AS id, string_agg(text, chr(10) ORDER BY turn) AS t FROM conversations GROUP BY ALL),
p AS (SELECT id, '# ' || id || chr(10) || chr(10) || t || chr(10) AS t FROM n)
SELECT md5(g) AS guide_md5, length(g) AS n_chars FROM (SELECT (SELECT '# Table of Contents' || chr(10) || chr(10) || string_agg('- [' || id || '](#' || id || ')', chr(10) ORDER BY id) || chr(10) FROM n) || (SELECT string_agg(t, chr(10) ORDER BY id) FROM p) AS g)""")
def assemble_guide(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id").agg(documents.joined("turn", "text", "\n").alias("text"))
    notes = c.select(F.format_string("lecture%05d", "conv_id").alias("lecture_id"), "text")
    return documents.assemble_guide(notes).select(F.md5("guide").alias("guide_md5"), F.length("guide").cast("long").alias("n_chars"))


@query("""SELECT event_id, '## Slide ' || user_id || ': ' || event_type || chr(10) || 'body' AS note, CASE WHEN value < 50 THEN 'paper ' || event_id END AS paper, CASE WHEN value < 50 THEN 'key' END AS answers FROM events""")
def note_parts(spark, d):
    e = table(spark, d, "events")
    raw = F.when(F.col("value") < 20, F.concat(F.lit("## Slide "), F.col("user_id").cast("string"), F.lit(": "), "event_type")).otherwise(F.concat(F.lit("## "), "event_type"))
    note = fn.numbered_heading(F.concat(raw, F.lit("\nbody")), "user_id")
    exam = fn.split_exam(F.concat(F.lit("paper "), F.col("event_id").cast("string"), F.lit(f"\n\n{fn.ANSWER_KEY}\n\nkey\n")))
    low = F.col("value") < 50
    return e.select("event_id", note.alias("note"), F.when(low, exam["paper"]).alias("paper"), F.when(low, exam["key"]).alias("answers"))


@query("""SELECT event_id, CASE WHEN s >= 3600 THEN printf('%d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) ELSE printf('%d:%02d', s // 60, s % 60) END AS shown, left(event_type || '-' || event_id, 10) || '…' AS hidden
FROM (SELECT *, CAST(round_even(value * 50, 0) AS BIGINT) AS s FROM events)""")
def clock_and_mask(spark, d):
    return table(spark, d, "events").select("event_id", fn.clock(F.col("value") * 50).alias("shown"), fn.masked(F.concat("event_type", F.lit("-"), F.col("event_id").cast("string"))).alias("hidden"))


@query("""SELECT event_id, CASE event_type WHEN 'click' THEN round(value / 100, 6) WHEN 'view' THEN round(CAST(json_extract(props, '$.k') AS BIGINT) / 100, 6) WHEN 'signup' THEN round(least(value / 50, 1.0), 6) WHEN 'error' THEN round(least((60 + value) / 200, 1.0), 6) END AS share FROM events""")
def progress_lines(spark, d):
    return reported(spark, d).select("event_id", F.round("share", 6).alias("share"))


def reported(spark, d) -> DataFrame:
    """Events as lines of stages' output, with the share that they report."""
    e = table(spark, d, "events")
    k = F.get_json_object("props", "$.k")
    shown = F.col("value").cast("decimal(18,4)").cast("string")
    of = lambda t: F.col("event_type") == t
    line = F.when(of("click"), F.concat(F.lit("[download]  "), shown, F.lit("% of 3MiB"))).when(of("view"), F.concat(F.lit("[ocr "), k, F.lit("/100] frame"))).when(of("signup"), F.concat(F.lit("[event 3] t= "), shown, F.lit("s"))).when(of("error"), F.concat(F.lit("[00:00.000 --> 01:"), shown, F.lit("] words"))).otherwise("nothing")
    stage = F.when(of("click"), 0).when(of("view"), 4).when(of("signup"), 3).when(of("error"), 1).otherwise(6)
    duration = F.when(of("signup"), 50.0).when(of("error"), 200.0)
    return e.select("event_id", F.col("user_id").alias("lecture_id"), "ts", stage.alias("stage"), fn.progress_share(stage, line, duration).alias("share"))


@query("""SELECT lecture_id, stage, event_id, percent FROM (SELECT *, max(percent) OVER (PARTITION BY lecture_id, stage ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM
 (SELECT user_id AS lecture_id, ts, e.event_id, CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 4 WHEN 'signup' THEN 3 WHEN 'error' THEN 1 ELSE 6 END AS stage, round(share * 100, 4) AS percent FROM events e JOIN ({lines}) USING (event_id)))
WHERE percent IS NOT NULL AND (best IS NULL OR percent > best)""".replace("{lines}", SQL["progress_lines"]))
def stage_progress(spark, d):
    lines = reported(spark, d).withColumn("percent", F.round(F.round("share", 6) * 100, 4))
    return runs.running_maximum(lines, "percent", "ts", ("lecture_id", "stage")).select("lecture_id", "stage", "event_id", "percent")


@query("""SELECT event_id, event_type IN ('click', 'view') AS parsed, CASE WHEN event_type IN ('click', 'view') THEN CAST(json_extract(props, '$.k') AS BIGINT) > 50 END AS is_example,
CASE WHEN event_type IN ('click', 'view') THEN CASE WHEN event_type = 'click' THEN 'whiteboard' ELSE 'annotated_slide' END END AS kind, CASE WHEN event_type IN ('click', 'view') THEN CAST(json_extract(props, '$.k') AS BIGINT) / 100 END AS confidence FROM events""")
def verdict_parse(spark, d):
    e = table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    truth = F.when(k > 50, "true").otherwise("false")
    share = F.concat(F.lit("0."), F.lpad(k.cast("string"), 2, "0"))
    fenced = F.concat(F.lit('Here:\n```json\n{"is_example": '), truth, F.lit(', "kind": "whiteboard", "confidence": '), share, F.lit("}\n```"))
    bare = F.concat(F.lit('I think {"is_example": '), truth, F.lit(', "kind": "", "caption": " x ", "confidence": '), share, F.lit("} fits"))
    answer = F.when(F.col("event_type") == "click", fenced).when(F.col("event_type") == "view", bare).when(F.col("event_type") == "error", F.lit('{"kind": "x"}')).otherwise("no idea")
    v = fn.parse_verdict(answer)
    return e.select("event_id", v.isNotNull().alias("parsed"), v["is_example"].alias("is_example"), v["kind"].alias("kind"), v["confidence"].alias("confidence"))


# Catalogue

@query("""SELECT CAST(sum(k) AS BIGINT) AS input_tokens, CAST(sum(CASE WHEN value < 10 THEN 0 ELSE k END) AS BIGINT) AS output_tokens, CAST(0 AS BIGINT) AS cache_creation_input_tokens, count(*) AS cache_read_input_tokens FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)""")
def usage_totals(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    u = table(spark, d, "events").select(k.alias("input_tokens"), F.when(F.col("value") >= 10, k).alias("output_tokens"), F.lit(None).cast("long").alias("cache_creation_input_tokens"), F.lit(1).cast("long").alias("cache_read_input_tokens"))
    return catalog.total_usage(u)


@query("SELECT event_id AS seq, event_type FROM events ORDER BY event_id DESC LIMIT 2000")
def recent_events(spark, d):
    return catalog.recent_events(table(spark, d, "events").select(F.col("event_id").alias("seq"), "event_type"))


@query("SELECT page_id, regexp_matches(url, '^https?://[^/?#]+') AS valid FROM pages")
def url_check(spark, d):
    return table(spark, d, "pages").select("page_id", catalog.valid_url("url").alias("valid"))


@query("SELECT printf('lecture%02d', row_number() OVER (ORDER BY n_nationkey)) AS lecture_id, n_name AS title FROM nation")
def lecture_numbers(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("position"), F.col("n_name").alias("title"), F.lit(0).alias("course"))
    return catalog.number_lectures(n, keys=("course",)).select("lecture_id", "title")


STATUS = "CASE WHEN value < 2 THEN 'cancelled' WHEN value < 20 THEN 'failed' ELSE 'done' END"


@query(f"""SELECT user_id AS lecture_id, bool_and({STATUS} = 'done') AS all_done, true AS all_settled,
CASE WHEN bool_or({STATUS} = 'cancelled') THEN 'cancelled' WHEN bool_or({STATUS} = 'failed') THEN 'failed' ELSE 'done' END AS status FROM events GROUP BY ALL""")
def job_status(spark, d):
    s = F.when(F.col("value") < 2, "cancelled").when(F.col("value") < 20, "failed").otherwise("done")
    return catalog.settled(table(spark, d, "events").select(F.col("user_id").alias("lecture_id"), F.col("event_type").alias("stage"), s.alias("status")))


@query(f"""WITH {EV}, s AS (SELECT *, CASE WHEN score < 20 THEN 'failed' WHEN score < 50 THEN 'pending' ELSE 'done' END AS status FROM ev),
w AS (SELECT *, bool_and(status = 'done') OVER p AS ok, bool_or(status = 'failed') OVER p AS bad FROM s WINDOW p AS (PARTITION BY lecture_id ORDER BY event_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT lecture_id, event_index AS stage, CASE WHEN coalesce(bad, false) THEN 'skip' ELSE 'run' END AS action FROM w WHERE status = 'pending' AND (coalesce(bad, false) OR coalesce(ok, true))""")
def ready_tasks(spark, d):
    s = F.when(F.col("score") < 20, "failed").when(F.col("score") < 50, "pending").otherwise("done")
    t = lecture_events(spark, d).select("lecture_id", F.col("event_index").alias("stage"), s.alias("status"))
    return catalog.ready_tasks(t).select("lecture_id", "stage", "action")


@query("""WITH a AS (SELECT user_id, event_type, bool_or(value > 90) AS done FROM events GROUP BY ALL), s AS (SELECT user_id, string_agg(event_type || '=' || CASE WHEN done THEN 'true' ELSE 'false' END, ',' ORDER BY event_type) AS stages FROM a GROUP BY ALL),
r AS (SELECT user_id, CAST(count_if(value < 25) AS BIGINT) AS n_low FROM events GROUP BY ALL), k AS (SELECT user_id, arg_max(event_type, ts) AS path FROM events WHERE value > 50 GROUP BY ALL)
SELECT user_id AS lecture_id, CAST(user_id AS VARCHAR) AS title, stages, path, n_low FROM s JOIN r USING (user_id) LEFT JOIN k USING (user_id)""")
def dashboard(spark, d):
    e = table(spark, d, "events").withColumnRenamed("user_id", "lecture_id")
    lectures = e.select("lecture_id").distinct().withColumn("title", F.lit(""))
    artifacts = e.groupBy("lecture_id", F.col("event_type").alias("stage")).agg(F.bool_or(F.col("value") > 90).alias("done"))
    deck = e.where("value > 50").groupBy("lecture_id").agg(F.max_by("event_type", "ts").alias("path"))
    low = match.confidence_by_lecture(e.withColumn("score", F.col("value")), 25)
    rows = catalog.dashboard(lectures, artifacts, deck, low)
    stages = F.array_join(F.transform(F.map_entries("stages"), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))), ",")
    return rows.select("lecture_id", F.col("title").cast("string").alias("title"), stages.alias("stages"), "path", "n_low")


@query("""WITH c AS (SELECT n_name AS name, n_regionkey < 3 AS required, n_nationkey % 6 <> 1 AS ok FROM nation)
SELECT bool_and(ok) FILTER (required) AS ready, string_agg(name, ',' ORDER BY name) FILTER (required AND NOT ok) AS failing FROM c""")
def preflight(spark, d):
    n = table(spark, d, "nation").select(F.col("n_name").alias("name"), (F.col("n_regionkey") < 3).alias("required"), (F.col("n_nationkey") % 6 != 1).alias("ok"))
    return catalog.preflight(n).select("ready", F.array_join("failing", ",").alias("failing"))


@query("""WITH l AS (SELECT n_name AS lecture_id FROM nation), s AS (SELECT unnest([3, 4, 5, 7]) AS stage), o AS (SELECT 3 AS stage, '--threshold 0.1' AS argv UNION ALL SELECT 4, '--mode deck --margin 0.2')
SELECT lecture_id, s.stage, coalesce(argv, '') AS argv FROM l CROSS JOIN s LEFT JOIN o ON s.stage = o.stage WHERE s.stage < 7 UNION ALL SELECT NULL, 7, '--force'""")
def task_plan(spark, d):
    lectures = table(spark, d, "nation").select(F.col("n_name").alias("lecture_id"))
    stages = spark.createDataFrame([(3,), (4,), (5,), (6,), (7,)], "stage int")
    options = spark.createDataFrame([(3, 0, "--threshold", "0.1"), (3, 1, "--crop", ""), (4, 1, "--margin", "0.2"), (4, 0, "--mode", "deck"), (5, 0, "--min-dwell", None)], "stage int, position int, flag string, value string")
    return catalog.task_plan(lectures, stages, options, has_key=False).withColumn("argv", F.array_join("argv", " "))


@query("""SELECT user_id AS playlist, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS INTEGER) AS "index", 'video ' || row_number() OVER (PARTITION BY user_id ORDER BY ts) AS title, 'https://www.youtube.com/watch?v=' || event_id AS url FROM events WHERE value > 10""")
def playlist_expand(spark, d):
    e = table(spark, d, "events")
    item = F.when(F.col("value") > 10, F.struct(F.col("event_id").cast("string").alias("id"), F.lit("").alias("title")))
    own = F.transform(F.array_sort(F.collect_list(F.struct("ts", F.coalesce(F.to_json(item), F.lit("null")).alias("x")))), lambda x: x["x"])
    lists = e.groupBy(F.col("user_id").alias("playlist")).agg(F.concat(F.lit("["), F.array_join(own, ","), F.lit("]")).alias("entries"))
    return catalog.playlist_entries(lists).select("playlist", "index", "title", "url")


@query("SELECT r_regionkey, 'a=' || r_name || ',b=2,c=' || r_regionkey AS merged FROM region")
def option_overlay(spark, d):
    r = table(spark, d, "region")
    spark.conf.set("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
    maps = r.select("r_regionkey", F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")).alias("defaults"), F.create_map(F.lit("a"), F.col("r_name"), F.lit("c"), F.col("r_regionkey").cast("string")).alias("overrides"))
    return maps.select("r_regionkey", F.array_join(F.transform(F.array_sort(F.map_entries(catalog.overlay("defaults", "overrides"))), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ",").alias("merged"))


@query(f"WITH {EV}, l AS (SELECT * FROM ev WHERE score < 25) SELECT lecture_id, event_index, coalesce(n_name, '') AS title, '/files/' || frame_image_path AS frame_url FROM l LEFT JOIN nation ON n_nationkey = lecture_id")
def review_rows(spark, d):
    low = match.low_confidence(lecture_events(spark, d), 25).withColumn("frame_image_path", F.concat(F.lit("output/"), "frame_image_path"))
    names = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("lecture_id"), F.explode(F.sequence(F.lit(1), F.lit(5))).alias("slide_number"), F.col("n_name").alias("title"))
    return catalog.review_rows(low, names).select("lecture_id", "event_index", "title", "frame_url")


@query("SELECT c_custkey AS lecture_id FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def ready_for_essentials(spark, d):
    notes = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("lecture_id"))
    return catalog.ready_for_essentials(table(spark, d, "customer").select(F.col("c_custkey").alias("lecture_id")), notes)


@query("SELECT doc_id AS lecture_id, l.doc_id IS NULL OR l.quality = 0 AS fetch FROM documents LEFT JOIN labels l USING (doc_id)")
def fetch_plan(spark, d):
    lectures = table(spark, d, "documents").select(F.col("doc_id").alias("lecture_id"), F.lit("u").alias("url"))
    known = table(spark, d, "labels").select(F.col("doc_id").alias("lecture_id"), F.lit("u").alias("url"), (F.col("quality") == 1).alias("playable"))
    return catalog.fetch_plan(lectures, known).select("lecture_id", "fetch")


@query("""WITH p AS (SELECT vec_id, label AS lecture_id, list_transform(embedding, lambda x: CAST(trunc(x * 100) AS BIGINT)) AS px FROM embeddings), l AS (SELECT *, lag(px) OVER (PARTITION BY lecture_id ORDER BY vec_id) AS before FROM p),
d AS (SELECT *, list_sum(list_transform(range(1, len(px) + 1), lambda i: abs(px[i] - before[i]))) / len(px) / 255 AS diff FROM l)
SELECT lecture_id, vec_id, row_number() OVER (PARTITION BY lecture_id ORDER BY vec_id) - 1 AS event_index, round(diff, 6) AS diff FROM d WHERE diff IS NULL OR diff > 0.05""")
def pixel_events(spark, d):
    p = table(spark, d, "embeddings").select("vec_id", F.col("label").alias("lecture_id"), scaled("embedding", 100).alias("pixels"))
    rows = runs.change_events(p, 0.05, "pixels", "vec_id", difference=runs.pixel_difference)
    return rows.select("lecture_id", "vec_id", "event_index", F.round("difference", 6).alias("diff"))


@query("""SELECT vec_id, CAST(list_sum(list_transform(range(56), lambda i: CASE WHEN embedding[i // 8 * 9 + i % 8 + 1] > embedding[i // 8 * 9 + i % 8 + 2] THEN CAST(1 AS BIGINT) << (55 - i) ELSE 0 END)) AS BIGINT) AS dhash FROM embeddings""")
def frame_hash(spark, d):
    return table(spark, d, "embeddings").select("vec_id", fn.difference_hash("embedding", 9, 7).alias("dhash"))


@query("""WITH c AS (SELECT vec_id, embedding AS e, CASE vec_id % 5 WHEN 0 THEN [0, 0, 8, 8] WHEN 1 THEN [2, 2, 6, 6] WHEN 2 THEN [4, 0, 5, 8] END AS box FROM embeddings)
SELECT vec_id, vec_id % 5 < 3 AS valid, CASE WHEN vec_id % 5 < 3 THEN len(list_filter(range(64), lambda i: i % 8 >= box[1] AND i % 8 < box[3] AND i // 8 >= box[2] AND i // 8 < box[4])) END AS n_pixels,
CASE WHEN vec_id % 5 < 3 THEN CAST(list_sum(list_transform(list_filter(range(64), lambda i: i % 8 >= box[1] AND i % 8 < box[3] AND i // 8 >= box[2] AND i // 8 < box[4]), lambda i: CAST(trunc(e[i + 1] * 1000) AS BIGINT))) AS BIGINT) END AS total FROM c""")
def crop_frames(spark, d):
    kind = F.col("vec_id") % 5
    spec = F.when(kind == 0, "0,0,1,1").when(kind == 1, "0.25, 0.25, 0.5, 0.5").when(kind == 2, "0.5,0,0.05,1").when(kind == 3, "0.5,0.5,0.6,0.2").otherwise("1,2,x")
    e = table(spark, d, "embeddings").select("vec_id", scaled("embedding", 1000).alias("pixels"), spec.alias("spec"), F.lit(8).alias("w"), F.lit(8).alias("h"))
    e = e.withColumn("crop", catalog.parse_crop("spec"))
    e = e.withColumn("own", F.when(F.col("crop").isNotNull(), catalog.cropped("pixels", "w", "h", F.col("crop"))))
    total = F.aggregate("own", F.lit(0).cast("long"), lambda acc, x: acc + x)
    return e.select("vec_id", F.col("crop").isNotNull().alias("valid"), F.when(F.col("own").isNotNull(), F.size("own").cast("long")).alias("n_pixels"), total.alias("total"))


@query("SELECT doc_id, CASE WHEN lang IN ('en', 'de') THEN '' ELSE lang END AS missing FROM documents")
def missing_languages(spark, d):
    own = table(spark, d, "documents").select("doc_id", F.concat(F.lit("en++"), "lang", F.lit("+")).alias("spec"), F.array(F.lit("en"), F.lit("de")).alias("installed"))
    return own.select("doc_id", F.array_join(catalog.missing_languages("spec", "installed"), "+").alias("missing"))


@query("SELECT 'lecture' || printf('%02d', o_custkey) AS lecture_id, o_orderkey FROM orders WHERE o_orderstatus <> 'O' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def valid_ids(spark, d):
    shown = F.format_string("%02d", "o_custkey")
    named = table(spark, d, "orders").select(F.concat(F.when(F.col("o_orderstatus") == "O", "talk").otherwise("lecture"), shown).alias("lecture_id"), "o_orderkey")
    known = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.explode(F.array(*[F.concat(F.lit(p), F.format_string("%02d", "c_custkey")) for p in ("lecture", "talk")])).alias("lecture_id"))
    return catalog.valid_ids(named, known)


@query("SELECT printf('exam_%02d', n_nationkey) AS name, n_nationkey % 3 = 0 AS has_key FROM nation")
def exam_listing(spark, d):
    n = table(spark, d, "nation").select(F.format_string("exam_%02d", "n_nationkey").alias("name"), "n_nationkey")
    return catalog.exam_listing(n.select("name").union(n.where("n_nationkey % 3 = 0").select(F.concat("name", F.lit("_key")))))


@query("""SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'sr' WHEN turn % 3 = 1 THEN role ELSE 'sr' END AS language, CAST(turn AS DOUBLE) AS seg_start, trim(text) AS text, CASE WHEN turn % 2 = 0 THEN role || ' ' ELSE '' END || right(text, 20) AS prompt FROM conversations""")
def recognised_parts(spark, d):
    detected = F.when(F.col("turn") % 3 == 0, "").when(F.col("turn") % 3 == 1, F.col("role"))
    heard = F.array(F.struct(F.col("turn").alias("start"), (F.col("turn") + 1).alias("end"), F.concat(F.lit(" \n"), "text", F.lit("\t")).alias("text")))
    c = table(spark, d, "conversations").withColumn("r", chunks.parsed_response(detected, F.lit("sr"), heard))
    c = c.withColumns({"vocabulary": F.when(F.col("turn") % 2 == 0, F.col("role")).otherwise(""), "tail": F.right("text", F.lit(20))})
    first = F.get("r.segments", F.lit(0))
    return c.select("conv_id", "turn", "r.language", first["start"].alias("seg_start"), first["text"].alias("text"), fn.chunk_prompt("vocabulary", "tail").alias("prompt"))


@query(f"""WITH {EV}, x AS (SELECT *, row_number() OVER (PARTITION BY lecture_id, slide_number ORDER BY timestamp, event_index) AS k, CAST(round_even(score * 50, 0) AS BIGINT) AS t FROM (SELECT * REPLACE (score AS score, event_index AS timestamp) FROM ev)),
b AS (SELECT lecture_id, slide_number, k, CASE WHEN hash % 4 <> 0 THEN '![Example ' || k || ' — ' || printf('%d:%02d', event_index // 60, event_index % 60) || '](../' || frame_image_path || ')' || CASE WHEN hash % 3 = 0 THEN '' ELSE chr(10) || '*' || event_type || '*' END END AS block FROM x)
SELECT lecture_id, slide_number, md5(CASE WHEN count(block) = 0 THEN '' ELSE chr(10) || chr(10) || '**Examples:**' || chr(10) || chr(10) || string_agg(block, chr(10) || chr(10) ORDER BY k) || chr(10) END) AS examples_md5 FROM b GROUP BY ALL""")
def examples_block(spark, d):
    e = lecture_events(spark, d)
    shown = e.select("lecture_id", "slide_number", "event_index", F.col("event_index").cast("double").alias("timestamp"), F.concat(F.lit("output/"), "frame_image_path").alias("frame_image_path"), F.when(F.col("hash") % 3 == 0, " ").otherwise(F.col("event_type")).alias("caption"), (F.col("hash") % 4 != 0).alias("exists"))
    return documents.examples_block(shown).select("lecture_id", "slide_number", F.md5("examples").alias("examples_md5"))


# External steps with fakes: what the fakes answer is known

@query("""WITH p AS (SELECT doc_id, text, 'Slide text:' || chr(10) || lang || chr(10) || chr(10) || 'Speaker notes:' || chr(10) || chr(10) || chr(10) || 'Transcript:' || chr(10) || text AS p FROM documents)
SELECT doc_id AS slide_number, false AS skipped, CAST(NULL AS VARCHAR) AS error, '## Note ' || left(md5(p), 8) AS text, CAST(len(regexp_extract_all(p, '\\S+')) AS BIGINT) AS input_tokens FROM p""")
def udf_note_stub(spark, d):
    from ..ports import FakeModel, slide_notes

    s = table(spark, d, "documents").select(F.col("source").alias("lecture_id"), F.col("doc_id").alias("slide_number"), F.lit("deck").alias("mode"), F.col("lang").alias("slide_text"), F.lit("").alias("notes_text"), F.col("text").alias("transcript_text"))
    return slide_notes(s, FakeModel).select("slide_number", "note.skipped", "note.error", "note.text", "note.input_tokens")


@query("SELECT CAST(page_id AS VARCHAR) AS lecture_id, CAST(i AS BIGINT) AS event_index, i * 6.0::DOUBLE AS timestamp, CAST(i * 4 AS INTEGER) AS frame_idx FROM pages, (SELECT unnest([0, 1]) AS i)")
def frame_udtf(spark, d):
    from ..ports import FakeFrames, sample_frames

    v = table(spark, d, "pages").select(F.col("page_id").cast("string").alias("lecture_id"), F.col("url").alias("path"))
    return runs.frame_events(sample_frames(v, FakeFrames))


@query(f"""WITH {EV}, o AS (SELECT *, CASE WHEN bit_count(xor(hash, lag(hash) OVER (PARTITION BY lecture_id ORDER BY event_index))) <= 2 THEN NULL ELSE event_index END AS own FROM ev),
p AS (SELECT *, max(own) OVER (PARTITION BY lecture_id ORDER BY event_index) AS owner FROM o)
SELECT lecture_id, event_index, owner, replace(replace(first_value(frame_image_path) OVER (PARTITION BY lecture_id, owner ORDER BY event_index), '_', ' '), '.png', '') AS ocr_text FROM p""")
def ocr_stub(spark, d):
    from ..ports import FakeOcr, ocr_events

    return ocr_events(lecture_events(spark, d), FakeOcr, most_bits=2).select("lecture_id", "event_index", "owner", "ocr_text")


@query("""SELECT CAST(page_id AS VARCHAR) AS lecture_id, url AS path, 'words' AS prompt, 'en' AS language, CAST(i AS INTEGER) AS seg_index, i * 2.0::DOUBLE AS start, i * 2.0::DOUBLE + 2 AS "end", CASE WHEN i = 0 THEN trim(url) ELSE 'words' END AS text FROM pages, (SELECT unnest([0, 1]) AS i)""")
def transcriber_stub(spark, d):
    from ..ports import FakeTranscriber, transcribe

    r = table(spark, d, "pages").select(F.col("page_id").cast("string").alias("lecture_id"), F.col("url").alias("path"), F.lit("words").alias("prompt"))
    return transcribe(r, FakeTranscriber)


@query(f"WITH {CONV} SELECT CAST(lecture_id AS VARCHAR) AS lecture_id, seg_index, round(s, 6) AS seg_start, round(e, 6) AS seg_end, md5(trim(text)) AS text_md5 FROM seg")
def recognised_segments(spark, d):
    from ..sources import logs

    path = scratch(spark, "segments")
    logs.write_logs(transcript(spark, d).select("lecture_id", "seg_index", "start", "end", F.concat(F.lit(" "), "text", F.lit(" ")).alias("text")), path)
    rows = logs.segment_log(spark, path)
    return rows.select("lecture_id", "seg_index", F.round("start", 6).alias("seg_start"), F.round("end", 6).alias("seg_end"), F.md5("text").alias("text_md5"))


@query("SELECT 'pages' AS lecture_id, i AS frame_idx, i / 25.0::DOUBLE AS timestamp, md5(url) AS frame_md5 FROM (SELECT row_number() OVER () - 1 AS i, url FROM pages) WHERE i % 4 = 0")
def frame_scan(spark, d):
    from ..sources.frames import TableVideo, frames

    rows = frames(spark, f"{d}/pages.parquet", lambda path: TableVideo(path, "url"), interval=0.16, frames_per_task=50, whole=True)
    return rows.select("lecture_id", "frame_idx", "timestamp", F.md5("content").alias("frame_md5"))


@query(SQL["change_events"].replace("round(timestamp, 3) AS timestamp, score", "timestamp, score AS value"))
def online_change_events(spark, d):
    """The events as a stream, through state by lecture, against the SQL of the batch operator."""
    from ..session import SETTINGS
    from ..streaming.online import online_changes

    own = spark.newSession()
    provider = "spark.sql.streaming.stateStore.providerClass"
    own.conf.set(provider, SETTINGS[provider])
    own.conf.set("spark.sql.session.timeZone", "UTC")
    where, out = scratch(spark, "online"), scratch(spark, "online-changes")
    lecture_events(spark, d).select("lecture_id", "timestamp", F.col("score").alias("value")).write.parquet(where)
    samples = own.readStream.schema("lecture_id long, timestamp double, value double").parquet(where)
    found = online_changes(samples, 35)
    stream = found.writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch(spark, "checkpoint")).trigger(availableNow=True).start()
    stream.awaitTermination()
    return spark.read.parquet(out)


# Stored files as relations

@query("""SELECT o_orderkey AS lecture_id, CASE WHEN n_line > 0 THEN 'https://b/' || o_orderkey ELSE 'https://a/' || o_orderkey END AS url
FROM (SELECT o_orderkey, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45) AS n_line FROM orders)""")
def merge_provenance(spark, d):
    old = table(spark, d, "orders").select(F.col("o_orderkey").alias("lecture_id")).withColumn("url", F.concat(F.lit("https://a/"), F.col("lecture_id").cast("string")))
    new = table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("lecture_id")).distinct().join(old.select("lecture_id"), "lecture_id", "left_semi")
    return artifacts.merge_provenance(old, new.withColumn("url", F.concat(F.lit("https://b/"), F.col("lecture_id").cast("string"))))


@query("""SELECT 'd' || doc_id AS name, 100 AS modified FROM documents WHERE doc_id % 7 = 0 OR doc_id % 5 = 0""")
def stale_documents(spark, d):
    s = table(spark, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("name"), F.lit(100).alias("modified"), "doc_id")
    made = s.where("doc_id % 7 != 0").select("name", F.when(F.col("doc_id") % 5 == 0, 99).otherwise(F.lit(100) + F.col("doc_id") % 2).alias("modified"))
    return artifacts.stale_documents(s.select("name", "modified"), made)


@query("""SELECT n_name AS name, n_nationkey AS size, 'replaced' AS how FROM nation WHERE n_regionkey < 2
UNION ALL SELECT n_name, CASE WHEN n_regionkey < 2 THEN n_nationkey ELSE -n_nationkey END, 'added' FROM nation WHERE n_regionkey < 2 OR n_nationkey % 2 = 0""")
def merge_pool(spark, d):
    n = table(spark, d, "nation")
    old = n.where("n_nationkey % 2 = 0").select(F.col("n_name").alias("name"), (-F.col("n_nationkey")).alias("size"))
    new = n.where("n_regionkey < 2").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("size"))
    return artifacts.merge_pool(old, new, True).withColumn("how", F.lit("replaced")).union(artifacts.merge_pool(old, new, False).withColumn("how", F.lit("added")))


@query("""WITH n AS (SELECT source || '-' || lang AS name, doc_id, coalesce(length(text), 0) AS size, lang FROM documents),
a AS (SELECT name, doc_id, 1 AS modified FROM n WHERE size > 1000 AND lang <> 'en')
SELECT *, 'added' AS how FROM a UNION ALL SELECT name, doc_id, 0, 'added' FROM n WHERE name NOT IN (SELECT name FROM a)
UNION ALL SELECT name, doc_id, 2, 'replaced' FROM n WHERE lang = 'en'""")
def staged_pool(spark, d):
    n = table(spark, d, "documents").select(F.concat_ws("-", "source", "lang").alias("name"), "doc_id", "lang", F.coalesce(F.length("text"), F.lit(0)).alias("size"))
    own = lambda rows, modified: rows.select("name", "doc_id", F.lit(modified).alias("modified"))
    pool = Pool(spark, scratch(spark, "staged_pool"), own(n, 0).schema)
    pool.save(own(n, 0), replace=True)
    pool.save(own(n.where("size > 1000 and lang != 'en'"), 1), replace=False)
    pool.stage(own(n, 9))
    added = pool.read()
    pool.save(own(n.where("lang = 'en'"), 2), replace=True)
    return added.withColumn("how", F.lit("added")).union(pool.read().withColumn("how", F.lit("replaced")))


@query("SELECT n_name AS text, r_name AS source FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey < 3")
def tagged_exams(spark, d):
    n = table(spark, d, "nation")
    regions = {r.r_name: r.r_regionkey for r in table(spark, d, "region").where("r_regionkey < 3").collect()}
    return artifacts.tagged_union({name: n.where(F.col("n_regionkey") == k).select(F.col("n_name").alias("text")) for name, k in regions.items()}, ["text string"])


@query("""SELECT doc_id AS lecture_id, size, CAST(size - 200 AS DOUBLE) AS duration FROM (SELECT doc_id, CAST(coalesce(length(text), 0) AS BIGINT) AS size FROM documents WHERE lang <> 'fr') WHERE size > 200""")
def playable_files(spark, d):
    f = table(spark, d, "documents").select(F.col("doc_id").alias("lecture_id"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("size"), "lang")
    return artifacts.playable(f.drop("lang"), f.where("lang != 'fr'").select("lecture_id", (F.col("size") - 200).cast("double").alias("duration")))


@query("SELECT doc_id, source || '/' || doc_id || CASE WHEN lang = 'en' THEN '.PDF' ELSE '.pptx' END AS path FROM documents WHERE lang IN ('en', 'de')")
def upload_filter(spark, d):
    end = F.when(F.col("lang") == "en", ".PDF").when(F.col("lang") == "de", ".pptx").otherwise(".exe")
    files = table(spark, d, "documents").select("doc_id", F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), end).alias("path"))
    return artifacts.with_extension(files, "pdf", "pptx")


@query("SELECT CASE WHEN n_nationkey < 10 THEN 'exam_' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') ELSE 'exam_' || n_nationkey END AS name FROM nation WHERE n_nationkey % 4 <> 1")
def exam_names(spark, d):
    k = F.col("n_nationkey")
    name = F.when(k % 4 == 1, F.format_string("exam_%d x", k)).otherwise(F.format_string("exam_%02d", k))
    return catalog.valid_exam_names(table(spark, d, "nation").select(name.alias("name")))


@query("SELECT l_orderkey, CAST(list_sort(list_distinct(list(l_linenumber))) AS VARCHAR) AS stages FROM lineitem GROUP BY ALL")
def wanted_stages(spark, d):
    asked = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.flatten(F.collect_list(F.array("l_linenumber", "l_linenumber"))).alias("asked"))
    shown = F.array_join(F.transform(catalog.wanted_stages("asked"), lambda x: x.cast("string")), ", ")
    return asked.select("l_orderkey", F.concat(F.lit("["), shown, F.lit("]")).alias("stages"))


@query(f"""WITH {EV} SELECT lecture_id, CAST(sum(hash) AS BIGINT) AS input_tokens, count(*) AS output_tokens, CAST(0 AS BIGINT) AS cache_creation_input_tokens, CAST(sum(CASE WHEN hash > 50 THEN hash ELSE 0 END) AS BIGINT) AS cache_read_input_tokens FROM ev GROUP BY ALL""")
def usage_by_lecture(spark, d):
    u = lecture_events(spark, d).select("lecture_id", F.col("hash").alias("input_tokens"), F.lit(1).alias("output_tokens"), F.lit(None).cast("long").alias("cache_creation_input_tokens"), F.when(F.col("hash") > 50, F.col("hash")).alias("cache_read_input_tokens"))
    return catalog.total_usage(u, ("lecture_id",))


@query(f"""WITH {EV} SELECT lecture_id, event_index, hash > 50 AS confirmed FROM ev""")
def split_verdicts(spark, d):
    e = lecture_events(spark, d).withColumn("verdict", F.when(F.col("hash") % 2 == 0, F.struct((F.col("hash") > 50).alias("is_example"))).when(F.col("hash") > 50, F.struct(F.lit(True).alias("is_example"))))
    good, bad = catalog.split_verdicts(e)
    return good.select("lecture_id", "event_index", F.lit(True).alias("confirmed")).union(bad.select("lecture_id", "event_index", F.lit(False)))


@query("SELECT conv_id AS lecture_id, turn, CAST(turn + 1 AS INTEGER) AS number, role AS l_role, length(text) AS r_size FROM conversations")
def numbered_results(spark, d):
    c = table(spark, d, "conversations").withColumnRenamed("conv_id", "lecture_id")
    left = chunks.numbered(c.select("lecture_id", "turn", F.col("role").alias("l_role")), "turn")
    right = chunks.numbered(c.select("lecture_id", "turn", F.length("text").cast("long").alias("r_size")), "turn").drop("turn")
    return chunks.zipped(left, right, "number")


@query("""SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'sr' WHEN 1 THEN 'en' END AS language, CASE WHEN turn % 4 < 2 THEN 1 END AS n_segments, CASE WHEN turn % 4 >= 2 THEN 'malformed response' END AS error FROM conversations""")
def recogniser_errors(spark, d):
    kind = F.col("turn") % 4
    answer = F.when(kind == 0, '{"segments": [{"start": 0, "end": 1.5, "text": " a "}]}').when(kind == 1, '{"language": "en", "segments": [{"start": 1, "end": 2, "text": "b"}]}').when(kind == 2, '{"segments": [{"start": 0, "text": "c"}]}').otherwise("not json")
    c = table(spark, d, "conversations").withColumn("a", answer).withColumn("r", chunks.answer_or_error(F.col("a"), "sr"))
    return c.select("conv_id", "turn", "r.response.language", F.when(F.col("r.error").isNull(), F.size("r.response.segments")).alias("n_segments"), "r.error")


# Texts and pictures

@query("""SELECT conv_id, turn, md5(t) AS restored_md5, 2 AS n_formulas, md5('A ' || chr(0) || '@@0@@' || chr(0) || replace(text, '$', '') || chr(0) || '@@1@@' || chr(0)) AS stashed_md5
FROM (SELECT *, 'A $x_1$' || replace(text, '$', '') || '$$y' || chr(10) || 'z$$' AS t FROM conversations)""")
def math_stash(spark, d):
    own = F.concat(F.lit("A $x_1$"), F.replace("text", F.lit("$"), F.lit("")), F.lit("$$y\nz$$"))
    c = table(spark, d, "conversations").withColumn("s", fn.stashed_math(own))
    return c.select("conv_id", "turn", F.md5(fn.restored_math("s.text", "s.formulas")).alias("restored_md5"), F.size("s.formulas").alias("n_formulas"), F.md5("s.text").alias("stashed_md5"))


@query(f"""WITH {EV} SELECT lecture_id, event_index, '../frames/' || frame_image_path AS note_path, '{{"k": ' || hash || '}}' AS answer FROM ev""")
def answers_and_paths(spark, d):
    e = lecture_events(spark, d)
    bare = F.concat(F.lit('{"k": '), F.col("hash").cast("string"), F.lit("}"))
    answer = F.when(F.col("hash") % 3 == 0, F.concat(F.lit("So:\n```json\n"), bare, F.lit("\n```\nDone."))).when(F.col("hash") % 3 == 1, F.concat(F.lit("I say "), bare, F.lit(" here"))).otherwise(F.concat(F.lit(" \n"), bare, F.lit("\n")))
    return e.select("lecture_id", "event_index", fn.note_image_path(F.concat(F.lit("output/frames/"), "frame_image_path")).alias("note_path"), fn.embedded_json(answer).alias("answer"))


@query("""WITH p AS (SELECT vec_id, list_concat(embedding, embedding[1:8]) AS e FROM embeddings),
h AS (SELECT vec_id, list_sum(list_transform(range(64), lambda i: CASE WHEN e[i // 8 * 9 + i % 8 + 1] > e[i // 8 * 9 + i % 8 + 2] THEN CAST(1 AS HUGEINT) << CAST(63 - i AS INTEGER) ELSE CAST(0 AS HUGEINT) END)) AS x FROM p)
SELECT vec_id, CAST(CASE WHEN x > 9223372036854775807 THEN x - 18446744073709551616::HUGEINT ELSE x END AS BIGINT) AS dhash FROM h""")
def frame_hash_full(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.concat("embedding", F.slice("embedding", 1, 8)).alias("gray"))
    return e.select("vec_id", fn.difference_hash("gray").alias("dhash"))


@query("""WITH w AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(trunc(v * 1000) AS DOUBLE)) AS e FROM embeddings), o AS (SELECT *, p % 3 AS x, p // 3 AS y FROM w, (SELECT CAST(unnest(range(9)) AS INTEGER) AS p))
SELECT vec_id, p AS place, round(list_sum(list_transform(range(64), lambda i: e[i + 1] * greatest(0, least(i % 8 + 1, (x + 1) * 8 / 3.0::DOUBLE) - greatest(i % 8, x * 8 / 3.0::DOUBLE)) * greatest(0, least(i // 8 + 1, (y + 1) * 8 / 3.0::DOUBLE) - greatest(i // 8, y * 8 / 3.0::DOUBLE)))) * 9 / 64, 6) AS mean FROM o""")
def frame_resize(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", scaled("embedding", 1000).cast("array<double>").alias("gray"), F.lit(8).alias("w"), F.lit(8).alias("h"))
    return e.select("vec_id", F.posexplode(fn.area_resized("gray", "w", "h", 3)).alias("place", "mean")).withColumn("mean", F.round("mean", 6))


@query("""WITH s AS (SELECT conv_id AS lecture_id, max(CASE WHEN turn = 0 THEN text END) AS t, max(CASE WHEN turn = 1 THEN text END) AS b, max(CASE WHEN turn = 2 THEN text END) AS n FROM (SELECT conv_id, turn, trim(text, E' \\n\\t\\r') AS text FROM conversations WHERE turn < 3) GROUP BY ALL)
SELECT lecture_id, CAST(1 AS INTEGER) AS slide_number, CASE WHEN lecture_id % 2 = 0 THEN coalesce(t, '') ELSE coalesce(split_part(b, chr(10), 1), '') END AS title, coalesce(b, '') AS body_text, coalesce(n, '') AS notes_text, CASE WHEN lecture_id % 3 = 0 THEN 'p.png' ELSE '' END AS image_path FROM s""")
def shape_slides(spark, d):
    c = table(spark, d, "conversations").where("turn < 3").withColumnRenamed("conv_id", "lecture_id")
    role = F.when(F.col("turn") == 0, F.when(F.col("lecture_id") % 2 == 0, "title")).when(F.col("turn") == 1, "body").otherwise("notes")
    shapes = c.select("lecture_id", F.lit(1).alias("slide_number"), F.col("turn").alias("shape_index"), role.alias("role"), F.concat(F.lit("\n"), "text", F.lit(" ")).alias("text"))
    images = c.select("lecture_id").distinct().where("lecture_id % 3 = 0").select("lecture_id", F.lit(1).alias("slide_number"), F.lit("p.png").alias("image_path"))
    return decks.shapes_to_slides(shapes, images)


@query("""WITH n AS (SELECT r_name AS lecture_id, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS position, n_nationkey, n_name FROM nation JOIN region ON n_regionkey = r_regionkey),
b AS (SELECT *, CASE n_nationkey % 4 WHEN 0 THEN '## Slide ' || position || chr(10) || chr(10) || '*(Nothing to summarize here — skipped.)*' || chr(10)
 WHEN 1 THEN '## Slide ' || position || chr(10) || chr(10) || '*(Note generation failed here: ' || n_name || ')*' || chr(10) ELSE '## Slide ' || position || ': ' || n_name || chr(10) || 'text' || chr(10) END AS body FROM n)
SELECT lecture_id, '# ' || lecture_id || chr(10) || chr(10) || string_agg(body, chr(10) ORDER BY position) || coalesce(chr(10) || chr(10) || '---' || chr(10) || chr(10) || '**Slides that failed to generate:** ' || string_agg(CASE WHEN n_nationkey % 4 = 1 THEN CAST(n_nationkey AS VARCHAR) END, ', ' ORDER BY position) || chr(10), '') AS text FROM b GROUP BY lecture_id""")
def lecture_notes(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    k = F.col("n_nationkey") % 4
    note = F.struct((k == 0).alias("skipped"), F.when(k == 1, F.col("n_name")).alias("error"), F.when(k > 1, F.concat(F.lit("## "), "n_name", F.lit("\ntext"))).alias("text"))
    rows = n.select(F.col("r_name").alias("lecture_id"), F.col("n_nationkey").alias("slide_number"), F.lit("deck").alias("mode"), note.alias("note"), F.lit("").alias("examples"), F.lit(None).cast("string").alias("deck_image_path"), F.lit(None).cast("string").alias("frame_image_path"))
    return documents.lecture_notes(chunks.numbered(rows, "slide_number", name="position"))


# Prompts

@query("""SELECT conv_id AS lecture_id, md5(left(string_agg(role || ': ' || text, chr(10) || chr(10) ORDER BY turn), 900)) AS text_md5, CAST(least(900, sum(length(role || ': ' || text)) + 2 * (count(*) - 1)) AS BIGINT) AS n_chars FROM conversations GROUP BY conv_id""")
def budgeted_text(spark, d):
    from . import prompts

    parts = table(spark, d, "conversations").select(F.col("conv_id").alias("lecture_id"), "turn", F.concat("role", F.lit(": "), "text").alias("text"))
    return prompts.joined_within(parts, 900, ("lecture_id",), "turn").select("lecture_id", F.md5("text").alias("text_md5"), F.length("text").cast("long").alias("n_chars"))


@query("""WITH c AS (SELECT *, CASE turn % 3 WHEN 0 THEN 'Slide ' || turn || chr(10) || chr(10) || 'On the slide:' || chr(10) || role || chr(10) || chr(10) || 'In the deck''s notes, not said aloud:' || chr(10) || '(none)' || chr(10) || chr(10) || 'Said while it was shown:' || chr(10) || t
   || chr(10) || chr(10) || 'Worked out meanwhile, and shown as images in this order:' || chr(10) || '1. whiteboard: ' || role || chr(10) || '2. example: '
 WHEN 1 THEN 'Part ' || turn || ' of the recording (?)' || chr(10) || chr(10) || 'Words read off the screen, which may be misread:' || chr(10) || role || ', x' || chr(10) || chr(10) || 'Said meanwhile:' || chr(10) || t
 ELSE 'Blueprint:' || chr(10) || role || chr(10) || chr(10) || 'Course material:' || chr(10) || chr(10) || text || chr(10) || chr(10) || 'This is paper ' || turn || ' of 9; its questions differ from those of the others.' END AS p
 FROM (SELECT *, coalesce(nullif(trim(text, E' \\n\\t\\r'), ''), '(none)') AS t FROM conversations))
SELECT conv_id, turn, md5(p) AS prompt_md5 FROM c""")
def prompt_builders(spark, d):
    from . import prompts

    c = table(spark, d, "conversations").withColumns({"slide_number": F.col("turn"), "slide_text": F.col("role"), "notes_text": F.lit(" \n"), "transcript_text": F.col("text"), "position": F.col("turn"), "number": F.col("turn"), "blueprint": F.col("role")})
    c = c.withColumns({"start": F.lit(None).cast("double"), "end": F.lit(None).cast("double"), "segment_keywords": F.array("role", F.lit("x"))})
    shown = F.array(F.struct(F.lit("whiteboard").alias("kind"), F.col("role").alias("caption")), F.struct(F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("caption")))
    prompt = F.when(F.col("turn") % 3 == 0, prompts.slide_prompt(shown)).when(F.col("turn") % 3 == 1, prompts.segment_prompt()).otherwise(prompts.exam_prompt(9))
    return c.select("conv_id", "turn", F.md5(prompt).alias("prompt_md5"))


@query("""WITH g AS (SELECT n_regionkey, left(string_agg(n_name || ' ' || n_nationkey, chr(10) || chr(10) ORDER BY n_nationkey), 30) AS t FROM nation GROUP BY ALL),
s AS (SELECT n_regionkey, string_agg(chr(10) || '--- ' || n_name || ' ---' || chr(10) || n_nationkey, chr(10) ORDER BY n_name) AS e FROM nation WHERE n_nationkey % 2 = 0 AND n_regionkey <> 2 GROUP BY ALL)
SELECT r_name, t || coalesce(chr(10) || chr(10) || 'Sheets of single lectures made from it:' || chr(10) || e, '') AS prompt FROM region JOIN g ON n_regionkey = r_regionkey LEFT JOIN s USING (n_regionkey)""")
def course_prompt(spark, d):
    from . import prompts

    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    guide = n.select("r_name", "n_nationkey", F.concat("n_name", F.lit(" "), F.col("n_nationkey").cast("string")).alias("text"))
    sheets = n.where("n_nationkey % 2 = 0 and n_regionkey <> 2").select("r_name", F.col("n_name").alias("lecture_id"), F.col("n_nationkey").cast("string").alias("text"))
    return prompts.course_prompts(guide, sheets, ("r_name",), "n_nationkey", 30).select("r_name", "prompt")


PLAIN = "trim(regexp_replace(text, '[^A-Za-z .,]+', ' ', 'g'))"


@query(f"""WITH p AS (SELECT conv_id, turn, role, {PLAIN} AS t FROM conversations),
h AS (SELECT *, CASE turn % 4 WHEN 0 THEN '<h2>' || turn || ' <em>' || role || '</em></h2>' || chr(10) || '<p>x <strong>' || t || '</strong>' || chr(10) || 'and $a_' || turn || '*b*$</p>'
 WHEN 1 THEN '<ul>' || chr(10) || '<li>x ' || t || '<ol>' || chr(10) || '<li>one <code>a&lt;b</code></li>' || chr(10) || '<li>two</li>' || chr(10) || '</ol>' || chr(10) || '</li>' || chr(10) || '<li><a href="#t">' || role || '</a></li>' || chr(10) || '</ul>'
 WHEN 2 THEN '<pre><code class="language-text"># x ' || t || chr(10) || chr(10) || '&lt;i&gt;' || chr(10) || '</code></pre>'
 ELSE '<table>' || chr(10) || '<thead>' || chr(10) || '<tr>' || chr(10) || '<th>who</th>' || chr(10) || '<th>what</th>' || chr(10) || '</tr>' || chr(10) || '</thead>' || chr(10) || '<tbody>' || chr(10) || '<tr>' || chr(10) || '<td>' || role || '</td>' || chr(10) || '<td>x ' || t || '</td>' || chr(10) || '</tr>' || chr(10) || '</tbody>' || chr(10) || '</table>' || chr(10) || '<p><img alt="i" src="/files/' || turn || '.png" /></p>' END AS html FROM p)
SELECT conv_id AS lecture_id, md5(string_agg(html, chr(10) ORDER BY turn)) AS html_md5, CAST(sum(length(html)) + count(*) - 1 AS BIGINT) AS n_chars FROM h GROUP BY conv_id""")
def guide_html(spark, d):
    from . import markdown

    said, turn, role = F.concat(F.lit("x "), F.trim(F.regexp_replace("text", "[^A-Za-z .,]+", " "))), F.col("turn").cast("string"), F.col("role")
    kind = F.col("turn") % 4
    heading = F.concat(F.lit("## "), turn, F.lit(" *"), role, F.lit("*\n\nx **"), F.substr(said, F.lit(3)), F.lit("**\nand $a_"), turn, F.lit("*b*$"))
    items = F.concat(F.lit("- "), said, F.lit("\n    1. one `a<b`\n    2. two\n- ["), role, F.lit("](#t)"))
    code = F.concat(F.lit("```text\n# "), said, F.lit("\n\n<i>\n```"))
    rows = F.concat(F.lit("| who | what |\n|---|---|\n| "), role, F.lit(" | "), said, F.lit(" |\n\n![i]("), turn, F.lit(".png)"))
    parts = table(spark, d, "conversations").select("conv_id", F.struct("turn", F.when(kind == 0, heading).when(kind == 1, items).when(kind == 2, code).otherwise(rows).alias("text")).alias("part"))
    guides = parts.groupBy(F.col("conv_id").alias("lecture_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("part")), lambda p: p["text"]), "\n\n").alias("text"))
    html = markdown.rendered(guides, keys=("lecture_id",)).withColumn("html", markdown.preview_sources("html"))
    return html.select("lecture_id", F.md5("html").alias("html_md5"), F.length("html").cast("long").alias("n_chars"))


# Stage 4 as a whole: similarities, the ordered matcher, runs

STAGE_4 = SQL["deck_similarity"].split("\nSELECT e.conv_id")[0].replace("WITH docs", "WITH RECURSIVE docs", 1) + """,
sc AS MATERIALIZED (SELECT e.conv_id, e.turn, list(coalesce(sim, 0.0::DOUBLE) ORDER BY z.turn) AS sc FROM conversations e JOIN conversations z ON e.conv_id = z.conv_id AND z.turn < 3 LEFT JOIN p ON p.conv_id = e.conv_id AND p.e = e.turn AND p.s = z.turn + 1 GROUP BY ALL),
""" + SQL["greedy_match"].split("FROM conversations),\n", 1)[1].split("\nSELECT conv_id AS lecture_id")[0].replace(":4]", ":3]") + """,
matched AS (SELECT conv_id AS lecture_id, turn AS event_index, cur AS slide_number, round(score, 4) AS score, jumped, stayed, turn * 10.0::DOUBLE AS timestamp, 'output/' || turn || '.png' AS frame FROM m WHERE turn >= 0)"""


def stage_four(spark, d, modes: DataFrame | None = None, t: Tunables = Tunables(auto_visual_threshold=0.0)) -> dict[str, DataFrame]:  # noqa: B008
    """A deck of three slides against all turns of a conversation; unless told so no lecture falls back to sight."""
    e, s = deck_frames(spark, d)
    index = F.col("event_index")
    e = e.withColumns({"timestamp": index * F.lit(10.0), "frame_image_path": F.concat(F.lit("output/"), index.cast("string"), F.lit(".png")), "hash": index.cast("long")})
    slides = s.select("lecture_id", "slide_number", F.lit("").alias("title"), F.col("reference_text").alias("body_text"))
    return stages.match_stage(e, slides, None, STOP, modes, t)


@query(STAGE_4 + " SELECT lecture_id, event_index, slide_number, score, jumped AS jumped_backward, stayed AS stayed_over_raw_best, timestamp, frame AS frame_image_path FROM matched")
def stage_matches(spark, d):
    return stage_four(spark, d)["matches"].select("lecture_id", "event_index", "slide_number", "score", "jumped_backward", "stayed_over_raw_best", "timestamp", "frame_image_path")


@query(STAGE_4 + " SELECT lecture_id, event_index, slide_number, score FROM matched WHERE score < 0.25")
def stage_low_confidence(spark, d):
    return stage_four(spark, d)["low_confidence"].select("lecture_id", "event_index", "slide_number", "score")


@query(STAGE_4 + """, f AS (SELECT *, CASE WHEN slide_number = lag(slide_number) OVER w THEN 0 ELSE 1 END AS brk FROM matched WINDOW w AS (PARTITION BY lecture_id ORDER BY event_index)),
g AS (SELECT *, sum(brk) OVER (PARTITION BY lecture_id ORDER BY event_index) AS run FROM f),
r AS (SELECT lecture_id, run, any_value(slide_number) AS slide_number, min(timestamp) AS s, max(timestamp) AS l, max(score) AS confidence, arg_max(frame, event_index) AS last_frame_image_path FROM g GROUP BY ALL)
SELECT lecture_id, slide_number, s AS start, coalesce(lead(s) OVER (PARTITION BY lecture_id ORDER BY run), l) AS "end", confidence, last_frame_image_path, 'deck' AS mode FROM r""")
def stage_timeline(spark, d):
    return stage_four(spark, d)["timeline"].select("lecture_id", "slide_number", "start", "end", "confidence", "last_frame_image_path", "mode")


@query(STAGE_4 + """, q AS (SELECT lecture_id, count(*) FILTER (score < 0.25) / count(*) AS ratio FROM matched GROUP BY lecture_id),
md AS (SELECT lecture_id, CASE WHEN lecture_id % 7 = 0 OR ratio >= 0.6::DOUBLE THEN 'visual' ELSE 'deck' END AS mode FROM q),
f AS (SELECT *, CASE WHEN slide_number = lag(slide_number) OVER (PARTITION BY lecture_id ORDER BY event_index) THEN 0 ELSE 1 END AS brk FROM matched)
SELECT lecture_id, mode, CASE WHEN mode = 'deck' THEN CAST(sum(brk) AS BIGINT) END AS n_runs, count(*) FILTER (mode = 'deck' AND score < 0.25) AS n_low FROM f JOIN md USING (lecture_id) GROUP BY lecture_id, mode""")
def stage_modes(spark, d):
    """Lectures of both modes in one run: a seventh are said to have no deck, and those whose matches are weak fall back to sight."""
    modes = table(spark, d, "conversations").where("conv_id % 7 = 0").select(F.col("conv_id").alias("lecture_id"), F.lit("visual").alias("mode")).distinct()
    found = stage_four(spark, d, modes, Tunables())
    rows = found["timeline"].groupBy("lecture_id", "mode").agg(F.count("*").alias("n"))
    low = found["low_confidence"].groupBy("lecture_id").agg(F.count("*").alias("n_low"))
    return rows.join(low, "lecture_id", "left").select("lecture_id", "mode", F.when(F.col("mode") == "deck", F.col("n")).alias("n_runs"), F.coalesce("n_low", F.lit(0)).alias("n_low"))


# Stage 5 as a whole: runs of slides against what was said, short runs taken in, copies of slides made one, examples attached

STAGE_5 = f"""WITH {CONV}, t AS (SELECT lecture_id, seg_index AS run_idx, CASE WHEN lecture_id % 5 <> 0 AND lecture_id % 2 = 0 AND seg_index % 4 = 2 THEN 1 ELSE seg_index % 4 + 1 END AS slide_number,
 CASE WHEN seg_index = 0 THEN s ELSE s + 4 END AS s, 'f' || seg_index AS frame FROM seg),
runs AS (SELECT *, lead(s) OVER (PARTITION BY lecture_id ORDER BY run_idx) AS e FROM t),
sh AS (SELECT *, coalesce(e - s < 15, false) AS short FROM runs), """ + ABSORBED.split("AS short FROM runs),\n ", 1)[1] + """,
asg AS (SELECT * FROM (SELECT seg.lecture_id, seg.seg_index, r.run_idx, seg.text, row_number() OVER (PARTITION BY seg.lecture_id, seg.seg_index ORDER BY least(seg.e, coalesce(r.e, 'infinity'::DOUBLE)) - greatest(seg.s, r.s) DESC, r.run_idx) AS k
 FROM seg JOIN runs r ON r.lecture_id = seg.lecture_id AND seg.s < coalesce(r.e, 'infinity'::DOUBLE) AND r.s < seg.e) WHERE k = 1),
txt AS (SELECT a.lecture_id, b.target AS run_idx, string_agg(text, chr(10) ORDER BY a.run_idx, seg_index) AS run_text FROM asg a JOIN absorbed b USING (lecture_id, run_idx) GROUP BY ALL),
alive AS (SELECT b.*, coalesce(run_text, '') AS run_text FROM absorbed b LEFT JOIN txt USING (lecture_id, run_idx) WHERE b.target = b.run_idx),
cons AS (SELECT lecture_id, slide_number, min(run_idx) AS segment_idx, arg_min(s, run_idx) AS s, list(e ORDER BY run_idx)[-1] AS e, count(*) AS n_windows, coalesce(string_agg(nullif(run_text, ''), chr(10) || chr(10) ORDER BY run_idx), '') AS said,
 array_to_string(flatten(list(merged_from ORDER BY run_idx)), ',') AS merged_from, arg_max(frame, run_idx) AS frame FROM alive GROUP BY lecture_id, slide_number),
cand AS (SELECT lecture_id, seg_index AS event_index, CASE WHEN lecture_id % 5 <> 0 AND lecture_id % 2 = 0 AND seg_index % 6 = 2 THEN 1 ELSE seg_index % 6 + 1 END AS want, CASE WHEN seg_index % 3 = 2 THEN s - 1000 ELSE s + 5 END AS t FROM seg WHERE role = 'user'),
p AS (SELECT c.lecture_id, event_index, any_value(t) AS t, min(CASE WHEN want = k.slide_number THEN segment_idx END) AS eq,
 min(CASE WHEN EXISTS (SELECT 1 FROM alive a WHERE a.lecture_id = c.lecture_id AND a.slide_number = k.slide_number AND a.s <= c.t AND c.t <= coalesce(a.e, 'infinity'::DOUBLE)) THEN segment_idx END) AS ins,
 arg_min(segment_idx, {'d': abs(k.s - t), 'r': segment_idx}) AS near FROM cand c JOIN cons k ON c.lecture_id = k.lecture_id GROUP BY ALL),
ctx AS (SELECT p.lecture_id, event_index, coalesce(eq, ins, near) AS segment_idx, md5(trim(coalesce(string_agg(b.text, ' ' ORDER BY b.seg_index), ''), E' \\n\\t\\r')) AS heard FROM p LEFT JOIN seg b ON b.lecture_id = p.lecture_id AND b.e >= t - 20 AND b.s <= t + 40 GROUP BY ALL),
ex AS (SELECT lecture_id, segment_idx, string_agg(event_index || ':' || heard, ',' ORDER BY event_index) AS examples FROM ctx GROUP BY ALL)
SELECT lecture_id, slide_number, segment_idx, s AS seg_start, e AS seg_end, n_windows, md5(said) AS said_md5, merged_from, frame, CASE WHEN lecture_id % 5 = 0 THEN 'visual' ELSE 'deck' END AS mode, coalesce(examples, '') AS examples,
 CASE WHEN slide_number > 3 THEN '' ELSE 'T' || CASE WHEN lecture_id % 2 = 0 AND slide_number = 3 THEN 1 ELSE slide_number END || chr(10) || 'body' END AS slide_text FROM cons LEFT JOIN ex USING (lecture_id, segment_idx)"""


@query(STAGE_5)
def stage_segments(spark, d):
    """Each turn begins a run four seconds later; of four slides the fourth is not in the deck, and in even lectures the third is a copy of the first. A fifth of the lectures are by sight."""
    said = stored(transcript(spark, d), "transcript")
    lecture, turn = F.col("lecture_id"), F.col("seg_index")
    runs_of = said.select("lecture_id", turn.cast("long").alias("run_idx"), (turn % 4 + 1).cast("int").alias("slide_number"), F.when(turn == 0, F.col("start")).otherwise(F.col("start") + 4).alias("start"), F.concat(F.lit("f"), turn.cast("string")).alias("last_frame_image_path"))
    timeline = runs_of.withColumn("end", F.lead("start").over(runs.ordered(order="run_idx"))).withColumn("mode", F.when(lecture % 5 == 0, "visual").otherwise("deck"))
    n = F.col("slide_number")
    title = F.concat(F.lit("T"), F.when((lecture % 2 == 0) & (n == 3), 1).otherwise(n).cast("string"))
    slides = said.select("lecture_id").distinct().withColumn("slide_number", F.explode(F.sequence(F.lit(1), F.lit(3)))).withColumn("position", n)
    slides = slides.select("lecture_id", "slide_number", "position", title.alias("title"), F.lit("body").alias("body_text"), F.lit(None).cast("string").alias("notes_text"))
    own = said.where("role = 'user'").select(
        "lecture_id", turn.alias("event_index"), (turn % 6 + 1).cast("int").alias("slide_number"), F.when(turn % 3 == 2, F.col("start") - 1000).otherwise(F.col("start") + 5).alias("timestamp"),
        F.lit("x.png").alias("frame_image_path"), F.lit("whiteboard").alias("kind"), F.lit(0.1).alias("score"), F.lit(None).cast("int").alias("ink_delta"), F.col("role").alias("ocr_excerpt"),
    )
    found = stages.segment_stage(timeline, said, slides, own, Tunables(min_dwell=15.0))
    heard = F.transform("example_candidates", lambda x: F.concat(x["event_index"].cast("string"), F.lit(":"), F.md5(x["transcript_context"])))
    return found.select(
        "lecture_id", "slide_number", "segment_idx", F.col("start").alias("seg_start"), F.col("end").alias("seg_end"), F.size("windows").cast("long").alias("n_windows"), F.md5("transcript_text").alias("said_md5"),
        numbers("merged_from").alias("merged_from"), F.col("frame_image_path").alias("frame"), "mode", F.array_join(heard, ",").alias("examples"), "slide_text",
    )
