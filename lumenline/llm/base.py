"""The columns of operators without whole SQL that SQL can express, as queries of their own: each takes its operator's rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .licenses import op6_template_markup
from .preference import op2_preference_pairs
from .quality import op7_controlled_thresholds
from .sharding import op1_sampled_splitters


def base1_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_sampled_splitters(spark, sf_dir).select("doc_id", "size", "law")


def base2_common_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_preference_pairs(spark, sf_dir).select("pair_id", "chosen_id", "rejected_id", "n_common")


def base2_completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["start"].cast("string"), x["length"].cast("string"))), ",").alias(c)
    return op2_preference_pairs(spark, sf_dir).select("pair_id", "prompt", "chosen", "rejected", spans("chosen_spans"), spans("rejected_spans"))


def base6_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_template_markup(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def base7_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_controlled_thresholds(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


QUERIES = {f.__name__: f for f in (base1_sizes, base2_common_turns, base2_completions, base6_phrases, base7_counts)}

SQL = {
    "base1_sizes": "SELECT doc_id, coalesce(strlen(text), 0) + 1 AS size, 'bytes' AS law FROM documents",
    "base2_common_turns": """WITH t AS (SELECT DISTINCT conv_id // 2 AS pair_id, conv_id % 2 AS side, conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k FROM t),
c AS (SELECT pair_id, max(conv_id) FILTER (side = 0) AS chosen_id, max(conv_id) FILTER (side = 1) AS rejected_id, max(k) AS longest FROM n GROUP BY pair_id),
p AS (SELECT pair_id, k, count(*) = 2 AND count(DISTINCT role) = 1 AND count(DISTINCT text) = 1 AND bool_and(role IS NOT NULL AND text IS NOT NULL) AS same FROM n GROUP BY pair_id, k),
f AS (SELECT pair_id, min(k) FILTER (NOT same) - 1 AS n_common FROM p GROUP BY pair_id)
SELECT pair_id, chosen_id, rejected_id, coalesce(n_common, longest) AS n_common FROM c JOIN f USING (pair_id)""",
    "base2_completions": """WITH t AS (SELECT DISTINCT conv_id // 2 AS pair_id, conv_id % 2 AS side, conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k FROM t),
c AS (SELECT pair_id, max(conv_id) FILTER (side = 0) AS chosen_id, max(conv_id) FILTER (side = 1) AS rejected_id, max(k) AS longest FROM n GROUP BY pair_id),
p AS (SELECT pair_id, k, count(*) = 2 AND count(DISTINCT role) = 1 AND count(DISTINCT text) = 1 AND bool_and(role IS NOT NULL AND text IS NOT NULL) AS same FROM n GROUP BY pair_id, k),
f AS (SELECT pair_id, min(k) FILTER (NOT same) - 1 AS n_common FROM p GROUP BY pair_id),
r AS (SELECT n.*, chosen_id, rejected_id, k <= coalesce(n_common, longest) AS shared, '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10) AS shown, length(coalesce(text, '')) + 8 AS body FROM n JOIN c USING (pair_id) JOIN f USING (pair_id)),
s AS (SELECT *, CASE WHEN role = 'assistant' AND NOT shared THEN sum(length(shown)) OVER (PARTITION BY pair_id, side, shared ORDER BY k) - body || ':' || body END AS span FROM r)
SELECT pair_id, coalesce(string_agg(shown, '' ORDER BY k) FILTER (shared AND side = 0), '') AS prompt,
 CASE WHEN any_value(chosen_id) IS NOT NULL THEN coalesce(string_agg(shown, '' ORDER BY k) FILTER (NOT shared AND side = 0), '') END AS chosen,
 CASE WHEN any_value(rejected_id) IS NOT NULL THEN coalesce(string_agg(shown, '' ORDER BY k) FILTER (NOT shared AND side = 1), '') END AS rejected,
 CASE WHEN any_value(chosen_id) IS NOT NULL THEN coalesce(string_agg(span, ',' ORDER BY k) FILTER (side = 0), '') END AS chosen_spans,
 CASE WHEN any_value(rejected_id) IS NOT NULL THEN coalesce(string_agg(span, ',' ORDER BY k) FILTER (side = 1), '') END AS rejected_spans FROM s GROUP BY pair_id""",
    "base6_phrases": r"""WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS l FROM documents),
w AS (SELECT doc_id, unnest(range(len(l))) AS p, unnest(l) AS a FROM d),
x AS (SELECT *, lead(a) OVER q AS b, lead(a, 2) OVER q AS c FROM w WINDOW q AS (PARTITION BY doc_id ORDER BY p)),
f AS (SELECT doc_id, p, CASE WHEN a = 'cc' AND b = 'by' THEN 'cc-by' WHEN a = 'general' AND b = 'public' AND c = 'license' THEN 'gpl' WHEN a = 'all' AND b = 'rights' AND c = 'reserved' THEN 'reserved' END AS label FROM x),
g AS (SELECT doc_id, count(*) AS n, min(p) AS first, max(p) AS last, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM f WHERE label IS NOT NULL GROUP BY doc_id)
SELECT doc_id, len(l) AS n_words, coalesce(n, 0) AS n_base, first AS first_word, last AS last_word, coalesce(labels, '') AS base_labels FROM d LEFT JOIN g USING (doc_id)""",
    "base7_counts": r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS l FROM documents),
w AS (SELECT doc_id, unnest(range(len(l))) AS p, unnest(l) AS a FROM d),
g AS (SELECT doc_id, p, string_agg(a, ' ') OVER q AS h, count(*) OVER q AS k FROM w WINDOW q AS (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
m AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, h) AS often FROM g WHERE k = 5),
r AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest(range(p, p + 5)) AS place FROM m WHERE often > 1) GROUP BY doc_id),
s AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
u AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM s WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id)
SELECT doc_id, len(l) AS n_words, coalesce(CAST(list_sum(list_transform(l, lambda x: length(x))) AS BIGINT), 0) AS word_chars, length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols,
coalesce(u.n, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, len(l) < 10 OR 100 * coalesce(r.n, 0) > 20 * len(l) AS base_failed
FROM d LEFT JOIN r USING (doc_id) LEFT JOIN u USING (doc_id)""",
}
