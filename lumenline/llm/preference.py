"""Preference formatting of conversation pairs, in DataFrame functions only.

Of a chosen and a rejected conversation the longest common prefix of turns (role and text equal, null
equals null) is rendered once, as the prompt. What follows on either side is a completion, with the spans of
the assistant's text that a loss may see; all else is masked.

A turn is rendered as ``<|role|>``, a line feed, its text, ``<|end|>`` and a line feed. Spans are
(start, length) in characters of the completion and take in the end mark. A null role or text is rendered
as empty. Of rows of one conversation with the same turn number that differ, all stay, by role and text;
rows that are equal count once. Rows without a conversation or a turn number belong to no conversation. A pair of which a side has no
conversation has no prompt, and null on that side. Pairs with a null id on both sides are dropped. Other
columns are ignored. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

END = "<|end|>\n"


def rendered(turn: Column) -> Column:
    return F.concat(F.lit("<|"), F.coalesce(turn["role"], F.lit("")), F.lit("|>\n"), F.coalesce(turn["text"], F.lit("")), F.lit(END))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, rendered), "")


def completion_spans(turns: Column, learned: str) -> Column:
    """(start, length) of the learned role's text and end mark within the rendered turns."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

    def step(acc: Column, turn: Column) -> Column:
        head = F.length(F.coalesce(turn["role"], F.lit(""))) + 5  # <| |> and the line feed
        body = F.length(F.coalesce(turn["text"], F.lit(""))) + len(END)
        span = F.struct((acc["at"] + head).cast("long").alias("start"), body.cast("long").alias("length"))
        spans = F.when(turn["role"] == learned, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct((acc["at"] + head + body).cast("long").alias("at"), spans.alias("spans"))

    return F.aggregate(turns, start, step, lambda acc: acc["spans"])


def common_prefix(a: Column, b: Column) -> Column:
    """How many leading turns of two arrays are equal in role and text."""
    n = F.least(F.size(a), F.size(b))
    same = lambda i: F.get(a, i)["role"].eqNullSafe(F.get(b, i)["role"]) & F.get(a, i)["text"].eqNullSafe(F.get(b, i)["text"])
    differs = F.filter(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), lambda i: ~same(i))
    return F.coalesce(F.get(differs, F.lit(0)), n)


def format_preferences(turns: DataFrame, pairs: DataFrame, learned: str = "assistant") -> DataFrame:
    """A row for each pair (pair_id, chosen_id, rejected_id): prompt, completions and their learned spans.

    ``turns`` are conv_id, turn, role, text. A conversation becomes one value, as each rendered completion is.
    """
    sides = pairs.select("pair_id", F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"{s}_id").alias("conv_id")) for s in ("chosen", "rejected")])).alias("x"))
    sides = sides.select("pair_id", "x.side", "x.conv_id").where("conv_id is not null").distinct()
    own = turns.where("conv_id is not null and turn is not null").select("conv_id", "turn", "role", "text")
    return assemble(own.join(sides, "conv_id"), learned)


def assemble(rows: DataFrame, learned: str) -> DataFrame:
    """``rows`` (pair_id, side, conv_id, turn, role, text) as one row for each pair."""
    struct = F.struct("turn", "role", "text")
    side = lambda s: F.array_sort(F.collect_set(F.when(F.col("side") == s, struct)))
    conv = lambda s: F.min(F.when(F.col("side") == s, F.col("conv_id")))
    both = rows.groupBy("pair_id").agg(conv("chosen").alias("chosen_id"), conv("rejected").alias("rejected_id"), side("chosen").alias("c"), side("rejected").alias("r"))
    both = both.withColumn("n_common", common_prefix(F.col("c"), F.col("r")))
    rest = lambda s: F.slice(s, F.col("n_common") + 1, F.greatest(F.size(s) - F.col("n_common"), F.lit(0)))
    both = both.withColumns({"prefix": F.slice("c", F.lit(1), F.col("n_common")), "c_rest": rest("c"), "r_rest": rest("r")})
    shown = lambda x, known: F.when(F.col(known).isNotNull(), x)
    return both.select(
        "pair_id",
        "chosen_id",
        "rejected_id",
        F.col("n_common").cast("long").alias("n_common"),
        render(F.col("prefix")).alias("prompt"),
        shown(render(F.col("c_rest")), "chosen_id").alias("chosen"),
        shown(render(F.col("r_rest")), "rejected_id").alias("rejected"),
        shown(completion_spans(F.col("c_rest"), learned), "chosen_id").alias("chosen_spans"),
        shown(completion_spans(F.col("r_rest"), learned), "rejected_id").alias("rejected_spans"),
    )


def op2_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations 2k and 2k + 1 are pair k: the first chosen, the second rejected.

    As the pair follows from the id, the turns are grouped by it at once, in one shuffle.
    """
    turns = read(spark, sf_dir, "conversations").where("conv_id is not null and turn is not null")
    even = F.pmod("conv_id", F.lit(2)) == 0
    rows = turns.select(F.shiftright(F.col("conv_id").cast("long"), 1).alias("pair_id"), F.when(even, "chosen").otherwise("rejected").alias("side"), "conv_id", "turn", "role", "text")
    return assemble(rows, "assistant")
