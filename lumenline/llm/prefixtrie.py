"""The trie of all prefixes of conversations, as succinct level-order tries over shards of prefixes.

A node is a distinct sequence of first turns. Its name is a pair of 64-bit hashes: the exclusive or of hashes of (depth, turn)
along the path, so a parent's name is a node's own without its last turn. Turns are counted by node before anything is
dealt out, so copies cost nothing after that; texts are never shuffled, only their hashes and lengths.

* Nodes of a single conversation have a chain below them and nothing to sum up. Only the top one of a chain goes into a trie.
* Nodes whose subtrees hold more than a task should (``SHARD`` turns, copies counted) are heavy. They are the upper levels.
* Below a heavy node each subtree is a shard. A task takes its shards as they come, and builds level-order tries of them with
  numpy: a bitvector (a one for each child and a zero, node by node) and an array of labels. Leaves and saved tokens are
  rolled up in reverse level order, children added to parents at once for each level.
* The upper levels are a trie of their own, whose nodes start with the sums over their shards. SHARD doubles until there
  are at most ``UPPER`` heavy nodes.

Where many conversations end at one node their ids are joined in sorted pieces, by ranges of ids, and only the hash over the
pieces runs through one task, a piece at a time.

Null roles and texts count as empty. Rows without conv_id belong to no conversation and are left out; a conversation of
any number of turns spans several tasks. Turns of one number are taken by the md5 of role and text; repeated rows are turns. Texts may be
of any length. An empty table has no nodes. Other columns are ignored. One chain that several conversations share must
fit one task if it has more than UPPER nodes (24 MB a million).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_type, join_split, materialize, read
from .turns import numbered

#: Turns below a node that a task takes at most, and heavy nodes at most.
SHARD, UPPER = 1 << 17, 1 << 20
#: Turns of a conversation whose hashes are summed up in one go.
BLOCK = 4096
NONE = hashlib.sha256(b"").hexdigest()


class Forest:
    """Trees as one level-order trie: ``bits`` has for each node, breadth first, a one for each child and then a zero.

    The first run of ones are the roots. ``order`` has the places of the given nodes breadth first; siblings are in
    the order of their labels.
    """

    def __init__(self, tree: np.ndarray, depth: np.ndarray, name: np.ndarray, parent: np.ndarray):
        """Nodes sorted by (tree, depth); the first of a tree is its root. Names must be distinct within a tree."""
        first = np.r_[True, tree[1:] != tree[:-1]] if len(tree) else np.zeros(0, bool)
        level = depth - depth[first][np.cumsum(first) - 1] if len(tree) else depth
        label = name ^ parent
        place = np.empty(len(tree), np.int64)
        order, degrees, above = [], [], None
        by_level = np.argsort(level, kind="stable")
        cuts = np.flatnonzero(np.diff(level[by_level])) + 1
        for own in np.split(by_level, cuts) if len(tree) else []:
            if above is None:
                up = np.zeros(len(own), np.int64)
                own = own[np.argsort(tree[own], kind="stable")]
                degrees.append([len(own)])
            else:
                sorted_above = above[np.lexsort((name[above], tree[above]))]
                pairs = np.rec.fromarrays([tree[sorted_above], name[sorted_above]])
                up = sorted_above[np.searchsorted(pairs, np.rec.fromarrays([tree[own], parent[own]], dtype=pairs.dtype))]
                up = place[up]
                turn = np.lexsort((label[own], up))
                own, up = own[turn], up[turn]
                degrees.append(np.bincount(up, minlength=len(above)))
            place[own] = np.arange(len(own))
            order.append(own)
            above = own
        degrees.append(np.zeros(0 if above is None else len(above), np.int64))
        self.order = np.concatenate(order) if order else np.zeros(0, np.int64)
        self.levels = np.cumsum([0, *map(len, order)])
        self.labels = label[self.order]
        ends = np.cumsum(np.concatenate([np.asarray(d, np.int64) for d in degrees])) + np.arange(len(self.order) + bool(len(order)))
        self.bits = np.ones(int(ends[-1]) + 1 if len(ends) else 0, bool)
        self.bits[ends] = False

    def parents(self) -> np.ndarray:
        """Each node's parent, by places breadth first; -1 for roots: the zeros before its one, without the roots' own."""
        ones = np.flatnonzero(self.bits)
        return ones - np.arange(len(ones)) - 1

    def degrees(self) -> np.ndarray:
        return np.diff(np.flatnonzero(~self.bits)) - 1

    def rolled_up(self, values: np.ndarray) -> np.ndarray:
        """Sums over subtrees of values given breadth first."""
        out, up = values.copy(), self.parents()
        for i in range(len(self.levels) - 2, 0, -1):
            own = slice(self.levels[i], self.levels[i + 1])
            np.add.at(out, up[own], out[own])
        return out


def ints(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def trees(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.Table]:
    """Rows sorted by ``shard`` as tables of whole shards, of at least so many rows where there are more."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        if held.num_rows >= least:
            shards = ints(held["shard"])
            cut = int(np.searchsorted(shards, shards[-1]))
            if cut:
                yield held.slice(0, cut)
                held = held.slice(cut)
    if held is not None and held.num_rows:
        yield held


def summed(nodes: DataFrame) -> DataFrame:
    """``nodes`` (shard, conv_id, depth, a, pa, n_convs, n_bytes, own_leaves, own_saved, own_children) sorted by shard and depth
    within partitions, with n_children, n_leaves, saved_tokens, parent_conv_id (null: a root) and top, whether it is a root."""
    kind = nodes.schema["conv_id"].dataType
    added = [T.StructField(c, T.LongType()) for c in ("n_children", "n_leaves", "saved_tokens")]
    schema = T.StructType([*nodes.schema.fields, *added, T.StructField("parent_conv_id", kind), T.StructField("top", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in trees(batches, SHARD):
            table = table.combine_chunks()
            col = {c: ints(table[c]) for c in ("shard", "depth", "a", "pa", "n_convs", "n_bytes", "own_leaves", "own_saved", "own_children")}
            forest = Forest(col["shard"], col["depth"], col["a"], col["pa"])
            own = {c: v[forest.order] for c, v in col.items()}
            up, children = forest.parents(), forest.degrees() + own["own_children"]
            leaves = forest.rolled_up(np.where(children == 0, 1, own["own_leaves"]))
            saved = forest.rolled_up((own["n_convs"] - 1) * own["n_bytes"] + own["own_saved"])
            table = table.take(pa.array(forest.order))
            above = pc.take(table["conv_id"].combine_chunks(), pa.array(up, mask=up < 0))
            columns = [*table.columns, pa.array(children, pa.int64()), pa.array(leaves, pa.int64()), pa.array(saved, pa.int64()), above, pa.array(up < 0)]
            yield from pa.Table.from_arrays(columns, schema.fieldNames()).to_batches(max_chunksize=1 << 16)

    return nodes.mapInArrow(run, schema)


def paths(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, depth, mark, n_bytes, length) with the names of their nodes (a, b) and of the parents (pa, pb)."""
    rows = turns.withColumns({"x": F.xxhash64("depth", "mark"), "y": F.xxhash64("mark", "depth"), "block": F.floor((F.col("depth") - 1) / BLOCK)})
    block = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({"a": F.bit_xor("x").over(block), "b": F.bit_xor("y").over(block)})
    # What the blocks before have; only conversations of more than a block have such.
    sums = turns.where(F.col("length") > BLOCK).groupBy("conv_id", F.floor((F.col("depth") - 1) / BLOCK).alias("block"))
    sums = sums.agg(F.bit_xor(F.xxhash64("depth", "mark")).alias("x0"), F.bit_xor(F.xxhash64("mark", "depth")).alias("y0"))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("conv_id", "block", F.bit_xor("x0").over(earlier).alias("x0"), F.bit_xor("y0").over(earlier).alias("y0")).where("block > 0")
    later = rows.where("block > 0").join(sums, ["conv_id", "block"])
    later = later.withColumns({"a": F.col("a").bitwiseXOR(F.col("x0")), "b": F.col("b").bitwiseXOR(F.col("y0"))}).drop("x0", "y0")
    rows = rows.where("block = 0").unionByName(later)
    return rows.select("conv_id", "depth", "length", "n_bytes", "a", "b", F.col("a").bitwiseXOR(F.col("x")).alias("pa"), F.col("b").bitwiseXOR(F.col("y")).alias("pb"))


def joined_ids(ends: DataFrame) -> DataFrame:
    """(a, b, ends_sha256) of ``ends`` (a, b, conv_id): the hash of a node's ids, ascending and joined by commas."""
    pieces = T.StructType([ends.schema["a"], ends.schema["b"], T.StructField("first", ends.schema["conv_id"].dataType), T.StructField("ids", T.StringType())])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = ints(batch.column(0)), ints(batch.column(1))
            begins = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, int)
            ids = batch.column(2).cast(pa.string()).to_pylist()
            made = [",".join(ids[i:j]) for i, j in zip(begins, [*begins[1:], len(ids)])]
            at = pa.array(begins)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), batch.column(2).take(at), pa.array(made, pa.string())], pieces.fieldNames())

    hashes = T.StructType([ends.schema["a"], ends.schema["b"], T.StructField("ends_sha256", T.StringType())])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            done = []
            for a, b, ids in zip(ints(batch.column(0)).tolist(), ints(batch.column(1)).tolist(), batch.column(3).to_pylist()):
                if (a, b) == node:
                    state.update(b"," + ids.encode())
                    continue
                if node:
                    done.append((*node, state.hexdigest()))
                node, state = (a, b), hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_pylist([dict(zip(hashes.fieldNames(), r)) for r in done], schema=pa.schema([(f.name, arrow_type(f.dataType)) for f in hashes]))
        if node:
            yield pa.RecordBatch.from_pylist([dict(zip(hashes.fieldNames(), (*node, state.hexdigest())))])

    by_range = ends.select("a", "b", "conv_id").repartitionByRange("a", "b", "conv_id").sortWithinPartitions("a", "b", "conv_id").mapInArrow(join, pieces)
    return by_range.repartition("a", "b").sortWithinPartitions("a", "b", "first").mapInArrow(digest, hashes)


def shards_of(steps: DataFrame, heavy: DataFrame) -> DataFrame:
    """(conv_id, shard): the name of the first node on a conversation's path that is not heavy."""
    deepest = heavy.agg(F.max("depth")).first()[0] or 0
    near = steps.where(F.col("depth") <= deepest + 1)
    if not deepest:
        return near.select("conv_id", F.col("a").alias("shard"))
    node = F.struct("a", "b").alias("node")
    on_path = join_split(near.select("conv_id", "depth", node), heavy.select(node, F.col("n_convs").alias("n")), "node")
    last = on_path.groupBy("conv_id").agg(F.max("depth").alias("last"))
    return near.join(last, "conv_id", "left").where(F.col("depth") == F.coalesce("last", F.lit(0)) + 1).select("conv_id", F.col("a").alias("shard"))


def prefix_trie(turns: DataFrame, convs: DataFrame, shard: int = SHARD, upper: int = UPPER) -> DataFrame:
    """All nodes of the trie of ``convs`` (conv_id, length) with ``turns`` (conv_id, depth from 1, mark, n_bytes, length).

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, and the
    node's name a, b and its parent's pa, pb.
    """
    steps = materialize(paths(turns), "steps")
    ends = F.col("length") == F.col("depth")
    nodes = steps.groupBy("a", "b").agg(
        F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.min("pa").alias("pa"), F.min("pb").alias("pb"), F.min("n_bytes").alias("n_bytes"),
        F.count("*").alias("n_convs"), F.sum(ends.cast("long")).alias("n_ends"), F.min(F.when(ends, F.col("conv_id"))).alias("end_id"), F.sum(F.col("length") - F.col("depth") + 1).alias("weight"),
    )
    nodes = materialize(nodes, "nodes")
    # The smallest bound for which there are few heavy nodes.
    bounds = [shard << i for i in range(0, 44, 2)]
    counted = nodes.where("n_convs > 1").agg(*(F.sum((F.col("weight") > b).cast("long")) for b in bounds)).first()
    bound = next((b for b, n in zip(bounds, counted) if (n or 0) < upper), bounds[-1])
    is_heavy = (F.col("n_convs") > 1) & (F.col("weight") > bound)
    heavy = nodes.where(is_heavy)

    fields = ["conv_id", "depth", "a", "b", "pa", "pb", "n_bytes", "n_convs", "n_ends", "end_id"]
    single = nodes.where("n_convs = 1").select(*fields)
    tops = single.groupBy("conv_id").agg(F.min(F.struct(*fields[1:])).alias("t"), F.count("*").alias("n"))
    chain_tops = tops.select("conv_id", *(F.col(f"t.{c}").alias(c) for c in fields[1:]))
    own = {"own_leaves": F.lit(0).cast("long"), "own_saved": F.lit(0).cast("long"), "own_children": F.lit(0).cast("long")}
    # A chain is a leaf of the trie; its top node has a child all the same if the chain goes on.
    light = nodes.where(~is_heavy & (F.col("n_convs") > 1)).select(*fields).withColumns(own)
    chains = chain_tops.withColumns(own | {"own_leaves": F.lit(1).cast("long"), "own_children": (F.col("n_ends") == 0).cast("long")})
    placed = light.unionByName(chains).join(shards_of(steps, heavy), "conv_id")
    lower = materialize(summed(placed.repartition("shard").sortWithinPartitions("shard", "depth")), "lower")

    node = F.struct("a", "b").alias("node")
    stubs = lower.where("top").groupBy(F.struct(F.col("pa").alias("a"), F.col("pb").alias("b")).alias("node"))
    stubs = stubs.agg(F.sum("n_leaves").alias("own_leaves"), F.sum("saved_tokens").alias("own_saved"), F.count("*").alias("own_children"))
    zero = F.lit(0).cast("long")
    at_root = F.col("length") == 0
    root = convs.agg(
        F.min("conv_id").alias("conv_id"), zero.alias("depth"), zero.alias("a"), zero.alias("b"), zero.alias("pa"), zero.alias("pb"), zero.alias("n_bytes"), F.count("*").alias("n_convs"),
        F.sum(at_root.cast("long")).alias("n_ends"), F.min(F.when(at_root, F.col("conv_id"))).alias("end_id"),
    ).where("n_convs > 0")
    tall = root.unionByName(heavy.select(*fields)).join(stubs, F.struct("a", "b") == F.col("node"), "left").drop("node").fillna(0, list(own))
    tall = summed(tall.withColumn("shard", zero).coalesce(1).sortWithinPartitions("depth"))
    tall = materialize(tall, "upper")
    # The parents of the shards' roots are upper nodes.
    parents = tall.select(F.struct("a", "b").alias("up"), F.col("own_children").alias("n"), F.col("conv_id").alias("up_conv"))
    roots = join_split(lower.where("top").withColumn("up", F.struct(F.col("pa").alias("a"), F.col("pb").alias("b"))), parents, "up")
    roots = roots.withColumn("parent_conv_id", F.col("up_conv")).drop("up", "up_conv")
    tops = tops.select("conv_id", "n", F.col("t.depth").alias("top_depth"))
    rest = join_split(single, tops, "conv_id").where("depth > top_depth").select(*fields, F.col("conv_id").alias("parent_conv_id"))
    rest = rest.withColumns({"n_children": (F.col("n_ends") == 0).cast("long"), "n_leaves": F.lit(1).cast("long"), "saved_tokens": zero})
    out = [*rest.columns]
    found = lower.where("not top").select(*out).unionByName(roots.select(*out)).unionByName(tall.select(*out)).unionByName(rest)

    few = found.where("n_ends < 2").withColumn("ends_sha256", F.when(F.col("n_ends") == 0, F.lit(NONE)).otherwise(F.sha2(F.col("end_id").cast("string"), 256)))
    last = steps.where(ends).select(node, "conv_id").unionByName(convs.where(at_root).select(F.struct(zero.alias("a"), zero.alias("b")).alias("node"), "conv_id"))
    several = nodes.select("a", "b", "n_ends").unionByName(root.select("a", "b", "n_ends")).where("n_ends > 1")
    last = join_split(last, several.select(node, F.col("n_ends").alias("n")), "node").select("node.a", "node.b", "conv_id")
    many = found.where("n_ends > 1").join(joined_ids(last), ["a", "b"])
    result = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "a", "b", "pa", "pb"]
    return few.select(*result).unionByName(many.select(*result))


def turn_mark(role: Column, text: Column) -> Column:
    return F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))


def hashed_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, mark, n_bytes, depth) of every turn of conversations (conv_id, turn, role, text), without the texts."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where("conv_id is not null").select("conv_id", "turn", turn_mark(role, text).alias("mark"), F.octet_length(text).cast("long").alias("n_bytes"))
    return numbered(rows, "conv_id", [F.col("turn").asc_nulls_first(), F.col("mark")], "depth")


def conversation_trie(conversations: DataFrame, **bounds: int) -> DataFrame:
    """The nodes of the trie of ``conversations`` (conv_id, turn, role, text) as they are."""
    turns = hashed_turns(conversations)
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("length"))
    long = join_split(turns, convs.withColumn("n", F.col("length")), "conv_id")
    return prefix_trie(long.select("conv_id", "depth", "mark", "n_bytes", "length"), convs, **bounds)


def rebuilt(conversations: DataFrame, group: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Turns and conversations as ``prefix_trie`` takes them: conversation c begins with the first turns of conversation
    c - c % group, as many as the crc32 of its decimal id says modulo ``most``, and goes on with its own turns after as many."""
    turns = hashed_turns(conversations)
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    convs = convs.withColumns({"base": F.col("conv_id") - F.col("conv_id") % group, "h": F.crc32(F.col("conv_id").cast("string")) % most})
    convs = convs.join(convs.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n")), "base", "left")
    convs = convs.withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0))))
    convs = materialize(convs.withColumn("length", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "conversations")
    begin = turns.where(F.col("depth") < most).select(F.col("conv_id").alias("base"), "depth", "mark", "n_bytes")
    begin = convs.where("taken > 0").select("conv_id", "base", "taken", "length").join(begin, "base").where("depth <= taken")
    own = join_split(turns, convs.select("conv_id", "n", "h", "taken", "length"), "conv_id").where("depth > h").withColumn("depth", F.col("depth") - F.col("h") + F.col("taken"))
    out = ["conv_id", "depth", "mark", "n_bytes", "length"]
    return begin.select(*out).unionByName(own.select(*out)), convs.select("conv_id", "length")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the trie of all rebuilt conversations."""
    turns, convs = rebuilt(read(spark, sf_dir, "conversations"))
    return prefix_trie(turns, convs).drop("a", "b", "pa", "pb")


OP11_SQL = """WITH tab AS (SELECT list(v ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v FROM range(256) r(i))),
t AS (SELECT conv_id, strlen(coalesce(text, '')) AS bytes, mark, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, mark) AS place FROM
 (SELECT *, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS mark FROM conversations WHERE conv_id IS NOT NULL)),
c AS (SELECT conv_id, n, conv_id - conv_id % 5 AS base,
 xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda s, b: xor(s // 256, tab[CAST(xor(s % 256, b) AS BIGINT) + 1])), 4294967295) % 9 AS h
 FROM (SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id), tab),
r AS (SELECT c.conv_id, place AS depth, mark, bytes FROM c JOIN t ON t.conv_id = c.base AND place <= h
 UNION ALL SELECT c.conv_id, least(c.h, coalesce(b.n, 0)) + place - c.h, mark, bytes FROM c JOIN t ON t.conv_id = c.conv_id AND place > c.h LEFT JOIN c b ON b.conv_id = c.base),
s AS (SELECT c.conv_id, coalesce(list(mark ORDER BY depth) FILTER (mark IS NOT NULL), []) AS marks, list(bytes ORDER BY depth) AS bytes FROM c LEFT JOIN r USING (conv_id) GROUP BY c.conv_id),
p AS (SELECT conv_id, d, array_to_string(marks[1:d], ',') AS node, CASE WHEN d > 0 THEN array_to_string(marks[1:d - 1], ',') END AS parent, CASE WHEN d > 0 THEN bytes[d] ELSE 0 END AS own, d = len(marks) AS ends
 FROM (SELECT *, unnest(range(len(marks) + 1)) AS d FROM s)),
n AS (SELECT node, any_value(parent) AS parent, min(conv_id) AS conv_id, any_value(d) AS depth, count(*) AS n_convs, any_value(own) AS own,
 sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM p GROUP BY node),
k AS (SELECT parent AS node, count(*) AS n_children FROM n WHERE parent IS NOT NULL GROUP BY parent),
w AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (node)),
u AS (SELECT DISTINCT x.node AS top, y.node FROM p x JOIN p y ON x.conv_id = y.conv_id AND x.d <= y.d),
v AS (SELECT top AS node, count(*) FILTER (n_children = 0) AS n_leaves, CAST(sum((n_convs - 1) * own) AS BIGINT) AS saved_tokens FROM u JOIN w USING (node) GROUP BY top)
SELECT w.conv_id, CAST(w.depth AS BIGINT) AS depth, q.conv_id AS parent_conv_id, w.n_convs, w.n_children, n_leaves, saved_tokens, w.ends_sha256 FROM w JOIN v USING (node) LEFT JOIN n q ON q.node = w.parent"""
