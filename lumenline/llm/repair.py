"""Repair of conversations' structure at the least cost, by rank-compressed dynamic programming.

The roles of a repaired conversation begin with s (system), u (user) or a (assistant), in the form (s?(ua)+)? . A turn may be kept (K, 0),
get the role user or assistant (R, 3) or be deleted (D, 4); an empty user or assistant turn may be inserted anywhere (I, 3).
Blank turns and duplicates must go; a truncated turn that stays adds 3. Of cheapest repairs the one whose edits, as a
string, come first in ASCII is taken.

What happens between two turns and to the second of them is one macro edit: up to two insertions, then K, R or D. (A third
insertion never pays: two of them lead back to the same state.) The nine codes are prefix-free and numbered in ASCII order, so
strings of equally many macros compare as their sequences of numbers. Each layer of the program, one turn, therefore holds for
each of the four states a cost, the rank of its string among the four, and a pointer to the state and code it
came from, instead of strings: cost, rank and code in one integer are added and compared at once for all conversations of a task.
Strings are put together from the pointers afterwards.

A conversation is cut into blocks of ``BLOCK`` turns that are solved apart, from every state they might begin in; the
blocks' costs and ranks are then combined, block after block, as turns are within one. So neither the program nor the search for
duplicates needs a conversation in one task. Only the texts go through one task in order, as a stream.

Null roles and texts count as one space. Rows without conv_id belong to no conversation and are left out. Turns come by number,
null first, equal ones by the md5 of role and text. An empty text is blank; texts may be of any length.
Repeated rows are duplicates. A conversation whose turns all go is empty, which is well formed. An empty table gives an
empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import schema as ddl_schema
from .common import arrow_type, join_split, materialize, read
from .turns import group_starts, numbered, whole_groups

BLOCK = 4096
#: Rows that a task solves at once.
ROWS = 1 << 16
WHITE = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: States: nothing yet, after s, after u, after a. The last letter of the roles so far.
STATES = ("", "s", "u", "a")
CODES = ("D", "ID", "IID", "IIK", "IIR", "IK", "IR", "K", "R")
#: The role that has to follow, and those that may be kept.
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}
KEPT = {"": "su", "s": "u", "u": "a", "a": "u"}
ROLES = {"u": "user", "a": "assistant"}
#: What it takes to end well from each state.
TAILS = ("", "II", "I", "")
FAR = np.int64(1) << 50


def inserted(state: str, times: int) -> str:
    for _ in range(times):
        state = NEXT[state]
    return state


def weights() -> np.ndarray:
    """[class, from, to]: cost << 8 | code of the cheapest macro, the first in ASCII among equals.

    Classes: 0 must be deleted, 1 + 2 * (initial: other, s, u, a) + truncated.
    """
    out = np.full((9, 4, 4), FAR << 8, np.int64)
    for kind in range(9):
        initial, truncated = ("", *"sua")[(kind - 1) // 2] if kind else "", bool(kind) and kind % 2 == 0
        for i, state in enumerate(STATES):
            for code, macro in enumerate(CODES):
                at, edit = inserted(state, len(macro) - 1), macro[-1]
                cost = INSERT * (len(macro) - 1)
                if edit == "D":
                    cost, end = cost + DELETE, at
                elif not kind or (edit == "K" and (not initial or initial not in KEPT[at])):
                    continue
                else:
                    end = initial if edit == "K" else NEXT[at]
                    cost += (KEEP if edit == "K" else REROLE) + TRUNCATED * truncated
                j = STATES.index(end)
                out[kind, i, j] = min(out[kind, i, j], cost << 8 | code)
    return out


WEIGHTS = weights()


def next_layer(keys: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """New keys (cost << 8 | rank << 4) of the four states, and where each came from (state << 4 | code).

    ``keys`` [n, from], ``step`` [n, from, to].
    """
    found = keys[:, :, None] + step
    came = found.argmin(axis=1)
    best = np.take_along_axis(found, came[:, None, :], axis=1)[:, 0, :]
    cost, text = best >> 8, best & 255
    rank = np.where(cost >= FAR, 256, text).argsort(axis=1, kind="stable").argsort(axis=1, kind="stable")
    return np.minimum(cost, FAR) << 8 | rank << 4, (came << 4 | text & 15).astype(np.uint8)


def solve(kinds: np.ndarray, begins: np.ndarray, sizes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """(final keys [n, 4], pointers by layer, order) of stretches of ``kinds`` from the states ``starts``; longest first in ``order``."""
    order = np.argsort(-sizes, kind="stable")
    at, left = begins[order], sizes[order]
    keys = np.full((len(order), 4), FAR << 8, np.int64)
    keys[np.arange(len(order)), starts[order]] = 0
    pointers = []
    for i in range(int(left[0]) if len(left) else 0):
        n = int(np.searchsorted(-left, -i, "left"))  # stretches longer than i
        keys[:n], came = next_layer(keys[:n], WEIGHTS[kinds[at[:n] + i]])
        pointers.append(came)
    return keys, pointers, order


def codes_back(pointers: list[np.ndarray], which: np.ndarray, ends: np.ndarray, sizes: np.ndarray) -> list[str]:
    """The edits of stretches ``which`` (places in the solver's order) that end in states ``ends``."""
    offsets = np.r_[0, np.cumsum(sizes)]
    flat = np.zeros(int(offsets[-1]), np.uint8)
    state = ends.copy()
    for i in range(int(sizes.max(initial=0)) - 1, -1, -1):
        live = np.flatnonzero(sizes > i)
        came = pointers[i][which[live], state[live]]
        flat[offsets[live] + i] = came & 15
        state[live] = came >> 4
    names = np.array(CODES, object)[flat].tolist()
    return ["".join(names[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]


def last_sign(text: Column) -> Column:
    """The last character that is not white space; empty if there is none."""
    return F.right(F.rtrim(text, F.lit(WHITE)), F.lit(1))


def turn_rows(turns: DataFrame) -> DataFrame:
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    rows = turns.where("conv_id is not null").select("conv_id", "turn", role.alias("role"), text.alias("text"))
    return rows.withColumn("mark", F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))


def in_order() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("mark")]


PIECE = "block long, start int, end int, cost long, rank int, done boolean, edits string, faults string"


def pieces(rows: DataFrame) -> DataFrame:
    """(conv_id, block, start, end, cost, rank, done, edits, faults): repairs of blocks. Those of conversations of one block are done;
    others have a row for each state to begin in and each to end in. Faults: a letter for each turn, b, d, t or a space."""
    sign = last_sign(F.col("text"))
    thin = rows.select("conv_id", "turn", "mark", F.left("role", F.lit(1)).alias("initial"), (sign == "").alias("blank"), (~sign.isin(".", "!", "?")).alias("open"))
    thin = numbered(thin, "conv_id", in_order(), "place")
    block = F.floor((F.col("place") - 1) / BLOCK).alias("block")
    key = F.struct("conv_id", "mark").alias("key")
    first = thin.groupBy("conv_id", "mark").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1").select(key, "first", "n")
    later = join_split(thin.select(key, "conv_id", "place"), first, "key").where("place > first")
    code = F.when(F.col("blank"), 0).otherwise(1 + 2 * F.greatest(F.instr(F.lit("sua"), F.col("initial")) * (F.length("initial") > 0).cast("int"), F.lit(0)) + F.col("open").cast("int"))
    flags = thin.select("conv_id", block, "place", F.lit(False).alias("again"), code.alias("kind"), "blank").unionByName(
        later.select("conv_id", block, "place", F.lit(True).alias("again"), F.lit(0).alias("kind"), F.lit(False).alias("blank"))
    )
    schema = ddl_schema(f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, {PIECE}")
    names = schema.fieldNames()
    kinds = [arrow_type(f.dataType) for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, _ in whole_groups(batches, ["conv_id", "block"], ROWS):
            again = table["again"].to_numpy()
            repeated = np.r_[again[1:], False][~again]  # a mark follows the turn it is about
            table = table.filter(pa.array(~again)).combine_chunks()
            begins = group_starts(table, ["conv_id", "block"])
            blank, kind = table["blank"].to_numpy(), table["kind"].to_numpy().astype(np.int64)
            repeated &= ~blank
            faults = np.full(len(kind), ord(" "), np.uint8)
            faults[(kind > 0) & (kind % 2 == 0)] = ord("t")
            faults[repeated], faults[blank] = ord("d"), ord("b")
            kind[repeated] = 0
            sizes = np.diff(np.r_[begins, len(kind)])
            blocks = table["block"].to_numpy()[begins]
            done = (blocks == 0) & (sizes < BLOCK)
            group, start = np.concatenate([np.arange(len(begins)), np.repeat(np.flatnonzero(blocks > 0), 3)]), np.concatenate([np.zeros(len(begins), int), np.tile([1, 2, 3], int((blocks > 0).sum()))])
            keys, pointers, order = solve(kind, begins[group], sizes[group], start)
            group, start = group[order], start[order]
            cost, rank = keys >> 8, keys >> 4 & 15
            ended = (cost + INSERT * np.array([len(t) for t in TAILS])) << 4 | rank
            last = ended.argmin(axis=1)
            own = np.flatnonzero(done[group])
            many = np.argwhere(~done[group][:, None] & (cost < FAR))
            which, end = np.r_[own, many[:, 0]], np.r_[last[own], many[:, 1]]
            edits = codes_back(pointers, which, end, sizes[group[which]])
            finished = done[group[which]]
            edits = [e + TAILS[s] if f else e for e, s, f in zip(edits, end, finished)]
            total = np.where(finished, ended[which, end] >> 4, cost[which, end])
            letters = [faults[begins[g] : begins[g] + sizes[g]].tobytes().decode() for g in group[which]]
            columns = [blocks[group[which]], start[which], end, total, rank[which, end], finished, edits, letters]
            ids = table["conv_id"].combine_chunks().take(pa.array(begins[group[which]]))
            yield from pa.Table.from_arrays([ids, *(pa.array(c, type=k) for c, k in zip(columns, kinds[1:]))], names).to_batches(max_chunksize=1 << 14)

    return flags.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "place", "again").mapInArrow(run, schema)


def chosen(parts: DataFrame) -> DataFrame:
    """(conv_id, block, start, end, total, tail): the pieces that make up the cheapest repair of each conversation of several blocks."""
    schema = ddl_schema(f"conv_id {parts.schema['conv_id'].dataType.simpleString()}, block long, start int, end int, total long, tail string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, begins in whole_groups(batches, ["conv_id"], 1):
            for a, b in zip(begins, [*begins[1:], table.num_rows]):
                own = table.slice(a, b - a)
                block, start, end, cost, rank = (own[c].to_numpy().astype(np.int64) for c in ("block", "start", "end", "cost", "rank"))
                n = int(block[-1]) + 1
                step = np.full((n, 4, 4), FAR << 8, np.int64)
                step[block, start, end] = cost << 8 | rank
                keys, came = np.array([[0, *[FAR << 8] * 3]], np.int64), []
                for s in step:
                    keys, back = next_layer(keys, s[None])
                    came.append(back[0] >> 4)
                ended = (keys[0] >> 8) + INSERT * np.array([len(t) for t in TAILS]) << 4 | keys[0] >> 4 & 15
                at = int(ended.argmin())
                rows = []
                for i in range(n - 1, -1, -1):
                    final = i == n - 1
                    rows.append((i, int(came[i][at]), at, int(ended[at] >> 4) if final else 0, TAILS[at] if final else ""))
                    at = int(came[i][at])
                ids = own["conv_id"].combine_chunks().take(pa.array([0] * n))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, type=arrow_type(f.dataType)) for c, f in zip(zip(*rows), schema.fields[1:]))], schema.fieldNames())

    thin = parts.select("conv_id", "block", "start", "end", "cost", "rank").repartition("conv_id").sortWithinPartitions("conv_id", "block", "start", "end")
    return thin.mapInArrow(run, schema)


EDITS = "step long, edit string, turn long, role_before string, role string, text string, fault string, cost long"


def repaired(turns: DataFrame) -> DataFrame:
    """The edits of ``turns`` (conv_id, turn, role, text), one row each: conv_id, step (from 0), edit (K, R, D or I), turn and role_before
    (null where inserted), role (null where deleted), text, fault (blank, duplicate, truncated or null) and cost.

    What is left of a conversation are the rows with a role, by step. A conversation's rows stand together and in order.
    """
    rows = turn_rows(turns)
    found = materialize(pieces(rows), "pieces")
    parts = found.where("not done")
    several = parts.join(chosen(parts), ["conv_id", "block", "start", "end"]).select("conv_id", "block", F.concat("edits", "tail").alias("edits"), "faults")
    plan = found.where("done").select("conv_id", "block", "edits", "faults").unionByName(several)
    plan = plan.select("conv_id", F.lit(0).alias("kind"), "block", F.lit(None).cast("long").alias("turn"), F.lit("").alias("mark"), F.col("edits").alias("role"), F.col("faults").alias("text"))
    texts = rows.select("conv_id", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("block"), F.col("turn").cast("long").alias("turn"), "mark", "role", "text")
    both = plan.unionByName(texts).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "block", *in_order())
    schema = ddl_schema(f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, {EDITS}")
    fault_names = {"b": "blank", "d": "duplicate", "t": "truncated"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, edits, faults, at, n, state = None, "", "", 0, 0, ""
        for batch in batches:
            out: list[tuple] = []
            for conv, kind, turn, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 5, 6))):
                if conv != now:
                    now, edits, faults, at, n, state = conv, "", "", 0, 0, ""
                if not kind:
                    edits, faults = edits + role, faults + text
                    continue
                while True:
                    edit = edits[at]
                    if edit == "I":
                        state = NEXT[state]
                        out.append((conv, at, "I", None, None, ROLES[state], "", None, INSERT))
                        at += 1
                        continue
                    break
                fault = faults[n]
                if edit == "D":
                    new, cost = None, DELETE
                else:
                    state = role[0] if edit == "K" else NEXT[state]
                    new, cost = role if edit == "K" else ROLES[state], (KEEP if edit == "K" else REROLE) + TRUNCATED * (fault == "t")
                out.append((conv, at, edit, turn, role, new, text, fault_names.get(fault), cost))
                at, n = at + 1, n + 1
                if n == len(faults):
                    for edit in edits[at:]:
                        state = NEXT[state]
                        out.append((conv, at, "I", None, None, ROLES[state], "", None, INSERT))
                        at += 1
            columns = list(zip(*out)) or [[]] * len(schema.fields)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=arrow_type(f.dataType)) for c, f in zip(columns, schema)], schema.fieldNames())

    return both.mapInArrow(run, schema)


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with faults put in by the crc32 of ``conv_id:turn`` modulo 20, and whether a row is left at all."""
    name = F.concat(F.col("conv_id").cast("string"), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = conversations.where("conv_id is not null").select("conv_id", "turn", *(F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")), (F.crc32(name) % 20).alias("way"))
    text = F.when(F.col("way") == 1, "").when(F.col("way") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.withColumns({"text": text, "role": F.when(F.col("way") == 4, "user").otherwise(F.col("role"))})
    copies = F.when(F.col("way") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.withColumn("copy", F.explode(copies)).drop("copy")


DIGEST = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
NOTHING = hashlib.sha256(b"").hexdigest()


def digests(edits: DataFrame) -> DataFrame:
    """A row for each conversation of ``repaired``: its gaps, faults, illegal neighbours, cost, edits and the hash of what is left."""
    schema = ddl_schema(f"conv_id {edits.schema['conv_id'].dataType.simpleString()}, {DIGEST}")
    legal = {"su", "ua", "au"}

    class Sum:
        def __init__(self, conv):
            self.conv, self.low, self.high, self.turns, self.before, self.counts = conv, None, None, 0, None, {"blank": 0, "duplicate": 0, "truncated": 0}
            self.illegal, self.cost, self.audit, self.state, self.some = 0, 0, [], hashlib.sha256(), False

        def row(self) -> tuple:
            gaps = self.high - self.low + 1 - self.turns if self.turns else 0
            return (self.conv, gaps, *self.counts.values(), self.illegal, self.cost, "".join(self.audit), self.state.hexdigest())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows)) or [[]] * len(schema.fields)
            return pa.RecordBatch.from_arrays([pa.array(c, type=arrow_type(f.dataType)) for c, f in zip(columns, schema)], schema.fieldNames())

        own = None
        for batch in batches:
            rows = []
            for conv, _, edit, turn, was, role, text, fault, cost in zip(*(c.to_pylist() for c in batch.columns)):
                if own is None or conv != own.conv:
                    if own:
                        rows.append(own.row())
                    own = Sum(conv)
                own.audit.append(edit)
                own.cost += cost
                if fault:
                    own.counts[fault] += 1
                if edit != "I":
                    if turn is not None:
                        own.turns += turn != own.high
                        own.low, own.high = turn if own.low is None else own.low, turn
                    if own.before is not None and own.before + was[:1] not in legal:
                        own.illegal += 1
                    own.before = was[:1]
                if role is not None:
                    own.state.update(("\n" * own.some + role + ":" + text).encode())
                    own.some = True
            yield made(rows)
        if own:
            yield made([own.row()])

    return edits.mapInArrow(run, schema)


def op13_rank_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations after damage, repaired; those that lost all rows have zeros."""
    rows = damaged(read(spark, sf_dir, "conversations"))
    found = digests(repaired(rows.where("way <> 0")))
    gone = rows.groupBy("conv_id").agg(F.sum((F.col("way") != 0).cast("long")).alias("n")).where("n = 0")
    zeros = {c: F.lit(0).cast("long") for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    return found.unionByName(gone.select("conv_id", *(c.alias(n) for n, c in zeros.items()), F.lit("").alias("audit"), F.lit(NOTHING).alias("repaired_sha256")))


OP13_SQL = """WITH RECURSIVE tab AS (SELECT list(v ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v FROM range(256) r(i))),
w AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
 xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda s, b: xor(s // 256, tab[CAST(xor(s % 256, b) AS BIGINT) + 1])), 4294967295) % 20 AS way
 FROM conversations, tab WHERE conv_id IS NOT NULL),
d AS (SELECT conv_id, turn, CASE WHEN way = 4 THEN 'user' ELSE role END AS role, CASE way WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN way = 3 THEN [0, 1] ELSE [0] END) AS c FROM w WHERE way <> 0),
m AS (SELECT *, md5(length(role) || ':' || role || text) AS mark, right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS sign FROM d),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, mark) AS place FROM m),
f AS (SELECT *, left(role, 1) AS ini, CASE WHEN sign = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, mark ORDER BY place) > 1 THEN 'duplicate' WHEN sign NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM o),
ins(q, k, t, made) AS (VALUES ('', 0, '', CAST([] AS VARCHAR[])), ('', 1, 'u', ['user:']), ('', 2, 'a', ['user:', 'assistant:']), ('s', 0, 's', []), ('s', 1, 'u', ['user:']), ('s', 2, 'a', ['user:', 'assistant:']),
 ('u', 0, 'u', []), ('u', 1, 'a', ['assistant:']), ('u', 2, 'u', ['assistant:', 'user:']), ('a', 0, 'a', []), ('a', 1, 'u', ['user:']), ('a', 2, 'a', ['user:', 'assistant:'])),
keep(t, ini) AS (VALUES ('', 's'), ('', 'u'), ('s', 'u'), ('u', 'a'), ('a', 'u')),
mv AS (SELECT q, k, made, t, 'D' AS e, t AS q2, NULL AS ini, 3 * k + 4 AS c FROM ins UNION ALL SELECT q, k, made, i.t, 'K', ini, ini, 3 * k FROM ins i JOIN keep USING (t)
 UNION ALL SELECT q, k, made, t, 'R', CASE t WHEN 'u' THEN 'a' ELSE 'u' END, NULL, 3 * k + 3 FROM ins),
dp(conv_id, place, q, best) AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT), '', {'c': 0, 'a': '', 'o': CAST([] AS VARCHAR[])} FROM f
 UNION ALL SELECT dp.conv_id, f.place, mv.q2, min({'c': CAST(best.c + mv.c + CASE WHEN e <> 'D' AND fault = 'truncated' THEN 3 ELSE 0 END AS INTEGER), 'a': best.a || repeat('I', k) || e,
  'o': list_concat(best.o, list_concat(made, CASE e WHEN 'D' THEN [] WHEN 'K' THEN [role || ':' || text] ELSE [CASE q2 WHEN 'u' THEN 'user:' ELSE 'assistant:' END || text] END))})
 FROM dp JOIN f ON f.conv_id = dp.conv_id AND f.place = dp.place + 1 JOIN mv ON mv.q = dp.q AND (mv.e = 'D' OR (fault IN ('', 'truncated') AND (mv.e = 'R' OR mv.ini = f.ini))) GROUP BY dp.conv_id, f.place, mv.q2),
z AS (SELECT conv_id, min({'c': best.c + 3 * k, 'a': best.a || repeat('I', k), 'o': list_concat(best.o, made)}) AS best FROM dp JOIN ins USING (q) JOIN (SELECT conv_id, max(place) AS place FROM f GROUP BY conv_id) n USING (conv_id, place)
 WHERE t = 'a' OR (t = '' AND k = 0) GROUP BY conv_id),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
 count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM (SELECT *, lag(ini) OVER (PARTITION BY conv_id ORDER BY place) || ini AS pair FROM f) GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
 CAST(coalesce(best.c, 0) AS BIGINT) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(array_to_string(best.o, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL) c LEFT JOIN g USING (conv_id) LEFT JOIN z USING (conv_id)"""
