"""Exact token counts of every prefix of a text, by dynamic programming over word pieces.

A text is cut as the vocabulary's file says: special strings, canonical composition, lower case, then units (runs of
letters, single digits, runs of other signs, contractions). Within a unit the tokens of a prefix are those of a shorter
prefix and one more: the last token is the only vocabulary entry ending there that no merge could tie to the token before
it. So one pass over a unit gives the count at each of its prefixes, without encoding any of them, and the counts of a text
are running sums over units. The counts are stored as a step for each character (one byte; a step can be negative, as
"hel" may take more tokens than "hello") and a total for each ``ANCHOR`` characters. How many tokens a prefix has, and where a
text has to be cut to keep within a budget, is answered from the store alone.

A row gives a row and nothing is shuffled. A text that is null counts as empty; an empty text has no tokens; a text of any
length is counted whole, in time linear in it (a unit's last tokens are found among entries of at most the vocabulary's longest), but for
characters that compose with the ones before them, each of which recounts its unit. Characters that the running Python's
Unicode version doesn't assign are taken as they are. Repeated rows are counted one by one, an empty table gives an
empty result, other columns stay, and one that has the store's name is replaced.
"""

from __future__ import annotations

import json
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache
from operator import sub

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_type, read

ANCHOR = 1024
STORE = "struct<n_tokens:bigint,steps:binary,anchors:array<bigint>>"
#: Units whose steps a worker keeps; those longer than LONG characters are counted anew each time.
KEPT, LONG = 1 << 18, 64
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
NEVER = float("inf")
#: White space in the sense of Unicode.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def byte_signs() -> dict[str, int]:
    """The signs that stand for bytes in byte-level vocabularies: printable Latin-1 for itself, others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=1)
def joins_backwards() -> frozenset[str]:
    """Characters that canonical composition may join to the one before."""
    second = set()
    for i in range(0x110000):
        parts = unicodedata.decomposition(chr(i))
        if parts and parts[0] != "<" and " " in parts:
            second.add(chr(int(parts.split(" ")[1], 16)))
    return frozenset(second | set(map(chr, [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)])))


def stands_alone(c: str) -> bool:
    first = unicodedata.normalize("NFD", c)[0]
    return not unicodedata.combining(first) and first not in joins_backwards()


def as_steps(totals: list[int]) -> bytes:
    """Differences of neighbouring counts, a signed byte each; a character changes a count by a few tokens at most."""
    return array("b", map(sub, totals[1:], totals)).tobytes()


def lowered(text: str) -> str:
    """Lower case of each character by itself, whatever follows it."""
    return text.replace("Σ", "σ").lower()


class Units(dict):
    """Steps of units, computed when first asked for. ``KEPT`` are kept, and as many that were asked for before those."""

    def __init__(self, make):
        self.make, self.older = make, {}

    def __missing__(self, unit: str) -> bytes:
        steps = self.older.pop(unit, None)
        if steps is None:
            steps = self.make(unit)
        if len(unit) <= LONG:
            if len(self) >= KEPT:
                self.older = dict(self)
                self.clear()
            self[unit] = steps
        return steps


class Neighbours(dict):
    """Whether one token may follow another, by both ids in one number; found out when first asked for."""

    def __init__(self, decide):
        self.decide = decide

    def __missing__(self, pair: int) -> bool:
        if len(self) >= 4 * KEPT:
            self.clear()
        found = self[pair] = self.decide(pair >> 20, pair & 0xFFFFF)
        return found


class PrefixCounter:
    """Counts of tokens by a tokenizer file that holds word pieces with an end-of-word mark."""

    def __init__(self, path: str):
        import ahocorasick

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, cut, suffix = spec["model"], spec["pre_tokenizer"].get("pretokenizers"), spec["model"].get("end_of_word_suffix")
        if (spec["normalizer"] or {}).get("normalizers") != NORMALIZERS or not suffix or model["byte_fallback"] or cut[0]["behavior"] != "Removed":
            raise ValueError("the vocabulary must be word pieces with an end-of-word mark, over composed lower-case text")
        inner = cut[0]["pattern"]["Regex"]
        self.pattern = regex.compile(inner)
        self.parts = regex.compile(rf"\s?(?:{inner})|\s+")
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        ids = model["vocab"]
        self.pairs: dict[tuple[int, int], int] = {}
        self.right: dict[int, list] = {}
        self.left: dict[int, list] = {}
        sound = {}
        merged = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            merged[ids[a + b]] = (ids[a], ids[b], rank)
            self.pairs[ids[a], ids[b]] = rank
        # A token's edge, from the whole to a single sign, and the merge that uses each of them up.
        for token, t in ids.items():
            if t not in merged:
                self.right[t] = self.left[t] = [(t, NEVER)]
                sound[t] = True
        for t, (a, b, rank) in merged.items():
            self.right[t] = [(t, NEVER), (b, rank), *self.right[b][1:]]
            self.left[t] = [(t, NEVER), (a, rank), *self.left[a][1:]]
            sound[t] = sound[a] and sound[b] and not self.tied([(a, rank), *self.right[a][1:]], [(b, rank), *self.left[b][1:]])
        signs = byte_signs()
        entries: dict[str, list[int]] = {}
        for token, t in ids.items():
            final = token.endswith(suffix) and len(token) > len(suffix)
            entry = token[: -len(suffix)] if final else token
            if sound[t] and all(c in signs for c in entry):
                entries.setdefault("".join(chr(signs[c]) for c in entry), [-1, -1])[final] = t
        self.entries = ahocorasick.Automaton()
        for entry, (plain, final) in entries.items():
            self.entries.add_word(entry, (len(entry), plain, final))
        self.entries.make_automaton()
        self.units = Units(self.unit_steps)
        self.follows = Neighbours(lambda a, b: not self.tied(self.right[a], self.left[b]))

    def tied(self, right: list, left: list) -> bool:
        """Whether a merge would have joined two neighbours before either had become what it is.

        Merges happen by rank, equal ones from the left: a merge across the border comes first if its rank is below that
        of the merge that uses up the left side, and not above that of the one that uses up the right side.
        """
        pairs = self.pairs
        for x, ends_x in right:
            for y, ends_y in left:
                rank = pairs.get((x, y))
                if rank is not None and rank < ends_x and rank <= ends_y:
                    return True
        return False

    def piece_counts(self, signs: str) -> list[int]:
        """The number of tokens of every prefix of a unit's bytes, each taken as a unit of its own."""
        n = len(signs) + 1
        last, count, out = [-1] * n, [0] * n, [0] * n
        follows = self.follows
        for end, (size, plain, final) in self.entries.iter(signs):
            end += 1
            begin = end - size
            before = last[begin] << 20
            if plain >= 0 and last[end] < 0 and (not begin or follows[before | plain]):
                last[end], count[end] = plain, count[begin] + 1
            if final >= 0 and not out[end] and (not begin or follows[before | final]):
                out[end] = count[begin] + 1
        return out

    def unit_steps(self, unit: str) -> bytes:
        """A step for each character of a unit of composed lower-case text and of the white space before it."""
        word = unit.lstrip(WHITE)
        if not word:
            return bytes(len(unit))
        if word[0] == "'" and len(word) > 1 and word[1].isalpha():  # a contraction; what it begins with is cut elsewhere
            totals = [0, *(self.total(word[:i]) for i in range(1, len(word))), self.piece_counts(word)[-1]]
        else:
            raw = word.encode()
            totals = self.piece_counts(raw.decode("latin-1"))
            if len(raw) > len(word):
                ends = [i for i, byte in enumerate(raw) if byte & 0xC0 != 0x80]
                totals = [totals[i] for i in (*ends, len(raw))]
        return bytes(len(unit) - len(word)) + as_steps(totals)

    def total(self, text: str) -> int:
        """The number of tokens of composed lower-case text."""
        return sum(int(np.frombuffer(self.units[u], np.int8).sum()) for u in self.pattern.findall(text))

    def steps(self, text: str) -> bytes:
        """The steps of the counts, one for each character of the text."""
        if self.special is None or not self.special.search(text):
            return self.plain_steps(text)[0]
        parts, at = [], 0
        for m in self.special.finditer(text):
            own, tail = self.plain_steps(text[at : m.start()])
            parts.append(own)
            # Inside, the special string is not one yet: its beginning is read on from the last unit before it.
            known = self.total(tail)
            inside = [self.total(tail + lowered(m.group()[:k])) - known for k in range(len(m.group()))]
            parts.append(as_steps([*inside, 1]))
            at = m.end()
        return b"".join([*parts, self.plain_steps(text[at:])[0]])

    def plain_steps(self, text: str) -> tuple[bytes, str]:
        """The steps of a text without special strings, and its last unit, composed and in lower case."""
        low = lowered(text)
        if len(low) == len(text) and unicodedata.is_normalized("NFC", text):
            units = self.parts.findall(low)
            return b"".join(map(self.units.__getitem__, units)), units[-1] if units else ""
        return self.composed_steps(text)

    def composed_steps(self, text: str) -> tuple[bytes, str]:
        """As ``plain_steps``, of a text whose characters are not those of its composed lower-case form."""
        begins = [i for i, c in enumerate(text) if i == 0 or c.isascii() or stands_alone(c)]
        forms = [lowered(unicodedata.normalize("NFC", text[a:b])) for a, b in zip(begins, [*begins[1:], len(text)])]
        whole = "".join(forms)
        units = self.parts.findall(whole)
        counts = np.r_[0, np.cumsum(np.frombuffer(b"".join(map(self.units.__getitem__, units)), np.int8), dtype=np.int64)]
        edges = np.r_[0, np.cumsum([len(u) for u in units], dtype=np.int64)]
        ends = np.cumsum([len(f) for f in forms])
        totals = np.empty(len(text) + 1, np.int64)
        totals[0] = 0
        totals[[*begins[1:], len(text)]] = counts[ends]
        for a, b, end, form in zip(begins, [*begins[1:], len(text)], ends, forms):
            if b - a > 1:
                start = end - len(form)
                edge = edges[max(np.searchsorted(edges, start - 2, "right") - 1, 0)]  # a contraction reads two characters on
                for k in range(a + 1, b):
                    totals[k] = counts[edge] + self.total(whole[edge:start] + lowered(unicodedata.normalize("NFC", text[a:k])))
        return as_steps(totals.tolist()), units[-1] if units else ""


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def word_vocabulary() -> str:
    """The public vocabulary of lower-case word pieces."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def with_prefix_counts(docs: DataFrame, name: str = "token_counts", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``docs`` with ``name``: the number of tokens, and the counts of all prefixes as steps and anchors."""
    kept = [c for c in docs.columns if c.lower() != name.lower()]
    frame = docs.select(F.struct(*kept).alias("row"), F.col(text).alias("text"))
    schema = docs.select(*kept, F.lit(None).cast(STORE).alias(name)).schema
    kind = arrow_type(schema[name].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary or word_vocabulary())
        for batch in batches:
            made = []
            for value in batch.column(1).to_pylist():
                steps = count.steps(value or "")
                sums = np.cumsum(np.frombuffer(steps, np.int8), dtype=np.int64)
                made.append({"n_tokens": int(sums[-1]) if len(sums) else 0, "steps": steps, "anchors": sums[ANCHOR - 1 :: ANCHOR]})
            yield pa.RecordBatch.from_arrays([*batch.column(0).flatten(), pa.array(made, type=kind)], schema.fieldNames())

    return frame.mapInArrow(run, schema)


def tokens_in_prefix(counts: Column | str, chars: Column | str) -> Column:
    """The number of tokens of a text's first ``chars`` characters, from its stored counts; all of them beyond its end."""

    @F.pandas_udf("long")
    def look_up(store: pd.DataFrame, at: pd.Series) -> pd.Series:
        out = []
        for steps, anchors, n in zip(store["steps"], store["anchors"], at):
            n = min(max(int(n), 0), len(steps))
            whole = n // ANCHOR
            out.append((int(anchors[whole - 1]) if whole else 0) + int(np.frombuffer(steps, np.int8)[whole * ANCHOR : n].sum()))
        return pd.Series(out, dtype="int64")

    return look_up(counts, F.coalesce(F.col(chars) if isinstance(chars, str) else chars, F.lit(0)))


def chars_within(counts: Column | str, budget: Column | int) -> Column:
    """The length of the longest prefix of at most ``budget`` tokens, from a text's stored counts; 0 for a budget below 0."""

    @F.pandas_udf("long")
    def look_up(store: pd.DataFrame, most: pd.Series) -> pd.Series:
        out = []
        for steps, n in zip(store["steps"], most):
            fits = np.flatnonzero(np.cumsum(np.frombuffer(steps, np.int8), dtype=np.int64) <= n)
            out.append(int(fits[-1]) + 1 if len(fits) else 0)
        return pd.Series(out, dtype="int64")

    return look_up(counts, F.coalesce(F.lit(budget), F.lit(0)).cast("long"))


def truncate(docs: DataFrame, budget: int, text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``docs`` with each text cut to its longest prefix of at most ``budget`` tokens; nulls stay null."""
    row = docs.select(F.struct(*docs.columns).alias("row"), F.col(text).alias("text"))
    most = chars_within("token_counts", budget).cast("int")
    cut = with_prefix_counts(row, vocabulary=vocabulary).select("row", F.substr("text", F.lit(1), most).alias("text"))
    return cut.select(*(F.col("text").alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns))


def op12_prefix_token_counts(spark: SparkSession, sf_dir: str, limit: int = 2048) -> DataFrame:
    """doc_id, bytes, tokens, and whether there are more than ``limit``: the count at each text's last prefix."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    n = F.col("token_counts.n_tokens")
    return with_prefix_counts(docs).select("doc_id", "n_bytes", n.alias("n_tokens"), (n > limit).alias("over_limit"))
