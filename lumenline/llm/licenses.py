"""License scans by template markup.

A template is wording with markup: ``[[words]]`` may be missing, ``{{n}}`` stands for up to n words of any
kind, ``{{a|b}}`` for one of the wordings given. Templates compile to token automata; a text is accepted at
a place where the mandatory wording stands exactly, word for word. Before an automaton runs, each of its
mandatory stretches must occur in the text, and it starts only at its possible first words.

Null texts are empty: no words, no labels, score 0. Repeated rows are scanned one by one. Columns other than
doc_id and text are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import FOLD, map_texts, read

#: Phrases and their labels, as the contract gives them.
BASE_PHRASES = {b"cc by": "cc-by", b"general public license": "gpl", b"all rights reserved": "reserved"}

#: Label and template; the wording is that of the licences' own public notices.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license [[,]] version 2 0 [[the license you may not use this file except in compliance with the license]]"),
    ("mit", "{{released|licensed|distributed|available}} under the [[terms of the]] mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("gpl-3.0", "licensed under the [[terms of the]] gnu general public license [[as published by the free software foundation either]] version 3"),
    ("gpl-2.0", "licensed under the [[terms of the]] gnu general public license [[as published by the free software foundation either]] version 2"),
    ("lgpl", "gnu {{lesser|library}} general public license"),
    ("agpl-3.0", "gnu affero general public license [[as published by the free software foundation either]] [[version 3]]"),
    ("cc-by-4.0", "licensed under [[a]] {{cc by|creative commons attribution}} 4 0 [[international]]"),
    ("cc-by-nc-4.0", "licensed under [[a]] {{cc by nc|creative commons attribution noncommercial}} 4 0 [[international]]"),
    ("cc-by-sa-4.0", "licensed under [[a]] {{cc by sa|creative commons attribution sharealike}} 4 0 [[international]]"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0"),
    ("copyright-notice", "copyright [[c]] {{8}} all rights reserved"),
)

MARKUP = re.compile(r"\[\[(?P<optional>.*?)\]\]|\{\{(?P<any>\d+)\}\}|\{\{(?P<one>.*?)\}\}|(?P<plain>[^\[\{]+)", re.S)


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(FOLD).split()


@dataclass
class Automaton:
    """States with word edges, edges on any word and edges without a word; the last state accepts."""

    label: str
    words: list[dict[bytes, set[int]]] = field(default_factory=list)
    free: list[set[int]] = field(default_factory=list)
    wild: list[set[int]] = field(default_factory=list)
    mandatory: list[bytes] = field(default_factory=list)
    first: frozenset[bytes] = frozenset()

    def state(self) -> int:
        self.words.append({})
        self.free.append(set())
        self.wild.append(set())
        return len(self.words) - 1

    def chain(self, at: int, words: list[bytes]) -> int:
        for w in words:
            new = self.state()
            self.words[at].setdefault(w, set()).add(new)
            at = new
        return at

    def closure(self, states: set[int]) -> set[int]:
        todo, out = list(states), set(states)
        while todo:
            for s in self.free[todo.pop()] - out:
                out.add(s)
                todo.append(s)
        return out

    def longest(self, words: list[bytes], start: int) -> int | None:
        """Where the longest accepted stretch that starts at ``start`` ends."""
        now, end, last = self.closure({0}), None, len(self.words) - 1
        for i in range(start, len(words) + 1):
            if last in now:
                end = i
            if i == len(words) or not now:
                break
            w = words[i]
            now = self.closure({t for s in now for t in self.words[s].get(w, ())} | {t for s in now for t in self.wild[s]})
        return end


def compile_template(label: str, template: str) -> Automaton:
    a = Automaton(label)
    at = a.state()
    for m in MARKUP.finditer(template):
        if m["plain"] is not None:
            words = words_of(m["plain"])
            if words:
                a.mandatory.append(b" " + b" ".join(words) + b" ")
            at = a.chain(at, words)
        elif m["optional"] is not None:
            end = a.chain(at, words_of(m["optional"]))
            if end != at:
                a.free[at].add(end)
            at = end
        elif m["any"]:
            begin, states = at, []
            for _ in range(int(m["any"])):
                new = a.state()
                a.wild[at].add(new)
                states.append(at)
                at = new
            for s in {begin, *states}:
                a.free[s].add(at)
        else:
            ends = [a.chain(at, words_of(x)) for x in m["one"].split("|")]
            at = a.state()
            for e in ends:
                a.free[e].add(at)
    if at != len(a.words) - 1:
        end = a.state()
        a.free[at].add(end)
    a.first = frozenset(w for s in a.closure({0}) for w in a.words[s])
    return a


def phrase_places(joined: bytes, phrase: bytes) -> list[int]:
    """Word positions at which the phrase's words stand consecutively; ``joined`` has a space around each word."""
    out, at, n, seen = [], joined.find(b" " + phrase + b" "), 0, 0
    while at >= 0:
        n += joined.count(b" ", seen, at)
        seen = at
        out.append(n)
        at = joined.find(b" " + phrase + b" ", at + 1)
    return out


class Scanner:
    def __init__(self, templates=TEMPLATES, phrases=None):
        self.automata = [compile_template(*t) for t in templates]
        self.phrases = BASE_PHRASES if phrases is None else phrases

    def scan(self, text: bytes | None):
        """Number of words, base places with labels, and accepted (label, start, end)."""
        words = (text or b"").translate(FOLD).split()
        joined = b" " + b" ".join(words) + b" "
        base = sorted((place, label) for phrase, label in self.phrases.items() for place in phrase_places(joined, phrase))
        found = []
        for a in self.automata:
            if all(m in joined for m in a.mandatory):
                for w in a.first:
                    for start in phrase_places(joined, w):
                        end = a.longest(words, start)
                        if end is not None:
                            found.append((a.label, start, end))
        return len(words), base, sorted(found)


def scan_licenses(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and spans of accepted templates."""

    def make():
        scanner = Scanner(templates)

        def compute(texts):
            columns: list[list] = [[] for _ in range(8)]
            for text in texts:
                n, base, found = scanner.scan(text)
                own = sorted({x for _, x in base})
                values = (
                    n,
                    len(base),
                    base[0][0] if base else None,
                    base[-1][0] if base else None,
                    ",".join(own),
                    ",".join(sorted({*own, *(f[0] for f in found)})),
                    1.0 if found else 0.5 if base else 0.0,
                    [{"label": f[0], "start": f[1], "end": f[2]} for f in found],
                )
                for column, value in zip(columns, values, strict=True):
                    column.append(value)
            return columns

        return compute

    spans = T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    fields = [T.StructField(n, T.LongType()) for n in ("n_words", "n_base", "first_word", "last_word")]
    fields += [T.StructField("base_labels", T.StringType()), T.StructField("labels", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("spans", spans)]
    return map_texts(docs, make, fields, ["doc_id"])


def op6_template_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read(spark, sf_dir, "documents")).drop("spans")
