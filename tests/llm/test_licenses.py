import pytest

from lumenline.llm.licenses import Scanner, compile_template, phrase_places, scan_licenses, words_of

from .fixture_docs import FOLDED, words

PHRASES = {("cc", "by"): "cc-by", ("general", "public", "license"): "gpl", ("all", "rights", "reserved"): "reserved"}


def test_against_plain_python(docs, rows):
    want = []
    for r in rows:
        w = words(r[1], FOLDED)
        at = sorted((i, label) for p, label in PHRASES.items() for i in range(len(w)) if tuple(w[i : i + len(p)]) == p)
        want.append((str(r[0]), len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted({x for _, x in at}))))
    got = scan_licenses(docs).collect()
    assert sorted(map(str, want)) == sorted(str((str(r.doc_id), r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)) for r in got)
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got)


@pytest.mark.parametrize(
    "text, labels",
    [
        ("Licensed under the Apache License, Version 2.0.", {"apache-2.0"}),
        ("Licensed under the Apache Licence, Version 2.0.", set()),
        ("Licensed under the Apache License Version 2.0 (the License); you may not use this file except in compliance with the License", {"apache-2.0"}),
        ("Released under the MIT License", {"mit"}),
        ("available under the terms of the MIT license", {"mit"}),
        ("sold under the MIT License", set()),
        ("This work is licensed under the GNU General Public License, version 3.", {"gpl-3.0"}),
        ("licensed under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2", {"gpl-2.0"}),
        ("Licensed under CC BY-NC 4.0.", {"cc-by-nc-4.0"}),
        ("Copyright (c) 2020 by Some One. All rights reserved.", {"copyright-notice"}),
        ("Copyright one two three four five six seven eight nine all rights reserved", set()),
    ],
)
def test_templates(text, labels):
    assert {f[0] for f in Scanner().scan(text.encode())[2]} == labels


@pytest.mark.parametrize("text, end", [("a b", 2), ("a x b", 3), ("a x x b", None), ("a o b", 3), ("a b c", 2), ("b", None)])
def test_automaton(text, end):
    a = compile_template("t", "a [[o]] {{1}} b" if "o" in text else "a {{1}} b")
    assert a.longest(words_of(text), 0) == end


def test_optional_at_either_end_and_choice():
    a = compile_template("t", "[[x y]] {{p|q r}} [[z]]")
    for text, end in (("p", 1), ("x y q r z", 5), ("x p", None), ("q", None), ("q r p", 2)):
        assert a.longest(words_of(text), 0) == end


def test_overlapping_places():
    assert phrase_places(b" a a a b ", b"a a") == [0, 1]


def test_empty_and_null(nothing, unknown):
    assert scan_licenses(nothing).count() == 0
    assert [(r.n_words, r.labels, r.score, r.first_word) for r in scan_licenses(unknown).collect()] == [(0, "", 0.0, None)] * 3
