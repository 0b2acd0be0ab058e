import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lumenline.llm.packing import cut_pieces, encoder, pack_documents, packing_patterns, public_vocabulary

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids + [1]


def check(got, rows, limit):
    docs = defaultdict(list)
    for r in got:
        docs[r.doc_id].append(r)
    want = defaultdict(list)
    for r in rows:
        want[r[0]].append(ids_of(r[1]))
    for doc, texts in want.items():
        pieces = [(s, zlib.crc32(np.array(t[s : s + limit], "<u4").tobytes()), len(t[s : s + limit]), len(t)) for t in texts for s in range(0, len(t), limit)]
        assert sorted(pieces) == sorted((r.start, r.ids_crc32, r.length, r.doc_tokens) for r in docs[doc])
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= limit
    assert sorted(sequences) == list(range(len(sequences)))
    return sum(r.length for r in got) / (limit * len(sequences))


@pytest.mark.parametrize("limit", [2048, 64])
def test_round_trip(docs, rows, limit):
    assert check(pack_documents(docs, limit).collect(), rows, limit) > 0.9


def test_ids_are_returned(docs):
    for r in cut_pieces(docs, 64, with_ids=True).collect():
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length


def test_hot_length(spark):
    rows = [(i, "the same text" if i % 3 else " ".join(["word"] * (i % 40))) for i in range(1500)]
    assert check(pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), 128).collect(), rows, 128) > 0.95


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 500), min_size=1, max_size=30))
def test_patterns_hold_the_histogram(histogram):
    patterns = packing_patterns(histogram, 64)
    total = defaultdict(int)
    for count, lengths in patterns:
        assert count > 0 and sum(lengths) <= 64
        for x in lengths:
            total[x] += count
    assert total == histogram


def test_shortest_pack_first():
    assert sorted(packing_patterns({6: 1, 5: 1, 4: 1, 3: 1}, 10)) == [(1, (5, 4)), (1, (6, 3))]


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60) | st.text(st.sampled_from("aé <|endoftext|>\n\t\r 　'sÄ1²"), max_size=60))
def test_ids_are_those_of_the_tokenizer(text):
    assert encoder(*public_vocabulary()).encode(text, allowed_special="all") == TOKENIZER.encode(text, add_special_tokens=False).ids


def test_special_string_and_long_text(spark):
    rows = [(1, "a<|endoftext|>b"), (2, "x" * 50_000), (3, " " * 5_000)]
    check(pack_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect(), rows, 2048)


def test_empty_and_null(nothing, unknown):
    assert pack_documents(nothing).count() == 0
    assert [(r.length, r.doc_tokens) for r in pack_documents(unknown).collect()] == [(1, 1)] * 3
