import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lumenline.llm import tokencounts as tc

TOKENIZER = Tokenizer.from_file(tc.word_vocabulary())
PARTS = ["a", "b", "e", "s", "t", "th", "ing", "'", "'s", "'re", "'LL", "'rest", "é", "é", "́", "̈", "İ", "Σ", "ΣΑΣ", " ", "  ", "\n", "1", "23", "!", "...", "''", "<|endoftext|>",
         "<|startoftext|>", "<|", "|>", "日本", "😀", "가", "ᄀ", "ᅡ", "ᆨ", "ǅ", "̈́", " ", "\x1c", "\x85", "​", "hello", "Universe", "unthinkable"]


def wanted(texts):
    return [len(e.ids) for e in TOKENIZER.encode_batch(texts, add_special_tokens=False)]


def counts(text):
    return np.r_[0, np.cumsum(np.frombuffer(tc.counter(tc.word_vocabulary()).steps(text), np.int8), dtype=int)].tolist()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=14).map("".join))
def test_every_prefix_has_the_tokenizers_count(text):
    assert counts(text) == wanted([text[:i] for i in range(len(text) + 1)])


@settings(max_examples=100, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cn", "Cs"]), max_size=20))
def test_any_characters(text):
    assert counts(text) == wanted([text[:i] for i in range(len(text) + 1)])


def test_long_units():
    texts = ["ab" * 5000, "é" * 3000, "é" * 300, "!" * 4000, " " * 5000 + "x", "abc" * 1000 + "'s" * 1000, "word " * 40_000]
    assert [counts(t)[-1] for t in texts] == wanted(texts)


def test_counts_of_rows(docs, rows):
    got = tc.with_prefix_counts(docs).collect()
    assert sorted(map(str, ((r.doc_id, r.token_counts.n_tokens) for r in got))) == sorted(map(str, zip([r[0] for r in rows], wanted([r[1] or "" for r in rows]))))


def test_store_answers_without_texts(docs, rows):
    for chars, budget in ((0, 0), (3, 1), (700, 64), (3000, 700), (10**6, 10**6), (-1, -1)):
        got = tc.with_prefix_counts(docs.where("doc_id is not null").dropDuplicates(["doc_id"]), "c").select("doc_id", tc.tokens_in_prefix("c", F.lit(chars)).alias("n"), tc.chars_within("c", budget).alias("k")).collect()
        text = {r[0]: r[1] or "" for r in rows}
        for r in got:
            own = counts(text[r.doc_id])
            assert r.n == own[min(max(chars, 0), len(own) - 1)]
            assert r.k == max((i for i, n in enumerate(own) if n <= budget), default=0)


def test_texts_are_cut_at_the_budget(docs):
    cut = tc.truncate(docs, 50)
    assert cut.columns == docs.columns
    assert {n <= 50 for n in wanted([r.text or "" for r in cut.collect()])} == {True}
    assert sorted(map(str, tc.truncate(docs, 10**9).collect())) == sorted(map(str, docs.collect()))


def test_names_and_empty_tables(spark, docs, nothing, unknown):
    taken = docs.withColumn("Token_Counts", F.lit("x")).withColumn("__token_counts", F.lit(1))
    assert {r.token_counts.n_tokens >= 0 for r in tc.with_prefix_counts(taken).collect()} == {True}
    assert tc.truncate(taken, 5).count() == docs.count()
    assert tc.with_prefix_counts(nothing).collect() == [] and tc.truncate(nothing, 3).collect() == []
    assert [(r.text, r.token_counts.n_tokens) for r in tc.with_prefix_counts(unknown).collect()] == [(None, 0)] * 3


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        tc.PrefixCounter(public_tokenizers.path("byte_bpe_50k.json"))


def test_query(spark, docs, rows, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = tc.op12_prefix_token_counts(spark, str(tmp_path))
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint", "bigint", "bigint", "boolean"]
    want = [(r[0], len((r[1] or "").encode()), n, n > 2048) for r, n in zip(rows, wanted([r[1] or "" for r in rows]))]
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got.collect())
