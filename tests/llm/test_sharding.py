import zlib
from collections import defaultdict

import pytest

from lumenline.llm.sharding import shard_documents


def check(got, rows, shards):
    want = sorted((str(r[0]), len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        assert r.law == "bytes" and 0 <= r.shard < shards and r.grown_shard is None
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


@pytest.mark.parametrize("shards", [1, 8])
def test_all_rows_once(docs, rows, shards):
    check(shard_documents(docs, shards).collect(), rows, shards)


def test_near_equal_with_a_hot_text(spark):
    rows = [(i, "hot text " * 20 if i % 3 == 0 else f"{i} " * (i % 90)) for i in range(6000)]
    got = shard_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    check(got, rows, 8)
    sizes = defaultdict(int)
    for r in got:
        sizes[r.shard] += r["size"]
    mean = sum(sizes.values()) / 8
    assert len(sizes) == 8 and all(abs(s - mean) < 0.03 * mean for s in sizes.values())


def test_equal_texts_stay_together(spark):
    rows = [(i, f"text {i // 3} " * 30) for i in range(3000)]
    got = shard_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    shards = defaultdict(set)
    for r in got:
        shards[r.doc_id // 3].add(r.shard)
    assert all(len(s) == 1 for s in shards.values())


def test_repeatable(docs):
    one, two = (sorted(map(tuple, shard_documents(docs).select("doc_id", "shard", "slot").collect()), key=str) for _ in range(2))
    assert one == two


def test_empty_and_null(nothing, unknown):
    assert shard_documents(nothing).collect() == []
    check(shard_documents(unknown).collect(), [(None, None)] * 3, 8)
