import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenline.llm import prefixtrie as pt

SCHEMA = "conv_id long, turn long, role string, text string, depth int, a string, length int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 7, "x", None) for r in rows], SCHEMA).repartition(3)


def in_order(rows):
    found = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            found[c].append((turn is not None, turn or 0, hashlib.md5(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest(), role or "", text or ""))
    return {c: [(r[3], r[4]) for r in sorted(own)] for c, own in found.items()}


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - c % 5, [])[:h] + own[h:]
    return out


def brute(convs):
    nodes = defaultdict(list)
    for c, own in convs.items():
        for d in range(len(own) + 1):
            nodes[tuple(own[:d])].append(c)
    children = defaultdict(list)
    for n in nodes:
        if n:
            children[n[:-1]].append(n)
    leaves, saved = {}, {}
    for n in sorted(nodes, key=len, reverse=True):
        leaves[n] = sum(leaves[k] for k in children[n]) or 1
        saved[n] = (len(nodes[n]) - 1) * (len(n[-1][1].encode()) if n else 0) + sum(saved[k] for k in children[n])
    rows = []
    for n, members in nodes.items():
        ends = ",".join(map(str, sorted(c for c in members if len(convs[c]) == len(n))))
        parent = min(nodes[n[:-1]]) if n else None
        rows.append((min(members), len(n), parent, len(members), len(children[n]), leaves[n], saved[n], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(map(str, rows))


def got(df):
    return sorted(str(tuple(r)[:8]) for r in df.collect())


def make(seed=3, n=90):
    rng = random.Random(seed)
    texts = ["", "a", "é", "one two", None, "long " * 300]
    rows = []
    for c in rng.sample(range(400), n):
        for turn in range(rng.choice([1, 2, 3, 4, 9, 12])):
            rows.append((c, rng.choice([turn, turn, None, 1]), rng.choice(["user", "assistant", None]), rng.choice(texts)))
    rows += [(c, t, "user", "same") for c in range(1000, 1060) for t in range(12)]  # copies
    rows += [(c, t, "user", "first" if t == 0 else str(c * 10 + t)) for c in range(2000, 2040) for t in range(3)]  # a common beginning
    rows += [(None, 0, "user", "lost"), (None, None, None, None)] + rows[:3]
    return rows


@pytest.mark.parametrize("bounds", [{}, {"shard": 1}, {"shard": 20}, {"shard": 4, "upper": 3}])
def test_trie_is_that_of_brute_force(spark, bounds):
    rows = make()
    assert got(pt.conversation_trie(frame(spark, rows), **bounds)) == brute(in_order(rows))


def test_rebuilt_conversations(spark):
    rows = make(4) + [(c, t, "user", str(t)) for c in (-3, -5, -10) for t in range(10)]
    turns, convs = pt.rebuilt(frame(spark, [r for r in rows if r[0] is None or r[0] >= 0]))
    assert got(pt.prefix_trie(turns, convs)) == brute(rebuilt(in_order([r for r in rows if r[0] is None or r[0] >= 0])))


def test_long_conversations(spark, monkeypatch):
    monkeypatch.setattr(pt, "BLOCK", 16)
    rows = [(c, t, "user", str(t % 7) if t < 90 else str(c)) for c in range(4) for t in range(120 + c)]
    assert got(pt.conversation_trie(frame(spark, rows), shard=50)) == brute(in_order(rows))


def test_empty_and_unknown(spark):
    assert got(pt.conversation_trie(frame(spark, []))) == []
    assert got(pt.conversation_trie(frame(spark, [(None, None, None, None)] * 3))) == []
    assert got(pt.conversation_trie(frame(spark, [(1, None, None, None)]))) == brute({1: [("", "")]})
    turns, convs = pt.rebuilt(frame(spark, [(6, 0, "user", "x")]))  # its beginning would be that of conversation 5
    assert got(pt.prefix_trie(turns, convs)) == brute(rebuilt({6: [("user", "x")]}))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=6), min_size=1, max_size=12))
def test_bitvector_leads_from_children_to_parents(sequences):
    names = {(): 0}
    for s in sequences:
        for d in range(len(s)):
            names.setdefault(tuple(s[: d + 1]), len(names) * 7919 + 1)
    paths = sorted(names, key=len)
    columns = [np.array(v, np.int64) for v in ([0] * len(paths), [len(p) for p in paths], [names[p] for p in paths], [names[p[:-1]] for p in paths])]
    forest = pt.Forest(*columns)
    own = [paths[i] for i in forest.order]
    assert [own[i] if i >= 0 else None for i in forest.parents()] == [p[:-1] if p else None for p in own]
    assert forest.degrees().tolist() == [sum(1 for q in paths if q and q[:-1] == p) for p in own]
    assert forest.rolled_up(np.ones(len(own), int)).tolist() == [sum(1 for q in paths if q[: len(p)] == p) for p in own]
    assert forest.bits.sum() == len(own) and (~forest.bits).sum() == len(own) + 1
