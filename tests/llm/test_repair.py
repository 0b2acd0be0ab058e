import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

from lumenline.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, place int, block string, kind int, edits string"
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2, None) for r in rows], SCHEMA).repartition(3)


def in_order(rows):
    found = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = " " if role is None else role, " " if text is None else text
            found[c].append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), turn, role, text))
    return {c: [r[3:] for r in sorted(own, key=lambda r: r[:3])] for c, own in found.items()}


def faults(turns):
    out, seen = [], set()
    for _, role, text in turns:
        last = text.rstrip(SPACE)[-1:]
        out.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else None)
        seen.add((role, text))
    return out


def steps(turn, fault, state):
    """(edit, cost, role, state) of what may become of a turn."""
    after = "a" if state == "u" else "u"
    yield "D", 4, None, state
    if fault not in ("blank", "duplicate"):
        more = 3 * (fault == "truncated")
        if turn[1][:1] and turn[1][:1] in ("su" if state == "" else after):
            yield "K", more, turn[1], turn[1][0]
        yield "R", 3 + more, {"u": "user", "a": "assistant"}[after], after


def every_repair(turns, found, most, state="", i=0):
    """All repairs with at most so many insertions in a row: (cost, audit, lines)."""
    for k in range(most + 1):
        at, lines = state, []
        for _ in range(k):
            at = "a" if at == "u" else "u"
            lines.append({"u": "user:", "a": "assistant:"}[at])
        if i == len(turns):
            if at in ("", "a"):
                yield 3 * k, "I" * k, lines
            continue
        for edit, cost, role, end in steps(turns[i], found[i], at):
            for c, a, rest in every_repair(turns, found, most, end, i + 1):
                yield 3 * k + cost + c, "I" * k + edit + a, lines + ([f"{role}:{turns[i][2]}"] if role is not None else []) + rest


def cheapest(turns, found):
    """The same by strings, one turn after the other."""
    best = {"": (0, "", [])}
    for turn, fault in [*zip(turns, found), (None, None)]:
        new = {}
        for state, (cost, audit, lines) in best.items():
            at, made = state, []
            for k in range(4):
                options = [("", 0, None, at)] if turn is None else steps(turn, fault, at)
                for edit, c, role, end in options:
                    own = (cost + 3 * k + c, audit + "I" * k + edit, lines + made + ([f"{role}:{turn[2]}"] if role is not None else []))
                    new[end] = min(new.get(end, own), own, key=lambda x: x[:2])
                at = "a" if at == "u" else "u"
                made = [*made, {"u": "user:", "a": "assistant:"}[at]]
        best = new
    return min((best[s] for s in ("", "a") if s in best), key=lambda x: x[:2])


def expected(convs, solve):
    rows = []
    for c, turns in convs.items():
        found = faults(turns)
        numbers = [t[0] for t in turns if t[0] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
        cost, audit, lines = solve(turns, found)
        rows.append((c, gaps, *(found.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(map(str, rows))


def make(n, most, seed=1, first=0):
    rng = random.Random(seed)
    roles = ["user", "user", "assistant", "assistant", "system", "tool", "", None, "aide", "Student"]
    texts = ["Yes.", "No!", "Why?", "cut off", "", " \n\t", None, "x" * 50, "é.", "a.\x0b ", "b. c\r\n", " ", "long " * 2000]
    return [(c, rng.choice([t, t, t + 3, None, 1]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.6 else f"{t}.") for c in range(first, first + n) for t in range(rng.randint(1, most))]


def got(df):
    return sorted(str(tuple(r)) for r in df.collect())


def test_all_repairs_of_short_conversations(spark):
    rows = make(150, 3) + [(None, 1, "user", "x."), (None, None, None, None)]
    solve = lambda turns, found: min(every_repair(turns, found, 3), key=lambda x: x[:2])
    assert got(repair.digests(repair.repaired(frame(spark, rows)))) == expected(in_order(rows), solve)


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_blocks_of_long_conversations(spark, monkeypatch, block):
    monkeypatch.setattr(repair, "BLOCK", block)
    rows = make(40, 25, seed=block) + [(500, t, "user", f"{t}.") for t in range(300)] + [(501, 1, "assistant", "same.")] * 200
    assert got(repair.digests(repair.repaired(frame(spark, rows)))) == expected(in_order(rows), cheapest)


def test_edits_are_whole(spark):
    rows = make(60, 8, seed=9)
    edits = repair.repaired(frame(spark, rows)).collect()
    by = defaultdict(list)
    for r in edits:
        by[r.conv_id].append(r)
    for conv, turns in in_order(rows).items():
        own = sorted(by[conv], key=lambda r: r.step)
        assert [r.step for r in own] == list(range(len(own)))
        assert [(r.turn, r.role_before) for r in own if r.edit != "I"] == [(t[0], t[1]) for t in turns]
        kept = [r.role[0] for r in own if r.role is not None]
        assert re.fullmatch("(s?(ua)+)?", "".join(kept)), kept
        assert all(r.fault not in ("blank", "duplicate") for r in own if r.edit in "KR")


def test_query_with_damage(spark, tmp_path):
    rows = make(120, 6, seed=4) + [(10_000 + i, t, "user", f"{t}.") for i in range(60) for t in range(1)] + [(None, 0, "user", "x")]
    frame(spark, rows).write.parquet(str(tmp_path / "conversations.parquet"))
    after = []
    for c, turn, role, text in rows:
        if c is None:
            continue
        role, text = " " if role is None else role, " " if text is None else text
        way = zlib.crc32(f"{c}:{' ' if turn is None else turn}".encode()) % 20
        if way:
            new = (c, turn, "user" if way == 4 else role, "" if way == 1 else re.sub("[.!?]", "", text) if way == 2 else text)
            after += [new] * (2 if way == 3 else 1)
    convs = in_order(after)
    lost = {r[0] for r in rows if r[0] is not None} - set(convs)
    assert lost
    want = expected(convs, cheapest) + [str((c, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())) for c in lost]
    df = repair.op13_rank_repair(spark, str(tmp_path))
    assert [f.dataType.simpleString() for f in df.schema] == ["bigint"] * 7 + ["string"] * 2
    assert got(df) == sorted(want)


def test_empty_and_unknown(spark):
    for rows in ([], [(None, None, None, None)] * 3):
        assert repair.repaired(frame(spark, rows)).collect() == []
    [row] = repair.digests(repair.repaired(frame(spark, [(1, None, None, None)]))).collect()
    assert (row.blank, row.audit, row.cost, row.gaps) == (1, "D", 4, 0)


def test_codes_are_ordered_and_prefix_free():
    assert list(repair.CODES) == sorted(repair.CODES)
    assert not any(a != b and b.startswith(a) for a in repair.CODES for b in repair.CODES)
