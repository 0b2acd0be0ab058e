import pytest
from pyspark.sql import functions as F

from lumenline.llm.preference import format_preferences, op2_preference_pairs

TURN = "conv_id long, turn long, role string, text string, prompt int"
PAIR = "pair_id long, chosen_id long, rejected_id long"


def show(turns):
    return "".join(f"<|{r or ''}|>\n{t or ''}<|end|>\n" for r, t in turns)


def seen(text, spans):
    return [text[s.start : s.start + s.length] for s in spans]


@pytest.fixture
def talk(spark):
    rows = [
        (1, 0, "system", "be kind"), (1, 1, "user", "hi"), (1, 2, "assistant", "good é answer"), (1, 3, "user", "thanks"), (1, 4, "assistant", "bye"),
        (2, 1, "user", "hi"), (2, 0, "system", "be kind"), (2, 2, "assistant", "bad"),
        (3, 0, "user", None), (3, 1, None, "x"), (3, 2, "assistant", ""), (4, 0, "user", None), (4, 1, None, "x"), (4, 2, "assistant", ""),
        (5, 0, "user", "other"), (5, 0, "user", "other"), (None, 0, "user", "lost"), (6, None, "user", "lost"),
    ]
    return spark.createDataFrame([(*r, 1) for r in rows], TURN)


def test_pairs(spark, talk):
    pairs = spark.createDataFrame([(1, 1, 2), (2, 3, 4), (3, 1, 5), (4, 5, 99), (5, None, 2), (6, None, None), (7, 1, 6)], PAIR)
    got = {r.pair_id: r for r in format_preferences(talk, pairs).collect()}
    one = got[1]
    assert one.n_common == 2 and one.prompt == show([("system", "be kind"), ("user", "hi")])
    assert one.chosen == show([("assistant", "good é answer"), ("user", "thanks"), ("assistant", "bye")])
    assert seen(one.chosen, one.chosen_spans) == ["good é answer<|end|>\n", "bye<|end|>\n"]
    assert seen(one.rejected, one.rejected_spans) == ["bad<|end|>\n"]
    same = got[2]
    assert same.n_common == 3 and same.chosen == same.rejected == "" and same.chosen_spans == []
    assert got[3].n_common == 0 and got[3].prompt == "" and got[3].rejected == show([("user", "other")])
    assert got[4].rejected is None and got[4].rejected_spans is None and got[4].chosen is not None
    assert got[5].chosen is None and got[5].rejected == show([("system", "be kind"), ("user", "hi"), ("assistant", "bad")])
    assert 6 not in got and got[7].rejected is None


def test_query_pairs_neighbours(spark, talk, tmp_path):
    talk.write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.pair_id: (r.chosen_id, r.rejected_id, r.n_common) for r in op2_preference_pairs(spark, str(tmp_path)).collect()}
    assert got == {0: (None, 1, 0), 1: (2, 3, 0), 2: (4, 5, 0)}


def test_query_against_plain_python(spark):
    d = "/root/testdata/sf0.001"
    talks = {}
    for r in spark.read.parquet(f"{d}/conversations.parquet").orderBy("conv_id", "turn").collect():
        talks.setdefault(r.conv_id, []).append((r.role, r.text))
    got = op2_preference_pairs(spark, d).collect()
    assert len(got) == len({c // 2 for c in talks})
    for r in got:
        a, b = talks.get(2 * r.pair_id, []), talks.get(2 * r.pair_id + 1, [])
        n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert (r.n_common, r.prompt, r.chosen or "", r.rejected or "") == (n, show(a[:n]), show(a[n:]), show(b[n:]))
        assert seen(r.chosen, r.chosen_spans) == [t + "<|end|>\n" for role, t in a[n:] if role == "assistant"]


def test_hot_first_turn_and_nothing(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", "same" if t == 0 else f"{c} {t}") for c in range(200) for t in range(3)]
    pairs = spark.range(100).select(F.col("id").alias("pair_id"), (F.col("id") * 2).alias("chosen_id"), (F.col("id") * 2 + 1).alias("rejected_id"))
    got = format_preferences(spark.createDataFrame([(*r, 0) for r in rows], TURN), pairs).collect()
    assert len(got) == 100 and all(r.n_common == 1 and r.prompt == show([("user", "same")]) for r in got)
    assert format_preferences(spark.createDataFrame([], TURN), pairs).count() == 0
    assert format_preferences(spark.createDataFrame([(None,) * 5], TURN), pairs).count() == 0


def test_large_ids_keep_their_pairs(spark, tmp_path):
    from lumenline.llm.preference import op2_preference_pairs

    big = 2**53 + 2
    rows = [(i, 0, "user", "a") for i in (big, big + 1, big + 2, -2, -1, -3)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.pair_id: (r.chosen_id, r.rejected_id) for r in op2_preference_pairs(spark, str(tmp_path)).collect()}
    assert got == {big // 2: (big, big + 1), big // 2 + 1: (big + 2, None), -1: (-2, -1), -2: (None, -3)}
