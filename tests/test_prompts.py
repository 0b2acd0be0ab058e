from lumenline.plans import prompts


def test_budget_is_that_of_the_joined_text(spark):
    import random

    rng = random.Random(1)
    groups = {str(g): ["é" * rng.randint(0, 6) if rng.random() < 0.8 else None for _ in range(rng.randint(1, 9))] for g in range(40)}
    df = spark.createDataFrame([(g, i, t) for g, own in groups.items() for i, t in enumerate(own)], "g string, i int, text string")
    for chars in (0, 1, 7, 20, 1000):
        got = {r.g: r.text for r in prompts.joined_within(df, chars, ("g",), "i", separator="--").collect()}
        for g, own in groups.items():
            assert got.get(g, "") == "--".join(t or "" for t in own)[:chars]


def test_only_parts_that_fit_are_kept(spark):
    df = spark.createDataFrame([("a", i, "x" * 10) for i in range(100)], "g string, i int, text string")
    assert [len(r.text) for r in prompts.within_budget(df, 35, ("g",), "i").orderBy("i").collect()] == [12, 12, 11]


def test_pages_of_past_exams(spark):
    material = spark.createDataFrame([("c", 1, "one"), ("d", 1, "two")], "course string, place int, text string")
    pages = spark.createDataFrame([("c", "b", 1, "q"), ("c", "a", 2, ""), ("c", "a", 1, "p")], "course string, source string, page_number int, text string")
    got = {r.course: r.prompt for r in prompts.format_prompts(material, pages, ("course",)).collect()}
    assert got["c"] == "one\n\nPages of past exams:\n\n--- a page 1 ---\np\n\n--- a page 2 ---\n(a scan; see its image)\n\n--- b page 1 ---\nq"
    assert got["d"] == "two\n\nThere are no past exams; choose a form that suits the material."
