import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from marquee.llm.frequency import marked, term_frequencies
from marquee.llm.matching import assigned, best_assignment, components, improved, match_entities, maximal, variants
from marquee.llm.mixing import mix, plan_budgets, text_quality
from marquee.llm.topn import top_items


def test_frequencies_with_a_hot_pair(spark):
    rng = random.Random(1)
    rows = [(rng.choice("abcdefg"), rng.randrange(9)) for _ in range(400)] + [("hot", 1)] * 800 + [(None, 1), ("x", None)]
    df = spark.createDataFrame([(t, r, 1) for t, r in rows], "t string, r bigint, records int")
    want = {t: (n, len({r for u, r in rows if u == t and r is not None})) for t, n in Counter(t for t, r in rows if t and r is not None).items()}
    for frame in (df, df.repartition(7)):
        assert {r.term: (r.occurrences, r.records) for r in term_frequencies(frame, "t", "r").collect()} == want
    assert term_frequencies(df.limit(0), "t", "r").count() == 0
    assert {r.term: r.mark for r in marked(term_frequencies(df, "t", "r"), 10, 2, 60).collect()}["hot"] == "rare"


def test_numeric_terms(spark):
    df = spark.createDataFrame([(i % 5, i % 7) for i in range(300)], "t bigint, r bigint")
    assert {(r.term, r.occurrences, r.records) for r in term_frequencies(df, "t", "r").collect()} == {(t, 60, 7) for t in range(5)}


def test_top_items(spark):
    rows = [(1, 10, 4.0, 5), (1, 10, 5.0, 4), (1, 11, 4.0, None), (1, 12, 4.0, 9), (1, 13, 4.0, 9), (1, 14, float("nan"), 1), (2, 5, 7.0, 1), (2, None, 3.0, 1), (None, 5, 3.0, 1), (3, 1, 0.5, 1), (1, 13, 4.0, 9)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "u bigint, i bigint, s double, a bigint, place int")
    got = {(r.group_id, r.place, r.item_id) for r in top_items(df, "u", "i", "s", "a", 3).collect()}
    assert got == {(1, 1, 12), (1, 2, 13), (1, 3, 10), (3, 1, 1)}
    assert top_items(df.limit(0), "u", "i", "s", "a", 3).count() == 0


def test_budgets():
    sizes, targets = {"a": 1000, "b": 10, "x": 5}, [("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 3)]
    plan = plan_budgets(sizes, targets)
    assert plan["b"][1] == 20 and plan["a"][1] == 33 and "c" not in plan and "x" not in plan
    assert plan_budgets(sizes, targets, 1000)["b"][1] == 20
    assert plan_budgets({}, targets) == {}


def test_mix(spark):
    rng = random.Random(2)
    docs = [(i, "film " * rng.randint(0, 60), rng.choice(["a", "a", "a", "b", None, "z"]), 1) for i in range(400)] + [(900, None, "a", 1)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string, n_tokens int")
    targets = spark.createDataFrame([("a", 0.6, 1), ("b", 0.3, 2), ("b", 0.3, 2), ("none", 0.1, 4)], "source string, target_share double, max_repeats bigint")
    chosen, report = mix(df, targets, ordered=8)
    rows, shares = chosen.collect(), {r.source: r for r in report.collect()}
    assert len({r.doc_id for r in rows}) == len(rows) and all(r.repeats <= {"a": 1, "b": 2}[r.source] for r in rows)
    assert abs(shares["a"].actual_share - 2 / 3) < 0.02 and shares["none"].mixed_tokens == 0
    assert all(r.mixed_tokens <= r.budget for r in shares.values())
    again = {(r.doc_id, r.repeats) for r in mix(df.repartition(5), targets, ordered=100)[0].collect()}
    assert again == {(r.doc_id, r.repeats) for r in rows}
    assert mix(df.limit(0), targets)[0].count() == 0


def test_quality_of_texts(spark):
    prose = "The harbour lay still that morning, and nobody on the pier had yet heard what the tide brought in."
    texts = [prose, "日本語の映画の感想です。\nとても良かった。", "12 | 34 | ## | 5.0 | -- | 7", "buy now " * 200, (prose + "\n") * 30, "", " ", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    w = {r.i: r.w for r in df.select("i", text_quality("text").alias("w")).collect()}
    assert w[0] > 0.9 and w[1] > 0.8 and w[2] < 0.1 and w[3] < 0.05 and w[4] < 0.05 and w[5] == w[6] == w[7] == 0


def test_prefix_sums_end_where_a_sort_says(spark):
    rng = random.Random(9)
    docs = [(i, "film " * rng.randint(1, 9), "a") for i in range(3000)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats bigint")
    runs = [{r.doc_id: r.n_tokens for r in mix(df, targets, total=4000, ordered=n)[0].collect()} for n in (1, 50, 10_000)]
    assert runs[0] == runs[1] == runs[2] and 3991 <= sum(runs[0].values()) <= 4000


def test_weights_are_followed(spark):
    df = spark.createDataFrame([(i, "film", "a") for i in range(2000)], "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats bigint")
    rows = mix(df, targets, weight=F.when(F.col("doc_id") < 1000, 1.0).otherwise(0.1), total=300)[0].collect()
    assert len(rows) in (299, 300) and sum(r.doc_id < 1000 for r in rows) > 240


def test_titles():
    squeezed = lambda t: [v[0] for v in variants(t)[0]]
    assert variants("Thé Market & Sons, Part II (1985)")[1:] == (2, 1985)
    assert squeezed("Bakery for Zavofom, A (1996)")[0] == squeezed("A BAKERY FOR ZAVOFOM")[0]
    assert "stubborndibobox" in squeezed("The Village (a.k.a. The Stubborn Dibobox) (1938)")
    assert squeezed("St. Klo’s Door")[0] == squeezed("Saint Klo's  Door")[0]


def matched(spark, rows, **more):
    df = spark.createDataFrame(rows, "l bigint, lt string, r bigint, rt string, d string, h double, title string, id int")
    out = match_entities(df, left_id="l", left_title="lt", right_id="r", right_title="rt", right_date="d", hint="h", **more)
    return {(x.l, x.r) for x in out.collect()}


def test_matches(spark):
    rows = [(1, "Harbor, The (1950)", 11, "The Quarry", "1990-01-01", 1.0), (2, "Quarry, The (1990)", 12, "The Harbr", "1950", None), (3, "Window (1960)", 13, "Window", "1985-05-05", 1.0), (4, "Lantern (2000)", 14, "Lantern 2", "2000", 1.0), (5, None, 15, "Alone", None, 0.5), (6, "Nameless", None, None, None, None)]
    rows = [(*r, "x", 1) for r in rows] * 2
    assert matched(spark, rows) == {(1, 12), (2, 11)}


def test_matching_of_nothing(spark):
    assert matched(spark, []) == set()


def test_many_of_one_title(spark):
    rows = [(i, f"Same Film ({1900 + i})", 1000 + i, "Same Film", f"{1900 + i}-01-01", 1.0, "x", 1) for i in range(0, 90, 3)]
    assert matched(spark, rows) == {(i, 1000 + i) for i in range(0, 90, 3)}


def test_assignment_is_best():
    rng = random.Random(5)

    def best(edges, used=frozenset(), i=0):
        if i == len(edges):
            return 0.0
        a, b, w = edges[i]
        skip = best(edges, used, i + 1)
        return skip if ("l", a) in used or ("r", b) in used else max(skip, w + best(edges, used | {("l", a), ("r", b)}, i + 1))

    for _ in range(300):
        edges = [(a, b, round(rng.random(), 2) + 0.01) for a, b in sorted({(rng.randrange(4), rng.randrange(4)) for _ in range(8)})]
        got = best_assignment(edges)
        assert len({edges[i][0] for i in got}) == len(got) == len({edges[i][1] for i in got})
        assert sum(edges[i][2] for i in got) == pytest.approx(best(edges))


def one_to_one(rows):
    return len({x.l for x in rows}) == len(rows) == len({x.r for x in rows})


@pytest.mark.parametrize("kind", ["equal", "chain", "random"])
def test_large_components_in_bounded_passes(spark, kind):
    rng = random.Random(6)
    if kind == "equal":  # every confidence the same, more on one side than on the other
        edges = [(a, b, 0.9) for a in range(60) for b in range(40)]
    elif kind == "chain":
        edges = [(a, b, round(0.74 + 0.26 * rng.random(), 3)) for a in range(120) for b in range(max(0, a - 3), min(120, a + 4))]
    else:
        edges = [(a, b, round(0.5 + rng.random() / 2, 3)) for a, b in sorted({(rng.randrange(80), rng.randrange(80)) for _ in range(500)})]
    df = spark.createDataFrame(edges, "l bigint, r bigint, confidence double")
    exact = sum(edges[i][2] for i in best_assignment(edges))
    got = (assigned(df, task_edges=100) if kind == "random" else improved(df, 100, passes=8, calm=2)).collect()
    assert one_to_one(got) and {(x.l, x.r, x.confidence) for x in got} <= set(edges)
    # Regions of a fifth of a graph without neighbourhoods reach less than those of a chain.
    assert sum(x.confidence for x in got) >= (0.975 if kind == "random" else 0.99) * exact


def test_no_edges(spark):
    df = spark.createDataFrame([], "l bigint, r bigint, confidence double")
    assert maximal(df).count() == 0 and assigned(df).count() == 0


def test_components(spark):
    edges = [(i, i, 1.0) for i in range(200)] + [(i + 1, i, 1.0) for i in range(199) if i != 120] + [(900, 500, 1.0)]
    rows = components(spark.createDataFrame(edges, "l bigint, r bigint, confidence double").repartition(3)).collect()
    assert len(rows) == len(edges) and all(r.component == (900 if r.l == 900 else 0 if r.l <= 120 else 121) for r in rows)


def test_large_components_are_solved_exactly(spark):
    """More edges than the 20,000 beyond which components were once approximated; both orders of the rows give the same."""
    rng = random.Random(7)
    edges = [(a, b, round(0.74 + 0.26 * rng.random(), 6)) for a, b in sorted({(rng.randrange(6000), rng.randrange(6000)) for _ in range(24_000)})]
    df = spark.createDataFrame(edges, "l bigint, r bigint, confidence double")
    exact = sum(edges[i][2] for i in best_assignment(edges))
    got, again = assigned(df).collect(), assigned(df.repartition(5)).collect()
    assert one_to_one(got) and set(got) == set(again) and sum(x.confidence for x in got) == pytest.approx(exact, abs=1e-6)
