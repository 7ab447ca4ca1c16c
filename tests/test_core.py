import itertools
import math
import os
import random
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marquee.functions import scalars as S
from marquee.operators import consensus as C
from marquee.operators import models as O
from marquee.operators.cluster import fuzzy_c_means, knee, pearson_k_means, standardised
from marquee.operators.filters import k_core
from marquee.operators.groups import disjoint_groups, hold_out, random_groups, similar_groups, validate_pairs
from marquee.operators.heavy_keys import heavy_keys, key_stats
from marquee.operators import matrix
from marquee.operators.linear import spd_inverse
from marquee.operators.matrix import cosine_pairs
from marquee.operators.metrics import ndcg_cut
from marquee.operators.packed_fields import Segmenter, learn_dictionary, split_packed
from marquee.operators.skew import clustered
from marquee.plans import training_queries as T
from marquee.sources.sinks import RunStore, escape_latex, latex_table

# Packed fields


@pytest.mark.parametrize(
    "text,values",
    [
        (None, []), ("", []), ("  ", []), ("(No Genres LISTED)", []), ('Musical|"War|Home Front"|Comedy', ["Musical", "War|Home Front", "Comedy"]),
        ("Children's • R&B Concert", ["Children's", "R&B Concert"]), ('"The ""Lost"" Reel";Drama', ['The "Lost" Reel', "Drama"]), ("“Song; Dance”/ Sci-Fi ", ["Song; Dance", "Sci-Fi"]), ("a,,b, ,a", ["a", "b", "a"]),
        ('Drama|"Open|Comedy', ["Drama", "Open", "Comedy"]), ("\xa0Crime\xa0", ["Crime"]), ("Heist\tWar", ["Heist", "War"]), ('" "|x', ["x"]), ("Café", ["Café"]), ("War|Home Front", ["War", "Home Front"]),
    ],
)
def test_segments(text, values):
    for known in ([], ["Drama", "War|Home Front", "Home", "Home Front", "Children's"]):
        assert Segmenter(known).values(text) == values


def test_guarded_delimiters():
    assert Segmenter(["War|Home Front"], guard=True).values("Comedy|War|Home Front|War") == ["Comedy", "War|Home Front", "War"]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet='ab "“”|,;-\'&()\t\xa0', max_size=25))
def test_the_dictionary_changes_nothing(text):
    assert Segmenter([]).values(text) == Segmenter(["a", "b", "ab", "a b", "a-b", "a|b"]).values(text)


def test_the_likelier_cover_is_taken():
    known = {"War|Home Front": 5, "War": 3, "Comedy": 900, "Drama": 900, "Comedy/Drama": 1}
    cut = lambda t: Segmenter(known, guard=True).values(t)
    assert cut("Drama|War|Home Front") == ["Drama", "War|Home Front"]
    assert cut("Comedy/Drama") == ["Comedy", "Drama"]  # its parts are likelier
    assert cut("War|Front") == ["War", "Front"]


def test_planted_delimiters_need_the_dictionary(spark):
    rows = [(1, '"War|Home Front"|Comedy'), (2, '"Song; Dance"/Drama'), (3, '"The ""Lost"" Reel",Mystery'), (4, "Comedy,Drama"), (5, "“Food, Drink, Travel”|Heist")] * 2
    df = spark.createDataFrame(rows, "id bigint, genres string")
    planted = spark.createDataFrame([(7, "Comedy|War|Home Front|Heist"), (8, "Drama / Song; Dance"), (9, 'The "Lost" Reel;Comedy'), (10, "Food, Drink, Travel, Drama")], "id bigint, genres string")
    listed = lambda out: {k: [v for _, _, v in g] for k, g in itertools.groupby(sorted(map(tuple, out.collect())), key=lambda r: r[0])}
    want = {7: ["Comedy", "War|Home Front", "Heist"], 8: ["Drama", "Song; Dance"], 9: ['The "Lost" Reel', "Comedy"], 10: ["Food, Drink, Travel", "Drama"]}
    known = learn_dictionary(df, "genres")
    assert listed(split_packed(planted, "id", "genres", guard=True, dictionary=known)) == want
    nothing = listed(split_packed(planted, "id", "genres", guard=True, dictionary=known.limit(0)))
    assert all(nothing[k] != want[k] for k in want)
    assert listed(split_packed(planted, "id", "genres", guard=False, dictionary=known)) == nothing


def test_planted_delimiters_of_the_tables(spark):
    directory = "/root/testdata/sf0.001"
    if not os.path.isdir(directory):
        pytest.skip("no tables")
    listed = lambda df: {k: [r[2] for r in g] for k, g in itertools.groupby(sorted(map(tuple, df.collect())), key=lambda r: r[0])}
    truth = listed(T.p3_found(spark, directory))
    guided = listed(T.p3_guarded(spark, directory))
    bare = listed(split_packed(T.unquoted_genres(spark, directory), "movieId", "genres", guard=True, dictionary=spark.createDataFrame([], "value string, n bigint")))
    right = lambda got: sum(got.get(k) == v for k, v in truth.items()) / len(truth)
    assert right(guided) > right(bare) and right(guided) > 0.97


def test_split_packed(spark):
    df = spark.createDataFrame([(1, "A|B", 0), (1, "A / B", 0), (2, None, 0), (3, "", 0), (None, "C", 0)], "id bigint, genres string, pos int")
    assert {tuple(r) for r in split_packed(df, "id", "genres").collect()} == {(1, 1, "A"), (1, 2, "B"), (None, 1, "C")}
    assert split_packed(df.limit(0), "id", "genres").count() == 0


def test_fields_without_guard_need_no_dictionary(spark, monkeypatch):
    """Nothing is learned or looked up that could not change the result."""
    from marquee.operators import packed_fields

    def fail(*args):
        raise AssertionError("a dictionary has no effect here")

    monkeypatch.setattr(packed_fields, "learn_dictionary", fail)
    monkeypatch.setattr(packed_fields, "relevant", fail)
    df = spark.createDataFrame([(1, 'War|Home Front|"War|Home Front"'), (1, 'War / Home Front / "War|Home Front"'), (2, None)], "id bigint, genres string")
    assert {tuple(r) for r in split_packed(df, "id", "genres").collect()} == {(1, 1, "War"), (1, 2, "Home Front"), (1, 3, "War|Home Front")}


# Heavy keys and layout


def test_heavy_keys(spark):
    rows = [(1, i, 3.0, 5) for i in range(300)] + [(None, 7, None, None)] * 20 + [(2, 7, float("nan"), 1)] * 3
    df = spark.createDataFrame([(*r, 1) for r in rows], "a bigint, b bigint, v double, s bigint, n_rows int")
    got = {(r.key_field, r.key_value): (r.n_rows, r.mean_value) for r in heavy_keys(df, ["a", "b"], "v", "s", 20).collect()}
    assert got == {("a", 1): (300, 3.0), ("b", 7): (24, 3.0)}
    stats = {(r.key_field, r.key_value): r for r in key_stats(df, ["a", "b"], "v", "s", 8).collect()}
    assert stats["a", 2].mean_value is None and stats["a", 2].n_rows == 3 and stats["a", 1].first_at == 5
    assert key_stats(df.limit(0), ["a"], "v", "s").count() == 0


def test_clustered_keeps_keys_together(spark):
    rows = [(1, i % 70) for i in range(60_000)] + [(2, i) for i in range(60_000)] + [(k, 1) for k in range(10, 60)]
    df = spark.createDataFrame(rows, "k bigint, x bigint")
    out = clustered(df, "k", "x", 1000).withColumn("p", F.spark_partition_id())
    spread = out.groupBy("k", "part").agg(F.count_distinct("p").alias("n")).agg(F.max("n")).first()[0]
    parts = {r.k: r.n for r in out.groupBy("k").agg(F.count_distinct("part").alias("n")).collect()}
    assert spread == 1 and parts[1] == 1 and parts[2] > 1 and parts[10] == 1
    assert out.select("k", "x").distinct().count() == df.distinct().count()


# Scalars and models


def test_sigmoid_golden(spark):
    row = spark.range(1).select(*[S.sigmoid_threshold(F.lit(k), F.lit(q), F.lit(10)).alias(f"x{k}{q}") for k, q in ((0, 5), (1, 0), (9, 1))]).first()
    assert tuple(row) == (0, 2, 10)
    p = C.Params("p", policy="sigmoid", center=1, steepness=0.75, c_init=0.2, most=1)
    assert [C.policy_size(p, k, q) for k, q in ((0, 5), (1, 0), (9, 1))] == [0, 2, 10]


def test_group_aggregation_by_hand(spark):
    table = [[2, 9, 5], [4, 1, 5], [6, 2, 2], [8, 4, 1]]  # four members, three items
    scores = spark.createDataFrame([(u, i + 1, float(v)) for u, r in enumerate(table) for i, v in enumerate(r)], "user_id bigint, item_id bigint, score double")
    groups = spark.createDataFrame([(1, [0, 1, 2, 3])], "group_id bigint, members array<bigint>")
    value = lambda how: [r.score for r in O.group_scores(groups, scores, how).orderBy("item_id").collect()]
    assert value("mean") == [5, 4, 3.25] and value("product") == [384, 72, 50] and value("median") == [5, 3, 3.5]
    assert value("min") == [2, 1, 1] and value("max") == [8, 9, 5] and value("sum") == [20, 16, 13]


def _dense(rng, users, items, share=0.4):
    return np.where(rng.random((users, items)) < share, rng.integers(1, 6, (users, items)), 0).astype(float)


def _facts(spark, x, scale=1):
    return spark.createDataFrame([(int(u), int(i) * scale, float(x[u, i])) for u, i in zip(*np.nonzero(x))], "user_id bigint, item_id bigint, rating double")


def _best(s, k):
    return np.argsort(-np.round(s, 9), kind="stable")[:k].tolist()


@pytest.mark.parametrize("norm", ["row", "col"])
@pytest.mark.parametrize("width", [16, 33, None])
def test_ease_against_numpy(spark, norm, width):
    x = _dense(np.random.default_rng(0), 60, 40)
    rated = _facts(spark, x, 7)
    model = O.Ease(rated, norm=norm, width=width).fit(3.0)
    p = np.linalg.inv(x.T @ x + 3.0 * np.eye(40))
    b = -p / (np.diag(p)[:, None] if norm == "row" else np.diag(p)[None, :])
    np.fill_diagonal(b, 0)
    got = {(r.i, r.j): r.b for r in model.weights().collect()}
    assert len(got) == 40 * 39 and all(v == pytest.approx(b[i // 7, j // 7], abs=1e-9) for (i, j), v in got.items())
    s = np.where(x > 0, -np.inf, x @ b)
    rows = {(r.user_id, r.place): r.item_id for r in model.scores(rated, 5).collect()}
    assert all(rows[u, k + 1] == 7 * i for u in range(60) for k, i in enumerate(_best(s[u], 5)))


def test_user_based_ease(spark):
    x = _dense(np.random.default_rng(1), 50, 30)
    model = O.Ease(_facts(spark, x), norm="col", row="item_id", col="user_id", width=16).fit(3.0)
    p = np.linalg.inv(x @ x.T + 3.0 * np.eye(50))
    b = -p / np.diag(p)[None, :]
    np.fill_diagonal(b, 0)
    s = np.where(x > 0, -np.inf, (x.T @ b).T)
    rows = {(r.user_id, r.place): r.item_id for r in model.column_scores(_facts(spark, x), 4).collect()}
    assert all(rows[u, k + 1] == i for u in range(50) for k, i in enumerate(_best(s[u], 4)))


@pytest.mark.parametrize("users,items", [(50, 30), (30, 50)])
def test_user_based_ease_inverts_the_smaller_side(spark, monkeypatch, users, items):
    """rec3_user_based_top10 always inverted users by users, however many they are."""
    from marquee.operators.linear import BlockMatrix
    from marquee.plans import model_queries as Q

    x, sizes, made = _dense(np.random.default_rng(4), users, items), [], BlockMatrix.of_cells
    monkeypatch.setattr(BlockMatrix, "of_cells", lambda cells, n, width=None: sizes.append(n) or made(cells, n, 16))
    monkeypatch.setattr(Q, "split", lambda s, d: (_facts(spark, x), None))
    p = np.linalg.inv(x @ x.T + 500.0 * np.eye(users))
    b = -p / np.diag(p)[None, :]
    np.fill_diagonal(b, 0)
    s = np.where(x > 0, -np.inf, (x.T @ b).T)
    rows = Q.QUERIES["rec3_user_based_top10"](spark, "").collect()
    assert sizes == [30] and len(rows) == np.minimum((x == 0).sum(axis=1), 10).sum()
    assert all(r.item_id == _best(s[r.user_id], 10)[r.place - 1] and r.score == pytest.approx(s[r.user_id, r.item_id], abs=6e-5) for r in rows)


def test_ease_keeps_no_matrix_it_has_used_up(spark, monkeypatch):
    """rec1, rec3, rec15, con18 and con20 kept the Gram matrix beside the inverse, rec16 the inverses of all penalties."""
    from marquee.operators import linear
    from marquee.plans import model_queries as Q

    rated, made, deleted = _facts(spark, _dense(np.random.default_rng(5), 40, 30)), [], []
    real_scratch, real_removed = linear.scratch, linear.removed
    monkeypatch.setattr(linear, "scratch", lambda s, name: made.append(real_scratch(s, name)) or made[-1])
    for module in (linear, O):
        monkeypatch.setattr(module, "removed", lambda s, path: deleted.append(path) or real_removed(s, path), raising=False)
    monkeypatch.setattr(Q, "R", lambda s, d: rated)
    monkeypatch.setattr(Q, "split", lambda s, d: (rated, rated.where("item_id < 5").select("user_id", "item_id")))
    for name, kept in (("rec1_ease_weights", 1), ("rec3_ease_columns_top10", 1), ("rec16_penalty_sweep", 1)):
        made.clear(), deleted.clear()
        rows = Q.QUERIES[name](spark, "").collect()
        assert rows and len(set(made) - set(deleted)) == kept, name


def test_ease_of_nothing(spark):
    empty = spark.createDataFrame([], "user_id bigint, item_id bigint, rating double")
    model = O.Ease(empty).fit(1.0)
    assert model.weights().count() == 0 and model.scores(empty, 3).count() == 0


def test_spd_inverse():
    a = np.random.default_rng(2).normal(size=(30, 9))
    m = a.T @ a + np.eye(9)
    assert np.allclose(spd_inverse(m) @ m, np.eye(9))
    with pytest.raises(ValueError):
        spd_inverse(-np.eye(2))


def test_unseen_items_below_a_rated_head(spark):
    order = list(range(1500))  # best first
    scores = spark.createDataFrame([(i, float(2000 - i)) for i in order], "item_id bigint, score double")
    seen = {1: set(range(1200)), 2: {0, 2, 4}, 3: set(order), 4: set(range(1, 1500)), 5: set(range(3, 1498))}
    rows = [(u, i) for u, items in seen.items() for i in items] + [(1, 5), (2, 9999), (None, 1)]
    got: dict = {}
    for r in O.recommend_unseen(scores, spark.createDataFrame(rows, "user_id bigint, item_id bigint"), 4).collect():
        got.setdefault(r.user_id, {})[r.place] = r.item_id
    for u, items in seen.items():
        want = [i for i in order if i not in items][:4]
        assert [got.get(u, {})[k] for k in sorted(got.get(u, {}))] == want


@pytest.mark.parametrize("chunk", [2048, 5])
def test_gram_with_hot_rows(spark, chunk):
    x = _dense(np.random.default_rng(3), 12, 40)
    x[0] = 3.0  # a row with every column
    want = x.T @ x
    pairs = matrix.cell_pairs(_facts(spark, x), "user_id", "item_id", "rating", chunk).collect()
    got = np.zeros((40, 40))
    for r in pairs:
        assert r.i <= r.j
        got[r.i, r.j] += r.x * r.y
    assert np.allclose(np.triu(got), np.triu(want)) and len(pairs) == sum(n * (n + 1) // 2 for n in (x > 0).sum(axis=1))


def test_nearest_vectors(spark):
    v = np.random.default_rng(4).normal(size=(40, 4))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "id bigint, v array<double>")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = np.round(unit @ unit.T, 6)
    np.fill_diagonal(s, -np.inf)
    for block in (1, 3):
        rows = {(r.id, r.place): r.other for r in matrix.cosine_neighbours(df, "id", "v", 3, block).collect()}
        assert all(rows[i, k + 1] == j for i in range(40) for k, j in enumerate(_best(s[i], 3)))


def test_ndcg_golden(spark):
    ranking = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3)], "user_id bigint, item_id bigint, place int")
    truth = spark.createDataFrame([(1, 10), (1, 12), (2, 10)], "user_id bigint, item_id bigint")
    got = {r.user_id: r.ndcg for r in ndcg_cut(ranking, truth, 3).collect()}
    assert got[1] == pytest.approx(0.919721, abs=1e-6) and got[2] == 0


def test_small_pieces(spark):
    assert knee([(k, 100 / k) for k in range(1, 30)]) in range(3, 9) and math.isnan(knee([]))
    flat = standardised(spark.createDataFrame([(1, 2.0), (2, 2.0)], "k int, x double"), ["x"]).collect()
    assert [r.x for r in flat] == [0, 0]
    assert escape_latex("a_b & 5%") == r"a\_b \& 5\%"
    text = latex_table(spark.createDataFrame([("x_1", None), ("y", 1.5)], "n string, v double"), bold=lambda r, c: c == "v")
    assert r"x\_1 & --" in text and r"\textbf{1.50}" in text
    core = k_core(spark.createDataFrame([(1, 1, 5.0), (1, 2, 5.0), (2, 1, 5.0), (2, 2, 5.0), (3, 3, 5.0)], "user_id bigint, item_id bigint, rating double"), 2, 2)
    assert {r.user_id for r in core.collect()} == {1, 2}


def test_cosine_pairs(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(30, 5))
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(99, None)], "id bigint, v array<double>")
    rows = cosine_pairs(df, "id", "v", 3).collect()
    assert len({(r.a, r.b) for r in rows}) == len(rows) == 30 * 29 // 2
    assert all(r.sim == pytest.approx(v[r.a] @ v[r.b] / np.linalg.norm(v[r.a]) / np.linalg.norm(v[r.b]), abs=1e-6) for r in rows)


def test_run_store(spark, tmp_path):
    store = RunStore(spark, f"file://{tmp_path}/runs", ["k", "bias"])
    frame = lambda *rows: spark.createDataFrame(rows, "k string, bias string, v int")
    assert store.append(frame(("a", "0", 1), ("b", "1", 2))) == 1
    assert store.upsert(frame(("a", "0", 9))) == 2
    assert {(r.k, r.v) for r in store.merged().collect()} == {("a", 9), ("b", 2)}


# Groups and hold-out


def test_groups_and_hold_out(spark):
    rng = random.Random(8)
    rated = spark.createDataFrame([(u, i, float(rng.randint(1, 5))) for u in range(40) for i in rng.sample(range(30), 15)], "user_id bigint, item_id bigint, rating double")
    groups = random_groups(rated, 12)
    rows = groups.collect()
    assert len({tuple(r.members) for r in rows}) == 12 and all(len(set(r.members)) == 3 for r in rows)
    train, kept, truth, common = hold_out(groups, rated)
    t = {(r.user_id, r.item_id) for r in truth.collect()}
    left = {(r.user_id, r.item_id) for r in train.collect()}
    assert not t & left and len(t) + len(left) == 40 * 15
    members = {r.group_id: r.members for r in kept.collect()}
    assert all((u, r.item_id) in t for r in common.collect() for u in members[r.group_id])
    alone = disjoint_groups(groups).collect()
    assert len({u for r in alone for u in r.members}) == 3 * len(alone)


def test_similar_groups_are_valid(spark):
    pairs = spark.createDataFrame([(1, 2, 0.5), (1, 3, 0.4), (2, 3, 0.3), (2, 4, 0.9), (3, 4, -0.2)], "a bigint, b bigint, sim double")
    groups = similar_groups(pairs, 0.3)
    assert [list(r.members) for r in groups.collect()] == [[1, 2, 3]]
    assert validate_pairs(groups, pairs, low=0.3).count() == 0 and validate_pairs(groups, pairs, low=0.35).count() == 1


# Consensus


def session(p, n_items=40, users=3, seed=1):
    rng = np.random.default_rng(seed)
    return C.Session(p, 7, list(range(users)), np.arange(n_items), rng.normal(3.5, 1, (users, n_items)))


@pytest.mark.parametrize("p", C.catalogue(10) + C.catalogue(1), ids=lambda p: f"{p.name}-{p.w}")
def test_rounds(p):
    log, found = C.play(session(p))
    assert (log, found) == C.play(session(p))
    by = {}
    for at, u, pos, i, v in log:
        by.setdefault((at, u), []).append((i, v))
    for shown in by.values():
        assert len(shown) <= p.w and len({i for i, _ in shown}) == len(shown)
    if found:
        at, item = found[0]
        assert sum(v == 1 for r, u, pos, i, v in log if i == item and r <= at) >= 3
    if p.approach == "sync":
        for at in {a for a, _ in by}:
            assert len({tuple(i for i, _ in by[at, u]) for u in range(3)}) == 1


def test_positive_bias_is_stricter():
    p = C.Params("p")
    assert C.vote_chances(4, 3.5, 1, p)[2] > C.vote_chances(4, 3.5, 1, C.Params("q", bias=1))[2]
    assert sum(C.vote_chances(4, 3.5, 0, p)) == pytest.approx(1)


def test_distinct_likers_can_only_delay():
    for seed in range(10):
        a, b = (C.play(session(C.Params("p", t=5, distinct_likers=d), seed=seed))[1] for d in (False, True))
        assert not b or (a and a[0][0] <= b[0][0])


def test_outcomes_equal_serial_play(spark):
    p = C.catalogue(5)[:4]
    s = {q.name: session(q, 20) for q in p}
    scores = spark.createDataFrame([(7, u, i, float(s["A0"].scores[u, i])) for u in range(3) for i in range(20)], "group_id bigint, user_id bigint, item_id bigint, score double")
    got = {r.params: (r.found_round, r.item_id) for r in C.outcomes(scores, p).collect()}
    assert got == {n: (C.play(x)[1] or [(None, None)])[0] for n, x in s.items()}


def test_every_member_plays_the_whole_round_budget(spark):
    rng = random.Random(4)
    rows = [(u, i, float(rng.randint(1, 5))) for u in range(8) for i in rng.sample(range(130), 60)] + [(8, 500, 4.0)]
    rated = spark.createDataFrame(rows, "user_id bigint, item_id bigint, rating double")
    groups = spark.createDataFrame([(1, [0, 1, 2]), (2, [6, 7, 8])], "group_id bigint, members array<bigint>")
    model = O.Ease(rated.where("item_id < 500")).fit(3.0)  # user 8 has rated nothing the model has
    chosen = C.Candidates(groups, rated, model)
    strict = [C.Params("S0", "sync", "group", bias=1000.0), C.Params("A1", t=9, bias=1000.0)]  # nobody likes anything
    got = C.outcomes(chosen, strict).collect()
    assert len(got) == 4 and all((r.n_members, r.rounds, r.found_round) == (3, 10, None) for r in got)
    log = C.round_log(chosen, strict[:1]).collect()
    assert len(log) == 2 * 3 * 100 and len({(r.group_id, r.user_id, r.item_id) for r in log}) == len(log)
    scores = {(r.user_id, r.item_id): r.score for r in model.scores(rated.where("item_id < 500"), 130, False).collect()}
    long = spark.createDataFrame([(1, u, i, scores[u, i]) for u in range(3) for i in model.ids.tolist()], "group_id bigint, user_id bigint, item_id bigint, score double")
    free = C.catalogue(10)
    assert sorted(map(tuple, C.outcomes(C.Candidates(groups.where("group_id = 1"), rated, model), free).collect()), key=str) == sorted(map(tuple, C.outcomes(long, free).collect()), key=str)


def test_the_consensus_queries_play_all_items_of_the_model(spark):
    from marquee.plans.consensus_queries import candidates

    chosen = candidates(spark, "/root/testdata/sf0.001")
    n = spark.read.parquet("/root/testdata/sf0.001/ratings.parquet").where("userId is not null and movieId is not null and rating between 0.5 and 5 and not isnan(rating)").select("movieId").distinct().count()
    assert len(chosen.ids) == n >= 100


def test_hybrid_scores_have_the_content_of_every_held_out_pair(spark):
    from marquee.plans import model_queries as Q
    from marquee.sources import views as V

    d = "/root/testdata/sf0.001"
    rated = V.ratings(spark, d)
    _, held = Q.split(spark, d)
    tags = V.genres(spark, d).where(f"genre in {Q._MAIN}")
    every = O.content_scores(rated, tags, tags.select("item_id").distinct())
    content = {(r.user_id, r.item_id): r.score for r in every.join(held, ["user_id", "item_id"], "left_semi").collect()}
    near = {(r.user_id, r.item_id): r.est for r in O.knn_predictions(rated, O.similarities(rated, 3), held).collect()}
    got = {(r.user_id, r.item_id): r.score for r in Q.QUERIES["rec14_hybrid_scores"](spark, d).collect()}
    assert got.keys() == near.keys() and all(v == pytest.approx(0.2 * content.get(k, 0) + 0.8 * near[k], abs=1e-4) for k, v in got.items())
    popular = {r.item_id for r in O.popular_items(rated, 50).collect()}
    assert any(i not in popular for _, i in content)


def _pearson_labels(v, first, rounds):
    """Labels of correlation k-means by NumPy after at most so many rounds, and the number played."""
    unit = lambda x: (x - x.mean(axis=1, keepdims=True)) / np.linalg.norm(x - x.mean(axis=1, keepdims=True), axis=1, keepdims=True)
    v, played = unit(v), 0
    centres = v[first]
    for played in range(1, rounds + 1):
        labels = (v @ unit(centres).T).argmax(axis=1)
        moved = np.array([v[labels == k].mean(axis=0) if (labels == k).any() else c for k, c in enumerate(centres)])
        done, centres = np.allclose(moved, centres, atol=1e-4), moved
        if done:
            break
    return (v @ unit(centres).T).argmax(axis=1), played


def test_pearson_k_means_plays_until_centres_rest(spark):
    from marquee.plans.model_queries import QUERIES

    d = "/root/testdata/sf0.01"
    rows = sorted((r.vec_id, r.embedding) for r in spark.read.parquet(f"{d}/embeddings.parquet").where("vec_id is not null and embedding is not null").collect())
    ids, v = [r[0] for r in rows], np.array([r[1] for r in rows], float)
    first = sorted(range(len(ids)), key=lambda k: (ids[k] * 40503 % 1000003, ids[k]))[:8]
    wanted, played = _pearson_labels(v, first, 1000)
    assert played > 6 and (wanted != _pearson_labels(v, first, 6)[0]).any()
    got = {r.vec_id: r.cluster for r in QUERIES["clu4_pearson_k_means"](spark, d).collect()}
    assert [got[i] for i in ids] == wanted.tolist()


def test_centres_that_still_move_are_reported(spark):
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(np.random.default_rng(5).normal(size=(60, 4)))], "id bigint, v array<double>")
    for run in (pearson_k_means, fuzzy_c_means):
        with pytest.warns(RuntimeWarning, match="still move after 1 rounds"):
            run(df, "id", "v", 4, most=1)


def test_unseen_items_of_the_whole_catalogue(spark):
    from marquee.operators.ranking import unseen_summary

    rng = random.Random(6)
    seen = {1: set(range(40)), 2: set(range(39)), 3: {39}, 4: {0, 1, 3}} | {u: set(rng.sample(range(40), rng.randint(1, 39))) for u in range(5, 30)}
    rated = spark.createDataFrame([(u, 10 * i) for u, items in seen.items() for i in items], "user_id bigint, item_id bigint")
    wanted = {u: (40 - len(items), 10 * min(set(range(40)) - items)) for u, items in seen.items() if len(items) < 40}
    assert {r.user_id: (r.n_unseen, r.first_item) for r in unseen_summary(rated).collect()} == wanted


@pytest.mark.parametrize("name", ["joi11_unseen_candidates", "rec10_content_topk", "rec4_popularity_topk"])
def test_whole_queries_same_as_sql(spark, name):
    from compare import differences

    from marquee.plans import registry

    assert differences(spark, "/root/testdata/sf0.01", name, registry.collect("QUERIES")[name], registry.collect("ORACLE")[name]) == ""


def test_content_top_reaches_the_long_tail(spark):
    rng = random.Random(9)
    genres = {i: rng.sample("abcde", rng.randint(1, 3)) for i in range(80)} | {200: ["a", "b", "c", "d", "e"], 201: ["z"]}
    tags = spark.createDataFrame([(i, g) for i, s in genres.items() for g in s], "item_id bigint, genre string")
    rated = spark.createDataFrame([(u, i, float(rng.randint(1, 5))) for u in range(20) for i in rng.sample(range(80), 3)] + [(99, 201, 4.0)], "user_id bigint, item_id bigint, rating double")
    every = O.content_scores(rated, tags, tags.select("item_id").distinct()).withColumn("score", F.round("score", 4))
    wanted = {}
    for r in sorted(every.collect(), key=lambda r: (r.user_id, -r.score, r.item_id)):
        wanted.setdefault(r.user_id, []).append((r.item_id, r.score))
    got = {}
    for r in sorted(O.content_top(rated, tags, 5).collect(), key=lambda r: (r.user_id, r.place)):
        got.setdefault(r.user_id, []).append((r.item_id, r.score))
    assert got == {u: rows[:5] for u, rows in wanted.items()} and got[99] == [(201, 1.0)]


def test_best_columns_are_those_of_a_stable_sort():
    rng = np.random.default_rng(2)
    for k in (1, 3, 12, 20):
        s = np.where(rng.random((50, 12)) < 0.2, -np.inf, rng.integers(0, 4, (50, 12)).astype(float))
        assert (O.best_columns(s, k) == np.argsort(-s, axis=1, kind="stable")[:, :k]).all()


def test_ease_queries_fit_all_items_the_model_may_have(spark):
    from marquee.plans.model_queries import QUERIES, split

    d = "/root/testdata/sf0.01"
    train, _ = split(spark, d)
    users, items = (train.select(c).distinct().count() for c in ("user_id", "item_id"))
    assert QUERIES["rec2_ease_top10"](spark, d).select("user_id").distinct().count() == users
    rows = QUERIES["rec1_ease_weights"](spark, d)
    n = rows.select("i").distinct().count()
    assert n >= items and rows.where("i <> j").count() == rows.count() == n * (n - 1)


def test_many_groups_lie_in_one_batch(spark):
    """Rows standing for all members, scores row by row and a group's rows over several batches give the same; no group is lost."""
    rng = random.Random(3)
    own = [(g, 3 * g + m, i, rng.randint(1, 10) / 2) for g in range(40) for m in range(3) for i in rng.sample(range(30), 9)]
    means = {i: 2.0 + i / 100 for i in range(30)}
    of_group = {g: sorted({i for h, _, i, _ in own if h == g}) for g in range(40)}
    rated = {(u, i): x for _, u, i, x in own}
    short = spark.createDataFrame([(*r, means[r[2]]) for r in own], "group_id bigint, user_id bigint, item_id bigint, score double, otherwise double")
    full = spark.createDataFrame([(g, 3 * g + m, i, rated.get((3 * g + m, i), means[i])) for g in of_group for m in range(3) for i in of_group[g]], "group_id bigint, user_id bigint, item_id bigint, score double")
    votes = spark.createDataFrame([(g, u, k % 2, i, rng.choice([-1, 0, 1])) for k, (g, u, i, _) in enumerate(own) if k % 9 < 5], "group_id bigint, user_id bigint, round int, item_id bigint, vote int")
    params = [p for p in C.catalogue(10) if p.name in ("A1", "A3", "S1", "H0")]
    rows = lambda df: sorted(map(tuple, df.collect()))
    calls = [lambda s: C.next_round(s, votes, params), lambda s: C.queues(s, votes, params), lambda s: C.profiles(s, votes, params[-1])]
    want = [rows(call(full)) for call in calls]
    assert all(len({r[1] for r in w}) == 40 for w in want)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert [rows(call(short)) for call in calls] == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_votes_of_own_ratings(spark):
    """What own_items gives the round machine as votes is what the view gives; ratings reach it once."""
    from marquee.plans import consensus_queries as Q
    from marquee.sources import views

    directory = "/root/testdata/sf0.001"
    if not os.path.isdir(directory):
        pytest.skip("no tables")
    scores, votes = Q.own_items(spark, directory, 1)
    columns = ["group_id", "user_id", "round", "item_id", "vote"]
    want = views.votes(views.ratings(spark, directory)).where("round < 1").select(columns)
    assert sorted(map(tuple, votes.select(columns).collect())) == sorted(map(tuple, want.collect()))
    assert scores.count() == scores.select("group_id", "user_id", "item_id").distinct().count() and Q.own_items(spark, directory, 0)[1].count() == 0


def _many(n, seed, rounds):
    """Groups of 1 to 4 members in order, with rows of their own items, and votes, some of them twice or on items without scores."""
    rng = random.Random(seed)
    rows = []
    for g in range(n):
        users = [10 * g + m for m in range(rng.randint(1, 4))]
        rated = {u: rng.sample(range(30), rng.randint(1, 9)) for u in users}
        rows += [(g, 0, 0, u, i, rng.randint(1, 10) / 2, 2.0 + i / 100) for u in users for i in sorted(rated[u])]
        played = rng.sample(range(5), rng.randint(0, rounds))
        pool = sorted({i for s in rated.values() for i in s} | {99})
        rows += [(g, 1, k, u, i, float(rng.choice([-1, 0, 1])), np.nan) for k in sorted(played) for u in [*users, 10 * g + 9] for i in sorted(rng.choices(pool, k=4))]
    return [np.array(c) for c in zip(*rows)]


def _rows(columns):
    return sorted(zip(*(np.asarray(c).tolist() for c in columns)))


def _same(got, want):
    got, want = _rows(got), sorted(want)
    assert [r[:-1] for r in got] == [r[:-1] for r in want] and np.allclose([r[-1] for r in got], [r[-1] for r in want], rtol=0, atol=1e-12) and want


def _faster(many, one_by_one, times=3):
    """many() takes less than a part of the time of one_by_one()."""
    took = []
    for f in (many, one_by_one):
        began = time.process_time()
        f()
        took.append(time.process_time() - began)
    assert took[0] * times < took[1], took


def _sessions(batch, p):
    return [C._resumed(p, grid, told) for grid, told in batch.grids()]


def _followed(batch, p):
    out = []
    for session, rounds in _sessions(batch, p):
        for given in rounds:
            session._follow(given)
        voted = sorted({i for given in rounds for v in given.values() for i in v})
        out += [(session.group, u, i, float(session.own[row, session.place[i]])) for row, u in enumerate(session.users) for i in voted]
    return out


def _queued(batch, p):
    out = []
    for session, rounds in _sessions(batch, p):
        for given in rounds:
            session._redistribute(given)
        out += [(session.group, u, i, float(x)) for u in session.users for i, x in session.queue[u].items()]
    return out


def _opened(batch, p):
    return [(session.group, u, pos, i, False) for session, _ in _sessions(batch, p) for u, items in session.recommend({}).items() for pos, i in enumerate(items, 1)]


def _catalogue(*names):
    return [p for p in C.catalogue(10) if p.name in names]


def test_profiles_of_many_groups_at_once():
    (p,) = _catalogue("A3")
    batch = C._Batch(*_many(300, 4, 4))
    _same(batch.followed(p), _followed(batch, p))
    _faster(lambda: batch.followed(p), lambda: _followed(batch, p))


def test_queues_of_many_groups_at_once():
    batch = C._Batch(*_many(300, 5, 4))
    for p in [*_catalogue("A1", "A3"), C.Params("n", priority="normalised")]:
        _same(batch.queued(p), _queued(batch, p))
    _faster(lambda: batch.queued(p), lambda: _queued(batch, p))


def test_openings_of_many_groups_at_once():
    batch = C._Batch(*_many(300, 6, 0))
    for p in [*_catalogue("A0", "A1", "H0", "H1", "S0", "S1"), C.Params("x", "hybrid", preamble=20), C.Params("y", "hybrid", preamble=0), *(C.Params(a, "sync", "group", aggregate=a, w=3) for a in ("min", "max", "median", "geomean"))]:
        assert _rows(batch.opening(p)) == sorted(_opened(batch, p))
    _faster(lambda: batch.opening(p), lambda: _opened(batch, p))


def test_votes_beside_the_ratings_they_come_from(spark):
    """The round machine gives the same for votes beside the scores as for a table of votes, which is not dealt out once more."""
    from marquee.plans import consensus_queries as Q

    directory = "/root/testdata/sf0.001"
    if not os.path.isdir(directory):
        pytest.skip("no tables")
    rows = lambda df: sorted(map(tuple, df.collect()))
    calls = [(0, lambda *x: C.next_round(*x, _catalogue("H0", "A0"))), (1, lambda *x: C.queues(*x, _catalogue("A1", "A3"))), (2, lambda *x: C.profiles(*x, *_catalogue("A3"))), (1, lambda *x: C.next_round(*x, _catalogue("S1")))]
    for rounds, call in calls:
        got, want = (call(*f(spark, directory, rounds)) for f in (Q.own_rows, Q.own_items))
        assert rows(got) == rows(want) != []
        assert got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("Exchange hashpartitioning(group_id") == 1


def test_votes_beside_their_scores_are_not_looked_up(monkeypatch):
    """con3_dynamic_priority took votes out of the rows of scores and looked their cells up again."""
    rng = np.random.default_rng(9)
    keys = np.unique(rng.integers(0, [40, 3, 30], (2000, 3)), axis=0)
    g, u, i = keys[:, 0], keys[:, 0] * 3 + keys[:, 1], keys[:, 2]
    at, vote = rng.integers(0, 3, len(g)), rng.choice([-1.0, 0.0, 1.0, np.nan], len(g))
    x, other = np.where(rng.random(len(g)) < 0.2, np.nan, rng.random(len(g))), rng.random(len(g))
    told = np.flatnonzero(~np.isnan(vote))
    told = told[np.lexsort((i[told], u[told], at[told], g[told]))]
    both = lambda a, b: np.concatenate([a, b])
    want = C._Batch(both(g, g[told]), np.repeat([0, 1], [len(g), len(told)]), both(at * 0, at[told]), both(u, u[told]), both(i, i[told]), both(x, vote[told]), both(other, other[told]))
    monkeypatch.setattr(C._Batch, "_places", None)
    got = C._voted(g, u, i, x, other, at, vote)
    for p in _catalogue("A1", "A3"):
        assert _rows(got.queued(p)) == _rows(want.queued(p)) != []
    assert all(np.array_equal(getattr(got, c), getattr(want, c)) for c in ("scores", "cell", "vote", "at", "items", "users"))


@pytest.mark.parametrize("far", [1, 2**40, 2**61])
def test_places_in_order_of_any_keys(far):
    from marquee.operators.packed_groups import places_in_order

    rng = np.random.default_rng(10)
    major, minor = rng.integers(-3, 4, 500) * far, rng.integers(-3, 4, 500) * far
    order = places_in_order(major, minor)
    assert list(zip(major[order], minor[order])) == sorted(zip(major, minor)) and sorted(order) == list(range(500))
    assert not len(places_in_order(major[:0], minor[:0]))


def test_packed_groups_hold_what_the_views_give(spark, tmp_path):
    """Doubled and odd rows, ranges and packed rows of a few ratings, members left over: groups, ratings, means and votes are those of the views."""
    from marquee.operators import packed_groups as P
    from marquee.plans import consensus_queries as Q
    from marquee.sources import views

    rng = random.Random(8)
    some = [(rng.randint(-5, 40) * 2**33, rng.randint(0, 60), rng.choice([0.5, 2.5, 3.0, 3.5, 5.0, 7.0, float("nan"), None]), rng.choice([None, 0, -3, 5])) for _ in range(2500)]
    spark.createDataFrame([*some, (None, 1, 3.0, 1), (1, None, 3.0, 1)], "userId bigint, movieId bigint, rating double, timestamp bigint").write.parquet(str(tmp_path / "ratings.parquet"))
    directory, rows = str(tmp_path), lambda df: sorted(map(tuple, df.collect()))
    rated = views.ratings(spark, directory)
    assert rated.select("user_id").distinct().count() % 3
    member = views.groups(rated).select("group_id", F.explode("members").alias("user_id"))
    want = rows(rated.join(member, "user_id").select("group_id", "user_id", "item_id", "rating"))
    for each, at_once, packed in ((50, 70, 20), (400, 10_000, 90), (P.EACH, P.AT_ONCE, P.PACKED)):
        groups = P.PackedGroups.of(views.rating_rows(spark, directory), 3, each, at_once, packed)
        assert rows(groups.rows()) == want
        assert rows(groups.means()) == rows(rated.groupBy("item_id").agg(F.round(F.avg("rating"), 6)))
        assert groups.table.count() >= (10 if each == 50 else 1)
    calls = [(0, lambda *x: C.next_round(*x, _catalogue("H0", "A0"))), (1, lambda *x: C.queues(*x, _catalogue("A1", "A3"))), (2, lambda *x: C.profiles(*x, *_catalogue("A3"))), (1, lambda *x: C.next_round(*x, _catalogue("S1")))]
    for rounds, call in calls:
        want = rows(call(*Q.own_items(spark, directory, rounds)))
        packed = call(*Q.own_groups(spark, directory, rounds))
        assert rows(packed) == rows(call(*Q.own_groups(spark, directory, rounds, 3))) == want != []
        assert "Exchange" not in packed._jdf.queryExecution().executedPlan().toString()  # before: three shuffles of all ratings after the first
    none = P.PackedGroups.of(views.rating_rows(spark, directory).where("false"), 3)
    assert none.rows().count() == none.means().count() == 0


def test_queues_reach_the_machine_without_a_shuffle(spark):
    """con3_dynamic_priority reads groups that lie whole; before, ratings were joined with means by item and dealt out again by group."""
    from marquee.plans import consensus_queries as Q

    directory = "/root/testdata/sf0.001"
    if not os.path.isdir(directory):
        pytest.skip("no tables")
    plan = Q.QUERIES["con3_dynamic_priority"](spark, directory)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
