import difflib
import itertools
import random
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marquee.functions import scalars as S
from marquee.operators import cluster as K
from marquee.operators import consensus as C
from marquee.operators import groups as G
from marquee.operators import matrix as M
from marquee.operators import models as O
from marquee.sources.sinks import ProfileLog, best_of, latex_table

RATED = "user_id bigint, item_id bigint, rating double"


def table(rng, users, items, share=0.4):
    return np.where(rng.random((users, items)) < share, rng.integers(1, 6, (users, items)), 0).astype(float)


def facts(spark, x):
    return spark.createDataFrame([(int(u), int(i), float(x[u, i])) for u, i in zip(*np.nonzero(x))], RATED)


# Neighbours


def corated(x, least):
    """{(i, j): (sim, n)} of columns i < j, by definition."""
    out = {}
    for i, j in itertools.combinations(range(x.shape[1]), 2):
        both = (x[:, i] > 0) & (x[:, j] > 0)
        if both.sum() >= least:
            a, b = x[both, i], x[both, j]
            out[i, j] = (a @ b / np.sqrt((a @ a) * (b @ b)), int(both.sum()))
    return out


@pytest.mark.parametrize("chunk", [2048, 6])
@pytest.mark.parametrize("least", [1, 3])
def test_corated_cosine_with_hot_rows(spark, chunk, least):
    x = table(np.random.default_rng(1), 14, 25, 0.3)
    x[:3] = np.random.default_rng(2).integers(1, 6, (3, 25))  # three rows with every column
    got = {(r.i, r.j): (r.sim, r.n) for r in M.corated_cosine(facts(spark, x), "user_id", "item_id", "rating", least, chunk).collect()}
    want = corated(x, least)
    assert got.keys() == want.keys() and all(got[k] == (pytest.approx(want[k][0]), want[k][1]) for k in want)


@pytest.mark.parametrize("by", ["item_id", "user_id"])
def test_predictions_over_the_nearest_that_count(spark, by):
    x = table(np.random.default_rng(3), 30, 20)
    sims = {k: round(v[0], 6) for k, v in corated(x if by == "item_id" else x.T, 2).items()}
    near = lambda i, j: sims.get((min(i, j), max(i, j)), 0.0)
    wanted = [(u, i) for u in range(30) for i in range(20) if x[u, i] == 0][:150]
    rated = facts(spark, x)
    rows = O.similarities(rated, 2) if by == "item_id" else O.similarities(rated, 2, "item_id", "user_id")
    got = {(r.user_id, r.item_id): r.est for r in O.knn_predictions(rated, rows, spark.createDataFrame(wanted, "user_id bigint, item_id bigint"), 4, by).collect()}
    for u, i in wanted:
        own = [(near(i, j), j, x[u, j]) for j in range(20) if x[u, j]] if by == "item_id" else [(near(u, v), v, x[v, i]) for v in range(30) if x[v, i]]
        best = sorted((t for t in own if t[0] > 0), key=lambda t: (-t[0], t[1]))[:4]
        want = sum(t[0] * t[2] for t in best) / sum(t[0] for t in best) if best else x[x > 0].mean()
        assert got[u, i] == pytest.approx(want, abs=1e-6)


def test_memory_knn_needs_enough_ratings(spark):
    x = table(np.random.default_rng(4), 40, 30, 0.5)
    rows = {r.n_ratings: r for r in O.memory_knn_rmse(facts(spark, x), [3, 6], 4, 5).collect()}
    n = (x > 0).sum(axis=1)
    assert rows[3].n_users == (n > 7).sum() and rows[6].n_users == (n > 10).sum() and all(0 < r.rmse < 4 for r in rows.values())


@pytest.mark.parametrize("cells", [10**6, 700])
def test_memory_knn_against_all_pairs(spark, monkeypatch, cells):
    """Hot items that nearly all share, many users alike, one panel and several: as if all pairs were compared; no table of pairs."""
    rng = np.random.default_rng(9)
    x = table(rng, 150, 60, 0.12)
    x[:, 0] = np.where(rng.random(150) < 0.9, rng.integers(1, 11, 150) / 2, 0)
    x[:, 1] = np.where(rng.random(150) < 0.4, rng.integers(1, 11, 150) / 2, 0)
    x[100:, 4:] *= rng.random((50, 56)) < 0.1
    monkeypatch.setattr(O, "gram", lambda *a: pytest.fail("all pairs"))
    monkeypatch.setattr("marquee.operators.knn_errors.FIRST", 3)
    monkeypatch.setattr("marquee.operators.knn_errors.EACH", 2)
    got = {r.n_ratings: r for r in O.memory_knn_rmse(facts(spark, x), [3, 6], 2, 4, cells=cells).collect()}
    m, s, ss = (x > 0).any(axis=0).sum(), x.sum(axis=1), (x * x).sum(axis=1)
    for size in (3, 6):
        errors = []
        for u in range(150):
            items = sorted(np.flatnonzero(x[u]).tolist(), key=lambda i: ((u * 2654435761 + i * 40503 + 42) % 1000003, i))
            if len(items) <= size + 2:
                continue
            mine, rest = items[:size], items[size:]
            a, aa, mean = x[u, mine].sum(), (x[u, mine] ** 2).sum(), x[u, mine].mean()
            others = [v for v in range(150) if v != u and (x[v, mine] > 0).any()]
            sim = {v: round((m * (x[u, mine] @ x[v, mine]) - a * s[v]) / np.sqrt((m * aa - a * a) * (m * ss[v] - s[v] ** 2)), 9) for v in others}
            near = sorted(others, key=lambda v: (-sim[v], v))[:4]
            off = []
            for i in rest:
                by = [v for v in near if x[v, i]]
                total = sum(abs(sim[v]) for v in by)
                off.append(x[u, i] - mean - (sum((x[v, i] - s[v] / (x[v] > 0).sum()) * sim[v] for v in by) / total if total else 0))
            errors.append(np.sqrt(np.mean(np.square(off))))
        assert got[size].n_users == len(errors) > 30 and got[size].rmse == pytest.approx(np.mean(errors), abs=1e-9)


# Factors


def test_factors_recover_a_low_rank_table(spark):
    rng = np.random.default_rng(5)
    x = np.clip(3 + 0.8 * rng.normal(size=(60, 2)) @ rng.normal(size=(2, 40)), 0.5, 5)
    train = rng.random((60, 40)) < 0.7
    rows = lambda keep: spark.createDataFrame([(int(u), int(i), float(x[u, i])) for u, i in zip(*np.nonzero(keep))], RATED)
    held = rows(~train)
    error = lambda est: float(np.sqrt(np.mean([(r.est - r.rating) ** 2 for r in est.collect()])))
    model = O.residual_factors(rows(train), 4)
    mu, users, items = model[:3]
    biases = held.join(users, "user_id").join(items, "item_id").withColumn("est", F.lit(mu) + F.col("bu") + F.col("bi"))
    assert error(O.residual_predictions(model, held)) < 0.8 * error(biases)
    unknown = spark.createDataFrame([(999, 999, 1.0)], RATED)
    assert O.residual_predictions(model, unknown).first().est == pytest.approx(mu)
    users, items = O.factors(rows(train), 3, implicit=True)
    assert users.count() == 60 and len(items.first().features) == 3


# Reranking


def test_recency_rerank(spark):
    scores = spark.createDataFrame([(1, i, 10.0 - i, i + 1) for i in range(6)], "user_id bigint, item_id bigint, score double, place bigint")
    years = spark.createDataFrame([(0, 1950), (1, 2025), (2, 2000), (3, None), (5, 2025)], "item_id bigint, year int")
    got = [(r.item_id, round(r.score, 6)) for r in O.recency_rerank(scores, years, 3, pool=5).orderBy("place").collect()]
    age = {0: 75, 1: 0, 2: 25, 3: 0, 4: 0}  # item 5 is outside the pool
    want = sorted(((i, round((10 - i) * (0.3 + 0.7 * np.exp(-0.05 * a)), 6)) for i, a in age.items()), key=lambda t: (-t[1], t[0]))[:3]
    assert got == want


def test_rescored_items_come_once(spark):
    rated = spark.createDataFrame([(1, 0, 5.0), (1, 3, 4.0), (2, 9, 1.0)], RATED)
    up = spark.createDataFrame([(i, float(i)) for i in range(10)], "item_id bigint, score double")
    down = spark.createDataFrame([(i, -float(i)) for i in range(10)], "item_id bigint, score double")
    items = O.Rescored(rated)
    steps = [{(r.user_id, r.place): r.item_id for r in items.next(x, 3).collect()} for x in (up, down, up)]
    assert [steps[0][1, k] for k in (1, 2, 3)] == [9, 8, 7] and [steps[1][1, k] for k in (1, 2, 3)] == [1, 2, 4]
    assert [steps[2][1, k] for k in (1, 2)] == [6, 5] and (1, 3) not in steps[2] and steps[0][2, 1] == 8


# Clustering


def blobs(spark, centres, each=15, noise=0.02):
    rng = np.random.default_rng(6)
    rows = [(c * each + n, (np.array(v) + noise * rng.normal(size=len(v))).tolist()) for c, v in enumerate(centres) for n in range(each)]
    return spark.createDataFrame([*rows, (None, [0.0] * len(centres[0])), (10_000, None)], "id bigint, v array<double>")


def found(labels, each=15):
    groups = {}
    for r in labels.where("id is not null and id < 10000").collect():
        groups.setdefault(r.id // each, set()).add(r.cluster)
    return groups


CENTRES = [[5, 0, 0, 1], [0, 5, 0, 1], [0, 0, 5, 1]]


def test_k_means_and_its_sweep(spark):
    df = blobs(spark, CENTRES).where("id is not null and v is not null")
    groups = found(K.k_means(df, "id", "v", 3)[0])
    assert all(len(g) == 1 for g in groups.values()) and len(set.union(*groups.values())) == 3
    rows = {r.k: r for r in K.k_means_sweep(df, "id", "v", [1, 2, 3, 4, 5]).collect()}
    assert rows[3].elbow and sum(r.elbow for r in rows.values()) == 1 and rows[1].silhouette is None
    assert rows[3].silhouette == max(r.silhouette for r in rows.values() if r.silhouette is not None) > 0.9


def test_correlation_k_means_fills_empty_clusters(spark):
    labels, cost = K.pearson_k_means(blobs(spark, CENTRES), "id", "v", 3)
    assert len(set.union(*found(labels).values())) == 3
    rows = K.pearson_sweep(blobs(spark, CENTRES), "id", "v", [1, 2, 3, 4]).collect()
    assert [r.k for r in rows if r.elbow] == [3] and rows[2].cost == pytest.approx(cost)


def test_fuzzy_memberships(spark):
    rows = K.fuzzy_c_means(blobs(spark, CENTRES), "id", "v", 3).collect()
    total = {}
    for r in rows:
        total[r.id] = total.get(r.id, 0) + r.membership
    assert len(total) == 45 and all(v == pytest.approx(1) for v in total.values())
    assert min(max(r.membership for r in rows if r.id == i) for i in total) > 0.9


def test_samples_from_clusters(spark):
    rated = spark.createDataFrame([(1, 10, 5.0), (1, 11, 4.0), (1, 12, 1.0), (2, 12, 5.0), (2, 13, 4.0), (3, 14, 3.0)], RATED)
    clusters = spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "user_id bigint, cluster bigint")
    assert {tuple(r) for r in K.pool_of_top_rated(rated, clusters, 1).collect()} == {(0, 10), (1, 12), (1, 14)}
    tags = spark.createDataFrame([(10, "a"), (11, "b"), (12, "b"), (13, "c"), (14, "a")], "item_id bigint, genre string")
    assert {tuple(r) for r in K.pool_of_top_genres(rated, tags, clusters, 1).collect()} == {(0, 10), (0, 14), (1, 11), (1, 12), (1, 10), (1, 14)}
    assert {r.cluster for r in K.user_clusters(rated, tags, ["a", "b", "c"], 2).collect()} == {0, 1}


# Text


def test_sequence_ratio_is_the_library_one():
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abc é") for _ in range(rng.randrange(12)))
    a, b = [word() for _ in range(200)], [word() for _ in range(200)]
    got = S.sequence_ratio.func(pd.Series(a), pd.Series(b))
    assert np.allclose(got, [difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)])


# Groups


def test_evaluation_context(spark):
    rng = random.Random(8)
    rated = spark.createDataFrame([(u, i, float(rng.randint(1, 5))) for u in range(60) for i in rng.sample(range(25), 2 if u % 10 == 0 else 12)], RATED)
    groups = G.random_groups(rated, 20)
    left, kept, truth, common = G.evaluation_context(rated, groups, "train", 3, 5)
    members = {u for r in kept.collect() for u in r.members}
    assert kept.count() and {r.user_id for r in truth.collect()} == members <= {r.user_id for r in left.collect()}
    assert not {(r.user_id, r.item_id) for r in truth.collect()} & {(r.user_id, r.item_id) for r in left.collect()}
    counts = rated.groupBy("user_id").count().where("user_id in (%s)" % ",".join(map(str, members))).agg(F.min("count")).first()[0]
    assert counts >= 3


def test_group_validators(spark):
    pairs = spark.createDataFrame([(1, 2, 0.9), (1, 3, 0.1), (2, 3, 0.2), (1, 4, 0.8), (2, 4, 0.9)], "a bigint, b bigint, sim double")
    groups = spark.createDataFrame([(1, [1, 2, 3]), (2, [1, 2, 4]), (3, [1, 3, 4])], "group_id bigint, members array<bigint>")
    ids = lambda df: {r.group_id for r in df.collect()}
    assert ids(G.validate_pairs(groups, pairs, low=0.7)) == {1, 3} and ids(G.validate_outliers(groups, pairs, 0.7, 0.3)) == {2, 3}
    rated = spark.createDataFrame([(u, i, 1.0) for u in range(1, 5) for i in range(u)], RATED)
    planted = spark.createDataFrame([(1, [2, 3, 4]), (2, [4, 3, 2]), (3, [2, 2, 3]), (4, [1, 3, 4])], "group_id bigint, members array<bigint>")
    assert ids(G.validate_members(planted, rated, 2)) == {2, 3, 4}


# The round machine


def session(p, scores):
    return C.Session(p, 1, list(range(len(scores))), np.arange(10, 10 + len(scores[0])), np.array(scores, float))


def test_rounds_by_hand():
    """Two members, four items, windows of two, one re-offer; votes are given."""
    s = session(C.Params("A1", t=1, w=2), [[4, 3, 2, 1], [1, 2, 3, 4]])
    assert s.recommend({}) == {0: [10, 11], 1: [13, 12]}
    votes = {0: {10: 1, 11: -1}, 1: {13: 0, 12: 1}}
    assert s.matches(votes) == []
    # 10 waits for member 1 (1 * 1), 12 for member 0 (2 * 1); 11 and 13 were liked by nobody.
    assert s.recommend(votes) == {0: [13, 12], 1: [11, 10]}
    votes = {0: {13: -1, 12: 1}, 1: {11: 0, 10: 1}}
    assert s.matches(votes) == [10, 12] and s.likes[10] == 0
    assert s.recommend(votes) == {0: [], 1: []}


def test_members_leave():
    s = session(C.Params("S0", "sync", "group", w=1), [[4, 3, 2, 1], [4, 1, 2, 3], [1, 1, 9, 1]])
    assert s.recommend({}) == {u: [12] for u in range(3)}
    s.matches({0: {12: 1}, 1: {12: -1}, 2: {12: 1}})
    s.change_members([0, 1], np.array([[4, 3, 2, 1], [4, 1, 2, 3]], float))
    assert s.recommend({0: {12: 1}, 1: {12: -1}}) == {0: [10], 1: [10]} and s.likes[12] == 2


def test_dynamic_profiles_against_a_plain_twin():
    rng = random.Random(9)
    norm = lambda v: [max(x, 0) / sum(max(y, 0) for y in v) for x in v]

    def ordered(p, high, low):
        moves = 0
        for a in high:
            for b in low:
                if moves < 64 and p[a] <= p[b] + 1e-3:
                    p = p[:]
                    p[a] += 0.05
                    p[b] -= 0.05
                    p, moves = norm(p), moves + 1
        return p

    scores = [[rng.random() * 5 for _ in range(12)] for _ in range(3)]
    s = session(C.Params("A3", engine="sts"), scores)
    own, weight = [norm(r) for r in scores], [1.0] * 3
    for _ in range(3):
        crowd = norm([sum(w * o[i] for w, o in zip(weight, own)) / sum(weight) for i in range(12)])
        votes = [{i: rng.choice([-1, 0, 1]) for i in rng.sample(range(12), 4)} for _ in range(3)]
        s._follow({u: {10 + i: v for i, v in given.items()} for u, given in enumerate(votes)})
        for u, given in enumerate(votes):
            kind = {k: [i for i, v in given.items() if v == k] for k in (1, 0, -1)}
            inferred = ordered(ordered(ordered(crowd, kind[1], kind[0]), kind[0], kind[-1]), kind[1], kind[-1])
            own[u] = norm([0.6 * a + 0.4 * b for a, b in zip(own[u], inferred)])
            weight[u] += 4
        assert np.allclose(s.own, own)


def test_bias_makes_members_stricter_on_their_own_scale():
    p = C.Params("x", threshold=3.5, width=1.0, tau=0.7)
    z = lambda bias, sigma: C.vote_chances(4.0, 3.0, sigma, C.replace(p, bias=bias))[2]
    like = lambda score, mean, sigma, bias: 1 / (1 + np.exp(-((score - mean) / sigma - (3.5 - mean) / sigma - bias) / 0.7))
    for bias, sigma in itertools.product((0.0, 1.0), (0.5, 2.0)):
        a, d = like(4.0, 3.0, sigma, bias), 1 / (1 + np.exp(-((2.5 - 3.0) / sigma + bias - (4.0 - 3.0) / sigma) / 0.7))
        assert z(bias, sigma) == pytest.approx(a / (a + d + max(0, 1 - a - d)))


# Sinks


def test_profile_log(spark, tmp_path):
    log = ProfileLog(spark, f"file://{tmp_path}", "x", tag="t")
    with pytest.raises(ValueError), log.timed("fails"):
        raise ValueError
    rows = {r.stage: r for r in spark.read.json(log.write()).collect()}
    assert rows["fails"].duration_s >= 0 and rows["session.start"].extra == '{"tag": "t"}'
    off = ProfileLog(spark, f"file://{tmp_path}", "off", enabled=False)
    off.write()
    assert not (tmp_path / "off").exists()


def test_best_cells(spark):
    df = spark.createDataFrame([("a", 1.0, 4.0), ("b", 2.0, 3.0)], "n string, x double, y double")
    text = latex_table(df, bold=best_of(df, ["x", "y"]), heads=[("", 1), ("both", 2)])
    assert r"a & \textbf{1.00} & 4.00" in text and r"b & 2.00 & \textbf{3.00}" in text and r"\multicolumn{2}{c}{both}" in text


@pytest.mark.parametrize("least", [1, 2, 3])
@pytest.mark.parametrize("cells", [10**6, 150])
def test_predictions_by_users_without_all_pairs(spark, least, cells):
    """Popular items that many share and nothing else, few and many panels, wanted items that are rated, unrated and unknown."""
    from marquee.operators.near_users import near_user_predictions

    rng = np.random.default_rng(least)
    x = table(rng, 60, 40, 0.08)
    x[:, :3] = rng.choice([0, 1.5, 3, 4.5], (60, 3))  # these three make up most of what users share
    rated = facts(spark, x)
    wanted = spark.createDataFrame([(u, i) for u in range(0, 62, 2) for i in range(0, 42) if (u + i) % 3 or i < 3], "user_id bigint, item_id bigint")
    rows = lambda df: {(r.user_id, r.item_id): r.est for r in df.collect()}
    got = rows(near_user_predictions(rated, wanted, 4, least, cells))
    want = rows(O.knn_predictions(rated, O.similarities(rated, least, "item_id", "user_id"), wanted, 4, "user_id"))
    assert got.keys() == want.keys() and len({*want.values()}) > 20
    assert all(got[key] == pytest.approx(want[key], abs=1e-9) for key in want)


def test_predictions_by_users_look_at_few_pairs(spark):
    """4,000 users share three items and nothing else: all their pairs, eight million, took 70 seconds; now kinds of users are compared (7)."""
    from marquee.operators.near_users import near_user_predictions

    rng = np.random.default_rng(5)
    x = rng.integers(1, 11, (4000, 3)) / 2
    wanted = spark.createDataFrame([(u, u % 3) for u in range(0, 4000, 2)], "user_id bigint, item_id bigint")
    began = time.time()
    got = {(r.user_id, r.item_id): r.est for r in near_user_predictions(facts(spark, x), wanted).collect()}
    assert time.time() - began < 40 and len(got) == 2000
    for u in range(0, 4000, 400):
        sim = np.round((x @ x[u]) / np.sqrt((x * x).sum(axis=1) * (x[u] @ x[u])), 6)
        sim[u] = -1
        best = np.lexsort((np.arange(4000), -sim))[:20]
        assert got[u, u % 3] == pytest.approx((sim[best] * x[best, u % 3]).sum() / sim[best].sum())
