"""Queries of models, metrics and clustering."""

from __future__ import annotations

from pyspark.sql import functions as F

from marquee.operators import cluster as C
from marquee.operators import metrics as E
from marquee.operators import models as O
from marquee.operators.matrix import top_k
from marquee.operators.near_users import near_user_predictions
from marquee.plans.registry import Book
from marquee.session import table, written
from marquee.sources import views as V
from marquee.sources.views import GENRES, GROUPS, ITEMS, RATINGS, VOTES

book = Book()
add = book.add
R = V.ratings
TEST = "(user_id * 2654435761 + item_id * 40503 + 42) % 1000003 % 5 = 0"
LIKED = f"(SELECT user_id, item_id FROM {RATINGS} WHERE rating >= 4 AND {TEST})"
TRAIN = f"(SELECT user_id, item_id, rating FROM {RATINGS} WHERE NOT ({TEST}))"
POP = f"(SELECT item_id, sum(rating) AS score FROM {TRAIN} GROUP BY 1)"
RANKED = f"(SELECT user_id, item_id, place FROM (SELECT u.user_id, p.item_id, row_number() OVER (PARTITION BY u.user_id ORDER BY p.score DESC, p.item_id) AS place FROM (SELECT DISTINCT user_id FROM {TRAIN}) u CROSS JOIN {POP} p WHERE NOT EXISTS (SELECT 1 FROM {TRAIN} t WHERE t.user_id = u.user_id AND t.item_id = p.item_id)) WHERE place <= 10)"


def split(s, d):
    rated = R(s, d)
    held = F.expr(TEST)
    return rated.where(~held).select("user_id", "item_id", "rating"), rated.where(held & (F.col("rating") >= 4)).select("user_id", "item_id")


def ranked(s, d):
    train, held = split(s, d)
    return O.recommend_unseen(O.popularity(train), train, 10), held


def r6(c):
    return F.round(c, 6)


@add("rec1_ease_weights")
def _(s, d):
    return O.Ease(R(s, d)).fit(500.0, last=True).weights().withColumn("b", F.round("b", 6))


@add("rec2_ease_top10")
def _(s, d):
    train, _ = split(s, d)
    return O.Ease(train).fit(500.0, last=True).scores(train, 10).withColumn("score", F.round("score", 4))


@add("rec3_ease_columns_top10")
def _(s, d):
    train, _ = split(s, d)
    return O.Ease(train, norm="col").fit(500.0, last=True).scores(train, 10).withColumn("score", F.round("score", 4))


@add("rec4_popularity_topk", f"SELECT user_id, item_id, place FROM {RANKED}")
def _(s, d):
    return ranked(s, d)[0].select("user_id", "item_id", "place")


def _sim_sql(row, col):
    half = f"SELECT a.{col} AS i, b.{col} AS j, round(sum(a.rating * b.rating) / sqrt(sum(a.rating * a.rating) * sum(b.rating * b.rating)), 6) AS sim FROM {RATINGS} a JOIN {RATINGS} b ON a.{row} = b.{row} AND a.{col} < b.{col} GROUP BY 1, 2 HAVING count(*) >= 3"
    return f"(SELECT * FROM (SELECT i, j, sim FROM ({half}) UNION ALL SELECT j, i, sim FROM ({half})) WHERE sim > 0)"


def _near_sql(row, col):
    return f"SELECT i, j, place FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY sim DESC, j) AS place FROM {_sim_sql(row, col)}) WHERE place <= 20"


def _knn_sql(row, col):
    """Predictions of the liked test pairs: the 20 nearest that the user (or that users) rated."""
    return f"""WITH r AS MATERIALIZED (SELECT user_id, item_id, rating FROM {RATINGS}), t AS {LIKED}, n AS MATERIALIZED {_sim_sql(row, col)}, h AS (SELECT t.user_id, t.item_id, n.sim, r.rating, row_number() OVER (PARTITION BY t.user_id, t.item_id ORDER BY n.sim DESC, n.j) AS k FROM t JOIN r ON r.{row} = t.{row} JOIN n ON n.i = t.{col} AND n.j = r.{col}),
    e AS (SELECT user_id, item_id, sum(sim * rating) / sum(sim) AS est FROM h WHERE k <= 20 GROUP BY 1, 2) SELECT t.user_id, t.item_id, round(coalesce(e.est, (SELECT avg(rating) FROM r)), 4) AS est FROM t LEFT JOIN e ON e.user_id = t.user_id AND e.item_id = t.item_id"""


@add("rec5_item_neighbours", _near_sql("user_id", "item_id"))
def _(s, d):
    return O.neighbours(R(s, d), 20, 3).select("i", "j", "place")


@add("rec5_user_neighbours", _near_sql("item_id", "user_id"))
def _(s, d):
    return O.neighbours(R(s, d), 20, 3, "item_id", "user_id").select("i", "j", "place")


@add("rec5_knn_predictions", _knn_sql("user_id", "item_id"))
def _(s, d):
    rated = R(s, d)
    _, held = split(s, d)
    return O.knn_predictions(rated, O.similarities(rated, 3), held).withColumn("est", F.round("est", 4))


@add("rec5_user_predictions", _knn_sql("item_id", "user_id"))
def _(s, d):
    rated = written(R(s, d).select("user_id", "item_id", "rating"), "rated")
    held = rated.where(F.expr(TEST) & (F.col("rating") >= 4))
    return near_user_predictions(rated, held, 20, 3).withColumn("est", F.round("est", 4))


@add("rec3_user_based_top10")
def _(s, d):
    train, _ = split(s, d)
    return O.user_based(train, 500.0, 10).withColumn("score", F.round("score", 4))


_SIZES = [5, 10, 15, 20]
_KNN_SIZE = """SELECT {n} AS n_ratings, count(*) AS n_users, round(avg(rmse), 4) AS rmse FROM (SELECT user_id, sqrt(avg((truth - mean - coalesce(moved, 0)) ** 2)) AS rmse FROM (
    SELECT t.user_id, t.item_id, any_value(t.rating) AS truth, any_value(q.mean) AS mean, sum((f.rating - x.other_mean) * x.sim) FILTER (f.rating IS NOT NULL) / sum(abs(x.sim)) FILTER (f.rating IS NOT NULL) AS moved
    FROM o t JOIN q{n} q ON q.user_id = t.user_id LEFT JOIN x{n} x ON x.user_id = t.user_id LEFT JOIN f ON f.user_id = x.other AND f.item_id = t.item_id WHERE t.i > {n} GROUP BY 1, 2) GROUP BY 1)"""
_KNN_STEPS = """q{n} AS MATERIALIZED (SELECT user_id, sum(rating) AS a, sum(rating * rating) AS aa, avg(rating) AS mean FROM o WHERE n > {n} + 5 AND i <= {n} GROUP BY 1),
    d{n} AS (SELECT o.user_id, f.user_id AS other, sum(o.rating * f.rating) AS xy FROM o JOIN f ON f.item_id = o.item_id AND f.user_id <> o.user_id WHERE o.n > {n} + 5 AND o.i <= {n} GROUP BY 1, 2),
    c{n} AS (SELECT d.user_id, d.other, round(({m} * xy - q.a * u.s) / sqrt(({m} * q.aa - q.a * q.a) * ({m} * u.ss - u.s * u.s)), 9) AS sim, u.s / u.n AS other_mean FROM d{n} d JOIN q{n} q ON q.user_id = d.user_id JOIN u ON u.user_id = d.other),
    x{n} AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY sim DESC, other) AS k FROM c{n}) WHERE k <= 9)"""
_N_ITEMS = "(SELECT count(DISTINCT item_id) FROM f)"


@add("rec9_rmse_by_ratings", f"WITH f AS MATERIALIZED (SELECT user_id, item_id, rating FROM {RATINGS}), u AS (SELECT user_id, count(*) AS n, sum(rating) AS s, sum(rating * rating) AS ss FROM f GROUP BY 1), o AS MATERIALIZED (SELECT f.*, u.n, row_number() OVER (PARTITION BY f.user_id ORDER BY (f.user_id * 2654435761 + f.item_id * 40503 + 42) % 1000003, f.item_id) AS i FROM f JOIN u USING (user_id)), " + ", ".join(_KNN_STEPS.format(n=n, m=_N_ITEMS) for n in _SIZES) + " " + " UNION ALL ".join(_KNN_SIZE.format(n=n) for n in _SIZES))
def _(s, d):
    return O.memory_knn_rmse(R(s, d), _SIZES).withColumn("rmse", F.round("rmse", 4))


@add("rec15_recency_rerank")
def _(s, d):
    train, _ = split(s, d)
    return O.recency_rerank(O.Ease(train).fit(500.0, last=True).scores(train, 50), V.items(s, d), 10).withColumn("score", F.round("score", 4))


@add("rec16_neighbour_sweep")
def _(s, d):
    train, _ = split(s, d)
    held = R(s, d).where(TEST).select("user_id", "item_id", "rating")
    return O.neighbour_sweep(train, held, [5, 10, 20, 40], 3).withColumn("rmse", F.round("rmse", 4))


_MEANS = f"(SELECT item_id, round(avg(rating), 6) AS score FROM {RATINGS} GROUP BY 1)"
_COUNTS = f"(SELECT item_id, count(*) AS score FROM {RATINGS} GROUP BY 1)"


def _unseen_sql(scores, gone, k):
    return f"(SELECT user_id, item_id, place FROM (SELECT u.user_id, p.item_id, row_number() OVER (PARTITION BY u.user_id ORDER BY p.score DESC, p.item_id) AS place FROM (SELECT DISTINCT user_id FROM {RATINGS}) u CROSS JOIN {scores} p WHERE NOT EXISTS (SELECT 1 FROM {gone} t WHERE t.user_id = u.user_id AND t.item_id = p.item_id)) WHERE place <= {k})"


_STEP1 = _unseen_sql(_COUNTS, RATINGS, 5)


@add("win2_rescored", f"WITH a AS MATERIALIZED {_STEP1}, gone AS MATERIALIZED (SELECT user_id, item_id FROM {RATINGS} UNION ALL SELECT user_id, item_id FROM a) SELECT 1 AS step, user_id, item_id, place FROM a UNION ALL SELECT 2, user_id, item_id, place FROM {_unseen_sql(_MEANS, 'gone', 5)}")
def _(s, d):
    rated = R(s, d)
    items = O.Rescored(rated)
    by_count = rated.groupBy("item_id").agg(F.count("*").cast("double").alias("score"))
    by_mean = rated.groupBy("item_id").agg(F.round(F.avg("rating"), 6).alias("score"))
    steps = [items.next(by_count, 5).withColumn("step", F.lit(1)), items.next(by_mean, 5).withColumn("step", F.lit(2))]
    return steps[0].unionByName(steps[1]).select("step", "user_id", "item_id", "place")


@add("win4_masked_topk", f"SELECT user_id, item_id, place FROM {_unseen_sql(_MEANS, RATINGS, 5)}")
def _(s, d):
    rated = R(s, d)
    means = rated.groupBy("item_id").agg(F.round(F.avg("rating"), 6).alias("score"))
    return O.recommend_unseen(means, rated, 5).select("user_id", "item_id", "place")


@add("rec6_residual_predictions")
def _(s, d):
    rated = R(s, d)
    train, _ = split(s, d)
    held = rated.where(TEST).select("user_id", "item_id", "rating")
    return O.residual_predictions(O.residual_factors(train, 8), held).select("user_id", "item_id", F.round("est", 3).alias("est"))


@add("rec7_baseline_biases", f"""WITH r AS {RATINGS}, m AS (SELECT avg(rating) AS mu FROM r), i1 AS (SELECT item_id, sum(rating - mu) / (10 + count(*)) AS bi FROM r, m GROUP BY 1), u1 AS (SELECT user_id, sum(rating - mu - bi) / (15 + count(*)) AS bu FROM r JOIN i1 USING (item_id), m GROUP BY 1),
    i2 AS (SELECT item_id, sum(rating - mu - bu) / (10 + count(*)) AS bi FROM r JOIN u1 USING (user_id), m GROUP BY 1), u2 AS (SELECT user_id, sum(rating - mu - bi) / (15 + count(*)) AS bu FROM r JOIN i2 USING (item_id), m GROUP BY 1) SELECT user_id, round(bu, 4) AS bu FROM u2""")
def _(s, d):
    return O.baseline_biases(R(s, d))[1].select("user_id", F.round("bu", 4).alias("bu"))


@add("rec8_user_embeddings")
def _(s, d):
    users, _ = O.factors(R(s, d), 16, implicit=True)
    return users.select(F.col("id").cast("bigint").alias("user_id"), F.posexplode("features").alias("dim", "x")).withColumn("x", F.round("x", 4))


_MAIN = "('action', 'adventure', 'animation', 'comedy', 'crime', 'documentary', 'drama', 'fantasy', 'horror', 'musical', 'mystery', 'romance', 'sci-fi', 'thriller', 'war')"


@add("rec10_content_topk", f"""WITH g AS (SELECT item_id, genre, 1 / sqrt(count(*) OVER (PARTITION BY item_id)) AS x FROM {GENRES} WHERE genre IN {_MAIN}), p AS (SELECT user_id, genre, sum(rating * x) AS p FROM {RATINGS} JOIN g USING (item_id) GROUP BY 1, 2), l AS (SELECT user_id, sqrt(sum(p * p)) AS len FROM p GROUP BY 1),
    s AS (SELECT p.user_id, g.item_id, round(sum(p.p * g.x) / max(l.len), 4) AS score FROM p JOIN g USING (genre) JOIN l ON l.user_id = p.user_id GROUP BY 1, 2)
    SELECT user_id, item_id, place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS place FROM s) WHERE place <= 5""")
def _(s, d):
    return O.content_top(R(s, d), V.genres(s, d).where(f"genre in {_MAIN}"), 5).select("user_id", "item_id", "place")


def _group_sql(agg):
    return f"SELECT g.group_id, r.item_id, round({agg}, 4) AS score FROM (SELECT group_id, unnest(members) AS user_id FROM {GROUPS}) g JOIN {RATINGS} r USING (user_id) GROUP BY 1, 2"


def _group(how):
    def run(s, d):
        rated = R(s, d)
        return O.group_scores(V.groups(rated), rated.select("user_id", "item_id", F.col("rating").alias("score")), how).withColumn("score", F.round("score", 4))

    return run


for _name, _agg in {"mean": "avg(rating)", "min": "min(rating)", "max": "max(rating)", "median": "median(rating)", "geomean": "exp(avg(ln(greatest(rating, 1e-12))))"}.items():
    add(f"rec11_group_{_name}", _group_sql(_agg))(_group(_name))


@add("rec11_group_plurality", f"SELECT group_id, item_id, CAST(count(*) AS DOUBLE) AS score FROM (SELECT g.group_id, r.item_id, row_number() OVER (PARTITION BY g.group_id, r.user_id ORDER BY rating DESC, item_id) AS i FROM (SELECT group_id, unnest(members) AS user_id FROM {GROUPS}) g JOIN {RATINGS} r USING (user_id)) WHERE i = 1 GROUP BY 1, 2")
def _(s, d):
    return _group("plurality")(s, d)


@add("rec12_profile_mean", f"SELECT g.group_id, r.item_id, round(sum(rating) / 3, 6) AS rating FROM (SELECT group_id, unnest(members) AS user_id FROM {GROUPS}) g JOIN {RATINGS} r USING (user_id) GROUP BY 1, 2")
def _(s, d):
    rated = R(s, d)
    return O.group_profiles(V.groups(rated), rated).withColumn("rating", r6("rating"))


@add("rec12_profile_median", f"SELECT g.group_id, r.item_id, CASE WHEN count(*) = 1 THEN 0.0 WHEN count(*) = 2 THEN min(rating) ELSE median(rating) END AS rating FROM (SELECT group_id, unnest(members) AS user_id FROM {GROUPS}) g JOIN {RATINGS} r USING (user_id) GROUP BY 1, 2")
def _(s, d):
    rated = R(s, d)
    return O.group_profiles(V.groups(rated), rated, "median")


_STARS = f"(SELECT group_id, item_id, avg(CASE vote WHEN 1 THEN 5.0 WHEN 0 THEN 3.0 ELSE 1.0 END) AS v FROM {VOTES} WHERE round = 0 GROUP BY 1, 2)"


@add("rec13_ema_step", f"WITH p AS (SELECT g.group_id, r.item_id, sum(rating) / 3 AS rating FROM (SELECT group_id, unnest(members) AS user_id FROM {GROUPS}) g JOIN {RATINGS} r USING (user_id) GROUP BY 1, 2) SELECT coalesce(p.group_id, v.group_id) AS group_id, coalesce(p.item_id, v.item_id) AS item_id, round(CASE WHEN v.v IS NULL THEN rating ELSE 0.7 * coalesce(rating, 0) + 0.3 * v.v END, 4) AS rating FROM p FULL JOIN {_STARS} v ON v.group_id = p.group_id AND v.item_id = p.item_id")
def _(s, d):
    from marquee.functions.scalars import vote_stars

    rated = R(s, d)
    votes = V.votes(rated).where("round = 0").select("group_id", "item_id", vote_stars("vote").alias("stars"))
    return O.ema_step(O.group_profiles(V.groups(rated), rated), votes, 0.3).withColumn("rating", F.round("rating", 4))


@add("rec13_running_mean_step", f"WITH p AS (SELECT g.group_id, r.item_id, sum(rating) / 3 AS rating FROM (SELECT group_id, unnest(members) AS user_id FROM {GROUPS}) g JOIN {RATINGS} r USING (user_id) GROUP BY 1, 2) SELECT p.group_id, p.item_id, round(coalesce(v.v, rating), 4) AS rating, CASE WHEN v.v IS NULL THEN 0 ELSE 1 END AS n FROM p LEFT JOIN {_STARS} v ON v.group_id = p.group_id AND v.item_id = p.item_id")
def _(s, d):
    from marquee.functions.scalars import vote_stars

    rated = R(s, d)
    votes = V.votes(rated).where("round = 0").select("group_id", "item_id", vote_stars("vote").alias("stars"))
    return O.running_mean_step(O.group_profiles(V.groups(rated), rated).withColumn("n", F.lit(0)), votes).withColumn("rating", F.round("rating", 4))


@add("rec14_hybrid_scores")
def _(s, d):
    rated = R(s, d)
    _, held = split(s, d)
    content = O.content_pair_scores(rated, V.genres(s, d).where(f"genre in {_MAIN}"), held)
    return O.hybrid_scores(content, O.knn_predictions(rated, O.similarities(rated, 3), held)).withColumn("score", F.round("score", 4))


@add("rec16_penalty_sweep")
def _(s, d):
    train, held = split(s, d)
    return O.penalty_sweep(O.Ease(train), train, held, [100.0, 500.0, 1400.0], 20)


@add("met1_ndcg", f"WITH t AS {LIKED}, n AS (SELECT user_id, count(*) AS n FROM t GROUP BY 1), g AS (SELECT user_id, sum(1 / log2(place + 1)) AS dcg FROM {RANKED} JOIN t USING (user_id, item_id) GROUP BY 1) SELECT n.user_id, round(coalesce(dcg, 0) / list_sum(list_transform(range(1, least(n, 10) + 1), lambda j: 1 / log2(j + 1))), 4) AS ndcg FROM n LEFT JOIN g USING (user_id)")
def _(s, d):
    ranking, held = ranked(s, d)
    return E.ndcg_cut(ranking, held, 10).withColumn("ndcg", F.round("ndcg", 4))


@add("met3_prec_recall", f"WITH t AS {LIKED}, n AS (SELECT user_id, count(*) AS n FROM t GROUP BY 1), h AS (SELECT user_id, count(*) AS h FROM {RANKED} JOIN t USING (user_id, item_id) GROUP BY 1) SELECT round(avg(coalesce(h, 0) / 10), 6) AS precision, round(avg(coalesce(h, 0) / n), 6) AS recall FROM n LEFT JOIN h USING (user_id)")
def _(s, d):
    ranking, held = ranked(s, d)
    return E.precision_recall(ranking, held, 10).select(r6("precision").alias("precision"), r6("recall").alias("recall"))


@add("met4_ndcg_list", f"WITH t AS {LIKED}, x AS (SELECT r.user_id, sum(CASE WHEN t.item_id IS NOT NULL THEN 1 / log2(place + 1) ELSE 0 END) AS dcg, count(t.item_id) AS h FROM {RANKED} r LEFT JOIN t ON t.user_id = r.user_id AND t.item_id = r.item_id GROUP BY 1) SELECT user_id, round(dcg / list_sum(list_transform(range(1, greatest(h, 1) + 1), lambda j: 1 / log2(j + 1))), 4) AS ndcg FROM x")
def _(s, d):
    ranking, held = ranked(s, d)
    return E.ndcg_list(ranking, held, 10).withColumn("ndcg", F.round("ndcg", 4))


@add("met5_list_precision", f"WITH l AS (SELECT item_id FROM (SELECT item_id, count(*) AS n FROM {RATINGS} GROUP BY 1) ORDER BY n DESC, item_id LIMIT 24) SELECT round((SELECT count(*) FROM {RATINGS} WHERE rating >= 3.5 AND item_id IN (SELECT item_id FROM l)) / (24 * count(DISTINCT user_id)), 6) AS precision FROM {RATINGS} WHERE rating >= 3.5")
def _(s, d):
    rated = R(s, d)
    return E.list_precision(O.popular_items(rated, 24), rated, 24).select(r6("precision").alias("precision"))


@add("met6_test_item_precision", f"WITH t AS (SELECT user_id, item_id, rating FROM {RATINGS} WHERE {TEST}), p AS (SELECT t.user_id, t.rating, row_number() OVER (PARTITION BY t.user_id ORDER BY coalesce(s.score, 0) DESC, t.item_id) AS place FROM t LEFT JOIN (SELECT item_id, sum(rating) AS score FROM {TRAIN} GROUP BY 1) s ON s.item_id = t.item_id) SELECT user_id, round(sum(CASE WHEN rating >= 4 THEN 1 ELSE 0 END) / 5, 4) AS precision FROM p WHERE place <= 5 GROUP BY 1")
def _(s, d):
    rated = R(s, d)
    test = rated.where(TEST)
    train, _ = split(s, d)
    scored = test.join(O.popularity(train), "item_id", "left").na.fill(0.0, ["score"])
    return top_k(scored, ["user_id"], "score", "item_id", 5).groupBy("user_id").agg(F.round(F.sum(F.expr("int(rating >= 4)")) / 5, 4).alias("precision"))


@add("met7_rmse", f"WITH m AS (SELECT item_id, avg(rating) AS e FROM {TRAIN} GROUP BY 1) SELECT round(sqrt(avg((r.rating - m.e) ** 2)), 4) AS rmse FROM {RATINGS} r JOIN m USING (item_id) WHERE {TEST}")
def _(s, d):
    train, _ = split(s, d)
    means = train.groupBy("item_id").agg(F.avg("rating").alias("e"))
    return E.rmse(R(s, d).where(TEST).join(means, "item_id"), "rating", "e").select(F.round("rmse", 4).alias("rmse"))


@add("met10_k_fold", f"SELECT fold, count(*) AS n, round(sqrt(avg((rating - mu) ** 2)), 4) AS rmse FROM (SELECT rating, (user_id * 2654435761 + item_id * 40503 + 42) % 1000003 % 5 AS fold FROM {RATINGS}), (SELECT avg(rating) AS mu FROM {RATINGS}) GROUP BY fold")
def _(s, d):
    from marquee.operators.splits import k_fold

    rated = R(s, d)
    folded = k_fold(rated, "user_id", "item_id").crossJoin(F.broadcast(rated.agg(F.avg("rating").alias("mu"))))
    return folded.groupBy("fold").agg(F.count("*").alias("n"), F.round(F.sqrt(F.avg(F.pow(F.col("rating") - F.col("mu"), F.lit(2)))), 4).alias("rmse"))


@add("met11_hold_out", f"SELECT user_id, item_id, {TEST} AS test FROM {RATINGS}")
def _(s, d):
    return R(s, d).select("user_id", "item_id", F.expr(TEST).alias("test"))


@add("clu1_standardised", f"WITH c AS (SELECT item_id, count(*) AS n, avg(rating) / 5 AS m FROM {RATINGS} GROUP BY 1) SELECT item_id, round((n - avg(n) OVER ()) / stddev_pop(n) OVER (), 4) AS n, round((m - avg(m) OVER ()) / stddev_pop(m) OVER (), 4) AS m FROM c")
def _(s, d):
    c = R(s, d).groupBy("item_id").agg(F.count("*").cast("double").alias("n"), (F.avg("rating") / 5).alias("m"))
    return C.standardised(c, ["n", "m"]).select("item_id", F.round("n", 4).alias("n"), F.round("m", 4).alias("m"))


_GENRE_LIST = [g.strip(" '") for g in _MAIN.strip("()").split(",")]


@add("clu1_features", f"""WITH c AS (SELECT item_id, count(*) AS n, avg(rating) / 5 AS m FROM {RATINGS} GROUP BY 1), g AS (SELECT DISTINCT item_id, genre FROM {GENRES}), names AS (SELECT unnest([{", ".join(repr(g) for g in _GENRE_LIST)}]) AS feature),
    x AS (SELECT c.item_id, feature, CASE WHEN g.item_id IS NULL THEN 0.0 ELSE 1.0 END AS x FROM c CROSS JOIN names LEFT JOIN g ON g.item_id = c.item_id AND g.genre = feature UNION ALL SELECT item_id, 'popularity', (n - min(n) OVER ()) / (max(n) OVER () - min(n) OVER ()) FROM c UNION ALL SELECT item_id, 'rating', m FROM c)
    SELECT item_id, feature, round(CASE WHEN s > 0 THEN (x - a) / s ELSE 0 END, 4) AS value FROM (SELECT *, avg(x) OVER (PARTITION BY feature) AS a, stddev_pop(x) OVER (PARTITION BY feature) AS s FROM x)""")
def _(s, d):
    vectors = C.item_features(R(s, d), V.genres(s, d), _GENRE_LIST)
    return vectors.select("item_id", F.explode(F.map_from_arrays(F.array(*map(F.lit, [*_GENRE_LIST, "popularity", "rating"])), "features")).alias("feature", "value")).withColumn("value", F.round("value", 4))


@add("clu2_sweep")
def _(s, d):
    return C.k_means_sweep(C.item_features(R(s, d), V.genres(s, d), _GENRE_LIST), "item_id", "features", [2, 3, 4, 5, 6, 8, 10, 12, 16, 20])


@add("clu5_correlation_sweep")
def _(s, d):
    return C.pearson_sweep(table(s, d, "embeddings"), "vec_id", "embedding", [1, 2, 3, 4, 6, 8])


@add("clu2_k_means")
def _(s, d):
    return C.k_means(table(s, d, "embeddings"), "vec_id", "embedding", 10)[0]


@add("clu3_fuzzy_c_means")
def _(s, d):
    return C.fuzzy_c_means(table(s, d, "embeddings"), "vec_id", "embedding", 5).withColumn("membership", F.round("membership", 4))


@add("clu4_pearson_k_means")
def _(s, d):
    return C.pearson_k_means(table(s, d, "embeddings"), "vec_id", "embedding", 8)[0]


_C = f"(SELECT user_id, item_id, rating, (user_id * 2654435761 + item_id * 40503 + 42) % 1000003 AS h FROM {RATINGS})"


@add("smp1_cluster_sample", f"WITH x AS (SELECT u.user_id % 7 AS cluster, r.item_id, count(*) AS n FROM {RATINGS} r JOIN (SELECT DISTINCT user_id FROM {RATINGS}) u USING (user_id) GROUP BY 1, 2), t AS (SELECT cluster, item_id, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, item_id) AS place FROM x) SELECT cluster, item_id FROM (SELECT cluster, item_id, row_number() OVER (PARTITION BY cluster ORDER BY (item_id * 40503) % 1000003, item_id) AS rn FROM t WHERE place <= 100) ORDER BY rn, cluster LIMIT 24")
def _(s, d):
    counts = R(s, d).groupBy((F.col("user_id") % 7).alias("cluster"), "item_id").agg(F.count("*").alias("n"))
    pool = top_k(counts, ["cluster"], "n", "item_id", 100).select("cluster", "item_id")
    return C.round_robin(pool, "cluster", "item_id", 24)


_CLUSTERS = f"(SELECT user_id, user_id % 7 AS cluster FROM {RATINGS} GROUP BY 1)"
_ROBIN = "SELECT cluster, item_id FROM (SELECT cluster, item_id, row_number() OVER (PARTITION BY cluster ORDER BY (item_id * 40503) % 1000003, item_id) AS rn FROM (SELECT DISTINCT cluster, item_id FROM {pool})) ORDER BY rn, cluster LIMIT 24"
_TOP5 = f"(SELECT cluster, item_id FROM (SELECT c.cluster, r.item_id, row_number() OVER (PARTITION BY r.user_id ORDER BY r.rating DESC, r.item_id) AS k FROM {RATINGS} r JOIN {_CLUSTERS} c USING (user_id)) WHERE k <= 5)"
_TOP_GENRES = f"(SELECT c.cluster, g.item_id FROM (SELECT user_id, genre FROM (SELECT user_id, genre, row_number() OVER (PARTITION BY user_id ORDER BY round(avg(rating), 6) DESC, genre) AS k FROM {RATINGS} JOIN {GENRES} USING (item_id) GROUP BY 1, 2) WHERE k <= 3) t JOIN {_CLUSTERS} c USING (user_id) JOIN {GENRES} g USING (genre))"


def _user_clusters(s, d):
    return R(s, d).select("user_id", (F.col("user_id") % 7).alias("cluster")).distinct()


@add("smp1_top_rated", _ROBIN.format(pool=_TOP5))
def _(s, d):
    return C.round_robin(C.pool_of_top_rated(R(s, d), _user_clusters(s, d), 5), "cluster", "item_id", 24)


@add("smp1_top_genres", _ROBIN.format(pool=_TOP_GENRES))
def _(s, d):
    return C.round_robin(C.pool_of_top_genres(R(s, d), V.genres(s, d), _user_clusters(s, d), 3), "cluster", "item_id", 24)


@add("smp1_k_means_users")
def _(s, d):
    rated, tags = R(s, d), V.genres(s, d)
    return C.round_robin(C.pool_of_top_rated(rated, C.user_clusters(rated, tags, _GENRE_LIST, 7), 5), "cluster", "item_id", 24)


@add("smp2_of_top", f"SELECT item_id FROM (SELECT item_id, count(*) AS n FROM {RATINGS} GROUP BY 1 ORDER BY n DESC, item_id LIMIT 100) ORDER BY (item_id * 40503) % 1000003, item_id LIMIT 24")
def _(s, d):
    return O.popular_items(R(s, d), 100).orderBy((F.col("item_id") * 40503) % 1000003, "item_id").limit(24)


@add("smp3_stratified", f"SELECT user_id, item_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY h, item_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM {_C}) WHERE i <= round_even(n * 0.25, 0) ORDER BY h, user_id, item_id LIMIT 1000")
def _(s, d):
    return C.stratified_sample(R(s, d), "user_id", "item_id", 0.25, 1000).select("user_id", "item_id")


@add("smp4_method_metrics")
def _(s, d):
    from marquee.operators.aggregates import genre_entropy

    rated = R(s, d)
    tags, clusters = V.genres(s, d), _user_clusters(s, d)
    hashed = (F.col("item_id") * 40503) % 1000003
    robin = lambda pool: C.round_robin(pool, "cluster", "item_id", 24).select("item_id").distinct()
    methods = {"top": O.popular_items(rated, 24), "of_top": O.popular_items(rated, 100).orderBy(hashed, "item_id").limit(24), "clusters_rated": robin(C.pool_of_top_rated(rated, clusters, 5)), "clusters_genres": robin(C.pool_of_top_genres(rated, tags, clusters, 3))}
    out = None
    for name, sample in methods.items():
        row = genre_entropy(tags.join(sample, "item_id", "left_semi")).crossJoin(E.list_precision(sample, rated, 24)).withColumn("method", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out.select("method", r6("entropy").alias("entropy"), r6("normalised").alias("normalised"), r6("precision").alias("precision"))


QUERIES, ORACLE = book.queries, book.sql
