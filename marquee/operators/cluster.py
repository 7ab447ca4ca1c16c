"""Clustering and sampling (CLU, SMP, WIN8)."""

from __future__ import annotations

import math
import warnings

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marquee.session import written


def round_robin(df: DataFrame, cluster: str, key: str, n: int) -> DataFrame:
    """WIN8: n rows taken from the clusters in turn, in hash order within each."""
    order = (F.col(key) * 40503) % 1000003
    ranked = df.withColumn("__i", F.row_number().over(Window.partitionBy(cluster).orderBy(order, key))).where(F.col("__i") <= n)
    return ranked.orderBy("__i", cluster).limit(n).drop("__i")


def standardised(df: DataFrame, columns: list[str]) -> DataFrame:
    """CLU1: columns less their mean, over their population deviation (0 where that is 0)."""
    stats = df.agg(*[f(c).alias(f"__{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    wide = df.crossJoin(F.broadcast(stats))
    keep = [c for c in df.columns if c not in columns]
    return wide.select(*keep, *[F.coalesce(F.try_divide(F.col(c) - F.col(f"__m_{c}"), F.col(f"__s_{c}")), F.lit(0.0)).alias(c) for c in columns])


def k_means(df: DataFrame, key: str, vector: str, k: int, seed: int = 42) -> tuple[DataFrame, float]:
    """CLU2 for one k: (key, cluster) by Spark's k-means, and the sum of squares within clusters."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    if k == 1:  # one centre, the mean
        v = F.col(vector).cast("array<double>")
        centre = _centroids(df.select(F.lit(0).alias("cluster"), v.alias("v"), F.lit(1.0).alias("w")), 1, "w")
        cost = df.select(v.alias("v")).agg(F.sum(_distances(centre)[0])).first()[0]
        return df.select(key, F.lit(0).alias("cluster")), float(cost or 0.0)
    data = df.select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    model = KMeans(k=k, seed=seed, maxIter=20).fit(data)
    return model.transform(data).select(key, F.col("prediction").alias("cluster")), model.summary.trainingCost


def item_features(rated: DataFrame, tags: DataFrame, genres: list[str]) -> DataFrame:
    """CLU1: (item_id, features): genre one-hots, popularity between 0 and 1 and mean rating over 5, each standardised."""
    c = rated.groupBy("item_id").agg(F.count("*").cast("double").alias("n"), (F.avg("rating") / 5).alias("rating"))
    span = c.agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    hot = tags.where(F.col("genre").isin(genres)).groupBy("item_id").agg(F.collect_set("genre").alias("g"))
    wide = c.crossJoin(F.broadcast(span)).join(hot, "item_id", "left")
    has = lambda g: F.coalesce(F.array_contains("g", g).cast("double"), F.lit(0.0))
    share = F.coalesce(F.try_divide(F.col("n") - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0))
    names = [f"f{i}" for i in range(len(genres))] + ["popularity", "rating"]
    flat = wide.select("item_id", *[has(g).alias(f"f{i}") for i, g in enumerate(genres)], share.alias("popularity"), "rating")
    return standardised(flat, names).select("item_id", F.array(*names).alias("features"))


def k_means_sweep(df: DataFrame, key: str, vector: str, ks: list[int], seed: int = 42) -> DataFrame:
    """CLU2: (k, silhouette, cost, elbow) for every k: mean silhouette (squared Euclidean), sum of squares within clusters, and
    whether k is the elbow of the costs."""
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector

    data = written(df.select(key, F.col(vector).cast("array<double>").alias("v")).where(F.col(key).isNotNull() & F.col(vector).isNotNull()), "vectors")
    points = data.select(key, array_to_vector("v").alias("features"))
    rows = []
    for k in ks:
        labels, cost = k_means(data, key, "v", k, seed)
        found = labels.select("cluster").distinct().count()
        silhouette = ClusteringEvaluator(predictionCol="cluster").evaluate(points.join(labels, key)) if found > 1 else None
        rows.append((k, silhouette, float(cost)))
    elbow = knee([(k, c) for k, _, c in rows])
    return df.sparkSession.createDataFrame([(*r, r[0] == elbow) for r in rows], "k int, silhouette double, cost double, elbow boolean")


def pearson_sweep(df: DataFrame, key: str, vector: str, ks: list[int]) -> DataFrame:
    """CLU5: (k, cost, elbow) for every k: the sum of 1 - correlation with the own centre, and whether k is its elbow."""
    rows = [(k, float(pearson_k_means(df, key, vector, k)[1])) for k in ks]
    elbow = knee(rows)
    return df.sparkSession.createDataFrame([(*r, r[0] == elbow) for r in rows], "k int, cost double, elbow boolean")


def user_clusters(rated: DataFrame, tags: DataFrame, genres: list[str], k: int, seed: int = 42) -> DataFrame:
    """SMP1: (user_id, cluster) by k-means of the users' mean ratings by genre; a genre not rated counts as the user's mean."""
    means = rated.join(tags.where(F.col("genre").isin(genres)), "item_id").groupBy("user_id").pivot("genre", genres).agg(F.avg("rating"))
    own = rated.groupBy("user_id").agg(F.avg("rating").alias("__mean"))
    wide = means.join(own, "user_id").select("user_id", F.array(*[F.coalesce(F.col(f"`{g}`"), "__mean") for g in genres]).alias("v"))
    return k_means(wide, "user_id", "v", k, seed)[0]


def pool_of_top_rated(rated: DataFrame, clusters: DataFrame, n: int) -> DataFrame:
    """SMP1: (cluster, item_id): the n best rated items of every user of a cluster (5, or a pool of 100)."""
    best = rated.withColumn("__i", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("rating"), "item_id"))).where(F.col("__i") <= n)
    return best.join(clusters, "user_id").select("cluster", "item_id").distinct()


def pool_of_top_genres(rated: DataFrame, tags: DataFrame, clusters: DataFrame, n: int) -> DataFrame:
    """SMP1: (cluster, item_id): items with one of the n best rated genres of some user of a cluster."""
    means = rated.join(tags, "item_id").groupBy("user_id", "genre").agg(F.round(F.avg("rating"), 6).alias("m"))
    best = means.withColumn("__i", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("m"), "genre"))).where(F.col("__i") <= n)
    return best.join(clusters, "user_id").select("cluster", "genre").distinct().join(tags, "genre").select("cluster", "item_id").distinct()


def knee(points: list[tuple[float, float]]) -> float:
    """CLU2, CLU5: the elbow of a sweep over k: the x whose point lies furthest from the chord of a falling curve; nan for fewer than three points."""
    if len(points) < 3:
        return math.nan
    x, y = (np.array(v, float) for v in zip(*sorted(points)))
    x1, y1 = (v - v.min() for v in (x, y))
    u, v = x1 / (x1.max() or 1), y1 / (y1.max() or 1)
    line = v[0] + (v[-1] - v[0]) * u
    return float(x[np.argmax(line - v)])


def _centroids(parts: DataFrame, size: int, weight: str) -> np.ndarray:
    """Weighted mean vectors of column cluster: one row a cluster and dimension reaches the driver."""
    long = parts.select("cluster", weight, F.posexplode("v").alias("dim", "x"))
    rows = long.groupBy("cluster", "dim").agg((F.sum(F.col("x") * F.col(weight)) / F.sum(weight)).alias("c")).collect()
    out = np.full((size, max((r.dim for r in rows), default=-1) + 1), np.nan)
    for r in rows:
        out[r.cluster, r.dim] = r.c
    return out


def _first_centres(vectors: DataFrame, k: int) -> np.ndarray:
    picked = vectors.orderBy((F.col("key") * 40503) % 1000003, "key").limit(k).collect()
    return np.array([r.v for r in picked], float)


def _distances(centres: np.ndarray):
    """Squared distances of vector v to the centres, an array expression."""
    return F.array(*[F.aggregate(F.zip_with("v", F.array(*map(F.lit, c.tolist())), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x) for c in centres])


def _unrested(name: str, most: int) -> None:
    warnings.warn(f"{name}: the centres still move after {most} rounds; the result is not converged", RuntimeWarning, stacklevel=3)


def fuzzy_c_means(df: DataFrame, key: str, vector: str, k: int, m: float = 2.0, error: float = 0.005, most: int = 300) -> DataFrame:
    """CLU3: (key, cluster, membership) by alternating memberships and weighted centroids until the centres rest.

    Centres that still move after `most` rounds are warned of.
    """
    vectors = df.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v")).where("key is not null and v is not null")
    centres = _first_centres(vectors, k)
    for _ in range(most):
        u = F.transform(_distances(centres), lambda d: F.pow(F.lit(1.0) / F.greatest(d, F.lit(1e-12)), F.lit(1.0 / (m - 1))))
        total = F.aggregate("u", F.lit(0.0), lambda s, x: s + x)
        shares = vectors.withColumn("u", u).withColumn("t", total)
        long = shares.select("key", "v", F.posexplode(F.transform("u", lambda x: x / F.col("t"))).alias("cluster", "membership"))
        moved = _centroids(long.withColumn("w", F.pow("membership", F.lit(m))), k, "w")
        shift, centres = float(np.abs(moved - centres).max()), moved
        if shift < error:
            break
    else:
        _unrested("fuzzy_c_means", most)
    return long.select(F.col("key").alias(key), "cluster", "membership")


def pearson_k_means(df: DataFrame, key: str, vector: str, k: int, tolerance: float = 1e-4, most: int = 300) -> tuple[DataFrame, float]:
    """CLU4, and one k of CLU5: (key, cluster) by greatest correlation with mean centroids, and the sum of 1 - correlation.

    Correlation is the cosine of centred vectors. An empty cluster starts again from a vector that fits its centre worst. Centres that still move after `most`
    rounds are warned of.
    """
    raw = df.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v")).where("key is not null and v is not null")
    mean = F.aggregate("v", F.lit(0.0), lambda s, x: s + x) / F.size("v")
    centred = raw.withColumn("m", mean).select("key", F.transform("v", lambda x: x - F.col("m")).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    vectors = centred.withColumn("n", norm).select("key", F.transform("v", lambda x: x / F.greatest(F.col("n"), F.lit(1e-12))).alias("v"))
    vectors = written(vectors, "centred")
    centres = _first_centres(vectors, k)

    def placed(c: np.ndarray) -> DataFrame:
        c = c - c.mean(axis=1, keepdims=True)
        c = c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        r = F.array(*[F.aggregate(F.zip_with("v", F.array(*map(F.lit, x.tolist())), lambda a, b: a * b), F.lit(0.0), lambda s, y: s + y) for x in c])
        best = vectors.withColumn("r", r).withColumn("best", F.array_max("r"))
        return best.select("key", "v", (F.array_position("r", F.col("best")) - 1).cast("int").alias("cluster"), "best", F.lit(1.0).alias("w"))

    for _ in range(most):
        moved = _centroids(placed(centres), len(centres), "w")
        empty = np.flatnonzero(np.isnan(moved).all(axis=1))
        if len(empty):
            worst = placed(centres).orderBy("best", "key").limit(len(empty)).select("v").collect()
            moved[empty[: len(worst)]] = np.array([r.v for r in worst])
        moved = np.where(np.isnan(moved), centres, moved)
        done = np.allclose(moved, centres, atol=tolerance)
        centres = moved
        if done:
            break
    else:
        _unrested("pearson_k_means", most)
    result = placed(centres)
    cost = result.agg(F.sum(1 - F.col("best"))).first()[0] or 0.0
    return result.select(F.col("key").alias(key), "cluster"), cost


def stratified_sample(df: DataFrame, user: str, item: str, share: float, n: int, seed: int = 42) -> DataFrame:
    """SMP3: round(share * rows) of every user in hash order, then n of all in hash order."""
    from marquee.operators.splits import hash_order

    w = Window.partitionBy(user)
    order = hash_order(user, item, seed)
    some = df.withColumn("__i", F.row_number().over(w.orderBy(order, item))).withColumn("__n", F.count("*").over(w)).where("__i <= rint(__n * %s)" % share)
    return some.orderBy(order, user, item).limit(n).drop("__i", "__n")
