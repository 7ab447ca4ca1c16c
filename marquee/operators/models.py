"""Recommender models (REC) on long ratings.

Item models are matrices in blocks (linear.py): one panel of bounded size at a time reaches the driver, and no task takes a
whole matrix. Everything else is joins and aggregates, or NumPy per batch of users.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.operators.knn_errors import held_against_panels
from marquee.operators.linear import PANEL_BYTES, BlockMatrix
from marquee.operators.matrix import corated_cosine, gram, top_k
from marquee.operators.ranking import with_position
from marquee.session import removed, ship, written


def popularity(rated: DataFrame) -> DataFrame:
    """REC4: sum of ratings per item: (item_id, score)."""
    return rated.groupBy("item_id").agg(F.sum("rating").alias("score"))


def popular_items(rated: DataFrame, n: int) -> DataFrame:
    """The n items with the most ratings; ties by id."""
    return rated.groupBy("item_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "item_id").limit(n).select("item_id")


def recommend_unseen(scores: DataFrame, rated: DataFrame, k: int) -> DataFrame:
    """REC4, JOI3, WIN1, WIN4: the k best of (item_id, score) for every user among the items not rated, with their places.

    Items are numbered once, best first (ties by id). The unseen ones are the gaps between the numbers of a user's own items,
    so only the first k of them are ever listed: no user meets all items. Users with fewer than k unseen items get fewer
    rows; items without a score are never recommended; null users and items are left out.
    """
    ranks = with_position(scores.where("item_id is not null").select("item_id", "score"), [F.desc("score"), "item_id"], "rank").withColumn("rank", F.col("rank") + 1)
    total = ranks.count()
    own = rated.select("user_id", "item_id").where("user_id is not null").distinct()
    # A number after the last one closes every user's list.
    seen = own.join(ranks, "item_id").select("user_id", "rank").unionByName(own.select("user_id").distinct().withColumn("rank", F.lit(total + 1).cast("bigint")))
    w = Window.partitionBy("user_id").orderBy("rank")
    before = F.coalesce(F.lag("rank").over(w), F.lit(0))
    gaps = seen.select("user_id", "rank", before.alias("before"), (F.row_number().over(w) - 1).cast("bigint").alias("n")).withColumn("place", F.col("before") - F.col("n"))
    listed = gaps.where((F.col("rank") > F.col("before") + 1) & (F.col("place") < k))
    last = F.least(F.col("rank") - 1, F.col("before") + k - F.col("place"))
    unseen = listed.select("user_id", "n", F.explode(F.sequence(F.col("before") + 1, last)).alias("rank"))
    return unseen.join(ranks, "rank").select("user_id", "item_id", "score", (F.col("rank") - F.col("n")).alias("place"))


def best_columns(s: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k greatest values of every row, best first, ties by column; equal to a stable sort, but most of a row isn't sorted."""
    if k >= s.shape[1]:
        return np.argsort(-s, axis=1, kind="stable")
    least = np.partition(s, s.shape[1] - k, axis=1)[:, -k]
    r, c = np.nonzero(s >= least[:, None])
    order = np.lexsort((c, -s[r, c], r))
    starts = np.searchsorted(r, np.arange(len(s)))
    return c[order][starts[:, None] + np.arange(k)]


class Ease:
    """REC1, REC2, REC3: closed-form linear autoencoder over all items, or over the n_items most rated ones.

    norm: 'row' divides row i by P_ii, 'col' column j by P_jj. The Gram matrix is computed once and reused over penalties.
    row and col name the two sides; with them exchanged the model is over users (REC3, user-based). Every user with a rating
    has scores. The matrix is dense, items by items, and lies in blocks in the shared folder.
    """

    def __init__(self, rated: DataFrame, n_items: int | None = None, norm: str = "row", row: str = "user_id", col: str = "item_id", width: int | None = None):
        if norm not in ("row", "col"):
            raise ValueError(norm)
        self.spark, self.norm, self.row, self.col = rated.sparkSession, norm, row, col
        ship(self.spark)
        rated = rated.where(F.col(row).isNotNull() & F.col(col).isNotNull() & F.col("rating").isNotNull())
        axis = rated.select(col).distinct() if n_items is None else popular_items(rated.withColumnRenamed(col, "item_id"), n_items).withColumnRenamed("item_id", col)
        self.index = with_position(axis, [col], "idx")
        self.ids = np.array(self.index.orderBy("idx").select(col).toArrow()[col].to_pylist(), np.int64)  # the axis of the matrix
        self.gram = BlockMatrix.of_cells(gram(self._cells(rated), "r", "idx", "x"), len(self.ids), width)
        self.p: BlockMatrix | None = None

    def _cells(self, rated: DataFrame) -> DataFrame:
        return rated.join(self.index, self.col).select(F.col(self.row).cast("bigint").alias("r"), F.col("idx"), F.col("rating").cast("double").alias("x"))

    def fit(self, penalty: float, last: bool = False) -> Ease:
        """last: no other penalty follows, so the Gram matrix is deleted as soon as it is used up."""
        self.penalty, self.p = penalty, self.gram.inverse(penalty, last)  # with its sign turned
        self.d = -self.p.diagonal()
        return self

    def weights(self) -> DataFrame:
        """(i, j, b) without the empty diagonal."""
        ids, d, by_row, width = self.ids, self.d, self.norm == "row", self.p.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for c, r, payload in zip(*(x.to_pylist() for x in batch.columns)):
                    left, right = ids[r * width : (r + 1) * width], ids[c * width : (c + 1) * width]
                    b = np.frombuffer(payload, np.float64).reshape(len(left), len(right))
                    b = b / (d[r * width : r * width + len(left), None] if by_row else d[None, c * width : c * width + len(right)])
                    i, j = np.repeat(left, len(right)), np.tile(right, len(left))
                    keep = i != j
                    yield pa.RecordBatch.from_arrays([pa.array(i[keep]), pa.array(j[keep]), pa.array(b.reshape(-1)[keep])], ["i", "j", "b"])

        return self.p.column_panels().mapInArrow(run, "i bigint, j bigint, b double")

    def _scored(self, rated: DataFrame, emit: Callable, schema: str, plain: bool = False) -> DataFrame:
        """emit(rows, first column, scores, seen) of the scores of every row in every column block.

        A task has one column block of the weights and one slice of the rows; scores are sums over a row's own items in the
        order of their ids, rounded to nine digits. plain: the weights are the inverse with its sign turned, as it is, nothing
        is rounded, and seen ends with the ratings.
        """
        cells = written(self._cells(rated), "cells")
        blocks, width, n = self.p.blocks, self.p.width, self.p.n
        if not n:
            return self.spark.createDataFrame([], schema)
        slices = max(-(-cells.count() // 1_000_000), -(-self.spark.sparkContext.defaultParallelism // blocks))
        every = lambda count, name: F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias(name)
        panels = self.p.column_panels().select("c", "r", "payload", every(slices, "s"))
        placed = cells.select("r", "idx", "x", F.pmod(F.xxhash64("r"), F.lit(slices)).cast("int").alias("s"), every(blocks, "c"))
        d, by_row, names = self.d, self.norm == "row", [f.split()[0] for f in schema.split(", ")]

        def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows or not right.num_rows:
                return emit(None, 0, None, None)
            c, r = key[0].as_py(), np.asarray(left["r"].combine_chunks())
            payloads = left["payload"].to_pylist()
            wide = min(width, n - c * width)
            b = np.concatenate([np.frombuffer(payloads[k], np.float64).reshape(-1, wide) for k in np.argsort(r)])
            if not plain:
                b = b / (d[:, None] if by_row else d[None, c * width : c * width + wide])
                own = np.arange(wide)
                b[c * width + own, own] = 0.0
            u, i, x = (np.asarray(right[name].combine_chunks()) for name in ("r", "idx", "x"))
            order = np.lexsort((i, u))
            u, i, x = u[order], i[order], x[order]
            starts = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]]))
            ends, out, at = np.append(starts[1:], len(u)), [], 0
            while at < len(starts):
                to = min(at + 512, len(starts))
                lo, hi, s, done = starts[at], ends[to - 1], np.empty((to - at, wide)), at
                while done < to:  # so many cells at once that their weights stay in the cache
                    upto = min(to, max(done + 1, int(np.searchsorted(ends, starts[done] + 256, side="right"))))
                    p, q = starts[done], ends[upto - 1]
                    s[done - at : upto - at] = np.add.reduceat(b[i[p:q]] * x[p:q, None], starts[done:upto] - p, axis=0)
                    done = upto
                if not plain:
                    s = np.round(s, 9, out=s)
                within = np.flatnonzero((i[lo:hi] >= c * width) & (i[lo:hi] < c * width + wide))
                rows = np.searchsorted(starts[at:to], lo + within, side="right") - 1
                out.append(emit(u[starts[at:to]], c * width, s, (rows, i[lo:hi][within] - c * width, *([x[lo:hi][within]] if plain else []))))
                at = to
            return pa.concat_tables(out)

        return panels.groupBy("c", "s").cogroup(placed.groupBy("c", "s")).applyInArrow(run, schema).toDF(*names)

    def scores(self, rated: DataFrame, k: int, mask_seen: bool = True, plain: bool = False) -> DataFrame:
        """(user_id, item_id, score, place): the k best items of every row's entity; ties go to the smaller id."""
        ids = self.ids

        def emit(rows, first, s, seen) -> pa.Table:
            if rows is None:
                return pa.table({"user_id": pa.array([], pa.int64()), "item_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
            if plain:
                s = np.round(s, 9, out=s)
            if mask_seen:
                s[seen[:2]] = -np.inf
            order = best_columns(s, k)
            best = np.take_along_axis(s, order, axis=1)
            keep = np.isfinite(best)
            return pa.table({"user_id": np.repeat(rows, keep.sum(axis=1)), "item_id": ids[first + order][keep], "score": best[keep]})

        return top_k(self._scored(rated, emit, "user_id bigint, item_id bigint, score double", plain), ["user_id"], "score", "item_id", k)

    def column_scores(self, rated: DataFrame, k: int) -> DataFrame:
        """REC3, user-based: (user_id, item_id, score, place) of a model over users, whose rows are items: each user's k best."""
        ids = self.ids

        def emit(rows, first, s, seen) -> pa.Table:
            if rows is None:
                return pa.table({"user_id": pa.array([], pa.int64()), "item_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
            s[seen] = -np.inf
            order = best_columns(np.ascontiguousarray(s.T), k)
            best = np.take_along_axis(s.T, order, axis=1)
            keep = np.isfinite(best)
            return pa.table({"user_id": np.repeat(ids[first : first + s.shape[1]], keep.sum(axis=1)), "item_id": rows[order][keep], "score": best[keep]})

        return top_k(self._scored(rated, emit, "user_id bigint, item_id bigint, score double"), ["user_id"], "score", "item_id", k)

    def user_based_scores(self, rated: DataFrame, k: int) -> DataFrame:
        """REC3, user-based: what column_scores gives of a model over users with norm 'col' and this penalty, from this model
        over items, of the ratings it was made from.

        With Q the inverse of X'X + penalty, X'(XX' + penalty)^-1 = QX', so user u's score of an item not seen is -(Q x)_i / P_uu
        with P_uu = (1 - x'Qx) / penalty, x the user's ratings. No matrix of users by users is made.
        """

        def emit(rows, first, s, seen) -> pa.Table:
            if rows is None:
                return pa.table({"user_id": pa.array([], pa.int64()), "part": pa.array([], pa.float64())})
            r, c, x = seen
            return pa.table({"user_id": rows, "part": np.bincount(r, -s[r, c] * x, len(rows))})

        parts = self._scored(rated, emit, "user_id bigint, part double", plain=True)
        own = written(parts.groupBy("user_id").agg((F.lit(float(self.penalty)) / (1 - F.sum("part"))).alias("by")), "own")
        return self.scores(rated.join(own, "user_id").withColumn("rating", F.col("rating") * F.col("by")), k, plain=True)

    def score_vectors(self, rated: DataFrame) -> DataFrame:
        """(user_id, first, payload): the scores of all items, packed as doubles in the order of `ids`, block by block."""

        def emit(rows, first, s, seen) -> pa.Table:
            if rows is None:
                return pa.table({"user_id": pa.array([], pa.int64()), "first": pa.array([], pa.int32()), "payload": pa.array([], pa.binary())})
            return pa.table({"user_id": rows, "first": pa.array([first] * len(rows), pa.int32()), "payload": pa.array([v.tobytes() for v in s], pa.binary())})

        return self._scored(rated, emit, "user_id bigint, first int, payload binary")


def user_based(rated: DataFrame, penalty: float, k: int) -> DataFrame:
    """REC3, user-based: (user_id, item_id, score, place): each user's k best of the items not rated, by a model over users
    whose columns are divided by P_jj. Inverted is the matrix of items or that of users, whichever is smaller."""
    rated = rated.where("user_id is not null and item_id is not null and rating is not null")
    n = rated.agg(F.count_distinct("user_id").alias("users"), F.count_distinct("item_id").alias("items")).first()
    if n["items"] <= n.users:
        return Ease(rated).fit(penalty, last=True).user_based_scores(rated, k)
    return Ease(rated, norm="col", row="item_id", col="user_id").fit(penalty, last=True).column_scores(rated, k)


def penalty_sweep(model: Ease, rated: DataFrame, held: DataFrame, penalties: list[float], k: int = 20) -> DataFrame:
    """REC16: (penalty, precision, recall) of every penalty on held-out items; one Gram matrix serves all.

    Each inverse is deleted once its row is written.
    """
    from marquee.operators.metrics import precision_recall

    out = None
    for p in penalties:
        row = written(precision_recall(model.fit(p).scores(rated, k), held, k).withColumn("penalty", F.lit(float(p))), "swept")
        if model.p.path != model.gram.path:  # they are one where there are no items
            removed(model.spark, model.p.path)
        model.p = None
        out = row if out is None else out.unionByName(row)
    return out


def similarities(rated: DataFrame, least: int = 2, row: str = "user_id", col: str = "item_id") -> DataFrame:
    """REC5: (i, j, sim) in both directions, sim > 0: cosine over co-rated entries of two items (or users, with row and col
    exchanged) with at least so many, rounded so that ties are ties."""
    half = corated_cosine(rated, row, col, "rating", least).withColumn("sim", F.round("sim", 6)).where("sim > 0")
    return half.select("i", "j", "sim").unionByName(half.select(F.col("j").alias("i"), F.col("i").alias("j"), "sim"))


def neighbours(rated: DataFrame, k: int, least: int = 2, row: str = "user_id", col: str = "item_id") -> DataFrame:
    """REC5: (i, j, sim, place): the k nearest of every item (or user)."""
    return top_k(similarities(rated, least, row, col), ["i"], "sim", "j", k)


def knn_predictions(rated: DataFrame, near: DataFrame, wanted: DataFrame, k: int = 20, by: str = "item_id") -> DataFrame:
    """REC5: (user_id, item_id, est) for wanted (user_id, item_id): similarity-weighted mean over the k nearest items the user
    rated, or with by='user_id' over the k nearest users who rated the item; the global mean where there are none.

    near: similarities (i, j, sim) of items or users.
    """
    other = "user_id" if by == "item_id" else "item_id"
    mean = rated.agg(F.avg("rating").alias("mu"))
    wanted = written(wanted.select("user_id", "item_id").distinct(), "wanted")
    facts = rated.select(F.col(other), F.col(by).alias("j"), "rating")
    if by == "item_id":  # a user's own items are fewer than an item's neighbours
        hits = wanted.join(facts, other).withColumnRenamed("item_id", "i").join(near.select("i", "j", "sim"), ["i", "j"]).withColumnRenamed("i", "item_id")
    else:
        hits = wanted.withColumnRenamed("user_id", "i").join(near.select("i", "j", "sim"), "i").join(facts, [other, "j"]).withColumnRenamed("i", "user_id")
    best = top_k(hits, ["user_id", "item_id"], "sim", "j", k)
    est = best.groupBy("user_id", "item_id").agg((F.sum(F.col("sim") * F.col("rating")) / F.sum("sim")).alias("est"))
    return wanted.join(est, ["user_id", "item_id"], "left").crossJoin(F.broadcast(mean)).select("user_id", "item_id", F.coalesce("est", "mu").alias("est"))


def memory_knn_rmse(rated: DataFrame, sizes: list[int], margin: int = 5, k: int = 9, seed: int = 42, cells: int = PANEL_BYTES // 8) -> DataFrame:
    """REC9: (n_ratings, n_users, rmse): how well a user is predicted from the first n of the own ratings, in hash order.

    For every n, each user with more than n + margin ratings is reduced to n of them. Neighbours are the k other users of
    greatest correlation over all items (absent ratings count as 0) that share an item; predictions are mean-centred, the
    user's mean where no neighbour has rated the item; rmse is averaged over users. Up to `cells` ratings are one panel of
    users; of more panels the nearest are put together before they predict.
    """
    from marquee.operators.splits import hash_order

    facts = written(rated.select(*(F.col(c).cast("bigint").alias(c) for c in ("user_id", "item_id")), F.col("rating").cast("double").alias("rating")), "facts")
    n_items = facts.select("item_id").distinct().count()
    found, whole = held_against_panels(facts, [hash_order("user_id", "item_id", seed), "item_id"], n_items, sizes, margin, k, cells)
    if whole:
        by_user = found
    else:
        mine = Window.partitionBy("user_id")
        placed = facts.withColumn("i", F.row_number().over(mine.orderBy(hash_order("user_id", "item_id", seed), "item_id"))).withColumn("n", F.count("*").over(mine))
        asked = facts.sparkSession.createDataFrame([(n,) for n in sizes], "size int")
        sized = written(placed.join(F.broadcast(asked), F.col("n") > F.col("size") + margin).select("size", "user_id", "item_id", "rating", (F.col("i") <= F.col("size")).alias("train")), "reduced")
        means = sized.where("train").groupBy("size", "user_id").agg(F.avg("rating").alias("mean"))
        test = sized.where("not train").select("size", "user_id", "item_id", F.col("rating").alias("truth"))
        near = top_k(found, ["size", "user_id"], "sim", "other", k)
        hits = test.join(near, ["size", "user_id"]).join(facts.select(F.col("user_id").alias("other"), "item_id", "rating"), ["other", "item_id"])
        moved = hits.groupBy("size", "user_id", "item_id").agg(F.try_divide(F.sum((F.col("rating") - F.col("other_mean")) * F.col("sim")), F.sum(F.abs("sim"))).alias("moved"))
        errors = test.join(moved, ["size", "user_id", "item_id"], "left").join(means, ["size", "user_id"])
        off = F.col("truth") - F.col("mean") - F.coalesce("moved", F.lit(0.0))
        by_user = errors.groupBy("size", "user_id").agg(F.sqrt(F.avg(off * off)).alias("rmse"))
    return by_user.groupBy(F.col("size").alias("n_ratings")).agg(F.count("*").alias("n_users"), F.avg("rmse").alias("rmse"))


def recency_rerank(scores: DataFrame, years: DataFrame, k: int, pool: int = 50, beta: float = 0.3, decay: float = 0.05, now: int = 2025) -> DataFrame:
    """REC15, WIN15: (user_id, item_id, score, place): of each user's `pool` best, the k best by score * (beta + (1 - beta) *
    exp(-decay * age)); an item without a year counts as new."""
    aged = scores.where(F.col("place") <= pool).join(years.select("item_id", "year"), "item_id", "left")
    recency = F.exp(-decay * (now - F.coalesce("year", F.lit(now))))
    return top_k(aged.withColumn("score", F.round(F.col("score") * (beta + (1 - beta) * recency), 9)).select("user_id", "item_id", "score"), ["user_id"], "score", "item_id", k)


def neighbour_sweep(rated: DataFrame, held: DataFrame, ks: list[int], least: int = 2) -> DataFrame:
    """REC16: (k, rmse) of item neighbour predictions of held-out (user_id, item_id, rating); similarities are computed once."""
    near, out = written(similarities(rated, least), "near"), None
    for k in ks:
        est = knn_predictions(rated, near, held, k).join(held.select("user_id", "item_id", "rating"), ["user_id", "item_id"])
        row = est.agg(F.sqrt(F.avg(F.pow(F.col("rating") - F.col("est"), F.lit(2)))).alias("rmse")).select(F.lit(k).alias("k"), "rmse")
        out = row if out is None else out.unionByName(row)
    return out


class Rescored:
    """WIN2: an iterator over every user's items that are not shown yet; each step ranks them by the scores it is given."""

    def __init__(self, rated: DataFrame):
        self.rated, self.shown = rated.select("user_id", "item_id").distinct(), None

    def next(self, scores: DataFrame, k: int) -> DataFrame:
        """(user_id, item_id, score, place): the k best by (item_id, score) that are neither rated nor shown before."""
        gone = self.rated if self.shown is None else self.rated.unionByName(self.shown)
        out = written(recommend_unseen(scores, gone, k), "step")
        step = out.select("user_id", "item_id")
        self.shown = step if self.shown is None else self.shown.unionByName(step)
        return out


def baseline_biases(rated: DataFrame, sweeps: int = 2, damp_user: float = 15.0, damp_item: float = 10.0) -> tuple[float, DataFrame, DataFrame]:
    """REC7: mean and damped biases (user_id, bu), (item_id, bi) by alternating sweeps, items first."""
    facts = rated.select("user_id", "item_id", "rating")
    mu = facts.agg(F.avg("rating")).first()[0] or 0.0
    users = facts.select("user_id").distinct().withColumn("bu", F.lit(0.0))
    for _ in range(sweeps):
        items = facts.join(users, "user_id").groupBy("item_id").agg((F.sum(F.col("rating") - mu - F.col("bu")) / (damp_item + F.count("*"))).alias("bi"))
        items = written(items, "bi")
        users = facts.join(items, "item_id").groupBy("user_id").agg((F.sum(F.col("rating") - mu - F.col("bi")) / (damp_user + F.count("*"))).alias("bu"))
        users = written(users, "bu")
    return mu, users, items


def factors(rated: DataFrame, rank: int = 50, implicit: bool = False, seed: int = 42, sweeps: int = 10) -> tuple[DataFrame, DataFrame]:
    """REC6, REC8: user and item factors by alternating least squares, a stand-in for gradient methods."""
    from pyspark.ml.recommendation import ALS

    als = ALS(rank=rank, maxIter=sweeps, seed=seed, implicitPrefs=implicit, userCol="user_id", itemCol="item_id", ratingCol="rating", coldStartStrategy="drop")
    model = als.fit(rated.select(F.col("user_id").cast("int").alias("user_id"), F.col("item_id").cast("int").alias("item_id"), "rating"))
    return model.userFactors, model.itemFactors


def residual_factors(rated: DataFrame, rank: int = 20, seed: int = 42) -> tuple[float, DataFrame, DataFrame, DataFrame, DataFrame]:
    """REC6: the bias model, and factors of what it leaves."""
    mu, users, items = baseline_biases(rated)
    rest = rated.join(users, "user_id").join(items, "item_id").select("user_id", "item_id", (F.col("rating") - mu - F.col("bu") - F.col("bi")).alias("rating"))
    return mu, users, items, *factors(rest, rank, False, seed)


def residual_predictions(model: tuple, wanted: DataFrame, low: float = 0.5, high: float = 5.0) -> DataFrame:
    """REC6: (*wanted, est): mean + biases + the product of the factors, within the scale; what is unknown counts as 0."""
    mu, users, items, user_factors, item_factors = model
    side = lambda f, key, name: f.select(F.col("id").cast("bigint").alias(key), F.col("features").alias(name))
    known = wanted.join(users, "user_id", "left").join(items, "item_id", "left").join(side(user_factors, "user_id", "p"), "user_id", "left").join(side(item_factors, "item_id", "q"), "item_id", "left")
    dot = F.aggregate(F.zip_with("p", "q", lambda a, b: (a * b).cast("double")), F.lit(0.0), lambda s, x: s + x)
    est = F.lit(mu) + F.coalesce("bu", F.lit(0.0)) + F.coalesce("bi", F.lit(0.0)) + F.coalesce(dot, F.lit(0.0))
    return known.select(*wanted.columns, F.least(F.greatest(est, F.lit(low)), F.lit(high)).alias("est"))


def _tag_profiles(rated: DataFrame, tags: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """REC10: item vectors (item_id, genre, x), user profiles (user_id, genre, p) and their lengths (user_id, len)."""
    size = tags.groupBy("item_id").agg(F.count("*").alias("k"))
    vectors = tags.join(size, "item_id").select("item_id", "genre", (1 / F.sqrt("k")).alias("x"))
    profile = rated.join(vectors, "item_id").groupBy("user_id", "genre").agg(F.sum(F.col("rating") * F.col("x")).alias("p"))
    length = profile.groupBy("user_id").agg(F.sqrt(F.sum(F.col("p") * F.col("p"))).alias("len"))
    return vectors, profile, length


def content_scores(rated: DataFrame, tags: DataFrame, candidates: DataFrame) -> DataFrame:
    """REC10: (user_id, item_id, score): cosine of a user's rating-weighted mean tag vector and candidates' tag vectors.

    tags: (item_id, genre) one row a tag; vectors are even over an item's tags and of length one.
    """
    vectors, profile, length = _tag_profiles(rated, tags)
    wanted = vectors.join(candidates, "item_id", "left_semi")
    dots = profile.join(wanted, "genre").groupBy("user_id", "item_id").agg(F.sum(F.col("p") * F.col("x")).alias("dot"))
    return dots.join(length, "user_id").select("user_id", "item_id", (F.col("dot") / F.col("len")).alias("score"))


def content_pair_scores(rated: DataFrame, tags: DataFrame, wanted: DataFrame) -> DataFrame:
    """REC10: content_scores of wanted (user_id, item_id) pairs only; none where user and item share no tag."""
    vectors, profile, length = _tag_profiles(rated, tags)
    pairs = wanted.select("user_id", "item_id").join(vectors, "item_id")
    dots = pairs.join(profile, ["user_id", "genre"]).groupBy("user_id", "item_id").agg(F.sum(F.col("p") * F.col("x")).alias("dot"))
    return dots.join(length, "user_id").select("user_id", "item_id", (F.col("dot") / F.col("len")).alias("score"))


def content_top(rated: DataFrame, tags: DataFrame, k: int, digits: int = 4) -> DataFrame:
    """REC10: (user_id, item_id, score, place): the k best of all tagged items by content_scores, rounded so that ties go to
    the smaller id.

    Items of one tag set score alike, so the distinct sets are scored; only a user's k best sets (by score, then their least
    item) and the k least items of each can hold the result. The sets and those items reach the driver: tags must be few.
    """
    _, profile, _ = _tag_profiles(rated, tags)
    sets = tags.groupBy("item_id").agg(F.array_sort(F.collect_set("genre")).alias("set"))
    w = Window.partitionBy("set").orderBy("item_id")
    heads = sets.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k).groupBy("set").agg(F.array_sort(F.collect_list("item_id")).alias("items"))
    found = sorted(((list(r["items"]), list(r["set"])) for r in heads.collect()), key=lambda x: x[0])
    names = {g: i for i, g in enumerate(sorted({g for _, s in found for g in s}))}
    x, items = np.zeros((len(names), len(found))), np.full((len(found), k), np.iinfo(np.int64).max)
    for c, (ids, s) in enumerate(found):
        x[[names[g] for g in s], c] = 1 / np.sqrt(len(s))
        items[c, : len(ids)] = ids
    listed = profile.groupBy("user_id").agg(F.collect_list("genre").alias("genres"), F.collect_list("p").alias("p"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        step = max(1, 2_000_000 // max(1, len(found)))
        for batch in batches:
            for at in range(0, len(batch), step):
                part = batch.iloc[at : at + step]
                p = np.zeros((len(part), len(names)))
                rows = np.repeat(np.arange(len(part)), part.genres.map(len))
                p[rows, [names[g] for g in np.concatenate(part.genres.to_numpy())]] = np.concatenate(part.p.to_numpy())
                s = np.floor(p @ x / np.sqrt((p * p).sum(axis=1))[:, None] * 10**digits + 0.5) / 10**digits
                s[(p > 0).astype(float) @ (x > 0) == 0] = -1.0  # no tag in common
                rank = np.rint(s * 10**digits).astype(np.int64) * -len(found) + np.arange(len(found))  # ties by the least item
                best = np.argpartition(rank, k, axis=1)[:, :k] if len(found) > k else np.broadcast_to(np.arange(len(found)), s.shape)
                score = np.repeat(np.take_along_axis(s, best, axis=1), k, axis=1)
                ids = items[best].reshape(len(part), -1)
                score = np.where(ids == np.iinfo(np.int64).max, -1.0, score)
                order = np.lexsort((ids, -score), axis=1)[:, :k]
                ids, score = np.take_along_axis(ids, order, axis=1), np.take_along_axis(score, order, axis=1)
                keep = score >= 0
                yield pd.DataFrame({"user_id": np.repeat(part.user_id.to_numpy(), keep.sum(axis=1)), "item_id": ids[keep], "score": score[keep], "place": np.broadcast_to(np.arange(1, ids.shape[1] + 1), ids.shape)[keep]})

    return listed.mapInPandas(run, "user_id bigint, item_id bigint, score double, place bigint")


#: REC11: aggregations of members' scores of an item by name; a caller may add its own.
AGGREGATIONS: dict[str, Callable[[str], Column]] = {
    "mean": lambda c: F.avg(c),
    "min": lambda c: F.min(c),
    "max": lambda c: F.max(c),
    "median": lambda c: F.expr(f"percentile({c}, 0.5)"),
    "geomean": lambda c: F.exp(F.avg(F.log(F.greatest(F.col(c), F.lit(1e-12))))),
    "sum": lambda c: F.sum(c),
    "product": lambda c: F.product(c),
}


def group_scores(groups: DataFrame, scores: DataFrame, how: str | Callable[[str], Column]) -> DataFrame:
    """REC11: (group_id, item_id, score) from members' scores (user_id, item_id, score); plurality counts first places."""
    member = groups.select("group_id", F.explode("members").alias("user_id"))
    joined = member.join(scores, "user_id")
    if how == "plurality":
        first = top_k(joined, ["group_id", "user_id"], "score", "item_id", 1)
        return first.groupBy("group_id", "item_id").agg(F.count("*").cast("double").alias("score"))
    return joined.groupBy("group_id", "item_id").agg((AGGREGATIONS[how] if isinstance(how, str) else how)("score").alias("score"))


def group_profiles(groups: DataFrame, rated: DataFrame, how: str = "mean") -> DataFrame:
    """REC12: (group_id, item_id, rating): members' ratings joined to one profile; what a member didn't rate counts as 0."""
    member = groups.select("group_id", F.size("members").alias("size"), F.explode("members").alias("user_id"))
    seen = member.join(rated, "user_id").groupBy("group_id", "item_id", "size").agg(F.sum("rating").alias("s"), F.array_sort(F.collect_list("rating")).alias("v"))
    if how == "mean":
        value = F.col("s") / F.col("size")
    elif how == "sum":
        value = F.col("s")
    elif how == "median":
        full = F.concat(F.array_repeat(F.lit(0.0), F.col("size") - F.size("v")), F.col("v"))
        value = (F.element_at(full, F.floor((F.col("size") + 1) / 2).cast("int")) + F.element_at(full, F.floor((F.col("size") + 2) / 2).cast("int"))) / 2
    else:
        raise ValueError(how)
    return seen.select("group_id", "item_id", value.alias("rating"))


def ema_step(profile: DataFrame, votes: DataFrame, alpha: float, how: str = "mean") -> DataFrame:
    """REC13: one update of (group_id, item_id, rating) profiles by votes (group_id, item_id, stars).

    A voted item's rating moves by alpha to the mean (or sum) of its votes; one without a rating starts from 0.
    """
    v = votes.groupBy("group_id", "item_id").agg((F.avg if how == "mean" else F.sum)("stars").alias("v"))
    old = F.coalesce("rating", F.lit(0.0))
    return profile.join(v, ["group_id", "item_id"], "full").select("group_id", "item_id", F.when(F.col("v").isNotNull(), (1 - alpha) * old + alpha * F.col("v")).otherwise(old).alias("rating"))


def running_mean_step(profile: DataFrame, votes: DataFrame) -> DataFrame:
    """REC13, mean mode: profiles with a count n of updates (0 at the start); the first update replaces the base value."""
    v = votes.groupBy("group_id", "item_id").agg(F.avg("stars").alias("v"))
    n, old = F.coalesce("n", F.lit(0)), F.coalesce("rating", F.lit(0.0))
    hit = F.col("v").isNotNull()
    return profile.join(v, ["group_id", "item_id"], "full").select("group_id", "item_id", F.when(hit, (old * n + F.col("v")) / (n + 1)).otherwise(old).alias("rating"), F.when(hit, n + 1).otherwise(n).alias("n"))


def hybrid_scores(content: DataFrame, neighbours: DataFrame, alpha: float = 0.2) -> DataFrame:
    """REC14: alpha * content score + (1 - alpha) * neighbour score; a missing one counts as 0."""
    joined = content.select("user_id", "item_id", F.col("score").alias("c")).join(neighbours.select("user_id", "item_id", F.col("est").alias("k")), ["user_id", "item_id"], "full")
    return joined.select("user_id", "item_id", (alpha * F.coalesce("c", F.lit(0.0)) + (1 - alpha) * F.coalesce("k", F.lit(0.0))).alias("score"))
