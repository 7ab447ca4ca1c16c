"""Hash-ranked splits: deterministic stand-ins for shuffles (WIN10, WIN11, MET10, MET11, GRP7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_order(user: str | Column, item: str | Column | None = None, seed: int = 42) -> Column:
    """A pseudo-random order from integer arithmetic, the same in any SQL engine."""
    as_column = lambda c: F.col(c) if isinstance(c, str) else c
    total = as_column(user) * F.lit(2654435761) + F.lit(seed)
    return (total + as_column(item) * 40503 if item is not None else total) % 1000003


def _part(rank: Column, n: Column, train: float, val: float) -> Column:
    a, b = F.floor(n * train), F.floor(n * val)
    return F.when(rank <= a, "train").when(rank <= a + b, "val").otherwise("test")


def split_rows(df: DataFrame, user: str, item: str, seed: int, train: float = 0.8, val: float = 0.1) -> DataFrame:
    """WIN10: every user's rows into train / val / test by int(n * ratio), in hash order."""
    w = Window.partitionBy(user)
    rank = F.row_number().over(w.orderBy(hash_order(user, item, seed), item))
    return df.withColumn("part", _part(rank, F.count("*").over(w), train, val))


def split_keys(keys: DataFrame, key: str, seed: int, train: float = 0.8, val: float = 0.1) -> DataFrame:
    """WIN11, GRP7: distinct keys into train / val / test.

    The rank is taken over the hash's values: counts by a coarse slice of the hash are summed up, then keys are ranked
    within their slice, so no window holds all keys.
    """
    h = keys.select(key, hash_order(key, None, seed).alias("h")).withColumn("slice", F.floor(F.col("h") / 1024))
    sizes = h.groupBy("slice").agg(F.count("*").alias("n"))
    before = sizes.select("slice", (F.sum("n").over(Window.orderBy("slice")) - F.col("n")).alias("before"))  # at most 977 rows
    total = sizes.agg(F.sum("n").alias("total"))
    rank = F.col("before") + F.row_number().over(Window.partitionBy("slice").orderBy("h", key))
    placed = h.join(F.broadcast(before), "slice").withColumn("rank", rank).crossJoin(F.broadcast(total))
    return placed.select(key, _part(F.col("rank"), F.col("total"), train, val).alias("part"))


def k_fold(df: DataFrame, user: str, item: str, folds: int = 5, seed: int = 42) -> DataFrame:
    """MET10: a fold number for every row."""
    return df.withColumn("fold", hash_order(user, item, seed) % folds)
