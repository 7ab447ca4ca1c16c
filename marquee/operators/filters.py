"""Filters and predicates (FLT) over long ratings. Groups are counted with map-side partial sums; survivors are kept by semi-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.session import written


def at_least(df: DataFrame, key: str, n: int, strict: bool = False, condition: Column | None = None) -> DataFrame:
    """FLT1, FLT2, FLT11, FLT18: rows of keys with at least (strict: more than) n rows that meet a condition."""
    counted = F.count(F.when(condition, 1)) if condition is not None else F.count("*")
    keep = df.groupBy(key).agg(counted.alias("__n")).where(F.col("__n") > n if strict else F.col("__n") >= n)
    return df.join(keep.select(key), key, "left_semi")


def interaction_thresholds(df: DataFrame, user_least: int = 50, item_least: int = 20, positive: float = 4.0) -> DataFrame:
    """FLT3: users and items with enough positive ratings, both counted on the unfiltered table; all their ratings stay."""
    hit = F.sum((F.col("rating") >= positive).cast("int")).alias("__n")
    users = df.groupBy("user_id").agg(hit).where(F.col("__n") >= user_least).select("user_id")
    items = df.groupBy("item_id").agg(hit).where(F.col("__n") >= item_least).select("item_id")
    return df.join(users, "user_id", "left_semi").join(items, "item_id", "left_semi")


def k_core(df: DataFrame, user_least: int, item_least: int, most: int = 5) -> DataFrame:
    """FLT4: users, then items below their least counts leave, until nothing changes or `most` rounds have passed."""
    now, before = df, -1
    for _ in range(most):
        now = written(at_least(at_least(now, "user_id", user_least), "item_id", item_least), "kcore")
        n = now.count()
        if n == before:
            break
        before = n
    return now


def top_percent(df: DataFrame, key: str, percent: float) -> DataFrame:
    """FLT5: the keys with the most rows, int(number of keys * percent / 100) of them; ties by key."""
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), key).limit(int(counts.count() * percent / 100))


def first_of(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """FLT7, WIN9, WIN12, SRC12, SRC14: one row per key, the first in the given order."""
    return df.withColumn("__i", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__i = 1").drop("__i")


def not_blank(column: str) -> Column:
    """FLT7: neither null nor blank."""
    return F.trim(F.coalesce(F.col(column), F.lit(""))) != ""


def consistent_years(left: Column, right: Column, most: int = 1) -> Column:
    """FLT8: true unless both years are known and further apart."""
    return left.isNull() | right.isNull() | (F.abs(left - right) <= most)


def pick_bias(df: DataFrame, keys: list[str], target: float) -> DataFrame:
    """FLT20: one bias block per key: the target, else 0, else the smallest."""
    return first_of(df, keys, [F.desc(F.col("bias") == target), F.desc(F.col("bias") == 0), F.asc("bias")])
