"""Aggregations (AGG) on long facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marquee.operators.ranking import with_position


def dataset_stats(df: DataFrame) -> DataFrame:
    """AGG1: users, items, ratings, density, ratings per user and item. Distinct ids are counted by grouping first."""
    users = df.groupBy("user_id").agg(F.count("*").alias("n")).agg(F.count("*").alias("n_users"), F.sum("n").alias("n_ratings"))
    items = df.groupBy("item_id").agg(F.count("*").alias("n")).agg(F.count("*").alias("n_items"))
    both = users.crossJoin(items)
    return both.select("n_users", "n_items", "n_ratings", (F.col("n_ratings") / F.col("n_users") / F.col("n_items")).alias("density"), (F.col("n_ratings") / F.col("n_users")).alias("per_user"), (F.col("n_ratings") / F.col("n_items")).alias("per_item"))


def long_tail(df: DataFrame, head: float = 0.1, middle: float = 0.4) -> DataFrame:
    """AGG3: items by number of ratings with their rank and head / middle / tail, cut at int(n * share).

    Places come from range partitions in the order of counts and ids, so neither all items nor the many with one count meet
    in one task.
    """
    counts = df.groupBy("item_id").agg(F.count("*").alias("n_ratings"))
    placed = with_position(counts, [F.desc("n_ratings"), "item_id"], "rank").withColumn("rank", F.col("rank") + 1)
    total = placed.agg(F.count("*").alias("total"))
    part = F.when(F.col("rank") <= F.floor(F.col("total") * head), "head").when(F.col("rank") <= F.floor(F.col("total") * middle), "middle").otherwise("tail")
    return placed.crossJoin(F.broadcast(total)).select("item_id", "n_ratings", "rank", part.alias("part"))


def weighted_popularity(df: DataFrame, years: DataFrame, weight: float = 0.5) -> DataFrame:
    """AGG8: count * (1 + weight * (year - min) / (max - min)); a missing year counts as the median year."""
    counts = df.groupBy("item_id").agg(F.count("*").alias("n_ratings"))
    rated = counts.join(years.select("item_id", "year"), "item_id", "left")
    spans = rated.agg(F.min("year").alias("lo"), F.max("year").alias("hi"), F.expr("percentile(year, 0.5)").alias("mid"))
    share = F.coalesce(F.try_divide(F.coalesce(F.col("year").cast("double"), F.col("mid")) - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0))
    return rated.crossJoin(F.broadcast(spans)).select("item_id", "n_ratings", (F.col("n_ratings") * (1 + weight * share)).alias("popularity"))


def genre_entropy(pairs: DataFrame, key: str | None = None) -> DataFrame:
    """AGG10: Shannon entropy (base 2) of the genre counts, and the same over log2 of the number of genres."""
    keys = [key] if key else []
    counts = pairs.groupBy(*keys, "genre").agg(F.count("*").alias("n"))
    total = counts.groupBy(*keys).agg(F.sum("n").alias("t"), F.count("*").alias("k")) if keys else counts.agg(F.sum("n").alias("t"), F.count("*").alias("k"))
    joined = counts.join(total, key) if key else counts.crossJoin(F.broadcast(total))
    p = F.col("n") / F.col("t")
    out = joined.groupBy(*keys, "k").agg((-F.sum(p * F.log2(p))).alias("entropy"))
    return out.withColumn("normalised", F.coalesce(F.try_divide("entropy", F.log2("k")), F.lit(0.0))).drop("k")


def threshold_sweep(df: DataFrame, thresholds: list[int]) -> DataFrame:
    """AGG14: users, items, ratings and density among users with more than t ratings, for every t.

    One pass: users carry their count, items the greatest count of their users; a suffix sum over counts answers all t.
    """
    spark = df.sparkSession
    sizes = df.groupBy("user_id").agg(F.count("*").alias("n"))
    by_user = sizes.groupBy("n").agg(F.count("*").alias("users"), F.sum("n").alias("ratings"))
    by_item = df.join(sizes, "user_id").groupBy("item_id").agg(F.max("n").alias("n")).groupBy("n").agg(F.count("*").alias("items"))
    t = spark.createDataFrame([(x,) for x in thresholds], "t int")
    u = t.join(by_user, F.col("n") > F.col("t"), "left").groupBy("t").agg(F.coalesce(F.sum("users"), F.lit(0)).alias("n_users"), F.coalesce(F.sum("ratings"), F.lit(0)).alias("n_ratings"))
    i = t.join(by_item, F.col("n") > F.col("t"), "left").groupBy("t").agg(F.coalesce(F.sum("items"), F.lit(0)).alias("n_items"))
    return u.join(i, "t").withColumn("density", F.try_divide(F.col("n_ratings").cast("double"), F.col("n_users") * F.col("n_items")))


def overflow_histogram(counts: DataFrame, column: str, limit: int) -> DataFrame:
    """AGG16, SNK9: frequency of min(count, limit) with percentages of two places, the last bin taking what is left of 100."""
    bins = counts.groupBy(F.least(F.col(column), F.lit(limit)).alias("k")).agg(F.count("*").alias("n"))
    total = bins.agg(F.sum("n").alias("t"), F.max("k").alias("last"))
    share = bins.crossJoin(F.broadcast(total)).withColumn("p", F.round(100.0 * F.col("n") / F.col("t"), 2))
    rest = share.where("k < last").agg(F.coalesce(F.sum("p"), F.lit(0.0)).alias("others"))
    return share.crossJoin(F.broadcast(rest)).select("k", "n", F.when(F.col("k") == F.col("last"), F.round(100.0 - F.col("others"), 2)).otherwise(F.col("p")).alias("pct"))


def moving_average(df: DataFrame, order: str, value: str, width: int) -> DataFrame:
    """WIN7: average over `width` consecutive points, only where the window is full; for series of one row a point."""
    w = Window.orderBy(order).rowsBetween(-(width - 1), 0)
    return df.select(order, F.avg(value).over(w).alias("average"), F.count("*").over(w).alias("__n")).where(F.col("__n") == width).drop("__n")
