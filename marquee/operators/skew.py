"""Laying rows out by key when a few keys may hold a large part of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than 1/HOT of the sampled rows is hot, so there are fewer than HOT hot keys.
HOT = 256
#: Parts a hot key's rows are spread over.
PARTS = 64
#: Share of the rows looked at to find hot keys. It decides only where rows lie, never a result.
LOOK = 0.02


def partitions_for(df: DataFrame, rows: int, each: int) -> int:
    """Partitions of about `each` of the rows, no fewer than the session's shuffle partitions."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // each))


def hot_keys(df: DataFrame, key: str, rows: int) -> list:
    """Keys that hold more than 1/HOT of a sample of the df's `rows` rows (fewer than HOT of them)."""
    seen = df.where(F.col(key).isNotNull()).sample(LOOK, 7).groupBy(key).agg(F.count("*").alias("n"))
    least = max(1000.0, rows * LOOK / HOT)
    return [r[0] for r in seen.where(F.col("n") > least).orderBy(F.desc("n")).limit(HOT).collect()]


def clustered(df: DataFrame, key: str, item: str, limit: int = 50_000, each: int = 500_000) -> DataFrame:
    """(key, part, item) rows without nulls: partitioned by key and part, sorted by key, part and item.

    part is 0 for all rows of an ordinary key, so they lie together. A hot key's rows are made distinct first, on the map
    side too; if no more than `limit` remain they lie together as well, else they are spread over PARTS by item. A partition has about `each` rows.
    """
    rows = df.select(F.col(key).alias("k"), F.col(item).alias("x")).where("k is not null and x is not null")
    total = rows.count()
    hot = hot_keys(rows, "k", total)
    if hot:
        distinct = rows.where(F.col("k").isin(hot)).distinct()
        sizes = distinct.groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") > limit).collect()  # fewer than HOT rows
        big = [r.k for r in sizes]
        part = F.when(F.col("k").isin(big), F.pmod(F.xxhash64("x"), F.lit(PARTS)).cast("int") + 1).otherwise(0) if big else F.lit(0)
        rows = rows.where(~F.col("k").isin(hot)).withColumn("part", F.lit(0)).unionByName(distinct.withColumn("part", part))
    else:
        rows = rows.withColumn("part", F.lit(0))
    return rows.repartition(partitions_for(df, total, each), "k", "part").sortWithinPartitions("k", "part", "x").select("k", "part", "x")
