"""Problem 6: the top N items within every group.

A mergeable aggregate keeps a heap of at most N structs per group: Spark's own bounded priority queue aggregate fills it on
the map side, so at most N entries per group and task are shuffled and merged. Entries compare by score, then by a tie
rule that ends in the item's id, so the order is total.

Defined cases: rows with a null group, item or score, a NaN score or one outside the valid range are left out; among
repeated (group, item) rows the latest counts, then the highest score (a null time is the oldest); groups with fewer items
have fewer places; empty input gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bounded_heap(value: Column, n: int) -> Column:
    """Aggregate: the n greatest values in descending order, held in a heap of size n, partial before the shuffle."""
    from pyspark.sql import SparkSession
    from pyspark.sql.classic.column import Column as JvmColumn
    from pyspark.sql.classic.column import _to_java_column, _to_seq

    context = SparkSession.active().sparkContext
    columns = getattr(getattr(context._jvm, "org.apache.spark.sql.Column$"), "MODULE$")
    return JvmColumn(columns.internalFn("collect_top_k", _to_seq(context, [value, F.lit(n), F.lit(False)], _to_java_column)))


def latest(df: DataFrame, group: str, item: str, score: str, at: str, low: float, high: float) -> DataFrame:
    """Valid rows, one per (group, item): (g, i, s, a)."""
    rows = df.select(F.col(group).alias("g"), F.col(item).alias("i"), F.col(score).alias("s"), F.col(at).alias("a"))
    valid = rows.where(f"g is not null and i is not null and s between {low} and {high} and not isnan(s)")
    # Time and score belong to one row, so they are compared together; Spark sorts to aggregate structs, partially first.
    best = F.max(F.struct(F.col("a"), F.col("s"))).alias("best")
    return valid.groupBy("g", "i").agg(best).select("g", "i", F.col("best.s").alias("s"), F.col("best.a").alias("a"))


def top_items(df: DataFrame, group: str, item: str, score: str, at: str, n: int, low: float = 0.5, high: float = 5.0) -> DataFrame:
    """(group_id, place, item_id, score) with places 1 to n by score descending, time descending (null last), item ascending."""
    rows = latest(df, group, item, score, at, low, high)
    entry = F.struct(F.col("s"), F.col("a"), F.negate(F.col("i").cast("bigint")).alias("m"))
    heaps = rows.groupBy("g").agg(bounded_heap(entry, n).alias("heap"))
    placed = heaps.select(F.col("g").alias("group_id"), F.posexplode("heap").alias("p", "e"))
    return placed.select("group_id", (F.col("p") + 1).cast("bigint").alias("place"), F.negate(F.col("e.m")).alias("item_id"), F.col("e.s").alias("score"))
