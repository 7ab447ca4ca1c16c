"""Global positions without a window over everything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.session import written


def with_position(df: DataFrame, order: list[str | Column], out: str = "position") -> DataFrame:
    """Rows with their 0-based position in the order (total: ties make it arbitrary).

    Range partitions are sorted on their own and numbered through by their sizes; only those sizes, one row a partition,
    reach the driver. The table is written first, so that positions survive recomputation.
    """
    laid = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    local = written(laid, "position")
    pid, low = F.shiftright("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    starts, total = [], 0
    for r in local.groupBy(pid.alias("pid")).agg((F.max(low) + 1).alias("n")).orderBy("pid").collect():
        starts.append((r.pid, total))
        total += r.n
    offsets = df.sparkSession.createDataFrame(starts, "pid bigint, start bigint")
    return local.withColumn("pid", pid).join(F.broadcast(offsets), "pid").withColumn(out, F.col("start") + low).drop("pid", "start", "__at")


def unseen_summary(rated: DataFrame) -> DataFrame:
    """JOI11: (user_id, n_unseen, first_item): of all rated items, how many a user hasn't rated, and the least of them.

    The least one is the first gap among the places of the user's own items; users who have rated everything have no row.
    """
    items = with_position(rated.select("item_id").distinct(), ["item_id"])
    own = rated.select("user_id", "item_id").distinct().join(items, "item_id")
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("item_id")) - 1
    users = own.withColumn("n", n).groupBy("user_id").agg(F.count("*").alias("seen"), F.sum((F.col("n") == F.col("position")).cast("bigint")).alias("position"))
    total = items.agg(F.count("*").alias("total"))
    return users.join(items, "position").crossJoin(F.broadcast(total)).select("user_id", (F.col("total") - F.col("seen")).alias("n_unseen"), F.col("item_id").alias("first_item"))
