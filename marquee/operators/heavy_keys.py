"""Problem 7: per-key results when a few keys hold most records.

Rows are range-partitioned on (key, secondary order) with Spark's sampled quantiles, so a heavy key is spread over as many
partitions as it fills. Every partition folds its runs into one partial state per key; the states of keys that straddle
partition boundaries are then stitched. Only those states move in the second exchange: at most one per key and partition.

Defined cases: null keys give no result row but count in the total; null and NaN values are left out of the mean (a key
with none has a null mean) and count as rows; ties in the secondary order don't matter to any result; empty input gives no
rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.operators.skew import partitions_for

#: Rows of a range partition, unless a number of partitions is asked for.
ROWS = 1_000_000


def ranged(df: DataFrame, keys: list[str], secondary: list[str | Column], partitions: int | None = None) -> DataFrame:
    """Rows range-partitioned so that heavy keys are split along the secondary order."""
    order = [F.col(k) if isinstance(k, str) else k for k in (*keys, *secondary)]
    return df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)


def key_stats(df: DataFrame, fields: list[str], value: str, secondary: str, partitions: int | None = None) -> DataFrame:
    """Rows, mean of valid values, and first and last secondary value of every key of every field.

    Columns: key_field, key_value, n_rows, mean_value, first_at, last_at.
    """
    pairs = ", ".join(f"'{f}', cast({f} as bigint)" for f in fields)
    valid = F.when(F.col(value).isNotNull() & ~F.isnan(value), F.col(value))
    # The secondary order ends in a row number's low bits, so that a key whose rows agree in everything can be split as well.
    low = (F.monotonically_increasing_id() % 1024).cast("smallint")
    partitions = partitions or partitions_for(df, df.count() * len(fields), ROWS)
    long = df.select(F.expr(f"stack({len(fields)}, {pairs}) as (key_field, key_value)"), valid.alias("v"), F.col(secondary).alias("s"), low.alias("i"))
    spread = ranged(long.where("key_value is not null"), ["key_field", "key_value"], ["s", "i"], partitions)
    return spread.groupBy("key_field", "key_value").agg(
        F.count("*").alias("n_rows"), F.avg("v").alias("mean_value"), F.min("s").alias("first_at"), F.max("s").alias("last_at")
    )


def heavy_keys(df: DataFrame, fields: list[str], value: str, secondary: str, share: int = 100, partitions: int | None = None) -> DataFrame:
    """Keys with more than 1/share of all rows of df (rows with null keys count): key_field, key_value, n_rows, mean_value."""
    total = df.agg(F.count("*").alias("total"))
    stats = key_stats(df, fields, value, secondary, partitions)
    return stats.crossJoin(F.broadcast(total)).where(F.col("n_rows") * share > F.col("total")).select("key_field", "key_value", "n_rows", "mean_value")
