"""Report tables (AGG20-AGG37, WIN5, WIN6, WIN13, SRT4, JOI13) over result facts.

Facts hold one row per (algorithm, w_size, group_type, bias, run_num) with average, matched_count and total.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mean_by(df: DataFrame, keys: list[str], value: str = "average") -> DataFrame:
    """AGG20, AGG22, AGG26, AGG36: mean over whatever is not a key; NaN counts as missing."""
    clean = F.when(~F.isnan(value), F.col(value))
    return df.groupBy(*keys).agg(F.avg(clean).alias("mean"))


def pivoted(df: DataFrame, rows: list[str], column: str, values: list, value: str = "average") -> DataFrame:
    """AGG22, AGG36: mean of value with the given column values side by side; named after them."""
    return df.groupBy(*rows).pivot(column, values).agg(F.avg(value))


def with_margin(df: DataFrame, rows: list[str], column: str, value: str = "average") -> DataFrame:
    """AGG23: cells and row margins (column null) in one pass of grouping sets, ignoring missing values."""
    cells = df.groupBy(*rows, column).agg(F.avg(value).alias("mean"))
    margin = cells.groupBy(*rows).agg(F.avg("mean").alias("mean")).withColumn(column, F.lit(None).cast(df.schema[column].dataType))
    return cells.unionByName(margin)


def success_rate(df: DataFrame, keys: list[str]) -> DataFrame:
    """AGG24, AGG25: sum of matched over sum of total (not a mean of ratios), and the unmatched share."""
    s = df.groupBy(*keys).agg(F.sum("matched_count").alias("m"), F.sum("total").alias("t"))
    rate = F.try_divide(F.col("m").cast("double"), F.col("t"))
    return s.select(*keys, rate.alias("success_rate"), F.greatest(F.lit(0.0), 1 - rate).alias("unmatched"))


def best_per(df: DataFrame, keys: list[str], name: str, value: str) -> DataFrame:
    """AGG27: the name of the least value per key; ties by name."""
    best = F.min(F.struct(F.col(value), F.col(name))).alias("b")
    return df.groupBy(*keys).agg(best).select(*keys, F.col(f"b.{name}").alias(name), F.col(f"b.{value}").alias(value))


def first_against_rest(df: DataFrame, keys: list[str], window: int = 1) -> DataFrame:
    """AGG28: mean at one window size, and over all others."""
    return df.groupBy(*keys).agg(F.avg(F.when(F.col("w_size") == window, F.col("average"))).alias("first"), F.avg(F.when(F.col("w_size") != window, F.col("average"))).alias("rest"))


def tune_summary(df: DataFrame, keys: list[str], params: str, value: str) -> DataFrame:
    """AGG29: mean, sample variance and deviation, and the parameters of the least and greatest value."""
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.var_samp(value).alias("variance"), F.stddev_samp(value).alias("deviation"), F.min(F.struct(value, params)).getField(params).alias("best"), F.max(F.struct(value, params)).getField(params).alias("worst"))


def coalesced(df: DataFrame, key: str, columns: list[str], order: str) -> DataFrame:
    """AGG30: sparse rows of one key in one row, the first known value of every column by the given order."""
    picks = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns]
    return df.groupBy(key).agg(*picks)


def sigma_summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """AGG31: mean, population deviation, standard error and the 95 % interval."""
    s = df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("sigma"), (F.stddev_samp(value) / F.sqrt(F.count(value))).alias("error"))
    return s.select(*keys, "mean", "sigma", "error", (F.col("mean") - 1.96 * F.col("error")).alias("low"), (F.col("mean") + 1.96 * F.col("error")).alias("high"))


def best_two(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """WIN5, WIN6: rows with the least and second least distinct value per key (place 1 and 2)."""
    return df.withColumn("place", F.dense_rank().over(Window.partitionBy(*keys).orderBy(value)).cast("bigint")).where("place <= 2")


def preferred_rank(column: str, order: list[str], missing: int = 1000) -> Column:
    """WIN13, SRT4: position in a preferred order from 1; unknown values come last."""
    at = F.array_position(F.array(*map(F.lit, order)), F.col(column))
    return F.when(at > 0, at).otherwise(missing)


def outer_grid(df: DataFrame, axes: list[str], value: str) -> DataFrame:
    """JOI13: every combination of the axes' values, '--' where there is none. Axes of reports have a few values each."""
    grid = None
    for a in axes:
        values = df.select(a).distinct()
        grid = values if grid is None else grid.crossJoin(F.broadcast(values))
    return grid.join(df, axes, "left").withColumn("cell", F.when(F.col(value).isNotNull(), F.format_string("%.2f", F.col(value))).otherwise("--"))


def flattened(nested: DataFrame) -> DataFrame:
    """PRJ4, PRJ5: {group_type: {bias: stats}} maps to rows; a metric missing at the top is taken from `metrics`."""
    by_type = nested.select("algorithm", F.explode("results").alias("group_type", "by_bias"))
    rows = by_type.select("algorithm", "group_type", F.explode("by_bias").alias("bias", "stats"))
    rate = F.try_divide(F.col("stats.matched_count").cast("double"), F.col("stats.total"))
    return rows.select("algorithm", "group_type", F.col("bias").cast("double").alias("bias"), F.coalesce("stats.average", "stats.metrics.average").alias("average"), rate.alias("success_rate"))
