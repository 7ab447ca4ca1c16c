"""Canonical views of the tables: long facts, never wide matrices.

ratings: one valid row a (user, item): user and item known, rating from 0.5 to 5; the latest counts, then the highest.
items: one row an item. Every view is lazy; readers prune to the columns used.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.operators.ranking import with_position
from marquee.session import table

#: Genre values of a packed field, as an expression: quoted values whole, the placeholder away, the rest split.
_TOKENS = r"""regexp_extract_all(genres, '"(?:[^"]|"")*"|“[^”]*”|(?i:\\(no genres listed\\))|[\\p{L}\\p{M}\\p{N} \\-\'’&]+', 0)"""
_CLEAN = r"""transform(filter({0}, t -> t not like '(%'), t -> regexp_replace(case when t like '"%' then replace(substring(t, 2, length(t) - 2), '""', '"') when t like '“%' then substring(t, 2, length(t) - 2) else t end, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', ''))"""


def _valid(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ratings").where("userId is not null and movieId is not null and rating between 0.5 and 5 and not isnan(rating)")


def rating_rows(spark: SparkSession, d: str) -> DataFrame:
    """(user_id, item_id, rating, ts): all valid rows, of which ratings has the latest of a (user, item)."""
    return _valid(spark, d).select(F.col("userId").alias("user_id"), F.col("movieId").alias("item_id"), "rating", F.col("timestamp").alias("ts"))


def ratings(spark: SparkSession, d: str) -> DataFrame:
    """(user_id, item_id, rating, ts)."""
    raw = _valid(spark, d)
    best = raw.groupBy(F.col("userId").alias("user_id"), F.col("movieId").alias("item_id")).agg(F.max(F.struct("timestamp", "rating")).alias("b"))
    return best.select("user_id", "item_id", F.col("b.rating").alias("rating"), F.col("b.timestamp").alias("ts"))


def items(spark: SparkSession, d: str) -> DataFrame:
    """(item_id, title, genres array, year): the least title of an item's rows, nulls last."""
    raw = table(spark, d, "movies").where("movieId is not null")
    first = raw.groupBy(F.col("movieId").alias("item_id")).agg(F.min(F.struct(F.col("title").isNull(), "title", F.col("genres").isNull(), "genres")).alias("b")).select("item_id", "b.title", "b.genres")
    year = F.regexp_extract("title", r"\((\d{4})\)", 1)
    values = F.coalesce(F.expr(f"filter({_CLEAN.format(_TOKENS)}, t -> t <> '')"), F.array().cast("array<string>"))
    return first.select("item_id", "title", values.alias("genres"), F.when(year != "", year.cast("int")).alias("year"))


def genres(spark: SparkSession, d: str) -> DataFrame:
    """(item_id, genre): distinct genres of every item, in lower case."""
    return items(spark, d).select("item_id", F.explode("genres").alias("g")).select("item_id", F.lower("g").alias("genre")).distinct()


def groups(rated: DataFrame, size: int = 3) -> DataFrame:
    """(group_id, members): all users in order of their ids, in groups of `size`; at most size - 1 users at the end are left over."""
    placed = with_position(rated.select("user_id").distinct(), ["user_id"], "pos").withColumn("group_id", F.floor(F.col("pos") / size))
    listed = placed.groupBy("group_id").agg(F.array_sort(F.collect_list("user_id")).alias("members"))
    return listed.where(F.size("members") == size)


def votes(rated: DataFrame, size: int = 3, window: int = 10) -> DataFrame:
    """(group_id, user_id, round, pos, item_id, vote): every member votes on the own rated items in order of their ids."""
    member = groups(rated, size).select("group_id", F.explode("members").alias("user_id"))
    return votes_of(rated.join(member, "user_id"), window)


def votes_of(own: DataFrame, window: int = 10, keep: tuple[str, ...] = ()) -> DataFrame:
    """votes of members' ratings (group_id, user_id, item_id, rating), with columns of theirs to keep."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("group_id", "user_id").orderBy("item_id"))
    vote = F.when(F.col("rating") >= 3.5, 1).when(F.col("rating") <= 2.5, -1).otherwise(0)
    return own.select("group_id", "user_id", F.floor((n - 1) / window).cast("int").alias("round"), ((n - 1) % window + 1).alias("pos"), "item_id", vote.alias("vote"), *keep)


def votes_in_order(counts: np.ndarray, rating: np.ndarray, window: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """Rounds and votes as votes_of has them, of so many ratings of every member, each member's in order of the items."""
    place = np.arange(len(rating)) - np.repeat(np.cumsum(counts) - counts, counts)
    return place // window, np.where(rating >= 3.5, 1.0, np.where(rating <= 2.5, -1.0, 0.0))


def places(spark: SparkSession, d: str) -> DataFrame:
    """(id, rating, types, reviews): suppliers as places, their order lines as reviews nested in them."""
    t = lambda n: table(spark, d, n)
    lines = t("lineitem").select("l_suppkey", "l_partkey", "l_quantity", "l_orderkey", "l_linenumber")
    reviews = lines.groupBy("l_suppkey").agg(F.sort_array(F.collect_list(F.struct(F.col("l_orderkey").alias("at"), F.col("l_linenumber").alias("line"), F.concat(F.lit("user "), F.col("l_partkey") % 50).alias("user"), (F.floor((F.col("l_quantity") - 1) / 10) + 1).cast("int").alias("rating")))).alias("reviews"))
    kinds = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.array(F.lower("n_name"), F.lower("r_name"), F.lit("restaurant")).alias("types"))
    return t("supplier").join(kinds, F.col("s_nationkey") == F.col("n_nationkey")).join(reviews, F.col("s_suppkey") == F.col("l_suppkey"), "left").select(F.col("s_suppkey").alias("id"), (F.pmod(F.col("s_suppkey"), F.lit(41)) / 10 + 1).alias("rating"), "types", "reviews")


def facts(spark: SparkSession, d: str) -> DataFrame:
    """Report facts, one row a (algorithm, w_size, group_type, bias, run_num): average, matched_count, total."""
    line = table(spark, d, "lineitem")
    pick = lambda c, *v: F.element_at(F.array(*map(F.lit, v)), (F.pmod(F.col(c), F.lit(len(v))) + 1).cast("int"))
    keyed = line.select(
        F.concat("l_returnflag", "l_linestatus", F.pmod("l_suppkey", F.lit(2)).cast("string")).alias("algorithm"), pick("l_linenumber", 1, 3, 5, 10).alias("w_size"), pick("l_suppkey", "similar", "outlier", "divergent", "variance", "random").alias("group_type"), pick("l_partkey", 0.0, 0.5, 1.0, 2.0, 3.0).alias("bias"), F.pmod("l_orderkey", F.lit(3)).cast("int").alias("run_num"), F.col("l_quantity").cast("bigint").alias("q")
    )
    grouped = keyed.groupBy("algorithm", "w_size", "group_type", "bias", "run_num").agg(F.sum("q").alias("s"), F.count("*").alias("total"), F.sum((F.col("q") > 20).cast("bigint")).alias("matched_count"))
    return grouped.select("algorithm", "w_size", "group_type", "bias", "run_num", (F.col("s") / F.col("total") / 10).alias("average"), "matched_count", "total")


#: The same views in DuckDB's SQL.
RATINGS = "(SELECT user_id, item_id, rating, ts FROM (SELECT userId AS user_id, movieId AS item_id, rating, timestamp AS ts, row_number() OVER (PARTITION BY userId, movieId ORDER BY timestamp DESC NULLS LAST, rating DESC) AS rn FROM ratings WHERE userId IS NOT NULL AND movieId IS NOT NULL AND rating BETWEEN 0.5 AND 5 AND NOT isnan(rating)) WHERE rn = 1)"
_SQL_TOKENS = r"""regexp_extract_all(genres, '"(?:[^"]|"")*"|“[^”]*”|\([nN][oO] [gG][eE][nN][rR][eE][sS] [lL][iI][sS][tT][eE][dD]\)|[\p{L}\p{M}\p{N} \-''’&]+')"""
ITEMS = rf"""(SELECT item_id, title, coalesce(list_filter(list_transform(list_filter({_SQL_TOKENS}, lambda t: t NOT LIKE '(%'), lambda t: regexp_replace(CASE WHEN t LIKE '"%' THEN replace(t[2:-2], '""', '"') WHEN t LIKE '“%' THEN t[2:-2] ELSE t END, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')), lambda t: t <> ''), []) AS genres,
    TRY_CAST(regexp_extract(title, '\((\d{{4}})\)', 1) AS INTEGER) AS year FROM (SELECT movieId AS item_id, title, genres, row_number() OVER (PARTITION BY movieId ORDER BY title NULLS LAST, genres NULLS LAST) AS rn FROM movies WHERE movieId IS NOT NULL) WHERE rn = 1)"""
GENRES = f"(SELECT DISTINCT item_id, lower(g) AS genre FROM (SELECT item_id, unnest(genres) AS g FROM {ITEMS}))"
GROUPS = f"(SELECT group_id, list(user_id ORDER BY user_id) AS members FROM (SELECT user_id, (row_number() OVER (ORDER BY user_id) - 1) // 3 AS group_id FROM (SELECT DISTINCT user_id FROM {RATINGS})) GROUP BY group_id HAVING count(*) = 3)"
VOTES = f"(SELECT group_id, user_id, CAST(floor((n - 1) / 10) AS INTEGER) AS round, (n - 1) % 10 + 1 AS pos, item_id, CASE WHEN rating >= 3.5 THEN 1 WHEN rating <= 2.5 THEN -1 ELSE 0 END AS vote FROM (SELECT g.group_id, r.user_id, r.item_id, r.rating, row_number() OVER (PARTITION BY g.group_id, r.user_id ORDER BY r.item_id) AS n FROM {RATINGS} r JOIN (SELECT group_id, unnest(members) AS user_id FROM {GROUPS}) g USING (user_id)))"
REVIEWS = "(SELECT l_suppkey AS id, l_orderkey AS at, l_linenumber AS line, 'user ' || CAST(l_partkey % 50 AS VARCHAR) AS user, CAST(floor((l_quantity - 1) / 10) + 1 AS INTEGER) AS rating FROM lineitem)"
FACTS = """(SELECT algorithm, w_size, group_type, bias, run_num, sum(q) / count(*) / 10 AS average, sum(CASE WHEN q > 20 THEN 1 ELSE 0 END) AS matched_count, count(*) AS total FROM (SELECT l_returnflag || l_linestatus || CAST(l_suppkey % 2 AS VARCHAR) AS algorithm, ([1, 3, 5, 10])[l_linenumber % 4 + 1] AS w_size, (['similar', 'outlier', 'divergent', 'variance', 'random'])[l_suppkey % 5 + 1] AS group_type, ([0.0, 0.5, 1.0, 2.0, 3.0])[l_partkey % 5 + 1]::DOUBLE AS bias, CAST(l_orderkey % 3 AS INTEGER) AS run_num, CAST(l_quantity AS BIGINT) AS q FROM lineitem) GROUP BY ALL)"""
