"""Synthetic groups and leak-free hold-out (GRP, GTH).

Pair tables are long (a, b, sim); "random" choices are hash-ranked, so every result is reproducible.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marquee.operators.matrix import common_items
from marquee.operators.splits import hash_order, split_keys


def random_groups(users: DataFrame, n: int, size: int = 3, seed: int = 42, tries: int = 10) -> DataFrame:
    """GRP2: up to n distinct groups; each draws `size` members by hash among the users of its slot, repeats fall out."""
    slots = users.sparkSession.range(n * tries).select(F.col("id").alias("slot"))
    users = users.select("user_id").where("user_id is not null").distinct()
    count = users.count()
    if count < size:
        return users.sparkSession.createDataFrame([], "group_id bigint, members array<bigint>")
    from marquee.operators.ranking import with_position

    placed = with_position(users, ["user_id"], "pos")
    draws = slots.select("slot", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("k")).select("slot", F.pmod(F.xxhash64("slot", "k", F.lit(seed)), F.lit(count)).alias("pos"))
    drawn = draws.join(placed, "pos").groupBy("slot").agg(F.array_sort(F.collect_set("user_id")).alias("members")).where(F.size("members") == size)
    first = drawn.groupBy("members").agg(F.min("slot").alias("group_id"))
    return first.orderBy("group_id").limit(n).select("group_id", "members")


def restricted(groups: DataFrame, rated: DataFrame, least: int) -> DataFrame:
    """GRP2: groups with at least so many common items."""
    enough = common_items(groups, rated).groupBy("group_id").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return groups.join(enough, "group_id", "left_semi")


def edges(pairs: DataFrame, low: float | None = None, high: float | None = None) -> DataFrame:
    """Pairs with sim >= low (similar) or sim <= high (opposite)."""
    return pairs.where(F.col("sim") >= low) if low is not None else pairs.where(F.col("sim") <= high)


def triangles(e: DataFrame) -> DataFrame:
    """GRP3, GRP5: triples a < b < c with all three edges."""
    ab, bc, ac = (e.select(F.col("a").alias(x), F.col("b").alias(y)) for x, y in ("ab", "bc", "ac"))
    return ab.join(bc, "b").join(ac, ["a", "c"]).select("a", "b", "c")


def one_per_seed(triples: DataFrame) -> DataFrame:
    """The first triple of every first member, as groups."""
    return triples.groupBy("a").agg(F.min(F.struct("b", "c")).alias("t")).select(F.col("a").alias("group_id"), F.array("a", "t.b", "t.c").alias("members"))


def similar_groups(pairs: DataFrame, ts: float) -> DataFrame:
    """GRP3: groups of three with similarity at least ts throughout, one per seed."""
    return one_per_seed(triangles(edges(pairs, low=ts)))


def divergent_groups(pairs: DataFrame, to: float) -> DataFrame:
    """GRP5: groups of three with similarity at most `to` throughout, one per seed."""
    return one_per_seed(triangles(edges(pairs, high=to)))


def outlier_groups(pairs: DataFrame, ts: float, to: float) -> DataFrame:
    """GRP4: a similar pair and a third far from both, the first by hash order per pair's first member."""
    close, far = edges(pairs, low=ts), edges(pairs, high=to)
    both = far.select(F.col("a").alias("x"), F.col("b").alias("o")).union(far.select("b", "a"))
    found = close.join(both.withColumnRenamed("x", "a"), "a").join(both.withColumnRenamed("x", "b"), ["b", "o"])
    order = (F.col("o") * 40503) % 1000003
    picked = found.groupBy("a").agg(F.min(F.struct("b", order.alias("h"), "o")).alias("t"))
    return picked.select(F.col("a").alias("group_id"), F.array("a", "t.b", "t.o").alias("members"))


def variance_groups(groups: DataFrame, rated: DataFrame, least: float = 1.2) -> DataFrame:
    """GRP6: groups whose mean rating variance over common items reaches `least`, with it."""
    member = groups.select("group_id", F.size("members").alias("size"), F.explode("members").alias("user_id"))
    v = member.join(rated, "user_id").groupBy("group_id", "item_id", "size").agg(F.var_pop("rating").alias("v"), F.count("*").alias("n")).where("n = size")
    return groups.join(v.groupBy("group_id").agg(F.avg("v").alias("variance")).where(F.col("variance") >= least), "group_id")


def split_groups(groups: DataFrame, seed: int = 42, val: int | None = None, test: int | None = None) -> DataFrame:
    """GRP7: (group_id, part). With counts: val and test of that size, in proportion when there are too few groups."""
    if val is None:
        return split_keys(groups.select("group_id"), "group_id", seed)
    n = groups.count()
    if val + test > n:
        val, test = int(n * val / (val + test)), n - int(n * val / (val + test))
    from marquee.operators.ranking import with_position

    placed = with_position(groups.select("group_id", hash_order("group_id", None, seed).alias("h")), ["h", "group_id"], "pos")
    return placed.select("group_id", F.when(F.col("pos") < val, "val").when(F.col("pos") < val + test, "test").otherwise("train").alias("part"))


def validate_pairs(groups: DataFrame, pairs: DataFrame, low: float | None = None, high: float | None = None) -> DataFrame:
    """GRP8: groups that break their rule: some pair of members below low or above high."""
    m = groups.select("group_id", F.explode("members").alias("x"))
    both = m.join(m.withColumnRenamed("x", "y"), "group_id").where("x < y").join(pairs.select(F.col("a").alias("x"), F.col("b").alias("y"), "sim"), ["x", "y"], "left")
    bad = F.col("sim").isNull()
    bad = bad | (F.col("sim") < low) if low is not None else bad
    bad = bad | (F.col("sim") > high) if high is not None else bad
    return both.where(bad).select("group_id").distinct()


def validate_outliers(groups: DataFrame, pairs: DataFrame, ts: float, to: float) -> DataFrame:
    """GRP8: groups of three that are no outlier groups: the most similar two of them below ts, or the third above `to` to either.

    A pair without a similarity breaks the rule; ties for the most similar pair go to the smaller members.
    """
    m = groups.select("group_id", F.explode("members").alias("x"))
    both = m.join(m.withColumnRenamed("x", "y"), "group_id").where("x < y").join(pairs.select(F.col("a").alias("x"), F.col("b").alias("y"), "sim"), ["x", "y"], "left")
    place = F.row_number().over(Window.partitionBy("group_id").orderBy(F.desc_nulls_last("sim"), "x", "y"))
    bad = F.col("sim").isNull() | F.when(F.col("i") == 1, F.col("sim") < ts).otherwise(F.col("sim") > to)
    return both.withColumn("i", place).where(bad).select("group_id").distinct()


def validate_members(groups: DataFrame, rated: DataFrame, least: int) -> DataFrame:
    """GRP8: groups with a repeated member, a member with fewer than `least` ratings, or the members of an earlier group."""
    counts = rated.groupBy("user_id").agg(F.count("*").alias("n"))
    m = groups.select("group_id", F.explode("members").alias("user_id")).join(counts, "user_id", "left")
    few = m.where(F.coalesce("n", F.lit(0)) < least).select("group_id")
    repeated = groups.where(F.size(F.array_distinct("members")) < F.size("members")).select("group_id")
    keyed = groups.select("group_id", F.array_sort("members").alias("k"))
    later = keyed.join(keyed.groupBy("k").agg(F.min("group_id").alias("first")), "k").where("group_id > first").select("group_id")
    return few.unionByName(repeated).unionByName(later).distinct()


def disjoint_groups(groups: DataFrame) -> DataFrame:
    """SET5: in order of group ids, groups that share no member with one taken before.

    Greedy choice in a fixed order is sequential; it runs in one task over groups only, streamed in order, holding the
    members taken so far.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        taken: set[int] = set()
        for batch in batches:
            keep = []
            for members in batch.members:
                ok = taken.isdisjoint(members)
                keep.append(ok)
                if ok:
                    taken.update(members)
            yield batch[keep]

    return groups.select("group_id", "members").coalesce(1).sortWithinPartitions("group_id").mapInPandas(run, "group_id bigint, members array<bigint>")


def capacity_filter(groups: DataFrame, rated: DataFrame, ratio: float = 0.5, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """GTH2: kept groups, and their capped common items (group_id, item_id).

    A group's common items are capped at the least ceil(ratio * ratings) of its members, by hash order; groups with a member
    whose required items over all groups exceed the own capacity fall out, in one pass.
    """
    member = groups.select("group_id", F.explode("members").alias("user_id"))
    capacity = rated.groupBy("user_id").agg(F.ceil(F.count("*") * ratio).alias("cap"))
    group_cap = member.join(capacity, "user_id").groupBy("group_id").agg(F.min("cap").alias("cap"))
    order = Window.partitionBy("group_id").orderBy(hash_order("group_id", "item_id", seed), "item_id")
    capped = common_items(groups, rated).join(group_cap, "group_id").withColumn("i", F.row_number().over(order)).where("i <= cap").select("group_id", "item_id")
    required = member.join(capped, "group_id").select("user_id", "item_id").distinct().groupBy("user_id").agg(F.count("*").alias("n"))
    over = required.join(capacity, "user_id").where("n > cap").select("user_id")
    bad = member.join(over, "user_id", "left_semi").select("group_id").distinct()
    return groups.join(bad, "group_id", "left_anti"), capped.join(bad, "group_id", "left_anti")


def hold_out(groups: DataFrame, rated: DataFrame, ratio: float = 0.5, seed: int = 42) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """GTH3, GTH4: (ratings without held-out items, kept groups, user truth, group truth).

    Each member's truth is the required items and others in hash order up to ceil(ratio * ratings).
    """
    kept, common = capacity_filter(groups, rated, ratio, seed)
    member = kept.select("group_id", F.explode("members").alias("user_id"))
    required = member.join(common, "group_id").select("user_id", "item_id", F.lit(1).alias("required")).distinct()
    mine = rated.join(member.select("user_id").distinct(), "user_id", "left_semi").select("user_id", "item_id").join(required, ["user_id", "item_id"], "left").na.fill(0, ["required"])
    w = Window.partitionBy("user_id")
    rank = F.row_number().over(w.orderBy(F.desc("required"), hash_order("user_id", "item_id", seed), "item_id"))
    truth = mine.withColumn("i", rank).withColumn("n", F.count("*").over(w)).where(F.col("i") <= F.ceil(F.col("n") * ratio)).select("user_id", "item_id")
    return rated.join(truth, ["user_id", "item_id"], "left_anti"), kept, truth, common


def without_common(groups: DataFrame, rated: DataFrame) -> DataFrame:
    """GTH5: ratings without the common items of members' groups."""
    member = groups.select("group_id", F.explode("members").alias("user_id"))
    gone = member.join(common_items(groups, rated), "group_id").select("user_id", "item_id").distinct()
    return rated.join(gone, ["user_id", "item_id"], "left_anti")


def evaluation_context(rated: DataFrame, groups: DataFrame, part: str, user_least: int, item_least: int, seed: int = 42) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """GTH6: thresholds, the groups of one split whose members are left, and their hold-out."""
    from marquee.operators.filters import interaction_thresholds

    enough = interaction_thresholds(rated, user_least, item_least)
    parts = split_groups(groups, seed).where(F.col("part") == part)
    chosen = groups.join(parts, "group_id", "left_semi")
    missing = chosen.select("group_id", F.explode("members").alias("user_id")).join(enough.select("user_id").distinct(), "user_id", "left_anti").select("group_id")
    return hold_out(chosen.join(missing, "group_id", "left_anti"), enough, 0.5, seed)
