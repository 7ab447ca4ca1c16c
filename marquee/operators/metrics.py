"""Ranking metrics (MET): rankings (user_id, item_id, place) against held-out (user_id, item_id)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ndcg_cut(ranking: DataFrame, truth: DataFrame, k: int, key: str = "user_id") -> DataFrame:
    """MET1: binary NDCG@k per user of the truth, ideal over min(#truth, k); 0 for users without a ranking."""
    size = truth.groupBy(key).agg(F.count("*").alias("n"))
    gain = ranking.where(F.col("place") <= k).join(truth.select(key, "item_id").distinct(), [key, "item_id"]).groupBy(key).agg(F.sum(1 / F.log2(F.col("place") + 1)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, j: s + 1 / F.log2(j + 1))
    return size.join(gain, key, "left").select(key, (F.coalesce("dcg", F.lit(0.0)) / ideal).alias("ndcg"))


def ndcg_list(ranking: DataFrame, truth: DataFrame, k: int, key: str = "user_id") -> DataFrame:
    """MET4: NDCG of the returned list against its own best order; 0 where it has no hit."""
    top = ranking.where(F.col("place") <= k).join(truth.select(key, "item_id", F.lit(1).alias("hit")).distinct(), [key, "item_id"], "left")
    sums = top.groupBy(key).agg(F.sum(F.when(F.col("hit") == 1, 1 / F.log2(F.col("place") + 1)).otherwise(0.0)).alias("dcg"), F.count("hit").alias("h"))
    ideal = F.aggregate(F.when(F.col("h") > 0, F.sequence(F.lit(1), F.col("h").cast("int"))).otherwise(F.array(F.lit(1))), F.lit(0.0), lambda s, j: s + 1 / F.log2(j + 1))
    return sums.select(key, (F.col("dcg") / ideal).alias("ndcg"))


def per_user_precision_recall(ranking: DataFrame, truth: DataFrame, k: int, key: str = "user_id") -> DataFrame:
    """MET3: hits / k (also where fewer were returned) and hits / #truth, per user of the truth."""
    size = truth.groupBy(key).agg(F.count("*").alias("n"))
    hits = ranking.where(F.col("place") <= k).join(truth.select(key, "item_id"), [key, "item_id"], "left_semi").groupBy(key).agg(F.count("*").alias("h"))
    return size.join(hits, key, "left").select(key, (F.coalesce("h", F.lit(0)) / k).alias("precision"), (F.coalesce("h", F.lit(0)) / F.col("n")).alias("recall"))


def precision_recall(ranking: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """MET3: their means over users."""
    return per_user_precision_recall(ranking, truth, k).agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"))


def group_ndcg(ranking: DataFrame, groups: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """MET2: (group_id, mean, least, most) of the members' NDCG of a group ranking against their own truth."""
    member = groups.select("group_id", F.explode("members").alias("user_id"))
    own = member.join(truth, "user_id").select(F.struct("group_id", "user_id").alias("key"), "item_id")
    shown = member.join(ranking, "group_id").select(F.struct("group_id", "user_id").alias("key"), "item_id", "place")
    scores = ndcg_cut(shown, own, k, "key")
    return scores.groupBy(F.col("key.group_id").alias("group_id")).agg(F.avg("ndcg").alias("mean"), F.min("ndcg").alias("least"), F.max("ndcg").alias("most"))


def list_precision(items: DataFrame, rated: DataFrame, k: int, relevant: float = 3.5) -> DataFrame:
    """MET5: precision of one list for all users with a relevant rating."""
    liked = rated.where(F.col("rating") >= relevant)
    users = liked.select("user_id").distinct().agg(F.count("*").alias("n"))
    hits = liked.join(items, "item_id", "left_semi").agg(F.count("*").alias("h"))
    return hits.crossJoin(users).select(F.coalesce(F.try_divide(F.col("h").cast("double"), F.col("n") * k), F.lit(0.0)).alias("precision"))


def rmse(predicted: DataFrame, actual: str, estimate: str) -> DataFrame:
    """MET7."""
    return predicted.agg(F.sqrt(F.avg(F.pow(F.col(actual) - F.col(estimate), F.lit(2)))).alias("rmse"))


def first_consensus(votes: DataFrame, size: int, distinct: bool = False) -> DataFrame:
    """CON12, MET8: (group_id, round) in which an item first has as many likes as members.

    Likes add up over rounds; distinct counts a member once (an item offered twice may else match by one member alone).
    """
    from pyspark.sql import Window

    liked = votes.where("vote = 1")
    if distinct:
        liked = liked.groupBy("group_id", "item_id", "user_id").agg(F.min("round").alias("round"))
    per_round = liked.groupBy("group_id", "item_id", "round").agg(F.count("*").alias("n"))
    so_far = per_round.withColumn("c", F.sum("n").over(Window.partitionBy("group_id", "item_id").orderBy("round")))
    matched = so_far.where(F.col("c") == size).groupBy("group_id", "item_id").agg(F.min("round").alias("round"))
    return matched.groupBy("group_id").agg(F.min("round").alias("round"))


def common_truth_stats(common: DataFrame, ranking: DataFrame, groups: DataFrame, k: int) -> DataFrame:
    """MET9: mean size of the common truth, share of groups that have one, hit rate and recall of the first k positions."""
    size = common.groupBy("group_id").agg(F.count("*").alias("n"))
    hits = ranking.where(F.col("place") <= k).join(common, ["group_id", "item_id"]).groupBy("group_id").agg(F.count("*").alias("h"))
    all_ = groups.select("group_id").join(size, "group_id", "left").join(hits, "group_id", "left").na.fill(0, ["n", "h"])
    has = F.col("n") > 0
    return all_.agg(F.avg("n").alias("mean_size"), F.avg(has.cast("double")).alias("share"), F.avg(F.when(has, (F.col("h") > 0).cast("double"))).alias("hit_rate"), F.avg(F.when(has, F.col("h") / F.col("n"))).alias("recall"))
