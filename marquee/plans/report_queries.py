"""Queries of report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from marquee.operators import filters as L
from marquee.operators import reports as P
from marquee.plans.registry import Book
from marquee.session import table
from marquee.sources import views as V
from marquee.sources.sinks import last_written, upserted
from marquee.sources.views import FACTS, RATINGS, VOTES

book = Book()
add = book.add
X = V.facts
KEYS = ["algorithm", "w_size", "group_type", "bias"]
LATEST = f"(SELECT * FROM {FACTS} QUALIFY row_number() OVER (PARTITION BY algorithm, w_size, group_type, bias ORDER BY run_num DESC) = 1)"


def latest(s, d):
    return last_written(X(s, d), KEYS, "run_num")


def r6(c):
    return F.round(c, 6)


@add("src12_latest_run", f"SELECT algorithm, w_size, group_type, bias, run_num FROM {FACTS} QUALIFY run_num = max(run_num) OVER (PARTITION BY algorithm, w_size)")
def _(s, d):
    from marquee.sources.readers import latest_run

    return latest_run(X(s, d), ["algorithm", "w_size"]).select(*KEYS, "run_num")


@add("snk2_upsert_run", f"WITH f AS {FACTS}, o AS (SELECT * FROM f WHERE run_num = 0), n AS (SELECT * FROM f WHERE run_num = 1 AND group_type = 'similar') SELECT algorithm, w_size, group_type, bias, run_num, total FROM (SELECT * FROM o WHERE (algorithm, w_size, group_type, bias) NOT IN (SELECT algorithm, w_size, group_type, bias FROM n) UNION ALL SELECT * FROM n)")
def _(s, d):
    f = X(s, d)
    return upserted(f.where("run_num = 0"), f.where("run_num = 1 and group_type = 'similar'"), KEYS).select(*KEYS, "run_num", "total")


@add("snk3_merge_runs", f"SELECT algorithm, w_size, group_type, bias, run_num, total FROM {LATEST}")
def _(s, d):
    return latest(s, d).select(*KEYS, "run_num", "total")


@add("snk10_strip_heavy", f"SELECT algorithm, w_size, group_type, bias, total FROM {LATEST}")
def _(s, d):
    from marquee.sources.sinks import without

    return without(latest(s, d), "average", "matched_count", "run_num")


@add("flt13_report_filters", f"SELECT algorithm, w_size, group_type, bias, total FROM {LATEST} WHERE w_size IN (1, 10) AND bias IN (0, 1) AND group_type IN ('similar', 'random')")
def _(s, d):
    return latest(s, d).where("w_size in (1, 10) and bias in (0, 1) and group_type in ('similar', 'random')").select(*KEYS, "total")


@add("flt20_pick_bias", f"SELECT algorithm, w_size, group_type, bias FROM {LATEST} QUALIFY row_number() OVER (PARTITION BY algorithm, w_size, group_type ORDER BY bias = 2 DESC, bias = 0 DESC, bias) = 1")
def _(s, d):
    return L.pick_bias(latest(s, d), ["algorithm", "w_size", "group_type"], 2.0).select(*KEYS)


@add("prj4_flatten", f"SELECT algorithm, group_type, bias, round(sum(matched_count) / sum(total), 6) AS success_rate, round(sum(average), 6) AS average FROM {LATEST} WHERE w_size = 1 GROUP BY ALL")
def _(s, d):
    rows = latest(s, d).where("w_size = 1")
    stats = F.struct(F.lit(None).cast("double").alias("average"), F.struct("average").alias("metrics"), "matched_count", "total")
    by_bias = rows.groupBy("algorithm", "group_type").agg(F.map_from_entries(F.collect_list(F.struct(F.col("bias").cast("string"), stats))).alias("by_bias"))
    nested = by_bias.groupBy("algorithm").agg(F.map_from_entries(F.collect_list(F.struct("group_type", "by_bias"))).alias("results"))
    return P.flattened(nested).withColumn("average", r6("average")).withColumn("success_rate", r6("success_rate"))


@add("joi13_outer_grid", f"WITH m AS (SELECT algorithm, w_size, round(avg(average), 2) AS v FROM {LATEST} WHERE NOT (w_size = 3 AND algorithm LIKE '%1') GROUP BY ALL) SELECT a.algorithm, w.w_size, CASE WHEN v IS NULL THEN '--' ELSE printf('%.2f', v) END AS cell FROM (SELECT DISTINCT algorithm FROM m) a CROSS JOIN (SELECT DISTINCT w_size FROM m) w LEFT JOIN m ON m.algorithm = a.algorithm AND m.w_size = w.w_size")
def _(s, d):
    m = latest(s, d).where("not (w_size = 3 and algorithm like '%1')").groupBy("algorithm", "w_size").agg(F.round(F.avg("average"), 2).alias("v"))
    return P.outer_grid(m, ["algorithm", "w_size"], "v").select("algorithm", "w_size", "cell")


@add("agg20_fold_means", f"SELECT fold, round(avg(rating), 6) AS mean, count(*) AS n FROM (SELECT rating, (user_id * 2654435761 + item_id * 40503 + 42) % 1000003 % 5 AS fold FROM {RATINGS}) GROUP BY fold")
def _(s, d):
    from marquee.operators.splits import k_fold

    return k_fold(V.ratings(s, d), "user_id", "item_id").groupBy("fold").agg(r6(F.avg("rating")).alias("mean"), F.count("*").alias("n"))


@add("agg21_group_stats", f"WITH f AS (SELECT group_id, item_id, min(round) AS first FROM {VOTES} WHERE vote = 1 GROUP BY 1, 2) SELECT group_id, round(avg(first), 4) AS mean, round(var_pop(first), 4) AS variance, round(stddev_pop(first), 4) AS deviation, count(*) AS n FROM f GROUP BY 1")
def _(s, d):
    f = V.votes(V.ratings(s, d)).where("vote = 1").groupBy("group_id", "item_id").agg(F.min("round").alias("first"))
    return f.groupBy("group_id").agg(F.round(F.avg("first"), 4).alias("mean"), F.round(F.var_pop("first"), 4).alias("variance"), F.round(F.stddev_pop("first"), 4).alias("deviation"), F.count("*").alias("n"))


@add("agg22_pivot_bias", f"SELECT algorithm, w_size, round(avg(average) FILTER (bias = 0), 4) AS b0, round(avg(average) FILTER (bias = 1), 4) AS b1, round(avg(average) FILTER (bias = 3), 4) AS b3 FROM {LATEST} GROUP BY 1, 2")
def _(s, d):
    p = P.pivoted(latest(s, d), ["algorithm", "w_size"], "bias", [0.0, 1.0, 3.0])
    return p.select("algorithm", "w_size", *[F.round(F.col(f"`{b}.0`"), 4).alias(f"b{b}") for b in (0, 1, 3)])


@add("agg23_margins", f"WITH c AS (SELECT algorithm, w_size, avg(average) AS m FROM {LATEST} GROUP BY 1, 2) SELECT algorithm, w_size, round(m, 4) AS mean FROM c UNION ALL SELECT algorithm, NULL, round(avg(m), 4) FROM c GROUP BY 1")
def _(s, d):
    return P.with_margin(latest(s, d), ["algorithm"], "w_size").withColumn("mean", F.round("mean", 4))


_RATES = f"SELECT algorithm, w_size, round(sum(matched_count) / sum(total), 6) AS success_rate, round(greatest(0, 1 - sum(matched_count) / sum(total)), 6) AS unmatched FROM {LATEST} GROUP BY 1, 2"


@add("agg24_success_rate", _RATES)
def _(s, d):
    return P.success_rate(latest(s, d), ["algorithm", "w_size"]).withColumn("success_rate", r6("success_rate")).withColumn("unmatched", r6("unmatched"))


@add("agg25_unmatched_by_type", f"SELECT group_type, round(greatest(0, 1 - sum(matched_count) / sum(total)), 6) AS unmatched FROM {LATEST} GROUP BY 1")
def _(s, d):
    return P.success_rate(latest(s, d), ["group_type"]).select("group_type", r6("unmatched").alias("unmatched"))


@add("agg26_mean_by_type", f"SELECT group_type, round(avg(average), 4) AS mean FROM {LATEST} GROUP BY 1")
def _(s, d):
    return P.mean_by(latest(s, d), ["group_type"]).withColumn("mean", F.round("mean", 4))


@add("agg27_best_of_family", f"WITH m AS (SELECT algorithm, substr(algorithm, 1, 1) AS family, w_size, round(avg(average), 4) AS v FROM {LATEST} GROUP BY 1, 2, 3) SELECT family, w_size, algorithm, v FROM m QUALIFY row_number() OVER (PARTITION BY family, w_size ORDER BY v, algorithm) = 1")
def _(s, d):
    m = latest(s, d).groupBy("algorithm", F.substring("algorithm", 1, 1).alias("family"), "w_size").agg(F.round(F.avg("average"), 4).alias("v"))
    return P.best_per(m, ["family", "w_size"], "algorithm", "v")


@add("agg28_first_against_rest", f"SELECT algorithm, round(avg(average) FILTER (w_size = 1), 4) AS first, round(avg(average) FILTER (w_size <> 1), 4) AS rest FROM {LATEST} GROUP BY 1")
def _(s, d):
    return P.first_against_rest(latest(s, d), ["algorithm"]).select("algorithm", F.round("first", 4).alias("first"), F.round("rest", 4).alias("rest"))


@add("agg29_tune_summary", f"""WITH v AS (SELECT group_type, algorithm || ' ' || w_size || ' ' || CAST(CAST(bias * 10 AS INTEGER) AS VARCHAR) AS params, round(average, 6) AS a FROM {LATEST})
    SELECT group_type, round(avg(a), 4) AS mean, round(var_samp(a), 4) AS variance, round(stddev_samp(a), 4) AS deviation, arg_min(params, (a, params)) AS best, arg_max(params, (a, params)) AS worst FROM v GROUP BY 1""")
def _(s, d):
    params = F.concat_ws(" ", "algorithm", "w_size", (F.col("bias") * 10).cast("int"))
    t = P.tune_summary(latest(s, d).select("group_type", params.alias("params"), r6("average").alias("a")), ["group_type"], "params", "a")
    return t.select("group_type", *[F.round(c, 4).alias(c) for c in ("mean", "variance", "deviation")], "best", "worst")


@add("agg30_first_known", f"SELECT algorithm, arg_min(total, run_num) FILTER (run_num >= 1) AS total, arg_min(matched_count, run_num) FILTER (run_num >= 2) AS matched FROM {FACTS} WHERE w_size = 1 AND group_type = 'similar' AND bias = 0 GROUP BY 1")
def _(s, d):
    rows = X(s, d).where("w_size = 1 and group_type = 'similar' and bias = 0")
    sparse = rows.select("algorithm", "run_num", F.when(F.col("run_num") >= 1, F.col("total")).alias("total"), F.when(F.col("run_num") >= 2, F.col("matched_count")).alias("matched"))
    return P.coalesced(sparse, "algorithm", ["total", "matched"], "run_num")


@add("agg31_sigma_summary", f"SELECT bias, round(avg(average), 4) AS mean, round(stddev_pop(average), 4) AS sigma, round(stddev_samp(average) / sqrt(count(average)), 4) AS error, round(avg(average) - 1.96 * stddev_samp(average) / sqrt(count(average)), 4) AS low, round(avg(average) + 1.96 * stddev_samp(average) / sqrt(count(average)), 4) AS high FROM {LATEST} GROUP BY 1")
def _(s, d):
    return P.sigma_summary(latest(s, d), ["bias"], "average").select("bias", *[F.round(c, 4).alias(c) for c in ("mean", "sigma", "error", "low", "high")])


@add("agg33_metric_at_bias", f"WITH k AS (SELECT *, dense_rank() OVER (PARTITION BY algorithm ORDER BY bias) AS i FROM {LATEST}) SELECT algorithm, round(avg(average) FILTER (bias = 1), 4) AS by_value, round(avg(average) FILTER (i = 2), 4) AS by_index FROM k GROUP BY 1")
def _(s, d):
    from pyspark.sql import Window

    k = latest(s, d).withColumn("i", F.dense_rank().over(Window.partitionBy("algorithm").orderBy("bias")))
    return k.groupBy("algorithm").agg(F.round(F.avg(F.when(F.col("bias") == 1, F.col("average"))), 4).alias("by_value"), F.round(F.avg(F.when(F.col("i") == 2, F.col("average"))), 4).alias("by_index"))


@add("agg36_rfc_by_bias", f"SELECT algorithm, bias, round(avg(average), 4) AS mean FROM {LATEST} GROUP BY 1, 2")
def _(s, d):
    return P.mean_by(latest(s, d), ["algorithm", "bias"]).withColumn("mean", F.round("mean", 4))


@add("agg37_matched_total", f"WITH f AS {LATEST}, a AS (SELECT * FROM f WHERE w_size = 10), b AS (SELECT * FROM f WHERE w_size = 5) SELECT coalesce(a.algorithm, b.algorithm) AS algorithm, coalesce(a.group_type, b.group_type) AS group_type, coalesce(a.bias, b.bias) AS bias, coalesce(a.matched_count, b.matched_count) AS matched, coalesce(a.total, b.total) AS total FROM a FULL JOIN b USING (algorithm, group_type, bias)")
def _(s, d):
    f = latest(s, d)
    keys = ["algorithm", "group_type", "bias"]
    a, b = (f.where(f"w_size = {w}").select(*keys, F.col("matched_count").alias(f"m{w}"), F.col("total").alias(f"t{w}")) for w in (10, 5))
    return a.join(b, keys, "full").select(*keys, F.coalesce("m10", "m5").alias("matched"), F.coalesce("t10", "t5").alias("total"))


_MEANS = f"(SELECT algorithm, w_size, bias, round(avg(average), 4) AS v FROM {LATEST} GROUP BY 1, 2, 3)"


@add("win5_best_second", f"SELECT algorithm, w_size, bias, place FROM (SELECT *, dense_rank() OVER (PARTITION BY w_size, bias ORDER BY v) AS place FROM {_MEANS}) WHERE place <= 2")
def _(s, d):
    m = latest(s, d).groupBy("algorithm", "w_size", "bias").agg(F.round(F.avg("average"), 4).alias("v"))
    return P.best_two(m, ["w_size", "bias"], "v").select("algorithm", "w_size", "bias", "place")


@add("win6_bold_cells", f"SELECT algorithm, w_size, bias, v = min(v) OVER (PARTITION BY w_size, bias) AS bold FROM {_MEANS}")
def _(s, d):
    from pyspark.sql import Window

    m = latest(s, d).groupBy("algorithm", "w_size", "bias").agg(F.round(F.avg("average"), 4).alias("v"))
    return m.select("algorithm", "w_size", "bias", (F.col("v") == F.min("v").over(Window.partitionBy("w_size", "bias"))).alias("bold"))


@add("win13_paper_order", "SELECT a AS algorithm, coalesce(nullif(list_position(['RF0', 'AF1', 'NO0'], a), 0), 1000) AS rank FROM (SELECT DISTINCT l_returnflag || l_linestatus || CAST(l_suppkey % 2 AS VARCHAR) AS a FROM lineitem)")
def _(s, d):
    return X(s, d).select("algorithm").distinct().select("algorithm", P.preferred_rank("algorithm", ["RF0", "AF1", "NO0"]).cast("bigint").alias("rank"))


@add("srt4_preferred_first", f"SELECT group_type, count(*) AS n FROM {LATEST} GROUP BY 1 ORDER BY CASE group_type WHEN 'variance' THEN 1 WHEN 'similar' THEN 2 ELSE 999 END, group_type")
def _(s, d):
    return latest(s, d).groupBy("group_type").agg(F.count("*").alias("n")).orderBy(P.preferred_rank("group_type", ["variance", "similar"], 999), "group_type")


QUERIES, ORACLE = book.queries, book.sql
