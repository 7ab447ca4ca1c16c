"""Problem 9: mixing sources to target weights.

Efraimidis-Spirakis sampling: every document draws the exponential key -ln(u) / weight from a hash of its id; in the order
of these keys a source's documents are a weighted sample without replacement. A source's budget of tokens is met by whole
epochs over all its documents, then by the documents whose prefix sum in key order stays within the rest.

Prefix sums need no sort of a source: sums by (source, slice of the key range) say in which slice a budget ends; documents
of earlier slices are in, of later ones out. That slice is cut again in the same way until it holds few enough documents
to be ordered in one task, so no task takes a source or a fixed share of it.

Defined cases: documents without tokens, with a null source or of a source without target take no part; a target without
documents gets nothing and its share is spread over the others in proportion; a weight that is null or not positive counts
as the least weight; repeated target rows count once (the largest share); equal keys are ordered by id; empty tables give
no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.llm.tokenize import TOKENIZERS, token_counts
from marquee.session import written

LEAST_WEIGHT = 1e-3
#: A key is placed by an integer of so many bits; every cut of a slice decides SLICE_BITS of them.
KEY_BITS, SLICE_BITS = 52, 12
#: Documents of the slice in which a source's budget ends that one task puts in order.
ORDERED = 200_000
#: Bound on the rows of the table of targets, which are collected and sent to all tasks.
MOST_TARGETS = 10_000


def text_quality(text: str) -> Column:
    """A weight from 0 to 1 that no script is favoured by: the product of the share of letters among the visible characters, of
    the number of distinct words over what a running text of that many words has at least (n ** 0.8, at most 1), and of the
    share of distinct lines. Symbol tables, repeated phrases and repeated lines weigh little."""
    visible = F.length(F.regexp_replace(text, r"[\s\p{Z}]+", ""))
    letters = F.length(F.regexp_replace(text, r"[^\p{L}\p{M}]+", ""))
    words = F.split(F.lower(F.trim(text)), r"[\s\p{Z}]+")
    lines = F.filter(F.transform(F.split(text, r"\R"), lambda x: F.trim(x)), lambda x: x != "")
    richness = F.least(F.lit(1.0), F.size(F.array_distinct(words)) / F.pow(F.size(words).cast("double"), F.lit(0.8)))
    return F.coalesce(F.try_divide(letters.cast("double"), visible) * richness * F.try_divide(F.size(F.array_distinct(lines)).cast("double"), F.size(lines)), F.lit(0.0))


def plan_budgets(sizes: dict[str, int], targets: list[tuple[str, float, int]], total: int | None = None) -> dict[str, tuple[float, int]]:
    """By source: its share among the sources that have documents, and its budget in tokens.

    Without a total the mix is as large as the caps allow with every share kept. With one, a source that its cap holds
    below its share gets what the cap allows.
    """
    live = [(s, share, cap) for s, share, cap in targets if sizes.get(s, 0) > 0 and share > 0 and cap > 0]
    whole = sum(share for _, share, _ in live)
    if not live:
        return {}
    size = total if total is not None else min(cap * sizes[s] * whole / share for s, share, cap in live)
    return {s: (share / whole, min(math.floor(size * share / whole + 1e-6), cap * sizes[s])) for s, share, cap in live}


def last_slices(counted: DataFrame, rests: dict[str, int], ordered: int) -> dict[str, tuple[int, int, int]]:
    """By source: the interval [low, high) of places q in which the prefix sum of n passes the rest, and the sum before it.

    Intervals are cut until they hold at most `ordered` rows, or one place. At most one row a source and slice is summed up,
    and one a source reaches the driver.
    """
    found = {s: (0, 1 << KEY_BITS, 0) for s in rests}
    open_, bits = dict(rests), KEY_BITS
    while open_ and bits:
        step = min(SLICE_BITS, bits)
        bits -= step
        asked = counted.sparkSession.createDataFrame([(s, found[s][0], found[s][1], found[s][2], rest) for s, rest in open_.items()], "s string, low bigint, high bigint, before bigint, rest bigint")
        rows = counted.join(F.broadcast(asked), "s").where("q >= low and q < high")
        by_slice = rows.groupBy("s", "low", "before", "rest", F.expr(f"shiftright(q - low, {bits})").alias("slice")).agg(F.sum("n").alias("n"), F.count("*").alias("size"))
        upto = by_slice.withColumn("upto", F.col("before") + F.sum("n").over(Window.partitionBy("s").orderBy("slice")))
        last = upto.where("upto > rest").groupBy("s").agg(F.min(F.struct("slice", "low", F.expr("upto - n").alias("before"), "size")).alias("x"))
        for r in last.select("s", "x.*").collect():
            low = r.low + (r.slice << bits)
            found[r.s] = (low, low + (1 << bits), r.before)
            if r.size <= ordered:
                open_.pop(r.s)
    return found


def mix(df: DataFrame, targets: DataFrame, *, record: str = "doc_id", text: str = "text", source: str = "source", weight: Column | None = None, total: int | None = None, seed: int = 17, ordered: int = ORDERED, vocabulary: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> tuple[DataFrame, DataFrame]:
    """The mix (record, source, n_tokens, repeats) and its report, one row per target."""
    spark = df.sparkSession
    wanted = [(r[0], float(r[1] or 0), int(r[2] or 0)) for r in targets.where("source is not null").groupBy("source").agg(F.max("target_share"), F.max("max_repeats")).orderBy("source").limit(MOST_TARGETS + 1).collect()]
    if len(wanted) > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} targets")
    w = F.coalesce(weight if weight is not None else text_quality(text), F.lit(LEAST_WEIGHT)).cast("double")
    draw = (F.xxhash64(F.col(record), F.lit(seed)).bitwiseAND(F.lit((1 << 52) - 1)) + F.lit(0.5)) / F.lit(float(1 << 52))
    chosen = df.where(F.col(source).isin([s for s, _, _ in wanted])).select(F.col(record).alias("r"), F.col(source).alias("s"), F.col(text).alias("t"), (-F.log(draw) / F.greatest(w, F.lit(LEAST_WEIGHT))).alias("k"))
    counted = token_counts(chosen, "t", keep=["r", "s", "k"], count="n", vocabulary=vocabulary, folder=folder).where("n > 0")
    place = F.least(F.floor(F.lit(float(1 << KEY_BITS)) * F.col("k") / (F.lit(1.0) + F.col("k"))), F.lit((1 << KEY_BITS) - 1)).cast("bigint")
    counted = written(counted.withColumn("q", place), "mix")

    sizes = {r.s: r.n for r in counted.groupBy("s").agg(F.sum("n").alias("n")).collect()}
    budgets = plan_budgets(sizes, wanted, total)
    plan = [(s, share, budget, budget // sizes[s], budget % sizes[s]) for s, (share, budget) in budgets.items()]
    plans = spark.createDataFrame(plan, "s string, share double, budget bigint, epochs bigint, rest bigint")
    ends = spark.createDataFrame([(s, *x) for s, x in last_slices(counted, {s: rest for s, *_, rest in plan}, ordered).items()], "s string, low bigint, high bigint, before bigint")
    placed = counted.join(F.broadcast(plans.join(ends, "s")), "s")
    inner = Window.partitionBy("s").orderBy("k", "r").rowsBetween(Window.unboundedPreceding, 0)
    within = (F.col("q") >= F.col("low")) & (F.col("q") < F.col("high"))
    edge = placed.where(within).withColumn("extra", (F.col("before") + F.sum("n").over(inner) <= F.col("rest")).cast("bigint"))
    away = placed.where(~within).withColumn("extra", (F.col("q") < F.col("low")).cast("bigint"))
    picked = edge.unionByName(away).withColumn("repeats", F.col("epochs") + F.col("extra")).where("repeats > 0")
    result = picked.select(F.col("r").alias(record), F.col("s").alias("source"), F.col("n").alias("n_tokens"), "repeats")

    asked = spark.createDataFrame(wanted, "source string, target_share double, max_repeats bigint")
    got = result.groupBy("source").agg(F.sum(F.expr("n_tokens * repeats")).alias("mixed_tokens"), F.max("repeats").alias("most_repeats"), F.count("*").alias("n_documents"))
    report = asked.join(got, "source", "left").join(plans.select(F.col("s").alias("source"), "share", "budget"), "source", "left").na.fill(0, ["mixed_tokens", "most_repeats", "n_documents", "share", "budget"])
    everything = Window.partitionBy()  # one row per target
    actual = F.coalesce(F.try_divide(F.col("mixed_tokens").cast("double"), F.sum("mixed_tokens").over(everything)), F.lit(0.0))
    return result, report.withColumn("actual_share", actual)
