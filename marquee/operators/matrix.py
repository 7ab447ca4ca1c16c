"""Matrix operators on long (row, column, value) tables: Gram products, co-occurrence, cosine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marquee.session import written


#: Cells of a row beyond which its pairs are dealt over tasks.
CHUNK = 2048


def cell_pairs(df: DataFrame, row: str, col: str, value: str, chunk: int = CHUNK) -> DataFrame:
    """(i, x, j, y): every two cells of a row with i <= j, each once.

    Cells of one row meet in a self-join on that row. A row of more than `chunk` cells is cut into chunks by a hash of its
    columns, and every two chunks meet in a join key of their own, so no key squares a hot row.
    """
    cells = written(df.select(F.col(row).alias("k"), F.col(col).alias("i"), F.col(value).alias("x")), "cells")
    other = lambda d: d.withColumnsRenamed({"i": "j", "x": "y"})
    sizes = cells.groupBy("k").agg(F.ceil(F.count("*") / chunk).cast("int").alias("n")).where("n > 1")
    if not sizes.limit(1).count():
        return cells.join(other(cells), "k").where("i <= j").select("i", "x", "j", "y")
    sizes = written(sizes, "sizes")
    ordinary = cells.join(sizes, "k", "left_anti")
    chunked = cells.join(sizes, "k").withColumn("c", F.pmod(F.xxhash64("i"), "n").cast("int"))
    met = chunked.select("k", "i", "x", "c", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("o")).select("k", "i", "x", "c", F.least("c", "o").alias("p"), F.greatest("c", "o").alias("q"))
    # Left is the chunk p, right the chunk q; the two cells are then put in order.
    hot = met.where("c = p").drop("c").join(other(met.where("c = q").drop("c")), ["k", "p", "q"]).where("p < q or i <= j")
    turned = F.col("i") > F.col("j")
    swap = lambda a, b, name: F.when(turned, F.col(b)).otherwise(F.col(a)).alias(name)
    hot = hot.select(swap("i", "j", "i"), swap("x", "y", "x"), swap("j", "i", "j"), swap("y", "x", "y"))
    return ordinary.join(other(ordinary), "k").where("i <= j").select("i", "x", "j", "y").unionByName(hot)


def gram(df: DataFrame, row: str, col: str, value: str) -> DataFrame:
    """JOI6, JOI7: upper triangle (i <= j) of the product of the matrix with itself over rows: (i, j, g, n).

    Products are summed on the map side first.
    """
    return cell_pairs(df, row, col, value).groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("g"), F.count("*").alias("n"))


def corated_cosine(df: DataFrame, row: str, col: str, value: str, least: int = 1, chunk: int = CHUNK) -> DataFrame:
    """REC5: cosine over co-rated entries only: (i, j, sim, n) with i < j and n >= least common rows.

    Two columns with `least` common rows have one outside any least - 1 rows. So the largest rows, at most least - 1 of those
    beyond `chunk` cells, make no pairs; their products are added to the pairs that the other rows make.
    """
    cells = written(df.select(F.col(row).alias("k"), F.col(col).alias("i"), F.col(value).alias("x")), "cells")
    sizes = cells.groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") > chunk)
    largest = [r.k for r in sizes.orderBy(F.desc("n"), "k").limit(least - 1).collect()] if least > 1 else []
    rest = cells.where(~F.col("k").isin(largest)) if largest else cells
    s = cell_pairs(rest, "k", "i", "x", chunk).where("i < j").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("xy"), F.sum(F.col("x") * F.col("x")).alias("xx"), F.sum(F.col("y") * F.col("y")).alias("yy"), F.count("*").alias("n"))
    if largest:
        held = cells.where(F.col("k").isin(largest)).groupBy("i").agg(*[F.max(F.when(F.col("k") == k, F.col("x"))).alias(f"v{n}") for n, k in enumerate(largest)])
        v = F.array(*[F.col(f"v{n}") for n in range(len(largest))])
        s = s.join(held.select("i", v.alias("a")), "i", "left").join(held.select(F.col("i").alias("j"), v.alias("b")), "j", "left")
        both = F.filter(F.arrays_zip(F.coalesce("a", F.array().cast("array<double>")), F.coalesce("b", F.array().cast("array<double>"))), lambda z: z["0"].isNotNull() & z["1"].isNotNull())
        more = lambda f: F.aggregate(both, F.lit(0.0), lambda t, z: t + f(z))
        s = s.select("i", "j", (F.col("xy") + more(lambda z: z["0"] * z["1"])).alias("xy"), (F.col("xx") + more(lambda z: z["0"] * z["0"])).alias("xx"), (F.col("yy") + more(lambda z: z["1"] * z["1"])).alias("yy"), (F.col("n") + F.size(both)).alias("n"))
    return s.where(F.col("n") >= least).select("i", "j", (F.col("xy") / F.sqrt(F.col("xx") * F.col("yy"))).alias("sim"), "n")


def top_k(df: DataFrame, keys: list[str], score: str, tie: str, k: int, place: str = "place") -> DataFrame:
    """WIN1, WIN3, WIN4: the k best rows per key by score descending, tie ascending; Catalyst limits groups before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(F.desc(score), F.asc(tie))
    return df.withColumn(place, F.row_number().over(w).cast("bigint")).where(F.col(place) <= k)


def _block_cosines(df: DataFrame, key: str, vector: str, block: int | None, keep: Callable, each: int = 1024) -> DataFrame:
    """What `keep` selects of the cosines of every two blocks of vectors: keep(left ids, right ids, cosines, same block).

    Blocks hold about `each` vectors, so tasks are of one size and their number grows with the vectors. Every block meets
    every other once, and no side is broadcast whole.
    """
    import numpy as np
    import pandas as pd

    vectors = df.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v")).where("id is not null and v is not null")
    block = block or max(1, -(-vectors.count() // each))
    n = F.pmod(F.xxhash64("id"), F.lit(block)).cast("int")
    others = F.explode(F.sequence(F.lit(0), F.lit(block - 1))).alias("o")
    spread = vectors.withColumn("b", n).select("id", "v", "b", others).select("id", "v", "b", F.least("b", "o").alias("p"), F.greatest("b", "o").alias("q"))

    def cross(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        left, right = frame[frame.b == key[0]], frame[frame.b == key[1]]
        if not len(left) or not len(right):
            return pd.DataFrame({"a": [], "b": [], "sim": []})
        x, y = np.stack(left.v.to_numpy()), np.stack(right.v.to_numpy())
        s = (x @ y.T) / (np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1)[None, :] + 1e-8)
        a, b, sim = keep(left.id.to_numpy(), right.id.to_numpy(), s, key[0] == key[1])
        return pd.DataFrame({"a": a, "b": b, "sim": sim})

    return spread.groupBy("p", "q").applyInPandas(cross, "a bigint, b bigint, sim double")


def cosine_pairs(df: DataFrame, key: str, vector: str, block: int | None = None, low: float | None = None, high: float | None = None) -> DataFrame:
    """JOI9, AGG34: cosine (a, b, sim) of all pairs a < b of vectors; only those >= low, or <= high, at six digits, if asked.

    Thresholds are applied where the cosines are computed, so pairs beyond them are never shuffled.
    """
    import numpy as np

    def keep(left, right, s, same):
        hit = left[:, None] < right[None, :] if same else np.ones(s.shape, bool)
        if low is not None:
            hit &= np.round(s, 6) >= low
        if high is not None:
            hit &= np.round(s, 6) <= high
        i, j = np.nonzero(hit)
        return np.minimum(left[i], right[j]), np.maximum(left[i], right[j]), s[i, j]

    return _block_cosines(df, key, vector, block, keep)


def cosine_neighbours(df: DataFrame, key: str, vector: str, k: int, block: int | None = None, digits: int = 6) -> DataFrame:
    """JOI10: (id, other, sim, place): each vector's k nearest by rounded cosine, ties by id; a block gives at most k a vector."""
    import numpy as np

    def nearest(ids, others, s, same):
        if same:
            s = np.where(ids[:, None] == others[None, :], -np.inf, s)
        order = np.lexsort((np.broadcast_to(others, s.shape), -s), axis=1)[:, :k]
        best = np.take_along_axis(s, order, axis=1)
        hit = np.isfinite(best)
        return np.repeat(ids, hit.sum(axis=1)), others[order][hit], best[hit]

    def keep(left, right, s, same):
        s = np.round(s, digits)
        first = nearest(left, right, s, same)
        if same:
            return first
        return tuple(np.concatenate(x) for x in zip(first, nearest(right, left, s.T, False)))

    near = _block_cosines(df, key, vector, block, keep).select(F.col("a").alias("id"), F.col("b").alias("other"), "sim")
    return top_k(near, ["id"], "sim", "other", k)


def common_items(groups: DataFrame, rated: DataFrame) -> DataFrame:
    """JOI8, GTH1, SET4: (group_id, item_id) rated by all members of a group."""
    member = groups.select("group_id", F.size("members").alias("size"), F.explode("members").alias("user_id"))
    hits = member.join(rated.select("user_id", "item_id"), "user_id").groupBy("group_id", "item_id", "size").agg(F.count("*").alias("n"))
    return hits.where("n = size").select("group_id", "item_id")
