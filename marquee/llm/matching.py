"""Problem 4: matching entities of two sources that share no key.

Sorted neighbourhood: every record is entered under several variants of its title (as written, an alternative title, the
title without its last subtitle) and each entry is sorted by several composite keys (title and year, year and title, title
from its end, longest word); one range-partitioned sort serves all keys. Entries within a sliding window of each other are
compared: a weighted sum of title, year and hint similarities gives the confidence. Of the pairs above the least confidence
a one-to-one assignment of greatest total confidence is taken: pairs without rivals stand; the rest falls into connected
components, each solved exactly by shortest augmenting paths with prices, whatever its size; the task that holds a component
holds all its edges. (improved() is an approximation in bounded passes for callers whose components fit no task; nothing
here takes it on its own.)

Defined cases: rows with a null id or title on a side give no record of that side; repeated rows count once; a null or
partial date gives no year or its year; several titles of one id are all tried; equal confidences are settled by ids; empty
tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from array import array
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.session import ship, written

#: Positions of a sort order within which entries are compared.
WINDOW = 12
#: Passes over the regions of large components: at most so many, and no more after so many without gain.
PASSES, CALM = 24, 4
#: Weights of the fields and the least confidence of a match.
TITLE_WEIGHT, YEAR_WEIGHT, HINT_WEIGHT, LEAST_TITLE, LEAST = 0.75, 0.20, 0.05, 0.80, 0.74

#: Words for numbers of parts, articles and abbreviations.
NUMBERS = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "i": 1, "ii": 2, "iii": 3, "iv": 4, "v": 5, "vi": 6, "vii": 7, "viii": 8, "ix": 9, "x": 10}
ARTICLES = {"the", "a", "an"}
WORDS = {"dr": "doctor", "st": "saint", "mr": "mister", "mt": "mount", "vs": "versus", "&": "and"}
_YEAR = re.compile(r"\(\s*(\d{4})\s*\)\s*$")
_PAREN = re.compile(r"\(\s*(?:a\.?\s*k\.?\s*a\.?\s*)?([^()]*)\)", re.I)
_PART = re.compile(r"[\s,:-]+(?:(?:part|chapter|vol(?:ume)?)\.?\s*(\d{1,2}|[ivx]+|one|two|three|four|five|six|seven|eight|nine|ten)|(\d{1,2}|ii|iii|iv|vi|vii|viii|ix))\s*$", re.I)
_TRAILING_ARTICLE = re.compile(r"^(.*),\s*(the|a|an)\s*$", re.I)


def plain(text: str) -> str:
    """Without accents and in lower case; a typographic apostrophe is an apostrophe."""
    folded = unicodedata.normalize("NFKD", text.replace("’", "'"))
    return "".join(c for c in folded if not unicodedata.combining(c)).casefold()


def words_of(text: str) -> list[str]:
    """Words without articles, abbreviations written out, apostrophes closed up."""
    found = re.findall(r"[^\W_]+|&", plain(text).replace("'", ""))
    out = [WORDS.get(w, w) for w in found]
    return [w for w in out if w not in ARTICLES] or out


def variants(title: str) -> tuple[list[tuple[str, str, float]], int, int | None]:
    """((squeezed title, longest word, factor of its similarity), ...), part number (1: none said) and year of a title."""
    year = int(m[1]) if (m := _YEAR.search(title)) else None
    body = _YEAR.sub("", title)
    others = [m[1] for m in _PAREN.finditer(body) if m[1].strip()]
    main = _PAREN.sub(" ", body).strip()
    if m := _TRAILING_ARTICLE.match(main):
        main = f"{m[2]} {m[1]}"
    part = 1
    if m := _PART.search(main):
        said = (m[1] or m[2]).lower()
        part, main = int(said) if said.isdigit() else NUMBERS[said], main[: m.start()]
        if n := _TRAILING_ARTICLE.match(main):
            main = f"{n[2]} {n[1]}"
    named = [(main, 1.0)] + [(x, 0.99) for x in others]
    if len(pieces := re.split(r":\s+|\s+-\s+", main)) > 1:
        named.append((": ".join(pieces[:-1]), 0.93))
    out: dict[str, tuple[str, str, float]] = {}
    for text, factor in named:
        ws = words_of(text)
        if ws and "".join(ws) not in out:
            out["".join(ws)] = ("".join(ws), max(ws, key=lambda w: (len(w), w)), factor)
    return list(out.values()), part, year


_ENTRY = "side int, id bigint, title string, word string, factor double, part int, year int"


def _entries(records: DataFrame) -> DataFrame:
    """(side, id, title, year) records to their entries."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for side, key, title, year in batch.itertuples(index=False):
                found, part, own = variants(title)
                known = own if own is not None else (None if pd.isna(year) else int(year))
                rows += [(side, key, t, w, f, part, known) for t, w, f in found]
            frame = pd.DataFrame(rows, columns=["side", "id", "title", "word", "factor", "part", "year"])
            frame["year"] = frame["year"].astype("Int32")
            yield frame

    return records.mapInPandas(run, _ENTRY)


def neighbours(entries: DataFrame, window: int = WINDOW) -> DataFrame:
    """Pairs of entries of the two sides within a window of some sort order (l_ and r_ columns)."""
    year = F.coalesce(F.lpad(F.col("year").cast("string"), 4, "0"), F.lit("~"))
    keys = F.array(F.concat_ws("|", "title", year), F.concat_ws("|", year, "title"), F.concat_ws("|", F.reverse("title"), year), F.concat_ws("|", "word", year, "title"))
    keyed = entries.select("*", F.posexplode(keys).alias("order", "key"))
    laid = keyed.repartitionByRange("order", "key", "side", "id", "title").sortWithinPartitions("order", "key", "side", "id", "title")
    # A position in the partition; partitions are numbered through by their sizes (one row a partition).
    local = written(laid.withColumn("at", F.monotonically_increasing_id()).drop("key"), "neighbours")
    pid, low = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    sizes = local.groupBy(pid.alias("pid")).agg((F.max(low) + 1).alias("n")).orderBy("pid").collect()
    starts, total = [], 0
    for r in sizes:
        starts.append((r.pid, total))
        total += r.n
    spark = entries.sparkSession
    offsets = spark.createDataFrame(starts, "pid bigint, start bigint")
    placed = local.withColumn("pid", pid).join(F.broadcast(offsets), "pid").withColumn("pos", F.col("start") + low).drop("pid", "start", "at")
    block = F.floor(F.col("pos") / window)
    left = placed.where("side = 0").select(*[F.col(c).alias(f"l_{c}") for c in ("id", "title", "factor", "part", "year", "order", "pos")], block.alias("block"))
    right = placed.where("side = 1").select(*[F.col(c).alias(f"r_{c}") for c in ("id", "title", "factor", "part", "year", "order", "pos")], F.explode(F.array(block - 1, block, block + 1)).alias("block"))
    return left.join(right, "block").where(F.abs(F.col("l_pos") - F.col("r_pos")) <= window).where("l_order = r_order")


def compared(near: DataFrame, hints: DataFrame) -> DataFrame:
    """(l, r, confidence) of the pairs that may be the same: same part, years at most one apart, titles alike."""
    may = near.where("l_part = r_part and (l_year is null or r_year is null or abs(l_year - r_year) <= 1)")
    may = may.groupBy("l_id", "r_id", "l_title", "r_title", "l_year", "r_year").agg(F.max(F.least("l_factor", "r_factor")).alias("factor"))
    longest = F.greatest(F.length("l_title"), F.length("r_title"))
    title = (F.lit(1.0) - F.levenshtein("l_title", "r_title") / longest) * F.col("factor")
    year = F.when(F.col("l_year").isNull() | F.col("r_year").isNull(), 0.7).when(F.col("l_year") == F.col("r_year"), 1.0).otherwise(0.85)
    best = may.withColumn("title", title).where(F.col("title") >= LEAST_TITLE).groupBy("l_id", "r_id").agg(F.max(F.col("title") * TITLE_WEIGHT + year * YEAR_WEIGHT).alias("score"))
    with_hint = best.join(hints, ["l_id", "r_id"], "left")
    confidence = F.round(F.col("score") + F.coalesce(F.col("hint"), F.lit(0.0)) * HINT_WEIGHT, 6)
    return with_hint.select(F.col("l_id").alias("l"), F.col("r_id").alias("r"), confidence.alias("confidence")).where(F.col("confidence") >= LEAST)


#: Weights are compared as whole numbers of this many a unit; confidences have six digits.
UNITS = 10**9


def best_assignment(edges: list[tuple[int, int, float]]) -> list[int]:
    """Numbers of the edges of a one-to-one assignment of greatest total weight (weights positive); exact to nine digits."""
    lefts, rights, weights = zip(*edges) if edges else ((), (), ())
    return best_of(np.array(lefts, np.int64), np.array(rights, np.int64), np.array(weights, np.float64)).tolist()


def best_of(lefts: np.ndarray, rights: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """best_assignment of columns.

    Each left node in turn is brought in by the shortest augmenting path. Nodes have prices: those of the two ends of an
    edge add up to its weight at least, and just to it on a chosen one; a node without partner has price 0. So what a step
    costs is never negative, a path is searched no further than the cheapest way to end it (at a free right node, or at
    a left node that is better left out), and the prices prove the result the best. Memory grows with the edges.
    """
    left, l = np.unique(lefts, return_inverse=True)
    right, r = np.unique(rights, return_inverse=True)
    order = np.lexsort((r, l))
    begin = np.searchsorted(l[order], np.arange(len(left) + 1)).tolist()
    to, weight = array("q", r[order].astype(np.int64).tobytes()), array("q", np.rint(weights[order] * UNITS).astype(np.int64).tobytes())
    of_left, of_right = [-1] * len(left), [-1] * len(right)  # an edge, by its place in the order
    owner = array("q", l[order].astype(np.int64).tobytes())
    y, z = [0] * len(left), [0] * len(right)
    for root in range(len(left)):
        y[root] = max(0, max(weight[e] - z[to[e]] for e in range(begin[root], begin[root + 1])))
        cost, came, reached = {root: 0}, {}, {}  # came: by left, the edge that takes its partner; reached: cost by right
        heap, done = [(0, root)], set()
        best, last = y[root], (-1, root)  # stay out
        while heap and heap[0][0] < best:
            at, a = heappop(heap)
            if a in done:
                continue
            done.add(a)
            for e in range(begin[a], begin[a + 1]):
                b = to[e]
                d = at + y[a] + z[b] - weight[e]
                if d > best or d >= reached.get(b, d + 1):
                    continue
                held = of_right[b]
                if held < 0:
                    if d < best or last[0] < 0:
                        best, last = d, (e, a)
                elif held != e and d < best:
                    reached[b] = d
                    other = owner[held]
                    cost[other], came[other] = d, e
                    heappush(heap, (d, other))
                    if d + y[other] < best:
                        best, last = d + y[other], (-1, other)
        for a, d in cost.items():
            if d < best:
                y[a] -= best - d
        for b, d in reached.items():
            if d < best:
                z[b] += best - d
        e, a = last
        if e < 0:  # `a` gives up its partner
            if a == root:
                continue
            of_left[a], e = -1, came[a]
            a = owner[e]
        while True:
            left_behind = of_left[a]
            of_left[a], of_right[to[e]] = e, e
            if a == root:
                break
            e = came[a]
            assert to[left_behind] == to[e]
            a = owner[e]
    return np.sort(order[[e for e in of_left if e >= 0]])


def _least(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.min(value).alias(out))


def components(edges: DataFrame) -> DataFrame:
    """Edges with the least left id of their connected component (column component).

    Lefts that share a right are linked to the least of them; then every left is hung under the least one near it, large
    ones and small ones in turn, so paths shorten by more than a step each time and long chains take few rounds.
    """
    hub = edges.join(_least(edges, ["r"], "l", "hub"), "r").where("l > hub").select(F.col("l").alias("u"), F.col("hub").alias("v")).distinct()
    links, before = written(hub, "links"), None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _least(both, ["u"], "v", "m").select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = written(large, "links")
        low = _least(down, ["u"], "v", "m")
        small = down.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        links = written(small, "links")
        now = links.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if now == before:
            break
        before = now
    return edges.join(links.select(F.col("u").alias("l"), F.col("v").alias("top")), "l", "left").select("l", "r", "confidence", F.coalesce("top", "l").alias("component"))


def maximal(edges: DataFrame) -> DataFrame:
    """A one-to-one choice of (l, r, confidence) that no edge can be added to: in rounds, every edge that is the best of both
    its ends is taken. Equal confidences are settled by a hash, so that ties don't form long chains."""
    rank = F.struct("confidence", F.xxhash64("l", "r").alias("h"), "l", "r")
    rest = written(edges.select("l", "r", "confidence"), "rest")
    taken = None
    while True:
        best = rest.withColumn("rank", rank)
        for side in ("l", "r"):
            best = best.join(rest.groupBy(side).agg(F.max(rank).alias(f"best_{side}")), side)
        won = written(best.where("rank = best_l and rank = best_r").select("l", "r", "confidence"), "taken")
        taken = won if taken is None else taken.unionByName(won)
        rest = written(rest.join(won.select("l"), "l", "left_anti").join(won.select("r"), "r", "left_anti"), "rest")
        if not rest.limit(1).count():
            return written(taken, "maximal")


def _solve(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """The best assignment of the edges of one component or region."""
    table = table.sort_by([("l", "ascending"), ("r", "ascending")]).select(["l", "r", "confidence"])
    return table.take(pa.array(best_of(*(np.asarray(table[c].combine_chunks()) for c in ("l", "r", "confidence")))))


def regions(edges: DataFrame, chosen: DataFrame, number: int, task_edges: int) -> DataFrame:
    """Edges (l, r, confidence) with both ends in one region and part of pass `number`.

    A left draws a hash and takes the least one within some steps of it; a right goes with its chosen left, one without with
    the least of its lefts. So chosen edges never cross a border. A region of more edges than a task should take is cut into
    parts by a hash of its lefts, again with their rights.
    """
    label = edges.select("l").distinct().withColumn("region", F.xxhash64("l", F.lit(number)))
    for _ in range(1 + number % 3):
        near = _least(edges.join(label, "l"), ["r"], "region", "near")
        label = written(_least(edges.join(near, "r"), ["l"], "near", "region"), "regions")
    mate = chosen.select("r", F.col("l").alias("mate"))
    home = edges.join(label, "l").groupBy("r").agg(F.min("region").alias("near")).join(mate, "r", "left")
    home = home.join(label.select(F.col("l").alias("mate"), F.col("region").alias("with_mate")), "mate", "left")
    home = home.select("r", F.coalesce("with_mate", "near").alias("right_region"), F.coalesce("mate", F.xxhash64("r", F.lit(number))).alias("anchor"))
    inner = written(edges.join(label, "l").join(home, "r").where("region = right_region").select("l", "r", "confidence", "region", "anchor"), "regions")
    size = inner.groupBy("region").agg(F.ceil(F.sqrt(F.count("*") / task_edges)).cast("int").alias("parts"))
    part = lambda c: F.pmod(F.xxhash64(c, F.lit(number)), "parts")
    # Edges of a part are about 1 / parts ** 2 of the region's.
    return inner.join(size, "region").withColumn("part", part("l")).where(part("anchor") == F.col("part")).select("l", "r", "confidence", "region", "part")


def improved(edges: DataFrame, task_edges: int, passes: int = PASSES, calm: int = CALM) -> DataFrame:
    """A one-to-one choice of great total confidence among edges too many for a task: at most `passes` passes over regions."""
    now = maximal(edges)
    total, quiet = now.agg(F.sum("confidence")).first()[0] or 0.0, 0
    for number in range(passes):
        inner = regions(edges, now, number, task_edges)
        now = written(inner.groupBy("region", "part").applyInArrow(_solve, "l bigint, r bigint, confidence double"), "chosen")
        reached = now.agg(F.sum("confidence")).first()[0] or 0.0
        quiet = 0 if reached > total + 1e-9 else quiet + 1
        total = reached
        if quiet == calm:
            break
    return now


def assigned(edges: DataFrame, task_edges: int | None = None) -> DataFrame:
    """The one-to-one assignment of greatest total confidence among (l, r, confidence).

    Every component is solved exactly, whatever its size, by the task that holds it. Only a caller who names task_edges gets
    something less: components of more edges are then improved region by region.
    """
    edges = written(edges, "edges")
    degree_l, degree_r = edges.groupBy("l").agg(F.count("*").alias("dl")), edges.groupBy("r").agg(F.count("*").alias("dr"))
    counted = edges.join(degree_l, "l").join(degree_r, "r")
    alone = counted.where("dl = 1 and dr = 1").select("l", "r", "confidence")
    rivals = written(components(written(counted.where("dl > 1 or dr > 1").select("l", "r", "confidence"), "rivals")), "components")
    solved = lambda d: d.groupBy("component").applyInArrow(_solve, "l bigint, r bigint, confidence double")
    if task_edges is None:
        return alone.unionByName(solved(rivals))
    sized = rivals.join(rivals.groupBy("component").agg(F.count("*").alias("size")), "component")
    result = alone.unionByName(solved(sized.where(F.col("size") <= task_edges).select("component", "l", "r", "confidence")))
    large = sized.where(F.col("size") > task_edges).select("l", "r", "confidence")
    if large.limit(1).count():
        result = result.unionByName(improved(written(large, "large"), task_edges))
    return result


def match_entities(df: DataFrame, *, left_id: str, left_title: str, right_id: str, right_title: str, right_date: str, hint: str, window: int = WINDOW) -> DataFrame:
    """(left_id, right_id, confidence): which entity of one side is which of the other."""
    ship(df.sparkSession)
    rows = df.select(F.col(left_id).cast("bigint").alias("l"), F.col(left_title).alias("lt"), F.col(right_id).cast("bigint").alias("r"), F.col(right_title).alias("rt"), F.col(right_date).alias("d"), F.col(hint).alias("h"))
    year = F.regexp_extract(F.coalesce("d", F.lit("")), r"^\s*(\d{4})", 1)
    left = rows.where("l is not null and lt is not null").select(F.lit(0).alias("side"), F.col("l").alias("id"), F.col("lt").alias("title"), F.lit(None).cast("int").alias("year"))
    right = rows.where("r is not null and rt is not null").select(F.lit(1).alias("side"), F.col("r").alias("id"), F.col("rt").alias("title"), F.when(year != "", year.cast("int")).alias("year"))
    entries = _entries(left.unionByName(right).distinct())
    hints = rows.where("l is not null and r is not null").groupBy(F.col("l").alias("l_id"), F.col("r").alias("r_id")).agg(F.max(F.when(F.col("h").between(0, 1), F.col("h")).otherwise(0.0)).alias("hint"))
    return assigned(compared(neighbours(entries, window), hints)).select(F.col("l").alias(left_id), F.col("r").alias(right_id), "confidence")
