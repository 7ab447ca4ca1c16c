"""Problem 1: items that appear together, as an incremental pair table.

A change is given as the contents of the changed baskets before and after it. Every changed basket emits signed deltas, -1
for the pairs it had and +1 for those it has, and likewise for the items' own counts and the number of baskets; deltas are
added up per task, packed into hash buckets and merged into the persistent counts of those buckets; buckets without deltas
are neither read nor written. A first load is the change from nothing. Scores are recomputed from the counts, for all pairs
or for those the last change touched.

A basket of more than `large` items does not emit its pairs inside one task. The few largest (fewer than the least support
of a reported pair, so that no such pair can live in them alone) are kept as rows and their share of a pair's count is
added when it is scored; the pairs of any further large basket are emitted chunk by chunk, spread over tasks.

Defined cases: null baskets and items are left out; repeated rows of a basket count once; an item makes no pair with
itself; extra columns are ignored; empty tables give no pairs.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.llm.similar_sets import mix64
from marquee.operators.skew import clustered, partitions_for
from marquee.session import scratch, ship, written

#: Kinds of the state's rows: pair counts (a, b, n); item counts (item, null, n); number of baskets (0, null, n); rows of
#: kept large baskets (basket, item, 1); rows of large baskets whose pairs are counted (basket, item, 1).
PAIR, ITEM, BASKETS, KEPT, COUNTED = 0, 1, 2, 3, 4
_ROWS = "kind int, bucket int, a bigint, b bigint, n bigint"
#: State and deltas alike: the sorted rows of a kind and bucket, packed, so that only what is asked for becomes Spark rows.
_STATE = "kind int, bucket int, payload binary"


def _narrow(column: np.ndarray) -> tuple[int, bytes]:
    """A column in the narrowest of three widths, bytes of equal weight together."""
    low, high = (int(column.min()), int(column.max())) if len(column) else (0, 0)
    kind = next(k for k in (np.int8, np.int32, np.int64) if np.iinfo(k).min <= low and high <= np.iinfo(k).max)
    width = np.dtype(kind).itemsize
    raw = column.astype(kind)
    return width, raw.tobytes() if width == 1 else raw.view(np.uint8).reshape(-1, width).T.tobytes()


def _wide(raw: np.ndarray, width: int) -> np.ndarray:
    kind = {1: np.int8, 4: np.int32, 8: np.int64}[width]
    flat = raw if width == 1 else np.ascontiguousarray(raw.reshape(width, -1).T).reshape(-1)
    return flat.view(kind).astype(np.int64)


def pack(a: np.ndarray, b: np.ndarray | None, n: np.ndarray) -> bytes:
    """Rows sorted by (a, b), compressed: runs of a, differences of b, counts."""
    heads = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])[: len(a)])
    columns = [np.diff(a[heads], prepend=np.int64(0)), np.diff(np.append(heads, len(a))), n]
    columns += [np.diff(b, prepend=np.int64(0))] if b is not None else []
    parts = [_narrow(c.astype(np.int64)) for c in columns]
    head = np.array([len(parts), *(x for c, (w, _) in zip(columns, parts) for x in (len(c), w))], np.int64).tobytes()
    return head + pa.compress(b"".join(raw for _, raw in parts), "zstd", asbytes=True)


def unpack(payload: bytes) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
    count = int(np.frombuffer(payload[:8], np.int64)[0])
    shape = np.frombuffer(payload[8 : 8 + 16 * count], np.int64).reshape(count, 2)
    raw, at, columns = np.frombuffer(pa.decompress(payload[8 + 16 * count :], int(shape.prod(axis=1).sum()), "zstd", asbytes=True), np.uint8), 0, []
    for length, width in shape.tolist():
        columns.append(_wide(raw[at : at + length * width], width))
        at += length * width
    return np.repeat(np.cumsum(columns[0]), columns[1]), np.cumsum(columns[3]) if count == 4 else None, columns[2]


def added(a: np.ndarray, b: np.ndarray | None, n: np.ndarray) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
    """Counts of equal keys added up, in key order; keys that come to nothing fall out."""
    narrow = b is not None and len(a) and min(a.min(), b.min()) >= 0 and max(a.max(), b.max()) < 1 << 31
    if b is None:
        order = np.argsort(a, kind="stable")
    elif narrow:
        order = np.argsort((a << 32) | b, kind="stable")  # presorted runs are merged
    else:
        order = np.lexsort((b, a))
    a, n, b = a[order], n[order], b[order] if b is not None else None
    fresh = np.concatenate([[True], a[1:] != a[:-1] if b is None else (a[1:] != a[:-1]) | (b[1:] != b[:-1])])[: len(a)]
    starts = np.flatnonzero(fresh)
    sums = np.add.reduceat(n, starts) if len(starts) else n
    kept = np.flatnonzero(sums)
    starts = starts[kept]
    return a[starts], b[starts] if b is not None else None, sums[kept]


def bucket_of(a: np.ndarray, b: np.ndarray | None, buckets: int) -> np.ndarray:
    """An item's pairs go to at most eight buckets, so that sorted payloads stay short and no bucket takes a whole hot item."""
    with np.errstate(over="ignore"):
        key = a.astype(np.int64) * np.int64(8) + (b & 7 if b is not None else 0)
    return (mix64(key) % np.uint64(buckets)).astype(np.int32)


def _pairs_of(k: np.ndarray, x: np.ndarray, most: int = 3_000_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(a, b, n) with a < b of the baskets in sorted, distinct (k, x) rows, added up over groups of baskets of one size."""
    starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    sizes = np.diff(np.append(starts, len(k)))
    items, local = np.unique(x, return_inverse=True)
    codes, held = [], 0

    def total():
        code, n = np.unique(np.concatenate(codes), return_counts=True)
        return items[code // len(items)], items[code % len(items)], n.astype(np.int64)

    for size in np.unique(sizes):
        if size < 2:
            continue
        i, j = np.triu_indices(size, 1)
        rows = starts[sizes == size]
        step = max(1, most // len(i))
        for at in range(0, len(rows), step):
            m = local[rows[at : at + step, None] + np.arange(size)]
            codes.append((m[:, i] * len(items) + m[:, j]).reshape(-1))
            held += len(codes[-1])
            if held >= most:
                yield total()
                codes, held = [], 0
    if held:
        yield total()


def _bucketed(kind: int, a, b, n, buckets: int) -> pa.RecordBatch:
    at = bucket_of(a, b, buckets)
    order = np.argsort(at.astype(np.uint16) if buckets <= 1 << 16 else at, kind="stable")  # 16 bits: a radix sort
    a, b, n, at = a[order], b[order] if b is not None else None, n[order], at[order]
    heads = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    ends = np.append(heads[1:], len(at))
    payloads = [pack(a[s:e], b[s:e] if b is not None else None, n[s:e]) for s, e in zip(heads, ends)]
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(heads), kind, np.int32)), pa.array(at[heads]), pa.array(payloads, pa.binary())], ["kind", "bucket", "payload"])


def _deltas(sign: int, buckets: int, large: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        baskets, marginals = 0, []

        def flush(k, p, x):
            nonlocal baskets
            fresh = np.concatenate([[True], (k[1:] != k[:-1]) | (x[1:] != x[:-1])])
            k, p, x = k[fresh], p[fresh], x[fresh]
            starts = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (p[1:] != p[:-1])]))
            sizes = np.diff(np.append(starts, len(k)))
            # Parts of hot baskets and large ones are set aside; part 1 stands for the basket.
            baskets += int((p[starts] <= 1).sum())
            aside = np.repeat((p[starts] > 0) | (sizes > large), sizes)
            items, n = np.unique(x, return_counts=True)
            marginals.append((items, n))
            if len(marginals) >= 16:
                yield from margins()
            if aside.any():
                yield _bucketed(KEPT, k[aside], x[aside], np.full(int(aside.sum()), sign, np.int64), buckets)
            k, x = k[~aside], x[~aside]
            if len(k):
                for a, b, n in _pairs_of(k, x):
                    yield _bucketed(PAIR, a, b, sign * n, buckets)

        def margins():
            nonlocal marginals
            items, _, n = added(np.concatenate([m[0] for m in marginals]), None, np.concatenate([m[1] for m in marginals]))
            marginals = []
            yield _bucketed(ITEM, items, None, sign * n, buckets)

        held: list[tuple[np.ndarray, ...]] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(tuple(np.asarray(c) for c in batch.columns))
            rows += batch.num_rows
            if rows >= 300_000:
                k, p, x = (np.concatenate(c) for c in zip(*held))
                change = np.flatnonzero((k != k[-1]) | (p != p[-1]))
                end = int(change[-1]) + 1 if len(change) else 0
                if end:
                    yield from flush(k[:end], p[:end], x[:end])
                held, rows = [(k[end:], p[end:], x[end:])], len(k) - end if end else 0
        if held:
            k, p, x = (np.concatenate(c) for c in zip(*held))
            if len(k):
                yield from flush(k, p, x)
        if marginals:
            yield from margins()
        if baskets:
            yield _bucketed(BASKETS, np.zeros(1, np.int64), None, np.array([sign * baskets], np.int64), buckets)

    return run


def _chunk_deltas(buckets: int):
    """Rows (k, i, j, c, x) of one large basket's chunk pair, sorted, to pair deltas."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        i, j = key[1].as_py(), key[2].as_py()
        c, x, n = (np.asarray(table[name].combine_chunks()) for name in ("c", "x", "n"))
        sign = int(n[0])
        u, v = np.sort(x[c == i]), np.sort(x[c == j])
        batches = []
        for at in range(0, len(u), 512):
            a, b = np.repeat(u[at : at + 512], len(v)), np.tile(v, len(u[at : at + 512]))
            keep = a < b if i == j else np.ones(len(a), bool)
            a, b = np.minimum(a, b)[keep], np.maximum(a, b)[keep]
            if len(a):
                batches.append(_bucketed(PAIR, *added(a, b, np.full(len(a), sign, np.int64)), buckets))
        schema = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("payload", pa.binary())])
        return pa.Table.from_batches(batches, schema)

    return run


def _merge(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """All deltas of one bucket of one kind, and its old counts, to its new counts."""
    parts = [unpack(p) for p in table["payload"].to_pylist()]
    two = parts[0][1] is not None
    a, b, n = added(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]) if two else None, np.concatenate([p[2] for p in parts]))
    same = lambda v: pa.array([v.as_py()] if len(a) else [], pa.int32())
    return pa.table({"kind": same(key[0]), "bucket": same(key[1]), "payload": pa.array([pack(a, b, n)] if len(a) else [], pa.binary())})


def _unpacked(least: int | None):
    """Payloads to rows; least: only rows counted so often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for kind, bucket, payload in zip(*(c.to_pylist() for c in batch.columns)):
                a, b, n = unpack(payload)
                if least is not None:
                    keep = n >= least
                    a, b, n = a[keep], b[keep] if b is not None else None, n[keep]
                same = lambda v: pa.array(np.full(len(a), v, np.int32))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([same(kind), same(bucket), pa.array(a), pa.array(b) if b is not None else pa.nulls(len(a), pa.int64()), pa.array(n)], ["kind", "bucket", "a", "b", "n"])

    return run


def _moved(buckets: int):
    """Rows (a, b, n) of large baskets from kind KEPT to COUNTED."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b, n = added(*(np.asarray(c) for c in batch.columns))
                yield _bucketed(KEPT, a, b, -n, buckets)
                yield _bucketed(COUNTED, a, b, n, buckets)

    return run


@dataclass(frozen=True)
class Layout:
    """What stays the same over the versions of a table."""

    buckets: int
    large: int
    most_kept: int


class PairTable:
    """Persistent counts of one kind of baskets in the shared folder; every change writes a new version."""

    def __init__(self, spark: SparkSession, path: str, layout: Layout, version: str | None = None):
        self.spark, self.path, self.layout, self.version = spark, path, layout, version
        ship(spark)

    @classmethod
    def create(cls, spark: SparkSession, path: str | None = None, *, buckets: int = 64, large: int = 4000, most_kept: int = 14) -> PairTable:
        """An empty table. most_kept: large baskets kept as rows; the least support asked of scores must exceed it."""
        path = path or scratch(spark, "pairs")
        table = cls(spark, path, Layout(buckets, large, most_kept))
        spark.createDataFrame([(json.dumps(asdict(table.layout)),)], "layout string").coalesce(1).write.mode("overwrite").json(f"{path}/layout")
        return table

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: str) -> PairTable:
        layout = json.loads(spark.read.json(f"{path}/layout").first().layout)
        return cls(spark, path, Layout(**layout), version)

    def _manifest(self) -> DataFrame | None:
        """(kind, bucket, latest): the version that holds a bucket, for those written after the first one."""
        if self.version in (None, "v0"):
            return None
        return self.spark.read.schema("kind int, bucket int, latest int").parquet(f"{self.path}/manifest/{self.version}")

    def state(self) -> DataFrame:
        """The payloads in force: of every bucket the one of the version that wrote it last."""
        if self.version is None:
            return self.spark.createDataFrame([], _STATE)
        columns, number = ["kind", "bucket", "payload"], int(self.version[1:])
        layers = self.spark.read.schema("bucket int, payload binary, version int, kind int").option("basePath", f"{self.path}/state").parquet(*[f"{self.path}/state/version={i}" for i in range(number + 1)])
        manifest = self._manifest()
        if manifest is None:
            return layers.select(columns)
        # One row a bucket and kind, whose number is fixed by the layout.
        return layers.join(F.broadcast(manifest), ["kind", "bucket"], "left").where("version = coalesce(latest, 0)").select(columns)

    def rows(self, *kinds: int, least: int | None = None) -> DataFrame:
        """(kind, bucket, a, b, n) rows of the state."""
        return self.state().where(F.col("kind").isin(*kinds)).mapInArrow(_unpacked(least), _ROWS)

    def _write(self, deltas: DataFrame) -> None:
        """Merge deltas into the buckets they touch."""
        number = int(self.version[1:]) + 1 if self.version else 0
        if number:
            deltas = written(deltas, "deltas")
            touched = deltas.select("kind", "bucket").distinct()
            manifest = touched.select("kind", "bucket", F.lit(number).alias("latest"))
            if (before := self._manifest()) is not None:
                manifest = manifest.unionByName(before.join(touched, ["kind", "bucket"], "left_anti"))
            manifest.write.mode("overwrite").parquet(f"{self.path}/manifest/v{number}")
            deltas = deltas.unionByName(self.state().join(F.broadcast(touched), ["kind", "bucket"], "left_semi"))
        tasks = partitions_for(deltas, self.layout.buckets, 8)
        merged = deltas.repartition(tasks, "kind", "bucket").groupBy("kind", "bucket").applyInArrow(_merge, _STATE)
        merged.write.mode("overwrite").partitionBy("kind").option("compression", "uncompressed").parquet(f"{self.path}/state/version={number}")
        self.version = f"v{number}"

    def _side(self, rows: DataFrame, basket: str, item: str, sign: int) -> DataFrame:
        source = rows.select(F.col(basket).cast("bigint").alias("basket"), F.col(item).cast("bigint").alias("item"))
        laid = clustered(source, "basket", "item", self.layout.large)
        return laid.mapInArrow(_deltas(sign, self.layout.buckets, self.layout.large), _STATE)

    def update(self, after: DataFrame, before: DataFrame | None = None, *, basket: str, item: str) -> PairTable:
        """Apply a change: whole contents of the changed baskets after and before it."""
        deltas = self._side(after, basket, item, 1)
        if before is not None:
            deltas = deltas.unionByName(self._side(before, basket, item, -1))
        self._write(deltas)
        self._settle()
        return self

    def _settle(self, most_kept: int | None = None) -> None:
        """Keep the largest baskets set aside as rows, as many as may be; count the pairs of the others, chunk by chunk.

        Parts of hot baskets that turn out to be small are counted as well.
        """
        most = self.layout.most_kept if most_kept is None else most_kept
        rows = self.rows(KEPT, COUNTED)
        sizes = rows.groupBy("a", "kind").agg(F.count("*").alias("size"))
        largest = [r.a for r in sizes.where(f"kind = {KEPT} and size > {self.layout.large}").orderBy(F.desc("size"), "a").limit(most).collect()]
        moving = rows.where((F.col("kind") == KEPT) & ~F.col("a").isin(largest))
        if moving.limit(1).count():
            # What the table counted of these baskets so far is taken back, what they hold now is counted.
            touched = moving.select("a").distinct()
            mine = rows.where(~F.col("a").isin(largest)).join(touched, "a", "left_semi")
            old = mine.where(f"kind = {COUNTED}").select("a", "b", F.lit(-1).alias("n"))
            new = mine.groupBy("a", "b").agg(F.sum("n").alias("n")).where("n > 0").select("a", "b", F.lit(1).alias("n"))
            both = old.unionByName(new)
            counts = both.groupBy("a", "n").agg(F.count("*").alias("size"))
            chunks = F.ceil(F.col("size") / 2048).cast("int")
            placed = both.join(counts, ["a", "n"]).withColumn("chunks", chunks).withColumn("c", F.pmod(F.xxhash64("b"), "chunks").cast("int"))
            other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("o")
            spread = placed.select(F.col("a").alias("k"), "c", F.col("b").alias("x"), "n", other).select("k", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), "c", "x", "n")
            pairs = spread.groupBy("k", "i", "j", "n").applyInArrow(_chunk_deltas(self.layout.buckets), _STATE)
            # Their rows change kind, so that a later change finds them counted.
            change = moving.select("a", "b", "n").mapInArrow(_moved(self.layout.buckets), _STATE)
            self._write(pairs.unionByName(change))

    def scores(self, least: int, lift: int, changed: DataFrame | None = None) -> DataFrame:
        """(a, b, n_ab, n_a, n_b, baskets, lift) of pairs with n_ab >= least and lift >= `lift`.

        changed: only pairs with one of these items (column item), the ones a change of their baskets affected.
        """
        kept = self.rows(KEPT).select("a", F.col("b").alias("x")).distinct()
        baskets = [r.a for r in kept.select("a").distinct().limit(self.layout.most_kept + 1).collect()]
        if len(baskets) >= least:  # a pair could live in the kept baskets alone: count the pairs of all but a few
            self._settle(max(0, least - 1))
            return self.scores(least, lift, changed)
        pairs = self.rows(PAIR, least=least - len(baskets)).select("a", "b", "n")
        if changed is not None:
            pairs = pairs.join(changed.select(F.col("item").alias("a")).distinct().withColumn("hit_a", F.lit(1)), "a", "left").join(changed.select(F.col("item").alias("b")).distinct().withColumn("hit_b", F.lit(1)), "b", "left").where("hit_a = 1 or hit_b = 1").select("a", "b", "n")
        if baskets:
            bit = F.element_at(F.create_map(*[F.lit(v) for i, k in enumerate(baskets) for v in (k, 1 << i)]), F.col("a"))
            masks = kept.groupBy("x").agg(F.bit_or(bit.cast("bigint")).alias("m"))
            pairs = pairs.join(masks.select(F.col("x").alias("a"), F.col("m").alias("ma")), "a", "left").join(masks.select(F.col("x").alias("b"), F.col("m").alias("mb")), "b", "left")
            pairs = pairs.select("a", "b", (F.col("n") + F.coalesce(F.expr("bit_count(ma & mb)"), F.lit(0))).alias("n")).where(f"n >= {least}")
        items = self.rows(ITEM).select(F.col("a").alias("x"), F.col("n").alias("nx"))
        total = self.rows(BASKETS).agg(F.sum("n").alias("baskets"))
        full = pairs.join(items.select(F.col("x").alias("a"), F.col("nx").alias("n_a")), "a").join(items.select(F.col("x").alias("b"), F.col("nx").alias("n_b")), "b").crossJoin(F.broadcast(total))
        wide = lambda c: F.col(c).cast("decimal(20,0)")
        return full.where(wide("n") * wide("baskets") >= F.lit(lift) * wide("n_a") * wide("n_b")).select("a", "b", F.col("n").alias("n_ab"), "n_a", "n_b", "baskets", (F.col("n") * F.col("baskets") / (F.col("n_a").cast("double") * F.col("n_b"))).alias("lift"))
