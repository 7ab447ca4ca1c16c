"""Problem 2: all pairs of set-valued records whose Jaccard similarity reaches a threshold.

Records are looked up by the rarest items of their sets where that is less work (`set_prefixes.py`); it finds every pair but
for one in a million right at the threshold. Where items are so few that their lists are long, by sketches:

Multi-index binary sketches. Each record's set is reduced to one-bit minhashes packed into a code of 128 bits; two sets of
similarity s agree in a bit with probability (1 + s) / 2. Every index takes a segment, some fixed bits of the code, and
joins the records that agree in all of them; candidates must then lie within a Hamming radius. The radius and the number of
segments are computed from the binomial law so that a pair right at the threshold is found with the recall asked for (more
similar pairs with more). Segment length grows with the logarithm of the number of records, so segment groups keep their
expected size. The original sets decide every candidate in the end, so precision is 1.

A pure pigeonhole guarantee for that radius would need segments of one or two bits, that is, a comparison of all pairs;
hence the segments overlap in the code and their number is calibrated instead.

Records with equal sets form one class and take part once. The result is given as pairs of class representatives plus
membership; expand() lists the pairs of records.

Defined cases: null records and items are left out; repeated rows count once; records below the least size take no part;
extra columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.set_prefixes import BITS, Prefixes, binomial_upto, mix64
from marquee.operators.skew import clustered, partitions_for
from marquee.session import ship, written

#: Records a segment group is expected to hold, and records of one cell (a task's share of one index).
GROUP, CELL = 512, 200_000
#: Segments whose cells lie on disk at once (about 18 bytes a record and segment).
AT_ONCE = 24
#: Records looked at to find crowded cells; the sample decides only where rows are compared.
LOOKED_AT = 200_000
_U = np.uint64


def item_hashes(items: np.ndarray) -> np.ndarray:
    """(items, BITS) 16-bit hash values."""
    lanes = np.arange(BITS // 4, dtype=np.uint64) * _U(0xD1342543DE82EF95)
    return mix64(mix64(items.astype(np.int64).view(np.uint64))[:, None] ^ lanes[None, :]).view(np.uint16)


def minhashes(items: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(records, BITS) minima over each record's items; sets of one size are reduced together."""
    distinct, local = np.unique(items, return_inverse=True)
    table = item_hashes(distinct)
    out = np.empty((len(starts), BITS), np.uint16)
    for size in np.unique(sizes):
        chosen = np.flatnonzero(sizes == size)
        step = max(1, 40_000 // int(size))
        for k in range(0, len(chosen), step):
            rows = chosen[k : k + step]
            if size > 40_000:
                part = local[starts[rows[0]] : starts[rows[0]] + size]
                out[rows[0]] = np.min([table[part[j : j + 40_000]].min(axis=0) for j in range(0, int(size), 40_000)], axis=0)
            else:
                out[rows] = table[local[starts[rows][:, None] + np.arange(size)]].min(axis=1)
    return out


def packed(minima: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lowest bits of the minima as two 64-bit words."""
    words = np.packbits((minima & 1).astype(np.uint8), axis=1).view(">u8").astype(np.uint64)
    return words[:, 0], words[:, 1]


def set_hashes(items: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two order-free 64-bit hashes of each record's set; partial ones add up."""
    h = mix64(items.astype(np.int64).view(np.uint64))
    with np.errstate(over="ignore"):
        return np.add.reduceat(h, starts).view(np.int64), np.add.reduceat(mix64(h ^ _U(0xA5A5A5A5)), starts).view(np.int64)


def _signatures(batches: Iterator[pa.RecordBatch], prefixes: Prefixes | None = None) -> Iterator[pa.RecordBatch]:
    """Sorted (k, part, x) rows to one row a (record, part): size, set hashes, code, the minima for hot records' parts, tokens."""
    names = ["r", "size", "h1", "h2", "c1", "c2", "minima", "tokens"]

    def flush(k, p, x):
        fresh = np.concatenate([[True], (k[1:] != k[:-1]) | (p[1:] != p[:-1]) | (x[1:] != x[:-1])])
        k, p, x = k[fresh], p[fresh], x[fresh]
        starts = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (p[1:] != p[:-1])]))
        sizes = np.diff(np.append(starts, len(k)))
        minima = minhashes(x, starts, sizes)
        c1, c2 = packed(minima)
        h1, h2 = set_hashes(x, starts)
        kept = [m.tobytes() if part else None for m, part in zip(minima, p[starts])]
        return pa.RecordBatch.from_arrays([pa.array(k[starts]), pa.array(sizes.astype(np.int64)), pa.array(h1), pa.array(h2), pa.array(c1.view(np.int64)), pa.array(c2.view(np.int64)), pa.array(kept, pa.binary()), prefixes.of(x, starts, sizes, p[starts]) if prefixes else pa.nulls(len(starts), pa.binary())], names)

    held: list[tuple[np.ndarray, ...]] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(tuple(np.asarray(c) for c in batch.columns))
        rows += batch.num_rows
        if rows >= 100_000:
            k, p, x = (np.concatenate(c) for c in zip(*held))
            end = int(np.flatnonzero((k != k[-1]) | (p != p[-1]))[-1]) + 1 if (k[0], p[0]) != (k[-1], p[-1]) else 0
            if end:
                yield flush(k[:end], p[:end], x[:end])
            held, rows = [(k[end:], p[end:], x[end:])], len(k) - end if end else 0
    if held:
        k, p, x = (np.concatenate(c) for c in zip(*held))
        if len(k):
            yield flush(k, p, x)


_SIGNATURE = "r bigint, size bigint, h1 bigint, h2 bigint, c1 bigint, c2 bigint, minima binary, tokens binary"


def _joined(key: tuple[pa.Scalar, ...], table: pa.Table, prefixes: Prefixes | None = None) -> pa.Table:
    """The parts of one hot record (at most as many as skew.PARTS) to its signature."""
    minima = np.array([np.frombuffer(m, np.uint16) for m in table["minima"].to_pylist()]).min(axis=0, keepdims=True)
    c1, c2 = packed(minima)
    with np.errstate(over="ignore"):
        h1, h2 = (np.asarray(table[c]).sum(dtype=np.int64) for c in ("h1", "h2"))
    tokens = prefixes.joined(table["tokens"].to_pylist()) if prefixes else None
    return pa.table({"r": [key[0].as_py()], "size": [int(np.asarray(table["size"]).sum())], "h1": [int(h1)], "h2": [int(h2)], "c1": pa.array(c1.view(np.int64)), "c2": pa.array(c2.view(np.int64)), "minima": pa.array([None], pa.binary()), "tokens": pa.array([tokens], pa.binary())})


def signatures(df: DataFrame, record: str, item: str, prefixes: Prefixes | None = None) -> DataFrame:
    """(r, size, h1, h2, c1, c2) of every record, and its tokens where prefixes are given, written to the shared folder."""
    ship(df.sparkSession)
    source = df.select(F.col(record).cast("bigint").alias("record"), F.col(item).cast("bigint").alias("item"))
    made = written(clustered(source, "record", "item").mapInArrow(lambda batches: _signatures(batches, prefixes), _SIGNATURE), "signatures")
    columns = ["r", "size", "h1", "h2", "c1", "c2", *["tokens"] * (prefixes is not None)]
    if not made.where("minima is not null").limit(1).count():
        return made.select(columns)
    whole = made.where("minima is null").select(columns)
    return whole.unionByName(made.where("minima is not null").groupBy("r").applyInArrow(lambda key, table: _joined(key, table, prefixes), _SIGNATURE).select(columns))


@dataclass(frozen=True)
class Plan:
    """Masks of the segments, Hamming radius of the code and of its first word, and the recall expected at the threshold."""

    masks: list[tuple[int, int]]
    bits: list[list[int]]
    radius: int
    first: int
    recall: float


def calibrate(records: int, threshold: float, recall: float, seed: int = 5) -> Plan:
    """Segment length from the number of records; radius and number of segments from the recall wanted at the threshold."""
    p = (1 - threshold) / 2
    width = min(24, max(4, math.ceil(math.log2(max(records, 1) / GROUP))))
    spare = 1 - recall
    upto, half = binomial_upto(BITS, p), binomial_upto(BITS // 2, p)
    radius = next(r for r, c in enumerate(upto) if c >= 1 - spare / 4)
    first = next(r for r, c in enumerate(half) if c >= 1 - spare / 8)
    law = [upto[0], *(b - a for a, b in zip(upto, upto[1:]))]
    agree = [math.comb(BITS - x, width) / math.comb(BITS, width) if x <= BITS - width else 0.0 for x in range(BITS + 1)]
    count = 1
    while sum(law[x] * (1 - agree[x]) ** count for x in range(radius + 1)) > spare / 2:
        count += 1
    rng, bits, left = np.random.default_rng(seed), [], []
    for _ in range(count):
        while len(left) < width:  # every bit is used about equally often
            left += [int(b) for b in rng.permutation(BITS) if b not in left]
        bits.append(sorted(left[:width]))
        left = left[width:]
    masks = [tuple(sum(1 << (63 - (b - 64 * w)) for b in segment if b // 64 == w) for w in (0, 1)) for segment in bits]
    return Plan(masks, bits, radius, first, recall)


def segment_values(c1: np.ndarray, c2: np.ndarray, bits: list[int]) -> np.ndarray:
    out = np.zeros(len(c1), np.uint32)
    for b in bits:
        word = c1 if b < 64 else c2
        out = (out << np.uint32(1)) | ((word >> _U(63 - b % 64)) & _U(1)).astype(np.uint32)
    return out


def _packed_cell(ids, sizes, c1, c2) -> bytes:
    order = np.argsort(ids)
    deltas = np.diff(ids[order], prepend=np.int64(0))
    raw = b"".join(a.view(np.uint8).reshape(len(ids), -1).T.tobytes() for a in (deltas, sizes[order].astype(np.int32), c1[order], c2[order]))
    return len(ids).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unpacked_cell(payload: bytes) -> tuple[np.ndarray, ...]:
    n = int.from_bytes(payload[:8], "little")
    raw, out, at = np.frombuffer(pa.decompress(payload[8:], 28 * n, "zstd", asbytes=True), np.uint8), [], 0
    for kind in (np.int64, np.int32, np.uint64, np.uint64):
        width = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(raw[at : at + width * n].reshape(width, n).T).reshape(-1).view(kind))
        at += width * n
    out[0] = np.cumsum(out[0])
    return tuple(out)


def cell_pairs(segment: int, plan: Plan, ids, sizes, c1, c2, numerator: int, denominator: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of row numbers of a cell that agree in the segment, in no earlier one, and lie within the radius.

    Rows are ordered by segment value and size, so that the partners a row may have by size are the next few; all rows
    look at their d-th neighbour together.
    """
    value = segment_values(c1, c2, plan.bits[segment])
    order = np.lexsort((sizes, value))
    value, a, b, s = value[order], c1[order], c2[order], sizes[order].astype(np.int64)
    # The end of each row's window: same value, and size at most size * denominator / numerator.
    scale = np.int64(1) << 32
    key, most = value.astype(np.int64) * scale + s, value.astype(np.int64) * scale + np.minimum(s * denominator // numerator, scale - 1)
    end = np.searchsorted(key, most, side="right")
    active, d = np.arange(len(s)), 1
    earlier = [(_U(x), _U(y)) for x, y in plan.masks[:segment]]
    while True:
        active = active[active + d < end[active]]
        if not len(active):
            return
        x1 = a[active] ^ a[active + d]
        near = np.flatnonzero(np.bitwise_count(x1) <= plan.first)
        if len(near):
            left = active[near]
            y1, y2 = x1[near], b[left] ^ b[left + d]
            keep = np.bitwise_count(y1).astype(np.int64) + np.bitwise_count(y2) <= plan.radius
            for m1, m2 in earlier:
                keep &= ((y1 & m1) | (y2 & m2)) != 0
            if keep.any():
                yield order[left[keep]], order[left[keep] + d]
        d += 1


def top_bits(records: int, plan: Plan) -> int:
    """Leading bits of a segment's value that name its cell."""
    return min(max(0, math.ceil(math.log2(max(records, 1) / CELL))), len(plan.bits[0]))


def crowded(representatives: DataFrame, plan: Plan, top: int, records: int) -> dict[int, int]:
    """Parts of the cells that a sample says hold more than 4 * CELL records: groups of near-duplicates. Layout only."""
    if records <= 4 * CELL:
        return {}
    rows = representatives.select("c1", "c2").sample(min(1.0, LOOKED_AT / records), 11).toArrow()
    c1, c2 = (np.asarray(rows[c].combine_chunks()).view(np.uint64) for c in ("c1", "c2"))
    out, width = {}, len(plan.bits[0])
    for s, bits in enumerate(plan.bits):
        at, n = np.unique(segment_values(c1, c2, bits) >> np.uint32(width - top), return_counts=True)
        for v, k in zip(at.tolist(), (n * (records / max(1, len(c1)))).tolist()):
            if k > 4 * CELL:
                out[(s << 24) + v] = math.ceil(k / CELL)
    return out


def candidates(representatives: DataFrame, plan: Plan, numerator: int, denominator: int, records: int, parts: dict[int, int] | None = None, segments: range | None = None) -> DataFrame:
    """(a, b, size_a, size_b) with a < b: pairs within the radius that share a segment, each once.

    segments: only pairs whose first shared segment is one of these.
    A cell is compared in one task; a crowded one is cut into parts by a hash of its records, and every two parts meet in a
    task of their own.
    """
    width, top = len(plan.bits[0]), top_bits(records, plan)
    cut = crowded(representatives, plan, top, records) if parts is None else parts
    chosen = range(len(plan.bits)) if segments is None else segments

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held):
            ids, sizes, c1, c2 = (np.concatenate(c) for c in zip(*held))
            c1, c2 = c1.view(np.uint64), c2.view(np.uint64)
            for s in chosen:
                at = segment_values(c1, c2, plan.bits[s]) >> np.uint32(width - top)
                cells, pairs, payloads = [], [], []
                for v in np.unique(at):
                    cell, rows = (s << 24) + int(v), np.flatnonzero(at == v)
                    n = cut.get(cell, 1)
                    part = (mix64(ids[rows]) % np.uint64(n)).astype(np.int64)
                    for i in range(n) if n > 1 else [0]:
                        mine = rows[part == i] if n > 1 else rows
                        if not len(mine):
                            continue
                        payload = _packed_cell(ids[mine], sizes[mine], c1[mine], c2[mine])
                        for j in range(n):
                            cells.append(cell)
                            pairs.append(min(i, j) * n + max(i, j))
                            payloads.append(payload)
                yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(pairs, pa.int64()), pa.array(payloads, pa.binary())], ["cell", "pair", "payload"])

        held, rows = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append([np.asarray(c) for c in batch.columns])
                rows += batch.num_rows
            if rows >= CELL:
                yield from out(held)
                held, rows = [], 0
        if held:
            yield from out(held)

    def compare(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        cell, pair = key[0].as_py(), key[1].as_py()
        unpacked = [_unpacked_cell(p) for p in table["payload"].to_pylist()]
        ids, sizes, c1, c2 = (np.concatenate(c) for c in zip(*unpacked))
        found = list(cell_pairs(cell >> 24, plan, ids, sizes, c1, c2, numerator, denominator))
        i, j = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int))
        n = cut.get(cell, 1)
        if pair // n != pair % n:  # two parts: pairs within one are found where it meets itself
            part = mix64(ids) % np.uint64(n)
            across = part[i] != part[j]
            i, j = i[across], j[across]
        i, j = np.where(ids[i] < ids[j], i, j), np.where(ids[i] < ids[j], j, i)
        return pa.table({"a": ids[i].astype(np.int64), "b": ids[j].astype(np.int64), "size_a": sizes[i].astype(np.int64), "size_b": sizes[j].astype(np.int64)})

    cells = representatives.select("r", "size", "c1", "c2").mapInArrow(spread, "cell bigint, pair bigint, payload binary")
    tasks = partitions_for(representatives, records * len(chosen), 2_000_000)
    return cells.repartition(tasks, "cell", "pair").groupBy("cell", "pair").applyInArrow(compare, "a bigint, b bigint, size_a bigint, size_b bigint")


def near_pairs(representatives: DataFrame, plan: Plan, numerator: int, denominator: int, records: int, at_once: int = AT_ONCE) -> DataFrame:
    """candidates() of all segments, written to the shared folder. `at_once` segments go through a shuffle at a time, whose
    files are then deleted: their number grows with the records, the disk a record takes doesn't."""
    cut = crowded(representatives, plan, top_bits(records, plan), records)
    out = None
    for first in range(0, len(plan.bits), at_once):
        some = range(first, min(first + at_once, len(plan.bits)))
        near = written(candidates(representatives, plan, numerator, denominator, records, cut, some), "near")
        out = near if out is None else out.unionByName(near)
    return out


def similar_sets(df: DataFrame, record: str, item: str, *, numerator: int = 7, denominator: int = 10, least: int = 8, recall: float = 0.998) -> tuple[DataFrame, DataFrame]:
    """Pairs of class representatives (a, b, common, size_a, size_b) with common / united >= numerator / denominator,
    and membership (record, class_id): records with equal sets share a class, whose id is its least record."""
    prefixes = Prefixes(df, item, numerator, denominator, least)
    signed = signatures(df, record, item, prefixes).where(F.col("size") >= least)
    classes = signed.groupBy("h1", "h2", "size").agg(*(F.min(c).alias(c) for c in ("r", "c1", "c2", "tokens")))
    representatives = written(classes, "classes")
    records = representatives.count()
    members = signed.join(representatives.select("h1", "h2", "size", F.col("r").alias("class_id")), ["h1", "h2", "size"]).select(F.col("r").alias(record), "class_id")
    plan = calibrate(records, numerator / denominator, recall)
    met, parts = prefixes.estimate(representatives, records)
    if met <= records * len(plan.bits) * GROUP // 8:
        near = written(prefixes.pairs(representatives, records, parts), "near")
    else:
        near = near_pairs(representatives, plan, numerator, denominator, records)
    # The original sets decide.
    involved = near.select(F.col("a").alias("r")).union(near.select("b")).distinct()
    rows = df.select(F.col(record).cast("bigint").alias("r"), F.col(item).cast("bigint").alias("x")).where("x is not null").join(involved, "r", "left_semi").distinct()
    left = near.join(rows.withColumnRenamed("r", "a"), "a")
    both = left.join(rows.withColumnRenamed("r", "b"), ["b", "x"])
    common = both.groupBy("a", "b", "size_a", "size_b").agg(F.count("*").alias("common"))
    pairs = common.where(F.col("common") * denominator >= numerator * (F.col("size_a") + F.col("size_b") - F.col("common")))
    return pairs.select("a", "b", "common", "size_a", "size_b"), members


def expand(pairs: DataFrame, members: DataFrame, record: str) -> DataFrame:
    """All pairs of records (id_a < id_b): those between similar classes and those within a class."""
    m = members.select(F.col(record).alias("m"), "class_id")
    first, second = m.select(F.col("m").alias("x"), F.col("class_id").alias("a")), m.select(F.col("m").alias("y"), F.col("class_id").alias("b"))
    between = pairs.select("a", "b").join(first, "a").join(second, "b").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    within = first.join(second.withColumnRenamed("b", "a"), "a").where("x < y").select(F.col("x").alias("id_a"), F.col("y").alias("id_b"))
    return between.unionByName(within)
