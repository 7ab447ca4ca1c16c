"""Problem 2: candidates by the rarest items of a set.

With items in any one order, two sets that share enough share an item among the first few of each. Rare items come first, so
few records meet at one. An item's place in the order is the count of the rows in its bucket, then a hash: a token. Items with
the same token only add candidates.

The smaller set of a pair needs fewer of its first items than the larger one, because more of it must be shared. Records that
meet at a token must be of fitting sizes and their codes within a radius that one pair in a million right at the threshold
exceeds. The original sets decide in the end.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.operators.skew import partitions_for

BITS = 128
#: Buckets items are counted in, a prime; the counts go to all tasks (4 MB).
BUCKETS = 1_048_573
#: Records that meet at one token in one task.
CROWD = 50_000
#: Records looked at for the length of the tokens' lists; decides only the way taken and where rows are compared.
LOOKED_AT = 200_000
#: Share of the pairs right at the threshold that may exceed the radius.
SPARE = 1e-6
_U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed bijective mixing of 64-bit integers."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + _U(0x9E3779B97F4A7C15)
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def binomial_upto(n: int, p: float) -> list[float]:
    out, total = [], 0.0
    for x in range(n + 1):
        total += math.comb(n, x) * p**x * (1 - p) ** (n - x)
        out.append(total)
    return out


def _bytes(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Runs of values, `counts` of them each, as one binary a run."""
    offsets = np.append(0, np.cumsum(counts * values.dtype.itemsize)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All tokens of a column of binaries, and how many each row has."""
    rows = column.cast(pa.large_binary())
    offsets = np.frombuffer(rows.buffers()[1], np.int64)[rows.offset : rows.offset + len(rows) + 1]
    if rows.buffers()[2] is None:
        return np.zeros(0, np.uint32), np.zeros(len(rows), np.int64)
    return np.frombuffer(rows.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(np.uint32), np.diff(offsets) // 4


class Prefixes:
    """The first items of every set, and the pairs of sets that meet there."""

    def __init__(self, df: DataFrame, item: str, numerator: int, denominator: int, least: int):
        counted = df.select(F.col(item).cast("bigint").alias("x")).where("x is not null").groupBy(F.pmod("x", F.lit(BUCKETS)).alias("b")).agg(F.count("*").alias("n")).toArrow()
        counts = np.zeros(BUCKETS, np.uint32)
        counts[np.asarray(counted["b"])] = np.minimum(np.asarray(counted["n"]), 2**31)
        self.sent, self.numerator, self.denominator, self.least = df.sparkSession.sparkContext.broadcast(counts), numerator, denominator, least
        p = (1 - numerator / denominator) / 2
        self.radius, self.first = (next(r for r, c in enumerate(binomial_upto(n, p)) if c >= 1 - SPARE / 2) for n in (BITS, BITS // 2))

    def long(self, sizes: np.ndarray) -> np.ndarray:
        """Items to look at in the larger set of a pair: at least numerator / denominator of it is shared."""
        return sizes + sizes * -self.numerator // self.denominator + 1

    def short(self, sizes: np.ndarray) -> np.ndarray:
        """Items to look at in the smaller set: at least 2 * numerator / (numerator + denominator) of it is shared."""
        return sizes + sizes * (-2 * self.numerator) // (self.numerator + self.denominator) + 1

    def keys(self, items: np.ndarray) -> np.ndarray:
        """Places of items in the order; the lower half is the token."""
        return (self.sent.value[items % BUCKETS].astype(np.uint64) << _U(32)) | (mix64(items.astype(np.int64).view(np.uint64)) >> _U(32))

    def of(self, items: np.ndarray, starts: np.ndarray, sizes: np.ndarray, parts: np.ndarray) -> pa.Array:
        """Tokens of the long prefix of every whole set in order, none below the least size; all keys of a part of a set."""
        keys, row = self.keys(items), np.repeat(np.arange(len(starts)), sizes)
        order = np.lexsort((keys, row))
        keys = keys[order]
        if parts.any():
            some = [keys[a : a + n] if part else keys[a : a + k].astype(np.uint32) for a, n, k, part in zip(starts, sizes, np.where(sizes >= self.least, self.long(sizes), 0), parts)]
            return pa.array([x.tobytes() for x in some], pa.binary())
        wanted = np.where(sizes >= self.least, self.long(sizes), 0)
        kept = np.arange(len(keys)) - starts[row] < wanted[row]
        return _bytes(keys[kept].astype(np.uint32), wanted)

    def joined(self, parts: list[bytes]) -> bytes:
        """Tokens of a set from all keys of its parts."""
        keys = np.concatenate([np.frombuffer(p, np.uint64) for p in parts])
        size = np.array([len(keys)])
        return np.sort(keys)[: int(self.long(size)[0]) if len(keys) >= self.least else 0].astype(np.uint32).tobytes()

    def estimate(self, representatives: DataFrame, records: int) -> tuple[float, dict[int, int]]:
        """Pairs of records that meet at a token, from a sample, and the parts of the tokens where a crowd meets."""
        share = min(1.0, LOOKED_AT / max(1, records))
        looked = representatives.select("tokens")
        rows = (looked if share == 1 else looked.sample(share, 11)).toArrow()
        token, n = np.unique(np.concatenate([np.zeros(0, np.uint32), *(_tokens(c)[0] for c in rows["tokens"].chunks)]), return_counts=True)
        n = n.astype(float)
        crowded = n / share > 4 * CROWD
        return float((n * (n - 1) / 2).sum() / share**2), {int(t): math.ceil(c / share / CROWD) for t, c in zip(token[crowded], n[crowded])}

    def pairs(self, representatives: DataFrame, records: int, parts: dict[int, int]) -> DataFrame:
        """(a, b, size_a, size_b) with a < b, each once: records (r, size, c1, c2, tokens) that meet within the radius.

        A token's records are compared in one task; those of a crowded one are cut into parts by a hash of the record, and
        every two parts meet under a key of their own.
        """

        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                token, counts = _tokens(batch.column("tokens"))
                row = np.repeat(np.arange(batch.num_rows), counts)
                place = np.arange(len(token)) - np.repeat(np.cumsum(counts) - counts, counts)
                r, size, c1, c2 = (np.asarray(batch.column(c)) for c in ("r", "size", "c1", "c2"))
                short, key = place < self.short(size)[row], token.astype(np.int64)
                for t, n in parts.items():
                    at = np.flatnonzero(token == t)
                    if len(at):
                        part = (mix64(r[row[at]]) % _U(n)).astype(np.int64)[:, None]
                        met = np.arange(n)[None, :]
                        own = (np.minimum(part, met) * n + np.maximum(part, met) << 32) + t
                        rest = np.arange(len(token)) != -1
                        rest[at] = False
                        row, short, key = (np.concatenate([a[rest], b]) for a, b in ((row, np.repeat(row[at], n)), (short, np.repeat(short[at], n)), (key, own.reshape(-1))))
                        token = np.concatenate([token[rest], np.full(len(at) * n, t, token.dtype)])
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, r[row], size[row], c1[row], c2[row], short)], ["key", "r", "size", "c1", "c2", "short"])

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = [b for b in batches if b.num_rows]
            if not held:
                return
            table = pa.Table.from_batches(held)
            key, r, size, c1, c2, short = (table[c].combine_chunks().to_numpy(zero_copy_only=False) for c in table.column_names)
            del table, held
            order = np.lexsort((r, size, key))
            key, r, size, c1, c2, short = (x[order] for x in (key, r, size, c1.view(np.uint64), c2.view(np.uint64), short))
            for i, j in self._near(key, r, size, c1, c2, short, parts):
                swap = r[i] > r[j]
                i, j = np.where(swap, j, i), np.where(swap, i, j)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (r[i], r[j], size[i], size[j])], ["a", "b", "size_a", "size_b"])

        met = representatives.select("r", "size", "c1", "c2", "tokens").mapInArrow(spread, "key bigint, r bigint, size bigint, c1 bigint, c2 bigint, short boolean")
        tasks = partitions_for(representatives, records, 200_000)
        return met.repartition(tasks, "key").mapInArrow(compare, "a bigint, b bigint, size_a bigint, size_b bigint").distinct()

    def _near(self, key, r, size, c1, c2, short, parts: dict[int, int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows, ordered by key, size and record, that meet: all look at their d-th neighbour together, the smaller set by its
        short prefix, as far as sizes fit."""
        edges = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        group = np.cumsum(np.append(False, key[1:] != key[:-1])).astype(np.int64)
        scale, largest = np.int64(1) << 32, (np.int64(1) << 32) - 1
        # A group's rows lie in order of size: the last that fits each of them.
        end = np.searchsorted(group * scale + np.minimum(size, largest), group * scale + np.minimum(size * self.denominator // self.numerator, largest), side="right")
        across = np.zeros(len(edges), np.int64)  # of how many parts a key joins two different ones; 0 elsewhere
        for g in np.flatnonzero(np.isin(key[edges] & 0xFFFFFFFF, list(parts))) if parts else []:
            pair, n = key[edges[g]] >> 32, parts[int(key[edges[g]] & 0xFFFFFFFF)]
            across[g] = n * (pair // n != pair % n)
        active, d = np.flatnonzero(short), 1
        while len(active := active[active + d < end[active]]):
            x = c1[active] ^ c1[active + d]
            near = np.flatnonzero(np.bitwise_count(x) <= self.first)
            i = active[near]
            i = i[np.bitwise_count(x[near]).astype(np.int64) + np.bitwise_count(c2[i] ^ c2[i + d]) <= self.radius]
            i = i[r[i] != r[i + d]]
            if parts and len(i):
                n = across[group[i]].astype(np.uint64)
                m = np.maximum(n, _U(1))
                i = i[(n == 0) | (mix64(r[i]) % m != mix64(r[i + d]) % m)]
            if len(i):
                yield i, i + d
            d += 1
