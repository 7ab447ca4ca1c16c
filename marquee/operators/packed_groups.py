"""Ratings of consecutive groups, packed: a row of a table holds many whole groups as arrays, in order of user and item.

Rows are dealt out once, as bytes by user ranges that end where groups end; the last rating of a user and item, the groups'
numbers and the order are worked out where they arrive. Whoever reads the table needs no further shuffle to see whole groups.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.operators.ranking import with_position
from marquee.session import freeing, removed, scratch, ship, written

#: Rows of a user range, rows dealt out at a time, rows of a packed row: about so many.
EACH, AT_ONCE, PACKED = 500_000, 200_000, 50_000
#: Most stretches of users that reach the driver, to choose the ranges from.
STRETCHES = 100_000
_PACKED = "position bigint, users binary, counts binary, items binary, ratings binary"


def _planes(values: np.ndarray) -> bytes:
    """The first bytes of all values, then the second and so on: most of them are alike, so they compress."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def _values(planes: bytes | memoryview, kind: type, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(-1, n).T).reshape(-1).view(kind)


def places_in_order(major: np.ndarray, minor: np.ndarray) -> np.ndarray:
    """Places in order of major, then minor; equal pairs in any order. One key of both sorts faster, where it fits 63 bits."""
    if not len(major):
        return np.zeros(0, np.int64)
    first, low = int(major.min()), int(minor.min())
    wide = int(minor.max()) - low + 1
    if (int(major.max()) - first + 1) * wide < 1 << 63:
        return np.argsort((major - first) * wide + (minor - low))
    return np.lexsort((minor, major))


def _latest(user: np.ndarray, item: np.ndarray, rating: np.ndarray, ts: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Places in order of user and item, one a pair: the latest, then the highest rating; no time is before any time."""
    order = places_in_order(user, item)
    u, i = user[order], item[order]
    same = (u[1:] == u[:-1]) & (i[1:] == i[:-1])
    if not same.any():
        return order
    twice = np.append(same, False) | np.append(False, same)
    some = np.flatnonzero(twice)
    of = order[some]
    order[some] = of[np.lexsort((rating[of], np.where(known[of], ts[of], 0), known[of], i[some], u[some]))]
    return order[~np.append(same, False)]  # the last of equal ones


@dataclass(frozen=True)
class PackedGroups:
    """table: `position` is that of the row's first user among all users; groups are `size` users in order of their ids.

    known: a broadcast of all items in order and the mean of each, for the round machine.
    """

    spark: SparkSession
    table: DataFrame
    size: int
    known: Any = None

    @classmethod
    def of(cls, rows: DataFrame, size: int, each: int = EACH, at_once: int = AT_ONCE, packed: int = PACKED) -> PackedGroups:
        """From valid rows (user_id, item_id, rating, ts), of which the latest counts, then the highest rating."""
        spark = rows.sparkSession
        ship(spark)
        rows = rows.select(F.col("user_id").cast("bigint"), F.col("item_id").cast("bigint"), F.col("rating").cast("double"), F.col("ts").cast("bigint"))
        placed = with_position(written(rows.groupBy("user_id").agg(F.count("*").alias("n")), "users"), ["user_id"], "pos")
        users = placed.count()
        step = size * max(1, -(-users // (STRETCHES * size)))
        firsts, positions, held = [], [], each
        for r in placed.groupBy(F.floor(F.col("pos") / step).alias("k")).agg(F.min("user_id").alias("first"), F.sum("n").alias("n")).orderBy("k").collect():
            if held + r.n > each:
                firsts.append(r["first"])
                positions.append(r.k * step)
                held = 0
            held += r.n
        first, position = np.array(firsts, np.int64), np.array(positions, np.int64)

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def out(held: list[pa.RecordBatch]) -> pa.RecordBatch:
                table = pa.Table.from_batches(held)
                u, i, x = (np.asarray(table[c].combine_chunks()) for c in ("user_id", "item_id", "rating"))
                ts = table["ts"].combine_chunks()
                known, ts = np.asarray(ts.is_valid()).astype(np.uint8), np.asarray(ts.fill_null(0))
                order = np.argsort(u)
                edges = np.append(np.searchsorted(u[order], first), len(order))
                parts = np.flatnonzero(np.diff(edges))
                payloads = []
                for lo, hi in zip(edges[parts].tolist(), edges[parts + 1].tolist()):
                    at = order[lo:hi]
                    payloads.append(b"".join(_planes(c[at]) for c in (u, i, x, ts, known)))
                return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(payloads, pa.binary())], ["part", "payload"])

            held, n = [], 0
            for batch in batches:
                if batch.num_rows:
                    held.append(batch)
                    n += batch.num_rows
                if n >= at_once:
                    yield out(held)
                    held, n = [], 0
            if held:
                yield out(held)

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts: dict[int, list[bytes]] = {}
            for batch in batches:
                for part, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    parts.setdefault(part, []).append(payload)
            for part in sorted(parts):
                held = []
                for payload in parts.pop(part):
                    n = len(payload) // 33
                    bytes_of = memoryview(payload)
                    held.append([_values(bytes_of[8 * n * c : 8 * n * (c + 1)], kind, n) for c, kind in enumerate((np.int64, np.int64, np.float64, np.int64))] + [_values(bytes_of[32 * n :], np.uint8, n)])
                user, item, rating, ts, known = (np.concatenate(c) for c in zip(*held))
                order = _latest(user, item, rating, ts, known)
                user, item, rating = user[order], item[order], rating[order]
                starts = np.flatnonzero(np.append(True, user[1:] != user[:-1]))
                ids, counts = user[starts], np.diff(np.append(starts, len(user)))
                begun = 0
                for k in range(size, len(ids) + size, size):
                    upto = min(k, len(ids))
                    lo, hi = starts[begun], starts[upto] if upto < len(ids) else len(user)
                    if hi - lo >= packed or upto == len(ids):
                        row = [[int(position[part]) + begun], *([_planes(a)] for a in (ids[begun:upto], counts[begun:upto], item[lo:hi], rating[lo:hi]))]
                        yield pa.RecordBatch.from_arrays([pa.array(row[0], pa.int64()), *(pa.array(c, pa.binary()) for c in row[1:])], [c.split()[0] for c in _PACKED.split(", ")])
                        begun = upto

        path = scratch(spark, "groups")
        if not len(first):
            return cls(spark, spark.createDataFrame([], _PACKED), size)
        with freeing(spark):
            rows.mapInArrow(deal, "part int, payload binary").repartitionById(len(first), "part").mapInArrow(pack, _PACKED).write.parquet(path)
        for used in {f.rpartition("/")[0] for f in placed.inputFiles()}:
            removed(spark, used)
        return cls(spark, spark.read.schema(_PACKED).parquet(path), size)

    def mapped(self, made, schema: str) -> DataFrame:
        """made(position of the first user, users, ratings of each, items, ratings) of every packed row: batches."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for position, users, counts, items, ratings in zip(*(c for c in batch.columns)):
                    n = len(users.as_buffer()) // 8, len(items.as_buffer()) // 8
                    yield from made(position.as_py(), *(_values(c.as_buffer(), kind, n[k > 1]) for k, (c, kind) in enumerate(zip((users, counts, items, ratings), (np.int64, np.int64, np.int64, np.float64)))))

        ship(self.spark)
        return self.table.mapInArrow(run, schema)

    def means(self) -> DataFrame:
        """(item_id, otherwise): the mean of an item's ratings, by all users."""

        def made(position, users, counts, items, ratings) -> Iterator[pa.RecordBatch]:
            ids, at = np.unique(items, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.bincount(at, ratings, len(ids))), pa.array(np.bincount(at, minlength=len(ids)))], ["item_id", "s", "n"])

        parts = self.mapped(made, "item_id bigint, s double, n bigint")
        return parts.groupBy("item_id").agg(F.round(F.sum("s") / F.sum("n"), 6).alias("otherwise"))

    def rows(self) -> DataFrame:
        """(group_id, user_id, item_id, rating) of whole groups."""
        size = self.size

        def made(position, users, counts, items, ratings) -> Iterator[pa.RecordBatch]:
            whole, group = whole_groups(position, users, size)
            upto = int(counts[:whole].sum())
            user = np.repeat(np.arange(whole), counts[:whole])
            yield pa.RecordBatch.from_arrays([pa.array(group[user]), pa.array(users[user]), pa.array(items[:upto]), pa.array(ratings[:upto])], ["group_id", "user_id", "item_id", "rating"])

        return self.mapped(made, "group_id bigint, user_id bigint, item_id bigint, rating double")


def whole_groups(position: int, users: np.ndarray, size: int) -> tuple[int, np.ndarray]:
    """How many users of a packed row are in whole groups, and everybody's group; only the last one of all can lack members."""
    return len(users) // size * size, (position + np.arange(len(users))) // size
