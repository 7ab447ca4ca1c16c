"""Dense symmetric matrices in blocks: a table of (bi, bj, payload) with bi <= bj, held in the shared folder.

A payload is a block of doubles in row order. The inverse is computed in place by sweeps over block columns; the only data
that reaches the driver and is sent to all tasks is one panel of block columns, whose width is chosen so that it stays within
PANEL_BYTES; every task inverts the pivot block inside it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.session import freeing, removed, scratch, ship

#: Most bytes of a panel (rows of the whole matrix by one block's columns).
PANEL_BYTES = 64 << 20
#: Most rows of a block.
WIDEST = 768
_BLOCKS = "bi int, bj int, payload binary"


def spd_inverse(matrix: np.ndarray) -> np.ndarray:
    """Inverse of a symmetric positive definite matrix; called in tasks only.

    On the driver, a process that has forked, a threaded linear algebra call was seen to wait for ever.
    """
    try:
        np.linalg.cholesky(matrix)
    except np.linalg.LinAlgError:
        raise ValueError("the matrix is not positive definite") from None
    inverse = np.linalg.inv(matrix)
    return (inverse + inverse.T) / 2


def block_width(n: int) -> int:
    """Rows of a block of an n by n matrix."""
    return max(16, min(WIDEST, PANEL_BYTES // (8 * max(1, n)), n))


def _batch(rows: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([i for i, _, _ in rows], pa.int32()), pa.array([j for _, j, _ in rows], pa.int32()), pa.array([np.ascontiguousarray(b).tobytes() for _, _, b in rows], pa.binary())], ["bi", "bj", "payload"])


@dataclass(frozen=True)
class BlockMatrix:
    """A symmetric n by n matrix in the shared folder."""

    spark: SparkSession
    path: str
    n: int
    width: int

    @property
    def blocks(self) -> int:
        return -(-self.n // self.width)

    def rows_of(self, block: int) -> int:
        return min(self.width, self.n - block * self.width)

    def frame(self) -> DataFrame:
        return self.spark.read.schema(_BLOCKS).parquet(self.path)

    def array(self, i: int, j: int, payload: bytes) -> np.ndarray:
        return np.frombuffer(payload, np.float64).reshape(self.rows_of(i), self.rows_of(j))

    @classmethod
    def of_cells(cls, cells: DataFrame, n: int, width: int | None = None) -> BlockMatrix:
        """From cells (i, j, g) of the upper triangle, i <= j < n; cells that are absent are 0."""
        spark, w = cells.sparkSession, width or block_width(n)
        ship(spark)
        made = cls(spark, scratch(spark, "matrix"), n, w)
        count, shape = made.blocks, made._plain()
        every = spark.range(count * count).select((F.col("id") / count).cast("int").alias("bi"), (F.col("id") % count).cast("int").alias("bj"), F.lit(None).cast("int").alias("i"), F.lit(None).cast("int").alias("j"), F.lit(None).cast("double").alias("g")).where("bi <= bj")
        placed = cells.select((F.col("i") / w).cast("int").alias("bi"), (F.col("j") / w).cast("int").alias("bj"), (F.col("i") % w).cast("int").alias("i"), (F.col("j") % w).cast("int").alias("j"), F.col("g").cast("double").alias("g"))

        def build(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            bi, bj = key[0].as_py(), key[1].as_py()
            table = table.filter(pc.is_valid(table["i"]))
            i, j, g = (np.asarray(table[c].combine_chunks()) for c in ("i", "j", "g"))
            block = np.zeros((shape.rows_of(bi), shape.rows_of(bj)))
            block[i, j] = g
            if bi == bj:
                block = np.triu(block) + np.triu(block, 1).T
            return pa.Table.from_batches([_batch([(bi, bj, block)])])

        # As many files as there are block columns to share out, and more on a small matrix; later steps keep to them.
        files = min(count * (count + 1) // 2, max(4 * spark.sparkContext.defaultParallelism, count)) or 1
        made._write(placed.unionByName(every).repartition(files, "bi", "bj").groupBy("bi", "bj").applyInArrow(build, _BLOCKS), made.path)
        return made

    @staticmethod
    def _write(blocks: DataFrame, path: str) -> None:
        with freeing(blocks.sparkSession):
            blocks.write.mode("overwrite").option("compression", "uncompressed").parquet(path)

    def diagonal(self) -> np.ndarray:
        """n doubles."""
        shape = self._plain()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield _batch([(i, j, np.diag(shape.array(i, j, p))) for i, j, p in zip(*(c.to_pylist() for c in batch.columns))])

        rows = self.frame().where("bi = bj").mapInArrow(run, _BLOCKS).toArrow()
        parts = dict(zip(rows["bi"].to_pylist(), rows["payload"].to_pylist()))
        return np.concatenate([np.frombuffer(parts[k], np.float64) for k in range(self.blocks)]) if self.n else np.zeros(0)

    def _plain(self) -> BlockMatrix:
        """The shape alone, to travel with tasks."""
        return BlockMatrix(None, "", self.n, self.width)

    def inverse(self, add: float = 0.0, used_up: bool = False) -> BlockMatrix:
        """The inverse of this positive definite matrix with `add` added to its diagonal, as a new table. used_up: this one is
        deleted after the first sweep, so that no more than two tables lie on disk.

        A block column is swept at a time: with C the column, P the inverse of its pivot block, every other block loses
        C_i P C_j'. After all sweeps the table holds the inverse with its sign turned.
        """
        shape, spark, old = self._plain(), self.spark, self.path if used_up else None
        path = self.path
        for k in range(self.blocks):
            frame = spark.read.schema(_BLOCKS).parquet(path)
            rows = frame.where((F.col("bi") == k) | (F.col("bj") == k)).toArrow()  # one panel
            panel = np.zeros((self.n, self.rows_of(k)))
            for i, j, p in zip(*(rows[c].to_pylist() for c in ("bi", "bj", "payload"))):
                block = shape.array(i, j, p)
                other, block = (i, block) if j == k else (j, block.T)
                panel[other * self.width : other * self.width + len(block)] = block
            at = slice(k * self.width, k * self.width + self.rows_of(k))
            sent = spark.sparkContext.broadcast(panel)
            fresh = k == 0

            def sweep(batches: Iterator[pa.RecordBatch], k=k, at=at, sent=sent, fresh=fresh) -> Iterator[pa.RecordBatch]:
                panel = sent.value
                mine = panel[at]
                p = spd_inverse(mine + (add if fresh else 0.0) * np.eye(len(mine)))  # every task works out the same one
                part = lambda b: panel[b * shape.width : b * shape.width + shape.rows_of(b)]
                for batch in batches:
                    out = []
                    for i, j, payload in zip(*(c.to_pylist() for c in batch.columns)):
                        block = shape.array(i, j, payload)
                        if i == k and j == k:
                            block = -p
                        elif i == k:
                            block = p @ part(j).T
                        elif j == k:
                            block = part(i) @ p
                        else:
                            block = block - (part(i) @ p) @ part(j).T
                            if i == j and fresh:
                                block += add * np.eye(len(block))
                        out.append((i, j, block))
                    yield _batch(out)

            new = scratch(spark, "matrix")
            self._write(frame.mapInArrow(sweep, _BLOCKS), new)
            sent.unpersist()
            if old:
                removed(spark, old)
            path = old = new
        return BlockMatrix(spark, path, self.n, self.width)

    def column_panels(self) -> DataFrame:
        """(c, r, payload): every block of the full matrix, by column block c and row block r."""
        shape = self._plain()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for i, j, payload in zip(*(c.to_pylist() for c in batch.columns)):
                    out.append((j, i, shape.array(i, j, payload)))
                    if i != j:
                        out.append((i, j, shape.array(i, j, payload).T))
                yield _batch(out).rename_columns(["c", "r", "payload"])

        return self.frame().mapInArrow(run, "c int, r int, payload binary")
