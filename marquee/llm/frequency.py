"""Problem 5: occurrences and records of every distinct term.

External sort: (term, record) pairs are range-partitioned with sampled quantiles and sorted within partitions; one scan of
the runs counts each term's occurrences (rows) and distinct records (runs). A low-order salt ends the sort key, so even a
single pair that holds a third of all rows is spread; the first and last run of each partition, the only ones that may go
on elsewhere, come out by themselves and are stitched by (term, record).

Defined cases: rows with a null term or record are no pairs; terms are compared as written, case included; empty tables give
no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.session import ship


def _codes(column: pa.Array) -> np.ndarray:
    return np.asarray(column.dictionary_encode().indices) if pa.types.is_string(column.type) else np.asarray(column)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of sorted (term, record) pairs to (term, record of an edge run or null, occurrences, records)."""
    open_run = None  # [term, record, occurrences, whether it is the partition's first]
    kinds = None

    def rows(terms, records, occurrences, counts):
        return pa.RecordBatch.from_arrays([terms, records, pa.array(occurrences, pa.int64()), pa.array(counts, pa.int64())], ["term", "record", "occurrences", "records"])

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        kinds = (batch.column(0).type, batch.column(1).type)
        t, r = _codes(batch.column(0)), _codes(batch.column(1))
        starts = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (r[1:] != r[:-1])]))
        lengths = np.diff(np.append(starts, n))
        # The first run may continue the open one.
        first = (batch.column(0)[0].as_py(), batch.column(1)[0].as_py())
        closed = None
        if open_run and first == (open_run[0], open_run[1]):
            lengths[0] += open_run[2]
            is_first = open_run[3]
        else:
            closed, is_first = open_run, open_run is None
        if closed:
            yield rows(pa.array([closed[0]], kinds[0]), pa.array([closed[1] if closed[3] else None], kinds[1]), [closed[2]], [1])
        last = int(starts[-1])
        if len(starts) > 1:
            if is_first:
                yield rows(pa.array([first[0]], kinds[0]), pa.array([first[1]], kinds[1]), [int(lengths[0])], [1])
            inner = slice(1 if is_first else 0, -1)
            at, size = starts[inner], lengths[inner]
            if len(at):
                heads = np.flatnonzero(np.concatenate([[True], t[at[1:]] != t[at[:-1]]]))
                yield rows(batch.column(0).take(pa.array(at[heads])), pa.nulls(len(heads), kinds[1]), np.add.reduceat(size, heads), np.diff(np.append(heads, len(at))))
            is_first = False
        open_run = [batch.column(0)[last].as_py(), batch.column(1)[last].as_py(), int(lengths[-1]), is_first]
    if open_run:
        yield rows(pa.array([open_run[0]], kinds[0]), pa.array([open_run[1]], kinds[1]), [open_run[2]], [1])


def term_frequencies(df: DataFrame, term: str | Column, record: str | Column) -> DataFrame:
    """(term, occurrences, records) of every distinct term."""
    ship(df.sparkSession)
    as_column = lambda c: F.col(c) if isinstance(c, str) else c
    pairs = df.select(as_column(term).alias("term"), as_column(record).alias("record")).where("term is not null and record is not null")
    kinds = [f.dataType.simpleString() for f in pairs.schema.fields]
    salted = pairs.withColumn("salt", (F.monotonically_increasing_id() % 1024).cast("smallint"))
    ordered = salted.repartitionByRange("term", "record", "salt").sortWithinPartitions("term", "record").select("term", "record")
    runs = ordered.mapInArrow(_scan, f"term {kinds[0]}, record {kinds[1]}, occurrences bigint, records bigint")
    # Inner runs carry no record; edge runs of one pair are one record.
    stitched = runs.groupBy("term", "record").agg(F.sum("occurrences").alias("occurrences"), F.when(F.col("record").isNull(), F.sum("records")).otherwise(1).alias("records"))
    return stitched.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def marked(frequencies: DataFrame, records: DataFrame | int, rare: int, common_percent: int) -> DataFrame:
    """Adds mark: 'rare' below `rare` records, 'common' above `common_percent` per cent of all records, else null.

    records: their number, or a one-row frame with it in column n_records.
    """
    with_total = frequencies.withColumn("n_records", F.lit(records)) if isinstance(records, int) else frequencies.crossJoin(F.broadcast(records))
    mark = F.when(F.col("records") < rare, "rare").when(F.col("records") * 100 > F.col("n_records") * common_percent, "common")
    return with_total.withColumn("mark", mark).drop("n_records")
