"""Structured Streaming over the events table: an extension, labelled as such; the batch operators don't need it.

Streams read the table's files, watermark on event time and write Parquet exactly once from a checkpoint in the shared
folder. With the availableNow trigger a stream ends when its files are read, so results can be compared with batch SQL.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from marquee.session import scratch

SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str, delay: str = "10 minutes", files: int = 1000) -> DataFrame:
    """The table as a stream; ts as a timestamp (a watermark can't stand on one without zone)."""
    raw = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).parquet(path + "*")
    return raw.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


def run_to_table(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run until the files are read; the result as a table."""
    spark = stream.sparkSession
    path, state = scratch(spark, "stream"), scratch(spark, "stream-state")
    query = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).start(path)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def tumbling(stream: DataFrame, width: str = "1 hour") -> DataFrame:
    """Events and sum of values per type and window."""
    return _counted(stream, F.window("ts", width))


def sliding(stream: DataFrame, width: str = "2 hours", step: str = "1 hour") -> DataFrame:
    return _counted(stream, F.window("ts", width, step))


def _counted(stream: DataFrame, window) -> DataFrame:
    agg = stream.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"))
    return agg.select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(stream: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Events per user and session, a session ending with a gap."""
    agg = stream.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return agg.select(F.col("w.start").alias("start"), "user_id", "n")


def deduplicated(stream: DataFrame) -> DataFrame:
    """Replayed events once, as far as the watermark remembers."""
    return stream.dropDuplicatesWithinWatermark(["event_id"])


def _consensus(size: int):
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = {i: set(u) for i, u in zip(*state.get)} if state.exists else {}
        out = []
        for batch in batches:
            for item, user, liked in zip(batch.item_id, batch.user_id, batch.liked):
                voters = seen.setdefault(int(item), set())
                if liked and len(voters) < size:
                    voters.add(int(user))
                    if len(voters) == size:
                        out.append((int(key[0]), int(item)))
        state.update((list(seen), [sorted(v) for v in seen.values()]))
        yield pd.DataFrame(out, columns=["group_id", "item_id"]).astype("int64")

    return step


def live_consensus(votes: DataFrame, size: int = 3) -> DataFrame:
    """CON12 on a stream of (group_id, user_id, item_id, liked): an item once, when `size` members like it.

    State is keyed by group: the likers of its items, at most `size` each.
    """
    return votes.groupBy("group_id").applyInPandasWithState(_consensus(size), "group_id bigint, item_id bigint", "items array<bigint>, likers array<array<bigint>>", "append", GroupStateTimeout.NoTimeout)
