"""Queries of the streaming extension."""

from __future__ import annotations

from pyspark.sql import functions as F

from marquee.plans.registry import Book
from marquee.streaming import events as S

book = Book()
add = book.add
_LATE = "(SELECT max(ts) - INTERVAL 10 MINUTE AS mark FROM events)"


def stream(s, d):
    return S.event_stream(s, f"{d}/events.parquet")


@add("stream_tumbling", f"SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events, {_LATE} GROUP BY 1, 2, mark HAVING time_bucket(INTERVAL 1 HOUR, min(ts)) + INTERVAL 1 HOUR <= mark")
def _(s, d):
    return S.run_to_table(S.tumbling(stream(s, d)))


@add("stream_sliding", f"WITH e AS (SELECT unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS start, event_type FROM events) SELECT start, event_type, count(*) AS n FROM e, {_LATE} WHERE start + INTERVAL 2 HOUR <= mark GROUP BY 1, 2")
def _(s, d):
    return S.run_to_table(S.sliding(stream(s, d)))


@add("stream_sessions", f"""WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS fresh FROM events),
    k AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT min(ts) AS start, user_id, count(*) AS n FROM k, {_LATE} GROUP BY user_id, k, mark HAVING max(ts) + INTERVAL 30 MINUTE <= mark""")
def _(s, d):
    return S.run_to_table(S.sessions(stream(s, d)))


@add("stream_deduplicated", "SELECT DISTINCT event_id, user_id FROM events")
def _(s, d):
    return S.run_to_table(S.deduplicated(stream(s, d))).select("event_id", "user_id")


@add("stream_live_consensus", "SELECT CAST(user_id % 40 AS BIGINT) AS group_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS item_id FROM events WHERE value >= 20 AND json_extract_string(props, '$.k') IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT user_id) >= 3")
def _(s, d):
    item = F.get_json_object("props", "$.k").cast("bigint")
    votes = stream(s, d).select((F.col("user_id") % 40).alias("group_id"), "user_id", item.alias("item_id"), (F.col("value") >= 20).alias("liked")).where("item_id is not null")
    return S.run_to_table(S.live_consensus(votes))


QUERIES, ORACLE = book.queries, book.sql
