"""Queries of the general training-data problems 3 and 7."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.operators.heavy_keys import heavy_keys, key_stats
from marquee.operators.packed_fields import learn_dictionary, split_packed
from marquee.session import table


def genre_values(spark: SparkSession, d: str) -> DataFrame:
    return split_packed(table(spark, d, "movies"), "movieId", "genres", out_record="movie_id", out_value="genre")


def unquoted_genres(spark: SparkSession, d: str) -> DataFrame:
    """The genres without their quotes, as if no row had ever quoted a value: (movieId, genres)."""
    bare = F.regexp_replace("genres", r"(?<!\")\"(?!\")|[“”]", "")
    return table(spark, d, "movies").select("movieId", F.regexp_replace(bare, r"\"\"", '"').alias("genres"))


def p3_guarded(spark: SparkSession, d: str) -> DataFrame:
    """Planted delimiters: quotes are taken off all genres, and the dictionary of the quoted ones is to say where values end."""
    known = learn_dictionary(table(spark, d, "movies"), "genres")
    return split_packed(unquoted_genres(spark, d), "movieId", "genres", out_record="movie_id", out_value="genre", guard=True, dictionary=known)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return genre_values(spark, d)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return heavy_keys(table(spark, d, "ratings"), ["movieId", "userId"], "rating", "timestamp").select("key_field", "key_value")


def p7_key_stats(spark: SparkSession, d: str) -> DataFrame:
    stats = key_stats(table(spark, d, "ratings"), ["movieId", "userId"], "rating", "timestamp")
    return stats.withColumn("mean_value", F.round("mean_value", 6))


QUERIES = {"p3_found": p3_found, "p3_guarded": p3_guarded, "p7_found": p7_found, "p7_key_stats": p7_key_stats}

_LONG = "(SELECT 'movieId' AS key_field, movieId AS key_value, rating, timestamp FROM ratings UNION ALL SELECT 'userId', userId, rating, timestamp FROM ratings)"
ORACLE = {
    "p3_found": r"""
        WITH raw AS (SELECT DISTINCT movieId, genres FROM movies WHERE genres IS NOT NULL),
        tok AS (SELECT movieId, genres, unnest(regexp_extract_all(genres, '"(?:[^"]|"")*"|“[^”]*”|\([nN][oO] [gG][eE][nN][rR][eE][sS] [lL][iI][sS][tT][eE][dD]\)|[\p{L}\p{M}\p{N} \-''’&]+')) AS t,
                       generate_subscripts(regexp_extract_all(genres, '"(?:[^"]|"")*"|“[^”]*”|\([nN][oO] [gG][eE][nN][rR][eE][sS] [lL][iI][sS][tT][eE][dD]\)|[\p{L}\p{M}\p{N} \-''’&]+'), 1) AS i FROM raw),
        val AS (SELECT movieId, genres, i, regexp_replace(CASE WHEN t LIKE '"%' THEN replace(t[2:-2], '""', '"') WHEN t LIKE '“%' THEN t[2:-2] ELSE t END, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS v FROM tok WHERE t NOT LIKE '(%')
        SELECT DISTINCT movieId AS movie_id, row_number() OVER (PARTITION BY movieId, genres ORDER BY i) AS pos, v AS genre FROM val WHERE v <> ''""",
    "p7_found": f"SELECT key_field, key_value FROM {_LONG} WHERE key_value IS NOT NULL GROUP BY ALL HAVING count(*) * 100 > (SELECT count(*) FROM ratings)",
    "p7_key_stats": f"""SELECT key_field, key_value, count(*) AS n_rows, round(avg(rating) FILTER (NOT isnan(rating)), 6) AS mean_value,
        min(timestamp) AS first_at, max(timestamp) AS last_at FROM {_LONG} WHERE key_value IS NOT NULL GROUP BY key_field, key_value""",
}
