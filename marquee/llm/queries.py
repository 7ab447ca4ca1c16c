"""Queries of the problems tagged llm, with SQL where SQL can express them on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.llm.frequency import marked, term_frequencies
from marquee.llm.matching import match_entities
from marquee.llm.mixing import mix
from marquee.llm.pair_table import PairTable
from marquee.llm.similar_sets import expand, similar_sets
from marquee.llm.splitting import oversized, split_texts
from marquee.llm.tokenize import token_ids
from marquee.llm.topn import top_items
from marquee.plans.training_queries import ORACLE as CORE_SQL
from marquee.plans.training_queries import genre_values
from marquee.session import table


def _pair_table(spark: SparkSession, d: str) -> PairTable:
    ratings = table(spark, d, "ratings")
    made = PairTable.create(spark, buckets=max(12, ratings.count() // 100_000), most_kept=14)
    return made.update(ratings, basket="userId", item="movieId")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    found = _pair_table(spark, d).scores(15, 5)
    return found.select(F.col("a").alias("movie_id_a"), F.col("b").alias("movie_id_b"))


def p1_scores(spark: SparkSession, d: str) -> DataFrame:
    found = _pair_table(spark, d).scores(15, 5)
    return found.select(F.col("a").alias("movie_id_a"), F.col("b").alias("movie_id_b"), "n_ab", "n_a", "n_b", "baskets", F.round("lift", 6).alias("lift"))


def p1_changed(spark: SparkSession, d: str) -> DataFrame:
    """All pairs are loaded; then the baskets with an invalid rating change to their valid ones, which takes pairs away."""
    ratings = table(spark, d, "ratings")
    valid = F.coalesce(F.col("rating").between(0.5, 5) & ~F.isnan("rating"), F.lit(False))
    changed = ratings.where(~valid & F.col("userId").isNotNull()).select("userId").distinct()
    before = ratings.join(changed, "userId", "left_semi")
    loaded = _pair_table(spark, d).update(before.where(valid), before, basket="userId", item="movieId")
    return loaded.scores(15, 5).select(F.col("a").alias("movie_id_a"), F.col("b").alias("movie_id_b"), "n_ab", "baskets")


def p2_similarities(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of different sets, by the least user of each, with their overlap."""
    pairs, _ = similar_sets(table(spark, d, "ratings"), "userId", "movieId")
    share = F.round(F.col("common") / (F.col("size_a") + F.col("size_b") - F.col("common")), 6)
    return pairs.select(F.col("a").alias("user_id_a"), F.col("b").alias("user_id_b"), "common", share.alias("similarity"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    pairs, members = similar_sets(table(spark, d, "ratings"), "userId", "movieId")
    return expand(pairs, members, "userId").select(F.col("id_a").alias("user_id_a"), F.col("id_b").alias("user_id_b"))


def p4_matches(spark: SparkSession, d: str) -> DataFrame:
    proposals = table(spark, d, "repaired_filtered")
    return match_entities(proposals, left_id="movieId", left_title="movielens_title", right_id="new_tmdb_id", right_title="matched_title", right_date="release_date", hint="title_similarity")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_matches(spark, d).select(F.col("movieId").alias("movie_id"), "new_tmdb_id")


def _frequencies(spark: SparkSession, d: str) -> DataFrame:
    genres = genre_values(spark, d).withColumn("genre", F.lower("genre"))
    with_value = genres.agg(F.count_distinct("movie_id").alias("n_records"))
    by_genre = marked(term_frequencies(genres, "genre", "movie_id"), with_value, 3, 25).withColumn("field_name", F.lit("genres"))
    pairs = table(spark, d, "ratings").select("movieId", "userId").where("movieId is not null and userId is not null")
    users = pairs.select("userId").distinct().agg(F.count("*").alias("n_records"))
    by_movie = marked(term_frequencies(pairs, "movieId", "userId"), users, 3, 10).withColumn("field_name", F.lit("movieId"))
    return by_genre.unionByName(by_movie.withColumn("term", F.col("term").cast("string")))


def p5_counts(spark: SparkSession, d: str) -> DataFrame:
    return _frequencies(spark, d).select("field_name", "term", "occurrences", "records", "mark")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _frequencies(spark, d).where("mark is not null").select("field_name", "term", "mark")


def p6_scores(spark: SparkSession, d: str) -> DataFrame:
    top = top_items(table(spark, d, "ratings"), "userId", "movieId", "rating", "timestamp", 3)
    return top.select(F.col("group_id").alias("user_id"), "place", F.col("item_id").alias("movie_id"), F.col("score").alias("rating"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    top = top_items(table(spark, d, "ratings"), "userId", "movieId", "rating", "timestamp", 3)
    return top.select(F.col("group_id").alias("user_id"), "place", F.col("item_id").alias("movie_id"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return token_ids(table(spark, d, "documents"), "doc_id", "text")


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return oversized(split_texts(table(spark, d, "documents"), "doc_id", "text"), "doc_id")


def p10_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split_texts(table(spark, d, "documents"), "doc_id", "text")


QUERIES = {"p1_found": p1_found, "p1_scores": p1_scores, "p1_changed": p1_changed, "p2_found": p2_found, "p2_similarities": p2_similarities, "p4_found": p4_found, "p4_matches": p4_matches, "p5_found": p5_found, "p5_counts": p5_counts, "p6_found": p6_found, "p6_scores": p6_scores, "p8_ids": p8_ids, "p9_mix": p9_mix, "p9_shares": p9_shares, "p10_found": p10_found, "p10_pieces": p10_pieces}

_PAIRS = "(SELECT DISTINCT userId AS u, movieId AS m FROM ratings WHERE userId IS NOT NULL AND movieId IS NOT NULL)"
_VALID = "(SELECT DISTINCT userId AS u, movieId AS m FROM ratings WHERE userId IS NOT NULL AND movieId IS NOT NULL AND rating BETWEEN 0.5 AND 5 AND NOT isnan(rating))"
# Baskets without an invalid rating keep all their pairs; so do the others theirs, but for items rated invalidly only.
_PAIRS_LEFT = f"(SELECT * FROM {_PAIRS} p WHERE u NOT IN (SELECT userId FROM ratings WHERE userId IS NOT NULL AND coalesce(rating NOT BETWEEN 0.5 AND 5 OR isnan(rating), true)) UNION SELECT * FROM {_VALID})"


def _cooccurrence(pairs: str, columns: str) -> str:
    return f"""
        WITH p AS {pairs}, n AS (SELECT m, count(*) AS c FROM p GROUP BY m), total AS (SELECT count(DISTINCT u) AS t FROM p),
        ab AS (SELECT a.m AS a, b.m AS b, count(*) AS c FROM p a JOIN p b ON a.u = b.u AND a.m < b.m GROUP BY 1, 2 HAVING count(*) >= 15)
        SELECT ab.a AS movie_id_a, ab.b AS movie_id_b, {columns} FROM ab JOIN n x ON x.m = ab.a JOIN n y ON y.m = ab.b, total WHERE ab.c * t >= 5 * x.c * y.c"""


ORACLE = {
    "p1_scores": _cooccurrence(_PAIRS, "ab.c AS n_ab, x.c AS n_a, y.c AS n_b, t AS baskets, round(ab.c * t / (x.c * y.c), 6) AS lift"),
    "p1_changed": _cooccurrence(_PAIRS_LEFT, "ab.c AS n_ab, t AS baskets"),
    "p2_similarities": f"""
        WITH p AS {_PAIRS}, s AS (SELECT u, count(*) AS c, list(m ORDER BY m) AS items FROM p GROUP BY u HAVING count(*) >= 8), k AS (SELECT items, min(u) AS u, max(c) AS c FROM s GROUP BY items), q AS (SELECT p.* FROM p JOIN k USING (u)),
        ab AS (SELECT a.u AS a, b.u AS b, count(*) AS c FROM q a JOIN q b ON a.m = b.m AND a.u < b.u GROUP BY 1, 2)
        SELECT ab.a AS user_id_a, ab.b AS user_id_b, ab.c AS common, round(ab.c / (x.c + y.c - ab.c), 6) AS similarity FROM ab JOIN k x ON x.u = ab.a JOIN k y ON y.u = ab.b WHERE 10 * ab.c >= 7 * (x.c + y.c - ab.c)""",
    "p5_counts": f"""
        WITH v AS (SELECT movie_id, lower(genre) AS term FROM ({CORE_SQL["p3_found"]})),
        g AS (SELECT term, count(*) AS o, count(DISTINCT movie_id) AS r, (SELECT count(DISTINCT movie_id) FROM v) AS t FROM v GROUP BY term),
        k AS (SELECT movieId AS m, count(*) AS o, count(DISTINCT userId) AS r, (SELECT count(DISTINCT u) FROM {_PAIRS}) AS t FROM ratings WHERE movieId IS NOT NULL AND userId IS NOT NULL GROUP BY 1)
        SELECT 'genres' AS field_name, term, o AS occurrences, r AS records, CASE WHEN r < 3 THEN 'rare' WHEN r * 100 > t * 25 THEN 'common' END AS mark FROM g
        UNION ALL SELECT 'movieId', CAST(m AS VARCHAR), o, r, CASE WHEN r < 3 THEN 'rare' WHEN r * 100 > t * 10 THEN 'common' END FROM k""",
    "p6_scores": """
        WITH v AS (SELECT userId AS u, movieId AS m, rating AS r, timestamp AS t FROM ratings WHERE userId IS NOT NULL AND movieId IS NOT NULL AND rating BETWEEN 0.5 AND 5 AND NOT isnan(rating)),
        k AS (SELECT *, row_number() OVER (PARTITION BY u, m ORDER BY t DESC NULLS LAST, r DESC) AS i FROM v)
        SELECT u AS user_id, place, m AS movie_id, r AS rating FROM (SELECT u, m, r, row_number() OVER (PARTITION BY u ORDER BY r DESC, t DESC NULLS LAST, m) AS place FROM k WHERE i = 1) WHERE place <= 3""",
    "p1_found": f"""
        WITH p AS {_PAIRS}, n AS (SELECT m, count(*) AS c FROM p GROUP BY m), total AS (SELECT count(DISTINCT u) AS t FROM p),
        ab AS (SELECT a.m AS a, b.m AS b, count(*) AS c FROM p a JOIN p b ON a.u = b.u AND a.m < b.m GROUP BY 1, 2 HAVING count(*) >= 15)
        SELECT ab.a AS movie_id_a, ab.b AS movie_id_b FROM ab JOIN n x ON x.m = ab.a JOIN n y ON y.m = ab.b, total WHERE ab.c * t >= 5 * x.c * y.c""",
    "p2_found": f"""
        WITH p AS {_PAIRS}, s AS (SELECT u, count(*) AS c FROM p GROUP BY u HAVING count(*) >= 8), q AS (SELECT p.* FROM p JOIN s USING (u)),
        ab AS (SELECT a.u AS a, b.u AS b, count(*) AS c FROM q a JOIN q b ON a.m = b.m AND a.u < b.u GROUP BY 1, 2)
        SELECT ab.a AS user_id_a, ab.b AS user_id_b FROM ab JOIN s x ON x.u = ab.a JOIN s y ON y.u = ab.b WHERE 10 * ab.c >= 7 * (x.c + y.c - ab.c)""",
    "p5_found": f"""
        WITH v AS (SELECT movie_id, lower(genre) AS term FROM ({CORE_SQL["p3_found"]})),
        g AS (SELECT term, count(DISTINCT movie_id) AS r, (SELECT count(DISTINCT movie_id) FROM v) AS t FROM v GROUP BY term),
        p AS {_PAIRS}, k AS (SELECT m, count(*) AS r, (SELECT count(DISTINCT u) FROM p) AS t FROM p GROUP BY m)
        SELECT 'genres' AS field_name, term, CASE WHEN r < 3 THEN 'rare' ELSE 'common' END AS mark FROM g WHERE r < 3 OR r * 100 > t * 25
        UNION ALL SELECT 'movieId', CAST(m AS VARCHAR), CASE WHEN r < 3 THEN 'rare' ELSE 'common' END FROM k WHERE r < 3 OR r * 100 > t * 10""",
    "p6_found": """
        WITH v AS (SELECT userId AS u, movieId AS m, rating AS r, timestamp AS t FROM ratings WHERE userId IS NOT NULL AND movieId IS NOT NULL AND rating BETWEEN 0.5 AND 5 AND NOT isnan(rating)),
        k AS (SELECT *, row_number() OVER (PARTITION BY u, m ORDER BY t DESC NULLS LAST, r DESC) AS i FROM v)
        SELECT u AS user_id, place, m AS movie_id FROM (SELECT u, m, row_number() OVER (PARTITION BY u ORDER BY r DESC, t DESC NULLS LAST, m) AS place FROM k WHERE i = 1) WHERE place <= 3""",
}
