"""Queries of filters, projections, joins, aggregations, windows and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marquee.operators import aggregates as A
from marquee.operators import filters as L
from marquee.operators import matrix as M
from marquee.operators.models import recommend_unseen
from marquee.operators.ranking import unseen_summary
from marquee.plans.registry import Book
from marquee.session import table
from marquee.sources import views as V
from marquee.sources.views import GENRES, GROUPS, ITEMS, RATINGS, REVIEWS, VOTES

book = Book()
add = book.add
R, I, G = V.ratings, V.items, V.genres
N_USER = f"(SELECT user_id, count(*) AS n FROM {RATINGS} GROUP BY user_id)"
N_ITEM = f"(SELECT item_id, count(*) AS n FROM {RATINGS} GROUP BY item_id)"


def r6(c):
    return F.round(c, 6)


# Filters

@add("flt1_min_user_ratings", f"SELECT user_id, item_id, rating FROM {RATINGS} r WHERE user_id IN (SELECT user_id FROM {N_USER} WHERE n >= 20)")
def _(s, d):
    return L.at_least(R(s, d), "user_id", 20).select("user_id", "item_id", "rating")


@add("flt2_more_than_user_ratings", f"SELECT user_id, item_id, rating FROM {RATINGS} r WHERE user_id IN (SELECT user_id FROM {N_USER} WHERE n > 20)")
def _(s, d):
    return L.at_least(R(s, d), "user_id", 20, strict=True).select("user_id", "item_id", "rating")


@add("flt3_interaction_thresholds", f"""WITH r AS {RATINGS} SELECT user_id, item_id, rating FROM r WHERE user_id IN (SELECT user_id FROM r WHERE rating >= 4 GROUP BY user_id HAVING count(*) >= 5)
    AND item_id IN (SELECT item_id FROM r WHERE rating >= 4 GROUP BY item_id HAVING count(*) >= 10)""")
def _(s, d):
    return L.interaction_thresholds(R(s, d), 5, 10).select("user_id", "item_id", "rating")


def _kcore_sql(rounds: int = 5) -> str:
    steps = [f"r0 AS (SELECT user_id, item_id, rating FROM {RATINGS})"]
    for i in range(rounds):
        steps.append(f"u{i} AS (SELECT * FROM r{i} WHERE user_id IN (SELECT user_id FROM r{i} GROUP BY user_id HAVING count(*) >= 15))")
        steps.append(f"r{i + 1} AS MATERIALIZED (SELECT * FROM u{i} WHERE item_id IN (SELECT item_id FROM u{i} GROUP BY item_id HAVING count(*) >= 25))")
    return "WITH " + ", ".join(steps) + f" SELECT * FROM r{rounds}"


@add("flt4_k_core", _kcore_sql())
def _(s, d):
    return L.k_core(R(s, d).select("user_id", "item_id", "rating"), 15, 25)


@add("flt5_top_percent", f"SELECT item_id, n FROM (SELECT item_id, n, row_number() OVER (ORDER BY n DESC, item_id) AS i, count(*) OVER () AS t FROM {N_ITEM}) WHERE i <= floor(t * 40 / 100)")
def _(s, d):
    return L.top_percent(R(s, d), "item_id", 40)


@add("flt6_allow_list", r"SELECT movieId AS movie_id, title FROM movies WHERE movieId IN (SELECT TRY_CAST(movieId AS BIGINT) FROM links WHERE regexp_full_match(trim(tmdbId), '[0-9]+'))")
def _(s, d):
    ids = table(s, d, "links").where(F.trim("tmdbId").rlike("^[0-9]+$")).select(F.expr("try_cast(movieId as bigint)").alias("movieId"))
    return table(s, d, "movies").join(ids, "movieId", "left_semi").select(F.col("movieId").alias("movie_id"), "title")


@add("flt7_drop_empty_ids", """SELECT movieId AS movie_id, tmdb, imdb FROM (SELECT movieId, trim(tmdbId) AS tmdb, trim(imdbId) AS imdb, row_number() OVER (PARTITION BY trim(tmdbId) ORDER BY TRY_CAST(movieId AS BIGINT), trim(imdbId) NULLS LAST) AS i
    FROM links WHERE trim(coalesce(tmdbId, '')) <> '') WHERE i = 1""")
def _(s, d):
    rows = table(s, d, "links").where(L.not_blank("tmdbId")).select(F.col("movieId").alias("movie_id"), F.trim("tmdbId").alias("tmdb"), F.trim("imdbId").alias("imdb"))
    return L.first_of(rows, ["tmdb"], [F.expr("try_cast(movie_id as bigint)"), F.asc_nulls_last("imdb")])


@add("flt9_real_ratings", "SELECT userId AS user_id, movieId AS movie_id, rating FROM ratings WHERE rating IS NOT NULL AND rating <> 0 AND NOT isnan(rating)")
def _(s, d):
    return table(s, d, "ratings").where("rating is not null and rating <> 0 and not isnan(rating)").select(F.col("userId").alias("user_id"), F.col("movieId").alias("movie_id"), "rating")


@add("flt10_places_with_reviews", f"SELECT s_suppkey AS id, count(*) AS n_reviews FROM supplier JOIN {REVIEWS} r ON r.id = s_suppkey GROUP BY 1")
def _(s, d):
    return V.places(s, d).where("size(reviews) > 0").select("id", F.size("reviews").cast("bigint").alias("n_reviews"))


@add("flt11_users_by_count", f"SELECT n, count(*) AS n_users FROM {N_USER} WHERE n = 8 OR n >= 100 GROUP BY n")
def _(s, d):
    sizes = R(s, d).groupBy("user_id").agg(F.count("*").alias("n"))
    return sizes.where("n = 8 or n >= 100").groupBy("n").agg(F.count("*").alias("n_users"))


@add("flt12_top_types", f"SELECT genre, n FROM (SELECT genre, count(*) AS n FROM {GENRES} WHERE genre NOT IN ('drama', 'comedy') GROUP BY genre) ORDER BY n DESC, genre LIMIT 10")
def _(s, d):
    return G(s, d).where(~F.col("genre").isin("drama", "comedy")).groupBy("genre").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "genre").limit(10)


@add("flt14_rated_with_genre", f"SELECT item_id, len(genres) AS n_genres FROM {ITEMS} WHERE len(genres) > 0 AND item_id IN (SELECT item_id FROM {RATINGS})")
def _(s, d):
    return I(s, d).where("size(genres) > 0").join(R(s, d), "item_id", "left_semi").select("item_id", F.size("genres").cast("bigint").alias("n_genres"))


@add("flt15_held_out_removed", f"SELECT user_id, item_id, rating FROM {RATINGS} WHERE NOT (rating >= 4 AND (user_id * 31 + item_id) % 5 = 0)")
def _(s, d):
    rated = R(s, d).select("user_id", "item_id", "rating")
    held = rated.where("rating >= 4 and (user_id * 31 + item_id) % 5 = 0")
    return rated.join(held, ["user_id", "item_id"], "left_anti")


@add("flt16_positive_votes", f"SELECT group_id, user_id, item_id FROM {VOTES} WHERE vote = 1")
def _(s, d):
    return V.votes(R(s, d)).where("vote = 1").select("group_id", "user_id", "item_id")


@add("flt17_numeric_rows", "SELECT movieId AS movie_id, TRY_CAST(tmdbId AS DOUBLE) AS tmdb FROM links WHERE TRY_CAST(tmdbId AS DOUBLE) IS NOT NULL")
def _(s, d):
    return table(s, d, "links").select(F.col("movieId").alias("movie_id"), F.expr("try_cast(tmdbId as double)").alias("tmdb")).where("tmdb is not null")


@add("flt18_users_with_two", f"SELECT user_id, n FROM {N_USER} WHERE n >= 2")
def _(s, d):
    return R(s, d).groupBy("user_id").agg(F.count("*").alias("n")).where("n >= 2")


@add("flt19_sweep_points", f"SELECT t, sum(n) AS n_ratings FROM {N_USER}, (SELECT unnest([2, 10, 50, 100, 200, 400]) AS t) WHERE n > t GROUP BY t HAVING sum(n) >= 30")
def _(s, d):
    return A.threshold_sweep(R(s, d), [2, 10, 50, 100, 200, 400]).where("n_ratings >= 30").select("t", "n_ratings")


# Projections

@add("prj1_index_remap", f"SELECT r.user_id, k.idx FROM {RATINGS} r JOIN (SELECT item_id, dense_rank() OVER (ORDER BY item_id) - 1 AS idx FROM {N_ITEM}) k USING (item_id)")
def _(s, d):
    from marquee.sources.readers import dense_index

    rated = R(s, d)
    return rated.join(dense_index(rated, "item_id", "idx"), "item_id").select("user_id", "idx")


@add("prj2_binarise", f"SELECT item_id, sum(CASE WHEN rating >= 3.5 THEN 1 ELSE 0 END) AS n_positive FROM {RATINGS} GROUP BY 1")
def _(s, d):
    return R(s, d).groupBy("item_id").agg(F.sum((F.col("rating") >= 3.5).cast("bigint")).alias("n_positive"))


@add("prj3_wide_to_long", "SELECT l_orderkey, l_linenumber, name, value FROM (UNPIVOT (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS DOUBLE) AS quantity, CAST(l_discount AS DOUBLE) AS discount FROM lineitem) ON quantity, discount INTO NAME name VALUE value)")
def _(s, d):
    wide = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("quantity"), F.col("l_discount").cast("double").alias("discount"))
    return wide.unpivot(["l_orderkey", "l_linenumber"], ["quantity", "discount"], "name", "value").where("value is not null")


# Joins

@add("joi1_left_join", f"SELECT r.user_id, r.item_id, i.year FROM {RATINGS} r LEFT JOIN {ITEMS} i USING (item_id)")
def _(s, d):
    return R(s, d).join(I(s, d).select("item_id", "year"), "item_id", "left").select("user_id", "item_id", "year")


@add("joi2_semi", f"SELECT user_id, item_id FROM {RATINGS} WHERE item_id IN (SELECT item_id FROM {GENRES} WHERE genre = 'western')")
def _(s, d):
    return R(s, d).join(G(s, d).where("genre = 'western'"), "item_id", "left_semi").select("user_id", "item_id")


@add("joi3_anti", f"SELECT user_id, item_id FROM {RATINGS} r WHERE NOT EXISTS (SELECT 1 FROM movies m WHERE m.movieId = r.item_id)")
def _(s, d):
    return R(s, d).join(table(s, d, "movies").select(F.col("movieId").alias("item_id")), "item_id", "left_anti").select("user_id", "item_id")


@add("joi4_lookup", "SELECT r.new_tmdb_id, m.title FROM repaired_filtered r JOIN (SELECT movieId, min(title) AS title FROM movies GROUP BY 1) m ON m.movieId = r.movieId")
def _(s, d):
    titles = table(s, d, "movies").groupBy("movieId").agg(F.min("title").alias("title"))
    return table(s, d, "repaired_filtered").join(titles, "movieId").select("new_tmdb_id", "title")


_LINKS = "(SELECT DISTINCT movieId AS movie_id, CAST(TRY_CAST(trim(tmdbId) AS DOUBLE) AS BIGINT) AS tmdb FROM links)"
_FIX = "(SELECT old_tmdb_id, max_by(new_tmdb_id, (popularity, -new_tmdb_id)) AS new_id FROM repaired_filtered GROUP BY 1)"


def _repaired(s, d, drop_unresolved):
    from marquee.sources.links import numeric_id, resolve_ids

    links = table(s, d, "links").select(F.col("movieId").alias("movie_id"), numeric_id("tmdbId").alias("tmdb")).distinct()
    best = F.max_by("new_tmdb_id", F.struct("popularity", -F.col("new_tmdb_id"))).alias("new_id")
    fixes = table(s, d, "repaired_filtered").groupBy("old_tmdb_id").agg(best)
    return resolve_ids(links, fixes, table(s, d, "unresolved").select("old_tmdb_id"), drop_unresolved)


@add("joi5_update_ids", f"SELECT movie_id, coalesce(f.new_id, l.tmdb) AS tmdb FROM {_LINKS} l LEFT JOIN {_FIX} f ON f.old_tmdb_id = l.tmdb")
def _(s, d):
    return _repaired(s, d, False)


@add("joi5_update_ids_drop", f"SELECT movie_id, coalesce(f.new_id, l.tmdb) AS tmdb FROM {_LINKS} l LEFT JOIN {_FIX} f ON f.old_tmdb_id = l.tmdb WHERE f.new_id IS NOT NULL OR l.tmdb IS NULL OR l.tmdb NOT IN (SELECT old_tmdb_id FROM unresolved WHERE old_tmdb_id IS NOT NULL)")
def _(s, d):
    return _repaired(s, d, True)


@add("joi6_gram", f"WITH r AS {RATINGS} SELECT a.item_id AS i, b.item_id AS j, sum(a.rating * b.rating) AS g, count(*) AS n FROM r a JOIN r b ON a.user_id = b.user_id AND a.item_id <= b.item_id GROUP BY 1, 2 HAVING count(*) >= 5")
def _(s, d):
    return M.gram(R(s, d), "user_id", "item_id", "rating").where("n >= 5")


@add("joi7_gram_rows", "WITH q AS (SELECT l_suppkey, l_partkey, sum(CAST(l_quantity AS BIGINT)) AS q FROM lineitem GROUP BY 1, 2) SELECT a.l_suppkey AS i, b.l_suppkey AS j, CAST(sum(a.q * b.q) AS BIGINT) AS g, count(*) AS n FROM q a JOIN q b ON a.l_partkey = b.l_partkey AND a.l_suppkey <= b.l_suppkey GROUP BY 1, 2")
def _(s, d):
    cells = table(s, d, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.sum(F.col("l_quantity").cast("bigint")).alias("q"))
    return M.gram(cells, "l_partkey", "l_suppkey", "q")


@add("joi8_common_items", f"SELECT g.group_id, r.item_id FROM (SELECT group_id, unnest(members) AS user_id FROM {GROUPS}) g JOIN {RATINGS} r USING (user_id) GROUP BY 1, 2 HAVING count(*) = 3")
def _(s, d):
    rated = R(s, d)
    return M.common_items(V.groups(rated), rated)


_COS = "(SELECT a.vec_id AS a, b.vec_id AS b, list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)) + 1e-8) AS sim FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) a JOIN (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) b ON a.vec_id < b.vec_id)"


@add("joi9_similar_pairs", f"SELECT a, b, round(sim, 4) AS sim FROM {_COS} WHERE round(sim, 6) >= 0.26")
def _(s, d):
    return M.cosine_pairs(table(s, d, "embeddings"), "vec_id", "embedding", low=0.26).select("a", "b", F.round("sim", 4).alias("sim"))


@add("joi9_opposite_pairs", f"SELECT a, b, round(sim, 4) AS sim FROM {_COS} WHERE round(sim, 6) <= -0.12")
def _(s, d):
    return M.cosine_pairs(table(s, d, "embeddings"), "vec_id", "embedding", high=-0.12).select("a", "b", F.round("sim", 4).alias("sim"))


@add("joi10_knn", f"WITH e AS (SELECT a AS id, b AS other, round(sim, 6) AS sim FROM {_COS} UNION ALL SELECT b, a, round(sim, 6) FROM {_COS}) SELECT id, other, place FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, other) AS place FROM e) WHERE place <= 10")
def _(s, d):
    return M.cosine_neighbours(table(s, d, "embeddings"), "vec_id", "embedding", 10).select("id", "other", "place")


@add("joi11_unseen_candidates", f"WITH r AS {RATINGS} SELECT user_id, count(*) AS n_unseen, min(item_id) AS first_item FROM (SELECT u.user_id, t.item_id FROM (SELECT DISTINCT user_id FROM r) u, (SELECT DISTINCT item_id FROM r) t EXCEPT SELECT user_id, item_id FROM r) GROUP BY 1")
def _(s, d):
    return unseen_summary(R(s, d))


@add("joi12_full_outer", f"SELECT coalesce(n.item_id, i.item_id) AS item_id, coalesce(n.n, 0) AS n_ratings, coalesce(len(i.genres), 0) AS n_genres FROM {N_ITEM} n FULL JOIN {ITEMS} i ON i.item_id = n.item_id")
def _(s, d):
    counts = R(s, d).groupBy("item_id").agg(F.count("*").alias("n_ratings"))
    n_genres = I(s, d).select("item_id", F.size("genres").cast("bigint").alias("n_genres"))
    return counts.join(n_genres, "item_id", "full").na.fill(0, ["n_ratings", "n_genres"])


@add("joi14_group_key", f"SELECT a.group_id, b.group_id AS found FROM {GROUPS} a JOIN (SELECT group_id, list_reverse(members) AS members FROM {GROUPS}) b ON list_sort(a.members) = list_sort(b.members)")
def _(s, d):
    groups = V.groups(R(s, d))
    other = groups.select(F.col("group_id").alias("found"), F.array_sort(F.reverse("members")).alias("k"))
    return groups.withColumn("k", F.array_sort("members")).join(other, "k").select("group_id", "found")


# Aggregations

@add("agg1_dataset_stats", f"WITH r AS {RATINGS} SELECT count(DISTINCT user_id) AS n_users, count(DISTINCT item_id) AS n_items, count(*) AS n_ratings, round(count(*) / count(DISTINCT user_id) / count(DISTINCT item_id), 6) AS density, round(count(*) / count(DISTINCT user_id), 6) AS per_user, round(count(*) / count(DISTINCT item_id), 6) AS per_item FROM r")
def _(s, d):
    return A.dataset_stats(R(s, d)).select("n_users", "n_items", "n_ratings", *[r6(c).alias(c) for c in ("density", "per_user", "per_item")])


@add("agg2_item_stats", f"SELECT min(n) AS least, max(n) AS most, round(avg(n), 6) AS mean FROM {N_ITEM}")
def _(s, d):
    return R(s, d).groupBy("item_id").agg(F.count("*").alias("n")).agg(F.min("n").alias("least"), F.max("n").alias("most"), r6(F.avg("n")).alias("mean"))


@add("agg3_popularity_long_tail", f"SELECT item_id, n AS n_ratings, i AS rank, CASE WHEN i <= floor(t * 0.1) THEN 'head' WHEN i <= floor(t * 0.4) THEN 'middle' ELSE 'tail' END AS part FROM (SELECT item_id, n, row_number() OVER (ORDER BY n DESC, item_id) AS i, count(*) OVER () AS t FROM {N_ITEM})")
def _(s, d):
    return A.long_tail(R(s, d))


@add("agg4_genre_count_hist", f"SELECT len(list_distinct(list_transform(genres, lambda g: lower(g)))) AS n_genres, count(*) AS n FROM {ITEMS} GROUP BY 1")
def _(s, d):
    return I(s, d).groupBy(F.size(F.array_distinct(F.transform("genres", F.lower))).cast("bigint").alias("n_genres")).agg(F.count("*").alias("n"))


@add("agg5_ratings_by_year", f"SELECT year, count(*) AS n FROM {RATINGS} JOIN {ITEMS} USING (item_id) WHERE year IS NOT NULL GROUP BY 1")
def _(s, d):
    counts = R(s, d).groupBy("item_id").agg(F.count("*").alias("n"))
    return counts.join(I(s, d).where("year is not null").select("item_id", "year"), "item_id").groupBy("year").agg(F.sum("n").alias("n"))


@add("agg6_user_genre_avg", f"SELECT user_id, genre, round(avg(rating), 6) AS mean, count(*) AS n FROM {RATINGS} JOIN {GENRES} USING (item_id) GROUP BY 1, 2 HAVING count(*) >= 2")
def _(s, d):
    return R(s, d).join(G(s, d), "item_id").groupBy("user_id", "genre").agg(r6(F.avg("rating")).alias("mean"), F.count("*").alias("n")).where("n >= 2")


@add("agg7_minmax_popularity", f"WITH c AS (SELECT item_id, count(*) AS n, avg(rating) AS m FROM {RATINGS} GROUP BY 1) SELECT item_id, round((n - min(n) OVER ()) / (max(n) OVER () - min(n) OVER ()), 6) AS popularity, round(m / 5, 6) AS mean FROM c")
def _(s, d):
    c = R(s, d).groupBy("item_id").agg(F.count("*").alias("n"), F.avg("rating").alias("m"))
    span = c.agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    return c.crossJoin(F.broadcast(span)).select("item_id", r6(F.try_divide(F.col("n") - F.col("lo"), F.col("hi") - F.col("lo"))).alias("popularity"), r6(F.col("m") / 5).alias("mean"))


@add("agg8_weighted_popularity", f"""WITH c AS (SELECT n.item_id, n.n, i.year FROM {N_ITEM} n LEFT JOIN {ITEMS} i USING (item_id)), x AS (SELECT min(year) AS lo, max(year) AS hi, quantile_cont(year, 0.5) AS mid FROM c)
    SELECT item_id, n AS n_ratings, round(n * (1 + 0.5 * (coalesce(year, mid) - lo) / (hi - lo)), 6) AS popularity FROM c, x""")
def _(s, d):
    return A.weighted_popularity(R(s, d), I(s, d)).withColumn("popularity", r6("popularity"))


@add("agg9_year_quantiles", f"SELECT round(quantile_cont(year, 0.1), 4) AS q10, round(quantile_cont(year, 0.5), 4) AS q50, round(quantile_cont(year, 0.9), 4) AS q90, round(100.0 * sum(CASE WHEN year >= 1990 THEN 1 ELSE 0 END) / count(*), 4) AS pct_1990 FROM {ITEMS} WHERE year IS NOT NULL")
def _(s, d):
    q = I(s, d).where("year is not null").agg(F.expr("percentile(year, array(0.1, 0.5, 0.9))").alias("q"), F.round(100.0 * F.sum(F.expr("int(year >= 1990)")) / F.count("*"), 4).alias("pct_1990"))
    return q.select(*[F.round(F.col("q")[i], 4).alias(n) for i, n in enumerate(("q10", "q50", "q90"))], "pct_1990")


@add("agg9_year_buckets", f"SELECT CAST(floor(year / 20) * 20 AS BIGINT) AS bucket, count(*) AS n FROM {ITEMS} WHERE year IS NOT NULL GROUP BY 1")
def _(s, d):
    return I(s, d).where("year is not null").groupBy((F.floor(F.col("year") / 20) * 20).alias("bucket")).agg(F.count("*").alias("n"))


@add("agg10_genre_entropy", f"WITH c AS (SELECT genre, count(*) AS n FROM {GENRES} GROUP BY 1), p AS (SELECT n / sum(n) OVER () AS p, count(*) OVER () AS k FROM c) SELECT round(-sum(p * log2(p)), 4) AS entropy, round(-sum(p * log2(p)) / log2(max(k)), 4) AS normalised FROM p")
def _(s, d):
    return A.genre_entropy(G(s, d)).select(F.round("entropy", 4).alias("entropy"), F.round("normalised", 4).alias("normalised"))


@add("agg11_genre_coverage", f"SELECT user_id, round(count(DISTINCT genre) / (SELECT count(DISTINCT genre) FROM {GENRES}), 4) AS coverage FROM {RATINGS} JOIN {GENRES} USING (item_id) GROUP BY 1")
def _(s, d):
    g = G(s, d)
    per_user = R(s, d).join(g, "item_id").select("user_id", "genre").distinct().groupBy("user_id").agg(F.count("*").alias("n"))
    return per_user.crossJoin(F.broadcast(g.select("genre").distinct().agg(F.count("*").alias("t")))).select("user_id", F.round(F.col("n") / F.col("t"), 4).alias("coverage"))


@add("agg12_sample_coverage", f"WITH r AS {RATINGS}, top AS (SELECT item_id FROM {N_ITEM} ORDER BY n DESC, item_id LIMIT 100) SELECT count(*) AS n_ratings, round(count(DISTINCT user_id) / (SELECT count(DISTINCT user_id) FROM r), 6) AS user_coverage, round(count(*) / 100 / (SELECT count(DISTINCT user_id) FROM r), 6) AS density FROM r WHERE item_id IN (SELECT item_id FROM top)")
def _(s, d):
    rated = R(s, d)
    top = rated.groupBy("item_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "item_id").limit(100)
    users = rated.groupBy("user_id").agg(F.count("*").alias("x")).agg(F.count("*").alias("t"))
    hits = rated.join(F.broadcast(top), "item_id", "left_semi").groupBy("user_id").agg(F.count("*").alias("n")).agg(F.sum("n").alias("n_ratings"), F.count("*").alias("u"))
    return hits.crossJoin(users).select("n_ratings", r6(F.col("u") / F.col("t")).alias("user_coverage"), r6(F.col("n_ratings") / 100 / F.col("t")).alias("density"))


@add("agg13_coverage_by_activity", f"WITH m AS (SELECT r.item_id, max(n.n) AS n FROM {RATINGS} r JOIN {N_USER} n USING (user_id) GROUP BY 1) SELECT t, count(*) AS n_items FROM m, (SELECT unnest(range(1, 32)) AS t) WHERE m.n >= t GROUP BY t")
def _(s, d):
    return A.threshold_sweep(R(s, d), list(range(0, 31))).select((F.col("t") + 1).cast("bigint").alias("t"), "n_items").where("n_items > 0")


@add("agg14_density_sweep", f"WITH r AS (SELECT r.user_id, r.item_id, n.n FROM {RATINGS} r JOIN {N_USER} n USING (user_id)) SELECT t, count(DISTINCT user_id) AS n_users, count(*) AS n_ratings, count(DISTINCT item_id) AS n_items, round(count(*) / (count(DISTINCT user_id) * count(DISTINCT item_id)), 6) AS density FROM r, (SELECT unnest(range(0, 31)) AS t) WHERE r.n > t GROUP BY t")
def _(s, d):
    return A.threshold_sweep(R(s, d), list(range(0, 31))).select(F.col("t").cast("bigint").alias("t"), "n_users", "n_ratings", "n_items", r6("density").alias("density"))


@add("agg15_overlap_pairs", f"WITH r AS (SELECT r.user_id, r.item_id FROM {RATINGS} r JOIN {N_USER} n USING (user_id) WHERE n.n > 20) SELECT 2 * count(*) AS n_pairs FROM (SELECT a.item_id, b.item_id AS j FROM r a JOIN r b ON a.user_id = b.user_id AND a.item_id < b.item_id GROUP BY 1, 2 HAVING count(*) > 1)")
def _(s, d):
    active = L.at_least(R(s, d), "user_id", 20, strict=True)
    return M.gram(active, "user_id", "item_id", "rating").where("i < j and n > 1").agg((F.count("*") * 2).alias("n_pairs"))


@add("agg16_overflow_hist", f"WITH b AS (SELECT least(n, 30) AS k, count(*) AS n FROM {N_USER} GROUP BY 1), p AS (SELECT k, n, round(100.0 * n / sum(n) OVER (), 2) AS p, max(k) OVER () AS last FROM b) SELECT k, n, CASE WHEN k = last THEN round(100.0 - (SELECT coalesce(sum(p), 0) FROM p WHERE k < last), 2) ELSE p END AS pct FROM p")
def _(s, d):
    return A.overflow_histogram(R(s, d).groupBy("user_id").agg(F.count("*").alias("c")), "c", 30)


@add("agg17_missing_categories", f"SELECT DISTINCT genre FROM {GENRES} WHERE genre NOT IN (SELECT genre FROM {GENRES} JOIN {RATINGS} USING (item_id) WHERE rating >= 4.5)")
def _(s, d):
    g = G(s, d)
    liked = g.join(R(s, d).where("rating >= 4.5"), "item_id", "left_semi")
    return g.select("genre").distinct().join(liked, "genre", "left_anti")


@add("agg18_type_frequency", f"SELECT genre, count(*) AS n FROM {GENRES} GROUP BY 1")
def _(s, d):
    return G(s, d).groupBy("genre").agg(F.count("*").alias("n"))


@add("agg19_neighbour_counts", "WITH q AS (SELECT DISTINCT l_suppkey AS u, l_partkey AS i FROM lineitem), p AS (SELECT DISTINCT a.u, b.u AS v FROM q a JOIN q b USING (i)) SELECT round(avg(n), 6) AS mean_neighbours FROM (SELECT u, count(*) AS n FROM p GROUP BY u)")
def _(s, d):
    cells = table(s, d, "lineitem").select("l_suppkey", "l_partkey", F.lit(1).alias("one")).distinct()
    g = M.gram(cells, "l_partkey", "l_suppkey", "one")
    both = g.select("i").union(g.where("i <> j").select("j")).groupBy("i").agg(F.count("*").alias("n"))
    return both.agg(r6(F.avg("n")).alias("mean_neighbours"))


@add("agg32_group_item_variance", f"WITH c AS (SELECT g.group_id, r.item_id, var_pop(r.rating) AS v FROM (SELECT group_id, unnest(members) AS user_id FROM {GROUPS}) g JOIN {RATINGS} r USING (user_id) GROUP BY 1, 2 HAVING count(*) = 3) SELECT group_id, round(avg(v), 4) AS variance, count(*) AS n_common FROM c GROUP BY 1")
def _(s, d):
    rated = R(s, d)
    member = V.groups(rated).select("group_id", F.explode("members").alias("user_id"))
    common = member.join(rated, "user_id").groupBy("group_id", "item_id").agg(F.var_pop("rating").alias("v"), F.count("*").alias("n")).where("n = 3")
    return common.groupBy("group_id").agg(F.round(F.avg("v"), 4).alias("variance"), F.count("*").alias("n_common"))


@add("agg34_similarity_percentiles", f"SELECT round(quantile_cont(sim, 0.75), 4) AS ts, round(quantile_cont(sim, 0.25), 4) AS to_ FROM {_COS}")
def _(s, d):
    q = M.cosine_pairs(table(s, d, "embeddings"), "vec_id", "embedding").agg(F.expr("percentile(sim, array(0.75, 0.25))").alias("q"))
    return q.select(F.round(F.col("q")[0], 4).alias("ts"), F.round(F.col("q")[1], 4).alias("to_"))


@add("agg35_user_places", f"SELECT user, count(*) AS n_reviews, count(DISTINCT id) AS n_places FROM {REVIEWS} GROUP BY 1")
def _(s, d):
    flat = V.places(s, d).select("id", F.explode("reviews").alias("r")).select("id", "r.user")
    per_place = flat.groupBy("user", "id").agg(F.count("*").alias("n"))
    return per_place.groupBy("user").agg(F.sum("n").alias("n_reviews"), F.count("*").alias("n_places"))


# Windows, sorts, sets

@add("win1_top_unseen", f"WITH r AS {RATINGS}, top AS (SELECT item_id, n FROM {N_ITEM}) SELECT user_id, item_id, place FROM (SELECT u.user_id, t.item_id, row_number() OVER (PARTITION BY u.user_id ORDER BY t.n DESC, t.item_id) AS place FROM (SELECT DISTINCT user_id FROM r) u CROSS JOIN top t WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.user_id = u.user_id AND r.item_id = t.item_id)) WHERE place <= 5")
def _(s, d):
    rated = R(s, d)
    counts = rated.groupBy("item_id").agg(F.count("*").alias("score"))
    return recommend_unseen(counts, rated, 5).select("user_id", "item_id", "place")


@add("win3_top_k", f"SELECT user_id, item_id, place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY rating DESC, item_id) AS place FROM {RATINGS}) WHERE place <= 5")
def _(s, d):
    return M.top_k(R(s, d), ["user_id"], "rating", "item_id", 5).select("user_id", "item_id", "place")


@add("win7_moving_average", f"WITH c AS (SELECT year, count(*) AS n FROM {RATINGS} JOIN {ITEMS} USING (item_id) WHERE year IS NOT NULL GROUP BY 1) SELECT year, round(average, 6) AS average FROM (SELECT year, avg(n) OVER w AS average, count(*) OVER w AS k FROM c WINDOW w AS (ORDER BY year ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) WHERE k = 5")
def _(s, d):
    by_year = R(s, d).groupBy("item_id").agg(F.count("*").alias("n")).join(I(s, d).where("year is not null"), "item_id").groupBy("year").agg(F.sum("n").alias("n"))
    return A.moving_average(by_year, "year", "n", 5).withColumn("average", r6("average"))


@add("win8_round_robin", "SELECT vec_id, label FROM (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY (vec_id * 40503) % 1000003, vec_id) AS rn FROM embeddings) ORDER BY rn, label LIMIT 24")
def _(s, d):
    from marquee.operators.cluster import round_robin

    return round_robin(table(s, d, "embeddings").select("vec_id", "label"), "label", "vec_id", 24)


@add("win9_first_seen", f"SELECT group_id, item_id, round, user_id FROM (SELECT *, row_number() OVER (PARTITION BY group_id, item_id ORDER BY round, pos, user_id) AS i FROM {VOTES}) WHERE i = 1")
def _(s, d):
    return L.first_of(V.votes(R(s, d)), ["group_id", "item_id"], ["round", "pos", "user_id"]).select("group_id", "item_id", "round", "user_id")


_SHUFFLE = "(user_id * 2654435761 + item_id * 40503 + 42) % 1000003"


@add("win10_user_split", f"SELECT user_id, item_id, CASE WHEN i <= floor(n * 0.8) THEN 'train' WHEN i <= floor(n * 0.8) + floor(n * 0.1) THEN 'val' ELSE 'test' END AS part FROM (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY {_SHUFFLE}, item_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM {RATINGS})")
def _(s, d):
    from marquee.operators.splits import split_rows

    return split_rows(R(s, d), "user_id", "item_id", 42).select("user_id", "item_id", "part")


@add("win11_users_split", f"SELECT user_id, CASE WHEN i <= floor(n * 0.8) THEN 'train' WHEN i <= floor(n * 0.8) + floor(n * 0.1) THEN 'val' ELSE 'test' END AS part FROM (SELECT user_id, row_number() OVER (ORDER BY (user_id * 2654435761 + 42) % 1000003, user_id) AS i, count(*) OVER () AS n FROM {N_USER})")
def _(s, d):
    from marquee.operators.splits import split_keys

    return split_keys(R(s, d).select("user_id").distinct(), "user_id", 42)


@add("win12_best_repair", "SELECT new_tmdb_id, old_tmdb_id, matched_title FROM (SELECT *, row_number() OVER (PARTITION BY new_tmdb_id ORDER BY popularity DESC NULLS LAST, old_tmdb_id NULLS LAST, matched_title NULLS LAST) AS i FROM repaired) WHERE i = 1")
def _(s, d):
    order = [F.desc_nulls_last("popularity"), F.asc_nulls_last("old_tmdb_id"), F.asc_nulls_last("matched_title")]
    return L.first_of(table(s, d, "repaired"), ["new_tmdb_id"], order).select("new_tmdb_id", "old_tmdb_id", "matched_title")


@add("win14_top_genres", f"WITH c AS (SELECT user_id, genre, count(*) AS n FROM {RATINGS} JOIN {GENRES} USING (item_id) WHERE rating >= 4 GROUP BY 1, 2) SELECT user_id, genre, place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, genre) AS place FROM c) WHERE place <= 3")
def _(s, d):
    c = R(s, d).where("rating >= 4").join(G(s, d), "item_id").groupBy("user_id", "genre").agg(F.count("*").alias("n"))
    return M.top_k(c, ["user_id"], "n", "genre", 3).select("user_id", "genre", "place")


@add("win15_recency_rerank", f"""WITH c AS (SELECT i.genre, n.item_id, n.n, coalesce(y.year, 1970) AS year FROM {N_ITEM} n JOIN {GENRES} i USING (item_id) JOIN {ITEMS} y USING (item_id)), p AS (SELECT *, row_number() OVER (PARTITION BY genre ORDER BY n DESC, item_id) AS i FROM c),
    s AS (SELECT genre, item_id, round(n * (0.3 + 0.7 * exp(-0.05 * (2025 - year))), 6) AS score FROM p WHERE i <= 50) SELECT genre, item_id, place FROM (SELECT *, row_number() OVER (PARTITION BY genre ORDER BY score DESC, item_id) AS place FROM s) WHERE place <= 10""")
def _(s, d):
    counts = R(s, d).groupBy("item_id").agg(F.count("*").alias("n"))
    pool = M.top_k(counts.join(G(s, d), "item_id"), ["genre"], "n", "item_id", 50, "i").join(I(s, d).select("item_id", F.coalesce("year", F.lit(1970)).alias("year")), "item_id")
    scored = pool.withColumn("score", r6(F.col("n") * (0.3 + 0.7 * F.exp(-0.05 * (2025 - F.col("year"))))))
    return M.top_k(scored, ["genre"], "score", "item_id", 10).select("genre", "item_id", "place")


@add("win16_positions", f"WITH v AS {VOTES} SELECT group_id, user_id, item_id, pos AS round_position, row_number() OVER (PARTITION BY group_id, user_id ORDER BY round, pos) AS global_position FROM v")  # a RANGE frame in DuckDB was seen to differ from run to run
def _(s, d):
    before = Window.partitionBy("group_id", "user_id").orderBy("round").rangeBetween(Window.unboundedPreceding, -1)
    return V.votes(R(s, d)).select("group_id", "user_id", "item_id", F.col("pos").alias("round_position"), (F.count("*").over(before) + F.col("pos")).alias("global_position"))


@add("srt1_sort_limit", f"SELECT item_id, n FROM {N_ITEM} ORDER BY n DESC, item_id LIMIT 25")
def _(s, d):
    return R(s, d).groupBy("item_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "item_id").limit(25)


@add("srt2_smallest", f"SELECT item_id, mean FROM (SELECT item_id, round(avg(rating), 6) AS mean, count(*) AS n FROM {RATINGS} GROUP BY 1) WHERE n >= 10 ORDER BY mean, item_id LIMIT 10")
def _(s, d):
    return R(s, d).groupBy("item_id").agg(r6(F.avg("rating")).alias("mean"), F.count("*").alias("n")).where("n >= 10").orderBy("mean", "item_id").limit(10).select("item_id", "mean")


@add("srt3_first_groups", f"SELECT group_id FROM {GROUPS} ORDER BY group_id LIMIT 100")
def _(s, d):
    return V.groups(R(s, d)).select("group_id").orderBy("group_id").limit(100)


@add("set1_not_unanimous", f"WITH v AS {VOTES} SELECT group_id, user_id, item_id FROM v WHERE (group_id, item_id) NOT IN (SELECT group_id, item_id FROM v GROUP BY 1, 2 HAVING count(DISTINCT user_id) = 3)")
def _(s, d):
    v = V.votes(R(s, d))
    same = v.groupBy("group_id", "item_id").agg(F.count_distinct("user_id").alias("n")).where("n = 3")
    return v.join(same, ["group_id", "item_id"], "left_anti").select("group_id", "user_id", "item_id")


@add("set2_discard_enqueue", f"WITH v AS (SELECT * FROM {VOTES} WHERE round = 0), liked AS (SELECT DISTINCT group_id, item_id FROM v WHERE vote = 1), members AS (SELECT DISTINCT group_id, user_id FROM v) SELECT m.group_id, m.user_id, l.item_id FROM members m JOIN liked l USING (group_id) WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.group_id = m.group_id AND v.user_id = m.user_id AND v.item_id = l.item_id)")
def _(s, d):
    v = V.votes(R(s, d)).where("round = 0")
    liked = v.where("vote = 1").select("group_id", "item_id").distinct()
    return v.select("group_id", "user_id").distinct().join(liked, "group_id").join(v, ["group_id", "user_id", "item_id"], "left_anti").select("group_id", "user_id", "item_id")


@add("set3_union_common", f"SELECT DISTINCT item_id FROM (SELECT g.group_id, r.item_id FROM (SELECT group_id, unnest(members) AS user_id FROM {GROUPS}) g JOIN {RATINGS} r USING (user_id) GROUP BY 1, 2 HAVING count(*) = 3)")
def _(s, d):
    rated = R(s, d)
    return M.common_items(V.groups(rated), rated).select("item_id").distinct()


@add("set6_symmetric_dedup", "SELECT DISTINCT least(l_suppkey, l_partkey) AS a, greatest(l_suppkey, l_partkey) AS b FROM lineitem")
def _(s, d):
    return table(s, d, "lineitem").select(F.array_sort(F.array("l_suppkey", "l_partkey")).alias("k")).dropDuplicates(["k"]).select(F.col("k")[0].alias("a"), F.col("k")[1].alias("b"))


@add("set7_catalogue_minus_observed", f"SELECT movieId AS item_id FROM movies WHERE movieId IS NOT NULL EXCEPT SELECT item_id FROM {RATINGS}")
def _(s, d):
    return table(s, d, "movies").where("movieId is not null").select(F.col("movieId").alias("item_id")).distinct().join(R(s, d), "item_id", "left_anti")


@add("set8_union_by_name", "SELECT old_tmdb_id, query_title AS title, 'unresolved' AS kind FROM unresolved UNION ALL SELECT old_tmdb_id, query_title, 'repaired' FROM repaired")
def _(s, d):
    a = table(s, d, "unresolved").select("old_tmdb_id", F.col("query_title").alias("title"), F.lit("unresolved").alias("kind"))
    return a.unionByName(table(s, d, "repaired").select(F.lit("repaired").alias("kind"), F.col("query_title").alias("title"), "old_tmdb_id"))


QUERIES, ORACLE = book.queries, book.sql
