"""Queries of scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from marquee.functions import scalars as S
from marquee.plans.registry import Book
from marquee.session import table
from marquee.sources import views as V
from marquee.sources.links import best_search_match, digit_id, numeric_id, slug_title
from marquee.sources.views import ITEMS, RATINGS

book = Book()
add = book.add


@add("str1_title_year", r"SELECT movieId AS movie_id, title, TRY_CAST(regexp_extract(title, '\((\d{4})\)', 1) AS INTEGER) AS year FROM movies")
def _(s, d):
    return table(s, d, "movies").select(F.col("movieId").alias("movie_id"), "title", S.title_year("title").alias("year"))


@add("str2_normal_title", r"SELECT movieId AS movie_id, trim(regexp_replace(regexp_replace(lower(title), '\(\d{4}\)', '', 'g'), '[^a-z0-9\s]', '', 'g')) AS title FROM movies")
def _(s, d):
    return table(s, d, "movies").select(F.col("movieId").alias("movie_id"), S.normal_title("title").alias("title"))


@add("str3_sequence_ratio")
def _(s, d):
    rows = table(s, d, "repaired_filtered").select("movieId", "new_tmdb_id", S.normal_title("movielens_title").alias("a"), S.normal_title("matched_title").alias("b"))
    return rows.select(F.col("movieId").alias("movie_id"), "new_tmdb_id", F.round(S.sequence_ratio("a", "b"), 4).alias("ratio"))


@add("flt8_similar_and_same_year")
def _(s, d):
    from marquee.operators.filters import consistent_years

    rows = table(s, d, "repaired_filtered")
    ratio = S.sequence_ratio(S.normal_title("movielens_title"), S.normal_title("matched_title"))
    return rows.withColumn("ratio", ratio).where((F.col("ratio") >= 0.65) & consistent_years(S.title_year("movielens_title"), S.date_year("release_date"))).select(F.col("movieId").alias("movie_id"), "new_tmdb_id", F.round("ratio", 4).alias("ratio"))


@add("str4_date_year", r"SELECT new_tmdb_id, release_date, CASE WHEN regexp_full_match(substr(release_date, 1, 4), '\d{4}') THEN CAST(substr(release_date, 1, 4) AS INTEGER) END AS year FROM repaired")
def _(s, d):
    return table(s, d, "repaired").select("new_tmdb_id", "release_date", S.date_year("release_date").alias("year"))


_URL = "'https://films.example/movie/' || movieId || '-' || replace(lower(coalesce(title, '')), ' ', '-') || '/'"


@add("str5_slug_title", rf"SELECT movieId AS movie_id, nullif(replace(regexp_extract(regexp_replace({_URL}, '/+$', ''), '/[^/-]*-([^/]*)$', 1), '-', ' '), '') AS slug FROM movies WHERE title IS NOT NULL AND title NOT LIKE '%/%'")
def _(s, d):
    rows = table(s, d, "movies").where("title is not null and title not like '%/%'")
    url = F.concat(F.lit("https://films.example/movie/"), F.col("movieId").cast("string"), F.lit("-"), F.replace(F.lower("title"), F.lit(" "), F.lit("-")), F.lit("/"))
    return rows.withColumn("url", url).select(F.col("movieId").alias("movie_id"), slug_title("url").alias("slug"))


@add("str6_best_search_match", "SELECT old_tmdb_id, new_tmdb_id FROM (SELECT *, row_number() OVER (PARTITION BY old_tmdb_id ORDER BY coalesce(lower(trim(query_title)) = lower(trim(matched_title)), false) DESC, popularity DESC NULLS LAST, new_tmdb_id) AS i FROM repaired) WHERE i = 1")
def _(s, d):
    return best_search_match(table(s, d, "repaired"), "old_tmdb_id", "query_title", "matched_title", "popularity", "new_tmdb_id").select("old_tmdb_id", "new_tmdb_id")


@add("str7_genre_one_hot", f"SELECT item_id, CAST(list_contains(g, 'drama') AS INTEGER) AS drama, CAST(list_contains(g, 'comedy') AS INTEGER) AS comedy, CAST(list_contains(g, 'sci-fi') AS INTEGER) AS scifi FROM (SELECT item_id, list_transform(genres, lambda x: lower(x)) AS g FROM {ITEMS})")
def _(s, d):
    low = V.items(s, d).withColumn("g", F.transform("genres", F.lower))
    return low.select("item_id", *[F.array_contains("g", v).cast("int").alias(n) for v, n in (("drama", "drama"), ("comedy", "comedy"), ("sci-fi", "scifi"))])


@add("str8_slug_family", "SELECT DISTINCT l_shipmode_like AS slug, CASE WHEN l_shipmode_like LIKE '%hybrid%' THEN 'hybrid' WHEN l_shipmode_like LIKE '%async%' THEN 'async' ELSE 'sync' END AS family FROM (SELECT ([ 'eval_hybrid_updatable', 'eval_async_static', 'eval_sync_ema'])[l_linenumber % 3 + 1] AS l_shipmode_like FROM lineitem)")
def _(s, d):
    slugs = F.element_at(F.array(*map(F.lit, ("eval_hybrid_updatable", "eval_async_static", "eval_sync_ema"))), (F.col("l_linenumber") % 3 + 1).cast("int"))
    family = F.when(F.col("slug").contains("hybrid"), "hybrid").when(F.col("slug").contains("async"), "async").otherwise("sync")
    return table(s, d, "lineitem").select(slugs.alias("slug")).distinct().select("slug", family.alias("family"))


@add("str9_number_format", "SELECT p_partkey, printf('%.2f', p_retailprice) AS price FROM part")
def _(s, d):
    return table(s, d, "part").select("p_partkey", F.format_string("%.2f", "p_retailprice").alias("price"))


@add("src7_digit_guard", "SELECT movieId AS movie_id, CASE WHEN regexp_full_match(trim(tmdbId), '[0-9]+') THEN TRY_CAST(trim(tmdbId) AS BIGINT) END AS tmdb FROM links")
def _(s, d):
    return table(s, d, "links").select(F.col("movieId").alias("movie_id"), digit_id("tmdbId").alias("tmdb"))


@add("src8_numeric_id", "SELECT movieId AS movie_id, CAST(TRY_CAST(trim(tmdbId) AS DOUBLE) AS BIGINT) AS tmdb FROM links")
def _(s, d):
    return table(s, d, "links").select(F.col("movieId").alias("movie_id"), numeric_id("tmdbId").alias("tmdb"))


_X0 = "(1 - (1 / 0.75) * ln((1 - 0.2) / 0.015 - 1))"


@add("con7_sigmoid_t", f"SELECT k, q, w, CASE WHEN k = 0 THEN 0 ELSE CAST(round_even(w * (0.2 + 0.8 / (1 + exp(-0.75 * (k - {_X0}))) * greatest(0, least(q, 10) - 2) / 8), 0) AS INTEGER) END AS t FROM (SELECT DISTINCT l_linenumber - 1 AS k, CAST(l_quantity AS BIGINT) AS q, ([1, 3, 5, 10])[l_suppkey % 4 + 1] AS w FROM lineitem)")
def _(s, d):
    w = F.element_at(F.array(*map(F.lit, (1, 3, 5, 10))), (F.col("l_suppkey") % 4 + 1).cast("int"))
    rows = table(s, d, "lineitem").select((F.col("l_linenumber") - 1).alias("k"), F.col("l_quantity").cast("bigint").alias("q"), w.alias("w")).distinct()
    return rows.withColumn("t", S.sigmoid_threshold(F.col("k"), F.col("q"), F.col("w"), most=10.0, least=2.0))


@add("mth2_half_even", "SELECT DISTINCT l_quantity AS x, CAST(round_even(l_quantity / 2, 0) AS BIGINT) AS y FROM lineitem")
def _(s, d):
    return table(s, d, "lineitem").select(F.col("l_quantity").alias("x"), F.rint(F.col("l_quantity") / 2).cast("bigint").alias("y")).distinct()


_E = "(SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)"


def _vectors(s, d):
    return table(s, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


@add("mth3_l2_normal", f"SELECT vec_id, round(v[1] / (sqrt(list_dot_product(v, v)) + 1e-10), 5) AS first FROM {_E}")
def _(s, d):
    return _vectors(s, d).select("vec_id", F.round(S.l2_normal("v")[0], 5).alias("first"))


_PAIR = f"(SELECT a.vec_id, a.v, b.v AS u FROM {_E} a JOIN {_E} b ON b.vec_id = a.vec_id + 1)"


def _pairs(s, d):
    v = _vectors(s, d)
    return v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("u")), "vec_id")


@add("mth4_cosine", f"SELECT vec_id, round(list_dot_product(v, u) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(u, u)) + 1e-8), 4) AS sim FROM {_PAIR}")
def _(s, d):
    return _pairs(s, d).select("vec_id", F.round(S.cosine("v", "u"), 4).alias("sim"))


@add("mth5_pearson", f"SELECT vec_id, round((64 * list_dot_product(v, u) - list_sum(v) * list_sum(u)) / sqrt((64 * list_dot_product(v, v) - list_sum(v) ** 2) * (64 * list_dot_product(u, u) - list_sum(u) ** 2)), 4) AS r FROM {_PAIR}")
def _(s, d):
    return _pairs(s, d).select("vec_id", F.round(S.pearson("v", "u"), 4).alias("r"))


@add("mth6_simplex", f"SELECT vec_id, round(greatest(v[1], 0) / list_sum(list_transform(v, lambda x: greatest(x, 0))), 5) AS first FROM {_E}")
def _(s, d):
    return _vectors(s, d).select("vec_id", F.round(S.simplex("v")[0], 5).alias("first"))


@add("mth7_price_ordinal", "SELECT DISTINCT p_size, round(CASE WHEN p_size % 7 BETWEEN 1 AND 5 THEN p_size % 7 ELSE 0 END / 6, 6) AS price FROM part")
def _(s, d):
    level = F.get(F.array(*map(F.lit, S.PRICE_LEVELS)), (F.col("p_size") % 7).cast("int"))
    return table(s, d, "part").select("p_size", F.round(S.price_ordinal(level), 6).alias("price")).distinct()


@add("mth8_multi_hot", f"SELECT item_id, CAST(list_has_any(g, ['drama', 'romance']) AS INTEGER) AS serious, CAST(list_has_any(g, ['comedy', 'animation']) AS INTEGER) AS light FROM (SELECT item_id, list_transform(genres, lambda x: lower(x)) AS g FROM {ITEMS})")
def _(s, d):
    hot = S.multi_hot(F.transform("genres", F.lower), {"serious": ["drama", "romance"], "light": ["comedy", "animation"]})
    return V.items(s, d).withColumn("h", hot).select("item_id", F.col("h")[0].cast("int").alias("serious"), F.col("h")[1].cast("int").alias("light"))


_KINDS = [k for kinds in S.PLACE_GROUPS.values() for k in kinds]
_KIND_SQL = "[" + ", ".join(repr(k) for k in _KINDS) + "]"


@add("mth8_place_groups", "SELECT l_suppkey, l_partkey, " + ", ".join(f"CAST(list_has_any(types, {members!r}) AS INTEGER) AS {name}" for name, members in S.PLACE_GROUPS.items()) + f" FROM (SELECT DISTINCT l_suppkey, l_partkey, [({_KIND_SQL})[l_suppkey % {len(_KINDS)} + 1], ({_KIND_SQL})[l_partkey % {len(_KINDS)} + 1], 'unheard_of'] AS types FROM lineitem)")
def _(s, d):
    kind = lambda c: F.element_at(F.array(*map(F.lit, _KINDS)), (F.pmod(F.col(c), F.lit(len(_KINDS))) + 1).cast("int"))
    pairs = table(s, d, "lineitem").select("l_suppkey", "l_partkey").distinct()
    hot = pairs.withColumn("h", S.multi_hot(F.array(kind("l_suppkey"), kind("l_partkey"), F.lit("unheard_of")), S.PLACE_GROUPS))
    return hot.select("l_suppkey", "l_partkey", *[F.col("h")[i].cast("int").alias(name) for i, name in enumerate(S.PLACE_GROUPS)])


@add("mth9_vote_stars", f"SELECT user_id, item_id, CASE WHEN rating >= 3.5 THEN 5.0 WHEN rating <= 2.5 THEN 1.0 ELSE 3.0 END::DOUBLE AS stars FROM {RATINGS}")
def _(s, d):
    vote = F.when(F.col("rating") >= 3.5, 1).when(F.col("rating") <= 2.5, -1).otherwise(0)
    return V.ratings(s, d).select("user_id", "item_id", S.vote_stars(vote).alias("stars"))


@add("mth10_cards_seen", "SELECT l_suppkey, round(10 * (avg(l_linenumber) - 1) + max(l_linenumber), 6) AS cards FROM lineitem GROUP BY 1")
def _(s, d):
    return table(s, d, "lineitem").groupBy("l_suppkey").agg(F.round(S.cards_seen(F.lit(10), F.avg("l_linenumber"), F.max("l_linenumber")), 6).alias("cards"))


@add("mth12_test_sizes", f"SELECT user_id, CAST(ceil(n * 0.2) AS BIGINT) AS up, CAST(floor(n * 0.2) AS BIGINT) AS down FROM (SELECT user_id, count(*) AS n FROM {RATINGS} GROUP BY 1)")
def _(s, d):
    n = V.ratings(s, d).groupBy("user_id").agg(F.count("*").alias("n"))
    return n.select("user_id", F.ceil(F.col("n") * F.lit(0.2).cast("double")).alias("up"), F.floor(F.col("n") * F.lit(0.2).cast("double")).alias("down"))


@add("con17_vote_probabilities", f"""WITH z AS (SELECT user_id, item_id, (rating - avg(rating) OVER w) / greatest(stddev_pop(rating) OVER w, 0.5) AS z FROM {RATINGS} WINDOW w AS (PARTITION BY user_id)),
    p AS (SELECT user_id, item_id, 1 / (1 + exp(-(z - 1.5) / 0.7)) AS l, 1 / (1 + exp((z + 0.5) / 0.7)) AS dl FROM z) SELECT user_id, item_id, round(l / (l + dl + greatest(0, 1 - l - dl)), 4) AS likes FROM p""")
def _(s, d):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id")
    p = S.vote_probabilities(F.col("rating"), F.avg("rating").over(w), F.stddev_pop("rating").over(w), -1.0, 1.0, 0.7, 0.5)
    return V.ratings(s, d).select("user_id", "item_id", F.round(p[2], 4).alias("likes"))


@add("arr1_argmax", f"SELECT vec_id, list_position(v, list_max(v)) - 1 AS dim FROM {_E}")
def _(s, d):
    return _vectors(s, d).select("vec_id", (F.array_position("v", F.array_max("v")) - 1).cast("int").alias("dim"))


@add("jsn1_nested_default", "SELECT event_id, coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS k, coalesce(CAST(json_extract_string(props, '$.missing') AS BIGINT), -1) AS m FROM events")
def _(s, d):
    return table(s, d, "events").select("event_id", S.json_int("props", "$.k").alias("k"), S.json_int("props", "$.missing", -1).alias("m"))


@add("map1_invert", "SELECT DISTINCT genre_no AS id, genre FROM (SELECT row_number() OVER (ORDER BY n_name) AS genre_no, n_name AS genre FROM nation)")
def _(s, d):
    from pyspark.sql import Window

    names = table(s, d, "nation").select(F.row_number().over(Window.orderBy("n_name")).alias("id"), F.col("n_name").alias("genre"))
    inverted = names.agg(F.map_from_entries(F.collect_list(F.struct("genre", "id"))).alias("m"))  # 25 nations
    return inverted.select(F.explode("m").alias("genre", "id")).select("id", "genre")


@add("dat1_utc_stamp", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS stamp FROM events")
def _(s, d):
    return table(s, d, "events").select("event_id", S.utc_stamp("ts").alias("stamp"))


QUERIES, ORACLE = book.queries, book.sql
