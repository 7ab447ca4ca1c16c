"""Queries of sources and sinks: tables go through files of another format and come back."""

from __future__ import annotations

from pyspark.sql import functions as F

from marquee.plans.registry import Book
from marquee.session import scratch, table
from marquee.sources import readers as S
from marquee.sources import sinks as K
from marquee.sources import views as V
from marquee.sources.views import FACTS, RATINGS, REVIEWS

book = Book()
add = book.add


def _csv(s, d, name, columns):
    path = scratch(s, f"csv-{name}")
    K.write_csv(table(s, d, name).select(*columns), path)
    return path


@add("src1_csv_scan", "SELECT userId, movieId, CASE WHEN isnan(rating) THEN NULL ELSE rating END AS rating FROM ratings")  # a typed scan reads NaN as no value
def _(s, d):
    return S.read_csv(s, _csv(s, d, "ratings", ["userId", "movieId", "rating", "timestamp"]), S.RATINGS, ["userId", "movieId", "rating"])


@add("src2_id_maps", f"SELECT user_id, item_id, dense_rank() OVER (ORDER BY user_id) - 1 AS r, dense_rank() OVER (ORDER BY item_id) - 1 AS c FROM {RATINGS}")
def _(s, d):
    rated = V.ratings(s, d).select("user_id", "item_id")
    return rated.join(S.dense_index(rated, "user_id", "r"), "user_id").join(S.dense_index(rated, "item_id", "c"), "item_id")


def _places(s, d):
    path = scratch(s, "places")
    p = V.places(s, d)
    reviews = F.transform("reviews", lambda r: F.struct(F.struct(r["user"].alias("displayName")).alias("authorAttribution"), r["rating"].alias("rating")))
    shaped = p.select(F.col("id").cast("string").alias("id"), "types", "rating", reviews.alias("reviews"))
    # One document a stretch of ids, as the files of the source hold arrays of places.
    K.write_json(shaped.groupBy(F.pmod(F.col("id").cast("bigint"), F.lit(16)).alias("part")).agg(F.collect_list(F.struct("id", "types", "rating", "reviews")).alias("places")).drop("part").repartition(16), path)
    return s.read.schema(S.PLACES).json(path).select(F.posexplode("places").alias("pos", "p")).select("pos", "p.*")


@add("src3_json_places", "SELECT CAST(s_suppkey AS VARCHAR) AS id, lower(n_name) AS first_type, (s_suppkey % 41) / 10 + 1 AS rating FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def _(s, d):
    return _places(s, d).select("id", F.col("types")[0].alias("first_type"), "rating")


@add("src4_place_ratings", f"SELECT user, CAST(id AS VARCHAR) AS place_id, arg_max(rating, (r.at, line, rating)) AS rating FROM {REVIEWS} r WHERE id IN (SELECT s_suppkey FROM supplier) GROUP BY 1, 2")
def _(s, d):
    return S.place_ratings(_places(s, d))


@add("src5_first_existing", "SELECT count(*) AS n FROM movies")
def _(s, d):
    return S.load_first(s, [f"{d}/absent.parquet", f"{d}/movies.parquet"], s.read.parquet).agg(F.count("*").alias("n"))


@add("src6_pruned_scan", "SELECT movieId, title FROM movies")
def _(s, d):
    return S.read_csv(s, _csv(s, d, "movies", ["movieId", "title", "genres"]), S.MOVIES, ["movieId", "title"])


@add("src9_enrichment", "SELECT DISTINCT old_tmdb_id, CASE WHEN old_tmdb_id % 2 = 0 THEN 'film ' || old_tmdb_id END AS found FROM unresolved WHERE old_tmdb_id IS NOT NULL")
def _(s, d):
    def client():
        return lambda key: {"found": f"film {key}"} if key % 2 == 0 else {}

    return S.enrich(table(s, d, "unresolved").where("old_tmdb_id is not null").select("old_tmdb_id").distinct(), client, "found string", "old_tmdb_id")


@add("src10_by_suffix", "SELECT new_tmdb_id, popularity FROM repaired")
def _(s, d):
    path = scratch(s, "repaired") + ".json"
    K.write_json(table(s, d, "repaired"), path)
    return S.read_any(s, path, S.REPAIRED).select("new_tmdb_id", "popularity")


@add("src11_discovery", f"SELECT algorithm, w_size, run_num, count(*) AS n FROM {FACTS} GROUP BY ALL")
def _(s, d):
    root = scratch(s, "runs")
    V.facts(s, d).withColumnRenamed("w_size", "w").withColumnRenamed("run_num", "run").write.partitionBy("w", "run").parquet(root)
    return S.discover_runs(s, root).groupBy("algorithm", F.col("w").alias("w_size"), "run_num").agg(F.count("*").alias("n"))


@add("src13_candidates", "SELECT count(*) AS n FROM links")
def _(s, d):
    return S.load_first(s, [f"{d}/w=10/links", f"{d}/legacy/links", f"{d}/links.parquet"], s.read.parquet).agg(F.count("*").alias("n"))


@add("src14_last_by_id", "SELECT movie_id, tmdb FROM (SELECT movieId AS movie_id, tmdbId AS tmdb, row_number() OVER (PARTITION BY movieId ORDER BY coalesce(imdbId, '') || '|' || coalesce(tmdbId, '') DESC) AS i FROM links) WHERE i = 1")
def _(s, d):
    rows = table(s, d, "links").select(F.col("movieId").alias("id"), F.col("tmdbId").alias("tmdb"), F.concat(F.coalesce("imdbId", F.lit("")), F.lit("|"), F.coalesce("tmdbId", F.lit(""))).alias("pos"))
    return S.places_by_id(rows).select(F.col("id").alias("movie_id"), "tmdb")


@add("snk1_csv_round_trip", "SELECT movieId, title, genres FROM movies WHERE title <> '' AND genres <> ''")
def _(s, d):
    plain = table(s, d, "movies").where("title <> '' and genres <> ''")
    path = scratch(s, "csv-movies")
    K.write_csv(plain, path)
    return S.read_csv(s, path, S.MOVIES)


@add("snk2_run_store", f"SELECT algorithm, w_size, count(*) AS n FROM {FACTS} WHERE run_num = 0 OR (run_num = 1 AND w_size = 1 AND (algorithm, w_size, group_type, bias) NOT IN (SELECT algorithm, w_size, group_type, bias FROM {FACTS} WHERE run_num = 0)) GROUP BY ALL")
def _(s, d):
    keys = ["algorithm", "w_size", "group_type", "bias"]
    store, f = K.RunStore(s, scratch(s, "store"), keys), V.facts(s, d)
    store.append(f.where("run_num = 0"))
    number = store.upsert(f.where("run_num = 1 and w_size = 1"))
    return s.read.parquet(f"{store.path}/run={number}").groupBy("algorithm", "w_size").agg(F.count("*").alias("n"))


@add("snk4_load_or_build", "SELECT count(*) AS n FROM movies")
def _(s, d):
    path = scratch(s, "kept")
    S.load_or_build(s, path, lambda: table(s, d, "movies"))
    return S.load_or_build(s, path, lambda: table(s, d, "links"), mode="auto").agg(F.count("*").alias("n"))


@add("snk5_modes", "SELECT count(*) AS n FROM links")
def _(s, d):
    path = scratch(s, "kept")
    S.load_or_build(s, path, lambda: table(s, d, "movies"), mode="compute")
    S.load_or_build(s, path, lambda: table(s, d, "links"), mode="compute")
    return S.load_or_build(s, path, lambda: table(s, d, "movies"), mode="load").agg(F.count("*").alias("n"))


@add("snk6_latex_lines")
def _(s, d):
    from marquee.operators.reports import mean_by

    text = K.latex_table(mean_by(V.facts(s, d), ["group_type"]).orderBy("group_type"), "Means", lambda r, c: c == "mean" and r[c] > 2.5)
    return s.createDataFrame([(i, line) for i, line in enumerate(text.split("\n"))], "line int, text string")


@add("snk6_latex_multihead")
def _(s, d):
    """Means by algorithm and bias under spanning heads, the least of every column bold."""
    from marquee.operators.reports import mean_by

    cells = mean_by(V.facts(s, d).withColumn("b", F.concat(F.lit("b"), (F.col("bias") * 10).cast("int").cast("string"))), ["algorithm", "b"])
    wide = cells.groupBy("algorithm").pivot("b", ["b0", "b5", "b10", "b20", "b30"]).agg(F.first("mean")).orderBy("algorithm")
    text = K.latex_table(wide, "By bias", K.best_of(wide, ["b0", "b5", "b10", "b20", "b30"]), heads=[("", 1), ("lenient", 2), ("strict", 3)])
    return s.createDataFrame([(i, line) for i, line in enumerate(text.split("\n"))], "line int, text string")


@add("snk8_profile_log", "SELECT stage, n FROM (VALUES ('session.start', 1), ('read', 1), ('write', 2)) t(stage, n)")
def _(s, d):
    log = K.ProfileLog(s, scratch(s, "profile"), "run", purpose="query")
    with log.timed("read", table="movies"):
        table(s, d, "movies").schema
    for _ in range(2):
        with log.timed("write"):
            pass
    return s.read.schema("ts string, stage string, duration_s double, extra string").json(log.write()).groupBy("stage").agg(F.count("*").cast("int").alias("n"))


@add("prj5_metric_fallback", f"SELECT userId AS user_id, movieId AS item_id, timestamp AS ts, round(coalesce(CASE WHEN isnan(rating) THEN NULL ELSE rating END, m.mean, (SELECT avg(rating) FROM {RATINGS})), 6) AS value FROM ratings LEFT JOIN (SELECT item_id, avg(rating) AS mean FROM {RATINGS} GROUP BY 1) m ON m.item_id = movieId")
def _(s, d):
    """A value read directly, else from the item, else from the whole; NaN counts as missing."""
    rated = V.ratings(s, d)
    means = rated.groupBy("item_id").agg(F.avg("rating").alias("mean"))
    whole = rated.agg(F.avg("rating").alias("whole"))
    raw = table(s, d, "ratings").select(F.col("userId").alias("user_id"), F.col("movieId").alias("item_id"), F.col("timestamp").alias("ts"), "rating")
    value = F.coalesce(F.when(~F.isnan("rating"), F.col("rating")), "mean", "whole")
    return raw.join(means, "item_id", "left").crossJoin(F.broadcast(whole)).select("user_id", "item_id", "ts", F.round(value, 6).alias("value"))


@add("snk9_count_percent", f"WITH b AS (SELECT least(n, 20) AS k, count(*) AS n FROM (SELECT user, count(*) AS n FROM {REVIEWS} GROUP BY 1) GROUP BY 1) SELECT k, n FROM b")
def _(s, d):
    from marquee.operators.aggregates import overflow_histogram

    counts = V.places(s, d).select(F.explode("reviews").alias("r")).groupBy("r.user").agg(F.count("*").alias("c"))
    return overflow_histogram(counts, "c", 20).select("k", "n")


@add("snk11_json_dump", f"SELECT user, count(DISTINCT id) AS n_places FROM {REVIEWS} WHERE id IN (SELECT s_suppkey FROM supplier) GROUP BY 1")
def _(s, d):
    path = scratch(s, "users")
    flat = V.places(s, d).select("id", F.explode("reviews").alias("r")).select("id", "r.user")
    K.write_json(flat.groupBy("user").agg(F.collect_set("id").alias("places")), path)
    return s.read.schema("user string, places array<bigint>").json(path).select("user", F.size("places").cast("bigint").alias("n_places"))


QUERIES, ORACLE = book.queries, book.sql
