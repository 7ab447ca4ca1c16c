"""Sources (SRC): typed scans of files, id maps, loaders with fallbacks, discovery of result files.

Paths may be anything Spark reads. Missing files raise Spark's own error unless an operator says otherwise.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.operators.filters import first_of
from marquee.operators.ranking import with_position
from marquee.session import written

MOVIES = "movieId bigint, title string, genres string"
RATINGS = "userId bigint, movieId bigint, rating double, timestamp bigint"
LINKS = "movieId string, imdbId string, tmdbId string"
REPAIRED = "old_tmdb_id bigint, new_tmdb_id bigint, query_title string, matched_title string, release_date string, popularity double"
REPAIRED_FILTERED = "movieId bigint, old_tmdb_id bigint, new_tmdb_id bigint, movielens_title string, matched_title string, title_similarity double, release_date string, popularity double"
UNRESOLVED = "old_tmdb_id bigint, query_title string, reason string"
PLACES = "places array<struct<id string, displayName struct<text string>, types array<string>, rating double, priceLevel string, reviews array<struct<authorAttribution struct<displayName string>, rating int>>>>"


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_csv(spark: SparkSession, path: str, schema: str, columns: list[str] | None = None, encoding: str = "UTF-8") -> DataFrame:
    """SRC1, SRC6, SRC7: a typed CSV scan; only the chosen columns are parsed. A number written as NaN is no value: null."""
    df = spark.read.schema(schema).csv(path, header=True, encoding=encoding, escape='"')
    kinds = dict(df.dtypes)
    return df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in columns or df.columns])


def load_ratings(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """SRC1: movies and ratings of a MovieLens folder, ratings without the timestamp."""
    return read_csv(spark, f"{folder}/movies.csv", MOVIES, encoding="ISO-8859-1"), read_csv(spark, f"{folder}/ratings.csv", RATINGS, ["userId", "movieId", "rating"])


def dense_index(df: DataFrame, key: str, out: str) -> DataFrame:
    """SRC2, PRJ1: (key, 0-based index in key order) of the distinct keys."""
    return with_position(df.select(key).where(F.col(key).isNotNull()).distinct(), [key], out)


def load_indexed(spark: SparkSession, folder: str) -> DataFrame:
    """SRC2: ratings with matrix positions (row, col) beside the ids."""
    rated = load_ratings(spark, folder)[1]
    return rated.join(dense_index(rated, "userId", "row"), "userId").join(dense_index(rated, "movieId", "col"), "movieId")


def read_places(spark: SparkSession, path: str) -> DataFrame:
    """SRC3: one row a place of a nested JSON file, with its position; a missing list of reviews is an empty one."""
    raw = spark.read.schema(PLACES).json(path, multiLine=True)
    return raw.select(F.posexplode("places").alias("pos", "p")).select("pos", "p.*").withColumn("reviews", F.coalesce("reviews", F.expr("cast(array() as array<struct<authorAttribution: struct<displayName: string>, rating: int>>)")))


def place_ratings(places: DataFrame, author: str = "authorAttribution.displayName") -> DataFrame:
    """SRC4: (user, place_id, rating) of the nested reviews; the last review of a user at a place counts."""
    flat = places.select(F.col("id").alias("place_id"), F.posexplode("reviews").alias("i", "r")).select("place_id", "i", F.col(f"r.{author}").alias("user"), "r.rating")
    return flat.where("user is not null").groupBy("user", "place_id").agg(F.max_by("rating", "i").alias("rating"))


def load_first(spark: SparkSession, folders: list[str], load: Callable[[str], DataFrame]) -> DataFrame:
    """SRC5, SRC13: the first of the candidate paths that exists."""
    for folder in folders:
        if exists(spark, folder):
            return load(folder)
    raise FileNotFoundError(f"none of {folders}")


def read_any(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """SRC10: the format by the suffix."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    reader = spark.read.schema(schema) if schema else spark.read
    if kind == "csv":
        return reader.csv(path, header=True, inferSchema=schema is None, escape='"')
    if kind in ("parquet", "orc", "json"):
        return getattr(reader, kind)(path)
    raise ValueError(f"no reader for .{kind}")


def discover_runs(spark: SparkSession, root: str) -> DataFrame:
    """SRC11: result files below w=/group=/split=/algo=, with the values of their paths as columns and run numbers."""
    df = spark.read.option("basePath", root).option("recursiveFileLookup", "false").parquet(f"{root}/w=*")
    return df.withColumn("run_num", F.regexp_extract(F.col("_metadata.file_path"), r"/run=(\d+)/", 1).cast("int"))


def latest_run(df: DataFrame, keys: list[str], run: str = "run_num") -> DataFrame:
    """SRC12: only the rows of the highest run of every directory."""
    newest = df.groupBy(*keys).agg(F.max(run).alias(run))
    return df.join(newest, [*keys, run], "left_semi")


def places_by_id(places: DataFrame, order: str = "pos") -> DataFrame:
    """SRC14: one row a place id, the last of repeated ones."""
    return first_of(places, ["id"], [F.desc(order)])


def enrich(df: DataFrame, client: Callable[[], Callable[[int], dict]], schema: str, key: str) -> DataFrame:
    """SRC9: rows joined with what a client says of their key; the client is made once a task and may be any stub.

    A key the client doesn't know gives nulls; each key is asked for once.
    """
    names = [f.split()[0] for f in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = client()
        for batch in batches:
            rows = [ask(k) or {} for k in batch[key]]
            yield pd.concat([batch.reset_index(drop=True), pd.DataFrame([{n: r.get(n) for n in names} for r in rows], columns=names)], axis=1)

    keys = df.select(key).distinct()
    found = keys.mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, {schema}")
    return df.join(found, key, "left")


def load_or_build(spark: SparkSession, path: str, build: Callable[[], DataFrame], force: bool = False, mode: str = "auto") -> DataFrame:
    """SNK4, SNK5: a table kept as Parquet. mode: auto (load if there, else build), load, or compute."""
    if mode == "load" or (mode == "auto" and not force and exists(spark, path)):
        return spark.read.parquet(path)
    written(build(), "build").write.mode("overwrite").parquet(path)  # the table may be built from its own old version
    return spark.read.parquet(path)
