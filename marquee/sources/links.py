"""Link repair: id normalisation, conditional updates and best matches (SRC7, SRC8, JOI5, STR5, STR6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.operators.filters import first_of


def numeric_id(column: str) -> Column:
    """SRC8: '123.0' to 123; blank and non-numeric text to null."""
    return F.expr(f"cast(try_cast(trim({column}) as double) as bigint)")


def digit_id(column: str) -> Column:
    """SRC7: text of digits only as a number, else null."""
    return F.when(F.trim(column).rlike("^[0-9]+$"), F.expr(f"try_cast(trim({column}) as bigint)"))


def resolve_ids(links: DataFrame, fixes: DataFrame, unresolved: DataFrame, drop_unresolved: bool) -> DataFrame:
    """JOI5: (movie_id, tmdb) with repaired ids put in; ids known to be unresolved stay or go."""
    joined = links.join(fixes, links.tmdb == fixes.old_tmdb_id, "left")
    if drop_unresolved:
        gone = unresolved.where("old_tmdb_id is not null").distinct().select(F.col("old_tmdb_id").alias("gone"))
        joined = joined.join(gone, links.tmdb == F.col("gone"), "left").where("new_id is not null or gone is null")
    return joined.select("movie_id", F.coalesce("new_id", "tmdb").alias("tmdb"))


def slug_title(url: str) -> Column:
    """STR5: the title in the last path segment after its first hyphen; null without one."""
    slug = F.regexp_extract(F.regexp_replace(F.col(url), "/+$", ""), r"/[^/-]*-([^/]*)$", 1)
    return F.when(slug != "", F.replace(slug, F.lit("-"), F.lit(" ")))


def best_search_match(hits: DataFrame, key: str, query: str, title: str, popularity: str, position: str) -> DataFrame:
    """STR6: an exact title (case aside) first, then the most popular, then the earlier hit."""
    exact = F.lower(F.trim(query)) == F.lower(F.trim(title))
    return first_of(hits, [key], [F.desc(F.coalesce(exact, F.lit(False))), F.desc_nulls_last(popularity), F.asc(position)])
