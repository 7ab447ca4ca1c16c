"""Scalar functions (STR, MTH, ARR, JSN) as column expressions; Python only where no expression exists."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def title_year(title: Column | str) -> Column:
    """STR1: the first four digits in parentheses; null without."""
    y = F.regexp_extract(col(title), r"\((\d{4})\)", 1)
    return F.when(y != "", y.cast("int"))


def normal_title(title: Column | str) -> Column:
    """STR2: lower case, without years in parentheses and without all but letters, digits and blanks; ends trimmed."""
    no_year = F.regexp_replace(F.lower(col(title)), r"\(\d{4}\)", "")
    return F.trim(F.regexp_replace(no_year, r"[^a-z0-9\s]", ""))


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """STR3: Ratcliff-Obershelp ratio; null if either text is."""
    from difflib import SequenceMatcher

    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def date_year(date: Column | str) -> Column:
    """STR4: the first four characters as a year if they are digits."""
    head = F.substring(col(date), 1, 4)
    return F.when(head.rlike(r"^\d{4}$"), head.cast("int"))


def sigmoid_threshold(k: Column, queue: Column, w: Column, center: float = 1.0, a: float = 0.75, c: float = 0.2, most: float = 1.0, least: float = 0.0) -> Column:
    """MTH1, MTH2, CON7: items to offer anew in round k, half to even; 0 in round 0.

    The share of the window rises from c to 1 along a logistic curve in k; its midpoint lies before `center` by as much as
    brings the curve's foot within 0.015 of c. The rise is scaled by the fill of the queue between `least` and `most`.
    """
    x0 = center - (1 / a) * math.log((1 - c) / 0.015 - 1)
    fill = F.greatest(F.lit(0.0), F.least(queue.cast("double"), F.lit(float(most))) - least) / (most - least)
    share = F.lit(c) + (1 - c) / (1 + F.exp(-a * (k - F.lit(x0)))) * fill
    return F.when(k == 0, 0).otherwise(F.rint(w * share)).cast("int")


def dot(a: Column | str, b: Column | str) -> Column:
    """ARR1."""
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def l2_normal(v: Column | str) -> Column:
    """MTH3: over its length plus 1e-10."""
    return F.transform(col(v), lambda x: x / (F.sqrt(dot(v, v)) + 1e-10))


def cosine(a: Column | str, b: Column | str) -> Column:
    """MTH4: with 1e-8 in the denominator."""
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + 1e-8)


def pearson(a: Column | str, b: Column | str) -> Column:
    """MTH5: correlation of two vectors."""
    n = F.size(col(a))
    total = lambda v: F.aggregate(col(v), F.lit(0.0), lambda s, x: s + x)
    up = n * dot(a, b) - total(a) * total(b)
    return F.try_divide(up, F.sqrt((n * dot(a, a) - total(a) * total(a)) * (n * dot(b, b) - total(b) * total(b))))


def simplex(v: Column | str) -> Column:
    """MTH6: negative parts cut off, then shares of the sum; even shares if nothing is left."""
    cut = F.transform(col(v), lambda x: F.greatest(x, F.lit(0.0)))
    total = F.aggregate(cut, F.lit(0.0), lambda s, x: s + x)
    return F.transform(cut, lambda x: F.when(total > 0, x / total).otherwise(F.lit(1.0) / F.size(col(v))))


#: Price levels in rising order.
PRICE_LEVELS = ["PRICE_LEVEL_UNSPECIFIED", "PRICE_LEVEL_FREE", "PRICE_LEVEL_INEXPENSIVE", "PRICE_LEVEL_MODERATE", "PRICE_LEVEL_EXPENSIVE", "PRICE_LEVEL_VERY_EXPENSIVE"]


def price_ordinal(level: Column | str) -> Column:
    """MTH7: place of the price level over 6; 0 for unknown ones."""
    at = F.array_position(F.array(*map(F.lit, PRICE_LEVELS)), col(level))
    return F.coalesce(F.greatest(at - 1, F.lit(0)), F.lit(0)) / 6.0


#: Kinds of places by group, in the order of the groups.
PLACE_GROUPS = {
    "african": ["african_restaurant"],
    "american": ["american_restaurant", "diner", "steak_house", "brunch_restaurant", "breakfast_restaurant"],
    "asian": ["asian_restaurant", "japanese_restaurant", "sushi_restaurant", "chinese_restaurant", "thai_restaurant", "indonesian_restaurant", "vietnamese_restaurant", "korean_restaurant", "ramen_restaurant"],
    "bars_alcohol": ["bar", "pub", "bar_and_grill", "wine_bar", "wine_bardeli"],
    "buffet_dining": ["buffet_restaurant", "cafeteria", "food_court", "restaurant"],
    "cafes_tea": ["cafe", "coffee_shop", "tea_house", "cat_cafe", "dog_cafe"],
    "dessert_sweets": ["dessert_restaurant", "dessert_shop", "ice_cream_shop", "donut_shop", "chocolate_shop", "chocolate_factory", "candy_store", "confectionery", "bakery", "bagel_shop"],
    "european": ["italian_restaurant", "spanish_restaurant", "french_restaurant", "greek_restaurant"],
    "fast_food_takeaway": ["fast_food_restaurant", "hamburger_restaurant", "pizza_restaurant", "meal_takeaway", "meal_delivery", "sandwich_shop"],
    "fine_dining": ["fine_dining_restaurant"],
    "latin_american": ["brazilian_restaurant", "mexican_restaurant"],
    "middle_eastern": ["lebanese_restaurant", "turkish_restaurant", "middle_eastern_restaurant", "afghani_restaurant"],
    "other": ["deli"],
    "south_asian": ["indian_restaurant"],
    "vegetarian_healthy": ["vegan_restaurant", "vegetarian_restaurant", "juice_shop", "acai_shop", "confectioneryacai_shop"],
}


def multi_hot(types: Column | str, groups: dict[str, list[str]]) -> Column:
    """MTH8: 1.0 for every group that shares a type with the list, in the order of the groups."""
    return F.array(*[F.coalesce(F.arrays_overlap(col(types), F.array(*map(F.lit, members))), F.lit(False)).cast("double") for members in groups.values()])


def vote_stars(vote: Column | str) -> Column:
    """MTH9: -1, 0, 1 to 1, 3, 5 stars."""
    return F.when(col(vote) == -1, 1.0).when(col(vote) == 0, 3.0).when(col(vote) == 1, 5.0)


def cards_seen(w: Column, mean_round: Column, rank: Column) -> Column:
    """MTH10: cards until consensus, w * (mean round - 1) + rank."""
    return w * (mean_round - 1) + rank


def most_rounds(w: int, budget: int = 100) -> int:
    """MTH11: rounds that a budget of items allows."""
    return math.ceil(budget / w)


def vote_probabilities(score: Column, mean: Column, deviation: Column, low: float, high: float, tau: float, bias: float = 0.0) -> Column:
    """MTH13, CON16, CON17: (dislike, neutral, like) from the z-score of a predicted rating.

    like and dislike are sigmoids of the distance to an upper and a lower threshold, both moved up by the bias; what they
    leave is neutral. Without a z-score the chances are (0.4, 0.2, 0.4).
    """
    z = F.try_divide(score - mean, F.greatest(deviation, F.lit(0.5)))
    like = 1 / (1 + F.exp(-(z - F.lit(high + bias)) / tau))
    dislike = 1 / (1 + F.exp((z - F.lit(low + bias)) / tau))
    neutral = F.greatest(F.lit(0.0), 1 - like - dislike)
    total = like + dislike + neutral
    fallback = F.array(F.lit(0.4), F.lit(0.2), F.lit(0.4))
    return F.when(z.isNull() | F.isnan(z), fallback).otherwise(F.array(dislike / total, neutral / total, like / total))


def hash_uniform(*columns: Column | str, seed: int = 0) -> Column:
    """D7: a reproducible number in [0, 1) from ids."""
    return F.pmod(F.xxhash64(F.lit(seed), *map(col, columns)), F.lit(1_000_003)) / 1_000_003.0


def drawn_vote(probabilities: Column | str, u: Column) -> Column:
    """CON16: the vote of a uniform number: -1, 0 or 1."""
    p = col(probabilities)
    return F.when(u < p[0], -1).when(u < p[0] + p[1], 0).otherwise(1)


def json_int(column: Column | str, path: str, default: int = 0) -> Column:
    """JSN1: a nested number with a default."""
    return F.coalesce(F.get_json_object(col(column), path).cast("bigint"), F.lit(default))


def utc_stamp(ts: Column | str) -> Column:
    """DAT1: UTC time in ISO form (sessions run in UTC)."""
    return F.date_format(col(ts), "yyyy-MM-dd'T'HH:mm:ss'Z'")
