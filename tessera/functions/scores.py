"""Vector and score columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.config import DEFAULT, Settings


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def normalized(v: Column) -> Column:
    """v over its length; a zero vector stays."""
    length = F.sqrt(dot(v, v))
    return F.transform(doubles(v), lambda x: F.when(length > 0, x / length).otherwise(x))


def sigmoid(score: Column) -> Column:
    return 1 / (1 + F.exp(-score))


def distance(score: Column, scale: str) -> Column:
    """Cosine distance from what a store calls score: exp(-d) on the `exp` scale, 1 - d otherwise."""
    return -F.log(score) if scale == "exp" else 1 - score


def percent(part: Column, total: Column) -> Column:
    """100 part / total to one decimal, 0 of nothing."""
    return F.when(total == 0, F.lit(0.0)).otherwise(F.round(100.0 * part / total, 1))


def to_decimals(score, places: int) -> Column:
    """score with so many decimals, judged by its exact binary value, ties to even."""
    return F.call_function("format_number", F.col(score) if isinstance(score, str) else score, F.lit("0." + "0" * places)).cast("double")


def confidence(best: Column, settings: Settings = DEFAULT) -> Column:
    """Level of a best score, judged after rounding to three decimals."""
    r = F.round(best, 3)
    return F.when(r >= settings.confidence_high, "alta").when(r >= settings.confidence_medium, "media").otherwise("baja")
