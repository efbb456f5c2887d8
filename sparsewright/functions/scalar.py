"""Column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def min_max(x: Column, low: float, high: float) -> Column:
    """Clamp; null stays null."""
    return F.when(x < low, F.lit(low)).when(x > high, F.lit(high)).otherwise(x)


def relu(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def percent_above(x: Column, threshold: float) -> Column:
    """Aggregate: share of rows strictly above; nulls count below the line."""
    return F.sum(F.when(x > threshold, 1).otherwise(0)) / F.count(F.lit(1))


def exp_mean(total_expm1: Column, n: Column | int) -> Column:
    """log1p of the mean of expm1 values from their sum."""
    return F.log1p(total_expm1 / n)


def extract_field(x: Column, fields: list[int], delim: str = "_") -> Column:
    """Fields (from 1) of a delimited string, joined again."""
    parts = F.split(x, f"\\Q{delim}\\E")
    return F.array_join(F.array_compact(F.array(*(F.get(parts, f - 1) for f in fields))), delim)


def remove_last_field(x: Column, delim: str = "_") -> Column:
    """The string without its last delimited field; whole if it has one only."""
    parts = F.split(x, f"\\Q{delim}\\E")
    return F.when(F.size(parts) > 1, F.array_join(F.slice(parts, 1, F.size(parts) - 1), delim)).otherwise(x)


def mean_range(x: Column) -> Column:
    """Midpoint of the two numbers in a textual interval such as (1,3]."""
    numbers = F.regexp_extract_all(x, F.lit(r"(-?[0-9.]+)"), 1)
    return (F.get(numbers, 0).cast("double") + F.get(numbers, 1).cast("double")) / 2


def to_numeric(x: Column) -> Column:
    """``a:b`` as the range's integers, any other number as an array of one, else null."""
    span = F.regexp_extract_all(x, F.lit(r"^(-?\d+):(-?\d+)$"), 1)
    upper = F.regexp_extract_all(x, F.lit(r"^(-?\d+):(-?\d+)$"), 2)
    ranged = F.sequence(F.get(span, 0).cast("int"), F.get(upper, 0).cast("int")).cast("array<double>")
    return F.when(F.size(span) > 0, ranged).otherwise(F.array(x.try_cast("double")))


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def l2_norm(x: Column) -> Column:
    return F.sqrt(dot(x, x))


def l2_normalize(x: Column) -> Column:
    """Vector over its norm; zeros where that is not finite."""
    n = l2_norm(x)
    return F.when(n > 0, F.transform(x, lambda v: v / n)).otherwise(F.transform(x, lambda v: F.lit(0.0)))


def euclidean(x: Column, y: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))


def project_vec(x: Column, onto: Column) -> Column:
    return F.try_divide(dot(x, onto), dot(onto, onto))


def unique_names(rows: DataFrame, name: str, order: str) -> DataFrame:
    """Repeated names get .1, .2, ... from the second on, in ``order``."""
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy(name).orderBy(order)) - 1
    return rows.withColumn(name, F.when(k > 0, F.concat_ws(".", F.col(name), k)).otherwise(F.col(name)))
