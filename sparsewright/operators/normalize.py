"""Normalisation of stored entries. Zeros stay zeros, so none of these densifies."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import functions as F

from sparsewright.matrix import Matrix


def cell_totals(m: Matrix):
    return m.values.groupBy("cell").agg(F.sum("value").alias("total"))


def relative_counts(m: Matrix, scale_factor: float = 1.0) -> Matrix:
    """x over the cell's total, times the factor (1: fractions, 1e6: per million)."""
    rows = m.values.join(cell_totals(m), "cell")
    return m.with_values(rows.select("feature", "cell", (F.col("value") / F.col("total") * scale_factor).alias("value")))


def log_normalize(m: Matrix, scale_factor: float = 1e4) -> Matrix:
    """log1p of the relative counts."""
    out = relative_counts(m, scale_factor)
    return m.with_values(out.values.withColumn("value", F.log1p("value")))


def clr(m: Matrix, margin: int = 1) -> Matrix:
    """Centred log ratio within features (1) or cells (2); the geometric mean's divisor counts the zeros."""
    by, n = ("feature", m.n_cells) if margin == 1 else ("cell", m.n_features)
    scale = m.values.filter("value > 0").groupBy(by).agg(F.exp(F.sum(F.log1p("value")) / n).alias("scale"))
    rows = m.values.join(scale, by)
    return m.with_values(rows.select("feature", "cell", F.log1p(F.col("value") / F.col("scale")).alias("value")))


def custom(m: Matrix, each: Callable[[pd.Series], pd.Series], by: str = "cell") -> Matrix:
    """A user's function over the stored values of each cell or feature."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.assign(value=each(pdf["value"]).astype("float64"))

    return m.with_values(m.values.groupBy(by).applyInPandas(run, m.values.schema))


def normalize(m: Matrix, method: str | None = "LogNormalize", scale_factor: float = 1e4, margin: int = 1) -> Matrix:
    if method is None:
        return m
    if method == "LogNormalize":
        return log_normalize(m, scale_factor)
    if method == "CLR":
        return clr(m, margin)
    if method == "RC":
        return relative_counts(m, scale_factor)
    raise ValueError(f"unknown normalisation method: {method}")


def sample_counts(m: Matrix, target: float, upsample: bool = False, seed: int = 42) -> Matrix:
    """Cells with more than ``target`` counts (all, if upsampling) are scaled to it and rounded at random by the fraction.

    The draw is a hash of feature, cell and seed: the same on every run.
    """
    rows = m.values.join(cell_totals(m), "cell")
    x = F.col("value") * target / F.col("total")
    draw = F.pmod(F.xxhash64("feature", "cell", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    rounded = F.floor(x) + F.when(x - F.floor(x) > draw, 1).otherwise(0)
    changes = (F.col("total") > target) | F.lit(upsample)
    value = F.when(changes, rounded).otherwise(F.col("value")).cast("double")
    return m.with_values(rows.select("feature", "cell", value.alias("value")).filter("value != 0"))
