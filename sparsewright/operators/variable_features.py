"""Selection of variable features."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparsewright.matrix import Matrix
from sparsewright.operators.statistics import expm1_statistics, row_moments, standardized_variance

BINS = 20


def dispersion(m: Matrix, bins: int = BINS, statistics: Callable[[Matrix], DataFrame] | None = None) -> DataFrame:
    """(feature, mean, dispersion, bin, dispersion_scaled) on log-normalised values.

    Means fall into equal-width bins, the first of which includes the least
    mean; dispersions are z-scores in their bin, null in a bin of one.
    ``statistics`` gives a (feature, mean, dispersion) of one's own.
    """
    rows = statistics(m) if statistics else expm1_statistics(m).select("feature", F.col("exp_mean").alias("mean"), F.coalesce("log_vmr", F.lit(0.0)).alias("dispersion"))
    span = rows.agg(F.min("mean").alias("low"), F.max("mean").alias("high"))
    width = (F.col("high") - F.col("low")) / bins
    slot = F.when(width > 0, F.greatest(F.lit(1), F.least(F.lit(bins), F.ceil((F.col("mean") - F.col("low")) / F.when(width > 0, width))))).otherwise(1)
    binned = rows.join(F.broadcast(span), how="cross").withColumn("bin", slot.cast("int"))  # one row
    stats = binned.groupBy("bin").agg(F.avg("dispersion").alias("centre"), F.stddev_samp("dispersion").alias("spread"))
    return binned.join(stats, "bin").select("feature", "mean", "dispersion", "bin", F.try_divide(F.col("dispersion") - F.col("centre"), F.when(F.col("spread") > 0, F.col("spread"))).alias("dispersion_scaled"))


def mean_var_plot(m: Matrix, mean_range: tuple[float, float] = (0.1, 8.0), dispersion_range: tuple[float, float] = (1.0, float("inf"))) -> DataFrame:
    """Features strictly inside both ranges, by falling dispersion."""
    rows = dispersion(m)
    inside = (F.col("mean") > mean_range[0]) & (F.col("mean") < mean_range[1]) & (F.col("dispersion_scaled") > dispersion_range[0])
    if dispersion_range[1] != float("inf"):
        inside = inside & (F.col("dispersion_scaled") < dispersion_range[1])
    return ranked(rows.filter(inside), "dispersion")


def ranked(rows: DataFrame, by: str, limit: int | None = None) -> DataFrame:
    """Adds ``rank`` from 1 by falling value, ties by feature; at most ``limit`` rows. The sort is on one row a feature."""
    best = rows.orderBy(F.desc(by), "feature")
    best = best.limit(limit) if limit else best
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(by), "feature")))


def loess_quadratic(x: np.ndarray, y: np.ndarray, span: float = 0.3) -> np.ndarray:
    """Local quadratic fit with tricube weights, at all x."""
    n = len(x)
    k = min(n, max(3, int(np.ceil(span * n))))
    order = np.argsort(x, kind="stable")
    xs, ys = x[order], y[order]
    at = np.unique(xs)
    fitted = np.empty(len(at))
    low = 0
    for i, centre in enumerate(at):
        while low + k < n and xs[low + k] - centre < centre - xs[low]:
            low += 1
        d = xs[low : low + k] - centre
        reach = np.abs(d).max()
        w = np.sqrt((1 - (np.abs(d) / reach) ** 3) ** 3) if reach > 0 else np.ones(k)
        design = np.column_stack([np.ones(k), d, d * d]) * w[:, None]
        fitted[i] = np.linalg.lstsq(design, ys[low : low + k] * w, rcond=None)[0][0]
    return np.interp(x, at, fitted)


def expected_sd(m: Matrix, span: float = 0.3) -> DataFrame:
    """(feature, mean, sd_expected): trend of log variance on log mean. One row a feature is fitted, in one task."""
    stats = row_moments(m).select("feature", "mean", "variance")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        some = (pdf["variance"] > 0).to_numpy()
        sd = np.zeros(len(pdf))
        if some.sum() > 3:
            x, y = np.log10(pdf["mean"].to_numpy()[some]), np.log10(pdf["variance"].to_numpy()[some])
            sd[some] = np.sqrt(10 ** loess_quadratic(x, y, span))
        return pd.DataFrame({"feature": pdf["feature"], "mean": pdf["mean"], "sd_expected": sd})

    kind = m.features.schema["feature"].dataType.simpleString()
    return stats.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(lambda pdf: fit(pdf.sort_values("feature")), f"feature {kind}, mean double, sd_expected double")


def vst(m: Matrix, n_select: int = 2000, span: float = 0.3) -> DataFrame:
    """(feature, variance_standardized, rank) of the top features by variance of clipped standardised counts."""
    return ranked(standardized_variance(m, expected_sd(m, span)), "variance_standardized", n_select)


def top_dispersion(m: Matrix, n_select: int = 2000) -> DataFrame:
    return ranked(dispersion(m).select("feature", "dispersion"), "dispersion", n_select)


METHODS: dict[str, Callable[[Matrix, int], DataFrame]] = {
    "vst": vst,
    "disp": top_dispersion,
    "mvp": lambda m, n: mean_var_plot(m),
}


def find_variable_features(m: Matrix, method: str | Callable[[Matrix], DataFrame] = "vst", n_select: int = 2000) -> DataFrame:
    """Ranked features by a named method, or by the score of any function that gives (feature, score)."""
    if callable(method):
        return ranked(method(m), "score", n_select)
    if method not in METHODS:
        raise ValueError(f"unknown method: {method}")
    return METHODS[method](m, n_select)


def select_shared(ranks: DataFrame, n_select: int, datasets: int) -> DataFrame:
    """From (dataset, feature, rank): features by the number of datasets that list them, then median rank, then id."""
    by = ranks.groupBy("feature").agg(F.count_distinct("dataset").alias("n_datasets"), F.percentile("rank", 0.5).alias("median_rank")).filter(F.col("n_datasets") <= datasets)
    return by.orderBy(F.desc("n_datasets"), "median_rank", "feature").limit(n_select)
