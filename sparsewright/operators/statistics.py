"""Row and cell statistics that count implicit zeros."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparsewright.matrix import Matrix


def _double(x: float | int) -> Column:
    return F.lit(float(x))


def spread_of(s: Column, q: Column, n: Column) -> Column:
    """Variance (n - 1) from sum, sum of squares and number; what rounding leaves of a constant row is 0."""
    v = F.try_divide(q - s * s / n, n - 1)
    return F.when(v > 1e-12 * q, v).otherwise(F.when(n > 1, F.lit(0.0)))


def row_moments(m: Matrix) -> DataFrame:
    """(feature, total, mean, variance) over all cells, variance with n - 1; features without entries have zeros."""
    n = m.n_cells
    sums = m.values.groupBy("feature").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"))
    s, q = F.coalesce("s", _double(0)), F.coalesce("q", _double(0))
    variance = spread_of(s, q, F.lit(n)) if n > 1 else F.lit(None).cast("double")
    return m.features.select("feature").join(sums, "feature", "left").select("feature", s.alias("total"), (s / n).alias("mean"), variance.alias("variance"))


def row_mean_sd(m: Matrix, floor: float = 1e-8) -> DataFrame:
    rows = row_moments(m)
    return rows.select("feature", "mean", F.greatest(F.sqrt("variance"), _double(floor)).alias("sd"))


def expm1_statistics(m: Matrix) -> DataFrame:
    """(feature, exp_mean, exp_var, exp_sd, log_vmr): log-space summaries of expm1 values; log_vmr is null for a zero mean or variance."""
    linear = m.with_values(m.values.withColumn("value", F.expm1("value")))
    rows = row_moments(linear)
    ok = (F.col("mean") > 0) & (F.col("variance") > 0)
    ratio = F.when(ok, F.log(F.col("variance") / F.when(ok, F.col("mean"))))
    return rows.select("feature", F.log1p("mean").alias("exp_mean"), F.log1p("variance").alias("exp_var"), F.log1p(F.sqrt("variance")).alias("exp_sd"), ratio.alias("log_vmr"))


def standardized_variance(m: Matrix, expected: DataFrame, clip: float | None = None) -> DataFrame:
    """Variance of standardised values, clipped above, given (feature, mean, sd_expected); 0 where sd_expected is 0."""
    n = m.n_cells
    top = float(n) ** 0.5 if clip is None else clip
    joined = m.values.join(expected, "feature").filter("sd_expected > 0")
    z = F.least(_double(top), (F.col("value") - F.col("mean")) / F.col("sd_expected"))
    held = joined.groupBy("feature").agg(F.sum(z * z).alias("q"), F.count(F.lit(1)).alias("k"))
    zero = (F.lit(n) - F.coalesce("k", F.lit(0))) * F.pow(F.col("mean") / F.col("sd_expected"), F.lit(2.0))
    value = F.when(F.col("sd_expected") > 0, (F.coalesce("q", _double(0)) + zero) / (n - 1)).otherwise(0.0)
    return expected.join(held, "feature", "left").select("feature", value.alias("variance_standardized"))


def qc(m: Matrix) -> DataFrame:
    """(cell, n_count, n_feature) of every cell."""
    sums = m.values.filter("value != 0").groupBy("cell").agg(F.sum("value").alias("n_count"), F.count(F.lit(1)).alias("n_feature"))
    return m.cells.select("cell").join(sums, "cell", "left").select("cell", F.coalesce("n_count", _double(0)).alias("n_count"), F.coalesce("n_feature", F.lit(0)).alias("n_feature"))


def percentage_feature_set(m: Matrix, chosen: DataFrame) -> DataFrame:
    """(cell, percent): counts of the chosen features in each cell's total; null for an empty cell."""
    marked = m.values.join(chosen.select("feature", F.lit(1).alias("in_set")), "feature", "left")
    sums = marked.groupBy("cell").agg(F.sum(F.when(F.col("in_set") == 1, F.col("value")).otherwise(0.0)).alias("s"), F.sum("value").alias("t"))
    return m.cells.select("cell").join(sums, "cell", "left").select("cell", F.try_divide(F.lit(100.0) * F.col("s"), F.col("t")).alias("percent"))


def meta_feature(m: Matrix, chosen: DataFrame) -> DataFrame:
    """(cell, score): mean over the chosen features of the value's share of its row."""
    rows = m.values.join(chosen.select("feature"), "feature", "left_semi")
    totals = rows.groupBy("feature").agg(F.sum("value").alias("row_total"))
    k = totals.count()
    shares = rows.join(totals, "feature").groupBy("cell").agg(F.sum(F.col("value") / F.col("row_total")).alias("s"))
    return m.cells.select("cell").join(shares, "cell", "left").select("cell", (F.coalesce("s", _double(0)) / max(1, k)).alias("score"))
