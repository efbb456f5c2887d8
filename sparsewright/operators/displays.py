"""The tables behind displays: what a plot would show, as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparsewright.functions.scalar import min_max
from sparsewright.matrix import Matrix
from sparsewright.operators.objects import picked


def elbow(deviations: DataFrame) -> DataFrame:
    """(dim, sd, percent, cumulative) from (dim, sd): shares of the variance, in per cent."""
    variance = F.col("sd") * F.col("sd")
    percent = 100 * variance / F.sum(variance).over(Window.partitionBy())
    rows = deviations.select("dim", "sd", percent.alias("percent"))
    return rows.withColumn("cumulative", F.sum("percent").over(Window.orderBy("dim").rowsBetween(Window.unboundedPreceding, 0)))


def without_outliers(embedding: DataFrame, ident: str, dims: list[str], outlier_sd: float = 2.0) -> DataFrame:
    """``embedding`` with identities moved by whole steps where the z-score of their median passes ``outlier_sd``.

    Per dimension, an identity whose median lies z standard deviations from the
    mean of the medians, |z| >= outlier_sd, moves back by (|z| - outlier_sd)
    standard deviations; an identity whose least move over the dimensions is 0 stays.
    """
    medians = embedding.groupBy(ident).agg(*(F.median(d).alias(d) for d in dims))
    about = Window.partitionBy()
    moves = medians
    for d in dims:
        sd = F.stddev("med").over(about)
        z = F.try_divide(F.col("med") - F.avg("med").over(about), sd)
        step = F.when(F.abs("z") >= outlier_sd, F.signum("z") * (F.abs("z") - outlier_sd) * F.col("sd")).otherwise(0.0)
        moves = moves.withColumnRenamed(d, "med").withColumn("z", z).withColumn("sd", sd).withColumn(f"move_{d}", step).drop("med", "z", "sd")
    rows = embedding.join(F.broadcast(moves.withColumn("least", F.least(*(f"move_{d}" for d in dims)) if len(dims) > 1 else F.col(f"move_{dims[0]}"))), ident)  # a row an identity
    return rows.withColumns({d: F.when(F.col("least") != 0, F.col(d) - F.col(f"move_{d}")).otherwise(F.col(d)) for d in dims}).drop("least").drop(*(f"move_{d}" for d in dims))


def feature_scatter(m: Matrix, first, second) -> DataFrame:
    """(cell, x, y, r): two features' values in all cells, and their correlation."""
    one = m.values.filter(F.col("feature").isin(first, second)).groupBy("cell").agg(F.sum(F.when(F.col("feature") == first, F.col("value"))).alias("x"), F.sum(F.when(F.col("feature") == second, F.col("value"))).alias("y"))
    rows = m.cells.select("cell").join(one, "cell", "left").fillna(0.0, ["x", "y"])
    return rows.withColumn("r", F.corr("x", "y").over(Window.partitionBy()))


def cell_scatter(m: Matrix, first, second) -> DataFrame:
    """(feature, x, y, r): two cells' values of all features, and their correlation."""
    one = m.values.filter(F.col("cell").isin(first, second)).groupBy("feature").agg(F.sum(F.when(F.col("cell") == first, F.col("value"))).alias("x"), F.sum(F.when(F.col("cell") == second, F.col("value"))).alias("y"))
    rows = m.features.select("feature").join(one, "feature", "left").fillna(0.0, ["x", "y"])
    return rows.withColumn("r", F.corr("x", "y").over(Window.partitionBy()))


def by_identity(m: Matrix, features: list, ident: str) -> DataFrame:
    """(feature, cell, ident, value) of some features in all cells with an identity, zeros included: violins and ridges."""
    cells = m.cells.filter(F.col(ident).isNotNull()).select("cell", F.col(ident).alias("ident"))
    wanted = cells.withColumn("feature", F.explode(F.lit(features))).withColumn("feature", F.col("feature").cast(m.values.schema["feature"].dataType))
    held = m.values.filter(F.col("feature").isin(features))
    return wanted.join(held, ["feature", "cell"], "left").select("feature", "cell", "ident", F.coalesce("value", F.lit(0.0)).alias("value"))


def heatmap(scaled: DataFrame, cells: DataFrame, features: list, ident: str, limit: float = 2.5) -> DataFrame:
    """(feature, cell, ident, value): scaled values of some features, held within the limits."""
    rows = scaled.filter(F.col("feature").isin(features)).join(cells.select("cell", F.col(ident).alias("ident")), "cell")
    return rows.select("feature", "cell", "ident", min_max(F.col("value"), -limit, limit).alias("value"))


def dim_heatmap(loadings: DataFrame, embedding: DataFrame, values: DataFrame, dim: int, n_features: int = 30, n_cells: int = 500) -> DataFrame:
    """(feature, cell, value): values of the features of largest loadings on either side in the cells of largest scores on either side.

    ``loadings``: (feature, dim, value); ``embedding``: (cell, dim, value); pairs without a stored value have no row.
    """
    from sparsewright.operators.verbs import top

    f = top(loadings.filter(F.col("dim") == dim), "value", n_features).select("feature")
    c = top(embedding.filter(F.col("dim") == dim), "value", n_cells, key="cell").select("cell")
    return values.join(F.broadcast(f), "feature").join(F.broadcast(c), "cell").select("feature", "cell", "value")  # n_features and n_cells rows


def sampled_by_class(cells: DataFrame, column: str, n: int, seed: int = 1) -> DataFrame:
    """(cell, class): at most n cells a class, by hash order: the feature is the sample."""
    first = F.row_number().over(Window.partitionBy(column).orderBy(F.xxhash64("cell", F.lit(seed)), "cell"))
    return cells.select("cell", F.col(column).alias("class"), first.alias("k")).filter(F.col("k") <= n).select("cell", "class")


def blended(m: Matrix, first, second) -> DataFrame:
    """(cell, a, b, blend): two features' values as whole steps of 0 to 9 between their least and greatest, and a + 10 b."""
    rows = feature_scatter(m, first, second).select("cell", "x", "y")
    about = Window.partitionBy()
    step = lambda c: F.coalesce(F.bround(9 * F.try_divide(F.col(c) - F.min(c).over(about), F.max(c).over(about) - F.min(c).over(about))), F.lit(0)).cast("int")
    rows = rows.select("cell", step("x").alias("a"), step("y").alias("b"))
    return rows.withColumn("blend", F.col("a") + 10 * F.col("b"))


def feature_table(m: Matrix, features: list, cells: list) -> DataFrame:
    """(feature, cell, value) of a rectangle, zeros included."""
    return picked(m, features, cells)
