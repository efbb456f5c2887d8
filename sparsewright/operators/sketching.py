"""Sketches of cells and features. Random draws are hashes of ids and a seed."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparsewright.operators.reduction import gram, leading, project


def unit_draw(*keys: Column) -> Column:
    """A number in (0, 1) from a hash."""
    return (F.pmod(F.xxhash64(*keys), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)


def count_sketch(values: DataFrame, rows: int, seed: int = 123) -> DataFrame:
    """(feature, bucket, value): each cell goes to one bucket with a sign."""
    h = F.xxhash64("cell", F.lit(seed))
    sign = F.when(F.pmod(F.shiftright(h, 7), F.lit(2)) == 0, 1.0).otherwise(-1.0)
    return values.select("feature", F.pmod(h, F.lit(rows)).alias("bucket"), (F.col("value") * sign).alias("v")).groupBy("feature", "bucket").agg(F.sum("v").alias("value"))


def sketch_with(values: DataFrame, hashes: DataFrame) -> DataFrame:
    """The same with given (cell, bucket, sign)."""
    return values.join(hashes, "cell").groupBy("feature", "bucket").agg(F.sum(F.col("value") * F.col("sign")).alias("value"))


def leverage_exact(vectors: DataFrame, k: int = 50) -> DataFrame:
    """(cell, leverage): squared norms of the cells' rows in the top k left singular vectors."""
    w, v = leading(gram(vectors), k)
    ok = w > 1e-10 * max(w.max(), 1e-300)
    rows = project(vectors, v[:, ok] / np.sqrt(w[ok]))
    return rows.select("cell", F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x).alias("leverage"))


def leverage_sketched(vectors: DataFrame, buckets: int = 5000, eps: float = 0.5, seed: int = 123) -> DataFrame:
    """(cell, leverage) by a count sketch of the cells, its QR factor, and a sparse random projection: one pass for the sketch, one for the scores."""
    dims = len(vectors.select("vector").first()[0])
    h = F.xxhash64("cell", F.lit(seed))
    rows = vectors.select(F.pmod(h, F.lit(buckets)).alias("b"), F.when(F.pmod(F.shiftright(h, 7), F.lit(2)) == 0, 1.0).otherwise(-1.0).alias("s"), F.posexplode("vector").alias("d", "x"))
    summed = rows.groupBy("b", "d").agg(F.sum(F.col("s") * F.col("x")).alias("x")).groupBy(F.col("b").alias("cell")).agg(F.array_sort(F.collect_list(F.struct("d", "x"))).alias("p")).select("cell", F.col("p.x").alias("vector"))
    g = gram(summed)  # R'R of the sketch
    w, v = np.linalg.eigh(g)
    ok = w > 1e-10 * w.max()
    inverse = v[:, ok] / np.sqrt(w[ok])
    columns = min(int(ok.sum()), max(1, int(4 * np.log(dims) / (eps**2 / 2 - eps**3 / 3))))
    jl = np.random.default_rng(seed).choice([-1.0, 0.0, 1.0], p=[1 / 6, 2 / 3, 1 / 6], size=(inverse.shape[1], columns)) * np.sqrt(3 / columns)
    out = project(vectors, inverse @ jl)
    return out.select("cell", F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x).alias("leverage"))


def weighted_sample(rows: DataFrame, weight: str, n: int, seed: int = 1) -> DataFrame:
    """n rows without replacement, with chances that follow the weight: the largest of log(u) / weight."""
    key = F.log(unit_draw(F.col("cell"), F.lit(seed))) / F.col(weight)
    return rows.filter(F.col(weight) > 0).withColumn("key", key).orderBy(F.desc("key"), "cell").limit(n).drop("key")


def sketch_cells(vectors: DataFrame, n: int, method: str | Callable[[DataFrame], DataFrame] = "leverage", seed: int = 1) -> DataFrame:
    """(cell) ids of a sketch by leverage or uniform chances, or by those that a function gives as (cell, leverage)."""
    scores = method(vectors) if callable(method) else leverage_exact(vectors) if method == "leverage" else vectors.select("cell", F.lit(1.0).alias("leverage"))
    return weighted_sample(scores, "leverage", n, seed).select("cell")


def unsketch(embeddings: DataFrame, atoms: DataFrame, every: DataFrame, ridge: float = 1e-6) -> DataFrame:
    """Embeddings of the sketch's cells carried to all cells by the linear map from the cells' vectors that fits best on the sketch."""
    both = atoms.join(embeddings.select("cell", F.col("vector").alias("e")), "cell")
    g = gram(both)
    cross = gram(both, "e")
    return project(every, np.linalg.solve(g + ridge * np.trace(g) / len(g) * np.eye(len(g)), cross))


def jl_matrix(columns: int, eps: float = 0.5, seed: int = 1) -> pd.DataFrame:
    """Sparse random projection with entries -1, 0, 1 as (row, column, value)."""
    rows = int(4 * np.log(columns) / (eps**2 / 2 - eps**3 / 3))
    m = np.random.default_rng(seed).choice([-1.0, 0.0, 1.0], p=[1 / 6, 2 / 3, 1 / 6], size=(rows, columns)) * np.sqrt(3 / rows)
    i, j = np.nonzero(m)
    return pd.DataFrame({"row": i, "column": j, "value": m[i, j]})
