"""Tag demultiplexing and perturbation scores."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparsewright.functions.distributions import negbinom_quantile
from sparsewright.matrix import Matrix
from sparsewright.plans.scratch import cut


def tag_cutoffs(m: Matrix, clusters: DataFrame, quantile: float = 0.99) -> DataFrame:
    """(feature, cutoff): for each tag, a negative binomial is fitted to its cluster of least mean; the cutoff is its quantile. The 0.5 % largest values are left out."""
    dense = m.dense().join(clusters, "cell")
    means = dense.groupBy("feature", "cluster").agg(F.avg("value").alias("m"))
    first = F.row_number().over(Window.partitionBy("feature").orderBy("m", "cluster"))
    low = means.withColumn("k", first).filter("k = 1").select("feature", "cluster")
    stats = dense.join(low, ["feature", "cluster"])
    top = stats.groupBy("feature").agg(F.percentile("value", 0.995).alias("top"))
    kept = stats.join(top, "feature").filter(F.col("value") <= F.col("top")).groupBy("feature").agg(F.avg("value").alias("mu"), F.sum((F.col("value") * F.col("value"))).alias("q"), F.count(F.lit(1)).alias("n"))

    def quantiles(frames):
        for pdf in frames:
            out = []
            for mu, q, n in zip(pdf["mu"], pdf["q"], pdf["n"], strict=True):
                over = q - n * mu * mu - n * mu
                out.append(float(negbinom_quantile(quantile, mu, n * mu * mu / over if over > 0 else math.inf)))
            yield pd.DataFrame({"feature": pdf["feature"], "cutoff": out})

    kind = m.features.schema["feature"].dataType.simpleString()
    return kept.mapInPandas(quantiles, f"feature {kind}, cutoff double")


def classify_tags(values: DataFrame, cells: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """(cell, n_tags, classification, max_tag, second_tag, margin): tags strictly above their cutoffs make Negative, Singlet or Doublet; first tag of ties."""
    tags = cutoffs.select("feature", "cutoff")
    rows = cells.select("cell").join(tags, how="cross").join(values, ["feature", "cell"], "left").select("cell", "feature", "cutoff", F.coalesce("value", F.lit(0.0)).alias("value"))
    w = Window.partitionBy("cell").orderBy(F.desc("value"), "feature")
    rows = rows.withColumn("k", F.row_number().over(w))
    out = rows.groupBy("cell").agg(
        F.sum(F.when(F.col("value") > F.col("cutoff"), 1).otherwise(0)).alias("n_tags"),
        F.max(F.when(F.col("k") == 1, F.struct("feature", "value"))).alias("a"),
        F.max(F.when(F.col("k") == 2, F.struct("feature", "value"))).alias("b"),
    )
    kind = F.when(F.col("n_tags") == 0, "Negative").when(F.col("n_tags") == 1, "Singlet").otherwise("Doublet")
    return out.select("cell", "n_tags", kind.alias("classification"), F.col("a.feature").alias("max_tag"), F.col("b.feature").alias("second_tag"), (F.col("a.value") - F.col("b.value")).alias("margin"))


def density_threshold(x: np.ndarray, q: float, count: np.ndarray | None = None) -> float:
    """Point at share q between the lowest large mode and the highest mode of a kernel density; infinite with one mode. ``count`` tells how often each value occurs."""
    count = np.ones(len(x), dtype=np.int64) if count is None else count
    some = np.isfinite(x)
    order = np.argsort(x[some], kind="stable")
    x, count = x[some][order], count[some][order]
    n, upto = int(count.sum()), np.cumsum(count)

    def quantile(share: float) -> float:
        at = share * (n - 1)
        low, high = x[np.searchsorted(upto, [np.floor(at), np.ceil(at)], side="right")]
        return low + (high - low) * (at - np.floor(at))

    sd = 0
    if n > 1:
        mean = (x * count).sum() / n
        sd = min(np.sqrt((count * (x - mean) ** 2).sum() / (n - 1)), (quantile(0.75) - quantile(0.25)) / 1.34 or np.inf)
    if not sd or not np.isfinite(sd):
        return float("inf")
    h = 0.9 * sd * n**-0.2
    grid = np.linspace(x.min() - 3 * h, x.max() + 3 * h, 256)
    y = np.zeros(len(grid))
    for lo in range(0, len(x), 16384):
        y += np.exp(-0.5 * ((grid[:, None] - x[None, lo : lo + 16384]) / h) ** 2) @ count[lo : lo + 16384]
    modes = np.flatnonzero((y[1:-1] > y[:-2]) & (y[1:-1] >= y[2:])) + 1
    if len(modes) < 2:
        return float("inf")
    low, high = modes[np.argmax(y[modes])], modes[-1]
    if low == high:
        low = modes[0]
    a, b = sorted((grid[low], grid[high]))
    return float(a + q * (b - a))


def multiseq(m: Matrix, quantile: float = 0.7) -> DataFrame:
    """(cell, n_tags, classification, ...): tags above density thresholds of centred log-ratio values."""
    from sparsewright.operators.normalize import clr

    x = clr(m, 1)
    kind = m.features.schema["feature"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"feature": pdf["feature"].iloc[:1], "cutoff": [density_threshold(pdf["value"].to_numpy(), quantile, pdf["count"].to_numpy())]})

    # all cells count; a tag's group has a row for each different value
    counted = x.dense().groupBy("feature", "value").count()
    return classify_tags(x.values, m.cells, counted.groupBy("feature").applyInPandas(run, f"feature {kind}, cutoff double"))


def perturbation_signature(values: DataFrame, neighbors: DataFrame) -> DataFrame:
    """(cell, feature, value): log1p of the mean expm1 over nearest control cells, less the cell's own log value."""
    size = neighbors.groupBy("query").agg(F.count(F.lit(1)).alias("k"))
    means = neighbors.join(values.select(F.col("cell").alias("neighbor"), "feature", F.expm1("value").alias("v")), "neighbor").groupBy(F.col("query").alias("cell"), "feature").agg(F.sum("v").alias("s"))
    means = means.join(size.withColumnRenamed("query", "cell"), "cell").select("cell", "feature", F.log1p(F.col("s") / F.col("k")).alias("control"))
    own = values.join(size.select(F.col("query").alias("cell")), "cell", "left_semi").select("cell", "feature", "value")
    return means.join(own, ["cell", "feature"], "full").select("cell", "feature", (F.coalesce("control", F.lit(0.0)) - F.coalesce("value", F.lit(0.0))).alias("value"))


def two_normals(x: np.ndarray, mu0: float, sd0: float, rounds: int = 200) -> np.ndarray:
    """Posterior of the second component of a normal mixture whose first has the control's mean and deviation (mu0, sd0)."""
    mu1, sd1, share = np.quantile(x, 0.9), max(x.std(), 1e-6), 0.5
    normal = lambda v, mu, sd: np.exp(-0.5 * ((v - mu) / sd) ** 2) / sd
    post = np.full(len(x), 0.5)
    for _ in range(rounds):
        a, b = (1 - share) * normal(x, mu0, sd0), share * normal(x, mu1, sd1)
        new = b / np.maximum(a + b, 1e-300)
        if np.abs(new - post).max() < 1e-6:
            break
        post = new
        if post.sum() < 1e-6:
            break
        share = post.mean()
        mu1 = (post * x).sum() / post.sum()
        sd1 = max(np.sqrt((post * (x - mu1) ** 2).sum() / post.sum()), 1e-3)
    return post


def mixscape(scores: DataFrame, control: str, least: int = 5) -> DataFrame:
    """(cell, target, posterior, class) from (cell, target, score): perturbed if the posterior passes one half."""
    mean, sd = scores.filter(F.col("target") == control).agg(F.avg("score"), F.stddev_samp("score")).first()
    mean, sd = float("nan") if mean is None else mean, 1.0 if sd is None else max(sd, 1e-6)
    kind = scores.schema["cell"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf["score"].to_numpy()
        post = two_normals(x, mean, sd) if len(x) >= least else np.zeros(len(x))
        return pd.DataFrame({"cell": pdf["cell"], "target": pdf["target"], "posterior": post, "class": np.where(post > 0.5, "perturbed", "not perturbed")})

    rest = scores.filter(F.col("target") != control).groupBy("target").applyInPandas(run, f"cell {kind}, target string, posterior double, class string")
    return rest.unionByName(scores.filter(F.col("target") == control).select("cell", "target", F.lit(0.0).alias("posterior"), F.lit("control").alias("class")))


def missing_signatures(values: DataFrame, neighbors: DataFrame, known: DataFrame, features: DataFrame) -> DataFrame:
    """``known`` (cell, feature, value) signatures with those of requested features that it lacks."""
    lacking = features.select("feature").distinct().join(known.select("feature").distinct(), "feature", "left_anti")
    fresh = perturbation_signature(values.join(lacking, "feature", "left_semi"), neighbors)
    return known.select("cell", "feature", "value").unionByName(fresh)


def perturbation_markers(m: Matrix, column: str, target, control, cutoff: float = 0.05, logfc_threshold: float = 0.25) -> DataFrame:
    """(feature, p_val_adj) of a target's cells against the controls, significant ones only."""
    from sparsewright.operators.differential import find_markers

    rows = find_markers(m, column, target, control, min_pct=0.1, logfc_threshold=logfc_threshold)
    return rows.filter(F.col("p_val_adj") < cutoff).select("feature", "p_val_adj")


def perturbation_space(m: Matrix, column: str, control, dims: int = 10, cutoff: float = 0.05, least: int = 5) -> DataFrame:
    """(cell, vector): all cells in the components of every target that has enough markers, one after another.

    A target's components are those of its own and the controls' cells over its
    markers; all cells are projected. The loop is over targets.
    """
    from sparsewright.operators.reduction import pca, project, vectors_of

    targets = [r[0] for r in m.cells.select(column).distinct().orderBy(column).collect() if r[0] is not None and r[0] != control]
    out = None
    for k, target in enumerate(targets):
        markers = perturbation_markers(m, column, target, control, cutoff)
        if markers.count() < least:
            continue
        vectors, _ = vectors_of(m.select_features(markers).dense())
        fitted = vectors.join(m.cells.filter(F.col(column).isin(target, control)).select("cell"), "cell", "left_semi")
        _, loadings, _ = pca(fitted, dims, recentre=True)
        one = project(vectors, loadings).withColumnRenamed("vector", f"v{k}")
        out = one if out is None else out.join(one, "cell")
    if out is None:
        raise ValueError("no target has enough markers")
    return out.select("cell", F.concat(*(c for c in out.columns if c != "cell")).alias("vector"))


def perturbation_lda(m: Matrix, column: str, control, dims: int = 10, cutoff: float = 0.05, least: int = 5) -> DataFrame:
    """(cell, vector): discriminants of the targets in that space."""
    from sparsewright.operators.reduction import lda

    space = cut(perturbation_space(m, column, control, dims, cutoff, least), "space")
    return lda(space, m.cells.filter(F.col(column).isNotNull()).select("cell", F.col(column).alias("label")))[0]
