"""Pseudobulk, group tables and per-cell scores."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparsewright.functions.hashes import INT, LONG, hash_of
from sparsewright.matrix import Matrix
from sparsewright.operators.statistics import row_moments
from sparsewright.plans.scratch import cut


def group_label(columns: list[str]) -> Column:
    """Group name of several cell columns: ``_`` in labels becomes ``-``, parts are joined by ``_``, a leading digit gets a ``g``."""
    parts = [F.translate(F.col(c).cast("string"), "_", "-") for c in columns]
    name = F.concat_ws("_", *parts)
    return F.when(name.rlike("^[0-9]"), F.concat(F.lit("g"), name)).otherwise(name)


def grouped_cells(m: Matrix, by: list[str]) -> DataFrame:
    """(cell, grp), without cells that lack a grouping value."""
    some = m.cells.filter(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in by]))
    return some.select("cell", group_label(by).alias("grp"))


def pseudobulk(m: Matrix, by: list[str], method: str = "average", layer: str = "counts") -> DataFrame:
    """(feature, grp, value): sums, or means over all cells of the group; a ``data`` layer is taken out of log space first for means. Zero groups of a feature have rows."""
    cells = grouped_cells(m, by)
    x = F.expm1("value") if layer == "data" and method == "average" else F.col("value")
    sums = m.values.join(cells, "cell").groupBy("feature", "grp").agg(F.sum(x).alias("s"))
    sizes = cells.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    grid = m.features.select("feature").join(F.broadcast(sizes) if len(by) == 1 else sizes, how="cross").join(sums, ["feature", "grp"], "left")
    total = F.coalesce("s", F.lit(0.0))
    return grid.select("feature", "grp", (total / F.col("n") if method == "average" else total).alias("value"))


def dot_plot(m: Matrix, by: str, features: DataFrame) -> DataFrame:
    """(feature, grp, avg_exp, pct_exp, avg_scaled): mean of expm1, share above 0 in percent, log1p mean scaled over groups and clamped to 2.5."""
    sub = m.select_features(features)
    cells = grouped_cells(sub, [by])
    sizes = cells.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    sums = sub.values.join(cells, "cell").groupBy("feature", "grp").agg(F.sum(F.expm1("value")).alias("s"), F.sum(F.when(F.col("value") > 0, 1).otherwise(0)).alias("k"))
    grid = sub.features.select("feature").join(sizes, how="cross").join(sums, ["feature", "grp"], "left").fillna(0, ["s", "k"])
    rows = grid.select("feature", "grp", (F.col("s") / F.col("n")).alias("avg_exp"), (F.lit(100.0) * F.col("k") / F.col("n")).alias("pct_exp"))
    w = Window.partitionBy("feature")
    x = F.log1p("avg_exp")
    z = F.try_divide(x - F.avg(x).over(w), F.stddev_samp(x).over(w))
    return rows.withColumn("avg_scaled", F.when(z.isNotNull(), F.greatest(F.lit(-2.5), F.least(F.lit(2.5), z))))


def mean_bins(m: Matrix, bins: int = 24) -> DataFrame:
    """(feature, mean, bin): equal-count bins of mean value, ties by feature."""
    w = Window.orderBy("mean", "feature")
    return row_moments(m).select("feature", "mean").withColumn("bin", F.ntile(bins).over(w))


def module_scores(m: Matrix, sets: DataFrame, controls: int = 100, bins: int = 24, seed: int = 1) -> DataFrame:
    """(cell, set_name, score) from sets (set_name, feature): mean of the set less the mean of its controls.

    Each member draws ``controls`` features of its bin, the lowest of a hash;
    a set's controls are the union of its members' draws.
    """
    binned = mean_bins(m, bins)
    binned = cut(binned.select("feature", "bin"), "bins")
    members = sets.join(binned, "feature")
    kind = m.features.schema["feature"].dataType.simpleString()
    if kind in LONG + INT:
        return scores_of(m, sets, _drawn(members, binned, controls, seed, kind))
    pool = binned.select(F.col("feature").alias("control"), "bin")
    draw = F.row_number().over(Window.partitionBy("set_name", "feature").orderBy(F.xxhash64("control", "feature", F.lit(seed)), "control"))
    drawn = members.join(pool, "bin").withColumn("k", draw).filter(F.col("k") <= controls).select("set_name", F.col("control").alias("feature")).distinct()
    return scores_of(m, sets, drawn)


#: Tasks that share a bin's members; each gets the whole bin.
_SHARES = 16


def _drawn(members: DataFrame, binned: DataFrame, controls: int, seed: int, kind: str) -> DataFrame:
    """(set_name, feature): the draws of all members, without a row for each pair of a member and a feature of its bin."""
    pool = binned.select(F.col("feature").alias("control"), F.col("bin").alias("of"), F.xxhash64("feature").alias("hash")).withColumn("share_of", F.explode(F.sequence(F.lit(0), F.lit(_SHARES - 1))))
    dealt = members.select("set_name", "feature", "bin", F.pmod(F.xxhash64("feature"), F.lit(_SHARES)).cast("int").alias("share"))

    def draw(some: pd.DataFrame, pool: pd.DataFrame) -> pd.DataFrame:
        pool = pool.sort_values("control")
        ids, hashes, out = pool["control"].to_numpy(), pool["hash"].to_numpy(), []
        for name, one in some.groupby("set_name", sort=False) if len(pool) else ():
            taken = np.zeros(len(ids), dtype=bool)
            for feature in one["feature"].to_numpy():
                h = hash_of(np.int64(seed), hash_of(feature, hashes, kind), "int")
                if len(h) > controls:
                    near = np.flatnonzero(h <= np.partition(h, controls - 1)[controls - 1])
                    taken[near[np.argsort(h[near], kind="stable")[:controls]]] = True
                else:
                    taken[:] = True
            out.append(pd.DataFrame({"set_name": name, "feature": ids[taken]}))
        return pd.concat(out) if out else some[["set_name", "feature"]]

    name = members.schema["set_name"].dataType.simpleString()
    found = dealt.groupBy("bin", "share").cogroup(pool.groupBy("of", "share_of")).applyInPandas(draw, f"set_name {name}, feature {kind}")
    return found.distinct()


def scores_of(m: Matrix, sets: DataFrame, controls: DataFrame) -> DataFrame:
    """Scores for given (set_name, feature) controls."""
    parts = sets.select("set_name", "feature").distinct().withColumn("sign", F.lit(1)).unionByName(controls.select("set_name", "feature").distinct().withColumn("sign", F.lit(-1)))
    size = parts.groupBy("set_name", "sign").agg(F.count(F.lit(1)).alias("k"))
    weights = parts.join(size, ["set_name", "sign"]).select("set_name", "feature", (F.col("sign") / F.col("k")).alias("w"))
    sums = m.values.join(weights, "feature").groupBy("cell", "set_name").agg(F.sum(F.col("value") * F.col("w")).alias("score"))
    grid = m.cells.select("cell").join(sets.select("set_name").distinct(), how="cross")
    return grid.join(sums, ["cell", "set_name"], "left").select("cell", "set_name", F.coalesce("score", F.lit(0.0)).alias("score"))


def cell_cycle(scores: DataFrame, s_set: str, g2m_set: str) -> DataFrame:
    """(cell, s_score, g2m_score, phase) from two module scores."""
    wide = scores.groupBy("cell").agg(F.max(F.when(F.col("set_name") == s_set, F.col("score"))).alias("s_score"), F.max(F.when(F.col("set_name") == g2m_set, F.col("score"))).alias("g2m_score"))
    s, g = F.col("s_score"), F.col("g2m_score")
    return wide.withColumn("phase", F.when((s < 0) & (g < 0), "G1").when(s == g, "Undecided").when(s > g, "S").otherwise("G2M"))


def smooth_labels(cells: DataFrame, cluster: str, label: str) -> DataFrame:
    """(cluster, label): each cluster's most frequent label, ties to the first in order."""
    counts = cells.filter(F.col(label).isNotNull()).groupBy(cluster, label).agg(F.count(F.lit(1)).alias("n"))
    first = F.row_number().over(Window.partitionBy(cluster).orderBy(F.desc("n"), label))
    return counts.withColumn("k", first).filter("k = 1").select(cluster, label)


def barcode_inflections(cells: DataFrame, count: str, group: str, low: int, high: int) -> DataFrame:
    """(group, cell, rank, derivative, inflection, kept): the steepest fall of log10 counts over ranks inside (low, high), by group."""
    w = Window.partitionBy(group).orderBy(F.desc(count), "cell")
    rows = cells.select(group, "cell", count).withColumn("rank", F.row_number().over(w)).withColumn("y", F.log10(F.col(count) + 1))
    rows = rows.withColumn("derivative", F.coalesce(F.col("y") - F.lag("y").over(w), F.lit(0.0)))
    inside = (F.col("rank") > low) & (F.col("rank") < high)
    best = rows.filter(inside).groupBy(group).agg(F.min_by(F.struct(F.col("rank"), F.col(count).alias("c")), F.struct("derivative", "rank")).alias("b")).select(group, F.col("b.c").alias("inflection"))
    return rows.join(best, group, "left").select(group, "cell", "rank", "derivative", "inflection", (F.col(count) >= F.col("inflection")).alias("kept"))


def group_correlation(m: Matrix, covariate: str) -> DataFrame:
    """(feature, correlation) of each feature with a numeric cell column, zeros included."""
    cells = m.cells.select("cell", F.col(covariate).cast("double").alias("c"))
    n = m.n_cells
    about = cells.agg(F.sum("c").alias("sc"), F.sum(F.col("c") * F.col("c")).alias("qc"))
    sums = m.values.join(cells, "cell").groupBy("feature").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"), F.sum(F.col("value") * F.col("c")).alias("x"))
    rows = sums.join(F.broadcast(about), how="cross")  # one row of sums
    bottom = F.sqrt((F.col("q") * n - F.col("s") * F.col("s")) * (F.col("qc") * n - F.col("sc") * F.col("sc")))
    return rows.select("feature", F.try_divide(F.col("x") * n - F.col("s") * F.col("sc"), F.when(bottom > 0, bottom)).alias("correlation"))


def feature_groups(m: Matrix, groups: int = 6, min_cells: int = 5) -> DataFrame:
    """(feature, log_mean, grp): features with enough positive cells in equal-width groups of log10 geometric mean."""
    n = m.n_cells
    rows = m.values.filter("value > 0").groupBy("feature").agg(F.sum(F.log1p("value")).alias("s"), F.count(F.lit(1)).alias("k")).filter(F.col("k") >= min_cells)
    rows = rows.select("feature", F.log10(F.expm1(F.col("s") / n)).alias("log_mean"))
    span = rows.agg(F.min("log_mean").alias("low"), F.max("log_mean").alias("high"))
    width = (F.col("high") - F.col("low")) / groups
    slot = F.when(width > 0, F.greatest(F.lit(1), F.least(F.lit(groups), F.ceil((F.col("log_mean") - F.col("low")) / F.when(width > 0, width))))).otherwise(1)
    return rows.join(F.broadcast(span), how="cross").select("feature", "log_mean", slot.cast("int").alias("grp"))  # one row


def spatial_bins(values: DataFrame, coords: DataFrame, nx: int, ny: int) -> DataFrame:
    """(feature, bin_x, bin_y, value): mean value in equal-width bins of (cell, x, y), zeros included."""
    span = coords.agg(*(f(c).alias(f"{n}_{c}") for c in "xy" for n, f in (("lo", F.min), ("hi", F.max))))
    rows = coords.join(F.broadcast(span), how="cross")  # one row

    def slot(c: str, k: int) -> Column:
        width = (F.col(f"hi_{c}") - F.col(f"lo_{c}")) / k
        return F.when(width > 0, F.least(F.lit(k), F.floor((F.col(c) - F.col(f"lo_{c}")) / F.when(width > 0, width)) + 1)).otherwise(1).cast("int")

    binned = rows.select("cell", slot("x", nx).alias("bin_x"), slot("y", ny).alias("bin_y"))
    sizes = binned.groupBy("bin_x", "bin_y").agg(F.count(F.lit(1)).alias("n"))
    sums = values.join(binned, "cell").groupBy("feature", "bin_x", "bin_y").agg(F.sum("value").alias("s"))
    return sums.join(sizes, ["bin_x", "bin_y"]).select("feature", "bin_x", "bin_y", (F.col("s") / F.col("n")).alias("value"))
