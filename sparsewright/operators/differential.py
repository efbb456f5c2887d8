"""Differential statistics between groups of cells.

All tests run off the stored entries; the zeros enter by their number. The
tail probabilities come from a vectorised function over one row a feature.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from sparsewright.functions import distributions as dist
from sparsewright.matrix import Matrix
from sparsewright.operators.statistics import spread_of


def two_groups(m: Matrix, column: str, first, second=None) -> DataFrame:
    """(cell, g): 1 for the first identity, 2 for the second, or for all others."""
    is_second = F.col(column) != F.lit(first) if second is None else F.col(column) == F.lit(second)
    return m.cells.select("cell", F.when(F.col(column) == F.lit(first), 1).when(is_second, 2).alias("g")).filter("g is not null")


def checked_sizes(groups: DataFrame, least: int = 3) -> tuple[int, int]:
    sizes = {r.g: r["count"] for r in groups.groupBy("g").count().collect()}
    a, b = sizes.get(1, 0), sizes.get(2, 0)
    if min(a, b) < least:
        raise ValueError(f"groups of {a} and {b} cells; {least} are needed")
    return a, b


def fold_change(m: Matrix, groups: DataFrame, pseudocount: float = 1.0, base: float = 2.0, layer: str = "data", each: Callable[[Column], Column] | None = None, finish: Callable[[Column, int], Column] | None = None) -> DataFrame:
    """(feature, avg_log_fc, pct_1, pct_2): the pseudocount goes on the sum; shares are rounded to 3 digits; a scaled layer has plain mean differences.

    A mean of one's own: ``each`` is applied to stored values (zeros stay zeros) before they are added up, ``finish`` to a group's sum and size.
    """
    n1, n2 = checked_sizes(groups, 1)
    x = each(F.col("value")) if each else {"data": F.expm1("value"), "counts": F.col("value"), "scale.data": F.col("value")}[layer]
    part = lambda g: F.sum(F.when(F.col("g") == g, x).otherwise(0.0))
    share = lambda g: F.sum(F.when((F.col("g") == g) & (F.col("value") > 0), 1).otherwise(0))
    sums = m.values.join(groups, "cell").groupBy("feature").agg(part(1).alias("s1"), part(2).alias("s2"), share(1).alias("k1"), share(2).alias("k2"))
    rows = m.features.select("feature").join(sums, "feature", "left").fillna(0, ["s1", "s2", "k1", "k2"])
    if finish:
        fc = finish(F.col("s1"), n1) - finish(F.col("s2"), n2)
    elif layer == "scale.data":
        fc = F.col("s1") / n1 - F.col("s2") / n2
    else:
        fc = (F.log((F.col("s1") + pseudocount) / n1) - F.log((F.col("s2") + pseudocount) / n2)) / math.log(base)
    return rows.select("feature", fc.alias("avg_log_fc"), F.round(F.col("k1") / n1, 3).alias("pct_1"), F.round(F.col("k2") / n2, 3).alias("pct_2"))


def rank_sums(m: Matrix, groups: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(feature, r1, ties): sum of mid-ranks of group 1 among all cells, and sum of t^3 - t over ties.

    Values are first reduced to one row a feature and value, so the ranking
    window runs over distinct values, not over cells. The zeros are one tie.
    """
    n1, n2 = checked_sizes(groups, 1)
    counts = m.values.join(groups, "cell").groupBy("feature", "value").agg(F.count(F.lit(1)).alias("t"), F.sum(F.when(F.col("g") == 1, 1).otherwise(0)).alias("t1"))
    held = counts.groupBy("feature").agg(F.sum("t").alias("k"), F.sum("t1").alias("k1"))
    zeros = m.features.select("feature").join(held, "feature", "left").fillna(0, ["k", "k1"]).select("feature", F.lit(0.0).alias("value"), (F.lit(n1 + n2) - F.col("k")).alias("t"), (F.lit(n1) - F.col("k1")).alias("t1"))
    w = Window.partitionBy("feature").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    rows = counts.unionByName(zeros).filter("t > 0").withColumn("below", F.coalesce(F.sum("t").over(w), F.lit(0)).cast("double"))
    t = F.col("t").cast("double")
    mid = F.col("below") + (t + F.lit(1.0)) / F.lit(2.0)
    return rows.groupBy("feature").agg(F.sum(mid * F.col("t1")).alias("r1"), F.sum(t * t * t - t).alias("ties"))


def wilcoxon(m: Matrix, groups: DataFrame) -> DataFrame:
    """(feature, u, z, p_val, auc): rank-sum with tie and continuity correction; null z without spread."""
    n1, n2 = checked_sizes(groups, 1)
    n = n1 + n2
    u = F.col("r1") - n1 * (n1 + 1) / 2.0
    variance = F.lit(n1 * n2 / 12.0) * (F.lit(n + 1.0) - F.col("ties") / float(n * (n - 1)))
    gap = F.col("u") - n1 * n2 / 2.0
    z = F.when(F.col("v") > 0, (gap - F.signum(gap) * 0.5) / F.sqrt("v"))
    rows = rank_sums(m, groups).select("feature", u.alias("u"), variance.alias("v")).withColumn("z", z)
    return rows.select("feature", "u", "z", normal_tail(F.col("z")).alias("p_val"), F.round(F.col("u") / float(n1 * n2), 3).alias("auc"))


@F.pandas_udf(DoubleType())
def _normal_tail(z: pd.Series) -> pd.Series:
    return pd.Series(np.where(z.isna(), 1.0, dist.normal_sf2(z.fillna(0.0).to_numpy())))


def normal_tail(z: Column) -> Column:
    return _normal_tail(z)


def roc(m: Matrix, groups: DataFrame) -> DataFrame:
    """(feature, my_auc, avg_diff, power): difference of log means of expm1 values."""
    n1, n2 = checked_sizes(groups, 1)
    part = lambda g: F.sum(F.when(F.col("g") == g, F.expm1("value")).otherwise(0.0))
    sums = m.values.join(groups, "cell").groupBy("feature").agg(part(1).alias("s1"), part(2).alias("s2"))
    diff = F.log1p(F.coalesce("s1", F.lit(0.0)) / n1) - F.log1p(F.coalesce("s2", F.lit(0.0)) / n2)
    a = wilcoxon(m, groups).select("feature", F.col("auc").alias("my_auc"))
    return a.join(sums, "feature", "left").select("feature", "my_auc", diff.alias("avg_diff"), (F.abs(F.col("my_auc") - 0.5) * 2).alias("power"))


def group_moments(m: Matrix, groups: DataFrame) -> DataFrame:
    """(feature, n_g, mean_g, var_g for g in 1, 2), zeros included."""
    n1, n2 = checked_sizes(groups, 1)
    agg = []
    for g in (1, 2):
        x = F.when(F.col("g") == g, F.col("value")).otherwise(0.0)
        agg += [F.sum(x).alias(f"s{g}"), F.sum(x * x).alias(f"q{g}")]
    sums = m.values.join(groups, "cell").groupBy("feature").agg(*agg)
    rows = m.features.select("feature").join(sums, "feature", "left").fillna(0.0)
    out = ["feature"]
    for g, n in ((1, n1), (2, n2)):
        s, q = F.col(f"s{g}"), F.col(f"q{g}")
        variance = spread_of(s, q, F.lit(n)) if n > 1 else F.lit(None).cast("double")
        out += [F.lit(n).alias(f"n{g}"), (s / n).alias(f"mean{g}"), variance.alias(f"var{g}")]
    return rows.select(*out)


def welch_t(m: Matrix, groups: DataFrame) -> DataFrame:
    """(feature, t, df, p_val); null t without spread."""
    rows = group_moments(m, groups)
    a, b = F.col("var1") / F.col("n1"), F.col("var2") / F.col("n2")
    se2 = a + b
    t = F.when(se2 > 0, (F.col("mean1") - F.col("mean2")) / F.sqrt(se2))
    df = F.when(se2 > 0, se2 * se2 / (a * a / (F.col("n1") - 1) + b * b / (F.col("n2") - 1)))
    return rows.select("feature", t.alias("t"), df.alias("df")).withColumn("p_val", _t_tail("t", "df"))


@F.pandas_udf(DoubleType())
def _t_tail(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([dist.t_sf2(a, b) if a == a and b == b else 1.0 for a, b in zip(t, df, strict=True)])


@F.pandas_udf(DoubleType())
def _chi2_tail(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([dist.chi2_sf(a, b) if a == a else 1.0 for a, b in zip(x, df, strict=True)])


def bimod(m: Matrix, groups: DataFrame) -> DataFrame:
    """(feature, lrt, p_val): likelihood ratio of a Bernoulli for positive values times a normal on them, chi-square with 3 degrees."""
    n1, n2 = checked_sizes(groups, 1)
    agg = []
    for g in (1, 2):
        some = (F.col("g") == g) & (F.col("value") > 0)
        agg += [F.sum(F.when(some, 1).otherwise(0)).alias(f"k{g}"), F.sum(F.when(some, F.col("value")).otherwise(0.0)).alias(f"s{g}"), F.sum(F.when(some, F.col("value") * F.col("value")).otherwise(0.0)).alias(f"q{g}")]
    sums = m.values.join(groups, "cell").groupBy("feature").agg(*agg)
    rows = m.features.select("feature").join(sums, "feature", "left").fillna(0)

    def likelihood(k: Column, s: Column, q: Column, n: int) -> Column:
        share = F.least(F.lit(1 - 1e-5), F.greatest(F.lit(1e-5), k / n))
        spread = F.greatest(F.lit(0.0), q - F.try_divide(s * s, k))
        # of the maximum-likelihood mean and the n - 1 standard deviation
        v = F.when(k < 2, F.lit(1.0)).otherwise(spread / F.when(k < 2, F.lit(1.0)).otherwise(k - 1))
        normal = F.when(k < 1, F.lit(0.0)).otherwise(-0.5 * k * F.log(2 * math.pi * F.when(v > 0, v)) - F.coalesce(spread, F.lit(0.0)) / (2 * F.when(v > 0, v)))
        return F.lit(n) * F.log(1 - share) - k * F.log(1 - share) + k * F.log(share) + normal

    k, s, q = (F.col(f"{c}1") + F.col(f"{c}2") for c in "ksq")
    lrt = 2 * (likelihood(F.col("k1"), F.col("s1"), F.col("q1"), n1) + likelihood(F.col("k2"), F.col("s2"), F.col("q2"), n2) - likelihood(k, s, q, n1 + n2))
    return rows.select("feature", lrt.alias("lrt")).withColumn("p_val", _chi2_tail("lrt", F.lit(3.0)))


def glm_test(m: Matrix, groups: DataFrame, family: str = "poisson", min_cells: int = 3, latent: list[str] | None = None) -> DataFrame:
    """(feature, p_val): group effect by a likelihood-ratio test of a Poisson, negbinom or logistic (group on value) model, latent cell columns in both.

    Without latent columns the counts' fits are the groups' means, so sums over stored entries do, and the logistic fit's
    zeros are two weighted rows. With them one feature is a task's group; the cells' design is broadcast, at most 64 MB.
    """
    if latent:
        return _glm_test_latent(m, groups, family, min_cells, latent)
    n1, n2 = checked_sizes(groups, 1)
    stored = m.values.join(groups, "cell")
    if family == "logistic":
        return _logistic_test(stored, n1, n2, min_cells)
    one = lambda g, x: F.sum(F.when(F.col("g") == g, x).otherwise(0.0))
    v = F.col("value")
    rows = stored.groupBy("feature").agg(*(one(g, v).alias(f"s{g}") for g in (1, 2)), *(one(g, (v > 0).cast("double")).alias(f"k{g}") for g in (1, 2)), F.sum(v * v).alias("q"), F.min(v).alias("low"), F.max(v).alias("high"), F.count(F.lit(1)).alias("k"))
    constant = F.when(F.col("k") == n1 + n2, F.col("low") == F.col("high")).otherwise((F.col("low") == 0) & (F.col("high") == 0))
    rows = rows.filter(~constant & (F.greatest("k1", "k2") >= min_cells)).withColumn("s", F.col("s1") + F.col("s2"))
    if family == "negbinom":  # the size by moments about the groups' means
        squares = F.col("s1") * F.col("s1") / n1 + F.col("s2") * F.col("s2") / n2
        over = F.col("q") - squares - F.col("s")
        rows = rows.withColumn("theta", F.when(over > 0, squares / F.when(over > 0, over)))
    else:
        rows = rows.withColumn("theta", F.lit(None).cast("double"))

    def fitted(s: Column, n: int) -> Column:
        """What depends on a mean in the log-likelihood at a group's own, for all its cells."""
        some = F.when(s > 0, s)
        poisson = some * F.log(some / n) - some
        theta = F.col("theta")
        negbinom = some * F.log(some / n / (theta + some / n)) - n * theta * F.log1p(some / n / theta)
        return F.coalesce(F.when(theta.isNull(), poisson).otherwise(negbinom), F.lit(0.0))

    gain = 2 * (fitted(F.col("s1"), n1) + fitted(F.col("s2"), n2) - fitted(F.col("s"), n1 + n2))
    return rows.select("feature", _chi2_tail(F.greatest(F.lit(0.0), gain), F.lit(1.0)).alias("p_val"))


def _logistic_test(stored: DataFrame, n1: int, n2: int, min_cells: int) -> DataFrame:
    """(feature, p_val) of (feature, value, g): the group on the value; equal values of a feature are one weighted row."""
    one = lambda g: F.sum(F.when(F.col("g") == g, 1.0).otherwise(0.0))
    counts = stored.groupBy("feature", "value").agg(one(1).alias("w1"), one(2).alias("w2"))
    # in order, so that sums do not depend on the run
    lists = counts.groupBy("feature").agg(F.array_sort(F.collect_list(F.struct("value", "w1", "w2"))).alias("p")).select("feature", F.col("p.value").alias("v"), F.col("p.w1").alias("w1"), F.col("p.w2").alias("w2"))
    null = n1 * math.log(n1 / (n1 + n2)) + n2 * math.log(n2 / (n1 + n2))

    def run(frames):
        for pdf in frames:
            if not len(pdf):
                continue
            size = pdf["v"].map(len).to_numpy()
            at = np.cumsum(size) - size
            v, w1, w2 = (np.concatenate(pdf[c].to_list()) for c in ("v", "w1", "w2"))
            total = lambda x, at=at: np.add.reduceat(x, at)
            k1, k2 = total(w1), total(w2)
            some = np.maximum(total(w1 * (v > 0)), total(w2 * (v > 0))) >= min_cells
            # the cells without an entry: a row of each feature
            order = np.argsort(np.concatenate([np.repeat(np.arange(len(size)), size), np.arange(len(size))]), kind="stable")
            v, w1, w2 = (np.concatenate(x)[order] for x in ((v, np.zeros(len(size))), (w1, n1 - k1), (w2, n2 - k2)))
            at, size = at + np.arange(len(size)), size + 1
            n, of = n1 + n2, np.repeat(np.arange(len(size)), size)
            mean = np.add.reduceat((w1 + w2) * v, at) / n
            varies = np.maximum.reduceat(np.where(w1 + w2 > 0, v, -np.inf), at) > np.minimum.reduceat(np.where(w1 + w2 > 0, v, np.inf), at)
            some &= varies
            sd = np.sqrt(np.add.reduceat((w1 + w2) * (v - mean[of]) ** 2, at) / n)
            x = (v - mean[of]) / np.where(varies, sd, 1.0)[of]
            best = dist.logistic_logliks(x, w1, w2, size)
            p = [dist.chi2_sf(max(0.0, 2 * (a - null)), 1) for a in best[some]]
            yield pd.DataFrame({"feature": pdf["feature"].to_numpy()[some], "p_val": p}).astype({"p_val": float})

    kind = stored.schema["feature"].dataType.simpleString()
    return lists.mapInPandas(run, f"feature {kind}, p_val double")


def _glm_test_latent(m: Matrix, groups: DataFrame, family: str, min_cells: int, latent: list[str]) -> DataFrame:
    n1, n2 = checked_sizes(groups, 1)
    if (n1 + n2) * (len(latent) + 2) * 8 > 64 << 20:
        raise ValueError("the design matrix passes 64 MB; use a rank or t test")
    design = groups.join(m.cells.select("cell", *latent), "cell").orderBy("cell").toPandas()
    held = m.values.sparkSession.sparkContext.broadcast(({c: i for i, c in enumerate(design["cell"])}, (design["g"] == 1).to_numpy(dtype=float), design[latent].to_numpy(dtype=float)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        place, first, z = held.value
        y = np.zeros(len(first))
        y[[place[c] for c in pdf["cell"]]] = pdf["value"]
        none = pd.DataFrame({"feature": [], "p_val": []}).astype({"feature": pdf["feature"].dtype, "p_val": float})
        if y.var() == 0 or ((y[first == 1] > 0).sum() < min_cells and (y[first == 0] > 0).sum() < min_cells):
            return none
        null = np.column_stack([np.ones(len(y)), z])
        if family == "logistic":
            full = np.column_stack([null, (y - y.mean()) / y.std()])
            p = dist.chi2_sf(max(0.0, 2 * (dist.logistic_loglik(first, full) - dist.logistic_loglik(first, null))), 1)
        else:
            p = dist.glm_deviance_test(y, null, np.column_stack([null, first]), family)
        return pd.DataFrame({"feature": pdf["feature"].iloc[:1], "p_val": [p]})

    kind = m.values.schema["feature"].dataType.simpleString()
    return m.values.join(groups.select("cell"), "cell", "left_semi").groupBy("feature").applyInPandas(run, f"feature {kind}, p_val double")


def hurdle(m: Matrix, groups: DataFrame) -> DataFrame:
    """(feature, lrt, df, p_val): two-part test of a group effect, on whether a value is positive and on the positive values' mean.

    Both parts are likelihood ratios in closed form, logistic and Gaussian; a part that a feature cannot inform adds no degree of freedom.
    """
    n1, n2 = checked_sizes(groups, 1)
    rows = _positive_sums(m, groups)
    k1, k2 = F.col("k1"), F.col("k2")

    def binary(k: Column, n: int) -> Column:
        share = k / n
        return F.when((k > 0) & (k < n), k * F.log(share) + (n - k) * F.log(1 - share)).otherwise(0.0)

    within = (F.col("q1") - F.coalesce(F.try_divide(F.col("s1") * F.col("s1"), k1), F.lit(0.0))) + (F.col("q2") - F.coalesce(F.try_divide(F.col("s2") * F.col("s2"), k2), F.lit(0.0)))
    k, s = k1 + k2, F.col("s1") + F.col("s2")
    whole = F.col("q1") + F.col("q2") - F.try_divide(s * s, k)
    part = 2 * (binary(k1, n1) + binary(k2, n2) - binary(k, n1 + n2))
    mixed = (k > 0) & (k < n1 + n2)
    both = (k1 > 0) & (k2 > 0) & (within > 1e-9)
    lrt = F.when(mixed, part).otherwise(0.0) + F.when(both, k * F.log(whole / F.when(both, within))).otherwise(0.0)
    df = F.when(mixed, 1).otherwise(0) + F.when(both, 1).otherwise(0)
    out = rows.select("feature", F.greatest(lrt, F.lit(0.0)).alias("lrt"), df.alias("df")).filter("df > 0")
    return out.withColumn("p_val", _chi2_tail("lrt", F.col("df").cast("double")))


def _positive_sums(m: Matrix, groups: DataFrame) -> DataFrame:
    """(feature, k1, s1, q1, k2, s2, q2): numbers, sums and squares of the positive values of both groups."""
    rows = m.values.filter("value > 0").join(groups, "cell")
    one = lambda g, x: F.coalesce(F.sum(F.when(F.col("g") == g, x)), F.lit(0.0))
    v = F.col("value")
    return rows.groupBy("feature").agg(*(one(g, x).alias(f"{c}{g}") for g in (1, 2) for c, x in (("k", F.lit(1.0)), ("s", v), ("q", v * v))))


def size_factors(m: Matrix) -> DataFrame:
    """(cell, factor): median over features of the ratio to their geometric mean over all cells (zeros count as none in the mean), about 1 in geometric mean."""
    n = float(m.n_cells)
    positive = m.values.filter("value > 0")
    means = positive.groupBy("feature").agg((F.sum(F.log("value")) / n).alias("g"))
    raw = positive.join(means, "feature").groupBy("cell").agg(F.exp(F.percentile(F.log("value") - F.col("g"), 0.5)).alias("f"))
    middle = raw.agg(F.exp(F.avg(F.log("f"))).alias("mid"))
    return raw.join(F.broadcast(middle), how="cross").select("cell", (F.col("f") / F.col("mid")).alias("factor"))  # one row


def count_wald(m: Matrix, groups: DataFrame) -> DataFrame:
    """(feature, log2_fc, z, p_val): Wald test of a negative binomial group effect on counts over size factors.

    The dispersion is the feature's own by moments (no shrinkage towards a
    trend); features without counts in either group have no row.
    """
    n1, n2 = checked_sizes(groups, 1)
    factors = size_factors(m)
    inverse = factors.join(groups, "cell").agg(F.avg(1 / F.col("factor")).alias("inv"))
    scaled = m.with_values(m.values.join(factors, "cell").select("feature", "cell", (F.col("value") / F.col("factor")).alias("value")))
    rows = _positive_sums(scaled, groups).join(F.broadcast(inverse), how="cross")  # one row
    mean = lambda g, n: F.col(f"s{g}") / n
    spread = lambda g, n: (F.col(f"q{g}") - F.col(f"s{g}") * F.col(f"s{g}") / n)
    pooled = (spread(1, n1) + spread(2, n2)) / max(1, n1 + n2 - 2)
    whole = (F.col("s1") + F.col("s2")) / (n1 + n2)
    alpha = F.greatest((pooled - whole * F.col("inv")) / (whole * whole), F.lit(1e-8))
    rows = rows.filter("s1 > 0 and s2 > 0").withColumn("alpha", alpha)
    error = F.sqrt((F.col("inv") / mean(1, n1) + F.col("alpha")) / n1 + (F.col("inv") / mean(2, n2) + F.col("alpha")) / n2)
    change = F.log(mean(1, n1) / mean(2, n2))
    out = rows.select("feature", (change / F.log(F.lit(2.0))).alias("log2_fc"), (change / error).alias("z"))
    return out.withColumn("p_val", normal_tail(F.col("z")))


def find_markers(m: Matrix, column: str, first, second=None, test: str = "wilcox", min_pct: float = 0.01, min_diff_pct: float = -1.0, logfc_threshold: float = 0.1, only_pos: bool = False) -> DataFrame:
    """(feature, p_val, avg_log_fc, pct_1, pct_2, p_val_adj): prefiltered features, Bonferroni over all features of the matrix; the roc test has my_auc, avg_diff and power instead of p."""
    groups = two_groups(m, column, first, second)
    checked_sizes(groups)
    fc = fold_change(m, groups)
    high, low = F.greatest("pct_1", "pct_2"), F.least("pct_1", "pct_2")
    big = F.col("avg_log_fc") >= logfc_threshold if only_pos else F.abs("avg_log_fc") >= logfc_threshold
    kept = fc.filter((high >= min_pct) & (high - low >= min_diff_pct) & big)
    tests = {"wilcox": wilcoxon, "t": welch_t, "bimod": bimod, "roc": roc, "hurdle": hurdle, "wald": lambda m, g: count_wald(m, g), "poisson": lambda m, g: glm_test(m, g, "poisson"), "negbinom": lambda m, g: glm_test(m, g, "negbinom"), "LR": lambda m, g: glm_test(m, g, "logistic")}
    if test not in tests:
        raise ValueError(f"unknown test: {test}")
    sub = m.select_features(kept)
    rows = tests[test](sub, groups)
    if test == "roc":
        return kept.join(rows, "feature").select("feature", "my_auc", "avg_diff", "power", "avg_log_fc", "pct_1", "pct_2")
    adjusted = F.least(F.lit(1.0), F.col("p_val") * m.n_features)
    return kept.join(rows, "feature").select("feature", "p_val", "avg_log_fc", "pct_1", "pct_2", adjusted.alias("p_val_adj"))


def one_vs_rest(m: Matrix, column: str) -> DataFrame:
    """(cluster, feature, u, z, avg_log_fc, pct_1, pct_2) of every identity against all other cells, in one pass over the values."""
    cells = m.cells.select("cell", F.col(column).alias("cluster")).filter("cluster is not null")
    sizes = cells.groupBy("cluster").agg(F.count(F.lit(1)).alias("n1"))
    total = m.values.sparkSession.createDataFrame([(cells.count(),)], "n long")
    rows = m.values.join(cells, "cell")
    by_value = rows.groupBy("feature", "value", "cluster").agg(F.count(F.lit(1)).alias("t1"))
    counts = by_value.groupBy("feature", "value").agg(F.sum("t1").alias("t"))
    held = counts.groupBy("feature").agg(F.sum("t").alias("k"))
    features = m.features.select("feature")
    zero = features.join(held, "feature", "left").join(F.broadcast(total), how="cross").select("feature", F.lit(0.0).alias("value"), (F.col("n") - F.coalesce("k", F.lit(0))).alias("t"))  # one row
    w = Window.partitionBy("feature").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    ranked = counts.unionByName(zero).filter("t > 0").withColumn("below", F.coalesce(F.sum("t").over(w), F.lit(0)))
    t = F.col("t").cast("double")
    ranked = ranked.withColumn("mid", F.col("below") + (t + F.lit(1.0)) / F.lit(2.0))
    ties = ranked.groupBy("feature").agg(F.sum(t * t * t - t).alias("ties"), F.max(F.when(F.col("value") == 0, F.col("mid"))).alias("mid0"))
    stored = by_value.join(ranked.select("feature", "value", "mid"), ["feature", "value"]).groupBy("feature", "cluster").agg(F.sum(F.col("mid") * F.col("t1")).alias("r"), F.sum("t1").alias("k1"), F.sum(F.when(F.col("value") > 0, F.col("t1")).otherwise(0)).alias("p1"), F.sum(F.expm1("value") * F.col("t1")).alias("s1"))
    every = stored.groupBy("feature").agg(F.sum("p1").alias("p"), F.sum("s1").alias("s"))
    grid = features.join(sizes, how="cross").join(F.broadcast(total), how="cross").join(ties, "feature").join(stored, ["feature", "cluster"], "left").join(every, "feature", "left").fillna(0, ["r", "k1", "p1", "s1", "p", "s", "mid0"])
    n1, n2 = F.col("n1").cast("double"), (F.col("n") - F.col("n1")).cast("double")
    n = F.col("n").cast("double")
    u = F.col("r") + (n1 - F.col("k1")) * F.col("mid0") - n1 * (n1 + 1) / 2
    v = n1 * n2 / 12 * (n + 1 - F.col("ties") / (n * (n - 1)))
    gap = F.col("u") - n1 * n2 / 2
    fc = (F.log((F.col("s1") + 1) / n1) - F.log((F.col("s") - F.col("s1") + 1) / n2)) / math.log(2)
    out = grid.filter(n2 > 0).withColumn("u", u).withColumn("v", v)
    return out.select("cluster", "feature", "u", F.when(F.col("v") > 0, (gap - F.signum(gap) * 0.5) / F.sqrt("v")).alias("z"), fc.alias("avg_log_fc"), F.round(F.col("p1") / n1, 3).alias("pct_1"), F.round((F.col("p") - F.col("p1")) / n2, 3).alias("pct_2"))


def find_all_markers(m: Matrix, column: str, min_pct: float = 0.01, logfc_threshold: float = 0.1, return_thresh: float = 0.01, only_pos: bool = False) -> DataFrame:
    """(cluster, gene, p_val, avg_log_fc, pct_1, pct_2, p_val_adj) of all identities."""
    rows = one_vs_rest(m, column)
    big = F.col("avg_log_fc") >= logfc_threshold if only_pos else F.abs("avg_log_fc") >= logfc_threshold
    kept = rows.filter((F.greatest("pct_1", "pct_2") >= min_pct) & big).withColumn("p_val", normal_tail(F.col("z"))).filter(F.col("p_val") < return_thresh)
    return kept.select("cluster", F.col("feature").alias("gene"), "p_val", "avg_log_fc", "pct_1", "pct_2", F.least(F.lit(1.0), F.col("p_val") * m.n_features).alias("p_val_adj"))


def minimum_p(p: Column) -> Column:
    """Combined p of an array of p-values by their least."""
    return 1 - F.pow(1 - F.array_min(p), F.size(p).cast("double"))


def find_conserved(m: Matrix, column: str, first, grouping: str, combine: Callable[[Column], Column] = minimum_p) -> DataFrame:
    """(feature, max_pval, minimump_p_val, n_groups): the test in every level of a cell column; features found in all levels. ``combine`` makes one p of an array of them."""
    levels = [r[0] for r in m.cells.filter(F.col(grouping).isNotNull()).groupBy(grouping).agg(F.count_distinct(F.when(F.col(column) == F.lit(first), F.lit(1)).otherwise(F.lit(0))).alias("k")).filter("k = 2").orderBy(grouping).collect()]
    every = None
    for level in levels:
        part = m.select_cells(m.cells.filter(F.col(grouping) == level))
        rows = wilcoxon(part, two_groups(part, column, first)).select("feature", "p_val")
        every = rows if every is None else every.unionByName(rows)
    k = len(levels)
    return every.groupBy("feature").agg(F.max("p_val").alias("max_pval"), combine(F.sort_array(F.collect_list("p_val"))).alias("minimump_p_val"), F.count(F.lit(1)).alias("n_groups")).filter(F.col("n_groups") == k)
