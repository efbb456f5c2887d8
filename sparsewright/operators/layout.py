"""Two-dimensional layouts of a cell graph.

Edge weights come from a distributed pass over neighbour lists; the layout
itself is a sequential descent over all cells, so it runs in one task over a
graph whose size is checked. Cells beyond a sketch are placed by ``placed``,
which is distributed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparsewright.operators.neighbors import knn
from sparsewright.operators.sketching import weighted_sample
from sparsewright.plans.scratch import cut

MAX_EDGES = 20_000_000
MAX_EXACT = 5_000


def curve(min_dist: float = 0.3, spread: float = 1.0) -> tuple[float, float]:
    """(a, b) of 1 / (1 + a d^2b) closest to 1 up to min_dist and an exponential fall beyond."""
    d = np.linspace(0, 3 * spread, 300)[1:]
    want = np.where(d < min_dist, 1.0, np.exp(-(d - min_dist) / spread))
    p = np.array([1.0, 1.0])
    for _ in range(200):
        power = d ** (2 * p[1])
        f = 1 / (1 + p[0] * power)
        slope = np.column_stack([-f * f * power, -f * f * p[0] * power * 2 * np.log(d)])
        step = np.linalg.lstsq(slope, want - f, rcond=None)[0]
        p = np.maximum(p + np.clip(step, -0.2, 0.2), 1e-3)
        if np.abs(step).max() < 1e-10:
            break
    return float(p[0]), float(p[1])


def memberships(neighbors: DataFrame) -> DataFrame:
    """(i, j, w) of neighbour lists: exp(-(d - nearest) / s) with s so that the weights of a cell add up to log2 k; both directions joined as w + v - w v."""
    lists = neighbors.filter("query != neighbor").groupBy(F.col("query").alias("i")).agg(F.array_sort(F.collect_list(F.struct("dist", "neighbor"))).alias("near"))
    kind = neighbors.schema["query"].dataType.simpleString()

    def weigh(frames):
        for pdf in frames:
            for i, near in zip(pdf["i"], pdf["near"], strict=True):
                d = np.array([x["dist"] for x in near], dtype=float)
                beyond = np.maximum(d - (d[d > 0].min() if (d > 0).any() else 0.0), 0)
                low, high, target = 0.0, np.inf, np.log2(len(d) + 1)
                s = 1.0
                for _ in range(64):
                    total = np.exp(-beyond / s).sum()
                    if abs(total - target) < 1e-5:
                        break
                    if total > target:
                        high = s
                        s = (low + high) / 2
                    else:
                        low = s
                        s = s * 2 if np.isinf(high) else (low + high) / 2
                s = max(s, 1e-3 * d.mean())
                yield pd.DataFrame({"i": i, "j": [x["neighbor"] for x in near], "w": np.exp(-beyond / s) if s > 0 else np.ones(len(d))})

    one = lists.mapInPandas(weigh, f"i {kind}, j {kind}, w double")
    both = one.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), "w")
    return both.groupBy(F.col("a").alias("i"), F.col("b").alias("j")).agg(F.sum("w").alias("s"), F.product("w").alias("p"), F.count(F.lit(1)).alias("n")).select("i", "j", F.when(F.col("n") > 1, F.col("s") - F.col("p")).otherwise(F.col("s")).alias("w"))


def descend(start: np.ndarray, i: np.ndarray, j: np.ndarray, w: np.ndarray, a: float, b: float, epochs: int, seed: int, negatives: int = 5, moving: np.ndarray | None = None) -> np.ndarray:
    """Layout by descent: edges attract as often as they weigh, random cells repel."""
    y, rng = start.copy(), np.random.default_rng(seed)
    free = np.ones(len(y), dtype=bool) if moving is None else moving
    share = w / w.max() if len(w) else w
    for e in range(epochs):
        rate = 1.0 - e / epochs
        on = np.flatnonzero(rng.random(len(w)) < share)
        p, q = np.concatenate([i[on], j[on]]), np.concatenate([j[on], i[on]])
        gap = y[p] - y[q]
        d2 = (gap * gap).sum(axis=1)
        pull = np.where(d2 > 0, -2 * a * b * np.maximum(d2, 1e-12) ** (b - 1) / (1 + a * d2**b), 0.0)
        move = np.zeros_like(y)
        np.add.at(move, p, np.clip(pull[:, None] * gap, -4, 4))
        for _ in range(negatives):
            r = rng.integers(0, len(y), len(p))
            gap = y[p] - y[r]
            d2 = (gap * gap).sum(axis=1)
            push = np.where(r != p, 2 * b / ((0.001 + d2) * (1 + a * d2**b)), 0.0)
            np.add.at(move, p, np.clip(push[:, None] * gap, -4, 4))
        count = np.maximum(np.bincount(p, minlength=len(y)), 1)[:, None]
        y[free] += (rate * move / np.sqrt(count))[free]
    return y


def umap(neighbors: DataFrame, start: DataFrame, min_dist: float = 0.3, epochs: int = 200, seed: int = 42) -> DataFrame:
    """(cell, x, y): layout of the cells of a neighbour table, from the first two coordinates of ``start`` (cell, vector)."""
    edges = memberships(neighbors)
    if edges.count() > MAX_EDGES:
        raise ValueError(f"more than {MAX_EDGES} edges; lay out a sketch and place the other cells")
    a, b = curve(min_dist)
    kind = start.schema["cell"].dataType.simpleString()
    cells = start.select(F.col("cell").alias("i"), F.lit(None).cast(kind).alias("j"), F.lit(0.0).alias("w"), F.get("vector", 0).alias("x"), F.get("vector", 1).alias("y"))
    rows = edges.select("i", "j", "w", F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y")).unionByName(cells).withColumn("g", F.lit(1))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        held = pdf[pdf["x"].notna()].sort_values("i")
        links = pdf[pdf["x"].isna()].sort_values(["i", "j"])
        ids = held["i"].to_numpy()
        first = held[["x", "y"]].to_numpy()
        first = 10 * (first - first.min(axis=0)) / np.maximum(np.ptp(first, axis=0), 1e-12)
        out = descend(first, np.searchsorted(ids, links["i"].to_numpy()), np.searchsorted(ids, links["j"].to_numpy().astype(ids.dtype)), links["w"].to_numpy(), a, b, epochs, seed)
        return pd.DataFrame({"cell": ids, "x": out[:, 0], "y": out[:, 1]})

    return rows.groupBy("g").applyInPandas(run, f"cell {kind}, x double, y double")


def placed(neighbors: DataFrame, layout: DataFrame) -> DataFrame:
    """(cell, x, y): query cells at the mean of their reference neighbours' places, weighted by nearness."""
    weight = 1 / (F.col("dist") + 1e-6)
    rows = neighbors.join(layout.withColumnRenamed("cell", "neighbor"), "neighbor")
    return rows.groupBy(F.col("query").alias("cell")).agg((F.sum(weight * F.col("x")) / F.sum(weight)).alias("x"), (F.sum(weight * F.col("y")) / F.sum(weight)).alias("y"))


def affinities(x: np.ndarray, perplexity: float) -> np.ndarray:
    """Symmetric affinities whose rows have the given perplexity."""
    d2 = np.empty((len(x), len(x)))
    for lo in range(0, len(x), 16):  # some rows at a time: all differences would be as many times larger as there are dimensions
        d2[lo : lo + 16] = ((x[lo : lo + 16, None] - x[None]) ** 2).sum(axis=-1)
    low, high, beta = np.zeros(len(x)), np.full(len(x), np.inf), np.ones(len(x)) / max(np.median(d2), 1e-12)
    np.fill_diagonal(d2, np.inf)
    d2 -= d2.min(axis=1, keepdims=True)
    np.fill_diagonal(d2, 0)
    for _ in range(64):
        p = np.exp(-d2 * beta[:, None])
        np.fill_diagonal(p, 0)
        p /= np.maximum(p.sum(axis=1, keepdims=True), 1e-300)
        entropy = -(p * np.log(np.maximum(p, 1e-300))).sum(axis=1)
        wide = entropy > np.log(perplexity)
        low, high = np.where(wide, beta, low), np.where(wide, high, beta)
        beta = np.where(np.isinf(high), beta * 2, (low + np.where(np.isinf(high), 0, high)) / 2)
    return (p + p.T) / (2 * len(x))


def tsne(vectors: DataFrame, perplexity: float = 30.0, rounds: int = 500, seed: int = 1) -> DataFrame:
    """(cell, x, y): t-distributed layout of all cells.

    Up to ``MAX_EXACT`` cells it is exact (all pairs are held in one task).
    Beyond, as many landmarks, by hash, are laid out so, and every other cell is
    placed among its nearest landmarks.
    """
    if vectors.count() > MAX_EXACT:
        marks = cut(weighted_sample(vectors.select("cell", "vector", F.lit(1.0).alias("w")), "w", MAX_EXACT, seed).select("cell", "vector"), "landmarks")
        first = cut(tsne(marks, perplexity, rounds, seed), "layout")
        rest = vectors.select("cell", "vector").join(marks.select("cell"), "cell", "left_anti")
        return first.unionByName(placed(knn(marks, rest, 10), first))
    kind = vectors.schema["cell"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cell")
        x = np.stack(pdf["vector"].to_numpy())
        n = len(x)
        p = np.maximum(affinities(x, min(perplexity, (n - 1) / 3)), 1e-12)
        centred = x - x.mean(axis=0)
        y = centred @ np.linalg.svd(centred, full_matrices=False)[2][:2].T
        y = 1e-4 * y / max(y[:, 0].std(), 1e-12) + np.random.default_rng(seed).normal(size=(n, 2)) * 1e-6
        speed, rate = np.zeros_like(y), max(n / 12, 50.0)
        for e in range(rounds):
            q = 1 / (1 + ((y[:, None, 0] - y[None, :, 0]) ** 2 + (y[:, None, 1] - y[None, :, 1]) ** 2))
            np.fill_diagonal(q, 0)
            pull = ((12 if e < 100 else 1) * p - q / q.sum()) * q
            slope = 4 * (pull.sum(axis=1)[:, None] * y - pull @ y)
            speed = (0.5 if e < 100 else 0.8) * speed - rate * slope
            y = y + speed
        return pd.DataFrame({"cell": pdf["cell"], "x": y[:, 0], "y": y[:, 1]})

    return vectors.select("cell", "vector", F.lit(1).alias("g")).groupBy("g").applyInPandas(run, f"cell {kind}, x double, y double")
