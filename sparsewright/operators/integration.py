"""Integration of layers: anchors in shared spaces, soft clusters, and what sketches carry over."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparsewright.functions.scalar import l2_normalize
from sparsewright.operators import mapping, neighbors, reduction, sketching
from sparsewright.plans.scratch import cut

Layers = dict[str, DataFrame]


def union(layers: Layers) -> DataFrame:
    """(cell, vector, layer) of all layers."""
    out = None
    for name in sorted(layers):
        one = layers[name].select("cell", "vector", F.lit(name).alias("layer"))
        out = one if out is None else out.unionByName(one)
    return out


def layer_labels(layers: Layers) -> DataFrame:
    """(cell, layer)."""
    return union(layers).select("cell", "layer")


def unit(vectors: DataFrame) -> DataFrame:
    return vectors.select("cell", l2_normalize(F.col("vector")).alias("vector"))


def joint_pca(layers: Layers, dims: int = 30) -> DataFrame:
    """(cell, vector): principal components of all cells together."""
    return reduction.pca(union(layers).select("cell", "vector"), dims, recentre=True)[0]


def standardised(vectors: DataFrame) -> DataFrame:
    """Each coordinate over its standard deviation, then each vector over its norm."""
    n = len(vectors.select("vector").first()[0])
    sd = vectors.agg(*(F.stddev(F.get("vector", i)).alias(f"s{i}") for i in range(n))).first()
    by = F.array(*(F.lit(float(s or 1.0)) for s in sd))
    return unit(vectors.select("cell", F.zip_with("vector", by, lambda v, s: F.coalesce(F.try_divide(v, s), F.lit(0.0))).alias("vector")))


def reciprocal_project(a: DataFrame, b: DataFrame, dims: int = 30) -> tuple[DataFrame, DataFrame]:
    """Both sets in the components of the first, and both in those of the second: each standardised within its own set, the other projected."""

    def space(own: DataFrame, other: DataFrame) -> DataFrame:
        ours, loadings, _ = reduction.pca(own, dims, recentre=True)
        n = len(loadings)
        about = other.agg(*(F.avg(F.get("vector", i)).alias(f"m{i}") for i in range(n))).first()
        theirs = reduction.project(other, loadings, np.array(list(about), dtype=float))
        return cut(standardised(ours.unionByName(theirs)), "reciprocal")

    return space(a, b), space(b, a)


def reciprocal_anchors(a: DataFrame, b: DataFrame, k_anchor: int = 5, k_score: int = 30, dims: int = 30) -> DataFrame:
    """Anchors whose ends are near in each other's components."""
    one, two = reciprocal_project(a, b, dims)
    k = max(k_anchor, k_score)
    of = lambda space, cells: space.join(cells.select("cell"), "cell", "left_semi")
    near = {
        "aa": neighbors.knn(of(one, a), of(one, a), k + 1),
        "ba": neighbors.knn(of(one, a), of(one, b), k),
        "bb": neighbors.knn(of(two, b), of(two, b), k + 1),
        "ab": neighbors.knn(of(two, b), of(two, a), k),
    }
    return mapping.score_anchors(mapping.mutual_neighbors(near["ab"], near["ba"], k_anchor), near, k_score)


def canonical_anchors(a: DataFrame, b: DataFrame, k_anchor: int = 5, k_score: int = 30, dims: int = 20) -> DataFrame:
    """Anchors in the two sets' canonical space."""
    x, y, _ = reduction.cca(a, b, dims)
    return mapping.find_anchors(cut(unit(x), "cca"), cut(unit(y), "cca"), k_anchor, k_score)


def joint_anchors(a: DataFrame, b: DataFrame, k_anchor: int = 5, k_score: int = 30, dims: int = 30) -> DataFrame:
    """Anchors in the principal components of both sets together."""
    e = cut(unit(joint_pca({"a": a, "b": b}, dims)), "joint")
    of = lambda cells: e.join(cells.select("cell"), "cell", "left_semi")
    return mapping.find_anchors(of(a), of(b), k_anchor, k_score)


def integrate_pairwise(layers: Layers, anchors: Callable[[DataFrame, DataFrame], DataFrame], embedding: DataFrame | None = None, k_weight: int = 50) -> DataFrame:
    """(cell, vector): the joint embedding, layer after layer corrected onto those before, the largest first. The loop is over layers."""
    e = cut(joint_pca(layers) if embedding is None else embedding, "embedding")
    names = sorted(layers, key=lambda k: (-layers[k].count(), k))
    of = lambda part, cells: part.join(cells.select("cell"), "cell", "left_semi")
    data, done = layers[names[0]].select("cell", "vector"), of(e, layers[names[0]])
    for name in names[1:]:
        fresh = layers[name].select("cell", "vector")
        found = cut(anchors(data, fresh), "anchors")
        query = of(e, fresh)
        weights = cut(mapping.anchor_weights(found, query, k_weight), "weights")
        moved = mapping.vector_form(mapping.correct(weights, mapping.long_form(done), mapping.long_form(query)))
        done = cut(done.unionByName(moved), "integrated")
        data = data.unionByName(fresh)
    return done


def harmonise(vectors: DataFrame, batch: DataFrame, clusters: int = 20, theta: float = 2.0, sigma: float = 0.1, ridge: float = 1.0, rounds: int = 10, cluster_rounds: int = 10, seed: int = 5) -> DataFrame:
    """(cell, vector): embeddings without what batches add inside soft clusters.

    Rounds of two steps, each one pass of partial sums (clusters x batches x
    dimensions): soft k-means on unit vectors with a penalty for clusters that
    batches share unevenly, then a ridge regression on the batches in each
    cluster, of which all but the intercept is taken off. Passes start from the
    original vectors and the corrections so far, so nothing is cached between them.
    """
    rows = cut(vectors.select("cell", "vector").join(batch.select("cell", F.col(batch.columns[-1]).alias("batch")), "cell").filter("batch is not null"), "harmony")
    names = [r[0] for r in rows.select("batch").distinct().orderBy("batch").collect()]
    start = np.array([r[0] for r in rows.orderBy(F.xxhash64("cell", F.lit(seed)), "cell").limit(2000).select("vector").collect()])
    k, b, d = min(clusters, len(start)), len(names), start.shape[1]
    sc, place = rows.sparkSession.sparkContext, {n: i for i, n in enumerate(names)}
    rng = np.random.default_rng(seed)
    norm = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    centres = norm(start)[rng.choice(len(start), k, replace=False)]
    for _ in range(20):  # plain k-means on the bounded sample
        near = (norm(start) @ centres.T).argmax(axis=1)
        centres = norm(np.array([norm(start)[near == i].sum(axis=0) if (near == i).any() else centres[i] for i in range(k)]))
    steps: list = []  # (centres, penalty, per-cluster batch effects) of each round so far
    penalty = np.ones((k, b))

    def member(x: np.ndarray, of: np.ndarray, centres: np.ndarray, penalty: np.ndarray) -> np.ndarray:
        r = np.exp(-2 * (1 - norm(x) @ centres.T) / sigma) * penalty[:, of].T
        return r / np.maximum(r.sum(axis=1, keepdims=True), 1e-300)

    def corrected(x: np.ndarray, of: np.ndarray, steps: list) -> np.ndarray:
        for centres, penalty, effect in steps:
            r = member(x, of, centres, penalty)
            x = x - np.einsum("nk,nkd->nd", r, effect.transpose(1, 0, 2)[of])
        return x

    def sums(centres: np.ndarray, penalty: np.ndarray) -> np.ndarray:
        held = sc.broadcast((centres, penalty, list(steps), place))  # clusters x batches x dimensions a round

        def partial(frames):
            centres, penalty, steps, place = held.value
            total = np.zeros((k, b, 2 * d + 1))
            for pdf in frames:
                if len(pdf):
                    of = pdf["batch"].map(place).to_numpy()
                    x = corrected(np.stack(pdf["vector"].to_numpy()), of, steps)
                    r = member(x, of, centres, penalty)
                    wide = np.concatenate([np.ones((len(x), 1)), x, norm(x)], axis=1)
                    for i in np.unique(of):
                        total[:, i] += r[of == i].T @ wide[of == i]
            yield pd.DataFrame({"k": np.arange(k), "row": list(total.reshape(k, -1))})

        def add(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"k": pdf["k"].iloc[:1], "row": [np.stack(pdf["row"].to_numpy()).sum(axis=0)]})

        found = rows.mapInPandas(partial, "k int, row array<double>").groupBy("k").applyInPandas(add, "k int, row array<double>").collect()
        return np.array([r.row for r in sorted(found, key=lambda r: r.k)]).reshape(k, b, 2 * d + 1)

    for _ in range(rounds):
        last = None
        for _ in range(cluster_rounds):
            total = sums(centres, penalty)
            held = total[:, :, 0]
            expected = held.sum(axis=1, keepdims=True) * held.sum(axis=0, keepdims=True) / max(held.sum(), 1e-12)
            penalty = ((expected + 1) / (held + 1)) ** theta
            centres = norm(total[:, :, d + 1 :].sum(axis=1))
            if last is not None and np.abs(centres - last).max() < 1e-3:
                break
            last = centres
        total = sums(centres, penalty)
        effect = np.zeros((k, b, d))
        for i in range(k):
            design = np.zeros((b + 1, b + 1))
            n = total[i, :, 0]
            design[0, 0], design[0, 1:], design[1:, 0] = n.sum(), n, n
            design[1:, 1:] = np.diag(n + ridge)
            right = np.concatenate([total[i, :, 1 : d + 1].sum(axis=0, keepdims=True), total[i, :, 1 : d + 1]])
            effect[i] = (np.linalg.pinv(design) @ right)[1:]
        steps.append((centres.copy(), penalty.copy(), effect))
        if np.abs(effect).max() < 1e-3 * max(np.abs(total[:, :, 1 : d + 1]).sum() / max(total[:, :, 0].sum(), 1e-12), 1e-12):
            break
    held = sc.broadcast((list(steps), place))

    def run(frames):
        steps, place = held.value
        for pdf in frames:
            if len(pdf):
                x = corrected(np.stack(pdf["vector"].to_numpy()), pdf["batch"].map(place).to_numpy(), steps)
                yield pd.DataFrame({"cell": pdf["cell"], "vector": list(x)})

    kind = rows.schema["cell"].dataType.simpleString()
    return rows.mapInPandas(run, f"cell {kind}, vector array<double>")


METHODS: dict[str, Callable[[Layers], DataFrame]] = {
    "cca": lambda layers: integrate_pairwise(layers, canonical_anchors),
    "rpca": lambda layers: integrate_pairwise(layers, reciprocal_anchors),
    "joint_pca": lambda layers: integrate_pairwise(layers, joint_anchors),
    "harmony": lambda layers: harmonise(joint_pca(layers), layer_labels(layers)),
}


def integrate_layers(layers: Layers, method: str | Callable[[Layers], DataFrame] = "cca") -> DataFrame:
    """(cell, vector) of all layers' cells by a named method or any function of the layers."""
    if callable(method):
        return method(layers)
    if method not in METHODS:
        raise ValueError(f"unknown method: {method}")
    return METHODS[method](layers)


def project_data(sketch: DataFrame, embeddings: DataFrame, every: DataFrame, labels: DataFrame, k_weight: int = 50) -> tuple[DataFrame, DataFrame]:
    """(embeddings, predictions) of all cells from a sketch: the embedding carried over by the best linear map, labels by the nearest sketched cells."""
    full = cut(sketching.unsketch(embeddings, sketch, every), "projected")
    near = neighbors.knn(embeddings, full, k_weight)
    weights = near.select(F.col("query").alias("cell"), F.col("neighbor").alias("cell1"), F.col("neighbor").alias("cell2"), (1 / (1 + F.col("dist"))).alias("w"))
    total = weights.groupBy("cell").agg(F.sum("w").alias("t"))
    weights = weights.join(total, "cell").select("cell", "cell1", "cell2", (F.col("w") / F.col("t")).alias("weight"))
    return full, mapping.transfer_labels(weights, labels)


def project_integration(sketch: DataFrame, integrated: DataFrame, every: DataFrame) -> DataFrame:
    """Integrated embeddings of sketched cells carried to all cells."""
    return sketching.unsketch(integrated, sketch, every)


def feature_sketch(values: DataFrame, n_features: int, ratio: float = 0.8, seed: int = 123) -> DataFrame:
    """Count sketch of the features to a share of their number."""
    return sketching.count_sketch(values, max(1, int(n_features * ratio)), seed)


def smoothed_lsi(vectors: DataFrame, edges: DataFrame, k: int = 50) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(embeddings, loadings, singular values) of the matrix smoothed over a cell graph (i, j, w).

    With X cells x features and the graph G, the roots of the singular values
    are those of X'GG'X, so only a feature x feature matrix is decomposed.
    """
    right = edges.join(vectors.select(F.col("cell").alias("i"), F.col("vector").alias("v")), "i").select("j", "w", F.posexplode("v").alias("dim", "x"))
    summed = right.groupBy(F.col("j").alias("cell"), "dim").agg(F.sum(F.col("w") * F.col("x")).alias("value"))
    w, v = reduction.leading(reduction.gram(cut(mapping.vector_form(summed), "smoothed")), k)
    d = np.sqrt(np.maximum(w, 0))
    return reduction.project(vectors, v / np.where(d > 0, d, 1)), v, d
