"""Integration, layouts, communities, trees and further tests, against what defines them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparsewright.functions import distributions as dist
from sparsewright.operators import clustering, integration, layout, neighbors, objects, trees


@pytest.fixture(scope="module")
def cells(spark):
    """Three types in two batches; the second batch is moved."""
    rng = np.random.default_rng(0)
    centre = rng.normal(size=(3, 8)) * 6
    move = rng.normal(size=8) * 2
    rows = [(b * 1000 + i, f"b{b}", i % 3, (centre[i % 3] + rng.normal(size=8) + b * move).tolist()) for b in (0, 1) for i in range(90)]
    return spark.createDataFrame(rows, "cell long, batch string, type int, vector array<double>").cache()


def near(rows, k=12):
    x = np.array([r.vector for r in rows])
    d = ((x[:, None] - x[None]) ** 2).sum(axis=-1)
    np.fill_diagonal(d, np.inf)
    return np.argsort(d, axis=1)[:, :k]


@pytest.mark.parametrize("method", ["cca", "rpca", "joint_pca", "harmony"])
def test_integration_mixes_batches_and_keeps_types(cells, method):
    known = {r.cell: (r.batch, r.type) for r in cells.collect()}
    layers = {b: cells.filter(F.col("batch") == b).select("cell", "vector") for b in ("b0", "b1")}
    use = method if method != "harmony" else lambda x: integration.harmonise(integration.joint_pca(x), integration.layer_labels(x), rounds=3, cluster_rounds=4)
    rows = integration.integrate_layers(layers, use).collect()
    assert sorted(r.cell for r in rows) == sorted(known)
    at = near(rows)
    of = [known[r.cell] for r in rows]
    assert np.mean([[of[j][1] == of[i][1] for j in at[i]] for i in range(len(rows))]) > 0.95
    assert np.mean([[of[j][0] != of[i][0] for j in at[i]] for i in range(len(rows))]) > 0.25


def test_unknown_integration_method(cells):
    with pytest.raises(ValueError):
        integration.integrate_layers({"a": cells}, "none")


def test_leiden_communities_are_connected_and_good():
    rng = np.random.default_rng(3)
    n = 120
    group = np.arange(n) // 20
    i, j = np.triu_indices(n, 1)
    on = rng.random(len(i)) < np.where(group[i] == group[j], 0.4, 0.02)
    i, j = i[on], j[on]
    g = clustering.Graph(n, i, j, np.ones(len(i)))
    label, q = clustering.best_partition(n, i, j, np.ones(len(i)), algorithm=4, starts=3)
    assert len(np.unique(clustering.connected(g, label))) == len(np.unique(label))
    assert q >= clustering.best_partition(n, i, j, np.ones(len(i)), algorithm=1, starts=3)[1] - 0.01
    assert np.mean([np.bincount(label[group == k]).max() / 20 for k in range(6)]) > 0.9


@pytest.mark.parametrize("kind", ["umap", "tsne"])
def test_layouts_keep_types_together(cells, kind):
    v = cells.filter("batch = 'b0'").select("cell", "vector")
    out = layout.umap(neighbors.knn(v, v, 12), v, epochs=100) if kind == "umap" else layout.tsne(v, perplexity=15, rounds=300)
    rows = out.orderBy("cell").collect()
    x = np.array([[r.x, r.y] for r in rows])
    d = ((x[:, None] - x[None]) ** 2).sum(axis=-1)
    np.fill_diagonal(d, np.inf)
    kinds = np.array([r.cell % 3 for r in rows])
    assert np.isfinite(x).all() and (kinds[np.argsort(d, axis=1)[:, :10]] == kinds[:, None]).mean() > 0.95


def test_landmarks_place_every_cell(cells, monkeypatch):
    monkeypatch.setattr(layout, "MAX_EXACT", 60)
    assert layout.tsne(cells, rounds=50).select("cell").distinct().count() == cells.count()


def test_membership_weights_add_up(cells):
    v = cells.select("cell", "vector")
    lists = neighbors.knn(v, v, 11)
    a, b = layout.curve(0.3)
    assert abs(1 / (1 + a * 0.01 ** (2 * b)) - 1) < 0.05
    rows = layout.memberships(lists).collect()
    assert all(0 < r.w <= 1 + 1e-9 and r.i < r.j for r in rows)


def test_nested_negbinom_finds_a_group_effect():
    rng = np.random.default_rng(1)
    group = np.repeat([0.0, 1.0], 150)
    batch = np.tile([0.0, 1.0], 150)
    even = rng.negative_binomial(3, 3 / (3 + np.exp(1 + 0.5 * batch)))
    moved = rng.negative_binomial(3, 3 / (3 + np.exp(1 + 0.5 * batch + 0.9 * group)))
    assert dist.nested_negbinom_test(moved.astype(float), batch[:, None], group[:, None], 3.0) < 1e-4 < dist.nested_negbinom_test(even.astype(float), batch[:, None], group[:, None], 3.0)


def test_trees():
    merges = trees.sample_tree(np.array([[0, 9, 1, 1], [9, 0, 1, 1], [1, 1, 0, 5], [1, 1, 5, 0]]))
    assert [m[:2] for m in merges] == [(0, 1), (2, 3), (4, 5)]
    assert trees.internal_nodes(merges, 4) == [6, 4, 5]
    assert (trees.left_leaves(merges, 4, 6), trees.right_leaves(merges, 4, 6)) == ([0, 1], [2, 3])
    assert trees.has_child(merges, 4, 6) and trees.has_only_children(merges, 4, 6) and not trees.has_child(merges, 4, 4)
    assert trees.integration_order(merges, 4) == [0, 1, 2, 3]
    assert trees.parsed_merge(merges, 4, 0) == ("-1", "-2") and trees.parsed_merge(merges, 4, 2) == ("1", "2")
    assert trees.adjusted(merges, 4, [1, 3, 5, 7])[0][:2] == (1, 3)


def test_names_and_lists(spark, tmp_path):
    assert objects.abbreviated("HelloWorld") == "hw" and objects.abbreviated("LetsGo3") == "lg3" and objects.abbreviated("tomato") == "tomato" and objects.abbreviated("Wow3", digits=False) == "wow3"
    assert objects.unused_name(["a", "a.1"], "a") == "a.2" and objects.unused_name([], "a") == "a"
    row = spark.range(1).select(objects.interleaved(F.array(F.lit(1), F.lit(3), F.lit(5)), F.array(F.lit(2), F.lit(4))).alias("x")).first()
    assert row.x == [1, 2, 3, 4, 5]
    edges = spark.createDataFrame([(2, 1, 0.5), (1, 2, 0.5), (3, 1, 1 / 3)], "i long, j long, w double")
    numbers = spark.createDataFrame([(1, 0), (2, 1), (3, 2)], "cell long, number long")
    objects.write_edges(edges, numbers, f"file://{tmp_path}/edges")
    assert sorted(r.value for r in spark.read.text(f"file://{tmp_path}/edges").collect()) == ["0\t1\t0.5", "0\t2\t0.333333333333333"]
    with pytest.raises(ValueError):
        objects.neighbors_of_graph(edges.unionAll(edges.limit(1)))
    p = {r.value: r.p for r in objects.empirical_p(spark.createDataFrame([(0.0,), (2.0,), (9.0,)], "value double"), spark.createDataFrame([(1.0,), (2.0,), (2.0,), (3.0,)], "value double")).collect()}
    assert p == {0.0: 1.0, 2.0: 0.25, 9.0: 0.0}
