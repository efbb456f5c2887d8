"""Core operators against numpy, and every registered query with SQL against DuckDB."""

import math
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def small(spark):
    """Six features, five cells: an empty cell, a constant row, a row of zeros, a single positive entry, ties."""
    from sparsewright.matrix import bundle
    from sparsewright.plans.session import ship

    ship(spark)
    x = np.array([[1, 0, 2, 0, 0], [3, 3, 3, 3, 3], [0, 0, 0, 0, 0], [0, 0, 0, 7, 0], [1, 1, 0, 2, 2], [0, 4, 0, 1, 9]], dtype=float)
    x = np.delete(np.insert(x, 5, 0, axis=1), [], axis=1)
    rows = [(f"g{i}", j, float(x[i, j])) for i in range(6) for j in range(6) if x[i, j]]
    cells = spark.createDataFrame([(j, ["a", "a", "a", "b", "b", None][j], float(j)) for j in range(6)], "cell int, grp string, c double")
    features = spark.createDataFrame([(f"g{i}",) for i in range(6)], "feature string")
    return bundle(spark.createDataFrame(rows, "feature string, cell int, value double"), cells, features), x


def wide(df, shape):
    out = np.zeros(shape)
    for r in df.collect():
        out[int(r.feature[1:]), r.cell] = r.value
    return out


def test_normalisation(small):
    from sparsewright.operators.normalize import clr, custom, log_normalize, normalize, relative_counts, sample_counts

    m, x = small
    totals = np.where(x.sum(axis=0) > 0, x.sum(axis=0), 1)
    assert np.allclose(wide(log_normalize(m).values, x.shape), np.log1p(x / totals * 1e4))
    assert np.allclose(wide(relative_counts(m, 1e6).values, x.shape), x / totals * 1e6)
    for margin in (1, 2):
        g = np.exp(np.log1p(x).sum(axis=2 - margin, keepdims=True) / x.shape[2 - margin])
        assert np.allclose(wide(clr(m, margin).values, x.shape), np.log1p(x / g))
    assert np.allclose(wide(custom(m, lambda s: s * 2).values, x.shape), 2 * x)
    assert normalize(m, None) is m
    with pytest.raises(ValueError):
        normalize(m, "other")
    down = wide(sample_counts(m, 4.0).values, x.shape)
    assert (np.abs(down - np.where(totals > 4, x * 4 / totals, x)) < 1).all()


def test_row_statistics(small):
    from sparsewright.operators.statistics import expm1_statistics, meta_feature, qc, row_moments

    m, x = small
    got = {r.feature: r for r in row_moments(m).collect()}
    for i in range(6):
        assert got[f"g{i}"].mean == pytest.approx(x[i].mean()) and got[f"g{i}"].variance == pytest.approx(x[i].var(ddof=1))
    e = {r.feature: r for r in expm1_statistics(m).collect()}
    assert e["g0"].log_vmr == pytest.approx(math.log(np.expm1(x[0]).var(ddof=1) / np.expm1(x[0]).mean()))
    assert e["g2"].log_vmr is None
    assert {(r.cell, r.n_count, r.n_feature) for r in qc(m).collect()} == {(j, x[:, j].sum(), (x[:, j] > 0).sum()) for j in range(6)}
    score = {r.cell: r.score for r in meta_feature(m, m.features.filter("feature in ('g0', 'g4')")).collect()}
    assert score[0] == pytest.approx((1 / 3 + 1 / 6) / 2) and score[5] == 0


def test_scaling(small):
    from sparsewright.operators.scaling import regress_linear, regress_out, scale_data, scale_data_by

    m, x = small
    sd = x.std(axis=1, ddof=1)
    z = np.minimum(np.where(sd[:, None] > 0, (x - x.mean(axis=1, keepdims=True)) / np.where(sd > 0, sd, 1)[:, None], 0), 1.5)
    assert np.allclose(wide(scale_data(m, clip=1.5), x.shape), z)
    rms = np.sqrt((x**2).sum(axis=1) / 5)
    assert np.allclose(wide(scale_data(m, centre=False), x.shape), np.where(rms[:, None] > 0, x / np.where(rms > 0, rms, 1)[:, None], 0))
    split = wide(scale_data_by(m, "grp"), x.shape)
    part = x[:, :3]
    s = part.std(axis=1, ddof=1)
    assert np.allclose(split[:, :3], np.where(s[:, None] > 0, (part - part.mean(axis=1, keepdims=True)) / np.where(s > 0, s, 1)[:, None], 0))
    design = np.column_stack([np.ones(6), np.arange(6)])
    residual = x - (design @ np.linalg.lstsq(design, x.T, rcond=None)[0]).T
    assert np.allclose(wide(regress_linear(m, "c"), x.shape), residual)
    assert np.allclose(wide(regress_out(m, ["c"]), x.shape), residual)


def test_pseudobulk(small):
    from sparsewright.operators.aggregate import pseudobulk, smooth_labels

    m, x = small
    got = {(r.feature, r.grp): r.value for r in pseudobulk(m, ["grp"]).collect()}
    assert got["g5", "a"] == pytest.approx(x[5, :3].mean()) and got["g5", "b"] == pytest.approx(x[5, 3:5].mean()) and got["g2", "b"] == 0
    sums = {(r.feature, r.grp): r.value for r in pseudobulk(m, ["grp"], "aggregate").collect()}
    assert sums["g3", "b"] == 7
    assert [tuple(r) for r in smooth_labels(m.cells.withColumn("k", F.lit(1)), "k", "grp").collect()] == [(1, "a")]


def ranks(v):
    order = np.argsort(v, kind="stable")
    r = np.empty(len(v))
    r[order] = np.arange(1, len(v) + 1)
    return np.array([r[v == x].mean() for x in v])


def test_differential(small):
    from sparsewright.operators import differential as d

    m, x = small
    groups = d.two_groups(m, "grp", "a", "b")
    u = {r.feature: r for r in d.wilcoxon(m, groups).collect()}
    for i in range(6):
        v = x[i, :5]
        assert u[f"g{i}"].u == pytest.approx(ranks(v)[:3].sum() - 6)
    assert u["g2"].z is None and u["g2"].p_val == 1
    fc = {r.feature: r for r in d.fold_change(m, groups, layer="counts").collect()}
    assert fc["g5"].avg_log_fc == pytest.approx(math.log2((4 + 1) / 3) - math.log2((10 + 1) / 2))
    assert (fc["g5"].pct_1, fc["g5"].pct_2) == (0.333, 1.0)
    t = {r.feature: r for r in d.welch_t(m, groups).collect()}
    a, b = x[5, :3], x[5, 3:5]
    assert t["g5"].t == pytest.approx((a.mean() - b.mean()) / math.sqrt(a.var(ddof=1) / 3 + b.var(ddof=1) / 2))
    with pytest.raises(ValueError):
        d.find_markers(m, "grp", "a", "b")
    rows = {(r.cluster, r.feature): r.u for r in d.one_vs_rest(m, "grp").collect()}
    assert rows["a", "g5"] == pytest.approx(u["g5"].u)


def test_distributions():
    from sparsewright.functions import distributions as d

    assert d.normal_sf2(1.959964)[()] == pytest.approx(0.05, abs=1e-6)
    assert d.chi2_sf(3.841459, 1) == pytest.approx(0.05, abs=1e-6)
    assert d.t_sf2(2.228139, 10) == pytest.approx(0.05, abs=1e-6)
    assert d.negbinom_quantile(0.99, 3.0, math.inf) == 8
    y = np.array([1, 2, 3, 4, 7, 9.0])
    x = np.column_stack([np.ones(6), np.arange(6)])
    mu, _ = d.fit_glm(y, x, "poisson")
    assert np.allclose(x.T @ (y - mu), 0, atol=1e-6)


def test_loess_follows_quadratics():
    from sparsewright.operators.variable_features import loess_quadratic

    x = np.linspace(0, 1, 40)
    assert np.allclose(loess_quadratic(x, 1 + 2 * x - x * x), 1 + 2 * x - x * x)


KARATE = "0-1 0-2 0-3 0-4 0-5 0-6 0-7 0-8 0-10 0-11 0-12 0-13 0-17 0-19 0-21 0-31 1-2 1-3 1-7 1-13 1-17 1-19 1-21 1-30 2-3 2-7 2-8 2-9 2-13 2-27 2-28 2-32 3-7 3-12 3-13 4-6 4-10 5-6 5-10 5-16 6-16 8-30 8-32 8-33 9-33 13-33 14-32 14-33 15-32 15-33 18-32 18-33 19-33 20-32 20-33 22-32 22-33 23-25 23-27 23-29 23-32 23-33 24-25 24-27 24-31 25-31 26-29 26-33 27-33 28-31 28-33 29-32 29-33 30-32 30-33 31-32 31-33 32-33"


@pytest.mark.parametrize("algorithm", [1, 2, 3])
def test_communities_of_the_karate_club(algorithm):
    from sparsewright.operators.clustering import best_partition

    edges = np.array([list(map(int, e.split("-"))) for e in KARATE.split()])
    assert len(edges) == 78
    label, quality = best_partition(34, edges[:, 0], edges[:, 1], np.ones(78), algorithm=algorithm, starts=20, seed=1)
    assert quality == pytest.approx(0.4198, abs=1e-3)
    assert sorted(np.bincount(label), reverse=True) == list(np.bincount(label)) and label.max() == 3


def test_neighbours_and_snn(spark):
    from sparsewright.operators import neighbors

    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 4))
    x[7] = x[3]  # a tie
    v = spark.createDataFrame([(i, list(map(float, r))) for i, r in enumerate(x)], "cell long, vector array<double>")
    got = {}
    for r in neighbors.knn(v, k=5).collect():
        got.setdefault(r.query, {})[r.rank] = r.neighbor
    d = np.round(np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=-1)), 9)
    want = np.array([np.lexsort((np.arange(60), d[i]))[:5] for i in range(60)])
    assert [[got[i][k + 1] for k in range(5)] for i in range(60)] == want.tolist()
    edges = {(r.i, r.j): r.w for r in neighbors.snn(neighbors.knn(v, k=5), 5, 0.0).collect()}
    for i in range(60):
        for j in range(60):
            s = len(set(want[i]) & set(want[j]))
            assert edges.get((i, j), 0) == pytest.approx(s / (10 - s))


def test_reduction(spark):
    from sparsewright.operators import reduction

    rng = np.random.default_rng(2)
    x = rng.normal(size=(50, 6)) @ np.diag([5, 3, 2, 1, 1, 1])
    v = spark.createDataFrame([(i, list(map(float, r))) for i, r in enumerate(x)], "cell long, vector array<double>")
    _, load, sd = reduction.pca(v, 3)
    s = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(sd, s.S[:3] / 7) and np.allclose(np.abs(load), np.abs(s.Vh[:3].T))
    _, _, sd2 = reduction.pca(v, 3, recentre=True)
    assert np.allclose(sd2, np.linalg.svd(x - x.mean(axis=0)).S[:3] / 7)
    one, two = v.filter("cell < 25"), v.filter("cell >= 25")
    a, b, sv = reduction.cca(one, two, 2)
    st = lambda y: (y - y.mean(axis=1, keepdims=True)) / y.std(axis=1, ddof=1, keepdims=True)
    assert np.allclose(sv, np.linalg.svd(st(x[:25]) @ st(x[25:]).T).S[:2])
    assert np.allclose(np.linalg.norm(np.array([r.vector for r in a.orderBy("cell").collect()]), axis=0), 1)


def test_readers(spark, tmp_path):
    from sparsewright.sources import matrix_market, tables

    (tmp_path / "matrix.mtx").write_text("%%MatrixMarket matrix coordinate real general\n%\n3 2 3\n1 1 5\n3 1 2\n2 2 4\n")
    (tmp_path / "genes.tsv").write_text("e1\tA\ne2\tB\ne3\tA\n")
    (tmp_path / "barcodes.tsv").write_text("AC-1\nGT-1\n")
    m = next(iter(matrix_market.read_10x(spark, str(tmp_path), strip_suffix=True).values()))
    assert {tuple(r) for r in m.values.collect()} == {("A", "AC", 5.0), ("A.1", "AC", 2.0), ("B", "GT", 4.0)}
    with pytest.raises(ValueError, match="skip"):
        matrix_market.read_mtx(spark, str(tmp_path / "matrix.mtx"), str(tmp_path / "barcodes.tsv"), str(tmp_path / "genes.tsv"), skip_cell=1)
    matrix_market.write_mtx(m, str(tmp_path / "out"))
    assert matrix_market.read_written(spark, str(tmp_path / "out")).values.count() == 3
    (tmp_path / "scale.json").write_text('{"spot_diameter_fullres": 7.0,\n "tissue_lowres_scalef": 0.1}')
    assert tuple(tables.read_scale_factors(spark, str(tmp_path / "scale.json")).first()) == (7.0, None, None, 0.1)
    (tmp_path / "pos.csv").write_text("barcode,in_tissue,array_row,array_col,pxl_row_in_fullres,pxl_col_in_fullres\nAC,1,0,0,10,20\nGT,0,0,1,11,21\n")
    assert [tuple(r) for r in tables.read_coordinates(spark, str(tmp_path / "pos.csv")).collect()] == [("AC", 20.0, 10.0)]
    (tmp_path / "poly.json").write_text('{"features": [{"properties": {"cell_id": "c1"}, "geometry": {"type": "Polygon", "coordinates": [[[0, 1], [2, 3]]]}}]}')
    assert {tuple(r) for r in tables.read_polygons(spark, str(tmp_path / "poly.json")).collect()} == {("c1", 0, 0.0, 1.0), ("c1", 1, 2.0, 3.0)}
    (tmp_path / "wide.csv").write_text("cell,A,DAPI,B\nx,1,9,0\ny,0,9,2\n")
    assert {tuple(r) for r in tables.read_wide(spark, str(tmp_path / "wide.csv"), "cell").collect()} == {("A", "x", 1.0), ("B", "y", 2.0)}
    (tmp_path / "genes.json").write_text('{"A": {"cells": {"x": 2, "y": 0}}}')
    assert [tuple(r) for r in tables.read_nested_counts(spark, str(tmp_path / "genes.json")).collect()] == [("A", "x", 2.0)]


def test_scalar_functions(spark):
    from sparsewright.functions import scalar as s

    one = spark.createDataFrame([("a_b_c", "(1,4]", "3:5", "7.5", 5.0, -1.0)], "t string, r string, n string, m string, x double, y double")
    row = one.select(
        s.extract_field(F.col("t"), [1, 3]), s.remove_last_field(F.col("t")), s.mean_range(F.col("r")), s.to_numeric(F.col("n")), s.to_numeric(F.col("m")), s.min_max(F.col("x"), 0, 2), s.relu(F.col("y")), s.l2_normalize(F.array(F.lit(3.0), F.lit(4.0)))
    ).first()
    assert tuple(row) == ("a_c", "a_b", 2.5, [3.0, 4.0, 5.0], [7.5], 2.0, 0.0, [0.6, 0.8])


def test_streaming_counts(spark, tmp_path):
    from sparsewright.streaming.counts import start_counts, windowed_counts

    rows = spark.createDataFrame([("2024-01-01 00:10:00", 1, "a"), ("2024-01-01 00:20:00", 1, "a"), ("2024-01-01 09:00:00", 2, "b")], "ts string, u int, e string").withColumn("ts", F.to_timestamp("ts"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    start_counts(stream, str(tmp_path / "out"), str(tmp_path / "state"), ts="ts", cell="u", feature="e").awaitTermination(60)
    got = {(r.cell, r.feature, r.value) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert (1, "a", 2) in got
    assert windowed_counts(rows, "ts", "u", "e").count() == 2


def sql_names():
    from sparsewright import registry

    return sorted(registry.SQL)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for name in os.listdir(SF):
        c.execute(f"create view {name.split('.')[0]} as select * from '{SF}/{name}'")
    return c


def canonical(df: pd.DataFrame):
    def one(x):
        if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and x != x):
            return None
        if isinstance(x, (bool, np.bool_)):
            return bool(x)
        if isinstance(x, (int, np.integer)):
            return int(x)
        return round(float(x), 5) + 0.0 if isinstance(x, (float, np.floating)) else str(x)

    return sorted((tuple(one(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sql_names())
def test_query_equals_sql(spark, duck, name):
    from sparsewright import registry

    a, b = canonical(registry.QUERIES[name](spark, SF).toPandas()), canonical(duck.sql(registry.SQL[name]).df())
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert all(p == q or (isinstance(p, float) and isinstance(q, float) and abs(p - q) < 2e-5 * max(1, abs(p))) for p, q in zip(x, y)), (x, y)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_presets(spark, tmp_path):
    from sparsewright.sources import presets

    (tmp_path / "DGE.mtx").write_text("%%MatrixMarket matrix coordinate real general\n2 3 2\n1 3 5\n2 1 2\n")
    (tmp_path / "cell_metadata.csv").write_text("bc,x\nc1,0\nc2,0\n")
    (tmp_path / "all_genes.csv").write_text("id,name\n1,A\n2,B\n3,C\n")
    m = presets.read_parse_bio(spark, str(tmp_path))
    assert {tuple(r) for r in m.values.collect()} == {("C", "c1", 5.0), ("A", "c2", 2.0)}
    xy = spark.createDataFrame([("c1", 1.0, 2.0)], "cell string, x double, y double")
    assert {tuple(r) for r in presets.load_spatial_counts(m, xy).values.collect()} == {("C", "c1", 5.0)}
    assert tuple(presets.flip(xy).first()) == ("c1", 2.0, 1.0)
    (tmp_path / "counts.csv").write_text("1,0\n0,3\n")
    (tmp_path / "genes.csv").write_text("A\nB\n")
    (tmp_path / "centroids.tsv").write_text("0.5 1\n2 3\n")
    p = presets.load_positional(spark, *(str(tmp_path / n) for n in ("counts.csv", "genes.csv", "centroids.tsv")))
    assert {tuple(r) for r in p.values.collect()} == {("A", 1, 1.0), ("B", 2, 3.0)} and p.cells.count() == 2
    (tmp_path / "t.csv").write_text("cell_id,feature_name,qv\nx,A,30\nx,A,10\nx,Blank1,40\n")
    t = presets.load_transcripts(spark, str(tmp_path / "t.csv"), skip="Blank")
    assert [tuple(r) for r in t.values.collect()] == [("A", "x", 1.0)]


def test_independent_components(spark):
    from sparsewright.operators.reduction import ica

    rng = np.random.default_rng(3)
    s = np.column_stack([rng.uniform(-1, 1, 1500), rng.laplace(size=1500)])
    x = s @ np.array([[1.0, 0.6, 0.2], [0.5, -1.0, 0.7]])
    v = spark.createDataFrame([(i, list(map(float, r))) for i, r in enumerate(x)], "cell long, vector array<double>")
    got = np.array([r.vector for r in ica(v, 2)[0].orderBy("cell").collect()])
    c = np.abs(np.corrcoef(got.T, s.T)[:2, 2:])
    assert c.max(axis=1).min() > 0.98 and set(c.argmax(axis=1)) == {0, 1}


@pytest.mark.parametrize("dims, k", [(24, 20), (5, 20), (5, 400)])
def test_bucket_neighbours_recall(spark, dims, k):
    """Vectors off the origin with a heap of equal ones, of many dimensions (exact blocks) and few (buckets): nine of ten true neighbours, and always k of them."""
    from sparsewright.operators.neighbors import knn, knn_buckets

    x = np.random.default_rng(4).normal(size=(900, dims)) + 5
    x[:60] = x[0]
    v = spark.createDataFrame([(i, [float(e) for e in row]) for i, row in enumerate(x)], "cell int, vector array<double>")
    true, got = ({(r.query, r.neighbor) for r in f.collect()} for f in (knn(v, k=k), knn_buckets(v, v, k)))
    assert len(got) == 900 * k and len(got & true) >= 0.9 * len(true)
    assert dims != 5 or k != 20 or got != true


def test_residuals_of_features_outside_the_fitted_cells(spark):
    from sparsewright.matrix import bundle
    from sparsewright.operators.residuals import corrected_counts, depth, fit_parameters, pearson, residual_variance, smoothed

    rng = np.random.default_rng(5)
    x = rng.poisson(rng.uniform(0.2, 4, 12)[:, None] * rng.uniform(0.5, 2, 80)[None]).astype(float)
    cells = spark.createDataFrame([(j,) for j in range(80)], "cell int")
    table = lambda a: spark.createDataFrame([(f"g{i}", int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a))], "feature string, cell int, value double")
    kept = {r.cell for r in depth(bundle(table(x), cells)).orderBy(F.xxhash64("cell"), "cell").limit(30).collect()}
    rare = np.zeros((1, 80))
    rare[0, [j for j in range(80) if j not in kept][0]] = 3
    m = bundle(table(np.vstack([x, rare])), cells)
    p = smoothed(fit_parameters(m, fit_cells=30))
    got = {r.feature: r for r in p.collect()}
    assert set(got) == {f"g{i}" for i in range(13)}
    assert all(got[f"g{i}"].mean == pytest.approx(v.mean()) for i, v in enumerate(np.vstack([x, rare])))
    r = got["g12"]
    middle = np.mean([d.depth for d in depth(m).collect()])
    assert 0.5 < np.exp(r.intercept + r.slope * middle) / r.mean < 2 and 0 < r.theta <= 1e6
    residuals = pearson(m, p)
    assert residuals.filter("feature = 'g12'").count() == 80 and residuals.filter("isnan(value) or value is null").count() == 0
    assert residual_variance(residuals).filter("feature = 'g12'").count() == 1
    assert corrected_counts(m, p, pearson(m, p, clip=100.0)).filter("feature = 'g12'").count() > 0


def test_densities_and_trend_use_all_values():
    from sparsewright.operators.demultiplexing import density_threshold
    from sparsewright.operators.variable_features import loess_quadratic

    rng = np.random.default_rng(6)
    x = np.concatenate([rng.poisson(2, 3000), rng.poisson(60, 900)]).astype(float)
    value, count = np.unique(x, return_counts=True)
    assert density_threshold(value, 0.7, count) == pytest.approx(density_threshold(x, 0.7))
    # one local fit at each point, however many
    x = np.sort(rng.uniform(0, 1, 900))
    y = np.sin(12 * x) + rng.normal(0, 0.3, 900)
    got = loess_quadratic(x, y, 0.05)
    for i in range(0, 900, 50):
        d = np.abs(x - x[i])
        near = np.argsort(d, kind="stable")[:45]
        w = (1 - (d[near] / d[near].max()) ** 3) ** 1.5
        design = np.column_stack([np.ones(45), x[near] - x[i], (x[near] - x[i]) ** 2]) * w[:, None]
        assert got[i] == pytest.approx(np.linalg.lstsq(design, y[near] * w, rcond=None)[0][0], abs=1e-9)


def test_mixscape_uses_all_controls(spark):
    from sparsewright.operators.demultiplexing import mixscape, two_normals

    score = np.arange(100_200) % 1000 / 500.0
    score[-200:] = 40.0
    v = spark.createDataFrame(pd.DataFrame({"cell": np.arange(100_200), "target": "NT", "score": score}))
    few = [float(i) for i in range(1, 9)]
    got = mixscape(v.unionByName(spark.createDataFrame([(-i, "t", x) for i, x in enumerate(few, 1)], "cell long, target string, score double")), "NT")
    post = [r.posterior for r in got.filter("target = 't'").orderBy(F.desc("cell")).collect()]
    assert np.allclose(post, two_normals(np.array(few), score.mean(), score.std(ddof=1)))


def test_jackstraw_queries_ask_for_the_reference_replicates(monkeypatch):
    import __spark_entry__
    from sparsewright.operators import reduction

    asked = []

    def stop(v, k, replicates):
        asked.append((k, replicates))
        raise KeyError("asked")

    class Spark:
        def __getattr__(self, name):
            return lambda *a, **b: self

    monkeypatch.setattr(reduction, "jackstraw", stop)
    for module in ("graph_queries", "more_queries"):
        monkeypatch.setattr(f"sparsewright.plans.{module}.embedding_table", lambda *a: Spark())
    for name in ("jackstraw", "significant_features"):
        with pytest.raises(KeyError, match="asked"):
            __spark_entry__.queries()[name].__wrapped__(Spark(), "") if hasattr(__spark_entry__.queries()[name], "__wrapped__") else __import__("sparsewright.plans.graph_queries", fromlist=["QUERIES"]).QUERIES[name](Spark(), "")
    assert asked == [(20, 100), (20, 100)]
