"""Steps that failed on larger tables in round 3."""

import numpy as np
import pytest
from pyspark.sql import functions as F


def counts(spark, x, cells=None):
    from sparsewright.matrix import Matrix

    values = spark.createDataFrame([(i, int(j), float(x[i, j])) for i, j in zip(*(a.tolist() for a in np.nonzero(x)))], "feature int, cell long, value double")
    return Matrix(values, spark.range(x.shape[1]).withColumnRenamed("id", "cell") if cells is None else cells, spark.createDataFrame([(i,) for i in range(len(x))], "feature int"))


@pytest.mark.parametrize("family", ["poisson", "negbinom", "logistic"])
def test_glm_test_without_latent_columns_needs_no_design_matrix(spark, family):
    from sparsewright.functions import distributions as dist
    from sparsewright.operators.differential import glm_test

    rng = np.random.default_rng(8)
    x = rng.poisson(rng.uniform(0.1, 6, 30)[:, None], (30, 60)).astype(float)
    x[0], x[1, :30], x[2, 30:], x[3] = 2, 0, 0, 0
    x[3, 5] = 4
    first = (np.arange(60) < 25).astype(float)
    m = counts(spark, x)
    got = {r.feature: r.p_val for r in glm_test(m, m.cells.withColumn("g", F.when(F.col("cell") < 25, 1).otherwise(2)), family).collect()}
    assert set(got) == set(range(30)) - {0, 3}  # no spread; too few cells
    null = np.ones((60, 1))
    for i, p in got.items():
        if family == "logistic":
            full = np.column_stack([null, (x[i] - x[i].mean()) / x[i].std()])
            want = dist.chi2_sf(max(0.0, 2 * (dist.logistic_loglik(first, full) - dist.logistic_loglik(first, null))), 1)
        else:
            want = dist.glm_deviance_test(x[i], null, np.column_stack([null, first]), family)
        assert p == pytest.approx(want, abs=1e-6)
    # so many cells that their design would pass 64 MB
    many = counts(spark, x, spark.range(4_300_000).withColumnRenamed("id", "cell"))
    assert glm_test(many, many.cells.withColumn("g", F.when(F.col("cell") < 25, 1).otherwise(2)), family).count() == 29


def shuffled_rows(df):
    """The least number of rows that an exchange of the executed plan must take for pairs: exchanges above the step that makes them."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan
    return plan[: plan.index("MapInArrow")].count("Exchange")


def test_pairs_pass_no_shuffle_and_zeros_are_told_apart_by_block(spark, monkeypatch):
    from sparsewright import matrix
    from sparsewright.operators import residuals, scaling

    rng = np.random.default_rng(9)
    x = rng.poisson(0.7, (9, 50)).astype(float)
    x[4] = 0
    m = counts(spark, x, spark.range(50).select(F.col("id").alias("cell"), (F.col("id") * 3 % 11).cast("double").alias("c"), (F.col("id") % 2).alias("grp")))
    given = m.features.filter("feature != 4").select("feature", F.lit(-0.5).alias("intercept"), F.lit(0.2).alias("slope"), F.lit(3.0).alias("theta"))
    made = lambda: {"scale": scaling.scale_data(m), "split": scaling.scale_data_by(m, "grp"), "line": scaling.regress_linear(m, "c"), "pearson": residuals.pearson(m, given), "corrected": residuals.corrected_counts(m, given)}
    got = {k: df.toPandas().sort_values(["feature", "cell"]).reset_index(drop=True) for k, df in made().items()}
    assert all(shuffled_rows(df) == 0 for df in made().values())
    assert [len(got[k]) for k in ("scale", "split", "line", "pearson")] == [450, 450, 450, 400]
    monkeypatch.setattr(matrix, "BLOCK", 7)  # many blocks of cells
    for k, df in made().items():
        again = df.toPandas().sort_values(["feature", "cell"]).reset_index(drop=True)
        assert (again[["feature", "cell"]] == got[k][["feature", "cell"]]).all(axis=None) and np.allclose(again["value"], got[k]["value"])
    given_residuals = residuals.corrected_counts(m, given, residuals.pearson(m, given)).toPandas().sort_values(["feature", "cell"]).reset_index(drop=True)
    assert given_residuals.equals(got["corrected"])
    want = residuals.residual_variance(residuals.pearson(m, given), 4).toPandas()
    best = residuals.variable_features(m, given, 4).toPandas()
    assert best["feature"].tolist() == want["feature"].tolist() and np.allclose(best["residual_variance"], want["residual_variance"])


def test_fits_of_many_features_at_once_are_the_single_fits():
    from sparsewright.functions.distributions import fit_glm, fit_glms

    rng = np.random.default_rng(10)
    z = np.column_stack([np.ones(200), rng.normal(3, 0.4, 200)])
    y = rng.negative_binomial(2, 2 / (2 + np.exp(z @ [-2, 0.8])), (12, 200)).astype(float)
    y[3], y[4, :198] = 0, 0
    for family in ("poisson", "negbinom"):
        mu, theta, beta = fit_glms(y, z, family)
        for i in range(12):
            one, size = fit_glm(y[i], z, family)
            assert np.allclose(mu[i], one, rtol=1e-6, atol=1e-9) and min(theta[i], 1e6) == pytest.approx(min(size, 1e6), rel=1e-5)
            assert np.allclose(beta[i], np.linalg.lstsq(z, np.log(np.maximum(one, 1e-12)), rcond=None)[0], atol=1e-5)


def test_rounding_and_hashes_in_numpy_are_those_of_spark(spark):
    from sparsewright.functions.hashes import hash_of
    from sparsewright.plans.rounding import half_up, rounded

    x = np.concatenate([np.random.default_rng(3).normal(0, 9, 500), [0.0000005, -0.0000005, 1.0000005, 0.1234565, 2.5e-7, -0.0, 123456.1234565, 7.0]])
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    for digits in (4, 6):
        assert [r.x for r in rounded(df, digits).collect()] == half_up(x, digits).tolist()
    ids = spark.range(-5, 400).select(F.col("id").alias("a"), (F.col("id") * 7 - 90).cast("int").alias("b"), F.lit("k").alias("s"))
    rows = ids.select("a", "b", F.xxhash64("s").alias("h"), F.xxhash64("s", "a", "b", F.lit(3)).alias("all")).toPandas()
    h = hash_of(rows["b"].to_numpy(), hash_of(rows["a"].to_numpy(), rows["h"].to_numpy(), "bigint"), "int")
    assert hash_of(np.int64(3), h, "int").tolist() == rows["all"].tolist()


def test_shuffled_rows_are_the_permutation_of_the_windows(spark):
    from sparsewright.operators.verbs import shuffle_rows

    x = np.random.default_rng(12).poisson(0.5, (6, 40)).astype(float)
    m = counts(spark, x)
    got = {(r.feature, r.cell): r.value for r in shuffle_rows(m).collect()}
    hashes = {(r.feature, r.cell): r.h for r in m.features.crossJoin(m.cells).select("feature", "cell", F.xxhash64("feature", "cell", F.lit(1)).alias("h")).collect()}
    for i in range(6):
        order = sorted(range(40), key=lambda j: hashes[i, j])
        assert [got[i, order[k]] for k in range(40)] == x[i].tolist()
    assert shuffled_rows(shuffle_rows(m)) == 0


@pytest.mark.parametrize("ids", ["long", "string"])
def test_knn_sends_no_vector_more_than_once(spark, monkeypatch, ids):
    from sparsewright.operators import neighbors

    monkeypatch.setattr(neighbors, "BLOCK", 16)  # many blocks
    rng = np.random.default_rng(13)
    x, q = rng.integers(0, 3, (90, 3)).astype(float), rng.integers(0, 3, (40, 3)).astype(float)  # many ties
    frame = lambda a, first: spark.createDataFrame([(first + i, [float(e) for e in row]) for i, row in enumerate(a)], "cell long, vector array<double>").withColumn("cell", F.col("cell").cast(ids)).repartition(7)
    name = lambda i: str(i) if ids == "string" else i
    for asks, first, found in ((x, 100, neighbors.knn(v := frame(x, 100), k=6)), (q, 500, neighbors.knn(v, frame(q, 500), 6))):
        d = np.round(np.sqrt(((asks[:, None] - x[None]) ** 2).sum(axis=2)), 9)
        want = {(name(first + i), r + 1): name(100 + j) for i in range(len(asks)) for r, j in enumerate(sorted(range(90), key=lambda j, i=i: (d[i, j], name(100 + j)))[:6])}
        assert {(r.query, r["rank"]): r.neighbor for r in found.collect()} == want
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "CoGroup" not in plan and "Exchange" not in plan  # written: readers do not search again
    few = neighbors.knn(frame(x[:4], 0), frame(q, 500), 6)
    assert few.count() == 160 and neighbors.knn(v.filter("false"), v, 3).count() == 0


def test_module_scores_make_no_row_for_each_member_and_feature_of_a_bin(spark, monkeypatch):
    from sparsewright.operators import aggregate

    x = np.random.default_rng(14).poisson(1.0, (60, 20)).astype(float)
    m = counts(spark, x)
    sets = m.features.filter("feature % 3 = 0").select(F.when(F.col("feature") % 2 == 0, "a").otherwise("b").alias("set_name"), "feature")
    score = lambda: {(r.cell, r.set_name): r.score for r in aggregate.module_scores(m, sets, controls=4, bins=3).collect()}
    got = score()
    assert "CoGroup" in (plan := aggregate.module_scores(m, sets, controls=4, bins=3)._jdf.queryExecution().executedPlan().toString()) and "row_number" not in plan
    monkeypatch.setattr(aggregate, "INT", ())  # by windows over pairs, as for other types
    want = score()
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)


def test_leading_directions_beyond_the_side_are_those_of_the_matrix(spark, monkeypatch):
    from sparsewright.operators import reduction

    rng = np.random.default_rng(15)
    x = rng.poisson(rng.gamma(1, 2, (70, 1)) * rng.gamma(2, 0.5, (1, 45))).astype(float)
    m = counts(spark, x)
    a = np.where(rng.random((40, 40)) < 0.2, rng.random((40, 40)), 0)
    edges = spark.createDataFrame([(int(i), int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a))] + [(i, i, 1.0) for i in range(40)], "i long, j long, w double").groupBy("i", "j").agg(F.max("w").alias("w"))
    made = lambda: [{r.cell: r.vector for r in df.collect()} for df in (reduction.pca_sparse(m, 3)[0], reduction.laplacian(edges, 3))]
    want = made()
    monkeypatch.setattr(reduction, "MAX_SIDE", 20)
    for one, two in zip(made(), want, strict=True):
        assert one.keys() == two.keys() and all(np.allclose(one[c], two[c], atol=1e-4) for c in two)


def test_pca_sparse_reads_all_features(spark, monkeypatch):
    import __spark_entry__
    from sparsewright.operators import reduction

    seen = []
    monkeypatch.setattr(reduction, "pca_sparse", lambda m, k: (seen.append(m.features.count()), [spark.createDataFrame([(1, [1.0])], "cell int, vector array<double>")])[1])
    __spark_entry__.queries()["pca_sparse"](spark, "/root/testdata/sf0.001")
    assert seen == [spark.read.parquet("/root/testdata/sf0.001/part.parquet").count()]


def test_affinities_hold_no_array_of_pairs_and_dimensions():
    import tracemalloc

    from sparsewright.operators.layout import affinities

    x = np.random.default_rng(16).normal(size=(600, 64))
    tracemalloc.start()
    p = affinities(x, 20)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 * 600 * 600 * 12  # a few matrices of pairs; all differences are 64
    q = p * 2 * 600
    assert np.allclose(p, p.T) and q.sum() == pytest.approx(2 * 600, rel=1e-6)
