"""Queries of integration methods, layouts, Leiden communities and further tests; SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparsewright.matrix import Matrix, embedding_table, sales_matrix
from sparsewright.operators import clustering, demultiplexing, differential, integration, layout, mapping, neighbors, reduction, residuals, variable_features
from sparsewright.plans import matrix_queries
from sparsewright.plans.matrix_queries import FIRST, SECOND, data
from sparsewright.plans.rounding import rounded

QUERIES: dict = {}
SQL: dict = {}
M = matrix_queries.BASE


def query(name: str, sql: str | None = None, base: str = ""):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = base.rstrip() + (sql if sql.startswith(",") else " " + sql)
        return f

    return add


def _layers(spark, sf_dir):
    v = embedding_table(spark, sf_dir).select("cell", "vector")
    return {"even": v.filter("cell % 2 = 0"), "odd": v.filter("cell % 2 = 1")}


def _long(vectors):
    return rounded(mapping.long_form(vectors), 4)


_GROUPS = f", g AS (SELECT cell, CASE ident WHEN '{FIRST}' THEN 1 ELSE 2 END AS g FROM c WHERE ident IN ('{FIRST}', '{SECOND}')), n AS (SELECT count(*) FILTER (g = 1)::DOUBLE AS n1, count(*) FILTER (g = 2)::DOUBLE AS n2 FROM g)"


@query(
    "hurdle_statistic",
    _GROUPS
    + """, s AS (SELECT feature, coalesce(count(*) FILTER (g = 1), 0)::DOUBLE AS k1, coalesce(sum(value) FILTER (g = 1), 0) AS s1, coalesce(sum(value * value) FILTER (g = 1), 0) AS q1,
coalesce(count(*) FILTER (g = 2), 0)::DOUBLE AS k2, coalesce(sum(value) FILTER (g = 2), 0) AS s2, coalesce(sum(value * value) FILTER (g = 2), 0) AS q2 FROM d JOIN g USING (cell) WHERE value > 0 GROUP BY 1),
t AS (SELECT feature, k1, k2, n1, n2, k1 + k2 AS k, n1 + n2 AS n, q1 - coalesce(s1 * s1 / nullif(k1, 0), 0) + q2 - coalesce(s2 * s2 / nullif(k2, 0), 0) AS within, q1 + q2 - (s1 + s2) * (s1 + s2) / (k1 + k2) AS whole FROM s, n),
u AS (SELECT *, k > 0 AND k < n AS mixed, k1 > 0 AND k2 > 0 AND within > 1e-9 AS twofold FROM t)
SELECT feature, round(greatest(0, CASE WHEN mixed THEN 2 * ((CASE WHEN k1 > 0 AND k1 < n1 THEN k1 * ln(k1 / n1) + (n1 - k1) * ln(1 - k1 / n1) ELSE 0 END) + (CASE WHEN k2 > 0 AND k2 < n2 THEN k2 * ln(k2 / n2) + (n2 - k2) * ln(1 - k2 / n2) ELSE 0 END) - (k * ln(k / n) + (n - k) * ln(1 - k / n))) ELSE 0 END
+ CASE WHEN twofold THEN k * ln(whole / within) ELSE 0 END), 6) AS lrt, mixed::INT + twofold::INT AS df FROM u WHERE mixed OR twofold""",
    M,
)
def _(spark, sf_dir):
    m = data(spark, sf_dir)
    return rounded(differential.hurdle(m, differential.two_groups(m, "ident", FIRST, SECOND)).select("feature", "lrt", "df"))


_FACTORS = ", gm AS (SELECT feature, sum(ln(value)) / max(n) AS g FROM m, nc WHERE value > 0 GROUP BY 1), raw AS (SELECT cell, exp(quantile_cont(ln(value) - g, 0.5)) AS f FROM m JOIN gm USING (feature) WHERE value > 0 GROUP BY 1), sf AS (SELECT cell, f / (SELECT exp(avg(ln(f))) FROM raw) AS factor FROM raw)"


@query("size_factors", _FACTORS + " SELECT cell, round(factor, 6) AS factor FROM sf", M)
def _(spark, sf_dir):
    return rounded(differential.size_factors(sales_matrix(spark, sf_dir)))


@query(
    "count_wald",
    _FACTORS
    + _GROUPS
    + """, iv AS (SELECT avg(1 / factor) AS inv FROM sf JOIN g USING (cell)), s AS (SELECT feature, coalesce(sum(x) FILTER (g = 1), 0) AS s1, coalesce(sum(x * x) FILTER (g = 1), 0) AS q1, coalesce(sum(x) FILTER (g = 2), 0) AS s2, coalesce(sum(x * x) FILTER (g = 2), 0) AS q2 FROM (SELECT feature, cell, value / factor AS x FROM m JOIN sf USING (cell) WHERE value > 0) JOIN g USING (cell) GROUP BY 1),
a AS (SELECT *, greatest(1e-8, ((q1 - s1 * s1 / n1 + q2 - s2 * s2 / n2) / greatest(1, n1 + n2 - 2) - (s1 + s2) / (n1 + n2) * inv) / pow((s1 + s2) / (n1 + n2), 2)) AS alpha FROM s, n, iv WHERE s1 > 0 AND s2 > 0)
SELECT feature, round(ln((s1 / n1) / (s2 / n2)) / ln(2), 6) AS log2_fc, round(ln((s1 / n1) / (s2 / n2)) / sqrt((inv / (s1 / n1) + alpha) / n1 + (inv / (s2 / n2) + alpha) / n2), 6) AS z FROM a""",
    M,
)
def _(spark, sf_dir):
    m = sales_matrix(spark, sf_dir)
    return rounded(differential.count_wald(m, differential.two_groups(m, "ident", FIRST, SECOND)).select("feature", "log2_fc", "z"))


@query("find_markers_hurdle")
def _(spark, sf_dir):
    return rounded(differential.find_markers(data(spark, sf_dir), "ident", FIRST, SECOND, test="hurdle"))


@query("leiden_clusters")
def _(spark, sf_dir):
    v = embedding_table(spark, sf_dir)
    edges = neighbors.snn(neighbors.knn(v, v, 20), 20)
    return clustering.modularity_clusters(edges, v.select("cell"), resolution=0.8, algorithm=4)


@query("integrate_cca")
def _(spark, sf_dir):
    return _long(integration.integrate_layers(_layers(spark, sf_dir), "cca"))


@query("integrate_rpca")
def _(spark, sf_dir):
    return _long(integration.integrate_layers(_layers(spark, sf_dir), "rpca"))


@query("integrate_joint_pca")
def _(spark, sf_dir):
    return _long(integration.integrate_layers(_layers(spark, sf_dir), "joint_pca"))


@query("integrate_harmony")
def _(spark, sf_dir):
    layers = _layers(spark, sf_dir)
    return _long(integration.harmonise(integration.joint_pca(layers, 20), integration.layer_labels(layers), rounds=3, cluster_rounds=3))


@query("layer_labels", "SELECT vec_id AS cell, CASE vec_id % 2 WHEN 0 THEN 'even' ELSE 'odd' END AS layer FROM embeddings")
def _(spark, sf_dir):
    return integration.layer_labels(_layers(spark, sf_dir))


@query("reciprocal_projection")
def _(spark, sf_dir):
    layers = _layers(spark, sf_dir)
    return _long(integration.reciprocal_project(layers["even"], layers["odd"], 10)[0])


@query("project_data")
def _(spark, sf_dir):
    v = embedding_table(spark, sf_dir)
    some = v.filter("cell % 4 = 0")
    embeddings = reduction.pca(some.select("cell", "vector"), 10, recentre=True)[0]
    return rounded(integration.project_data(some, embeddings, v, some.select("cell", F.col("ident").alias("label")), 10)[1], 4)


@query("feature_sketch")
def _(spark, sf_dir):
    m = sales_matrix(spark, sf_dir)
    return rounded(integration.feature_sketch(m.values, m.n_features))


@query("smoothed_lsi")
def _(spark, sf_dir):
    v = embedding_table(spark, sf_dir)
    edges = neighbors.snn(neighbors.knn(v, v, 20), 20)
    return _long(integration.smoothed_lsi(v, edges, 10)[0])


@query("umap_layout")
def _(spark, sf_dir):
    v = embedding_table(spark, sf_dir)
    near = neighbors.knn(v, v, 16)
    return rounded(layout.umap(near, v, epochs=100), 4)


@query("umap_projection")
def _(spark, sf_dir):
    v = embedding_table(spark, sf_dir)
    reference, rest = v.filter("cell % 2 = 0"), v.filter("cell % 2 = 1")
    return rounded(layout.placed(neighbors.knn(reference, rest, 10), layout.umap(neighbors.knn(reference, reference, 16), reference, epochs=100)), 4)


@query("tsne_layout")
def _(spark, sf_dir):
    v = embedding_table(spark, sf_dir)
    return rounded(layout.tsne(v, rounds=250), 4)


@query("membership_strengths")
def _(spark, sf_dir):
    v = embedding_table(spark, sf_dir)
    return rounded(layout.memberships(neighbors.knn(v, v, 16)), 4)


@query("variable_features_by_function", "SELECT feature, s AS score, k::INT AS rank FROM (SELECT feature, s, row_number() OVER (ORDER BY s DESC, feature) AS k FROM (SELECT feature, sum(value) AS s FROM m GROUP BY 1)) WHERE k <= 100", M)
def _(spark, sf_dir):
    return variable_features.find_variable_features(sales_matrix(spark, sf_dir), lambda m: m.values.groupBy("feature").agg(F.sum("value").alias("score")), 100)


@query(
    "fold_change_of_own_mean",
    _GROUPS + " SELECT feature, round(coalesce(sum(sqrt(value)) FILTER (g = 1), 0) / max(n1) - coalesce(sum(sqrt(value)) FILTER (g = 2), 0) / max(n2), 6) AS avg_log_fc FROM f LEFT JOIN (SELECT feature, value, g FROM m JOIN g USING (cell)) USING (feature), n GROUP BY 1",
    M,
)
def _(spark, sf_dir):
    m = sales_matrix(spark, sf_dir)
    groups = differential.two_groups(m, "ident", FIRST, SECOND)
    return rounded(differential.fold_change(m, groups, each=F.sqrt, finish=lambda total, n: total / n).select("feature", "avg_log_fc"))


@query("own_pair_distance", ", e AS (SELECT vec_id AS cell, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 100 = 0) SELECT a.cell AS i, b.vec_id AS j, round(list_sum(list_transform(list_zip(a.v, b.embedding::DOUBLE[]), lambda p: abs(p[1] - p[2]))), 6) AS dist FROM e a, embeddings b".replace(", e AS", "WITH e AS", 1))
def _(spark, sf_dir):
    v = embedding_table(spark, sf_dir)
    return rounded(neighbors.pair_distances(v.filter("cell % 100 = 0"), v, lambda x, y: abs(x - y).sum()))


@query("own_neighbor_mean", "WITH v AS (SELECT vec_id AS cell, embedding::DOUBLE[] AS vec FROM embeddings), nn AS (SELECT x.cell AS query, y.cell AS neighbor, row_number() OVER (PARTITION BY x.cell ORDER BY round(list_distance(x.vec, y.vec), 9), y.cell) AS rank FROM v x, v y) SELECT query AS cell, round(max(vec[1]), 6) AS first FROM nn JOIN v ON neighbor = v.cell WHERE rank <= 6 AND query <> neighbor GROUP BY 1")
def _(spark, sf_dir):
    v = embedding_table(spark, sf_dir).select("cell", "vector")
    found = neighbors.neighbor_mean(neighbors.knn(v, v, 6), v.select("cell", F.slice("vector", 1, 1).alias("vector")), F.max)
    return rounded(found.select("cell", F.get("vector", 0).alias("first")))


@query("bridge_anchors")
def _(spark, sf_dir):
    v = embedding_table(spark, sf_dir)
    one = v.select("cell", F.slice("vector", 1, 32).alias("vector"))
    two = v.select("cell", F.slice("vector", 33, 32).alias("vector"))
    third = lambda d, k: d.filter(F.col("cell") % 3 == k)
    return rounded(mapping.bridge_anchors(third(two, 1), third(one, 2), third(one, 0), third(two, 0)))


@query("map_embeddings")
def _(spark, sf_dir):
    layers = _layers(spark, sf_dir)
    anchors = mapping.find_anchors(layers["even"], layers["odd"])
    return _long(mapping.map_embeddings(anchors, layers["even"], layers["odd"]))


@query("pca_sparse")
def _(spark, sf_dir):
    return _long(reduction.pca_sparse(sales_matrix(spark, sf_dir), 10)[0])


def _models(spark, sf_dir):
    m = sales_matrix(spark, sf_dir)
    out = {}
    for name in (FIRST, SECOND):
        part = m.select_cells(m.cells.filter(F.col("ident") == name))
        seen = part.values.groupBy("feature").agg(F.log(F.avg("value")).alias("intercept")).select("feature", "intercept", F.lit(0.3).alias("slope"), F.lit(4.0).alias("theta"))
        out[name] = (part, seen)
    return out


_MODELS = f", ds AS (SELECT cell, ident AS dataset FROM c WHERE ident IN ('{FIRST}', '{SECOND}')), dep AS (SELECT cell, dataset, log10(t) AS depth FROM tot JOIN ds USING (cell) WHERE t > 0), nd AS (SELECT dataset, count(*)::DOUBLE AS n FROM dep GROUP BY 1), na AS (SELECT dataset, count(*)::DOUBLE AS n FROM ds GROUP BY 1), par AS (SELECT dataset, feature, ln(avg(value)) AS b FROM m JOIN ds USING (cell) GROUP BY 1, 2), mid AS (SELECT min(md) AS mid FROM (SELECT quantile_cont(depth, 0.5) AS md FROM dep GROUP BY dataset)), res AS (SELECT dataset, feature, cell, greatest(-sqrt(n / 30), least(sqrt(n / 30), (coalesce(value, 0) - exp(b + 0.3 * depth)) / sqrt(exp(b + 0.3 * depth) + exp(b + 0.3 * depth) * exp(b + 0.3 * depth) / 4))) AS r, b FROM par JOIN dep USING (dataset) JOIN na USING (dataset) LEFT JOIN m USING (feature, cell))"


@query("prepared_residuals", _MODELS + " SELECT dataset, feature, cell, round(r, 6) AS value FROM res WHERE feature <= 50", M)
def _(spark, sf_dir):
    return rounded(residuals.prepared_residuals(_models(spark, sf_dir), spark.range(51).withColumnRenamed("id", "feature")))


@query("recorrected_counts", _MODELS + ", x AS (SELECT dataset, feature, cell, round(r * sqrt(exp(b + 0.3 * mid) + exp(b + 0.3 * mid) * exp(b + 0.3 * mid) / 4) + exp(b + 0.3 * mid)) AS value FROM res, mid) SELECT dataset, feature, cell, value FROM x WHERE value > 0", M)
def _(spark, sf_dir):
    return residuals.recorrected(_models(spark, sf_dir))


@query("shared_residual_features", _MODELS + ", rv AS (SELECT dataset, feature, row_number() OVER (PARTITION BY dataset ORDER BY var_samp(r) DESC, feature) AS k FROM res GROUP BY 1, 2) SELECT feature FROM (SELECT feature, count(*) AS nd, quantile_cont(k, 0.5) AS md FROM rv WHERE k <= 300 AND feature IN (SELECT feature FROM par GROUP BY 1 HAVING count(*) = 2) GROUP BY 1) ORDER BY nd DESC, md, feature LIMIT 300", M)
def _(spark, sf_dir):
    return residuals.shared_residual_features(_models(spark, sf_dir), 300).select("feature")


def _screen(spark, sf_dir) -> Matrix:
    """Identities as targets, with a shift of some features in one of them."""
    m = data(spark, sf_dir)
    m = m.select_features(m.features.filter("feature <= 60"))
    moved = m.values.join(m.cells.select("cell", "ident"), "cell").withColumn("value", F.when((F.col("ident") == FIRST) & (F.col("feature") <= 12), F.col("value") + 6).otherwise(F.col("value")))
    return m.with_values(moved.select("feature", "cell", "value"))


@query("perturbation_markers")
def _(spark, sf_dir):
    return rounded(demultiplexing.perturbation_markers(_screen(spark, sf_dir), "ident", FIRST, SECOND, cutoff=0.5))


@query("missing_signatures", "WITH v AS (SELECT vec_id AS cell, embedding::DOUBLE[] AS vec FROM embeddings) SELECT cell, d::INT AS feature, round(0.0, 6)::DOUBLE AS value FROM v, (SELECT unnest([0, 1]) AS d)")
def _(spark, sf_dir):
    v = embedding_table(spark, sf_dir).select("cell")
    values = v.withColumn("feature", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("value", F.lit(2.0))
    near = v.select(F.col("cell").alias("query"), F.lit(0).cast("long").alias("neighbor"))
    known = values.filter("feature = 0").select("cell", "feature", F.lit(0.0).alias("value"))
    return rounded(demultiplexing.missing_signatures(values, near, known, values.select("feature")))
