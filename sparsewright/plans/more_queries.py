"""Further operators: object verbs, projections, residuals, bridges."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparsewright.functions import scalar
from sparsewright.matrix import Matrix, embedding_table, sales_matrix, table
from sparsewright.operators import aggregate, clustering, mapping, neighbors, reduction, residuals, statistics, variable_features, verbs
from sparsewright.plans import graph_queries, matrix_queries
from sparsewright.plans.rounding import rounded
from sparsewright.sources.tables import long_form, wide_form

QUERIES: dict = {}
SQL: dict = {}
M, V = matrix_queries.BASE, graph_queries.BASE


def query(name: str, sql: str | None = None, base: str = ""):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = base.rstrip() + " " + sql
        return f

    return add


@query("create_object_filter", ", k AS (SELECT cell FROM m GROUP BY 1 HAVING count(*) >= 400), m2 AS (SELECT * FROM m WHERE cell IN (SELECT cell FROM k)) SELECT feature, cell, value FROM m2 WHERE feature IN (SELECT feature FROM m2 GROUP BY 1 HAVING count(*) >= 20)", M)
def _(spark, sf_dir):
    from sparsewright.matrix import bundle

    m = sales_matrix(spark, sf_dir)
    return bundle(m.values, m.cells, m.features, min_cells=20, min_features=400).values


@query("subset_object", "SELECT feature, cell, value FROM m JOIN c USING (cell) JOIN f USING (feature) WHERE ident = 'ASIA' AND size <= 10", M)
def _(spark, sf_dir):
    m = sales_matrix(spark, sf_dir)
    return m.select_cells(m.cells.filter("ident = 'ASIA'")).select_features(m.features.filter("size <= 10")).values


@query("split_object", "SELECT ident, count(*)::BIGINT AS n_cells, sum(k)::BIGINT AS n_entries FROM c JOIN (SELECT cell, count(*) AS k FROM m GROUP BY 1) USING (cell) WHERE ident IS NOT NULL GROUP BY 1", M)
def _(spark, sf_dir):
    m = sales_matrix(spark, sf_dir)
    parts = m.values.groupBy("cell").agg(F.count(F.lit(1)).alias("k")).join(m.cells.filter("ident is not null"), "cell")
    return parts.groupBy("ident").agg(F.count(F.lit(1)).alias("n_cells"), F.sum("k").alias("n_entries"))


@query("fetch_data", "SELECT cell, ident, max(CASE WHEN feature = 1 THEN value ELSE 0 END) AS v1, max(CASE WHEN feature = 2 THEN value ELSE 0 END) AS v2 FROM c LEFT JOIN m USING (cell) GROUP BY 1, 2", M)
def _(spark, sf_dir):
    m = sales_matrix(spark, sf_dir)
    pick = wide_form(m.values.filter("feature in (1, 2)"), [1, 2]).withColumnsRenamed({"1": "v1", "2": "v2"})
    return m.cells.select("cell", "ident").join(pick, "cell", "left").fillna(0.0, ["v1", "v2"])


@query("wide_and_long", "SELECT event_type AS feature, user_id AS cell, count(*)::DOUBLE AS value FROM events GROUP BY 1, 2")
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("feature"), F.col("user_id").alias("cell")).agg(F.count(F.lit(1)).alias("value"))
    types = [r[0] for r in rows.select("feature").distinct().orderBy("feature").collect()]
    return long_form(wide_form(rows, types), "cell")


@query("filter_radius", ", q AS (SELECT quantile_cont(vec[1], 0.01) AS a, quantile_cont(vec[1], 0.99) AS b, quantile_cont(vec[2], 0.01) AS c, quantile_cont(vec[2], 0.99) AS d FROM v), mid AS (SELECT (SELECT avg(vec[1]) FROM v, q WHERE vec[1] > a AND vec[1] < b) AS x, (SELECT avg(vec[2]) FROM v, q WHERE vec[2] > c AND vec[2] < d) AS y) SELECT cell FROM v, mid WHERE sqrt(pow(vec[1] - x, 2) + pow(vec[2] - y, 2)) <= 0.1", V)
def _(spark, sf_dir):
    v = embedding_table(spark, sf_dir)
    coords = v.select("cell", F.get("vector", 0).alias("x"), F.get("vector", 1).alias("y"))
    return verbs.filter_radius(coords, 0.1).select("cell")


@query("rename_fields", "SELECT cell, 'cell_' || cell || '_x' AS full_name, 'cell_x' AS picked, 'cell_' || cell AS short FROM c", M)
def _(spark, sf_dir):
    full = F.concat(F.lit("cell_"), F.col("cell").cast("string"), F.lit("_x"))
    rows = sales_matrix(spark, sf_dir).cells.select("cell", full.alias("full_name"))
    return rows.select("cell", "full_name", scalar.extract_field(F.col("full_name"), [1, 3]).alias("picked"), scalar.remove_last_field(F.col("full_name")).alias("short"))


@query("clamp_and_rectify", "SELECT cell, least(5000, greatest(0, covariate)) AS clamped, greatest(covariate, 0) AS rectified FROM c", M)
def _(spark, sf_dir):
    c = sales_matrix(spark, sf_dir).cells
    return c.select("cell", scalar.min_max(F.col("covariate"), 0.0, 5000.0).alias("clamped"), scalar.relu(F.col("covariate")).alias("rectified"))


@query("add_metadata", "SELECT cell, ident, coalesce(t, 0)::DOUBLE AS n_count FROM c LEFT JOIN tot USING (cell)", M)
def _(spark, sf_dir):
    m = sales_matrix(spark, sf_dir)
    return m.cells.select("cell", "ident").join(statistics.qc(m).select("cell", "n_count"), "cell", "left")


@query("predict_assay", ", p AS (SELECT query, neighbor FROM nn WHERE rank <= 20 AND query <> neighbor) SELECT query AS cell, f::INT AS feature, round(avg(vec[f + 1]), 6) + 0 AS value FROM p JOIN v ON v.cell = neighbor, range(64) t(f) GROUP BY 1, 2", V)
def _(spark, sf_dir):
    v = embedding_table(spark, sf_dir)
    values = v.select("cell", F.posexplode("vector").alias("feature", "value"))
    return rounded(neighbors.predict_values(neighbors.knn(v, k=20), values))


@query("transfer_values", "SELECT weights.cell, f::INT AS feature, round(sum(weight * vec[f + 1]), 6) + 0 AS value FROM weights JOIN v ON v.cell = cell1, range(64) t(f) GROUP BY 1, 2", V)
def _(spark, sf_dir):
    v = embedding_table(spark, sf_dir)
    anchors = mapping.find_anchors(v.filter("cell % 2 = 0"), v.filter("cell % 2 = 1"), 5, 30)
    values = v.select("cell", F.posexplode("vector").alias("feature", "value"))
    return rounded(mapping.transfer_values(mapping.anchor_weights(anchors, v.filter("cell % 2 = 1")), values))


@query("neighbor_vote", ", t AS (SELECT query, ident, count(*)::DOUBLE / 20 AS share FROM nn JOIN v ON v.cell = neighbor WHERE rank <= 20 GROUP BY 1, 2) SELECT query AS cell, ident::VARCHAR AS predicted, round(share, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY share DESC, ident) AS k FROM t) WHERE k = 1", V)
def _(spark, sf_dir):
    v = embedding_table(spark, sf_dir)
    votes = neighbors.knn(v, k=20).select(F.col("query").alias("cell"), F.col("neighbor").alias("cell1"), F.lit(0.05).alias("weight"))
    return rounded(mapping.transfer_labels(votes, v.select("cell", F.col("ident").alias("label"))))


@query("subset_anchors", "SELECT cell1, cell2, round(score, 6) AS score FROM anchors WHERE score > 0.5", V)
def _(spark, sf_dir):
    v = embedding_table(spark, sf_dir)
    return rounded(mapping.subset_anchors(mapping.find_anchors(v.filter("cell % 2 = 0"), v.filter("cell % 2 = 1"), 5, 30), 0.5))


@query("project_cell_embeddings", """, st AS (SELECT f, avg(vec[f + 1]) AS mu, stddev_samp(vec[f + 1]) AS sd FROM v, range(64) t(f) WHERE cell % 2 = 0 GROUP BY 1)
SELECT cell, j::INT AS dim, round(sum(least(10, (vec[f + 1] - mu) / sd) * ((f * (j + 2)) % 7 - 3)), 6) + 0 AS value FROM v, st, range(4) t(j) WHERE cell % 2 = 1 GROUP BY 1, 2""", V)
def _(spark, sf_dir):
    import numpy as np

    v = embedding_table(spark, sf_dir)
    stats = v.filter("cell % 2 = 0").select(F.posexplode("vector").alias("f", "x")).groupBy("f").agg(F.avg("x").alias("mu"), F.stddev_samp("x").alias("sd")).orderBy("f").collect()
    i, j = np.arange(64)[:, None], np.arange(4)[None]
    out = reduction.project(v.filter("cell % 2 = 1"), ((i * (j + 2)) % 7 - 3).astype(float), np.array([r.mu for r in stats]), np.array([r.sd for r in stats]), 10.0)
    return rounded(out.select("cell", F.posexplode("vector").alias("dim", "value")))


@query("create_category_matrix", "SELECT cell, ident AS grp, 1.0::DOUBLE / count(*) OVER (PARTITION BY ident) AS weight FROM c WHERE ident IS NOT NULL", M)
def _(spark, sf_dir):
    from pyspark.sql import Window

    cells = aggregate.grouped_cells(sales_matrix(spark, sf_dir), ["ident"])
    return cells.select("cell", "grp", (F.lit(1.0) / F.count(F.lit(1)).over(Window.partitionBy("grp"))).alias("weight"))


@query("user_event_normalized", "SELECT feature, cell, round(ln(1 + value / t * 1e4), 6) AS value FROM (SELECT event_type AS feature, user_id AS cell, count(*)::DOUBLE AS value, sum(count(*)) OVER (PARTITION BY user_id) AS t FROM events GROUP BY 1, 2)")
def _(spark, sf_dir):
    from sparsewright.matrix import bundle
    from sparsewright.operators.normalize import log_normalize

    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("feature"), F.col("user_id").alias("cell"), F.lit(1.0).alias("value"))
    return rounded(log_normalize(bundle(rows)).values)


@query("document_label_markers", """WITH t AS (SELECT DISTINCT d.doc_id, quality, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM documents d JOIN labels USING (doc_id)), n AS (SELECT sum(quality)::DOUBLE AS n1, (count(*) - sum(quality))::DOUBLE AS n0 FROM labels)
SELECT term, round(sum(quality) / max(n1), 3) AS pct_1, round(sum(1 - quality) / max(n0), 3) AS pct_2 FROM t, n GROUP BY 1""")
def _(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    n = labels.agg(F.sum("quality").cast("double").alias("n1"), F.sum(1 - F.col("quality")).cast("double").alias("n0"))
    words = table(spark, sf_dir, "documents").join(labels, "doc_id").select("doc_id", "quality", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), 1))).alias("term"))
    rows = words.groupBy("term").agg(F.sum("quality").alias("a"), F.sum(1 - F.col("quality")).alias("b")).join(F.broadcast(n), how="cross")  # one row
    return rows.select("term", F.round(F.col("a") / F.col("n1"), 3).alias("pct_1"), F.round(F.col("b") / F.col("n0"), 3).alias("pct_2"))


@query("regularized_residuals")
def _(spark, sf_dir):
    m = sales_matrix(spark, sf_dir)
    return residuals.pearson(m, residuals.model(m), digits=4)


@query("residual_variance_features")
def _(spark, sf_dir):
    m = sales_matrix(spark, sf_dir)
    return rounded(residuals.variable_features(m, residuals.model(m), 50), 4)


@query("corrected_counts")
def _(spark, sf_dir):
    m = sales_matrix(spark, sf_dir)
    return residuals.corrected_counts(m, residuals.model(m))


@query("pearson_residuals_given_parameters", ", p AS (SELECT feature, ln(sum(value) / (SELECT sum(t) FROM tot)) AS b FROM m GROUP BY 1) SELECT feature, cell, round(greatest(-sqrt(n / 30), least(sqrt(n / 30), (value - exp(b) * t) / sqrt(exp(b) * t + pow(exp(b) * t, 2) / 10))), 6) + 0 AS value FROM dense JOIN p USING (feature) JOIN tot USING (cell), nc", M)
def _(spark, sf_dir):
    import math

    m = sales_matrix(spark, sf_dir)
    total = m.values.agg(F.sum("value").alias("t"))
    given = m.values.groupBy("feature").agg(F.sum("value").alias("s")).join(F.broadcast(total), how="cross")  # one row
    params = given.select("feature", F.log(F.col("s") / F.col("t")).alias("intercept"), F.lit(math.log(10)).alias("slope"), F.lit(10.0).alias("theta"))
    return residuals.pearson(m, params, digits=6)


@query("niche_clusters")
def _(spark, sf_dir):
    """Neighbour label counts as vectors, clustered on their own graph."""
    v = embedding_table(spark, sf_dir)
    plane = v.select("cell", F.slice("vector", 1, 2).alias("vector"))
    counts = neighbors.niche_counts(neighbors.knn(plane, k=20), v.select("cell", F.col("ident").alias("label")))
    niche, _ids = reduction.vectors_of(counts.withColumn("n", F.col("n").cast("double")).withColumnRenamed("n", "value"), "cell", "label")
    return clustering.modularity_clusters(neighbors.snn(neighbors.knn(niche, k=20), 20), niche, resolution=0.5, starts=2)


@query("bridge_embedding")
def _(spark, sf_dir):
    """One modality's cells carried to the other's space through the cells measured in both."""
    from sparsewright.operators.sketching import unsketch

    v = embedding_table(spark, sf_dir)
    one = v.select("cell", F.slice("vector", 1, 32).alias("vector"))
    two = v.filter("cell % 3 = 0").select("cell", F.slice("vector", 33, 32).alias("vector"))
    both = one.filter("cell % 3 = 0")
    return rounded(unsketch(two, both, one).select("cell", F.posexplode("vector").alias("dim", "value")), 4)


@query("hvf_union_by_layer", ", d2 AS (SELECT ident, feature, sum(value) AS s FROM m JOIN c USING (cell) WHERE ident IS NOT NULL GROUP BY 1, 2) SELECT ident AS layer, feature, k::INT AS rank FROM (SELECT ident, feature, row_number() OVER (PARTITION BY ident ORDER BY s DESC, feature) AS k FROM d2) WHERE k <= 20", M)
def _(spark, sf_dir):
    from pyspark.sql import Window

    m = sales_matrix(spark, sf_dir)
    sums = m.values.join(m.cells.filter("ident is not null").select("cell", F.col("ident").alias("layer")), "cell").groupBy("layer", "feature").agg(F.sum("value").alias("s"))
    return sums.withColumn("rank", F.row_number().over(Window.partitionBy("layer").orderBy(F.desc("s"), "feature"))).filter("rank <= 20").select("layer", "feature", "rank")


@query("mean_bins")
def _(spark, sf_dir):
    return rounded(aggregate.mean_bins(sales_matrix(spark, sf_dir)))


@query("vst_expected_sd")
def _(spark, sf_dir):
    return rounded(variable_features.expected_sd(sales_matrix(spark, sf_dir)), 4)


@query("count_anchors", "SELECT 'even' AS dataset1, 'odd' AS dataset2, round(count(*) / (SELECT least(count(*) FILTER (WHERE cell % 2 = 0), count(*) FILTER (WHERE cell % 2 = 1)) FROM v)::DOUBLE, 6) AS similarity FROM mnn", V)
def _(spark, sf_dir):
    v = embedding_table(spark, sf_dir)
    near = mapping.four_way(v.filter("cell % 2 = 0"), v.filter("cell % 2 = 1"), 5)
    side = F.when(F.col("cell") % 2 == 0, "even").otherwise("odd")
    sizes = v.groupBy(side.alias("dataset")).agg(F.count(F.lit(1)).alias("n"))
    found = mapping.mutual_neighbors(near["ab"], near["ba"], 5).withColumns({"dataset1": F.lit("even"), "dataset2": F.lit("odd")})
    return rounded(mapping.count_anchors(found, sizes))


@query("map_query")
def _(spark, sf_dir):
    v = embedding_table(spark, sf_dir)
    labels = v.select("cell", F.col("ident").alias("label"))
    return rounded(mapping.map_query(v.filter("cell % 2 = 0"), v.filter("cell % 2 = 1"), labels)[0])


@query("top_dim_features", """, l AS (SELECT cell AS feature, d AS dim, vec[d + 1] AS value FROM v, range(4) t(d)),
r AS (SELECT feature, min(r) AS r FROM (SELECT feature, row_number() OVER (PARTITION BY dim ORDER BY abs(value) DESC, feature) AS r FROM l) GROUP BY 1),
s AS (SELECT r, sum(count(*)) OVER (ORDER BY r) AS total FROM r GROUP BY 1)
SELECT feature FROM r WHERE r <= (SELECT max(r) FROM s WHERE total < 100)""", V)
def _(spark, sf_dir):
    rows = embedding_table(spark, sf_dir).select(F.col("cell").alias("feature"), F.posexplode("vector").alias("dim", "value"))
    return reduction.top_dim_features(rows, 4, 100)


@query("significant_features")
def _(spark, sf_dir):
    v = embedding_table(spark, sf_dir).select("cell", "vector")
    return rounded(reduction.significant_features(spark.createDataFrame(reduction.jackstraw(v, 20, 100)), [0, 1]))


@query("independent_components")
def _(spark, sf_dir):
    v = embedding_table(spark, sf_dir).select("cell", "vector")
    return rounded(reduction.ica(v, 5)[0].select("cell", F.posexplode("vector").alias("dim", "value")), 3)


@query("find_markers_t")
def _(spark, sf_dir):
    from sparsewright.operators import differential

    return rounded(differential.find_markers(matrix_queries.data(spark, sf_dir), "ident", matrix_queries.FIRST, matrix_queries.SECOND, test="t"))


@query("negbinom_test")
def _(spark, sf_dir):
    from sparsewright.operators import differential

    m = sales_matrix(spark, sf_dir)
    return rounded(differential.glm_test(m, differential.two_groups(m, "ident", matrix_queries.FIRST, matrix_queries.SECOND), "negbinom"), 4)


@query("bimod_test_markers")
def _(spark, sf_dir):
    from sparsewright.operators import differential

    return rounded(differential.find_markers(matrix_queries.data(spark, sf_dir), "ident", matrix_queries.FIRST, matrix_queries.SECOND, test="bimod"))
