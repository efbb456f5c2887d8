"""Queries of the object verbs and of the tables behind displays, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparsewright.matrix import embedding_table, sales_matrix, table
from sparsewright.operators import displays, mapping, neighbors, objects, trees
from sparsewright.plans import graph_queries, matrix_queries
from sparsewright.plans.matrix_queries import data
from sparsewright.plans.rounding import rounded

QUERIES: dict = {}
SQL: dict = {}
M, V = matrix_queries.BASE, graph_queries.BASE


def query(name: str, sql: str | None = None, base: str = ""):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = base.rstrip() + (sql if sql.startswith(",") else " " + sql)
        return f

    return add


def _vectors(spark, sf_dir):
    v = embedding_table(spark, sf_dir)
    return v.select("cell", "ident", F.get("vector", 0).alias("x"), F.get("vector", 1).alias("y"))


@query("levels", "SELECT ident AS level, row_number() OVER (ORDER BY ident)::INT AS place FROM (SELECT DISTINCT ident FROM c WHERE ident IS NOT NULL)", M)
def _(spark, sf_dir):
    return objects.levels(sales_matrix(spark, sf_dir).cells, "ident")


@query("set_levels", "SELECT cell, ident, CASE ident WHEN 'EUROPE' THEN 1 WHEN 'ASIA' THEN 2 WHEN 'AFRICA' THEN 3 END::BIGINT AS place FROM c", M)
def _(spark, sf_dir):
    return objects.with_levels(sales_matrix(spark, sf_dir).cells, "ident", ["EUROPE", "ASIA", "AFRICA"]).select("cell", "ident", "place")


@query("levels_by_feature", "SELECT *, row_number() OVER (ORDER BY mean DESC, level)::INT AS place FROM (SELECT ident AS level, round(avg(coalesce(value, 0)), 6) AS mean FROM c LEFT JOIN (SELECT cell, value FROM m WHERE feature = 5) USING (cell) WHERE ident IS NOT NULL GROUP BY 1)", M)
def _(spark, sf_dir):
    return rounded(objects.levels_by_feature(sales_matrix(spark, sf_dir), "ident", 5, descending=True))


@query("regroup_identities", "SELECT ident AS cluster, batch AS label FROM (SELECT ident, batch, row_number() OVER (PARTITION BY ident ORDER BY count(*) DESC, batch) AS k FROM c WHERE batch IS NOT NULL GROUP BY 1, 2) WHERE k = 1", M)
def _(spark, sf_dir):
    return objects.regroup(sales_matrix(spark, sf_dir).cells, "ident", "batch")


@query("cells_by_value", "SELECT batch AS value, count(*) OVER (PARTITION BY batch)::BIGINT AS n, cell FROM c WHERE batch IS NOT NULL", M)
def _(spark, sf_dir):
    return objects.cells_by(sales_matrix(spark, sf_dir).cells, "batch")


@query("slim_object", "SELECT feature, cell, value FROM m JOIN f USING (feature) WHERE size <= 5", M)
def _(spark, sf_dir):
    m = sales_matrix(spark, sf_dir)
    return objects.slim(m, features=m.features.filter("size <= 5"), columns=["ident"]).values


@query("rectangle", "SELECT feature, cell, coalesce(value, 0) AS value FROM (SELECT unnest([1, 2, 3, 4, 5]) AS feature) CROSS JOIN (SELECT unnest([1, 2, 3]) AS cell) LEFT JOIN m USING (feature, cell)", M)
def _(spark, sf_dir):
    return objects.picked(sales_matrix(spark, sf_dir), [1, 2, 3, 4, 5], [1, 2, 3])


@query("usable_features", "SELECT feature FROM (SELECT feature, var_samp(value) AS v FROM dense GROUP BY 1) WHERE v > 0 AND feature <= 100", M)
def _(spark, sf_dir):
    m = sales_matrix(spark, sf_dir)
    return objects.usable_features(m, m.features.filter("feature <= 100"))


@query("sweep_stored", "SELECT feature, cell, round(value / mx, 6) AS value FROM m JOIN (SELECT feature, max(value) AS mx FROM m GROUP BY 1) USING (feature)", M)
def _(spark, sf_dir):
    m = sales_matrix(spark, sf_dir)
    return rounded(objects.swept(m.values, m.values.groupBy("feature").agg(F.max("value").alias("stat")), "feature", "/"))


@query("sweep_dense", ", q AS (SELECT * FROM dense WHERE feature <= 50) SELECT feature, cell, round(value - s, 6) AS value FROM q JOIN (SELECT cell, avg(value) AS s FROM q GROUP BY 1) USING (cell)", M)
def _(spark, sf_dir):
    m = sales_matrix(spark, sf_dir)
    m = m.select_features(m.features.filter("feature <= 50"))
    n = m.n_features
    means = m.cells.select("cell").join(m.values, "cell", "left").groupBy("cell").agg((F.coalesce(F.sum("value"), F.lit(0.0)) / n).alias("stat"))
    return rounded(objects.swept_dense(m, means, "cell", "-"))


@query("interleave", "SELECT s_suppkey AS cell, [s_name, s_nationkey::VARCHAR, 'z'] AS both FROM supplier")
def _(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("cell"), objects.interleaved(F.array("s_name", F.lit("z")), F.array(F.col("s_nationkey").cast("string"))).alias("both"))


@query("empirical_p", "SELECT vec_id AS cell, (SELECT avg(CASE WHEN n.embedding[2]::DOUBLE > e.embedding[1]::DOUBLE THEN 1.0 ELSE 0 END) FROM embeddings n)::DOUBLE AS p FROM embeddings e")
def _(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return rounded(objects.empirical_p(v.select("cell", F.col("x").alias("value")), v.select(F.col("y").alias("value"))).select("cell", "p"), 12)


@query("imputed_distance", "SELECT query, neighbor, round(greatest(dist - 0.1, 0), 6) AS d FROM nn WHERE rank = 2", V)
def _(spark, sf_dir):
    v = embedding_table(spark, sf_dir).select("cell", "vector")
    near = neighbors.knn(v, v, 2).filter("rank = 2").select("query", "neighbor")
    rows = near.join(v.withColumnsRenamed({"cell": "query", "vector": "a"}), "query").join(v.withColumnsRenamed({"cell": "neighbor", "vector": "b"}), "neighbor")
    return rounded(rows.select("query", "neighbor", objects.imputed_distance(F.col("a"), F.col("b"), F.lit(0.1)).alias("d")))


@query("nth_largest", "SELECT cell, max(CASE WHEN k = 2 THEN value END) AS value FROM (SELECT cell, value, row_number() OVER (PARTITION BY cell ORDER BY value DESC) AS k FROM m) WHERE k <= 2 GROUP BY 1", M)
def _(spark, sf_dir):
    return objects.nth_largest_by(sales_matrix(spark, sf_dir).values, "cell", "value")


@query("longer_lists", "SELECT doc_id, coalesce(len(string_split(text, ' ')), 0) > 100 AS long FROM documents")
def _(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", objects.longer_than(F.split("text", " "), 100).alias("long"))


@query("map_values", "SELECT cell, CASE ident WHEN 'ASIA' THEN 'east' WHEN 'AMERICA' THEN 'west' ELSE ident END AS ident FROM c", M)
def _(spark, sf_dir):
    return sales_matrix(spark, sf_dir).cells.select("cell", objects.mapped(F.col("ident"), {"ASIA": "east", "AMERICA": "west"}).alias("ident"))


@query("anchor_datasets", ", o AS (SELECT cell1, cell2, CASE WHEN cell1 >= 100 THEN 'b' ELSE 'a' END AS dataset1, cell1 - CASE WHEN cell1 >= 100 THEN 100 ELSE 0 END AS local1, CASE WHEN cell2 >= 100 THEN 'b' ELSE 'a' END AS dataset2, cell2 - CASE WHEN cell2 >= 100 THEN 100 ELSE 0 END AS local2 FROM mnn) SELECT * FROM o", V)
def _(spark, sf_dir):
    v = embedding_table(spark, sf_dir)
    near = mapping.four_way(v.filter("cell % 2 = 0"), v.filter("cell % 2 = 1"), 5)
    pairs = mapping.mutual_neighbors(near["ab"], near["ba"], 5).select("cell1", "cell2")
    sizes = spark.createDataFrame([("a", 100), ("b", 1 << 40)], "dataset string, size long")
    return objects.with_datasets(pairs, sizes)


@query("cell_numbers", "SELECT cell, k::INT AS number FROM (SELECT cell, row_number() OVER (ORDER BY cell) - 1 AS k, ident FROM c) WHERE ident = 'ASIA'", M)
def _(spark, sf_dir):
    cells = sales_matrix(spark, sf_dir).cells
    return objects.cell_numbers(cells, cells.filter("ident = 'ASIA'"))


@query("quantile_scaled", "SELECT cell, round((t - lo) / (hi - lo), 6) AS value FROM tot, (SELECT quantile_cont(t, 0.025) AS lo, quantile_cont(t, 0.975) AS hi FROM tot)", M)
def _(spark, sf_dir):
    totals = sales_matrix(spark, sf_dir).values.groupBy("cell").agg(F.sum("value").alias("value"))
    return rounded(objects.quantile_scaled(totals, "value"))


@query("neighbor_offsets", "SELECT query + 1000 AS query, neighbor + 2000 AS neighbor, rank::INT AS rank FROM nn WHERE rank <= 5", V)
def _(spark, sf_dir):
    v = embedding_table(spark, sf_dir)
    return objects.moved_neighbors(neighbors.knn(v, v, 5), 1000, 2000).select("query", "neighbor", "rank")


@query("bound_rows", "SELECT * FROM m WHERE feature <= 20 OR feature > 150", M)
def _(spark, sf_dir):
    values = sales_matrix(spark, sf_dir).values
    return objects.bound_rows(values.filter("feature <= 20"), values.filter("feature > 150"))


@query("replaced_cells", "SELECT feature, cell, CASE WHEN cell <= 3 THEN value * 2 ELSE value END AS value FROM m", M)
def _(spark, sf_dir):
    values = sales_matrix(spark, sf_dir).values
    return objects.replaced_cells(values, values.filter("cell <= 3").withColumn("value", F.col("value") * 2))


@query("graph_to_neighbors", "SELECT query, neighbor, rank::INT AS rank, round(dist, 6) AS dist FROM (SELECT query, neighbor, dist, row_number() OVER (PARTITION BY query ORDER BY round(dist, 6), neighbor) AS rank FROM (SELECT * FROM nn WHERE rank <= 7))", V)
def _(spark, sf_dir):
    v = embedding_table(spark, sf_dir)
    edges = neighbors.knn(v, v, 7).select(F.col("query").alias("i"), F.col("neighbor").alias("j"), F.round("dist", 6).alias("w"))
    return rounded(objects.neighbors_of_graph(edges))


@query("edge_lines", ", num AS (SELECT cell, row_number() OVER (ORDER BY cell) - 1 AS n FROM v) SELECT b.n || chr(9) || a.n || chr(9) || printf('%.15g', rank::DOUBLE) AS line FROM nn JOIN num a ON query = a.cell JOIN num b ON neighbor = b.cell WHERE rank <= 5 AND b.n < a.n", V)
def _(spark, sf_dir):
    v = embedding_table(spark, sf_dir)
    edges = neighbors.knn(v, v, 5).select(F.col("query").alias("i"), F.col("neighbor").alias("j"), F.col("rank").cast("double").alias("w"))
    return objects.edge_lines(edges, objects.cell_numbers(v, v))


@query("transfer_predictions", "SELECT cell, CASE WHEN score < 0.25 THEN 'Unassigned' ELSE label END AS label, round(score, 6) AS score FROM (SELECT cell, batch AS label, s / sum(s) OVER (PARTITION BY cell) AS score, row_number() OVER (PARTITION BY cell ORDER BY s DESC, batch) AS k FROM (SELECT feature AS cell, batch, sum(value) AS s FROM m JOIN c USING (cell) WHERE batch IS NOT NULL GROUP BY 1, 2)) WHERE k = 1", M)
def _(spark, sf_dir):
    m = sales_matrix(spark, sf_dir)
    sums = m.values.join(m.cells.filter("batch is not null"), "cell").groupBy(F.col("feature").alias("cell"), F.col("batch").alias("label")).agg(F.sum("value").alias("s"))
    total = sums.groupBy("cell").agg(F.sum("s").alias("t"))
    return rounded(objects.unassigned_below(sums.join(total, "cell").select("cell", "label", (F.col("s") / F.col("t")).alias("score")), 0.25))


@query("elbow_table", ", s AS (SELECT feature AS dim, stddev_samp(value) AS sd FROM ddense WHERE feature <= 20 GROUP BY 1), p AS (SELECT dim, sd, 100 * sd * sd / sum(sd * sd) OVER () AS percent FROM s) SELECT dim, round(sd, 6) AS sd, round(percent, 6) AS percent, round(sum(percent) OVER (ORDER BY dim), 6) AS cumulative FROM p", M)
def _(spark, sf_dir):
    m = data(spark, sf_dir)
    m = m.select_features(m.features.filter("feature <= 20"))
    from sparsewright.operators.statistics import row_moments

    return rounded(displays.elbow(row_moments(m).select(F.col("feature").alias("dim"), F.sqrt("variance").alias("sd"))))


@query("collapsed_outliers", ", e AS (SELECT cell, ident, vec[1] AS x, vec[2] AS y FROM v), md AS (SELECT ident, median(x) AS mx, median(y) AS my FROM e GROUP BY 1), z AS (SELECT ident, (mx - avg(mx) OVER ()) / stddev_samp(mx) OVER () AS zx, (my - avg(my) OVER ()) / stddev_samp(my) OVER () AS zy, stddev_samp(mx) OVER () AS sx, stddev_samp(my) OVER () AS sy FROM md), t AS (SELECT ident, CASE WHEN abs(zx) >= 1 THEN sign(zx) * (abs(zx) - 1) * sx ELSE 0 END AS dx, CASE WHEN abs(zy) >= 1 THEN sign(zy) * (abs(zy) - 1) * sy ELSE 0 END AS dy FROM z) SELECT cell, ident, round(CASE WHEN least(dx, dy) <> 0 THEN x - dx ELSE x END, 6) AS x, round(CASE WHEN least(dx, dy) <> 0 THEN y - dy ELSE y END, 6) AS y FROM e JOIN t USING (ident)", V)
def _(spark, sf_dir):
    return rounded(displays.without_outliers(_vectors(spark, sf_dir), "ident", ["x", "y"], 1.0).select("cell", "ident", "x", "y"))


@query("feature_scatter", ", p AS (SELECT cell, max(CASE WHEN feature = 1 THEN value ELSE 0 END) AS x, max(CASE WHEN feature = 2 THEN value ELSE 0 END) AS y FROM ddense WHERE feature IN (1, 2) GROUP BY 1) SELECT cell, round(x, 6) AS x, round(y, 6) AS y, round(corr(x, y) OVER (), 6) AS r FROM p", M)
def _(spark, sf_dir):
    return rounded(displays.feature_scatter(data(spark, sf_dir), 1, 2))


@query("cell_scatter", ", p AS (SELECT feature, max(CASE WHEN cell = 1 THEN value ELSE 0 END) AS x, max(CASE WHEN cell = 2 THEN value ELSE 0 END) AS y FROM ddense WHERE cell IN (1, 2) GROUP BY 1) SELECT feature, round(x, 6) AS x, round(y, 6) AS y, round(corr(x, y) OVER (), 6) AS r FROM p", M)
def _(spark, sf_dir):
    return rounded(displays.cell_scatter(data(spark, sf_dir), 1, 2))


@query("violin_table", "SELECT feature, cell, ident, round(value, 6) AS value FROM ddense JOIN c USING (cell) WHERE feature IN (3, 4) AND ident IS NOT NULL", M)
def _(spark, sf_dir):
    return rounded(displays.by_identity(data(spark, sf_dir), [3, 4], "ident"))


@query("blended_features", ", p AS (SELECT cell, max(CASE WHEN feature = 1 THEN value ELSE 0 END) AS x, max(CASE WHEN feature = 2 THEN value ELSE 0 END) AS y FROM ddense WHERE feature IN (1, 2) GROUP BY 1), q AS (SELECT cell, round_even(9 * (x - min(x) OVER ()) / (max(x) OVER () - min(x) OVER ()), 0)::INT AS a, round_even(9 * (y - min(y) OVER ()) / (max(y) OVER () - min(y) OVER ()), 0)::INT AS b FROM p) SELECT cell, a, b, (a + 10 * b)::INT AS blend FROM q", M)
def _(spark, sf_dir):
    return displays.blended(data(spark, sf_dir), 1, 2)


@query("heatmap_table", ", s AS (SELECT feature, avg(value) AS mu, stddev_samp(value) AS sd FROM ddense WHERE feature <= 10 GROUP BY 1) SELECT feature, cell, ident, round(CASE WHEN sd > 0 THEN greatest(-1, least(1, least(10, (value - mu) / sd))) ELSE 0 END, 6) AS value FROM ddense JOIN s USING (feature) JOIN c USING (cell)", M)
def _(spark, sf_dir):
    from sparsewright.operators.scaling import scale_data

    m = data(spark, sf_dir)
    scaled = scale_data(m, m.features.filter("feature <= 10"))
    return rounded(displays.heatmap(scaled, m.cells, list(range(11)), "ident", 1.0))


@query("dim_heatmap_table", ", ld AS (SELECT feature, sum(value) AS l FROM m GROUP BY 1), em AS (SELECT cell, sum(value) AS s FROM m GROUP BY 1), fh AS (SELECT feature FROM ld ORDER BY l DESC, feature LIMIT 5), fl AS (SELECT feature FROM ld WHERE feature NOT IN (SELECT feature FROM fh) ORDER BY l, feature LIMIT 5), ch AS (SELECT cell FROM em ORDER BY s DESC, cell LIMIT 10), cl AS (SELECT cell FROM em WHERE cell NOT IN (SELECT cell FROM ch) ORDER BY s, cell LIMIT 10) SELECT feature, cell, value FROM m WHERE feature IN (SELECT feature FROM fh UNION ALL SELECT feature FROM fl) AND cell IN (SELECT cell FROM ch UNION ALL SELECT cell FROM cl)", M)
def _(spark, sf_dir):
    values = sales_matrix(spark, sf_dir).values
    loadings = values.groupBy("feature").agg(F.sum("value").alias("value")).withColumn("dim", F.lit(0))
    scores = values.groupBy("cell").agg(F.sum("value").alias("value")).withColumn("dim", F.lit(0))
    return displays.dim_heatmap(loadings, scores, values, 0, 10, 20)


@query("merged_tree_node", "SELECT cell, CASE WHEN ident IN ('AFRICA', 'AMERICA') THEN 'AFRICA' ELSE ident END AS ident FROM c", M)
def _(spark, sf_dir):
    names = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
    merges = [(0, 1, 0.1), (2, 3, 0.2), (5, 6, 0.5), (7, 4, 0.9)]
    return trees.merged_node(sales_matrix(spark, sf_dir).cells, "ident", names, merges, 5).select("cell", "ident")


@query("sampled_by_class")
def _(spark, sf_dir):
    return displays.sampled_by_class(sales_matrix(spark, sf_dir).cells, "ident", 5)
