"""Queries on the embeddings, tags and events tables, with the same in SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparsewright.functions.scalar import l2_normalize
from sparsewright.matrix import Matrix, bundle, embedding_table, sales_matrix, table
from sparsewright.operators import aggregate, clustering, demultiplexing, mapping, neighbors, reduction, scaling, sketching, spatial, variable_features
from sparsewright.operators.normalize import log_normalize
from sparsewright.plans.rounding import rounded
from sparsewright.streaming.counts import windowed_counts

QUERIES: dict = {}
SQL: dict = {}
K = 20

#: v: vectors; dist: all distances; nn: neighbour lists; a, b: even and odd cells.
BASE = """
WITH v AS (SELECT vec_id AS cell, embedding::DOUBLE[] AS vec, label AS ident FROM embeddings),
pairs AS (SELECT x.cell AS query, y.cell AS neighbor, list_distance(x.vec, y.vec) AS dist FROM v x, v y),
nn AS (SELECT query, neighbor, dist, row_number() OVER (PARTITION BY query ORDER BY round(dist, 9), neighbor) AS rank FROM pairs),
side AS (SELECT query, neighbor, dist, row_number() OVER (PARTITION BY query, query % 2, neighbor % 2 ORDER BY round(dist, 9), neighbor) AS rank FROM pairs),
aa AS (SELECT * FROM side WHERE query % 2 = 0 AND neighbor % 2 = 0), ab AS (SELECT * FROM side WHERE query % 2 = 0 AND neighbor % 2 = 1),
ba AS (SELECT * FROM side WHERE query % 2 = 1 AND neighbor % 2 = 0), bb AS (SELECT * FROM side WHERE query % 2 = 1 AND neighbor % 2 = 1),
mnn AS (SELECT ab.query AS cell1, ab.neighbor AS cell2 FROM ab JOIN ba ON ab.query = ba.neighbor AND ab.neighbor = ba.query WHERE ab.rank <= 5 AND ba.rank <= 5),
nb AS (SELECT query, 0 AS f, neighbor FROM aa WHERE rank <= 30 UNION ALL SELECT query, 1, neighbor FROM ab WHERE rank <= 30 UNION ALL SELECT query, 0, neighbor FROM ba WHERE rank <= 30 UNION ALL SELECT query, 1, neighbor FROM bb WHERE rank <= 30),
sh AS (SELECT cell1, cell2, (SELECT count(*) FROM nb x JOIN nb y ON x.f = y.f AND x.neighbor = y.neighbor WHERE x.query = cell1 AND y.query = cell2)::DOUBLE AS s FROM mnn),
qs AS (SELECT quantile_cont(s, 0.01) AS lo, quantile_cont(s, 0.9) AS hi FROM sh),
anchors AS (SELECT cell1, cell2, CASE WHEN hi > lo THEN greatest(0, least(1, (s - lo) / (hi - lo))) ELSE 1 END AS score FROM sh, qs),
near AS (SELECT query, neighbor, dist, row_number() OVER (PARTITION BY query ORDER BY round(dist, 9), neighbor) AS rank FROM bb WHERE neighbor IN (SELECT cell2 FROM anchors)),
nw AS (SELECT *, max(dist) OVER (PARTITION BY query) AS dk FROM near WHERE rank <= 50),
pw AS (SELECT query, cell1, neighbor, dist, dk, score, row_number() OVER (PARTITION BY query ORDER BY rank, cell1) AS place FROM nw JOIN anchors ON neighbor = cell2),
ww AS (SELECT *, 1 - exp(-(CASE WHEN dk > 0 THEN 1 - dist / dk ELSE 1 END) * score / 4) AS w FROM pw WHERE place <= 50),
weights AS (SELECT * FROM (SELECT query AS cell, cell1, neighbor AS cell2, w / nullif(sum(w) OVER (PARTITION BY query), 0) AS weight FROM ww) WHERE weight IS NOT NULL)
"""


def query(name: str, sql: str | None = None, base: str = BASE):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = base.rstrip() + " " + sql
        return f

    return add


def _even(v: DataFrame) -> DataFrame:
    return v.filter("cell % 2 = 0")


def _odd(v: DataFrame) -> DataFrame:
    return v.filter("cell % 2 = 1")


@query("knn_exact", f"SELECT query, neighbor, rank::INT AS rank, round(dist, 6) AS dist FROM nn WHERE rank <= {K}")
def _(spark, sf_dir):
    return rounded(neighbors.knn(embedding_table(spark, sf_dir), k=K))


@query("knn_cosine", f"SELECT query, neighbor, rank::INT AS rank, round(dist, 6) AS dist FROM (SELECT query, neighbor, dist, row_number() OVER (PARTITION BY query ORDER BY round(dist, 9), neighbor) AS rank FROM (SELECT x.cell AS query, y.cell AS neighbor, list_distance(x.u, y.u) AS dist FROM (SELECT cell, list_transform(vec, lambda e: e / sqrt(list_dot_product(vec, vec))) AS u FROM v) x, (SELECT cell, list_transform(vec, lambda e: e / sqrt(list_dot_product(vec, vec))) AS u FROM v) y)) WHERE rank <= {K}")
def _(spark, sf_dir):
    return rounded(neighbors.knn(embedding_table(spark, sf_dir), k=K, metric="cosine"))


@query("knn_buckets")
def _(spark, sf_dir):
    v = embedding_table(spark, sf_dir)
    return rounded(neighbors.knn_buckets(v, v, K))


@query("nn_graph", f"SELECT query AS i, neighbor AS j, 1.0::DOUBLE AS w FROM nn WHERE rank <= {K}")
def _(spark, sf_dir):
    return neighbors.nn_graph(neighbors.knn(embedding_table(spark, sf_dir), k=K))


_SNN = f", e AS (SELECT x.query AS i, y.query AS j, count(*) / ({2.0 * K} - count(*))::DOUBLE AS w FROM nn x JOIN nn y ON x.neighbor = y.neighbor WHERE x.rank <= {K} AND y.rank <= {K} GROUP BY 1, 2)"


@query("snn_jaccard", _SNN + " SELECT i, j, round(w, 6) AS w FROM e WHERE w >= 1.0 / 15")
def _(spark, sf_dir):
    return rounded(neighbors.snn(neighbors.knn(embedding_table(spark, sf_dir), k=K), K))


@query("snn_width", _SNN + f", d AS (SELECT i, w, dist, row_number() OVER (PARTITION BY i ORDER BY w, dist DESC, j) AS r FROM e JOIN pairs ON i = query AND j = neighbor WHERE i <> j AND w >= 1.0 / 15) SELECT i AS cell, round(avg(dist), 6) AS width FROM d WHERE r <= {K} GROUP BY 1")
def _(spark, sf_dir):
    v = embedding_table(spark, sf_dir)
    return rounded(neighbors.snn_width(neighbors.snn(neighbors.knn(v, k=K), K), v, K))


@query("l2_normalize", "SELECT cell, d::INT AS d, round(vec[d + 1] / sqrt(list_dot_product(vec, vec)), 6) + 0 AS x FROM v, range(64) t(d)")
def _(spark, sf_dir):
    return rounded(embedding_table(spark, sf_dir).select("cell", F.posexplode(l2_normalize(F.col("vector"))).alias("d", "x")))


@query("neighbor_mean", f"SELECT query AS cell, d::INT AS d, round(avg(vec[d + 1]), 6) + 0 AS x FROM nn JOIN v ON neighbor = cell, range(64) t(d) WHERE rank <= {K} AND query <> neighbor GROUP BY 1, 2")
def _(spark, sf_dir):
    v = embedding_table(spark, sf_dir)
    return rounded(neighbors.neighbor_mean(neighbors.knn(v, k=K), v.select("cell", "vector")).select("cell", F.posexplode("vector").alias("d", "x")))


@query("niche_counts", f"SELECT query AS cell, ident AS label, count(*)::BIGINT AS n FROM nn JOIN v ON neighbor = cell WHERE rank <= {K} GROUP BY 1, 2")
def _(spark, sf_dir):
    v = embedding_table(spark, sf_dir)
    return neighbors.niche_counts(neighbors.knn(v, k=K), v.select("cell", F.col("ident").alias("label")))


@query("mutual_nn", "SELECT cell1, cell2, 1.0::DOUBLE AS score FROM mnn")
def _(spark, sf_dir):
    v = embedding_table(spark, sf_dir)
    near = mapping.four_way(_even(v), _odd(v), 5)
    return mapping.mutual_neighbors(near["ab"], near["ba"], 5)


def _anchors(v: DataFrame) -> DataFrame:
    return mapping.find_anchors(_even(v), _odd(v), 5, 30)


@query("anchor_scores", "SELECT cell1, cell2, round(score, 6) AS score FROM anchors")
def _(spark, sf_dir):
    return rounded(_anchors(embedding_table(spark, sf_dir)))


@query("filter_anchors", "SELECT m.cell1, m.cell2, 1.0::DOUBLE AS score FROM mnn m JOIN ab ON ab.query = cell1 AND ab.neighbor = cell2 WHERE ab.rank <= 2")
def _(spark, sf_dir):
    v = embedding_table(spark, sf_dir)
    near = mapping.four_way(_even(v), _odd(v), 5)
    return mapping.filter_anchors(mapping.mutual_neighbors(near["ab"], near["ba"], 5), near["ab"], 2)


@query("anchor_annotation", "SELECT cell1, cell2, x.ident AS ident1, y.ident AS ident2, x.ident = y.ident AS ident_match FROM mnn JOIN v x ON x.cell = cell1 JOIN v y ON y.cell = cell2")
def _(spark, sf_dir):
    v = embedding_table(spark, sf_dir)
    near = mapping.four_way(_even(v), _odd(v), 5)
    found = mapping.mutual_neighbors(near["ab"], near["ba"], 5).select("cell1", "cell2")
    return mapping.annotate_anchors(found, v, "ident").select("cell1", "cell2", "ident1", "ident2", "ident_match")


@query("anchor_weights", "SELECT cell, cell1, cell2, round(weight, 6) AS weight FROM weights")
def _(spark, sf_dir):
    v = embedding_table(spark, sf_dir)
    return rounded(mapping.anchor_weights(_anchors(v), _odd(v)))


@query("transfer_labels", ", r AS (SELECT w.cell, ident, sum(weight) AS s FROM weights w JOIN v ON v.cell = cell1 GROUP BY 1, 2) SELECT cell, ident::VARCHAR AS predicted, round(s, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY round(s, 9) DESC, ident) AS k FROM r) WHERE k = 1")
def _(spark, sf_dir):
    v = embedding_table(spark, sf_dir)
    w = mapping.anchor_weights(_anchors(v), _odd(v))
    return rounded(mapping.transfer_labels(w, v.select("cell", F.col("ident").alias("label"))))


@query("integration_correction", ", sft AS (SELECT w.cell, d, sum(weight * (y.vec[d + 1] - x.vec[d + 1])) AS s FROM weights w JOIN v x ON x.cell = cell1 JOIN v y ON y.cell = cell2, range(64) t(d) GROUP BY 1, 2) SELECT v.cell, t.d::INT AS dim, round(vec[t.d + 1] - coalesce(s, 0), 6) + 0 AS value FROM v CROSS JOIN range(64) t(d) LEFT JOIN sft ON sft.cell = v.cell AND sft.d = t.d WHERE v.cell % 2 = 1")
def _(spark, sf_dir):
    v = embedding_table(spark, sf_dir)
    w = mapping.anchor_weights(_anchors(v), _odd(v))
    return rounded(mapping.correct(w, mapping.long_form(_even(v)), mapping.long_form(_odd(v))))


@query("integrate_three")
def _(spark, sf_dir):
    v = embedding_table(spark, sf_dir)
    return rounded(mapping.integrate({str(i): v.filter(F.col("cell") % 3 == i) for i in range(3)}), 4)


@query("mapping_score")
def _(spark, sf_dir):
    v = embedding_table(spark, sf_dir)
    return rounded(mapping.mapping_score(_anchors(v), _even(v), _odd(v)))


@query("mixing_metric", ", g AS (SELECT query, neighbor % 2 AS g, rank, row_number() OVER (PARTITION BY query, neighbor % 2 ORDER BY rank) AS k FROM nn WHERE rank <= 60) SELECT q.query AS cell, quantile_cont(coalesce(rank, 60)::DOUBLE, 0.5) AS metric FROM (SELECT DISTINCT query, h FROM nn, (VALUES (0), (1)) t(h)) q LEFT JOIN g ON g.query = q.query AND g.g = q.h AND g.k = 5 GROUP BY 1")
def _(spark, sf_dir):
    v = embedding_table(spark, sf_dir)
    return rounded(mapping.mixing_metric(neighbors.knn(v, k=60), v.select("cell", (F.col("cell") % 2).alias("grp")), 5, 60))


@query("local_structure", ", n2 AS (SELECT x.cell AS query, y.cell AS neighbor, row_number() OVER (PARTITION BY x.cell ORDER BY round(list_distance(x.vec[1:32], y.vec[1:32]), 9), y.cell) AS rank FROM v x, v y) SELECT nn.query AS cell, count(n2.query) / 10.0::DOUBLE AS share FROM nn LEFT JOIN n2 ON nn.query = n2.query AND nn.neighbor = n2.neighbor AND n2.rank <= 10 WHERE nn.rank <= 10 GROUP BY 1")
def _(spark, sf_dir):
    v = embedding_table(spark, sf_dir)
    half = v.select("cell", F.slice("vector", 1, 32).alias("vector"))
    return rounded(mapping.local_structure(neighbors.knn(v, k=10), neighbors.knn(half, k=10), 10))


@query("perturb_signature", ", ct AS (SELECT query, neighbor FROM side WHERE query % 2 = 1 AND neighbor % 2 = 0 AND rank <= 5) SELECT query AS cell, d::INT AS feature, round(ln(1 + avg(exp(abs(n.vec[d + 1])) - 1)) - max(abs(o.vec[d + 1])), 6) + 0 AS value FROM ct JOIN v n ON n.cell = neighbor JOIN v o ON o.cell = query, range(64) t(d) GROUP BY 1, 2")
def _(spark, sf_dir):
    v = embedding_table(spark, sf_dir)
    values = v.select("cell", F.posexplode("vector").alias("feature", "x")).select("cell", "feature", F.abs("x").alias("value"))
    return rounded(demultiplexing.perturbation_signature(values, neighbors.knn(_even(v), _odd(v), 5)))


@query("mixscape")
def _(spark, sf_dir):
    v = embedding_table(spark, sf_dir)
    name = F.when(F.col("ident") == 0, "NT").otherwise(F.concat(F.lit("g"), F.col("ident").cast("string")))
    return rounded(demultiplexing.mixscape(v.select("cell", name.alias("target"), F.get("vector", 0).alias("score")), "NT"))


@query("weighted_multimodal_neighbors")
def _(spark, sf_dir):
    v = embedding_table(spark, sf_dir)
    parts = {"first": v.select("cell", F.slice("vector", 1, 32).alias("vector")), "second": v.select("cell", F.slice("vector", 33, 32).alias("vector"))}
    return rounded(neighbors.multimodal_neighbors(parts, 10, 40)[1], 4)


def _clusters(v: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    edges = neighbors.snn(neighbors.knn(v, k=K), K)
    return edges, clustering.modularity_clusters(edges, v, starts=4, **options)


@query("louvain_clusters")
def _(spark, sf_dir):
    return _clusters(embedding_table(spark, sf_dir))[1]


@query("smart_moving_clusters")
def _(spark, sf_dir):
    return _clusters(embedding_table(spark, sf_dir), algorithm=3)[1]


@query("group_singletons")
def _(spark, sf_dir):
    return clustering.group_singletons(*_clusters(embedding_table(spark, sf_dir), resolution=3.0))


@query("sub_clusters")
def _(spark, sf_dir):
    edges, found = _clusters(embedding_table(spark, sf_dir))
    return clustering.sub_clusters(edges, found, 0, starts=2)


@query("label_propagation")
def _(spark, sf_dir):
    v = embedding_table(spark, sf_dir)
    return clustering.propagate_labels(neighbors.snn(neighbors.knn(v, k=K), K), 2)


@query("cluster_tree")
def _(spark, sf_dir):
    v = embedding_table(spark, sf_dir)
    long = v.select("ident", F.posexplode("vector").alias("d", "x")).groupBy("ident", "d").agg(F.avg("x").alias("x"))
    means = long.groupBy(F.col("ident").alias("cluster")).agg(F.array_sort(F.collect_list(F.struct("d", "x"))).alias("p")).select("cluster", F.col("p.x").alias("vector"))
    _, merges = clustering.cluster_tree(means)
    return spark.createDataFrame([(i, int(a), int(b), round(h, 6)) for i, (a, b, h) in enumerate(merges)], "step int, a int, b int, height double")


def _scaled(spark, sf_dir, n: int = 60) -> tuple[Matrix, DataFrame]:
    m = log_normalize(sales_matrix(spark, sf_dir))
    top = variable_features.top_dispersion(m, n).select("feature")
    return m, scaling.scale_data(m, top)


@query("pca")
def _(spark, sf_dir):
    v, _ids = reduction.vectors_of(_scaled(spark, sf_dir)[1])
    return rounded(reduction.pca(v, 10)[0].select("cell", F.posexplode("vector").alias("dim", "value")), 4)


@query("project_loadings")
def _(spark, sf_dir):
    _, scaled = _scaled(spark, sf_dir)
    v, _ids = reduction.vectors_of(scaled)
    return rounded(reduction.feature_loadings(scaled, reduction.pca(v, 5)[0]), 4)


@query("project_embedding", "SELECT cell, j::INT AS dim, round(list_sum(list_transform(range(64), lambda i: vec[i + 1] * ((i * (j + 2)) % 7 - 3))), 6) + 0 AS value FROM v, range(8) t(j)")
def _(spark, sf_dir):
    i, j = np.arange(64)[:, None], np.arange(8)[None]
    loadings = ((i * (j + 2)) % 7 - 3).astype(float)
    return rounded(reduction.project(embedding_table(spark, sf_dir), loadings).select("cell", F.posexplode("vector").alias("dim", "value")))


@query("cca")
def _(spark, sf_dir):
    v = embedding_table(spark, sf_dir)
    a, b, _ = reduction.cca(_even(v), _odd(v), 5)
    return rounded(a.unionByName(b).select("cell", F.posexplode("vector").alias("dim", "value")), 4)


@query("lda")
def _(spark, sf_dir):
    v = embedding_table(spark, sf_dir)
    return rounded(reduction.lda(v.select("cell", "vector"), v.select("cell", F.col("ident").alias("label")), 5)[0].select("cell", F.posexplode("vector").alias("dim", "value")), 4)


@query("supervised_pca")
def _(spark, sf_dir):
    v = embedding_table(spark, sf_dir)
    return rounded(reduction.supervised(v.select("cell", "vector"), neighbors.snn(neighbors.knn(v, k=K), K), 5)[0].select("cell", F.posexplode("vector").alias("dim", "value")), 4)


@query("graph_laplacian")
def _(spark, sf_dir):
    v = embedding_table(spark, sf_dir)
    return rounded(reduction.laplacian(neighbors.snn(neighbors.knn(v, k=K), K), 5).select("cell", F.posexplode("vector").alias("dim", "value")), 4)


@query("jackstraw")
def _(spark, sf_dir):
    v = embedding_table(spark, sf_dir).select("cell", "vector")
    return spark.createDataFrame(reduction.jackstraw(v, 20, 100))


@query("leverage_scores")
def _(spark, sf_dir):
    return rounded(sketching.leverage_exact(embedding_table(spark, sf_dir), 20))


@query("leverage_sketched")
def _(spark, sf_dir):
    return rounded(sketching.leverage_sketched(embedding_table(spark, sf_dir), 400), 4)


@query("sketch_cells")
def _(spark, sf_dir):
    return sketching.sketch_cells(embedding_table(spark, sf_dir), 100)


@query("unsketch_embeddings")
def _(spark, sf_dir):
    v = embedding_table(spark, sf_dir).select("cell", "vector")
    atoms = v.join(sketching.sketch_cells(v, 200), "cell", "left_semi")
    return rounded(sketching.unsketch(reduction.pca(atoms, 5)[0], atoms, v).select("cell", F.posexplode("vector").alias("dim", "value")), 4)


@query("count_sketch_given_hash", "SELECT l_partkey AS feature, l_suppkey % 16 AS bucket, round(sum(l_quantity * CASE WHEN l_suppkey % 3 = 0 THEN 1 ELSE -1 END), 6) + 0 AS value FROM lineitem GROUP BY 1, 2", base="")
def _(spark, sf_dir):
    m = sales_matrix(spark, sf_dir)
    hashes = m.cells.select("cell", (F.col("cell") % 16).alias("bucket"), F.when(F.col("cell") % 3 == 0, 1.0).otherwise(-1.0).alias("sign"))
    return rounded(sketching.sketch_with(m.values, hashes))


def _coords(v: DataFrame) -> DataFrame:
    return v.select("cell", F.get("vector", 0).alias("x"), F.get("vector", 1).alias("y"))


def _marks(v: DataFrame) -> DataFrame:
    return v.select("cell", F.posexplode(F.slice("vector", 3, 62)).alias("feature", "value")).select("feature", "cell", "value")


@query("morans_i", """, wt AS (SELECT x.cell AS i, y.cell AS j, 1 / (pow(x.vec[1] - y.vec[1], 2) + pow(x.vec[2] - y.vec[2], 2)) AS w FROM v x, v y WHERE x.cell <> y.cell AND pow(x.vec[1] - y.vec[1], 2) + pow(x.vec[2] - y.vec[2], 2) > 0),
z AS (SELECT cell, f, vec[f + 3] - avg(vec[f + 3]) OVER (PARTITION BY f) AS z FROM v, range(62) t(f)), s0 AS (SELECT sum(w) AS s0 FROM wt),
s1 AS (SELECT sum(pow(a.w + coalesce(b.w, 0), 2)) / 2 AS s1 FROM wt a LEFT JOIN wt b ON a.i = b.j AND a.j = b.i),
s2 AS (SELECT sum(pow(o + n, 2)) AS s2 FROM (SELECT i, sum(w) AS o FROM wt GROUP BY 1) x JOIN (SELECT j, sum(w) AS n FROM wt GROUP BY 1) y ON i = j),
n AS (SELECT count(*)::DOUBLE AS n FROM v), q AS (SELECT f, sum(z * z) AS q FROM z GROUP BY 1),
c AS (SELECT a.f, sum(w * a.z * b.z) AS c FROM wt JOIN z a ON a.cell = i JOIN z b ON b.cell = j AND a.f = b.f GROUP BY 1),
r AS (SELECT q.f, n * c / (s0 * q) AS observed, -1 / (n - 1) AS expected, sqrt((n * n * s1 - n * s2 + 3 * s0 * s0) / (s0 * s0 * (n * n - 1)) - 1 / pow(n - 1, 2)) AS sd FROM q JOIN c USING (f), s0, s1, s2, n)
SELECT f::INT AS feature, round(observed, 6) AS observed, round(expected, 6) AS expected, round(sd, 6) AS sd, round((observed - expected) / sd, 4) AS z FROM r""")
def _(spark, sf_dir):
    v = embedding_table(spark, sf_dir)
    out = spatial.morans_i(_marks(v), spatial.inverse_square_weights(_coords(v)), v.count())
    return rounded(out.withColumn("z", F.round("z", 4)))


@query("mark_variogram", """, p AS (SELECT query AS i, neighbor AS j FROM (SELECT x.cell AS query, y.cell AS neighbor, row_number() OVER (PARTITION BY x.cell ORDER BY round(sqrt(pow(x.vec[1] - y.vec[1], 2) + pow(x.vec[2] - y.vec[2], 2)), 9), y.cell) AS rank FROM v x, v y) WHERE rank <= 6 AND query <> neighbor)
SELECT f::INT AS feature, round(avg(pow(a.vec[f + 3] - b.vec[f + 3], 2)) / 2 / (SELECT var_pop(vec[f + 3]) FROM v), 6) AS r_metric FROM p JOIN v a ON a.cell = i JOIN v b ON b.cell = j, range(62) t(f) GROUP BY f""")
def _(spark, sf_dir):
    v = embedding_table(spark, sf_dir)
    plane = v.select("cell", F.slice("vector", 1, 2).alias("vector"))
    pairs = neighbors.knn(plane, k=6).filter("query != neighbor").select(F.col("query").alias("i"), F.col("neighbor").alias("j"))
    return rounded(spatial.mark_variogram(_marks(v), pairs, v.count()))


@query("spatial_bins", """, s AS (SELECT min(vec[1]) AS lx, max(vec[1]) AS hx, min(vec[2]) AS ly, max(vec[2]) AS hy FROM v),
b AS (SELECT cell, vec, least(4, floor((vec[1] - lx) / ((hx - lx) / 4)) + 1)::INT AS bin_x, least(4, floor((vec[2] - ly) / ((hy - ly) / 4)) + 1)::INT AS bin_y FROM v, s)
SELECT f::INT AS feature, bin_x, bin_y, round(avg(vec[f + 3]), 6) + 0 AS value FROM b, range(62) t(f) GROUP BY 1, 2, 3""")
def _(spark, sf_dir):
    v = embedding_table(spark, sf_dir)
    return rounded(aggregate.spatial_bins(_marks(v), _coords(v), 4, 4))


_TAGS = """
WITH t AS (SELECT user_id AS cell, event_type AS feature, count(*)::DOUBLE AS value FROM events GROUP BY 1, 2),
c AS (SELECT DISTINCT cell FROM t), cut AS (SELECT feature, avg(value) AS cutoff FROM t GROUP BY 1),
r AS (SELECT c.cell, cut.feature, cutoff, coalesce(value, 0) AS value FROM c CROSS JOIN cut LEFT JOIN t ON t.cell = c.cell AND t.feature = cut.feature),
k AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY value DESC, feature) AS k FROM r)
"""


def _tags(spark, sf_dir) -> Matrix:
    return bundle(table(spark, sf_dir, "events").select(F.col("event_type").alias("feature"), F.col("user_id").alias("cell"), F.lit(1.0).alias("value")))


@query("hash_classification_given_cutoffs", """, o AS (SELECT cell, sum(CASE WHEN value > cutoff THEN 1 ELSE 0 END)::BIGINT AS n_tags, max(CASE WHEN k = 1 THEN feature END) AS max_tag, max(CASE WHEN k = 2 THEN feature END) AS second_tag, max(CASE WHEN k = 1 THEN value END) - max(CASE WHEN k = 2 THEN value END) AS margin FROM k GROUP BY 1)
SELECT cell, n_tags, CASE n_tags WHEN 0 THEN 'Negative' WHEN 1 THEN 'Singlet' ELSE 'Doublet' END AS classification, max_tag, second_tag, margin FROM o""", base=_TAGS)
def _(spark, sf_dir):
    m = _tags(spark, sf_dir)
    cutoffs = m.values.groupBy("feature").agg(F.avg("value").alias("cutoff"))
    return demultiplexing.classify_tags(m.values, m.cells, cutoffs)


@query("hash_demultiplexing")
def _(spark, sf_dir):
    m = _tags(spark, sf_dir)
    clusters = m.cells.select("cell", F.pmod("cell", F.lit(6)).cast("int").alias("cluster"))
    return demultiplexing.classify_tags(m.values, m.cells, demultiplexing.tag_cutoffs(m, clusters))


@query("multiseq_demultiplexing")
def _(spark, sf_dir):
    return rounded(demultiplexing.multiseq(_tags(spark, sf_dir)))


@query("windowed_event_counts", "SELECT time_bucket(INTERVAL 1 HOUR, ts)::TIMESTAMP AS begin, user_id AS cell, event_type AS feature, count(*)::BIGINT AS value FROM events GROUP BY 1, 2, 3", base="")
def _(spark, sf_dir):
    rows = windowed_counts(table(spark, sf_dir, "events"), "ts", "user_id", "event_type")
    return rows.withColumn("begin", F.col("begin").cast("timestamp_ntz"))
