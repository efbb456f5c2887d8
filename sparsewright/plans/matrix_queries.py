"""Queries on the sales matrix (parts x suppliers), with the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparsewright.matrix import Matrix, sales_matrix, table
from sparsewright.operators import aggregate, differential, normalize, scaling, statistics, variable_features, verbs
from sparsewright.plans.rounding import rounded

FIRST, SECOND = "ASIA", "EUROPE"
QUERIES: dict = {}
SQL: dict = {}

#: m: stored entries; c: cells; f: features; nc, nf: their numbers.
BASE = """
WITH m AS (SELECT l_partkey AS feature, l_suppkey AS cell, sum(l_quantity)::DOUBLE AS value FROM lineitem GROUP BY 1, 2 HAVING sum(l_quantity) <> 0),
c AS (SELECT s_suppkey AS cell, r_name AS ident, n_name AS batch, s_acctbal AS covariate FROM supplier LEFT JOIN (nation JOIN region ON n_regionkey = r_regionkey) ON s_nationkey = n_nationkey),
f AS (SELECT p_partkey AS feature, p_name AS name, p_brand AS brand, p_size AS size FROM part),
nc AS (SELECT count(*)::DOUBLE AS n FROM c), nf AS (SELECT count(*)::DOUBLE AS n FROM f),
tot AS (SELECT cell, sum(value) AS t FROM m GROUP BY 1),
d AS (SELECT feature, cell, ln(1 + value / t * 1e4) AS value FROM m JOIN tot USING (cell)),
dense AS (SELECT feature, cell, coalesce(value, 0) AS value FROM (SELECT feature FROM f) CROSS JOIN (SELECT cell FROM c) LEFT JOIN m USING (feature, cell)),
ddense AS (SELECT feature, cell, coalesce(value, 0) AS value FROM (SELECT feature FROM f) CROSS JOIN (SELECT cell FROM c) LEFT JOIN d USING (feature, cell))
"""


def query(name: str, sql: str | None = None, base: str = BASE):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = f"{base} {sql}" if not base or not sql.lstrip().startswith(",") else base.rstrip() + sql
        return f

    return add


def data(spark: SparkSession, sf_dir: str) -> Matrix:
    return normalize.log_normalize(sales_matrix(spark, sf_dir))


@query("log_normalize", "SELECT feature, cell, round(value, 6) AS value FROM d")
def _(spark, sf_dir) -> DataFrame:
    return rounded(data(spark, sf_dir).values)


@query("relative_counts", "SELECT feature, cell, round(value / t * 1e6, 6) AS value FROM m JOIN tot USING (cell)")
def _(spark, sf_dir):
    return rounded(normalize.relative_counts(sales_matrix(spark, sf_dir), 1e6).values)


@query("clr_by_feature", "SELECT feature, cell, round(ln(1 + value / g), 6) AS value FROM m JOIN (SELECT feature, exp(sum(ln(1 + value)) / max(n)) AS g FROM m, nc WHERE value > 0 GROUP BY 1) USING (feature)")
def _(spark, sf_dir):
    return rounded(normalize.clr(sales_matrix(spark, sf_dir), 1).values)


@query("clr_by_cell", "SELECT feature, cell, round(ln(1 + value / g), 6) AS value FROM m JOIN (SELECT cell, exp(sum(ln(1 + value)) / max(n)) AS g FROM m, nf WHERE value > 0 GROUP BY 1) USING (cell)")
def _(spark, sf_dir):
    return rounded(normalize.clr(sales_matrix(spark, sf_dir), 2).values)


@query("custom_normalize", "SELECT feature, cell, round(value / max(value) OVER (PARTITION BY cell), 6) AS value FROM m")
def _(spark, sf_dir):
    return rounded(normalize.custom(sales_matrix(spark, sf_dir), lambda x: x / x.max()).values)


@query("sample_umi")
def _(spark, sf_dir):
    return normalize.sample_counts(sales_matrix(spark, sf_dir), 1000.0).values


@query("qc_metrics", "SELECT c.cell, coalesce(t, 0)::DOUBLE AS n_count, coalesce(k, 0)::BIGINT AS n_feature FROM c LEFT JOIN tot USING (cell) LEFT JOIN (SELECT cell, count(*) AS k FROM m GROUP BY 1) USING (cell)")
def _(spark, sf_dir):
    return rounded(statistics.qc(sales_matrix(spark, sf_dir)))


@query("percentage_feature_set", "SELECT c.cell, round(p, 6) AS percent FROM c LEFT JOIN (SELECT cell, 100 * sum(CASE WHEN brand = 'Brand#13' THEN value ELSE 0 END) / sum(value) AS p FROM m JOIN f USING (feature) GROUP BY 1) USING (cell)")
def _(spark, sf_dir):
    m = sales_matrix(spark, sf_dir)
    return rounded(statistics.percentage_feature_set(m, m.features.filter("brand = 'Brand#13'")))


@query("percent_above", "SELECT feature, round(sum(CASE WHEN value > 30 THEN 1 ELSE 0 END) / count(*)::DOUBLE, 6) AS share FROM m GROUP BY 1")
def _(spark, sf_dir):
    from sparsewright.functions.scalar import percent_above

    return rounded(sales_matrix(spark, sf_dir).values.groupBy("feature").agg(percent_above(F.col("value"), 30.0).alias("share")))


@query("row_mean_var", "SELECT feature, round(sum(value), 6) AS total, round(avg(value), 6) AS mean, round(var_samp(value), 6) AS variance FROM dense GROUP BY 1")
def _(spark, sf_dir):
    return rounded(statistics.row_moments(sales_matrix(spark, sf_dir)))


@query("row_mean_sd", "SELECT feature, round(avg(value), 6) AS mean, round(greatest(stddev_samp(value), 1e-8), 6) AS sd FROM dense GROUP BY 1")
def _(spark, sf_dir):
    return rounded(statistics.row_mean_sd(sales_matrix(spark, sf_dir)))


_EXP = ", e AS (SELECT feature, avg(exp(value) - 1) AS mu, var_samp(exp(value) - 1) AS v FROM ddense GROUP BY 1), es AS (SELECT feature, ln(1 + mu) AS exp_mean, ln(1 + v) AS exp_var, ln(1 + sqrt(v)) AS exp_sd, CASE WHEN mu > 0 AND v > 0 THEN ln(v / mu) END AS log_vmr FROM e)"


@query("exp_mean_log_vmr", _EXP + " SELECT feature, round(exp_mean, 6) AS exp_mean, round(exp_var, 6) AS exp_var, round(exp_sd, 6) AS exp_sd, round(log_vmr, 6) AS log_vmr FROM es")
def _(spark, sf_dir):
    return rounded(statistics.expm1_statistics(data(spark, sf_dir)))


_DISP = _EXP + """, b0 AS (SELECT feature, exp_mean AS mean, coalesce(log_vmr, 0) AS dispersion FROM es), sp AS (SELECT min(mean) AS lo, max(mean) AS hi FROM b0),
b1 AS (SELECT *, greatest(1, least(20, ceil((mean - lo) / ((hi - lo) / 20))))::INT AS bin FROM b0, sp),
b2 AS (SELECT bin, avg(dispersion) AS ctr, stddev_samp(dispersion) AS spread FROM b1 GROUP BY 1),
disp AS (SELECT feature, mean, dispersion, b1.bin, CASE WHEN spread > 0 THEN (dispersion - ctr) / spread END AS dispersion_scaled FROM b1 JOIN b2 USING (bin))"""


@query("dispersion_bins", _DISP + " SELECT feature, round(mean, 6) AS mean, round(dispersion, 6) AS dispersion, bin, round(dispersion_scaled, 6) AS dispersion_scaled FROM disp")
def _(spark, sf_dir):
    return rounded(variable_features.dispersion(data(spark, sf_dir)))


@query("mean_var_plot", _DISP + " SELECT feature, round(mean, 6) AS mean, round(dispersion, 6) AS dispersion, bin, round(dispersion_scaled, 6) AS dispersion_scaled, row_number() OVER (ORDER BY dispersion DESC, feature)::INT AS rank FROM disp WHERE mean > 0.1 AND mean < 8 AND dispersion_scaled > 1")
def _(spark, sf_dir):
    return rounded(variable_features.mean_var_plot(data(spark, sf_dir)))


@query("top_dispersion", _DISP + " SELECT feature, round(dispersion, 6) AS dispersion, row_number() OVER (ORDER BY dispersion DESC, feature)::INT AS rank FROM disp ORDER BY rank LIMIT 100")
def _(spark, sf_dir):
    return rounded(variable_features.top_dispersion(data(spark, sf_dir), 100))


_MOM = ", mom AS (SELECT feature, avg(value) AS mu, var_samp(value) AS v, sum(value) AS s FROM dense GROUP BY 1)"


@query("standardized_variance", _MOM + " SELECT feature, round(sum(CASE WHEN mu > 0 THEN pow(least(sqrt(n), (value - mu) / sqrt(mu)), 2) ELSE 0 END) / (max(n) - 1), 6) AS variance_standardized FROM dense JOIN mom USING (feature), nc GROUP BY 1")
def _(spark, sf_dir):
    m = sales_matrix(spark, sf_dir)
    expected = statistics.row_moments(m).select("feature", "mean", F.sqrt("mean").alias("sd_expected"))  # a given trend: the Poisson one
    return rounded(statistics.standardized_variance(m, expected))


@query("vst_features")
def _(spark, sf_dir):
    return rounded(variable_features.vst(sales_matrix(spark, sf_dir), 200))


_CHOSEN = ", ch AS (SELECT feature FROM f WHERE brand = 'Brand#13')"


def _brand(m: Matrix) -> DataFrame:
    return m.features.filter("brand = 'Brand#13'").select("feature")


@query("scale_data", _MOM + " SELECT feature, cell, round(coalesce(CASE WHEN v > 1e-9 THEN least(10, (value - mu) / sqrt(v)) END, 0), 6) + 0 AS value FROM dense JOIN mom USING (feature)")
def _(spark, sf_dir):
    return scaling.scale_data(sales_matrix(spark, sf_dir), digits=6)


@query("scale_data_split", ", g AS (SELECT feature, ident, avg(value) AS mu, var_samp(value) AS v FROM dense JOIN c USING (cell) WHERE ident IS NOT NULL GROUP BY 1, 2) SELECT feature, cell, round(coalesce(CASE WHEN v > 1e-9 THEN least(10, (value - mu) / sqrt(v)) END, 0), 6) + 0 AS value FROM dense JOIN c USING (cell) JOIN g USING (feature, ident)")
def _(spark, sf_dir):
    return scaling.scale_data_by(sales_matrix(spark, sf_dir), "ident", digits=6)


@query("regress_linear", ", r AS (SELECT feature, regr_slope(value, covariate) AS b, avg(value) AS my, avg(covariate) AS mx FROM dense JOIN c USING (cell) GROUP BY 1) SELECT feature, cell, round(value - my - b * (covariate - mx), 6) + 0 AS value FROM dense JOIN c USING (cell) JOIN r USING (feature)")
def _(spark, sf_dir):
    return scaling.regress_linear(sales_matrix(spark, sf_dir), "covariate", digits=6)


@query("regress_poisson")
def _(spark, sf_dir):
    return scaling.regress_out(sales_matrix(spark, sf_dir), ["covariate"], "poisson", digits=4)


@query("average_expression", "SELECT feature, ident AS grp, round(avg(exp(value) - 1), 6) AS value FROM ddense JOIN c USING (cell) WHERE ident IS NOT NULL GROUP BY 1, 2")
def _(spark, sf_dir):
    m = data(spark, sf_dir)
    return rounded(aggregate.pseudobulk(m, ["ident"], "average", "data"))


@query("aggregate_expression_two_keys", "SELECT feature, translate(ident, '_', '-') || '_' || translate(batch, '_', '-') AS grp, round(sum(value), 6) AS value FROM dense JOIN c USING (cell) WHERE ident IS NOT NULL AND batch IS NOT NULL GROUP BY 1, 2")
def _(spark, sf_dir):
    return rounded(aggregate.pseudobulk(sales_matrix(spark, sf_dir), ["ident", "batch"], "aggregate"))


@query("dot_plot_table", """, a AS (SELECT feature, ident AS grp, avg(exp(value) - 1) AS avg_exp, 100.0 * avg(CASE WHEN value > 0 THEN 1.0 ELSE 0 END) AS pct_exp FROM ddense JOIN c USING (cell) WHERE ident IS NOT NULL GROUP BY 1, 2),
z AS (SELECT *, avg(ln(1 + avg_exp)) OVER w AS mu, stddev_samp(ln(1 + avg_exp)) OVER w AS sd FROM a WINDOW w AS (PARTITION BY feature))
SELECT feature, grp, round(avg_exp, 6) AS avg_exp, round(pct_exp, 6) AS pct_exp, round(CASE WHEN sd > 0 THEN greatest(-2.5, least(2.5, (ln(1 + avg_exp) - mu) / sd)) END, 6) + 0 AS avg_scaled FROM z""")
def _(spark, sf_dir):
    m = data(spark, sf_dir)
    return rounded(aggregate.dot_plot(m, "ident", m.features))


@query("meta_feature", _CHOSEN + ", rt AS (SELECT feature, sum(value) AS s FROM m WHERE feature IN (SELECT feature FROM ch) GROUP BY 1) SELECT c.cell, round(coalesce(x, 0), 6) AS score FROM c LEFT JOIN (SELECT cell, sum(value / s) / (SELECT count(*) FROM rt) AS x FROM m JOIN rt USING (feature) GROUP BY 1) USING (cell)")
def _(spark, sf_dir):
    m = sales_matrix(spark, sf_dir)
    return rounded(statistics.meta_feature(m, _brand(m)))


def _sets(m: Matrix) -> tuple[DataFrame, DataFrame]:
    names = F.when(F.col("brand") == "Brand#13", "a").when(F.col("brand") == "Brand#25", "b")
    sets = m.features.withColumn("set_name", names).filter("set_name is not null").select("set_name", "feature")
    controls = m.features.filter("size <= 5").select("feature").join(sets.select("set_name").distinct(), how="cross").select("set_name", "feature")
    return sets, controls


@query("module_score_fixed_controls", """, st AS (SELECT feature, CASE brand WHEN 'Brand#13' THEN 'a' WHEN 'Brand#25' THEN 'b' END AS set_name FROM f WHERE brand IN ('Brand#13', 'Brand#25')),
w AS (SELECT set_name, feature, 1.0::DOUBLE / count(*) OVER (PARTITION BY set_name) AS w FROM st UNION ALL SELECT set_name, feature, -1.0::DOUBLE / count(*) OVER (PARTITION BY set_name) FROM f, (SELECT DISTINCT set_name FROM st) WHERE size <= 5),
g AS (SELECT cell, set_name FROM c, (SELECT DISTINCT set_name FROM st))
SELECT g.cell, g.set_name, round(coalesce(x, 0), 6) + 0 AS score FROM g LEFT JOIN (SELECT cell, set_name, sum(value * w) AS x FROM d JOIN w USING (feature) GROUP BY 1, 2) s ON g.cell = s.cell AND g.set_name = s.set_name""")
def _(spark, sf_dir):
    m = data(spark, sf_dir)
    return rounded(aggregate.scores_of(m, *_sets(m)))


@query("module_score")
def _(spark, sf_dir):
    m = data(spark, sf_dir)
    return rounded(aggregate.module_scores(m, _sets(m)[0]))


@query("cell_cycle_phase")
def _(spark, sf_dir):
    m = data(spark, sf_dir)
    return rounded(aggregate.cell_cycle(aggregate.scores_of(m, *_sets(m)), "a", "b"))


@query("smooth_labels", "SELECT ident, batch FROM (SELECT ident, batch, row_number() OVER (PARTITION BY ident ORDER BY count(*) DESC, batch) AS k FROM c WHERE batch IS NOT NULL GROUP BY 1, 2) WHERE k = 1")
def _(spark, sf_dir):
    return aggregate.smooth_labels(sales_matrix(spark, sf_dir).cells, "ident", "batch")


@query("barcode_inflections", """, q AS (SELECT c.cell, ident, coalesce(t, 0)::DOUBLE AS n_count FROM c LEFT JOIN tot USING (cell)),
r AS (SELECT *, row_number() OVER w AS rank, log10(n_count + 1) AS y FROM q WINDOW w AS (PARTITION BY ident ORDER BY n_count DESC, cell)),
x AS (SELECT *, coalesce(y - lag(y) OVER (PARTITION BY ident ORDER BY rank), 0) AS derivative FROM r),
b AS (SELECT ident, n_count AS inflection FROM (SELECT *, row_number() OVER (PARTITION BY ident ORDER BY derivative, rank) AS k FROM x WHERE rank > 2 AND rank < 15) WHERE k = 1)
SELECT x.ident, cell, rank::INT AS rank, round(derivative, 6) AS derivative, round(inflection, 6) AS inflection, n_count >= inflection AS kept FROM x LEFT JOIN b USING (ident)""")
def _(spark, sf_dir):
    m = sales_matrix(spark, sf_dir)
    return rounded(aggregate.barcode_inflections(m.cells.join(statistics.qc(m), "cell"), "n_count", "ident", 2, 15))


@query("group_correlation", "SELECT feature, round(corr(value, covariate), 6) + 0 AS correlation FROM dense JOIN c USING (cell) WHERE feature IN (SELECT feature FROM m) GROUP BY 1")
def _(spark, sf_dir):
    return rounded(aggregate.group_correlation(sales_matrix(spark, sf_dir), "covariate"))


@query("feature_groups", """, a AS (SELECT feature, log10(exp(sum(ln(1 + value)) / max(n)) - 1) AS log_mean FROM m, nc WHERE value > 0 GROUP BY 1 HAVING count(*) >= 5), s AS (SELECT min(log_mean) AS lo, max(log_mean) AS hi FROM a)
SELECT feature, round(log_mean, 6) AS log_mean, greatest(1, least(6, ceil((log_mean - lo) / ((hi - lo) / 6))))::INT AS grp FROM a, s""")
def _(spark, sf_dir):
    return rounded(aggregate.feature_groups(sales_matrix(spark, sf_dir)))


_G = f", g AS (SELECT cell, CASE ident WHEN '{FIRST}' THEN 1 WHEN '{SECOND}' THEN 2 END AS g FROM c WHERE ident IN ('{FIRST}', '{SECOND}')), n1 AS (SELECT count(*)::DOUBLE AS n1 FROM g WHERE g = 1), n2 AS (SELECT count(*)::DOUBLE AS n2 FROM g WHERE g = 2), x AS (SELECT feature, cell, value, g, n1, n2 FROM ddense JOIN g USING (cell), n1, n2)"


def _groups(m: Matrix) -> DataFrame:
    return differential.two_groups(m, "ident", FIRST, SECOND)


_FC = ", fc AS (SELECT feature, (ln((sum(CASE WHEN g = 1 THEN exp(value) - 1 ELSE 0 END) + 1) / max(n1)) - ln((sum(CASE WHEN g = 2 THEN exp(value) - 1 ELSE 0 END) + 1) / max(n2))) / ln(2) AS avg_log_fc, round(sum(CASE WHEN g = 1 AND value > 0 THEN 1 ELSE 0 END) / max(n1), 3) AS pct_1, round(sum(CASE WHEN g = 2 AND value > 0 THEN 1 ELSE 0 END) / max(n2), 3) AS pct_2 FROM x GROUP BY 1)"


@query("fold_change", _G + _FC + " SELECT feature, round(avg_log_fc, 6) + 0 AS avg_log_fc, pct_1, pct_2 FROM fc")
def _(spark, sf_dir):
    m = data(spark, sf_dir)
    return rounded(differential.fold_change(m, _groups(m)))


_W = ", rk AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0 AS mid, count(*) OVER (PARTITION BY feature, value)::DOUBLE AS t FROM x), ws AS (SELECT feature, sum(CASE WHEN g = 1 THEN mid ELSE 0 END)::DOUBLE - max(n1) * (max(n1) + 1) / 2 AS u, sum(t * t - 1) AS ties, max(n1) AS n1, max(n2) AS n2 FROM rk GROUP BY 1), w AS (SELECT feature, u, n1, n2, n1 * n2 / 12 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1))) AS v, u - n1 * n2 / 2 AS gap FROM ws)"


@query("wilcoxon_statistic", _G + _W + " SELECT feature, round(u, 6) AS u, round(CASE WHEN v > 1e-9 THEN (gap - sign(gap) * 0.5) / sqrt(v) END, 6) + 0 AS z, round(u / (n1 * n2), 3) AS auc FROM w")
def _(spark, sf_dir):
    m = data(spark, sf_dir)
    return rounded(differential.wilcoxon(m, _groups(m)).drop("p_val"))


@query("auc_power", _G + _W + " SELECT feature, round(u / (n1 * n2), 3) AS my_auc, round(ln(1 + s1 / n1) - ln(1 + s2 / n2), 6) + 0 AS avg_diff, round(abs(round(u / (n1 * n2), 3) - 0.5) * 2, 6) AS power FROM w JOIN (SELECT feature, sum(CASE WHEN g = 1 THEN exp(value) - 1 ELSE 0 END) AS s1, sum(CASE WHEN g = 2 THEN exp(value) - 1 ELSE 0 END) AS s2 FROM x GROUP BY 1) USING (feature)")
def _(spark, sf_dir):
    m = data(spark, sf_dir)
    return rounded(differential.roc(m, _groups(m)))


@query("welch_t_statistic", _G + """, a AS (SELECT feature, avg(CASE WHEN g = 1 THEN value END) AS m1, avg(CASE WHEN g = 2 THEN value END) AS m2, var_samp(CASE WHEN g = 1 THEN value END) / max(n1) AS a, var_samp(CASE WHEN g = 2 THEN value END) / max(n2) AS b, max(n1) AS n1, max(n2) AS n2 FROM x GROUP BY 1)
SELECT feature, round(CASE WHEN a + b > 0 THEN (m1 - m2) / sqrt(a + b) END, 6) + 0 AS t, round(CASE WHEN a + b > 0 THEN (a + b) * (a + b) / (a * a / (n1 - 1) + b * b / (n2 - 1)) END, 6) AS df FROM a""")
def _(spark, sf_dir):
    m = data(spark, sf_dir)
    return rounded(differential.welch_t(m, _groups(m)).drop("p_val"))


@query("bimod_loglik")
def _(spark, sf_dir):
    m = data(spark, sf_dir)
    return rounded(differential.bimod(m, _groups(m)))


@query("find_markers")
def _(spark, sf_dir):
    return rounded(differential.find_markers(data(spark, sf_dir), "ident", FIRST))


@query("find_markers_roc")
def _(spark, sf_dir):
    return rounded(differential.find_markers(data(spark, sf_dir), "ident", FIRST, SECOND, test="roc"))


@query("glm_poisson_test")
def _(spark, sf_dir):
    m = sales_matrix(spark, sf_dir)
    return rounded(differential.glm_test(m, _groups(m), "poisson"), 4)


@query("logistic_test")
def _(spark, sf_dir):
    m = data(spark, sf_dir)
    return rounded(differential.glm_test(m, _groups(m), "logistic"), 4)


@query("find_all_markers_statistics", """, i AS (SELECT DISTINCT ident AS cluster FROM c WHERE ident IS NOT NULL),
x AS (SELECT cluster, feature, value, CASE WHEN ident = cluster THEN 1 ELSE 2 END AS g FROM ddense JOIN c USING (cell), i WHERE ident IS NOT NULL),
rk AS (SELECT *, rank() OVER (PARTITION BY cluster, feature ORDER BY value) + (count(*) OVER (PARTITION BY cluster, feature, value) - 1) / 2.0 AS mid, count(*) OVER (PARTITION BY cluster, feature, value)::DOUBLE AS t FROM x),
a AS (SELECT cluster, feature, sum(CASE WHEN g = 1 THEN mid ELSE 0 END)::DOUBLE AS r, sum(t * t - 1) AS ties, sum(CASE WHEN g = 1 THEN 1 ELSE 0 END)::DOUBLE AS n1, sum(CASE WHEN g = 2 THEN 1 ELSE 0 END)::DOUBLE AS n2,
  sum(CASE WHEN g = 1 THEN exp(value) - 1 ELSE 0 END) AS s1, sum(CASE WHEN g = 2 THEN exp(value) - 1 ELSE 0 END) AS s2, sum(CASE WHEN g = 1 AND value > 0 THEN 1 ELSE 0 END) AS p1, sum(CASE WHEN g = 2 AND value > 0 THEN 1 ELSE 0 END) AS p2 FROM rk GROUP BY 1, 2),
b AS (SELECT *, r - n1 * (n1 + 1) / 2 AS u, n1 * n2 / 12 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1))) AS v FROM a)
SELECT cluster, feature, round(u, 6) AS u, round(CASE WHEN v > 1e-9 THEN (u - n1 * n2 / 2 - sign(u - n1 * n2 / 2) * 0.5) / sqrt(v) END, 6) + 0 AS z, round((ln((s1 + 1) / n1) - ln((s2 + 1) / n2)) / ln(2), 6) + 0 AS avg_log_fc, round(p1 / n1, 3) AS pct_1, round(p2 / n2, 3) AS pct_2 FROM b""")
def _(spark, sf_dir):
    return rounded(differential.one_vs_rest(data(spark, sf_dir), "ident"))


@query("find_all_markers")
def _(spark, sf_dir):
    return rounded(differential.find_all_markers(data(spark, sf_dir), "ident"))


@query("find_conserved_markers")
def _(spark, sf_dir):
    m = data(spark, sf_dir)
    half = m.cells.withColumn("half", F.when(F.col("cell") % 2 == 0, "even").otherwise("odd"))
    return rounded(differential.find_conserved(Matrix(m.values, half, m.features), "ident", FIRST, "half"))


@query("merge_union", "SELECT feature, k || '_' || cell AS cell, value FROM m, (VALUES ('a'), ('b')) AS t(k)")
def _(spark, sf_dir):
    m = sales_matrix(spark, sf_dir)
    return verbs.merge({"a": m, "b": m}).values


@query("merge_sparse_sum", "SELECT feature, cell, 2 * value AS value FROM m")
def _(spark, sf_dir):
    m = sales_matrix(spark, sf_dir)
    return verbs.merge_sum(m.values, m.values)


@query("collapse_species", ", t AS (SELECT feature, sum(value) AS s FROM m GROUP BY 1), k AS (SELECT feature, name[9:] AS nm FROM (SELECT feature, brand || name AS name FROM f) WHERE starts_with(name, 'Brand#13') UNION ALL SELECT feature, name FROM (SELECT feature, brand || name AS name, s FROM f LEFT JOIN t USING (feature)) WHERE starts_with(name, 'Brand#25') ORDER BY 1) SELECT nm AS feature_name, cell, value FROM m JOIN (SELECT feature, nm FROM k WHERE NOT starts_with(nm, 'Brand#25') OR feature IN (SELECT feature FROM f LEFT JOIN t USING (feature) WHERE brand = 'Brand#25' ORDER BY s DESC NULLS LAST, feature LIMIT 10)) USING (feature)")
def _(spark, sf_dir):
    m = sales_matrix(spark, sf_dir)
    named = Matrix(m.values, m.cells, m.features.withColumn("full", F.concat("brand", "name")))
    return verbs.collapse_species(named, "full", "Brand#13", "Brand#25", 10)


@query("case_match", "SELECT DISTINCT lower(brand) AS search, brand AS name FROM f")
def _(spark, sf_dir):
    names = table(spark, sf_dir, "part").select(F.col("p_brand").alias("name")).distinct()
    return verbs.case_match(names.select(F.lower("name").alias("search")), names)


@query("duplicate_cell_names", "SELECT part::INT AS part, cell || '_' || part AS cell FROM c, (VALUES (1), (2)) AS t(part)")
def _(spark, sf_dir):
    c = sales_matrix(spark, sf_dir).cells
    return verbs.suffix_duplicates({1: c, 2: c})


_TOP = ", s AS (SELECT feature, sum(value) AS total FROM m GROUP BY 1)"


@query("top_features_balanced", _TOP + " SELECT * FROM (SELECT feature, total, 'positive' AS side FROM s ORDER BY total DESC, feature LIMIT 10) UNION ALL SELECT * FROM (SELECT feature, total, 'negative' AS side FROM s ORDER BY total, feature LIMIT 10)")
def _(spark, sf_dir):
    rows = sales_matrix(spark, sf_dir).values.groupBy("feature").agg(F.sum("value").alias("total"))
    return verbs.top(rows, "total", 20)


@query("set_quantile", "SELECT round(quantile_cont(value, 0.9), 6) AS cutoff FROM m WHERE value > 0")
def _(spark, sf_dir):
    return rounded(verbs.set_quantile(sales_matrix(spark, sf_dir).values, "value", 0.9))


@query("integration_features_by_rank", """, r AS (SELECT ident, feature, sum(value) AS s FROM m JOIN c USING (cell) WHERE ident IS NOT NULL GROUP BY 1, 2), k AS (SELECT ident, feature, row_number() OVER (PARTITION BY ident ORDER BY s DESC, feature) AS rank FROM r)
SELECT feature, count(DISTINCT ident)::BIGINT AS n_datasets, quantile_cont(rank::DOUBLE, 0.5) AS median_rank FROM k WHERE rank <= 100 GROUP BY 1 ORDER BY 2 DESC, 3, 1 LIMIT 50""")
def _(spark, sf_dir):
    from pyspark.sql import Window

    m = sales_matrix(spark, sf_dir)
    sums = m.values.join(m.cells.filter("ident is not null").select("cell", F.col("ident").alias("dataset")), "cell").groupBy("dataset", "feature").agg(F.sum("value").alias("s"))
    ranks = sums.withColumn("rank", F.row_number().over(Window.partitionBy("dataset").orderBy(F.desc("s"), "feature"))).filter("rank <= 100")
    return variable_features.select_shared(ranks, 50, 5)


@query("matrix_row_shuffle")
def _(spark, sf_dir):
    return verbs.shuffle_rows(sales_matrix(spark, sf_dir))


@query("doc_term_matrix", "SELECT term, count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_total FROM (SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM documents) GROUP BY 1, 2) GROUP BY 1", base="")
def _(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), 1)).alias("term"))
    counts = words.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("term").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("n_total"))


@query("region_top_features", "SELECT ident AS grp, feature, round(value, 6) AS value, k::INT AS rank FROM (SELECT ident, feature, avg(exp(value) - 1) AS value, row_number() OVER (PARTITION BY ident ORDER BY round(avg(exp(value) - 1), 9) DESC, feature) AS k FROM ddense JOIN c USING (cell) WHERE ident IS NOT NULL GROUP BY 1, 2) WHERE k <= 10")
def flagship(spark, sf_dir):
    """Normalise, average by region, and take each region's ten largest features."""
    from pyspark.sql import Window

    rows = aggregate.pseudobulk(data(spark, sf_dir), ["ident"], "average", "data")
    k = F.row_number().over(Window.partitionBy("grp").orderBy(F.desc(F.round("value", 9)), "feature"))
    return rounded(rows.withColumn("rank", k).filter("rank <= 10").select("grp", "feature", "value", "rank"))
