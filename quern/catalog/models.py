"""Queries that fit something (checked by tests rather than by SQL) or need a distribution's tail."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.catalog import groups, matrices
from quern.catalog.base import log_expr, n_cells, raw_expr, registry, rounded
from quern.operators import bio, bulk, de, glm, hvg, impute as imp, norm, qc
from quern.plans import surrogates
from quern.plans.scratch import materialize
from quern.session import table

QUERIES, SQL, add = registry()

# tails as power series, which agree with the functions to more than the six places compared
NORMAL_SF = """0.5 - exp(-{z} * {z} / 2) / sqrt(2 * pi()) * sign({z}) * list_sum(list_transform(range(0, 200), lambda i:
  CASE WHEN {z} = 0 THEN 0 ELSE exp((2 * i + 1) * ln(abs({z})) - (i + 1) * ln(2.0) - lgamma(i + 1.5) + 0.5 * ln(pi())) END))"""
STUDENT_SF = """0.5 - 0.5 * sign({t}) * list_sum(list_transform(range(0, 300), lambda i: CASE WHEN {t} = 0 THEN 0 ELSE
  exp((i + 0.5) * ln({t} * {t} / ({d} + {t} * {t})) + {d} / 2.0 * ln({d} / ({d} + {t} * {t})) + lgamma({d} / 2.0 + 0.5 + i) - lgamma(i + 1.5) - lgamma({d} / 2.0)) END))"""
FISHER = """least(1.0, list_sum(list_transform(range(a, least(a + b, a + c) + 1), lambda i: exp(
  lgamma(a + c + 1) - lgamma(i + 1) - lgamma(a + c - i + 1) + lgamma(b + d + 1) - lgamma(a + b - i + 1) - lgamma(d - a + i + 1)
  - lgamma(a + b + c + d + 1) + lgamma(a + b + 1) + lgamma(c + d + 1)))))"""


def step_up(rows: str, n: str = "COUNT(*) OVER ()") -> str:
    """CTEs of Benjamini-Hochberg over ``rows``: ``adj`` with column ``fdr``."""
    return f"""stp AS (SELECT *, {n} * p_val / COUNT(*) OVER (ORDER BY p_val) AS q_ FROM {rows}),
adj AS (SELECT *, least(1.0, min(q_) OVER (ORDER BY p_val DESC)) AS fdr FROM stp)"""


@add()
def mcd_low_quality(spark, sf):
    return qc.find_low_quality(materialize(matrices.features(spark, sf), "features"))


@add()
def vsn(spark, sf):
    return norm.vsn(surrogates.matrix(spark, sf, "m4"))


@add()
def impute(spark, sf):
    clusters = surrogates.batches(spark, sf).withColumnRenamed("batch", "cluster")
    return imp.impute(surrogates.matrix(spark, sf, "m2"), clusters)


@add()
def impute_subpopulations(spark, sf):
    """The clusters that imputation finds by itself."""
    return imp.subpopulations(surrogates.matrix(spark, sf, "m2"))


def _spread(spark, sf):
    expr = materialize(log_expr(spark, sf, "m1"), "expr")
    return expr, n_cells(expr)


@add()
def hvg_brennecke(spark, sf):
    return hvg.brennecke(*_spread(spark, sf), ngenes=100)


@add()
def hvg_chen2016(spark, sf):
    return hvg.chen2016(*_spread(spark, sf), ngenes=100)


@add()
def hvg_mm(spark, sf):
    return hvg.mm(*_spread(spark, sf), ngenes=100)


@add()
def hvg_scran(spark, sf):
    expr, n = _spread(spark, sf)
    spikes = expr.where("gene % 20 = 0")
    return hvg.scran(expr.where("gene % 20 <> 0"), n, spikes, ngenes=100)


PVALUES = f"""{groups.LINEAR}, tl AS (SELECT *, {STUDENT_SF.format(t='t_stat', d='df')} AS up FROM lt),
both_ AS (SELECT a, b, gene, t_stat, t_stat AS t_signed, logfc, mean_a, mean_b, up AS p_val FROM tl
  UNION ALL SELECT b, a, gene, t_stat, -t_stat, -logfc, mean_b, mean_a, 1 - up FROM tl), {step_up('both_')}"""


@add(f"""{PVALUES} SELECT a || '_vs_' || b AS comparison, a, b, gene, round(p_val, 6) AS p_val, round(fdr, 6) AS fdr, round(t_stat, 6) AS t_stat,
  round(t_signed, 6) AS t_signed, round(logfc, 6) AS logfc, round(mean_a, 6) AS mean_a, round(mean_b, 6) AS mean_b FROM adj""")
def de_pvalues(spark, sf):
    tests = de.linear_model(log_expr(spark, sf, "m4"), surrogates.segments(spark, sf))
    return rounded(tests, "p_val", "fdr", "t_stat", "t_signed", "logfc", "mean_a", "mean_b")


SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
PIVOT = ", ".join(f"round(max(p_val) FILTER (a = '{a}' AND b = '{b}'), 6) AS \"{a}_vs_{b}\"" for a in SEGMENTS for b in SEGMENTS if a != b)


@add(f"{PVALUES} SELECT gene, {PIVOT} FROM both_ GROUP BY gene")
def de_matrix(spark, sf):
    return de.matrix_form(de_pvalues(spark, sf))


RANKS = groups.SQL["de_wilcoxon_u"].partition("SELECT gene, c1, c2, n1, n2, u::DOUBLE")[0]


@add(f"""{RANKS}, zz AS (SELECT *, CASE WHEN sd > 0 THEN (abs(u - n1 * n2 / 2.0) - 0.5) / sd ELSE 0 END AS z FROM w),
pz AS (SELECT *, least(1.0, 2 * ({NORMAL_SF.format(z='z')})) AS p_val FROM zz),
both_ AS (SELECT c1 AS a, c2 AS b, gene, u::DOUBLE AS u, p_val FROM pz UNION ALL SELECT c2, c1, gene, n1 * n2 - u, p_val FROM pz), {step_up('both_')}
SELECT a || '_vs_' || b AS comparison, a, b, gene, u, round(p_val, 6) AS p_val, round(fdr, 6) AS fdr FROM adj""")
def de_wilcoxon(spark, sf):
    return rounded(de.wilcoxon(raw_expr(spark, sf, "m4"), surrogates.segments(spark, sf)), "p_val", "fdr")


@add()
def stouffer(spark, sf):
    return de.combine_tests(groups.tests(spark, sf), "stouffer", "bonferroni")


@add(f"""{groups.SCORED.partition('sc AS')[0]}pm AS (SELECT regexp_replace(upper(gene), '_.*$', '') AS gene, cluster, max(median) AS median FROM md GROUP BY 1, 2),
sc AS (SELECT gene, cluster, median, (median - avg(median) OVER (PARTITION BY cluster)) / stddev_pop(median) OVER (PARTITION BY cluster) AS z FROM pm),
mu AS (SELECT upper(gene) AS gene, cell_type FROM mk), fq AS (SELECT gene, COUNT(*) AS f FROM mu GROUP BY gene),
ww AS (SELECT gene, 1 + sqrt(COALESCE((hi - f) / NULLIF(hi - lo, 0)::DOUBLE, 0)) AS weight FROM fq, (SELECT max(f) AS hi, min(f) AS lo FROM fq)),
md2 AS (SELECT DISTINCT gene, cell_type FROM mu),
ac AS (SELECT sc.cluster, cell_type, SUM(z * weight) / power(COUNT(*), 0.3) AS activity, COUNT(*) AS n, COUNT(*) FILTER (median > 0) AS a, COUNT(*) FILTER (NOT median > 0) AS b
  FROM sc JOIN md2 USING (gene) JOIN ww USING (gene) GROUP BY sc.cluster, cell_type),
ev AS (SELECT cluster, COUNT(*) FILTER (median > 0) AS e, COUNT(*) FILTER (NOT median > 0) AS ne FROM sc GROUP BY cluster),
ct AS (SELECT ac.*, e - a AS c, ne - b AS d FROM ac JOIN ev USING (cluster)), pf AS (SELECT *, {FISHER} AS p_val FROM ct), {step_up('pf')},
ra AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY activity DESC, cell_type) AS r FROM adj)
SELECT cluster, CASE WHEN fdr > 0.1 THEN 'Unknown' ELSE cell_type END AS cell_type, round(activity, 6) AS activity, n, a, b, c, d, round(p_val, 6) AS p_val, round(fdr, 6) AS fdr
FROM ra WHERE r = 1""")
def celltype_predict(spark, sf):
    clusters = surrogates.batches(spark, sf).withColumnRenamed("batch", "cluster")
    best = bio.predict_cell_types(log_expr(spark, sf, "m3"), clusters, groups.markers(spark, sf), 1)[0]
    return rounded(best, "activity", "p_val", "fdr")


@add(f"""{groups.SQL['celltype_contingency'].replace('SELECT se.cluster', ', ct AS (SELECT se.cluster')})
SELECT *, round({FISHER}, 6) AS p_val FROM ct""")
def fisher_exact(spark, sf):
    from quern.functions.special import udfs

    rows = bio.contingency(groups.scored(spark, sf), groups.markers(spark, sf))
    return rounded(rows.withColumn("p_val", udfs()["fisher_greater"](*[F.col(c).cast("double") for c in "abcd"])), "p_val")


@add()
def cell_cycle(spark, sf):
    """Trained on all labelled suppliers, predicted for all."""
    expr = materialize(log_expr(spark, sf, "m2"), "expr")
    genes = [r["gene"] for r in expr.select("gene").distinct().orderBy("gene").collect()]  # 25 brands
    phases = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("cell"), F.element_at(F.array(*map(F.lit, ("G1", "G2M", "S"))), (F.col("s_nationkey") % 3 + 1).cast("int")).alias("phase"))
    model, genes = bio.train_cell_cycle(expr, phases, genes)
    return bio.predict_cell_cycle(expr, model, genes)


@add()
def deconv_nnls(spark, sf):
    """Years of shipping as bulk samples."""
    sums = groups.sums(spark, sf)
    base = bulk.basis(bulk.mean_matrix(sums), bulk.library_sizes(sums, groups.cellmap(spark, sf)))
    lines = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.expr("l_partkey = p_partkey"))
    rows = lines.groupBy(F.col("p_brand").alias("gene"), F.year("l_shipdate").alias("sample")).agg(F.sum("l_quantity").alias("value"))
    return bulk.deconvolve(rows, base)


def _lines(spark, sf):
    return table(spark, sf, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@add()
def glm_poisson_identity(spark, sf):
    rows = _lines(spark, sf).withColumn("x", F.col("l_extendedprice") / 1000)
    return spark.createDataFrame(glm.GLM(glm.Gamma(), tol=1e-8).fit(rows, "l_quantity", ["x"]).summary())


@add("""WITH d AS (SELECT l_quantity::DOUBLE AS y, l_extendedprice / 1000.0 AS x FROM lineitem),
f AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a, COUNT(*) AS n, SUM(x * x) AS q, var_pop(x) AS v FROM d),
r AS (SELECT SUM(power(y - a - b * x, 2)) / (any_value(n) - 2) AS phi FROM d, f)
SELECT 'intercept' AS name, round(a, 6) AS estimate, round(sqrt(phi * q / (n * n * v)), 8) AS std_error FROM f, r
UNION ALL SELECT 'x', round(b, 6), round(sqrt(phi / (n * v)), 8) FROM f, r""")
def glm_gaussian(spark, sf):
    rows = _lines(spark, sf).withColumn("x", F.col("l_extendedprice") / 1000)
    found = glm.GLM(glm.Gaussian(), tol=1e-12).fit(rows, "l_quantity", ["x"]).summary()
    return spark.createDataFrame(found[["name", "estimate", "std_error"]].round({"estimate": 6, "std_error": 8}))


@add()
def glm_path(spark, sf):
    rows = _lines(spark, sf).withColumn("x", F.col("l_extendedprice") / 1000)
    return spark.createDataFrame(glm.glmnet_path(rows, "l_quantity", ["x", "l_discount", "l_tax"], [10.0, 1.0, 0.1], 0.5))


@add()
def glm_bootstrap(spark, sf):
    """100 refits of price on size over all parts; the operator takes arrays, so the table's two columns go to the driver."""
    rows = table(spark, sf, "part").select("p_size", "p_retailprice").orderBy("p_partkey").toPandas()
    import numpy as np

    x = np.column_stack([np.ones(len(rows)), rows["p_size"]])
    return glm.bootstrap(spark, x, rows["p_retailprice"].to_numpy(dtype=float), glm.Gaussian(), 100)
