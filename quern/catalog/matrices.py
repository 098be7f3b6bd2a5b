"""Queries over the matrix as a whole: metrics, filters, normalisation, variable genes, statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.catalog.base import BATCH, SEG, ctes, log_expr, n_cells, raw_expr, registry, rounded
from quern.functions import stats
from quern.functions.zeroagg import row_stats
from quern.operators import hvg, norm, qc
from quern.plans import surrogates
from quern.plans.scratch import materialize
from quern.session import table

QUERIES, SQL, add = registry()
M1, M2, M4 = ctes("m1"), ctes("m2"), ctes("m4")
CELLS = "c AS (SELECT cell, CAST(SUM(count) AS BIGINT) AS total_reads, COUNT(*) FILTER (count > 0) AS detected_genes FROM m GROUP BY cell)"
GENES = """g AS (SELECT gene, expressed, 100.0 * expressed / n AS expressed_perc
  FROM (SELECT gene, COUNT(*) FILTER (count > 0) AS expressed FROM m GROUP BY gene), (SELECT COUNT(DISTINCT cell) AS n FROM m))"""


def m(spark, sf, name="m1"):
    return surrogates.matrix(spark, sf, name)


@add(f"{M1}, {CELLS} SELECT * FROM c")
def qc_cell_metrics(spark, sf):
    return qc.cell_metrics(m(spark, sf))


@add(f"{M1}, {GENES} SELECT gene, expressed, round(expressed_perc, 6) AS expressed_perc FROM g")
def qc_gene_metrics(spark, sf):
    return rounded(qc.gene_metrics(m(spark, sf), None), "expressed_perc")


def kept(spark, sf):
    counts = m(spark, sf)
    return counts, qc.filter_cells(qc.cell_metrics(counts), 500), qc.filter_genes(qc.gene_metrics(counts, None), 20)


@add(f"""{M1}, {CELLS}, {GENES}
SELECT * FROM (SELECT COUNT(*) AS genes, COUNT(*) FILTER (expressed >= 20) AS genes_ok FROM g),
  (SELECT COUNT(*) AS cells, COUNT(*) FILTER (total_reads >= 500) AS cells_ok FROM c), (SELECT COUNT(*) AS entries FROM m)""")
def dataset_dims(spark, sf):
    return qc.dims(*kept(spark, sf))


@add(f"""{M1}, {CELLS} SELECT cell, total_reads, detected_genes,
  CASE WHEN total_reads >= 500 AND total_reads <= 2000 AND detected_genes >= 10 AND detected_genes <= 60 THEN 'OK' ELSE 'EXCLUDE' END AS status FROM c""")
def filter_cells(spark, sf):
    return qc.filter_cells(qc.cell_metrics(m(spark, sf)), 500, 2000, 10, 60)


@add(f"{M1}, {GENES} SELECT gene, expressed, CASE WHEN expressed < 20 THEN 'EXCLUDE' ELSE 'OK' END AS status FROM g")
def filter_genes_int(spark, sf):
    return qc.filter_genes(qc.gene_metrics(m(spark, sf), None), 20).select("gene", "expressed", "status")


@add(f"{M1}, {GENES} SELECT gene, expressed, CASE WHEN expressed_perc < 2.0 THEN 'EXCLUDE' ELSE 'OK' END AS status FROM g")
def filter_genes_pct(spark, sf):
    return qc.filter_genes(qc.gene_metrics(m(spark, sf), None), 2.0).select("gene", "expressed", "status")


def share_sql(pattern, out):
    return f"{M4} SELECT cell, round(100.0 * COALESCE(SUM(count) FILTER (regexp_matches(gene, '{pattern}')), 0) / SUM(count), 6) AS {out} FROM m GROUP BY cell"


@add(share_sql("(?i)^brand#1", "mito_perc"))
def mito_perc(spark, sf):
    counts = m(spark, sf, "m4")
    flagged = qc.find_mitochondrial(counts.select("gene").distinct(), "^brand#1")
    return rounded(qc.share_of(counts, flagged, "mitochondrial", "mito_perc"), "mito_perc")


@add(share_sql("^Brand#2[0-9]$", "ercc_perc"))
def ercc_perc(spark, sf):
    counts = m(spark, sf, "m4")
    return rounded(qc.share_of(counts, qc.find_ercc(counts.select("gene").distinct(), "^Brand#2[0-9]$"), "ercc", "ercc_perc"), "ercc_perc")


def features(spark, sf):
    counts = m(spark, sf, "m4")
    genes = qc.find_ercc(qc.find_mitochondrial(counts.select("gene").distinct(), "^brand#1"), "^Brand#2[0-9]$")
    return qc.quality_features(counts, qc.gene_set(genes, "^Brand#3", flag="rrna"))


@add(f"""{M4} SELECT cell, round(ln(SUM(count)), 6) AS log_reads, round(COUNT(*) / SUM(count), 6) AS detected_share,
  round(COALESCE(SUM(count) FILTER (gene LIKE 'Brand#3%'), 0) / SUM(count), 6) AS rrna_share,
  round(COALESCE(SUM(count) FILTER (gene LIKE 'Brand#1%'), 0) / SUM(count), 6) AS mito_share,
  round(COALESCE(SUM(count) FILTER (regexp_matches(gene, '^Brand#2[0-9]$')), 0) / SUM(count), 6) AS ercc_share
FROM m GROUP BY cell""")
def qc_features(spark, sf):
    return rounded(features(spark, sf), *qc.FEATURES)


@add(f"""{M1}, {CELLS}, l AS (SELECT *, log2(total_reads + 1) AS t, log2(detected_genes + 1) AS d FROM c),
md AS (SELECT median(t) AS mt, median(d) AS mg FROM l),
dv AS (SELECT 1.4826 * median(abs(t - mt)) AS dt, 1.4826 * median(abs(d - mg)) AS dg FROM l, md)
SELECT cell, total_reads, detected_genes, CASE WHEN t < mt - 3 * dt OR d < mg - 3 * dg THEN 'EXCLUDE' ELSE 'OK' END AS status FROM l, md, dv""")
def mad_outlier(spark, sf):
    return qc.mad_outlier(qc.cell_metrics(m(spark, sf)))


@add("""SELECT 'ENS0000' || p_partkey || '.' || p_size AS gene,
  CASE WHEN p_partkey % 3 = 0 THEN 'NA' ELSE p_brand END || '_ENS0000' || p_partkey AS new_gene FROM part""")
def symbol_switch(spark, sf):
    part = table(spark, sf, "part")
    bare = F.concat(F.lit("ENS0000"), F.col("p_partkey").cast("string"))
    genes = part.select(F.concat(bare, F.lit("."), F.col("p_size").cast("string")).alias("gene"))
    return qc.symbol_switch(genes, part.where("p_partkey % 3 <> 0").select(bare.alias("id"), F.col("p_brand").alias("symbol")))


@add(f"""{M1}, {CELLS}, {GENES} SELECT m.gene, m.cell, count FROM m JOIN c ON m.cell = c.cell JOIN g ON m.gene = g.gene
WHERE total_reads >= 500 AND expressed >= 20""")
def clean_matrix(spark, sf):
    return qc.clean_matrix(*kept(spark, sf)).select("gene", "cell", "count")


@add("SELECT gene, \"row\" FROM (SELECT o_custkey AS gene, o_orderkey AS \"row\", COUNT(*) OVER (PARTITION BY o_custkey) AS n FROM orders) WHERE n = 1")
def dedup_genes(spark, sf):
    return qc.dedup_genes(table(spark, sf, "orders").select(F.col("o_custkey").alias("gene"), F.col("o_orderkey").alias("row")))


# normalisation


@add(f"{M1} SELECT gene, cell, round(count / SUM(count) OVER (PARTITION BY cell) * 10000.0, 6) AS value FROM m")
def norm_standard(spark, sf):
    return rounded(norm.standard(m(spark, sf)), "value")


@add(f"{ctes('m1', True)} SELECT gene, cell, round(value, 6) AS value FROM e")
def norm_standard_log2(spark, sf):
    return rounded(log_expr(spark, sf, "m1"), "value")


@add(f"""{M1}, j AS (SELECT gene, cell, count, p_size * 100 AS length FROM m JOIN part ON gene = p_partkey)
SELECT gene, cell, round(count / (SUM(count) OVER (PARTITION BY cell) / 1e6) / (length / 1000.0), 6) AS value FROM j""")
def norm_rpkm(spark, sf):
    lengths = table(spark, sf, "part").select(F.col("p_partkey").alias("gene"), (F.col("p_size") * 100).alias("length"))
    return rounded(norm.rpkm(m(spark, sf), lengths), "value")


DENSE2 = """d AS (SELECT a.gene, b.cell, COALESCE(x.value, 0) AS value FROM (SELECT DISTINCT gene FROM m) a CROSS JOIN (SELECT DISTINCT cell FROM m) b
  LEFT JOIN e x ON x.gene = a.gene AND x.cell = b.cell)"""


def dense(spark, sf, name="m2"):
    expr = materialize(log_expr(spark, sf, name), "expr")
    return qc.densify(expr, expr.select("gene").distinct(), expr.select("cell").distinct())


@add(f"""{ctes('m2', True)}, {DENSE2}, r AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY value, gene) AS rnk FROM d),
a AS (SELECT rnk, avg(value) AS v FROM r GROUP BY rnk)
SELECT gene, cell, round(v, 6) AS value FROM r JOIN a ON r.rnk = a.rnk""")
def norm_fqn(spark, sf):
    return rounded(norm.fqn_dense(dense(spark, sf)), "value")


@add(f"""{M1}, n AS (SELECT COUNT(DISTINCT cell) AS n FROM m), s AS (SELECT gene, exp(SUM(ln(1 + count)) / n) AS g FROM m, n GROUP BY gene, n)
SELECT m.gene, cell, round(ln(1 + count / g), 6) AS value FROM m JOIN s ON m.gene = s.gene""")
def norm_clr_genes(spark, sf):
    counts = m(spark, sf)
    return rounded(norm.clr(counts, n_cells(counts)), "value")


@add(f"""{M1}, n AS (SELECT COUNT(DISTINCT gene) AS n FROM m), s AS (SELECT cell, exp(SUM(ln(1 + count)) / n) AS g FROM m, n GROUP BY cell, n)
SELECT gene, m.cell, round(ln(1 + count / g), 6) AS value FROM m JOIN s ON m.cell = s.cell""")
def norm_clr_cells(spark, sf):
    counts = m(spark, sf)
    return rounded(norm.clr(counts, counts.select("gene").distinct().count(), "cells"), "value")


@add(f"""{ctes('m2', True)}, {DENSE2}, s AS (SELECT gene, avg(value) AS m, stddev_pop(value) AS s FROM d GROUP BY gene)
SELECT d.gene, cell, round(CASE WHEN s > 1e-12 THEN (value - m) / s ELSE 0 END, 6) AS value FROM d JOIN s ON d.gene = s.gene""")
def zscore(spark, sf):
    return rounded(norm.zscore(dense(spark, sf), "gene"), "value").select("gene", "cell", "value")


@add(f"{M1}, n AS (SELECT COUNT(DISTINCT cell) AS n FROM m) SELECT gene, round(exp(SUM(ln(count + 1)) / n) - 1, 6) AS gmean FROM m, n GROUP BY gene, n")
def geometric_mean(spark, sf):
    expr = raw_expr(spark, sf, "m1")
    return rounded(stats.geometric_mean(expr, "gene", n_cells(expr)), "gmean")


@add(f"""{ctes('m2', True)}, {BATCH}, {DENSE2}, r AS (SELECT d.*, batch FROM d JOIN bat ON d.cell = bat.cell),
gb AS (SELECT gene, batch, avg(value) AS mb FROM r GROUP BY gene, batch),
gg AS (SELECT r.gene, avg(value) AS gm, avg((value - mb) * (value - mb)) AS vp FROM r JOIN gb ON r.gene = gb.gene AND r.batch = gb.batch GROUP BY r.gene),
ga AS (SELECT gb.gene, batch, gm, vp, (mb - gm) / sqrt(vp) AS gh FROM gb JOIN gg ON gb.gene = gg.gene WHERE vp > 1e-12),
pr AS (SELECT batch, avg(gh) AS gbar, var_pop(gh) AS t2 FROM ga GROUP BY batch),
gs AS (SELECT gene, ga.batch, gm, vp, (t2 * gh + gbar) / (t2 + 1) AS gstar FROM ga JOIN pr ON ga.batch = pr.batch)
SELECT r.gene, cell, round(((value - gm) / sqrt(vp) - gstar) * sqrt(vp) + gm, 6) AS value FROM r JOIN gs ON r.gene = gs.gene AND r.batch = gs.batch""")
def combat(spark, sf):
    return rounded(norm.combat(dense(spark, sf), surrogates.batches(spark, sf)), "value")


@add(f"""{ctes('m2', True)}, {DENSE2}, r AS (SELECT d.*, s_acctbal AS x FROM d JOIN supplier ON cell = s_suppkey),
f AS (SELECT gene, regr_slope(value, x) AS b, regr_intercept(value, x) AS a FROM r GROUP BY gene)
SELECT r.gene, cell, round(value - a - b * x, 6) AS value FROM r JOIN f ON r.gene = f.gene""")
def regress_one(spark, sf):
    design = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("cell"), "s_acctbal")
    return rounded(norm.regress_out(dense(spark, sf), design, ["s_acctbal"]), "value")


@add(f"""{ctes('m2', True)}, {BATCH}, {DENSE2}, r AS (SELECT d.*, batch FROM d JOIN bat ON d.cell = bat.cell)
SELECT gene, cell, round(value - avg(value) OVER (PARTITION BY gene, batch), 6) AS value FROM r""")
def regress_category(spark, sf):
    return rounded(norm.regress_out(dense(spark, sf), surrogates.batches(spark, sf), (), ["batch"]), "value")


# variable genes

STATS = """n AS (SELECT COUNT(DISTINCT cell)::DOUBLE AS n FROM m),
st AS (SELECT gene, SUM(value) / n AS mean, (COUNT(*) * var_pop(value) + COUNT(*) * (n - COUNT(*)) / n * avg(value) * avg(value)) / (n - 1) AS var, COUNT(*) AS nnz
  FROM e, n GROUP BY gene, n)"""


@add(f"""{ctes('m1', True)}, {STATS}, d AS (SELECT gene, mean, var / mean AS dispersion FROM st),
mm AS (SELECT min(mean) AS lo, max(mean) AS hi FROM d),
b AS (SELECT d.*, CAST(greatest(1, least(20, ceil((mean - lo) / ((hi - lo) / 20)))) AS INTEGER) AS bin FROM d, mm),
s AS (SELECT bin, avg(dispersion) AS m, stddev_samp(dispersion) AS s FROM b GROUP BY bin),
z AS (SELECT gene, mean, dispersion, b.bin, round((dispersion - m) / NULLIF(s, 0), 6) AS z FROM b JOIN s ON b.bin = s.bin)
SELECT gene, round(mean, 6) AS mean, round(dispersion, 6) AS dispersion, bin, z FROM z ORDER BY z DESC NULLS LAST, gene LIMIT 50""")
def hvg_seurat(spark, sf):
    expr = materialize(log_expr(spark, sf, "m1"), "expr")
    return rounded(hvg.seurat(expr, n_cells(expr), 50), "mean", "dispersion").select("gene", "mean", "dispersion", "bin", "z")


M1STD = ctes("m1") + ", e AS (SELECT gene, cell, count / SUM(count) OVER (PARTITION BY cell) * 10000.0 AS value FROM m)"


@add(f"""{M1STD}, n AS (SELECT COUNT(DISTINCT cell)::DOUBLE AS n FROM m),
a AS (SELECT gene, SUM(value) / n AS s, 1 - COUNT(*) / n AS p0, SUM(value * value) / n AS q, n FROM e, n GROUP BY gene, n),
b AS (SELECT gene, s, CASE WHEN p0 = 0 THEN (SELECT min(p0) FROM a WHERE p0 > 0) / 2 ELSE p0 END AS p, sqrt(p0 * (1 - p0) / n) AS pe, sqrt(greatest(0, q - s * s) / n) AS se FROM a),
c AS (SELECT *, p * s / (1 - p) AS kq, abs(p * s / (1 - p)) * sqrt(power(se / s, 2) + power(pe / p, 2)) AS ke FROM b),
d AS (SELECT *, ln(kq) AS l, CASE WHEN kq - ke > 0 THEN abs(ln(CASE WHEN kq - ke > 0 THEN kq - ke ELSE 1 END) - ln(kq)) ELSE 1e10 END AS err FROM c)
SELECT gene, round(s, 6) AS s, round(p, 6) AS p,
  round((l - ln(50)) / sqrt(err * err + power(stddev_pop(l - ln(50)) OVER () / sqrt(COUNT(*) OVER ()), 2)), 6) AS z FROM d""")
def hvg_mm_dropout(spark, sf):
    expr = materialize(norm.standard(m(spark, sf)), "expr")
    return rounded(hvg.mm_z(hvg.dropout_points(expr, n_cells(expr)), 50.0).drop("always"), "s", "p", "z")


POINTS = "pt AS (SELECT gene, log10(mean) AS x, log10(sqrt(var) / mean) AS y FROM st WHERE mean > 0 AND var > 0)"


def points(spark, sf):
    expr = materialize(norm.standard(m(spark, sf)), "expr")
    return hvg.log_cv(row_stats(expr, "gene", n_cells(expr)))


@add(f"{M1STD}, {STATS}, {POINTS} SELECT round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept, COUNT(*) AS n FROM pt")
def hvg_chen_cv_fit(spark, sf):
    return rounded(hvg.cv_fit(points(spark, sf)), "slope", "intercept")


@add(f"""{M1STD}, {STATS}, {POINTS}, en AS (SELECT min(x) AS lo, max(x) AS hi FROM pt),
gr AS (SELECT unnest(range(0, CAST(floor((hi - lo) / 0.005 + 1e-9) AS BIGINT) + 1)) AS g, lo FROM en)
SELECT g, COUNT(*) AS n FROM gr JOIN pt ON (x - 0.05 - lo) / 0.005 - 1e-9 <= g AND (x + 0.05 - lo) / 0.005 + 1e-9 >= g GROUP BY g""")
def hvg_chen_window_counts(spark, sf):
    return hvg.window_counts(points(spark, sf))


@add(f"""{M1STD}, {STATS}, t AS (SELECT 0.1 + 0.25 + 0.1 * 0.25 AS th)
SELECT gene, round(mean, 6) AS mean, round(var / (mean * mean), 6) AS cv2,
  round(var * (n - 1) / ((mean * 0.5 + mean * mean * th) / (1 + th / n)), 6) AS chi2 FROM st, n, t WHERE mean > 0""")
def hvg_brennecke_cv2(spark, sf):
    expr = materialize(norm.standard(m(spark, sf)), "expr")
    n = n_cells(expr)
    return rounded(hvg.brennecke_stat(row_stats(expr, "gene", n), n, 0.1, 0.5), "mean", "cv2", "chi2")


# statistics


@add(f"""{M1}, {SEG}, {CELLS}, j AS (SELECT cluster, total_reads::DOUBLE AS v FROM c JOIN seg ON c.cell = seg.cell)
SELECT cluster, round(1.06 * least(stddev_pop(v), (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) / 1.34) * power(COUNT(*), -0.2), 6) AS bw FROM j GROUP BY cluster""")
def bw_nrd(spark, sf):
    cells = qc.cell_metrics(m(spark, sf)).join(surrogates.segments(spark, sf), "cell")
    return rounded(stats.bw_nrd(cells.withColumn("v", F.col("total_reads").cast("double")), "v", ["cluster"]), "bw")



@add("""WITH e AS (SELECT min(c_custkey)::DOUBLE AS lo, (max(c_custkey) - min(c_custkey)) / 50.0 AS w FROM customer),
b AS (SELECT c_custkey, c_acctbal AS y, floor((c_custkey - lo) / w) AS b1, floor((c_custkey - lo + w / 2) / w) AS b2 FROM customer, e),
m AS (SELECT *, y - median(y) OVER (PARTITION BY b1) AS d1, y - median(y) OVER (PARTITION BY b2) AS d2 FROM b),
s AS (SELECT *, d1 / (1.4826 * median(abs(d1)) OVER (PARTITION BY b1) + 1e-9) AS s1, d2 / (1.4826 * median(abs(d2)) OVER (PARTITION BY b2) + 1e-9) AS s2 FROM m)
SELECT c_custkey, round(least(abs(s1), abs(s2)), 6) AS score, least(abs(s1), abs(s2)) > 1.2 AS outlier FROM s""")
def outlier_binned(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", "c_acctbal", F.col("c_custkey").cast("double").alias("x"))
    return rounded(stats.is_outlier(rows, "c_acctbal", "x", 1.2), "score").select("c_custkey", "score", "outlier")


PVALS = "p AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 17 <> 0 THEN CAST(floor(abs(c_acctbal)) AS BIGINT) % 1000 / 1000.0 END AS p_val FROM customer)"


def pvalues(spark, sf):
    p = F.when(F.col("c_custkey") % 17 != 0, (F.floor(F.abs("c_acctbal")) % 1000) / 1000.0)
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), p.alias("p_val"))


@add(f"""WITH {PVALS}, r AS (SELECT *, (SELECT COUNT(*) FROM p) * p_val / row_number() OVER (ORDER BY p_val, id) AS q FROM p WHERE p_val IS NOT NULL),
b AS (SELECT id, p_val, least(1.0, min(q) OVER (ORDER BY p_val DESC, id DESC ROWS UNBOUNDED PRECEDING)) AS fdr FROM r)
SELECT id, p_val::DOUBLE AS p_val, round(fdr, 6)::DOUBLE AS fdr FROM b UNION ALL SELECT id, NULL, NULL FROM p WHERE p_val IS NULL""")
def bh_adjust(spark, sf):
    return rounded(stats.bh_adjust(pvalues(spark, sf)), "fdr")


@add(f"WITH {PVALS} SELECT id, p_val::DOUBLE AS p_val, CASE WHEN p_val IS NULL THEN NULL ELSE round(least(1.0, p_val * (SELECT COUNT(*) FROM p)), 6) END::DOUBLE AS fdr FROM p")
def bonferroni(spark, sf):
    return rounded(stats.bonferroni(pvalues(spark, sf)), "fdr")
