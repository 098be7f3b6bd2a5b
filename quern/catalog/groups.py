"""Queries over groups of cells: differential expression, cell types, deconvolution, charts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quern.catalog.base import BATCH, SEG, ctes, log_expr, raw_expr, registry, rounded
from quern.operators import bio, bulk, de, qc, reduce, views
from quern.plans import surrogates
from quern.plans.scratch import materialize, shared_dir
from quern.session import table
from quern.sources import matrices as files

QUERIES, SQL, add = registry()
E4 = ctes("m4", True)

MOMENTS = f"""{SEG}, sz AS (SELECT cluster, COUNT(*) AS n FROM seg GROUP BY cluster HAVING COUNT(*) >= 10),
sm AS (SELECT gene, cluster, SUM(value) AS s, SUM(value * value) AS q FROM e JOIN seg ON e.cell = seg.cell GROUP BY gene, cluster),
mo AS (SELECT g.gene, sz.cluster, n, COALESCE(s, 0) AS s, COALESCE(q, 0) AS q FROM (SELECT DISTINCT gene FROM sm) g CROSS JOIN sz
  LEFT JOIN sm ON sm.gene = g.gene AND sm.cluster = sz.cluster)"""
LINEAR = f"""{E4}, {MOMENTS}, ev AS (SELECT gene, SUM(q - s * s / n) / (SUM(n) - COUNT(*)) AS s2, (SUM(n) - COUNT(*))::BIGINT AS df FROM mo GROUP BY gene),
lt AS (SELECT a.gene, a.cluster AS a, b.cluster AS b, a.s / a.n AS mean_a, b.s / b.n AS mean_b, a.s / a.n - b.s / b.n AS logfc,
  (a.s / a.n - b.s / b.n) / NULLIF(sqrt(s2 * (1.0 / a.n + 1.0 / b.n)), 0) AS t_stat, df
  FROM mo a JOIN mo b ON a.gene = b.gene AND a.cluster > b.cluster JOIN ev ON ev.gene = a.gene)"""


def linear(spark, sf, expr=None):
    return de.linear_model_stats(de.cluster_moments(log_expr(spark, sf, "m4") if expr is None else expr, surrogates.segments(spark, sf)))


@add(f"{LINEAR} SELECT gene, a, b, round(t_stat, 6) AS t_stat, round(logfc, 6) AS logfc, round(mean_a, 6) AS mean_a, round(mean_b, 6) AS mean_b, df FROM lt")
def de_linear_t(spark, sf):
    return rounded(linear(spark, sf), "t_stat", "logfc", "mean_a", "mean_b")


@add(f"""{ctes('m4')}, {SEG}, g AS (SELECT DISTINCT gene FROM m), x AS (SELECT g.gene, seg.cluster, COALESCE(count, 0)::DOUBLE AS v
  FROM g CROSS JOIN seg LEFT JOIN m ON m.gene = g.gene AND m.cell = seg.cell),
pr AS (SELECT DISTINCT a.cluster AS c1, b.cluster AS c2 FROM seg a, (SELECT DISTINCT cluster FROM seg) b WHERE a.cluster < b.cluster),
u AS (SELECT gene, c1, c2, cluster, v FROM x JOIN pr ON cluster = c1 OR cluster = c2),
r AS (SELECT *, rank() OVER (PARTITION BY gene, c1, c2 ORDER BY v) + (COUNT(*) OVER (PARTITION BY gene, c1, c2, v) - 1) / 2.0 AS rk,
  COUNT(*) OVER (PARTITION BY gene, c1, c2, v) AS t FROM u),
s AS (SELECT gene, c1, c2, COUNT(*) FILTER (cluster = c1) AS n1, COUNT(*) FILTER (cluster = c2) AS n2, SUM(rk) FILTER (cluster = c1) AS r1,
  SUM(t::DOUBLE * t - 1) AS tie FROM r GROUP BY gene, c1, c2),
w AS (SELECT *, r1 - n1 * (n1 + 1) / 2.0 AS u, sqrt(n1 * n2 / 12.0 * ((n1 + n2 + 1) - tie / ((n1 + n2)::DOUBLE * (n1 + n2 - 1)))) AS sd FROM s)
SELECT gene, c1, c2, n1, n2, u::DOUBLE AS u, round((abs(u - n1 * n2 / 2.0) - 0.5) / sd, 6) AS z FROM w""")
def de_wilcoxon_u(spark, sf):
    return rounded(de.wilcoxon_stats(materialize(raw_expr(spark, sf, "m4"), "expr"), surrogates.segments(spark, sf)), "z")


# a p-value that both engines compute: a logistic curve of t in both directions of each pair
TESTS = f"""{LINEAR}, te AS (SELECT gene, a, round(1 / (1 + exp(1.7 * t_stat)), 6) AS p_val FROM lt
  UNION ALL SELECT gene, b AS a, round(1 / (1 + exp(-1.7 * t_stat)), 6) AS p_val FROM lt)"""


def tests(spark, sf, expr=None):
    one = materialize(linear(spark, sf, expr), "linear")
    p = lambda t: F.round(1 / (1 + F.exp(1.7 * t)), 6).alias("p_val")
    return one.select("gene", "a", p(F.col("t_stat"))).unionByName(one.select("gene", F.col("b").alias("a"), p(-F.col("t_stat"))))


SIMES = """k AS (SELECT *, COUNT(*) OVER (PARTITION BY gene, a) AS k, rank() OVER (PARTITION BY gene, a ORDER BY p_val) + (COUNT(*) OVER (PARTITION BY gene, a, p_val) - 1) / 2.0 AS rk FROM te),
si AS (SELECT a AS cluster, gene, least(1.0, min(k * p_val / rk)) AS p_val FROM k GROUP BY a, gene)"""


@add(f"{TESTS}, {SIMES} SELECT cluster, gene, round(p_val, 6) AS p_val FROM si")
def de_simes(spark, sf):
    return rounded(de.simes(tests(spark, sf)), "p_val")


@add(f"""{TESTS}, h AS (SELECT a AS cluster, gene, -SUM(ln(greatest(p_val, 1e-300))) AS h, COUNT(*) AS k FROM te GROUP BY a, gene)
SELECT cluster, gene, round(least(1.0, exp(-h) * list_sum(list_transform(range(0, k), lambda i: power(h, i) / gamma(i + 1)))), 6) AS p_val FROM h""")
def de_fisher(spark, sf):
    return rounded(de.fisher(tests(spark, sf)), "p_val")


COMBINED = f"""{TESTS}, {SIMES}, bq AS (SELECT *, (SELECT COUNT(*) FROM si) * p_val / row_number() OVER (ORDER BY p_val, cluster, gene) AS q FROM si),
co AS (SELECT cluster, gene, p_val, least(1.0, min(q) OVER (ORDER BY p_val DESC, cluster DESC, gene DESC ROWS UNBOUNDED PRECEDING)) AS mtc_p FROM bq),
fo AS (SELECT gene, cluster, COUNT(*) AS r FROM e JOIN seg ON e.cell = seg.cell WHERE value > 0 GROUP BY gene, cluster),
fi AS (SELECT co.cluster, co.gene, p_val, mtc_p, round(100.0 * r / n, 2) AS perc_cells
  FROM co JOIN fo ON co.gene = fo.gene AND co.cluster = fo.cluster JOIN (SELECT cluster, COUNT(*) AS n FROM seg GROUP BY cluster) z ON z.cluster = co.cluster
  WHERE mtc_p < 0.999 AND r > 0.7 * n)"""


def filtered(spark, sf):
    """The star schema's quantities are noise, so only wide bounds leave rows."""
    expr = materialize(log_expr(spark, sf, "m4"), "expr")
    combined = de.combine_tests(tests(spark, sf, expr), "simes")
    return de.filter_tests(combined, expr, surrogates.segments(spark, sf), 0.999, 0.7)


@add(f"{COMBINED} SELECT cluster, gene, round(p_val, 6) AS p_val, round(mtc_p, 6) AS mtc_p, perc_cells::DOUBLE AS perc_cells FROM fi")
def de_filter(spark, sf):
    return rounded(filtered(spark, sf), "p_val", "mtc_p")


@add(f"{COMBINED} SELECT gene, COUNT(DISTINCT cluster) AS n_clusters, string_agg(DISTINCT cluster, ' ' ORDER BY cluster) AS clusters FROM fi GROUP BY gene")
def de_summary(spark, sf):
    return de.summary(filtered(spark, sf))


# scores and cell types

E3 = ctes("m3", True)


@add(f"""{E3}, n AS (SELECT COUNT(DISTINCT cell)::DOUBLE AS n FROM m), me AS (SELECT gene, SUM(value) / n AS mean FROM e, n GROUP BY gene, n),
ed AS (SELECT list_distinct(quantile_cont(mean, [0.2, 0.4, 0.6, 0.8])) AS ed FROM me),
bi AS (SELECT gene, len(list_filter(ed, lambda x: x < mean)) AS bin FROM me, ed),
pa AS (SELECT t.gene AS target, c.gene, row_number() OVER (PARTITION BY t.gene ORDER BY md5('42:' || t.gene || ':' || c.gene), c.gene) AS o
  FROM bi t JOIN bi c ON t.bin = c.bin WHERE t.gene LIKE '%anvil%'),
dr AS (SELECT *, COUNT(*) OVER (PARTITION BY target) AS k FROM pa WHERE o <= 5), nt AS (SELECT COUNT(*) AS nt FROM bi WHERE gene LIKE '%anvil%'),
w AS (SELECT gene, SUM(w) AS w FROM (SELECT gene, -1.0 / k / nt AS w FROM dr, nt UNION ALL SELECT gene, 1.0 / nt FROM bi, nt WHERE gene LIKE '%anvil%') GROUP BY gene),
sc AS (SELECT cell, SUM(w * value) AS score FROM e JOIN w ON e.gene = w.gene GROUP BY cell)
SELECT c.cell, round(COALESCE(score, 0), 6) AS score FROM (SELECT DISTINCT cell FROM e) c LEFT JOIN sc ON c.cell = sc.cell""")
def genes2scores(spark, sf):
    expr = materialize(log_expr(spark, sf, "m3"), "expr")
    targets = expr.select("gene").distinct().where("gene LIKE '%anvil%'")
    n = expr.select("cell").distinct().count()
    return rounded(reduce.genes2scores(expr, targets, n, bins=5, ctrl=5), "score")


@add(f"""{ctes('m4')}, {SEG}, x AS (SELECT g.gene, seg.cluster, COALESCE(count, 0)::DOUBLE AS v FROM (SELECT DISTINCT gene FROM m) g CROSS JOIN seg
  LEFT JOIN m ON m.gene = g.gene AND m.cell = seg.cell)
SELECT gene, cluster, median(v) AS median FROM x GROUP BY gene, cluster""")
def median_expr(spark, sf):
    return bio.median_expression(raw_expr(spark, sf, "m4"), surrogates.segments(spark, sf))


MARKERS = """mk AS (SELECT DISTINCT p_name AS gene, split_part(p_name, ' ', 1) AS cell_type FROM part
  UNION ALL SELECT DISTINCT p_name, split_part(p_name, ' ', 2) FROM part WHERE split_part(p_name, ' ', 2) IN ('anvil', 'bolt', 'gear'))"""
SCORED = f"""{E3}, {BATCH}, {MARKERS}, szb AS (SELECT batch AS cluster, COUNT(*) AS n FROM bat GROUP BY batch),
xm AS (SELECT g.gene, bat.batch AS cluster, COALESCE(value, 0) AS v FROM (SELECT DISTINCT gene FROM m) g CROSS JOIN bat LEFT JOIN e ON e.gene = g.gene AND e.cell = bat.cell),
md AS (SELECT gene, cluster, median(v) AS median FROM xm GROUP BY gene, cluster),
sc AS (SELECT gene, cluster, median, (median - avg(median) OVER (PARTITION BY cluster)) / stddev_pop(median) OVER (PARTITION BY cluster) AS z FROM md),
fq AS (SELECT gene, COUNT(*) AS f FROM mk GROUP BY gene), ww AS (SELECT gene, 1 + sqrt(COALESCE((hi - f) / NULLIF(hi - lo, 0)::DOUBLE, 0)) AS weight FROM fq, (SELECT max(f) AS hi, min(f) AS lo FROM fq))"""


def markers(spark, sf):
    part = table(spark, sf, "part").select("p_name").distinct()
    word = lambda i: F.split("p_name", " ")[i].alias("cell_type")
    one = part.select(F.col("p_name").alias("gene"), word(0))
    return one.unionByName(part.select(F.col("p_name").alias("gene"), word(1)).where(F.col("cell_type").isin("anvil", "bolt", "gear")))


def scored(spark, sf):
    clusters = surrogates.batches(spark, sf).withColumnRenamed("batch", "cluster")
    return bio.cluster_zscores(bio.median_expression(materialize(log_expr(spark, sf, "m3"), "expr"), clusters, 1))


@add(f"{SCORED} SELECT gene, round(weight, 6) AS weight FROM ww")
def marker_weights(spark, sf):
    return rounded(bio.marker_weights(markers(spark, sf)), "weight")


@add(f"""{SCORED} SELECT sc.cluster, cell_type, round(SUM(z * weight) / power(COUNT(*), 0.3), 6) AS activity, COUNT(*) AS n
FROM sc JOIN mk ON sc.gene = mk.gene JOIN ww ON ww.gene = mk.gene GROUP BY sc.cluster, cell_type""")
def celltype_activity(spark, sf):
    return rounded(bio.activity(scored(spark, sf), markers(spark, sf)), "activity")


@add(f"""{SCORED}, ev AS (SELECT cluster, COUNT(*) FILTER (median > 0) AS e, COUNT(*) FILTER (NOT median > 0) AS ne FROM sc GROUP BY cluster),
se AS (SELECT cluster, cell_type, COUNT(*) FILTER (median > 0) AS a, COUNT(*) FILTER (NOT median > 0) AS b FROM sc JOIN mk ON sc.gene = mk.gene GROUP BY cluster, cell_type)
SELECT se.cluster, cell_type, a, b, e - a AS c, ne - b AS d FROM se JOIN ev ON se.cluster = ev.cluster""")
def celltype_contingency(spark, sf):
    return bio.contingency(scored(spark, sf), markers(spark, sf))


# deconvolution

CELLMAP = "cm AS (SELECT c_custkey AS cell, c_mktsegment AS ct, c_nationkey AS sample FROM customer)"
SUMS = f"{ctes('m4')}, {CELLMAP}, su AS (SELECT gene, ct, sample, SUM(count)::DOUBLE AS s, SUM(count::DOUBLE * count) AS q FROM m JOIN cm ON m.cell = cm.cell GROUP BY gene, ct, sample)"
SHARES = SUMS + ", sh AS (SELECT gene, ct, sample, s / SUM(s) OVER (PARTITION BY ct, sample) AS share FROM su)"
LIBS = "nn AS (SELECT ct, sample, COUNT(*) AS n FROM cm GROUP BY ct, sample), li AS (SELECT ct, avg(t / n) AS lib FROM (SELECT ct, sample, SUM(s) AS t FROM su GROUP BY ct, sample) x JOIN nn USING (ct, sample) GROUP BY ct)"


def cellmap(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("cell"), F.col("c_mktsegment").alias("ct"), F.col("c_nationkey").alias("sample"))


def sums(spark, sf):
    return materialize(bulk.group_sums(surrogates.matrix(spark, sf, "m4"), cellmap(spark, sf)), "sums")


@add(f"{SHARES} SELECT gene, ct, sample, round(share, 9) AS share FROM sh")
def deconv_mean_mat(spark, sf):
    return rounded(bulk.mean_matrix(sums(spark, sf)), "share", places=9)


@add(f"{SHARES}, {LIBS} SELECT gene, ct, round(SUM(share) / k * lib, 6) AS basis FROM sh JOIN (SELECT ct, COUNT(DISTINCT sample) AS k FROM sh GROUP BY ct) USING (ct) JOIN li USING (ct) GROUP BY gene, ct, k, lib")
def deconv_basis(spark, sf):
    s = sums(spark, sf)
    return rounded(bulk.basis(bulk.mean_matrix(s), bulk.library_sizes(s, cellmap(spark, sf))), "basis")


VADJ = f"""{SUMS}, {LIBS}, tp AS (SELECT gene, sample, max((q - s * s / n) / (n - 1)) AS v FROM su JOIN nn USING (ct, sample) WHERE n > 1 GROUP BY gene, sample),
ra AS (SELECT gene, sample, v / NULLIF(m, 0) AS v FROM tp JOIN (SELECT sample, median(v) AS m FROM tp GROUP BY sample) USING (sample)),
en AS (SELECT sample, quantile_cont(v, 0.15) AS lo, quantile_cont(v, 0.85) AS hi FROM ra GROUP BY sample),
va AS (SELECT gene, sample, greatest(lo, least(hi, v)) AS v FROM ra JOIN en USING (sample))"""


@add(f"{VADJ} SELECT gene, sample, round(v, 6) AS v FROM va")
def deconv_var_adj(spark, sf):
    return rounded(bulk.variance_adjustment(sums(spark, sf), cellmap(spark, sf)), "v")


@add(f"""{VADJ}, ws AS (SELECT gene, ct, sample, COALESCE(s / sqrt(NULLIF(v, 0)), 0) AS w FROM su JOIN va USING (gene, sample))
SELECT gene, ct, sample, round(COALESCE(w / NULLIF(SUM(w) OVER (PARTITION BY ct, sample), 0), 0), 9) AS share FROM ws""")
def deconv_mvw(spark, sf):
    s = sums(spark, sf)
    return rounded(bulk.weighted_shares(s, bulk.variance_adjustment(s, cellmap(spark, sf))), "share", places=9)


# charts and exports


@add(f"{E4}, {SEG}, z AS (SELECT cluster, COUNT(*) AS n FROM seg GROUP BY cluster) SELECT gene, cluster, round(SUM(value) / n, 6) AS mean FROM e JOIN seg ON e.cell = seg.cell JOIN z USING (cluster) GROUP BY gene, cluster, n")
def cluster_means(spark, sf):
    return rounded(views.cluster_means(log_expr(spark, sf, "m4"), surrogates.segments(spark, sf)), "mean")


@add("SELECT c_mktsegment AS cluster, COUNT(*) AS n FROM customer GROUP BY 1")
def cluster_sizes(spark, sf):
    return de.cluster_sizes(surrogates.segments(spark, sf))


TOP = f"""{E4}, {SEG}, z AS (SELECT cluster, COUNT(*) AS n FROM seg GROUP BY cluster),
me AS (SELECT gene, cluster, SUM(value) / n AS score FROM e JOIN seg ON e.cell = seg.cell JOIN z USING (cluster) GROUP BY gene, cluster, n),
tg AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY round(score, 9) DESC, gene) AS rank FROM me)"""


@add(f"{TOP} SELECT tg.cluster, rank::INTEGER AS rank, e.gene, e.cell, round(value, 6) AS value FROM e JOIN seg ON e.cell = seg.cell JOIN tg ON tg.cluster = seg.cluster AND tg.gene = e.gene WHERE rank <= 3")
def top_genes_violin(spark, sf):
    return rounded(views.violin(log_expr(spark, sf, "m4"), surrogates.segments(spark, sf), 3), "value")


@add(f"{ctes('m4')}, {SEG} SELECT cluster, seg.cell, COUNT(gene) AS genes FROM seg LEFT JOIN m ON m.cell = seg.cell GROUP BY cluster, seg.cell")
def exp_genes(spark, sf):
    return views.expressed_genes(surrogates.matrix(spark, sf, "m4"), surrogates.segments(spark, sf))


READS = f"{ctes('m1')}, c AS (SELECT cell, SUM(count)::DOUBLE AS t FROM m GROUP BY cell)"


def reads(spark, sf):
    return qc.cell_metrics(surrogates.matrix(spark, sf, "m1"))


@add(f"""{READS}, x AS (SELECT min(t) AS lo, (max(t) - min(t)) / 50 AS w FROM c), b AS (SELECT CAST(least(49, floor((t - lo) / w)) AS INTEGER) AS bin, lo, w FROM c, x)
SELECT bin, round(lo + bin * w, 6) AS low, COUNT(*) AS n FROM b GROUP BY bin, lo, w""")
def hist_reads(spark, sf):
    return rounded(views.histogram(reads(spark, sf), "total_reads", 50), "low")


@add(f"{READS} SELECT COUNT(*) FILTER (t > 1000) AS above, COUNT(*) FILTER (t <= 1000) AS below FROM c")
def reads_cutoff(spark, sf):
    return views.cutoff(reads(spark, sf), "total_reads", 1000)


@add(f"{READS}, {SEG} SELECT cluster, quantile_cont(t, 0.0) AS low, quantile_cont(t, 0.25) AS q1, quantile_cont(t, 0.5) AS median, quantile_cont(t, 0.75) AS q3, quantile_cont(t, 1.0) AS high FROM c JOIN seg USING (cell) GROUP BY cluster")
def box_reads(spark, sf):
    return views.quantiles(reads(spark, sf).join(surrogates.segments(spark, sf), "cell"), "total_reads", ["cluster"])


@add(f"{ctes('m1')} SELECT cell, SUM(count)::BIGINT AS total_reads, COUNT(*) AS detected_genes, SUM(count) < 500 AS removed FROM m GROUP BY cell")
def overall_scatter(spark, sf):
    return views.overall_scatter(qc.filter_cells(reads(spark, sf), 500))


@add(f"{ctes('m2')} SELECT gene, CAST(cell AS VARCHAR) AS cell, count FROM m")
def io_text_roundtrip(spark, sf):
    """The dense matrix exported as wide text, genes x cells, and read again."""
    path = f"{shared_dir(spark)}/quern/export-{uuid.uuid4().hex}"
    files.export_normalised(raw_expr(spark, sf, "m2").withColumn("cell", F.col("cell").cast("string")), path, sep=",", compression="gzip")
    return files.read_text(spark, path, do_round=False, sep=",")
