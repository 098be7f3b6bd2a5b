"""The small matrix whose results were worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from quern.functions import stats
from quern.functions.zeroagg import average_ranks, group_median, row_stats
from quern.operators import de, hvg, norm, qc

CELLS = ("1", "2", "3")
MATRIX = {"a": (4, 0, 6), "b": (0, 2, 2), "c": (5, 3, 0), "d": (1, 5, 2)}


@pytest.fixture(scope="module")
def counts(spark):
    rows = [(g, c, v) for g, vs in MATRIX.items() for c, v in zip(CELLS, vs) if v]
    return spark.createDataFrame(rows, "gene string, cell string, count long")


def wide(df):
    out = {g: [0.0] * 3 for g in MATRIX}
    for r in df.collect():
        out[r.gene][CELLS.index(r.cell)] = round(r.value, 6)
    return out


def close(got, want):
    assert all(abs(a - b) < 1e-5 for g in want for a, b in zip(got[g], want[g])), got


def test_metrics_and_filters(counts):
    assert {tuple(r) for r in qc.cell_metrics(counts).collect()} == {(c, 10, 3) for c in CELLS}
    genes = qc.gene_metrics(counts, None)
    assert {r.gene: r.expressed for r in genes.collect()} == {"a": 2, "b": 2, "c": 2, "d": 3}
    assert {r.gene for r in qc.filter_genes(genes, 3).where("status = 'OK'").collect()} == {"d"}
    assert {r.gene for r in qc.filter_genes(genes, 80.0).where("status = 'OK'").collect()} == {"d"}
    assert qc.filter_genes(genes, None).where("status = 'OK'").count() == 4
    assert qc.filter_cells(qc.cell_metrics(counts), 0, 10, 3, 3).where("status = 'OK'").count() == 3
    assert qc.filter_cells(qc.cell_metrics(counts), 11).where("status = 'OK'").count() == 0


def test_normalisations(spark, counts):
    std = norm.standard(counts)
    close(wide(std), {"a": (4000, 0, 6000), "b": (0, 2000, 2000), "c": (5000, 3000, 0), "d": (1000, 5000, 2000)})
    close(
        wide(norm.log_transform(std)),
        {"a": (11.966145, 0, 12.550987), "b": (0, 10.966505, 10.966505), "c": (12.288001, 11.551228, 0), "d": (9.967226, 12.288001, 10.966505)},
    )
    close(
        wide(norm.clr(counts, 3)),
        {"a": (0.798787, 0, 1.041782), "b": (0, 0.673709, 0.673709), "c": (1.005547, 0.712970, 0), "d": (0.264557, 0.921981, 0.473564)},
    )
    want = {"a": (3, 0, 5.333333), "b": (0, 1.666667, 1.666667), "c": (5.333333, 3, 0), "d": (1.666667, 5.333333, 3)}
    close(wide(norm.fqn(counts, 4, 3)), want)
    dense = qc.densify(counts.withColumnRenamed("count", "value"), counts.select("gene").distinct(), counts.select("cell").distinct())
    close(wide(norm.fqn_dense(dense)), want)
    lengths = spark.createDataFrame([("a", 1000), ("b", 2000), ("c", 500), ("d", 4000)], "gene string, length long")
    close(wide(norm.rpkm(counts, lengths)), {"a": (400000, 0, 600000), "b": (0, 100000, 100000), "c": (1000000, 600000, 0), "d": (25000, 125000, 50000)})
    expr = counts.withColumnRenamed("count", "value")
    got = {r.gene: round(r.gmean, 6) for r in stats.geometric_mean(expr, "gene", 3).collect()}
    assert got == {"a": 2.271066, "b": 1.080084, "c": 1.884499, "d": 2.301927}
    for method in ("standard", "clr", "fqn"):
        values, spikes = norm.normalise(counts, method, spikes=spark.createDataFrame([("d",)], "gene string"))
        assert values.count() == 6 and spikes.count() == 3
    with pytest.raises(ValueError):
        norm.normalise(counts, "other")


def test_zero_aware_aggregates(spark, counts):
    expr = counts.select("gene", "cell", F.col("count").cast("double").alias("value"))
    import statistics

    for r in row_stats(expr, "gene", 3).collect():
        assert abs(r.mean - statistics.mean(MATRIX[r.gene])) < 1e-12 and abs(r["var"] - statistics.variance(MATRIX[r.gene])) < 1e-12
    sizes = spark.createDataFrame([("k", 3)], "cluster string, n long")
    got = {r.gene: r["median"] for r in group_median(expr.withColumn("cluster", F.lit("k")), ["gene", "cluster"], sizes, ["cluster"]).collect()}
    assert got == {g: statistics.median(v) for g, v in MATRIX.items()}
    ranks = average_ranks(spark.createDataFrame([(x,) for x in (0, 0, 1, 3, 3, 3)], "x int").withColumn("k", F.lit(1)), ["k"], "x")
    assert sorted(r["rank"] for r in ranks.collect()) == [1.5, 1.5, 3, 5, 5, 5]


def test_multiple_testing(spark):
    p = spark.createDataFrame([("x", "g", v) for v in (0.01, 0.04, 0.03, 0.5)], "a string, gene string, p_val double")
    assert abs(de.fisher(p).first().p_val - 0.0022501350691) < 1e-10
    assert abs(de.simes(p).first().p_val - 0.04) < 1e-12
    got = {r.p_val: r.fdr for r in stats.bh_adjust(p).collect()}
    want = {0.01: 0.04, 0.04: 0.0533333, 0.03: 0.0533333, 0.5: 0.5}
    assert all(abs(got[k] - v) < 1e-6 for k, v in want.items())
    many = spark.createDataFrame([(i, (i * 37 % 501) / 1000) for i in range(2000)] + [(i, None) for i in range(2000, 2100)], "id int, p_val double")
    rows = sorted((r.p_val, r.id) for r in many.where("p_val is not null").collect())
    low, brute = 1.0, {}
    for rank in range(len(rows), 0, -1):
        low = min(low, 2100 * rows[rank - 1][0] / rank)
        brute[rows[rank - 1][1]] = low
    got = {r.id: r.fdr for r in stats.bh_adjust(many, ranges=7).collect()}
    assert all(abs(got[i] - q) < 1e-12 for i, q in brute.items()) and all(got[i] is None for i in range(2000, 2100))
    alone = {r.id: r.fdr for r in stats.bh_adjust(many.withColumn("k", F.lit(1)), by=["k"]).collect()}
    assert all(abs(alone[i] - q) < 1e-12 for i, q in brute.items())


def test_wilcoxon_against_pairs(spark):
    a, b = [0, 0, 3, 5, 9, 1], [0, 2, 2, 0, 1]
    expr = spark.createDataFrame([("g", f"a{i}", float(v)) for i, v in enumerate(a) if v] + [("g", f"b{i}", float(v)) for i, v in enumerate(b) if v], "gene string, cell string, value double")
    clusters = spark.createDataFrame([(f"a{i}", "a") for i in range(6)] + [(f"b{i}", "b") for i in range(5)], "cell string, cluster string")
    row = de.wilcoxon_stats(expr, clusters, 1).first()
    assert row.u == sum((x > y) + (x == y) / 2 for x in a for y in b)
    both = {r.comparison: r.p_val for r in de.wilcoxon(expr, clusters, 1).collect()}
    assert len(both) == 2 and len(set(both.values())) == 1
    up = {r.comparison: r.p_val for r in de.wilcoxon(expr, clusters, 1, "greater").collect()}
    assert up["a_vs_b"] < 0.5 < up["b_vs_a"]


def test_michaelis_constant(spark):
    k = 7.0
    rows = [(f"g{i}", s, 1 - s / (k + s), False, 0.01, 0.01) for i, s in enumerate((0.5, 1.0, 2.0, 5.0, 20.0, 60.0))]
    points = spark.createDataFrame(rows, "gene string, s double, p double, always boolean, p_err double, s_err double")
    assert abs(hvg.michaelis_constant(points) - k) < 1e-4
    assert all(abs(r.z) < 1e-6 for r in hvg.mm_z(points, k).collect() if not math.isnan(r.z))
