"""Differential expression between clusters: tests by pair, their combination, filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from quern.functions import special
from quern.functions.stats import bh_adjust, bonferroni
from quern.plans.scratch import materialize


def cluster_sizes(clusters: DataFrame, min_size: int = 0) -> DataFrame:
    """``(cluster, n)`` of the clusters with at least ``min_size`` cells."""
    return clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_size)


def cluster_moments(expr: DataFrame, clusters: DataFrame, min_size: int = 10) -> DataFrame:
    """``(gene, cluster, n, s, q)``: sums and squares of every gene in every kept cluster, absent ones as 0."""
    sizes = cluster_sizes(clusters, min_size)
    kept = clusters.join(F.broadcast(sizes.select("cluster")), "cluster")
    sums = expr.join(kept, "cell").groupBy("gene", "cluster").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"))
    names = sums.select("gene").distinct()
    grid = names.join(F.broadcast(sizes))  # genes x clusters, a row each of the result
    zero = F.lit(0.0)
    return grid.join(sums, ["gene", "cluster"], "left").select("gene", "cluster", "n", F.coalesce("s", zero).alias("s"), F.coalesce("q", zero).alias("q"))


def linear_model_stats(moments: DataFrame) -> DataFrame:
    """``(gene, a, b, t_stat, logfc, mean_a, mean_b, df)`` for cluster pairs with a > b.

    One-hot least squares in closed form: pooled variance SSE / (N - K) and t of the difference of means.
    """
    every = moments.groupBy("gene").agg((F.sum(F.col("q") - F.col("s") * F.col("s") / F.col("n")) / (F.sum("n") - F.count(F.lit(1)))).alias("s2"), (F.sum("n") - F.count(F.lit(1))).alias("df"))
    side = lambda x: moments.select("gene", F.col("cluster").alias(x), (F.col("s") / F.col("n")).alias(f"mean_{x}"), F.col("n").alias(f"n_{x}"))
    pairs = side("a").join(side("b"), "gene").where("a > b").join(every, "gene")
    lfc = F.col("mean_a") - F.col("mean_b")
    err = F.sqrt(F.col("s2") * (1.0 / F.col("n_a") + 1.0 / F.col("n_b")))
    return pairs.select("gene", "a", "b", (lfc / F.nullif(err, F.lit(0.0))).alias("t_stat"), lfc.alias("logfc"), "mean_a", "mean_b", "df")


def linear_model(expr: DataFrame, clusters: DataFrame, direction: str = "up", min_size: int = 10, target: list | None = None) -> DataFrame:
    """``(comparison, a, b, gene, p_val, fdr, t_stat, t_signed, logfc, mean_a, mean_b)`` in both directions of each pair.

    ``t_stat`` keeps the pair's sign in the reverse comparison; ``t_signed`` turns it.
    """
    if direction not in ("up", "down", "any"):
        raise ValueError("direction is up, down or any")
    sf = special.udfs()["student_sf"]
    one = linear_model_stats(cluster_moments(expr, clusters, min_size)).withColumn("up", sf("t_stat", F.col("df").cast("double")))
    both = one.withColumn("t_signed", F.col("t_stat")).unionByName(
        one.select(
            "gene", F.col("b").alias("a"), F.col("a").alias("b"), "t_stat", (-F.col("t_stat")).alias("t_signed"), (-F.col("logfc")).alias("logfc"),
            F.col("mean_b").alias("mean_a"), F.col("mean_a").alias("mean_b"), "df", (1 - F.col("up")).alias("up"),
        )
    )
    p = {"up": F.col("up"), "down": 1 - F.col("up"), "any": 2 * F.least(F.col("up"), 1 - F.col("up"))}[direction]
    out = both.withColumn("p_val", p).withColumn("comparison", F.concat_ws("_vs_", F.col("a").cast("string"), F.col("b").cast("string")))
    if target is not None:
        out = out.where(F.col("a").isin(target))
    out = bh_adjust(materialize(out, "tests"))
    return out.select("comparison", "a", "b", "gene", "p_val", "fdr", "t_stat", "t_signed", "logfc", "mean_a", "mean_b")


def matrix_form(long: DataFrame, value: str = "p_val") -> DataFrame:
    """Genes x comparisons."""
    return long.groupBy("gene").pivot("comparison").agg(F.first(value))


def wilcoxon_stats(expr: DataFrame, clusters: DataFrame, min_size: int = 10) -> DataFrame:
    """``(gene, c1, c2, n1, n2, u, z)`` for cluster pairs c1 < c2; zeros are one block of ties.

    Values are counted by (gene, cluster, value) first, so ranks are sums over distinct values.
    """
    sizes = cluster_sizes(clusters, min_size)
    kept = clusters.join(F.broadcast(sizes.select("cluster")), "cluster")
    found = expr.where("value <> 0").join(kept, "cell").groupBy("gene", "cluster", "value").agg(F.count(F.lit(1)).alias("c"))
    held = found.groupBy("gene", "cluster").agg(F.sum("c").alias("h"))
    grid = found.select("gene").distinct().join(F.broadcast(sizes))
    zeros = grid.join(held, ["gene", "cluster"], "left").select("gene", "cluster", F.lit(0.0).alias("value"), (F.col("n") - F.coalesce("h", F.lit(0))).alias("c")).where("c > 0")
    freq = found.unionByName(zeros)
    other = sizes.select(F.col("cluster").alias("o"), F.col("n").alias("n_o"))
    mine = sizes.select("cluster", F.col("n").alias("n_c"))
    rows = freq.join(F.broadcast(mine), "cluster").join(F.broadcast(other)).where("cluster <> o")
    first = F.col("cluster") < F.col("o")
    rows = rows.select(
        "gene", F.least("cluster", "o").alias("c1"), F.greatest("cluster", "o").alias("c2"), "value", "c", F.when(first, F.col("c")).otherwise(0).alias("c_1"),
        F.when(first, F.col("n_c")).otherwise(F.col("n_o")).alias("n1"), F.when(first, F.col("n_o")).otherwise(F.col("n_c")).alias("n2"),
    )
    ties = rows.groupBy("gene", "c1", "c2", "n1", "n2", "value").agg(F.sum("c").alias("t"), F.sum("c_1").alias("t1"))
    before = Window.partitionBy("gene", "c1", "c2").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    ties = ties.withColumn("rank", F.coalesce(F.sum("t").over(before), F.lit(0)) + (F.col("t") + 1) / 2.0)
    t = F.col("t").cast("double")
    sums = ties.groupBy("gene", "c1", "c2", "n1", "n2").agg(F.sum(F.col("t1") * F.col("rank")).alias("r1"), F.sum(t * t * t - t).alias("tie"))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    u = F.col("r1") - n1 * (n1 + 1) / 2
    sd = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.col("tie") / (n * (n - 1))))
    z = F.when(sd > 0, (F.abs(u - n1 * n2 / 2) - 0.5) / F.nullif(sd, F.lit(0.0))).otherwise(0.0)
    return sums.select("gene", "c1", "c2", "n1", "n2", u.alias("u"), z.alias("z"))


def wilcoxon(expr: DataFrame, clusters: DataFrame, min_size: int = 10, alternative: str = "two-sided") -> DataFrame:
    """``(comparison, a, b, gene, u, p_val, fdr)`` for all ordered pairs; p is 1 where all values are equal."""
    stats = wilcoxon_stats(expr, clusters, min_size)
    centre = F.col("n1") * F.col("n2") / 2.0
    sf = special.udfs()["normal_sf"]
    if alternative == "two-sided":
        p = lambda up: F.least(F.lit(1.0), 2 * sf("z"))
    else:
        sign = {"greater": 1, "less": -1}[alternative]
        sd = F.abs(F.col("u") - centre) - 0.5
        z0 = lambda up: F.when(F.col("z") == 0, 0.0).otherwise((sign * up * (F.col("u") - centre) - 0.5) * F.col("z") / sd)
        p = lambda up: sf(z0(up))
    one = stats.select(F.col("c1").alias("a"), F.col("c2").alias("b"), "gene", "u", p(1).alias("p_val"))
    two = stats.select(F.col("c2").alias("a"), F.col("c1").alias("b"), "gene", (F.col("n1") * F.col("n2") - F.col("u")).alias("u"), p(-1).alias("p_val"))
    both = one.unionByName(two).withColumn("comparison", F.concat_ws("_vs_", F.col("a").cast("string"), F.col("b").cast("string")))
    return bh_adjust(materialize(both, "tests")).select("comparison", "a", "b", "gene", "u", "p_val", "fdr")


def simes(tests: DataFrame) -> DataFrame:
    """``(cluster, gene, p_val)`` of ``tests(a, gene, p_val)``: min of k p / rank, with average ranks of ties."""
    rows = tests.where("p_val IS NOT NULL").withColumnRenamed("a", "cluster")
    group, order = Window.partitionBy("cluster", "gene"), Window.partitionBy("cluster", "gene").orderBy("p_val")
    rank = F.rank().over(order) + (F.count(F.lit(1)).over(Window.partitionBy("cluster", "gene", "p_val")) - 1) / F.lit(2.0)
    scored = rows.withColumn("s", F.count(F.lit(1)).over(group) * F.col("p_val") / rank)
    return scored.groupBy("cluster", "gene").agg(F.least(F.lit(1.0), F.min("s")).alias("p_val"))


def fisher(tests: DataFrame) -> DataFrame:
    """Fisher's combination; its chi-square has an even number of degrees, so its tail is a finite sum."""
    p = F.greatest(F.col("p_val"), F.lit(1e-300))
    sums = tests.where("p_val IS NOT NULL").groupBy(F.col("a").alias("cluster"), "gene").agg((-F.sum(F.log(p))).alias("h"), F.count(F.lit(1)).alias("k"))
    # terms t_i = t_(i-1) h / i, started at exp(-h)
    tail = F.expr(
        "aggregate(sequence(1, cast(k as int)), named_struct('t', exp(-h), 's', cast(0.0 as double)),"
        " (acc, i) -> named_struct('t', acc.t * h / i, 's', acc.s + acc.t), acc -> least(1.0D, acc.s))"
    )
    return sums.select("cluster", "gene", tail.alias("p_val"))


def stouffer(tests: DataFrame) -> DataFrame:
    """Sum of normal quantiles over root k; a p-value of 0 counts as the group's smallest above 0."""
    udf = special.udfs()
    rows = tests.where("p_val IS NOT NULL").withColumnRenamed("a", "cluster")
    low = F.min(F.when(F.col("p_val") > 0, F.col("p_val"))).over(Window.partitionBy("cluster", "gene"))
    rows = rows.withColumn("p", F.least(F.lit(1 - 1e-16), F.when(F.col("p_val") > 0, F.col("p_val")).otherwise(F.coalesce(low, F.lit(1e-300)))))
    sums = rows.withColumn("z", udf["normal_isf"]("p")).groupBy("cluster", "gene").agg((F.sum("z") / F.sqrt(F.count(F.lit(1)).cast("double"))).alias("z"))
    return sums.select("cluster", "gene", udf["normal_sf"]("z").alias("p_val"))


def combine_tests(tests: DataFrame, method: str = "fisher", mtc: str = "BH") -> DataFrame:
    """``(cluster, gene, p_val, mtc_p)``: each cluster's tests against all others as one, then corrected over all rows."""
    ways = {"simes": simes, "fisher": fisher, "stouffer": stouffer}
    if method not in ways or mtc not in ("BH", "bonferroni"):
        raise ValueError("method is simes, fisher or stouffer; mtc is BH or bonferroni")
    return (bh_adjust if mtc == "BH" else bonferroni)(materialize(ways[method](tests), "combined"), "p_val", "mtc_p")


def filter_tests(combined: DataFrame, expr: DataFrame, clusters: DataFrame, thres: float = 0.01, frac: float = 0.8) -> DataFrame:
    """Rows under ``thres`` whose gene is found in more than ``frac`` of the cluster's cells, with that percentage."""
    sizes = cluster_sizes(clusters)
    found = expr.where("value > 0").join(clusters, "cell").groupBy("gene", "cluster").agg(F.count(F.lit(1)).alias("r")).join(F.broadcast(sizes), "cluster")
    share = found.select("gene", "cluster", F.round(100.0 * F.col("r") / F.col("n"), 2).alias("perc_cells"), (F.col("r") > frac * F.col("n")).alias("wide"))
    return combined.where(F.col("mtc_p") < thres).join(share.where("wide").drop("wide"), ["gene", "cluster"]).select("cluster", "gene", "p_val", "mtc_p", "perc_cells")


def summary(filtered: DataFrame) -> DataFrame:
    """``(gene, n_clusters, clusters)``: in how many and which clusters a gene stays."""
    return filtered.groupBy("gene").agg(
        F.count_distinct("cluster").alias("n_clusters"), F.concat_ws(" ", F.array_sort(F.collect_set(F.col("cluster").cast("string")))).alias("clusters")
    )
