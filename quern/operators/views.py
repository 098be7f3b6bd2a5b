"""The queries behind charts; drawing is left to the caller."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def overall_scatter(cells: DataFrame) -> DataFrame:
    """``(cell, total_reads, detected_genes, removed)``."""
    return cells.select("cell", "total_reads", "detected_genes", (F.col("status") != "OK").alias("removed"))


def histogram(df: DataFrame, value: str, bins: int = 100) -> DataFrame:
    """``(bin, low, n)``: equal-width bins between the ends; the largest value is in the last bin."""
    ends = df.agg(F.min(value).cast("double").alias("_lo"), F.max(value).cast("double").alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    place = F.when(width > 0, F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("_lo")) / F.nullif(width, F.lit(0.0))))).otherwise(0)
    rows = df.where(F.col(value).isNotNull()).join(F.broadcast(ends)).select(place.cast("int").alias("bin"), "_lo", width.alias("_w"))
    return rows.groupBy("bin", "_lo", "_w").agg(F.count(F.lit(1)).alias("n")).select("bin", (F.col("_lo") + F.col("bin") * F.col("_w")).alias("low"), "n")


def cutoff(df: DataFrame, value: str, at: float) -> DataFrame:
    """One row: how many lie above, and at or below, a cut."""
    return df.agg(F.count_if(F.col(value) > at).alias("above"), F.count_if(F.col(value) <= at).alias("below"))


def quantiles(df: DataFrame, value: str, by: list[str] = ()) -> DataFrame:
    """Five-number summaries for box plots."""
    return df.groupBy(*by).agg(*[F.expr(f"percentile({value}, {q})").alias(n) for n, q in (("low", 0.0), ("q1", 0.25), ("median", 0.5), ("q3", 0.75), ("high", 1.0))])


def contributors(loadings: DataFrame, dims: list[int], top: int = 20) -> DataFrame:
    """``(pc, side, rank, gene, loading)``: largest and smallest loadings of each component."""
    rows = loadings.select("gene", F.posexplode("load").alias("pc", "loading")).withColumn("pc", F.col("pc") + 1).where(F.col("pc").isin(dims))
    sides = []
    for side, key in (("top", F.desc("loading")), ("bottom", F.asc("loading"))):
        order = Window.partitionBy("pc").orderBy(key, "gene")
        sides.append(rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("pc", F.lit(side).alias("side"), "rank", "gene", "loading"))
    return sides[0].unionByName(sides[1])


def elbow(sdev: DataFrame) -> DataFrame:
    """``(pc, share, cumulative)`` of the variance explained."""
    total = sdev.agg(F.sum(F.col("sdev") * F.col("sdev")).alias("t"))
    rows = sdev.join(F.broadcast(total)).select("pc", (F.col("sdev") * F.col("sdev") / F.col("t")).alias("share"))
    return rows.withColumn("cumulative", F.sum("share").over(Window.orderBy("pc")))


def cell_view(embedding: DataFrame, clusters: DataFrame | None = None, metadata: DataFrame | None = None, expr: DataFrame | None = None, gene: str | None = None, min_size: int = 0) -> DataFrame:
    """The embedding with clusters (and their labels), metadata, and one gene's values; the pattern must match exactly one gene."""
    out = embedding
    if clusters is not None:
        sizes = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_size)
        label = F.concat(F.col("cluster").cast("string"), F.lit(" (n="), F.col("n").cast("string"), F.lit(")"))
        out = out.join(clusters.join(F.broadcast(sizes), "cluster").select("cell", "cluster", label.alias("label")), "cell")
    if metadata is not None:
        out = out.join(metadata, "cell", "left")
    if gene is not None:
        found = [r["gene"] for r in expr.select("gene").distinct().where(F.col("gene").cast("string").rlike(gene)).limit(2).collect()]
        if len(found) != 1:
            raise ValueError(f"{gene!r} matches {'no gene' if not found else 'several genes'}")
        one = expr.where(F.col("gene") == F.lit(found[0])).select("cell", F.col("value").alias("expression"))
        out = out.join(one, "cell", "left").fillna(0.0, ["expression"])
    return out


def rectangle(embedding: DataFrame, x1: float, x2: float, y1: float, y2: float) -> DataFrame:
    """Cells strictly inside a rectangle."""
    return embedding.where((F.col("x") > x1) & (F.col("x") < x2) & (F.col("y") > y1) & (F.col("y") < y2))


def cluster_centres(embedding: DataFrame, clusters: DataFrame) -> DataFrame:
    return embedding.join(clusters, "cell").groupBy("cluster").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count(F.lit(1)).alias("n"))


def cluster_means(expr: DataFrame, clusters: DataFrame) -> DataFrame:
    """``(gene, cluster, mean)`` with zeros counted; genes absent from a cluster have no row."""
    sizes = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    return expr.join(clusters, "cell").groupBy("gene", "cluster").agg(F.sum("value").alias("s")).join(F.broadcast(sizes), "cluster").select("gene", "cluster", (F.col("s") / F.col("n")).alias("mean"))


def top_genes(expr: DataFrame, clusters: DataFrame, top: int = 10, rank=None) -> DataFrame:
    """``(cluster, rank, gene, score)``: best genes of each cluster; ``rank`` maps the value column to an aggregate (default: zero-aware mean)."""
    if rank is None:
        scored = cluster_means(expr, clusters).withColumnRenamed("mean", "score")
    else:
        scored = expr.join(clusters, "cell").groupBy("gene", "cluster").agg(rank(F.col("value")).alias("score"))
    order = Window.partitionBy("cluster").orderBy(F.desc(F.round("score", 9)), "gene")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("cluster", "rank", "gene", "score")


def violin(expr: DataFrame, clusters: DataFrame, top: int = 10) -> DataFrame:
    """Values of each cluster's best genes in its cells."""
    best = top_genes(expr, clusters, top)
    return expr.join(clusters, "cell").join(F.broadcast(best.select("cluster", "gene", "rank")), ["cluster", "gene"]).select("cluster", "rank", "gene", "cell", "value")


def expressed_genes(counts: DataFrame, clusters: DataFrame, min_size: int = 0) -> DataFrame:
    """``(cluster, cell, genes)``: genes found in each cell."""
    sizes = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_size)
    each = counts.where("count > 0").groupBy("cell").agg(F.count(F.lit(1)).alias("genes"))
    return clusters.join(F.broadcast(sizes.select("cluster")), "cluster").join(each, "cell", "left").select("cluster", "cell", F.coalesce("genes", F.lit(0)).alias("genes"))


def jackstraw_bars(components: DataFrame) -> DataFrame:
    """``(pc, height, significant, threshold)``: -log10 p, and the largest significant p."""
    line = components.agg(F.max(F.when(F.col("significant"), F.col("p_val"))).alias("threshold"))
    return components.join(F.broadcast(line)).select("pc", (-F.log10(F.greatest("p_val", F.lit(1e-300)))).alias("height"), "significant", "threshold")


def distinct_colours(n: int, seed: int = 42) -> list[str]:
    """``n`` hex colours far apart: hues by the golden ratio at alternating lightness."""
    import colorsys

    out = []
    for i in range(n):
        hue, light, full = (seed * 0.1 + i * 0.618033988749895) % 1, (0.5, 0.35, 0.65)[i % 3], (0.9, 0.65)[i // 3 % 2]
        out.append("#" + "".join(f"{round(c * 255):02x}" for c in colorsys.hls_to_rgb(hue, light, full)))
    return out
