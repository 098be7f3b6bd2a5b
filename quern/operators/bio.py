"""Cell types from marker genes, and cell-cycle phases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from quern.functions import special
from quern.functions.stats import bh_adjust
from quern.functions.zeroagg import group_median
from quern.plans.scratch import materialize


def median_expression(expr: DataFrame, clusters: DataFrame, min_size: int = 10) -> DataFrame:
    """``(gene, cluster, median)`` with zeros counted; a row for each gene and kept cluster."""
    sizes = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_size)
    rows = expr.join(clusters.join(F.broadcast(sizes.select("cluster")), "cluster"), "cell")
    found = group_median(rows.select("gene", "cluster", "value"), ["gene", "cluster"], sizes, ["cluster"])
    grid = expr.select("gene").distinct().join(F.broadcast(sizes.select("cluster")))
    return grid.join(found, ["gene", "cluster"], "left").select("gene", "cluster", F.coalesce("median", F.lit(0.0)).alias("median"))


def load_markers(rows: DataFrame, species: str = "Mm", max_ubiquity: float = 0.05) -> DataFrame:
    """``(gene, cell_type)`` of a marker table: one species, and genes that few cell types share."""
    return rows.where(F.col("species").contains(species) & (F.col("ubiquitousness index").cast("double") < max_ubiquity)).select(
        F.upper("official gene symbol").alias("gene"), F.col("cell type").alias("cell_type")
    )


def marker_weights(markers: DataFrame) -> DataFrame:
    """``(gene, weight)``: 1 + sqrt((max - f) / (max - min)) of the number of cell types f that list a gene; 1 if all are equal."""
    freq = markers.groupBy("gene").agg(F.count(F.lit(1)).alias("f"))
    ends = freq.agg(F.max("f").alias("hi"), F.min("f").alias("lo"))
    share = (F.col("hi") - F.col("f")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0)).cast("double")
    return freq.join(F.broadcast(ends)).select("gene", (1 + F.sqrt(F.coalesce(share, F.lit(0.0)))).alias("weight"))


def cluster_zscores(medians: DataFrame) -> DataFrame:
    """``(gene, cluster, median, z)``: within each cluster, over genes, with the population deviation."""
    stats = medians.groupBy("cluster").agg(F.avg("median").alias("_m"), F.stddev_pop("median").alias("_s"))
    z = F.when(F.col("_s") > 1e-12, (F.col("median") - F.col("_m")) / F.col("_s")).otherwise(0.0)
    return medians.join(F.broadcast(stats), "cluster").select("gene", "cluster", "median", z.alias("z"))


def activity(scored: DataFrame, markers: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """``(cluster, cell_type, activity, n)``: sum of z * weight over the set's genes in the data, over n ** 0.3.

    Weights come from all markers; ``symbols(gene)`` then restricts the sets.
    """
    kept = markers.join(symbols, "gene", "left_semi") if symbols is not None else markers
    rows = scored.join(kept.distinct().join(marker_weights(markers), "gene"), "gene")
    total = F.sum(F.col("z") * F.col("weight")) / F.pow(F.count(F.lit(1)).cast("double"), 0.3)
    return rows.groupBy("cluster", "cell_type").agg(total.alias("activity"), F.count(F.lit(1)).alias("n"))


def contingency(scored: DataFrame, markers: DataFrame) -> DataFrame:
    """``(cluster, cell_type, a, b, c, d)``: expressed (median > 0) or not, in the set or not."""
    on = F.col("median") > 0
    every = scored.groupBy("cluster").agg(F.count_if(on).alias("e"), F.count_if(~on).alias("ne"))
    sets = scored.join(markers.distinct(), "gene").groupBy("cluster", "cell_type").agg(F.count_if(on).alias("a"), F.count_if(~on).alias("b"))
    return sets.join(F.broadcast(every), "cluster").select("cluster", "cell_type", "a", "b", (F.col("e") - F.col("a")).alias("c"), (F.col("ne") - F.col("b")).alias("d"))


def plain_symbol(gene):
    """Upper case, without what follows the first underscore."""
    return F.regexp_replace(F.upper(gene.cast("string")), "_.*$", "")


def predict_cell_types(expr: DataFrame, clusters: DataFrame, markers: DataFrame, min_size: int = 10, symbols: DataFrame | None = None, max_p: float = 0.10):
    """``(best, all)``: the best cell type of each cluster ('Unknown' over ``max_p``), and all activities with p-values."""
    medians = median_expression(materialize(expr, "expr"), clusters, min_size).withColumn("gene", plain_symbol(F.col("gene")))
    scored = cluster_zscores(materialize(medians.groupBy("gene", "cluster").agg(F.max("median").alias("median")), "medians"))
    markers = markers.withColumn("gene", F.upper("gene"))
    kept = markers.join(symbols, "gene", "left_semi") if symbols is not None else markers
    fisher = special.udfs()["fisher_greater"]
    rows = activity(scored, markers, symbols).join(contingency(scored, kept), ["cluster", "cell_type"])
    rows = rows.withColumn("p_val", fisher(*[F.col(c).cast("double") for c in "abcd"]))
    rows = bh_adjust(materialize(rows, "tested"))
    first = rows.withColumn("rank", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("activity"), "cell_type")))
    best = first.where("rank = 1").withColumn("cell_type", F.when(F.col("fdr") > max_p, "Unknown").otherwise(F.col("cell_type"))).drop("rank")
    return best, rows


def _features(expr: DataFrame, genes: list) -> DataFrame:
    """``(cell, features vector)``: scaled values of ``genes`` in order, 0 where absent."""
    from pyspark.ml.functions import array_to_vector

    place = expr.sparkSession.createDataFrame([(g, i) for i, g in enumerate(genes)], ["gene", "_i"])
    n = expr.select("cell").distinct().count()
    stats = expr.groupBy("gene").agg((F.sum("value") / n).alias("_m"), F.sqrt(F.greatest(F.lit(0.0), F.sum(F.col("value") * F.col("value")) / n - F.pow(F.sum("value") / n, 2))).alias("_s"))
    rest = place.join(F.broadcast(stats), "gene", "left").orderBy("_i").select("_m", "_s").collect()  # a row a feature
    mean, spread = [float(r["_m"] or 0) for r in rest], [float(r["_s"] or 0) or 1.0 for r in rest]
    held = expr.join(F.broadcast(place), "gene").groupBy("cell").agg(F.map_from_entries(F.collect_list(F.struct("_i", F.col("value").cast("double")))).alias("m"))
    every = expr.select("cell").distinct().join(held, "cell", "left")
    value = lambda i: (F.coalesce(F.try_element_at("m", F.lit(i).cast("long")), F.lit(0.0)) - mean[i]) / spread[i]
    return every.select("cell", array_to_vector(F.array(*[value(i) for i in range(len(genes))])).alias("features"))


def train_cell_cycle(expr: DataFrame, phases: DataFrame, genes: list, iterations: int = 50, reg: float = 1e-2):
    """A linear support-vector classifier of ``phases(cell, phase)`` on scaled genes: a fitted pipeline model with ``genes``."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LinearSVC, OneVsRest
    from pyspark.ml.feature import IndexToString, StringIndexer

    index = StringIndexer(inputCol="phase", outputCol="label", stringOrderType="alphabetAsc")
    rows = materialize(_features(expr, genes).join(phases, "cell"), "phases")  # read once an iteration
    names = index.fit(rows).labels
    model = Pipeline(
        stages=[index, OneVsRest(classifier=LinearSVC(maxIter=iterations, regParam=reg)), IndexToString(inputCol="prediction", outputCol="cell_cycle", labels=names)]
    ).fit(rows)
    return model, genes


def predict_cell_cycle(expr: DataFrame, model, genes: list, id_pattern: str | None = None) -> DataFrame:
    """``(cell, cell_cycle)``; ``id_pattern`` extracts gene ids from labels (e.g. ``ENSMUSG[0-9]+``)."""
    if id_pattern:
        expr = expr.withColumn("gene", F.regexp_extract(F.col("gene").cast("string"), f"({id_pattern})", 1)).groupBy("gene", "cell").agg(F.sum("value").alias("value"))
    rows = _features(expr, genes)
    for stage in model.stages[1:]:
        rows = stage.transform(rows)
    return rows.select("cell", "cell_cycle")
