"""Bulk deconvolution: cell-type bases from single cells, proportions by non-negative least squares."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.linalg import nnls


def group_sums(counts: DataFrame, cells: DataFrame) -> DataFrame:
    """``(gene, ct, sample, s, q)`` of ``cells(cell, ct, sample)``: sums and squares of the entries."""
    return counts.join(cells.select("cell", "ct", "sample"), "cell").groupBy("gene", "ct", "sample").agg(
        F.sum("count").cast("double").alias("s"), F.sum(F.col("count").cast("double") * F.col("count")).alias("q")
    )


def mean_matrix(sums: DataFrame) -> DataFrame:
    """``(gene, ct, sample, share)``: a gene's share of the reads of a cell type in a sample."""
    total = sums.groupBy("ct", "sample").agg(F.sum("s").alias("t"))
    return sums.join(F.broadcast(total), ["ct", "sample"]).select("gene", "ct", "sample", (F.col("s") / F.col("t")).alias("share"))


def library_sizes(sums: DataFrame, cells: DataFrame) -> DataFrame:
    """``(ct, lib)``: mean over samples of the reads per cell."""
    n = cells.groupBy("ct", "sample").agg(F.count(F.lit(1)).alias("n"))
    each = sums.groupBy("ct", "sample").agg(F.sum("s").alias("t")).join(F.broadcast(n), ["ct", "sample"])
    return each.groupBy("ct").agg(F.avg(F.col("t") / F.col("n")).alias("lib"))


def _over_samples(shares: DataFrame):
    """Mean over all samples of a cell type, absent genes counting 0."""
    samples = shares.groupBy("ct").agg(F.count_distinct("sample").alias("k"))
    return shares.groupBy("gene", "ct").agg(F.sum("share").alias("s"), F.sum(F.col("share") * F.col("share")).alias("q"), F.count(F.lit(1)).alias("c")).join(F.broadcast(samples), "ct")


def sigma(shares: DataFrame) -> DataFrame:
    """``(gene, ct, sigma)``: variance (ddof 1) of a gene's share over samples."""
    k = F.col("k").cast("double")
    var = F.when(F.col("k") > 1, (F.col("q") - F.col("s") * F.col("s") / k) / F.nullif(k - 1, F.lit(0.0)))
    return _over_samples(shares).select("gene", "ct", var.alias("sigma"))


def basis(shares: DataFrame, libs: DataFrame) -> DataFrame:
    """``(gene, ct, basis)``: mean share over samples times the cell type's library size."""
    return _over_samples(shares).join(F.broadcast(libs), "ct").select("gene", "ct", (F.col("s") / F.col("k") * F.col("lib")).alias("basis"))


def variance_adjustment(sums: DataFrame, cells: DataFrame, low: float = 0.15, high: float = 0.85) -> DataFrame:
    """``(gene, sample, v)``: the largest variance over cell types, relative to the sample's median, kept within two quantiles."""
    n = cells.groupBy("ct", "sample").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    var = (F.col("q") - F.col("s") * F.col("s") / F.col("n")) / (F.col("n") - 1)
    top = sums.join(F.broadcast(n), ["ct", "sample"]).groupBy("gene", "sample").agg(F.max(var).alias("v"))
    mid = top.groupBy("sample").agg(F.expr("percentile(v, 0.5)").alias("m"))
    ratio = top.join(F.broadcast(mid), "sample").select("gene", "sample", (F.col("v") / F.nullif(F.col("m"), F.lit(0.0))).alias("v"))
    ends = ratio.groupBy("sample").agg(F.expr(f"percentile(v, {low})").alias("lo"), F.expr(f"percentile(v, {high})").alias("hi"))
    return ratio.join(F.broadcast(ends), "sample").select("gene", "sample", F.greatest(F.col("lo"), F.least(F.col("hi"), F.col("v"))).alias("v"))


def weighted_shares(sums: DataFrame, adjustment: DataFrame, parity: bool = False) -> DataFrame:
    """Shares of variance-weighted reads; ``parity`` takes a sample's cells of all types for each type."""
    if parity:
        types = sums.select("ct").distinct()
        sums = sums.groupBy("gene", "sample").agg(F.sum("s").alias("s")).join(F.broadcast(types))
    rows = sums.join(adjustment, ["gene", "sample"]).withColumn("w", F.coalesce(F.col("s") / F.sqrt(F.nullif(F.col("v"), F.lit(0.0))), F.lit(0.0)))
    total = rows.groupBy("ct", "sample").agg(F.sum("w").alias("t"))
    return rows.join(F.broadcast(total), ["ct", "sample"]).select("gene", "ct", "sample", F.coalesce(F.col("w") / F.nullif(F.col("t"), F.lit(0.0)), F.lit(0.0)).alias("share"))


def deconvolve(bulk: DataFrame, base: DataFrame, value: str = "basis") -> DataFrame:
    """``(sample, ct, proportion)``: non-negative fit of every bulk sample ``(gene, sample, value)``, summing to 1.

    The basis (genes x cell types) is sent to the workers, which read the genes of one sample at a time.
    """
    wide = base.groupBy("gene").pivot("ct").agg(F.first(value)).fillna(0.0).orderBy("gene").toPandas()
    types, genes = [c for c in wide.columns if c != "gene"], {g: i for i, g in enumerate(wide["gene"])}
    matrix = wide[types].to_numpy(dtype=float)

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        at = frame["gene"].map(genes)
        y = np.zeros(len(matrix))
        y[at[at.notna()].astype(int)] = frame.loc[at.notna(), "value"]
        size = matrix.max(initial=0) or 1.0
        x = nnls(matrix / size, y / (np.abs(y).max(initial=0) or 1.0))
        total = x.sum()
        return pd.DataFrame({"sample": [frame["sample"].iloc[0]] * len(types), "ct": types, "proportion": x / total if total else x})

    return bulk.groupBy("sample").applyInPandas(fit, f"sample {bulk.schema['sample'].dataType.simpleString()}, ct string, proportion double")
