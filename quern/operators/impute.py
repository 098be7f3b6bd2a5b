"""Imputation of dropouts: a gamma-normal mixture by gene and cluster, then a non-negative regression by cell."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.linalg import nnls, nonnegative_ridge
from quern.functions.special import digamma, gamma_pdf, norm_pdf
from quern.operators import graph, hvg, reduce
from quern.plans.scratch import materialize

OFFSET = 1.01
FITS = 500


def _gamma_shape(v: float) -> float:
    """Root of ln(a) - digamma(a) = v, at most 20, by bisection."""
    if v <= 0:
        return 20.0
    low, high = 1e-3, 20.0
    if math.log(high) - digamma(high)[0] > v:
        return high
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if math.log(mid) - digamma(mid)[0] > v else (low, mid)
    return (low + high) / 2


def fit_mixture(x: np.ndarray, max_iter: int = 100) -> tuple[float, float, float, float, float] | None:
    """``(share, shape, scale, mean, sd)`` of a gamma (dropouts) and a normal part of log10 values; None for constant ones."""
    base = math.log10(OFFSET)
    if len(x) < 3 or np.ptp(x) < 1e-12:
        return None
    share = max(0.01, float((x <= base + 1e-9).mean()))
    rest = x[x > base + 1e-9]
    rest = rest if len(rest) > 1 else x
    shape, scale, mean, sd = 0.5, 1.0, float(rest.mean()), float(rest.std()) or 0.1
    before = -np.inf
    for _ in range(max_iter):
        low, high = share * gamma_pdf(x, shape, scale), (1 - share) * norm_pdf(x, mean, sd)
        total = np.maximum(low + high, 1e-300)
        w = low / total
        now = float(np.log(total).sum())
        if (now - before) ** 2 <= 0.5:
            break
        before = now
        share = min(0.999, max(0.001, float(w.mean())))
        v = 1 - w
        if v.sum() > 1e-9:
            mean = float((v * x).sum() / v.sum())
            sd = max(1e-3, math.sqrt(float((v * (x - mean) ** 2).sum() / v.sum())))
        if w.sum() > 1e-9:
            m = float((w * x).sum() / w.sum())
            logs = float((w * np.log(x)).sum() / w.sum())
            shape = _gamma_shape(math.log(m) - logs)
            scale = m / shape
    return share, shape, scale, mean, sd


def log_cpm(counts: DataFrame) -> DataFrame:
    """``(gene, cell, value, depth)``: log10(counts per million + 1.01); absent entries stand for log10(1.01)."""
    depth = counts.groupBy("cell").agg(F.sum("count").cast("double").alias("depth"))
    return counts.join(depth, "cell").select("gene", "cell", F.log10(F.col("count") * 1e6 / F.col("depth") + OFFSET).alias("value"), "depth")


def subpopulations(counts: DataFrame, ngenes: int = 1000, ncomp: int = 75, k: int = 10, prune: float = 0.067, resolution: float = 0.5) -> DataFrame:
    """``(cell, cluster)``: Leiden communities of cells on the components of the most variable genes.

    Genes are chosen on log10(counts per million + 1.01) less its value at zero, which leaves absent entries at 0 and
    drops out of the scaled components. Cells without any chosen gene take part as zero vectors.
    """
    logs = materialize(log_cpm(counts).select("gene", "cell", (F.col("value") - math.log10(OFFSET)).alias("value")), "logs")
    cells = logs.select("cell").distinct()
    n = cells.count()
    if n < 2:
        return cells.select("cell", F.lit(0).alias("cluster"))
    genes = [r["gene"] for r in hvg.find_hvg(logs, n, "seurat", ngenes).orderBy("rank").collect()]  # ngenes names
    zero = F.array_repeat(F.lit(0.0), len(genes))
    vectors = cells.join(reduce.cell_vectors(logs, genes), "cell", "left").select("cell", F.coalesce("v", zero).alias("v"))
    comp, _, _ = reduce.svd(vectors, len(genes), min(ncomp, len(genes), n - 1))
    # numbers in the order of the names, without a sort in one task
    points = materialize(comp.orderBy("cell").select("cell", F.monotonically_increasing_id().alias("id"), F.col("comp").alias("v")), "points")
    found = graph.generate(points.select("id", "v"), min(k, n), "leiden", prune, resolution=resolution)
    return points.join(found, "id").select("cell", "cluster")


def dropout_rates(logs: DataFrame, clusters: DataFrame) -> DataFrame:
    """``(gene, cluster, cell, value, drop)``: the chance of each cell's value being a dropout, zeros included.

    A group is one gene in one cluster: its found values and the number of its zeros, which all have one chance.
    """
    sizes = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    rows = logs.join(clusters, "cell").join(sizes, "cluster")
    base = math.log10(OFFSET)
    gene, cell, cluster = (df.schema[c].dataType.simpleString() for df, c in ((logs, "gene"), (logs, "cell"), (clusters, "cluster")))

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        found = frame["value"].to_numpy(dtype=float)
        mix = fit_mixture(np.concatenate([found, np.full(int(frame["n"].iloc[0]) - len(found), base)]))
        value = np.append(found, base)
        if mix is None:
            drop = np.zeros(len(value))
        else:
            share, shape, scale, mean, sd = mix
            low, high = share * gamma_pdf(value, shape, scale), (1 - share) * norm_pdf(value, mean, sd)
            drop = low / np.maximum(low + high, 1e-300)
            drop = np.where(value > mean, 0.0, drop)
        names = pd.concat([frame["cell"].astype(object), pd.Series([None], dtype=object)], ignore_index=True)
        return pd.DataFrame({"gene": [frame["gene"].iloc[0]] * len(value), "cluster": [frame["cluster"].iloc[0]] * len(value), "cell": names, "value": value, "drop": drop})

    fitted = rows.select("gene", "cell", "value", "cluster", "n").groupBy("gene", "cluster").applyInPandas(
        fit, f"gene {gene}, cluster {cluster}, cell {cell}, value double, drop double"
    )
    fitted = materialize(fitted, "rates")
    found = fitted.where("cell IS NOT NULL")
    zeros = fitted.where("cell IS NULL").drop("cell").join(clusters, "cluster").join(found.select("gene", "cell"), ["gene", "cell"], "left_anti")
    return found.unionByName(zeros.select("gene", "cluster", "cell", "value", "drop"))


def impute(counts: DataFrame, clusters: DataFrame | None = None, drop_thres: float = 0.5, ridge: float = 1.0) -> DataFrame:
    """``(gene, cell, value)``: counts with likely dropouts predicted from other cells of the cluster, rounded to 2 places.

    A cell's sure genes are fitted on the same genes of all other cells of its cluster by a positive ridge regression,
    which predicts its unsure ones, at most up to the gene's largest value. Entries of 0 are not returned.
    Without ``clusters`` they are the :func:`subpopulations`. A task holds a cluster's matrix and fits ``FITS`` of its cells.
    """
    clusters = materialize(subpopulations(counts), "clusters") if clusters is None else clusters
    parts = clusters.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / FITS).cast("int").alias("parts"))
    rates = dropout_rates(log_cpm(counts), clusters).join(F.broadcast(parts), "cluster")
    rates = rates.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    depth = counts.groupBy("cell").agg(F.sum("count").cast("double").alias("depth"))
    gene, cell = (counts.schema[c].dataType.simpleString() for c in ("gene", "cell"))

    def fill(frame: pd.DataFrame) -> pd.DataFrame:
        value = frame.pivot(index="gene", columns="cell", values="value").sort_index()
        drop = frame.pivot(index="gene", columns="cell", values="drop").reindex_like(value).to_numpy()
        x, out, cells = value.to_numpy(), value.to_numpy().copy(), list(value.columns)
        top = x.max(axis=1)
        own = range(int(frame["part"].iloc[0]), len(cells), int(frame["parts"].iloc[0]))
        for i in own:
            unsure = drop[:, i] > drop_thres
            others = np.arange(len(cells)) != i
            if not unsure.any() or unsure.all() or not others.any():
                continue
            fit = nonnegative_ridge if ridge > 0 else nnls
            w = fit(x[~unsure][:, others], x[~unsure, i], ridge)
            out[unsure, i] = np.minimum(x[unsure][:, others] @ w, top[unsure])
        cells, out = [cells[i] for i in own], out[:, list(own)]
        return pd.DataFrame({"gene": np.repeat(value.index.to_numpy(), len(cells)), "cell": cells * len(x), "value": out.ravel()})

    filled = rates.groupBy("cluster", "part").applyInPandas(fill, f"gene {gene}, cell {cell}, value double")
    raw = F.round((F.pow(F.lit(10.0), "value") - OFFSET) * F.col("depth") / 1e6, 2)
    return filled.join(depth, "cell").select("gene", "cell", F.greatest(F.lit(0.0), raw).alias("value")).where("value > 0")
