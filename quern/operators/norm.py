"""Normalisation of counts in long form; missing entries are zeros."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from quern.functions.stats import geometric_mean, theta_ml
from quern.plans.scratch import materialize


def standard(counts: DataFrame, scaling_factor: float = 10_000.0) -> DataFrame:
    """x / cell total * factor. The totals are one aggregate joined back, so a cell's entries never meet in one window."""
    total = counts.groupBy("cell").agg(F.sum("count").alias("_t"))
    return counts.join(total, "cell").select("gene", "cell", (F.col("count") / F.col("_t") * scaling_factor).alias("value"))


def rpkm(counts: DataFrame, lengths: DataFrame) -> DataFrame:
    """Reads per kilobase and million, over the genes of ``lengths(gene, length)``."""
    rows = counts.join(lengths.where("length IS NOT NULL"), "gene")
    total = rows.groupBy("cell").agg(F.sum("count").alias("_t"))
    return rows.join(total, "cell").select("gene", "cell", (F.col("count") / (F.col("_t") / 1e6) / (F.col("length") / 1000.0)).alias("value"))


def clr(expr: DataFrame, n: int, axis: str = "genes", value: str = "count") -> DataFrame:
    """ln(1 + x / exp(sum(ln(1 + x)) / n)) along genes or cells; ``n`` is the vector's full length."""
    by = {"genes": "gene", "cells": "cell"}[axis]
    mid = expr.groupBy(by).agg(F.exp(F.sum(F.log1p(value)) / n).alias("_g"))
    return expr.join(mid, by).select("gene", "cell", F.log1p(F.col(value) / F.col("_g")).alias("value"))


def fqn(expr: DataFrame, n_genes: int, n_cells: int, value: str = "count", genes: DataFrame | None = None) -> DataFrame:
    """Full quantile normalisation; ties by gene. Zeros hold a cell's lowest ranks.

    A zero is made a row only if its rank's mean is above 0, i.e. if some cell has a value at that rank: as many
    as the fullest cell has values more. ``genes`` lists all genes, those without a value too (else those of ``expr``).
    """
    order = Window.partitionBy("cell").orderBy(value, "gene")
    here = F.count(F.lit(1)).over(Window.partitionBy("cell"))
    values = expr.where(F.col(value) != 0)
    ranked = values.withColumn("rnk", F.row_number().over(order) + n_genes - here)
    means = ranked.groupBy("rnk").agg((F.sum(value) / n_cells).alias("normal"))
    full = ranked.join(means, "rnk").select("gene", "cell", F.col("normal").alias("value"))
    # place of each gene among all; of the zeros of a cell, the z-th stands after the values before it
    named = (expr if genes is None else genes).select("gene").distinct()
    numbered = materialize(named.select("gene", (F.row_number().over(Window.orderBy("gene")) - 1).alias("at")), "genes")

    @F.pandas_udf("array<struct<at:int,rnk:int>>")
    def zeros(held: pd.Series, low: pd.Series) -> pd.Series:
        out = []
        for places, first in zip(held, low):
            places = np.sort(np.asarray(places, dtype=np.int64))
            z = np.arange(first, n_genes - len(places))
            at = z + np.searchsorted(places - np.arange(len(places)), z, side="right")
            out.append([{"at": int(a), "rnk": int(r) + 1} for a, r in zip(at, z)])
        return pd.Series(out)

    held = values.join(numbered, "gene").groupBy("cell").agg(F.collect_list("at").alias("held"), F.count(F.lit(1)).alias("n"))
    none = expr.select("cell").distinct().join(values.select("cell").distinct(), "cell", "left_anti").select("cell", F.array().cast("array<int>").alias("held"), F.lit(0).cast("long").alias("n"))
    held = held.unionByName(none)
    most = held.agg(F.max("n").alias("most"))  # one number
    rows = held.join(F.broadcast(most)).select("cell", F.explode(zeros("held", n_genes - F.col("most"))).alias("z"))
    rows = rows.select("cell", "z.at", "z.rnk").join(numbered, "at").join(means, "rnk").select("gene", "cell", F.col("normal").alias("value"))
    return full.unionByName(rows)


def fqn_dense(dense: DataFrame, value: str = "value") -> DataFrame:
    """Full quantile normalisation of rows for every gene and cell; ties by gene."""
    ranked = dense.withColumn("rnk", F.row_number().over(Window.partitionBy("cell").orderBy(value, "gene")))
    means = ranked.groupBy("rnk").agg(F.avg(value).alias("normal"))
    return ranked.join(means, "rnk").select("gene", "cell", F.col("normal").alias("value"))


def log_transform(expr: DataFrame, log=F.log2, small_const: float = 1.0) -> DataFrame:
    """``log(x + small_const)``; a constant of 1 keeps zeros implicit. ``log`` maps a column to a column."""
    return expr.withColumn("value", log(F.col("value") + small_const))


def normalise(counts: DataFrame, method: str = "standard", log=F.log2, small_const: float = 1.0, spikes: DataFrame | None = None, **args):
    """Method, then log, then spikes apart: ``(expr, expr of spikes or None)``."""
    if method == "standard":
        out = standard(counts, args.get("scaling_factor", 10_000.0))
    elif method == "rpkm":
        out = rpkm(counts, args["gene_lengths"])
    elif method == "clr":
        by = "cell" if args.get("axis", "genes") == "genes" else "gene"
        out = clr(counts, args.get("n") or counts.select(by).distinct().count(), args.get("axis", "genes"))
    elif method == "fqn":
        out = fqn(counts, counts.select("gene").distinct().count(), counts.select("cell").distinct().count())
    elif method == "vsn":
        out = vsn(counts, **{k: v for k, v in args.items() if k in ("min_cells", "gmean_eps", "ngenes", "seed")})
    else:
        raise ValueError(f"no normalisation {method!r}")
    if log is not None:
        out = log_transform(out, log, small_const)
    if spikes is None:
        return out, None
    names = spikes.select("gene")
    return out.join(names, "gene", "left_anti"), out.join(names, "gene", "left_semi")


def combat(dense: DataFrame, batches: DataFrame, value: str = "value") -> DataFrame:
    """Empirical-Bayes batch correction of means (Johnson et al. 2007), in closed form.

    ``dense(gene, cell, value)`` has all rows, ``batches(cell, batch)`` a row a cell. A gene without
    spread in its batches gives null.
    """
    rows = dense.join(batches, "cell")
    by_batch = rows.groupBy("gene", "batch").agg(F.avg(value).alias("mb"), F.count(F.lit(1)).alias("nb"), F.var_pop(value).alias("vb"))
    by_gene = by_batch.groupBy("gene").agg(
        (F.sum(F.col("mb") * F.col("nb")) / F.sum("nb")).alias("gm"), (F.sum(F.col("vb") * F.col("nb")) / F.sum("nb")).alias("vp")
    )
    by_gene = by_gene.withColumn("vp", F.when(F.col("vp") > 1e-12, F.col("vp")))
    gamma = by_batch.join(by_gene, "gene").withColumn("gh", (F.col("mb") - F.col("gm")) / F.sqrt("vp"))
    prior = gamma.groupBy("batch").agg(F.avg("gh").alias("gb"), F.var_pop("gh").alias("t2"))
    shrunk = gamma.join(F.broadcast(prior), "batch").select(
        "gene", "batch", "gm", "vp", ((F.col("t2") * F.col("gh") + F.col("gb")) / (F.col("t2") + 1)).alias("gs")
    )
    spread = F.sqrt("vp")
    return rows.join(shrunk, ["gene", "batch"]).select(
        "gene", "cell", (((F.col(value) - F.col("gm")) / spread - F.col("gs")) * spread + F.col("gm")).alias("value")
    )


def regress_out(dense: DataFrame, design: DataFrame, numeric: list[str] = (), categorical: list[str] = (), value: str = "value") -> DataFrame:
    """Residuals of every gene's least-squares fit on ``design(cell, ...)``; categories are dummy-coded.

    The design is shared by all genes: its inverse cross product is solved once on the driver (columns squared),
    coefficients are one aggregate by gene, residuals a projection.
    """
    levels = {c: [r[0] for r in design.select(c).distinct().orderBy(c).collect()][1:] for c in categorical}
    columns = [F.lit(1.0), *[F.col(c).cast("double") for c in numeric]]
    columns += [(F.col(c) == F.lit(v)).cast("double") for c, vs in levels.items() for v in vs]
    x = design.select("cell", F.array(*columns).alias("x"))
    k = len(columns)
    cross = x.agg(*[F.sum(F.col("x")[i] * F.col("x")[j]).alias(f"c{i}_{j}") for i in range(k) for j in range(k)]).first()
    inverse = np.linalg.pinv(np.array(cross, dtype=float).reshape(k, k))
    rows = dense.join(x, "cell")
    sums = rows.groupBy("gene").agg(F.array(*[F.sum(F.col("x")[i] * F.col(value)) for i in range(k)]).alias("xy"))
    beta = sums.select("gene", F.array(*[sum((F.col("xy")[j] * float(inverse[i, j]) for j in range(k)), F.lit(0.0)) for i in range(k)]).alias("beta"))
    fitted = sum((F.col("x")[i] * F.col("beta")[i] for i in range(k)), F.lit(0.0))
    return rows.join(beta, "gene").select("gene", "cell", (F.col(value) - fitted).alias("value"))


def zscore(expr: DataFrame, by: str, n: Column | int | None = None, value: str = "value") -> DataFrame:
    """(x - mean) / population sd within ``by``; 0 without spread. ``n`` counts implicit zeros (their rows stay absent)."""
    size = F.count(value).cast("double") if n is None else F.lit(float(n))
    k, m = F.count(value), F.avg(value)
    spread = F.sqrt((k * F.var_pop(value) + k * (size - k) / size * m * m) / size)
    stats = expr.groupBy(by).agg((F.sum(value) / size).alias("_m"), spread.alias("_s"))
    z = F.when(F.col("_s") > 1e-12, (F.col(value) - F.col("_m")) / F.col("_s")).otherwise(0.0)
    return expr.join(stats, by).withColumn("value", z).drop("_m", "_s")


# variance stabilisation by regularised negative-binomial regression


def _poisson_line(y: np.ndarray, x: np.ndarray, steps: int = 50, times: np.ndarray | None = None) -> np.ndarray:
    """Coefficients of a Poisson model log(mu) = a + b x, by iterated weighted least squares; ``times`` counts equal rows."""
    times = np.ones(len(y)) if times is None else times
    design = np.column_stack([np.ones_like(x), x])
    beta = np.array([np.log(max(np.average(y, weights=times), 1e-8)), 0.0])
    for _ in range(steps):
        eta = np.clip(design @ beta, -30, 30)
        mu = np.exp(eta)
        z = eta + (y - mu) / mu
        root = np.sqrt(mu * times)
        new = np.linalg.lstsq(design * root[:, None], z * root, rcond=None)[0]
        if np.abs(new - beta).max() < 1e-8:
            return new
        beta = new
    return beta


def _kernel_smooth(x: np.ndarray, y: np.ndarray, at: np.ndarray, width: float) -> np.ndarray:
    """Nadaraya-Watson means with a normal kernel."""
    out = np.empty(len(at))
    for lo in range(0, len(at), 2048):
        w = np.exp(-0.5 * ((at[lo : lo + 2048, None] - x[None, :]) / width) ** 2) + 1e-300
        out[lo : lo + 2048] = (w @ y) / w.sum(axis=1)
    return out


def _aic_width(x: np.ndarray, y: np.ndarray) -> float:
    """Kernel width of the smallest corrected AIC (Hurvich, Simonoff and Tsai 1998) on a grid."""
    base, best = 1.06 * x.std() * len(x) ** -0.2 or 1.0, None
    for width in base * np.geomspace(0.25, 4, 12):
        w = np.exp(-0.5 * ((x[:, None] - x[None, :]) / width) ** 2)
        hat = w / w.sum(axis=1, keepdims=True)
        n, trace = len(x), float(np.trace(hat))
        if trace + 2 >= n:
            continue
        error = float(((y - hat @ y) ** 2).mean())
        aic = np.log(max(error, 1e-300)) + 1 + 2 * (trace + 1) / (n - trace - 2)
        best = min(best, (aic, width)) if best else (aic, width)
    return best[1] if best else base


def vsn_parameters(counts: DataFrame, min_cells: int = 5, gmean_eps: float = 1.0, ngenes: int = 2000, seed: int = 42) -> DataFrame:
    """``(gene, b0, b1, theta)`` for genes found in ``min_cells`` cells or more, smoothed over their geometric means.

    At most ``ngenes`` genes are fitted (drawn against their density, by keyed hashes), each in its own group;
    the curve over their means is bounded by that number and applied to all genes.
    """
    cells = materialize(counts.groupBy("cell").agg(F.sum("count").cast("double").alias("umi")), "cells")
    n = cells.count()
    expr = counts.select("gene", "cell", F.col("count").cast("double").alias("value"))
    kept = counts.groupBy("gene").agg(F.count_if(F.col("count") > 0).alias("k")).where(F.col("k") >= min_cells)
    logs = geometric_mean(expr, "gene", n, gmean_eps).join(kept, "gene", "left_semi").select("gene", F.log10("gmean").alias("g"))
    logs = materialize(logs, "means")  # a row a gene
    low, high = logs.agg(F.min("g"), F.max("g")).first()
    spark = counts.sparkSession
    empty = spark.createDataFrame([], "gene string, b0 double, b1 double, theta double")
    if low is None:
        return empty
    width = (high - low) / 30 or 1.0
    binned = logs.withColumn("bin", F.least(F.lit(29), F.floor((F.col("g") - low) / width)))
    dense = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("c"))
    chance = (F.pmod(F.xxhash64("gene", F.lit(seed)), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    drawn = binned.join(F.broadcast(dense), "bin").withColumn("o", -F.log(chance) * F.col("c")).orderBy("o", "gene").limit(ngenes).select("gene", "g")
    # zeros matter for the fit; a gene's entries come with their cells, the others are counted by depth
    depth = [r for r in cells.select(F.round(F.log10("umi"), 2).alias("d")).groupBy("d").count().orderBy("d").collect()]
    levels, sizes = np.array([r["d"] for r in depth]), np.array([r["count"] for r in depth], dtype=float)
    rows = expr.join(F.broadcast(drawn), "gene").join(cells, "cell").select("gene", "g", "value", F.round(F.log10("umi"), 2).alias("d"))
    rows = rows.groupBy("gene", "g", "value", "d").agg(F.count(F.lit(1)).alias("times"))  # a gene's task holds values by depth, not cells

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        y, x, times = frame["value"].to_numpy(), frame["d"].to_numpy(), frame["times"].to_numpy(dtype=float)
        zeros = np.maximum(sizes - pd.Series(times).groupby(x).sum().reindex(levels).fillna(0).to_numpy(), 0)
        y, x, times = np.concatenate([y, np.zeros(len(levels))]), np.concatenate([x, levels]), np.concatenate([times, zeros])
        y, x, times = y[times > 0], x[times > 0], times[times > 0]
        b = _poisson_line(y, x, times=times)
        theta = theta_ml(y, np.exp(np.clip(b[0] + b[1] * x, -30, 30)), times=times)
        return pd.DataFrame({"gene": frame["gene"].iloc[:1], "g": frame["g"].iloc[:1], "b0": b[0], "b1": b[1], "theta": max(theta, 1e-7)})

    kind = counts.schema["gene"].dataType.simpleString()
    fitted = rows.groupBy("gene").applyInPandas(fit, f"gene {kind}, g double, b0 double, b1 double, theta double").toPandas().sort_values("g")
    x = fitted["g"].to_numpy()
    values = {"b0": fitted["b0"].to_numpy(), "b1": fitted["b1"].to_numpy(), "theta": np.log10(fitted["theta"].to_numpy())}
    fine = np.ones(len(x), dtype=bool)
    for v in values.values():
        mid = np.median(v)
        fine &= np.abs(v - mid) / (1.4826 * np.median(np.abs(v - mid)) + 1e-9) <= 10
    knots = np.linspace(low, high, 200)
    curves = {k: _kernel_smooth(x[fine], v[fine], knots, _aic_width(x[fine], v[fine])) for k, v in values.items()}

    @F.pandas_udf("b0 double, b1 double, theta double")
    def smooth(g: pd.Series) -> pd.DataFrame:
        out = {k: np.interp(g.to_numpy(dtype=float), knots, c) for k, c in curves.items()}
        return pd.DataFrame({"b0": out["b0"], "b1": out["b1"], "theta": 10 ** out["theta"]})

    return logs.withColumn("p", smooth("g")).select("gene", "p.b0", "p.b1", "p.theta")


def vsn(counts: DataFrame, min_cells: int = 5, gmean_eps: float = 1.0, ngenes: int = 2000, seed: int = 42) -> DataFrame:
    """Counts corrected to the median depth through Pearson residuals; entries that round to 0 are dropped.

    A zero in a shallow cell may stand for more at the median depth, so every kept gene meets every cell; the result
    is about that large itself.
    """
    counts = materialize(counts, "counts")  # read for depths, means, fits and values
    pars = vsn_parameters(counts, min_cells, gmean_eps, ngenes, seed)
    cells = counts.groupBy("cell").agg(F.log10(F.sum("count").cast("double")).alias("d"))
    median = cells.agg(F.expr("percentile(d, 0.5)").alias("md"))
    grid = cells.join(F.broadcast(median)).crossJoin(pars)
    rows = grid.join(counts, ["gene", "cell"], "left").withColumn("y", F.coalesce("count", F.lit(0)).cast("double"))
    mu, to = F.exp(F.col("b0") + F.col("b1") * F.col("d")), F.exp(F.col("b0") + F.col("b1") * F.col("md"))
    residual = (F.col("y") - mu) / F.sqrt(mu + mu * mu / F.col("theta"))
    value = F.abs(F.bround(to + residual * F.sqrt(to + to * to / F.col("theta")), 0))
    return rows.select("gene", "cell", value.alias("value")).where("value <> 0")
