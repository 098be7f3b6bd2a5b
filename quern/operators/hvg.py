"""Highly variable genes: five selections over per-gene summaries."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from quern.functions import special
from quern.functions.stats import bh_adjust
from quern.functions.zeroagg import row_stats
from quern.plans.scratch import materialize


def unlog(expr: DataFrame) -> DataFrame:
    return expr.withColumn("value", F.pow(F.lit(2.0), "value") - 1)


def seurat_scores(stats: DataFrame, num_bins: int = 20) -> DataFrame:
    """``(gene, mean, dispersion, bin, z)`` from per-gene ``mean`` and ``var``: dispersion scored within equal-width bins of the mean."""
    rows = stats.where("mean > 0").select("gene", "mean", (F.col("var") / F.col("mean")).alias("dispersion"))
    ends = rows.agg(F.min("mean").alias("_lo"), F.max("mean").alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / num_bins
    place = F.when(width > 0, F.ceil((F.col("mean") - F.col("_lo")) / F.nullif(width, F.lit(0.0)))).otherwise(1)
    rows = rows.join(F.broadcast(ends)).withColumn("bin", F.greatest(F.lit(1), F.least(F.lit(num_bins), place)).cast("int")).drop("_lo", "_hi")
    by_bin = rows.groupBy("bin").agg(F.avg("dispersion").alias("_m"), F.stddev_samp("dispersion").alias("_s"))
    z = (F.col("dispersion") - F.col("_m")) / F.nullif(F.col("_s"), F.lit(0.0))
    return rows.join(F.broadcast(by_bin), "bin").select("gene", "mean", "dispersion", "bin", z.alias("z"))


def seurat(expr: DataFrame, n_cells: int, ngenes: int = 1000, num_bins: int = 20) -> DataFrame:
    scored = seurat_scores(row_stats(expr, "gene", n_cells), num_bins)
    return scored.withColumn("z", F.round("z", 6)).orderBy(F.col("z").desc_nulls_last(), "gene").limit(ngenes)


def technical_fit(stats: DataFrame) -> tuple[float, float]:
    """CV2 ~ a0 + a1 / mean on genes whose mean is at least the 80 % quantile of those with CV2 over 0.3.

    The weighting is that of a quasi-likelihood with identity link and variance equal to the mean.
    """
    rows = stats.where("mean > 0").withColumn("cv2", F.col("var") / (F.col("mean") * F.col("mean"))).where("cv2 IS NOT NULL")
    cut = rows.where("cv2 > 0.3").agg(F.expr("percentile(mean, 0.8)")).first()[0]
    fit = rows.where(F.col("mean") >= F.lit(cut)) if cut is not None else rows
    if cut is None or fit.count() < 20:
        cut = rows.agg(F.expr("percentile(mean, 0.8)")).first()[0]
        fit = rows.where(F.col("mean") >= F.lit(cut))
    design = materialize(fit.select(F.col("cv2").alias("y"), (1 / F.col("mean")).alias("x")).where("y > 0"), "design")  # read once a step
    a0, a1 = 0.1, 1.0
    for _ in range(100):  # Fisher scoring; each step is one aggregate of five sums
        mu = F.greatest(F.lit(1e-8), F.lit(a0) + F.lit(a1) * F.col("x"))
        w = 1 / mu
        s = design.agg(F.sum(w), F.sum(w * F.col("x")), F.sum(w * F.col("x") * F.col("x")), F.sum(w * F.col("y")), F.sum(w * F.col("x") * F.col("y"))).first()
        if s[0] is None:
            return 0.0, 0.0
        det = s[0] * s[2] - s[1] ** 2
        if abs(det) < 1e-300:
            return s[3] / s[0], 0.0
        n0, n1 = (s[2] * s[3] - s[1] * s[4]) / det, (s[0] * s[4] - s[1] * s[3]) / det
        done = abs(n0 - a0) + abs(n1 - a1) < 1e-8 * (abs(a0) + abs(a1) + 1e-8)
        a0, a1 = n0, n1
        if done:
            break
    return a0, a1


def brennecke_stat(stats: DataFrame, m: int, a0: float, a1: float, min_disp: float = 0.5) -> DataFrame:
    """``(gene, mean, cv2, chi2)``: the statistic has m - 1 degrees of freedom."""
    threshold = a0 + min_disp**2 + a0 * min_disp**2
    mean = F.col("mean")
    expected = (mean * a1 + mean * mean * threshold) / (1 + threshold / m)
    return stats.where("mean > 0").select("gene", "mean", (F.col("var") / (mean * mean)).alias("cv2"), (F.col("var") * (m - 1) / expected).alias("chi2"))


def brennecke(expr: DataFrame, n_cells: int, spikes: DataFrame | None = None, fdr: float = 0.1, ngenes: int | None = 1000, logged: bool = True, min_disp: float = 0.5) -> DataFrame:
    """Genes whose variation is over the technical one, fitted to ``spikes`` if given, else to all genes."""
    raw = unlog if logged else lambda e: e
    stats = materialize(row_stats(raw(expr), "gene", n_cells), "stats")  # a row a gene
    a0, a1 = technical_fit(materialize(row_stats(raw(spikes), "gene", n_cells), "stats") if spikes is not None else stats)
    udf = special.udfs()["chisq_sf"]
    tested = brennecke_stat(stats, n_cells, a0, a1, min_disp).withColumn("p_val", udf("chi2", F.lit(float(n_cells - 1))))
    out = bh_adjust(materialize(tested, "tested")).where(F.col("fdr") < fdr).orderBy("p_val", F.desc("chi2"), "gene")
    return out.limit(ngenes) if ngenes else out


def scran(expr: DataFrame, n_cells: int, spikes: DataFrame | None = None, ngenes: int = 1000, logged: bool = True) -> DataFrame:
    """Variance above a polynomial of degree 4 through ln(variance + 1) of the spikes; needs spikes."""
    if spikes is None:
        raise ValueError("this method needs spike-in genes")
    raw = unlog if logged else lambda e: e
    stats, tech = row_stats(raw(expr), "gene", n_cells), row_stats(raw(spikes), "gene", n_cells)
    known = tech.select("mean", F.log1p("var").alias("v")).where("v IS NOT NULL").toPandas()  # spikes are a few dozen
    degree = min(4, max(0, known["mean"].nunique() - 1))
    shape = np.polynomial.Polynomial.fit(known["mean"], known["v"], degree).convert().coef
    trend = sum((F.lit(float(c)) * F.pow("mean", F.lit(float(i))) for i, c in enumerate(shape)), F.lit(0.0))
    return stats.select("gene", "mean", "var", (F.col("var") - trend).alias("bio")).orderBy(F.desc("bio"), "gene").limit(ngenes)


def log_cv(stats: DataFrame) -> DataFrame:
    """``(gene, x, y)``: log10 of mean and of the coefficient of variation."""
    return stats.where("mean > 0 AND var > 0").select("gene", F.log10("mean").alias("x"), F.log10(F.sqrt("var") / F.col("mean")).alias("y"))


def cv_fit(points: DataFrame) -> DataFrame:
    """One row: slope and intercept of y on x."""
    return points.agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.count(F.lit(1)).alias("n"))


def window_counts(points: DataFrame, half: float = 0.05, step: float = 0.005) -> DataFrame:
    """``(g, n)``: genes within ``half`` of each grid place between the ends of x.

    Each gene explodes to the few grid places it counts for (2 half / step), so no range join is needed.
    """
    low, high = points.agg(F.min("x"), F.max("x")).first()
    if low is None:
        return points.sparkSession.createDataFrame([], "g long, n long")
    last = int(math.floor((high - low) / step + 1e-9))
    first = F.greatest(F.lit(0), F.ceil((F.col("x") - half - low) / step - 1e-9)).cast("long")
    until = F.least(F.lit(last), F.floor((F.col("x") + half - low) / step + 1e-9)).cast("long")
    return points.select(first.alias("a"), until.alias("b")).where("a <= b").select(F.explode(F.sequence("a", "b")).alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("n"))


def _parabola(points: DataFrame):
    """The least-squares polynomial of degree 2 (less for fewer different x) through all ``points(x, y)``, from sums of powers."""
    base = points.agg(F.avg("x"), F.stddev_pop("x"), F.count_distinct("x")).first()
    centre, scale, degree = base[0], base[1] or 1.0, min(2, max(0, base[2] - 1))
    z = (F.col("x") - centre) / scale
    sums = points.agg(*[F.sum(F.pow(z, F.lit(k))) for k in range(2 * degree + 1)], *[F.sum(F.pow(z, F.lit(k)) * F.col("y")) for k in range(degree + 1)]).first()
    left = np.array([[sums[i + j] for j in range(degree + 1)] for i in range(degree + 1)], dtype=float)
    coef = np.linalg.lstsq(left, np.array(sums[2 * degree + 1 :], dtype=float), rcond=None)[0]
    return lambda x: np.polynomial.polynomial.polyval((x - centre) / scale, coef)


def chen2016(expr: DataFrame, n_cells: int, fdr: float = 0.1, ngenes: int | None = 1000, logged: bool = True, bins: int = 4000) -> DataFrame:
    """Genes far above the CV-mean curve. The curve comes from sums over all genes, the null from a histogram of all distances."""
    points = log_cv(row_stats(unlog(expr) if logged else expr, "gene", n_cells))
    points = materialize(points, "cv")
    total = points.count()
    if total < 3:
        return points.sparkSession.createDataFrame([], points.schema.add("distance", "double").add("p_val", "double").add("fdr", "double"))
    low = points.agg(F.min("x")).first()[0]
    usable = window_counts(points).where(F.col("n") > 0.005 * total).agg(F.min("g"), F.max("g")).first()
    near = points.where(F.col("x").between(low + (usable[0] or 0) * 0.005 - 0.05, low + (usable[1] or 0) * 0.005 + 0.05))
    curve = _parabola(near)

    def signed(x, y):
        steps = np.arange(-0.2, 0.2005, 0.001)
        out = np.empty(len(x))
        for lo in range(0, len(x), 4096):
            grid = x[lo : lo + 4096, None] + steps[None, :]
            gap = np.sqrt(steps[None, :] ** 2 + (curve(grid) - y[lo : lo + 4096, None]) ** 2)
            out[lo : lo + 4096] = gap.min(axis=1)
        return np.where(y >= curve(x), out, -out)

    @F.pandas_udf("double")
    def distance(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(signed(x.to_numpy(dtype=float), y.to_numpy(dtype=float)))

    far = materialize(points.withColumn("distance", distance("x", "y")), "cv-distance")
    d = far.join(near.select("gene"), "gene", "left_semi")
    ends = d.agg(F.min("distance"), F.max("distance"), F.stddev_pop("distance"), F.count(F.lit(1)), F.percentile_approx("distance", [0.01, 0.99], 10_000)).first()
    first, step = ends[0], (ends[1] - ends[0]) / bins or 1.0
    at = F.least(F.floor((F.col("distance") - first) / step), F.lit(bins - 1))
    held = d.groupBy(at.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n")).toPandas()  # ``bins`` rows at most
    middle, weight = first + (held["bin"].to_numpy() + 0.5) * step, held["n"].to_numpy()
    grid = np.linspace(*ends[4], 401)
    width = 1.06 * ends[2] * ends[3] ** -0.2 or 1.0
    mode = float(grid[(weight * np.exp(-0.5 * ((grid[:, None] - middle[None, :]) / width) ** 2)).sum(axis=1).argmax()])
    left = F.when(F.col("distance") <= mode, F.col("distance") - mode)
    spread = math.sqrt(d.agg(F.avg(left * left)).first()[0] or 0.0) or 1e-12

    @F.pandas_udf("double")
    def tail(dist: pd.Series) -> pd.Series:
        return pd.Series(special.norm_sf((dist.to_numpy(dtype=float) - mode) / spread))

    tested = far.select("gene", "x", "y", "distance", tail("distance").alias("p_val"))
    out = bh_adjust(tested).where(F.col("fdr") < fdr).orderBy("p_val", F.desc("distance"), "gene")
    return out.limit(ngenes) if ngenes else out


def dropout_points(expr: DataFrame, n_cells: int) -> DataFrame:
    """``(gene, s, p, p_err, s_err)``: mean, dropout rate and their standard errors."""
    n = float(n_cells)
    rows = expr.where("value <> 0").groupBy("gene").agg(
        (F.sum("value") / n).alias("s"), (1 - F.count(F.lit(1)) / n).alias("p"), (F.sum(F.col("value") * F.col("value")) / n).alias("q")
    )
    rows = rows.withColumns({"p_err": F.sqrt(F.col("p") * (1 - F.col("p")) / n), "s_err": F.sqrt(F.greatest(F.lit(0.0), F.col("q") - F.col("s") * F.col("s")) / n)})
    least = rows.where("p > 0").agg(F.min("p").alias("_l"))
    return rows.join(F.broadcast(least)).select("gene", "s", F.when(F.col("p") == 0, F.col("_l") / 2).otherwise(F.col("p")).alias("p"), (F.col("p") == 0).alias("always"), "p_err", "s_err")


def mm_z(points: DataFrame, k: float) -> DataFrame:
    """``(gene, s, p, z)`` given the Michaelis constant: the deviation of each gene's own constant."""
    own = F.col("p") * F.col("s") / (1 - F.col("p"))
    err = F.abs(own) * F.sqrt(F.pow(F.col("s_err") / F.col("s"), 2) + F.pow(F.col("p_err") / F.col("p"), 2))
    rows = points.withColumns({"l": F.log(own), "e": F.when(own - err > 0, F.abs(F.log(F.when(own - err > 0, own - err).otherwise(1.0)) - F.log(own))).otherwise(1e10)})
    spread = rows.agg((F.stddev_pop(F.col("l") - math.log(k)) / F.sqrt(F.count(F.lit(1)).cast("double"))).alias("_k"))
    z = (F.col("l") - math.log(k)) / F.sqrt(F.col("e") * F.col("e") + F.col("_k") * F.col("_k"))
    return rows.join(F.broadcast(spread)).select("gene", "s", "p", "always", z.alias("z"))


def michaelis_constant(points: DataFrame, rounds: int = 40) -> float:
    """Least squares of p on 1 - s / (K + s), by golden section over ln K; a round is one aggregate of two sums."""
    low, high = points.agg(F.log(F.min("s")), F.log(F.max("s"))).first()
    if low is None:
        return 1.0
    low, high, gold = low - 5, high + 5, (math.sqrt(5) - 1) / 2

    def errors(*ks):
        return points.agg(*[F.sum(F.pow(F.col("p") - 1 + F.col("s") / (math.exp(k) + F.col("s")), 2)) for k in ks]).first()

    grid = [low + (high - low) * i / 32 for i in range(33)]
    at = int(np.argmin(errors(*grid)))
    low, high = grid[max(0, at - 1)], grid[min(32, at + 1)]
    for _ in range(rounds):
        a, b = high - gold * (high - low), low + gold * (high - low)
        x, y = errors(a, b)
        low, high = (low, b) if x < y else (a, high)
        if high - low < 1e-10:
            break
    return math.exp((low + high) / 2)


def mm(expr: DataFrame, n_cells: int, ngenes: int | None = 1000, fdr: float | None = None, logged: bool = True) -> DataFrame:
    """Genes with more dropouts than a Michaelis-Menten curve of their mean; ``fdr`` None keeps the top ones only."""
    points = materialize(dropout_points(unlog(expr) if logged else expr, n_cells), "points")  # a row a gene, read once a round
    rows = mm_z(points, michaelis_constant(points))
    rows = rows.withColumn("p_val", F.when(F.col("always"), 1.0).otherwise(special.udfs()["normal_sf"]("z"))).drop("always")
    rows = bh_adjust(materialize(rows, "tested"))
    rows = rows.where(F.col("fdr") < fdr) if fdr else rows
    rows = rows.orderBy("p_val", F.desc("z"), "gene")
    return rows.limit(ngenes) if ngenes else rows


METHODS = {"seurat": seurat, "brennecke": brennecke, "scran": scran, "chen2016": chen2016, "mm": mm}


def find_hvg(expr: DataFrame, n_cells: int, method: str = "seurat", ngenes: int = 1000, **args) -> DataFrame:
    """Names of the selected genes in order of rank: ``(gene, rank)``."""
    if method not in METHODS:
        raise ValueError(f"no method {method!r}; there are {sorted(METHODS)}")
    out = METHODS[method](expr, n_cells, ngenes=ngenes, **args)
    keys = {"seurat": [F.col("z").desc_nulls_last()], "scran": [F.desc("bio")]}.get(method, [F.col("p_val")])
    return out.select("gene", F.row_number().over(Window.orderBy(*keys, "gene")).alias("rank"))
