"""Multiple testing, bandwidths, robust scales and negative-binomial dispersion."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from quern.functions.special import digamma, trigamma


def bh_adjust(df: DataFrame, p: str = "p_val", out: str = "fdr", ranges: int = 64, by: list[str] | None = None) -> DataFrame:
    """Benjamini-Hochberg step-up; null p-values stay null but count in n.

    With ``by`` each group is adjusted alone. Without it nothing is sorted in one task: equal p-values are
    one row of a first aggregate, the distinct ones fall into ``ranges`` ranges with known counts below,
    and the running minimum from above is carried from range to range.
    """
    if by:
        n = F.count(F.lit(1)).over(Window.partitionBy(*by))
        upto = F.count(p).over(Window.partitionBy(*by).orderBy(F.col(p).asc_nulls_last()))
        steps = df.withColumn("_q", F.when(F.col(p).isNotNull(), n * F.col(p) / upto))
        down = Window.partitionBy(*by).orderBy(F.col(p).desc_nulls_last())
        return steps.withColumn(out, F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.min("_q").over(down)))).drop("_q")
    total = df.count()
    values = df.where(F.col(p).isNotNull()).groupBy(F.col(p).alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    edges = values.approxQuantile("_p", [i / ranges for i in range(1, ranges)], 0.5 / ranges) if total else []
    edges = sorted(set(edges))
    part = F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e < F.col("_p"))) if edges else F.lit(0)
    values = values.withColumn("_part", part)
    sums = values.groupBy("_part").agg(F.sum("_n").alias("_held"))
    sums = sums.withColumn("_below", F.coalesce(F.sum("_held").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = Window.partitionBy("_part").orderBy("_p")
    rows = values.join(F.broadcast(sums), "_part").withColumn("_q", F.lit(total) * F.col("_p") / (F.col("_below") + F.sum("_n").over(inside)))
    least = rows.groupBy("_part").agg(F.min("_q").alias("_min"))
    above = least.select("_part", F.min("_min").over(Window.orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)).alias("_above"))
    falling = Window.partitionBy("_part").orderBy(F.desc("_p"))
    adjusted = rows.join(F.broadcast(above), "_part").select("_p", F.least(F.lit(1.0), F.min("_q").over(falling), "_above").alias(out))
    return df.join(adjusted, df[p] == adjusted["_p"], "left").drop("_p")


def bonferroni(df: DataFrame, p: str = "p_val", out: str = "fdr") -> DataFrame:
    n = df.count()
    return df.withColumn(out, F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.col(p) * F.lit(n))))


def bw_nrd(df: DataFrame, value: str, by: list[str] = ()) -> DataFrame:
    """Scott's normal-reference bandwidth: 1.06 min(sd, IQR / 1.34) n^(-1/5), population sd."""
    iqr = F.expr(f"percentile({value}, 0.75) - percentile({value}, 0.25)")
    return df.groupBy(*by).agg((1.06 * F.least(F.stddev_pop(value), iqr / 1.34) * F.pow(F.count(value).cast("double"), -0.2)).alias("bw"))


def geometric_mean(expr: DataFrame, by: str, n: int, eps: float = 1.0, value: str = "value") -> DataFrame:
    """exp(mean(ln(x + eps))) - eps over ``n`` places; missing entries are zeros."""
    logs = F.sum(F.log(F.col(value) + eps)) + (n - F.count(F.lit(1))) * F.log(F.lit(eps))
    return expr.groupBy(by).agg((F.exp(logs / n) - eps).alias("gmean"))


MAD_SCALE = 1.4826


def robust_scale(df: DataFrame, value: str, by: str, out: str, eps: float = 1e-9) -> DataFrame:
    """(x - median) / (scaled MAD + eps) within each group."""
    mid = df.groupBy(by).agg(F.expr(f"percentile({value}, 0.5)").alias("_m"))
    apart = df.join(mid, by).withColumn("_d", F.abs(F.col(value) - F.col("_m")))
    mad = apart.groupBy(by).agg(F.expr("percentile(_d, 0.5)").alias("_mad"))
    return apart.join(mad, by).withColumn(out, (F.col(value) - F.col("_m")) / (F.col("_mad") * MAD_SCALE + eps)).drop("_m", "_d", "_mad")


def is_outlier(df: DataFrame, y: str, x: str, thres: float = 10.0, bins: int = 50) -> DataFrame:
    """Marks rows whose robust score of y is over ``thres`` in both of two shifted grids over x."""
    low, high = df.agg(F.min(x), F.max(x)).first()
    width = ((high or 0.0) - (low or 0.0)) / bins or 1.0
    grid = lambda shift: F.floor((F.col(x) - F.lit(low) + F.lit(shift)) / F.lit(width))
    out = df.withColumns({"_b1": grid(0.0), "_b2": grid(width / 2)})
    out = robust_scale(robust_scale(out, y, "_b1", "_s1"), y, "_b2", "_s2")
    score = F.least(F.abs("_s1"), F.abs("_s2"))
    return out.withColumns({"score": score, "outlier": score > thres}).drop("_b1", "_b2", "_s1", "_s2")


def theta_ml(y: np.ndarray, mu: np.ndarray, limit: int = 10, eps: float = 1e-8, times: np.ndarray | None = None) -> float:
    """Maximum-likelihood dispersion of a negative binomial with known means, by Newton's method; ``times`` counts equal rows."""
    times = np.ones(len(y)) if times is None else times
    theta = float(times.sum()) / max(float((times * ((y / mu) - 1) ** 2).sum()), 1e-12)
    for _ in range(limit):
        theta = abs(theta)
        slope = float((times * (digamma(theta + y) - digamma(theta) + np.log(theta) + 1 - np.log(theta + mu) - (y + theta) / (mu + theta))).sum())
        curve = float((times * (-trigamma(theta + y) + trigamma(theta) - 1 / theta + 2 / (mu + theta) - (y + theta) / (mu + theta) ** 2)).sum())
        if not curve:
            break
        step = slope / curve
        theta += step
        if abs(step) < eps:
            break
    return max(theta, 0.0)
