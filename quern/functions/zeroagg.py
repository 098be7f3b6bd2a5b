"""Aggregates over sparse rows in which a missing entry is a zero.

``n`` is the length of the full vector. Everything is computed from the entries
present, so nothing is made dense.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def mean0(value, n) -> Column:
    return F.sum(value) / n


def var0(value, n, ddof: int = 1) -> Column:
    """Variance with zeros: spread within the entries plus that between them and the zeros."""
    k, m = F.count(value), F.avg(value)
    squares = k * F.coalesce(F.var_pop(value), F.lit(0.0)) + k * (n - k) / n * m * m
    return squares / (n - ddof)


def row_stats(expr: DataFrame, by: str, n: int, value: str = "value") -> DataFrame:
    """``(by, mean, var, nnz, total)`` with ddof 1; rows without entries are absent."""
    n = F.lit(float(n))
    return expr.where(F.col(value) != 0).groupBy(by).agg(
        mean0(value, n).alias("mean"), var0(value, n).alias("var"), F.count(value).alias("nnz"), F.sum(value).alias("total")
    )


def group_median(expr: DataFrame, keys: list[str], sizes: DataFrame, size_keys: list[str], value: str = "value") -> DataFrame:
    """Exact medians of non-negative values by ``keys`` over groups of ``sizes(size_keys, n)`` members.

    Only groups with an entry are returned; fewer than half entries means 0. The two middle places are
    found among the sorted entries, shifted by the number of zeros.
    """
    order = Window.partitionBy(*keys).orderBy(value)
    whole = Window.partitionBy(*keys)
    rows = expr.where(F.col(value) != 0).join(F.broadcast(sizes), size_keys)
    rows = rows.withColumn("_at", F.row_number().over(order) + F.col("n") - F.count(F.lit(1)).over(whole))
    middle = (F.col("_at") == F.floor((F.col("n") + 1) / 2)) | (F.col("_at") == F.floor((F.col("n") + 2) / 2))
    twice = F.when(F.pmod(F.col("n"), F.lit(2)) == 1, F.col(value) * 2).otherwise(F.col(value))
    return rows.groupBy(*keys).agg((F.coalesce(F.sum(F.when(middle, twice)), F.lit(0.0)) / 2).alias("median"))


def average_ranks(df: DataFrame, keys: list[str], value: str, out: str = "rank") -> DataFrame:
    """Ranks from 1 with ties sharing their average."""
    order = Window.partitionBy(*keys).orderBy(value)
    ties = Window.partitionBy(*keys, value)
    return df.withColumn(out, F.rank().over(order) + (F.count(F.lit(1)).over(ties) - 1) / F.lit(2.0))
