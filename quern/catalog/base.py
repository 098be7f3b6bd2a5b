"""Helpers of the registry: registering, rounding, shared inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators import norm
from quern.plans import surrogates
from quern.session import table


def registry():
    """``(queries, sql, add)``; ``add(sql)`` registers the function below it, without SQL if None."""
    queries, sqls = {}, {}

    def add(sql: str | None = None):
        def register(f):
            queries[f.__name__] = f
            if sql:
                sqls[f.__name__] = sql.strip()
            return f

        return register

    return queries, sqls, add


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), places) for c in columns})


def log_expr(spark, sf, name: str) -> DataFrame:
    """log2(standard + 1) of a matrix."""
    return norm.log_transform(norm.standard(surrogates.matrix(spark, sf, name)))


def raw_expr(spark, sf, name: str) -> DataFrame:
    return surrogates.matrix(spark, sf, name).select("gene", "cell", F.col("count").cast("double").alias("value"))


def n_cells(expr: DataFrame) -> int:
    return expr.select("cell").distinct().count()


def vectors(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))


def ctes(name: str, log: bool = False) -> str:
    """``WITH m AS (matrix)``, and ``e`` with its log2(standard + 1)."""
    out = f"WITH m AS ({surrogates.sql(name)})"
    if log:
        out += """, e AS (
  SELECT gene, m.cell, log2(count / t * 10000.0 + 1) AS value
  FROM m JOIN (SELECT cell, SUM(count) AS t FROM m GROUP BY cell) x ON m.cell = x.cell)"""
    return out


SEG = "seg AS (SELECT c_custkey AS cell, c_mktsegment AS cluster FROM customer)"
BATCH = "bat AS (SELECT s_suppkey AS cell, CAST(s_nationkey % 3 AS INTEGER) AS batch FROM supplier)"
