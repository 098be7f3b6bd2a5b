"""Count matrices made of the star schema's tables, for queries and tests.

gene x cell with summed quantities: M1 part x customer (sparse), M2 brand x supplier
(dense), M3 part name x supplier, M4 brand x customer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.session import table

#: Gene, cell and what must be joined to lineitem, by matrix.
SHAPES = {
    "m1": ("l_partkey", "o_custkey", ("orders",)),
    "m2": ("p_brand", "l_suppkey", ("part",)),
    "m3": ("p_name", "l_suppkey", ("part",)),
    "m4": ("p_brand", "o_custkey", ("part", "orders")),
}
JOINS = {"orders": "l_orderkey = o_orderkey", "part": "l_partkey = p_partkey"}


def sql(name: str) -> str:
    """The matrix as a query that DuckDB and Spark both run."""
    gene, cell, others = SHAPES[name]
    joins = " ".join(f"JOIN {o} ON {JOINS[o]}" for o in others)
    return f"SELECT {gene} AS gene, {cell} AS cell, CAST(SUM(l_quantity) AS BIGINT) AS count FROM lineitem {joins} GROUP BY {gene}, {cell}"


def matrix(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    gene, cell, others = SHAPES[name]
    rows = table(spark, sf_dir, "lineitem")
    for other in others:
        rows = rows.join(table(spark, sf_dir, other), F.expr(JOINS[other]))
    return rows.groupBy(F.col(gene).alias("gene"), F.col(cell).alias("cell")).agg(F.sum("l_quantity").cast("long").alias("count"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(cell, cluster)``: customers by market segment."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cell"), F.col("c_mktsegment").alias("cluster"))


def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(cell, batch)``: suppliers in three batches by nation."""
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("cell"), (F.col("s_nationkey") % 3).cast("int").alias("batch"))
