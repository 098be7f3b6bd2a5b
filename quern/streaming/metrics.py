"""Quality metrics kept up to date while counts arrive in files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.operators import qc

SCHEMA = "gene string, cell string, count long"


def read_counts(spark: SparkSession, path: str, schema: str = SCHEMA) -> DataFrame:
    """A stream of parquet files with entries of the count matrix."""
    return spark.readStream.schema(schema).parquet(path)


def watch_cells(stream: DataFrame, table: str, checkpoint: str):
    """A started query that keeps each cell's reads and genes in the in-memory table ``table``; an entry must arrive once."""
    return qc.cell_metrics(stream).writeStream.outputMode("complete").format("memory").queryName(table).option("checkpointLocation", checkpoint).start()
