"""The data set: counts in long form, their two dimensions, and named results."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from quern.operators import qc

#: Results that a new one makes stale, by the key of the new one.
STALE = {"norm": ("hvg", "pca", "clusters", "embedding", "de"), "hvg": ("pca", "clusters", "embedding"), "pca": ("clusters", "embedding")}


class Dataset:
    """``counts(gene, cell, count)`` without zeros, ``cells`` and ``genes`` with statuses, and results by name.

    Filters change statuses only; :meth:`clean` applies them. Results are DataFrames, so nothing runs
    until one is read.
    """

    def __init__(self, counts: DataFrame, desc: str = ""):
        self.counts, self.desc = counts, desc
        self.cells = qc.cell_metrics(counts).withColumn("status", F.lit("OK"))
        self.genes = qc.gene_metrics(counts, F.lit(None)).withColumn("status", F.lit("OK"))
        self.results: dict[str, DataFrame] = {}
        self.assays: dict[str, dict] = {}

    @property
    def n_cells(self) -> int:
        return self.cells.count()

    def record(self, assay: str, **args) -> None:
        self.assays[assay] = args

    def put(self, key: str, df: DataFrame, **args) -> DataFrame:
        """Store a result as ``kind`` or ``kind/name``, dropping what it makes stale."""
        kind = key.split("/")[0]
        for old in [k for k in self.results if k.split("/")[0] in STALE.get(kind, ())]:
            self.delete(old)
        self.results[key] = df
        self.record(key, **args)
        return df

    def get(self, key: str) -> DataFrame:
        if key not in self.results:
            raise KeyError(f"no result {key!r}; there are {sorted(self.results)}")
        return self.results[key]

    def delete(self, key: str) -> None:
        self.results.pop(key).unpersist()
        self.assays.pop(key, None)

    def add_metadata(self, axis: str, key: str, data: DataFrame, kind: str = "cat") -> None:
        """Add column ``key`` of ``data(id, key)`` to cells or genes, by label."""
        if key == "status":
            raise ValueError("'status' is reserved")
        if axis not in ("cells", "genes") or kind not in ("cat", "cont"):
            raise ValueError("axis is cells or genes, kind is cat or cont")
        name = axis[:-1]
        value = F.col(key).cast("string" if kind == "cat" else "double").alias(key)
        setattr(self, axis, getattr(self, axis).join(data.select(name, value), name, "left"))

    def add_positional(self, axis: str, key: str, values: list, kind: str = "cat") -> None:
        """Add a list of values, one for each cell or gene in the order of their names."""
        name = axis[:-1]
        dim = getattr(self, axis)
        if len(values) != dim.count():
            raise ValueError(f"{len(values)} values for {dim.count()} {axis}")
        given = dim.sparkSession.createDataFrame(list(enumerate(values, 1)), ["_at", key])
        places = dim.select(name, F.row_number().over(Window.orderBy(name)).alias("_at"))
        self.add_metadata(axis, key, places.join(given, "_at").drop("_at"), kind)

    def clean(self, remove_low_quality: bool = True, remove_mito: bool = True) -> DataFrame:
        return qc.clean_matrix(self.counts, self.cells, self.genes, remove_low_quality, remove_mito)

    def describe(self) -> DataFrame:
        return qc.dims(self.counts, self.cells, self.genes)

    def low_quality_cells(self) -> DataFrame:
        return self.cells.where("status <> 'OK'").select("cell")

    @property
    def norm_data(self) -> dict[str, dict]:
        """The normalised matrices by name, each with the results made of it (``kind/name`` of that name)."""
        names = [k.partition("/")[2] or "norm" for k in self.results if k.split("/")[0] == "norm"]
        made = lambda n: {k.split("/")[0]: df for k, df in self.results.items() if (k.partition("/")[2] or "norm") == n}
        return {n: made(n) for n in names}

    def is_normalized(self) -> bool:
        return bool(self.norm_data)

    def print_dict(self) -> str:
        """The structure of :attr:`norm_data`, a name a line, results one tab further in."""
        return "\n".join(line for name, made in self.norm_data.items() for line in [name, *(f"\t{k}" for k in made)])

    def has_assay(self, key: str) -> bool:
        return key in self.assays

    def mem_usage(self, df: DataFrame | None = None) -> float:
        """Megabytes, by the optimizer's estimate of the plan's size; nothing is read."""
        plan = (self.counts if df is None else df)._jdf.queryExecution().optimizedPlan()
        return round(int(str(plan.stats().sizeInBytes())) / 1024 / 1024, 2)

    def save(self, path: str) -> None:
        """Parquet for each table, and a manifest; any path that Spark can write."""
        for name, df in {"counts": self.counts, "cells": self.cells, "genes": self.genes, **{f"results/{k}": v for k, v in self.results.items()}}.items():
            df.write.mode("overwrite").parquet(f"{path}/{name}")
        row = json.dumps({"desc": self.desc, "results": list(self.results), "assays": self.assays}, default=str)
        self.counts.sparkSession.createDataFrame([(row,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")

    @classmethod
    def load(cls, spark, path: str) -> Dataset:
        out = cls.__new__(cls)
        manifest = json.loads(spark.read.text(f"{path}/manifest").first()["value"])
        out.desc, out.assays = manifest["desc"], manifest["assays"]
        out.counts, out.cells, out.genes = (spark.read.parquet(f"{path}/{n}") for n in ("counts", "cells", "genes"))
        out.results = {k: spark.read.parquet(f"{path}/results/{k}") for k in manifest["results"]}
        return out
