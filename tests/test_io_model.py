"""Files, the data set and its manifest, streaming metrics, and what must not be imported."""

import ast
import bz2
import gzip
import io
import lzma
import os
import tarfile
import time
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

import quern
from quern.operators import qc, views
from quern.plans.components import components
from quern.plans.model import Dataset
from quern.sources import matrices as files
from quern.streaming import metrics

TEXT = 'gene c1 c2 c3\n"a" 4 0 6\nb 0 2 2\ndup 1 1 1\ndup 2 2 2\nArrayControl-12 5 5 5\nc 5 3 0\n'
WANT = {("a", "c1", 4), ("a", "c3", 6), ("b", "c2", 2), ("b", "c3", 2), ("c", "c1", 5), ("c", "c2", 3)}


def test_text_matrices_in_all_packings(spark, tmp_path):
    def packed(name):
        path = str(tmp_path / name)
        data = TEXT.encode()
        if name.endswith(".zip"):
            with zipfile.ZipFile(path, "w") as z:
                z.writestr("m.txt", data)
        else:
            data = {"gz": gzip.compress, "bz2": bz2.compress, "xz": lzma.compress}.get(name.rsplit(".", 1)[-1], bytes)(data)
            with open(path, "wb") as f:
                f.write(data)
        return path

    for name in ("m.txt", "m.txt.gz", "m.txt.bz2", "m.txt.xz", "m.zip"):
        assert {tuple(r) for r in files.read_matrix(spark, packed(name)).collect()} == WANT, name
    short = tmp_path / "short.csv"
    short.write_text("c1,c2,c3\na,4,0,6\nb,0,2.7,2\n")
    with pytest.raises(ValueError):
        files.read_text(spark, str(short)).count()
    assert {tuple(r) for r in files.read_text(spark, str(short), do_round=True).collect()} == {("a", "c1", 4), ("a", "c3", 6), ("b", "c2", 2), ("b", "c3", 2)}
    flipped = files.read_text(spark, packed("m.txt"), flip=True)
    assert {(r.cell, r.gene, r["count"]) for r in flipped.collect()} == WANT


def test_matrix_market(spark, tmp_path):
    def archive(path, parts):
        with tarfile.open(path, "w:gz") as tar:
            for name, text in parts.items():
                data = gzip.compress(text.encode())
                info = tarfile.TarInfo(f"x/{name}")
                info.size = len(data)
                tar.addfile(info, io.BytesIO(data))
        return str(path)

    parts = {
        "matrix.mtx.gz": "%%MatrixMarket matrix coordinate integer general\n% note\n3 2 4\n1 1 4\n3 1 5\n2 2 2\n3 2 3\n",
        "barcodes.tsv.gz": "c1\nc2\n",
        "genes.tsv.gz": "id1\ta\nid2\tb\n\tskip\nid3\tc\n",
    }
    path = archive(tmp_path / "m.tar.gz", parts)
    for n in (1, 3):
        assert {tuple(r) for r in files.read_matrix(spark, path, partitions=n).collect()} == {("a", "c1", 4), ("c", "c1", 5), ("b", "c2", 2), ("c", "c2", 3)}
    bad = archive(tmp_path / "bad.tar.gz", {k: v for k, v in parts.items() if k != "genes.tsv.gz"})
    with pytest.raises(Exception, match="exactly"):
        files.read_matrix(spark, bad).count()


def test_side_files_and_exports(spark, tmp_path):
    (tmp_path / "l.txt").write_text("a 1000\nb\nc 500\n")
    assert {tuple(r) for r in files.read_gene_lengths(spark, str(tmp_path / "l.txt")).collect()} == {("a", 1000.0), ("c", 500.0)}
    assert files.read_list(spark, str(tmp_path / "l.txt")).count() == 3
    (tmp_path / "s.tsv").write_text("ENS1\tAbc\nENS2\tDef\n")
    symbols = files.read_symbols(spark, str(tmp_path / "s.tsv"))
    genes = spark.createDataFrame([("ENS1.7",), ("ENS3.1",)], "gene string")
    assert {r.new_gene for r in qc.symbol_switch(genes, symbols).collect()} == {"Abc_ENS1", "NA_ENS3"}
    assert files.read_first_column(spark, str(tmp_path / "s.tsv")).count() == 2
    expr = spark.createDataFrame([("a", "c1", 1.239), ("b", "c2", 2.0)], "gene string, cell string, value double")
    files.export_normalised(expr, str(tmp_path / "out"), upper=True, compression="gzip")
    back = spark.read.csv(str(tmp_path / "out"), sep="\t", header=True, inferSchema=True).orderBy("gene")
    assert [tuple(r) for r in back.collect()] == [("A", 1.24, 0.0), ("B", 0.0, 2.0)]
    assert files.wide(expr, transpose=True).columns == ["cell", "a", "b"]
    comp = spark.createDataFrame([("c1", [1.0, 2.0])], "cell string, comp array<double>")
    files.export_vectors(comp, str(tmp_path / "pca"))
    assert spark.read.csv(str(tmp_path / "pca"), sep="\t", header=True).columns == ["cell", "comp1", "comp2"]


def test_export_of_more_cells_than_a_pivot_takes(spark, tmp_path):
    rows = [(g, f"c{c}", float(c + 1)) for c in range(12_000) for g in (["a", 'b"x'] if c % 2 else ["a"])]
    expr = spark.createDataFrame(pd.DataFrame(rows, columns=["gene", "cell", "value"]))
    files.export_normalised(expr, str(tmp_path / "wide"), sep=",", compression="gzip")
    got = files.read_text(spark, str(tmp_path / "wide"), sep=",").toPandas()
    assert len(got) == 18_000 and set(got["gene"]) == {"a", "b\\x"} and (got["cell"] == "c" + (got["count"] - 1).astype(str)).all()


def test_dataset(spark, tmp_path):
    counts = spark.createDataFrame(list(WANT) + [("ERCC-1", "c1", 2), ("mt-a", "c2", 3)], "gene string, cell string, count long")
    data = Dataset(counts, "test")
    assert data.n_cells == 3
    data.genes = qc.find_ercc(qc.find_mitochondrial(data.genes))
    data.cells = qc.filter_cells(data.cells, 9)
    assert {r.cell for r in data.low_quality_cells().collect()} == {"c2", "c3"}
    assert {tuple(r) for r in data.clean().select("gene", "cell", "count").collect()} == {("a", "c1", 4), ("c", "c1", 5), ("ERCC-1", "c1", 2)}
    assert data.describe().first().cells_ok == 1
    data.add_metadata("cells", "kind", spark.createDataFrame([("c1", "x")], "cell string, kind string"))
    assert data.cells.where("kind = 'x'").count() == 1
    data.add_positional("cells", "age", [1.5, 2.5, 3.5], "cont")
    assert {r.cell: r.age for r in data.cells.collect()} == {"c1": 1.5, "c2": 2.5, "c3": 3.5}
    with pytest.raises(ValueError):
        data.add_positional("genes", "x", [1])
    with pytest.raises(ValueError):
        data.add_metadata("cells", "status", data.cells)
    data.put("norm/standard", counts)
    data.put("hvg", counts.select("gene"))
    assert data.is_normalized() and list(data.norm_data) == ["standard"] and data.print_dict() == "standard\n\tnorm"
    assert data.has_assay("hvg") and not data.has_assay("de") and data.mem_usage() >= 0
    data.put("pca", counts)
    data.put("hvg", counts.select("gene"))
    assert "pca" not in data.results
    data.save(str(tmp_path / "d"))
    again = Dataset.load(spark, str(tmp_path / "d"))
    assert again.desc == "test" and set(again.results) == {"norm/standard", "hvg"} and again.counts.count() == 8
    with pytest.raises(KeyError):
        again.get("pca")


def test_components_of_paths_stars_and_strings(spark):
    pairs = [(f"n{i:03}", f"n{i + 1:03}") for i in range(100)] + [("z", f"y{i}") for i in range(50)] + [("q", "q"), (None, "z")]
    got = {r.id: r.root for r in components(spark.createDataFrame(pairs, "u string, v string")).collect()}
    assert {got[f"n{i:03}"] for i in range(101)} == {"n000"} and {got[f"y{i}"] for i in range(50)} == {"y0"} and got["z"] == "y0" and "q" not in got
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_streaming_metrics(spark, tmp_path):
    rows = spark.createDataFrame(list(WANT), metrics.SCHEMA)
    folder = str(tmp_path / "in")
    rows.where("gene = 'a'").write.parquet(folder)
    query = metrics.watch_cells(metrics.read_counts(spark, folder), "cells_live", str(tmp_path / "ck"))
    try:
        query.processAllAvailable()
        rows.where("gene <> 'a'").write.mode("append").parquet(folder)
        time.sleep(0.2)
        query.processAllAvailable()
        got = {tuple(r) for r in spark.table("cells_live").collect()}
    finally:
        query.stop()
    assert got == {tuple(r) for r in qc.cell_metrics(rows).collect()}


def test_views(spark):
    embedding = spark.createDataFrame([("c1", 0.0, 1.0), ("c2", 2.0, 3.0)], "cell string, x double, y double")
    clusters = spark.createDataFrame([("c1", 0), ("c2", 1)], "cell string, cluster int")
    expr = spark.createDataFrame([("ab", "c1", 2.0), ("abc", "c1", 1.0)], "gene string, cell string, value double")
    got = views.cell_view(embedding, clusters, None, expr, "^ab$").orderBy("cell").collect()
    assert [(r.label, r.expression) for r in got] == [("0 (n=1)", 2.0), ("1 (n=1)", 0.0)]
    with pytest.raises(ValueError):
        views.cell_view(embedding, expr=expr, gene="ab")
    assert len(set(views.distinct_colours(12))) == 12
    assert views.top_genes(expr, clusters, 1, F.median).count() == 1


def test_nothing_outside_imports_the_training_data_package():
    root = os.path.dirname(quern.__file__)
    for folder, _, names in os.walk(root):
        if os.path.relpath(folder, root).split(os.sep)[0] == "llm":
            continue
        for name in names:
            if name.endswith(".py"):
                with open(os.path.join(folder, name)) as f:
                    tree = ast.parse(f.read())
                for node in ast.walk(tree):
                    found = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
                    assert not any("llm" in x for x in found), name
