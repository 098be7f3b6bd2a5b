"""From a text file to annotated clusters, as an analyst would go."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import Window

from quern.operators import bio, de, graph, hvg, norm, qc, reduce
from quern.plans.model import Dataset
from quern.sources import matrices as files


def test_from_file_to_cell_types(spark, tmp_path):
    rnd = np.random.default_rng(20)
    types = {"A": range(0, 15), "B": range(15, 30), "C": range(30, 45)}
    cells = [(t, i) for t in types for i in range(40)] + [("low", 0)]
    table = {f"g{g}": [0 if t == "low" else rnd.poisson(15 if g in types[t] else 0.4) for t, _ in cells] for g in range(60)}
    table |= {"mt-1": [rnd.poisson(5) for _ in cells], "ERCC-1": [rnd.poisson(8) for _ in cells], "rare": [1] + [0] * (len(cells) - 1)}
    lines = [" ".join(f"{t}{i}" for t, i in cells)] + [" ".join([g, *map(str, v)]) for g, v in table.items()]
    (tmp_path / "m.txt").write_text("\n".join(lines) + "\n")

    data = Dataset(files.read_matrix(spark, str(tmp_path / "m.txt")), "walkthrough")
    data.cells = qc.filter_cells(data.cells, 100)
    data.genes = qc.find_ercc(qc.find_mitochondrial(qc.filter_genes(data.genes, 5)))
    assert {r.cell for r in data.low_quality_cells().collect()} == {"low0"}
    assert {r.gene for r in data.genes.where("status <> 'OK'").collect()} == {"rare", "ERCC-1"}
    expr, spikes = norm.normalise(data.clean(), spikes=data.genes.where("ercc"))
    data.put("norm/standard", expr.cache(), method="standard")
    assert spikes.select("gene").distinct().count() == 1 and expr.where("gene = 'mt-1'").count() == 0
    data.put("hvg", hvg.find_hvg(expr, 120, "seurat", 40))
    genes = [r.gene for r in data.get("hvg").orderBy("rank").collect()]
    comp, _ = reduce.pca(expr, genes, 10, n_cells=120)
    data.put("pca", comp)
    index = comp.select("cell", F.row_number().over(Window.orderBy("cell")).cast("long").alias("id"), F.col("comp").alias("v")).cache()
    found = graph.generate(index.select("id", "v"), 10, "leiden")
    clusters = found.join(index, "id").select("cell", "cluster").cache()
    data.put("clusters/leiden", clusters)
    by = {r.cell: r.cluster for r in clusters.collect()}
    assert len({(c[0], k) for c, k in by.items()}) == 3 and len(set(by.values())) == 3
    tests = de.linear_model(expr, clusters).cache()
    kept = de.filter_tests(de.combine_tests(tests, "fisher"), expr, clusters, 0.01, 0.5)
    top = {(r.cluster, r.gene) for r in kept.collect()}
    for t, own in types.items():
        k = by[f"{t}0"]
        assert len({g for c, g in top if c == k} & {f"g{g}" for g in own}) >= 12
    assert de.summary(kept).where("n_clusters >= 1").count() >= 36
    markers = spark.createDataFrame([(f"g{g}", t) for t, own in types.items() for g in own], "gene string, cell_type string")
    best, every = bio.predict_cell_types(expr, clusters, markers)
    assert {r.cell_type for r in best.collect()} == {"A", "B", "C"}
    data.put("cell_type_pred/leiden", best)
    data.put("cell_type_pred_full/leiden", every)
    data.put("embedding/tsne", reduce.tsne(comp, n_iter=50))
    for what in ("normalized", "clusters", "pca", "tsne", "cell_type_pred", "cell_type_pred_full", "median_expr"):
        files.export_result(data, what, str(tmp_path / what))
        assert spark.read.csv(str(tmp_path / what), sep="\t", header=True).count() > 0
    with pytest.raises(ValueError):
        files.export_result(data, "nothing", str(tmp_path / "x"))
    with pytest.raises(KeyError):
        files.export_result(data, "umap", str(tmp_path / "x"))
