"""Queries over points and graphs: neighbours, communities, layouts, trajectories."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.catalog.base import log_expr, registry, rounded, vectors
from quern.operators import graph, hvg, reduce, views
from quern.plans.scratch import materialize
from quern.session import table

QUERIES, SQL, add = registry()

KNN = """WITH v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
d AS (SELECT a.id AS i, b.id AS j, sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS distance FROM v a, v b),
n AS (SELECT i, row_number() OVER (PARTITION BY i ORDER BY i <> j, round(distance, 12), j) AS rank, j, distance FROM d),
k AS (SELECT * FROM n WHERE rank <= 10)"""
SNN = KNN + """, s AS (SELECT a.i AS src, b.i AS dst, COUNT(*) AS v FROM k a JOIN k b ON a.j = b.j GROUP BY a.i, b.i),
ed AS (SELECT src, dst FROM s WHERE v / (10 + (10 - v)) > 0.15)"""


def neighbours(spark, sf):
    return graph.knn(vectors(spark, sf), 10)


def edges(spark, sf):
    return materialize(graph.snn(neighbours(spark, sf), 10, 0.15), "snn")


@add(f"{KNN} SELECT i, rank::INTEGER AS rank, j, round(distance, 6) AS distance FROM k")
def knn(spark, sf):
    return rounded(neighbours(spark, sf), "distance")


@add(f"{SNN} SELECT * FROM ed UNION ALL SELECT id, id FROM v WHERE id NOT IN (SELECT src FROM ed)")
def snn(spark, sf):
    return graph.snn(neighbours(spark, sf), 10, 0.15)


def _round(n):
    return f"""l{n} AS (SELECT l.id, COALESCE(w.label, l.label) AS label FROM l{n - 1} l LEFT JOIN (
  SELECT src, label FROM (SELECT src, label, row_number() OVER (PARTITION BY src ORDER BY COUNT(*) DESC, label) AS r
    FROM ed JOIN l{n - 1} x ON x.id = ed.dst WHERE src <> dst GROUP BY src, label) WHERE r = 1) w ON w.src = l.id)"""


@add(f"{SNN}, l0 AS (SELECT id, id AS label FROM v), {_round(1)}, {_round(2)}, {_round(3)} SELECT * FROM l3")
def label_prop_3(spark, sf):
    return graph.label_propagation(edges(spark, sf), 3)


def plane(spark, sf):
    e = F.col("embedding")
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("cell"), e[0].cast("double").alias("x"), e[1].cast("double").alias("y"), F.col("label").alias("cluster"))


@add("""WITH c AS (SELECT label, avg(x) AS x, avg(y) AS y, var_samp(x) AS xx, var_samp(y) AS yy, covar_samp(x, y) AS xy
  FROM (SELECT label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings) GROUP BY label HAVING COUNT(*) >= 10),
p AS (SELECT a.label AS a, b.label AS b, a.x - b.x AS dx, a.y - b.y AS dy, a.xx + b.xx AS xx, a.yy + b.yy AS yy, a.xy + b.xy AS xy FROM c a JOIN c b ON a.label < b.label)
SELECT a, b, round((dx * dx * yy - 2 * dx * dy * xy + dy * dy * xx) / (xx * yy - xy * xy), 6) AS distance FROM p""")
def slingshot_dist(spark, sf):
    return rounded(graph.cluster_distances(plane(spark, sf)), "distance")


@add("SELECT label AS cluster, round(avg(embedding[1]::DOUBLE), 6) AS x, round(avg(embedding[2]::DOUBLE), 6) AS y, COUNT(*) AS n FROM embeddings GROUP BY label")
def cluster_centres(spark, sf):
    p = plane(spark, sf)
    return rounded(views.cluster_centres(p.select("cell", "x", "y"), p.select("cell", "cluster")), "x", "y")


@add("SELECT vec_id AS cell, round(embedding[1]::DOUBLE, 6) AS x, round(embedding[2]::DOUBLE, 6) AS y FROM embeddings WHERE embedding[1]::DOUBLE > 0 AND embedding[1]::DOUBLE < 0.1 AND embedding[2]::DOUBLE > -0.1 AND embedding[2]::DOUBLE < 0.1")
def cell_rectangle(spark, sf):
    return rounded(views.rectangle(plane(spark, sf).drop("cluster"), 0.0, 0.1, -0.1, 0.1), "x", "y")


@add("SELECT vec_id AS cell, round(embedding[1]::DOUBLE, 6) AS x, label AS cluster, label || ' (n=' || n || ')' AS label FROM embeddings JOIN (SELECT label, COUNT(*) AS n FROM embeddings GROUP BY label) USING (label)")
def cell_labels(spark, sf):
    p = plane(spark, sf)
    return rounded(views.cell_view(p.select("cell", "x"), p.select("cell", "cluster")), "x")


@add("""WITH u AS (SELECT vec_id AS gene, unnest(range(1, 4)) AS pc, embedding FROM embeddings), w AS (SELECT gene, pc, embedding[pc]::DOUBLE AS loading FROM u),
r AS (SELECT *, row_number() OVER (PARTITION BY pc ORDER BY loading DESC, gene) AS t, row_number() OVER (PARTITION BY pc ORDER BY loading, gene) AS b FROM w)
SELECT pc::INTEGER AS pc, 'top' AS side, t::INTEGER AS rank, gene, round(loading, 6) AS loading FROM r WHERE t <= 5
UNION ALL SELECT pc::INTEGER, 'bottom', b::INTEGER, gene, round(loading, 6) FROM r WHERE b <= 5""")
def pca_contributors(spark, sf):
    loads = vectors(spark, sf).select(F.col("id").alias("gene"), F.col("v").alias("load"))
    return rounded(views.contributors(loads, [1, 2, 3], 5), "loading")


def as_cells(spark, sf):
    return vectors(spark, sf).withColumnRenamed("id", "cell")


@add("""WITH x AS (SELECT unnest(range(1, 65)) AS i, embedding FROM embeddings)
SELECT round(SUM(v), 6) AS total_var FROM (SELECT var_samp(embedding[i]::DOUBLE) AS v FROM x GROUP BY i)""")
def elbow_total_var(spark, sf):
    """Squared deviations of all components add up to the total variance."""
    _, _, sdev = reduce.svd(as_cells(spark, sf), 64, 10, scale=False)
    return reduce.sdev_table(spark, sdev).agg(F.round(F.sum(F.col("sdev") * F.col("sdev")), 6).alias("total_var"))


@add()
def pca_elbow(spark, sf):
    _, _, sdev = reduce.svd(as_cells(spark, sf), 64, 10)
    return views.elbow(reduce.sdev_table(spark, sdev))


@add()
def pca_svd(spark, sf):
    """Components of the most variable genes of the sparse matrix."""
    expr = materialize(log_expr(spark, sf, "m1"), "expr")
    n = expr.select("cell").distinct().count()
    genes = [r["gene"] for r in hvg.find_hvg(expr, n, "seurat", 100).orderBy("rank").collect()]  # 100 names
    return reduce.pca(expr, genes, 10, n_cells=n)[0]


@add()
def pca_lanczos(spark, sf):
    return reduce.svd(as_cells(spark, sf), 64, 10, solver="lanczos")[0]


@add()
def jackstraw(spark, sf):
    return reduce.jackstraw(as_cells(spark, sf), list(range(64)), 5, 500)[1]


@add()
def jackstraw_bars(spark, sf):
    return views.jackstraw_bars(reduce.jackstraw(as_cells(spark, sf), list(range(64)), 5, 500)[1])


def _community(algorithm):
    def query(spark, sf):
        return graph.communities(edges(spark, sf), algorithm)

    query.__name__ = algorithm
    QUERIES[algorithm] = query


for _name in ("leiden", "louvain", "multilevel", "walktrap", "infomap", "spinglass", "leading_eigenvector", "label_prop"):
    _community(_name)


@add()
def cluster_generate(spark, sf):
    return graph.generate(vectors(spark, sf), 10, prune=0.15)


@add()
def tsne(spark, sf):
    return reduce.tsne(as_cells(spark, sf), "v")


@add()
def umap(spark, sf):
    return reduce.umap(graph.knn(vectors(spark, sf), 15))


@add()
def force_graph(spark, sf):
    return reduce.force_graph(materialize(graph.snn(neighbours(spark, sf), 10), "snn"))


@add()
def slingshot_lineages(spark, sf):
    return graph.slingshot(plane(spark, sf))[0]


@add()
def tree(spark, sf):
    means = vectors(spark, sf).join(table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label"), "id")
    wide = means.groupBy("label").agg(*[F.avg(F.col("v")[i]).alias(f"d{i}") for i in range(64)]).orderBy("label").toPandas()  # a row a cluster
    return spark.createDataFrame(graph.cluster_tree(wide.drop(columns="label"), "average"))
