"""Numerical kernels by their defining properties."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quern.functions import linalg
from quern.operators import bio, bulk, glm, graph, hvg, impute, layout, norm, qc, reduce


def planted(groups=4, size=15, inside=0.7, outside=0.03, seed=1):
    rnd, g = np.random.default_rng(seed), graph.Graph(groups * size)
    for i in range(groups * size):
        for j in range(i):
            if rnd.random() < (inside if i // size == j // size else outside):
                g.add(i, j)
    return g, [i // size for i in range(groups * size)]


def same_partition(a, b):
    return len(set(zip(a, b))) == len(set(a)) == len(set(b))


@pytest.mark.parametrize("name", sorted(graph.KERNELS))
def test_communities_find_planted_groups(name):
    g, truth = planted()
    label = graph.KERNELS[name](g)
    assert graph.modularity(g, label) >= graph.modularity(g, truth) - 0.03
    assert same_partition(label, truth), name


def sparse_groups(n, seed=5):
    """A ring of small dense groups: few links a node."""
    rnd, g = np.random.default_rng(seed), graph.Graph(n)
    for i in range(n):
        for j in {i // 10 * 10 + int(x) for x in rnd.integers(0, 10, 3)} | ({i + 1} if i % 10 == 9 and i + 1 < n else set()):
            if i < j < n:
                g.add(i, j)
    return g


def dense_walks(g, steps):
    n = len(g.near)
    p = np.zeros((n, n))
    for i, near in enumerate(g.near):
        for j, w in near.items():
            p[i, j] = w
        p[i, i] += np.mean(list(near.values())) if near else 1.0
    degree = p.sum(axis=1)
    return np.linalg.matrix_power(p / degree[:, None], steps) / np.sqrt(degree)[None, :]


def test_walktrap_holds_no_square_matrix():
    small = sparse_groups(300)
    small.add(7, 7, 2.0)
    full = np.zeros((300, 300))
    for i, (at, v) in enumerate(graph._walks(small, 4, chunk=64)):
        full[i, at] = v
    assert np.allclose(full, dense_walks(small, 4))
    import tracemalloc

    tracemalloc.start()
    label = graph.walktrap(sparse_groups(3000))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3000 * 3000 * 8 / 2 and graph.modularity(sparse_groups(3000), label) > 0.9


def test_spinglass_sweeps_by_groups_of_nodes():
    import time

    g, began = sparse_groups(8000), time.perf_counter()
    label = graph.spinglass(g)
    assert time.perf_counter() - began < 60 and graph.modularity(g, label) > 0.85


def test_clusters_are_numbered_without_a_search_for_each(spark, monkeypatch):
    class Labels(list):
        def index(self, *_):
            raise AssertionError("looks through all labels once a cluster")

    monkeypatch.setitem(graph.KERNELS, "louvain", lambda g: Labels([5, 9, 9, 7, 5, 5, 3]))
    edges = spark.createDataFrame([(i, i) for i in range(7)], "src long, dst long")
    got = {r.id: r.cluster for r in graph.communities(edges, "louvain").collect()}
    assert got == {0: 0, 4: 0, 5: 0, 1: 1, 2: 1, 3: 2, 6: 3}


def test_distributed_communities(spark):
    g, truth = planted(2, 20, 0.8, 0.02)
    edges = spark.createDataFrame([(i, j) for i, near in enumerate(g.near) for j in near], "src long, dst long")
    for name in ("label_prop", "leading_eigenvector"):
        got = {r.id: r.cluster for r in graph.communities(edges, name).collect()}
        assert same_partition([got[i] for i in range(40)], truth), name
    with pytest.raises(ValueError):
        graph.communities(edges, "nothing")


def test_lanczos_equals_svd():
    rnd = np.random.default_rng(0)
    a = rnd.normal(size=(60, 25)) * np.geomspace(1, 20, 25)
    center, scale = a.mean(axis=0), a.std(axis=0)
    u, s, v, _ = linalg.lanczos(a, 6, tol=1e-9, center=center, scale=scale)
    full = np.linalg.svd((a - center) / scale)[1][:6]
    assert np.allclose(s, full, atol=1e-6) and np.allclose(u.T @ u, np.eye(6), atol=1e-8) and np.allclose(v.T @ v, np.eye(6), atol=1e-8)
    with pytest.raises(linalg.MatrixShapeError):
        linalg.lanczos(np.ones((1, 5)), 1)
    with pytest.raises(linalg.VectorLengthError):
        linalg.lanczos(a, 2, center=np.ones(3))


def test_distributed_svd_and_pca(spark):
    rnd = np.random.default_rng(1)
    a = rnd.normal(size=(200, 8)) @ rnd.normal(size=(8, 8))
    vectors = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(a)], "cell long, v array<double>").repartition(5)
    x = (a - a.mean(axis=0)) / a.std(axis=0)
    full = np.linalg.svd(x, full_matrices=False)
    for solver in ("eigen", "lanczos"):
        comp, load, sdev = reduce.svd(vectors, 8, 3, solver=solver)
        got = np.stack([r.comp for r in comp.orderBy("cell").collect()])
        assert np.allclose(np.abs(got), np.abs(full[0][:, :3] * full[1][:3]), atol=1e-5)
        assert np.allclose(load.T @ load, np.eye(3), atol=1e-8)
        assert np.allclose(sdev[:3], full[1][:3] / np.sqrt(199), atol=1e-5)
    expr = spark.createDataFrame([(f"g{j}", i, float(a[i, j])) for i in range(200) for j in range(8)], "gene string, cell long, value double")
    comp, loads = reduce.pca(expr, [f"g{j}" for j in range(8)], 3)
    assert comp.count() == 200 and loads.count() == 8
    units, _, _ = reduce.svd(vectors, 8, 3, var_weigh=False)
    u = np.stack([r.comp for r in units.orderBy("cell").collect()])
    assert np.allclose(u.T @ u, np.eye(3), atol=1e-5)


def test_knn_snn(spark):
    rnd = np.random.default_rng(2)
    a = rnd.normal(size=(120, 5))
    vectors = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(a)], "id long, v array<double>")
    d = np.sqrt(((a[:, None] - a[None]) ** 2).sum(axis=2))
    want = np.argsort(d, axis=1, kind="stable")[:, :6]
    for rows in (30, 1000):
        got = graph.knn(vectors, 6, block_rows=rows).orderBy("i", "rank").toPandas()
        assert (got["j"].to_numpy().reshape(120, 6) == want).all()
    member = np.zeros((120, 120))
    member[np.arange(120)[:, None], want] = 1
    v = member @ member.T
    strong = {(i, j) for i, j in zip(*np.nonzero(v / (12 - v) > 0.3))}
    strong |= {(i, i) for i in range(120) if not any(s == i for s, _ in strong)}
    edges = graph.snn(graph.knn(vectors, 6), 6, 0.3)
    assert {(r.src, r.dst) for r in edges.collect()} == strong
    with pytest.raises(ValueError):
        graph.knn(vectors, 3, "other")
    for distance in ("cosine", "manhattan"):
        assert graph.knn(vectors, 3, distance).where("rank = 1 AND i <> j").count() == 0


def test_neighbours_among_many_copies_are_those_of_smallest_names(spark, monkeypatch):
    rnd = np.random.default_rng(21)
    a = np.concatenate([np.repeat(rnd.normal(size=(3, 4)), [60, 25, 1], axis=0), rnd.normal(size=(54, 4))]) + 100
    names = rnd.permutation(140)
    d = np.round(np.sqrt(((a[:, None] - a[None]) ** 2).sum(axis=2)), 12)
    want = {int(n): names[np.lexsort((names, d[i], names != n))[:6]].tolist() for i, n in enumerate(names)}
    vectors = spark.createDataFrame([(int(n), r.tolist()) for n, r in zip(names, a)], "id long, v array<double>")
    for most, rows in ((12, 4096), (3, 20)):
        monkeypatch.setattr(graph, "MOST_BLOCKS", most)
        got = graph.knn(vectors, 6, block_rows=rows)
        assert got.orderBy("i", "rank").toPandas().groupby("i")["j"].agg(list).to_dict() == want
        monkeypatch.setattr(graph, "MOST_ROWS", 60)
    asked = [r[0] for r in graph.knn(vectors, 6, block_rows=20)._jdf.queryExecution().toString().split("sequence(0, ")[1:]]
    assert set(asked) == {"2"}  # three blocks a side at most, not one for each 20 points


def test_layouts_keep_groups_apart(spark):
    rnd = np.random.default_rng(3)
    a = np.concatenate([rnd.normal(c * 12, 1, (30, 4)) for c in range(3)])
    vectors = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(a)], "id long, v array<double>")
    near = graph.knn(vectors, 10)
    edges = graph.snn(near, 10)
    for layout in (reduce.tsne(vectors.withColumnRenamed("id", "cell"), "v", 10, 250), reduce.umap(near, 200), reduce.force_graph(edges, 200)):
        xy = layout.orderBy("cell").toPandas()[["x", "y"]].to_numpy()
        assert np.isfinite(xy).all()
        centre = np.stack([xy[c * 30 : c * 30 + 30].mean(axis=0) for c in range(3)])
        nearest = ((xy[:, None] - centre[None]) ** 2).sum(axis=2).argmin(axis=1)
        assert (nearest == np.repeat(range(3), 30)).mean() > 0.95
    w = reduce.fuzzy_weights(near).toPandas()
    assert w["w"].between(0, 1 + 1e-9).all() and len(w) == len(w.merge(w.rename(columns={"i": "j", "j": "i"}), on=["i", "j"]))


def test_linkage_methods():
    points = np.array([[0.0, 0], [0, 1], [5, 0], [5, 2]])
    for method, top in (("single", 5.0), ("complete", np.sqrt(29)), ("average", (5 + 2 * np.sqrt(26) + np.sqrt(29)) / 4), ("ward", None), ("centroid", None), ("median", None), ("weighted", None)):
        out = linalg.linkage(points, method)
        assert out.shape == (3, 4) and out[-1, 3] == 4 and set(out[0, :2]) == {0, 1}
        if top:
            assert abs(out[-1, 2] - top) < 1e-9


@pytest.mark.parametrize("task_links", [500_000, 500])
def test_leading_eigenvector_splits_on(spark, monkeypatch, task_links):
    rnd, sizes = np.random.default_rng(3), (12, 20, 30, 44)
    truth = [k for k, size in enumerate(sizes) for _ in range(size)]
    g = graph.Graph(len(truth))
    for i in range(len(truth)):
        for j in range(i):
            if rnd.random() < (0.7 if truth[i] == truth[j] else 0.01):
                g.add(i, j)
    edges = spark.createDataFrame([(i, j) for i, near in enumerate(g.near) for j in near], "src long, dst long")
    monkeypatch.setattr(graph, "TASK_LINKS", task_links)
    found = {r.id: r.label for r in graph.leading_eigenvector(edges, rounds=40).collect()}
    assert same_partition([found[i] for i in range(len(truth))], truth)


def test_split_of_many_nodes_by_lanczos():
    g, truth = planted(groups=6, size=250, inside=0.2, outside=0.004)
    links = np.array([(i, j) for i in range(len(truth)) for j in g.near[i]])
    degree = np.bincount(links[:, 0], minlength=len(truth)).astype(float)
    label = graph.split_community(links[:, 0], links[:, 1], degree, degree.sum())
    assert graph.modularity(g, label.tolist()) >= graph.modularity(g, truth) - 0.03


def test_nnls():
    rnd = np.random.default_rng(4)
    a, x = rnd.random((30, 5)), np.array([0.5, 0, 2, 0, 1.0])
    assert np.allclose(linalg.nnls(a, a @ x), x, atol=1e-5)
    assert (linalg.nnls(a, -a.sum(axis=1)) == 0).all()


def test_minimum_covariance_determinant(spark):
    rnd = np.random.default_rng(5)
    x = np.concatenate([rnd.normal(0, 1, (180, 3)), rnd.normal(30, 1, (12, 3))])
    mean, cov = qc.fast_mcd(x)
    assert np.abs(mean).max() < 0.5 and np.abs(cov - np.eye(3)).max() < 0.7
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "cell long, a double, b double, c double")
    out = {r.cell for r in qc.find_low_quality(df, 2.0).where("status = 'EXCLUDE'").collect()}
    assert out and out <= set(range(180, 192))


def test_trajectory_of_a_fork(spark):
    rnd = np.random.default_rng(6)
    centres = {"a": (0, 0), "b": (5, 0), "c": (10, 4), "d": (10, -4.5)}
    rows = [(k, float(x + rnd.normal(0, 0.5)), float(y + rnd.normal(0, 0.5))) for k, (x, y) in centres.items() for _ in range(40)]
    lineages, edges = graph.slingshot(spark.createDataFrame(rows, "cluster string, x double, y double"), omega=1e9)
    assert {(r.src, r.dst) for r in edges.collect() if r.src < r.dst} == {("a", "b"), ("b", "c"), ("b", "d")}
    assert all(len(r.path) == 3 and r.path[1] == "b" for r in lineages.collect())


def counts_by_root():
    class CountsByRoot(glm.Family):
        """A family of a user's own: counts whose mean is the squared predictor."""

        def start(self, mean):
            return mean**0.5

        def inv_link(self, nu):
            return np.maximum(nu, 1e-6) ** 2

        def d_inv_link(self, nu, mu):
            return 2 * np.maximum(nu, 1e-6)

        def variance(self, mu):
            return mu

        def deviance(self, y, mu):
            return glm.Poisson().deviance(y, mu)

    return CountsByRoot()  # a local class travels to the workers


@pytest.mark.parametrize("family", [glm.Gaussian(), glm.Bernoulli(), glm.QuasiPoisson(), glm.Poisson(), glm.Gamma(), glm.Exponential(), counts_by_root()], ids=lambda f: type(f).__name__)
def test_glm_inference_equals_arrays(spark, family):
    rnd = np.random.default_rng(3)
    n = 500
    x, z, w = rnd.random(n), rnd.random(n), rnd.integers(1, 4, n).astype(float)
    mu = family.inv_link(1.0 + 0.8 * x - 0.3 * z)
    y = rnd.binomial(1, mu) if isinstance(family, glm.Bernoulli) else mu + rnd.normal(0, 0.3, n) if type(family) is glm.Gaussian else rnd.poisson(mu) + 0.5 * (family.spark_link == "identity")
    sdf = spark.createDataFrame(pd.DataFrame({"x": x, "z": z, "w": w, "y": y.astype(float)}))
    fitted = glm.GLM(family).fit(sdf, "y", ["x", "z"], weights="w")
    design, beta = np.column_stack([np.ones(n), x, z]), fitted.coef_
    nu = design @ beta
    mu = family.inv_link(nu)
    slope, spread = family.d_inv_link(nu, mu), family.variance(mu)
    if not isinstance(family, (glm.Gamma, glm.Gaussian)):
        assert np.abs(design.T @ (w * (y - mu) * slope / spread)).max() < 1e-3  # the score vanishes at the fit
    info = (design * (w * slope**2 / spread)[:, None]).T @ design
    deviance = sum(family.deviance(y[i : i + 1], mu[i : i + 1]) * w[i] for i in range(n))
    phi = deviance / (n - 3) if family.has_dispersion else 1.0
    assert np.isclose(fitted.score(), deviance) and np.isclose(fitted.dispersion_, phi)
    errors = np.sqrt(np.diag(phi * np.linalg.inv(info)))
    assert np.allclose(fitted.coef_standard_error_, errors) and np.allclose(fitted.information_, info)
    assert np.allclose(fitted.p_values_, [math.erfc(abs(b / e) / math.sqrt(2)) for b, e in zip(beta, errors)])
    got = fitted.predict(sdf.withColumn("o", F.lit(0.5)), offset="o").select("prediction").toPandas()["prediction"]
    assert np.allclose(np.sort(got), np.sort(family.inv_link(nu + 0.5)))


def test_sparse_quantile_normalisation_equals_the_dense_one(spark):
    rnd = np.random.default_rng(8)
    full = rnd.integers(1, 50, (12, 7)) * (rnd.random((12, 7)) < np.linspace(0.1, 0.95, 7))
    full[:, 0] = 0
    rows = [(f"g{i:02d}", f"c{j}", int(full[i, j])) for i in range(12) for j in range(7)]
    dense = spark.createDataFrame(rows, "gene string, cell string, value long")
    want = {(r.gene, r.cell): r.value for r in norm.fqn_dense(dense).collect() if r.value}
    got = {(r.gene, r.cell): r.value for r in norm.fqn(dense, 12, 7, "value").collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_low_quality_fit_sees_all_cells(spark):
    rnd = np.random.default_rng(4)
    rows = [(f"c{i}", *map(float, rnd.normal([5, 0.5], [1, 0.1]) + (8 if i >= 290 else 0))) for i in range(300)]
    features = spark.createDataFrame(rows, "cell string, a double, b double")
    part = qc.find_low_quality(features, max_start=40).collect()
    assert {r.cell for r in part if r.status == "EXCLUDE"} == {f"c{i}" for i in range(290, 300)}


def test_scratch_needs_a_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    from quern.plans import scratch

    conf = SimpleNamespace(get=lambda *_: None)
    with pytest.raises(RuntimeError):
        scratch.shared_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077", applicationId="none")))


def test_glm(spark):
    rnd = np.random.default_rng(7)
    x = rnd.random(400)
    df = pd.DataFrame({"x": x, "z": rnd.normal(size=400)})
    df["y"] = 0.5 + 1.6 * x + 0.1 * rnd.normal(size=400)
    df["k"] = rnd.poisson(np.exp(0.3 + x)).astype(float)
    sdf = spark.createDataFrame(df)
    design = np.column_stack([np.ones(400), x])
    assert np.allclose(glm.GLM(glm.Gaussian()).fit(sdf, "y", ["x"]).coef_, np.linalg.lstsq(design, df["y"], rcond=None)[0], atol=1e-6)
    fitted = glm.GLM(glm.Poisson()).fit(sdf, formula="k ~ x")
    assert np.allclose(fitted.coef_, glm.irls(design, df["k"].to_numpy(), glm.Poisson()), atol=1e-4)
    assert len(fitted.p_values_) == 2 and fitted.summary()["p_value"].max() < 0.05 and fitted.predict(sdf).count() == 400
    mine = glm.irls(design, df["y"].to_numpy().clip(0.01), glm.Gamma())
    ml = glm.GLM(glm.Gamma()).fit(sdf.withColumn("y", F.greatest("y", F.lit(0.01))), "y", ["x"]).coef_
    assert np.allclose(mine, ml, atol=1e-2)
    boots = np.stack([r.coef for r in glm.bootstrap(spark, design, df["y"].to_numpy(), glm.Gaussian(), 40).collect()])
    assert np.abs(boots.mean(axis=0) - [0.5, 1.6]).max() < 0.1
    simulated = np.stack([r.coef for r in glm.bootstrap(spark, design, df["y"].to_numpy(), glm.Gaussian(), 20, parametric=True, dispersion=0.01).collect()])
    assert np.abs(simulated.mean(axis=0) - [0.5, 1.6]).max() < 0.1
    path = glm.glmnet_path(sdf, "y", ["x", "z"], [1.0, 0.01], 1.0)
    assert path.loc[path["lambda"] == 1.0, "x"].item() == 0 and path.loc[path["lambda"] == 0.01, "x"].item() > 1
    with pytest.raises(ValueError):
        glm.GLM(glm.Gaussian()).fit(sdf, "y", ["none"])
    with pytest.raises(ValueError):
        glm.irls(design[:, ::-1], df["y"].to_numpy(), glm.Gaussian())
    with pytest.raises(ValueError):
        glm.glmnet_path(sdf, "y", ["x"], [1.0], 1.0, family="poisson")
    got = sdf.select(glm.soft_threshold(F.lit(-3.0), F.lit(1.0)).alias("a"), glm.soft_threshold(F.lit(0.5), F.lit(1.0)).alias("b")).first()
    assert (got.a, got.b) == (-2.0, 0.0)


def test_mixture_and_imputation(spark):
    rnd = np.random.default_rng(8)
    x = np.concatenate([np.full(60, np.log10(impute.OFFSET)), rnd.normal(2.5, 0.2, 140)])
    share, _, _, mean, sd = impute.fit_mixture(x)
    assert abs(share - 0.3) < 0.05 and abs(mean - 2.5) < 0.05 and sd < 0.3
    rows = [(f"g{g}", c, int(v)) for g in range(12) for c in range(30) if (v := rnd.poisson(20 + 10 * g) * (rnd.random() > 0.15))]
    counts = spark.createDataFrame(rows, "gene string, cell long, count long")
    clusters = spark.createDataFrame([(c, 0) for c in range(30)], "cell long, cluster int")
    out = {(r.gene, r.cell): r.value for r in impute.impute(counts, clusters).collect()}
    held = {(g, c): v for g, c, v in rows}
    assert len(out) > len(held) and np.median([abs(out[k] - v) / v for k, v in held.items()]) < 0.05


def test_nonnegative_ridge():
    rnd = np.random.default_rng(10)
    for m, n in ((40, 12), (12, 60)):
        a, b = rnd.random((m, n)), rnd.random(m)
        assert np.allclose(linalg.nonnegative_ridge(a, b, 0.5), linalg.nnls(a, b, 0.5, steps=20_000, tol=1e-13), atol=1e-6)


def test_imputation_fits_on_all_other_cells(spark, monkeypatch):
    rnd = np.random.default_rng(11)
    cells = [(c, 0) for c in range(240)]
    rows = [(f"g{g:02d}", c, int(v)) for g in range(16) for c, _ in cells if (v := rnd.poisson(20 + 10 * g) * (rnd.random() > 0.15))]
    counts = spark.createDataFrame(rows, "gene string, cell long, count long")
    clusters = spark.createDataFrame(cells, "cell long, cluster int")
    rates = impute.dropout_rates(impute.log_cpm(counts), clusters).toPandas()
    x = rates.pivot(index="gene", columns="cell", values="value")
    drop = rates.pivot(index="gene", columns="cell", values="drop").to_numpy() > 0.5
    depth, x = counts.toPandas().groupby("cell")["count"].sum(), x.to_numpy()
    want = {}
    for i in range(0, 240, 12):
        others, unsure = np.arange(240) != i, drop[:, i]
        if unsure.any():
            a, b = x[~unsure][:, others], x[~unsure, i]
            w = linalg.nonnegative_ridge(a, b, 1.0)
            slope = a.T @ (a @ w - b) + w  # the smallest value has no slope where w > 0, and none downwards elsewhere
            assert (w >= 0).all() and np.abs(slope[w > 0]).max() < 1e-6 and slope.min() > -1e-6
            guess = np.minimum(x[unsure][:, others] @ w, x[unsure].max(axis=1))
            want |= {(f"g{g:02d}", i): (10**v - impute.OFFSET) * depth[i] / 1e6 for g, v in zip(np.flatnonzero(unsure), guess)}
    assert len(want) > 20
    for fits in (500, 100):
        monkeypatch.setattr(impute, "FITS", fits)
        got = {(r.gene, r.cell): r.value for r in impute.impute(counts, clusters).collect()}
        assert all(abs(got.get(k, 0.0) - max(0.0, v)) < 0.011 for k, v in want.items())


def test_subpopulations_part_two_kinds_of_cells(spark):
    rnd = np.random.default_rng(12)
    mean = np.where(np.arange(40)[:, None] // 20 == np.arange(60)[None] // 30, 60, 4)
    rows = [(f"g{g:02d}", f"c{c:02d}", int(v)) for g in range(40) for c in range(60) if (v := rnd.poisson(mean[g, c]))]
    counts = spark.createDataFrame(rows, "gene string, cell string, count long")
    found = {r.cell: r.cluster for r in impute.subpopulations(counts, ngenes=40, ncomp=5).collect()}
    kinds = [{found[f"c{c:02d}"] for c in range(lo, lo + 30)} for lo in (0, 30)]
    assert len(found) == 60 and not kinds[0] & kinds[1]
    assert impute.impute(counts).where("value > 0").count() >= len(rows) * 0.9


def test_checks_and_weighted_dots(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0), (2.0, 5.0, 0.5)], "x double, y double, w double")
    assert df.agg(glm.weighted_dot("x", "y", "w")).first()[0] == 11.0
    glm.check_intercept(np.ones((2, 2)))
    glm.check_lengths([1, 2], offset=[0, 0], weights=None)
    for wrong in (lambda: glm.check_intercept(np.zeros((2, 2))), lambda: glm.check_lengths([1], offset=[0, 0])):
        with pytest.raises(ValueError):
            wrong()


def test_vsn_removes_depth(spark):
    rnd = np.random.default_rng(9)
    depth = rnd.uniform(0.5, 4, 150)
    rows = [(f"g{g}", c, int(v)) for g in range(60) for c in range(150) if (v := rnd.poisson((2 + g % 7) * depth[c]))]
    out = norm.vsn(spark.createDataFrame(rows, "gene string, cell long, count long")).groupBy("cell").agg(F.sum("value").alias("t")).toPandas()
    corr = np.corrcoef(out.sort_values("cell")["t"], depth)[0, 1]
    assert abs(corr) < 0.5


def test_variable_genes_are_found(spark):
    rnd = np.random.default_rng(10)
    rows = []
    for g in range(120):
        mean = rnd.uniform(5, 50)
        for c in range(120):
            v = rnd.poisson(mean * (4.0 if c < 40 else 0.2) if g < 8 else mean)
            if v:
                rows.append((f"g{g:03}", c, float(v)))
    expr = spark.createDataFrame(rows, "gene string, cell long, value double")
    truth = {f"g{g:03}" for g in range(8)}
    raw = {"logged": False}
    # bins of the mean hold several of these genes, which lowers their scores within them
    for method, least, args in (("seurat", 4, {}), ("brennecke", 6, raw), ("chen2016", 6, raw), ("scran", 6, raw | {"spikes": expr.where("gene >= 'g060'")})):
        found = [r.gene for r in hvg.find_hvg(expr, 120, method, 8, **args).orderBy("rank").collect()]
        assert len(truth & set(found)) >= least, (method, found)
    assert hvg.find_hvg(expr, 120, "mm", 20, logged=False).count() == 20
    with pytest.raises(ValueError):
        hvg.find_hvg(expr, 120, "scran")
    with pytest.raises(ValueError):
        hvg.find_hvg(expr, 120, "other")


@pytest.mark.parametrize("method", ["brennecke", "mm"])
def test_selections_read_the_matrix_a_few_times_only(spark, method):
    rnd = np.random.default_rng(22)
    rows = [(f"g{g}", c, float(v)) for g in range(40) for c in range(30) if (v := rnd.poisson(1 + g % 9))]
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    kind = "gene string, cell long, value double"
    expr = spark.createDataFrame(rows, kind).mapInPandas(count, kind)
    hvg.METHODS[method](expr, 30, ngenes=5, logged=False).collect()
    assert len(rows) <= read.value <= 2 * len(rows)  # not once for each step of a fit


def test_cell_types_cycle_and_deconvolution(spark):
    rnd = np.random.default_rng(11)
    types = {"A": range(0, 10), "B": range(10, 20), "C": range(20, 30)}
    rows, cells = [], []
    for i, (t, genes) in enumerate(types.items()):
        for c in range(30):
            cells.append((f"{t}{c}", t, str(c % 3)))
            rows += [(f"G{g}_x", f"{t}{c}", int(v)) for g in range(40) if (v := rnd.poisson(12 if g in genes else 0.4))]
    counts = spark.createDataFrame(rows, "gene string, cell string, count long")
    expr = norm.log_transform(norm.standard(counts))
    clusters = spark.createDataFrame([(c, t) for c, t, _ in cells], "cell string, cluster string")
    markers = spark.createDataFrame([(f"g{g}", t) for t, gs in types.items() for g in gs] + [("g35", "A"), ("g0", "Z"), ("g38", "Z")], "gene string, cell_type string")
    best, rest = bio.predict_cell_types(expr, clusters, markers)
    assert {r.cluster: r.cell_type for r in best.collect()} == {"A": "A", "B": "B", "C": "C"} and rest.count() > 3
    model, genes = bio.train_cell_cycle(expr, clusters.withColumnRenamed("cluster", "phase"), [f"G{g}_x" for g in range(30)])
    got = bio.predict_cell_cycle(expr, model, genes).join(clusters, "cell")
    assert got.where("cell_cycle = cluster").count() >= 85
    cellmap = spark.createDataFrame(cells, "cell string, ct string, sample string")
    sums = bulk.group_sums(counts, cellmap)
    base = bulk.basis(bulk.mean_matrix(sums), bulk.library_sizes(sums, cellmap))
    wide = {(r.gene, r.ct): r.basis for r in base.collect()}
    mix = {"A": 0.6, "B": 0.1, "C": 0.3}
    names = sorted({g for g, _ in wide})
    sample = spark.createDataFrame([(g, "s", float(sum(mix[t] * wide.get((g, t), 0) for t in types))) for g in names], "gene string, sample string, value double")
    got = {r.ct: r.proportion for r in bulk.deconvolve(sample, base).collect()}
    assert all(abs(got[t] - mix[t]) < 0.01 for t in types)
    assert bulk.sigma(bulk.mean_matrix(sums)).where("sigma < 0").count() == 0
    adjust = bulk.variance_adjustment(sums, cellmap)
    assert bulk.weighted_shares(sums, adjust, parity=True).groupBy("ct", "sample").agg(F.sum("share").alias("s")).where("abs(s - 1) > 1e-9").count() == 0


def test_jackstraw_finds_structure(spark):
    rnd = np.random.default_rng(12)
    a = rnd.normal(size=(150, 30))
    a[:, :10] += rnd.normal(size=(150, 1)) * 3
    vectors = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(a)], "cell long, v array<double>")
    scores, comps = reduce.jackstraw(vectors, list(range(30)), 3, 60, 0.1, score_thr=0.05)
    rows = {r.pc: r for r in comps.collect()}
    assert rows[1].found >= 10 and rows[1].p_val < rows[3].p_val and scores.count() == 90


def test_pyramid_sums_are_those_of_all_pairs():
    rnd = np.random.default_rng(23)
    y = np.concatenate([rnd.normal(0, 1, (700, 2)), rnd.normal(6, 0.05, (200, 2)), [[40.0, -3.0]], np.zeros((3, 2))])
    mass = rnd.integers(1, 5, len(y)).astype(float)
    tree = layout.Pyramid(y, mass)
    count = np.concatenate([tree.meet(lo, min(lo + 250, len(y)), lambda m, dx, dy: (m,)) for lo in range(0, len(y), 250)])[:, 0]
    assert np.allclose(count, mass.sum() - mass)  # each other point once
    dx, dy = y[:, None, 0] - y[None, :, 0], y[:, None, 1] - y[None, :, 1]
    q = 1 / (1 + dx**2 + dy**2)
    want = np.stack([(mass * q**2 * dx).sum(axis=1), (mass * q**2 * dy).sum(axis=1)], axis=1)
    got = tree.meet(0, len(y), lambda m, dx, dy: (m * dx / (1 + dx**2 + dy**2) ** 2, m * dy / (1 + dx**2 + dy**2) ** 2))
    assert np.linalg.norm(got - want) < 0.03 * np.linalg.norm(want)


def test_layouts_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(layout, "BLOCK", 200)
    rnd = np.random.default_rng(24)
    a = np.concatenate([rnd.normal(c * 12, 1, (100, 4)) for c in range(3)])
    vectors = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(a)], "id long, v array<double>")
    near = graph.knn(vectors, 10)
    for turn in (reduce.tsne(vectors.withColumnRenamed("id", "cell"), "v", 10, 25), reduce.umap(near, 10), reduce.force_graph(graph.snn(near, 10), 10)):
        xy = turn.orderBy("cell").toPandas()
        assert len(xy) == 300 and np.isfinite(xy[["x", "y"]].to_numpy()).all()


def test_points_without_links_have_a_place(spark):
    edges = spark.createDataFrame([(0, 1), (1, 0), (1, 2), (2, 1), (5, 5)], "src long, dst long")
    assert [r.cell for r in reduce.force_graph(edges, 5).orderBy("cell").collect()] == [0, 1, 2, 5]


def test_depth_fits_take_equal_rows_as_counts(spark):
    from quern.functions.stats import theta_ml

    rnd = np.random.default_rng(25)
    x = np.round(rnd.uniform(1, 2, 400), 1)
    y = rnd.negative_binomial(3, 3 / (3 + np.exp(x))).astype(float)
    pairs, times = np.unique(np.column_stack([y, x]), axis=0, return_counts=True)
    beta = norm._poisson_line(y, x)
    assert np.allclose(norm._poisson_line(pairs[:, 0], pairs[:, 1], times=times.astype(float)), beta, atol=1e-6)
    mu = lambda at: np.exp(beta[0] + beta[1] * at)
    assert np.isclose(theta_ml(pairs[:, 0], mu(pairs[:, 1]), times=times), theta_ml(y, mu(x)))


def test_cell_types_read_the_matrix_once(spark):
    rows = [(f"g{g}", c, float(1 + (g * c) % 5)) for g in range(20) for c in range(24)]
    read, kind = spark.sparkContext.accumulator(0), "gene string, cell long, value double"

    def count(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    clusters = spark.createDataFrame([(c, c % 2) for c in range(24)], "cell long, cluster int")
    markers = spark.createDataFrame([(f"g{g}", "A" if g < 10 else "B") for g in range(20)], "gene string, cell_type string")
    assert len(bio.predict_cell_types(spark.createDataFrame(rows, kind).mapInPandas(count, kind), clusters, markers)[0].collect()) == 2
    assert read.value == len(rows)
