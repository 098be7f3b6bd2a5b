import math
import random

import numpy as np

from quern.llm import ball_tree as b


def brute(rows, k):
    """Every row with a query's id asks all rows but itself."""
    v = [(i, [math.floor(256 * float(np.float32(c))) for c in x]) for i, x in rows if i is not None and x is not None and all(c is not None and math.isfinite(c) for c in x)]
    out = []
    for at, (q, x) in enumerate(v):
        if q % 50 == 0:
            scores = sorted((-sum(a * c for a, c in zip(x, y)), i) for other, (i, y) in enumerate(v) if other != at and len(x) == len(y))
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def test_against_brute_force_with_many_shards(spark):
    rnd = random.Random(5)
    rows = [(i, [rnd.gauss(0, 0.3) for _ in range(8)]) for i in range(400)]
    rows += [(i, rows[7][1]) for i in range(400, 450)]  # ties
    rows += [(500, None), (501, [None, 1.0]), (502, [float("nan")] * 8), (503, [float("inf")] * 8), (504, []), (None, [0.1] * 8)]
    rows += [(600, [0.5, -0.5]), (601, [0.25, 0.25]), (50, rows[3][1]), (-50, [0.0] * 8), (700, []), (701, []), (505, [])]
    rows += [(100, [0.9] * 8)] * 9 + [(100, [0.8] * 8), (150, rows[150][1])]  # repeated rows and ids
    df = spark.createDataFrame([(i, x, "s") for i, x in rows], "vec_id long, embedding array<float>, score string")
    vectors = b.integer_vectors(df, "vec_id", "embedding", 256)
    want = brute(rows, 5)
    for shard_rows in (32, 100_000):
        got = b.top_k(vectors, vectors.where("id % 50 = 0"), 5, shard_rows=shard_rows, leaf_rows=8).collect()
        assert sorted(tuple(r) for r in got) == want
    none = vectors.where("false")
    assert b.top_k(none, none).count() == 0
    assert b.top_k(vectors, none).count() == 0


def test_branches_are_cut():
    rnd = np.random.default_rng(0)
    centres = rnd.normal(0, 300, (20, 8))
    points = np.floor(centres[rnd.integers(0, 20, 4000)] + rnd.normal(0, 5, (4000, 8)))
    tree = b.BallTree(np.arange(4000), points, 50)
    score = points[:5] @ points.T
    kth = np.sort(score, axis=1)[:, -6]
    bound = tree.bounds(points[:5], kth)
    assert np.isinf(bound).mean() > 0.5
    ids, best = tree.search(np.arange(5), points[:5], 5, np.full(5, -np.inf))
    score[np.arange(5), np.arange(5)] = -np.inf
    assert (best == -np.sort(-score, axis=1)[:, :5]).all()
