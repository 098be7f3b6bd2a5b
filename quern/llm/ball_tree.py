"""Exact top-k inner products: a ball tree per shard, searched by branch and bound.

Vectors are turned into integers floor(scale * x); scores are integer inner
products and ties go to the smaller id. Candidates are split into shards of
bounded size by a hash of the id. Two rounds share the kth score: a query first
searches one shard, then all others start from the kth score it found there,
and within a task the kth score moves along from shard to shard. A shard's
queries stream through its tree, so a task holds one shard and one batch.

Inside a shard, nodes carry a centre and a radius; query.centre + |query| *
radius bounds every score below a node. Nodes whose bound is under the kth
score are cut, and the leaves left are taken in the order of their bounds.

Defined results: vectors that are null or hold a null or non-finite component take no part, nor do rows with a
null id; a vector of another length than the query's is no candidate for it (empty ones score 0 among
themselves); every row with a query's id is a query of its own, and all rows but itself are its candidates, repeated ones
too; an empty table gives no rows; other columns are ignored. Equal rows are one with their number, of which a tree
holds k + 1 at most (more can't matter), so a row that fills a third of the table is no hot shard. Components
beyond 2^21 / scale in magnitude raise, as scores must stay exact (up to 2048 dimensions).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from quern.plans.scratch import materialize

LIMIT = 1 << 21


def integer_vectors(df: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """``(id, v array<int>)`` of the rows that take part."""
    x = F.col(vec_col).cast("array<double>")
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    ints = F.transform(
        "x",
        lambda c: F.when(F.abs(c) * scale < LIMIT, F.floor(c * scale).cast("int")).otherwise(
            F.raise_error(F.lit("a vector component is too large for exact scores")).cast("int")
        ),
    )
    return (
        df.select(F.col(id_col).cast("long").alias("id"), x.alias("x"), whole.alias("whole"))
        .where(F.col("id").isNotNull() & F.col("x").isNotNull() & F.col("whole"))
        .select("id", ints.alias("v"))
    )


class BallTree:
    """A balanced binary tree of balls over the rows of ``points`` (float64, whole numbers)."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, leaf_rows: int = 128):
        self.order = np.arange(len(ids))
        self.centre, self.radius, self.child, self.span = [], [], [], []
        self.leaves: list[int] = []
        self._grow(points, 0, len(ids), leaf_rows)
        self.ids, self.points = ids[self.order], points[self.order]
        self.centre, self.radius = np.array(self.centre), np.array(self.radius)

    def _grow(self, points, lo, hi, leaf_rows) -> int:
        rows = points[self.order[lo:hi]]
        node, centre = len(self.centre), rows.mean(axis=0)
        self.centre.append(centre)
        self.radius.append(float(np.sqrt(((rows - centre) ** 2).sum(axis=1).max())))
        self.child.append(None)
        self.span.append((lo, hi))
        if hi - lo <= leaf_rows:
            self.leaves.append(node)
            return node
        far = rows[((rows - centre) ** 2).sum(axis=1).argmax()]
        other = rows[((rows - far) ** 2).sum(axis=1).argmax()]
        cut = np.argpartition(rows @ (other - far), (hi - lo) // 2)
        self.order[lo:hi] = self.order[lo:hi][cut]
        mid = lo + (hi - lo) // 2
        self.child[node] = (self._grow(points, lo, mid, leaf_rows), self._grow(points, mid, hi, leaf_rows))
        return node

    def bounds(self, queries: np.ndarray, kth: np.ndarray) -> np.ndarray:
        """Upper bounds by query and leaf; -inf where a node above was cut."""
        size = np.sqrt((queries**2).sum(axis=1))
        out = np.full((len(queries), len(self.leaves)), -np.inf)
        column = {leaf: i for i, leaf in enumerate(self.leaves)}
        todo = [(0, np.arange(len(queries)))]
        while todo:
            node, q = todo.pop()
            bound = queries[q] @ self.centre[node] + size[q] * self.radius[node]
            bound += 1e-9 * (np.abs(bound) + size[q] * (self.radius[node] + 1)) + 1e-6  # rounding never cuts
            stay = bound >= kth[q]
            if not stay.any():
                continue
            if self.child[node] is None:
                out[q[stay], column[node]] = bound[stay]
            else:
                todo += [(c, q[stay]) for c in self.child[node]]
        return out

    def own_rows(self, qid: np.ndarray, queries: np.ndarray) -> np.ndarray:
        """Place of the row that equals each query in id and vector (the first of several); -1 if there is none."""
        out, order = np.full(len(qid), -1, dtype=np.int64), np.argsort(self.ids, kind="stable")
        lo, hi = np.searchsorted(self.ids[order], qid, "left"), np.searchsorted(self.ids[order], qid, "right")
        for i in np.flatnonzero(hi > lo):
            same = order[lo[i] : hi[i]][(self.points[order[lo[i] : hi[i]]] == queries[i]).all(axis=1)]
            out[i] = same[0] if len(same) else -1
        return out

    def search(self, qid: np.ndarray, queries: np.ndarray, k: int, kth: np.ndarray):
        """Top ``k`` ``(ids, scores)`` by query, best first; -1 and -inf fill up. ``kth`` may cut all. A query's own row is left out."""
        n, own = len(qid), self.own_rows(qid, queries)
        best_id, best = np.full((n, k), -1, dtype=np.int64), np.full((n, k), -np.inf)
        floor = kth.astype(np.float64).copy()
        bound = self.bounds(queries, floor)
        turn = np.argsort(-bound, axis=1, kind="stable")
        for step in range(len(self.leaves)):
            leaf = turn[:, step]
            live = np.flatnonzero((bound[np.arange(n), leaf] > -np.inf) & (bound[np.arange(n), leaf] >= floor))
            if not len(live):
                break
            for at in np.unique(leaf[live]):
                q = live[leaf[live] == at]
                lo, hi = self.span[self.leaves[at]]
                score = queries[q] @ self.points[lo:hi].T
                here = np.flatnonzero((own[q] >= lo) & (own[q] < hi))
                score[here, own[q][here] - lo] = -np.inf
                both = np.concatenate([best[q], score], axis=1)
                names = np.concatenate([best_id[q], np.broadcast_to(self.ids[lo:hi], score.shape)], axis=1)
                pick = np.lexsort((names, -both), axis=1)[:, :k]
                best[q], best_id[q] = np.take_along_axis(both, pick, 1), np.take_along_axis(names, pick, 1)
                floor[q] = np.maximum(floor[q], best[q, -1])
        best_id[best == -np.inf] = -1
        return best_id, best


def _searcher(k: int, leaf_rows: int):
    """A task of rows sorted by (shard, query?, id): each shard's candidates, then its queries."""

    def run(batches):
        shard, held, trees, learnt = None, [], None, {}

        def answer(part):
            for dim, group in part.groupby(part["v"].map(len)):
                tree = trees.get(dim)
                if tree is None:
                    continue
                for lo in range(0, len(group), 1024):
                    g = group.iloc[lo : lo + 1024]
                    qid, key = g["id"].to_numpy(dtype=np.int64), list(zip(g["id"], g["version"]))
                    start = np.array([max(f, learnt.get(i, -np.inf)) for i, f in zip(key, g["kth"].fillna(-np.inf))])
                    found, score = tree.search(qid, np.stack(g["v"].to_numpy()).astype(np.float64), k, start)
                    if len(learnt) > 100_000:
                        learnt.clear()
                    learnt.update(zip(key, np.maximum(start, score[:, -1]).tolist()))
                    row, col = np.nonzero(score > -np.inf)
                    yield pd.DataFrame({"query_id": qid[row], "version": g["version"].to_numpy()[row], "vec_id": found[row, col], "score": score[row, col].astype(np.int64)})

        for batch in batches:
            for s, rows in batch.groupby("shard", sort=True):
                if s != shard:
                    shard, held, trees = s, [], None
                fresh = rows[~rows["asks"]]
                if len(fresh):
                    held.append(fresh[["id", "v"]])
                asks = rows[rows["asks"]]
                if not len(asks) or not held:
                    continue
                if trees is None:
                    mine = pd.concat(held)
                    trees = {
                        dim: BallTree(g["id"].to_numpy(dtype=np.int64), np.stack(g["v"].to_numpy()).astype(np.float64), leaf_rows)
                        for dim, g in mine.groupby(mine["v"].map(len))
                    }
                yield from answer(asks)

    return run


def top_k(
    candidates: DataFrame, queries: DataFrame, k: int = 5, shard_rows: int = 8192, leaf_rows: int = 128
) -> DataFrame:
    """``(query_id, rank, vec_id, score)`` of ``(id, v)`` frames: the k best of all candidates for every query.

    ``queries`` are rows of ``candidates``; each leaves out itself.
    """
    rows = candidates.groupBy("id", "v").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.select("id", "v", F.explode(F.sequence(F.lit(1), F.least("n", F.lit(k + 1)).cast("int")))).select("id", "v")
    rows = materialize(rows, "topk-rows")
    shards = max(1, -(-rows.count() // shard_rows))
    home = F.pmod(F.xxhash64("id", "v"), F.lit(shards)).cast("int")
    none, zero = F.lit(None).cast("double").alias("kth"), F.lit(0).alias("version")
    held = rows.select("id", zero, "v", home.alias("shard"), F.lit(False).alias("asks"), none)
    # queries of one id with different vectors are told apart by their version
    asked = queries.groupBy("id", "v").agg(F.count(F.lit(1)).alias("times"))
    asked = asked.withColumn("version", F.row_number().over(Window.partitionBy("id").orderBy("v")))
    asked = materialize(asked, "topk-queries")
    key = ["id", "version"]

    def searched(ask: DataFrame) -> DataFrame:
        rows = held.unionByName(ask).repartition(max(1, shards), "shard").sortWithinPartitions("shard", "asks", "id")
        return rows.mapInPandas(_searcher(k, leaf_rows), "query_id long, version int, vec_id long, score long")

    first = materialize(searched(asked.select(*key, "v", home.alias("shard"), F.lit(True).alias("asks"), none)), "topk-home")
    if shards == 1:
        found = first
    else:
        known = first.groupBy("query_id", "version").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("s"))
        known = known.select(F.col("query_id").alias("id"), "version", F.when(F.col("n") >= k, F.col("s")).cast("double").alias("kth"))
        rest = asked.join(known, key, "left").select(
            *key, "v", "kth", home.alias("home"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
        )
        again = rest.where("shard <> home").select(*key, "v", F.col("shard").cast("int").alias("shard"), F.lit(True).alias("asks"), "kth")
        found = first.unionByName(searched(again))
    order = Window.partitionBy("query_id", "version").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    times = asked.select(F.col("id").alias("query_id"), "version", "times")
    found = found.join(times, ["query_id", "version"]).withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op5_ball_tree(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    vectors = integer_vectors(table, "vec_id", "embedding", 256)
    return top_k(vectors, vectors.where("id % 50 = 0"))


ORACLE_SQL = {
    "op5_ball_tree": """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v, row_number() OVER () AS i
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.i, q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(COALESCE(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id % 50 = 0 AND c.i <> q.i AND len(c.v) = len(q.v)
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
}
