"""Neighbours, shared-neighbour graphs, communities, trajectories."""

from __future__ import annotations

import heapq
import math
from collections import deque

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from quern.functions.linalg import linkage
from quern.plans.scratch import materialize, release


#: a side of the grid of tasks of exact neighbours has at most so many blocks, unless they would pass so many rows
MOST_BLOCKS, MOST_ROWS = 12, 65_536
PACK = 2048


def _first_copies(x: np.ndarray, k: int) -> np.ndarray:
    """Which rows are among the first ``k`` of their equals."""
    _, group = np.unique(np.ascontiguousarray(x).view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel(), return_inverse=True)
    order = np.argsort(group, kind="stable")
    starts = np.flatnonzero(np.append(True, np.diff(group[order]) != 0))
    place = np.empty(len(x), dtype=np.int64)
    place[order] = np.arange(len(x)) - np.repeat(starts, np.diff(np.append(starts, len(x))))
    return place < k


def nearest(a: np.ndarray, ids: np.ndarray, b: np.ndarray, names: np.ndarray, k: int, distance: str = "euclidean"):
    """``(row of a, name, distance)`` of the ``k`` nearest of ``b`` to each row of ``a``, ties by name; a name of its own counts first.

    Tiles of rough distances only choose candidates: all that may be among the ``k`` nearest within the error of single
    precision. Those are measured exactly and merged with the best so far.
    """
    if distance == "cosine":
        a, b = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300) for x in (a, b))
    order = np.argsort(names, kind="stable")
    b, names = b[order], names[order]
    fresh = _first_copies(b, k + 1)  # of equal points the smallest names come first; a point's own is added below
    own = np.flatnonzero(np.isin(names, ids) & ~fresh)
    keep = np.sort(np.concatenate([np.flatnonzero(fresh), own]))
    rest = ~fresh[keep]
    b, names = b[keep], names[keep]
    whole = np.isfinite(b).all(axis=1)
    centre = b[whole].mean(axis=0) if whole.any() else np.zeros(b.shape[1])
    a0, b0 = a - centre, b - centre
    aa, bb = (a0**2).sum(axis=1), (b0**2).sum(axis=1)
    plain = distance != "manhattan"
    wide = 4096 if plain else max(1, 2_000_000 // (64 * max(1, a.shape[1])))
    step = 512 if plain else 64
    right = np.column_stack([-2 * b0, bb]).astype(np.float32)
    slack = 2.4e-7 * (a.shape[1] + 8) * (aa + bb[whole].max(initial=0.0)) + 1e-30
    out = []
    for lo in range(0, len(a), step):
        q, mine = a[lo : lo + step], ids[lo : lo + step]
        n = len(q)
        left = np.column_stack([a0[lo : lo + step], np.ones(n)]).astype(np.float32)
        best = [np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0)]  # row, place in b, distance
        limit = np.full(n, np.inf)
        for to in range(0, len(b), wide):
            if plain:
                rough = left @ right[to : to + wide].T
                bound = (limit - aa[lo : lo + n] + slack[lo : lo + n]).astype(np.float32)
                if not to and rough.shape[1] > k:  # a first bound, from the kth of this tile
                    first = np.partition(rough, k, axis=1)[:, k]
                    bound = first + 2 * slack[lo : lo + n].astype(np.float32)
            else:
                rough = np.abs(q[:, None] - b[None, to : to + wide]).sum(axis=2)
                bound = limit + 1e-9 * (1 + np.where(np.isinf(limit), 0.0, limit))
            row, at = np.divmod(np.flatnonzero(~(rough > bound[:, None])), rough.shape[1])
            at += to
            usable = ~rest[at] | (names[at] == mine[row])
            row, at = row[usable], at[usable]
            if not len(row):
                continue
            far = np.empty(len(row))
            for i in range(0, len(row), 100_000):
                gap = q[row[i : i + 100_000]] - b[at[i : i + 100_000]]
                far[i : i + 100_000] = np.abs(gap).sum(axis=1) if not plain else (gap**2).sum(axis=1)
            d = far if not plain else far / 2 if distance == "cosine" else np.sqrt(far)
            row, at, d = (np.concatenate(x) for x in zip(best, (row, at, d)))
            sort = np.lexsort((at, np.round(d, 12), names[at] != mine[row], row))  # places are in the order of names
            row, at, d = row[sort], at[sort], d[sort]
            starts = np.searchsorted(row, np.arange(n))
            rank = np.arange(len(row)) - starts[row]
            chosen = rank < k
            best = [row[chosen], at[chosen], d[chosen]]
            last = np.flatnonzero(rank == k - 1)
            edge = d[last] + 1e-12
            limit[row[last]] = edge**2 if distance == "euclidean" else edge * 2 if plain else edge
        out.append((best[0] + lo, names[best[1]], best[2]))
    return tuple(np.concatenate(x) for x in zip(*out))


def knn(vectors: DataFrame, k: int = 10, distance: str = "euclidean", block_rows: int = 4096) -> DataFrame:
    """Exact neighbours ``(i, rank, j, distance)`` of ``(id, v)``; a point is its own first neighbour; ties by id.

    Points are dealt into blocks by a hash of their id and packed, ``PACK`` to a row; each block meets each other one as a pair
    of arrays, so a task holds two blocks, and keeps the k best of each row before anything is shuffled. Blocks have ``block_rows``
    at least and grow with the input up to ``MOST_ROWS``, so that a point is sent at most 2 ``MOST_BLOCKS`` times till then.
    """
    if distance not in ("euclidean", "manhattan", "cosine"):
        raise ValueError("distance is euclidean, manhattan or cosine")
    n = vectors.count()
    blocks = max(1, min(-(-n // block_rows), max(MOST_BLOCKS, -(-n // MOST_ROWS))))
    rows = vectors.select(F.col("id").cast("long"), F.col("v").cast("array<double>"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("b"))

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        ids, x = frame["id"].to_numpy(dtype=np.int64), np.stack(frame["v"].to_numpy()).astype(float)
        cuts = range(0, len(ids), PACK)
        return pd.DataFrame({"b": frame["b"].iloc[0], "ids": [ids[c : c + PACK].tobytes() for c in cuts], "x": [x[c : c + PACK].tobytes() for c in cuts]})

    packs = materialize(rows.groupBy("b").applyInPandas(pack, "b int, ids binary, x binary"), "points")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    ask = packs.select("ids", "x", F.col("b").alias("mine"), every.alias("other"))
    give = packs.select(F.col("ids").alias("names"), F.col("x").alias("y"), every.alias("mine"), F.col("b").alias("other"))

    def unpack(ids: pd.Series, x: pd.Series):
        ids = np.concatenate([np.frombuffer(i, dtype=np.int64) for i in ids])
        return ids, np.concatenate([np.frombuffer(v) for v in x]).reshape(len(ids), -1)

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"i": [], "j": [], "distance": []})
        (ids, a), (names, b) = unpack(left["ids"], left["x"]), unpack(right["names"], right["y"])
        i, j, d = nearest(a, ids, b, names, k, distance)
        return pd.DataFrame({"i": ids[i], "j": j, "distance": d})

    found = ask.groupBy("mine", "other").cogroup(give.groupBy("mine", "other")).applyInPandas(best, "i long, j long, distance double")
    order = Window.partitionBy("i").orderBy(F.col("i") != F.col("j"), F.round("distance", 12), "j")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("i", "rank", "j", "distance")


def snn(neighbours: DataFrame, k: int = 10, prune: float = 0.067) -> DataFrame:
    """``(src, dst)``: pairs with shared-neighbour similarity v / (2k - v) over ``prune``, both ways, and self loops of the rest."""
    side = neighbours.select("i", "j")
    shared = side.select(F.col("i").alias("src"), "j").join(side.select(F.col("i").alias("dst"), "j"), "j").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("v"))
    edges = shared.where(F.col("v") / (k + (k - F.col("v"))).cast("double") > prune).select("src", "dst")
    alone = neighbours.select(F.col("i").alias("src")).distinct().join(edges, "src", "left_anti").select("src", F.col("src").alias("dst"))
    return edges.unionByName(alone)


def label_propagation(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """``(id, label)`` after synchronous rounds: each node takes its neighbours' commonest label, ties the smallest."""
    now = materialize(edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct().withColumn("label", F.col("id")), "labels")
    links = edges.where("src <> dst").select("src", "dst").distinct()
    for _ in range(rounds):
        votes = links.join(now.withColumnRenamed("id", "dst"), "dst").groupBy("src", "label").agg(F.count(F.lit(1)).alias("n"))
        best = votes.groupBy("src").agg(F.max(F.struct("n", (-F.col("label")).alias("m"))).alias("b")).select(F.col("src").alias("id"), (-F.col("b.m")).alias("new"))
        new = materialize(now.join(best, "id", "left").select("id", F.coalesce("new", "label").alias("label"), (F.coalesce("new", "label") != F.col("label")).alias("moved")), "labels")
        release(now)
        now = new.drop("moved")
        now._quern_path = new._quern_path
        if not new.where("moved").limit(1).count():
            break
    return now


#: links of a community that one task splits on; larger ones are split by joins
TASK_LINKS = 500_000


def _side(src: np.ndarray, dst: np.ndarray, d: np.ndarray, twice: float, seed: int) -> np.ndarray | None:
    """Which nodes of a community go apart, by the first eigenvector of its generalised modularity matrix; None if that gains nothing.

    ``src``, ``dst`` are the links inside, ``d`` degrees in the whole graph, whose sum is ``twice``.
    """
    n = len(d)
    if n < 2:
        return None
    own = np.bincount(src, minlength=n) - d * (d.sum() / twice)
    mul = lambda x: np.bincount(src, weights=x[dst], minlength=n) - d * ((d @ x) / twice) - own * x
    if n <= 1000:
        full = -np.outer(d, d) / twice
        np.add.at(full, (src, dst), 1.0)
        x = np.linalg.eigh(full - np.diag(own))[1][:, -1]
    else:  # Lanczos, every vector kept orthogonal
        q = np.random.default_rng(seed).normal(size=n)
        held, diag, off = [q / np.linalg.norm(q)], [], []
        for _ in range(150):
            q = mul(held[-1])
            diag.append(float(q @ held[-1]))
            for _ in range(2):
                for h in held:
                    q -= (q @ h) * h
            size = float(np.linalg.norm(q))
            if size < 1e-10 * max(1.0, float(d.max())):
                break
            off.append(size)
            held.append(q / size)
        off = off[: len(diag) - 1]
        x = np.linalg.eigh(np.diag(diag) + np.diag(off, 1) + np.diag(off, -1))[1][:, -1] @ np.stack(held[: len(diag)])
    apart = x < 0
    s = np.where(apart, -1.0, 1.0)
    return apart if apart.any() and not apart.all() and s @ mul(s) > 1e-9 * twice else None


def split_community(src: np.ndarray, dst: np.ndarray, d: np.ndarray, twice: float, seed: int = 42) -> np.ndarray:
    """Labels from 0 of a community's nodes, split in two again and again while modularity grows."""
    label, last, todo = np.zeros(len(d), dtype=np.int64), 0, [(np.arange(len(d)), src, dst)]
    while todo:
        members, src, dst = todo.pop()
        apart = _side(src, dst, d[members], twice, seed)
        if apart is None:
            continue
        last += 1
        label[members[apart]] = last
        for part in (apart, ~apart):
            place = np.cumsum(part) - 1
            inside = part[src] & part[dst]
            todo.append((members[part], place[src[inside]], place[dst[inside]]))
    return label


def _split_by_joins(nodes: DataFrame, inner: DataFrame, twice: float, rounds: int, seed: int) -> DataFrame:
    """``nodes(id, d, label)`` with ``apart``: each community's split by power iteration, false for all of one that gains nothing."""
    own = inner.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).cast("double").alias("k"))
    whole = nodes.groupBy("label").agg(F.sum("d").alias("whole"))
    base = nodes.join(own, "id", "left").fillna(0.0, ["k"]).join(whole, "label").withColumn("own", F.col("k") - F.col("d") * F.col("whole") / twice)
    # shifted by the largest degree inside, so that the wanted eigenvalue is the largest in size
    tops = base.groupBy("label").agg(F.greatest(F.max("k"), F.lit(1.0)).alias("top"))
    start = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1000)) / 500.0 - 1.0
    now = materialize(base.join(tops, "label").select("id", "d", "label", "own", "top", start.alias("x")), "eigen")

    def times(now):  # the modularity matrix times x, as y
        sums = now.groupBy("label").agg((F.sum(F.col("d") * F.col("x")) / twice).alias("s"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("n"))
        pulled = inner.join(now.select(F.col("id").alias("dst"), "x"), "dst").groupBy(F.col("src").alias("id")).agg(F.sum("x").alias("a"))
        return now.join(pulled, "id", "left").join(sums, "label").withColumn("y", F.coalesce("a", F.lit(0.0)) - F.col("d") * F.col("s") - F.col("own") * F.col("x"))

    for _ in range(rounds):
        x = (F.col("y") + F.col("x") * F.col("top")) / (F.when(F.col("n") > 0, F.col("n")).otherwise(1.0) * F.col("top"))
        new = materialize(times(now).select("id", "d", "label", "own", "top", x.alias("x")), "eigen")
        release(now)
        now = new
    signs = now.withColumn("x", F.when(F.col("x") < 0, -1.0).otherwise(1.0))
    gains = times(signs).groupBy("label").agg(F.sum(F.col("x") * F.col("y")).alias("gain"), F.min("x").alias("low"), F.max("x").alias("high"))
    kept = gains.select("label", ((F.col("gain") > 1e-9 * twice) & (F.col("low") < F.col("high"))).alias("splits"))
    out = materialize(signs.join(kept, "label").select("id", "d", "label", "splits", (F.col("splits") & (F.col("x") < 0)).alias("apart")), "sides")
    release(now)
    return out


def leading_eigenvector(edges: DataFrame, rounds: int = 60, seed: int = 42) -> DataFrame:
    """``(id, label)``: communities split by the sign of the modularity matrix's first eigenvector, again inside each while modularity grows.

    Communities of more than ``TASK_LINKS`` links are split all at once by ``rounds`` of power iteration in joins;
    each smaller one is a task that splits it to the end.
    """
    links = materialize(edges.where("src <> dst").select("src", "dst").distinct(), "graph")
    degree = links.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).cast("double").alias("d"))
    nodes = materialize(degree.select("id", "d", F.lit(0).cast("long").alias("label"), F.lit(True).alias("open")), "communities")
    twice = nodes.agg(F.sum("d")).first()[0] or 1.0
    level = 0
    while True:
        ends = [nodes.where("open").select(F.col("id").alias(end), F.col("label").alias(name)) for end, name in (("src", "label"), ("dst", "other"))]
        inner = materialize(links.join(ends[0], "src").join(ends[1], "dst").where("label = other").select("label", "src", "dst"), "inner")
        large = inner.groupBy("label").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > TASK_LINKS).select("label")
        if not large.limit(1).count():
            break
        level += 1
        some = materialize(nodes.where("open").join(large, "label", "left_semi").select("id", "d", "label"), "large")
        split = _split_by_joins(some, inner.join(large, "label", "left_semi"), twice, rounds, seed)
        label = F.when(F.col("apart"), F.xxhash64("label", F.lit(level))).otherwise(F.col("label"))
        rest = nodes.join(some.select("id"), "id", "left_anti")
        new = materialize(rest.unionAll(split.select("id", "d", label.alias("label"), F.col("splits").alias("open"))), "communities")
        for old in (nodes, inner, some, split):
            release(old)
        nodes = new

    kind = edges.schema["src"].dataType.simpleString()

    def run(mine: pd.DataFrame, within: pd.DataFrame) -> pd.DataFrame:
        mine = mine.sort_values("id")
        names = pd.Index(mine["id"])
        src, dst = (names.get_indexer(within[c]) for c in ("src", "dst"))
        parts = split_community(src, dst, mine["d"].to_numpy(), twice, seed)
        return pd.DataFrame({"id": names, "label": mine["label"].to_numpy(), "part": parts})

    tasks = nodes.where("open").groupBy("label").cogroup(inner.groupBy("label")).applyInPandas(run, f"id {kind}, label long, part long")
    found = materialize(tasks.unionAll(nodes.where("not open").select("id", "label", F.lit(0).cast("long").alias("part"))), "parts")
    firsts = found.groupBy("label", "part").agg(F.min("id").alias("first"))
    order = firsts.withColumn("number", F.row_number().over(Window.orderBy("first")) - 1).drop("first")  # a row a community
    return found.join(order, ["label", "part"]).select("id", F.col("number").alias("label"))


# kernels on an edge list that fits the driver

MAX_EDGES = 5_000_000


class Graph:
    """An undirected weighted graph as neighbour dictionaries, nodes numbered from 0."""

    def __init__(self, n: int):
        self.near: list[dict[int, float]] = [{} for _ in range(n)]

    def add(self, i: int, j: int, w: float = 1.0) -> None:
        self.near[i][j] = self.near[i].get(j, 0.0) + w
        if i != j:
            self.near[j][i] = self.near[j].get(i, 0.0) + w

    @property
    def strength(self) -> np.ndarray:
        return np.array([sum(x.values()) + x.get(i, 0.0) for i, x in enumerate(self.near)])

    @property
    def total(self) -> float:
        return float(self.strength.sum()) / 2


def collected(edges: DataFrame) -> tuple[list, Graph]:
    rows = edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct().limit(MAX_EDGES + 1).toArrow().to_pandas()
    if len(rows) > MAX_EDGES:
        raise ValueError(f"this kernel takes at most {MAX_EDGES} edges; use label_propagation or leading_eigenvector")
    rows = rows.sort_values(["a", "b"])
    names = sorted(edges.select("src").union(edges.select("dst")).distinct().toArrow().column(0).to_pylist())
    place = {x: i for i, x in enumerate(names)}
    graph = Graph(len(names))
    for a, b in zip(rows["a"].tolist(), rows["b"].tolist()):
        graph.add(place[a], place[b])
    return names, graph


def modularity(graph: Graph, label, resolution: float = 1.0) -> float:
    strength, total = graph.strength, graph.total or 1.0
    inside = sum(w * (2 if i == j else 1) for i, near in enumerate(graph.near) for j, w in near.items() if label[i] == label[j])
    by = {}
    for i, c in enumerate(label):
        by[c] = by.get(c, 0.0) + strength[i]
    return inside / (2 * total) - resolution * sum(s * s for s in by.values()) / (2 * total) ** 2


def _move(graph: Graph, label: list[int], resolution: float, rnd, within=None) -> bool:
    """Local moves to the neighbouring community of largest gain until none is left; ``within`` confines them."""
    strength, two = graph.strength.tolist(), 2 * graph.total or 1.0
    held: dict[int, float] = {}
    for i, c in enumerate(label):
        held[c] = held.get(c, 0.0) + strength[i]
    queue, waiting, moved = deque(rnd.permutation(len(label)).tolist()), set(range(len(label))), False
    while queue:
        i = queue.popleft()
        waiting.discard(i)
        links: dict[int, float] = {label[i]: 0.0}
        for j, w in graph.near[i].items():
            if j != i and (within is None or within[j] == within[i]):
                links[label[j]] = links.get(label[j], 0.0) + w
        held[label[i]] -= strength[i]
        gain = {c: w - resolution * strength[i] * held.get(c, 0.0) / two for c, w in links.items()}
        best = max(gain, key=lambda c: (gain[c], c == label[i], -c))
        held[best] = held.get(best, 0.0) + strength[i]
        if best != label[i] and gain[best] > gain[label[i]] + 1e-12:
            label[i], moved = best, True
            for j in graph.near[i]:
                if label[j] != best and j not in waiting:
                    waiting.add(j)
                    queue.append(j)
        elif best != label[i]:
            held[best] -= strength[i]
            held[label[i]] += strength[i]
    return moved


def _merged(graph: Graph, label: list[int]) -> tuple[Graph, list[int]]:
    names = {c: k for k, c in enumerate(dict.fromkeys(label))}
    number = [names[c] for c in label]
    out = Graph(len(names))
    for i, near in enumerate(graph.near):
        for j, w in near.items():
            if i <= j:
                out.add(number[i], number[j], w)
    return out, number


def _communities(graph: Graph, resolution: float, seed: int, refine: bool, passes: int = 10) -> list[int]:
    rnd = np.random.default_rng(seed)
    best = list(range(len(graph.near)))
    for _ in range(passes if refine else 1):
        level, place = graph, list(range(len(graph.near)))
        label = list(best)
        while True:
            moved = _move(level, label, resolution, rnd)
            names = {c: k for k, c in enumerate(dict.fromkeys(label))}
            parts = [names[c] for c in label]
            if refine:
                fine = list(range(len(level.near)))
                _move(level, fine, resolution, rnd, within=parts)
            else:
                fine = parts
            nxt, number = _merged(level, fine)
            if len(nxt.near) == len(level.near) or not moved and not refine:
                break
            above = [0] * len(nxt.near)
            for i, k in enumerate(number):
                above[k] = parts[i]
            place, level, label = [number[p] for p in place], nxt, above if refine else list(range(len(nxt.near)))
        flat = [label[p] for p in place]
        if modularity(graph, flat, resolution) <= modularity(graph, best, resolution) + 1e-12:
            break
        best = flat
    return best


def louvain(graph: Graph, resolution: float = 0.8, seed: int = 42) -> list[int]:
    """Blondel et al. 2008: moves, then the graph of communities, until nothing moves."""
    return _communities(graph, resolution, seed, refine=False)


def leiden(graph: Graph, resolution: float = 0.8, seed: int = 42) -> list[int]:
    """Traag et al. 2019: communities are refined from single nodes before the graph is merged; repeated while it improves."""
    return _communities(graph, resolution, seed, refine=True)


def multilevel(graph: Graph, seed: int = 42) -> list[int]:
    return louvain(graph, 1.0, seed)


def _walks(graph: Graph, steps: int, chunk: int = 2048):
    """For each node the places a walk of so many steps reaches and its chances there over the root of their degrees, without zeros."""
    n = len(graph.near)
    lines = []
    for i, near in enumerate(graph.near):
        line = dict(near)
        line[i] = line.get(i, 0.0) + (sum(near.values()) / len(near) if near else 1.0)
        lines.append(line)
    sizes = np.array([len(x) for x in lines])
    start = np.append(0, np.cumsum(sizes))
    to = np.fromiter((j for x in lines for j in x), dtype=np.int64, count=start[-1])
    p = np.fromiter((w for x in lines for w in x.values()), dtype=float, count=start[-1])
    degree = np.bincount(np.repeat(np.arange(n), sizes), weights=p, minlength=n)
    p = p / np.repeat(degree, sizes)
    for lo in range(0, n, chunk):
        row = at = np.arange(lo, min(n, lo + chunk))
        row, v = row - lo, np.ones(len(at))
        for _ in range(steps):
            many = sizes[at]
            edge = np.repeat(start[at] - np.append(0, np.cumsum(many)[:-1]), many) + np.arange(many.sum())
            key, place = np.unique(np.repeat(row, many) * n + to[edge], return_inverse=True)
            v = np.bincount(place, weights=np.repeat(v, many) * p[edge])
            row, at = np.divmod(key, n)
        v = v / np.sqrt(degree[at])
        cuts = np.searchsorted(row, np.arange(1, min(n, lo + chunk) - lo))
        yield from zip(np.split(at.astype(np.int32), cuts), np.split(v, cuts))


def walktrap(graph: Graph, steps: int = 4) -> list[int]:
    """Pons and Latapy 2005: Ward merging of neighbouring communities by random-walk distance, cut at the best modularity."""
    n = len(graph.near)
    if n < 2:
        return [0] * n
    rows = dict(enumerate(_walks(graph, steps)))
    square = {i: float(v @ v) for i, (_, v) in rows.items()}
    size = dict.fromkeys(range(n), 1)
    near = {i: {j for j in graph.near[i] if j != i} for i in range(n)}
    strength, total = graph.strength.tolist(), graph.total or 1.0
    links = {i: {j: w for j, w in near_i.items() if j != i} for i, near_i in enumerate(graph.near)}
    now = top = modularity(graph, list(range(n)))
    merges: list[tuple[int, int]] = []
    kept = 0

    def gap(a, b):
        (i, v), (j, w) = (rows[a], rows[b]) if len(rows[a][0]) < len(rows[b][0]) else (rows[b], rows[a])
        at = j.searchsorted(i).clip(max=len(j) - 1)
        common = float(v[j[at] == i] @ w[at[j[at] == i]])
        return size[a] * size[b] / (size[a] + size[b]) * max(0.0, square[a] + square[b] - 2 * common)

    heap = [(gap(a, b), a, b) for a in near for b in near[a] if a < b]
    heapq.heapify(heap)
    age = dict.fromkeys(size, 0)  # entries made before a part last changed are passed over
    made = {(a, b): 0 for _, a, b in heap}
    turn = 0
    while heap:
        _, a, b = heapq.heappop(heap)
        if a not in near or b not in near or made.get((a, b), -1) < max(age[a], age[b]):
            continue
        turn += 1
        (i, v), (j, w), both = rows[a], rows.pop(b), size[a] + size[b]
        names, place = np.unique(np.concatenate([i, j]), return_inverse=True)
        mean = np.bincount(place, weights=np.concatenate([v * (size[a] / both), w * (size.pop(b) / both)]))
        rows[a], square[a], size[a] = (names, mean), float(mean @ mean), both
        around = (near.pop(a) | near.pop(b)) - {a, b}
        near[a], age[a] = around, turn
        for c in around:
            near[c] = (near[c] - {b}) | {a}
            pair = min(a, c), max(a, c)
            made[pair] = turn
            heapq.heappush(heap, (gap(a, c), *pair))
        # merging a and b changes modularity by their links less the expected ones
        now += links[a].get(b, 0.0) / total - strength[a] * strength[b] / (2 * total * total)
        for c, w in links.pop(b).items():
            if c != a:
                links[a][c] = links[a].get(c, 0.0) + w
                links[c][a] = links[a][c]
                links[c].pop(b, None)
        links[a].pop(b, None)
        strength[a] += strength[b]
        merges.append((a, b))
        if now > top + 1e-12:
            kept, top = len(merges), now
    label = list(range(n))
    for a, b in reversed(merges[:kept]):
        label[b] = a
    for i in range(n):
        while label[label[i]] != label[i]:
            label[i] = label[label[i]]
        label[i] = label[label[i]]
    return label


def _stationary(graph: Graph) -> np.ndarray:
    s = graph.strength
    return s / (s.sum() or 1.0)


def infomap(graph: Graph, seed: int = 42, rounds: int = 20) -> list[int]:
    """Rosvall and Bergstrom 2008: greedy moves that shorten the two-level map equation."""
    n, two, rnd = len(graph.near), 2 * graph.total or 1.0, np.random.default_rng(seed)
    visit = _stationary(graph)
    plogp = lambda x: x * math.log2(x) if x > 1e-15 else 0.0
    label = list(range(n))
    leave = [sum(w for j, w in near.items() if j != i) / two for i, near in enumerate(graph.near)]
    out, inside = dict(enumerate(leave)), dict(enumerate(visit))
    total = sum(out.values())
    for _ in range(rounds):
        moved = False
        for i in rnd.permutation(n):
            here, links = label[i], {}
            for j, w in graph.near[i].items():
                if j != i:
                    links[label[j]] = links.get(label[j], 0.0) + w / two
            own = links.get(here, 0.0)
            # the module without the node
            o_here, i_here = out[here] - leave[i] + 2 * own, inside[here] - visit[i]
            best, low = here, 0.0
            for c, w in links.items():
                if c == here:
                    continue
                o_new, i_new = out[c] + leave[i] - 2 * w, inside[c] + visit[i]
                t = total - out[here] - out[c] + o_here + o_new
                change = plogp(t) - plogp(total)
                change -= 2 * (plogp(o_here) + plogp(o_new) - plogp(out[here]) - plogp(out[c]))
                change += plogp(o_here + i_here) + plogp(o_new + i_new) - plogp(out[here] + inside[here]) - plogp(out[c] + inside[c])
                if change < low - 1e-12:
                    best, low = c, change
            if best != here:
                w = links[best]
                total += o_here - out[here] + leave[i] - 2 * w
                out[here], inside[here] = o_here, i_here
                out[best], inside[best] = out[best] + leave[i] - 2 * w, inside[best] + visit[i]
                label[i], moved = best, True
        if not moved:
            break
    return label


def spinglass(graph: Graph, spins: int = 25, gamma: float = 1.0, cool: float = 0.97, seed: int = 42) -> list[int]:
    """Reichardt and Bornholdt 2006: heat-bath annealing of a Potts model against the configuration model.

    A sweep draws groups of nodes at once, none of them neighbours and each a 64th of all at most, so that their links see
    each other's present spins and the sums by spin lag behind by less than a group.
    """
    n, rnd, strength, two = len(graph.near), np.random.default_rng(seed), graph.strength, 2 * graph.total or 1.0
    label = rnd.integers(0, spins, n)
    held = np.bincount(label, weights=strength, minlength=spins)
    heat = float(max(strength.max(initial=1.0) / 2, 1.0))
    colour = [0] * n  # greedy, hubs first; 0 stands for nodes without links, whose spins are as drawn
    for i in np.argsort([-len(x) for x in graph.near], kind="stable").tolist():
        around = {colour[j] for j in graph.near[i] if j != i}
        if around:
            colour[i] = next(c for c in range(1, len(around) + 2) if c not in around)
    colour, groups = np.asarray(colour), []
    for c in range(1, colour.max(initial=0) + 1):
        nodes = rnd.permutation(np.flatnonzero(colour == c))
        for part in np.array_split(nodes, -(-len(nodes) // max(1, n // 64))):
            links = [(k, j, w) for k, i in enumerate(part.tolist()) for j, w in graph.near[i].items() if j != i]
            row, to, weight = (np.array(x) for x in zip(*links))
            groups.append((part, row, to, weight))
    while heat > 0.01:
        for g in rnd.permutation(len(groups)):
            part, row, to, weight = groups[g]
            own, k = strength[part], np.arange(len(part))
            field = np.bincount(row * spins + label[to], weights=weight, minlength=len(part) * spins).reshape(len(part), spins)
            field -= (gamma / two) * own[:, None] * held
            field[k, label[part]] += (gamma / two) * own * own  # without the node itself
            field -= field.max(axis=1, keepdims=True)
            total = np.exp(field / heat).cumsum(axis=1)
            held = held - np.bincount(label[part], weights=own, minlength=spins)
            label[part] = (total < (rnd.random(len(part)) * total[:, -1])[:, None]).sum(axis=1).clip(0, spins - 1)
            held += np.bincount(label[part], weights=own, minlength=spins)
        heat *= cool
    out = label.tolist()
    _move(graph, out, gamma, rnd)
    return out


KERNELS = {"leiden": leiden, "louvain": louvain, "multilevel": multilevel, "walktrap": walktrap, "infomap": infomap, "spinglass": spinglass}


def communities(edges: DataFrame, algorithm: str = "leiden", **args) -> DataFrame:
    """``(id, cluster)``, clusters numbered from 0 by falling size."""
    if algorithm in ("label_prop", "leading_eigenvector"):
        found = (label_propagation if algorithm == "label_prop" else leading_eigenvector)(edges, **args)
        sizes = found.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
        order = sizes.withColumn("cluster", F.row_number().over(Window.orderBy(F.desc("n"), "label")) - 1)
        return found.join(order, "label").select("id", "cluster")
    if algorithm not in KERNELS:
        raise ValueError(f"no algorithm {algorithm!r}")
    names, graph = collected(edges)
    label = KERNELS[algorithm](graph, **args)
    found, first, number, count = np.unique(np.asarray(label), return_index=True, return_inverse=True, return_counts=True)
    place = np.empty(len(found), dtype=np.int32)
    place[np.lexsort((first, -count))] = np.arange(len(found))
    kind = edges.schema["src"].dataType.simpleString()
    return edges.sparkSession.createDataFrame(pa.table({"id": names, "cluster": place[number]}), f"id {kind}, cluster int")


def generate(vectors: DataFrame, k: int = 10, algorithm: str = "leiden", prune: float = 0.067, distance: str = "euclidean", **args) -> DataFrame:
    """kNN, shared-neighbour graph, communities: ``(id, cluster)``."""
    return communities(materialize(snn(knn(vectors, k, distance), k, prune), "snn"), algorithm, **args)


# trajectories


def cluster_distances(points: DataFrame, min_size: int = 10) -> DataFrame:
    """``(a, b, distance)`` of clusters a < b in ``(cluster, x, y)``: (m1 - m2)' (S1 + S2)^-1 (m1 - m2)."""
    by = points.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n"), F.avg("x").alias("x"), F.avg("y").alias("y"), F.var_samp("x").alias("xx"), F.var_samp("y").alias("yy"), F.covar_samp("x", "y").alias("xy")
    ).where(F.col("n") >= min_size)
    side = lambda s: by.select(*[F.col(c).alias(f"{c}_{s}") for c in ("cluster", "x", "y", "xx", "yy", "xy")])
    pairs = side("a").join(side("b"), F.col("cluster_a") < F.col("cluster_b"))
    xx, yy, xy = (F.col(f"{c}_a") + F.col(f"{c}_b") for c in ("xx", "yy", "xy"))
    dx, dy = F.col("x_a") - F.col("x_b"), F.col("y_a") - F.col("y_b")
    det = xx * yy - xy * xy
    return pairs.select(F.col("cluster_a").alias("a"), F.col("cluster_b").alias("b"), ((dx * dx * yy - 2 * dx * dy * xy + dy * dy * xx) / F.nullif(det, F.lit(0.0))).alias("distance"))


def slingshot(points: DataFrame, min_size: int = 10, omega: float | None = None) -> tuple[DataFrame, DataFrame]:
    """``(lineages(id, path), edges(src, dst))`` from a minimum spanning forest of clusters (Street et al. 2018).

    Clusters may hang on an artificial node at distance ``omega`` (None: the largest distance / 2 + 1e-9), which splits the
    tree into a forest. Each tree starts at the leaf with the longest mean path; lineages lead from there to the other leaves.
    """
    spark = points.sparkSession
    rows = cluster_distances(points, min_size).collect()  # clusters squared
    nodes = sorted({r["a"] for r in rows} | {r["b"] for r in rows})
    if not nodes:
        nodes = sorted(r["cluster"] for r in points.groupBy("cluster").count().where(F.col("count") >= min_size).collect())
    dist = {(r["a"], r["b"]): r["distance"] if r["distance"] is not None else math.inf for r in rows}
    finite = [d for d in dist.values() if math.isfinite(d)]
    far = omega if omega is not None else (max(finite, default=1.0) / 2 + 1e-9)
    root = {n: n for n in [*nodes, "apart"]}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = sorted([(d, 0, a, b) for (a, b), d in dist.items()] + [(far, 1, n, "apart") for n in nodes], key=lambda t: (t[0], t[1], str(t[2])))
    tree = {n: set() for n in nodes}
    for d, extra, a, b in links:
        if math.isfinite(d) and find(a) != find(b):
            root[find(a)] = find(b)
            if not extra:
                tree[a].add(b)
                tree[b].add(a)

    def paths(start):
        found, todo = {start: [start]}, [start]
        while todo:
            x = todo.pop()
            for y in sorted(tree[x]):
                if y not in found:
                    found[y] = [*found[x], y]
                    todo.append(y)
        return found

    lineages, seen = [], set()
    for n in nodes:
        if n in seen:
            continue
        part = paths(n)
        seen |= set(part)
        leaves = [x for x in part if len(tree[x]) <= 1]
        mean = {x: sum(len(p) - 1 for y, p in paths(x).items() if y in leaves) / max(1, len(leaves) - 1) for x in leaves}
        start = max(leaves, key=lambda x: (mean[x], -nodes.index(x)))
        ends = [p for y, p in paths(start).items() if y in leaves and y != start] or [[start]]
        lineages += ends
    lineages.sort(key=lambda p: (-len(p), [nodes.index(x) for x in p]))
    kind = points.schema["cluster"].dataType.simpleString()
    out = spark.createDataFrame([(i + 1, p) for i, p in enumerate(lineages)], f"id int, path array<{kind}>")
    return out, spark.createDataFrame([(a, b) for a in nodes for b in sorted(tree[a])], f"src {kind}, dst {kind}")


def cluster_tree(means: pd.DataFrame, method: str = "complete") -> pd.DataFrame:
    """Hierarchical linkage of cluster means, a row a cluster."""
    return pd.DataFrame(linkage(means.to_numpy(dtype=float), method), columns=["i", "j", "distance", "size"])
