"""Matrix kernels: truncated SVD by Lanczos, distributed cross products, hierarchical linkage, NNLS."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


class MatrixShapeError(ValueError):
    """The matrix is too small for a truncated decomposition."""


class VectorLengthError(ValueError):
    """A vector doesn't fit the matrix."""


def lanczos(a: np.ndarray, nval: int, tol: float = 1e-4, maxit: int = 50, center=None, scale=None, seed: int = 42):
    """The ``nval`` largest singular triplets ``(u, s, v, steps)`` of (a - center) / scale.

    Golub-Kahan bidiagonalisation with full reorthogonalisation. The subspace grows by blocks until the
    residuals of the wanted triplets are under ``tol`` times the largest value.
    """
    m, n = a.shape
    if m < 2 or n < 2:
        raise MatrixShapeError("the matrix must be 2 x 2 at least")
    center = np.zeros(n) if center is None else np.asarray(center, dtype=float)
    scale = np.ones(n) if scale is None else np.asarray(scale, dtype=float)
    if len(center) != n or len(scale) != n:
        raise VectorLengthError("center and scale have a value for each column")
    nval = min(nval, m, n)
    mul = lambda x: a @ (x / scale) - center @ (x / scale)
    back = lambda y: (a.T @ y - center * y.sum()) / scale
    rnd = np.random.default_rng(seed)
    limit = min(m, n)
    vs, us, alpha, beta = [], [], [], []
    v = rnd.normal(size=n)
    v /= np.linalg.norm(v)
    block = max(nval + 7, 20)
    for turn in range(maxit):
        while len(us) < min(limit, block * (turn + 1)):
            vs.append(v)
            u = mul(v) - (beta[-1] * us[-1] if us else 0)
            for _ in range(2):
                for w in us:
                    u -= (w @ u) * w
            size = np.linalg.norm(u)
            if size < 1e-12:
                u = rnd.normal(size=m)
                for w in us:
                    u -= (w @ u) * w
                u /= np.linalg.norm(u)
                size = 0.0
            else:
                u /= size
            us.append(u)
            alpha.append(size)
            v = back(u) - size * vs[-1]
            for _ in range(2):
                for w in vs:
                    v -= (w @ v) * w
            size = np.linalg.norm(v)
            if size < 1e-12:
                v = rnd.normal(size=n)
                for w in vs:
                    v -= (w @ v) * w
                v /= np.linalg.norm(v) or 1.0
                size = 0.0
            else:
                v /= size
            beta.append(size)
        k = len(us)
        b = np.diag(alpha) + np.diag(beta[: k - 1], 1)
        p, s, qt = np.linalg.svd(b)
        if k == limit or (beta[-1] * np.abs(p[-1, :nval]) <= tol * s[0]).all():
            break
    u, v = np.array(us).T @ p[:, :nval], np.array(vs).T @ qt[:nval].T
    return u, s[:nval], v, len(us)


def cross_product(vectors: DataFrame, dim: int, column: str = "v") -> tuple[int, np.ndarray, np.ndarray]:
    """``(rows, sums, X'X)`` of an array column: a partial product by partition, added up in the shuffle by row.

    The driver receives ``dim`` squared numbers; ``dim`` is the number of selected genes, not of cells.
    """

    def run(batches):
        n, total, square = 0, np.zeros(dim), np.zeros((dim, dim))
        for batch in batches:
            for lo in range(0, len(batch), 2048):
                x = np.stack(batch[column].iloc[lo : lo + 2048].to_numpy()).astype(float)
                n, total, square = n + len(x), total + x.sum(axis=0), square + x.T @ x
        if n:
            rows = [np.concatenate([[n], total]), *square]
            yield pd.DataFrame({"i": range(-1, dim), "x": [r.tolist() for r in rows]})

    parts = vectors.select(column).mapInPandas(run, "i int, x array<double>")

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": frame["i"].iloc[:1], "x": [np.sum(np.stack(frame["x"].to_numpy()), axis=0).tolist()]})

    got = {r["i"]: np.array(r["x"]) for r in parts.groupBy("i").applyInPandas(add, "i int, x array<double>").collect()}
    if not got:
        return 0, np.zeros(dim), np.zeros((dim, dim))
    return int(got[-1][0]), got[-1][1:], np.stack([got[i] for i in range(dim)])


def fix_signs(loadings: np.ndarray) -> np.ndarray:
    """Each column's entry of largest size made positive."""
    top = np.abs(loadings).argmax(axis=0)
    sign = np.sign(loadings[top, np.arange(loadings.shape[1])])
    return loadings * np.where(sign == 0, 1, sign)


def linkage(points: np.ndarray, method: str = "complete") -> np.ndarray:
    """Agglomerative clustering rows ``(i, j, distance, size)`` by the Lance-Williams update."""
    methods = ("complete", "single", "average", "weighted", "centroid", "median", "ward")
    if method not in methods:
        raise ValueError(f"method is one of {methods}")
    n = len(points)
    dist = np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2))
    squared = method in ("centroid", "median", "ward")
    dist = dist**2 if squared else dist
    live, size, name, out = list(range(n)), {i: 1 for i in range(n)}, {i: i for i in range(n)}, []
    for step in range(n - 1):
        d, i, j = min((dist[a, b], a, b) for x, a in enumerate(live) for b in live[x + 1 :])
        for k in live:
            if k in (i, j):
                continue
            a, b, c = dist[i, k], dist[j, k], dist[i, j]
            ni, nj, nk = size[i], size[j], size[k]
            new = {
                "complete": lambda: max(a, b),
                "single": lambda: min(a, b),
                "average": lambda: (ni * a + nj * b) / (ni + nj),
                "weighted": lambda: (a + b) / 2,
                "centroid": lambda: (ni * a + nj * b) / (ni + nj) - ni * nj * c / (ni + nj) ** 2,
                "median": lambda: (a + b) / 2 - c / 4,
                "ward": lambda: ((ni + nk) * a + (nj + nk) * b - nk * c) / (ni + nj + nk),
            }[method]()
            dist[i, k] = dist[k, i] = new
        size[i] += size[j]
        live.remove(j)
        first, second = sorted((name[i], name[j]))
        out.append((first, second, float(np.sqrt(max(d, 0))) if squared else float(d), size[i]))
        name[i] = n + step
    return np.array(out).reshape(-1, 4)


def nnls(a: np.ndarray, b: np.ndarray, ridge: float = 0.0, steps: int = 2000, tol: float = 1e-10) -> np.ndarray:
    """Non-negative least squares with an optional ridge, by coordinate descent on the normal equations."""
    gram, target = a.T @ a + ridge * np.eye(a.shape[1]), a.T @ b
    x = np.zeros(a.shape[1])
    slope = -target.astype(float)
    for _ in range(steps):
        most = 0.0
        for i in range(len(x)):
            if gram[i, i] <= 0:
                continue
            new = max(0.0, x[i] - slope[i] / gram[i, i])
            if new != x[i]:
                slope += gram[:, i] * (new - x[i])
                most = max(most, abs(new - x[i]))
                x[i] = new
        if most < tol * (1 + np.abs(x).max(initial=0.0)):
            break
    return x


def nonnegative_ridge(a: np.ndarray, b: np.ndarray, ridge: float) -> np.ndarray:
    """The minimum of ``|a x - b|^2 + ridge |x|^2`` over x >= 0, for ridge > 0, by block principal pivoting (Kim and Park, 2011).

    Holds no matrix larger than ``a`` or than the square of its smaller side, so that columns can be many.
    """
    m, n = a.shape
    target = a.T @ b
    active = np.zeros(n, dtype=bool)
    x, slope = np.zeros(n), -target
    tol = 1e-10 * max(1.0, float(np.abs(target).max(initial=0.0)))
    best, tries = n + 1, 3
    while True:
        wrong = np.where(active, x < -tol, slope < -tol)
        count = int(wrong.sum())
        if not count:
            return np.maximum(x, 0.0)
        if count < best:
            best, tries = count, 3
        elif tries:
            tries -= 1
        else:  # one at a time always ends
            wrong = np.arange(n) == np.flatnonzero(wrong)[-1]
        active = active ^ wrong
        part, t = a[:, active], target[active]
        x = np.zeros(n)
        if part.shape[1] <= m:
            x[active] = np.linalg.solve(part.T @ part + ridge * np.eye(part.shape[1]), t)
        else:
            x[active] = part.T @ np.linalg.solve(part @ part.T + ridge * np.eye(m), b)
        slope = np.where(active, 0.0, a.T @ (part @ x[active]) - target)
