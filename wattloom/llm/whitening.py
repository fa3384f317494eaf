"""Whitening of embeddings by the singular values of the centred rows.

Entries become whole numbers x, so counts and sums are exact. Rows are centred by (n x - S) / n and reduced to a triangle R, block by block in a task and
triangle by triangle between tasks (FAN at once); no products of rows are summed, so nothing is squared before the solver. Householder
reflections bring R to an upper bidiagonal B = U' R V. dqds with Newton shifts (1 / trace of the inverse, never above the least eigenvalue) finds the
squared singular values to high relative accuracy, and twisted factorisations of B'B less each eigenvalue give the directions.
Eigenvalues too close to tell apart (CLOSE) get their directions by inverse iteration with the same factorisations, each kept orthogonal to those before.

Rows whose vector is null, empty or holds a null, a non-finite entry or one beyond 2^43 (which no double holds to the unit after scaling) are dropped. Vectors of each length
are fitted by themselves. Repeated rows count each, and vec_id may be null. A direction without variance has no whitened value (null). A deviation
beyond 64 bits is null. An empty table gives no rows. Other columns are not looked at."""
from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wattloom.session import cut_lineage

#: Rows reduced at once, triangles reduced at once, and relative gap below which eigenvalues share a space.
BLOCK, FAN, CLOSE = 4096, 16, 1e-5
EPS = np.finfo(float).eps


# ------------------------------------------------------------------ the solver: a triangle of bounded size
def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal and superdiagonal of B, and V, with R = U B V' for some orthogonal U."""
    a, d = np.array(r, float), r.shape[1]
    v = np.eye(d)

    def reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
        w, norm = x.copy(), np.linalg.norm(x)
        w[0] += math.copysign(norm, x[0])
        size = w @ w
        return w, 2 / size if size > 0 else 0.0
    for k in range(d):
        w, t = reflector(a[k:, k])
        a[k:, k:] -= np.outer(t * w, w @ a[k:, k:])
        if k < d - 2:
            w, t = reflector(a[k, k + 1:])
            a[k:, k + 1:] -= np.outer(a[k:, k + 1:] @ w, t * w)
            v[:, k + 1:] -= np.outer(v[:, k + 1:] @ w, t * w)
    return np.diag(a).copy(), np.diag(a, 1).copy(), v


def dqds(q: list[float], e: list[float]) -> list[float]:
    """Eigenvalues of B'B, largest first, from the squares of B's diagonal (none is 0) and superdiagonal."""
    out, waiting, tol = [], [(list(q), list(e), 0.0)], (4 * EPS) ** 2
    while waiting:
        q, e, shift = waiting.pop()
        while len(q) > 1:
            n = len(q)
            if q[0] * 1.5 < q[-1]:                            # small values belong at the end
                q.reverse()
                e.reverse()
            gap = next((i for i in range(n - 2, -1, -1) if e[i] <= tol * (shift + min(q[i], q[i + 1]))), None)
            if gap is not None:
                waiting.append((q[:gap + 1], e[:gap], shift))
                q, e = q[gap + 1:], e[gap + 1:]
                continue
            d = q[0]
            inverse = 1 / d
            for i in range(n - 1):
                d *= q[i + 1] / (d + e[i])
                inverse += 1 / d if d else math.inf
            newton = 1 / inverse
            for s in (newton, newton * (1 - 64 * n * EPS), newton / 2, 0.0):
                d, q2, e2 = q[0] - s, [], []
                for i in range(n - 1):
                    if d < 0 or (up := d + e[i]) <= 0:
                        break
                    t = q[i + 1] / up
                    q2.append(up)
                    e2.append(e[i] * t)
                    d = d * t - s
                if len(q2) == n - 1 and d >= 0:
                    break
            if e2 == e and s == 0:
                raise ArithmeticError("dqds makes no progress")
            q, e, shift = [*q2, d], e2, shift + s
        out.append(shift + q[0])
    return sorted(out, reverse=True)


class Twisted:
    """B'B less `value` as N D N', twisted where the pivot is least. c: products of neighbours on B's diagonal and superdiagonal."""

    def __init__(self, q: np.ndarray, e: np.ndarray, c: np.ndarray, value: float):
        n, tiny = len(q), EPS * EPS * float(q.max())

        def pivot(x: float) -> float:
            return x if abs(x) > tiny else math.copysign(tiny, x)
        s, p = np.empty(n), np.empty(n)
        self.up, self.down, dp, dm = np.empty(n - 1), np.empty(n - 1), np.empty(n), np.empty(n)
        s[0], p[-1] = -value, q[-1] - value
        for i in range(n - 1):
            dp[i] = pivot(s[i] + q[i])
            self.up[i] = c[i] / dp[i]
            s[i + 1] = self.up[i] * c[i] / q[i] * s[i] - value
        for i in range(n - 2, -1, -1):
            dm[i + 1] = pivot(p[i + 1] + e[i])
            self.down[i] = c[i] / dm[i + 1]
            p[i] = p[i + 1] * (q[i] / dm[i + 1]) - value
        gamma = s + p + value
        self.k = k = int(np.argmin(np.abs(gamma)))
        self.d = np.r_[dp[:k], pivot(gamma[k]), dm[k + 1:]]

    def vector(self) -> np.ndarray:
        """The unit vector that N D N' takes to the least pivot alone."""
        z, k = np.zeros(len(self.d)), self.k
        z[k] = 1
        return self._back(z)

    def _back(self, z: np.ndarray) -> np.ndarray:
        for i in range(self.k - 1, -1, -1):
            z[i] -= self.up[i] * z[i + 1]
        for i in range(self.k, len(z) - 1):
            z[i + 1] -= self.down[i] * z[i]
        return z / np.linalg.norm(z)

    def solve(self, x: np.ndarray) -> np.ndarray:
        """Direction of the solution y of N D N' y = x."""
        w = x.copy()
        for i in range(self.k):
            w[i + 1] -= self.up[i] * w[i]
        for i in range(len(w) - 2, self.k - 1, -1):
            w[i] -= self.down[i] * w[i + 1]
        w /= self.d
        return self._back(w / np.abs(w).max())


def right_vectors(r: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of R'R, falling, and their unit vectors as columns."""
    d = r.shape[1]
    a, b, v = bidiagonal(r)
    scale = max(np.abs(a).max(), np.abs(b).max() if d > 1 else 0.0)
    if scale == 0:
        return np.zeros(min(k, d)), np.eye(d)[:, :k]
    a, b = a / scale, b / scale
    a[np.abs(a) < 1e-30] = 1e-30                              # exact zeros: far below what rounding has left of R
    cut = np.flatnonzero(np.abs(b) <= EPS * np.minimum(np.abs(a[:-1]), np.abs(a[1:]))) + 1
    found = []
    for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), d]):
        q, e, c = a[lo:hi] ** 2, b[lo:hi - 1] ** 2, a[lo:hi - 1] * b[lo:hi - 1]
        values = dqds(q.tolist(), e.tolist())
        group: list[np.ndarray] = []                          # directions of the eigenvalues that share a space
        for i, x in enumerate(values[:k]):
            t = Twisted(q, e, c, x)
            z = t.vector()
            if i and values[i - 1] - x <= max(CLOSE * values[i - 1], (16 * d * EPS) ** 2 * values[0]):       # close to each other, or nothing but rounding
                rng = np.random.default_rng(i)
                z = rng.standard_normal(hi - lo)
                for _ in range(4):
                    for _ in range(2):
                        for g in group:
                            z -= (g @ z) * g
                    z = t.solve(z / np.linalg.norm(z))
                for g in group + group:
                    z -= (g @ z) * g
                z /= np.linalg.norm(z)
            else:
                group = []
            group.append(z)
            found.append((x, v[:, lo:hi] @ z))
    found.sort(key=lambda p: -p[0])
    return np.array([x for x, _ in found[:k]]) * scale * scale, np.stack([z for _, z in found[:k]], 1)


# ------------------------------------------------------------------ on Spark
@dataclass
class Fit:
    """What whitening of one vector length needs. n and sums are exact."""
    n: int
    sums: list[int]
    values: np.ndarray                                        # eigenvalues of the covariance, falling
    vectors: np.ndarray                                       # as columns
    trace: float

    def directions(self) -> np.ndarray:
        """Vectors over the root of their eigenvalues; NaN where there is no variance but for rounding."""
        live = self.values > (16 * len(self.sums) * EPS) ** 2 * max(self.values.max(), np.finfo(float).tiny)
        return np.where(live, self.vectors / np.sqrt(np.where(live, self.values, 1.0)), np.nan)


def scaled(vectors: DataFrame) -> DataFrame:
    """vec_id, dim and x (longs, floor(1024 c) + 100000) of the rows that remain."""
    d = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    d = d.filter(F.coalesce(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) <= float(1 << 43))), F.lit(False)) & (F.size("v") > 0))
    return d.select("vec_id", F.size("v").alias("dim"), F.transform("v", lambda c: F.floor(c * 1024) + 100000).cast("array<long>").alias("x"))


def _by_length(b: pa.RecordBatch):
    """(length, rows, x as a matrix) for each length in the batch, BLOCK rows at most."""
    dims = b.column("dim").to_numpy()
    for dim in np.unique(dims).tolist():
        rows = b.filter(pa.array(dims == dim))
        for lo in range(0, rows.num_rows, BLOCK):
            part = rows.slice(lo, BLOCK)
            yield dim, part, part.column("x").flatten().to_numpy().reshape(-1, dim)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, exact: 64-bit where that holds it, else Python's integers."""
    small = n * int(np.abs(x).max(initial=0)) < 1 << 62
    return x * n - np.array(sums, np.int64) if small else x.astype(object) * n - np.array(sums, object)


def totals(rows: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """Number of rows and sums by dimension, for each length. Tasks hand on their sums; one row for each length and dimension comes to the driver."""
    def run(batches):
        for b in batches:
            for dim, part, x in _by_length(b):
                yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([len(x)], pa.int64()), pa.array([x.sum(0).tolist()], pa.list_(pa.int64()))], ["dim", "n", "s"])
    d = rows.mapInArrow(run, "dim int, n long, s array<long>").select("dim", "n", F.posexplode("s").alias("at", "s"))
    found: dict[int, tuple[int, list[int]]] = {}
    for r in d.groupBy("dim", "at").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("dim", "at").collect():
        found.setdefault(r.dim, (r.n, []))[1].append(int(r.s))
    return found


def triangles(rows: DataFrame, sums: dict[int, tuple[int, list[int]]]) -> dict[int, np.ndarray]:
    """R of the centred rows of each length. One triangle for each length comes to the driver."""
    schema = "dim int, part int, r array<double>"

    def record(dim: int, part: int, r: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([part], pa.int32()), pa.array([r.ravel()], pa.list_(pa.float64()))], ["dim", "part", "r"])

    def run(batches):
        from pyspark import TaskContext
        part, tops = TaskContext.get().partitionId(), {}
        for b in batches:
            for dim, _, x in _by_length(b):
                block = deviations(x, *sums[dim]).astype(float) / sums[dim][0]
                tops[dim] = np.linalg.qr(np.vstack([tops[dim], block]) if dim in tops else block, mode="r")
        for dim, r in tops.items():
            yield record(dim, part, r)

    def merge(key, t):
        dim = key[0].as_py()
        top = np.zeros((0, dim))
        for r in t["r"].chunks:
            for row in r:
                top = np.linalg.qr(np.vstack([top, np.array(row.values.to_numpy()).reshape(-1, dim)]), mode="r")
        return pa.Table.from_batches([record(dim, key[1].as_py(), top)])

    d = cut_lineage(rows.mapInArrow(run, schema))
    while d.groupBy("dim").count().agg(F.max("count")).first()[0] not in (None, 1):
        d = d.withColumn("part", F.floor(F.col("part") / FAN).cast("int"))
        d = cut_lineage(d.groupBy("dim", "part").applyInArrow(merge, schema))
    return {r.dim: np.array(r.r).reshape(-1, r.dim) for r in d.collect()}


def fit(rows: DataFrame, components: int = 8) -> dict[int, Fit]:
    """A fit for each vector length of `rows` (vec_id, dim, x)."""
    sums, out = totals(rows), {}
    for dim, r in triangles(rows, sums).items():
        n = sums[dim][0]
        r = np.vstack([r, np.zeros((max(0, dim - len(r)), dim))])                 # fewer rows than dimensions
        values, vectors = right_vectors(r, components)
        out[dim] = Fit(n, sums[dim][1], values / n, vectors, float((r * r).sum()) / n)
    return out


def apply(rows: DataFrame, fits: dict[int, Fit]) -> DataFrame:
    """vec_id, dim, n, deviation and w (whitened values by component) of each row."""
    def run(batches):
        names = ["vec_id", "dim", "n", "deviation", "w"]
        for b in batches:
            for dim, part, x in _by_length(b):
                f = fits[dim]
                y = deviations(x, f.n, f.sums)
                most = int(np.abs(y).max(initial=0))
                y2 = (y * y).sum(1) if most * most * dim < 1 << 63 else np.array([v if v < 1 << 63 else None for v in (y.astype(object) ** 2).sum(1)], object)
                w = (y.astype(float) / f.n) @ f.directions()
                values = pa.array(w.ravel(), pa.float64(), mask=np.isnan(w.ravel()))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32()), values)
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("dim"), pa.array(np.full(len(w), f.n)), pa.array(y2, pa.int64()), lists], names)
    return rows.mapInArrow(run, "vec_id long, dim int, n long, deviation long, w array<double>")


def identity_errors(white: DataFrame, components: int) -> DataFrame:
    """dim and the largest entry of |covariance of w - identity|; products are of values less their mean."""
    means = white.groupBy("dim").agg(*[F.avg(F.get("w", F.lit(i))).alias(f"m{i}") for i in range(components)])
    d = white.join(F.broadcast(means), "dim")                                     # one row for each length
    c = [F.get("w", F.lit(i)) - F.col(f"m{i}") for i in range(components)]
    worst = [F.abs(F.avg(c[i] * c[j]) - float(i == j)) for i in range(components) for j in range(i + 1)]
    return d.groupBy("dim").agg((F.greatest(*worst) if len(worst) > 1 else worst[0]).alias("identity_error"))


def whiten(vectors: DataFrame, components: int = 8) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error for each row of `vectors` (vec_id, embedding) and component."""
    spark, rows = vectors.sparkSession, cut_lineage(scaled(vectors))
    fits = fit(rows, components)
    white = cut_lineage(apply(rows, fits))
    shares = [(dim, i + 1, float(e / f.trace) if f.trace > 0 else None) for dim, f in fits.items() for i, e in enumerate(f.values.tolist())]
    known = spark.createDataFrame(shares, "dim int, component int, explained double").join(identity_errors(white, components), "dim", "left")
    d = white.select("vec_id", "dim", "n", "deviation", F.posexplode("w").alias("at", "whitened")).withColumn("component", (F.col("at") + 1).cast("int"))
    return d.join(known, ["dim", "component"]).select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")
