"""Grouped least squares from moment sums: Spark adds up the Gram matrix map-side, a tiny solve per key follows.

The Gram row of a key has (p+1)^2 numbers whatever the number of rows, so keys of any size and excluded sets
(total minus part) cost one aggregate."""
from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType


#: Cross products up to which plain sums are the better plan; their number grows with the square of the features.
FEW_PRODUCTS = 66
#: Partial matrices that a task holds before it hands them on.
HELD = 64


def gram(df: DataFrame, keys: list[str], features: list[str], y: str) -> DataFrame:
    """keys, n, g: upper triangle of the cross products of (1, features, y), row by row. Rows with a NULL in a feature or y are left out."""
    ok = df.where(" AND ".join(f"`{c}` IS NOT NULL" for c in [*features, y]))
    k = len(features) + 2
    if k * (k + 1) // 2 > FEW_PRODUCTS:
        return _gram_by_partition(ok, keys, features, y)
    cols = [F.lit(1.0)] + [F.col(c).cast("double") for c in features] + [F.col(y).cast("double")]
    prods = [(i, j) for i in range(k) for j in range(i, k)]
    a = ok.groupBy(*keys).agg(*[F.sum(cols[i] * cols[j]).alias(f"_g{i}_{j}") for i, j in prods])
    return a.select(*keys, F.col("_g0_0").cast("bigint").alias("n"), F.array(*[F.col(f"_g{i}_{j}") for i, j in prods]).alias("g"))


def _gram_by_partition(ok: DataFrame, keys: list[str], features: list[str], y: str) -> DataFrame:
    """Each task multiplies its rows key by key; the partial triangles, one row each, are added up by position with map-side combining."""
    ids = ok.select(*keys).schema
    k, width = len(features) + 2, len(keys)
    upper = np.triu_indices(k)

    def partial(batches):
        held: dict[tuple, np.ndarray] = {}

        def hand_on():
            cols = [pa.array([t[i] for t in held], from_arrow[i]) for i in range(width)]
            g = pa.array([m[upper] for m in held.values()], pa.list_(pa.float64()))
            held.clear()
            return pa.RecordBatch.from_arrays([*cols, g], [*keys, "g"])

        from_arrow: list = []
        for b in batches:
            from_arrow = [b.schema.field(i).type for i in range(width)]
            x = np.column_stack([np.ones(b.num_rows), *[b.column(width + i).to_numpy(zero_copy_only=False) for i in range(k - 1)]])
            which = pd.DataFrame({str(i): b.column(i).to_pylist() for i in range(width)}).groupby([str(i) for i in range(width)], dropna=False, sort=False).indices if width else {(): np.arange(b.num_rows)}
            for rows in which.values():
                t = tuple(b.column(i)[int(rows[0])].as_py() for i in range(width))
                held[t] = held.get(t, 0) + x[rows].T @ x[rows]
                if len(held) >= HELD:
                    yield hand_on()
        if held:
            yield hand_on()

    doubles = [F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate([*features, y])]
    fields = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in ids], "g array<double>"])
    parts = ok.select(*keys, *doubles).mapInArrow(partial, fields)
    sums = parts.select(*keys, F.posexplode("g").alias("_at", "_v")).groupBy(*keys, "_at").agg(F.sum("_v").alias("_v"))
    g = sums.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_v"))), lambda s: s["_v"]).alias("g"))
    return g.select(*keys, F.col("g")[0].cast("bigint").alias("n"), "g")


def unpack(g) -> np.ndarray:
    """Upper triangle to the full symmetric matrix."""
    g = np.asarray(g, float)
    k = int((np.sqrt(8 * len(g) + 1) - 1) / 2)
    m = np.zeros((k, k))
    m[np.triu_indices(k)] = g
    return m + np.triu(m, 1).T


def ridge_of(g, alpha: float, intercept: bool = True) -> np.ndarray:
    """Coefficients (intercept first) of ridge on standardised features (population sd); alpha 0 is OLS."""
    m = unpack(g)
    if m[0, 0] == 0:
        return np.full(len(m) - 1, np.nan)
    if not intercept:
        a = m[1:-1, 1:-1] + alpha * np.eye(len(m) - 2)
        return np.r_[0.0, np.linalg.lstsq(a, m[1:-1, -1], rcond=None)[0]]
    n = m[0, 0]
    mu, ybar = m[0, 1:-1] / n, m[0, -1] / n
    c, cy = m[1:-1, 1:-1] - n * np.outer(mu, mu), m[1:-1, -1] - n * mu * ybar
    sd = np.sqrt(np.maximum(np.diag(c) / n, 0))
    live = sd > 1e-12
    w = np.zeros(len(mu))
    if live.any():
        z = c[np.ix_(live, live)] / np.outer(sd[live], sd[live])
        w[live] = np.linalg.lstsq(z + alpha * np.eye(live.sum()), cy[live] / sd[live], rcond=None)[0] / sd[live]
    return np.r_[ybar - mu @ w, w]


def pls_of(g, k: int) -> np.ndarray:
    """One-response partial least squares on standardised features from the Gram matrix alone."""
    m = unpack(g)
    n = m[0, 0]
    mu, ybar = m[0, 1:-1] / n, m[0, -1] / n
    c, cy = m[1:-1, 1:-1] - n * np.outer(mu, mu), m[1:-1, -1] - n * mu * ybar
    sd = np.sqrt(np.maximum(np.diag(c) / n, 0))
    sd = np.where(sd > 1e-12, sd, 1.0)
    z, zy = c / np.outer(sd, sd), cy / sd
    # the PLS1 solution lies in the Krylov space of (Z'Z, Z'y)
    basis, v = [], zy
    for _ in range(min(k, len(zy))):
        for b in basis:
            v = v - (b @ v) * b
        norm = np.linalg.norm(v)
        if norm < 1e-10 * max(1.0, np.linalg.norm(zy)):
            break
        basis.append(v / norm)
        v = z @ basis[-1]
    K = np.array(basis).T
    w = K @ np.linalg.solve(K.T @ z @ K, K.T @ zy) / sd if len(basis) else np.zeros(len(mu))
    return np.r_[ybar - mu @ w, w]


def elastic_of(g, alpha: float, l1_ratio: float, tol: float = 1e-10) -> np.ndarray:
    """Lasso / elastic net (1/2n squared error + alpha l1_ratio |w| + alpha (1 - l1_ratio) w^2 / 2) on standardised features, by
    coordinate descent on the Gram matrix, until no coefficient moves by more than `tol` of the largest or the objective stops falling."""
    m = unpack(g)
    n = m[0, 0]
    mu, ybar = m[0, 1:-1] / n, m[0, -1] / n
    c, cy = m[1:-1, 1:-1] / n - np.outer(mu, mu), m[1:-1, -1] / n - mu * ybar
    sd = np.sqrt(np.maximum(np.diag(c), 0))
    live = np.flatnonzero(sd > 1e-12)
    w = np.zeros(len(mu))
    if len(live):
        z, r = c[np.ix_(live, live)] / np.outer(sd[live], sd[live]), cy[live] / sd[live]
        v = np.zeros(len(live))
        loss = np.inf
        while True:
            step = 0.0
            for j in range(len(live)):
                rho = r[j] - z[j] @ v + z[j, j] * v[j]
                new = np.sign(rho) * max(abs(rho) - alpha * l1_ratio, 0.0) / (z[j, j] + alpha * (1 - l1_ratio))
                step, v[j] = max(step, abs(new - v[j])), new
            now = v @ z @ v / 2 - r @ v + alpha * (l1_ratio * np.abs(v).sum() + (1 - l1_ratio) * v @ v / 2)
            if step <= tol * max(1.0, np.abs(v).max()) or now >= loss:
                break
            loss = now
        w[live] = v / sd[live]
    return np.r_[ybar - mu @ w, w]


def solve_linear(g, kind: str, **opt) -> np.ndarray:
    """Coefficients of a linear model by name from its Gram row."""
    if kind == "linear":
        return ridge_of(g, 0.0)
    if kind == "ridge":
        return ridge_of(g, opt["alpha"])
    if kind in ("lasso", "elasticnet"):
        return elastic_of(g, opt["alpha"], 1.0 if kind == "lasso" else opt["l1_ratio"])
    return pls_of(g, opt["k"])


def sub_gram(g, keep: list[int]) -> list[float]:
    """Gram row of a subset of the features (0-based)."""
    m = unpack(g)
    ix = [0, *[k + 1 for k in keep], len(m) - 1]
    s = m[np.ix_(ix, ix)]
    return s[np.triu_indices(len(s))].tolist()


def held_out_mse(coef: np.ndarray, g) -> float:
    """Mean squared error of a coefficient vector on the rows behind a Gram row."""
    m = unpack(g)
    v = np.r_[coef, -1.0]
    return float(v @ m @ v / m[0, 0])


def nnls_of(g) -> np.ndarray:
    """Non-negative weights without intercept: best of the active sets of up to a few columns."""
    m = unpack(g)
    a, b, yy = m[1:-1, 1:-1], m[1:-1, -1], m[-1, -1]
    p, best, w_best = len(b), yy, np.zeros(len(b))
    for mask in range(1, 2 ** p):
        s = [i for i in range(p) if mask >> i & 1]
        w = np.linalg.lstsq(a[np.ix_(s, s)], b[s], rcond=None)[0]
        if (w >= -1e-12).all():
            sse = yy - 2 * w @ b[s] + w @ a[np.ix_(s, s)] @ w
            if sse < best - 1e-12 * max(1.0, yy):
                best, w_best = sse, np.zeros(p)
                w_best[s] = np.maximum(w, 0)
    return w_best


def solver(kind: str, **opt):
    """Arrow-batched column function: Gram array -> coefficient array."""
    fn = {"ols": lambda g: ridge_of(g, 0.0), "origin": lambda g: ridge_of(g, 0.0, False), "ridge": lambda g: ridge_of(g, opt["alpha"]),
          "pls": lambda g: pls_of(g, opt["k"]), "nnls": nnls_of,
          "lasso": lambda g: elastic_of(g, opt["alpha"], 1.0), "elasticnet": lambda g: elastic_of(g, opt["alpha"], opt["l1_ratio"])}[kind]

    @F.pandas_udf(ArrayType(DoubleType()))
    def solve(g: pd.Series) -> pd.Series:
        return g.map(lambda x: fn(x).tolist())
    return solve


def fit_linear(df: DataFrame, keys: list[str], features: list[str], y: str, kind: str = "ols", **opt) -> DataFrame:
    """keys, n, coef (intercept first; without it for nnls)."""
    return gram(df, keys, features, y).select(*keys, "n", solver(kind, **opt)("g").alias("coef"))


def apply_linear(df: DataFrame, fits: DataFrame, keys: list[str], features: list[str], out: str = "pred", clip: bool = False, intercept: bool = True) -> DataFrame:
    """Prediction of each row by its key's coefficients; NULL where a feature is. Without keys `fits` is the one row of a global fit and goes to every task."""
    x = F.col("coef")[0] if intercept else F.lit(0.0)
    for i, c in enumerate(features):
        x = x + F.col("coef")[i + int(intercept)] * F.col(c)
    d = df.join(fits.select(*keys, "coef"), keys, "left") if keys else df.crossJoin(F.broadcast(fits.select("coef")))
    return d.withColumn(out, F.greatest(F.lit(0.0), x) if clip else x).drop("coef")


def two_feature_slopes(x1: Column, x2: Column, y: Column) -> tuple[Column, Column, Column]:
    """Aggregates (b0, b1, b2) of y on two features, from second moments."""
    s11, s22, s12 = F.covar_pop(x1, x1), F.covar_pop(x2, x2), F.covar_pop(x1, x2)
    s1y, s2y = F.covar_pop(x1, y), F.covar_pop(x2, y)
    det = F.nullif(s11 * s22 - s12 * s12, F.lit(0.0))
    b1, b2 = (s1y * s22 - s2y * s12) / det, (s2y * s11 - s1y * s12) / det
    return F.avg(y) - b1 * F.avg(x1) - b2 * F.avg(x2), b1, b2


def ols_interval(train: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """One-feature OLS with what a prediction interval needs: b0, b1, n, x_mean, sxx, s2."""
    t = train.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    g = t.groupBy(*keys).agg(F.count("*").alias("n_fit"), F.regr_slope(y, x).alias("b1"), F.regr_intercept(y, x).alias("b0"), F.avg(x).alias("x_mean"),
                             F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("_syy"), F.regr_sxy(y, x).alias("_sxy"))
    return g.withColumn("s2", (F.col("_syy") - F.col("b1") * F.col("_sxy")) / F.nullif(F.col("n_fit") - 2, F.lit(0))).drop("_syy", "_sxy")


def with_interval(df: DataFrame, fit: DataFrame, keys: list[str], x: str, t_value: float) -> DataFrame:
    d = df.join(fit, keys, "left")
    half = t_value * F.sqrt(F.col("s2") * (1 + 1 / F.col("n_fit") + (F.col(x) - F.col("x_mean")) * (F.col(x) - F.col("x_mean")) / F.col("sxx")))
    p = F.col("b0") + F.col("b1") * F.col(x)
    return d.withColumn("pred", p).withColumn("lo", p - half).withColumn("hi", p + half)
