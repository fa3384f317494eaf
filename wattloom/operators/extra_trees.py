"""Extremely randomised regression trees, grown a level at a time over all trees at once.

A node draws one threshold for each of its features, uniform between the feature's least and highest value in the node, and takes the split with the least squared
error. A level is two passes over the rows, which stay where they are: ranges by (tree, node, feature), then sums left of the thresholds; both combine in the
tasks, and what reaches the driver is bounded by trees x nodes of a level x features. Draws are md5 hashes of (seed, tree, node, feature), so a forest can be replayed
anywhere. Trees see all rows (no bootstrap). Rows without a target are left out of the fit; a missing feature value goes right."""
from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.hashing import digest, hash_unit


@dataclass
class Forest:
    """Nodes by tree and place (root 1, children 2k and 2k + 1): split feature (-1: leaf), threshold, mean target and rows."""
    features: list[str]
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    rows: np.ndarray

    def route(self, x: np.ndarray) -> np.ndarray:
        """Place of the node that each row has reached in each tree."""
        t, node = np.arange(len(self.feature)), np.ones((len(x), len(self.feature)), np.int64)
        while True:
            f = self.feature[t, node]
            inner = f >= 0
            if not inner.any():
                return node
            right = ~(x[np.arange(len(x))[:, None], f] <= self.threshold[t, node])
            node = np.where(inner, 2 * node + right, node)

    def table(self) -> list[tuple]:
        """(tree, node, feature, threshold, value, rows) of every node, to be stored."""
        return [(int(t), int(k), self.features[f] if (f := self.feature[t, k]) >= 0 else None, float(self.threshold[t, k]) if f >= 0 else None, float(self.value[t, k]), int(self.rows[t, k]))
                for t, k in np.argwhere(self.rows > 0)]


def _matrix(b: pa.RecordBatch, features: list[str]) -> np.ndarray:
    return np.stack([b.column(f).to_numpy(zero_copy_only=False).astype(float) for f in features], 1) if b.num_rows else np.zeros((0, len(features)))


def _pass(rows: DataFrame, forest: Forest, y: str, live: set[tuple[int, int]], measure: Callable, names: list[str]) -> DataFrame:
    """(tree, node, feature, *names) of each batch: measure(x, target, order of rows by node, starts of nodes, tree, nodes) gives arrays of nodes x features."""
    features, wanted = forest.features, np.zeros(forest.feature.shape, bool)
    wanted[tuple(np.array(sorted(live)).T)] = True

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            x, target = _matrix(b, features), b.column(y).to_numpy(zero_copy_only=False).astype(float)
            if not len(x):
                continue
            at = forest.route(x)
            for t in range(at.shape[1]):
                keep = np.flatnonzero(wanted[t, at[:, t]])
                if not len(keep):
                    continue
                order = keep[np.argsort(at[keep, t], kind="stable")]
                nodes, starts = np.unique(at[order, t], return_index=True)
                out = measure(x[order], target[order], starts, t, nodes)
                shape = (len(nodes), len(features))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(shape, t).ravel(), pa.int32()), pa.array(np.repeat(nodes, shape[1]), pa.int64()), pa.array(np.tile(np.arange(shape[1]), shape[0]), pa.int32()),
                                                  *[pa.array(np.broadcast_to(a, shape).ravel().astype(float), pa.float64()) for a in out]], ["tree", "node", "feature", *names])
    return rows.select(*features, y).mapInArrow(run, "tree int, node long, feature int, " + ", ".join(f"{n} double" for n in names))


def fit(df: DataFrame, features: list[str], y: str = "y", trees: int = 100, depth: int = 6, min_leaf: int = 1, max_features: float = 1.0, seed: int = 0) -> Forest:
    """`df` should be a written table: it is read twice for each level. `max_features`: share of a node's varying features that is tried."""
    rows = df.where(F.col(y).isNotNull()).select(*[F.col(f).cast("double").alias(f) for f in features], F.col(y).cast("double").alias(y))
    size = 2 << depth
    forest = Forest(features, np.full((trees, size), -1), np.zeros((trees, size)), np.zeros((trees, size)), np.zeros((trees, size), np.int64))
    n, s = rows.agg(F.count("*"), F.sum(y)).first()
    if not n:
        return forest
    forest.rows[:, 1], forest.value[:, 1] = n, s / n
    live, tried = {(t, 1) for t in range(trees)}, max(1, int(max_features * len(features)))

    def ranges(x, target, starts, t, nodes):
        lo, hi = np.fmin.reduceat(x, starts), np.fmax.reduceat(x, starts)
        return np.where(np.isnan(lo), np.inf, lo), np.where(np.isnan(hi), -np.inf, hi)

    for level in range(depth):
        live = {(t, k) for t, k in live if forest.rows[t, k] >= 2 * min_leaf}
        if not live:
            break
        r = _pass(rows, forest, y, live, ranges, ["lo", "hi"]).groupBy("tree", "node", "feature").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo < hi")
        order = W.partitionBy("tree", "node").orderBy(digest(F.lit(seed), F.col("tree"), F.col("node"), F.col("feature"), F.lit("pick")))
        u = hash_unit(F.lit(seed), F.col("tree"), F.col("node"), F.col("feature"))
        drawn = r.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= tried).select("tree", "node", "feature", (F.col("lo") + u * (F.col("hi") - F.col("lo"))).alias("threshold")).collect()
        at = np.full((trees, 1 << level, len(features)), -np.inf)                 # nothing is left of it: no split
        for d in drawn:
            at[d.tree, d.node - (1 << level), d.feature] = d.threshold
        live = {(d.tree, d.node) for d in drawn}

        def left(x, target, starts, t, nodes, at=at, level=level):
            where = np.repeat(np.arange(len(nodes)), np.diff(np.r_[starts, len(x)]))
            under = x <= at[t, nodes - (1 << level)][where]
            return np.add.reduceat(under.astype(float), starts), np.add.reduceat(under * target[:, None], starts)
        sums = {}
        for d in _pass(rows, forest, y, live, left, ["n", "s"]).groupBy("tree", "node", "feature").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect() if live else []:
            n, s = forest.rows[d.tree, d.node], forest.value[d.tree, d.node] * forest.rows[d.tree, d.node]
            if min(d.n, n - d.n) < min_leaf or d.n in (0, n):
                continue
            score = d.s ** 2 / d.n + (s - d.s) ** 2 / (n - d.n)
            best = sums.get((d.tree, d.node))
            if score > s * s / n * (1 + 1e-12) and (best is None or (-score, d.feature) < best[:2]):
                sums[d.tree, d.node] = (-score, d.feature, d.n, d.s, n - d.n, s - d.s)
        live = set()
        for (t, k), (_, f, nl, sl, nr, sr) in sums.items():
            forest.feature[t, k], forest.threshold[t, k] = f, at[t, k - (1 << level), f]
            for child, c, v in ((2 * k, nl, sl), (2 * k + 1, nr, sr)):
                forest.rows[t, child], forest.value[t, child] = c, v / c
                live.add((t, child))
    return forest


def predict(df: DataFrame, forest: Forest, out: str = "prediction") -> DataFrame:
    """Adds the mean over the trees of the reached nodes' means."""
    d = df.drop(out)

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            node = forest.route(_matrix(b, forest.features))
            p = forest.value[np.arange(node.shape[1]), node].mean(1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p, pa.float64())], [*b.schema.names, out])
    return d.mapInArrow(run, d.withColumn(out, F.lit(None).cast("double")).schema)
