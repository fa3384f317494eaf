"""Near copies among embeddings by a pivot-permutation index.

A bounded sample of vectors (PIVOTS at most, by hash order) are the reference points. Every vector is described by its PREFIX nearest
ones in order, and stands in the inverted list of each. Within a list, two vectors are candidates if they share SHARED reference points or
more; candidates are verified by cosine in double precision. A pair is counted in the list of its first shared reference point only.
Lists longer than BLOCK are cut to blocks, and each pair of blocks is a row group of its own, so no list is too long for a task.

Vectors link only if their labels are equal and not null and their lengths are equal. Vectors that are null, zero or hold null or non-finite
components link with nothing, as do rows with a null vec_id (these have no component and are not kept). Equal vectors of a label are one
class with a multiplicity: they link with each other and share all other links. Other columns are ignored; an empty table gives no rows."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wattloom.session import cut_lineage

from .components import Forest, components

PIVOTS, PREFIX, SHARED, BLOCK = 192, 12, 2, 1024


def _pivots(classes: DataFrame, most: int) -> dict[int, np.ndarray]:
    """Reference points by vector length, normed. At most `most` rows come to the driver for each of the few lengths."""
    out = {}
    for (dim,) in classes.select("dim").distinct().collect():
        v = np.array([r[0] for r in classes.filter(F.col("dim") == dim).orderBy(F.xxhash64("c", F.lit("pivot"))).limit(most).select("v").collect()])
        out[dim] = v / np.linalg.norm(v, axis=1, keepdims=True)
    return out


def nearest(v: np.ndarray, pivots: np.ndarray, k: int) -> np.ndarray:
    """Numbers of the k nearest reference points of each vector, nearest first; equals by number."""
    sim = v @ pivots.T
    return np.argsort(-sim, axis=1, kind="stable")[:, :k]


def _describe(classes: DataFrame, pivots: dict[int, np.ndarray], k: int) -> DataFrame:
    """A row for each class and list it stands in, with its permutation prefix."""
    sent = classes.sparkSession.sparkContext.broadcast(pivots)

    def run(batches):
        for b in batches:
            dims = b.column("dim").to_numpy()
            for dim in np.unique(dims):
                rows = b.filter(pa.array(dims == dim))
                v = np.array(rows.column("v").flatten().to_numpy(zero_copy_only=False)).reshape(-1, dim)
                p = nearest(v / np.linalg.norm(v, axis=1, keepdims=True), sent.value[int(dim)], k)
                w = p.shape[1]
                again = rows.take(pa.array(np.repeat(np.arange(len(v)), w)))
                prefix = pa.ListArray.from_arrays(pa.array(np.arange(len(v) * w + 1) * w, pa.int32()), pa.array(np.repeat(p, w, axis=0).ravel().astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*again.columns, pa.array(p.ravel().astype(np.int32)), prefix], [*again.schema.names, "pivot", "prefix"])
    return classes.mapInArrow(run, "label string, dim int, c long, n long, v array<double>, pivot int, prefix array<int>")


def _blocks(lists: DataFrame) -> DataFrame:
    """Adds the pair of blocks (i <= j) that a row takes part in, once for each, and the side it stands on."""
    size = lists.groupBy("label", "dim", "pivot").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"))
    d = lists.join(size, ["label", "dim", "pivot"])
    d = d.withColumn("own", F.pmod(F.xxhash64("c", F.lit("block")), F.col("blocks")).cast("int"))
    d = d.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return d.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("other", "blocks")


def linked_pairs(v: np.ndarray, prefix: np.ndarray, pivot: int, left: np.ndarray, right: np.ndarray, least: float, shared: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (left row, right row) of one list that share enough reference points, of which `pivot` is the first, and whose cosine is `least` or more."""
    top = int(prefix.max()) + 1
    has = np.zeros((len(v), top), np.float32)
    np.put_along_axis(has, prefix, 1.0, 1)
    norm = np.sqrt((v * v).sum(1))
    good = has[left] @ has[right].T >= shared
    good &= has[left, :pivot] @ has[right, :pivot].T == 0
    a, b = np.nonzero(good)
    keep = left[a] != right[b]
    a, b = left[a[keep]], right[b[keep]]
    cos = np.concatenate([(v[a[s:s + 65536]] * v[b[s:s + 65536]]).sum(1) / (norm[a[s:s + 65536]] * norm[b[s:s + 65536]]) for s in range(0, len(a), 65536)]) if len(a) else np.zeros(0)
    return a[cos >= least], b[cos >= least]


def link(classes: DataFrame, least: float, pivots: int = PIVOTS, k: int = PREFIX, shared: int = SHARED) -> DataFrame:
    """c, links (vectors of other classes linked directly) and root (a linked class) of the classes in each pair of blocks."""
    def run(key, t):
        t = t.sort_by("c")
        c, n, own = (t[x].to_numpy() for x in ("c", "n", "own"))
        i, j, pivot = key[3].as_py(), key[4].as_py(), key[2].as_py()
        v = t["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(c), -1)
        prefix = t["prefix"].combine_chunks().flatten().to_numpy().reshape(len(c), -1)
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        a, b = linked_pairs(v, prefix, pivot, left, right, least, shared) if len(left) and len(right) else (left[:0], right[:0])
        links = np.bincount(a, n[b], len(c)) + (np.bincount(b, n[a], len(c)) if i != j else 0)
        forest = Forest(len(c))
        for x, y in zip(a.tolist(), b.tolist()):
            forest.join(x, y)
        root = np.array([forest.root(x) for x in range(len(c))], np.int64)
        hit = np.flatnonzero(links)
        return pa.table({"c": pa.array(c[hit], pa.int64()), "links": pa.array(links[hit].astype(np.int64)), "root": pa.array(c[root[hit]], pa.int64())})

    lists = cut_lineage(_describe(classes, _pivots(classes, pivots), k))
    return _blocks(lists).groupBy("label", "dim", "pivot", "i", "j").applyInArrow(run, "c long, links long, root long")


def near_copies(vectors: DataFrame, least: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row of `vectors` (vec_id, embedding, label)."""
    d = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    fit = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite, F.lit(False))
    d = d.withColumn("h1", F.when(fit, F.xxhash64("v"))).withColumn("h2", F.when(fit, F.xxhash64(F.lit("second"), "v")))
    group = ["label", "h1", "h2"]
    classes = cut_lineage(d.filter(fit).groupBy(*group).agg(F.min("vec_id").alias("c"), F.count("*").alias("n"), F.min_by("v", "vec_id").alias("v")).withColumn("dim", F.size("v")))
    found = cut_lineage(link(classes.select("label", "dim", "c", "n", "v"), least))
    whole = components(found.select(F.col("c").alias("a"), F.col("root").alias("b")))
    sums = found.groupBy("c").agg(F.sum("links").alias("links"))
    info = (classes.select(*group, "c", "n").join(sums, "c", "left").join(whole.withColumnRenamed("id", "c"), "c", "left")
            .select(*group, (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "c").alias("component_id")))
    out = d.select("vec_id", *group).join(info, group, "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")) \
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
