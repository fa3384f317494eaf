"""Connected components by alternating star contractions, each a grouped minimum and a join; every round is written to the shared folder."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wattloom.session import cut_lineage


def _star(edges: DataFrame, both: bool) -> DataFrame:
    """Large star (both directions; moves larger neighbours) or small star (smaller neighbours and the node itself) onto the least neighbour.

    `edges` runs from larger `a` to smaller `b`. The least neighbour comes from a partial aggregate, the join may be split where a node is hot."""
    if both:
        near = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        moved = near.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        moved = edges.join(least, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.withColumnRenamed("m", "b"))
    return moved.filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """id and component (the least id reachable) of every node of the edges (a, b), in any order and with repeats."""
    cur = cut_lineage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    mark = lambda d: d.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    seen = mark(cur)
    while seen[0]:
        cur = cut_lineage(_star(_star(cur, True), False))
        now = mark(cur)
        if now == seen:
            break
        seen = now
    return cur.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(cur.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())


class Forest:
    """Union-find over row numbers of one task; the root is the least number."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)
        return i != j
