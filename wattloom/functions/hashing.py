"""Seeded, portable randomness: md5 of readable keys, so every draw can be replayed in any SQL engine."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

def digest(*parts) -> Column:
    """md5 of the parts joined by '|'."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.md5(F.concat_ws("|", *[c.cast("string") for c in cols]))


def hash_int(*parts) -> Column:
    """First 32 bits of the digest as BIGINT."""
    return F.conv(F.substring(digest(*parts), 1, 8), 16, 10).cast("bigint")


def hash_unit(*parts) -> Column:
    """Uniform draw in [0, 1)."""
    return hash_int(*parts) / F.lit(4294967296.0)


def hash_rank(df: DataFrame, group: list[str], key: Column, rank: str = "pos", size: str = "pool_size") -> DataFrame:
    """0-based rank of every row in md5 order within its group, and the group size.

    The first two hex digits are a bucket that is monotone in the order: rows are ranked inside
    (group, bucket) and shifted by the bucket's prefix count, so a single huge group is spread
    over 256 tasks. Equal to row_number() over the whole group."""
    d = df.withColumn("_h", key).withColumn("_b", F.substring("_h", 1, 2))
    w = W.partitionBy(*group).orderBy("_b")
    offs = (d.groupBy(*group, "_b").agg(F.count("*").alias("_n"))
            .select(*group, "_b", (F.sum("_n").over(w) - F.col("_n")).alias("_off"),
                    F.sum("_n").over(W.partitionBy(*group)).alias(size)))
    inner = W.partitionBy(*group, "_b").orderBy("_h")
    return (d.withColumn("_r", F.row_number().over(inner) - 1)
            .join(offs, group + ["_b"])
            .withColumn(rank, (F.col("_r") + F.col("_off")).cast("bigint"))
            .withColumn(size, F.col(size).cast("bigint"))
            .drop("_h", "_b", "_r", "_off"))


def draw_positions(cells: DataFrame, n: Column, pool: Column, key: Column, out: str = "pos", turn: str | None = None) -> DataFrame:
    """One row per drawn position: `n` distinct positions of 0..pool-1 per cell, every subset alike; `key` is unique per cell. `turn`: column for the order of the draws.

    Positions are drawn independently and repeats are passed over, which is a draw without replacement. 3n + 32 tries nearly
    always hold n distinct ones; a walk of 2n places (the whole pool, if that is less) from a hashed start stands behind them and completes the
    draw in any case. The work follows the size of the result, not cells x candidates, and a cell's rows are few enough for one window."""
    n, tries = n.cast("bigint"), n.cast("bigint") * 3 + 32
    d = cells.withColumn("_key", key).withColumn("_n", n).withColumn("_tries", tries).withColumn("_pool", pool.cast("bigint"))
    d = d.withColumn("_j", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_tries") + F.least(F.col("_pool"), F.col("_n") * 2))))
    d = d.withColumn(out, F.when(F.col("_j") <= F.col("_tries"), hash_int(F.col("_key"), F.lit("try"), F.col("_j")))
                     .otherwise(hash_int(F.col("_key"), F.lit("start")) + F.col("_j")) % F.col("_pool"))
    first = d.groupBy(*cells.columns, "_key", "_n", out).agg(F.min("_j").alias("_j"))
    ranked = first.withColumn("_turn", F.row_number().over(W.partitionBy("_key").orderBy("_j"))).where(F.col("_turn") <= F.col("_n"))
    ranked = ranked.withColumn(turn, F.col("_turn")) if turn else ranked
    return ranked.drop("_key", "_n", "_j", "_turn")
