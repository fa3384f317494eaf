"""Sharding by a hierarchical weighted hash tree.

A tree is {region: {rack: {shard: weight}}}. A row descends it: at each level the child with the least -ln(u) / weight wins, where u is
a hash of the key and the child's path and the weight is the sum below the child. A child is drawn with the probability of its
weight, and a change of weights moves rows only into or out of the subtrees whose weight changes; a new region therefore takes
rows only into itself. The key is all that decides, so rows with one doc_id (a null one included) share a shard."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Racks of a region and shards of a rack in a regular tree.
RACKS, SHARDS = 3, 4
#: Rows that are numbered together.
SLOT_ROWS = 20_000


def regular_tree(n: int) -> dict:
    """n shards of weight 1 in whole regions of RACKS x SHARDS; what is over makes a region of its own."""
    tree: dict = {}
    for s in range(n):
        region, at = divmod(s, RACKS * SHARDS)
        tree.setdefault(region, {}).setdefault(at // SHARDS, {})[s] = 1.0
    return tree


def _weight(node: dict | float) -> float:
    return sum(map(_weight, node.values())) if isinstance(node, dict) else float(node)


def _draw(key: Column, path: tuple, children: dict) -> Column:
    """The winning child of one node."""
    def entry(c) -> Column:
        h = F.xxhash64(key, F.lit("/".join(map(str, (*path, c)))))
        u = (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / float(1 << 53)
        return F.struct((-F.ln(u) / F.lit(_weight(children[c]))).alias("draw"), F.lit(int(c)).alias("child"))
    live = [c for c in sorted(children) if _weight(children[c]) > 0]
    return entry(live[0])["child"] if len(live) == 1 else F.array_min(F.array(*map(entry, live)))["child"]


def place(df: DataFrame, tree: dict, key: Column, out: str) -> DataFrame:
    """The row's shard as column `out`."""
    k = F.coalesce(key.cast("string"), F.lit("null"))
    df = df.withColumn("_region", _draw(k, (), tree))
    rack = shard = F.lit(None).cast("int")
    for r, racks in tree.items():
        rack = F.when(F.col("_region") == r, _draw(k, (r,), racks)).otherwise(rack)
    df = df.withColumn("_rack", rack)
    for r, racks in tree.items():
        for q, shards in racks.items():
            shard = F.when((F.col("_region") == r) & (F.col("_rack") == q), _draw(k, (r, q), shards)).otherwise(shard)
    return df.withColumn(out, shard.cast("int")).drop("_region", "_rack")


def number_slots(df: DataFrame, shard: str, rows: int) -> DataFrame:
    """Adds `slot`, gapless from 0 within each shard. Rows are numbered in hash buckets of about SLOT_ROWS and shifted by the rows of the buckets before."""
    n = max(4, -(-rows // SLOT_ROWS))
    d = df.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "size", "text_crc32", F.lit("slot")), F.lit(n)))
    before = W.partitionBy(shard).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    shift = d.groupBy(shard, "_bucket").agg(F.count("*").alias("_n")).select(shard, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    inner = W.partitionBy(shard, "_bucket").orderBy("doc_id", "size", "text_crc32")
    return (d.withColumn("_at", F.row_number().over(inner) - 1).join(shift, [shard, "_bucket"])
            .withColumn("slot", (F.col("_at") + F.col("_shift")).cast("long")).drop("_bucket", "_at", "_shift"))


def shard_documents(docs: DataFrame, tree: dict, grown: dict) -> DataFrame:
    """doc_id, size (bytes of the text plus 8), crc32 of the text, shard in `tree`, slot in the shard and shard in `grown`."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"),
                    F.crc32(F.encode(text, "UTF-8")).cast("long").alias("text_crc32"))
    d = place(place(d, tree, F.col("doc_id"), "shard"), grown, F.col("doc_id"), "grown_shard")
    return number_slots(d.withColumn("law", F.lit("key")), "shard", docs.count()).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def write_shards(docs: DataFrame, tree: dict, path: str, column: str = "in_shard", rows_per_file: int = 500_000) -> None:
    """One folder of Parquet files per shard, named by `column` (which `docs` must not have); large shards are spread over tasks by a salt."""
    n = max(1, -(-docs.count() // (rows_per_file * max(1, len(_leaves(tree))))))
    d = place(docs, tree, F.col("doc_id"), column).withColumn("_salt", F.pmod(F.xxhash64("doc_id", F.lit("salt")), F.lit(n)))
    d.repartition(column, "_salt").drop("_salt").write.partitionBy(column).parquet(path)


def _leaves(tree: dict) -> list:
    return [s for racks in tree.values() for shards in racks.values() for s in shards]
