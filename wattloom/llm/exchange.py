"""Documents in blocks, and fingerprints that travel between blocks and hash buckets as packed arrays.

Documents are written once to a table bucketed by block, so that each pass over the texts runs without a shuffle of them. A pass sends
its fingerprints to hash buckets (one row for each block and bucket, arrays inside); a bucket sees every block that holds a
fingerprint and answers each of them. A fingerprint comes from a block once at most, however often the block's documents repeat it,
so a hot one costs a bucket as many entries as there are blocks."""
from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wattloom.session import scratch

from .common import NO_ID, block_count, block_of, texts


def blocked(docs: DataFrame, by_text: bool = False) -> tuple[DataFrame, int]:
    """(doc_id, text, block) from a table bucketed by block, and the number of blocks. A null doc_id is NO_ID. Rows of one doc_id share a block; `by_text`: only if their
    texts are equal too, so that rows without an id are spread."""
    spark, d = docs.sparkSession, texts(docs).withColumn("doc_id", F.coalesce("doc_id", F.lit(int(NO_ID))))
    n = block_count(d)
    if n > int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets")):
        spark.conf.set("spark.sql.sources.bucketing.maxBuckets", str(n))
    name = f"blocks_{uuid.uuid4().hex[:12]}"
    (d.withColumn("block", block_of(n, "doc_id", *["text"] * by_text)).repartition(n, "block").write.bucketBy(n, "block").option("path", scratch(spark, "blocks"))
     .option("compression", "zstd").saveAsTable(name))
    return spark.table(name), n


def planes(x: np.ndarray) -> bytes:
    """The bytes of an integer array, all first bytes first: high bytes, mostly equal, lie together and compress."""
    return x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes() if len(x) else b""


def from_planes(b: bytes, dtype) -> np.ndarray:
    t = np.dtype(dtype)
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(t.itemsize, -1).T).view(t).ravel() if len(b) else np.zeros(0, t)


def deal(to: np.ndarray, n_to: int, arrays: list[np.ndarray]) -> list[tuple[int, list[np.ndarray]]]:
    """The entries of the arrays by destination, in their order."""
    order = np.argsort(to, kind="stable")
    cut = np.searchsorted(to[order], np.arange(n_to + 1))
    arrays = [a[order] for a in arrays]
    return [(t, [a[lo:hi] for a in arrays]) for t, lo, hi in zip(range(n_to), cut[:-1].tolist(), cut[1:].tolist()) if hi > lo]


def packed_table(rows: list[tuple], names: list[str]) -> pa.Table:
    """Rows of two ints and then byte strings."""
    cols = list(zip(*rows)) or [[] for _ in names]
    return pa.table([pa.array(c, pa.int32() if i < 2 else pa.binary()) for i, c in enumerate(cols)], names)


def binaries(t: pa.Table, name: str) -> list[bytes]:
    return t[name].to_pylist()


def send(docs: DataFrame, emit: Callable, columns: list[str]) -> DataFrame:
    """Groups the blocks: emit(block table) gives rows (bucket, block, *bytes)."""
    names = ["bucket", "block", *columns]
    return docs.groupBy("block").applyInArrow(lambda t: packed_table(emit(t), names), ", ".join(["bucket int", "block int", *[f"{c} binary" for c in columns]]))


def send_again(docs: DataFrame, answers: DataFrame, emit: Callable, columns: list[str]) -> DataFrame:
    """The same with what the buckets answered: emit(block table, answers)."""
    names = ["bucket", "block", *columns]
    return docs.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(lambda t, a: packed_table(emit(t, a), names), ", ".join(["bucket int", "block int", *[f"{c} binary" for c in columns]]))


def answer(sent: DataFrame, resolve: Callable, columns: list[str]) -> DataFrame:
    """Groups the buckets: resolve(bucket table) gives rows (block, bucket, *bytes)."""
    names = ["block", "bucket", *columns]
    return sent.groupBy("bucket").applyInArrow(lambda t: packed_table(resolve(t), names), ", ".join(["block int", "bucket int", *[f"{c} binary" for c in columns]]))


def repeated_in(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Which of x are among the sorted values."""
    return sorted_values[np.searchsorted(sorted_values, x).clip(max=len(sorted_values) - 1)] == x if len(sorted_values) else np.zeros(len(x), bool)
