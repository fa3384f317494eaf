"""What the corpus operators share: tables, UTF-8 buffers, words and their hashes, block and bucket numbers."""
from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Text bytes that one block of documents holds on average, and the least number of blocks.
BLOCK_BYTES, LEAST_BLOCKS = 8 << 20, 128
#: Bytes of text that are looked at at once inside a task.
CHUNK_BYTES = 4 << 20
#: Stands for a doc_id that is null: larger than every other.
NO_ID = np.iinfo(np.int64).max


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, so that no other column of the table can clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def block_count(docs: DataFrame, text: str = "text", target: int = BLOCK_BYTES) -> int:
    """Number of document blocks: grows with the bytes of the text, so that a block stays of bounded size."""
    n = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(LEAST_BLOCKS, -(-n // target))


def block_of(n: int, *keys: str) -> Column:
    return F.pmod(F.xxhash64(*(keys or ("doc_id",)), F.lit("block")), F.lit(n)).cast("int")


def buffers(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts of the column, and where each text starts and the last one ends; nulls are empty."""
    a = (pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], col.type)) if isinstance(col, pa.ChunkedArray) else col
    a = a.fill_null("").cast(pa.large_string())
    off = np.frombuffer(a.buffers()[1], np.int64)[a.offset:a.offset + len(a) + 1] if len(a) else np.zeros(1, np.int64)
    data = np.frombuffer(a.buffers()[2], np.uint8) if len(a) and a.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[off[0]:off[-1]], off - off[0]


def ids_of(col: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The ids as int64; a null is NO_ID."""
    return col.cast(pa.int64()).fill_null(int(NO_ID)).to_numpy(zero_copy_only=False) if isinstance(col, pa.Array) else col.cast(pa.int64()).fill_null(int(NO_ID)).to_numpy()


def id_array(ids: np.ndarray) -> pa.Array:
    """Back to Arrow: NO_ID is null again."""
    return pa.array(ids, pa.int64(), mask=ids == NO_ID)


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about `most` bytes; a longer text is a range of its own."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def odd(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit factors that depend on the seed alone."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


#: ASCII white space, and lower case for A-Z alone.
SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
LOWER = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)).astype(np.uint8)
_AT = 64


@lru_cache(maxsize=8)
def _table(seed: int) -> np.ndarray:
    return odd(_AT * 256, seed)


class Words:
    """Words `[^\\x20\\x09-\\x0D]+` of a run of texts: byte range of each and the number of the first word of each text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        gap = SPACE[data]
        before = np.empty(len(data) + 1, bool)
        before[0], before[1:] = True, gap
        before[offsets] = True                              # a text starts here, so a word may
        gap_after = np.empty(len(data) + 1, bool)
        gap_after[:-1], gap_after[-1] = gap, True
        gap_after[offsets] = True
        self.starts = np.flatnonzero(~gap & before[:-1])
        self.ends = np.flatnonzero(~gap & gap_after[1:]) + 1
        self.first = np.searchsorted(self.starts, offsets)

    def hashes(self, seed: int, data: np.ndarray | None = None) -> np.ndarray:
        """64-bit hash of each word. `data`: other bytes in the same places, such as lower case."""
        return span_hashes(self.data if data is None else data, self.starts, self.ends, seed)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """64-bit hash of the bytes of each span (none is empty): sum of table entries by byte and place, mixed."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    length = ends - starts
    stop = np.cumsum(length)
    place = np.arange(stop[-1]) - np.repeat(stop - length, length)
    v = _table(seed)[(place % _AT) * 256 + data[np.repeat(starts, length) + place]]
    if length.max() > _AT:
        far = place >= _AT
        v[far] *= mix((place[far] // _AT).astype(np.uint64) + np.uint64(seed)) | np.uint64(1)
    return mix(np.add.reduceat(v, stop - length) + length.astype(np.uint64))


def grams(h: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Hash of the k words from each word on, len(h) - k + 1 of them (none if there are fewer words)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j, c in enumerate(odd(k, seed)):
        out += h[j:j + n] * c
    return mix(out)


def slide(x: np.ndarray, w: int, f=np.minimum) -> np.ndarray:
    """f over each run of w values, len(x) - w + 1 of them, by doubling."""
    n, have = len(x) - w + 1, 1
    if n <= 0:
        return x[:0]
    out = x
    while have * 2 <= w:
        out = f(out[:len(out) - have], out[have:])
        have *= 2
    return f(out[:n], out[w - have:w - have + n]) if have < w else out[:n]


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... counts[0] of them, then those of the next."""
    stop = np.cumsum(counts)
    return np.arange(stop[-1] if len(stop) else 0) - np.repeat(stop - counts, counts) + np.repeat(starts, counts)


def merge_intervals(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint maximal intervals that cover the same places; touching ones become one."""
    if not len(starts):
        return starts, ends
    o = np.argsort(starts, kind="stable")
    s, e = starts[o], np.maximum.accumulate(ends[o])
    new = np.r_[True, s[1:] > e[:-1]]
    return s[new], e[np.r_[np.flatnonzero(new)[1:] - 1, len(s) - 1]]
