"""Bound-certified best-fit packing of token sequences.

Documents are cut to pieces of at most `size` tokens. Pieces are dealt to partitions of bounded size, each packs its own by best-fit
decreasing and gets a lower bound from dual feasible functions. A partition that meets its bound is certified and stays as it
is; the others exchange their documents (a new hash deals them to half as many partitions) and pack again, as long as this
saves sequences. Null and empty texts are documents of the end token alone. Repeated rows are packed each."""
from __future__ import annotations

import base64
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wattloom.session import cut_lineage

#: Pieces a partition packs on average, and how often partitions with gaps exchange documents at most.
PART_PIECES, ROUNDS = 16_384, 4
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"
_DOUBLE_SPACE = re.compile(r"\s\s")


@lru_cache(maxsize=4)
def _encoders(vocabulary: str):
    """Encoder of the vocabulary, and one whose pattern needs no look-ahead: the same for texts without two white spaces in a row."""
    import public_tokenizers
    import tiktoken
    with open(public_tokenizers.path(vocabulary), "rb") as f:
        ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in f)}
    whole = public_tokenizers.PATTERN
    plain = whole.replace(r"|\s+(?!\S)|\s+", r"|\s")
    return tuple(tiktoken.Encoding(n, pat_str=p, mergeable_ranks=ranks, special_tokens={}) for n, p in (("whole", whole), ("plain", plain)))


def token_ids(text: str, vocabulary: str = "byte_bpe_50k.tiktoken") -> list[int]:
    """Ids of byte_bpe_50k.json for the text; the file of ranks holds the same vocabulary and is read several times faster."""
    whole, plain = _encoders(vocabulary)
    return (whole if _DOUBLE_SPACE.search(text) else plain).encode_ordinary(text)


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of each piece: whole ones of `size`, the first takes what is over."""
    first = n % size or min(n, size)
    return [(0, first), *((s, size) for s in range(first, n, size))]


def pieces(docs: DataFrame, size: int = 1024, end_id: int = 2) -> DataFrame:
    """Pieces of each document with the crc32 of their ids (unsigned 32-bit, little-endian)."""
    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part, rows = b.slice(lo, 256), []
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    ids = np.array([*token_ids(text or ""), end_id], "<u4")
                    rows += [(doc, i, s, n, zlib.crc32(ids[s:s + n].tobytes())) for i, (s, n) in enumerate(cut(len(ids), size))]
                d, i, s, n, c = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(i, pa.int32()), *[pa.array(x, pa.int64()) for x in (s, n, c)]],
                                                 ["doc_id", "piece", "start", "length", "ids_crc32"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECE_SCHEMA)


def best_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each length, longest first into the fullest bin that takes it; number of bins."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(size + 1)]
    rooms, used = 0, 0                                       # bit r of rooms: some bin has r tokens left
    for i, n in zip(order.tolist(), lengths[order].tolist()):
        fits = rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, b, used = size, used, used + 1
        bins[i], offsets[i] = b, size - room
        if room > n:
            by_room[room - n].append(b)
            rooms |= 1 << (room - n)
    return bins, offsets, used


def lower_bound(lengths: np.ndarray, size: int) -> int:
    """Fewest bins that any packing needs, by three families of dual feasible functions (each maps lengths so that no bin holds more than 1)."""
    count = np.bincount(lengths, minlength=size + 1)
    x = np.arange(size + 1)
    best = -(-int((count * x).sum()) // size)
    for t in range(1, size // 2 + 1):                         # above size - t: a bin each; below t: nothing
        v = np.where(x > size - t, size, np.where(x >= t, x, 0))
        best = max(best, -(-int((count * v).sum()) // size))
        half = np.where(2 * x > size, 2 * (size // t - (size - x) // t), np.where(2 * x == size, size // t, 2 * (x // t)))   # whole multiples of t
        best = max(best, -(-int((count * half).sum()) // (2 * (size // t))))
    for k in range(1, 33):                                    # rounding to k-ths
        u = np.where((k + 1) * x % size == 0, x * k, (k + 1) * x // size * size)
        best = max(best, -(-int((count * u).sum()) // (k * size)))
    return best


def _packed(df: DataFrame, parts: int, rnd: int, size: int) -> DataFrame:
    """One round: each partition packs what a hash deals to it."""
    def run(key, t):
        n = t["length"].to_numpy()
        b, off, used = best_fit(n, size)
        gap = used - lower_bound(n, size)
        sequence = b + ((rnd << 58) + (int(key[0].as_py()) << 26))
        t = t.select(["doc_id", "piece", "start", "length", "ids_crc32"])
        for name, v in (("sequence_id", sequence), ("offset", off), ("gap", np.full(len(n), gap)), ("used", np.full(len(n), used))):
            t = t.append_column(name, pa.array(v, pa.int64()))
        return t
    d = df.withColumn("_part", F.pmod(F.xxhash64("doc_id", "piece", "start", "length", "ids_crc32", F.lit(rnd)), F.lit(parts)))
    return cut_lineage(d.groupBy("_part").applyInArrow(run, PIECE_SCHEMA + ", sequence_id long, offset long, gap long, used long"))


def _sequences(packed: DataFrame) -> int:
    return packed.filter("offset = 0").count()


def pack(df: DataFrame, size: int = 1024) -> DataFrame:
    """Adds sequence_id and offset to pieces (PIECE_SCHEMA). A piece of `size` tokens is a sequence of its own; best fit would give it one as well."""
    rows = df.count()
    parts = max(1, -(-rows // PART_PIECES))
    packed, done = _packed(df, parts, 1, size), []
    for rnd in range(2, ROUNDS + 2):
        open_ = packed.filter("gap > 0")
        gaps = open_.filter("offset = 0").count()
        if not gaps or parts == 1:
            break
        done.append(packed.filter("gap = 0"))
        parts = max(1, -(-parts // 2), -(-open_.count() // PART_PIECES))
        again = _packed(open_.select(*df.columns), parts, rnd, size)
        if _sequences(again) >= gaps:
            packed = open_
            break
        packed = again
    out = packed
    for x in done:
        out = out.unionByName(x)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def pack_documents(docs: DataFrame, size: int = 1024, end_id: int = 2) -> DataFrame:
    """Pieces of all documents and their places. The pieces are written once, so that no text is tokenised twice."""
    return pack(cut_lineage(pieces(docs, size, end_id)), size)
