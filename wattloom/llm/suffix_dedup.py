"""Repeated byte strings by blockwise suffix sorting with a difference cover.

A string of `width` bytes is repeated if it starts anywhere else, in the same text or another.
1. Minimizers: the least hash among the GRAM-byte strings inside a string is its minimizer; equal strings have equal ones. Only strings whose
   minimizer stands at two places or more go on, and runs of them with one minimizer are sent, with their bytes, to its bucket.
   A minimizer with more than HOT places is split by a longer one (LONG_GRAM bytes), so that a hot passage is spread over buckets.
2. A bucket holds the suffixes that start in its runs. It first ranks the suffixes at the places of a difference cover modulo 57 to a
   depth of 235 bytes, then sorts the others one slice of keys at a time. Suffixes that tie on their first and last 64 bytes are
   split around a pivot by cover ranks: for any two places the cover has an offset below 57 that leads both to ranked places, and two such
   offsets reach all `width` bytes. So ties of any length cost two look-ups, and memory is bounded by the slice.
   Slices follow a hash of those 128 bytes, which serves as well as the alphabet to bring equal strings together; ties are in alphabetical order.
3. Each text learns which of its runs' suffixes have an equal, and loses all bytes such strings cover.

Null and empty texts hold nothing. Rows that repeat (a doc_id or a text) repeat each other's strings. Other columns are ignored; a
table without rows gives no rows. Long texts are read in overlapping sections, whole."""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from wattloom.session import cut_lineage

from .common import buffers, chunks, id_array, ids_of, merge_intervals, mix, ranges, slide
from .exchange import answer, binaries, blocked, deal, from_planes, planes, repeated_in, send, send_again

WIDTH, GRAM, LONG_GRAM, HOT = 400, 32, 320, 4096
SECTION = 2 << 20
#: Suffixes that are sorted at once.
SLICE = 1 << 20
#: A perfect difference set; every difference modulo 57 is that of one pair.
MODULUS, COVER = 57, np.array([0, 1, 3, 13, 32, 36, 43, 52])
_EDGE = 64
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x9FB21C651E98DF25
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, np.uint64(base))
    if n:
        p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of each string of `size` bytes: differences of a running polynomial, brought to the same power and mixed."""
    n = len(data) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    run = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _powers(_BASE, len(data)), out=run[1:])
    return mix((run[size:] - run[:n]) * _powers(_BASE_INVERSE, n))


def _offsets() -> np.ndarray:
    """Least offset that leads two residues to the cover, by residue and residue."""
    inside = np.isin(np.arange(MODULUS), COVER)
    out = np.zeros((MODULUS, MODULUS), np.int64)
    r = np.arange(MODULUS)
    for d in range(MODULUS - 1, -1, -1):
        both = inside[(r[:, None] + d) % MODULUS] & inside[(r[None, :] + d) % MODULUS]
        out[both] = d
    return out


OFFSET = _offsets()


def cover_ranks(data: np.ndarray) -> np.ndarray:
    """Alphabetical rank, at the places of the cover, of the next 235 bytes (zeros beyond the end): of 64 bytes first, then doubled by 57 and 114 places, which lead to the cover again."""
    padded = np.concatenate([data, np.zeros(_EDGE + 3 * MODULUS, np.uint8)])
    n = len(padded) - _EDGE + 1
    at = np.flatnonzero(np.isin(np.arange(n) % MODULUS, COVER))
    eight = np.lib.stride_tricks.sliding_window_view(padded, 8)
    words = [np.ascontiguousarray(eight[at + k]).view(">u8").ravel().astype(np.uint64) for k in range(0, _EDGE, 8)]
    order = np.lexsort(words[::-1])
    new = np.zeros(len(at), bool)
    for w in words:
        new[1:] |= w[order][1:] != w[order][:-1]
    rank = np.zeros(n, np.int64)
    rank[at[order]] = np.cumsum(new)
    for step in (MODULUS, 2 * MODULUS):
        further = at + step
        second = np.where(further < n, rank[further.clip(max=n - 1)] + 1, 0)
        rank[at] = np.unique((rank[at] << 32) | second, return_inverse=True)[1]
    return rank


def equal_strings(data: np.ndarray, starts: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Number of the class of equal strings of `width` bytes (320 to 470) for each start."""
    rank, edge = cover_ranks(data), gram_hashes(data, _EDGE)
    far = width - 235 - MODULUS + 1                       # the second ranked place lies this far on, or up to 56 more
    key = mix(edge[starts] * np.uint64(3) + edge[starts + width - _EDGE])
    out, classes = np.empty(len(starts), np.int64), 0
    slices = max(1, -(-len(starts) // SLICE))
    which = (key >> np.uint64(32)) * np.uint64(slices) >> np.uint64(32)
    for s in range(slices):
        own = np.flatnonzero(which == s)
        own = own[np.argsort(key[own], kind="stable")]
        group = np.cumsum(np.r_[False, key[own][1:] != key[own][:-1]]) if len(own) else own
        while len(own):
            first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            size = np.diff(np.r_[first, len(own)])
            pivot, me = starts[own[np.repeat(first, size)]], starts[own]
            side = np.zeros(len(own), np.int64)
            for on in (0, far):
                d = on + OFFSET[(me + on) % MODULUS, (pivot + on) % MODULUS]
                side = np.where(side == 0, np.sign(rank[me + d] - rank[pivot + d]), side)
            same = side == 0
            out[own[same]] = classes + np.repeat(np.arange(len(first)), size)[same]
            classes += len(first)
            left = np.flatnonzero(~same)
            new = group[left] * 2 + (side[left] > 0)
            o = np.argsort(new, kind="stable")
            own, new = own[left[o]], new[o]
            group = np.cumsum(np.r_[False, new[1:] != new[:-1]]) if len(own) else own
    return out


class _Part:
    """A section of some texts. at: start of each string; least: its minimizer."""

    def __init__(self, data: np.ndarray, off: np.ndarray, text: np.ndarray, shift: np.ndarray, width: int):
        self.data, self.off, self.text, self.shift, self.width = data, off, text, shift, width
        self.hash = gram_hashes(data, GRAM)
        least = slide(self.hash, width - GRAM + 1)
        self.valid = np.zeros(max(0, len(data) - width + 1), bool)
        n = np.diff(off) - width + 1
        self.valid[ranges(off[:-1][n > 0], n[n > 0])] = True
        self.least = least

    def minimizers(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct minimizers and at how many places each stands; none where all texts together are shorter than a string."""
        if not len(self.valid):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        reach = self.width - GRAM + 1
        m = np.where(self.valid, self.least, 0)
        around = slide(np.concatenate([np.zeros(reach - 1, np.uint64), m, np.zeros(reach - 1, np.uint64)]), reach, np.maximum)
        return np.unique(self.hash[around == self.hash], return_counts=True)

    def runs(self, known: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, ...]:
        """First start, length, bucket key and digest of each maximal run of strings with one repeated key."""
        at = np.flatnonzero(self.valid & repeated_in(known, self.least))
        key = self.least[at]
        burning = repeated_in(hot, key)
        if burning.any():
            longer = slide(gram_hashes(self.data, LONG_GRAM), self.width - LONG_GRAM + 1)
            key = np.where(burning, mix(key + longer[at]), key)
        if not len(at):
            return at, at, key, key
        new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1] + 1) | (key[1:] != key[:-1])])
        n = np.diff(np.r_[new, len(at)])
        start = at[new]
        run = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(_BYTE[self.data] * _powers(_BASE, len(self.data)), out=run[1:])
        digest = mix((run[start + n + self.width - 1] - run[start]) * _powers(_BASE_INVERSE, len(self.data))[start] + n.astype(np.uint64))
        return start, n, key[new], digest


def _parts(t: pa.Table, width: int, section: int) -> Iterator[_Part]:
    """Sections of the block's texts; those of a long text overlap by width - 1 bytes, so that each string starts in one section only."""
    data, off = buffers(t["text"])
    for lo, hi in chunks(off, section):
        if hi - lo > 1 or off[hi] - off[lo] <= section:
            yield _Part(data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo], np.arange(lo, hi), np.zeros(hi - lo, np.int64), width)
        else:
            for s in range(off[lo], max(off[lo] + 1, off[hi] - width + 1), section):
                e = min(off[hi], s + section + width - 1)
                yield _Part(data[s:e], np.array([0, e - s]), np.array([lo]), np.array([s - off[lo]]), width)


def _emit_minimizers(t: pa.Table, n: int, width: int, section: int) -> list[tuple]:
    found = [p.minimizers() for p in _parts(t, width, section)]
    key, inv = np.unique(np.concatenate([x[0] for x in found]), return_inverse=True)
    count = np.bincount(inv, np.concatenate([x[1] for x in found]), len(key)).astype(np.int64)
    block = t["block"][0].as_py()
    return [(b, block, k.tobytes(), planes(c)) for b, (k, c) in deal((key % np.uint64(n)).astype(np.int64), n, [key, count])]


def _resolve_minimizers(t: pa.Table, hot: int) -> list[tuple]:
    keys = [np.frombuffer(x, np.uint64) for x in binaries(t, "key")]
    count = np.concatenate([from_planes(x, np.int64) for x in binaries(t, "count")])
    u, inv = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(inv, count, len(u))[inv]
    bucket, at, out = t["bucket"][0].as_py(), 0, []
    for block, k in zip(t["block"].to_pylist(), keys):
        c = total[at:at + len(k)]
        at += len(k)
        if (c > 1).any():
            out.append((block, bucket, k[c > 1].tobytes(), k[c > hot].tobytes()))
    return out


def _known(a: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    get = lambda c: np.sort(np.concatenate([np.zeros(0, np.uint64), *[np.frombuffer(x, np.uint64) for x in binaries(a, c) if x is not None]]))
    return get("key"), get("hot")


def _emit_runs(t: pa.Table, a: pa.Table, n: int, width: int, section: int) -> list[tuple]:
    """Runs with their bytes, equal ones of a block once, and how often the block holds each."""
    if not a.num_rows or not t.num_rows:
        return []
    known, hot = _known(a)
    block, out = t["block"][0].as_py(), []
    digests, counts, lengths, keys, texts = [], [], [], [], []
    for p in _parts(t, width, section):
        start, length, key, digest = p.runs(known, hot)
        u, first, c = np.unique(digest, return_index=True, return_counts=True)
        digests.append(u); counts.append(c); lengths.append(length[first]); keys.append(key[first])  # noqa: E702
        texts += [p.data[s:s + m + width - 1] for s, m in zip(start[first].tolist(), length[first].tolist())]
    if not texts:
        return []
    digest, count, length, key = map(np.concatenate, (digests, counts, lengths, keys))
    u, first, inv = np.unique(digest, return_index=True, return_inverse=True)
    count = np.bincount(inv, count, len(u)).astype(np.int32)
    key, length = key[first], length[first].astype(np.int32)
    for b, (i,) in deal((key % np.uint64(n)).astype(np.int64), n, [np.arange(len(u))]):
        raw = np.concatenate([texts[first[k]] for k in i]).tobytes()
        out.append((b, block, key[i].tobytes(), u[i].tobytes(), planes(count[i]), planes(length[i]), pa.compress(raw, codec="zstd", asbytes=True)))
    return out


def _resolve_runs(t: pa.Table, width: int) -> list[tuple]:
    """Sorts the bucket's suffixes and tells each block which stretches of its runs start strings that start elsewhere too."""
    u64 = lambda c: [np.frombuffer(x, np.uint64) for x in binaries(t, c)]
    sizes = [len(x) for x in u64("digest")]
    key, digest = np.concatenate(u64("key")), np.concatenate(u64("digest"))
    count, length = (np.concatenate([from_planes(x, np.int32) for x in binaries(t, c)]).astype(np.int64) for c in ("count", "length"))
    lengths = [from_planes(x, np.int32).astype(np.int64) for x in binaries(t, "length")]
    data = np.concatenate([np.frombuffer(pa.decompress(x, decompressed_size=int((m + width - 1).sum()), codec="zstd", asbytes=True), np.uint8) for x, m in zip(binaries(t, "text"), lengths)])
    start = np.cumsum(length + width - 1) - (length + width - 1)
    run, first, inv = np.unique(digest, return_index=True, return_inverse=True)      # equal runs of several blocks are one
    total, n, key, start = np.bincount(inv, count, len(run)).astype(np.int64), length[first], key[first], start[first]
    alone = np.zeros(len(run), bool)
    order = np.argsort(key, kind="stable")
    cut = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]])
    alone[order] = np.repeat(np.logical_or.reduceat(total[order] == 1, cut), np.diff(np.r_[cut, len(order)]))   # its key has a run that stands once
    again = np.repeat(total > 1, n)
    open_ = np.flatnonzero(alone)
    if len(open_):
        piece = data[ranges(start[open_], n[open_] + width - 1)]
        place = np.cumsum(n[open_] + width - 1) - (n[open_] + width - 1)
        cls = equal_strings(piece, ranges(place, n[open_]), width)
        weight = np.bincount(cls, np.repeat(np.minimum(total[open_], 2), n[open_]))
        again[ranges((np.cumsum(n) - n)[open_], n[open_])] = weight[cls] > 1
    owner, within = np.repeat(np.arange(len(run)), n), ranges(np.zeros(len(run), np.int64), n)
    hit = np.flatnonzero(again)
    new = np.flatnonzero(np.r_[True, (hit[1:] != hit[:-1] + 1) | (owner[hit][1:] != owner[hit][:-1])]) if len(hit) else hit
    many = np.diff(np.r_[new, len(hit)])
    who, off = owner[hit[new]], within[hit[new]]
    lo, hi = np.searchsorted(who, inv), np.searchsorted(who, inv, "right")           # the stretches of each sent run
    i, of_block = ranges(lo, hi - lo), np.repeat(np.repeat(np.arange(len(sizes)), sizes), hi - lo)
    blocks, bucket = t["block"].to_pylist(), t["bucket"][0].as_py()
    return [(blocks[b], bucket, d.tobytes(), planes(x.astype(np.int32)), planes(m.astype(np.int32)))
            for b, (d, x, m) in deal(of_block, len(sizes), [np.repeat(digest, hi - lo), off[i], many[i]])]


def _cut(t: pa.Table, a: pa.Table, width: int, section: int) -> pa.Table:
    data, off = buffers(t["text"])
    spans: list[tuple] = []
    runs = a.filter(a["digest"].is_valid()) if a.num_rows else a
    if runs.num_rows:
        known, hot = _known(a)
        digest = np.concatenate([np.frombuffer(x, np.uint64) for x in binaries(runs, "digest")])
        at, n = (np.concatenate([from_planes(x, np.int32) for x in binaries(runs, c)]).astype(np.int64) for c in ("off", "n"))
        o = np.argsort(digest, kind="stable")
        digest, at, n = digest[o], at[o], n[o]
        for p in _parts(t, width, section):
            start, _, _, d = p.runs(known, hot)
            lo, hi = np.searchsorted(digest, d), np.searchsorted(digest, d, "right")
            i, s = ranges(lo, hi - lo), np.repeat(start, hi - lo)
            k = np.searchsorted(p.off, s, "right") - 1
            begin = off[p.text[k]] + p.shift[k] + s - p.off[k] + at[i]
            spans.append((begin, begin + n[i] + width - 1, p.text[k]))
    text = np.concatenate([x[2] for x in spans]) if spans else np.zeros(0, np.int64)
    s, e = (np.concatenate([x[j] for x in spans]) if spans else text for j in (0, 1))
    o = np.argsort(text, kind="stable")
    text, s, e = text[o], s[o], e[o]
    removed, number, digests, kept = [], [], [], []
    for k in range(t.num_rows):
        x, y = np.searchsorted(text, [k, k + 1])
        keep = data[off[k]:off[k + 1]]
        b, f = merge_intervals(s[x:y], e[x:y])
        if len(b):
            mask = np.ones(len(keep), bool)
            mask[ranges(b - off[k], f - b)] = False
            keep = keep[mask]
        removed.append(int((f - b).sum()))
        number.append(len(b))
        digests.append(hashlib.sha256(keep.tobytes()).hexdigest())
        kept.append(keep.tobytes())
    return pa.table({"doc_id": id_array(ids_of(t["doc_id"])), "n_bytes": pa.array(np.diff(off), pa.int64()), "n_removed": pa.array(removed, pa.int64()),
                     "n_spans": pa.array(number, pa.int64()), "kept_sha256": pa.array(digests, pa.string()), "kept": pa.array(kept, pa.binary())})


def dedup(docs: DataFrame, width: int = WIDTH, with_bytes: bool = True, hot: int | None = None, section: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept (the remaining bytes) of each row. `width`: 320 to 470 bytes.

    `hot` and `section` (HOT and SECTION if not given) go to the tasks with the functions; the result doesn't depend on them."""
    hot, section = HOT if hot is None else hot, SECTION if section is None else section
    table, n = blocked(docs, by_text=True)
    known = cut_lineage(answer(send(table, lambda t: _emit_minimizers(t, n, width, section), ["key", "count"]), lambda t: _resolve_minimizers(t, hot), ["key", "hot"]))
    runs = send_again(table, known, lambda t, a: _emit_runs(t, a, n, width, section), ["key", "digest", "count", "length", "text"])
    told = answer(runs, lambda t: _resolve_runs(t, width), ["digest", "off", "n"]).unionByName(known, allowMissingColumns=True)
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_bytes]
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_bytes
    return table.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(lambda t, a: _cut(t, a, width, section).select(names), schema)
