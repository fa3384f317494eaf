"""Repeated word passages by compaction of a De Bruijn graph.

Each window of `window` words is an edge between its first and its last window-1 words; an edge is repeated if documents with different ids hold it.
1. Minimizers: of the K-word hashes inside a window the least one is its minimizer, so equal windows have equal minimizers, and only one
   place in about four is one. Those that more than one document holds are found first; windows of other minimizers can't repeat.
2. Runs of windows with one minimizer go to the bucket of that minimizer, which finds for every edge its source: the first place in the document
   with the least id. Edges of a run with consecutive sources are one nonbranching piece.
3. Pieces compact to paths through a Spark join: a piece that begins in document and source where another one ends continues it.
4. The words at the source coordinates are read again and must give the same digest, by a second hash, as the words of the path's copy.
   Only verified spans are removed, from every document but those of the source.

Rows with a null doc_id count as one document with the largest id. Null, empty and short texts hold no window; rows that repeat a doc_id don't
cut each other, and what is found in one of them is cut from that one alone: their different texts lie one behind another on the document's line of
places, with a gap between. Other columns are ignored; a table without rows gives no rows. Whole texts are read, whatever their length."""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from wattloom.session import cut_lineage

from .common import NO_ID, Words, block_of, buffers, chunks, grams, id_array, ids_of, merge_intervals, mix, ranges, slide
from .exchange import answer, binaries, blocked, deal, from_planes, packed_table, planes, repeated_in, send, send_again

K = 6
_SEEDS = (11, 12)
_SPAN = "doc_id long, start long, n long, src_doc long, src_start long, digest long"


class _Part:
    """Windows of a run of texts: minimizer `least` and hash `edge` of each valid window `at` (a word number), its document, and where its text begins there."""

    def __init__(self, words: Words, ids: np.ndarray, base: np.ndarray, window: int):
        self.words, self.ids, self.base, self.window = words, ids, base, window
        h = words.hashes(_SEEDS[0])
        self.text = np.repeat(np.arange(len(ids)), np.diff(words.first))
        self.kmers = grams(h, min(K, window), 21)
        least = slide(self.kmers, window - min(K, window) + 1)
        self.at = np.flatnonzero(self.text[:len(least)] == self.text[window - 1:]) if len(least) else np.zeros(0, np.int64)
        self.least = least[self.at]
        self.edges = grams(h, window, 22)

    def minimizers(self) -> tuple[np.ndarray, np.ndarray]:
        """Hash and document of each minimizer."""
        hit = np.zeros(len(self.kmers), bool)
        for j in range(self.window - min(K, self.window) + 1):
            hit[self.at + j] |= self.kmers[self.at + j] == self.least
        at = np.flatnonzero(hit)
        return self.kmers[at], self.ids[self.text[at]]

    def runs(self, repeated: np.ndarray) -> tuple[np.ndarray, ...]:
        """First window, number of windows, minimizer and digest of each maximal run of windows with one repeated minimizer."""
        keep = repeated_in(repeated, self.least)
        at, least = self.at[keep], self.least[keep]
        if not len(at):
            return at, at, least, least
        new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1] + 1) | (least[1:] != least[:-1])])
        n = np.diff(np.r_[new, len(at)])
        place = np.arange(len(at)) - np.repeat(new, n)
        return at[new], n, least[new], mix(np.add.reduceat(mix(self.edges[at] + place.astype(np.uint64)), new) + n.astype(np.uint64))


def _bases(data: np.ndarray, off: np.ndarray, ids: np.ndarray, window: int) -> np.ndarray:
    """Place of each text's first word in its document: 0 but for ids with several texts (a block has all of an id), which follow each other by digest; equal texts of an id share theirs."""
    base = np.zeros(len(ids), np.int64)
    _, inv, count = np.unique(ids, return_inverse=True, return_counts=True)
    rows = np.flatnonzero(count[inv] > 1).tolist()
    line = sorted((int(ids[k]), hashlib.sha256(data[off[k]:off[k + 1]].tobytes()).digest(), k) for k in rows)
    for (i, d, j), (i2, d2, k) in zip(line, line[1:]):
        if i == i2:
            base[k] = base[j] + (int(off[j + 1] - off[j]) + window if d != d2 else 0)
    return base


def _parts(t: pa.Table, window: int) -> Iterator[_Part]:
    data, off = buffers(t["text"])
    ids = ids_of(t["doc_id"])
    base = _bases(data, off, ids, window)
    for lo, hi in chunks(off):
        yield _Part(Words(data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo]), ids[lo:hi], base[lo:hi], window)


def _least_most(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, least and largest document of each."""
    o = np.lexsort((doc, key))
    key, doc = key[o], doc[o]
    new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return key[new], doc[new], doc[np.r_[new[1:] - 1, len(doc) - 1]] if len(key) else doc


def _emit_minimizers(t: pa.Table, n: int, window: int) -> list[tuple]:
    found = [_least_most(*p.minimizers()) for p in _parts(t, window)]
    key, lo, _ = map(np.concatenate, zip(*found))
    hi = np.concatenate([x[2] for x in found])
    o = np.lexsort((lo, key))
    key, lo, hi = key[o], lo[o], hi[o]
    if not len(key):
        return []
    new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    key, lo, hi = key[new], lo[new], np.maximum.reduceat(hi, new)
    block = t["block"][0].as_py()
    return [(b, block, k.tobytes(), planes(x), planes(y - x)) for b, (k, x, y) in deal((key % np.uint64(n)).astype(np.int64), n, [key, lo, hi])]


def _resolve_minimizers(t: pa.Table) -> list[tuple]:
    """Which hashes more than one document holds, told to each block that has them."""
    key = [np.frombuffer(x, np.uint64) for x in binaries(t, "key")]
    lo = [from_planes(x, np.int64) for x in binaries(t, "lo")]
    hi = [a + from_planes(x, np.int64) for a, x in zip(lo, binaries(t, "more"))]
    k = np.concatenate(key)
    u, inv = np.unique(k, return_inverse=True)
    least, most = np.full(len(u), NO_ID), np.full(len(u), np.iinfo(np.int64).min)
    np.minimum.at(least, inv, np.concatenate(lo))
    np.maximum.at(most, inv, np.concatenate(hi))
    again = (least < most)[inv]
    bucket, at, out = t["bucket"][0].as_py(), 0, []
    for block, x in zip(t["block"].to_pylist(), key):
        r = x[again[at:at + len(x)]]
        at += len(x)
        if len(r):
            out.append((block, bucket, r.tobytes()))
    return out


def _emit_runs(t: pa.Table, a: pa.Table, n: int, window: int) -> list[tuple]:
    """Runs of windows with a repeated minimizer, equal ones of a block once, with their first place and their largest document."""
    if not a.num_rows or not t.num_rows:
        return []
    repeated = np.sort(np.concatenate([np.frombuffer(x, np.uint64) for x in binaries(a, "key")]))
    least, digest, doc, pos, count, edges = [], [], [], [], [], []
    for p in _parts(t, window):
        at, c, m, d = p.runs(repeated)
        text = p.text[at] if len(at) else at
        least.append(m); digest.append(d); doc.append(p.ids[text]); pos.append(at - p.words.first[text] + p.base[text]); count.append(c)  # noqa: E702
        edges.append(p.edges[ranges(at, c)])
    least, digest, doc, pos, count, edges = map(np.concatenate, (least, digest, doc, pos, count, edges))
    if not len(least):
        return []
    start = np.cumsum(count) - count
    o = np.lexsort((pos, doc, digest))
    new = np.flatnonzero(np.r_[True, digest[o][1:] != digest[o][:-1]])
    most, one = np.maximum.reduceat(doc[o], new), o[new]
    block = t["block"][0].as_py()
    out = []
    for b, (i, hi) in deal((least[one] % np.uint64(n)).astype(np.int64), n, [one, most]):
        out.append((b, block, least[i].tobytes(), digest[i].tobytes(), planes(doc[i]), planes(hi - doc[i]), planes(pos[i]), planes(count[i].astype(np.int32)), edges[ranges(start[i], count[i])].tobytes()))
    return out


def _resolve_runs(t: pa.Table) -> list[tuple]:
    """Source of each edge, and for each block the pieces of its runs whose source has a smaller id than some document of the run."""
    column = lambda name, f: [f(x) for x in binaries(t, name)]
    u64 = lambda x: np.frombuffer(x, np.uint64)
    least, digest, edge = (np.concatenate(column(c, u64)) for c in ("least", "digest", "edge"))
    doc, more = (np.concatenate(column(c, lambda x: from_planes(x, np.int64))) for c in ("doc", "more"))
    pos, count = (np.concatenate(column(c, lambda x, kind=kind: from_planes(x, kind))).astype(np.int64) for c, kind in (("pos", np.int64), ("count", np.int32)))
    sizes = [len(x) // 8 for x in binaries(t, "least")]
    run = np.repeat(np.arange(len(least)), count)
    off = np.arange(len(edge)) - np.repeat(np.cumsum(count) - count, count)
    o = np.lexsort((pos[run] + off, doc[run], least[run], edge))
    new = np.r_[True, (edge[o][1:] != edge[o][:-1]) | (least[run][o][1:] != least[run][o][:-1])]
    group = np.empty(len(edge), np.int64)
    group[o] = np.cumsum(new) - 1
    first = o[new]
    src_doc, src_pos = doc[run][first][group], (pos[run] + off)[first][group]
    keep = np.flatnonzero(src_doc < (doc + more)[run])
    if not len(keep):
        return []
    r, f, sd, sp = run[keep], off[keep], src_doc[keep], src_pos[keep]
    cut = np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (f[1:] != f[:-1] + 1) | (sd[1:] != sd[:-1]) | (sp[1:] != sp[:-1] + 1)])
    n = np.diff(np.r_[cut, len(r)])
    owner = np.repeat(np.arange(len(sizes)), sizes)[r[cut]]
    blocks, bucket = t["block"].to_pylist(), t["bucket"][0].as_py()
    return [(blocks[b], bucket, d.tobytes(), planes(x.astype(np.int32)), planes(m.astype(np.int32)), planes(a), planes(y))
            for b, (d, x, m, a, y) in deal(owner, len(sizes), [digest[r[cut]], f[cut], n, sd[cut], sp[cut]])]


def _pieces(t: pa.Table, a: pa.Table, repeated: pa.Table, window: int) -> pa.Table:
    """Pieces of the block's documents: place, number of windows, source place, digest by the second hash."""
    empty = pa.table({c: pa.array([], pa.int64()) for c in ("doc_id", "start", "n", "src_doc", "src_start", "digest")})
    if not a.num_rows or not t.num_rows:
        return empty
    known = np.sort(np.concatenate([np.frombuffer(x, np.uint64) for x in repeated]))
    digest = np.concatenate([np.frombuffer(x, np.uint64) for x in binaries(a, "digest")])
    off, n = (np.concatenate([from_planes(x, np.int32) for x in binaries(a, c)]).astype(np.int64) for c in ("off", "n"))
    src_doc, src_pos = (np.concatenate([from_planes(x, np.int64) for x in binaries(a, c)]) for c in ("src_doc", "src_pos"))
    o = np.argsort(digest, kind="stable")
    digest, off, n, src_pos, src_doc = (x[o] for x in (digest, off, n, src_pos, src_doc))
    out = []
    for p in _parts(t, window):
        at, c, _, d = p.runs(known)
        lo, hi = np.searchsorted(digest, d), np.searchsorted(digest, d, "right")
        i = ranges(lo, hi - lo)
        start = np.repeat(at, hi - lo) + off[i]
        text = p.text[start] if len(start) else start
        own = src_doc[i] < p.ids[text]
        i, start, text = i[own], start[own], text[own]
        if len(i):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(grams(p.words.hashes(_SEEDS[1]), window, 23))])
            out.append((p.ids[text], start - p.words.first[text] + p.base[text], n[i], src_doc[i], src_pos[i], (total[start + n[i]] - total[start]).view(np.int64)))
    if not out:
        return empty
    rows = np.unique(np.stack([np.concatenate(x) for x in zip(*out)]), axis=1)        # rows that repeat a doc_id count once
    return pa.table([pa.array(x) for x in rows], empty.schema.names)


def _source_digests(t: pa.Table, a: pa.Table, window: int) -> pa.Table:
    """Digest, by the second hash, of the words at the asked source coordinates, in the row that they lie in."""
    names = ["src_doc", "src_start", "n", "src_digest"]
    out = [(np.zeros(0, np.int64),) * 4]
    if a.num_rows and t.num_rows:
        want, start, n = (a[c].to_numpy() for c in names[:3])
        o = np.argsort(want, kind="stable")
        want, start, n = want[o], start[o], n[o]
        for p in _parts(t, window):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(grams(p.words.hashes(_SEEDS[1]), window, 23))])
            lo, hi = np.searchsorted(want, p.ids), np.searchsorted(want, p.ids, "right")
            i, text = ranges(lo, hi - lo), np.repeat(np.arange(len(p.ids)), hi - lo)
            within = start[i] - p.base[text]
            fits = (within >= 0) & (within + n[i] + window - 1 <= np.diff(p.words.first)[text])
            i, text, within = i[fits], text[fits], within[fits]
            at = p.words.first[text] + within
            out.append((want[i], start[i], n[i], (total[at + n[i]] - total[at]).view(np.int64)))
    return pa.table([pa.array(np.concatenate(x), pa.int64()) for x in zip(*out)], names)


def compact(pieces: DataFrame) -> DataFrame:
    """Joins pieces of a document end to end where the source goes on too. Returns the paths' spans with the sum of the pieces' digests.

    A left join finds the pieces that continue no other; each starts a path, and the running count of starts numbers the pieces of a document."""
    line = ["doc_id", "src_doc", "shift"]
    p = pieces.withColumn("shift", F.col("src_start") - F.col("start"))
    ends = p.select(*line, (F.col("start") + F.col("n")).alias("start"), F.lit(True).alias("goes_on"))
    marked = p.join(ends, [*line, "start"], "left")
    so_far = W.partitionBy(*line).orderBy("start").rowsBetween(W.unboundedPreceding, W.currentRow)
    path = marked.withColumn("path", F.sum(F.col("goes_on").isNull().cast("int")).over(so_far))
    return (path.groupBy(*line, "path").agg(F.min("start").alias("start"), F.sum("n").alias("n"), F.sum(F.col("digest").cast("decimal(38,0)")).alias("digest"))
            .select("doc_id", "start", "n", "src_doc", (F.col("start") + F.col("shift")).alias("src_start"), "digest"))


def repeated_passages(docs: DataFrame, n: int, window: int = 13) -> DataFrame:
    """Verified spans: doc_id, start (word), n (windows), src_doc, src_start. `docs` and `n` as blocked() gives them."""
    sent = send(docs, lambda t: _emit_minimizers(t, n, window), ["key", "lo", "more"])
    known = cut_lineage(answer(sent, _resolve_minimizers, ["key"]))
    runs = send_again(docs, known, lambda t, a: _emit_runs(t, a, n, window), ["least", "digest", "doc", "more", "pos", "count", "edge"])
    sources = answer(runs, _resolve_runs, ["digest", "off", "n", "src_doc", "src_pos"])
    both = sources.withColumn("key", F.lit(None).cast("binary")).unionByName(known.select("block", "bucket", "key"), allowMissingColumns=True)

    def place(t, a):
        key = a["key"].is_valid() if a.num_rows else None
        return _pieces(t, a.filter(a["digest"].is_valid()), a.filter(key)["key"].to_pylist() if a.num_rows else [], window)
    pieces = docs.groupBy("block").cogroup(both.groupBy("block")).applyInArrow(place, _SPAN)
    spans = cut_lineage(compact(cut_lineage(pieces)))
    asked = spans.select("src_doc", "src_start", "n").distinct().withColumn("block", block_of(n, "src_doc"))
    source = docs.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(lambda t, a: _source_digests(t, a, window), "src_doc long, src_start long, n long, src_digest long")
    # sums of 64-bit words agree if they agree modulo 2^64
    word = F.lit("18446744073709551616").cast("decimal(20,0)")
    same = F.pmod(F.col("digest"), word) == F.pmod(F.col("src_digest").cast("decimal(38,0)"), word)
    return spans.join(source.distinct(), ["src_doc", "src_start", "n"]).filter(same).select("doc_id", "start", "n", "src_doc", "src_start").distinct()


def _cut(t: pa.Table, a: pa.Table, window: int) -> pa.Table:
    data, off = buffers(t["text"])
    ids = ids_of(t["doc_id"])
    base = _bases(data, off, ids, window)
    spans = {}
    if a.num_rows:
        doc, start, n = (a[c].to_numpy() for c in ("doc_id", "start", "n"))
        o = np.lexsort((start, doc))
        doc, start, n = doc[o], start[o], n[o]
        at = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        spans = {int(doc[x]): (start[x:y], n[x:y]) for x, y in zip(at, np.r_[at[1:], len(doc)])}
    total, removed, digest, kept_text = [], [], [], []
    for lo, hi in chunks(off):
        w = Words(data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo])
        raw = w.data
        for k in range(hi - lo):
            first, last = w.first[k], w.first[k + 1]
            keep = np.ones(last - first, bool)
            if int(ids[lo + k]) in spans:
                s, n = spans[int(ids[lo + k])]
                x, y = np.searchsorted(s, [base[lo + k], base[lo + k] + last - first])
                s, n = s[x:y] - base[lo + k], n[x:y]
                for x, y in zip(*merge_intervals(s, s + n + window - 1)):
                    keep[x:y] = False
            word = np.flatnonzero(keep) + first
            # bytes of the kept words with one space behind each but the last
            size = w.ends[word] - w.starts[word]
            text = np.full(int(size.sum()) + max(0, len(word) - 1), 32, np.uint8)
            text[ranges(np.cumsum(size + 1) - size - 1, size)] = raw[ranges(w.starts[word], size)]
            total.append(last - first)
            removed.append(last - first - len(word))
            digest.append(hashlib.sha256(text).hexdigest())
            kept_text.append(text.tobytes())
    return pa.table({"doc_id": id_array(ids), "n_words": pa.array(total, pa.int64()), "n_removed": pa.array(removed, pa.int64()),
                     "kept_sha256": pa.array(digest, pa.string()), "kept": pa.array(kept_text, pa.binary()).cast(pa.string())})


def dedup(docs: DataFrame, window: int = 13, with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if asked for, kept (the kept words joined by spaces) of each row."""
    table, n = blocked(docs)
    spans = repeated_passages(table, n, window).withColumn("block", block_of(n, "doc_id"))
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", *["kept"] * with_text]
    return table.groupBy("block").cogroup(spans.groupBy("block")).applyInArrow(lambda t, a: _cut(t, a, window).select(names), "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text)
