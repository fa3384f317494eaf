"""Similarity join on word shingles with count-vector R-trees.

A document's set holds its distinct SHINGLE-word shingles (lower case for A-Z; fewer words: the whole sequence as one). Two link if
100 * intersection >= PERCENT * union. Shingles are hashed into groups; the counts by group are the set's point. For a node of a tree, the sum over groups of
the lesser of the query's count and the node's largest count bounds every overlap below it; what survives is verified on the sets.

A tree over all documents would be one task's work, and points of unrelated documents lie too near each other to prune, so trees are built over cells:
1. Linked sets differ in few shingles (at most D, which follows from their sizes). Cut into more than D groups they agree in some wholly:
   a signature is a group's number, count and sum. Each block sends its signatures to buckets, which answer those that two blocks hold.
2. A set goes on only if at least its number of filled groups less D signatures are shared. Sets that share one are in a cell; those that few signatures
   name are passed over as far as the count leaves one, so that a common passage doesn't tie families together.
3. Cells of moderate size get a tree in one task. A larger cell is cut to leaves, each a row group of its own: first one set of each family
   (sets with the same least partner) queries all leaves whose bound lets it, then every set outside the largest component found does. Any link between two
   components has such a query at one end, so none is lost, and no task sees a whole hot cell.
4. Links become components by star contraction.

Null texts and texts without words have an empty set and link with nothing, as do rows with a null doc_id (their component is null). Rows with one doc_id are one
document. Equal sets link. Other columns are ignored; an empty table gives no rows."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from wattloom.session import cut_lineage

from .common import LOWER, NO_ID, Words, block_of, buffers, chunks, grams, id_array, ids_of, mix, odd, ranges
from .components import Forest, components
from .exchange import answer, binaries, blocked, deal, from_planes, planes, send

SHINGLE, PERCENT = 5, 80
#: Groups of a count vector; fan-out of a tree; sets and shingles that one task joins.
DIMS, FAN, CELL_SETS, CELL_SHINGLES = 128, 16, 512, 2_000_000
#: Tasks that route the queries of large cells; leaves whose bounds (some 300 bytes each) may be sent to every executor.
SPREAD, SENT_LEAVES = 16, 20_000
_SEED = 31


def size_classes(largest: int, percent: int = PERCENT) -> np.ndarray:
    """Least size of each class: sets that link are in the same class or in neighbours."""
    s = [1]
    while s[-1] <= largest:
        s.append(max(s[-1] + 1, s[-1] * 100 // percent))
    return np.array([*s, max(s[-1] + 1, s[-1] * 100 // percent)])


def cuts(classes: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """For pairs whose smaller set is in a class: the most shingles in which they differ, and the number of groups."""
    most = classes[1:] - 1
    # |A| + |B| - 2 * overlap, with overlap >= p (|A| + |B|) / (100 + p) and |B| <= 100 |A| / p
    differ = most * (100 + percent) * (100 - percent) // (percent * (100 + percent))
    return differ, np.where(most < 64, 8 * (most + 1), differ + 3 + (3 * differ + 9) // 10)


class Sets:
    """Distinct shingles of some texts, ordered by text and hash. first: where each text's begin; two digests of each set."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE):
        w = Words(data, offsets)
        h, n = w.hashes(_SEED, LOWER[data]), np.diff(w.first)
        text = np.repeat(np.arange(len(n)), n)
        g = grams(h, size, 32)
        at = np.flatnonzero(text[:len(g)] == text[size - 1:]) if len(g) else np.zeros(0, np.int64)
        key, owner = [g[at]], [text[at]]
        for m in range(1, size):
            short = np.flatnonzero(n == m)
            key.append(mix((h[w.first[short][:, None] + np.arange(m)] * odd(m, 33 + m)).sum(1, dtype=np.uint64)))
            owner.append(short)
        key, owner = np.concatenate(key), np.concatenate(owner)
        o = np.lexsort((key, owner))
        key, owner = key[o], owner[o]
        new = np.r_[True, (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])] if len(key) else np.zeros(0, bool)
        self.key, self.owner = key[new], owner[new]
        self.first = np.searchsorted(self.owner, np.arange(len(n) + 1))
        self.size = np.diff(self.first)
        self.digest = [self._sums(mix(self.key ^ np.uint64(c))) for c in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]

    def _sums(self, x: np.ndarray) -> np.ndarray:
        at = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)])
        return at[self.first[1:]] - at[self.first[:-1]]

    def signatures(self, texts: np.ndarray, slot: np.ndarray, groups: np.ndarray, differ: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(signature, index into `texts`) of each filled group, and how many must be shared; where that says nothing, empty groups sign as well."""
        n = self.size[texts]
        i = np.repeat(np.arange(len(texts)), n)
        key = self.key[ranges(self.first[texts], n)]
        g = ((key >> np.uint64(32)) * groups[i].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        new = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (i[1:] != i[:-1])]) if len(g) else np.zeros(0, np.int64)
        count = np.diff(np.r_[new, len(g)])
        name = lambda i, g: mix((slot[i].astype(np.uint64) << np.uint64(40)) + g.astype(np.uint64))
        total = np.add.reduceat(mix(key + np.uint64(77)), new) if len(new) else np.zeros(0, np.uint64)
        sig, who = mix(total + name(i[new], g[new]) + count.astype(np.uint64)), i[new]
        filled = np.bincount(who, minlength=len(texts))
        need = filled - differ
        for t in np.flatnonzero(need <= 0).tolist():
            empty = np.setdiff1d(np.arange(groups[t]), g[new][who == t])
            sig, who = np.concatenate([sig, mix(name(np.full(len(empty), t), empty) ^ np.uint64(5))]), np.concatenate([who, np.full(len(empty), t)])
        return sig, who, need


def _block_signatures(t: pa.Table) -> Iterator[tuple]:
    """For each chunk: sets, rows' ids, and (signature, row in the chunk, slot side, need by row and side) over the first row of each distinct set of the chunk."""
    data, off = buffers(t["text"])
    ids = ids_of(t["doc_id"])
    for lo, hi in chunks(off):
        s = Sets(data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo])
        own = ids[lo:hi]
        # the row with the least id stands for all rows with its set
        o = np.lexsort((own, s.digest[1], s.digest[0]))
        new = np.r_[True, (s.digest[0][o][1:] != s.digest[0][o][:-1]) | (s.digest[1][o][1:] != s.digest[1][o][:-1])]
        stand = np.empty(len(o), np.int64)
        stand[o] = np.repeat(o[new], np.diff(np.r_[np.flatnonzero(new), len(o)]))
        live = np.flatnonzero((stand == np.arange(len(o))) & (s.size > 0) & (own != NO_ID))
        bounds = size_classes(int(s.size.max(initial=1)))
        differ, groups = cuts(bounds)
        cls = np.searchsorted(bounds, s.size[live], "right") - 1
        found = []
        for side in (0, 1):
            ok = cls - side >= 0
            slot = (cls - side)[ok]
            found.append((*s.signatures(live[ok], slot, groups[slot], differ[slot]), live[ok]))
        yield lo, hi, s, own, stand, found


def _emit(t: pa.Table, n: int) -> list[tuple]:
    sig, doc = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for _, _, _, own, _, found in _block_signatures(t):
        for g, who, _, live in found:
            sig.append(g)
            doc.append(own[live[who]])
    sig, doc = np.concatenate(sig), np.concatenate(doc)
    o = np.lexsort((doc, sig))
    sig, doc = sig[o], doc[o]
    new = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]]) if len(sig) else np.zeros(0, np.int64)
    block = t["block"][0].as_py()
    return [(b, block, s.tobytes(), planes(d)) for b, (s, d) in deal((sig[new] % np.uint64(n)).astype(np.int64), n, [sig[new], doc[new]])]


def _resolve(t: pa.Table) -> list[tuple]:
    """Signatures that more than one block holds, with the least document of all, told to each of these blocks."""
    sigs = [np.frombuffer(x, np.uint64) for x in binaries(t, "sig")]
    doc = np.concatenate([from_planes(x, np.int64) for x in binaries(t, "doc")])
    sig = np.concatenate(sigs)
    o = np.lexsort((doc, sig))
    new = np.flatnonzero(np.r_[True, sig[o][1:] != sig[o][:-1]])
    size = np.diff(np.r_[new, len(o)])
    least, many = np.empty(len(o), np.int64), np.empty(len(o), np.int64)
    least[o], many[o] = np.repeat(doc[o][new], size), np.repeat(size, size)
    bucket, at, out = t["bucket"][0].as_py(), 0, []
    for block, s in zip(t["block"].to_pylist(), sigs):
        m, d = many[at:at + len(s)] > 1, least[at:at + len(s)]
        at += len(s)
        if m.any():
            out.append((block, bucket, s[m].tobytes(), planes(d[m])))
    return out


def _kept_partners(live: np.ndarray, who: np.ndarray, partner: np.ndarray, need: np.ndarray) -> np.ndarray:
    """Rows and their least partners, without those that few signatures name (a common passage gives a set one or two).

    Linked sets share `need` signatures or more, each with one least partner. If each of the two passes over fewer than half of
    `need` signatures, one of those they share is left, so they stay in one cell."""
    o = np.lexsort((partner, who))
    who, partner = who[o], partner[o]
    new = np.flatnonzero(np.r_[True, (who[1:] != who[:-1]) | (partner[1:] != partner[:-1])]) if len(who) else who
    count, who, partner = np.diff(np.r_[new, len(who)]), who[new], partner[new]
    o = np.lexsort((count, who))                               # the weakest partners of each set first
    count, who, partner = count[o], who[o], partner[o]
    total = np.cumsum(count)
    first = np.searchsorted(who, np.arange(len(live)))
    before = np.concatenate([[0], total])[first]
    keep = total - before[who] > (need[who] - 1) // 2
    return np.stack([live[who[keep]], partner[keep]])


_ROWS = "doc_id long, n long, d1 long, d2 long, stand long, goes_on boolean, partners array<long>"


def _judge(t: pa.Table, a: pa.Table) -> pa.Table:
    """Each row's set size and digests, the row of the block that stands for it, and, if it goes on, the least partner by each shared signature."""
    known = np.concatenate([np.zeros(0, np.uint64), *[np.frombuffer(x, np.uint64) for x in binaries(a, "sig")]]) if a.num_rows else np.zeros(0, np.uint64)
    least = np.concatenate([from_planes(x, np.int64) for x in binaries(a, "doc")]) if a.num_rows else np.zeros(0, np.int64)
    o = np.argsort(known, kind="stable")
    known, least = known[o], least[o]
    parts = list(_block_signatures(t))
    every = [(p, side, *p[5][side]) for p in parts for side in (0, 1)]
    sig = np.concatenate([np.zeros(0, np.uint64), *[x[2] for x in every]])
    doc = np.concatenate([np.zeros(0, np.int64), *[x[0][3][x[5][x[3]]] for x in every]])
    # inside the block: signatures of two documents, and the least of them
    o = np.lexsort((doc, sig))
    new = np.flatnonzero(np.r_[True, sig[o][1:] != sig[o][:-1]]) if len(o) else o
    local = np.empty(len(o), np.int64)
    local[o] = np.repeat(doc[o][new], np.diff(np.r_[new, len(o)])) if len(o) else doc
    most = np.empty(len(o), np.int64)
    most[o] = np.repeat(doc[o][np.r_[new[1:] - 1, len(o) - 1]], np.diff(np.r_[new, len(o)])) if len(o) else doc
    shared = local < most
    partner = local
    if len(known):
        i = np.searchsorted(known, sig).clip(max=len(known) - 1)
        far = known[i] == sig
        shared, partner = shared | far, np.where(far, np.minimum(least[i], local), local)
    cols, at = [], 0
    for p in parts:
        lo, hi, s, own, stand, found = p
        rows, goes = [], np.zeros(hi - lo, bool)
        for sig_, who, need, live in found:
            here = slice(at, at + len(sig_))
            at += len(sig_)
            ok = np.bincount(who, shared[here], len(live)) >= need
            goes[live[ok]] = True
            use = np.flatnonzero(shared[here] & ok[who])
            rows.append(_kept_partners(live, who[use], partner[here][use], need))
        pairs = np.unique(np.concatenate(rows, 1), axis=1)
        cut = np.searchsorted(pairs[0], np.arange(hi - lo + 1))
        partners = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(pairs[1], pa.int64()))
        cols.append(pa.table({"doc_id": id_array(own), "n": pa.array(s.size, pa.int64()), "d1": pa.array(s.digest[0].view(np.int64)), "d2": pa.array(s.digest[1].view(np.int64)),
                              "stand": id_array(own[stand]), "goes_on": pa.array(goes), "partners": partners}))
    return pa.concat_tables(cols)


_SET_ROWS = "cell long, family long, doc_id long, n long, point binary, set array<long>"


def _sets_of(t: pa.Table, a: pa.Table) -> pa.Table:
    """Set and point of each document asked for."""
    names = ["cell", "family", "doc_id", "n", "point", "set"]
    kinds = [pa.int64()] * 4 + [pa.binary(), pa.list_(pa.int64())]
    out = [pa.table([pa.array([], k) for k in kinds], names)]
    if a.num_rows and t.num_rows:
        a = a.sort_by("doc_id")
        want, cell, family = (a[c].to_numpy() for c in ("doc_id", "cell", "family"))
        data, off = buffers(t["text"])
        ids = ids_of(t["doc_id"])
        for lo, hi in chunks(off):
            i = np.searchsorted(want, ids[lo:hi]).clip(max=len(want) - 1)
            hit = np.flatnonzero(want[i] == ids[lo:hi])
            if not len(hit):
                continue
            s = Sets(data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo])
            n, i = s.size[hit], i[hit]
            p = Point(s.key[ranges(s.first[hit], n)], n)
            sets = pa.ListArray.from_arrays(pa.array(p.first, pa.int32()), pa.array(p.key.view(np.int64)))
            out.append(pa.table([pa.array(cell[i]), pa.array(family[i]), pa.array(want[i]), pa.array(n), pa.array([c.tobytes() for c in p.count.astype(np.uint32)], pa.binary()), sets], names))
    return pa.concat_tables(out)


class Point:
    """Sets of one task, their shingles one after the other, and their counts by group."""

    def __init__(self, key: np.ndarray, size: np.ndarray):
        self.key, self.size = key, size
        self.first = np.concatenate([[0], np.cumsum(size)])
        owner = np.repeat(np.arange(len(size)), size)
        group = (mix(key + np.uint64(13)) % np.uint64(DIMS)).astype(np.int64)
        self.count = np.bincount(owner * DIMS + group, minlength=len(size) * DIMS).reshape(len(size), DIMS).astype(np.int32)

    @classmethod
    def of(cls, sets: pa.ChunkedArray, size: np.ndarray) -> "Point":
        flat = pa.concat_arrays([c.flatten() for c in sets.chunks]) if sets.num_chunks else pa.array([], pa.int64())
        return cls(flat.to_numpy().view(np.uint64), size)


def points(col) -> np.ndarray:
    """Count vectors from their bytes, a row each."""
    return np.frombuffer(b"".join(col.to_pylist()), np.uint32).reshape(-1, DIMS).astype(np.int32)


def needed(n: np.ndarray | int, m: np.ndarray | int) -> np.ndarray:
    """Least overlap of linked sets of sizes n and m."""
    return -(-PERCENT * (n + m) // (100 + PERCENT))


class CountTree:
    """R-tree over count vectors, packed in an order that keeps like points together; each node keeps the largest count of each group and its range of sizes."""

    def __init__(self, count: np.ndarray, size: np.ndarray):
        spread = np.argsort(-count.var(0), kind="stable")[:3] if len(count) else []
        self.order = np.lexsort((*[count[:, g] for g in spread[::-1]], size // 8)) if len(count) else np.zeros(0, np.int64)
        self.count, self.size = count[self.order], size[self.order]
        self.levels = []                                       # from leaves up: largest counts, least and largest size
        top, lo, hi = self.count, self.size, self.size
        while len(top) > 1:
            at = np.arange(0, len(top), FAN)
            top, lo, hi = np.maximum.reduceat(top, at, axis=0), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at)
            self.levels.append((top, lo, hi))

    def search(self, count: np.ndarray, size: int) -> np.ndarray:
        """Points whose overlap with the query may suffice: descends the nodes whose summed minima reach what a set of their sizes needs."""
        nodes = np.arange(len(self.levels[-1][0])) if self.levels else np.arange(len(self.order))
        for top, lo, hi in [*self.levels[::-1], (self.count, self.size, self.size)]:
            nodes = nodes[nodes < len(top)]
            fits = (lo[nodes] * PERCENT <= size * 100) & (size * PERCENT <= hi[nodes] * 100)
            nodes = nodes[fits]
            bound = np.minimum(top[nodes], count).sum(1)
            nodes = nodes[bound >= needed(size, np.maximum(lo[nodes], -(-PERCENT * size // 100)))]
            if top is not self.count:
                nodes = (nodes[:, None] * FAN + np.arange(FAN)).ravel()
        return self.order[nodes]


def overlaps(points: Point, query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Size of the intersection of the query's sorted shingles with each row's."""
    n = points.size[rows]
    key = points.key[ranges(points.first[rows], n)]
    hit = query[np.searchsorted(query, key).clip(max=len(query) - 1)] == key
    at = np.concatenate([[0], np.cumsum(hit)])
    stop = np.cumsum(n)
    return at[stop] - at[stop - n]


def join_cell(docs: np.ndarray, points: Point) -> list[tuple[int, int]]:
    """Links enough to connect all sets of a cell that are connected. Stops when all sets that were no query yet are in one component."""
    n, out = len(docs), []
    tree, forest = CountTree(points.count, points.size), Forest(n)
    asked, waiting = np.zeros(n, bool), list(range(n - 1, -1, -1))
    while waiting:
        q = waiting.pop()
        asked[q] = True
        rows = tree.search(points.count[q], int(points.size[q]))
        root = forest.root(q)
        rows = rows[[r != q and forest.root(r) != root for r in rows.tolist()]] if len(rows) else rows
        if len(rows):
            both = overlaps(points, points.key[points.first[q]:points.first[q + 1]], rows)
            for r in rows[100 * both >= PERCENT * (points.size[q] + points.size[rows] - both)].tolist():
                if forest.join(q, r):
                    out.append((int(docs[q]), int(docs[r])))
        left = {forest.root(w) for w in waiting}
        if len(left) <= 1:
            break
    return out


def _small(key, t):
    links, t = [], t.sort_by([("cell", "ascending"), ("doc_id", "ascending")])
    cell, docs, size = t["cell"].to_numpy(), t["doc_id"].to_numpy(), t["n"].to_numpy()
    cut = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1], True])
    for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist()):
        links += join_cell(docs[lo:hi], Point.of(t["set"].slice(lo, hi - lo), size[lo:hi]))
    a, b = zip(*links) if links else ((), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _bounds(key, t):
    """What a leaf tells its queries: largest counts and range of sizes."""
    n = t["n"].to_numpy()
    return pa.table({"cell": pa.array([key[0].as_py()], pa.int64()), "leaf": pa.array([key[1].as_py()], pa.int64()), "top": pa.array([points(t["point"]).max(0).astype(np.uint32).tobytes()], pa.binary()),
                     "lo": pa.array([int(n.min())], pa.int64()), "hi": pa.array([int(n.max())], pa.int64())})


_QUERY = ["cell", "leaf", "copy", "doc_id", "n", "point", "component"]


def _route(batches):
    """Keeps the (query, leaf) rows whose bound lets the query in."""
    for b in batches:
        if b.num_rows:
            n, lo, hi = (b.column(c).to_numpy() for c in ("n", "lo", "hi"))
            ok = (lo * PERCENT <= n * 100) & (n * PERCENT <= hi * 100)
            ok &= np.minimum(points(b.column("top")), points(b.column("point"))).sum(1) >= needed(n, np.maximum(lo, -(-PERCENT * n // 100)))
            yield b.filter(pa.array(ok)).select(_QUERY)


def _leaf(key, t, q):
    """Pairs of a query and a member of another component that their points let overlap enough."""
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    if t.num_rows and q.num_rows:
        docs, own = t["doc_id"].to_numpy(), t["component"].to_numpy()
        tree = CountTree(points(t["point"]), t["n"].to_numpy())
        for doc, n, count, component in zip(q["doc_id"].to_pylist(), q["n"].to_pylist(), points(q["point"]), q["component"].to_pylist()):
            rows = tree.search(count, n)
            hit = docs[rows[(own[rows] != component)]]
            a.append(np.full(len(hit), doc))
            b.append(hit)
    return pa.table({"a": pa.array(np.concatenate(a)), "b": pa.array(np.concatenate(b))})


def _ask(leaves: DataFrame, bounds: DataFrame, queries: DataFrame, sets: DataFrame) -> DataFrame:
    """Links of the queries with members of other components. Points alone travel to the leaves; where a cell has many queries, they are dealt to several copies of its leaves.
    The pairs that are left are verified on the sets, each pair for itself."""
    copies = queries.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(4 * CELL_SETS)).cast("int").alias("copies"))
    dealt = leaves.join(copies, "cell").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).select(*_QUERY)
    spread = queries.select("cell", "doc_id", "n", "point", "component").repartition(4 * SPREAD, "doc_id").join(copies, "cell").withColumn("copy", F.pmod(F.xxhash64("doc_id", F.lit("copy")), F.col("copies")).cast("int")).drop("copies")
    routed = spread.join(F.broadcast(bounds) if bounds.count() <= SENT_LEAVES else bounds, "cell").select(*_QUERY, "top", "lo", "hi").mapInArrow(_route, "cell long, leaf long, copy int, doc_id long, n long, point binary, component long")
    by = ["cell", "leaf", "copy"]
    pairs = cut_lineage(dealt.groupBy(*by).cogroup(routed.groupBy(*by)).applyInArrow(_leaf, "a long, b long"))
    side = lambda x: sets.select(F.col("doc_id").alias(x), F.col("n").alias(f"n_{x}"), F.col("set").alias(f"set_{x}"))
    both = F.size(F.array_intersect("set_a", "set_b"))
    found = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("both", both)
    return cut_lineage(found.filter(F.col("both") * 100 >= PERCENT * (F.col("n_a") + F.col("n_b") - F.col("both"))).select("a", "b"))


def _large(sets: DataFrame) -> DataFrame:
    """Links of the cells that are too large for a task."""
    whole = sets.groupBy("cell").agg(F.count("*").alias("cell_sets"))
    size = sets.groupBy("cell", "family").agg(F.count("*").alias("family_sets"), F.min("doc_id").alias("head")).join(whole, "cell")
    # a large family is cut to leaves of its own, small ones share leaves
    part = lambda n: F.greatest(F.lit(1), F.ceil(F.col(n) / F.lit(CELL_SETS // 2)))
    own = F.xxhash64("family", F.pmod(F.xxhash64("doc_id", F.lit("leaf")), part("family_sets")))
    leaf = F.when(part("family_sets") > 1, own).otherwise(F.pmod(F.xxhash64("family", F.lit("leaf")), part("cell_sets")))
    leaves = cut_lineage(sets.drop("set").join(size, ["cell", "family"]).withColumn("leaf", leaf).withColumn("component", F.col("doc_id")))
    bounds = cut_lineage(leaves.groupBy("cell", "leaf").applyInArrow(_bounds, "cell long, leaf long, top binary, lo long, hi long"))
    first = _ask(leaves, bounds, leaves.filter("doc_id = head"), sets)
    found = leaves.drop("component").join(components(first).withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    found = cut_lineage(found)
    largest = found.groupBy("cell", "component").agg(F.count("*").alias("k")).groupBy("cell").agg(F.max_by("component", F.struct("k", "component")).alias("component"))
    rest = found.filter("doc_id <> head").join(largest, ["cell", "component"], "left_anti")
    return first.unionByName(_ask(found, bounds, rest, sets))


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id (least doc_id reachable over links, itself included) of each row."""
    table, n = blocked(docs)
    told = answer(send(table, lambda t: _emit(t, n), ["sig", "doc"]), _resolve, ["sig", "doc"])
    rows = cut_lineage(table.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_judge, _ROWS))
    on = rows.filter("goes_on AND doc_id IS NOT NULL")
    near = on.select(F.col("doc_id").alias("a"), F.explode("partners").alias("b"))
    cells = components(near).withColumnRenamed("id", "doc_id").withColumnRenamed("component", "cell")
    # of several rows with one set, one is enough from here on: equal sets link
    equal = rows.filter("n > 0 AND doc_id IS NOT NULL").groupBy("d1", "d2").agg(F.min("doc_id").alias("b"))
    copies = rows.filter("n > 0 AND doc_id IS NOT NULL").join(equal, ["d1", "d2"]).filter("doc_id <> b").select(F.col("doc_id").alias("a"), "b")
    member = (on.join(equal.withColumnRenamed("b", "doc_id"), ["d1", "d2", "doc_id"], "left_semi").select("doc_id", "n", F.array_min("partners").alias("family"))
              .join(cells, "doc_id"))
    sized = member.groupBy("cell").agg(F.count("*").alias("sets"), F.sum("n").alias("shingles")).filter("sets > 1")
    member = cut_lineage(member.join(sized, "cell").withColumn("large", (F.col("sets") > CELL_SETS) | (F.col("shingles") > CELL_SHINGLES)))
    asked = member.select("doc_id", "cell", F.coalesce("family", "doc_id").alias("family"), block_of(n, "doc_id").alias("block"))
    sets = cut_lineage(table.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(_sets_of, _SET_ROWS))
    large = member.filter("large").select("cell").distinct()
    tasks = max(16, (member.filter("not large").agg(F.sum("n")).first()[0] or 0) // CELL_SHINGLES)
    small = sets.join(large, "cell", "left_anti").withColumn("_task", F.pmod(F.xxhash64("cell"), F.lit(tasks)))
    links = small.groupBy("_task").applyInArrow(_small, "a long, b long").unionByName(copies)
    if large.take(1):
        links = links.unionByName(_large(sets.join(large, "cell", "left_semi")))
    whole = components(links).withColumnRenamed("id", "doc_id").withColumnRenamed("component", "component_id")
    return rows.join(whole, "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_first(docs: DataFrame) -> DataFrame:
    """All columns of the rows that stand for their component: of each group of linked documents the one with the least doc_id stays, with all its rows; rows with a null doc_id stay."""
    gone = join(docs).filter("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, F.col("doc_id").cast("long") == F.col("_gone"), "left_anti")
