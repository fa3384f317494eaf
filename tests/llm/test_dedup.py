"""Substring, suffix and shingle operators against brute force, on every edge case at once."""
import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from wattloom.llm import shingle_join, substring_dedup, suffix_dedup
from wattloom.llm.common import slide

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BIG = 1 << 62


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def brute_substring(corpus, k):
    first = {}
    split = [(i, WORD.findall(t or "")) for i, t in corpus]
    for i, w in split:
        for j in range(len(w) - k + 1):
            g = tuple(w[j:j + k])
            first[g] = min(first.get(g, BIG), BIG if i is None else i)
    out = []
    for i, w in split:
        gone = [False] * len(w)
        for j in range(len(w) - k + 1):
            if first[tuple(w[j:j + k])] < (BIG if i is None else i):
                gone[j:j + k] = [True] * k
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out, key=repr)


def test_substring(docs, corpus):
    want = brute_substring(corpus, 13)
    assert sum(r[2] for r in want) > 1000
    assert rows_of(substring_dedup.dedup(docs)) == want


def test_substring_small_window(docs, corpus):
    assert rows_of(substring_dedup.dedup(docs, window=4)) == brute_substring(corpus, 4)


def test_rows_of_one_id_keep_their_own_words(spark):
    """Rows without an id, and rows that repeat one with another text, as documents and as sources."""
    w = lambda tag, n: " ".join(f"{tag}{i}" for i in range(n))
    passage, middle = w("p", 30), w("m", 12)
    rows = [(1, passage), (None, f"{w('a', 5)} {passage} {w('b', 20)}"), (None, w("c", 60)), (None, w("c", 60)), (7, f"{passage} {w('d', 9)}"), (7, w("e", 50)), (7, f"{w('f', 40)} {passage}"), (7, None),
            (2, f"za {middle} ya"), (2, f"zb {middle} yb"), (9, f"zb {middle} ya {w('g', 5)}"), (8, f"za {middle} yb {w('h', 5)}")]
    for part in (rows, rows[::-1]):
        got = rows_of(substring_dedup.dedup(spark.createDataFrame(part, "doc_id long, text string").repartition(3)))
        assert got == brute_substring(rows, 13)


def test_paths_join_end_to_end(spark):
    pieces = spark.createDataFrame([(9, 0, 3, 1, 10, 5), (9, 3, 2, 1, 13, 6), (9, 5, 1, 2, 0, 7), (9, 8, 2, 1, 18, 8), (8, 3, 2, 1, 13, 9)], "doc_id long, start long, n long, src_doc long, src_start long, digest long")
    got = sorted((r.doc_id, r.start, r.n, r.src_doc, r.src_start, int(r.digest)) for r in substring_dedup.compact(pieces).collect())
    assert got == [(8, 3, 2, 1, 13, 9), (9, 0, 5, 1, 10, 11), (9, 5, 1, 2, 0, 7), (9, 8, 2, 1, 18, 8)]


def brute_suffix(corpus, k):
    texts = [(i, (t or "").encode()) for i, t in corpus]
    seen = Counter(b[j:j + k] for _, b in texts for j in range(len(b) - k + 1))
    out = []
    for i, b in texts:
        gone = np.zeros(len(b), bool)
        for j in range(len(b) - k + 1):
            if seen[b[j:j + k]] > 1:
                gone[j:j + k] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((i, len(b), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("hot", [4096, 3])
def test_suffix(docs, corpus, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    want = brute_suffix(corpus, 400)
    assert sum(r[2] for r in want) > 5000
    assert rows_of(suffix_dedup.dedup(docs, with_bytes=False)) == want


def test_suffix_sections(docs, corpus, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SECTION", 1000)       # long texts fall into overlapping sections
    assert rows_of(suffix_dedup.dedup(docs, with_bytes=False)) == brute_suffix(corpus, 400)


def test_suffix_short_blocks(spark):
    """Rows of one id share a block: blocks of short and empty texts alone hold no string, and the others lose nothing by them."""
    long = "".join(chr(97 + i * i % 23) for i in range(900))
    rows = [(1, "short"), (1, ""), (2, ""), (3, None), (4, "x" * 31), (5, "y" * 32), (6, "z" * 398), (7, "z" * 399), (8, long), (9, "- " + long[100:700]), (10, "z" * 400)]
    got = rows_of(suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), with_bytes=False))
    assert got == brute_suffix(rows, 400)
    assert rows_of(suffix_dedup.dedup(spark.createDataFrame(rows[:7], "doc_id long, text string"), with_bytes=False)) == brute_suffix(rows[:7], 400)


def test_suffix_limits_reach_the_workers(spark):
    """A limit that the tasks don't get would leave the section whole and the minimizer unsplit."""
    import pyarrow as pa
    t = pa.table({"text": ["q" * 3000]})
    assert [len(p.data) for p in suffix_dedup._parts(t, 400, 1000)] == [1399, 1399, 1000]
    rng = np.random.default_rng(8)
    base = "".join(map(chr, rng.integers(97, 101, 2600)))
    rows = [(i, base[100 * i:100 * i + 1500]) for i in range(8)] + [(8, base + "tail"), (8, "a")]
    got = rows_of(suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), with_bytes=False, hot=2, section=1000))
    assert got == brute_suffix(rows, 400)


def test_difference_cover():
    c, m = suffix_dedup.COVER, suffix_dedup.MODULUS
    assert {(a - b) % m for a in c for b in c} == set(range(m))
    for a in range(m):
        for b in range(m):
            d = suffix_dedup.OFFSET[a, b]
            assert (a + d) % m in c and (b + d) % m in c


@pytest.mark.parametrize("slice_", [1 << 20, 97])
def test_equal_strings(monkeypatch, slice_):
    monkeypatch.setattr(suffix_dedup, "SLICE", slice_)
    rng = np.random.default_rng(1)
    base = rng.integers(97, 99, 2000).astype(np.uint8)
    parts = [base[a:a + 450].copy() for a in rng.integers(0, 1500, 30)] + [np.full(700, 97, np.uint8)]
    for p in parts[:15]:
        p[rng.integers(len(p))] = 99
    data = np.concatenate(parts)
    starts = np.concatenate([o + np.arange(len(p) - 399) for p, o in zip(parts, np.cumsum([0, *map(len, parts)]))])
    cls, by = suffix_dedup.equal_strings(data, starts), defaultdict(set)
    for s, c in zip(starts, cls):
        by[data[s:s + 400].tobytes()].add(c)
    assert all(len(v) == 1 for v in by.values()) and len(set(cls)) == len(by)


def shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    return frozenset(tuple(w[j:j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(corpus):
    sets, up = [(i, shingles(t)) for i, t in corpus], {i: i for i, _ in corpus}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i
    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if a and b and i is not None and j is not None and 100 * len(a & b) >= 80 * len(a | b):
                p, q = root(i), root(j)
                up[max(p, q)] = min(p, q)
    return sorted(((i, len(s), None if i is None else root(i)) for i, s in sets), key=repr)


@pytest.mark.parametrize("cell", [512, 8])
def test_shingle_join(docs, corpus, monkeypatch, cell):
    monkeypatch.setattr(shingle_join, "CELL_SETS", cell)     # 8: the hot group is cut to leaves
    want = brute_components(corpus)
    assert len({r[2] for r in want}) < len(want) - 40
    assert rows_of(shingle_join.join(docs)) == want


def test_keep_first(docs, corpus):
    kept = shingle_join.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted((i for i, _, c in brute_components(corpus) if i == c), key=repr)


def test_count_tree_loses_nothing():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 60, 300).astype(np.uint64)
    sets = []
    for _ in range(300):
        s = base[rng.random(300) < rng.choice([0.3, 0.85, 0.95])]
        sets.append(np.sort(np.concatenate([s, rng.integers(0, 1 << 60, rng.integers(0, 40)).astype(np.uint64)])).tobytes())
    p = shingle_join.Point(np.frombuffer(b"".join(sets), np.uint64), np.array([len(x) // 8 for x in sets]))
    tree = shingle_join.CountTree(p.count, p.size)
    real = [set(np.frombuffer(x, np.uint64).tolist()) for x in sets]
    pruned = 0
    for q in range(0, 300, 7):
        found = set(tree.search(p.count[q], int(p.size[q])).tolist())
        pruned += 300 - len(found)
        assert {r for r in range(300) if 100 * len(real[q] & real[r]) >= 80 * len(real[q] | real[r])} <= found
    assert pruned > 0


def test_signatures_differ_bound():
    """No two sets that may link differ in more shingles than the class says."""
    bounds = shingle_join.size_classes(600)
    differ, groups = shingle_join.cuts(bounds)
    for a in range(1, 400):
        c = int(np.searchsorted(bounds, a, "right")) - 1
        b = np.arange(a, a * 100 // 80 + 1)
        assert (np.searchsorted(bounds, b, "right") - 1 <= c + 1).all()
        assert ((a + b) - 2 * -(-80 * (a + b) // 180)).max() <= differ[c] < groups[c]


def test_empty_tables(no_docs):
    for f in (substring_dedup.dedup, suffix_dedup.dedup, shingle_join.join, shingle_join.keep_first):
        assert f(no_docs).count() == 0


def test_slide():
    x = np.array([5, 3, 8, 1, 9, 2, 7])
    for w in range(1, 8):
        assert slide(x, w).tolist() == [min(x[i:i + w]) for i in range(len(x) - w + 1)]
