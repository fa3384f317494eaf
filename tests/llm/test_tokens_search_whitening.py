"""Byte-level BPE against tiktoken, lexical search against plain scoring, whitening against numpy."""
import base64
import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattloom.llm import bpe, lexical, whitening


# ------------------------------------------------------------------ byte-level BPE
@pytest.fixture(scope="module")
def reference():
    import public_tokenizers as P
    import tiktoken
    with open(P.path(bpe.RANKS), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoded(e, texts):
    ids, off = e.encode(texts)
    return [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:])]


def test_words_and_merges_equal_the_library(reference):
    rng = random.Random(3)
    near = ["".join(rng.choice(["a", "b", "t", "h", "e", "in", "the", "ing", " ", "'s", "'", "1", "é", "  ", "\n"]) for _ in range(rng.randrange(80))) for _ in range(3000)]
    odd = ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xA0, 0x3000), rng.randrange(0x10000, 0x20000), 9, 10, 0x1C, 0x85, 0xA0])) for _ in range(40)) for _ in range(1000)]
    every = ["".join(chr(c) for c in range(a, a + 256) if not 0xD800 <= c < 0xE000) for a in range(0, 0x110000, 4096)]
    edges = [None, "", " ", "a", "x" * 3000, "ab " * 2000, " " * 999, "\n\n  x", "the the  the", "<|endoftext|>", "We'LL we'll"]
    whole, many = bpe.Encoder(bpe.vocabulary(bpe.RANKS)), bpe.Encoder(bpe.vocabulary(bpe.RANKS), most=50)
    for texts in (near, odd, every, edges):
        expected = [reference.encode_ordinary(t or "") for t in texts]
        assert encoded(whole, texts) == expected                              # replayed all at once
        assert [x for t in texts[:300] for x in encoded(many, [t])] == expected[:300]      # a text at a time: in order, words forgotten


def test_both_replays_agree_on_repeats():
    v = bpe.vocabulary(bpe.RANKS)
    rng = random.Random(5)
    parts = ["the", "ing", "in", "th", "er", "aa", "a", "  ", "ab", "xyz"]
    words = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 12))).encode() for _ in range(4000)] + [b"aaaaaaa", b"x" * 777]
    assert [np.frombuffer(x, np.int32).tolist() for x in bpe.replay(words, v)] == bpe.replay_in_order(words, v)
    assert bpe.replay([], v) == [] and bpe.replay_in_order([], v) == []


def test_a_text_longer_than_a_section(monkeypatch, reference):
    monkeypatch.setattr(bpe, "SECTION", 50)
    monkeypatch.setattr(bpe.sections, "__defaults__", (50,))
    texts = ["some words, and numbers 12 " * 40, "é" * 200 + " x" * 99, "short"]
    assert encoded(bpe.Encoder(bpe.vocabulary(bpe.RANKS)), texts) == [reference.encode_ordinary(t) for t in texts]


def test_digests_of_all_rows(docs, corpus, no_docs, reference):
    def row(i, t):
        ids = reference.encode_ordinary(t or "")
        return i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()
    assert sorted(map(tuple, bpe.digest(docs).collect()), key=repr) == sorted((row(i, t) for i, t in corpus), key=repr)
    assert bpe.digest(no_docs).count() == 0 and bpe.digest(no_docs).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_decoding_alone(spark):
    d = spark.createDataFrame([(1, [1169, 262], "x"), (2, [], None), (3, None, "y")], "k long, ids array<int>, decoded string")
    assert {r.k: bytes(r.decoded) for r in bpe.decode(d).collect()} == {1: b"the the", 2: b"", 3: b""}


# ------------------------------------------------------------------ lexical search
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def ranked(rows, items, k=10):
    counts = [Counter(terms(t)) for _, t in rows]
    n_docs, length = sum(map(bool, counts)), sum(c.total() for c in counts)
    df = Counter(t for c in counts for t in c)
    out = []
    for item, text in items:
        scores = []
        for (doc, _), c in zip(rows, counts):
            m = 25 + (75 * c.total() * n_docs) // max(length, 1)
            s = sum(reps * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t, reps in Counter(terms(text)).items() if t in c)
            if s > 0:
                scores.append((-s, doc is None, doc or 0, doc))
        out += [(item, i + 1, d, -s) for i, (s, _, _, d) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def test_terms():
    for t in ["", None, "Ab-c İÉé_1x\x00y ÄB", "  ", "漢字 x²", "A" * 50, "a\x85b\xa0c"]:
        assert {k.decode(): n for k, n in lexical.term_counts(t).items()} == Counter(terms(t))


def test_long_texts_are_counted_by_section(monkeypatch):
    monkeypatch.setattr(lexical, "SECTION", 7)
    t = "one two three, abcdefghijkl one x " * 30
    assert {k.decode(): n for k, n in lexical.term_counts(t).items()} == Counter(terms(t))


@pytest.mark.parametrize("postings", [500_000, 40])
def test_search_equals_plain_scoring(spark, docs, corpus, no_docs, monkeypatch, postings):
    monkeypatch.setattr(lexical, "PART_POSTINGS", postings)
    monkeypatch.setattr(lexical, "ITEMS", 3)
    rng = random.Random(2)
    items = [(i, " ".join(rng.choice(rng.choice(corpus)[1] and terms(rng.choice([t for _, t in corpus if t]))[:80] or ["of"]) for _ in range(rng.randint(1, 25)))) for i in range(12)]
    items += [(20, None), (21, ""), (22, "unheardof"), (23, "the the of"), (None, "a b c"), (3, "q"), (3, "q"), (24, "é Ü zz")]
    queries = spark.createDataFrame([(*x, 1, "y") for x in items], "item_id long, text string, rank int, term string").repartition(2)
    got = sorted(map(tuple, lexical.search(docs, queries).collect()), key=repr)
    assert got == ranked(corpus, items) and len(got) > 100
    if postings == 40:
        assert lexical.search(no_docs, queries).count() == 0 and lexical.search(docs, queries.limit(0)).count() == 0


def test_ties_a_hot_term_and_null_ids(spark):
    rows = [(None if i % 3 == 0 else i, "common " + ("rare " if i % 50 == 0 else "") + "filler " * (i % 4)) for i in range(900)] + [(7, "common"), (7, "common")]
    items = [(1, "common rare"), (2, "common"), (3, "filler rare rare")]
    got = lexical.search(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=repr) == ranked(rows, items)


def test_accumulators_stop_and_scores_stay_exact():
    rng = np.random.default_rng(1)
    for _ in range(60):
        n, lists = 400, []
        for size in sorted(rng.integers(1, 400, 8).tolist()):
            lists.append(rng.choice(n, size, replace=False))
        row = np.concatenate(lists)
        term = np.repeat(np.arange(8), [len(x) for x in lists])
        gain = rng.integers(1, 30, len(row)) * (8 - term) ** 2
        part, reps = lexical.Part(row + 1000, row * 2, term, gain), rng.integers(1, 3, 8).tolist()
        top, score = part.first(list(range(8)), reps, 5)
        whole = np.zeros(n, np.int64)
        np.add.at(whole, row, gain * np.array(reps)[term])
        best = sorted((-s, 2 * d) for d, s in enumerate(whole.tolist()) if s)[:5]
        assert [(-s, d) for s, d in zip(score.tolist(), part.doc_id[top].tolist())] == best


# ------------------------------------------------------------------ whitening
def against_svd(x, k=8):
    r = np.linalg.qr(x, mode="r")
    r = np.vstack([r, np.zeros((max(0, x.shape[1] - len(r)), x.shape[1]))])
    e, v = whitening.right_vectors(r, k)
    s = np.r_[np.linalg.svd(x, compute_uv=False) ** 2, np.zeros(x.shape[1])][:len(e)]
    top = max(s[0], 1e-300)
    assert np.abs(e - s).max() <= 1e-13 * top and np.abs(x.T @ (x @ v) - v * e).max() <= 1e-12 * top and np.abs(v.T @ v - np.eye(len(e))).max() <= 1e-11


def test_solver_on_hard_triangles():
    rng = np.random.default_rng(0)
    q = np.linalg.qr(rng.standard_normal((120, 40)))[0]
    turn = np.linalg.qr(rng.standard_normal((40, 40)))[0]
    zero = rng.standard_normal((50, 12))
    zero[:, [2, 7]] = 0
    for x in [rng.standard_normal((90, d)) for d in (1, 2, 3, 40)] + [np.eye(20), np.zeros((5, 4)), zero, rng.standard_normal((4, 9)), q @ np.diag([5] * 3 + [2] * 2 + [1] * 35) @ turn,
              q @ np.diag(1 + 1e-9 * np.arange(40)), np.diag(10.0 ** -np.arange(18)), np.repeat(rng.standard_normal((30, 5)), 3, axis=1), np.kron(np.eye(3), np.triu(np.tril(np.ones((15, 15)), 1)))]:
        against_svd(x)


def test_small_singular_values_are_accurate():
    b = np.diag(10.0 ** -np.arange(12)) + np.diag(10.0 ** -np.arange(11.0) * 0.3, 1)
    got = np.array(whitening.dqds((np.diag(b) ** 2).tolist(), (np.diag(b, 1) ** 2).tolist()))
    inverse = np.linalg.inv(b)                                                # small values are the large ones of the inverse
    assert np.prod(got) == pytest.approx(np.prod(np.diag(b) ** 2), rel=1e-12) and got[-1] == pytest.approx(1 / np.linalg.norm(inverse, 2) ** 2, rel=1e-9)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "a", 1, 0.5) for i, v in rows], "vec_id long, embedding array<float>, label string, n long, w double").repartition(4)


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(4)
    base = (rng.standard_normal((400, 12)) @ np.diag([3, 2, 1.5, 1.2, 1, 0.8, 0.6, 0.5, 0.3, 0.2, 0.1, 0.05]) + rng.standard_normal(12)).astype(np.float32)
    base[:150] = base[0]                                                      # a third are one vector
    return [(None if i % 3 == 0 else i, v.tolist()) for i, v in enumerate(base)]


def test_whitening_equals_numpy(spark, vectors):
    rows = vectors + [(901, None), (902, []), (903, [None] + [1.0] * 11), (904, [float("nan")] * 12), (905, [float("inf")] * 12), (906, [1e30] * 12), (7, vectors[0][1]), (7, vectors[0][1])]
    kept = [v for i, v in rows[:-8]] + [v for i, v in rows[-2:]]
    x = np.floor(1024 * np.array(kept, np.float32).astype(float)).astype(np.int64) + 100000
    n, dev = len(x), len(x) * x - x.sum(0)
    cov = (dev / n).T @ (dev / n) / n
    e = np.linalg.eigvalsh(cov)[::-1]
    got = whitening.whiten(frame(spark, rows)).collect()
    assert len(got) == 8 * n and Counter(r.deviation for r in got) == Counter(np.repeat((dev * dev).sum(1), 8).tolist()) and {r.n for r in got} == {n}
    w = np.array([[r.whitened for r in sorted(got, key=lambda r: (r.component, r.deviation, r.vec_id is None, r.vec_id or 0)) if r.component == k] for k in range(1, 9)])
    assert np.abs(w @ w.T / n - np.eye(8)).max() < 1e-10 and max(r.identity_error for r in got) < 1e-10
    assert all(r.explained == pytest.approx(e[r.component - 1] / e.sum(), rel=1e-12) for r in got)
    by_dev = {d: c for d, c in zip((dev * dev).sum(1).tolist(), dev / n)}
    v = np.linalg.eigh(cov)[1][:, ::-1]
    for k in (1, 8):
        pairs = np.array([(r.whitened, by_dev[r.deviation] @ v[:, k - 1] / math.sqrt(e[k - 1])) for r in got if r.component == k])
        assert min(np.abs(pairs[:, 0] - pairs[:, 1]).max(), np.abs(pairs[:, 0] + pairs[:, 1]).max()) < 1e-9


def test_whitening_of_odd_tables(spark, vectors):
    assert whitening.whiten(frame(spark, vectors).limit(0)).count() == 0
    one = whitening.whiten(frame(spark, [(1, [0.5, 0.25])])).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained) for r in sorted(one)] == [(1, 1, 0, None, None), (2, 1, 0, None, None)]
    flat = whitening.whiten(frame(spark, [(i, [float(i % 5), 1.0, float(i % 5)]) for i in range(50)])).collect()
    assert {r.component for r in flat if r.whitened is not None} == {1} and flat[0].identity_error < 1e-12
    mixed = whitening.whiten(frame(spark, vectors + [(5000 + i, [float(i), float(i * i % 7)]) for i in range(20)])).groupBy("n").agg(F.count("*").alias("rows")).collect()
    assert {(r.n, r["rows"]) for r in mixed} == {(400, 3200), (20, 40)}


def test_deviations_beyond_64_bits():
    x = np.array([[1 << 52, 5], [3, 1 << 40]])
    exact = [[int(a) * (1 << 20) - s for a, s in zip(row, (7, 9))] for row in x]
    assert whitening.deviations(x, 1 << 20, [7, 9]).tolist() == exact and whitening.deviations(x[1:], 4, [7, 9]).tolist() == [[5, (1 << 42) - 9]]
