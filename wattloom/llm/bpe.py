"""Byte-level BPE by merge replay over a corpus's words.

A text falls into words, the matches of a pattern; words are encoded separately, so only distinct words matter. The distinct words of a slice of
the corpus lie in one row of byte tokens with links to both neighbours. An inverted index leads from each pair of neighbouring tokens that
some merge joins (filed under the rank of that merge) to all its positions in all words. Merges are replayed in rank order; each looks up
its positions and files only the pairs that arise at their sides. Every word sees the order of merges that it would see alone, also where a merge gives
rise to a pair of lower rank. A word that is a token as a whole is that token.

A slice is what one task reads: its distinct words are encoded once (WORDS at most are held, then the table starts anew), so no text and no word is shuffled,
a lost task is run again alone, and the result does not depend on slices. Decoding joins the bytes of the tokens.

Null texts are empty and have no tokens. Texts longer than SECTION characters are split to words a section at a time. Rows may repeat and doc_id may be null: each row
stands for itself. An empty table gives no rows. Other columns are not looked at."""
from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import ranges, texts

RANKS = "byte_bpe_50k.tiktoken"
#: Words that a task remembers, words looked at at once, rows of a batch, and bytes of new words from which positions are joined all at once.
WORDS, SECTION, ROWS, FEW = 300_000, 500_000, 1024, 20_000
#: Rank of two tokens that no merge joins.
NONE = np.iinfo(np.int32).max
_HIGH = re.compile("[\U00010000-\U0010ffff]")


class Vocabulary:
    """Tokens of a rank file: bytes by id, id by bytes, and id of the merge by pair of ids (every way to cut a token into two tokens)."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ids = ranks
        size = max(ranks.values()) + 1
        self.tokens: list[bytes] = [b""] * size
        for t, r in ranks.items():
            self.tokens[r] = t
        self.shift = size.bit_length()
        self.pairs = {ranks[t[:i]] << self.shift | ranks[t[i:]]: r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.keys, self.merged = (np.array(x, t) for x, t in zip(zip(*sorted(self.pairs.items())), (np.int64, np.int32)))
        self.unsafe = np.zeros(size, bool)                                # tokens that a merge of lower rank can take
        for part in (self.keys >> self.shift, self.keys & ((1 << self.shift) - 1)):
            self.unsafe[part[self.merged < part]] = True
        self.length = np.array([len(t) for t in self.tokens], np.int64)
        self.first = np.cumsum(self.length) - self.length
        self.data = np.frombuffer(b"".join(self.tokens), np.uint8)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of each two tokens; NONE if there is none, or if one of them is negative."""
        key = a.astype(np.int64) << self.shift | b                       # negative if b is
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.merged[at], np.int32(NONE))

    @classmethod
    def of_file(cls, path: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls({base64.b64decode(t): int(r) for t, r in map(bytes.split, f)})


@lru_cache(maxsize=4)
def vocabulary(name: str) -> Vocabulary:
    import public_tokenizers
    return Vocabulary.of_file(public_tokenizers.path(name))


def _class_of(pattern: str) -> str:
    """The code points that tiktoken's engine takes for the class, as ranges for `re`: the Unicode version of Python's modules may be another."""
    import tiktoken
    bytes_only = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
    found = np.concatenate([np.array([ord(c) for c in bytes(bytes_only.encode_ordinary("".join(chr(c) for c in range(lo, lo + 0x800)))).decode()], np.int64)
                            for lo in range(0, 0x110000, 0x800) if lo != 0xD800])
    cut = np.flatnonzero(np.diff(found) > 1)
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(found[np.r_[0, cut + 1]].tolist(), found[np.r_[cut, len(found) - 1]].tolist()))


@lru_cache(maxsize=1)
def splitters() -> tuple[re.Pattern, re.Pattern, re.Pattern]:
    """public_tokenizers.PATTERN for any text, for texts within the first 65,536 code points, and for ASCII texts: the same matches, by smaller and faster classes."""
    import public_tokenizers
    whole = public_tokenizers.PATTERN

    def with_classes(space: str, letter: str, number: str) -> re.Pattern:
        p = whole.replace(r"[^\s\p{L}\p{N}]", f"[^{space}{letter}{number}]").replace(r"(?!\S)", f"(?![^{space}])")
        return re.compile(p.replace(r"\s", f"[{space}]").replace(r"\p{L}", f"[{letter}]").replace(r"\p{N}", f"[{number}]"))
    classes = [_class_of(p) for p in (r"\s+", r"\p{L}+", r"\p{N}+")]
    low = [re.sub(r"\\U(?!0000).{8}-.{10}", "", c) for c in classes]
    return with_classes(*classes), with_classes(*low), with_classes(r" \t-\r", "A-Za-z", "0-9")


def sections(text: str, most: int = SECTION) -> Iterator[list[str]]:
    """Words of the text in order, at most `most` at once."""
    p = splitters()[2 if text.isascii() else 0 if _HIGH.search(text) else 1]
    if len(text) <= most:
        yield p.findall(text)
        return
    found = (m.group() for m in p.finditer(text))
    while words := list(islice(found, most)):
        yield words


def replay(words: list[bytes], v: Vocabulary) -> list[bytes]:
    """Token ids of each word, as bytes of int32. All positions of a merge are joined at once.

    Where a word holds a merge twice and a pair of lower rank might arise in between (`v.unsafe`), its order matters: such words are replayed by `replay_in_order`."""
    whole = [v.ids.get(w) for w in words]
    cut = [i for i, t in enumerate(whole) if t is None]
    size = np.array([len(words[i]) for i in cut], np.int64)
    stop = np.cumsum(size)
    start, n = stop - size, int(stop[-1]) if len(cut) else 0
    sym = np.append(v.byte[np.frombuffer(b"".join(words[i] for i in cut), np.uint8)], np.int32(-1))     # place n is no token
    owner = np.repeat(np.arange(len(cut)), size)
    right, left = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)       # neighbours; n: none
    right[stop - 1] = left[start] = n
    merging = np.zeros(n + 1, bool)
    cur = np.full(n + 1, NONE, np.int32)                                                                # rank of the merge of a token and its right neighbour
    cur[:n] = v.rank(sym[:n], sym[right[:n]])
    index: dict[int, list[np.ndarray]] = {}
    ranks: list[int] = []

    def file(at: np.ndarray) -> None:
        r = cur[at]
        order = np.argsort(r, kind="stable")[:np.count_nonzero(r != NONE)]
        at, r = at[order], r[order]
        edge = [0, *(np.flatnonzero(r[1:] != r[:-1]) + 1).tolist()] if len(r) else []
        for lo, hi, q in zip(edge, [*edge[1:], len(r)], r[edge].tolist()):
            if q in index:
                index[q].append(at[lo:hi])
            else:
                index[q] = [at[lo:hi]]
                heappush(ranks, q)

    apart: list[int] = []
    file(np.arange(n, dtype=np.int32))
    while ranks:
        r = heappop(ranks)
        i = np.concatenate(index.pop(r))
        i = np.sort(i[cur[i] == r])                                                           # others were taken by a merge before
        if len(i) > 1:
            touching = right[i[:-1]] == i[1:]
            if touching.any():                                                                # a run of one token: every second place merges
                k = np.arange(len(i))
                i = i[(k - np.maximum.accumulate(np.where(np.r_[True, ~touching], k, 0))) % 2 == 0]
            if v.unsafe[r]:
                o = owner[i]
                again = np.unique(o[1:][o[1:] == o[:-1]])
                if len(again):
                    apart += again.tolist()
                    cur[ranges(start[again], size[again])] = NONE
                    i = i[cur[i] == r]
        j = right[i]
        sym[i], sym[j], cur[j] = r, -1, NONE
        right[i] = right[j]
        left[right[i]] = i                                                                    # place n takes what nobody reads
        a = left[i]
        merging[i] = merging[n] = True
        touched = np.concatenate([i, a[~merging[a]]])
        merging[i] = False
        cur[touched] = v.rank(sym[touched], sym[right[touched]])
        file(touched)
    tokens = sym[:n]
    count = np.add.reduceat(tokens >= 0, start) if len(cut) else size
    data, ends = tokens[tokens >= 0].tobytes(), (4 * np.cumsum(count)).tolist()
    out = [np.int32(t).tobytes() if t is not None else b"" for t in whole]
    for k, (lo, hi) in zip(cut, zip([0, *ends], ends)):
        out[k] = data[lo:hi]
    for k, ids in zip(apart, replay_in_order([words[cut[k]] for k in apart], v)):
        out[cut[k]] = np.array(ids, np.int32).tobytes()
    return out


def replay_in_order(words: list[bytes], v: Vocabulary) -> list[list[int]]:
    """Token ids of each word, a position at a time. A pair of lower rank that arises is replayed before the rest of the positions."""
    sym: list[int] = []
    starts = []
    for w in words:
        starts.append(len(sym))
        sym += [v.ids[w]] if w in v.ids else v.byte[np.frombuffer(w, np.uint8)].tolist()
    n = len(sym)
    right, left = list(range(1, n + 1)), list(range(-1, n - 1))           # neighbours; -1: none
    for s in [*starts, n]:
        if s < n:
            left[s] = -1
        if s:
            right[s - 1] = -1
    pairs, shift, index = v.pairs, v.shift, {}
    for i in range(n - 1):
        if right[i] >= 0 and (r := pairs.get(sym[i] << shift | sym[i + 1])) is not None:
            index.setdefault(r, []).append(i)
    ranks = sorted(index)                                                 # a sorted list is a heap

    def file(r: int, at: list[int]) -> None:
        if r in index:
            index[r] += at
        else:
            index[r] = at
            heappush(ranks, r)

    while ranks:
        r = heappop(ranks)
        positions = sorted(index.pop(r))
        for k, i in enumerate(positions):
            j = right[i]
            if sym[i] < 0 or j < 0 or pairs.get(sym[i] << shift | sym[j]) != r:
                continue                                                  # a merge before took one of the two
            a, b = left[i], right[j]
            sym[i], sym[j], right[i] = r, -1, b
            lower = False
            if b >= 0:
                left[b] = i
                if (q := pairs.get(r << shift | sym[b])) is not None:
                    file(q, [i])
                    lower = q < r
            if a >= 0 and (q := pairs.get(sym[a] << shift | r)) is not None:
                file(q, [a])
                lower = lower or q < r
            if lower:
                if rest := positions[k + 1:]:
                    file(r, rest)
                break
    return [[t for t in sym[s:e] if t >= 0] for s, e in zip(starts, [*starts[1:], n])]


class Encoder:
    """Encodes batches of texts; remembers the ids of words as bytes of int32."""

    def __init__(self, v: Vocabulary, most: int = WORDS):
        self.v, self.most, self.known, self.before = v, most, {}, {}

    def _learn(self, words: set[str]) -> None:
        """Puts all words into `known`. What it held is `before` once it holds half of `most`; words that are met again come back, the others go."""
        if len(self.known) > self.most // 2:
            self.before, self.known = self.known, {}
        known, before = self.known, self.before
        new = []
        for w in words.difference(known):
            if w in before:
                known[w] = before[w]
            else:
                new.append(w)
        raw = [w.encode("utf-8") for w in new]
        known.update(zip(new, replay(raw, self.v) if sum(map(len, raw)) >= FEW else (np.array(ids, np.int32).tobytes() for ids in replay_in_order(raw, self.v))))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's ids start and the last one's end."""
        out, ends, waiting = [], [], []

        def flush() -> None:                                              # words of whole short texts wait, so that new ones are replayed together
            self._learn(set().union(*(w for w, _ in waiting)))
            for words, last in waiting:
                part = b"".join(map(self.known.__getitem__, words))
                out.append(part)
                if last:
                    ends.append(len(out))
            waiting.clear()
        size = 0
        for text in texts:
            parts = list(sections(text)) if text and len(text) <= SECTION else sections(text or "")
            for words in parts:
                waiting.append((words, False))
                size += len(words)
                if size > SECTION:
                    flush()
                    size = 0
            waiting.append(([], True))
        flush()
        sizes = np.cumsum([0, *map(len, out)])
        return np.frombuffer(b"".join(out), np.int32), np.r_[0, sizes[ends]] // 4


@lru_cache(maxsize=2)
def _encoder(name: str) -> Encoder:
    return Encoder(vocabulary(name))


def encode(docs: DataFrame, ranks: str = RANKS, with_decoded: bool = False) -> DataFrame:
    """doc_id and ids (array of int) of the text of each row; on wish also `decoded`, as `decode` would add it, without sending the ids to Python again."""
    def run(batches):
        e = _encoder(ranks)
        for whole in batches:
            for lo in range(0, whole.num_rows, ROWS):
                b = whole.slice(lo, ROWS)
                ids, offsets = e.encode(b.column("text").to_pylist())
                columns = [b.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))]
                if with_decoded:
                    columns.append(decoded_texts(ids.astype(np.int64), offsets, e.v))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "decoded"][:len(columns)])
    return texts(docs).mapInArrow(run, "doc_id long, ids array<int>" + ", decoded binary" * with_decoded)


def decoded_texts(ids: np.ndarray, offsets: np.ndarray, v: Vocabulary) -> pa.Array:
    """The bytes that the ids of each row stand for."""
    length = v.length[ids]
    cut = np.r_[0, np.cumsum(length)][offsets]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(cut.astype(np.int64).tobytes()), pa.py_buffer(v.data[ranges(v.first[ids], length)].tobytes())]).cast(pa.binary())


def decode(encoded: DataFrame, ranks: str = RANKS) -> DataFrame:
    """Adds `decoded`, the bytes that the ids stand for. Null ids are no ids."""
    def run(batches):
        v = vocabulary(ranks)
        for whole in batches:
            for lo in range(0, whole.num_rows, ROWS):
                b = whole.slice(lo, ROWS)
                col = b.column("ids")
                offsets = np.r_[0, np.cumsum(col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))].astype(np.int64)
                yield pa.RecordBatch.from_arrays([*b.columns, decoded_texts(col.flatten().to_numpy(zero_copy_only=False).astype(np.int64), offsets, v)], [*b.schema.names, "decoded"])
    d = encoded.drop("decoded")
    return d.mapInArrow(run, d.selectExpr("*", "cast(null as binary) as decoded").schema)


def digest(docs: DataFrame, ranks: str = RANKS) -> DataFrame:
    """doc_id, n_tokens, and sha256 of the decimal ids joined by one space and of the decoded bytes."""
    d = encode(docs, ranks, with_decoded=True)
    return d.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
                    F.sha2("decoded", 256).alias("decoded_sha256"))
