"""Language of a text by inference of its mixture of languages.

Training sums the byte trigrams of all texts with a known language, hashed into BUCKETS cells. A text is explained as a mixture of
the languages' trigram distributions: expectation-maximisation estimates the proportions, and the set of languages is the one
with the best log-likelihood less PENALTY * ln(trigrams) for each language beyond the first. The language with the largest
proportion in that set is predicted; its proportion is the score.

Most texts need no iteration: the log-likelihood is concave in the proportions, so no mixture gains more over the best single
language k than the largest directional derivative sum(p_j / p_k) - n. Where that is within the penalty, k alone is optimal.

A text that is null or has no letter is `und` with score 0, and so is every text if no language was learned; equal likelihoods go to
the language that sorts first. Rows with a null language or text teach nothing."""
from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import LOWER, buffers, chunks, mix, ranges

BUCKETS = 1 << 15
SMOOTHING, PENALTY = 0.1, 3.0
STEPS, REFINE_STEPS = 12, 6
#: Bytes of text that the mixture is estimated for at once.
EM_BYTES = 1 << 20
_LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str | None) -> bool:
    """Whether some character is a letter. The pattern also finds characters such as ² and ½, which are none."""
    m = _LETTER.search(text) if text else None
    return m is not None and (m.group().isalpha() or any(map(str.isalpha, text)))


#: Letters in lower case and bytes of other scripts as they are; everything else is a gap.
_PLAIN = np.array([LOWER[b] if chr(b).isalpha() and b < 128 or b >= 128 else 32 for b in range(256)], np.uint8)


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cell of each trigram of each text with a gap put before and behind it, and where each text's begin. Trigrams of gaps alone are left out."""
    n = np.diff(offsets)
    padded = np.full(len(data) + 2 * len(n), 32, np.uint8)
    starts = offsets[:-1] + 2 * np.arange(len(n))
    padded[ranges(starts + 1, n)] = _PLAIN[data]
    p = padded.astype(np.uint32)
    code = (p[:-2] << np.uint32(16)) | (p[1:-1] << np.uint32(8)) | p[2:] if len(p) > 2 else np.zeros(0, np.uint32)
    keep = code != 0x202020
    keep[(starts[1:, None] - np.array([1, 2])).ravel()] = False      # these span two texts
    at = np.concatenate([[0], np.cumsum(keep)])
    cell = (mix(code[keep].astype(np.uint64)) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)
    return cell, at[np.r_[starts, len(code)].clip(max=len(code))]


def count_trigrams(docs: DataFrame) -> DataFrame:
    """lang, cell and n over all texts with a language; each task adds up its own before the shuffle."""
    def run(batches):
        total: dict[str, np.ndarray] = {}
        for b in batches:
            data, off = buffers(b.column("text"))
            lang = b.column("lang").dictionary_encode()
            names, which = lang.dictionary.to_pylist(), lang.indices.to_numpy()
            for lo, hi in chunks(off):
                cell, first = trigrams(data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo])
                key = np.repeat(which[lo:hi], np.diff(first)).astype(np.int64) * BUCKETS + cell
                sums = np.bincount(key, minlength=len(names) * BUCKETS).reshape(len(names), BUCKETS)
                for i in np.unique(which[lo:hi]):
                    total[names[i]] = total.get(names[i], 0) + sums[i]
        for name, c in total.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(c[at], pa.int64())], ["lang", "cell", "n"])

    d = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).filter("lang IS NOT NULL AND text IS NOT NULL")
    return d.mapInArrow(run, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order, and the log-probability of each cell by language. Its size is languages x BUCKETS, whatever the corpus."""
    rows = count_trigrams(docs).toPandas()
    names = sorted(rows["lang"].unique())
    n = np.full((len(names), BUCKETS), SMOOTHING)
    n[np.searchsorted(names, rows["lang"]) if len(names) else [], rows["cell"].to_numpy()] += rows["n"].to_numpy()
    return names, np.log(n / n.sum(1, keepdims=True)) if len(names) else n


def _sums(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of each text's stretch of x; 0 for an empty one."""
    at = np.concatenate([[0.0], np.cumsum(x, dtype=np.float64)])
    return at[first[1:]] - at[first[:-1]]


def _em(p: np.ndarray, count: np.ndarray, doc: np.ndarray, n: np.ndarray, share: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions after some steps for all texts at once, and their log-likelihood. p: probability by (entry, language)."""
    for _ in range(steps):
        w = p * share[doc]
        w *= (count / w.sum(1))[:, None]
        share = np.stack([np.bincount(doc, w[:, k], len(n)) for k in range(p.shape[1])], 1) / n[:, None]
    return share, np.bincount(doc, count * np.log((p * share[doc]).sum(1)), len(n))


def mixture(cell: np.ndarray, first: np.ndarray, logp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chosen language and its proportion for each text."""
    n, langs = np.diff(first).astype(float), len(logp)
    single = np.stack([_sums(row[cell], first) for row in logp], 1)
    best, score = single.argmax(1), np.ones(len(n))
    if langs == 1:
        return best, score
    gain = np.full(len(n), -np.inf)
    base = np.repeat(best, np.diff(first)) * BUCKETS + cell
    for j in range(langs):
        slope = _sums(np.exp(logp[j][cell] - logp.ravel()[base]), first) - n
        gain = np.where(best == j, gain, np.maximum(gain, slope))
    open_ = np.flatnonzero(gain > PENALTY * np.log(np.maximum(n, 2)))
    size = np.cumsum(np.diff(first)[open_])
    for part in np.split(open_, np.flatnonzero(np.diff(size // EM_BYTES)) + 1) if len(open_) else []:
        best[part], score[part] = _select(cell, first, logp, part, single[part])
    return best, score


def _select(cell: np.ndarray, first: np.ndarray, logp: np.ndarray, part: np.ndarray, single: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Language set by penalised likelihood: the likeliest single one, then the mixtures of the languages with the largest proportions."""
    length = np.diff(first)[part]
    key, count = np.unique(np.repeat(np.arange(len(part)), length) * BUCKETS + cell[ranges(first[part], length)], return_counts=True)
    doc, langs, n = key // BUCKETS, len(logp), length.astype(float)
    p = np.exp(logp[:, key % BUCKETS]).T.copy()
    full, _ = _em(p, count, doc, n, np.full((len(part), langs), 1 / langs), STEPS)
    order = np.argsort(-full, axis=1, kind="stable")
    value, best, score = single.max(1), single.argmax(1), np.ones(len(part))
    cost = PENALTY * np.log(np.maximum(n, 2))
    for m in range(2, langs + 1):
        share = full.copy()
        np.put_along_axis(share, order[:, m:], 0, 1)
        share, fit_ = _em(p, count, doc, n, share / share.sum(1, keepdims=True), REFINE_STEPS)
        better = fit_ - cost * (m - 1) > value
        if not better.any():
            break
        top = share.argmax(1)
        value = np.where(better, fit_ - cost * (m - 1), value)
        best, score = np.where(better, top, best), np.where(better, share.max(1), score)
    return best, score


def predict(docs: DataFrame, names: list[str], logp: np.ndarray) -> DataFrame:
    """All columns of `docs` (with a text), lang_pred and score. The model goes to the executors once."""
    model = docs.sparkSession.sparkContext.broadcast((names, logp))
    schema = docs.schema.simpleString()[7:-1]

    def run(batches):
        names, logp = model.value
        for b in batches:
            data, off = buffers(b.column("text"))
            pred, score = np.full(b.num_rows, -1), np.zeros(b.num_rows)
            for lo, hi in chunks(off) if names else ():
                pred[lo:hi], score[lo:hi] = mixture(*trigrams(data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo]), logp)
            none = np.array([not has_letter(t) for t in b.column("text").to_pylist()], bool)
            pred[none] = -1
            score[pred < 0] = 0
            out = pa.array(np.array([*names, "und"], object)[pred], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, out, pa.array(score.clip(0, 1))], [*b.schema.names, "lang_pred", "score"])
    return docs.mapInArrow(run, f"{schema}, lang_pred string, score double")


def held_out(key: str = "doc_id"):
    """Whether the row belongs to the part that nothing is learned from."""
    return F.coalesce(F.crc32(F.encode(F.col(key).cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each row; learned from the texts with a language that are not held out."""
    names, logp = fit(docs.filter(~held_out()).select("lang", "text"))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return predict(d, names, logp).select("doc_id", "held_out", "lang_pred", "score")


def keep_languages(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """All columns of the rows whose language is known and makes up `least` of the text or more. The lang column is learned from but never read for a prediction."""
    names, logp = fit(docs.filter(~held_out()).select("lang", "text"))
    kept = predict(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").cast("string").alias("text")), names, logp)
    return kept.filter((F.col("lang_pred") != "und") & (F.col("score") >= least)).select("row.*")
