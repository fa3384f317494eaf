"""Ranked lexical search: term-at-a-time scoring with a limited set of accumulators.

Postings (one row for each document and term of a query, with the term's count) are dealt to parts by document, so that a frequent term's list is cut and no part
is long; weights and lengths are those of all documents. A part takes a query's terms one at a time, rarest first. Each term has a bound, the most
that it can add to a document of the part. Once the bounds of the terms to come sum to less than the kth partial score, no document without an accumulator can
enter the first k: none is created any more, and later terms update the survivors alone, exactly. Survivors whose score and bounds fall below that mark go. The parts'
first k are merged. Queries are taken in blocks of ITEMS.

Terms are the maximal runs of ASCII letters and digits and of all characters beyond ASCII; only A-Z are lower-cased. Null and empty texts have no terms, as documents and as
queries. Each row of a table is a document (a query) of its own, also where rows repeat or ids are null; equal scores are ordered by doc_id, null last. Texts longer than
SECTION bytes are counted a section at a time. Empty tables give no rows. Other columns are not looked at."""
from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from wattloom.session import cut_lineage

from .common import id_array, ids_of, texts

#: Postings of a part on average, queries of a block, rows of a batch, bytes counted at once.
PART_POSTINGS, ITEMS, ROWS, SECTION = 500_000, 4096, 512, 8 << 20
_GAPS = bytes(b for b in range(128) if not chr(b).isalnum())
_TABLE = bytes.maketrans(_GAPS, b" " * len(_GAPS)).translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256)))
_POSTINGS = "row long, doc_id long, n long, terms array<string>, tfs array<long>"


def term_counts(text: str | None) -> Counter:
    """Terms of a text, as UTF-8, and how often each occurs."""
    data, found, lo = (text or "").encode().translate(_TABLE), Counter(), 0
    while lo < len(data):
        hi = len(data) if len(data) - lo <= SECTION else data.find(b" ", lo + SECTION)
        hi = len(data) if hi < 0 else hi
        found.update(data[lo:hi].split())
        lo = hi
    return found


def index(docs: DataFrame) -> DataFrame:
    """For each document: row (a number of its own), doc_id, n (its terms with repeats), its terms and their counts."""
    def run(batches):
        from pyspark import TaskContext
        row = TaskContext.get().partitionId() << 40
        for whole in batches:
            for lo in range(0, whole.num_rows, ROWS):
                b = whole.slice(lo, ROWS)
                counts = [term_counts(t) for t in b.column("text").to_pylist()]
                offsets = pa.array(np.cumsum([0, *map(len, counts)]), pa.int32())
                terms = pa.array([t for c in counts for t in c], pa.binary()).cast(pa.string())
                tfs = pa.array([n for c in counts for n in c.values()], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + len(counts))), b.column("doc_id"), pa.array([sum(c.values()) for c in counts], pa.int64()),
                                                  pa.ListArray.from_arrays(offsets, terms), pa.ListArray.from_arrays(offsets, tfs)], ["row", "doc_id", "n", "terms", "tfs"])
                row += len(counts)
    return texts(docs).mapInArrow(run, _POSTINGS)


class Part:
    """Postings of some documents, by term."""

    def __init__(self, row: np.ndarray, doc_id: np.ndarray, term: np.ndarray, gain: np.ndarray):
        rows, at, doc = np.unique(row, return_index=True, return_inverse=True)
        self.doc_id, order = doc_id[at], np.argsort(term, kind="stable")
        self.doc, self.gain, term = doc[order], gain[order], term[order]
        cut = np.flatnonzero(np.diff(term, prepend=-1, append=-1)) if len(term) else np.zeros(0, int)
        self.lists = {int(term[lo]): slice(lo, hi) for lo, hi in zip(cut[:-1], cut[1:])}

    def first(self, terms: list[int], reps: list[int], k: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents (numbers in the part) with the k highest scores above 0, and the scores. `terms` rarest first."""
        found = [(self.lists[t], r) for t, r in zip(terms, reps) if t in self.lists]
        bounds = np.array([int(self.gain[s].max()) * r for s, r in found], np.int64)
        left = np.cumsum(bounds[::-1])[::-1]                  # what this term and those to come add at most
        score = np.zeros(len(self.doc_id), np.int64)          # an accumulator exists where this is above 0: all gains are
        survives = None                                       # documents that are updated; None while accumulators are created
        mark = 0
        for (s, r), rest in zip(found, left.tolist()):
            have = score[score > 0] if survives is None else score[survives]
            if len(have) >= k:
                mark = max(mark, int(np.partition(have, len(have) - k)[len(have) - k]))
                if rest < mark:
                    survives = (score > 0) & (score + rest >= mark)
            doc, gain = self.doc[s], self.gain[s]
            if survives is not None:
                live = survives[doc]
                doc, gain = doc[live], gain[live]
            score[doc] += gain * r                            # a document stands in a list once
        top = np.flatnonzero((score > 0) & (score >= mark))
        top = top[np.lexsort((self.doc_id[top], -score[top]))][:k]
        return top, score[top]


def _first_of_parts(postings: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    def run(key, p, q):
        part = Part(p["row"].to_numpy(), ids_of(p["doc_id"]), p["t"].to_numpy(), p["gain"].to_numpy())
        items, docs, scores = [], [], []
        for item, terms, reps in zip(q["item"].to_pylist(), q["ts"].to_pylist(), q["reps"].to_pylist()):
            top, score = part.first(terms, reps, k)
            items.append(np.full(len(top), item))
            docs.append(part.doc_id[top])
            scores.append(score)
        item, doc, score = (np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in (items, docs, scores))
        return pa.table({"item": pa.array(item, pa.int64()), "doc_id": id_array(doc), "score": pa.array(score, pa.int64())})
    return postings.groupBy("block", "part").cogroup(queries.groupBy("block", "part")).applyInArrow(run, "item long, doc_id long, score long")


def search(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id and score of the k documents of `docs` (doc_id, text) that rank highest for each row of `queries` (item_id, text)."""
    ids = cut_lineage(queries.select("item_id", "text", F.monotonically_increasing_id().alias("item")))
    q = cut_lineage(index(ids.select(F.col("item").alias("doc_id"), "text")).withColumnRenamed("doc_id", "item"))
    blocks = max(1, -(-ids.count() // ITEMS))
    terms = cut_lineage(q.select(F.explode("terms").alias("term")).distinct().withColumn("t", F.monotonically_increasing_id())
                        .unionByName(q.sparkSession.createDataFrame([("", -1)], "term string, t long")))
    # every document has the empty term once: it carries n of documents that hold no term of a query
    d = index(docs).withColumn("terms", F.concat("terms", F.array(F.lit("")))).withColumn("tfs", F.concat("tfs", F.array(F.lit(1).cast("long"))))
    d = d.select("row", "doc_id", "n", F.explode(F.arrays_zip("terms", "tfs")).alias("p")).select("row", "doc_id", "n", F.col("p.terms").alias("term"), F.col("p.tfs").alias("tf"))
    p = cut_lineage(d.join(terms, "term").select("row", "doc_id", "n", "t", "tf"))
    total = p.filter("t = -1").agg(F.count_if(F.col("n") > 0).alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).first()
    w = cut_lineage(p.filter("t >= 0").groupBy("t").agg(F.count("*").alias("df")).withColumn("w", F.floor(1000 * F.ln(F.lit(2 * total.n + 2) / (2 * F.col("df") + 1))).cast("long")))
    items = (q.select("item", F.explode(F.arrays_zip("terms", "tfs")).alias("p")).select("item", F.col("p.terms").alias("term"), F.col("p.tfs").alias("rep"))
             .join(terms, "term").join(w, "t").groupBy("item").agg(F.array_sort(F.collect_list(F.struct("df", "t", "rep"))).alias("ts"))
             .select("item", F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int").alias("block"), F.col("ts.t").alias("ts"), F.col("ts.rep").alias("reps")))
    items = cut_lineage(items)
    n_parts = max(1, -(-p.count() // PART_POSTINGS))
    m = F.expr(f"25 + (75 * n * {total.n}L) div {max(total.length, 1)}L")
    gains = (p.join(w, "t").withColumn("m", m).withColumn("gain", F.expr("w * ((1000000000 * tf) div (1000 * tf + 8 * m))")).filter("gain > 0")
             .join(items.select(F.col("block").alias("for_block"), F.explode("ts").alias("t")).distinct(), "t")
             .select(F.col("for_block").alias("block"), F.pmod(F.xxhash64("row"), F.lit(n_parts)).cast("int").alias("part"), "row", "doc_id", "t", "gain"))
    tasks = items.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n_parts - 1))))
    order = W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    best = _first_of_parts(gains, tasks, k).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.join(ids.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
