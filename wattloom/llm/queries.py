"""Queries of the corpus operators with their production parameters, and the SQL they must agree with."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontamination, embedding_dedup, html_text, langid, lexical, packing, pii, sharding, shingle_join, substring_dedup, suffix_dedup, whitening
from .common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_substring_dedup(spark: SparkSession, d: str) -> DataFrame:
    return substring_dedup.dedup(read(spark, d, "documents"), window=13, with_text=False)


@query
def op2_sharding(spark: SparkSession, d: str) -> DataFrame:
    return sharding.shard_documents(read(spark, d, "documents"), sharding.regular_tree(24), sharding.regular_tree(25))


@query
def op3_embedding_dedup(spark: SparkSession, d: str) -> DataFrame:
    return embedding_dedup.near_copies(read(spark, d, "embeddings"), least=0.98)


@query
def op4_decontamination(spark: SparkSession, d: str) -> DataFrame:
    return decontamination.leaks(read(spark, d, "documents"), read(spark, d, "benchmark"))


@query
def op5_language_id(spark: SparkSession, d: str) -> DataFrame:
    return langid.identify(read(spark, d, "documents"))


@query
def op6_suffix_dedup(spark: SparkSession, d: str) -> DataFrame:
    return suffix_dedup.dedup(read(spark, d, "documents"), width=400, with_bytes=False)


@query
def op7_html_text(spark: SparkSession, d: str) -> DataFrame:
    return html_text.extract(read(spark, d, "pages"))


@query
def op8_shingle_join(spark: SparkSession, d: str) -> DataFrame:
    return shingle_join.join(read(spark, d, "documents"))


@query
def op9_pii(spark: SparkSession, d: str) -> DataFrame:
    return pii.digest(read(spark, d, "documents"))


@query
def op10_best_fit_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(read(spark, d, "documents"), size=1024, end_id=2)


@query
def op11_bpe_replay(spark: SparkSession, d: str) -> DataFrame:
    return bpe.digest(read(spark, d, "documents"))


@query
def op12_whitening(spark: SparkSession, d: str) -> DataFrame:
    return whitening.whiten(read(spark, d, "embeddings"), components=8)


@query
def op13_lexical_search(spark: SparkSession, d: str) -> DataFrame:
    return lexical.search(read(spark, d, "documents"), read(spark, d, "benchmark"), k=10)


ORACLES["op13_lexical_search"] = r"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
     total AS (SELECT count(*) FILTER (len(terms) > 0) AS n_docs, sum(len(terms))::BIGINT AS length FROM texts),
     tf AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(terms) AS n, unnest(terms) AS term FROM texts) GROUP BY ALL),
     w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), total),
     item AS (SELECT row_number() OVER () AS i, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                     '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM benchmark),
     wanted AS (SELECT i, item_id, term, count(*) AS reps FROM (SELECT i, item_id, unnest(terms) AS term FROM item) GROUP BY ALL),
     scores AS (SELECT i, item_id, r, doc_id, sum(reps * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * n_docs) // length))))::BIGINT AS score
                FROM wanted JOIN w USING (term) JOIN tf USING (term), total GROUP BY i, item_id, r, doc_id)
SELECT item_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id)::INTEGER AS rank FROM scores WHERE score > 0) WHERE rank <= 10
"""
