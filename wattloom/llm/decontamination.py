"""Benchmark passages in documents, re-parameterised ones included.

Texts become templates: a token is a run of letters and digits; numbers, units and names (words with one capital inside a sentence, a run of them as
one) turn into typed placeholders, all else into lower case. Windows of WINDOW template tokens, half of them literal at least, of
documents and benchmark items meet in a hash join. Windows of one document and item on one diagonal are one alignment: it counts if it
covers COVER of the item's tokens and if its slots are consistent, that is if benchmark values and document values map
one to one (the share of the distinct pairs that a one-to-one mapping could have is CONSISTENT or more).

Beside them go windows of the plain lower-case words, names and numbers as they stand, whatever share of them is literal: so an exact copy is
found of an item made mostly of numbers, names or units, and of one whose first word the document's sentence turns into a name. Words
that cover COVER of the item's words on one diagonal count, and so does a verbatim run of RUN words, however small its share of the item.
If the templates agree too, the result shows their alignment, else that of the words.

The document side is filtered by the benchmark's window hashes inside the scan if these are few enough to be sent to every
executor (SENT_WINDOWS, checked); beyond that all windows go into the same join. Items with fewer than WINDOW tokens (or words) are matched whole; those
with fewer than LEAST can't be told from chance and match nothing, as do null and empty texts. Repeated rows count once; a table without rows
gives no result; other columns are ignored."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import LOWER, buffers, chunks, mix, odd, ranges, span_hashes

WINDOW, LEAST, COVER, CONSISTENT = 8, 4, 0.5, 0.8
#: Words of a verbatim run that is a leak whatever share of the item it is.
RUN = 13
SENT_WINDOWS = 2_000_000
#: Words that stand for a unit.
UNITS = "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ton tons lb lbs pound pounds oz ounce ounces ml cl l liter liters litre litres gallon gallons second seconds minute minutes hour hours day days week weeks month months year years cent cents dollar dollars euro euros usd eur gbp percent pct degree degrees celsius fahrenheit kelvin watt watts kw kwh volt volts amp amps joule joules newton newtons pascal hz khz mhz ghz kb mb gb tb kmh mph".split()
_SEED = 41
_WORD = np.array([chr(b).isalnum() and b < 128 or b >= 128 for b in range(256)])
_DIGIT = np.isin(np.arange(256), np.frombuffer(b"0123456789", np.uint8))
_UPPER = np.isin(np.arange(256), np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", np.uint8))
_BREAK = np.isin(np.arange(256), np.frombuffer(b".!?:;|\n\r", np.uint8))
_POINT = np.isin(np.arange(256), np.frombuffer(b".,", np.uint8))
_FACTORS = odd(WINDOW, 43)
_PLACEHOLDER = odd(4, 47)
_SCHEMA = "doc_id {key}, window long, at int, slots array<long>"


def _unit_hashes() -> np.ndarray:
    data, off = buffers(pa.array(UNITS))
    return np.sort(span_hashes(data, off[:-1], off[1:], _SEED))


def templates(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Template token, slot value (0 for a literal) and the number of the first token of each text; the same of the plain words, none of which is a slot."""
    n = np.diff(offsets)
    d = np.full(len(data) + len(n) + 2, 10, np.uint8)                # a line break between texts
    starts = 1 + offsets[:-1] + np.arange(len(n))
    d[ranges(starts, n)] = data
    digit, word = _DIGIT[d], _WORD[d]
    word[1:-1] |= _POINT[d[1:-1]] & digit[:-2] & digit[2:]
    first, last = np.flatnonzero(word[1:] & ~word[:-1]) + 1, np.flatnonzero(word[:-1] & ~word[1:]) + 1
    low = LOWER[d]
    low[1:] += np.where((d[:-1] == 0xC3) & (d[1:] >= 0x80) & (d[1:] <= 0x9E) & (d[1:] != 0x97), 0x20, 0).astype(np.uint8)   # capitals with accents
    value = span_hashes(low, first, last, _SEED)
    units = _unit_hashes()
    unit = units[np.searchsorted(units, value).clip(max=len(units) - 1)] == value
    breaks = np.concatenate([[0], np.cumsum(_BREAK[d])])
    inside = np.zeros(len(first), bool)
    inside[1:] = breaks[first[1:]] == breaks[last[:-1]]
    name = _UPPER[d[first]] & inside & (last - first > 1) & (low[first + 1] == d[first + 1])
    later = np.zeros(len(first), bool)
    later[1:] = name[1:] & name[:-1]                                  # goes on a name
    keep, words = np.flatnonzero(~later), value                       # a literal's token is mixed, so no hash of both kinds is alike
    run = np.arange(len(first)) - np.maximum.accumulate(np.where(later, 0, np.arange(len(first)))) if len(first) else first
    value = np.add.reduceat(mix(value + run.astype(np.uint64)), keep) if len(keep) else value
    kind = np.where(digit[first], 1, np.where(name, 2, np.where(unit, 3, 0)))[keep]
    token = np.where(kind > 0, _PLACEHOLDER[kind], value)
    ends = np.r_[starts, len(d)]
    return [(token, np.where(kind > 0, value | np.uint64(1), np.uint64(0)), np.searchsorted(first[keep], ends)), (words, np.zeros(len(words), np.uint64), np.searchsorted(first, ends))]


def windows(token: np.ndarray, slot: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Place and hash of each window inside one text with enough literals."""
    n = len(token) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h, literal = np.full(n, width, np.uint64), np.zeros(n, np.int64)
    for j in range(width):
        h += token[j:j + n] * _FACTORS[j]
        literal += slot[j:j + n] == 0
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.flatnonzero((text[:n] == text[width - 1:]) & (2 * literal >= width))
    return at, mix(h)[at]


def _rows(ids: pa.Array, text: np.ndarray, at: np.ndarray, first: np.ndarray, h: np.ndarray, slot: np.ndarray, width: int, names: list[str]) -> pa.RecordBatch:
    values = slot[(at[:, None] + np.arange(width)).ravel()].view(np.int64)
    slots = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * width, pa.int32()), pa.array(values, pa.int64()))
    return pa.RecordBatch.from_arrays([ids.take(pa.array(text)), pa.array(h.view(np.int64)), pa.array((at - first[text]).astype(np.int32)), slots], names)


def _scan(df: DataFrame, key: str, widths: list[tuple[bool, int]], wanted) -> DataFrame:
    """Windows of the texts of `df` (doc_id, text), of the words or templates and widths that the items have: all of them, or those whose hash is sent along."""
    def run(batches):
        some = wanted.value if wanted else None
        for b in batches:
            data, off = buffers(b.column("text"))
            for lo, hi in chunks(off, 1 << 20):
                both = templates(data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo])
                for plain, w in widths:
                    token, slot, first = both[plain]
                    at, h = windows(token, slot, first, w)
                    if some is not None:
                        hit = some[np.searchsorted(some, h).clip(max=len(some) - 1)] == h if len(some) else np.zeros(len(h), bool)
                        at, h = at[hit], h[hit]
                    if len(at):
                        text = np.searchsorted(first, at, "right") - 1
                        yield _rows(b.column("doc_id").slice(lo), text, at, first, h, slot, w, ["doc_id", "window", "at", "slots"])
    return df.mapInArrow(run, _SCHEMA.format(key=key))


def _items(bench: DataFrame) -> DataFrame:
    """Windows of each benchmark item: item_id, window, at, slots, tokens and words of the item, whether the window is one of plain words."""
    def run(batches):
        for b in batches:
            data, off = buffers(b.column("text"))
            both = templates(data, off)
            counts = [np.diff(x[2]) for x in both]
            for plain, (token, slot, first) in enumerate(both):
                n = counts[plain]
                for w in range(LEAST, WINDOW + 1):
                    at, h = windows(token, slot, first, w)
                    text = np.searchsorted(first, at, "right") - 1
                    own = n[text] == w if w < WINDOW else n[text] >= w
                    at, h, text = at[own], h[own], text[own]
                    out = _rows(b.column("item_id"), text, at, first, h, slot, w, ["item_id", "window", "item_at", "item_slots"])
                    more = [pa.array(counts[0][text]), pa.array(counts[1][text]), pa.array(np.full(len(at), bool(plain)))]
                    yield pa.RecordBatch.from_arrays([*out.columns, *more], [*out.schema.names, "tokens", "words", "plain"])
    b = bench.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text IS NOT NULL")
    return b.mapInArrow(run, "item_id long, window long, item_at int, item_slots array<long>, tokens long, words long, plain boolean")


def leaks(docs: DataFrame, bench: DataFrame, key: Column | None = None) -> DataFrame:
    """doc_id (or `key`), item_id, tokens of the item, covered tokens, slots, consistency of each contaminated document and item. Where
    the plain words alone agree, tokens and covered are numbers of words and there are no slots."""
    from wattloom.session import cut_lineage
    items = cut_lineage(_items(bench))
    widths = sorted(map(tuple, items.select("plain", F.size("item_slots")).distinct().collect()))    # at most WINDOW of either kind
    wanted = None
    if items.count() <= SENT_WINDOWS:
        wanted = docs.sparkSession.sparkContext.broadcast(np.unique(items.select("window").distinct().toPandas()["window"].to_numpy(np.int64).view(np.uint64)))
    d = docs.select((F.col("doc_id").cast("long") if key is None else key).alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = _scan(d, d.schema["doc_id"].dataType.simpleString(), widths, wanted).join(items, "window")
    group = ["doc_id", "item_id", "tokens", "words", "plain", "diagonal"]
    pairs = (found.withColumn("diagonal", F.col("at") - F.col("item_at"))
             .select(*group, "item_at", F.posexplode(F.arrays_zip("slots", "item_slots")).alias("i", "pair"))
             .groupBy(*group, (F.col("item_at") + F.col("i")).alias("place"))
             .agg(F.max("pair.slots").alias("mine"), F.max("pair.item_slots").alias("theirs")))
    line = W.partitionBy(*group).orderBy("place")                        # no more rows than the item has tokens
    begin = F.when(F.lag("place").over(line) == F.col("place") - 1, F.lit(None)).otherwise(F.col("place"))
    pairs = pairs.withColumn("begin", begin).withColumn("run", F.col("place") - F.last("begin", ignorenulls=True).over(line) + 1)
    slot = F.col("theirs") != 0
    runs = pairs.groupBy(*group).agg(F.count("*").alias("covered"), F.max("run").alias("run"), F.count_distinct(F.when(slot, F.col("theirs"))).alias("values_"),
                                     F.count_distinct(F.when(slot, F.col("mine"))).alias("mine_"), F.count_distinct(F.when(slot, F.struct("theirs", "mine"))).alias("slots"))
    consistent = F.when(F.col("slots") == 0, F.lit(1.0)).otherwise(F.least("values_", "mine_") / F.col("slots"))
    of = F.when(F.col("plain"), F.col("words")).otherwise(F.col("tokens"))
    enough = (F.col("covered") >= COVER * of) | F.col("plain") & (F.col("run") >= RUN)
    good = runs.withColumn("consistent", consistent).filter(enough & (F.col("consistent") >= CONSISTENT))
    best = F.max(F.struct((~F.col("plain")).alias("template"), "covered", "slots", "consistent", of.alias("of"))).alias("best")
    return good.groupBy("doc_id", "item_id", "tokens").agg(best).select("doc_id", "item_id", F.col("best.of").alias("tokens"), "best.covered", "best.slots", "best.consistent")


def drop_leaks(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """All columns of the rows whose text holds no benchmark item. Whether it does depends on the text alone, so the digest of the text is the key."""
    digest = F.sha2(F.col("text").cast("string"), 256)
    bad = leaks(docs, bench, digest).select(F.col("doc_id").alias("_digest")).distinct()
    return docs.withColumn("_digest", digest).join(bad, "_digest", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
