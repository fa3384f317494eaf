"""Ordered scans whose work is split inside a key, and exact quantiles of groups of any size.

A plain window over one meter runs in one task. Here a key is cut into chunks that follow the order
(days, weeks), each chunk is scanned by its own task, and only one summary row per chunk is carried
across chunk borders."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

DAY = 86400


def time_chunk(ts: str | Column, seconds: int = 7 * DAY) -> Column:
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.floor(F.unix_timestamp(c) / seconds)


def chunked_scan(df: DataFrame, keys: list[str], order: list[str], chunk: Column, outs: dict[str, tuple[str, Column]]) -> DataFrame:
    """Add one column per entry of `outs` = {name: (kind, column)}.

    kinds: last  - latest non-NULL value up to and including the row
           prev  - latest non-NULL value strictly before the row
           next  - earliest non-NULL value from the row on
           sum / max - running aggregate up to and including the row
           before_max - running maximum strictly before the row
    `chunk` must be monotone in `order`; key columns must not be NULL."""
    d = df.withColumn("_c", chunk)
    for i, (kind, col) in enumerate(outs.values()):
        d = d.withColumn(f"_v{i}", col)
    at = [F.col(o) for o in order]
    aggs = []
    for i, (kind, _) in enumerate(outs.values()):
        v = F.col(f"_v{i}")
        if kind in ("last", "prev"):
            aggs.append(F.max(F.when(v.isNotNull(), F.struct(*at, v.alias("v")))).getField("v").alias(f"_s{i}"))
        elif kind == "next":
            aggs.append(F.min(F.when(v.isNotNull(), F.struct(*at, v.alias("v")))).getField("v").alias(f"_s{i}"))
        else:
            aggs.append((F.sum(v) if kind == "sum" else F.max(v)).alias(f"_s{i}"))
    before = W.partitionBy(*keys).orderBy("_c").rowsBetween(W.unboundedPreceding, -1)
    # looking ahead is a running window in descending order: a frame that ends at the last row is re-read for every row
    after = W.partitionBy(*keys).orderBy(F.desc("_c")).rowsBetween(W.unboundedPreceding, -1)
    over_chunks = {"last": lambda s: F.last(s, True).over(before), "prev": lambda s: F.last(s, True).over(before),
                   "next": lambda s: F.last(s, True).over(after), "sum": lambda s: F.sum(s).over(before),
                   "max": lambda s: F.max(s).over(before), "before_max": lambda s: F.max(s).over(before)}
    carry = (d.groupBy(*keys, "_c").agg(*aggs)
             .select(*keys, "_c", *[over_chunks[k](F.col(f"_s{i}")).alias(f"_k{i}") for i, (k, _) in enumerate(outs.values())]))
    # a key's chunks go to different tasks even when the input is already partitioned by the key alone; their number is fixed, as rows that
    # compress well to few bytes would else be put together to tasks of many rows
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 16 * spark.sparkContext.defaultParallelism)
    d = d.repartition(tasks, *keys, "_c").join(carry, keys + ["_c"], "left")
    part = W.partitionBy(*keys, "_c").orderBy(*order)
    upto, strict = part.rowsBetween(W.unboundedPreceding, 0), part.rowsBetween(W.unboundedPreceding, -1)
    onward = W.partitionBy(*keys, "_c").orderBy(*[F.desc(o) for o in order]).rowsBetween(W.unboundedPreceding, 0)
    made = []
    for i, (name, (kind, _)) in enumerate(outs.items()):
        v, k = F.col(f"_v{i}"), F.col(f"_k{i}")
        made.append({
            "last": lambda: F.coalesce(F.last(v, True).over(upto), k),
            "prev": lambda: F.coalesce(F.last(v, True).over(strict), k),
            "next": lambda: F.coalesce(F.last(v, True).over(onward), k),
            "sum": lambda: F.coalesce(F.sum(v).over(upto), F.lit(0)) + F.coalesce(k, F.lit(0)),
            "max": lambda: F.greatest(F.max(v).over(upto), k),
            "before_max": lambda: F.greatest(F.max(v).over(strict), k),
        }[kind]().alias(name))
    keep = [c for c in df.columns if c not in outs]
    return d.select(*keep, *made)


def high_quantile(df: DataFrame, keys: list[str], values: str, part: Column, q: float, out: str) -> DataFrame:
    """Exact linear-interpolation quantile near the top of all values in an array column, per key.

    Each part of a key (`part`, such as a month) hands on only its largest values, as many as can hold a wanted rank; the parts' short lists
    are merged once. The work per part is bounded by the part, whatever share of the rows a key holds. NULL and NaN values don't count."""
    d = df.select(*keys, part.alias("_part"), F.filter(values, lambda x: x.isNotNull() & ~F.isnan(x)).alias("_v"))
    n = d.groupBy(*keys).agg(F.sum(F.size("_v")).alias("n"))
    down = lambda a: F.reverse(F.array_sort(a))
    lists = d.groupBy(*keys, "_part").agg(F.flatten(F.collect_list("_v")).alias("_v")).join(n, keys)
    rank = F.lit(float(q)) * (F.col("n") - 1)
    k = (F.col("n") - F.floor(rank)).cast("int")                              # the kth largest is at or below the wanted rank
    top = lists.select(*keys, "n", F.slice(down(F.col("_v")), F.lit(1), k).alias("_v"))
    g = top.groupBy(*keys, "n").agg(down(F.flatten(F.collect_list("_v"))).alias("_v")).where("n > 0")
    lo, hi = F.element_at("_v", k), F.element_at("_v", F.greatest(k - 1, F.lit(1)))
    return g.select(*keys, F.col("n").cast("bigint").alias("n"), (lo + (hi - lo) * (rank - F.floor(rank))).alias(out))


def exact_quantiles(df: DataFrame, keys: list[str], value: str, qs: dict[str, float], cuts: int = 64) -> DataFrame:
    """Exact linear-interpolation quantiles per key without holding a key's values in one task.

    Equal values are counted first (map-side), each key is split at approximate quantiles into
    `cuts` value ranges, and only the ranges that contain a wanted rank are ranked."""
    v = (df.select(*keys, F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL AND NOT isnan(_v)"))
    marks = v.groupBy(*keys).agg(F.percentile_approx("_v", [i / cuts for i in range(1, cuts)], 10 * cuts).alias("_m"))
    counted = v.groupBy(*keys, "_v").agg(F.count("*").alias("_cnt"))
    b = counted.join(marks, keys).withColumn("_b", F.size(F.filter("_m", lambda c: c < F.col("_v")))).drop("_m")
    wb = W.partitionBy(*keys).orderBy("_b")
    tot = (b.groupBy(*keys, "_b").agg(F.sum("_cnt").alias("_bn"))
           .withColumn("_off", F.sum("_bn").over(wb) - F.col("_bn"))
           .withColumn("_tot", F.sum("_bn").over(W.partitionBy(*keys))))
    rank = {n: F.lit(float(q)) * (F.col("_tot") - 1) for n, q in qs.items()}
    hit = None
    for r in rank.values():
        for p in (F.floor(r), F.ceil(r)):
            h = (p >= F.col("_off")) & (p < F.col("_off") + F.col("_bn"))
            hit = h if hit is None else hit | h
    cum = F.sum("_cnt").over(W.partitionBy(*keys, "_b").orderBy("_v"))
    picked = (b.join(tot.where(hit), keys + ["_b"])
              .withColumn("_hi", F.col("_off") + cum).withColumn("_lo", F.col("_hi") - F.col("_cnt")))
    at = lambda p: F.max(F.when((p >= F.col("_lo")) & (p < F.col("_hi")), F.col("_v")))
    g = picked.groupBy(*keys).agg(F.max("_tot").alias("n"), *[a for n, r in rank.items() for a in
                                  (at(F.floor(r)).alias(f"_a_{n}"), at(F.ceil(r)).alias(f"_b_{n}"))])
    frac = {n: F.lit(float(q)) * (F.col("n") - 1) - F.floor(F.lit(float(q)) * (F.col("n") - 1)) for n, q in qs.items()}
    return g.select(*keys, F.col("n").cast("bigint").alias("n"),
                    *[(F.col(f"_a_{n}") + (F.col(f"_b_{n}") - F.col(f"_a_{n}")) * frac[n]).alias(n) for n in qs])
