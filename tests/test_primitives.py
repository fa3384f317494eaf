"""Ordered scans, exact quantiles, hash ranks and draws against plain windows and numpy, with one key holding a third of the rows."""
import datetime as dt

import numpy as np
from pyspark.sql import Window as W, functions as F

from wattloom.functions.hashing import digest, draw_positions, hash_rank
from wattloom.functions import stats as S
from wattloom.functions.scan import chunked_scan, exact_quantiles


def skewed(spark, n=6000):
    r = np.random.default_rng(0)
    key = np.where(r.random(n) < 0.34, 0, r.integers(1, 20, n))
    rows = [(int(k), i, None if r.random() < 0.4 else float(np.round(v, 1))) for i, (k, v) in enumerate(zip(key, r.normal(0, 1, n)))]
    return spark.createDataFrame(rows, "k int, o long, v double"), rows


def test_scans_equal_plain_windows(spark):
    d, _ = skewed(spark)
    outs = {"l": ("last", F.col("v")), "p": ("prev", F.col("v")), "n": ("next", F.col("v")), "s": ("sum", F.col("v")), "m": ("max", F.col("v")), "b": ("before_max", F.col("v"))}
    got = chunked_scan(d, ["k"], ["o"], F.floor(F.col("o") / 500), outs)
    w = W.partitionBy("k").orderBy("o")
    up, st, on = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(W.unboundedPreceding, -1), w.rowsBetween(0, W.unboundedFollowing)
    want = d.select("k", "o", F.last("v", True).over(up).alias("l"), F.last("v", True).over(st).alias("p"), F.first("v", True).over(on).alias("n"),
                    F.coalesce(F.sum("v").over(up), F.lit(0.0)).alias("s"), F.max("v").over(up).alias("m"), F.max("v").over(st).alias("b"))
    a = {(r.k, r.o): r for r in got.collect()}
    for r in want.collect():
        g = a[(r.k, r.o)]
        assert (g.l, g.p, g.n, g.m, g.b) == (r.l, r.p, r.n, r.m, r.b)
        assert abs(g.s - r.s) < 1e-9


def test_quantiles_equal_numpy_with_ties_and_hot_key(spark):
    d, rows = skewed(spark)
    got = exact_quantiles(d, ["k"], "v", {"a": 0.05, "m": 0.5, "z": 0.999}, cuts=8).collect()
    for r in got:
        x = [v for k, _, v in rows if k == r.k and v is not None]
        assert r.n == len(x)
        assert np.allclose([r.a, r.m, r.z], np.quantile(x, [0.05, 0.5, 0.999]))


def test_rank_equals_row_number(spark):
    d, _ = skewed(spark)
    key = digest(F.lit("t"), F.col("o"))
    got = {(r.k, r.o): (r.pos, r.pool_size) for r in hash_rank(d.select("k", "o"), ["k"], key).collect()}
    want = d.select("k", "o", (F.row_number().over(W.partitionBy("k").orderBy(key)) - 1).alias("p"), F.count("*").over(W.partitionBy("k")).alias("n"))
    assert all(got[(r.k, r.o)] == (r.p, r.n) for r in want.collect())


def test_draws_are_distinct_and_complete(spark):
    cells = spark.range(1, 60).select(F.col("id").alias("N"), F.concat(F.lit("c"), F.col("id").cast("string")).alias("c"))
    for take in (F.col("N"), F.ceil(F.col("N") / 2)):
        g = draw_positions(cells, take, F.col("N"), F.col("c")).groupBy("N").agg(F.count("*").alias("n"), F.count_distinct("pos").alias("u"), F.max("pos").alias("m")).collect()
        assert all(r.n == r.u and r.m < r.N for r in g) and len(g) == 59


def test_every_subset_is_drawn_alike(spark):
    """All 252 subsets of 5 out of 10 occur, as often as chance has it (chi-square, 251 degrees: 99.9 % below 326)."""
    cells = spark.range(20160).select(F.concat(F.lit("cell"), F.col("id").cast("string")).alias("c"))
    g = draw_positions(cells, F.lit(5), F.lit(10), F.col("c")).groupBy("c").agg(F.array_sort(F.collect_list("pos")).alias("s")).groupBy("s").count().collect()
    assert len(g) == 252
    assert sum((r["count"] - 80) ** 2 / 80 for r in g) < 326


def test_result_does_not_depend_on_partitions(spark):
    d, _ = skewed(spark)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    out = []
    for p in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", p)
        out.append(sorted(map(tuple, exact_quantiles(d, ["k"], "v", {"m": 0.5}).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", old)
    assert out[0] == out[1]


def test_dates(spark):
    from wattloom.functions.holidays import easter_sunday, is_holiday, weekend_or_holiday
    e = spark.createDataFrame([(2019,), (2022,), (2023,), (2024,)], "y int").select(easter_sunday(F.col("y")).alias("e")).collect()
    assert [r.e for r in e] == [dt.date(2019, 4, 21), dt.date(2022, 4, 17), dt.date(2023, 4, 9), dt.date(2024, 3, 31)]
    d = spark.createDataFrame([(dt.date(2019, 5, 30),), (dt.date(2020, 6, 1),), (dt.date(2022, 1, 2),), (dt.date(2023, 8, 2),)], "d date")
    assert [r[0] for r in d.select(is_holiday(F.col("d"), "CH-ZH")).collect()] == [True, True, False, False]
    assert [r[0] for r in d.select(is_holiday(F.col("d"), "CH-ZH+2")).collect()] == [True, True, True, False]
    gb = [(2022, 6, 2, True), (2022, 6, 3, True), (2022, 9, 19, True), (2022, 6, 1, False), (2022, 6, 6, False), (2022, 8, 29, True), (2022, 6, 4, True), (2022, 5, 30, False),
          (2021, 12, 27, True), (2021, 12, 28, True), (2022, 1, 3, True), (2022, 12, 27, True), (2022, 12, 28, False)]
    g = spark.createDataFrame([(dt.date(*x[:3]),) for x in gb], "d date").select(weekend_or_holiday(F.col("d"), "GB-ENG")).collect()
    assert [r[0] for r in g] == [x[3] for x in gb]


def test_correlation_without_spread_is_null(spark):
    rows = [(1, 2.0, 1.0), (1, 2.0, 3.0), (1, 2.0, 8.0), (2, 1.0, 4.0), (2, 3.0, 4.0), (3, 1.0, 2.0), (3, 2.0, 3.0), (3, 4.0, 9.0), (3, None, 5.0), (4, 5.0, 5.0)]
    d = spark.createDataFrame(rows, "k int, x double, y double")
    got = {r.k: (r.a, r.b) for r in d.groupBy("k").agg(S.corr("x", "y").alias("a"), S.corr_guarded("x", "y").alias("b")).collect()}
    want = np.corrcoef([1, 2, 4], [2, 3, 9])[0, 1]
    assert got[1] == got[2] == got[4] == (None, None)
    assert abs(got[3][0] - want) < 1e-12 and abs(got[3][1] - want) < 1e-12
