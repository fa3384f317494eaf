"""Grids, gaps, runs, counters, stations and sources on hand-made cases."""
import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from wattloom.functions import timeparts as TP
from wattloom.operators import clean as C, joins as J, rank as R
from wattloom.sources import readers as D

T0 = dt.datetime(2022, 1, 1)


def series(spark, vals, step=1800, key="a"):
    return spark.createDataFrame([(key, T0 + dt.timedelta(seconds=step * i), None if v is None else float(v)) for i, v in enumerate(vals)], "hh string, ts timestamp, v double")


def values(df, col):
    return [r[0] for r in df.orderBy("ts").select(col).collect()]


def test_limit_fills_from_each_side(spark):
    d = series(spark, [0, None, None, None, None, None, None, None, 8], 900)
    assert values(C.interpolate(d, ["hh"], "ts", "v", limit=3, step_seconds=900, edges=False), "v") == [0, 1, 2, 3, None, 5, 6, 7, 8]
    e = series(spark, [None, 1, None, 3, None], 900)
    assert values(C.interpolate(e, ["hh"], "ts", "v"), "v") == [1, 1, 2, 3, 3]
    assert values(C.interpolate(e, ["hh"], "ts", "v", edges=False), "v") == [None, 1, 2, 3, None]


def test_gap_fill_interpolates_short_and_donates_long(spark):
    base = np.tile(np.arange(48.0), 4)
    x = [float(v) + 100 * (i // 48) for i, v in enumerate(base)]
    x[10] = x[11] = None
    for i in range(2 * 48 + 5, 2 * 48 + 20):
        x[i] = None
    d = series(spark, x).withColumn("day", F.to_date("ts")).withColumn("slot", F.floor((F.hour("ts") * 60 + F.minute("ts")) / 30).cast("int"))
    t = F.element_at(F.create_map(*[F.lit(v) for i, tt in enumerate((5.0, 9.0, 8.5, 1.0)) for v in ((T0.date() + dt.timedelta(i)).isoformat(), tt)]), F.col("day").cast("string"))
    f = C.fill_gaps(d.withColumn("t", t).withColumn("off", F.lit(False)), ["hh"], "ts", "v", "t", "off", max_gap=4, slots_per_day=48)
    got = values(f, "filled")
    assert got[10] == 10 and got[11] == 11
    assert got[2 * 48 + 5:2 * 48 + 20] == [100.0 + s for s in range(5, 20)]            # day 1 is the nearest complete day
    assert f.first().n_donor_days == 1
    again = C.fill_gaps(f.drop("v", "n_donor_days").withColumnRenamed("filled", "v"), ["hh"], "ts", "v", "t", "off", 4, 48)
    assert values(again, "filled") == got and again.first().n_donor_days == 0


def test_spring_day_has_46_half_hours(spark):
    d = spark.range(0, 60).select(F.timestamp_seconds(F.lit(1648339200) + F.col("id") * 1800).alias("ts"))      # from 2022-03-27 00:00 UTC
    s = [r.slot for r in C.local_slots(d, "ts", "Europe/London", 30).where("day = '2022-03-27'").collect()]
    assert len(s) == 46 and 2 not in s and 3 not in s


def test_missing_and_repeated_local_times_become_null(spark):
    d = spark.createDataFrame([("2022-03-27 02:30:00",), ("2022-10-30 02:30:00",), ("2022-07-01 12:00:00",)], "s string").select(F.to_timestamp("s").alias("l"))
    out = [r[0] for r in d.select(F.date_format(TP.to_utc(F.col("l"), "Europe/Zurich"), "HH:mm")).collect()]
    assert out == [None, None, "10:00"]


def test_zero_runs_keep_switch_offs_and_flag_dropouts(spark):
    n = 200
    p, q = np.ones(n), np.zeros(n)
    p[10:30] = 0                       # real switch-off: no heat near it
    p[100:120] = 0
    q[105] = 0.5                       # heat inside the run
    d = spark.createDataFrame([("a", T0 + dt.timedelta(minutes=30 * i), float(p[i]), float(q[i]), 5.0) for i in range(n)], "hh string, ts timestamp, p double, q double, t double")
    r = C.zero_run_dropouts(d, ["hh"], "ts", "p", "q", "t", 1800).orderBy("start").collect()
    assert [(x.length, x.dropout) for x in r] == [(20, False), (20, True)]


def test_counters(spark):
    e = [0.0, .1, .2, .3, .2, .4, .5]                      # one reset
    d = series(spark, e, 120)
    c = C.counters_to_power(d, ["hh"], "ts", "v", 120, 10.0, 30, 3, 15).first()
    assert c.n == 5 and abs(c.kw - (0.1 * 3 + .2 + .1) * 2 * 15 / 5) < 1e-9


def test_interval_union_against_brute_force(spark):
    r = np.random.default_rng(0)
    iv = [("g", T0 + dt.timedelta(seconds=int(s)), T0 + dt.timedelta(seconds=int(s + l))) for s, l in zip(r.integers(0, 5000, 80), r.integers(1, 200, 80))]
    d = spark.createDataFrame(iv, "g string, a timestamp, b timestamp")
    got = R.union_length(d, ["g"], "a", "b", F.floor(F.unix_timestamp("a") / 600)).first().busy_seconds
    busy = set()
    for _, a, b in iv:
        busy |= set(range(int((a - T0).total_seconds()), int((b - T0).total_seconds())))
    assert got == len(busy)


def test_station_fill_uses_best_station_else_drops(spark):
    r = np.random.default_rng(0)
    days = [dt.date(2022, 1, 1) + dt.timedelta(i) for i in range(200)]
    base = 10 + 8 * np.sin(np.arange(200) / 20)
    near, far = base + r.normal(0, .1, 200), r.normal(10, 3, 200)
    rows = [("G0", d, float(v)) for d, v in zip(days, base)] + [("G1", d, float(v)) for d, v in zip(days, far)]
    rows += [("G2", d, float(2 + 0.5 * v)) for i, (d, v) in enumerate(zip(days, near)) if i >= 40] + [("G3", d, float(v)) for i, (d, v) in enumerate(zip(days, r.normal(0, 3, 200))) if i >= 40]
    log, filled = J.station_fill(spark.createDataFrame(rows, "station string, day date, t double"), 200)
    l = {x.station: x for x in log.collect()}
    assert l["G2"].action == "filled" and l["G2"].donor == "G0" and l["G3"].action == "dropped"
    f = filled.groupBy("station").agg(F.count("*").alias("n"), F.count_if("is_filled").alias("k")).collect()
    assert {x.station: (x.n, x.k) for x in f} == {"G0": (200, 0), "G1": (200, 0), "G2": (200, 40)}


def test_weather_groups_are_greedy_in_id_order(spark):
    days = [dt.date(2022, 1, 1) + dt.timedelta(i) for i in range(40)]
    off = {"h1": 0.0, "h2": 0.15, "h3": 0.30, "h4": 5.0}           # h3 is near h2 but not near the leader h1
    rows = [(h, d, 10 + o) for h, o in off.items() for d in days] + [("h0", d, 1.0) for d in days[:10]]
    g = {x.home: x.grp for x in J.weather_groups(spark.createDataFrame(rows, "home string, day date, t double")).collect()}
    assert g == {"h0": "G_none", "h1": "G000", "h2": "G000", "h3": "G001", "h4": "G002"}


def test_analog_rules(spark):
    r = np.random.default_rng(0)
    mk = lambda a, n: spark.createDataFrame([(0, a + dt.timedelta(i), float(np.round(10 - 8 * np.cos(2 * np.pi * (a + dt.timedelta(i)).timetuple().tm_yday / 365) + r.normal(0, 2), 2)),
                                              (a + dt.timedelta(i)).weekday() >= 5) for i in range(n)], "station int, day date, t double, off boolean")
    tgt, cand = mk(dt.date(2021, 10, 1), 365), mk(dt.date(2012, 7, 1), 600)
    m = J.analog_map(tgt, cand, ["station"], 0).collect()
    T, Cn = {x.day: x for x in tgt.collect()}, {x.day: x for x in cand.collect()}
    assert len(m) == 365
    for x in m:
        a, b = T[x.day], Cn[x.src]
        assert a.off == b.off and x.ddoy <= (30, 45, 60, 60)[x.widen]
        dd = lambda c: min(abs(c.timetuple().tm_yday - x.day.timetuple().tm_yday), abs(365 - abs(c.timetuple().tm_yday - x.day.timetuple().tm_yday)))
        near = [c for c in Cn.values() if c.off == a.off and abs(c.t - a.t) <= 1]
        want = next((i for i, w in enumerate((30, 45, 60)) if any(dd(c.day) <= w for c in near)), 3)
        assert x.widen == want
        pool = [c for c in (near if want < 3 else [c for c in Cn.values() if c.off == a.off]) if dd(c.day) <= (30, 45, 60, 60)[want]]
        assert x.src in {c.day for c in sorted(pool, key=lambda c: (abs(c.t - a.t), c.day))[:3]}


def test_scan_reads_only_what_it_needs(spark):
    s = D.scan_channels(spark, "/root/testdata/sf0.001/lineitem.parquet", ["l_quantity"], "l_suppkey", "l_shipdate", "1996-01-01", "1996-02-01")
    plan = s._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" not in plan and "PushedFilters: [" in plan and "GreaterThanOrEqual(l_shipdate" in plan


def test_silent_heat_near_zero_runs_against_brute_force(spark):
    r = np.random.default_rng(8)
    for step, context in ((3600, 24), (1800, 2), (3600, 0)):
        n = 1200
        p, q = np.where(r.random(n) < 0.5, 0.0, 1.0), np.zeros(n)
        for a in r.integers(0, n - 40, 14):
            p[a:a + r.integers(10, 40)] = 0
        q[r.integers(0, n, 6)] = 2.0
        d = spark.createDataFrame([("a", T0 + dt.timedelta(seconds=step * i), float(p[i]), float(q[i]), 5.0) for i in range(n)], "hh string, ts timestamp, p double, q double, t double")
        got = C.zero_run_dropouts(d, ["hh"], "ts", "p", "q", "t", step, context=context).orderBy("start").collect()
        edge = np.flatnonzero(np.diff(np.r_[1, p != 0, 1].astype(int)))
        runs = [(a, b) for a, b in zip(edge[::2], edge[1::2]) if b - a >= 12]
        silent = np.flatnonzero((q > 1) & (p < 0.02))
        assert [x.near_silent for x in got] == [bool(((silent >= a - context) & (silent <= b - 1 + context)).any()) for a, b in runs] and len(got) > 5


def test_grid_is_not_broadcast(spark):
    """A filter on the readings makes the join an inner one, and the planner takes the grid for as small as its entities."""
    d = spark.range(50).select(F.col("id").alias("hh"), F.lit(T0).alias("ts"), F.lit(1.0).alias("v"))
    g = C.complete_grid(d, ["hh"], "ts", "2022-01-01 00:00:00", "2022-03-01 00:00:00", "1 hour").where("v > 0")
    assert "Broadcast" not in g._jdf.queryExecution().executedPlan().toString()
