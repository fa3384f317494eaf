"""Slot-level targets, high quantiles, n-of-n bootstraps and the two-armed fit against brute force."""
import datetime
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattloom.functions.scan import high_quantile
from wattloom.operators import audits as U, cohorts as K, hinge as H

DAY = datetime.date(2023, 1, 1)


def day(i):
    return DAY + datetime.timedelta(days=int(i))


def test_high_quantile_equals_numpy(spark):
    rng = np.random.default_rng(0)
    values = {"a": rng.integers(0, 50, (400, 6)).astype(float), "hot": rng.normal(size=(3000, 6)), "one": np.array([[1.0, np.nan, 3.0, 3.0, np.nan, 2.0]])}
    rows = [(k, i, [None if np.isnan(x) and i % 2 else float(x) for x in r]) for k, v in values.items() for i, r in enumerate(v)] + [("none", 0, [None] * 6)]
    d = spark.createDataFrame(rows, "k string, i int, v array<double>")
    for q in (0.999, 0.95, 1.0):
        got = {r.k: (r.n, r.x) for r in high_quantile(d, ["k"], "v", F.floor(F.col("i") / 100), q, "x").collect()}
        assert got == {k: (int((~np.isnan(v)).sum()), pytest.approx(np.nanquantile(v, q), rel=1e-12)) for k, v in values.items()}


def substations(spark, slots=4):
    """Members of three substations (one household in all of them), their day arrays, and the same as numpy arrays."""
    rng = np.random.default_rng(1)
    members = [("s0", "h0", "hp"), ("s0", "f0", "fill"), ("s0", "h1", "hp"), ("s1", "h1", "hp"), ("s1", "f1", "fill"), ("s2", "h1", "hp"), ("s2", "f0", "fill"), ("s2", "f1", "fill")]
    hp, own = ({h: rng.uniform(0, 3, (300, slots)) * (h[0] == "h" or name == "own") for h in ("h0", "h1", "f0", "f1")} for name in ("hp", "own"))
    rows = [(h, day(i), hp[h][i].tolist(), own[h][i].tolist()) for h in hp for i in range(300)]
    m = spark.createDataFrame(members, "sub_id string, hh string, role string")
    return members, hp, own, m, spark.createDataFrame(rows, "hh string, day date, hp_slots array<double>, own_slots array<double>")


def test_sums_of_slots_and_their_peaks(spark):
    members, hp, own, m, r = substations(spark)
    got = K.aggregate_slots(m, r, 4).collect()
    assert len(got) == 3 * 300
    for x in got:
        i = (x.day - DAY).days
        h = sum(hp[a][i] for s, a, role in members if s == x.sub_id and role == "hp")
        n = h + sum(own[a][i] for s, a, _ in members if s == x.sub_id)
        assert np.allclose(x.hp_slots, h) and np.allclose(x.net_slots, n) and np.allclose(x.nonhp_slots, n - h)
        assert np.allclose((x.hp, x.net, x.hp_max, x.net_max), (h.mean(), n.mean(), h.max(), n.max()))


def test_targets_take_maxima_of_sums(spark):
    members, hp, own, m, r = substations(spark)
    m = m.withColumns({"seed": F.lit(0), "split": F.lit("train"), "fold": F.lit(-1), "station": F.lit(0), "size": F.lit(3), "p": F.lit(0.5), "n_hp": F.lit(1)})
    d = K.aggregate_slots(m, r, 4).withColumn("t", (10 - F.datediff("day", F.lit("2023-01-01")) / 20.0))
    peaks = spark.createDataFrame([("h0", 2.5), ("h1", 2.0)], "hh string, hp_peak double")
    got = {x.sub_id: x for x in K.targets(m, d, peaks).collect()}
    for s in ("s0", "s1", "s2"):
        h = sum(hp[a] for q, a, role in members if q == s and role == "hp")
        n = h + sum(own[a] for q, a, _ in members if q == s)
        assert got[s].HP_CoincPeak == pytest.approx(h.max()) and got[s].peak == pytest.approx(n.max())
        assert got[s].HP_Peak == pytest.approx(4.5 if s == "s0" else 2.0) and got[s].HP_CoincPeak <= sum(hp[a].max() for q, a, role in members if q == s and role == "hp") + 1e-9


def test_load_profiles_keep_the_day(spark):
    from wattloom.sources import tables as X
    r = X.slot_readings(spark, "/root/testdata/sf0.001").limit(200).collect()
    assert len(r) == 200 and all(len(x.hp_slots) == X.SLOTS and np.isclose(np.mean(x.hp_slots), x.hp) and np.isclose(np.mean(x.own_slots), x.own) and min(x.own_slots) >= 0 for x in r)


# ------------------------------------------------------------------ bootstrap
def plain_bootstrap(e, order, key, n_boot, block):
    """Replicate means and weights of one key, draw by draw."""
    n, out, weights = len(order), [], []
    for b in range(n_boot):
        per_block = Counter(int(U.draws(np.int64(key + b), np.int64(j), n)) // block for j in range(n))
        w = Counter()
        for k, m in per_block.items():
            for i in range(m):
                w[k * block + int(U.draws(U.mix32(np.int64(key + b)) + np.int64(k + 1), np.int64(i), min(block, n - k * block)))] += 1
        weights.append(w)
        out.append(sum(c * e[order[at]] for at, c in w.items()) / n * 100)
    return np.array(out), weights


def test_row_bootstrap_draws_n_of_n(spark):
    from hashlib import md5
    rng = np.random.default_rng(2)
    y, p = rng.uniform(1, 5, 60), rng.uniform(1, 5, 60)
    rows = [("a" if i % 3 else "b", i, float(y[i]), float(p[i])) for i in range(60)] + [("a", 100, 0.0, 1.0), ("a", 101, None, 1.0), ("b", 102, 1.0, None)]
    d = spark.createDataFrame(rows, "k string, i long, y double, p double")
    got = {r.k: r for r in U.row_bootstrap(d, ["k"], "i", 30, 5, "y", "p", block=7, at_once=11).collect()}
    for k in "ab":
        ids = [i for i in range(60) if (i % 3 > 0) == (k == "a")]
        ids.sort(key=lambda i: md5(f"5|{i}".encode()).hexdigest())
        m, weights = plain_bootstrap(np.abs(p - y) / y, ids, int(md5(f"5|{k}".encode()).hexdigest()[:8], 16), 30, 7)
        assert all(w.total() == len(ids) for w in weights) and (got[k].n_least, got[k].n_most) == (len(ids), len(ids))
        assert (got[k].lo, got[k].hi, got[k].sd) == pytest.approx((np.quantile(m, 0.025), np.quantile(m, 0.975), m.std(ddof=1)), rel=1e-9)


def test_bootstrap_spread_is_that_of_the_mean(spark):
    rng = np.random.default_rng(6)
    e = rng.exponential(1, 3000)
    d = spark.createDataFrame([("a", i, 1.0, float(1 + x)) for i, x in enumerate(e)], "k string, i long, y double, p double")
    r = U.row_bootstrap(d, ["k"], "i", 600, 0, "y", "p", block=256).first()
    assert r.sd == pytest.approx(100 * e.std() / np.sqrt(len(e)), rel=0.1) and r.lo < 100 * e.mean() < r.hi


def test_draws_are_even():
    at = U.draws(np.int64(77), np.arange(200_000), 50)
    count = np.bincount(at, minlength=50)
    assert at.min() == 0 and at.max() == 49 and ((count - 4000) ** 2 / 4000).sum() < 90


# ------------------------------------------------------------------ bathtub
def least_error(T, Y, a, b):
    best, A = np.inf, np.c_[np.ones_like(T), np.maximum(0, a - T), np.maximum(0, T - b)]
    for m in range(8):
        c = [i for i in range(3) if m >> i & 1]
        x = np.linalg.lstsq(A[:, c], Y, rcond=None)[0] if c else np.zeros(0)
        if (x >= -1e-12).all():
            best = min(best, ((Y - A[:, c] @ x) ** 2).sum())
    return best


def test_bathtub_is_never_above_a_fine_grid(spark):
    rng, series = np.random.default_rng(3), {}
    for i in range(10):
        n = int(rng.integers(6, 90))
        T = np.round(rng.uniform(-10, 35, n), 3 if i % 2 else 0)
        Y = rng.uniform(-1, 4) + rng.uniform(-.2, .8) * np.maximum(0, rng.uniform(5, 22) - T) + rng.uniform(-.2, .6) * np.maximum(0, T - rng.uniform(14, 30)) + rng.normal(0, .3 if i % 3 else 2, n)
        series[str(i)] = (T, np.maximum(0, Y))
    series["flat"] = (np.arange(5.0), np.full(5, 2.0))
    series["one"] = (np.array([10.0]), np.array([1.0]))
    rows = [(k, float(a), float(b)) for k, (T, Y) in series.items() for a, b in zip(T, Y)] + [("0", None, 1.0), ("0", 1.0, None)]
    got = {r.e: r for r in H.fit_bathtub(spark.createDataFrame(rows, "e string, t double, y double"), ["e"]).collect()}
    assert got.keys() == series.keys()
    for k, (T, Y) in series.items():
        r = got[k]
        grid = min(least_error(T, Y, a, b) for a in np.arange(8, 20.01, 0.4) for b in np.arange(a, 36.01, 0.6))
        fit = r.P_base + r.s_heat * np.maximum(0, (r.T_heat or 0) - T) + r.s_cool * np.maximum(0, T - (r.T_cool or 0))
        assert r.sse <= grid + 1e-6 and r.sse == pytest.approx(((Y - fit) ** 2).sum(), abs=1e-6) and min(r.P_base, r.s_heat, r.s_cool) >= 0
        assert r.T_heat is None or r.T_cool is None or 0 <= r.T_cool - r.T_heat <= 24


def test_bootstrap_replicates_are_dealt_to_many_tasks(spark):
    """Few keys don't put all replicates into one task."""
    d = spark.range(200).select(F.col("id").alias("i"), F.lit("a").alias("k"), (F.col("id") + 1.0).alias("y"), (F.col("id") * 1.1).alias("p"))
    plan = U.row_bootstrap(d, ["k"], "i", 40, 0, "y", "p", block=16)._jdf.queryExecution().executedPlan().toString()
    units = plan[plan.index("MapInArrow"):].split("Exchange")[1]
    assert "REPARTITION_BY_NUM" in units and int(units.split("_b#")[1].split(", ")[1].rstrip(")")) > 1
