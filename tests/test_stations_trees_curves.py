"""Donor stations, weather groups, windowed features, extra trees, out-of-fold families and learning-curve verdicts against plain loops."""
import datetime as dt
from hashlib import md5

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wattloom.operators import aggregate as A, estimators as E, extra_trees as XT, joins as J, models as M, verdicts as V

D0 = dt.date(2022, 1, 1)


# ------------------------------------------------------------------ stations
def test_donors_over_many_blocks_equal_plain_correlations(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(4, 150)).cumsum(1)
    series = {f"s{i:02d}": base[i % 4] * rng.uniform(0.5, 2) + rng.normal(0, 0.5 + i % 3, 150) + 100 for i in range(14)}
    series["flat"] = np.full(150, 5.0)
    there = {s: rng.random(150) < (0.9 if i % 2 else 0.7) for i, s in enumerate(series)}
    there["short"], series["short"] = np.arange(150) < 20, series["s00"]
    rows = [(s, D0 + dt.timedelta(int(i)), float(v[i])) for s, v in series.items() for i in np.flatnonzero(there[s])]
    d = spark.createDataFrame(rows, "station string, day date, t double")
    bad, ok = [s for i, s in enumerate(series) if i % 2 == 0], [s for i, s in enumerate(series) if i % 2]
    one = lambda x: spark.createDataFrame([(s,) for s in x], "station string")
    got = {r.station: r for r in J.donors(d, one(bad), one(ok), 60, size=3).collect()}
    for s in bad:
        best = None
        for o in ok:
            m = there[s] & there[o]
            if m.sum() >= 60 and series[s][m].std() > 0 and series[o][m].std() > 0:
                r = np.corrcoef(series[s][m], series[o][m])[0, 1]
                best = max(best or (-9, ""), (r, o))
        if best is None:
            assert s not in got
            continue
        m = there[s] & there[best[1]]
        b, a = np.polyfit(series[best[1]][m], series[s][m], 1)
        assert (got[s].donor, got[s].n_days_fit) == (best[1], m.sum()) and (got[s].corr, got[s].a, got[s].b) == pytest.approx((best[0], a, b), rel=1e-9, abs=1e-9)


def test_slots_are_filled_where_the_donor_has_them(spark):
    t = lambda i, k: float(10 + 5 * np.sin(i / 9) + k)
    rows = [("a", D0 + dt.timedelta(i), k, t(i, k)) for i in range(100) for k in range(4)]
    rows += [("b", D0 + dt.timedelta(i), k, 2 * t(i, k) + 1) for i in range(100) for k in range(4) if i >= 12 and (i, k) != (50, 2)]
    log, filled = J.slot_station_fill(spark.createDataFrame(rows, "station string, day date, slot int, t double"), 4, 3)
    r = log.first()
    assert (r.station, r.donor, r.action, r.n_bins_filled) == ("b", "a", "filled", 12 * 4 + 1) and r.missing_share == pytest.approx(49 / 400)
    x = {(f.station, (f.day - D0).days, f.slot): f for f in filled.collect()}
    assert len(x) == 800 and x["b", 50, 2].t == pytest.approx(2 * t(50, 2) + 1, abs=0.1) and x["b", 50, 2].is_filled and not x["b", 50, 1].is_filled


@pytest.mark.parametrize("batch", [1, 3, 64])
def test_weather_groups_equal_the_one_by_one_rule(spark, batch):
    rng = np.random.default_rng(5)
    level = {f"h{i:02d}": round(float(rng.uniform(0, 1.2)), 3) for i in range(18)}
    noise = {h: rng.normal(0, 0.05, 40) for h in level}
    rows = [(h, D0 + dt.timedelta(i), v + float(noise[h][i])) for h, v in level.items() for i in range(40)] + [("h99", D0, 1.0)]
    reps, want = {}, {"h99": "G_none"}
    for h in sorted(level):
        g = next((g for g, r in reps.items() if np.median(np.abs(level[h] + noise[h] - level[r] - noise[r])) < 0.2), None)
        if g is None:
            g = f"G{len(reps):03d}"
            reps[g] = h
        want[h] = g
    got = {r.home: r.grp for r in J.weather_groups(spark.createDataFrame(rows, "home string, day date, t double"), batch=batch).collect()}
    assert got == want and len(reps) > 2


# ------------------------------------------------------------------ windowed features
def test_cells_equal_pandas(spark):
    rng = np.random.default_rng(1)
    ts = pd.date_range("2022-01-03", periods=24 * 30, freq="h")
    p = pd.DataFrame({"ts": ts, "t": 8 + 6 * np.sin(np.arange(len(ts)) / 40) + rng.normal(0, 1, len(ts)), "y": rng.gamma(2, 1, len(ts))})
    p["day"], p["win"] = p.ts.dt.date, np.select([p.ts.dt.hour < 6, p.ts.dt.hour < 10, p.ts.dt.hour < 16], ["night", "morning", "day"], "evening")
    p["h"] = np.maximum(0, 12 - p.t)
    sev = p.groupby("day").h.sum()
    p["bin"] = np.select([p.day.map(sev) <= 0, p.day.map(sev) <= 60, p.day.map(sev) <= 120], ["warm", "mild", "cold"], "extreme")
    d = spark.createDataFrame(p[["ts", "t", "y"]].assign(k="a"))
    long = A.day_windows(d, ["k"], "ts", "t", "y", 12.0, 1.0, 60.0, 120.0)
    cells, names = A.cell_statistics(long, ["k"], with_corr=True)
    got = {(r.window, r.bin): r.asDict() for r in cells.collect()}
    want = p.groupby(["win", "bin"])
    assert got.keys() == set(want.groups)
    for key, g in want:
        r, y = got[key], g.y
        exact = {"Mean": y.mean(), "Std": y.std(), "Min": y.min(), "Max": y.max(), "Max-Min": y.max() - y.min(), "Skew": y.skew(), "Kurtosis": y.kurt(), "N_obs": len(y), "Q50": y.quantile(.5), "Q95": y.quantile(.95),
                 "N_days": g.day.nunique(), "Cov_Temp": y.cov(g.t), "Corr_Temp": y.corr(g.t), "Cov_HDH": y.cov(g.h), "Corr_HDH": y.corr(g.h) if g.h.std() > 0 else None}
        assert set(exact) == set(names)
        for n, v in exact.items():
            assert (r[n] is None) if v is None or np.isnan(v) else r[n] == pytest.approx(v, rel=1e-8, abs=1e-9), n


def test_arrays_and_slots_give_the_same_features(spark):
    rng = np.random.default_rng(2)
    rows = [("a", D0 + dt.timedelta(i), 4.0 + i % 11, rng.uniform(0, 5, 48).tolist()) for i in range(40)]
    days = spark.createDataFrame(rows, "k string, day date, t double, v array<double>")
    slots = days.select("k", "t", "day", F.posexplode("v").alias("i", "y")).withColumn("ts", F.timestamp_seconds(F.unix_timestamp(F.col("day").cast("timestamp")) + F.col("i") * 1800))
    a = A.wide_features(A.array_windows(days, ["k"], "day", "t", "v", 48, 12.0, 60.0, 120.0), ["k"], climate=True).first().asDict()
    b = A.windowed_features(slots, ["k"], "ts", "t", "y", 12.0, 60.0, 120.0, 0.5, weekday_only=False, climate=True).first().asDict()
    assert a.keys() == b.keys() and a["Feature N_weekdays"] == 40
    for n in a:
        assert a[n] == b[n] or a[n] == pytest.approx(b[n], rel=1e-9, abs=1e-12), n


def test_slots_between_first_and_last_value_are_filled(spark):
    at = lambda m: dt.datetime(2022, 1, 1) + dt.timedelta(minutes=m)
    rows = [("a", at(1), 1.0, 5.0), ("a", at(8), 3.0, None), ("a", at(46), 7.0, None), ("a", at(20000), 9.0, 6.0), ("a", at(20020), None, 7.0), ("b", at(0), None, 1.0)]
    got = [(r.ts, r.y, r.t) for r in A.regular_slots(spark.createDataFrame(rows, "k string, ts timestamp, y double, t double"), ["k"], "ts", ["y", "t"], 15).orderBy("ts").collect()]
    assert got[:4] == [(at(0), 2.0, 5.0), (at(15), 2.0, 5.0), (at(30), 2.0, 5.0), (at(45), 7.0, 5.0)] and got[-1] == (at(19995), 9.0, 6.0) and len(got) == 19995 // 15 + 1
    assert got[-2] == (at(19980), 7.0, 5.0)


# ------------------------------------------------------------------ extra trees
def plain_tree(x, y, t, depth, leaf, share, seed):
    """One tree by recursion: {place: (feature, threshold)} and {place: mean}."""
    unit = lambda *k: int(md5("|".join(map(str, k)).encode()).hexdigest()[:8], 16) / 2**32
    splits, means = {}, {}

    def grow(rows, k, d):
        means[k] = y[rows].mean()
        if d == depth or len(rows) < 2 * leaf:
            return
        span = [(np.nanmin(x[rows, f]), np.nanmax(x[rows, f])) if not np.isnan(x[rows, f]).all() else (0, 0) for f in range(x.shape[1])]
        vary = [f for f, (lo, hi) in enumerate(span) if lo < hi]
        vary = sorted(vary, key=lambda f: md5(f"{seed}|{t}|{k}|{f}|pick".encode()).hexdigest())[:max(1, int(share * x.shape[1]))]
        best, whole = None, y[rows].sum() ** 2 / len(rows)
        for f in sorted(vary):
            thr = span[f][0] + unit(seed, t, k, f) * (span[f][1] - span[f][0])
            left = x[rows, f] <= thr
            if min(left.sum(), (~left).sum()) < max(leaf, 1):
                continue
            score = y[rows][left].sum() ** 2 / left.sum() + y[rows][~left].sum() ** 2 / (~left).sum()
            if score > whole * (1 + 1e-12) and (best is None or score > best[0]):
                best = score, f, thr, left
        if best:
            splits[k] = best[1:3]
            grow(rows[best[3]], 2 * k, d + 1)
            grow(rows[~best[3]], 2 * k + 1, d + 1)
    grow(np.arange(len(y)), 1, 0)
    return splits, means


@pytest.mark.parametrize("share,parts", [(1.0, 1), (0.5, 7)])
def test_extra_trees_equal_a_plain_loop(spark, share, parts):
    rng = np.random.default_rng(3)
    x = np.c_[rng.normal(size=(120, 3)), np.full(120, 4.0)]
    x[::17, 1] = np.nan
    y = 3 + x[:, 0] + (x[:, 2] > 0.3) * 2 + rng.normal(0, 0.1, 120)
    rows = [(i, *(None if np.isnan(v) else float(v) for v in r), float(t)) for i, (r, t) in enumerate(zip(x, y))] + [(500, 1.0, 1.0, 1.0, 1.0, None)]
    d = spark.createDataFrame(rows, "i int, a double, b double, c double, d double, y double").repartition(parts)
    f = XT.fit(d, ["a", "b", "c", "d"], "y", trees=4, depth=4, min_leaf=3, max_features=share, seed=9)
    plain = [plain_tree(x, y, t, 4, 3, share, 9) for t in range(4)]
    for t, (splits, means) in enumerate(plain):
        assert {int(k): (int(f.feature[t, k]), pytest.approx(f.threshold[t, k])) for k in np.flatnonzero(f.feature[t] >= 0)} == splits
        assert {int(k): pytest.approx(f.value[t, k]) for k in np.flatnonzero(f.rows[t] > 0)} == means

    def reach(r, splits):
        k = 1
        while k in splits:
            k = 2 * k + int(not r[splits[k][0]] <= splits[k][1])
        return k
    for r in XT.predict(d, f).where("i < 500").collect():
        assert r.prediction == pytest.approx(np.mean([means[reach(x[r.i], splits)] for splits, means in plain]))
    assert len(f.table()) == sum(len(m) for _, m in plain)


def test_extra_trees_on_nothing_and_on_constants(spark):
    d = spark.createDataFrame([(1.0, 2.0)] * 5, "a double, y double")
    assert {r.prediction for r in XT.predict(d, XT.fit(d, ["a"], "y", 3, 3)).collect()} == {2.0}
    assert not XT.fit(d.limit(0), ["a"], "y", 3, 3).rows.any()


# ------------------------------------------------------------------ out of fold and curves
def test_every_row_meets_a_fit_without_its_fold(spark):
    rng = np.random.default_rng(0)
    x, fold = rng.normal(size=(80, 2)), np.arange(80) % 4
    y = 1 + x @ [0.5, -2] + rng.normal(0, 0.2, 80)
    d = spark.createDataFrame([(0, int(f), float(a), float(b), float(t)) for f, (a, b), t in zip(fold, x, y)], "seed int, fold int, a double, b double, y double")
    got = sorted((r.fold, r.a, r.oof) for r in M.out_of_fold(d, ["seed"], "fold", ["a", "b"], "y", "linear").collect())
    want = []
    for f in range(4):
        c = np.linalg.lstsq(np.c_[np.ones((fold != f).sum()), x[fold != f]], y[fold != f], rcond=None)[0]
        want += [(f, a, pytest.approx(c[0] + c[1] * a + c[2] * b)) for a, b in x[fold == f]]
    assert got == sorted(want, key=lambda w: w[:2])


def test_gate_finds_the_edge_and_rows_without_ratio_take_all_weights(spark):
    rng = np.random.default_rng(0)
    r, y = rng.uniform(0.01, 0.2, 400), rng.uniform(10, 100, 400)
    low = r < np.quantile(r, 0.35)
    good, bad = y[:, None] * np.exp(rng.normal(0, 0.01, (400, 2))), y[:, None] * np.exp(rng.normal(0, 0.3, (400, 2))) * [1.3, 0.7]
    p = np.where(np.c_[low, ~low], good, bad)
    d = spark.createDataFrame([(0, i % 4, float(y[i]), float(r[i]), float(p[i, 0]), float(p[i, 1])) for i in range(400)], "seed int, fold int, y double, r double, a double, b double")
    g = E.fit_gate(d, ["a", "b"])
    w = {x.bin: x for x in g.collect()}
    assert list(w[0].edges) == [pytest.approx(np.quantile(r, 0.35))] and np.allclose([w[0].weights, w[1].weights], np.eye(2), atol=0.05) and w[0].cv_wape < 2
    none = E.apply_gate(d.withColumn("r", F.lit(None).cast("double")), g, ["a", "b"]).collect()
    assert all(x.gated == pytest.approx(w[-1].weights[0] * x.a + w[-1].weights[1] * x.b) for x in none)


def test_learning_curve_verdicts(spark):
    rows = []
    for s in range(6):
        for fam, a, b, ref in (("falls", 5.0, 60.0, 8.0), ("flat", 12.0, 0.0, 8.0), ("high", 20.0, 60.0, 8.0)):
            rows += [(fam, s, n, 400, a + b * (n or 400) ** -0.5 + 0.01 * s, ref) for n in (25, 50, 100, None)]
    rows += [("thin", 0, 25, 30, 9.0, 8.0), ("thin", 0, None, 30, 9.0, 8.0)]
    c = spark.createDataFrame(rows, "fam string, seed int, n int, n_all int, wape double, phys double")
    fits = {(r.fam, r.seed): r for r in V.curve_fits(c, ["fam"], "seed", "n", "n_all", "wape", "phys").collect()}
    assert ("thin", 0) not in fits and fits["falls", 0].a == pytest.approx(5, abs=0.05) and fits["falls", 0].c == pytest.approx(0.5, abs=0.01) and fits["falls", 0].n_star == pytest.approx(400, rel=0.02)
    assert fits["high", 0].n_star == float("inf") and not fits["high", 0].a_below
    v = {r.fam: r for r in V.data_limit(c, ["fam"], "seed", "n", "n_all", "wape", "phys", 25, (50, 100)).collect()}
    assert {k: r.verdict for k, r in v.items()} == {"falls": "D", "flat": "I or features", "high": "inconclusive", "thin": "inconclusive"}
    assert v["falls"].asymptote_share == 1.0 and v["high"].n_star_inf == 6 and v["thin"].n_pairs == 1
