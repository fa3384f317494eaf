"""Known-truth recovery and brute force for the fits and estimators."""
import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from wattloom.operators import estimators as E, hinge as H


def daily(spark, series):
    rows = [(e, float(t), float(y)) for e, (T, Y) in series.items() for t, y in zip(T, Y)]
    return spark.createDataFrame(rows, "e string, t double, y double")


def year(n=365):
    return 10 + 12 * np.sin(2 * np.pi * (np.arange(n) - 110) / 365)


def sse_grid(T, Y, lo=8.0, hi=20.0, n=241):
    best = np.inf
    for th in np.linspace(lo, hi, n):
        x = np.maximum(0, th - T)
        A = np.c_[np.ones_like(x), x]
        for cols in ([0, 1], [0], [1]):
            c, *_ = np.linalg.lstsq(A[:, cols], Y, rcond=None)
            if (c >= -1e-12).all():
                best = min(best, ((Y - A[:, cols] @ c) ** 2).sum())
    return best


def test_hinge_recovers_truth(spark):
    T = year()
    f = H.fit_hinge(daily(spark, {"a": (T, 5 + 0.8 * np.maximum(0, 16 - T))}), ["e"]).first()
    assert abs(f.s_h - 0.8) < 1e-6 and abs(f.T_h - 16) < 1e-6 and abs(f.P_base - 5) < 1e-6 and f.r2 > 0.999999
    assert f.hinge_inside and not f.at_bound


def test_hinge_never_loses_to_a_grid(spark):
    r = np.random.default_rng(1)
    series = {}
    for i in range(12):
        T = np.round(year(200) + r.normal(0, 3, 200), 1 if i % 2 else 4)
        Y = np.maximum(0, (3 if i % 3 else 0.2) + r.uniform(-0.3, 0.8) * np.maximum(0, r.uniform(6, 22) - T) + r.normal(0, 1.5, 200) + (0 if i % 4 else 3 * np.maximum(0, T - 18)))
        series[str(i)] = (T, Y)
    for f in H.fit_hinge(daily(spark, series), ["e"]).collect():
        T, Y = series[f.e]
        assert f.sse <= sse_grid(T, Y) + 1e-6
        assert f.s_h >= 0 and f.P_base >= 0 and 8 <= f.T_h <= 20
        assert abs(((Y - f.P_base - f.s_h * np.maximum(0, f.T_h - T)) ** 2).sum() - f.sse) < 1e-5


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(-10, 30), st.floats(0, 20)), min_size=4, max_size=25))
def test_hinge_property(spark, pts):
    T, Y = np.array([p[0] for p in pts], float), np.array([p[1] for p in pts], float)
    f = H.fit_hinge(daily(spark, {"a": (T, Y)}), ["e"]).first()
    assert f.sse <= sse_grid(T, Y, n=121) + 1e-5


def test_all_days_warm_gives_flat_fit(spark):
    f = H.fit_hinge(daily(spark, {"a": (np.array([25.0, 26, 27, 28]), np.array([1.0, 2, 3, 4]))}), ["e"]).first()
    assert f.s_h == 0 and f.P_base == 2.5 and f.r2 == 0


def test_cooling_and_bathtub(spark):
    T = year() + 6
    c = H.fit_cooling(daily(spark, {"a": (T, 4 + 0.5 * np.maximum(0, T - 21))}), ["e"]).first()
    assert abs(c.s_c - 0.5) < 1e-6 and abs(c.T_c - 21) < 1e-6
    b = H.fit_bathtub(daily(spark, {"a": (T, 4 + 0.7 * np.maximum(0, 13 - T) + 0.5 * np.maximum(0, T - 22.5))}), ["e"]).first()
    assert (b.T_heat, b.T_cool) == (13.0, 22.5) and abs(b.s_heat - 0.7) < 1e-6 and abs(b.s_cool - 0.5) < 1e-6 and abs(b.P_base - 4) < 1e-6


def test_degree_line_clamps(spark):
    d = daily(spark, {"up": (np.arange(5.0), 2 + 3 * np.arange(5.0)), "down": (np.arange(5.0), 9 - np.arange(5.0)), "neg": (np.arange(1.0, 6), 4 * np.arange(1.0, 6) - 3)})
    f = {r.e: r for r in H.fit_degree_line(d, ["e"], "t", "y").collect()}
    assert (round(f["up"].slope, 9), round(f["up"].base, 9)) == (3, 2)
    assert f["down"].slope == 0 and f["down"].base == 7
    assert f["neg"].base == 0 and f["neg"].slope > 0


def test_invalid_estimates_are_zero(spark):
    d = spark.createDataFrame([(2.0, .02), (0.0, .02), (-1.0, .02), (None, .02), (3.0, None)], "s double, m double")
    p, v = E.ratio_estimate(F.col("s"), F.col("m"))
    assert [tuple(r) for r in d.select(p, v).collect()] == [(100.0, True)] + [(0.0, False)] * 4


def test_residual_composition(spark):
    d = spark.createDataFrame([(10.0, True), (20.0, True), (5.0, False), (7.0, True)], "p double, v boolean")
    assert [r[0] for r in d.select(E.compose(F.col("p"), F.lit(0.0), F.col("v"))).collect()] == [10, 20, 0, 7]


@pytest.mark.parametrize("a,b,c", [(20, 80, .5), (12, 300, 1.2), (30, 40, .3)])
def test_power_law(spark, a, b, c):
    n = [16, 32, 64, 100, 200, 400]
    d = spark.createDataFrame([("x", x, a + b * x ** -c) for x in n], "k string, n int, w double")
    f = E.fit_power_law(d, ["k"], "n", "w").first()
    assert abs(f.c - c) < 0.02 and abs(f.a - a) < 0.05 * a and not f.flag_c_bound


def test_n_star(spark):
    d = spark.createDataFrame([(20.0, 80.0, .5, 20 + 80 * 50 ** -.5), (30.0, 1.0, 1.0, 25.0), (10.0, -1.0, 1.0, 25.0)], "a double, b double, c double, w double")
    v = [r[0] for r in d.select(E.n_star(*[F.col(x) for x in "abcw"])).collect()]
    assert abs(v[0] - 50) < 1e-6 and v[1] == float("inf") and v[2] == 0


def test_pilot_and_own_load_correction(spark):
    """Toy pool: heat pumps with slope .03 per kW, own load with a slope: the corrected pilot is unbiased."""
    T, m, cap, k = year(), .03, 6.0, .02
    days = [(h, i, float(m * cap * max(0, 14 - t)), float(1 + k * max(0, 14 - t))) for h in range(8) for i, t in enumerate(T)]
    r = spark.createDataFrame(days, "hh int, day int, hp double, own double")
    st_ = spark.createDataFrame([(0, i, float(t)) for i, t in enumerate(T)], "station int, day int, t double")
    sets = spark.createDataFrame([(0, h, 0, cap) for h in range(8)], "seed int, hh int, station int, cap double")
    p = E.pilots(sets, ["seed"], r, st_).first()
    assert abs(p.m - m) < 1e-6 and abs(p.T_h - 14) < 1e-6 and p.n_hh == 8
    s0 = E.dwelling_slope(sets, ["seed"], r, st_).first().s0
    assert abs(s0 - k) < 1e-6
    w = E.whole_house_slope(E.pilots(sets, ["seed"], r, st_), F.lit(s0)).first()
    assert abs(w.m_own - m) < 1e-6
    est, _ = E.corrected_estimate(F.lit(3 * m * cap + 20 * k), F.lit(20), F.lit(k), F.lit(m))
    assert abs(spark.range(1).select(est).first()[0] - 3 * cap) < 1e-6


def test_crossfit_uses_the_other_households_only(spark):
    T = year(120)
    r = spark.createDataFrame([(h, i, float((.02 + .01 * (h % 2)) * max(0, 14 - t)), float(1.0 + .1 * max(0.0, 14 - t))) for h in range(4) for i, t in enumerate(T)], "hh int, day int, hp double, own double")
    st_ = spark.createDataFrame([(0, i, float(t)) for i, t in enumerate(T)], "station int, day int, t double")
    tr = spark.createDataFrame([(0, h, 0, 1.0) for h in range(4)], "seed int, hh int, station int, cap double")
    x = E.crossfit_pilots(tr, tr.where("hh % 2 = 0").withColumn("set_id", F.lit("even")), r, st_).first()
    direct = E.pilots(tr.where("hh % 2 = 1"), ["seed"], r, st_).first()
    assert abs(x.m - direct.m) < 1e-9 and abs(x.m - .03) < 1e-6


def test_response_scaling_scales_the_slope(spark):
    T = year()
    d = daily(spark, {"a": (T, 5 + 0.8 * np.maximum(0, 16 - T))})
    for f in (0.5, 1.5):
        s = H.fit_hinge(E.scale_response(d, ["e"], "t", "y", f).select("e", "t", F.col("y_scaled").alias("y")), ["e"]).first()
        assert abs(s.s_h - 0.8 * f) < 1e-6 and abs(s.P_base - 5) < 1e-6


def test_ridge_scale_recovers_dependence(spark):
    r = np.random.default_rng(0)
    rows = []
    for i in range(240):
        x = r.normal(0, 1, 5)
        rows.append((0, ["train", "inner", "test"][i % 3], int(i % 4), int(i % 5), *map(float, x), float(-3 + 0.4 * x[1] - 0.2 * x[0])))
    d = spark.createDataFrame(rows, "seed int, split string, fold int, station int, T_h double, T_design double, r_hat double, T_mean double, T_q05 double, log_m double")
    g = E.scale_ridge(d).collect()
    full = next(x for x in g if x.kind == "full")
    assert full.alpha <= 0.1 and abs(full.coef[2] - 0.4) < 0.01 and abs(full.coef[1] + 0.2) < 0.01
    assert {x.kind for x in g} == {"full", "fold", "station"} and sum(x.kind == "fold" for x in g) == 4


def test_gate_finds_the_edge_and_the_weights(spark):
    r = np.random.default_rng(0)
    rows = []
    for i in range(400):
        q, y = (i * 7 % 400) / 400, r.uniform(5, 20)
        a, b = (y, y * r.uniform(.2, 3)) if q < 0.2 else (y * r.uniform(.2, 3), 0.5 * y)
        rows.append((0, i % 4, float(y), float(q), float(a), float(b)))
    d = spark.createDataFrame(rows, "seed int, fold int, y double, r double, a double, b double")
    g = E.fit_gate(d, ["a", "b"])
    w = {x.bin: x.weights for x in g.collect()}
    e = g.first().edges
    assert len(e) == 1 and abs(e[0] - 0.2) < 0.03
    assert w[0][0] > 0.9 and w[1][1] > 1.7
    p = E.apply_gate(d, g, ["a", "b"]).agg(F.avg(F.abs(F.col("gated") - F.col("y")))).first()[0]
    assert p < 0.6


def test_netfit_has_29_columns_and_null_rule(spark):
    import datetime as dt
    T = year()
    rows = [("a", dt.date(2023, 1, 1) + dt.timedelta(i), float(t), float(5 + 0.8 * max(0, 16 - t))) for i, t in enumerate(T)]
    rows += [("b", dt.date(2023, 6, 1) + dt.timedelta(i), 10.0 + i % 9, 2.0 + (i % 3)) for i in range(30)]
    n = E.netfit(spark.createDataFrame(rows, "e string, day date, t double, y double"), "e", "t", "y", "day")
    assert len(n.columns) == 30
    r = {x.e: x for x in n.collect()}
    assert abs(r["a"].nf_all_s_h - 0.8) < 1e-6 and abs(r["a"].nf_we_s_h - 0.8) < 1e-6 and abs(r["a"].nf_ratio_sh_we_wd - 1) < 1e-6
    assert r["b"].nf_we_s_h is None and r["b"].nf_all_s_h is not None


def test_saturation_arm_of_a_constant_factor_is_null(spark):
    rows = [(1, float(t), 1.0, 14.0) for t in range(12)] + [(2, float(t), (14 - t) / 20, 14.0) for t in range(12)]
    got = {r[0]: tuple(r)[1:] for r in H.saturation_arm(spark.createDataFrame(rows, "k int, t double, sf double, th double"), ["k"], "t", "sf", "th").collect()}
    assert got[1] == (12, None, None, None, None)
    assert got[2][0] == 12 and np.allclose(got[2][1:], (0, 0.05, 0.7, 1))
