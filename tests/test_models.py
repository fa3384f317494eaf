"""Linear solvers against numpy, validation without leakage, metrics, rules."""
import numpy as np
from pyspark.sql import functions as F

from wattloom.operators import aggregate as A, audits as U, linear as L, models as M, verdicts as V


def frame(spark, n=200, seed=0):
    r = np.random.default_rng(seed)
    X = r.normal(0, 1, (n, 3)) * [1, 5, .2] + [0, 3, -1]
    y = X @ [1.5, -.3, 2.0] + 4 + r.normal(0, .3, n)
    d = spark.createDataFrame([(0, int(i % 4), *map(float, x), float(v)) for i, (x, v) in enumerate(zip(X, y))], "k int, fold int, a double, b double, c double, y double")
    return d, X, y


def std(X):
    return (X - X.mean(0)) / X.std(0)


def test_ols_and_ridge(spark):
    d, X, y = frame(spark)
    c = L.fit_linear(d, ["k"], ["a", "b", "c"], "y").first().coef
    assert np.allclose(c, np.linalg.lstsq(np.c_[np.ones(len(y)), X], y, rcond=None)[0])
    Z = std(X)
    w = np.linalg.solve(Z.T @ Z + 7 * np.eye(3), Z.T @ (y - y.mean())) / X.std(0)
    assert np.allclose(L.fit_linear(d, ["k"], ["a", "b", "c"], "y", "ridge", alpha=7.0).first().coef[1:], w)


def test_lasso_satisfies_kkt(spark):
    d, X, y = frame(spark)
    alpha = .4
    c = np.array(L.fit_linear(d, ["k"], ["a", "b", "c"], "y", "lasso", alpha=alpha).first().coef)
    Z, w = std(X), c[1:] * X.std(0)
    g = Z.T @ (y - c[0] - X @ c[1:]) / len(y)
    for gi, wi in zip(g, w):
        assert abs(gi - alpha * np.sign(wi)) < 1e-6 if abs(wi) > 1e-9 else abs(gi) <= alpha + 1e-6


def test_pls_with_all_components_is_ols(spark):
    d, X, y = frame(spark)
    f = lambda k: np.array(L.fit_linear(d, ["k"], ["a", "b", "c"], "y", "pls", k=k).first().coef)
    assert np.allclose(f(3), np.linalg.lstsq(np.c_[np.ones(len(y)), X], y, rcond=None)[0])
    Z = std(X)
    w = Z.T @ (y - y.mean())
    t = Z @ w
    one = w * (t @ (y - y.mean())) / (t @ t) / X.std(0)
    assert np.allclose(f(1)[1:], one)


def test_grouped_cv_matches_a_manual_loop(spark):
    d, X, y = frame(spark)
    got = {(r.kind, r.params): r for r in M.tune_linear(d, d, ["k"], "fold", ["a", "b", "c"], "y", [("linear", {}), ("ridge", {"alpha": 50.0})]).collect()}
    f = np.arange(len(y)) % 4
    loss = []
    for k in range(4):
        c = np.linalg.lstsq(np.c_[np.ones((f != k).sum()), X[f != k]], y[f != k], rcond=None)[0]
        loss.append(np.mean((c[0] + X[f == k] @ c[1:] - y[f == k]) ** 2))
    assert abs(got[("linear", "[]")].cv_mse - np.mean(loss)) < 1e-9
    oof = M.out_of_fold(d, ["k"], "fold", ["a", "b", "c"], "y", "linear")
    assert abs(oof.agg(F.avg(F.pow(F.col("oof") - F.col("y"), 2))).first()[0] - np.mean(loss)) < 1e-6


def test_prep_is_fitted_on_the_given_rows(spark):
    rows = [(1.0, None, False), (2.0, 4.0, False), (6.0, 8.0, False), (100.0, None, True)]
    d = spark.createDataFrame(rows, "a double, b double, te boolean")
    p = M.fit_prep(d.where("NOT te"), [], ["a", "b"])
    q = {r.feature: r for r in p.collect()}
    assert q["a"].median == 2 and q["b"].median == 6 and abs(q["a"].sd - np.std([1, 2, 6])) < 1e-12
    z = M.apply_prep(d, p, [], ["a", "b"]).where("te").first()
    assert abs(z.a - (100 - 3) / np.std([1, 2, 6])) < 1e-9 and z.b == 0


def test_nnls_matches_brute_force(spark):
    r = np.random.default_rng(3)
    P = r.uniform(0, 10, (60, 3))
    y = P @ [0.7, 0.0, 0.4] - 0.3 * P[:, 1]
    d = spark.createDataFrame([(0, *map(float, p), float(v)) for p, v in zip(P, y)], "k int, a double, b double, c double, y double")
    w = np.array(L.fit_linear(d, ["k"], ["a", "b", "c"], "y", "nnls").first().coef)
    best = min((np.sum((P @ v - y) ** 2) for v in r.uniform(0, 1, (20000, 3))))
    assert (w >= 0).all() and np.sum((P @ w - y) ** 2) <= best + 1e-9


def test_wape_and_null_rules(spark):
    d = spark.createDataFrame([("a", 10.0, 12.0), ("a", 20.0, 18.0), ("a", 30.0, 33.0), ("z", 0.0, 1.0), ("z", 0.0, 2.0)], "k string, y double, p double")
    s = {r.k: r for r in A.score(d, ["k"]).collect()}
    assert abs(s["a"].wape - 700 / 60) < 1e-9 and abs(s["a"].nmae - s["a"].wape * 20 / 30) < 1e-9
    assert s["z"].wape is None and s["z"].nmae is None and s["z"].mape is None and s["z"].r2 is None


def test_bins_are_right_closed(spark):
    d = spark.createDataFrame([(0.15,), (0.16,), (0.35,), (0.65,), (0.66,)], "p double")
    assert [r[0] for r in d.select(A.penetration_bin(F.col("p"))).collect()] == ["pbin<=15", "pbin15-35", "pbin15-35", "pbin35-65", "pbin>65"]


def test_cluster_bootstrap_keeps_whole_member_sets(spark):
    pred = spark.createDataFrame([("s1", 10.0, 11.0), ("s2", 10.0, 11.0), ("s3", 10.0, 11.0), ("s4", 10.0, 11.0)], "sub_id string, y double, p double")
    mem = spark.createDataFrame([("s1", 1), ("s2", 1), ("s3", 2), ("s4", 1), ("s4", 2)], "sub_id string, hh int")
    b = U.cluster_bootstrap(pred, mem, 200, 0, "y", "p").first()
    assert abs(b.lo - 10) < 1e-9 and abs(b.hi - 10) < 1e-9 and b.n_valid <= 200 and 0.4 < b.mean_kept < 0.8


def test_verdict_and_carry_rules(spark):
    d = spark.createDataFrame([("b", -2.0)] * 8 + [("b", 1.0)] * 2 + [("w", 2.0)] * 9 + [("n", -.5)] * 10, "k string, d double")
    assert {r.k: r.verdict for r in V.verdict(d, ["k"], "d").collect()} == {"b": "better", "w": "worse", "n": "no difference"}
    p = spark.createDataFrame([("a", 10.0), ("b", 11.0), ("c", 10.9), ("linear", 30.0), ("e", 20.0)], "family string, e double")
    c = {r.family: r.reason for r in V.carry_forward(p, "family", "e").collect()}
    assert c == {"a": "top", "c": "top", "b": "near", "linear": "always", "e": "not carried"}


def test_ensemble_average_and_specs(spark):
    from wattloom.operators.estimators import average
    assert spark.createDataFrame([(1.0, 3.0)], "a double, b double").select(average(["a", "b"])).first()[0] == 2
    s = M.specs(spark.createDataFrame([("Ridge",)], "method string"), ["none", "size"], ["-", "x"], ["direct", "residual"], ["none", "log"])
    assert s.where("mode = 'residual' AND target_transform = 'none'").count() == 0 and s.where("feature_set = '-' AND anchor = 'none'").count() == 0


def test_trees_fit_and_stop(spark):
    d, _, _ = frame(spark, 120)
    z = M.assemble(d, ["a", "b", "c"]).withColumn("is_stop", F.col("fold") == 0)
    m, table, oof = M.tune_trees(z, z, "fold", 4, [("forest", {"trees": 4}), ("boosted", {"iters": 4, "depth": 2})])
    assert table.count() == 2 and oof.count() == 120 and m.transform(z).count() == 120


def test_gram_by_partition_equals_sums(spark, monkeypatch):
    import numpy as np
    from pyspark.sql import functions as F
    from wattloom.operators import linear as L
    names = [f"x{i}" for i in range(14)]
    d = spark.range(3000).withColumn("k", F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b")).withColumn("f", (F.col("id") % 2).cast("int"))
    d = d.select("k", "f", *[F.sin(F.col("id") * (i + 1)).alias(n) for i, n in enumerate(names)], F.when(F.col("id") % 50 != 0, F.cos(F.col("id"))).alias("y")).repartition(5)
    got = {(r.k, r.f): r for r in L.gram(d, ["k", "f"], names, "y").collect()}
    monkeypatch.setattr(L, "FEW_PRODUCTS", 10 ** 6)
    want = {(r.k, r.f): r for r in L.gram(d, ["k", "f"], names, "y").collect()}
    assert got.keys() == want.keys() and len(got) == 6
    assert all(got[k].n == want[k].n and np.allclose(got[k].g, want[k].g, atol=1e-9) for k in got)


def test_log_matching_forms_no_pairs(spark):
    """Bands of a step function of cents with exact borders, and 40,000 rows of nearly one value, against counts by hand."""
    g = np.random.default_rng(3)
    cents = np.r_[g.integers(0, 400, 300), -g.integers(0, 400, 100)] * 10
    rows = [(int(i % 3) or None, i, float(c) / 1000) for i, c in enumerate(cents)] + [(1, 900, None), (1, 901, float("nan")), (1, 902, float("inf")), (1, 903, 1e9), (1, 5, 3.0), (1, 5, 3.0)]
    logs = [(int(k % 3) or None, float(c) / 1000, [None, "a", "a", "a", "b"][int(k) % 5]) for k, c in enumerate(g.integers(-400, 400, 500) * 10)] + [(1, None, "a"), (1, float("nan"), "a"), (1, float("inf"), "b")]
    r, l = spark.createDataFrame(rows, "k int, id int, v double"), spark.createDataFrame(logs, "k int, w double, p string")
    got = {(x.k, x.id): (x.n_matches, x.status, x.params) for x in V.match_logs(r, l, ["k"], "v", "w", "p").collect()}
    assert len(got) == len(set(map(str, rows)))
    for k, i, v in rows:
        hit = [p for key, w, p in logs if k is not None and key == k and None not in (v, w) and abs(w - v) <= 0.05]
        kinds = {p for p in hit if p}
        assert got[k, i] == (len(hit) * (2 if i == 5 and k == 1 and v == 3.0 else 1), ["no log line", "ok", "ambiguous"][min(len(kinds), 2)], min(kinds) if len(kinds) == 1 else None), (k, i, v)
    n = 40000
    d = spark.range(n).select(F.lit(1).alias("k"), F.col("id"), (7 + (F.col("id") % 4) / 1e6).alias("v"), F.lit("a").alias("p"))
    one = V.match_logs(d.select("k", "id", "v"), d.select("k", "v", "p"), ["k"], "v", "v", "p").agg(F.count("*"), F.min("n_matches"), F.max("n_matches")).first()
    assert tuple(one) == (n, n, n)
