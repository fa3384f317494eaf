"""Queries over feature matrices, models and validation (M rows)."""
from __future__ import annotations

from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from ..functions.hashing import hash_int
from ..operators import aggregate as A, estimators as E, extra_trees as XT, hinge as HG, linear as L, models as M, rank as R
from ..session import cut_lineage, scratch
from ..sources import tables as X
from . import q_cohorts as C, q_estimators as QE, sqlparts as Q
from .registry import query

FEATS, FOLDS = ["x1", "x2", "x3", "x4"], 4


def frame(spark, d):
    """One row per household: features of its readings (sd is NULL with one reading), target = mean load; split and fold by household hash."""
    r = X.daily_readings(spark, d)
    g = r.groupBy("hh", "station", "role").agg(F.avg("own").alias("x1"), F.stddev_samp("own").alias("x2"), F.avg("t").alias("x3"), F.first("cap").alias("x4"),
                                               F.avg(F.col("own") + F.col("hp")).alias("y"), F.count("*").alias("size"))
    h = hash_int(F.lit("ml"), F.col("hh"))
    return g.withColumn("is_test", h % 4 == 0).withColumn("fold", (F.floor(h / 4) % FOLDS).cast("int"))


FR_SQL = f"""{X.SQL_READ}, fr0 AS (SELECT hh, station, role, avg(own) AS x1, stddev_samp(own) AS x2, avg(t) AS x3, any_value(cap) AS x4, avg(own+hp) AS y, count(*) AS size, {Q.hint("'ml'", 'hh')} AS h FROM rd GROUP BY hh, station, role),
fr AS (SELECT *, h%4=0 AS is_test, CAST((h//4)%{FOLDS} AS INTEGER) AS fold FROM fr0)"""


def ready(spark, d):
    f = cut_lineage(frame(spark, d))
    p = M.fit_prep(f.where("NOT is_test"), [], FEATS)
    return cut_lineage(M.apply_prep(f, p, [], FEATS))


@query("m01_feature_matrix", f"""WITH {X.SQL_HOUR}, n1 AS (SELECT hh, ts, kw AS y, {X.sql_temp('hh', 'ts')}+hour(ts)/4.0::DOUBLE AS t FROM hr WHERE isodow(ts)<6), n2 AS (SELECT *, CAST(ts AS DATE) AS day, greatest(0.0::DOUBLE,12-t) AS hdh FROM n1),
n3 AS (SELECT hh, day, sum(hdh) AS sev FROM n2 GROUP BY 1,2), n4 AS (SELECT n2.*, CASE WHEN hour(ts)<6 THEN 'night' WHEN hour(ts)<10 THEN 'morning' WHEN hour(ts)<16 THEN 'day' ELSE 'evening' END AS win, CASE WHEN sev<=0 THEN 'warm' WHEN sev<=10 THEN 'mild' WHEN sev<=25 THEN 'cold' ELSE 'extreme' END AS bin FROM n2 JOIN n3 USING (hh, day)),
c AS (SELECT hh, win, bin, avg(y) AS m FROM n4 GROUP BY 1,2,3), w AS (SELECT hh, {", ".join(f"max(m) FILTER (win='{w}' AND bin='{b}') AS {w}_{b}" for w in A.WINDOWS for b in A.SEVERITY)} FROM c GROUP BY 1), an AS (SELECT hh, CAST(count(*) AS DOUBLE) AS size, max(y) AS peak FROM n2 GROUP BY 1)
SELECT w.hh, round(evening_extreme/(evening_cold+1e-6::DOUBLE),6) AS ratio_evening, round(day_cold/(day_warm+1e-6::DOUBLE),6) AS ratio_day, round((night_extreme-night_cold)/(night_cold+1e-6::DOUBLE),6) AS normdelta_night, round(evening_cold/nullif(peak,0),6) AS mean_norm_peak, size AS scale_size, round(peak,6) AS scale_peak, CAST(4*4*7+2*4*4*5 AS BIGINT) AS n_scale_free FROM w JOIN an USING (hh)""")
def m01(spark, d):
    h = X.hourly(spark, d).withColumn("t", X.temperature_at(F.col("hh"), F.to_date("ts")) + F.hour("ts") / 4.0)
    raw = A.windowed_features(h, ["hh"], "ts", "t", "kw", peak_norm=True)
    wd = h.where(F.weekday("ts") < 5).groupBy("hh").agg(F.count("*").alias("size"), F.max("kw").alias("peak"))
    m = M.feature_matrix(raw, "hh", wd)
    f = lambda c, n: F.round(F.col(f"`{c}`"), 6).alias(n)
    return m.select("hh", f("Feature evening_ratio_Mean_extreme_cold", "ratio_evening"), f("Feature day_ratio_Mean_cold_warm", "ratio_day"), f("Feature night_normdelta_Mean_extreme_cold", "normdelta_night"),
                    f("Feature evening_cold_Mean_norm_peak", "mean_norm_peak"), F.col("`Feature Scale_size`").alias("scale_size"), f("Feature Scale_peak", "scale_peak"),
                    F.lit(len(A.scale_free(raw.columns))).cast("bigint").alias("n_scale_free"))


def _prep_sql():
    med = ", ".join(f"median({f}) FILTER (NOT is_test) AS m_{f}" for f in FEATS)
    st = ", ".join(f"avg(coalesce({f},m_{f})) FILTER (NOT is_test) AS a_{f}, stddev_pop(coalesce({f},m_{f})) FILTER (NOT is_test) AS s_{f}" for f in FEATS)
    return f"{FR_SQL}, pm AS (SELECT {med} FROM fr), ps AS (SELECT {st} FROM fr, pm), z AS (SELECT hh, station, role, y, size, is_test, fold, {', '.join(f'coalesce((coalesce({f},m_{f})-a_{f})/CASE WHEN s_{f}>1e-12 THEN s_{f} END,0.0::DOUBLE) AS {f}' for f in FEATS)} FROM fr, pm, ps)"


@query("m02_impute_and_scale", f"WITH {_prep_sql()} SELECT hh, is_test, fold, {', '.join(f'round({f},6) AS {f}' for f in FEATS)} FROM z")
def m02(spark, d):
    return ready(spark, d).select("hh", "is_test", "fold", *[F.round(f, 6).alias(f) for f in FEATS])


@query("m03_linear_family")
def m03(spark, d):
    """Linear, ridge, lasso, elastic net and their test errors, all from one Gram row."""
    z = ready(spark, d)
    tr, te, out = z.where("NOT is_test"), z.where("is_test"), None
    g = cut_lineage(L.gram(tr, [], FEATS, "y"))
    for kind, opt in (("ols", {}), ("ridge", {"alpha": 10.0}), ("lasso", {"alpha": 0.05}), ("elasticnet", {"alpha": 0.05, "l1_ratio": 0.5})):
        p = L.apply_linear(te, g.select(L.solver(kind, **opt)("g").alias("coef")), [], FEATS, "p", clip=True)
        s = A.score(p, []).select(F.lit(kind).alias("kind"), "n", F.round("wape", 5).alias("wape"), F.round("rmse", 5).alias("rmse"))
        out = s if out is None else out.unionByName(s)
    return out


@query("m03_one_feature_ridge", f"""WITH {_prep_sql()}, g AS (SELECT avg(y) AS ym, sum(x4*y) AS xy, sum(x4*x4) AS xx, sum(x4) AS sx, count(*) AS n, avg(x4) AS xm, stddev_pop(x4) AS sd FROM z WHERE NOT is_test), c AS (SELECT ym, xm, ((xy-n*xm*ym)/sd)/(n+10.0::DOUBLE)/sd AS w FROM g)
SELECT hh, round(ym+w*(x4-xm),6) AS p FROM z, c WHERE is_test""")
def m03_ridge(spark, d):
    z = ready(spark, d)
    f = L.fit_linear(z.where("NOT is_test"), [], ["x4"], "y", "ridge", alpha=10.0)
    return L.apply_linear(z.where("is_test"), f, [], ["x4"], "p").select("hh", F.round("p", 6).alias("p"))


@query("m04_random_forest")
def m04(spark, d):
    z = M.assemble(ready(spark, d), FEATS)
    m = M.tree_model("forest", 0, trees=10).fit(z.where("NOT is_test"))
    return m.transform(z.where("is_test")).select("hh", "y", F.col("prediction").alias("p"))


TREES, DEPTH, LEAF = 50, 5, 3


def extra_sql():
    """The forest grown level by level: every tree, node and feature in plain joins."""
    long = " UNION ALL ".join(f"SELECT hh, is_test, y, {i} AS feature, {f} AS x FROM z" for i, f in enumerate(FEATS))
    out = [f"lx AS ({long})", f"n0 AS (SELECT hh, is_test, y, tree, CAST(1 AS BIGINT) AS node FROM z, range({TREES}) t(tree))"]
    for i in range(DEPTH):
        out += [f"t{i} AS (SELECT tree, node, count(*) AS n, sum(y) AS s FROM n{i} WHERE NOT is_test AND node>={1 << i} GROUP BY 1,2 HAVING count(*)>={2 * LEAF})",
                f"d{i} AS (SELECT tree, node, feature, min(x)+{Q.hint('0', 'tree', 'node', 'feature')}/4294967296.0::DOUBLE*(max(x)-min(x)) AS thr FROM n{i} JOIN lx USING (hh) JOIN t{i} USING (tree, node) WHERE NOT n{i}.is_test GROUP BY 1,2,3 HAVING min(x)<max(x))",
                f"s{i} AS (SELECT d{i}.tree, d{i}.node, feature, thr, count(*) AS nl, sum(n{i}.y) AS sl FROM d{i} JOIN n{i} ON n{i}.tree=d{i}.tree AND n{i}.node=d{i}.node AND NOT n{i}.is_test JOIN lx USING (hh, feature) WHERE x<=thr GROUP BY 1,2,3,4)",
                f"b{i} AS (SELECT tree, node, feature, thr FROM s{i} JOIN t{i} USING (tree, node) WHERE nl>={LEAF} AND n-nl>={LEAF} AND sl*sl/nl+(s-sl)*(s-sl)/(n-nl)>s*s/n*(1+1e-12::DOUBLE) QUALIFY row_number() OVER (PARTITION BY tree, node ORDER BY round(sl*sl/nl+(s-sl)*(s-sl)/(n-nl),9) DESC, feature)=1)",
                f"n{i + 1} AS (SELECT n.hh, n.is_test, n.y, n.tree, CASE WHEN b.feature IS NULL THEN n.node WHEN lx.x<=thr THEN 2*n.node ELSE 2*n.node+1 END AS node FROM n{i} n LEFT JOIN b{i} b ON b.tree=n.tree AND b.node=n.node LEFT JOIN lx ON lx.hh=n.hh AND lx.feature=b.feature)"]
    return ", ".join(out) + f", v AS (SELECT tree, node, avg(y) AS v FROM n{DEPTH} WHERE NOT is_test GROUP BY 1,2)"


@query("m04_extra_trees", f"WITH {_prep_sql()}, {extra_sql()} SELECT n.hh, round(any_value(n.y),6) AS y, round(avg(v.v),6) AS p FROM n{DEPTH} n JOIN v ON v.tree=n.tree AND v.node=n.node WHERE is_test GROUP BY 1")
def m04_extra(spark, d):
    """Trees with one random threshold for each feature and node."""
    z = ready(spark, d)
    f = XT.fit(z.where("NOT is_test"), FEATS, "y", TREES, DEPTH, LEAF)
    return XT.predict(z.where("is_test"), f).select("hh", F.round("y", 6).alias("y"), F.round("prediction", 6).alias("p"))


@query("m05_boosted_trees")
def m05(spark, d):
    """Boosted trees stopped early on one named fold."""
    z = M.assemble(ready(spark, d), FEATS).withColumn("is_stop", F.col("fold") == 0)
    m = M.tree_model("boosted", 0, iters=10).fit(z.where("NOT is_test"))
    return m.transform(z.where("is_test")).select("hh", "y", F.col("prediction").alias("p"))


@query("m06_partial_least_squares")
def m06(spark, d):
    z = ready(spark, d)
    f = L.fit_linear(z.where("NOT is_test"), [], FEATS, "y", "pls", k=2)
    return L.apply_linear(z.where("is_test"), f, [], FEATS, "p", clip=True).select("hh", F.round("y", 6).alias("y"), F.round("p", 5).alias("p"))


@query("m07_log_target", f"""WITH {_prep_sql()}, c AS (SELECT regr_slope(ln(y),x1) AS s, regr_intercept(ln(y),x1) AS i FROM z WHERE NOT is_test AND y>0) SELECT hh, round(greatest(0.0::DOUBLE,exp(i+s*x1)),6) AS p FROM z, c WHERE is_test""")
def m07(spark, d):
    z = ready(spark, d).where("y > 0").withColumn("ly", M.to_target(F.col("y"), "log"))
    f = L.fit_linear(z.where("NOT is_test"), [], ["x1"], "ly")
    p = L.apply_linear(ready(spark, d).where("is_test"), f, [], ["x1"], "lp")
    return p.select("hh", F.round(M.from_target(F.col("lp"), "log"), 6).alias("p"))


@query("m08_grouped_cv")
def m08(spark, d):
    """Every candidate of the linear family, scored over household folds, with the best of each kind marked."""
    z = ready(spark, d).where("NOT is_test").withColumn("k", F.lit(0))
    t = M.tune_linear(z, z, ["k"], "fold", FEATS, "y", M.linear_grid())
    return t.select("kind", "params", F.round("cv_mse", 6).alias("cv_mse"), "best")


@query("m08_out_of_fold", f"""WITH {_prep_sql()}, o AS (SELECT DISTINCT fold AS out_ FROM z), c AS (SELECT out_, regr_slope(y,x4) AS s, regr_intercept(y,x4) AS i FROM z, o WHERE NOT is_test AND fold<>out_ GROUP BY 1) SELECT hh, fold, round(i+s*x4,6) AS oof FROM z JOIN c ON fold=out_ WHERE NOT is_test""")
def m08_oof(spark, d):
    z = ready(spark, d).where("NOT is_test").withColumn("k", F.lit(0))
    return M.out_of_fold(z, ["k"], "fold", ["x4"], "y", "linear").select("hh", "fold", F.round("oof", 6).alias("oof"))


@query("m08_tree_cv")
def m08_trees(spark, d):
    """Boosted trees with the fold after the scored one as the stopping fold."""
    z = cut_lineage(M.assemble(ready(spark, d).where("NOT is_test"), FEATS))
    _, table, _ = M.tune_trees(z, z, "fold", FOLDS, [("boosted", {"iters": 6, "depth": 2})])
    return table


@query("m09_plain_search")
def m09(spark, d):
    z = M.assemble(ready(spark, d), FEATS)
    m = M.plain_search(z.where("NOT is_test"), "fold", FOLDS)
    return m.transform(z.where("is_test")).select("hh", "y", F.col("prediction").alias("p"))


@query("m10_naive_baselines", f"""WITH {FR_SQL}, c AS (SELECT median(y) AS m, median(y/size) AS ms FROM fr WHERE NOT is_test), p AS (SELECT y, m AS p, 'median' AS method FROM fr, c WHERE is_test UNION ALL SELECT y, ms*size, 'density' FROM fr, c WHERE is_test)
SELECT method, CAST(count(*) AS BIGINT) AS n, round(sum(abs(p-y))/sum(y)*100,6) AS wape FROM p GROUP BY 1""")
def m10(spark, d):
    from ..functions.scan import exact_quantiles
    f = frame(spark, d).withColumn("k", F.lit(0)).withColumn("per", F.col("y") / F.col("size"))
    tr = f.where("NOT is_test")
    a = exact_quantiles(tr, ["k"], "y", {"m": 0.5}).select("m")
    b = exact_quantiles(tr, ["k"], "per", {"ms": 0.5}).select("ms")
    p = f.where("is_test").crossJoin(F.broadcast(a)).crossJoin(F.broadcast(b)).select("y", F.explode(F.create_map(F.lit("median"), F.col("m"), F.lit("density"), F.col("ms") * F.col("size"))).alias("method", "p"))
    return A.score(p, ["method"]).select("method", "n", F.round("wape", 6).alias("wape"))


@query("m11_feature_selection")
def m11(spark, d):
    """Fold-averaged importances order the features; the smallest k within one standard error of the best is chosen."""
    z = cut_lineage(M.assemble(ready(spark, d).where("NOT is_test"), FEATS))
    imp = M.importances(z, "fold", FOLDS, FEATS)
    order = [r["feature"] for r in imp.orderBy(F.desc("importance"), "feature").collect()]      # one row per feature
    c = M.selection_curve(z, "fold", order, "y").withColumn("g", F.lit(0))
    return R.one_se(c, ["g"], "k", "mean", "se").select("k_1se", "k_best", F.round("best_error", 6).alias("best_error"), F.lit(",".join(order)).alias("feature_order"))


@query("m12_experiment_specs", """WITH m AS (SELECT DISTINCT o_orderpriority AS method FROM orders) SELECT method, anchor, feature_set, mode, target_transform FROM m, (VALUES ('none'),('size'),('size+peak')) a(anchor), (VALUES ('-'),('whdd'),('netfit')) f(feature_set), (VALUES ('direct'),('residual')) o(mode), (VALUES ('none'),('log')) t(target_transform)
WHERE (mode<>'residual' OR target_transform='log') AND (feature_set<>'-' OR anchor<>'none')""")
def m12(spark, d):
    m = X.table(spark, d, "orders").select(F.col("o_orderpriority").alias("method")).distinct()
    return M.specs(m, ["none", "size", "size+peak"], ["-", "whdd", "netfit"], ["direct", "residual"], ["none", "log"])


def _m13_sql():
    m = Q.metrics()
    un = " UNION ALL ".join(f"SELECT seed, method, cell, n_substations, '{k}' AS metric, round({k},4) AS value FROM g" for k in m)
    return f"""WITH {QE.EST_SQL}, c AS (SELECT seed, regr_slope(HP_Peak,s_h_net) AS s1, regr_intercept(HP_Peak,s_h_net) AS i1 FROM es WHERE split='train' GROUP BY 1),
l AS (SELECT seed, 'ratio' AS method, HP_Peak AS y, ratio AS p, HP_Count, size, es.p AS pen FROM es WHERE split='test' UNION ALL SELECT seed, 'corrected', HP_Peak, corrected, HP_Count, size, p FROM es WHERE split='test' UNION ALL SELECT es.seed, 'slope_only', HP_Peak, greatest(0.0::DOUBLE,i1+s1*s_h_net), HP_Count, size, es.p FROM es JOIN c ON es.seed=c.seed WHERE split='test'),
b AS (SELECT *, CASE WHEN HP_Count/size::DOUBLE<=0.15 THEN 'pbin<=15' WHEN HP_Count/size::DOUBLE<=0.35 THEN 'pbin15-35' WHEN HP_Count/size::DOUBLE<=0.65 THEN 'pbin35-65' ELSE 'pbin>65' END AS bin, 'p='||pen||'|size='||size AS cl FROM l),
g AS (SELECT seed, method, coalesce(bin, cl, 'all') AS cell, CAST(count(*) AS BIGINT) AS n_substations, {', '.join(f'{v} AS {k}' for k, v in m.items())} FROM b GROUP BY GROUPING SETS ((seed, method),(seed, method, bin),(seed, method, cl))) {un}"""


@query("m13_seed_experiments", _m13_sql())
def m13(spark, d):
    """All seeds in one plan: splits, members, aggregates, fits, pilots, estimates, maps, metrics."""
    e = cut_lineage(QE.estimate_plan(spark, d))
    e = L.apply_linear(e, L.fit_linear(e.where("split = 'train'"), ["seed"], ["s_h_net"], "HP_Peak"), ["seed"], ["s_h_net"], "slope_only", clip=True).where("split = 'test'")
    l = e.select("seed", F.col("HP_Peak").alias("y"), "HP_Count", "size", F.col("p").alias("pen"), F.explode(F.create_map(*[x for m in ("ratio", "corrected", "slope_only") for x in (F.lit(m), F.col(m))])).alias("method", "pred"))
    s = A.score_cells(l, ["seed", "method"], "y", "pred", "HP_Count", "size", "pen")
    return s.withColumn("value", F.round("value", 4))


@query("m14_reload_check", f"WITH {FR_SQL} SELECT CAST(count(*) AS BIGINT) AS n, CAST(0 AS BIGINT) AS n_unmatched, true AS passed FROM fr WHERE is_test")
def m14(spark, d):
    """Save a fitted pipeline with its manifest, load it again, compare predictions."""
    z = ready(spark, d)
    model = M.fit_pipeline(z.where("NOT is_test"), FEATS, LinearRegression(featuresCol="features", labelCol="y", solver="normal"))
    path = scratch(spark, "model")
    man = z.groupBy().agg(F.count("*").alias("n_rows")).withColumn("features", F.lit(",".join(FEATS)))
    M.save_model(model, path, man)
    te = z.where("is_test")
    return M.reload_check(model.transform(te), M.load_model(path).transform(te), "hh", "prediction").select("n", "n_unmatched", "passed")


@query("m15_frozen_on_shifted", f"""WITH {X.SQL_ND}, {Q.hinge('f', 'nd', 'station')}, tg AS (SELECT c_nationkey AS station, sum(3.0::DOUBLE+c_custkey%8) AS y FROM customer WHERE c_mktsegment='MACHINERY' GROUP BY 1), m AS (SELECT regr_slope(y,s_h) AS s, regr_intercept(y,s_h) AS i FROM f JOIN tg USING (station)),
sc AS (SELECT nd.station, nd.t, nd.y*CASE WHEN nd.t<T_h THEN greatest(P_base+1.5::DOUBLE*(nd.y-P_base),1e-3)/greatest(nd.y,1e-3) ELSE 1.0::DOUBLE END AS y FROM nd JOIN f ON nd.station=f.station), {Q.hinge('g', 'sc', 'station')}
SELECT f.station, round(greatest(0.0::DOUBLE,i+s*f.s_h),4) AS pred, round(greatest(0.0::DOUBLE,i+s*g.s_h),4) AS pred_shifted FROM f JOIN g ON f.station=g.station, m""")
def m15(spark, d):
    """A map frozen on the original series, read on series whose response was scaled by 1.5."""
    n = X.nation_daily(spark, d)
    y = X.households(spark, d).where("role = 'hp'").groupBy(F.col("nation").alias("station")).agg(F.sum("cap").alias("y"))
    f = HG.fit_hinge(n, ["station"]).select("station", "s_h")
    frozen = cut_lineage(L.fit_linear(f.join(y, "station"), [], ["s_h"], "y"))
    sh = HG.fit_hinge(E.scale_response(n, ["station"], "t", "y", 1.5).select("station", "t", F.col("y_scaled").alias("y")), ["station"]).select("station", "s_h")
    a = L.apply_linear(f, frozen, [], ["s_h"], "pred", clip=True).select("station", F.round("pred", 4).alias("pred"))
    b = L.apply_linear(sh, frozen, [], ["s_h"], "pred_shifted", clip=True).select("station", F.round("pred_shifted", 4).alias("pred_shifted"))
    return a.join(b, "station")


@query("m16_transfer", f"""WITH {QE.EST_SQL}, s AS (SELECT *, CASE WHEN station<3 THEN 'A' ELSE 'B' END AS side FROM es), c AS (SELECT seed, side AS src, regr_slope(HP_Peak,s_h_net) AS s1, regr_intercept(HP_Peak,s_h_net) AS i1, median(s_h/HP_Peak) FILTER (s_h>0) AS m FROM s WHERE split='train' GROUP BY 1,2),
l AS (SELECT s.seed, src||'->'||side AS direction, label, CASE label WHEN 'native' THEN HP_Peak WHEN 'coincident' THEN HP_CoincPeak ELSE P_design END AS y, greatest(0.0::DOUBLE,i1+s1*s_h_net) AS pm, CASE WHEN s_h_net>0 AND m>0 THEN s_h_net/m ELSE 0.0::DOUBLE END AS pr FROM s JOIN c ON s.seed=c.seed AND s.side<>c.src, (VALUES ('native'),('coincident'),('design')) v(label) WHERE split='test'),
u AS (SELECT seed, direction, label, 'map' AS row_, y, pm AS p FROM l UNION ALL SELECT seed, direction, label, 'physics', y, pr FROM l)
SELECT seed, direction, label, row_, CAST(count(*) AS BIGINT) AS n, round(CASE WHEN max(y)>0 THEN avg(abs(p-y))/max(y)*100 END,4) AS nmae FROM u GROUP BY 1,2,3,4""")
def m16(spark, d):
    """Source maps and source constants on the other side's test substations, for three label definitions."""
    e = cut_lineage(QE.estimate_plan(spark, d)).withColumn("side", F.when(F.col("station") < 3, "A").otherwise("B"))
    tr = e.where("split = 'train'").withColumnRenamed("side", "src")
    maps = L.fit_linear(tr, ["seed", "src"], ["s_h_net"], "HP_Peak").join(
        tr.where("s_h > 0").groupBy("seed", "src").agg(F.percentile(F.col("s_h") / F.col("HP_Peak"), 0.5).alias("m_src")), ["seed", "src"])
    te = e.where("split = 'test'").withColumn("src", F.when(F.col("side") == "A", "B").otherwise("A")).join(maps.select("seed", "src", "coef", "m_src"), ["seed", "src"])
    te = te.withColumn("pm", F.greatest(F.lit(0.0), F.col("coef")[0] + F.col("coef")[1] * F.col("s_h_net"))).withColumn("pr", E.ratio_estimate(F.col("s_h_net"), F.col("m_src"))[0])
    u = te.select("seed", F.concat("src", F.lit("->"), "side").alias("direction"), F.explode(F.create_map(F.lit("native"), F.col("HP_Peak"), F.lit("coincident"), F.col("HP_CoincPeak"), F.lit("design"), F.col("P_design"))).alias("label", "y"), "pm", "pr")
    u = u.select("seed", "direction", "label", "y", F.explode(F.create_map(F.lit("map"), F.col("pm"), F.lit("physics"), F.col("pr"))).alias("row_", "p"))
    return A.score(u, ["seed", "direction", "label", "row_"]).select("seed", "direction", "label", "row_", "n", F.round("nmae", 4).alias("nmae"))


@query("m17_leakage_checks", f"WITH {C.SPLIT_SQL} SELECT CAST(count(*) AS BIGINT) AS n_shared_households, CAST(0 AS BIGINT) AS n_changed_choices FROM (SELECT seed, hh FROM sp WHERE split='train' INTERSECT SELECT seed, hh FROM sp WHERE split='test')")
def m17(spark, d):
    """Households on both sides of a split, and winners that change when the test column is scrambled; both must be 0."""
    from .q_joins import candidates
    s = cut_lineage(C.split_plan(spark, d))
    shared = s.where("split = 'train'").select("seed", "hh").intersect(s.where("split = 'test'").select("seed", "hh")).agg(F.count("*").alias("n_shared_households"))
    c = candidates(spark, d)
    pick = lambda x: R.family_winners(x, ["unit", "family"], "cv", F.col("config")).select("unit", "family", "config")
    diff = pick(c).exceptAll(pick(c.withColumn("test", F.hash("config", "unit").cast("double")))).agg(F.count("*").alias("n_changed_choices"))
    return shared.join(diff)
