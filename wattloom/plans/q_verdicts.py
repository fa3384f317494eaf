"""Queries over decision rules (T rows). Metrics come from line items: unit = year, family = order priority, rung = return flag, cell = order status."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.stats import r8
from ..operators import verdicts as V
from ..session import cut_lineage
from ..sources import tables as X
from . import sqlparts as Q
from .registry import query

RUNGS = {"A": "L1", "N": "L2", "R": "L3"}


def metrics(spark, d):
    l, o = X.table(spark, d, "lineitem"), X.table(spark, d, "orders")
    j = l.join(o, l.l_orderkey == o.o_orderkey)
    m = F.create_map(*[F.lit(x) for kv in RUNGS.items() for x in kv])
    return j.groupBy(F.year("o_orderdate").alias("seed"), F.substring("o_orderpriority", 3, 20).alias("fam"), m[F.col("l_returnflag")].alias("rung"), F.col("o_orderstatus").alias("cell")).agg(
        (F.avg("l_extendedprice") / 999.91).alias("value"))


M_SQL = """mt AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS seed, substr(o_orderpriority,3,20) AS fam, CASE l_returnflag WHEN 'A' THEN 'L1' WHEN 'N' THEN 'L2' ELSE 'L3' END AS rung, o_orderstatus AS cell, avg(l_extendedprice)/999.91::DOUBLE AS value
 FROM lineitem JOIN orders ON l_orderkey=o_orderkey GROUP BY 1,2,3,4)"""
STEP_SQL = f"""{M_SQL}, w AS (SELECT seed, fam, cell, max(value) FILTER (rung='L1') AS l1, max(value) FILTER (rung='L2') AS l2, max(value) FILTER (rung='L3') AS l3 FROM mt GROUP BY 1,2,3),
st AS (SELECT seed, fam, cell, 'L2 vs L1' AS step, l2-l1 AS d, l1 AS base FROM w UNION ALL SELECT seed, fam, cell, 'L3 vs L2', l3-l2, l2 FROM w)"""


def verdict_sql(keys: str, src: str, d: str = "d", eff: float = 1.0, share: float = 0.8, name="vd") -> str:
    return f"""{name}0 AS (SELECT {keys}, count(*) AS n, count(*) FILTER ({d}<0) AS n_neg, count(*) FILTER ({d}>0) AS n_pos, median({d}) AS med FROM {src} WHERE {d} IS NOT NULL GROUP BY {keys}),
{name} AS (SELECT {keys}, n, n_neg, med, CASE WHEN n_neg/n>={share} AND med<=-{eff} THEN 'better' WHEN n_pos/n>={share} AND med>={eff} THEN 'worse' ELSE 'no difference' END AS verdict FROM {name}0)"""


def step_rows(spark, d):
    return V.steps(metrics(spark, d), "seed", ["fam", "cell"], "rung", "value", [("L2", "L1"), ("L3", "L2")])


@query("t01_wide_metrics", f"""WITH {M_SQL} SELECT seed, fam, rung, round(max(value) FILTER (cell='F'),8) AS "F", round(max(value) FILTER (cell='O'),8) AS "O", round(max(value) FILTER (cell='P'),8) AS "P" FROM mt GROUP BY 1,2,3""")
def t01(spark, d):
    w = V.wide(metrics(spark, d), ["seed", "fam", "rung"], "cell", "value", ["F", "O", "P"])
    return w.select("seed", "fam", "rung", *[r8(c).alias(c) for c in ("F", "O", "P")])


@query("t02_paired_verdict", f"WITH {STEP_SQL}, {verdict_sql('fam, cell, step', 'st', share=0.6)} SELECT fam, cell, step, CAST(n AS BIGINT) AS n, CAST(n_neg AS BIGINT) AS n_neg, round(med,8) AS median, verdict FROM vd")
def t02(spark, d):
    v = V.verdict(step_rows(spark, d), ["fam", "cell", "step"], "d", share=0.6)
    return v.withColumn("median", r8("median"))


@query("t02_relative_verdict", f"""WITH {STEP_SQL}, g AS (SELECT fam, cell, step, count(*) AS n, count(*) FILTER (d<0) AS a, count(*) FILTER (d>0) AS b, median(d/base) AS mr, median(d) AS md FROM st WHERE d IS NOT NULL GROUP BY 1,2,3)
SELECT fam, cell, step, CAST(n AS BIGINT) AS n, CAST(a AS BIGINT) AS n_neg, round(mr,8) AS median_rel, round(md,8) AS median_diff, CASE WHEN a/n>=0.6 AND mr<=-0.02 THEN 'better' WHEN b/n>=0.6 AND mr>=0.02 THEN 'worse' ELSE 'no difference' END AS verdict FROM g""")
def t02_rel(spark, d):
    v = V.rel_verdict(step_rows(spark, d), ["fam", "cell", "step"], "d", "base", share=0.6, thr=0.02)
    return v.withColumn("median_rel", r8("median_rel")).withColumn("median_diff", r8("median_diff"))


PAIR_SQL = f"""{M_SQL}, rm AS (SELECT cell, fam, median(value) AS m FROM mt WHERE rung='L1' GROUP BY 1,2), rb AS (SELECT cell, fam AS reference FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY m, fam) AS rn FROM rm) WHERE rn=1),
pa AS (SELECT a.seed, a.cell, a.fam, reference, a.value-b.value AS d FROM mt a JOIN rb USING (cell) JOIN mt b ON b.seed=a.seed AND b.cell=a.cell AND b.fam=reference AND b.rung='L1' WHERE a.rung='L3')"""


def pair_rows(spark, d):
    m = metrics(spark, d)
    return V.paired(m.where("rung = 'L3'").drop("rung"), m.where("rung = 'L1'").select("seed", "cell", F.col("fam").alias("method"), "value"), ["seed"], ["cell"], "method", "value")


@query("t03_paired_winners", f"WITH {PAIR_SQL} SELECT fam, cell, any_value(reference) AS reference, CAST(count(d) AS BIGINT) AS n, CAST(count(*) FILTER (d<0) AS BIGINT) AS wins, round(median(d),8) AS median_d, count(*) FILTER (d<0)/count(d)>=0.5 AND median(d)<=-1 AS meets FROM pa GROUP BY 1,2")
def t03(spark, d):
    return V.criterion(pair_rows(spark, d), ["fam", "cell", "reference"], share=0.5).withColumn("median_d", r8("median_d"))


LC_NS = (12, 25, 50)
LC_ROWS = f"""lo AS (SELECT o_orderpriority AS fam, o_orderstatus AS cell, CAST(year(o_orderdate) AS INTEGER) AS seed, o_orderkey AS k, o_totalprice AS v FROM orders), tru AS (SELECT fam, cell, avg(v) AS y FROM lo GROUP BY 1,2),
ph AS (SELECT cell, seed, avg(v) AS v FROM lo GROUP BY 1,2), lr AS (SELECT *, row_number() OVER (PARTITION BY fam, cell, seed, dr ORDER BY {Q.md("'t04'", 'dr', 'k')}) AS pos, count(*) OVER (PARTITION BY fam, cell, seed, dr) AS m FROM lo, range(3) r(dr)),
lv AS (SELECT fam, cell, seed, dr, n, any_value(m) AS n_all, avg(v) AS v FROM lr, (VALUES {', '.join(f'({n})' for n in LC_NS)}, (NULL)) x(n) WHERE (n IS NULL AND dr=0) OR (pos<=n AND n<=m) GROUP BY 1,2,3,4,5),
lc AS (SELECT fam, cell, seed, dr, n, n_all, abs(lv.v-y)/y*100 AS wape, abs(ph.v-y)/y*100 AS phys FROM lv JOIN tru USING (fam, cell) JOIN ph USING (cell, seed)),
lp AS (SELECT fam, cell, seed, coalesce(n, n_all)::DOUBLE AS n, median(wape) AS w FROM lc GROUP BY 1,2,3,4),
p1 AS (SELECT fam, cell, seed, c, n, w, power(n,-c) AS x FROM lp, (SELECT 0.001::DOUBLE + i*(2.0::DOUBLE-0.001::DOUBLE)/40 AS c FROM range(41) r(i))),
p2 AS (SELECT fam, cell, seed, c, round(regr_syy(w,x)-coalesce(regr_slope(w,x),0)*regr_sxy(w,x),12) AS sse FROM p1 GROUP BY ALL HAVING regr_slope(w,x) IS NOT NULL), p3 AS (SELECT fam, cell, seed, arg_min(c, (sse,c)) AS c0 FROM p2 GROUP BY ALL),
p4 AS (SELECT DISTINCT fam, cell, seed, n, w, least(2.0::DOUBLE,greatest(0.001::DOUBLE,c0+i*((2.0::DOUBLE-0.001::DOUBLE)/40/20))) AS c FROM lp JOIN p3 USING (fam, cell, seed), range(-20,21) r(i)), p5 AS (SELECT *, power(n,-c) AS x FROM p4),
p6 AS (SELECT fam, cell, seed, c, regr_slope(w,x) AS b, regr_intercept(w,x) AS a, round(regr_syy(w,x)-coalesce(regr_slope(w,x),0)*regr_sxy(w,x),12) AS sse, count(*) AS n_points FROM p5 GROUP BY fam, cell, seed, c HAVING regr_slope(w,x) IS NOT NULL QUALIFY row_number() OVER (PARTITION BY fam, cell, seed ORDER BY round(regr_syy(w,x)-coalesce(regr_slope(w,x),0)*regr_sxy(w,x),12), c)=1),
pf AS (SELECT p6.*, phys AS ref_, a<phys AS a_below, CASE WHEN a>=phys THEN NULL WHEN b<=0 THEN 0.0::DOUBLE ELSE power(b/(phys-a),1/c) END AS n_star, (c<=0.00101 OR c>=1.998) AS fc, a<0 AS fa FROM p6 JOIN lc USING (fam, cell, seed) WHERE lc.n IS NULL AND n_points>=3)"""


def curve_rows(spark, d):
    """Learning curves from orders: error of the mean of n drawn orders of a priority and year, against the mean over all years; the reference is the year's mean over all priorities."""
    from ..functions.hashing import digest, hash_rank
    o = X.table(spark, d, "orders").select(F.col("o_orderpriority").alias("fam"), F.col("o_orderstatus").alias("cell"), F.year("o_orderdate").alias("seed"), F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    r = hash_rank(o.withColumn("dr", F.explode(F.sequence(F.lit(0), F.lit(2)))), ["fam", "cell", "seed", "dr"], digest(F.lit("t04"), F.col("dr"), F.col("k")))
    sizes = F.array(*[F.lit(n) for n in LC_NS], F.lit(None).cast("int"))
    n = F.filter(sizes, lambda x: F.when(x.isNull(), F.col("dr") == 0).otherwise((F.col("pos") < x) & (x <= F.col("pool_size"))))
    g = r.withColumn("n", F.explode(n)).groupBy("fam", "cell", "seed", "dr", "n").agg(F.first("pool_size").alias("n_all"), F.avg("v").alias("v"))
    true = o.groupBy("fam", "cell").agg(F.avg("v").alias("y"))
    phys = o.groupBy("cell", "seed").agg(F.avg("v").alias("p"))
    err = lambda c: F.abs(F.col(c) - F.col("y")) / F.col("y") * 100
    return g.join(true, ["fam", "cell"]).join(phys, ["cell", "seed"]).select("fam", "cell", "seed", "dr", "n", "n_all", err("v").alias("wape"), err("p").alias("phys"))


@query("t04_curve_fits", f"""WITH {LC_ROWS} SELECT fam, cell, seed, round(a,4) AS a, round(b,4) AS b, round(c,5) AS c, fc AS flag_c_bound, fa AS flag_a_neg, a_below, round(n_star,3) AS n_star FROM pf""")
def t04_fits(spark, d):
    f = V.curve_fits(cut_lineage(curve_rows(spark, d)), ["fam", "cell"], "seed", "n", "n_all", "wape", "phys")
    return f.select("fam", "cell", "seed", F.round("a", 4).alias("a"), F.round("b", 4).alias("b"), F.round("c", 5).alias("c"), "flag_c_bound", "flag_a_neg", "a_below",
                    F.when(F.col("n_star") < float("inf"), F.round("n_star", 3)).alias("n_star"))


@query("t04_data_limit", f"""WITH {LC_ROWS}, dp AS (SELECT x.fam, x.cell, median(x.wape-z.wape) AS dm, avg((x.wape-z.wape>0)::INT) AS ds, count(*) AS np FROM lc x JOIN lc z ON x.fam=z.fam AND x.cell=z.cell AND x.seed=z.seed WHERE x.n=25 AND z.n IS NULL GROUP BY 1,2),
ga AS (SELECT fam, cell, median(wape-phys) FILTER (n IS NULL) AS am, avg((wape-phys<0)::INT) FILTER (n IS NULL) AS ash, median(wape-phys) FILTER (n=25) AS d25, median(wape-phys) FILTER (n=50) AS d50 FROM lc GROUP BY 1,2),
af AS (SELECT fam, cell, avg(a_below::INT) AS asy, median(n_star) AS ns, count(*) FILTER (n_star IS NULL) AS ni, count(*) FILTER (fc OR fa) AS ff FROM pf GROUP BY 1,2)
SELECT fam, cell, round(dm,8) AS drop_median, round(ds,8) AS drop_share, coalesce(np,0) AS n_pairs, round(am,8) AS all_median_d, round(ash,8) AS all_share, round(asy,8) AS asymptote_share, round(ns,3) AS n_star_median, coalesce(ni,0) AS n_star_inf, coalesce(ff,0) AS fit_flags,
 CASE WHEN coalesce(dm>=1 AND ds>=0.8,false) AND (coalesce(ash>=0.8 AND am<=-1,false) OR coalesce(asy>=0.8,false)) THEN 'D' WHEN coalesce(abs(dm)<1 AND am>=0 AND d25>=0 AND d50>=0,false) THEN 'I or features' ELSE 'inconclusive' END AS verdict FROM ga LEFT JOIN dp USING (fam, cell) LEFT JOIN af USING (fam, cell)""")
def t04(spark, d):
    v = V.data_limit(cut_lineage(curve_rows(spark, d)), ["fam", "cell"], "seed", "n", "n_all", "wape", "phys", 25, (50,))
    return v.select("fam", "cell", *[r8(x).alias(x) for x in ("drop_median", "drop_share", "all_median_d", "all_share", "asymptote_share")], F.round("n_star_median", 3).alias("n_star_median"), "n_pairs", "n_star_inf", "fit_flags", "verdict")


@query("t05_ladder_steps", f"""WITH {STEP_SQL}, {verdict_sql('fam, cell, step', 'st', share=0.5)}, c AS (SELECT fam, step, CASE WHEN count(*) FILTER (verdict='better')>=2 AND count(*) FILTER (verdict='worse')=0 THEN 'better' WHEN count(*) FILTER (verdict='worse')>=2 AND count(*) FILTER (verdict='better')=0 THEN 'worse' ELSE 'no difference' END AS combined FROM vd GROUP BY 1,2) SELECT * FROM c""")
def t05(spark, d):
    return V.combine_readings(V.verdict(step_rows(spark, d), ["fam", "cell", "step"], "d", share=0.5), ["fam", "step"])


@query("t05_family_agreement", f"""WITH {STEP_SQL}, {verdict_sql('fam, cell, step', 'st', share=0.5)}, g AS (SELECT cell, step, CASE WHEN count(DISTINCT verdict)=1 THEN min(verdict) ELSE 'mixed' END AS all_families, CASE WHEN count(DISTINCT verdict) FILTER (fam<>'LOW')=1 THEN min(verdict) FILTER (fam<>'LOW') ELSE 'mixed' END AS without_one FROM vd GROUP BY 1,2)
SELECT *, all_families<>without_one AS dependent FROM g""")
def t05_agree(spark, d):
    return V.agreement(V.verdict(step_rows(spark, d), ["fam", "cell", "step"], "d", share=0.5), ["cell", "step"], "fam", "LOW")


@query("t06_claim_rule", f"""WITH {STEP_SQL}, {verdict_sql('fam, cell, step', 'st', share=0.5)}, md AS (SELECT fam, median(value) FILTER (rung='L3') AS hybrid, median(value) FILTER (rung='L2') AS plain FROM mt GROUP BY 1),
s AS (SELECT fam, max(verdict) FILTER (cell='F' AND step='L3 vs L2') AS sv, max(verdict) FILTER (cell='O' AND step='L3 vs L2') AS rv FROM vd GROUP BY 1)
SELECT md.fam, round(hybrid,8) AS hybrid, round(plain,8) AS plain, round(hybrid-plain,8) AS gap, CASE WHEN hybrid-plain>1 OR (sv<>'better' AND rv<>'better') THEN 'fails' WHEN sv='better' AND rv='better' THEN 'holds' ELSE 'open' END AS outcome FROM md JOIN s USING (fam)""")
def t06(spark, d):
    m = cut_lineage(metrics(spark, d))
    med = m.groupBy("fam").agg(F.percentile(F.when(F.col("rung") == "L3", F.col("value")), 0.5).alias("hybrid"), F.percentile(F.when(F.col("rung") == "L2", F.col("value")), 0.5).alias("plain"))
    v = V.verdict(V.steps(m, "seed", ["fam", "cell"], "rung", "value", [("L2", "L1"), ("L3", "L2")]), ["fam", "cell", "step"], "d", share=0.5).where("step = 'L3 vs L2'")
    s = v.groupBy("fam").agg(F.max(F.when(F.col("cell") == "F", F.col("verdict"))).alias("sv"), F.max(F.when(F.col("cell") == "O", F.col("verdict"))).alias("rv"))
    c = V.claim(med.join(s, "fam"), F.col("sv"), F.col("rv"), "hybrid", "plain")
    return c.select("fam", *[r8(x).alias(x) for x in ("hybrid", "plain", "gap")], "outcome")


@query("t06_ensemble_keep_rule", f"""WITH {STEP_SQL}, {verdict_sql('fam, cell, step', 'st', share=0.5)} SELECT fam, bool_or(cell IN ('F','O') AND verdict='better') AS kept FROM vd GROUP BY 1""")
def t06_keep(spark, d):
    return V.keep_ensemble(V.verdict(step_rows(spark, d), ["fam", "cell", "step"], "d", share=0.5), ["fam"], "cell", ("F", "O"))


@query("t07_transfer_outcome", f"""WITH {STEP_SQL}, s2 AS (SELECT * REPLACE (CASE WHEN cell='F' THEN 'F' ELSE 'open' END AS cell) FROM st), {verdict_sql('fam, cell', 's2', share=0.5)} SELECT fam, CASE WHEN count(*) FILTER (verdict='worse')>0 THEN 'refuted' WHEN count(*) FILTER (verdict='better')=2 THEN 'confirmed' WHEN count(*) FILTER (verdict='better')=1 THEN 'partly confirmed' ELSE 'not confirmed' END AS outcome FROM vd GROUP BY 1""")
def t07(spark, d):
    """Two directions: finished orders, and all that are open."""
    s = step_rows(spark, d).withColumn("cell", F.when(F.col("cell") == "F", "F").otherwise("open"))
    v = V.verdict(s, ["fam", "cell"], "d", share=0.5)
    return V.transfer_outcome(v, ["fam"])


@query("t08_gain_over_baseline", f"""WITH {M_SQL}, b AS (SELECT seed, cell, fam AS best_base, value AS bv FROM (SELECT *, row_number() OVER (PARTITION BY seed, cell ORDER BY value, fam) AS rn FROM mt WHERE rung='L1') WHERE rn=1)
SELECT mt.seed, mt.cell, mt.rung||' '||mt.fam AS fam, round(value,8) AS value, 'L1 '||best_base AS best_base, round(bv-value,8) AS gain FROM mt JOIN b USING (seed, cell) WHERE rung<>'L1'""")
def t08(spark, d):
    m = metrics(spark, d).withColumn("fam", F.concat_ws(" ", "rung", "fam"))
    g = V.gain_over_best(m, "seed", ["cell"], F.col("rung") == "L1", "fam", "value")
    return g.select("seed", "cell", "fam", r8("value").alias("value"), "best_base", r8("gain").alias("gain"))


@query("t09_two_level_bias", f"""WITH {M_SQL}, g AS (SELECT fam, cell, seed, median(value) AS m FROM mt GROUP BY 1,2,3) SELECT fam, cell, round(median(m),8) AS median, round(max(m),8) AS "max", CAST(count(*) AS BIGINT) AS n FROM g GROUP BY 1,2""")
def t09(spark, d):
    g = V.two_level_median(metrics(spark, d), ["fam", "cell"], ["seed"], "value")
    return g.select("fam", "cell", r8("median").alias("median"), r8("max").alias("max"), "n")


@query("t10_arm_deltas", f"""WITH {M_SQL} SELECT a.fam, a.cell, round(median(a.value-b.value),8) AS median_delta, CAST(count(*) AS BIGINT) AS n FROM mt a JOIN mt b ON a.seed=b.seed AND a.fam=b.fam AND a.cell=b.cell AND a.rung='L3' AND b.rung='L1' GROUP BY 1,2""")
def t10(spark, d):
    m = metrics(spark, d)
    return V.delta(m.where("rung = 'L3'"), m.where("rung = 'L1'"), ["seed", "fam", "cell"], ["fam", "cell"], "value").withColumn("median_delta", r8("median_delta"))


@query("t11_consistency_checks", """WITH z AS (SELECT o_orderpriority AS fam, o_totalprice AS y, round(o_totalprice*(0.8::DOUBLE+(o_orderkey%7)/15.0::DOUBLE),6) AS p, o_totalprice<100000 AS invalid FROM orders),
g AS (SELECT fam, avg(abs(p-y))/max(y)*100 AS nmae, sum(abs(p-y))/sum(y)*100*avg(y)/max(y) AS viaw, avg(CASE WHEN invalid THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS inv FROM z GROUP BY 1) SELECT fam, round(nmae,6) AS nmae, abs(nmae-viaw)<1e-9 AS identity_holds, round(inv,8) AS invalid_share FROM g""")
def t11(spark, d):
    from ..operators.aggregate import score
    from .q_aggregate import order_predictions
    p = order_predictions(spark, d).withColumnRenamed("o_orderpriority", "fam")
    s = score(p, ["fam"]).join(p.groupBy("fam").agg(F.avg("y").alias("ym"), F.avg((F.col("y") < 100000).cast("double")).alias("inv")), "fam")
    return s.select("fam", F.round("nmae", 6).alias("nmae"), (F.abs(F.col("nmae") - F.col("wape") * F.col("ym") / F.col("y_max")) < 1e-9).alias("identity_holds"), r8("inv").alias("invalid_share"))


@query("t12_results_to_long", """WITH w AS (SELECT o_orderpriority AS method, avg(o_totalprice)/999.91::DOUBLE AS rmse, max(o_totalprice) AS mae, CASE WHEN min(o_totalprice)<2000 THEN min(o_totalprice) END AS mape FROM orders GROUP BY 1)
SELECT 'orders' AS dataset, method, metric, round(value,8) AS value FROM (SELECT method, 'rmse' AS metric, rmse AS value FROM w UNION ALL SELECT method, 'mae', mae FROM w UNION ALL SELECT method, 'mape', mape FROM w) WHERE value IS NOT NULL""")
def t12(spark, d):
    w = X.table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("method")).agg((F.avg("o_totalprice") / 999.91).alias("rmse"), F.max("o_totalprice").alias("mae"),
                                                                                          F.when(F.min("o_totalprice") < 2000, F.min("o_totalprice")).alias("mape"))
    return V.to_long(w, ["method"], {"dataset": "orders"}).withColumn("value", r8("value"))


@query("t13_job_status", """WITH j AS (SELECT o_orderkey AS job, o_orderpriority AS arm, o_orderstatus AS fam FROM orders), m AS (SELECT l_orderkey AS job, bool_or(l_linestatus='F') AS dn, bool_or(l_linestatus='O' AND l_returnflag='R') AS fl FROM lineitem GROUP BY 1)
SELECT arm, fam, CAST(count(*) AS BIGINT) AS jobs, CAST(count(*) FILTER (coalesce(dn,false)) AS BIGINT) AS done, CAST(count(*) FILTER (coalesce(fl,false) AND NOT coalesce(dn,false)) AS BIGINT) AS failed, CAST(count(*) FILTER (NOT coalesce(dn,false) AND NOT coalesce(fl,false)) AS BIGINT) AS missing FROM j LEFT JOIN m USING (job) GROUP BY 1,2""")
def t13(spark, d):
    j = X.table(spark, d, "orders").select(F.col("o_orderkey").alias("job"), F.col("o_orderpriority").alias("arm"), F.col("o_orderstatus").alias("fam"))
    m = X.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("job"), F.when(F.col("l_linestatus") == "F", "done").when(F.col("l_returnflag") == "R", "failed").otherwise("open").alias("state"))
    return V.job_status(j, m, "arm", "fam")


@query("t14_log_parameters", r"""WITH l AS (SELECT page_id, regexp_extract(url, '^https?://([^/]+)/([a-z]+)/([0-9]+)', 1) AS host, regexp_extract(url, '^https?://([^/]+)/([a-z]+)/([0-9]+)', 2) AS lang, regexp_extract(url, '^https?://([^/]+)/([a-z]+)/([0-9]+)', 3) AS num FROM pages WHERE regexp_matches(url, '^https?://([^/]+)/([a-z]+)/([0-9]+)')) SELECT * FROM l""")
def t14(spark, d):
    p = X.table(spark, d, "pages").select("page_id", "url")
    return V.log_parameters(p, "url", r"^https?://([^/]+)/([a-z]+)/([0-9]+)", ["host", "lang", "num"])


@query("t14_log_matching", """WITH r AS (SELECT o_orderpriority AS k, o_orderkey AS id, o_totalprice/1000 AS v FROM orders), l AS (SELECT o_orderpriority AS k, o_totalprice/1000 AS v, o_orderstatus AS p FROM orders)
SELECT r.k, r.id, CAST(count(l.v) AS BIGINT) AS n_matches, CASE WHEN count(DISTINCT p)=0 THEN 'no log line' WHEN count(DISTINCT p)=1 THEN 'ok' ELSE 'ambiguous' END AS status, CASE WHEN count(DISTINCT p)=1 THEN min(p) END AS params FROM r LEFT JOIN l ON r.k=l.k AND abs(l.v-r.v)<=0.05 GROUP BY 1,2""")
def t14_match(spark, d):
    o = X.table(spark, d, "orders")
    r = o.select(F.col("o_orderpriority").alias("k"), F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / 1000).alias("v"))
    l = o.select(F.col("o_orderpriority").alias("k"), (F.col("o_totalprice") / 1000).alias("v"), F.col("o_orderstatus").alias("p"))
    return V.match_logs(r, l, ["k"], "v", "v", "p").select("k", "id", "n_matches", "status", "params")


@query("m18_carry_forward", f"""WITH {M_SQL}, m AS (SELECT fam, median(value) AS md FROM mt GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY md, fam) AS rk, md-min(md) OVER () AS gap FROM m)
SELECT fam, round(md,8) AS median_inner, CAST(rk AS INTEGER) AS rank, round(gap,8) AS gap, CASE WHEN rk<=2 THEN 'top' WHEN gap<=1 THEN 'near' WHEN fam='LOW' THEN 'always' ELSE 'not carried' END AS reason, (rk<=2 OR gap<=1 OR fam='LOW') AS carried FROM r""")
def m18(spark, d):
    c = V.carry_forward(metrics(spark, d), "fam", "value", always="LOW")
    return c.select("fam", r8("median_inner").alias("median_inner"), "rank", r8("gap").alias("gap"), "reason", "carried")
