"""Queries over pilots, estimators, calibration, residuals, scales, curves and ensembles."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import digest
from ..functions.stats import corr, r8
from ..operators import aggregate as A, cohorts as K, estimators as E, hinge as HG, linear as L, models as M
from ..session import cut_lineage
from ..sources import tables as X
from . import q_cohorts as C, sqlparts as Q
from .q_clean import easter_table
from .registry import query


def rnd(df, cols, n=6):
    return df.select(*[F.round(c, n).alias(c) if c in cols else F.col(c) for c in df.columns])


def rsql(cols, n=6):
    return ", ".join(f"round({c},{n}) AS {c}" for c in cols)


# ------------------------------------------------------------------ pilots
def train_hp(spark, d):
    return C.pool_plan(spark, d).where("split = 'train' AND role = 'hp'").select("seed", "hh", "station", "cap")


def summed(days, keys):
    return days.groupBy(*keys, "day").agg(*[F.sum(c).alias(c) for c in ("n", "hp", "own")])


def pilot_sets(spark, d, min_station=10):
    """seed, pilot ('all' or a station with enough HP homes), hh, station, cap."""
    t = train_hp(spark, d)
    n = t.groupBy("seed", "station").agg(F.count("*").alias("n")).where(F.col("n") >= min_station).select("seed", "station")
    per = t.join(n, ["seed", "station"]).withColumn("pilot", F.concat(F.lit("S"), F.col("station").cast("string")))
    return cut_lineage(t.withColumn("pilot", F.lit("all")).unionByName(per))


def pilot_plan(spark, d):
    sets = pilot_sets(spark, d)
    days = C.train_days_plan(spark, d).where("role = 'hp'").join(sets.select("seed", "pilot", "station").distinct(), ["seed", "station"])
    return E.pilots(sets, ["seed", "pilot"], None, C.temperature_plan(spark, d), summed(days, ["seed", "pilot"]))


def pilot_sql(name: str, sets: str, keys: str) -> str:
    """CTEs ending in `name`(keys, T_h, s_whole, b, m, cap, n_hh) of household sets `sets`(keys, hh, station, cap)."""
    using = f"USING ({keys})"
    ks = ", ".join(f"s.{k.strip()}" for k in keys.split(","))
    return f"""{name}_n AS (SELECT {keys}, sum(cap) AS cap, CAST(count(*) AS BIGINT) AS n_hh FROM {sets} GROUP BY {keys}),
{name}_l AS (SELECT {ks}, rd.day, sum(rd.hp) AS hp, sum(own) AS own FROM {sets} s JOIN rd ON s.hh=rd.hh GROUP BY {ks}, rd.day),
{name}_w AS (SELECT {keys}, station, sum(cap) AS w FROM {sets} GROUP BY {keys}, station),
{name}_t AS (SELECT {ks}, stt.day, sum(w*t) AS wt FROM {name}_w s JOIN stt ON s.station=stt.station GROUP BY {ks}, stt.day),
{name}_d AS (SELECT {keys}, day, hp, own, hp+own AS y, cap, wt/cap AS T FROM {name}_l JOIN {name}_t USING ({keys}, day) JOIN {name}_n {using}),
{arm_sql(name, keys)},
{name} AS (SELECT {keys}, T_h, s_whole, P_base, b, m, cap, n_hh FROM {name}_a JOIN {name}_n {using})"""


def arm_sql(name: str, keys: str) -> str:
    """Hinge and saturation arm of `name`_d(keys, hp, own, y, cap, T), ending in `name`_a(keys, T_h, s_whole, P_base, b, m)."""
    return f"""{Q.hinge(name + '_f', name + '_d', keys, 'T', 'y')},
{name}_x AS (SELECT {keys}, T_h-T AS x, least(1.0::DOUBLE, greatest(0.0::DOUBLE, hp/cap)) AS sf FROM {name}_d JOIN {name}_f USING ({keys})),
{name}_g AS (SELECT {keys}, count(*) FILTER (x>0) AS n, stddev_pop(sf) FILTER (x>0) AS sd, regr_slope(sf,x) FILTER (x>0) AS m, regr_intercept(sf,x) FILTER (x>0) AS b FROM {name}_x GROUP BY {keys}),
{name}_a AS (SELECT {keys}, T_h, s_h AS s_whole, P_base, CASE WHEN n>=10 AND sd>0 THEN b END AS b, CASE WHEN n>=10 AND sd>0 THEN m END AS m FROM {name}_f JOIN {name}_g USING ({keys}))"""


PILOT_BASE = f"{C.SPLIT_SQL}, {C.READ_TAIL}, {X.SQL_ST}, thp AS (SELECT seed, hh, station, cap FROM sp WHERE split='train' AND role='hp')"
PSET_SQL = "pset AS (SELECT seed, 'all' AS pilot, hh, station, cap FROM thp UNION ALL SELECT seed, 'S'||station, hh, station, cap FROM thp JOIN (SELECT seed, station FROM thp GROUP BY ALL HAVING count(*)>=10) USING (seed, station))"
PILOT_SQL = f"{PILOT_BASE}, {PSET_SQL}, {pilot_sql('pil', 'pset', 'seed, pilot')}"
PCOLS = ("T_h", "b", "m", "cap")


@query("r07_pilots", f"WITH {PILOT_SQL} SELECT seed, pilot, n_hh, {rsql(PCOLS)} FROM pil")
def r07(spark, d):
    return rnd(pilot_plan(spark, d).select("seed", "pilot", "n_hh", *PCOLS), PCOLS)


def s0_plan(spark, d):
    fill = C.pool_plan(spark, d).where("split = 'train' AND role = 'fill'").select("seed", "hh", "station", "cap")
    heat = 0.004 * F.greatest(F.lit(0.0), 16 - X.temperature_at(F.col("station"), F.col("day")))      # of each home with a reading: a station's homes share its temperature
    days = C.train_days_plan(spark, d).where("role = 'fill'").withColumn("own", F.col("own") + F.col("n") * heat)
    return E.dwelling_slope(fill, ["seed"], None, C.temperature_plan(spark, d), summed(days, ["seed"]))


S0_SQL = f"""sfil AS (SELECT seed, hh, station FROM sp WHERE split='train' AND role='fill'), s0n AS (SELECT seed, CAST(count(*) AS BIGINT) AS N_ FROM sfil GROUP BY 1),
s0l AS (SELECT seed, day, sum(own+0.004::DOUBLE*greatest(0.0::DOUBLE,16-t)) AS y FROM sfil JOIN rd ON sfil.hh=rd.hh GROUP BY 1,2), s0w AS (SELECT seed, station, count(*)::DOUBLE AS w FROM sfil GROUP BY 1,2),
s0t AS (SELECT seed, day, sum(w*t)/max(N_) AS T FROM s0w JOIN stt USING (station) JOIN s0n USING (seed) GROUP BY 1,2), s0d AS (SELECT seed, day, y, T FROM s0l JOIN s0t USING (seed, day)),
{Q.hinge('s0f', 's0d', 'seed', 'T', 'y')}, s0 AS (SELECT seed, s_h/N_ AS s0, s_h, T_h, P_base, N_ FROM s0f JOIN s0n USING (seed))"""


@query("r09_dwelling_slope", f"WITH {PILOT_BASE}, {S0_SQL} SELECT seed, round(s0,8) AS s0, {rsql(('s_h', 'T_h', 'P_base'))}, N_ AS n_dwellings FROM s0")
def r09(spark, d):
    s = s0_plan(spark, d)
    return s.select("seed", r8("s0").alias("s0"), *[F.round(c, 6).alias(c) for c in ("s_h", "T_h", "P_base")], F.col("N").alias("n_dwellings"))


@query("r08_whole_house_pilot", f"WITH {PILOT_SQL}, {S0_SQL} SELECT seed, pilot, n_hh, round(s_whole,6) AS s_whole, round((s_whole-n_hh*s0)/cap,8) AS m_own FROM pil JOIN s0 USING (seed)")
def r08(spark, d):
    p = pilot_plan(spark, d).join(s0_plan(spark, d).select("seed", "s0"), "seed")
    return E.whole_house_slope(p, F.col("s0")).select("seed", "pilot", "n_hh", F.round("s_whole", 6).alias("s_whole"), r8("m_own").alias("m_own"))


# ------------------------------------------------------------------ estimates per substation
def estimate_plan(spark, d):
    """Targets with pilot numbers and every named estimate."""
    tab = C.target_plan(spark, d)
    pil = cut_lineage(pilot_plan(spark, d))
    full = pil.where("pilot = 'all'").select("seed", F.col("m").alias("m_full"), F.col("T_h").alias("T_full"), "cap", "n_hh", "s_whole")
    st = pil.where("pilot <> 'all'").select("seed", F.substring("pilot", 2, 9).cast("int").alias("station"), F.col("m").alias("m_station"))
    j = tab.join(full, "seed").join(st, ["seed", "station"], "left").join(s0_plan(spark, d).select("seed", "s0"), "seed")
    j = E.whole_house_slope(j, F.col("s0"))
    s, n = F.col("s_h_net"), F.col("size")
    for name, (p, v) in {
        "ratio": E.ratio_estimate(s, F.col("m_full")), "ratio_station": E.ratio_estimate(s, F.coalesce("m_station", "m_full")),
        "corrected": E.corrected_estimate(s, n, F.col("s0"), F.col("m_full")), "corrected_own": E.corrected_estimate(s, n, F.col("s0"), F.col("m_own")),
    }.items():
        j = j.withColumn(name, p).withColumn(f"{name}_valid", v)
    return j.withColumn("station_fallback", F.col("m_station").isNull())


def _est(name, s, m):
    return f"CASE WHEN {s}>0 AND {m}>0 THEN ({s})/({m}) ELSE 0.0::DOUBLE END AS {name}, coalesce({s}>0 AND {m}>0, false) AS {name}_valid"


EST_SQL = f"""{C.TARGET_SQL}, {X.SQL_ST}, thp AS (SELECT seed, hh, station, cap FROM sp WHERE split='train' AND role='hp'), {PSET_SQL}, {pilot_sql('pil', 'pset', 'seed, pilot')}, {S0_SQL},
es AS (SELECT tb.*, a.m AS m_full, a.T_h AS T_full, a.cap, a.n_hh, b.m AS m_station, s0.s0, (a.s_whole-a.n_hh*s0.s0)/a.cap AS m_own, b.m IS NULL AS station_fallback,
 {_est('ratio', 's_h_net', 'a.m')}, {_est('ratio_station', 's_h_net', 'coalesce(b.m,a.m)')}, {_est('corrected', '(s_h_net-size*s0.s0)', 'a.m')}, {_est('corrected_own', '(s_h_net-size*s0.s0)', '((a.s_whole-a.n_hh*s0.s0)/a.cap)')}
 FROM tb JOIN pil a ON tb.seed=a.seed AND a.pilot='all' LEFT JOIN pil b ON tb.seed=b.seed AND b.pilot='S'||tb.station JOIN s0 ON s0.seed=tb.seed)"""
ECOLS = ("ratio", "ratio_station", "corrected", "corrected_own")


@query("r10_capacity_estimates", f"WITH {EST_SQL} SELECT sub_id, station_fallback, ratio_valid, corrected_valid, {rsql(ECOLS)} FROM es")
def r10(spark, d):
    e = estimate_plan(spark, d)
    return e.select("sub_id", "station_fallback", "ratio_valid", "corrected_valid", *[F.round(c, 6).alias(c) for c in ECOLS])


def crossfit_plan(spark, d):
    """Cross-fitted pilot slope per inner fold and per train substation."""
    m = C.member_plan(spark, d).where("role = 'hp'")
    hh = C.hh_table(spark, d).select("hh", "cap", F.col("station").alias("home"))
    fold = (C.pool_plan(spark, d).where("split = 'inner' AND role = 'hp'")
            .select("seed", F.concat(F.lit("fold"), F.col("fold").cast("string")).alias("set_id"), "hh", "station", "cap"))
    own = m.where("split = 'train'").join(hh, "hh").select("seed", F.col("sub_id").alias("set_id"), "hh", F.col("home").alias("station"), "cap")
    return crossfit(spark, d, fold.unionByName(own))


def crossfit(spark, d, excluded):
    """Cross-fitted pilots of the sets in `excluded`. The sets are written first: few sets have a known size then, and are broadcast to the readings."""
    excluded = cut_lineage(excluded)
    days = summed(C.train_days_plan(spark, d).where("role = 'hp'"), ["seed"])
    return E.crossfit_pilots(train_hp(spark, d), excluded, C.readings_plan(spark, d), C.temperature_plan(spark, d), days)


def xf_arms():
    # the brute-force form: every kept household set summed on its own
    p = pilot_sql('xf', 'xkeep', 'seed, set_id')
    return p.replace("wt/cap AS T FROM", "round(wt/cap,9) AS T FROM")


@query("r11_crossfitted_pilots", f"""WITH {C.DAILY_SQL}, {X.SQL_ST}, thp AS (SELECT seed, hh, station, cap FROM sp WHERE split='train' AND role='hp'),
xset AS (SELECT seed, 'fold'||fold AS set_id, hh, station, cap FROM fo WHERE role='hp' UNION ALL SELECT me.seed, sub_id, me.hh, h.station, h.cap FROM me JOIN hh h ON me.hh=h.hh WHERE me.role='hp' AND me.split='train'),
xids AS (SELECT DISTINCT seed, set_id FROM xset), xkeep AS (SELECT x.seed, x.set_id, t.hh, t.station, t.cap FROM xids x JOIN thp t ON t.seed=x.seed
 WHERE NOT EXISTS (SELECT 1 FROM xset e WHERE e.seed=x.seed AND e.set_id=x.set_id AND e.hh=t.hh)), {xf_arms()}
SELECT seed, set_id, round(m,6) AS m, round(T_h,4) AS T_h FROM xf""")
def r11(spark, d):
    return crossfit_plan(spark, d).select("seed", "set_id", F.round("m", 6).alias("m"), F.round("T_h", 4).alias("T_h"))


def with_crossfit(spark, d, e):
    """Estimates of train substations from pilots without the substation's own households; all others keep theirs."""
    own = (C.member_plan(spark, d).where("role = 'hp' AND split = 'train'").join(C.hh_table(spark, d).select("hh", "cap", F.col("station").alias("home")), "hh")
           .select("seed", F.col("sub_id").alias("set_id"), "hh", F.col("home").alias("station"), "cap"))
    xf = crossfit(spark, d, own).select("seed", F.col("set_id").alias("sub_id"), F.col("m").alias("_m"))
    e = e.join(xf, ["seed", "sub_id"], "left").withColumn("_m", F.when(F.col("split") == "train", F.col("_m")).otherwise(F.col("m_full")))
    s = F.col("s_h_net")
    for name, (p, v) in {"ratio": E.ratio_estimate(s, F.col("_m")), "corrected": E.corrected_estimate(s, F.col("size"), F.col("s0"), F.col("_m"))}.items():
        e = e.withColumn(name, p).withColumn(f"{name}_valid", v)
    return e.drop("_m")


XF_SQL = f"""{EST_SQL}, xset AS (SELECT me.seed, sub_id AS set_id, me.hh, h.station, h.cap FROM me JOIN hh h ON me.hh=h.hh WHERE me.role='hp' AND me.split='train'),
xids AS (SELECT DISTINCT seed, set_id FROM xset), xkeep AS (SELECT x.seed, x.set_id, t.hh, t.station, t.cap FROM xids x JOIN thp t ON t.seed=x.seed
 WHERE NOT EXISTS (SELECT 1 FROM xset e WHERE e.seed=x.seed AND e.set_id=x.set_id AND e.hh=t.hh)), {xf_arms()},
em AS (SELECT es.* EXCLUDE (ratio, ratio_valid, corrected, corrected_valid), CASE WHEN split='train' THEN xf.m ELSE m_full END AS mm FROM es LEFT JOIN xf ON xf.seed=es.seed AND xf.set_id=es.sub_id),
ec AS (SELECT *, {_est('ratio', 's_h_net', 'mm')}, {_est('corrected', '(s_h_net-size*s0)', 'mm')} FROM em)"""


@query("r12_log_bias_calibration", f"""WITH {XF_SQL}, lb AS (SELECT seed, avg(ln(HP_Peak/ratio)) AS b, avg(ln(HP_Peak/corrected)) FILTER (corrected_valid) AS bc FROM ec WHERE split='train' AND ratio_valid AND HP_Peak>0 GROUP BY 1)
SELECT sub_id, round(ratio*exp(b),5) AS ratio_cal, round(corrected*exp(bc),5) AS corrected_cal FROM ec JOIN lb USING (seed) WHERE split='test'""")
def r12(spark, d):
    """The bias is the mean log ratio of cross-fitted train estimates."""
    e = cut_lineage(with_crossfit(spark, d, estimate_plan(spark, d)))
    tr = e.where("split = 'train' AND ratio_valid")
    b = E.log_bias(tr, ["seed"], "HP_Peak", "ratio", "ratio_valid").withColumnRenamed("bias", "b")
    bc = E.log_bias(tr, ["seed"], "HP_Peak", "corrected", "corrected_valid").withColumnRenamed("bias", "bc")
    return e.where("split = 'test'").join(b, "seed").join(bc, "seed").select(
        "sub_id", F.round(F.col("ratio") * F.exp("b"), 5).alias("ratio_cal"), F.round(F.col("corrected") * F.exp("bc"), 5).alias("corrected_cal"))


@query("r13_net_features", f"""WITH {X.SQL_ND}, {Q.hinge('f', 'nd', 'station')}, h AS (SELECT station, regr_slope(y, greatest(0.0::DOUBLE,12-t)*24) AS s FROM nd GROUP BY 1)
SELECT f.station, round(s_h,6) AS s_h_net, round(P_base,6) AS P_base_net, round(T_h,6) AS T_h_net, round(r2,6) AS r2_net, T_min AS T_min_net, round(s_h*greatest(0.0::DOUBLE,T_h-T_min),6) AS delta_net, hinge_inside, at_bound, round(s,8) AS hdh_slope_net FROM f JOIN h ON f.station=h.station""")
def r13(spark, d):
    n = E.net_features(X.nation_daily(spark, d), "station", "t", "y")
    return n.select("station", *[F.round(c, 6).alias(c) for c in ("s_h_net", "P_base_net", "T_h_net", "r2_net")], "T_min_net", F.round("delta_net", 6).alias("delta_net"),
                    "hinge_inside", "at_bound", r8("hdh_slope_net").alias("hdh_slope_net"))


def _netfit_sql():
    out = []
    for f in E.FITS:
        for c in E.PER_FIT:
            v = f"max(CASE WHEN fit='{f}' THEN {c} END)"
            out.append((f"nf_{f}_{c}", v))
    cols = ", ".join(f"round({v},5) AS {n}" for n, v in out)
    return f"""WITH {X.SQL_ND}, {easter_table('nd')}, d AS (SELECT station, nd.day, t, y, (hol OR wend OR strftime(nd.day,'%m-%d')='01-02') AS we FROM nd JOIN hol ON nd.day=hol.day),
sb AS (SELECT *, 'all' AS fit FROM d UNION ALL SELECT *, CASE WHEN we THEN 'we' ELSE 'wd' END FROM d), {Q.hinge('f', 'sb', 'station, fit')},
rf AS (SELECT station, T_h AS t_ref, P_base AS pb FROM f WHERE fit='all'), q AS (SELECT station, quantile_cont(t,0.05) AS q05 FROM d GROUP BY 1),
j AS (SELECT sb.station, sb.fit, t, y, P_base, s_h, T_h, at_bound, t_ref, q05 FROM sb JOIN f ON f.station=sb.station AND f.fit=sb.fit JOIN rf ON rf.station=sb.station JOIN q ON q.station=sb.station),
o AS (SELECT station, fit, any_value(P_base) AS pb_, any_value(s_h) AS s_, any_value(T_h) AS th_, any_value(at_bound) AS ab_, any_value(q05) AS q_, count(*) FILTER (t<t_ref) AS nh,
 count(*) FILTER (t<T_h) AS na, var_pop(y) FILTER (t<T_h) AS va, avg((y-(P_base+s_h*(T_h-t)))*(y-(P_base+s_h*(T_h-t)))) FILTER (t<T_h) AS ra FROM j GROUP BY 1,2),
ok AS (SELECT station, fit, nh::DOUBLE AS n_heat_days, CASE WHEN u THEN s_ END AS s_h, CASE WHEN u THEN th_ END AS T_h, CASE WHEN u THEN pb_ END AS P_base, CASE WHEN u AND na>=10 AND va>0 THEN 1-ra/va END AS R2_h,
 CASE WHEN u THEN CASE WHEN ab_ THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END AS at_bound, CASE WHEN u THEN s_*(th_-q_) END AS cold_resp, CASE WHEN u AND pb_>0 THEN s_/pb_ END AS r_hat FROM (SELECT *, (fit='all' OR nh>=20) AS u FROM o)),
w AS (SELECT station, {cols}, round(max(CASE WHEN fit='we' THEN s_h END)/max(CASE WHEN fit='wd' AND s_h>0 THEN s_h END),5) AS nf_ratio_sh_we_wd,
 round(max(CASE WHEN fit='we' THEN P_base END)/max(CASE WHEN fit='wd' AND P_base>0 THEN P_base END),5) AS nf_ratio_Pbase_we_wd FROM ok GROUP BY 1),
th AS (SELECT d.station, y, pb, CASE WHEN t_ref>q05 THEN (t_ref-t)/(t_ref-q05) END AS z FROM d JOIN rf USING (station) JOIN q USING (station)),
tz AS (SELECT station, round(avg(y) FILTER (z<=0)/max(CASE WHEN pb>0 THEN pb END),5) AS nf_theta_warm, round(avg(y) FILTER (z>0 AND z<=0.5)/max(CASE WHEN pb>0 THEN pb END),5) AS nf_theta_mild, round(avg(y) FILTER (z>0.5)/max(CASE WHEN pb>0 THEN pb END),5) AS nf_theta_cold FROM th GROUP BY 1)
SELECT w.*, nf_theta_warm, nf_theta_mild, nf_theta_cold FROM w JOIN tz USING (station)"""


@query("r14_netfit", _netfit_sql())
def r14(spark, d):
    n = E.netfit(X.nation_daily(spark, d), "station", "t", "y", "day")
    return n.select("station", *[F.round(c, 5).alias(c) for c in n.columns[1:]])


# ------------------------------------------------------------------ baseline maps
@query("r15_baseline_maps", f"""WITH {C.TARGET_SQL}, tr AS (SELECT * FROM tb WHERE split='train'),
c AS (SELECT seed, regr_slope(HP_Peak,s_h_net) AS s1, regr_intercept(HP_Peak,s_h_net) AS i1, sum(HP_Peak*delta_net)/sum(delta_net*delta_net) AS o1, regr_slope(HP_Peak,hdh_slope_net) AS h1, regr_intercept(HP_Peak,hdh_slope_net) AS h0,
 (covar_pop(s_h_net,HP_Peak)*var_pop(P_base_net)-covar_pop(P_base_net,HP_Peak)*covar_pop(s_h_net,P_base_net))/(var_pop(s_h_net)*var_pop(P_base_net)-covar_pop(s_h_net,P_base_net)*covar_pop(s_h_net,P_base_net)) AS b1,
 (covar_pop(P_base_net,HP_Peak)*var_pop(s_h_net)-covar_pop(s_h_net,HP_Peak)*covar_pop(s_h_net,P_base_net))/(var_pop(s_h_net)*var_pop(P_base_net)-covar_pop(s_h_net,P_base_net)*covar_pop(s_h_net,P_base_net)) AS b2,
 avg(HP_Peak) AS ym, avg(s_h_net) AS m1, avg(P_base_net) AS m2 FROM tr GROUP BY 1)
SELECT sub_id, round(greatest(0.0::DOUBLE,i1+s1*s_h_net),6) AS slope_only, round(greatest(0.0::DOUBLE,ym-b1*m1-b2*m2+b1*s_h_net+b2*P_base_net),6) AS slope_base, round(greatest(0.0::DOUBLE,o1*delta_net),6) AS calibrated_delta,
 round(greatest(0.0::DOUBLE,h0+h1*hdh_slope_net),6) AS hdh FROM tb JOIN c USING (seed) WHERE split='test'""")
def r15(spark, d):
    return baseline_maps(cut_lineage(C.target_plan(spark, d))).where("split = 'test'").select("sub_id", *[F.round(c, 6).alias(c) for c in MAPS])


MAPS = {"slope_only": (["s_h_net"], "ols"), "slope_base": (["s_h_net", "P_base_net"], "ols"), "calibrated_delta": (["delta_net"], "origin"), "hdh": (["hdh_slope_net"], "ols")}


def baseline_maps(tab):
    out = tab
    for name, (fs, kind) in MAPS.items():
        out = L.apply_linear(out, L.fit_linear(tab.where("split = 'train'"), ["seed"], fs, "HP_Peak", kind), ["seed"], fs, name, clip=True)
    return out


# ------------------------------------------------------------------ slope-to-capacity variants
def variant_entities(spark, d):
    """Nation-years: daily pairs by two reductions, hinge of each, and the active heating capacity as the target."""
    r = X.daily_readings(spark, d).withColumn("e", F.concat_ws("_", "nation", F.year("day"))).withColumn("y", F.col("own") + F.col("hp"))
    mm = A.daily_means(r, ["e"], "day", "t", "y", 15.0).select("e", F.lit("mean/mean").alias("red"), "t", "y")
    mx = A.daily_min_max(r, ["e"], "day", "t", "y", 15.0).select("e", F.lit("min/max").alias("red"), F.col("t_min").alias("t"), F.col("y_max").alias("y"))
    f = HG.fit_hinge(mm.unionByName(mx), ["e", "red"], "t", "y")
    target = r.where("role = 'hp'").select("e", "hh", "cap").distinct().groupBy("e").agg(F.sum("cap").alias("target"))
    f = f.join(target, "e").withColumn("delta", F.col("s_h") * F.greatest(F.lit(0.0), F.col("T_h") - F.col("T_min")))
    return f.withColumn("train", F.split("e", "_")[1].cast("int") % 2 == 1)


VARIANTS = {"slope": (["s_h"], "ols"), "slope_base": (["s_h", "P_base"], "ols"), "slope_base_tbal": (["s_h", "P_base", "T_h"], "ols"), "delta": (["delta"], "ols"), "delta_origin": (["delta"], "origin")}


def _r16_sql():
    base = f"""{X.SQL_READ}, e0 AS (SELECT nation||'_'||year(day) AS e, day, t, own+hp AS y, role, hh, cap FROM rd),
vs AS (SELECT e, 'mean/mean' AS red, avg(t) AS t, avg(y) AS y FROM e0 GROUP BY e, day HAVING avg(t)<15 UNION ALL SELECT e, 'min/max', min(t), max(y) FROM e0 GROUP BY e, day HAVING min(t)<15), {Q.hinge('vf', 'vs', 'e, red')},
tg AS (SELECT e, sum(cap) AS target FROM (SELECT DISTINCT e, hh, cap FROM e0 WHERE role='hp') GROUP BY 1),
v AS (SELECT vf.*, target, s_h*greatest(0.0::DOUBLE,T_h-T_min) AS delta, CAST(split_part(vf.e,'_',2) AS INTEGER)%2=1 AS train FROM vf JOIN tg ON vf.e=tg.e),
c AS (SELECT red, regr_slope(target,s_h) AS s1, regr_intercept(target,s_h) AS i1, regr_slope(target,delta) AS d1, regr_intercept(target,delta) AS d0, sum(target*delta)/sum(delta*delta) AS o1,
 (covar_pop(s_h,target)*var_pop(P_base)-covar_pop(P_base,target)*covar_pop(s_h,P_base))/(var_pop(s_h)*var_pop(P_base)-covar_pop(s_h,P_base)*covar_pop(s_h,P_base)) AS b1,
 (covar_pop(P_base,target)*var_pop(s_h)-covar_pop(s_h,target)*covar_pop(s_h,P_base))/(var_pop(s_h)*var_pop(P_base)-covar_pop(s_h,P_base)*covar_pop(s_h,P_base)) AS b2, avg(target) AS ym, avg(s_h) AS m1, avg(P_base) AS m2 FROM v WHERE train GROUP BY 1),
p AS (SELECT v.red, target AS y, i1+s1*s_h AS p, 'slope' AS variant FROM v JOIN c USING (red) WHERE NOT train UNION ALL SELECT v.red, target, ym-b1*m1-b2*m2+b1*s_h+b2*P_base, 'slope_base' FROM v JOIN c USING (red) WHERE NOT train
 UNION ALL SELECT v.red, target, d0+d1*delta, 'delta' FROM v JOIN c USING (red) WHERE NOT train UNION ALL SELECT v.red, target, o1*delta, 'delta_origin' FROM v JOIN c USING (red) WHERE NOT train)"""
    m = Q.metrics()
    return f"WITH {base} SELECT red, variant, CAST(count(*) AS BIGINT) AS n, {', '.join(f'round({m[k]},5) AS {k}' for k in ('r2', 'mape', 'rmse'))} FROM p GROUP BY 1,2"


@query("r16_capacity_map_variants", _r16_sql())
def r16(spark, d):
    v = cut_lineage(variant_entities(spark, d))
    out = None
    for name, (fs, kind) in VARIANTS.items():
        if name == "slope_base_tbal":
            continue
        p = L.apply_linear(v.where("NOT train"), L.fit_linear(v.where("train"), ["red"], fs, "target", kind), ["red"], fs).select("red", F.lit(name).alias("variant"), F.col("target").alias("y"), F.col("pred").alias("p"))
        out = p if out is None else out.unionByName(p)
    s = A.score(out, ["red", "variant"])
    return s.select("red", "variant", "n", *[F.round(c, 5).alias(c) for c in ("r2", "mape", "rmse")])


@query("r16_three_feature_map")
def r16_three(spark, d):
    v = cut_lineage(variant_entities(spark, d))
    fs, kind = VARIANTS["slope_base_tbal"]
    p = L.apply_linear(v.where("NOT train"), L.fit_linear(v.where("train"), ["red"], fs, "target", kind), ["red"], fs)
    s = A.score(p, ["red"], "target", "pred")
    return s.select("red", "n", *[F.round(c, 4).alias(c) for c in ("r2", "mape", "rmse")])


@query("r17_prediction_interval", f"""WITH {C.TARGET_SQL}, c AS (SELECT seed, count(*) AS n, regr_slope(HP_Peak,s_h_net) AS b1, regr_intercept(HP_Peak,s_h_net) AS b0, avg(s_h_net) AS xm, regr_sxx(HP_Peak,s_h_net) AS sxx,
 (regr_syy(HP_Peak,s_h_net)-regr_slope(HP_Peak,s_h_net)*regr_sxy(HP_Peak,s_h_net))/(count(*)-2) AS s2 FROM tb WHERE split='train' GROUP BY 1),
p AS (SELECT tb.seed, HP_Peak AS y, b0+b1*s_h_net AS p, 1.99::DOUBLE*sqrt(s2*(1+1/n+(s_h_net-xm)*(s_h_net-xm)/sxx)) AS h FROM tb JOIN c USING (seed) WHERE split='test')
SELECT seed, CAST(count(*) AS BIGINT) AS n, round(avg(CASE WHEN y BETWEEN p-h AND p+h THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END),8) AS coverage, round(avg(2*h),6) AS width FROM p GROUP BY 1""")
def r17(spark, d):
    t = cut_lineage(C.target_plan(spark, d))
    p = L.with_interval(t.where("split = 'test'"), L.ols_interval(t.where("split = 'train'"), ["seed"], "s_h_net", "HP_Peak"), ["seed"], "s_h_net", 1.99)
    inside = F.col("HP_Peak").between(F.col("lo"), F.col("hi")).cast("double")
    return p.groupBy("seed").agg(F.count("*").alias("n"), r8(F.avg(inside)).alias("coverage"), F.round(F.avg(F.col("hi") - F.col("lo")), 6).alias("width"))


@query("r18_residual_model", f"""WITH {XF_SQL}, z AS (SELECT *, CASE WHEN ratio_valid AND HP_Peak>0 THEN ln(HP_Peak)-ln(ratio) END AS z, ln(size) AS ls FROM ec), c AS (SELECT seed, regr_slope(z,ls) AS s, regr_intercept(z,ls) AS i, CAST(count(*)-count(z) AS BIGINT) AS n_excluded FROM z WHERE split='train' GROUP BY 1)
SELECT sub_id, round(z,6) AS z, round(CASE WHEN ratio_valid THEN ratio*exp(i+s*ls) ELSE 0.0::DOUBLE END,5) AS pred, n_excluded FROM z JOIN c USING (seed)""")
def r18(spark, d):
    e = cut_lineage(with_crossfit(spark, d, estimate_plan(spark, d)))
    z = e.withColumn("z", E.log_ratio(F.col("HP_Peak"), F.col("ratio"), F.col("ratio_valid"))).withColumn("ls", F.log("size"))
    tr = z.where("split = 'train'")
    ex = tr.groupBy("seed").agg((F.count("*") - F.count("z")).alias("n_excluded"))
    p = L.apply_linear(z, L.fit_linear(tr, ["seed"], ["ls"], "z"), ["seed"], ["ls"], "z_hat").join(ex, "seed")
    return p.select("sub_id", F.round("z", 6).alias("z"), F.round(E.compose(F.col("ratio"), F.col("z_hat"), F.col("ratio_valid")), 5).alias("pred"), "n_excluded")


@query("r19_oracles", f"""WITH {EST_SQL}, oset AS (SELECT me.sub_id, me.hh, h.station, h.cap FROM me JOIN hh h ON me.hh=h.hh WHERE me.role='hp'), {pilot_sql('op', 'oset', 'sub_id')}
SELECT es.sub_id, round(CASE WHEN s_h>0 AND m_full>0 THEN s_h/m_full ELSE 0.0::DOUBLE END,5) AS oracle_1, round(CASE WHEN s_h>0 AND op.m>0 THEN s_h/op.m ELSE 0.0::DOUBLE END,4) AS oracle_2 FROM es JOIN op ON es.sub_id=op.sub_id""")
def r19(spark, d):
    e = estimate_plan(spark, d)
    hh = C.hh_table(spark, d).select("hh", "cap", F.col("station").alias("home"))
    own = C.member_plan(spark, d).where("role = 'hp'").join(hh, "hh").select("sub_id", "hh", F.col("home").alias("station"), "cap")
    m = E.pilots(own, ["sub_id"], C.readings_plan(spark, d), C.temperature_plan(spark, d)).select("sub_id", F.col("m").alias("m_true"))
    j = e.join(m, "sub_id")
    return j.select("sub_id", F.round(E.ratio_estimate(F.col("s_h"), F.col("m_full"))[0], 5).alias("oracle_1"), F.round(E.ratio_estimate(F.col("s_h"), F.col("m_true"))[0], 4).alias("oracle_2"))


@query("r20_response_scaling", f"""WITH {X.SQL_ND}, {Q.hinge('f', 'nd', 'station')} SELECT nd.station, day, round(CASE WHEN t<T_h THEN greatest(P_base+0.5::DOUBLE*(y-P_base),1e-3)/greatest(y,1e-3) ELSE 1.0::DOUBLE END,6) AS factor,
 round(y*CASE WHEN t<T_h THEN greatest(P_base+0.5::DOUBLE*(y-P_base),1e-3)/greatest(y,1e-3) ELSE 1.0::DOUBLE END,6) AS y_scaled FROM nd JOIN f ON nd.station=f.station""")
def r20(spark, d):
    s = E.scale_response(X.nation_daily(spark, d), ["station"], "t", "y", 0.5)
    return s.select("station", "day", F.round("factor", 6).alias("factor"), F.round("y_scaled", 6).alias("y_scaled"))


def scale_rows(spark, d):
    """Covariates of the transferable scale and log of the true scale of every substation."""
    e = cut_lineage(estimate_plan(spark, d))
    clim = A.climate(C.temperature_plan(spark, d), "station", "t").select("station", "T_mean", "T_q05")
    s_hat = F.greatest(F.lit(0.0), F.col("s_h_net") - F.col("size") * F.col("s0"))
    return (e.join(clim, "station").withColumn("s_hat", s_hat).withColumn("T_design", F.lit(-8.0)).withColumn("T_h", F.col("T_h_net"))
            .withColumn("r_hat", F.col("s_hat") / F.when(F.col("P_base_net") > 0, F.col("P_base_net")))
            .withColumn("log_m", F.when(F.col("s_h") > 0, F.log(F.col("s_h") / F.col("HP_Peak")))))


@query("r21_design_scale", f"""WITH {EST_SQL} SELECT sub_id, round(m_full*(T_full+8.0::DOUBLE),6) AS kappa, round(m_full*(T_full+8.0::DOUBLE)/nullif(T_h_net+8.0::DOUBLE,0),6) AS m_hat,
 round(CASE WHEN s_h_net-size*s0>0 AND m_full*(T_full+8.0::DOUBLE)/nullif(T_h_net+8.0::DOUBLE,0)>0 THEN (s_h_net-size*s0)/(m_full*(T_full+8.0::DOUBLE)/(T_h_net+8.0::DOUBLE)) ELSE 0.0::DOUBLE END,5) AS estimate FROM es""")
def r21(spark, d):
    e = estimate_plan(spark, d)
    kappa = E.design_scale(F.col("m_full"), F.col("T_full"), -8.0)
    m = kappa / F.nullif(F.col("T_h_net") + 8.0, F.lit(0.0))
    return e.select("sub_id", F.round(kappa, 6).alias("kappa"), F.round(m, 6).alias("m_hat"), F.round(E.corrected_estimate(F.col("s_h_net"), F.col("size"), F.col("s0"), m)[0], 5).alias("estimate"))


@query("r21_ridge_scale")
def r21_ridge(spark, d):
    rows = cut_lineage(scale_rows(spark, d))
    g = cut_lineage(E.scale_ridge(rows))
    j = rows.join(g.where("kind = 'full'").select("seed", F.col("coef").alias("c_full"), "alpha"), "seed")
    fo = g.where("kind = 'fold'").select("seed", F.lit("inner").alias("split"), F.col("part").alias("fold"), F.col("coef").alias("c_fold"))
    st = g.where("kind = 'station'").select("seed", F.lit("train").alias("split"), F.col("part").alias("station"), F.col("coef").alias("c_station"))
    j = j.join(fo, ["seed", "split", "fold"], "left").join(st, ["seed", "split", "station"], "left")
    c = F.coalesce("c_fold", "c_station", "c_full")
    x = c[0]
    for i, v in enumerate(E.COVARS):
        x = x + c[i + 1] * F.col(v)
    m = F.exp(x)
    fb = (F.col("split") != "test") & F.coalesce("c_fold", "c_station").isNull()
    return j.select("sub_id", "seed", "split", "alpha", fb.alias("fallback"), F.round(m, 5).alias("m_hat"), F.round(E.ratio_estimate(F.col("s_hat"), m)[0], 4).alias("estimate"))


# ------------------------------------------------------------------ learning curve
NS = (8, 16, 32, 64, 128)
LC_SQL = f"""o AS (SELECT c_nationkey AS station, o_orderkey AS k, o_totalprice/1000 AS v FROM orders JOIN customer ON o_custkey=c_custkey), a AS (SELECT station, avg(v) AS ref FROM o GROUP BY 1),
r AS (SELECT o.*, dr, row_number() OVER (PARTITION BY station, dr ORDER BY {Q.md("'lc'", 'dr', 'k')}) AS pos FROM o, (VALUES (0),(1),(2)) x(dr)),
s AS (SELECT station, dr, n, avg(v) AS v FROM r, (VALUES (8),(16),(32),(64),(128)) y(n) WHERE pos<=n GROUP BY 1,2,3), w AS (SELECT s.station, n, median(abs(s.v-ref)/ref*100) AS w FROM s JOIN a USING (station) GROUP BY 1,2)"""


def curve_points(spark, d):
    """Error of a mean over n drawn readings against the full mean: median over three draws per station and n."""
    from ..functions.hashing import hash_rank
    o, c = X.table(spark, d, "orders"), X.table(spark, d, "customer")
    v = o.join(c, o.o_custkey == c.c_custkey).select(F.col("c_nationkey").alias("station"), F.col("o_orderkey").alias("k"), (F.col("o_totalprice") / 1000).alias("v"))
    ref = v.groupBy("station").agg(F.avg("v").alias("ref"))
    r = hash_rank(v.withColumn("dr", F.explode(K.ints(range(3)))), ["station", "dr"], digest(F.lit("lc"), F.col("dr"), F.col("k")))
    s = (r.where(F.col("pos") < max(NS)).withColumn("n", F.explode(F.filter(K.ints(NS), lambda n: F.col("pos") < n))).groupBy("station", "dr", "n").agg(F.avg("v").alias("v")))
    return s.join(ref, "station").groupBy("station", "n").agg(F.percentile(F.abs(F.col("v") - F.col("ref")) / F.col("ref") * 100, 0.5).alias("w"))


@query("r22_learning_curve_points", f"WITH {LC_SQL} SELECT station, n, round(w,8) AS w FROM w")
def r22_points(spark, d):
    return curve_points(spark, d).select("station", "n", r8("w").alias("w"))


@query("r22_power_law", f"""WITH {LC_SQL}, g1 AS (SELECT station, c, n, w, power(n::DOUBLE,-c) AS x FROM w, (SELECT 0.001::DOUBLE + i*(2.0::DOUBLE-0.001::DOUBLE)/40 AS c FROM range(41) r(i))),
f1 AS (SELECT station, c, round(regr_syy(w,x)-regr_slope(w,x)*regr_sxy(w,x),12) AS sse FROM g1 GROUP BY 1,2), b1 AS (SELECT station, arg_min(c, (sse,c)) AS c0 FROM f1 GROUP BY 1),
g2 AS (SELECT DISTINCT w.station, n, w, least(2.0::DOUBLE,greatest(0.001::DOUBLE,c0+i*((2.0::DOUBLE-0.001::DOUBLE)/40/20))) AS c FROM w JOIN b1 USING (station), range(-20,21) r(i)), g3 AS (SELECT *, power(n::DOUBLE,-c) AS x FROM g2),
f2 AS (SELECT station, c, regr_slope(w,x) AS b, regr_intercept(w,x) AS a, round(regr_syy(w,x)-regr_slope(w,x)*regr_sxy(w,x),12) AS sse FROM g3 GROUP BY 1,2), b2 AS (SELECT *, row_number() OVER (PARTITION BY station ORDER BY sse, c) AS rn FROM f2)
SELECT station, round(a,4) AS a, round(b,4) AS b, round(c,5) AS c, (c<=0.00101 OR c>=1.998) AS flag_c_bound, a<0 AS flag_a_neg, round(CASE WHEN a>=5 THEN NULL WHEN b<=0 THEN 0.0::DOUBLE ELSE power(b/(5-a),1/c) END,3) AS n_star FROM b2 WHERE rn=1""")
def r22(spark, d):
    f = E.fit_power_law(curve_points(spark, d), ["station"], "n", "w")
    ns = E.n_star(F.col("a"), F.col("b"), F.col("c"), F.lit(5.0))
    return f.select("station", F.round("a", 4).alias("a"), F.round("b", 4).alias("b"), F.round("c", 5).alias("c"), "flag_c_bound", "flag_a_neg", F.when(ns != float("inf"), F.round(ns, 3)).alias("n_star"))


# ------------------------------------------------------------------ ensembles and gates
FAMS = ["slope_only", "slope_base", "hdh"]


def family_predictions(spark, d):
    """Each family's prediction: inner rows by a map fitted on the inner rows of the other folds, which hold none of their households; test rows by the map of the train substations."""
    tab = cut_lineage(C.target_plan(spark, d))
    inner, test = tab.where("split = 'inner'"), baseline_maps(tab).where("split = 'test'")
    for f in FAMS:
        inner = M.out_of_fold(inner, ["seed"], "fold", MAPS[f][0], "HP_Peak", "linear").withColumn(f, F.greatest(F.lit(0.0), F.col("oof"))).drop("oof")
    r = F.col("s_h_net") / F.when(F.col("P_base_net") > 0, F.col("P_base_net"))
    return inner.unionByName(test, allowMissingColumns=True).select("sub_id", "seed", "split", "fold", "size", "n_hp", F.col("HP_Peak").alias("y"), r.alias("r"), *FAMS)


def map_sql(name, src, keys):
    """Coefficients of the families' maps by `keys`, from moments."""
    det = "(var_pop(s_h_net)*var_pop(P_base_net)-covar_pop(s_h_net,P_base_net)*covar_pop(s_h_net,P_base_net))"
    return f"""{name} AS (SELECT {keys}, regr_slope(HP_Peak,s_h_net) AS s1, regr_intercept(HP_Peak,s_h_net) AS i1, regr_slope(HP_Peak,hdh_slope_net) AS h1, regr_intercept(HP_Peak,hdh_slope_net) AS h0,
 (covar_pop(s_h_net,HP_Peak)*var_pop(P_base_net)-covar_pop(P_base_net,HP_Peak)*covar_pop(s_h_net,P_base_net))/{det} AS b1, (covar_pop(P_base_net,HP_Peak)*var_pop(s_h_net)-covar_pop(s_h_net,HP_Peak)*covar_pop(s_h_net,P_base_net))/{det} AS b2,
 avg(HP_Peak) AS ym, avg(s_h_net) AS m1, avg(P_base_net) AS m2 FROM {src} GROUP BY ALL)"""


FAM_COLS = """CASE WHEN P_base_net>0 THEN s_h_net/P_base_net END AS r, greatest(0.0::DOUBLE,i1+s1*s_h_net) AS f1, greatest(0.0::DOUBLE,ym-b1*m1-b2*m2+b1*s_h_net+b2*P_base_net) AS f2, greatest(0.0::DOUBLE,h0+h1*hdh_slope_net) AS f3"""
FAM_SQL = f"""{C.TARGET_SQL}, {map_sql('mc', "tb WHERE split='train'", 'seed')}, it AS (SELECT * FROM tb WHERE split='inner'), fo_ AS (SELECT DISTINCT seed, fold AS out FROM it),
{map_sql('mo', 'it JOIN fo_ USING (seed) WHERE fold<>out', 'seed, out')}, fi AS (SELECT sub_id, it.seed, fold, HP_Peak AS y, {FAM_COLS} FROM it JOIN mo ON mo.seed=it.seed AND mo.out=it.fold),
ft_ AS (SELECT sub_id, tb.seed, {FAM_COLS} FROM tb JOIN mc USING (seed) WHERE split='test')"""


def nnls3_sql(name, src, keys):
    """Non-negative least squares of y on f1, f2, f3 by `keys`: the best of all sets of families that get a weight."""
    g = f"""{name}_g AS (SELECT {keys}, count(*) AS n, sum(f1*f1) AS a11, sum(f1*f2) AS a12, sum(f1*f3) AS a13, sum(f2*f2) AS a22, sum(f2*f3) AS a23, sum(f3*f3) AS a33, sum(f1*y) AS c1, sum(f2*y) AS c2, sum(f3*y) AS c3 FROM {src} GROUP BY ALL)"""
    A = lambda i, j: f"a{min(i, j)}{max(i, j)}"
    opts = ["0.0::DOUBLE AS w1, 0.0::DOUBLE AS w2, 0.0::DOUBLE AS w3"]
    for i in (1, 2, 3):
        opts.append(", ".join((f"c{i}/nullif({A(i, i)},0)" if k == i else "0.0::DOUBLE") + f" AS w{k}" for k in (1, 2, 3)))
        j, k = [x for x in (1, 2, 3) if x != i]
        det = f"nullif({A(j, j)}*{A(k, k)}-{A(j, k)}*{A(j, k)},0)"
        w = {i: "0.0::DOUBLE", j: f"(c{j}*{A(k, k)}-c{k}*{A(j, k)})/{det}", k: f"(c{k}*{A(j, j)}-c{j}*{A(j, k)})/{det}"}
        opts.append(", ".join(f"{w[x]} AS w{x}" for x in (1, 2, 3)))
    det3 = lambda m: f"({m[0][0]}*({m[1][1]}*{m[2][2]}-{m[1][2]}*{m[2][1]})-{m[0][1]}*({m[1][0]}*{m[2][2]}-{m[1][2]}*{m[2][0]})+{m[0][2]}*({m[1][0]}*{m[2][1]}-{m[1][1]}*{m[2][0]}))"
    full = [[A(i, j) for j in (1, 2, 3)] for i in (1, 2, 3)]
    opts.append(", ".join(f"{det3([[f'c{i}' if j == k else A(i, j) for j in (1, 2, 3)] for i in (1, 2, 3)])}/nullif({det3(full)},0) AS w{k}" for k in (1, 2, 3)))
    return f"""{g}, {name}_o AS ({" UNION ALL ".join(f"SELECT *, {o} FROM {name}_g" for o in opts)}),
{name} AS (SELECT * FROM {name}_o WHERE w1>=0 AND w2>=0 AND w3>=0 QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY w1*c1+w2*c2+w3*c3 DESC)=1)"""


def gate_sql(min_bin=5, tol=0.01):
    """Edges and weights of the gate by brute force over all subsets of the quantiles."""
    from itertools import combinations
    n = len(E.QUANTILES)
    subsets = [x for k in range(n + 1) for x in combinations(range(n), k)]
    cand = " UNION ALL ".join(f"SELECT seed, {i} AS cand, {len(x)} AS k, [{', '.join(f'q{j}' for j in x)}]::DOUBLE[] AS edges FROM gq" for i, x in enumerate(subsets))
    at = "CASE WHEN r IS NULL THEN -1 ELSE len(list_filter(edges, lambda e: e<=r)) END"
    return f"""gq AS (SELECT seed, {', '.join(f'quantile_cont(r,{q}) AS q{i}' for i, q in enumerate(E.QUANTILES))} FROM fi GROUP BY 1), gc AS ({cand}), gd AS (SELECT fi.*, cand, k, edges, {at} AS bin FROM fi JOIN gc USING (seed)),
gp AS (SELECT gd.*, out FROM gd JOIN fo_ USING (seed) WHERE fold<>out), gu AS (SELECT * FROM gp WHERE bin>=0 UNION ALL SELECT * REPLACE (-1 AS bin) FROM gp), {nnls3_sql('gw', 'gu', 'seed, cand, bin, out')},
gk AS (SELECT seed, cand FROM (SELECT seed, cand, out, min(n) AS least, count(*) AS bins FROM gw WHERE bin>=0 GROUP BY ALL) JOIN gc USING (seed, cand) GROUP BY 1,2 HAVING bool_and(k=0 OR (least>={min_bin} AND bins=k+1))),
ge AS (SELECT d.seed, d.cand, sum(abs(w1*f1+w2*f2+w3*f3-d.y)) AS err, sum(d.y) AS sy FROM gd d JOIN gw w ON w.seed=d.seed AND w.cand=d.cand AND w.bin=d.bin AND w.out=d.fold GROUP BY 1,2),
gb AS (SELECT * FROM ge JOIN gk USING (seed, cand) JOIN gc USING (seed, cand) QUALIFY row_number() OVER (PARTITION BY seed, k ORDER BY err, cand)=1),
gs AS (SELECT seed, edges FROM gb JOIN (SELECT seed, min(err) AS low FROM gb GROUP BY 1) USING (seed) WHERE err<={1 + tol}*low+1e-9*sy QUALIFY row_number() OVER (PARTITION BY seed ORDER BY k)=1),
gf AS (SELECT fi.*, {at} AS bin FROM fi JOIN gs USING (seed)), gv AS (SELECT * FROM gf WHERE bin>=0 UNION ALL SELECT * REPLACE (-1 AS bin) FROM gf), {nnls3_sql('gz', 'gv', 'seed, bin')}"""


@query("r23_out_of_fold", f"WITH {FAM_SQL} SELECT sub_id, fold, round(f1,5) AS slope_only, round(f2,5) AS slope_base, round(f3,5) AS hdh FROM fi")
def r23_oof(spark, d):
    p = family_predictions(spark, d).where("split = 'inner'")
    return p.select("sub_id", "fold", *[F.round(f, 5).alias(f) for f in FAMS])


@query("r23_ensembles", f"""WITH {FAM_SQL}, {gate_sql()}, te AS (SELECT ft_.*, CASE WHEN r IS NULL THEN -1 ELSE len(list_filter(edges, lambda e: e<=r)) END AS bin FROM ft_ JOIN gs USING (seed))
SELECT sub_id, round((f1+f2+f3)/3,6) AS average, round(w1*f1+w2*f2+w3*f3,5) AS gated FROM te LEFT JOIN gz ON gz.seed=te.seed AND gz.bin=te.bin""")
def r23(spark, d):
    p = cut_lineage(family_predictions(spark, d))
    g = cut_lineage(E.fit_gate(p.where("split = 'inner'"), FAMS, min_bin=5))
    t = E.apply_gate(p.where("split = 'test'"), g, FAMS).withColumn("mean_of", E.average(FAMS))
    return t.select("sub_id", F.round("mean_of", 6).alias("average"), F.round("gated", 5).alias("gated"))


@query("r24_penetration_gate", f"""WITH {C.TARGET_SQL}, c AS (SELECT seed, regr_slope(HP_Peak,s_h_net) AS s1, regr_intercept(HP_Peak,s_h_net) AS i1, sum(HP_Peak*delta_net)/sum(delta_net*delta_net) AS o1 FROM tb WHERE split='train' GROUP BY 1),
p AS (SELECT tb.seed, HP_Peak AS y, n_hp/size::DOUBLE AS pen, greatest(0.0::DOUBLE,i1+s1*s_h_net) AS a, greatest(0.0::DOUBLE,o1*delta_net) AS b FROM tb JOIN c USING (seed) WHERE split='inner'),
g AS (SELECT seed, thr, round(sum(abs(CASE WHEN pen<=thr THEN a ELSE b END-y)),9) AS err, avg(CASE WHEN pen<=thr THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS share, sum(y) AS sy FROM p, (VALUES (0.0::DOUBLE),(0.05::DOUBLE),(0.15::DOUBLE),(0.25::DOUBLE),(0.35::DOUBLE)) t(thr) GROUP BY 1,2),
k AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY err, thr) AS rn FROM g) SELECT seed, thr AS threshold, round(share,8) AS share_below, round(100*err/sy,6) AS wape FROM k WHERE rn=1""")
def r24(spark, d):
    t = baseline_maps(cut_lineage(C.target_plan(spark, d))).where("split = 'inner'").withColumn("pen", F.col("n_hp") / F.col("size"))
    g = E.penetration_gate(t, ["seed"], "pen", "slope_only", "calibrated_delta", "HP_Peak", [0.0, 0.05, 0.15, 0.25, 0.35])
    return g.select("seed", "threshold", r8("share_below").alias("share_below"), F.round("wape", 6).alias("wape"))


@query("r25_capacity_equivalents", f"""WITH {EST_SQL}, z AS (SELECT seed, station, size*s0/m_full AS expected, ratio-corrected AS actual FROM es WHERE split='test' AND ratio_valid AND corrected_valid)
SELECT seed, CAST(count(*) AS BIGINT) AS n, round(median(expected),6) AS expected, round(median(actual),6) AS actual, round(avg(actual)/avg(expected),6) AS shift_ratio, round(corr(expected,actual),6) AS corr FROM z GROUP BY 1""")
def r25(spark, d):
    e = estimate_plan(spark, d).where("split = 'test' AND ratio_valid AND corrected_valid")
    z = e.select("seed", (F.col("size") * F.col("s0") / F.col("m_full")).alias("expected"), (F.col("ratio") - F.col("corrected")).alias("actual"))
    return z.groupBy("seed").agg(F.count("*").alias("n"), F.round(F.percentile("expected", 0.5), 6).alias("expected"), F.round(F.percentile("actual", 0.5), 6).alias("actual"),
                                 F.round(F.avg("actual") / F.avg("expected"), 6).alias("shift_ratio"), F.round(corr("expected", "actual"), 6).alias("corr"))
