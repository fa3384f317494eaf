"""Queries over splits, folds, cells, draws and substation aggregates (W01, W02, G rows, J05)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scan import high_quantile
from ..functions.stats import r8
from ..operators import cohorts as K, hinge as HG
from ..session import cut_lineage, shared
from ..sources import tables as X
from . import sqlparts as Q
from .registry import query

SEEDS, FRAC, FOLDS, SIZES, PENS = (0, 1), 0.25, 3, (20, 40), (0.1, 0.3)
PER_CELL = {"train": 2, "test": 2, "inner": 1}
MIN_POOL, OVERLAP = 3, 0.8


# ------------------------------------------------------------------ shared plans
def hh_table(spark, d):
    return X.households(spark, d).select("hh", "role", "station", "cap")


def split_plan(spark, d):
    return K.household_splits(hh_table(spark, d), SEEDS, FRAC)


def pool_plan(spark, d):
    """Pools are read several times by every plan below: one written copy, one row per seed, household and pool."""
    def make():
        s = cut_lineage(split_plan(spark, d))
        return K.pools(s, K.inner_folds(s, FOLDS))
    return shared(spark, "pools", _inputs(d), make)


def _inputs(d):
    return [f"{d}/{t}.parquet" for t in ("customer", "nation")]


def cell_plan(spark, d):
    return K.plan_cells(pool_plan(spark, d), SIZES, PENS, MIN_POOL, OVERLAP)


def member_plan(spark, d):
    def make():
        p = pool_plan(spark, d)
        return K.draw_members(K.substations(K.plan_cells(p, SIZES, PENS, MIN_POOL, OVERLAP), PER_CELL), p)
    return shared(spark, "members", _inputs(d), make)


def readings_plan(spark, d):
    """Daily readings with `train`, the seeds that have the household on their train side: one written copy, so that a plan sums the orders by household and day once."""
    def make():
        return K.with_train_seeds(X.daily_readings(spark, d), pool_plan(spark, d))
    return shared(spark, "readings", [*_inputs(d), f"{d}/orders.parquet"], make)


def train_days_plan(spark, d):
    """Day sums n, hp, own of the train households by seed, role and station: all pilots and dwelling slopes are sums of these rows."""
    return shared(spark, "train_days", [*_inputs(d), f"{d}/orders.parquet"], lambda: K.train_days(readings_plan(spark, d)))


def temperature_plan(spark, d):
    return shared(spark, "temperature", [f"{d}/orders.parquet"], lambda: X.station_temperature(spark, d))


def daily_plan(spark, d, members=None):
    m = member_plan(spark, d) if members is None else members
    a = K.aggregate_daily(m, X.daily_readings(spark, d))
    st = F.split("sub_id", r"\|")[2].cast("int")
    return a.withColumn("t", X.temperature_at(st, F.col("day")))


def slot_plan(spark, d, members):
    """Substation loads by day and slot, written once: fits, peaks and windowed features all read this copy."""
    a = K.aggregate_slots(members, slots_of(spark, d, members), X.SLOTS)
    return cut_lineage(a.withColumn("t", X.temperature_at(F.split("sub_id", r"\|")[2].cast("int"), F.col("day"))))


def slots_of(spark, d, members):
    """Slot readings of the members alone: a day gets its 96 slot loads only where a substation needs them."""
    return X.slot_readings(spark, d, readings_plan(spark, d).join(members.select("hh"), "hh", "left_semi"))


def peak_plan(spark, d, members=None):
    """Robust peak of each HP household (of the members, where given): the 99.9th percentile of its slot loads."""
    r = (X.slot_readings(spark, d) if members is None else slots_of(spark, d, members.where("role = 'hp'"))).where("role = 'hp'")
    return high_quantile(r, ["hh"], "hp_slots", F.trunc("day", "month"), 0.999, "hp_peak")


def target_plan(spark, d):
    m = member_plan(spark, d)
    return K.targets(m, slot_plan(spark, d, m), peak_plan(spark, d, m))


# ------------------------------------------------------------------ the same as SQL
SPLIT_SQL = f"""{X.SQL_HH}, seeds AS (SELECT * FROM (VALUES (0),(1)) v(seed)),
sg AS (SELECT hh, role, station, cap, seed, CASE WHEN role='hp' THEN 'hp'||station ELSE 'fill' END AS grp FROM hh CROSS JOIN seeds),
sr AS (SELECT *, row_number() OVER (PARTITION BY seed, grp ORDER BY {Q.md('seed', "'split'", 'grp', 'hh')}) - 1 AS pos, count(*) OVER (PARTITION BY seed, grp) AS n FROM sg),
sp AS (SELECT hh, role, station, cap, seed, grp, CASE WHEN pos < round_even({FRAC}*n, 0) THEN 'test' ELSE 'train' END AS split FROM sr)"""
FOLD_SQL = f"""{SPLIT_SQL}, fr AS (SELECT *, row_number() OVER (PARTITION BY seed, grp ORDER BY {Q.md('seed', "'fold'", 'hh')}) - 1 AS pos FROM sp WHERE split='train'),
fo AS (SELECT hh, role, station, cap, seed, grp, split, CAST((CASE WHEN role='hp' THEN {Q.hint('seed', "'start'", 'grp')} % {FOLDS} ELSE 0 END + pos) % {FOLDS} AS INTEGER) AS fold FROM fr)"""
CELL_SQL = f"""{FOLD_SQL}, po AS (SELECT hh, role, station, cap, seed, split, -1 AS fold FROM sp UNION ALL SELECT hh, role, station, cap, seed, 'inner', fold FROM fo),
ch AS (SELECT seed, split, fold, station, count(*) AS H FROM po WHERE role='hp' GROUP BY ALL), cf AS (SELECT seed, split, fold, count(*) AS F FROM po WHERE role='fill' GROUP BY ALL),
ce0 AS (SELECT ch.*, F, size, p::DOUBLE AS p, CAST(greatest(1, round_even(p::DOUBLE*size, 0)) AS INTEGER) AS n_hp FROM ch JOIN cf USING (seed, split, fold)
 CROSS JOIN (VALUES (20),(40)) a(size) CROSS JOIN (VALUES (0.1),(0.3)) b(p)),
ce AS (SELECT *, CASE WHEN H<{MIN_POOL} THEN 'station pool < min_station_pool' WHEN n_hp>{OVERLAP}*H THEN 'n_hp > max_overlap * H' WHEN size-n_hp>F THEN 'fill pool too small' END AS reason FROM ce0)"""


def draw_sql(src: str, key: str, n: str, pool: str) -> str:
    """`src` with pos and turn of each of n distinct positions below pool: tries in order, repeats passed over, then a walk from a hashed start."""
    tries = f"3*({n})+32"
    return f"""(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k_ ORDER BY j) AS turn FROM (SELECT * FROM (
  SELECT q.*, {key} AS k_, j, (CASE WHEN j<={tries} THEN {Q.hint(key, "'try'", 'j')} ELSE {Q.hint(key, "'start'")}+j END) % ({pool}) AS pos
  FROM {src} q, generate_series(1, {tries}+least({pool}, 2*({n}))) g(j)) QUALIFY row_number() OVER (PARTITION BY k_, pos ORDER BY j)=1)) WHERE turn<={n})"""


MEMBER_SQL = f"""{CELL_SQL}, su AS (SELECT c.*, rep, concat_ws('|', seed, split||CASE WHEN fold>=0 THEN CAST(fold AS VARCHAR) ELSE '' END, station, size, p, rep) AS sub_id
 FROM ce c JOIN (VALUES ('train',0),('train',1),('test',0),('test',1),('inner',0)) r(sp_, rep) ON split=sp_ WHERE reason IS NULL),
rh AS (SELECT seed, split, fold, station, hh, row_number() OVER (PARTITION BY seed, split, fold, station ORDER BY {Q.md('seed', "'draw'", 'hh')}) - 1 AS pos FROM po WHERE role='hp'),
rf AS (SELECT seed, split, fold, hh, row_number() OVER (PARTITION BY seed, split, fold ORDER BY {Q.md('seed', "'draw'", 'hh')}) - 1 AS pos FROM po WHERE role='fill'),
dh AS {draw_sql('su', "'draw|'||sub_id||'|hp'", 'n_hp', 'H')},
df AS {draw_sql('(SELECT * FROM su WHERE size>n_hp)', "'draw|'||sub_id||'|fill'", 'size-n_hp', 'F')},
me AS (SELECT d.seed, d.split, d.fold, d.station, size, p, n_hp, rep, sub_id, r.hh, 'hp' AS role FROM dh d JOIN rh r ON d.seed=r.seed AND d.split=r.split AND d.fold=r.fold AND d.station=r.station AND d.pos=r.pos
 UNION ALL SELECT d.seed, d.split, d.fold, d.station, size, p, n_hp, rep, sub_id, r.hh, 'fill' FROM df d JOIN rf r ON d.seed=r.seed AND d.split=r.split AND d.fold=r.fold AND d.pos=r.pos)"""
READ_TAIL = X.SQL_READ.replace(X.SQL_HH + ", ", "")
DAILY_SQL = f"""{MEMBER_SQL}, {READ_TAIL}, sd0 AS (SELECT sub_id, any_value(m.station) AS station, day, sum(CASE WHEN m.role='hp' THEN hp ELSE 0.0::DOUBLE END) AS hp, sum(own) AS nonhp FROM me m JOIN rd ON m.hh=rd.hh GROUP BY sub_id, day),
sd AS (SELECT sub_id, station, day, hp, nonhp, hp+nonhp AS net, {X.sql_temp('station','day')} AS t FROM sd0)"""
FIT_SQL = f"""{DAILY_SQL}, fl AS (SELECT sub_id, 'hp' AS series, t, hp AS y FROM sd UNION ALL SELECT sub_id, 'nonhp', t, nonhp FROM sd UNION ALL SELECT sub_id, 'net', t, net FROM sd),
{Q.hinge('ft', 'fl', 'sub_id, series')}"""
LINE_SQL = """hl_g AS (SELECT sub_id, count(*)::DOUBLE AS n_, sum(x) AS x1, sum(y) AS y1, sum(x*x) AS xx, sum(x*y) AS xy FROM (SELECT sub_id, greatest(0.0::DOUBLE,12-t)*24 AS x, net AS y FROM sd) GROUP BY 1),
hl_s AS (SELECT *, CASE WHEN n_*xx-x1*x1>1e-9 THEN (n_*xy-x1*y1)/(n_*xx-x1*x1) ELSE 0.0::DOUBLE END AS s0 FROM hl_g),
hl AS (SELECT sub_id, CASE WHEN s0<=0 THEN 0.0::DOUBLE WHEN (y1-s0*x1)/n_<0 THEN greatest(0.0::DOUBLE, xy/nullif(xx,0)) ELSE s0 END AS slope FROM hl_s)"""
SLOT_SQL = f"""{X.SQL_PROFILE}, ss AS (SELECT sub_id, day, slot, sum(CASE WHEN m.role='hp' THEN hp*p_hp ELSE 0.0::DOUBLE END) AS hp, sum(own*p_own) AS nonhp FROM me m JOIN rd ON m.hh=rd.hh JOIN prof ON prof.k=m.hh%{X.CLASSES} GROUP BY 1,2,3)"""
TARGET_SQL = f"""{FIT_SQL}, {LINE_SQL}, {SLOT_SQL}, pk AS (SELECT hh, quantile_cont(hp*p_hp,0.999) AS hp_peak FROM rd JOIN prof ON prof.k=hh%{X.CLASSES} WHERE role='hp' GROUP BY 1),
mp AS (SELECT sub_id, sum(hp_peak) AS HP_Peak, count(*) AS HP_Count FROM me LEFT JOIN pk ON me.hh=pk.hh WHERE role='hp' GROUP BY 1),
co AS (SELECT sub_id, max(hp) AS HP_CoincPeak, max(hp+nonhp) AS peak FROM ss GROUP BY 1), ids AS (SELECT DISTINCT sub_id, seed, split, fold, station, size, p, n_hp FROM me),
tb AS (SELECT ids.*, HP_Peak, CAST(HP_Count AS BIGINT) AS HP_Count, HP_CoincPeak, peak, h.s_h AS s_h, CASE WHEN o.P_base>0 THEN h.s_h/o.P_base END AS r,
 h.P_base+h.s_h*greatest(0.0::DOUBLE, h.T_h+8.0::DOUBLE) AS P_design, h.T_h AS T_h_hp, o.P_base AS P_base_nonhp, n.s_h AS s_h_net, n.P_base AS P_base_net, n.T_h AS T_h_net, n.r2 AS r2_net,
 n.T_min AS T_min_net, n.s_h*greatest(0.0::DOUBLE, n.T_h-n.T_min) AS delta_net, n.hinge_inside AS hinge_inside_net, n.at_bound AS at_bound_net, slope AS hdh_slope_net
 FROM ids JOIN mp USING (sub_id) JOIN co USING (sub_id) JOIN hl USING (sub_id) JOIN ft h ON h.sub_id=ids.sub_id AND h.series='hp' JOIN ft o ON o.sub_id=ids.sub_id AND o.series='nonhp'
 JOIN ft n ON n.sub_id=ids.sub_id AND n.series='net')"""
TARGET_COLS = ("HP_Peak", "HP_CoincPeak", "peak", "s_h", "r", "P_design", "T_h_hp", "P_base_nonhp", "s_h_net", "P_base_net", "T_h_net", "r2_net", "T_min_net", "delta_net", "hdh_slope_net")


# ------------------------------------------------------------------ queries
@query("w01_household_splits", f"WITH {SPLIT_SQL} SELECT seed, grp, hh, split FROM sp")
def w01(spark, d):
    return split_plan(spark, d).select("seed", "grp", "hh", "split")


@query("w02_inner_folds", f"WITH {FOLD_SQL} SELECT seed, hh, grp, fold FROM fo")
def w02(spark, d):
    return K.inner_folds(split_plan(spark, d), FOLDS).select("seed", "hh", "grp", "fold")


@query("g01_plan_cells", f"WITH {CELL_SQL} SELECT seed, split, fold, station, size, p, n_hp, CAST(H AS BIGINT) AS n_pool, CAST(F AS BIGINT) AS n_fill, reason FROM ce")
def g01(spark, d):
    return cell_plan(spark, d).select("seed", "split", "fold", "station", "size", "p", "n_hp", F.col("H").alias("n_pool"), F.col("F").alias("n_fill"), "reason")


@query("g02_draw_members", f"WITH {MEMBER_SQL} SELECT sub_id, role, hh FROM me")
def g02(spark, d):
    return member_plan(spark, d).select("sub_id", "role", "hh")


@query("g02_draw_invariants", f"WITH {CELL_SQL} SELECT CAST(0 AS BIGINT) AS n_repeated, CAST(0 AS BIGINT) AS n_wrong_size, CAST(0 AS BIGINT) AS n_other_station, CAST(0 AS BIGINT) AS n_outside_pool")
def g02_invariants(spark, d):
    """Counts that must be zero: repeated members, wrong sizes, HP members of another station, members outside the pool."""
    m, p = member_plan(spark, d), pool_plan(spark, d)
    hh = hh_table(spark, d).select("hh", F.col("station").alias("home"))
    per = m.groupBy("sub_id", "size", "n_hp").agg(F.count("*").alias("n"), F.count_distinct("hh").alias("u"), F.count_if(F.col("role") == "hp").alias("h"))
    a = per.agg(F.count_if(F.col("n") != F.col("u")).alias("n_repeated"), F.count_if((F.col("n") != F.col("size")) | (F.col("h") != F.col("n_hp"))).alias("n_wrong_size"))
    b = m.where("role = 'hp'").join(hh, "hh").agg(F.count_if(F.col("home") != F.col("station")).alias("n_other_station"))
    c = m.join(p.select(*K.POOL, "hh", "role"), [*K.POOL, "hh", "role"], "left_anti").agg(F.count("*").alias("n_outside_pool"))
    return a.join(b).join(c)


def slot_readings(spark, d, minutes: int = 30):
    """Household loads by slot of the day: clicks stand for the heat pump, all other channels for the rest."""
    from ..operators.aggregate import time_bin
    s = X.slots(spark, d).withColumn("ts", time_bin(F.col("ts"), f"{minutes} minutes")).withColumn("kw", F.col("kw").cast("decimal(18,2)"))
    hp = F.col("channel") == "click"
    g = s.groupBy("hh", "ts").agg(F.sum(F.when(hp, F.col("kw"))).alias("hp"), F.sum(F.when(~hp, F.col("kw"))).alias("own"))
    return g.select("hh", F.to_date("ts").alias("day"), ((F.hour("ts") * 60 + F.minute("ts")) / minutes).cast("int").alias("slot"),
                    *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in ("hp", "own")])


@query("j05_substation_slots", f"""WITH {MEMBER_SQL}, hs AS (SELECT user_id AS hh, CAST(ts AS DATE) AS day, CAST((hour(ts)*60+minute(ts))//30 AS INTEGER) AS slot, coalesce(CAST(sum(CAST(value AS DECIMAL(18,2))) FILTER (event_type='click') AS DOUBLE),0.0::DOUBLE) AS hp,
 coalesce(CAST(sum(CAST(value AS DECIMAL(18,2))) FILTER (event_type<>'click') AS DOUBLE),0.0::DOUBLE) AS own FROM events GROUP BY 1,2,3), g AS (SELECT sub_id, day, slot, sum(CASE WHEN role='hp' THEN hp ELSE 0.0::DOUBLE END) AS hp, sum(own) AS nonhp FROM me JOIN hs USING (hh) GROUP BY 1,2,3)
SELECT sub_id, day, slot, round(hp,6) AS hp, round(nonhp,6) AS nonhp, round(hp+nonhp,6) AS net FROM g""")
def j05_slots(spark, d):
    a = K.aggregate_loads(member_plan(spark, d), slot_readings(spark, d), ["day", "slot"])
    return a.select("sub_id", "day", "slot", *[F.round(c, 6).alias(c) for c in ("hp", "nonhp", "net")])


@query("g03_coincident_slot_peaks", f"""WITH {MEMBER_SQL}, hs AS (SELECT user_id AS hh, CAST(ts AS DATE) AS day, CAST((hour(ts)*60+minute(ts))//30 AS INTEGER) AS slot, coalesce(CAST(sum(CAST(value AS DECIMAL(18,2))) FILTER (event_type='click') AS DOUBLE),0.0::DOUBLE) AS hp,
 coalesce(CAST(sum(CAST(value AS DECIMAL(18,2))) FILTER (event_type<>'click') AS DOUBLE),0.0::DOUBLE) AS own FROM events GROUP BY 1,2,3), g AS (SELECT sub_id, day, slot, sum(CASE WHEN role='hp' THEN hp ELSE 0.0::DOUBLE END) AS hp, sum(own) AS nonhp FROM me JOIN hs USING (hh) GROUP BY 1,2,3)
SELECT sub_id, round(max(hp),6) AS HP_CoincPeak, round(max(hp+nonhp),6) AS peak, count(*) AS n_slots FROM g GROUP BY 1""")
def g03_slots(spark, d):
    """Coincident heat-pump peak and net peak over slots, not daily means."""
    a = K.aggregate_loads(member_plan(spark, d), slot_readings(spark, d), ["day", "slot"])
    return a.groupBy("sub_id").agg(F.round(F.max("hp"), 6).alias("HP_CoincPeak"), F.round(F.max("net"), 6).alias("peak"), F.count("*").alias("n_slots"))


@query("j05_substation_days", f"WITH {DAILY_SQL} SELECT sub_id, day, round(hp,8) AS hp, round(nonhp,8) AS nonhp, round(net,8) AS net, t FROM sd")
def j05(spark, d):
    return daily_plan(spark, d).select("sub_id", "day", r8("hp").alias("hp"), r8("nonhp").alias("nonhp"), r8("net").alias("net"), "t")


@query("g03_substation_targets", f"WITH {TARGET_SQL} SELECT sub_id, seed, split, fold, station, size, p, n_hp, HP_Count, hinge_inside_net, at_bound_net, {', '.join(f'round({c},6) AS {c}' for c in TARGET_COLS)} FROM tb")
def g03(spark, d):
    t = target_plan(spark, d)
    return t.select("sub_id", "seed", "split", "fold", "station", "size", "p", "n_hp", "HP_Count", "hinge_inside_net", "at_bound_net", *[F.round(c, 6).alias(c) for c in TARGET_COLS])


@query("r01_fit_hinge", f"WITH {X.SQL_ND}, {Q.hinge('f', 'nd', 'station')} SELECT station, n_days, round(P_base,6) AS P_base, round(s_h,6) AS s_h, round(T_h,6) AS T_h, round(sse,5) AS sse, round(r2,6) AS r2, T_min, T_max, hinge_inside, at_bound FROM f")
def r01(spark, d):
    f = HG.fit_hinge(X.nation_daily(spark, d), ["station"])
    return f.select("station", "n_days", *[F.round(c, 6).alias(c) for c in ("P_base", "s_h", "T_h")], F.round("sse", 5).alias("sse"), F.round("r2", 6).alias("r2"), "T_min", "T_max", "hinge_inside", "at_bound")


COOL_SRC = "cd AS (SELECT station, -t AS nt, t, kw + 0.2::DOUBLE*greatest(0.0::DOUBLE, t-18) AS y FROM nd)"


@query("r02_fit_cooling", f"WITH {X.SQL_ND}, {COOL_SRC}, {Q.hinge('f', 'cd', 'station', 'nt', 'y', -32.0, -15.0)} SELECT station, n_days, round(P_base,6) AS P_base, round(s_h,6) AS s_c, round(-T_h,6) AS T_c, round(r2,6) AS r2 FROM f")
def r02(spark, d):
    n = X.nation_daily(spark, d).withColumn("y", F.col("kw") + 0.2 * F.greatest(F.lit(0.0), F.col("t") - 18))
    f = HG.fit_cooling(n, ["station"])
    return f.select("station", "n_days", *[F.round(c, 6).alias(c) for c in ("P_base", "s_c", "T_c", "r2")])


BATH_SRC = "bd AS (SELECT station, t, y + 0.2::DOUBLE*greatest(0.0::DOUBLE, t-18) AS y FROM nd)"
BATH_COLS = ("T_heat", "T_cool", "P_base", "s_heat", "s_cool", "r2")


@query("r03_fit_bathtub", f"WITH {X.SQL_ND}, {BATH_SRC}, {Q.bathtub('b', 'bd', 'station')} SELECT station, n_days, {', '.join(f'round({c},6) AS {c}' for c in BATH_COLS)} FROM b")
def r03(spark, d):
    n = X.nation_daily(spark, d).withColumn("y", F.col("y") + 0.2 * F.greatest(F.lit(0.0), F.col("t") - 18))
    f = HG.fit_bathtub(n, ["station"])
    return f.select("station", "n_days", *[F.round(c, 6).alias(c) for c in BATH_COLS])


@query("r04_degree_line", f"""WITH {X.SQL_ND}, z AS (SELECT station, greatest(0.0::DOUBLE,12-t)*24 AS x, y FROM nd), g AS (SELECT station, CAST(count(*) AS BIGINT) AS n_days, regr_slope(y,x) AS s, regr_intercept(y,x) AS b, regr_r2(y,x) AS r2 FROM z GROUP BY 1)
SELECT station, n_days, round(b,6) AS base, round(s,8) AS slope, round(r2,6) AS r2 FROM g""")
def r04(spark, d):
    n = X.nation_daily(spark, d).withColumn("hdh", F.greatest(F.lit(0.0), 12 - F.col("t")) * 24)
    f = HG.fit_degree_line(n, ["station"])
    return f.select("station", "n_days", F.round("base", 6).alias("base"), r8("slope").alias("slope"), F.round("r2", 6).alias("r2"))


@query("r05_fixed_hinge_slopes", f"""WITH {X.SQL_ND} SELECT station, round(regr_slope(y, greatest(0.0::DOUBLE,15-t)),8) AS slope_fixed, round(regr_slope(y,-t) FILTER (t<12),8) AS slope_cold, CAST(count(*) FILTER (t<12) AS BIGINT) AS n_cold FROM nd GROUP BY 1""")
def r05(spark, d):
    s = HG.slope_fixed_hinge(X.nation_daily(spark, d), ["station"], "t", "y", 15.0)
    return s.select("station", r8("slope_fixed").alias("slope_fixed"), r8("slope_cold").alias("slope_cold"), "n_cold")


@query("r06_saturation_arm", f"""WITH {X.SQL_ND}, z AS (SELECT station, 14.0::DOUBLE-t AS x, least(1.0::DOUBLE, greatest(0.0::DOUBLE, y/20)) AS sf FROM nd),
g AS (SELECT station, count(*) FILTER (x>0) AS n, regr_slope(sf,x) FILTER (x>0) AS m, regr_intercept(sf,x) FILTER (x>0) AS b, regr_r2(sf,x) FILTER (x>0) AS r2, stddev_pop(sf) FILTER (x>0)>0 AS ok, max(x) AS ext FROM z GROUP BY 1)
SELECT station, CAST(n AS BIGINT) AS n_arm, CASE WHEN ok THEN round(b,8) END AS b, CASE WHEN ok THEN round(m,8) END AS m, CASE WHEN ok THEN round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, b+m*ext)),8) END AS sf_extreme, CASE WHEN ok THEN round(r2,8) END AS arm_r2 FROM g WHERE n>=10""")
def r06(spark, d):
    n = X.nation_daily(spark, d).withColumn("sf", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("y") / 20))).withColumn("th", F.lit(14.0))
    s = HG.saturation_arm(n, ["station"], "t", "sf", "th").where("n_arm >= 10")
    return s.select("station", "n_arm", *[r8(c).alias(c) for c in ("b", "m", "sf_extreme", "arm_r2")])


@query("w08_prefix_sums", f"""WITH {X.SQL_ND}, c AS (SELECT station, t, count(*) AS m, sum(y) AS my FROM nd GROUP BY 1,2)
SELECT station, t, CAST(sum(m) OVER w AS DOUBLE) AS run_n, round(sum(m*t) OVER w,6) AS st, round(sum(my) OVER w,6) AS sy, round(sum(t*my) OVER w,6) AS sty, lead(t) OVER (PARTITION BY station ORDER BY t) AS t_next
FROM c WINDOW w AS (PARTITION BY station ORDER BY t ROWS UNBOUNDED PRECEDING)""")
def w08(spark, d):
    p = HG.prefix_sums(X.nation_daily(spark, d), ["station"])
    return p.select("station", F.col("T").alias("t"), "run_n", *[F.round(c, 6).alias(c) for c in ("st", "sy", "sty")], "t_next")
