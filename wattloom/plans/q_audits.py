"""Queries over audits, labels, feeder targets, and the remaining generators."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.stats import r8
from ..operators import aggregate as A, audits as U, cohorts as K, hinge as HG, joins as J
from ..session import cut_lineage
from ..sources import tables as X
from ..sources.readers import first_and_last
from . import q_cohorts as C, sqlparts as Q
from .q_joins import AM_SQL, analog_plan
from .registry import query

#: Replicates of both bootstraps.
BOOT = 2000


@query("a16_cluster_bootstrap", f"""WITH {C.TARGET_SQL}, m AS (SELECT sub_id, hh FROM me WHERE role='hp' AND split='test'), hs AS (SELECT hh, row_number() OVER (ORDER BY {Q.md('0', "'boot'", 'hh')})-1 AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT hh FROM m)),
dr AS (SELECT DISTINCT b, {Q.hint('0', "'draw'", 'b', 'j')} % n AS pos FROM range({BOOT}) x(b), (SELECT any_value(n) AS n FROM hs), generate_series(1, n) g(j)),
dhx AS (SELECT b, hh FROM dr JOIN hs USING (pos)), k AS (SELECT b, sub_id FROM m JOIN dhx ON m.hh=dhx.hh GROUP BY 1,2 HAVING count(*)=(SELECT count(*) FROM m m2 WHERE m2.sub_id=m.sub_id)),
p AS (SELECT sub_id, HP_Peak AS y, delta_net*1.3::DOUBLE AS p FROM tb WHERE split='test'), s AS (SELECT b, count(*) AS n, CASE WHEN count(*)>=2 THEN sum(abs(p-y))/sum(y)*100 END AS w FROM k JOIN p USING (sub_id) GROUP BY 1)
SELECT round(quantile_cont(w,0.025),6) AS lo, round(quantile_cont(w,0.975),6) AS hi, round(stddev_pop(w),6) AS sd, CAST(count(w) AS BIGINT) AS n_valid, round(sum(n)/((SELECT count(*) FROM p)*{BOOT})::DOUBLE,8) AS mean_kept FROM s""")
def a16(spark, d):
    t = C.target_plan(spark, d).where("split = 'test'").select("sub_id", F.col("HP_Peak").alias("y"), (F.col("delta_net") * 1.3).alias("p"))
    m = C.member_plan(spark, d).where("role = 'hp' AND split = 'test'")
    b = U.cluster_bootstrap(cut_lineage(t), m, BOOT, 0, "y", "p")
    return b.select(*[F.round(c, 6).alias(c) for c in ("lo", "hi", "sd")], "n_valid", r8("mean_kept").alias("mean_kept"))


ROW_BLOCK = 1000


def mix_sql(x: str) -> str:
    """The 32-bit mix of operators.audits as SQL."""
    once = lambda v: f"((xor({v}, ({v}) >> 16) * 73244475) & 4294967295)"
    out = once(once(f"(({x}) & 4294967295)"))
    return f"xor({out}, ({out}) >> 16)"


# each mix is a column of its own: nested, its text would double at every step
@query("a16_row_bootstrap", f"""WITH z AS (SELECT o_orderpriority, o_orderkey, abs(p-y)/abs(y) AS e FROM (SELECT *, o_totalprice AS y, round(o_totalprice*(0.8::DOUBLE+(o_orderkey%7)/15.0::DOUBLE),6) AS p FROM orders) WHERE y<>0),
r AS (SELECT o_orderpriority, e, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {Q.md('0', 'o_orderkey')})-1 AS pos FROM z), k AS (SELECT o_orderpriority, count(*) AS n, {Q.hint('0', 'o_orderpriority')} AS h FROM z GROUP BY o_orderpriority),
s0 AS (SELECT o_orderpriority, n, b, {mix_sql('h+b')} AS s FROM k, range({BOOT}) b(b)), s1 AS (SELECT o_orderpriority, n, b, s, {mix_sql('s+j')} AS u FROM s0, range(n) g(j)),
c1 AS (SELECT o_orderpriority, n, b, s, ((u*n)>>32)//{ROW_BLOCK} AS blk, count(*) AS m FROM s1 GROUP BY ALL),
d0 AS (SELECT o_orderpriority, b, blk, m, least({ROW_BLOCK}, n-{ROW_BLOCK}*blk) AS w, {mix_sql('s+blk+1')} AS s FROM c1), d1 AS (SELECT o_orderpriority, b, blk, w, {mix_sql('s+i')} AS u FROM d0, range(m) g(i)),
f AS (SELECT o_orderpriority, b, sum(e)/count(*)*100 AS m, count(*) AS n FROM (SELECT o_orderpriority, b, blk*{ROW_BLOCK}+((u*w)>>32) AS pos FROM d1) JOIN r USING (o_orderpriority, pos) GROUP BY 1,2)
SELECT o_orderpriority, round(quantile_cont(m,0.025),6) AS lo, round(quantile_cont(m,0.975),6) AS hi, round(stddev_samp(m),6) AS sd, min(n) AS n_least, max(n) AS n_most FROM f GROUP BY 1""")
def a16_rows(spark, d):
    from .q_aggregate import order_predictions
    b = U.row_bootstrap(order_predictions(spark, d), ["o_orderpriority"], "o_orderkey", BOOT, 0, "y", "p", ROW_BLOCK)
    return b.select("o_orderpriority", *[F.round(c, 6).alias(c) for c in ("lo", "hi", "sd")], "n_least", "n_most")


@query("a17_label_audit", f"""WITH {C.TARGET_SQL}, z AS (SELECT split, HP_CoincPeak/HP_Peak AS c, CASE WHEN n_hp/size::DOUBLE<=0.15 THEN 'pbin<=15' WHEN n_hp/size::DOUBLE<=0.35 THEN 'pbin15-35' WHEN n_hp/size::DOUBLE<=0.65 THEN 'pbin35-65' ELSE 'pbin>65' END AS b FROM tb WHERE HP_Peak>0)
SELECT split, coalesce(b,'all') AS bin, CAST(count(*) AS BIGINT) AS n, round(median(c),6) AS median, round(quantile_cont(c,0.05),6) AS q05, round(quantile_cont(c,0.9),6) AS q90 FROM z GROUP BY GROUPING SETS ((split),(split,b))""")
def a17(spark, d):
    a = U.label_audit(C.target_plan(spark, d), ["split"], "HP_CoincPeak", "HP_Peak", "n_hp", "size")
    return a.select("split", "bin", "n", *[F.round(c, 6).alias(c) for c in ("median", "q05", "q90")])


@query("a17_peak_ratio", f"""WITH {X.SQL_SLOT}, q AS (SELECT channel, floor(epoch(ts)/3600) AS f, CAST(sum(CAST(kw AS DECIMAL(18,2))) AS DOUBLE)/99.991::DOUBLE AS y FROM sl GROUP BY 1,2), c AS (SELECT channel, floor(f/2) AS k, avg(y) AS m, count(*) AS n, max(y) AS x FROM q GROUP BY 1,2)
SELECT channel, round(max(x),8) AS peak_fine, round(max(m) FILTER (n=2),8) AS peak_coarse FROM c GROUP BY 1""")
def a17_ratio(spark, d):
    q = X.slots(spark, d).groupBy("channel", F.date_trunc("hour", "ts").alias("ts")).agg((F.sum(F.col("kw").cast("decimal(18,2)")).cast("double") / 99.991).alias("y"))
    return U.peak_ratio(q, ["channel"], "ts", "y", 3600, 2).select("channel", r8("peak_fine").alias("peak_fine"), r8("peak_coarse").alias("peak_coarse"))


DEC_SQL = """m0 AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS seed, CASE o_orderpriority WHEN '1-URGENT' THEN 'net' WHEN '2-HIGH' THEN 'O1' ELSE 'O2' END AS method, avg(o_totalprice)/99991.0 AS wape FROM orders GROUP BY 1,2)"""


@query("a18_error_decomposition", f"WITH {DEC_SQL}, w AS (SELECT seed, max(wape) FILTER (method='net') AS n, max(wape) FILTER (method='O1') AS o1, max(wape) FILTER (method='O2') AS o2 FROM m0 GROUP BY 1) SELECT seed, round(n,8) AS wape_net, round(n-o1,8) AS fill_contamination, round(o1-o2,8) AS scale_dispersion, round(o2,8) AS fit_noise FROM w")
def a18(spark, d):
    o = X.table(spark, d, "orders")
    m = o.groupBy(F.year("o_orderdate").alias("seed"), F.when(F.col("o_orderpriority") == "1-URGENT", "net").when(F.col("o_orderpriority") == "2-HIGH", "O1")
                  .otherwise("O2").alias("method")).agg((F.avg("o_totalprice") / X.KW).alias("wape"))
    x = U.decomposition(m, ["seed"], "method", "wape", "net", "O1", "O2")
    return x.select("seed", *[r8(c).alias(c) for c in x.columns[1:]])


@query("a19_dispersion_floor", f"""WITH {C.TARGET_SQL}, hq AS (SELECT hh, t, hp AS y FROM rd WHERE role='hp'), {Q.hinge('hf', 'hq', 'hh')}, r AS (SELECT 'household' AS cell, hp_peak/s_h AS v FROM hf JOIN pk USING (hh) WHERE s_h>0 UNION ALL SELECT 'n_hp='||HP_Count, HP_Peak/s_h FROM tb WHERE split='test' AND s_h>0)
SELECT cell, CAST(count(*) AS BIGINT) AS n, round(CASE WHEN count(*)>1 THEN stddev_pop(v)/avg(v) END,5) AS cv FROM r GROUP BY 1""")
def a19(spark, d):
    f = HG.fit_hinge(X.daily_readings(spark, d).where("role = 'hp'"), ["hh"], "t", "hp").join(C.peak_plan(spark, d), "hh")
    a = U.dispersion(f.withColumn("cell", F.lit("household")), ["cell"], "hp_peak", "s_h")
    t = C.target_plan(spark, d).where("split = 'test'").withColumn("cell", F.concat(F.lit("n_hp="), F.col("HP_Count").cast("string")))
    b = U.dispersion(t, ["cell"], "HP_Peak", "s_h")
    return a.unionByName(b).select("cell", "n", F.round("cv", 5).alias("cv"))


@query("a25_fit_diagnostics", f"""WITH {C.TARGET_SQL} SELECT seed, split, CAST(count(*) AS BIGINT) AS n, round(avg(hinge_inside_net::INT),8) AS share_inside, round(avg(at_bound_net::INT),8) AS share_at_bound, round(avg((s_h_net<=0)::INT),8) AS share_failed, CAST(count(*) FILTER (HP_CoincPeak>HP_Peak) AS BIGINT) AS n_coinc_above_sum FROM tb GROUP BY 1,2""")
def a25(spark, d):
    x = U.fit_diagnostics(C.target_plan(spark, d), ["seed", "split"])
    return x.select("seed", "split", "n", *[r8(c).alias(c) for c in ("share_inside", "share_at_bound", "share_failed")], "n_coinc_above_sum")


AC = ("s_h_net", "P_base_net", "delta_net", "peak", "hdh_slope_net")


@query("a26_correlations", f"WITH {C.TARGET_SQL}, " + "c AS (" + " UNION ALL ".join(f"SELECT p, '{c}' AS feature, round(corr({c}, HP_Peak),6) AS corr FROM tb GROUP BY p" for c in AC) + ") SELECT * FROM c")
def a26(spark, d):
    return U.correlations(C.target_plan(spark, d), ["p"], "HP_Peak", list(AC)).select("p", "feature", F.round("corr", 6).alias("corr"))


@query("a26_cell_audit", f"WITH {C.TARGET_SQL} " + " UNION ALL ".join(f"SELECT '{c}' AS feature, round(avg(CASE WHEN {c} IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END),8) AS null_share, round(coalesce(avg(CASE WHEN abs({c})>20 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END),0),8) AS extreme_share FROM tb" for c in ("r", "P_design", "peak", "delta_net")))
def a26_cells(spark, d):
    m = C.target_plan(spark, d).select("sub_id", "r", "P_design", "peak", "delta_net")
    return U.cell_audit(m, ["sub_id"], 20.0).select("feature", r8("null_share").alias("null_share"), r8("extreme_share").alias("extreme_share"))


@query("a26_changed_registrations", """WITH g AS (SELECT l_suppkey, count(DISTINCT l_returnflag)>1 AS a, count(DISTINCT l_linestatus)>1 AS b, min(l_tax)<>max(l_tax) AS c FROM lineitem GROUP BY 1)
SELECT 'l_returnflag' AS "column", CAST(count(*) FILTER (a) AS BIGINT) AS n_changed FROM g UNION ALL SELECT 'l_linestatus', CAST(count(*) FILTER (b) AS BIGINT) FROM g UNION ALL SELECT 'l_tax', CAST(count(*) FILTER (c) AS BIGINT) FROM g""")
def a26_changes(spark, d):
    return U.changed_registrations(X.table(spark, d, "lineitem"), "l_suppkey", ["l_returnflag", "l_linestatus", "l_tax"])


@query("a27_source_inventory", f"""WITH {X.SQL_READ}, w(label,a,b) AS (VALUES {', '.join(f"('{n}', DATE '{a}', DATE '{b}')" for n, a, b in A.season_windows(1995, 2001))}), u AS (SELECT role, hh, count(*) AS n, min(day) AS a, max(day) AS b FROM rd GROUP BY 1,2),
bs AS (SELECT role, CAST(count(*) AS BIGINT) AS n_units, CAST(sum(n) AS BIGINT) AS n_rows, min(a) AS first_day, max(b) AS last_day FROM u GROUP BY 1), k AS (SELECT role, hh, label FROM rd JOIN w ON day>=w.a AND day<w.b GROUP BY 1,2,3 HAVING count(*)>=4), f AS (SELECT role, CAST(count(DISTINCT hh) AS BIGINT) AS n_complete, array_to_string(list_sort(list(DISTINCT label)),',') AS windows FROM k GROUP BY 1)
SELECT bs.*, n_complete, windows FROM bs LEFT JOIN f USING (role)""")
def a27(spark, d):
    r = X.daily_readings(spark, d).select("role", "hh", "day")
    return U.source_inventory(r, "role", "hh", "day", A.season_windows(1995, 2001), A.in_windows, 4)


@query("a28_circuit_fits", f"""WITH c AS (SELECT s_nationkey AS site, CAST(l_shipdate AS DATE) AS day, CASE l_returnflag WHEN 'A' THEN 'heat' WHEN 'N' THEN 'mains' ELSE 'cool' END AS f, l_quantity+CASE l_returnflag WHEN 'N' THEN 40 ELSE 0 END AS p FROM lineitem JOIN supplier ON l_suppkey=s_suppkey),
g AS (SELECT site, day, f, sum(p) AS kw FROM c GROUP BY 1,2,3), w AS (SELECT site, day, max(kw) FILTER (f='heat') AS heat, max(kw) FILTER (f='cool') AS cool, max(kw) FILTER (f='mains') AS mains FROM g GROUP BY 1,2 HAVING count(*)=3),
x AS (SELECT site, day, heat, mains-heat-cool AS res, {X.sql_temp('site', 'day')} AS t FROM w), l AS (SELECT site, 'heat' AS series, t, heat AS y FROM x UNION ALL SELECT site, 'residual', t, res FROM x), {Q.hinge('f', 'l', 'site, series')}
SELECT site, series, n_days, round(P_base,5) AS P_base, round(s_h,5) AS s_h, round(r2,5) AS r2 FROM f""")
def a28(spark, d):
    l, s = X.table(spark, d, "lineitem"), X.table(spark, d, "supplier")
    c = l.join(s, l.l_suppkey == s.s_suppkey).select(F.col("s_nationkey").alias("site"), F.to_date("l_shipdate").alias("day"), "l_returnflag",
                                                     (F.col("l_quantity") + F.when(F.col("l_returnflag") == "N", 40).otherwise(0)).alias("p"))
    temp = c.select("site", "day").distinct().withColumn("t", X.temperature_at(F.col("site"), F.col("day")))
    fam = F.when(F.col("l_returnflag") == "A", "heat").when(F.col("l_returnflag") == "N", "mains").otherwise("cool")
    f = U.circuit_fits(c, temp, "site", "day", fam, "p", 1)
    return f.select("site", "series", "n_days", *[F.round(x, 5).alias(x) for x in ("P_base", "s_h", "r2")])


@query("a29_feeder_targets", """WITH m AS (SELECT l_suppkey AS feeder, CAST(l_shipdate AS DATE) AS day, sum(l_quantity) FILTER (l_returnflag='A') AS hp, sum(l_quantity) FILTER (l_returnflag='N') AS st, sum(l_quantity) FILTER (l_returnflag='R') AS rs FROM lineitem GROUP BY 1,2),
s AS (SELECT feeder, coalesce(arg_min(hp,day) FILTER (year(day)=1998 AND hp IS NOT NULL), arg_min(hp,day) FILTER (hp IS NOT NULL)) AS hp, coalesce(arg_min(st,day) FILTER (year(day)=1998 AND st IS NOT NULL), arg_min(st,day) FILTER (st IS NOT NULL)) AS st, coalesce(arg_min(rs,day) FILTER (year(day)=1998 AND rs IS NOT NULL), arg_min(rs,day) FILTER (rs IS NOT NULL)) AS rs, arg_max(hp,day) FILTER (year(day)=1998 AND hp IS NOT NULL) AS e FROM m GROUP BY 1),
z AS (SELECT feeder, coalesce(hp,0) AS hp, coalesce(hp,0)+coalesce(st,0)+coalesce(rs,0) AS tot, coalesce(e,0) AS e FROM s)
SELECT feeder, hp AS hp_kw, tot AS electric_kw, round(CASE WHEN tot>0 THEN hp/tot ELSE 0.0::DOUBLE END,8) AS hp_share, CASE WHEN tot>0 THEN hp/tot ELSE 0 END>=0.5 AS hp_dominant, hp=e AS stable FROM z""")
def a29(spark, d):
    l = X.table(spark, d, "lineitem")
    kw = lambda f: F.sum(F.when(F.col("l_returnflag") == f, F.col("l_quantity")))
    m = l.groupBy(F.col("l_suppkey").alias("feeder"), F.to_date("l_shipdate").alias("day")).agg(kw("A").alias("hp"), kw("N").alias("st"), kw("R").alias("rs"))
    pairs = [first_and_last(m.where(F.col(c).isNotNull()), "feeder", "day", "1998-01-01", "1998-12-31", [c]) for c in ("hp", "st", "rs")]
    s = pairs[0][0].join(pairs[1][0], "feeder", "full_outer").join(pairs[2][0], "feeder", "full_outer")
    f = U.feeder_targets(s, pairs[0][1], "feeder", "hp", ["st", "rs"])
    return f.withColumn("hp_share", r8("hp_share"))


@query("a30_household_labels", """WITH h AS (SELECT user_id AS hh, CAST(ts AS DATE) AS day, hour(ts)>=12 AS half, avg(value)*1.0::DOUBLE/0.99991::DOUBLE AS v FROM events GROUP BY 1,2,3), s AS (SELECT hh, day, avg(v) AS m FROM h GROUP BY 1,2 HAVING count(*)=2), c AS (SELECT hh, quantile_cont(m,0.999) AS cap FROM s GROUP BY 1)
SELECT c_nationkey AS sub_id, round(sum(cap),6) AS label, CAST(count(cap) AS BIGINT) AS n_labelled, CAST(count(*) AS BIGINT) AS n_members FROM customer LEFT JOIN c ON c.hh=c_custkey GROUP BY 1""")
def a30(spark, d):
    h = X.slots(spark, d).groupBy("hh", F.to_date("ts").alias("day"), (F.hour("ts") >= 12).alias("half")).agg((F.avg("kw") * 1.0 / 0.99991).alias("v"))
    m = X.table(spark, d, "customer").select(F.col("c_custkey").alias("hh"), F.col("c_nationkey").alias("sub_id"))
    x = U.substation_labels(m, U.household_caps(h, "hh", "day", "v"), "hh")
    return x.select("sub_id", F.round("label", 6).alias("label"), "n_labelled", "n_members")


# ------------------------------------------------------------------ other generators
def wr_members(spark, d):
    pool = X.households(spark, d).where("role = 'hp'").select("hh")
    return K.draw_with_replacement(pool, 60, 7, (10, 37), 0.5)


WR_SQL = f"""{X.SQL_HH}, rk AS (SELECT hh, row_number() OVER (ORDER BY {Q.md('7', "'wr'", 'hh')})-1 AS pos, count(*) OVER () AS n FROM hh WHERE role='hp'), pn AS (SELECT count(*) AS n FROM rk),
s0 AS (SELECT '7|wr|'||i AS sub_id FROM range(60) r(i)), s1 AS (SELECT sub_id, CAST(10+floor({Q.hint('sub_id', "'size'")}/4294967296.0::DOUBLE*28) AS INTEGER) AS size, {Q.hint('sub_id', "'pen'")}/4294967296.0::DOUBLE*0.5::DOUBLE AS p FROM s0),
s2 AS (SELECT *, CAST(greatest(1,round_even(p*size,0)) AS INTEGER) AS n_hp FROM s1), mm AS (SELECT sub_id, size, p, n_hp, j, {Q.hint('sub_id', "'m'", 'j')} % n AS pos FROM s2, pn, generate_series(1,size) g(j)),
wm AS (SELECT sub_id, size, p, n_hp, hh, CASE WHEN j<=n_hp THEN 'hp' ELSE 'fill' END AS role, count(*)::DOUBLE AS weight FROM mm JOIN rk USING (pos) GROUP BY ALL)"""


@query("g04_with_replacement", f"WITH {WR_SQL}, {C.READ_TAIL} SELECT sub_id, day, round(sum(CASE WHEN wm.role='hp' THEN weight*hp ELSE 0.0::DOUBLE END),8) AS hp, round(sum(weight*own),8) AS nonhp FROM wm JOIN rd ON wm.hh=rd.hh GROUP BY 1,2")
def g04(spark, d):
    a = K.aggregate_daily(wr_members(spark, d), X.daily_readings(spark, d))
    return a.select("sub_id", "day", r8("hp").alias("hp"), r8("nonhp").alias("nonhp"))


@query("g04_real_feeder", f"WITH {X.SQL_READ} SELECT day, round(sum(hp),8) AS hp, round(sum(own),8) AS nonhp, CAST(count(*) AS BIGINT) AS n_houses FROM rd WHERE role='hp' GROUP BY 1")
def g04_feeder(spark, d):
    r = X.daily_readings(spark, d).where("role = 'hp'")
    return r.groupBy("day").agg(r8(F.sum("hp")).alias("hp"), r8(F.sum("own")).alias("nonhp"), F.count("*").alias("n_houses"))


@query("g05_stations_by_size", f"""WITH {X.SQL_HH}, h AS (SELECT station, count(*) AS H FROM hh WHERE role='hp' GROUP BY 1), e AS (SELECT station, H, sum(H) OVER (ORDER BY station) AS hi, sum(H) OVER () AS T FROM h), f AS (SELECT count(*) AS F FROM hh WHERE role='fill'),
s AS (SELECT '3|nr|'||i AS sub_id FROM range(80) r(i)), u AS (SELECT sub_id, {Q.hint('sub_id', "'station'")}/4294967296.0::DOUBLE AS u, 0.1::DOUBLE+{Q.hint('sub_id', "'pen'")}/4294967296.0::DOUBLE*(0.5::DOUBLE-0.1::DOUBLE) AS p, {Q.hint('sub_id', "'size'")}/4294967296.0::DOUBLE AS us FROM s),
k AS (SELECT sub_id, station, H, p, us FROM u JOIN e ON u*T>=hi-H AND u*T<hi), t AS (SELECT *, greatest(10, least(40, floor(H/p))) AS top_ FROM k), z AS (SELECT *, CAST(10+floor(us*(top_-10+1)) AS INTEGER) AS size FROM t)
SELECT sub_id, station, CAST(H AS BIGINT) AS n_pool, (SELECT CAST(F AS BIGINT) FROM f) AS n_fill, round(p,8) AS p, size, CAST(least(H, greatest(1, round_even(p*size,0))) AS INTEGER) AS n_hp FROM z""")
def g05(spark, d):
    s = K.draw_stations_by_size(C.hh_table(spark, d), 80, 3, (10, 40), (0.1, 0.5))
    return s.select("sub_id", "station", F.col("H").alias("n_pool"), F.col("F").alias("n_fill"), r8("p").alias("p"), "size", "n_hp")


NR_SUBS, NR_SIZES, NR_PEN = {"train": 60, "test": 30}, (10, 40), (0.1, 1.0)
NR_SQL = f"""{C.CELL_SQL}, p0 AS (SELECT * FROM po WHERE seed=0 AND fold=-1), nh AS (SELECT split, station, count(*) AS H FROM p0 WHERE role='hp' GROUP BY 1,2 HAVING count(*)>=3), ne AS (SELECT *, sum(H) OVER (PARTITION BY split ORDER BY station) AS hi, sum(H) OVER (PARTITION BY split) AS T FROM nh),
nf AS (SELECT split, count(*) AS F FROM p0 WHERE role='fill' GROUP BY 1), ns AS (SELECT split, F, rep, '5|nr|'||split||'|'||rep AS sub_id FROM nf JOIN (SELECT 'train' AS split, range AS rep FROM range({NR_SUBS['train']}) UNION ALL SELECT 'test', range FROM range({NR_SUBS['test']})) USING (split)),
nu AS (SELECT *, {Q.hint('sub_id', "'station'")}/4294967296.0::DOUBLE AS u, {NR_PEN[0]}::DOUBLE+{Q.hint('sub_id', "'pen'")}/4294967296.0::DOUBLE*({NR_PEN[1]}::DOUBLE-{NR_PEN[0]}::DOUBLE) AS p0_, {Q.hint('sub_id', "'size'")}/4294967296.0::DOUBLE AS us FROM ns),
nk AS (SELECT nu.*, station, H, CASE WHEN floor(H/p0_)<{NR_SIZES[0]} THEN least({NR_PEN[1]}::DOUBLE, H/{NR_SIZES[0]}::DOUBLE) ELSE p0_ END AS p FROM nu JOIN ne USING (split) WHERE u*T>=hi-H AND u*T<hi),
nz AS (SELECT *, CAST({NR_SIZES[0]}+floor(us*(greatest({NR_SIZES[0]}, least({NR_SIZES[1]}, floor(round(H/p,9))))-{NR_SIZES[0]}+1)) AS INTEGER) AS size FROM nk),
sw AS (SELECT sub_id, split, station, H, F, p, size, CAST(least(H, greatest(1, round_even(p*size,0))) AS INTEGER) AS n_hp FROM nz),
qh AS (SELECT split, station, hh, row_number() OVER (PARTITION BY split, station ORDER BY {Q.md('seed', "'nr'", 'hh')})-1 AS pos FROM p0 WHERE role='hp'), qf AS (SELECT split, hh, row_number() OVER (PARTITION BY split ORDER BY {Q.md('seed', "'nr'", 'hh')})-1 AS pos FROM p0 WHERE role='fill'),
xh AS {C.draw_sql('sw', "'nr|'||sub_id||'|hp'", 'n_hp', 'H')}, xf AS {C.draw_sql('(SELECT * FROM sw WHERE size>n_hp)', "'nr|'||sub_id||'|fill'", 'size-n_hp', 'F')},
me AS (SELECT d.sub_id, d.split, d.station, r.hh, 'hp' AS role FROM xh d JOIN qh r ON d.split=r.split AND d.station=r.station AND d.pos=r.pos UNION ALL SELECT d.sub_id, d.split, d.station, r.hh, 'fill' FROM xf d JOIN qf r ON d.split=r.split AND d.pos=r.pos)"""


def without_replacement(spark, d):
    s, m = K.draw_without_replacement(C.pool_plan(spark, d).where("seed = 0 AND fold = -1"), NR_SUBS, 5, NR_SIZES, NR_PEN)
    return s, cut_lineage(m)


@query("g05_members", f"WITH {NR_SQL} SELECT sub_id, split, station, role, hh FROM me")
def g05_members(spark, d):
    """Members of substations without replacement: distinct households of one side of the split, HP members of one station."""
    return without_replacement(spark, d)[1].select("sub_id", "split", "station", "role", "hh")


@query("g05_targets", f"""WITH {NR_SQL}, {C.READ_TAIL}, {C.SLOT_SQL}, pk AS (SELECT hh, quantile_cont(hp*p_hp,0.999) AS hp_peak FROM rd JOIN prof ON prof.k=hh%{X.CLASSES} WHERE role='hp' GROUP BY 1),
hp_ AS (SELECT sub_id, sum(hp_peak) AS y FROM me LEFT JOIN pk USING (hh) WHERE role='hp' GROUP BY 1), co AS (SELECT sub_id, max(hp) AS c, max(hp+nonhp) AS p, sum(hp+nonhp)/{X.SLOTS} AS e FROM ss GROUP BY 1)
SELECT sw.sub_id, split, station, size, n_hp, round(y,6) AS HP_Peak, round(c,6) AS HP_CoincPeak, round(co.p,6) AS peak, round(e,5) AS day_loads FROM sw JOIN hp_ USING (sub_id) JOIN co USING (sub_id)""")
def g05_targets(spark, d):
    """Loads and targets of these substations from half-hour slots."""
    s, m = without_replacement(spark, d)
    a = K.aggregate_slots(m, C.slots_of(spark, d, m), X.SLOTS).groupBy("sub_id").agg(F.max("hp_max").alias("HP_CoincPeak"), F.max("net_max").alias("peak"), F.sum("net").alias("day_loads"))
    y = m.where("role = 'hp'").join(C.peak_plan(spark, d, m), "hh", "left").groupBy("sub_id").agg(F.sum("hp_peak").alias("HP_Peak"))
    return s.join(y, "sub_id").join(a, "sub_id").select("sub_id", "split", "station", "size", "n_hp", *[F.round(c, 6).alias(c) for c in ("HP_Peak", "HP_CoincPeak", "peak")], F.round("day_loads", 5).alias("day_loads"))


def factorial_members(spark, d, tag="fact"):
    """Balanced design: every split x size x penetration x replicate from the station pools."""
    p = C.pool_plan(spark, d).where("fold = -1")
    cells = K.plan_cells(p, (20, 30, 40), (0.05, 0.1, 0.2, 0.3), C.MIN_POOL, 1.0)
    return K.draw_members(K.substations(cells, {"train": 2, "test": 2}), p, tag)


@query("g06_factorial_design", f"""WITH {C.CELL_SQL}, hf AS (SELECT seed, split, station, count(*) AS H FROM po WHERE fold=-1 AND role='hp' GROUP BY ALL), c AS (SELECT hf.*, size, p, greatest(1, round_even(p::DOUBLE*size,0)) AS n FROM hf, (VALUES (20),(30),(40)) a(size), (VALUES (0.05),(0.1),(0.2),(0.3)) b(p))
SELECT seed, split, CAST(sum(2) AS BIGINT) AS n_substations, CAST(sum(2*size) AS BIGINT) AS n_member_rows, CAST(0 AS BIGINT) AS n_replay_differs FROM c WHERE H>={C.MIN_POOL} AND n<=H GROUP BY 1,2""")
def g06(spark, d):
    """Counts of the design and the replay check: two seeded runs agree row by row."""
    a = cut_lineage(factorial_members(spark, d))
    b = factorial_members(spark, d)
    diff = a.select("seed", "split", "sub_id", "hh").exceptAll(b.select("seed", "split", "sub_id", "hh")).groupBy("seed", "split").agg(F.count("*").alias("x"))
    g = a.groupBy("seed", "split").agg(F.count_distinct("sub_id").alias("n_substations"), F.count("*").alias("n_member_rows"))
    return g.join(diff, ["seed", "split"], "left").select("seed", "split", "n_substations", "n_member_rows", F.coalesce("x", F.lit(0)).cast("bigint").alias("n_replay_differs"))


@query("g06_member_stacking")
def g06_stacking(spark, d):
    """How often one household is reused across the substations of a design."""
    u = factorial_members(spark, d).groupBy("seed", "split", "role", "hh").agg(F.count("*").alias("n"))
    return u.groupBy("seed", "split", "role").agg(F.count("*").alias("n_households"), F.max("n").alias("max_uses"), r8(F.avg("n")).alias("mean_uses"))


LEVELS = (5, 10, 20)


def sweep(spark, d):
    """Penetration sweep: the whole pool's own load, plus the heat pumps of k drawn houses; estimate against their capacity."""
    hp = X.households(spark, d).where("role = 'hp'").select("hh", "cap").withColumn("_g", F.lit(0))
    from ..functions.hashing import digest, draw_positions, hash_rank
    r = hash_rank(hp, ["_g"], digest(F.lit("sweep"), F.col("hh")))
    n = r.groupBy("_g").agg(F.max("pool_size").alias("n"))
    s = n.withColumn("k", F.explode(K.ints(LEVELS))).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(9)))).withColumn("sid", F.concat_ws("|", F.lit("sw"), F.col("k").cast("string"), F.col("draw").cast("string")))
    m = draw_positions(s, F.least(F.col("k"), F.col("n")), F.col("n"), F.col("sid")).join(r.select("hh", "cap", "pos"), "pos").select("sid", "k", "draw", "hh", "cap")
    return m


@query("g07_penetration_sweep", f"""WITH {X.SQL_READ}, r AS (SELECT hh, cap, row_number() OVER (ORDER BY {Q.md("'sweep'", 'hh')})-1 AS pos, count(*) OVER () AS n FROM hh WHERE role='hp'), s AS (SELECT k, d, 'sw|'||k||'|'||d AS sid, (SELECT any_value(n) FROM r) AS n FROM (VALUES (5),(10),(20)) a(k), range(10) b(d)),
m0 AS (SELECT sid, k, d, n, pos FROM {C.draw_sql('s', 'sid', 'least(k,n)', 'n')}), m AS (SELECT m0.sid, k, d, hh, cap FROM m0 JOIN r USING (pos)), y AS (SELECT sid, k, sum(cap) AS y FROM m GROUP BY 1,2),
bs AS (SELECT day, sum(own)/50.0::DOUBLE AS own, avg(t) AS t FROM rd GROUP BY 1), sm AS (SELECT sid, rd.day, sum(hp) AS hp FROM m JOIN rd ON m.hh=rd.hh GROUP BY 1,2), g AS (SELECT y.sid, bs.day, t, own, coalesce(hp,0) AS hp FROM y CROSS JOIN bs LEFT JOIN sm ON sm.sid=y.sid AND sm.day=bs.day), z AS (SELECT sid, t, own+hp AS y FROM g), {Q.hinge('f', 'z', 'sid')},
e AS (SELECT f.sid, k, y, s_h*100 AS a, (P_base+s_h)*8 AS b FROM f JOIN y USING (sid)), l AS (SELECT k, 'slope' AS method, y, a AS p FROM e UNION ALL SELECT k, 'base', y, b FROM e), w AS (SELECT k, method, round(sum(abs(p-y))/sum(y)*100,5) AS wape FROM l GROUP BY 1,2)
SELECT k, method, wape, wape=min(wape) OVER (PARTITION BY k) AS best FROM w""")
def g07(spark, d):
    m = cut_lineage(sweep(spark, d))
    r = X.daily_readings(spark, d)
    y = m.groupBy("sid", "k").agg(F.sum("cap").alias("y"))
    base = r.groupBy("day").agg((F.sum("own") / 50.0).alias("own"), F.avg("t").alias("t"))
    hp = m.join(r.select("hh", "day", "hp"), "hh").groupBy("sid", "day").agg(F.sum("hp").alias("hp"))
    # the base load repeats for each of the design's subsets: one row per calendar day each
    sids = y.groupBy().agg(F.collect_list("sid").alias("s"))
    g = base.join(F.broadcast(sids)).withColumn("sid", F.explode("s")).drop("s").join(hp, ["sid", "day"], "left").withColumn("z", F.col("own") + F.coalesce("hp", F.lit(0.0)))
    e = HG.fit_hinge(g, ["sid"], "t", "z").join(y, "sid")
    l = e.select("k", "y", F.explode(F.create_map(F.lit("slope"), F.col("s_h") * 100, F.lit("base"), (F.col("P_base") + F.col("s_h")) * 8)).alias("method", "p"))
    s = A.score(l, ["k", "method"], "y", "p").select("k", "method", F.round("wape", 5).alias("wape"))
    best = s.groupBy("k").agg(F.min("wape").alias("_m"))
    return s.join(best, "k").select("k", "method", "wape", (F.col("wape") == F.col("_m")).alias("best"))


@query("g10_learning_curve_designs", f"""WITH {C.SPLIT_SQL}, t AS (SELECT sp.seed, n, dr, station, hh FROM sp, (VALUES (16),(32),(64),(100000)) a(n), range(2) b(dr) WHERE split='train' AND role='hp'),
r AS (SELECT *, row_number() OVER (PARTITION BY seed, n, dr ORDER BY {Q.md('seed', "'lc'", 'n', 'dr', 'hh')})-1 AS pos, count(*) OVER (PARTITION BY seed, n, dr) AS c FROM t) SELECT seed, n, CAST(dr AS INTEGER) AS lc_draw, station, hh FROM r WHERE pos<n AND n<=c""")
def g10(spark, d):
    return K.subsample_train(C.split_plan(spark, d), [16, 32, 64, 100000], 2)


LC_N, LC_DRAWS = [32, 64, 128, 100000, None], 2
_NS = ", ".join(f"({n})" for n in LC_N if n is not None)
LC_POOL_SQL = f"""lt AS (SELECT sp.*, dr, row_number() OVER (PARTITION BY seed, dr ORDER BY {Q.md('seed', "'lc'", 'dr', 'hh')})-1 AS pos, count(*) OVER (PARTITION BY seed, dr) AS H FROM sp, range({LC_DRAWS}) d(dr) WHERE split='train' AND role='hp'),
ld AS (SELECT seed, hh, role, station, cap, grp, n, dr FROM lt, (VALUES {_NS}) x(n) WHERE pos<n AND n<=H UNION ALL SELECT seed, hh, role, station, cap, grp, NULL, dr FROM lt WHERE dr=0), lk AS (SELECT DISTINCT seed, n, dr FROM ld),
lw AS (SELECT * FROM ld UNION ALL SELECT sp.seed, hh, role, station, cap, grp, n, dr FROM sp JOIN lk USING (seed) WHERE split='train' AND role='fill'), ll AS (SELECT *, coalesce(CAST(n AS VARCHAR),'all')||'@'||dr AS lab FROM lw),
lf AS (SELECT *, row_number() OVER (PARTITION BY seed, lab, grp ORDER BY {Q.md('seed', "'fold'", 'hh')})-1 AS pos FROM ll),
po AS (SELECT hh, role, station, cap, seed, 'train@'||lab AS split, -1 AS fold FROM ll UNION ALL SELECT hh, role, station, cap, seed, 'inner@'||lab, CAST((CASE WHEN role='hp' THEN {Q.hint('seed', "'start'", 'grp')} % {C.FOLDS} ELSE 0 END + pos) % {C.FOLDS} AS INTEGER) FROM lf
 UNION ALL SELECT hh, role, station, cap, seed, 'test', -1 FROM sp WHERE split='test')"""
_PO = "po AS (SELECT hh, role, station, cap, seed, split, -1 AS fold FROM sp UNION ALL SELECT hh, role, station, cap, seed, 'inner', fold FROM fo)"
LC_MEMBER_SQL = C.MEMBER_SQL.replace(_PO, LC_POOL_SQL).replace("ON split=sp_ WHERE", "ON split_part(split,'@',1)=sp_ WHERE")


def curve_designs(spark, d):
    pool, reasons = K.learning_curve_pools(cut_lineage(C.split_plan(spark, d)), LC_N, LC_DRAWS, C.FOLDS)
    return K.learning_curve_members(cut_lineage(pool), LC_N, LC_DRAWS, C.SIZES, C.PENS, C.PER_CELL, C.MIN_POOL, C.OVERLAP), reasons


@query("g10_rebuilt_members", f"""WITH {LC_MEMBER_SQL} SELECT seed, split_part(split,'@',1) AS part, TRY_CAST(nullif(split_part(split,'@',2),'') AS INTEGER) AS n, TRY_CAST(nullif(split_part(split,'@',3),'') AS INTEGER) AS lc_draw, fold, count(DISTINCT sub_id) AS n_substations, count(*) AS n_members,
 CAST(sum({Q.hint('sub_id', 'role', 'hh')}) AS BIGINT) AS digest FROM me GROUP BY seed, split, fold""")
def g10_members(spark, d):
    """Train, folds and test substations of every learning-curve design."""
    m = cut_lineage(curve_designs(spark, d)[0])
    keys = ["seed", "split", "part", "n", "lc_draw", "fold"]
    c = m.groupBy("seed", "split", "fold").agg(F.count_distinct("sub_id").alias("n_substations"))
    return K.members_digest(m, keys).join(c, ["seed", "split", "fold"]).drop("split")


@query("g10_test_identity", f"""WITH {C.MEMBER_SQL} SELECT seed, count(*) AS n_members, CAST(sum({Q.hint('sub_id', 'role', 'hh')}) AS BIGINT) AS digest, true AS same FROM me WHERE split='test' GROUP BY 1""")
def g10_identity(spark, d):
    """The designs' test substations are those of the main run: rows and digest of both, compared."""
    a = K.members_digest(C.member_plan(spark, d).where("split = 'test'"), ["seed"])
    b = K.members_digest(curve_designs(spark, d)[0].where("part = 'test'"), ["seed"]).select("seed", F.col("n_members").alias("_n"), F.col("digest").alias("_d"))
    return a.join(b, "seed", "full_outer").select("seed", "n_members", "digest", F.coalesce((F.col("n_members") == F.col("_n")) & (F.col("digest") == F.col("_d")), F.lit(False)).alias("same"))


@query("g10_infeasible_sizes", f"""WITH {C.SPLIT_SQL}, h AS (SELECT seed, count(*) AS H FROM sp WHERE split='train' AND role='hp' GROUP BY 1) SELECT seed, CAST(n AS INTEGER) AS n, CAST(dr AS INTEGER) AS lc_draw, 'n = '||n||' > '||H||' train HP households' AS reason FROM h, (VALUES {_NS}) x(n), range({LC_DRAWS}) r(dr) WHERE n>H""")
def g10_reasons(spark, d):
    return curve_designs(spark, d)[1]


@query("g11_design_envelope", f"""WITH {C.CELL_SQL}, z AS (SELECT *, reason IS NULL AS ok, CASE WHEN n_hp/size::DOUBLE<=0.15 THEN 'pbin<=15' WHEN n_hp/size::DOUBLE<=0.35 THEN 'pbin15-35' WHEN n_hp/size::DOUBLE<=0.65 THEN 'pbin35-65' ELSE 'pbin>65' END AS bin,
 CASE WHEN reason IS NULL THEN (SELECT sum(log10(H-i+1)-log10(i)) FROM generate_series(1,n_hp) g(i)) END AS lc FROM ce)
SELECT split, bin, CAST(count(*) FILTER (ok) AS BIGINT) AS n_feasible, CAST(count(*) FILTER (NOT ok) AS BIGINT) AS n_dropped, CAST(min(size) FILTER (ok) AS INTEGER) AS size_min, CAST(max(size) FILTER (ok) AS INTEGER) AS size_max, CAST(min(H) AS BIGINT) AS pool_min, CAST(max(H) AS BIGINT) AS pool_max, round(max(lc),8) AS log10_subsets FROM z GROUP BY 1,2""")
def g11(spark, d):
    e = K.design_envelope(C.cell_plan(spark, d))
    return e.select("split", "bin", "n_feasible", "n_dropped", "size_min", "size_max", F.col("H_min").alias("pool_min"), F.col("H_max").alias("pool_max"), r8("log10_subsets").alias("log10_subsets"))


@query("g12_filler_self_test", f"""WITH {X.SQL_READ}, {AM_SQL}, fd AS (SELECT station, day, sum(own) AS y FROM rd WHERE role='fill' GROUP BY 1,2), pl AS (SELECT am.station, am.day, fd.y AS p FROM am JOIN fd ON fd.station=am.station AND fd.day=am.src), j AS (SELECT fd.station, fd.day, y, p FROM fd JOIN pl ON fd.station=pl.station AND fd.day=pl.day)
SELECT station, CAST(count(*) AS BIGINT) AS n_days, round((sum(p)-sum(y))/sum(y),8) AS energy_error, round((quantile_cont(p,0.95)-quantile_cont(y,0.95))/quantile_cont(y,0.95),8) AS tail_error FROM j GROUP BY 1""")
def g12(spark, d):
    f = X.daily_readings(spark, d).where("role = 'fill'").groupBy("station", "day").agg(F.sum("own").alias("y"))
    src = f.select(F.lit("all").alias("set_id"), "station", F.col("day").alias("src"), F.lit(0).alias("slot"), F.col("y").alias("kw"))
    p = J.place_analogs(src, analog_plan(spark, d), ["station"]).select("station", "day", F.col("kw").alias("p"))
    q = lambda c: F.percentile(c, 0.95)
    return f.join(p, ["station", "day"]).groupBy("station").agg(F.count("*").alias("n_days"), r8((F.sum("p") - F.sum("y")) / F.sum("y")).alias("energy_error"), r8((q("p") - q("y")) / q("y")).alias("tail_error"))
