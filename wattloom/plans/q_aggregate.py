"""Queries over reductions and features (A rows)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stats as S
from ..functions.scan import exact_quantiles
from ..functions.stats import r8
from ..operators import aggregate as A, cohorts as K, hinge as HG
from ..sources import tables as X
from .q_clean import GRID_SQL, grid
from .q_cohorts import DAILY_SQL, MEMBER_SQL, SLOT_SQL, member_plan, slot_plan
from .registry import query

R = "round({},8)"


def rounded(df, *cols):
    return df.select(*[r8(c).alias(c) if c in cols else F.col(f"`{c}`") for c in df.columns])


@query("a01_change_resolution", f"""WITH {GRID_SQL}, z AS (SELECT hh, date_trunc('day', ts) AS day, sum(kw) AS s, count(kw) AS nv, count(*) AS n, max(kw) AS mx, min(kw) AS mn, avg(kw) AS av FROM gr GROUP BY 1,2)
SELECT hh, CAST(day AS DATE) AS day, round(CASE WHEN nv=n THEN s END,8) AS kwh_strict, round(s,8) AS kwh_skip, round(mx,8) AS t_max_daily, round(mn,8) AS t_min_daily, round(av,8) AS t_mean_daily FROM z""")
def a01(spark, d):
    g = grid(spark, d)
    strict = A.change_resolution(g.select("hh", "ts", F.col("kw").alias("kwh_strict")), ["hh"], "ts", "day")
    skip = A.change_resolution(g.select("hh", "ts", F.col("kw").alias("kwh_skip"), F.col("kw").alias("t_max_daily"), F.col("kw").alias("t_min_daily"),
                                        F.col("kw").alias("t_mean_daily")), ["hh"], "ts", "day", skip_null=True)
    j = strict.join(skip, ["hh", "ts"])
    return rounded(j.withColumn("day", F.to_date("ts")).drop("ts"), "kwh_strict", "kwh_skip", "t_max_daily", "t_min_daily", "t_mean_daily")


@query("a01_half_hours", f"""WITH {X.SQL_SLOT} SELECT hh, channel, time_bucket(INTERVAL 30 MINUTE, ts) AS ts, round(CAST(sum(CAST(kw AS DECIMAL(18,2))) AS DOUBLE),8) AS kwh_sum, max(kw) AS t_max_slot, arg_min(kw, (ts, event_id)) AS first_kw FROM sl GROUP BY 1,2,3""")
def a01_half_hours(spark, d):
    s = X.slots(spark, d)
    g = s.select("hh", "channel", "ts", F.col("kw").cast("decimal(18,2)").alias("kwh_sum"), F.col("kw").alias("t_max_slot"))
    first = s.groupBy("hh", "channel", A.time_bin(F.col("ts"), "30 minutes").alias("ts")).agg(F.min_by("kw", F.struct("ts", "event_id")).alias("first_kw"))
    r = A.change_resolution(g, ["hh", "channel"], "ts", "30 minutes").withColumn("kwh_sum", F.round(F.col("kwh_sum").cast("double"), 8))
    return r.join(first, ["hh", "channel", "ts"])


@query("a02_daily_min_max", f"""WITH {X.SQL_READ} SELECT nation, day, round(min(t+own),8) AS t_min, round(max(own+hp),8) AS y_max FROM rd GROUP BY 1,2 HAVING min(t+own)<12""")
def a02(spark, d):
    r = X.daily_readings(spark, d).withColumn("ts_", F.col("t") + F.col("own")).withColumn("y", F.col("own") + F.col("hp"))
    return rounded(A.daily_min_max(r, ["nation"], "day", "ts_", "y"), "t_min", "y_max")


@query("a03_daily_means", f"""WITH {X.SQL_READ} SELECT nation, day, round(avg(t),8) AS t, round(avg(own+hp),8) AS y, avg(t)<12 AS heating FROM rd GROUP BY 1,2""")
def a03(spark, d):
    r = X.daily_readings(spark, d).withColumn("load", F.col("own") + F.col("hp"))
    return rounded(A.daily_means(r, ["nation"], "day", "t", "load").withColumn("heating", F.col("t") < 12), "t", "y")


@query("a04_degree_hours", f"""WITH {X.SQL_HOUR} SELECT hh, CAST(ts AS DATE) AS day, round(sum(greatest(0.0::DOUBLE, 12-({X.sql_temp('hh','ts')}))),8) AS hdh, round(avg(kw),8) AS mean_load, round(sum(kw),8) AS energy FROM hr GROUP BY 1,2""")
def a04(spark, d):
    h = X.hourly(spark, d).withColumn("day", F.to_date("ts")).withColumn("t", X.temperature_at(F.col("hh"), F.to_date("ts")))
    return rounded(A.daily_degree_hours(h, ["hh"], "day", "t", "kw", 1.0), "hdh", "mean_load", "energy")


def net_slots(spark, d):
    """Hourly net load per channel with a temperature that swings around the daily value."""
    s = (X.slots(spark, d).groupBy("channel", F.date_trunc("hour", "ts").alias("ts"))
         .agg((F.sum(F.col("kw").cast("decimal(18,2)")).cast("double") / 0.99991).alias("y")))
    return s.withColumn("t", F.round(X.temperature_at(F.length("channel"), F.to_date("ts")) + 10 + F.hour("ts") / 4.0, 4))


NET_SQL = f"""{X.SQL_SLOT}, n0 AS (SELECT channel, date_trunc('hour', ts) AS ts, CAST(sum(CAST(kw AS DECIMAL(18,2))) AS DOUBLE)/0.99991::DOUBLE AS y FROM sl GROUP BY 1,2),
n1 AS (SELECT *, round({X.sql_temp('length(channel)', 'ts')}+10+hour(ts)/4.0::DOUBLE,4) AS t FROM n0 WHERE isodow(ts)<6), n2 AS (SELECT *, CAST(ts AS DATE) AS day, greatest(0.0::DOUBLE,12-t) AS hdh FROM n1),
n3 AS (SELECT channel, day, sum(hdh) AS sev FROM n2 GROUP BY 1,2),
n4 AS (SELECT n2.*, CASE WHEN hour(ts)<6 THEN 'night' WHEN hour(ts)<10 THEN 'morning' WHEN hour(ts)<16 THEN 'day' ELSE 'evening' END AS win,
 CASE WHEN sev<=0 THEN 'warm' WHEN sev<=60 THEN 'mild' WHEN sev<=120 THEN 'cold' ELSE 'extreme' END AS bin FROM n2 JOIN n3 USING (channel, day))"""


def windowed_sql(ctes: str, src: str, key: str) -> str:
    """Statistics of the slots `src` (key, day, y, win, bin), wide."""
    stats = {"Mean": "avg(y)", "Std": "CASE WHEN count(y)>=2 THEN stddev_samp(y) END", "Min": "min(y)", "Max": "max(y)", "Skew": "CASE WHEN count(y)>=3 THEN skewness(y) END",
             "Kurtosis": "CASE WHEN count(y)>=4 THEN kurtosis(y) END", "Q50": "quantile_cont(y,0.5)", "Q95": "quantile_cont(y,0.95)", "N_days": "count(DISTINCT day)"}
    cells = ", ".join(f"{v} AS {k}" for k, v in stats.items())
    pick = lambda w, b, s: f"max(CASE WHEN win='{w}' AND bin='{b}' THEN {s} END)"
    out = []
    for w in A.WINDOWS:
        for b in A.SEVERITY:
            for s in ("Mean", "Std", "Skew", "Kurtosis", "Q95"):
                out.append(f'round({pick(w, b, s)},6) AS "Feature {w}_{b}_{s}"')
            out.append(f'coalesce(CAST({pick(w, b, "N_days")} AS DOUBLE),0) AS "Feature {w}_{b}_N_days"')
        for hi, lo in A.PAIRS:
            for s in ("Mean", "Q50"):
                h, l = pick(w, hi, s), pick(w, lo, s)
                out += [f'round({h}-{l},6) AS "Feature {w}_delta_{s}_{hi}_{lo}"', f'round({h}/({l}+1e-6::DOUBLE),6) AS "Feature {w}_ratio_{s}_{hi}_{lo}"',
                        f'round(({h}-{l})/({l}+1e-6::DOUBLE),6) AS "Feature {w}_normdelta_{s}_{hi}_{lo}"']
    return f"WITH {ctes}, c AS (SELECT {key}, win, bin, {cells} FROM {src} GROUP BY 1,2,3) SELECT {key}, {', '.join(out)} FROM c GROUP BY 1"


def checked_features(f, key):
    """The columns that the SQL has, rounded."""
    keep = [c for c in f.columns if c.endswith("_N_days") or any((f"{x}_{s}_" in c) for x in ("delta", "ratio", "normdelta") for s in ("Mean", "Q50")) or (
        c != key and not any(x in c for x in ("delta_", "ratio_")) and c.rsplit("_", 1)[-1] in ("Mean", "Std", "Skew", "Kurtosis", "Q95"))]
    return f.select(key, *[F.round(F.col(f"`{c}`"), 6).alias(c) for c in keep])


@query("a05_windowed_features", windowed_sql(NET_SQL, "n4", "channel"))
def a05(spark, d):
    return checked_features(A.windowed_features(net_slots(spark, d), ["channel"], "ts", "t", "y", mild=60.0, cold=120.0), "channel")


@query("a05_filled_slots", f"""WITH {X.SQL_SLOT}, b AS (SELECT channel, hh%5 AS g, time_bucket(INTERVAL 15 MINUTES, ts) AS ts, avg(kw) AS y FROM sl WHERE kw>5 GROUP BY 1,2,3),
sp AS (SELECT channel, g, min(ts) AS a, max(ts) AS z FROM b GROUP BY 1,2), gr AS (SELECT channel, g, unnest(generate_series(a, z, INTERVAL 15 MINUTES)) AS ts FROM sp)
SELECT channel, CAST(g AS BIGINT) AS g, ts, round(last_value(y IGNORE NULLS) OVER (PARTITION BY channel, g ORDER BY ts ROWS UNBOUNDED PRECEDING),6) AS y FROM gr LEFT JOIN b USING (channel, g, ts)""")
def a05_filled(spark, d):
    """Quarter-hour means with gaps filled by the value before."""
    s = X.slots(spark, d).where("kw > 5").withColumn("g", (F.col("hh") % 5).cast("long"))
    return A.regular_slots(s, ["channel", "g"], "ts", ["kw"], 15).select("channel", "g", "ts", F.round("kw", 6).alias("y"))


WHDD_SQL = f"""{DAILY_SQL}, {SLOT_SQL}, wf AS (SELECT ss.sub_id, ss.day, ss.hp+ss.nonhp AS y, CASE WHEN slot<12 THEN 'night' WHEN slot<20 THEN 'morning' WHEN slot<32 THEN 'day' ELSE 'evening' END AS win,
 CASE WHEN t>=12 THEN 'warm' WHEN (12-t)*24<=120 THEN 'mild' WHEN (12-t)*24<=300 THEN 'cold' ELSE 'extreme' END AS bin FROM ss JOIN sd ON sd.sub_id=ss.sub_id AND sd.day=ss.day WHERE isodow(ss.day)<6)"""


@query("g03_windowed_features", windowed_sql(WHDD_SQL, "wf", "sub_id"))
def g03_features(spark, d):
    """Windowed features of the net load of every substation, from the slots that its targets come from."""
    s = slot_plan(spark, d, member_plan(spark, d)).where(F.weekday("day") < 5)
    long = A.array_windows(s, ["sub_id"], "day", "t", "net_slots", X.SLOTS, 12.0, 120.0, 300.0)
    return checked_features(A.wide_features(long, ["sub_id"]), "sub_id")


@query("a06_guarded_statistics", f"""WITH {X.SQL_OWN}, z AS (SELECT hh, own AS x, {X.sql_temp('hh','day')} AS t FROM own)
SELECT hh, round(CASE WHEN count(x)>=2 THEN stddev_samp(x) END,6) AS std, round(CASE WHEN count(x)>=3 AND stddev_pop(x)>0 THEN skewness(x) END,6) AS skew,
 round(CASE WHEN count(x)>=4 AND stddev_pop(x)>0 THEN kurtosis(x) END,6) AS kurt, round(quantile_cont(x,0.95),6) AS q95, round(CASE WHEN count(x)>=2 THEN covar_samp(x,t) END,6) AS cov,
 round(CASE WHEN count(x)>=3 AND stddev_samp(x)>0 AND stddev_samp(t)>0 THEN corr(x,t) END,6) AS corr FROM z GROUP BY 1""")
def a06(spark, d):
    z = X.daily_own(spark, d).withColumn("t", X.temperature_at(F.col("hh"), F.col("day")))
    return z.groupBy("hh").agg(*[F.round(c, 6).alias(n) for n, c in {
        "std": S.std_guarded("own"), "skew": S.skew_g1("own"), "kurt": S.kurt_g2("own"), "q95": F.percentile("own", 0.95),
        "cov": S.cov_guarded("own", "t"), "corr": S.corr_guarded("own", "t")}.items()])


@query("a07_robust_peak", f"""WITH {X.SQL_SLOT} SELECT channel, CAST(count(kw) AS BIGINT) AS n, round(quantile_cont(kw,0.999),8) AS robust_peak, max(kw) AS peak FROM sl GROUP BY 1""")
def a07(spark, d):
    return rounded(A.robust_peak(X.slots(spark, d), ["channel"], "kw"), "robust_peak")


WIN = A.season_windows(1995, 2001)
WIN_SQL = "win(label, a, b) AS (VALUES " + ", ".join(f"('{n}', DATE '{a}', DATE '{b}')" for n, a, b in WIN) + ")"


@query("a08_window_inventory", f"""WITH {X.SQL_READ}, {WIN_SQL}, c AS (SELECT hh, role, station, label, count(*) AS n FROM rd JOIN win ON day>=a AND day<b GROUP BY 1,2,3,4)
SELECT station, role, label AS win, CAST(count(*) AS BIGINT) AS n_households, CAST(sum(n) AS BIGINT) AS n_readings, CAST(count(*) FILTER (n>=2) AS BIGINT) AS n_covered FROM c GROUP BY 1,2,3""")
def a08(spark, d):
    w = A.in_windows(X.daily_readings(spark, d), "day", WIN).groupBy("hh", "role", "station", "window").agg(F.count("*").alias("n"))
    return w.groupBy("station", "role", F.col("window").alias("win")).agg(F.count("*").alias("n_households"), F.sum("n").alias("n_readings"), F.count_if(F.col("n") >= 2).alias("n_covered"))


@query("a09_multi_season", f"""WITH {X.SQL_READ}, {WIN_SQL}, c AS (SELECT hh, station, label, count(*) AS n FROM rd JOIN win ON day>=a AND day<b WHERE label LIKE 'cal%' GROUP BY 1,2,3),
u AS (SELECT hh, station, count(*) FILTER (n>=2) AS k FROM c GROUP BY 1,2) SELECT station, CAST(count(*) FILTER (k>=2) AS BIGINT) AS n_two, CAST(count(*) FILTER (k>=4) AS BIGINT) AS n_four FROM u GROUP BY 1""")
def a09(spark, d):
    cal = [w for w in WIN if w[0].startswith("cal")]
    c = A.in_windows(X.daily_readings(spark, d), "day", cal).groupBy("hh", "station", "window").agg(F.count("*").alias("n"))
    u = c.groupBy("hh", "station").agg(F.count_if(F.col("n") >= 2).alias("k"))
    return u.groupBy("station").agg(F.count_if(F.col("k") >= 2).alias("n_two"), F.count_if(F.col("k") >= 4).alias("n_four"))


def _line_sql(src, keys):
    return f"""ln_g AS (SELECT {keys}, count(*)::DOUBLE AS n_, sum(x) AS x1, sum(y) AS y1, sum(x*x) AS xx, sum(x*y) AS xy, sum(y*y) AS yy FROM {src} GROUP BY {keys}),
ln_s AS (SELECT *, CASE WHEN n_*xx-x1*x1>1e-9 THEN (n_*xy-x1*y1)/(n_*xx-x1*x1) ELSE 0.0::DOUBLE END AS s0 FROM ln_g),
ln_b AS (SELECT *, CASE WHEN s0<=0 THEN 0.0::DOUBLE WHEN (y1-s0*x1)/n_<0 THEN greatest(0.0::DOUBLE, xy/nullif(xx,0)) ELSE s0 END AS s,
 CASE WHEN s0<=0 THEN greatest(0.0::DOUBLE,y1/n_) WHEN (y1-s0*x1)/n_<0 THEN 0.0::DOUBLE ELSE (y1-s0*x1)/n_ END AS b FROM ln_s),
ln AS (SELECT {keys}, CAST(n_ AS BIGINT) AS n_days, b AS base, s AS slope, CASE WHEN yy-y1*y1/n_>1e-9 THEN 1-(yy-2*b*y1-2*s*xy+n_*b*b+2*b*s*x1+s*s*xx)/(yy-y1*y1/n_) ELSE 0.0::DOUBLE END AS r2 FROM ln_b)"""


@query("a10_time_of_day_slopes", f"""WITH {NET_SQL}, z AS (SELECT channel, day, hour(ts)//6 AS grp, sum(hdh) AS x, avg(y)+2*sum(hdh) AS y FROM n2 GROUP BY 1,2,3), {_line_sql('z','channel, grp')}
SELECT channel, round(max(CASE WHEN grp=0 THEN slope END),8) AS s0, round(max(CASE WHEN grp=1 THEN slope END),8) AS s1, round(max(CASE WHEN grp=2 THEN slope END),8) AS s2, round(max(CASE WHEN grp=3 THEN slope END),8) AS s3 FROM ln GROUP BY 1""")
def a10(spark, d):
    n = net_slots(spark, d).where(F.weekday("ts") < 5)
    z = n.groupBy("channel", F.to_date("ts").alias("day"), (F.floor(F.hour("ts") / 6)).alias("grp")).agg(
        F.sum(F.greatest(F.lit(0.0), 12 - F.col("t"))).alias("x"), F.avg("y").alias("m"))
    f = HG.fit_degree_line(z.withColumn("y", F.col("m") + 2 * F.col("x")), ["channel", "grp"], "x", "y")
    p = f.groupBy("channel").pivot("grp", [0, 1, 2, 3]).agg(F.first("slope"))
    return p.select("channel", *[r8(F.col(str(i))).alias(f"s{i}") for i in range(4)])


@query("a11_station_climate", f"""WITH {X.SQL_ND} SELECT station, CAST(count(*) AS BIGINT) AS n, round(quantile_cont(t,0.05),8) AS T_q05, round(avg(t),8) AS T_mean FROM nd GROUP BY 1""")
def a11(spark, d):
    return rounded(A.climate(X.nation_daily(spark, d), "station", "t"), "T_q05", "T_mean")


@query("a12_group_median_temperature", f"""WITH {X.SQL_READ} SELECT station, day, round(median(t+own/10),8) AS t_group, CAST(count(*) AS BIGINT) AS n FROM rd GROUP BY 1,2""")
def a12(spark, d):
    r = X.daily_readings(spark, d).withColumn("t_home", F.col("t") + F.col("own") / 10)
    return exact_quantiles(r, ["station", "day"], "t_home", {"t_group": 0.5}, cuts=8).select("station", "day", r8("t_group").alias("t_group"), "n")


ORD_P = "o_totalprice AS y, round(o_totalprice*(0.8::DOUBLE+(o_orderkey%7)/15.0::DOUBLE),6) AS p"


def order_predictions(spark, d):
    o = X.table(spark, d, "orders")
    return o.select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus", F.col("o_totalprice").alias("y"),
                    F.round(F.col("o_totalprice") * (0.8 + (F.col("o_orderkey") % 7) / 15.0), 6).alias("p"))


def _metric_sql(extra=""):
    from .sqlparts import metrics
    return ", ".join(f"round({v},4) AS {k}" for k, v in metrics().items())


@query("a13_error_metrics", f"""WITH z AS (SELECT o_orderpriority, {ORD_P} FROM orders) SELECT o_orderpriority, CAST(count(*) AS BIGINT) AS n, {_metric_sql()} FROM z GROUP BY 1""")
def a13(spark, d):
    s = A.score(order_predictions(spark, d), ["o_orderpriority"])
    return s.select("o_orderpriority", "n", *[F.round(c, 4).alias(c) for c in s.columns[2:]])


def _cells_sql():
    from .sqlparts import metrics
    m = metrics()
    un = " UNION ALL ".join(f"SELECT o_orderstatus, cell, n_substations, '{k}' AS metric, round({k},4) AS value FROM g" for k in m)
    return f"""WITH z AS (SELECT o_orderstatus, {ORD_P}, CAST(o_custkey%20 AS DOUBLE) AS n_hp, 20 AS size, (o_custkey%4+1)/10.0::DOUBLE AS pen FROM orders),
b AS (SELECT *, CASE WHEN n_hp/size<=0.15 THEN 'pbin<=15' WHEN n_hp/size<=0.35 THEN 'pbin15-35' WHEN n_hp/size<=0.65 THEN 'pbin35-65' ELSE 'pbin>65' END AS bin, 'p='||CAST(pen AS VARCHAR)||'|size='||size AS cl FROM z),
g AS (SELECT o_orderstatus, coalesce(bin, cl, 'all') AS cell, CAST(count(*) AS BIGINT) AS n_substations, {', '.join(f'{v} AS {k}' for k, v in m.items())} FROM b GROUP BY GROUPING SETS ((o_orderstatus),(o_orderstatus,bin),(o_orderstatus,cl))) {un}"""


@query("a14_metric_cells", _cells_sql())
def a14(spark, d):
    z = (order_predictions(spark, d).withColumn("n_hp", (F.col("o_custkey") % 20).cast("double")).withColumn("size", F.lit(20))
         .withColumn("pen", (F.col("o_custkey") % 4 + 1) / 10.0))
    s = A.score_cells(z, ["o_orderstatus"], "y", "p", "n_hp", "size", "pen")
    return s.withColumn("value", F.round("value", 4))


@query("a15_seed_summary", f"""WITH {X.SQL_OWN}, z AS (SELECT hh, year(day) AS seed, avg(own) AS v FROM own GROUP BY 1,2)
SELECT hh, CAST(count(*) AS BIGINT) AS n, round(median(v),8) AS median, round(avg(v),8) AS mean, round(stddev_samp(v),8) AS sd, round(quantile_cont(v,0.05),8) AS q_lo, round(quantile_cont(v,0.9),8) AS q_hi FROM z GROUP BY 1""")
def a15(spark, d):
    z = X.daily_own(spark, d).groupBy("hh", F.year("day").alias("seed")).agg(F.avg("own").alias("v"))
    return rounded(A.summarise(z, ["hh"], "v"), "median", "mean", "sd", "q_lo", "q_hi")


@query("a20_sample_distances", f"""WITH {X.SQL_READ}, c AS (SELECT station, own AS x, count(*) FILTER (role='hp') AS a, count(*) FILTER (role<>'hp') AS b FROM rd GROUP BY 1,2),
w AS (SELECT *, sum(a) OVER o AS ca, sum(b) OVER o AS cb, lag(x) OVER o AS px, sum(a) OVER t AS na, sum(b) OVER t AS nb FROM c WINDOW o AS (PARTITION BY station ORDER BY x), t AS (PARTITION BY station))
SELECT station, round(max(abs(ca/na::DOUBLE-cb/nb::DOUBLE)),8) AS ks, round(coalesce(sum(abs((ca-a)/na::DOUBLE-(cb-b)/nb::DOUBLE)*(x-px)),0),8) AS w1, CAST(max(na) AS BIGINT) AS n_a, CAST(max(nb) AS BIGINT) AS n_b FROM w GROUP BY 1""")
def a20(spark, d):
    return rounded(A.sample_distances(X.daily_readings(spark, d), ["station"], "own", F.col("role") == "hp"), "ks", "w1")


@query("a21_day_by_time_matrix", f"""WITH {X.SQL_SLOT}, z AS (SELECT hour(ts) AS h, isodow(ts) AS dow, CAST(ts AS DATE) AS day, kw FROM sl)
SELECT CAST(h AS INTEGER) AS hour, {', '.join(f"round(avg(kw) FILTER (day=DATE '2024-01-{i:02d}'),8) AS d{i:02d}" for i in range(1, 31))} FROM z GROUP BY 1""")
def a21(spark, d):
    z = X.slots(spark, d).select(F.hour("ts").alias("hour"), F.date_format("ts", "yyyy-MM-dd").alias("day"), "kw")
    days = [f"2024-01-{i:02d}" for i in range(1, 31)]
    p = z.groupBy("hour").pivot("day", days).agg(F.avg("kw"))
    return p.select("hour", *[r8(F.col(f"`{x}`")).alias(f"d{x[-2:]}") for x in days])


@query("a22_distinct_members", f"WITH {MEMBER_SQL} SELECT seed, split, CAST(count(DISTINCT hh) AS BIGINT) AS n_households FROM me WHERE role='hp' GROUP BY 1,2")
def a22(spark, d):
    # a member list is at most as long as its substation
    return A.distinct_members(K.member_lists(member_plan(spark, d)), ["seed", "split"], "hp_members")


@query("a23_daily_vector", f"""WITH {X.SQL_ND}, s AS (SELECT station, min(day) AS s FROM nd GROUP BY 1),
g AS (SELECT s.station, i, nd.y FROM s CROSS JOIN range(365) AS r(i) LEFT JOIN nd ON nd.station=s.station AND nd.day=CAST(s.s + CAST(i AS INTEGER) AS DATE))
SELECT station, list(round(y,6) ORDER BY i) AS vector FROM g GROUP BY 1""")
def a23(spark, d):
    v = A.daily_vector(X.nation_daily(spark, d), ["station"], "day", "y")
    return v.select("station", F.transform("vector", lambda x: F.round(x, 6)).alias("vector"))


@query("a24_segment_scores", f"""WITH z AS (SELECT o_orderpriority AS seg, {ORD_P} FROM orders), k AS (SELECT seg, sum(y)/sum(p) AS k FROM z GROUP BY 1)
SELECT z.seg AS segment, CAST(count(*) AS BIGINT) AS n, round(sum(abs(p-y))/sum(y)*100,6) AS wape, round(sum(p-y)/sum(y)*100,6) AS bias, round(sum(abs(p*k-y))/sum(y)*100,6) AS wape_rescaled,
 round(sum(y)/sum(sum(y)) OVER (),8) AS share FROM z JOIN k ON z.seg=k.seg GROUP BY 1""")
def a24(spark, d):
    s = A.segment_score(order_predictions(spark, d).withColumnRenamed("o_orderpriority", "segment"), ["segment"], "y", "p")
    return s.select("segment", "n", *[F.round(c, 6).alias(c) for c in ("wape", "bias", "wape_rescaled")], r8("share").alias("share"))
