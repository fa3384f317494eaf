"""Queries over clocks, calendars, gaps, runs and quality rules (P rows)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import holidays as H, timeparts as TP
from ..functions.stats import r8
from ..operators import clean as C, reports as R
from ..sources import tables as X
from .registry import query

GRID_SQL = f"""{X.SQL_HOUR}, gh AS (SELECT u.hh, g.ts FROM (SELECT DISTINCT hh FROM hr) u, (SELECT unnest(generate_series(a_, z_, INTERVAL 1 HOUR)) AS ts FROM {X.SQL_SPAN}) AS g),
gr AS (SELECT gh.hh, gh.ts, hr.kw FROM gh LEFT JOIN hr ON gh.hh=hr.hh AND gh.ts=hr.ts)"""

def easter_table(src: str, day: str = "day") -> str:
    """CTE `hol(day, hol)`: holiday flag of every distinct day of src, Canton of Zurich."""
    return f"""hol_y AS (SELECT DISTINCT CAST(year({day}) AS BIGINT) AS y FROM {src}),
hol_1 AS (SELECT y, y%19 AS a, y//100 AS b, y%100 AS c FROM hol_y), hol_2 AS (SELECT *, (19*a+b-b//4-(b-(b+8)//25+1)//3+15)%30 AS h FROM hol_1),
hol_3 AS (SELECT *, (32+2*(b%4)+2*(c//4)-h-c%4)%7 AS l FROM hol_2), hol_4 AS (SELECT *, h+l-7*((a+11*h+22*l)//451)+114 AS n FROM hol_3),
hol_e AS (SELECT y, make_date(y, n//31, n%31+1) AS easter FROM hol_4),
hol AS (SELECT d.{day} AS day, strftime(d.{day}, '%m-%d') IN ('01-01','05-01','08-01','12-25','12-26')
 OR date_diff('day', easter, d.{day}) IN (-2,1,39,50) AS hol, isodow(d.{day})>=6 AS wend FROM (SELECT DISTINCT {day} FROM {src}) d JOIN hol_e ON year(d.{day})=y)"""


def grid(spark, d):
    return C.complete_grid(X.hourly(spark, d), ["hh"], "ts", *X.span(spark, d)[:2], "1 hour")


@query("p01_clock_conversion", f"""WITH {X.SQL_SLOT}, z AS (SELECT event_id, ts, timezone('Europe/Zurich', timezone('UTC', ts)) AS loc FROM sl)
SELECT event_id, strftime(loc, '%Y-%m-%d %H:%M:%S') AS local_time, strftime(ts, '%Y-%m-%d %H:%M:%S') AS utc_again FROM z""")
def p01(spark, d):
    s = X.slots(spark, d).withColumn("loc", TP.to_local(F.col("ts"), "Europe/Zurich"))
    f = "yyyy-MM-dd HH:mm:ss"
    return s.select("event_id", F.date_format("loc", f).alias("local_time"), F.date_format(TP.to_utc(F.col("loc"), "Europe/Zurich"), f).alias("utc_again"))


@query("p02_temporal_columns", f"""WITH {X.SQL_SLOT}, {easter_table("(SELECT CAST(ts AS DATE) AS day FROM events)")},
z AS (SELECT event_id, ts, hour(ts) AS h, isodow(ts)-1 AS dow, month(ts) AS mo, hour(ts)*60+minute(ts) AS mod_, dayofyear(ts) AS doy, hol FROM sl JOIN hol ON CAST(ts AS DATE)=day)
SELECT event_id, CAST(year(ts) AS INTEGER) AS year, CAST(week(ts) AS INTEGER) AS week, CAST(dow AS INTEGER) AS day_of_week, CAST(mod_ AS INTEGER) AS minute_of_day,
 hol AS public_holiday, dow>=5 AS weekend, h BETWEEN 6 AND 9 AS morning, h BETWEEN 10 AND 13 AS noon, h BETWEEN 18 AND 22 AS evening, (h>=23 OR h<6) AS night,
 CAST((mo%12)//3+1 AS INTEGER) AS season, round(sin(2*pi()*mod_/1440),8) AS time_of_day_sin, round(cos(2*pi()*doy/365),8) AS day_of_year_cos, round(sin(2*pi()*dow/7),8) AS day_of_week_sin FROM z""")
def p02(spark, d):
    t = C.add_temporal(X.slots(spark, d))
    return t.select("event_id", "year", "week", "day_of_week", "minute_of_day", "public_holiday", "weekend", "morning", "noon", "evening", "night", "season",
                    *[r8(c).alias(c) for c in ("time_of_day_sin", "day_of_year_cos", "day_of_week_sin")])


@query("p03_working_day_calendar", f"""WITH o AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1), {easter_table('o')}
SELECT o.day, CAST(n AS BIGINT) AS n_orders, (wend OR hol) AS off_day, hol AS holiday FROM o JOIN hol ON o.day=hol.day""")
def p03(spark, d):
    o = X.table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n_orders"))
    return o.select("day", "n_orders", H.weekend_or_holiday(F.col("day")).alias("off_day"), H.is_holiday(F.col("day")).alias("holiday"))


@query("p04_first_per_stamp", f"""WITH {X.SQL_SLOT}, z AS (SELECT *, date_trunc('hour', ts) AS hour_, row_number() OVER (PARTITION BY hh, date_trunc('hour', ts) ORDER BY event_id) AS rn FROM sl)
SELECT hh, strftime(hour_, '%Y-%m-%d %H') AS hour, event_id, kw, channel FROM z WHERE rn=1""")
def p04(spark, d):
    s = X.slots(spark, d).withColumn("hour", F.date_format("ts", "yyyy-MM-dd HH")).drop("ts")
    return C.dedupe_first(s, ["hh", "hour"], "event_id").select("hh", "hour", "event_id", "kw", "channel")


@query("p05_complete_grid", f"""WITH {GRID_SQL}, z AS (SELECT *, timezone('Europe/London', timezone('UTC', ts)) AS loc FROM gr)
SELECT hh, CAST(loc AS DATE) AS day, CAST(hour(loc) AS INTEGER) AS slot, round(avg(kw),8) AS kw, CAST(count(*) AS BIGINT) AS n_stamps FROM z GROUP BY 1,2,3""")
def p05(spark, d):
    g = C.local_slots(grid(spark, d), "ts", "Europe/London", 60)
    return g.groupBy("hh", "day", "slot").agg(r8(F.avg("kw")).alias("kw"), F.count("*").alias("n_stamps"))


INTERP_SQL = """ip AS (SELECT hh, ts, kw, epoch(ts) AS t, last_value(CASE WHEN kw IS NOT NULL THEN epoch(ts) END IGNORE NULLS) OVER p AS t0, last_value(kw IGNORE NULLS) OVER p AS v0,
 first_value(CASE WHEN kw IS NOT NULL THEN epoch(ts) END IGNORE NULLS) OVER f AS t1, first_value(kw IGNORE NULLS) OVER f AS v1 FROM gr
 WINDOW p AS (PARTITION BY hh ORDER BY ts ROWS UNBOUNDED PRECEDING), f AS (PARTITION BY hh ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


@query("p06_interpolate", f"""WITH {GRID_SQL}, {INTERP_SQL}
SELECT hh, strftime(ts, '%Y-%m-%d %H') AS hour, round(CASE WHEN kw IS NOT NULL THEN kw WHEN v1 IS NULL THEN v0 WHEN v0 IS NULL THEN v1 ELSE v0+(v1-v0)*(t-t0)/(t1-t0) END,8) AS kw,
 round(CASE WHEN kw IS NOT NULL THEN kw WHEN v0 IS NOT NULL AND v1 IS NOT NULL AND least(t-t0,t1-t)<=3*3600 THEN v0+(v1-v0)*(t-t0)/(t1-t0) END,8) AS kw_limit3 FROM ip""")
def p06(spark, d):
    g = C.neighbours(grid(spark, d), ["hh"], "ts", "kw")          # one scan serves both fills
    return g.select("hh", F.date_format("ts", "yyyy-MM-dd HH").alias("hour"), r8(C.line_between("ts", "kw")).alias("kw"),
                    r8(C.line_between("ts", "kw", 3, 3600, False)).alias("kw_limit3"))


@query("p07_unit_conversion", """SELECT event_id, round(value*4,8) AS kw_15min, round(value*2,8) AS kw_30min, round((value-32)*5/9,8) AS celsius, round(value/1000,8) AS kw_from_w FROM events""")
def p07(spark, d):
    v = F.col("kw")
    return X.slots(spark, d).select("event_id", r8(v * 4).alias("kw_15min"), r8(v * 2).alias("kw_30min"), r8((v - 32) * 5 / 9).alias("celsius"), r8(v / 1000).alias("kw_from_w"))


@query("p08_coverage", f"""WITH {X.SQL_HOUR}, dd AS (SELECT hh, CAST(ts AS DATE) AS day, count(*) AS n FROM hr WHERE kw IS NOT NULL GROUP BY 1,2)
SELECT hh, round(sum(n)/{X.SQL_HOURS},8) AS coverage, CAST(count(*) FILTER (n>=0.1*24) AS BIGINT) AS n_valid_days FROM dd GROUP BY 1 HAVING sum(n)/{X.SQL_HOURS}>=0.05""")
def p08(spark, d):
    h = X.hourly(spark, d).withColumn("day", F.to_date("ts"))
    c = C.coverage(h, ["hh"], F.col("kw").isNotNull(), X.span(spark, d)[2], 24, day_share=0.1)
    return c.where("coverage >= 0.05").select("hh", r8("coverage").alias("coverage"), "n_valid_days")


def gap_input(spark, d):
    """Hourly mean per channel, with the hours that had no reading as holes."""
    h = (X.slots(spark, d).groupBy(F.col("channel").alias("hh"), F.date_trunc("hour", "ts").alias("ts"))
         .agg((F.sum(F.col("kw").cast("decimal(18,2)")).cast("double") / F.count("*")).alias("kw")))
    g = C.complete_grid(h, ["hh"], "ts", *X.span(spark, d)[:2], "1 hour")
    day = F.to_date("ts")
    return (g.withColumn("day", day).withColumn("slot", F.hour("ts")).withColumn("t", X.temperature_at(F.length("hh"), day))
            .withColumn("off", H.weekend_or_holiday(day)))


@query("p09_fill_gaps", f"""WITH {X.SQL_SLOT}, h0 AS (SELECT channel AS hh, date_trunc('hour', ts) AS ts, CAST(sum(CAST(kw AS DECIMAL(18,2))) AS DOUBLE)/count(*) AS kw FROM sl GROUP BY 1,2),
gg AS (SELECT u.hh, g.ts FROM (SELECT DISTINCT hh FROM h0) u, (SELECT unnest(generate_series(a_, z_, INTERVAL 1 HOUR)) AS ts FROM {X.SQL_SPAN}) AS g),
gr AS (SELECT gg.hh, gg.ts, h0.kw FROM gg LEFT JOIN h0 ON gg.hh=h0.hh AND gg.ts=h0.ts), {INTERP_SQL}, {easter_table("(SELECT CAST(ts AS DATE) AS day FROM events)")},
v AS (SELECT hh, ts, CAST(ts AS DATE) AS day, hour(ts) AS slot, CASE WHEN kw IS NOT NULL THEN kw WHEN v0 IS NOT NULL AND v1 IS NOT NULL AND (t1-t0)/3600-1<=1 THEN v0+(v1-v0)*(t-t0)/(t1-t0) END AS v FROM ip),
dy AS (SELECT v.hh, v.day, {X.sql_temp('length(v.hh)','v.day')} AS t, any_value(hol OR wend) AS off, count(v)=24 AS full_ FROM v JOIN hol ON v.day=hol.day GROUP BY 1,2,3),
dn AS (SELECT a.hh, a.day, b.day AS src, row_number() OVER (PARTITION BY a.hh, a.day ORDER BY abs(a.t-b.t), b.day) AS rn FROM dy a JOIN dy b ON a.hh=b.hh AND a.off=b.off AND b.full_ AND NOT a.full_),
nb AS (SELECT hh, CAST(count(*) FILTER (NOT full_) AS BIGINT) AS n_donor_days FROM dy GROUP BY 1)
SELECT v.hh, v.day, CAST(v.slot AS INTEGER) AS slot, round(coalesce(v.v, s.v),8) AS filled, n_donor_days FROM v LEFT JOIN dn ON v.hh=dn.hh AND v.day=dn.day AND rn=1
 LEFT JOIN v s ON s.hh=v.hh AND s.day=dn.src AND s.slot=v.slot JOIN nb ON nb.hh=v.hh""")
def p09(spark, d):
    f = C.fill_gaps(gap_input(spark, d), ["hh"], "ts", "kw", "t", "off", max_gap=1, slots_per_day=24)
    return f.select("hh", "day", "slot", r8("filled").alias("filled"), "n_donor_days")


ZERO_SQL = f"""{GRID_SQL}, zz AS (SELECT hh, ts, coalesce(kw,0) AS kw FROM gr), za AS (SELECT *, row_number() OVER (PARTITION BY hh ORDER BY ts) AS rn FROM zz),
zb AS (SELECT *, rn-row_number() OVER (PARTITION BY hh ORDER BY ts) AS isl FROM za WHERE kw=0), zr AS (SELECT hh, isl, count(*) AS len, min(ts) AS s, max(ts) AS e FROM zb GROUP BY 1,2)"""


@query("p10_quality_rules", f"""WITH {ZERO_SQL}, m AS (SELECT hh, max(len) AS z FROM zr GROUP BY 1),
q AS (SELECT g.hh, count(kw)/{X.SQL_HOURS} AS cov, max(kw) AS mx, coalesce(any_value(z),0) AS z FROM gr g LEFT JOIN m ON g.hh=m.hh GROUP BY 1)
SELECT hh, CAST(z AS BIGINT) AS zero_run_max, round(cov,8) AS coverage, cov<0.08 AS low_coverage, mx>300 AS above_max, z>=72 AS long_zero_run,
 CASE WHEN cov<0.08 THEN 'coverage' WHEN mx>300 THEN 'above max' WHEN z>=72 THEN 'zero run' END AS dropped_by FROM q""")
def p10(spark, d):
    g = grid(spark, d)
    z = C.longest_zero_run(g.withColumn("kw", F.coalesce("kw", F.lit(0.0))), ["hh"], "ts", "kw")
    q = g.groupBy("hh").agg((F.count("kw") / F.lit(float(X.span(spark, d)[2]))).alias("coverage"), F.max("kw").alias("mx")).join(z, "hh")
    rules = {"coverage": F.col("coverage") < 0.08, "above max": F.col("mx") > 300, "zero run": F.col("zero_run_max") >= 72}
    return q.select("hh", "zero_run_max", r8("coverage").alias("coverage"), rules["coverage"].alias("low_coverage"), rules["above max"].alias("above_max"),
                    rules["zero run"].alias("long_zero_run"), C.first_failed_rule(rules).alias("dropped_by"))


def power_heat(spark, d):
    """Hourly electricity (zero when silent) and heat (from 'view' readings) of each household."""
    h = X.slots(spark, d).groupBy("hh", F.date_trunc("hour", "ts").alias("ts")).agg(
        F.sum(F.when(F.col("channel") != "view", F.col("kw"))).alias("p"), F.sum(F.when(F.col("channel") == "view", F.col("kw"))).alias("q"))
    g = C.complete_grid(h, ["hh"], "ts", *X.span(spark, d)[:2], "1 hour")
    return g.select("hh", "ts", F.round(F.coalesce("p", F.lit(0.0)), 6).alias("p"), F.round("q", 6).alias("q"), X.temperature_at(F.col("hh"), F.to_date("ts")).alias("t"))


PQ_SQL = f"""{X.SQL_SLOT}, ph AS (SELECT hh, date_trunc('hour', ts) AS ts, sum(kw) FILTER (channel<>'view') AS p, sum(kw) FILTER (channel='view') AS q FROM sl GROUP BY 1,2),
pg AS (SELECT u.hh, g.ts FROM (SELECT DISTINCT hh FROM ph) u, (SELECT unnest(generate_series(a_, z_, INTERVAL 1 HOUR)) AS ts FROM {X.SQL_SPAN}) AS g),
pq AS (SELECT pg.hh, pg.ts, round(coalesce(p,0),6) AS p, round(q,6) AS q, {X.sql_temp('pg.hh', 'pg.ts')} AS t FROM pg LEFT JOIN ph ON pg.hh=ph.hh AND pg.ts=ph.ts)"""


@query("p11_zero_run_dropouts", f"""WITH {PQ_SQL}, a AS (SELECT *, row_number() OVER (PARTITION BY hh ORDER BY ts) AS rn FROM pq),
b AS (SELECT *, rn-row_number() OVER (PARTITION BY hh ORDER BY ts) AS isl FROM a WHERE p=0),
r AS (SELECT hh, isl, min(ts) AS s, max(ts) AS e, count(*) AS len, arg_min(t, ts) AS ts0, max(coalesce(q,0)) AS qm FROM b GROUP BY 1,2),
l AS (SELECT * FROM r WHERE len>=12 AND ts0<12), si AS (SELECT hh, ts FROM pq WHERE q>1 AND p<0.02),
n AS (SELECT DISTINCT l.hh, l.s FROM l JOIN si ON l.hh=si.hh AND si.ts BETWEEN l.s - INTERVAL 24 HOUR AND l.e + INTERVAL 24 HOUR)
SELECT l.hh, strftime(l.s,'%Y-%m-%d %H') AS start, CAST(len AS BIGINT) AS length, round(qm,6) AS heat_max, n.hh IS NOT NULL AS near_silent, (qm>60 OR n.hh IS NOT NULL) AS dropout
FROM l LEFT JOIN n ON l.hh=n.hh AND l.s=n.s""")
def p11(spark, d):
    r = C.zero_run_dropouts(power_heat(spark, d), ["hh"], "ts", "p", "q", "t", 3600, heat_tol=60.0)
    return r.select("hh", F.date_format("start", "yyyy-MM-dd HH").alias("start"), "length", F.round("heat_max", 6).alias("heat_max"), "near_silent", "dropout")


@query("p12_silent_meters", f"""WITH {PQ_SQL} SELECT hh, CAST(count(*) FILTER (q>1) AS BIGINT) AS n_heat, round(count(*) FILTER (q>1 AND p<0.02)/nullif(count(*) FILTER (q>1),0)::DOUBLE,8) AS silent_share,
 round(count(*) FILTER (q>50)/nullif(count(q),0)::DOUBLE,8) AS backup_share FROM pq GROUP BY 1 HAVING count(*) FILTER (q>1 AND p<0.02)/nullif(count(*) FILTER (q>1),0)::DOUBLE>0.05""")
def p12(spark, d):
    s = C.silent_shares(power_heat(spark, d).withColumn("b", F.col("q") / 500.0), ["hh"], "p", "q", "b")
    return s.where("silent_share > 0.05").select("hh", "n_heat", r8("silent_share").alias("silent_share"), r8("backup_share").alias("backup_share"))


@query("p13_counters_to_power", f"""WITH {X.SQL_SLOT}, c AS (SELECT hh, ts, CAST(sum(CAST(kw AS DECIMAL(18,2))) OVER (PARTITION BY hh ORDER BY ts, event_id) AS DOUBLE)/100 AS e FROM sl),
g AS (SELECT hh, date_trunc('hour', ts) AS ts, max(e) AS e FROM c GROUP BY 1,2),
s AS (SELECT *, CASE WHEN epoch(ts)-lag(epoch(ts)) OVER w=3600 THEN e-lag(e) OVER w END AS x FROM g WINDOW w AS (PARTITION BY hh ORDER BY ts)),
f AS (SELECT hh, to_timestamp(floor((epoch(ts)-3600)/86400)*86400) AS bin, CASE WHEN x>=0 AND x<=2.0 THEN x END AS x FROM s)
SELECT hh, CAST(timezone('UTC', bin) AS DATE) AS day, CAST(count(x) AS BIGINT) AS n, round(CASE WHEN count(x)>=2 THEN sum(x)*(60.0::DOUBLE/1440)*24/count(x) END,8) AS kw FROM f GROUP BY 1,2""")
def p13(spark, d):
    s = X.slots(spark, d).withColumn("dec", F.col("kw").cast("decimal(18,2)"))
    cum = C.chunked_scan(s, ["hh"], ["ts", "event_id"], C.time_chunk("ts"), {"cum": ("sum", F.col("dec"))})
    g = cum.groupBy("hh", F.date_trunc("hour", "ts").alias("ts")).agg(F.max(F.col("cum").cast("double") / 100).alias("e"))
    p = C.counters_to_power(g, ["hh"], "ts", "e", 3600, 2.0, bin_minutes=1440, min_n=2, full_n=24)
    return p.select("hh", F.to_date("bin").alias("day"), "n", r8("kw").alias("kw"))


@query("p14_null_hygiene", f"""WITH {GRID_SQL}, e AS (SELECT hh, count(*) AS n, count(kw) AS nv FROM gr GROUP BY 1)
SELECT hh, nv>=60 AS usable, CASE WHEN nv=0 THEN 'no values' WHEN nv<60 THEN 'too few values' END AS reason, CAST(n-nv AS BIGINT) AS n_filled FROM e""")
def p14(spark, d):
    return R.usable_entities(C.null_hygiene(grid(spark, d), ["kw"]), ["hh"], "kw", 60)


@query("p15_plausibility", f"""WITH {X.SQL_SLOT} SELECT hh, CAST(count(*) FILTER (kw NOT BETWEEN -30 AND 40) AS BIGINT) AS n_masked,
 round(avg(CASE WHEN kw BETWEEN -30 AND 40 THEN kw END),8) AS mean_ok, count(*) FILTER (kw NOT BETWEEN -30 AND 40)>0.2*count(*) AS flagged FROM sl GROUP BY 1""")
def p15(spark, d):
    s = X.slots(spark, d).withColumn("ok", C.plausible(F.col("kw")))
    n = F.count("*") - F.count("ok")
    return s.groupBy("hh").agg(n.alias("n_masked"), r8(F.avg("ok")).alias("mean_ok"), (n > 0.2 * F.count("*")).alias("flagged"))


@query("p16_around_visit", f"""WITH {X.SQL_OWN}, v AS (SELECT hh, max(day) AS last_, min(day) AS visit0 FROM own GROUP BY 1), w AS (SELECT hh, CAST(visit0 + INTERVAL 24 MONTH AS DATE) AS visit FROM v),
z AS (SELECT o.hh, own, CASE WHEN day<visit THEN 'before visit' WHEN day>visit THEN 'after visit' ELSE 'during visit' END AS phase FROM own o JOIN w ON o.hh=w.hh
 WHERE day>=CAST(visit - INTERVAL 18 MONTH AS DATE) AND day<=CAST(visit + INTERVAL 12 MONTH AS DATE))
SELECT hh, phase, CAST(count(*) AS BIGINT) AS n, round(sum(own),8) AS own FROM z GROUP BY 1,2""")
def p16(spark, d):
    o = X.daily_own(spark, d)
    v = o.groupBy("hh").agg(F.add_months(F.min("day"), 24).alias("visit"))
    z = C.around_date(o.join(v, "hh"), "day", "visit", 18, 12).withColumn("phase", C.visit_phase(F.col("day"), F.col("visit")))
    return z.groupBy("hh", "phase").agg(F.count("*").alias("n"), r8(F.sum("own")).alias("own"))


@query("p21_window_labels", f"""WITH {X.SQL_SLOT} SELECT event_id, CASE WHEN hour(ts)<6 THEN 'night' WHEN hour(ts)<10 THEN 'morning' WHEN hour(ts)<16 THEN 'day' ELSE 'evening' END AS clock_window,
 CASE WHEN kw-5<=0 THEN 'warm' WHEN kw-5<=10 THEN 'mild' WHEN kw-5<=25 THEN 'cold' ELSE 'extreme' END AS severity, CAST(hour(ts)//6 AS INTEGER) AS hour_group FROM sl""")
def p21(spark, d):
    t = F.col("ts")
    return X.slots(spark, d).select("event_id", TP.clock_window(t).alias("clock_window"), TP.severity_bin(F.col("kw") - 5).alias("severity"), TP.hour_group(t).alias("hour_group"))


@query("p22_sampling_step", f"""WITH {X.SQL_HOUR}, s AS (SELECT hh, epoch(ts)-lag(epoch(ts)) OVER (PARTITION BY hh ORDER BY ts) AS x FROM hr)
SELECT hh, CAST(min(x) AS BIGINT) AS step_seconds, CAST(greatest(4, ceil(20*86400.0/min(x))) AS BIGINT) AS min_points FROM s GROUP BY 1""")
def p22(spark, d):
    s = C.step_seconds_of(X.hourly(spark, d), ["hh"], "ts")
    return s.withColumn("min_points", C.min_points(F.col("step_seconds")))
