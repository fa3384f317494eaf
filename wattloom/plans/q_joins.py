"""Queries over joins, winners, windows and sets (J and W rows), and analog fillers."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import holidays as H
from ..functions.stats import r8
from ..operators import cohorts as K, joins as J, rank as R
from ..session import cut_lineage
from ..sources import tables as X
from . import q_cohorts as C, sqlparts as Q
from .q_clean import easter_table
from .registry import query


# ------------------------------------------------------------------ weather on meter stamps
def quarter_meters(spark, d):
    """Meter stamps on the quarter hour with their station (channel)."""
    return X.slots(spark, d).select("event_id", F.col("channel").alias("station"), F.timestamp_seconds(F.floor(F.unix_timestamp("ts") / 900) * 900).alias("ts"), "kw")


def channel_weather(spark, d):
    """Hourly temperature per channel; hours divisible by 5 are missing."""
    h = X.slots(spark, d).select(F.col("channel").alias("station"), F.date_trunc("hour", "ts").alias("ts")).distinct()
    return h.where(F.hour("ts") % 5 != 0).withColumn("t", X.temperature_at(F.length("station"), F.to_date("ts")) + F.hour("ts") / 7.0)


CW_SQL = f"""cw AS (SELECT st AS station, ts, {X.sql_temp('length(st)', 'ts')}+hour(ts)/7.0::DOUBLE AS t FROM (SELECT DISTINCT event_type AS st, date_trunc('hour', ts) AS ts FROM events) WHERE hour(ts)%5<>0)"""


@query("j01_meter_weather", f"""WITH {CW_SQL}, m AS (SELECT event_id, event_type AS station, ts FROM events) SELECT event_id, round(t,8) AS t FROM m LEFT JOIN cw ON cw.station=m.station AND cw.ts=date_trunc('hour', m.ts)""")
def j01(spark, d):
    j = J.meter_weather(quarter_meters(spark, d), channel_weather(spark, d), "station", "ts", "t", interpolate_hours=False)
    return j.select("event_id", r8("t").alias("t"))


@query("j01_meter_weather_interpolated", f"""WITH {CW_SQL}, q AS (SELECT DISTINCT event_type AS station, to_timestamp(floor(epoch(ts)/900)*900) AS tz FROM events), m AS (SELECT station, timezone('UTC', tz) AS ts FROM q),
gr AS (SELECT m.station, m.ts, t AS v, epoch(m.ts) AS e FROM m LEFT JOIN cw ON cw.station=m.station AND cw.ts=m.ts),
ip AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN e END IGNORE NULLS) OVER p AS t0, last_value(v IGNORE NULLS) OVER p AS v0, first_value(CASE WHEN v IS NOT NULL THEN e END IGNORE NULLS) OVER f AS t1, first_value(v IGNORE NULLS) OVER f AS v1
 FROM gr WINDOW p AS (PARTITION BY station ORDER BY ts ROWS UNBOUNDED PRECEDING), f AS (PARTITION BY station ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT station, strftime(ts,'%Y-%m-%d %H:%M') AS stamp, round(CASE WHEN v IS NOT NULL THEN v WHEN v0 IS NOT NULL AND v1 IS NOT NULL AND least(e-t0,t1-e)<=2700 THEN v0+(v1-v0)*(e-t0)/(t1-t0) END,8) AS t FROM ip""")
def j01_interp(spark, d):
    m = quarter_meters(spark, d).select("station", "ts").distinct()
    j = J.meter_weather(m, channel_weather(spark, d), "station", "ts", "t", key=["station"])
    return j.select("station", F.date_format("ts", "yyyy-MM-dd HH:mm").alias("stamp"), r8("t").alias("t"))


@query("j02_quarter_hour_temperature", f"""WITH {CW_SQL}, g AS (SELECT s.station, x.ts FROM (SELECT DISTINCT station FROM cw) s, (SELECT unnest(generate_series(a_, z_ + INTERVAL 45 MINUTE, INTERVAL 15 MINUTE)) AS ts FROM {X.SQL_SPAN}) AS x),
gr AS (SELECT g.station, g.ts, t AS v, epoch(g.ts) AS e FROM g LEFT JOIN cw ON cw.station=g.station AND cw.ts=g.ts),
ip AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN e END IGNORE NULLS) OVER p AS t0, last_value(v IGNORE NULLS) OVER p AS v0, first_value(CASE WHEN v IS NOT NULL THEN e END IGNORE NULLS) OVER f AS t1, first_value(v IGNORE NULLS) OVER f AS v1
 FROM gr WINDOW p AS (PARTITION BY station ORDER BY ts ROWS UNBOUNDED PRECEDING), f AS (PARTITION BY station ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT station, strftime(ts,'%Y-%m-%d %H:%M') AS stamp, round(CASE WHEN v IS NOT NULL THEN v WHEN v1 IS NULL THEN v0 WHEN v0 IS NULL THEN v1 ELSE v0+(v1-v0)*(e-t0)/(t1-t0) END,8) AS t FROM ip""")
def j02(spark, d):
    first, last, _ = X.span(spark, d)
    g = J.station_grid_temperature(channel_weather(spark, d), "station", "ts", "t", first, last[:14] + "45:00", "15 minutes")
    return g.select("station", F.date_format("ts", "yyyy-MM-dd HH:mm").alias("stamp"), r8("t").alias("t"))


@query("j04_align_load_temperature", f"""WITH {X.SQL_ND}, l AS (SELECT station, day, kw FROM nd), t AS (SELECT DISTINCT station, day, t FROM nd) SELECT l.station, l.day, round(kw,8) AS kw, t FROM l JOIN t ON l.station=t.station AND l.day=t.day WHERE isodow(l.day)<6""")
def j04(spark, d):
    n = X.nation_daily(spark, d)
    t = n.select("station", "day", "t")
    return J.align(n.select("station", "day", "kw"), t, ["station", "day"], "day").select("station", "day", r8("kw").alias("kw"), "t")


# ------------------------------------------------------------------ analog days
def calendar(spark, d):
    """station, day, t, off: every weather day with its day type."""
    return cut_lineage(X.station_temperature(spark, d).withColumn("off", H.weekend_or_holiday(F.col("day"))))


def split_calendar(spark, d):
    c = calendar(spark, d)
    return c.where(F.year("day") == 2000), c.where(F.year("day") != 2000)


AM_SQL = f"""{X.SQL_ST}, {easter_table('stt')}, ca AS (SELECT station, stt.day, t, (hol OR wend) AS off FROM stt JOIN hol ON stt.day=hol.day),
pr AS (SELECT a.station, a.day, b.day AS src, a.t-b.t AS dT, least(abs(dayofyear(a.day)-dayofyear(b.day)), abs(365-abs(dayofyear(a.day)-dayofyear(b.day)))) AS ddoy FROM ca a JOIN ca b ON a.station=b.station AND a.off=b.off AND year(a.day)=2000 AND year(b.day)<>2000 AND abs(date_diff('day',a.day,b.day))>3),
lv AS (SELECT *, CASE WHEN abs(dT)<=1 AND ddoy<=30 THEN 0 WHEN abs(dT)<=1 AND ddoy<=45 THEN 1 WHEN abs(dT)<=1 AND ddoy<=60 THEN 2 WHEN ddoy<=60 THEN 3 END AS widen FROM pr),
lo AS (SELECT *, min(widen) OVER (PARTITION BY station, day) AS mn FROM lv WHERE widen IS NOT NULL),
rk AS (SELECT *, row_number() OVER (PARTITION BY station, day ORDER BY abs(dT), src) AS r FROM lo WHERE widen=mn), k3 AS (SELECT *, count(*) OVER (PARTITION BY station, day) AS n FROM rk WHERE r<=3),
am AS (SELECT station, day, src, dT, ddoy, widen FROM k3 WHERE r={Q.hint('0', "'analog'", 'station', 'day')} % n + 1)"""


def analog_plan(spark, d):
    t, c = split_calendar(spark, d)
    return J.analog_map(t, c, ["station"], 0, exclude_days=3)


@query("j06_analog_days", f"WITH {AM_SQL} SELECT station, day, src, round(dT,8) AS dt_k, CAST(ddoy AS INTEGER) AS ddoy, widen FROM am")
def j06(spark, d):
    return analog_plan(spark, d).select("station", "day", "src", r8("dT").alias("dt_k"), "ddoy", "widen")


@query("g08_analog_filler", f"""WITH {C.MEMBER_SQL}, {C.READ_TAIL}, {AM_SQL}, fs AS (SELECT sub_id, m.station, day AS src, sum(own) AS kw FROM me m JOIN rd ON m.hh=rd.hh WHERE m.role='fill' GROUP BY 1,2,3)
SELECT sub_id, am.day, round(kw,8) AS kw FROM fs JOIN am ON am.station=fs.station AND am.src=fs.src""")
def g08(spark, d):
    m = C.member_plan(spark, d).where("role = 'fill'").select(F.col("sub_id").alias("set_id"), "station", "hh")
    # members are summed per source day before the analog join
    s = m.join(X.daily_own(spark, d), "hh").groupBy("set_id", "station", F.col("day").alias("src")).agg(F.sum("own").alias("kw")).withColumn("slot", F.lit(0))
    return J.place_analogs(s, analog_plan(spark, d), ["station"]).select(F.col("set_id").alias("sub_id"), "day", r8("kw").alias("kw"))


@query("g09_own_fillers", f"""WITH {C.MEMBER_SQL}, dl AS {C.draw_sql('(SELECT * FROM su WHERE size>n_hp)', "'draw|'||sub_id||'|fill'", 'least(size,F)', 'F')},
dx AS (SELECT * FROM dl WHERE NOT EXISTS (SELECT 1 FROM df WHERE df.sub_id=dl.sub_id AND df.pos=dl.pos) QUALIFY row_number() OVER (PARTITION BY sub_id ORDER BY turn)<=n_hp)
SELECT sub_id, CAST(count(*) AS BIGINT) AS n_extra, min(r.hh) AS first_hh, max(r.hh) AS last_hh FROM dx d JOIN rf r ON d.seed=r.seed AND d.split=r.split AND d.fold=r.fold AND d.pos=r.pos GROUP BY 1""")
def g09(spark, d):
    """n_hp extra fillers per substation, disjoint from its own: the next of a longer draw."""
    p = C.pool_plan(spark, d)
    subs = K.substations(K.plan_cells(p, C.SIZES, C.PENS, C.MIN_POOL, C.OVERLAP), C.PER_CELL)
    extra = K.extra_fillers(subs, p)
    return extra.groupBy("sub_id").agg(F.count("*").alias("n_extra"), F.min("hh").alias("first_hh"), F.max("hh").alias("last_hh"))


# ------------------------------------------------------------------ stations
def gappy_stations(spark, d):
    """Daily temperature of the 25 nations on their reading days, with a second set of stations that follow the first one closely."""
    n = X.nation_daily(spark, d)
    days = X.table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    full = days.withColumn("station", F.explode(F.sequence(F.lit(100), F.lit(104)))).withColumn("t", X.temperature_at(F.col("station") % 5, F.col("day")))
    part = n.select("day", "station", (X.temperature_at(F.col("station") % 5, F.col("day")) * 1.1 + 0.5 + F.sin(F.dayofyear("day") * F.col("station")) * F.col("station") / 10).alias("t"))
    return full.unionByName(part)


GS_SQL = f"""{X.SQL_ND}, dd AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders), gs AS (SELECT CAST(s AS INTEGER) AS station, day, {X.sql_temp('(s%5)', 'day')} AS t FROM dd, range(100,105) r(s)
 UNION ALL SELECT station, day, ({X.sql_temp('(station%5)', 'day')})*1.1::DOUBLE+0.5::DOUBLE+sin(dayofyear(day)*station)*station/10.0::DOUBLE FROM nd),
ms AS (SELECT station, 1-count(*)/(SELECT count(DISTINCT day) FROM gs)::DOUBLE AS miss FROM gs GROUP BY 1),
cp AS (SELECT x.station, y.station AS donor, corr(x.t,y.t) AS corr, regr_slope(x.t,y.t) AS b, regr_intercept(x.t,y.t) AS a, count(*) AS n FROM gs x JOIN ms mx ON mx.station=x.station AND mx.miss>0.05 JOIN gs y ON y.day=x.day JOIN ms my ON my.station=y.station AND my.miss<=0.05 GROUP BY 1,2 HAVING count(*)>=60),
bs AS (SELECT *, row_number() OVER (PARTITION BY station ORDER BY corr DESC, donor DESC) AS rn FROM cp)"""


@query("j07_station_donors", f"""WITH {GS_SQL} SELECT m.station, round(miss,8) AS missing_share, donor, round(corr,8) AS corr, round(a,6) AS a, round(b,6) AS b, CAST(n AS BIGINT) AS n_days_fit, CASE WHEN corr>=0.98 THEN 'filled' ELSE 'dropped' END AS action FROM ms m LEFT JOIN bs ON bs.station=m.station AND rn=1 WHERE miss>0.05""")
def j07(spark, d):
    log, _ = J.station_fill(gappy_stations(spark, d))
    return log.select("station", r8("missing_share").alias("missing_share"), "donor", r8("corr").alias("corr"), F.round("a", 6).alias("a"), F.round("b", 6).alias("b"), "n_days_fit", "action")


@query("j07_station_fill", f"""WITH {GS_SQL}, u AS (SELECT * FROM bs WHERE rn=1 AND corr>=0.98) SELECT station, day, round(t,6) AS t, is_filled FROM (SELECT gs.station, day, t, false AS is_filled FROM gs JOIN ms USING (station) WHERE miss<=0.05 OR station IN (SELECT station FROM u)
 UNION ALL SELECT u.station, g.day, a+b*g.t, true FROM u JOIN gs g ON g.station=u.donor WHERE NOT EXISTS (SELECT 1 FROM gs h WHERE h.station=u.station AND h.day=g.day))""")
def j07_fill(spark, d):
    _, f = J.station_fill(gappy_stations(spark, d))
    return f.select("station", "day", F.round("t", 6).alias("t"), "is_filled")


def gappy_slots(spark, d):
    """The same stations by three-hour slots; those with gaps also miss single slots."""
    s = gappy_stations(spark, d).withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(7))))
    s = s.where((F.col("station") >= 100) | ((F.dayofyear("day") * 8 + F.col("slot") + F.col("station")) % 13 != 0))
    return s.withColumn("t", F.col("t") + 2 * F.sin(F.pi() * F.col("slot") / 4))


GL_SQL = f"""{GS_SQL}, gl AS (SELECT station, day, CAST(slot AS INTEGER) AS slot, t+2*sin(pi()*slot/4) AS t FROM gs, range(8) z(slot) WHERE station>=100 OR (dayofyear(day)*8+slot+station)%13<>0),
lm AS (SELECT station, 1-count(*)/(8*(SELECT count(DISTINCT day) FROM gl))::DOUBLE AS miss FROM gl GROUP BY 1), ld AS (SELECT station, day, avg(t) AS t FROM gl GROUP BY 1,2 HAVING count(*)>=6),
lc AS (SELECT x.station, y.station AS donor, corr(x.t,y.t) AS corr, regr_slope(x.t,y.t) AS b, regr_intercept(x.t,y.t) AS a, count(*) AS n FROM ld x JOIN lm mx ON mx.station=x.station AND mx.miss>0.05 JOIN ld y ON y.day=x.day JOIN lm my ON my.station=y.station AND my.miss<=0.05 GROUP BY 1,2 HAVING count(*)>=60),
lb AS (SELECT * FROM lc QUALIFY row_number() OVER (PARTITION BY station ORDER BY corr DESC, donor DESC)=1),
la AS (SELECT lb.station, g.day, g.slot, a+b*g.t AS t FROM lb JOIN gl g ON g.station=lb.donor WHERE corr>=0.98 AND NOT EXISTS (SELECT 1 FROM gl h WHERE h.station=lb.station AND h.day=g.day AND h.slot=g.slot))"""


@query("j07_slot_fill_log", f"""WITH {GL_SQL} SELECT m.station, round(miss,8) AS missing_share, donor, round(corr,8) AS corr, round(a,6) AS a, round(b,6) AS b, CAST(n AS BIGINT) AS n_days_fit,
 CASE WHEN corr>=0.98 THEN 'filled' ELSE 'dropped' END AS action, CASE WHEN corr>=0.98 THEN (SELECT count(*) FROM la WHERE la.station=m.station) END AS n_bins_filled FROM lm m LEFT JOIN lb ON lb.station=m.station WHERE miss>0.05""")
def j07_slots(spark, d):
    log, _ = J.slot_station_fill(gappy_slots(spark, d), 8, 6)
    return log.select("station", r8("missing_share").alias("missing_share"), "donor", r8("corr").alias("corr"), F.round("a", 6).alias("a"), F.round("b", 6).alias("b"), "n_days_fit", "action", "n_bins_filled")


@query("j07_slot_fill", f"""WITH {GL_SQL} SELECT station, day, slot, round(t,6) AS t, is_filled FROM (SELECT *, false AS is_filled FROM gl WHERE station NOT IN (SELECT m.station FROM lm m LEFT JOIN lb ON lb.station=m.station WHERE miss>0.05 AND NOT coalesce(corr>=0.98, false))
 UNION ALL SELECT *, true FROM la)""")
def j07_slot_values(spark, d):
    _, f = J.slot_station_fill(gappy_slots(spark, d), 8, 6)
    return f.select("station", "day", "slot", F.round("t", 6).alias("t"), "is_filled")


@query("j08_weather_groups", f"""WITH RECURSIVE {X.SQL_ND}, d AS (SELECT station AS home, day, {X.sql_temp('(station % 4)', 'day')} AS t FROM nd), n AS (SELECT home, count(*) AS n FROM d GROUP BY 1),
pr AS (SELECT a.home AS h, b.home AS r, median(abs(a.t-b.t)) AS med FROM d a JOIN d b ON a.day=b.day AND b.home<a.home GROUP BY 1,2), near AS (SELECT h, list(r) AS rs FROM pr WHERE med<0.2 GROUP BY 1),
o AS (SELECT home, row_number() OVER (ORDER BY home) AS i, coalesce(rs, []) AS rs FROM n LEFT JOIN near ON h=home WHERE n>=30),
rec AS (SELECT i, home, [home] AS leaders, home AS leader FROM o WHERE i=1
 UNION ALL SELECT i, home, CASE WHEN f IS NULL THEN list_append(leaders, home) ELSE leaders END, coalesce(f, home) FROM (SELECT o.i, o.home, leaders, list_filter(leaders, lambda x: list_contains(o.rs, x))[1] AS f FROM rec JOIN o ON o.i=rec.i+1)),
g AS (SELECT leader, row_number() OVER (ORDER BY leader)-1 AS k FROM (SELECT DISTINCT leader FROM rec))
SELECT home, 'G'||lpad(CAST(k AS VARCHAR),3,'0') AS grp FROM rec JOIN g USING (leader) UNION ALL SELECT home, 'G_none' FROM n WHERE n<30""")
def j08(spark, d):
    """Greedy groups of the nations' temperature series."""
    n = X.nation_daily(spark, d).select(F.col("station").alias("home"), "day", X.temperature_at(F.col("station") % 4, F.col("day")).alias("t"))
    return J.weather_groups(n)


@query("j09_compare_tables", """WITH a AS (SELECT o_custkey AS k, avg(o_totalprice)/99991.0 AS x, CASE WHEN o_custkey%7=0 THEN NULL ELSE count(*) END::DOUBLE AS y FROM orders GROUP BY 1), b AS (SELECT o_custkey AS k, avg(o_totalprice)/99991.0 AS x, count(*)::DOUBLE AS y FROM orders WHERE o_orderstatus='F' GROUP BY 1),
j AS (SELECT a.k AS ak, b.k AS bk, a.x AS ax, b.x AS bx, a.y AS ay, b.y AS by_ FROM a FULL JOIN b ON a.k=b.k), l AS (SELECT 'x' AS c, ak, bk, ax AS p, bx AS q FROM j UNION ALL SELECT 'y', ak, bk, ay, by_ FROM j)
SELECT c AS "column", CAST(count(*) FILTER (bk IS NULL) AS BIGINT) AS left_only, CAST(count(*) FILTER (ak IS NULL) AS BIGINT) AS right_only, round(max(CASE WHEN ak=bk THEN abs(p-q) END),10) AS max_abs, CAST(count(*) FILTER (ak=bk AND (p IS NULL)<>(q IS NULL)) AS BIGINT) AS null_mismatch, false AS ok FROM l GROUP BY 1""")
def j09(spark, d):
    o = X.table(spark, d, "orders")
    g = lambda t: t.groupBy(F.col("o_custkey").alias("k")).agg((F.avg("o_totalprice") / X.KW).alias("x"), F.count("*").cast("double").alias("y"))
    a, b = g(o).withColumn("y", F.when(F.col("k") % 7 != 0, F.col("y"))), g(o.where("o_orderstatus = 'F'"))
    return J.compare_tables(a, b, ["k"], ["x", "y"], 1e-9).select("column", "left_only", "right_only", F.round("max_abs", 10).alias("max_abs"), "null_mismatch", "ok")


@query("j10_left_only", "SELECT c_custkey AS hh, c_mktsegment AS segment FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey=c_custkey AND o_orderstatus='P')")
def j10(spark, d):
    o = X.table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("hh"))
    return X.table(spark, d, "customer").select(F.col("c_custkey").alias("hh"), F.col("c_mktsegment").alias("segment")).join(o, "hh", "left_anti")


@query("j11_station_identity", f"""WITH {X.SQL_ND}, a AS (SELECT day, max(t) AS t FROM nd WHERE station<13 GROUP BY 1), b AS (SELECT day, max(t) AS t FROM nd WHERE station>=13 GROUP BY 1)
SELECT CAST(count(*) AS BIGINT) AS n_overlap, round(max(abs(a.t-b.t)),8) AS max_abs_diff, round(avg(CASE WHEN a.t=b.t THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END),8) AS share_identical FROM a JOIN b USING (day)""")
def j11(spark, d):
    n = X.nation_daily(spark, d)
    side = lambda c: n.where(c).groupBy("day").agg(F.max("t").alias("t"))
    return J.series_identity(side("station < 13"), side("station >= 13"), ["day"], "t").select("n_overlap", r8("max_abs_diff").alias("max_abs_diff"), r8("share_identical").alias("share_identical"))


@query("j12_calendar_alignment", f"""WITH {X.SQL_ND} SELECT a.station, a.day, b.day AS src_day, round(b.y,8) AS src_value FROM nd a LEFT JOIN nd b ON a.station=b.station AND strftime(a.day,'%m-%d')=strftime(b.day,'%m-%d') AND year(b.day)=year(a.day)-1""")
def j12(spark, d):
    n = X.nation_daily(spark, d)
    src = n.withColumn("yr", F.year("day") + 1)
    return J.same_calendar_day(src, n.withColumn("yr", F.year("day")), "day", ["station", "yr"], "y").select("station", "day", "src_day", r8("src_value").alias("src_value"))


SPEC_SQL = "sp_ AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS seed, o_orderpriority AS spec, avg(o_totalprice)/99991.0 AS wape FROM orders GROUP BY 1,2), sr_ AS (SELECT seed, spec, wape FROM (SELECT CAST(year(o_orderdate) AS INTEGER) AS seed, o_orderpriority AS spec, avg(o_totalprice)/99991.0 AS wape FROM orders WHERE o_orderstatus='F' GROUP BY 1,2))"


def spec_rows(spark, d, cond="true"):
    o = X.table(spark, d, "orders").where(cond)
    return o.groupBy(F.year("o_orderdate").alias("seed"), F.col("o_orderpriority").alias("spec")).agg((F.avg("o_totalprice") / X.KW).alias("wape"))


@query("j13_degradation", f"WITH {SPEC_SQL} SELECT a.seed, a.spec, round(a.wape,8) AS wape, round(a.wape-b.wape,8) AS delta, b.spec IS NOT NULL AS unique_ref FROM sp_ a LEFT JOIN sr_ b ON a.seed=b.seed AND a.spec=b.spec")
def j13(spark, d):
    j = J.degradation(spec_rows(spark, d), spec_rows(spark, d, "o_orderstatus = 'F'"), ["seed", "spec"], "wape")
    return j.select("seed", "spec", r8("wape").alias("wape"), r8("delta").alias("delta"), "unique_ref")


@query("j14_household_overlap", f"WITH {C.MEMBER_SQL} SELECT CAST(count(*) AS BIGINT) AS n_shared FROM (SELECT seed, hh FROM me WHERE split='train' INTERSECT SELECT seed, hh FROM me WHERE split='test')")
def j14(spark, d):
    return J.household_overlap(C.member_plan(spark, d), "split", "train", "test").agg(F.count("*").alias("n_shared"))


# ------------------------------------------------------------------ winners and windows
def candidates(spark, d):
    """Experiment rows: unit = year, family = priority, configuration = part brand of the line, error = mean discount."""
    l, p, o = X.table(spark, d, "lineitem"), X.table(spark, d, "part"), X.table(spark, d, "orders")
    j = l.join(p, l.l_partkey == p.p_partkey).join(o, l.l_orderkey == o.o_orderkey)
    return j.groupBy(F.year("o_orderdate").alias("unit"), F.col("o_orderpriority").alias("family"), F.col("p_brand").alias("config")).agg(
        (F.avg("l_extendedprice") / X.KW).alias("cv"), (F.avg("l_quantity") / 7.003).alias("test"))


CAND_SQL = "ca AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS unit, o_orderpriority AS family, p_brand AS config, avg(l_extendedprice)/99991.0 AS cv, avg(l_quantity)/7.003::DOUBLE AS test FROM lineitem JOIN part ON l_partkey=p_partkey JOIN orders ON l_orderkey=o_orderkey GROUP BY 1,2,3)"


@query("w03_family_winners", f"WITH {CAND_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY unit, family ORDER BY cv, config) AS rn FROM ca) SELECT unit, family, config, round(cv,8) AS cv, round(test,8) AS test FROM r WHERE rn=1")
def w03(spark, d):
    w = R.family_winners(candidates(spark, d), ["unit", "family"], "cv", F.col("config"))
    return w.select("unit", "family", "config", r8("cv").alias("cv"), r8("test").alias("test"))


@query("w03_median_winners", f"WITH {CAND_SQL}, m AS (SELECT family, config, median(cv) AS med, count(DISTINCT unit) AS n FROM ca GROUP BY 1,2), e AS (SELECT *, max(n) OVER (PARTITION BY family) AS mx FROM m), r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY med, config) AS rn FROM e WHERE n>=0.8*mx) SELECT family, config, round(med,8) AS median, CAST(n AS BIGINT) AS n_units FROM r WHERE rn=1")
def w03_median(spark, d):
    return R.median_winners(candidates(spark, d), ["family"], "config", "unit", "cv").select("family", "config", r8("median").alias("median"), "n_units")


@query("w04_best_reference", f"WITH {CAND_SQL}, m AS (SELECT unit, config, median(test) AS med FROM ca GROUP BY 1,2), r AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY med, config) AS rn FROM m) SELECT unit, config, round(med,8) AS median FROM r WHERE rn=1")
def w04(spark, d):
    return R.best_reference(candidates(spark, d), ["unit"], "config", "test").select("unit", "config", r8("median").alias("median"))


@query("w05_busy_time", """WITH i AS (SELECT event_type AS grp, CAST(floor(epoch(ts)) AS BIGINT) AS s, CAST(floor(epoch(ts)) AS BIGINT)+CAST(floor(value*60) AS BIGINT) AS e FROM events), p AS (SELECT grp, s, max(e) AS e FROM i GROUP BY 1,2),
m AS (SELECT *, max(e) OVER (PARTITION BY grp ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM p), k AS (SELECT *, sum(CASE WHEN pm IS NULL OR s>pm THEN 1 ELSE 0 END) OVER (PARTITION BY grp ORDER BY s) AS isl FROM m), g AS (SELECT grp, isl, min(s) AS a, max(e) AS b FROM k GROUP BY 1,2)
SELECT grp, CAST(sum(b-a) AS BIGINT) AS busy_seconds FROM g GROUP BY 1""")
def w05(spark, d):
    s = X.slots(spark, d).select(F.col("channel").alias("grp"), F.date_trunc("second", "ts").alias("a"), (F.floor(F.col("kw") * 60)).alias("len"))
    i = s.withColumn("b", F.timestamp_seconds(F.unix_timestamp("a") + F.col("len")))
    return R.union_length(i, ["grp"], "a", "b", F.floor(F.unix_timestamp("a") / 86400)).select("grp", "busy_seconds")


@query("w06_first_last_metadata", """WITH m AS (SELECT o_custkey AS hh, CAST(o_orderdate AS DATE) AS day, CASE WHEN o_orderkey%3=0 THEN NULL ELSE o_orderpriority END AS a, o_orderstatus AS b, o_orderkey AS k FROM orders), u AS (SELECT hh, day, min(a) AS a, max(b) AS b FROM m GROUP BY 1,2)
SELECT hh, coalesce((arg_min(a,day) FILTER (year(day)=1998 AND a IS NOT NULL)), arg_min(a,day) FILTER (a IS NOT NULL)) AS a_start, coalesce(arg_min(b,day) FILTER (year(day)=1998), arg_min(b,day)) AS b_start, arg_max(b,day) FILTER (year(day)=1998) AS b_end FROM u GROUP BY 1""")
def w06(spark, d):
    from ..sources.readers import first_and_last
    o = X.table(spark, d, "orders")
    m = o.select(F.col("o_custkey").alias("hh"), F.to_date("o_orderdate").alias("day"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")).alias("a"), F.col("o_orderstatus").alias("b"))
    u = m.groupBy("hh", "day").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    a = first_and_last(u.where("a IS NOT NULL"), "hh", "day", "1998-01-01", "1998-12-31", ["a"])[0]
    s, e = first_and_last(u, "hh", "day", "1998-01-01", "1998-12-31", ["b"])
    return s.withColumnRenamed("b", "b_start").join(e.withColumnRenamed("b", "b_end"), "hh").join(a.withColumnRenamed("a", "a_start"), "hh", "left")


STARTS = [f"{y}-{m:02d}-01" for y in (1997, 1998, 1999) for m in (1, 4, 7, 10)]


@query("w07_window_choice", f"""WITH {X.SQL_OWN}, st(s) AS (VALUES {', '.join(f"(DATE '{s}')" for s in STARTS)}), n AS (SELECT hh, s, count(*) AS n FROM own JOIN st ON day>=s AND day<CAST(s + INTERVAL 12 MONTH AS DATE) GROUP BY 1,2)
SELECT strftime(s,'%Y-%m-%d') AS start, CAST(count(*) FILTER (n>=2) AS BIGINT) AS n_homes FROM n GROUP BY 1 ORDER BY n_homes DESC, start LIMIT 1""")
def w07(spark, d):
    return R.best_window(R.window_choice(X.daily_own(spark, d), "hh", "day", STARTS, 12, 2))


@query("w09_one_se_rule", f"WITH {CAND_SQL}, c AS (SELECT family, unit-1994 AS k, avg(cv) AS m, stddev_samp(cv)/sqrt(count(*)) AS se FROM ca GROUP BY 1,2), b AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY m, k) AS rn FROM c) SELECT c.family, min(c.k) AS k_1se, any_value(b.k) AS k_best, round(any_value(b.m),8) AS best_error FROM c JOIN b ON c.family=b.family AND rn=1 WHERE c.m<=b.m+b.se GROUP BY 1")
def w09(spark, d):
    c = candidates(spark, d).groupBy("family", (F.col("unit") - 1994).alias("k")).agg(F.avg("cv").alias("m"), (F.stddev_samp("cv") / F.sqrt(F.count("*").cast("double"))).alias("se"))
    return R.one_se(c, ["family"], "k", "m", "se").select("family", "k_1se", "k_best", r8("best_error").alias("best_error"))


@query("w10_runs", f"""WITH z AS (SELECT c_nationkey AS st, CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders JOIN customer ON o_custkey=c_custkey GROUP BY 1,2), a AS (SELECT *, row_number() OVER (PARTITION BY st ORDER BY day) AS rn FROM z), b AS (SELECT *, rn-row_number() OVER (PARTITION BY st ORDER BY day) AS isl FROM a WHERE n=1)
SELECT st, min(day) AS start, max(day) AS "end", CAST(count(*) AS BIGINT) AS length FROM b GROUP BY st, isl""")
def w10(spark, d):
    from ..operators.clean import runs
    o, c = X.table(spark, d, "orders"), X.table(spark, d, "customer")
    z = o.join(c, o.o_custkey == c.c_custkey).groupBy(F.col("c_nationkey").alias("st"), F.to_date("o_orderdate").cast("timestamp").alias("day")).agg(F.count("*").alias("n"))
    r = runs(z, ["st"], "day", F.col("n") == 1, chunk_seconds=90 * 86400)
    return r.select("st", F.to_date("start").alias("start"), F.to_date("end").alias("end"), "length")


@query("w11_set_operations", """WITH a AS (SELECT DISTINCT o_custkey AS hh FROM orders WHERE year(o_orderdate)=1997), b AS (SELECT DISTINCT o_custkey AS hh FROM orders WHERE year(o_orderdate)=1998)
SELECT 'both' AS kind, CAST(count(*) AS BIGINT) AS n FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'either', CAST(count(*) AS BIGINT) FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'first only', CAST(count(*) AS BIGINT) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""")
def w11(spark, d):
    o = X.table(spark, d, "orders")
    y = lambda n: o.where(F.year("o_orderdate") == n).select(F.col("o_custkey").alias("hh")).distinct()
    a, b = y(1997), y(1998)
    n = lambda x, k: x.agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n")
    return n(a.intersect(b), "both").unionByName(n(a.union(b).distinct(), "either")).unionByName(n(a.exceptAll(b), "first only"))


@query("w12_top_readings", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def w12(spark, d):
    return X.table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)
