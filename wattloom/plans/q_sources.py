"""Queries over scans, sinks, metadata and reports (S rows, P17-P20)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.stats import r8
from ..operators import reports as R
from ..session import cut_lineage, scratch
from ..sources import readers as D, tables as X
from .registry import query


# ------------------------------------------------------------------ files derived from the tables, then read back
def meter_files(spark, d):
    """Daily household files in the meter layout; every fifth row appears twice, as overlapping exports do."""
    r = X.daily_readings(spark, d)
    m = r.select(F.col("hh").alias("Household_ID"), F.date_format("day", "yyyy-MM-dd HH:mm:ss").alias("Timestamp"), F.round(F.col("own") + F.col("hp"), 4).alias("kWh_received_Total"),
                 F.when(F.col("role") == "hp", F.round("hp", 4)).alias("kWh_received_HeatPump"), F.round("own", 4).alias("kWh_received_Other"))
    path = scratch(spark, "meters")
    twice = m.where("Household_ID % 5 = 0")
    m.unionByName(twice).write.option("sep", ";").option("header", True).csv(f"{path}/daily")
    return path


@query("s01_household_meters", f"""WITH {X.SQL_READ} SELECT hh AS household, day, round(own+hp,4) AS total, CASE WHEN role='hp' THEN round(hp,4) END AS heat_pump, round(own,4) AS other FROM rd""")
def s01(spark, d):
    m = D.read_meters(spark, meter_files(spark, d), "daily")
    return m.select(F.col("Household_ID").alias("household"), F.to_date("Timestamp").alias("day"), F.col("kWh_received_Total").alias("total"),
                    F.col("kWh_received_HeatPump").alias("heat_pump"), F.col("kWh_received_Other").alias("other"))


@query("s02_fused_weather", f"""WITH h AS (SELECT event_type AS st, date_trunc('hour', ts) AS ts, round(avg(value)/0.99991::DOUBLE,5) AS th FROM events GROUP BY 1,2), d AS (SELECT event_type AS st, CAST(ts AS DATE) AS day, round(avg(value)/0.99991::DOUBLE,5) AS td FROM events GROUP BY 1,2)
SELECT h.st AS station, strftime(h.ts,'%Y-%m-%d %H') AS hour, th, td FROM h LEFT JOIN d ON h.st=d.st AND CAST(h.ts AS DATE)=d.day""")
def s02(spark, d):
    s, path = X.slots(spark, d), scratch(spark, "weather")
    w = lambda unit, name: (s.groupBy(F.col("channel").alias("Weather_ID"), F.date_format(F.date_trunc(unit, "ts"), "yyyy-MM-dd HH:mm:ss").alias("Timestamp"))
                            .agg(F.round(F.avg("kw") / 0.99991, 5).alias(name)))
    w("hour", "Temperature_avg_hourly").write.option("sep", ";").option("header", True).csv(f"{path}/hourly")
    w("day", "Temperature_avg_daily").write.option("sep", ";").option("header", True).csv(f"{path}/daily")
    f = D.read_weather(spark, path, "fused")
    return f.select(F.col("Weather_ID").alias("station"), F.date_format("Timestamp", "yyyy-MM-dd HH").alias("hour"), F.col("Temperature_avg_hourly").alias("th"), F.col("Temperature_avg_daily").alias("td"))


@query("s02_weather_of_households", f"""WITH {X.SQL_HH}, {X.SQL_ST} SELECT hh, h.station, CAST(count(*) AS BIGINT) AS n_days, round(avg(t),8) AS t_mean FROM hh h JOIN stt USING (station) GROUP BY 1,2""")
def s02_households(spark, d):
    h = X.households(spark, d).select(F.col("hh").alias("Household_ID"), F.col("station").alias("Weather_ID"))
    # one summary per station first: a station's rows are not repeated for each of its households
    w = X.station_temperature(spark, d).groupBy(F.col("station").alias("Weather_ID")).agg(F.count("*").alias("n_days"), r8(F.avg("t")).alias("t_mean"))
    return D.weather_of_households(w, h, h).select(F.col("Household_ID").alias("hh"), F.col("Weather_ID").alias("station"), "n_days", "t_mean")


@query("s03_metadata_merge", """WITH m AS (SELECT c_custkey AS id, c_mktsegment AS segment FROM customer), o AS (SELECT o_custkey AS id, CAST(count(*) AS BIGINT) AS n_reports, min(CAST(o_orderdate AS DATE)) AS first_visit FROM orders GROUP BY 1)
SELECT coalesce(m.id,o.id) AS id, segment, n_reports, first_visit, m.id IS NOT NULL AS has_meta, o.id IS NOT NULL AS has_report FROM m FULL JOIN o ON m.id=o.id""")
def s03(spark, d):
    m = X.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"), F.lit(True).alias("a"))
    o = X.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("n_reports"), F.to_date(F.min("o_orderdate")).alias("first_visit")).withColumn("b", F.lit(True))
    j = D.merge_metadata(m, o, "id")
    return j.select("id", "segment", "n_reports", "first_visit", F.coalesce("a", F.lit(False)).alias("has_meta"), F.coalesce("b", F.lit(False)).alias("has_report"))


@query("s03_variable_descriptions", """WITH u AS (SELECT p_type AS variable, 'part '||min(p_brand) AS description, 0 AS pr FROM part GROUP BY 1 UNION ALL SELECT o_orderpriority, 'priority '||min(o_orderstatus), 1 FROM orders GROUP BY 1 UNION ALL SELECT c_mktsegment, 'segment', 2 FROM customer GROUP BY 1 UNION ALL SELECT p_type, 'again', 2 FROM part GROUP BY 1)
SELECT variable, description FROM (SELECT *, row_number() OVER (PARTITION BY variable ORDER BY pr) AS rn FROM u) WHERE rn=1""")
def s03_describe(spark, d):
    p, o, c = (X.table(spark, d, n) for n in ("part", "orders", "customer"))
    a = p.groupBy(F.col("p_type").alias("variable")).agg(F.concat(F.lit("part "), F.min("p_brand")).alias("description"))
    b = o.groupBy(F.col("o_orderpriority").alias("variable")).agg(F.concat(F.lit("priority "), F.min("o_orderstatus")).alias("description"))
    s = c.select(F.col("c_mktsegment").alias("variable")).distinct().withColumn("description", F.lit("segment"))
    t = p.select(F.col("p_type").alias("variable")).distinct().withColumn("description", F.lit("again"))
    return R.describe_variable([a, b, s.unionByName(t)])


@query("s04_available_variables", """WITH m AS (SELECT s_nationkey AS st, max(s_acctbal)>5000 AS a, min(s_acctbal)<1000 AS b, count(*)>=4 AS c FROM supplier GROUP BY 1)
SELECT st, v AS variable FROM (SELECT st, 'rain' AS v, a AS ok FROM m UNION ALL SELECT st, 'sun', b FROM m UNION ALL SELECT st, 'wind', c FROM m) WHERE ok""")
def s04(spark, d):
    m = X.table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("st")).agg((F.max("s_acctbal") > 5000).alias("rain"), (F.min("s_acctbal") < 1000).alias("sun"), (F.count("*") >= 4).alias("wind"))
    return R.available_variables(m, "st")


@query("s05_missing_data_files", "SELECT c_custkey AS hh FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate>=TIMESTAMP '2001-01-01')")
def s05(spark, d):
    o = X.table(spark, d, "orders").where(F.col("o_orderdate") >= F.lit("2001-01-01").cast("timestamp_ntz")).select(F.col("o_custkey").alias("hh"))
    return R.missing_ids(X.table(spark, d, "customer").select(F.col("c_custkey").alias("hh")), o, "hh")


@query("s06_utility_meters", f"""WITH {X.SQL_SLOT}, f AS (SELECT * FROM (SELECT hh, date_trunc('hour', ts) AS ts, kw, row_number() OVER (PARTITION BY hh, date_trunc('hour', ts) ORDER BY event_id) AS rn FROM sl) WHERE rn=1),
k AS (SELECT hh FROM f GROUP BY 1 HAVING count(*)/{X.SQL_HOURS}>=0.09), g AS (SELECT k.hh, x.ts FROM k, (SELECT unnest(generate_series(a_, z_, INTERVAL 1 HOUR)) AS ts FROM {X.SQL_SPAN}) AS x), gr AS (SELECT g.hh, g.ts, f.kw FROM g LEFT JOIN f ON f.hh=g.hh AND f.ts=g.ts),
ip AS (SELECT hh, ts, kw, epoch(ts) AS t, last_value(CASE WHEN kw IS NOT NULL THEN epoch(ts) END IGNORE NULLS) OVER p AS t0, last_value(kw IGNORE NULLS) OVER p AS v0, first_value(CASE WHEN kw IS NOT NULL THEN epoch(ts) END IGNORE NULLS) OVER f_ AS t1, first_value(kw IGNORE NULLS) OVER f_ AS v1
 FROM gr WINDOW p AS (PARTITION BY hh ORDER BY ts ROWS UNBOUNDED PRECEDING), f_ AS (PARTITION BY hh ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT hh, strftime(ts,'%Y-%m-%d %H') AS hour, round(4/0.99991::DOUBLE*CASE WHEN kw IS NOT NULL THEN kw WHEN v1 IS NULL THEN v0 WHEN v0 IS NULL THEN v1 ELSE v0+(v1-v0)*(t-t0)/(t1-t0) END,7) AS kw FROM ip""")
def s06(spark, d):
    s = X.slots(spark, d).withColumn("ts", F.date_trunc("hour", "ts")).select("hh", "ts", "kw", "event_id")
    u = D.utility_meters(s, ["hh"], "ts", "kw", "event_id", *X.span(spark, d)[:2], "1 hour", X.span(spark, d)[2], 0.09, 4 / 0.99991)
    return u.select("hh", F.date_format("ts", "yyyy-MM-dd HH").alias("hour"), F.round("kw", 7).alias("kw"))


@query("s07_submetered_houses", """WITH z AS (SELECT user_id AS house, CAST(floor(epoch(ts)/900)*900 AS BIGINT) AS e, value/1000 AS k, CASE WHEN event_type IN ('view','click') THEN 'HEATPUMP' ELSE 'HOUSEHOLD' END AS ch FROM events)
SELECT house, e AS epoch, round(avg(k) FILTER (ch='HEATPUMP'),8) AS hp_kw, round(avg(k) FILTER (ch='HOUSEHOLD'),8) AS other_kw FROM z GROUP BY 1,2""")
def s07(spark, d):
    e = X.slots(spark, d).select(F.col("hh").alias("house"), (F.floor(F.unix_timestamp("ts") / 900) * 900).alias("index"), F.col("kw").alias("P_TOT"), "channel")
    e = e.withColumn("channel", F.when(F.col("channel").isin("view", "click"), "HEATPUMP").otherwise("HOUSEHOLD"))
    u = D.submetered([e.where("house < 75"), e.where("house >= 75")], "house", "index", "P_TOT", "channel")
    return u.select("house", F.unix_timestamp("ts").alias("epoch"), r8("hp_kw").alias("hp_kw"), r8("other_kw").alias("other_kw"))


@query("s08_wide_to_long", "SELECT CAST(o_orderdate AS DATE) AS day, o_orderpriority AS hh, round(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE)/99991.0,8) AS kwh FROM orders GROUP BY 1,2")
def s08(spark, d):
    o = X.table(spark, d, "orders")
    names = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    wide = o.groupBy(F.to_date("o_orderdate").alias("day")).pivot("o_orderpriority", names).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double") / X.KW)
    return D.wide_to_long(wide, "day").select("day", "hh", r8("kwh").alias("kwh"))


@query("s09_channel_scan", "SELECT l_suppkey, CAST(l_shipdate AS DATE) AS day, l_quantity, l_discount FROM lineitem WHERE l_shipdate>=TIMESTAMP '1996-01-01' AND l_shipdate<TIMESTAMP '1997-01-01'")
def s09(spark, d):
    s = spark.read.parquet(f"{d}/lineitem.parquet").select("l_suppkey", "l_shipdate", "l_quantity", "l_discount")
    s = s.where((F.col("l_shipdate") >= F.lit("1996-01-01").cast("timestamp_ntz")) & (F.col("l_shipdate") < F.lit("1997-01-01").cast("timestamp_ntz")))
    return s.select("l_suppkey", F.to_date("l_shipdate").alias("day"), "l_quantity", "l_discount")


@query("s10_feeder_series", f"""WITH m AS (SELECT s_suppkey AS feeder, s_nationkey AS area, CAST(l_shipdate AS DATE) AS day, avg(l_quantity) AS kw FROM lineitem JOIN supplier ON l_suppkey=s_suppkey GROUP BY 1,2,3)
SELECT feeder, day, round(kw*1.0007::DOUBLE,8) AS kw, {X.sql_temp('area', 'day')} AS t FROM m""")
def s10(spark, d):
    l, s = X.table(spark, d, "lineitem"), X.table(spark, d, "supplier")
    m = l.join(s, l.l_suppkey == s.s_suppkey).select(F.col("s_suppkey").alias("feeder"), F.col("s_nationkey").alias("area"), F.col("l_shipdate").cast("timestamp").alias("ts"), F.col("l_quantity").alias("kw"))
    w = m.select("area", "ts").distinct().withColumn("t", X.temperature_at(F.col("area"), F.to_date("ts")))
    f = D.feeder_series(m, w, "feeder", "ts", "kw", "area", 1440)
    return f.select("feeder", F.to_date("slot").alias("day"), r8(F.col("kw") * 1.0007).alias("kw"), "t")


@query("s11_daily_temperature_text", f"WITH {X.SQL_ST} SELECT station, day AS date, CASE WHEN dayofmonth(day)=13 THEN NULL ELSE round(t,2) END AS t, round(t,2) AS t_csv FROM stt")
def s11(spark, d):
    """Every station's daily file in two layouts, one folder per station and layout."""
    whole = cut_lineage(X.station_temperature(spark, d).select("station", "day", F.round("t", 2).alias("t")))
    bad, out = F.when(F.dayofmonth("day") == 13, "n/a").otherwise(F.format_string("%.2f", "t")), None
    for (k,) in whole.select("station").distinct().orderBy("station").collect():      # one file set per station
        t, a, b = whole.where(F.col("station") == k), scratch(spark, "text"), scratch(spark, "csv")
        t.select(F.concat(F.lit("  "), F.col("day").cast("string"), F.lit("   "), bad).alias("value")).write.text(a)
        t.select(F.col("day").cast("string"), F.format_string("%.2f", "t")).write.csv(b)
        x = D.daily_temperature_text(spark, a).withColumnRenamed("T", "t").join(D.daily_temperature_csv(spark, b).select("date", F.col("T").alias("t_csv")), "date").withColumn("station", F.lit(k))
        out = x if out is None else out.unionByName(x)
    return out


@query("s12_tall_meters", """SELECT l_suppkey AS meter, CAST(count(*) AS BIGINT) AS n, CAST(max(CASE WHEN l_discount>0.09 THEN 1 ELSE 0 END) AS INTEGER) AS flag, CAST(min(l_shipdate) AS DATE) AS first_day, CAST(max(l_shipdate) AS DATE) AS last_day,
 arg_min(l_returnflag, (l_shipdate, l_orderkey, l_linenumber, l_returnflag)) AS category FROM lineitem GROUP BY 1""")
def s12(spark, d):
    l = X.table(spark, d, "lineitem")
    t = D.tall_meters(l.withColumnRenamed("l_suppkey", "meter"), "meter", "l_shipdate", F.col("l_discount") > 0.09, "l_returnflag", ["l_shipdate", "l_orderkey", "l_linenumber", "l_returnflag"])
    return t.withColumn("first_day", F.to_date("first_day")).withColumn("last_day", F.to_date("last_day"))


HEAD = {"lang": r'<html lang="([a-z]+)"', "charset": r'charset="([A-Za-z0-9-]+)"', "title": r"<title>([^<]*)</title>", "article": r"<article[^>]*><h1>([^<]*)</h1>"}


@query("s13_header_attributes", "SELECT page_id, " + ", ".join(f"nullif(regexp_extract(html, '{p}', 1), '') AS {n}" for n, p in HEAD.items()) + " FROM pages")
def s13(spark, d):
    return D.text_attributes(X.table(spark, d, "pages"), "page_id", "html", HEAD)


@query("s14_field_study", """WITH z AS (SELECT user_id AS unit, CASE WHEN event_id%11=0 THEN 'bad stamp' ELSE strftime(ts,'%Y-%m-%d %H:%M:%S') END AS st, CASE WHEN event_id%7=0 THEN NULL ELSE value END AS kw, TRY_CAST(regexp_extract(props,'([0-9]+)',1) AS DOUBLE)/90 AS k FROM events)
SELECT unit, CAST(count(TRY_CAST(st AS TIMESTAMP)) AS BIGINT) AS n_stamps, CAST(count(kw) AS BIGINT) AS n_kw, CAST(count(k) AS BIGINT) AS n_k, CAST(min(TRY_CAST(st AS TIMESTAMP)) AS DATE) AS first_day, CAST(max(TRY_CAST(st AS TIMESTAMP)) AS DATE) AS last_day, coalesce(max(k>0.1),false) AS backup FROM z GROUP BY 1""")
def s14(spark, d):
    e = X.table(spark, d, "events")
    z = e.select(F.col("user_id").alias("unit"), F.when(F.col("event_id") % 11 == 0, "bad stamp").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("st"),
                 F.when(F.col("event_id") % 7 == 0, "--").otherwise(F.col("value").cast("string")).alias("kw"),
                 (F.get_json_object("props", "$.k").cast("double") / 90).cast("string").alias("k"))
    return D.field_study(z, "unit", "st", ["kw", "k"], "k")


@query("s15_pool_store", f"WITH {X.SQL_READ} SELECT hh, day, round(own,8) AS own, round(hp,8) AS hp FROM rd WHERE role='hp'")
def s15(spark, d):
    path = scratch(spark, "pool")
    D.write_pool(X.daily_readings(spark, d).select("role", "hh", "day", "own", "hp"), X.households(spark, d), path)
    return D.read_pool(spark, path, "hp").select("hh", "day", r8("own").alias("own"), r8("hp").alias("hp"))


@query("s16_metric_sink", "SELECT o_orderpriority AS arm, CAST(year(o_orderdate) AS INTEGER) AS split_seed, 'mean' AS metric, round(avg(o_totalprice)/99991.0,8) AS value FROM orders GROUP BY 1,2")
def s16(spark, d):
    o = X.table(spark, d, "orders")
    m = o.groupBy(F.col("o_orderpriority").alias("arm"), F.year("o_orderdate").alias("split_seed")).agg(F.lit("mean").alias("metric"), r8(F.avg("o_totalprice") / X.KW).alias("value"))
    path = scratch(spark, "results")
    D.write_results({"metrics": m}, path, ["arm", "split_seed"])
    return D.read_results(spark, path, "metrics").select("arm", "split_seed", "metric", "value")


# ------------------------------------------------------------------ reports and pools
def reports(spark, d):
    """Inspection reports: one per document, a second one for labelled documents, flags and codes from the key."""
    a = X.table(spark, d, "documents").select(F.col("doc_id").alias("hh"), F.col("doc_id").alias("k"))
    o = a.unionByName(X.table(spark, d, "labels").select(F.col("doc_id").alias("hh"), (F.col("doc_id") + 100000).alias("k")))
    k = F.col("k")
    b = lambda n: F.when(k % n == 0, F.lit(None)).otherwise(k % n == 1).cast("boolean")
    pick = lambda n, vals: F.element_at(F.array(*[F.lit(v) for v in vals]), (k % n + 1).cast("int"))
    return o.select(
        "hh", k.alias("report"), b(3).alias("Building_Renovated_Windows"), b(5).alias("Building_Renovated_Roof"), b(4).alias("Building_PVSystem_Available"),
        pick(4, ("single family house", "multi family house", "other", None)).alias("Building_Type"), pick(3, ("< 1975", "2000 - 10", None)).alias("Building_ConstructionYear_Interval"),
        pick(5, ("air-source", "ground-source", "water-source", None, "air-source")).alias("HeatPump_Installation_Type"), F.when(k % 6 > 0, k % 6).alias("Building_HousingUnits"),
        b(6).alias("HeatPump_BasicFunctionsOkay"), b(7).alias("HeatPump_TechnicallyOkay"), b(3).alias("HeatPump_Installation_CorrectlyPlanned"),
        pick(3, ("undersized", "oversized", None)).alias("HeatPump_Installation_IncorrectlyPlanned_Categorization"),
        pick(4, ("normal", "rather low", "rather high", None)).alias("HeatPump_ElectricityConsumption_Categorization"),
        b(4).alias("HeatPump_HeatingCurveSetting_TooHigh_BeforeVisit"), b(2).alias("HeatPump_HeatingCurveSetting_Changed"),
        b(5).alias("HeatPump_HeatingLimitSetting_TooHigh_BeforeVisit"), b(3).alias("HeatPump_HeatingLimitSetting_Changed"),
        (k % 20).cast("double").alias("HeatPump_HeatingLimitSetting_BeforeVisit"), (k % 15).cast("double").alias("HeatPump_HeatingLimitSetting_AfterVisit"),
        b(3).alias("HeatPump_NightSetbackSetting_Activated_BeforeVisit"), b(4).alias("HeatPump_NightSetbackSetting_Activated_AfterVisit"),
        pick(4, ("normal", "too low", "too high", None)).alias("DHW_TemperatureSetting_Categorization"), b(2).alias("DHW_TemperatureSetting_Changed"))


def _b(n):
    return f"(CASE WHEN k%{n}=0 THEN NULL ELSE k%{n}=1 END)"


REP_SQL = """r0 AS (SELECT doc_id AS hh, doc_id AS k FROM documents UNION ALL SELECT doc_id, doc_id+100000 FROM labels), mu AS (SELECT hh FROM r0 GROUP BY 1 HAVING count(*)>1), r1 AS (SELECT * FROM r0 WHERE hh NOT IN (SELECT hh FROM mu))"""


@query("p17_report_groundtruth", f"""WITH {REP_SQL}, z AS (SELECT r1.*, tp, tp='after visit' AS aft FROM r1, (VALUES ('before visit'),('after visit')) v(tp)),
q AS (SELECT *, CASE k%4 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE WHEN 2 THEN 3.0::DOUBLE END AS cons, CASE WHEN aft AND coalesce({_b(2)},false) THEN 1.0::DOUBLE ELSE CASE k%4 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE WHEN 2 THEN 3.0::DOUBLE END END AS dhw FROM z)
SELECT hh, tp AS "AffectsTimePoint", CASE WHEN NOT aft THEN CAST(coalesce({_b(6)},true) AS DOUBLE) END AS basic_ok, CAST(coalesce({_b(3)},true) AS DOUBLE) AS planned_ok, CASE k%3 WHEN 0 THEN 2.0::DOUBLE WHEN 1 THEN 3.0::DOUBLE ELSE 1.0::DOUBLE END AS planned_code,
 CASE WHEN NOT aft THEN cons END AS consumption, CASE WHEN NOT aft THEN CASE WHEN cons=3 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END AS consumption_high, CASE WHEN aft AND coalesce({_b(4)},false) AND coalesce({_b(2)},false) THEN 0.0::DOUBLE ELSE CAST(coalesce({_b(4)},false) AS DOUBLE) END AS curve_high,
 CASE WHEN aft AND coalesce({_b(5)},false) AND coalesce({_b(3)},false) THEN 0.0::DOUBLE ELSE CAST(coalesce({_b(5)},false) AS DOUBLE) END AS limit_high, CASE WHEN aft THEN CAST(k%15 AS DOUBLE) ELSE CAST(k%20 AS DOUBLE) END AS heating_limit,
 CASE WHEN aft THEN CAST({_b(4)} AS DOUBLE) ELSE CAST(coalesce({_b(3)},false) AS DOUBLE) END AS night, dhw, CASE WHEN dhw=3 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS dhw_high FROM q""")
def p17(spark, d):
    g = R.report_groundtruth(reports(spark, d), "hh")
    names = {"HeatPump_BasicFunctionsOkay": "basic_ok", "HeatPump_Installation_CorrectlyPlanned": "planned_ok", "HeatPump_Installation_CorrectlyPlanned_Categorization": "planned_code",
             "HeatPump_ElectricityConsumption_Categorization": "consumption", "HeatPump_ElectricityConsumption_TooHigh": "consumption_high", "HeatPump_HeatingCurveSetting_TooHigh": "curve_high",
             "HeatPump_HeatingLimitSetting_TooHigh": "limit_high", "HeatPump_HeatingLimitSetting": "heating_limit", "HeatPump_NightSetbackSetting_Activated": "night",
             "DHW_TemperatureSetting_Categorization": "dhw", "DHW_TemperatureSetting_TooHigh": "dhw_high"}
    return g.select("hh", "AffectsTimePoint", *[F.col(a).alias(b) for a, b in names.items()])


@query("p18_report_features", f"""WITH {REP_SQL} SELECT hh, CAST(coalesce({_b(3)},false) OR coalesce({_b(5)},false) AS DOUBLE) AS renovated, CAST(coalesce({_b(4)},false) AS DOUBLE) AS pv, CASE k%4 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE WHEN 2 THEN 3.0::DOUBLE ELSE 1.0::DOUBLE END AS building,
 CASE k%3 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 7.0::DOUBLE END AS built, CASE k%5 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE WHEN 2 THEN 3.0::DOUBLE WHEN 4 THEN 1.0::DOUBLE END AS source, CASE WHEN k%6>0 THEN CAST(k%6 AS DOUBLE) ELSE 1.0::DOUBLE END AS units FROM r1""")
def p18(spark, d):
    f = R.report_features(reports(spark, d), "hh")
    return f.select("hh", F.col("Building_Renovated").alias("renovated"), F.col("Building_PVSystem_Available").alias("pv"), F.col("Building_Type").alias("building"),
                    F.col("Building_ConstructionYear_Interval").alias("built"), F.col("HeatPump_Installation_Type").alias("source"), F.col("Building_HousingUnits").alias("units"))


@query("p19_filter_pool", f"WITH {X.SQL_HH} SELECT hh, station, split_part('P:'||hh,':',1) AS source FROM hh WHERE NOT (acctbal<0 OR hh%9=0) AND segment IN ('MACHINERY','BUILDING') AND hh IN (SELECT o_custkey FROM orders WHERE o_orderstatus='F')")
def p19(spark, d):
    h = X.households(spark, d)
    flag_a, flag_b = F.when(F.col("acctbal") < 0, "True"), F.when(F.col("hh") % 9 == 0, "True").otherwise("False")
    p = R.filter_pool(h, [flag_a == "True", flag_b == "True"], F.col("segment").isin("MACHINERY", "BUILDING"))
    ids = X.table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("hh"))
    return R.restrict_pool(p, ids, "hh").select("hh", "station", F.split(F.concat(F.lit("P:"), F.col("hh").cast("string")), ":")[0].alias("source"))


@query("p20_combine_pools", f"WITH {X.SQL_HH} SELECT CASE WHEN role='hp' THEN 'A:' ELSE 'B:' END||hh AS hh, CASE WHEN station=0 THEN 'STATION-0' ELSE CAST(station AS VARCHAR) END AS station, CASE WHEN role='hp' THEN 'A' ELSE 'B' END AS source FROM hh")
def p20(spark, d):
    h = X.households(spark, d).select("hh", F.col("station").cast("string").alias("station"), "role")
    return R.combine_pools({"A": h.where("role = 'hp'"), "B": h.where("role <> 'hp'")}, "hh", "station", {"0": "STATION-0"}).select("hh", "station", "source")


@query("j03_pair_meters", """WITH m AS (SELECT s_suppkey AS meter, CASE WHEN s_acctbal<-500 THEN NULL ELSE s_nationkey END AS obj, CASE WHEN s_suppkey%3=0 THEN 'hp' WHEN s_suppkey%3=1 THEN 'dwelling' ELSE 'other' END AS kind FROM supplier),
g AS (SELECT obj, min(meter) FILTER (kind='dwelling') AS own_meter, min(meter) FILTER (kind='hp') AS hp_meter FROM m WHERE obj IS NOT NULL GROUP BY 1)
SELECT *, CASE WHEN own_meter IS NULL THEN 'heat pump only' WHEN hp_meter IS NULL THEN 'dwelling only' ELSE 'paired' END AS state FROM g WHERE own_meter IS NOT NULL OR hp_meter IS NOT NULL""")
def j03(spark, d):
    s = X.table(spark, d, "supplier").select(F.col("s_suppkey").alias("meter"), F.when(F.col("s_acctbal") < -500, None).otherwise(F.col("s_nationkey")).alias("obj"),
                                             F.when(F.col("s_suppkey") % 3 == 0, "hp").when(F.col("s_suppkey") % 3 == 1, "dwelling").otherwise("other").alias("kind"))
    return R.pair_units(s, "obj", "kind", "dwelling", "hp", "meter")
