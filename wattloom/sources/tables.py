"""Adapters that present the star-schema test tables as meters, weather and households.

household = customer, station = region (cohorts) or nation (series), daily reading = orders of the
day, sub-daily reading = events, temperature = a seasonal formula of station and day of year."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import shared

NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
         "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


KW = 99991.0      # price per kW: a prime, so derived values are no short decimals and rounding has no exact ties


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def temperature_at(station: Column, day: Column) -> Column:
    """Seasonal mean plus a station-and-day offset, in degrees Celsius."""
    doy = F.dayofyear(day)
    return F.round(10 - 12 * F.cos(2 * F.pi() * (doy - 20) / 365) + ((station * 7 + doy * 13) % 17 - 8) / 4.0, 4)


def households(spark, d) -> DataFrame:
    """hh, role (hp / fill), nation, station (region), cap (nameplate kW)."""
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    return (c.join(n, c.c_nationkey == n.n_nationkey)
            .select(F.col("c_custkey").alias("hh"),
                    F.when(F.col("c_mktsegment") == "MACHINERY", "hp").otherwise("fill").alias("role"),
                    F.col("c_nationkey").alias("nation"), F.col("n_regionkey").alias("station"),
                    F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("acctbal"),
                    (3.0 + F.col("c_custkey") % 8).alias("cap")))


def daily_own(spark, d) -> DataFrame:
    """hh, day, own: non-heating load of a day, orders summed as DECIMAL before any join."""
    o = table(spark, d, "orders")
    return (o.groupBy(F.col("o_custkey").alias("hh"), F.to_date("o_orderdate").alias("day"))
            .agg((F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double") / KW).alias("own")))


def daily_readings(spark, d) -> DataFrame:
    """hh, role, nation, station, cap, day, t, own, hp: one row per household and day with data."""
    x = daily_own(spark, d).join(households(spark, d), "hh").withColumn("t", temperature_at(F.col("station"), F.col("day")))
    hp = F.when(F.col("role") == "hp", 0.03 * F.col("cap") * F.greatest(F.lit(0.0), 15 - F.col("t"))).otherwise(0.0)
    return x.select("hh", "role", "nation", "station", "cap", "day", "t", "own", hp.alias("hp"))


#: Half-hour slots of a day, and classes of households that share a load profile.
SLOTS, CLASSES = 48, 24


def load_profiles(spark, d) -> DataFrame:
    """class, p_hp, p_own: shape of a day by slot (mean 1) from the events of the class's users; clicks shape the heat pump, other events the rest.
    One row for each of the CLASSES."""
    ts = F.col("ts").cast("timestamp")
    e = table(spark, d, "events").select((F.col("user_id") % CLASSES).cast("int").alias("class"), F.floor((F.hour(ts) * 60 + F.minute(ts)) / 30).cast("int").alias("slot"),
                                         (F.col("event_type") == "click").alias("hp"), F.col("value").cast("decimal(18,2)").alias("v"))
    g = e.groupBy("class", "slot").agg(*[F.coalesce(F.sum(F.when(c, F.col("v"))).cast("double"), F.lit(0.0)).alias(n) for n, c in (("hp", F.col("hp")), ("own", ~F.col("hp")))])
    at = g.groupBy("class").agg(*[F.map_from_entries(F.collect_list(F.struct("slot", c))).alias(c) for c in ("hp", "own")])

    def shape(c: str) -> Column:
        w = F.transform(F.sequence(F.lit(0), F.lit(SLOTS - 1)), lambda s: 1.0 + F.coalesce(F.try_element_at(c, s), F.lit(0.0)))
        return F.transform(w, lambda x: x * SLOTS / F.aggregate(w, F.lit(0.0), lambda a, y: a + y))
    k = spark.range(CLASSES).select(F.col("id").cast("int").alias("class"))
    return k.join(at, "class", "left").select("class", shape("hp").alias("p_hp"), shape("own").alias("p_own"))


def slot_readings(spark, d, readings: DataFrame | None = None) -> DataFrame:
    """daily_readings (or those of them in `readings`) with the half-hour loads of each day: hp_slots and own_slots, arrays whose means are the day's hp and own."""
    profiles = shared(spark, "profiles", [f"{d}/events.parquet"], lambda: load_profiles(spark, d))
    r = (daily_readings(spark, d) if readings is None else readings).join(profiles, F.col("class") == F.col("hh") % CLASSES)
    return r.select("hh", "role", "station", "day", "t", "hp", "own", F.transform("p_hp", lambda x: F.col("hp") * x).alias("hp_slots"), F.transform("p_own", lambda x: F.col("own") * x).alias("own_slots"))


def nation_daily(spark, d) -> DataFrame:
    """station (nation), day, t, y: mean load per nation and day plus a known heating response of 0.3 kW/K below 15 C."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    g = (o.join(c, o.o_custkey == c.c_custkey)
         .groupBy(F.col("c_nationkey").alias("station"), F.to_date("o_orderdate").alias("day"))
         .agg((F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double") / KW).alias("kw"))
         .withColumn("t", temperature_at(F.col("station"), F.col("day"))))
    return g.select("station", "day", "t", (F.col("kw") + 0.3 * F.greatest(F.lit(0.0), 15 - F.col("t"))).alias("y"), "kw")


def slots(spark, d) -> DataFrame:
    """Sub-daily readings: hh, channel, ts (TIMESTAMP, UTC), kw, event_id."""
    return (table(spark, d, "events")
            .select(F.col("user_id").alias("hh"), F.col("event_type").alias("channel"),
                    F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("kw"), "event_id"))


def span(spark, d) -> tuple[str, str, int]:
    """First and last hour of the sub-daily readings, and the number of hours between, both included."""
    ts = F.date_trunc("hour", F.col("ts").cast("timestamp"))
    a, z, n = table(spark, d, "events").agg(F.date_format(F.min(ts), "yyyy-MM-dd HH:mm:ss"), F.date_format(F.max(ts), "yyyy-MM-dd HH:mm:ss"),
                                            ((F.unix_timestamp(F.max(ts)) - F.unix_timestamp(F.min(ts))) / 3600 + 1).cast("int")).first()
    return a, z, n


def hourly(spark, d) -> DataFrame:
    """hh, ts (hour), kw: mean of the hour's readings; silent hours have no row."""
    return (slots(spark, d).groupBy("hh", F.date_trunc("hour", "ts").alias("ts"))
            .agg((F.sum(F.col("kw").cast("decimal(18,2)")).cast("double") / F.count("*")).alias("kw")))


# The same adapters as SQL common table expressions, for the result checks.
SQL_HH = """hh AS (SELECT c_custkey AS hh, CASE WHEN c_mktsegment='MACHINERY' THEN 'hp' ELSE 'fill' END AS role,
 c_nationkey AS nation, n_regionkey AS station, c_mktsegment AS segment, c_acctbal AS acctbal, 3.0::DOUBLE + c_custkey % 8 AS cap
 FROM customer JOIN nation ON c_nationkey=n_nationkey)"""


def sql_temp(station: str, day: str) -> str:
    return (f"round(10 - 12*cos(2*pi()*(dayofyear({day})-20)/365) + "
            f"(({station}*7 + dayofyear({day})*13) % 17 - 8)/4.0::DOUBLE, 4)")


SQL_OWN = """own AS (SELECT o_custkey AS hh, CAST(o_orderdate AS DATE) AS day,
 CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE)/99991.0 AS own FROM orders GROUP BY 1,2)"""
SQL_READ = f"""{SQL_HH}, {SQL_OWN}, rt AS (SELECT h.hh, role, nation, station, cap, day, own, {sql_temp('station', 'day')} AS t
 FROM own o JOIN hh h ON o.hh=h.hh),
rd AS (SELECT hh, role, nation, station, cap, day, t, own,
 CASE WHEN role='hp' THEN 0.03::DOUBLE*cap*greatest(0.0::DOUBLE, 15-t) ELSE 0.0::DOUBLE END AS hp FROM rt)"""
SQL_PROFILE = f"""pe AS (SELECT CAST(user_id % {CLASSES} AS INTEGER) AS k, CAST((hour(ts)*60+minute(ts))//30 AS INTEGER) AS slot, event_type='click' AS c, CAST(value AS DECIMAL(18,2)) AS v FROM events),
pw AS (SELECT CAST(a.k AS INTEGER) AS k, CAST(b.slot AS INTEGER) AS slot, 1.0::DOUBLE+coalesce(CAST(sum(v) FILTER (c) AS DOUBLE),0) AS hp, 1.0::DOUBLE+coalesce(CAST(sum(v) FILTER (NOT c) AS DOUBLE),0) AS own
 FROM range({CLASSES}) a(k) CROSS JOIN range({SLOTS}) b(slot) LEFT JOIN pe ON pe.k=a.k AND pe.slot=b.slot GROUP BY 1,2),
prof AS (SELECT k, slot, hp*{SLOTS}/sum(hp) OVER (PARTITION BY k) AS p_hp, own*{SLOTS}/sum(own) OVER (PARTITION BY k) AS p_own FROM pw)"""
SQL_ND = f"""nd0 AS (SELECT c_nationkey AS station, CAST(o_orderdate AS DATE) AS day,
 CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE)/99991.0 AS kw
 FROM orders JOIN customer ON o_custkey=c_custkey GROUP BY 1,2),
nd1 AS (SELECT *, {sql_temp('station', 'day')} AS t FROM nd0),
nd AS (SELECT station, day, t, kw + 0.3::DOUBLE*greatest(0.0::DOUBLE, 15-t) AS y, kw FROM nd1)"""
SQL_SPAN = "(SELECT date_trunc('hour', min(ts)) AS a_, date_trunc('hour', max(ts)) AS z_ FROM events)"
SQL_HOURS = f"(SELECT CAST(date_diff('hour', a_, z_)+1 AS DOUBLE) FROM {SQL_SPAN})"
SQL_SLOT = "sl AS (SELECT user_id AS hh, event_type AS channel, ts, value AS kw, event_id FROM events)"
SQL_HOUR = f"""{SQL_SLOT}, hr AS (SELECT hh, date_trunc('hour', ts) AS ts,
 CAST(sum(CAST(kw AS DECIMAL(18,2))) AS DOUBLE)/count(*) AS kw FROM sl GROUP BY 1,2)"""


def station_temperature(spark, d) -> DataFrame:
    """Weather table: station (the five regions), day, t for every calendar day with readings."""
    days = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    x = days.withColumn("station", F.explode(F.sequence(F.lit(0), F.lit(4))))
    return x.select("station", "day", temperature_at(F.col("station"), F.col("day")).alias("t"))


SQL_ST = f"""stt AS (SELECT CAST(s AS INTEGER) AS station, day, {sql_temp('s', 'day')} AS t FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders), range(5) r(s))"""
