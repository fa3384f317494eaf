"""Scans and sinks: meter, weather, feeder and text sources into long tables; pool and metric stores."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.clean import complete_grid, coverage, dedupe_first, interpolate

# fixed values: resolutions and columns of the household meter files
RESOLUTIONS = ("15min", "daily", "monthly", "cumulative_counters")
METER_SCHEMA = "Household_ID BIGINT, Timestamp TIMESTAMP, kWh_received_Total DOUBLE, kWh_received_HeatPump DOUBLE, kWh_received_Other DOUBLE"
HOURLY_SCHEMA = "Weather_ID STRING, Timestamp TIMESTAMP, Temperature_avg_hourly DOUBLE"
DAILY_SCHEMA = "Weather_ID STRING, Timestamp TIMESTAMP, Temperature_avg_daily DOUBLE"


def _csv(spark: SparkSession, path: str, schema: str, sep: str = ";", header: bool = True) -> DataFrame:
    return spark.read.schema(schema).option("sep", sep).option("header", header).csv(path)


def read_meters(spark: SparkSession, path: str, resolution: str, ids: DataFrame | None = None, schema: str = METER_SCHEMA) -> DataFrame:
    """All households of one resolution in one scan of the folder, full-row duplicates removed; `ids` keeps some households."""
    if resolution not in RESOLUTIONS:
        raise ValueError(f"resolution must be one of {RESOLUTIONS}")
    m = _csv(spark, f"{path}/{resolution}", schema)
    if ids is not None:
        m = m.join(ids.select("Household_ID").distinct(), "Household_ID", "left_semi")
    return m.dropDuplicates()


def read_weather(spark: SparkSession, path: str, resolution: str) -> DataFrame:
    """hourly, daily, or fused: daily columns repeated on each hour of the date."""
    if resolution == "hourly":
        return _csv(spark, f"{path}/hourly", HOURLY_SCHEMA)
    daily = _csv(spark, f"{path}/daily", DAILY_SCHEMA)
    if resolution == "daily":
        return daily
    h = _csv(spark, f"{path}/hourly", HOURLY_SCHEMA).withColumn("_d", F.to_date("Timestamp"))
    return h.join(daily.withColumn("_d", F.to_date("Timestamp")).drop("Timestamp"), ["Weather_ID", "_d"], "left").drop("_d")


def weather_of_households(weather: DataFrame, mapping: DataFrame, ids: DataFrame) -> DataFrame:
    """Weather rows of the stations that serve the given households."""
    st = mapping.join(ids.select("Household_ID").distinct(), "Household_ID", "left_semi").select("Household_ID", "Weather_ID")
    return st.join(weather, "Weather_ID")


def merge_metadata(meta: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Full outer merge of two household tables on the id."""
    return meta.join(other, key, "full_outer")


def utility_meters(readings: DataFrame, key: list[str], ts: str, kwh: str, tiebreak: str, start: str, end: str, step: str, slots: int, min_cover: float, per_hour: float) -> DataFrame:
    """First row per stamp, full grid, meters below the coverage left out, gaps interpolated, kWh to kW."""
    one = dedupe_first(readings, [*key, ts], tiebreak).select(*key, ts, kwh)
    cov = coverage(one.withColumn("_day", F.to_date(ts)), key, F.col(kwh).isNotNull(), slots, 24, day="_day").where(F.col("coverage") >= min_cover)
    g = complete_grid(one.join(cov.select(*key), key, "left_semi"), key, ts, start, end, step)
    return interpolate(g, key, ts, kwh, "_v").select(*key, ts, (F.col("_v") * per_hour).alias("kw"))


def submetered(groups: list[DataFrame], house: str, epoch: str, watts: str, channel: str) -> DataFrame:
    """Union of submetered groups: epoch seconds to stamps, W to kW, one column per channel."""
    u = reduce(lambda a, b: a.unionByName(b), groups)
    k = F.col(watts) / 1000.0
    return u.groupBy(house, F.timestamp_seconds(epoch).alias("ts")).agg(F.avg(F.when(F.col(channel) == "HEATPUMP", k)).alias("hp_kw"),
                                                                     F.avg(F.when(F.col(channel) == "HOUSEHOLD", k)).alias("other_kw"))


def wide_to_long(wide: DataFrame, ts: str, name: str = "hh", value: str = "kwh") -> DataFrame:
    """One column per household to one row per household and stamp; missing cells are left out."""
    return wide.unpivot([ts], [c for c in wide.columns if c != ts], name, value).where(F.col(value).isNotNull())


def scan_channels(spark: SparkSession, path: str, channels: list[str], key: str, ts: str, start: str, end: str, homes: DataFrame | None = None) -> DataFrame:
    """Columnar scan: only the wanted columns and the half-open time range reach the reader."""
    d = spark.read.parquet(path).select(key, ts, *channels).where((F.col(ts) >= F.lit(start).cast("timestamp")) & (F.col(ts) < F.lit(end).cast("timestamp")))
    return d if homes is None else d.join(homes.select(key).distinct(), key, "left_semi")


def feeder_series(measure: DataFrame, weather: DataFrame, feeder: str, ts: str, kw: str, area: str, minutes: int = 15) -> DataFrame:
    """Mean power per feeder and slot with the slot's temperature; slots without either are left out."""
    s = minutes * 60
    slot = F.timestamp_seconds(F.floor(F.unix_timestamp(ts) / s) * s)
    m = measure.groupBy(feeder, area, slot.alias("slot")).agg(F.avg(kw).alias("kw"))
    t = weather.groupBy(area, slot.alias("slot")).agg(F.avg("t").alias("t"))
    return m.join(t, [area, "slot"]).where("kw IS NOT NULL AND t IS NOT NULL")


def daily_temperature_text(spark: SparkSession, path: str) -> DataFrame:
    """Whitespace-separated daily file with a header line: date, T; unparsable numbers become NULL."""
    t = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("p"))
    return t.select(F.try_to_date(F.col("p")[0]).alias("date"), F.expr("try_cast(p[1] AS DOUBLE)").alias("T")).where("date IS NOT NULL")


def daily_temperature_csv(spark: SparkSession, path: str) -> DataFrame:
    """Header-less comma file: date, T."""
    return _csv(spark, path, "date DATE, T DOUBLE", ",", False)


def tall_meters(rows: DataFrame, meter: str, day: str, flag: Column, category: str, order: list[str]) -> DataFrame:
    """Per meter of a tall table: rows, flag, first and last day, first category. Partial aggregation takes the place of chunked reading."""
    return rows.groupBy(meter).agg(F.count("*").alias("n"), F.max(flag.cast("int")).alias("flag"), F.min(day).alias("first_day"), F.max(day).alias("last_day"),
                                   F.min_by(category, F.struct(*order)).alias("category"))


def text_attributes(files: DataFrame, key: str, text: str, patterns: dict[str, str]) -> DataFrame:
    """One row per text file: first group of each pattern, NULL where it does not occur."""
    ex = lambda p: F.nullif(F.regexp_extract(text, p, 1), F.lit(""))
    return files.select(key, *[ex(p).alias(n) for n, p in patterns.items()])


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """path, value: whole text of each file."""
    return spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("path"), "value")


def field_study(rows: DataFrame, unit: str, stamp: str, numbers: list[str], backup: str) -> DataFrame:
    """Coerced numbers and stamps of mixed formats; per unit the counts, span and whether backup heat ever ran."""
    d = rows.select(unit, F.try_to_timestamp(F.substring(stamp, 1, 19)).alias("_ts"), *[F.expr(f"try_cast({n} AS DOUBLE)").alias(n) for n in numbers])
    return d.groupBy(unit).agg(F.count("_ts").alias("n_stamps"), *[F.count(n).alias(f"n_{n}") for n in numbers], F.to_date(F.min("_ts")).alias("first_day"),
                               F.to_date(F.max("_ts")).alias("last_day"), F.coalesce(F.max(F.col(backup) > 0.1), F.lit(False)).alias("backup"))


# ------------------------------------------------------------------ stores
def write_pool(readings: DataFrame, households: DataFrame, path: str) -> None:
    """Long readings partitioned by role, and the household table."""
    readings.write.mode("overwrite").partitionBy("role").parquet(f"{path}/readings")
    households.write.mode("overwrite").parquet(f"{path}/households")


def read_pool(spark: SparkSession, path: str, role: str | None = None) -> DataFrame:
    r = spark.read.parquet(f"{path}/readings")
    return r if role is None else r.where(F.col("role") == role)      # partition pruning


def write_results(tables: dict[str, DataFrame], path: str, parts: list[str]) -> None:
    """Long metric and prediction tables, partitioned by the experiment keys; a rerun replaces its own partitions only."""
    for n, t in tables.items():
        t.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(f"{path}/{n}")


def read_results(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}")


def first_and_last(meta: DataFrame, key: str, day: str, year_start: str, year_end: str, cols: list[str]) -> tuple[DataFrame, DataFrame]:
    """Metadata of an entity at the start and end of a year. The start falls back, cell by cell, to the entity's earliest row overall."""
    inside = F.col(day).between(F.lit(year_start).cast("date"), F.lit(year_end).cast("date"))
    first = lambda c, cond: F.min(F.when(cond, F.struct(day, F.col(c).alias("v")))).getField("v")
    g = meta.groupBy(key).agg(*[first(c, inside).alias(f"_i_{c}") for c in cols], *[first(c, F.lit(True)).alias(f"_e_{c}") for c in cols],
                              *[F.max(F.when(inside, F.struct(day, F.col(c).alias("v")))).getField("v").alias(f"_l_{c}") for c in cols])
    return (g.select(key, *[F.coalesce(f"_i_{c}", f"_e_{c}").alias(c) for c in cols]), g.select(key, *[F.col(f"_l_{c}").alias(c) for c in cols]))
