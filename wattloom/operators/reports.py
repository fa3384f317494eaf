"""Household metadata, inspection reports and pool selection."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

# fixed values: report variables and their codes
CODES = {
    "Building_Type": {"single family house": 1.0, "multi family house": 2.0, "other": 3.0},
    "Building_ConstructionYear_Interval": {"< 1975": 1.0, "1976 - 80": 2.0, "1981 - 85": 3.0, "1986 - 90": 4.0,
                                           "1991 - 95": 5.0, "1995 - 00": 6.0, "2000 - 10": 7.0, "> 2010": 8.0},
    "HeatPump_Installation_Type": {"air-source": 1.0, "ground-source": 2.0, "water-source": 3.0},
    "HeatPump_ElectricityConsumption_Categorization": {"normal": 1.0, "rather low": 2.0, "rather high": 3.0},
    "HeatPump_Installation_IncorrectlyPlanned_Categorization": {"undersized": 2.0, "oversized": 3.0},
    "DHW_TemperatureSetting_Categorization": {"normal": 1.0, "too low": 2.0, "too high": 3.0},
}
RENOVATED = ("Building_Renovated_Windows", "Building_Renovated_Roof", "Building_Renovated_Walls", "Building_Renovated_Floor")
FLAGS = ("Building_PVSystem_Available", "Building_ElectricVehicle_Available", "HeatDistribution_System_Radiators",
         "HeatDistribution_System_FloorHeating", "HeatDistribution_System_ThermostaticValve", "DHW_Production_ByHeatPump",
         "DHW_Production_ByElectricWaterHeater", "DHW_Production_BySolar", "DHW_Production_ByHeatPumpBoiler", "DHW_Circulation_ByTraceHeating",
         "DHW_Circulation_ByCirculationPump", "DHW_Circulation_SwitchedByTimer", "DHW_Sterilization_Available")


def recode(col: str | Column, codes: dict[str, float]) -> Column:
    m = F.create_map(*[F.lit(x) for kv in codes.items() for x in kv])
    return m[F.col(col) if isinstance(col, str) else col]


def any_of(flags: list[Column]) -> Column:
    """OR that treats NULL as False."""
    return reduce(lambda a, b: a | b, [F.coalesce(f, F.lit(False)) for f in flags])


def as_number(flag: Column) -> Column:
    return F.coalesce(flag.cast("double"), F.lit(0.0))


def single_visit(reports: DataFrame, hh: str) -> DataFrame:
    """Reports of households visited exactly once."""
    multi = reports.where(F.col(hh).isNotNull()).groupBy(hh).agg(F.count("*").alias("n")).where("n > 1").select(hh)
    return reports.where(F.col(hh).isNotNull()).join(multi, hh, "left_anti")


def report_features(reports: DataFrame, hh: str) -> DataFrame:
    """Static context of single-visit reports: booleans as 0/1, renovation as OR, categories as ordinal codes. Works on the
    columns that are present."""
    r, have = single_visit(reports, hh), set(reports.columns)
    out = [F.col(hh)]
    ren = [F.col(c) for c in RENOVATED if c in have]
    if ren:
        out.append(as_number(any_of(ren)).alias("Building_Renovated"))
    out += [as_number(F.col(c)).alias(c) for c in FLAGS if c in have]
    if "Building_Type" in have:
        out.append(recode(F.coalesce("Building_Type", F.lit("single family house")), CODES["Building_Type"]).alias("Building_Type"))
    if "Building_HousingUnits" in have:
        out.append(F.coalesce(F.col("Building_HousingUnits").cast("double"), F.lit(1.0)).alias("Building_HousingUnits"))
    out += [recode(c, CODES[c]).alias(c) for c in ("Building_ConstructionYear_Interval", "HeatPump_Installation_Type") if c in have]
    out += [F.col(c).cast("double").alias(c) for c in ("Building_Residents", "Building_FloorAreaHeated_Total", "HeatPump_Installation_HeatingCapacity") if c in have]
    return r.select(*out)


def report_groundtruth(reports: DataFrame, hh: str) -> DataFrame:
    """Two rows per single-visit household (before / after the visit): unknown-after values NULL, settings that were too high and
    changed count as corrected afterwards, categories as codes."""
    r = single_visit(reports, hh).withColumn("AffectsTimePoint", F.explode(F.array(F.lit("before visit"), F.lit("after visit"))))
    after = F.col("AffectsTimePoint") == "after visit"
    before_only = lambda c: F.when(~after, c)
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    ok = lambda c: F.coalesce(F.col(c), F.lit(True)).cast("double")
    cons = recode("HeatPump_ElectricityConsumption_Categorization", CODES["HeatPump_ElectricityConsumption_Categorization"])
    fixed = lambda high, changed: F.when(after & flag(high) & flag(changed), 0.0).otherwise(flag(high).cast("double"))
    dhw = F.when(after & flag("DHW_TemperatureSetting_Changed"), F.lit("normal")).otherwise(F.col("DHW_TemperatureSetting_Categorization"))
    dhw_code = recode(dhw, CODES["DHW_TemperatureSetting_Categorization"])
    return r.select(
        hh, "AffectsTimePoint",
        before_only(ok("HeatPump_BasicFunctionsOkay")).alias("HeatPump_BasicFunctionsOkay"),
        before_only(ok("HeatPump_TechnicallyOkay")).alias("HeatPump_TechnicallyOkay"),
        ok("HeatPump_Installation_CorrectlyPlanned").alias("HeatPump_Installation_CorrectlyPlanned"),
        F.coalesce(recode("HeatPump_Installation_IncorrectlyPlanned_Categorization", CODES["HeatPump_Installation_IncorrectlyPlanned_Categorization"]),
                   F.lit(1.0)).alias("HeatPump_Installation_CorrectlyPlanned_Categorization"),
        before_only(cons).alias("HeatPump_ElectricityConsumption_Categorization"),
        before_only(F.when(cons == 3.0, 1.0).otherwise(0.0)).alias("HeatPump_ElectricityConsumption_TooHigh"),
        fixed("HeatPump_HeatingCurveSetting_TooHigh_BeforeVisit", "HeatPump_HeatingCurveSetting_Changed").alias("HeatPump_HeatingCurveSetting_TooHigh"),
        fixed("HeatPump_HeatingLimitSetting_TooHigh_BeforeVisit", "HeatPump_HeatingLimitSetting_Changed").alias("HeatPump_HeatingLimitSetting_TooHigh"),
        F.when(after, F.col("HeatPump_HeatingLimitSetting_AfterVisit")).otherwise(F.col("HeatPump_HeatingLimitSetting_BeforeVisit")).alias("HeatPump_HeatingLimitSetting"),
        F.when(after, F.col("HeatPump_NightSetbackSetting_Activated_AfterVisit").cast("double"))
        .otherwise(flag("HeatPump_NightSetbackSetting_Activated_BeforeVisit").cast("double")).alias("HeatPump_NightSetbackSetting_Activated"),
        dhw_code.alias("DHW_TemperatureSetting_Categorization"),
        F.when(dhw_code == 3.0, 1.0).otherwise(0.0).alias("DHW_TemperatureSetting_TooHigh"))


def usable_entities(df: DataFrame, key: list[str], value: str, min_values: int) -> DataFrame:
    """Entities with enough values, and the reason for the others."""
    g = df.groupBy(*key).agg(F.count("*").alias("n"), F.count(value).alias("nv"))
    return g.select(*key, (F.col("nv") >= min_values).alias("usable"),
                    F.when(F.col("nv") == 0, "no values").when(F.col("nv") < min_values, "too few values").alias("reason"),
                    (F.col("n") - F.col("nv")).alias("n_filled"))


def filter_pool(pool: DataFrame, other_heating: list[Column], dwelling: Column | None = None) -> DataFrame:
    """Households without any other electric heating and of the wanted dwelling kind."""
    keep = ~any_of(other_heating)
    return pool.where(keep if dwelling is None else keep & dwelling)


def restrict_pool(pool: DataFrame, ids: DataFrame, hh: str) -> DataFrame:
    return pool.join(ids.select(hh).distinct(), hh, "left_semi")


def combine_pools(pools: dict[str, DataFrame], hh: str, station: str, alias: dict[str, str]) -> DataFrame:
    """Union of pools with source-prefixed ids and one station naming."""
    names = F.create_map(*[F.lit(x) for kv in alias.items() for x in kv]) if alias else None
    parts = [p.withColumn(hh, F.concat(F.lit(f"{n}:"), F.col(hh).cast("string"))).withColumn("source", F.lit(n)) for n, p in pools.items()]
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return out if names is None else out.withColumn(station, F.coalesce(names[F.col(station)], F.col(station)))


def pair_units(meters: DataFrame, obj: str, kind: str, dwelling: str, heatpump: str, meter: str) -> DataFrame:
    """Dwelling and heat-pump meters of one object: first of each by id; `state` tells pairs from one-sided objects."""
    g = meters.where(F.col(obj).isNotNull()).groupBy(obj).agg(
        F.min(F.when(F.col(kind) == dwelling, F.col(meter))).alias("own_meter"),
        F.min(F.when(F.col(kind) == heatpump, F.col(meter))).alias("hp_meter"))
    return g.select("*", F.when(F.col("own_meter").isNull(), "heat pump only").when(F.col("hp_meter").isNull(), "dwelling only").otherwise("paired").alias("state")
                    ).where("own_meter IS NOT NULL OR hp_meter IS NOT NULL")


def missing_ids(overview: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """Ids of the overview without data; empty when complete."""
    return overview.select(key).distinct().join(present.select(key).distinct(), key, "left_anti")


def available_variables(matrix: DataFrame, key: str) -> DataFrame:
    """Station x variable booleans to one row per available variable."""
    return matrix.unpivot([key], [c for c in matrix.columns if c != key], "variable", "ok").where("ok").drop("ok")


def describe_variable(dictionaries: list[DataFrame], name: str = "variable") -> DataFrame:
    """Union of description tables; the first table that knows a variable wins."""
    u = reduce(lambda a, b: a.unionByName(b), [t.withColumn("_p", F.lit(i)) for i, t in enumerate(dictionaries)])
    rest = [c for c in u.columns if c not in (name, "_p")]
    return u.groupBy(name).agg(F.min_by(F.struct(*rest), F.struct("_p", *rest)).alias("_r")).select(name, "_r.*")
