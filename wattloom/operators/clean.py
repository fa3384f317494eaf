"""Cleaning of meter series: duplicates, grids, gaps, coverage, runs, counters, rules."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.holidays import is_holiday
from ..functions.scan import DAY, chunked_scan, time_chunk
from ..functions.timeparts import cyclic, season


# ------------------------------------------------------------------ clocks and calendar
def add_temporal(df: DataFrame, ts: str = "ts", calendar: str = "CH-ZH") -> DataFrame:
    """Calendar, clock, day-part, season and cyclic columns of a timestamp (local clock expected)."""
    t = F.col(ts)
    day, h, dow, s = F.to_date(t), F.hour(t), F.weekday(t), season(t)
    part = lambda a, b: (h >= a) & (h < b)
    minute = h * 60 + F.minute(t)
    return df.select(
        *df.columns, day.alias("date"), F.date_format(t, "HH:mm:ss").alias("time"), F.year(t).alias("year"), F.month(t).alias("month"),
        F.weekofyear(t).alias("week"), dow.alias("day_of_week"), F.dayofyear(t).alias("day_of_year"), h.alias("hour"), F.minute(t).alias("minute"),
        minute.alias("minute_of_day"), (dow <= 4).alias("weekday"), (dow >= 5).alias("weekend"), is_holiday(day, calendar).alias("public_holiday"),
        part(6, 10).alias("morning"), part(10, 14).alias("noon"), part(14, 18).alias("afternoon"), part(18, 23).alias("evening"),
        part(6, 23).alias("day"), (~part(6, 23)).alias("night"), s.alias("season"), (s == 1).alias("winter"), (s == 2).alias("spring"),
        (s == 3).alias("summer"), (s == 4).alias("autumn"), s.isin(2, 4).alias("transition"),
        *cyclic(minute, 1440.0, "time_of_day"), *cyclic(F.dayofyear(t), 365.0, "day_of_year"), *cyclic(dow, 7.0, "day_of_week"))


def around_date(df: DataFrame, day: str, visit: str, before: int | None, after: int | None) -> DataFrame:
    """Rows within months before and after the entity's visit date."""
    c = F.lit(True)
    if before is not None:
        c = c & (F.col(day) >= F.add_months(visit, -before))
    if after is not None:
        c = c & (F.col(day) <= F.add_months(visit, after))
    return df.where(c)


def visit_phase(day: Column, visit: Column) -> Column:
    return F.when(day < visit, "before visit").when(day > visit, "after visit").otherwise("during visit")


# ------------------------------------------------------------------ duplicates, grid, gaps
def dedupe_first(df: DataFrame, key: list[str], tiebreak: str) -> DataFrame:
    """First row per key by the tiebreak column; an aggregate with map-side combine, so copies of one key
    are reduced before they travel."""
    rest = [c for c in df.columns if c not in key]
    return (df.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(tiebreak, *[c for c in rest if c != tiebreak])).alias("_r"))
            .select(*key, "_r.*"))


def complete_grid(df: DataFrame, key: list[str], ts: str, start: str, end: str, step: str) -> DataFrame:
    """Every step of [start, end] for every entity; absent rows have NULL values."""
    ent = df.select(*key).distinct()
    grid = ent.withColumn(ts, F.explode(F.expr(f"sequence(timestamp'{start}', timestamp'{end}', interval {step})")))
    # the planner takes the grid for as small as its entities and would broadcast it where a filter allows that
    return grid.join(df.hint("merge"), key + [ts], "left")


def local_slots(df: DataFrame, ts: str, tz: str, step_min: int) -> DataFrame:
    """Local day and clock slot of a UTC timestamp (repeated autumn hours share a slot)."""
    loc = F.from_utc_timestamp(F.col(ts), tz)
    return df.withColumn("day", F.to_date(loc)).withColumn("slot", F.floor((F.hour(loc) * 60 + F.minute(loc)) / step_min).cast("int"))


def neighbours(df: DataFrame, key: list[str], ts: str, value: str, chunk_seconds: int = 7 * DAY) -> DataFrame:
    """Nearest non-NULL value at or before (`_p`) and at or after (`_n`) each row, as (t, v) structs."""
    v = F.col(value)
    at = F.when(v.isNotNull(), F.struct(F.unix_timestamp(ts).alias("t"), v.alias("v")))
    return chunked_scan(df, key, [ts], time_chunk(ts, chunk_seconds), {"_p": ("last", at), "_n": ("next", at)})


def line_between(ts: str, value: str, limit: int | None = None, step_seconds: int | None = None, edges: bool = True) -> Column:
    """Value on the line between the neighbours of a row. `limit` fills at most that many steps from EACH side of a gap; `edges`
    carries the nearest value outward where there is no neighbour on one side."""
    v, t, p, n = F.col(value), F.unix_timestamp(ts), F.col("_p"), F.col("_n")
    line = p["v"] + (n["v"] - p["v"]) * (t - p["t"]) / F.nullif((n["t"] - p["t"]).cast("double"), F.lit(0.0))
    if limit is not None:
        line = F.when(F.least((t - p["t"]), (n["t"] - t)) <= limit * step_seconds, line)
    filled = F.when(v.isNotNull(), v).when(p.isNotNull() & n.isNotNull(), line)
    return F.coalesce(filled, F.when(n.isNull(), p["v"]), F.when(p.isNull(), n["v"])) if edges else filled


def interpolate(df: DataFrame, key: list[str], ts: str, value: str, out: str | None = None, limit: int | None = None,
                step_seconds: int | None = None, edges: bool = True, chunk_seconds: int = 7 * DAY) -> DataFrame:
    """Linear interpolation in time of NULL values (see `line_between`)."""
    d = neighbours(df, key, ts, value, chunk_seconds)
    return d.withColumn(out or value, line_between(ts, value, limit, step_seconds, edges)).drop("_p", "_n")


def coverage(df: DataFrame, key: list[str], valid: Column, expected: int, per_day: int, day: str = "day", day_share: float = 0.9) -> DataFrame:
    """Share of expected slots that are valid and number of days at or above `day_share`; taken before gap filling."""
    d = df.where(valid).groupBy(*key, day).agg(F.count("*").alias("_n"))
    return d.groupBy(*key).agg((F.sum("_n") / F.lit(float(expected))).alias("coverage"),
                               F.count_if(F.col("_n") >= day_share * per_day).cast("bigint").alias("n_valid_days"))


# ------------------------------------------------------------------ runs
def runs(df: DataFrame, key: list[str], ts: str, hit: Column, extra: dict[str, Column] | None = None, chunk_seconds: int = 7 * DAY) -> DataFrame:
    """Maximal runs of rows where `hit` holds: start, end, length. A run is named by the last row before it that breaks it,
    so a long run needs no single-task scan."""
    d = (df.withColumn("_hit", F.coalesce(hit, F.lit(False)))
         .transform(lambda x: chunked_scan(x, key, [ts], time_chunk(ts, chunk_seconds),
                                           {"_brk": ("last", F.when(~F.col("_hit"), F.col(ts)))})))
    return (d.where("_hit").groupBy(*key, "_brk")
            .agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count("*").cast("bigint").alias("length"),
                 *[c.alias(n) for n, c in (extra or {}).items()]).drop("_brk"))


def longest_zero_run(df: DataFrame, key: list[str], ts: str, value: str) -> DataFrame:
    r = runs(df, key, ts, F.col(value) == 0)
    return (df.select(*key).distinct().join(r.groupBy(*key).agg(F.max("length").alias("m")), key, "left")
            .select(*key, F.coalesce("m", F.lit(0)).cast("bigint").alias("zero_run_max")))


def first_failed_rule(rules: dict[str, Column]) -> Column:
    """Name of the first rule that holds (the sequential drop count), NULL when none does."""
    c = None
    for n, r in rules.items():
        c = F.when(r, n) if c is None else c.when(r, n)
    return c


def zero_run_dropouts(df: DataFrame, key: list[str], ts: str, power: str, heat: str, t_day: str, step_seconds: int, min_slots: int = 12,
                      t_max: float = 12.0, heat_tol: float = 0.1, context: int = 24) -> DataFrame:
    """Runs of exact zeros that are electricity dropouts: long enough, starting on a cold day, and with heat inside the run or
    silent heat (heat > 1 kW, power < 0.02 kW) within `context` slots of it."""
    r = runs(df, key, ts, F.col(power) == 0, {"t_start": F.min_by(t_day, ts), "heat_max": F.max(F.coalesce(heat, F.lit(0.0)))})
    long_cold = r.where((F.col("length") >= min_slots) & (F.col("t_start") < t_max))
    silent = df.where((F.col(heat) > 1.0) & (F.col(power) < 0.02)).select(*key, F.unix_timestamp(ts).alias("_s"))
    pad = context * step_seconds
    # buckets turn the range condition into an equi join; none is longer than the padded range, so it holds at most one end of it
    # and its first and last silent stamp tell whether one lies inside
    width = max(step_seconds, min(DAY, 2 * pad))
    bucket = lambda c: F.floor(F.col(c) / width)
    spread = long_cold.select(*key, "start", (F.unix_timestamp("start") - pad).alias("_a"), (F.unix_timestamp("end") + pad).alias("_b"))
    spread = spread.withColumn("_d", F.explode(F.sequence(bucket("_a"), bucket("_b"))))
    per_bucket = silent.groupBy(*key, bucket("_s").alias("_d")).agg(F.min("_s").alias("_first"), F.max("_s").alias("_last"))
    near = (spread.join(per_bucket, key + ["_d"]).where((F.col("_last") >= F.col("_a")) & (F.col("_first") <= F.col("_b")))
            .select(*key, "start").distinct().withColumn("near_silent", F.lit(True)))
    return (long_cold.join(near, key + ["start"], "left").withColumn("near_silent", F.coalesce("near_silent", F.lit(False)))
            .withColumn("dropout", (F.col("heat_max") > heat_tol) | F.col("near_silent")))


def silent_shares(df: DataFrame, key: list[str], power: str, heat: str, backup: str | None = None) -> DataFrame:
    """Share of heating slots with silent electricity, and the share of backup heat in the top-load slots."""
    heating = F.col(heat) > 1.0
    aggs = [F.count_if(heating).cast("bigint").alias("n_heat"),
            (F.count_if(heating & (F.col(power) < 0.02)) / F.nullif(F.count_if(heating), F.lit(0))).alias("silent_share")]
    if backup:
        aggs.append((F.count_if(F.col(backup) > 0.1) / F.nullif(F.count(F.col(backup)), F.lit(0))).alias("backup_share"))
    return df.groupBy(*key).agg(*aggs)


def fill_gaps(df: DataFrame, key: list[str], ts: str, value: str, t_day: str, off_day: str, max_gap: int, slots_per_day: int) -> DataFrame:
    """Two tiers on a complete grid: NULL runs of at most `max_gap` slots are interpolated, other NULL slots are taken from the
    household's complete day of the same day type with the nearest daily temperature (earliest on ties). Columns day, slot must exist.
    Adds `filled` and `n_donor_days`."""
    g = neighbours(df, key, ts, value)
    short = (F.col("_n.t") - F.col("_p.t")) / (86400 // slots_per_day) - 1 <= max_gap
    g = g.withColumn("_v", F.coalesce(F.col(value), F.when(short, line_between(ts, value, edges=False)))).drop("_p", "_n")
    days = g.groupBy(*key, "day").agg(F.first(t_day, True).alias("_T"), F.first(off_day, True).alias("_we"),
                                      (F.count("_v") == slots_per_day).alias("_full"))
    donors = nearest_by_value(days.where(~F.col("_full")), days.where("_full"), key + ["_we"], "_T", "day")
    src = g.select(*key, F.col("day").alias("_src"), F.col("slot").alias("_slot"), F.col("_v").alias("_dv"))
    n_bad = days.groupBy(*key).agg(F.count_if(~F.col("_full")).cast("bigint").alias("n_donor_days"))
    holes = (g.where("_v IS NULL").join(donors.select(*key, "day", "_src"), key + ["day"], "left")
             .withColumn("_slot", F.col("slot")).join(src, key + ["_src", "_slot"], "left").select(*key, "day", "slot", "_dv"))
    return (g.join(holes, key + ["day", "slot"], "left").withColumn("filled", F.coalesce("_v", "_dv"))
            .join(n_bad, key).drop("_v", "_dv"))


def nearest_by_value(target: DataFrame, cand: DataFrame, key: list[str], value: str, day: str) -> DataFrame:
    """For each target row the candidate of its key with the nearest value (earliest day on ties), as `_src`.

    Both sides are merged in value order and each target looks at its neighbours below and above; no pairs are formed."""
    both = target.select(*key, value, day, F.lit(True).alias("_is_t")).unionByName(cand.select(*key, value, day, F.lit(False).alias("_is_t")))
    c = F.when(~F.col("_is_t"), F.struct(F.col(value).alias("v"), (-F.datediff(day, F.lit("1900-01-01"))).alias("nd")))
    # below: among equal values the earliest day sorts last; above: the earliest day sorts first
    lo = both.withColumn("_ord", F.when(F.col("_is_t"), 1).otherwise(0)).withColumn("_nd", -F.datediff(day, F.lit("1900-01-01")))
    wl = W.partitionBy(*key).orderBy(F.col(value), F.col("_ord"), F.col("_nd")).rowsBetween(W.unboundedPreceding, 0)
    wh = W.partitionBy(*key).orderBy(F.col(value).desc(), F.col("_ord"), F.col("_nd")).rowsBetween(W.unboundedPreceding, 0)
    x = lo.withColumn("_below", F.last(c, True).over(wl)).withColumn("_above", F.last(c, True).over(wh)).where("_is_t")
    b, a, v = F.col("_below"), F.col("_above"), F.col(value)
    gb, ga = v - b["v"], a["v"] - v
    pick_b = a.isNull() | (b.isNotNull() & ((gb < ga) | ((gb == ga) & (b["nd"] >= a["nd"]))))
    nd = F.when(pick_b, b["nd"]).otherwise(a["nd"])
    return x.withColumn("_src", F.date_add(F.lit("1900-01-01").cast("date"), (-nd).cast("int"))).select(*key, value, day, "_src")


def counters_to_power(df: DataFrame, key: list[str], ts: str, counter: str, step_seconds: int, max_kw: float, bin_minutes: int = 30,
                      min_n: int = 12, full_n: int = 15) -> DataFrame:
    """Cumulative kWh counters to mean kW per bin: consecutive steps only, negative or too large differences are NULL, energy belongs
    to the slot before; bins with at least `min_n` steps are rescaled to the full count."""
    at = F.struct(F.unix_timestamp(ts).alias("t"), F.col(counter).alias("v"))
    d = chunked_scan(df, key, [ts], time_chunk(ts), {"_p": ("prev", at)})
    t, p = F.unix_timestamp(ts), F.col("_p")
    e = F.when(t - p["t"] == step_seconds, F.col(counter) - p["v"])
    e = F.when((e >= 0) & (e <= max_kw * step_seconds / 3600.0), e)
    b = bin_minutes * 60
    return (d.withColumn("_e", e).withColumn("bin", F.timestamp_seconds(F.floor((t - step_seconds) / b) * b))
            .groupBy(*key, "bin").agg(F.sum("_e").alias("_s"), F.count("_e").cast("bigint").alias("n"))
            .select(*key, "bin", "n", F.when(F.col("n") >= min_n, F.col("_s") * (60.0 / bin_minutes) * full_n / F.col("n")).alias("kw")))


def null_hygiene(df: DataFrame, cols: list[str], fill: float | None = None, clip: bool = False) -> DataFrame:
    """NaN and infinities become NULL, then optional fill of numeric columns and clipping at 0."""
    for c in cols:
        x = F.col(c).cast("double")
        x = F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)
        if clip:
            x = F.greatest(x, F.lit(0.0))
        df = df.withColumn(c, F.coalesce(x, F.lit(fill)) if fill is not None else x)
    return df


def plausible(t: Column, lo: float = -30.0, hi: float = 40.0) -> Column:
    return F.when(t.between(lo, hi), t)


def step_seconds_of(df: DataFrame, key: list[str], ts: str) -> DataFrame:
    """Smallest distance between consecutive stamps per entity, and the point count that makes up `min_days` days."""
    d = chunked_scan(df, key, [ts], time_chunk(ts), {"_p": ("prev", F.unix_timestamp(ts))})
    return d.groupBy(*key).agg(F.min(F.unix_timestamp(ts) - F.col("_p")).alias("step_seconds"))


def min_points(step_seconds: Column, min_days: int = 20) -> Column:
    return F.greatest(F.lit(4), F.ceil(min_days * 86400.0 / step_seconds)).cast("bigint")
