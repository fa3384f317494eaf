"""Grouped reductions: resolution change, daily pairs, windowed features, coverage, climate, distances, summaries (A rows)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import stats as S
from ..functions.scan import chunked_scan, exact_quantiles, time_chunk
from ..functions.timeparts import SEVERITY, WINDOWS, clock_window, severity_bin

PAIRS = (("mild", "warm"), ("cold", "warm"), ("extreme", "warm"), ("extreme", "cold"))
COMPARED = ("Mean", "Std", "Q50", "Q95", "Max")
EPS = 1e-6


# ------------------------------------------------------------------ resolution
def rule_of(name: str) -> str:
    """Reduction of a column chosen from its name."""
    n = name.lower()
    if "_max_" in n:
        return "max"
    if "_min_" in n:
        return "min"
    if "kwh_" in n or "kvarh_" in n or "_total_" in n or "_duration_" in n:
        return "sum"
    return "mean" if "_mean_" in n else "first"


def time_bin(ts: Column, unit: str) -> Column:
    """Start of the bin that holds the stamp: a calendar unit (hour, day, month ...) or a number of minutes ('15 minutes', '30 minutes'), counted from midnight UTC."""
    n, _, word = unit.partition(" ")
    if not word:
        return F.date_trunc(unit, ts)
    if not word.startswith("minute") or 1440 % int(n):
        raise ValueError(f"{unit}: minutes that divide a day are wanted")
    seconds = 60 * int(n)
    return F.timestamp_seconds(F.floor(F.unix_timestamp(ts) / seconds) * seconds)


def change_resolution(df: DataFrame, key: list[str], ts: str, unit: str, skip_null: bool = False) -> DataFrame:
    """Reduce to some minutes, hour, day or month. Sums and means are NULL when a value of the bin is missing, unless `skip_null`."""
    aggs = []
    for c in df.columns:
        if c in key or c == ts:
            continue
        r, x = rule_of(c), F.col(c)
        whole = F.lit(True) if skip_null else F.count(x) == F.count("*")
        aggs.append({"max": lambda: F.max(x), "min": lambda: F.min(x), "sum": lambda: F.when(whole, F.sum(x)),
                     "mean": lambda: F.when(whole, F.avg(x)), "first": lambda: F.min(F.when(x.isNotNull(), F.struct(F.col(ts), x.alias("v")))).getField("v")}[r]().alias(c))
    return df.groupBy(*key, time_bin(F.col(ts), unit).alias("_bin")).agg(*aggs).withColumnRenamed("_bin", ts)


# ------------------------------------------------------------------ daily pairs
def daily_min_max(df: DataFrame, key: list[str], day: str, t: str, y: str, season_below: float = 12.0) -> DataFrame:
    """Daily minimum temperature and maximum load, heating season only."""
    return df.groupBy(*key, day).agg(F.min(t).alias("t_min"), F.max(y).alias("y_max")).where((F.col("t_min") < season_below) & F.col("y_max").isNotNull())


def daily_means(df: DataFrame, key: list[str], day: str, t: str, y: str, season_below: float | None = None) -> DataFrame:
    """Daily mean temperature and load; days without both are left out."""
    g = df.groupBy(*key, day).agg(F.avg(t).alias("t"), F.avg(y).alias("y")).where("t IS NOT NULL AND y IS NOT NULL")
    return g if season_below is None else g.where(F.col("t") < season_below)


def daily_degree_hours(df: DataFrame, key: list[str], day: str, t: str, y: str, dt_hours: float, threshold: float = 12.0) -> DataFrame:
    """Heating degree hours, mean load and energy of each day."""
    g = df.groupBy(*key, day).agg((F.sum(F.greatest(F.lit(0.0), threshold - F.col(t))) * dt_hours).alias("hdh"),
                                  F.avg(y).alias("mean_load"), (F.sum(y) * dt_hours).alias("energy"))
    return g.where("hdh IS NOT NULL AND mean_load IS NOT NULL")


# ------------------------------------------------------------------ windowed degree-day features
def regular_slots(df: DataFrame, key: list[str], ts: str, cols: list[str], minutes: int) -> DataFrame:
    """Means of the columns by `minutes`; missing slots between a series' first and last value take the value before, also over the borders of scanned chunks. Slots in which
    some column has no value left out."""
    d = df.groupBy(*key, time_bin(F.col(ts), f"{minutes} minutes").alias(ts)).agg(*[F.avg(c).alias(c) for c in cols])
    span = d.groupBy(*key).agg(F.min(ts).alias("_a"), F.max(ts).alias("_z"), *[F.max(F.when(F.col(c).isNotNull(), F.col(ts))).alias(f"_end_{c}") for c in cols])
    grid = span.withColumn(ts, F.explode(F.sequence("_a", "_z", F.expr(f"INTERVAL {minutes} MINUTES")))).drop("_a", "_z").join(d, [*key, ts], "left")
    filled = chunked_scan(grid, key, [ts], time_chunk(ts), {f"_f_{c}": ("last", F.col(c)) for c in cols})
    value = [F.when(F.col(ts) <= F.col(f"_end_{c}"), F.col(f"_f_{c}")).alias(c) for c in cols]
    return filled.select(*key, ts, *value).dropna(subset=cols)


def _by_severity(days: DataFrame, key: list[str], mild: float, cold: float) -> DataFrame:
    """One row per day and clock window with its values, from one row per day with a column of values for each window."""
    w = F.explode(F.array(*[F.struct(F.lit(w).alias("window"), F.col(w).alias("v")) for w in WINDOWS])).alias("_w")
    return days.select(*key, "_day", "_sev", w).select(*key, "_day", "_sev", "_w.*").where(F.size("v") > 0).withColumn("bin", severity_bin(F.col("_sev"), mild, cold))


def day_windows(slots: DataFrame, key: list[str], ts: str, t: str, y: str, base: float, hours: float, mild: float, cold: float) -> DataFrame:
    """Values (y, t, degree hours) of each day and clock window and the severity bin of the day, in one exchange: a day's slots are one short list."""
    h = F.greatest(F.lit(0.0), base - F.col(t))
    value = F.struct(F.col(y).cast("double").alias("y"), F.col(t).cast("double").alias("t"), h.alias("h"))
    d = slots.groupBy(*key, F.to_date(ts).alias("_day")).agg((F.sum(h) * hours).alias("_sev"), *[F.collect_list(F.when(clock_window(F.col(ts)) == w, value)).alias(w) for w in WINDOWS])
    return _by_severity(d, key, mild, cold)


def array_windows(days: DataFrame, key: list[str], day: str, t: str, values: str, n: int, base: float, mild: float, cold: float) -> DataFrame:
    """The same from one row per day with an array of `n` slot values and the day's temperature: nothing is exchanged."""
    h, ends = F.greatest(F.lit(0.0), base - F.col(t)), [0, n // 4, 10 * n // 24, 16 * n // 24, n]      # fixed values: hours 6, 10 and 16 begin a window
    cut = lambda lo, hi: F.transform(F.slice(values, lo + 1, hi - lo), lambda x: F.struct(x.alias("y"), F.col(t).cast("double").alias("t"), h.alias("h")))
    return _by_severity(days.select(*key, F.col(day).alias("_day"), (h * 24).alias("_sev"), *[cut(lo, hi).alias(w) for w, lo, hi in zip(WINDOWS, ends, ends[1:])]), key, mild, cold)


def cell_statistics(long: DataFrame, key: list[str], with_corr: bool = False) -> tuple[DataFrame, list[str]]:
    """Distribution statistics per (entity, clock window, severity bin), long. A cell's values are at most the calendar's slots of an entity; they are gathered once and
    every statistic, quantiles included, is read off the sorted list."""
    c = long.groupBy(*key, "window", "bin").agg(F.flatten(F.collect_list("v")).alias("v"), F.count("*").cast("double").alias("N_days"))
    total = lambda a, f: F.aggregate(a, F.lit(0.0), lambda s, x: s + f(x))
    c = c.withColumn("_s", F.array_sort(F.transform("v", lambda x: x["y"]))).withColumn("n", F.size("v").cast("double"))
    n, s = F.col("n"), F.col("_s")
    c = c.withColumns({"_my": total(s, lambda x: x) / n, **({f"_m{x}": total(F.col("v"), lambda r: r[x]) / n for x in "th"} if with_corr else {})})
    my = F.col("_my")
    c = c.withColumns({"_2": total(s, lambda x: (x - my) * (x - my)), "_3": total(s, lambda x: (x - my) * (x - my) * (x - my)), "_4": total(s, lambda x: (x - my) * (x - my) * (x - my) * (x - my))})
    m2, m3, m4 = (F.col(f"_{i}") for i in (2, 3, 4))

    def quantile(q: float) -> Column:
        r = (n - 1) * q
        lo, hi = s[F.floor(r).cast("int")], s[F.least(F.floor(r) + 1, n - 1).cast("int")]
        return lo + (hi - lo) * (r - F.floor(r))
    low, high = s[0], F.element_at(s, -1)
    aggs = {"Mean": my, "Std": F.when(n >= 2, F.sqrt(m2 / (n - 1))), "Min": low, "Max": high, "Max-Min": high - low,
            "Skew": F.when((n >= 3) & (m2 > 0), F.sqrt(n * (n - 1)) / (n - 2) * (m3 / n) / F.pow(m2 / n, 1.5)),
            "Kurtosis": F.when((n >= 4) & (m2 > 0), (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * (m4 * n / (m2 * m2) - 3) + 6)), "N_obs": n, "Q50": quantile(0.5), "Q95": quantile(0.95), "N_days": F.col("N_days")}
    if with_corr:
        for x, name in (("t", "Temp"), ("h", "HDH")):
            mx = F.col(f"_m{x}")
            cov = total(F.col("v"), lambda r: (r["y"] - my) * (r[x] - mx))  # noqa: B023
            sq = total(F.col("v"), lambda r: (r[x] - mx) * (r[x] - mx))  # noqa: B023
            aggs |= {f"Cov_{name}": F.when(n >= 2, cov / (n - 1)), f"Corr_{name}": F.when((n >= 3) & (m2 > 0) & (sq > 0), cov / F.sqrt(m2 * sq))}
    return c.select(*key, "window", "bin", *[x.alias(k) for k, x in aggs.items()]), list(aggs)


def wide_features(long: DataFrame, key: list[str], with_corr: bool = False, peak_norm: bool = False, climate: bool = False) -> DataFrame:
    """One wide row per entity: statistics of 4 clock windows x 4 severity bins, then delta, ratio and normalised delta of bin pairs; on wish also values over the peak
    load, and mean, deviation and maximum of the days' severity with their number."""
    cells, stats = cell_statistics(long, key, with_corr)
    cells = cells.withColumn("_cell", F.concat_ws("_", "window", "bin"))
    names = [f"{w}_{b}" for w in WINDOWS for b in SEVERITY]
    wide = cells.groupBy(*key).pivot("_cell", names).agg(*[F.first(f"`{s}`").alias(s) for s in stats])
    col = lambda w, b, s: F.col(f"`{w}_{b}_{s}`")
    zero = {"N_obs", "N_days"}
    out = [*[F.col(k) for k in key]] + [(F.coalesce(col(w, b, s), F.lit(0.0)) if s in zero else col(w, b, s)).alias(f"Feature {w}_{b}_{s}")
                                        for w in WINDOWS for b in SEVERITY for s in stats]
    for w in WINDOWS:
        for hi, lo in PAIRS:
            for s in COMPARED:
                h, l = col(w, hi, s), col(w, lo, s)
                out += [(h - l).alias(f"Feature {w}_delta_{s}_{hi}_{lo}"), (h / (l + EPS)).alias(f"Feature {w}_ratio_{s}_{hi}_{lo}"),
                        ((h - l) / (l + EPS)).alias(f"Feature {w}_normdelta_{s}_{hi}_{lo}")]
    peak = F.greatest(*[col(w, b, "Max") for w in WINDOWS for b in SEVERITY])
    if peak_norm:                                             # the highest value of any cell is the highest of all
        plain = [f"{w}_{b}_{s}" for w in WINDOWS for b in SEVERITY for s in stats if s in ("Mean", "Std", "Min", "Max", "Max-Min", "Q50", "Q95")]
        out += [(F.col(f"`{c}`") / F.nullif(peak, F.lit(0.0))).alias(f"Feature {c}_norm_peak") for c in plain]
    res = wide.select(*out)
    if climate:
        days = long.groupBy(*key, "_day").agg(F.first("_sev").alias("_sev"))
        res = res.join(days.groupBy(*key).agg(F.avg("_sev").alias("Feature Daily_HDH_Severity_Mean"), S.std_guarded("_sev").alias("Feature Daily_HDH_Severity_Std"),
                                              F.max("_sev").alias("Feature Daily_HDH_Severity_Max"), F.count("*").cast("double").alias("Feature N_weekdays")), key)
    return res


def windowed_features(slots: DataFrame, key: list[str], ts: str, t: str, y: str, base: float = 12.0, mild: float = 10.0, cold: float = 25.0,
                      hours: float = 1.0, weekday_only: bool = True, with_corr: bool = False, peak_norm: bool = False, resolution: int | None = None, climate: bool = False) -> DataFrame:
    """Windowed features of slots. `resolution`: minutes to which the series are brought first, gaps filled with the value before (`hours` follows from it)."""
    if resolution:
        slots, hours = regular_slots(slots, key, ts, [t, y], resolution), resolution / 60
    d = slots.where(F.col(t).isNotNull() & F.col(y).isNotNull())
    if weekday_only:
        d = d.where(F.weekday(ts) < 5)
    return wide_features(day_windows(d, key, ts, t, y, base, hours, mild, cold), key, with_corr, peak_norm, climate)


def scale_free(columns: list[str]) -> list[str]:
    return [c for c in columns if c.endswith("_norm_peak") or "ratio_" in c or "normdelta_" in c]


# ------------------------------------------------------------------ peaks, coverage, climate
def robust_peak(df: DataFrame, key: list[str], value: str, q: float = 0.999) -> DataFrame:
    """Exact high quantile and plain maximum of the valid samples."""
    return exact_quantiles(df, key, value, {"robust_peak": q}).join(df.groupBy(*key).agg(F.max(value).alias("peak")), key)


def season_windows(first_year: int, last_year: int) -> list[tuple[str, str, str]]:
    """Calendar years and Nov-Mar seasons as (label, start, exclusive end)."""
    cal = [(f"cal{y}", f"{y}-01-01", f"{y + 1}-01-01") for y in range(first_year, last_year + 1)]
    return cal + [(f"w{y}", f"{y}-11-01", f"{y + 1}-04-01") for y in range(first_year, last_year + 1)]


def in_windows(df: DataFrame, day: str, windows: list[tuple[str, str, str]]) -> DataFrame:
    """One row per window a day belongs to; the windows are plan literals, so nothing is joined."""
    hits = F.array(*[F.when((F.col(day) >= F.lit(a).cast("date")) & (F.col(day) < F.lit(b).cast("date")), F.lit(n)) for n, a, b in windows])
    return df.withColumn("window", F.explode(F.filter(hits, lambda x: x.isNotNull())))


def climate(daily: DataFrame, station: str, t: str) -> DataFrame:
    """Mean and 5th percentile of the station's daily temperature."""
    return exact_quantiles(daily, [station], t, {"T_q05": 0.05}).join(daily.groupBy(station).agg(F.avg(t).alias("T_mean")), station)


# ------------------------------------------------------------------ distances of samples
def sample_distances(df: DataFrame, key: list[str], value: str, is_a: Column) -> DataFrame:
    """Kolmogorov-Smirnov and Wasserstein-1 distance of two samples per key.

    Equal values are counted first; cumulative counts run over value ranges, so a large sample is spread over tasks."""
    c = df.where(F.col(value).isNotNull()).groupBy(*key, F.col(value).alias("_x")).agg(
        F.sum(is_a.cast("bigint")).alias("_a"), F.sum((~is_a).cast("bigint")).alias("_b"))
    marks = c.groupBy(*key).agg(F.percentile_approx("_x", [i / 64 for i in range(1, 64)], 640).alias("_m"))
    d = c.join(marks, key).withColumn("_k", F.size(F.filter("_m", lambda m: m < F.col("_x")))).drop("_m")
    d = chunked_scan(d, key, ["_x"], F.col("_k"), {"_ca": ("sum", F.col("_a")), "_cb": ("sum", F.col("_b")), "_px": ("prev", F.col("_x"))})
    tot = c.groupBy(*key).agg(F.sum("_a").alias("_na"), F.sum("_b").alias("_nb"))
    d = d.join(tot, key)
    fa, fb = F.col("_ca") / F.nullif("_na", F.lit(0)), F.col("_cb") / F.nullif("_nb", F.lit(0))
    # the step up to this value belongs to the cumulative shares before it
    ga, gb = (F.col("_ca") - F.col("_a")) / F.nullif("_na", F.lit(0)), (F.col("_cb") - F.col("_b")) / F.nullif("_nb", F.lit(0))
    return d.groupBy(*key).agg(F.max(F.abs(fa - fb)).alias("ks"), F.coalesce(F.sum(F.abs(ga - gb) * (F.col("_x") - F.col("_px"))), F.lit(0.0)).alias("w1"),
                               F.max("_na").alias("n_a"), F.max("_nb").alias("n_b"))


# ------------------------------------------------------------------ scores and summaries
def score(df: DataFrame, key: list[str], y: str = "y", p: str = "p") -> DataFrame:
    m = S.error_metrics(y, p)
    ok = F.col(p).isNotNull() & F.col(y).isNotNull()
    base = df.where(ok)
    return base.groupBy(*key).agg(F.count("*").cast("bigint").alias("n"), *[c.alias(n) for n, c in m.items()])


def penetration_bin(p: Column) -> Column:
    """Right-closed bins of the share of dwellings with a heat pump."""
    return F.when(p <= 0.15, "pbin<=15").when(p <= 0.35, "pbin15-35").when(p <= 0.65, "pbin35-65").otherwise("pbin>65")


def score_cells(pred: DataFrame, spec: list[str], y: str, p: str, n_hp: str, size: str, pen: str) -> DataFrame:
    """Metrics for all rows, per penetration bin and per (penetration, size) cell in one pass, long."""
    m = S.error_metrics(y, p)
    d = pred.where(F.col(p).isNotNull()).withColumn("_bin", penetration_bin(F.col(n_hp) / F.col(size))).withColumn(
        "_cell", F.concat(F.lit("p="), F.col(pen).cast("string"), F.lit("|size="), F.col(size).cast("string")))
    g = d.groupingSets([[*spec], [*spec, "_bin"], [*spec, "_cell"]], *spec, "_bin", "_cell").agg(
        F.count("*").cast("bigint").alias("n_substations"), *[c.alias(n) for n, c in m.items()])
    g = g.withColumn("cell", F.coalesce("_bin", "_cell", F.lit("all")))
    return g.unpivot([*spec, "cell", "n_substations"], list(m), "metric", "value")


def summarise(df: DataFrame, key: list[str], value: str, band: tuple[float, float] = (0.05, 0.90)) -> DataFrame:
    """n, median, mean, sd and band of a value over its units (seeds)."""
    v = F.col(value)
    return df.where(v.isNotNull() & ~F.isnan(v)).groupBy(*key).agg(
        F.count("*").cast("bigint").alias("n"), F.percentile(value, 0.5).alias("median"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"),
        F.percentile(value, band[0]).alias("q_lo"), F.percentile(value, band[1]).alias("q_hi"))


def segment_score(df: DataFrame, by: list[str], y: str, p: str) -> DataFrame:
    """WAPE, bias, share of the total, and WAPE after the segment's own best rescaling. The grand total comes from the segment
    sums (a handful of rows)."""
    y, p = F.col(y), F.col(p)
    k = df.groupBy(*by).agg((F.sum(y) / F.nullif(F.sum(p), F.lit(0.0))).alias("_k"))
    g = df.join(k, by).groupBy(*by).agg(
        F.count("*").cast("bigint").alias("n"), (F.sum(F.abs(p - y)) / F.nullif(F.sum(y), F.lit(0.0)) * 100).alias("wape"),
        (F.sum(p - y) / F.nullif(F.sum(y), F.lit(0.0)) * 100).alias("bias"), F.sum(y).alias("_y"),
        (F.sum(F.abs(p * F.col("_k") - y)) / F.nullif(F.sum(y), F.lit(0.0)) * 100).alias("wape_rescaled"))
    return g.withColumn("share", F.col("_y") / F.sum("_y").over(W.partitionBy(F.lit(1)))).drop("_y")


def daily_vector(df: DataFrame, key: list[str], day: str, value: str, n: int = 365) -> DataFrame:
    """Values of the first n days of each entity as an array, NULL where a day is missing."""
    start = df.groupBy(*key).agg(F.min(day).alias("_s"))
    d = df.join(start, key).withColumn("_i", F.datediff(day, "_s")).where(F.col("_i") < n)
    m = d.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("_i", value))).alias("_m"))   # at most n entries
    return m.select(*key, F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.col("_m")[i]).alias("vector"))


def distinct_members(members: DataFrame, key: list[str], array_col: str) -> DataFrame:
    return (members.select(*key, F.explode(array_col).alias("_m")).groupBy(*key).agg(F.count_distinct(F.col("_m")).cast("bigint").alias("n_households")))
