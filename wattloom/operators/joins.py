"""Joins of meters, weather and results: interpolated weather, analog days, donor stations, weather groups, comparisons (J rows)."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.hashing import hash_int
from ..session import cut_lineage
from .clean import interpolate


# ------------------------------------------------------------------ meter x weather
def meter_weather(meters: DataFrame, weather: DataFrame, station: str, ts: str, t: str, interpolate_hours: bool = True, key: list[str] | None = None,
                  step_seconds: int = 900, limit: int = 3) -> DataFrame:
    """Hourly weather on meter stamps of all households in one join: exact hours plus interpolation of up to `limit` steps from each side,
    or the hour's value on every stamp of the hour."""
    w = weather.select(station, F.col(ts).alias("_h"), t).dropDuplicates([station, "_h"])
    if interpolate_hours:
        j = meters.join(w, (meters[station] == w[station]) & (meters[ts] == w["_h"]), "left").drop(w[station]).drop("_h")
        return interpolate(j, key, ts, t, limit=limit, step_seconds=step_seconds, edges=False)
    j = meters.withColumn("_h", F.date_trunc("hour", ts)).join(w, [station, "_h"], "left")
    return j.drop("_h")


def station_grid_temperature(hourly: DataFrame, station: str, ts: str, t: str, start: str, end: str, step: str) -> DataFrame:
    """Hourly temperature interpolated onto a finer grid: the union of both stamp sets is filled, then the grid rows are kept."""
    st = hourly.select(station).distinct()
    g = st.withColumn(ts, F.explode(F.expr(f"sequence(timestamp'{start}', timestamp'{end}', interval {step})"))).withColumn("_g", F.lit(True))
    u = hourly.select(station, ts, t).join(g, [station, ts], "full_outer")
    return interpolate(u, [station], ts, t).where("_g").drop("_g")


def align(load: DataFrame, temp: DataFrame, keys: list[str], weekdays_of: str | None = None) -> DataFrame:
    """Inner alignment of load and temperature, NULLs dropped, optionally Monday to Friday only."""
    j = load.join(temp, keys).na.drop()
    return j if weekdays_of is None else j.where(F.weekday(weekdays_of) < 5)


# ------------------------------------------------------------------ analog days
def analog_map(targets: DataFrame, cand: DataFrame, key: list[str], seed: int, windows=(30, 45, 60), tol: float = 1.0, k: int = 3, exclude_days: int = 0) -> DataFrame:
    """Analog day of every target day (key, day, t, off): a candidate of the same day type within a circular day-of-year window and
    temperature tolerance; windows widen only when empty, the last resort drops the tolerance. One of the k nearest is picked by hash.

    Candidates meet targets through buckets of day-of-year and temperature (an equi join), so a target meets only the days near it;
    the few targets without any near day meet their day-of-year buckets alone. Both sides are calendar days."""
    nb, top = 13, windows[-1] // 30 + 1
    around = lambda c, n, m: F.transform(F.sequence(F.lit(-n), F.lit(n)), lambda o: m(c + o))
    doyb = lambda c: F.floor(F.dayofyear(c) / 30).cast("int")
    t = targets.select(*key, "day", F.col("t").alias("t_day"), F.col("off").alias("_off"))
    t = t.withColumn("_b", F.explode(F.array_distinct(around(doyb("day"), top, lambda x: F.pmod(x, F.lit(nb))))))
    c = (cand.select(*key, F.col("day").alias("src"), F.col("t").alias("t_src"), F.col("off").alias("_off")).withColumn("_b", doyb("src"))
         .withColumn("_tb", F.floor(F.col("t_src") / tol).cast("int")))
    dd = F.abs(F.dayofyear("src") - F.dayofyear("day"))

    def shaped(j):
        j = j.withColumn("ddoy", F.least(dd, F.abs(365 - dd))).withColumn("dT", F.col("t_day") - F.col("t_src"))
        return j.where((F.abs(F.datediff("src", "day")) > exclude_days) & (F.col("ddoy") <= windows[-1]))

    lvl = None
    for i, w in enumerate(windows):
        lvl = F.when(F.col("ddoy") <= w, i) if lvl is None else lvl.when(F.col("ddoy") <= w, i)
    near = shaped(t.withColumn("_tb", F.explode(around(F.floor(F.col("t_day") / tol).cast("int"), 1, lambda x: x))).join(c, [*key, "_off", "_b", "_tb"]))
    near = near.where(F.abs("dT") <= tol).withColumn("widen", lvl).select(*key, "day", "src", "dT", "ddoy", "widen")
    lone = t.join(near.select(*key, "day").distinct(), [*key, "day"], "left_anti")
    far = shaped(lone.join(c.drop("_tb"), [*key, "_off", "_b"])).withColumn("widen", F.lit(len(windows))).select(*key, "day", "src", "dT", "ddoy", "widen")
    best = W.partitionBy(*key, "day")
    j = near.unionByName(far).withColumn("_lo", F.min("widen").over(best)).where(F.col("widen") == F.col("_lo"))
    r = j.withColumn("_r", F.row_number().over(best.orderBy(F.abs(F.col("dT")), "src"))).where(F.col("_r") <= k)
    n = r.withColumn("_n", F.count("*").over(best))
    return n.where(F.col("_r") == hash_int(F.lit(seed), F.lit("analog"), *[F.col(x) for x in key], F.col("day")) % F.col("_n") + 1).select(*key, "day", "src", "dT", "ddoy", "widen")


def place_analogs(filler: DataFrame, amap: DataFrame, key: list[str]) -> DataFrame:
    """Filler sums per (set, source day, slot) placed on target days. `filler`: set_id, key, src, slot, kw already summed over members, so the
    join carries one row per set, day and slot."""
    return filler.join(amap.select(*key, "day", "src"), [*key, "src"]).select("set_id", *key, "day", "slot", "kw")


# ------------------------------------------------------------------ stations
def _packed_stations(daily: DataFrame, stations: DataFrame, block: str, other: str, blocks: int, others: int) -> DataFrame:
    """One row per station with its days and means, in the block of its id, once for each block of the other side."""
    p = daily.join(stations.select("station"), "station").groupBy("station").agg(F.array_sort(F.collect_list(F.struct("day", "t"))).alias("v"))
    return p.select(F.pmod(F.xxhash64("station"), F.lit(blocks)).cast("int").alias(block), F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other), "station",
                    F.col("v.day").cast("array<int>").alias("days"), F.col("v.t").alias("ts")).toDF(block, other, "station", "days", "ts")      # columns of its own: both sides come from one table


def donors(daily: DataFrame, bad: DataFrame, ok: DataFrame, min_days: int = 60, size: int = 256) -> DataFrame:
    """For each station of `bad` the station of `ok` with the highest correlation over their shared days (equals: the higher id): station, donor, corr, a, b, n_days_fit.

    Stations meet in pairs of blocks. A pair of blocks is two matrices of days x stations with masks of what is there, and six products of these give the counts and sums of all their
    pairs at once, so no row of station, station and day arises. Stations with too few days pair with nothing."""
    days = daily.where("t IS NOT NULL").withColumn("day", F.datediff("day", F.lit("1970-01-01")))
    enough = days.groupBy("station").agg(F.count("*").alias("n")).where(F.col("n") >= min_days).select("station")
    bad, ok = cut_lineage(bad.join(enough, "station", "left_semi")), cut_lineage(ok.join(enough, "station", "left_semi"))
    nb, no = max(1, -(-bad.count() // size)), max(1, -(-ok.count() // size))

    def matrix(t, first, n):
        x, there = np.zeros((n, t.num_rows)), np.zeros((n, t.num_rows))
        for i, (d, v) in enumerate(zip(t["days"].to_pylist(), t["ts"].to_pylist())):
            at = np.array(d) - first
            x[at, i], there[at, i] = v, 1.0
        mean = x.sum(0) / np.maximum(there.sum(0), 1)
        return (x - mean) * there, there, mean                                # centred: sums of squares don't cancel

    def pair(key, t, o):
        names, kinds = ["station", "donor", "corr", "a", "b", "n_days_fit"], [t.schema.field("station").type, o.schema.field("station").type, pa.float64(), pa.float64(), pa.float64(), pa.int64()]
        if not (t.num_rows and o.num_rows):
            return pa.table([pa.array([], k) for k in kinds], names)
        o = o.sort_by([("station", "descending")])                            # the first of equal correlations has the higher id
        every = np.concatenate([np.concatenate(x["days"].to_pylist()) for x in (t, o)])
        first, n = int(every.min()), int(every.max() - every.min()) + 1
        (x, mx, ax), (y, my, ay) = matrix(t, first, n), matrix(o, first, n)
        c, sx, sy, sxy, sxx, syy = mx.T @ my, x.T @ my, mx.T @ y, x.T @ y, (x * x).T @ my, mx.T @ (y * y)
        with np.errstate(divide="ignore", invalid="ignore"):
            vx, vy, cov = sxx - sx * sx / c, syy - sy * sy / c, sxy - sx * sy / c
            corr = np.where((c >= min_days) & (vx > 1e-12 * sxx) & (vy > 1e-12 * syy), cov / np.sqrt(vx * vy), -np.inf)
            best = corr.argmax(1)
            i = np.flatnonzero(corr[np.arange(len(best)), best] > -np.inf)
            j = best[i]
            b = cov[i, j] / vy[i, j]
            a = ax[i] + sx[i, j] / c[i, j] - b * (ay[j] + sy[i, j] / c[i, j])
        return pa.table([t["station"].combine_chunks().take(pa.array(i)), o["station"].combine_chunks().take(pa.array(j)), pa.array(corr[i, j]), pa.array(a), pa.array(b), pa.array(c[i, j].astype(np.int64))], names)
    kind = daily.schema["station"].dataType.simpleString()
    found = (_packed_stations(days, bad, "_b", "_o", nb, no).groupBy("_b", "_o").cogroup(_packed_stations(days, ok, "_o", "_b", no, nb).groupBy("_b", "_o"))
             .applyInArrow(pair, f"station {kind}, donor {kind}, corr double, a double, b double, n_days_fit long"))
    f = F.max_by(F.struct("donor", "corr", "a", "b", "n_days_fit"), F.struct("corr", "donor"))
    return found.groupBy("station").agg(f.alias("f")).select("station", "f.*")


def slot_station_fill(slots: DataFrame, bins: int, least_bins: int, expected_days: int | None = None, max_missing: float = 0.05, min_corr: float = 0.98, min_days: int = 60) -> tuple[DataFrame, DataFrame]:
    """Fill stations (station, day, slot, t; `bins` slots a day) that miss more than `max_missing` of their slots from the complete station with the highest correlation of
    daily means (days with `least_bins` slots): t = a + b t', fitted on the shared days, for every slot that is missing and that the donor has. Without such a donor
    the station is dropped. Returns (log, filled). `expected_days`: days that a complete station has; all days of the table if not given."""
    have = slots.where("t IS NOT NULL").select("station", "day", "slot", F.col("t").cast("double").alias("t"))
    expected = bins * (slots.select("day").distinct().count() if expected_days is None else expected_days)
    miss = cut_lineage(have.groupBy("station").agg((1 - F.count("*") / F.lit(float(expected))).alias("missing_share")))
    ok, bad = miss.where(F.col("missing_share") <= max_missing), miss.where(F.col("missing_share") > max_missing)
    daily = have.groupBy("station", "day").agg(F.avg("t").alias("t"), F.count("*").alias("n")).where(F.col("n") >= least_bins).drop("n")
    best = cut_lineage(bad.join(donors(daily, bad, ok, min_days), "station", "left")
                       .withColumn("action", F.when(F.col("corr") >= min_corr, "filled").otherwise("dropped")))
    use = best.where("action = 'filled'").select("station", "donor", "a", "b")
    given = have.select(F.col("station").alias("donor"), "day", "slot", F.col("t").alias("td"))
    add = cut_lineage(use.join(given, "donor").select("station", "day", "slot", (F.col("a") + F.col("b") * F.col("td")).alias("t"))
                      .join(have.select("station", "day", "slot"), ["station", "day", "slot"], "left_anti"))
    log = best.join(add.groupBy("station").agg(F.count("*").alias("_f")), "station", "left").withColumn("n_bins_filled", F.when(F.col("action") == "filled", F.coalesce("_f", F.lit(0)))).drop("_f")
    filled = have.withColumn("is_filled", F.lit(False)).unionByName(add.withColumn("is_filled", F.lit(True)))
    return log, filled.join(best.where("action = 'dropped'").select("station"), "station", "left_anti")


def station_fill(daily: DataFrame, expected: int | None = None, max_missing: float = 0.05, min_corr: float = 0.98, min_days: int = 60) -> tuple[DataFrame, DataFrame]:
    """The same for one value a day (station, day, t): returns (log, filled)."""
    log, filled = slot_station_fill(daily.withColumn("slot", F.lit(0)), 1, 1, expected, max_missing, min_corr, min_days)
    return log, filled.select("station", "day", "t", "is_filled")


def _close(data: DataFrame, homes: DataFrame, refs: DataFrame, tol: float) -> DataFrame:
    """(home, leader) whose median absolute daily difference is below `tol`. A pair's differences are bounded by the calendar."""
    r = data.join(refs.select(F.col("home").alias("leader")), F.col("home") == F.col("leader")).select("leader", "day", F.col("t").alias("tr"))
    d = data.join(homes.select("home"), "home").join(r, "day").where(F.col("leader") < F.col("home"))
    return d.groupBy("home", "leader").agg(F.percentile(F.abs(F.col("t") - F.col("tr")), 0.5).alias("med")).where(F.col("med") < tol).select("home", "leader")


def weather_groups(daily: DataFrame, tol: float = 0.2, min_days: int = 30, batch: int = 64) -> DataFrame:
    """Greedy leader groups of homes (home, day, t) in id order: a home joins the first leader whose median absolute daily difference is below `tol`, else it leads
    a group of its own. Too short series get 'G_none'.

    A round takes the `batch` lowest unassigned homes. Which of them lead follows from the close pairs among them (batch^2 at most, read by the driver); then one join tests
    every other home against these leaders. All homes of the batch are assigned, so there are at most homes / batch rounds, and since unassigned homes have higher ids
    than the batch, the groups are those of the one-by-one rule."""
    data = daily.where("t IS NOT NULL").select("home", "day", "t")
    n = data.groupBy("home").agg(F.count("*").alias("n"))
    left = cut_lineage(n.where(F.col("n") >= min_days).select("home"))
    done, groups = [n.where(F.col("n") < min_days).select("home", F.lit("G_none").alias("grp"))], 0
    while first := [r.home for r in left.orderBy("home").limit(batch).collect()]:
        low = left.where(F.col("home").isin(first))
        near: dict = {}
        for r in _close(data, low, low, tol).collect():
            near.setdefault(r.home, set()).add(r.leader)
        leaders: list = []
        for h in first:
            if not near.get(h, set()).intersection(leaders):
                leaders.append(h)
        lead = left.where(F.col("home").isin(leaders))
        joined = _close(data, left.where(~F.col("home").isin(leaders)), lead, tol).groupBy("home").agg(F.min("leader").alias("leader"))
        new = cut_lineage(joined.unionByName(lead.select("home", F.col("home").alias("leader"))))
        names = F.create_map(*[x for i, h in enumerate(leaders) for x in (F.lit(h), F.lit(f"G{groups + i:03d}"))])
        done.append(new.select("home", names[F.col("leader")].alias("grp")))
        groups += len(leaders)
        left = cut_lineage(left.join(new, "home", "left_anti"))
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def series_identity(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Overlap, largest difference and share of identical values of two stations' series."""
    j = a.select(*keys, F.col(value).alias("_x")).join(b.select(*keys, F.col(value).alias("_y")), keys).where("_x IS NOT NULL AND _y IS NOT NULL")
    return j.agg(F.count("*").alias("n_overlap"), F.max(F.abs(F.col("_x") - F.col("_y"))).alias("max_abs_diff"), F.avg((F.col("_x") == F.col("_y")).cast("double")).alias("share_identical"))


def same_calendar_day(src: DataFrame, tgt: DataFrame, day: str, keys: list[str], value: str) -> DataFrame:
    """Values of a source window placed on the target window's days by (month, day of month)."""
    md = lambda c: F.date_format(c, "MM-dd")
    s = src.select(*keys, md(F.col(day)).alias("_md"), F.col(day).alias("src_day"), F.col(value).alias("src_value"))
    return tgt.select(*keys, day, md(F.col(day)).alias("_md")).join(s, [*keys, "_md"], "left").drop("_md")


# ------------------------------------------------------------------ result tables
def compare_tables(a: DataFrame, b: DataFrame, keys: list[str], cols: list[str], tol: float) -> DataFrame:
    """Per column of two keyed tables: rows on one side only, largest absolute and relative difference, NULL mismatches, within tolerance."""
    x = a.select(*keys, *[F.col(c).cast("double").alias(f"_a_{c}") for c in cols], F.lit(1).alias("_ina"))
    y = b.select(*keys, *[F.col(c).cast("double").alias(f"_b_{c}") for c in cols], F.lit(1).alias("_inb"))
    j = x.join(y, keys, "full_outer")
    long = j.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_a_{c}").alias("x"), F.col(f"_b_{c}").alias("y"), F.col("_ina").alias("ia"), F.col("_inb").alias("ib")) for c in cols])).alias("r")).select("r.*")
    both = F.col("ia").isNotNull() & F.col("ib").isNotNull()
    d = F.when(both, F.abs(F.col("x") - F.col("y")))
    return (long.groupBy("column").agg(F.count_if(F.col("ib").isNull()).alias("left_only"), F.count_if(F.col("ia").isNull()).alias("right_only"), F.max(d).alias("max_abs"),
                                       F.max(d / F.nullif(F.abs(F.col("x")), F.lit(0.0))).alias("max_rel"), F.count_if(both & (F.col("x").isNull() != F.col("y").isNull())).alias("null_mismatch"))
            .withColumn("ok", (F.col("left_only") == 0) & (F.col("right_only") == 0) & (F.col("null_mismatch") == 0) & (F.coalesce("max_abs", F.lit(0.0)) <= tol)))


def degradation(rows: DataFrame, ref: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Value minus the reference value of the same configuration; a configuration with several reference rows is an error column."""
    r = ref.groupBy(*keys).agg(F.first(value).alias(f"{value}_ref"), F.count("*").alias("_n"))
    j = rows.join(r, keys, "left")
    return j.withColumn("delta", F.col(value) - F.col(f"{value}_ref")).withColumn("unique_ref", F.coalesce(F.col("_n") == 1, F.lit(False))).drop("_n")


def household_overlap(members: DataFrame, group: str, a: str, b: str) -> DataFrame:
    """Households that occur on both sides of a partition (`group` = a or b); empty when the sides are disjoint."""
    x, y = members.where(F.col(group) == a).select("seed", "hh").distinct(), members.where(F.col(group) == b).select("seed", "hh").distinct()
    return x.join(y, ["seed", "hh"], "left_semi")
