"""Uncertainty, label and data audits, feeder targets, circuit fits."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.hashing import digest, hash_int, hash_rank
from ..functions.scan import exact_quantiles
from ..functions.stats import corr
from ..session import cut_lineage
from .aggregate import penetration_bin, score
from .hinge import fit_hinge


def cluster_bootstrap(pred: DataFrame, members: DataFrame, n_boot: int, seed: int, y: str, p: str, metric: str = "wape", ci: float = 0.95) -> DataFrame:
    """Interval of a metric from drawing the HP households with replacement and keeping substations whose members were all drawn.

    Each household carries the array of replicates it was drawn in; a substation keeps the intersection of its members' arrays
    (at most its size of them), so no replicate x member table is joined."""
    hh = hash_rank(members.select("hh").distinct().withColumn("_g", F.lit(0)), ["_g"], digest(F.lit(seed), F.lit("boot"), F.col("hh")))
    # the j-th draw of every replicate belongs to the household of rank j: draws are made where the households are
    draws = hh.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1)))).select(
        "b", (hash_int(F.lit(seed), F.lit("draw"), F.col("b"), F.col("pos") + 1) % F.col("pool_size")).alias("pos"))
    drawn = draws.groupBy("pos").agg(F.collect_set("b").alias("bs"))
    have = hh.select("hh", "pos").join(drawn, "pos", "left").select("hh", F.coalesce("bs", F.array().cast("array<int>")).alias("bs"))
    kept = (members.select("sub_id", "hh").join(have, "hh").groupBy("sub_id").agg(F.collect_list("bs").alias("l"))
            .select("sub_id", F.aggregate(F.slice("l", F.lit(2), F.size("l")), F.col("l")[0], lambda a, x: F.array_intersect(a, x)).alias("bs")))
    n_all = pred.agg(F.count("*").alias("n_all"))
    d = pred.join(kept, "sub_id").select(y, p, F.explode("bs").alias("b"))
    # the share kept is over all replicates, those with fewer than two substations (or none) included
    s = score(d, ["b"], y, p).withColumn("_m", F.when(F.col("n") >= 2, F.col(metric)))
    a = (1 - ci) / 2
    out = s.agg(F.percentile("_m", a).alias("lo"), F.percentile("_m", 1 - a).alias("hi"), F.stddev_pop("_m").alias("sd"), F.count("_m").alias("n_valid"), F.sum("n").alias("_kept"))
    return out.join(F.broadcast(n_all)).withColumn("mean_kept", F.col("_kept") / (F.col("n_all") * n_boot)).drop("_kept", "n_all")      # one row each


def draws(stream: np.ndarray, j: np.ndarray, n: np.ndarray | int) -> np.ndarray:
    """Draw number j of a stream: a place below n. Plain 64-bit integers, so that SQL can replay it."""
    return (mix32(mix32(stream) + j) * n) >> 32


def mix32(x: np.ndarray) -> np.ndarray:
    """Scatters 32-bit integers (held in 64 bits)."""
    x = x & 0xFFFFFFFF
    for _ in range(2):
        x = ((x ^ (x >> 16)) * 73244475) & 0xFFFFFFFF
    return x ^ (x >> 16)


#: Draws of a bootstrap that one task makes.
PER_TASK = 1 << 27


def row_bootstrap(pred: DataFrame, keys: list[str], row: str, n_boot: int, seed: int, y: str, p: str, block: int = 1000, at_once: int = 1 << 22) -> DataFrame:
    """Bootstrap of the MAPE over rows: each replicate draws n of a key's n rows with replacement. Rows whose truth is 0 or NULL or whose prediction is NULL don't count.

    A replicate's draws are first counted by block of rows (ranges of the rows' hash order), then each block deals its draws to its rows. Only counts by
    replicate and block and sums by replicate and block are exchanged; a row meets all replicates in its block's task, so no rows x replicates table arises. A key of any size is
    cut to blocks, and a replicate's draws are counted `at_once` by `at_once`."""
    e = F.abs(F.col(p) - F.col(y)) / F.abs(F.col(y))
    d = hash_rank(pred.withColumn("_e", F.when(F.col(y) != 0, e)).where("_e IS NOT NULL"), keys, digest(F.lit(seed), F.col(row)))
    d = cut_lineage(d.select(*keys, F.floor(F.col("pos") / block).cast("int").alias("_block"), (F.col("pos") % block).cast("int").alias("_at"), "_e", F.col("pool_size").alias("_n"), hash_int(F.lit(seed), *[F.col(k) for k in keys]).alias("_key")))
    units = (d.groupBy(*keys).agg(F.first("_n").alias("_n"), F.first("_key").alias("_key"))
             .withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_boot - 1).cast("long")))))
    # few rows of units stand for n_boot x rows draws: as many tasks as the draws ask for
    tasks = max(2 * pred.sparkSession.sparkContext.defaultParallelism, -(-n_boot * d.count() // PER_TASK))
    units = units.repartition(tasks, *keys, "_b")

    def count(batches):
        for t in batches:
            for i, (n, key, b) in enumerate(zip(*(t.column(c).to_pylist() for c in ("_n", "_key", "_b")))):
                m = np.zeros(-(-n // block), np.int64)
                for lo in range(0, n, at_once):
                    m += np.bincount(draws(np.int64(key + b), np.arange(lo, min(lo + at_once, n)), n) // block, minlength=len(m))
                hit = np.flatnonzero(m)
                row = t.take(pa.array(np.full(len(hit), i))).select([*keys, "_key", "_b"])
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array(hit, pa.int32()), pa.array(m[hit], pa.int64())], [*row.schema.names, "_block", "_m"])
    of_keys = units.select(*keys, "_key", "_b").schema
    counts = units.mapInArrow(count, of_keys.add("_block", "integer").add("_m", "long")).repartition(tasks, *keys, "_block")

    def deal(key, rows, counts):
        v = np.zeros(rows.num_rows)
        v[rows["_at"].to_numpy()] = rows["_e"].to_numpy()
        number, b, m = (counts[c].to_numpy() for c in ("_key", "_b", "_m"))
        sums = []
        for k, r, c in zip(number, b, m):
            at = draws(mix32(k + r) + np.int64(key[-1].as_py() + 1), np.arange(c), len(v))
            sums.append(float(v[at].sum()))
        t = counts.select([*keys, "_b", "_m"])
        return t.append_column("_s", pa.array(sums, pa.float64()))
    part = (d.select(*keys, "_block", "_at", "_e").repartition(tasks, *keys, "_block").groupBy(*keys, "_block").cogroup(counts.groupBy(*keys, "_block"))
            .applyInArrow(deal, counts.select(*keys, "_b", "_m").schema.add("_s", "double")))
    g = part.groupBy(*keys, "_b").agg((F.sum("_s") / F.sum("_m") * 100).alias("m"), F.sum("_m").alias("n"))
    return g.groupBy(*keys).agg(F.percentile("m", 0.025).alias("lo"), F.percentile("m", 0.975).alias("hi"), F.stddev_samp("m").alias("sd"), F.min("n").alias("n_least"), F.max("n").alias("n_most"))


def label_audit(tab: DataFrame, keys: list[str], label: str, native: str, n_hp: str, size: str) -> DataFrame:
    """Ratio of two label definitions: median and band for all rows of a key and per penetration bin."""
    d = tab.where(F.col(native) > 0).withColumn("c", F.col(label) / F.col(native)).withColumn("bin", penetration_bin(F.col(n_hp) / F.col(size)))
    g = d.groupingSets([[*keys], [*keys, "bin"]], *keys, "bin")
    return g.agg(F.count("*").alias("n"), F.percentile("c", 0.5).alias("median"), F.percentile("c", 0.05).alias("q05"), F.percentile("c", 0.9).alias("q90")).withColumn("bin", F.coalesce("bin", F.lit("all")))


def peak_ratio(slots: DataFrame, key: list[str], ts: str, y: str, fine_seconds: int, factor: int) -> DataFrame:
    """Peak at the fine resolution over the peak of `factor`-slot means (full coarse slots only)."""
    k = F.floor(F.unix_timestamp(ts) / (fine_seconds * factor))
    c = slots.groupBy(*key, k.alias("_k")).agg(F.avg(y).alias("_m"), F.count(y).alias("_n"), F.max(y).alias("_x"))
    return c.groupBy(*key).agg(F.max("_x").alias("peak_fine"), F.max(F.when(F.col("_n") == factor, F.col("_m"))).alias("peak_coarse"))


def decomposition(metrics: DataFrame, keys: list[str], method: str, value: str, net: str, o1: str, o2: str) -> DataFrame:
    """Error of the net estimate split into fill contamination (net - O1), scale dispersion (O1 - O2) and fit noise (O2)."""
    w = metrics.where(F.col(method).isin(net, o1, o2)).groupBy(*keys).pivot(method, [net, o1, o2]).agg(F.first(value))
    return w.select(*keys, F.col(net).alias("wape_net"), (F.col(net) - F.col(o1)).alias("fill_contamination"), (F.col(o1) - F.col(o2)).alias("scale_dispersion"), F.col(o2).alias("fit_noise"))


def dispersion(df: DataFrame, keys: list[str], peak: str, slope: str) -> DataFrame:
    """Coefficient of variation of peak per slope; groups of one are NULL."""
    r = F.when(F.col(slope) > 0, F.col(peak) / F.col(slope))
    return df.groupBy(*keys).agg(F.count(r).alias("n"), F.when(F.count(r) > 1, F.stddev_pop(r) / F.avg(r)).alias("cv"))


def fit_diagnostics(tab: DataFrame, keys: list[str]) -> DataFrame:
    share = lambda c: F.avg(c.cast("double"))
    return tab.groupBy(*keys).agg(
        F.count("*").alias("n"), share(F.coalesce("hinge_inside_net", F.lit(False))).alias("share_inside"), share(F.coalesce("at_bound_net", F.lit(False))).alias("share_at_bound"),
        share(F.col("s_h_net").isNull() | (F.col("s_h_net") <= 0)).alias("share_failed"), F.count_if(F.col("HP_CoincPeak") > F.col("HP_Peak")).alias("n_coinc_above_sum"))


def correlations(tab: DataFrame, keys: list[str], target: str, cols: list[str]) -> DataFrame:
    """Correlation of each column with the target, long; overall when `keys` is empty."""
    g = tab.groupBy(*keys) if keys else tab.groupBy()
    w = g.agg(*[corr(c, target).alias(c) for c in cols])
    return w.unpivot(keys, cols, "feature", "corr")


def cell_audit(matrix: DataFrame, id_cols: list[str], extreme: float = 1e6) -> DataFrame:
    """Per feature column the share of NULL and extreme cells."""
    cols = [c for c in matrix.columns if c not in id_cols]
    w = matrix.agg(*[a for c in cols for a in (F.avg(F.col(f"`{c}`").isNull().cast("double")).alias(f"n|{c}"), F.avg((F.abs(f"`{c}`") > extreme).cast("double")).alias(f"x|{c}"))])
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"`n|{c}`").alias("null_share"), F.coalesce(F.col(f"`x|{c}`"), F.lit(0.0)).alias("extreme_share")) for c in cols])
    return w.select(F.explode(pairs).alias("r")).select("r.*")


def changed_registrations(meta: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Number of entities whose registered value changes over time, per column."""
    g = meta.groupBy(key).agg(*[(F.min(c) != F.max(c)).alias(c) for c in cols])       # two distinct values exist iff min differs from max
    return g.agg(*[F.count_if(F.col(c)).alias(c) for c in cols]).unpivot([], cols, "column", "n_changed")


def source_inventory(readings: DataFrame, source: str, unit: str, day: str, windows, in_windows, min_days: int) -> DataFrame:
    """One row per source: units, rows, span, units with a complete window, and the list of complete windows."""
    u = readings.groupBy(source, unit).agg(F.count("*").alias("n"), F.min(day).alias("a"), F.max(day).alias("b"))
    base = u.groupBy(source).agg(F.count("*").alias("n_units"), F.sum("n").alias("n_rows"), F.min("a").alias("first_day"), F.max("b").alias("last_day"))
    w = in_windows(readings, day, windows).groupBy(source, unit, "window").agg(F.count("*").alias("k")).where(F.col("k") >= min_days)
    full = w.groupBy(source).agg(F.count_distinct(unit).alias("n_complete"), F.array_join(F.array_sort(F.collect_set("window")), ",").alias("windows"))   # as many as there are windows
    return base.join(full, source, "left")


def circuit_fits(circuits: DataFrame, temp: DataFrame, site: str, day: str, family: Column, power: str, min_n: int) -> DataFrame:
    """End-use circuits to heat, cool and mains families; days count when every family has enough readings; hinge slopes of the heating
    load and of the residual mains - heat - cool."""
    c = circuits.withColumn("_f", family).groupBy(site, day, "_f").agg(F.sum(power).alias("kw"), F.count("*").alias("n"))
    w = c.groupBy(site, day).agg(*[F.sum(F.when(F.col("_f") == f, F.col("kw"))).alias(f) for f in ("heat", "cool", "mains")], F.bool_and(F.col("n") >= min_n).alias("full"), F.count("*").alias("nf"))
    d = w.where("full AND nf = 3").withColumn("residual", F.col("mains") - F.col("heat") - F.col("cool")).join(temp, [site, day])
    long = d.select(site, "t", F.explode(F.create_map(F.lit("heat"), F.col("heat"), F.lit("residual"), F.col("residual"))).alias("series", "y"))
    return fit_hinge(long, [site, "series"], "t", "y")


def feeder_targets(static: DataFrame, end: DataFrame, feeder: str, hp: str, other: list[str], dominance: float = 0.5) -> DataFrame:
    """Registered heat-pump power, all electric heating, share, dominance flag, and whether the value is the same at the end of the year."""
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    tot = sum((z(c) for c in other), z(hp))
    share = F.when(tot > 0, z(hp) / tot).otherwise(0.0)
    e = end.select(feeder, F.col(hp).alias("_end"))
    return static.join(e, feeder, "left").select(feeder, z(hp).alias("hp_kw"), tot.alias("electric_kw"), share.alias("hp_share"), (share >= dominance).alias("hp_dominant"),
                                                 (z(hp) == F.coalesce("_end", F.lit(0.0))).alias("stable"))


def household_caps(halves: DataFrame, hh: str, slot: str, value: str, q: float = 0.999) -> DataFrame:
    """Cap of a household from full slots: both halves valid, their mean, then the high quantile."""
    s = halves.where(F.col(value).isNotNull()).groupBy(hh, slot).agg(F.avg(value).alias("_m"), F.count("*").alias("_n")).where("_n = 2")
    return exact_quantiles(s, [hh], "_m", {"cap": q}, cuts=8)


def substation_labels(members: DataFrame, caps: DataFrame, hh: str) -> DataFrame:
    return members.join(caps.select(hh, "cap"), hh, "left").groupBy("sub_id").agg(F.sum("cap").alias("label"), F.count("cap").alias("n_labelled"), F.count("*").alias("n_members"))
