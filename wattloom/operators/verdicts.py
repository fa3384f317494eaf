"""Paired decision rules on long metric tables (T rows). Units are seeds; every table here is an aggregate of experiments."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .estimators import fit_power_law, n_star

# fixed values: thresholds of the decision rules
SHARE, PP, REL = 0.8, 1.0, 0.05


def wide(metrics: DataFrame, keys: list[str], cell: str, value: str, cells: list[str]) -> DataFrame:
    """One row per configuration, one column per cell."""
    return metrics.groupBy(*keys).pivot(cell, cells).agg(F.first(value))


def verdict(diffs: DataFrame, keys: list[str], d: str, share: float = SHARE, min_effect: float = PP) -> DataFrame:
    """better: enough negative differences and a median at or below -min_effect; worse: the mirror image."""
    x = F.col(d)
    g = diffs.where(x.isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(x < 0).alias("n_neg"), F.count_if(x > 0).alias("_pos"), F.percentile(d, 0.5).alias("median"))
    v = (F.when((F.col("n_neg") / F.col("n") >= share) & (F.col("median") <= -min_effect), "better")
         .when((F.col("_pos") / F.col("n") >= share) & (F.col("median") >= min_effect), "worse").otherwise("no difference"))
    return g.withColumn("verdict", v).drop("_pos")


def rel_verdict(diffs: DataFrame, keys: list[str], d: str, base: str, share: float = SHARE, thr: float = REL) -> DataFrame:
    """As `verdict` with the median of the relative difference."""
    x = F.col(d)
    r = F.col(d) / F.nullif(F.col(base), F.lit(0.0))
    g = (diffs.where(x.isNotNull()).withColumn("_r", r).groupBy(*keys)
         .agg(F.count("*").alias("n"), F.count_if(x < 0).alias("n_neg"), F.count_if(x > 0).alias("_pos"), F.percentile("_r", 0.5).alias("median_rel"), F.percentile(d, 0.5).alias("median_diff")))
    v = (F.when(F.col("median_rel").isNull(), "missing").when((F.col("n_neg") / F.col("n") >= share) & (F.col("median_rel") <= -thr), "better")
         .when((F.col("_pos") / F.col("n") >= share) & (F.col("median_rel") >= thr), "worse").otherwise("no difference"))
    return g.withColumn("verdict", v).drop("_pos")


def paired(winners: DataFrame, reference: DataFrame, unit: list[str], scope: list[str], method: str, value: str) -> DataFrame:
    """Winner minus the best reference of its scope (lowest median over units) on the same unit."""
    med = reference.where(F.col(value).isNotNull()).groupBy(*scope, method).agg(F.percentile(value, 0.5).alias("_m"))
    best = med.groupBy(*scope).agg(F.min(F.struct("_m", method)).alias("_b")).select(*scope, F.col(f"_b.{method}").alias("reference"))
    ref = reference.join(best, scope).where(F.col(method) == F.col("reference")).select(*unit, *scope, "reference", F.col(value).alias(f"{value}_ref"))
    return winners.join(ref, unit + scope).withColumn("d", F.col(value) - F.col(f"{value}_ref"))


def criterion(diffs: DataFrame, keys: list[str], d: str = "d", share: float = SHARE, pp: float = -1.0) -> DataFrame:
    x = F.col(d)
    g = diffs.where(x.isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(x < 0).alias("wins"), F.percentile(d, 0.5).alias("median_d"))
    return g.withColumn("meets", (F.col("wins") / F.col("n") >= share) & (F.col("median_d") <= pp))


def combine_readings(v: DataFrame, keys: list[str], col: str = "verdict") -> DataFrame:
    """better on at least two readings and worse on none, and the mirror image; missing readings do not count."""
    b, w, n = (F.count_if(F.col(col) == x) for x in ("better", "worse", "missing"))
    c = (F.when(F.count("*") == n, "missing").when((b >= 2) & (w == 0), "better").when((w >= 2) & (b == 0), "worse").otherwise("no difference"))
    return v.groupBy(*keys).agg(c.alias("combined"))


def agreement(v: DataFrame, keys: list[str], family: str, without: str, col: str = "verdict") -> DataFrame:
    """The common verdict of all families or 'mixed', with and without one family, and whether leaving it out changes the outcome."""
    one = lambda c: F.when(F.min(c) == F.max(c), F.min(c)).otherwise("mixed")
    g = v.groupBy(*keys).agg(one(F.col(col)).alias("all_families"), one(F.when(F.col(family) != without, F.col(col))).alias("without_one"))
    return g.withColumn("dependent", F.col("all_families") != F.col("without_one"))


def steps(rungs: DataFrame, unit: str, keys: list[str], rung: str, value: str, pairs: list[tuple[str, str]]) -> DataFrame:
    """Differences between ladder rungs on the same unit, long by step."""
    names = sorted({r for p in pairs for r in p})
    w = wide(rungs, [unit, *keys], rung, value, names)
    s = F.explode(F.array(*[F.struct(F.lit(f"{h} vs {l}").alias("step"), (F.col(h) - F.col(l)).alias("d"), F.col(l).alias("base")) for h, l in pairs]))
    return w.select(unit, *keys, s.alias("_s")).select(unit, *keys, "_s.*")


def curve_fits(curve: DataFrame, keys: list[str], unit: str, n: str, n_all: str, wape: str, phys: str, least: int = 3) -> DataFrame:
    """Power law a + b n^-c of every unit's learning curve (NULL n stands for all, that is `n_all`), with n* where it meets the unit's reference at all. Units with fewer than `least` sizes have no fit.
    Columns: keys, unit, a, b, c, flag_c_bound, flag_a_neg, a_below, n_star (infinite if the curve stays above)."""
    p = curve.withColumn("_n", F.coalesce(F.col(n), F.col(n_all)).cast("double")).groupBy(*keys, unit, "_n").agg(F.percentile(wape, 0.5).alias("_w")).where("_w IS NOT NULL")
    f = fit_power_law(p, [*keys, unit], "_n", "_w").where(F.col("n_points") >= least)
    ref = curve.where(F.col(n).isNull()).groupBy(*keys, unit).agg(F.first(phys).alias("_ref")).where("_ref IS NOT NULL")
    return f.join(ref, [*keys, unit]).withColumn("a_below", F.col("a") < F.col("_ref")).withColumn("n_star", n_star(F.col("a"), F.col("b"), F.col("c"), F.col("_ref"))).drop("_ref", "sse", "n_points")


def data_limit(curve: DataFrame, keys: list[str], unit: str, n: str, n_all: str, wape: str, phys: str, at: int, also: tuple[int, ...] = (), drop_pp: float = 1.0) -> DataFrame:
    """Is a family data-limited? `curve`: unit, n (NULL = all), n_all, wape, phys, draws as rows of their own. D when the error still falls from `at` to all and the family beats
    the reference at all or the asymptote of its learning curve does; 'I or features' when it neither falls nor beats at `at`, `also` and all; else inconclusive."""
    all_, part = curve.where(F.col(n).isNull()), curve.where(F.col(n) == at)
    full = all_.groupBy(*keys, unit).agg(F.first(wape).alias("_a"))
    drop = part.join(full, keys + [unit]).withColumn("_drop", F.col(wape) - F.col("_a")).groupBy(*keys).agg(
        F.percentile("_drop", 0.5).alias("drop_median"), F.avg((F.col("_drop") > 0).cast("double")).alias("drop_share"), F.count("_drop").alias("n_pairs"))
    d = F.col(wape) - F.col(phys)
    g = curve.groupBy(*keys).agg(F.percentile(F.when(F.col(n).isNull(), d), 0.5).alias("all_median_d"), F.avg(F.when(F.col(n).isNull(), (d < 0).cast("double"))).alias("all_share"),
                                 *[F.percentile(F.when(F.col(n) == k, d), 0.5).alias(f"_d{k}") for k in (at, *also)])
    a = curve_fits(curve, keys, unit, n, n_all, wape, phys).groupBy(*keys).agg(
        F.avg(F.col("a_below").cast("double")).alias("asymptote_share"), F.percentile(F.when(F.col("n_star") < float("inf"), F.col("n_star")), 0.5).alias("n_star_median"),
        F.count_if(F.col("n_star") == float("inf")).alias("n_star_inf"), F.count_if(F.col("flag_c_bound") | F.col("flag_a_neg")).alias("fit_flags"))
    c1 = F.coalesce((F.col("drop_median") >= drop_pp) & (F.col("drop_share") >= SHARE), F.lit(False))
    c2 = F.coalesce((F.col("all_share") >= SHARE) & (F.col("all_median_d") <= -PP), F.lit(False)) | F.coalesce(F.col("asymptote_share") >= SHARE, F.lit(False))
    no = F.abs("drop_median") < drop_pp
    for c in ("all_median_d", *[f"_d{k}" for k in (at, *also)]):
        no = no & (F.col(c) >= 0)
    r = g.join(drop, keys, "left").join(a, keys, "left").withColumns({"n_star_inf": F.coalesce("n_star_inf", F.lit(0)), "fit_flags": F.coalesce("fit_flags", F.lit(0)), "n_pairs": F.coalesce("n_pairs", F.lit(0))})
    return r.withColumn("verdict", F.when(c1 & c2, "D").when(F.coalesce(no, F.lit(False)), "I or features").otherwise("inconclusive")).drop(*[f"_d{k}" for k in (at, *also)])


def claim(medians: DataFrame, sample: Column, robust: Column, hybrid: str, plain: str, max_gap: float = 1.0) -> DataFrame:
    """Claim of the hybrid: accuracy gap within bounds, and better in sample efficiency and robustness."""
    gap = F.col(hybrid) - F.col(plain)
    nb = (sample == "better").cast("int") + (robust == "better").cast("int")
    return medians.withColumn("gap", gap).withColumn("outcome", F.when((gap > max_gap) | (nb == 0), "fails").when(nb == 2, "holds").otherwise("open"))


def keep_ensemble(v: DataFrame, key: list[str], cell: str, cells: tuple[str, ...] = ("all", "dagger")) -> DataFrame:
    """An ensemble is kept when it is better than its reference in one of the main cells."""
    return v.groupBy(*key).agg(F.bool_or(F.col(cell).isin(*cells) & (F.col("verdict") == "better")).alias("kept"))


def transfer_outcome(v: DataFrame, keys: list[str], col: str = "verdict") -> DataFrame:
    """Two directions: any worse refutes, two better confirm, one better confirms partly."""
    b, w = F.count_if(F.col(col) == "better"), F.count_if(F.col(col) == "worse")
    return v.groupBy(*keys).agg(F.when(w > 0, "refuted").when(b == 2, "confirmed").when(b == 1, "partly confirmed").otherwise("not confirmed").alias("outcome"))


def gain_over_best(rows: DataFrame, unit: str, keys: list[str], is_base: Column, method: str, value: str) -> DataFrame:
    """Gain of every method over the best baseline of its unit (lower is better)."""
    b = rows.where(is_base).groupBy(unit, *keys).agg(F.min(F.struct(F.col(value).alias("v"), F.col(method).alias("m"))).alias("_b"))
    return rows.where(~is_base).join(b, [unit, *keys]).select(unit, *keys, method, F.col(value), F.col("_b.m").alias("best_base"), (F.col("_b.v") - F.col(value)).alias("gain"))


def two_level_median(df: DataFrame, outer: list[str], inner: list[str], value: str) -> DataFrame:
    """Median over inner groups of each group's median, and the largest inner median."""
    g = df.groupBy(*outer, *inner).agg(F.percentile(value, 0.5).alias("_m"))
    return g.groupBy(*outer).agg(F.percentile("_m", 0.5).alias("median"), F.max("_m").alias("max"), F.count("*").alias("n"))


def delta(a: DataFrame, b: DataFrame, keys: list[str], by: list[str], value: str) -> DataFrame:
    """Median difference of two arms on the same unit and configuration."""
    j = a.select(*keys, F.col(value).alias("_a")).join(b.select(*keys, F.col(value).alias("_b")), keys).withColumn("_d", F.col("_a") - F.col("_b"))
    return j.groupBy(*by).agg(F.percentile("_d", 0.5).alias("median_delta"), F.count("_d").alias("n"))


def to_long(df: DataFrame, ids: list[str], const: dict[str, str]) -> DataFrame:
    """Wide result columns to (metric, value) rows with constant labels; empty values are left out."""
    cols = [c for c in df.columns if c not in ids]
    u = df.select(*ids, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(ids, cols, "metric", "value").where("value IS NOT NULL")
    return u.select(*[F.lit(v).alias(k) for k, v in const.items()], *u.columns)


def job_status(jobs: DataFrame, markers: DataFrame, arm: str, family: str) -> DataFrame:
    """Jobs of the list by state of their marker: done, failed (and not done), missing."""
    m = markers.groupBy("job").agg(F.bool_or(F.col("state") == "done").alias("_d"), F.bool_or(F.col("state") == "failed").alias("_f"))
    j = jobs.join(m, "job", "left")
    d, f = F.coalesce("_d", F.lit(False)), F.coalesce("_f", F.lit(False))
    return j.groupBy(arm, family).agg(F.count("*").alias("jobs"), F.count_if(d).alias("done"), F.count_if(f & ~d).alias("failed"), F.count_if(~d & ~f).alias("missing"))


def log_parameters(lines: DataFrame, text: str, pattern: str, names: list[str]) -> DataFrame:
    """Named groups of log lines that match; other lines are left out."""
    return lines.where(F.col(text).rlike(pattern)).select(*[c for c in lines.columns if c != text], *[F.regexp_extract(text, pattern, i + 1).alias(n) for i, n in enumerate(names)])


def match_logs(rows: DataFrame, logs: DataFrame, keys: list[str], row_value: str, log_value: str, params: str, tol: float = 0.05, span: int = 16) -> DataFrame:
    """Parameters of the log lines whose value lies within `tol` of the row's; they must agree to count.

    No pairs are formed: the distinct values of both sides meet in stretches of `span` tolerances (a log line also in a neighbouring stretch that
    its band reaches). There the log lines are sorted, a row's band is one piece of them, and running sums give its count; its parameters agree if
    the run of equal ones at its start reaches its end."""
    width = span * tol
    at = lambda c: F.floor(c / width)
    finite = lambda c: F.abs(c) < float("inf")
    v, edge = F.col("_v"), F.lit(1.001 * tol)
    l = logs.select(*keys, F.col(log_value).cast("double").alias("_v"), F.col(params).alias("_p")).where(finite(v)).groupBy(*keys, "_v", "_p").agg(F.count("*").alias("_c"))
    l = l.withColumn("_b", F.explode(F.array_distinct(F.array(at(v - edge), at(v), at(v + edge)))))
    r = rows.groupBy(*rows.columns).agg(F.count("*").alias("_times")).withColumn("_v", F.col(row_value).cast("double"))
    asked = r.select(*keys, "_v").where(finite(v)).distinct().withColumn("_b", at(v))

    def meet(q: pa.Table, found: pa.Table) -> pa.Table:
        found = found.sort_by("_v")
        x, y = found["_v"].to_numpy(), q["_v"].to_numpy()
        before = np.r_[0, np.cumsum(found["_c"].to_numpy())]
        lo, hi = np.searchsorted(x, y - tol), np.searchsorted(x, y + tol, "right")
        # the sums above are rounded; what counts is the rounded difference
        padded = np.r_[-np.inf, x, np.inf]
        for end, outward, inside in ((lo, -1, lambda i: y - padded[i] <= tol), (hi, 1, lambda i: padded[i + 1] - y <= tol)):
            while (more := inside(end)).any():
                end[more] += outward
        while (less := (lo < hi) & (y - padded[lo + 1] > tol)).any():
            lo[less] += 1
        while (less := (lo < hi) & (padded[hi] - y > tol)).any():
            hi[less] -= 1
        known = np.flatnonzero(found["_p"].is_valid().to_numpy())
        p = found["_p"].take(pa.array(known))
        code = p.combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False) if len(p) else np.zeros(0, int)
        last = np.r_[np.flatnonzero(code[1:] != code[:-1]), max(len(code) - 1, 0)]          # the last place of each run of equal parameters
        first, end = np.searchsorted(known, lo), np.searchsorted(known, hi)
        some = first < end
        one = np.zeros(len(y), bool)
        one[some] = last[np.searchsorted(last, first[some])] >= end[some] - 1
        value = p.take(pa.array(np.where(one, first, 0), mask=~one)) if len(p) else pa.nulls(len(y), p.type)
        return pa.table({**{c: q[c] for c in [*keys, "_v"]}, "_n": before[hi] - before[lo], "_some": some, "_one": value})
    schema = asked.select(*keys, "_v").schema.add("_n", "long").add("_some", "boolean").add("_one", logs.schema[params].dataType)
    m = asked.groupBy(*keys, "_b").cogroup(l.groupBy(*keys, "_b")).applyInArrow(meet, schema)
    j = r.join(m, [*keys, "_v"], "left")
    return j.select(*rows.columns, F.coalesce(F.col("_n") * F.col("_times"), F.lit(0)).cast("bigint").alias("n_matches"),
                    F.when(~F.coalesce("_some", F.lit(False)), "no log line").when(F.col("_one").isNotNull(), "ok").otherwise("ambiguous").alias("status"), F.col("_one").alias("params"))


def carry_forward(plan: DataFrame, family: str, inner: str, top: int = 2, near: float = 1.0, always: str = "linear") -> DataFrame:
    """Families by median inner error: the top ones, those near the best and the always-listed one are carried (one row per family)."""
    m = plan.groupBy(family).agg(F.percentile(inner, 0.5).alias("median_inner"))
    w = W.partitionBy(F.lit(1)).orderBy("median_inner", family)
    r = m.withColumn("rank", F.row_number().over(w)).withColumn("gap", F.col("median_inner") - F.first("median_inner").over(w))
    why = F.when(F.col("rank") <= top, F.lit("top")).when(F.col("gap") <= near, F.lit("near")).when(F.col(family) == always, F.lit("always")).otherwise("not carried")
    return r.withColumn("reason", why).withColumn("carried", F.col("reason") != "not carried")
