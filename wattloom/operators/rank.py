"""Winners, unions of intervals, window choice, feature selection, sets (W rows)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.scan import chunked_scan


def family_winners(df: DataFrame, group: list[str], cv: str, label: Column) -> DataFrame:
    """Row with the lowest inner error per group, ties by label; all other columns are carried, none is read."""
    rest = [c for c in df.columns if c not in group]
    d = df.where(F.col(cv).isNotNull() & ~F.isnan(cv)).withColumn("_label", label)
    return d.groupBy(*group).agg(F.min_by(F.struct(*rest), F.struct(F.col(cv).alias("_cv"), F.col("_label"))).alias("_w")).select(*group, "_w.*")


def median_winners(df: DataFrame, group: list[str], label: str, unit: str, cv: str, min_share: float = 0.8) -> DataFrame:
    """Per group the configuration with the lowest median error over its units, among those seen in enough units."""
    g = df.where(F.col(cv).isNotNull()).groupBy(*group, label).agg(F.percentile(cv, 0.5).alias("median"), F.count_distinct(unit).alias("n_units"))
    top = g.groupBy(*group).agg(F.max("n_units").alias("_m"))
    e = g.join(top, group).where(F.col("n_units") >= min_share * F.col("_m"))
    return e.groupBy(*group).agg(F.min(F.struct("median", label, "n_units")).alias("_w")).select(*group, F.col(f"_w.{label}"), "_w.median", "_w.n_units")


def best_reference(df: DataFrame, group: list[str], method: str, value: str) -> DataFrame:
    """Reference method with the lowest median over units, ties by name."""
    g = df.groupBy(*group, method).agg(F.percentile(value, 0.5).alias("median"))
    return g.groupBy(*group).agg(F.min(F.struct("median", method)).alias("_w")).select(*group, F.col(f"_w.{method}"), "_w.median")


def union_length(df: DataFrame, group: list[str], start: str, end: str, chunk: Column) -> DataFrame:
    """Length in seconds of the union of intervals per group. An interval starts a new island when it begins after everything before it ended."""
    s, e = F.unix_timestamp(start), F.unix_timestamp(end)
    d = df.groupBy(*group, start).agg(F.max(end).alias(end)).withColumn("_c0", chunk)
    d = chunked_scan(d, group, [start], F.col("_c0"), {"_m": ("before_max", F.unix_timestamp(end))})
    # each interval adds the part that lies after everything already covered
    add = F.greatest(F.lit(0), e - F.greatest(s, F.coalesce("_m", s)))
    return d.groupBy(*group).agg(F.sum(add).alias("busy_seconds"), F.count("*").alias("n_starts"))


def window_choice(readings: DataFrame, home: str, day: str, starts: list[str], months: int, min_days: int, last_day: str | None = None) -> DataFrame:
    """Candidate windows with the homes that reach the coverage; the window with most homes first, ties to the earliest."""
    ends = [F.least(F.add_months(F.lit(s).cast("date"), months), F.date_add(F.lit(last_day).cast("date"), 1)) if last_day else F.add_months(F.lit(s).cast("date"), months) for s in starts]
    hit = F.array(*[F.when((F.col(day) >= F.lit(s).cast("date")) & (F.col(day) < e), F.lit(s)) for s, e in zip(starts, ends)])
    d = readings.select(home, F.explode(F.filter(hit, lambda x: x.isNotNull())).alias("start"))
    n = d.groupBy(home, "start").agg(F.count("*").alias("n"))
    return n.groupBy("start").agg(F.count_if(F.col("n") >= min_days).alias("n_homes"))


def best_window(choice: DataFrame) -> DataFrame:
    return choice.orderBy(F.desc("n_homes"), "start").limit(1)


def one_se(curve: DataFrame, group: list[str], k: str, mean: str, se: str) -> DataFrame:
    """Smallest k whose mean error is within one standard error of the best."""
    b = curve.groupBy(*group).agg(F.min(F.struct(F.col(mean).alias("m"), F.col(k).alias("k"), F.col(se).alias("s"))).alias("_b"))
    return (curve.join(b, group).where(F.col(mean) <= F.col("_b.m") + F.col("_b.s")).groupBy(*group)
            .agg(F.min(k).alias("k_1se"), F.first("_b.k").alias("k_best"), F.first("_b.m").alias("best_error")))


def top_k(df: DataFrame, group: list[str], value: str, label: str, k: int) -> DataFrame:
    """k largest per group, ties by label (group = features of a model: small)."""
    r = F.row_number().over(W.partitionBy(*group).orderBy(F.desc(value), label))
    return df.withColumn("rank", r).where(F.col("rank") <= k)
