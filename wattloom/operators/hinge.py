"""Grouped temperature-response fits as plain DataFrame plans: heating hinge, cooling hinge, bathtub, degree-hour line.

Input is one row per entity and day, so an entity's group is bounded by the calendar; rows are first
collapsed to one per (entity, temperature) with map-side sums."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

HEAT_BOUNDS = (8.0, 20.0)
COOL_BOUNDS = (15.0, 32.0)
DEADBAND_MAX = 24.0
EDGE = 1e-3


def prefix_sums(df: DataFrame, keys: list[str], t: str = "t", y: str = "y") -> DataFrame:
    """Per (entity, temperature): running n, sum T, sum T^2, sum y, sum Ty up to T, the entity totals, and the next T."""
    c = (df.where(F.col(t).isNotNull() & F.col(y).isNotNull())
         .groupBy(*keys, F.col(t).cast("double").alias("T"))
         .agg(F.count("*").cast("double").alias("m"), F.sum(y).alias("my"), F.sum(F.col(y) * F.col(y)).alias("myy")))
    w = W.partitionBy(*keys).orderBy("T")
    run, tot = w.rowsBetween(W.unboundedPreceding, 0), W.partitionBy(*keys)
    T, m = F.col("T"), F.col("m")
    return c.select(
        *keys, "T",
        F.sum(m).over(run).alias("run_n"), F.sum(m * T).over(run).alias("st"), F.sum(m * T * T).over(run).alias("stt"),
        F.sum("my").over(run).alias("sy"), F.sum(T * F.col("my")).over(run).alias("sty"),
        F.sum(m).over(tot).alias("tot_n"), F.sum("my").over(tot).alias("tot_y"), F.sum("myy").over(tot).alias("tot_yy"),
        F.min(T).over(tot).alias("t_min"), F.max(T).over(tot).alias("t_max"),
        F.lead(T).over(w).alias("t_next"), (F.row_number().over(w) == 1).alias("first"))


def fit_hinge(df: DataFrame, keys: list[str], t: str = "t", y: str = "y", bounds: tuple[float, float] = HEAT_BOUNDS) -> DataFrame:
    """Least squares of y = P_base + s_h * max(0, T_h - T), s_h and P_base >= 0, T_h within the bounds.

    The global optimum: the error is quadratic between two data temperatures, so only crossings of the
    cold line with the warm mean, the data temperatures and the bounds can be best. One row per entity."""
    lo, hi = (F.lit(float(b)) for b in bounds)
    p = prefix_sums(df, keys, t, y)
    T, n, st, stt, sy, sty, N, Y, YY = (F.col(c) for c in ("T", "run_n", "st", "stt", "sy", "sty", "tot_n", "tot_y", "tot_yy"))
    c = (n * sty - st * sy) / F.nullif(n * stt - st * st, F.lit(0.0))
    inner = ((Y - sy) / F.nullif(N - n, F.lit(0.0)) - (sy - c * st) / n) / F.nullif(c, F.lit(0.0))
    ends_after = lambda b: (T <= b) & (F.col("t_next").isNull() | (F.col("t_next") > b))
    cand = F.array(
        F.when((T >= lo) & (T <= hi), T),
        F.when((c < 0) & (inner > T) & (inner <= F.col("t_next")) & (inner >= lo) & (inner <= hi), inner),
        F.when(ends_after(lo), lo), F.when(ends_after(hi), hi),
        F.when(F.col("first") & (T > lo), lo))
    e = p.withColumn("th", F.explode(F.filter(cand, lambda x: x.isNotNull())))
    th = F.col("th")
    below = th >= T        # only the flat candidate lies under its row's temperature: it has no cold arm
    e = (e.withColumn("sx", F.when(below, n * th - st).otherwise(0.0))
         .withColumn("sxx", F.when(below, n * th * th - 2 * th * st + stt).otherwise(0.0))
         .withColumn("sxy", F.when(below, th * sy - sty).otherwise(0.0)))
    sx, sxx, sxy = F.col("sx"), F.col("sxx"), F.col("sxy")
    den = N * sxx - sx * sx
    ok = (sx > 1e-9) & (den > 1e-9)
    s0 = F.when(ok, (N * sxy - sx * Y) / den).otherwise(0.0)
    e = e.withColumn("s0", s0).withColumn("b0", (Y - F.col("s0") * sx) / N)
    s = (F.when(F.col("s0") <= 0, 0.0)
         .when(F.col("b0") < 0, F.greatest(F.lit(0.0), sxy / F.nullif(sxx, F.lit(0.0)))).otherwise(F.col("s0")))
    b = F.when(F.col("s0") <= 0, F.greatest(F.lit(0.0), Y / N)).when(F.col("b0") < 0, 0.0).otherwise(F.col("b0"))
    e = e.withColumn("s", s).withColumn("b", b)
    s, b = F.col("s"), F.col("b")
    sse = F.when(s > 0, YY - 2 * b * Y - 2 * s * sxy + N * b * b + 2 * b * s * sx + s * s * sxx).otherwise(YY - 2 * b * Y + N * b * b)
    best = (e.groupBy(*keys).agg(F.min(F.struct(F.round(sse, 9).alias("sse"), th.alias("T_h"), s.alias("s_h"), b.alias("P_base"))).alias("f"),
                                 F.max("tot_n").alias("tot_n"), F.max("tot_y").alias("tot_y"), F.max("tot_yy").alias("tot_yy"),
                                 F.max("t_min").alias("t_min"), F.max("t_max").alias("t_max")))
    sst = F.col("tot_yy") - F.col("tot_y") * F.col("tot_y") / F.col("tot_n")
    return best.select(
        *keys, F.col("tot_n").cast("bigint").alias("n_days"), F.col("f.P_base").alias("P_base"), F.col("f.s_h").alias("s_h"),
        F.col("f.T_h").alias("T_h"), F.col("f.sse").alias("sse"),
        F.when(sst > 1e-9, 1 - F.col("f.sse") / sst).otherwise(0.0).alias("r2"),
        F.col("t_min").alias("T_min"), F.col("t_max").alias("T_max"),
        ((F.col("t_min") < F.col("f.T_h")) & (F.col("f.T_h") < F.col("t_max"))).alias("hinge_inside"),
        ((F.col("f.T_h") <= lo + EDGE) | (F.col("f.T_h") >= hi - EDGE)).alias("at_bound"))


def fit_cooling(df: DataFrame, keys: list[str], t: str = "t", y: str = "y", bounds=COOL_BOUNDS) -> DataFrame:
    """Mirror of the heating hinge: load rises above T_c. Columns P_base, s_c, T_c, sse, r2."""
    f = fit_hinge(df.withColumn("_neg", -F.col(t)), keys, "_neg", y, (-bounds[1], -bounds[0]))
    return f.select(*keys, "n_days", "P_base", F.col("s_h").alias("s_c"), (-F.col("T_h")).alias("T_c"), "sse", "r2", "at_bound")


def _bathtub_solve(m1: Column, m2: Column) -> Column:
    """Best non-negative (base, heat, cool) of one (T_heat, T_cool) pair from its sums: the two arms never overlap,
    so each arm's slope follows from the base alone. Candidates are the active sets; the least SSE wins."""
    N, Y, YY = F.col("N"), F.col("Y"), F.col("YY")
    s1, q1, y1 = F.col("h.s"), F.col("h.q"), F.col("h.y")
    s2, q2, y2 = F.col("c.s"), F.col("c.q"), F.col("c.y")

    def one(use1, use2, base):
        k1 = s1 / F.nullif(q1, F.lit(0.0)) if use1 else F.lit(0.0)
        k2 = s2 / F.nullif(q2, F.lit(0.0)) if use2 else F.lit(0.0)
        b = ((Y - k1 * (y1 if use1 else 0.0) - k2 * (y2 if use2 else 0.0))
             / F.nullif(N - k1 * (s1 if use1 else 0.0) - k2 * (s2 if use2 else 0.0), F.lit(0.0))) if base else F.lit(0.0)
        a1 = (y1 - s1 * b) / F.nullif(q1, F.lit(0.0)) if use1 else F.lit(0.0)
        a2 = (y2 - s2 * b) / F.nullif(q2, F.lit(0.0)) if use2 else F.lit(0.0)
        sse = YY - 2 * b * Y + N * b * b - (2 * a1 * (y1 - b * s1) - a1 * a1 * q1 if use1 else 0.0) - (2 * a2 * (y2 - b * s2) - a2 * a2 * q2 if use2 else 0.0)
        ok = (b >= 0) & (a1 >= 0) & (a2 >= 0)
        return F.when(ok, F.struct(F.round(sse, 9).alias("sse"), b.alias("b"), a1.alias("a1"), a2.alias("a2")))

    opts = [one(u1, u2, base) for u1 in (True, False) for u2 in (True, False) for base in (True, False)]
    return F.array_min(F.filter(F.array(*opts), lambda x: x.isNotNull()))


def _bathtub_pass(c: DataFrame, keys: list[str], heat: Column, cool: Column, tmax_gap: float) -> DataFrame:
    """Best fit over the thresholds in the arrays `heat` and `cool` (T_cool >= T_heat, gap <= tmax_gap)."""
    T, m, my = F.col("T"), F.col("m"), F.col("my")

    def sums(th, sign):
        x = F.greatest(F.lit(0.0), sign * (F.col("th") - T))
        return (c.withColumn("th", F.explode(th)).groupBy(*keys, "th")
                .agg(F.sum(m * x).alias("s"), F.sum(m * x * x).alias("q"), F.sum(my * x).alias("y")))

    h = sums(heat, 1.0).select(*keys, F.struct("th", "s", "q", "y").alias("h"))
    k = sums(cool, -1.0).select(*keys, F.struct("th", "s", "q", "y").alias("c"))
    tot = c.groupBy(*keys).agg(F.sum("m").alias("N"), F.sum("my").alias("Y"), F.sum("myy").alias("YY"))
    e = h.join(k, keys).where((F.col("c.th") >= F.col("h.th")) & (F.col("c.th") - F.col("h.th") <= tmax_gap)).join(tot, keys)
    e = e.withColumn("v", _bathtub_solve(F.col("h"), F.col("c")))
    g = e.groupBy(*keys).agg(F.min(F.struct(F.col("v.sse").alias("sse"), F.col("h.th").alias("T_heat"), F.col("c.th").alias("T_cool"),
                                            F.col("v.b").alias("P_base"), F.col("v.a1").alias("s_heat"), F.col("v.a2").alias("s_cool"))).alias("f"),
                             F.max("N").alias("N"), F.max("Y").alias("Y"), F.max("YY").alias("YY"))
    sst = F.col("YY") - F.col("Y") * F.col("Y") / F.col("N")
    return g.select(*keys, F.col("N").cast("bigint").alias("n_days"), "f.*", F.when(sst > 1e-9, 1 - F.col("f.sse") / sst).otherwise(0.0).alias("r2"))


def _arm(c: DataFrame, keys: list[str], cold: bool) -> DataFrame:
    """Per (entity, temperature): sums over the days up to it (cold) or from it on (warm), the line through them (level a at T = 0, slope k) with its error, and the
    next temperature on the other side of the gap that a threshold may lie in."""
    w = W.partitionBy(*keys).orderBy(F.asc("T") if cold else F.desc("T"))
    run, T, m, my = w.rowsBetween(W.unboundedPreceding, 0), F.col("T"), F.col("m"), F.col("my")
    p = c.select(*keys, "T", F.sum(m).over(run).alias("n"), F.sum(m * T).over(run).alias("t1"), F.sum(m * T * T).over(run).alias("t2"), F.sum(my).over(run).alias("y1"),
                 F.sum(T * my).over(run).alias("ty"), F.sum("myy").over(run).alias("yy"), F.lead(T).over(w).alias("beyond"))
    n, t1, t2, y1, ty, yy = (F.col(x) for x in ("n", "t1", "t2", "y1", "ty", "yy"))
    den = F.when(F.row_number().over(w) > 1, n * t2 - t1 * t1)
    p = p.withColumn("k", (n * ty - t1 * y1) / den)
    k = F.col("k")
    return p.withColumn("a", (y1 - k * t1) / n).withColumn("err", F.greatest(F.lit(0.0), yy - y1 * y1 / n - F.coalesce(k * k * (t2 - t1 * t1 / n), F.lit(0.0))))


def fit_bathtub(df: DataFrame, keys: list[str], t: str = "t", y: str = "y", heat_bounds=HEAT_BOUNDS, gap_max: float = DEADBAND_MAX) -> DataFrame:
    """Heating below T_heat and cooling above T_cool >= T_heat on one shared base, all three coefficients >= 0: the global optimum.

    Two thresholds cut an entity's days into cold, middle and warm ones. Within one cut the best thresholds are where the cold and the warm line (each free) meet the middle's
    level, or lie at a temperature of the data or a bound; so only these are tried, for every cut. A cut's error is never below the errors of its two lines and
    its middle mean: cuts for which that is above the best of a coarse grid and of the two one-armed fits are passed over. On the line T_cool = T_heat + gap_max temperatures of the data are tried alone.
    An arm without slope has no threshold (NULL)."""
    lo, hi = (float(b) for b in heat_bounds)
    top = hi + gap_max
    c = (df.where(F.col(t).isNotNull() & F.col(y).isNotNull()).groupBy(*keys, F.col(t).cast("double").alias("T"))
         .agg(F.count("*").cast("double").alias("m"), F.sum(y).alias("my"), F.sum(F.col(y) * F.col(y)).alias("myy")))
    grid = lambda a, b: F.array(*[F.lit(a + i) for i in range(int(b - a) + 1)])
    single = [fit_hinge(df, keys, t, y, (lo, hi)).select(*keys, F.struct("sse", F.col("T_h").alias("T_heat"), F.lit(None).cast("double").alias("T_cool"), "P_base", F.col("s_h").alias("s_heat"), F.lit(0.0).alias("s_cool")).alias("f")),
              fit_cooling(df, keys, t, y, (lo, top)).select(*keys, F.struct("sse", F.lit(None).cast("double").alias("T_heat"), F.col("T_c").alias("T_cool"), "P_base", F.lit(0.0).alias("s_heat"), F.col("s_c").alias("s_cool")).alias("f")),
              _bathtub_pass(c, keys, grid(lo, hi), grid(lo, top), gap_max).select(*keys, F.struct("sse", "T_heat", "T_cool", "P_base", "s_heat", "s_cool").alias("f"))]
    known = single[0].unionByName(single[1]).unionByName(single[2])
    tot = c.groupBy(*keys).agg(F.sum("m").alias("N"), F.sum("my").alias("Y"), F.sum("myy").alias("YY")).join(known.groupBy(*keys).agg(F.min("f.sse").alias("bound")), keys)
    most = F.col("bound") * (1 + 1e-12) + 1e-9
    cells = ["T", "beyond", "n", "t1", "t2", "y1", "ty", "yy", "k", "a", "err"]
    cold = _arm(c, keys, True).where((F.col("T") <= hi) & (F.coalesce("beyond", F.lit(hi)) >= lo)).select(*keys, F.struct(*cells).alias("c"))
    warm = _arm(c, keys, False).where((F.col("T") >= lo) & (F.coalesce("beyond", F.lit(lo)) <= top)).select(*keys, F.struct(*cells).alias("w"))
    near = lambda d, x: d.join(tot.select(*keys, "bound"), keys).where(F.col(f"{x}.err") <= most).drop("bound")
    e = near(cold, "c").join(near(warm, "w"), keys).where(F.col("c.T") < F.col("w.T")).join(tot, keys)
    v = lambda x: F.col(x)
    mid_n, mid_y, mid_yy = (v(x) - v(f"c.{z}") - v(f"w.{z}") for x, z in (("N", "n"), ("Y", "y1"), ("YY", "yy")))
    mid = F.when(mid_n > 0, mid_y / F.nullif(mid_n, F.lit(0.0)))
    e = e.where(v("c.err") + v("w.err") + F.greatest(F.lit(0.0), mid_yy - F.coalesce(mid_y * mid, F.lit(0.0))) <= most)
    low1, high1 = F.greatest(v("c.T"), F.lit(lo)), F.least(F.coalesce(v("c.beyond"), F.lit(hi)), F.lit(hi))
    low2, high2 = F.coalesce(v("w.beyond"), F.lit(lo)), F.least(v("w.T"), F.lit(top))
    e = e.withColumns({"l1": low1, "u1": high1, "l2": low2, "u2": high2})

    def level(side: str, other: str, th, sign: float):
        """Base of the best (base, slope) on all days but those of `other`, with the arm of `side` fixed at th."""
        n, s = v("N") - v(f"{other}.n"), sign * (v(f"{side}.n") * th - v(f"{side}.t1"))
        q = v(f"{side}.n") * th * th - 2 * th * v(f"{side}.t1") + v(f"{side}.t2")
        xy = sign * (th * v(f"{side}.y1") - v(f"{side}.ty"))
        yo = v("Y") - v(f"{other}.y1")
        return (q * yo - s * xy) / F.nullif(n * q - s * s, F.lit(0.0))
    meet = lambda x, base: (base - v(f"{x}.a")) / F.nullif(v(f"{x}.k"), F.lit(0.0))
    l1, u1, u2 = v("l1"), v("u1"), v("u2")
    pair = lambda a, b: F.struct(a.alias("h"), b.alias("c"))
    tries = [pair(x, z) for x in (l1, u1) for z in (v("l2"), u2)] + [
        pair(meet("c", mid), meet("w", mid)), pair(meet("c", F.lit(0.0)), meet("w", F.lit(0.0)))]
    tries += [pair(meet("c", level("w", "c", z, -1.0)), z) for z in (v("l2"), u2)] + [pair(x, meet("w", level("c", "w", x, 1.0))) for x in (l1, u1)]
    tries += [pair(meet("c", F.lit(0.0)), z) for z in (v("l2"), u2)] + [pair(x, meet("w", F.lit(0.0))) for x in (l1, u1)]
    cross = (v("w.a") - v("c.a")) / F.nullif(v("c.k") - v("w.k"), F.lit(0.0))
    tries += [pair(cross, cross), pair(l1, l1), pair(u1, u1), pair(l1, l1 + gap_max), pair(u1, u1 + gap_max), pair(u2 - gap_max, u2), pair(v("l2") - gap_max, v("l2"))]
    ok = lambda p: (p["h"] >= l1) & (p["h"] <= u1) & (p["c"] >= v("l2")) & (p["c"] <= u2) & (p["c"] >= p["h"]) & (p["c"] - p["h"] <= gap_max)
    e = e.withColumn("th", F.explode(F.filter(F.array(*tries), ok)))

    def sums(x: str, th, sign: float):
        return F.struct(th.alias("th"), (sign * (v(f"{x}.n") * th - v(f"{x}.t1"))).alias("s"), (v(f"{x}.n") * th * th - 2 * th * v(f"{x}.t1") + v(f"{x}.t2")).alias("q"),
                        (sign * (th * v(f"{x}.y1") - v(f"{x}.ty"))).alias("y"))
    e = e.select(*keys, "N", "Y", "YY", sums("c", v("th.h"), 1.0).alias("h"), sums("w", v("th.c"), -1.0).alias("c"))
    e = e.withColumn("v", _bathtub_solve(F.col("h"), F.col("c")))
    pairs = e.select(*keys, F.struct(v("v.sse").alias("sse"), v("h.th").alias("T_heat"), v("c.th").alias("T_cool"), v("v.b").alias("P_base"), v("v.a1").alias("s_heat"), v("v.a2").alias("s_cool")).alias("f"))
    g = known.unionByName(pairs).groupBy(*keys).agg(F.min("f").alias("f")).join(tot, keys)
    sst = F.col("YY") - F.col("Y") * F.col("Y") / F.col("N")
    return g.select(*keys, F.col("N").cast("bigint").alias("n_days"), "f.sse", F.when(v("f.s_heat") > 0, F.round(v("f.T_heat"), 9)).alias("T_heat"), F.when(v("f.s_cool") > 0, F.round(v("f.T_cool"), 9)).alias("T_cool"),
                    "f.P_base", "f.s_heat", "f.s_cool", F.when(sst > 1e-9, 1 - F.col("f.sse") / sst).otherwise(0.0).alias("r2"))


def fit_degree_line(df: DataFrame, keys: list[str], x: str = "hdh", y: str = "y") -> DataFrame:
    """y = base + s * x with both coefficients >= 0; one row per entity."""
    ok = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    g = ok.groupBy(*keys).agg(
        F.count("*").cast("double").alias("N"), F.sum(x).alias("X"), F.sum(y).alias("Y"), F.sum(F.col(x) * F.col(x)).alias("XX"),
        F.sum(F.col(x) * F.col(y)).alias("XY"), F.sum(F.col(y) * F.col(y)).alias("YY"))
    N, X, Y, XX, XY, YY = (F.col(c) for c in ("N", "X", "Y", "XX", "XY", "YY"))
    den = N * XX - X * X
    g = g.withColumn("s0", F.when(den > 1e-9, (N * XY - X * Y) / den).otherwise(0.0)).withColumn("b0", (Y - F.col("s0") * X) / N)
    s = F.when(F.col("s0") <= 0, 0.0).when(F.col("b0") < 0, F.greatest(F.lit(0.0), XY / F.nullif(XX, F.lit(0.0)))).otherwise(F.col("s0"))
    b = F.when(F.col("s0") <= 0, F.greatest(F.lit(0.0), Y / N)).when(F.col("b0") < 0, 0.0).otherwise(F.col("b0"))
    g = g.withColumn("s", s).withColumn("b", b)
    s, b = F.col("s"), F.col("b")
    sst = YY - Y * Y / N
    sse = YY - 2 * b * Y - 2 * s * XY + N * b * b + 2 * b * s * X + s * s * XX
    return g.select(*keys, N.cast("bigint").alias("n_days"), b.alias("base"), s.alias("slope"),
                    F.when(sst > 1e-9, 1 - sse / sst).otherwise(0.0).alias("r2"))


def slope_fixed_hinge(df: DataFrame, keys: list[str], t: str, y: str, t_h, t_cold: float = 12.0) -> DataFrame:
    """OLS slope on max(0, T_h - T) with a given T_h, and OLS slope of y on -T over days colder than `t_cold`."""
    th = F.col(t_h) if isinstance(t_h, str) else F.lit(float(t_h))
    x = F.greatest(F.lit(0.0), th - F.col(t))
    cold = F.col(t) < t_cold
    return df.groupBy(*keys).agg(
        F.regr_slope(F.col(y), x).alias("slope_fixed"),
        F.regr_slope(F.when(cold, F.col(y)), F.when(cold, -F.col(t))).alias("slope_cold"),
        F.count_if(cold).cast("bigint").alias("n_cold"))


def saturation_arm(df: DataFrame, keys: list[str], t: str, sf: str, t_h: str, min_points: int = 10, side: str = "h") -> DataFrame:
    """OLS of the saturation factor on the distance to the threshold, on its side only: b, m, extreme value, r2.
    Fewer than `min_points` points or a constant factor give NULLs."""
    x = F.col(t_h) - F.col(t) if side == "h" else F.col(t) - F.col(t_h)
    d = df.withColumn("_x", F.when(x > 0, x)).withColumn("_y", F.when(x > 0, F.col(sf)))
    g = d.groupBy(*keys).agg(
        F.count("_x").alias("n"), F.stddev_pop("_y").alias("sd"), F.regr_slope("_y", "_x").alias("m0"), F.regr_intercept("_y", "_x").alias("b0"),
        F.regr_r2("_y", "_x").alias("r0"), F.max(x).alias("ext"))
    ok = (F.col("n") >= min_points) & (F.col("sd") > 0)
    m, b = F.when(ok, F.col("m0")), F.when(ok, F.col("b0"))
    return g.select(*keys, F.col("n").cast("bigint").alias("n_arm"), b.alias("b"), m.alias("m"),
                    F.when(ok, F.least(F.lit(1.0), F.greatest(F.lit(0.0), b + m * F.col("ext")))).alias("sf_extreme"), F.when(ok, F.col("r0")).alias("arm_r2"))
