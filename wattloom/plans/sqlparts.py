"""SQL text of the regressions, for the result checks (written against per-entity scans, not the Spark plan)."""
from __future__ import annotations


def hinge(name: str, src: str, keys: str, t: str = "t", y: str = "y", lo: float = 8.0, hi: float = 20.0) -> str:
    """CTEs ending in `name`(keys, n_days, P_base, s_h, T_h, sse, r2, T_min, T_max, hinge_inside, at_bound)."""
    k = keys
    return f"""
{name}_c AS (SELECT {k}, CAST({t} AS DOUBLE) AS T, count(*)::DOUBLE AS m, sum({y}) AS my, sum({y}*{y}) AS myy FROM {src}
  WHERE {t} IS NOT NULL AND {y} IS NOT NULL GROUP BY {k}, CAST({t} AS DOUBLE)),
{name}_p AS (SELECT {k}, T, sum(m) OVER w AS n, sum(m*T) OVER w AS st, sum(m*T*T) OVER w AS stt, sum(my) OVER w AS sy, sum(T*my) OVER w AS sty,
  sum(m) OVER a AS N_, sum(my) OVER a AS Y, sum(myy) OVER a AS YY, min(T) OVER a AS t_min, max(T) OVER a AS t_max, lead(T) OVER (PARTITION BY {k} ORDER BY T) AS t_next,
  row_number() OVER (PARTITION BY {k} ORDER BY T) AS rn
  FROM {name}_c WINDOW w AS (PARTITION BY {k} ORDER BY T ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY {k})),
{name}_i AS (SELECT *, (n*sty-st*sy)/nullif(n*stt-st*st,0) AS c FROM {name}_p),
{name}_j AS (SELECT *, ((Y-sy)/nullif(N_-n,0)-(sy-c*st)/n)/nullif(c,0) AS x FROM {name}_i),
{name}_k AS (
  SELECT *, T AS th FROM {name}_j WHERE T BETWEEN {lo} AND {hi}
  UNION ALL SELECT *, x AS th FROM {name}_j WHERE c<0 AND x>T AND x<=t_next AND x BETWEEN {lo} AND {hi}
  UNION ALL SELECT *, {lo}::DOUBLE AS th FROM {name}_j WHERE T<={lo} AND (t_next IS NULL OR t_next>{lo})
  UNION ALL SELECT *, {hi}::DOUBLE AS th FROM {name}_j WHERE T<={hi} AND (t_next IS NULL OR t_next>{hi})),
{name}_s AS (SELECT {k}, N_, Y, YY, t_min, t_max, th, n*th-st AS sx, n*th*th-2*th*st+stt AS sxx, th*sy-sty AS sxy FROM {name}_k
  UNION ALL SELECT {k}, N_, Y, YY, t_min, t_max, {lo}::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM {name}_j WHERE rn=1 AND T>{lo}),
{name}_o AS (SELECT *, CASE WHEN sx>1e-9 AND N_*sxx-sx*sx>1e-9 THEN (N_*sxy-sx*Y)/(N_*sxx-sx*sx) ELSE 0.0::DOUBLE END AS s0 FROM {name}_s),
{name}_q AS (SELECT *, CASE WHEN s0<=0 THEN 0.0::DOUBLE WHEN (Y-s0*sx)/N_<0 THEN greatest(0.0::DOUBLE, sxy/nullif(sxx,0)) ELSE s0 END AS s,
  CASE WHEN s0<=0 THEN greatest(0.0::DOUBLE, Y/N_) WHEN (Y-s0*sx)/N_<0 THEN 0.0::DOUBLE ELSE (Y-s0*sx)/N_ END AS b FROM {name}_o),
{name}_r AS (SELECT *, round(CASE WHEN s>0 THEN YY-2*b*Y-2*s*sxy+N_*b*b+2*b*s*sx+s*s*sxx ELSE YY-2*b*Y+N_*b*b END, 9) AS sse FROM {name}_q),
{name}_z AS (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY sse, th, s, b) AS rk FROM {name}_r),
{name} AS (SELECT {k}, CAST(N_ AS BIGINT) AS n_days, b AS P_base, s AS s_h, th AS T_h, sse,
  CASE WHEN YY-Y*Y/N_>1e-9 THEN 1-sse/(YY-Y*Y/N_) ELSE 0.0::DOUBLE END AS r2, t_min AS T_min, t_max AS T_max,
  (t_min<th AND th<t_max) AS hinge_inside, (th<={lo}+1e-3 OR th>={hi}-1e-3) AS at_bound FROM {name}_z WHERE rk=1)"""


def bathtub(name: str, src: str, keys: str, t: str = "t", y: str = "y", lo: float = 8.0, hi: float = 20.0, gap: float = 24.0) -> str:
    """CTEs ending in `name`(keys, n_days, T_heat, T_cool, P_base, s_heat, s_cool, r2): every cut of the temperatures into cold, middle and warm, every candidate, no pruning.
    The one-armed fits come from two hinges."""
    k, top = keys, hi + gap
    on = lambda a, b: " AND ".join(f"{a}.{x.strip()}={b}.{x.strip()}" for x in keys.split(","))
    arm = lambda order: f"""SELECT *, y1/n-k*t1/n AS a FROM (SELECT *, CASE WHEN rn>1 THEN (n*ty-t1*y1)/nullif(n*t2-t1*t1,0) END AS k FROM (SELECT {k}, T, sum(m) OVER w AS n, sum(m*T) OVER w AS t1, sum(m*T*T) OVER w AS t2, sum(my) OVER w AS y1, sum(T*my) OVER w AS ty,
 lead(T) OVER o AS beyond, row_number() OVER o AS rn FROM {name}_c WINDOW w AS (PARTITION BY {k} ORDER BY T {order} ROWS UNBOUNDED PRECEDING), o AS (PARTITION BY {k} ORDER BY T {order})))"""  # noqa: E731

    def level(s: str, o: str, th: str, sign: int) -> str:
        d, q, xy = f"({sign}*({s}n*{th}-{s}t1))", f"({s}n*{th}*{th}-2*{th}*{s}t1+{s}t2)", f"({sign}*({th}*{s}y1-{s}ty))"
        return f"(({q}*(Y-{o}y1)-{d}*{xy})/nullif((N_-{o}n)*{q}-{d}*{d},0))"
    meet = lambda s, base: f"(({base}-{s}a)/nullif({s}k,0))"
    mid = "((Y-cy1-wy1)/nullif(N_-cn-wn,0))"
    cross = "((wa-ca)/nullif(ck-wk,0))"
    tries = [(x, z) for x in ("l1", "u1") for z in ("l2", "u2")] + [(meet("c", mid), meet("w", mid)), (meet("c", "0"), meet("w", "0"))]
    tries += [(meet("c", level("w", "c", z, -1)), z) for z in ("l2", "u2")] + [(x, meet("w", level("c", "w", x, 1))) for x in ("l1", "u1")]
    tries += [(meet("c", "0"), z) for z in ("l2", "u2")] + [(x, meet("w", "0")) for x in ("l1", "u1")]
    tries += [(cross, cross), ("l1", "l1"), ("u1", "u1"), ("l1", f"l1+{gap}"), ("u1", f"u1+{gap}"), (f"u2-{gap}", "u2"), (f"l2-{gap}", "l2")]
    side = lambda p: ", ".join(f"{p}.{x} AS {p}{x}" for x in ("n", "t1", "t2", "y1", "ty", "k", "a"))
    return f"""{hinge(name + "_h", src, k, t, y, lo, hi)}, {name}_n AS (SELECT {k}, -{t} AS nt, {y} AS y FROM {src}), {hinge(name + "_k", name + "_n", k, "nt", "y", -top, -lo)},
{name}_c AS (SELECT {k}, CAST({t} AS DOUBLE) AS T, count(*)::DOUBLE AS m, sum({y}) AS my, sum({y}*{y}) AS myy FROM {src} WHERE {t} IS NOT NULL AND {y} IS NOT NULL GROUP BY {k}, CAST({t} AS DOUBLE)),
{name}_1 AS ({arm("ASC")}), {name}_2 AS ({arm("DESC")}), {name}_t AS (SELECT {k}, sum(m) AS N_, sum(my) AS Y, sum(myy) AS YY FROM {name}_c GROUP BY {k}),
{name}_p AS (SELECT t.*, {side("c")}, {side("w")}, greatest(c.T, {lo}::DOUBLE) AS l1, least(coalesce(c.beyond,{hi}),{hi}::DOUBLE) AS u1, coalesce(w.beyond,{lo}::DOUBLE) AS l2, least(w.T,{top}::DOUBLE) AS u2
 FROM {name}_1 c JOIN {name}_2 w ON {on("c", "w")} AND c.T<w.T JOIN {name}_t t ON {on("c", "t")} WHERE c.T<={hi} AND coalesce(c.beyond,{hi})>={lo} AND w.T>={lo} AND coalesce(w.beyond,{lo})<={top}),
{name}_q AS ({" UNION ALL ".join(f"SELECT *, {h}::DOUBLE AS h_, {c}::DOUBLE AS c_ FROM {name}_p" for h, c in tries)}),
{name}_s AS (SELECT {k}, N_, Y, YY, h_, c_, cn*h_-ct1 AS s1, cn*h_*h_-2*h_*ct1+ct2 AS q1, h_*cy1-cty AS y1, -(wn*c_-wt1) AS s2, wn*c_*c_-2*c_*wt1+wt2 AS q2, -(c_*wy1-wty) AS y2
 FROM {name}_q WHERE h_>=l1 AND h_<=u1 AND c_>=l2 AND c_<=u2 AND c_>=h_ AND c_-h_<={gap}),
{name}_b AS (SELECT *, CASE WHEN ub THEN (Y-CASE WHEN a THEN s1/nullif(q1,0)*y1 ELSE 0 END-CASE WHEN z THEN s2/nullif(q2,0)*y2 ELSE 0 END)/nullif(N_-CASE WHEN a THEN s1/nullif(q1,0)*s1 ELSE 0 END-CASE WHEN z THEN s2/nullif(q2,0)*s2 ELSE 0 END,0) ELSE 0.0::DOUBLE END AS b
 FROM {name}_s, (VALUES (true),(false)) x(a), (VALUES (true),(false)) w(z), (VALUES (true),(false)) v(ub)),
{name}_e AS (SELECT *, CASE WHEN a THEN (y1-s1*b)/nullif(q1,0) ELSE 0.0::DOUBLE END AS a1, CASE WHEN z THEN (y2-s2*b)/nullif(q2,0) ELSE 0.0::DOUBLE END AS a2 FROM {name}_b),
{name}_f AS (SELECT {k}, round(YY-2*b*Y+N_*b*b-CASE WHEN a THEN 2*a1*(y1-b*s1)-a1*a1*q1 ELSE 0 END-CASE WHEN z THEN 2*a2*(y2-b*s2)-a2*a2*q2 ELSE 0 END,9) AS sse, h_ AS T_heat, c_ AS T_cool, b AS P_base, a1 AS s_heat, a2 AS s_cool
  FROM {name}_e WHERE b>=0 AND a1>=0 AND a2>=0
 UNION ALL SELECT {k}, sse, T_h, NULL, P_base, s_h, 0.0::DOUBLE FROM {name}_h UNION ALL SELECT {k}, sse, NULL, -T_h, P_base, 0.0::DOUBLE, s_h FROM {name}_k),
{name}_g AS (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY sse, T_heat NULLS FIRST, T_cool NULLS FIRST, P_base, s_heat, s_cool) AS rk FROM {name}_f),
{name} AS (SELECT {", ".join("g." + x.strip() for x in keys.split(","))}, CAST(N_ AS BIGINT) AS n_days, CASE WHEN s_heat>0 THEN T_heat END AS T_heat, CASE WHEN s_cool>0 THEN T_cool END AS T_cool, P_base, s_heat, s_cool,
 CASE WHEN YY-Y*Y/N_>1e-9 THEN 1-sse/(YY-Y*Y/N_) ELSE 0.0::DOUBLE END AS r2 FROM {name}_g g JOIN {name}_t t ON {on("g", "t")} WHERE rk=1)"""


def metrics(y: str = "y", p: str = "p") -> dict[str, str]:
    """Aggregate expressions of the error metrics."""
    return {
        "nmae": f"CASE WHEN max({y})>0 THEN avg(abs({p}-{y}))/max({y})*100 END",
        "y_max": f"max({y})",
        "wape": f"CASE WHEN sum({y})>0 THEN sum(abs({p}-{y}))/sum({y})*100 END",
        "mape": f"avg(CASE WHEN {y}<>0 THEN abs({p}-{y})/abs({y}) END)*100",
        "r2": f"CASE WHEN count({y})>1 AND var_pop({y})>0 THEN 1-avg(({p}-{y})*({p}-{y}))/var_pop({y}) END",
        "rmse": f"sqrt(avg(({p}-{y})*({p}-{y})))",
        "mae": f"avg(abs({p}-{y}))",
    }


def hint(*parts: str) -> str:
    """First 32 bits of md5 of the parts joined by '|'."""
    return "CAST('0x'||substr(md5(concat_ws('|'," + ",".join(parts) + ")),1,8) AS BIGINT)"


def md(*parts: str) -> str:
    return "md5(concat_ws('|'," + ",".join(parts) + "))"
