"""Run registered queries against DuckDB: python tests/check.py [sf] [prefix ...]"""
from __future__ import annotations

import datetime
import decimal
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402
import pandas as pd  # noqa: E402

DATA = "/root/testdata"


def connect(d):
    from wattloom.sources.tables import NAMES
    c = duckdb.connect()
    for t in NAMES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    return c


def norm(v):
    if v is None or v is pd.NaT:
        return None
    if isinstance(v, float):
        return None if v != v else float(v) + 0.0
    if isinstance(v, decimal.Decimal):
        return float(v)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, pd.Timestamp):
        return v.tz_localize(None).to_pydatetime() if v.tzinfo else v.to_pydatetime()
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return [cols[i] for i in order], sorted(out, key=repr)


def compare(df, con, sql):
    """(message or None, spark rows) of one query."""
    sc, sr = canon(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None, len(sr)
    cur = con.execute(sql)
    oc, orr = canon([c[0] for c in cur.description], cur.fetchall())
    if sc != oc:
        return f"columns {sc} != {oc}", len(sr)
    if len(sr) != len(orr):
        return f"rows {len(sr)} != {len(orr)}\n   S {sr[:2]}\n   O {orr[:2]}", len(sr)
    bad = [(a, b) for a, b in zip(sr, orr) if a != b]
    if bad:
        diff = [(c, x, y) for c, x, y in zip(sc, *bad[0]) if x != y]
        return f"{len(bad)} of {len(sr)} rows differ, first: {diff}\n   S {bad[0][0]}", len(sr)
    types = {type(x) for r in sr for x in r} ^ {type(x) for r in orr for x in r}
    return (f"types differ {types}" if types else None), len(sr)


def main(argv):
    from wattloom.session import local_session
    import __spark_entry__ as E
    sf = next((a for a in argv if a.startswith("sf")), "sf0.01")
    want = [a for a in argv if not a.startswith("sf")]
    spark, d = local_session(), f"{DATA}/{sf}"
    con, bad = connect(d), []
    Q, O = E.queries(), E.oracle_sql()
    for n, fn in Q.items():
        if want and not any(n.startswith(w) for w in want):
            continue
        t = time.time()
        try:
            msg, rows = compare(fn(spark, d), con, O.get(n))
        except Exception as e:  # noqa: BLE001
            msg, rows = f"{type(e).__name__}: {str(e)[:700]}", -1
        print(f"{'ok  ' if msg is None else 'FAIL'} {n} rows={rows} {time.time()-t:.1f}s{'' if n in O else ' (no oracle)'} {msg or ''}", flush=True)
        if msg:
            bad.append(n)
    print(f"{len(bad)} failed: {bad}")
    return len(bad)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
