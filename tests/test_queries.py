"""Registered queries against DuckDB on the small tables. WATTLOOM_ALL=1 runs every query, else one of each family."""
import os

import pytest

import check

QUICK = ("s01_", "s13_", "p06_", "p09_", "p11_", "j06_", "a01_", "a05_", "a07_", "a14_", "a20_", "w01_", "w05_", "w06_", "r01_", "r14_", "g02_", "g03_", "m02_", "t02_", "t14_log_m", "x01_stream_r")


def names():
    import __spark_entry__ as E
    q = E.queries()
    return [n for n in q if os.environ.get("WATTLOOM_ALL") or n.startswith(QUICK)]


@pytest.mark.parametrize("name", names())
def test_query(spark, name):
    import __spark_entry__ as E
    d = f"{check.DATA}/sf0.001"
    msg, rows = check.compare(E.queries()[name](spark, d), check.connect(d), E.oracle_sql().get(name))
    assert msg is None and rows >= 0


def test_entry(spark):
    import __spark_entry__ as E
    assert E.entry(spark).count() >= 0
