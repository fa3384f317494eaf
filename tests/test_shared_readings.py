"""Day sums of train households, peaks of members, and how often a plan sums the orders."""
import shutil

from wattloom.operators import cohorts as K, estimators as E
from wattloom.plans import q_cohorts as C, q_estimators as QE
from wattloom.sources import tables as X


def test_train_days_equal_the_sums_of_each_set(spark):
    homes = [(h, "hp" if h % 3 else "fill", h % 2) for h in range(12)]
    pool = spark.createDataFrame([(h, r, s, seed, "train" if (h + seed) % 4 else "test", -1) for h, r, s in homes for seed in (0, 1)]
                                 + [(h, r, s, seed, "inner", 0) for h, r, s in homes for seed in (0, 1)], "hh int, role string, station int, seed int, split string, fold int")
    readings = spark.createDataFrame([(h, r, s, day, h / 4, day / 2) for h, r, s in homes for day in range(5) if (h + day) % 5], "hh int, role string, station int, day int, hp double, own double")
    got = {tuple(r) for r in K.train_days(K.with_train_seeds(readings, pool)).select("seed", "role", "station", "day", "n", "hp", "own").collect()}
    keys = ["seed", "role", "station"]
    want = {tuple(r) for r in E.set_days(pool.where("split = 'train'"), keys, readings).select(*keys, "day", "n", "hp", "own").collect()}
    assert got == want and len(want) > 20


def test_peaks_of_members_are_those_of_all(spark):
    d = "/root/testdata/sf0.01"
    m = C.member_plan(spark, d)
    m = m.where("seed = 0 AND split = 'test' AND station = 1")
    some = {r.hh: r.hp_peak for r in C.peak_plan(spark, d, m).collect()}
    whole = {r.hh: r.hp_peak for r in C.peak_plan(spark, d).collect()}
    have = {r.hh for r in m.where("role = 'hp'").collect()} & whole.keys()
    assert 0 < len(some) < len(whole) and some == {h: whole[h] for h in have}


def test_a_plan_sums_the_orders_once(spark, tmp_path, monkeypatch):
    d = str(tmp_path / "tables")
    shutil.copytree("/root/testdata/sf0.001", d)
    calls, real = [], X.daily_own
    monkeypatch.setattr(X, "daily_own", lambda *a: calls.append(1) or real(*a))
    QE.with_crossfit(spark, d, QE.estimate_plan(spark, d))
    assert len(calls) == 1
