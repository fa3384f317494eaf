"""Weighted draws, substations without replacement and learning-curve designs."""
from collections import Counter

import pytest
from pyspark.sql import functions as F

from wattloom.operators import cohorts as K


@pytest.fixture(scope="module")
def homes(spark):
    rows = [(f"h{s}{i:02d}", "hp", s) for s, n in ((0, 24), (1, 12), (2, 2)) for i in range(n)] + [(f"f{i:03d}", "fill", None) for i in range(80)]
    return spark.createDataFrame(rows, "hh string, role string, station int").cache()


def test_weighted_draws_follow_the_weights(spark):
    st = spark.createDataFrame([(0, i, w) for i, w in enumerate([5, 1, 0, 40, 3, 3, 3, 900])], "g int, station int, H long").where("H > 0")
    d = spark.range(2000).select(F.lit(0).alias("g"), "id")
    got = K.draw_weighted(d, st, ["g"], "H", F.col("id") / 2000).collect()
    edges, low = {}, 0
    for r in st.orderBy("station").collect():
        edges[r.station], low = (low, low + r.H), low + r.H
    assert len(got) == 2000 and all(edges[r.station][0] <= r.id / 2000 * low < edges[r.station][1] for r in got) and Counter(r.station for r in got)[7] > 1800


def test_substations_without_replacement(homes):
    split = K.household_splits(homes, [4])
    pool = split.withColumn("fold", F.lit(-1))
    subs, members = K.draw_without_replacement(pool, {"train": 40, "test": 20}, 9, (10, 40), (0.1, 1.0))
    side = {r.hh: (r.split, r.station, r.role) for r in pool.collect()}
    have = Counter((r.split, r.station) for r in pool.where("role = 'hp'").collect())
    s, by = {r.sub_id: r for r in subs.collect()}, {}
    for m in members.collect():
        by.setdefault(m.sub_id, []).append(m)
    assert Counter(r.split for r in s.values()) == {"train": 40, "test": 20} and by.keys() == s.keys()
    for k, r in s.items():
        hh = [m.hh for m in by[k]]
        assert len(set(hh)) == len(hh) and r.H == have[r.split, r.station] >= 3 and 1 <= r.n_hp <= r.H and 10 <= r.size <= 40
        assert all(side[m.hh][0] == r.split and side[m.hh][2] == m.role and (m.role == "fill" or side[m.hh][1] == r.station) for m in by[k])
        assert sum(m.role == "hp" for m in by[k]) == r.n_hp and len(hh) == r.n_hp + min(r.size - r.n_hp, r.F)
    assert {r.station for r in s.values()} == {0, 1} or (("train", 2) in have and have["train", 2] < 3)


def test_learning_curve_designs(homes):
    split = K.household_splits(homes, [0, 1]).cache()
    ns = [6, 12, 500, None]
    pool, reasons = K.learning_curve_pools(split, ns, 2)
    rows = pool.collect()
    hp = {}
    for r in rows:
        if r.role == "hp" and r.split.startswith("train"):
            hp.setdefault((r.seed, r.split), set()).add(r.hh)
    n_train = Counter(r.seed for r in split.where("split = 'train' AND role = 'hp'").collect())
    for s in (0, 1):
        assert len(hp[s, "train@6@0"]) == 6 and hp[s, "train@6@0"] < hp[s, "train@12@0"] < hp[s, "train@all@0"] and len(hp[s, "train@all@0"]) == n_train[s]
        assert hp[s, "train@12@0"] != hp[s, "train@12@1"] and (s, "train@all@1") not in hp
    got = {(r.seed, r.n, r.lc_draw): r.reason for r in reasons.collect()}
    assert got == {(s, 500, i): f"n = 500 > {n_train[s]} train HP households" for s in (0, 1) for i in (0, 1)}
    inner = {}
    for r in rows:
        if r.split.startswith("inner"):
            inner.setdefault((r.seed, r.split[6:]), []).append((r.hh, r.fold))
    for (s, lab), x in inner.items():                        # each design's households are dealt once; with all of them the folds are those of the main run
        assert len(dict(x)) == len(x) and {h for h, _ in x} >= hp[s, f"train@{lab}"]
    main = {(r.seed, r.hh): r.fold for r in K.inner_folds(split).collect()}
    assert all(dict(inner[s, "all@0"])[h] == f for (s, h), f in main.items())
    m = K.learning_curve_members(pool, ns, 2, (10,), (0.2,), {"train": 2, "test": 2, "inner": 1}, 2, 1.0)
    test = split.withColumn("fold", F.lit(-1)).where("split = 'test'")
    whole = K.draw_members(K.substations(K.plan_cells(test, (10,), (0.2,), 2, 1.0), {"test": 2}), test)
    same = K.members_digest(m.where("part = 'test'"), ["seed"]).collect()
    assert sorted(same) == sorted(K.members_digest(whole, ["seed"]).collect()) and len(same) == 2
    other = K.members_digest(m.where("part = 'test'").withColumn("hh", F.concat("hh", F.lit("x"))), ["seed"]).collect()
    assert {r.digest for r in other}.isdisjoint(r.digest for r in same)


def test_shared_tables_are_written_once_and_anew_after_a_change(spark, tmp_path):
    from wattloom.session import shared
    src, made = str(tmp_path / "in.parquet"), []

    def make():
        made.append(1)
        return spark.read.parquet(src).withColumn("b", F.col("id") * 2)
    spark.range(5).write.parquet(src)
    assert shared(spark, "twice", [src], make).count() == 5 and shared(spark, "twice", [src], make).count() == 5 and len(made) == 1
    import time
    time.sleep(1.1)
    spark.range(7).write.mode("overwrite").parquet(src)
    assert shared(spark, "twice", [src], make).count() == 7 and len(made) == 2
