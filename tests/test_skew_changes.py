"""Salted aggregation, skewed joins and snapshot changes on small fixtures."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mnemoria.operators.changes import snapshot_changes, validity_intervals
from mnemoria.operators.skew import add_salt, heavy_hashes, heavy_keys, salted_aggregate, skewed_lookup

SNAP = "snapshot_ms long, key string, value string, relevance double, received_ms long"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_salted_aggregate_equals_plain(spark):
    data = [("hot", i % 7, float(i % 5)) for i in range(3000)] + [(f"k{i}", i, None) for i in range(200)] + [(None, 1, 2.0)]
    df = spark.createDataFrame(data, "k string, v int, w double")
    got = salted_aggregate(df, ["k"], {"n": ("count", None), "nw": ("count", "w"), "s": ("sum", "w"), "lo": ("min", "v"), "hi": ("max", "v"), "d": ("count_distinct", "v"), "a": ("avg", "w")})
    want = df.selectExpr("k", "v", "w").groupBy("k").agg({"v": "max"})
    by = {r["k"]: r for r in got.collect()}
    assert len(by) == want.count() == 202
    assert by["hot"]["n"] == 3000 and by["hot"]["d"] == 7 and by["hot"]["s"] == sum(float(i % 5) for i in range(3000)) and by["hot"]["a"] == pytest.approx(2.0)
    assert by["k3"]["nw"] == 0 and by["k3"]["s"] is None and by["k3"]["a"] is None and by["k3"]["d"] == 1
    assert by[None]["n"] == 1


def test_salts_split_a_heavy_key_that_is_only_counted(spark):
    df = spark.range(0, 40000, 1, 40).selectExpr("CASE WHEN id % 10 < 7 THEN 'hot' ELSE 'k' || id END AS k")
    heavy, total = heavy_hashes(df, ["k"])
    salts = add_salt(df, ["k"], heavy, total).groupBy("k").agg(F.countDistinct("__salt").alias("n")).where("n > 1").collect()
    assert [(r["k"], r["n"] >= 20) for r in salts] == [("hot", True)]
    plan = salted_aggregate(df, ["k"], {"n": ("count", None)})
    assert "hashpartitioning(__k0" in (text := plan._jdf.queryExecution().toString()) and "__salt" in text
    # rows that repeat in full have nothing but their partition to part them
    assert rows(heavy_keys(df, "k", 0.5)) == [("hot", 28000)]
    again = df.selectExpr("k", "1 AS v")
    assert add_salt(again, ["k"], heavy, total).where("k = 'hot'").select("__salt").distinct().count() >= 20


def test_wide_lookups_are_salted_and_not_broadcast(spark, monkeypatch):
    from mnemoria.operators import skew

    df = spark.createDataFrame([("hot", i) for i in range(900)] + [(f"k{i}", i) for i in range(600)] + [("none", 0), (None, 1)], "k string, v int").repartition(6)
    lookup = spark.createDataFrame([("hot", "x" * 5000)] + [(f"k{i}", "c") for i in range(600)], "k string, x string")
    want = {how: rows(df.join(lookup, ["k"], how)) for how in ("inner", "left")}
    monkeypatch.setattr(skew, "BROADCAST_BYTES", 1000)
    for how in want:
        assert rows(skewed_lookup(df, lookup, ["k"], how)) == want[how]


def test_what_is_heavy_follows_the_partitions(spark):
    df = spark.range(1000).selectExpr("CASE WHEN id < 6 THEN 'six' ELSE 'k' || id END AS k")
    assert heavy_hashes(df, ["k"])[0] == {}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        assert list(heavy_hashes(df, ["k"])[0].values()) == [6]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_clashing_names_extra_columns_and_empty(spark):
    df = spark.createDataFrame([("a", 1, "x", 0)], "k string, __salt int, __k0 string, n int")
    assert rows(salted_aggregate(df, ["k"], {"n": ("count", None), "__salt": ("sum", "__salt")})) == [("a", 1, 1)]
    assert rows(salted_aggregate(df.limit(0), ["k"], {"n": ("count", None)})) == []
    with pytest.raises(ValueError):
        salted_aggregate(df, ["k"], {"x": ("median", "n")})


def test_heavy_keys_ignore_null_but_count_its_rows(spark):
    df = spark.createDataFrame([("a",)] * 5 + [(None,)] * 94 + [("b",)], "k string")
    assert rows(heavy_keys(df, "k", 0.02)) == [("a", 5)]
    assert rows(heavy_keys(df, "k", 0.01)) == [("a", 5), ("b", 1)]
    assert rows(heavy_keys(df.limit(0), "k")) == []


def test_sketch_finds_hot_key_and_lookup_keeps_all_rows(spark):
    df = spark.createDataFrame([("hot", i) for i in range(900)] + [(f"k{i}", i) for i in range(600)] + [("none", 0)], "k string, v int")
    heavy, total = heavy_hashes(df, ["k"])
    assert total == 1501 and len(heavy) == 1
    lookup = spark.createDataFrame([("hot", "h")] + [(f"k{i}", "c") for i in range(600)], "k string, x string")
    assert skewed_lookup(df, lookup, ["k"]).count() == 1500
    assert skewed_lookup(df, lookup, ["k"], "left").count() == 1501


def brute(data):
    last = {}
    for snap, key, value, rel, received in data:
        if snap is None or key is None:
            continue
        if (snap, key) not in last or received > last[snap, key][0]:
            last[snap, key] = (received, value, None if rel is None else round(rel, 4))
    snaps = sorted({s for s, _ in last})
    out = []
    for before, now in zip(snaps, snaps[1:]):
        a, b = ({k: v[1:] for (s, k), v in last.items() if s == x} for x in (before, now))
        out += [(now, k, "added") for k in b.keys() - a.keys()] + [(now, k, "removed") for k in a.keys() - b.keys()] + [(now, k, "changed") for k in a.keys() & b.keys() if a[k] != b[k]]
    return sorted(out, key=repr)


def test_changes_on_a_fixture(spark):
    data = [
        (1, "same", "v", 0.5, 10), (2, "same", "v", 0.50000001, 20), (3, "same", "v", 0.5, 30),
        (1, "gap", "v", 0.5, 10), (3, "gap", "v", 0.5, 30), (2, "late", "a", None, 20), (2, "late", "b", None, 25), (3, "late", "b", None, 30),
        (1, "null", None, 0.1, 10), (2, "null", "", 0.1, 20), (2, "null", "", 0.1, 20), (3, "null", None, 0.1, 30), (2, None, "x", 0.1, 20), (None, "x", "x", 0.1, 20),
    ]
    df = spark.createDataFrame(data, SNAP)
    assert rows(snapshot_changes(df)) == brute(data)
    assert rows(snapshot_changes(df.limit(0))) == []
    assert rows(snapshot_changes(df.where("snapshot_ms = 1"))) == []
    spans = {r["key"]: r for r in validity_intervals(df, {"value": df["value"]}).where("key = 'same'").collect()}
    assert (spans["same"]["first_snap"], spans["same"]["last_snap"]) == (1, 3)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(1, 4), st.sampled_from("abc"), st.sampled_from([None, "x", "y"]), st.sampled_from([None, 0.1, 0.2])), min_size=1, max_size=14))
def test_changes_like_brute_force(spark, drawn):
    data = [(*row, i) for i, row in enumerate(drawn)]
    assert rows(snapshot_changes(spark.createDataFrame(data, SNAP))) == brute(data)
