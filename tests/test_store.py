"""The store's semantics on small fixtures."""

import math

import pytest
from pyspark.sql import functions as F

from mnemoria.functions.keys import next_power_of_two, prefix_of_pattern
from mnemoria.operators import access, capacity, consolidate, mutate, reap, scan, sharing, triggers, vector_search
from mnemoria.operators.consolidate import Compress, Promote
from mnemoria.schema import ENTRIES
from mnemoria.sources import snapshot, tokens
from mnemoria.store import Store

H = 3_600_000
NOW = 1_000 * H


def entry(full, value="v", kind="semantic", exp=None, vec=None, used=0, rel=1.0, created=NOW, reads=0, pinned=False):
    ns, _, key = full.partition(":")
    return (ns, key, value, kind, exp, vec, used, rel, created, reads, pinned)


@pytest.fixture
def make(spark):
    return lambda *rows: spark.createDataFrame(list(rows), ENTRIES)


def keys(df):
    return sorted(f"{r['namespace']}:{r['key']}" for r in df.select("namespace", "key").collect())


def test_prefix_count_and_namespaces(make):
    e = make(entry("session:abc", "data1"), entry("session:def", "data2"), entry("cache:xyz"), entry("sessions:q"), entry("session:old", exp=NOW))
    assert keys(scan.prefix_scan(e, "session:", NOW)) == ["session:abc", "session:def"]
    assert scan.count_prefix(e, "cache:", NOW).first()["n"] == 1
    assert keys(scan.prefix_scan(e, "sess", NOW)) == ["session:abc", "session:def", "sessions:q"]
    assert sorted(r[0] for r in scan.active_namespaces(e, NOW).collect()) == ["cache", "session", "sessions"]
    assert [r[0] for r in scan.keys_matching(e, "cache:*", NOW).collect()] == ["cache:xyz"]
    for bad in ("a*b", "abc", "a?*"):
        with pytest.raises(ValueError):
            prefix_of_pattern(bad)
    assert [next_power_of_two(n) for n in (0, 1, 3, 64, 65)] == [1, 1, 4, 64, 128]


def test_expiry_boundary_and_ttl(make):
    e = make(entry("a:1", exp=NOW), entry("a:2", exp=NOW + 1), entry("a:3"))
    assert keys(access.live(e, NOW)) == ["a:2", "a:3"]
    assert {r["key"]: r["ttl_ms"] for r in access.with_meta(e, NOW).collect()} == {"2": 1, "3": None}
    assert keys(reap.expired(e, NOW)) == ["a:1"]


def test_decay_boost_and_pin(make):
    e = make(entry("d:day", created=NOW - 24 * H), entry("d:hour", created=NOW - H), entry("d:three", created=NOW - 72 * H), entry("d:pin", rel=0.2, created=NOW - 500 * H, pinned=True), entry("d:read", created=NOW - 24 * H, reads=3), entry("d:future", rel=0.4, created=NOW + H))
    got = {r["key"]: r["relevance"] for r in access.with_meta(e, NOW).collect()}
    assert got["day"] == pytest.approx(0.5) and got["hour"] > 0.95 and got["three"] < 0.15 and got["pin"] == 1.0 and got["read"] == pytest.approx(0.8) and got["future"] == pytest.approx(0.4)
    order = [r["key"] for r in scan.relevance_scan(e, "d:", NOW).collect()]
    assert order[0] == "pin" and order[-1] == "three"


def test_reap_uses_defaults_unless_asked(spark, make):
    e = make(entry("t:ancient", created=0, reads=50), entry("t:pinned", created=0, pinned=True), entry("o:safe"))
    slow = spark.createDataFrame([("t", 0.0, None, None, None)], "namespace string, rate double, read_boost double, write_boost double, floor double")
    assert keys(reap.low_relevance(e, NOW, slow)) == ["t:ancient"]
    assert keys(reap.low_relevance(e, NOW, slow, per_namespace=True)) == []


def test_multi_get_keeps_order_repeats_and_gaps(spark, make):
    s = Store.empty(spark)
    s = s._with(entries=make(entry("a:1", "x", "episodic", exp=NOW + 5), entry("a:b:c", "y")))
    got = s.mgett(["a:b:c", "a:2", "a:1", "a:1", "nocolon"], NOW).orderBy("pos").collect()
    assert [(r["value"], r["memory_type"], r["ttl_ms"]) for r in got] == [("y", "semantic", -1), (None, None, -1), ("x", "episodic", 5), ("x", "episodic", 5), (None, None, -1)]
    found, missing = s.batch_get(["a:1", "a:2"], NOW)
    assert found.count() == 1 and missing.first()["full_key"] == "a:2"
    assert [r[2] for r in s.mtype(["a:1", "z:z"], NOW).orderBy("pos").collect()] == ["episodic", "none"]
    with pytest.raises(ValueError):
        access.conditional(s.entries, s.entries, NOW, nx=True, xx=True)


def test_put_update_boost_nx_xx_and_erased_embedding(spark):
    s = Store.empty(spark)
    first = spark.createDataFrame([(0, "n", "k", "one", "episodic", 0, [1.0, 0.0])], "pos long, namespace string, key string, value string, memory_type string, ttl_ms long, embedding array<float>")
    s = s.put(first, NOW, 1)
    row = s.entries.first()
    assert row["relevance"] == 1.0 and row["access_count"] == 0 and row["expires_at_ms"] is None and row["embedding"] == [1.0, 0.0]
    again = spark.createDataFrame([(0, "n", "k", "two"), (1, "n", "new", "three")], "pos long, namespace string, key string, value string")
    later = s.put(again, NOW + 24 * H, 10)
    row = later.entries.where("key = 'k'").first()
    assert row["relevance"] == pytest.approx(0.65) and row["access_count"] == 1 and row["embedding"] is None and row["memory_type"] == "semantic" and row["created_at_ms"] == NOW
    assert s.put(again, NOW, 20, nx=True).entries.where("value = 'two'").count() == 0
    assert keys(s.put(again, NOW, 20, xx=True).entries) == ["n:k"]
    with pytest.raises(Exception, match="unknown memory type"):
        mutate.set_ops(first.withColumn("memory_type", F.lit("dream")), NOW).collect()


def test_deletions(spark, make):
    s = Store.empty(spark)._with(entries=make(entry("ns:a"), entry("ns:b"), entry("ns:bc"), entry("other:d")))
    assert keys(s.delete(["ns:a", "ns:zz"]).entries) == ["ns:b", "ns:bc", "other:d"]
    assert keys(s.delete_namespace("ns").entries) == ["other:d"]
    assert keys(s.delete_prefix("ns", "b").entries) == ["ns:a", "other:d"]
    assert s.clear().entries.count() == 0
    pinned = s.pin(["ns:a"], NOW)
    assert pinned.entries.where("pinned").count() == 1 and pinned.pin(["ns:a"], NOW, False).entries.where("pinned").count() == 0


def test_vector_search(spark, make):
    e = make(entry("v:cat", vec=[1.0, 0.0, 0.0]), entry("v:dog", vec=[0.0, 1.0, 0.0]), entry("v:car", vec=[0.0, 0.0, 1.0]), entry("v:none"), entry("mixed:a", vec=[1.0]), entry("mixed:b", vec=[1.0, 2.0]), entry("zero:z", vec=[0.0, 0.0]))
    got = vector_search.top_k(e, "v", [0.9, 0.1, 0.0], NOW, 3).collect()
    assert [r["key"] for r in got] == ["cat", "dog", "car"] and got[0]["distance"] == pytest.approx(1 - 0.9 / math.sqrt(0.82))
    assert vector_search.top_k(e, "v", [1.0, 0.0, 0.0], NOW, 1).count() == 1
    assert vector_search.top_k(e, "v", [1.0, 0.0], NOW).count() == 0
    assert vector_search.top_k(e, "mixed", [1.0], NOW).count() == 0
    assert vector_search.top_k(e, "missing", [1.0], NOW).count() == 0
    assert vector_search.top_k(e, "zero", [1.0, 0.0], NOW).first()["distance"] == 1.0
    opposite = vector_search.top_k(e.where("key = 'cat'"), "v", [-1.0, 0.0, 0.0], NOW).first()
    assert opposite["distance"] == pytest.approx(2.0)
    q = spark.createDataFrame([(1, "v", [1.0, 0.0, 0.0]), (2, "zero", [1.0, 1.0])], "query_id int, namespace string, embedding array<float>")
    assert [(r["query_id"], r["key"], r["rank"]) for r in vector_search.multi_top_k(e, q, NOW, 2).orderBy("query_id", "rank").collect()] == [(1, "cat", 1), (1, "car", 2), (2, "z", 1)]


def test_lsh_finds_the_nearest(make):
    rows = [entry(f"l:{i}", vec=[math.cos(i / 20), math.sin(i / 20), 0.1]) for i in range(60)]
    got = [r["key"] for r in vector_search.lsh_top_k(make(*rows), "l", [1.0, 0.0, 0.1], NOW, 3).orderBy("distance").collect()]
    assert got[0] == "0" and set(got) <= {"0", "1", "2", "3"}


def ping(n):
    return [entry(f"test:event:ping:{i}", f"val{i}", "episodic") for i in range(n)]


def state(df):
    return {f"{r['namespace']}:{r['key']}": r["value"] for r in df.collect()}


def test_promote_and_conflicts(make):
    rule = Promote(min_occurrences=3)
    after, report = consolidate.run_rules(make(*ping(3)), [rule], NOW)
    assert state(after) == {"test:fact:ping": "val2"} and report.first()["outcome"] == "promoted"
    assert len(state(consolidate.run_rules(make(*ping(2)), [rule], NOW)[0])) == 2
    there = [*ping(3), entry("test:fact:ping", "old")]
    after, report = consolidate.run_rules(make(*there), [rule], NOW)
    assert state(after)["test:fact:ping"] == "old" and len(state(after)) == 4 and report.first()["outcome"] == "skipped"
    after, _ = consolidate.run_rules(make(*there), [Promote(conflict_policy="overwrite")], NOW)
    assert state(after) == {"test:fact:ping": "val2"}
    after, _ = consolidate.run_rules(make(*there, entry("test:fact:ping_v2", "x"), entry("test:fact:ping_v4", "y")), [Promote(conflict_policy="version")], NOW)
    assert state(after)["test:fact:ping_v3"] == "val2" and state(after)["test:fact:ping"] == "old"
    after, _ = consolidate.run_rules(make(*ping(3), entry("test:fact:ping", "old", "procedural")), [rule], NOW)
    assert state(after) == {"test:fact:ping": "val2"}
    with pytest.raises(ValueError):
        Promote(conflict_policy="merge")


def test_compress_strategies_and_chain(make):
    logs = [entry(f"test:log:entry{i}", f"data{i % 3}", "episodic") for i in range(5)]
    after, report = consolidate.run_rules(make(*logs), [Compress(min_episodes=5)], NOW)
    assert state(after) == {"test:summary:log": "data0\ndata1\ndata2"} and report.first()["occurrences"] == 5
    assert len(state(consolidate.run_rules(make(*logs[:3]), [Compress(min_episodes=5)], NOW)[0])) == 3
    kept, _ = consolidate.run_rules(make(*logs), [Compress(min_episodes=5, summary_strategy="dedupe", delete_source=False, target_key="digest")], NOW)
    assert state(kept)["test:digest"] == "data0; data1; data2" and len(state(kept)) == 6
    told, _ = consolidate.run_rules(make(*logs), [Compress(summary_strategy="llm", summarise=lambda values: f"{len(values)} values")], NOW)
    assert state(told) == {"test:summary:log": "3 values"}
    chained, _ = consolidate.run_rules(make(*ping(3), *logs), [Promote(), Compress(group_by="all", target_key="all:{prefix}")], NOW)
    assert state(chained) == {"test:fact:ping": "val2", "test:all:__all__": "data0\ndata1\ndata2"}
    empty, report = consolidate.run_rules(make(*logs).limit(0), [Promote(), Compress()], NOW)
    assert empty.count() == 0 and report.count() == 0


def test_facade_consolidation_needs_rules(spark, make):
    s = Store.empty(spark)._with(entries=make(*ping(3)))
    with pytest.raises(ValueError):
        s.consolidate(NOW)
    s, _ = s._with(rules=[Promote(), Compress()]).consolidate(NOW, "promote")
    status = s.consolidation_status().first()
    assert (status["namespace"], status["last_run_ms"], status["total_promoted"]) == ("test", NOW, 1)


def test_capacity_policies(spark, make):
    e = make(entry("a:1", exp=NOW, used=5), entry("a:2", used=9), entry("a:3", used=1))
    w = spark.createDataFrame([(1, "a", "2"), (2, "a", "x"), (3, "a", "y"), (4, "a", "x")], "seq long, namespace string, key string")
    one = F.lit(0)
    took = lambda policy, n: [r["accepted"] for r in capacity.admit(e, w, n, one, NOW, capacity.Policy.parse(policy)).orderBy("seq").collect()]
    assert took("reject", 3) == [True, False, False, False]
    assert took("TTL-First", 3) == [True, True, False, True]
    assert took("lru", 1) == [True] * 4
    assert keys(capacity.evict_lru(e, 1, one)) == ["a:1", "a:3"]
    assert keys(capacity.evict_lru(e, 3, one)) == []
    batch = capacity.prefix_until_full(capacity.admit(e, w, 3, one, NOW))
    assert [r["seq"] for r in batch.collect()] == [1]


def test_triggers(spark, make):
    e = make(entry("n:event:1", created=NOW - 10), entry("n:event:2"), entry("n:log:1"), entry("m:1", created=NOW - 100))
    reg = triggers.Registry()
    reg.register("many", "min_entries", "n", threshold=3)
    reg.register("few", "min_entries", "n", threshold=4)
    reg.register("old", "max_age", "n", max_age_ms=9)
    reg.register("edge", "max_age", "n", max_age_ms=10)
    reg.register("match", "match_count", "n", threshold=2, key_prefix="event:")
    reg.register("off", "min_entries", "n", threshold=1, enabled=False)
    reg.register("none", "min_entries", "empty", threshold=0)
    with pytest.raises(ValueError):
        reg.register("many", "min_entries", "n", threshold=1)
    with pytest.raises(ValueError):
        reg.register("bad", "max_age", "n", threshold=1)
    ids = lambda df: sorted(r["id"] for r in df.select("id").distinct().collect())
    assert ids(triggers.fire(reg.table(spark), e, NOW)) == ["many", "match", "none", "old"]
    s = Store.empty(spark)._with(entries=e, registry=reg)
    rows = s.sweep_triggers(NOW)
    assert rows.where("id = 'old'").first()["key"] == "event:1" and rows.where("id = 'match'").count() == 2
    assert ids(triggers.fire(reg.table(spark), e, NOW + 59_999)) == ["edge"]  # the others cool down
    assert ids(triggers.fire(reg.table(spark), e, NOW + 59_999, force=True)) == ["edge", "many", "match", "none", "old"]
    assert ids(triggers.fire(reg.table(spark), e, NOW + 60_000)) == ["edge", "many", "match", "none", "old"]
    assert reg.set_enabled("off", True) and not reg.set_enabled("zz", True) and reg.unregister("off") and not reg.unregister("off")
    assert [r["id"] for r in reg.list()][0] == "edge" and reg.get("many")["last_fired_ms"] == NOW


def test_sharing_and_tokens(spark, make):
    s = Store.empty(spark)._with(entries=make(entry("a:fact:1"), entry("a:pref:1"), entry("b:x")))
    s = s.share("a", "b", "read", 1, "fact:").share("a", "c", "read", 1).share("a", "c", "read-write", 2)
    assert sorted((r[0], r[2]) for r in s.visible(NOW).collect()) == [("b", "fact:1"), ("c", "fact:1"), ("c", "pref:1")]
    with pytest.raises(ValueError):
        s.share("a", "a", "read", 1)
    asks = spark.createDataFrame([("b", "a", "fact:1", False), ("b", "a", "pref:1", False), ("b", "a", "fact:1", True), ("b", "a", "", False), ("c", "a", "pref:1", True), ("b", "b", "x", True), ("d", "a", None, False)], "caller string, namespace string, key string, is_write boolean")
    got = {(r["caller"], r["key"], r["is_write"]): r["allowed"] for r in sharing.check_access(asks, s.shares).collect()}
    assert got == {("b", "fact:1", False): True, ("b", "pref:1", False): False, ("b", "fact:1", True): False, ("b", "", False): True, ("c", "pref:1", True): True, ("b", "x", True): True, ("d", None, False): False}
    assert s.unshare("a").visible(NOW).count() == 0 and s.unshare("a", "b", "fact:").visible(NOW).count() == 2
    t = tokens.tokens(spark, arguments=["t1:a,b", "t2:*"])
    req = spark.createDataFrame([(1, "t1", "a", "k", True), (2, "t1", "z", "k", False), (3, "t2", "z", "k", True), (4, "t9", "a", "k", False)], "request_id int, token string, namespace string, key string, is_write boolean")
    allowed = lambda tok: [r["allowed"] for r in sharing.authorize(req, tok, s.shares).orderBy("request_id").collect()]
    assert allowed(t) == [True, False, True, False] and allowed(t.limit(0)) == [True] * 4
    assert tokens.parse_lines(["# note", "", "tok a b"]) == [("tok", ["a", "b"])]
    for bad in ("tok", ":a", "tok:"):
        with pytest.raises(ValueError):
            tokens.parse_argument(bad)


def test_snapshots(spark, make, tmp_path):
    root = f"file://{tmp_path}/snaps"
    s = Store.empty(spark)._with(entries=make(entry("a:1", "one", exp=NOW + 5, rel=0.5, created=7, reads=42, pinned=True, vec=[1.0]), entry("a:2", exp=NOW)))
    assert snapshot.latest_snapshot(spark, root) is None and snapshot.read_snapshot(spark, root).count() == 0
    for i in range(4):
        s.save(root, NOW - 3 + i, keep=3)
    assert snapshot.list_snapshots(spark, root) == [NOW - 2, NOW - 1, NOW]
    back = Store.empty(spark).restore(root, NOW).entries
    assert back.count() == 1 and back.first()["access_count"] == 42 and back.first()["pinned"]
    assert Store.empty(spark).restore(root, NOW + 5).entries.count() == 0
    (tmp_path / "snaps" / f"snapshot_ts={NOW + 1}").mkdir()  # not complete
    assert snapshot.latest_snapshot(spark, root) == NOW
    s.entries.select("namespace", "key", "value", "memory_type").write.parquet(f"{root}/snapshot_ts={NOW + 2}")
    old = snapshot.read_snapshot(spark, root).where("key = '1'").first()
    assert old["relevance"] == 1.0 and old["created_at_ms"] == 0 and old["pinned"] is False
    over = Store.empty(spark)._with(entries=make(entry("a:1", "newer"), entry("b:1"))).restore(root, NOW)
    assert state(over.entries)["a:1"] == "one" and "b:1" in state(over.entries)


def test_decay_settings_are_merged(spark):
    columns = "namespace string, rate double, read_boost double, write_boost double, floor double"
    s = Store.empty(spark).with_decay(spark.createDataFrame([("a", 0.5, None, None, None)], columns)).with_decay(spark.createDataFrame([("a", None, 0.3, None, None)], columns))
    row = s.overrides.first()
    assert row["rate"] == 0.5 and row["read_boost"] == 0.3 and row["floor"] == 0.01
    assert s.without_decay("a").overrides.count() == 0
