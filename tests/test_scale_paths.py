"""Prefixes, triggers, hot keys, limits, guards and loops against plain computations."""

import json
import random
import zlib

import pytest
from pyspark.sql import functions as F

from mnemoria.operators import consolidate, mutate, replay, triggers
from mnemoria.operators.capacity import Policy
from mnemoria.operators.classify import classify_relevance
from mnemoria.operators.prefixes import prefix_pairs
from mnemoria.schema import ENTRIES, LOG, TRIGGERS
from mnemoria.sources import snapshot
from mnemoria.store import Store
from mnemoria.streaming import jobs
from tests.test_replay import folded, op_rows, simulate


def entry(ns, key, value="v", kind="episodic", created=0, expires=None):
    return (ns, key, value, kind, expires, None, created, 1.0, created, 0, False)


def test_prefixes_of_a_hot_namespace_like_brute_force(spark):
    r = random.Random(1)
    keys = [("hot" if i % 2 else f"n{i % 50}", None if i % 97 == 0 else "".join(r.choice("ab:") for _ in range(r.randint(0, 7)))) for i in range(1200)]
    prefixes = sorted({("hot" if r.random() < 0.9 else "n3", "".join(r.choice("ab:") for _ in range(r.randint(0, 8)))) for _ in range(1000)}, key=repr)
    rows = spark.createDataFrame([(*k, i) for i, k in enumerate(keys)], "namespace string, key string, i int")
    p = spark.createDataFrame([(*x, j) for j, x in enumerate(prefixes)], "namespace string, prefix string, j int")
    want = sorted((i, j) for i, (ns, k) in enumerate(keys) for j, (pn, pp) in enumerate(prefixes) if k is not None and ns == pn and k.startswith(pp))
    assert sorted((x["i"], x["j"]) for x in prefix_pairs(rows, p).collect()) == want
    assert prefix_pairs(rows, p.limit(0)).count() == prefix_pairs(rows.limit(0), p).count() == 0
    gone = {(ns, k) for ns, k in keys for pn, pp in prefixes if k is not None and ns == pn and k.startswith(pp)}
    left = mutate.delete_prefixes(rows, p.select("namespace", F.col("prefix").alias("key_prefix")))
    assert sorted(x["i"] for x in left.collect()) == [i for i, k in enumerate(keys) if k not in gone]


def test_trigger_counts_like_brute_force(spark):
    r = random.Random(2)
    rows = [entry(r.choice(["a", "a", "b"]), f"{r.choice(['x:', 'xy:', 'z'])}{i}", created=r.choice([None, 0, 5, 400, 950, 1000, 2000]), expires=r.choice([None, None, 900, 5000])) for i in range(400)]
    table = [(f"t{i}", kind, r.choice(["a", "b", "c"]), r.randint(1, 300) if kind != "max_age" else None, r.choice([0, 50, 600, 995, 5000]) if kind == "max_age" else None, r.choice([None, "", "x", "xy:", "q"]) if kind == "match_count" else None, True, 0, None, '{"type":"log"}') for i, kind in enumerate(triggers.KINDS * 20)]
    now = 1000
    alive = [e for e in rows if e[4] is None or e[4] > now]
    want = {}
    for t in table:
        mine = [e for e in alive if e[0] == t[2]]
        hit = mine if t[1] == "min_entries" else [e for e in mine if e[8] is not None and e[8] < max(now - t[4], 0)] if t[1] == "max_age" else [e for e in mine if e[1].startswith(t[5] or "")]
        want[t[0]] = (len(hit), len(hit) >= (1 if t[1] == "max_age" else t[3]))
    t, e = spark.createDataFrame(table, TRIGGERS), spark.createDataFrame(rows, ENTRIES)
    assert {x["id"]: (x["matched"], x["holds"]) for x in triggers.counts(t, e, now).collect()} == want
    listed = {x["id"]: x["count"] for x in triggers.matching_entries(t, e, now).groupBy("id").count().collect()}
    assert listed == {i: n for i, (n, holds) in want.items() if holds and n}


def test_payloads_list_entries_in_parts(spark):
    e = spark.createDataFrame([entry("a", f"k{i}") for i in range(25)] + [entry("b", "k", expires=1)], ENTRIES)
    t = spark.createDataFrame([("w", "min_entries", "a", 1, None, None, True, 0, None, '{"type":"webhook","url":"https://x.example","headers":{"Authorization":"Bearer t"}}'), ("none", "min_entries", "b", 0, None, None, True, 0, None, '{"type":"log"}')], TRIGGERS)
    rows = triggers.payloads(t, triggers.fire(t, e, 100), 100, triggers.matching_entries(t, e, 100), part_entries=10).collect()
    mine = [r for r in rows if r["id"] == "w"]
    assert [r["headers"] for r in mine] == [{"Authorization": "Bearer t"}] * 3 and sorted(r["part"] for r in mine) == [0, 1, 2]
    assert sorted(x["key"] for r in mine for x in json.loads(r["payload"])["entries"]) == sorted(f"k{i}" for i in range(25))
    assert [json.loads(r["payload"])["entries"] for r in rows if r["id"] == "none"] == [[]]
    assert triggers.contexts(t, e, 100).where("trigger_id = 'w' AND fired_at_ms = 100").count() == 25


def test_a_key_that_is_only_read(spark):
    r = random.Random(3)
    ops, ts = [(1, "set", "n", "hot", "v1", "semantic", 10**9, None, 1000)], 1000
    for seq in range(2, 6000):
        ts += r.choice([0, 300, 700, 1100, 5000, -2500])
        ops.append((seq, r.choice(["read"] * 30 + ["pin", "unpin"]), "n", "hot", None, None, None, None, ts))
    df = spark.createDataFrame(ops, LOG)
    want = simulate(ops)
    assert folded(replay.replay(df, part_width=256)) == want == folded(replay.replay(df, hot_share=1.1))
    base = replay.replay(df.where("seq < 50"))
    assert folded(replay.replay(df.where("seq >= 50"), base=base, part_width=256)) == want


def test_reads_of_a_run_come_down_to_few_numbers():
    from mnemoria.operators.hotfold import _count_reads, _Reads

    r = random.Random(4)
    for _ in range(200):
        times, ts = [], 0
        for _ in range(r.randint(0, 60)):
            ts += r.choice([0, 200, 999, 1000, 1001, 3000, -1500, -4000])
            times.append(ts)
        bound = r.randint(-3000, 6000)
        run = _Reads(bound, 1000)
        for t in times:
            run.add(t)
        for last in {bound, bound - 1, bound - 2500, -9999}:
            n, end = 0, last
            for t in times:
                if t - end > 1000:
                    n, end = n + 1, t
            assert _count_reads(run.done(), last, 1000) == (n, end)
    run = _Reads(0, 1000)
    for t in range(0, 10_000_000, 700):
        run.add(t)
    assert len(run.done()) <= 3


def test_a_write_leaves_other_rows_alone(spark):
    base = spark.createDataFrame([entry("n", f"k{i}") for i in range(50)], ENTRIES)
    ops = spark.createDataFrame(op_rows([("set", "n", "k3", None, 5), ("read", "n", "k4", None, 5000), ("delete", "n", "k5", None, 1)]), LOG)
    changed, rest = replay.replay_parts(ops, base=base)
    assert {x["key"] for x in changed.collect()} == {"k3", "k4"} and rest.count() == 47
    store = Store.empty(spark)
    for i in range(10):
        store = store.apply(spark.createDataFrame([(i, "set", "n", f"k{i % 7}", f"v{i}", "semantic", None, None, i)], LOG))
    assert {(x["key"], x["value"]) for x in store.entries.collect()} == {(f"k{i % 7}", f"v{i}") for i in range(3, 10)} and store.depth == 2


def test_consolidation_that_finds_no_room_fails(spark):
    rows = [entry("n", f"{g}:{i}", f"v{i}") for g in "abc" for i in range(5)] + [entry("n", "summary:c", kind="semantic")]
    e = spark.createDataFrame(rows, ENTRIES)
    rule = consolidate.Compress(min_episodes=5)
    state, report = consolidate.run_rules(e, [rule], 100, capacity=17, shard=F.lit(0))
    outcome = {x["source"]: x["outcome"] for x in report.collect()}
    assert sorted(outcome.values()) == ["compressed", "compressed", "failed"] and outcome["c"] == "compressed"
    lost = next(g for g, o in outcome.items() if o == "failed")
    kept = {x["key"] for x in state.collect()}
    assert {f"{lost}:{i}" for i in range(5)} <= kept and f"summary:{lost}" not in kept and len(kept) == 7
    assert consolidate.report_totals(report).first()["failed"] == 1
    free, _ = consolidate.run_rules(e, [rule], 100, capacity=17, shard=F.lit(0), policy=Policy.LRU)
    assert free.count() == 3
    store = Store.empty(spark)._with(entries=e).with_rules([rule], enabled=False)
    with pytest.raises(ValueError):
        store.consolidate(100)
    after, _ = store.with_rules([rule], enabled=True).consolidate(100)
    assert after.consolidation_status().first()["total_failed"] == 0


def test_commands_behind_a_token(spark):
    e = spark.createDataFrame([entry("mine", "k"), entry("other", "pub:k"), entry("other", "k")], ENTRIES)
    store = Store.empty(spark)._with(entries=e).share("other", "mine", "read", 1, "pub:")
    tokens = spark.createDataFrame([("t", ["mine"]), ("root", ["*"])], "token string, namespaces array<string>")
    me = store.as_caller("t", tokens)
    assert me.get("mine", "k", 10).count() == me.get("other", "pub:k", 10).count() == 1
    assert me.mget(["mine:k", "other:pub:k"], 10).count() == 2
    for denied in (lambda: me.get("other", "k", 10), lambda: me.delete(["other:pub:k"]), lambda: me.clear(), lambda: me.delete_namespace("other"), lambda: me.namespaces(10), lambda: store.as_caller("nobody", tokens).get("mine", "k", 10)):
        with pytest.raises(PermissionError):
            denied()
    after = me.delete(["mine:k"])
    assert after.get("mine", "k", 10).count() == 0
    assert store.as_caller("root", tokens).namespaces(10).count() == 2
    writes = spark.createDataFrame([(0, "other", "pub:z", "v")], "pos long, namespace string, key string, value string")
    with pytest.raises(PermissionError):
        me.put(writes, 10, 1)
    assert store.as_caller("root", tokens).put(writes, 10, 1).get("other", "pub:z", 10).count() == 1


def test_loops_over_the_streamed_state(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    ops = op_rows([("set", "n", f"a:{i}", None, 10) for i in range(5)] + [("set", "m", "k", None, 1)])
    ops = [(*o[:5], "episodic", *o[6:]) for o in ops]
    for i, part in enumerate((ops[:3], ops[3:], ops[1:4])):  # in order, in order, once more
        spark.createDataFrame(part, LOG).coalesce(1).write.parquet(f"{tmp_path}/in/{i}.parquet")
    source = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    jobs.replay_stream(source, root, f"{tmp_path}/ck").awaitTermination()
    assert folded(jobs.read_state(spark, root)) == simulate(ops)
    seen = []
    jobs.run_every(spark, "1 minute", lambda n: seen.append(jobs.consolidation_sweep(spark, root, [consolidate.Compress(min_episodes=5)], 1000).count()), f"{tmp_path}/ticks", once=True).awaitTermination()
    assert seen[:1] == [1] and {x["key"] for x in jobs.read_state(spark, root).collect()} == {"summary:a", "k"}
    jobs.snapshot_sweep(spark, root, f"{tmp_path}/snaps", 1000)
    assert snapshot.read_snapshot(spark, f"{tmp_path}/snaps").count() == 2


def test_scores_by_a_model(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("c", 4), ("d", 5), (None, 6)], "value string, i int")

    def model(text):
        return {"a": 0.25, "b": 7, "c": float("nan")}[text]

    assert {x["i"]: x["relevance"] for x in classify_relevance(rows, model).collect()} == {1: 0.25, 2: 0.25, 3: 1.0, 4: 0.5, 5: 0.5, 6: 0.5}


def test_checksums_and_old_snapshots(spark, tmp_path):
    e = spark.createDataFrame([entry("n", "k", "v"), entry("n", "l", None)], ENTRIES)
    row = snapshot.manifest(e).first()
    texts = ["k\x01v\x01episodic", "l\x01\x02\x01episodic"]
    assert row["checksum"] == sum(zlib.crc32(t.encode()) for t in texts) and row["entries"] == 2
    columns = ["namespace", "key", "value", "memory_type", "expires_at_ms"]
    later = [["embedding"], ["last_accessed_ms", "relevance"], ["created_at_ms", "access_count"], ["pinned"]]
    for version in range(5):  # each version had some columns more than the one before
        have = columns + [c for group in later[:version] for c in group]
        e.select(*have).write.parquet(f"{tmp_path}/v{version}/snapshot_ts=5")
        got = snapshot.read_snapshot(spark, f"{tmp_path}/v{version}").where("key = 'k'").first()
        want = e.where("key = 'k'").first().asDict()
        assert got.asDict() == {c: want[c] if c in have else snapshot.DEFAULTS.get(c) for c in ENTRIES.names}
