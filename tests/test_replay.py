"""The fold of the log against a plain simulator, in batch and as a stream."""

import math

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from mnemoria.operators import replay
from mnemoria.schema import LOG
from mnemoria.streaming import jobs

RATE = math.log(2) / 24


def simulate(ops):
    """One operation after another over the whole store."""
    store = {}
    for seq, op, ns, key, value, kind, ttl, vec, ts in sorted({o[0]: o for o in ops}.values(), key=lambda o: o[0]):
        if op == "clear":
            store = {}
        elif op == "delete_prefix":
            store = {k: s for k, s in store.items() if not (k[0] == ns and k[1].startswith(key or ""))}
        elif op == "delete":
            store.pop((ns, key), None)
        else:
            s = store.get((ns, key))
            if s and s["exp"] is not None and ts >= s["exp"]:
                s = None
                store.pop((ns, key))
            exp = ts + ttl if ttl else None
            if op == "set" and s is None:
                store[ns, key] = dict(value=value, kind=kind, exp=exp, vec=vec, last=ts, rel=1.0, created=ts, reads=0, pin=False)
            elif op == "set":
                age = max(0.0, (ts - s["created"]) / 3.6e6)
                rel = 1.0 if s["pin"] else min(1.0, s["rel"] * math.exp(-RATE * age) + 0.15)
                s.update(value=value, kind=kind, exp=exp, vec=vec, last=ts, rel=rel, reads=s["reads"] + 1)
            elif s and op == "pin":
                s.update(pin=True, rel=1.0)
            elif s and op == "unpin":
                s.update(pin=False)
            elif s and op == "read" and ts - s["last"] > 1000:
                s.update(reads=s["reads"] + 1, last=ts)
    return {k: (s["value"], s["kind"], s["exp"], s["last"], round(s["rel"], 9), s["created"], s["reads"], s["pin"]) for k, s in store.items()}


def folded(df):
    return {(r["namespace"], r["key"]): (r["value"], r["memory_type"], r["expires_at_ms"], r["last_accessed_ms"], round(r["relevance"], 9), r["created_at_ms"], r["access_count"], r["pinned"]) for r in df.collect()}


def op_rows(drawn):
    out, ts = [], 0
    for seq, (op, ns, key, ttl, step) in enumerate(drawn, 1):
        ts += step
        whole = op in ("set", "delete", "read", "pin", "unpin")
        out.append((seq, op, None if op == "clear" else ns, key if whole else key[:1] if op == "delete_prefix" else None, f"v{seq}" if op == "set" else None, "semantic" if op == "set" else None, ttl if op == "set" else None, None, ts))
    return out


OPS = st.lists(
    st.tuples(st.sampled_from(["set"] * 6 + ["read", "read", "pin", "unpin", "delete", "delete_prefix", "clear"]), st.sampled_from(["n", "m"]), st.sampled_from(["a", "ab", "b"]), st.sampled_from([None, 0, 5_000, 80_000_000]), st.sampled_from([-500, 0, 400, 3_000, 40_000_000])),
    max_size=25,
)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(OPS)
def test_fold_like_simulator(spark, drawn):
    ops = op_rows(drawn)
    df = spark.createDataFrame(ops[::-1] + ops[:3], LOG)  # out of order, some twice
    assert folded(replay.replay(df)) == simulate(ops)
    # every key folded in parts of three operations
    assert folded(replay.replay(df, hot_share=0.0, part_width=3)) == simulate(ops)
    half = len(ops) // 2
    base = replay.replay(df, up_to_seq=half)
    assert folded(replay.replay(df.where(f"seq > {half}"), base=base)) == simulate(ops)
    assert folded(replay.replay(df.where(f"seq > {half}"), base=base, hot_share=0.0, part_width=4)) == simulate(ops)


def test_a_hot_key_among_others(spark):
    drawn = [(["set", "set", "read", "pin", "unpin", "read"][i * 7 % 6], "n", "hot", [None, 90_000_000, 5_000_000][i % 3], 1_500_000 + i % 900) for i in range(400)] + [("set", "m", f"k{i}", 0, 5) for i in range(60)]
    ops = op_rows(drawn)
    assert folded(replay.replay(spark.createDataFrame(ops, LOG), part_width=16)) == simulate(ops)


def test_last_writes_tail_and_retention(spark):
    ops = op_rows([("set", "n", "a", 0, 1), ("set", "n", "a", 5_000, 1), ("set", "m", "b", None, 1), ("delete", "m", "b", None, 1), ("set", "n", "ab", None, 1)])
    df = spark.createDataFrame(ops + ops, LOG)
    assert {(r["key"], r["value"], r["expires_at_ms"]) for r in replay.last_writes(df).collect()} == {("a", "v2", 5_002), ("ab", "v5", None)}
    assert {r["key"] for r in replay.last_writes(df, 10_000).collect()} == {"ab"}
    assert sorted(r["seq"] for r in replay.retain_last(df, 2).collect()) == [4, 5]
    assert replay.retain_last(df, 99).count() == 5 and replay.retain_last(df.limit(0), 2).count() == 0
    assert replay.wal_tail(df, 4).count() == 2
    assert folded(replay.replay(df.limit(0))) == {}


def test_stream_equals_batch_and_fires_triggers(spark, tmp_path):
    from mnemoria.operators.triggers import Registry

    ops = op_rows([("set", "n", "a", 0, 1), ("set", "m", "b", 0, 5), ("read", "n", "a", None, 5_000), ("clear", "n", "", None, 1), ("set", "n", "ab", 900, 50), ("set", "n", "a", 0, 50), ("delete_prefix", "n", "b", None, 1), ("pin", "n", "a", None, 9)])
    for i, part in enumerate((ops[:3] + ops[5:6], ops[3:5] + ops[:1], ops[6:])):  # late, repeated
        spark.createDataFrame(part, LOG).coalesce(1).write.parquet(f"{tmp_path}/in/{i}.parquet")
    source = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    root = f"file://{tmp_path}/store"
    jobs.replay_stream(source, root, f"{tmp_path}/ck").awaitTermination()
    assert folded(jobs.read_state(spark, root)) == simulate(ops)
    registry, seen = Registry(), []
    registry.register("t", "min_entries", "n", threshold=1)
    jobs.trigger_stream(source, root, f"{tmp_path}/ck2", registry, lambda rows, now: seen.append(rows.count()), lambda rows: 5_100).awaitTermination()
    assert seen == [2]
    assert jobs.expiry_sweep(spark, root, 10_000) == 1 and jobs.read_state(spark, root).count() == 1


def test_stream_counts_a_log_of_many_months(spark, tmp_path):
    day = 86_400_000
    rows = [(i, "set", f"n{i % 3}", f"k{i}", "v", "semantic", None, None, 1_700_000_000_000 + i * day) for i in range(200)]
    spark.createDataFrame(rows + rows[:20], LOG).write.parquet(f"{tmp_path}/ops")
    jobs.count_stream(jobs.read_log(spark, f"{tmp_path}/ops", f"{tmp_path}/staged", files_per_batch=1), f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert len(got) == 200 and all(r["n"] == 1 for r in got)
