"""Queries over the operation log: replay, snapshots, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import access, replay
from ..sources import load, snapshot
from ..session import work_dir
from ..streaming import jobs
from .common import AS_OF, LIVE, META_DEFAULT, Catalogue, entries

C = Catalogue()
#: A time within the log, half way through its last day.
MIDWAY = AS_OF - 12 * 3_600_000


def _log_sql(keep: str = "true") -> str:
    return f"""d AS (SELECT DISTINCT ON (seq) * FROM ops WHERE {keep}),
  cleared AS (SELECT coalesce(max(seq), -1) AS s FROM d WHERE op = 'clear'),
  known AS (SELECT namespace, key, max(seq) FILTER (WHERE op = 'delete') AS s FROM d WHERE key IS NOT NULL AND op NOT IN ('clear', 'delete_prefix') GROUP BY ALL),
  prefixed AS (SELECT k.namespace, k.key, max(p.seq) AS s FROM known k JOIN d p ON p.op = 'delete_prefix' AND p.namespace = k.namespace AND starts_with(k.key, coalesce(p.key, '')) GROUP BY ALL),
  cut AS (SELECT k.namespace, k.key, greatest(coalesce(k.s, -1), coalesce(p.s, -1), (SELECT s FROM cleared)) AS s FROM known k LEFT JOIN prefixed p ON p.namespace = k.namespace AND p.key = k.key)"""


def _fold_sql(keep: str = "true") -> str:
    live = "(f.there AND (f.exp IS NULL OR r.ts_ms < f.exp))"
    age = "greatest(0.0, (r.ts_ms - f.created) / 3600000.0)"
    boosted = f"CASE WHEN f.pinned THEN 1.0 ELSE least(1.0, least(1.0, greatest(0.0, f.rel * exp(-(0.028881132523331052) * {age}))) + 0.15) END"
    counted = f"({live} AND r.op = 'read' AND r.ts_ms - f.last > 1000)"
    return f"""WITH RECURSIVE {_log_sql(keep)},
  r AS (SELECT d.namespace, d.key, d.seq, d.op, d.ts_ms, nullif(d.ttl_ms, 0) AS ttl, row_number() OVER (PARTITION BY d.namespace, d.key ORDER BY d.seq) AS i
    FROM d JOIN cut c ON c.namespace = d.namespace AND c.key = d.key WHERE d.seq > c.s AND d.op IN ('set', 'pin', 'unpin', 'read')),
  f AS (
    SELECT namespace, key, i, op = 'set' AS there, CASE WHEN op = 'set' THEN ts_ms + ttl END AS exp, CAST(1.0 AS DOUBLE) AS rel, ts_ms AS created, CAST(0 AS BIGINT) AS reads, false AS pinned, ts_ms AS last, CASE WHEN op = 'set' THEN seq END AS set_seq FROM r WHERE i = 1
    UNION ALL
    SELECT r.namespace, r.key, r.i, r.op = 'set' OR {live}, CASE WHEN r.op = 'set' THEN r.ts_ms + r.ttl ELSE f.exp END,
      CASE WHEN r.op = 'set' AND NOT {live} THEN 1.0 WHEN r.op = 'set' THEN {boosted} WHEN r.op = 'pin' AND {live} THEN 1.0 ELSE f.rel END,
      CASE WHEN r.op = 'set' AND NOT {live} THEN r.ts_ms ELSE f.created END,
      CASE WHEN r.op = 'set' AND NOT {live} THEN 0 WHEN r.op = 'set' OR {counted} THEN f.reads + 1 ELSE f.reads END,
      CASE WHEN r.op = 'set' AND NOT {live} THEN false WHEN r.op = 'pin' AND {live} THEN true WHEN r.op = 'unpin' AND {live} THEN false ELSE f.pinned END,
      CASE WHEN r.op = 'set' OR {counted} THEN r.ts_ms ELSE f.last END, CASE WHEN r.op = 'set' THEN r.seq ELSE f.set_seq END
    FROM f JOIN r ON r.namespace = f.namespace AND r.key = f.key AND r.i = f.i + 1),
  ended AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY namespace, key ORDER BY i DESC) = 1),
  state AS (SELECT e.namespace, e.key, d.value, d.memory_type, d.embedding, e.exp AS expires_at_ms, e.last AS last_accessed_ms, e.rel AS relevance, e.created AS created_at_ms, e.reads AS access_count, e.pinned
    FROM ended e JOIN d ON d.seq = e.set_seq WHERE e.there)"""


_STATE = "SELECT namespace, key, value, memory_type, embedding, expires_at_ms, last_accessed_ms, round(relevance, 6) AS relevance, created_at_ms, access_count, pinned FROM state"


def _plain(state: DataFrame) -> DataFrame:
    return state.withColumn("relevance", F.round("relevance", 6))


@C.add(_fold_sql() + _STATE)
def replay_state(spark: SparkSession, d: str) -> DataFrame:
    return _plain(replay.replay(load(spark, d, "ops")))


@C.add(_fold_sql(f"ts_ms <= {MIDWAY}") + _STATE + f" WHERE expires_at_ms IS NULL OR expires_at_ms > {MIDWAY}")
def replay_as_of(spark: SparkSession, d: str) -> DataFrame:
    return _plain(access.live(replay.replay(load(spark, d, "ops"), as_of_ms=MIDWAY), MIDWAY))


@C.add(f"WITH {_log_sql()}, sets AS (SELECT d.* FROM d JOIN cut c ON c.namespace = d.namespace AND c.key = d.key WHERE d.op = 'set' AND d.seq > c.s QUALIFY row_number() OVER (PARTITION BY d.namespace, d.key ORDER BY d.seq DESC) = 1) SELECT namespace, key, value, memory_type, ts_ms + nullif(ttl_ms, 0) AS expires_at_ms FROM sets WHERE coalesce(ts_ms + nullif(ttl_ms, 0) > {AS_OF}, true)")
def replay_last_writes(spark: SparkSession, d: str) -> DataFrame:
    return replay.last_writes(load(spark, d, "ops"), AS_OF)


@C.add(f"WITH {_log_sql()} SELECT namespace, key, s AS cut FROM cut WHERE s >= 0")
def replay_delete_prefix(spark: SparkSession, d: str) -> DataFrame:
    return replay.cutoffs(load(spark, d, "ops").dropDuplicates(["seq"])).where(F.col("cut") >= 0)


@C.add("SELECT DISTINCT seq, op, namespace, key, ts_ms FROM ops WHERE seq >= 1000")
def wal_tail(spark: SparkSession, d: str) -> DataFrame:
    return replay.wal_tail(load(spark, d, "ops"), 1000).select("seq", "op", "namespace", "key", "ts_ms")


@C.add("SELECT DISTINCT seq, op FROM ops WHERE seq >= (SELECT min(seq) FROM (SELECT DISTINCT seq FROM ops ORDER BY seq DESC LIMIT 500))")
def wal_retention(spark: SparkSession, d: str) -> DataFrame:
    return replay.retain_last(load(spark, d, "ops"), 500).select("seq", "op")


@C.add(_fold_sql() + _STATE)
def resync(spark: SparkSession, d: str) -> DataFrame:
    """State from a base that covers the first half of the log, and the rest of the log on top."""
    ops = load(spark, d, "ops")
    half = ops.agg((F.max("seq") / 2).cast("long")).first()[0]
    base = replay.replay(ops, up_to_seq=half)
    return _plain(replay.replay(ops.where(F.col("seq") > half), base=base))


@C.add("SELECT namespace, op, count(*) AS n, min(ts_ms) AS first_ts_ms, max(ts_ms) AS last_ts_ms FROM (SELECT DISTINCT seq, op, namespace, ts_ms FROM ops) GROUP BY ALL")
def op_metrics(spark: SparkSession, d: str) -> DataFrame:
    return replay.op_metrics(load(spark, d, "ops"))


def _scratch(spark: SparkSession, label: str) -> str:
    return f"{work_dir(spark)}/{label}-{uuid.uuid4().hex}"


@C.add(f"SELECT namespace, key, value, memory_type, expires_at_ms, embedding, last_accessed_ms, relevance, created_at_ms, access_count, pinned FROM entries WHERE {LIVE}")
def snapshot_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    root = _scratch(spark, "snapshots")
    snapshot.write_snapshot(entries(spark, d), root, AS_OF)
    return snapshot.restore(spark, root, AS_OF)


@C.add(f"WITH {META_DEFAULT} SELECT namespace, key, round(relevance, 6) AS relevance, pinned FROM meta")
def snapshot_scores(spark: SparkSession, d: str) -> DataFrame:
    root = _scratch(spark, "snapshots")
    snapshot.write_snapshot(entries(spark, d), root, AS_OF)
    rows = access.with_meta(snapshot.read_snapshot(spark, root), AS_OF)
    return rows.select("namespace", "key", F.round("relevance", 6).alias("relevance"), "pinned")


@C.add(f"SELECT namespace, count(*) AS entries, CAST(sum(CAST(concat('0x', substr(md5(concat_ws(chr(1), key, coalesce(value, chr(2)), memory_type)), 1, 8)) AS BIGINT)) AS BIGINT) AS digest FROM entries WHERE {LIVE} GROUP BY namespace")
def snapshot_manifest(spark: SparkSession, d: str) -> DataFrame:
    return snapshot.manifest(access.live(entries(spark, d), AS_OF)).drop("checksum")


# --- streams, each driven to its end over the same files


@C.add(_fold_sql() + _STATE)
def stream_replay(spark: SparkSession, d: str) -> DataFrame:
    work = _scratch(spark, "stream-replay")
    jobs.replay_stream(jobs.read_log(spark, f"{d}/ops.parquet", _scratch(spark, "stream-source")), work, f"{work}-checkpoint").awaitTermination()
    return _plain(jobs.read_state(spark, work))


@C.add("SELECT namespace, op, (ts_ms // 86400000) * 86400000 AS day_ms, count(*) AS n FROM (SELECT DISTINCT seq, namespace, op, ts_ms FROM ops WHERE namespace IS NOT NULL) GROUP BY ALL")
def stream_op_counts(spark: SparkSession, d: str) -> DataFrame:
    work = _scratch(spark, "stream-counts")
    jobs.count_stream(jobs.read_log(spark, f"{d}/ops.parquet", _scratch(spark, "stream-source")), work, f"{work}-checkpoint").awaitTermination()
    return spark.read.parquet(work)




@C.add("SELECT namespace, key, max(seq) AS seq, arg_max(op, seq) AS op FROM (SELECT DISTINCT seq, namespace, key, op FROM ops WHERE key IS NOT NULL AND namespace IS NOT NULL AND op <> 'delete_prefix') GROUP BY ALL")
def stream_last_op(spark: SparkSession, d: str) -> DataFrame:
    work = _scratch(spark, "stream-last")
    jobs.last_op_stream(jobs.read_log(spark, f"{d}/ops.parquet", _scratch(spark, "stream-source")), work, f"{work}-checkpoint").awaitTermination()
    # each batch adds the keys that changed in it; the newest row of a key holds
    return spark.read.parquet(work).groupBy("namespace", "key").agg(F.max("seq").alias("seq"), F.max_by("op", "seq").alias("op"))


QUERIES, ORACLE = C.queries, C.sql
