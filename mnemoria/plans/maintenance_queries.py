"""Queries for consolidation, capacity, triggers and sharing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import capacity, consolidate, mutate, sharing, triggers
from ..operators.consolidate import Compress, Promote
from ..sources import load
from ..streaming.metrics import rate_windows
from .common import AS_OF, LIVE, LIVE_ENTRIES, Catalogue, decayed_sql, entries

C = Catalogue()

# --- consolidation


def _episodes_as_events(spark: SparkSession, d: str) -> DataFrame:
    """The entries plus, for each chat, a fact of the same name in every third session, so that promotions meet conflicts."""
    rows = entries(spark, d)
    groups = rows.where((F.col("memory_type") == "episodic") & F.col("key").startswith("event:")).select("namespace", F.split_part("key", F.lit(":"), F.lit(2)).alias("g")).distinct()
    facts = groups.where(F.col("g").isin("ping", "sync")).select("namespace", F.concat(F.lit("fact:"), F.col("g")).alias("key"), F.lit("known").alias("value"), F.when(F.col("g") == "ping", "semantic").otherwise("procedural").alias("memory_type"))
    second = facts.where(F.col("key") == "fact:ping").withColumn("key", F.lit("fact:ping_v2"))
    return rows.unionByName(facts.unionByName(second), allowMissingColumns=True)


_EPISODES = f"""seeded AS (
  SELECT namespace, key, value, memory_type, expires_at_ms FROM entries
  UNION ALL SELECT namespace, 'fact:' || g, 'known', CASE g WHEN 'ping' THEN 'semantic' ELSE 'procedural' END, NULL FROM groups WHERE g IN ('ping', 'sync')
  UNION ALL SELECT namespace, 'fact:ping_v2', 'known', 'semantic', NULL FROM groups WHERE g = 'ping')"""
_GROUPS = "groups AS (SELECT DISTINCT namespace, split_part(key, ':', 2) AS g FROM entries WHERE memory_type = 'episodic' AND key LIKE 'event:%')"
_PROMOTED = f"""promoted AS (SELECT namespace, split_part(substr(key, 7), ':', 1) AS grp, count(*) AS occurrences, arg_max_null(value, key) AS value
  FROM seeded WHERE {LIVE} AND memory_type = 'episodic' AND key LIKE 'event:%' GROUP BY ALL HAVING count(*) >= 2),
met AS (SELECT p.*, 'fact:' || grp AS target, EXISTS (SELECT 1 FROM seeded s WHERE s.namespace = p.namespace AND s.key = 'fact:' || p.grp AND s.memory_type = 'semantic' AND {LIVE}) AS conflict FROM promoted p)"""
_WITH = f"WITH {_GROUPS}, {_EPISODES}, {_PROMOTED} "


def _rule(policy: str) -> Promote:
    return Promote(min_occurrences=2, key_prefix="event:", conflict_policy=policy)


@C.add(_WITH + "SELECT namespace, grp, occurrences, value FROM promoted")
def promote_basic(spark: SparkSession, d: str) -> DataFrame:
    return consolidate.promote_groups(_episodes_as_events(spark, d), _rule("skip"), AS_OF)


@C.add(_WITH + "SELECT namespace, grp, occurrences, value, target, CASE WHEN conflict THEN 'skipped' ELSE 'promoted' END AS outcome FROM met")
def promote_skip(spark: SparkSession, d: str) -> DataFrame:
    return consolidate.promote(_episodes_as_events(spark, d), _rule("skip"), AS_OF)


@C.add(_WITH + "SELECT namespace, grp, occurrences, value, target, 'promoted' AS outcome FROM met")
def promote_overwrite(spark: SparkSession, d: str) -> DataFrame:
    return consolidate.promote(_episodes_as_events(spark, d), _rule("overwrite"), AS_OF)


@C.add(
    _WITH
    + """SELECT namespace, grp, occurrences, value, CASE WHEN conflict THEN target || '_v' || (SELECT min(n) FROM range(2, 100) t(n)
    WHERE NOT EXISTS (SELECT 1 FROM seeded s WHERE s.namespace = met.namespace AND s.key = met.target || '_v' || n)) ELSE target END AS target, 'promoted' AS outcome FROM met"""
)
def promote_version(spark: SparkSession, d: str) -> DataFrame:
    return consolidate.promote(_episodes_as_events(spark, d), _rule("version"), AS_OF)


@C.add(_WITH + "SELECT namespace, count(*) FILTER (WHERE NOT conflict) AS promoted, CAST(0 AS BIGINT) AS compressed, count(*) FILTER (WHERE conflict) AS skipped, CAST(0 AS BIGINT) AS failed FROM met GROUP BY namespace")
def promote_report(spark: SparkSession, d: str) -> DataFrame:
    return consolidate.report_totals(consolidate.report(consolidate.promote(_episodes_as_events(spark, d), _rule("skip"), AS_OF), "promote"))


@C.add(_WITH + "SELECT namespace, key FROM seeded s WHERE memory_type = 'episodic' AND key LIKE 'event:%' AND " + LIVE + " AND EXISTS (SELECT 1 FROM met m WHERE m.namespace = s.namespace AND m.grp = split_part(substr(s.key, 7), ':', 1) AND NOT conflict)")
def promote_deletes(spark: SparkSession, d: str) -> DataFrame:
    rows = _episodes_as_events(spark, d)
    return consolidate.promote_sources(rows, _rule("skip"), consolidate.promote(rows, _rule("skip"), AS_OF), AS_OF)


def _compress_sql(group: str, join: str, least: int, order: str) -> str:
    return f"""WITH rows AS (SELECT namespace, key, value, {group} AS grp FROM entries WHERE {LIVE} AND memory_type = 'episodic'),
  sizes AS (SELECT namespace, grp, count(*) AS occurrences FROM rows GROUP BY ALL HAVING count(*) >= {least}),
  vals AS (SELECT namespace, grp, value, min(key) AS first_key FROM rows WHERE value IS NOT NULL GROUP BY ALL)
  SELECT namespace, grp, occurrences, coalesce((SELECT string_agg(value, {join} ORDER BY {order}) FROM vals v WHERE v.namespace = s.namespace AND v.grp = s.grp), '') AS value FROM sizes s"""


_SEGMENT = "split_part(key, ':', 1)"


@C.add(_compress_sql(_SEGMENT, r"E'\n'", 3, "first_key"))
def compress_concat(spark: SparkSession, d: str) -> DataFrame:
    return consolidate.compress_groups(entries(spark, d), Compress(min_episodes=3), AS_OF)


@C.add(_compress_sql(_SEGMENT, "'; '", 3, "value"))
def compress_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return consolidate.compress_groups(entries(spark, d), Compress(min_episodes=3, summary_strategy="dedupe"), AS_OF)


@C.add(_compress_sql("'__all__'", r"E'\n'", 4, "first_key"))
def compress_namespace(spark: SparkSession, d: str) -> DataFrame:
    return consolidate.compress_groups(entries(spark, d), Compress(min_episodes=4, group_by="all"), AS_OF)


@C.add(_compress_sql(_SEGMENT, r"E'\n'", 3, "first_key"))
def compress_llm_fallback(spark: SparkSession, d: str) -> DataFrame:
    def unreachable(values: list[str]) -> str:
        raise ConnectionError("no model here")

    return consolidate.compress_groups(entries(spark, d), Compress(min_episodes=3, summary_strategy="llm", summarise=unreachable), AS_OF)


@C.add(
    f"""SELECT namespace, 'compress' AS action, {_SEGMENT} AS source, 'summary:' || {_SEGMENT} AS target, count(*) AS occurrences, 'compressed' AS outcome
  FROM entries WHERE {LIVE} AND memory_type = 'episodic' GROUP BY ALL HAVING count(*) >= 3"""
)
def compress_report(spark: SparkSession, d: str) -> DataFrame:
    return consolidate.report(consolidate.compress(entries(spark, d), Compress(min_episodes=3), AS_OF), "compress")


@C.add(
    f"""WITH totals AS (SELECT namespace, least(count(*), 1) AS n FROM entries WHERE {LIVE} AND memory_type = 'episodic' GROUP BY namespace, {_SEGMENT} HAVING count(*) >= 3)
  SELECT namespace, CAST({AS_OF + 300000} AS BIGINT) AS last_run_ms, CAST(0 AS BIGINT) AS total_promoted, CAST(2 * sum(n) AS BIGINT) AS total_compressed, CAST(0 AS BIGINT) AS total_skipped, CAST(0 AS BIGINT) AS total_failed FROM totals GROUP BY namespace"""
)
def consolidation_meta(spark: SparkSession, d: str) -> DataFrame:
    totals = consolidate.report_totals(consolidate.report(consolidate.compress(entries(spark, d), Compress(min_episodes=3), AS_OF), "compress"))
    runs = [totals.withColumn("run_ms", F.lit(AS_OF + i * 300_000).cast("long")) for i in range(2)]
    return consolidate.accumulate_meta(runs[0].unionByName(runs[1]))


@C.add(
    f"""WITH rows AS (SELECT namespace, key, value, memory_type, {_SEGMENT} AS grp, {LIVE} AND memory_type = 'episodic' AS episode FROM entries),
  sizes AS (SELECT namespace, grp, count(*) AS n FROM rows WHERE episode GROUP BY ALL HAVING count(*) >= 3),
  gone AS (SELECT r.namespace, r.key FROM rows r JOIN sizes s USING (namespace, grp) WHERE episode)
  SELECT namespace, key, memory_type FROM rows r WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.namespace = r.namespace AND g.key = r.key) AND NOT EXISTS (SELECT 1 FROM sizes s WHERE s.namespace = r.namespace AND 'digest:' || s.grp = r.key)
  UNION ALL SELECT namespace, 'digest:' || grp, 'semantic' FROM sizes"""
)
def consolidated_state(spark: SparkSession, d: str) -> DataFrame:
    rules = [Compress(min_episodes=3, target_key="digest:{prefix}"), Promote(min_occurrences=3, key_prefix="event:")]
    return consolidate.run_rules(entries(spark, d), rules, AS_OF)[0].select("namespace", "key", "memory_type")


# --- deletions


@C.add("SELECT namespace, key FROM entries e WHERE NOT EXISTS (SELECT 1 FROM ops o WHERE o.op = 'delete' AND o.namespace = e.namespace AND o.key = e.key)")
def delete_keys(spark: SparkSession, d: str) -> DataFrame:
    return mutate.delete_keys(entries(spark, d), load(spark, d, "ops").where(F.col("op") == "delete")).select("namespace", "key")


@C.add(f"SELECT count(*) AS n FROM entries e WHERE {LIVE} AND EXISTS (SELECT 1 FROM ops o WHERE o.op = 'delete' AND o.namespace = e.namespace AND o.key = e.key)")
def delete_count(spark: SparkSession, d: str) -> DataFrame:
    return mutate.deleted_count(entries(spark, d), load(spark, d, "ops").where(F.col("op") == "delete"), AS_OF)


@C.add("SELECT namespace, count(*) AS n FROM entries WHERE namespace <> 'hub-main' GROUP BY namespace")
def delete_namespace(spark: SparkSession, d: str) -> DataFrame:
    return mutate.delete_namespace(entries(spark, d), "hub-main").groupBy("namespace").agg(F.count(F.lit(1)).alias("n"))


@C.add("SELECT namespace, key FROM entries e WHERE NOT EXISTS (SELECT 1 FROM ops o WHERE o.op = 'delete_prefix' AND o.namespace = e.namespace AND starts_with(e.key, coalesce(o.key, '')))")
def delete_prefix(spark: SparkSession, d: str) -> DataFrame:
    prefixes = load(spark, d, "ops").where(F.col("op") == "delete_prefix").select("namespace", F.col("key").alias("key_prefix"))
    return mutate.delete_prefixes(entries(spark, d), prefixes).select("namespace", "key")


@C.add("SELECT DISTINCT seq, 'set' AS op, namespace, key, coalesce(memory_type, 'semantic') AS memory_type, CASE WHEN coalesce(ttl_ms, 0) <> 0 THEN ttl_ms WHEN memory_type = 'episodic' THEN 3600000 END AS ttl_ms FROM ops WHERE op = 'set'")
def put_with_type_ttl(spark: SparkSession, d: str) -> DataFrame:
    writes = load(spark, d, "ops").where(F.col("op") == "set").select("seq", "namespace", "key", "value", "memory_type", "ttl_ms").distinct()
    ops = mutate.set_ops(writes, AS_OF, apply_type_default_ttl=True, keep=["seq"])
    return ops.select("seq", "op", "namespace", "key", "memory_type", "ttl_ms")


# --- capacity: eight shards by the length of the full key

_SHARD = "length(namespace || key) % 8"
_CAPACITY = 200
_WRITES = "writes AS (SELECT DISTINCT seq, namespace, key FROM ops WHERE op = 'set')"


def _shard():
    return F.pmod(F.length(F.concat("namespace", "key")), F.lit(8))


def _writes(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "ops").where(F.col("op") == "set").select("seq", "namespace", "key").distinct()


def _admit_sql(held: str) -> str:
    return f"""WITH {_WRITES}, held AS (SELECT namespace, key FROM entries WHERE {held}), used AS (SELECT {_SHARD} AS shard, count(*) AS n FROM held GROUP BY 1),
  firsts AS (SELECT namespace, key, min(seq) AS seq, {_SHARD} AS shard FROM writes w WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.namespace = w.namespace AND h.key = w.key) GROUP BY ALL),
  fits AS (SELECT namespace, key, row_number() OVER (PARTITION BY shard ORDER BY seq) + coalesce((SELECT n FROM used u WHERE u.shard = f.shard), 0) <= {_CAPACITY} AS ok FROM firsts f)
  SELECT w.seq, w.namespace, w.key, coalesce(f.ok, true) AS accepted FROM writes w LEFT JOIN fits f ON f.namespace = w.namespace AND f.key = w.key"""


@C.add(_admit_sql("true"))
def capacity_reject(spark: SparkSession, d: str) -> DataFrame:
    return capacity.admit(entries(spark, d), _writes(spark, d), _CAPACITY, _shard(), AS_OF).select("seq", "namespace", "key", "accepted")


@C.add(_admit_sql(LIVE))
def capacity_ttl_first(spark: SparkSession, d: str) -> DataFrame:
    return capacity.admit(entries(spark, d), _writes(spark, d), _CAPACITY, _shard(), AS_OF, capacity.Policy.parse("TTL-first")).select("seq", "namespace", "key", "accepted")


@C.add(f"SELECT namespace, key FROM (SELECT namespace, key, row_number() OVER (PARTITION BY {_SHARD} ORDER BY last_accessed_ms DESC, namespace DESC, key DESC) AS place FROM entries) WHERE place > {_CAPACITY}")
def evict_lru(spark: SparkSession, d: str) -> DataFrame:
    return capacity.evict_lru(entries(spark, d), _CAPACITY, _shard()).select("namespace", "key")


@C.add(f"WITH a AS ({_admit_sql('true')}) SELECT seq, namespace, key FROM a WHERE seq < coalesce((SELECT min(seq) FROM a WHERE NOT accepted), 9223372036854775807)")
def capacity_batch_stop(spark: SparkSession, d: str) -> DataFrame:
    admitted = capacity.admit(entries(spark, d), _writes(spark, d), _CAPACITY, _shard(), AS_OF)
    return capacity.prefix_until_full(admitted).select("seq", "namespace", "key")


@C.add("""SELECT namespace, key, value, memory_type, expires_at_ms, embedding, last_accessed_ms, relevance, created_at_ms, access_count, pinned FROM entries e
  WHERE NOT EXISTS (SELECT 1 FROM ops o WHERE o.op = 'pin' AND o.namespace = e.namespace AND o.key = e.key)
  UNION ALL SELECT namespace, key, 'forced', 'semantic', NULL, [0.5, 0.25], max(ts_ms), 0.75, min(ts_ms), count(DISTINCT seq), true FROM ops WHERE op = 'pin' GROUP BY namespace, key""")
def forced_merge(spark: SparkSession, d: str) -> DataFrame:
    """Full records, with all their metadata, over the state."""
    pins = load(spark, d, "ops").where(F.col("op") == "pin").groupBy("namespace", "key").agg(F.max("ts_ms").alias("last_accessed_ms"), F.min("ts_ms").alias("created_at_ms"), F.count_distinct("seq").alias("access_count"))
    made = {"value": F.lit("forced"), "memory_type": F.lit("semantic"), "expires_at_ms": F.lit(None).cast("long"), "embedding": F.array(F.lit(0.5), F.lit(0.25)).cast("array<float>"), "relevance": F.lit(0.75), "pinned": F.lit(True)}
    rows = entries(spark, d)
    return mutate.merge_forced(rows, pins.withColumns(made).select(*rows.columns))


@C.add("SELECT namespace AS client, (ts_ms // 60000) * 60000 AS window_ms, count(*) AS n, greatest(count(*) - 2, 0) AS refused FROM ops WHERE namespace IS NOT NULL AND ts_ms IS NOT NULL GROUP BY ALL")
def rate_limit_windows(spark: SparkSession, d: str) -> DataFrame:
    return rate_windows(load(spark, d, "ops"), "namespace", "ts_ms", limit=2)


# --- triggers

_MATCH = f"""matches AS (SELECT t.id, t.namespace, e.key, e.value, e.memory_type, {decayed_sql(pinned='e.pinned', relevance='e.relevance', created='e.created_at_ms')} AS relevance, e.created_at_ms, e.access_count
  FROM triggers t JOIN entries e ON e.namespace = t.namespace WHERE {LIVE} AND CASE t.kind WHEN 'max_age' THEN e.created_at_ms < greatest({AS_OF} - t.max_age_ms, 0)
    WHEN 'match_count' THEN starts_with(e.key, coalesce(t.key_prefix, '')) ELSE t.kind = 'min_entries' END),
counted AS (SELECT t.id, count(m.id) AS matched, count(m.id) >= CASE WHEN any_value(t.kind) = 'max_age' THEN 1 ELSE any_value(t.threshold) END AS holds FROM triggers t LEFT JOIN matches m ON m.id = t.id GROUP BY t.id)"""
_READY = f"enabled AND (last_fired_ms IS NULL OR {AS_OF} >= last_fired_ms + coalesce(cooldown_ms, 60000))"


def _triggers(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "triggers")


def _counts(kind: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        return triggers.counts(_triggers(spark, d).where(F.col("kind") == kind), entries(spark, d), AS_OF)

    query.__name__ = f"trigger_{kind}"
    return query


for _kind in triggers.KINDS:
    C.add(f"WITH {_MATCH} SELECT c.* FROM counted c JOIN triggers USING (id) WHERE kind = '{_kind}'")(_counts(_kind))


@C.add(f"WITH {_MATCH} SELECT id, namespace, matched FROM counted JOIN triggers USING (id) WHERE holds AND {_READY}")
def trigger_fire_cooldown(spark: SparkSession, d: str) -> DataFrame:
    return triggers.fire(_triggers(spark, d), entries(spark, d), AS_OF)


@C.add(f"WITH {_MATCH} SELECT id, namespace, matched FROM counted JOIN triggers USING (id) WHERE holds AND enabled")
def trigger_force_fire(spark: SparkSession, d: str) -> DataFrame:
    return triggers.fire(_triggers(spark, d), entries(spark, d), AS_OF, force=True)


@C.add(f"WITH {_MATCH} SELECT id, namespace, key, memory_type, round(m.relevance, 6) AS relevance, m.created_at_ms, access_count FROM matches m WHERE id IN (SELECT id FROM counted JOIN triggers USING (id) WHERE holds AND {_READY})")
def trigger_entries_matching(spark: SparkSession, d: str) -> DataFrame:
    rows = triggers.matching_entries(_triggers(spark, d), entries(spark, d), AS_OF)
    return rows.select("id", "namespace", "key", "memory_type", F.round("relevance", 6).alias("relevance"), "created_at_ms", "access_count")


@C.add(f"WITH {_MATCH} SELECT m.id AS trigger_id, m.namespace, CAST({AS_OF} AS BIGINT) AS fired_at_ms, m.key, e.value, m.memory_type, round(m.relevance, 6) AS relevance, m.created_at_ms, m.access_count FROM matches m JOIN entries e ON e.namespace = m.namespace AND e.key = m.key WHERE m.id IN (SELECT id FROM counted JOIN triggers USING (id) WHERE holds AND {_READY})")
def trigger_contexts(spark: SparkSession, d: str) -> DataFrame:
    return triggers.contexts(_triggers(spark, d), entries(spark, d), AS_OF).withColumn("relevance", F.round("relevance", 6))


@C.add(f"WITH {_MATCH} SELECT t.id, CASE WHEN holds AND {_READY} THEN {AS_OF} ELSE last_fired_ms END AS last_fired_ms FROM triggers t JOIN counted USING (id)")
def trigger_mark_fired(spark: SparkSession, d: str) -> DataFrame:
    t = _triggers(spark, d)
    return triggers.mark_fired(t, triggers.fire(t, entries(spark, d), AS_OF), AS_OF).select("id", "last_fired_ms")


@C.add(f"WITH {_MATCH} SELECT id, action ->> '$.type' AS action_type, action ->> '$.url' AS url, '{{\"trigger_id\":\"' || id || '\",\"namespace\":\"' || namespace || '\",\"fired_at_ms\":{AS_OF},\"matched\":' || matched || '}}' AS payload FROM counted JOIN triggers USING (id) WHERE holds AND {_READY}")
def trigger_payloads(spark: SparkSession, d: str) -> DataFrame:
    t = _triggers(spark, d)
    return triggers.payloads(t, triggers.fire(t, entries(spark, d), AS_OF), AS_OF)


# --- sharing and tokens

_SHARES = """grants AS (SELECT source_namespace, target_namespace, key_prefix, arg_max(permission, (created_at, permission = 'read-write')) AS permission, max(created_at) AS created_at FROM shares GROUP BY ALL)"""


@C.add(f"WITH {_SHARES} SELECT source_namespace, target_namespace, permission, key_prefix, created_at FROM grants")
def share_current(spark: SparkSession, d: str) -> DataFrame:
    return sharing.current_shares(load(spark, d, "shares"))


@C.add(f"WITH {_SHARES}, {LIVE_ENTRIES} SELECT DISTINCT target_namespace, l.namespace, l.key FROM live l JOIN grants g ON g.source_namespace = l.namespace WHERE starts_with(l.key, coalesce(g.key_prefix, ''))")
def share_visible(spark: SparkSession, d: str) -> DataFrame:
    return sharing.visible_entries(entries(spark, d), load(spark, d, "shares"), AS_OF)


_REQUESTS = "requests AS (SELECT DISTINCT g.target_namespace AS caller, o.namespace, o.key, o.op <> 'read' AS is_write FROM ops o JOIN (SELECT DISTINCT source_namespace, target_namespace FROM shares) g ON g.source_namespace = o.namespace WHERE o.key IS NOT NULL)"


@C.add(
    f"""WITH {_SHARES}, {_REQUESTS} SELECT caller, namespace, key, is_write, caller = namespace OR EXISTS (SELECT 1 FROM grants g WHERE g.source_namespace = r.namespace AND g.target_namespace = r.caller
  AND (NOT r.is_write OR g.permission = 'read-write') AND (r.key = '' OR starts_with(r.key, coalesce(g.key_prefix, '')))) AS allowed FROM requests r"""
)
def share_write_check(spark: SparkSession, d: str) -> DataFrame:
    shares = load(spark, d, "shares")
    pairs = shares.select(F.col("source_namespace").alias("namespace"), F.col("target_namespace").alias("caller")).distinct()
    asked = load(spark, d, "ops").where(F.col("key").isNotNull()).join(pairs, "namespace").select("caller", "namespace", "key", (F.col("op") != "read").alias("is_write")).distinct()
    return sharing.check_access(asked, shares)


_TOKENS = [("t0", ["hub-main", "planner"]), ("t1", ["*"]), ("t2", ["ingest"]), ("t3", ["nightly", "planner"])]
_TOKEN_ROWS = ", ".join(f"('{t}', '{n}')" for t, ns in _TOKENS for n in ns)


@C.add(
    f"""WITH {_SHARES}, tok AS (SELECT * FROM (VALUES {_TOKEN_ROWS}) AS t(token, ns)), asks AS (SELECT DISTINCT seq AS request_id, 't' || (seq % 5) AS token, namespace, key, op <> 'read' AS is_write FROM ops WHERE key IS NOT NULL)
  SELECT request_id, token, namespace, key, is_write, EXISTS (SELECT 1 FROM tok t WHERE t.token = a.token AND (t.ns = '*' OR t.ns = a.namespace))
    OR EXISTS (SELECT 1 FROM tok t JOIN grants g ON g.target_namespace = t.ns WHERE t.token = a.token AND g.source_namespace = a.namespace AND (NOT a.is_write OR g.permission = 'read-write') AND (a.key = '' OR starts_with(a.key, coalesce(g.key_prefix, '')))) AS allowed FROM asks a"""
)
def token_authorize(spark: SparkSession, d: str) -> DataFrame:
    tokens = spark.createDataFrame(_TOKENS, "token string, namespaces array<string>")
    asks = load(spark, d, "ops").where(F.col("key").isNotNull()).select(F.col("seq").alias("request_id"), F.concat(F.lit("t"), F.col("seq") % 5).alias("token"), "namespace", "key", (F.col("op") != "read").alias("is_write")).distinct()
    return sharing.authorize(asks, tokens, load(spark, d, "shares"))


QUERIES, ORACLE = C.queries, C.sql
