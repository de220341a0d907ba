"""Queries for point access, scans, relevance and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys, vectors
from ..operators import access, reap, scan, vector_search
from ..sources import full_key, load
from ..sources.ingest import embeddings_as_entries, events_as_entries
from .common import AS_OF, ASKED, CONFIG, LIVE, LIVE_ENTRIES, META_DEFAULT, WITH_META, Catalogue, asked, decayed_sql, entries, overrides

C = Catalogue()
_R = lambda df, *names, digits=6: df.withColumns({n: F.round(n, digits) for n in names})


@C.add(f"SELECT value FROM entries WHERE namespace = 'hub-main' AND key = 'event:ping:1409' AND {LIVE}")
def point_get(spark: SparkSession, d: str) -> DataFrame:
    return access.get(entries(spark, d), "hub-main", "event:ping:1409", AS_OF)


@C.add(f"WITH {META_DEFAULT} SELECT namespace, key, value, memory_type, ttl_ms, round(relevance, 6) AS relevance, access_count, pinned FROM meta WHERE namespace = 'hub-main' AND key = 'event:ping:1409'")
def point_get_with_meta(spark: SparkSession, d: str) -> DataFrame:
    return _R(access.get_with_meta(entries(spark, d), "hub-main", "event:ping:1409", AS_OF), "relevance")


@C.add(f"WITH {ASKED}, {LIVE_ENTRIES} SELECT pos, full_key, l.value, l.memory_type, l.namespace IS NOT NULL AS found FROM asked a LEFT JOIN live l ON l.namespace = a.namespace AND l.key = a.key")
def multi_get(spark: SparkSession, d: str) -> DataFrame:
    return access.multi_get(asked(spark, d), entries(spark, d), AS_OF).select("pos", "full_key", "value", "memory_type", "found")


@C.add(f"WITH {ASKED}, {LIVE_ENTRIES} SELECT pos, full_key, l.value, l.memory_type, CAST(CASE WHEN l.expires_at_ms IS NULL THEN -1 ELSE greatest(l.expires_at_ms - {AS_OF}, 0) END AS BIGINT) AS ttl_ms FROM asked a LEFT JOIN live l ON l.namespace = a.namespace AND l.key = a.key")
def typed_get(spark: SparkSession, d: str) -> DataFrame:
    return access.typed_get(asked(spark, d), entries(spark, d), AS_OF)


@C.add(f"WITH {ASKED}, {LIVE_ENTRIES} SELECT pos, full_key, coalesce(l.memory_type, 'none') AS memory_type FROM asked a LEFT JOIN live l ON l.namespace = a.namespace AND l.key = a.key")
def type_lookup(spark: SparkSession, d: str) -> DataFrame:
    return access.type_lookup(asked(spark, d), entries(spark, d), AS_OF)


@C.add(f"WITH {ASKED}, {LIVE_ENTRIES} SELECT pos, full_key, l.value, l.memory_type FROM asked a JOIN live l ON l.namespace = a.namespace AND l.key = a.key")
def batch_get(spark: SparkSession, d: str) -> DataFrame:
    return access.batch_found(asked(spark, d), entries(spark, d), AS_OF).select("pos", "full_key", "value", "memory_type")


@C.add(f"WITH {ASKED}, {LIVE_ENTRIES} SELECT pos, full_key FROM asked a WHERE NOT EXISTS (SELECT 1 FROM live l WHERE l.namespace = a.namespace AND l.key = a.key)")
def batch_get_missing(spark: SparkSession, d: str) -> DataFrame:
    return access.batch_missing(asked(spark, d), entries(spark, d), AS_OF).select("pos", "full_key")


@C.add(f"WITH {ASKED}, {META_DEFAULT} SELECT pos, full_key, round(relevance, 4) AS relevance, access_count, pinned FROM asked JOIN meta USING (namespace, key)")
def relevance_info(spark: SparkSession, d: str) -> DataFrame:
    return access.relevance_info(asked(spark, d), entries(spark, d), AS_OF)


_SETS = "sets AS (SELECT DISTINCT seq, namespace, key, value FROM ops WHERE op = 'set')"


@C.add(f"WITH {_SETS}, {LIVE_ENTRIES} SELECT * FROM sets s WHERE NOT EXISTS (SELECT 1 FROM live l WHERE l.namespace = s.namespace AND l.key = s.key)")
def nx_filter(spark: SparkSession, d: str) -> DataFrame:
    writes = load(spark, d, "ops").where(F.col("op") == "set").select("seq", "namespace", "key", "value").distinct()
    return access.conditional(writes, entries(spark, d), AS_OF, nx=True)


@C.add(f"WITH {_SETS}, {LIVE_ENTRIES} SELECT * FROM sets s WHERE EXISTS (SELECT 1 FROM live l WHERE l.namespace = s.namespace AND l.key = s.key)")
def xx_filter(spark: SparkSession, d: str) -> DataFrame:
    writes = load(spark, d, "ops").where(F.col("op") == "set").select("seq", "namespace", "key", "value").distinct()
    return access.conditional(writes, entries(spark, d), AS_OF, xx=True)


@C.add(f"SELECT namespace, key, value, memory_type FROM entries WHERE namespace = 'hub-main' AND key LIKE 'event:%' AND {LIVE}")
def prefix_scan(spark: SparkSession, d: str) -> DataFrame:
    return scan.prefix_scan(entries(spark, d), "hub-main:event:", AS_OF).select("namespace", "key", "value", "memory_type")


@C.add(f"SELECT namespace, key, value, embedding FROM entries WHERE namespace = 'planner' AND {LIVE}")
def scan_with_embeddings(spark: SparkSession, d: str) -> DataFrame:
    return scan.scan_with_embeddings(entries(spark, d), "planner:", AS_OF)


@C.add(f"WITH {META_DEFAULT} SELECT namespace, key, value, memory_type, ttl_ms, round(relevance, 6) AS relevance, access_count, pinned FROM meta WHERE namespace = 'relay-east' AND memory_type = 'episodic' AND key LIKE 'log:%'")
def type_filtered_list(spark: SparkSession, d: str) -> DataFrame:
    return _R(scan.list_entries(entries(spark, d), "relay-east", AS_OF, "episodic", "log:"), "relevance")


@C.add(f"WITH {CONFIG}, {WITH_META} SELECT namespace, key, value, memory_type, ttl_ms, round(relevance, 6) AS relevance, access_count, pinned FROM meta WHERE namespace = 'hub-main' AND memory_type = 'semantic' ORDER BY relevance DESC, key")
def relevance_list_filtered(spark: SparkSession, d: str) -> DataFrame:
    return _R(scan.list_entries(entries(spark, d), "hub-main", AS_OF, "semantic", overrides=overrides(spark), by_relevance=True), "relevance")


@C.add(f"SELECT namespace || ':' || key AS full_key FROM entries WHERE namespace LIKE 'agent-00000%' AND {LIVE}")
def keys_pattern(spark: SparkSession, d: str) -> DataFrame:
    return scan.keys_matching(entries(spark, d), "agent-00000*", AS_OF)


@C.add(f"SELECT count(*) AS n FROM entries WHERE namespace = 'hub-main' AND key LIKE 'chat:%' AND {LIVE}")
def prefix_count(spark: SparkSession, d: str) -> DataFrame:
    return scan.count_prefix(entries(spark, d), "hub-main:chat:", AS_OF)


@C.add(f"SELECT DISTINCT namespace FROM entries WHERE {LIVE}")
def active_namespaces(spark: SparkSession, d: str) -> DataFrame:
    return scan.active_namespaces(entries(spark, d), AS_OF)


@C.add(f"SELECT namespace, memory_type, count(*) AS n FROM entries WHERE {LIVE} GROUP BY ALL")
def type_histogram(spark: SparkSession, d: str) -> DataFrame:
    return scan.type_histogram(entries(spark, d), AS_OF)


_SHARD = "CAST(concat('0x', substr(md5(namespace || ':' || key), 1, 8)) AS BIGINT) % 64"


@C.add(f"SELECT CAST({_SHARD} AS INTEGER) AS shard, count(*) AS n FROM entries GROUP BY 1")
def shard_histogram(spark: SparkSession, d: str) -> DataFrame:
    return scan.shard_histogram(entries(spark, d), 64)


@C.add(f"SELECT '0.1.0' AS version, 'reject' AS policy, 64 AS shards, CAST(64000 AS BIGINT) AS capacity, count(*) AS entries, count(*) FILTER (WHERE {LIVE}) AS live, count(DISTINCT namespace) AS namespaces FROM entries")
def store_info(spark: SparkSession, d: str) -> DataFrame:
    return scan.info(entries(spark, d), AS_OF, 64, 1000, "reject")


@C.add(f"WITH {META_DEFAULT} SELECT namespace, key, value, memory_type, ttl_ms, round(relevance, 6) AS relevance, access_count, pinned FROM meta ORDER BY relevance DESC, namespace, key")
def relevance_scan(spark: SparkSession, d: str) -> DataFrame:
    return _R(scan.relevance_scan(entries(spark, d), "", AS_OF), "relevance")


@C.add(f"WITH {CONFIG}, {WITH_META} SELECT namespace, key, round(relevance, 6) AS relevance FROM meta")
def decay_override(spark: SparkSession, d: str) -> DataFrame:
    return _R(access.with_meta(entries(spark, d), AS_OF, overrides(spark)).select("namespace", "key", "relevance"), "relevance")


@C.add(f"SELECT namespace, key, CAST(CASE WHEN expires_at_ms IS NOT NULL THEN greatest(expires_at_ms - {AS_OF}, 0) END AS BIGINT) AS ttl_ms FROM entries WHERE {LIVE}")
def ttl_remaining(spark: SparkSession, d: str) -> DataFrame:
    return access.live(entries(spark, d), AS_OF).select("namespace", "key", access.remaining_ttl(AS_OF).alias("ttl_ms"))


@C.add(f"SELECT namespace, count(*) AS n FROM entries WHERE NOT {LIVE} GROUP BY namespace")
def expired_sweep(spark: SparkSession, d: str) -> DataFrame:
    return reap.counts_by_namespace(reap.expired(entries(spark, d), AS_OF))


@C.add(f"SELECT 'delete' AS op, namespace, key, CAST({AS_OF} AS BIGINT) AS ts_ms FROM entries WHERE {LIVE} AND NOT pinned AND {decayed_sql()} < 0.01")
def low_relevance_reap(spark: SparkSession, d: str) -> DataFrame:
    return reap.delete_ops(reap.low_relevance(entries(spark, d), AS_OF), AS_OF)


@C.add(f"""WITH {CONFIG} SELECT e.namespace, e.key FROM entries e LEFT JOIN config c ON c.namespace = e.namespace WHERE {LIVE} AND NOT pinned
  AND {decayed_sql("coalesce(c.rate, 0.028881132523331052)")} < coalesce(c.floor, 0.01)""")
def reap_per_namespace(spark: SparkSession, d: str) -> DataFrame:
    return reap.low_relevance(entries(spark, d), AS_OF, overrides(spark), per_namespace=True)


# --- vectors: those of the embeddings table, one namespace per label

_VECTORS = "vectors AS (SELECT 'label-' || label AS namespace, 'vec:' || vec_id AS key, CAST(vec_id AS VARCHAR) AS value, embedding FROM embeddings)"
_DISTANCE = "1 - list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST({} AS DOUBLE[]))"
_FIRST = "(SELECT embedding FROM embeddings WHERE vec_id = 0)"


def _query(spark: SparkSession, d: str) -> list[float]:
    return load(spark, d, "embeddings").where(F.col("vec_id") == 0).first()["embedding"]


@C.add(f"WITH {_VECTORS} SELECT key, value, round({_DISTANCE.format(_FIRST)}, 6) AS distance FROM vectors v WHERE namespace = 'label-3' ORDER BY {_DISTANCE.format(_FIRST)}, key LIMIT 10")
def vector_topk_namespace(spark: SparkSession, d: str) -> DataFrame:
    return _R(vector_search.top_k(embeddings_as_entries(load(spark, d, "embeddings")), "label-3", _query(spark, d), AS_OF), "distance")


@C.add(f"WITH {_VECTORS} SELECT key, value, round({_DISTANCE.format(_FIRST)}, 6) AS distance FROM vectors v ORDER BY {_DISTANCE.format(_FIRST)}, key LIMIT 25")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    everywhere = embeddings_as_entries(load(spark, d, "embeddings")).withColumn("namespace", F.lit("all"))
    return _R(vector_search.top_k(everywhere, "all", _query(spark, d), AS_OF, k=25), "distance")


@C.add(
    f"""WITH {_VECTORS}, scored AS (SELECT q.vec_id AS query_id, v.key, v.value, {_DISTANCE.format('q.embedding')} AS distance FROM embeddings q JOIN vectors v ON v.namespace = 'label-' || q.label WHERE q.vec_id % 100 = 0)
  SELECT query_id, key, value, round(distance, 6) AS distance, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, key) AS rank FROM scored) WHERE rank <= 5"""
)
def vector_multi_query(spark: SparkSession, d: str) -> DataFrame:
    vectors = load(spark, d, "embeddings")
    queries = vectors.where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), F.concat(F.lit("label-"), F.col("label")).alias("namespace"), "embedding")
    return _R(vector_search.multi_top_k(embeddings_as_entries(vectors), queries, AS_OF, k=5), "distance")


@C.add(
    f"""SELECT namespace, count(*) AS vectors, CAST(min(len(embedding)) AS INTEGER) AS min_dims, CAST(max(len(embedding)) AS INTEGER) AS max_dims,
  min(len(embedding)) = max(len(embedding)) AND min(len(embedding)) > 0 AS searchable FROM entries WHERE {LIVE} AND embedding IS NOT NULL GROUP BY namespace"""
)
def vector_dim_guard(spark: SparkSession, d: str) -> DataFrame:
    return vector_search.dimension_report(entries(spark, d), AS_OF)


@C.add()
def vector_lsh(spark: SparkSession, d: str) -> DataFrame:
    return vector_search.lsh_top_k(embeddings_as_entries(load(spark, d, "embeddings")), "label-3", _query(spark, d), AS_OF)


@C.add(
    """SELECT 'user-' || user_id AS namespace, 'event:' || event_type || ':' || event_id AS key,
  CASE event_type WHEN 'purchase' THEN 'semantic' WHEN 'signup' THEN 'procedural' ELSE 'episodic' END AS memory_type,
  CASE WHEN event_type = 'error' THEN epoch_us(ts) // 1000 + 3600000 END AS expires_at_ms, epoch_us(ts) // 1000 AS created_at_ms FROM events"""
)
def ingest_events(spark: SparkSession, d: str) -> DataFrame:
    return events_as_entries(load(spark, d, "events")).select("namespace", "key", "memory_type", "expires_at_ms", "created_at_ms")


@C.add(f"SELECT namespace, count(*) AS entries, CAST(sum(access_count) AS BIGINT) AS reads, count(*) FILTER (WHERE pinned) AS pinned, count(*) FILTER (WHERE NOT {LIVE}) AS expired FROM entries GROUP BY namespace")
def namespace_metrics(spark: SparkSession, d: str) -> DataFrame:
    e = entries(spark, d)
    return e.groupBy("namespace").agg(
        F.count(F.lit(1)).alias("entries"), F.sum("access_count").alias("reads"), F.count(F.when(F.col("pinned"), 1)).alias("pinned"), F.count(F.when(F.col("expires_at_ms") <= AS_OF, 1)).alias("expired")
    )


@C.add("SELECT full_key, split_part(full_key, ':', 1) AS namespace, CASE WHEN contains(full_key, ':') THEN substr(full_key, instr(full_key, ':') + 1) END AS rest, split_part(key, ':', 1) AS segment FROM (SELECT namespace || ':' || key AS full_key, key FROM entries UNION ALL SELECT namespace, key FROM entries)")
def key_parts(spark: SparkSession, d: str) -> DataFrame:
    rows = entries(spark, d)
    both = rows.select(full_key().alias("full_key"), "key").unionByName(rows.select(F.col("namespace").alias("full_key"), "key"))
    k = F.col("full_key")
    return both.select("full_key", keys.key_namespace(k).alias("namespace"), keys.key_rest(k).alias("rest"), keys.first_segment(F.col("key")).alias("segment"))


@C.add("SELECT vec_id, embedding FROM embeddings")
def vector_parse(spark: SparkSession, d: str) -> DataFrame:
    texts = load(spark, d, "embeddings").select("vec_id", F.to_json("embedding").alias("json"))
    return texts.select("vec_id", vectors.parse_vector(F.col("json")).alias("embedding"))


QUERIES, ORACLE = C.queries, C.sql
