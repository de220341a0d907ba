"""Queries over the operators for skewed keys (p4) and snapshot changes (p6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.changes import snapshot_changes
from ..operators.skew import heavy_keys, salted_aggregate
from ..sources import full_key, load


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    fired = load(spark, folder, "trigger_entries").select("namespace")
    log = load(spark, folder, "ops").select(full_key().alias("full_key"))
    parts = [
        heavy_keys(df, column).select(F.lit(kind).alias("kind"), "heavy_key")
        for kind, df, column in (("namespace", fired, "namespace"), ("key", log, "full_key"))
    ]
    return parts[0].unionByName(parts[1])


P4_FOUND = """
SELECT 'namespace' AS kind, namespace AS heavy_key FROM trigger_entries WHERE namespace IS NOT NULL
GROUP BY namespace HAVING count(*) >= 0.01 * (SELECT count(*) FROM trigger_entries)
UNION ALL
SELECT 'key' AS kind, namespace || ':' || key AS heavy_key FROM ops WHERE namespace || ':' || key IS NOT NULL
GROUP BY namespace || ':' || key HAVING count(*) >= 0.01 * (SELECT count(*) FROM ops)
"""


def p4_namespace_stats(spark: SparkSession, folder: str) -> DataFrame:
    fired = load(spark, folder, "trigger_entries").withColumn("usable", F.when(~F.isnan("relevance"), F.col("relevance")))
    out = salted_aggregate(
        fired,
        ["namespace"],
        {"n_rows": ("count", None), "n_keys": ("count_distinct", "key"), "best": ("max", "usable"), "mean": ("avg", "usable"), "reads": ("sum", "access_count"), "first_fired": ("min", "fired_at_ms")},
    )
    return out.withColumn("mean", F.round("mean", 6))


P4_NAMESPACE_STATS = """
SELECT namespace, count(*) AS n_rows, count(DISTINCT key) AS n_keys,
  max(relevance) FILTER (WHERE CAST(relevance AS VARCHAR) <> 'nan') AS best,
  round(avg(relevance) FILTER (WHERE CAST(relevance AS VARCHAR) <> 'nan'), 6) AS mean,
  CAST(sum(access_count) AS BIGINT) AS reads, min(fired_at_ms) AS first_fired
FROM trigger_entries GROUP BY namespace
"""


def p4_key_stats(spark: SparkSession, folder: str) -> DataFrame:
    log = load(spark, folder, "ops").withColumn("full_key", full_key()).withColumn("wrote", F.when(F.col("op") == "set", F.col("seq")))
    return salted_aggregate(
        log, ["full_key"], {"n_ops": ("count", None), "n_seqs": ("count_distinct", "seq"), "first_seq": ("min", "seq"), "last_seq": ("max", "seq"), "n_sets": ("count", "wrote")}
    )


P4_KEY_STATS = """
SELECT namespace || ':' || key AS full_key, count(*) AS n_ops, count(DISTINCT seq) AS n_seqs,
  min(seq) AS first_seq, max(seq) AS last_seq, count(*) FILTER (WHERE op = 'set') AS n_sets
FROM ops GROUP BY 1
"""


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return snapshot_changes(load(spark, folder, "snapshots"))


_P6_STATE = """
WITH last AS (
  SELECT snapshot_ms, key, value, round(relevance, 4) AS relevance FROM snapshots WHERE snapshot_ms IS NOT NULL AND key IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY snapshot_ms, key ORDER BY received_ms DESC NULLS LAST) = 1),
series AS (SELECT snapshot_ms, lag(snapshot_ms) OVER (ORDER BY snapshot_ms) AS before FROM (SELECT DISTINCT snapshot_ms FROM last)),
pairs AS (
  SELECT s.snapshot_ms, coalesce(a.key, b.key) AS key,
    CASE WHEN b.key IS NULL THEN 'added' WHEN a.key IS NULL THEN 'removed'
      WHEN a.value IS DISTINCT FROM b.value OR a.relevance IS DISTINCT FROM b.relevance THEN 'changed' END AS change
  FROM (SELECT l.*, s.before FROM last l JOIN series s USING (snapshot_ms) WHERE s.before IS NOT NULL) a
  FULL JOIN (SELECT l.*, s.snapshot_ms AS after FROM last l JOIN series s ON s.before = l.snapshot_ms) b
    ON a.before = b.snapshot_ms AND a.key = b.key
  JOIN series s ON s.snapshot_ms = coalesce(a.snapshot_ms, b.after))
"""
P6_FOUND = _P6_STATE + "SELECT snapshot_ms, key, change FROM pairs WHERE change IS NOT NULL"


def p6_change_counts(spark: SparkSession, folder: str) -> DataFrame:
    return p6_found(spark, folder).groupBy("snapshot_ms", "change").agg(F.count(F.lit(1)).alias("n_keys"))


P6_CHANGE_COUNTS = _P6_STATE + "SELECT snapshot_ms, change, count(*) AS n_keys FROM pairs WHERE change IS NOT NULL GROUP BY snapshot_ms, change"

QUERIES = {f.__name__: f for f in (p4_found, p4_namespace_stats, p4_key_stats, p6_found, p6_change_counts)}
ORACLE = {"p4_found": P4_FOUND, "p4_namespace_stats": P4_NAMESPACE_STATS, "p4_key_stats": P4_KEY_STATS, "p6_found": P6_FOUND, "p6_change_counts": P6_CHANGE_COUNTS}
