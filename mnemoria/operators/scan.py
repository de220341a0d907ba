"""Scans, listings and counts. Filters are plain column predicates, so they reach the Parquet scan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import is_live, next_power_of_two, prefix_of_pattern, shard_of
from ..sources import full_key
from .access import live, with_meta


def prefix_scan(entries: DataFrame, prefix: str, as_of_ms: int) -> DataFrame:
    """Live entries whose full key starts with ``prefix``.

    A prefix that holds a colon names a namespace and a key prefix, which is what
    the scan can skip row groups by.
    """
    namespace, colon, rest = prefix.partition(":")
    rows = live(entries, as_of_ms)
    if colon:
        rows = rows.where(F.col("namespace") == namespace)
        return rows.where(F.col("key").startswith(rest)) if rest else rows
    return rows.where(F.col("namespace").startswith(namespace)) if namespace else rows


def list_entries(entries: DataFrame, namespace: str, as_of_ms: int, memory_type: str | None = None, prefix: str | None = None, overrides: DataFrame | None = None, by_relevance: bool = False) -> DataFrame:
    """One namespace's live entries with score and remaining time, filtered first, sorted last."""
    rows = entries.where(F.col("namespace") == namespace)
    if memory_type:
        rows = rows.where(F.col("memory_type") == memory_type)
    if prefix:
        rows = rows.where(F.col("key").startswith(prefix))
    rows = with_meta(rows, as_of_ms, overrides)
    return rows.orderBy(F.desc("relevance"), "namespace", "key") if by_relevance else rows


def relevance_scan(entries: DataFrame, prefix: str, as_of_ms: int, overrides: DataFrame | None = None) -> DataFrame:
    """Live entries below a prefix, the most relevant first, ties by key."""
    return with_meta(prefix_scan(entries, prefix, as_of_ms), as_of_ms, overrides).orderBy(F.desc("relevance"), "namespace", "key")


def scan_with_embeddings(entries: DataFrame, prefix: str, as_of_ms: int) -> DataFrame:
    return prefix_scan(entries, prefix, as_of_ms).select("namespace", "key", "value", "embedding")


def keys_matching(entries: DataFrame, pattern: str, as_of_ms: int) -> DataFrame:
    """Full keys that a ``prefix*`` pattern matches."""
    return prefix_scan(entries, prefix_of_pattern(pattern), as_of_ms).select(full_key().alias("full_key"))


def count_prefix(entries: DataFrame, prefix: str, as_of_ms: int) -> DataFrame:
    return prefix_scan(entries, prefix, as_of_ms).agg(F.count(F.lit(1)).alias("n"))


def active_namespaces(entries: DataFrame, as_of_ms: int) -> DataFrame:
    return live(entries, as_of_ms).select("namespace").distinct()


def type_histogram(entries: DataFrame, as_of_ms: int) -> DataFrame:
    return live(entries, as_of_ms).groupBy("namespace", "memory_type").agg(F.count(F.lit(1)).alias("n"))


def shard_histogram(entries: DataFrame, shards: int) -> DataFrame:
    """Entries per shard, expired ones too."""
    return entries.groupBy(shard_of(full_key(), shards).alias("shard")).agg(F.count(F.lit(1)).alias("n"))


def info(entries: DataFrame, as_of_ms: int, shards: int, capacity_per_shard: int, policy: str) -> DataFrame:
    """One row on the store: ``(version, policy, shards, capacity, entries, live, namespaces)``."""
    from .. import __version__

    is_there = is_live(F.col("expires_at_ms"), as_of_ms)
    n = next_power_of_two(shards)
    return entries.agg(F.count(F.lit(1)).alias("entries"), F.count_if(is_there).alias("live"), F.count_distinct("namespace").alias("namespaces")).select(
        F.lit(__version__).alias("version"), F.lit(policy).alias("policy"), F.lit(n).alias("shards"), F.lit(n * capacity_per_shard).cast("long").alias("capacity"), "entries", "live", "namespaces"
    )
