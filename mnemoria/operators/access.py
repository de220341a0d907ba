"""Point and batch access. Requests are DataFrames of full keys, answered in their order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import is_live, key_namespace, key_rest
from ..functions.relevance import DEFAULT, Decay, effective, with_decay


def live(entries: DataFrame, as_of_ms: int) -> DataFrame:
    """Entries that aren't expired; the filter reaches the scan."""
    return entries.where(is_live(F.col("expires_at_ms"), as_of_ms))


def remaining_ttl(as_of_ms: int) -> Column:
    """Time left, never below 0; null where nothing expires."""
    return F.when(F.col("expires_at_ms").isNotNull(), F.greatest(F.col("expires_at_ms") - F.lit(as_of_ms), F.lit(0)))


def get(entries: DataFrame, namespace: str, key: str, as_of_ms: int) -> DataFrame:
    """``(value)`` of one live key: one row or none."""
    return live(entries, as_of_ms).where((F.col("namespace") == namespace) & (F.col("key") == key)).select("value")


def with_meta(entries: DataFrame, as_of_ms: int, overrides: DataFrame | None = None, default: Decay = DEFAULT) -> DataFrame:
    """Live entries with remaining time to live and effective relevance."""
    rows = with_decay(live(entries, as_of_ms), overrides, default)
    score = effective(F.col("relevance"), F.col("created_at_ms"), F.col("pinned"), F.col("access_count"), as_of_ms, F.col("rate"), F.col("read_boost"))
    return rows.select("namespace", "key", "value", "memory_type", remaining_ttl(as_of_ms).alias("ttl_ms"), score.alias("relevance"), "access_count", "pinned")


def get_with_meta(entries: DataFrame, namespace: str, key: str, as_of_ms: int, overrides: DataFrame | None = None) -> DataFrame:
    return with_meta(entries.where((F.col("namespace") == namespace) & (F.col("key") == key)), as_of_ms, overrides)


def requests(spark, keys: list[str]) -> DataFrame:
    """``(pos, full_key, namespace, key)`` of a list of full keys."""
    rows = spark.createDataFrame(list(enumerate(keys)), "pos long, full_key string")
    return rows.withColumns({"namespace": key_namespace(F.col("full_key")), "key": key_rest(F.col("full_key"))})


def multi_get(asked: DataFrame, entries: DataFrame, as_of_ms: int) -> DataFrame:
    """Each request, repeated ones too, with the live entry's columns or nulls."""
    found = live(entries, as_of_ms).select("namespace", "key", "value", "memory_type", "expires_at_ms", F.lit(True).alias("found"))
    return asked.join(found, ["namespace", "key"], "left").withColumn("found", F.coalesce("found", F.lit(False)))


def typed_get(asked: DataFrame, entries: DataFrame, as_of_ms: int) -> DataFrame:
    """``(pos, full_key, value, memory_type, ttl_ms)``; -1 where nothing expires or nothing is there."""
    return multi_get(asked, entries, as_of_ms).select("pos", "full_key", "value", "memory_type", F.coalesce(remaining_ttl(as_of_ms), F.lit(-1)).alias("ttl_ms"))


def type_lookup(asked: DataFrame, entries: DataFrame, as_of_ms: int) -> DataFrame:
    return multi_get(asked, entries, as_of_ms).select("pos", "full_key", F.coalesce("memory_type", F.lit("none")).alias("memory_type"))


def batch_found(asked: DataFrame, entries: DataFrame, as_of_ms: int) -> DataFrame:
    return asked.join(live(entries, as_of_ms).select("namespace", "key", "value", "memory_type"), ["namespace", "key"])


def batch_missing(asked: DataFrame, entries: DataFrame, as_of_ms: int) -> DataFrame:
    return asked.join(live(entries, as_of_ms).select("namespace", "key"), ["namespace", "key"], "left_anti")


def relevance_info(asked: DataFrame, entries: DataFrame, as_of_ms: int, overrides: DataFrame | None = None) -> DataFrame:
    """Effective relevance to four decimals, reads and pin of each requested live key; an untouched read."""
    rows = with_meta(entries, as_of_ms, overrides).select("namespace", "key", F.round("relevance", 4).alias("relevance"), "access_count", "pinned")
    return asked.join(rows, ["namespace", "key"]).select("pos", "full_key", "relevance", "access_count", "pinned")


def only_new(writes: DataFrame, entries: DataFrame, as_of_ms: int) -> DataFrame:
    """Writes whose key has no live entry (NX)."""
    return writes.join(live(entries, as_of_ms).select("namespace", "key"), ["namespace", "key"], "left_anti")


def only_existing(writes: DataFrame, entries: DataFrame, as_of_ms: int) -> DataFrame:
    """Writes whose key has a live entry (XX)."""
    return writes.join(live(entries, as_of_ms).select("namespace", "key"), ["namespace", "key"], "left_semi")


def conditional(writes: DataFrame, entries: DataFrame, as_of_ms: int, nx: bool = False, xx: bool = False) -> DataFrame:
    if nx and xx:
        raise ValueError("a write can't ask for a new and an existing key at once")
    return only_new(writes, entries, as_of_ms) if nx else only_existing(writes, entries, as_of_ms) if xx else writes
