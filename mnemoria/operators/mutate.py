"""Writes and deletions, as rows for the operation log or as the state they leave."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import is_live
from ..schema import MEMORY_TYPES, TYPE_TTL_MS
from .access import live
from .prefixes import prefix_pairs


def set_ops(writes: DataFrame, as_of_ms: int, apply_type_default_ttl: bool = False, default_type: str = "semantic", keep: list[str] | None = None) -> DataFrame:
    """Log rows (without seq) for writes of ``(namespace, key, value[, memory_type, ttl_ms, embedding])``.

    The type is ``default_type`` where none is given, and an unknown type is
    refused when the rows are read. A write without embedding erases one. Columns
    in ``keep`` go with the rows.
    """
    have = set(writes.columns)
    kind = F.lower(F.coalesce(F.col("memory_type") if "memory_type" in have else F.lit(None).cast("string"), F.lit(default_type)))
    checked = F.when(kind.isin(*MEMORY_TYPES), kind).otherwise(F.raise_error(F.concat(F.lit("unknown memory type "), kind)).cast("string"))
    ttl = F.nullif(F.col("ttl_ms").cast("long"), F.lit(0).cast("long")) if "ttl_ms" in have else F.lit(None).cast("long")
    if apply_type_default_ttl:
        for name, default in TYPE_TTL_MS.items():
            if default is not None:
                ttl = F.when(ttl.isNull() & (kind == name), F.lit(default)).otherwise(ttl)
    vector = F.col("embedding").cast("array<float>") if "embedding" in have else F.lit(None).cast("array<float>")
    return writes.select(*(keep or []), F.lit("set").alias("op"), "namespace", "key", "value", checked.alias("memory_type"), ttl.alias("ttl_ms"), vector.alias("embedding"), F.lit(as_of_ms).cast("long").alias("ts_ms"))


def delete_keys(entries: DataFrame, keys: DataFrame) -> DataFrame:
    """State without the given ``(namespace, key)``."""
    return entries.join(keys.select("namespace", "key"), ["namespace", "key"], "left_anti")


def deleted_count(entries: DataFrame, keys: DataFrame, as_of_ms: int) -> DataFrame:
    """How many of the keys were there and live."""
    return live(entries, as_of_ms).join(keys.select("namespace", "key").distinct(), ["namespace", "key"], "left_semi").agg(F.count(F.lit(1)).alias("n"))


def delete_namespace(entries: DataFrame, namespace: str) -> DataFrame:
    return entries.where(F.col("namespace") != namespace)


def delete_prefixes(entries: DataFrame, prefixes: DataFrame) -> DataFrame:
    """State without the keys below any ``(namespace, key_prefix)``; a null or empty prefix means all of a namespace.

    Keys meet the prefixes that they begin with by equality (``prefix_pairs``).
    Rows without a key stay.
    """
    p = prefixes.select("namespace", F.coalesce("key_prefix", F.lit("")).alias("prefix")).distinct()
    gone = prefix_pairs(entries.select("namespace", "key"), p).select("namespace", "key").distinct()
    return entries.join(gone, ["namespace", "key"], "left_anti")


def merge_forced(entries: DataFrame, forced: DataFrame) -> DataFrame:
    """State after full records are put over it, as on a restore: they win over what is there, capacity or not."""
    return forced.unionByName(entries.join(forced.select("namespace", "key"), ["namespace", "key"], "left_anti"))


def purge_expired(entries: DataFrame, as_of_ms: int) -> DataFrame:
    return entries.where(is_live(F.col("expires_at_ms"), as_of_ms))
