"""Expiry and reaping: which entries go, as deletions for the log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import is_live
from ..functions.relevance import DEFAULT, Decay, decayed, with_decay


def expired(entries: DataFrame, as_of_ms: int) -> DataFrame:
    """``(namespace, key)`` of expired entries."""
    return entries.where(~is_live(F.col("expires_at_ms"), as_of_ms)).select("namespace", "key")


def low_relevance(entries: DataFrame, as_of_ms: int, overrides: DataFrame | None = None, default: Decay = DEFAULT, per_namespace: bool = False) -> DataFrame:
    """``(namespace, key)`` of live, unpinned entries whose decayed score is below the floor.

    Reads don't count here, and every namespace has the default rate and floor,
    unless ``per_namespace`` asks for its own.
    """
    rows = entries.where(is_live(F.col("expires_at_ms"), as_of_ms) & ~F.coalesce("pinned", F.lit(False)))
    rows = with_decay(rows, overrides if per_namespace else None, default)
    score = decayed(F.col("relevance"), F.col("created_at_ms"), F.lit(False), as_of_ms, F.col("rate"))
    return rows.where(score < F.col("floor")).select("namespace", "key")


def delete_ops(doomed: DataFrame, as_of_ms: int) -> DataFrame:
    return doomed.select(F.lit("delete").alias("op"), "namespace", "key", F.lit(as_of_ms).cast("long").alias("ts_ms"))


def counts_by_namespace(doomed: DataFrame) -> DataFrame:
    return doomed.groupBy("namespace").agg(F.count(F.lit(1)).alias("n"))
