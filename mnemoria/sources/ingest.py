"""Other tables as entries and operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ERROR_TTL_MS = 3_600_000


def _millis(column: str):
    return F.unix_millis(F.col(column).cast("timestamp"))


def events_as_entries(events: DataFrame) -> DataFrame:
    """One entry per event: namespace ``user-N``, key ``event:TYPE:ID``; errors expire after an hour."""
    kind = F.when(F.col("event_type") == "purchase", "semantic").when(F.col("event_type") == "signup", "procedural").otherwise("episodic")
    at = _millis("ts")
    return events.select(
        F.concat(F.lit("user-"), F.col("user_id")).alias("namespace"),
        F.concat_ws(":", F.lit("event"), "event_type", F.col("event_id").cast("string")).alias("key"),
        F.col("value").cast("string").alias("value"),
        kind.alias("memory_type"),
        F.when(F.col("event_type") == "error", at + ERROR_TTL_MS).alias("expires_at_ms"),
        F.lit(None).cast("array<float>").alias("embedding"),
        at.alias("last_accessed_ms"),
        F.lit(1.0).alias("relevance"),
        at.alias("created_at_ms"),
        F.lit(0).cast("long").alias("access_count"),
        F.lit(False).alias("pinned"),
    )


def embeddings_as_entries(embeddings: DataFrame) -> DataFrame:
    """One entry per vector: namespace ``label-N``, key ``vec:ID``."""
    zero = F.lit(0).cast("long")
    return embeddings.select(
        F.concat(F.lit("label-"), F.col("label")).alias("namespace"),
        F.concat(F.lit("vec:"), F.col("vec_id")).alias("key"),
        F.col("vec_id").cast("string").alias("value"),
        F.lit("semantic").alias("memory_type"),
        F.lit(None).cast("long").alias("expires_at_ms"),
        "embedding",
        zero.alias("last_accessed_ms"),
        F.lit(1.0).alias("relevance"),
        zero.alias("created_at_ms"),
        zero.alias("access_count"),
        F.lit(False).alias("pinned"),
    )
