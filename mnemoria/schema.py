"""Schemas and fixed values of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

#: Memory types with the default time to live of each, in ms (None: no expiry).
TYPE_TTL_MS = {"episodic": 3_600_000, "semantic": None, "procedural": None}
MEMORY_TYPES = tuple(TYPE_TTL_MS)
OPS = ("set", "delete", "delete_prefix", "pin", "unpin", "read", "clear")

ENTRIES = T.StructType(
    [
        T.StructField("namespace", T.StringType()),
        T.StructField("key", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("memory_type", T.StringType()),
        T.StructField("expires_at_ms", T.LongType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("last_accessed_ms", T.LongType()),
        T.StructField("relevance", T.DoubleType()),
        T.StructField("created_at_ms", T.LongType()),
        T.StructField("access_count", T.LongType()),
        T.StructField("pinned", T.BooleanType()),
    ]
)
LOG = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("op", T.StringType()),
        T.StructField("namespace", T.StringType()),
        T.StructField("key", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("memory_type", T.StringType()),
        T.StructField("ttl_ms", T.LongType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("ts_ms", T.LongType()),
    ]
)
SHARES = "source_namespace string, target_namespace string, permission string, key_prefix string, created_at long"
TRIGGERS = "id string, kind string, namespace string, threshold long, max_age_ms long, key_prefix string, enabled boolean, cooldown_ms long, last_fired_ms long, action string"
DEFAULT_COOLDOWN_MS = 60_000
DEFAULT_TOP_K = 10
