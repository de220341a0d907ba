"""What the catalogue's queries share: the time they are as of, and pieces of SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.relevance import DEFAULT
from ..operators.access import requests
from ..sources import load

#: 2026-01-01 UTC, which the tables are as of.
AS_OF = 1_767_225_600_000
#: Per-namespace decay used by the queries: (namespace, rate, read_boost, write_boost, floor); null means the default.
OVERRIDES = [("hub-main", 0.001, 0.01, None, 0.2), ("planner", 0.01, 0.0, 0.3, None), ("nightly", None, 0.02, None, 0.05)]
OVERRIDES_SCHEMA = "namespace string, rate double, read_boost double, write_boost double, floor double"

Query = Callable[[SparkSession, str], DataFrame]


class Catalogue:
    """Queries by name, with their SQL where SQL can say the same."""

    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None):
        def keep(query: Query) -> Query:
            self.queries[query.__name__] = query
            if sql is not None:
                self.sql[query.__name__] = sql
            return query

        return keep


def entries(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "entries")


def overrides(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(OVERRIDES, OVERRIDES_SCHEMA)


def asked(spark: SparkSession, folder: str) -> DataFrame:
    """The keys that the log's reads ask for, in its order, as a batch of requests."""
    from pyspark.sql import functions as F

    from ..sources import full_key

    reads = load(spark, folder, "ops").where(F.col("op") == "read").select(F.col("seq").alias("pos"), "namespace", "key").distinct()
    return reads.withColumn("full_key", full_key())


LIVE = f"(expires_at_ms IS NULL OR expires_at_ms > {AS_OF})"
ASKED = "asked AS (SELECT DISTINCT seq AS pos, namespace, key, namespace || ':' || key AS full_key FROM ops WHERE op = 'read')"
LIVE_ENTRIES = f"live AS (SELECT * FROM entries WHERE {LIVE})"
_VALUES = ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" if isinstance(x, str) else f"CAST({x} AS DOUBLE)" for x in row) + ")" for row in OVERRIDES)
CONFIG = f"config AS (SELECT * FROM (VALUES {_VALUES}) AS t(namespace, rate, read_boost, write_boost, floor))"


def decayed_sql(rate: str = repr(DEFAULT.rate), pinned: str = "pinned", relevance: str = "relevance", created: str = "created_at_ms", now: str = str(AS_OF)) -> str:
    return f"""CASE WHEN {pinned} THEN 1.0 WHEN {now} <= {created} THEN least(greatest({relevance}, 0.0), 1.0)
      ELSE least(greatest({relevance} * exp(-({rate}) * (({now} - {created}) / 3600000.0)), 0.0), 1.0) END"""


def effective_sql(rate: str = repr(DEFAULT.rate), boost: str = repr(DEFAULT.read_boost)) -> str:
    return f"least(greatest({decayed_sql(rate)} + access_count * ({boost}), 0.0), 1.0)"


WITH_META = f"""meta AS (SELECT e.namespace, e.key, e.value, e.memory_type, CASE WHEN e.expires_at_ms IS NOT NULL THEN greatest(e.expires_at_ms - {AS_OF}, 0) END AS ttl_ms,
  {effective_sql(f'coalesce(c.rate, {DEFAULT.rate!r})', f'coalesce(c.read_boost, {DEFAULT.read_boost!r})')} AS relevance, access_count, pinned
  FROM entries e LEFT JOIN config c ON c.namespace = e.namespace WHERE {LIVE})"""
META_DEFAULT = f"""meta AS (SELECT namespace, key, value, memory_type, CASE WHEN expires_at_ms IS NOT NULL THEN greatest(expires_at_ms - {AS_OF}, 0) END AS ttl_ms, {effective_sql()} AS relevance, access_count, pinned
  FROM entries WHERE {LIVE})"""

__all__ = ["AS_OF", "Catalogue", "entries", "overrides", "asked", "requests"]
