"""Queries for personal information in entries and trigger entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import load
from .pii import personal_data_kinds, redact_column

_KEEP = ["source_table", "fire_id", "namespace", "key"]


def _values(spark: SparkSession, folder: str) -> DataFrame:
    state = load(spark, folder, "entries").select(F.lit("entries").alias("source_table"), F.lit(0).cast("long").alias("fire_id"), "namespace", "key", "value")
    fired = load(spark, folder, "trigger_entries").select(F.lit("trigger_entries").alias("source_table"), "fire_id", "namespace", "key", "value")
    return state.unionByName(fired)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return personal_data_kinds(_values(spark, folder), "value", _KEEP).distinct()


def p5_redacted(spark: SparkSession, folder: str) -> DataFrame:
    return redact_column(_values(spark, folder), "value")


QUERIES = {f.__name__: f for f in (p5_found, p5_redacted)}
ORACLE: dict[str, str] = {}
