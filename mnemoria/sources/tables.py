"""Readers of the Parquet tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table, as file or folder of files; columns and filters reach the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_tables(spark: SparkSession, folder: str, *names: str) -> list[DataFrame]:
    return [load(spark, folder, name) for name in names]


def full_key(namespace: Column | str = "namespace", key: Column | str = "key") -> Column:
    """``namespace:key``; null where one of the two is null."""
    namespace = F.col(namespace) if isinstance(namespace, str) else namespace
    key = F.col(key) if isinstance(key, str) else key
    return F.concat(namespace, F.lit(":"), key)
