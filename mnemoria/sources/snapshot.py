"""Snapshots: one folder of Parquet files per time, below a common root."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import is_live
from ..schema import ENTRIES

_FOLDER = re.compile(r"snapshot_ts=(\d+)$")
#: What older snapshots don't have, and what is assumed then.
DEFAULTS = {"relevance": 1.0, "created_at_ms": 0, "access_count": 0, "pinned": False, "last_accessed_ms": 0}


def _fs(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def write_snapshot(entries: DataFrame, root: str, as_of_ms: int, partitions: int | None = None) -> str:
    """Write the live entries; the folder counts once its success marker is there. Gives its path."""
    rows = entries.where(is_live(F.col("expires_at_ms"), as_of_ms))
    # clustered by key, so that prefix reads skip row groups by their statistics
    rows = rows.repartitionByRange(partitions, "namespace", "key") if partitions else rows.repartitionByRange("namespace", "key")
    path = f"{root}/snapshot_ts={as_of_ms}"
    rows.sortWithinPartitions("namespace", "key").write.mode("overwrite").option("compression", "zstd").parquet(path)
    return path


def list_snapshots(spark: SparkSession, root: str) -> list[int]:
    """Times of complete snapshots, in order. A folder without a success marker is no snapshot."""
    fs, target = _fs(spark, root)
    if not fs.exists(target):
        return []
    names = [s.getPath() for s in fs.listStatus(target)]
    done = [p for p in names if _FOLDER.search(p.getName()) and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(_FOLDER.search(p.getName())[1]) for p in done)


def latest_snapshot(spark: SparkSession, root: str) -> int | None:
    return max(list_snapshots(spark, root), default=None)


def read_snapshot(spark: SparkSession, root: str, at_ms: int | None = None) -> DataFrame:
    """A snapshot's entries, the latest if no time is given; columns that an old one lacks get ``DEFAULTS``."""
    at_ms = latest_snapshot(spark, root) if at_ms is None else at_ms
    if at_ms is None:
        return spark.createDataFrame([], ENTRIES)
    rows = spark.read.option("mergeSchema", "true").parquet(f"{root}/snapshot_ts={at_ms}")
    have = set(rows.columns)
    return rows.select(*[(F.coalesce(F.col(f.name), F.lit(DEFAULTS.get(f.name))) if f.name in have else F.lit(DEFAULTS.get(f.name))).cast(f.dataType).alias(f.name) for f in ENTRIES.fields])


def prune_snapshots(spark: SparkSession, root: str, keep: int = 3) -> list[int]:
    """Delete all but the newest ``keep``; gives the times of what went."""
    gone = list_snapshots(spark, root)[:-keep] if keep else list_snapshots(spark, root)
    for at in gone:
        fs, target = _fs(spark, f"{root}/snapshot_ts={at}")
        fs.delete(target, True)
    return gone


def restore(spark: SparkSession, root: str, as_of_ms: int, current: DataFrame | None = None, at_ms: int | None = None) -> DataFrame:
    """The snapshot's entries that are still live, with all their metadata, over what is there."""
    from ..operators.mutate import merge_forced

    rows = read_snapshot(spark, root, at_ms).where(is_live(F.col("expires_at_ms"), as_of_ms))
    return rows if current is None else merge_forced(current.select(*rows.columns), rows)


def manifest(entries: DataFrame) -> DataFrame:
    """``(namespace, entries, checksum, digest)``: sums per namespace that don't depend on the order of rows, of CRC-32 and of the first 32 bits of MD5."""
    row = F.concat_ws("\u0001", "key", F.coalesce("value", F.lit("\u0002")), "memory_type").cast("binary")
    digest = F.conv(F.substring(F.md5(row), 1, 8), 16, 10).cast("long")
    return entries.groupBy("namespace").agg(F.count(F.lit(1)).alias("entries"), F.sum(F.crc32(row)).alias("checksum"), F.sum(digest).alias("digest"))
