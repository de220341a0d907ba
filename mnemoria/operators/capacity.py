"""Capacity of shards: which writes are refused, which entries are evicted."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import is_live

#: Slices of a shard in which ranks are taken before they are put together.
SLICES = 64


class Policy(Enum):
    REJECT = "reject"
    TTL_FIRST = "ttl-first"
    LRU = "lru"

    @classmethod
    def parse(cls, text: str) -> Policy:
        return cls(text.strip().lower())


def _running_count(rows: DataFrame, order: str) -> DataFrame:
    """``rows`` with ``nth``: the running number of rows per ``shard`` in the order of a numeric column.

    Rows are first numbered within slices of the shard by value range, then the
    sizes of the slices before are added, so that a large shard isn't numbered in
    one task.
    """
    ends = rows.groupBy("shard").agg(F.min(order).alias("__low"), F.max(order).alias("__high"))
    place = F.floor((F.col(order) - F.col("__low")) / F.greatest(F.col("__high") - F.col("__low") + 1, F.lit(1)) * SLICES)
    sliced = rows.join(ends, "shard").withColumn("__slice", place).drop("__low", "__high")
    sizes = sliced.groupBy("shard", "__slice").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("shard").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("shard", "__slice", F.coalesce(before, F.lit(0)).alias("__before"))
    nth = F.row_number().over(Window.partitionBy("shard", "__slice").orderBy(order, "namespace", "key"))
    return sliced.withColumn("__nth", nth).join(offsets, ["shard", "__slice"]).withColumn("nth", F.col("__before") + F.col("__nth")).drop("__slice", "__nth", "__before")


def admit(entries: DataFrame, writes: DataFrame, capacity: int, shard: Column, as_of_ms: int, policy: Policy = Policy.REJECT) -> DataFrame:
    """``writes`` (with ``seq``) plus ``shard`` and ``accepted``.

    Writes to keys that exist always pass. A new key passes while its shard has
    room, in the order of ``seq``; later writes to a key that passed pass too.
    ``ttl-first`` doesn't count entries that are expired; ``lru`` refuses nothing.
    """
    held = entries if policy is Policy.REJECT else entries.where(is_live(F.col("expires_at_ms"), as_of_ms))
    there = held.select("namespace", "key").withColumn("__there", F.lit(True))
    marked = writes.join(there, ["namespace", "key"], "left").withColumns({"shard": shard, "__there": F.coalesce("__there", F.lit(False))})
    if policy is Policy.LRU:
        return marked.drop("__there").withColumn("accepted", F.lit(True))
    firsts = marked.where(~F.col("__there")).groupBy("shard", "namespace", "key").agg(F.min("seq").alias("seq"))
    used = held.groupBy(shard.alias("shard")).agg(F.count(F.lit(1)).alias("__used"))
    room = _running_count(firsts, "seq").join(used, "shard", "left").select("namespace", "key", (F.col("nth") + F.coalesce("__used", F.lit(0)) <= capacity).alias("__fits"))
    out = marked.join(room, ["namespace", "key"], "left")
    return out.withColumn("accepted", F.col("__there") | F.coalesce("__fits", F.lit(False))).drop("__there", "__fits")


def evict_lru(entries: DataFrame, capacity: int, shard: Column, as_of_ms: int | None = None) -> DataFrame:
    """``(namespace, key, shard)`` of the entries that must go so that each shard keeps its ``capacity`` last used ones.

    Exact where a store would sample: the oldest access goes first, ties by key.
    """
    rows = entries if as_of_ms is None else entries.where(is_live(F.col("expires_at_ms"), as_of_ms))
    rows = rows.select("namespace", "key", F.col("last_accessed_ms").alias("used_ms"), shard.alias("shard"))
    over = rows.groupBy("shard").agg((F.count(F.lit(1)) - F.lit(capacity)).alias("__over")).where(F.col("__over") > 0)
    return _running_count(rows.join(over, "shard"), "used_ms").where(F.col("nth") <= F.col("__over")).select("namespace", "key", "shard")


def prefix_until_full(writes: DataFrame) -> DataFrame:
    """The writes of a batch before its first refused one, as a batch stops there."""
    stop = writes.where(~F.col("accepted")).agg(F.min("seq")).first()[0]
    return writes if stop is None else writes.where(F.col("seq") < stop)
