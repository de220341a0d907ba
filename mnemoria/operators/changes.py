"""What changed between full snapshots: gaps and islands over key and row hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _digest(columns: list[Column]) -> list[Column]:
    """128 bits over the columns, as two hashes; nulls keep their places."""
    marks = [F.when(c.isNull(), F.lit(0)).otherwise(F.lit(1)) for c in columns]
    return [F.xxhash64(F.lit(seed), *[x for pair in zip(marks, columns) for x in pair]) for seed in (11, 23)]


def settle_deliveries(snapshots: DataFrame, compare: dict[str, Column], at: str = "snapshot_ms", key: str = "key", received: str = "received_ms") -> DataFrame:
    """``(snap, key, h1, h2)``: for each snapshot and key the row received last.

    Rows without a snapshot or key are no records. Rows received at the same
    time count by the larger digest, so the result doesn't depend on the order
    of rows. A received time that is null counts as earliest.
    """
    slim = snapshots.where(F.col(at).isNotNull() & F.col(key).isNotNull())
    h1, h2 = _digest(list(compare.values()))
    slim = slim.select(F.col(at).alias("snap"), F.col(key).alias("key"), F.coalesce(F.col(received), F.lit(-(1 << 63))).alias("received"), h1.alias("h1"), h2.alias("h2"))
    order = F.struct("received", "h1", "h2")
    return slim.groupBy("snap", "key").agg(F.max(order).alias("last")).select("snap", "key", "last.h1", "last.h2")


def validity_intervals(snapshots: DataFrame, compare: dict[str, Column], at: str = "snapshot_ms", key: str = "key", received: str = "received_ms") -> DataFrame:
    """``(key, first_snap, last_snap, next_snap, joined)``: maximal runs of consecutive snapshots with one unchanged record.

    ``next_snap`` is the snapshot after ``last_snap`` (null at the end of the
    series) and ``joined`` tells whether another interval of the key ends just
    before this one begins. A snapshot in which no key is left can't be seen in
    the rows and so doesn't count as a delivery.
    """
    rows = settle_deliveries(snapshots, compare, at, key, received)
    # one row per delivery date, so the single-partition window holds dates, not records
    dates = rows.select("snap").distinct()
    series = dates.select(
        "snap",
        F.row_number().over(Window.orderBy("snap")).alias("no"),
        F.lead("snap").over(Window.orderBy("snap")).alias("following"),
    )
    per_key = Window.partitionBy("key").orderBy("no")
    run = per_key.rowsBetween(Window.unboundedPreceding, 0)
    near = F.lag("no").over(per_key) == F.col("no") - 1
    same = near & (F.lag("h1").over(per_key) == F.col("h1")) & (F.lag("h2").over(per_key) == F.col("h2"))
    marked = rows.join(series, "snap").select(
        "key", "snap", "no", "following", F.coalesce(near, F.lit(False)).alias("near"), (~F.coalesce(same, F.lit(False))).alias("starts")
    )
    islands = marked.withColumn("island", F.sum(F.col("starts").cast("int")).over(run))
    return islands.groupBy("key", "island").agg(
        F.min("snap").alias("first_snap"),
        F.max("snap").alias("last_snap"),
        F.max("no").alias("last_no"),
        F.min("no").alias("first_no"),
        F.max_by("following", "no").alias("next_snap"),
        F.max((F.col("starts") & F.col("near")).cast("int")).cast("boolean").alias("joined"),
    ).drop("island")


def snapshot_changes(snapshots: DataFrame, compare: dict[str, Column] | None = None, at: str = "snapshot_ms", key: str = "key", received: str = "received_ms") -> DataFrame:
    """``(snapshot_ms, key, change)``: added, removed or changed against the delivery before.

    Starts of validity intervals are additions, ends are removals, and where two
    intervals of a key are adjacent the record changed. ``compare`` names what
    makes a record another one: by default ``value`` exactly (null equals null
    only) and ``relevance`` rounded to four decimals. Rows sent twice and rows
    put right later don't show. An empty table, or a single delivery, gives no
    rows. Columns not needed aren't read.
    """
    compare = compare or {"value": F.col("value"), "relevance": F.round("relevance", 4)}
    spans = validity_intervals(snapshots, compare, at, key, received)
    follows = F.lead("first_no").over(Window.partitionBy("key").orderBy("first_no"))
    spans = spans.withColumn("gap_after", F.coalesce(follows != F.col("last_no") + 1, F.lit(True)))
    start = F.when(F.col("joined"), F.lit("changed")).when(F.col("first_no") > 1, F.lit("added"))
    end = F.when(F.col("gap_after") & F.col("next_snap").isNotNull(), F.lit("removed"))
    events = F.array(F.struct(F.col("first_snap").alias("snapshot_ms"), start.alias("change")), F.struct(F.col("next_snap").alias("snapshot_ms"), end.alias("change")))
    return (
        spans.select("key", F.explode(events).alias("e"))
        .where(F.col("e.change").isNotNull())
        .select("e.snapshot_ms", "key", "e.change")
    )
