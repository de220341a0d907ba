"""Continuous maintenance with Structured Streaming.

The log is the source of truth: a batch adds its operations to it, then only the
state of keys that the batch touches is worked out anew. Operations count by
their number, so late, repeated and disordered ones, and batches that run again
after a failure, change nothing but what they must.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.keys import is_live
from ..functions.relevance import DEFAULT, Decay
from ..operators import replay, triggers
from ..operators import consolidate
from ..schema import ENTRIES, LOG
from ..session import materialize
from ..sources import snapshot

BUCKETS = 64
ENTRIES_BY_BUCKET = T.StructType([*ENTRIES.fields, T.StructField("bucket", T.IntegerType())])


def read_log(spark: SparkSession, path: str, staging: str | None = None, files_per_batch: int = 4) -> DataFrame:
    """The log as a stream of new files below a folder.

    A stream reads folders; a log that is one file is first dealt into several
    files below ``staging``.
    """
    if staging:
        spark.read.parquet(path).repartition(8, "seq").write.mode("overwrite").parquet(staging)
        path = staging
    return spark.readStream.schema(LOG).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def _bucket(column: str = "namespace"):
    return F.pmod(F.xxhash64(column), F.lit(BUCKETS)).cast("int")


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def replay_stream(log: DataFrame, root: str, checkpoint: str, decay: Decay = DEFAULT) -> StreamingQuery:
    """Keep ``root/state`` up to date with the log, which is kept in ``root/log`` by batch.

    A batch rewrites its own part of the log, so a batch that runs twice adds
    nothing. Log and state are split into buckets of namespaces, and deletions by
    prefix stay within one. Operations that follow all earlier ones of their bucket are
    applied to its state as it is. Buckets in which operations come late, and those of a
    batch that runs again after a failure, are worked out anew from the log.
    """
    log_path, state_path, marks_path = f"{root}/log", f"{root}/state", f"{root}/marks"
    names = [f.name for f in LOG.fields]

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        again = _exists(spark, f"{log_path}/batch={number}")
        rows.withColumn("bucket", _bucket()).write.mode("overwrite").parquet(f"{log_path}/batch={number}")
        fresh = spark.read.parquet(f"{log_path}/batch={number}")
        everything = fresh.where(F.col("op") == "clear").limit(1).count() > 0
        touched = set(range(BUCKETS)) if everything else {r["bucket"] for r in fresh.select("bucket").distinct().collect()}
        earlier = [i for i in range(number) if _exists(spark, f"{log_path}/batch={i}")]
        history = spark.read.parquet(*[f"{log_path}/batch={i}" for i in (*earlier, number)])
        anew = set(touched) if again or everything else set()
        news = fresh
        if earlier and not (again or everything):
            # the highest number of each bucket so far: a few rows per batch
            marks = {r["bucket"]: r["m"] for r in spark.read.parquet(*[f"{marks_path}/batch={i}" for i in earlier]).groupBy("bucket").agg(F.max("top").alias("m")).collect()}
            top = F.coalesce(F.create_map(*[F.lit(x) for pair in marks.items() for x in pair])[F.col("bucket")], F.lit(-1)) if marks else F.lit(-1)
            before = fresh.where(F.col("seq") <= top)
            known = spark.read.parquet(*[f"{log_path}/batch={i}" for i in earlier]).where(F.col("bucket").isin(list(touched))).select("seq")
            late = before.join(known, "seq", "left_anti")
            anew = {r["bucket"] for r in late.select("bucket").distinct().collect()}
            news = fresh.where(F.col("seq") > top)
        follow = touched - anew
        parts = []
        if anew:
            # a clear has no namespace and concerns every bucket
            mine = history.where(F.col("bucket").isin(list(anew)) | (F.col("op") == "clear")).select(*names)
            parts.append(replay.replay(mine, decay=decay).withColumn("bucket", _bucket()).where(F.col("bucket").isin(list(anew))))
        if follow:
            held = spark.read.schema(ENTRIES_BY_BUCKET).parquet(state_path).where(F.col("bucket").isin(list(follow))) if _exists(spark, state_path) else None
            mine = news.where(F.col("bucket").isin(list(follow))).select(*names)
            parts.append(replay.replay(mine, base=None if held is None else held.select(*replay.STATE_COLUMNS), decay=decay).withColumn("bucket", _bucket()))
        state = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        if parts:
            # the state is read and written in one place
            _replace_buckets(materialize(state, "stream-state"), state_path, list(touched))
        fresh.groupBy("bucket").agg(F.max("seq").alias("top")).coalesce(1).write.mode("overwrite").parquet(f"{marks_path}/batch={number}")

    return log.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _replace_buckets(state: DataFrame, path: str, touched: list[int]) -> None:
    """Write the touched buckets anew; a bucket whose keys are all gone ends up empty."""
    spark = state.sparkSession
    state.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    left = {r["bucket"] for r in state.select("bucket").distinct().collect()}
    for bucket in set(touched) - left:
        target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/bucket={bucket}")
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def read_state(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(ENTRIES).parquet(f"{root}/state").select(*replay.STATE_COLUMNS)


def count_stream(log: DataFrame, path: str, checkpoint: str, window: str = "1 day", lateness: str | None = None) -> StreamingQuery:
    """Operations per namespace, kind and window of event time.

    Repeated deliveries are dropped by number. All operations count, however late
    they come, and the numbers seen are kept as state; with ``lateness`` these are let
    go once the watermark has passed, and operations further behind the newest may be
    left out. Each batch
    writes the counts so far; the last one written holds.
    """
    rows = log.where(F.col("namespace").isNotNull()).withColumn("at", F.timestamp_millis("ts_ms"))
    rows = rows.withWatermark("at", lateness).dropDuplicatesWithinWatermark(["seq"]) if lateness else rows.dropDuplicates(["seq"])
    counts = rows.groupBy("namespace", "op", F.window("at", window)).agg(F.count(F.lit(1)).alias("n"))
    shaped = counts.select("namespace", "op", F.unix_millis("window.start").alias("day_ms"), "n")

    def batch(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(path)

    return shaped.writeStream.outputMode("complete").foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def last_op_stream(log: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """The last operation of each key, by a stateful operator that keeps one number and kind per key."""
    rows = log.where(F.col("namespace").isNotNull() & F.col("key").isNotNull() & (F.col("op") != "delete_prefix"))

    def latest(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seq, op = state.get if state.exists else (-1, "")
        for batch in batches:
            best = batch.loc[batch["seq"].idxmax()]
            if int(best["seq"]) > seq:
                seq, op = int(best["seq"]), str(best["op"])
        state.update((seq, op))
        yield pd.DataFrame({"namespace": [key[0]], "key": [key[1]], "seq": [seq], "op": [op]})

    out = rows.groupBy("namespace", "key").applyInPandasWithState(latest, "namespace string, key string, seq long, op string", "seq long, op string", "update", GroupStateTimeout.NoTimeout)

    def batch(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return out.writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def trigger_stream(log: DataFrame, root: str, checkpoint: str, registry: triggers.Registry, act: Callable[[DataFrame, int], None], clock: Callable[[DataFrame], int]) -> StreamingQuery:
    """After each batch of the log, fire the triggers that hold on the state below ``root``.

    ``act`` gets what fired and the entries that go with it; ``clock`` tells the
    time a batch is as of. Cooldowns are kept in the registry.
    """

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        if not rows.limit(1).count():
            return
        now, table, state = clock(rows), registry.table(spark), read_state(spark, root)
        fired = triggers.fire(table, state, now).toPandas()  # at most the registry's triggers
        if len(fired):
            act(triggers.matching_entries(table, state, now), now)
            registry.mark(fired["id"].tolist(), now)

    return log.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def expiry_sweep(spark: SparkSession, root: str, as_of_ms: int) -> int:
    """Drop expired entries from the streamed state; gives how many went."""
    state = spark.read.parquet(f"{root}/state")
    gone = state.where(~is_live(F.col("expires_at_ms"), as_of_ms))
    touched = [r["bucket"] for r in gone.select("bucket").distinct().collect()]
    n = gone.count()
    if touched:
        _replace_buckets(materialize(state.where(F.col("bucket").isin(touched) & is_live(F.col("expires_at_ms"), as_of_ms)), "sweep"), f"{root}/state", touched)
    return n


def consolidation_sweep(spark: SparkSession, root: str, rules: list, as_of_ms: int, **limits) -> DataFrame:
    """Run the rules over the streamed state of all namespaces and write it back; gives the report."""
    state, report = consolidate.run_rules(read_state(spark, root), rules, as_of_ms, **limits)
    _replace_buckets(materialize(state.withColumn("bucket", _bucket()), "consolidated"), f"{root}/state", list(range(BUCKETS)))
    return report


def snapshot_sweep(spark: SparkSession, root: str, target: str, as_of_ms: int, keep: int = 3) -> str:
    """Write a snapshot of the streamed state and delete all but the newest; gives its path."""
    path = snapshot.write_snapshot(read_state(spark, root), target, as_of_ms)
    snapshot.prune_snapshots(spark, target, keep)
    return path


def run_every(spark: SparkSession, interval: str, task: Callable[[int], None], checkpoint: str, once: bool = False) -> StreamingQuery:
    """Call ``task`` with a running number at each ``interval``, as a stream that can be stopped and goes on after a restart.

    This is the loop for sweeps: expiry, consolidation, triggers and snapshots.
    """
    ticks = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).load()
    writer = ticks.writeStream.foreachBatch(lambda _, number: task(number)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()
