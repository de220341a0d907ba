"""Consolidation: promote repeated episodes to facts, compress episodes into summaries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import first_segment
from ..session import materialize
from . import capacity as limits
from .access import live

REPORT = "namespace string, action string, source string, target string, occurrences long, outcome string"


@dataclass(frozen=True)
class Promote:
    """Groups of at least ``min_occurrences`` episodes below ``key_prefix`` become ``fact:{group}``."""

    description: str = ""
    min_occurrences: int = 3
    lookback_secs: int | None = None
    key_prefix: str = "event:"
    target_type: str = "semantic"
    conflict_policy: str = "skip"

    def __post_init__(self):
        if self.conflict_policy not in ("skip", "overwrite", "version"):
            raise ValueError(f"unknown conflict policy {self.conflict_policy!r}")


@dataclass(frozen=True)
class Compress:
    """Groups of at least ``min_episodes`` episodes become one summary."""

    description: str = ""
    min_episodes: int = 5
    group_by: str = "key_prefix"
    summary_strategy: str = "concat"
    target_key: str = "summary:{prefix}"
    target_type: str = "semantic"
    delete_source: bool = True
    summarise: Callable[[list[str]], str] | None = field(default=None, compare=False)

    def __post_init__(self):
        if self.summary_strategy not in ("concat", "dedupe", "llm") or self.group_by not in ("key_prefix", "all"):
            raise ValueError("unknown summary strategy or grouping")


def _episodes(entries: DataFrame, as_of_ms: int) -> DataFrame:
    return live(entries, as_of_ms).where(F.col("memory_type") == "episodic")


def promote_groups(entries: DataFrame, rule: Promote, as_of_ms: int) -> DataFrame:
    """``(namespace, grp, occurrences, value)`` of the groups a rule takes; the value is that of the last key."""
    rows = _episodes(entries, as_of_ms).where(F.col("key").startswith(rule.key_prefix))
    group = first_segment(F.substring(F.col("key"), len(rule.key_prefix) + 1, 1 << 30))
    found = rows.groupBy("namespace", group.alias("grp")).agg(F.count(F.lit(1)).alias("occurrences"), F.max_by(F.struct("value"), "key").alias("last"))
    return found.where(F.col("occurrences") >= rule.min_occurrences).select("namespace", "grp", "occurrences", F.col("last.value").alias("value"))


def promote(entries: DataFrame, rule: Promote, as_of_ms: int) -> DataFrame:
    """``(namespace, grp, occurrences, value, target, outcome)``: what a rule does with each group.

    Only an existing *semantic* fact is a conflict; any other entry under the
    target key is overwritten. ``version`` takes the smallest free number from 2.
    """
    groups = materialize(promote_groups(entries, rule, as_of_ms).withColumn("target", F.concat(F.lit("fact:"), F.col("grp"))), "promote-groups")
    there = live(entries, as_of_ms).where(F.col("key").startswith("fact:")).select("namespace", F.col("key").alias("target"), F.col("memory_type").alias("__type"))
    met = groups.join(there, ["namespace", "target"], "left").withColumn("conflict", F.coalesce(F.col("__type") == "semantic", F.lit(False))).drop("__type")
    if rule.conflict_policy == "version":
        # read twice: by the groups and by the search for free numbers
        met = materialize(met, "promote-met")
    if rule.conflict_policy == "skip":
        return met.select("namespace", "grp", "occurrences", "value", "target", F.when(F.col("conflict"), F.lit("skipped")).otherwise(F.lit("promoted")).alias("outcome"))
    if rule.conflict_policy == "version":
        free = free_versions(met.where("conflict").select("namespace", "target"), there.select("namespace", F.col("target").alias("taken")))
        met = met.join(free, ["namespace", "target"], "left")
        met = met.withColumn("target", F.when(F.col("conflict"), F.concat("target", F.lit("_v"), F.col("version"))).otherwise(F.col("target")))
    return met.select("namespace", "grp", "occurrences", "value", "target", F.lit("promoted").alias("outcome"))


def free_versions(targets: DataFrame, taken: DataFrame) -> DataFrame:
    """``(namespace, target, version)``: the smallest number from 2 whose ``{target}_v{n}`` isn't taken.

    Taken numbers are ranked; the first that isn't equal to its rank plus one
    shows a gap below it, so nothing is tried one after another.
    """
    parts = taken.withColumns({"target": F.regexp_extract("taken", r"^(.*)_v(?:[2-9]|[1-9][0-9]+)$", 1), "n": F.regexp_extract("taken", r"_v([0-9]+)$", 1).try_cast("decimal(38,0)")}).where((F.col("target") != "") & F.col("n").isNotNull())
    used = parts.join(targets, ["namespace", "target"], "left_semi").select("namespace", "target", "n").distinct()
    place = F.row_number().over(Window.partitionBy("namespace", "target").orderBy("n")) + 1
    runs = used.withColumn("place", place).where(F.col("n") == F.col("place")).groupBy("namespace", "target").agg(F.max("n").alias("top"))
    return targets.join(runs, ["namespace", "target"], "left").select("namespace", "target", (F.coalesce(F.col("top").cast("long"), F.lit(1)) + 1).alias("version"))


def promote_sources(entries: DataFrame, rule: Promote, outcome: DataFrame, as_of_ms: int) -> DataFrame:
    """``(namespace, key)`` of the episodes that a promotion deletes."""
    rows = _episodes(entries, as_of_ms).where(F.col("key").startswith(rule.key_prefix))
    group = first_segment(F.substring(F.col("key"), len(rule.key_prefix) + 1, 1 << 30))
    done = outcome.where(F.col("outcome") == "promoted").select("namespace", "grp")
    return rows.select("namespace", "key", group.alias("grp")).join(done, ["namespace", "grp"], "left_semi").select("namespace", "key")


def _group_of(rule: Compress) -> Column:
    return first_segment(F.col("key")) if rule.group_by == "key_prefix" else F.lit("__all__")


def compress_groups(entries: DataFrame, rule: Compress, as_of_ms: int) -> DataFrame:
    """``(namespace, grp, occurrences, value)``: the summary of each group that is large enough.

    ``concat`` joins distinct values by line ends, in the order of the first key
    that has them; ``dedupe`` joins distinct values by "; ", in their own order.
    Values are made distinct by partial aggregation before any group is put
    together. A summary holds its whole group, as the rule defines it.
    """
    rows = _episodes(entries, as_of_ms).withColumn("grp", _group_of(rule))
    sizes = rows.groupBy("namespace", "grp").agg(F.count(F.lit(1)).alias("occurrences")).where(F.col("occurrences") >= rule.min_episodes)
    values = rows.where(F.col("value").isNotNull()).groupBy("namespace", "grp", "value").agg(F.min("key").alias("first_key"))
    values = values.join(sizes.select("namespace", "grp"), ["namespace", "grp"], "left_semi")
    if rule.summary_strategy == "llm" and rule.summarise:
        summaries = values.groupBy("namespace", "grp").applyInPandas(_summarise_with(rule.summarise), "namespace string, grp string, value string")
    elif rule.summary_strategy == "dedupe":
        summaries = values.groupBy("namespace", "grp").agg(F.array_join(F.array_sort(F.collect_list("value")), "; ").alias("value"))
    else:
        listed = F.array_sort(F.collect_list(F.struct("first_key", "value")))
        summaries = values.groupBy("namespace", "grp").agg(F.array_join(F.transform(listed, lambda x: x["value"]), "\n").alias("value"))
    return sizes.join(summaries, ["namespace", "grp"], "left").select("namespace", "grp", "occurrences", F.coalesce("value", F.lit("")).alias("value"))


def _summarise_with(summarise: Callable[[list[str]], str]):
    def one(group: pd.DataFrame) -> pd.DataFrame:
        values = group.sort_values("first_key")["value"].tolist()
        try:
            text = summarise(values) or "\n".join(values)
        except Exception:  # noqa: BLE001 - any failure of the model means the plain summary
            text = "\n".join(values)
        return pd.DataFrame({"namespace": group["namespace"].iloc[:1], "grp": group["grp"].iloc[:1], "value": [text]})

    return one


def compress(entries: DataFrame, rule: Compress, as_of_ms: int) -> DataFrame:
    """``(namespace, grp, occurrences, value, target, outcome)`` of each summary."""
    target = F.replace(F.lit(rule.target_key), F.lit("{prefix}"), F.col("grp"))
    return compress_groups(entries, rule, as_of_ms).select("namespace", "grp", "occurrences", "value", target.alias("target"), F.lit("compressed").alias("outcome"))


def compress_sources(entries: DataFrame, rule: Compress, outcome: DataFrame, as_of_ms: int) -> DataFrame:
    rows = _episodes(entries, as_of_ms).select("namespace", "key", _group_of(rule).alias("grp"))
    outcome = outcome.where(F.col("outcome") != "failed")
    kept = outcome.select("namespace", "grp", F.col("target").alias("key"))
    return rows.join(outcome.select("namespace", "grp"), ["namespace", "grp"], "left_semi").join(kept, ["namespace", "grp", "key"], "left_anti").select("namespace", "key")


def report(outcome: DataFrame, action: str) -> DataFrame:
    """Report rows of one rule: ``REPORT``."""
    return outcome.select("namespace", F.lit(action).alias("action"), F.col("grp").alias("source"), "target", "occurrences", "outcome")


def report_totals(reports: DataFrame) -> DataFrame:
    """``(namespace, promoted, compressed, skipped, failed)``."""
    n = lambda what: F.count(F.when(F.col("outcome") == what, 1)).alias(what)
    return reports.groupBy("namespace").agg(n("promoted"), n("compressed"), n("skipped"), n("failed"))


def accumulate_meta(history: DataFrame) -> DataFrame:
    """Last run and running totals per namespace, from totals with ``run_ms``."""
    return history.groupBy("namespace").agg(F.max("run_ms").alias("last_run_ms"), *[F.sum(c).alias(f"total_{c}") for c in ("promoted", "compressed", "skipped", "failed")])


def refuse_over_capacity(state: DataFrame, outcome: DataFrame, capacity: int, shard: Column, as_of_ms: int, policy: limits.Policy = limits.Policy.REJECT) -> DataFrame:
    """``outcome`` where targets that find no room in their shard have ``failed``, in the order of namespace and target.

    A failed group is left as it is: its sources stay. Keys that exist always have room.
    """
    writes = outcome.where(F.col("outcome") != "skipped").select("namespace", F.col("target").alias("key"), F.xxhash64("namespace", "target").alias("seq"))
    kept = limits.admit(state, writes, capacity, shard, as_of_ms, policy).where("accepted").select("namespace", F.col("key").alias("target"), F.lit(True).alias("__kept")).distinct()
    met = outcome.join(kept, ["namespace", "target"], "left")
    fails = (F.col("outcome") != "skipped") & F.col("__kept").isNull()
    return met.withColumn("outcome", F.when(fails, F.lit("failed")).otherwise(F.col("outcome"))).select(*outcome.columns)


def _written(entries: DataFrame, outcome: DataFrame, target_type: str, as_of_ms: int) -> DataFrame:
    """Entries that targets become: an update keeps creation, pin and counts and is boosted, a new one starts afresh."""
    from ..functions.relevance import DEFAULT, boosted, decayed

    new = outcome.where(~F.col("outcome").isin("skipped", "failed")).select("namespace", F.col("target").alias("key"), F.col("value").alias("__value"))
    new = new.groupBy("namespace", "key").agg(F.max("__value").alias("__value"))
    old = live(entries, as_of_ms).select("namespace", "key", "relevance", "created_at_ms", "access_count", "pinned", F.lit(True).alias("__there"))
    met = new.join(old, ["namespace", "key"], "left")
    there = F.coalesce("__there", F.lit(False))
    again = boosted(decayed(F.col("relevance"), F.col("created_at_ms"), F.col("pinned"), as_of_ms), F.col("pinned"), DEFAULT.write_boost)
    return met.select(
        "namespace", "key", F.col("__value").alias("value"), F.lit(target_type).alias("memory_type"), F.lit(None).cast("long").alias("expires_at_ms"), F.lit(None).cast("array<float>").alias("embedding"), F.lit(as_of_ms).cast("long").alias("last_accessed_ms"),
        F.when(there, again).otherwise(F.lit(1.0)).alias("relevance"), F.when(there, F.col("created_at_ms")).otherwise(F.lit(as_of_ms)).cast("long").alias("created_at_ms"), F.when(there, F.col("access_count") + 1).otherwise(F.lit(0)).cast("long").alias("access_count"), F.when(there, F.col("pinned")).otherwise(F.lit(False)).alias("pinned"),
    )


def run_rules(entries: DataFrame, rules: list[Promote | Compress], as_of_ms: int, capacity: int | None = None, shard: Column | None = None, policy: limits.Policy = limits.Policy.REJECT) -> tuple[DataFrame, DataFrame]:
    """State and report after all rules, in order, over all namespaces at once.

    With a ``capacity`` per ``shard`` a target that finds no room fails and its group stays.

    Each rule sees what the ones before it wrote; the state between rules is
    written out, so the plan doesn't grow with the number of rules.
    """
    names = ["namespace", "key", "value", "memory_type", "expires_at_ms", "embedding", "last_accessed_ms", "relevance", "created_at_ms", "access_count", "pinned"]
    state, reports = entries.select(*names), None

    def guarded(held: DataFrame, outcome: DataFrame) -> DataFrame:
        return outcome if capacity is None else refuse_over_capacity(held, materialize(outcome, "rule"), capacity, shard, as_of_ms, policy)

    for rule in rules:
        if isinstance(rule, Promote):
            outcome, action = materialize(guarded(state, promote(state, rule, as_of_ms)), "rule"), "promote"
            gone = promote_sources(state, rule, outcome, as_of_ms)
        else:
            outcome, action = materialize(guarded(state, compress(state, rule, as_of_ms)), "rule"), "compress"
            gone = compress_sources(state, rule, outcome, as_of_ms) if rule.delete_source else None
        written = _written(state, outcome, rule.target_type, as_of_ms)
        rest = state if gone is None else state.join(gone, ["namespace", "key"], "left_anti")
        rest = rest.join(written.select("namespace", "key"), ["namespace", "key"], "left_anti")
        state = materialize(rest.select(*names).unionByName(written.select(*names)), "state")
        rows = report(outcome, action)
        reports = rows if reports is None else reports.unionByName(rows)
    if reports is None:
        reports = entries.sparkSession.createDataFrame([], REPORT)
    return state, reports
