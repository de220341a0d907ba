"""Triggers on namespaces: which hold, which may fire, and with what entries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.relevance import decayed
from ..schema import DEFAULT_COOLDOWN_MS
from .access import live
from .prefixes import prefix_pairs

KINDS = ("min_entries", "max_age", "match_count")


def _prefix(column: str = "key_prefix") -> Column:
    return F.coalesce(column, F.lit(""))


def _cutoff(as_of_ms: int) -> Column:
    return F.greatest(F.lit(as_of_ms) - F.col("max_age_ms"), F.lit(0)).cast("long")


def _matches(triggers: DataFrame, entries: DataFrame, as_of_ms: int) -> DataFrame:
    """Live entries that count for each trigger: its id with each of them.

    Prefixes meet the keys that begin with them by equality; a namespace meets its
    other triggers, which take all of it or the old ones.
    """
    rows = live(entries, as_of_ms)
    whole = triggers.where(F.col("kind") != "match_count").select("id", "namespace", F.when(F.col("kind") == "max_age", _cutoff(as_of_ms)).alias("__before"))
    old = rows.join(whole, "namespace").where(F.col("__before").isNull() | (F.col("created_at_ms") < F.col("__before"))).drop("__before")
    by_prefix = triggers.where(F.col("kind") == "match_count").groupBy("namespace", _prefix().alias("prefix")).agg(F.collect_list("id").alias("__ids"))
    some = prefix_pairs(rows, by_prefix).withColumn("id", F.explode("__ids"))
    return old.unionByName(some.select(*old.columns))


def counts(triggers: DataFrame, entries: DataFrame, as_of_ms: int) -> DataFrame:
    """``(id, matched, holds)`` of every trigger.

    Nothing is counted per trigger and entry: entries are counted per namespace, per
    namespace and prefix, and per namespace and the stretch between two of its
    triggers' ages in which they were created; triggers then add up what they cover.
    """
    rows = live(entries, as_of_ms)
    # a namespace's ages, sorted; an entry's place among them tells for which it is old enough
    aged = triggers.where(F.col("kind") == "max_age").select("id", "namespace", _cutoff(as_of_ms).alias("__before"))
    ages = aged.groupBy("namespace").agg(F.sort_array(F.collect_set("__before")).alias("__ages"))
    placed = rows.select("namespace", "created_at_ms").join(ages, "namespace", "left")
    place = F.when(F.col("__ages").isNotNull() & F.col("created_at_ms").isNotNull(), F.size(F.filter("__ages", lambda x: x <= F.col("created_at_ms"))))
    per_place = placed.groupBy("namespace", place.alias("__place")).agg(F.count(F.lit(1)).alias("n"))
    per_ns = per_place.groupBy("namespace").agg(F.sum("n").alias("matched"))
    all_places = ages.select("namespace", F.posexplode("__ages").alias("__place", "__before"))
    upto = F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy("namespace").orderBy("__place"))
    olds = all_places.join(per_place, ["namespace", "__place"], "left").select("namespace", "__before", upto.alias("matched"))
    prefixes = triggers.where(F.col("kind") == "match_count").select("namespace", _prefix().alias("prefix")).distinct()
    per_prefix = prefix_pairs(rows.select("namespace", "key"), prefixes).groupBy("namespace", "prefix").agg(F.count(F.lit(1)).alias("matched"))
    found = [
        triggers.where(F.col("kind") == "min_entries").select("id", "namespace").join(per_ns, "namespace", "left"),
        aged.join(olds, ["namespace", "__before"], "left"),
        triggers.where(F.col("kind") == "match_count").select("id", "namespace", _prefix().alias("prefix")).join(per_prefix, ["namespace", "prefix"], "left"),
    ]
    matched = reduce(DataFrame.unionByName, [x.select("id", F.coalesce("matched", F.lit(0)).cast("long").alias("matched")) for x in found])
    need = F.when(F.col("kind") == "max_age", F.lit(1)).otherwise(F.col("threshold"))
    return matched.join(triggers.select("id", "kind", "threshold"), "id").select("id", "matched", (F.col("matched") >= need).alias("holds"))


def can_fire(triggers: DataFrame, as_of_ms: int, force: bool = False) -> DataFrame:
    """Enabled triggers that are past their cooldown; ``force`` leaves the cooldown out, not the flag."""
    cool = F.col("last_fired_ms").isNull() | (F.lit(as_of_ms) >= F.col("last_fired_ms") + F.coalesce("cooldown_ms", F.lit(DEFAULT_COOLDOWN_MS)))
    return triggers.where(F.col("enabled") & cool if not force else F.col("enabled"))


def fire(triggers: DataFrame, entries: DataFrame, as_of_ms: int, force: bool = False) -> DataFrame:
    """``(id, namespace, matched)`` of the triggers that fire now."""
    ready = can_fire(triggers, as_of_ms, force)
    return counts(ready, entries, as_of_ms).where("holds").join(ready.select("id", "namespace"), "id").select("id", "namespace", "matched")


def matching_entries(triggers: DataFrame, entries: DataFrame, as_of_ms: int, force: bool = False) -> DataFrame:
    """What each firing trigger reports: all entries of its namespace, the old ones, or those below its prefix.

    Relevance is decayed without the boost of reads.
    """
    fired = fire(triggers, entries, as_of_ms, force).select("id")
    ready = can_fire(triggers, as_of_ms, force).join(fired, "id", "left_semi")
    score = decayed(F.col("relevance"), F.col("created_at_ms"), F.col("pinned"), as_of_ms)
    return _matches(ready, entries, as_of_ms).select("id", "namespace", "key", "value", "memory_type", score.alias("relevance"), "created_at_ms", "access_count")


def mark_fired(triggers: DataFrame, fired: DataFrame, as_of_ms: int) -> DataFrame:
    """The trigger table after firing."""
    now = fired.select("id", F.lit(as_of_ms).cast("long").alias("__now"))
    return triggers.join(now, "id", "left").withColumn("last_fired_ms", F.coalesce("__now", "last_fired_ms")).drop("__now")


def payloads(triggers: DataFrame, fired: DataFrame, as_of_ms: int, entries: DataFrame | None = None, part_entries: int = 1000) -> DataFrame:
    """``(id, action_type, url, payload)``: what an action of each fired trigger is given, as JSON.

    With ``entries`` (as ``matching_entries`` gives them) the payload lists them, and rows
    have ``headers`` of a webhook, ``part`` and ``parts``: a payload holds at most about
    ``part_entries`` entries, dealt by their keys, as a namespace may be large.
    """
    action = F.from_json("action", "struct<type:string,url:string,headers:map<string,string>>")
    met = triggers.join(fired.select("id", "matched"), "id")
    head = [F.col("id").alias("trigger_id"), F.col("namespace"), F.lit(as_of_ms).alias("fired_at_ms"), F.col("matched")]
    if entries is None:
        return met.select("id", action["type"].alias("action_type"), action["url"].alias("url"), F.to_json(F.struct(*head)).alias("payload"))
    parts = F.greatest(F.ceil(F.col("matched") / part_entries), F.lit(1)).cast("long")
    told = ["key", "value", "memory_type", "relevance", "created_at_ms", "access_count"]
    dealt = entries.join(met.select("id", parts.alias("parts")), "id").withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")))
    lists = dealt.groupBy("id", "part").agg(F.array_sort(F.collect_list(F.struct(*told))).alias("entries"))
    every = met.withColumns({"parts": parts, "part": F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))})
    body = F.to_json(F.struct(*head, F.coalesce("entries", F.array()).alias("entries")))
    out = every.join(lists, ["id", "part"], "left")
    return out.select("id", action["type"].alias("action_type"), action["url"].alias("url"), action["headers"].alias("headers"), "part", "parts", body.alias("payload"))


def contexts(triggers: DataFrame, entries: DataFrame, as_of_ms: int, force: bool = False) -> DataFrame:
    """What firing leaves behind: a row for each firing trigger and entry, ``(trigger_id, namespace, fired_at_ms, key, value, ...)``."""
    rows = matching_entries(triggers, entries, as_of_ms, force)
    return rows.select(F.col("id").alias("trigger_id"), "namespace", F.lit(as_of_ms).cast("long").alias("fired_at_ms"), *[c for c in rows.columns if c not in ("id", "namespace")])


class Registry:
    """Triggers by id: register, unregister, enable, disable, list. Small, and kept on the driver."""

    def __init__(self):
        self._rows: dict[str, dict] = {}

    def register(self, id: str, kind: str, namespace: str, threshold: int | None = None, max_age_ms: int | None = None, key_prefix: str | None = None, cooldown_ms: int = DEFAULT_COOLDOWN_MS, action: str = '{"type":"log"}', enabled: bool = True) -> None:
        if id in self._rows:
            raise ValueError(f"trigger {id!r} is there already")
        if kind not in KINDS or (kind == "max_age") != (max_age_ms is not None) or (kind != "max_age") != (threshold is not None):
            raise ValueError(f"{kind!r} with these conditions is no trigger")
        self._rows[id] = dict(id=id, kind=kind, namespace=namespace, threshold=threshold, max_age_ms=max_age_ms, key_prefix=key_prefix, enabled=enabled, cooldown_ms=cooldown_ms, last_fired_ms=None, action=action)

    def unregister(self, id: str) -> bool:
        return self._rows.pop(id, None) is not None

    def get(self, id: str) -> dict | None:
        return self._rows.get(id)

    def list(self) -> list[dict]:
        return [self._rows[i] for i in sorted(self._rows)]

    def set_enabled(self, id: str, enabled: bool) -> bool:
        if id in self._rows:
            self._rows[id]["enabled"] = enabled
        return id in self._rows

    def mark(self, ids: list[str], as_of_ms: int) -> None:
        for i in ids:
            self._rows[i]["last_fired_ms"] = as_of_ms

    def table(self, spark) -> DataFrame:
        from ..schema import TRIGGERS

        return spark.createDataFrame([tuple(r.values()) for r in self._rows.values()], TRIGGERS)
