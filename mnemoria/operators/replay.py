"""State from the operation log: an ordered fold per key, cut to what still matters first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import is_live
from ..functions.relevance import DEFAULT, HOUR_MS, Decay, clamp
from ..session import materialize
from .hotfold import fold_in_parts
from .prefixes import prefix_pairs
from .skew import heavy_hashes, skewed_lookup

#: Numbers of the log that one part of a hot key's operations spans.
PART_WIDTH = 1 << 16
#: A read within this time of the last counted one doesn't count.
TOUCH_MS = 1000
STATE_COLUMNS = ["namespace", "key", "value", "memory_type", "expires_at_ms", "embedding", "last_accessed_ms", "relevance", "created_at_ms", "access_count", "pinned"]


def distinct_ops(ops: DataFrame, as_of_ms: int | None = None, up_to_seq: int | None = None) -> DataFrame:
    """Each operation once, however often it was delivered, up to a time or number."""
    if as_of_ms is not None:
        ops = ops.where(F.col("ts_ms") <= as_of_ms)
    if up_to_seq is not None:
        ops = ops.where(F.col("seq") <= up_to_seq)
    return ops.dropDuplicates(["seq"])


def wal_tail(ops: DataFrame, from_seq: int) -> DataFrame:
    return ops.where(F.col("seq") >= from_seq).dropDuplicates(["seq"])


def retain_last(ops: DataFrame, n: int) -> DataFrame:
    """The newest ``n`` operations, as a ring of that size keeps them.

    Numbers are consecutive, but for gaps; the boundary is found by counting
    per range of numbers, so the log isn't sorted in one task.
    """
    ids = ops.select("seq").distinct()
    width = 1 << 16
    per = ids.groupBy((F.col("seq") / width).cast("long").alias("range")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("range")).toLocalIterator()
    seen = 0
    for row in per:
        if seen + row["n"] >= n:
            low = ids.where((F.col("seq") / width).cast("long") == row["range"]).orderBy(F.desc("seq")).limit(n - seen).agg(F.min("seq")).first()[0]
            return wal_tail(ops, low) if low is not None else ops.limit(0)
        seen += row["n"]
    return ops.dropDuplicates(["seq"])


def cutoffs(ops: DataFrame) -> DataFrame:
    """``(namespace, key, cut)``: the last deletion that reaches each key, directly, by a prefix or by a clear.

    What comes before has no bearing on the state, so it is never folded. All
    three are maxima, which combine on the map side however hot a key is.
    """
    cleared = ops.where(F.col("op") == "clear").agg(F.max("seq")).first()[0]
    keys = ops.where(F.col("key").isNotNull() & ~F.col("op").isin("clear", "delete_prefix")).groupBy("namespace", "key").agg(F.max(F.when(F.col("op") == "delete", F.col("seq"))).alias("direct"))
    prefixes = ops.where(F.col("op") == "delete_prefix").groupBy("namespace", F.coalesce("key", F.lit("")).alias("prefix")).agg(F.max("seq").alias("by_prefix"))
    hit = prefix_pairs(keys.select("namespace", "key"), prefixes).groupBy("namespace", "key").agg(F.max("by_prefix").alias("by_prefix"))
    return keys.join(hit, ["namespace", "key"], "left").select("namespace", "key", F.greatest(F.coalesce("direct", F.lit(-1)), F.coalesce("by_prefix", F.lit(-1)), F.lit(-1 if cleared is None else cleared)).alias("cut"))


_BASE = {"expires_at_ms": "long", "last_accessed_ms": "long", "relevance": "double", "created_at_ms": "long", "access_count": "long", "pinned": "boolean"}
_HELD = "there boolean, set_seq long, exp long, last long, rel double, created long, reads long, pinned boolean"


def _step(decay: Decay, rebase_on_write: bool):
    """State after one more operation, as columns."""

    def state(s: Column | None = None, **parts: Column) -> Column:
        names = [x.split() for x in _HELD.split(", ")]
        return F.struct(*[(parts[n] if n in parts else s[n] if s is not None else F.lit(None)).cast(t).alias(n) for n, t in names])

    def step(s: Column, x: Column) -> Column:
        ts = x["ts_ms"]
        live = s["there"] & (s["exp"].isNull() | (ts < s["exp"]))
        exp = F.when(x["ttl_ms"].isNotNull(), ts + x["ttl_ms"])
        new = state(there=F.lit(True), set_seq=x["seq"], exp=exp, last=ts, rel=F.lit(1.0), created=ts, reads=F.lit(0), pinned=F.lit(False))
        age = F.greatest(F.lit(0.0), (ts - s["created"]) / HOUR_MS)
        boosted = F.least(F.lit(1.0), clamp(s["rel"] * F.exp(-decay.rate * age)) + F.lit(decay.write_boost))
        again = state(s, set_seq=x["seq"], exp=exp, last=ts, rel=F.when(s["pinned"], 1.0).otherwise(boosted), reads=s["reads"] + 1, created=ts if rebase_on_write else s["created"])
        counted = (x["op"] == "read") & (ts - s["last"] > TOUCH_MS)
        touched = state(
            s,
            pinned=F.when(x["op"] == "pin", True).when(x["op"] == "unpin", False).otherwise(s["pinned"]), rel=F.when(x["op"] == "pin", 1.0).otherwise(s["rel"]),
            reads=s["reads"] + counted.cast("long"), last=F.when(counted, ts).otherwise(s["last"]),
        )
        base = state(there=F.lit(True), exp=x["expires_at_ms"], last=x["last_accessed_ms"], rel=x["relevance"], created=x["created_at_ms"], reads=x["access_count"], pinned=x["pinned"])
        # a touch of an expired entry removes it
        return F.when(x["op"] == "base", base).when(x["op"] == "set", F.when(live, again).otherwise(new)).when(live, touched).otherwise(state(s, there=F.lit(False)))

    return step, state(there=F.lit(False))


def _fold(kept: DataFrame, decay: Decay, rebase_on_write: bool) -> DataFrame:
    """State of each key from its operations in order, folded inside the engine; a key here has a small share of all rows."""
    step, begin = _step(decay, rebase_on_write)
    ops = F.array_sort(F.collect_list(F.struct("seq", "op", "ts_ms", "ttl_ms", *_BASE)))
    done = kept.groupBy("namespace", "key").agg(ops.alias("ops")).select("namespace", "key", F.aggregate("ops", begin, step).alias("s")).where("s.there")
    return done.select("namespace", "key", "s.set_seq", F.col("s.exp").alias("expires_at_ms"), F.col("s.last").alias("last_accessed_ms"), F.col("s.rel").alias("relevance"), F.col("s.created").alias("created_at_ms"), F.col("s.reads").alias("access_count"), "s.pinned")


def replay_parts(ops: DataFrame, as_of_ms: int | None = None, up_to_seq: int | None = None, base: DataFrame | None = None, decay: Decay = DEFAULT, rebase_on_write: bool = False, hot_share: float | None = None, part_width: int = PART_WIDTH) -> tuple[DataFrame, DataFrame | None]:
    """State (``STATE_COLUMNS``) after the log, on top of a ``base`` state if given, in two parts: keys that the log touches, and the rest of the base.

    Operations count once and in the order of ``seq``, whatever order they come
    in. A set on a live key keeps creation, pin and reads and boosts the decayed
    score; by default decay runs from the creation time also after an update,
    ``rebase_on_write`` lets it run from the update. Expired entries are kept
    here: a read of the result filters them by its own time. An empty log gives
    the base, or nothing.

    Without values the log is narrow: it is made distinct and written once, and values
    and embeddings are looked up by the number of the set that holds. A key's
    operations since its last deletion are folded in order inside the engine; keys with
    at least ``hot_share`` of them (by default what one partition holds) are folded in
    parts of ``part_width`` numbers, side by side (``hotfold``). Keys of the base that
    the log doesn't touch pass by.
    """
    narrow = distinct_ops(ops.select("seq", "op", "namespace", "key", "ts_ms", F.nullif("ttl_ms", F.lit(0)).alias("ttl_ms")), as_of_ms, up_to_seq)
    log = materialize(narrow, "replay-log")
    cut = materialize(cutoffs(log), "replay-cuts")
    kept = log.where(F.col("op").isin("set", "pin", "unpin", "read") & F.col("namespace").isNotNull() & F.col("key").isNotNull()).select("namespace", "key", "seq", "op", "ts_ms", "ttl_ms")
    # most keys are never deleted: only those that are have a number to look up
    deep = cut.where(F.col("cut") >= 0)
    kept = skewed_lookup(kept, deep, ["namespace", "key"], "left").where(F.col("cut").isNull() | (F.col("seq") > F.col("cut"))).drop("cut")
    kept = kept.withColumns({n: F.lit(None).cast(t) for n, t in _BASE.items()})
    rest = None
    if base is not None:
        cleared = log.where(F.col("op") == "clear").limit(1).count() > 0
        prefixes = log.where(F.col("op") == "delete_prefix").select("namespace", F.col("key").alias("key_prefix"))
        from .mutate import delete_prefixes

        base = base.select(*STATE_COLUMNS)
        base = base.limit(0) if cleared else delete_prefixes(base.join(deep.select("namespace", "key"), ["namespace", "key"], "left_anti"), prefixes)
        touched = kept.select("namespace", "key").distinct()
        rest, base = base.join(touched, ["namespace", "key"], "left_anti"), base.join(touched, ["namespace", "key"], "left_semi")
        first = base.select("namespace", "key", F.lit(-1).cast("long").alias("seq"), F.lit("base").alias("op"), F.lit(None).cast("long").alias("ts_ms"), F.lit(None).cast("long").alias("ttl_ms"), *_BASE)
        kept = kept.unionByName(first)
    kept = materialize(kept, "replay-ops")
    hot = list(heavy_hashes(kept, ["namespace", "key"], hot_share)[0])
    is_hot = F.xxhash64("namespace", "key").isin(hot) if hot else F.lit(False)
    folded = _fold(kept.where(~is_hot), decay, rebase_on_write)
    if hot:
        folded = folded.unionByName(fold_in_parts(kept.where(is_hot), decay, TOUCH_MS, rebase_on_write, part_width))
    values = ops.where(F.col("op") == "set").select(F.col("seq").alias("set_seq"), "value", "memory_type", "embedding")
    # a set that was delivered twice meets its key twice
    if base is None:
        return folded.join(values, "set_seq").dropDuplicates(["set_seq"]).select(*STATE_COLUMNS), None
    old = base.select("namespace", "key", F.col("value").alias("__v"), F.col("memory_type").alias("__t"), F.col("embedding").alias("__e"))
    out = folded.join(values, "set_seq", "left").dropDuplicates(["namespace", "key"]).join(old, ["namespace", "key"], "left")
    fresh = F.col("set_seq").isNotNull()
    return out.withColumns({n: F.when(fresh, F.col(n)).otherwise(F.col(o)) for n, o in (("value", "__v"), ("memory_type", "__t"), ("embedding", "__e"))}).select(*STATE_COLUMNS), rest


def replay(ops: DataFrame, *args, **named) -> DataFrame:
    """State (``STATE_COLUMNS``) after the log: what ``replay_parts`` gives, put together."""
    changed, rest = replay_parts(ops, *args, **named)
    return changed if rest is None else changed.unionByName(rest)


def last_writes(ops: DataFrame, as_of_ms: int | None = None) -> DataFrame:
    """``(namespace, key, value, memory_type, expires_at_ms)`` by the last set after the last deletion, live at ``as_of_ms`` if given.

    What a replica keeps that applies sets and deletions only. It needs no fold:
    everything is a maximum.
    """
    log = ops if as_of_ms is None else ops.where(F.col("ts_ms") <= as_of_ms)
    # maxima don't mind repeated deliveries, so nothing is made distinct; a key's last set is after its last deletion or it isn't
    sets = log.where((F.col("op") == "set") & F.col("key").isNotNull()).groupBy("namespace", "key").agg(F.max_by(F.struct("seq", "value", "memory_type", "ts_ms", "ttl_ms"), "seq").alias("w"))
    last = sets.join(cutoffs(log), ["namespace", "key"]).where(F.col("w.seq") > F.col("cut"))
    out = last.select("namespace", "key", "w.value", "w.memory_type", (F.col("w.ts_ms") + F.nullif("w.ttl_ms", F.lit(0))).alias("expires_at_ms"))
    return out if as_of_ms is None else out.where(is_live(F.col("expires_at_ms"), as_of_ms))


def op_metrics(ops: DataFrame) -> DataFrame:
    """``(namespace, op, n, first_ts_ms, last_ts_ms)`` of operations delivered once or more."""
    return ops.dropDuplicates(["seq"]).groupBy("namespace", "op").agg(F.count(F.lit(1)).alias("n"), F.min("ts_ms").alias("first_ts_ms"), F.max("ts_ms").alias("last_ts_ms"))
