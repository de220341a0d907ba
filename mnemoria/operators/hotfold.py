"""The fold of the log for hot keys: parts of a key's operations folded side by side, then joined in order.

The fold as it stands needs the state before. Cut into parts that begin at a
set, it becomes a function of little: whether the entry was there, since when,
whether it was pinned, and its score, which a run of sets turns by
``min(c, a * score + b)`` with numbers of its own. What stands before a part's
first set, or in a part without one, comes down to the last pin, the latest time (an
entry that expires by then is gone) and how many reads count, which depends on the
last counted one before: a read counts if it is late enough after that, so only the
reads that could be the first to count are told apart, and those that soon agree are
one. Two rounds do it: the first tells how long each part's entry has been there, the
second makes each part's function. Both rounds stream through parts; what joins them
per key has one small row per part.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.relevance import HOUR_MS, Decay
from ..session import materialize

_BOUNDS = "namespace string, key string, part long, summary string"
_STATE = "namespace string, key string, set_seq long, expires_at_ms long, last_accessed_ms long, relevance double, created_at_ms long, access_count long, pinned boolean"
_BASE = ("expires_at_ms", "last_accessed_ms", "relevance", "created_at_ms", "access_count", "pinned")


def _whole(x):
    return None if x is None or x != x else int(x)


def _runs(batches: Iterator[pd.DataFrame], make, columns: int) -> Iterator[list]:
    """Feeds sorted rows to one accumulator per (key, part), and gives what each makes."""
    current, acc = None, None
    for batch in batches:
        out = []
        for row in batch.itertuples(index=False, name=None):
            if row[:3] != current:
                if current is not None:
                    out.append((*current, json.dumps(acc.done())))
                current, acc = row[:3], make(row)
            acc.add(*row[3:columns])
        yield out
    if current is not None:
        yield [(*current, json.dumps(acc.done()))]


class _Reads:
    """How many reads of a run count, and the last that does, for any last counted one before it that isn't after ``bound``."""

    def __init__(self, bound: int, touch_ms: int):
        self.bound, self.touch = bound, touch_ms
        # walkers by their last counted read; each with the first it counted and how many
        self.groups: dict[int, list[list[int]]] = {}
        self.top: int | None = None

    def add(self, ts: int) -> None:
        moved = [last for last in self.groups if ts - last > self.touch]
        gathered = [w for last in moved for w in self.groups.pop(last)]
        for w in gathered:
            w[1] += 1
        # a later first read than any so far counts first for whom the earlier ones came too soon
        if self.top is None or (ts > self.top and self.top <= self.bound + self.touch):
            gathered.append([ts, 1])
            self.top = ts
        if gathered:
            self.groups.setdefault(ts, []).extend(gathered)

    def done(self) -> list[list[int]]:
        return sorted([first, n, last] for last, walkers in self.groups.items() for first, n in walkers)


def _count_reads(reads: list[list[int]], last: int, touch_ms: int) -> tuple[int, int]:
    """Reads that count after ``last``, and the last counted one."""
    for first, n, end in reads:
        if first - last > touch_ms:
            return n, end
    return 0, last


class _Bounds:
    """Round one: what comes before a part's first set, and how the entry fares after it."""

    def __init__(self, row, touch_ms: int):
        bound = _whole(row[-1])
        self.base, self.latest, self.pin, self.pinned = None, None, None, False
        self.reads = _Reads(-(1 << 62) if bound is None else bound, touch_ms)
        self.first, self.there, self.exp, self.reset = None, False, None, None

    def add(self, seq, op, ts, ttl, *base):
        ts, ttl = _whole(ts), _whole(ttl)
        if op == "base":
            self.base = [_whole(base[0]), _whole(base[1]), float(base[2]), _whole(base[3]), _whole(base[4]), bool(base[5])]
            self.reads.bound = max(self.reads.bound, self.base[1])
        elif self.first is None and op != "set":
            self.latest = ts if self.latest is None else max(self.latest, ts)
            if op == "read":
                self.reads.add(ts)
            else:
                self.pin, self.pinned = op, self.pinned or op == "pin"
        else:
            live = self.first is None or (self.there and (self.exp is None or ts < self.exp))
            if op == "set":
                if self.first is None:
                    self.first = ts
                elif not live:
                    self.reset = ts
                self.there, self.exp = True, ts + ttl if ttl else None
            elif not live:
                self.there = False

    def done(self):
        head = {"base": self.base, "latest": self.latest, "pin": self.pin, "pinned": self.pinned, "reads": self.reads.done()}
        return {"head": head, "first": self.first, "there": self.there, "exp": self.exp, "reset": self.reset}


class _Body:
    """Round two: a part from its first set on, as a function of pin and score before it."""

    def __init__(self, row, decay: Decay, touch_ms: int, rebase: bool):
        self.decay, self.touch, self.rebase = decay, touch_ms, rebase
        start = json.loads(row[-1])
        self.insert, self.created = start["insert"], start["created"]
        self.modes = {p: [p, 1.0, 0.0, 1.0] for p in (False, True)}
        self.seen, self.there, self.exp, self.last, self.reads, self.fresh, self.set_seq = False, False, None, None, 0, False, None

    def add(self, seq, op, ts, ttl, *_):
        seq, ts, ttl = _whole(seq), _whole(ts), _whole(ttl)
        if op == "base" or (not self.seen and op != "set"):
            return
        live = (not self.insert) if not self.seen else self.there and (self.exp is None or ts < self.exp)
        if op == "set":
            if not live:
                self.modes, self.reads, self.fresh, self.created = {p: [False, 0.0, 1.0, 1.0] for p in (False, True)}, 0, True, ts
            else:
                d = math.exp(-self.decay.rate * max(0.0, (ts - self.created) / HOUR_MS))
                for m in self.modes.values():
                    m[1:] = [0.0, 1.0, 1.0] if m[0] else [d * m[1], d * m[2] + self.decay.write_boost, min(1.0, d * m[3] + self.decay.write_boost)]
                self.reads += 1
                if self.rebase:
                    self.created = ts
            self.seen, self.there, self.exp, self.last, self.set_seq = True, True, ts + ttl if ttl else None, ts, seq
        elif not live:
            self.there = False
        elif op == "read" and ts - self.last > self.touch:
            self.reads, self.last = self.reads + 1, ts
        elif op == "pin":
            for m in self.modes.values():
                m[:] = [True, 0.0, 1.0, 1.0]
        elif op == "unpin":
            for m in self.modes.values():
                m[0] = False

    def done(self):
        return None if not self.seen else {"modes": [self.modes[False], self.modes[True]], "there": self.there, "exp": self.exp, "last": self.last, "reads": self.reads, "fresh": self.fresh, "created": self.created, "set_seq": self.set_seq}


def _frame(rows: list, schema: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[x.split()[0] for x in schema.split(", ")])


def fold_in_parts(rows: DataFrame, decay: Decay, touch_ms: int, rebase_on_write: bool, part_width: int) -> DataFrame:
    """State of each key (without its value) from rows ``(namespace, key, seq, op, ts_ms, ttl_ms, base columns)``."""
    sorted_by = ["namespace", "key", "part", "seq"]
    parted = rows.withColumn("part", F.floor(F.greatest("seq", F.lit(0)) / part_width))
    parted = materialize(parted.select("namespace", "key", "part", "seq", "op", "ts_ms", "ttl_ms", *_BASE), "hot-ops")
    # the latest time of all parts before, which no last access before a part exceeds; one row per part
    latest = parted.groupBy("namespace", "key", "part").agg(F.max(F.greatest("ts_ms", F.coalesce("last_accessed_ms", "ts_ms"))).alias("latest"))
    before = Window.partitionBy("namespace", "key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    latest = latest.select("namespace", "key", "part", F.max("latest").over(before).alias("bound"))
    spread = parted.join(latest, ["namespace", "key", "part"]).repartition("namespace", "key", "part").sortWithinPartitions(*sorted_by)
    spread = spread.select("namespace", "key", "part", "seq", "op", "ts_ms", "ttl_ms", *_BASE, "bound")

    def bounds(batches):
        for out in _runs(batches, lambda row: _Bounds(row, touch_ms), 13):
            yield _frame(out, _BOUNDS)

    summaries = materialize(spread.mapInPandas(bounds, _BOUNDS), "hot-bounds")

    def starts(parts: pd.DataFrame) -> pd.DataFrame:
        there, exp, created, out = False, None, None, []
        for ns, key, part, text in parts.sort_values("part").itertuples(index=False, name=None):
            s = json.loads(text)
            head = s["head"]
            if head["base"]:
                there, exp, created = True, head["base"][0], head["base"][3]
            if exp is not None and head["latest"] is not None and head["latest"] >= exp:
                there = False
            if s["first"] is not None:
                live = there and (exp is None or s["first"] < exp)
                out.append((ns, key, part, json.dumps({"insert": not live, "created": created if live else s["first"]})))
                created = s["reset"] if s["reset"] is not None else created if live else s["first"]
                if rebase_on_write and s["reset"] is None and live:
                    created = s["first"]
                there, exp = s["there"], s["exp"]
        return _frame(out, _BOUNDS)

    begun = materialize(summaries.groupBy("namespace", "key").applyInPandas(starts, _BOUNDS), "hot-starts")
    with_start = parted.join(begun, ["namespace", "key", "part"]).repartition("namespace", "key", "part").sortWithinPartitions(*sorted_by)

    def bodies(batches):
        for out in _runs(batches, lambda row: _Body(row, decay, touch_ms, rebase_on_write), 13):
            yield _frame(out, _BOUNDS)

    made = with_start.select("namespace", "key", "part", "seq", "op", "ts_ms", "ttl_ms", *_BASE, "summary").mapInPandas(bodies, _BOUNDS).withColumnRenamed("summary", "body")

    def joined(parts: pd.DataFrame) -> pd.DataFrame:
        state = None
        for text, body in parts.sort_values("part")[["summary", "body"]].itertuples(index=False, name=None):
            head = json.loads(text)["head"]
            if head["base"]:
                base = head["base"]
                state = dict(exp=base[0], last=base[1], rel=base[2], created=base[3], reads=base[4], pinned=base[5], set_seq=None)
            if state is not None and state["exp"] is not None and head["latest"] is not None and head["latest"] >= state["exp"]:
                state = None
            if state is not None:
                n, last = _count_reads(head["reads"], state["last"], touch_ms)
                state |= dict(reads=state["reads"] + n, last=last)
                if head["pin"]:
                    state |= dict(pinned=head["pin"] == "pin", rel=1.0 if head["pinned"] else state["rel"])
            b = json.loads(body) if isinstance(body, str) else None
            if b:
                before = state or dict(rel=1.0, reads=0, pinned=False)
                pinned, a, c, top = b["modes"][int(before["pinned"])]
                state = dict(exp=b["exp"], last=b["last"], rel=min(top, a * before["rel"] + c), created=b["created"], reads=b["reads"] + (0 if b["fresh"] else before["reads"]), pinned=pinned, set_seq=b["set_seq"])
                state = state if b["there"] else None
        rows = [] if state is None else [(parts["namespace"].iloc[0], parts["key"].iloc[0], state["set_seq"], state["exp"], state["last"], state["rel"], state["created"], state["reads"], state["pinned"])]
        out = _frame(rows, _STATE)
        for name in ("set_seq", "expires_at_ms", "last_accessed_ms", "created_at_ms", "access_count"):
            out[name] = out[name].astype("Int64")
        return out

    return summaries.join(made, ["namespace", "key", "part"], "left").groupBy("namespace", "key").applyInPandas(joined, _STATE)
