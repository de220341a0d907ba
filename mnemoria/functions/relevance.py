"""Relevance: exponential decay with boosts by use."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOUR_MS = 3_600_000.0


@dataclass(frozen=True)
class Decay:
    """Decay per hour, boosts per read and write, and the floor below which entries are reaped."""

    rate: float = math.log(2) / 24
    read_boost: float = 0.1
    write_boost: float = 0.15
    floor: float = 0.01


DEFAULT = Decay()


def clamp(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def _column(x: Column | float | int) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def decayed(relevance: Column, created_ms: Column, pinned: Column, as_of_ms: Column | int, rate: Column | float = DEFAULT.rate) -> Column:
    """Score at a time: 1 if pinned, unchanged before its creation, else halved every ln 2 / rate hours."""
    now = _column(as_of_ms)
    age = (now - created_ms) / F.lit(HOUR_MS)
    return F.when(pinned, F.lit(1.0)).when(now <= created_ms, clamp(relevance)).otherwise(clamp(relevance * F.exp(-_column(rate) * age)))


def effective(relevance: Column, created_ms: Column, pinned: Column, access_count: Column, as_of_ms: Column | int, rate: Column | float = DEFAULT.rate, read_boost: Column | float = DEFAULT.read_boost) -> Column:
    """Decayed score plus the boost of all reads, within 0 and 1."""
    return clamp(decayed(relevance, created_ms, pinned, as_of_ms, rate) + access_count * _column(read_boost))


def boosted(relevance: Column, pinned: Column, boost: Column | float) -> Column:
    return F.when(pinned, F.lit(1.0)).otherwise(F.least(F.lit(1.0), relevance + _column(boost)))


def below_floor(relevance: Column, floor: Column | float = DEFAULT.floor) -> Column:
    return relevance < _column(floor)


def with_decay(entries: DataFrame, overrides: DataFrame | None = None, default: Decay = DEFAULT) -> DataFrame:
    """``entries`` with ``rate``, ``read_boost``, ``write_boost`` and ``floor`` of each row's namespace.

    ``overrides`` has one row per namespace; a null in it means the default. How
    the two meet is left to the planner, as overrides may grow with namespaces.
    """
    names = ("rate", "read_boost", "write_boost", "floor")
    if overrides is None:
        return entries.withColumns({n: F.lit(getattr(default, n)) for n in names})
    own = overrides.select("namespace", *[F.col(n).alias(f"__{n}") for n in names])
    joined = entries.join(own, "namespace", "left")
    return joined.withColumns({n: F.coalesce(f"__{n}", F.lit(getattr(default, n))) for n in names}).drop(*[f"__{n}" for n in names])


def merge_overrides(current: DataFrame, changes: DataFrame, default: Decay = DEFAULT) -> DataFrame:
    """Overrides after a partial update: nulls of ``changes`` keep what held before, or the default."""
    names = ("rate", "read_boost", "write_boost", "floor")
    old = current.select("namespace", *[F.col(n).alias(f"__{n}") for n in names])
    both = changes.join(old, "namespace", "full")
    return both.select("namespace", *[F.coalesce(n, f"__{n}", F.lit(getattr(default, n))).alias(n) for n in names])
