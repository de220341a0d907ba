"""Keys: ``namespace:rest``, split at the first colon."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def key_namespace(full: Column) -> Column:
    """Text before the first colon; a key without one is its own namespace."""
    return F.substring_index(full, ":", 1)


def key_rest(full: Column) -> Column:
    """Text after the first colon, null where there is none."""
    return F.when(F.instr(full, ":") > 0, F.substring(full, F.instr(full, ":") + 1, F.length(full)))


def first_segment(key: Column) -> Column:
    """The part of a key before its first colon, as groups are formed by."""
    return F.substring_index(key, ":", 1)


def is_live(expires: Column, as_of_ms: int | Column) -> Column:
    """Not expired: an entry expires at the very millisecond of its expiry."""
    return expires.isNull() | (expires > F.lit(as_of_ms) if isinstance(as_of_ms, int) else expires > as_of_ms)


def readable(value: Column) -> Column:
    """Bytes as text, invalid sequences replaced."""
    return F.make_valid_utf8(value.cast("string"))


def prefix_of_pattern(pattern: str) -> str:
    """The prefix that a ``prefix*`` pattern means; no other patterns are supported."""
    if not pattern.endswith("*") or "*" in pattern[:-1] or "?" in pattern or "[" in pattern:
        raise ValueError(f"only patterns that end in a single * are supported, not {pattern!r}")
    return pattern[:-1]


def next_power_of_two(n: int) -> int:
    return 1 << max(0, (max(1, n) - 1).bit_length())


def shard_of(full: Column, shards: int) -> Column:
    """Number of a key's shard, by the first 32 bits of its MD5; ``shards`` is rounded up to a power of two."""
    return F.pmod(F.conv(F.substring(F.md5(full.cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(next_power_of_two(shards))).cast("int")
