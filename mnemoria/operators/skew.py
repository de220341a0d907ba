"""Work per key where a few keys hold most rows.

Two-stage salted aggregation: heavy keys get a salt, partial results are made
per key and salt, and the partials are merged by the original key. Heavy keys
are found by a bounded frequent-items sketch in one pass, so that no count per
key has to exist before the work is split. What counts as heavy follows the
number of shuffle partitions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize

#: A key is split at the latest when it holds this share of the rows.
HEAVY_SHARE = 0.01
#: Counters of the sketch for each key that can hold the share asked for; its error is far below that share.
SKETCH_FACTOR = 16
#: Pieces of one heavy key for each whole share that it holds.
SALTS_PER_SHARE = 4
#: Rows of a lookup are broadcast only when they are measured to be smaller than this.
BROADCAST_BYTES = 32 << 20

_SALT, _HASH = "__salt", "__key_hash"


def heavy_share(spark: SparkSession) -> float:
    """The share from which a key is split: what one shuffle partition of even size holds, and ``HEAVY_SHARE`` at most.

    On ten thousand partitions a key with a thousandth of the rows is ten of them.
    """
    return min(HEAVY_SHARE, 1 / max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def heavy_hashes(df: DataFrame, keys: list[str], share: float | None = None) -> tuple[dict[int, int], int]:
    """Hashes of the keys that hold at least ``share`` of the rows, with estimates, and the rows.

    The driver gets at most ``2 / share`` pairs of numbers, which depends on the
    size of the cluster and not on the data. A light key whose hash equals a heavy
    one's is only split needlessly; results don't change.
    """
    share = share or heavy_share(df.sparkSession)
    items = min(1_000_000, max(16384, round(SKETCH_FACTOR / share)))
    top = min(items, max(256, round(2 / share)))
    row = df.select(F.xxhash64(*keys).alias("h")).agg(F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k(h, {top}, {items})").alias("top")).first()
    total = row["n"] or 0
    slack = 2 * total / items
    return {x["item"]: x["count"] for x in row["top"] or [] if x["count"] + slack >= share * total}, total


def pieces_of(heavy: dict[int, int], total: int, share: float) -> dict[int, list[int]]:
    """Numbers of pieces (powers of two, so that there are few) with the key hashes that are cut into so many."""
    by_pieces: dict[int, list[int]] = {}
    for h, n in heavy.items():
        wanted = max(2, round(SALTS_PER_SHARE * n / max(1, share * total)))
        by_pieces.setdefault(1 << (wanted - 1).bit_length(), []).append(h)
    return by_pieces


def _by_key(code: Column, by_pieces: dict[int, list[int]], make) -> Column:
    """``make(pieces)`` for rows of heavy keys, else null."""
    chosen = None
    for n, hashes in by_pieces.items():
        hit = code.isin(hashes)
        chosen = F.when(hit, make(n)) if chosen is None else chosen.when(hit, make(n))
    return F.lit(None) if chosen is None else chosen


def add_salt(df: DataFrame, keys: list[str], heavy: dict[int, int], total: int, share: float = HEAVY_SHARE) -> DataFrame:
    """``df`` with ``__salt``: 0 for light keys, else one of the key's pieces.

    The salt is a hash of the partition that a row is in and of the rest of the row. A
    row has no other columns where rows are only counted, and rows may repeat in
    full: the partition parts those, too. Both are the same when a task runs
    again after a lost executor, which ``rand()`` or a row's place in the output of a
    shuffle isn't. Within a partition equal rows combine before they move.
    """
    rest = [c for c in df.columns if c not in keys]
    mix = F.xxhash64(F.lit(7), F.spark_partition_id(), *rest)
    salt = _by_key(F.xxhash64(*keys), pieces_of(heavy, total, share), lambda n: F.pmod(mix, F.lit(n)))
    return df.withColumn(_SALT, F.coalesce(salt, F.lit(0)).cast("int"))


def salted_aggregate(
    df: DataFrame, keys: list[str], aggs: dict[str, tuple[str, str | None]], share: float | None = None
) -> DataFrame:
    """Aggregates per key in two stages, without an imbalance by heavy keys.

    ``aggs`` maps an output column to ``(kind, column)``; kinds are ``count``
    (column None: rows, else non-null values), ``sum``, ``min``, ``max``,
    ``avg`` and ``count_distinct`` (exact). A null key is a key of its own, as
    in ``GROUP BY``. An empty table gives no rows. Columns not named in ``keys``
    or ``aggs`` aren't read, whatever their names. Distinct counts are taken from
    rows made distinct by key and value first, which spreads a heavy key by its
    values.
    """
    taken = sorted({c for _, c in aggs.values() if c})
    slim = df.select(*[F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(keys)], *[F.col(f"`{c}`").alias(f"__v_{c}") for c in taken])
    names = [f"__k{i}" for i in range(len(keys))]
    share = share or heavy_share(df.sparkSession)
    heavy, total = heavy_hashes(slim, names, share)
    salted = add_salt(slim, names, heavy, total, share)
    first: list[Column] = []
    last: list[Column] = []
    distinct = {out: c for out, (kind, c) in aggs.items() if kind == "count_distinct"}
    for out, (kind, column) in aggs.items():
        value = F.col(f"__v_{column}") if column else F.lit(1)
        if kind == "count":
            first.append(F.count(value).alias(f"__p_{out}"))
            last.append(F.sum(f"__p_{out}").alias(out))
        elif kind in ("sum", "min", "max"):
            f = getattr(F, kind)
            first.append(f(value).alias(f"__p_{out}"))
            last.append(f(f"__p_{out}").alias(out))
        elif kind == "avg":
            first += [F.sum(value.cast("double")).alias(f"__p_{out}"), F.count(value).alias(f"__n_{out}")]
            last.append((F.sum(f"__p_{out}") / F.nullif(F.sum(f"__n_{out}"), F.lit(0))).alias(out))
        elif kind != "count_distinct":
            raise ValueError(f"unknown aggregate {kind!r}")
    first = first or [F.count(F.lit(1)).alias("__p")]
    result = salted.groupBy(*names, _SALT).agg(*first).groupBy(*names).agg(*(last or [F.sum("__p").alias("__p")]))
    for out, column in distinct.items():
        value = f"__v_{column}"
        part = (
            slim.where(F.col(value).isNotNull()).groupBy(*names, value).agg(F.lit(1).alias("one"))
            .withColumn(_SALT, F.pmod(F.xxhash64(value), F.lit(64)))
            .groupBy(*names, _SALT).agg(F.count("one").alias("n")).groupBy(*names).agg(F.sum("n").alias(out))
        )
        right = part.select(*[F.col(n).alias(f"r{n}") for n in names], out)
        on = reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(f"r{n}")) for n in names])
        result = result.join(right, on, "left").drop(*[f"r{n}" for n in names]).withColumn(out, F.coalesce(out, F.lit(0).cast("long")))
    return result.select(*[F.col(n).alias(k) for n, k in zip(names, keys)], *aggs)


def heavy_keys(df: DataFrame, key: str, share: float = HEAVY_SHARE) -> DataFrame:
    """``(heavy_key, n)``: the non-null values of ``key`` with at least ``share`` of all rows, null keys included in the rows."""
    counts = salted_aggregate(df.select(F.col(f"`{key}`").alias("heavy_key")), ["heavy_key"], {"n": ("count", None)}, min(share, heavy_share(df.sparkSession)))
    return counts.where(F.col("heavy_key").isNotNull() & (F.col("n") >= F.lit(share * df.count())))


def _width(lookup: DataFrame) -> Column:
    """Bytes of a row, by the length of its text where a column has no fixed width."""
    fixed = ("bigint", "int", "smallint", "tinyint", "double", "float", "boolean", "date", "timestamp", "timestamp_ntz")
    return sum((F.lit(8) if kind in fixed else F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) + 8 for c, kind in lookup.dtypes), F.lit(0)).cast("long")


def skewed_lookup(rows: DataFrame, lookup: DataFrame, keys: list[str], how: str = "inner", share: float | None = None) -> DataFrame:
    """Join ``rows`` to ``lookup`` (one row per key) where some keys are hot in ``rows``.

    ``how`` is ``inner`` or ``left``; a null key meets nothing. The lookup rows of
    heavy keys are written out and measured. Below ``BROADCAST_BYTES`` they are
    broadcast, and hot rows don't move. Else hot rows are salted and the lookup row
    of a heavy key is repeated for each of its salts. All others meet by a shuffle
    in which no key is heavy.
    """
    share = share or heavy_share(rows.sparkSession)
    heavy, total = heavy_hashes(rows, keys, share)
    if not heavy:
        return rows.join(lookup, keys, how)
    code = F.xxhash64(*keys)
    hot = code.isin(list(heavy))
    few = materialize(lookup.where(hot), "hot-lookup")
    if (few.agg(F.sum(_width(few))).first()[0] or 0) <= BROADCAST_BYTES:
        met = rows.where(hot).join(F.broadcast(few), keys, how)
    else:
        by_pieces = pieces_of(heavy, total, share)
        salts = F.explode(_by_key(code, by_pieces, lambda n: F.array(*[F.lit(i) for i in range(n)])))
        met = add_salt(rows.where(hot), keys, heavy, total, share).join(few.withColumn(_SALT, salts), [*keys, _SALT], how).drop(_SALT)
    return met.unionByName(rows.where(~hot).join(lookup.where(~hot), keys, how))
