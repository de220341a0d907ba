"""The N best rows of every group by simultaneous bisection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.skew import heavy_hashes
from ..session import materialize

#: Midpoints that one pass counts at for every group.
SECTIONS = 4096
#: Bytes of a tie key that one level of the code takes; 48 bits are exact in a double.
CHUNK = 6
_INF = float("inf")


def _chunk(key: Column, level: Column) -> Column:
    """Six bytes of the key as a number that orders like them."""
    piece = F.hex(F.substring(F.encode(key, "UTF-8"), level.cast("int") * CHUNK - (CHUNK - 1), F.lit(CHUNK)))
    return F.conv(F.rpad(piece, 2 * CHUNK, "0"), 16, 10).cast("double")


def _code(level: Column, text_levels: int) -> Column:
    """The part of the code of (score desc, key asc, number asc) at a level; the larger, the better.

    Level 0 is the score, then come the key's bytes by six, the key's length
    (for keys that differ by trailing zero bytes only) and the number in two halves.
    """
    key, number = F.col("tie_key"), F.col("tie_number")
    return (
        F.when(level == 0, F.col("score"))
        .when(level <= text_levels, -F.coalesce(_chunk(key, level), F.lit(_INF)))
        .when(level == text_levels + 1, -F.coalesce(F.octet_length(key).cast("double"), F.lit(_INF)))
        .when(level == text_levels + 2, -F.coalesce(F.shiftright(number, 32).cast("double"), F.lit(_INF)))
        .otherwise(-F.coalesce(number.bitwiseAND(F.lit(0xFFFFFFFF)).cast("double"), F.lit(_INF)))
    )


def _differs(level: Column, text_levels: int) -> Column:
    """The first level beyond ``level`` on which the smallest and the largest code of rows can differ.

    Keys in between share what these two share; a null key has the lowest code on any
    level of the key, whichever comes next.
    """
    out = F.lit(text_levels + 3)
    halves = F.when(~F.shiftright("number1", 32).eqNullSafe(F.shiftright("number2", 32)), text_levels + 2).otherwise(out)
    out = F.when(F.octet_length("key1") != F.octet_length("key2"), text_levels + 1).otherwise(halves)
    for at in range(text_levels, 0, -1):
        beginning = [F.substring(F.encode(k, "UTF-8"), 1, at * CHUNK) for k in (F.col("key1"), F.col("key2"))]
        out = F.when(beginning[0] != beginning[1], at).otherwise(out)
    # where some keys are null and others not, the next level parts them
    return F.greatest(F.when(F.col("nulls") > 0, level + 1).otherwise(out), level + 1)


def _code_of(key: str, number: str, text_levels: int) -> Column:
    """The code on the level ``next`` of a row with this key and number; null where it is infinite."""
    at, number_column = F.col("next"), F.col(number)
    found = (
        F.when(at <= text_levels, -_chunk(F.col(key), at))
        .when(at == text_levels + 1, -F.octet_length(key).cast("double"))
        .when(at == text_levels + 2, -F.shiftright(number_column, 32).cast("double"))
        .when(F.shiftright("number1", 32).eqNullSafe(F.shiftright("number2", 32)), -number_column.bitwiseAND(F.lit(0xFFFFFFFF)).cast("double"))
        .otherwise(F.lit(0.0 if number == "number1" else -float(0xFFFFFFFF)))
    )
    return found


def _bucket(code: Column) -> Column:
    """Number of midpoints between ``lo`` and ``hi`` at or below the code; infinities have buckets of their own."""
    # halves, so that the span of two large scores of unlike sign is finite
    share = (code / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
    inside = F.when(F.col("hi") > F.col("lo"), F.least(F.floor(F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)) * SECTIONS), F.lit(SECTIONS - 1)))
    return F.when(code == _INF, F.lit(SECTIONS)).when(code == -_INF, F.lit(-1)).otherwise(F.coalesce(inside, F.lit(0))).cast("int")


def top_n_per_group(df: DataFrame, group: str, score: str, tie_key: str, tie_number: str, n: int) -> DataFrame:
    """``(group, score, tie_key, tie_number, place)``: the first ``n`` distinct rows of each group.

    Order: score descending, then the string ``tie_key`` ascending by bytes, then
    the integer ``tie_number`` ascending; nulls of the tie columns come last.
    Rows whose group or score is null, or whose score is NaN, don't take part.
    Repeated rows count once. A group with fewer than ``n`` rows keeps all; an
    empty table gives no rows. Columns not named aren't read.

    All groups are cut at once: each pass counts, for every group that is still
    open, the rows above 4095 midpoints of its range of codes (rows of one score go on
    at the first part of the key that tells them apart), accepts what lies
    above the cutoff, drops what lies below, and goes on within the cutoff's
    section, whose ends are the codes that occur there. Counting combines on the
    map side, and the cutoffs of hot groups reach their rows by a broadcast of
    bounded size, so no group is ever gathered in one task.
    """
    rows = df.select(F.col(group).alias("grp"), F.col(score).cast("double").alias("score"), F.col(tie_key).cast("string").alias("tie_key"), F.col(tie_number).cast("long").alias("tie_number"))
    rows = rows.where(F.col("grp").isNotNull() & F.col("score").isNotNull() & ~F.isnan("score")).withColumn("score", F.col("score") + F.lit(0.0))
    rows = materialize(rows.distinct(), "topn-rows")
    finite = F.when(F.abs("score") < _INF, F.col("score"))
    ends = rows.agg(F.min(finite).alias("lo"), F.max(finite).alias("hi"), F.max(F.octet_length("tie_key")).alias("size")).first()
    text_levels = -(-(ends["size"] or 0) // CHUNK)
    last_level = text_levels + 3
    heavy = list(heavy_hashes(rows, ["grp"])[0])
    hot = F.xxhash64("grp").isin(heavy) if heavy else F.lit(False)

    active = rows.withColumns({"need": F.lit(n).cast("long"), "level": F.lit(0), "lo": F.lit(ends["lo"] or 0.0).cast("double"), "hi": F.lit(ends["hi"] or 0.0).cast("double")})
    accepted = None
    while True:
        level = F.col("level")
        coded = active.withColumn("code", _code(level, text_levels)).withColumn("bucket", _bucket(F.col("code")))
        counts = coded.groupBy("grp", "bucket").agg(
            F.count(F.lit(1)).alias("n"), F.min("code").alias("lo2"), F.max("code").alias("hi2"), F.min("tie_key").alias("key1"), F.max("tie_key").alias("key2"),
            F.min("tie_number").alias("number1"), F.max("tie_number").alias("number2"), F.first("need").alias("need"), F.first("level").alias("level"),
            F.count_if(F.col("tie_key").isNull() | F.col("tie_number").isNull()).alias("nulls"),
        )
        # rows with one code go on at the first level on which their smallest and largest key, or number, differ
        counts = counts.withColumn("next", _differs(level, text_levels))
        counts = counts.withColumns({"lo3": _code_of("key2", "number2", text_levels), "hi3": _code_of("key1", "number1", text_levels)})
        above = F.sum("n").over(Window.partitionBy("grp").orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, 0))
        # of each group only the sections down to the cutoff's; at most one of them is split
        cut = counts.withColumn("upto", above).where(F.col("upto") - F.col("n") < F.col("need"))
        split, tied = F.col("upto") > F.col("need"), F.col("lo2") == F.col("hi2")
        state = cut.groupBy("grp").agg(
            F.min("bucket").alias("cut"),
            F.max(split).alias("open"),
            F.max(F.when(split, F.col("need") - F.col("upto") + F.col("n"))).alias("need2"),
            F.max(F.when(split, F.when(tied, F.col("next")).otherwise(F.col("level")))).alias("level2"),
            F.max(F.when(split, F.when(tied, F.coalesce("lo3", F.lit(0.0))).otherwise(F.col("lo2")))).alias("lo2"),
            F.max(F.when(split, F.when(tied, F.coalesce("hi3", F.lit(0.0))).otherwise(F.col("hi2")))).alias("hi2"),
        )
        coded = coded.select("grp", "score", "tie_key", "tie_number", "bucket")
        met = coded.where(~hot).join(state.where(~hot), "grp")
        if heavy:
            met = met.unionByName(coded.where(hot).join(F.broadcast(state.where(hot)), "grp"))
        met = met.where(F.col("bucket") >= F.col("cut")).select(
            "grp", "score", "tie_key", "tie_number", ((F.col("bucket") == F.col("cut")) & F.col("open")).alias("open"),
            F.col("need2").alias("need"), F.col("level2").cast("int").alias("level"), F.col("lo2").alias("lo"), F.col("hi2").alias("hi"),
        )
        met = materialize(met, "topn-pass")
        done = met.where(~F.col("open")).select("grp", "score", "tie_key", "tie_number")
        accepted = done if accepted is None else accepted.unionByName(done)
        active = met.where("open").drop("open")
        deepest = active.agg(F.max("level")).first()[0]
        if deepest is None:
            break
        if deepest > last_level:  # distinct rows differ at some level
            raise AssertionError("rows can't be told apart")
    order = [F.desc("score"), F.asc_nulls_last("tie_key"), F.asc_nulls_last("tie_number")]
    return accepted.withColumn("place", F.row_number().over(Window.partitionBy("grp").orderBy(*order))).select(
        F.col("grp").alias(group), F.col("score").alias(score), F.col("tie_key").alias(tie_key), F.col("tie_number").alias(tie_number), "place"
    )
