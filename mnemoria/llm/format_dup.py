"""Duplicates hidden by formatting differences."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import skewed_lookup
from ..session import materialize
from .batches import by_size
from .folding import class_hashes, same_left


def _hash_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in by_size(batches, "value"):
        h1, h2, left = class_hashes(batch.column("value").to_pylist())
        keep = pa.array(left)
        out = pa.RecordBatch.from_arrays([batch.column("id"), batch.column("value"), pa.array(h1), pa.array(h2)], ["id", "value", "h1", "h2"])
        yield out.filter(keep)


def _verify_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in by_size(batches, "value", "rep_value"):
        same = [same_left(a, b) for a, b in zip(batch.column("value").to_pylist(), batch.column("rep_value").to_pylist())]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("h1", "h2", "rep", "id")], pa.array(same, pa.bool_())], ["h1", "h2", "rep", "id", "same"])


def format_copies(df: DataFrame, id_column: str, value_column: str) -> DataFrame:
    """``(rep, id)``: each row but the first of every class of values that differ only in formatting.

    ``rep`` is the smallest id of the class, so a class of n copies gives n - 1
    rows. Values are copies if the same letters and digits are left of them in
    lower case; lists of fields, if the same set of name-value pairs is. Null
    values, and values of which nothing is left, belong to no class; rows with a
    null id are left out. An empty table gives no rows; other columns aren't read.

    Each value is streamed through the fold table into two hashes where it is
    scanned; classes are counted with a map-side combine, so a class that holds
    a third of all rows never meets in one task. Only rows of classes with at
    least two rows are compared with their representative, by two pointers that skip
    what the table skips. Rows that collide without being equal are compared with the
    smallest id among them in turn, until none is left; with 128 bits of hash that is a
    round that finds nothing.
    """
    slim = df.select(F.col(id_column).cast("string").alias("id"), F.col(value_column).alias("value")).where(F.col("id").isNotNull() & F.col("value").isNotNull())
    hashed = materialize(slim.mapInArrow(_hash_batches, "id string, value string, h1 long, h2 long"), "format-hashes")
    found, rows = None, hashed
    while True:
        groups = rows.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
        members = materialize(skewed_lookup(rows, groups.drop("n"), ["h1", "h2"]), "format-members")
        reps = members.where(F.col("id") == F.col("rep")).select("h1", "h2", F.col("value").alias("rep_value")).dropDuplicates(["h1", "h2"])
        met = skewed_lookup(members.where(F.col("id") != F.col("rep")), reps, ["h1", "h2"]).select("h1", "h2", "rep", "id", "value", "rep_value")
        checked = materialize(met.mapInArrow(_verify_batches, "h1 long, h2 long, rep string, id string, same boolean"), "format-checked")
        equal = checked.where("same").select("rep", "id")
        found = equal if found is None else found.unionByName(equal)
        odd = checked.where(~F.col("same")).select("h1", "h2", "id")
        if odd.limit(1).count() == 0:
            return found
        rows = materialize(members.join(odd, ["h1", "h2", "id"], "left_semi").select("id", "value", "h1", "h2"), "format-odd")


def copy_counts(df: DataFrame, id_column: str, value_column: str) -> DataFrame:
    """``(rep, copies)``: each class with at least two copies once, and how many rows it has."""
    return format_copies(df, id_column, value_column).groupBy("rep").agg((F.count(F.lit(1)) + 1).alias("copies"))


__all__ = ["copy_counts", "format_copies"]
