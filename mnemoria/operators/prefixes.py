"""Keys and the prefixes that they begin with, met by equality instead of by testing every prefix of a namespace."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def prefix_pairs(rows: DataFrame, prefixes: DataFrame) -> DataFrame:
    """``rows (namespace, key, ...)`` with the columns of each ``prefixes (namespace, prefix, ...)`` that its key begins with.

    Of each key the beginnings are taken whose length some prefix has, and these meet
    the prefixes by namespace and text. So a row is repeated once for each length that
    occurs, however many prefixes its namespace has, and a hot namespace is spread by
    its keys (and by adaptive execution where the prefix is empty). The lengths are
    collected: there are no more of them than the longest prefix has characters. A null
    key begins with nothing; other columns of both sides must have names of their own.
    """
    lengths = sorted(r[0] for r in prefixes.where(F.col("prefix").isNotNull()).select(F.length("prefix")).distinct().collect())
    if not lengths:
        return rows.join(prefixes, "namespace").limit(0)
    at = F.explode(F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length("key")))
    cut = rows.select("*", at.alias("__n")).withColumn("prefix", F.substring(F.col("key"), F.lit(1), F.col("__n"))).drop("__n")
    return cut.join(prefixes, ["namespace", "prefix"])
