"""Exact cosine top-k over embeddings; an optional approximate search by hashing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import cosine_distance, norm
from ..schema import DEFAULT_TOP_K
from .access import live

#: Parts into which a namespace's entries are dealt where queries meet them.
PARTS = 32


def searchable(entries: DataFrame, as_of_ms: int) -> DataFrame:
    """``(namespace, key, value, embedding, norm)`` of live entries with a vector, where a namespace's vectors all have one length.

    A namespace of mixed lengths, or of length 0, has nothing to search. Lengths
    are compared by a small aggregate per namespace.
    """
    rows = live(entries, as_of_ms).where(F.col("embedding").isNotNull()).select("namespace", "key", "value", "embedding")
    dims = rows.groupBy("namespace").agg(F.min(F.size("embedding")).alias("low"), F.max(F.size("embedding")).alias("high"))
    even = dims.where((F.col("low") == F.col("high")) & (F.col("low") > 0)).select("namespace")
    return rows.join(even, "namespace", "left_semi").withColumn("norm", norm(F.col("embedding")))


def top_k(entries: DataFrame, namespace: str, query: list[float], as_of_ms: int, k: int = DEFAULT_TOP_K) -> DataFrame:
    """``(key, value, distance)``: the nearest entries of a namespace, ties by key.

    A query of another length than the namespace's vectors finds nothing.
    """
    rows = searchable(entries.where(F.col("namespace") == namespace), as_of_ms).where(F.size("embedding") == len(query))
    vector = F.array(*[F.lit(float(x)) for x in query]) if query else F.array().cast("array<double>")
    scored = rows.select("key", "value", cosine_distance(F.col("embedding"), vector, norm_a=F.col("norm")).alias("distance"))
    return scored.orderBy("distance", "key").limit(k)


def multi_top_k(entries: DataFrame, queries: DataFrame, as_of_ms: int, k: int = DEFAULT_TOP_K) -> DataFrame:
    """``(query_id, key, value, distance, rank)`` for queries ``(query_id, namespace, embedding)``.

    Each query meets the entries of its own namespace only. These are dealt into
    ``PARTS`` by their keys and a query goes to each part, so that a hot namespace isn't
    met in one task; a part is cut to ``k`` where it is met. Norms are taken once per
    vector.
    """
    q = queries.select("query_id", F.col("namespace"), F.col("embedding").alias("__q"), F.explode(F.array(*[F.lit(i) for i in range(PARTS)])).alias("__part")).withColumn("__qn", norm(F.col("__q")))
    rows = searchable(entries, as_of_ms).withColumn("__part", F.pmod(F.xxhash64("key"), F.lit(PARTS)).cast("int"))
    rows = rows.join(q, ["namespace", "__part"]).where(F.size("embedding") == F.size("__q"))
    scored = rows.select("query_id", "__part", "key", "value", cosine_distance(F.col("embedding"), F.col("__q"), F.col("norm"), F.col("__qn")).alias("distance"))
    parts = Window.partitionBy("query_id", "__part").orderBy("distance", "key")
    whole = Window.partitionBy("query_id").orderBy("distance", "key")
    cut = scored.withColumn("rank", F.row_number().over(parts)).where(F.col("rank") <= k).drop("__part")
    return cut.withColumn("rank", F.row_number().over(whole)).where(F.col("rank") <= k)


def dimension_report(entries: DataFrame, as_of_ms: int) -> DataFrame:
    """``(namespace, vectors, min_dims, max_dims, searchable)`` of each namespace with vectors."""
    rows = live(entries, as_of_ms).where(F.col("embedding").isNotNull())
    out = rows.groupBy("namespace").agg(F.count(F.lit(1)).alias("vectors"), F.min(F.size("embedding")).alias("min_dims"), F.max(F.size("embedding")).alias("max_dims"))
    return out.withColumn("searchable", (F.col("min_dims") == F.col("max_dims")) & (F.col("min_dims") > 0))


def lsh_top_k(entries: DataFrame, namespace: str, query: list[float], as_of_ms: int, k: int = DEFAULT_TOP_K, tables: int = 8, bucket: float = 1.0) -> DataFrame:
    """``(key, distance)``: approximate neighbours by random projections of vectors of length one."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH, Normalizer
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.linalg import Vectors

    rows = searchable(entries.where(F.col("namespace") == namespace), as_of_ms).where((F.size("embedding") == len(query)) & (F.col("norm") > 0))
    unit = Normalizer(inputCol="v", outputCol="unit").transform(rows.select("key", array_to_vector(F.col("embedding").cast("array<double>")).alias("v")))
    model = BucketedRandomProjectionLSH(inputCol="unit", outputCol="hashes", bucketLength=bucket, numHashTables=tables, seed=42).fit(unit)
    size = sum(x * x for x in query) ** 0.5 or 1.0
    near = model.approxNearestNeighbors(unit, Vectors.dense([x / size for x in query]), k, distCol="euclid")
    # for vectors of length one, half the squared distance is the cosine distance
    return near.select("key", (F.col("euclid") * F.col("euclid") / 2).alias("distance"))
