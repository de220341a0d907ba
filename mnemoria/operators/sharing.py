"""Who may see and write what: tokens, and shares between namespaces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import SHARES
from .access import live
from .prefixes import prefix_pairs


def current_shares(shares: DataFrame) -> DataFrame:
    """One grant per source, target and prefix: the latest; of equal times the wider permission."""
    key = ["source_namespace", "target_namespace", "key_prefix"]
    order = F.struct("created_at", (F.col("permission") == "read-write").cast("int").alias("wide"))
    return shares.groupBy(*key).agg(F.max_by("permission", order).alias("permission"), F.max("created_at").alias("created_at")).select("source_namespace", "target_namespace", "permission", "key_prefix", "created_at")


def grant(shares: DataFrame, source: str, target: str, permission: str, key_prefix: str | None, created_at: int) -> DataFrame:
    if source == target:
        raise ValueError("a namespace isn't shared with itself")
    if permission not in ("read", "read-write"):
        raise ValueError(f"unknown permission {permission!r}")
    new = shares.sparkSession.createDataFrame([(source, target, permission, key_prefix, created_at)], SHARES)
    return revoke(shares, source, target, key_prefix).unionByName(new)


def revoke(shares: DataFrame, source: str, target: str, key_prefix: str | None) -> DataFrame:
    return shares.where(~((F.col("source_namespace") == source) & (F.col("target_namespace") == target) & F.col("key_prefix").eqNullSafe(F.lit(key_prefix))))


def revoke_all(shares: DataFrame, source: str) -> DataFrame:
    return shares.where(F.col("source_namespace") != source)


def policies_for(shares: DataFrame, source: str) -> DataFrame:
    return current_shares(shares).where(F.col("source_namespace") == source)


def shared_with(shares: DataFrame, target: str) -> DataFrame:
    return current_shares(shares).where(F.col("target_namespace") == target)


def visible_entries(entries: DataFrame, shares: DataFrame, as_of_ms: int) -> DataFrame:
    """``(target_namespace, namespace, key)``: entries that each namespace sees of others, by any grant, within its prefix.

    Keys meet the prefixes that they begin with by equality; the prefix holds in lists, too.
    """
    s = current_shares(shares).groupBy(F.col("source_namespace").alias("namespace"), F.coalesce("key_prefix", F.lit("")).alias("prefix")).agg(F.collect_set("target_namespace").alias("targets"))
    rows = prefix_pairs(live(entries, as_of_ms).select("namespace", "key"), s)
    return rows.select(F.explode("targets").alias("target_namespace"), "namespace", "key").distinct()


def check_access(requests: DataFrame, shares: DataFrame) -> DataFrame:
    """``requests (caller, namespace, key, is_write)`` plus ``allowed``: the caller's own namespace, or a grant that fits.

    An empty key asks for a list, which a grant with a prefix allows too.
    """
    s = current_shares(shares).select(F.col("source_namespace").alias("namespace"), F.col("target_namespace").alias("caller"), "permission", F.coalesce("key_prefix", F.lit("")).alias("__prefix"))
    key = F.coalesce("key", F.lit(""))
    fits = F.col("permission").isNotNull() & (~F.col("is_write") | (F.col("permission") == "read-write")) & ((key == "") | key.startswith(F.col("__prefix")))
    rows = requests.withColumn("__row", F.monotonically_increasing_id()).join(s, ["namespace", "caller"], "left").withColumn("__fits", F.coalesce(fits, F.lit(False)))
    columns = requests.columns
    merged = rows.groupBy("__row", *columns).agg(F.max("__fits").alias("__any"))
    return merged.select(*columns, ((F.col("caller") == F.col("namespace")) | F.col("__any")).alias("allowed"))


def authorize(requests: DataFrame, tokens: DataFrame, shares: DataFrame | None = None) -> DataFrame:
    """``requests (request_id, token, namespace, key, is_write)`` plus ``allowed``.

    ``tokens (token, namespaces)`` give direct access to their namespaces, or to
    all by ``*``; else any namespace of the token may hold a grant. Without any
    token everything is allowed.
    """
    each = tokens.select("token", F.explode("namespaces").alias("__ns")).distinct()
    everyone = tokens.limit(1).count() == 0
    direct = requests.join(each, "token").where((F.col("__ns") == "*") | (F.col("__ns") == F.col("namespace"))).select("request_id")
    if shares is not None:
        via = requests.join(each, "token").withColumnRenamed("__ns", "caller").select("request_id", "caller", "namespace", "key", "is_write")
        direct = direct.unionByName(check_access(via, shares).where("allowed").select("request_id"))
    ok = direct.distinct().withColumn("__ok", F.lit(True))
    out = requests.join(ok, "request_id", "left")
    return out.withColumn("allowed", F.lit(everyone) | F.coalesce("__ok", F.lit(False))).drop("__ok")
