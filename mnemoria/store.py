"""The store's operations under one roof: state in, state or rows out, all as of a given time."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.relevance import DEFAULT, Decay, merge_overrides
from .operators import access, capacity, consolidate, mutate, reap, replay, scan, sharing, triggers, vector_search
from .schema import ENTRIES, LOG, SHARES
from .session import materialize
from .sources import snapshot

#: Writes after which the state is written as a whole.
COMPACT = 8


@dataclass
class Store:
    """A view of ``entries`` (state), ``ops`` (log), ``shares`` and triggers.

    Reads are lazy DataFrames. Writes give a new ``Store``; nothing is changed
    in place, so a store stays what it was for whoever holds it.
    """

    spark: SparkSession
    entries: DataFrame
    ops: DataFrame | None = None
    shares: DataFrame | None = None
    overrides: DataFrame | None = None
    decay: Decay = DEFAULT
    registry: triggers.Registry = field(default_factory=triggers.Registry)
    rules: list = field(default_factory=list)
    history: DataFrame | None = None
    consolidates: bool = True
    depth: int = 0

    @classmethod
    def empty(cls, spark: SparkSession) -> Store:
        return cls(spark, spark.createDataFrame([], ENTRIES), spark.createDataFrame([], LOG), spark.createDataFrame([], SHARES))

    @classmethod
    def from_tables(cls, spark: SparkSession, folder: str) -> Store:
        from .sources import read_tables

        return cls(spark, *read_tables(spark, folder, "entries", "ops", "shares"))

    @classmethod
    def from_log(cls, spark: SparkSession, ops: DataFrame, as_of_ms: int | None = None) -> Store:
        return cls(spark, materialize(replay.replay(ops, as_of_ms=as_of_ms), "store"), ops)

    def _with(self, **changes) -> Store:
        names = ("spark", "entries", "ops", "shares", "overrides", "decay", "registry", "rules", "history", "consolidates", "depth")
        return Store(**({n: getattr(self, n) for n in names} | changes))

    # --- reads

    def get(self, namespace: str, key: str, as_of_ms: int) -> DataFrame:
        return access.get(self.entries, namespace, key, as_of_ms)

    def get_with_meta(self, namespace: str, key: str, as_of_ms: int) -> DataFrame:
        return access.get_with_meta(self.entries, namespace, key, as_of_ms, self.overrides)

    def mget(self, keys: list[str], as_of_ms: int) -> DataFrame:
        return access.multi_get(access.requests(self.spark, keys), self.entries, as_of_ms)

    def mgett(self, keys: list[str], as_of_ms: int) -> DataFrame:
        return access.typed_get(access.requests(self.spark, keys), self.entries, as_of_ms)

    def mtype(self, keys: list[str], as_of_ms: int) -> DataFrame:
        return access.type_lookup(access.requests(self.spark, keys), self.entries, as_of_ms)

    def batch_get(self, keys: list[str], as_of_ms: int) -> tuple[DataFrame, DataFrame]:
        asked = access.requests(self.spark, keys)
        return access.batch_found(asked, self.entries, as_of_ms), access.batch_missing(asked, self.entries, as_of_ms)

    def relevance(self, keys: list[str], as_of_ms: int) -> DataFrame:
        return access.relevance_info(access.requests(self.spark, keys), self.entries, as_of_ms, self.overrides)

    def list(self, namespace: str, as_of_ms: int, memory_type: str | None = None, prefix: str | None = None, by_relevance: bool = False) -> DataFrame:
        return scan.list_entries(self.entries, namespace, as_of_ms, memory_type, prefix, self.overrides, by_relevance)

    def scan(self, prefix: str, as_of_ms: int, by_relevance: bool = False) -> DataFrame:
        return scan.relevance_scan(self.entries, prefix, as_of_ms, self.overrides) if by_relevance else scan.prefix_scan(self.entries, prefix, as_of_ms)

    def keys(self, pattern: str, as_of_ms: int) -> DataFrame:
        return scan.keys_matching(self.entries, pattern, as_of_ms)

    def count(self, prefix: str, as_of_ms: int) -> DataFrame:
        return scan.count_prefix(self.entries, prefix, as_of_ms)

    def namespaces(self, as_of_ms: int) -> DataFrame:
        return scan.active_namespaces(self.entries, as_of_ms)

    def search(self, namespace: str, query: list[float], as_of_ms: int, top_k: int = 10) -> DataFrame:
        return vector_search.top_k(self.entries, namespace, query, as_of_ms, top_k)

    def search_many(self, queries: DataFrame, as_of_ms: int, top_k: int = 10) -> DataFrame:
        return vector_search.multi_top_k(self.entries, queries, as_of_ms, top_k)

    # --- writes

    def apply(self, ops: DataFrame) -> Store:
        """The store after more operations of the log, on top of its state.

        Only the state of keys that the operations touch is folded and written; the rest
        is the old one without them. After ``COMPACT`` such steps all of it is written.
        """
        changed, rest = replay.replay_parts(ops, base=self.entries, decay=self.decay)
        entries, depth = materialize(changed, "store"), self.depth + 1
        if rest is not None:
            entries = entries.unionByName(rest)
        if depth >= COMPACT:
            entries, depth = materialize(entries, "store"), 0
        return self._with(entries=entries, depth=depth, ops=ops if self.ops is None else self.ops.unionByName(ops, allowMissingColumns=True))

    def put(self, writes: DataFrame, as_of_ms: int, first_seq: int, nx: bool = False, xx: bool = False, apply_type_default_ttl: bool = False) -> Store:
        """Set ``(pos, namespace, key, value[, memory_type, ttl_ms, embedding])``, in the order of ``pos``.

        ``pos`` is unique within the batch, and with ``first_seq`` it makes the
        numbers of the operations.
        """
        from pyspark.sql import functions as F

        chosen = access.conditional(writes, self.entries, as_of_ms, nx, xx)
        ops = mutate.set_ops(chosen, as_of_ms, apply_type_default_ttl, keep=["pos"])
        return self.apply(ops.withColumn("seq", F.lit(first_seq) + F.col("pos")).select(*[f.name for f in LOG.fields]))

    def delete(self, keys: list[str]) -> Store:
        return self._with(entries=mutate.delete_keys(self.entries, access.requests(self.spark, keys)))

    def delete_namespace(self, namespace: str) -> Store:
        return self._with(entries=mutate.delete_namespace(self.entries, namespace))

    def delete_prefix(self, namespace: str, prefix: str) -> Store:
        return self._with(entries=mutate.delete_prefixes(self.entries, self.spark.createDataFrame([(namespace, prefix)], "namespace string, key_prefix string")))

    def clear(self) -> Store:
        return self._with(entries=self.entries.limit(0))

    def pin(self, keys: list[str], as_of_ms: int, pinned: bool = True) -> Store:
        """Pin live keys (score 1, no decay) or let them go (the score stays); others are left alone."""
        from pyspark.sql import functions as F

        from .functions.keys import is_live

        asked = access.requests(self.spark, keys).select("namespace", "key", F.lit(True).alias("__asked")).distinct()
        met = self.entries.join(asked, ["namespace", "key"], "left")
        hit = F.coalesce("__asked", F.lit(False)) & is_live(F.col("expires_at_ms"), as_of_ms)
        score = F.when(hit, F.lit(1.0)).otherwise(F.col("relevance")) if pinned else F.col("relevance")
        return self._with(entries=met.withColumns({"relevance": score, "pinned": F.when(hit, F.lit(pinned)).otherwise(F.col("pinned"))}).select(*self.entries.columns))

    # --- maintenance

    def reap_expired(self, as_of_ms: int) -> Store:
        return self._with(entries=mutate.purge_expired(self.entries, as_of_ms))

    def reap_low(self, as_of_ms: int, per_namespace: bool = False) -> tuple[Store, DataFrame]:
        gone = reap.low_relevance(self.entries, as_of_ms, self.overrides, self.decay, per_namespace)
        return self._with(entries=mutate.delete_keys(self.entries, gone)), gone

    def evict_lru(self, capacity_per_shard: int, shard) -> Store:
        return self._with(entries=mutate.delete_keys(self.entries, capacity.evict_lru(self.entries, capacity_per_shard, shard)))

    def consolidate(self, as_of_ms: int, kind: str | None = None) -> tuple[Store, DataFrame]:
        """Run the rules, all or only ``promote`` or ``compress`` ones; needs rules to be set and consolidation to be on."""
        if not self.rules:
            raise ValueError("no consolidation rules are set")
        if not self.consolidates:
            raise ValueError("consolidation is off")
        chosen = [r for r in self.rules if kind is None or type(r).__name__.lower() == kind]
        state, report = consolidate.run_rules(self.entries, chosen, as_of_ms)
        from pyspark.sql import functions as F

        totals = consolidate.report_totals(report).withColumn("run_ms", F.lit(as_of_ms).cast("long"))
        return self._with(entries=state, history=totals if self.history is None else self.history.unionByName(totals)), report

    def with_rules(self, rules: list, enabled: bool | None = None) -> Store:
        """Other rules in place of those set, and consolidation on or off if told."""
        return self._with(rules=list(rules), consolidates=self.consolidates if enabled is None else enabled)

    def consolidation_status(self) -> DataFrame | None:
        return None if self.history is None else consolidate.accumulate_meta(self.history)

    def with_decay(self, changes: DataFrame) -> Store:
        """Decay per namespace, updated in part."""
        now = changes if self.overrides is None else merge_overrides(self.overrides, changes, self.decay)
        return self._with(overrides=now)

    def without_decay(self, namespace: str) -> Store:
        from pyspark.sql import functions as F

        return self._with(overrides=None if self.overrides is None else self.overrides.where(F.col("namespace") != namespace))

    def sweep_triggers(self, as_of_ms: int, force: bool = False) -> DataFrame:
        """Entries of the triggers that fire now; cooldowns are kept in the registry."""
        table = self.registry.table(self.spark)
        rows = materialize(triggers.matching_entries(table, self.entries, as_of_ms, force), "fired")
        self.registry.mark([r["id"] for r in triggers.fire(table, self.entries, as_of_ms, force).select("id").collect()], as_of_ms)
        return rows

    # --- sharing

    def share(self, source: str, target: str, permission: str, created_at: int, key_prefix: str | None = None) -> Store:
        return self._with(shares=sharing.grant(self.shares, source, target, permission, key_prefix, created_at))

    def unshare(self, source: str, target: str | None = None, key_prefix: str | None = None) -> Store:
        return self._with(shares=sharing.revoke_all(self.shares, source) if target is None else sharing.revoke(self.shares, source, target, key_prefix))

    def visible(self, as_of_ms: int) -> DataFrame:
        return sharing.visible_entries(self.entries, self.shares, as_of_ms)

    # --- snapshots and views

    def save(self, root: str, as_of_ms: int, keep: int = 3) -> str:
        path = snapshot.write_snapshot(self.entries, root, as_of_ms)
        snapshot.prune_snapshots(self.spark, root, keep)
        return path

    def restore(self, root: str, as_of_ms: int) -> Store:
        return self._with(entries=snapshot.restore(self.spark, root, as_of_ms, self.entries))

    def info(self, as_of_ms: int, shards: int, capacity_per_shard: int, policy: str = "reject") -> DataFrame:
        return scan.info(self.entries, as_of_ms, shards, capacity_per_shard, policy)

    def as_caller(self, token: str | None, tokens: DataFrame) -> Guarded:
        """The store as the holder of a token sees it: each command is checked first."""
        return Guarded(self, token, tokens)

    def create_views(self) -> None:
        """``entries``, ``ops`` and ``shares`` for Spark SQL."""
        for name in ("entries", "ops", "shares"):
            if getattr(self, name) is not None:
                getattr(self, name).createOrReplaceTempView(name)


#: Commands of a store that name keys, by how: whether they write, and where the namespace and the key or prefix stand.
_BY_KEY = {"get": False, "get_with_meta": False, "list": False, "search": False, "delete_namespace": True, "delete_prefix": True}
_BY_KEYS = {"mget": False, "mgett": False, "mtype": False, "batch_get": False, "relevance": False, "delete": True, "pin": True}
_BY_PREFIX = {"scan": False, "keys": False, "count": False}


class Guarded:
    """A store behind a token. Commands outside its namespaces and grants raise ``PermissionError``; those without a namespace need a token for all."""

    def __init__(self, store: Store, token: str | None, tokens: DataFrame):
        self._store, self._token, self._tokens = store, token, tokens

    def _check(self, wanted: list[tuple[str | None, str | None]], is_write: bool) -> None:
        store = self._store
        rows = [(i, self._token, ns, key, is_write) for i, (ns, key) in enumerate(wanted)]
        asked = store.spark.createDataFrame(rows, "request_id long, token string, namespace string, key string, is_write boolean")
        refused = sharing.authorize(asked, self._tokens, store.shares).where(~F.col("allowed")).select("namespace", "key").collect()
        if refused:
            raise PermissionError(f"no access to {sorted({f'{r.namespace}:{r.key or str()}' for r in refused})}")

    def __getattr__(self, name: str):
        command = getattr(self._store, name)
        if not callable(command):
            raise AttributeError(name)

        def split(full: str) -> tuple[str, str | None]:
            ns, colon, rest = full.partition(":")
            return ns, rest if colon else None

        def run(*args, **named):
            if name in _BY_KEY:
                ns = args[0] if args else named["namespace"]
                second = args[1] if len(args) > 1 else named.get("key", named.get("prefix"))
                self._check([(ns, second if name in ("get", "get_with_meta", "delete_prefix") else named.get("prefix"))], _BY_KEY[name])
            elif name in _BY_KEYS:
                self._check([split(k) for k in (args[0] if args else named["keys"])], _BY_KEYS[name])
            elif name in _BY_PREFIX:
                self._check([split((args[0] if args else next(iter(named.values()))).rstrip("*"))], _BY_PREFIX[name])
            elif name == "put":
                writes = args[0] if args else named["writes"]
                self._check([(r["namespace"], r["key"]) for r in writes.select("namespace", "key").collect()], True)
            else:
                self._check([("*", None)], True)
            out = command(*args, **named)
            return Guarded(out, self._token, self._tokens) if isinstance(out, Store) else out

        return run
