"""Settings of a store, as a dataclass and from a TOML file."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, fields

from .functions.keys import next_power_of_two
from .functions.relevance import Decay
from .operators.capacity import Policy
from .operators.consolidate import Compress, Promote


@dataclass(frozen=True)
class Settings:
    """What a store is run with. Times are in milliseconds."""

    shards: int = 64
    capacity_per_shard: int = 1_000_000
    policy: Policy = Policy.REJECT
    decay: Decay = Decay()
    snapshot_root: str | None = None
    snapshots_kept: int = 3
    log_kept: int = 50_000
    apply_type_default_ttl: bool = False
    rules: tuple[Promote | Compress, ...] = field(default=())

    def __post_init__(self):
        object.__setattr__(self, "shards", next_power_of_two(self.shards))
        if self.capacity_per_shard < 1 or self.snapshots_kept < 0 or self.log_kept < 0:
            raise ValueError("capacities and numbers kept can't be negative")


_RULES = {"promote": Promote, "compress": Compress}


def from_toml(text: str) -> Settings:
    """``[store]``, ``[decay]`` and ``[[rules]]`` tables; unknown names are refused."""
    data = tomllib.loads(text)
    unknown = set(data) - {"store", "decay", "rules"}
    store, decay = data.get("store", {}), data.get("decay", {})
    unknown |= set(store) - {f.name for f in fields(Settings)} | set(decay) - {f.name for f in fields(Decay)}
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    if "policy" in store:
        store["policy"] = Policy.parse(store["policy"])
    rules = []
    for rule in data.get("rules", []):
        kind = rule.pop("type", None)
        if kind not in _RULES:
            raise ValueError(f"a rule's type is promote or compress, not {kind!r}")
        rules.append(_RULES[kind](**rule))
    return Settings(**store, decay=Decay(**decay), rules=tuple(rules))
