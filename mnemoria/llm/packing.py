"""Filling fixed-capacity containers with texts."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .batches import by_size

#: Folder of the public tokenizers' vocabulary files; the same path on every executor.
TOKENIZER_DIR = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: How the byte-level vocabularies split a text before merging (fixed value).
SPLIT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
OPEN_BINS = 64
#: Tokens that one task packs. Each task leaves at most OPEN_BINS containers not full.
SHARD_TOKENS = 8_000_000


@lru_cache(2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("byte_bpe", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, id_column: str, text_column: str, vocabulary: str | None = None) -> DataFrame:
    """``(id, n_tokens, digest)`` for each row, whole texts counted where they are scanned; a null text has 0 tokens. ``digest`` is a hash of the text."""
    path = vocabulary or f"{TOKENIZER_DIR}/{VOCABULARY}"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(path).encode_ordinary
        for batch in by_size(batches, "text"):
            sizes = [len(encode(t)) if t else 0 for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes, pa.int64()), batch.column("digest")], ["id", "n_tokens", "digest"])

    slim = df.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"), F.xxhash64(text_column).alias("digest"))
    return slim.mapInArrow(count, "id long, n_tokens long, digest long")


class OpenBins:
    """At most ``limit`` open bins; a bitset over free space finds the tightest that fits.

    Bit f of the bitset is set while a bin with f tokens free is open. The lowest
    set bit at or above an item's size is the best fit; the lowest of all is the
    fullest bin, which closes first when another must open.
    """

    def __init__(self, capacity: int, limit: int = OPEN_BINS):
        self.capacity, self.limit = capacity, limit
        self.bits, self.open, self.made = 0, 0, 0
        self.by_free: dict[int, list[int]] = {}

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        name = bins.pop()
        if not bins:
            self.bits ^= 1 << free
        self.open -= 1
        return name

    def put(self, size: int) -> int:
        """The number of the bin that an item of at most ``capacity`` goes to."""
        fitting = self.bits >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            name = self._take(free)
        else:
            if self.open >= self.limit:
                self._take((self.bits & -self.bits).bit_length() - 1)
            name, free = self.made, self.capacity
            self.made += 1
        left = free - size
        if left:
            self.bits |= 1 << left
            self.by_free.setdefault(left, []).append(name)
            self.open += 1
        return name


def pack_sizes(sizes: list[int], capacity: int, limit: int = OPEN_BINS) -> list[tuple[int, int, int, int]]:
    """``(item, part, first, bin)`` of each piece, items in the order given; only items over the capacity are split."""
    bins, out = OpenBins(capacity, limit), []
    for item, size in enumerate(sizes):
        part, first = 0, 0
        while size - first > capacity:
            out.append((item, part, first, bins.made))
            bins.made += 1
            part, first = part + 1, first + capacity
        out.append((item, part, first, bins.put(size - first)))
    return out


def pack(df: DataFrame, id_column: str, text_column: str, capacity: int = 2048, vocabulary: str | None = None, open_bins: int = OPEN_BINS) -> DataFrame:
    """``(id, part, first_token, n_tokens, container)``: every text assigned to containers of ``capacity`` tokens.

    A text that fits into one container is never split; a longer one fills whole
    containers and its last piece is packed like a text. Null and empty texts
    have no tokens and go where there is room; rows with equal ids are texts of
    their own. An empty table gives no rows; other columns aren't read.

    Texts are counted where they are scanned, and only ids and sizes move. The
    rows are dealt by a hash of id and size into shards of bounded size, more of
    them for more data; each shard packs online, in the order of that hash.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    counts = materialize(token_counts(df, id_column, text_column, vocabulary), "pack-counts")
    tokens, rows = counts.agg(F.sum("n_tokens"), F.count(F.lit(1))).first()
    # rows without tokens weigh a little too, so that a shard of empty texts stays small
    shards = max(1, -(-((tokens or 0) + 16 * rows) // SHARD_TOKENS))
    # by what the row is and not by where it stands, so that the result doesn't depend on how files are split
    mixed = F.xxhash64("id", "n_tokens", "digest")
    dealt = counts.withColumn("mixed", mixed).withColumn("shard", F.pmod("mixed", F.lit(shards)))

    def one(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values(["mixed", "id"], kind="stable")
        ids, sizes, number = shard["id"].to_numpy(), shard["n_tokens"].tolist(), int(shard["shard"].iloc[0])
        pieces = pack_sizes(sizes, capacity, open_bins)
        out = pd.DataFrame(pieces, columns=["item", "part", "first_token", "bin"])
        out["id"] = ids[out["item"]]
        size = shard["n_tokens"].to_numpy()[out["item"]]
        out["n_tokens"] = (size - out["first_token"]).clip(upper=capacity)
        out["container"] = (number << 32) + out["bin"]
        return out[["id", "part", "first_token", "n_tokens", "container"]]

    return dealt.groupBy("shard").applyInPandas(one, "id long, part long, first_token long, n_tokens long, container long")


def container_fill(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """``(container, texts, n_tokens, free)`` of each container."""
    sums = packed.groupBy("container").agg(F.count(F.lit(1)).alias("texts"), F.sum("n_tokens").alias("n_tokens"))
    return sums.withColumn("free", F.lit(capacity) - F.col("n_tokens"))
