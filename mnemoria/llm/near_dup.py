"""Near-duplicate records with small edits: an exact set-similarity join by universe partition."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import skewed_lookup
from ..session import discard, materialize
from .batches import by_size
from .folding import fields, mix
from .words import shingles, word_hashes

#: Counters of token frequencies, in two rows: 4 MB in each task while counting, one byte each where they are read.
COUNTERS = 1 << 20
_CHUNKS = 32
#: Partitions whose counts are added in one group.
GROUP_PARTS = 64
_MOST = np.iinfo(np.uint16).max
#: Coverage beyond the pigeonhole's bound that a record asks for, so that candidates must agree in more than one segment.
SLACK = 3
#: Records of sizes below 2 ** SINGLE_BANDS have each token as a segment of its own.
SINGLE_BANDS = 4
#: Segments for each one that an allocation of one deletion everywhere would need.
SPARE = 1.5
#: Records of one signature that meet in one task; beyond it they are dealt by a salt.
HOT_RECORDS = 8192
#: From this similarity on a segment holds two tokens or more on average and its whole subset is indexed; below, its subsets of two are.
WHOLE_FROM = 2 / 3
#: Tokens with at most so many records are subsets of their own where subsets of two are indexed.
RARE = 4
#: Cost of a subset that is empty: more than any count.
_NEVER = 1e12
#: Bits of the table of tokens that records without a segment allocation look for.
WANTED_BITS = 1 << 21


def token_sets(values: list[str], kinds: list[str | None], words_per_shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each value the set of its shingles, tied to its kind, as sorted 64-bit tokens; their bounds; the numbers of words."""
    hashes, bounds = word_hashes(values)
    grams, gram_bounds = shingles(hashes, bounds, words_per_shingle)
    salt = {k: np.uint64(hash_text(k)) for k in set(kinds)}
    owner = np.repeat(np.arange(len(values)), np.diff(gram_bounds))
    with np.errstate(over="ignore"):
        tokens = mix(grams + np.array([salt[k] for k in kinds], np.uint64)[owner])
    order = np.lexsort((tokens, owner))
    tokens, owner = tokens[order], owner[order]
    first = np.ones(len(tokens), bool)
    first[1:] = (tokens[1:] != tokens[:-1]) | (owner[1:] != owner[:-1])
    tokens, owner = tokens[first], owner[first]
    return tokens, np.searchsorted(owner, np.arange(len(values) + 1)), np.diff(bounds)


_SETS = "id string, s1 long, s2 long, value string, kind string, uneven boolean, chunk int, counts binary"


def _sets(words_per_shingle: int, least_words: int, similarity: float, spare: float):
    """Eligible values with 128 bits of their token sets; after the last one of a partition, its counts of tokens."""
    kinds_of = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.int32(), pa.binary()]
    names = [x.split()[0] for x in _SETS.split(", ")]

    def batch_of(**columns) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([columns[c] if isinstance(columns.get(c), pa.Array) else pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in zip(names, kinds_of)], names)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, COUNTERS), np.int64)
        for batch in by_size(batches, "value"):
            values, kinds = batch.column("value").to_pylist(), batch.column("kind").to_pylist()
            keep = [i for i, v in enumerate(values) if fields(v) is None]
            tokens, bounds, n_words = token_sets([values[i] for i in keep], [kinds[i] for i in keep], words_per_shingle)
            enough = n_words >= least_words
            # sums over a set don't depend on the order of its tokens
            with np.errstate(over="ignore"):
                sums = [np.concatenate([[np.uint64(0)], np.cumsum(mix(tokens + np.uint64(x)), dtype=np.uint64)]) for x in (0, 77)]
                s1, s2 = (x[bounds[1:]] - x[bounds[:-1]] for x in sums)
            chosen = tokens[np.repeat(enough, np.diff(bounds))]
            for row in (0, 1):
                total[row] += np.bincount(_slot(chosen, row), minlength=COUNTERS)
            uneven = ~covered(tokens, bounds, similarity, spare) if similarity >= WHOLE_FROM else np.zeros(len(keep), bool)
            rows = pa.array(np.array(keep, np.int64)[enough])
            yield batch_of(id=batch.column("id").take(rows), s1=pa.array(s1[enough].view(np.int64)), s2=pa.array(s2[enough].view(np.int64)), value=batch.column("value").take(rows), kind=batch.column("kind").take(rows), uneven=pa.array(uneven[enough]))
        if total.any():
            parts = np.minimum(total, _MOST).astype(np.uint16).reshape(_CHUNKS, -1)
            yield batch_of(chunk=list(range(_CHUNKS)), counts=[p.tobytes() for p in parts])

    return sets


def hash_text(text: str | None) -> int:
    """A hash of a short string that is the same in every process."""
    out = 1469598103934665603
    for byte in ("\0" if text is None else text).encode():
        out = ((out ^ byte) * 1099511628211) & 0x7FFFFFFFFFFFFFFF
    return out


def _slot(tokens: np.ndarray, row: int) -> np.ndarray:
    return ((tokens >> np.uint64(7 + 25 * row)) & np.uint64(COUNTERS - 1)).astype(np.int64)


#: Steps of the logarithm in which counts are kept: each is exact up to 4 and within 4.5 % beyond.
_STEPS = 8


def _levels(counts: np.ndarray) -> np.ndarray:
    return np.minimum(np.ceil(_STEPS * np.log2(np.maximum(counts, 1)) - 1e-9), 255).astype(np.uint8)


def _add_counts(kind: type, last: bool):
    def add(part: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(2 * COUNTERS // _CHUNKS, np.int64)
        for counts in part["counts"]:
            total += np.frombuffer(counts, kind)
        return pd.DataFrame({"chunk": part["chunk"].iloc[:1].astype("int32"), "counts": [(_levels(total) if last else total).tobytes()]})

    return add


def token_frequencies(counted: DataFrame) -> np.ndarray:
    """Upper bounds of how many values hold each token, as logarithms in a table of fixed size.

    The counts of partitions are added in two rounds if there are many, so that no group
    holds more than about the square root of their number. Tokens share counters and the smaller of two
    holds, so a count is never too small. Counts tell what is cheap to look for and what
    no other value has; results don't depend on them.
    """
    n = counted.rdd.getNumPartitions()
    kind: type = np.uint16
    if n > GROUP_PARTS:
        parts = counted.withColumn("deal", F.spark_partition_id() % round(n**0.5))
        counted, kind = parts.groupBy("chunk", "deal").applyInPandas(_add_counts(np.uint16, False), "chunk int, counts binary"), np.int64
    out = np.zeros((_CHUNKS, 2 * COUNTERS // _CHUNKS), np.uint8)
    for row in counted.groupBy("chunk").applyInPandas(_add_counts(kind, True), "chunk int, counts binary").collect():
        out[row["chunk"]] = np.frombuffer(row["counts"], np.uint8)
    return out.reshape(2, COUNTERS)


_COUNT_OF = 2.0 ** (np.arange(256) / _STEPS)


def _level(levels: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    return np.minimum(*(levels[row][_slot(tokens, row)] for row in (0, 1)))


def _often(levels: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Counts of tokens: 1 for those that no other value has."""
    return _COUNT_OF[_level(levels, tokens)]


def band_of(sizes: np.ndarray) -> np.ndarray:
    """Size bands: of 2 ** band to 2 ** (band + 1) - 1 tokens."""
    return np.floor(np.log2(np.maximum(sizes, 1))).astype(np.int64)


def distance(a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """The most tokens by which similar sets of ``a`` and ``b`` tokens differ."""
    return np.floor((1 - similarity) / (1 + similarity) * (a + b) + 1e-9).astype(np.int64)


def segments_of(band: np.ndarray, similarity: float, spare: float = SPARE) -> np.ndarray:
    """Segments of the token universe for a band; 0 means that each token is one."""
    top = 2 ** (band + 1) - 1
    most = distance(np.floor(top / similarity), top, similarity)
    return np.where(band < SINGLE_BANDS, 0, np.maximum(np.ceil(spare * (most + 1) / 2), 1)).astype(np.int64)


def _segment(tokens: np.ndarray, segments: np.ndarray) -> np.ndarray:
    return np.where(segments == 0, mix(tokens), (mix(tokens) >> np.uint64(11)) % np.maximum(segments, 1).astype(np.uint64))


def _bound(sizes: np.ndarray, down: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """For records that look for smaller ones in their own band (``down`` 0) or the next lower: the distance to allow, and whether any can be similar there."""
    top = np.where(down == 0, sizes, 2 ** band_of(sizes) - 1)
    return distance(sizes, top, similarity), (top >= similarity * sizes - 1e-9) & (sizes > 0)


def covered(tokens: np.ndarray, bounds: np.ndarray, similarity: float, spare: float = SPARE) -> np.ndarray:
    """Records whose tokens fall evenly enough for an allocation in every band that they look into."""
    sizes, out = np.diff(bounds), np.ones(len(bounds) - 1, bool)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    for down in (0, 1):
        segment = _segment(tokens, segments_of(band_of(sizes) - down, similarity, spare)[owner])
        order = np.lexsort((segment, owner))
        run = np.flatnonzero(np.concatenate([[True], (owner[order][1:] != owner[order][:-1]) | (segment[order][1:] != segment[order][:-1])])) if len(order) else np.zeros(0, np.int64)
        reach = np.bincount(owner[order][run], weights=np.minimum(np.diff(np.append(run, len(order))), 2), minlength=len(sizes))
        most, any_there = _bound(sizes, down, similarity)
        out &= (reach > most) | ~any_there
    return out


#: Of a signature: it is a subset after one deletion; it is indexed; it is looked for; its segment allows a deletion. Then the coverage to reach, and above all the size.
DELETED, INDEXED, SOUGHT, LOOSE = 1, 2, 4, 8
#: In the plan by pairs, where nothing is deleted: the record is of the band below.
BELOW = LOOSE
_REACH_SHIFT, _SIZE_SHIFT = 4, 8
_SIGNATURES = "signature long, no long, info long"


def _rows(signature: np.ndarray, numbers: np.ndarray, info: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(signature.view(np.int64)), pa.array(numbers), pa.array(info.astype(np.int64))], ["signature", "no", "info"])


class _Subsets:
    """Subsets of records by segment, whole and after each deletion, with hashes and upper bounds of how many records have them."""

    def __init__(self, tokens: np.ndarray, often: np.ndarray, owner: np.ndarray, band: np.ndarray, similarity: float, spare: float):
        segment = _segment(tokens, segments_of(band, similarity, spare)[owner])
        order = np.lexsort((often, segment, owner))
        tokens, often, owner, segment = tokens[order], often[order], owner[order], segment[order]
        new = np.ones(len(tokens), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (segment[1:] != segment[:-1])
        starts = np.flatnonzero(new)
        size = np.diff(np.append(starts, len(tokens)))
        self.owner, self.size, self.of = owner[starts], size, np.repeat(np.arange(len(starts)), size)
        with np.errstate(over="ignore"):
            sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(tokens + np.uint64(5)), dtype=np.uint64)])
            whole = sums[starts + size] - sums[starts]
            place = mix(segment[starts] * np.uint64(0x9E3779B97F4A7C15) + band[self.owner].astype(np.uint64))
            self.whole, self.deleted = mix(whole ^ place), mix((whole[self.of] - mix(tokens + np.uint64(5))) ^ place[self.of])
        # the rarest token of each subset; tokens are sorted by count
        self.whole_often = often[starts]
        second = np.where(size > 1, often[np.minimum(starts + 1, max(0, len(often) - 1))], _NEVER) if len(often) else often
        self.deleted_often = np.where(new, second[self.of], self.whole_often[self.of])
        self.there = (self.size > 1)[self.of] & (self.deleted_often > 1)

    def allocate(self, need: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each segment -1 (left out), 0 (whole) or 1 (one deletion), at the least cost with a coverage of ``need`` per record; and the coverage reached.

        A segment that is looked for whole covers one token of difference, with one
        deletion two. Its cost is how many records are met. Both steps of all
        segments are taken by cost until the coverage is there; the second step
        of a segment never costs less than the first. A subset with a token that
        no other record has covers its step for nothing.
        """
        first = np.where(self.whole_often > 1, self.whole_often, 0)
        second = np.bincount(self.of, weights=np.where(self.there, self.deleted_often, 0), minlength=len(first))
        second = np.where(self.size > 1, np.maximum(first, second), _NEVER)
        n = len(first)
        cost, owner, which = np.concatenate([first, second]), np.tile(self.owner, 2), np.tile(np.arange(n), 2)
        order = np.lexsort((np.arange(2 * n), cost, owner))
        cost, owner, which, step = cost[order], owner[order], which[order], (order >= n).astype(np.int64)
        starts = np.searchsorted(owner, np.arange(len(need)))
        taken = (np.arange(2 * n) - starts[owner] < need[owner]) & (cost < _NEVER)
        chosen = np.full(n, -1)
        np.maximum.at(chosen, which[taken], step[taken])
        return chosen, np.bincount(owner[taken], minlength=len(need))


def _deal(signature: np.ndarray, often: np.ndarray, info: np.ndarray, numbers: np.ndarray, hot: int) -> Iterator[pa.RecordBatch]:
    """Rows of signatures; a hot one is salted: who looks for it goes to one of its parts, who is indexed under it to all of them.

    How many parts there are follows from the subset alone, so both sides agree.
    """
    parts = 2 ** np.maximum(0, np.ceil(np.log2(np.clip(often, 1, 2.0**31) / hot))).astype(np.int64)
    cool = parts == 1
    yield _rows(signature[cool], numbers[cool], info[cool])
    if cool.all():
        return
    signature, parts, info, numbers = signature[~cool], parts[~cool], info[~cool], numbers[~cool]
    with np.errstate(over="ignore"):
        sought = (info & SOUGHT) > 0
        own = mix(numbers.astype(np.uint64) + np.uint64(31)) % parts.astype(np.uint64)
        yield _rows(mix(signature + own + np.uint64(1))[sought], numbers[sought], info[sought] & ~INDEXED)
        indexed = (info & INDEXED) > 0
        rows = np.repeat(np.flatnonzero(indexed), parts[indexed])
        salt = np.arange(len(rows)) - np.repeat(np.cumsum(parts[indexed]) - parts[indexed], parts[indexed])
        yield _rows(mix(signature[rows] + salt.astype(np.uint64) + np.uint64(1)), numbers[rows], info[rows] & ~SOUGHT)


def _signatures(frequencies, wanted, words_per_shingle: int, similarity: float, spare: float, hot: int):
    """What each record is indexed under and what it looks for."""

    def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = frequencies.value
        table = None if wanted.value is None else np.unpackbits(wanted.value).astype(bool)
        for batch in by_size(batches, "value", limit=2_000_000):
            tokens, bounds, _ = token_sets(batch.column("value").to_pylist(), batch.column("kind").to_pylist(), words_per_shingle)
            sizes, numbers = np.diff(bounds), np.asarray(batch.column("no"))
            uneven = np.asarray(batch.column("uneven")).astype(bool)
            owner, often = np.repeat(np.arange(len(sizes)), sizes), _often(levels, tokens)
            size_bits = sizes.astype(np.int64) << _SIZE_SHIFT
            for down in (0, 1):
                most, any_there = _bound(sizes, down, similarity)
                looks = any_there & ~uneven
                use = np.ones(len(tokens), bool) if down == 0 else looks[owner]
                made = _Subsets(tokens[use], often[use], owner[use], band_of(sizes) - down, similarity, spare)
                chosen, reached = made.allocate(np.where(looks, most + 1 + SLACK, 0))
                reach = np.clip(reached - most, 1, SLACK + 1).astype(np.int64) << _REACH_SHIFT
                base = size_bits + reach
                for deleted, chosen_of, who, signature, count, there in (
                    (0, chosen, made.owner, made.whole, made.whole_often, made.whole_often > 1),
                    (DELETED, chosen[made.of], made.owner[made.of], made.deleted, made.deleted_often, made.there),
                ):
                    info = base[who] + deleted + np.where(chosen_of >= (1 if deleted else 0), SOUGHT, 0) + np.where(chosen_of == 1, LOOSE, 0) + (INDEXED if down == 0 else 0)
                    there = there & ((info & (INDEXED | SOUGHT)) > 0)
                    yield from _deal(signature[there], count[there], info[there], numbers[who[there]], hot)
            if table is not None:
                # tokens by themselves, for the few records whose tokens crowd in too few segments
                single = mix(tokens ^ np.uint64(0x5851F42D4C957F2D))
                asked = table[(tokens & np.uint64(WANTED_BITS - 1)).astype(np.int64)]
                info = np.full(len(tokens), INDEXED) + (1 << _REACH_SHIFT) + size_bits[owner]
                info += np.where(uneven[owner] & _asked_for(sizes, bounds, owner, similarity), SOUGHT, 0)
                yield from _deal(single[asked], often[asked], info[asked], numbers[owner[asked]], hot)

    return signatures


def pair_plan(size: np.ndarray, band: np.ndarray, own: bool, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(segments, ignored, reach)`` for records of ``size`` tokens among those of sizes 2 ** band to 2 ** (band + 1).

    Similar records share at least o = t / (1 + t) times the sum of their sizes. A record
    leaves out its ``ignored`` most frequent tokens; as all records order tokens
    alike, no more of the shared tokens than the larger of both numbers are lost. If
    each of m segments held at most one shared token then o would be at most m +
    ignored. As m + ignored = o - reach, at least ``reach`` pairs of shared tokens
    fall into common segments. Small records have no segments: each token stands alone.
    """
    low = 1 << np.maximum(band, 0)
    # in its own band a record may meet a smaller one; from the band below it meets at least `low` tokens
    least = similarity * size if own else similarity / (1 + similarity) * (size + low)
    shared = np.ceil(least - 1e-9).astype(np.int64)
    single = band < SINGLE_BANDS - 1
    segments, reach = np.where(single, 0, low // 4), np.where(single, 1, np.minimum(low // 8, 4))
    return segments, shared - reach - segments, reach


_PAIRS = "signature long, who long"
_WHO_SHIFT = 8


def _pair_rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Record and flags in one number."""
    for part in parts:
        who = (np.asarray(part.column("no")) << _WHO_SHIFT) | np.asarray(part.column("info"))
        yield pa.RecordBatch.from_arrays([part.column("signature"), pa.array(who)], ["signature", "who"])


def _pair_signatures(frequencies, words_per_shingle: int, similarity: float, hot: int):
    """Subsets of two tokens of each segment, and rare tokens, of each record in the band of its size and in the next one."""

    def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = frequencies.value
        for batch in by_size(batches, "value", limit=2_000_000):
            tokens, bounds, _ = token_sets(batch.column("value").to_pylist(), batch.column("kind").to_pylist(), words_per_shingle)
            sizes, numbers = np.diff(bounds), np.asarray(batch.column("no"))
            owner, level = np.repeat(np.arange(len(sizes)), sizes), _level(levels, tokens)
            # a record's tokens are sorted already, so that equal counts stay in the order of tokens
            order = np.argsort((owner << 8) | level, kind="stable")
            tokens, often = tokens[order], _COUNT_OF[level[order]]
            place = np.arange(len(tokens)) - np.repeat(bounds[:-1], sizes)
            for up in (0, 1):
                band = band_of(sizes) + up
                segments, ignored, reach = pair_plan(sizes, band, up == 0, similarity)
                info = INDEXED + (SOUGHT if up == 0 else BELOW) + (reach << _REACH_SHIFT)
                # the most frequent tokens are what a record may ignore; a token of one record only is never shared
                keep = (place < (sizes - ignored)[owner]) & (often > 1)
                kept, who, count = tokens[keep], owner[keep], often[keep]
                rare = (count <= RARE) | (segments[who] == 0)
                alone = mix(kept[rare] ^ mix(band[who[rare]].astype(np.uint64) + np.uint64(1)))
                yield from _pair_rows(_deal(alone, count[rare], info[who[rare]], numbers[who[rare]], hot))
                kept, who, count = kept[~rare], who[~rare], count[~rare]
                if not len(kept):
                    continue
                segment = (mix(kept) >> np.uint64(11)) % segments[who].astype(np.uint64)
                order = np.lexsort((kept, (who.astype(np.uint64) << np.uint64(32)) | segment))
                kept, who, segment, count = kept[order], who[order], segment[order], count[order]
                starts = np.flatnonzero(np.concatenate([[True], (who[1:] != who[:-1]) | (segment[1:] != segment[:-1])]))
                size = np.diff(np.append(starts, len(kept)))
                later = np.repeat(starts + size, size) - np.arange(len(kept)) - 1
                left = np.repeat(np.arange(len(kept)), later)
                right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(later) - later, later)
                with np.errstate(over="ignore"):
                    pair = mix(mix(kept[left]) * np.uint64(0x9E3779B97F4A7C15) + kept[right])
                pair = mix(pair ^ mix(band[who[left]].astype(np.uint64) + np.uint64(101)))
                yield from _pair_rows(_deal(pair, np.minimum(count[left], count[right]), info[who[left]], numbers[who[left]], hot))

    return signatures


def _asked_for(sizes: np.ndarray, bounds: np.ndarray, owner: np.ndarray, similarity: float) -> np.ndarray:
    """So many tokens of each record that a similar one, however it is chosen, has one of them."""
    common = np.ceil(similarity * sizes - 1e-9).astype(np.int64)
    return np.arange(len(owner)) - bounds[:-1][owner] < (sizes - common + 1)[owner]


def _wanted(words_per_shingle: int, similarity: float):
    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(WANTED_BITS, bool)
        for batch in by_size(batches, "value"):
            tokens, bounds, _ = token_sets(batch.column("value").to_pylist(), batch.column("kind").to_pylist(), words_per_shingle)
            sizes = np.diff(bounds)
            asked = _asked_for(sizes, bounds, np.repeat(np.arange(len(sizes)), sizes), similarity)
            table[(tokens[asked] & np.uint64(WANTED_BITS - 1)).astype(np.int64)] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(table).tobytes()])], ["bits"])

    return wanted


def _wanted_tokens(records: DataFrame, words_per_shingle: int, similarity: float) -> np.ndarray | None:
    """A table of fixed size of the tokens that uneven records look for; None if there are no such records."""
    uneven = records.where("uneven")
    if uneven.limit(1).count() == 0:
        return None
    tables = uneven.select("value", "kind").mapInArrow(_wanted(words_per_shingle, similarity), "bits binary")
    merged = tables.withColumn("deal", F.spark_partition_id() % 64).groupBy("deal").applyInPandas(lambda x: pd.DataFrame({"bits": [np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in x["bits"]]).tobytes()]}), "bits binary")
    return np.bitwise_or.reduce([np.frombuffer(r["bits"], np.uint8) for r in merged.collect()])


def _similarities(words_per_shingle: int):
    """Exact similarity of the two values of each candidate."""

    def similarities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_size(batches, "value_1", "value_2"):
            kinds, n = batch.column("kind").to_pylist(), batch.num_rows
            sides = [token_sets(batch.column(c).to_pylist(), kinds, words_per_shingle) for c in ("value_1", "value_2")]
            sizes = [np.diff(bounds) for _, bounds, _ in sides]
            tokens = np.concatenate([t for t, *_ in sides])
            owner = np.concatenate([np.repeat(np.arange(n), s) for s in sizes])
            order = np.lexsort((tokens, owner))
            tokens, owner = tokens[order], owner[order]
            twice = (tokens[1:] == tokens[:-1]) & (owner[1:] == owner[:-1])
            common = np.bincount(owner[1:][twice], minlength=n)
            score = common / np.maximum(sizes[0] + sizes[1] - common, 1)
            yield pa.RecordBatch.from_arrays([batch.column("rep_1"), batch.column("rep_2"), pa.array(score, pa.float64())], ["rep_1", "rep_2", "similarity"])

    return similarities


def candidates_of(rows: DataFrame, similarity: float) -> DataFrame:
    """``(no, no_b)``: records whose subsets agree to a coverage that similar ones reach.

    The larger of two records looks for the smaller. Agreement of a whole subset
    covers what its segment was allotted, agreement after one deletion, on one side
    only, covers one. One shuffle serves who looks and who is indexed: each side's own
    condition is tied to the partition, so that it isn't moved below the shuffle and
    doesn't make two of it.
    """
    bit = lambda c, x: F.col(c).bitwiseAND(F.lit(x).cast("long"))
    here = lambda condition: F.when(F.spark_partition_id() >= 0, condition)
    a = rows.where(here(bit("info", SOUGHT) > 0))
    b = rows.where(here(bit("info", INDEXED) > 0)).select(F.col("signature").alias("signature_b"), F.col("no").alias("no_b"), F.col("info").alias("info_b"))
    size, size_b = F.shiftright("info", _SIZE_SHIFT), F.shiftright("info_b", _SIZE_SHIFT)
    deletions = bit("info", DELETED) + bit("info_b", DELETED)
    fits = (deletions == 0) | ((deletions == 1) & (bit("info", LOOSE) + deletions > LOOSE))
    larger = (size > size_b) | ((size == size_b) & ((F.col("no") > F.col("no_b")) | ((size_b == 0) & (bit("info_b", BELOW) > 0))))
    near = size_b >= F.lit(similarity) * size - 1e-9
    met = a.hint("merge").join(b, (F.col("signature") == F.col("signature_b")) & fits & larger & near)
    covers = F.when((deletions == 0) & (bit("info", LOOSE) > 0), 2).otherwise(1)
    reach = F.shiftright(bit("info", 15 << _REACH_SHIFT), _REACH_SHIFT)
    agreed = met.groupBy("no", "no_b", reach.alias("reach")).agg(F.sum(covers).alias("n")).where(F.col("n") >= F.col("reach"))
    return agreed.select("no", "no_b").distinct()


def near_duplicates(df: DataFrame, id_column: str, value_column: str, kind_column: str, words_per_shingle: int = 5, similarity: float = 0.8, least_words: int = 12, spare: float = SPARE, hot_records: int = HOT_RECORDS) -> tuple[DataFrame, DataFrame]:
    """Pairs of classes ``(rep_a, rep_b, similarity)`` and members ``(id, rep)`` of all classes.

    Records are similar if their kinds are equal and the sets of their word
    shingles have a Jaccard similarity of at least ``similarity`` (0.5 or more).
    Records with one and the same set are a class, named by its smallest id;
    pairs are given between classes, in both columns by id, each pair once. Lists
    of fields, null values, values of fewer than ``least_words`` words and rows
    with a null id take no part; a null kind equals a null kind. An empty table
    gives two empty results; other columns aren't read.

    The join is exact (but for 64-bit hash collisions of words). Two plans split the
    token universe into segments. From a similarity of ``WHOLE_FROM`` on, where segments
    hold several tokens: similar sets of a and b tokens differ in at most H = (1 - t) / (1 + t) * (a + b) of them. The token
    universe is hashed into segments, more of them for each higher size band. Each record
    is indexed, in its own band, by the whole subset of each segment and by the
    subsets after one deletion; it looks for smaller ones in its own band and the next
    lower. It chooses for each segment whether to ask for it whole (which covers one
    token of difference), with one deletion (two), or not at all, at the least
    counted cost, until H + 1 + ``SLACK`` tokens are covered: then similar records agree
    in segments that cover more than ``SLACK``. The few records whose tokens crowd in
    too few segments to reach H + 1 look for single tokens instead, which are indexed only
    as far as such records ask for them. Below ``WHOLE_FROM`` a whole subset would be one
    token, which too many records have: subsets of two tokens of a segment are indexed
    instead (see ``pair_plan``; of a segment of three these are its one-deletion
    neighbours), and the costliest tokens left out. Candidates are compared exactly.
    ``spare`` sets how many segments there are and ``hot_records`` how many records of one
    signature meet in a task; neither changes the result.
    """
    if not 0.5 <= similarity <= 1 or least_words < words_per_shingle:
        raise ValueError("similarity must be 0.5 to 1, and records have at least one shingle")
    spark = df.sparkSession
    slim = df.select(F.col(id_column).cast("string").alias("id"), F.col(value_column).alias("value"), F.col(kind_column).cast("string").alias("kind")).where(F.col("id").isNotNull() & F.col("value").isNotNull())
    sets = materialize(slim.mapInArrow(_sets(words_per_shingle, least_words, similarity, spare), _SETS), "near-sets")
    frequencies = spark.sparkContext.broadcast(token_frequencies(sets.where(F.col("chunk").isNotNull()).select("chunk", "counts")))
    rows = sets.where(F.col("id").isNotNull())
    classes = rows.groupBy("s1", "s2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"), F.min_by(F.struct("value", "kind", "uneven"), "id").alias("x"))
    records = materialize(classes.select(F.monotonically_increasing_id().alias("no"), "rep", "n", "s1", "s2", "x.value", "x.kind", "x.uneven"), "near-records")
    copied = skewed_lookup(rows.select("id", "s1", "s2"), records.where(F.col("n") > 1).select("s1", "s2", "rep"), ["s1", "s2"]).select("id", "rep")
    members = materialize(copied.unionByName(records.where(F.col("n") == 1).select(F.col("rep").alias("id"), "rep")), "near-members")
    discard(sets)
    if similarity >= WHOLE_FROM:
        wanted = spark.sparkContext.broadcast(_wanted_tokens(records, words_per_shingle, similarity))
        signed = records.select("no", "value", "kind", "uneven").mapInArrow(_signatures(frequencies, wanted, words_per_shingle, similarity, spare, hot_records), _SIGNATURES).repartition("signature")
    else:
        paired = records.select("no", "value", "kind").mapInArrow(_pair_signatures(frequencies, words_per_shingle, similarity, hot_records), _PAIRS).repartition("signature")
        signed = paired.select("signature", F.shiftright("who", _WHO_SHIFT).alias("no"), F.col("who").bitwiseAND(F.lit(255).cast("long")).alias("info"))
    candidates = materialize(candidates_of(signed, similarity), "near-candidates")
    # texts move, not token sets, which are larger and don't compress
    left = records.select("no", F.col("rep").alias("rep_1"), F.col("value").alias("value_1"), "kind")
    right = records.select(F.col("no").alias("no_b"), F.col("rep").alias("rep_2"), F.col("value").alias("value_2"))
    both = candidates.join(left, "no").join(right, "no_b").select("rep_1", "rep_2", "value_1", "value_2", "kind")
    pairs = both.mapInArrow(_similarities(words_per_shingle), "rep_1 string, rep_2 string, similarity double").where(F.col("similarity") >= similarity)
    pairs = pairs.select(F.least("rep_1", "rep_2").alias("rep_a"), F.greatest("rep_1", "rep_2").alias("rep_b"), "similarity")
    return materialize(pairs, "near-pairs"), members


def expand_pairs(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """``(key_a, key_b)``: all pairs of ids, within classes and between paired ones.

    Only for a result that is defined as all pairs; it grows with the square of a class.
    """
    a, b = members.select(F.col("rep").alias("rep_a"), F.col("id").alias("x")), members.select(F.col("rep").alias("rep_b"), F.col("id").alias("y"))
    many = members.groupBy("rep").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select(F.col("rep").alias("rep_a"))
    within = a.join(many, "rep_a").join(b, F.col("rep_a") == F.col("rep_b")).where(F.col("x") < F.col("y"))
    across = pairs.join(a, "rep_a").join(b, "rep_b")
    return within.select("x", "y").unionByName(across.select("x", "y")).select(F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b"))


def classes_with_links(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """``(id, rep, copies, links)``: each record once, with its class, the rows of the class and the classes it is similar to."""
    ends = pairs.select(F.explode(F.array("rep_a", "rep_b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("links"))
    sizes = members.groupBy("rep").agg(F.count(F.lit(1)).alias("copies"))
    facts = sizes.join(ends, "rep", "left").select("rep", "copies", F.coalesce("links", F.lit(0).cast("long")).alias("links"))
    return skewed_lookup(members, facts, ["rep"]).select("id", "rep", "copies", "links")
