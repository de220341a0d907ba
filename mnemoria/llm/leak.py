"""Evaluation passages that stand, whole, in part or edited, in training texts."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .batches import by_size
from .words import WORD, words

#: Consecutive words of a seed.
SEED_WORDS = 5
#: A copy of so many consecutive words scores enough to be reported.
WINDOW_WORDS = 10
#: Words of test items that one pass holds in memory on each executor; more items take more passes.
BLOCK_WORDS = 2_000_000
#: Scores of the alignment: equal words, other words, a word left out or put in (fixed values).
MATCH, MISMATCH, GAP = 2, -1, -1

_SEQUENCE = "doc_id long, ids array<int>, grams array<long>, places array<int>"
_FOUND = "doc_id long, item_id long, score int, identity double, longest_run int, covered double, from_word int, to_word int"


def _gram_codes(ids: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive word numbers; 0 where one of the words is in no test item."""
    size = len(ids) - n + 1
    if size <= 0:
        return np.zeros(0, np.int64)
    out, known = np.zeros(size, np.uint64), np.ones(size, bool)
    with np.errstate(over="ignore"):
        for i in range(n):
            part = ids[i : i + size]
            known &= part > 0
            out = (out ^ part.astype(np.uint64)) * np.uint64(0x100000001B3) + np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    out = out.view(np.int64).copy()
    out[out == 0] = 1
    out[~known] = 0
    return out


class Items:
    """A block of test items: their words as numbers, and the seeds that occur in them."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.vocabulary: dict[str, int] = {}
        self.ids = {i: np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(t)], np.int32) for i, t in rows}
        # a passage shorter than a seed says nothing: any text may hold its few words
        self.grams = {i: _gram_codes(x, SEED_WORDS) for i, x in self.ids.items() if len(x) >= SEED_WORDS}
        self.lengths = [SEED_WORDS] if self.grams else []
        each = [np.zeros(0, np.int64), *self.grams.values()]
        grams = np.concatenate(each)
        order = np.argsort(grams, kind="stable")
        #: Seeds in order, as often as items hold them, with the item and the place of each.
        self.sorted = grams[order]
        self.item_of = np.repeat(np.array([0, *self.grams], np.int64), [len(g) for g in each])[order]
        self.place_of = np.concatenate([np.arange(len(g), dtype=np.int32) for g in each])[order]
        self.all_grams = np.unique(grams)

    def starts(self, grams: list[int], places: list[int]) -> dict[int, list[int]]:
        """For each item with a seed among these the places of the text where the item would begin."""
        out: dict[int, set[int]] = defaultdict(set)
        wanted = np.array(grams, np.int64)
        first, last = (np.searchsorted(self.sorted, wanted, side) for side in ("left", "right"))
        for place, a, b in zip(places, first.tolist(), last.tolist()):
            for item, at in zip(self.item_of[a:b].tolist(), self.place_of[a:b].tolist()):
                out[item].add(place - at)
        return {item: sorted(found) for item, found in out.items()}


def _scan(items: Broadcast):
    """Documents that hold any seed of any item: their words as numbers, the seeds and their places."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Items = items.value
        number = held.vocabulary.get
        for batch in by_size(batches, "text"):
            docs, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            rows = []
            for doc, text in zip(docs, texts):
                ids = np.fromiter((number(w, 0) for w in WORD.findall(text.lower())), np.int32)
                hits, places = [], []
                for n in held.lengths:
                    grams = _gram_codes(ids, n)
                    if len(grams) and len(held.all_grams):
                        at = np.minimum(np.searchsorted(held.all_grams, grams), len(held.all_grams) - 1)
                        where = np.flatnonzero((held.all_grams[at] == grams) & (grams != 0))
                        hits += grams[where].tolist()
                        places += where.tolist()
                if hits:
                    rows.append((doc, ids, hits, places))
            columns = list(zip(*rows)) or [(), (), (), ()]
            kinds = (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], ["doc_id", "ids", "grams", "places"])

    return scan


def _row(above: np.ndarray, word: int, text: np.ndarray, slope: np.ndarray) -> np.ndarray:
    """The next row of the alignment's scores; a gap along the text is a running maximum."""
    step = np.where((text == word) & (text > 0), MATCH, MISMATCH)
    row = np.maximum(above[1:] + GAP, above[:-1] + step)
    row = np.concatenate([[0], np.maximum(row, 0)])
    return (np.maximum.accumulate(row + slope) - slope).astype(np.int32)


def align(passage: np.ndarray, text: np.ndarray) -> tuple[int, int, int, int, int]:
    """Smith-Waterman over word numbers: score, equal words of the best alignment, its columns, its first and last word in the text.

    One row per word of the passage, each a few array operations. Of the rows one in
    ``sqrt(n)`` is kept; on the way back the rows between two of these are made again, so
    that no more than twice the root of the passage's words are held.
    """
    n, m = len(passage), len(text)
    slope = np.arange(m + 1, dtype=np.int32) * -GAP
    stride = max(1, int(n**0.5))
    row, kept = np.zeros(m + 1, np.int32), {0: np.zeros(m + 1, np.int32)}
    best, i, j = 0, 0, 0
    for at in range(1, n + 1):
        row = _row(row, passage[at - 1], text, slope)
        top = int(row.argmax())
        if row[top] > best:
            best, i, j = int(row[top]), at, top
        if at % stride == 0:
            kept[at] = row
    last, equal, columns, base, rows = j, 0, 0, -1, []
    while i > 0 and j >= 0:
        start = (i - 1) // stride * stride
        if start != base:
            base, rows = start, [kept[start]]
            for at in range(start + 1, min(start + stride, n) + 1):
                rows.append(_row(rows[-1], passage[at - 1], text, slope))
        here, above = rows[i - base], rows[i - 1 - base]
        if here[j] <= 0:
            break
        hit = bool(text[j - 1] == passage[i - 1] and text[j - 1] > 0)
        columns += 1
        if here[j] == above[j - 1] + (MATCH if hit else MISMATCH):
            equal, i, j = equal + hit, i - 1, j - 1
        elif here[j] == above[j] + GAP:
            i -= 1
        else:
            j -= 1
    return best, equal, columns, j, last


def longest_run(passage: np.ndarray, text: np.ndarray) -> int:
    """Most words that both have consecutively and in order."""
    best, run = 0, np.zeros(len(text) + 1, np.int32)
    for word in passage:
        run[1:] = np.where((text == word) & (text > 0), run[:-1] + 1, 0)
        best = max(best, int(run.max()))
    return best


def _verify(items: Broadcast, least_score: int):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Items = items.value
        for batch in batches:
            out = []
            for doc, ids, grams, places in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "ids", "grams", "places"))):
                text = np.array(ids, np.int32)
                for item, found in held.starts(grams, places).items():
                    passage = held.ids[item]
                    best, regions = None, _regions(found, len(passage), len(text))
                    # no alignment scores more than the words of the passage that the text has
                    if max(np.isin(passage, text[a:b]).sum() for a, b in regions) * MATCH < min(least_score, MATCH * len(passage)):
                        continue
                    for low, high in regions:
                        part = text[low:high]
                        score, equal, columns, first, last = align(passage, part)
                        candidate = (score, longest_run(passage, part), equal, columns, low + first, low + last)
                        best = candidate if best is None else (*max(best, candidate)[:1], max(best[1], candidate[1]), *max(best, candidate)[2:])
                    score, run, equal, columns, first, last = best
                    if score >= min(least_score, MATCH * len(passage)):
                        out.append((doc, item, score, equal / max(1, columns), run, equal / len(passage), first, last))
            columns = list(zip(*out)) or [()] * 8
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.int32(), pa.float64(), pa.int32(), pa.int32())
            names = [x.split()[0] for x in _FOUND.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names)

    return verify


#: Words of a text that one alignment takes, unless the passage needs more.
REGION_WORDS = 20_000


def _regions(starts: list[int], size: int, end: int) -> list[tuple[int, int]]:
    """Stretches of the text around the places where the passage would begin, with room for words put in.

    An alignment scores more than nothing only over at most three times the passage's
    words, so a long stretch is cut into parts that overlap by that much and none is lost.
    """
    out: list[list[int]] = []
    for start in starts:
        low, high = max(0, start - size // 2), min(end, start + 2 * size)
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    width = max(REGION_WORDS, 6 * size)
    return [(x, min(b, x + width)) for a, b in out for x in range(a, max(a + 1, b - 3 * size), width - 3 * size)]


def find_leaks(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", passage: str = "passage", least_score: int = MATCH * WINDOW_WORDS) -> DataFrame:
    """``(doc_id, item_id, score, identity, longest_run, covered, from_word, to_word)``: documents with what leaked into them.

    A document is reported for an item if a local alignment of their words scores
    at least ``least_score`` (or the whole passage, if that is shorter): whole
    copies, parts and edited copies. The two must share five words in a row
    somewhere; edits that leave no five words together aren't looked for. ``identity`` is the share of equal words in
    the alignment, ``covered`` the share of the passage's words. Null and empty
    texts and passages of fewer than five words have no leaks. An empty table on either side gives no rows. Repeated rows are
    reported once. Other columns aren't read.

    The corpus is read once for each block of items. Texts are scanned where they
    lie for seeds of five words; every seed of an item that a document holds has
    the two aligned around it, whatever other documents hold. Only documents with a seed go on, as word numbers. What is
    broadcast are the items of one block, at most ``BLOCK_WORDS`` words.
    """
    spark = documents.sparkSession
    held = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(passage).alias("passage")).where(F.col("item_id").isNotNull() & F.col("passage").isNotNull())
    size = held.agg(F.sum(F.length("passage"))).first()[0] or 0
    blocks = max(1, -(-(size // 4) // BLOCK_WORDS))
    texts = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    out = None
    for k in range(blocks):
        part = held.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k) if blocks > 1 else held
        block = Items([(r["item_id"], r["passage"]) for r in part.distinct().collect()])
        items_b = spark.sparkContext.broadcast(block)
        hits = materialize(texts.mapInArrow(_scan(items_b), _SEQUENCE), "leak-hits")
        found = hits.mapInArrow(_verify(items_b, least_score), _FOUND)
        out = found if out is None else out.unionByName(found)
    return out.distinct()
