"""Words: the longest runs of letters and digits in the lower-cased text."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

from .folding import mix

WORD = re.compile(r"[^\W_]+")
_TABLE_END = 0x3000
_BASE = np.uint64(0x100000001B3)


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


@lru_cache(1)
def _is_word() -> np.ndarray:
    return np.array([bool(WORD.match(chr(c))) for c in range(_TABLE_END)])


@lru_cache(8)
def _powers(log_size: int) -> np.ndarray:
    out, step = np.ones(1, np.uint64), _BASE
    with np.errstate(over="ignore"):
        for _ in range(log_size):
            out = np.concatenate([out, out * step])
            step = step * step
    return out


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of all texts in one array, and the bounds of each text in it."""
    lowered = [t.lower() for t in texts]
    codes = np.frombuffer("\n".join(lowered).encode("utf-32-le", "surrogatepass") + b"\n\0\0\0", np.uint32)
    high = codes >= _TABLE_END
    inside = _is_word()[np.where(high, 0, codes)]
    if high.any():
        far, inverse = np.unique(codes[high], return_inverse=True)
        inside[high] = np.array([bool(WORD.match(chr(c))) for c in far])[inverse]
    before = np.concatenate([[False], inside[:-1]])
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(~inside & before)
    text_ends = np.cumsum(np.fromiter((len(t) + 1 for t in lowered), np.int64, len(lowered)))
    bounds = np.concatenate([[0], np.searchsorted(starts, text_ends)]).astype(np.int64)
    if not len(starts):
        return np.zeros(0, np.uint64), bounds
    sizes = ends - starts
    chars = codes[inside].astype(np.uint64)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    place = np.arange(len(chars)) - np.repeat(offsets[:-1], sizes)
    with np.errstate(over="ignore"):
        sums = np.add.reduceat(mix(chars) * _powers(int(sizes.max() - 1).bit_length())[place], offsets[:-1])
        return mix(sums + sizes.astype(np.uint64)), bounds


def shingles(hashes: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``k`` consecutive words, and the bounds of each text in them."""
    sizes = np.diff(bounds)
    if len(hashes) < k:
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    n = len(hashes) - k + 1
    with np.errstate(over="ignore"):
        out = np.zeros(n, np.uint64)
        for i in range(k):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + n])
    valid = np.ones(len(hashes), bool)
    ends = bounds[1:][sizes > 0]
    for i in range(1, k):
        valid[np.maximum(ends - i, 0)] = False
    counts = np.maximum(sizes - k + 1, 0)
    return out[valid[:n]], np.concatenate([[0], np.cumsum(counts)])
