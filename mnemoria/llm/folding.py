"""Skip-and-fold: what is left of a text when only its letters and digits count.

A lookup table sends each character to 0 (skip) or to the code of its lower-case
form. Hashes take the table's output block by block: a skipped character weighs
nothing, and the weight of a kept one follows from a running count. Comparisons move
two pointers over the texts as they are and skip what the table skips. What is left
is never put together.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np

#: Moduli and bases of the two rolling polynomial hashes (fixed values).
MODULI = (2147483647, 2147483629)
BASES = (1000003, 736338717)

_TABLE_END = 0x3000
#: Characters that go through the table at once.
BLOCK = 1 << 16


def _fold(char: str) -> int:
    """The rule behind the table: first letter or digit of the lower-case form, else 0."""
    return next((ord(c) for c in char.lower() if c.isalnum()), 0) if char.isalnum() else 0


@lru_cache(1)
def _table() -> np.ndarray:
    return np.array([_fold(chr(c)) for c in range(_TABLE_END)], np.uint32)


def fold_codes(codes: np.ndarray) -> np.ndarray:
    """Code points to folded codes, 0 where the character is skipped."""
    high = codes >= _TABLE_END
    out = _table()[np.where(high, 0, codes)]
    if high.any():
        far, inverse = np.unique(codes[high], return_inverse=True)
        out[high] = np.array([_fold(chr(c)) for c in far], np.uint32)[inverse]
    return out


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


@lru_cache(8)
def _powers(modulus: int, base: int, log_size: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    step = base % modulus
    for _ in range(log_size):
        out = np.concatenate([out, out * np.uint64(step) % np.uint64(modulus)])
        step = step * step % modulus
    return out


def _power(modulus: int, base: int, place: np.ndarray) -> np.ndarray:
    """Powers of the base, by two tables that stay small for texts of any length."""
    low = _powers(modulus, base, 16)[place & 0xFFFF]
    top = int(place.max(initial=0)) >> 16
    return low if not top else low * _powers(modulus, pow(base, 1 << 16, modulus), top.bit_length())[place >> 16] % np.uint64(modulus)


def poly_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two 31-bit polynomial hashes of what is left of each text, as one 62-bit number and one again under another mix, and how many characters are left.

    The texts run through the table in blocks; a count of kept characters runs along
    and gives each its power of the base.
    """
    n = len(texts)
    lengths = np.fromiter(map(len, texts), np.int64, n)
    ends = np.cumsum(lengths)
    codes = code_points("".join(texts))
    sums, sizes = [np.zeros(n, np.uint64) for _ in MODULI], np.zeros(n, np.int64)
    for since in range(0, len(codes), BLOCK):
        folded = fold_codes(codes[since : since + BLOCK])
        kept = folded != 0
        first = int(np.searchsorted(ends, since, "right"))
        last = int(np.searchsorted(ends, since + len(folded), "left"))
        # where each text of the block begins in it, texts without characters too
        starts = np.maximum(ends[first : last + 1] - lengths[first : last + 1] - since, 0)
        whose = np.repeat(np.arange(first, last + 1), np.diff(np.append(starts, len(folded))))
        count = np.cumsum(kept)
        before = np.where(starts > 0, count[starts - 1], 0)
        place = np.maximum(count - 1 - before[whose - first] + sizes[whose], 0)
        for total, modulus, base in zip(sums, MODULI, BASES):
            terms = folded.astype(np.uint64) * _power(modulus, base, place) % np.uint64(modulus)
            run = np.concatenate([[np.uint64(0)], np.cumsum(terms, dtype=np.uint64)])
            bounds = np.append(starts, len(folded))
            total[first : last + 1] = (total[first : last + 1] + run[bounds[1:]] - run[bounds[:-1]]) % np.uint64(modulus)
        sizes[first : last + 1] += np.bincount(whose - first, weights=kept, minlength=last + 1 - first).astype(np.int64)
    with np.errstate(over="ignore"):
        return (sums[0] << np.uint64(31)) | sums[1], mix(sums[0] * np.uint64(0x9E3779B97F4A7C15) ^ sums[1] ^ sizes.astype(np.uint64)), sizes


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _refuse(_: str) -> None:
    raise ValueError("not JSON")


def _text_of(value) -> str:
    return value if isinstance(value, str) else {None: "null", True: "true", False: "false"}[value] if value is None or isinstance(value, bool) else json.dumps(value, ensure_ascii=False)


class _Pairs(list):
    """The pairs of one JSON object, in order, repeats kept."""


def _plain(value):
    if isinstance(value, _Pairs):
        return {k: _plain(v) for k, v in value}
    return [_plain(x) for x in value] if isinstance(value, list) else value


def fields(value: str) -> list[tuple[str, str]] | None:
    """The name-value pairs of a list of fields; None if the value is ordinary text.

    A list of fields is a JSON object, or contains ``=`` in each non-blank part
    between semicolons (and at all). Numbers keep the digits they are written in.
    """
    body = value.strip()
    if body[:1] == "{" and body[-1:] == "}":
        try:
            found = json.loads(body, object_pairs_hook=_Pairs, parse_int=str, parse_float=str, parse_constant=_refuse)
            if isinstance(found, _Pairs):
                return [(name, _text_of(_plain(x))) for name, x in found]
        except (ValueError, RecursionError):
            pass
    if "=" not in value:
        return None
    parts = [p for p in value.split(";") if p.strip()]
    return [tuple(p.split("=", 1)) for p in parts] if all("=" in p for p in parts) else None


def class_hashes(values: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """128 bits that are equal for values of which the same is left, and whether anything is left.

    Text is hashed as one folded stream; a list of fields by the sum over its
    distinct pairs, so the order of fields doesn't matter.
    """
    n = len(values)
    lists = [fields(v) for v in values]
    h1, h2, size = poly_hashes([v if f is None else "" for v, f in zip(values, lists)])
    h1, h2, left = mix(h1 + np.uint64(1)), h2.copy(), size > 0
    owner = np.array([i for i, f in enumerate(lists) if f is not None for _ in f], np.int64)
    if len(owner):
        pairs = [p for f in lists if f is not None for p in f]
        a1, a2, asize = poly_hashes([p[0] for p in pairs])
        b1, b2, bsize = poly_hashes([p[1] for p in pairs])
        with np.errstate(over="ignore"):
            c1 = mix(mix(a1 + np.uint64(3)) * np.uint64(31) + mix(b1 + np.uint64(5)))
            c2 = mix(mix(a2 + np.uint64(7)) * np.uint64(37) + mix(b2 + np.uint64(9)))
        full = (asize + bsize) > 0
        rows = np.unique(np.rec.fromarrays([owner[full], c1[full], c2[full]], names="o,a,b"))
        for out, part in ((h1, rows["a"]), (h2, rows["b"])):
            total = np.zeros(n, np.uint64)
            np.add.at(total, rows["o"], part)
            hit = np.unique(rows["o"])
            out[hit] = mix(total[hit] ^ np.uint64(0x5851F42D4C957F2D))
        left[np.unique(rows["o"])] = True
    return h1.view(np.int64), h2.view(np.int64), left


def same_text(a: str, b: str, block: int = 4096) -> bool:
    """Whether the same is left of two texts: two pointers run over both and skip what the table skips.

    Each step takes a block from either pointer on, compares as many kept
    characters as both blocks hold, and moves each pointer behind the last one compared.
    """
    if a == b:
        return True
    x, y = code_points(a), code_points(b)
    i = j = 0
    while True:
        fx, fy = fold_codes(x[i : i + block]), fold_codes(y[j : j + block])
        px, py = np.flatnonzero(fx), np.flatnonzero(fy)
        n = min(len(px), len(py))
        if n and not np.array_equal(fx[px[:n]], fy[py[:n]]):
            return False
        # a pointer with nothing more to compare in its block skips all of it
        i += int(px[n]) if len(px) > n else len(fx)
        j += int(py[n]) if len(py) > n else len(fy)
        if i >= len(x) or j >= len(y):
            rest, at = (y, j) if i >= len(x) else (x, i)
            return not any(fold_codes(rest[k : k + block]).any() for k in range(at, len(rest), block))


def _distinct_pairs(found: list[tuple[str, str]]) -> dict[tuple[int, int], list[tuple[str, str]]]:
    """The pairs of which something is left, each once, by their hashes."""
    names, _, name_sizes = poly_hashes([n for n, _ in found])
    values, _, value_sizes = poly_hashes([v for _, v in found])
    out: dict[tuple[int, int], list[tuple[str, str]]] = {}
    for pair, h, g, left in zip(found, names.tolist(), values.tolist(), (name_sizes + value_sizes).tolist()):
        group = out.setdefault((h, g), []) if left else [pair]
        if not any(_same_pair(pair, other) for other in group):
            group.append(pair)
    return out


def _same_pair(p: tuple[str, str], q: tuple[str, str]) -> bool:
    return same_text(p[0], q[0]) and same_text(p[1], q[1])


def same_left(a: str, b: str) -> bool:
    """Whether the same is left of two values, compared exactly; lists of fields as sets of pairs."""
    fa, fb = fields(a), fields(b)
    if fa is None or fb is None:
        return fa is None and fb is None and same_text(a, b)
    x, y = _distinct_pairs(fa), _distinct_pairs(fb)
    return x.keys() == y.keys() and all(len(x[h]) == len(y[h]) and all(any(_same_pair(p, q) for q in y[h]) for p in x[h]) for h in x)
