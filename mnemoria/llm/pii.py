"""Personal information inside free text: found by a tagger, replaced by typed placeholders."""

from __future__ import annotations

import io
import pkgutil
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import skewed_lookup
from ..session import materialize
from .batches import by_size
from .pii_train import MODEL, spans
from .tagger import KINDS, Tagger

#: What stands for each kind in the text.
PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "street_address": "[ADDRESS]", "person_name": "[PERSON]"}
#: Spans of one kind closer than this are one, unless what parts them shows that they are two.
JOIN_GAP = 2
#: What can lie inside one piece, and what parts pieces of a list.
_INSIDE = re.compile(r"[ .\-‑–]?")
_PARTING = re.compile(r"\s*[,;/]\s*")
_AT = re.compile(r"@|\bat\b", re.I)
#: Words for streets and dwellings, whole or as the end of a word.
_STREET = re.compile(
    r"\b(?:street|st|road|rd|lane|ln|avenue|ave|av|avenida|boulevard|blvd|close|drive|court|square|terrace|way|place|rue|calle|plaza|via|viale|piazza|quai|chemin|allee|platz|weg|gasse|flat|apt|unit)\b|(?:straße|strasse|str|weg|gasse|allee|platz|ring|damm|ufer)\b",
    re.I,
)
_DWELLING = re.compile(r"\b(?:flat|apt|unit)\b", re.I)
#: Common words that no name of a person contains.
_NO_NAME = set("the of in on at near and are was were from not than then while over again overnight".split())


@lru_cache(1)
def tagger() -> Tagger:
    # by the package's loader, as executors get the package as an archive
    return Tagger.load(io.BytesIO(pkgutil.get_data(__package__, MODEL.name)))


def plausible(kind: str, text: str) -> bool:
    """A check of a found piece by its form, after the tagger has found it."""
    digits = sum(c.isdigit() for c in text)
    words = re.findall(r"[^\W\d_]+", text)
    if kind == "email":
        return bool(_AT.search(text)) and len(text) >= 6 and bool(words)
    if kind == "phone":
        return 7 <= digits <= 17
    if kind == "id_number":
        return digits >= 8 or (digits >= 5 and bool(words))
    if kind == "street_address":
        # a bare number, or one with a single word, is doubtful and needs a word for a street
        return digits >= 1 and (bool(_STREET.search(text)) or (digits <= 10 and sum(len(w) > 1 for w in words) >= 2))
    return len(words) >= 2 and digits == 0 and not _NO_NAME & {w.lower() for w in words}


def _trimmed(text: str, a: int, b: int) -> tuple[int, int]:
    """A name without the common words and marks at its ends."""
    words = [m.span() for m in re.finditer(r"[^\W\d_]+", text[a:b])]
    common = [text[a + x : a + y].lower() in _NO_NAME for x, y in words]
    if not words or all(common):
        return a, b
    first, last = common.index(False), len(common) - 1 - common[::-1].index(False)
    return a + words[first][0] if first else a, a + words[last][1] if last < len(words) - 1 else b


def _alone(kind: str, text: str) -> bool:
    """Whether a part of a list is a piece of its own; a flat, floor or town goes with the street."""
    return plausible(kind, text) and (kind != "street_address" or bool(_STREET.search(_DWELLING.sub("", text))))


def _joins(kind: str, text: str, before: list[int], after: tuple[int, int]) -> bool:
    """Whether two spans of one kind that are close are one piece."""
    gap = text[before[1] : after[0]]
    if len(gap) > JOIN_GAP:
        return False
    if _INSIDE.fullmatch(gap):
        return plausible(kind, text[before[0] : after[1]]) or not (plausible(kind, text[slice(*before)]) or plausible(kind, text[slice(*after)]))
    left, right = _alone(kind, text[slice(*before)]), _alone(kind, text[slice(*after)])
    # the second part of a number or an address ("030/23125", "12 High Street, Town") can't stand alone, of a name ("Miller, Jane") the first
    return not (left and right) if kind in ("phone", "street_address") else not left


def _same_form(text: str, piece: str, at: int) -> re.Match | None:
    """A number of the form of ``piece`` that begins in ``text`` at a place."""
    return re.compile("".join(r"\d" if c.isdigit() else re.escape(c) for c in piece) + r"(?!\d)").match(text, at)


def _parts(kind: str, text: str, a: int, b: int) -> list[tuple[int, int]]:
    """A piece, cut where it is a list of several."""
    for cut in _PARTING.finditer(text, a, b):
        if kind == "id_number" and "/" in cut.group():
            continue
        if _alone(kind, text[a : cut.start()]):
            if _alone(kind, text[cut.end() : b]):
                return [(a, cut.start()), *_parts(kind, text, cut.end(), b)]
            if kind == "phone" and _same_form(text, text[a : cut.start()], cut.end()):
                return [(a, cut.start())]
    if kind == "phone" and not plausible(kind, text[a:b]):
        # two or more numbers with nothing but spaces between: cut where the parts are most alike
        cuts = [m for m in re.finditer(r"\s+", text[a:b]) if plausible(kind, text[a : a + m.start()])]
        size = b - a
        for m in sorted(cuts, key=lambda m: abs(size - m.start() - m.end())):
            rest = _parts(kind, text, a + m.end(), b)
            if all(plausible(kind, text[x:y]) for x, y in rest):
                return [(a, a + m.start()), *rest]
    return [(a, b)]


def _listed(text: str, b: int, piece: str) -> list[tuple[int, int]]:
    """Numbers of the same form that follow a phone number in a list, however they are tagged."""
    out = []
    while (cut := _PARTING.match(text, b)) and (more := _same_form(text, piece, cut.end())):
        out.append(more.span())
        b = more.end()
    return out


def find_spans(texts: list[str], model: Tagger | None = None) -> list[list[tuple[int, int, str]]]:
    """``(from, to, kind)`` of each piece of personal data in each text, in order and without overlap."""
    out = []
    for text, labels in zip(texts, (model or tagger()).label(texts)):
        found: list[tuple[int, int, str]] = []
        if labels is not None:
            for number, kind in enumerate(KINDS, 1):
                pieces: list[list[int]] = []
                for a, b in spans(labels == number):
                    if pieces and _joins(kind, text, pieces[-1], (a, b)):
                        pieces[-1][1] = b
                    else:
                        pieces.append([a, b])
                for a, b in pieces:
                    # whole words: a piece never begins or ends within a run of letters and digits that has no other label
                    while a > 0 and text[a].isalnum() and text[a - 1].isalnum() and labels[a - 1] == 0:
                        a -= 1
                    while b < len(text) and text[b - 1].isalnum() and text[b].isalnum() and labels[b] == 0:
                        b += 1
                    # what stands before an at sign without a space is its user
                    while kind == "email" and a > 0 and (text[a - 1].isalnum() or text[a - 1] in "._+-") and labels[a - 1] == 0:
                        a -= 1
                    # marks around a piece belong to the text
                    while a < b and not text[a].isalnum() and text[a] not in "+(":
                        a += 1
                    while b > a and not text[b - 1].isalnum() and not (text[b - 1] == ")" and "(" in text[a:b]):
                        b -= 1
                    for a, b in _parts(kind, text, a, b):
                        if kind == "person_name":
                            a, b = _trimmed(text, a, b)
                        if plausible(kind, text[a:b]):
                            found.append((a, b, kind))
                            if kind == "phone":
                                found += [(*x, kind) for x in _listed(text, b, text[a:b])]
            found = sorted(set(found), key=lambda x: (x[0], -x[1]))
            found = [x for i, x in enumerate(found) if not i or x[0] >= max(y[1] for y in found[:i])]
        out.append(found)
    return out


def redact(text: str, found: list[tuple[int, int, str]]) -> str:
    """The text with each piece replaced by its placeholder, all else unchanged."""
    out, at = [], 0
    for a, b, kind in found:
        out += [text[at:a], PLACEHOLDERS[kind]]
        at = b
    return "".join([*out, text[at:]])


def _tag_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in by_size(batches, "value"):
        texts = batch.column("value").to_pylist()
        found = find_spans(texts)
        hit = [i for i, f in enumerate(found) if f]
        columns = [
            batch.column("h1").take(pa.array(hit, pa.int64())),
            batch.column("h2").take(pa.array(hit, pa.int64())),
            pa.array([sorted({k for _, _, k in found[i]}) for i in hit], pa.list_(pa.string())),
            pa.array([redact(texts[i], found[i]) for i in hit], pa.string()),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["h1", "h2", "kinds", "redacted"])


def _hashed(df: DataFrame, column: str) -> DataFrame:
    return df.withColumns({"__h1": F.xxhash64(column), "__h2": F.xxhash64(F.lit(3), column)})


def _tagged(df: DataFrame, column: str) -> DataFrame:
    """``(__h1, __h2, kinds, redacted)`` of each distinct value with personal data in it."""
    values = df.select(F.col(column).alias("value")).where(F.length("value") > 0).distinct()
    values = values.select("value", F.xxhash64("value").alias("h1"), F.xxhash64(F.lit(3), "value").alias("h2"))
    tagged = values.mapInArrow(_tag_batches, "h1 long, h2 long, kinds array<string>, redacted string")
    return materialize(tagged, "pii-values").select(F.col("h1").alias("__h1"), F.col("h2").alias("__h2"), F.col("kinds").alias("__kinds"), F.col("redacted").alias("__redacted"))


def personal_data_kinds(df: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """``(*keep, kind)``: one row for each row of ``df`` and each kind of personal data in its ``column``.

    Kinds are those of ``KINDS``. Null and empty texts have none; repeated rows
    come out as often as they come in. An empty table gives no rows. Texts of any
    length are read whole, in overlapping windows.

    Each distinct text is tagged once, however many rows share it; the rows find
    the result by a 128-bit hash, and the rows of a text that very many share are
    spread.
    """
    rows = _hashed(df.where(F.length(column) > 0), column).select(*keep, "__h1", "__h2")
    met = skewed_lookup(rows, _tagged(df, column).select("__h1", "__h2", "__kinds"), ["__h1", "__h2"])
    return met.select(*keep, F.explode("__kinds").alias("kind"))


def redact_column(df: DataFrame, column: str) -> DataFrame:
    """``df`` with each piece of personal data in ``column`` replaced by a placeholder; everything else stays as it is.

    All rows and columns are kept, null and empty texts among them, whatever the
    columns are called.
    """
    names = df.columns
    hashed = _hashed(df, column)
    met = skewed_lookup(hashed, _tagged(df, column).select("__h1", "__h2", "__redacted"), ["__h1", "__h2"], "left")
    return met.withColumn(column, F.coalesce("__redacted", column)).select(*[f"`{c}`" for c in names])
