"""Keyword-stuffed and link-list pages, by the perplexity of their word classes."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, materialize
from .batches import by_size

#: Function words by language, each a class of its own.
FUNCTION_WORDS = {
    "en": "the a an of in on at by to from for with and or but as is was were are be been has had have its it this that these which who when while after before until between not near than then so".split(),
    "de": "der die das den dem des ein eine einer einen und oder bei im in am an auf aus von vom zu zur zum mit sich ist war wurde wird hat sowie nach seit zwischen heute für nicht über unter durch später etwa".split(),
    "fr": "le la les un une des de du et ou en dans au aux à par pour sur est sont fut a se puis depuis entre vers que qui avec reste trouve situé près".split(),
    "es": "el la los las un una de del y o en al por para con se es fue hay que tiene desde luego entre hacia cerca menciona su pertenece".split(),
}
SEGMENT_TOKENS = 32
#: A segment is abnormal when its cross-entropy lies this many standard deviations from that of prose.
DEVIATIONS = 3.0
#: A segment advertises when at least this share of it is tags or links, or of its words recur on the page.
AD_SHARE = 0.3
#: A word recurs if the page has it so often, and once in so many words; it is recent if it stood so few tokens before.
LEAST_REPEATS, REPEAT_WORDS, RECENT_TOKENS = 3, 200, 48
#: A page is spam when more than this share of its text lies in abnormal segments that advertise.
PAGE_SHARE = 0.5

_TOKEN = re.compile(r"https?://[^\s\]<>|\"']+|#[^\W_]\w+|</?[A-Za-z]+|\d+[.,]\d\d(?![\d.,]\d)|\d+|[^\W\d_]+|\[\[|\]\]|\{\{|\}\}|\{\||\|\}|\|\||\|-|=+|'{2,}|\n|[^\w\s]")
_MARKS = list(".,;:!?()|*#<>/-–\"'") + ["[[", "]]", "{{", "}}", "{|", "|}", "||", "|-", "=", "''", "[", "]"]
#: Words with a meaning by how they are written; each again as one that stood a little before, and as the text of an outward link.
_FORMS = ["word", "capital", "upper"]
_OTHER = [*_FORMS, *[f"recent {x}" for x in _FORMS], "link word", "recent link word", "name", "number", "price", "year", "link", "tag", "mark"]
_FUNCTION = [*dict.fromkeys(w for ws in FUNCTION_WORDS.values() for w in ws)]
_NAMES = ["edge", *_OTHER, *_MARKS, *_FUNCTION]
CLASS = {name: i for i, name in enumerate(_NAMES)}
N_CLASSES = len(_NAMES)
_FUNCTION_FROM = N_CLASSES - len(_FUNCTION)
_FUNCTION_SET = set(_FUNCTION)
_TAG, _LINK, _YEAR, _WORD, _RECENT, _IN_LINK, _NAME = (CLASS[x] for x in ("tag", "link", "year", "word", "recent word", "link word", "name"))
#: Of a token: counts as a word, is a link, is a price, is one of several tags in a row, is a word of letters with a meaning, recurs on its page, makes no sense, is of a term or its definition.
WORD, LINK, PRICE, TAG, CONTENT, REPEAT, NONSENSE, ENTRY = 1, 2, 4, 8, 16, 32, 64, 128
#: Words that can't be spoken, and function words read backwards: what vandals type.
_UNSPOKEN = re.compile(r"^[bcdfghjklmnpqrstvwxz]{2,}$|[bcdfghjklmnpqrstvwxz]{6}|[jqx][bdfgjklmnqrsvwxz]|[fghjkmpqstvwxz]j")
_BACKWARDS = {w[::-1] for w in _FUNCTION if len(w) > 1}


def classify(token: str) -> tuple[int, int]:
    """Class of a token by itself, and what it counts as."""
    if token.startswith("http") and "://" in token:
        return _LINK, WORD | LINK
    if token[0] == "#" and len(token) > 1:
        return _TAG, WORD
    if token[0].isdigit():
        if not token.isdigit():
            return CLASS["price"], WORD | PRICE
        return (_YEAR if len(token) == 4 and "1000" <= token <= "2100" else CLASS["number"]), 0
    if token[0].isalpha():
        lower = token.lower()
        if lower in _FUNCTION_SET:
            return CLASS[lower], WORD
        flags = WORD | (CONTENT if len(lower) > 1 else 0) | (NONSENSE if _UNSPOKEN.search(lower) or lower in _BACKWARDS else 0)
        return CLASS["upper" if len(token) > 1 and token.isupper() else "capital" if token[0].isupper() else "word"], flags
    key = "<" if token[0] == "<" else "=" if token[0] == "=" else "''" if token.startswith("''") else token
    return CLASS.get(key, CLASS["mark"]) if key in _MARKS else CLASS["mark"], 0


class _Table(dict):
    """Numbers of the tokens of one batch; what is known of a token is worked out once."""

    def __init__(self):
        super().__init__()
        self.rows: list[tuple[int, int, int, int]] = []
        self.words: dict[str, int] = {}

    def __missing__(self, token: str) -> int:
        code, flags = (0, 0) if token == "\n" else classify(token)
        word = self.words.setdefault(token.lower(), len(self.words)) if flags & CONTENT else -1
        self.rows.append((code, flags, len(token), word))
        self[token] = number = len(self.rows) - 1
        return number


def _between(opens: np.ndarray, closers: np.ndarray) -> np.ndarray:
    """Which tokens lie between an opening one and the next that closes."""
    starts, ends = np.flatnonzero(opens), np.append(np.flatnonzero(closers), len(opens))
    depth = np.zeros(len(opens) + 1, np.int32)
    np.add.at(depth, starts, 1)
    np.add.at(depth, ends[np.searchsorted(ends, starts, "right")], -1)
    return np.cumsum(depth[:-1]) > 0


def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all tokens of all texts: class, what each counts as, length in characters, whether a segment ends with it; and the tokens of each text.

    Segments are lines and sentences, cut into even parts of at most
    ``SEGMENT_TOKENS`` tokens; a sentence of fewer than six stays with the next
    of its line. Classes see repetition: a word of meaning that stood within the last
    ``RECENT_TOKENS`` tokens of its page has a class of its own, and so has the
    text of an outward link.
    """
    table, numbers, sizes = _Table(), [], []
    for text in texts:
        found = list(map(table.__getitem__, _TOKEN.findall(text)))
        sizes.append(len(found))
        numbers += found
    per_text = np.array(sizes, np.int64)
    n = len(numbers)
    if not n:
        empty = np.zeros(0, np.uint8)
        return empty, empty, np.zeros(0, np.int32), np.zeros(0, bool), per_text
    known = np.array(table.rows, np.int64)[np.array(numbers, np.int64)]
    codes, flags, lengths, word = known[:, 0].astype(np.int16), known[:, 1].astype(np.uint8), known[:, 2].astype(np.int32), known[:, 3]
    text = np.repeat(np.arange(len(per_text)), per_text)
    place = np.arange(n)

    # signs of lists at the beginning of a line are no part of its words
    starts_line = np.concatenate([[True], (text[1:] != text[:-1]) | (codes[:-1] == 0)])
    lead = np.isin(codes, [CLASS[x] for x in "*#:;"])
    entry = starts_line & np.isin(codes, [CLASS[";"], CLASS[":"]])
    codes[starts_line & lead] = 0
    flags[np.isin(np.cumsum(starts_line), np.cumsum(starts_line)[entry])] |= ENTRY

    # words that recur on their page, and words that stood a little before
    content = np.flatnonzero(word >= 0)
    key = text[content] * len(table.words) + word[content]
    order = np.argsort(key, kind="stable")
    again = key[order][1:] == key[order][:-1]
    recent = np.zeros(n, bool)
    recent[content[order][1:]] = again & (np.diff(content[order]) <= RECENT_TOKENS)
    runs = np.flatnonzero(np.concatenate([[True], ~again])) if len(order) else np.zeros(0, np.int64)
    times = np.diff(np.append(runs, len(order)))
    often = np.zeros(n, np.int64)
    often[content[order]] = np.repeat(times, times)
    flags[often >= np.maximum(LEAST_REPEATS, per_text[text] / REPEAT_WORDS)] |= REPEAT

    # text of outward links; names of templates and of their fields, which are markup and no words of the page
    border = (codes == 0) | np.concatenate([[True], text[1:] != text[:-1]])
    in_link = _between((codes == _LINK) & np.concatenate([[False], codes[:-1] == CLASS["["]]), (codes == CLASS["]"]) | (codes == CLASS["]]"]) | border)
    names = _between(codes == CLASS["{{"], (codes == CLASS["|"]) | (codes == CLASS["}}"]) | border)
    names[:-1] |= codes[1:] == CLASS["="]
    form = (codes >= _WORD) & (codes < _WORD + len(_FORMS))
    flags[form & names] &= 255 - CONTENT - REPEAT
    codes = np.select([form & names, form & in_link, form & recent], [_NAME, _IN_LINK + recent, codes + len(_FORMS)], codes).astype(np.uint8)

    # several tags in a row; one alone is a redirect or an item of a numbered list
    tag = codes == _TAG
    side = np.zeros(n, bool)
    side[1:] |= tag[:-1] & (text[1:] == text[:-1])
    side[:-1] |= tag[1:] & (text[1:] == text[:-1])
    flags[tag & side] |= TAG

    # pieces: lines, and sentences of at least six tokens
    line = codes == 0
    last = np.concatenate([text[1:] != text[:-1], [True]])
    stop = (codes == CLASS["."]) | (codes == CLASS["!"]) | (codes == CLASS["?"])
    marks = np.flatnonzero(line | last | stop)
    since = np.diff(np.concatenate([[-1], marks]))
    cut = np.zeros(n, bool)
    cut[marks] = ~stop[marks] | (since >= 6) | last[marks]
    piece = np.concatenate([[0], np.cumsum(cut)[:-1]])
    real = ~line
    size = np.bincount(piece[real], minlength=piece[-1] + 1)
    begins = np.concatenate([[0], np.cumsum(size)[:-1]])
    within = np.cumsum(real) - 1 - begins[piece]
    part = within * -(-size // SEGMENT_TOKENS)[piece] // np.maximum(size, 1)[piece]
    kept = place[real]
    ends = np.zeros(n, bool)
    if len(kept):
        ends[kept[:-1]] = (piece[kept][1:] != piece[kept][:-1]) | (part[kept][1:] != part[kept][:-1])
        ends[kept[-1]] = True
    return codes, flags, lengths, ends, per_text


class Tokens:
    """Encoded texts of a batch in a row, line ends left out: class, flags, length, segment of each token; text of each segment."""

    def __init__(self, codes: np.ndarray, flags: np.ndarray, lengths: np.ndarray, ends: np.ndarray, per_text: np.ndarray):
        real = codes != 0
        text = np.repeat(np.arange(len(per_text)), per_text)[real]
        self.codes, self.flags, self.lengths, ends = codes[real].astype(np.int64), flags[real], lengths[real].astype(np.int64), ends[real]
        self.segment = np.concatenate([[0], np.cumsum(ends)[:-1]]) if len(ends) else np.zeros(0, np.int64)
        self.text = text[ends]
        self.n = len(self.text)

    def total(self, mask: np.ndarray) -> np.ndarray:
        return np.bincount(self.segment[mask], minlength=self.n)

    def of(self, flag: int) -> np.ndarray:
        return self.total((self.flags & flag) > 0)

    def chars(self, mask: np.ndarray) -> np.ndarray:
        return np.bincount(self.segment[mask], weights=self.lengths[mask], minlength=self.n)

    def grams(self) -> np.ndarray:
        """Trigram of each token, with edges where its segment begins."""
        c, s = self.codes, self.segment
        one, two = np.zeros_like(c), np.zeros_like(c)
        one[1:] = np.where(s[1:] == s[:-1], c[:-1], 0)
        two[2:] = np.where(s[2:] == s[:-2], c[:-2], 0)
        return (two * N_CLASSES + one) * N_CLASSES + c

    def entropies(self, bits: np.ndarray) -> np.ndarray:
        """Bits per token of each segment."""
        return np.bincount(self.segment, weights=bits[self.grams()], minlength=self.n) / np.maximum(np.bincount(self.segment, minlength=self.n), 1)

    def prose(self) -> np.ndarray:
        """Segments that a sentence looks like, to train on: function words, an end mark, no links, tags, prices or markup."""
        words, function = self.of(WORD), self.total(self.codes >= _FUNCTION_FROM)
        markup = self.total(np.isin(self.codes, [CLASS[x] for x in ("|", "*", "#", "<", ">", "[[", "]]", "{{", "}}", "{|", "|}", "||", "|-", "=", "link", "price", "tag", "link word", "recent link word")]))
        stop = self.total(np.isin(self.codes, [CLASS[x] for x in ".!?"]))
        return (words >= 6) & (function * 5 >= words) & (markup == 0) & (stop >= 1)

    def advertises(self) -> np.ndarray:
        """Segments full of tags in a row, of outward links, or of words that recur on the page; no list of words is asked.

        This says what kind of thing a segment is full of, and the model whether
        it is no prose. Sources have a year beside each link, tables numbers, lists of
        pages inner links, glossaries terms with definitions, and what is typed without sense or backwards has
        words to tell it: those don't count.
        """
        words, links, content = self.of(WORD), self.of(LINK), self.of(CONTENT)
        years = self.total(self.codes == _YEAR)
        tags = (self.of(TAG) >= AD_SHARE * words) & (self.of(TAG) > 0)
        outward = (links > 0) & (self.chars((self.flags & LINK) > 0) >= AD_SHARE * self.chars(np.ones(len(self.codes), bool))) & (years * 2 < links)
        # links with their text and prices among recurring words count with them
        linked = (self.codes == _IN_LINK) | (self.codes == _IN_LINK + 1)
        ads, told = self.total(linked | ((self.flags & (REPEAT | PRICE | LINK | TAG)) > 0)), content + self.of(PRICE | LINK | TAG)
        recurs = (ads >= AD_SHARE * told) & (told >= 2) & ((links == 0) | (years < links))
        # a number right after a recurring word ("size 40") is of a product
        labelled = np.concatenate([[False], (self.flags[:-1] & REPEAT) > 0])[: len(self.codes)]
        data = self.total(((self.codes == CLASS["number"]) | (self.codes == _YEAR)) & ~labelled) * 2 > words
        inner = self.total(self.codes == CLASS["[["]) * 4 > words
        return (words > 0) & (tags | outward | recurs & ~data & ~inner & (self.of(NONSENSE) * 5 < words) & (self.of(ENTRY) == 0))


_CODED = "doc_id long, gram long, n long, size int, codes binary, flags binary, lengths binary, ends binary"
_NAMES_OF = [x.split()[0] for x in _CODED.split(", ")]


def _batch_of(rows: int, **columns) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([columns[c].cast(t) if c in columns else pa.nulls(rows, t) for c, t in zip(_NAMES_OF, kinds)], _NAMES_OF)


def _encode_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Encoded texts; after the last one of a partition, its counts of trigrams of prose."""
    counts = np.zeros(N_CLASSES**3, np.int64)
    for batch in by_size(batches, "text"):
        codes, flags, lengths, ends, per_text = encode(batch.column("text").to_pylist())
        tokens = Tokens(codes, flags, lengths, ends, per_text)
        if tokens.n:
            found, n = np.unique(tokens.grams()[tokens.prose()[tokens.segment]], return_counts=True)
            counts[found] += n
        stops = np.cumsum(per_text)
        parts = lambda x: pa.array([x[e - s : e].tobytes() for s, e in zip(per_text, stops)], pa.binary())
        yield _batch_of(batch.num_rows, doc_id=batch.column("doc_id"), size=pa.array(per_text, pa.int32()), codes=parts(codes), flags=parts(flags), lengths=parts(np.minimum(lengths, 65535).astype(np.uint16)), ends=parts(ends.astype(np.uint8)))
    found = np.flatnonzero(counts)
    if len(found):
        yield _batch_of(len(found), gram=pa.array(found), n=pa.array(counts[found]))


def _tokens_of(batch: pa.RecordBatch) -> Tokens:
    join = lambda name, kind: np.frombuffer(b"".join(batch.column(name).to_pylist()), kind)
    return Tokens(join("codes", np.uint8), join("flags", np.uint8), join("lengths", np.uint16), join("ends", np.uint8).astype(bool), np.asarray(batch.column("size")).astype(np.int64))


def class_bits(counts: dict[int, int]) -> np.ndarray:
    """Bits of each trigram under an interpolated trigram model of word classes."""
    k = N_CLASSES
    tri = np.zeros(k * k * k, np.float32)
    if counts:
        tri[np.fromiter(counts.keys(), np.int64)] = np.fromiter(counts.values(), np.float64)
    tri = tri.reshape(k, k, k)
    bi = tri.sum(0, dtype=np.float64)
    uni = bi.sum(0) + 0.5
    uni /= uni.sum()
    two = bi / np.maximum(bi.sum(1, keepdims=True), 1)
    three = tri / np.maximum(tri.sum(2, keepdims=True), 1)
    mixed = 0.6 * three + 0.3 * two[None] + 0.1 * uni[None, None]
    return (-np.log2(np.maximum(mixed, 1e-6))).astype(np.float32).ravel()


_SEGMENTS = "doc_id long, n long, s double, q double, tokens int, bits array<float>, chars array<int>, ads array<boolean>"


def _score_segments(bits):
    """Of each text its segments with bits per token, characters and whether they advertise; after the last one of a partition, the moments of prose."""
    names = [x.split()[0] for x in _SEGMENTS.split(", ")]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, q = 0, 0.0, 0.0
        for batch in by_size(batches, "codes", limit=2_000_000):
            tokens, docs = _tokens_of(batch), batch.num_rows
            h = tokens.entropies(bits.value)
            prose = h[tokens.prose()]
            n, s, q = n + len(prose), s + prose.sum(), q + (prose * prose).sum()
            offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(tokens.text, minlength=docs))]).astype(np.int32))
            chars = np.bincount(tokens.segment, weights=tokens.lengths + 1, minlength=tokens.n).astype(np.int32)
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (h.astype(np.float32), chars, tokens.advertises())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.nulls(docs, t) for t in (pa.int64(), pa.float64(), pa.float64())], batch.column("size"), *lists], names)
        if n:
            nulls = [pa.nulls(1, pa.list_(t)) for t in (pa.float32(), pa.int32(), pa.bool_())]
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([n], pa.int64()), pa.array([s]), pa.array([q]), pa.nulls(1, pa.int32()), *nulls], names)

    return score


def segment_scores(df: DataFrame, id_column: str, text_column: str) -> tuple[DataFrame, float, float]:
    """Of each text its segments with bits per token, characters and whether they advertise, and the bounds of what is normal."""
    spark = df.sparkSession
    slim = df.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text")).where(F.col("text").isNotNull())
    coded = materialize(slim.mapInArrow(_encode_batches, _CODED), "spam-codes")
    counts = coded.where(F.col("gram").isNotNull()).groupBy("gram").agg(F.sum("n").alias("n"))
    bits = spark.sparkContext.broadcast(class_bits({r["gram"]: r["n"] for r in counts.collect()}))
    scored = materialize(coded.where(F.col("size").isNotNull()).mapInArrow(_score_segments(bits), _SEGMENTS), "spam-segments")
    discard(coded)
    n, s, q = scored.agg(F.sum("n"), F.sum("s"), F.sum("q")).first()
    mean = (s or 0) / max(n or 0, 1)
    spread = max((q or 0) / max(n or 0, 1) - mean * mean, 0) ** 0.5
    return scored.where(F.col("tokens").isNotNull()), mean - DEVIATIONS * spread, mean + DEVIATIONS * spread


def score_pages(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``(doc_id, advert_share, abnormal_share, perplexity)`` of each text.

    The model counts trigrams of word classes over the sentences of all texts:
    function words are classes of their own, other words fall into a few by form,
    by whether they stood just before and whether they are the text of an outward
    link or the name of a template or field; links, prices, numbers and marks have theirs. A segment is abnormal if its
    cross-entropy is abnormally high or low against all sentences;
    ``abnormal_share`` is the share of a text in such segments, and
    ``advert_share`` the share in those of them that are full of tags in a row,
    outward links, prices or words that recur on the page. Null texts are left out;
    an empty text has shares of 0 and a null perplexity. Repeated rows and ids
    come out as often as they come in. An empty table gives no rows; other columns
    aren't read.

    Texts are read once, into one class per token with the counts of trigrams
    beside them; the second pass scores them and sums the moments of prose; what
    is left is arithmetic on a few numbers per segment. What is broadcast is a table
    whose size depends on the number of classes only.
    """
    return page_shares(*segment_scores(df, id_column, text_column))


def page_shares(scored: DataFrame, low: float, high: float) -> DataFrame:
    """Shares and perplexity of each text from its segments."""
    each = F.arrays_zip("bits", "chars", "ads")
    zero = F.struct(*[F.lit(0.0).alias(x) for x in ("whole", "odd", "advert", "bits")])
    odd = lambda x: ~((x["bits"] >= low) & (x["bits"] <= high))
    add = lambda acc, x: F.struct(
        (acc["whole"] + x["chars"]).alias("whole"), (acc["odd"] + F.when(odd(x), x["chars"]).otherwise(0)).alias("odd"),
        (acc["advert"] + F.when(odd(x) & x["ads"], x["chars"]).otherwise(0)).alias("advert"), (acc["bits"] + x["bits"] * x["chars"]).alias("bits"),
    )
    rows = scored.select("doc_id", F.aggregate(each, zero, add).alias("t"))
    whole = F.greatest(F.col("t.whole"), F.lit(1.0))
    return rows.select("doc_id", (F.col("t.advert") / whole).alias("advert_share"), (F.col("t.odd") / whole).alias("abnormal_share"), F.when(F.col("t.whole") > 0, F.pow(F.lit(2.0), F.col("t.bits") / whole)).alias("perplexity"))


def spam_pages(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``(doc_id)``: texts more than half of which is advertising, as ``score_pages`` finds it."""
    return score_pages(df, id_column, text_column).where(F.col("advert_share") > PAGE_SHARE).select("doc_id").distinct()
