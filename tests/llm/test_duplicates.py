"""Formatting copies and near duplicates against brute force."""

import json
import random
import re

import pytest

from mnemoria.llm import near_dup
from mnemoria.llm.folding import class_hashes, fields, poly_hashes, same_left, same_text
from mnemoria.llm.format_dup import copy_counts, format_copies
from mnemoria.llm.near_dup import classes_with_links, expand_pairs, near_duplicates
from mnemoria.llm.words import shingles, word_hashes, words


def pairs(df):
    return sorted(map(tuple, df.collect()))


VALUES = [
    "Hello, World 12", "hello world-12", "HELLO\tWORLD 1 2", "hello world 13", "İstanbul Äpfel ß", "i̇stanbul äpfel ß!", "", "   ", "--- ***", None, "{}", '{"": ""}',
    '{"a": 1, "b": "x y"}', '{"B": "X-Y", "A": "1"}', "a=1; b=x y", "b = X Y ;a=1;", "a=1; b=xy; a=1", "a=1", '{"a": 1}', '{"a": {"c": [1, true, null]}}', '{"a": "c 1 true null"}', "a1", "A=1 and b", "x; a=1", '["a", 1]', "a 1", '{"a": 1', "naïve 日本語 テキスト", "NAÏVE日本語テキスト",
    '{"n": 1.50}', "n=1.50", "n=1.5", "😀", "x" * 5000, " ".join("x" * 5000),
]


def reduced(text):
    return "".join(next((c for c in x.lower() if c.isalnum()), "") if x.isalnum() else "" for x in text)


def canonical(value):
    found = fields(value)
    return "t" + reduced(value) if found is None else "f" + json.dumps(sorted({(reduced(n), reduced(v)) for n, v in found} - {("", "")}))


def test_fold_and_hash_classes_agree_with_canonical_forms():
    values = [v.encode("utf-16", "surrogatepass").decode("utf-16") for v in VALUES if v is not None]
    h1, h2, left = class_hashes(values)
    for i, a in enumerate(values):
        assert left[i] == (len(canonical(a)) > 1 and canonical(a) != "f[]")
        for j, b in enumerate(values):
            if left[i] and left[j]:
                assert ((h1[i], h2[i]) == (h1[j], h2[j])) == (canonical(a) == canonical(b)) == same_left(a, b), (a, b)
    assert fields("a=b;;c=d")[1] == ("c", "d") and fields("=") == [("", "")] and fields("no") is None and fields("a=1;b") is None


def test_hashes_and_comparisons_run_in_blocks(monkeypatch):
    from mnemoria.llm import folding

    r = random.Random(2)
    texts = ["", "...", *["".join(r.choice("aB1 -_é日") for _ in range(n)) for n in (1, 3, 5, 40, 63, 64, 65, 200)], "", "x" * 130, " " * 150, "y"]
    whole = [x.tolist() for x in poly_hashes(texts)]
    for block in (1, 7, 64):
        monkeypatch.setattr(folding, "BLOCK", block)
        assert [x.tolist() for x in poly_hashes(texts)] == whole
    assert whole[2] == [len(reduced(t)) for t in texts]
    long = "ab-" * 50_000
    want = [0, 0]
    for i, c in enumerate(reduced(long)):
        want = [(w + ord(c) * pow(b, i, m)) % m for w, b, m in zip(want, folding.BASES, folding.MODULI)]
    assert poly_hashes([long])[0].tolist() == [(want[0] << 31) | want[1]]
    for a in texts:
        for b in [*texts, a.upper(), "-".join(a), a + " !", a + "z", a[:-1] + "q"]:
            assert len({same_text(a, b, block) for block in (1, 3, 64, 4096)} | {reduced(a) == reduced(b)}) == 1, (a, b)


def test_format_copies_on_all_cases(spark):
    rows = [(f"k{i:02}", v, "clash", i) for i, v in enumerate(VALUES)] + [(None, "hello world 12", "c", 0), ("k99", "hello world 12", "c", 0)]
    df = spark.createDataFrame(rows, "id string, value string, h1 string, n int")
    want, groups = [], {}
    for k, v, *_ in rows:
        if k and v is not None and len(canonical(v)) > 1 and canonical(v) != "f[]":
            groups.setdefault(canonical(v), []).append(k)
    for g in groups.values():
        want += [(min(g), k) for k in g if k != min(g)]
    assert pairs(format_copies(df, "id", "value")) == sorted(want)
    assert {r["rep"]: r["copies"] for r in copy_counts(df, "id", "value").collect()} == {min(g): len(g) for g in groups.values() if len(g) > 1}
    assert pairs(format_copies(df.limit(0), "id", "value")) == []


def test_a_class_of_a_third_of_all_rows(spark):
    df = spark.createDataFrame([(f"h{i:04}", "Heart beat!" if i % 2 else "heart-beat") for i in range(700)] + [(f"x{i}", f"value {i}") for i in range(1400)], "id string, value string")
    assert {r["rep"]: r["copies"] for r in copy_counts(df, "id", "value").collect()} == {"h0000": 700}


def test_colliding_hashes_are_told_apart(spark, monkeypatch):
    """With hashes that all collide, exact comparison still finds the right classes."""
    import numpy as np

    from mnemoria.llm import format_dup

    def collide(batches):
        import pyarrow as pa

        for b in batches:
            zero = pa.array(np.zeros(b.num_rows, np.int64))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("value"), zero, zero], ["id", "value", "h1", "h2"])

    monkeypatch.setattr(format_dup, "_hash_batches", collide)
    df = spark.createDataFrame([("a", "one"), ("b", "two"), ("c", "TWO"), ("d", "One"), ("e", "x=1"), ("f", "X = 1")], "id string, value string")
    assert pairs(format_copies(df, "id", "value")) == [("a", "d"), ("b", "c"), ("e", "f")]


def test_words_and_shingles():
    assert words("Ab_c, d-É1!") == ["ab", "c", "d", "é1"]
    texts = ["one two three four", "", "ONE-two", "a b c", "日本 x_y z", "İ i"]
    hashes, bounds = word_hashes(texts)
    assert [b - a for a, b in zip(bounds, bounds[1:])] == [len(words(t)) for t in texts]
    assert hashes[0] == hashes[4] and hashes[1] == hashes[5]
    grams, gram_bounds = shingles(hashes, bounds, 3)
    assert [b - a for a, b in zip(gram_bounds, gram_bounds[1:])] == [2, 0, 0, 1, 2, 0] and len(set(grams.tolist())) == 5


def sets_of(v, k):
    w = re.findall(r"[^\W_]+", v.lower())
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= 12 else None


def brute(rows, k, t):
    usable = [(i, kind, s) for i, v, kind in rows if i and v is not None and fields(v) is None and (s := sets_of(v, k))]
    out = []
    for x, (i, ka, a) in enumerate(usable):
        for j, kb, b in usable[x + 1 :]:
            if ka == kb and len(a & b) >= t * len(a | b):
                out.append((min(i, j), max(i, j)))
    return sorted(out)


def corpus(seed, n, vocabulary):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        if rows and r.random() < 0.55:
            w = r.choice(rows)[1].split()
            for _ in range(r.randint(0, 6)):
                at = r.randrange(len(w))
                w[at : at + r.choice([0, 1, 1])] = r.choice([[], [f"w{r.randrange(vocabulary)}"], [w[at].upper()]])
                w = w or ["w0"]
            if r.random() < 0.3:
                cut = r.randrange(len(w))
                w = w[cut:] + w[:cut]
        else:
            w = [f"w{r.randrange(vocabulary)}" for _ in range(r.choice([3, 12, 13, 20, 40, 90, 200]))]
            if r.random() < 0.05:
                w = ["same"] * 30
        rows.append((f"k{i:04}", r.choice([" ", ", ", "_"]).join(w) if r.random() < 0.2 else " ".join(w), r.choice(["a", "a", "b", None])))
    return rows


@pytest.mark.parametrize(("seed", "vocabulary", "k", "t"), [(1, 6, 3, 0.5), (2, 60, 3, 0.5), (3, 500, 3, 0.5), (4, 40, 3, 0.65), (5, 30, 5, 0.8)])
def test_near_duplicates_lose_no_pair(spark, seed, vocabulary, k, t):
    rows = corpus(seed, 260, vocabulary) + [("null", None, "a"), ("empty", "", "a"), (None, "w1 " * 14, "a"), ("list", json.dumps({f"f{i}": i for i in range(14)}), "a")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "id string, value string, kind string, tokens int")
    found, members = near_duplicates(df, "id", "value", "kind", k, t)
    assert pairs(expand_pairs(found, members).distinct()) == brute(rows, k, t)
    listed = classes_with_links(found, members).collect()
    assert len(listed) == len({r["id"] for r in listed}) == sum(1 for i, v, _ in rows if i and v is not None and fields(v) is None and sets_of(v, k))


def test_empty_and_bad_parameters(spark):
    df = spark.createDataFrame([], "id string, value string, kind string")
    found, members = near_duplicates(df, "id", "value", "kind")
    assert found.count() == members.count() == 0
    with pytest.raises(ValueError):
        near_duplicates(df, "id", "value", "kind", similarity=0.3)
    assert near_dup.hash_text(None) != near_dup.hash_text("")


def test_many_copies_of_one_text_are_one_class(spark):
    text = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(f"c{i:04}", text, "a") for i in range(500)] + [("near", text + " more", "a")], "id string, value string, kind string")
    found, members = near_duplicates(df, "id", "value", "kind")
    assert pairs(found.select("rep_a", "rep_b")) == [("c0000", "near")] and members.count() == 501
    assert {(r["copies"], r["links"]) for r in classes_with_links(found, members).collect()} == {(500, 1), (1, 1)}


def test_counts_are_added_in_rounds(spark, monkeypatch):
    import numpy as np

    counts = np.zeros((2, near_dup.COUNTERS), np.uint16)
    counts[0, 5], counts[1, 9] = 7, 3
    rows = [(c, p.tobytes()) for c, p in enumerate(counts.reshape(near_dup._CHUNKS, -1))] * 9
    df = spark.createDataFrame(rows, "chunk int, counts binary").repartition(9)
    once = near_dup.token_frequencies(df)
    monkeypatch.setattr(near_dup, "GROUP_PARTS", 4)
    assert (near_dup.token_frequencies(df) == once).all()
    assert once[0, 5] == near_dup._levels(np.array([63]))[0] and once[1, 9] == near_dup._levels(np.array([27]))[0] and (once > 0).sum() == 2


@pytest.mark.parametrize(("k", "t", "spare"), [(3, 0.5, 1.5), (5, 0.8, 1.5), (5, 0.8, 0.1), (3, 0.7, 0.4)])
def test_hot_signatures_and_crowded_segments_lose_no_pair(spark, k, t, spare):
    rows = corpus(11, 220, 12)
    df = spark.createDataFrame(rows, "id string, value string, kind string")
    if spare < 1:
        # too few segments: records fall back to single tokens
        tokens, bounds, _ = near_dup.token_sets([v for _, v, _ in rows], [x for *_, x in rows], k)
        assert 0 < near_dup.covered(tokens, bounds, t, spare).sum() < len(rows)
    found, members = near_duplicates(df, "id", "value", "kind", k, t, spare=spare, hot_records=4)
    assert pairs(expand_pairs(found, members).distinct()) == brute(rows, k, t)
    assert found.count() == found.select("rep_a", "rep_b").distinct().count()
