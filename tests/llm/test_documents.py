"""Packing, leaked passages and spam pages."""

import random
from collections import defaultdict

import numpy as np
import pytest

from mnemoria.llm.leak import Items, align, find_leaks, longest_run
from mnemoria.llm.packing import OpenBins, pack, pack_sizes, token_counts
from mnemoria.llm.spam import encode, page_shares, score_pages, segment_scores, spam_pages

DOCS = "doc_id long, text string"


@pytest.mark.parametrize("seed", range(5))
def test_bins_hold_and_nothing_is_split_or_lost(seed):
    r = random.Random(seed)
    sizes = [r.choice([0, 1, r.randint(1, 100), r.randint(1, 300), 100, 101, 200]) for _ in range(600)]
    pieces, fill, parts = pack_sizes(sizes, 100, 8), defaultdict(int), defaultdict(list)
    for item, part, first, name in pieces:
        size = min(100, sizes[item] - first)
        fill[name] += size
        parts[item].append((part, first, size))
    assert max(fill.values()) <= 100 and sorted(parts) == list(range(600))
    for item, found in parts.items():
        assert sum(s for *_, s in found) == sizes[item] and len(found) == max(1, -(-sizes[item] // 100))
    assert len(fill) <= 1.25 * -(-sum(sizes) // 100) + 8


def test_best_fit_and_closing_of_the_fullest():
    bins = OpenBins(10, 2)
    assert [bins.put(s) for s in (6, 7, 3, 4)] == [0, 1, 1, 0]  # the tighter bin takes each
    assert [bins.put(s) for s in (9, 8, 7, 1, 2)] == [2, 3, 4, 3, 4]  # bin 2, the fullest, closed for bin 4
    assert [OpenBins(5).put(s) for s in (5, 0)] == [0, 0]


def test_pack_documents(spark):
    long = "word " * 6000
    texts = [None, "", " ", long, *[f"text number {i} " * (i % 50) for i in range(200)], long]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(3, "again", 1)], DOCS + ", container int")
    rows = pack(df, "doc_id", "text", 512).collect()
    counts = {r["id"]: r["n_tokens"] for r in token_counts(df.where("doc_id <> 3"), "doc_id", "text").collect()}
    fill, whole = defaultdict(int), defaultdict(int)
    for r in rows:
        fill[r["container"]] += r["n_tokens"]
        whole[r["id"]] += r["n_tokens"]
        assert r["part"] == 0 or r["first_token"] == 512 * r["part"]
    assert max(fill.values()) <= 512 and all(whole[i] == n for i, n in counts.items()) and set(whole) == set(range(len(texts)))
    assert sum(fill.values()) / (512 * sum(1 for v in fill.values() if v)) > 0.9
    assert pack(df.limit(0), "doc_id", "text").count() == 0
    with pytest.raises(ValueError):
        pack(df, "doc_id", "text", 0)


def test_alignment_and_runs():
    a = np.array([1, 2, 3, 4, 5, 6], np.int32)
    assert align(a, np.array([0, 1, 2, 3, 4, 5, 6, 0], np.int32)) == (12, 6, 6, 1, 7)
    score, equal, columns, first, last = align(a, np.array([1, 2, 9, 3, 4, 6], np.int32))
    assert (score, equal, columns, first, last) == (8, 5, 7, 0, 6)
    assert align(a, np.zeros(4, np.int32))[0] == 0
    assert longest_run(a, np.array([1, 2, 0, 3, 4, 5, 1, 2], np.int32)) == 3


def passage(r, n):
    return " ".join(f"w{r.randrange(3000)}" for _ in range(n))


def test_leaks_like_brute_force(spark):
    r = random.Random(3)
    items = [(i, passage(r, r.choice([4, 10, 30, 60]))) for i in range(40)] + [(90, None), (91, ""), (92, "...")]
    docs = []
    for i in range(300):
        text = passage(r, r.choice([0, 5, 80, 400])).split()
        for _ in range(r.choice([0, 0, 1, 2])):
            words = (r.choice(items[:40])[1]).split()
            size = r.choice([6, 9, 10, 11, len(words)])
            at = r.randrange(max(1, len(words) - size + 1))
            place = r.randrange(len(text) + 1)
            text[place:place] = [w.upper() for w in words[at : at + size]]
        docs.append((i, r.choice([" ", "_", ", "]).join(text)))
    docs += [(900, None), (901, ""), docs[5]]
    want = set()
    for d, t in docs:
        words = (t or "").lower().replace("_", " ").replace(",", " ").split()
        grams = {tuple(words[i : i + 10]) for i in range(len(words) - 9)}
        for i, p in items:
            w = (p or "").split()
            if any(tuple(w[j : j + 10]) in grams for j in range(len(w) - 9)):
                want.add((d, i))
    df = spark.createDataFrame([(*x, 0) for x in docs], DOCS + ", item_id int")
    it = spark.createDataFrame(items, "item_id long, passage string")
    found = find_leaks(df, it).where("longest_run >= 10")
    assert {(x["doc_id"], x["item_id"]) for x in found.collect()} == want and found.count() == len(want)
    assert find_leaks(df.limit(0), it).count() == find_leaks(df, it.limit(0)).count() == 0


def test_edited_copies_are_found(spark):
    r = random.Random(8)
    words = passage(r, 60).split()
    edited = [w if i % 9 else "other" for i, w in enumerate(words)]
    df = spark.createDataFrame([(1, passage(r, 100) + " " + " ".join(edited) + " " + passage(r, 100)), (2, passage(r, 260))], DOCS)
    rows = find_leaks(df, spark.createDataFrame([(7, " ".join(words))], "item_id long, passage string")).collect()
    assert [(x["doc_id"], x["item_id"]) for x in rows] == [(1, 7)]
    assert rows[0]["longest_run"] == 8 and rows[0]["identity"] > 0.8 and rows[0]["covered"] > 0.8 and rows[0]["from_word"] in range(99, 103)


def test_edited_copies_are_found_beside_whole_copies(spark):
    r = random.Random(9)
    words = passage(r, 60).split()
    edited = [w if i % 9 else "other" for i, w in enumerate(words)]
    # what one copy leaves whole the other breaks
    shifted = [w if (i + 5) % 9 else "else" for i, w in enumerate(words)]
    texts = [" ".join(words), " ".join(edited), " ".join(shifted), passage(r, 300), " ".join(words[20:26])]
    df = spark.createDataFrame([(i, passage(r, 100) + " " + t + " " + passage(r, 100)) for i, t in enumerate(texts)] + [(10 + i, " ".join(words)) for i in range(3)], DOCS)
    rows = find_leaks(df, spark.createDataFrame([(7, " ".join(words))], "item_id long, passage string")).collect()
    assert sorted(x["doc_id"] for x in rows) == [0, 1, 2, 10, 11, 12] and all(x["score"] >= 80 for x in rows)


def full_align(passage, text):
    """Scores of the whole table at once."""
    from mnemoria.llm.leak import GAP, MATCH, MISMATCH

    score = np.zeros((len(passage) + 1, len(text) + 1), int)
    for i in range(1, len(passage) + 1):
        for j in range(1, len(text) + 1):
            hit = passage[i - 1] == text[j - 1] and text[j - 1] > 0
            score[i, j] = max(0, score[i - 1, j - 1] + (MATCH if hit else MISMATCH), score[i - 1, j] + GAP, score[i, j - 1] + GAP)
    return int(score.max())


def test_alignment_keeps_few_rows_and_loses_nothing():
    r = np.random.default_rng(5)
    for n, m in ((1, 1), (3, 9), (10, 40), (17, 30), (30, 60)):
        for _ in range(6):
            a, b = r.integers(1, 6, n).astype(np.int32), r.integers(0, 6, m).astype(np.int32)
            score, equal, columns, first, last = align(a, b)
            assert score == full_align(a, b) and score == 3 * equal - columns and 0 <= first <= last <= m


def test_long_stretches_are_cut_without_loss():
    from mnemoria.llm.leak import _regions

    for size, end, starts in ((10, 100_000, range(0, 99_000, 7)), (4000, 90_000, range(0, 80_000, 50)), (5, 30, [2, 20]), (5, 5, [0])):
        parts = _regions(list(starts), size, end)
        covered = set()
        for a, b in parts:
            assert 0 <= a < b <= end and b - a <= max(20_000, 6 * size)
            covered |= set(range(a, b, max(1, size // 3)))
        for start in starts:
            low, high = max(0, start), min(end, start + 3 * size)
            if high <= start + 2 * size:
                assert any(a <= low and high <= b for a, b in parts)


@pytest.mark.parametrize(("edited", "least"), [(0.05, 0.99), (0.1, 0.95), (0.2, 0.7)])
def test_recall_of_edited_copies(spark, edited, least):
    r = random.Random(int(edited * 100))
    items = [(i, passage(r, 60)) for i in range(120)]
    docs = []
    for i, text in items:
        words = text.split()
        for _ in range(round(edited * len(words))):
            at = r.randrange(len(words))
            words[at : at + 1] = r.choice([[], [f"x{r.randrange(999)}"], [words[at], f"y{r.randrange(999)}"]])
        docs.append((i, passage(r, 150) + " " + " ".join(words) + " " + passage(r, 150)))
    found = find_leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, passage string"))
    hits = {x["doc_id"] for x in found.where("doc_id = item_id").collect()}
    assert len(hits) / len(items) >= least, len(hits) / len(items)


def test_short_passages_say_nothing(spark):
    df = spark.createDataFrame([(1, "the cat sat on the mat and slept")], DOCS)
    it = spark.createDataFrame([(1, "the"), (2, "cat sat on the"), (3, "cat sat on the mat")], "item_id long, passage string")
    assert [x["item_id"] for x in find_leaks(df, it).collect()] == [3]


def test_packing_does_not_depend_on_the_split_of_files(spark):
    df = spark.createDataFrame([(i, f"word {i} " * (i % 40)) for i in range(300)] + [(7, "twice"), (7, "twice")], DOCS)
    pack_of = lambda n: sorted(map(tuple, pack(df.repartition(n, "text"), "doc_id", "text", 128).collect()))
    assert pack_of(1) == pack_of(7)


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    from mnemoria.llm import leak

    r = random.Random(4)
    items = [(i, passage(r, 20)) for i in range(12)]
    df = spark.createDataFrame([(i, passage(r, 30) + " " + items[i % 12][1]) for i in range(30)], DOCS)
    it = spark.createDataFrame(items, "item_id long, passage string")
    whole = sorted(map(tuple, find_leaks(df, it).collect()))
    monkeypatch.setattr(leak, "BLOCK_WORDS", 100)
    assert sorted(map(tuple, find_leaks(df, it).collect())) == whole and len(whole) == 30
    assert Items([]).lengths == []


PROSE = "The mill of Torsin was built in 1820 and is known for its wheel. After the war it was closed, and the river that fed it dried up. Local records mention a bridge, a dry canal and 40 houses. "
SPAM = {
    "keywords": "cheap pills online buy cheap pills best price pills discount shoes order online shoes cheap store " * 6,
    "links": "\n".join(f"* [https://shop{i}-shoes.example/cheap{i} buy shoes Torsin]" for i in range(12)),
    "bare links": "\n".join(f"https://deal{i}-casino.example/bonus{i}" for i in range(12)),
    "tags": "Tags: " + " | ".join(f"size {i} | red shoes | sku {i}99 | discount shoes" for i in range(12)),
    "prices": "{|\n" + "\n".join(f"|-\n| [https://x{i}-tyres.example/sale cheap tyres] || order online || sale {i}9.99" for i in range(10)) + "\n|}",
}
FINE = {
    "prose": PROSE * 4, "little spam": PROSE * 6 + "\n" + SPAM["links"][:200], "stub": "'''Torsin''' is a village. {{stub}}", "redirect": "#REDIRECT [[Torsin]]",
    "table": "{| class=\"wikitable\"\n" + "\n".join(f"|-\n| [[Place{i}]] || {i}123 || market || 18{i}" for i in range(10, 30)) + "\n|}", "list": "\n".join(f"* [[Place{i}]] (18{i})" for i in range(10, 40)),
    "sources": "== References ==\n" + "\n".join(f"* [https://archive{i}.example/a/{i} Survey of Torsin], 19{i}." for i in range(10, 30)), "nonsense": "asdk jfla; sdkfj as;dlk fjas dfjkl; asdf " * 10, "glossary": "\n".join(f"; word{i}\n: a thing of the mill that turns" for i in range(20)),
}


def test_spam_pages_and_pages_that_only_look_odd(spark):
    names = [*SPAM, *FINE]
    rows = [(i, (SPAM | FINE)[n]) for i, n in enumerate(names)] + [(100 + i, PROSE * 3) for i in range(60)] + [(900, None), (901, ""), (0, SPAM["keywords"])]
    df = spark.createDataFrame([(*r, "x") for r in rows], DOCS + ", codes string")
    found = sorted(r["doc_id"] for r in spam_pages(df, "doc_id", "text").collect())
    assert [names[i] for i in found] == list(SPAM)
    scores = score_pages(df, "doc_id", "text")
    assert scores.count() == len(rows) - 1 and scores.where("doc_id = 901").first()["advert_share"] == 0
    assert spam_pages(df.limit(0), "doc_id", "text").count() == 0
    assert spam_pages(df.where("doc_id >= 900"), "doc_id", "text").count() == 0


def test_spam_without_any_listed_word(spark):
    r = random.Random(5)
    stems, places = ["kopula", "marfen", "tilost", "gerani", "bosk"], ["Zelrara", "Galkiberg", "Torsin", "Ulmnor", "Fosgor", "Rilmoquen", "Drenavik"]
    glued = [" ".join("#" + "".join(r.sample(stems, 2) + [r.choice(places)]) for _ in range(40))]
    spam = [*glued, " ".join(r.choice(stems + places[:1]) for _ in range(120)), ", ".join(" ".join(r.sample(stems, 2) + [r.choice(places)]) for _ in range(50)), "\n".join(f"* [https://a{i}-bosk.example/{i} kopula marfen]" for i in range(12))]
    names = "".join(f"#{r.choice(places)}{chr(97 + i)}\n" for i in range(20))
    backwards = (PROSE * 3)[::-1]
    fine = [names, backwards, PROSE * 6 + "\n" + glued[0][:200], "#REDIRECT [[Torsin]]", "#redirect [[Torsin]]\n#redirect [[Ulmnor]]"]
    rows = list(enumerate(spam + fine)) + [(100 + i, PROSE * 3) for i in range(60)]
    found = sorted(x["doc_id"] for x in spam_pages(spark.createDataFrame(rows, DOCS), "doc_id", "text").collect())
    assert found == list(range(len(spam)))


def test_the_model_decides(spark):
    # sentences about one thing repeat its words as advertising does; only their perplexity tells them apart
    r = random.Random(6)
    stems = ["kopula", "marfen", "tilost"]
    calm = " ".join(f"The {r.choice(stems)} of Torsin is near the {r.choice(stems)}, and the {r.choice(stems)} was built with a {r.choice(stems)} in it." for _ in range(12))
    stuffed = " ".join(r.choice(stems) for _ in range(120))
    rows = [(1, calm), (2, stuffed)] + [(100 + i, PROSE * 3) for i in range(60)] + [(200 + i, calm) for i in range(5)]
    scored, low, high = segment_scores(spark.createDataFrame(rows, DOCS), "doc_id", "text")
    flagged = lambda lo, hi: {x["doc_id"] for x in page_shares(scored, lo, hi).where("advert_share > 0.5").collect()}
    assert low < high and flagged(low, high) == {2}
    assert {1, 2} <= flagged(float("inf"), float("inf"))
    assert flagged(float("-inf"), float("inf")) == set()


def test_segments_cover_the_text():
    codes, flags, lengths, ends, sizes = encode(["One two. " * 30 + "\n\nx\n" + "word " * 100, "", "last"])
    assert len(codes) == len(flags) == len(lengths) == len(ends) == sizes.sum() and sizes[1] == 0 and ends[-1]
    assert max(np.diff(np.flatnonzero(np.concatenate([[True], ends])))) <= 33
    assert ends[sizes[0] - 1] and [len(x) for x in encode([])] == [0] * 5 and encode([""])[4].tolist() == [0]


def test_batches_by_size_keep_all_rows():
    import pyarrow as pa

    from mnemoria.llm.batches import by_size

    texts = ["a" * n for n in (3, 0, 50, 4, 4, 4, 120, 1)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array(texts)], ["i", "t"])
    parts = list(by_size(iter([batch, batch.slice(0, 0)]), "t", limit=12))
    assert [x for p in parts for x in p.column("i").to_pylist()] == list(range(9)) and [x for p in parts for x in p.column("t").to_pylist()] == texts
    assert all(p.num_rows == 1 or sum(len(x or "") for x in p.column("t").to_pylist()) <= 12 for p in parts)
