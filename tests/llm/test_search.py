"""Nearest neighbours and the best of each group against brute force."""

import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from mnemoria.llm.neighbours import nearest_neighbours, scan_list
from mnemoria.llm.topn import top_n_per_group

VEC = "id string, embedding array<float>"


def brute(ids, x, k, least):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = unit @ unit.T
    out = set()
    for i in range(len(ids)):
        near = sorted((-round(float(s[i, j]), 6), ids[j]) for j in range(len(ids)) if j != i and s[i, j] >= least - 1e-9)[:k]
        out |= {(ids[i], n) for _, n in near}
    return out


def clustered(n, dims, seed):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((max(2, n // 25), dims))
    return (centres[rng.integers(0, len(centres), n)] + 0.3 * rng.standard_normal((n, dims))).astype(np.float32)


def test_recall_against_brute_force(spark):
    x = clustered(900, 64, 1)
    ids = [f"k{i:04}" for i in range(len(x))]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], VEC)
    got = {(r["id"], r["neighbour"]) for r in nearest_neighbours(df, "id", "embedding", 5, 0.8).collect()}
    want = brute(ids, x.astype(float), 5, 0.8)
    assert len(got & want) >= 0.97 * len(want) and len(got & want) >= 0.97 * len(got)


def test_probes_follow_the_number_of_lists_and_exact_finds_all(spark):
    # many small lists: a fixed number of probes would lose most neighbours
    x = np.random.default_rng(7).standard_normal((700, 16)).astype(np.float32)
    ids = [f"k{i:04}" for i in range(len(x))]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], VEC)
    want = brute(ids, x.astype(float), 5, -2)
    got = lambda **how: {(r["id"], r["neighbour"]) for r in nearest_neighbours(df, "id", "embedding", 5, dims=16, lists=128, **how).collect()}
    few, measured, exact = got(probes=4), got(), got(exact=True)
    assert len(few & want) < 0.8 * len(want) <= 0.9 * len(want) <= len(measured & want)
    assert len(exact & want) >= 0.999 * len(want) and len(exact) == len(want)


def test_without_a_least_similarity(spark):
    x = clustered(300, 16, 2)
    ids = [f"k{i:04}" for i in range(len(x))]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], VEC)
    got = {(r["id"], r["neighbour"]) for r in nearest_neighbours(df, "id", "embedding", 3, dims=16).collect()}
    want = brute(ids, x.astype(float), 3, -2)
    assert len(got) == 900 and len(got & want) >= 0.9 * len(want)


def test_twins_unusable_vectors_and_ties(spark):
    a, b, far = [1.0, 0.0, 0.0, 0.0], [0.9, 0.1, 0.0, 0.0], [0.0, 0.0, 1.0, 0.0]
    rows = [(f"t{i:02}", a) for i in range(9)] + [("near", b), ("far", far), ("null", None), ("short", [1.0]), ("empty", []), ("zero", [0.0] * 4), ("nan", [1.0, float("nan"), 0.0, 0.0]), ("inf", [float("inf"), 0.0, 0.0, 0.0]), (None, a), ("hole", [1.0, None, 0.0, 0.0]), ("tiny", [1e-30, 0.0, 1e-38, 0.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], VEC + ", vec string")
    got = {}
    for r in nearest_neighbours(df, "id", "embedding", 3, 0.8, dims=4).collect():
        got.setdefault(r["id"], []).append(r["neighbour"])
    got = {k: sorted(v) for k, v in got.items()}
    assert got["t00"] == ["t01", "t02", "t03"] and got["t08"] == ["t00", "t01", "t02"] and "far" not in got and set(got) == {*(f"t{i:02}" for i in range(9)), "near", "tiny"}
    assert got["near"] == ["t00", "t01", "t02"]
    assert nearest_neighbours(df.limit(0), "id", "embedding", dims=4).count() == 0
    assert nearest_neighbours(df.where("id = 'far'"), "id", "embedding", dims=4).count() == 0


def test_scan_list_abandons_nothing_close():
    x = clustered(200, 64, 3)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    i, j, dist = scan_list(x, x, np.full(len(x), 0.4, np.float32))
    whole = ((x[:, None] - x[None]) ** 2).sum(2)
    kept = {(a, b) for a, b, d in zip(i, j, dist) if d <= 0.4}
    want = set(map(tuple, np.argwhere(whole <= 0.4)))
    assert len(kept & want) >= 0.97 * len(want) and np.allclose(dist, whole[i, j], atol=1e-4)


TOP = "g string, score double, k string, n long"


def best(rows, n):
    out = []
    for g in {r[0] for r in rows if r[0] is not None}:
        mine = {(s + 0.0, k, m) for h, s, k, m in rows if h == g and s is not None and s == s}
        order = sorted(mine, key=lambda r: (-r[0], r[1] is None, (r[1] or "").encode(), r[2] is None, r[2] or 0))[:n]
        out += [(g, *r, i) for i, r in enumerate(order, 1)]
    return sorted(out, key=repr)


def got(df, n):
    return sorted(map(tuple, top_n_per_group(df, "g", "score", "k", "n", n).collect()), key=repr)


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(
        st.tuples(st.sampled_from(["a", "b", None]), st.sampled_from([None, float("nan"), 0.0, -0.0, 1.0, 0.5, 0.50000001, float("inf"), float("-inf"), 1e308, -1e308, 1e-300]), st.sampled_from([None, "", "x", "x\0", "xé", "longer key 1", "longer key 2", "longer key 1\0\0"]), st.sampled_from([None, 0, -5, 7, 2**62, -(2**62)])),
        max_size=30,
    ),
    st.integers(1, 4),
)
def test_top_n_like_sorting(spark, rows, n):
    assert got(spark.createDataFrame(rows, TOP), n) == best(rows, n)


def test_top_n_in_a_large_group_with_many_ties(spark):
    r = random.Random(5)
    rows = [("hot", r.choice([1.0, 1.0, 0.9, r.random()]), f"event:click:{r.randrange(400)}", r.randrange(3)) for _ in range(4000)] + [(f"g{i}", 0.5, "k", 1) for i in range(50)]
    df = spark.createDataFrame(rows + rows[:100], TOP).selectExpr("*", "1 as level", "'c' as bucket")
    assert got(df, 5) == best(rows, 5)
    assert got(df.limit(0), 5) == []


def test_many_groups_fewer_rows_than_n(spark):
    rows = [(f"g{i % 40}", i / 7, f"k{i}", i) for i in range(80)]
    assert got(spark.createDataFrame(rows, TOP), 3) == best(rows, 3)


@pytest.mark.parametrize("n", [1, 2])
def test_top_n_with_equal_rows_but_for_the_number(spark, n):
    rows = [("a", 1.0, "same key that is long", i) for i in (5, 3, 9, 2**40, -1)]
    assert got(spark.createDataFrame(rows, TOP), n) == best(rows, n)
