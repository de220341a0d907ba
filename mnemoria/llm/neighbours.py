"""The most similar vectors of every vector: an inverted file with adaptive dimension scans."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.skew import skewed_lookup
from ..session import materialize

#: Vectors that the centroids are fitted on at most (a bounded sample; every vector is indexed).
SAMPLE = 65_536
SAMPLE_PER_LIST = 16
MAX_LISTS = 4_096
#: Lists of one cell. A cell is the unit that moves: a query goes once to each cell with lists it probes.
LISTS_PER_CELL = 16
#: Share of true neighbours that the probed lists must hold, measured on so many vectors against all others.
RECALL, MEASURED = 0.995, 256
#: Lists that are probed at least.
PROBES = 12
#: Dimensions that are looked at before each test.
COLUMN_BLOCK = 16
#: Confidence of the tests: a candidate is dropped when its estimated distance exceeds the bound by this many deviations.
EPSILON = 2.1
#: Vectors of a cell, or queries to it, that one task holds.
BLOCK_HOMES, BLOCK_QUERIES = 16_384, 32_768
_CELLS_AT_ONCE = 4_000_000
#: Seed of the rotation and the centroids.
SEED = 20_240_607


def rotation(dims: int) -> np.ndarray:
    """A random orthogonal matrix, the same in every run."""
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def _prepare(dims: int):
    """Usable vectors: turned, of length one, as bytes."""

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = rotation(dims)
        for batch in batches:
            vectors = batch.column("embedding")
            right = np.flatnonzero(np.asarray(pa.compute.fill_null(pa.compute.equal(pa.compute.list_value_length(vectors), dims), False)))
            taken = batch.take(pa.array(right))
            flat = taken.column("embedding").flatten()
            raw = np.asarray(flat.cast(pa.float64()).fill_null(np.nan)).reshape(-1, dims)
            with np.errstate(invalid="ignore", over="ignore"):
                top = np.abs(raw).max(axis=1, initial=0)
                good = np.isfinite(raw).all(axis=1) & (top > 0)
                raw, taken = raw[good] / top[good, None], taken.filter(pa.array(good))
            unit = (raw / np.linalg.norm(raw, axis=1, keepdims=True)) @ turn
            packed = np.ascontiguousarray(unit, np.float32)
            yield pa.RecordBatch.from_arrays(
                [taken.column("id"), taken.column("h1"), taken.column("h2"), pa.array([v.tobytes() for v in packed], pa.binary())], ["id", "h1", "h2", "vec"]
            )

    return prepare


def _matrix(column, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float32).reshape(-1, dims)


def fit_centroids(sample: np.ndarray, lists: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means; lists left empty are begun anew from the worst-served vectors."""
    rng = np.random.default_rng(SEED)
    centroids = sample[rng.choice(len(sample), lists, replace=len(sample) < lists)].copy()
    for _ in range(rounds):
        near = sample @ centroids.T
        home, best = near.argmax(1), near.max(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, home, sample)
        empty = np.flatnonzero(np.bincount(home, minlength=lists) == 0)
        sums[empty] = sample[np.argsort(best)[: len(empty)]] if len(empty) <= len(sample) else sample[rng.choice(len(sample), len(empty))]
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = (sums / np.where(norm > 0, norm, 1)).astype(np.float32)
    return centroids


class Index:
    """Centroids and the cell of each list."""

    def __init__(self, sample: np.ndarray, lists: int):
        self.centroids = fit_centroids(sample, lists)
        cells = max(1, lists // LISTS_PER_CELL)
        self.cell = (self.centroids @ fit_centroids(self.centroids, cells).T).argmax(1) if cells > 1 else np.zeros(lists, np.int64)

    def probes(self, vectors: np.ndarray, n: int) -> np.ndarray:
        """The n nearest lists of each vector, the nearest first."""
        near = vectors @ self.centroids.T
        n = min(n, near.shape[1])
        top = np.argpartition(-near, n - 1, axis=1)[:, :n]
        return np.take_along_axis(top, np.argsort(-np.take_along_axis(near, top, 1), axis=1, kind="stable"), 1)


def _deal(index, dims: int, probes: int, homes_of: dict[int, int], queries_of: dict[int, int]):
    """Each vector goes to its own list as a candidate, and to each cell it probes as a query."""

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Index = index.value
        for batch in batches:
            if not len(batch):
                continue
            lists = held.probes(_matrix(batch["vec"], dims), probes)
            cells = held.cell[lists]
            code = pd.util.hash_array(batch["rep"].to_numpy(object)).astype(np.int64) & 0x7FFFFFFF
            rows = []
            for i, (rep, vec) in enumerate(zip(batch["rep"], batch["vec"])):
                own = int(cells[i, 0])
                hb, qb = homes_of.get(own, 1), queries_of.get(own, 1)
                rows += [(own, int(code[i] % hb), q, 0, [int(lists[i, 0])], rep, vec) for q in range(qb)]
                for cell in dict.fromkeys(cells[i].tolist()):
                    hb, qb = homes_of.get(cell, 1), queries_of.get(cell, 1)
                    asked = lists[i][cells[i] == cell].tolist()
                    rows += [(cell, h, int(code[i] % qb), 1, asked, rep, vec) for h in range(hb)]
            yield pd.DataFrame(rows, columns=["cell", "hb", "qb", "role", "lists", "rep", "vec"])

    return deal


def _count_cells(index, dims: int, probes: int):
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Index = index.value
        for batch in batches:
            if len(batch):
                cells = held.cell[held.probes(_matrix(batch["vec"], dims), probes)]
                homes = np.bincount(cells[:, 0], minlength=held.cell.max() + 1)
                asked = np.zeros_like(homes)
                for row in cells:
                    asked[np.unique(row)] += 1
                yield pd.DataFrame({"cell": np.arange(len(homes)), "homes": homes, "queries": asked})

    return count


def _ranks(index, asked: np.ndarray, names: list[str], dims: int, keep: int, farthest: float):
    """The ``keep`` nearest of each asked vector among a partition's, exactly, each with the place of its list among those the asked one would probe."""

    def ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Index = index.value
        order = held.probes(asked, len(held.centroids))
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(order.shape[1])[None, :], 1)
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors, own = _matrix(batch.column("vec").to_pylist(), dims), np.asarray(batch.column("rep").to_pylist(), object)
            near = 2 - 2 * asked @ vectors.T
            near[np.asarray(names, object)[:, None] == own[None, :]] = np.inf
            n = min(keep, near.shape[1])
            top = np.argpartition(near, n - 1, axis=1)[:, :n]
            far = np.take_along_axis(near, top, 1)
            q, j = np.nonzero(far <= farthest)
            lists = held.probes(vectors[top[q, j]], 1)[:, 0] if len(q) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(far[q, j].astype(np.float64)), pa.array(place[q, lists].astype(np.int32))], ["q", "far", "place"])

    return ranks


def measured_probes(classes: DataFrame, index, total: int, dims: int, k: int, farthest: float, recall: float) -> int:
    """How many lists hold ``recall`` of the true neighbours of ``MEASURED`` vectors, found by comparing these with all."""
    share = F.pmod(F.xxhash64(F.lit(3), "rep"), F.lit(1_000_000)) < F.lit(max(1, int(1_000_000 * min(1.0, 1.5 * MEASURED / max(1, total)))))
    asked = classes.where(share).select("rep", "vec").limit(MEASURED).toPandas()
    if not len(asked):
        return PROBES
    found = classes.select("rep", "vec").mapInArrow(_ranks(index, _matrix(asked["vec"], dims), asked["rep"].tolist(), dims, k, farthest), "q int, far double, place int")
    near = found.withColumn("nth", F.row_number().over(Window.partitionBy("q").orderBy("far"))).where(F.col("nth") <= k)
    places = np.sort(np.array([r["place"] for r in near.select("place").collect()]))
    return PROBES if not len(places) else max(PROBES, int(places[min(len(places) - 1, int(np.ceil(recall * len(places))) - 1)]) + 1)


def scan_list(queries: np.ndarray, homes: np.ndarray, bound: np.ndarray, exact: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(query, home, squared distance)`` of the pairs that no test abandons.

    Distances grow block by block of columns. After each block the distance so
    far, scaled up to all columns, is tested against the query's bound; the
    first block is a product of matrices, later ones only touch pairs still alive.
    """
    dims = queries.shape[1]
    blocks = [(a, min(dims, a + COLUMN_BLOCK)) for a in range(0, dims, COLUMN_BLOCK)]

    def passes(partial: np.ndarray, seen: int, limit: np.ndarray) -> np.ndarray:
        if exact and seen < dims:
            # what is still to come adds to the distance: nothing nearer is dropped
            return partial <= limit * (1 + 1e-6) + 1e-6
        return partial * (dims / seen) <= limit * (1 + (EPSILON / np.sqrt(seen) if seen < dims else 1e-6)) ** 2

    a, b = blocks[0]
    q, h = queries[:, a:b], homes[:, a:b]
    first = (q * q).sum(1)[:, None] + (h * h).sum(1)[None, :] - 2 * (q @ h.T)
    i, j = np.nonzero(passes(first, b, bound[:, None]))
    partial = first[i, j]
    for a, b in blocks[1:]:
        diff = queries[i, a:b] - homes[j, a:b]
        partial = partial + np.einsum("ij,ij->i", diff, diff)
        alive = passes(partial, b, bound[i])
        i, j, partial = i[alive], j[alive], partial[alive]
    return i, j, partial


def _scan_cell(dims: int, keep: int, farthest: float, exact: bool = False):
    def scan(part: pd.DataFrame) -> pd.DataFrame:
        is_query = part["role"].to_numpy() == 1
        asks, homes = part[is_query], part[~is_query]
        empty = pd.DataFrame({"rep": pd.Series(dtype=object), "other": pd.Series(dtype=object), "similarity": pd.Series(dtype=float)})
        if not len(asks) or not len(homes):
            return empty
        q, h = _matrix(asks["vec"], dims), _matrix(homes["vec"], dims)
        q_names, h_names = asks["rep"].to_numpy(object), homes["rep"].to_numpy(object)
        order = np.argsort(h_names, kind="stable")
        h, h_names = h[order], h_names[order]
        h_list = np.array([x[0] for x in homes["lists"]])[order]
        names = {name: i for i, name in enumerate(h_names)}
        own = np.array([names.get(x, -1) for x in q_names])
        best = np.full((len(q), keep), np.inf, np.float32)
        who = np.full((len(q), keep), -1, np.int64)
        depth = np.array([len(x) for x in asks["lists"]])
        flat_q, flat_l = np.repeat(np.arange(len(q)), depth), np.concatenate([np.asarray(x) for x in asks["lists"]])
        rank = np.arange(len(flat_l)) - np.repeat(np.cumsum(depth) - depth, depth)
        for turn in range(int(depth.max())):  # all queries scan their nearest list first, so that bounds are tight early
            at = rank == turn
            for name in np.unique(flat_l[at]):
                there = np.flatnonzero(h_list == name)
                if not len(there):
                    continue
                asking = flat_q[at & (flat_l == name)]
                step = max(1, _CELLS_AT_ONCE // len(there))
                for start in range(0, len(asking), step):
                    some = asking[start : start + step]
                    i, j, dist = scan_list(q[some], h[there], np.minimum(best[some, -1], farthest), exact)
                    other = own[some][i] != there[j]
                    i, j, dist = i[other], there[j[other]], dist[other]
                    rows = np.concatenate([i, np.repeat(np.arange(len(some)), keep)])
                    found = np.concatenate([j, who[some].ravel()])
                    far = np.concatenate([dist, best[some].ravel()])
                    place = np.lexsort((found, far, rows))
                    rows, found, far = rows[place], found[place], far[place]
                    nth = np.arange(len(rows)) - np.searchsorted(rows, rows)
                    fits = nth < keep
                    who[some[rows[fits]], nth[fits]], best[some[rows[fits]], nth[fits]] = found[fits], far[fits]
        i, n = np.nonzero((who >= 0) & (best <= farthest * (1 + 1e-6)))
        if not len(i):
            return empty
        a, b = q[i].astype(np.float64), h[who[i, n]].astype(np.float64)
        cosine = np.einsum("ij,ij->i", a, b) / np.sqrt(np.einsum("ij,ij->i", a, a) * np.einsum("ij,ij->i", b, b))
        return pd.DataFrame({"rep": q_names[i], "other": h_names[who[i, n]], "similarity": cosine})

    return scan


def nearest_neighbours(df: DataFrame, id_column: str, vector_column: str, k: int = 5, least: float | None = None, dims: int = 64, probes: int | None = None, lists: int | None = None, exact: bool = False) -> DataFrame:
    """``(id, neighbour, similarity)``: up to ``k`` other rows of highest cosine similarity, ties by id ascending.

    A vector takes part if it has ``dims`` elements, all finite and not all zero;
    rows with a null id don't. ``least`` is the lowest similarity that counts.
    Equal vectors are one class in the index: the class is searched once, and
    each of its rows then gets its own neighbours, its twins among them. An empty
    table, or a single vector, gives no rows; other columns aren't read.

    Centroids are fitted on at most ``SAMPLE`` vectors; every vector is indexed,
    in the list of its nearest centroid, and searched for in its ``probes``
    nearest lists. How many that are is measured, unless given: ``MEASURED`` vectors are
    compared with all, and the lists probed must hold ``RECALL`` of their neighbours, so
    the accuracy stays where it is when there are more lists. Within a list, candidates are dropped early by tests on
    partial distances (see ``scan_list``). The result is approximate: a neighbour
    in a list that isn't probed, or dropped by a test, is missed. With ``exact`` all lists
    are probed and only candidates that are certainly farther are dropped. Cells with many
    vectors or queries are split into blocks, so that a task's share is bounded.
    """
    spark = df.sparkSession
    keep_twins = k + 1
    slim = df.select(F.col(id_column).cast("string").alias("id"), F.col(vector_column).cast("array<float>").alias("embedding")).where(F.col("id").isNotNull() & (F.size("embedding") == dims))
    slim = slim.withColumns({"h1": F.xxhash64("embedding"), "h2": F.xxhash64(F.lit(5), "embedding")})
    vectors = materialize(slim.mapInArrow(_prepare(dims), "id string, h1 long, h2 long, vec binary"), "knn-vectors")
    classes = materialize(vectors.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.min_by("vec", "id").alias("vec"), F.count(F.lit(1)).alias("n")), "knn-classes")
    total = classes.count()
    lists = lists or int(min(MAX_LISTS, max(1, 2 ** round(np.log2(max(1, 2 * total**0.5))))))
    bound = min(SAMPLE, SAMPLE_PER_LIST * lists)
    share = F.pmod(F.xxhash64("rep"), F.lit(1_000_000)) < F.lit(max(1, int(1_000_000 * min(1.0, 1.2 * bound / max(1, total)))))
    sample = classes.where(share).select("vec").limit(bound).toPandas()["vec"]
    if not len(sample):
        return spark.createDataFrame([], "id string, neighbour string, similarity double")
    index = spark.sparkContext.broadcast(Index(_matrix(sample, dims), lists))

    farthest = 4.0 if least is None else 2 - 2 * least
    probes = lists if exact else probes or min(lists, measured_probes(classes, index, total, dims, k, farthest * (1 + 1e-6), RECALL))
    reps = classes.select("rep", "vec")
    loads = reps.mapInPandas(_count_cells(index, dims, probes), "cell long, homes long, queries long").groupBy("cell").agg(F.sum("homes").alias("homes"), F.sum("queries").alias("queries")).collect()
    homes_of = {r["cell"]: -(-r["homes"] // BLOCK_HOMES) for r in loads if r["homes"] > BLOCK_HOMES}
    queries_of = {r["cell"]: -(-r["queries"] // BLOCK_QUERIES) for r in loads if r["queries"] > BLOCK_QUERIES}
    dealt = reps.mapInPandas(_deal(index, dims, probes, homes_of, queries_of), "cell long, hb int, qb int, role int, lists array<int>, rep string, vec binary")
    near = dealt.groupBy("cell", "hb", "qb").applyInPandas(_scan_cell(dims, k + 2, farthest, exact), "rep string, other string, similarity double")
    if least is not None:
        near = near.where(F.col("similarity") >= least)
    best = Window.partitionBy("rep").orderBy(F.desc("similarity"), "other")
    near = materialize(near.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k + 2).drop("nth"), "knn-near")

    many = classes.where(F.col("n") > 1).select("h1", "h2", "rep")
    twins = materialize(skewed_lookup(vectors.select("id", "h1", "h2"), many, ["h1", "h2"]).select("id", "rep"), "knn-twins")
    by_salt = Window.partitionBy("rep", F.pmod(F.xxhash64("id"), F.lit(64))).orderBy("id")
    by_rep = Window.partitionBy("rep").orderBy("id")
    first = twins.withColumn("nth", F.row_number().over(by_salt)).where(F.col("nth") <= keep_twins).withColumn("nth", F.row_number().over(by_rep)).where(F.col("nth") <= keep_twins).select(F.col("rep").alias("other"), F.col("id").alias("twin"))
    # neighbours of a class: the first twins of each class near it, and of itself
    own = first.select(F.col("other").alias("rep"), F.col("twin").alias("neighbour"), F.lit(1.0).alias("similarity"))
    spread = near.join(first, "other", "left").select("rep", F.coalesce("twin", "other").alias("neighbour"), "similarity").unionByName(own)
    order = Window.partitionBy("rep").orderBy(F.desc("similarity"), "neighbour")
    listed = spread.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= keep_twins).groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("nth", "neighbour", "similarity"))).alias("near"))
    single = listed.join(many.select("rep"), "rep", "left_anti").select(F.col("rep").alias("id"), "near")
    shared = skewed_lookup(twins, listed.join(many.select("rep"), "rep", "left_semi"), ["rep"]).select("id", "near")
    mine = F.slice(F.filter("near", lambda x: x["neighbour"] != F.col("id")), 1, k)
    return single.unionByName(shared).select("id", F.explode(mine).alias("x")).select("id", "x.neighbour", "x.similarity")
