"""Approximate nearest neighbours with an inverted multi-index.

Either half of a vector has a codebook of its own; a vector's two nearest centroids name its cell, so K centroids a half
make K x K cells.  A query goes through pairs of centroids in order of summed squared distance, taken from a heap, until
the cells that it has come to hold the wanted share of all vectors.  The entries of those cells are reranked by their
exact distance in double precision.

Equal vectors are one entry, which is known by the vector alone and keeps the smallest ids that an answer can need; so are
equal queries.  A vector that a third of all rows share is one row of one cell.  Cells are split over as many tasks as
their entries need, queries go to the parts of the cells that they visit, and each part gives each query its nearest few,
so a result grows with the queries and not with the cells' sizes.

The codebooks are fitted on a bounded sample (``max_fit`` rows and FIT_COMPONENTS components at most, by a hash of the
vector); every row is indexed.  The same sample says which share of all vectors has to be reranked: the least one with
which some of its vectors find nearly all of their nearest in it.  The more rows there are, the nearer neighbours lie, so
a share that will do for the sample will do for all.

Defined results
* vectors that are null, empty, zero, of another length than most, or hold null, NaN or infinite components take no part
* every row is a candidate and every query row has an answer of its own, also where ids or whole rows are repeated; only
  the query's own row is no candidate
* fewer candidates than k: all of them; ties go to the smaller id; null ids take no part
* an empty table gives an empty result; only the id and vector columns are read
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.llm.common import written

#: Components that the codebooks are fitted on at most; long vectors are sampled more thinly.
FIT_COMPONENTS = 4_000_000
#: Bytes of float32 components that a part of the index holds at most.
PART_BYTES = 4 << 20
#: Centroids of a half at most; cells are their square.
MOST_CENTROIDS = 256
#: Vectors of the sample that are searched in it, and the part of their nearest that the share has to find there.
TRIED, WANTED = 200, 0.97


def usable(vec: Column, dim: int) -> Column:
    """Of the right length, all components finite, not zero."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vec.isNotNull() & (F.size(vec) == dim) & finite & F.exists(vec, lambda x: x != 0)


def kmeans(points: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Centroids of Lloyd's iteration from random points; an empty centroid moves to a random point."""
    rng = np.random.default_rng(seed)
    centroids = points[rng.choice(len(points), min(k, len(points)), replace=False)].astype(np.float64)
    for _ in range(rounds):
        near = nearest(points, centroids)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, points)
        sizes = np.bincount(near, minlength=len(centroids))
        centroids = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], points[rng.integers(0, len(points), len(centroids))])
    return centroids


def squared(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.maximum(0, (points**2).sum(1)[:, None] - 2 * points @ centroids.T + (centroids**2).sum(1))


def nearest(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.concatenate([squared(points[i : i + 8192], centroids).argmin(1) for i in range(0, len(points), 8192)]) if len(points) else np.empty(0, np.int64)


def cells_of(vectors: np.ndarray, books: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    half = books[0].shape[1]
    return nearest(vectors[:, :half], books[0]) * len(books[1]) + nearest(vectors[:, half:], books[1])


def visit(query: np.ndarray, books: tuple[np.ndarray, np.ndarray], sizes: np.ndarray, wanted: float) -> list[int]:
    """Cells with entries in order of summed centroid distance, until ``wanted`` entries are inside."""
    half = books[0].shape[1]
    a, b = squared(query[None, :half], books[0])[0], squared(query[None, half:], books[1])[0]
    oa, ob = a.argsort(kind="stable").tolist(), b.argsort(kind="stable").tolist()
    da, db = a[oa].tolist(), b[ob].tolist()
    k, out, held = len(ob), [], 0
    heap, pushed = [(da[0] + db[0], 0, 0)], [0] * len(oa)  # pushed[i]: pairs of row i that are or were in the heap
    pushed[0] = 1
    while heap and held < wanted:
        _, i, j = heapq.heappop(heap)
        cell = oa[i] * k + ob[j]
        if sizes[cell]:
            out.append(cell)
            held += int(sizes[cell])
        # a pair comes in once both pairs before it, in its row and in its column, are out
        if i + 1 < len(oa) and pushed[i + 1] == j and pushed[i] > j:
            heapq.heappush(heap, (da[i + 1] + db[j], i + 1, j))
            pushed[i + 1] = j + 1
        if j + 1 < k and pushed[i] == j + 1 and (i == 0 or pushed[i - 1] > j + 1):
            heapq.heappush(heap, (da[i] + db[j + 1], i, j + 1))
            pushed[i] = j + 2
    return out


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


PART_KIND = "part long, cells array<int>, e string, v array<double>, ids array<long>, cell int"
PART_NAMES = ["part", "cells", "e", "v", "ids", "cell"]


def named(vec: str) -> Column:
    """A name that only equal vectors share."""
    return F.sha1(F.array_join(F.col(vec).cast("array<string>"), ",").cast("binary"))


def share_for(points: np.ndarray, books: tuple[np.ndarray, np.ndarray], k: int) -> float:
    """The least share of ``points`` whose cells, in the order in which they are visited, hold WANTED of the ``k`` nearest."""
    n = len(points)
    if n <= 2 * k:
        return 1.0
    cell = cells_of(points, books)
    sizes = np.bincount(cell, minlength=len(books[0]) * len(books[1]))
    needed = []
    for q in np.linspace(0, n - 1, min(TRIED, n)).astype(int).tolist():
        far = ((points - points[q]) ** 2).sum(axis=1)
        far[q] = np.inf
        near = np.argpartition(far, k)[:k]
        order = visit(points[q], books, sizes, n)
        before = dict(zip(order, np.cumsum([0, *sizes[order]]).tolist()))
        needed += [(before[c] + 1) / n for c in cell[near].tolist()]  # a cell is entered while less than the share is held
    return float(np.quantile(needed, WANTED))


def search(rows: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 10, share: float | None = None, centroids: int | None = None, max_fit: int = 20_000) -> DataFrame:
    """(query_id, rank, id, score): the k nearest found for each row where ``is_query`` (over id and vector columns).

    ``share``: part of all distinct vectors that is reranked; by default the sample says which.  ``centroids``: per half; by
    default it grows with the square root of the rows, 16 to MOST_CENTROIDS.
    """
    spark = rows.sparkSession
    lengths = rows.select(F.size(vec_col).alias("n")).where("n > 0").groupBy("n").count().orderBy(F.desc("count"), "n").first()
    dim = lengths[0] if lengths else 2
    wide = dim + dim % 2  # an odd length gets a zero component for the index
    valid = rows.where(F.col(id_col).isNotNull() & usable(F.col(vec_col), dim))
    kept = valid.select(F.col(id_col).cast("long").alias("id"), F.transform(vec_col, lambda x: x.cast("double") + 0.0).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    # an answer needs k rows of one vector at most, and one more where the query itself is among them; the rank is
    # limited before the shuffle, so a vector of very many rows doesn't gather
    same = Window.partitionBy("v").orderBy("id")
    ids = kept.withColumn("n", F.row_number().over(same)).where(F.col("n") <= k + 1)
    entries = written(ids.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")).withColumn("e", F.xxhash64("v")), "ann-entries")
    queries = written(kept.where("q").select("id", "v"), "ann-queries")
    n = entries.count()
    per_half = centroids or int(min(MOST_CENTROIDS, max(16, round(n**0.5 / 2.5))))
    max_fit = min(max_fit, max(256, FIT_COMPONENTS // dim))
    sample = entries.where(F.pmod("e", F.lit(1 << 20)) < int(min(1.0, max_fit / max(1, n)) * (1 << 20)) + 1).orderBy("e", "v").limit(max_fit).select("v").toPandas()
    points = np.array(sample["v"].tolist(), np.float64).reshape(len(sample), dim) if len(sample) else np.zeros((1, dim))
    points = np.pad(points, ((0, 0), (0, wide - dim)))
    half = wide // 2
    books = (kmeans(points[:, :half], per_half), kmeans(points[:, half:], per_half))
    share = share_for(points, books, k) if share is None else share
    held = spark.sparkContext.broadcast(books)  # MOST_CENTROIDS a half at most

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = np.pad(_matrix(batch.column(1), dim), ((0, 0), (0, wide - dim)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells_of(v, held.value).astype(np.int32))], names=["e", "v", "ids", "cell"])

    indexed = written(entries.select("e", "v", "ids").mapInArrow(assign, "e long, v array<double>, ids array<long>, cell int"), "ann-index")
    sizes = np.zeros(len(books[0]) * len(books[1]), np.int64)
    for cell, count in indexed.groupBy("cell").count().collect():  # as many rows as cells at most
        sizes[cell] = count
    # neighbouring cells share a part; a large cell has several
    room = max(1, PART_BYTES // (4 * dim))
    first = np.concatenate(([0], np.cumsum(sizes)))
    parts = {int(c): (int(first[c] // room), int((first[c + 1] - 1) // room)) for c in np.flatnonzero(sizes)}
    facts = spark.sparkContext.broadcast((sizes, parts))  # bounded by the number of cells

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Entries with the part of their cell that a hash of the vector gives them."""
        _, parts = facts.value
        for batch in batches:
            cell, e = batch.column(3).to_numpy(), batch.column(0).to_numpy()
            lo, hi = np.array([parts[c][0] for c in cell.tolist()]), np.array([parts[c][1] for c in cell.tolist()])
            mixed = (e.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            part = lo + (mixed % (hi - lo + 1).astype(np.uint64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.nulls(len(e), pa.list_(pa.int32())), pa.nulls(len(e), pa.string()), *batch.columns[1:]], names=PART_NAMES)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Distinct query vectors with the parts of the cells that they visit."""
        sizes, parts = facts.value
        for batch in batches:
            v = _matrix(batch.column(1), dim)
            for start in range(0, len(v), 64):
                part, at, cells = [], [], []
                for i in range(start, min(start + 64, len(v))):
                    by: dict[int, list[int]] = {}
                    for c in visit(np.pad(v[i], (0, wide - dim)), held.value, sizes, max(share * n, 10 * (k + 1))):
                        for p in range(parts[c][0], parts[c][1] + 1):
                            by.setdefault(p, []).append(c)
                    part += by
                    cells += by.values()
                    at += [i] * len(by)
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(cells, pa.list_(pa.int32())), *(c.take(pa.array(at, pa.int64())) for c in batch.columns), pa.nulls(len(at), pa.list_(pa.int64())), pa.nulls(len(at), pa.int32())], names=PART_NAMES)

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A part's entries come first, then the queries that visit it, in blocks."""
        now, got = None, []

        def entries_of() -> tuple[np.ndarray, list, np.ndarray]:
            t = pa.Table.from_batches(got).combine_chunks()
            return np.concatenate([_matrix(b.column("v"), dim) for b in got]), t.column("ids").to_pylist(), t.column("cell").to_numpy()

        built = None
        for batch in batches:
            part = batch.column(0).to_numpy()
            asks = batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero((np.diff(part) != 0) | (np.diff(asks.astype(np.int8)) != 0)) + 1).tolist(), len(part)]
            for s, e in zip(cuts, cuts[1:]):
                if s == e:
                    continue
                if part[s] != now:
                    now, got, built = part[s], [], None
                if not asks[s]:
                    got.append(batch.slice(s, e - s))
                    continue
                if built is None and got:
                    built = entries_of()
                if built is None:
                    continue
                vectors, ids, cell = built
                block = batch.slice(s, e - s)
                out: tuple[list, list, list] = ([], [], [])
                for q, v, cells in zip(block.column("e").to_pylist(), _matrix(block.column("v"), dim), block.column("cells").to_pylist()):
                    at = np.flatnonzero(np.isin(cell, cells))
                    if not len(at):
                        continue
                    near = ((vectors[at] - v) ** 2).sum(1)
                    # every entry as near as the (k + 1)th may hold one of the nearest ids
                    best = np.flatnonzero(near <= np.partition(near, k)[k]) if len(near) > k + 1 else np.arange(len(near))
                    pairs = sorted((float(np.sqrt(near[i])), x) for i in best.tolist() for x in ids[at[i]])[: k + 1]
                    out[0].append(q)
                    out[1].append([p[0] for p in pairs])
                    out[2].append([p[1] for p in pairs])
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.list_(pa.float64())), pa.array(out[2], pa.list_(pa.int64()))], names=["e", "scores", "ids"])

    both = indexed.mapInArrow(spread, PART_KIND).unionByName(queries.groupBy("v").agg(F.lit(1)).select(named("v").alias("e"), "v").mapInArrow(probe, PART_KIND))
    met = both.repartition("part").sortWithinPartitions("part", F.col("cells").isNotNull()).mapInArrow(rerank, "e string, scores array<double>, ids array<long>")
    # the nearest few of each part, then of all; a query vector has as many rows as parts times k + 1 at most
    pairs = met.select("e", F.explode(F.arrays_zip("scores", "ids")).alias("p")).select("e", F.col("p.scores").alias("score"), F.col("p.ids").alias("id"))
    order = Window.partitionBy("e").orderBy("score", "id")
    found = pairs.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1).groupBy("e").agg(F.array_sort(F.collect_list(F.struct("score", "id"))).alias("found"))
    answered = queries.select(F.col("id").alias("query_id"), named("v").alias("e")).join(found, "e")
    # of the rows with the query's id, its own is the first at no distance
    own = F.array_position("found", F.struct(F.lit(0.0).alias("score"), F.col("query_id").alias("id"))).cast("int")
    others = F.slice(F.when(own > 0, F.filter("found", lambda x, i: i + 1 != own)).otherwise(F.col("found")), 1, k)
    return answered.select("query_id", F.posexplode(others).alias("at", "x")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.id").alias(id_col), F.col("x.score").alias("score"))
