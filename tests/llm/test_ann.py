import numpy as np
from pyspark.sql import functions as F

from quillgraph.llm import ann as A

VEC = "vec_id long, embedding array<float>, label int"


def brute(ids, X, q, k):
    d = np.sqrt(((X - X[q]) ** 2).sum(1))
    return [int(ids[i]) for i in np.lexsort((ids, d)) if i != q][:k]


def test_cells_come_in_order():
    rng = np.random.default_rng(0)
    books = (rng.normal(size=(6, 2)), rng.normal(size=(5, 2)))
    sizes = rng.integers(0, 3, 30)
    for _ in range(20):
        q = rng.normal(size=4)
        got = A.visit(q, books, sizes, 10**9)
        cost = A.squared(q[None, :2], books[0])[0][:, None] + A.squared(q[None, 2:], books[1])[0][None, :]
        assert sorted(got) == np.flatnonzero(sizes).tolist()
        assert (np.diff(cost.reshape(-1)[got]) >= -1e-12).all()


def test_everything_scanned_is_exact(spark):
    rng = np.random.default_rng(1)
    X = rng.normal(size=(300, 7)).astype(np.float32).astype(np.float64)
    X[5] = X[6] = X[7] = X[100]
    rows = spark.createDataFrame([(int(i), [float(x) for x in v], 0) for i, v in enumerate(X)], VEC)
    got = {}
    for r in A.search(rows, F.col("id") % 100 == 0, k=10, share=1.0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    ids = np.arange(300)
    assert set(got) == {0, 100, 200}
    for q, found in got.items():
        found.sort()
        assert [f[1] for f in found] == brute(ids, X, q, 10) and [f[0] for f in found] == list(range(1, 11))
        assert all(abs(f[2] - np.sqrt(((X[q] - X[f[1]]) ** 2).sum())) < 1e-12 for f in found)


def test_recall(spark):
    from quillgraph.llm.entry import op5_ann

    d = "/root/testdata/sf0.1"
    pdf = spark.read.parquet(f"{d}/embeddings.parquet").orderBy("vec_id").toPandas()
    ids, X = pdf.vec_id.to_numpy(), np.array(pdf.embedding.tolist(), np.float64)
    got = {}
    for r in op5_ann(spark, d).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    queries = np.flatnonzero(ids % 100 == 0)
    hits = sum(len(got[int(ids[q])] & set(brute(ids, X, q, 10))) for q in queries)
    assert all(len(x) == 10 for x in got.values()) and hits >= 0.9 * 10 * len(queries)


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    good = [(0, [1.0, 0.0, 0.0]), (1, [1.0, 0.0, 0.5]), (2, [1.0, 0.0, 0.0]), (3, [-0.0, 2.0, 0.0]), (3, [0.0, 2.0, 0.0])]
    bad = [(100, None), (4, [0.0, 0.0, 0.0]), (200, [1.0, None, 0.0]), (5, [nan, 1.0, 1.0]), (6, [inf, 1.0, 1.0]), (7, []), (None, [1.0, 1.0, 1.0]), (8, [1.0])]
    rows = spark.createDataFrame([(i, v, 1) for i, v in good + bad], VEC).withColumn("score", F.lit("x")).withColumn("v", F.lit(1)).withColumn("q", F.lit(2))
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in A.search(rows, F.col("id") % 100 == 0, k=10).collect())
    assert got == [(0, 1, 2, 0.0), (0, 2, 1, 0.5), (0, 3, 3, 5**0.5), (0, 4, 3, 5**0.5)]  # the rows of id 3 are candidates each
    assert A.search(rows.limit(0), F.col("id") % 100 == 0).count() == 0
    assert A.search(rows.where("vec_id = 0"), F.lit(True)).count() == 0


def test_one_vector_with_very_many_rows(spark):
    rows = spark.range(3000).select(F.col("id").alias("vec_id"), F.when(F.col("id") < 1500, F.array(F.lit(1.0), F.lit(2.0))).otherwise(F.array(F.rand(1), F.rand(2))).cast("array<float>").alias("embedding"))
    got = A.search(rows, F.col("id") % 100 == 0, k=10, share=1.0).collect()
    mine = sorted((r["rank"], r.vec_id) for r in got if r.query_id == 700)
    assert len(got) == 300 and [m[1] for m in mine] == list(range(10)) and all(r.score == 0 for r in got if r.query_id < 1500)


def test_repeated_ids_and_rows_against_brute_force(spark):
    rng = np.random.default_rng(4)
    X = rng.integers(0, 4, size=(160, 3)).astype(np.float64) + 1
    ids = rng.integers(0, 40, 160)
    ids[:4] = 0
    X[1] = X[0]
    rows = spark.createDataFrame([(int(i), [float(x) for x in v], 0) for i, v in zip(ids, X)], VEC)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in A.search(rows, F.col("id") % 4 == 0, k=5, share=1.0).collect())
    want = []
    for q in np.flatnonzero(ids % 4 == 0):
        d = np.sqrt(((X - X[q]) ** 2).sum(1))
        near = [i for i in np.lexsort((ids, d)) if i != q][:5]
        want += [(int(ids[q]), n + 1, int(ids[i]), float(d[i])) for n, i in enumerate(near)]
    assert len(got) == len(want) and [g[:3] for g in got] == [w[:3] for w in sorted(want)] and np.allclose([g[3] for g in got], [w[3] for w in sorted(want)])


def test_share_and_recall_of_clustered_vectors(spark):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(150, 16)) * 4
    X = (centres[rng.integers(0, 150, 12_000)] + rng.normal(size=(12_000, 16)) * 0.5).astype(np.float32).astype(np.float64)
    books = (A.kmeans(X[:, :8], 44), A.kmeans(X[:, 8:], 44))
    assert A.share_for(X[:4000], books, 10) < 0.1
    rows = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(X)], VEC)
    got = {}
    for r in A.search(rows, F.col("id") % 100 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = sum(len(got[q] & set(brute(np.arange(len(X)), X, q, 10))) for q in range(0, len(X), 100))
    assert hits >= 0.9 * 1200
