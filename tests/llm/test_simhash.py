import random

import numpy as np
import pyarrow as pa
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillgraph.llm import simhash as S


def plain_fingerprint(text, size=3):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_classes(prints, budget):
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in prints:
        for j in prints:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= budget:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in prints}


@given(st.text(alphabet="aBé \n", max_size=60))
@settings(max_examples=60, deadline=None)
def test_fingerprint(text):
    assert S.fingerprint(text) == plain_fingerprint(text)


def test_same_hash_as_spark(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0] & (1 << 64) - 1 == xxhash.xxh64_intdigest(b"a b c", 42)


@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=40), st.integers(0, 4), st.randoms())
@settings(max_examples=40, deadline=None)
def test_trie_join_finds_all_pairs(seeds, budget, rnd):
    values = set(seeds)
    for v in seeds:
        for _ in range(3):
            values.add(v ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)))
    x = np.array(sorted(values), np.uint64)
    got = {(int(i), int(j)) for a, b in S.near_pairs(x, x, budget) for i, j in zip(a, b)}
    assert got == {(i, j) for i in range(len(x)) for j in range(len(x)) if (int(x[i]) ^ int(x[j])).bit_count() <= budget}


def test_dense_group_is_linked_without_all_its_pairs():
    rng = np.random.default_rng(9)
    base = int(rng.integers(0, 1 << 63))
    x = np.unique(np.array([base ^ (1 << int(i)) ^ (1 << int(j)) for i, j in rng.integers(0, 64, (3000, 2))] + [int(v) for v in rng.integers(0, 1 << 63, 500)], np.uint64))
    forest, pairs = S.Forest(len(x)), 0
    for i, j in S.near_pairs(x, x, 2, lambda: (forest.up, forest.up)):
        forest.union(i, j)
        pairs += len(i)
    every = [(int(i), int(j)) for a, b in S.near_pairs(x, x, 2) for i, j in zip(a, b)]
    want = S.Forest(len(x))
    want.union(np.array([e[0] for e in every]), np.array([e[1] for e in every]))
    assert forest.up.tolist() == want.up.tolist() and pairs < len(every)


def test_near_numbers_share_a_trie():
    rng = random.Random(4)
    for bits, budget in ((64, 2), (64, 4), (26, 2), (41, 3)):
        split, turns = S.tries(10**6, bits, budget, 1000)
        assert split and len(turns) == budget + 1 and S.tries(900, bits, budget, 1000) == (0, [0])
        for _ in range(200):
            a = rng.getrandbits(bits)
            b = a
            for _ in range(budget):
                b ^= 1 << rng.randrange(bits)
            both = np.array([a, b], np.uint64)
            assert any((v := S.turned(both, bits, by) >> np.uint64(bits - split))[0] == v[1] for by in turns)
            assert all((S.turned(S.turned(both, bits, by), bits, (bits - by) % bits) == both).all() for by in turns)


def test_classes_against_brute_force(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in rows.collect()}
    prints = {i: plain_fingerprint(t) for i, t in texts.items()}
    want = plain_classes(prints, 2)
    got = {r.id: r for r in S.near_duplicates(rows).collect()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert {i: r.fp & (1 << 64) - 1 for i, r in got.items()} == prints


def test_nodes_smaller_than_the_data(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    x = {int(b) ^ (1 << int(i)) ^ (1 << int(j)) for b in base for i, j in rng.integers(0, 63, (8, 2))}
    df = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in x], "fp long")
    edges = S.links(df, 2, node_size=10)
    classes = {r.node & (1 << 64) - 1: r.root for r in S.components(edges).collect()}
    want = plain_classes({v: v for v in x}, 2)
    root = lambda v: classes.get(v, v - (1 << 64) if v >> 63 else v)
    for a in x:
        for b in x:
            assert (root(a) == root(b)) == (want[a] == want[b])


def test_edge_cases(docs):
    long = "word " * 200_000
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "A  B"), (None, "a b"), (6, long), (7, long), (7, long)]
    got = S.near_duplicates(docs(rows).withColumn("fp", F.lit("clash")).withColumn("component_id", F.lit(0))).collect()
    assert len(got) == len(rows)
    by = {r.id: r.component_id for r in got}
    assert by[1] == by[2] == by[3] == 1 and by[4] == by[5] == by[None] == 4 and by[7] == 6
    assert S.near_duplicates(docs([])).count() == 0
    kept = S.keep_one(docs(rows).withColumn("least", F.lit(1)))
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 4, 6] and "least" in kept.columns


def shingle_set(text, size=5):
    words = S.ascii_lower_words(text)
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def near_copies(rng, n):
    """Texts of which many are changed copies of others, of all similarities."""
    texts = []
    for _ in range(n):
        if texts and rng.random() < 0.6:
            words = rng.choice(texts).split()
            for _ in range(rng.choice([0, 1, 1, 2, 3, 5, 9])):
                words[rng.randrange(len(words))] = f"y{rng.randrange(10**6)}"
            texts.append(" ".join(words))
        else:
            texts.append(" ".join(f"x{rng.randrange(10**6)}" for _ in range(rng.randint(40, 300))))
    return texts


def test_sketch_tells_similarity():
    rng = random.Random(5)
    texts = near_copies(rng, 150)
    wide = S.sketches(pa.array(texts), 5)
    sets = [shingle_set(t) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            alike, differ = len(sets[i] & sets[j]) / len(sets[i] | sets[j]), int(np.bitwise_count(wide[i] ^ wide[j]).sum())
            if alike >= 0.5:  # within five standard deviations of a binomial variable
                p = np.arccos(2 * alike / (1 + alike)) / np.pi
                assert abs(differ - 64 * S.WIDE * p) <= 5 * np.sqrt(64 * S.WIDE * p * (1 - p)) + 12
    assert (S.sketches(pa.array([None, "", " ", "a b", "A  B", "a b c"]), 5)[:3] == 0).all()
    short = S.sketches(pa.array(["a b", "A  B", "b a"]), 5)
    assert (short[0] == short[1]).all() and np.bitwise_count(short[0] ^ short[2]).sum() > 120
    assert (S.sketches(pa.array(["w " * 10 + "a b c d e f"]), 5) == S.sketches(pa.array(["w " * 500 + "a b c d e f"]), 5)).all()  # shingles are a set


def test_pieces_are_the_sketch_bit_by_bit():
    rng = np.random.default_rng(2)
    wide = rng.integers(0, 1 << 63, (20, S.WIDE), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    for bits in (24, 37, 63):
        whole = ["".join(f"{int(w):064b}" for w in row) for row in wide]
        for t in range(64 * S.WIDE // bits):
            assert [f"{int(v):0{bits}b}" for v in S.piece(wide, t * bits, bits)] == [w[t * bits : (t + 1) * bits] for w in whole]


def similar_classes(texts, bound):
    sets = [shingle_set(t) for t in texts]
    up = list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= bound * max(1, len(sets[i] | sets[j])):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return [root(i) for i in range(len(texts))]


def test_similar_documents_against_all_pairs(docs, monkeypatch):
    """Whoever is joined at a similarity of 0.86 or more is, and nobody is who isn't joined at 0.74."""
    texts = near_copies(random.Random(17), 400)
    sure, possible = similar_classes(texts, 0.86), similar_classes(texts, 0.74)
    for size in (1 << 18, 60):  # one trie for a piece, and many
        monkeypatch.setattr(S, "TRIE_SIZE", size)
        got = {r.id: r.component_id for r in S.similar_documents(docs(list(enumerate(texts)))).collect()}
        assert len(got) == len(texts) and sum(got[i] != got[sure[i]] for i in got) <= 0.005 * len(texts)
        assert all(possible[i] == possible[got[i]] for i in got)
    assert len(set(sure)) < 0.8 * len(texts)


def test_one_of_each_group_stays(docs):
    rng = random.Random(23)
    base = [f"x{rng.randrange(10**6)}" for _ in range(200)]
    rows = [(100 + i, " ".join(base[:i] + ["changed"] + base[i + 1 :])) for i in range(200)] + [(i, " ".join(base)) for i in range(50, 80)] + [(7, " ".join(f"z{rng.randrange(10**6)}" for _ in range(100))), (None, " ".join(base)), (8, None), (9, "")]
    wide = docs(rows).withColumn("stays", F.lit(1)).withColumn("__stays", F.lit(2)).withColumn("n", F.lit(3)).withColumn("id", F.lit(4)).repartition(5)
    kept = S.keep_one(wide)
    assert kept.columns == wide.columns
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n) for r in kept.collect()) == [(False, 7, 3), (False, 8, 3), (False, 50, 3), (True, 0, 3)]


def test_links_between_wide_fingerprints_are_whole_at_every_size(spark, monkeypatch):
    """Pairs at the bound and just beyond it, by themselves and among many others, in one trie, several, and blocks of them."""
    rng = np.random.default_rng(83)
    most = S.expected_bits(0.8)

    def changed(row, n):
        bits = np.unpackbits(row.view(np.uint8))
        bits[rng.choice(len(bits), n, replace=False)] ^= 1
        return np.packbits(bits).view(np.uint64)

    pairs = [(x, changed(x, most + k % 2)) for k, x in enumerate(rng.integers(0, 1 << 63, (160, S.WIDE), dtype=np.uint64))]
    rows = [(2 * k + j, x.tobytes()) for k, pair in enumerate(pairs) for j, x in enumerate(pair)]
    others = [(1000 + i, x.tobytes()) for i, x in enumerate(rng.integers(0, 1 << 63, (2000, S.WIDE), dtype=np.uint64))]
    want = {(2 * k, 2 * k + 1) for k in range(0, 160, 2)}
    for table, n, size in ((rows, 320, 1 << 18), (rows + others, 2320, 1 << 18), (rows, 1 << 30, 1 << 18), (rows, 320, 60), (rows, 320, 2)):
        monkeypatch.setattr(S, "TRIE_SIZE", size)
        if n == 1 << 30:
            monkeypatch.setattr(S, "TRIE_SIZE", 1 << 24)  # so many rows as are told, not as there are
        found = S.similar_links(spark.createDataFrame(table, "least long, wide binary"), n, most).collect()
        assert {(min(r.a, r.b), max(r.a, r.b)) for r in found} == want
