from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillgraph.llm import packing as P

LENGTHS = (8, 16, 32)


def plain(sizes):
    """The same rule by looking at every bin and every piece that is left."""
    bins, where, order = [], {}, sorted(range(len(sizes)), key=lambda i: -sizes[i])
    for at, i in enumerate(order):
        fits = [(c - u, n) for n, (c, u) in enumerate(bins) if c - u >= sizes[i]]
        if fits:
            n = min(fits)[1]
        else:
            price = {}
            for x in LENGTHS:
                if x >= sizes[i]:
                    held = sizes[i]
                    for j in order[at + 1 :]:
                        held += sizes[j] if held + sizes[j] <= x else 0
                    price[x] = P.default_cost(x) / held
            n = len(bins)
            bins.append([min(price, key=lambda x: (price[x], x)), 0])
        where[i] = (n, bins[n][1])
        bins[n][1] += sizes[i]
    return [where[i] for i in range(len(sizes))], [min(x for x in LENGTHS if x >= u) for _, u in bins]


@given(st.lists(st.integers(1, 32), max_size=60))
@settings(max_examples=80, deadline=None)
def test_best_fit_against_plain_search(sizes):
    assert P.best_fit(sizes, LENGTHS) == plain(sizes)


def test_every_token_once_and_bins_hold(docs):
    rows = [(i, "w " * (i * 37 % 90)) for i in range(200)] + [(500, "w " * 10_000), (None, "a b"), (7, "x"), (7, "x"), (501, None), (502, " ")]
    got = P.pack(docs(rows).withColumn("bin", F.lit("clash")).withColumn("n", F.lit(1)), lengths=LENGTHS, pack_docs=50).collect()
    tokens = sum(len((r[1] or "").split()) for r in rows)
    assert sum(r.n_tokens for r in got) == tokens
    bins = {}
    for r in got:
        bins.setdefault((r.pack, r.bin), []).append(r)
    for rs in bins.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.at_token):
            assert r.at_token == at
            at += r.n_tokens
        assert rs[0].used == at <= rs[0].capacity and rs[0].capacity == min(x for x in LENGTHS if x >= at)
    long = sorted((r.piece, r.first_token, r.n_tokens) for r in got if r.doc_id == 500)
    assert len(long) == 313 and all(p * 32 == f for p, f, _ in long)
    assert len([r for r in got if r.doc_id == 7]) == 5 and len([r for r in got if r.doc_id is None]) == 1
    assert P.pack(docs([])).count() == 0


def test_room_is_well_used(spark):
    got = P.pack(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    used, room = got.select("pack", "bin", "capacity", "used").distinct().agg(F.sum("used"), F.sum("capacity")).first()
    assert used > 0.95 * room


def total_cost(sizes, lengths):
    return sum(map(P.default_cost, P.best_fit(sizes, lengths)[1]))


def test_lengths_compete():
    """Of one length, the longest is needed; several permitted lengths are all used and cost less than any other set."""
    import random

    rng = random.Random(3)
    sizes = [min(4096, int(rng.lognormvariate(6, 1.1)) + 1) for _ in range(3000)]
    placed, final = P.best_fit(sizes)
    counts = {x: final.count(x) for x in P.LENGTHS}
    assert sum(n >= 0.02 * len(final) for n in counts.values()) >= 3
    assert total_cost(sizes, P.LENGTHS) < 0.9 * total_cost(sizes, (4096,))
    # downsizing acts: a bin that the rest of the pieces can't fill becomes shorter
    assert P.best_fit([600, 600, 500], (1024, 4096), lambda x: x**0.5)[1] == [4096] and P.best_fit([300], (512, 4096), lambda x: float(x))[1] == [512]
    assert P.best_fit([1500, 10], (2048, 4096), lambda x: 1.0 if x == 4096 else 3.0)[1] == [4096]


def test_plan_is_the_same_for_every_layout(docs):
    rows = [(i, "w " * (i * 37 % 90)) for i in range(150)] + [(7, "x y"), (7, "x y"), (None, "a b")]
    want = sorted(map(str, P.pack(docs(rows).coalesce(1), lengths=LENGTHS, pack_docs=40).collect()))
    assert sorted(map(str, P.pack(docs(rows[::-1]).repartition(5), lengths=LENGTHS, pack_docs=40).collect())) == want


def test_tokens_come_back(docs):
    rows = [(i, " ".join(f"d{i}w{j}" for j in range(i * 13 % 70))) for i in range(60)]
    plan = P.pack(docs(rows), lengths=LENGTHS)
    got = P.sequences(docs(rows), plan).collect()
    assert all(len(r.text.split()) == r.used for r in got)
    assert sorted(w for r in got for w in r.text.split()) == sorted(w for _, t in rows for w in t.split())
