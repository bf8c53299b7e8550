"""Graph operators against plain loops over a correspondence that is drawn at random."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import graph as G
from quillgraph.operators import retrieval as R

rng = random.Random(20)
PEOPLE = [f"writer{i}" for i in range(7)]
TOPICS = [f"topic{i}" for i in range(12)]
LETTERS = []
for n in range(45):
    sender, recipient = rng.sample(PEOPLE, 2)
    LETTERS.append((f"L{n:02d}", sender, recipient if n % 9 else None, (date(1871, 3, 1) + timedelta(rng.randrange(700))).isoformat(), rng.choice(["Hafen", "Mühle", None])))
MENTIONS = [(x[0], t) for x in LETTERS for t in rng.choices(TOPICS, k=rng.randint(0, 5))]  # some twice
LINKS = [(x[0], end, kind) for x in LETTERS for end, kind in ((x[1], "SENT_BY"), (x[2], "SENT_TO"), (x[4], "SENT_FROM")) if end] + [(a, b, "MENTIONS") for a, b in MENTIONS]


@pytest.fixture(scope="module")
def letters(spark):
    return spark.createDataFrame(LETTERS, "id string, sender string, recipient string, date string, place string")


@pytest.fixture(scope="module")
def mentions(spark):
    return spark.createDataFrame(MENTIONS, "letter_id string, entity_id string")


@pytest.fixture(scope="module")
def nodes(letters, spark):
    others = {kind: spark.createDataFrame([(x, f"the {x}") for x in names], "id string, label string") for kind, names in (("Person", PEOPLE), ("Topic", TOPICS), ("Place", ["Hafen"]))}
    return G.build_nodes(letters, others)


@pytest.fixture(scope="module")
def edges(letters, mentions):
    return G.build_edges(letters, mentions)


def test_edges_as_the_records_have_them(edges, nodes):
    assert sorted(map(tuple, edges.collect())) == sorted(LINKS)
    assert {r.type: r.n for r in G.counts(edges).collect()} == {k: sum(x[2] == k for x in LINKS) for k in ("SENT_BY", "SENT_TO", "SENT_FROM", "MENTIONS")}
    known = {x[0] for x in LETTERS} | {*PEOPLE, *TOPICS, "Hafen"}
    assert {tuple(r) for r in G.merged_edges(edges, nodes).collect()} == {x for x in LINKS if x[1] in known}
    assert G.merged_edges(edges.union(edges), nodes).count() == len({x for x in LINKS if x[1] in known})


def test_neighbors(edges, nodes):
    for key in ("L03", "topic2", "Mühle"):
        want = sorted([(b, k, "out") for a, b, k in LINKS if a == key] + [(a, k, "in") for a, b, k in LINKS if b == key])
        assert sorted((r.key, r.edge_type, r.direction) for r in G.neighbors(edges, nodes, key).collect()) == want


def test_shared_mentions(spark, mentions):
    of = {x[0]: {t for a, t in MENTIONS if a == x[0]} for x in LETTERS}
    for least in (1, 2, 3):
        want = {(a, b, len(of[a] & of[b])) for a in of for b in of if a != b and len(of[a] & of[b]) >= least}
        assert {tuple(r) for r in G.shared_mentions(mentions, least=least).collect()} == want
    seeds = spark.createDataFrame([("L05",), ("L11",), ("L11",)], "id string")
    assert {tuple(r) for r in G.shared_mentions(mentions, seeds, 1).collect()} == {(a, b, len(of[a] & of[b])) for a in ("L05", "L11") for b in of if a != b and of[a] & of[b]}


def near(days, of=None):
    out = set()
    for a, s, r, d, _ in LETTERS:
        for b, t, u, e, _ in LETTERS:
            apart = abs((date.fromisoformat(d) - date.fromisoformat(e)).days)
            if a != b and r and u and {s, r} == {t, u} and apart <= days and (of is None or a in of):
                out.add((a, b, apart))
    return out


def test_correspondence_context(spark, letters):
    for days in (1, 30, 90, 400):
        assert {tuple(r) for r in G.correspondence_context(letters, days=days).collect()} == near(days)
    seeds = spark.createDataFrame([("L01",), ("L10",)], "id string")
    assert {tuple(r) for r in G.correspondence_context(letters, seeds, 365).collect()} == near(365, {"L01", "L10"})


def test_context_in_runs(spark, letters, monkeypatch):
    monkeypatch.setattr(G, "RUN", 2)  # letters of a window that fill several runs
    twice = letters.unionByName(letters.where("id = 'L10'"))
    for days in (0, 7, 365):
        assert sorted(map(tuple, G.correspondence_context(letters, days=days).collect())) == sorted(near(days))
        once = [x for x in near(days) for _ in range(2 if "L10" in x[:2] else 1)]
        assert sorted(map(tuple, G.correspondence_context(twice, days=days).collect())) == sorted(once)


def test_context_reads_letters_once_and_is_small_in_a_file(spark, tmp_path):
    rng = random.Random(5)
    many = [(i, *rng.sample(["a", "b"], 2), (date(1871, 3, 1) + timedelta(rng.randrange(200))).isoformat()) for i in range(1000)]
    spark.createDataFrame(many, "id long, sender string, recipient string, date string").write.parquet(str(tmp_path / "letters"))
    found = G.correspondence_context(spark.read.parquet(str(tmp_path / "letters")))
    assert found._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 1
    found.write.parquet(str(tmp_path / "found"))
    day = [date.fromisoformat(x[3]).toordinal() for x in many]
    rows = sum(abs(d - e) <= 90 for d in day for e in day) - len(many)
    assert spark.read.parquet(str(tmp_path / "found")).distinct().count() == rows
    assert sum(x.stat().st_size for x in (tmp_path / "found").glob("*.parquet")) < rows


def test_dates_that_are_not_whole(letters):
    cut = letters.withColumn("date", F.when(F.col("id") == "L01", F.substring("date", 1, 7)).when(F.col("id") == "L10", F.substring("date", 1, 4)).otherwise(F.col("date")))
    assert {tuple(r) for r in G.correspondence_context(cut, days=365).collect()} == {x for x in near(365) if not {"L01", "L10"} & {x[0], x[1]}}
    first = letters.withColumn("date", F.when(F.col("id") == "L01", F.concat(F.substring("date", 1, 7), F.lit("-01"))).when(F.col("id") == "L10", F.concat(F.substring("date", 1, 4), F.lit("-01-01"))).otherwise(F.col("date")))
    assert {tuple(r) for r in G.correspondence_context(cut, days=365, partial_dates=True).collect()} == {tuple(r) for r in G.correspondence_context(first, days=365).collect()}


def plain_ego(pairs, key, depth):
    near_, frontier, seen = {key: 0}, [key], set()
    for d in range(depth):
        reached = []
        for k in frontier:
            for s, t, y in pairs:
                if k in (s, t):
                    seen.add((s, t, y))
                    o = t if k == s else s
                    if o not in near_:
                        near_[o] = d + 1
                        reached.append(o)
        frontier = reached
    return near_, seen


def test_ego_network(edges, nodes):
    for key in ("topic4", "writer1", "nowhere"):
        for depth in (1, 2, 3):
            depths, seen = plain_ego(LINKS, key, depth)
            assert {r.key: r.depth for r in G.ego_depths(edges, key, depth).collect()} == depths
            assert {tuple(r) for r in G.ego_edges(edges, key, depth).collect()} == seen
    known = {r.key for r in nodes.collect()}
    assert {r.key for r in G.ego_nodes(edges, nodes, "topic4", 2).collect()} == set(plain_ego(LINKS, "topic4", 2)[0]) & known


def test_an_ego_step_reads_the_edges_once(edges):
    plan = G.ego_depths(edges, "topic4", 3)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LocalRelation") + plan.count("LogicalRDD") <= 3 * 2 + 3  # letters and mentions for each step


def test_ego_of_random_graphs(spark):
    draw = random.Random(1)
    pairs = [(str(draw.randint(0, 25)), str(draw.randint(0, 25)), draw.choice("xy")) for _ in range(40)]
    edges = spark.createDataFrame(pairs, "source string, target string, type string")
    for depth in (1, 2, 3):
        depths, seen = plain_ego(pairs, "0", depth)
        assert {r.key: r.depth for r in G.ego_depths(edges, "0", depth).collect()} == depths
        assert {tuple(r) for r in G.ego_edges(edges, "0", depth).collect()} == seen


def test_capped_fill_against_the_loop(spark):
    draw = random.Random(6)
    seeds, events, want = [], [], {}
    for anchor in range(60):
        cap = 5
        own = draw.sample(range(12), draw.randint(0, 3))
        found = {i: [] for i in own}
        seeds += [(anchor, i, 0.5) for i in own]
        for n in range(draw.randint(0, 25)):
            i = draw.randint(0, 11)
            events.append((anchor, i, n, f"r{n}"))
            if i in found:
                found[i].append(f"r{n}")
            elif len(found) < cap:
                found[i] = [f"r{n}"]
        want[anchor] = found
    s = spark.createDataFrame(seeds, "anchor long, id long, score double")
    e = spark.createDataFrame(events, "anchor long, id long, seq long, reason string")
    got = {}
    for r in R.capped_fill(s, e, 5).collect():
        got.setdefault(r.anchor, {})[r.id] = r.reasons
    assert got == {a: f for a, f in want.items() if f}


def test_resolve_and_layout(nodes, edges):
    assert [(r.key, r["rank"]) for r in G.resolve(nodes, "topic7").collect()] == [("topic7", 0)]
    assert [(r.key, r["rank"]) for r in G.resolve(nodes, "The Topic7").collect()] == [("topic7", 1)]
    assert [(r.key, r["rank"]) for r in G.resolve(nodes, "he writer").collect()] == [("writer0", 2)] and G.resolve(nodes, "zzz").count() == 0
    ring = {r.key: (r.depth, r.x, r.y) for r in G.ring_layout(G.ego_nodes(edges, nodes, "topic4", 2), 3.0).collect()}
    assert ring["topic4"] == (0, 0.0, 0.0) and all(abs((x * x + y * y) ** 0.5 - 3 * d) < 1e-5 for d, x, y in ring.values())


def test_record_of_a_letter(letters, mentions):
    r = G.letter_record(letters, mentions, "L05", most=2).first()
    own = sorted({t for a, t in MENTIONS if a == "L05"})
    assert r.id == "L05" and r.mentions == own[:2] and r.n_mentions == len(own)
