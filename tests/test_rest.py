import random

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import matching, passages, register, retrieval
from quillgraph.plans import patterns, tools
from quillgraph.sources import sinks, texts
from quillgraph.sources.adapter import Corpus
from quillgraph.streaming import events

D = "/root/testdata/sf0.001"


def test_chunks(spark):
    rows = spark.createDataFrame([(1, "a  b c"), (2, " ".join(map(str, range(11)))), (3, ""), (4, None)], "letter_id int, text string")
    got = {(r.letter_id, r.chunk_index): r.text for r in passages.chunk_text(rows, 5, 2).collect()}
    assert got == {(1, 0): "a  b c", (2, 0): "0 1 2 3 4", (2, 1): "3 4 5 6 7", (2, 2): "6 7 8 9 10"}
    with pytest.raises(ValueError):
        passages.chunk_text(rows, 5, 5)


def test_splice_and_spans(spark):
    t = spark.createDataFrame([(1, "Anna in Ort."), (2, "none")], "letter_id int, text string")
    s = spark.createDataFrame([(1, 8, 11, "pl"), (1, 0, 4, "per")], "letter_id int, start int, end int, tag string")
    assert {r.letter_id: r.text for r in passages.splice(s, t).collect()} == {1: "<per>Anna</per> in <pl>Ort</pl>.", 2: "none"}
    assert {r.context for r in passages.with_context(s, t, 3).collect()} == {"[Anna] in", "in [Ort]."}


def test_fulltext(spark):
    d = spark.createDataFrame([(1, "Handschrift", "x"), (2, "y", "die Handschriften und Hanschrift"), (3, "z", "nichts")], "id int, title string, text string")
    got = [r.id for r in passages.fulltext_search(passages.inverted_index(d), "handschrift").collect()]
    assert got == [1, 2]


def test_stand_in_clusters(spark):
    got = passages.clusters_substitute(retrieval.letter_vectors(Corpus(spark, D).chunks), 4)
    assert got.select("cluster").distinct().count() <= 4 and got.columns == ["letter_id", "cluster", "x", "y"]


def test_incremental(spark):
    now = spark.createDataFrame([(1, "a"), (2, "b2"), (3, "c")], "letter_id int, sha256 string")
    known = spark.createDataFrame([(1, "a"), (2, "b"), (4, "d")], "letter_id int, sha256 string")
    fresh, good = retrieval.incremental(now, known)
    assert sorted(r.letter_id for r in fresh.collect()) == [2, 3] and [r.letter_id for r in good.collect()] == [1]


def test_matching(spark):
    spans = spark.createDataFrame([("Anna",), ("Bert",)], "text string")
    named = spark.createDataFrame([("Anna", "p1", 1), ("Anna", "p2", 2)], "text string, key string, position int")
    assert {r.text: r.key for r in matching.set_keys(spans, named).collect()} == {"Anna": "p2", "Bert": None}
    rows = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id int, sig string, other string")
    new = spark.createDataFrame([(2, "B")], "id int, sig string")
    assert [tuple(r) for r in matching.apply_updates(rows, new, "id", ["sig"]).orderBy("id").collect()] == [(1, "a", "x"), (2, "B", "y")]
    m = spark.createDataFrame([("m1", "Bergmann, Annette", "person"), ("m2", "Niemand", "person")], "mention string, text string, kind string")
    b = spark.createDataFrame([("p1", "Annette Bergmann", "person"), ("p2", "Anna Bergm", "person"), ("w1", "Annette Bergmann", "work")], "entity string, label string, kind string")
    got = {r.mention: (r.entity, r.method) for r in matching.fuzzy_link(m, b, accept=80).collect()}
    assert got == {"m1": ("p1", "fuzzy"), "m2": (None, "none")}


def test_cascade_against_a_plain_loop(spark):
    """All of few dates and repositories, so that a date has very many rows; nothing is paired by the date alone."""
    rng = random.Random(89)
    some = lambda *xs: rng.choice([*xs, None])
    kinds = ("1801-01-01", "1801-01-02", "1801-02"), ("Freiburg UB", "Freiburg", "F", "", "Basel"), ("Ulm", "ulm", "", "Meersburg", "Überlingen", "burg")
    reg = [(i, *(some(*k) for k in kinds)) for i in range(60)] + [(100, "1802-01-01", "Basel StA", "Ulm"), (101, "1803-01-01", "Basel", "Ulm"), (102, "1803-01-01", "Bern", "x")]
    got = [(i, some(*kinds[0]), some("Frei", "F", "", "Basel"), some("bei Ulm", "MEERSBURG", "überlingen", "")) for i in range(300)] + [(900, "1802-01-01", "Basel", None), (901, "1803-01-01", "B", "near x"), (902, "1803-01-01", "Ba", "no")]
    want = {}
    for i, date, rep, place in got:
        met = [r for r in reg if None not in (date, rep, r[1], r[2]) and r[1] == date and r[2].startswith(rep)]
        fit = met if len(met) == 1 else [r for r in met if None not in (place, r[3]) and r[3].lower() in place.lower()]
        want[i] = min((r[0] for r in fit), default=None)
    df = matching.match_cascaded(spark.createDataFrame(got, "text_id int, date string, repository string, place string"), spark.createDataFrame(reg, "id int, date string, repository string, place string"))
    assert {r.text_id: r.match for r in df.collect()} == want and df.columns == ["text_id", "date", "repository", "place", "match"]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "StartsWith" not in plan and "Window" not in plan


def test_linking_against_all_pairs(spark):
    """Edits anywhere in a name, common words, empty texts: best entries and their order are those of comparing everything."""
    import random

    from quillgraph.functions.similarity import token_set_ratio

    rng = random.Random(19)
    names = ["Kirchenmusikdirektor", "Schwartzenberger", "von Berg", "Anna von Berg", "Berg", "von der Tann", "Tann", "Uhland", "Ludwig Uhland", "Laura"] + ["".join(rng.choice("abcdeimnorst") for _ in range(rng.randint(3, 12))) + " von " + "".join(rng.choice("abcdeimnorst") for _ in range(rng.randint(3, 12))) for _ in range(60)]

    def changed(name):
        letters = list(name)
        for _ in range(rng.randint(0, 2)):
            i = rng.randrange(len(letters))
            letters[i : i + 1] = rng.choice([[], [rng.choice("xyz")], [letters[i], "x"]])
        return "".join(letters)

    said = ["Xirchenmusikdirektor", "Shwartzenberger", "", "von", *(changed(rng.choice(names)) for _ in range(60))]
    bank = [(f"e{i:03d}", name, "person" if i % 3 else "work") for i, name in enumerate(names)]
    mentions = [(i, text, "person" if i % 2 else "work") for i, text in enumerate(said)]
    one = spark.createDataFrame(mentions, "mention int, text string, kind string")
    two = spark.createDataFrame(bank, "entity string, label string, kind string")
    clean = {r.t: r.n for r in spark.createDataFrame([(x,) for x in {*said, *names}], "t string").select("t", matching.linker_text(F.col("t")).alias("n")).collect()}
    for block in (2000, 9):
        matching.BLOCK, before = block, matching.BLOCK
        try:
            got = {r.mention: r for r in matching.fuzzy_link(one, two).collect()}
        finally:
            matching.BLOCK = before
        for i, text, kind in mentions:
            every = sorted((-token_set_ratio(clean[text], clean[name]), e) for e, name, k in bank if k == kind)
            assert [(c.entity, c.score) for c in got[i].candidates] == [(e, -s) for s, e in every[:8]]
            assert (got[i].entity, got[i].method) == ((every[0][1], "fuzzy") if every[0][0] <= -92 else (None, "none"))
    assert got[1].method == "fuzzy" and got[1].entity == "e001"


def test_neighbors_in_blocks(spark):
    vectors = retrieval.letter_vectors(Corpus(spark, D).chunks)
    want = sorted(map(tuple, retrieval.top_neighbors(vectors).collect()))
    assert want == sorted(map(tuple, retrieval.top_neighbors(vectors, block=7).collect())) and len(want) == 5 * vectors.count()


def test_labels_that_contain(spark):
    texts_ = spark.createDataFrame([("Berg",), ("erg",), ("von  b",), ("",), ("zz",)], "text string")
    labels = spark.createDataFrame([("p2", "Anna von Berg"), ("p1", "Herberg"), ("p3", "")], "id string, label string")
    assert {r.text: r.entity for r in matching.name_contains(texts_, labels).collect()} == {"Berg": "p1", "erg": "p1", "von  b": "p2", "": None, "zz": None}
    assert {r.text: r.entity for r in matching.name_contains(texts_, labels, whole_words=True).collect()} == {"Berg": "p2", "erg": None, "von  b": None, "": "p3", "zz": None}


def test_register(spark):
    d = spark.createDataFrame([(1, "done_A", 3), (2, "b", None), (3, None, 1)], "id int, title string, pages int")
    assert [r.id for r in register.select_documents(d, "done_").orderBy("id").collect()] == [2, 3]
    assert [r.id for r in register.select_documents(d, "done_", only_done=True).collect()] == [1]
    assert [r.id for r in register.sorted_documents(d, "pages").collect()] == [2, 3, 1]
    wanted = spark.createDataFrame([("b",), ("3",)], "wanted string")
    assert {r.wanted: r.id for r in register.resolve_selection(d, wanted).collect()} == {"b": 2, "3": 3}
    with pytest.raises(Exception, match="no such document"):
        register.resolve_selection(d, spark.createDataFrame([("zz",)], "wanted string")).collect()


def test_transcripts(spark):
    page = "1 .\nErster |Brief\n17\n3. Mai 1821.\n2 *\nText\n* ) Anmerkung\nFuß\n---- Seite 2\nmehr\n2 .\nZweiter"
    t = spark.createDataFrame([("v", page)], "id string, text string")
    got = {r.number: r.text for r in texts.split_letters(texts.corpus_pages(t)).collect()}
    assert got == {1: "Erster Brief\nText\nmehr", 2: "Zweiter"}
    b = spark.createDataFrame([("v", "vor\n## Brief 1\na\n## Brief 2\nb")], "id string, text string")
    assert [r.block for r in texts.headed_blocks(b).orderBy("position").collect()] == ["## Brief 1\na\n", "## Brief 2\nb"]
    assert [r.block for r in texts.hash_blocks(spark.createDataFrame([("v", "# a # b")], "id string, text string")).collect()] == ["a", "b"]


def test_authority_records(spark):
    j = '{"preferredName":"X","gender":[{"id":"https://d/g#female"}],"dateOfBirth":["1790"],"professionOrOccupation":[{"id":"i","label":"Dichterin"}],"publication":[{"title":"a"},{"title":"b"}]}'
    got = texts.authority_records(spark.createDataFrame([("1", j), ("2", "no json")], "gnd_id string, json string")).collect()
    one = next(r for r in got if r.gnd_id == "1")
    assert (one.name, one.gender, one.birth, one.occupations, one.publications) == ("X", "female", "1790", ["Dichterin"], 2)
    rows = spark.createDataFrame([("w", "gsq", 1, "B", "1500"), ("w", "hsc", 2, "A", "1400"), ("w", "gsq", 3, "B", None)], "work_id string, source string, position int, title string, year string")
    r = texts.candidate_titles(rows).first()
    assert r.titles == ["A", "B"] and r.years == ["1400", "1500"]


def test_sinks(spark, tmp_path):
    c = Corpus(spark, D)
    s = sinks.node_statements(c.persons, "Person", {"label": (F.col("label"), "string")})
    b = sinks.batches(s, 2)
    assert b.groupBy().sum("statements").first()[0] == c.persons.count() and b.where("statements > 2").count() == 0
    assert all(r.value.startswith(":begin\n") and r.value.endswith("\n:commit") for r in b.collect())
    assert len(sinks.constraint_statements()) == 5
    sinks.write_vectors(c.chunks, str(tmp_path / "v"))
    assert spark.read.parquet(str(tmp_path / "v/vectors")).count() == c.chunks.count()
    box = tools.Toolbox(c)
    sinks.write_graph(box.nodes(), box.edges(), str(tmp_path / "g"))
    assert spark.read.parquet(str(tmp_path / "g/edges")).where("type = 'SENT_BY'").count() == c.letters.count()
    sinks.write_json(sinks.letters_index(c.letters, c.persons), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == c.letters.count()
    assert sinks.rag_json(c.letters, c.mentions.select("letter_id", F.lit("literature").alias("kind"), F.col("entity_id").alias("label"))).count() == c.letters.count()
    assert sinks.lookup_string(c.persons).first().value.count("|") == 24
    parts = sorted(sinks.lookup_string(c.persons, room=100).collect())
    assert len(parts) > 2 and all(len(r.value) <= 250 for r in parts)
    assert "|".join(r.value for r in parts) == sinks.lookup_string(c.persons).first().value
    assert sinks.filled_template(spark.range(1).select(F.lit("x").alias("a"), F.lit(None).cast("string").alias("b")), "<{a}{b}>", ["a", "b"]).first().value == "<x>"


def test_triples_either_way(spark):
    letters = Corpus(spark, D).letters
    gaps = letters.limit(50).union(spark.createDataFrame([(-1, None, "p", "", "1825-01", None, ""), (-2, "", None, None, None, None, "")], letters.schema))
    both = [sorted(map(str, sinks.letter_triples(gaps, "https://e.org/", one).collect())) for one in (False, True)]
    assert both[0] == both[1] and len(both[0]) > 500


def test_patterns(spark):
    t = spark.createDataFrame([("a", "knows", "b"), ("b", "knows", "c"), ("c", "knows", "c"), ("a", "name", "Anna")], "s string, p string, o string")
    assert {(r.x, r.z) for r in patterns.match(t, [("?x", "knows", "?y"), ("?y", "knows", "?z")]).collect()} == {("a", "c"), ("b", "c"), ("c", "c")}
    assert [r.x for r in patterns.match(t, [("?x", "knows", "?x")]).collect()] == ["c"]
    with pytest.raises(ValueError):
        patterns.match(t, [("?x", "knows", "b"), ("?y", "name", "?n")])
    q = 'PREFIX e: <> ASK { ?x <name> "Anna" . ?x <knows> ?y }'
    assert patterns.run(t, q).first().answer and not patterns.run(t, q.replace("Anna", "Berta")).first().answer
    assert patterns.run(t, "SELECT DISTINCT ?x WHERE { ?x <knows> ?y ; <name> ?n . } ORDER BY DESC(?x) LIMIT 5").first().x == "a"
    for bad in ("INSERT DATA {}", "SELECT ?x { ?x ?y }", "SELECT ?x { OPTIONAL { ?x ?p ?o } }"):
        with pytest.raises(ValueError):
            patterns.parse(bad)
    with pytest.raises(ValueError):
        patterns.read_only("MATCH (n) DETACH DELETE n")
    assert patterns.read_only("MATCH (n {x: 'set'}) RETURN n")


def test_cypher_that_is_not_understood(spark):
    box = tools.Toolbox(Corpus(spark, D))
    for text in ("MATCH (a)-[r]->(b) WHERE a.id = 'x' OR b.id = 'y' RETURN a", "MATCH (a) WHERE c.id = 'x' RETURN a", "MATCH (a) RETURN type(a)", "MATCH (a) RETURN labels(z)", "MATCH (a {id: y}) RETURN a", "MATCH (a) WHERE a.id RETURN a"):
        with pytest.raises(ValueError):
            patterns.cypher(box.nodes(), box.edges(), text)
    got = patterns.cypher(box.nodes(), box.edges(), "MATCH (p:Person) WHERE p.label CONTAINS 'NATION_1' AND p.label <> 'NATION_12' RETURN p.label AS name, labels(p) ORDER BY name DESC LIMIT 3").collect()
    assert [(r.name, r.labels_p) for r in got] == [("NATION_19", ["Person"]), ("NATION_18", ["Person"]), ("NATION_17", ["Person"])]


def test_tools(spark):
    box = tools.Toolbox(Corpus(spark, D))
    assert box.call("lookup_entity", {"name": "nation_6"}).first().id == "person-6"
    assert box.call("get_letter", {"id": 1}).count() == 1
    assert box.call("semantic_search", {"vector": [0.1] * 64, "k": 3}).count() == 3
    assert box.call("cypher", {"query": "MATCH (p:Person {label: 'NATION_6'})<-[:SENT_BY]-(l:Letter) RETURN p.label AS name, count(*) AS n"}).first().name == "NATION_6"
    assert box.call("sparql", {"query": "SELECT (COUNT(*) AS ?n) WHERE { ?l <http://schema.org/dateCreated> ?d }"}).first().n == box.corpus.letters.count()
    assert box.call("graph_neighbors", {"key": "1"}).count() >= 3
    for name, args in (("nothing", {}), ("get_letter", {}), ("get_letter", {"id": 1, "x": 2})):
        with pytest.raises(ValueError):
            box.call(name, args)
    assert tools.parse_action('I will {not json} {"tool": "get_letter", "args": {"id": 1}} now') == ("get_letter", {"id": 1})
    assert tools.parse_action("plain") is None


def test_streams(spark, tmp_path):
    source = spark.read.parquet(f"{D}/events.parquet")
    source.repartition(3).write.parquet(str(tmp_path / "in"))
    q = events.windowed_counts(events.event_stream(spark, str(tmp_path / "in")), "1 hour", "3650 days").writeStream.outputMode("complete").format("memory").queryName("w").start()
    q.processAllAvailable()
    q.stop()
    got = {tuple(r) for r in spark.sql("SELECT start, event_type, events FROM w").collect()}
    assert got == {tuple(r) for r in events.windowed_counts(source).select("start", "event_type", "events").collect()}
    a = spark.createDataFrame([("x", "1"), ("y", "2")], "path string, sha256 string")
    assert [r.path for r in events.changed_files(a, a.limit(1)).collect()] == ["y"]


def test_views(spark):
    Corpus(spark, D).views("t_")
    assert spark.sql("SELECT count(*) FROM t_letters").first()[0] > 0
