import duckdb
from pyspark.sql import functions as F

from quillgraph.operators import records as R
from quillgraph.plans import sql
from quillgraph.queries import QUERIES, SQL
from quillgraph.sources import schemas as M
from quillgraph.sources import sinks
from quillgraph.sources.adapter import Corpus
from tests import oracle

D = "/root/testdata/sf0.001"


def test_properties(spark):
    persons = spark.createDataFrame([("p1", "person", "O'Neil", "historical", None, False, (None, "w", None), [], ["a", "b"], "1790", None)], M.PERSON)
    p = R.with_properties(persons, R.person_properties()).first()
    assert p.corporate_body is False and p.occupation is None and p.education == ["a", "b"] and p.wikidata == "w"
    line = sinks.node_statements(persons, "Person", R.person_properties()).first().statement
    assert line == "MERGE (n:Person {id: 'p1'}) SET n.label = 'O\\'Neil', n.kind = 'person', n.person_type = 'historical', n.corporate_body = false, n.wikidata = 'w', n.education = ['a', 'b'], n.birth = '1790'"
    witness = spark.createDataFrame([("w1", "manuscript", "x", None, None, "Hs. 1", None)], M.WITNESS)
    assert R.with_properties(witness, R.witness_properties()).first().label == "Hs. 1"
    place = spark.createDataFrame([("o1", "Ort", (None, None, None), (47.5, 9.2), None)], M.PLACE)
    assert R.with_properties(place, R.place_properties()).first().lat == 47.5
    work = spark.createDataFrame([("l1", "W", "charter", None, None, None, None, [("a", "1")])], M.WORK)
    w = R.with_properties(work, R.work_properties()).first()
    assert w.is_exemplar and w.idno == ["a:1"]


def test_flattened(spark):
    place = spark.createDataFrame([("o1", " Ort  x", (None, "q", None), (47.5, 9.2), None)], M.PLACE)
    r = R.flattened(place).first()
    assert r.label == "Ort x" and r.normdaten_wikidata == "q" and r.coords_lat == 47.5


def test_bullets_and_models(spark):
    t = spark.createDataFrame([(1, "Intro\n- first\n * second \n-\n- third")], "id int, text string")
    assert [(r.n, r.item_id, r.item) for r in R.bullet_items(t, "i").orderBy("n").collect()] == [(1, "i1-01", "first"), (2, "i1-02", "second"), (3, "i1-03", "third")]
    m = spark.createDataFrame([("a", True, True), ("b", True, False), ("c", False, True), ("d", None, None)], "name string, enabled boolean, frontend_visible boolean")
    assert [r.name for r in R.enabled_models(m).collect()] == ["a", "b", "d"] and [r.name for r in R.enabled_models(m, True).collect()] == ["a", "d"]


def test_assigned_ids(spark):
    r = spark.createDataFrame([("x", 2), ("y", 1)], "name string, o int")
    assert [x.new_id for x in R.assign_ids(r.withColumn("g", F.lit(1)), "p-", "g", ["o"], 9999).orderBy("o").collect()] == ["p-10000", "p-10001"]


def test_assigned_ids_follow_their_sql_beyond_four_digits(spark, tmp_path):
    parts = spark.range(10_500).selectExpr("id AS p_partkey", "'p' AS p_name", "'t' AS p_type", "'b' AS p_brand")
    parts.write.parquet(str(tmp_path / "part.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    oracle.compare(QUERIES["assigned_ids"](spark, str(tmp_path)), con, SQL["assigned_ids"])
    whole = R.assign_ids(Corpus(spark, str(tmp_path)).works, "w-", "author", ["id"], 100)
    assert whole.select("new_id").distinct().count() == 10_500  # the operator cuts nothing


def test_sql_functions(spark):
    assert "chunk_text" in sql.register(spark)
    assert tuple(spark.sql("SELECT bare_id('a#b'), norm_ws(' a\tb '), date_precision('1825-01'), effective('', 'x'), dot(array(1D, 2D), array(3D, 4D))").first()) == ("b", "a b", "month", "x", 11.0)
    Corpus(spark, D).views("f_")
    from quillgraph.operators import passages

    found = spark.sql("SELECT letter_id, c.* FROM f_texts t, LATERAL chunk_text(t.text, 300, 60) c").collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, passages.chunk_text(Corpus(spark, D).texts).collect()))
