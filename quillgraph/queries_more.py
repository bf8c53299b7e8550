"""More registered queries: scalar functions in wide rows, and sources and sinks over documents made from the tables.

Inputs are put together from the tables' columns, so that the SQL says what must come out without the functions' own way.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.functions import dates as D
from quillgraph.functions import scalars as S
from quillgraph.functions.similarity import token_set_similarity
from quillgraph.operators import graph, integrity, matching, overview, passages, records, register, retrieval
from quillgraph.plans import patterns, tools
from quillgraph.queries import MODEL, query
from quillgraph.sources import sinks, tei, texts
from quillgraph.sources import schemas as M
from quillgraph.sources.adapter import Corpus

NL = "\n"


def _text(*parts: object) -> Column:
    """Columns and literals joined; a plain string is a literal, a column's value its text."""
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


# Scalars


@query(sql="""SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN 'Letter' WHEN 1 THEN 'Person' WHEN 2 THEN 'Place' WHEN 3 THEN 'Work' ELSE 'Witness' END AS label,
  'ed-letter-' || CASE WHEN length(CAST(o_orderkey AS VARCHAR)) < 4 THEN lpad(CAST(o_orderkey AS VARCHAR), 4, '0') ELSE CAST(o_orderkey AS VARCHAR) END AS letter_id,
  CASE o_orderkey % 4 WHEN 0 THEN 'published' WHEN 1 THEN 'reviewed' ELSE 'draft' END AS status,
  CASE o_orderkey % 3 WHEN 2 THEN 's' || o_orderkey ELSE 'r' || o_orderkey END AS effective,
  'ed-letter-' || o_orderkey || ',ed-letter-7' AS cited, CASE WHEN o_orderkey % 2 = 0 THEN 'vd18:' || o_orderkey ELSE '' END AS idno FROM orders""")
def id_scalars(spark: SparkSession, d: str) -> DataFrame:
    """P9, P11, P12, P13, P14, P17, P29, P44."""
    k = F.col("o_orderkey")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("letter", "correspondent", "place", "literature", "witness")]), (k % 5 + 1).cast("int"))
    statuses = F.when(k % 4 == 0, F.array(F.lit("draft"), F.lit("published"))).when(k % 4 == 1, F.array(F.lit("reviewed"))).when(k % 4 == 2, F.array(F.lit(""))).otherwise(F.expr("cast(array() as array<string>)"))
    sent = F.when(k % 3 == 2, _text("s", k)).when(k % 3 == 0, "")
    idno = F.array(F.struct(F.lit("vd18").alias("type"), F.when(k % 2 == 0, k.cast("string")).alias("value")), F.struct(F.lit("").alias("type"), F.lit("x").alias("value")))
    rows = Corpus(spark, d).table("orders").withColumn("statuses", statuses)
    return rows.select(
        k.alias("id"), S.label_for_id(_text("ed-", kind, "-", k), "ed").alias("label"), S.normalize_letter_id(_text("Letter ", k, " (copy)"), "ed").alias("letter_id"), S.last_status(F.col("statuses")).alias("status"),
        S.effective(sent, _text("r", k)).alias("effective"), F.array_join(S.citations(_text("see ed-letter-", k, " and (ed-letter-7)."), "ed"), ",").alias("cited"), F.array_join(S.flatten_idno(idno), ",").alias("idno"),
    )


@query(sql="""SELECT p_partkey AS id, p_type || ' ' || p_brand AS author, lower(p_name) || ' x' AS linker, CASE WHEN p_partkey % 2 = 0 THEN true ELSE false END AS coordinates,
  'id' || p_partkey || '|x' AS ids, p_brand || '; B: ' || p_name || '.' AS citation, 'ab ' || substr(p_type, 1, 1) || 'c' AS camel,
  CASE p_partkey % 3 WHEN 0 THEN 'corporate body' WHEN 1 THEN 'group' ELSE 'person' END AS kind, CASE WHEN p_partkey % 2 = 0 THEN p_brand || ', ' || p_type ELSE p_type END AS joined,
  p_brand || chr(10) || substr(p_name, 1, 5) AS block, CASE p_partkey % 4 WHEN 0 THEN 'https://d-nb.info/gnd/' || p_partkey END AS gnd,
  CASE p_partkey % 4 WHEN 1 THEN 'https://www.wikidata.org/wiki/Q' || p_partkey END AS wikidata, CASE p_partkey % 4 WHEN 2 THEN 'http://e.org/' || p_partkey END AS other,
  'Berg' || p_partkey AS last FROM part""")
def name_scalars(spark: SparkSession, d: str) -> DataFrame:
    """P5, P27, P38, P40, P41, P43, P48, P51, P52, P55, P58."""
    k, none = F.col("p_partkey"), F.lit(None).cast("string")
    ref = F.when(k % 4 == 0, _text(" https://d-nb.info/gnd/", k)).when(k % 4 == 1, _text("https://www.wikidata.org/wiki/Q", k)).when(k % 4 == 2, _text("http://e.org/", k)).otherwise("-")
    rows = Corpus(spark, d).table("part").withColumn("ref", S.classify_ref(ref))
    place = F.when(k % 2 == 0, _text(" ", k, ".5, -", k)).otherwise(_text(k, "; 3"))
    return rows.select(
        k.alias("id"), S.flip_author(_text(F.col("p_brand"), ",  ", F.col("p_type"))).alias("author"), S.linker_text(_text(" „", F.upper("p_name"), "”\t (x) ")).alias("linker"), S.is_coordinates(place).alias("coordinates"),
        F.array_join(S.named_ids(_text("A b (id", k, ") | B (none)| C (x, y)")), "|").alias("ids"), S.citation(F.array(F.col("p_brand"), F.lit("B")), F.col("p_name")).alias("citation"), S.split_camel(_text("ab", F.substring("p_type", 1, 1), "c- ")).alias("camel"),
        S.person_kind(F.when(k % 3 == 1, "personGrp").otherwise("person"), F.when(k % 3 == 0, True)).alias("kind"), S.join_filled(", ", F.when(k % 2 == 0, F.col("p_brand")).otherwise(""), none, F.col("p_type")).alias("joined"),
        S.context_block(F.col("p_brand"), none, F.lit(""), text=F.col("p_name"), limit=5).alias("block"), "ref.gnd", "ref.wikidata", "ref.other", S.last_name(_text("Frhr. v. Berg", k)).alias("last"),
    )


@query(sql="""SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS dateline, 'Handschrift ' || o_orderkey || ' ist neu' || chr(10) || chr(10) || 'Absatz' AS plain,
  'a ' || o_orderkey || ' b' AS all_text, 100.0 AS alike, CASE WHEN o_orderkey % 2 = 0 THEN 50.0 ELSE 0.0 END AS half FROM orders""")
def text_scalars(spark: SparkSession, d: str) -> DataFrame:
    """P1, P31, P32, T6."""
    k = F.col("o_orderkey")
    day = F.col("o_orderdate")
    line = _text("[", F.dayofmonth(day), ". ", F.month(day), ".(?) ", F.year(day), "]")
    return Corpus(spark, d).table("orders").select(
        k.alias("id"), D.dateline(line).alias("dateline"), S.dehyphenate(_text("Hand-\nschrift ", k, NL, " ist neu \n \n\nAbsatz")).alias("plain"), S.norm_ws(_text("\ta \n", k, "  b ")).alias("all_text"),
        token_set_similarity(_text("anna ", k, " berg"), _text("berg ", k, " anna")).alias("alike"), token_set_similarity(F.lit("ab"), F.when(k % 2 == 0, "bc").otherwise("xy")).alias("half"),
    )


@query(sql="""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'get' END AS tool, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderkey AS VARCHAR) END AS argument FROM orders""")
def reply_actions(spark: SparkSession, d: str) -> DataFrame:
    """Tool and argument that replies ask for, some of them without any."""
    k = F.col("o_orderkey")
    reply = F.when(k % 3 == 0, _text("no {tool} for ", k)).when(k % 3 == 1, _text('first {x} then {"tool": "get", "args": {"id": "', k, '"}} done')).otherwise(_text('{"action": "get", "parameters": {"id": "', k, '"}}'))

    @F.udf("struct<tool:string,argument:string>", useArrow=True)
    def asked(text: str):
        found = tools.parse_action(text)
        return (found[0], found[1].get("id")) if found else None

    return Corpus(spark, d).table("orders").select(k.alias("id"), asked(reply).alias("a")).select("id", "a.tool", "a.argument")


# Records, registers, selections


@query(sql="""SELECT n_nationkey AS id, n AS n, 'i' || n_nationkey || '-0' || n AS item_id, CASE n WHEN 1 THEN n_name ELSE 'second' END AS item FROM nation, (VALUES (1), (2)) t(n)""")
def bullet_items(spark: SparkSession, d: str) -> DataFrame:
    """P56."""
    t = Corpus(spark, d).table("nation").select(F.col("n_nationkey").alias("id"), _text("Intro\n- ", F.col("n_name"), "\n-\n  * second ").alias("text"))
    return records.bullet_items(t, "i")


@query(sql="SELECT n_nationkey AS id, n_name AS label, 'q' || n_nationkey AS normdaten_wikidata, CAST(n_nationkey AS DOUBLE) AS coords_lat FROM nation")
def flattened_places(spark: SparkSession, d: str) -> DataFrame:
    """P57."""
    k = F.col("n_nationkey")
    rows = Corpus(spark, d).table("nation").select(k.alias("id"), _text(F.col("n_name"), "  ").alias("label"), F.struct(_text("q", k).alias("wikidata")).alias("normdaten"), F.struct(k.cast("double").alias("lat")).alias("coords"))
    return records.flattened(rows)


@query(sql="SELECT p_partkey AS name FROM part WHERE p_partkey % 3 <> 1 AND p_partkey % 5 <> 1")
def enabled_models(spark: SparkSession, d: str) -> DataFrame:
    """F13."""
    k = F.col("p_partkey")
    config = Corpus(spark, d).table("part").select(k.alias("name"), F.when(k % 3 == 0, True).when(k % 3 == 1, False).alias("enabled"), F.when(k % 5 == 0, True).when(k % 5 == 1, False).alias("frontend_visible"))
    return records.enabled_models(config, True).select("name")


MODEL["docs"] = "docs AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN 'done_' ELSE '' END || p_name AS title, CASE WHEN p_partkey % 7 <> 0 THEN p_size END AS pages FROM part)"


def _documents(c: Corpus) -> DataFrame:
    k = F.col("p_partkey")
    return c.table("part").select(k.alias("id"), _text(F.when(k % 4 == 0, "done_").otherwise(""), F.col("p_name")).alias("title"), F.when(k % 7 != 0, F.col("p_size")).alias("pages"))


@query("docs", sql="SELECT id, title, pages FROM docs WHERE title NOT LIKE 'done_%' AND (contains(lower(title), 'bolt') OR contains(CAST(id AS VARCHAR), 'bolt'))")
def selected_documents(spark: SparkSession, d: str) -> DataFrame:
    """F9."""
    return register.select_documents(_documents(Corpus(spark, d)), "done_", text="bolt")


@query("docs", sql="SELECT id, title, pages FROM docs ORDER BY coalesce(pages, 0) DESC, id LIMIT 40")
def sorted_documents(spark: SparkSession, d: str) -> DataFrame:
    """The first page of the sorted list."""
    return register.sorted_documents(_documents(Corpus(spark, d)), "pages", descending=True).limit(40)


@query("docs", sql="SELECT CASE WHEN id % 2 = 0 THEN CAST(id AS VARCHAR) ELSE title END AS wanted, CASE WHEN id % 2 = 0 THEN id ELSE first END AS id FROM (SELECT *, min(id) OVER (PARTITION BY title) AS first FROM docs)")
def resolved_selection(spark: SparkSession, d: str) -> DataFrame:
    """J24."""
    docs = _documents(Corpus(spark, d))
    return register.resolve_selection(docs, docs.select(F.when(F.col("id") % 2 == 0, F.col("id").cast("string")).otherwise(F.col("title")).alias("wanted")))


@query(sql="SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'new' || p_partkey ELSE p_brand END AS sig, p_type AS other FROM part")
def applied_updates(spark: SparkSession, d: str) -> DataFrame:
    """J21."""
    rows = Corpus(spark, d).table("part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("sig"), F.col("p_type").alias("other"))
    new = rows.where("id % 3 = 0").select("id", _text("new", F.col("id")).alias("sig"))
    return matching.apply_updates(rows, new, "id", ["sig"])


@query(sql="SELECT p_name AS text, arg_max(p_partkey, p_partkey) AS key FROM part GROUP BY p_name UNION ALL SELECT 'nobody', NULL")
def span_keys(spark: SparkSession, d: str) -> DataFrame:
    """J26."""
    named = Corpus(spark, d).table("part").select(F.col("p_name").alias("text"), F.col("p_partkey").alias("key"), F.col("p_partkey").alias("position"))
    return matching.set_keys(named.select("text").distinct().unionByName(spark.range(1).select(F.lit("nobody").alias("text"))), named)


@query(sql="""SELECT p_partkey AS work_id, CASE WHEN p_partkey % 2 = 0 THEN 'preferred|' || p_name ELSE p_name || '|preferred' END AS titles, CASE WHEN p_partkey % 2 = 0 THEN '1500' ELSE '1400|1500' END AS years FROM part""")
def candidate_titles(spark: SparkSession, d: str) -> DataFrame:
    """A preferred source's titles come first, and each once."""
    k = F.col("p_partkey")
    rows = F.array(
        F.struct(F.when(k % 2 == 0, "gsq").otherwise("hsc").alias("source"), F.lit(1).alias("position"), F.col("p_name").alias("title"), F.lit("1500").alias("year")),
        F.struct(F.when(k % 2 == 0, "hsc").otherwise("gsq").alias("source"), F.lit(2).alias("position"), F.lit("preferred").alias("title"), F.when(k % 2 == 1, "1400").alias("year")),
        F.struct(F.lit("gsq").alias("source"), F.lit(3).alias("position"), F.col("p_name").alias("title"), F.lit(None).cast("string").alias("year")),
    )
    found = texts.candidate_titles(Corpus(spark, d).table("part").select(k.alias("work_id"), F.explode(rows).alias("r")).select("work_id", "r.*"))
    return found.select("work_id", F.array_join("titles", "|").alias("titles"), F.array_join("years", "|").alias("years"))


@query(sql="SELECT vec_id // 5 AS letter_id, vec_id AS chunk_id, CASE WHEN vec_id % 3 = 0 THEN 'fresh' ELSE 'good' END AS state FROM embeddings")
def incremental_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Every third passage has changed since it was embedded."""
    now = Corpus(spark, d).chunks.select("letter_id", "chunk_id", _text("sha", F.col("chunk_id")).alias("sha256"))
    known = now.withColumn("sha256", F.when(F.col("chunk_id") % 3 == 0, "old").otherwise(F.col("sha256")))
    fresh, good = retrieval.incremental(now, known)
    both = fresh.withColumn("state", F.lit("fresh")).unionByName(good.withColumn("state", F.lit("good")))
    return both.select("letter_id", "chunk_id", "state")


@query("letters", sql="SELECT CAST(id AS VARCHAR) AS source, sender AS target, 'SENT_BY' AS type FROM letters WHERE sender IS NOT NULL UNION ALL SELECT 'work-' || p_partkey, 'person-' || p_partkey % 25, 'AUTHORED_BY' FROM part WHERE p_partkey % 4 <> 0 UNION ALL SELECT 'work-' || p_partkey, 'place-' || p_partkey % 25, 'PUBLISHED_AT' FROM part WHERE p_partkey % 3 <> 0 UNION ALL SELECT 'witness-' || p_partkey, 'work-' || p_partkey, 'WITNESS_OF' FROM part")
def relation_edges(spark: SparkSession, d: str) -> DataFrame:
    """Relations of works and witnesses beside those of letters."""
    c, k = Corpus(spark, d), F.col("p_partkey")
    parts = c.table("part")
    works = parts.select(_text("work-", k).alias("id"), F.when(k % 4 != 0, _text("person-", k % 25)).otherwise("").alias("author_key"), F.when(k % 3 != 0, _text("place-", k % 25)).alias("place_key"))
    witnesses = parts.select(_text("witness-", k).alias("id"), _text("work-", k).alias("work_key"))
    letters = c.letters.withColumn("recipient", F.lit(None).cast("string")).withColumn("place", F.lit(None).cast("string"))
    return graph.build_edges(letters, c.mention_rows.limit(0), works, witnesses)


@query("letters", sql="SELECT id, CASE WHEN id % 5 = 0 THEN 'online_print' ELSE publication_status END AS publication_status, CAST(id % 5 = 0 AND publication_status <> 'online_print' AS BOOLEAN) AS changed FROM letters")
def synced_register(spark: SparkSession, d: str) -> DataFrame:
    """Rows that have drifted are put right, the others stay."""
    letters = Corpus(spark, d).letters.select("id", "publication_status")
    drift = letters.where("id % 5 = 0 and publication_status <> 'online_print'").select("id", F.lit("online_print").alias("wanted"))
    return integrity.synced(letters, drift)


@query("letters", sql="SELECT 'matched' AS part, count(*) AS n FROM letters WHERE recipient IS NOT NULL UNION ALL SELECT 'unmatched', count(*) FROM letters WHERE recipient IS NULL")
def split_matches(spark: SparkSession, d: str) -> DataFrame:
    """K15."""
    hit, miss = sinks.split_matched(Corpus(spark, d).letters, "recipient")
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
    return count(hit, "matched").unionByName(count(miss, "unmatched"))


@query("letters", sql="SELECT id, '<p>' || id || ' an ' || coalesce(recipient, '') || ', ' || date || '</p>' AS value FROM letters")
def filled_templates(spark: SparkSession, d: str) -> DataFrame:
    """K17."""
    return sinks.filled_template(Corpus(spark, d).letters, "<p>{id} an {recipient}, {date}</p>", ["id", "recipient", "date"]).select("id", "value")


@query(sql="SELECT letter_id, 'a <per>Anna' || letter_id || '</per> in <pl>Ort</pl>.' AS text FROM (SELECT doc_id AS letter_id FROM documents)")
def spliced_texts(spark: SparkSession, d: str) -> DataFrame:
    """P53."""
    k = F.col("letter_id")
    t = Corpus(spark, d).texts.select(k, _text("a Anna", k, " in Ort.").alias("text"))
    at = F.length(k.cast("string"))
    s = t.select("letter_id", F.explode(F.array(F.struct((at + 10).alias("start"), (at + 13).alias("end"), F.lit("pl").alias("tag")), F.struct(F.lit(2).alias("start"), (at + 6).alias("end"), F.lit("per").alias("tag")))).alias("s")).select("letter_id", "s.*")
    return passages.splice(s, t)


@query("letters", "chunks", sql="SELECT count(*) AS letters, true AS bounded FROM (SELECT DISTINCT letter_id FROM chunks)")
def stand_in_clusters(spark: SparkSession, d: str) -> DataFrame:
    """T4's stand-in: every letter has a cluster, one of eight at most; which one is the stand-in's own."""
    found = passages.clusters_substitute(retrieval.letter_vectors(Corpus(spark, d).chunks), 8)
    return found.agg(F.count("*").alias("letters"), (F.count_distinct("cluster") <= 8).alias("bounded"))


@query(sql="SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'refused' ELSE 'MATCH (n {x: ''set ' || s_suppkey || '''}) RETURN n' END AS answer FROM supplier")
def read_only_queries(spark: SparkSession, d: str) -> DataFrame:
    """F8: texts that would change a graph are refused; words in quotes don't count."""

    @F.udf("string", useArrow=True)
    def checked(text: str) -> str:
        try:
            return patterns.read_only(text)
        except ValueError:
            return "refused"

    k = F.col("s_suppkey")
    text = F.when(k % 2 == 0, _text("MATCH (n {x: '", k, "'}) SET n.y = 1")).otherwise(_text("MATCH (n {x: 'set ", k, "'}) RETURN n"))
    return Corpus(spark, d).table("supplier").select(k.alias("id"), checked(text).alias("answer"))


@query("letters", "mentions", sql="SELECT CAST(id AS VARCHAR) AS id, (SELECT count(*) FROM mentions WHERE letter_id = 1) AS n_mentions FROM letters WHERE id = 1")
def tool_call(spark: SparkSession, d: str) -> DataFrame:
    """a tool by its name, with checked arguments."""
    found = tools.Toolbox(Corpus(spark, d)).call("get_letter", {"id": 1})
    return found.select(F.col("id").cast("string").alias("id"), "n_mentions")


# Documents made from the tables, and what their readers make of them

NS = 'xmlns="http://www.tei-c.org/ns/1.0"'


def _wrapped(entries: Column) -> Column:
    return _text(f"<TEI {NS}><text><body>", F.array_join(entries, ""), "</body></text></TEI>").cast("binary")


def _register(df: DataFrame, entry: Column, name: str) -> DataFrame:
    """(path, content): one register file with an entry for each row of a small table."""
    return df.agg(F.array_sort(F.collect_list(entry)).alias("e")).select(F.lit(f"file:/r/{name}.xml").alias("path"), _wrapped(F.col("e")).alias("content"))


def _persons_file(c: Corpus) -> DataFrame:
    k = F.col("n_nationkey")
    ref = F.when(k % 3 == 0, _text("https://d-nb.info/gnd/", k)).when(k % 3 == 1, "-").otherwise("")
    person = _text('<person xml:id="ed-correspondent-', F.lpad(k.cast("string"), 4, "0"), '" type="contemporary" gender="male" ref="', ref, '"><persName>Alias</persName><persName type="main">Name  ', F.col("n_name"), "</persName><occupation>o", k, '</occupation><occupation> </occupation><birth when="17', k + 10, '"/><death/></person>')
    group = _text('<personGrp xml:id="ed-correspondent-', F.lpad(k.cast("string"), 4, "0"), '" gender="CorporateBody">Verein ', F.col("n_name"), "</personGrp>")
    return _register(c.table("nation"), F.when(k % 5 == 4, group).when(k % 5 == 3, _text("<person><persName>", F.col("n_name"), "</persName></person>")).otherwise(person), "ed-persons")


@query(sql="""SELECT 'ed-correspondent-' || lpad(CAST(n_nationkey AS VARCHAR), 4, '0') AS id, CASE WHEN n_nationkey % 5 = 4 THEN 'personGrp' ELSE 'person' END AS kind,
  CASE WHEN n_nationkey % 5 = 4 THEN 'Verein ' ELSE 'Name ' END || n_name AS label, CASE WHEN n_nationkey % 5 = 4 THEN true ELSE false END AS corporate_body,
  CASE WHEN n_nationkey % 5 <> 4 AND n_nationkey % 3 = 0 THEN 'https://d-nb.info/gnd/' || n_nationkey END AS gnd, CASE WHEN n_nationkey % 5 <> 4 THEN 'o' || n_nationkey ELSE '' END AS occupation,
  CASE WHEN n_nationkey % 5 <> 4 THEN '17' || (n_nationkey + 10) END AS birth FROM nation WHERE n_nationkey % 5 <> 3""")
def tei_persons(spark: SparkSession, d: str) -> DataFrame:
    """S2, U6, P2."""
    found = tei.parsed(_persons_file(Corpus(spark, d)), lambda root, _: tei.person_rows(root), M.PERSON)
    return found.select("id", "kind", "label", "corporate_body", "normdaten.gnd", F.array_join("occupation", "|").alias("occupation"), "birth")


def _places_file(c: Corpus) -> DataFrame:
    k = F.col("n_nationkey")
    geo = F.when(k % 2 == 0, _text(k, ".5, -", k)).otherwise("x,y")
    key = F.when(k % 4 == 3, "").otherwise(_text(' xml:id="ed-place-', k, '"'))
    return _register(c.table("nation"), _text("<place", key, '><placeName ref="https://www.wikidata.org/wiki/Q', k, '">', F.col("n_name"), "</placeName><location><geo>", geo, "</geo></location><desc> d  ", k, "</desc></place>"), "ed-places")


@query(sql="SELECT 'ed-place-' || n_nationkey AS id, n_name AS label, 'https://www.wikidata.org/wiki/Q' || n_nationkey AS wikidata, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey + 0.5::DOUBLE END AS lat, CASE WHEN n_nationkey % 2 = 0 THEN -n_nationkey::DOUBLE END AS lon, 'd ' || n_nationkey AS \"desc\" FROM nation WHERE n_nationkey % 4 <> 3")
def tei_places(spark: SparkSession, d: str) -> DataFrame:
    """S3."""
    found = tei.parsed(_places_file(Corpus(spark, d)), lambda root, _: tei.place_rows(root), M.PLACE)
    return found.select("id", "label", "normdaten.wikidata", "coords.lat", "coords.lon", "desc")


def _works_file(c: Corpus) -> DataFrame:
    k = F.col("p_partkey")
    key = F.when(k % 2 == 0, _text("../p.xml#ed-correspondent-", k % 25)).otherwise("")
    return _register(c.table("part"), _text('<bibl xml:id="ed-literature-', k, '" type="charter"><author key="', key, '">', F.col("p_brand"), "</author><title>", F.col("p_name"), '</title><date>1', k % 900 + 100, '</date><idno type="vd18">', k, '</idno><idno type="x"/></bibl>'), "ed-literature")


@query(sql="SELECT 'ed-literature-' || p_partkey AS id, p_name AS label, CASE WHEN p_partkey % 2 = 0 THEN 'ed-correspondent-' || p_partkey % 25 END AS author_key, p_brand AS author, '1' || (p_partkey % 900 + 100) AS date, 'vd18:' || p_partkey AS idno FROM part")
def tei_works(spark: SparkSession, d: str) -> DataFrame:
    """S4, P11."""
    found = tei.parsed(_works_file(Corpus(spark, d)), lambda root, _: tei.work_rows(root), M.WORK)
    return found.select("id", "label", F.col("author.key").alias("author_key"), F.col("author.label").alias("author"), "date", F.array_join(S.flatten_idno(F.col("idno")), "|").alias("idno"))


def _witnesses_file(c: Corpus) -> DataFrame:
    k = F.col("n_nationkey")
    return _register(c.table("nation"), _text('<witness xml:id="ed-witness-', k, '" type="manuscript" corresp="x.xml#ed-literature-', k, '"><bibl><settlement>', F.col("n_name"), "</settlement>", F.when(k % 2 == 0, "<repository>Archiv</repository>").otherwise(""), '<idno type="signature">Hs. ', k, "</idno></bibl></witness>"), "ed-manuscripts")


@query(sql="SELECT 'ed-witness-' || n_nationkey AS id, 'ed-literature-' || n_nationkey AS corresp, n_name AS settlement, CASE WHEN n_nationkey % 2 = 0 THEN 'Archiv' ELSE 'Hs. ' || n_nationkey END AS label FROM nation")
def tei_witnesses(spark: SparkSession, d: str) -> DataFrame:
    """S5, P10 (Q1)."""
    found = tei.parsed(_witnesses_file(Corpus(spark, d)), lambda root, _: tei.witness_rows(root), M.WITNESS)
    return found.select("id", "corresp", "settlement", tei.witness_label().alias("label"))


def _letters_register(c: Corpus) -> DataFrame:
    """A register with a row for each customer; every seventh row has no key."""
    k = F.col("c_custkey")
    key = F.when(k % 7 == 6, "").otherwise(_text(' key="ed-letter-', k, '"'))
    url = F.when(k % 2 == 0, _text("https://e.org/", k)).otherwise("done")
    return _register(c.table("customer"), _text("<correspDesc", key, ' change="online_print"><correspAction type="sent"><persName key="p.xml#ed-correspondent-', F.col("c_nationkey"), '"/><placeName key="ed-place-', F.col("c_nationkey"), '"/><date when="18', k % 90 + 10, '-05"/></correspAction><correspAction type="received"/><note type="nummer_harris">', k, '</note><note type="url_facsimile">', url, '</note><note type="published_in" target="https://b.org/', k, '">Band</note><note type="scan">online</note></correspDesc>'), "ed-letters")


@query(sql="SELECT 'ed-letter-' || c_custkey AS id, 'ed-correspondent-' || c_nationkey AS sender, 'ed-place-' || c_nationkey AS place, '18' || (c_custkey % 90 + 10) || '-05' AS date, 'month' AS date_precision, 'online_print' AS publication_status, CAST(c_custkey AS VARCHAR) AS harris_number, CASE WHEN c_custkey % 2 = 0 THEN 'https://e.org/' || c_custkey END AS facsimile_url, 'https://b.org/' || c_custkey AS published_in_url, 'online' AS scan FROM customer WHERE c_custkey % 7 <> 6")
def tei_register(spark: SparkSession, d: str) -> DataFrame:
    """S7, P4, P6."""
    found = tei.parsed(_letters_register(Corpus(spark, d)), lambda root, _: tei.register_rows(root), tei.REGISTER)
    return found.select("id", F.col("sent.person").alias("sender"), "sent.place", "sent.date", "sent.date_precision", "publication_status", "register_meta.harris_number", "register_meta.facsimile_url", "register_meta.published_in_url", "scan")


@query(sql="""SELECT category, count(*) AS n FROM (SELECT 'persons-missing-id' AS category FROM nation WHERE n_nationkey % 5 = 3
  UNION ALL SELECT 'invalid-url-ref' FROM nation WHERE n_nationkey % 5 NOT IN (3, 4) AND n_nationkey % 3 = 1 UNION ALL SELECT 'places-missing-id' FROM nation WHERE n_nationkey % 4 = 3
  UNION ALL SELECT 'places-bad-geo' FROM nation WHERE n_nationkey % 4 <> 3 AND n_nationkey % 2 = 1 UNION ALL SELECT 'register-missing-key' FROM customer WHERE c_custkey % 7 = 6
  UNION ALL SELECT 'invalid-url-note' FROM customer WHERE c_custkey % 7 <> 6 AND c_custkey % 2 = 1) GROUP BY 1""")
def source_warnings(spark: SparkSession, d: str) -> DataFrame:
    """What the readers drop, by category."""
    c = Corpus(spark, d)
    files = _persons_file(c).unionByName(_places_file(c)).unionByName(_letters_register(c))
    return integrity.warning_counts(integrity.register_warnings(tei.parsed(files, tei.register_notes, tei.NOTE)))


def _letter_files(c: Corpus) -> DataFrame:
    """(path, content): a letter for each customer, some of which are no XML."""
    k = F.col("c_custkey")
    head = _text(f'<TEI {NS}><teiHeader><profileDesc><correspDesc><correspAction type="sent"><persName key="p.xml#person-', F.col("c_nationkey"), '"/><date when="1825-01-', F.lpad((k % 28 + 1).cast("string"), 2, "0"), '"/></correspAction><correspAction type="received"><persName key=""/></correspAction><note type="mentioned"><ref type="cmif:mentionsBibl" target="l.xml#ed-literature-', k, " l.xml#ed-witness-", k, '"/><ref type="cmif:mentionsPerson" target=""/></note></correspDesc></profileDesc><revisionDesc><change status="done"/>', F.when(k % 2 == 0, '<change status="published"/>').otherwise(""), "</revisionDesc></teiHeader>")
    body = _text('<text><body><div type="original"><p>Alt <rs key="x#ed-place-', k, '">Ort</rs></p></div>', F.when(k % 3 == 0, '<div type="normalized"/>').when(k % 3 == 1, _text('<div type="normalized"><p>Neu <fw>Kopf</fw>nach\n <add>mehr</add> ', F.col("c_name"), "<!-- still --> hier</p></div>")).otherwise(""), "</body></text></TEI>")
    return c.table("customer").select(_text("file:/l/ed-letter-", k, ".xml").alias("path"), F.when(k % 11 == 0, "<TEI").otherwise(_text(head, body)).cast("binary").alias("content"))


@query(sql="""SELECT 'ed-letter-' || c_custkey AS id, 'person-' || c_nationkey AS sender, '1825-01-' || lpad(CAST(c_custkey % 28 + 1 AS VARCHAR), 2, '0') AS date,
  CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'Neu nach ' || c_name || ' hier' ELSE 'Alt Ort' END AS text, CASE WHEN c_custkey % 2 = 0 THEN 'published' ELSE 'done' END AS status,
  'ed-literature-' || c_custkey AS works, 'ed-witness-' || c_custkey AS witnesses, 'ed-place-' || c_custkey AS rs_keys, 'original' AS source FROM customer WHERE c_custkey % 11 <> 0""")
def tei_letters(spark: SparkSession, d: str) -> DataFrame:
    """letters' files; an empty division blocks the fallback, a file that is no XML is no letter."""
    found = tei.parsed(_letter_files(Corpus(spark, d)), lambda root, path: iter([tei.letter_row(root, path.rpartition("/")[2].removesuffix(".xml"), "ed-witness-")]), tei.LETTER_FILE)
    joined = lambda c: F.array_join(c, "|")
    return found.select("id", F.col("sent.person").alias("sender"), "sent.date", "text", S.last_status(F.col("statuses")).alias("status"), joined("mentions.works").alias("works"), joined("mentions.witnesses").alias("witnesses"), joined("rs_keys").alias("rs_keys"), "source")


@query(sql="SELECT 'file:/l/ed-letter-' || c_custkey || '.xml' AS path FROM customer WHERE c_custkey % 11 = 0")
def unreadable_files(spark: SparkSession, d: str) -> DataFrame:
    """S22."""
    return tei.unreadable(_letter_files(Corpus(spark, d))).select("path")


@query(sql="SELECT 'file:/p/scan-' || conv_id || '.xml' AS path, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS line_no, 'l' || turn AS line_id, 'turn ' || turn || ' of ' || conv_id AS text FROM conversations WHERE turn % 4 <> 3")
def page_lines(spark: SparkSession, d: str) -> DataFrame:
    """A page for each conversation, a line for each turn; blank lines are left out."""
    t = Corpus(spark, d).table("conversations")
    line = _text('<TextLine id="l', F.col("turn"), '"><TextEquiv><Unicode> ', F.when(F.col("turn") % 4 == 3, "").otherwise(_text("turn ", F.col("turn"), " of ", F.col("conv_id"))), " </Unicode></TextEquiv></TextLine>")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"]), "")
    pages = t.groupBy("conv_id").agg(_text('<PcGts xmlns="http://x"><Page><TextRegion>', body, "</TextRegion></Page></PcGts>").cast("binary").alias("content"))
    found = tei.page_lines(pages.select(_text("file:/p/scan-", F.col("conv_id"), ".xml").alias("path"), "content"))
    return found.select("path", "line_no", "line_id", "text")


@query(sql="SELECT n_nationkey AS id, CAST(n AS INTEGER) AS number, CASE n WHEN 1 THEN 'Erster Brief' || chr(10) || n_name || chr(10) || 'mehr' ELSE 'Zweiter ' || n_nationkey END AS text FROM nation, (VALUES (1), (2)) t(n)")
def transcript_letters(spark: SparkSession, d: str) -> DataFrame:
    """Letters of transcripts, without page numbers, running dates, signatures and footnotes."""
    page = _text("1 .\nErster |Brief\n17\n3. Mai 1821.\n2 *\n", F.col("n_name"), "\n* ) Anmerkung\nFuß\n---- Seite 2\nmehr\n2 .\nZweiter ", F.col("n_nationkey"))
    return texts.split_letters(texts.corpus_pages(Corpus(spark, d).table("nation").select(F.col("n_nationkey").alias("id"), page.alias("text"))))


@query(sql="SELECT n_nationkey AS id, kind, CAST(n AS INTEGER) AS n, CASE kind WHEN 'head' THEN '## Brief ' || n || chr(10) || n_name || CASE n WHEN 1 THEN chr(10) ELSE '' END ELSE n_name || n END AS block FROM nation, (VALUES (1), (2)) t(n), (VALUES ('head'), ('hash')) u(kind)")
def text_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Blocks that begin with a heading, and parts between marks."""
    rows = Corpus(spark, d).table("nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    number = F.row_number().over(Window.partitionBy("id").orderBy("position")).alias("n")
    head = texts.headed_blocks(rows.select("id", _text("vor\n## Brief 1\n", F.col("name"), "\n## Brief 2\n", F.col("name")).alias("text"))).select("id", F.lit("head").alias("kind"), number, "block")
    part = texts.hash_blocks(rows.select("id", _text("# ", F.col("name"), "1 ## ", F.col("name"), "2").alias("text"))).select("id", F.lit("hash").alias("kind"), number, "block")
    return head.unionByName(part)


@query(sql="SELECT s_suppkey AS gnd_id, CASE WHEN s_suppkey % 5 <> 0 THEN s_name END AS name, CASE WHEN s_suppkey % 5 <> 0 THEN 'female' END AS gender, CASE WHEN s_suppkey % 5 <> 0 THEN '17' || (s_suppkey % 90 + 10) END AS birth, CASE WHEN s_suppkey % 5 <> 0 THEN 'Dichterin|o' || s_suppkey END AS occupations, CAST(CASE WHEN s_suppkey % 5 <> 0 THEN 2 ELSE 0 END AS INTEGER) AS publications FROM supplier")
def authority_records(spark: SparkSession, d: str) -> DataFrame:
    """Cached authority records; every fifth is no JSON."""
    k = F.col("s_suppkey")
    json = _text('{"preferredName":"', F.col("s_name"), '","gender":[{"id":"https://d/g#female"}],"dateOfBirth":["17', k % 90 + 10, '"],"professionOrOccupation":[{"id":"i","label":"Dichterin"},{"id":"j","label":"o', k, '"}],"publication":[{"title":"a"},{"title":"b"}]}')
    found = texts.authority_records(Corpus(spark, d).table("supplier").select(k.alias("gnd_id"), F.when(k % 5 == 0, "no json").otherwise(json).alias("json")))
    return found.select("gnd_id", "name", "gender", "birth", F.array_join("occupations", "|").alias("occupations"), "publications")


def _folder(spark: SparkSession) -> str:
    """A fresh folder where driver and executors share one."""
    return f"{(spark.conf.get('spark.checkpoint.dir', None) or tempfile.gettempdir()).rstrip('/')}/quillgraph/query-{uuid.uuid4().hex}"


@query("letters", sql="SELECT id, date, sender FROM letters")
def letters_json(spark: SparkSession, d: str) -> DataFrame:
    """Letters written as JSON lines and read with their schema."""
    path = _folder(spark)
    sinks.write_json(Corpus(spark, d).letters.select("id", "date", "sender"), path)
    return texts.letters_json(spark, path, "id long, date string, sender string")


@query(sql="SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN CAST(c_nationkey AS VARCHAR) ELSE '' END AS place FROM customer")
def register_table(spark: SparkSession, d: str) -> DataFrame:
    """A register table; missing values are empty text."""
    path = _folder(spark)
    Corpus(spark, d).table("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_nationkey")).alias("place")).write.csv(path, sep=";", header=True)
    return texts.register_csv(spark, path)


@query(sql="SELECT n_nationkey AS id, CASE n_nationkey % 3 WHEN 0 THEN NULL ELSE 'item ' || i END AS item FROM nation, range(1, 3) t(i) WHERE n_nationkey % 3 <> 0 AND (i = 1 OR n_nationkey % 3 = 2) UNION ALL SELECT n_nationkey, NULL FROM nation WHERE n_nationkey % 3 = 0")
def unwound_elements(spark: SparkSession, d: str) -> DataFrame:
    """Elements of an XML file with a row for each of their children; those without any are one row."""
    path, k = _folder(spark), F.col("n_nationkey")
    one, two = "<item>item 1</item>", "<item>item 2</item>"
    row = _text("<row><id>", k, "</id>", F.when(k % 3 > 0, one).otherwise(""), F.when(k % 3 == 2, two).otherwise(""), "</row>")
    sinks.write_lines(Corpus(spark, d).table("nation").agg(_text("<rows>", F.array_join(F.collect_list(row), ""), "</rows>").alias("value")), path)
    return texts.unwound_xml(spark, path, "row", "id long, item array<string>", "item")


@query("letters", sql="SELECT CAST(count(*) AS BIGINT) AS statements, 500 AS most FROM (SELECT 1 FROM letters WHERE sender IS NOT NULL)")
def transaction_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Every statement is in one transaction, and none has more than its size."""
    letters = Corpus(spark, d).letters.where("sender is not null")
    statements = letters.select(F.lit(2).alias("stage"), F.col("id").cast("string").alias("key"), _text("MATCH (a {id: '", F.col("id"), "'})").alias("statement"))
    done = sinks.batches(statements, 500)
    return done.agg(F.sum("statements").cast("long").alias("statements"), F.when(F.max("statements") <= 500, 500).alias("most"))


@query(sql="SELECT n_nationkey AS id, 'MERGE (n:Person {id: ''' || n_nationkey || '''}) SET n.label = ''O\\''' || n_name || ''', n.corporate_body = ' || CASE WHEN n_nationkey % 2 = 0 THEN 'true' ELSE 'false' END || ', n.occupation = [''a'', ''b\\\\' || n_nationkey || ''']' AS statement FROM nation")
def cypher_nodes(spark: SparkSession, d: str) -> DataFrame:
    """K3, K4: quoted text, truth values and lists in statements."""
    k = F.col("id")
    rows = Corpus(spark, d).table("nation").select(F.col("n_nationkey").alias("id"), _text("O'", F.col("n_name")).alias("label"))
    props = {"label": (F.col("label"), "string"), "corporate_body": (k % 2 == 0, "bool"), "gnd": (F.lit(None).cast("string"), "string"), "occupation": (F.array(F.lit("a"), _text("b\\", k)), "list")}
    return sinks.node_statements(rows, "Person", props).select(F.col("key").cast("long").alias("id"), "statement")


# Records of letters in full


def _letter_records(c: Corpus) -> DataFrame:
    """Letters as records with all the fields that a register and files give, and with gaps."""
    k = F.col("id")
    filled = lambda name, n: F.when(k % n == 0, _text(f"{name} ", k)).alias(name)
    web = lambda name, n: F.when(k % n == 0, _text(f"https://{name}.org/", k)).alias(name)
    meta = F.struct(filled("harris_number", 2), filled("journal_number", 3), filled("repository_place", 2), filled("repository_institution", 5), filled("signature", 2), web("facsimile_url", 3), filled("published_in", 4), filled("comment", 7), web("iiif_manifest", 2), web("iiif_canvas", 9), web("published_in_url", 4))
    none, has = F.lit(None).cast("string"), k % 3 == 0
    action = lambda person, place, date: F.struct(person.alias("person"), place.alias("place"), date.alias("date"), S.date_precision(date).alias("date_precision"))
    return c.letters.select(
        "id", F.when(has, _text("data/letters/", k, ".xml")).alias("file"), has.alias("has_fulltext"), F.when(has, "published").otherwise("register-only").alias("status"),
        action(F.col("sender"), F.when(k % 4 != 0, F.col("place")), F.when(k % 5 != 0, F.col("date"))).alias("sent"), action(F.col("recipient"), F.when(k % 4 == 0, F.col("place")), F.when(k % 5 == 0, F.substring("date", 1, 7))).alias("received"),
        F.when(has, _text("Text ", k)).alias("text"), F.when(has, _text("Text ", k)).alias("incipit"), F.lit("de").alias("lang"), "publication_status", meta.alias("register_meta"), none.alias("sha256"),
    )


_META = {"harris_number": 2, "journal_number": 3, "repository_place": 2, "repository_institution": 5, "signature": 2, "published_in": 4, "comment": 7}
_WEB = {"facsimile_url": 3, "iiif_manifest": 2, "iiif_canvas": 9, "published_in_url": 4}
_META_SQL = {**{f: f"CASE WHEN id % {n} = 0 THEN '{f} ' || id END" for f, n in _META.items()}, **{f: f"CASE WHEN id % {n} = 0 THEN 'https://{f}.org/' || id END" for f, n in _WEB.items()}}


@query("letters", sql="SELECT id, CASE WHEN id % 5 = 0 THEN substr(date, 1, 7) ELSE date END AS date, CASE WHEN id % 5 = 0 THEN 'month' ELSE 'day' END AS date_precision, CASE WHEN id % 3 = 0 THEN 'Text ' || id END AS incipit, CASE WHEN id % 3 = 0 THEN 'Text ' || id END AS text, CASE WHEN id % 3 = 0 THEN 'data/letters/' || id || '.xml' END AS file, id % 3 = 0 AS has_fulltext, CASE WHEN id % 3 = 0 THEN 'published' ELSE 'register-only' END AS status, 'de' AS lang, publication_status, " + ", ".join(f"{x} AS {f}" for f, x in _META_SQL.items()) + " FROM letters")
def letter_properties(spark: SparkSession, d: str) -> DataFrame:
    """Every property of a letter."""
    return records.with_properties(_letter_records(Corpus(spark, d)), records.letter_properties())


_BASE, _VOC = "https://example.org/", "https://example.org/vocabulary#"
_PREDICATES = {"harris_number": f"{_VOC}harrisNumber", "journal_number": f"{_VOC}journalNumber", "repository_place": f"{_VOC}repositoryPlace", "repository_institution": f"{_VOC}repositoryInstitution", "signature": f"{sinks.DCTERMS}identifier", "published_in": f"{sinks.DCTERMS}bibliographicCitation", "comment": f"{sinks.RDFS}comment", "published_in_url": f"{sinks.DCTERMS}source", "facsimile_url": f"{_VOC}facsimileUrl", "iiif_manifest": f"{_VOC}iiifManifest", "iiif_canvas": f"{_VOC}iiifCanvas"}


@query("letters", sql="SELECT 'https://example.org/letter/' || id AS s, p, o, kind AS o_kind FROM (SELECT id, unnest([" + ", ".join(f"{{'p': '{p}', 'o': {o}, 'kind': '{kind}'}}" for p, o, kind in [
    (f"{sinks.SCHEMA}abstract", "CASE WHEN id % 3 = 0 THEN 'Text ' || id END", "literal"), (f"{sinks.SCHEMA}text", "CASE WHEN id % 3 = 0 THEN 'Text ' || id END", "literal"), (f"{sinks.SCHEMA}inLanguage", "'de'", "literal"),
    (f"{_VOC}publicationStatus", "publication_status", "literal"), (f"{_VOC}reviewStatus", "CASE WHEN id % 3 = 0 THEN 'published' ELSE 'register-only' END", "literal"), (f"{_VOC}hasFulltext", "CASE WHEN id % 3 = 0 THEN 'true' ELSE 'false' END", "literal"),
    *[(p, _META_SQL[f], "uri" if f in _WEB else "literal") for f, p in _PREDICATES.items()],
]) + "], recursive := true) FROM letters) WHERE o IS NOT NULL")
def letter_metadata_triples(spark: SparkSession, d: str) -> DataFrame:
    """K6: flat facts of letters."""
    return sinks.letter_metadata_triples(_letter_records(Corpus(spark, d)), _BASE, _VOC).select("s", "p", "o", "o_kind")


@query(sql=f"""SELECT s, p, o FROM (SELECT 'https://example.org/person/p' || n_nationkey AS s, unnest([
    {{'p': '{sinks.RDF}type', 'o': '{sinks.CSVOC}' || CASE n_nationkey % 3 WHEN 0 THEN 'Institution' WHEN 1 THEN 'Group' ELSE 'Person' END}}, {{'p': '{sinks.RDFS}label', 'o': n_name}},
    {{'p': '{sinks.OWL}sameAs', 'o': 'https://d-nb.info/gnd/' || n_nationkey}}, {{'p': '{sinks.RDFS}seeAlso', 'o': CASE WHEN n_nationkey % 2 = 0 THEN 'http://e.org/' || n_nationkey END}},
    {{'p': '{_VOC}personType', 'o': 'historical'}}, {{'p': '{sinks.SCHEMA}gender', 'o': 'female'}}, {{'p': '{sinks.SCHEMA}jobTitle', 'o': 'a' || n_nationkey}}, {{'p': '{sinks.SCHEMA}jobTitle', 'o': 'b'}}, {{'p': '{sinks.SCHEMA}birthDate', 'o': '1790'}}], recursive := true) FROM nation
  UNION ALL SELECT 'https://example.org/work/w' || p_partkey, unnest([{{'p': '{sinks.RDF}type', 'o': '{sinks.SCHEMA}CreativeWork'}}, {{'p': '{sinks.RDFS}label', 'o': p_name}}, {{'p': '{_VOC}litType', 'o': p_type}}, {{'p': '{sinks.DCTERMS}identifier', 'o': 'vd18:' || p_partkey}},
    {{'p': '{sinks.SCHEMA}author', 'o': CASE WHEN p_partkey % 2 = 0 THEN 'https://example.org/person/p' || p_partkey % 25 ELSE p_brand END}}], recursive := true) FROM part
  UNION ALL SELECT 'https://example.org/witness/x' || n_nationkey, unnest([{{'p': '{sinks.RDF}type', 'o': '{sinks.SCHEMA}CreativeWork'}}, {{'p': '{sinks.RDFS}label', 'o': 'Hs. ' || n_nationkey}}, {{'p': '{sinks.DCTERMS}identifier', 'o': 'Hs. ' || n_nationkey}}, {{'p': '{sinks.SCHEMA}exampleOfWork', 'o': 'https://example.org/work/w' || n_nationkey}}], recursive := true) FROM nation) WHERE o IS NOT NULL""")
def entity_triples(spark: SparkSession, d: str) -> DataFrame:
    """Persons, works and witnesses of the register, and what relates them."""
    c, k, q, none = Corpus(spark, d), F.col("n_nationkey"), F.col("p_partkey"), F.lit(None).cast("string")
    empty = F.expr("cast(array() as array<string>)")
    norm = F.struct(_text("https://d-nb.info/gnd/", k).alias("gnd"), none.alias("wikidata"), F.when(k % 2 == 0, _text("http://e.org/", k)).alias("other"))
    persons = c.table("nation").select(_text("p", k).alias("id"), F.when(k % 3 == 1, "personGrp").otherwise("person").alias("kind"), F.col("n_name").alias("label"), F.lit("historical").alias("person_type"), F.lit("female").alias("gender"), (k % 3 == 0).alias("corporate_body"), norm.alias("normdaten"), F.array(_text("a", k), F.lit(""), F.lit("b")).alias("occupation"), empty.alias("education"), F.lit("1790").alias("birth"), none.alias("death"))
    author = F.struct(F.when(q % 2 == 0, _text("p", q % 25)).otherwise("").alias("key"), F.col("p_brand").alias("label"))
    works = c.table("part").select(_text("w", q).alias("id"), F.col("p_name").alias("label"), F.col("p_type").alias("lit_type"), none.alias("ana"), author.alias("author"), F.struct(none.alias("key"), none.alias("label")).alias("pub_place"), none.alias("date"), F.array(F.struct(F.lit("vd18").alias("type"), q.cast("string").alias("value"))).alias("idno"))
    witnesses = c.table("nation").select(_text("x", k).alias("id"), none.alias("witness_type"), _text("w", k).alias("corresp"), none.alias("settlement"), F.lit("").alias("repository"), _text("Hs. ", k).alias("signature"), none.alias("note"))
    every = sinks.person_triples(persons, _BASE, _VOC).unionByName(sinks.work_triples(works, _BASE, _VOC)).unionByName(sinks.witness_triples(witnesses, _BASE, _VOC)).unionByName(sinks.relation_triples(works, witnesses, _BASE))
    return every.select("s", "p", "o")


@query("letters", sql="SELECT count(*) AS lines, count(*) FILTER (id % 3 = 0) AS texts FROM letters")
def ntriples_file(spark: SparkSession, d: str) -> DataFrame:
    """K8: triples written as lines and read back; as many lines as triples."""
    path = _folder(spark)
    rows = sinks.letter_metadata_triples(_letter_records(Corpus(spark, d)), _BASE, _VOC).where(F.col("p").isin(f"{_VOC}reviewStatus", f"{sinks.SCHEMA}text"))
    sinks.write_ntriples(rows, path)
    lines = spark.read.text(path)
    return lines.agg(F.count_if(F.contains("value", F.lit("reviewStatus"))).alias("lines"), F.count_if(F.contains("value", F.lit("schema.org/text>"))).alias("texts"))


@query("letters", "places", "partners", sql="""SELECT count(*) AS letters, count(*) FILTER (id % 3 = 0) AS fulltext FROM letters""")
def fulltext_totals(spark: SparkSession, d: str) -> DataFrame:
    """Letters with a text; counted, and filtered."""
    c = Corpus(spark, d)
    full = _letter_records(c)
    letters = c.letters.withColumn("has_fulltext", F.col("id") % 3 == 0)
    counted = overview.totals(letters, c.places, "person-0").select("letters", "fulltext")
    kept = texts.fulltext_letters(full).agg(F.count("*").alias("kept"))
    return counted.join(kept, F.col("fulltext") == F.col("kept")).select("letters", "fulltext")


@query("letters", sql="SELECT 'years' AS part, count(DISTINCT substr(date, 1, 4)) AS lines FROM letters UNION ALL SELECT 'totals', 1 UNION ALL SELECT 'places', count(*) FROM nation WHERE n_nationkey % 5 <> 0 AND 'place-' || n_nationkey IN (SELECT place FROM letters)")
def overview_document(spark: SparkSession, d: str) -> DataFrame:
    """The overview as JSON lines, part by part."""
    c = Corpus(spark, d)
    whole = overview.document({"totals": overview.totals(c.letters, c.places, "person-0"), "places": overview.sending_places(c.letters, c.places)}, {"years": (overview.timeline(c.letters), "year", "letters")})
    return whole.where(F.from_json("value", "map<string,string>").isNotNull()).groupBy("part").agg(F.count("*").alias("lines"))


@query("letters", "persons", "places", sql="""SELECT CAST(part AS INTEGER) AS part, count(*) AS n FROM (SELECT 0 AS part UNION ALL SELECT 1 FROM letters UNION ALL SELECT 2) GROUP BY 1""")
def cmif_whole(spark: SparkSession, d: str) -> DataFrame:
    """K7: the whole document: what stands before, the letters, what stands after."""
    c = Corpus(spark, d)
    return sinks.cmif_document(sinks.cmif(c.letters, c.persons, c.places), "Letters & more").groupBy("part").agg(F.count("*").alias("n"))


@query(sql="""SELECT c_custkey AS id, '<correspDesc key="' || c_custkey || '" ref="data/' || c_custkey || '.xml" change="in_register"><correspAction type="sent"><persName key="p' || c_nationkey || '">Hans M' || c_custkey || '</persName><placeName key="o' || c_nationkey || '" ana="1.5, 2">Ort &amp; Stadt</placeName><date when="1825">1825</date></correspAction><correspAction type="received"><persName key="h">Hub</persName></correspAction><note type="signatur">Hs. ' || c_custkey || '</note><note type="published_in"' || CASE WHEN c_custkey % 2 = 0 THEN ' target="http://x.org"' ELSE '' END || '>Band</note></correspDesc>' AS value FROM customer""")
def register_conversion(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a register table as entries with links, dates, status and notes."""
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    rows = Corpus(spark, d).table("customer").select(k.alias("id"), _text("p", n).alias("sender_id"), _text("HansM", k, "-").alias("sender"), F.lit("h").alias("recipient_id"), F.lit("Hub").alias("recipient"), _text("o", n).alias("place_id"), F.lit("Ort & Stadt").alias("place"), F.lit("1.5, 2").alias("place_geo"), F.lit("1825").alias("date"), _text("Hs. ", k).alias("signatur"), F.lit("Band").alias("published_in"), F.when(k % 2 == 0, "http://x.org").alias("published_in_url"))
    return sinks.register_entries(rows, "data/", ["signatur", "published_in"])


# An edition in files


def _edition(spark: SparkSession, d: str) -> tei.Edition:
    """Writes an edition with a letter for each nation: registers and files on the shared file system, bounded by the table's 25 rows."""
    root, jvm = _folder(spark), spark.sparkContext._jvm
    c = Corpus(spark, d)
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()

    def put(name: str, content: bytes) -> None:
        at = jvm.org.apache.hadoop.fs.Path(f"{root}/data/{name}")
        out = at.getFileSystem(hadoop).create(at)
        out.write(content)
        out.close()

    k = F.col("n_nationkey")
    key = lambda x: F.lpad(x.cast("string"), 4, "0")
    row = _text('<correspDesc key="ed-letter-', key(k), '" change="online_print"><correspAction type="sent"><persName key="ed-correspondent-0001"/><date when="1825-02-01"/></correspAction><correspAction type="received"><persName key="ed-correspondent-0002"/><placeName key="ed-place-', k, '"/></correspAction></correspDesc>')
    registers = [_persons_file(c), _places_file(c), _register(c.table("nation").where(k % 4 != 0), row, "ed-letters"), _register(c.table("part").where("p_partkey <= 20"), _text('<bibl xml:id="ed-literature-', F.col("p_partkey"), '"><author key="">A</author><title>', F.col("p_name"), "</title></bibl>"), "ed-literature"), _witnesses_file(c)]
    for df in registers:
        for path, content in df.select("path", "content").collect():
            put(f"register/{path.rpartition('/')[2]}", bytes(content))
    letter = _text(f'<TEI {NS}><teiHeader><profileDesc><correspDesc><correspAction type="sent"><persName key="x#ed-correspondent-0003"/></correspAction></correspDesc></profileDesc></teiHeader><text><body><div type="print">Text ', k, "</div></body></text></TEI>")
    for number, content in c.table("nation").where(k % 2 == 0).select(key(k), letter).collect():
        put(f"letters/ed-letter-{number}.xml", content.encode())
    put("letters/ed-letter-0001_old.xml", b"<TEI/>")
    return tei.Edition(spark, root, "ed")


@query(sql="""SELECT 'ed-letter-' || lpad(CAST(n_nationkey AS VARCHAR), 4, '0') AS id, n_nationkey % 2 = 0 AS has_fulltext, CASE WHEN n_nationkey % 2 = 0 THEN 'Text ' || n_nationkey END AS text, CASE WHEN n_nationkey % 2 = 0 THEN 'draft' ELSE 'register-only' END AS status,
  CASE WHEN n_nationkey % 2 = 0 THEN 'ed-correspondent-0003' ELSE 'ed-correspondent-0001' END AS sender, 'ed-correspondent-0002' AS recipient, 'ed-place-' || n_nationkey AS place FROM nation WHERE n_nationkey % 4 <> 0""")
def edition_letters(spark: SparkSession, d: str) -> DataFrame:
    """Register rows with what their files say; files without a row aren't letters, old ones aren't read."""
    found = _edition(spark, d).letters()
    return found.select("id", "has_fulltext", "text", "status", F.col("sent.person").alias("sender"), F.col("received.person").alias("recipient"), S.effective(F.col("sent.place"), F.col("received.place")).alias("place"))


@query(sql="SELECT 'data/letters/ed-letter-' || lpad(CAST(n_nationkey AS VARCHAR), 4, '0') || '.xml' AS path, 64 AS size FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT 'data/register/ed-' || n || '.xml', 64 FROM (VALUES ('persons'), ('places'), ('literature'), ('manuscripts'), ('letters')) t(n)")
def edition_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Paths and hashes of what an edition is made from."""
    return _edition(spark, d).manifest().select("path", F.length("sha256").alias("size"))


@query(sql="""SELECT kind, count(*) AS n FROM (SELECT 'person' AS kind FROM nation WHERE n_nationkey % 5 <> 3 UNION ALL SELECT 'place' FROM nation WHERE n_nationkey % 4 <> 3 UNION ALL SELECT 'work' FROM part WHERE p_partkey <= 20 UNION ALL SELECT 'witness' FROM nation) GROUP BY 1""")
def edition_entities(spark: SparkSession, d: str) -> DataFrame:
    """All registers in one."""
    return _edition(spark, d).entities().groupBy("kind").agg(F.count("*").alias("n"))


@query(sql="SELECT 'ed-correspondent-' || lpad(CAST(n_nationkey AS VARCHAR), 4, '0') AS entity, 'person' AS kind, 'Name ' || n_name AS label FROM nation WHERE n_nationkey % 5 NOT IN (3, 4) UNION ALL SELECT 'ed-place-' || n_nationkey, 'place', n_name FROM nation WHERE n_nationkey % 4 <> 3 UNION ALL SELECT 'ed-literature-' || p_partkey, 'bibl', 'A ' || p_name FROM part WHERE p_partkey <= 20")
def edition_bank(spark: SparkSession, d: str) -> DataFrame:
    """What mentions are linked with."""
    return _edition(spark, d).bank().select("entity", "kind", "label")


# Declarative queries


_VIEWS = ("letters", "persons", "places", "works", "mention_rows", "edges", "nodes")


def _graph(c: Corpus) -> tuple[DataFrame, DataFrame]:
    return graph.build_nodes(c.letters, {"Person": c.persons, "Place": c.places, "Work": c.works}), graph.build_edges(c.letters, c.mention_rows)


@query(*_VIEWS, sql="SELECT e.type AS kind, ['Letter'] AS labels, count(*) AS n FROM edges e JOIN nodes l ON source = l.key WHERE l.type = 'Letter' AND l.date >= '1996' AND l.date < '1997' AND starts_with(target, 'person-1') GROUP BY e.type")
def cypher_where(spark: SparkSession, d: str) -> DataFrame:
    """§2.14: conditions, labels and types of edges."""
    return patterns.cypher(*_graph(Corpus(spark, d)), "MATCH (l:Letter)-[r]->(p:Person) WHERE l.date >= '1996' AND l.date < '1997' AND p.id STARTS WITH 'person-1' RETURN type(r) AS kind, labels(l) AS labels, count(*) AS n")


@query(*_VIEWS, sql="SELECT target AS x, count(*) AS n FROM edges WHERE type = 'MENTIONS' AND target IN ('work-7', 'work-8') GROUP BY 1")
def cypher_unwind(spark: SparkSession, d: str) -> DataFrame:
    """§2.14: a list of values, each matched."""
    return patterns.cypher(*_graph(Corpus(spark, d)), "UNWIND ['work-7', 'work-8', 'nothing'] AS x MATCH (w:Work {id: x})<-[:MENTIONS]-(l:Letter) RETURN x, count(*) AS n")


@query("letters", "mention_rows", "edges", "ego", sql="SELECT key, CAST(depth AS INTEGER) AS depth FROM (SELECT 'work-7' AS key, 0 AS depth UNION ALL SELECT key, 1 FROM d1 UNION ALL SELECT key, 2 FROM d2)")
def ego_function(spark: SparkSession, d: str) -> DataFrame:
    """§2.13: the neighbourhood of a node as a table function."""
    from quillgraph.plans import sql

    graph.build_edges(Corpus(spark, d).letters, Corpus(spark, d).mention_rows).createOrReplaceTempView("ego_edges_of_letters")
    sql.register(spark, "ego_edges_of_letters")
    return spark.sql("SELECT key, depth FROM ego_network('work-7', 2)")


@query("letters", "context", sql="SELECT letter, other, CAST(abs(date_diff('day', CAST(substr(a.date, 1, 7) || '-01' AS DATE), CAST(substr(b.date, 1, 7) || '-01' AS DATE))) AS INTEGER) AS days_apart FROM (SELECT x.id AS letter, y.id AS other FROM letters x JOIN letters y ON least(x.sender, x.recipient) = least(y.sender, y.recipient) AND greatest(x.sender, x.recipient) = greatest(y.sender, y.recipient) AND x.id <> y.id WHERE x.recipient IS NOT NULL AND y.recipient IS NOT NULL) JOIN letters a ON letter = a.id JOIN letters b ON other = b.id WHERE abs(date_diff('day', CAST(substr(a.date, 1, 7) || '-01' AS DATE), CAST(substr(b.date, 1, 7) || '-01' AS DATE))) <= 20")
def partial_date_context(spark: SparkSession, d: str) -> DataFrame:
    """G4 (Q2): dates of months stand for their first day."""
    letters = Corpus(spark, d).letters.withColumn("date", F.substring("date", 1, 7))
    return graph.correspondence_context(letters, days=20, partial_dates=True)
