"""Sinks: JSON lines, graph scripts, triples, correspondence metadata, search index.  Everything is written by executors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions import scalars as S
from quillgraph.sources import schemas as M

CSVOC = "https://lod.academy/correspsearch/vocab/terms#"
SCHEMA = "http://schema.org/"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
DCTERMS = "http://purl.org/dc/terms/"
XSD = "http://www.w3.org/2001/XMLSchema#"


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object per line, without null fields."""
    df.write.mode(mode).option("ignoreNullFields", "true").json(path)


def write_lines(df: DataFrame, path: str, column: str = "value", mode: str = "overwrite") -> None:
    df.select(F.col(column).alias("value")).write.mode(mode).text(path)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K2: nodes and edges as tables; edges in folders by type, so a query of one type reads only its own."""
    nodes.write.mode(mode).parquet(f"{path}/nodes")
    edges.write.mode(mode).partitionBy("type").parquet(f"{path}/edges")


def graph_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """K2: one JSON line per node or edge, as graph viewers take them."""
    n = nodes.select(F.lit("node").alias("part"), F.to_json(F.struct("key", F.struct("type", "label", "date").alias("attributes"))).alias("value"))
    e = edges.select(F.lit("edge").alias("part"), F.to_json(F.struct("source", "target", F.struct("type").alias("attributes"))).alias("value"))
    return n.unionByName(e)


def write_vectors(chunks: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K9: quantized vectors, and one row with what they are scaled by."""
    from quillgraph.functions.vectors import quantize, range_arrays

    quantize(chunks, "v").select("chunk_id", "letter_id", "chunk_index", "q").write.mode(mode).parquet(f"{path}/vectors")
    range_arrays(chunks, "v").write.mode(mode).parquet(f"{path}/ranges")


def letters_index(letters: DataFrame, persons: DataFrame) -> DataFrame:
    """What a list of hits shows of a letter; labels are null where the register has none."""
    names = persons.select("id", "label")
    s, r = names.select(F.col("id").alias("sender"), F.col("label").alias("sender_label")), names.select(F.col("id").alias("recipient"), F.col("label").alias("recipient_label"))
    return letters.join(s, "sender", "left").join(r, "recipient", "left").select("id", "date", "sender_label", "recipient_label", F.coalesce(F.col("publication_status").rlike(r"\A(online|preview)"), F.lit(False)).alias("has_page"), F.coalesce(F.col("publication_status").startswith("preview"), F.lit(False)).alias("preview"))


def set_clause(var: str, props: dict[str, tuple[Column, str]]) -> Column:
    """Assignments of the properties that aren't null; kinds are string, list, or anything bare."""
    parts = [F.when(c.isNotNull(), F.concat(F.lit(f"{var}.{name} = "), S.cypher_list(c) if kind == "list" else S.cypher_literal(c, kind))) for name, (c, kind) in props.items()]
    joined = F.concat_ws(", ", *parts)
    return F.when(joined == "", F.lit("")).otherwise(F.concat(F.lit("SET "), joined))


def node_statements(df: DataFrame, label: str, props: dict[str, tuple[Column, str]]) -> DataFrame:
    """K3: a statement per entity (id): merge the node, set its properties."""
    return df.select(F.lit(1).alias("stage"), F.col("id").cast("string").alias("key"), F.rtrim(F.concat(F.lit(f"MERGE (n:{label} {{id: "), S.cypher_literal(F.col("id").cast("string")), F.lit("}) "), set_clause("n", props))).alias("statement"))


def edge_statements(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """K3: a statement per edge whose ends are nodes; ends are matched by label and id."""
    kind = nodes.select("key", F.col("type").alias("t"))
    e = edges.join(kind.select(F.col("key").alias("source"), F.col("t").alias("st")), "source").join(kind.select(F.col("key").alias("target"), F.col("t").alias("tt")), "target")
    q = lambda c: S.cypher_literal(F.col(c))
    text = F.concat(F.lit("MATCH (a:"), "st", F.lit(" {id: "), q("source"), F.lit("}), (b:"), "tt", F.lit(" {id: "), q("target"), F.lit("}) MERGE (a)-[:"), "type", F.lit("]->(b)"))
    return e.select(F.lit(2).alias("stage"), F.concat_ws(">", "source", "type", "target").alias("key"), text.alias("statement"))


def constraint_statements() -> list[str]:
    """K3: one id per node of each label."""
    return [f"CREATE CONSTRAINT {x.lower()}_id IF NOT EXISTS FOR (n:{x}) REQUIRE n.id IS UNIQUE;" for x in M.NODE_LABELS]


def batches(statements: DataFrame, size: int = 500) -> DataFrame:
    """Statements in transactions of ``size`` (batch, value), each ended.

    Statements are numbered inside folders of a hash, so no task has to see them all; a folder's last batch may be short.
    """
    folders = max(1, -(-statements.count() // (64 * size)))  # some sixty-four transactions to a folder
    f = F.pmod(F.xxhash64("key"), F.lit(folders)).cast("int")
    n = F.row_number().over(Window.partitionBy("stage", "folder").orderBy("key", "statement"))
    numbered = statements.withColumn("folder", f).withColumn("n", n).withColumn("part", F.floor((F.col("n") - 1) / size))
    by = numbered.groupBy("stage", "folder", "part").agg(F.array_sort(F.collect_list(F.struct("n", "statement"))).alias("s"))
    body = F.array_join(F.transform("s", lambda x: F.concat(x["statement"], F.lit(";"))), "\n")
    return by.select("stage", "folder", "part", F.size("s").alias("statements"), F.concat(F.lit(":begin\n"), body, F.lit("\n:commit")).alias("value"))


TRIPLE = ("s", "p", "o", "o_kind", "o_type")


def triple(df: DataFrame, s: Column, p: str, o: Column, kind: str = "literal", o_type: Column | None = None) -> DataFrame:
    """Triples of the rows whose object is there.  ``kind``: uri, literal or bnode."""
    return df.select(s.alias("s"), F.lit(p).alias("p"), o.cast("string").alias("o"), F.lit(kind).alias("o_kind"), (o_type if o_type is not None else F.lit(None)).cast("string").alias("o_type")).where("coalesce(o, '') <> ''")


def letter_triples(letters: DataFrame, base: str, one_pass: bool = False) -> DataFrame:
    """K6: a letter's sending, receiving and date; letters (id, sender, recipient, place, date).

    As a union, each kind of triple is a branch of its own, so that a pattern with a fixed predicate reads only its
    branch and the columns of that.  With ``one_pass``, letters are read once and give all their triples: for exports of letters that are dear to compute.
    """
    uri = S.entity_uri(base, F.lit("letter"), F.col("id").cast("string"))
    sent, received, date = F.concat(uri, F.lit("/sent")), F.concat(uri, F.lit("/received")), F.concat(uri, F.lit("/sent/date"))
    filled = lambda *cs: F.coalesce(*[S.blank_to_null(F.col(c)) for c in cs]).isNotNull()
    always, has_sent, dated, has_received = F.lit(True), filled("sender", "place", "date"), filled("date"), filled("recipient")
    ent = lambda kind, c: S.entity_uri(base, F.lit(kind), S.blank_to_null(F.col(c)))
    xsd = F.replace(S.rdf_date_type(F.col("date")), F.lit("xsd:"), F.lit(XSD))
    day = F.when(S.date_precision(F.col("date")) == "day", F.lit(f"{CSVOC}Day")).otherwise(F.lit(f"{CSVOC}ApproxTimespan"))
    term, none = (lambda x: F.lit(CSVOC + x)), F.lit(None).cast("string")
    # (condition, subject, predicate, object, kind, type)
    kinds = [
        (always, uri, f"{RDF}type", term("Letter"), "uri", none), (always, uri, f"{RDFS}label", F.col("id").cast("string"), "literal", none),
        (dated, uri, f"{SCHEMA}dateCreated", F.col("date"), "literal", none), (has_sent, uri, f"{CSVOC}hasCorrespAction", sent, "uri", none),
        (has_sent, sent, f"{RDF}type", term("correspAction"), "uri", none), (has_sent, sent, f"{RDF}type", term("Sent"), "uri", none),
        (filled("sender"), sent, f"{CSVOC}hasParticipant", ent("person", "sender"), "uri", none), (filled("place"), sent, f"{CSVOC}tookPlaceAt", ent("place", "place"), "uri", none),
        (dated, sent, f"{CSVOC}hasTimespan", date, "uri", none), (dated, date, f"{RDF}type", day, "uri", none), (dated, date, f"{CSVOC}startsOn", F.col("date"), "literal", xsd),
        (has_received, uri, f"{CSVOC}hasCorrespAction", received, "uri", none), (has_received, received, f"{RDF}type", term("correspAction"), "uri", none),
        (has_received, received, f"{RDF}type", term("Received"), "uri", none), (has_received, received, f"{CSVOC}hasParticipant", ent("person", "recipient"), "uri", none),
    ]
    if not one_pass:
        return reduce(DataFrame.unionByName, [triple(letters.where(c), s, p, o, kind, t) for c, s, p, o, kind, t in kinds])
    row = lambda s, p, o, kind, t: F.struct(s.alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit(kind).alias("o_kind"), t.alias("o_type"))
    return letters.select(F.explode(F.array_compact(F.array(*[F.when(k[0], row(*k[1:])) for k in kinds]))).alias("t")).select("t.*")


def mention_triples(mentions: DataFrame, base: str, kind: str) -> DataFrame:
    return triple(mentions, S.entity_uri(base, F.lit("letter"), F.col("letter_id").cast("string")), f"{CSVOC}mentions", S.entity_uri(base, F.lit(kind), F.col("entity_id")), "uri")


TRIPLE_KIND = "array<struct<s:string,p:string,o:string,o_kind:string,o_type:string>>"


def _one(s: Column, p: str, o: Column, kind: str = "literal", o_type: str | None = None) -> Column:
    """A list of one triple; of none if the object isn't there."""
    row = F.struct(s.alias("s"), F.lit(p).alias("p"), o.cast("string").alias("o"), F.lit(kind).alias("o_kind"), F.lit(o_type).cast("string").alias("o_type"))
    return F.when(F.coalesce(o.cast("string"), F.lit("")) != "", F.array(row)).otherwise(F.expr(f"cast(array() as {TRIPLE_KIND})"))


def _each(s: Column, p: str, os: Column) -> Column:
    """A triple for each filled entry of a list."""
    rows = F.transform(F.filter(os, lambda x: F.coalesce(x, F.lit("")) != ""), lambda x: F.struct(s.alias("s"), F.lit(p).alias("p"), x.alias("o"), F.lit("literal").alias("o_kind"), F.lit(None).cast("string").alias("o_type")))
    return F.coalesce(rows, F.expr(f"cast(array() as {TRIPLE_KIND})"))


def _exploded(df: DataFrame, *parts: Column) -> DataFrame:
    """All triples of each row, in one pass."""
    return df.select(F.explode(F.flatten(F.array(*parts))).alias("t")).select("t.*")


def _authorities(uri: Column) -> list[Column]:
    return [*(_one(uri, f"{OWL}sameAs", F.col(f"normdaten.{x}"), "uri") for x in ("gnd", "wikidata")), _one(uri, f"{RDFS}seeAlso", F.col("normdaten.other"), "uri")]


# Classes and predicates of the register's entries; `voc` is the edition's own vocabulary.
def person_triples(persons: DataFrame, base: str, voc: str) -> DataFrame:
    """K6: persons, groups and corporate bodies."""
    uri = S.entity_uri(base, F.lit("person"), F.col("id"))
    kind = F.when(F.col("corporate_body"), f"{CSVOC}Institution").when(F.col("kind") == "personGrp", f"{CSVOC}Group").otherwise(f"{CSVOC}Person")
    return _exploded(
        persons, _one(uri, f"{RDF}type", kind, "uri"), _one(uri, f"{RDFS}label", F.col("label")), *_authorities(uri), _one(uri, f"{voc}personType", F.col("person_type")), _one(uri, f"{SCHEMA}gender", F.col("gender")),
        _each(uri, f"{SCHEMA}jobTitle", F.col("occupation")), _each(uri, f"{voc}education", F.col("education")), _one(uri, f"{SCHEMA}birthDate", F.col("birth")), _one(uri, f"{SCHEMA}deathDate", F.col("death")),
    )


def place_triples(places: DataFrame, base: str) -> DataFrame:
    """K6: places; coordinates are a node of their own."""
    uri, geo = S.entity_uri(base, F.lit("place"), F.col("id")), F.when(F.col("coords").isNotNull(), F.concat(F.lit("_:geo-"), F.col("id")))
    return _exploded(
        places, _one(uri, f"{RDF}type", F.lit(f"{CSVOC}Place"), "uri"), _one(uri, f"{RDFS}label", F.col("label")), *_authorities(uri), _one(uri, f"{SCHEMA}description", F.col("desc")), _one(uri, f"{SCHEMA}geo", geo, "bnode"),
        _one(geo, f"{RDF}type", F.when(geo.isNotNull(), F.lit(f"{SCHEMA}GeoCoordinates")), "uri"), _one(geo, f"{SCHEMA}latitude", F.col("coords.lat"), "literal", f"{XSD}double"), _one(geo, f"{SCHEMA}longitude", F.col("coords.lon"), "literal", f"{XSD}double"),
    )


def work_triples(works: DataFrame, base: str, voc: str) -> DataFrame:
    """K6: works; an author or a place without a key is text, one with a key a relation."""
    uri = S.entity_uri(base, F.lit("work"), F.col("id"))
    text = lambda field: F.when(S.blank_to_null(F.col(f"{field}.key")).isNull(), F.col(f"{field}.label"))
    return _exploded(
        works, _one(uri, f"{RDF}type", F.lit(f"{SCHEMA}CreativeWork"), "uri"), _one(uri, f"{RDFS}label", F.col("label")), _one(uri, f"{voc}litType", F.col("lit_type")), _one(uri, f"{voc}ana", F.col("ana")), _one(uri, f"{SCHEMA}dateCreated", F.col("date")),
        _each(uri, f"{DCTERMS}identifier", S.flatten_idno(F.col("idno"))), _one(uri, f"{SCHEMA}author", text("author")), _one(uri, f"{SCHEMA}locationCreated", text("pub_place")),
    )


def witness_triples(witnesses: DataFrame, base: str, voc: str) -> DataFrame:
    """K6: witnesses of works."""
    uri = S.entity_uri(base, F.lit("witness"), F.col("id"))
    return _exploded(
        witnesses, _one(uri, f"{RDF}type", F.lit(f"{SCHEMA}CreativeWork"), "uri"), _one(uri, f"{RDFS}label", S.first_filled(F.col("repository"), F.col("signature"), F.col("id"))), _one(uri, f"{voc}witnessType", F.col("witness_type")), _one(uri, f"{voc}settlement", F.col("settlement")),
        _one(uri, f"{voc}repository", F.col("repository")), _one(uri, f"{DCTERMS}identifier", F.col("signature")), _one(uri, f"{SCHEMA}description", F.col("note")),
    )


# Predicates of the relations between entities.
RELATIONS = {"AUTHORED_BY": f"{SCHEMA}author", "PUBLISHED_AT": f"{SCHEMA}locationCreated", "WITNESS_OF": f"{SCHEMA}exampleOfWork"}


def relation_triples(works: DataFrame, witnesses: DataFrame, base: str) -> DataFrame:
    """Who wrote a work, where it was published, what a witness is a witness of."""
    end = lambda kind, key: F.when(S.blank_to_null(F.col(key)).isNotNull(), S.entity_uri(base, F.lit(kind), F.col(key)))
    work, witness = S.entity_uri(base, F.lit("work"), F.col("id")), S.entity_uri(base, F.lit("witness"), F.col("id"))
    of_works = _exploded(works, _one(work, RELATIONS["AUTHORED_BY"], end("person", "author.key"), "uri"), _one(work, RELATIONS["PUBLISHED_AT"], end("place", "pub_place.key"), "uri"))
    return of_works.unionByName(_exploded(witnesses, _one(witness, RELATIONS["WITNESS_OF"], end("work", "corresp"), "uri")))


# Predicates of what a letter record says of itself; web addresses are nodes.
def letter_metadata_triples(letters: DataFrame, base: str, voc: str) -> DataFrame:
    """K6: flat facts of letter records: texts, status, and the register's fields."""
    uri = S.entity_uri(base, F.lit("letter"), F.col("id").cast("string"))
    meta = lambda f: F.col(f"register_meta.{f}")
    text = {f"{SCHEMA}abstract": F.col("incipit"), f"{SCHEMA}text": F.col("text"), f"{SCHEMA}inLanguage": F.col("lang"), f"{voc}publicationStatus": F.col("publication_status"), f"{voc}reviewStatus": F.col("status"), f"{voc}harrisNumber": meta("harris_number"), f"{voc}journalNumber": meta("journal_number"), f"{voc}repositoryPlace": meta("repository_place"), f"{voc}repositoryInstitution": meta("repository_institution"), f"{DCTERMS}identifier": meta("signature"), f"{DCTERMS}bibliographicCitation": meta("published_in"), f"{RDFS}comment": meta("comment")}
    web = {f"{DCTERMS}source": meta("published_in_url"), f"{voc}facsimileUrl": meta("facsimile_url"), f"{voc}iiifManifest": meta("iiif_manifest"), f"{voc}iiifCanvas": meta("iiif_canvas")}
    return _exploded(letters, *[_one(uri, p, o) for p, o in text.items()], *[_one(uri, p, o, "uri") for p, o in web.items()], _one(uri, f"{voc}hasFulltext", F.col("has_fulltext"), "literal", f"{XSD}boolean"))


def ntriples(triples: DataFrame) -> DataFrame:
    """K6: distinct triples as N-Triples lines."""
    node = lambda c: F.when(c.startswith("_:"), c).otherwise(F.concat(F.lit("<"), c, F.lit(">")))
    text = reduce(lambda x, y: F.replace(x, F.lit(y[0]), F.lit(y[1])), [("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")], F.col("o"))
    literal = F.concat(F.lit('"'), text, F.lit('"'), F.coalesce(F.concat(F.lit("^^<"), "o_type", F.lit(">")), F.lit("")))
    line = F.concat(node(F.col("s")), F.lit(" <"), "p", F.lit("> "), F.when(F.col("o_kind") == "literal", literal).otherwise(node(F.col("o"))), F.lit(" ."))
    return triples.distinct().select(line.alias("value"))


def write_ntriples(triples: DataFrame, path: str, mode: str = "overwrite") -> int:
    """K6, K8: writes the lines, reads them back and returns how many there are; a different number is an error."""
    lines = ntriples(triples)
    write_lines(lines, path, mode=mode)
    there, wanted = triples.sparkSession.read.text(path).count(), triples.distinct().count()
    if there != wanted:
        raise ValueError(f"{wanted} triples, but {there} lines")
    return there


def xml_text(c: Column) -> Column:
    """Text as it stands in an element or attribute."""
    return reduce(lambda x, y: F.replace(x, F.lit(y[0]), F.lit(y[1])), [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")], F.coalesce(c.cast("string"), F.lit("")))


def element(name: str, attributes: dict[str, Column], text: Column | None = None) -> Column:
    """An element with the attributes that are filled; empty without text."""
    parts = [F.when(F.coalesce(c.cast("string"), F.lit("")) != "", F.concat(F.lit(f' {a}="'), xml_text(c), F.lit('"'))).otherwise(F.lit("")) for a, c in attributes.items()]
    head = F.concat(F.lit(f"<{name}"), *parts)
    return F.concat(head, F.lit("/>")) if text is None else F.concat(head, F.lit(">"), xml_text(text), F.lit(f"</{name}>"))


def cmif(letters: DataFrame, persons: DataFrame, places: DataFrame, base: str = "https://example.org/") -> DataFrame:
    """K7: (id, value): each letter (id, sender, recipient, place, date) as correspondence metadata.

    Persons and places are named where the register has them; a person's authority record if persons have ``gnd``.
    """
    gnd = F.col("gnd") if "gnd" in persons.columns else F.lit(None).cast("string")
    person = lambda role: persons.select(F.col("id").alias(role), F.struct(F.lit(True).alias("there"), "label", gnd.alias("gnd")).alias(f"{role}_entry"))
    place = places.select(F.col("id").alias("place"), F.struct(F.lit(True).alias("there"), "label").alias("place_entry"))
    rows = letters.join(person("sender"), "sender", "left").join(person("recipient"), "recipient", "left").join(place, "place", "left")
    named = lambda name, role: F.when(F.col(f"{role}_entry.there"), element(name, {"key": F.col(role), **({"ref": F.col(f"{role}_entry.gnd")} if name == "persName" else {})}, F.col(f"{role}_entry.label"))).otherwise(F.lit(""))
    date = F.when(S.blank_to_null(F.col("date")).isNotNull(), element("date", {"when": F.col("date")}, F.col("date"))).otherwise(F.lit(""))
    sent = F.concat(F.lit('<correspAction type="sent">'), named("persName", "sender"), named("placeName", "place"), date, F.lit("</correspAction>"))
    received = F.when(S.blank_to_null(F.col("recipient")).isNotNull(), F.concat(F.lit('<correspAction type="received">'), named("persName", "recipient"), F.lit("</correspAction>"))).otherwise(F.lit(""))
    key = F.col("id").cast("string")
    return rows.select("id", F.concat(F.lit('<correspDesc key="'), xml_text(key), F.lit('" ref="'), xml_text(F.concat(F.lit(f"{base}letter/"), key)), F.lit('">'), sent, received, F.lit("</correspDesc>")).alias("value"))


def document(entries: DataFrame, head: str, tail: str) -> DataFrame:
    """(part, id, value) in order: what stands before the entries (id, value), these by id, and what stands after."""
    one = lambda part, text: entries.sparkSession.range(1).select(F.lit(part).alias("part"), F.lit(None).cast(entries.schema["id"].dataType).alias("id"), F.lit(text).alias("value"))
    return one(0, head).unionByName(entries.select(F.lit(1).alias("part"), "id", "value")).unionByName(one(2, tail)).orderBy("part", "id")


def cmif_document(entries: DataFrame, title: str) -> DataFrame:
    """K7: the whole document.  Written with ``write_lines``, its files one after the other are the XML file."""
    escaped = title.replace("&", "&amp;").replace("<", "&lt;")
    head = f'<?xml version="1.0" encoding="UTF-8"?>\n<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><fileDesc><titleStmt><title>{escaped}</title></titleStmt></fileDesc><profileDesc>'
    return document(entries, head, "</profileDesc></teiHeader></TEI>")


def register_entries(rows: DataFrame, folder: str, notes: list[str], status: str = "in_register") -> DataFrame:
    """(id, value): rows of a register table as register entries.

    rows (id, sender_id, sender, recipient_id, recipient, place_id, place, date, and the notes); authority links are
    read from ``sender_ref``, ``recipient_ref``, ``place_ref`` and ``place_geo`` where the table has them.
    """
    there = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("string")
    person = lambda role: element("persName", {"key": F.col(f"{role}_id"), "ref": there(f"{role}_ref")}, S.split_camel(F.coalesce(F.col(role), F.lit(""))))
    place = element("placeName", {"key": F.col("place_id"), "ref": there("place_ref"), "ana": there("place_geo")}, F.col("place"))
    date = F.when(S.blank_to_null(F.col("date")).isNotNull(), element("date", {"when": F.col("date")}, F.col("date"))).otherwise(F.lit(""))
    target = {"published_in": there("published_in_url"), "url_facsimile": there("url_facsimile")}
    listed = [element("note", {"type": F.lit(n), **({"target": target[n]} if n in target else {})}, F.col(n)) for n in notes]
    key = F.col("id").cast("string")
    head = F.concat(F.lit('<correspDesc key="'), xml_text(key), F.lit('" ref="'), xml_text(F.concat(F.lit(folder), key, F.lit(".xml"))), F.lit(f'" change="{status}">'))
    return rows.select("id", F.concat(head, F.lit('<correspAction type="sent">'), person("sender"), place, date, F.lit('</correspAction><correspAction type="received">'), person("recipient"), F.lit("</correspAction>"), *listed, F.lit("</correspDesc>")).alias("value"))


def rag_json(letters: DataFrame, mentions: DataFrame) -> DataFrame:
    """(id, value): each letter as JSON for retrieval: where it is kept and printed, who wrote to whom and when, what it
    mentions by kind, and its texts.

    letters has id, sender, recipient, date and any of signature, printed, original, normalized, translated; mentions
    (letter_id, kind, label).  Fields that are null are left out.
    """
    of = lambda kind: F.array_sort(F.collect_set(F.when(F.col("kind") == kind, F.col("label")))).alias(kind)
    # Kinds of mentions, in the record's order.
    kinds = ("places", "persons", "literature")
    by = mentions.groupBy("letter_id").agg(F.struct(*[of(k) for k in kinds]).alias("mentioned"))
    none = F.struct(*[F.expr("cast(array() as array<string>)").alias(k) for k in kinds])
    joined = letters.join(by, letters.id == by.letter_id, "left")
    texts = [c for c in ("original", "normalized", "translated") if c in letters.columns]
    kept = [c for c in ("signature", "printed") if c in letters.columns]
    return joined.select("id", F.to_json(F.struct("id", *kept, "sender", "recipient", "date", F.coalesce("mentioned", none).alias("mentioned"), *texts)).alias("value"))


#: Characters that a prompt has room for.
PROMPT = 1 << 20


def lookup_string(entities: DataFrame, sep: str = "|", room: int = PROMPT) -> DataFrame:
    """(part, value): texts ``id;name|id;name`` in order of id, each of about ``room`` characters at most.

    A register that fits into one prompt is one row; a larger one is dealt by range of id to as many parts as it needs.
    """
    rows = entities.select("id", F.concat_ws(";", "id", S.norm_ws(F.col("label"))).alias("record"))
    size = rows.agg(F.coalesce(F.sum(F.length("record") + len(sep)), F.lit(0))).first()[0]
    parts = max(1, -(-size // room))
    dealt = rows.withColumn("part", F.lit(0)) if parts == 1 else rows.repartitionByRange(parts, "id").withColumn("part", F.spark_partition_id())
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "record"))), lambda x: x["record"]), sep)
    return dealt.groupBy("part").agg(joined.alias("value"))


def filled_template(rows: DataFrame, template: str, fields: list[str]) -> DataFrame:
    """A template with ``{field}`` put in; null is empty."""
    text = reduce(lambda t, f: F.replace(t, F.lit(f"{{{f}}}"), F.coalesce(F.col(f).cast("string"), F.lit(""))), fields, F.lit(template))
    return rows.withColumn("value", text)


def split_matched(rows: DataFrame, column: str = "match") -> tuple[DataFrame, DataFrame]:
    """What has been matched, and what hasn't."""
    return rows.where(F.col(column).isNotNull()), rows.where(F.col(column).isNull())
