"""TEI sources: registers and letters from XML files, PAGE-XML lines.

Files are read with Spark's binary source, one row per file, and parsed by a Python function over Arrow batches: mixed
content needs a tree walk that Spark's XML functions can't do.  A register is one file of a known size; letters are very
many small ones.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from quillgraph.functions import scalars as S
from quillgraph.operators.integrity import stray_keys
from quillgraph.sources import schemas as M

TEI = "{http://www.tei-c.org/ns/1.0}"
XML_ID = "{http://www.w3.org/XML/1998/namespace}id"


def squeezed(text: str | None) -> str:
    return " ".join((text or "").split())


def all_text(el: ET.Element | None) -> str:
    """The text of an element and all below it."""
    return squeezed("".join(el.itertext())) if el is not None else ""


def after_hash(ref: str | None) -> str | None:
    return (ref or "").strip().rpartition("#")[2] or None


def child(el: ET.Element | None, *path: str) -> ET.Element | None:
    return el.find("/".join(TEI + p for p in path)) if el is not None else None


def children(el: ET.Element | None, tag: str) -> list[ET.Element]:
    return el.findall(TEI + tag) if el is not None else []


def typed(el: ET.Element | None, tag: str, kind: str) -> ET.Element | None:
    return next((c for c in children(el, tag) if c.get("type") == kind), None)


def authority(ref: str | None) -> dict[str, str | None]:
    """P5 in Python, for values that are met inside a tree."""
    url = (ref or "").strip()
    kind = "gnd" if "d-nb.info/gnd" in url else "wikidata" if "wikidata.org" in url else "other" if url.startswith(("http://", "https://")) else None
    return {k: url if k == kind else None for k in ("gnd", "wikidata", "other")}


def letter_text(div: ET.Element) -> str:
    """An element's text without what is inside ``fw`` and ``add``; what follows these stays."""
    parts: list[str] = []
    todo: list[ET.Element | str] = [div]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            parts.append(x)
        elif x.tag not in (f"{TEI}fw", f"{TEI}add"):
            below: list[ET.Element | str] = [x.text or ""]
            for c in x:
                below += [c, c.tail or ""]
            todo += reversed(below)
    return squeezed("".join(parts))


def person_rows(root: ET.Element) -> Iterator[dict]:
    """Persons and groups; the main name before others, an entry without a name by all its text."""
    for el in root.iter():
        kind = el.tag.removeprefix(TEI)
        if kind not in ("person", "personGrp") or not el.get(XML_ID):
            continue
        name = typed(el, "persName", "main")
        name = name if name is not None else child(el, "persName")
        norm = authority(el.get("ref"))
        for ref in children(el, "ref"):
            target = (ref.get("target") or all_text(ref)).strip()
            if norm["other"] is None and target != el.get("ref") and target.startswith(("http://", "https://")):
                norm["other"] = target
        listed = lambda tag: [t for c in children(el, tag) if (t := squeezed(c.text))]  # noqa: B023, E731
        when = lambda tag: (c.get("when") or None) if (c := child(el, tag)) is not None else None  # noqa: B023, E731
        yield {"id": el.get(XML_ID), "kind": kind, "label": all_text(name if name is not None else el), "person_type": el.get("type"), "gender": el.get("gender"), "corporate_body": el.get("gender") == "CorporateBody", "normdaten": norm, "occupation": listed("occupation"), "education": listed("education"), "birth": when("birth"), "death": when("death")}


def place_rows(root: ET.Element) -> Iterator[dict]:
    """S3: coordinates are null where they can't be read."""
    for el in root.iter(f"{TEI}place"):
        if not el.get(XML_ID):
            continue
        name, geo = child(el, "placeName"), child(el, "location", "geo")
        coords = coordinates(geo.text) if geo is not None and geo.text and "," in geo.text else None
        yield {"id": el.get(XML_ID), "label": all_text(name), "normdaten": authority(name.get("ref") if name is not None else None), "coords": coords, "desc": all_text(child(el, "desc")) or None}


def work_rows(root: ET.Element) -> Iterator[dict]:
    """Entries with an id; a blank key is no link."""
    for el in root.iter():
        if el.tag not in (f"{TEI}bibl", f"{TEI}biblStruct") or not el.get(XML_ID):
            continue
        keyed = lambda tag: {"key": after_hash(c.get("key")), "label": all_text(c)} if (c := child(el, tag)) is not None else None  # noqa: B023, E731
        yield {"id": el.get(XML_ID), "label": all_text(child(el, "title")) or all_text(el), "lit_type": el.get("type"), "ana": el.get("ana"), "author": keyed("author"), "pub_place": keyed("pubPlace"), "date": all_text(child(el, "date")) or None, "idno": [{"type": i.get("type"), "value": squeezed(i.text)} for i in children(el, "idno")]}


def witness_rows(root: ET.Element) -> Iterator[dict]:
    """S5."""
    for el in root.iter(f"{TEI}witness"):
        if el.get(XML_ID):
            bibl = child(el, "bibl")
            text = lambda tag: all_text(child(bibl, tag)) or None  # noqa: B023, E731
            yield {"id": el.get(XML_ID), "witness_type": el.get("type"), "corresp": after_hash(el.get("corresp")), "settlement": text("settlement"), "repository": text("repository"), "signature": all_text(typed(bibl, "idno", "signature")) or None, "note": text("note")}


def action(desc: ET.Element | None, kind: str) -> dict[str, str | None]:
    """Person, place and date of a sending or receiving."""
    el = typed(desc, "correspAction", kind)
    key = lambda tag: after_hash(c.get("key")) if (c := child(el, tag)) is not None else None
    date = child(el, "date")
    when = date.get("when") if date is not None else None
    return {"person": key("persName"), "place": key("placeName"), "date": when, "date_precision": {10: "day", 7: "month", 4: "year"}.get(len((when or "").strip()))}


def register_rows(root: ET.Element) -> Iterator[dict]:
    """A row per letter of the overall register, with its notes as fields; notes that must be URLs but aren't are absent."""
    web = lambda v: v if v and v.startswith(("http://", "https://")) else None
    for desc in root.iter(f"{TEI}correspDesc"):
        if not desc.get("key"):
            continue
        notes = {n.get("type"): n for n in children(desc, "note") if n.get("type")}
        meta = {}
        for note, field in M.NOTE_FIELDS.items():
            value = all_text(notes.get(note)) or None
            meta[field] = web(value) if note in M.URL_NOTES else value
        published = notes.get("published_in")
        meta["published_in_url"] = web(published.get("target") if published is not None else None)
        yield {"id": desc.get("key"), "sent": action(desc, "sent"), "received": action(desc, "received"), "publication_status": desc.get("change"), "register_meta": meta, "scan": all_text(notes.get("scan")) or None}


REGISTER = f"id string, sent {M.ACTION}, received {M.ACTION}, publication_status string, register_meta {M.REGISTER_META}, scan string"


def mentions(desc: ET.Element | None, witness_prefix: str) -> dict[str, list[str]]:
    """Ids in a letter's list of mentions, by kind; a reference with several ids counts for each of them (Q9)."""
    found: dict[str, list[str]] = {"persons": [], "places": [], "works": [], "witnesses": []}
    for ref in children(typed(desc, "note", "mentioned"), "ref"):
        for target in (after_hash(t) for t in (ref.get("target") or "").split()):
            kind = {"cmif:mentionsPerson": "persons", "cmif:mentionsPlace": "places", "cmif:mentionsBibl": "works"}.get(ref.get("type") or "")
            if target and kind:
                found["witnesses" if kind == "works" and target.startswith(witness_prefix) else kind].append(target)
    return found


LETTER_FILE = f"id string, sent {M.ACTION}, received {M.ACTION}, mentions {M.MENTIONS}, text string, incipit string, statuses array<string>, source string, rs_keys array<string>"


def letter_row(root: ET.Element, letter_id: str, witness_prefix: str) -> dict:
    """Header and text of a letter: its first normalized division, even if empty, else the first original or printed one."""
    desc = root.find(f".//{TEI}correspDesc")
    divs = list(root.iter(f"{TEI}div"))
    first = lambda *kinds: next((d for d in divs if d.get("type") in kinds), None)
    chosen = first("normalized")
    chosen = chosen if chosen is not None else first("original", "print")
    text = letter_text(chosen) if chosen is not None else None
    source = first("original", "print")
    changes = [c.get("status") for r in root.iter(f"{TEI}revisionDesc") for c in r.iter(f"{TEI}change")]
    keys = sorted({k for d in divs for rs in d.iter(f"{TEI}rs") if (k := after_hash(rs.get("key")))})
    return {"id": letter_id, "sent": action(desc, "sent"), "received": action(desc, "received"), "mentions": mentions(desc, witness_prefix), "text": text, "incipit": text[:200] if text else None, "statuses": changes, "source": source.get("type") if source is not None else None, "rs_keys": keys}


def is_web(value: str | None) -> bool:
    return (value or "").strip().startswith(("http://", "https://"))


NOTE = "category string, id string, value string"


def register_notes(root: ET.Element, path: str) -> Iterator[dict]:
    """what reading a register drops: entries without an id, references and notes that are no web address, coordinates that can't be read."""
    note = lambda category, key, value: {"category": category, "id": key, "value": value}
    name = path.rpartition("/")[2]
    wrong = lambda v: bool((v or "").strip()) and not is_web(v)
    for el in root.iter():
        kind, key = el.tag.removeprefix(TEI), el.get(XML_ID)
        if kind in ("person", "personGrp"):
            if not key:
                yield note("persons-missing-id", None, name)
                continue
            for value in (el.get("ref"), *((r.get("target") or all_text(r)) for r in children(el, "ref"))):
                if wrong(value):
                    yield note("invalid-url-ref", key, value)
        elif kind == "place":
            if not key:
                yield note("places-missing-id", None, name)
                continue
            label, geo = child(el, "placeName"), child(el, "location", "geo")
            if label is not None and wrong(label.get("ref")):
                yield note("invalid-url-ref", key, label.get("ref"))
            if geo is not None and geo.text and "," in geo.text and coordinates(geo.text) is None:
                yield note("places-bad-geo", key, geo.text.strip())
        elif kind == "correspDesc":
            if not el.get("key"):
                yield note("register-missing-key", None, name)
                continue
            notes = {n.get("type"): n for n in children(el, "note") if n.get("type")}
            values = {t: all_text(notes.get(t)) for t in M.URL_NOTES}
            published = notes.get("published_in")
            values["published_in_url"] = published.get("target") if published is not None else None
            for field, value in values.items():
                if wrong(value):
                    yield note("invalid-url-note", el.get("key"), f"{field} ({value})")


def coordinates(text: str) -> dict[str, float] | None:
    lat, _, lon = text.strip().partition(",")
    try:
        return {"lat": float(lat), "lon": float(lon)}
    except ValueError:
        return None


def parsed(files: DataFrame, rows: Callable[[ET.Element, str], Iterator[dict]], ddl: str) -> DataFrame:
    """Rows of each file (path, content).  A file that is no XML gives none (S22); ``unreadable`` names those."""
    kind = M.schema(ddl)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[dict] = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    root = ET.fromstring(content)
                except ET.ParseError:
                    continue
                out += rows(root, path)
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return files.select("path", "content").mapInArrow(run, kind)


def unreadable(files: DataFrame) -> DataFrame:
    """Paths of files that are no XML."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bad = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    ET.fromstring(content)
                except ET.ParseError as e:
                    bad.append({"path": path, "error": str(e)})
            yield pa.RecordBatch.from_pylist(bad, schema=pa.schema([("path", pa.string()), ("error", pa.string())]))

    return files.select("path", "content").mapInArrow(run, "path string, error string")


def files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)


class Edition:
    """An edition's folder: ``data/register`` and ``data/letters``.  ``corpus`` is the name that its ids begin with."""

    def __init__(self, spark: SparkSession, folder: str, corpus: str):
        self.spark, self.folder, self.corpus = spark, folder.rstrip("/"), corpus

    def _register(self, name: str, rows: Callable[[ET.Element], Iterator[dict]], ddl: str) -> DataFrame:
        found = files(self.spark, f"{self.folder}/data/register", f"{self.corpus}-{name}.xml")
        return parsed(found, lambda root, _: rows(root), ddl)

    def persons(self) -> DataFrame:
        return self._register("persons", person_rows, M.PERSON)

    def places(self) -> DataFrame:
        return self._register("places", place_rows, M.PLACE)

    def works(self) -> DataFrame:
        return self._register("literature", work_rows, M.WORK)

    def witnesses(self) -> DataFrame:
        return self._register("manuscripts", witness_rows, M.WITNESS)

    def register(self) -> DataFrame:
        return self._register("letters", register_rows, REGISTER)

    def entities(self) -> DataFrame:
        """(id, label, kind) of all registers; of equal ids the later register's entry counts."""
        parts = [df.select("id", label.alias("label"), F.lit(kind).alias("kind"), F.lit(i).alias("n")) for i, (kind, df, label) in enumerate([("person", self.persons(), F.col("label")), ("place", self.places(), F.col("label")), ("work", self.works(), F.col("label")), ("witness", self.witnesses(), witness_label())])]
        every = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
        return every.groupBy("id").agg(F.max_by(F.struct("label", "kind"), "n").alias("e")).select("id", "e.label", "e.kind")

    def notes(self) -> DataFrame:
        """(category, id, value) of what reading registers and letters has dropped or found missing."""
        registers = files(self.spark, f"{self.folder}/data/register", f"{self.corpus}-{{letters,persons,places}}.xml")
        letters = self.parsed_letters()
        empty = letters.where("coalesce(text, '') = ''").select(F.lit("empty-fulltext").alias("category"), "id", F.concat("id", F.lit(".xml")).alias("value"))
        marked = letters.select("id", S.last_status(F.col("statuses")).alias("status"), "rs_keys", F.flatten(F.array(*[F.col(f"mentions.{k}") for k in ("persons", "places", "works", "witnesses")])).alias("mentioned"))
        stray = stray_keys(marked).select(F.lit("rs-mentioned-mismatch").alias("category"), "id", F.array_join("stray", ", ").alias("value"))
        return parsed(registers, register_notes, NOTE).unionByName(empty).unionByName(stray)

    def bank(self) -> DataFrame:
        """(entity, kind, label, ref, idno) of what mentions are linked with: persons (without groups), places, and works by author and title; without a label, the id stands in."""
        none = F.lit(None).cast("string")
        ref = F.coalesce("normdaten.gnd", "normdaten.wikidata", "normdaten.other")
        persons = self.persons().where("kind = 'person'").select(F.col("id").alias("entity"), F.lit("person").alias("kind"), F.col("label"), ref.alias("ref"), none.alias("idno"))
        places = self.places().select(F.col("id").alias("entity"), F.lit("place").alias("kind"), F.col("label"), ref.alias("ref"), none.alias("idno"))
        title = F.trim(F.concat_ws(" ", F.col("author.label"), F.col("label")))
        works = self.works().select(F.col("id").alias("entity"), F.lit("bibl").alias("kind"), title.alias("label"), none.alias("ref"), F.array_join(F.transform("idno", lambda i: i["value"]), " ").alias("idno"))
        every = persons.unionByName(places).unionByName(works)
        return every.withColumn("label", S.first_filled(F.col("label"), F.col("entity")))

    def letter_files(self) -> DataFrame:
        """(path, content, id) of letter files; those called old are left out."""
        found = files(self.spark, f"{self.folder}/data/letters", f"{self.corpus}-letter-*.xml")
        name = F.element_at(F.split("path", "/"), -1)
        return found.where(~F.contains(name, F.lit("_old"))).select("path", "content", F.regexp_replace(name, r"\.xml\z", "").alias("id"))

    def parsed_letters(self) -> DataFrame:
        prefix = f"{self.corpus}-witness-"
        return parsed(self.letter_files(), lambda root, path: iter([letter_row(root, re.sub(r"\.xml\Z", "", path.rpartition("/")[2]), prefix)]), LETTER_FILE)

    def letters(self) -> DataFrame:
        """A record per register row, with what its file says; files without a row aren't letters."""
        reg, doc = self.register(), self.parsed_letters().withColumnsRenamed({"sent": "fsent", "received": "freceived", "id": "fid"})
        there = self.letter_files().select(F.col("id").alias("pid"), F.sha2("content", 256).alias("sha256"))
        joined = reg.join(there, reg.id == there.pid, "left").join(doc, reg.id == doc.fid, "left")
        filled = lambda c: S.blank_to_null(F.col(c)).isNotNull()
        empty = F.from_json(F.lit('{"persons":[],"places":[],"works":[],"witnesses":[]}'), M.MENTIONS)
        has = F.col("pid").isNotNull()
        return joined.select(
            "id", F.when(has, F.concat(F.lit("data/letters/"), "id", F.lit(".xml"))).alias("file"), has.alias("has_fulltext"),
            F.when(has, S.last_status(F.col("statuses"))).otherwise("register-only").alias("status"), "sha256",
            F.when(filled("fsent.person") | filled("fsent.date"), F.col("fsent")).otherwise(F.col("sent")).alias("sent"),
            F.when(filled("freceived.person"), F.col("freceived")).otherwise(F.col("received")).alias("received"),
            F.coalesce("mentions", empty).alias("mentions"), "text", "incipit", F.lit("de").alias("lang"), "publication_status", "register_meta",
        )

    def manifest(self) -> DataFrame:
        """(path, sha256) of letters and registers."""
        registers = files(self.spark, f"{self.folder}/data/register", f"{self.corpus}-{{letters,persons,places,literature,manuscripts}}.xml")
        name = F.element_at(F.split("path", "/"), -1)
        sha = F.sha2("content", 256).alias("sha256")
        return self.letter_files().select(F.concat(F.lit("data/letters/"), name).alias("path"), sha).unionByName(registers.select(F.concat(F.lit("data/register/"), name).alias("path"), sha))


def witness_label() -> Column:
    """Q1: repository, else signature, else id."""
    return S.first_filled(F.col("repository"), F.col("signature"), F.col("id"))


def mention_rows(letters: DataFrame) -> DataFrame:
    """(letter_id, kind, entity_id), a row per mention."""
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"mentions.{k}").alias("ids")) for k in ("persons", "places", "works", "witnesses")])
    return letters.select(F.col("id").alias("letter_id"), F.explode(kinds).alias("m")).select("letter_id", "m.kind", F.explode("m.ids").alias("entity_id"))


def page_lines(files_: DataFrame) -> DataFrame:
    """(path, page, line_no, line_id, text) of PAGE-XML files; blank lines are left out, each line is there once.

    ``page`` orders files by the number at the end of their name, and those without a number after them by name.
    """

    def rows(root: ET.Element, path: str) -> Iterator[dict]:
        seen, n = set(), 0
        for region in (e for e in root.iter() if e.tag.rpartition("}")[2] == "TextRegion"):
            for line in (e for e in region.iter() if e.tag.rpartition("}")[2] == "TextLine"):
                if id(line) in seen:
                    continue
                seen.add(id(line))
                text = next((e.text for e in line.iter() if e.tag.rpartition("}")[2] == "Unicode"), None)
                if text and text.strip():
                    n += 1
                    yield {"path": path, "line_no": n, "line_id": line.get("id"), "text": text.strip()}

    found = parsed(files_, rows, "path string, line_no int, line_id string, text string")
    number = F.regexp_extract("path", r"([0-9]+)\.xml\z", 1)
    return found.select("path", F.struct((number == "").alias("unnumbered"), number.try_cast("int").alias("n"), F.element_at(F.split("path", "/"), -1).alias("name")).alias("page"), "line_no", "line_id", "text")
