"""The data model: letters, register entities, graph, chunks.  Schemas are fixed, never inferred."""

from __future__ import annotations

from pyspark.sql.types import StructType

ACTION = "struct<person:string,place:string,date:string,date_precision:string>"
MENTIONS = "struct<persons:array<string>,places:array<string>,works:array<string>,witnesses:array<string>>"
NORMDATEN = "struct<gnd:string,wikidata:string,other:string>"
KEYED = "struct<key:string,label:string>"

# The notes of a register entry, and the fields that they become.
NOTE_FIELDS = {
    "nummer_harris": "harris_number",
    "journalnummer": "journal_number",
    "aufbewahrungsort": "repository_place",
    "aufbewahrungsinstitution": "repository_institution",
    "signatur": "signature",
    "url_facsimile": "facsimile_url",
    "published_in": "published_in",
    "comment": "comment",
    "iiif_manifest": "iiif_manifest",
    "iiif_canvas": "iiif_canvas",
}
#: Notes whose text must be a URL.
URL_NOTES = ("url_facsimile", "iiif_manifest", "iiif_canvas")

META_FIELDS = [*NOTE_FIELDS.values(), "published_in_url"]
REGISTER_META = "struct<" + ",".join(f"{f}:string" for f in META_FIELDS) + ">"
LETTER = f"id string, file string, has_fulltext boolean, status string, sha256 string, sent {ACTION}, received {ACTION}, mentions {MENTIONS}, text string, incipit string, lang string, publication_status string, register_meta {REGISTER_META}"
PERSON = f"id string, kind string, label string, person_type string, gender string, corporate_body boolean, normdaten {NORMDATEN}, occupation array<string>, education array<string>, birth string, death string"
PLACE = f"id string, label string, normdaten {NORMDATEN}, coords struct<lat:double,lon:double>, `desc` string"
WORK = f"id string, label string, lit_type string, ana string, author {KEYED}, pub_place {KEYED}, date string, idno array<struct<type:string,value:string>>"
WITNESS = "id string, witness_type string, corresp string, settlement string, repository string, signature string, note string"
NODE = "key string, type string, label string, date string"
EDGE = "source string, target string, type string"
CHUNK = "id string, letter_id string, chunk_index int, text string, sha256 string"
SPAN = "struct<text:string,label:string,score:double,start:int,end:int>"

# Node labels and edge types of the property graph.
NODE_LABELS = ["Letter", "Person", "Place", "Work", "Witness"]
EDGE_TYPES = ["SENT_BY", "SENT_TO", "SENT_FROM", "MENTIONS", "AUTHORED_BY", "PUBLISHED_AT", "WITNESS_OF"]


def schema(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)
