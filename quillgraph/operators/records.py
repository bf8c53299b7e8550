"""Records and ids: properties of nodes, id assignment, first of duplicates, lists in text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions import scalars as S
from quillgraph.sources import schemas as M

Properties = dict[str, tuple[Column, str]]


# Names of properties, as graph queries use them.
def letter_properties() -> Properties:
    """P10: of a letter record: what its file says, and the fields that only the register has."""
    date = S.effective(F.col("sent.date"), F.col("received.date"))
    text = lambda *names: {n: (S.blank_to_null(F.col(n)), "string") for n in names}
    meta = {f: (S.blank_to_null(F.col(f"register_meta.{f}")), "string") for f in M.META_FIELDS}
    return {"date": (date, "string"), "date_precision": (S.date_precision(date), "string"), **text("incipit", "text", "file"), "has_fulltext": (F.col("has_fulltext"), "bool"), **text("status", "lang", "publication_status"), **meta}


def _norm(*kinds: str) -> Properties:
    return {"url" if k == "other" else k: (F.col(f"normdaten.{k}"), "string") for k in kinds}


def person_properties() -> Properties:
    """P10: empty lists are absent, false is kept."""
    filled = lambda c: F.when(F.size(c) > 0, F.col(c))
    return {"label": (F.col("label"), "string"), "kind": (F.col("kind"), "string"), "person_type": (F.col("person_type"), "string"), "gender": (F.col("gender"), "string"), "corporate_body": (F.col("corporate_body"), "bool"), **_norm("gnd", "wikidata", "other"), "occupation": (filled("occupation"), "list"), "education": (filled("education"), "list"), "birth": (F.col("birth"), "string"), "death": (F.col("death"), "string")}


def place_properties() -> Properties:
    return {"label": (F.col("label"), "string"), **_norm("wikidata", "gnd", "other"), "desc": (F.col("desc"), "string"), "lat": (F.col("coords.lat"), "number"), "lon": (F.col("coords.lon"), "number")}


def unlinked(field: str) -> Column:
    """The text of an author or a place that has no key to link it by."""
    return F.when(S.blank_to_null(F.col(f"{field}.key")).isNull(), S.blank_to_null(F.col(f"{field}.label")))


def work_properties() -> Properties:
    """P10: authors and places that are linked are edges; the others are text."""
    idno = S.flatten_idno(F.col("idno"))
    return {"label": (F.col("label"), "string"), "lit_type": (F.col("lit_type"), "string"), "ana": (F.col("ana"), "string"), "date": (F.col("date"), "string"), "idno": (F.when(F.size(idno) > 0, idno), "list"), "author_label": (unlinked("author"), "string"), "pub_place_label": (unlinked("pub_place"), "string"), "is_exemplar": (F.col("lit_type") == "charter", "bool")}


def witness_properties() -> Properties:
    """P10, Q1: the label is the repository, else the signature, else the id."""
    return {"label": (S.first_filled(F.col("repository"), F.col("signature"), F.col("id")), "string"), "witness_type": (F.col("witness_type"), "string"), "settlement": (F.col("settlement"), "string"), "repository": (F.col("repository"), "string"), "signature": (F.col("signature"), "string"), "note": (F.col("note"), "string")}


def with_properties(df: DataFrame, props: Properties) -> DataFrame:
    """The id and the properties as columns."""
    return df.select("id", *[c.alias(n) for n, (c, _) in props.items()])


def flattened(df: DataFrame, sep: str = "_") -> DataFrame:
    """Nested structs as columns named by their path, text with single spaces."""
    out: list[Column] = []

    def walk(kind, path: list[str]) -> None:
        for field in kind.fields:
            here = [*path, field.name]
            if field.dataType.typeName() == "struct":
                walk(field.dataType, here)
            else:
                c = F.col(".".join(f"`{p}`" for p in here))
                out.append((F.when(c.isNotNull(), S.norm_ws(c)) if field.dataType.typeName() == "string" else c).alias(sep.join(here)))

    walk(df.schema, [])
    return df.select(*out)


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """U8: the first row of each key."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def assign_ids(df: DataFrame, prefix: str, group: str, order: list[str], start: Column | int = 0, width: int = 4) -> DataFrame:
    """Ids by position inside a group, going on after the highest number that is taken (``start``)."""
    n = F.row_number().over(Window.partitionBy(group).orderBy(*order)) + start
    return df.withColumn("new_id", S.zero_padded(prefix, n, width))


def bullet_items(texts: DataFrame, prefix: str, key: str = "id", text: str = "text") -> DataFrame:
    """(key, n, item_id, item): the items of a bulleted text."""
    items = F.filter(F.transform(F.split(text, r"\n"), lambda x: F.trim(F.regexp_extract(x, r"\A\s*[-*•]\s+(.*)\z", 1))), lambda x: x != "")
    rows = texts.select(key, F.posexplode(items).alias("p", "item")).withColumn("n", F.col("p") + 1)
    return rows.select(key, "n", F.concat(F.lit(prefix), F.col(key).cast("string"), F.lit("-"), F.lpad(F.col("n").cast("string"), 2, "0")).alias("item_id"), "item")


def derived_mentions(marks: DataFrame, entities: dict[str, DataFrame]) -> DataFrame:
    """(letter_id, kind, entity_id, label): a list of mentions from the keys marked in a text (letter_id, kind, key)."""
    labels = reduce(DataFrame.unionByName, [df.select(F.lit(kind).alias("kind"), F.col("id").alias("entity_id"), "label") for kind, df in entities.items()])
    m = marks.select("letter_id", "kind", S.bare_id(F.col("key")).alias("entity_id")).where("entity_id is not null").distinct()
    return m.join(labels, ["kind", "entity_id"], "left")


def picker(df: DataFrame, contains: str = "", label: str = "label", key: str = "id") -> DataFrame:
    """A register's entries in order of label, those whose label contains a text."""
    return df.where(F.contains(F.lower(label), F.lit(contains.lower()))).select(key, label).orderBy(F.lower(label), key)


def enabled_models(config: DataFrame, visible: bool = False) -> DataFrame:
    """models that are switched on, or of these only those that are shown."""
    on = config.where(F.coalesce("enabled", F.lit(True)))
    return on.where(F.coalesce("frontend_visible", F.lit(True))) if visible else on


def cluster_sizes(clusters: DataFrame) -> DataFrame:
    """A10."""
    return clusters.groupBy("cluster").agg(F.count("*").alias("n"))
