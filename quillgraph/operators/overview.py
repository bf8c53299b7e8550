"""Corpus aggregates: totals, timeline, correspondents, places, mentions.  Entity tables are joined after aggregating."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.scalars import blank_to_null, year_of


def partner(hub: str) -> Column:
    """The other party of a letter: the sender of what the hub has received, else the recipient."""
    return F.when(F.col("recipient") == hub, F.col("sender")).otherwise(F.col("recipient"))


def totals(letters: DataFrame, places: DataFrame, hub: str) -> DataFrame:
    """A1: one row of counts.  Each letter is read once; a place counts if it has coordinates.

    Letters with a full text are counted where letters have ``has_fulltext``.
    """
    mapped = places.where("lat is not null").select(F.col("id").alias("place"), F.lit(1).alias("mapped"))
    seen = letters.join(mapped, "place", "left")
    return seen.agg(
        F.count("*").alias("letters"),
        F.count_if(year_of(F.col("date")).isNotNull()).alias("dated"),
        *([F.count_if(F.coalesce("has_fulltext", F.lit(False))).alias("fulltext")] if "has_fulltext" in letters.columns else []),
        F.count_if(F.coalesce(F.col("publication_status").startswith("online"), F.lit(False))).alias("published"),
        F.count_distinct(partner(hub)).alias("correspondents"),
        F.count_distinct(F.when(F.col("mapped") == 1, F.col("place"))).alias("places_mapped"),
    )


def timeline(letters: DataFrame) -> DataFrame:
    """A2: letters per year, by the sender's date or else the recipient's."""
    return letters.select(year_of(F.col("date")).alias("year")).where("year is not null").groupBy("year").agg(F.count("*").alias("letters")).orderBy("year")


def correspondents(letters: DataFrame, persons: DataFrame, hub: str) -> DataFrame:
    """A3: letters and first and last year of each partner, most letters first."""
    by = letters.select(partner(hub).alias("id"), year_of(F.col("date")).alias("year")).where("id is not null").groupBy("id").agg(F.count("*").alias("letters"), F.min("year").alias("from_year"), F.max("year").alias("to_year"))
    labels = persons.select("id", "label")
    return by.join(labels, "id", "left").select("id", F.coalesce(blank_to_null(F.col("label")), F.col("id")).alias("label"), "letters", "from_year", "to_year").orderBy(F.desc("letters"), "id")


def partner_years(letters: DataFrame, hub: str) -> DataFrame:
    """A3: letters of each partner in each year."""
    return letters.select(partner(hub).alias("id"), year_of(F.col("date")).alias("year")).where("id is not null and year is not null").groupBy("id", "year").agg(F.count("*").alias("letters"))


def partner_year_maps(letters: DataFrame, hub: str) -> DataFrame:
    """A3: a map from year to letters for each partner; as many entries as years."""
    rows = partner_years(letters, hub).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("year", "letters"))).alias("e"))
    return rows.select("id", F.map_from_entries("e").alias("years"))


def sending_places(letters: DataFrame, places: DataFrame) -> DataFrame:
    """A4: letters of each place that has coordinates."""
    by = letters.where("place is not null").groupBy("place").agg(F.count("*").alias("letters"))
    return by.join(places.where("lat is not null"), by.place == places.id).select("id", F.coalesce(blank_to_null(F.col("label")), F.col("id")).alias("label"), "lat", "lon", "letters").orderBy(F.desc("letters"), "id")


def mentioned(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """A5: distinct letters that mention each entity."""
    by = mentions.groupBy("entity_id").agg(F.count_distinct("letter_id").alias("letters"))
    return by.join(entities.select(F.col("id").alias("entity_id"), "label"), "entity_id", "left").select(F.col("entity_id").alias("id"), F.coalesce(blank_to_null(F.col("label")), F.col("entity_id")).alias("label"), "letters").orderBy(F.desc("letters"), "id")


def mentioned_persons(mentions: DataFrame, persons: DataFrame, person_type: str, placeholder: str = "Unbekannt") -> DataFrame:
    """Distinct letters that mention each person of a type, without the register's placeholder."""
    of_type = persons.where((F.col("person_type") == person_type) & ~F.coalesce(F.col("label") == placeholder, F.lit(False)))
    return mentioned(mentions.join(of_type.select(F.col("id").alias("entity_id")), "entity_id", "left_semi"), of_type)


def person_letter_totals(letters: DataFrame, persons: DataFrame) -> DataFrame:
    """Letters sent and received by each person; as references, and as distinct letters."""
    roles = F.explode(F.array(F.struct(F.col("sender").alias("p"), F.lit("sent").alias("role")), F.struct(F.col("recipient").alias("p"), F.lit("received").alias("role"))))
    flat = letters.select("id", roles.alias("r")).select("id", "r.p", "r.role").where("p is not null")
    by = flat.groupBy("p").agg(F.count_if(F.col("role") == "sent").alias("sent"), F.count_if(F.col("role") == "received").alias("received"), F.count("*").alias("refs"), F.count_distinct("id").alias("letters"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return persons.select("id", "label").join(by, persons.id == by.p, "left").select("id", "label", *[zero(c) for c in ("sent", "received", "refs", "letters")])


def max_year(letters: DataFrame) -> DataFrame:
    """The year with the most letters, the earliest of several."""
    return timeline(letters).agg(F.max_by("year", F.struct("letters", -F.col("year"))).alias("year"), F.max("letters").alias("letters"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows of each value."""
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def directions(letters: DataFrame, hub: str) -> DataFrame:
    """Letters and distinct partners by direction, as the hub sees it."""
    way = F.when(F.col("sender") == hub, "from_hub").when(F.col("recipient") == hub, "to_hub").otherwise("other")
    return letters.select(way.alias("direction"), partner(hub).alias("p")).groupBy("direction").agg(F.count("*").alias("letters"), F.count_distinct("p").alias("partners"))


def exploded_counts(df: DataFrame, column: str, sep: str) -> DataFrame:
    """Occurrences of each part of a separated list."""
    return df.select(F.explode(F.split(column, sep)).alias("part")).select(F.trim("part").alias("part")).where("part <> ''").groupBy("part").agg(F.count("*").alias("n"))


def map_markers(places: DataFrame) -> DataFrame:
    """Radii of places by their letters; the largest count is one row, known before the division."""
    from quillgraph.functions.scalars import area_radius, marker_radius

    top = F.broadcast(places.agg(F.max("letters").alias("top")))
    return places.crossJoin(top).select("id", "letters", marker_radius(F.col("letters")).alias("radius"), F.round(area_radius(F.col("letters"), F.col("top")), 6).alias("area_radius"))


def document(parts: dict[str, DataFrame], maps: dict[str, tuple[DataFrame, str, str]] | None = None) -> DataFrame:
    """(part, position, value): parts of an overview as JSON lines, one table after the other.

    ``parts`` are tables, a line for each row in order of their rank (``position`` if they have it); ``maps`` are tables
    that are one object from a key column to a value column, a line for each entry.
    """
    rows = []
    for name, df in parts.items():
        at = F.col("position") if "position" in df.columns else F.lit(0)
        rows.append(df.select(F.lit(name).alias("part"), at.cast("long").alias("position"), F.to_json(F.struct(*[c for c in df.columns if c != "position"])).alias("value")))
    for name, (df, key, value) in (maps or {}).items():
        rows.append(df.select(F.lit(name).alias("part"), F.lit(0).cast("long").alias("position"), F.to_json(F.struct(F.col(key).cast("string").alias("key"), F.col(value).alias("value"))).alias("value")))
    return reduce(DataFrame.unionByName, rows)
