"""Register pages: search, filter, sort, pages, autocomplete."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def contains_all(df: DataFrame, queries: dict[str, str]) -> DataFrame:
    """rows in which every named column contains its text, whatever the case."""
    return df.where(reduce(lambda a, b: a & b, [F.contains(F.lower(F.col(c)), F.lit(q.lower())) for c, q in queries.items()], F.lit(True)))


def contains_anywhere(df: DataFrame, columns: list[str], query: str) -> DataFrame:
    """rows one of whose columns contains the text."""
    return df.where(F.contains(F.lower(F.concat_ws("\n", *columns)), F.lit(query.lower())))


def published(df: DataFrame, status: str = "publication_status", previews: bool = True) -> DataFrame:
    """online letters, and previews if wanted."""
    online = F.col(status).startswith("online")
    return df.where(online | F.col(status).startswith("preview") if previews else online)


def between_dates(df: DataFrame, date: str = "date", date_from: str | None = None, date_to: str | None = None) -> DataFrame:
    """F1, Q8: inclusive bounds compared as text; undated rows go once a bound is set."""
    if date_from:
        df = df.where(F.col(date) >= date_from)
    return df.where(F.col(date) <= date_to) if date_to else df


def page(df: DataFrame, order: list[Column], size: int, number: int = 0) -> DataFrame:
    """One page of a sorted list; ``order`` must end with a unique key."""
    return df.orderBy(*order).offset(size * number).limit(size)


def by_date(df: DataFrame, date: str = "date", key: str = "id") -> list[Column]:
    """Dated rows first."""
    return [F.col(date).asc_nulls_last(), F.col(key)]


def autocomplete(df: DataFrame, query: str, label: str = "label", key: str = "id", limit: int = 10) -> DataFrame:
    """Labels that begin with a text, then those that contain it."""
    low, q = F.lower(F.col(label)), F.lit(query.lower())
    found = df.where(F.contains(low, q)).withColumn("rank", F.when(F.startswith(low, q), 0).otherwise(1))
    return found.orderBy("rank", label, key).limit(limit).select(key, label, "rank")


def lookup_entity(df: DataFrame, query: str, label: str = "label", key: str = "id", limit: int = 8) -> DataFrame:
    """Exact ids and prefixes, then labels that contain the text, then labels that contain one of its words.

    A later kind counts only where there is none of the earlier kinds: words matter if the whole text is nowhere.
    """
    low, q = F.lower(F.col(label)), query.lower().strip()
    words = [w for w in q.split() if len(w) > 3] or [q]
    any_word = reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words])
    rank = F.when((F.lower(F.col(key)) == q) | F.startswith(low, F.lit(q)), 0).when(F.contains(low, F.lit(q)), 1).when(any_word, 2)
    ranked = df.select(key, label, rank.alias("rank")).where("rank is not null")
    whole = F.broadcast(ranked.agg(F.min("rank").alias("best")))
    return ranked.crossJoin(whole).where("rank < 2 or best = 2").orderBy("rank", label, key).limit(limit).select(key, label, "rank")


def detail_list(letters: DataFrame, person: str, most: int = 40) -> DataFrame:
    """Each person's letters in order of date, left out where there are more than ``most``."""
    n = F.count("*").over(Window.partitionBy(person))
    place = F.row_number().over(Window.partitionBy(person).orderBy(F.col("date").asc_nulls_last(), "id"))
    return letters.where(F.col(person).isNotNull()).withColumn("n", n).where(F.col("n") <= most).withColumn("position", place).select(person, "position", "id", "date", "n")


def sorted_documents(df: DataFrame, by: str, descending: bool = False) -> DataFrame:
    """By id, title or pages; titles without regard to case, missing page counts as none."""
    key = {"title": F.lower("title"), "pages": F.coalesce("pages", F.lit(0)), "id": F.col("id")}[by]
    return df.orderBy(key.desc() if descending else key.asc(), "id")


def select_documents(df: DataFrame, done_prefix: str | None = None, only_done: bool = False, text: str | None = None) -> DataFrame:
    """without, or only, titles that begin with a mark; and those whose title or id contain a text."""
    if done_prefix:
        done = F.coalesce(F.col("title").startswith(done_prefix), F.lit(False))
        df = df.where(done if only_done else ~done)
    return df.where(F.contains(F.lower("title"), F.lit(text.lower())) | F.contains(F.col("id").cast("string"), F.lit(text))) if text else df


def resolve_selection(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """Wanted texts with the document that has it as title or id; those found nowhere raise an error when read."""
    names = documents.select("id", F.explode(F.array_distinct(F.array(F.col("title"), F.col("id").cast("string")))).alias("name")).groupBy("name").agg(F.min("id").alias("id"))
    joined = wanted.join(names, wanted.wanted == names.name, "left")
    return joined.select("wanted", F.when(F.col("id").isNull(), F.raise_error(F.concat(F.lit("no such document: "), "wanted")).cast(documents.schema["id"].dataType)).otherwise(F.col("id")).alias("id"))
