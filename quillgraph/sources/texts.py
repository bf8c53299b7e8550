"""Other sources: delimited texts, register tables, authority records, vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def fulltext_letters(letters: DataFrame) -> DataFrame:
    """Letters that have a file and a text in it."""
    return letters.where("has_fulltext and coalesce(text, '') <> ''")


def letters_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Letter records, one to a line, with the fixed schema."""
    return spark.read.schema(schema).json(path)


def register_csv(spark: SparkSession, path: str, sep: str = ";") -> DataFrame:
    """A register table with its header; missing values are empty text."""
    return spark.read.csv(path, sep=sep, header=True).na.fill("")


def corpus_pages(texts: DataFrame, mark: str = r"\n?\f|\n?---+ *Seite[^\n]*\n", key: str = "id", text: str = "text") -> DataFrame:
    """(key, page_no, lines): pages of a transcript without page numbers, running dates, signatures, or what follows a footnote's mark."""
    pages = texts.select(key, F.posexplode(F.split(text, mark)).alias("page_no", "p"))
    lines = F.transform(F.split("p", "\n"), lambda x: F.trim(F.replace(x, F.lit("|"), F.lit(""))))
    # what comes after the first footnote mark isn't the letter's
    cut = F.coalesce(F.array_min(F.filter(F.transform("l", lambda x, i: F.when(x.rlike(r"\A\*{1,2} \)"), i)), lambda i: i.isNotNull())), F.size("l"))
    number, running, signature = r"\A[0-9]+\z", r"\A[0-9]+\.\s+[\p{L}]+\s+[0-9]{4}\s*\.?\z", r"\A([1-7] )?\*\z"
    kept = F.filter(F.slice("l", F.lit(1), F.col("cut")), lambda x: ~x.rlike(number) & ~x.rlike(running) & ~x.rlike(signature))
    return pages.select(key, "page_no", lines.alias("l")).withColumn("cut", cut).select(key, "page_no", kept.alias("lines"))


def split_letters(pages: DataFrame, key: str = "id") -> DataFrame:
    """(key, number, text): a transcript's letters, each from a line with its number and a dot to the next."""
    whole = pages.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("page_no", "lines"))).alias("p")).select(key, F.concat(F.lit("\n"), F.array_join(F.flatten(F.transform("p", lambda x: x["lines"])), "\n")).alias("t"))
    parts = whole.select(key, F.explode(F.split("t", r"\n(?=[0-9]+\s*\.\n)")).alias("text"))
    number = F.regexp_extract("text", r"\A\s*([0-9]+)\s*\.", 1)
    return parts.where(number != "").select(key, number.cast("int").alias("number"), F.trim(F.regexp_replace("text", r"\A\s*[0-9]+\s*\.\s*", "")).alias("text"))


def headed_blocks(texts: DataFrame, head: str = "## Brief", key: str = "id", text: str = "text") -> DataFrame:
    """(key, position, block): blocks that begin with a heading."""
    return texts.select(key, F.posexplode(F.split(text, rf"(?m)(?=^\Q{head}\E)")).alias("position", "block")).where(F.col("block").startswith(head))


def hash_blocks(texts: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(key, position, block): the parts of a text between ``#`` marks."""
    return texts.select(key, F.posexplode(F.split(text, "#")).alias("position", "block")).select(key, "position", F.trim("block").alias("block")).where("block <> ''")


AUTHORITY = "preferredName string, gender array<struct<id:string>>, dateOfBirth array<string>, dateOfDeath array<string>, professionOrOccupation array<struct<id:string,label:string>>, academicDegree array<string>, publication array<struct<title:string>>"


def authority_records(rows: DataFrame, key: str = "gnd_id", json: str = "json") -> DataFrame:
    """Facts of cached authority records, a row per key; null where a record is no JSON."""
    r = rows.select(key, F.from_json(json, AUTHORITY).alias("r"))
    return r.select(
        key, F.col("r.preferredName").alias("name"), F.substring_index(F.try_element_at("r.gender", F.lit(1))["id"], "#", -1).alias("gender"),
        F.try_element_at("r.dateOfBirth", F.lit(1)).alias("birth"), F.try_element_at("r.dateOfDeath", F.lit(1)).alias("death"),
        F.transform("r.professionOrOccupation", lambda x: x["label"]).alias("occupations"), F.coalesce(F.size("r.publication"), F.lit(0)).alias("publications"), F.col("r.academicDegree").alias("degrees"),
    )


def candidate_titles(rows: DataFrame, key: str = "work_id", preferred: str = "hsc", n: int = 3) -> DataFrame:
    """First distinct titles and years of each work's harvested records (source, position, title, year); a preferred source's first."""
    order = F.struct((F.col("source") != preferred).alias("a"), F.col("position").alias("b"), F.col("title").alias("t"), F.col("year").alias("y"))
    by = rows.groupBy(key).agg(F.array_sort(F.collect_list(order)).alias("r"))
    titles = F.slice(F.array_distinct(F.filter(F.transform("r", lambda x: x["t"]), lambda t: t.isNotNull())), 1, n)
    years = F.slice(F.array_sort(F.array_distinct(F.filter(F.transform("r", lambda x: x["y"]), lambda y: y.isNotNull()))), 1, n)
    return by.select(key, titles.alias("titles"), years.alias("years"))


def unwound_xml(spark: SparkSession, path: str, row_tag: str, schema: str, children: str) -> DataFrame:
    """Elements of an XML file as rows, one for each of their ``children``; an element without any is one row."""
    rows = spark.read.schema(schema).option("rowTag", row_tag).format("xml").load(path)
    return rows.withColumn(children, F.explode_outer(children))
