"""The correspondence model over tables of orders, customers, parts and texts."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The correspondent around whom the edition is built.
HUB = "person-0"


class Corpus:
    """Typed DataFrames of one folder.  Nothing is read before it is used; views are registered by ``views``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def letters(self) -> DataFrame:
        """A letter per order: sender and recipient are nations, its date is the order's."""
        orders = self.table("orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus")
        customers = self.table("customer").select("c_custkey", "c_nationkey")
        suppliers = self.table("supplier").select("s_suppkey", "s_nationkey")
        first = self.table("lineitem").groupBy("l_orderkey").agg(F.min("l_suppkey").alias("suppkey"))
        joined = orders.join(customers, orders.o_custkey == customers.c_custkey).join(first, orders.o_orderkey == first.l_orderkey, "left").join(suppliers, F.col("suppkey") == suppliers.s_suppkey, "left")
        person = lambda c: F.when(F.col(c).isNotNull(), F.concat(F.lit("person-"), F.col(c).cast("string")))
        return joined.select(
            F.col("o_orderkey").alias("id"),
            person("c_nationkey").alias("sender"),
            person("s_nationkey").alias("recipient"),
            F.concat(F.lit("place-"), F.col("c_nationkey").cast("string")).alias("place"),
            F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"),
            F.col("o_orderstatus").alias("status"),
            F.when(F.col("o_orderstatus") == "F", "online_print").when(F.col("o_orderstatus") == "O", "preview_transcription").otherwise("in_register").alias("publication_status"),
        )

    @cached_property
    def persons(self) -> DataFrame:
        n, r = self.table("nation"), self.table("region")
        kind = F.when(F.col("n_nationkey") % 2 == 0, "historical").otherwise("contemporary")
        return n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select(F.concat(F.lit("person-"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("label"), kind.alias("person_type"), F.col("r_name").alias("kind"))

    @cached_property
    def places(self) -> DataFrame:
        """Every fifth place has no coordinates."""
        k = F.col("n_nationkey")
        return self.table("nation").select(F.concat(F.lit("place-"), k.cast("string")).alias("id"), F.col("n_name").alias("label"), F.when(k % 5 != 0, (k - 12) * 2.5).cast("double").alias("lat"), F.when(k % 5 != 0, k * 7.0 - 80).cast("double").alias("lon"))

    @cached_property
    def works(self) -> DataFrame:
        return self.table("part").select(F.concat(F.lit("work-"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("label"), F.col("p_type").alias("lit_type"), F.col("p_brand").alias("author"))

    @cached_property
    def mention_rows(self) -> DataFrame:
        """Mentions as they stand in the letters: repeated ones included."""
        return self.table("lineitem").select(F.col("l_orderkey").alias("letter_id"), F.concat(F.lit("work-"), F.col("l_partkey").cast("string")).alias("entity_id"))

    @cached_property
    def mentions(self) -> DataFrame:
        """A row per letter and entity that it mentions."""
        return self.mention_rows.distinct()

    @cached_property
    def texts(self) -> DataFrame:
        return self.table("documents").select(F.col("doc_id").alias("letter_id"), "text", "lang", "source")

    @cached_property
    def chunks(self) -> DataFrame:
        """Passages with vectors, five to a letter."""
        e = self.table("embeddings")
        return e.select(F.col("vec_id").alias("chunk_id"), F.floor(F.col("vec_id") / 5).alias("letter_id"), (F.col("vec_id") % 5).cast("int").alias("chunk_index"), F.col("embedding").cast("array<double>").alias("v"), F.col("label").alias("cluster"))

    def views(self, prefix: str = "") -> None:
        """Register every DataFrame of the model as a temporary view."""
        for name in ("letters", "persons", "places", "works", "mentions", "mention_rows", "texts", "chunks"):
            getattr(self, name).createOrReplaceTempView(prefix + name)
