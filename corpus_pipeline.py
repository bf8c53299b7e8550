"""From raw documents to packed training sequences: five stages, each written as Parquet and read again by the next.

A stage takes (spark, docs, sf_dir) and works on all that the one before it kept.  All but the last return the columns
of ``documents``; the last returns the packing plan, whose token positions count the words of the documents that it was
given.  ``run_all`` gives these documents and the plan; ``packing.sequences`` fetches the tokens.  Each stage calls one
operator of ``quillgraph.llm``, whose module says how it treats nulls, empty texts, repeated rows and empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillgraph.llm import decontaminate, language_id, packing, simhash, substring_dedup
from quillgraph.llm.common import table, written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; ``lang`` becomes the language found."""
    return language_id.keep_identified(docs, language_id.fit(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class whose five-word shingles are alike to 0.8 or more."""
    return simhash.keep_one(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one has; those that are nothing else go."""
    return substring_dedup.remove_repeats(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth is benchmark text."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Which tokens of which document go where in which sequence."""
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeated_passages),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: Language scores, fingerprints, chains and packing are no SQL; tests hold the whole against plain code.
ORACLE_SQL = None


def run_all(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All stages over the table of documents: the documents that are packed (a written table), and the plan."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs, STAGES[-1][1](spark, docs, sf_dir)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan that all stages over the table of documents give."""
    return run_all(spark, sf_dir)[1]
