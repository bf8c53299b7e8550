"""Vector search over passages, and hybrid retrieval that explains similarity with graph evidence."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.vectors import dot, truncated, unit
from quillgraph.operators.graph import correspondence_context, shared_mentions
from quillgraph.operators.register import between_dates


def letter_vectors(chunks: DataFrame) -> DataFrame:
    """Each letter's mean passage vector, of length one; a mean of nothing is nothing.

    Means are taken component by component with partial sums, so a letter of very many passages is no hot group.
    """
    parts = chunks.select("letter_id", F.posexplode("v").alias("dim", "x")).groupBy("letter_id", "dim").agg(F.avg("x").alias("m"))
    return parts.groupBy("letter_id").agg(F.array_sort(F.collect_list(F.struct("dim", "m"))).alias("p")).select("letter_id", unit(F.transform("p", lambda x: x["m"])).alias("v"))


def literal_vector(values: list[float]) -> Column:
    """A query vector as a literal."""
    return F.array(*[F.lit(float(x)) for x in values])


def chunk_scores(chunks: DataFrame, query: Column) -> DataFrame:
    """Each letter's best passage for a query of length one; the earliest of equal ones."""
    scored = chunks.select("letter_id", "chunk_index", dot(unit(F.col("v")), query).alias("score"))
    best = F.max_by(F.struct("chunk_index", "score"), F.struct("score", -F.col("chunk_index")))
    return scored.groupBy("letter_id").agg(best.alias("b")).select("letter_id", "b.chunk_index", "b.score")


def chunk_search(chunks: DataFrame, query: Column, k: int = 10) -> DataFrame:
    """O2: the letters with the best passages."""
    return chunk_scores(chunks, query).orderBy(F.desc("score"), "letter_id").limit(k)


def semantic_search(vectors: DataFrame, letters: DataFrame, query: Column, k: int = 10, date_from: str | None = None, date_to: str | None = None) -> DataFrame:
    """O1, F1: letters by the similarity of their vectors, within dates; scores rounded to four digits for display."""
    dated = between_dates(letters.select(F.col("id").alias("letter_id"), "date"), "date", date_from, date_to)
    joined = vectors.join(dated, "letter_id").select("letter_id", "date", dot(unit(F.col("v")), query).alias("score"))
    return joined.orderBy(F.desc("score"), "letter_id").limit(k).withColumn("score", F.round("score", 4))


#: Vectors that one task compares with each other at a time.
BLOCK = 4096


def top_neighbors(vectors: DataFrame, k: int = 5, key: str = "letter_id", block: int = BLOCK) -> DataFrame:
    """(key, other, score, rank): the k most similar others of each vector, exactly; ties to the smaller key.

    All pairs are a statement of the operation.  Rows are dealt to as many blocks as their number needs; a pair of blocks
    is a task's work, a product of two matrices, and gives each row's best few, so what is shuffled grows with rows times
    blocks and not with pairs.  Scores are sums in order of the components, as ``dot`` has them.
    """
    unit_rows = vectors.select(F.col(key).alias("k"), unit(F.col("v")).alias("v")).where("v is not null")
    kind = unit_rows.schema["k"].dataType.simpleString()
    blocks = max(1, -(-unit_rows.select("k").count() // block))
    own = unit_rows.withColumn("x", F.pmod(F.xxhash64("k"), F.lit(blocks)))
    every = F.sequence(F.lit(0), F.lit(blocks - 1))
    left = own.withColumn("y", F.explode(every))
    right = own.select("k", "v", F.col("x").alias("y"), F.explode(every).alias("x"))

    def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple] = []
        if len(a) and len(b):
            b = b.sort_values("k", kind="stable")
            names, theirs = b["k"].to_numpy(), np.stack(b["v"].to_numpy()).astype(np.float64)
            mine = np.stack(a["v"].to_numpy()).astype(np.float64)
            for at in range(0, len(mine), 256):
                scores = mine[at : at + 256] @ theirs.T
                for name, v, row in zip(a["k"].iloc[at : at + 256], mine[at : at + 256], scores):
                    row[names == name] = -np.inf
                    # the product's last digits depend on its order, so what is near the k-th is added up anew
                    least = np.partition(row, -k)[-k] - 1e-9 if len(row) > k else -np.inf
                    near = np.flatnonzero((row >= least) & (row > -np.inf))
                    exact = np.zeros(len(near))
                    for d in range(len(v)):
                        exact = exact + v[d] * theirs[near, d]
                    order = np.lexsort((near, -exact))[:k]  # names are in order
                    found += [(name, names[near[i]], float(exact[i])) for i in order]
        return pd.DataFrame(found, columns=["k1", "k2", "score"])

    met = left.groupBy("x", F.col("y").cast("long").alias("y")).cogroup(right.groupBy(F.col("x").cast("long").alias("x"), "y")).applyInPandas(compare, f"k1 {kind}, k2 {kind}, score double")
    rank = F.row_number().over(Window.partitionBy("k1").orderBy(F.desc("score"), "k2"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("k1").alias(key), F.col("k2").alias("other"), "score", "rank")


def overlap_at_k(a: DataFrame, b: DataFrame, k: int = 10, key: str = "letter_id") -> DataFrame:
    """Average share of k that two rankings (key, other, rank) have in common."""
    ids = lambda df, name: df.where(F.col("rank") <= k).groupBy(key).agg(F.collect_set("other").alias(name))
    return ids(a, "x").join(ids(b, "y"), key).agg(F.round(F.avg(F.size(F.array_intersect("x", "y")) / F.lit(k)), 6).alias("overlap"))


def truncation_gate(chunks: DataFrame, dim: int, k: int = 10, least: float = 0.8) -> DataFrame:
    """T5: whether the first ``dim`` components rank neighbours nearly as all do."""
    full = top_neighbors(chunks.select(F.col("chunk_id").alias("letter_id"), "v"), k)
    cut = top_neighbors(chunks.select(F.col("chunk_id").alias("letter_id"), truncated(F.col("v"), dim).alias("v")), k)
    return overlap_at_k(full, cut, k).withColumn("truncate", F.col("overlap") >= least)


def capped_fill(seeds: DataFrame, events: DataFrame, cap: int) -> DataFrame:
    """Candidates of each anchor: its seeds, then others in order of arrival until there are ``cap`` in all.

    seeds (anchor, id, score), events (anchor, id, seq, reason); ``seq`` orders arrivals.  Every event of a candidate
    that is kept is a reason.  Returns (anchor, id, score, reasons, first) with reasons in order of arrival.
    """
    first = events.groupBy("anchor", "id").agg(F.min("seq").alias("first"), F.array_sort(F.collect_list(F.struct("seq", "reason"))).alias("r"))
    n_seeds = seeds.groupBy("anchor").agg(F.count("*").alias("n_seeds"))
    both = first.join(seeds.select("anchor", "id", "score", F.lit(True).alias("seed")), ["anchor", "id"], "full").join(n_seeds, "anchor", "left")
    is_seed = F.coalesce("seed", F.lit(False))
    place = F.row_number().over(Window.partitionBy("anchor", is_seed).orderBy("first", "id"))
    kept = both.withColumn("place", place).where(is_seed | (F.col("place") <= F.lit(cap) - F.coalesce("n_seeds", F.lit(0))))
    reasons = F.coalesce(F.transform("r", lambda x: x["reason"]), F.expr("cast(array() as array<string>)"))
    return kept.select("anchor", "id", "score", reasons.alias("reasons"), F.coalesce(is_seed, F.lit(False)).alias("is_seed"), "first")


def _seq(stage: Column, major: Column, minor: Column, tie: Column) -> Column:
    """When an event arrives: stages in order, inside a stage by two numbers and an id."""
    return F.struct(stage.cast("long").alias("stage"), major.cast("double").alias("major"), minor.cast("double").alias("minor"), tie.cast("long").alias("tie"))


def related_letters(vectors: DataFrame, mentions: DataFrame, letters: DataFrame, top: int = 5, least_shared: int = 2, days: int = 90, keep: int = 6, spare: int = 4) -> DataFrame:
    """For each letter with a vector the related ones: (letter_id, rank, other, score, n_reasons, reasons).

    Nearest vectors first; shared mentions (most first) and the same correspondence (in order of id) confirm them and
    fill up to ``keep + spare``.  What more than one reason speaks for ranks first, then by similarity, then by reasons,
    then as it arrived (W3).
    """
    anchors = vectors.select(F.col("letter_id").alias("id"))
    near = top_neighbors(vectors, top).select(F.col("letter_id").alias("anchor"), F.col("other").alias("id"), "score", "rank")
    shared = shared_mentions(mentions, anchors, least_shared)
    same = correspondence_context(letters, anchors, days)
    zero = F.lit(0)
    neural = near.select("anchor", "id", _seq(zero, F.col("rank"), zero, F.col("id")).alias("seq"), F.lit("similar content").alias("reason"))
    by_mentions = shared.select(F.col("letter").alias("anchor"), F.col("other").alias("id"), _seq(F.lit(1), -F.col("shared"), zero, F.col("other")).alias("seq"), F.format_string("shares %d register mentions", "shared").alias("reason"))
    by_pair = same.select(F.col("letter").alias("anchor"), F.col("other").alias("id"), _seq(F.lit(2), zero, zero, F.col("other")).alias("seq"), F.format_string("same correspondence, %d days apart", "days_apart").alias("reason"))
    filled = capped_fill(near.select("anchor", "id", "score"), neural.unionByName(by_mentions).unionByName(by_pair), keep + spare)
    n = F.size("reasons")
    order = Window.partitionBy("anchor").orderBy(F.desc(n > 1), F.desc(F.coalesce(F.round("score", 3), F.lit(0.0))), F.desc(n), "first")
    ranked = filled.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)
    return ranked.select(F.col("anchor").alias("letter_id"), "rank", F.col("id").alias("other"), F.round("score", 3).alias("score"), n.alias("n_reasons"), "reasons")


def graphrag_context(chunks: DataFrame, query: Column, mentions: DataFrame, letters: DataFrame, top_k: int = 5, most: int = 15, least_shared: int = 2, days: int = 90) -> DataFrame:
    """Passages that answer a query, and letters that the graph ties to them: (rank, id, score, n_reasons, reasons).

    Hit by hit, shared mentions (most first) and then the same correspondence (nearest first) confirm or add letters
    until there are ``most``.  Hits rank by score, the others by reasons, then as they arrived (W4).
    """
    hits = chunk_search(chunks, query, top_k).withColumn("hit", F.row_number().over(Window.orderBy(F.desc("score"), "letter_id")))  # top_k rows
    seeds = hits.select(F.lit(0).alias("anchor"), F.col("letter_id").alias("id"), "score")
    ids = F.broadcast(hits.select("letter_id", "hit"))
    only = hits.select("letter_id")
    shared = shared_mentions(mentions, only, least_shared).join(ids, F.col("letter") == F.col("letter_id"))
    same = correspondence_context(letters, only, days).join(ids, F.col("letter") == F.col("letter_id"))
    own = hits.select(F.lit(0).alias("anchor"), F.col("letter_id").alias("id"), _seq(F.lit(0), F.col("hit"), F.lit(0), F.col("letter_id")).alias("seq"), F.lit("answers the question").alias("reason"))
    a = shared.select(F.lit(0).alias("anchor"), F.col("other").alias("id"), _seq(F.col("hit") * 2, -F.col("shared"), F.lit(0), F.col("other")).alias("seq"), F.format_string("%d register mentions in common with letter %s", "shared", F.col("letter").cast("string")).alias("reason"))
    b = same.select(F.lit(0).alias("anchor"), F.col("other").alias("id"), _seq(F.col("hit") * 2 + 1, F.col("days_apart"), F.lit(0), F.col("other")).alias("seq"), F.format_string("same two correspondents as letter %s, %d days apart", F.col("letter").cast("string"), "days_apart").alias("reason"))
    filled = capped_fill(seeds, own.unionByName(a).unionByName(b), most)
    order = Window.orderBy(F.desc_nulls_last("score"), F.when(F.col("score").isNull(), -F.size("reasons")), "first")  # at most `most` rows
    return filled.withColumn("rank", F.row_number().over(order)).select("rank", "id", F.round("score", 6).alias("score"), F.size("reasons").alias("n_reasons"), "reasons")


def incremental(chunks: DataFrame, known: DataFrame, keys: tuple[str, str] = ("letter_id", "sha256")) -> tuple[DataFrame, DataFrame]:
    """What has to be embedded anew, and what of the known rows is still good, by letter and content hash."""
    return chunks.join(known.select(*keys).distinct(), list(keys), "left_anti"), known.join(chunks.select(*keys).distinct(), list(keys), "left_semi")
