"""Matching loosely written records against registers: by date, by name, by similarity."""

from __future__ import annotations

import bisect
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.scalars import linker_text
from quillgraph.functions.similarity import token_set_ratio


def match_prefix(texts: DataFrame, register: DataFrame, date: str = "date", key: str = "id") -> DataFrame:
    """The first register row whose date begins with the found date; rows aren't used up.

    A prefix is a whole date, a month or a year, so the register offers each of these and the join is one of equality.
    """
    pieces = F.explode(F.array_distinct(F.array(F.col(date), F.substring(date, 1, 8), F.substring(date, 1, 7), F.substring(date, 1, 4))))
    offered = register.where(F.col(date).isNotNull()).select(F.col(key).alias("match"), pieces.alias("found")).groupBy("found").agg(F.min("match").alias("match"))
    return texts.join(offered, texts.found_date == offered.found, "left").drop("found")


def match_consume(texts: DataFrame, register: DataFrame, date: str = "date", key: str = "id", order: str = "position") -> DataFrame:
    """The n-th text of a date gets the n-th register row of that date; each row is used once.

    Numbers are given per date; dates with very many rows keep a task busy as long as their rows take to sort.
    """
    t = texts.withColumn("n", F.row_number().over(Window.partitionBy("found_date").orderBy(order)))
    r = register.where(F.col(date).isNotNull()).select(F.col(date).alias("found_date"), F.col(key).alias("match"), F.row_number().over(Window.partitionBy(date).orderBy(key)).alias("n"))
    return t.join(r, ["found_date", "n"], "left").drop("n")


def match_unique(texts: DataFrame, register: DataFrame, on: list[str], key: str = "id") -> DataFrame:
    """The register row that agrees in all of ``on`` (date, correspondent, direction), if it is the only one."""
    only = register.groupBy(*on).agg(F.count("*").alias("n"), F.min(key).alias("match")).where("n = 1").drop("n")
    return texts.join(only, on, "left")


def match_cascaded(texts: DataFrame, register: DataFrame, key: str = "id") -> DataFrame:
    """Register rows of the date and repository; where several are left, those whose place is part of the text's; the first of them.

    texts (text_id, date, repository, place), register (id, date, repository, place); repositories agree if the
    register's begins with the text's.

    Nothing is paired with everything of its date.  Register rows that are alike in all this are counted first; each offers
    the beginnings of its repository that are as long as some text's, and each place of a text its parts that are as long
    as some register row's, so all joins are of equality, over what differs.
    """
    key_of = ["date", "repository"]
    r = register.groupBy("date", F.col("repository").alias("rep"), F.lower("place").alias("part")).agg(F.count("*").alias("n"), F.min(key).alias("match"))
    wanted = texts.select(*key_of, "place").distinct()
    lengths = wanted.select(F.length("repository").alias("size")).distinct()
    sizes = F.explode(F.sequence(F.lit(0), F.length("rep")))
    offered = r.withColumn("size", sizes).join(lengths, "size").withColumn("repository", F.substring(F.col("rep"), F.lit(1), F.col("size")))
    offered = offered.groupBy(*key_of, "part").agg(F.sum("n").alias("n"), F.min("match").alias("match"))
    only = offered.groupBy(*key_of).agg(F.sum("n").alias("n"), F.min("match").alias("match"))
    widths = r.select(F.length("part").alias("width")).distinct()
    low = F.lower("place")
    parts = wanted.select(*key_of, "place", low.alias("low"), F.explode(F.sequence(F.lit(0), F.length(low))).alias("width")).join(widths, "width")
    parts = parts.select(*key_of, "place", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("low") - F.col("width") + 1), lambda i: F.substring(F.col("low"), i, F.col("width"))))).alias("part"))
    fits = parts.join(offered.drop("n"), [*key_of, "part"]).groupBy(*key_of, "place").agg(F.min("match").alias("fit"))
    fits = fits.toDF("d", "rep", "pl", "fit")
    found = wanted.join(only, key_of).join(fits, (F.col("date") == F.col("d")) & (F.col("repository") == F.col("rep")) & (F.col("place") == F.col("pl")), "left")
    best = found.select(F.col("date").alias("d"), F.col("repository").alias("rep"), F.col("place").alias("pl"), F.when(F.col("n") == 1, F.col("match")).otherwise(F.col("fit")).alias("match"))
    same = (F.col("date") == F.col("d")) & (F.col("repository") == F.col("rep")) & F.col("place").eqNullSafe(F.col("pl"))
    return texts.join(best, same, "left").drop("d", "rep", "pl")


def register_join(rows: DataFrame, persons: DataFrame, places: DataFrame) -> DataFrame:
    """Register rows with person and place ids by name; a name that two entries share gives two rows."""
    p = persons.select(F.col("id").alias("person_id"), F.col("label").alias("person"))
    q = places.select(F.col("id").alias("place_id"), F.col("label").alias("place"))
    return rows.join(p, "person", "left").join(q, "place", "left")


def name_contains(mentions: DataFrame, entities: DataFrame, text: str = "text", label: str = "label", key: str = "id", whole_words: bool = False) -> DataFrame:
    """For each text the first entity whose label contains it; with ``whole_words``, as a run of whole words.

    Every part of a label that is as long as some text is offered by equality, so nothing is compared with everything;
    the lengths of texts are few, and a label has as many parts of one length as letters at most.
    """
    normed = mentions.withColumn("norm", linker_text(F.col(text)))
    if whole_words:
        words = F.split(linker_text(F.col(label)), " ")
        runs = F.flatten(F.transform(F.sequence(F.lit(1), F.size("w")), lambda i: F.transform(F.sequence(F.lit(1), F.size("w") - i + 1), lambda n: F.array_join(F.slice("w", i, n), " "))))
        parts = entities.select(F.col(key).alias("entity"), words.alias("w")).select("entity", F.explode(runs).alias("norm"))
    else:
        lengths = normed.select(F.length("norm").alias("n")).where("n > 0").distinct()
        labels = entities.select(F.col(key).alias("entity"), linker_text(F.col(label)).alias("l")).withColumn("n", F.explode(F.when(F.length("l") > 0, F.sequence(F.lit(1), F.length("l"))))).join(lengths, "n")
        parts = labels.select("entity", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("l") - F.col("n") + 1), lambda i: F.substring("l", i, F.col("n"))))).alias("norm"))
    return normed.join(parts.groupBy("norm").agg(F.min("entity").alias("entity")), "norm", "left").drop("norm")


#: Texts and register entries that one task compares with each other at a time.
BLOCK = 2000
_BINS = 64


def _letters(texts: list[str]) -> np.ndarray:
    """How often each letter occurs in each text; letters are counted by the rest of their code point."""
    out = np.zeros((len(texts), _BINS), np.int16)
    for i, text in enumerate(texts):
        for c in text:
            out[i, ord(c) % _BINS] += 1
    return out


def best_entries(texts: list[str], labels: list[str], k: int) -> list[list[tuple[int, float]]]:
    """For each text the ``k`` best labels (position, score), earlier positions first among equals.

    Without a common word the score is at most what the letters in common allow; labels are scored in order of that
    bound, until it is below the k-th best score.  No label that could be among the best is left out.
    """
    plain = lambda t: " ".join(sorted(set(t.split())))
    mine, theirs = [plain(t) for t in texts], [plain(t) for t in labels]
    by_word: dict[str, list[int]] = defaultdict(list)
    for j, label in enumerate(theirs):
        for word in label.split():
            by_word[word].append(j)
    letters, sizes = _letters(theirs), np.array([len(x) for x in theirs])
    out = []
    for text, own in zip(mine, _letters(mine)):
        bound = 200.0 * np.minimum(own, letters).sum(axis=1) / np.maximum(1, len(text) + sizes)
        for word in text.split():
            bound[by_word.get(word, [])] = np.inf
        best: list[tuple[float, int]] = []
        for j in np.argsort(-bound, kind="stable").tolist():
            if len(best) == k and bound[j] < -best[-1][0]:
                break
            bisect.insort(best, (-token_set_ratio(text, theirs[j]), j))
            del best[k:]
        out.append([(j, -score) for score, j in best])
    return out


def candidates(mentions: DataFrame, bank: DataFrame, k: int = 8) -> DataFrame:
    """(norm, kind, rank, entity, score): the ``k`` best entries of a kind for each text of that kind, ties to the smaller entity.

    Every text is compared with every entry of its kind, in blocks of bounded size; a block gives its best ``k``.
    """
    blocks = lambda df: F.lit(max(1, -(-df.count() // BLOCK)))
    entries = bank.select("entity", "kind", linker_text(F.col("label")).alias("bank_norm")).where("entity is not null")
    own, theirs = blocks(mentions), blocks(entries)
    m = mentions.withColumn("x", F.pmod(F.xxhash64("norm"), own)).withColumn("y", F.explode(F.sequence(F.lit(0), theirs - 1)))
    b = entries.withColumn("y", F.pmod(F.xxhash64("entity"), theirs)).withColumn("x", F.explode(F.sequence(F.lit(0), own - 1)))

    def compare(texts: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
        entries = entries.sort_values("entity", kind="stable")
        names = entries["entity"].tolist()
        found = best_entries(texts["norm"].tolist(), entries["bank_norm"].fillna("").tolist(), k) if len(entries) and len(texts) else []
        rows = [(norm, kind, names[j], score) for norm, kind, best in zip(texts["norm"], texts["kind"], found) for j, score in best]
        return pd.DataFrame(rows, columns=["norm", "kind", "entity", "score"])

    key = ["x", "y", "kind"]
    met = m.groupBy([F.col(c).cast("string" if c == "kind" else "long").alias(c) for c in key]).cogroup(b.groupBy([F.col(c).cast("string" if c == "kind" else "long").alias(c) for c in key]))
    best = met.applyInPandas(compare, f"norm string, kind string, entity {entries.schema['entity'].dataType.simpleString()}, score double")
    rank = F.row_number().over(Window.partitionBy("norm", "kind").orderBy(F.desc("score"), "entity"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k)


def fuzzy_link(mentions: DataFrame, bank: DataFrame, k: int = 8, accept: float = 92.0) -> DataFrame:
    """(mention, entity, score, method, candidates): the best register entry, accepted from a score on.

    mentions (mention, text, kind), bank (entity, label, kind); the best ``k`` of a mention's kind are its candidates.
    Distinct texts are compared once.  Without an accepted entry, the method is ``none``; a null text counts as empty.
    """
    norm = mentions.withColumn("norm", F.coalesce(linker_text(F.col("text")), F.lit("")))
    ranked = candidates(norm.select("norm", "kind").where("kind is not null").distinct(), bank, k)
    best = ranked.groupBy("norm", "kind").agg(F.min_by(F.struct("entity", "score"), "rank").alias("b"), F.array_sort(F.collect_list(F.struct("rank", "entity", "score"))).alias("candidates"))
    found = norm.join(best, ["norm", "kind"], "left")
    good = F.coalesce(F.col("b.score") >= accept, F.lit(False))
    return found.select("mention", F.when(good, F.col("b.entity")).alias("entity"), F.when(good, F.col("b.score")).otherwise(0.0).alias("score"), F.when(good, "fuzzy").otherwise("none").alias("method"), "candidates")


def set_keys(spans: DataFrame, named: DataFrame) -> DataFrame:
    """The key of the last list entry with exactly the span's text (named: text, key, position)."""
    last = named.groupBy("text").agg(F.max_by("key", "position").alias("key"))
    return spans.join(last, "text", "left")


def apply_updates(rows: DataFrame, updates: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Values of ``columns`` from the update row of the same key, where it has any."""
    u = updates.select(key, *[F.col(c).alias(f"new_{c}") for c in columns])
    joined = rows.join(u, key, "left")
    return joined.select(*[F.coalesce(f"new_{c}", c).alias(c) if c in columns else F.col(c) for c in rows.columns])


def works_by_type(mentions: DataFrame, works: DataFrame, persons: DataFrame) -> DataFrame:
    """Mentioned works with label and author and the section they are listed under; unknown ones are not found."""
    w = works.select(F.col("id").alias("entity_id"), F.col("label").alias("work"), "lit_type", "author_key")
    p = persons.select(F.col("id").alias("author_key"), F.col("label").alias("author"))
    section = F.when(F.col("work").isNull(), "not found").when(F.col("lit_type").isin("charter", "historicalSource", "contemporaryPublication"), F.col("lit_type")).otherwise("other")
    return mentions.join(w, "entity_id", "left").join(p, "author_key", "left").select("letter_id", "entity_id", "work", "author", section.alias("section"))
