"""Validation: dangling references, missing dates, status conflicts; warnings as rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.scalars import blank_to_null, expected_change


def dangling(refs: DataFrame, entities: DataFrame, ref: str, key: str = "id") -> DataFrame:
    """Rows whose reference is no entity."""
    return refs.where(blank_to_null(F.col(ref).cast("string")).isNotNull()).join(entities.select(F.col(key).alias(ref)), ref, "left_anti")


def referenced(entities: DataFrame, refs: DataFrame, ref: str, key: str = "id") -> DataFrame:
    """Entities that some reference ends with."""
    ids = refs.select(F.substring_index(F.col(ref), "#", -1).alias(key)).distinct()
    return entities.join(ids, key, "left_semi")


def orphan_files(files: DataFrame, register: DataFrame, key: str = "id") -> DataFrame:
    """Letters with a file but no register row."""
    return files.join(register.select(key), key, "left_anti")


def warnings(letters: DataFrame, persons: DataFrame, places: DataFrame, mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """(category, message) of every broken rule over letters (id, sent, received) and their mentions.

    Each rule is a filter or an anti-join on ids; none reads the texts.
    """
    roles = letters.select("id", F.explode(F.array(F.struct(F.lit("sent").alias("role"), "sent.person", "sent.place"), F.struct(F.lit("received").alias("role"), "received.person", "received.place"))).alias("a")).select("id", "a.*")
    rule = lambda df, name, pattern, *cols: df.select(F.lit(name).alias("category"), F.format_string(pattern, *cols).alias("message"))
    undated = blank_to_null(F.col("sent.date")).isNull() & blank_to_null(F.col("received.date")).isNull()
    misplaced = blank_to_null(F.col("sent.place")).isNull() & blank_to_null(F.col("received.place")).isNotNull()
    out = [
        rule(dangling(roles, persons, "person"), "dangling-person-ref", "letter %s, %s: the persons' register has no entry %s", "id", "role", "person"),
        rule(dangling(roles, places, "place"), "dangling-place-ref", "letter %s, %s: the places' register has no entry %s", "id", "role", "place"),
        rule(dangling(mentions, entities, "entity_id"), "dangling-mention-ref", "letter %s mentions %s, which is in no register", "id", "entity_id"),
        rule(letters.where(undated), "missing-date", "letter %s has a date neither of sending nor of receiving", "id"),
        rule(letters.where(misplaced), "place-under-received", "letter %s has its place with the recipient", "id"),
    ]
    return reduce(DataFrame.unionByName, out)


def register_warnings(notes: DataFrame) -> DataFrame:
    """(category, message) of what reading the registers and files has dropped (notes: category, id, value)."""
    # Categories of warnings; their wording is ours.
    said = {
        "invalid-url-ref": "entry %s: %s is no web address", "invalid-url-note": "letter %s: the note %s is no web address",
        "persons-missing-id": "%sa person or group without an id in %s", "places-missing-id": "%sa place without an id in %s",
        "places-bad-geo": "place %s: coordinates %s can't be read", "register-missing-key": "%sa register row without a key in %s",
        "empty-fulltext": "letter %s: %s has no text", "rs-mentioned-mismatch": "letter %s: keys in the text that its list lacks: %s",
    }
    text = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, pattern in said.items():
        text = text.when(F.col("category") == name, F.format_string(pattern, F.coalesce("id", F.lit("")), F.coalesce("value", F.lit(""))))
    return notes.select("category", text.alias("message")).where("message is not null")


def write_log(found: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K1: warnings as lines ``[category] message``, those of a category together."""
    found.select("category", F.concat(F.lit("["), "category", F.lit("] "), "message").alias("value")).repartitionByRange("category", "value").sortWithinPartitions("category", "value").select("value").write.mode(mode).text(path)


def warning_counts(found: DataFrame) -> DataFrame:
    """Warnings of each category, most first."""
    return found.groupBy("category").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category")


def stray_keys(letters: DataFrame) -> DataFrame:
    """Keys marked in a finished letter's text that its list of mentions lacks (columns status, rs_keys, mentioned)."""
    stray = F.array_sort(F.array_except("rs_keys", "mentioned"))
    return letters.where(F.col("status").isin("done", "reviewed", "published")).select("id", stray.alias("stray")).where("size(stray) > 0")


def status_drift(letters: DataFrame) -> DataFrame:
    """Letters whose register status isn't what their own status calls for (columns status, source, publication_status)."""
    want = expected_change(F.col("status"), F.col("source"))
    return letters.select("id", F.col("publication_status").alias("is"), want.alias("wanted")).where("not (is <=> wanted)")


def synced(register: DataFrame, drift: DataFrame) -> DataFrame:
    """The register with drifted statuses put right, other rows as they are; ``changed`` says which it is."""
    fix = drift.select(F.col("id").alias("fixed_id"), "wanted")
    there = F.col("wanted").isNotNull()
    return register.join(fix, register.id == fix.fixed_id, "left").select(*[F.coalesce("wanted", c).alias(c) if c == "publication_status" else F.col(c) for c in register.columns], there.alias("changed"))


# Statuses of a letter, of its register row, and of its scan.
STATUSES = ("draft", "done", "reviewed", "published")
TIERS = ("in_register", "preview_print", "preview_transcription", "online_print", "online_transcription")
SCANS = ("none", "internal", "online")


def _conflict_rules() -> dict[str, Column]:
    """Tests by rule name; a null test is a rule kept."""
    file, row = F.col("has_file"), F.col("has_row")
    latest, tier, scan = F.try_element_at("statuses", F.lit(-1)), F.col("publication_status"), F.col("scan")
    return {
        "orphan-file": file & ~row,
        "unknown-status": file & row & F.exists("statuses", lambda s: ~s.isin(*STATUSES)),
        "missing-revision": file & row & (F.size("statuses") == 0),
        "missing-div": file & row & F.col("source").isNull(),
        "ready-to-publish": file & row & (latest == "reviewed"),
        "unknown-register-status": row & ~F.coalesce(tier.isin(*TIERS), F.lit(False)),
        "register-drift": row & tier.isin(*TIERS) & (tier != expected_change(latest, F.col("source"))),
        "missing-scan-note": row & scan.isNull(),
        "unknown-scan-value": row & ~scan.isin(*SCANS),
        "scan-url-mismatch": row & (scan == "online") & ~F.col("has_url"),
        "scan-implied": row & (scan == "none") & (F.col("source") == "original"),
    }


def status_conflicts(facts: DataFrame) -> DataFrame:
    """(id, rule, severity) for each rule that a letter breaks, in one pass over the facts.

    ``facts``: as ``status_facts`` puts them together.
    """
    tested = facts.withColumn("statuses", F.coalesce("statuses", F.expr("cast(array() as array<string>)")))
    marks = F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in _conflict_rules().items()]))
    return tested.select("id", F.explode(marks).alias("rule")).withColumn("severity", F.when(F.col("rule") == "ready-to-publish", "info").otherwise("conflict"))


def status_facts(register: DataFrame, files: DataFrame) -> DataFrame:
    """A row per letter with a register row (id, publication_status, scan, has_url), a file (id, statuses, source), or both."""
    r = register.select("id", "publication_status", "scan", F.coalesce("has_url", F.lit(False)).alias("has_url"), F.lit(True).alias("r"))
    f = files.select("id", "statuses", "source", F.lit(True).alias("f"))
    return r.join(f, "id", "full").select("id", F.coalesce("f", F.lit(False)).alias("has_file"), F.coalesce("r", F.lit(False)).alias("has_row"), "statuses", "source", "publication_status", "scan", "has_url")
