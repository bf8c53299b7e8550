"""Registered queries of the training-data operators, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import ann, decontaminate, language_id, license_scan, packing, sharding, simhash, substring_dedup, url_filter, warc
from quillgraph.llm.common import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from three quarters of the labelled ones."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
    model = language_id.fit(docs.where(~held_out))
    found = language_id.predict(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of documents that repeat one of an earlier document."""
    found = substring_dedup.repeats(table(spark, sf_dir, "documents"))
    names = ("doc_id", "first_word", "end_word", "of_doc_id", "of_first_word", "of_end_word", "similarity")
    return found.toDF(*names)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packing plan of all documents."""
    return packing.pack(table(spark, sf_dir, "documents"))


URL_RULES = "VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')"


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url."""
    rules = spark.sql(f"SELECT * FROM {URL_RULES} AS t(host, path, verdict)")
    return url_filter.judge(table(spark, sf_dir, "pages"), rules)


OP4_SQL = f"""
WITH rules(rh, rp, v) AS ({URL_RULES}),
rest AS (SELECT row_number() OVER () AS r, page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS u FROM pages),
parts AS (SELECT r, page_id, coalesce(translate(regexp_extract(u, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(u, '^[^/?#]*([^?#]*)', 1), '') AS path FROM rest),
fits AS (SELECT r, max_by(rh || rp, length(rh || rp)) AS rule, max_by(v, length(rh || rp)) AS verdict
  FROM parts JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY r)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN fits USING (r)
"""


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest vectors of every hundredth one."""
    found = ann.search(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, k=10)
    return found.select("query_id", "rank", "vec_id", "score")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence sentences and licences of every document."""
    return license_scan.scan(table(spark, sf_dir, "documents"))


def _op6_sql() -> str:
    text = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({text(s)}, {text(k)})" for s, k in license_scan.known_sentences(license_scan.SENTENCES).items())
    ordered = sorted(license_scan.RULES, key=lambda r: (-len(r[1]), r[0], r[1]))
    rules = ", ".join(f"({i}, {text(name)}, {text('|' + '|'.join(run) + '|')})" for i, (name, run) in enumerate(ordered))
    return rf"""
WITH known(s, sid) AS (VALUES {known}), rules(n, license, run) AS (VALUES {rules}),
docs AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
cut AS (SELECT r, regexp_replace(regexp_replace(regexp_replace(text, '\n[^A-Za-z0-9\n]+', chr(10), 'g'), '\n\n+', chr(1), 'g'), '[.!?;:]+([\x09-\x0D ]|\z)', chr(1) || '\1', 'g') AS t FROM docs),
split AS (SELECT r, string_split(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), chr(1)) AS p FROM cut),
pieces AS (SELECT r, unnest(p) AS raw, unnest(range(len(p))) AS i FROM split),
wholes AS (SELECT r, i, raw, trim(regexp_replace(raw, '[^a-z0-9]+', ' ', 'g')) AS s FROM pieces),
lines AS (SELECT r, i, unnest(string_split(raw, chr(10))) AS raw, unnest(range(len(string_split(raw, chr(10))))) AS j FROM wholes WHERE s NOT IN (SELECT s FROM known)),
hits AS (SELECT r, i, 0 AS j, sid FROM wholes JOIN known USING (s)
  UNION ALL SELECT r, i, j, sid FROM (SELECT r, i, j, trim(regexp_replace(raw, '[^a-z0-9]+', ' ', 'g')) AS s FROM lines) JOIN known USING (s)),
seqs AS (SELECT r, list(sid ORDER BY i, j) AS sentence_ids, '|' || string_agg(sid, '|' ORDER BY i, j) || '|' AS line FROM hits GROUP BY r),
named AS (SELECT r, list(license ORDER BY n) AS licenses FROM (SELECT r, license, min(n) AS n FROM seqs JOIN rules ON contains(line, run) GROUP BY r, license) GROUP BY r)
SELECT doc_id, coalesce(sentence_ids, []) AS sentence_ids, coalesce(licenses, []) AS licenses FROM docs LEFT JOIN seqs USING (r) LEFT JOIN named USING (r)
"""


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate class of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), size=3, budget=2)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document."""
    found = decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    counted = found.select("doc_id", "n_words", decontaminate.hit_words("spans").alias("n_hit"), F.size("items").cast("long").alias("n_items"), decontaminate.items_digest("items").alias("items_sha256"))
    return counted.withColumn("contaminated", decontaminate.is_contaminated(F.col("n_hit"), F.col("n_words")))


OP8_SQL = r"""
WITH item_words AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
windows AS (
  SELECT DISTINCT item_id, list_slice(w, i, i + 12) AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM item_words WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(win) AS m FROM windows),
doc_words AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
places AS (
  SELECT r, i, m, array_to_string(list_slice(w, i, i + m - 1), ' ') AS win
  FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM doc_words, sizes WHERE len(w) >= m)),
hits AS (SELECT r, i, m, item_id FROM places JOIN (SELECT item_id, array_to_string(win, ' ') AS win FROM windows) USING (win)),
covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + m)) AS p FROM (SELECT DISTINCT r, i, m FROM hits)) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc_words LEFT JOIN covered USING (r) LEFT JOIN named USING (r)
"""


#: Shards that op9 deals documents to.
SHARDS = [f"shard-{i:03d}" for i in range(64)]


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard of every document."""
    return sharding.place(table(spark, sf_dir, "documents"), SHARDS)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record, read back from normalised archives."""
    return warc.read(warc.archive(table(spark, sf_dir, "pages"))).withColumnRenamed("id", "page_id")


OP10_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h)) AS n, sha1(h) AS x FROM p),
f AS (SELECT x, min(page_id) AS first FROM d GROUP BY x),
b AS (SELECT page_id, n, x, CASE WHEN page_id <> first THEN first END AS refers_to,
  list_transform(range(8), lambda g: CAST('0x' || substr(x, CAST(5 * g + 1 AS BIGINT), 5) AS BIGINT)) AS five FROM d JOIN f USING (x))
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((five[CAST(i // 4 + 1 AS BIGINT)] >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31) + 1, 1)), '') AS payload_digest,
  CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to
FROM b
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_language_id, op2_substring_dedup, op3_packing, op4_url_filter, op5_ann, op6_license_scan, op7_simhash, op8_decontamination, op9_sharding, op10_warc]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op4_url_filter": OP4_SQL, "op6_license_scan": _op6_sql(), "op8_decontamination": OP8_SQL, "op10_warc": OP10_SQL}
