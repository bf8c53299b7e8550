"""Functions for SQL text: scalar and table functions whose bodies are SQL, so Catalyst sees through them."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Names, parameters, results and bodies of the functions.
SCALARS = {
    "bare_id": ("x STRING", "STRING", "nullif(substring_index(trim(x), '#', -1), '')"),
    "norm_ws": ("x STRING", "STRING", r"trim(regexp_replace(coalesce(x, ''), '\\s+', ' '))"),
    "date_precision": ("x STRING", "STRING", "CASE length(trim(x)) WHEN 10 THEN 'day' WHEN 7 THEN 'month' WHEN 4 THEN 'year' END"),
    "effective": ("a STRING, b STRING", "STRING", "coalesce(nullif(a, ''), nullif(b, ''))"),
    "dot": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)"),
}
TABLES = {
    "chunk_text": ("txt STRING, width INT, lap INT", "chunk_index INT, chunk STRING", r"""
        SELECT posexplode(CASE WHEN size(w) <= n THEN array(t) ELSE transform(sequence(0, greatest(size(w) - o - 1, 0), n - o), s -> array_join(slice(w, s + 1, n), ' ')) END) AS (chunk_index, chunk)
        FROM (SELECT filter(split(trim(regexp_replace(txt, '\\s+', ' ')), ' '), x -> x <> '') AS w, txt AS t, width AS n, lap AS o) WHERE size(w) > 0"""),
}
#: Over a view of edges (source, target, type): what is within two steps of a node at most, edges taken either way.
EGO = """
    SELECT key, min(depth) AS depth FROM (
      SELECT node AS key, 0 AS depth UNION ALL SELECT b, 1 FROM {both} WHERE a = node AND steps >= 1
      UNION ALL SELECT y.b, 2 FROM {both} x JOIN {both} y ON x.b = y.a WHERE x.a = node AND steps >= 2) GROUP BY key"""


def register(spark: SparkSession, edges: str | None = None) -> list[str]:
    """Make the functions known to the session; their names.

    With the name of a view of ``edges``, ``ego_network(node, steps)`` is a table function over it.
    """
    if edges:
        both = f"(SELECT e.a, e.b FROM (SELECT explode(array(struct(source AS a, target AS b), struct(target AS a, source AS b))) AS e FROM {edges}))"
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION ego_network(node STRING, steps INT) RETURNS TABLE(key STRING, depth INT) RETURN {EGO.format(both=both)}")
    for name, (given, result, body) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({given}) RETURNS {result} RETURN {body}")
    for name, (given, result, body) in TABLES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({given}) RETURNS TABLE({result}) RETURN {body}")
    return [*SCALARS, *TABLES, *(["ego_network"] if edges else [])]
