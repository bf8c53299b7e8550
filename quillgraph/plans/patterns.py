"""Graph patterns compiled to DataFrame joins: basic graph patterns over triples, paths over nodes and edges.

A pattern is a list of triples whose parts are variables (``?x``) or constants.  Each becomes a filter on its constants
and a projection on its variables; patterns that share variables join on them.  Catalyst picks the order and the way.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_variable(term: str) -> bool:
    return term.startswith("?")


def match_triple(triples: DataFrame, pattern: tuple[str, str, str]) -> DataFrame:
    """The rows of one triple pattern, a column per variable (named without its mark)."""
    rows, seen = triples, {}
    for column, term in zip(("s", "p", "o"), pattern):
        if not is_variable(term):
            rows = rows.where(F.col(column) == term)
        elif term in seen:
            rows = rows.where(F.col(column) == F.col(seen[term]))
        else:
            seen[term] = column
    return rows.select(*[F.col(c).alias(v[1:]) for v, c in seen.items()]) if seen else rows.select(F.lit(1).alias("__there")).limit(1)


def match(triples: DataFrame, patterns: list[tuple[str, str, str]]) -> DataFrame:
    """Solutions of a basic graph pattern.  Patterns are joined so that each shares a variable with those before it, if any does."""
    left, found, bound = list(patterns), None, set()
    while left:
        i = next((i for i, p in enumerate(left) if bound & {t for t in p if is_variable(t)}), 0)
        p = left.pop(i)
        rows, names = match_triple(triples, p), {t for t in p if is_variable(t)}
        shared = [v[1:] for v in sorted(bound & names)]
        if found is None:
            found = rows
        elif shared:
            found = found.join(rows, shared)
        else:
            raise ValueError(f"{p} shares no variable with the rest of the pattern")
        bound |= names
    if found is None:
        raise ValueError("a pattern is needed")
    return found


@dataclass
class Query:
    """A SELECT or ASK query."""

    patterns: list[tuple[str, str, str]]
    select: list[str] = field(default_factory=list)
    filters: list[str] = field(default_factory=list)
    binds: list[tuple[str, str]] = field(default_factory=list)
    count: tuple[str, str] | None = None
    group: list[str] = field(default_factory=list)
    order: list[tuple[str, bool]] = field(default_factory=list)
    limit: int | None = None
    distinct: bool = False
    ask: bool = False


_TERM = r'(?:\?\w+|<[^>]*>|"(?:[^"\\]|\\.)*"|[A-Za-z_][\w-]*:[\w./#-]*|a(?=\s))'


def _term(text: str, prefixes: dict[str, str]) -> str:
    if text == "a":
        return "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
    if text.startswith("<"):
        return text[1:-1]
    if text.startswith('"'):
        return text[1:-1].replace('\\"', '"').replace("\\\\", "\\")
    if text.startswith("?"):
        return text
    prefix, _, local = text.partition(":")
    if prefix not in prefixes:
        raise ValueError(f"unknown prefix: {prefix}")
    return prefixes[prefix] + local


def parse(text: str) -> Query:
    """A subset of SPARQL: PREFIX, SELECT [DISTINCT] or ASK, triples with ``;``, FILTER with CONTAINS and STRSTARTS,
    BIND(SUBSTR(STR(?x), n, m) AS ?y), COUNT, GROUP BY, ORDER BY, LIMIT.  Anything else is an error."""
    prefixes = dict(re.findall(r"PREFIX\s+([\w-]*):\s*<([^>]*)>", text, re.I))
    body = re.sub(r"PREFIX\s+[\w-]*:\s*<[^>]*>", "", text, flags=re.I).strip()
    head = re.fullmatch(r"(SELECT|ASK)\b(.*?)(?:WHERE\s*)?\{(.*)\}(.*)", body, re.I | re.S)
    if not head:
        raise ValueError("only SELECT and ASK with one group are known")
    kind, chosen, group, tail = head[1].upper(), head[2], head[3], head[4]
    query = Query([], ask=kind == "ASK", distinct=bool(re.search(r"\bDISTINCT\b", chosen, re.I)))
    if c := re.search(r"\(\s*COUNT\s*\(\s*(?:DISTINCT\s+)?(\?\w+|\*)\s*\)\s+AS\s+(\?\w+)\s*\)", chosen, re.I):
        query.count, chosen = (("distinct " if re.search(r"COUNT\s*\(\s*DISTINCT", c[0], re.I) else "") + c[1].lstrip("?"), c[2][1:]), chosen.replace(c[0], "")
    query.select = [v[1:] for v in re.findall(r"\?\w+", chosen)]
    for m in re.finditer(r"FILTER\s*\(\s*(CONTAINS|STRSTARTS)\s*\(\s*(?:STR\s*\(\s*)?\?(\w+)\s*\)?\s*,\s*\"([^\"]*)\"\s*\)\s*\)", group, re.I):
        quoted = m[3].replace("'", "''")
        query.filters.append(f"{'contains' if m[1].upper() == 'CONTAINS' else 'startswith'}({m[2]}, '{quoted}')")
        group = group.replace(m[0], " ")
    for m in re.finditer(r"BIND\s*\(\s*SUBSTR\s*\(\s*STR\s*\(\s*\?(\w+)\s*\)\s*,\s*(\d+)\s*,\s*(\d+)\s*\)\s+AS\s+\?(\w+)\s*\)", group, re.I):
        query.binds.append((m[4], f"substring({m[1]}, {m[2]}, {m[3]})"))
        group = group.replace(m[0], " ")
    rest = re.sub(rf"\s+|{_TERM}|[.;]", "", group)
    if rest:
        raise ValueError(f"not understood: {rest[:40]}")
    subject: list[str] = []
    for statement in re.findall(rf"(?:{_TERM}|;|\s+)+", group):
        for part in statement.split(";") if ";" in statement else [statement]:
            terms = re.findall(_TERM, part + " ")
            while terms:
                if not subject or len(terms) % 3 == 0:
                    subject = [terms.pop(0)]
                if len(terms) < 2:
                    raise ValueError(f"not a triple: {part.strip()}")
                query.patterns.append((_term(subject[0], prefixes), _term(terms.pop(0), prefixes), _term(terms.pop(0), prefixes)))
        subject = []
    if g := re.search(r"GROUP\s+BY((?:\s+\?\w+)+)", tail, re.I):
        query.group = [v[1:] for v in re.findall(r"\?\w+", g[1])]
    if o := re.search(r"ORDER\s+BY((?:\s+(?:\?\w+|(?:ASC|DESC)\s*\(\s*\?\w+\s*\)))+)", tail, re.I):
        query.order = [(m[2] or m[3], (m[1] or "").upper() == "DESC") for m in re.finditer(r"(?:(ASC|DESC)\s*\(\s*\?(\w+)\s*\)|\?(\w+))", o[1], re.I)]
    if n := re.search(r"LIMIT\s+(\d+)", tail, re.I):
        query.limit = int(n[1])
    return query


def run(triples: DataFrame, query: Query | str) -> DataFrame:
    """The query's answer; of ASK one row ``answer``."""
    q = parse(query) if isinstance(query, str) else query
    rows = match(triples, q.patterns)
    for name, expr in q.binds:
        rows = rows.withColumn(name, F.expr(expr))
    for f in q.filters:
        rows = rows.where(f)
    if q.ask:
        return rows.limit(1).agg((F.count("*") > 0).alias("answer"))
    if q.count:
        what = q.count[0].removeprefix("distinct ")
        n: Column = F.count("*") if what == "*" else F.count_distinct(what) if q.count[0].startswith("distinct ") else F.count(what)
        rows = rows.groupBy(*q.group).agg(n.alias(q.count[1])).select(*q.select, q.count[1])
    elif q.select:
        rows = rows.select(*q.select)
    if q.distinct:
        rows = rows.distinct()
    if q.order:
        rows = rows.orderBy(*[F.col(c).desc() if down else F.col(c) for c, down in q.order])
    return rows.limit(q.limit) if q.limit is not None else rows


def path(nodes: DataFrame, edges: DataFrame, labels: list[str | None], types: list[str | None], directions: list[str] | None = None) -> DataFrame:
    """Chains node-edge-node…: columns n0, e1, n1, …; labels and types may be None for any; a direction is ``out`` or ``in``."""
    def labelled(i: int) -> DataFrame:
        rows = nodes if labels[i] is None else nodes.where(F.col("type") == labels[i])
        return rows.select(F.col("key").alias(f"n{i}"))

    found = labelled(0)
    for i, kind in enumerate(types, 1):
        e = edges if kind is None else edges.where(F.col("type") == kind)
        a, b = ("source", "target") if not directions or directions[i - 1] == "out" else ("target", "source")
        found = found.join(e.select(F.col(a).alias(f"n{i - 1}"), F.col("type").alias(f"e{i}"), F.col(b).alias(f"n{i}")), f"n{i - 1}").join(labelled(i), f"n{i}")
    return found.select("n0", *[c for i in range(1, len(types) + 1) for c in (f"e{i}", f"n{i}")])


#: Words that change a graph; a text query with one of them is refused (F8).
WRITES = re.compile(r"\b(create|merge|delete|detach|set|remove|drop|load\s+csv|call)\b", re.I)


def read_only(cypher: str) -> str:
    """F8: the query if it changes nothing.  Words inside quotes don't count (Q19)."""
    if found := WRITES.search(re.sub(r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"", "''", cypher)):
        raise ValueError(f"only reading is allowed: {found[0]}")
    return cypher


_NODE = r"\(\s*(\w+)\s*(?::\s*(\w+))?\s*(?:\{\s*(\w+)\s*:\s*(?:'([^']*)'|(\w+))\s*\})?\s*\)"
_EDGE = r"\s*(<?)-\s*\[\s*(\w+)?\s*(?::\s*(\w+))?\s*\]\s*-(>?)\s*"
_CONDITION = r"(\w+)\.(\w+)\s*(=|<>|<=|>=|<|>|STARTS\s+WITH|ENDS\s+WITH|CONTAINS)\s*'([^']*)'"
_CYPHER = r"\s*(?:UNWIND\s+\[(.*?)\]\s+AS\s+(\w+)\s+)?MATCH\s+(.*?)(?:\s+WHERE\s+(.*?))?\s+RETURN\s+(.*?)(?:\s+ORDER\s+BY\s+(.*?))?(?:\s+LIMIT\s+(\d+))?\s*;?\s*"


def _compared(c: Column, sign: str, value: str) -> Column:
    """A condition of WHERE; null is never true."""
    known = {"=": c == value, "<>": c != value, "<": c < value, ">": c > value, "<=": c <= value, ">=": c >= value, "STARTS WITH": c.startswith(value), "ENDS WITH": c.endswith(value), "CONTAINS": c.contains(value)}
    return known[" ".join(sign.upper().split())]


def cypher(nodes: DataFrame, edges: DataFrame, text: str, limit: int = 100) -> DataFrame:
    """A subset of Cypher: UNWIND of a list of texts, MATCH of one path with labels and an id or other property (a text or the
    unwound variable), WHERE with comparisons of properties joined by AND, RETURN of variables (their ids),
    ``var.property``, ``labels(var)``, ``type(edge)`` and count(*), ORDER BY, LIMIT.  Anything else is an error.  Rows are
    limited to ``limit`` where the query says nothing (O8)."""
    m = re.fullmatch(_CYPHER, read_only(text), re.I | re.S)
    if not m:
        raise ValueError("only MATCH … RETURN … is known")
    listed, unwound, chain, where, returned, ordered, most = m.groups()
    at = 0
    found: list[tuple] = []
    links: list[tuple] = []
    while node := re.compile(_NODE).match(chain, at):
        found.append(node.groups())
        at = node.end()
        if edge := re.compile(_EDGE).match(chain, at):
            links.append((edge[3], "in" if edge[1] else "out", edge[2]))
            at = edge.end()
        else:
            break
    if at != len(chain.rstrip()) or len(links) != len(found) - 1:
        raise ValueError(f"not understood: {chain[at : at + 40]}")
    rows = path(nodes, edges, [n[1] for n in found], [x[0] for x in links], [x[1] for x in links])
    place = {n[0]: f"n{i}" for i, n in enumerate(found)}
    relation = {x[2]: f"e{i}" for i, x in enumerate(links, 1) if x[2]}
    column = lambda prop: F.col("key" if prop == "id" else prop)
    for i, (_, _, prop, value, variable) in enumerate(found):
        if variable:
            if variable != unwound:
                raise ValueError(f"unknown variable: {variable}")
            values = [a or b for a, b in re.findall(r"'([^']*)'|\"([^\"]*)\"", listed)]
            given = nodes.sparkSession.createDataFrame([(v,) for v in values], "value string")
            named = nodes.select(F.col("key").alias(f"n{i}"), column(prop).alias("value")).join(F.broadcast(given), "value")  # as many as the text has
            rows = rows.join(named.withColumnRenamed("value", f"_{unwound}"), f"n{i}")
        elif prop:
            rows = rows.join(nodes.where(column(prop) == value).select(F.col("key").alias(f"n{i}")), f"n{i}", "left_semi")
    if where:
        conditions = re.findall(_CONDITION, where, re.I)
        if not re.fullmatch(r"\s*#(\s+AND\s+#)*\s*", re.sub(_CONDITION, "#", where, flags=re.I), re.I):
            raise ValueError(f"not understood: {where}")
        for var, prop, sign, value in conditions:
            if var not in place:
                raise ValueError(f"unknown variable: {var}")
            rows = rows.join(nodes.where(_compared(column(prop), sign, value)).select(F.col("key").alias(place[var])), place[var], "left_semi")
    keys, counts, names = [], [], {}
    for item in re.split(r"\s*,\s*", returned):
        expr, _, name = (x.strip() for x in re.sub(r"\s+AS\s+", "\0", item, flags=re.I).partition("\0"))
        if re.fullmatch(r"count\(\s*\*\s*\)", expr, re.I):
            counts.append(F.count("*").alias(name or "count"))
            continue
        if f := re.fullmatch(r"(labels|type)\(\s*(\w+)\s*\)", expr, re.I):
            known = place if f[1].lower() == "labels" else relation
            if f[2] not in known:
                raise ValueError(f"unknown variable: {f[2]}")
            name = name or f"{f[1].lower()}_{f[2]}"
            if known is relation:
                keys.append(F.col(relation[f[2]]).alias(name))
            else:
                rows = rows.join(nodes.select(F.col("key").alias(place[f[2]]), F.array("type").alias(f"labels_{f[2]}")), place[f[2]])
                keys.append(F.col(f"labels_{f[2]}").alias(name))
            continue
        var, _, prop = expr.partition(".")
        if unwound and expr == unwound:
            keys.append(F.col(f"_{unwound}").alias(name or unwound))
            continue
        if var not in place:
            raise ValueError(f"unknown variable: {var}")
        at_ = place[var]
        if prop and prop != "id":
            rows = rows.join(nodes.select(F.col("key").alias(at_), F.col(prop).alias(f"{var}_{prop}")), at_)
            at_ = f"{var}_{prop}"
        names[expr] = name or (f"{var}_{prop}" if prop else var)
        keys.append(F.col(at_).alias(names[expr]))
    rows = rows.groupBy(*keys).agg(*counts) if counts else rows.select(*keys)
    if ordered:
        by = [(x.split()[0], x.lower().endswith(" desc")) for x in re.split(r"\s*,\s*", ordered.strip())]
        rows = rows.orderBy(*[(F.col(names.get(c, c).replace(".", "_")).desc() if down else F.col(names.get(c, c).replace(".", "_"))) for c, down in by])
    return rows.limit(int(most or limit))
