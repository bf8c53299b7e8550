"""The property graph as two DataFrames, nodes (key, type, label, date) and edges (source, target, type).

Traversals are joins on edge ends.  Seeds are literals or small DataFrames; a frontier is a DataFrame like any other.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.scalars import blank_to_null, pair_key

#: Letters that a letter's context has in one run; a multiple of eight, as Parquet packs values by eights.
RUN = 128
#: Tasks that give out all letters' contexts, at least.
TASKS = 256


def build_edges(letters: DataFrame, mentions: DataFrame, works: DataFrame | None = None, witnesses: DataFrame | None = None) -> DataFrame:
    """Edges as the records have them, repeated and dangling ones included.

    letters (id, sender, recipient, place), mentions (letter_id, entity_id), works (id, author_key, place_key),
    witnesses (id, work_key).  A relation is there only where its key is.
    """
    def edge(df: DataFrame, source: str, target: str, kind: str) -> DataFrame:
        filled = df.where(blank_to_null(F.col(target).cast("string")).isNotNull())
        return filled.select(F.col(source).cast("string").alias("source"), F.col(target).cast("string").alias("target"), F.lit(kind).alias("type"))

    roles = F.explode(F.array(*[F.struct(F.col(c).alias("target"), F.lit(t).alias("type")) for c, t in (("sender", "SENT_BY"), ("recipient", "SENT_TO"), ("place", "SENT_FROM"))]))
    out = [letters.select(F.col("id").cast("string").alias("source"), roles.alias("e")).select("source", "e.target", "e.type").where("coalesce(target, '') <> ''"), edge(mentions, "letter_id", "entity_id", "MENTIONS")]
    if works is not None:
        out += [edge(works, "id", "author_key", "AUTHORED_BY"), edge(works, "id", "place_key", "PUBLISHED_AT")]
    if witnesses is not None:
        out.append(edge(witnesses, "id", "work_key", "WITNESS_OF"))
    return reduce(DataFrame.unionByName, out)


def merged_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Each edge once, and only where both ends are nodes."""
    keys = nodes.select("key")
    return edges.dropDuplicates(["source", "target", "type"]).join(keys.withColumnRenamed("key", "source"), "source", "left_semi").join(keys.withColumnRenamed("key", "target"), "target", "left_semi").select("source", "target", "type")


def build_nodes(letters: DataFrame, entities: dict[str, DataFrame]) -> DataFrame:
    """Nodes of letters (id, date) and of each kind of entity (id, label)."""
    out = [letters.select(F.col("id").cast("string").alias("key"), F.lit("Letter").alias("type"), F.lit(None).cast("string").alias("label"), "date")]
    out += [df.select(F.col("id").cast("string").alias("key"), F.lit(kind).alias("type"), "label", F.lit(None).cast("string").alias("date")) for kind, df in entities.items()]
    return reduce(DataFrame.unionByName, out)


def counts(df: DataFrame, by: str = "type") -> DataFrame:
    """Nodes by label, or edges by type."""
    return df.groupBy(by).agg(F.count("*").alias("n"))


def neighbors(edges: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """The other ends of a node's edges, out-going first, a row per edge."""
    out = edges.where(F.col("source") == key).select(F.col("target").alias("key"), F.col("type").alias("edge_type"), F.lit("out").alias("direction"))
    inn = edges.where(F.col("target") == key).select(F.col("source").alias("key"), F.col("type").alias("edge_type"), F.lit("in").alias("direction"))
    return out.unionByName(inn).join(nodes.select("key", "type", "label"), "key", "left").select("key", "edge_type", "direction", "type", "label")


def shared_mentions(mentions: DataFrame, seeds: DataFrame | None = None, least: int = 2, letter: str = "letter_id", entity: str = "entity_id") -> DataFrame:
    """(letter, other, shared): entities that two letters both mention, from ``least`` on.

    Mentions are distinct on both sides.  Without ``seeds`` each pair of letters is counted once and then given both
    ways; with them (a column of letters) only the seeds' side is paired.  Letters with fewer than ``least`` mentions
    pair with nothing and go first.  Counts combine before the shuffle, and adaptive
    execution splits the join of an entity that very many letters mention; the pairs themselves are the result.
    """
    m = mentions.select(F.col(letter).alias("letter"), F.col(entity).alias("entity")).distinct()
    if least > 1:
        m = m.withColumn("n", F.count("*").over(Window.partitionBy("letter"))).where(F.col("n") >= least).drop("n")
    other = m.select(F.col("letter").alias("other"), "entity")
    count = lambda pairs: pairs.groupBy("letter", "other").agg(F.count("*").alias("shared")).where(F.col("shared") >= least)
    if seeds is not None:
        own = m.join(seeds.select(F.col(seeds.columns[0]).alias("letter")).distinct(), "letter", "left_semi")
        return count(own.join(other, "entity").where("letter <> other"))
    once = count(m.join(other, "entity").where("letter < other"))
    both = F.explode(F.array(F.struct("letter", "other", "shared"), F.struct(F.col("other").alias("letter"), F.col("letter").alias("other"), "shared")))
    return once.select(both.alias("p")).select("p.*")


def correspondence_context(letters: DataFrame, seeds: DataFrame | None = None, days: int = 90, partial_dates: bool = False) -> DataFrame:
    """(letter, other, days_apart): letters of the same two correspondents within ``days``.

    Dates are of day precision; with ``partial_dates`` (Q2) a month or a year stands for its first day.

    The unordered pair is the equality key.  Dates are dealt to windows of ``days`` and a letter meets its own and the
    two neighbouring windows, so a pair with very many letters is spread over its years; the distance is checked on top.
    With ``seeds`` (a column of letters) their side alone is paired, row by row.  Without, see ``_all_context``.
    """
    date = F.substring("date", 1, 10)
    if partial_dates:
        date = F.when(date.rlike(r"\A[0-9]{4}\z"), F.concat(date, F.lit("-01-01"))).when(date.rlike(r"\A[0-9]{4}-[0-9]{2}\z"), F.concat(date, F.lit("-01"))).otherwise(date)
    day = F.try_to_date(date, "yyyy-MM-dd")
    rows = letters.select("id", pair_key(F.col("sender"), F.col("recipient")).alias("pair"), day.alias("day")).where("pair is not null and day is not null").withColumn("w", F.floor(F.unix_date("day") / max(1, days)).cast("int"))
    if seeds is None:
        return _all_context(rows, days)
    own = rows.join(seeds.select(F.col(seeds.columns[0]).alias("id")).distinct(), "id", "left_semi")
    left = own.select(F.col("id").alias("letter"), "pair", F.col("day").alias("d"), F.explode(F.array(F.col("w") - 1, F.col("w"), F.col("w") + 1)).alias("w"))
    right = rows.select(F.col("id").alias("other"), "pair", F.col("day").alias("e"), "w")
    apart = F.abs(F.date_diff("d", "e"))
    return left.join(right, ["pair", "w"]).where((F.col("letter") != F.col("other")) & (apart <= days)).select("letter", "other", apart.alias("days_apart"))


def _all_context(rows: DataFrame, days: int) -> DataFrame:
    """Every letter's context, from rows (id, pair, day, w).

    A pair's letters of a window are one row.  It meets itself and, in both directions, the next window's, for which it
    is dealt to two keys in one shuffle; letters are read once and pairs of them come out of arrays after the last
    shuffle, in at least ``TASKS`` tasks, as they are very many more than the letters.  They come ``RUN`` others at a
    time for each letter in order of days: runs and repetitions are what keeps such a result small in a file.
    """
    blocks = rows.groupBy("pair", "w").agg(F.array_sort(F.collect_list(F.struct("day", "id"))).alias("block"))
    none = F.lit(None).cast(blocks.schema["block"].dataType)
    roles = F.explode(F.array(F.struct("w", F.col("block").alias("own"), none.alias("next")), F.struct((F.col("w") - 1).alias("w"), none.alias("own"), F.col("block").alias("next"))))
    tasks = max(TASKS, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    both = blocks.select("pair", roles.alias("r")).select("pair", "r.*").repartition(tasks, "pair", "w").groupBy("pair", "w").agg(F.first("own", True).alias("own"), F.first("next", True).alias("next"))
    meet = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"))
    sides = both.where("own is not null").select(F.explode(F.array(meet("own", "own"), meet("own", "next"), meet("next", "own"))).alias("s")).where("s.a is not null and s.b is not null")
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size("s.b") - 1) / RUN).cast("int")), lambda i: F.slice("s.b", i * RUN + 1, RUN))
    pairs = sides.select(F.col("s.a").alias("a"), F.explode(runs).alias("b")).select("b", F.explode("a").alias("l")).select("l", F.explode("b").alias("o"))
    apart = F.abs(F.date_diff("l.day", "o.day"))
    return pairs.where((F.col("l.id") != F.col("o.id")) & (apart <= days)).select(F.col("l.id").alias("letter"), F.col("o.id").alias("other"), apart.alias("days_apart"))


def ego_depths(edges: DataFrame, key: str, depth: int = 2) -> DataFrame:
    """(key, depth) of everything within ``depth`` steps of a node, edges taken either way.

    A step joins the frontier with the edges once; what a node is reached by is the least depth, so no step has to look
    at what was reached before.  The plan has the edges once for each step.
    """
    both = edges.select(F.explode(F.array(F.struct(F.col("source").alias("a"), F.col("target").alias("b")), F.struct(F.col("target").alias("a"), F.col("source").alias("b")))).alias("e")).select("e.a", "e.b")
    reached = edges.sparkSession.range(1).select(F.lit(key).alias("key"), F.lit(0).alias("depth"))
    for d in range(1, depth + 1):
        if d == 1:
            step = both.where(F.col("a") == key).select(F.col("b").alias("key"), F.lit(1).alias("depth"))
            reached = reached.unionByName(step).groupBy("key").agg(F.min("depth").alias("depth"))
            continue
        # a node hands itself on, and one more step to its neighbours: one join instead of one for each set
        hops = both.join(reached.select(F.col("key").alias("a"), "depth"), "a").select(F.explode(F.array(F.struct(F.col("b").alias("key"), (F.col("depth") + 1).alias("depth")), F.struct(F.col("a").alias("key"), "depth"))).alias("h"))
        alone = edges.sparkSession.range(1).select(F.lit(key).alias("key"), F.lit(0).alias("depth"))  # a node without edges
        reached = hops.select("h.key", "h.depth").unionByName(alone).groupBy("key").agg(F.min("depth").alias("depth"))
    return reached


def ego_nodes(edges: DataFrame, nodes: DataFrame, key: str, depth: int = 2) -> DataFrame:
    """Known nodes within ``depth`` steps, with their distance."""
    return ego_depths(edges, key, depth).join(nodes, "key").select("key", "type", "label", "depth")


def ego_edges(edges: DataFrame, key: str, depth: int = 2) -> DataFrame:
    """Each edge once that touches a node nearer than ``depth``."""
    inner = ego_depths(edges, key, depth - 1).select(F.col("key").alias("end"))
    ends = edges.select("source", "target", "type", F.explode(F.array_distinct(F.array("source", "target"))).alias("end"))
    return ends.join(inner, "end", "left_semi").select("source", "target", "type").distinct()


def nearest_ego_nodes(found: DataFrame, limit: int = 80) -> DataFrame:
    """The nodes to draw: the nearest ones."""
    return found.orderBy("depth", "key").limit(limit)


def ring_layout(found: DataFrame, spacing: float = 1.0) -> DataFrame:
    """Nodes on circles around the first, one circle for each distance (for the few nodes that are drawn)."""
    ring = Window.partitionBy("depth")
    i, n = F.row_number().over(ring.orderBy("key")) - 1, F.count("*").over(ring)
    angle = F.lit(2.0) * F.pi() * i / n
    return found.select("key", "depth", F.round(F.col("depth") * spacing * F.cos(angle), 6).alias("x"), F.round(F.col("depth") * spacing * F.sin(angle), 6).alias("y"))


def resolve(nodes: DataFrame, name: str) -> DataFrame:
    """The node meant by a text: by id, else by label, else by a label that contains it; one row at most."""
    low = F.lower("label")
    rank = F.when(F.col("key") == name, 0).when(low == name.lower(), 1).when(F.contains(low, F.lit(name.lower())), 2)
    return nodes.withColumn("rank", rank).where("rank is not null").orderBy("rank", "label", "key").limit(1).select("key", "type", "label", "rank")


def letter_record(letters: DataFrame, mentions: DataFrame, key: object, most: int = 25) -> DataFrame:
    """A letter with its first mentions in order of id, and how many there are."""
    one = letters.where(F.col("id") == key)
    m = mentions.where(F.col("letter_id") == key).select("entity_id").distinct()
    listed = m.orderBy("entity_id").limit(most).agg(F.array_sort(F.collect_list("entity_id")).alias("mentions"))
    return one.crossJoin(F.broadcast(listed)).crossJoin(F.broadcast(m.agg(F.count("*").alias("n_mentions"))))


