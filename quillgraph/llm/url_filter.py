"""URL rules by a sort-merge range join, with DataFrame functions only.

A host is written as its labels in reverse, each followed by a dot: ``blog.example.com`` becomes ``com.example.blog.``.
All hosts below a rule's host then lie in one interval, from the rule's key up to the key with its last dot replaced by
``/``, which follows the dot and is in no host.  Likewise all paths that a rule's path starts lie in one interval of the
paths below the rule's host, up to the path with a byte after it that no text has.  Intervals nest.  Their ends are the
events of a sweep, which goes once, in key order, over events and what is looked up; each takes what the last event before
it has left open.

There are two sweeps.  The first goes over the distinct hosts and keeps a stack of the rules' hosts that are open: no more
than a host has labels, however many rules they have.  The second goes over the distinct paths below each of these; of the
rules' paths that are open, the innermost is the longest, so that is what an event leaves.  The longest of the rules that
a host and path has got, one below each open host, wins.

Keys are dealt by range to partitions of even size and written; each partition starts with what the ones before it have
left open, a row per partition.  Hosts and urls are distinct before they are sorted, so one with a third of all pages is
one row of the sweep; pages get their verdict back by an equality join, which the optimizer can split.

Defined results
* null url or no ``://``: empty host and path, no rule, the default verdict
* two rules of the same length that fit: the one with the longer host; the same rule twice: ``block`` wins
* repeated pages are judged each; an empty rule table gives the default verdict to all; an empty table an empty result
* urls and rules of any length are compared whole; only the id and url columns are read, others may have any name
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.llm.common import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(_after_scheme(url), r"\A([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"\A[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """Labels in reverse order, each followed by a dot."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def _above(k: str) -> Column:
    """The keys of a host and of the hosts above it."""
    labels = F.split(F.expr(f"substring({k}, 1, length({k}) - 1)"), r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.concat(F.array_join(F.slice(labels, 1, n), "."), F.lit(".")))


def _host_events(hosts: DataFrame) -> DataFrame:
    """(k, open): the rules' hosts that are open from that key on, by the distinct keys (rk) of these.

    The hosts above a rule's host whose intervals are open at its key are its prefixes, so equality finds them.
    """
    above = hosts.select("rk", F.explode(_above("rk")).alias("p"))
    open_ = above.join(hosts.select(F.col("rk").alias("p")), "p")
    stacks = open_.groupBy("rk").agg(F.array_sort(F.collect_set("p")).alias("stack"))  # as many as it has labels at most
    ends = F.struct(F.concat(F.expr("substring(rk, 1, length(rk) - 1)"), F.lit("/")).alias("k"), F.slice("stack", F.lit(1), F.size("stack") - 1).alias("open"))
    events = stacks.select(F.explode(F.array(F.struct(F.col("rk").alias("k"), F.col("stack").alias("open")), ends)).alias("e"))
    return events.select(F.col("e.k").cast("binary").alias("k"), "e.open")


def _path_key(rk: str, path: str) -> Column:
    return F.concat(F.col(rk).cast("binary"), F.unhex(F.lit("00")), F.col(path).cast("binary"))


def _path_events(rules: DataFrame) -> DataFrame:
    """(k, open): the innermost rule that is open from that key on, by distinct rules (rk, host, path, verdict)."""
    rule = F.struct("host", "path", "verdict")
    starts = rules.select(_path_key("rk", "path").alias("k"), rule.alias("open"))
    shorter = rules.select("rk", F.col("path").alias("whole"), F.explode(F.transform(F.sequence(F.lit(0), F.length("path") - 1), lambda n: F.substring(F.col("path"), F.lit(1), n))).alias("path"))
    around = shorter.where("length(path) < length(whole)").join(rules, ["rk", "path"]).groupBy("rk", "whole").agg(F.max_by(rule, F.length("path")).alias("open"))
    ends = rules.select("rk", F.col("path").alias("whole")).join(around, ["rk", "whole"], "left")
    none = F.struct(*[F.lit(None).cast("string").alias(c) for c in ("host", "path", "verdict")])
    return starts.unionByName(ends.select(F.concat(_path_key("rk", "whole"), F.unhex(F.lit("FF"))).alias("k"), F.coalesce("open", none).alias("open")))


def _swept(points: DataFrame, events: DataFrame, name: str) -> DataFrame:
    """``points`` (k and others) with ``open``: what the last of ``events`` (k, open) at or before ``k`` says; null before the first."""
    others = [c for c in points.columns if c != "k"]
    line = points.select("k", F.struct(*others).alias("point"), F.lit(None).cast(events.schema["open"].dataType).alias("open")).unionByName(events.select("k", F.lit(None).cast(points.select(F.struct(*others).alias("p")).schema["p"].dataType).alias("point"), "open"))
    dealt = written(line.repartitionByRange("k").sortWithinPartitions("k").withColumn("part", F.spark_partition_id()), name)
    # what each partition leaves open, then what those before it leave: a row per partition
    ends = dealt.where("open is not null").groupBy("part").agg(F.max_by("open", "k").alias("ends"))
    parts = dealt.groupBy("part").agg(F.lit(1).alias("one")).join(ends, "part", "left")
    before = parts.select("part", F.last("ends", True).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    # an event at a point's own key comes before the point
    sweep = Window.partitionBy("part").orderBy(F.col("k"), F.col("point").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    swept = dealt.withColumn("open", F.last("open", True).over(sweep)).where("point is not null")
    return swept.join(F.broadcast(before), "part", "left").select("point.*", F.coalesce("open", "carried").alias("open"))


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """(id, host, path, rule, verdict) for every page.  ``rules`` has host, path and verdict (allow or block)."""
    urls = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    distinct = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict")).select(host_key(F.col("host")).alias("rk"), "host", "path", "verdict")
    hosts = urls.groupBy("host").agg(F.lit(1).alias("one")).select(host_key(F.col("host")).cast("binary").alias("k"), "host")
    stacks = _swept(hosts, _host_events(distinct.select("rk").distinct()), "url-hosts").where("size(open) > 0")
    asked = written(urls.select("host", "path").distinct().join(stacks, "host").select("host", "path", F.explode("open").alias("rk")), "url-paths")
    points = asked.select("rk", "path").distinct().select(_path_key("rk", "path").alias("k"), "rk", "path")
    found = _swept(points, _path_events(distinct), "url-rules").where("open.host is not null")
    rule = F.struct((F.length("open.host") + F.length("open.path")).alias("n"), F.length("open.host").alias("h"), F.col("open.verdict").alias("verdict"), F.concat("open.host", "open.path").alias("rule"))
    best = asked.join(found, ["rk", "path"]).groupBy("host", "path").agg(F.max(rule).alias("best"))
    return urls.join(best, ["host", "path"], "left").select(F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
