"""Passages, lines, spans, terms: operators on running text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.scalars import context_window


def chunk_text(docs: DataFrame, size: int = 300, overlap: int = 60, key: str = "letter_id", text: str = "text") -> DataFrame:
    """(key, chunk_index, text): windows of words; a text of one window stays as it is written."""
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be shorter than the window")
    words = F.filter(F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " "), lambda w: w != "")
    step = size - overlap
    rows = docs.select(F.col(key), F.col(text).alias("t"), words.alias("w")).where("size(w) > 0")
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - overlap - 1, F.lit(0)), F.lit(step))
    chunks = F.when(F.size("w") <= size, F.array("t")).otherwise(F.transform(starts, lambda s: F.array_join(F.slice("w", s + 1, F.lit(size)), " ")))
    return rows.select(key, F.posexplode(chunks).alias("chunk_index", "text"))


def char_windows(docs: DataFrame, size: int = 1500, overlap: int = 120, key: str = "letter_id", text: str = "text") -> DataFrame:
    """(key, start, text): windows of characters with their offset."""
    n = F.length(text)
    starts = F.sequence(F.lit(0), n - 1, F.lit(max(1, size - overlap)))
    return docs.where(n > 0).select(F.col(key), F.col(text).alias("t"), F.explode(starts).alias("start")).select(key, "start", F.substring("t", F.col("start") + 1, F.lit(size)).alias("text"))


#: What parts words, and what words are terms: of letters only, three at least.
NOT_TERM, TERM = r"[^\p{L}\p{N}_]+", r"\A\p{L}{3,}\z"


def tfidf_top_terms(docs: DataFrame, group: str, key: str, text: str = "text", k: int = 10, max_df: float = 0.9, stopwords: list[str] | None = None) -> DataFrame:
    """(group, term, weight, rank): terms by their mean weight over a group's documents.

    Smoothed inverse document frequency, documents scaled to length one; terms in more than ``max_df`` of all documents
    go.  Everything is an aggregate on (document, term), (term) or (group, term), but for a document's length, a window.
    """
    words = F.explode(F.split(F.lower(F.col(text)), NOT_TERM))
    rows = docs.select(F.col(key).alias("d"), F.col(group).alias("g"), words.alias("term")).where(F.col("term").rlike(TERM))
    if stopwords:
        rows = rows.where(~F.col("term").isin(stopwords))
    n = docs.agg(F.count("*").alias("n"))
    sizes = docs.groupBy(F.col(group).alias("g")).agg(F.count("*").alias("docs"))
    tf = rows.groupBy("g", "d", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n)).where(F.col("df") <= F.col("n") * max_df).select("term", (F.log((F.lit(1) + F.col("n")) / (F.lit(1) + F.col("df"))) + 1).alias("idf"))
    weighted = tf.join(df, "term").select("g", "d", "term", (F.col("tf") * F.col("idf")).alias("w"))
    scaled = weighted.withColumn("len", F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("d"))))
    mean = scaled.groupBy("g", "term").agg(F.sum(F.col("w") / F.col("len")).alias("s")).join(sizes, "g").select("g", "term", F.round(F.col("s") / F.col("docs"), 9).alias("weight"))
    rank = F.row_number().over(Window.partitionBy("g").orderBy(F.desc("weight"), "term"))
    return mean.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("g").alias(group), "term", "weight", "rank")


def cluster_entities(clusters: DataFrame, mentions: DataFrame, k: int = 5) -> DataFrame:
    """A10: (cluster, entity_id, letters, rank): what a cluster's letters mention most; clusters (letter_id, cluster)."""
    n = clusters.join(mentions.distinct(), "letter_id").groupBy("cluster", "entity_id").agg(F.count("*").alias("letters"))
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("letters"), "entity_id"))
    return n.withColumn("rank", rank).where(F.col("rank") <= k)


def dedup_spans(spans: DataFrame, key: str = "letter_id") -> DataFrame:
    """Spans of several models, each (start, end, label, text) once with its best score."""
    return spans.groupBy(key, "start", "end", "label", "text").agg(F.max("score").alias("score"))


def first_spans(spans: DataFrame, n: int, key: str = "letter_id") -> DataFrame:
    """The first spans of each model."""
    return spans.withColumn("rank", F.row_number().over(Window.partitionBy(key, "model").orderBy("start", "end", "label"))).where(F.col("rank") <= n)


def with_context(spans: DataFrame, texts: DataFrame, width: int = 60, key: str = "letter_id") -> DataFrame:
    """Spans with the characters around them."""
    joined = spans.join(texts.select(key, F.col("text").alias("__t")), key)
    return joined.withColumn("context", context_window(F.col("__t"), F.col("start"), F.col("end"), width)).drop("__t")


def unique_entities(spans: DataFrame) -> DataFrame:
    """Distinct (text, label), organisations then called persons."""
    return spans.select("text", "label").distinct().withColumn("label", F.when(F.col("label") == "ORG", "PER").otherwise(F.col("label")))


def line_stream(lines: DataFrame, doc: str = "doc", page: str = "page", order: str = "line_no", text: str = "text", mark: str = "¬") -> DataFrame:
    """Lines with the number on their page and whether a word goes on from the line before, across pages."""
    w = Window.partitionBy(doc).orderBy(page, order)
    goes_on = F.coalesce(F.contains(F.lag(text).over(w), F.lit(mark)), F.lit(False))
    return lines.select(doc, page, order, text, F.row_number().over(Window.partitionBy(doc, page).orderBy(order)).alias("n"), goes_on.alias("break_no"), F.row_number().over(w).alias("position"))


def tei_lines(stream: DataFrame, doc: str = "doc", page: str = "page", text: str = "text") -> DataFrame:
    """Each line as markup: a page break before a page's first line, a line break before every line."""
    lb = F.when(F.col("break_no"), F.lit('<lb break="no"/>')).otherwise(F.lit("<lb/>"))
    pb = F.when(F.col("n") == 1, F.concat(F.lit('<pb n="'), F.col(page).cast("string"), F.lit('"/>'))).otherwise(F.lit(""))
    escaped = F.replace(F.replace(F.replace(F.replace(F.col(text), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit("¬"), F.lit(""))
    return stream.select(doc, page, "position", F.concat(pb, lb, escaped).alias("line"))


def plain_text(stream: DataFrame, doc: str = "doc", text: str = "text") -> DataFrame:
    """(doc, plain_text, joined_text): lines joined by spaces; and with divided words whole again."""
    rows = stream.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("position", F.col(text).alias("t"), "break_no"))).alias("l"))
    plain = F.array_join(F.transform("l", lambda x: F.replace(x["t"], F.lit("¬"), F.lit(""))), " ")
    pieces = F.transform("l", lambda x: F.concat(F.when(x["break_no"], F.lit("")).otherwise(F.lit(" ")), F.regexp_replace(x["t"], r"¬\s*\z", "")))
    return rows.select(doc, plain.alias("plain_text"), F.trim(F.array_join(pieces, "")).alias("joined_text"))


def page_line_counts(lines: DataFrame, doc: str = "doc", page: str = "page") -> DataFrame:
    """Lines of each page and of all pages of a document."""
    by = lines.groupBy(doc, page).agg(F.count("*").alias("lines"))
    return by.join(by.groupBy(doc).agg(F.sum("lines").alias("total")), doc)


def inverted_index(docs: DataFrame, key: str = "id", fields: dict[str, float] | None = None) -> DataFrame:
    """(term, key, tf, boost): words of the named fields, each with its field's boost."""
    fields = fields or {"title": 2.0, "text": 1.0}
    parts = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.lit(b).alias("boost"), F.filter(F.split(F.lower(F.coalesce(f, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "").alias("w")) for f, b in fields.items()]))
    return docs.select(F.col(key), parts.alias("p")).select(key, "p.field", "p.boost", F.explode("p.w").alias("term")).groupBy("term", key, "field", "boost").agg(F.count("*").alias("tf"))


def fulltext_search(index: DataFrame, query: str, key: str = "id", fuzzy: float = 0.15, limit: int | None = 25) -> DataFrame:
    """(key, hits, score): rows with a word that begins with a query word, or is within ``fuzzy`` of its length in edits.

    The best ``limit`` rows in order; all of them, in no order, if it is None.

    The vocabulary is matched, not the texts; a row's score adds boosted, damped term counts, less for inexact words.
    """
    words = [w for w in query.lower().split() if w]
    vocabulary = index.select("term").distinct()
    match = F.array_compact(F.array(*[F.when(F.startswith("term", F.lit(w)) | (F.levenshtein("term", F.lit(w)) <= round(fuzzy * len(w))), F.struct(F.lit(w).alias("q"), F.when(F.col("term") == w, 1.0).when(F.startswith("term", F.lit(w)), 0.7).otherwise(0.45).alias("weight"))) for w in words]))
    terms = vocabulary.select("term", F.explode(match).alias("m")).select("term", "m.q", "m.weight")
    hits = index.join(terms, "term")
    scored = hits.groupBy(key).agg(F.count_distinct("q").alias("hits"), F.round(F.sum(F.col("weight") * F.col("boost") * F.log(F.lit(1.0) + F.col("tf"))), 6).alias("score"))
    return scored if limit is None else scored.orderBy(F.desc("hits"), F.desc("score"), key).limit(limit)


def search_index(parts: dict[str, DataFrame]) -> DataFrame:
    """Records of several kinds (id, title, date, text, url) in one table."""
    out = None
    for kind, df in parts.items():
        cols = {c: F.lit(None).cast("string") for c in ("title", "date", "text", "url") if c not in df.columns}
        row = df.withColumns(cols).select(F.lit(kind).alias("kind"), F.col("id").cast("string").alias("id"), "title", "date", "text", "url")
        out = row if out is None else out.unionByName(row)
    return out


def splice(spans: DataFrame, texts: DataFrame, key: str = "letter_id") -> DataFrame:
    """Texts with marks put around their spans (start, end, tag); spans of a text don't overlap.

    A text is put together from its pieces between the spans, so no offset has to be shifted.
    """
    ordered = spans.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "end", "tag"))).alias("s"))
    joined = texts.select(key, "text").join(ordered, key, "left")
    before = lambda x, i: F.when(i == 0, F.lit(0)).otherwise(F.try_element_at(F.col("s"), i)["end"])
    piece = F.transform("s", lambda x, i: F.concat(F.substring("text", before(x, i) + 1, x["start"] - before(x, i)), F.lit("<"), x["tag"], F.lit(">"), F.substring("text", x["start"] + 1, x["end"] - x["start"]), F.lit("</"), x["tag"], F.lit(">")))
    rest = F.substring("text", F.element_at("s", -1)["end"] + 1, F.length("text"))
    return joined.select(key, F.when(F.coalesce(F.size("s"), F.lit(0)) > 0, F.concat(F.array_join(piece, ""), rest)).otherwise(F.col("text")).alias("text"))


def clusters_substitute(vectors: DataFrame, k: int = 8, key: str = "letter_id", seed: int = 7) -> DataFrame:
    """T4 stand-in: (key, cluster, x, y).  Two principal components and bisecting k-means take the place of the
    manifold projection and density clustering, for which there is no library here; the results aren't the same."""
    from pyspark.ml.clustering import BisectingKMeans
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = vectors.select(key, array_to_vector("v").alias("features"))
    flat = PCA(k=2, inputCol="features", outputCol="xy").fit(rows).transform(rows)
    found = BisectingKMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(rows).transform(flat)
    return found.select(key, "cluster", vector_to_array("xy").alias("xy")).select(key, "cluster", F.col("xy")[0].alias("x"), F.col("xy")[1].alias("y"))
