"""Language identification by word-first backoff.

A word that was seen in training scores by its log frequency in every language.  An unseen word falls back to its
character n-grams, from the longest length that knows any of them down to single characters.  The scores of a text's
words add up; the posterior of the best language is the score.

Training reads a bounded sample of labelled rows (``max_train_docs``) and keeps a bounded vocabulary (``max_words``)
that all labels share alike; n-grams are counted over all words of the sample.  Every text is then predicted whole.

Defined results
* text null, empty or without a letter: ``und`` with score 0.0
* no labelled row to learn from: ``und`` with score 0.0 for every row
* labelled rows with null or letterless text teach nothing; null ids are kept and predicted like others
* repeated rows are predicted each; ties between languages go to the first in alphabetical order
* only the named id, text and label columns are read, so other columns may have any name
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.llm.common import columns, freeing, written

#: Runs of letters (and of numerals that are not decimal digits, which carry no letter by themselves).
WORD = re.compile(r"[^\W\d_]+")
UNDETERMINED = "und"
#: Longest and shortest character n-grams that unseen words fall back to.
LONGEST, SHORTEST = 5, 1
#: Unseen words whose fallback a worker remembers at a time.
REMEMBERED = 20_000


def words_of(text: str | None) -> list[str]:
    """Lower-cased words of a text; none if it has no letter."""
    words = WORD.findall(text.lower()) if text else []
    return words if any(c.isalpha() for w in words for c in w) else []


def grams(word: str, n: int) -> list[str]:
    """Character n-grams of a word with a mark at either end; single characters go without marks."""
    marked = f"\x02{word}\x03" if n > 1 else word
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


class Table:
    """Log frequencies of known pieces of text in every language: a row number by piece, and a matrix of rows."""

    def __init__(self, counts: dict[str, dict[str, int]], smoothing: float, most: int | None):
        total: Counter[str] = Counter()
        for c in counts.values():
            total.update(c)
        known = [x for x, _ in sorted(total.items(), key=lambda kv: (-kv[1], kv[0]))[:most]]
        self.row = {x: i for i, x in enumerate(known)}
        share = np.array([[c.get(x, 0) + smoothing for c in counts.values()] for x in known]).reshape(len(known), len(counts))
        all_ = np.array([sum(c.values()) + smoothing * max(1, len(known)) for c in counts.values()])
        self.logs = np.log(share / all_).astype(np.float32)


class Model:
    """Per-language log frequencies of words and character n-grams."""

    def __init__(self, counts: dict[str, dict[str, int]] | None = None, gram_counts: dict[int, dict[str, dict[str, int]]] | None = None, max_grams: int | None = None, smoothing: float = 0.5, state: dict | None = None):
        if state is not None:  # plain containers, as broadcast
            self.__dict__.update(state)
            return
        counts = {k: (counts or {})[k] for k in sorted(counts or {})}
        self.langs = list(counts)
        words = Table(counts, smoothing, sum(map(len, counts.values())))
        self.words, self.word_logs = words.row, words.logs
        self.grams: dict[int, dict[str, int]] = {}
        logs, held = [np.zeros((0, len(counts)), np.float32)], 0
        for n in range(SHORTEST, LONGEST + 1):
            by_lang = (gram_counts or {}).get(n, {})
            table = Table({lang: by_lang.get(lang, {}) for lang in counts}, smoothing, max_grams)
            self.grams[n] = {g: held + i for g, i in table.row.items()}
            logs.append(table.logs)
            held += len(table.row)
        self.gram_logs = np.concatenate(logs)

    def unseen(self, word: str) -> list[int]:
        """Rows of the longest n-grams of ``word`` that are known; none if none is."""
        for n in range(LONGEST, SHORTEST - 1, -1):
            get = self.grams[n].get
            if found := [i for g in grams(word, n) if (i := get(g)) is not None]:
                return found
        return []

    def predict(self, text: str | None, memo: dict[str, list[int]]) -> tuple[str, float]:
        """The best language and its posterior.  A known word adds its log frequencies, an unseen one the mean of its n-grams'."""
        words = words_of(text)
        if not words or not self.langs:
            return UNDETERMINED, 0.0
        get = self.words.get
        rows = np.array([get(w, -1) for w in words], np.int64)
        new = rows < 0
        total = self.word_logs[rows[~new]].sum(axis=0, dtype=np.float64)
        pieces: list[list[int]] = []
        for i in np.flatnonzero(new).tolist():
            word = words[i]
            found = memo.get(word)
            if found is None:
                if len(memo) >= REMEMBERED:
                    memo.clear()
                found = memo[word] = self.unseen(word)
            if found:
                pieces.append(found)
        if pieces:
            sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
            total += np.repeat(1.0 / sizes, sizes) @ self.gram_logs[list(chain.from_iterable(pieces))]
        p = np.exp(total - total.max())
        best = int(total.argmax())
        return self.langs[best], float(p[best] / p.sum())


def fit(train: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", max_train_docs: int = 20_000, max_words: int = 200_000, max_grams: int | None = None) -> Model:
    """Learn a model from labelled rows.

    ``max_train_docs``: about so many rows at most are learnt from, taken by a hash of the id over the whole table.
    ``max_words``: so many (label, word) pairs at most are kept, each label's most frequent ones in turn; rarer words are unseen.
    ``max_grams``: so many n-grams of each length at most are kept, the most frequent ones; all if None.
    """
    rows = train.select(F.col(id_col).alias("k"), F.col(text_col).alias("t"), F.col(label_col).alias("l")).where("t is not null and l is not null")
    there = rows.select("l").count()
    if there > max_train_docs:
        rows = rows.where(F.pmod(F.xxhash64("k"), F.lit(1 << 20)) < int(max_train_docs / there * (1 << 20)) + 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[str, Counter[str]] = defaultdict(Counter)

        def out() -> pa.RecordBatch:
            flat = [(lang, w, n) for lang, c in by.items() for w, n in c.items()]
            by.clear()
            return pa.RecordBatch.from_pydict({"l": [x[0] for x in flat], "w": [x[1] for x in flat], "n": pa.array([x[2] for x in flat], pa.int64())}, schema=pa.schema([("l", pa.string()), ("w", pa.string()), ("n", pa.int64())]))

        for batch in batches:
            for text, lang in zip(*columns(batch, "t", "l")):
                by[lang].update(words_of(text))
            if sum(map(len, by.values())) > 200_000:
                yield out()
        yield out()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[tuple[str, int], Counter[str]] = defaultdict(Counter)
            for lang, word, times in zip(*columns(batch, "l", "w", "n")):
                for size in range(SHORTEST, LONGEST + 1):
                    c = by[lang, size]
                    for g in grams(word, size):
                        c[g] += times
            flat = [(lang, size, g, n) for (lang, size), c in by.items() for g, n in c.items()]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in flat], t) for i, t in enumerate((pa.string(), pa.int32(), pa.string(), pa.int64()))], names=["l", "size", "g", "n"])

    words = written(rows.select("t", "l").mapInArrow(freeing(count), "l string, w string, n long").groupBy("l", "w").agg(F.sum("n").alias("n")), "words")
    turn = F.row_number().over(Window.partitionBy("l").orderBy(F.desc("n"), "w"))
    found = words.withColumn("turn", turn).where(F.col("turn") <= max_words).orderBy("turn", "l").limit(max_words).select("l", "w", "n").toArrow()
    counted = words.mapInArrow(freeing(pieces), "l string, size int, g string, n long").groupBy("l", "size", "g").agg(F.sum("n").alias("n")).toArrow()
    counts: dict[str, dict[str, int]] = {lang: {} for lang in counted.column("l").unique().to_pylist()}
    for lang, word, n in zip(*(found.column(i).to_pylist() for i in range(3))):
        counts[lang][word] = n
    gram_counts: dict[int, dict[str, dict[str, int]]] = defaultdict(lambda: defaultdict(dict))
    for batch in counted.to_batches():
        for lang, size, g, n in zip(*(batch.column(i).to_pylist() for i in range(4))):
            gram_counts[size][lang][g] = n
    return Model(counts, gram_counts, max_grams)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) for every row of ``docs``; the model is of bounded size and is broadcast."""
    held = docs.sparkSession.sparkContext.broadcast(model.__dict__)
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, memo = Model(state=held.value), {}
        for batch in batches:
            got = [m.predict(t, memo) for t in columns(batch, "t")[0]]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=[id_col, "lang_pred", "score"])

    return docs.select(F.col(id_col), F.col(text_col).alias("t")).mapInArrow(freeing(run), f"`{id_col}` {kind.simpleString()}, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model, min_score: float = 0.3) -> DataFrame:
    """The rows of ``docs`` (with columns ``text`` and ``lang``) whose language is determined with a posterior of at least
    ``min_score``, all columns kept.

    The bound is low on purpose: what has any evidence for a language stays, what has none goes.
    ``lang`` becomes the predicted language.
    """
    held = docs.sparkSession.sparkContext.broadcast(model.__dict__)
    text_at, lang_at = docs.columns.index("text"), docs.columns.index("lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, memo = Model(state=held.value), {}
        for batch in batches:
            got = [m.predict(t, memo) for t in batch.column(text_at).to_pylist()]
            keep = pa.array([lang != UNDETERMINED and score >= min_score for lang, score in got], pa.bool_())
            yield batch.set_column(lang_at, "lang", pa.array([g[0] for g in got], pa.string())).filter(keep)

    return docs.mapInArrow(freeing(run), docs.schema)
