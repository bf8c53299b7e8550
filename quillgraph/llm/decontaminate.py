"""Benchmark decontamination with an FM-index per training shard.

Each shard (a bounded block of documents) is indexed; every benchmark window is a pattern.  A pattern is found by
backward search: one rank query in a wavelet matrix over the Burrows-Wheeler transform per word.  Its places come from
suffix positions sampled along the text, reached by stepping backwards.  Overlapping places merge into spans.

Words that no pattern has cannot be part of an occurrence, so the text that is indexed consists of the shard's runs of
pattern words that are at least as long as the shortest pattern.  This loses nothing: an occurrence is inside a run.

Patterns come to the shards in blocks of ``block_bytes`` of benchmark text.  A block is made into flat arrays once and
broadcast; it is one pass over the documents, which adds to the spans that the passes before it found.  What a pass has
found is written before the next one begins, so a task holds one block.  A benchmark of usual size is one block, of which
nothing is written between; nothing is shuffled.

Defined results
* null or empty text, or no words: zero words, nothing hit; null and empty benchmark items have no windows
* a benchmark item of fewer words than a window is one window itself
* repeated documents are judged each; equal windows of several items count for all of them
* a document with a null id is judged like others; items with a null id are matched and named ``null``
* an empty table gives an empty result; an empty benchmark hits nothing
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import blocks_of, written

WINDOW = 13
#: Every so many text positions, the suffix array keeps its entry.
SAMPLING = 16
#: Bytes of document text in a shard.
SHARD_BYTES = 4 << 20
#: Bytes of benchmark text whose patterns are searched in one pass.
BLOCK_BYTES = 8 << 20


def _word_bytes() -> bytes:
    """Translation of UTF-8 bytes: A-Z lower-cased; what is no letter, digit or non-ASCII byte becomes a space."""
    table = bytearray(b" " * 256)
    for b in range(256):
        if b >= 0x80 or chr(b).isdigit() or chr(b).islower() and b < 0x80:
            table[b] = b
        elif b < 0x80 and chr(b).isupper():
            table[b] = b + 32
    return bytes(table)


WORD_BYTES = _word_bytes()


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split() if text else []


class Patterns:
    """Distinct windows of benchmark items, and the items that have each, in flat arrays.

    ``ids`` are the items' words, numbered from 1, one item after the other; a window is ``lengths`` words from ``starts``.
    Window ``w`` occurs in the items ``owners[bounds[w] : bounds[w + 1]]``, numbers into ``names``.
    """

    def __init__(self, items: list[tuple[object, str | None]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        self.names = ["null" if item is None else str(item) for item, _ in items]
        parts = [np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)], np.int32) for _, text in items]
        words = np.array([len(p) for p in parts], np.int64)
        number = np.where(words > 0, np.maximum(1, words - window + 1), 0)  # windows of each item
        self.ids = np.concatenate([*parts, np.zeros(window, np.int32)])
        owner = np.repeat(np.arange(len(parts)), number)
        starts = np.repeat(np.cumsum(words) - words - (np.cumsum(number) - number), number) + np.arange(number.sum())
        lengths = np.minimum(words, window)[owner]
        whole = np.where(np.arange(window) < lengths[:, None], self.ids[starts[:, None] + np.arange(window)], 0)
        _, first, same = np.unique(whole, axis=0, return_index=True, return_inverse=True)
        self.starts, self.lengths = starts[first], lengths[first]
        both = np.unique(np.stack([same.ravel(), owner], axis=1), axis=0)
        self.owners, self.bounds = both[:, 1], np.searchsorted(both[:, 0], np.arange(len(first) + 1))

    @property
    def shortest(self) -> int:
        return int(self.lengths.min()) if len(self.lengths) else 0

    def items_of(self, windows: set[int]) -> list[str]:
        return [self.names[i] for w in windows for i in self.owners[self.bounds[w] : self.bounds[w + 1]].tolist()]


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a sequence whose zeros end it piece by piece: a zero is smaller than any word, and zeros
    compare by position, so no comparison goes beyond a piece.  Ranks double in length until all differ."""
    n, zeros = len(text), text == 0
    rank = np.where(zeros, np.cumsum(zeros), text + int(zeros.sum()))
    length = 1
    while True:
        after = np.zeros(n, np.int64)
        after[: n - length] = rank[length:] + 1 if length < n else 0
        key = rank * (max(int(rank.max()), int(after.max())) + 2) + after
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
        rank, length = new, length * 2
        if int(rank.max()) == n - 1 or length > 2 * n:
            return order


class WaveletMatrix:
    """Rank of any symbol in any prefix of a sequence of small integers, in one step per bit of the alphabet."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.zeros, self.ones = bits, [], []
        now = symbols
        for b in range(bits - 1, -1, -1):
            bit = (now >> b) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit, dtype=np.int32))).astype(np.int32))
            self.zeros.append(int(len(now) - bit.sum()))
            now = np.concatenate((now[bit == 0], now[bit == 1]))

    def rank(self, symbol: np.ndarray, position: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each position."""
        start, end = np.zeros_like(position), position
        for level in range(self.bits):
            ones, set_ = self.ones[level], (symbol >> (self.bits - 1 - level)) & 1 == 1
            s, e = ones[start], ones[end]
            start = np.where(set_, self.zeros[level] + s, start - s)
            end = np.where(set_, self.zeros[level] + e, end - e)
        return end - start


class FMIndex:
    """Over a sequence of word numbers in which every piece ends with a zero."""

    def __init__(self, text: np.ndarray, alphabet: int):
        order = suffix_array(text)
        n = len(text)
        self.bwt = text[order - 1]
        self.ranks = WaveletMatrix(self.bwt, max(1, int(alphabet).bit_length()))
        self.below = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=alphabet + 1))))
        # a piece's first word is always sampled, so a walk backwards never leaves its piece
        first = np.concatenate(([True], text[:-1] == 0))
        sampled = (np.arange(n) % SAMPLING == 0) | first
        self.sampled = sampled[order]
        self.sample_at = np.concatenate(([0], np.cumsum(self.sampled)))
        self.samples = order[self.sampled]

    def step(self, row: np.ndarray) -> np.ndarray:
        symbol = self.bwt[row]
        return self.below[symbol] + self.ranks.rank(symbol, row)

    def search(self, words: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of suffixes that begin with each pattern (``lengths`` of ``words`` from ``starts``), all going backwards together."""
        low, high = np.zeros(len(lengths), np.int64), np.full(len(lengths), len(self.bwt), np.int64)
        for back in range(int(lengths.max(initial=0))):
            todo = np.flatnonzero((lengths > back) & (low < high))
            if not len(todo):
                break
            symbol = words[starts[todo] + lengths[todo] - 1 - back]
            low[todo] = self.below[symbol] + self.ranks.rank(symbol, low[todo])
            high[todo] = self.below[symbol] + self.ranks.rank(symbol, high[todo])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes, walking back to the nearest sample."""
        found, todo, steps = np.empty(len(rows), np.int64), np.arange(len(rows)), 0
        rows = rows.copy()
        while len(todo):
            there = self.sampled[rows]
            found[todo[there]] = self.samples[self.sample_at[rows[there]]] + steps
            todo, rows = todo[~there], rows[~there]
            if len(todo):
                rows = self.step(rows)
            steps += 1
        return found


def search_shard(texts: list[str | None], patterns: Patterns) -> tuple[list[int], dict[int, list[tuple[int, int, int]]]]:
    """Words of each text; for texts with occurrences, (first word, end, window number) of each."""
    counts, parts, docs, starts = [], [], [], []
    get, shortest = patterns.vocabulary.get, patterns.shortest
    for text in texts:
        words = words_of(text)
        counts.append(len(words))
        parts.append(np.fromiter((get(w, 0) for w in words), np.int32, len(words)))
    if not len(patterns.starts) or not sum(counts):
        return counts, {}
    ids = np.concatenate([np.append(p, np.int32(0)) for p in parts])
    word_of = np.concatenate([np.arange(len(p) + 1) for p in parts])
    doc_of = np.repeat(np.arange(len(parts)), [len(p) + 1 for p in parts])
    edges = np.flatnonzero(np.diff(np.concatenate(([0], (ids > 0).astype(np.int8), [0]))))
    runs = edges.reshape(-1, 2)
    runs = runs[runs[:, 1] - runs[:, 0] >= shortest]
    if not len(runs):
        return counts, {}
    sizes = runs[:, 1] - runs[:, 0] + 1  # with the zero that follows
    at = np.repeat(runs[:, 0] - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())
    index = FMIndex(ids[at].astype(np.int64), len(patterns.vocabulary))
    low, high = index.search(patterns.ids, patterns.starts, patterns.lengths)
    times = high - low
    which = np.repeat(np.arange(len(times)), times)
    if not len(which):
        return counts, {}
    rows = np.repeat(low - np.concatenate(([0], np.cumsum(times)[:-1])), times) + np.arange(times.sum())
    place = at[index.locate(rows)]
    found: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    docs, starts = doc_of[place], word_of[place]
    for d, s, w in zip(docs.tolist(), starts.tolist(), which.tolist()):
        found[d].append((s, s + int(patterns.lengths[w]), w))
    return counts, found


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans united where they overlap or touch."""
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


SPAN_TYPE = "array<struct<first:long,end:long>>"
ARROW_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))


def pattern_blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[object, str | None]]]:
    """The benchmark's items in blocks of bounded size, fetched one partition at a time; one empty block if there are none."""
    block, held, any_ = [], 0, False
    for item, text in benchmark.select(F.col(id_col), F.col(text_col)).toLocalIterator():
        size = 4 * len(text or "")
        if block and held + size > block_bytes:
            yield block
            block, held, any_ = [], 0, True
        block.append((item, text))
        held += size
    if block or not any_:
        yield block


def _searched(docs: DataFrame, text_col: str, benchmark: DataFrame, item_col: str, item_text_col: str, window: int, block_bytes: int) -> tuple[DataFrame, list[str]]:
    """``docs`` with three more columns (words, merged spans, sorted items), and the names of these.

    Each block of patterns is one narrow pass that adds to what the passes before it have found.
    """
    names = []
    for name in ("n_words", "spans", "items"):
        while name in docs.columns or name in names:
            name += "_"
        names.append(name)
    width, text_at = len(docs.columns), docs.columns.index(text_col)
    out = docs.withColumns({names[0]: F.lit(0).cast("long"), names[1]: F.expr(f"cast(array() as {SPAN_TYPE})"), names[2]: F.expr("cast(array() as array<string>)")})
    kind, before = out.schema, None
    for block in pattern_blocks(benchmark, item_col, item_text_col, block_bytes):
        if before is not None:  # one pass after the other: together they would hold all blocks
            out = written(out, "decontaminated")
            before.unpersist()
        held = before = docs.sparkSession.sparkContext.broadcast(Patterns(block, window))  # of block_bytes at most

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            patterns = held.value
            for batch in blocks_of(batches, text_col, SHARD_BYTES):
                counts, found = search_shard(batch.column(text_at).to_pylist(), patterns)
                spans, items = [None] * batch.num_rows, [None] * batch.num_rows
                for i, (old, had) in enumerate(zip(batch.column(width + 1).to_pylist(), batch.column(width + 2).to_pylist())):
                    new = found.get(i, ())
                    both = merged([(x["first"], x["end"]) for x in old] + [(s, e) for s, e, _ in new])
                    spans[i] = [{"first": s, "end": e} for s, e in both]
                    items[i] = sorted({*had, *patterns.items_of({w for _, _, w in new})})
                more = [pa.array(counts, pa.int64()), pa.array(spans, ARROW_SPANS), pa.array(items, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*batch.columns[:width], *more], names=kind.names)

        out = out.mapInArrow(run, kind)
    return out, names


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, n_words, spans, items) for every document: merged word spans inside occurrences, and the items that occur."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    found, (words, spans, items) = _searched(source, "t", benchmark, item_col, item_text_col, window, block_bytes)
    return found.select(F.col("id").alias(id_col), words, spans, items)


def hit_words(spans: str) -> Column:
    """Words inside merged spans."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["first"])


def items_digest(items: str) -> Column:
    """SHA-256 of the items' ids, comma-joined in string order; of nothing if there are none."""
    return F.sha2(F.concat_ws(",", F.array_sort(items)).cast("binary"), 256)


def is_contaminated(n_hit: Column, n_words: Column, one_in: int = 20) -> Column:
    """At least one word in ``one_in`` is inside an occurrence."""
    return (n_hit > 0) & (n_hit * one_in >= n_words)


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, one_in: int = 20, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` that aren't contaminated, all columns kept."""
    found, (words, spans, _) = _searched(docs, text_col, benchmark, item_col, item_text_col, window, block_bytes)
    return found.where(~is_contaminated(hit_words(spans), F.col(words), one_in)).select(docs.columns)
