"""Repeated passages by collinear chaining.

Seeds.  Of each document's 5-word shingles the winnowed ones are seeds: the least hash of every eight neighbours.  Every
run of twelve words that two documents share has a seed in common.  A shingle that recurs in its document is a seed once
more together with the number of its recurrence, so texts that repeat a word or a line match place by place.  Of the
40-word shingles the least hash of every eleven neighbours is a long seed: every run of fifty words that two documents
share has one in common, also where its pieces occur elsewhere before.

Matches.  A seed's occurrences are linked to its first one, in order of document id and place, never to each other, so
the links don't depend on how the rows are dealt.  A block of documents sends one occurrence of a seed to the seed's task,
which streams over its sorted rows.  The block's other occurrences are known by the document that has the first one in
the block: a row for each two documents, which meets that document's own links and takes them over.  So a passage that
very many documents share costs its seeds' tasks a row per block, and no other task more than a block's rows.

Chains.  The links of two documents are merged into runs on a diagonal, and runs into chains: in order of their place
in the one document, each run follows the best one that ends before it in both, less a cost for the gaps, which a
Fenwick tree over places in the other document gives as a prefix maximum.

Alignment.  The words around a chain are fetched for both documents.  Runs are compared word by word, gaps by their
longest common subsequence, and both ends are extended as long as that pays.  Stretches of the alignment that score best
at one word's gain against four words' loss, of at least ``min_words`` words and ``similarity``, are the passages.

The shingles' chains go first.  The links of long seeds whose words aren't all inside the passages then found are chained
and aligned after them, so they cost little where the shingles have already found all there is.

Runs.  A long seed's first occurrence may be in a document that has less than fifty words around it in common, while
others have more.  Wherever fifty words around a long seed aren't all inside passages, every run of fifty words around any
of its occurrences is linked to the run's own first occurrence.  Such a link is a passage as it stands, so every word of
every run of fifty words that an earlier document has too is in a passage.

A passage is always found in the document with the larger id; the first occurrence stays.

Defined results
* null, empty and blank texts and those of fewer than ``min_words`` words have no passages and are nobody's first
* rows with a null id take no part and are kept; rows with one id count as one document (the first row's words)
* whole copies are passages from the first word to the last; passages within one document are no repeats
* an empty table gives an empty result; only the id and text columns are read, others may have any name
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.llm.common import blocks_of, freeing, gathered, written

SHINGLE = 5
NEIGHBOURS = 8
MIN_WORDS = 50
SIMILARITY = 0.8
#: Bytes of text whose seeds are reduced together, and bytes that are hashed at a time.
BLOCK_BYTES, HASH_BYTES = 2 << 20, 1 << 20
#: Words fetched on either side of a chain.
MARGIN = 64
#: What a seed is worth to a chain, and what each word of gap costs; chains break at gaps of some forty words.
SEED_WORTH, GAP_COST = 8.0, 0.1
#: Words of a long seed, and neighbours of which one is: a run of LONG + LONG_NEIGHBOURS - 1 = 50 words has one.
LONG, LONG_NEIGHBOURS = 40, 11
#: Words of a run that has a long seed for certain.
RUN = LONG + LONG_NEIGHBOURS - 1
#: Words that the seeds of a chain must span at least to be aligned: a passage less what winnowing may leave out.
MIN_SPAN = 20
#: Gaps of more words aren't aligned: no stretch of the alignment can bridge one at a miss's loss anyway.
LARGEST_GAP = 256
MATCH, MISS = 1.0, -4.0

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS = np.cumprod(np.full(4096, 0x100000001B3, np.uint64), dtype=np.uint64)
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_LAST = np.uint64(0xFFFFFFFFFFFFFFFF)


def mixed(h: np.ndarray) -> np.ndarray:
    """Bits of 64-bit numbers spread over all places."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word (between spaces and U+0009 to U+000D, A-Z lower-cased), and the text it is in."""
    texts = pc.fill_null(texts, "")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
    if not len(ends) or not ends[-1]:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    _, offsets, data = texts.buffers()
    width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    at = int(np.frombuffer(offsets, width)[texts.offset])
    raw = np.frombuffer(data, np.uint8)[at : at + int(ends[-1])]
    inside = ~_IS_SPACE[raw]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    first = ends[:-1][ends[:-1] < len(raw)]
    start[first] = inside[first]
    starts = np.flatnonzero(start)
    if not len(starts):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    kept = _LOWER[raw[inside]].astype(np.uint64) + np.uint64(1)
    before = np.cumsum(inside)[starts] - 1  # of each word's first byte among the kept
    sizes = np.diff(np.append(before, len(kept)))
    place = (np.arange(len(kept)) - np.repeat(before, sizes)) & 4095
    return mixed(np.add.reduceat(kept * _POWERS[place], before) + sizes.astype(np.uint64)), np.searchsorted(ends, starts, "right")


def shingles(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of ``size`` of word hashes ``h``: of ``width`` words, doubled as far as that goes and overlapped for the rest."""
    g, width = h, 1
    while width < size:
        step = min(width, size - width)
        g, width = g[:-step] * _FACTORS[0] + mixed(g[step:] + np.uint64(width + step)), width + step
    return g


def seeds(h: np.ndarray, text: np.ndarray, size: int = SHINGLE, neighbours: int = NEIGHBOURS) -> tuple[np.ndarray, np.ndarray]:
    """Positions (in ``h``) and hashes of the winnowed shingles of word hashes ``h`` of consecutive texts."""
    span = size + neighbours - 1
    if len(h) < span:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    g = shingles(h, size)
    n = len(g)
    g = np.where(text[:n] == text[size - 1 :], mixed(g), _LAST)
    least, width = g, 1
    while width < neighbours:
        step = min(width, neighbours - width)
        least, width = np.minimum(least[:-step], least[step:]), width + step
    whole = text[: len(least)] == text[span - 1 :]
    chosen = np.zeros(n, bool)
    for j in range(neighbours):
        chosen[j : j + len(least)] |= whole & (g[j : j + len(least)] == least)
    at = np.flatnonzero(chosen)
    return at, g[at]


def first_links(seed: np.ndarray, doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For occurrences in order of (doc, place): positions of each seed's first ones, all in one document; of later ones in
    other documents; and of the very first that each of these has."""
    if not len(seed):
        return (np.empty(0, np.int64),) * 3
    order = np.argsort(seed, kind="stable")
    ordered = seed[order]
    new = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    first = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    other = doc[first] != doc[order]
    return order[~other], order[other], first[other]


def recurring(seed: np.ndarray, text: np.ndarray) -> np.ndarray:
    """How often each seed has occurred in its text before."""
    order = np.argsort(seed, kind="stable")
    new = np.concatenate(([True], (np.diff(seed[order]) != 0) | (np.diff(text[order]) != 0))) if len(seed) else np.empty(0, bool)
    times = np.empty(len(seed), np.int64)
    times[order] = np.arange(len(seed)) - np.maximum.accumulate(np.where(new, np.arange(len(seed)), 0))
    return times


#: Rows of a seed's first occurrence in a block; or of a document (``doc``) that shares seeds with the block's first
#: document that has them (``seed``): packed places and seeds.
SEED_KIND = "seed long, doc long, place long, packed binary"
#: Marks in a seed's place: it is a long one; there are more of it in its block.
_IS_LONG, _HAS_MORE = 1 << 31, 1 << 32
_PLACE = _IS_LONG - 1


def groups(*keys: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of equal keys."""
    if not len(keys[0]):
        return []
    new = np.zeros(len(keys[0]) - 1, bool)
    for k in keys:
        new |= k[1:] != k[:-1]
    cuts = [0, *(np.flatnonzero(new) + 1).tolist(), len(keys[0])]
    return list(zip(cuts, cuts[1:]))


def _find_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First occurrences in each block, and the others, packed by document and first document."""
    for batch in blocks_of(batches, "t", BLOCK_BYTES):
        batch = batch.take(pc.sort_indices(batch.column("id")))
        ids, hashes, owners, done = batch.column("id").to_numpy(), [], [], 0
        for part in blocks_of(iter([batch]), "t", HASH_BYTES):
            h, text = word_hashes(part.column(1))
            hashes.append(h)
            owners.append(text + done)
            done += part.num_rows
        h, text = np.concatenate(hashes), np.concatenate(owners)
        begins = np.searchsorted(text, np.arange(batch.num_rows))
        at, seed = seeds(h, text)
        again = recurring(seed, text[at])
        far, long = seeds(h, text, LONG, LONG_NEIGHBOURS)
        mark = np.repeat([0, _IS_LONG], (len(at) + (again > 0).sum(), len(far)))
        at, seed = np.concatenate((at, at[again > 0], far)), np.concatenate((seed, mixed(seed + mixed(again.astype(np.uint64)))[again > 0], mixed(long + _FACTORS[1])))
        doc, place = ids[text[at]], at - begins[text[at]] | mark
        order = np.lexsort((place & _PLACE, doc))
        seed, doc, place = seed[order].view(np.int64), doc[order], place[order]
        one, later, its_first = first_links(seed, doc, place)
        place[its_first] |= _HAS_MORE
        yield pa.RecordBatch.from_arrays([pa.array(seed[one]), pa.array(doc[one]), pa.array(place[one]), pa.nulls(len(one), pa.binary())], names=["seed", "doc", "place", "packed"])
        order = np.lexsort((place[later], doc[its_first], doc[later]))
        by, of, own, what = doc[later][order], doc[its_first][order], place[later][order], seed[later][order]
        cuts = groups(by, of)
        packed = [np.concatenate((own[s:e], what[s:e])).tobytes() for s, e in cuts]
        at = np.array([s for s, _ in cuts], np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(of[at]), pa.array(by[at]), pa.nulls(len(at), pa.int64()), pa.array(packed, pa.binary())], names=["seed", "doc", "place", "packed"])


#: ``kind`` 0: links; 1: a document's seeds that document ``of`` has before it in the block; 2: a link of such a seed of ``doc``.
MATCH_KIND = "kind int, seed long, doc long, of long, place long, of_place long, packed binary"
#: Rows that are linked at a time.
ROWS = 100_000


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows arrive sorted by (seed, doc): of a seed only its first occurrence is held."""
    held: tuple | None = None  # the last seed, and its first occurrence's document and place

    def rows(kind: int, *cols: np.ndarray | pa.Array | None) -> pa.RecordBatch:
        n = next(len(c) for c in cols if c is not None)
        types = [pa.int64()] * 5 + [pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), *(pa.nulls(n, t) if c is None else pa.array(c, t) if isinstance(c, np.ndarray) else c for c, t in zip(cols, types))], names=["kind", "seed", "doc", "of", "place", "of_place", "packed"])

    for batch in gathered(batches, ROWS):
        late = batch.filter(batch.column(3).is_valid())
        if late.num_rows:
            yield rows(1, None, late.column(1), late.column(0), None, None, late.column(3))
        batch = batch.filter(batch.column(3).is_null())
        if not batch.num_rows:
            continue
        seed, doc, place = (batch.column(i).to_numpy() for i in range(3))
        more, place = place & _HAS_MORE > 0, place & ~_HAS_MORE
        new = np.concatenate(([held is None or held[0] != seed[0]], seed[1:] != seed[:-1]))
        at = np.maximum.accumulate(np.where(new, np.arange(len(seed)), -1))
        of, of_place = doc[at], place[at]
        if held is not None:
            of, of_place = np.where(at < 0, held[1], of), np.where(at < 0, held[2], of_place)
        other = doc != of
        yield rows(0, None, doc[other], of[other], place[other], of_place[other] & _PLACE, None)
        yield rows(2, seed[more], doc[more], of[more], None, of_place[more] & _PLACE, None)
        held = (seed[-1], of[-1], of_place[-1])


LINK_KIND = "doc long, of long, place long, of_place long, packed binary"
LINK_NAMES = ["doc", "of", "place", "of_place", "packed"]


def _take_over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows arrive sorted by the first document in a block: its links, then the documents that share seeds with it there."""
    now, known, parts = None, None, []
    for batch in batches:
        first, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        out: list[tuple] = []
        for s, e in groups(first, kind):
            if first[s] != now:
                now, known, parts = first[s], None, []
            if kind[s] == 2:
                parts.append([batch.column(i).slice(s, e - s).to_numpy() for i in (2, 3, 4)])  # seed, its first document and place
                continue
            if known is None:
                seed, of, of_place = (np.concatenate(x) for x in zip(*parts))
                order = np.argsort(seed, kind="stable")
                known = (seed[order], of[order], of_place[order])
            for doc, data in zip(batch.column(3).slice(s, e - s).to_pylist(), batch.column(5).slice(s, e - s).to_pylist()):
                place, seed = np.frombuffer(data, np.int64).reshape(2, -1)
                at = np.searchsorted(known[0], seed)
                of, of_place, long = known[1][at], known[2][at], place >= _IS_LONG
                order = np.lexsort((place, of, long))
                place, of, of_place, long = (x[order] for x in (place, of, of_place, long))
                out += [(doc, int(of[x]), int(place[x]), int(of_place[x]), np.concatenate((place[x:y], of_place[x:y])).tobytes()) for x, y in groups(long, of) if of[x] != doc]
        cols = list(zip(*out)) or [()] * 5
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.binary())], names=LINK_NAMES)


def unpacked(batch: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, ...]:
    """Documents, first documents and both places of links, one by one, sorted by (doc, of, place)."""
    cols = [batch.column(i) for i in range(5)]
    if cols[4].null_count == len(cols[4]):
        return tuple(c.to_numpy() for c in cols[:4])
    doc, of, place, of_place = ([c.to_numpy()] for c in cols[:4])
    there = np.asarray(cols[4].is_valid())
    for i in np.flatnonzero(there).tolist():
        p, q = np.frombuffer(cols[4][i].as_py(), np.int64).reshape(2, -1)
        place.append(p)
        of_place.append(q)
        doc.append(np.full(len(p), doc[0][i]))
        of.append(np.full(len(p), of[0][i]))
    for x in (doc, of, place, of_place):
        x[0] = x[0][~there]
    doc, of, place, of_place = (np.concatenate(x) for x in (doc, of, place, of_place))
    order = np.lexsort((place, of, doc))
    return doc[order], of[order], place[order], of_place[order]


def linked(source: DataFrame) -> DataFrame:
    """(doc, of, place, of_place, packed): every seed's later occurrences with its first one, by (id, t); packed ones hold several."""
    dealt = source.mapInArrow(freeing(_find_seeds), SEED_KIND).repartition("seed").sortWithinPartitions("seed", "doc", F.col("place").bitwiseAND(_PLACE))
    found = written(dealt.mapInArrow(freeing(_link), MATCH_KIND), "seeds")
    is_late = F.col("kind") == 1
    ends = [F.when(is_late, F.col(a)).otherwise(F.col(b)).alias(name) for a, b, name in (("of", "doc", "first"), ("doc", "of", "other"))]
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    shared = found.where("kind > 0").select(ends[0], "kind", zero("seed"), ends[1], zero("of_place"), "packed")
    taken = shared.repartition("first").sortWithinPartitions("first", F.desc("kind"))
    return found.where("kind = 0").select(LINK_NAMES).unionAll(taken.mapInArrow(freeing(_take_over), LINK_KIND))


class PrefixMaximum:
    """Fenwick tree: the best (value, number) among positions up to one, where values only ever rise."""

    def __init__(self, n: int):
        self.best: list[tuple[float, int]] = [(float("-inf"), -1)] * (n + 1)

    def put(self, i: int, value: float, number: int) -> None:
        i += 1
        while i < len(self.best):
            if value > self.best[i][0]:
                self.best[i] = (value, number)
            i += i & -i

    def up_to(self, i: int) -> tuple[float, int]:
        i, top = i + 1, (float("-inf"), -1)
        while i > 0:
            if self.best[i][0] > top[0]:
                top = self.best[i]
            i -= i & -i
        return top


def diagonal_runs(place: np.ndarray, of_place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts in both documents and lengths in words of runs of neighbouring seeds on one diagonal."""
    order = np.lexsort((place, place - of_place))
    p, q = place[order], of_place[order]
    new = np.concatenate(([True], (np.diff(p - q) != 0) | (np.diff(p) > SHINGLE + NEIGHBOURS)))
    s = np.flatnonzero(new)
    e = np.append(s[1:], len(p)) - 1
    return p[s], q[s], p[e] - p[s] + SHINGLE


def chains(place: np.ndarray, of_place: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """Collinear chains of one pair of documents: each a list of runs (start, start in the other, words)."""
    p, q, n = diagonal_runs(place, of_place)
    order = np.lexsort((q, p))
    runs = list(zip(p[order].tolist(), q[order].tolist(), n[order].tolist()))
    ends = sorted({b + m - 1 for _, b, m in runs})
    rank = {x: i for i, x in enumerate(ends)}
    tree, score, back, waiting = PrefixMaximum(len(ends)), [0.0] * len(runs), [-1] * len(runs), []
    bounds = np.searchsorted(ends, [b for _, b, _ in runs]).tolist()
    for i, (a, b, m) in enumerate(runs):
        while waiting and waiting[0][0] < a:  # runs that have ended before this one starts
            _, j = heapq.heappop(waiting)
            aj, bj, mj = runs[j]
            tree.put(rank[bj + mj - 1], score[j] + GAP_COST * (aj + bj + 2 * mj), j)
        value, j = tree.up_to(bounds[i] - 1)
        gain = value - GAP_COST * (a + b)
        score[i], back[i] = SEED_WORTH + m, -1
        if j >= 0 and gain > 0:
            score[i], back[i] = score[i] + gain, j
        heapq.heappush(waiting, (a + m - 1, i))
    used, out = [False] * len(runs), []
    for i in sorted(range(len(runs)), key=lambda i: -score[i]):
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(runs[i])
            i = back[i]
        if chain and chain[0][0] + chain[0][2] - chain[-1][0] >= MIN_SPAN:
            out.append(chain[::-1])
    return out


CHAIN_KIND = "doc long, of long, first long, end long, of_first long, of_end long, runs array<int>"
CHAIN_NAMES = ["doc", "of", "first", "end", "of_first", "of_end", "runs"]


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows arrive sorted by (doc, of); a document's links are no more than its words."""

    def solve(t: pa.Table) -> pa.RecordBatch:
        doc, of, place, of_place = unpacked(t)
        if place[0] >= _IS_LONG:  # a long seed stands for shingles along one diagonal
            steps = np.linspace(0, LONG - SHINGLE, 4).astype(np.int64)
            doc, of = np.repeat(doc, 4), np.repeat(of, 4)
            place, of_place = (((x & _PLACE)[:, None] + steps).ravel() for x in (place, of_place))
            order = np.lexsort((place, of, doc))
            doc, of, place, of_place = (x[order] for x in (doc, of, place, of_place))
        cuts = np.concatenate(([0], np.flatnonzero((np.diff(doc) != 0) | (np.diff(of) != 0)) + 1, [len(doc)]))
        least = np.minimum.reduceat(place, cuts[:-1])
        most = np.maximum.reduceat(place, cuts[:-1])
        rows: list[tuple] = []
        for i in np.flatnonzero(most - least + SHINGLE >= MIN_SPAN).tolist():
            s, e = cuts[i], cuts[i + 1]
            for c in chains(place[s:e], of_place[s:e]):
                (a, b, _), (x, y, m) = c[0], c[-1]
                rows.append((int(doc[s]), int(of[s]), a, x + m, b, y + m, [v for run in c for v in (run[0] - a, run[1] - b, run[2])]))
        cols = list(zip(*rows)) or [()] * 7
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:6]), pa.array(cols[6], pa.list_(pa.int32()))], names=CHAIN_NAMES)

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        doc = batch.column(0).to_numpy()
        last = int(np.searchsorted(doc, doc[-1]))  # the last document may go on in the next batch
        if last or (held and held[-1].column(0)[0].as_py() != doc[0]):
            done = [*held, batch.slice(0, last)] if last else held
            yield solve(pa.Table.from_batches(done).combine_chunks())
            held = []
        held.append(batch.slice(last))
    if held:
        yield solve(pa.Table.from_batches(held).combine_chunks())


SEGMENT_KIND = "doc long, of long, first long, end long, of_first long, of_end long, runs array<int>, side int, low long, words binary"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hashed words of the chain's part of a text, and of some more on either side."""
    known, h = None, np.empty(0, np.uint32)
    for batch in blocks_of(batches, "t", HASH_BYTES):
        ids, texts, sides = batch.column("id").to_numpy(), batch.column("t"), batch.column("side").to_numpy()
        bounds = [batch.column(n).to_numpy() for n in ("first", "end", "of_first", "of_end")]
        low, words = [], []
        for i in range(batch.num_rows):
            text = texts[i]
            if known is None or known[0] != ids[i] or known[1] != text:
                known = (ids[i], text)
                h = word_hashes(texts.slice(i, 1))[0].astype(np.uint32)
            s, e = bounds[2 * sides[i]][i], bounds[2 * sides[i] + 1][i]
            low.append(max(0, s - MARGIN))
            words.append(h[low[-1] : e + MARGIN].tobytes())
        kept = [batch.column(n) for n in ("doc", "of", "first", "end", "of_first", "of_end", "runs", "side")]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(low, pa.int64()), pa.array(words, pa.binary())], names=["doc", "of", "first", "end", "of_first", "of_end", "runs", "side", "low", "words"])


def common(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of positions of a longest common subsequence."""
    if not len(a) or not len(b):
        return []
    same = a[:, None] == b[None, :]
    if not same.any():
        return []
    best = np.zeros((len(a) + 1, len(b) + 1), np.int32)
    for i in range(len(a) - 1, -1, -1):
        row = np.maximum(best[i + 1, :-1], np.where(same[i], best[i + 1, 1:] + 1, 0))
        best[i, :-1] = np.maximum.accumulate(row[::-1])[::-1]
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if same[i, j] and best[i, j] == best[i + 1, j + 1] + 1:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1, j] == best[i, j]:
            i += 1
        else:
            j += 1
    return out


def reach(same: np.ndarray) -> int:
    """How far an extension pays, given which of its words are the same."""
    if not len(same):
        return 0
    score = np.cumsum(np.where(same, MATCH, MISS))
    best = int(score.argmax())
    return best + 1 if score[best] > 0 else 0


def align(a: np.ndarray, b: np.ndarray, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """For each word of ``a`` the position of the word of ``b`` that it is aligned with and equal to, or -1."""
    to = np.full(len(a), -1, np.int64)
    x, y, m = runs[0]
    back = min(x, y)
    n = reach((a[x - back : x] == b[y - back : y])[::-1])
    i, j = x - n, y - n
    for x, y, m in [(i, j, m + n), *runs[1:]]:
        if x > i and y > j:
            if x - i == y - j and (a[i:x] == b[j:y]).mean() >= SIMILARITY:
                same = np.flatnonzero(a[i:x] == b[j:y])
                to[i + same] = j + same
            elif max(x - i, y - j) <= LARGEST_GAP:
                for p, q in common(a[i:x], b[j:y]):
                    to[i + p] = j + q
        same = np.flatnonzero(a[x : x + m] == b[y : y + m])
        to[x + same] = y + same
        i, j = x + m, y + m
    more = min(len(a) - i, len(b) - j)
    n = reach(a[i : i + more] == b[j : j + more])
    same = np.flatnonzero(a[i : i + n] == b[j : j + n])
    to[i + same] = j + same
    return to


def alike_parts(to: np.ndarray, first: int, end: int, min_words: int, similarity: float) -> list[tuple[int, int, int, int, float]]:
    """Of a stretch that isn't alike as a whole: the longest part that is, then the longest beside it, as ``passages`` has them.

    No part can bridge a gap that leaves it too few hits even with all of them, so the stretch is cut there first.
    """
    out, todo = [], [first + np.flatnonzero(to[first:end] >= 0)]
    while todo:
        at = todo.pop()
        n = len(at)
        if not n or at[-1] - at[0] + 1 < min_words:
            continue
        jump = np.maximum(np.diff(at), np.diff(to[at])) - 1
        wide = np.flatnonzero(n < similarity * (n + jump))
        if len(wide):
            todo += np.split(at, wide + 1)
            continue
        best = (0, 0, 0)
        for i in range(n):
            j = i + np.searchsorted(at[i:], at[i] + max(min_words, best[0] + 1) - 1)  # no earlier end makes it long enough
            spans = np.maximum(at[j:] - at[i], to[at[j:]] - to[at[i]]) + 1
            good = np.flatnonzero(np.arange(j - i + 1, n - i + 1) / spans >= similarity)
            if len(good):
                j += int(good[-1])
                best = (int(at[j] - at[i]) + 1, i, j + 1)
        if best[0]:
            _, i, j = best
            s, e, os, oe = int(at[i]), int(at[j - 1]) + 1, int(to[at[i]]), int(to[at[j - 1]]) + 1
            out.append((s, e, os, oe, (j - i) / max(e - s, oe - os)))
            todo += [at[:i], at[j:]]
    return out


def passages(to: np.ndarray, min_words: int, similarity: float) -> list[tuple[int, int, int, int, float]]:
    """Best-scoring stretches of an alignment: (first, end, first and end in the other, similarity)."""
    out, todo = [], [(0, len(to))]
    while todo:
        low, high = todo.pop()
        if high - low < min_words:
            continue
        score = np.concatenate(([0.0], np.cumsum(np.where(to[low:high] >= 0, MATCH, MISS))))
        gain = score[1:] - np.minimum.accumulate(score[:-1])
        end = int(gain.argmax()) + 1
        first = end - 1 - int(score[:end][::-1].argmin())
        if gain[end - 1] <= 0 or end - first < 1:
            continue
        s, e = low + first, low + end
        hit = to[s:e][to[s:e] >= 0]
        alike = len(hit) / max(e - s, int(hit[-1] - hit[0]) + 1)
        if e - s >= min_words:
            if alike >= similarity:
                out.append((s, e, int(hit[0]), int(hit[-1]) + 1, alike))
            else:  # the other document has more words between: what is alike in both goes by itself
                out += alike_parts(to, s, e, min_words, similarity)
        todo += [(low, s), (e, high)]
    return sorted(out)


PASSAGE_KIND = "doc long, first long, end long, of long, of_first long, of_end long, similarity double"


def _aligner(min_words: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows arrive sorted by chain and side: both sides of a chain follow each other."""
        own = None
        for batch in batches:
            rows = []
            keys = list(zip(*(batch.column(n).to_pylist() for n in ("doc", "of", "first", "of_first"))))
            side, low, words, runs = (batch.column(n) for n in ("side", "low", "words", "runs"))
            for i, key in enumerate(keys):
                if side[i].as_py() == 0:
                    if own is None or own[0] != key:
                        own = (key, low[i].as_py(), np.frombuffer(words[i].as_py(), np.uint32), np.array(runs[i].as_py(), np.int64))
                    continue
                if own is None or own[0] != key:
                    continue
                _, base, a, steps = own
                own = None  # further rows of one id are the same document
                steps = steps.reshape(-1, 3)
                b, of_base = np.frombuffer(words[i].as_py(), np.uint32), low[i].as_py()
                start = (key[2] - base, key[3] - of_base)
                if len(a) == len(b) and len(steps) == 1 and start[0] == start[1] and np.array_equal(a, b):
                    to = np.arange(len(a))
                else:
                    to = align(a, b, [(x + start[0], y + start[1], m) for x, y, m in steps.tolist()])
                for s, e, os, oe, alike in passages(to, min_words, similarity):
                    rows.append((key[0], base + s, base + e, key[1], of_base + os, of_base + oe, alike))
            cols = list(zip(*rows)) or [()] * 7
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:6]), pa.array(cols[6], pa.float64())], names=["doc", "first", "end", "of", "of_first", "of_end", "similarity"])

    return run


def _uncovered(before: int, size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows arrive sorted by document, its passages (without ``of``) by their start, then its links: gives the links whose
        ``size`` words, and ``before`` words before them, aren't all inside passages."""
        now, first, end = None, [], []
        for batch in batches:
            doc, at, to = (batch.column(i).to_numpy() for i in (0, 2, 3))
            link = batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero((np.diff(doc) != 0) | (link[1:] != link[:-1])) + 1).tolist(), len(doc)]
            for s, e in zip(cuts, cuts[1:]):
                if s == e:
                    continue
                if doc[s] != now:
                    now, first, end = doc[s], [], []
                if not link[s]:
                    for a, b in zip(at[s:e].tolist(), to[s:e].tolist()):
                        if end and a <= end[-1]:
                            end[-1] = max(end[-1], b)
                        else:
                            first.append(a)
                            end.append(b)
                    continue
                owner, of, place, of_place = unpacked(batch.slice(s, e - s))
                low = place & _PLACE
                inside = np.searchsorted(first, np.maximum(low - before, 0), "right") - 1
                bare = ~((inside >= 0) & (np.array([*end, 0])[inside] >= low + size))
                yield pa.RecordBatch.from_arrays([*(pa.array(x[bare]) for x in (owner, of, place, of_place)), pa.nulls(int(bare.sum()), pa.binary())], names=LINK_NAMES)

    return run


def _plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links one by one, without marks in their places."""
    for batch in batches:
        doc, of, place, of_place = unpacked(batch)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (doc, of, place & _PLACE, of_place & _PLACE)], names=LINK_NAMES[:4])


def _find_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every run of RUN words around the long seeds at ``places``, and whether its words aren't all inside the passages ``spans``."""
    for batch in blocks_of(batches, "t", HASH_BYTES):
        h, text = word_hashes(batch.column(1))
        begins = np.searchsorted(text, np.arange(batch.num_rows + 1))
        out: list[tuple] = []
        for i, (doc, places, spans) in enumerate(zip(*(batch.column(j).to_pylist() for j in (0, 2, 3)))):
            g = shingles(own, RUN) if len(own := h[begins[i] : begins[i + 1]]) >= RUN else own[:0]
            at = (np.array(places, np.int64)[:, None] - np.arange(LONG_NEIGHBOURS)).ravel()
            at = np.unique(at[(at >= 0) & (at < len(g))])
            first, end = (np.array([x[k] for x in spans or ()], np.int64) for k in ("first", "end"))
            first, end = first[order := np.argsort(first, kind="stable")], np.maximum.accumulate(end[order])
            new = np.flatnonzero(np.concatenate(([True], first[1:] > end[:-1]))) if len(first) else order
            first, end = first[new], end[np.append(new[1:], len(end)) - 1] if len(new) else end
            inside = np.searchsorted(first, at, "right") - 1
            out.append((g[at].view(np.int64), np.full(len(at), doc, np.int64), at, ~((inside >= 0) & (np.append(end, 0)[inside] >= at + RUN))))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names=["run", "doc", "place", "bare"])


def shared_runs(source: DataFrame, far: DataFrame, known: DataFrame, min_words: int) -> DataFrame:
    """Passages word by word the same, along the runs of RUN words that aren't all inside the ``known`` ones.

    ``far``: the links of long seeds.  Two documents that share a run share a long seed of it; all its occurrences are
    known by the first one, which every link names.  A run's first occurrences combine before the shuffle.
    """
    spans = known.select("doc", F.lit(None).cast("long"), "first", "end", F.lit(None).cast("binary"))
    loose = far.unionAll(spans).repartition("doc").sortWithinPartitions("doc", "of", "place").mapInArrow(freeing(_uncovered(RUN - LONG, RUN)), LINK_KIND)
    seed = written(loose.select("of", F.col("of_place").bitwiseAND(_PLACE).alias("of_place")).distinct(), "loose")
    all_links = far.mapInArrow(freeing(_plain), "doc long, of long, place long, of_place long")
    at = all_links.join(seed, ["of", "of_place"], "left_semi").select("doc", "place").unionAll(seed)
    around = at.groupBy("doc").agg(F.collect_set("place").alias("places")).join(known.groupBy("doc").agg(F.collect_list(F.struct("first", "end")).alias("spans")), "doc", "left")
    texts = source.join(around, F.col("id") == F.col("doc")).groupBy("id").agg(F.min("t").alias("t"), F.first("places").alias("places"), F.first("spans").alias("spans"))
    runs = written(texts.mapInArrow(freeing(_find_runs), "run long, doc long, place long, bare boolean"), "runs")
    first = runs.groupBy("run").agg(F.min(F.struct("doc", "place")).alias("at")).select("run", F.col("at.doc").alias("of"), F.col("at.place").alias("of_place"))
    links = runs.where("bare").join(first, "run").where("doc <> of").withColumn("line", F.col("place") - F.col("of_place"))
    line = Window.partitionBy("doc", "of", "line").orderBy("place")
    new = (F.col("place") - F.lag("place").over(line) > RUN).cast("int")
    parts = links.withColumn("new", F.coalesce(new, F.lit(0))).withColumn("n", F.sum("new").over(line))
    whole = parts.groupBy("doc", "of", "line", "n").agg(F.min("place").alias("first"), (F.max("place") + RUN).alias("end"))
    return whole.where(F.col("end") - F.col("first") >= min_words).select("doc", "first", "end", "of", (F.col("first") - F.col("line")).alias("of_first"), (F.col("end") - F.col("line")).alias("of_end"), F.lit(1.0).alias("similarity"))


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(doc, first, end, of, of_first, of_end, similarity): the word spans of each document that repeat an earlier one's."""
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).where("id is not null")
    chain = ["doc", "of", "first", "of_first"]

    def aligned(links: DataFrame, chain_up: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
        """Passages along the chains of links that are sorted by (doc, of, place) within their document's partition."""
        dealt = links.repartition("doc").sortWithinPartitions("doc", "of", "place")
        sides = dealt.mapInArrow(freeing(chain_up), CHAIN_KIND).withColumn("side", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("key", F.when(F.col("side") == 0, F.col("doc")).otherwise(F.col("of")))
        segments = sides.join(source, F.col("key") == F.col("id")).mapInArrow(freeing(_cut), SEGMENT_KIND)
        return segments.repartition(*chain).sortWithinPartitions(*chain, "side", "low", "words").mapInArrow(freeing(_aligner(min_words, similarity)), PASSAGE_KIND).distinct()

    links = linked(source)
    known = written(aligned(links.where(F.col("place") < _IS_LONG), _chain), "passages")
    far = written(links.where(F.col("place") >= _IS_LONG), "far")
    both = far.unionAll(known.select("doc", F.lit(None).cast("long"), "first", "end", F.lit(None).cast("binary")))
    # one function, so a task has one Python worker
    more = aligned(both, lambda batches: _chain(_uncovered(0, LONG)(batches)))
    known = written(known.unionAll(more).distinct(), "passages")
    return known.unionAll(shared_runs(source, far, known, min_words))


WORD = re.compile(rb"[^\x09-\x0D ]+")


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """A text without the words of merged, ordered spans; what is between other words stays."""
    raw = text.encode("utf-8", "surrogatepass")
    bounds = [m.span() for m in WORD.finditer(raw)]
    out, at = [], 0
    for first, end in spans:
        if first >= len(bounds):
            break
        out.append(raw[at : bounds[first][0]])
        at = bounds[min(end, len(bounds)) - 1][1]
    return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass").strip(" \t\n\r\v\f")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, similarity: float = SIMILARITY, chars_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with repeated passages cut out of all but the first document; rows with no words left go.

    Rows without a repeat are as they were.  ``chars_col`` is set to the new length where a text has changed.
    """
    found = repeats(docs, id_col, text_col, min_words, similarity)
    by = found.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("first", "end"))).alias("spans")).toDF("doc", "spans")
    text_at, chars_at = docs.columns.index(text_col), docs.columns.index(chars_col) if chars_col in docs.columns else None
    width, names = len(docs.columns), docs.columns
    numbered = docs.toDF(*map(str, range(width)))  # columns go by number, so theirs can't clash with ours
    joined = numbered.join(by, numbered[str(docs.columns.index(id_col))] == by["doc"], "left").drop("doc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols, spans = batch.columns, batch.column(width)
            changed = np.flatnonzero(spans.is_valid().to_numpy(zero_copy_only=False)).tolist()
            if not changed:
                yield pa.RecordBatch.from_arrays(cols[:width], names=names)
                continue
            texts, keep = cols[text_at].to_pylist(), np.ones(batch.num_rows, bool)
            for i in changed:
                if texts[i] is not None:
                    united: list[list[int]] = []
                    for x in spans[i].as_py():
                        if united and x["first"] <= united[-1][1]:
                            united[-1][1] = max(united[-1][1], x["end"])
                        else:
                            united.append([x["first"], x["end"]])
                    texts[i] = without(texts[i], united)
                    keep[i] = bool(texts[i])
            cols[text_at] = pa.array(texts, cols[text_at].type)
            if chars_at is not None:
                chars = cols[chars_at].to_pylist()
                for i in changed:
                    chars[i] = None if texts[i] is None else len(texts[i])
                cols[chars_at] = pa.array(chars, cols[chars_at].type)
            yield pa.RecordBatch.from_arrays(cols[:width], names=names).filter(pa.array(keep))

    return joined.mapInArrow(freeing(run), docs.schema)
