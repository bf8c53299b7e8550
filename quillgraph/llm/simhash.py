"""SimHash near-duplicate classes by a binary-trie self-join.

A text's fingerprint is the bitwise majority of the XXH64 (seed 42) of its word shingles.  Equal fingerprints collapse
to one row first, by an aggregate that combines before the shuffle, so thousands of copies cost one trie leaf.

The distinct fingerprints form a binary trie, which is joined with itself: pairs of nodes are traversed together, adding up
the bits in which their paths differ, and a pair beyond the budget is pruned with all below it.  Many fingerprints are dealt
to several tries: two that differ in two bits agree in one of three thirds of their bits, so each third has a trie for every
value of its first bits, as many as keep a trie small.  A fingerprint is in three tries, however many there are, and nothing
about them is gathered.  A trie gives a spanning forest of the links that it finds, never all pairs of a group.  Components
come from alternating large-star and small-star rounds over those links, each round written to the shared folder.

Similar documents (``similar_documents``).  Two texts whose sets of 5-word shingles have a Jaccard similarity of 0.8 differ
in about 15 % of a fingerprint's bits, a budget that prunes nothing in a trie of 64 bits.  There a fingerprint has 384
bits, cut into 20 pieces of 19 bits; each piece has its own trie, whose self-join with a budget of two bits proposes pairs,
and a pair whose whole fingerprints differ in no more bits than the similarity lets expect (58) is a link.  Were all pieces
to differ in three bits, these would be 60, so every such pair meets in one of them, however many fingerprints there are.

Defined results
* null, empty or blank text: fingerprint zero, linked like any other
* fewer words than a shingle: the whole sequence is the one shingle
* rows with equal ids: each is returned; null ids are returned and name no component (null if a class has no other id)
* an empty table gives an empty result; only the id and text columns are read
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.llm.common import ascii_lower_words, blocks_of, columns, files_for, freeing, written
from quillgraph.llm.substring_dedup import mixed, word_hashes

SEED = 42
#: Fingerprints that one trie holds; of more each third of the bits has several tries.
NODE_SIZE = 16_384
#: Pairs of trie nodes that are expanded at a time; a task holds a few such blocks for each level that it is down.
FRONTIER = 16_384
#: Nodes with so few fingerprints are compared directly.
SMALL = 4
#: 64-bit words of a wide fingerprint, and bits in which pieces of two of them may differ for the pair to be looked at.
WIDE, PIECE_BUDGET = 6, 2
#: Pieces that one trie holds; of more fingerprints each trie has a part.
TRIE_SIZE = 1 << 18
#: Bytes of text that are hashed at a time, and texts whose bits are counted together.
HASH_BYTES, HASH_TEXTS = 1 << 20, 2048
#: Pairs of nodes that are expanded at a time in the large tries of pieces.
WIDE_FRONTIER = 1 << 17
#: The bits of each byte, the highest first.
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """XXH64 of each run of ``size`` words joined by a space; of the whole sequence if it is shorter; none if empty."""
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-size])).tolist()
    return np.array([h(joined[s:e], SEED) for s, e in zip(starts, (ends[size - 1 :] - 1).tolist())], np.uint64)


def fingerprint(text: str | None, size: int = 3) -> int:
    """The 64-bit majority fingerprint, as an unsigned integer."""
    h = shingle_hashes(ascii_lower_words(text), size)
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 16_384):
        ones += np.unpackbits(h[i : i + 16_384].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """(id, fp) for every row; fp holds the 64 bits as a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t, size) for t in columns(batch, "t")[0]], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], names=["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).mapInArrow(run, "id long, fp long")


class Forest:
    """Union-find over positions 0 to n - 1; the smallest position is the root."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def union(self, a: np.ndarray, b: np.ndarray) -> None:
        """Join many pairs: hook larger roots below smaller ones and jump pointers until nothing changes."""
        up = self.up
        while len(a):
            ra, rb = up[a], up[b]
            open_ = ra != rb
            if not open_.any():
                return
            a, b = a[open_], b[open_]
            lo, hi = np.minimum(ra[open_], rb[open_]), np.maximum(ra[open_], rb[open_])
            np.minimum.at(up, hi, lo)
            while True:
                jumped = up[up]
                if np.array_equal(jumped, up):
                    break
                up[:] = jumped


def alike(low: np.ndarray, high: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Whether all labels of a range are the same."""
    changes = np.concatenate(([0], np.cumsum(label[1:] != label[:-1])))
    return changes[low] == changes[high - 1]


def near_pairs(own: np.ndarray, other: np.ndarray, budget: int, labels: Callable[[], tuple[np.ndarray, np.ndarray]] | None = None, counted: int = 64, once: bool = False, frontier: int = FRONTIER) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i, j) with own[i] and other[j] at most ``budget`` bits apart in the ``counted`` upper bits.

    Both are sorted and distinct.  ``once``: they are the same, and a pair comes once only (i <= j).

    Two tries are traversed together.  A trie node is a range of a sorted array; a pair of nodes carries the number of
    bits in which their paths differ.  ``labels`` gives the components so far of both arrays: a pair of nodes that are
    wholly in one component has nothing more to link and isn't entered, so a dense group isn't gone through pair by pair.
    """
    one = np.uint64(1)
    lower = np.uint64((1 << 64 - counted) - 1)
    todo = [(0, np.array([[0, len(own), 0, len(other), 0]], np.int64))] if len(own) and len(other) else []
    while todo:
        level, pairs = todo.pop()
        if labels is not None:
            x, y = labels()
            linked = (x[pairs[:, 0]] == y[pairs[:, 2]]) & alike(pairs[:, 0], pairs[:, 1], x) & alike(pairs[:, 2], pairs[:, 3], y)
            pairs = pairs[~linked]
            if not len(pairs):
                continue
        small = ((pairs[:, 1] - pairs[:, 0]) * (pairs[:, 3] - pairs[:, 2]) <= SMALL) | (level == 64)
        if small.any():
            now = pairs[small]
            for dx in range(int((now[:, 1] - now[:, 0]).max())):
                for dy in range(int((now[:, 3] - now[:, 2]).max())):
                    x, y = now[:, 0] + dx, now[:, 2] + dy
                    inside = (x < now[:, 1]) & (y < now[:, 3])
                    x, y = x[inside], y[inside]
                    close = np.bitwise_count((own[x] ^ other[y]) & ~lower) <= budget
                    if close.any():
                        yield x[close], y[close]
            pairs = pairs[~small]
        if not len(pairs):
            continue
        bit = one << np.uint64(63 - level)
        keep = ~np.uint64((int(bit) << 1) - 1 & (1 << 64) - 1)
        # the first position of each range that has the bit set
        xm = np.searchsorted(own, own[pairs[:, 0]] & keep | bit)
        ym = np.searchsorted(other, other[pairs[:, 2]] & keep | bit)
        xm, ym = np.clip(xm, pairs[:, 0], pairs[:, 1]), np.clip(ym, pairs[:, 2], pairs[:, 3])
        xs, ys = ((pairs[:, 0], xm), (xm, pairs[:, 1])), ((pairs[:, 2], ym), (ym, pairs[:, 3]))
        below = []
        for bx in (0, 1):
            for by in (0, 1):
                new = np.stack([*xs[bx], *ys[by], pairs[:, 4] + (bx != by and level < counted)], axis=1)
                below.append(new[(new[:, 0] < new[:, 1]) & (new[:, 2] < new[:, 3]) & (new[:, 4] <= budget) & (new[:, 0] <= new[:, 2] if once else True)])
        below = np.concatenate(below)
        todo += [(level + 1, below[i : i + frontier]) for i in range(0, len(below), frontier)]


def turned(value: np.ndarray, bits: int, by: int) -> np.ndarray:
    """Numbers of ``bits`` bits, the first ``by`` of them moved to the end."""
    if not by:
        return value
    return (value << np.uint64(by) | value >> np.uint64(bits - by)) & np.uint64((1 << bits) - 1)


def tries(n: int, bits: int, budget: int, most: int) -> tuple[int, list[int]]:
    """For ``n`` numbers of ``bits`` bits: how many first bits tell the tries apart, and the turns that a number has one for.

    Two numbers that differ in ``budget`` bits at most agree in one of ``budget`` + 1 equal parts.
    """
    part = bits // (budget + 1)
    split = min(part, max(0, (n - 1) // most).bit_length())
    return split, [i * part for i in range(budget + 1)] if split else [0]


def joined(batches: Iterator[pa.RecordBatch], solve: Callable[[pa.Table], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows arrive sorted by their first column, the trie: those of one trie meet in ``solve``."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        trie = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(trie)) + 1).tolist(), len(trie)]
        for s, e in zip(cuts, cuts[1:]):
            if held and held[-1].column(0)[0].as_py() != trie[s]:
                yield solve(pa.Table.from_batches(held).combine_chunks())
                held = []
            held.append(batch.slice(s, e - s))
    if held:
        yield solve(pa.Table.from_batches(held).combine_chunks())


def links(distinct: DataFrame, budget: int = 2, node_size: int = NODE_SIZE, n: int | None = None) -> DataFrame:
    """A spanning set of links (a, b) between distinct fingerprints (column fp) that differ in ``budget`` bits at most.

    A trie has about ``node_size`` fingerprints; ``n``: how many there are, counted if it isn't known.
    """
    split, turns = tries(distinct.count() if n is None else n, 64, budget, node_size)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            for i, by in enumerate(turns):
                v = turned(fp, 64, by)
                trie = np.full(len(v), i << split, np.int64)
                if split:
                    trie |= (v >> np.uint64(64 - split)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(trie), pa.array(fp.view(np.int64)), pa.array(np.full(len(v), by, np.int32))], names=["trie", "fp", "by"])

    def solve(got: pa.Table) -> pa.RecordBatch:
        own = np.sort(turned(got.column("fp").to_numpy().view(np.uint64), 64, by := got.column("by")[0].as_py()))
        forest = Forest(len(own))
        for i, j in near_pairs(own, own, budget, lambda: (forest.up, forest.up), once=True):
            forest.union(i, j)
        child = np.flatnonzero(forest.up != np.arange(len(own)))
        back = lambda x: pa.array(turned(x, 64, (64 - by) % 64).view(np.int64))
        return pa.RecordBatch.from_arrays([back(own[child]), back(own[forest.up[child]])], names=["a", "b"])

    dealt = distinct.select("fp").mapInArrow(deal, "trie long, fp long, by int")
    return dealt.repartition("trie").sortWithinPartitions("trie").mapInArrow(lambda batches: joined(batches, solve), "a long, b long").distinct()


def components(edges: DataFrame, files: int | None = None, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b), root being the smallest node of its component.

    Alternates large-star and small-star until the edges no longer change: a logarithmic number of rounds in practice.
    Minima combine before the shuffle and are joined back by key, so a node with very many edges is dealt by the
    optimizer's skew handling, never gathered in one task.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            both = e.union(e.select(F.col("b"), F.col("a"))).toDF("u", "v")
        else:
            both = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        joined = both.join(least, "u")
        if large:
            return joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        near = joined.select(F.col("v").alias("a"), F.col("m").alias("b"))
        return near.union(least.select(F.col("u"), F.col("m"))).toDF("a", "b").where("a <> b").distinct()

    now, before = written(edges.where("a <> b").select("a", "b"), "edges", files), None
    for _ in range(max_rounds):
        now = written(star(star(now, True), False), "edges", files)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state
    raise RuntimeError("components did not settle")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, budget: int = 2) -> DataFrame:
    """(id, fp, component_id) for every row: the smallest id reachable over links of at most ``budget`` bits."""
    prints = written(fingerprints(docs, id_col, text_col, size), "fingerprints")
    files = files_for(prints.count())
    reps = written(prints.groupBy("fp").agg(F.min("id").alias("least")), "reps", files)
    found = components(links(reps.select("fp"), budget, n=reps.count()), files)
    rooted = reps.join(found, reps.fp == found.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = rooted.join(least, "root").select("fp", "component_id")
    return prints.join(classes, "fp").select("id", "fp", "component_id")


def sketches(texts: pa.Array, size: int) -> np.ndarray:
    """A row of WIDE words for each text: the bitwise majority of its distinct shingles' hashes.  Without words: zero."""
    h, text = word_hashes(texts)
    out = np.zeros((len(texts), WIDE), np.uint64)
    if not len(h):
        return out
    begins, words = np.searchsorted(text, np.arange(len(texts) + 1)), np.bincount(text, minlength=len(texts))
    last = begins[text + 1] - size
    at = np.arange(len(h))
    start = (at <= last) | ((words[text] < size) & (at == begins[text]))  # a short text is one shingle
    at, text = at[start], text[start]
    g = np.zeros(len(at), np.uint64)
    for j in range(size):
        inside = at + j < begins[text + 1]
        g = mixed(g + np.where(inside, h[np.minimum(at + j, len(h) - 1)], 0) + np.uint64(j + 1))
    order = np.lexsort((g, text))
    g, text = g[order], text[order]
    new = np.concatenate(([True], (g[1:] != g[:-1]) | (text[1:] != text[:-1])))
    g, text = g[new], text[new]
    n = np.bincount(text, minlength=len(texts))
    for low in range(0, len(texts), HASH_TEXTS):
        high = min(len(texts), low + HASH_TEXTS)
        at, end = np.searchsorted(text, (low, high))
        base, own = (text[at:end] - low) << 8, g[at:end]
        for k in range(WIDE):
            each = mixed(own + np.uint64((k + 1) << 56)).astype(">u8").view(np.uint8).reshape(-1, 8)
            ones = np.empty((high - low, 64), np.int64)
            for byte in range(8):  # how often a text has each value of a byte, and so each of its bits
                times = np.bincount(base + each[:, byte], minlength=(high - low) << 8).reshape(-1, 256)
                ones[:, 8 * byte : 8 * byte + 8] = times @ BITS
            out[low:high, k] = np.packbits(ones * 2 > n[low:high, None], axis=1).view(">u8").astype(np.uint64).ravel()
    return out


def expected_bits(similarity: float) -> int:
    """Bits in which the wide fingerprints of two texts of this Jaccard similarity differ on average."""
    return int(64 * WIDE * math.acos(2 * similarity / (1 + similarity)) / math.pi)


def piece(wide: np.ndarray, first: int, bits: int) -> np.ndarray:
    """``bits`` bits (63 at most) of each row of WIDE words, from bit ``first`` on."""
    k, shift = divmod(first, 64)
    low = wide[:, min(k + 1, WIDE - 1)] >> np.uint64(64 - shift) if shift else np.uint64(0)
    return (wide[:, k] << np.uint64(shift) | low) >> np.uint64(64 - bits)


def similar_links(reps: DataFrame, n: int, most: int) -> DataFrame:
    """Links (a, b) between ids whose wide fingerprints differ in ``most`` bits at most, of ``reps`` (least, wide), ``n`` rows.

    There are so many pieces that two fingerprints differ in PIECE_BUDGET bits at most in one of them: no link is lost.
    Beyond TRIE_SIZE rows a piece has a trie for each value of some bits of each third of it: if two pieces differ in two
    bits, they agree in a third.  Where there are too few bits for that, a trie's rows are dealt to blocks, and every two
    blocks meet.  What an executor holds is one trie's rows, or two blocks'.
    """
    pieces = most // (PIECE_BUDGET + 1) + 1
    bits = min(63, 64 * WIDE // pieces)
    split, turns = tries(n, bits, PIECE_BUDGET, TRIE_SIZE)
    room = TRIE_SIZE << split
    blocks = 1 if n <= room else -(-2 * n // room)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wide = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint64).reshape(-1, WIDE)
            block = (mixed(batch.column(0).to_numpy().view(np.uint64)) % np.uint64(blocks)).astype(np.int64)
            for t in range(pieces):
                value = piece(wide, t * bits, bits)
                for i, by in enumerate(turns):
                    v = turned(value, bits, by)
                    trie = np.int64(t * len(turns) + i) << np.int64(split) | (v >> np.uint64(bits - split)).astype(np.int64)
                    for other in range(blocks):
                        two = (trie * blocks + np.minimum(block, other)) * blocks + np.maximum(block, other)
                        yield pa.RecordBatch.from_arrays([pa.array(two), pa.array(v.view(np.int64)), *batch.columns], names=["trie", "value", "least", "wide"])

    def solve(got: pa.Table) -> pa.RecordBatch:
        value, ids = got.column("value").to_numpy().view(np.uint64), got.column("least").to_numpy()
        wide = np.ascontiguousarray(np.frombuffer(b"".join(got.column("wide").to_pylist()), np.uint64).reshape(-1, WIDE).T)
        # equal pieces are told apart by their position, in bits that don't count; a very full trie counts fewer bits
        counted = min(bits, 64 - len(value).bit_length())
        own = value >> np.uint64(bits - counted) << np.uint64(64 - counted) | np.arange(len(value), dtype=np.uint64)
        forest = Forest(len(own))
        for i, j in near_pairs(own, own, PIECE_BUDGET, lambda: (forest.up, forest.up), counted, True, WIDE_FRONTIER):
            other = i != j
            i, j = i[other], j[other]
            differ = np.zeros(len(i), np.int16)
            for w in range(WIDE):
                differ += np.bitwise_count(wide[w][i] ^ wide[w][j])
                if w == 2:  # of unlike pairs hardly any differ in so few bits so far
                    near = differ <= most
                    i, j, differ = i[near], j[near], differ[near]
            near = differ <= most
            forest.union(i[near], j[near])
        child = np.flatnonzero(forest.up != np.arange(len(own)))
        return pa.RecordBatch.from_arrays([pa.array(ids[child]), pa.array(ids[forest.up[child]])], names=["a", "b"])

    dealt = reps.select("least", "wide").mapInArrow(freeing(deal), "trie long, value long, least long, wide binary")
    return dealt.repartition("trie").sortWithinPartitions("trie", "value", "least").mapInArrow(freeing(lambda batches: joined(batches, solve)), "a long, b long").distinct()


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, similarity: float = 0.8) -> DataFrame:
    """(id, component_id) for every row with an id: the smallest id reachable over pairs of documents of this similarity.

    The similarity of the sets of ``size``-word shingles is told from fingerprints of 384 bits, give or take 0.03.
    Texts without a word are alike; one of fewer words than a shingle is like its equals only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks_of(batches, "t", HASH_BYTES):
            wide = sketches(batch.column(1), size)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in wide], pa.binary())], names=["id", "wide"])

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).where("id is not null")
    prints = written(source.mapInArrow(freeing(run), "id long, wide binary"), "sketches")
    # a fingerprint that very many rows have is one row of the join, by its smallest id
    reps = written(prints.groupBy("wide").agg(F.min("id").alias("least")), "reps", files_for(prints.count()))
    n = reps.count()
    found = components(similar_links(reps, n, expected_bits(similarity)), files_for(n))
    classes = reps.join(found, reps.least == found.node, "left").select("wide", F.coalesce("root", "least").alias("component_id"))
    return prints.join(classes, "wide").select("id", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that stand for their class of similar documents: those with the class's smallest id.

    One row of an id stays, that with the first text in order.  Rows without an id have no class and are kept as they are.
    """
    found = similar_documents(docs, id_col, text_col, size, similarity)
    stays = found.groupBy("id").agg(F.min("component_id").alias("c")).where("id = c").select(F.col("id").alias("stays"))
    number = {c: str(i) for i, c in enumerate(docs.columns)}
    rows = docs.toDF(*number.values())  # columns go by number, so theirs can't clash with ours
    key, text = number[id_col], number[text_col]
    first = F.row_number().over(Window.partitionBy(key).orderBy(F.col(text).asc_nulls_first()))
    kept = rows.join(stays, rows[key].cast("long") == stays["stays"], "left_semi").withColumn("n", first).where("n = 1").drop("n")
    return kept.unionByName(rows.where(rows[key].isNull())).toDF(*docs.columns)
