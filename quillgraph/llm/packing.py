"""Variable-capacity best-fit packing of documents into training sequences.

Several sequence lengths are permitted, each with a cost: by default its tokens, the attention over them, which grows with
the square of the length, and a fixed part.  Pieces are placed longest first.  A piece goes into the open bin in which it
leaves the least room.  If none has room, a bin is opened, and the lengths compete for it: each is tried on the pieces
that are still to be placed, and the one whose cost is least for each token that it would hold is opened.  When
everything is placed, each bin is downsized to the cheapest permitted length that holds its contents.

Documents longer than the longest permitted length are cut into pieces of that length and a rest.  Only (id, length)
rows are shuffled: equal ones are counted and numbered, and each is dealt by a hash of id, length and number to a pack of
about ``pack_docs`` documents, so neither the layout of the files nor a task that is run again changes the plan.  Each
pack is packed by itself.  No document's text moves; the result says which words of it go where.

Defined results
* null, empty or blank texts have no tokens and are in no bin
* repeated rows are packed each; null ids are packed and returned as null
* ties go to the bin that was opened first and to the shorter length; equal lengths are placed in order of id, null ids first
* an empty table gives an empty result; only the id and text columns are read
"""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Permitted sequence lengths in tokens.
LENGTHS = (512, 1024, 2048, 4096)
#: Documents in a pack.  More make the packing a little tighter, and a task larger.
PACK_DOCS = 50_000


def default_cost(length: int) -> float:
    """A sequence costs its tokens, its attention (at 8,192 tokens as much as the rest) and a fixed part for being one more."""
    return length + length * length / 8192 + 32.0


def count_words(text: str | None) -> int:
    """Tokens of a text where no tokenizer is named: its words."""
    return len(text.split()) if text else 0


class OpenBins:
    """Bins by free room: the fullest that still has room for a piece is found by bisection over distinct rooms."""

    def __init__(self) -> None:
        self.rooms: list[int] = []
        self.bins: dict[int, list[int]] = {}

    def add(self, room: int, number: int) -> None:
        if room not in self.bins:
            bisect.insort(self.rooms, room)
            self.bins[room] = []
        bisect.insort(self.bins[room], -number)

    def take(self, size: int) -> tuple[int, int] | None:
        """Room and number of the best-fitting bin, taken out; the one opened first among equals."""
        at = bisect.bisect_left(self.rooms, size)
        if at == len(self.rooms):
            return None
        room = self.rooms[at]
        number = -self.bins[room].pop()
        if not self.bins[room]:
            del self.bins[room], self.rooms[at]
        return room, number


def would_hold(room: int, negated: list[int], start: int) -> int:
    """Tokens that a bin's room takes of the sizes from ``start`` on, the largest that fits first; sizes fall and are negated."""
    held, i, n = 0, start, len(negated)
    while room > held and i < n:
        i = bisect.bisect_left(negated, held - room, i, n)
        if i < n:
            held -= negated[i]
            i += 1
    return held


def best_fit(sizes: list[int], lengths: tuple[int, ...] = LENGTHS, cost: Callable[[int], float] = default_cost) -> tuple[list[tuple[int, int]], list[int]]:
    """Pack pieces of 1 to max(lengths) tokens.  Returns (bin, offset) of each piece and the final length of each bin."""
    permitted, free = sorted(set(lengths)), OpenBins()
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    negated = [-sizes[i] for i in order]
    placed: list[tuple[int, int]] = [(0, 0)] * len(sizes)
    used: list[int] = []
    for at, i in enumerate(order):
        size = sizes[i]
        if (got := free.take(size)) is None:
            # what of all that is left a bin of each length would hold decides what a token in it costs
            room = min((x for x in permitted if x >= size), key=lambda x: (cost(x) / (size + would_hold(x - size, negated, at + 1)), x))
            number = len(used)
            used.append(0)
        else:
            room, number = got
        placed[i] = (number, used[number])
        used[number] += size
        if room > size:
            free.add(room - size, number)
    final = [min((x for x in permitted if x >= u), key=lambda x: (cost(x), x)) for u in used]
    return placed, final


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lengths: tuple[int, ...] = LENGTHS, cost: Callable[[int], float] = default_cost, count: Callable[[str | None], int] = count_words, pack_docs: int = PACK_DOCS) -> DataFrame:
    """(pack, bin, capacity, used, id, piece, first_token, n_tokens, at_token), a row for each piece of each document."""
    longest = max(lengths)
    kind = docs.schema[id_col].dataType.simpleString()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([count(t) for t in batch.column(1).to_pylist()], pa.int64())], names=["id", "n"])

    rows = docs.select(F.col(id_col)).count()
    packs = max(1, -(-rows // pack_docs))
    sized = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(measure, f"id {kind}, n long").where("n > 0")
    # rows with one id and length are interchangeable: counted before the shuffle, then dealt each
    numbered = sized.groupBy("id", "n").count().select("id", "n", F.explode(F.sequence(F.lit(1), F.col("count"))).alias("number"))
    dealt = numbered.withColumn("pack", F.pmod(F.xxhash64("id", "n", "number"), F.lit(packs)).cast("int")).drop("number").repartition(packs, "pack").sortWithinPartitions("pack", "id", "n")

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def solve() -> pa.RecordBatch:
            got = pa.Table.from_batches(held).combine_chunks()
            number, n = got.column("pack")[0].as_py(), got.column("n").to_numpy()
            pieces = -(-n // longest)
            doc = np.repeat(np.arange(len(n)), pieces)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            first = piece * longest
            size = np.minimum(longest, n[doc] - first)
            placed, final = best_fit(size.tolist(), lengths, cost)
            at_bin, at = np.array([p[0] for p in placed], np.int64), np.array([p[1] for p in placed], np.int64)
            used = np.bincount(at_bin, weights=size, minlength=len(final)).astype(np.int64)
            cols = [pa.array(np.full(len(doc), number, np.int32)), pa.array(at_bin), pa.array(np.array(final, np.int64)[at_bin]), pa.array(used[at_bin]), got.column("id").take(pa.array(doc)).combine_chunks(), pa.array(piece), pa.array(first), pa.array(size), pa.array(at)]
            return pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in cols], names=["pack", "bin", "capacity", "used", "id", "piece", "first_token", "n_tokens", "at_token"])

        for batch in batches:
            if not batch.num_rows:
                continue
            packs_here = batch.column("pack").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(packs_here)) + 1).tolist(), len(packs_here)]
            for s, e in zip(cuts, cuts[1:]):
                if held and held[-1].column("pack")[0].as_py() != packs_here[s]:
                    yield solve()
                    held.clear()
                held.append(batch.slice(s, e - s))
        if held:
            yield solve()

    out = dealt.mapInArrow(fill, f"pack int, bin long, capacity long, used long, id {kind}, piece long, first_token long, n_tokens long, at_token long")
    return out.withColumnRenamed("id", id_col)


def sequences(docs: DataFrame, plan: DataFrame, id_col: str = "doc_id", text_col: str = "text", split: Callable[[str], list[str]] = str.split, separator: str = " ") -> DataFrame:
    """(pack, bin, capacity, used, text): the sequences of a plan, their documents' tokens fetched from ``docs``.

    ``docs`` has one row for each id, and ``split`` gives the tokens that the plan has counted.  Only the rows of one
    sequence meet; pieces of a document without an id can't be fetched and are left out.
    """
    pieces = plan.where(F.col(id_col).isNotNull()).select("pack", "bin", "capacity", "used", F.col(id_col).alias("id"), "first_token", "n_tokens", "at_token")
    source = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(n).to_pylist() for n in ("t", "first_token", "n_tokens")))
            cut = [separator.join(split(t)[first : first + n]) for t, first, n in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(cut, pa.string())], names=["pack", "bin", "capacity", "used", "at", "cut"])

    met = pieces.join(source, pieces["id"] == source["doc"]).select("pack", "bin", "capacity", "used", F.col("at_token").alias("at"), "t", "first_token", "n_tokens")
    parts = met.mapInArrow(run, "pack int, bin long, capacity long, used long, at long, cut string")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "cut"))), lambda x: x["cut"]), separator)
    return parts.groupBy("pack", "bin", "capacity", "used").agg(joined.alias("text"))
