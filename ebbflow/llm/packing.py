"""Best-fit packing of documents into sequences (operator 1).

Best-fit decreasing depends on piece lengths alone, and there are at most
``capacity`` of them. So the counts per length (at most ``capacity`` rows, the
only thing the driver sees) are packed on the driver by a segment tree over
remaining capacities: for the next length it finds the tightest open bin in
logarithmic time, and since a bin just used is the tightest again while it still
fits, equal pieces and equal bins are placed as runs. The plan is a bounded list
of runs (length, first rank, pieces a bin, first bin, offset). Each piece's rank
among those of its length comes from its rank inside its block (counted while
the block is written) plus the counts of earlier blocks; then the plan gives its
bin and offset. No task sees more than its own rows, however many have one length.

Results: null or empty text is one piece of the end id; repeated rows are packed
separately; an empty table gives no pieces. The pieces table is written once, so
ranks stay as they are when a task is run again.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ebbflow.llm.common import id_text, materialize, row_chunks
from ebbflow.llm.tokens import WordTokenizer

PIECES = "doc_id long, piece int, start long, length long, ids array<int>, block int, block_rank long"


class CapacityTree:
    """Counts of open bins by remaining capacity, as a segment tree."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.size)

    def add(self, remaining: int, n: int) -> None:
        at = self.size + remaining
        while at:
            self.tree[at] += n
            at //= 2

    def tightest(self, length: int) -> int | None:
        """The least remaining capacity of at least ``length`` that an open bin has."""
        at = self.size + length
        if not self.tree[at]:
            while at > 1 and (at % 2 or not self.tree[at + 1]):
                at //= 2
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at *= 2
                if not self.tree[at]:
                    at += 1
        return at - self.size


def best_fit_plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, pieces a bin, first bin, offset of the first piece)."""
    tree, bins = CapacityTree(capacity), defaultdict(list)
    plan, next_bin = [], 0
    for length in sorted(counts, reverse=True):
        rank, count = 0, counts[length]
        while rank < count:
            room = tree.tightest(length)
            if room is None:
                room = capacity
                each = room // length
                lo, hi = next_bin, next_bin + max(1, (count - rank) // each)
                next_bin = hi
            else:
                each = room // length
                lo, hi = bins[room].pop()
                tree.add(room, lo - hi)
            each_here = min(each, count - rank)
            n = min(hi - lo, (count - rank) // each_here)
            if lo + n < hi:  # the rest of the run stays open as it was
                bins[room].append((lo + n, hi))
                tree.add(room, hi - lo - n)
            plan.append((length, rank, each_here, lo, capacity - room))
            rank += n * each_here
            left = room - each_here * length
            if left:
                bins[left].append((lo, lo + n))
                tree.add(left, n)
    return plan


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """Writes and returns the pieces of each document's ids (the end id included)."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        block, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        words, end = WordTokenizer.at(tokenizer), np.array([end_id], "<u4").tobytes()
        for batch in row_chunks(batches):
            ids = [x + end for x in words.encode(batch.column("text").to_pylist())]
            total = np.array([len(x) // 4 for x in ids], dtype=np.int64)
            n = -(-total // capacity)
            doc = np.repeat(np.arange(len(ids)), n)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
            start = piece * capacity
            length = np.minimum(capacity, total[doc] - start)
            order = np.argsort(length, kind="stable")
            by_length = length[order]
            first = np.searchsorted(by_length, by_length)
            rank = np.empty(len(doc), np.int64)
            rank[order] = np.arange(len(doc)) - first
            rank += seen[length]
            seen += np.bincount(length, minlength=capacity + 1)
            offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
            flat = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(ids))])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start),
                 pa.array(length), pa.ListArray.from_arrays(pa.array(offsets), flat),
                 pa.array(np.full(len(doc), block, np.int32)), pa.array(rank)],
                names=["doc_id", "piece", "start", "length", "ids", "block", "block_rank"])

    return materialize(id_text(docs).mapInArrow(cut, PIECES), "pieces")


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows with ``length``, ``block`` and ``block_rank``,
    the row's place (from 0) among those of its length in its block."""
    counts = pieces.groupBy("length", "block").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("length", "block", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    lengths = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    if any(not 0 < n <= capacity for n in lengths):
        raise ValueError("piece lengths must be from 1 to the capacity")
    plan = sorted(best_fit_plan(lengths, capacity))
    length, rank, each, first, offset = (np.array([p[i] for p in plan], np.int64) for i in range(5))
    key = (length << 44) + rank

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("length").to_numpy()
            r = batch.column("_before").to_numpy() + batch.column("block_rank").to_numpy()
            run = np.searchsorted(key, (n << 44) + r, side="right") - 1
            j = r - rank[run]
            columns = [batch.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(first[run] + j // each[run]), pa.array(offset[run] + j % each[run] * n)],
                names=[*kept, "sequence_id", "offset"])

    kept = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    types = {f.name: f.dataType.simpleString() for f in pieces.schema.fields}
    schema = ", ".join(f"`{c}` {types[c]}" for c in kept)
    return (pieces.drop("sequence_id", "offset").join(before, ["length", "block"])
            .mapInArrow(place, f"{schema}, sequence_id long, offset long"))


def sequences(pieces: DataFrame, placed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the packed sequences, from the pieces with ids and their places."""
    entry = F.struct("offset", "ids")
    key = ["block", "length", "block_rank"]  # one row each, whatever the ids are
    return (pieces.select(*key, "ids").join(placed.select(*key, "sequence_id", "offset"), key)
            .groupBy("sequence_id").agg(F.array_sort(F.collect_list(entry)).alias("_parts"))  # at most capacity ids
            .select("sequence_id", F.flatten(F.transform("_parts", lambda p: p.ids)).alias("ids")))
