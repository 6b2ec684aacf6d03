"""Repeated byte strings, removed from every document (operator 8).

A byte is removed if a string of ``length`` bytes that covers it starts anywhere
else too, in the same document or another, as the input stands. Equal strings are
found around shared anchors, and extended there by a hash-compared sort:

1. ``_runs``: each window of ``length`` bytes has one anchor, its ``k``-mer of least
   hash (the leftmost), so equal windows have equal anchors at equal places. The
   windows of an anchor are one run of starts, and the run's bytes, from the first
   window's begin to the last one's end, have a 128-bit hash.
2. ``_status``: rows are dealt by anchor. Runs whose whole bytes occur twice repeat
   throughout; runs whose anchor occurs once do not repeat; copies inside a block of
   rows are counted before they are dealt, so an anchor that very many copies share
   is one row per block.
3. The other runs send their bytes to their anchor's task (one run of each kind of
   equal bytes). There, prefix polynomial hashes give the hash of any substring at
   once, and a binary search over the places of the window relative to the anchor
   decides where a run repeats: runs are sorted (a stable mergesort) by the hash of
   the extension all places of a range share, runs alone there drop out; those whose
   extension over the whole range is equal to another's repeat at every place; the
   rest goes on with either half. Equal hashes are verified byte by byte. So a run
   takes as many comparisons as the logarithm of its length for each end of a match.
4. Anchors of more than ``HOT_RUNS`` different runs are not gathered: their windows
   are counted by hash, one row per window.
5. The repeats of each document are united and its remaining bytes joined.

Suffixes are compared relative to anchors instead of in one array of all suffixes,
which would shuffle every byte's suffix; the strings found are the same.

Results: (doc_id, th, n_bytes, spans, kept) per row, ``th`` the hash of the text;
``spans`` are begin and end (exclusive) of the maximal removed runs in bytes, one
after another, and ``kept`` the remaining bytes. Null texts are empty; texts shorter
than ``length`` keep everything; equal rows repeat each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ebbflow.llm.common import id_text, materialize, row_chunks, utf8

STEP = 1 << 20
BLOCK_BYTES = 24 << 20
BATCH_RUNS = 4000
HOT_RUNS = 10_000
_B = np.uint64(0x9E3779B97F4A7C15)
_B_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    for i, base in enumerate((_B, _B_INVERSE)):
        if len(_POWERS[i]) < n:
            p = np.full(max(n, 1 << 16), base, np.uint64)
            p[0] = 1
            _POWERS[i] = np.multiply.accumulate(p)
    return _POWERS


class PrefixHashes:
    """The hash of any substring of ``data`` from prefix sums of a polynomial modulo 2**64."""

    def __init__(self, data: np.ndarray):
        power, self.inverse = _powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:len(data)], out=self.sums[1:])

    def __call__(self, begin, end) -> np.ndarray:
        h = (self.sums[end] - self.sums[begin]) * self.inverse[begin]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(29))


def anchors(data: np.ndarray, length: int, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(first start, last start, anchor position, anchor hash) of the runs of windows of ``data``."""
    windows = len(data) - length + 1
    for at in range(0, max(windows, 0), STEP):
        part = data[at:at + STEP + length - 1]
        i = np.arange(len(part) - k + 1)
        full = PrefixHashes(part)(i, i + k)
        bits = np.uint64(22)  # positions inside a step fit
        least = (full >> bits << bits) | i.astype(np.uint64)
        width, span = length - k + 1, 1
        while 2 * span <= width:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < width:
            n = len(part) - length + 1
            least = np.minimum(least[:n], least[width - span:width - span + n])
        place = (least & np.uint64((1 << 22) - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], np.diff(place) != 0]))
        last = np.concatenate([first[1:], [len(place)]]) - 1
        yield at + first, at + last, at + place[first], full[place[first]]


def _keyed(docs: DataFrame) -> DataFrame:
    return id_text(docs).withColumn("th", F.xxhash64("text"))


def _runs(rows: DataFrame, length: int, k: int) -> DataFrame:
    """Runs to be dealt by anchor (``copies`` equal ones in the block), and, with a null anchor,
    runs known to repeat."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        held: list = []
        size = 0

        def block() -> Iterator[pa.RecordBatch]:
            number: dict[bytes, int] = {}
            docs, lo, hi, place, key, kind = [], [], [], [], [], []
            for doc_id, th, data in held:
                view = memoryview(data)
                for first, last, p, h in anchors(np.frombuffer(data, np.uint8), length, k):
                    kind += [number.setdefault(xxhash.xxh3_128_digest(view[a:b]), len(number)) for a, b in zip(first.tolist(), (last + length).tolist())]
                    docs.append((doc_id, th, len(first)))
                    lo.append(first)
                    hi.append(last)
                    place.append(p)
                    key.append(h)
            if not docs:
                return
            counts = [d[2] for d in docs]
            owner = np.repeat(np.arange(len(docs)), counts)
            lo, hi, place, key = (np.concatenate(x) for x in (lo, hi, place, key))
            kind = np.array(kind)
            copies = np.bincount(kind)
            _, one = np.unique(kind, return_index=True)
            again = np.flatnonzero(copies[kind] > 1)
            ids = pa.array([d[0] for d in docs], pa.int64())
            ths = pa.array([d[1] for d in docs], pa.int64())
            digests = pa.array(list(number), pa.binary())
            none = pa.nulls(len(again), pa.int64())
            own = pa.array(owner[again])
            yield _batch(ids.take(own), ths.take(own), lo[again], hi[again], place[again], none, pa.nulls(len(again), pa.binary()), copies[kind[again]])
            for cut in range(0, len(one), 50_000):
                some = one[cut:cut + 50_000]
                own = pa.array(owner[some])
                yield _batch(ids.take(own), ths.take(own), lo[some], hi[some], place[some], pa.array(key[some].view(np.int64)),
                             digests.take(pa.array(kind[some])), copies[kind[some]])

        for batch in row_chunks(batches):
            offsets, data = utf8(batch.column("text"))
            for doc_id, th, a, b in zip(batch.column("doc_id").to_pylist(), batch.column("th").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist()):
                if b - a >= length:
                    held.append((doc_id, th, data[a:b]))
                    size += b - a
            if size >= BLOCK_BYTES:
                yield from block()
                held, size = [], 0
        yield from block()

    return rows.mapInArrow(scan, "doc_id long, th long, lo long, hi long, place long, anchor long, kind binary, copies long")


def _batch(ids, ths, lo, hi, place, key, kind, copies) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids, ths, pa.array(lo), pa.array(hi), pa.array(place), key, kind, pa.array(copies)],
                                      names=["doc_id", "th", "lo", "hi", "place", "anchor", "kind", "copies"])


def _status(runs: DataFrame) -> DataFrame:
    """Runs with ``whole`` (all of it repeats) and ``open`` (its bytes must be compared with others')."""
    deal = F.coalesce("anchor", F.xxhash64("doc_id", "th", "lo"))  # spreads those that need no comparison
    same, group = Window.partitionBy("deal", "kind"), Window.partitionBy("deal")
    counted = (runs.withColumn("deal", deal).repartition("deal").withColumn("n", F.sum("copies").over(same))
               .withColumn("turn", F.row_number().over(same.orderBy("doc_id", "th", "lo")))
               .withColumn("kinds", F.sum(F.when(F.col("turn") == 1, 1).otherwise(0)).over(group))
               .withColumn("least", F.min("n").over(group)))
    whole = F.col("n") > 1
    is_open = F.col("anchor").isNotNull() & (F.col("kinds") > 1) & (F.col("least") == 1) & (F.col("turn") == 1)
    return (counted.select("doc_id", "th", "lo", "hi", "place", "anchor", "kinds", whole.alias("whole"), is_open.alias("open"))
            .filter("whole or open"))


def _with_texts(rows: DataFrame, known: DataFrame, how: str) -> DataFrame:
    """``rows`` joined with one row of ``known`` per (doc_id, th)."""
    side = known.withColumnRenamed("doc_id", "i").withColumnRenamed("th", "h")
    on = F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("th") == F.col("h"))
    return rows.join(side, on, how).drop("i", "h")


def _contexts(rows: DataFrame, runs: DataFrame, length: int) -> DataFrame:
    """Open runs with their bytes."""
    entry = F.struct("lo", "hi", "place", "anchor", "kinds", "whole")
    asked = runs.groupBy("doc_id", "th").agg(F.collect_set(entry).alias("runs"))  # as many as the text has

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "th", "lo", "hi", "place", "anchor", "kinds", "whole"]
        kinds = [pa.int64()] * 7 + [pa.bool_()]
        for batch in row_chunks(batches, 200):
            offsets, data = utf8(batch.column("text"))
            out = []
            for i, (doc_id, th, found) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("doc_id", "th", "runs")))):
                a = int(offsets[i])
                out += [(doc_id, th, *(r[c] for c in names[2:]), data[a + r["lo"]:a + r["hi"] + length]) for r in found]
            yield pa.RecordBatch.from_arrays([*(pa.array([o[j] for o in out], kind) for j, kind in enumerate(kinds)), pa.array([o[-1] for o in out], pa.binary())],
                                             names=[*names, "bytes"])

    return _with_texts(rows, asked, "inner").mapInArrow(
        scan, "doc_id long, th long, lo long, hi long, place long, anchor long, kinds long, whole boolean, bytes binary")


def repeated_starts(data: bytes, base: np.ndarray, near: np.ndarray, far: np.ndarray, report: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """(run, first, last offset) of windows of a run that equal another run's.

    A run's bytes begin at ``base`` in ``data``; its anchor is ``far`` bytes on, and it has the windows
    that begin ``near`` to ``far`` bytes before its anchor. Runs without ``report`` are compared only."""
    hashes = PrefixHashes(np.frombuffer(data, np.uint8))
    found: list[tuple[int, int, int]] = []
    anchor = base + far

    def equal(begin: np.ndarray, size: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many rows' strings (of ``size`` at ``begin``) equal each row's, and the first such row."""
        h = hashes(begin, begin + size)
        order = np.argsort(h, kind="stable")
        new = np.concatenate([[True], np.diff(h[order]) != 0])
        group = np.empty(len(h), np.int64)
        group[order] = np.cumsum(new) - 1
        first = order[np.flatnonzero(new)]
        count = np.bincount(group)
        # verification: where a hash is equal and the bytes are not, classes are formed from the bytes
        wrong = [i for i in np.flatnonzero(count[group] > 1).tolist()
                 if data[begin[i]:begin[i] + size] != data[begin[first[group[i]]]:begin[first[group[i]]] + size]]
        if wrong:
            names: dict[bytes, int] = {}
            group = np.array([names.setdefault(data[b:b + size], len(names)) for b in begin.tolist()])
            _, first = np.unique(group, return_index=True)
            count = np.bincount(group)
        return count[group], first[group]

    todo = [(int(near.min()), int(far.max()), np.arange(len(base)), report.copy())] if len(base) else []
    while todo:
        a, b, rows, asks = todo.pop()
        some = (near[rows] <= b) & (far[rows] >= a)
        rows, asks = rows[some], asks[some]
        if len(rows) < 2 or not asks.any():
            continue
        count, first = equal(anchor[rows] - a, length - (b - a), rows)
        if a == b:
            found += [(int(r), a, a) for r in rows[asks & (count > 1)]]
            continue
        # groups with nothing to ask for, and runs that share the core with none, drop out
        wanted = np.zeros(len(rows), bool)
        np.logical_or.at(wanted, first, asks)
        stay = (count > 1) & wanted[first]
        rows, asks = rows[stay], asks[stay].copy()
        if not len(rows):
            continue
        full = np.flatnonzero((near[rows] <= a) & (far[rows] >= b))
        drop = np.zeros(len(rows), bool)
        if len(full):
            count, first = equal(anchor[rows[full]] - b, length + (b - a), rows[full])
            twice = count > 1
            found += [(int(r), a, b) for r in rows[full[twice & asks[full]]]]
            asks[full[twice]] = False
            drop[full[twice & (first != np.arange(len(full)))]] = True  # one of them stays to be compared with
        rows, asks = rows[~drop], asks[~drop]
        middle = (a + b) // 2
        todo += [(a, middle, rows, asks), (middle + 1, b, rows, asks)]
    return found


def _compared(contexts: DataFrame, length: int) -> DataFrame:
    """(doc_id, th, lo, hi): starts of the open runs' windows that repeat; anchors that few runs share."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def compare(table: pa.Table) -> pa.RecordBatch:
            column = table.column("bytes").combine_chunks()
            lo, hi, place = (table.column(c).to_numpy() for c in ("lo", "hi", "place"))
            sizes = hi - lo + length
            base = np.cumsum(sizes) - sizes
            data = b"".join(column.to_pylist())
            found = repeated_starts(data, base, place - hi, place - lo, ~table.column("whole").to_numpy(zero_copy_only=False).astype(bool), length)
            row = np.array([f[0] for f in found], np.int64)
            own = pa.array(row)
            return pa.RecordBatch.from_arrays(
                [table.column("doc_id").combine_chunks().take(own), table.column("th").combine_chunks().take(own),
                 pa.array(place[row] - np.array([f[2] for f in found], np.int64)), pa.array(place[row] - np.array([f[1] for f in found], np.int64))],
                names=["doc_id", "th", "lo", "hi"])

        for batch in row_chunks(batches, BATCH_RUNS):
            held.append(batch)
            if sum(b.num_rows for b in held) >= BATCH_RUNS:
                table = pa.Table.from_batches(held)
                key = table.column("anchor").to_numpy()
                cut = int(np.searchsorted(key, key[-1]))  # the last anchor's group may go on
                if cut:
                    yield compare(table.slice(0, cut))
                held = table.slice(cut).combine_chunks().to_batches()
        if held:
            yield compare(pa.Table.from_batches(held))

    dealt = contexts.filter(F.col("kinds") <= HOT_RUNS).repartition("anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(scan, "doc_id long, th long, lo long, hi long")


def _counted(contexts: DataFrame, length: int) -> DataFrame:
    """As ``_compared``, for anchors that more runs share: every window by its hash."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        for batch in row_chunks(batches, 200):
            out = [(doc_id, th, lo + i, xxhash.xxh3_128_digest(data[i:i + length]), whole)
                   for doc_id, th, lo, hi, whole, data in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "th", "lo", "hi", "whole", "bytes")))
                   for i in range(hi - lo + 1)]
            yield pa.RecordBatch.from_arrays([pa.array([o[j] for o in out], kind) for j, kind in enumerate([pa.int64()] * 3 + [pa.binary(), pa.bool_()])],
                                             names=["doc_id", "th", "lo", "window", "whole"])

    windows = contexts.filter(F.col("kinds") > HOT_RUNS).mapInArrow(scan, "doc_id long, th long, lo long, window binary, whole boolean")
    twice = windows.groupBy("window").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("window")
    return windows.filter("not whole").join(twice, "window").select("doc_id", "th", "lo", F.col("lo").alias("hi"))


def remove_repeats(docs: DataFrame, length: int = 400, k: int = 128) -> DataFrame:
    """(doc_id, th, n_bytes, spans, kept) for every row of ``docs``."""
    rows = _keyed(docs)
    made = materialize(_status(_runs(rows, length, k)), "runs")
    contexts = materialize(_contexts(rows, made.filter("open"), length), "contexts")
    ranges = (made.filter("whole").select("doc_id", "th", "lo", "hi")
              .unionByName(_compared(contexts, length)).unionByName(_counted(contexts, length)))
    per_text = ranges.groupBy("doc_id", "th").agg(F.array_sort(F.collect_set(F.struct("lo", "hi"))).alias("ranges"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_chunks(batches, 500):
            offsets, data = utf8(batch.column("text"))
            spans, kept = [], []
            for a, b, found in zip(offsets[:-1].tolist(), offsets[1:].tolist(), batch.column("ranges").to_pylist()):
                flat: list[int] = []
                for r in found or ():
                    if flat and r["lo"] <= flat[-1]:
                        flat[-1] = max(flat[-1], r["hi"] + length)
                    else:
                        flat += [r["lo"], r["hi"] + length]
                edges = [0, *flat, b - a]
                spans.append(flat)
                kept.append(b"".join(data[a + x:a + y] for x, y in zip(edges[::2], edges[1::2])))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(np.diff(offsets)), pa.array(spans, pa.list_(pa.int32())), pa.array(kept, pa.binary())],
                                             names=["doc_id", "th", "n_bytes", "spans", "kept"])

    return _with_texts(rows, per_text, "left").mapInArrow(cut, "doc_id long, th long, n_bytes long, spans array<int>, kept binary")
