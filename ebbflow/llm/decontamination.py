"""Benchmark decontamination by prefix-filtered containment join (operator 6).

A window is ``window`` consecutive words of an item (a shorter item is one
window). A document contains a window exactly if it has all the window's word
shingles, in place; so of each window only the necessary prefix, its rarest
shingle, is joined: shingles are ordered by how often they occur in all
documents (a first pass counts them), and a document position with a prefix
shingle is a candidate. Positional and length bounds drop candidates whose window
would begin before or end after the document; the rest are compared word by word.

The benchmark is sent to the tasks in blocks of at most ``block_bytes`` of text
(its size is summed first); a larger benchmark takes more passes over the
documents, whose result is written between passes. Documents are never shuffled.

Results, in a struct column (replacing one of that name): ``n_words``;
``hit_spans``, word positions begin, end (exclusive), begin, ... of the covered
runs, ascending; ``items``, the distinct item ids (as text, sorted) with an
occurring window. Null texts have no words; a null item id is the empty string;
items without words are ignored; an empty benchmark hits nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbflow.llm.common import materialize, row_chunks, utf8, word_bytes

WORD_TABLE = word_bytes("[0-9a-z]")
WIDTH = 3
_MIX = np.uint64(0x9E3779B97F4A7C15)
_TYPE = "struct<n_words:long,hit_spans:array<int>,items:array<string>>"


def words(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) words: runs of ASCII letters, digits and non-ASCII characters."""
    return text.translate(WORD_TABLE).split()


def _keys(ids: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit key of each run of ``width`` ids."""
    n = len(ids) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    key = np.full(n, width, np.uint64)
    for j in range(width):
        key = (key ^ ids[j:j + n].astype(np.uint64)) * _MIX
        key ^= key >> np.uint64(29)
    return key


class ItemIndex:
    """Windows of a block of items, and the prefix shingle of each."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.vocab: dict[bytes, int] = {}
        found: dict[bytes, int] = {}
        starts, lengths, owners, flat = [], [], [], []
        self.names = sorted({name for name, _ in items})
        number = {name: i for i, name in enumerate(self.names)}
        at = 0
        for name, text in items:
            ids = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words(text.encode())]
            row = np.array(ids, np.int32)
            size = min(window, len(ids))
            for s in range(len(ids) - size + 1 if size else 0):
                key = row[s:s + size].tobytes()
                w = found.get(key)
                if w is None:
                    w = found[key] = len(starts)
                    starts.append(at + s)
                    lengths.append(size)
                    owners.append({number[name]})
                else:
                    owners[w].add(number[name])
            flat.append(row)
            at += len(ids)
        self.flat = np.concatenate([*flat, np.zeros(1, np.int32)])
        self.start, self.length = np.array(starts, np.int64), np.array(lengths, np.int64)
        self.owner_at = np.concatenate([[0], np.cumsum([len(o) for o in owners])]).astype(np.int64)
        self.owner = np.array([i for o in owners for i in sorted(o)], np.int32)
        self.widths = sorted({min(WIDTH, n) for n in lengths})
        key, win, off = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for width in self.widths:
            keys = _keys(self.flat, width)
            mine = np.flatnonzero(np.minimum(self.length, WIDTH) == width)
            for o in range(int(self.length[mine].max()) - width + 1):
                sub = mine[self.length[mine] - width >= o]
                key.append(keys[self.start[sub] + o])
                win.append(sub)
                off.append(np.full(len(sub), o))
        self._key, self._win, self._off = map(np.concatenate, (key, win, off))
        self.shingles = np.unique(self._key)
        self.order_by(np.zeros(len(self.shingles), np.int64))

    def order_by(self, count: np.ndarray) -> None:
        """Takes each window's rarest shingle (by ``count`` of ``shingles``, then key) as its prefix."""
        rarity = count[np.searchsorted(self.shingles, self._key)]
        order = np.lexsort((self._off, self._key, rarity, self._win))
        first = order[np.flatnonzero(np.diff(self._win[order], prepend=-1))]
        first = first[np.argsort(self._key[first], kind="stable")]
        self.prefix_key, self.prefix_win, self.prefix_off = self._key[first], self._win[first], self._off[first]
        self.prefixes = np.unique(self.prefix_key)

    def ids(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """Word ids (0: in no item) of the texts, one after another, and where each text begins."""
        offsets, data = utf8(batch.column("text"))
        split = [words(data[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        at = np.concatenate([[0], np.cumsum([len(w) for w in split])]).astype(np.int64)
        return np.fromiter(map(self.vocab.get, chain.from_iterable(split), repeat(0)), np.int32, int(at[-1])), at

    def positions(self, ids: np.ndarray, among: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions whose shingle (of a width that windows have) is in ``among``, and its key.
        A run over a text's end may be among them; comparing windows drops those."""
        known = ids > 0
        for width in self.widths:
            if len(ids) < width:
                continue
            all_known = known[:len(ids) - width + 1].copy()
            for j in range(1, width):
                all_known &= known[j:len(ids) - width + 1 + j]
            at = np.flatnonzero(all_known)
            key = np.full(len(at), width, np.uint64)
            for j in range(width):
                key = (key ^ ids[at + j].astype(np.uint64)) * _MIX
                key ^= key >> np.uint64(29)
            spot = np.minimum(np.searchsorted(among, key), len(among) - 1)
            hit = among[spot] == key
            yield at[hit], key[hit]

    def matches(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(begin, window) of every window occurrence."""
        begins, wins = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for pos, key in self.positions(ids, self.prefixes) if len(self.prefixes) else ():
            for cut in range(0, len(pos), 100_000):
                p, k = pos[cut:cut + 100_000], key[cut:cut + 100_000]
                lo = np.searchsorted(self.prefix_key, k)
                n = np.searchsorted(self.prefix_key, k, side="right") - lo
                row = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
                w = self.prefix_win[row]
                begin = np.repeat(p, n) - self.prefix_off[row]
                text = np.searchsorted(at, np.repeat(p, n), side="right") - 1
                fits = (begin >= at[text]) & (begin + self.length[w] <= at[text + 1])
                begin, w = begin[fits], w[fits]
                for j in range(int(self.length[w].max()) if len(w) else 0):
                    same = (j >= self.length[w]) | (ids[np.minimum(begin + j, len(ids) - 1)] == self.flat[np.minimum(self.start[w] + j, len(self.flat) - 1)])
                    begin, w = begin[same], w[same]
                begins.append(begin)
                wins.append(w)
        return np.concatenate(begins), np.concatenate(wins)


def _shingle_counts(docs: DataFrame, shared) -> np.ndarray:
    """Occurrences in all documents of each shingle of the block (as many rows as the block has shingles)."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: ItemIndex = shared.value
        total = np.zeros(len(index.shingles), np.int64)
        for batch in row_chunks(batches):
            ids, _ = index.ids(batch)
            for _, key in index.positions(ids, index.shingles) if len(total) else ():
                total += np.bincount(np.searchsorted(index.shingles, key), minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["i", "n"])

    out = np.zeros(len(shared.value.shingles), np.int64)
    for i, n in docs.select("text").mapInArrow(count, "i long, n long").groupBy("i").agg(F.sum("n")).collect():
        out[i] = n
    return out


def _blocks(benchmark: DataFrame, block_bytes: int) -> list[DataFrame]:
    """The items in blocks of about ``block_bytes`` of text; only one is with the driver at a time."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"),
                             F.col("text").cast("string").alias("text")).filter("text is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-size // block_bytes))
    return [items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b) for b in range(n)]


def annotate(docs: DataFrame, benchmark: DataFrame, window: int = 10, keep: list[str] | None = None,
             out: str = "decontamination", block_bytes: int = 4 << 20) -> DataFrame:
    """``docs`` (or its columns ``keep``) with the struct column ``out``."""
    keep = [c for c in (docs.columns if keep is None else keep) if c != out]
    need = [*keep, *(["text"] if "text" not in keep else [])]
    sc = docs.sparkSession.sparkContext
    frame, first = docs.select(*need), True
    blocks = _blocks(benchmark, block_bytes)
    for number, items in enumerate(blocks):
        index = ItemIndex([(r["item_id"], r["text"]) for r in items.collect()], window)
        index.order_by(_shingle_counts(frame, sc.broadcast(index)))
        last = number == len(blocks) - 1
        columns = keep if last else need
        types = {f.name: f.dataType.simpleString() for f in frame.schema.fields}
        schema = ", ".join([*(f"`{c}` {types[c]}" for c in columns), f"`{out}` {_TYPE}"])
        frame = frame.mapInArrow(_scan(sc.broadcast(index), columns, out, first), schema)
        if not last:
            frame = materialize(frame, "decontaminated")
        first = False
    return frame


def _scan(shared, columns: list[str], out: str, first: bool):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: ItemIndex = shared.value
        for batch in row_chunks(batches):
            ids, at = index.ids(batch)
            begin, win = index.matches(ids, at)
            text = np.searchsorted(at, begin, side="right") - 1
            spans: list = [[] for _ in range(batch.num_rows)]
            items: list = [[] for _ in range(batch.num_rows)]
            order = np.argsort(text, kind="stable")
            cuts = np.flatnonzero(np.diff(text[order], prepend=-1))
            for lo, hi in zip(cuts, [*cuts[1:], len(order)]):
                rows = order[lo:hi]
                t = int(text[rows[0]])
                b = begin[rows] - at[t]
                spans[t] = np.stack([b, b + index.length[win[rows]]], 1).tolist()
                items[t] = [index.names[i] for w in np.unique(win[rows]) for i in index.owner[index.owner_at[w]:index.owner_at[w + 1]]]
            if not first:
                for t, old in enumerate(batch.column(out).to_pylist()):
                    pairs = old["hit_spans"]
                    spans[t] += [list(p) for p in zip(pairs[::2], pairs[1::2])]
                    items[t] += old["items"]
            found = pa.StructArray.from_arrays(
                [pa.array(np.diff(at)), pa.array([_union(s) for s in spans], pa.list_(pa.int32())),
                 pa.array([sorted(set(i)) for i in items], pa.list_(pa.string()))], names=["n_words", "hit_spans", "items"])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), found], names=[*columns, out])
    return scan


def _union(spans: list) -> list[int]:
    flat: list[int] = []
    for a, b in sorted(spans):
        if flat and a <= flat[-1]:
            flat[-1] = max(flat[-1], b)
        else:
            flat += [a, b]
    return flat
