"""Token counts by pre-token (operator 7).

The byte-level tokenizer never merges across white-space boundaries: a text is a
sequence of pre-tokens, each a run of other characters with at most one space in
front, or a run of white space. Documents are read in blocks; a block sends each
distinct pre-token once, with the documents it is in and how often (packed). Rows
are dealt by pre-token and sorted, so that equal ones meet: the library encodes a
distinct pre-token once, the count is joined to every block's frequencies, and
only sums per document, packed by block, go on. Ids are never stored.

Texts that hold a special string are cut at it first, as the library does.

Results: null text is empty and has 0 tokens; repeated rows are counted each; an
empty table gives no rows. A frequent pre-token is one row per block, not one per
document or occurrence, so no key is hot.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbflow.llm.common import id_text, row_chunks

#: White space as the tokenizer's pattern has it.
_WS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PRE_TOKEN = re.compile(f" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
BLOCK_CHARS = 24 << 20
BLOCK_DOCS = 1 << 16
#: Blocks whose sums a task holds before it sends them on.
HELD_BLOCKS = 128
_FREQS = "pre_token string, block long, packed binary"
_SUMS = "block long, docs binary, packed binary"
RESULT = "doc_id long, n_bytes long, n_tokens long"
_LIBRARY: dict = {}


def _library(path: str):
    if path not in _LIBRARY:
        from tokenizers import Tokenizer
        _LIBRARY[path] = Tokenizer.from_file(path)
    return _LIBRARY[path]


def _specials(path: str) -> list[str]:
    return [t.content for t in _library(path).get_added_tokens_decoder().values()]


def pre_tokens(text: str, special: re.Pattern | None = None) -> list[str]:
    if special is None or not special.search(text):
        return PRE_TOKEN.findall(text)
    return [p for part in special.split(text) for p in ([part] if special.fullmatch(part) else PRE_TOKEN.findall(part))]


def _pack_docs(ids: list, sizes: list[int]) -> bytes:
    """Ids, whether they are there, and sizes of a block's documents."""
    known = np.array([0 if i is None else i for i in ids], np.int64)
    return known.tobytes() + np.array([i is None for i in ids], np.int64).tobytes() + np.array(sizes, np.int64).tobytes()


def frequencies(docs: DataFrame, tokenizer: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per block and distinct pre-token: the block's documents that have it (unsigned 16-bit
    numbers) and how often (8-bit; more often takes several entries). And one row per block, with a
    null pre-token, for the documents themselves."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        special = re.compile("(" + "|".join(map(re.escape, _specials(tokenizer))) + ")") if _specials(tokenizer) else None
        part, seq, chars = TaskContext.get().partitionId(), 0, 0
        ids: list = []
        sizes: list[int] = []
        numbers: dict[str, int] = {}
        found: list[np.ndarray] = []

        def block() -> Iterator[pa.RecordBatch]:
            key = np.concatenate(found) << 16 | np.repeat(np.arange(len(found)), [len(x) for x in found])
            key, freq = np.unique(key, return_counts=True)
            entries = -(-freq // 255)
            key = np.repeat(key, entries)
            each = np.full(len(key), 255, np.uint8)
            each[np.cumsum(entries) - 1] = freq - 255 * (entries - 1)
            token, doc = key >> 16, (key & 0xFFFF).astype("<u2")
            first = np.searchsorted(token, np.arange(len(numbers) + 1))
            # per pre-token: its document numbers, then its frequencies
            packed = np.empty(3 * len(key), np.uint8)
            offset = np.arange(len(key)) - first[token]
            at = 3 * first[token] + 2 * offset
            packed[at], packed[at + 1] = doc & 0xFF, doc >> 8
            packed[3 * first[token] + 2 * np.diff(first)[token] + offset] = each
            names, number = list(numbers), (part << 32) + seq
            rows = pa.Array.from_buffers(pa.binary(), len(names), [None, pa.py_buffer((3 * first).astype(np.int32)), pa.py_buffer(packed)])
            for lo in range(0, len(names), 50_000):
                some = names[lo:lo + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), pa.array(np.full(len(some), number)), rows.slice(lo, len(some))],
                                                 names=["pre_token", "block", "packed"])
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), pa.array([number]), pa.array([_pack_docs(ids, sizes)], pa.binary())],
                                             names=["pre_token", "block", "packed"])

        for batch in row_chunks(batches):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                pieces = pre_tokens(text, special)
                for p in set(pieces).difference(numbers):
                    numbers[p] = len(numbers)
                found.append(np.fromiter(map(numbers.__getitem__, pieces), np.int64, len(pieces)))
                ids.append(doc_id)
                sizes.append(len(text.encode()))
                chars += len(text)
                if chars >= block_chars or len(ids) == BLOCK_DOCS:
                    yield from block()
                    ids, sizes, numbers, found, chars, seq = [], [], {}, [], 0, seq + 1
        if ids:
            yield from block()

    return id_text(docs).mapInArrow(count, _FREQS)


def token_counts(docs: DataFrame, tokenizer: str, limit: int, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of ``docs``."""
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library, last, last_n = _library(tokenizer), None, 0
        held: dict[int, np.ndarray] = {}

        def send() -> pa.RecordBatch:
            some = [(b, np.flatnonzero(total)) for b, total in held.items()]
            packed = [d.astype("<u2").tobytes() + held[b][d].astype("<u4").tobytes() for b, d in some]
            held_rows = pa.RecordBatch.from_arrays([pa.array([b for b, _ in some], pa.int64()), pa.nulls(len(some), pa.binary()),
                                                    pa.array(packed, pa.binary())], names=["block", "docs", "packed"])
            held.clear()
            return held_rows

        for batch in row_chunks(batches, 20_000):
            own = batch.filter(batch.column("pre_token").is_null())
            if own.num_rows:
                yield pa.RecordBatch.from_arrays([own.column("block"), own.column("packed"), pa.nulls(own.num_rows, pa.binary())],
                                                 names=["block", "docs", "packed"])
            batch = batch.filter(batch.column("pre_token").is_valid())
            if not batch.num_rows:
                continue
            tokens = batch.column("pre_token").dictionary_encode()
            values = tokens.dictionary.to_pylist()
            n = np.array([last_n if v == last else 0 for v in values], np.int64)
            new = [i for i, v in enumerate(values) if v != last]
            for at in range(0, len(new), 1000):
                some = new[at:at + 1000]
                n[some] = [len(e) for e in library.encode_batch_fast([values[i] for i in some], add_special_tokens=False)]
            where = tokens.indices.to_numpy(zero_copy_only=False)
            last, last_n = values[where[-1]], int(n[where[-1]])
            offsets, data = _binary(batch.column("packed"))
            block = batch.column("block").to_numpy()
            by_block = np.argsort(block, kind="stable")
            cuts = np.flatnonzero(np.diff(block[by_block], prepend=-1))
            size = np.diff(offsets) // 3
            for lo, hi in zip(cuts, [*cuts[1:], len(by_block)]):
                rows = by_block[lo:hi]
                m = size[rows]
                row = np.repeat(rows, m)
                j = np.arange(len(row)) - np.repeat(np.cumsum(m) - m, m)
                at = offsets[row] + 2 * j
                doc = data[at].astype(np.int64) | data[at + 1].astype(np.int64) << 8
                each = data[offsets[row] + 2 * size[row] + j] * n[where][row]
                b = int(block[rows[0]])
                if b not in held:
                    if len(held) == HELD_BLOCKS:
                        yield send()
                    held[b] = np.zeros(BLOCK_DOCS, np.int64)
                held[b] += np.bincount(doc, each, minlength=BLOCK_DOCS).astype(np.int64)
        if held:
            yield send()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, total, docs_of = None, None, None

        def done() -> pa.RecordBatch:
            ids, missing, sizes = np.frombuffer(docs_of, np.int64).reshape(3, -1)
            return pa.RecordBatch.from_arrays([pa.array(ids, mask=missing.astype(bool)), pa.array(sizes), pa.array(total[:len(ids)])],
                                              names=["doc_id", "n_bytes", "n_tokens"])

        for batch in batches:
            for row in batch.to_pylist():
                if row["block"] != block:
                    if block is not None:
                        yield done()
                    block, total = row["block"], np.zeros(BLOCK_DOCS, np.int64)
                if row["docs"] is not None:
                    docs_of = row["docs"]
                if row["packed"]:
                    m = len(row["packed"]) // 6
                    total[np.frombuffer(row["packed"][:2 * m], "<u2")] += np.frombuffer(row["packed"][2 * m:], "<u4")
        if block is not None:
            yield done()

    freqs = frequencies(docs, tokenizer, block_chars)
    dealt = (freqs.repartition(F.coalesce("pre_token", F.concat(F.lit("\x00"), F.col("block").cast("string"))))
             .sortWithinPartitions("pre_token"))
    sums = dealt.mapInArrow(join, _SUMS).repartition("block").sortWithinPartitions("block")
    return sums.mapInArrow(add, RESULT).withColumn("over_limit", F.col("n_tokens") > limit)


def _binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a binary column."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    return (np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1],
            np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8))
