"""Document fingerprints of closed syncmers (operator 5).

A ``k``-character window is an anchor if the least of its inner ``s``-character
hashes lies at either edge: that depends on the window alone, so an edit moves no
anchor elsewhere. A fingerprint holds all distinct anchors with the position of each
one's first occurrence, in code points, as base64 of little-endian (hash, position)
pairs ordered by hash. Likeness matches the equal hashes of both, counts the longest
chain whose positions rise in both texts, and divides it by the number of hashes that
either has: 1 for equal fingerprints, 0 without a common anchor. A ``size`` keeps the
least hashes only, for callers that want a sample.

A text without an anchor (shorter than ``k``, or by chance) has one for the whole
text; the empty text's fingerprint is empty, and two empty ones are alike (1).

``with_next`` pairs each row with the one that follows in descending ``doc_id``
(null ids last, rows of one id by the hash of their text; the last row with the
first). A sample of the keys places cuts between buckets of consecutive rows; the
first row of each bucket, found from the keys alone, is added behind the rows of the
bucket before it; then every bucket is streamed in order, and each row's fingerprint
is made once and goes straight to the result. Any cuts are right; even ones only
balance the buckets, and a key that very many rows have is cut by their hashes.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbflow.llm.common import id_text, row_chunks

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_P = np.uint64(0x9E3779B97F4A7C15)
RESULT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")
#: Keys sampled per bucket, and buckets per shuffle partition.
SAMPLED, BUCKETS = 20, 4
#: Characters of fingerprints after which a batch of results is sent on.
BATCH_CHARS = 8_000_000


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


@dataclass(frozen=True)
class Syncmers:
    k: int = 15
    s: int = 5
    size: int | None = None

    def anchors(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(hash, first position) of the distinct anchors, by hash."""
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        if not len(code):
            return np.zeros(0, np.uint32), np.zeros(0, np.uint32)
        hashes = at = np.zeros(0, np.uint64)
        if len(code) >= self.k:
            n = len(code) - self.s + 1
            inner = code[:n].copy()
            for j in range(1, self.s):
                inner *= _P
                inner += code[j:j + n]
            inner = _mix(inner)
            width = self.k - self.s + 1
            least, span = inner, 1
            while 2 * span <= width:
                least = np.minimum(least[:-span], least[span:])
                span *= 2
            if span < width:
                least = np.minimum(least[:len(inner) - width + 1], least[width - span:width - span + len(inner) - width + 1])
            at = np.flatnonzero((inner[:len(least)] == least) | (inner[width - 1:] == least))
            hashes = np.zeros(len(at), np.uint64)
            for j in range(0, self.k, self.s):
                j = min(j, self.k - self.s)
                hashes = (hashes ^ inner[at + j]) * _P
            hashes = _mix(hashes) >> np.uint64(32)
        if not len(at):
            digest = hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()
            return np.frombuffer(digest[:4], "<u4"), np.zeros(1, np.uint32)
        value, first = np.unique(hashes, return_index=True)
        return value[:self.size].astype(np.uint32), at[first[:self.size]].astype(np.uint32)

    def likeness(self, a: tuple, b: tuple) -> float:
        if len(a[0]) == len(b[0]) and (a[0] == b[0]).all() and (a[1] == b[1]).all():
            return 1.0
        if not len(a[0]) or not len(b[0]):
            return 0.0
        both, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
        if not len(both):
            return 0.0
        least = np.union1d(a[0], b[0])[:self.size]
        common = both <= least[-1]
        i, j = a[1][i[common]], b[1][j[common]]
        chain: list[int] = []
        for x in j[np.argsort(i, kind="stable")].tolist():
            spot = bisect_left(chain, x)
            chain[spot:spot + 1] = [x]
        return len(chain) / len(least)

    @staticmethod
    def text_of(anchors: tuple) -> str:
        return base64.b64encode(np.stack(anchors, 1).astype("<u4").tobytes()).decode() if len(anchors[0]) else ""


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by the first as many (or all) of ``following``."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def _compare(method: Syncmers, text: str, mine: tuple, following: str, theirs: tuple) -> tuple:
    changed = edited(text, following)
    other = method.anchors(changed)
    return (len(text), hashlib.sha256(changed.encode()).hexdigest(), method.text_of(mine), method.text_of(other),
            method.likeness(mine, other), method.likeness(mine, theirs))


def _key(doc_id: int | None, tie: int) -> int:
    """One number that orders rows as (doc_id, tie), null ids first."""
    return ((-1 << 70) if doc_id is None else doc_id << 64) + tie + (1 << 63)


def _bucketed(rows: DataFrame) -> DataFrame:
    """Adds ``bucket``: consecutive rows of the descending order, in ascending bucket number."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) * BUCKETS
    keys = rows.select("doc_id", "tie")
    share = min(1.0, SAMPLED * n / max(1, keys.count()))
    sample = sorted(_key(r["doc_id"], r["tie"]) for r in keys.sample(share, seed=1).collect())
    cuts = sorted({sample[len(sample) * i // n] for i in range(1, n)}) if sample else []

    @F.pandas_udf("int")
    def bucket(doc_id: pd.Series, missing: pd.Series, tie: pd.Series) -> pd.Series:
        keys = (_key(None if none else i, t) for i, none, t in zip(doc_id.tolist(), missing.tolist(), tie.tolist()))
        return pd.Series([len(cuts) - bisect_right(cuts, k) for k in keys], dtype="int32")

    return rows.withColumn("bucket", bucket(F.coalesce("doc_id", F.lit(0)), F.col("doc_id").isNull(), "tie"))


def with_next(docs: DataFrame, method: Syncmers = Syncmers()) -> DataFrame:
    """The columns of ``RESULT`` for every row: its fingerprint, that of its edited text, and likenesses."""
    rows = _bucketed(id_text(docs).withColumn("tie", F.xxhash64("text")))
    spark = docs.sparkSession
    # a row per bucket: its first key in descending order
    top = F.max(F.struct(F.col("doc_id").isNotNull().alias("known"), F.col("doc_id").alias("doc_id"), F.col("tie").alias("tie")))
    first = sorted(rows.groupBy("bucket").agg(top.alias("top")).select("bucket", "top.doc_id", "top.tie").collect(), key=lambda r: r["bucket"])
    after = [(r["bucket"], *first[(i + 1) % len(first)][1:]) for i, r in enumerate(first)]
    heads = F.broadcast(spark.createDataFrame(after, "to int, i long, h long"))  # as many rows as buckets
    follow = (rows.drop("bucket").join(heads, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("tie") == F.col("h")))
              .dropDuplicates(["to"]).select("doc_id", "text", "tie", F.col("to").alias("bucket"), F.lit(1).alias("extra")))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, last = None, None
        for batch in row_chunks(batches, 1000):
            done, held = [], 0
            for doc_id, text, b, extra in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "bucket", "extra"))):
                anchors = method.anchors(text)
                if last is not None and b == bucket:
                    done.append((last[0], *_compare(method, last[1], last[2], text, anchors)))
                    held += len(done[-1][3]) + len(done[-1][4])
                    if held >= BATCH_CHARS:
                        yield _rows(done, RESULT)
                        done, held = [], 0
                bucket, last = b, None if extra else (doc_id, text, anchors)
            yield _rows(done, RESULT)

    every = rows.withColumn("extra", F.lit(0)).unionByName(follow)
    order = ["bucket", "extra", F.col("doc_id").desc_nulls_last(), F.col("tie").desc()]
    return every.repartition("bucket").sortWithinPartitions(*order).select("doc_id", "text", "bucket", "extra").mapInArrow(stream, RESULT)


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64()}
    columns = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[kind]) for i, (_, kind) in enumerate(columns)],
                                      names=[name for name, _ in columns])
