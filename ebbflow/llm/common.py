"""Shared pieces of the training-data operators.

Row identity: ``doc_id`` may be null or repeated, so operators that must come
back to a row use the pair (doc_id, xxhash64(text)); rows equal in both carry
the same text and therefore the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbflow.session import ensure_checkpoint_dir

__all__ = ["documents", "ensure_checkpoint_dir", "id_text", "materialize", "read_table", "release_memory", "row_chunks",
           "shared_path", "utf8", "word_bytes"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new folder name under the shared folder the cluster names."""
    import uuid
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Writes ``df`` under the shared folder and reads it back: one evaluation, lineage cut."""
    path = shared_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def id_text(docs: DataFrame) -> DataFrame:
    """(doc_id, text) only, null text as empty: extra columns never reach an operator."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def release_memory() -> None:
    """Gives back what this process has freed: workers serve one stage after another, and the allocators
    would keep what each needed at most. Where the C library cannot, its part stays."""
    import ctypes
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def row_chunks(batches: Iterator[pa.RecordBatch], rows: int = 2000) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``rows`` rows, so that a task's buffers stay small; what earlier tasks of the
    worker have freed is given back first, what this one has freed at its end."""
    release_memory()
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    release_memory()


def utf8(column: pa.Array) -> tuple[np.ndarray, bytes]:
    """Offsets and bytes of a string column without decoding it (nulls are empty)."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    if not len(column):
        return np.zeros(1, np.int64), b""
    lo, hi = int(offs[0]), int(offs[-1])
    return offs - lo, (data.slice(lo, hi - lo).to_pybytes() if data is not None else b"")


def word_bytes(keep: str) -> bytes:
    """Byte table for ``bytes.translate``: A-Z to a-z, bytes that ``keep`` does not
    match to a space; bytes of non-ASCII characters always stay."""
    import re
    kept = re.compile(keep)
    table = bytearray(range(256))
    for b in range(128):
        c = chr(b).lower()
        table[b] = ord(c) if kept.fullmatch(c) else 0x20
    return bytes(table)
