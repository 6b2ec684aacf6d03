"""Token ids as Parquet list columns, with selective reads (operator 9).

``write_tokens`` puts documents in ascending ``doc_id`` order (range partitions,
sorted inside; rows of one id by the hash of their text, null ids first), encodes
each and writes one row per document: ``shard`` (the range partition),
``shard_start`` (ids before it in the shard), ``n_tokens`` and ``ids``. The
Parquet writer is told the row-group and page sizes; ids are dictionary-encoded
and fall back to delta encoding (format v2), and the writer adds column and
offset indexes per page, so a read of the metadata columns never touches the ids
and a read of some ``doc_id`` skips pages. Only Spark's writer and readers touch
the files, so they may lie in any store and survive lost executors.

Results: null text is empty and yields only the end id; repeated rows each keep
their own place; an empty table gives an empty file set.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ebbflow.llm.common import id_text, row_chunks
from ebbflow.llm.tokens import WordTokenizer

SCHEMA = "shard int, doc_id long, shard_start long, n_tokens long, ids array<int>"


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int,
                 row_group_bytes: int = 32 << 20, page_bytes: int = 1 << 20) -> None:
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        shard, total = TaskContext.get().partitionId(), 0
        words, end = WordTokenizer.at(tokenizer), np.array([end_id], "<u4").tobytes()
        for batch in row_chunks(batches):
            ids = [x + end for x in words.encode(batch.column("text").to_pylist())]
            lengths = np.array([len(x) // 4 for x in ids], dtype=np.int64)
            ends = np.cumsum(lengths)
            flat = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(ids))])
            offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(ids), shard, np.int32)), batch.column("doc_id"),
                 pa.array(total + ends - lengths), pa.array(lengths), pa.ListArray.from_arrays(offsets, flat)],
                names=["shard", "doc_id", "shard_start", "n_tokens", "ids"])
            total += int(ends[-1])

    rows = id_text(docs).withColumn("_tie", F.xxhash64("text"))
    placed = (rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.col("_tie"))
              .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "_tie").drop("_tie"))
    (placed.mapInArrow(encode, SCHEMA).write.mode("overwrite")
     .option("compression", "zstd").option("parquet.writer.version", "v2")
     .option("parquet.enable.dictionary", "true").option("parquet.block.size", str(row_group_bytes))
     .option("parquet.page.size", str(page_bytes)).option("parquet.dictionary.page.size", str(page_bytes))
     .parquet(path))


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(shard, doc_id, shard_start, n_tokens): the ids are not read."""
    return spark.read.schema(SCHEMA).parquet(path).drop("ids")


def read_tokens(spark: SparkSession, path: str, first_id: int | None = None, last_id: int | None = None) -> DataFrame:
    """Rows with ``start``, the ids of all documents before; a doc_id range is pushed to the pages."""
    totals = read_metadata(spark, path).groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))  # a row per shard
    rows = spark.read.schema(SCHEMA).parquet(path)
    if first_id is not None:
        rows = rows.filter(F.col("doc_id") >= first_id)
    if last_id is not None:
        rows = rows.filter(F.col("doc_id") <= last_id)
    return (rows.join(F.broadcast(starts), "shard")  # as many rows as range partitions were written
            .withColumn("start", (F.col("before") + F.col("shard_start")).cast("long")).drop("before"))


def with_crc32(rows: DataFrame, column: str = "ids") -> DataFrame:
    """Replaces a list of ids by ``ids_crc32``, the unsigned CRC-32 of its little-endian 32-bit form."""
    kept = [f for f in rows.schema.fields if f.name != column]

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_chunks(batches):
            ids = batch.column(column)
            flat = ids.flatten().to_numpy(zero_copy_only=False).astype("<u4")
            at = np.concatenate([[0], np.cumsum(ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
            sums = [zlib.crc32(flat[a:b]) for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(sums, pa.int64())],
                                             names=[*(f.name for f in kept), "ids_crc32"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return rows.mapInArrow(crc, f"{schema}, ids_crc32 long")
