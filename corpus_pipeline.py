"""Corpus pipeline: stages over ``documents``, each written as Parquet and read by the next.

1. ``toxicity`` drops the documents whose nearest labelled examples say they are toxic.
2. ``near_duplicates`` keeps one document of each group of near copies.
3. ``decontamination`` drops documents that hold a window of a benchmark item.
4. ``personal_data`` replaces personal data by its kind; ``n_chars`` follows the text.
5. ``packing`` cuts the remaining texts into token pieces and packs them into sequences.

Rows with null ids, null or empty texts pass every stage as the operators define it; all but the
last stage return the columns of their input, extra ones included.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbflow.llm import decontamination, ngram_join, packing, pii, queries, token_files, toxicity
from ebbflow.llm.common import documents, materialize, read_table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"), queries.learning_rows())
    scored = toxicity.score(docs, model, out="_toxicity")
    return scored.filter(F.col("_toxicity.score") < 0.5).select(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontamination.annotate(docs, read_table(spark, sf_dir, "benchmark"), out="_decontamination")
    return found.filter(F.size("_decontamination.hit_spans") == 0).select(*docs.columns)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    if "n_chars" not in docs.columns:
        return pii.mask(docs, pii.train(docs))
    masked = pii.mask(docs.withColumn("_before", F.length("text")), pii.train(docs))
    changed = F.length("text") != F.col("_before")
    kind = docs.schema["n_chars"].dataType
    return masked.withColumn("n_chars", F.when(changed, F.length("text").cast(kind)).otherwise(F.col("n_chars"))).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(docs, queries.vocabulary("word_bpe_49k.json"), queries.CAPACITY, end_id=0)
    return packing.pack(materialize(token_files.with_crc32(pieces), "pieces"), queries.CAPACITY).drop("block", "block_rank")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", keep_one_of_each_group),
    ("decontamination", drop_contaminated),
    ("personal_data", mask_personal_data),
    ("packing", pack),
]

#: Tokenizing, training and the search for neighbours are not SQL; the tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
