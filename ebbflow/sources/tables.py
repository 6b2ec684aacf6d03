"""Readers, writers and catalog helpers (inventory A1–A6, A8, A9)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one driver table; column pruning and filters reach the parquet scan."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


# Raw telco customer schema (column, type).
TELCO_SCHEMA = T.StructType([
    T.StructField("customerID", T.StringType()),
    T.StructField("gender", T.StringType()),
    T.StructField("SeniorCitizen", T.IntegerType()),
    T.StructField("Partner", T.StringType()),
    T.StructField("Dependents", T.StringType()),
    T.StructField("tenure", T.IntegerType()),
    T.StructField("PhoneService", T.StringType()),
    T.StructField("MultipleLines", T.StringType()),
    T.StructField("InternetService", T.StringType()),
    T.StructField("OnlineSecurity", T.StringType()),
    T.StructField("OnlineBackup", T.StringType()),
    T.StructField("DeviceProtection", T.StringType()),
    T.StructField("TechSupport", T.StringType()),
    T.StructField("StreamingTV", T.StringType()),
    T.StructField("StreamingMovies", T.StringType()),
    T.StructField("Contract", T.StringType()),
    T.StructField("PaperlessBilling", T.StringType()),
    T.StructField("PaymentMethod", T.StringType()),
    T.StructField("MonthlyCharges", T.DoubleType()),
    T.StructField("TotalCharges", T.StringType()),
    T.StructField("Churn", T.StringType()),
])

# Accepted raw file name patterns.
CUSTOMER_FILE_PATTERNS = ("WA_Fn*.csv", "telco*.csv", "Telco*.csv")


def read_customers(spark: SparkSession, path: str) -> DataFrame:
    """A1: raw customer CSV with header under a fixed schema (no inference pass).

    ``path`` is a directory, of which all files with an accepted name are read, or a
    file or glob (``…csv``), read as given; Spark resolves it, in any store.
    ``TotalCharges`` stays a string (blanks occur); ``clean.coerce_numeric`` turns
    it into a number.
    """
    reader = spark.read.schema(TELCO_SCHEMA).option("header", True).option("mode", "PERMISSIVE")
    if not path.endswith((".csv", ".csv.gz")) and not any(c in path for c in "*?[{"):
        reader = reader.option("pathGlobFilter", "{" + ",".join(CUSTOMER_FILE_PATTERNS) + "}")
    df = reader.csv(path)
    if not df.inputFiles():
        raise FileNotFoundError(f"no customer CSV ({', '.join(CUSTOMER_FILE_PATTERNS)}) in {path}")
    return df


def register_csv(spark: SparkSession, name: str, path: str) -> DataFrame:
    """A2: CSV with header and inferred schema, visible to SQL as ``name``."""
    df = spark.read.option("header", True).option("inferSchema", True).csv(path)
    df.createOrReplaceTempView(name)
    return df


def register(df: DataFrame, name: str) -> DataFrame:
    """A3: make a DataFrame visible to ``spark.sql``."""
    df.createOrReplaceTempView(name)
    return df


def save_table(df: DataFrame, name: str, mode: str = "overwrite",
               bucket_by: str | None = None, buckets: int = 0) -> None:
    """A4: ``CREATE OR REPLACE TABLE`` as a managed table.

    With ``bucket_by`` the table is bucketed on the key so later joins and
    aggregations on that key reuse the layout without a shuffle.
    """
    w = df.write.mode(mode).format("parquet")
    if bucket_by and buckets:
        w = w.bucketBy(buckets, bucket_by).sortBy(bucket_by)
    w.saveAsTable(name)


def table_counts(spark: SparkSession, names: list[str] | None = None) -> DataFrame:
    """A5: (table_name, row_count) for the named (or all) tables/views.

    One counting job per table is unavoidable (different scans), but the union
    keeps it a single action.
    """
    if names is None:
        names = [t.name for t in spark.catalog.listTables()]
    parts = [spark.table(n).agg(F.count(F.lit(1)).alias("row_count"))
             .select(F.lit(n).alias("table_name"), "row_count") for n in names]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def write_feature_store(df: DataFrame, path: str, fmt: str = "parquet",
                        partition_by: list[str] | None = None,
                        mode: str = "overwrite") -> None:
    """Write a feature table (parquet or csv with header)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)


def write_results(results: dict[str, DataFrame], out_dir: str) -> None:
    """Each named result to ``<dir>/<name>.json`` and ``<dir>/<name>.csv``."""
    for name, df in results.items():
        df.write.mode("overwrite").json(os.path.join(out_dir, f"{name}.json"))
        df.write.mode("overwrite").option("header", True).csv(os.path.join(out_dir, f"{name}.csv"))


def read_macro(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object of scalar signals → a one-row DataFrame."""
    return spark.read.option("multiLine", True).json(path)
