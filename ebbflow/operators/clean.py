"""Cleaning and validation (inventory B1–B16).

Order matters (X11): coerce first, then apply the missing-value policy.
Statistics (median, mode, quartiles) are computed for all columns at once and
applied as a broadcast one-row frame — never collected into Python per column.
Quantiles come from one histogram of all columns (``ranks.coarse_histogram`` where the
rows are read again anyway), so that columns with any number of distinct values keep no
value map in a task.
"""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbflow.functions.columns import attach, flag
from ebbflow.operators.ranks import grouped_quantiles, quantile_row
from ebbflow.session import materialize

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
           T.DecimalType)


def numeric_columns(df: DataFrame, drop=()) -> list[str]:
    """Schema-driven list of numeric columns minus ``drop``."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NUMERIC) and f.name not in set(drop)]


def dedupe(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """B1: exact duplicate rows removed; second frame = (rows_before, rows_after,
    removed) computed lazily in one aggregation each side."""
    out = df.dropDuplicates()
    report = (df.agg(F.count(F.lit(1)).alias("rows_before"))
              .transform(attach, out.agg(F.count(F.lit(1)).alias("rows_after")))
              .withColumn("removed", F.col("rows_before") - F.col("rows_after")))
    return out, report


def coerce_numeric(df: DataFrame, cols) -> DataFrame:
    """B2: blank/unparseable → null (``try_cast``, ANSI-safe)."""
    return df.withColumns({c: F.trim(F.col(c).cast("string")).try_cast("double") for c in cols})


def fill_median(df: DataFrame, c: str) -> DataFrame:
    """Nulls → exact interpolated median."""
    med = quantile_row(df, {c: [0.5]}).select(F.col(c)[0].alias("_med"))
    return (df.transform(attach, med)
            .withColumn(c, F.coalesce(F.col(c), F.col("_med").cast(df.schema[c].dataType)))
            .drop("_med"))


def drop_missing(df: DataFrame, cols) -> DataFrame:
    """B4."""
    return df.dropna(subset=list(cols))


def fill_mode(df: DataFrame, cols) -> DataFrame:
    """Nulls → most frequent value; ties → smallest (deterministic mode)."""
    modes = df.agg(*[F.mode(F.col(c), True).alias(f"_mode_{c}") for c in cols])
    out = df.transform(attach, modes)
    out = out.withColumns({c: F.coalesce(F.col(c), F.col(f"_mode_{c}")) for c in cols})
    return out.drop(*[f"_mode_{c}" for c in cols])


def missing_profile(df: DataFrame) -> DataFrame:
    """Nulls per column (one aggregation, then unpivot) plus a total row."""
    cols = df.columns
    wide = df.agg(*[F.sum(flag(F.col(c).isNull())).cast("long").alias(c) for c in cols])
    long = wide.unpivot([], cols, "column", "null_count")
    total = long.agg(F.lit("__total__").alias("column"),
                     F.sum("null_count").cast("long").alias("null_count"))
    return long.unionByName(total)


def iqr_bounds(df: DataFrame, cols, k: float = 1.5) -> DataFrame:
    """Per column Q1, Q3, IQR, bounds and outlier count: exact quartiles of all columns
    together, then one aggregation over the rows; columns without a value have none."""
    cols = list(cols)
    qs = (grouped_quantiles(df, cols, [0.25, 0.75], reread=True)
          .select("column", F.col("q")[0].alias("q1"), F.col("q")[1].alias("q3")))
    qs = qs.withColumns({"iqr": F.col("q3") - F.col("q1")}).withColumns({
        "lower": F.col("q1") - k * F.col("iqr"), "upper": F.col("q3") + k * F.col("iqr")})
    qs = materialize(qs, "bounds")
    limits = qs.agg(F.map_from_entries(F.collect_list(F.struct("column", F.struct("lower", "upper")))).alias("_b"))
    wide = limits.select(*[F.col("_b")[c].alias(f"_b{i}") for i, c in enumerate(cols)])
    numbers = df.select(*[F.col(c).cast("double").alias(f"_v{i}") for i, c in enumerate(cols)]).transform(attach, wide)
    outside = lambda i: (F.col(f"_v{i}") < F.col(f"_b{i}.lower")) | (F.col(f"_v{i}") > F.col(f"_b{i}.upper"))
    outliers = numbers.agg(*[F.count_if(outside(i)).alias(c) for i, c in enumerate(cols)])
    return (qs.join(F.broadcast(outliers.unpivot([], cols, "column", "outliers")), "column")
            .select("column", "q1", "q3", "iqr", "lower", "upper", "outliers"))


def iqr_cap(df: DataFrame, cols, k: float = 1.5, cap_degenerate: bool = False) -> DataFrame:
    """Clip to [Q1 − k·IQR, Q3 + k·IQR]. Columns with IQR = 0 (e.g. rare 0/1
    flags) are left alone unless ``cap_degenerate`` (X10)."""
    q = quantile_row(df, {c: [0.25, 0.75] for c in cols}, reread=True)
    out = df.transform(attach, q.select(*[F.col(c).alias(f"_q_{c}") for c in cols]))
    exprs = {}
    for c in cols:
        q1, q3 = F.col(f"_q_{c}")[0], F.col(f"_q_{c}")[1]
        iqr = q3 - q1
        capped = F.least(F.greatest(F.col(c), q1 - k * iqr), q3 + k * iqr)
        keep = F.lit(False) if cap_degenerate else (iqr == 0)
        exprs[c] = F.when(keep | F.col(c).isNull(), F.col(c).cast("double")).otherwise(
            capped.cast("double"))
    return out.withColumns(exprs).drop(*[f"_q_{c}" for c in cols])


def encode_yes_no(df: DataFrame, cols) -> DataFrame:
    """B8: 'Yes' → 1, anything else (incl. 'No internet service', null) → 0;
    only string columns are touched."""
    types = dict(df.dtypes)
    return df.withColumns({c: flag(F.col(c) == "Yes") for c in cols if types.get(c) == "string"})


def auto_encode_yes_no(df: DataFrame) -> DataFrame:
    """Encode only string columns whose every value is Yes/No (null
    disqualifies) — eligibility decided by one ``bool_and`` aggregation."""
    strings = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not strings:
        return df
    row = df.agg(*[F.bool_and(F.coalesce(F.col(c).isin("Yes", "No"), F.lit(False))).alias(c)
                   for c in strings]).first()
    eligible = [c for c in strings if row[c]]
    return df.withColumns({c: flag(F.col(c) == "Yes") for c in eligible})


def binary_target(df: DataFrame, src: str = "Churn", dst: str = "Churn_binary") -> DataFrame:
    """B10."""
    return df.withColumn(dst, flag(F.col(src) == "Yes"))


def fill_zero(df: DataFrame, cols=None) -> DataFrame:
    """B11."""
    return df.fillna(0, subset=list(cols) if cols else None)


# Scoring request constraints (column, min, max, required).
REQUEST_RULES = [
    ("tenure", 0, 72, True), ("MonthlyCharges", 0, None, True), ("TotalCharges", 0, None, True),
    ("SeniorCitizen", 0, 1, True), ("Partner", 0, 1, True), ("Dependents", 0, 1, True),
    ("PhoneService", 0, 1, True), ("PaperlessBilling", 0, 1, True),
    ("OnlineSecurity", 0, 1, False), ("OnlineBackup", 0, 1, False),
    ("DeviceProtection", 0, 1, False), ("TechSupport", 0, 1, False),
    ("StreamingTV", 0, 1, False), ("StreamingMovies", 0, 1, False),
    ("Contract", None, None, True), ("InternetService", None, None, True),
    ("PaymentMethod", None, None, True),
]


def validate_rows(df: DataFrame, rules=REQUEST_RULES) -> DataFrame:
    """Add ``errors`` (array of messages) and ``is_valid``; optional
    columns default to 0. Split with ``filter('is_valid')``."""
    fills = {c: F.coalesce(F.col(c), F.lit(0)) for c, _, _, req in rules
             if not req and c in df.columns}
    out = df.withColumns(fills)
    checks = []
    for c, lo, hi, req in rules:
        if c not in out.columns:
            if req:
                checks.append(F.lit(f"{c}: missing"))
            continue
        x = F.col(c)
        if req:
            checks.append(F.when(x.isNull(), F.lit(f"{c}: required")))
        if lo is not None:
            checks.append(F.when(x < lo, F.lit(f"{c}: below {lo}")))
        if hi is not None:
            checks.append(F.when(x > hi, F.lit(f"{c}: above {hi}")))
    errors = F.array_compact(F.array(*checks))
    return out.withColumn("errors", errors).withColumn("is_valid", F.size("errors") == 0)


def quality_checks(df: DataFrame, target="Churn_binary", charge="MonthlyCharges",
                   tenure="tenure", rate_bounds=(0.05, 0.50), min_rows: int = 1000) -> DataFrame:
    """(check, passed, observed) from one aggregation."""
    a = df.agg(F.count(F.lit(1)).alias("n"),
               F.sum(flag(F.col(target).isNull())).alias("null_target"),
               F.sum(flag(F.col(charge) < 0)).alias("neg_charge"),
               F.sum(flag((F.col(tenure) < 0) | (F.col(tenure) > 72))).alias("bad_tenure"),
               F.avg(F.col(target).cast("double")).alias("rate"))
    lo, hi = rate_bounds
    rows = [
        ("not_empty", F.col("n") > 0, F.col("n").cast("double")),
        ("no_null_target", F.col("null_target") == 0, F.col("null_target").cast("double")),
        ("charges_non_negative", F.col("neg_charge") == 0, F.col("neg_charge").cast("double")),
        ("tenure_in_range", F.col("bad_tenure") == 0, F.col("bad_tenure").cast("double")),
        ("churn_rate_plausible", F.col("rate").between(lo, hi), F.col("rate")),
        ("min_rows", F.col("n") >= min_rows, F.col("n").cast("double")),
    ]
    structs = F.array(*[F.struct(F.lit(n).alias("check"), F.coalesce(p, F.lit(False)).alias("passed"),
                                 o.alias("observed")) for n, p, o in rows])
    return a.select(F.inline(structs))


def describe(df: DataFrame, cols=None) -> DataFrame:
    """count/mean/std/min/quartiles/max per numeric column: one aggregation for
    the moments of all columns, one histogram for their exact quartiles."""
    cols = cols or numeric_columns(df)
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        aggs.append(F.struct(
            F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
            F.min(x).alias("min"), F.max(x).alias("max")).alias(c))
    long = df.agg(*aggs).unpivot([], cols, "column", "s")
    q = grouped_quantiles(df, cols, [0.25, 0.5, 0.75], reread=True).select("column", "q")
    return long.join(F.broadcast(q), "column", "left").select(
        "column", F.col("s.count").alias("count"), F.col("s.mean").alias("mean"),
        F.col("s.std").alias("std"), F.col("s.min").alias("min"),
        F.col("q")[0].alias("q25"), F.col("q")[1].alias("q50"),
        F.col("q")[2].alias("q75"), F.col("s.max").alias("max"))
