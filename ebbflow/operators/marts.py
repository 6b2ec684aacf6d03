"""Reporting data marts (inventory O1–O9): the tables behind the workbooks and
BI extracts, each one projection or one grouped aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbflow.functions.columns import attach, TENURE_EDGES_D, TENURE_LABELS_D, bucketize, flag, risk_tier
from ebbflow.operators.features import SERVICE_COLS
from ebbflow.operators.ranks import exact_quantiles


def mart_kpis(df: DataFrame, p: str = "churn_probability", y: str = "Churn_binary",
              m: str = "MonthlyCharges") -> DataFrame:
    """O1: (metric, value) rows: customers, churn rate, predicted churners
    (p ≥ .5) and revenue at risk Σ p·m (X13)."""
    a = df.agg(F.count(F.lit(1)).cast("double").alias("customers"),
               F.avg(F.col(y).cast("double")).alias("churn_rate"),
               F.sum(flag(F.col(p) >= 0.5)).cast("double").alias("predicted_churners"),
               F.sum(F.col(p) * F.col(m)).alias("revenue_at_risk"))
    return a.unpivot([], ["customers", "churn_rate", "predicted_churners", "revenue_at_risk"],
                     "metric", "value")


def mart_churn_analysis(df: DataFrame, y: str = "Churn_binary") -> DataFrame:
    """O2: per contract count, sum and mean of the target."""
    return df.groupBy("Contract").agg(
        F.count(F.lit(1)).alias("count"), F.sum(F.col(y)).cast("long").alias("sum"),
        (F.sum(F.col(y)).cast("double") / F.count(F.lit(1))).alias("mean")).orderBy("Contract")


def mart_at_risk(df: DataFrame, p: str = "churn_probability", n: int = 100) -> DataFrame:
    """O3: top ``n`` customers by probability (id tie-break) — a top-k report."""
    return (df.select("customer_id", "Contract", "MonthlyCharges", p)
            .orderBy(F.desc(p), "customer_id").limit(n))


def mart_predictions(df: DataFrame, preds: DataFrame, key: str = "customer_id") -> DataFrame:
    """Every customer row with its probability (key join, never positional)."""
    return df.join(preds.select(key, "churn_probability"), key, "left")


def mart_prob_summary(df: DataFrame, p: str = "churn_probability") -> DataFrame:
    """Mean, exact median, population std, min, max."""
    x = F.col(p)
    med = exact_quantiles(df, p, [0.5]).select(F.col("quantile").alias("median"))
    return df.agg(F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.min(x).alias("min"),
                  F.max(x).alias("max")).transform(attach, med).select("mean", "median", "std", "min", "max")


def mart_customers(df: DataFrame, p: str = "churn_probability") -> DataFrame:
    """Id, demographics, contract, internet, probability and risk level."""
    return df.select("customer_id", "gender", "SeniorCitizen", "Contract", "InternetService", p,
                     risk_tier(p, "ge").alias("risk_level"))


def mart_services(df: DataFrame) -> DataFrame:
    """Id, contract and whichever service columns exist."""
    return df.select("customer_id", "Contract", *[c for c in SERVICE_COLS if c in df.columns])


def mart_cohorts(df: DataFrame, y: str = "Churn_binary") -> DataFrame:
    """Id, tenure, charge, target, contract and the scheme-d cohort."""
    return df.select("customer_id", "tenure", "MonthlyCharges", y, "Contract",
                     bucketize("tenure", TENURE_EDGES_D, TENURE_LABELS_D).alias("tenure_cohort"))


def mart_segments(df: DataFrame, y: str = "Churn_binary", cents: str = "monthly_cents") -> DataFrame:
    """Per contract n, churn rate, average charge and tenure."""
    n = F.count(F.lit(1))
    return df.groupBy("Contract").agg(
        n.alias("customers"), (F.sum(F.col(y)).cast("double") / n).alias("churn_rate"),
        (F.sum(F.col(cents)).cast("double") / (n * 100)).alias("avg_monthly_charges"),
        (F.sum("tenure").cast("double") / n).alias("avg_tenure")).orderBy("Contract")
