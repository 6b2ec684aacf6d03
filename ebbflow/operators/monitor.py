"""Monitoring, gates and alerts (inventory E12, N1–N5, N7–N9, N11).

Many-column statistics are computed by unpivoting once and grouping by
feature — one job for all features, never one job per column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbflow.functions.columns import attach, flag
from ebbflow.functions.stats import ks_p_expr
from ebbflow.operators.evaluate import roc_auc, threshold_metrics
from ebbflow.operators.ranks import exact_quantiles, first_fraction_flag, grouped_prefix_sums
from ebbflow.session import materialize


def row_slice_split(df: DataFrame, order, frac: float, first: str = "reference",
                    rest: str = "current", name: str = "window") -> DataFrame:
    """First ⌊frac·n⌋ rows in ``order`` (ascending key columns) vs the rest;
    positions are computed on the keys only, rows are labelled against the cut key."""
    cols = [o[0] if isinstance(o, tuple) else o for o in order]
    return first_fraction_flag(df, cols, frac, name, first, rest)


def window_histogram(tagged: DataFrame, cols: list[str], window: str = "window",
                     ref: str = "reference", cur: str = "current") -> DataFrame:
    """(feature, v, n_ref, n_cur): how often each non-null value of each column occurs in the
    two windows, by one unpivot and one partial aggregation."""
    is_r, is_c = F.col(window) == ref, F.col(window) == cur
    return (tagged.select(window, *[F.col(c).cast("double").alias(c) for c in cols])
            .unpivot(window, cols, "feature", "v").where(F.col("v").isNotNull())
            .groupBy("feature", "v").agg(F.sum(flag(is_r)).cast("long").alias("n_ref"),
                                         F.sum(flag(is_c)).cast("long").alias("n_cur")))


def drift_statistics(tagged: DataFrame, cols: list[str], window: str = "window",
                     ref: str = "reference", cur: str = "current", min_values: int = 10,
                     bounded: bool = False) -> DataFrame:
    """N1 statistics for all features in one job: means, reference sample sd,
    mean shift in reference sds and the two-sample KS statistic (exact). The rows
    are read once, into a histogram that is written; all else comes from it."""
    h = window_histogram(tagged, cols, window, ref, cur)
    return histogram_drift(h if bounded else materialize(h, "drift"), min_values, bounded)


def reference_histogram(reference: DataFrame, cols: list[str], path: str) -> DataFrame:
    """(feature, v, n_ref) of a reference sample, written to ``path`` once: what drift of any later
    data against it needs. The sample itself is not read again."""
    h = window_histogram(reference.select(*cols).withColumn("window", F.lit("reference")), cols).drop("n_cur")
    h.write.mode("overwrite").parquet(path)
    return reference.sparkSession.read.schema(h.schema).parquet(path)


def drift_against(reference: DataFrame, current: DataFrame, cols: list[str], min_values: int = 10,
                  bounded: bool = False) -> DataFrame:
    """N1 statistics of ``current`` against a ``reference_histogram``."""
    cur = window_histogram(current.select(*cols).withColumn("window", F.lit("current")), cols).drop("n_ref")
    zero = F.lit(0).cast("long")
    both = (reference.withColumn("n_cur", zero).unionByName(cur.withColumn("n_ref", zero))
            .groupBy("feature", "v").agg(F.sum("n_ref").alias("n_ref"), F.sum("n_cur").alias("n_cur")))
    return histogram_drift(both if bounded else materialize(both, "drift"), min_values, bounded)


def histogram_drift(h: DataFrame, min_values: int = 10, bounded: bool = False) -> DataFrame:
    """N1 statistics from a ``window_histogram`` that is cheap to read again."""
    v, a, b = F.col("v"), F.col("n_ref"), F.col("n_cur")
    mean = lambda n: F.sum(v * n) / F.nullif(F.sum(n), F.lit(0))
    mom = h.groupBy("feature").agg(F.sum(a).alias("_nr"), F.sum(b).alias("_nc"), mean(a).alias("ref_mean"), mean(b).alias("cur_mean"))
    cum = grouped_prefix_sums(h, ["feature"], [("v", True)], {"_ca": a, "_cb": b}, bounded=bounded)
    far = F.abs(F.col("_ca") * F.col("_nc") - F.col("_cb") * F.col("_nr"))
    out = (cum.join(F.broadcast(mom), "feature").groupBy("feature", "_nr", "_nc", "ref_mean", "cur_mean")
           .agg(F.max(far).alias("_num"), F.sum(a * (v - F.col("ref_mean")) * (v - F.col("ref_mean"))).alias("_square"))
           .where((F.col("_nr") >= min_values) & (F.col("_nc") >= min_values)))
    sd = F.sqrt(F.col("_square") / F.nullif(F.col("_nr") - 1, F.lit(0)))
    return out.select("feature", "ref_mean", "cur_mean",
                      (F.abs(F.col("cur_mean") - F.col("ref_mean")) / (sd + 1e-8)).alias("mean_shift_sigma"),
                      (F.col("_num").cast("double") / (F.col("_nr") * F.col("_nc")).cast("double")).alias("ks_statistic"),
                      F.col("_nr").alias("n_ref"), F.col("_nc").alias("n_cur"))


def drift_report(tagged: DataFrame, cols: list[str], window: str = "window",
                 shift_limit: float = 0.1, alpha: float = 0.05) -> DataFrame:
    """Statistics + KS p-value, drift flag (p < α or shift > limit) and
    severity (HIGH p < .01, MEDIUM p < .05, else LOW), by KS statistic desc."""
    s = drift_statistics(tagged, cols, window)
    s = s.withColumn("ks_p_value", ks_p_expr("ks_statistic", F.col("n_ref").cast("double"),
                                             F.col("n_cur").cast("double")))
    return (s.withColumn("drift_detected", (F.col("ks_p_value") < alpha)
                         | (F.col("mean_shift_sigma") > shift_limit))
            .withColumn("severity", F.when(F.col("ks_p_value") < 0.01, "HIGH")
                        .when(F.col("ks_p_value") < 0.05, "MEDIUM").otherwise("LOW"))
            .orderBy(F.desc("ks_statistic"), "feature"))


def drift_summary(report: DataFrame) -> DataFrame:
    """Checked / drifted / stable and the overall level (>5 HIGH, >2 MEDIUM)."""
    a = report.agg(F.count(F.lit(1)).alias("checked"),
                   F.sum(flag(F.col("drift_detected"))).cast("long").alias("drifted"))
    return (a.withColumn("stable", F.col("checked") - F.col("drifted"))
            .withColumn("drift_level", F.when(F.col("drifted") > 5, "HIGH")
                        .when(F.col("drifted") > 2, "MEDIUM").otherwise("LOW")))


def performance_report(scored: DataFrame, window: str = "window", p: str = "churn_probability",
                       y: str = "Churn_binary", threshold: float = 0.5) -> DataFrame:
    """AUC, F1, precision, recall, n and churn rate per window; windows
    with a single class are skipped."""
    base = scored.groupBy(window).agg(F.count(F.lit(1)).alias("n_samples"),
                                      F.avg(F.col(y).cast("double")).alias("churn_rate"),
                                      F.countDistinct(y).alias("_classes"))
    auc = roc_auc(scored, p, y, by=[window]).select(window, F.col("auc").alias("roc_auc"))
    th = threshold_metrics(scored, p, y, threshold, by=[window]).select(
        window, "f1", "precision", "recall")
    return (base.where(F.col("_classes") > 1).drop("_classes")
            .join(auc, window).join(th, window))


def performance_delta(report: DataFrame, window: str = "window", ref: str = "reference",
                      cur: str = "current", metrics=("roc_auc", "f1", "precision", "recall"),
                      limit: float = 0.05) -> DataFrame:
    """Current − reference per metric, flagged when |Δ| > ``limit``."""
    long = report.select(window, *metrics).unpivot(window, list(metrics), "metric", "value")
    g = long.groupBy("metric").agg(
        F.max(F.when(F.col(window) == ref, F.col("value"))).alias("reference"),
        F.max(F.when(F.col(window) == cur, F.col("value"))).alias("current"))
    return (g.withColumn("delta", F.col("current") - F.col("reference"))
            .withColumn("flagged", F.abs(F.col("delta")) > limit))


def prediction_distribution(preds: DataFrame, p: str = "churn_probability") -> DataFrame:
    """Mean, exact median, sample std, min, max and tier shares."""
    x = F.col(p)
    n = F.count(F.lit(1))
    med = exact_quantiles(preds, p, [0.5]).select(F.col("quantile").alias("median_probability"))
    return preds.agg(
        F.avg(x).alias("mean_probability"),
        F.stddev_samp(x).alias("std_probability"), F.min(x).alias("min_probability"),
        F.max(x).alias("max_probability"),
        (F.sum(flag(x >= 0.6)) * 100).cast("double").alias("_h"),
        (F.sum(flag((x >= 0.3) & (x < 0.6))) * 100).cast("double").alias("_m"),
        (F.sum(flag(x < 0.3)) * 100).cast("double").alias("_l"), n.alias("_n"),
    ).transform(attach, med).select("mean_probability", "median_probability", "std_probability", "min_probability",
             "max_probability", (F.col("_h") / F.col("_n")).alias("pct_high_risk"),
             (F.col("_m") / F.col("_n")).alias("pct_medium_risk"),
             (F.col("_l") / F.col("_n")).alias("pct_low_risk"))


def refresh_predictions(preds: DataFrame, as_of: str, p: str = "churn_probability") -> tuple:
    """Stamp ``last_updated`` (an argument, so reruns are reproducible) and
    count high-risk rows; returns (stamped frame, 1-row summary)."""
    stamped = preds.withColumn("last_updated", F.lit(as_of).cast("timestamp_ntz"))
    summary = preds.agg(F.count(F.lit(1)).alias("updated"),
                        F.sum(flag(F.col(p) >= 0.6)).cast("long").alias("high_risk"))
    return stamped, summary.withColumn("last_updated", F.lit(as_of).cast("timestamp_ntz"))


def retrain_gate(scored: DataFrame, order, p: str = "churn_probability",
                 y: str = "Churn_binary", holdout: float = 0.2, threshold: float = 0.70) -> DataFrame:
    """AUC on the last ``holdout`` share of rows vs a threshold → decision."""
    split = row_slice_split(scored, order, 1 - holdout, "older", "recent")
    auc = roc_auc(split.where(F.col("window") == "recent"), p, y)
    return auc.select("auc", F.lit(threshold).alias("threshold"),
                      F.when(F.col("auc") >= threshold, "retain").otherwise("retrain")
                      .alias("decision"))


def alerts(preds: DataFrame, p: str = "churn_probability", cents: str = "monthly_cents",
           high: float = 0.6, max_high: int = 100, max_mrr: float = 5000.0) -> DataFrame:
    """HIGH when more than ``max_high`` customers are high risk; WARNING
    when their MRR exceeds ``max_mrr``; otherwise one all-clear row."""
    return alert_rows(preds.agg(*risk_totals(p, cents, high)), max_high, max_mrr)


def risk_totals(p: str = "churn_probability", cents: str = "monthly_cents", high: float = 0.6) -> list:
    """High-risk customers and their monthly revenue, as aggregates."""
    hr = F.col(p) >= high
    return [F.sum(flag(hr)).cast("long").alias("high_risk"),
            (F.sum(F.when(hr, F.col(cents)).otherwise(0)).cast("double") / 100).alias("mrr_at_risk")]


def alert_rows(totals: DataFrame, max_high: int = 100, max_mrr: float = 5000.0) -> DataFrame:
    """The alerts of each row of ``risk_totals``: its other columns, level, message, figures."""
    keep = [c for c in totals.columns if c not in ("high_risk", "mrr_at_risk")]
    msgs = F.array_compact(F.array(
        F.when(F.col("high_risk") > max_high,
               F.struct(F.lit("HIGH").alias("level"),
                        F.format_string("%d customers at high churn risk", F.col("high_risk"))
                        .alias("message"))),
        F.when(F.col("mrr_at_risk") > max_mrr,
               F.struct(F.lit("WARNING").alias("level"),
                        F.format_string("$%.2f/month MRR at risk", F.col("mrr_at_risk"))
                        .alias("message")))))
    ok = F.array(F.struct(F.lit("OK").alias("level"), F.lit("No critical alerts").alias("message")))
    return totals.select(*keep, F.explode(F.when(F.size(msgs) > 0, msgs).otherwise(ok)).alias("a"),
                         "high_risk", "mrr_at_risk").select(*keep, "a.level", "a.message", "high_risk", "mrr_at_risk")


def quality_report(tagged: DataFrame, cols: list[str], window: str = "window") -> DataFrame:
    """Per window and column: rows, nulls, distinct values, min, max, mean —
    one unpivot, one aggregation."""
    long = (tagged.select(window, *[F.col(c).cast("double").alias(c) for c in cols])
            .unpivot(window, cols, "column", "v"))
    return long.groupBy(window, "column").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(flag(F.col("v").isNull())).cast("long").alias("nulls"),
        F.countDistinct("v").alias("distinct"), F.min("v").alias("min"), F.max("v").alias("max"),
        F.avg("v").alias("mean"))
