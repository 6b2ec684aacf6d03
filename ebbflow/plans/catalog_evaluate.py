"""Registered evaluation queries (K) over the deterministic stand-in score
``churn_probability`` = least(1, advanced_risk_score / 20), with oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ebbflow.operators import evaluate as K
from ebbflow.plans import datasets as D
from ebbflow.plans.oracle_features import on_customers


def _c(fn):
    return lambda spark, sf: fn(D.customers(spark, sf))


SCORE_CTE = """
t AS (SELECT churn_probability AS p, SUM(CAST(Churn_binary = 1 AS BIGINT)) AS pos,
             SUM(CAST(Churn_binary <> 1 AS BIGINT)) AS neg FROM customers GROUP BY 1)"""

SQL = {}
SQL["roc_auc"] = on_customers("""
SELECT CAST(SUM(pos * (neg_le - neg) * 2 + pos * neg) AS DOUBLE)
         / CAST(SUM(pos) * SUM(neg) * 2 AS DOUBLE) AS auc,
       CAST(SUM(pos) AS BIGINT) AS n_pos, CAST(SUM(neg) AS BIGINT) AS n_neg
FROM (SELECT *, SUM(neg) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
        AS neg_le FROM t)""", SCORE_CTE)

SQL["average_precision"] = on_customers("""
SELECT round(SUM(CAST(pos AS DOUBLE) * tp / (tp + fp)) / SUM(pos), 10) AS average_precision
FROM (SELECT *, SUM(pos) OVER (ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp,
             SUM(neg) OVER (ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fp
      FROM t)""", SCORE_CTE)

THRESH = """
SELECT {by}tp, fp, tn, fn,
  coalesce(CAST(tp AS DOUBLE) / CAST(NULLIF(tp + fp, 0) AS DOUBLE), 0.0) AS precision,
  coalesce(CAST(tp AS DOUBLE) / CAST(NULLIF(tp + fn, 0) AS DOUBLE), 0.0) AS recall,
  coalesce(CAST(2 * tp AS DOUBLE) / CAST(NULLIF(2 * tp + fp + fn, 0) AS DOUBLE), 0.0) AS f1
FROM (SELECT {by}CAST(SUM(CAST(p >= 0.5 AND y = 1 AS INTEGER)) AS BIGINT) AS tp,
        CAST(SUM(CAST(p >= 0.5 AND y <> 1 AS INTEGER)) AS BIGINT) AS fp,
        CAST(SUM(CAST(p < 0.5 AND y <> 1 AS INTEGER)) AS BIGINT) AS tn,
        CAST(SUM(CAST(p < 0.5 AND y = 1 AS INTEGER)) AS BIGINT) AS fn
      FROM {src} {group})"""

SQL["threshold_metrics"] = on_customers(THRESH.format(
    by="", src="(SELECT churn_probability AS p, Churn_binary AS y FROM customers)", group=""))

SQL["roc_points"] = on_customers("""
SELECT p AS threshold, CAST(fp AS DOUBLE) / n0 AS fpr, CAST(tp AS DOUBLE) / n1 AS tpr,
       CAST(tp AS DOUBLE) / (tp + fp) AS precision
FROM (SELECT *, SUM(pos) OVER (ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp,
             SUM(neg) OVER (ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fp,
             SUM(pos) OVER () AS n1, SUM(neg) OVER () AS n0 FROM t)""", SCORE_CTE)

LIFT_CTE = """
lift AS (
  SELECT customer_id, churn_probability,
    row_number() OVER w AS position,
    SUM(Churn_binary) OVER w AS cumulative_churn,
    SUM(Churn_binary * monthly_cents) OVER w AS cum_c,
    COUNT(*) OVER () AS n, SUM(Churn_binary) OVER () AS yt
  FROM customers
  WINDOW w AS (ORDER BY churn_probability DESC, customer_id
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""

SQL["lift_curve"] = on_customers("""
SELECT customer_id, churn_probability, CAST(position AS BIGINT) AS position,
  CAST(cumulative_churn AS BIGINT) AS cumulative_churn,
  CAST(position AS DOUBLE) / n AS cumulative_pct,
  CAST(cum_c AS DOUBLE) / 100.0::DOUBLE AS cumulative_mrr_saved,
  CAST(cumulative_churn * n AS DOUBLE) / CAST(position * yt AS DOUBLE) AS lift
FROM lift""", LIFT_CTE)

SQL["lift_summary"] = on_customers("""
SELECT max(CAST(cum_c AS DOUBLE) / 100.0::DOUBLE) AS top_mrr_saved,
       CAST(max(cumulative_churn) AS BIGINT) AS top_churners, CAST(max(position) AS BIGINT) AS top_n
FROM lift WHERE position <= floor(n * 0.2)""", LIFT_CTE)

SQL["temporal_split"] = on_customers("""
SELECT customer_id, CASE WHEN row_number() OVER (ORDER BY tenure, customer_id)
                              <= floor(COUNT(*) OVER () * 0.8) THEN 'train' ELSE 'test' END AS split
FROM customers""")

SQL["class_weights"] = on_customers("""
SELECT Churn_binary, COUNT(*) AS n_c,
  CAST((SELECT COUNT(*) FROM customers) AS DOUBLE) / (COUNT(*) * 2) AS balanced_weight,
  CAST((SELECT COUNT(*) FROM customers) - (SELECT SUM(Churn_binary) FROM customers) AS DOUBLE)
    / (SELECT SUM(Churn_binary) FROM customers) AS pos_weight
FROM customers GROUP BY Churn_binary""")

SQL["risk_tier_counts"] = on_customers("""
SELECT CASE WHEN churn_probability >= 0.6 THEN 'High' WHEN churn_probability >= 0.3 THEN 'Medium'
            ELSE 'Low' END AS risk_tier, COUNT(*) AS customers FROM customers GROUP BY 1""")

SQL["risk_tier_counts_cut"] = on_customers("""
SELECT CASE WHEN churn_probability > 0 AND churn_probability <= 0.3 THEN 'Low'
            WHEN churn_probability > 0.3 AND churn_probability <= 0.6 THEN 'Medium'
            WHEN churn_probability > 0.6 AND churn_probability <= 1.0 THEN 'High' END AS risk_tier,
       COUNT(*) AS customers FROM customers GROUP BY 1""")

PRED_CTE = """
preds AS (
  SELECT customer_id, Churn_binary, churn_probability,
    CASE WHEN churn_probability > 0 AND churn_probability <= 0.3 THEN 'Low'
         WHEN churn_probability > 0.3 AND churn_probability <= 0.6 THEN 'Medium'
         WHEN churn_probability > 0.6 AND churn_probability <= 1.0 THEN 'High' END AS risk_tier,
    MonthlyCharges AS monthly_charges,
    MonthlyCharges * 12 * churn_probability AS clv_at_risk_12m
  FROM customers),
ranked AS (
  SELECT *, CAST(floor(rank() OVER (ORDER BY clv_at_risk_12m DESC) - 1
           + (COUNT(*) OVER (PARTITION BY clv_at_risk_12m) + 1) / 2.0::DOUBLE) AS BIGINT)
           AS intervention_priority
  FROM preds)"""

SQL["customer_predictions"] = on_customers("SELECT * FROM ranked", PRED_CTE)

SQL["impact_summary"] = on_customers("""
SELECT CAST(sum(c) AS DOUBLE) / 100.0::DOUBLE AS total_mrr,
  CAST(sum(CASE WHEN risk_tier = 'High' THEN c ELSE 0 END) AS DOUBLE) / 100.0::DOUBLE AS high_tier_mrr,
  CAST(sum(CASE WHEN pos <= floor(n * 0.2) THEN c ELSE 0 END) AS DOUBLE) / 100.0::DOUBLE AS top_share_mrr
FROM (SELECT *, CAST(round(monthly_charges * 100) AS BIGINT) AS c,
             row_number() OVER (ORDER BY intervention_priority, customer_id) AS pos,
             COUNT(*) OVER () AS n FROM ranked)""", PRED_CTE)


MODELS_SQL = """
scores AS (
  SELECT 'advanced' AS model, customer_id, churn_probability AS p, Churn_binary AS y FROM customers
  UNION ALL SELECT 'base', customer_id, least(1.0::DOUBLE, base_risk_score / 9.0::DOUBLE), Churn_binary FROM customers
  UNION ALL SELECT 'contract', customer_id, contract_risk_score / 5.0::DOUBLE, Churn_binary FROM customers),
st AS (SELECT model, p, SUM(CAST(y = 1 AS BIGINT)) AS pos, SUM(CAST(y <> 1 AS BIGINT)) AS neg
       FROM scores GROUP BY 1, 2),
cum AS (SELECT *, SUM(neg) OVER (PARTITION BY model ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS neg_le,
               SUM(pos) OVER (PARTITION BY model ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp_d,
               SUM(neg) OVER (PARTITION BY model ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fp_d
        FROM st),
rank_m AS (SELECT model,
  CAST(SUM(pos * (neg_le - neg) * 2 + pos * neg) AS DOUBLE) / CAST(SUM(pos) * SUM(neg) * 2 AS DOUBLE) AS auc,
  CAST(SUM(pos) AS BIGINT) AS n_pos, CAST(SUM(neg) AS BIGINT) AS n_neg,
  round(SUM(CAST(pos AS DOUBLE) * tp_d / (tp_d + fp_d)) / SUM(pos), 10) AS average_precision
  FROM cum GROUP BY model),
th AS (""" + THRESH.format(by="model, ", src="scores", group="GROUP BY model") + """)"""

SQL["compare_models"] = on_customers("""
SELECT r.*, th.tp, th.fp, th.tn, th.fn, th.precision, th.recall, th.f1,
       r.model = (SELECT model FROM rank_m ORDER BY auc DESC, model LIMIT 1) AS best
FROM rank_m r JOIN th ON r.model = th.model""", MODELS_SQL)


def q_compare_models(spark, sf):
    c = D.customers(spark, sf)
    y = "Churn_binary"
    scores = (c.select(F.lit("advanced").alias("model"), "customer_id",
                       F.col("churn_probability").alias("p"), y)
              .unionByName(c.select(F.lit("base").alias("model"), "customer_id",
                                    F.least(F.lit(1.0), F.col("base_risk_score") / 9.0).alias("p"), y))
              .unionByName(c.select(F.lit("contract").alias("model"), "customer_id",
                                    (F.col("contract_risk_score") / 5.0).alias("p"), y)))
    return K.compare_models(scores, y=y, p="p")


def q_customer_predictions(spark, sf):
    return K.customer_predictions(D.customers(spark, sf))


QUERIES = {
    "roc_auc": (_c(K.roc_auc), SQL["roc_auc"]),
    "average_precision": (_c(K.average_precision), SQL["average_precision"]),
    "threshold_metrics": (_c(K.threshold_metrics), SQL["threshold_metrics"]),
    "roc_points": (_c(K.roc_points), SQL["roc_points"]),
    "lift_curve": (_c(K.lift_curve), SQL["lift_curve"]),
    "lift_summary": (_c(lambda d: K.lift_summary(K.lift_curve(d))), SQL["lift_summary"]),
    "temporal_split": (_c(lambda d: K.temporal_split(d).select("customer_id", "split")),
                       SQL["temporal_split"]),
    "class_weights": (_c(K.class_weights), SQL["class_weights"]),
    "risk_tier_counts": (_c(K.risk_tier_counts), SQL["risk_tier_counts"]),
    "risk_tier_counts_cut": (_c(lambda d: K.risk_tier_counts(d, rule="cut")),
                             SQL["risk_tier_counts_cut"]),
    "customer_predictions": (q_customer_predictions, SQL["customer_predictions"]),
    "impact_summary": (lambda spark, sf: K.impact_summary(q_customer_predictions(spark, sf)),
                       SQL["impact_summary"]),
    "compare_models": (q_compare_models, SQL["compare_models"]),
}
