"""Registered monitoring, mart, scoring and archetype queries with oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ebbflow.operators import archetypes as J
from ebbflow.operators import marts as O
from ebbflow.operators import monitor as N
from ebbflow.operators import scoring as M
from ebbflow.plans import datasets as D
from ebbflow.plans.catalog_segments import FEATURE_COLS
from ebbflow.plans.oracle_base import ks_p_sql
from ebbflow.plans.oracle_features import on_customers

# every numeric column
DRIFT_FEATURES = [c for c in FEATURE_COLS if c not in ("customer_id", "Churn_binary", "churn_probability")]
AS_OF = "2024-02-01 00:00:00"


def _c(fn):
    return lambda spark, sf: fn(D.customers(spark, sf))


def _tagged(spark, sf):
    return N.row_slice_split(D.customers(spark, sf), [("customer_id", True)], 0.7)


TAG_CTE = """
tagged AS (
  SELECT *, CASE WHEN row_number() OVER (ORDER BY customer_id) <= floor(COUNT(*) OVER () * 0.7)
                 THEN 'reference' ELSE 'current' END AS "window"
  FROM customers)"""

_cast = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in DRIFT_FEATURES)
LONG_CTE = f"""
long AS (
  UNPIVOT (SELECT "window", {_cast} FROM tagged)
  ON {", ".join(DRIFT_FEATURES)} INTO NAME feature VALUE v)"""


def q_drift_statistics(spark, sf):
    s = N.drift_statistics(_tagged(spark, sf), DRIFT_FEATURES)
    return s.select("feature", *[F.round(c, 6).alias(c) for c in
                                 ("ref_mean", "cur_mean", "mean_shift_sigma")],
                    "ks_statistic", "n_ref", "n_cur")


_DRIFT_RAW = """
SELECT m.feature, ref_mean, cur_mean,
  abs(cur_mean - ref_mean) / (ref_std + 1e-8::DOUBLE) AS mean_shift_sigma,
  CAST(k.num AS DOUBLE) / CAST(m.n_ref * m.n_cur AS DOUBLE) AS ks_statistic, m.n_ref, m.n_cur
FROM (SELECT feature, avg(CASE WHEN "window" = 'reference' THEN v END) AS ref_mean,
        avg(CASE WHEN "window" = 'current' THEN v END) AS cur_mean,
        stddev_samp(CASE WHEN "window" = 'reference' THEN v END) AS ref_std,
        CAST(SUM(CAST("window" = 'reference' AS INTEGER)) AS BIGINT) AS n_ref,
        CAST(SUM(CAST("window" = 'current' AS INTEGER)) AS BIGINT) AS n_cur
      FROM long WHERE v IS NOT NULL GROUP BY feature) m
JOIN (SELECT feature, max(abs(ca * n_cur - cb * n_ref)) AS num
      FROM (SELECT h.*, SUM(a) OVER w AS ca, SUM(b) OVER w AS cb,
                   SUM(a) OVER (PARTITION BY feature) AS n_ref, SUM(b) OVER (PARTITION BY feature) AS n_cur
            FROM (SELECT feature, v, SUM(CAST("window" = 'reference' AS BIGINT)) AS a,
                         SUM(CAST("window" = 'current' AS BIGINT)) AS b
                  FROM long WHERE v IS NOT NULL GROUP BY 1, 2) h
            WINDOW w AS (PARTITION BY feature ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
      GROUP BY feature) k ON m.feature = k.feature
WHERE m.n_ref >= 10 AND m.n_cur >= 10"""
SQL_DRIFT = on_customers("""
SELECT feature, round(ref_mean, 6) AS ref_mean, round(cur_mean, 6) AS cur_mean,
  round(mean_shift_sigma, 6) AS mean_shift_sigma, ks_statistic, n_ref, n_cur FROM drift_raw""",
                         TAG_CTE, LONG_CTE, f"drift_raw AS ({_DRIFT_RAW})")
_KSP = ks_p_sql("ks_statistic", "CAST(n_ref AS DOUBLE)", "CAST(n_cur AS DOUBLE)")
_REPORT_CTE = f"""
report AS (
  SELECT *, {_KSP} AS ks_p_value FROM drift_raw)"""
SQL_DRIFT_REPORT = on_customers("""
SELECT feature, round(ref_mean, 6) AS ref_mean, round(cur_mean, 6) AS cur_mean,
  round(mean_shift_sigma, 6) AS mean_shift_sigma, ks_statistic, n_ref, n_cur,
  round(ks_p_value, 9) AS ks_p_value, ks_p_value < 0.05 OR mean_shift_sigma > 0.1 AS drift_detected,
  CASE WHEN ks_p_value < 0.01 THEN 'HIGH' WHEN ks_p_value < 0.05 THEN 'MEDIUM' ELSE 'LOW' END AS severity
FROM report""", TAG_CTE, LONG_CTE, f"drift_raw AS ({_DRIFT_RAW})", _REPORT_CTE)
SQL_DRIFT_SUMMARY = on_customers("""
SELECT COUNT(*) AS checked, CAST(SUM(CAST(drifted AS INTEGER)) AS BIGINT) AS drifted,
  COUNT(*) - CAST(SUM(CAST(drifted AS INTEGER)) AS BIGINT) AS stable,
  CASE WHEN SUM(CAST(drifted AS INTEGER)) > 5 THEN 'HIGH' WHEN SUM(CAST(drifted AS INTEGER)) > 2
       THEN 'MEDIUM' ELSE 'LOW' END AS drift_level
FROM (SELECT ks_p_value < 0.05 OR mean_shift_sigma > 0.1 AS drifted FROM report)""",
                                 TAG_CTE, LONG_CTE, f"drift_raw AS ({_DRIFT_RAW})", _REPORT_CTE)


def q_drift_report(spark, sf):
    r = N.drift_report(_tagged(spark, sf), DRIFT_FEATURES)
    return r.select("feature", *[F.round(c, 6).alias(c) for c in
                                 ("ref_mean", "cur_mean", "mean_shift_sigma")],
                    "ks_statistic", "n_ref", "n_cur", F.round("ks_p_value", 9).alias("ks_p_value"),
                    "drift_detected", "severity")


PERF_CTE = """
st AS (SELECT "window", churn_probability AS p, SUM(CAST(Churn_binary = 1 AS BIGINT)) AS pos,
              SUM(CAST(Churn_binary <> 1 AS BIGINT)) AS neg FROM tagged GROUP BY 1, 2),
auc AS (SELECT "window", CAST(SUM(pos * (neg_le - neg) * 2 + pos * neg) AS DOUBLE)
                          / CAST(SUM(pos) * SUM(neg) * 2 AS DOUBLE) AS roc_auc
        FROM (SELECT *, SUM(neg) OVER (PARTITION BY "window" ORDER BY p
                                       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS neg_le FROM st)
        GROUP BY 1),
th AS (SELECT "window", COUNT(*) AS n_samples, avg(CAST(Churn_binary AS DOUBLE)) AS churn_rate,
         COUNT(DISTINCT Churn_binary) AS classes,
         SUM(CAST(churn_probability >= 0.5 AND Churn_binary = 1 AS BIGINT)) AS tp,
         SUM(CAST(churn_probability >= 0.5 AND Churn_binary <> 1 AS BIGINT)) AS fp,
         SUM(CAST(churn_probability < 0.5 AND Churn_binary = 1 AS BIGINT)) AS fn
       FROM tagged GROUP BY 1),
perf AS (
  SELECT th."window", n_samples, churn_rate, roc_auc,
    coalesce(CAST(2 * tp AS DOUBLE) / CAST(NULLIF(2 * tp + fp + fn, 0) AS DOUBLE), 0.0) AS f1,
    coalesce(CAST(tp AS DOUBLE) / CAST(NULLIF(tp + fp, 0) AS DOUBLE), 0.0) AS precision,
    coalesce(CAST(tp AS DOUBLE) / CAST(NULLIF(tp + fn, 0) AS DOUBLE), 0.0) AS recall
  FROM th JOIN auc ON th."window" = auc."window" WHERE classes > 1)"""

SQL_PERF = on_customers('SELECT * FROM perf', TAG_CTE, PERF_CTE)

SQL_PERF_DELTA = on_customers("""
SELECT metric, reference, current, current - reference AS delta, abs(current - reference) > 0.05 AS flagged
FROM (SELECT metric, max(CASE WHEN "window" = 'reference' THEN value END) AS reference,
             max(CASE WHEN "window" = 'current' THEN value END) AS current
      FROM (UNPIVOT (SELECT "window", roc_auc, f1, precision, recall FROM perf)
            ON roc_auc, f1, precision, recall INTO NAME metric VALUE value)
      GROUP BY metric)""", TAG_CTE, PERF_CTE)


def q_pred_dist(spark, sf):
    d = N.prediction_distribution(D.customers(spark, sf))
    return d.select(*[F.round(c, 9).alias(c) for c in d.columns])


SQL_PRED_DIST = on_customers("""
SELECT round(avg(churn_probability), 9) AS mean_probability,
  round(quantile_cont(churn_probability, 0.5), 9) AS median_probability,
  round(stddev_samp(churn_probability), 9) AS std_probability,
  round(min(churn_probability), 9) AS min_probability, round(max(churn_probability), 9) AS max_probability,
  round(CAST(100 * SUM(CAST(churn_probability >= 0.6 AS INTEGER)) AS DOUBLE) / COUNT(*), 9) AS pct_high_risk,
  round(CAST(100 * SUM(CAST(churn_probability >= 0.3 AND churn_probability < 0.6 AS INTEGER)) AS DOUBLE)
        / COUNT(*), 9) AS pct_medium_risk,
  round(CAST(100 * SUM(CAST(churn_probability < 0.3 AS INTEGER)) AS DOUBLE) / COUNT(*), 9) AS pct_low_risk
FROM customers""")

SQL_REFRESH = on_customers(f"""
SELECT COUNT(*) AS updated, CAST(SUM(CAST(churn_probability >= 0.6 AS INTEGER)) AS BIGINT) AS high_risk,
       TIMESTAMP '{AS_OF}' AS last_updated FROM customers""")

SQL_RETRAIN = on_customers("""
SELECT auc, 0.7::DOUBLE AS threshold, CASE WHEN auc >= 0.7 THEN 'retain' ELSE 'retrain' END AS decision
FROM (SELECT CAST(SUM(pos * (neg_le - neg) * 2 + pos * neg) AS DOUBLE)
               / CAST(SUM(pos) * SUM(neg) * 2 AS DOUBLE) AS auc
      FROM (SELECT *, SUM(neg) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS neg_le
            FROM (SELECT churn_probability AS p, SUM(CAST(Churn_binary = 1 AS BIGINT)) AS pos,
                         SUM(CAST(Churn_binary <> 1 AS BIGINT)) AS neg
                  FROM (SELECT *, row_number() OVER (ORDER BY customer_id) AS pos_,
                               COUNT(*) OVER () AS n_ FROM customers)
                  WHERE pos_ > floor(n_ * 0.8) GROUP BY 1)))""")

SQL_ALERTS = on_customers("""
SELECT * FROM m
UNION ALL SELECT 'OK', 'No critical alerts', high_risk, mrr_at_risk FROM a
WHERE (SELECT COUNT(*) FROM m) = 0""", """
a AS (SELECT CAST(SUM(CAST(churn_probability >= 0.6 AS INTEGER)) AS BIGINT) AS high_risk,
             CAST(SUM(CASE WHEN churn_probability >= 0.6 THEN monthly_cents ELSE 0 END) AS DOUBLE) / 100
               AS mrr_at_risk FROM customers),
m AS (SELECT 'HIGH' AS level, printf('%d customers at high churn risk', high_risk) AS message,
             high_risk, mrr_at_risk FROM a WHERE high_risk > 100
      UNION ALL SELECT 'WARNING', printf('$%.2f/month MRR at risk', mrr_at_risk), high_risk, mrr_at_risk
      FROM a WHERE mrr_at_risk > 5000)""")


def q_alerts(spark, sf):
    return N.alerts(D.customers(spark, sf))


# ------------------------------------------------------------------ marts
SQL_MART_KPIS = on_customers("""
UNPIVOT (SELECT CAST(COUNT(*) AS DOUBLE) AS customers, avg(CAST(Churn_binary AS DOUBLE)) AS churn_rate,
                CAST(SUM(CAST(churn_probability >= 0.5 AS INTEGER)) AS DOUBLE) AS predicted_churners,
                round(SUM(churn_probability * MonthlyCharges), 6) AS revenue_at_risk FROM customers)
ON customers, churn_rate, predicted_churners, revenue_at_risk INTO NAME metric VALUE value""")


def q_mart_kpis(spark, sf):
    k = O.mart_kpis(D.customers(spark, sf))
    return k.withColumn("value", F.when(F.col("metric") == "revenue_at_risk", F.round("value", 6))
                        .otherwise(F.col("value")))


SQL_MARTS = {
    "mart_churn_analysis": """SELECT Contract, COUNT(*) AS count, CAST(SUM(Churn_binary) AS BIGINT) AS sum,
        CAST(SUM(Churn_binary) AS DOUBLE) / COUNT(*) AS mean FROM customers GROUP BY Contract""",
    "mart_at_risk": """SELECT customer_id, Contract, MonthlyCharges, churn_probability FROM customers
        ORDER BY churn_probability DESC, customer_id LIMIT 100""",
    "mart_prob_summary": """SELECT round(avg(churn_probability), 9) AS mean,
        round(quantile_cont(churn_probability, 0.5), 9) AS median,
        round(stddev_pop(churn_probability), 9) AS std, round(min(churn_probability), 9) AS min,
        round(max(churn_probability), 9) AS max FROM customers""",
    "mart_customers": """SELECT customer_id, gender, SeniorCitizen, Contract, InternetService, churn_probability,
        CASE WHEN churn_probability >= 0.6 THEN 'High' WHEN churn_probability >= 0.3 THEN 'Medium'
             ELSE 'Low' END AS risk_level FROM customers""",
    "mart_services": """SELECT customer_id, Contract, OnlineSecurity, OnlineBackup, DeviceProtection,
        TechSupport, StreamingTV, StreamingMovies FROM customers""",
    "mart_cohorts": """SELECT customer_id, tenure, MonthlyCharges, Churn_binary, Contract,
        CASE WHEN tenure > 0 AND tenure <= 6 THEN '0-6m' WHEN tenure > 6 AND tenure <= 12 THEN '6-12m'
             WHEN tenure > 12 AND tenure <= 24 THEN '12-24m' WHEN tenure > 24 AND tenure <= 72 THEN '24m+'
        END AS tenure_cohort FROM customers""",
    "mart_segments": """SELECT Contract, COUNT(*) AS customers, CAST(SUM(Churn_binary) AS DOUBLE) / COUNT(*) AS churn_rate,
        CAST(SUM(monthly_cents) AS DOUBLE) / CAST(COUNT(*) * 100 AS DOUBLE) AS avg_monthly_charges,
        CAST(SUM(tenure) AS DOUBLE) / COUNT(*) AS avg_tenure FROM customers GROUP BY Contract""",
}


def q_prob_summary(spark, sf):
    s = O.mart_prob_summary(D.customers(spark, sf))
    return s.select(*[F.round(c, 9).alias(c) for c in s.columns])


# ------------------------------------------------------------------ archetypes
ARCH_CTE = """
churned AS (
  SELECT *, CASE WHEN is_month_to_month = 1 AND is_high_charger = 1 THEN 'Price Refugee'
                 WHEN is_new_customer = 1 THEN 'Early Dropout'
                 WHEN has_fiber = 1 AND fiber_no_security = 1 THEN 'Tech Dissatisfied'
                 WHEN tenure >= 24 AND is_month_to_month = 0 THEN 'Lifecycle Leaver'
                 ELSE 'At Risk' END AS cluster
  FROM customers WHERE Churn_binary = 1),
prof AS (
  SELECT cluster, avg(CAST(MonthlyCharges AS DOUBLE)) * avg(CAST(is_month_to_month AS DOUBLE)) AS s0,
         1 / (avg(CAST(tenure AS DOUBLE)) + 1) AS s1,
         avg(CAST(has_fiber AS DOUBLE)) + avg(CAST(fiber_no_security AS DOUBLE)) AS s2,
         avg(CAST(tenure AS DOUBLE)) * (1 - avg(CAST(is_new_customer AS DOUBLE))) AS s3
  FROM churned GROUP BY cluster),
arch AS (
  SELECT cluster, CASE WHEN s0 >= s1 AND s0 >= s2 AND s0 >= s3 THEN 0
                       WHEN s1 >= s2 AND s1 >= s3 THEN 1 WHEN s2 >= s3 THEN 2 ELSE 3 END AS archetype_id
  FROM prof),
named AS (
  SELECT c.*, a.archetype_id,
    ['Price Refugee', 'Early Dropout', 'Tech Dissatisfied', 'Lifecycle Leaver'][a.archetype_id + 1]
      AS archetype_name
  FROM churned c JOIN arch a ON c.cluster = a.cluster)"""


def _named(spark, sf):
    c = D.customers(spark, sf)
    churned = J.archetype_rule(c.where(F.col("Churn_binary") == 1)).withColumn(
        "cluster", F.col("archetype"))
    prof = J.cluster_profiles(churned, "cluster")
    arch = J.assign_archetype(prof, "cluster")
    return churned.join(F.broadcast(arch), "cluster")


def q_assign_archetype(spark, sf):
    c = D.customers(spark, sf)
    churned = J.archetype_rule(c.where(F.col("Churn_binary") == 1)).withColumn(
        "cluster", F.col("archetype"))
    return J.assign_archetype(J.cluster_profiles(churned, "cluster"), "cluster")


SQL_ASSIGN = on_customers("""
SELECT a.cluster, CAST(a.archetype_id AS INTEGER) AS archetype_id,
  ['Price Refugee', 'Early Dropout', 'Tech Dissatisfied', 'Lifecycle Leaver'][a.archetype_id + 1] AS archetype_name
FROM arch a""", ARCH_CTE)

SQL_ARCH_SUMMARY = on_customers("""
SELECT archetype_id, archetype_name, COUNT(*) AS count,
  CAST(SUM(monthly_cents) AS DOUBLE) / CAST(COUNT(*) * 100 AS DOUBLE) AS avg_monthly_charges,
  CAST(SUM(tenure) AS DOUBLE) / COUNT(*) AS avg_tenure,
  CAST(SUM(monthly_cents) AS DOUBLE) / 100 AS mrr_at_risk,
  CAST(100 * COUNT(*) AS DOUBLE) / (SELECT COUNT(*) FROM churned) AS pct_of_churned,
  ['High charges, low service use, month-to-month contract',
   '0-6 month tenure, never adopted core features',
   'Fiber optic, no tech support, high charge-to-value ratio',
   'Long tenure, contract expiry, lifestyle change trigger'][archetype_id + 1] AS reason
FROM named GROUP BY archetype_id, archetype_name""", ARCH_CTE)

SQL_ARCH_PROFILE = on_customers("""
SELECT archetype_name, CAST(SUM(tenure) AS DOUBLE) / COUNT(*) AS tenure,
  round(CAST(SUM(MonthlyCharges) AS DOUBLE) / COUNT(*), 6) AS MonthlyCharges,
  CAST(SUM(service_adoption_score) AS DOUBLE) / COUNT(*) AS service_adoption_score,
  CAST(SUM(is_month_to_month) AS DOUBLE) / COUNT(*) AS is_month_to_month,
  CAST(SUM(has_fiber) AS DOUBLE) / COUNT(*) AS has_fiber,
  CAST(SUM(is_new_customer) AS DOUBLE) / COUNT(*) AS is_new_customer
FROM named GROUP BY archetype_name""", ARCH_CTE)

SQL_ARCH_REVENUE = on_customers("""
SELECT archetype_name, CAST(SUM(monthly_cents) AS DOUBLE) / 100 AS sum,
  CAST(SUM(monthly_cents) AS DOUBLE) / CAST(COUNT(*) * 100 AS DOUBLE) AS mean, COUNT(*) AS count
FROM named GROUP BY archetype_name""", ARCH_CTE)

SQL_ARCH_RULE = on_customers("""
SELECT archetype, COUNT(*) AS customers FROM (
  SELECT CASE WHEN is_month_to_month = 1 AND is_high_charger = 1 THEN 'Price Refugee'
              WHEN is_new_customer = 1 THEN 'Early Dropout'
              WHEN has_fiber = 1 AND fiber_no_security = 1 THEN 'Tech Dissatisfied'
              WHEN tenure >= 24 AND is_month_to_month = 0 THEN 'Lifecycle Leaver'
              ELSE 'At Risk' END AS archetype FROM customers) GROUP BY archetype""")


def q_arch_profile(spark, sf):
    p = J.archetype_profile(_named(spark, sf))
    return p.withColumn("MonthlyCharges", F.round("MonthlyCharges", 6))


# ------------------------------------------------------------------ scoring
def q_top_factors(spark, sf):
    s = M.top_risk_factors(D.customers(spark, sf))
    return s.select("customer_id", F.array_join(F.transform("top_risk_factors", lambda x: x["factor"]),
                                                "; ").alias("factors"))


_FACTOR_LIST = ", ".join(f"CASE WHEN {c} = 1 THEN '{label}' END" for c, label, _, _ in M.RISK_FACTORS)
SQL_TOP_FACTORS = on_customers(f"""
SELECT customer_id,
  array_to_string(list_filter([{_FACTOR_LIST}], lambda x: x IS NOT NULL)[1:5], '; ') AS factors
FROM customers""")


def q_intervention(spark, sf):
    s = J.archetype_rule(D.customers(spark, sf))
    return (s.select(M.intervention("archetype", "churn_probability").alias("intervention"))
            .groupBy("intervention").count())


_BOOK = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in M.INTERVENTIONS.items())
SQL_INTERVENTION = on_customers(f"""
SELECT intervention, COUNT(*) AS count FROM (
  SELECT CASE WHEN churn_probability < 0.3 THEN '{M.LOW_RISK_TEXT}'
              ELSE coalesce(CASE archetype {_BOOK} END, '{M.DEFAULT_INTERVENTION}') END AS intervention
  FROM (SELECT *, CASE WHEN is_month_to_month = 1 AND is_high_charger = 1 THEN 'Price Refugee'
              WHEN is_new_customer = 1 THEN 'Early Dropout'
              WHEN has_fiber = 1 AND fiber_no_security = 1 THEN 'Tech Dissatisfied'
              WHEN tenure >= 24 AND is_month_to_month = 0 THEN 'Lifecycle Leaver'
              ELSE 'At Risk' END AS archetype FROM customers))
GROUP BY intervention""")


def q_score(spark, sf):
    return M.score_customers(D.customers(spark, sf), engineered=True, as_of=AS_OF)


SCORE_FIELDS = ["customer_id", "churn_probability", "churn_prediction", "risk_tier", "risk_score",
                "intervention_priority", "archetype", "archetype_reason", "intervention",
                "model_version", "predicted_at"]


def q_score_fields(spark, sf):
    return q_score(spark, sf).select(*SCORE_FIELDS)


_ARCH = """CASE WHEN is_month_to_month = 1 AND is_high_charger = 1 THEN 'Price Refugee'
              WHEN is_new_customer = 1 THEN 'Early Dropout'
              WHEN has_fiber = 1 AND fiber_no_security = 1 THEN 'Tech Dissatisfied'
              WHEN tenure >= 24 AND is_month_to_month = 0 THEN 'Lifecycle Leaver'
              ELSE 'At Risk' END"""
_REASONS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in J.RULE_REASONS.items())
SQL_SCORE_FIELDS = on_customers(f"""
SELECT customer_id, round(churn_probability, 4) AS churn_probability,
  churn_probability >= 0.5 AS churn_prediction,
  CASE WHEN churn_probability >= 0.6 THEN 'High' WHEN churn_probability >= 0.3 THEN 'Medium'
       ELSE 'Low' END AS risk_tier,
  round(advanced_risk_score, 2) AS risk_score,
  CASE WHEN churn_probability >= 0.6 THEN 'HIGH' WHEN churn_probability >= 0.3 THEN 'MEDIUM'
       ELSE 'LOW' END AS intervention_priority,
  archetype, CASE archetype {_REASONS} END AS archetype_reason,
  CASE WHEN churn_probability < 0.3 THEN '{M.LOW_RISK_TEXT}'
       ELSE coalesce(CASE archetype {_BOOK} END, '{M.DEFAULT_INTERVENTION}') END AS intervention,
  '{M.MODEL_VERSION}' AS model_version, TIMESTAMP '{AS_OF}' AS predicted_at
FROM (SELECT *, {_ARCH} AS archetype FROM customers)""")


def q_risk_register(spark, sf):
    from ebbflow.operators.evaluate import customer_predictions
    preds = customer_predictions(D.customers(spark, sf), tier_rule="ge")
    top, _ = M.risk_register(preds, min_p=0.6)
    return top.select("customer_id", "churn_probability", "intervention_priority")


SQL_RISK_REGISTER = on_customers("""
SELECT customer_id, churn_probability, intervention_priority FROM (
  SELECT customer_id, churn_probability,
    CAST(floor(rank() OVER (ORDER BY clv DESC) - 1 + (COUNT(*) OVER (PARTITION BY clv) + 1) / 2.0::DOUBLE) AS BIGINT)
      AS intervention_priority
  FROM (SELECT *, MonthlyCharges * 12 * churn_probability AS clv FROM customers))
WHERE churn_probability >= 0.6 ORDER BY intervention_priority, customer_id LIMIT 200""")


def q_batch_summary(spark, sf):
    c = D.subscriptions(spark, sf)
    _, _, summary = M.batch_summary(c, lambda d: M.score_customers(d, as_of=AS_OF))
    return summary


def q_kmeans(spark, sf):
    c = D.customers(spark, sf)
    seg = J.kmeans_segments(c, ["tenure", "MonthlyCharges", "TotalCharges"], k=4)
    return J.segment_profile(seg)


def q_choose_k(spark, sf):
    c = D.customers(spark, sf).where(F.col("Churn_binary") == 1)
    return J.choose_k(c, ks=range(2, 8))


def q_project(spark, sf):
    c = D.customers(spark, sf)
    return J.project_2d(c, ["tenure", "MonthlyCharges", "TotalCharges", "service_adoption_score"]) \
        .select("customer_id", "pc1", "pc2")


def q_standardize(spark, sf):
    z = J.standardize(D.customers(spark, sf), ["tenure", "monthly_cents"])
    return z.select("customer_id", F.round("tenure_z", 9).alias("tenure_z"),
                    F.round("monthly_cents_z", 9).alias("monthly_cents_z"))


SQL_STANDARDIZE = on_customers("""
SELECT customer_id, round((tenure - mt) / st, 9) AS tenure_z, round((monthly_cents - mm) / sm, 9) AS monthly_cents_z
FROM customers CROSS JOIN (SELECT avg(CAST(tenure AS DOUBLE)) AS mt, stddev_pop(CAST(tenure AS DOUBLE)) AS st,
                                  avg(CAST(monthly_cents AS DOUBLE)) AS mm,
                                  stddev_pop(CAST(monthly_cents AS DOUBLE)) AS sm FROM customers)""")


def q_minmax(spark, sf):
    z = J.minmax_normalize(D.customers(spark, sf), ["tenure", "monthly_cents"])
    return z.select("customer_id", "tenure_mm", "monthly_cents_mm")


SQL_MINMAX = on_customers("""
SELECT customer_id, (tenure - lt) / (ht - lt + 1e-8::DOUBLE) AS tenure_mm,
       (monthly_cents - lm) / (hm - lm + 1e-8::DOUBLE) AS monthly_cents_mm
FROM customers CROSS JOIN (SELECT min(tenure) AS lt, max(tenure) AS ht, min(monthly_cents) AS lm,
                                  max(monthly_cents) AS hm FROM customers)""")


QUERIES = {
    "drift_statistics": (q_drift_statistics, SQL_DRIFT),
    "drift_report": (q_drift_report, SQL_DRIFT_REPORT),
    "drift_summary": (lambda spark, sf: N.drift_summary(
        N.drift_report(_tagged(spark, sf), DRIFT_FEATURES)), SQL_DRIFT_SUMMARY),
    "performance_report": (lambda spark, sf: N.performance_report(_tagged(spark, sf)), SQL_PERF),
    "performance_delta": (lambda spark, sf: N.performance_delta(
        N.performance_report(_tagged(spark, sf))), SQL_PERF_DELTA),
    "prediction_distribution": (q_pred_dist, SQL_PRED_DIST),
    "retrain_gate": (_c(lambda d: N.retrain_gate(d, [("customer_id", True)])), SQL_RETRAIN),
    "alerts": (q_alerts, SQL_ALERTS),
    "mart_kpis": (q_mart_kpis, SQL_MART_KPIS),
    "mart_churn_analysis": (_c(O.mart_churn_analysis), on_customers(SQL_MARTS["mart_churn_analysis"])),
    "mart_at_risk": (_c(O.mart_at_risk), on_customers(SQL_MARTS["mart_at_risk"])),
    "mart_predictions": (_c(lambda d: O.mart_predictions(d.select("customer_id", "Contract"), d)),
                         on_customers("SELECT customer_id, Contract, churn_probability FROM customers")),
    "mart_prob_summary": (q_prob_summary, on_customers(SQL_MARTS["mart_prob_summary"])),
    "mart_customers": (_c(O.mart_customers), on_customers(SQL_MARTS["mart_customers"])),
    "mart_services": (_c(O.mart_services), on_customers(SQL_MARTS["mart_services"])),
    "mart_cohorts": (_c(O.mart_cohorts), on_customers(SQL_MARTS["mart_cohorts"])),
    "mart_segments": (_c(O.mart_segments), on_customers(SQL_MARTS["mart_segments"])),
    "archetype_rule_counts": (_c(lambda d: J.archetype_rule(d).groupBy("archetype")
                                 .agg(F.count(F.lit(1)).alias("customers"))), SQL_ARCH_RULE),
    "assign_archetype": (q_assign_archetype, SQL_ASSIGN),
    "archetype_summary": (lambda spark, sf: J.archetype_summary(_named(spark, sf)), SQL_ARCH_SUMMARY),
    "archetype_profile": (q_arch_profile, SQL_ARCH_PROFILE),
    "archetype_revenue": (lambda spark, sf: J.archetype_revenue(_named(spark, sf)), SQL_ARCH_REVENUE),
    "top_risk_factors": (q_top_factors, SQL_TOP_FACTORS),
    "intervention": (q_intervention, SQL_INTERVENTION),
    "score_customers": (q_score, None),
    "score_customers_fields": (q_score_fields, SQL_SCORE_FIELDS),
    "risk_register": (q_risk_register, SQL_RISK_REGISTER),
    "kmeans_segments": (q_kmeans, None),
    "choose_k": (q_choose_k, None),
    "project_2d": (q_project, None),
    "standardize": (q_standardize, SQL_STANDARDIZE),
    "minmax_normalize": (q_minmax, SQL_MINMAX),
}
