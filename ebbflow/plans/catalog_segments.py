"""Registered queries for features, cleaning and segment analytics, each with
its DuckDB oracle. Each entry: name → (callable(spark, sf_dir), sql | None)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ebbflow.operators import clean, features, segments as S
from ebbflow.plans import datasets as D
from ebbflow.plans.oracle_base import with_ctes
from ebbflow.plans.oracle_features import on_customers

MONEY_AVG = "CAST(SUM({c}) AS DOUBLE) / CAST(COUNT(*) * 100 AS DOUBLE)"
RATE_PCT = "CAST(100 * SUM({y}) AS DOUBLE) / COUNT(*)"


def _std(y="Churn_binary", c="monthly_cents"):
    return (f"COUNT(*) AS customers, {RATE_PCT.format(y=y)} AS churn_rate_pct, "
            f"{MONEY_AVG.format(c=c)} AS avg_monthly_charges")


FEATURE_COLS = [
    "customer_id", "tenure", "MonthlyCharges", "TotalCharges", "Churn_binary",
    "charge_per_month", "charge_to_monthly_ratio", "is_high_charger", "is_low_charger",
    "charge_above_median", "monthly_to_total_ratio", "expected_lifetime_value",
    "actual_vs_expected_clv", "charge_trend", "revenue_efficiency", "tenure_squared",
    "is_new_customer", "is_early_customer", "is_loyal_customer", "is_veteran_customer",
    "tenure_bucket", "months_remaining_1yr", "months_remaining_2yr", "contract_age_ratio",
    "service_adoption_score", "service_adoption_pct", "is_single_service", "is_full_service",
    "security_bundle", "entertainment_bundle", "support_bundle", "has_any_security",
    "has_entertainment", "services_per_dollar", "charge_per_service", "is_month_to_month",
    "is_one_year", "is_two_year", "has_auto_pay", "uses_electronic", "uses_mailed_check",
    "paperless_no_auto", "contract_risk_score", "has_fiber", "has_dsl", "no_internet",
    "fiber_no_security", "fiber_no_support", "fiber_high_charge", "is_senior", "has_partner",
    "has_dependents", "has_family", "senior_alone", "young_family", "senior_month_to_month",
    "base_risk_score", "advanced_risk_score", "clv_at_risk", "poly_tenure_MonthlyCharges",
    "poly_tenure_service_adoption_score", "poly_tenure_base_risk_score",
    "poly_tenure_charge_per_service", "poly_MonthlyCharges_service_adoption_score",
    "poly_MonthlyCharges_base_risk_score", "poly_MonthlyCharges_charge_per_service",
    "poly_service_adoption_score_base_risk_score",
    "poly_service_adoption_score_charge_per_service",
    "poly_base_risk_score_charge_per_service", "churn_probability",
]


def q_feature_table(spark, sf):
    df = D.customers(spark, sf)
    return df.select(*FEATURE_COLS, F.round(F.log1p("tenure"), 6).alias("tenure_log"))


SQL_FEATURE_TABLE = on_customers(
    f"SELECT {', '.join(FEATURE_COLS)}, round(ln(1 + tenure), 6) AS tenure_log FROM customers")


def q_subscriptions(spark, sf):
    return D.subscriptions(spark, sf)


SQL_SUBSCRIPTIONS = with_ctes(body="SELECT * FROM subscriptions")


def q_percentile_ranks(spark, sf):
    df = D.subscriptions(spark, sf)
    df = clean.fill_median(df, "TotalCharges")
    from ebbflow.operators.ranks import pct_rank_avg
    df = pct_rank_avg(df, "MonthlyCharges", "monthly_charge_percentile")
    df = pct_rank_avg(df, "TotalCharges", "total_charge_percentile")
    return df.select("customer_id", "monthly_charge_percentile", "total_charge_percentile")


SQL_PERCENTILE_RANKS = on_customers("""
SELECT customer_id,
  (rank() OVER (ORDER BY MonthlyCharges) - 1
     + (count(*) OVER (PARTITION BY MonthlyCharges) + 1) / 2.0::DOUBLE)
     / count(*) OVER () AS monthly_charge_percentile,
  (rank() OVER (ORDER BY TotalCharges) - 1
     + (count(*) OVER (PARTITION BY TotalCharges) + 1) / 2.0::DOUBLE)
     / count(*) OVER () AS total_charge_percentile
FROM customers""")


def q_second_gen(spark, sf):
    df = features.second_gen_features(D.subscriptions(spark, sf))
    return df.select("customer_id", F.round("MonthlyCharges_log", 6).alias("MonthlyCharges_log"),
                     F.round("TotalCharges_log", 6).alias("TotalCharges_log"), "AvgMonthlyCharge",
                     "tenure_months_group", "is_at_risk", "Contract_encoded",
                     "InternetService_encoded", "num_services", "tenure_x_charges",
                     "services_x_tenure")


SQL_SECOND_GEN = with_ctes(body="""
SELECT customer_id, round(ln(1 + MonthlyCharges), 6) AS MonthlyCharges_log,
  round(ln(1 + TotalCharges), 6) AS TotalCharges_log,
  TotalCharges / (tenure + 1) AS AvgMonthlyCharge,
  CASE WHEN tenure > 0 AND tenure <= 6 THEN '0-6' WHEN tenure > 6 AND tenure <= 12 THEN '6-12'
       WHEN tenure > 12 AND tenure <= 24 THEN '12-24' WHEN tenure > 24 AND tenure <= 60 THEN '24-60'
       WHEN tenure > 60 AND tenure <= 72 THEN '60+' END AS tenure_months_group,
  CAST(tenure <= 12 AS INTEGER) AS is_at_risk,
  CASE Contract WHEN 'Month-to-month' THEN 0 WHEN 'One year' THEN 1 WHEN 'Two year' THEN 2 END
    AS Contract_encoded,
  CASE InternetService WHEN 'Fiber optic' THEN 2 WHEN 'DSL' THEN 1 WHEN 'No' THEN 0 END
    AS InternetService_encoded,
  OnlineSecurity + OnlineBackup + DeviceProtection + TechSupport + StreamingTV + StreamingMovies
    AS num_services,
  tenure * MonthlyCharges AS tenure_x_charges,
  (OnlineSecurity + OnlineBackup + DeviceProtection + TechSupport + StreamingTV + StreamingMovies)
    * tenure AS services_x_tenure
FROM subscriptions""")


def q_missing_profile(spark, sf):
    return clean.missing_profile(D.subscriptions(spark, sf).drop("start_date"))


def _missing_sql():
    cols = ["customer_id", "tenure", "monthly_cents", "MonthlyCharges", "total_cents",
            "TotalCharges", "OnlineSecurity", "OnlineBackup", "DeviceProtection", "TechSupport",
            "StreamingTV", "StreamingMovies", "Contract", "InternetService", "PaymentMethod",
            "gender", "SeniorCitizen", "Partner", "Dependents", "PhoneService",
            "PaperlessBilling", "Churn_binary"]
    parts = [f"SELECT '{c}' AS \"column\", CAST(COUNT(*) - COUNT({c}) AS BIGINT) AS null_count "
             f"FROM subscriptions" for c in cols]
    parts.append("SELECT '__total__', CAST(SUM(CAST(TotalCharges IS NULL AS INTEGER) "
                 "+ CAST(total_cents IS NULL AS INTEGER)) AS BIGINT) FROM subscriptions")
    return with_ctes(body="\nUNION ALL\n".join(parts))


def q_quality_checks(spark, sf):
    return clean.quality_checks(D.customers(spark, sf))


SQL_QUALITY_CHECKS = on_customers("""
SELECT * FROM (
  SELECT 'not_empty' AS "check", COUNT(*) > 0 AS passed, CAST(COUNT(*) AS DOUBLE) AS observed FROM customers
  UNION ALL SELECT 'no_null_target', COUNT(*) = COUNT(Churn_binary),
    CAST(COUNT(*) - COUNT(Churn_binary) AS DOUBLE) FROM customers
  UNION ALL SELECT 'charges_non_negative', SUM(CAST(MonthlyCharges < 0 AS INTEGER)) = 0,
    CAST(SUM(CAST(MonthlyCharges < 0 AS INTEGER)) AS DOUBLE) FROM customers
  UNION ALL SELECT 'tenure_in_range', SUM(CAST(tenure < 0 OR tenure > 72 AS INTEGER)) = 0,
    CAST(SUM(CAST(tenure < 0 OR tenure > 72 AS INTEGER)) AS DOUBLE) FROM customers
  UNION ALL SELECT 'churn_rate_plausible', avg(Churn_binary) BETWEEN 0.05 AND 0.5,
    avg(Churn_binary) FROM customers
  UNION ALL SELECT 'min_rows', COUNT(*) >= 1000, CAST(COUNT(*) AS DOUBLE) FROM customers)""")


def q_dedupe(spark, sf):
    df = D.subscriptions(spark, sf).select("Contract", "InternetService", "PaymentMethod",
                                           "tenure", "Churn_binary")
    out, report = clean.dedupe(df)
    return report


SQL_DEDUPE = with_ctes("""
d AS (SELECT Contract, InternetService, PaymentMethod, tenure, Churn_binary FROM subscriptions)""",
                       body="""
SELECT (SELECT COUNT(*) FROM d) AS rows_before,
       (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM d)) AS rows_after,
       (SELECT COUNT(*) FROM d) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM d)) AS removed""")


def q_fill_mode(spark, sf):
    df = D.subscriptions(spark, sf).withColumn(
        "tc_bucket", F.when(F.col("total_cents").isNotNull(), F.col("total_cents") % 7))
    return clean.fill_mode(df, ["tc_bucket"]).groupBy("tc_bucket").agg(
        F.count(F.lit(1)).alias("n"))


SQL_FILL_MODE = with_ctes("""
b AS (SELECT CASE WHEN total_cents IS NOT NULL THEN total_cents % 7 END AS tc_bucket FROM subscriptions),
m AS (SELECT tc_bucket AS mode_v FROM b WHERE tc_bucket IS NOT NULL GROUP BY tc_bucket
      ORDER BY COUNT(*) DESC, tc_bucket LIMIT 1)""", body="""
SELECT coalesce(b.tc_bucket, m.mode_v) AS tc_bucket, COUNT(*) AS n FROM b CROSS JOIN m GROUP BY 1""")


def q_validate_rows(spark, sf):
    df = D.subscriptions(spark, sf)
    v = clean.validate_rows(df)
    return v.groupBy("is_valid").agg(F.count(F.lit(1)).alias("n"))


SQL_VALIDATE_ROWS = with_ctes(body="""
SELECT (tenure BETWEEN 0 AND 72) AND MonthlyCharges >= 0 AND TotalCharges IS NOT NULL
       AND TotalCharges >= 0 AND Contract IS NOT NULL AND InternetService IS NOT NULL
       AND PaymentMethod IS NOT NULL AS is_valid,
       COUNT(*) AS n
FROM subscriptions GROUP BY 1""")


# ------------------------------------------------------------------ segments F
def _c(fn):
    return lambda spark, sf: fn(D.customers(spark, sf))


SQL = {}
SQL["churn_by_segment"] = on_customers(f"""
SELECT Contract, InternetService, COUNT(*) AS total_customers,
  CAST(SUM(Churn_binary) AS BIGINT) AS churned, {RATE_PCT.format(y='Churn_binary')} AS churn_rate_pct,
  {MONEY_AVG.format(c='monthly_cents')} AS avg_monthly_charges,
  CAST(SUM(monthly_cents) AS DOUBLE) / 100.0::DOUBLE AS total_mrr
FROM customers GROUP BY Contract, InternetService ORDER BY churn_rate_pct DESC""")

SQL["revenue_at_risk_cohort"] = on_customers(f"""
SELECT CASE WHEN tenure BETWEEN 0 AND 6 THEN '0-6m' WHEN tenure BETWEEN 7 AND 12 THEN '6-12m'
            WHEN tenure BETWEEN 13 AND 24 THEN '1-2yr' WHEN tenure BETWEEN 25 AND 48 THEN '2-4yr'
            ELSE '4+yr' END AS tenure_cohort,
  COUNT(*) AS customers, CAST(SUM(Churn_binary) AS BIGINT) AS churned,
  {RATE_PCT.format(y='Churn_binary')} AS churn_rate_pct,
  CAST(SUM(CASE WHEN Churn_binary = 1 THEN monthly_cents ELSE 0 END) AS DOUBLE) / 100.0::DOUBLE AS mrr_at_risk,
  CAST(SUM(CASE WHEN Churn_binary = 1 THEN monthly_cents * 12 ELSE 0 END) AS DOUBLE) / 100.0::DOUBLE
    AS annual_revenue_at_risk
FROM customers GROUP BY 1""")

SQL["payment_method_risk"] = on_customers(f"""
SELECT PaymentMethod, {_std()},
  CAST(SUM(monthly_cents * Churn_binary) AS DOUBLE) / 100.0::DOUBLE AS mrr_lost
FROM customers GROUP BY PaymentMethod""")

SQL["service_adoption_churn"] = on_customers(f"""
SELECT service_adoption_score, {_std()} FROM customers
WHERE service_adoption_score IS NOT NULL GROUP BY service_adoption_score""")

SQL["clv_at_risk_decile"] = on_customers(f"""
SELECT charge_decile, {_std()},
  CAST(SUM(monthly_cents * 24 * Churn_binary) AS DOUBLE) / 100.0::DOUBLE AS clv_at_risk
FROM (SELECT *, CAST(NTILE(10) OVER (ORDER BY monthly_cents DESC, customer_id) AS BIGINT)
        AS charge_decile FROM customers)
GROUP BY charge_decile""")

SQL["contract_window_analysis"] = on_customers(f"""
SELECT Contract, COUNT(*) AS total, CAST(SUM(Churn_binary) AS BIGINT) AS churned,
  {RATE_PCT.format(y='Churn_binary')} AS churn_rate,
  {MONEY_AVG.format(c='monthly_cents')} AS avg_mrr,
  CAST(SUM(monthly_cents) AS DOUBLE) / 100.0::DOUBLE AS total_mrr,
  CAST(100 * SUM(monthly_cents) AS DOUBLE) / CAST(SUM(SUM(monthly_cents)) OVER () AS DOUBLE) AS mrr_share_pct,
  CAST(100 * SUM(monthly_cents * Churn_binary) AS DOUBLE)
    / CAST(SUM(SUM(monthly_cents * Churn_binary)) OVER () AS DOUBLE) AS risk_share_pct
FROM customers GROUP BY Contract""")

SQL["senior_risk_profile"] = on_customers(f"""
SELECT CASE WHEN SeniorCitizen = 1 THEN 'Senior' ELSE 'Non-Senior' END AS segment,
       CASE WHEN Partner = 1 THEN 'Has Partner' ELSE 'No Partner' END AS partner_status,
       {_std()}
FROM customers GROUP BY 1, 2""")

SQL["cumulative_mrr_loss"] = on_customers("""
SELECT tenure, CAST(lost AS DOUBLE) / 100.0::DOUBLE AS mrr_lost_at_tenure,
       CAST(SUM(lost) OVER (ORDER BY tenure) AS DOUBLE) / 100.0::DOUBLE AS cumulative_mrr_lost
FROM monthly_loss ORDER BY tenure LIMIT 15""", """
monthly_loss AS (
  SELECT tenure, SUM(CASE WHEN Churn_binary = 1 THEN monthly_cents ELSE 0 END) AS lost
  FROM customers GROUP BY tenure)""")

SQL["fiber_optic_deep_dive"] = on_customers(f"""
SELECT InternetService,
  CASE WHEN TechSupport = 1 THEN 'Has TechSupport' ELSE 'No TechSupport' END AS tech_support_status,
  CASE WHEN OnlineSecurity = 1 THEN 'Secured' ELSE 'Unsecured' END AS security_status,
  {_std()}
FROM customers WHERE InternetService = 'Fiber optic' GROUP BY 1, 2, 3""")

SQL["intervention_roi"] = on_customers("""
SELECT Contract, InternetService, total, churn_rate, avg_mrr,
  CAST(risk AS DOUBLE) / 100.0::DOUBLE AS mrr_at_risk,
  CAST(risk * 12 AS DOUBLE) / 100.0::DOUBLE AS annual_risk,
  CAST(risk * 15 AS DOUBLE) / 10000.0::DOUBLE AS cost_15pct_discount,
  CAST(risk * 1200 AS DOUBLE) / CAST(NULLIF(risk * 180, 0) AS DOUBLE) AS intervention_roi_x
FROM segment_stats WHERE churn_rate > 20
ORDER BY annual_risk DESC, Contract, InternetService LIMIT 8""", f"""
segment_stats AS (
  SELECT Contract, InternetService, COUNT(*) AS total, SUM(Churn_binary) AS churned,
    {RATE_PCT.format(y='Churn_binary')} AS churn_rate,
    {MONEY_AVG.format(c='monthly_cents')} AS avg_mrr,
    SUM(Churn_binary * monthly_cents) AS risk
  FROM customers GROUP BY Contract, InternetService)""")

SQL["churn_by_contract"] = on_customers(f"""
SELECT Contract, COUNT(*) AS total_customers, CAST(SUM(Churn_binary) AS BIGINT) AS churned,
  {RATE_PCT.format(y='Churn_binary')} AS churn_rate_pct FROM customers GROUP BY Contract""")

SQL["revenue_metrics"] = on_customers(f"""
SELECT Contract, COUNT(*) AS customers, {MONEY_AVG.format(c='monthly_cents')} AS avg_monthly,
  CAST(SUM(total_cents) AS DOUBLE) / CAST(COUNT(total_cents) * 100 AS DOUBLE) AS avg_total,
  CAST(SUM(total_cents) AS DOUBLE) / 100.0::DOUBLE AS total_revenue
FROM customers GROUP BY Contract""")

SQL["ltv_segments"] = on_customers("""
SELECT CASE WHEN TotalCharges < 500 THEN 'Low' WHEN TotalCharges < 2000 THEN 'Medium'
            ELSE 'High' END AS value_segment,
  COUNT(*) AS customers,
  CAST(100 * COUNT(*) AS DOUBLE) / CAST(SUM(COUNT(*)) OVER () AS DOUBLE) AS pct_of_total,
  CAST(SUM(Churn_binary) AS DOUBLE) / COUNT(*) AS churn_rate
FROM customers GROUP BY 1""")

SQL["rate_by_payment_senior"] = on_customers(f"""
SELECT PaymentMethod, SeniorCitizen, COUNT(*) AS customers,
  CAST(SUM(Churn_binary) AS DOUBLE) / COUNT(*) AS rate,
  {MONEY_AVG.format(c='monthly_cents')} AS mean_value
FROM customers GROUP BY 1, 2""")

SQL["rate_by_tenure_bucket"] = on_customers(f"""
SELECT tenure_bucket, COUNT(*) AS customers,
  CAST(SUM(Churn_binary) AS DOUBLE) / COUNT(*) AS rate,
  {MONEY_AVG.format(c='monthly_cents')} AS mean_value
FROM customers GROUP BY 1""")

SQL["revenue_lost_by_internet"] = on_customers("""
SELECT InternetService, CAST(SUM(monthly_cents) AS DOUBLE) / 100.0::DOUBLE AS revenue_lost
FROM customers WHERE Churn_binary = 1 GROUP BY 1""")

SQL["business_impact"] = on_customers("""
SELECT CAST(SUM(monthly_cents) AS DOUBLE) / 100.0::DOUBLE AS total_mrr,
  CAST(SUM(CASE WHEN Churn_binary = 1 THEN monthly_cents ELSE 0 END) AS DOUBLE) / 100.0::DOUBLE AS churned_mrr,
  CAST(100 * SUM(CASE WHEN Churn_binary = 1 THEN monthly_cents ELSE 0 END) AS DOUBLE)
    / CAST(SUM(monthly_cents) AS DOUBLE) AS churned_mrr_pct,
  CAST(SUM(CAST(base_risk_score >= 6 AS INTEGER)) AS BIGINT) AS high_risk_customers,
  CAST(SUM(CASE WHEN base_risk_score >= 6 THEN monthly_cents ELSE 0 END) AS DOUBLE) / 100.0::DOUBLE
    AS high_risk_mrr
FROM customers""")


def _with_without_sql():
    parts = [f"""SELECT '{s}' AS service,
  CAST(100 * SUM(CASE WHEN {s} = 1 THEN Churn_binary END) AS DOUBLE)
    / SUM(CAST({s} = 1 AS INTEGER)) AS with_service_pct,
  CAST(100 * SUM(CASE WHEN {s} <> 1 THEN Churn_binary END) AS DOUBLE)
    / SUM(CAST({s} <> 1 AS INTEGER)) AS without_service_pct FROM customers"""
             for s in features.SERVICE_COLS]
    return on_customers("\nUNION ALL\n".join(parts))


SQL["with_without_service"] = _with_without_sql()


def _profile_sql():
    parts = [f"""SELECT '{f}' AS feature, Churn_binary,
  CAST(100 * SUM({f}) AS DOUBLE) / COUNT(*) AS mean_pct FROM customers GROUP BY Churn_binary"""
             for f in S.PROFILE_FLAGS]
    return on_customers("\nUNION ALL\n".join(parts))


SQL["profile_by_target"] = _profile_sql()

SQL["executive_kpis"] = on_customers("""
SELECT COUNT(*) AS customers, CAST(SUM(CAST(Churn_binary = 0 AS INTEGER)) AS BIGINT) AS retained,
  CAST(SUM(Churn_binary) AS BIGINT) AS churned,
  CAST(100 * SUM(Churn_binary) AS DOUBLE) / COUNT(*) AS churn_pct,
  CAST(SUM(CASE WHEN Churn_binary = 1 THEN monthly_cents ELSE 0 END) AS DOUBLE) / 100.0::DOUBLE AS mrr_at_risk,
  CAST(SUM(CASE WHEN Churn_binary = 1 THEN monthly_cents ELSE 0 END) * 12 AS DOUBLE) / 100.0::DOUBLE AS annual_risk,
  CAST(SUM(CAST(churn_probability >= 0.6 AS INTEGER)) AS BIGINT) AS high_risk_now
FROM customers""")

SQL["revenue_kpis"] = on_customers("""
SELECT CAST(SUM(monthly_cents) AS DOUBLE) / 100.0::DOUBLE AS total_mrr,
  CAST(SUM(CASE WHEN Churn_binary = 1 THEN monthly_cents ELSE 0 END) AS DOUBLE) / 100.0::DOUBLE AS churned_mrr,
  CAST(SUM(CASE WHEN Churn_binary = 0 THEN monthly_cents * 24 END) AS DOUBLE)
    / CAST(SUM(CAST(Churn_binary = 0 AS INTEGER)) * 100 AS DOUBLE) AS avg_clv_retained,
  CAST(SUM(CASE WHEN Churn_binary = 1 THEN monthly_cents * 8 END) AS DOUBLE)
    / CAST(SUM(CAST(Churn_binary = 1 AS INTEGER)) * 100 AS DOUBLE) AS avg_clv_churned
FROM customers""")

SQL["charge_band_churn"] = on_customers("""
SELECT charge_band, COUNT(*) AS customers,
  CAST(100 * SUM(Churn_binary) AS DOUBLE) / COUNT(*) AS churn_rate_pct
FROM (SELECT *, CASE WHEN MonthlyCharges > 0 AND MonthlyCharges <= 30 THEN '<$30'
                     WHEN MonthlyCharges > 30 AND MonthlyCharges <= 50 THEN '$30-50'
                     WHEN MonthlyCharges > 50 AND MonthlyCharges <= 70 THEN '$50-70'
                     WHEN MonthlyCharges > 70 AND MonthlyCharges <= 90 THEN '$70-90'
                     WHEN MonthlyCharges > 90 AND MonthlyCharges <= 120 THEN '$90+' END AS charge_band
      FROM customers)
WHERE charge_band IS NOT NULL GROUP BY 1""")

SQL["histogram_monthly_by_churn"] = on_customers("""
SELECT Churn_binary, bin, COUNT(*) AS count,
  lo + (hi - lo) * bin / 40.0::DOUBLE AS bin_start
FROM (SELECT Churn_binary, lo, hi,
        CAST(CASE WHEN hi = lo THEN 0
             ELSE least(39, floor(((monthly_cents - lo) * 40) / (hi - lo))) END AS BIGINT) AS bin
      FROM customers CROSS JOIN (SELECT min(monthly_cents) AS lo, max(monthly_cents) AS hi FROM customers))
GROUP BY Churn_binary, bin, lo, hi""")

SQL["box_stats_tenure_by_churn"] = on_customers("""
SELECT Churn_binary, CAST(min(tenure) AS DOUBLE) AS min, quantile_cont(tenure, 0.25) AS q1,
  quantile_cont(tenure, 0.5) AS median, quantile_cont(tenure, 0.75) AS q3,
  CAST(max(tenure) AS DOUBLE) AS max
FROM customers GROUP BY Churn_binary""")

SQL["two_group_ratio_autopay"] = on_customers("""
SELECT rate_with, rate_without, rate_without / rate_with AS ratio FROM (
SELECT CAST(SUM(CASE WHEN has_auto_pay = 1 THEN Churn_binary END) AS DOUBLE)
         / SUM(CAST(has_auto_pay = 1 AS INTEGER)) AS rate_with,
       CAST(SUM(CASE WHEN has_auto_pay <> 1 THEN Churn_binary END) AS DOUBLE)
         / SUM(CAST(has_auto_pay <> 1 AS INTEGER)) AS rate_without FROM customers)""")

SQL["cohort_retention"] = on_customers("""
SELECT cohort, CAST(SUM(Churn_binary) AS BIGINT) AS churned, COUNT(*) AS customers,
  CAST(SUM(monthly_cents) AS DOUBLE) / CAST(COUNT(*) * 100 AS DOUBLE) AS mean_monthly,
  CAST(SUM(total_cents) AS DOUBLE) / CAST(COUNT(total_cents) * 100 AS DOUBLE) AS mean_total,
  1 - CAST(SUM(Churn_binary) AS DOUBLE) / COUNT(*) AS retention
FROM (SELECT *, CASE WHEN tenure > 0 AND tenure <= 6 THEN '0-6m'
                     WHEN tenure > 6 AND tenure <= 12 THEN '6-12m'
                     WHEN tenure > 12 AND tenure <= 24 THEN '12-24m'
                     WHEN tenure > 24 AND tenure <= 72 THEN '24m+' END AS cohort FROM customers)
WHERE cohort IS NOT NULL GROUP BY cohort""")

SQL["cohort_summary"] = on_customers("""
SELECT cohort, COUNT(*) AS total, CAST(SUM(Churn_binary) AS BIGINT) AS churned,
  CAST(100 * SUM(CAST(Churn_binary = 0 AS INTEGER)) AS DOUBLE) / COUNT(*) AS retained_pct,
  CAST(100 * SUM(Churn_binary) AS DOUBLE) / COUNT(*) AS churn_pct
FROM (SELECT *, CASE WHEN tenure > 0 AND tenure <= 6 THEN '0-6m'
                     WHEN tenure > 6 AND tenure <= 12 THEN '6-12m'
                     WHEN tenure > 12 AND tenure <= 24 THEN '12-24m'
                     WHEN tenure > 24 AND tenure <= 36 THEN '24-36m'
                     WHEN tenure > 36 AND tenure <= 48 THEN '36-48m'
                     WHEN tenure > 48 AND tenure <= 72 THEN '48-72m' END AS cohort FROM customers)
WHERE cohort IS NOT NULL GROUP BY cohort""")

RFM_CTES = """
e AS (SELECT quantile_cont(tenure, [0, 1/3, 2/3, 1]) AS te,
             quantile_cont(MonthlyCharges, [0, 1/3, 2/3, 1]) AS me FROM customers),
rfm AS (
  SELECT c.*,
    CASE WHEN tenure >= te[1] AND tenure <= te[2] THEN 1 WHEN tenure > te[2] AND tenure <= te[3] THEN 2
         WHEN tenure > te[3] AND tenure <= te[4] THEN 3 END AS r_score,
    CASE WHEN MonthlyCharges >= me[1] AND MonthlyCharges <= me[2] THEN 1
         WHEN MonthlyCharges > me[2] AND MonthlyCharges <= me[3] THEN 2
         WHEN MonthlyCharges > me[3] AND MonthlyCharges <= me[4] THEN 3 END AS m_score,
    CASE WHEN service_adoption_score > -1 AND service_adoption_score <= 1 THEN 1
         WHEN service_adoption_score > 1 AND service_adoption_score <= 3 THEN 2
         WHEN service_adoption_score > 3 AND service_adoption_score <= 6 THEN 3 END AS f_score
  FROM customers c CROSS JOIN e),
rfm2 AS (SELECT *, r_score + f_score + m_score AS rfm_total FROM rfm)"""

SQL["rfm_scores"] = on_customers("""
SELECT customer_id, r_score, f_score, m_score, rfm_total,
  CASE WHEN rfm_total >= 8 THEN 'Champion' WHEN rfm_total >= 6 THEN 'Loyal'
       WHEN rfm_total >= 5 THEN 'Potential' WHEN rfm_total >= 4 THEN 'At Risk'
       ELSE 'Hibernating' END AS rfm_segment
FROM rfm2""", RFM_CTES)

SQL["rfm_summary"] = on_customers("""
SELECT rfm_segment, COUNT(*) AS count,
  CAST(100 * SUM(Churn_binary) AS DOUBLE) / COUNT(*) AS churn_rate,
  CAST(SUM(monthly_cents) AS DOUBLE) / CAST(COUNT(*) * 100 AS DOUBLE) AS avg_mrr,
  CAST(SUM(monthly_cents) AS DOUBLE) / 100.0::DOUBLE AS total_mrr
FROM (SELECT *, CASE WHEN rfm_total >= 8 THEN 'Champion' WHEN rfm_total >= 6 THEN 'Loyal'
       WHEN rfm_total >= 5 THEN 'Potential' WHEN rfm_total >= 4 THEN 'At Risk'
       ELSE 'Hibernating' END AS rfm_segment FROM rfm2)
GROUP BY rfm_segment""", RFM_CTES)

SQL["segment_drilldown_loyal"] = on_customers("""
SELECT COUNT(*) AS customers, CAST(100 * SUM(Churn_binary) AS DOUBLE) / COUNT(*) AS churn_rate_pct,
  CAST(SUM(monthly_cents) AS DOUBLE) / CAST(COUNT(*) * 100 AS DOUBLE) AS avg_monthly,
  CAST(SUM(monthly_cents) AS DOUBLE) / 100.0::DOUBLE AS total_mrr,
  CAST(SUM(tenure) AS DOUBLE) / COUNT(*) AS avg_tenure,
  CAST(SUM(Churn_binary) AS DOUBLE) / COUNT(*) > 0.3 AS high_priority
FROM rfm2 WHERE rfm_total >= 6 AND rfm_total < 8""", RFM_CTES)

SQL["crosstab_contract_internet"] = on_customers("""
SELECT Contract, InternetService, COUNT(*) AS count FROM customers GROUP BY 1, 2""")

SQL["pivot_contract_internet"] = on_customers("""
SELECT Contract,
  CAST(100 * SUM(CASE WHEN InternetService = 'DSL' THEN Churn_binary END) AS DOUBLE)
    / NULLIF(SUM(CAST(InternetService = 'DSL' AS INTEGER)), 0) AS "DSL",
  CAST(100 * SUM(CASE WHEN InternetService = 'Fiber optic' THEN Churn_binary END) AS DOUBLE)
    / NULLIF(SUM(CAST(InternetService = 'Fiber optic' AS INTEGER)), 0) AS "Fiber optic",
  CAST(100 * SUM(CASE WHEN InternetService = 'No' THEN Churn_binary END) AS DOUBLE)
    / NULLIF(SUM(CAST(InternetService = 'No' AS INTEGER)), 0) AS "No"
FROM customers GROUP BY Contract""")

SQL["value_counts_payment"] = on_customers("""
SELECT PaymentMethod, COUNT(*) AS count FROM customers GROUP BY 1""")

SQL["top_k_clv_at_risk"] = on_customers("""
SELECT customer_id, clv_at_risk, Contract FROM customers
ORDER BY clv_at_risk DESC, customer_id LIMIT 100""")


def _rfm(spark, sf):
    df = D.customers(spark, sf)
    return S.rfm_scores(df)


def q_rfm_scores(spark, sf):
    r = _rfm(spark, sf)
    return r.select("customer_id", "r_score", "f_score", "m_score", "rfm_total",
                    S.rfm_segment("rfm_total").alias("rfm_segment"))


def q_segment_drilldown(spark, sf):
    r = _rfm(spark, sf).withColumn("rfm_segment", S.rfm_segment("rfm_total"))
    return S.segment_drilldown(r, "rfm_segment", "Loyal")["kpis"]


QUERIES = {
    "subscriptions": (q_subscriptions, SQL_SUBSCRIPTIONS),
    "feature_table": (q_feature_table, SQL_FEATURE_TABLE),
    "percentile_ranks": (q_percentile_ranks, SQL_PERCENTILE_RANKS),
    "second_gen_features": (q_second_gen, SQL_SECOND_GEN),
    "missing_profile": (q_missing_profile, _missing_sql()),
    "quality_checks": (q_quality_checks, SQL_QUALITY_CHECKS),
    "dedupe": (q_dedupe, SQL_DEDUPE),
    "fill_mode": (q_fill_mode, SQL_FILL_MODE),
    "validate_rows": (q_validate_rows, SQL_VALIDATE_ROWS),
    "churn_by_segment": (_c(S.churn_by_segment), SQL["churn_by_segment"]),
    "revenue_at_risk_cohort": (_c(S.revenue_at_risk_cohort), SQL["revenue_at_risk_cohort"]),
    "payment_method_risk": (_c(S.payment_method_risk), SQL["payment_method_risk"]),
    "service_adoption_churn": (_c(S.service_adoption_churn), SQL["service_adoption_churn"]),
    "clv_at_risk_decile": (_c(S.clv_at_risk_decile), SQL["clv_at_risk_decile"]),
    "contract_window_analysis": (_c(S.contract_window_analysis), SQL["contract_window_analysis"]),
    "senior_risk_profile": (_c(S.senior_risk_profile), SQL["senior_risk_profile"]),
    "cumulative_mrr_loss": (_c(S.cumulative_mrr_loss), SQL["cumulative_mrr_loss"]),
    "fiber_optic_deep_dive": (_c(S.fiber_optic_deep_dive), SQL["fiber_optic_deep_dive"]),
    "intervention_roi": (_c(S.intervention_roi), SQL["intervention_roi"]),
    "churn_by_contract": (_c(S.churn_by_contract), SQL["churn_by_contract"]),
    "revenue_metrics": (_c(S.revenue_metrics), SQL["revenue_metrics"]),
    "ltv_segments": (_c(S.ltv_segments), SQL["ltv_segments"]),
    "rate_by_payment_senior": (_c(lambda d: S.rate_by(d, ["PaymentMethod", "SeniorCitizen"])),
                               SQL["rate_by_payment_senior"]),
    "rate_by_tenure_bucket": (_c(lambda d: S.rate_by(d, ["tenure_bucket"])),
                              SQL["rate_by_tenure_bucket"]),
    "revenue_lost_by_internet": (_c(lambda d: S.revenue_lost_by(d, "InternetService")),
                                 SQL["revenue_lost_by_internet"]),
    "business_impact": (_c(S.business_impact), SQL["business_impact"]),
    "with_without_service": (_c(S.with_without_service), SQL["with_without_service"]),
    "profile_by_target": (_c(S.profile_by_target), SQL["profile_by_target"]),
    "executive_kpis": (_c(lambda d: S.executive_kpis(d, d)), SQL["executive_kpis"]),
    "revenue_kpis": (_c(S.revenue_kpis), SQL["revenue_kpis"]),
    "charge_band_churn": (_c(S.charge_band_churn), SQL["charge_band_churn"]),
    "histogram_monthly_by_churn": (_c(lambda d: S.histogram(d, "monthly_cents", 40, ["Churn_binary"])),
                                   SQL["histogram_monthly_by_churn"]),
    "box_stats_tenure_by_churn": (_c(lambda d: S.box_stats(d, "tenure", ["Churn_binary"])),
                                  SQL["box_stats_tenure_by_churn"]),
    "two_group_ratio_autopay": (_c(lambda d: S.two_group_ratio(d, "has_auto_pay")),
                                SQL["two_group_ratio_autopay"]),
    "cohort_retention": (_c(S.cohort_retention), SQL["cohort_retention"]),
    "cohort_summary": (_c(S.cohort_summary), SQL["cohort_summary"]),
    "rfm_scores": (q_rfm_scores, SQL["rfm_scores"]),
    "rfm_summary": (lambda spark, sf: S.rfm_summary(_rfm(spark, sf)), SQL["rfm_summary"]),
    "segment_drilldown_loyal": (q_segment_drilldown, SQL["segment_drilldown_loyal"]),
    "crosstab_contract_internet": (_c(lambda d: S.crosstab(d, "Contract", "InternetService")),
                                   SQL["crosstab_contract_internet"]),
    "pivot_contract_internet": (_c(lambda d: S.pivot_rate(d, "Contract", "InternetService",
                                                          ["DSL", "Fiber optic", "No"])),
                                SQL["pivot_contract_internet"]),
    "value_counts_payment": (_c(lambda d: S.value_counts(d, "PaymentMethod")),
                             SQL["value_counts_payment"]),
    "top_k_clv_at_risk": (_c(lambda d: S.top_k(d, "clv_at_risk", 100)
                             .select("customer_id", "clv_at_risk", "Contract")),
                          SQL["top_k_clv_at_risk"]),
    "scatter_extract": (_c(lambda d: S.scatter_extract(d, ["tenure", "MonthlyCharges",
                                                           "advanced_risk_score"])), None),
}
