"""Hand-written SQL for the cleaned feature table (``customers``), DuckDB dialect.

Literals are typed explicitly (``::DOUBLE``) because DuckDB reads ``1.5`` as a
DECIMAL; transcendental columns are compared after ``round(·, 6)``.
"""

from ebbflow.plans.oracle_base import with_ctes

CUSTOMERS_CTES = """
stats AS (
  SELECT quantile_cont(MonthlyCharges, 0.25) AS q25,
         quantile_cont(MonthlyCharges, 0.5) AS q50,
         quantile_cont(MonthlyCharges, 0.75) AS q75,
         quantile_cont(TotalCharges, 0.5) AS t_med
  FROM subscriptions
),
c0 AS (
  SELECT s.* REPLACE (coalesce(s.TotalCharges, st.t_med) AS TotalCharges),
         st.q25, st.q50, st.q75
  FROM subscriptions s CROSS JOIN stats st
),
c1 AS (
  SELECT *,
    TotalCharges / (tenure + 1) AS charge_per_month,
    TotalCharges / (MonthlyCharges * (tenure + 1) + 1) AS charge_to_monthly_ratio,
    CAST(MonthlyCharges > q75 AS INTEGER) AS is_high_charger,
    CAST(MonthlyCharges < q25 AS INTEGER) AS is_low_charger,
    CAST(MonthlyCharges > q50 AS INTEGER) AS charge_above_median,
    MonthlyCharges / (TotalCharges + 1) AS monthly_to_total_ratio,
    MonthlyCharges * 24 AS expected_lifetime_value,
    TotalCharges / (MonthlyCharges * 24 + 1) AS actual_vs_expected_clv,
    MonthlyCharges / (TotalCharges / (tenure + 1) + 1) AS charge_trend,
    TotalCharges / (tenure * MonthlyCharges + 1) AS revenue_efficiency,
    CAST(tenure AS BIGINT) * tenure AS tenure_squared,
    ln(1 + tenure) AS tenure_log,
    CAST(tenure <= 6 AS INTEGER) AS is_new_customer,
    CAST(tenure <= 12 AS INTEGER) AS is_early_customer,
    CAST(tenure >= 48 AS INTEGER) AS is_loyal_customer,
    CAST(tenure >= 60 AS INTEGER) AS is_veteran_customer,
    CASE WHEN tenure > 0 AND tenure <= 6 THEN 1.0::DOUBLE
         WHEN tenure > 6 AND tenure <= 12 THEN 2.0::DOUBLE
         WHEN tenure > 12 AND tenure <= 24 THEN 3.0::DOUBLE
         WHEN tenure > 24 AND tenure <= 48 THEN 4.0::DOUBLE
         WHEN tenure > 48 AND tenure <= 72 THEN 5.0::DOUBLE END AS tenure_bucket,
    greatest(0, 12 - tenure) AS months_remaining_1yr,
    greatest(0, 24 - tenure) AS months_remaining_2yr,
    tenure / 24.0::DOUBLE AS contract_age_ratio,
    OnlineSecurity + OnlineBackup + DeviceProtection + TechSupport + StreamingTV
      + StreamingMovies AS service_adoption_score,
    OnlineSecurity + OnlineBackup + DeviceProtection AS security_bundle,
    StreamingTV + StreamingMovies AS entertainment_bundle,
    TechSupport + DeviceProtection AS support_bundle,
    CAST(Contract = 'Month-to-month' AS INTEGER) AS is_month_to_month,
    CAST(Contract = 'One year' AS INTEGER) AS is_one_year,
    CAST(Contract = 'Two year' AS INTEGER) AS is_two_year,
    CAST(lower(PaymentMethod) LIKE '%automatic%' AS INTEGER) AS has_auto_pay,
    CAST(lower(PaymentMethod) LIKE '%electronic%' AS INTEGER) AS uses_electronic,
    CAST(lower(PaymentMethod) LIKE '%mailed%' AS INTEGER) AS uses_mailed_check,
    CAST(InternetService = 'Fiber optic' AS INTEGER) AS has_fiber,
    CAST(InternetService = 'DSL' AS INTEGER) AS has_dsl,
    CAST(InternetService = 'No' AS INTEGER) AS no_internet,
    SeniorCitizen AS is_senior,
    Partner AS has_partner,
    Dependents AS has_dependents,
    CAST(Partner + Dependents > 0 AS INTEGER) AS has_family
  FROM c0
),
c2 AS (
  SELECT *,
    service_adoption_score / 6.0::DOUBLE AS service_adoption_pct,
    CAST(service_adoption_score <= 1 AS INTEGER) AS is_single_service,
    CAST(service_adoption_score = 6 AS INTEGER) AS is_full_service,
    CAST(security_bundle > 0 AS INTEGER) AS has_any_security,
    CAST(entertainment_bundle > 0 AS INTEGER) AS has_entertainment,
    service_adoption_score / (MonthlyCharges + 1) AS services_per_dollar,
    MonthlyCharges / (service_adoption_score + 1) AS charge_per_service,
    CAST(PaperlessBilling = 1 AND has_auto_pay = 0 AS INTEGER) AS paperless_no_auto,
    is_month_to_month * 3 + (1 - has_auto_pay) * 2 AS contract_risk_score,
    CAST(is_senior = 1 AND has_family = 0 AS INTEGER) AS senior_alone,
    CAST(is_senior = 0 AND has_family = 1 AS INTEGER) AS young_family,
    CAST(is_senior = 1 AND is_month_to_month = 1 AS INTEGER) AS senior_month_to_month
  FROM c1
),
c3 AS (
  SELECT *,
    CAST(has_fiber = 1 AND has_any_security = 0 AS INTEGER) AS fiber_no_security,
    CAST(has_fiber = 1 AND TechSupport = 0 AS INTEGER) AS fiber_no_support,
    CAST(has_fiber = 1 AND is_high_charger = 1 AS INTEGER) AS fiber_high_charge,
    is_month_to_month * 3 + is_new_customer * 2 + is_single_service * 2
      + is_high_charger + (1 - has_auto_pay) AS base_risk_score
  FROM c2
),
c4 AS (
  SELECT *,
    base_risk_score * 1.0::DOUBLE + fiber_no_security * 2.0::DOUBLE
      + fiber_high_charge * 1.5::DOUBLE + paperless_no_auto * 1.0::DOUBLE
      + senior_month_to_month * 1.5::DOUBLE AS advanced_risk_score
  FROM c3
),
customers AS (
  SELECT * EXCLUDE (q25, q50, q75),
    MonthlyCharges * 12 * advanced_risk_score / 10 AS clv_at_risk,
    CAST(tenure AS DOUBLE) * MonthlyCharges AS poly_tenure_MonthlyCharges,
    CAST(tenure AS DOUBLE) * service_adoption_score AS poly_tenure_service_adoption_score,
    CAST(tenure AS DOUBLE) * base_risk_score AS poly_tenure_base_risk_score,
    CAST(tenure AS DOUBLE) * charge_per_service AS poly_tenure_charge_per_service,
    MonthlyCharges * service_adoption_score AS poly_MonthlyCharges_service_adoption_score,
    MonthlyCharges * base_risk_score AS poly_MonthlyCharges_base_risk_score,
    MonthlyCharges * charge_per_service AS poly_MonthlyCharges_charge_per_service,
    CAST(service_adoption_score AS DOUBLE) * base_risk_score
      AS poly_service_adoption_score_base_risk_score,
    CAST(service_adoption_score AS DOUBLE) * charge_per_service
      AS poly_service_adoption_score_charge_per_service,
    CAST(base_risk_score AS DOUBLE) * charge_per_service AS poly_base_risk_score_charge_per_service,
    least(1.0::DOUBLE, advanced_risk_score / 20.0::DOUBLE) AS churn_probability
  FROM c4
)"""


def on_customers(body: str, *extra: str) -> str:
    """Oracle query over the ``customers`` CTE chain."""
    return with_ctes(CUSTOMERS_CTES, *extra, body=body)
