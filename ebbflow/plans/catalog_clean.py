"""Registered cleaning and enrichment queries (B4, B8, B10, B11, C15, C16, J2, J4) with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ebbflow.operators import archetypes as J
from ebbflow.operators import clean as B
from ebbflow.operators import features as C
from ebbflow.plans import datasets as D
from ebbflow.plans.oracle_base import with_ctes
from ebbflow.plans.oracle_features import on_customers
from ebbflow.sources import tables


def q_drop_missing(spark, sf):
    """Contracts without internet have no service, and those of one order in five no charge here."""
    s = D.subscriptions(spark, sf).select(
        "customer_id", "Contract", F.when(F.col("InternetService") != "No", F.col("InternetService")).alias("InternetService"),
        F.when(F.col("customer_id") % 5 != 0, F.col("monthly_cents")).alias("monthly_cents"))
    return B.drop_missing(s, ["InternetService", "monthly_cents"])


SQL_DROP_MISSING = with_ctes(body="""
SELECT customer_id, Contract, InternetService, monthly_cents FROM subscriptions
WHERE InternetService <> 'No' AND customer_id % 5 <> 0 AND monthly_cents IS NOT NULL""")


def q_encode(spark, sf):
    yes = lambda c, no: F.when(F.col(c) == 1, "Yes").otherwise(no).alias(c)
    s = D.subscriptions(spark, sf).select("customer_id", yes("Partner", "No"), yes("OnlineSecurity", "No internet service"),
                                          yes("Churn_binary", "No").alias("Churn"), "tenure")
    return B.binary_target(B.encode_yes_no(s, ["Partner", "OnlineSecurity", "tenure"])).drop("Churn")


SQL_ENCODE = with_ctes(body="""
SELECT customer_id, Partner, OnlineSecurity, tenure, Churn_binary FROM subscriptions""")


def q_fill_zero(spark, sf):
    s = D.subscriptions(spark, sf).select(
        "customer_id", F.when(F.col("tenure") > 12, F.col("monthly_cents")).alias("monthly_cents"),
        F.when(F.col("Contract") == "Two year", F.col("total_cents")).alias("total_cents"))
    return B.fill_zero(s, ["monthly_cents"])


SQL_FILL_ZERO = with_ctes(body="""
SELECT customer_id, CASE WHEN tenure > 12 THEN monthly_cents ELSE 0 END AS monthly_cents,
       CASE WHEN Contract = 'Two year' THEN total_cents END AS total_cents FROM subscriptions""")


def _macro(spark, sf):
    """One row of signals from the star schema: mean balance and price as growth and inflation."""
    balance = tables.read(spark, sf, "customer").agg(
        (F.sum(F.round(F.col("c_acctbal") * 100).cast("long")).cast("double") / (F.count(F.lit(1)) * 100000)).alias("macro_gdp_growth"))
    orders = tables.read(spark, sf, "orders").agg(F.count_distinct("o_orderpriority").cast("double").alias("macro_inflation"))
    return balance.crossJoin(orders)


def q_macro(spark, sf):
    c = D.customers(spark, sf).select("customer_id", "Contract")
    macro = C.derive_macro(_macro(spark, sf)).select("macro_gdp_growth", "macro_inflation", "macro_stress_index",
                                                     "macro_consumer_pressure", "trend_churn_intent")
    rounded = [F.round(x, 6).alias(x) for x in ("macro_gdp_growth", "macro_stress_index", "macro_consumer_pressure")]
    return C.add_macro(c, macro).select("customer_id", "Contract", "macro_inflation", "trend_churn_intent", *rounded)


SQL_MACRO = on_customers("""
SELECT customer_id, Contract, infl AS macro_inflation, 50.0::DOUBLE AS trend_churn_intent,
       round(gdp, 6) AS macro_gdp_growth, round(infl + 3.8::DOUBLE - gdp, 6) AS macro_stress_index,
       round(infl * 3.8::DOUBLE, 6) AS macro_consumer_pressure
FROM customers, (SELECT CAST(SUM(CAST(round(c_acctbal * 100) AS BIGINT)) AS DOUBLE) / (COUNT(*) * 100000) AS gdp FROM customer),
     (SELECT CAST(COUNT(DISTINCT o_orderpriority) AS DOUBLE) AS infl FROM orders)""")


def _labelled(spark, sf):
    """Clusters by rule, so that the profiles have an exact oracle."""
    return D.customers(spark, sf).where("Churn_binary = 1").withColumn(
        "cluster", F.when(F.col("tenure") <= 6, 0).when(F.col("tenure") <= 24, 1).otherwise(2))


def q_segment_profile(spark, sf):
    c = D.customers(spark, sf).withColumn("segment", (F.col("tenure") / 24).cast("int"))
    return J.segment_profile(c)


SQL_SEGMENT_PROFILE = on_customers("""
SELECT segment, COUNT(*) AS customers, CAST(SUM(Churn_binary) AS DOUBLE) / COUNT(*) AS churn_rate,
       CAST(SUM(monthly_cents) AS DOUBLE) / (COUNT(*) * 100) AS avg_monthly_charges
FROM (SELECT *, CAST(floor(tenure / 24.0) AS INTEGER) AS segment FROM customers) GROUP BY segment""")


def q_cluster_profiles(spark, sf):
    p = J.cluster_profiles(_labelled(spark, sf))
    return p.select("cluster", *[F.round(c, 9).alias(c) for c in J.CLUSTER_FEATURES])


_PROFILE = ["tenure", "MonthlyCharges", "TotalCharges", "service_adoption_score", "is_month_to_month", "is_new_customer", "has_fiber",
            "charge_per_service", "base_risk_score", "has_auto_pay", "is_high_charger", "fiber_no_security"]
SQL_CLUSTER_PROFILES = on_customers("SELECT cluster, " + ", ".join(f"round(avg(CAST({c} AS DOUBLE)), 9) AS {c}" for c in _PROFILE) + """
FROM (SELECT *, CASE WHEN tenure <= 6 THEN 0 WHEN tenure <= 24 THEN 1 ELSE 2 END AS cluster
      FROM customers WHERE Churn_binary = 1) GROUP BY cluster""")


QUERIES = {
    "drop_missing": (q_drop_missing, SQL_DROP_MISSING),
    "encode_yes_no": (q_encode, SQL_ENCODE),
    "fill_zero": (q_fill_zero, SQL_FILL_ZERO),
    "macro_enrichment": (q_macro, SQL_MACRO),
    "segment_profile": (q_segment_profile, SQL_SEGMENT_PROFILE),
    "cluster_profiles": (q_cluster_profiles, SQL_CLUSTER_PROFILES),
}
