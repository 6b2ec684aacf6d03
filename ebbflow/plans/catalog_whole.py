"""Registered queries over every column and every output of an operator, and over joined tables
(B7, B16, N7, N11, G6, M1, M4, M6, E4, E5, K17), with oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbflow.operators import archetypes as J
from ebbflow.operators import clean as B
from ebbflow.operators import evaluate as K
from ebbflow.operators import features as C
from ebbflow.operators import joins
from ebbflow.operators import monitor as N
from ebbflow.operators import scoring as M
from ebbflow.operators import segments as S
from ebbflow.operators import survival as I
from ebbflow.plans import catalog_clean, catalog_evaluate, catalog_ops as ops, catalog_segments as seg
from ebbflow.plans import datasets as D
from ebbflow.plans.oracle_base import SUBSCRIPTIONS_CTES
from ebbflow.plans.oracle_features import on_customers

#: Every numeric column of the feature table.
NUMERIC = ops.DRIFT_FEATURES
_cast = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in NUMERIC)
_LONG = f"""
long AS (UNPIVOT (SELECT {_cast} FROM customers) ON {", ".join(NUMERIC)} INTO NAME feature VALUE v)"""


def _numbers(spark, sf) -> DataFrame:
    return D.customers(spark, sf).select("customer_id", *NUMERIC)


# ------------------------------------------------------------------ B7, B16, N11
def q_describe(spark, sf):
    d = B.describe(_numbers(spark, sf), NUMERIC)
    return d.withColumns({c: F.round(c, 6) for c in ("mean", "std")})


SQL_DESCRIBE = on_customers("""
SELECT feature AS "column", COUNT(*) AS count, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, min(v) AS min,
  quantile_cont(v, 0.25) AS q25, quantile_cont(v, 0.5) AS q50, quantile_cont(v, 0.75) AS q75, max(v) AS max
FROM long GROUP BY feature""", _LONG)


def q_iqr_bounds(spark, sf):
    return B.iqr_bounds(_numbers(spark, sf), NUMERIC)


SQL_IQR_BOUNDS = on_customers("""
SELECT feature AS "column", q1, q3, iqr, lower, upper, CAST(SUM(CAST(v < lower OR v > upper AS INTEGER)) AS BIGINT) AS outliers
FROM long JOIN b USING (feature) GROUP BY ALL""", _LONG, """
b AS (SELECT *, q3 - q1 AS iqr, q1 - 1.5::DOUBLE * (q3 - q1) AS lower, q3 + 1.5::DOUBLE * (q3 - q1) AS upper
      FROM (SELECT feature, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM long GROUP BY feature))""")


def q_iqr_cap(spark, sf):
    return B.iqr_cap(_numbers(spark, sf), NUMERIC)


def _capped(c: str) -> str:
    iqr = f"({c}_3 - {c}_1)"
    return (f"CASE WHEN {c} IS NULL OR {iqr} = 0 THEN CAST({c} AS DOUBLE) "
            f"ELSE least(greatest({c}, {c}_1 - 1.5::DOUBLE * {iqr}), {c}_3 + 1.5::DOUBLE * {iqr}) END AS {c}")


SQL_IQR_CAP = on_customers(f"""
SELECT customer_id, {', '.join(_capped(c) for c in NUMERIC)} FROM customers CROSS JOIN q""", f"""
q AS (SELECT {', '.join(f'quantile_cont({c}, 0.25) AS {c}_1, quantile_cont({c}, 0.75) AS {c}_3' for c in NUMERIC)} FROM customers)""")


def q_quality(spark, sf):
    return N.quality_report(ops._tagged(spark, sf), NUMERIC).withColumn("mean", F.round("mean", 6))


SQL_QUALITY = on_customers("""
SELECT "window", feature AS "column", COUNT(*) AS rows, CAST(SUM(CAST(v IS NULL AS INTEGER)) AS BIGINT) AS nulls,
  COUNT(DISTINCT v) AS distinct, min(v) AS min, max(v) AS max, round(avg(v), 6) AS mean
FROM long GROUP BY 1, 2""", ops.TAG_CTE, f"""
long AS (
  UNPIVOT INCLUDE NULLS (SELECT "window", {_cast} FROM tagged) ON {", ".join(NUMERIC)} INTO NAME feature VALUE v)""".replace(
    "UNPIVOT INCLUDE NULLS (", "FROM (").replace(f") ON {', '.join(NUMERIC)} INTO NAME feature VALUE v",
                                                 f") UNPIVOT INCLUDE NULLS (v FOR feature IN ({', '.join(NUMERIC)}))"))


# ------------------------------------------------------------------ N7, M6, G6
def q_refresh(spark, sf):
    stamped, _ = N.refresh_predictions(D.customers(spark, sf), ops.AS_OF)
    return stamped.select("customer_id", "churn_probability", "last_updated")


SQL_REFRESH = on_customers(f"SELECT customer_id, churn_probability, TIMESTAMP '{ops.AS_OF}' AS last_updated FROM customers")


def q_register_kpis(spark, sf):
    _, kpis = M.risk_register(K.customer_predictions(D.customers(spark, sf), tier_rule="ge"), min_p=0.3)
    return kpis.select("customers", "mrr", *[F.round(c, 6).alias(c) for c in ("avg_probability", "clv_at_risk")])


SQL_REGISTER_KPIS = on_customers("""
SELECT COUNT(*) AS customers, CAST(SUM(monthly_cents) AS DOUBLE) / 100 AS mrr, round(avg(churn_probability), 6) AS avg_probability,
       round(SUM(MonthlyCharges * 12 * churn_probability), 6) AS clv_at_risk
FROM customers WHERE churn_probability >= 0.3""")


def q_drilldown_counts(spark, sf):
    """Both distributions of the drilled segment."""
    r = seg._rfm(spark, sf).withColumn("rfm_segment", S.rfm_segment("rfm_total"))
    parts = S.segment_drilldown(r, "rfm_segment", "Loyal")
    long = lambda k, c: parts[k].select(F.lit(k).alias("section"), F.col(c).alias("value"), "count")
    return long("contract", "Contract").unionByName(long("internet", "InternetService"))


SQL_DRILLDOWN_COUNTS = on_customers("""
SELECT 'contract' AS section, Contract AS value, COUNT(*) AS count FROM rfm2 WHERE rfm_total >= 6 AND rfm_total < 8 GROUP BY 2
UNION ALL SELECT 'internet', InternetService, COUNT(*) FROM rfm2 WHERE rfm_total >= 6 AND rfm_total < 8 GROUP BY 2""", seg.RFM_CTES)


# ------------------------------------------------------------------ F26, M3
def q_services_ratio(spark, sf):
    """Four and more services against a single one."""
    n = F.col("service_adoption_score")
    return S.two_group_ratio(D.customers(spark, sf), n >= 4, against=n == 1)


SQL_SERVICES_RATIO = on_customers("""
SELECT rate_with, rate_without, rate_without / rate_with AS ratio FROM (
  SELECT avg(Churn_binary) FILTER (service_adoption_score >= 4) AS rate_with,
         avg(Churn_binary) FILTER (service_adoption_score = 1) AS rate_without FROM customers)""")


def q_campaigns(spark, sf):
    """Churned customers and their monthly revenue per campaign."""
    named = J.archetype_rule(D.customers(spark, sf).where("Churn_binary = 1")).withColumn("c", M.campaign())
    return named.groupBy("archetype", F.col("c.action").alias("action"), F.col("c.description").alias("description")).agg(
        F.count(F.lit(1)).alias("customers"), (F.sum("monthly_cents").cast("double") / 100).alias("mrr"))


_ACTIONS = " ".join(f"WHEN '{k}' THEN '{a}'" for k, (a, _) in M.CAMPAIGNS.items())
_TEXTS = " ".join(f"WHEN '{k}' THEN '{t}'" for k, (_, t) in M.CAMPAIGNS.items())
SQL_CAMPAIGNS = on_customers(f"""
SELECT archetype, CASE archetype {_ACTIONS} END AS action, CASE archetype {_TEXTS} END AS description,
       COUNT(*) AS customers, CAST(SUM(monthly_cents) AS DOUBLE) / 100 AS mrr
FROM (SELECT *, {ops._ARCH} AS archetype FROM customers WHERE Churn_binary = 1) GROUP BY archetype""")


# ------------------------------------------------------------------ M1, M4
def q_score_all_fields(spark, sf):
    """All 14 fields, the macro context from signals of the tables; arrays and maps as text and columns."""
    macro = C.derive_macro(catalog_clean._macro(spark, sf))
    s = M.score_customers(D.customers(spark, sf), macro=macro, engineered=True, as_of=ops.AS_OF)
    factor = F.transform("top_risk_factors", lambda x: F.concat(x.factor, F.lit("="), x.weight.cast("string"), F.lit(": "), x.explanation))
    signals = [F.round(F.col("macro_context")[k], 6).alias(f"macro_{k}") for k in ("gdp_growth", "inflation", "unemployment", "stress_index")]
    return s.select(*ops.SCORE_FIELDS, "clv_at_risk_12m", F.array_join(factor, "; ").alias("factors"), *signals)


_FACTORS = ", ".join(f"CASE WHEN {c} = 1 THEN '{label}={w}: {text}' END" for c, label, w, text in M.RISK_FACTORS)
_exact = lambda x: f"CAST(round(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38, 22)), 2) AS DOUBLE)"  # noqa: E731  half up, as printed
SQL_SCORE_ALL_FIELDS = ops.SQL_SCORE_FIELDS.replace("AS predicted_at\n", f"""AS predicted_at,
  {_exact('MonthlyCharges * 12 * churn_probability')} AS clv_at_risk_12m,
  array_to_string(list_filter([{_FACTORS}], lambda x: x IS NOT NULL)[1:5], '; ') AS factors,
  round(gdp, 6) AS macro_gdp_growth, infl AS macro_inflation, 3.8::DOUBLE AS macro_unemployment, round(infl + 3.8::DOUBLE - gdp, 6) AS macro_stress_index
""") + """, (SELECT CAST(SUM(CAST(round(c_acctbal * 100) AS BIGINT)) AS DOUBLE) / (COUNT(*) * 100000) AS gdp FROM customer),
     (SELECT CAST(COUNT(DISTINCT o_orderpriority) AS DOUBLE) AS infl FROM orders)"""

_VALID = SUBSCRIPTIONS_CTES.strip().replace("subscriptions AS (", "all_subscriptions AS (") + """,
subscriptions AS (SELECT * FROM all_subscriptions WHERE TotalCharges IS NOT NULL)"""
SQL_BATCH_SUMMARY = on_customers(f"""
SELECT COUNT(*) + max(failed) AS total_customers, CAST(SUM(CAST(churn_probability >= 0.6 AS INTEGER)) AS BIGINT) AS high_risk_count,
       round(SUM({_exact('MonthlyCharges * 12 * churn_probability')}), 2) AS total_clv_at_risk, max(failed) AS failed
FROM customers, (SELECT COUNT(*) AS failed FROM all_subscriptions WHERE TotalCharges IS NULL)""").replace(SUBSCRIPTIONS_CTES.strip(), _VALID)


# ------------------------------------------------------------------ E4, E5, K17
def q_predictions_joined(spark, sf):
    """Predictions with the survival and archetype tables: next month's hazard and the months to the
    median of each contract's life table, names of the churned customers."""
    c = D.customers(spark, sf)
    table = I.life_table(c, "tenure", "Churn_binary", ["Contract"])
    hazard = table.select("Contract", F.col("t").alias("tenure"), (F.col("events").cast("double") / F.col("at_risk")).alias("churn_prob_30d"))
    median = I.median_survival(I.kaplan_meier(c, "tenure", "Churn_binary", ["Contract"]), ["Contract"])
    survival = (c.where("tenure < 60").select("customer_id", "Contract", "tenure").join(hazard, ["Contract", "tenure"]).join(F.broadcast(median), "Contract")
                .select("customer_id", "churn_prob_30d", F.greatest(F.lit(0.0), F.col("median_survival") - F.col("tenure")).alias("months_remaining")))
    names = J.archetype_rule(c.where("Churn_binary = 1")).select("customer_id", "archetype")
    return K.customer_predictions(c, survival=survival, archetypes=names)


SQL_PREDICTIONS_JOINED = on_customers("""
SELECT r.*, churn_prob_30d, months_remaining, archetype
FROM ranked r
LEFT JOIN (SELECT customer_id, CAST(h.events AS DOUBLE) / h.at_risk AS churn_prob_30d,
                  greatest(0.0::DOUBLE, coalesce(m.t, 72) - customers.tenure) AS months_remaining
           FROM customers JOIN h USING (Contract, tenure)
           LEFT JOIN (SELECT Contract, min(tenure) AS t FROM km WHERE s <= 0.5 GROUP BY Contract) m USING (Contract)
           WHERE tenure < 60) USING (customer_id)
LEFT JOIN (SELECT customer_id, """ + ops._ARCH + """ AS archetype FROM customers WHERE Churn_binary = 1) USING (customer_id)""",
                                      catalog_evaluate.PRED_CTE, """
h AS (SELECT Contract, tenure, SUM(d) AS events, SUM(SUM(n)) OVER (PARTITION BY Contract ORDER BY tenure DESC) AS at_risk
      FROM (SELECT Contract, tenure, COUNT(*) AS n, SUM(Churn_binary) AS d FROM customers GROUP BY 1, 2) GROUP BY 1, 2),
km AS (SELECT Contract, tenure, exp(SUM(CASE WHEN events < at_risk THEN ln(1 - events / CAST(at_risk AS DOUBLE)) ELSE -1e9 END)
         OVER (PARTITION BY Contract ORDER BY tenure)) AS s FROM h)""")


def _two_tables(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Contracts without every tenth, and line totals of the orders; a third of these has no contract."""
    from ebbflow.sources import tables
    left = D.customers(spark, sf).where("customer_id % 10 <> 0").select("customer_id", "Contract")
    lines = (tables.read(spark, sf, "lineitem").where("l_orderkey % 3 <> 0").groupBy(F.col("l_orderkey").alias("customer_id"))
             .agg(F.count(F.lit(1)).alias("lines")))
    return left, lines


def q_one_to_one(spark, sf):
    return joins.one_to_one(*_two_tables(spark, sf), "customer_id")


def q_key_report(spark, sf):
    left, lines = _two_tables(spark, sf)
    return joins.key_report(left, lines.unionByName(lines.where("customer_id % 7 = 0")), "customer_id")


_TABLES = """
l AS (SELECT customer_id, Contract FROM customers WHERE customer_id % 10 <> 0),
r AS (SELECT l_orderkey AS customer_id, COUNT(*) AS lines FROM lineitem WHERE l_orderkey % 3 <> 0 GROUP BY 1)"""
SQL_ONE_TO_ONE = on_customers("SELECT customer_id, Contract, lines FROM l LEFT JOIN r USING (customer_id)", _TABLES)
SQL_KEY_REPORT = on_customers("""
SELECT COUNT(*) FILTER (l.customer_id IS NOT NULL AND r.customer_id IS NOT NULL) AS matched, COUNT(*) FILTER (r.customer_id IS NULL) AS left_only,
  COUNT(*) FILTER (l.customer_id IS NULL) AS right_only, 0::BIGINT AS left_repeated, COUNT(*) FILTER (r.customer_id % 7 = 0) AS right_repeated,
  0::BIGINT AS left_null, 0::BIGINT AS right_null
FROM l FULL JOIN r ON l.customer_id = r.customer_id""", _TABLES)

QUERIES = {
    "describe": (q_describe, SQL_DESCRIBE),
    "iqr_bounds": (q_iqr_bounds, SQL_IQR_BOUNDS),
    "iqr_cap": (q_iqr_cap, SQL_IQR_CAP),
    "quality_report": (q_quality, SQL_QUALITY),
    "refresh_predictions": (q_refresh, SQL_REFRESH),
    "refresh_summary": (lambda spark, sf: N.refresh_predictions(D.customers(spark, sf), ops.AS_OF)[1], ops.SQL_REFRESH),
    "risk_register_kpis": (q_register_kpis, SQL_REGISTER_KPIS),
    "segment_drilldown_counts": (q_drilldown_counts, SQL_DRILLDOWN_COUNTS),
    "two_group_ratio_services": (q_services_ratio, SQL_SERVICES_RATIO),
    "intervention_campaigns": (q_campaigns, SQL_CAMPAIGNS),
    "score_customers_all_fields": (q_score_all_fields, SQL_SCORE_ALL_FIELDS),
    "batch_summary": (ops.q_batch_summary, SQL_BATCH_SUMMARY),
    "customer_predictions_joined": (q_predictions_joined, SQL_PREDICTIONS_JOINED),
    "one_to_one_join": (q_one_to_one, SQL_ONE_TO_ONE),
    "key_report": (q_key_report, SQL_KEY_REPORT),
}
