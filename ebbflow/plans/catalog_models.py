"""Registered selection, model, survival-model and source queries.

Model fits (MLlib, Cox Newton steps) are iterative and not SQL-expressible, so
those entries are rows-only; their properties are tested in ``tests/``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ebbflow.functions.columns import attach

from ebbflow.operators import evaluate as K
from ebbflow.operators import features as C
from ebbflow.operators import models as Mo
from ebbflow.operators import select as Sel
from ebbflow.operators import survival as I
from ebbflow.plans import datasets as D
from ebbflow.plans.catalog_segments import FEATURE_COLS
from ebbflow.plans.oracle_base import with_ctes
from ebbflow.plans.oracle_features import on_customers
from ebbflow.session import materialize
from ebbflow.sources import tables

MODEL_FEATURES = [c for c in FEATURE_COLS
                  if c not in ("customer_id", "Churn_binary", "churn_probability")]
MI_FEATURES = MODEL_FEATURES  # every numeric column
# The covariates of the proportional-hazards model.
COX_COVARIATES = ["MonthlyCharges", "is_month_to_month",
                  "is_new_customer", "is_high_charger", "service_adoption_score",
                  "has_fiber", "fiber_no_security", "charge_per_service"]
# The columns of the survival view.
SURVIVAL_VIEW = ["customer_id", "tenure", "Churn_binary", "MonthlyCharges", "Contract",
                 "InternetService", "is_month_to_month", "is_new_customer", "is_high_charger",
                 "service_adoption_score", "base_risk_score", "advanced_risk_score", "has_fiber",
                 "fiber_no_security", "charge_per_service"]


def _c(fn):
    return lambda spark, sf: fn(D.customers(spark, sf))


def q_mi(spark, sf):
    mi = Sel.mutual_information(D.customers(spark, sf), MI_FEATURES)
    return mi.withColumn("mutual_information", F.round("mutual_information", 9))


_casts = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in MI_FEATURES)
_MI_SELECT = """
SELECT feature, round(SUM((nxy / n) * ln(CAST(nxy * n AS DOUBLE) / CAST(nx * ny AS DOUBLE))), 9)
         AS mutual_information
FROM (SELECT feature, b, y, nxy, n,
             SUM(nxy) OVER (PARTITION BY feature, b) AS nx, SUM(nxy) OVER (PARTITION BY feature, y) AS ny
      FROM (SELECT feature, b, y, COUNT(*) AS nxy, max(n) AS n
            FROM (SELECT l.feature, l.y, m.n, len(list_filter(m.q, lambda e: e < l.v)) AS b
                  FROM long l JOIN (SELECT feature, COUNT(*) AS n,
                                      quantile_cont(v, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q
                                    FROM long GROUP BY feature) m ON l.feature = m.feature)
            GROUP BY feature, b, y))
GROUP BY feature"""
_MI_LONG = f"""
long AS (SELECT * FROM (UNPIVOT (SELECT Churn_binary AS y, {_casts} FROM customers)
                        ON {", ".join(MI_FEATURES)} INTO NAME feature VALUE v) WHERE v IS NOT NULL)"""
SQL_MI = on_customers(_MI_SELECT, _MI_LONG)
_MI_CTE = f"mi AS ({_MI_SELECT})"
SQL_TOPK = on_customers("""
SELECT feature, mutual_information FROM mi ORDER BY mutual_information DESC, feature LIMIT 10""",
                        _MI_LONG, _MI_CTE)
SQL_SELECT_Q = on_customers("""
SELECT feature, mutual_information FROM mi
WHERE mutual_information > (SELECT quantile_cont(mutual_information, 0.25) FROM mi)
UNION ALL SELECT 'Churn_binary', NULL""", _MI_LONG, _MI_CTE)


def q_corr(spark, sf):
    r = Sel.corr_with_target(D.customers(spark, sf), features=MI_FEATURES)
    return r.withColumn("correlation", F.round("correlation", 6))


SQL_CORR = on_customers(f"""
SELECT feature, round(correlation, 6) AS correlation FROM (
  SELECT feature, corr(v, CAST(y AS DOUBLE)) AS correlation
  FROM (UNPIVOT (SELECT Churn_binary AS y, {_casts} FROM customers)
        ON {", ".join(MI_FEATURES)} INTO NAME feature VALUE v)
  GROUP BY feature)
WHERE correlation IS NOT NULL ORDER BY abs(correlation) DESC, feature LIMIT 5""")


def _split(spark, sf):
    return K.temporal_split(D.customers(spark, sf))


def _eval(model_fn):
    def q(spark, sf):
        s = _split(spark, sf)
        train, test = s.where(F.col("split") == "train"), s.where(F.col("split") == "test")
        model = model_fn(train)
        scored = Mo.predict(model, test.select("customer_id", "Churn_binary", *MODEL_FEATURES))
        scored = materialize(scored.select("Churn_binary", "churn_probability"), "scores")  # the metrics read it several times
        auc = K.roc_auc(scored).select("auc")
        return auc.transform(attach, K.threshold_metrics(scored)).transform(
        attach,
            K.average_precision(scored))
    return q


def q_model_comparison(spark, sf):
    """The four models, scored on the same held-out rows."""
    s = _split(spark, sf)
    train, test = s.where(F.col("split") == "train"), s.where(F.col("split") == "test")
    cols = test.select("customer_id", "Churn_binary", *MODEL_FEATURES)
    train = materialize(train.select("customer_id", "Churn_binary", *MODEL_FEATURES), "train")
    models = Mo.fit_all(spark, {"boosted_b": lambda: Mo.train_boosted(train, MODEL_FEATURES, preset="B"),
                                "boosted_a": lambda: Mo.train_boosted(train, MODEL_FEATURES, preset="A"),
                                "random_forest": lambda: Mo.train_random_forest(train, MODEL_FEATURES),
                                "logistic": lambda: Mo.train_logistic(train, MODEL_FEATURES)})
    long = None
    for name, model in models.items():
        p = Mo.predict(model, cols).select(F.lit(name).alias("model"), "customer_id", "Churn_binary",
                                           F.col("churn_probability").alias("p"))
        long = p if long is None else long.unionByName(p)
    return K.compare_models(materialize(long, "scores"), p="p")


def q_attribution(spark, sf):
    """Mean absolute attributions over the held-out rows, top 15 of either model: exact Shapley values
    of the boosted trees (preset A, the trees that the reference explains), exact terms of the regression."""
    s = _split(spark, sf)
    train, test = s.where(F.col("split") == "train"), s.where(F.col("split") == "test")
    model = Mo.train_logistic(train, MODEL_FEATURES)
    trees = Mo.train_boosted(train, MODEL_FEATURES, preset="A")
    named = lambda name, found: found.select(F.lit(name).alias("model"), "feature", "mean_abs_attribution")
    return named("boosted_a", Mo.tree_attribution(trees, test, MODEL_FEATURES)).unionByName(
        named("logistic", Mo.linear_attribution(model, test, MODEL_FEATURES)))


def _adds_up(contributions, margins):
    """Whether bias and contributions give the model's own margin, for every row."""
    total = F.col("bias") + F.aggregate("contributions", F.lit(0.0), lambda a, x: a + x)
    sums = contributions.select("customer_id", F.size("contributions").alias("features"), total.alias("total"))  # not the arrays go through the join
    return sums.join(margins, "customer_id").select(
        "customer_id", "features", (F.abs(F.col("total") - F.col("margin")) < 1e-8).alias("adds_up"))


def q_tree_contributions(spark, sf):
    """Per-row attributions of boosted trees (30 of preset A's) on the held-out rows."""
    s = _split(spark, sf)
    model = Mo.train_boosted(s.where("split = 'train'"), MODEL_FEATURES, preset=Mo.BOOST_PRESETS["A"] | {"maxIter": 30})
    test = s.where("split = 'test'")
    return _adds_up(Mo.tree_contributions(model, test, MODEL_FEATURES), Mo.margins(model, test))


def q_linear_contributions(spark, sf):
    s = _split(spark, sf)
    model = Mo.train_logistic(s.where("split = 'train'"), MODEL_FEATURES)
    test = s.where("split = 'test'")
    return _adds_up(Mo.linear_contributions(model, test, MODEL_FEATURES), Mo.margins(model, test))


SQL_ADDS_UP = on_customers(f"""
SELECT customer_id, {len(MODEL_FEATURES)} AS features, true AS adds_up
FROM (SELECT *, row_number() OVER (ORDER BY tenure, customer_id) AS pos, COUNT(*) OVER () AS n FROM customers)
WHERE pos > floor(n * 0.8)""")


def q_permutation(spark, sf):
    s = _split(spark, sf)
    train, test = s.where(F.col("split") == "train"), s.where(F.col("split") == "test")
    model = Mo.train_logistic(train, MODEL_FEATURES)
    return Mo.permutation_importance(model, test.select("customer_id", "Churn_binary", *MODEL_FEATURES),
                                     MODEL_FEATURES)


def _cox(spark, sf):
    return I.cox_fit(D.customers(spark, sf), "tenure", "Churn_binary", COX_COVARIATES)


def q_cox_summary(spark, sf):
    return _cox(spark, sf).summary(spark)


def q_cox_predict(spark, sf):
    c = D.customers(spark, sf)
    m = I.cox_fit(c, "tenure", "Churn_binary", COX_COVARIATES)
    p = I.cox_predict_survival(c.select("customer_id", "tenure", *COX_COVARIATES), m, [1.0, 12.0])
    p = I.expected_remaining(p, m)
    return I.expected_remaining(p, m, tenure="tenure", name="expected_months_remaining_conditional") \
        .select("customer_id", "partial_hazard", "churn_prob_1", "churn_prob_12",
                "expected_months_remaining", "expected_months_remaining_conditional")


def q_concordance(spark, sf):
    c = D.customers(spark, sf)
    m = I.cox_fit(c, "tenure", "Churn_binary", COX_COVARIATES)
    scored = c.withColumn("risk", m.linear_predictor())
    return I.concordance_index(scored, "tenure", "Churn_binary", "risk")


def q_concordance_standin(spark, sf):
    return I.concordance_index(D.customers(spark, sf), "tenure", "Churn_binary", "churn_probability")


SQL_CONCORDANCE = on_customers("""
SELECT CAST(SUM(a.d * b.n * CASE WHEN a.r > b.r THEN 2 WHEN a.r = b.r THEN 1 ELSE 0 END) AS DOUBLE)
         / CAST(2 * SUM(a.d * b.n) AS DOUBLE) AS concordance_index,
       CAST(SUM(a.d * b.n) AS BIGINT) AS comparable_pairs
FROM cell a JOIN cell b ON a.t < b.t WHERE a.d > 0""", """
cell AS (SELECT tenure AS t, churn_probability AS r, COUNT(*) AS n, SUM(Churn_binary) AS d
         FROM customers GROUP BY 1, 2)""")


def q_quantile_flags(spark, sf):
    df = C.quantile_flags(D.subscriptions(spark, sf), "total_cents", 0.9, ">", "top_decile_total")
    return df.select("customer_id", "top_decile_total")


SQL_QFLAGS = with_ctes(body="""
SELECT customer_id, CAST(coalesce(total_cents > (SELECT quantile_cont(total_cents, 0.9) FROM subscriptions),
                                  false) AS INTEGER) AS top_decile_total FROM subscriptions""")


def q_trend(spark, sf):
    ev = D.events(spark, sf)
    weekly = (ev.where(F.col("event_type") == "error")
              .groupBy(F.to_date(F.date_trunc("week", "ts")).alias("week"))
              .agg(F.count(F.lit(1)).alias("errors")))
    return C.trend_velocity(weekly, "week", "errors", k=2).select(
        F.round("velocity", 9).alias("velocity"), F.round("mean_value", 9).alias("mean_value"))


SQL_TREND = """
WITH w AS (SELECT CAST(date_trunc('week', ts) AS DATE) AS week, COUNT(*) AS errors
           FROM events WHERE event_type = 'error' GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY week) AS ra, row_number() OVER (ORDER BY week DESC) AS rd FROM w)
SELECT round(avg(CASE WHEN rd <= 2 THEN CAST(errors AS DOUBLE) END)
             - avg(CASE WHEN ra <= 2 THEN CAST(errors AS DOUBLE) END), 9) AS velocity,
       round(avg(CAST(errors AS DOUBLE)), 9) AS mean_value FROM r"""


def q_table_counts(spark, sf):
    names = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
             "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
    for t in names:  # own view names, so a caller's views are never replaced
        tables.register(tables.read(spark, sf, t), f"ebbflow_{t}")
    counts = tables.table_counts(spark, [f"ebbflow_{t}" for t in names])
    return counts.withColumn("table_name", F.regexp_replace("table_name", "^ebbflow_", ""))


SQL_TABLE_COUNTS = """
SELECT 'region' AS table_name, COUNT(*) AS row_count FROM region
UNION ALL SELECT 'nation', COUNT(*) FROM nation
UNION ALL SELECT 'customer', COUNT(*) FROM customer
UNION ALL SELECT 'supplier', COUNT(*) FROM supplier
UNION ALL SELECT 'part', COUNT(*) FROM part
UNION ALL SELECT 'orders', COUNT(*) FROM orders
UNION ALL SELECT 'lineitem', COUNT(*) FROM lineitem
UNION ALL SELECT 'events', COUNT(*) FROM events
UNION ALL SELECT 'documents', COUNT(*) FROM documents
UNION ALL SELECT 'embeddings', COUNT(*) FROM embeddings
UNION ALL SELECT 'pages', COUNT(*) FROM pages
UNION ALL SELECT 'benchmark', COUNT(*) FROM benchmark
UNION ALL SELECT 'labels', COUNT(*) FROM labels
UNION ALL SELECT 'conversations', COUNT(*) FROM conversations"""


QUERIES = {
    "mutual_information": (q_mi, SQL_MI),
    "select_by_quantile": (lambda spark, sf: Sel.select_by_quantile(q_mi(spark, sf)), SQL_SELECT_Q),
    "top_k_features": (lambda spark, sf: Sel.top_k_features(q_mi(spark, sf), 10), SQL_TOPK),
    "vif": (_c(lambda d: Sel.vif(d, MODEL_FEATURES)), None),
    "drop_high_vif": (_c(lambda d: Sel.drop_high_vif(d, ["tenure", "MonthlyCharges", "service_adoption_score",
                                                         "charge_per_service", "is_month_to_month"])
                         .select("feature", F.round("vif", 6).alias("vif"))), None),
    "corr_with_target": (q_corr, SQL_CORR),
    "align_features": (_c(lambda d: Sel.align_features(d, MI_FEATURES + ["missing_col"])[0]
                          .select(*MI_FEATURES)),
                       on_customers("SELECT " + ", ".join(f"coalesce({c}, 0) AS {c}" for c in MI_FEATURES)
                                    + " FROM customers")),
    "train_logistic_eval": (_eval(lambda tr: Mo.train_logistic(tr, MODEL_FEATURES)), None),
    "train_random_forest_eval": (_eval(lambda tr: Mo.train_random_forest(tr, MODEL_FEATURES)), None),
    "train_boosted_eval": (_eval(lambda tr: Mo.train_boosted(tr, MODEL_FEATURES, preset="A")), None),
    "model_comparison": (q_model_comparison, None),
    "feature_attribution": (q_attribution, None),
    "tree_contributions": (q_tree_contributions, SQL_ADDS_UP),
    "linear_contributions": (q_linear_contributions, SQL_ADDS_UP),
    "permutation_importance": (q_permutation, None),
    "cox_summary": (q_cox_summary, None),
    "cox_predict_survival": (q_cox_predict, None),
    "concordance_index": (q_concordance, None),
    "concordance_index_standin": (q_concordance_standin, SQL_CONCORDANCE),
    "survival_view": (_c(lambda d: d.select(*SURVIVAL_VIEW)),
                      on_customers(f"SELECT {', '.join(SURVIVAL_VIEW)} FROM customers")),
    "quantile_flags": (q_quantile_flags, SQL_QFLAGS),
    "trend_velocity": (q_trend, SQL_TREND),
    "table_counts": (q_table_counts, SQL_TABLE_COUNTS),
}
