"""Registered streaming and source/sink queries (Q1–Q6, A1, A2, A4, A6, A8, A9) with oracles.

A stream's input is made by writing rows of the given tables to files, in one or more
deliveries; after each one the stream runs with ``availableNow`` until it has read it,
and the query reads the sink.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ebbflow.operators import clean as B
from ebbflow.operators import events as P
from ebbflow.operators import features as C
from ebbflow.operators import monitor as N
from ebbflow.plans import catalog_events as E
from ebbflow.plans import catalog_ops as ops
from ebbflow.plans import datasets as D
from ebbflow.plans.oracle_base import with_ctes
from ebbflow.plans.oracle_features import on_customers
from ebbflow.session import ensure_checkpoint_dir
from ebbflow.sources import tables
from ebbflow.streaming import streams as Q

# The raw customer table's Yes/No columns that the subscriptions hold as 0/1.
FLAGS = ["Partner", "Dependents", "PhoneService", "OnlineSecurity", "OnlineBackup", "DeviceProtection",
         "TechSupport", "StreamingTV", "StreamingMovies", "PaperlessBilling"]


def _path(spark: SparkSession, tag: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def _run(deliveries: list[DataFrame], build: Callable[[DataFrame], DataFrame], mode: str, handler=Q.batch_sink) -> DataFrame:
    """What the batches of a stream over the deliveries wrote, with ``batch_id``."""
    spark = deliveries[0].sparkSession
    source, sink = _path(spark, "source"), _path(spark, "sink")
    for rows in deliveries:
        rows.write.mode("append").parquet(source)
        stream = Q.read_parquet_stream(spark, source, rows.schema)
        Q.run_available_now(build(stream), sink + "-state", mode, foreach_batch=handler(sink))
    return spark.read.parquet(sink)


# ------------------------------------------------------------------ Q1
def q_score_stream(spark, sf):
    """Raw customer updates, scored with frozen statistics of the whole table."""
    base = D.customers(spark, sf).select(*D.subscriptions(spark, sf).columns)
    stats = C.fit_feature_stats(base)
    out = _run([base.where("customer_id % 2 = 0"), base.where("customer_id % 2 = 1")],
               lambda s: Q.score_stream(s, stats, as_of=ops.AS_OF), "append")
    return out.select(*ops.SCORE_FIELDS)


# ------------------------------------------------------------------ Q2
# limits of a month: a share of its customers is high, so all three levels occur
LIMITS = {"max_high": 18, "max_mrr": 1000.0}


def _predictions(spark, sf, part: int) -> DataFrame:
    return (D.customers(spark, sf).where(f"customer_id % 3 = {part}")
            .select("customer_id", "churn_probability", "monthly_cents", F.col("start_date").alias("event_time")))


def _alert_log(spark, sf) -> DataFrame:
    """Windows of 30 days; the later deliveries reach back into all of them."""
    return _run([_predictions(spark, sf, i) for i in range(3)],
                lambda s: Q.alerts_stream(s, watermark="10000 days", window="30 days", high=0.3), "update")


def q_alerts_stream(spark, sf):
    windows = Q.latest(_alert_log(spark, sf), ["window_start", "window_end"])
    return N.alert_rows(windows, **LIMITS).select("window_start", "window_end", "level", "message", "high_risk", "mrr_at_risk")


def q_alert_transitions(spark, sf):
    """The n-th change of a window's level."""
    changes = Q.level_transitions(_alert_log(spark, sf), **LIMITS)
    nth = F.row_number().over(Window.partitionBy("window_start").orderBy("batch_id")).cast("long")
    return changes.select("window_start", "previous_level", "level", nth.alias("change"))


_WINDOWS = """
w AS (
  SELECT *, time_bucket(INTERVAL 30 DAY, start_date, TIMESTAMP '1970-01-01') AS window_start, customer_id % 3 AS b FROM customers)"""
SQL_ALERTS_STREAM = on_customers("""
SELECT window_start, window_start + INTERVAL 30 DAY AS window_end, level, message, high_risk, mrr_at_risk FROM (
  SELECT *, 'HIGH' AS level, printf('%d customers at high churn risk', high_risk) AS message FROM a WHERE high_risk > 18
  UNION ALL SELECT *, 'WARNING', printf('$%.2f/month MRR at risk', mrr_at_risk) FROM a WHERE mrr_at_risk > 1000
  UNION ALL SELECT *, 'OK', 'No critical alerts' FROM a WHERE NOT (high_risk > 18 OR mrr_at_risk > 1000))""", _WINDOWS, """
a AS (
  SELECT window_start, CAST(SUM(CAST(churn_probability >= 0.3 AS INTEGER)) AS BIGINT) AS high_risk,
         CAST(SUM(CASE WHEN churn_probability >= 0.3 THEN monthly_cents ELSE 0 END) AS DOUBLE) / 100 AS mrr_at_risk
  FROM w GROUP BY window_start)""")
SQL_ALERT_TRANSITIONS = on_customers("""
SELECT window_start, previous_level, level, row_number() OVER (PARTITION BY window_start ORDER BY b) AS change
FROM (SELECT *, lag(level) OVER (PARTITION BY window_start ORDER BY b) AS previous_level FROM l)
WHERE level IS DISTINCT FROM previous_level""", _WINDOWS, """
l AS (
  SELECT window_start, b, CASE WHEN SUM(hr) OVER upto > 18 THEN 'HIGH' WHEN SUM(c) OVER upto > 100000 THEN 'WARNING' ELSE 'OK' END AS level
  FROM (SELECT window_start, b, SUM(CAST(churn_probability >= 0.3 AS INTEGER)) AS hr,
               SUM(CASE WHEN churn_probability >= 0.3 THEN monthly_cents ELSE 0 END) AS c
        FROM w GROUP BY window_start, b)
  WINDOW upto AS (PARTITION BY window_start ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""")


# ------------------------------------------------------------------ Q3–Q5
def _event_deliveries(spark, sf) -> list[DataFrame]:
    ev = D.events(spark, sf)
    return [ev.where("event_id % 2 = 0"), ev.where("event_id % 2 = 1")]


def q_activity_stream(spark, sf):
    log = _run(_event_deliveries(spark, sf), lambda s: Q.activity_stream(s, watermark="400 days"), "update")
    return Q.latest(log, ["user_id", "window_start", "window_end"])


def q_session_stream(spark, sf):
    """Sessions of all events so far after each batch; the last batch's are read."""
    log = _run(_event_deliveries(spark, sf), lambda s: Q.session_stream(s, watermark="400 days"), "complete")
    last = log.agg(F.max("batch_id").alias("last"))
    return log.join(F.broadcast(last), F.col("batch_id") == F.col("last")).select("user_id", "session_start", "session_end", "events")


def _redelivered(spark, sf) -> list[DataFrame]:
    """All events, then every seventh again."""
    ev = D.events(spark, sf)
    return [ev, ev.where("event_id % 7 = 0")]


def q_dedupe_events(spark, sf):
    first, again = _redelivered(spark, sf)
    return P.dedupe_events(first.unionByName(again))


def q_dedupe_stream(spark, sf):
    log = _run(_redelivered(spark, sf), lambda s: Q.dedupe_events(s, watermark="400 days"), "append")
    return log.drop("batch_id")


SQL_EVENTS = "SELECT DISTINCT event_id, ts, user_id, event_type, value, props FROM events"


# ------------------------------------------------------------------ Q6
def q_drift_stream(spark, sf):
    tagged = ops._tagged(spark, sf)
    frozen = N.reference_histogram(tagged.where("window = 'reference'"), ops.DRIFT_FEATURES, _path(spark, "reference"))
    current = tagged.where("window = 'current'").select("customer_id", *ops.DRIFT_FEATURES)
    log = _run([current], lambda s: s, "append", lambda out: Q.drift_stream_handler(frozen, ops.DRIFT_FEATURES, out, min_values=10))
    return log.select("feature", *[F.round(c, 6).alias(c) for c in ("ref_mean", "cur_mean", "mean_shift_sigma")],
                      "ks_statistic", "n_ref", "n_cur")


# ------------------------------------------------------------------ A1, A2, A4, A6, A8, A9
def q_read_customers(spark, sf):
    """Subscriptions written as raw customer files, read back under the fixed schema, coerced and encoded."""
    s, path = D.subscriptions(spark, sf), _path(spark, "raw")
    yes = lambda c: F.when(F.col(c) == 1, "Yes").otherwise("No")
    raw = {"customerID": F.col("customer_id").cast("string"), "MultipleLines": F.lit("No"), "Churn": yes("Churn_binary"),
           "TotalCharges": F.coalesce(F.col("TotalCharges").cast("string"), F.lit(" "))} | {c: yes(c) for c in FLAGS}
    columns = [raw.get(f.name, F.col(f.name)).alias(f.name) for f in tables.TELCO_SCHEMA.fields]
    s.select(*columns).write.option("header", True).csv(path)
    back = B.coerce_numeric(tables.read_customers(spark, f"{path}/*.csv"), ["TotalCharges"])
    return B.binary_target(B.encode_yes_no(back, FLAGS)).select(
        F.col("customerID").cast("long").alias("customer_id"), "tenure", "Contract", "PaymentMethod", "MonthlyCharges", "TotalCharges",
        "SeniorCitizen", *FLAGS, "Churn_binary")


SQL_READ_CUSTOMERS = with_ctes(body=f"""
SELECT customer_id, tenure, Contract, PaymentMethod, MonthlyCharges, TotalCharges, SeniorCitizen, {', '.join(FLAGS)}, Churn_binary
FROM subscriptions""")

_STORED = ["customer_id", "Contract", "tenure", "monthly_cents", "service_adoption_score", "Churn_binary"]


def _store(spark, sf) -> DataFrame:
    return D.customers(spark, sf).select(*_STORED)


def q_register_csv(spark, sf):
    path = _path(spark, "csv")
    tables.write_feature_store(_store(spark, sf), path, fmt="csv")
    tables.register_csv(spark, "ebbflow_csv", path)
    return spark.sql(f"SELECT {', '.join(_STORED)} FROM ebbflow_csv WHERE tenure >= 12")


def q_feature_store(spark, sf):
    """Written by contract; the filter reads one partition's files only."""
    path = _path(spark, "store")
    tables.write_feature_store(_store(spark, sf), path, partition_by=["Contract"])
    return spark.read.parquet(path).where("Contract = 'One year'").select(*_STORED)


def q_bucketed_join(spark, sf):
    """Two tables bucketed on the key: their join needs no exchange."""
    tag = uuid.uuid4().hex[:8]
    c = D.customers(spark, sf)
    tables.save_table(c.select("customer_id", "Contract", "tenure"), f"ebbflow_terms_{tag}", bucket_by="customer_id", buckets=8)
    tables.save_table(c.select("customer_id", "monthly_cents"), f"ebbflow_charges_{tag}", bucket_by="customer_id", buckets=8)
    joined = spark.table(f"ebbflow_terms_{tag}").hint("merge").join(spark.table(f"ebbflow_charges_{tag}"), "customer_id")
    return joined.select("customer_id", "Contract", "tenure", "monthly_cents")


def q_write_results(spark, sf):
    path = _path(spark, "results")
    by = D.customers(spark, sf).groupBy("Contract").agg(F.count(F.lit(1)).alias("customers"), F.sum("monthly_cents").alias("cents"))
    tables.write_results({"contracts": by}, path)
    kinds = "Contract string, customers long, cents long"
    json, csv = spark.read.schema(kinds).json(f"{path}/contracts.json"), spark.read.schema(kinds).option("header", True).csv(f"{path}/contracts.csv")
    return json.withColumn("format", F.lit("json")).unionByName(csv.withColumn("format", F.lit("csv")))


def q_read_macro(spark, sf):
    """Signals derived from the tables, written as one JSON object, read back and completed."""
    from ebbflow.plans.catalog_clean import _macro
    path = _path(spark, "macro")
    _macro(spark, sf).coalesce(1).write.json(path)
    return C.derive_macro(tables.read_macro(spark, path)).select(
        "macro_inflation", "trend_churn_intent", *[F.round(c, 6).alias(c) for c in ("macro_gdp_growth", "macro_stress_index", "macro_consumer_pressure")])


_LIST = ", ".join(_STORED)
QUERIES = {
    "score_stream": (q_score_stream, ops.SQL_SCORE_FIELDS),
    "alerts_stream": (q_alerts_stream, SQL_ALERTS_STREAM),
    "alert_transitions": (q_alert_transitions, SQL_ALERT_TRANSITIONS),
    "activity_stream": (q_activity_stream, E.SQL["activity_windows_sliding"]),
    "session_stream": (q_session_stream, E.SQL["user_sessions"]),
    "dedupe_events": (q_dedupe_events, SQL_EVENTS),
    "dedupe_stream": (q_dedupe_stream, SQL_EVENTS),
    "drift_stream": (q_drift_stream, ops.SQL_DRIFT),
    "read_customers": (q_read_customers, SQL_READ_CUSTOMERS),
    "register_csv": (q_register_csv, on_customers(f"SELECT {_LIST} FROM customers WHERE tenure >= 12")),
    "feature_store": (q_feature_store, on_customers(f"SELECT {_LIST} FROM customers WHERE Contract = 'One year'")),
    "bucketed_join": (q_bucketed_join, on_customers("SELECT customer_id, Contract, tenure, monthly_cents FROM customers")),
    "write_results": (q_write_results, on_customers("""
SELECT Contract, COUNT(*) AS customers, CAST(SUM(monthly_cents) AS BIGINT) AS cents, format
FROM customers, (VALUES ('json'), ('csv')) f(format) GROUP BY Contract, format""")),
    "read_macro": (q_read_macro, """
SELECT infl AS macro_inflation, 50.0::DOUBLE AS trend_churn_intent, round(gdp, 6) AS macro_gdp_growth,
       round(infl + 3.8::DOUBLE - gdp, 6) AS macro_stress_index, round(infl * 3.8::DOUBLE, 6) AS macro_consumer_pressure
FROM (SELECT CAST(SUM(CAST(round(c_acctbal * 100) AS BIGINT)) AS DOUBLE) / (COUNT(*) * 100000) AS gdp FROM customer),
     (SELECT CAST(COUNT(DISTINCT o_orderpriority) AS DOUBLE) AS infl FROM orders)"""),
}
