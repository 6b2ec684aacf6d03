"""Sources/sinks round trips (A2, A4, A6, A8, A9, K19), macro enrichment
and the remaining streaming forms (Q2, Q6)."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from paths import SF_SMALL
from ebbflow.operators import features, models, monitor
from ebbflow.plans import datasets
from ebbflow.sources import tables
from ebbflow.streaming import streams


def test_writers_and_readers_round_trip(spark):
    d = tempfile.mkdtemp(prefix="io-")
    cust = datasets.customers(spark, SF_SMALL).select("customer_id", "Contract", "tenure")
    tables.write_feature_store(cust, os.path.join(d, "fs_parquet"))
    tables.write_feature_store(cust, os.path.join(d, "fs_csv"), fmt="csv")
    tables.write_feature_store(cust, os.path.join(d, "fs_part"), partition_by=["Contract"])
    assert spark.read.parquet(os.path.join(d, "fs_parquet")).count() == cust.count()
    assert spark.read.parquet(os.path.join(d, "fs_part")).select("Contract").distinct().count() == 3
    csv = tables.register_csv(spark, "fs_csv_view", os.path.join(d, "fs_csv"))
    assert spark.sql("SELECT COUNT(*) AS n FROM fs_csv_view").first().n == cust.count()
    assert dict(csv.dtypes)["tenure"] == "int"
    tables.write_results({"q1": cust.groupBy("Contract").count()}, os.path.join(d, "results"))
    assert spark.read.json(os.path.join(d, "results", "q1.json")).count() == 3
    tables.register(cust, "cust_view")
    assert tables.table_counts(spark, ["cust_view"]).first().row_count == cust.count()


def test_save_table(spark):
    cust = datasets.customers(spark, SF_SMALL).select("customer_id", "Contract")
    tables.save_table(cust, "ebbflow_saved_customers", bucket_by="customer_id", buckets=4)
    assert spark.table("ebbflow_saved_customers").count() == cust.count()
    spark.sql("DROP TABLE IF EXISTS ebbflow_saved_customers")


def test_macro_read_and_enrich(spark):
    d = tempfile.mkdtemp(prefix="macro-")
    path = os.path.join(d, "macro_signals.json")
    with open(path, "w") as f:
        json.dump({"macro_gdp_growth": 2.793, "macro_inflation": 2.95,
                   "macro_unemployment": 4.198, "trend_churn_intent": 61.0}, f, indent=2)
    macro = features.derive_macro(tables.read_macro(spark, path))
    cust = datasets.customers(spark, SF_SMALL).select("customer_id")
    out = features.add_macro(cust, macro)
    assert out.count() == cust.count()
    r = out.select("macro_stress_index", "trend_churn_intent", "trend_switch_carrier").distinct().collect()
    assert len(r) == 1 and abs(r[0].macro_stress_index - 4.355) < 1e-12
    assert r[0].trend_churn_intent == 61.0 and r[0].trend_switch_carrier == 50.0


def test_model_save_load(spark):
    cust = datasets.customers(spark, SF_SMALL)
    feats = ["tenure", "MonthlyCharges"]
    m = models.train_logistic(cust, feats, max_iter=20)
    d = tempfile.mkdtemp(prefix="model-")
    models.save_model(m, os.path.join(d, "m"))
    m2 = models.load_model(os.path.join(d, "m"))
    a = models.predict(m, cust.select("customer_id", *feats)).select("churn_probability").collect()
    b = models.predict(m2, cust.select("customer_id", *feats)).select("churn_probability").collect()
    assert a == b


def test_alerts_stream(spark):
    cust = datasets.customers(spark, SF_SMALL)
    preds = cust.select("customer_id", "churn_probability", "monthly_cents",
                        F.col("start_date").alias("event_time"))
    d = tempfile.mkdtemp(prefix="alert-stream-")
    preds.write.parquet(os.path.join(d, "in"))
    st = spark.readStream.schema(preds.schema).parquet(os.path.join(d, "in"))
    q = (streams.alerts_stream(st, watermark="10000 days").writeStream.outputMode("complete")
         .format("memory").queryName("q2_alerts").trigger(availableNow=True).start())
    q.awaitTermination()
    got = spark.table("q2_alerts").agg(F.sum("high_risk")).first()[0]
    assert got == preds.where(F.col("churn_probability") >= 0.6).count()



def test_drift_stream_reads_the_reference_once_and_replays_change_nothing(spark):
    cust, cols = datasets.customers(spark, SF_SMALL), ["tenure", "MonthlyCharges", "TotalCharges"]
    ref, cur = cust.where("customer_id % 2 = 0"), cust.where("customer_id % 2 = 1").select("customer_id", *cols)
    d = tempfile.mkdtemp(prefix="drift-")
    frozen = monitor.reference_histogram(ref, cols, os.path.join(d, "reference"))
    assert all("reference" in f for f in frozen.inputFiles())
    handler = streams.drift_stream_handler(frozen, cols, os.path.join(d, "out"))
    parts = [cur.where(f"customer_id % 4 = {k}") for k in (1, 3)]
    for part in parts:  # each delivery is a batch
        part.write.mode("append").parquet(os.path.join(d, "in"))
        stream = streams.read_parquet_stream(spark, os.path.join(d, "in"), cur.schema)
        streams.run_available_now(stream, os.path.join(d, "sink"), foreach_batch=handler)
    read = lambda: sorted(map(tuple, spark.read.parquet(os.path.join(d, "out")).select(
        "batch_id", "feature", "n_ref", "n_cur", "ks_statistic", F.round("mean_shift_sigma", 9)).collect()))
    got = read()
    want = []
    for i, part in enumerate(parts):
        tagged = ref.select(*cols).withColumn("window", F.lit("reference")).unionByName(part.select(*cols).withColumn("window", F.lit("current")))
        want += [(i, *r) for r in monitor.drift_statistics(tagged, cols, min_values=1).select(
            "feature", "n_ref", "n_cur", "ks_statistic", F.round("mean_shift_sigma", 9)).collect()]
    assert got == sorted(want)
    handler(parts[1], 1)  # the batch is replayed after a failure
    assert read() == got


def test_late_rows_change_the_level_of_a_window(spark):
    """A window's level rises with late rows; rows behind the watermark change nothing."""
    d = tempfile.mkdtemp(prefix="levels-")
    rows = lambda day, n: [(f"2024-03-{day:02d} 10:00:00", 0.9, 1000)] * n
    deliveries = [rows(1, 2) + rows(2, 1), rows(1, 3) + rows(9, 1), rows(1, 50) + rows(9, 5)]
    schema = "event_time string, churn_probability double, monthly_cents long"
    for i, some in enumerate(deliveries):
        df = spark.createDataFrame(some, schema).withColumn("event_time", F.col("event_time").cast("timestamp_ntz"))
        df.write.mode("append").parquet(os.path.join(d, "in"))
        stream = streams.read_parquet_stream(spark, os.path.join(d, "in"), df.schema)
        streams.run_available_now(streams.alerts_stream(stream, watermark="2 days"), os.path.join(d, "sink"), "update",
                                  foreach_batch=streams.batch_sink(os.path.join(d, "out")))
    log = spark.read.parquet(os.path.join(d, "out"))
    changes = streams.level_transitions(log, max_high=4, max_mrr=15.0).collect()
    by_day = {}
    for r in sorted(changes, key=lambda r: r.batch_id):
        by_day.setdefault(r.window_start.day, []).append((r.previous_level, r.level))
    assert by_day == {1: [(None, "WARNING"), ("WARNING", "HIGH")], 2: [(None, "OK")], 9: [(None, "OK"), ("OK", "HIGH")]}
    last = {r.window_start.day: r.high_risk for r in streams.latest(log, ["window_start", "window_end"]).collect()}
    assert last == {1: 5, 2: 1, 9: 6}
