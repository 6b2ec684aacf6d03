"""Structured Streaming forms (inventory Q1–Q6).

Each function takes a streaming DataFrame (``spark.readStream...``) and returns
the transformed streaming DataFrame; ``run_available_now`` drives one with
``trigger(availableNow=True)`` into a parquet sink under the session's
checkpoint dir, so the same code runs incrementally on a cluster and to
completion in tests. Stateful operators carry a watermark, so state is bounded.
"""

from __future__ import annotations

import os
import uuid
from typing import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbflow.operators import monitor, scoring
from ebbflow.session import ensure_checkpoint_dir


def _event_time(df: DataFrame, ts: str) -> tuple[DataFrame, bool]:
    """Watermarks need TIMESTAMP; an NTZ event time is read as a session-zone
    instant. Returns the frame and whether outputs should be cast back to NTZ."""
    if dict(df.dtypes).get(ts) == "timestamp_ntz":
        return df.withColumn(ts, F.col(ts).cast("timestamp")), True
    return df, False


def _out_time(c: F.Column, ntz: bool) -> F.Column:
    return c.cast("timestamp_ntz") if ntz else c


def read_parquet_stream(spark: SparkSession, path: str, schema: T.StructType,
                        max_files: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(path)


def score_stream(updates: DataFrame, stats: DataFrame,
                 scorer: Callable[[DataFrame], DataFrame] = scoring.stand_in_scorer,
                 as_of: str = "1970-01-01 00:00:00") -> DataFrame:
    """Q1: stateless scoring of a customer-update stream with frozen training
    statistics (a one-row static frame, broadcast to every micro-batch)."""
    return scoring.score_customers(updates, scorer=scorer, stats=stats, as_of=as_of)


def alerts_stream(preds: DataFrame, ts: str = "event_time", p: str = "churn_probability",
                  cents: str = "monthly_cents", watermark: str = "1 day",
                  window: str = "1 day", high: float = 0.6) -> DataFrame:
    """Q2: per tumbling event-time window, high-risk count and MRR at risk. In update mode each
    batch gives the windows it changed, late rows included until the watermark has passed them;
    ``monitor.alert_rows`` gives their alerts, ``level_transitions`` what changed."""
    preds, ntz = _event_time(preds, ts)
    return (preds.withWatermark(ts, watermark)
            .groupBy(F.window(F.col(ts), window).alias("w")).agg(*monitor.risk_totals(p, cents, high))
            .select(_out_time(F.col("w.start"), ntz).alias("window_start"),
                    _out_time(F.col("w.end"), ntz).alias("window_end"), "high_risk", "mrr_at_risk"))


def level_transitions(log: DataFrame, max_high: int = 100, max_mrr: float = 5000.0) -> DataFrame:
    """Q2: when the worst level of a window changed, from the log of ``alerts_stream``'s batches:
    (window_start, window_end, batch_id, previous_level, level); the first level of a window counts
    as a change from null."""
    rank = F.when(F.col("level") == "HIGH", 2).when(F.col("level") == "WARNING", 1).otherwise(0)
    worst = (monitor.alert_rows(log, max_high, max_mrr).groupBy("window_start", "window_end", "batch_id")
             .agg(F.max_by("level", rank).alias("level")))
    before = F.lag("level").over(Window.partitionBy("window_start", "window_end").orderBy("batch_id"))
    return worst.withColumn("previous_level", before).where(~F.col("level").eqNullSafe(F.col("previous_level")))


def activity_stream(events: DataFrame, duration: str = "7 days", slide: str = "1 day",
                    watermark: str = "1 day", user: str = "user_id", ts: str = "ts",
                    value: str = "value") -> DataFrame:
    """Q3: sliding per-user event counts and value under a watermark."""
    events, ntz = _event_time(events, ts)
    return (events.withWatermark(ts, watermark)
            .groupBy(user, F.window(F.col(ts), duration, slide).alias("w"))
            .agg(F.count(F.lit(1)).alias("events"),
                 F.sum(F.round(F.col(value) * 100).cast("long")).alias("_c"))
            .select(user, _out_time(F.col("w.start"), ntz).alias("window_start"),
                    _out_time(F.col("w.end"), ntz).alias("window_end"),
                    "events", (F.col("_c").cast("double") / 100).alias("value")))


def session_stream(events: DataFrame, gap: str = "30 minutes", watermark: str = "1 hour",
                   user: str = "user_id", ts: str = "ts") -> DataFrame:
    """Q4: per-user sessions by inactivity gap (session windows + watermark)."""
    events, ntz = _event_time(events, ts)
    return (events.withWatermark(ts, watermark)
            .groupBy(user, F.session_window(F.col(ts), gap).alias("s"))
            .agg(F.count(F.lit(1)).alias("events"))
            .select(user, _out_time(F.col("s.start"), ntz).alias("session_start"),
                    _out_time(F.col("s.end"), ntz).alias("session_end"), "events"))


def dedupe_events(events: DataFrame, key: str = "event_id", ts: str = "ts",
                  watermark: str = "1 hour") -> DataFrame:
    """Q5: drop re-delivered events by id within the watermark."""
    events, ntz = _event_time(events, ts)
    out = events.withWatermark(ts, watermark).dropDuplicatesWithinWatermark([key])
    return out.withColumn(ts, _out_time(F.col(ts), ntz))


def drift_stream_handler(reference: DataFrame, cols: list[str], out_path: str, min_values: int = 1
                         ) -> Callable[[DataFrame, int], None]:
    """Q6: ``foreachBatch`` body — N1 statistics of each micro-batch against a frozen
    ``monitor.reference_histogram``, by batch in ``batch_sink``."""
    return batch_sink(out_path, lambda batch: monitor.drift_against(reference, batch, cols, min_values))


def batch_sink(out_path: str, transform: Callable[[DataFrame], DataFrame] = lambda batch: batch
               ) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` body: each batch replaces its own folder ``batch_id=…`` of a Parquet table,
    so that a batch that is replayed after a failure changes nothing."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{out_path}/batch_id={batch_id}")
    return handle


def latest(log: DataFrame, keys: list[str]) -> DataFrame:
    """The last version of each key in the batches of an update-mode ``batch_sink``."""
    rest = [c for c in log.columns if c not in (*keys, "batch_id")]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("_r")).select(*keys, "_r.*")


def run_available_now(stream: DataFrame, sink_dir: str | None = None, output_mode: str = "append",
                      name: str | None = None, foreach_batch=None) -> str:
    """Run a streaming DataFrame to completion over what is available now and
    return the parquet sink path (checkpoint kept next to it)."""
    spark = stream.sparkSession
    base = ensure_checkpoint_dir(spark)
    tag = name or uuid.uuid4().hex[:8]
    sink_dir = sink_dir or os.path.join(base, f"stream-{tag}")
    w = (stream.writeStream.outputMode(output_mode)
         .option("checkpointLocation", os.path.join(sink_dir + "-ckpt"))
         .trigger(availableNow=True))
    if foreach_batch is not None:
        q = w.foreachBatch(foreach_batch).start()  # the sink is where the body writes
    else:
        q = w.format("parquet").option("path", sink_dir).start()
    q.awaitTermination()
    return sink_dir
