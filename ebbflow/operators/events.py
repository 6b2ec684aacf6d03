"""Behavioural signals over the event log (inventory P1–P6).

All are per-user grouped aggregations with partial (map-side) aggregation, so a
hot user only adds partial-aggregate rows, never a single huge task. The
reference instant is the log's latest timestamp (one broadcast row).
Money (event value) is summed as integer cents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ebbflow.functions.columns import attach, flag


def _ref(ev: DataFrame, ts: str) -> DataFrame:
    return ev.agg(F.max(ts).alias("_ref"))


def _cents(value: str) -> F.Column:
    return F.round(F.col(value) * 100).cast("long")


def engagement_velocity(ev: DataFrame, user: str = "user_id", ts: str = "ts",
                        window_days: int = 7) -> DataFrame:
    """Events in the last w days minus events in the w days before, and
    their ratio (null when the earlier window is empty)."""
    w = F.expr(f"INTERVAL {window_days} DAYS")
    j = ev.select(user, ts).transform(attach, _ref(ev, ts))
    recent = F.col(ts) > F.col("_ref") - w
    prior = (F.col(ts) > F.col("_ref") - w - w) & ~recent
    g = j.groupBy(user).agg(F.sum(flag(recent)).cast("long").alias("recent_events"),
                            F.sum(flag(prior)).cast("long").alias("prior_events"))
    return g.select(user, "recent_events", "prior_events",
                    (F.col("recent_events") - F.col("prior_events")).alias("velocity"),
                    (F.col("recent_events") / F.nullif(F.col("prior_events"), F.lit(0)).cast("double"))
                    .alias("velocity_ratio"))


def adoption_breadth(ev: DataFrame, user: str = "user_id", kind: str = "event_type") -> DataFrame:
    """Distinct event types and events per user."""
    return ev.groupBy(user).agg(F.countDistinct(kind).alias("distinct_event_types"),
                                F.count(F.lit(1)).alias("events"))


def revenue_volatility(ev: DataFrame, user: str = "user_id", ts: str = "ts",
                       value: str = "value", kind: str = "event_type",
                       purchase: str = "purchase") -> DataFrame:
    """Coefficient of variation (sample std / mean) of weekly purchase value
    per user, over weeks with purchases."""
    weekly = (ev.where(F.col(kind) == purchase)
              .groupBy(user, F.date_trunc("week", F.col(ts)).alias("week"))
              .agg(F.sum(_cents(value)).alias("_c")))
    g = weekly.groupBy(user).agg(F.count(F.lit(1)).alias("weeks"),
                                 (F.avg("_c") / 100).alias("mean_weekly_value"),
                                 (F.stddev_samp("_c") / 100).alias("std_weekly_value"))
    return g.withColumn("revenue_volatility",
                        F.col("std_weekly_value") / F.nullif(F.col("mean_weekly_value"), F.lit(0.0)))


def _day(ts: str) -> F.Column:
    return F.datediff(F.to_date(F.col(ts)), F.lit("1970-01-01").cast("date"))


def ticket_spike(ev: DataFrame, user: str = "user_id", ts: str = "ts", kind: str = "event_type",
                 error: str = "error", k: float = 2.0, trailing_days: int = 7,
                 min_errors: int = 2) -> DataFrame:
    """Per user-day error count vs the mean over the previous
    ``trailing_days`` calendar days (days without errors count as 0); spike when
    count ≥ ``min_errors`` and count > k × trailing mean. The window runs over
    the per-user-day aggregate (≤ one row per day), never over raw events."""
    daily = (ev.where(F.col(kind) == error).groupBy(user, _day(ts).alias("day"))
             .agg(F.count(F.lit(1)).alias("errors")))
    w = Window.partitionBy(user).orderBy("day").rangeBetween(-trailing_days, -1)
    out = daily.withColumn("trailing_mean",
                           F.coalesce(F.sum("errors").over(w), F.lit(0)) / F.lit(float(trailing_days)))
    return out.withColumn("spike", (F.col("errors") >= min_errors)
                          & (F.col("errors") > F.col("trailing_mean") * k))


def cohort_retention_matrix(ev: DataFrame, user: str = "user_id", ts: str = "ts") -> DataFrame:
    """P5: first-seen week × week offset → active users, cohort size and the
    active share (long form; pivot for display)."""
    wk = ev.select(user, F.to_date(F.date_trunc("week", F.col(ts))).alias("week")).distinct()
    first = wk.groupBy(user).agg(F.min("week").alias("cohort_week"))
    j = wk.join(first, user)
    j = j.withColumn("week_offset", (F.datediff("week", "cohort_week") / 7).cast("int"))
    active = j.groupBy("cohort_week", "week_offset").agg(F.count(F.lit(1)).alias("active_users"))
    size = first.groupBy("cohort_week").agg(F.count(F.lit(1)).alias("cohort_size"))
    return (active.join(size, "cohort_week")
            .withColumn("retention_pct", (F.col("active_users") * 100).cast("double")
                        / F.col("cohort_size"))
            .orderBy("cohort_week", "week_offset"))


def recency_frequency(ev: DataFrame, user: str = "user_id", ts: str = "ts", value: str = "value",
                      kind: str = "event_type", purchase: str = "purchase",
                      window_days: int = 30) -> DataFrame:
    """Days since the user's last event (to the log's latest day), events
    in the trailing window and purchase value."""
    j = ev.transform(attach, _ref(ev, ts))
    in_w = F.col(ts) > F.col("_ref") - F.expr(f"INTERVAL {window_days} DAYS")
    g = j.groupBy(user).agg(F.max(ts).alias("last_event"), F.first("_ref").alias("_ref"),
                            F.sum(flag(in_w)).cast("long").alias("frequency"),
                            F.sum(F.when(F.col(kind) == purchase, _cents(value)).otherwise(0))
                            .alias("_c"))
    return g.select(user, F.datediff(F.to_date("_ref"), F.to_date("last_event")).alias("recency_days"),
                    "frequency", (F.col("_c").cast("double") / 100).alias("monetary"))


# ------------------------------------------------------------------ batch windows (Q3, Q4)
def activity_windows(ev: DataFrame, duration: str = "1 day", slide: str | None = None,
                     user: str = "user_id", ts: str = "ts", value: str = "value") -> DataFrame:
    """Q3 batch form: tumbling (or sliding) event-time windows per user."""
    w = F.window(F.col(ts), duration, slide) if slide else F.window(F.col(ts), duration)
    return (ev.groupBy(user, w.alias("w"))
            .agg(F.count(F.lit(1)).alias("events"), F.sum(_cents(value)).alias("_c"))
            .select(user, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    "events", (F.col("_c").cast("double") / 100).alias("value")))


def user_sessions(ev: DataFrame, gap: str = "30 minutes", user: str = "user_id",
                  ts: str = "ts", slice: str = "7 days") -> DataFrame:
    """Q4 batch form: sessions split by an inactivity gap (an event a full gap after the
    one before begins a new session; null times belong to none).

    Events in one bucket of the gap's length are always in one session, so rows are
    first counted per (user, slice of time, bucket), map-side. Partial sessions are
    formed inside (user, slice), and those that reach over a slice's edge are stitched:
    a user's events are never together in one task, only two rows per slice are.
    """
    length = F.expr(f"INTERVAL {gap}")
    buckets = (ev.where(F.col(ts).isNotNull()).select(F.col(user).alias("_u"), F.col(ts).alias("_ts"))
               .withColumn("_bucket", F.window("_ts", gap)["start"]).withColumn("_slice", F.window("_bucket", slice)["start"])
               .groupBy("_u", "_slice", "_bucket")
               .agg(F.min("_ts").alias("_from"), F.max("_ts").alias("_to"), F.count(F.lit(1)).alias("_n")))
    inside = Window.partitionBy("_u", "_slice").orderBy("_bucket")
    before = F.lag("_to").over(inside)
    begins = F.when(before.isNull() | (F.col("_from") >= before + length), 1).otherwise(0)
    partial = (buckets.withColumn("_begins", begins)
               .withColumn("_part", F.sum("_begins").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
               .groupBy("_u", "_slice", "_part").agg(F.min("_from").alias("_from"), F.max("_to").alias("_to"), F.sum("_n").alias("_n"))
               .withColumn("_last", F.max("_part").over(Window.partitionBy("_u", "_slice"))))
    done = ["_u", "_from", "_to", "_n"]
    inner = partial.where((F.col("_part") > 1) & (F.col("_part") < F.col("_last"))).select(*done)
    edges = partial.where((F.col("_part") == 1) | (F.col("_part") == F.col("_last")))
    along = Window.partitionBy("_u").orderBy("_slice", "_part")
    reached = F.lag("_to").over(along)
    fresh = F.when(reached.isNull() | (F.col("_from") >= reached + length), 1).otherwise(0)
    stitched = (edges.withColumn("_fresh", fresh)
                .withColumn("_s", F.sum("_fresh").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
                .groupBy("_u", "_s").agg(F.min("_from").alias("_from"), F.max("_to").alias("_to"), F.sum("_n").alias("_n")))
    return inner.unionByName(stitched.select(*done)).select(
        F.col("_u").alias(user), F.col("_from").alias("session_start"), (F.col("_to") + length).alias("session_end"), F.col("_n").alias("events"))


def dedupe_events(ev: DataFrame, key: str = "event_id", ts: str = "ts") -> DataFrame:
    """Q5 batch form: one row per id, the earliest delivery (ties: the least row in column order);
    rows without an id are kept."""
    rest = [c for c in ev.columns if c not in (key, ts)]
    first = (ev.where(F.col(key).isNotNull()).groupBy(key)
             .agg(F.min(F.struct(ts, *rest)).alias("_e")).select(key, "_e.*").select(*ev.columns))
    return first.unionByName(ev.where(F.col(key).isNull()))
