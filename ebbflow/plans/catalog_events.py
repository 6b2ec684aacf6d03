"""Registered event-log queries (P1–P6 and the batch forms of Q3, Q4) with oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ebbflow.operators import events as P
from ebbflow.plans import datasets as D


def _e(fn):
    return lambda spark, sf: fn(D.events(spark, sf))


REF = "(SELECT max(ts) FROM events)"

SQL = {}
SQL["engagement_velocity"] = f"""
SELECT user_id, recent_events, prior_events, recent_events - prior_events AS velocity,
       recent_events / CAST(NULLIF(prior_events, 0) AS DOUBLE) AS velocity_ratio
FROM (SELECT user_id,
        CAST(SUM(CAST(ts > {REF} - INTERVAL 7 DAY AS INTEGER)) AS BIGINT) AS recent_events,
        CAST(SUM(CAST(ts > {REF} - INTERVAL 7 DAY - INTERVAL 7 DAY
                      AND NOT (ts > {REF} - INTERVAL 7 DAY) AS INTEGER)) AS BIGINT) AS prior_events
      FROM events GROUP BY user_id)"""

SQL["adoption_breadth"] = """
SELECT user_id, COUNT(DISTINCT event_type) AS distinct_event_types, COUNT(*) AS events
FROM events GROUP BY user_id"""

SQL["revenue_volatility"] = """
SELECT user_id, weeks, round(mean_weekly_value, 9) AS mean_weekly_value,
       round(std_weekly_value, 9) AS std_weekly_value,
       round(std_weekly_value / NULLIF(mean_weekly_value, 0.0), 9) AS revenue_volatility
FROM (SELECT user_id, COUNT(*) AS weeks, avg(c) / 100 AS mean_weekly_value,
             stddev_samp(c) / 100 AS std_weekly_value
      FROM (SELECT user_id, date_trunc('week', ts) AS week, SUM(CAST(round(value * 100) AS BIGINT)) AS c
            FROM events WHERE event_type = 'purchase' GROUP BY 1, 2)
      GROUP BY user_id)"""


def q_volatility(spark, sf):
    v = P.revenue_volatility(D.events(spark, sf))
    return v.select("user_id", "weeks", *[F.round(c, 9).alias(c) for c in
                                          ("mean_weekly_value", "std_weekly_value",
                                           "revenue_volatility")])


SQL["ticket_spike"] = """
SELECT user_id, day, errors, trailing_mean,
       errors >= 2 AND errors > trailing_mean * 2.0::DOUBLE AS spike
FROM (SELECT user_id, day, errors,
        coalesce(SUM(errors) OVER (PARTITION BY user_id ORDER BY day
                                   RANGE BETWEEN 7 PRECEDING AND 1 PRECEDING), 0) / 7.0::DOUBLE AS trailing_mean
      FROM (SELECT user_id, CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS INTEGER) AS day,
                   COUNT(*) AS errors
            FROM events WHERE event_type = 'error' GROUP BY 1, 2))"""

SQL["cohort_retention_matrix"] = """
WITH wk AS (SELECT DISTINCT user_id, CAST(date_trunc('week', ts) AS DATE) AS week FROM events),
first AS (SELECT user_id, min(week) AS cohort_week FROM wk GROUP BY user_id),
act AS (SELECT f.cohort_week, CAST(date_diff('day', f.cohort_week, w.week) / 7 AS INTEGER) AS week_offset,
               COUNT(*) AS active_users
        FROM wk w JOIN first f ON w.user_id = f.user_id GROUP BY 1, 2),
size AS (SELECT cohort_week, COUNT(*) AS cohort_size FROM first GROUP BY 1)
SELECT a.cohort_week, a.week_offset, a.active_users, s.cohort_size,
       CAST(a.active_users * 100 AS DOUBLE) / s.cohort_size AS retention_pct
FROM act a JOIN size s ON a.cohort_week = s.cohort_week"""

SQL["recency_frequency"] = f"""
SELECT user_id, CAST(date_diff('day', CAST(max(ts) AS DATE), CAST({REF} AS DATE)) AS INTEGER) AS recency_days,
  CAST(SUM(CAST(ts > {REF} - INTERVAL 30 DAY AS INTEGER)) AS BIGINT) AS frequency,
  CAST(SUM(CASE WHEN event_type = 'purchase' THEN CAST(round(value * 100) AS BIGINT) ELSE 0 END) AS DOUBLE)
    / 100 AS monetary
FROM events GROUP BY user_id"""

SQL["activity_windows_daily"] = """
SELECT user_id, date_trunc('day', ts) AS window_start, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end,
       COUNT(*) AS events, CAST(SUM(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / 100 AS value
FROM events GROUP BY 1, 2, 3"""

SQL["activity_windows_sliding"] = """
SELECT user_id, window_start, window_start + INTERVAL 7 DAY AS window_end, COUNT(*) AS events,
       CAST(SUM(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / 100 AS value
FROM (SELECT user_id, value, date_trunc('day', ts) - to_days(k) AS window_start
      FROM events, range(0, 7) r(k))
GROUP BY 1, 2"""

SQL["user_sessions"] = """
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, COUNT(*) AS events
FROM (SELECT *, SUM(new_s) OVER (PARTITION BY user_id ORDER BY ts, event_id
                                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sid
      FROM (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL
                             OR ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)
                                      + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new_s
            FROM events))
GROUP BY user_id, sid"""

QUERIES = {
    "engagement_velocity": (_e(P.engagement_velocity), SQL["engagement_velocity"]),
    "adoption_breadth": (_e(P.adoption_breadth), SQL["adoption_breadth"]),
    "revenue_volatility": (q_volatility, SQL["revenue_volatility"]),
    "ticket_spike": (_e(P.ticket_spike), SQL["ticket_spike"]),
    "cohort_retention_matrix": (_e(P.cohort_retention_matrix), SQL["cohort_retention_matrix"]),
    "recency_frequency": (_e(P.recency_frequency), SQL["recency_frequency"]),
    "activity_windows_daily": (_e(P.activity_windows), SQL["activity_windows_daily"]),
    "activity_windows_sliding": (_e(lambda e: P.activity_windows(e, "7 days", "1 day")),
                                 SQL["activity_windows_sliding"]),
    "user_sessions": (_e(P.user_sessions), SQL["user_sessions"]),
}
