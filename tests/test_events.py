"""Sessions and deduplication of the event log against plain loops."""

import datetime as dt
import random

import pytest

from ebbflow.operators import events

SCHEMA = "event_id long, user_id long, ts timestamp_ntz"


def plain_sessions(rows, gap):
    by_user, out = {}, []
    for _, u, ts in rows:
        if ts is not None:
            by_user.setdefault(u, []).append(ts)
    for u, times in by_user.items():
        times.sort()
        first, last, n = times[0], times[0], 0
        for t in times:
            if t >= last + gap:
                out.append((u, first, last + gap, n))
                first, n = t, 0
            last, n = t, n + 1
        out.append((u, first, last + gap, n))
    return out


@pytest.mark.parametrize("minutes,slice", [(30, "7 days"), (30, "40 minutes"), (1, "3 minutes"), (600, "1 hour")])
def test_sessions_equal_the_plain_loop(spark, minutes, slice):
    """One user holds half of the events, sessions reach over many slices, gaps are met exactly."""
    rng = random.Random(minutes)
    start = dt.datetime(2024, 1, 1)
    gap = dt.timedelta(minutes=minutes)
    rows = [(i, rng.choice([7, 7, 7, 1, 2, None]), start + rng.choice([1, 2, 3]) * rng.randint(0, 300) * gap / 4) for i in range(900)]
    rows += [(901, 3, None), (902, 3, start), (903, 3, start + gap), (904, 3, start + gap), (905, 5, start - dt.timedelta(days=20000))]
    got = events.user_sessions(spark.createDataFrame(rows, SCHEMA), f"{minutes} minutes", slice=slice)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, plain_sessions(rows, gap)))
    assert events.user_sessions(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_hot_user_is_spread_over_tasks(spark):
    start = dt.datetime(2024, 1, 1)
    df = spark.range(20000).selectExpr("id AS event_id", "pmod(id, 1) AS user_id", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id * 500) AS ts")
    got = events.user_sessions(df, "5 minutes", slice="1 day")
    assert got.count() == 20000 and got.agg({"session_start": "min"}).first()[0] == start
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_u" in plan and "_slice" in plan.split("hashpartitioning(_u", 1)[1].split(")")[0]


def test_dedupe_keeps_the_earliest_delivery(spark):
    t = [dt.datetime(2024, 1, 1, h) for h in range(4)]
    rows = [(1, 5, t[2]), (1, 6, t[1]), (1, 4, t[1]), (2, 1, None), (2, 9, t[3]), (None, 1, t[0]), (None, 1, t[0])]
    got = events.dedupe_events(spark.createDataFrame(rows, SCHEMA))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [(1, 4, t[1]), (2, 1, None), (None, 1, t[0]), (None, 1, t[0])]))
