"""Distributed order statistics against plain ones, with buckets forced on small inputs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ebbflow.operators import ranks


@pytest.fixture(autouse=True)
def always_in_buckets(monkeypatch):
    monkeypatch.setattr(ranks, "SMALL", 0)


def rows_of(seed, n=900):
    """Groups of very different sizes (one holds a third of all rows, one is null), many ties, nulls and NaN."""
    rng = random.Random(seed)
    group = lambda: rng.choice(["hot"] * 5 + ["a", "b", None, *[f"g{i}" for i in range(8)]])
    value = lambda: rng.choice([None, float("nan"), -0.0, 0.0, *[float(x) for x in range(-4, 5)]])
    return [(i, group(), value(), rng.randint(-3, 9)) for i in range(n)]


def sort_key(v, asc):
    """Spark's order: null first ascending, last descending; NaN is the greatest."""
    rank = 0 if v is None else 2 if isinstance(v, float) and math.isnan(v) else 1
    x = 0 if rank != 1 else v
    return (rank, x) if asc else (-rank, -x)


def running(rows, by, asc):
    out, groups = {}, {}
    for r in sorted(rows, key=lambda r: (sort_key(r[2], asc), r[0])):
        key = r[1] if by else None
        groups[key] = groups.get(key, 0) + r[3]
        out[r[0]] = groups[key]
    return out


@pytest.mark.parametrize("asc", [True, False])
@pytest.mark.parametrize("by", [[], ["g"]])
@pytest.mark.parametrize("partitions", [1, 3, 40])
def test_running_sums_do_not_depend_on_buckets(spark, asc, by, partitions):
    rows = rows_of(partitions)
    df = spark.createDataFrame(rows, "id long, g string, v double, x long").repartition(5)
    got = ranks.grouped_prefix_sums(df, by, [("v", asc), ("id", True)], {"s": F.col("x")}, partitions=partitions)
    assert set(got.columns) == {"id", "g", "v", "x", "s"}
    assert {r.id: r.s for r in got.collect()} == running(rows, by, asc)


def test_rows_are_exchanged_once(spark):
    df = spark.range(5000).select("id", (F.col("id") % 7).alias("v"))
    plan = ranks.prefix_sums(df, [("v", False), ("id", True)], {"s": F.lit(1)})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(_bucket") == 1
    assert "rangepartitioning" not in plan


def test_empty_tables_and_single_rows(spark):
    for rows in ([], [(1, "a", 1.0, 5)]):
        df = spark.createDataFrame(rows, "id long, g string, v double, x long")
        assert [r.s for r in ranks.grouped_prefix_sums(df, ["g"], ["v", "id"], {"s": F.col("x")}).collect()] == [r[3] for r in rows]
        assert ranks.prefix_sums(df, ["v", "id"], {"s": F.col("x")}).count() == len(rows)


def test_grouped_quantiles_equal_numpy(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["hot", "hot", "hot", "a", None]), rng.choice([None, rng.randint(0, 9) / 4, rng.random() * 1e6]),
             rng.choice([None, rng.randint(0, 3)])) for _ in range(700)] + [("none", None, None), ("one", 2.5, 1)]
    df = spark.createDataFrame(rows, "g string, x double, k int")
    qs = [0.0, 0.1, 0.25, 1 / 3, 0.5, 0.9, 1.0]
    got = {(r.g, r.column): (r.n, r.q) for r in ranks.grouped_quantiles(df, ["x", "k"], qs, ["g"]).collect()}
    for g in {r[0] for r in rows}:
        for i, c in ((1, "x"), (2, "k")):
            values = [r[i] for r in rows if r[0] == g and r[i] is not None]
            if values:
                n, q = got.pop((g, c))
                assert n == len(values) and np.allclose(q, np.quantile(values, qs), rtol=1e-12)
    assert not got


def test_quantile_row_and_exact_quantiles(spark):
    df = spark.createDataFrame([(float(i), None) for i in range(101)], "x double, nothing double")
    row = ranks.quantile_row(df, {"x": [0.9, 0.25], "nothing": [0.5]}).first()
    assert row.x == [90.0, 25.0] and row.nothing is None
    assert {(r.level, r.quantile) for r in ranks.exact_quantiles(df, "x", [0.5, 0.005]).collect()} == {(0.5, 50.0), (0.005, 0.5)}


@pytest.mark.parametrize("kind", ["date", "timestamp", "timestamp_ntz", "decimal(30,8)", "bigint", "float", "string", "boolean", "binary"])
def test_cut_keys_keep_every_type(spark, kind):
    """Cuts travel as text; sums over buckets equal those of one window for keys of any type."""
    made = {"date": "date_add(date'1582-10-01', cast(id * 97 as int))", "timestamp": "timestamp_micros(id * 1234567891 - 5000000000000)",
            "timestamp_ntz": "timestamp_ntz'1969-12-31 23:59:59.999999' + make_dt_interval(0, 0, 0, id / 7)",
            "decimal(30,8)": "cast(id as decimal(30,8)) / 3 - 50", "bigint": "9223372036854775807 - id * 3", "float": "cast(id / 7.0 - 20 as float)",
            "string": "concat(chr(cast(id % 40 as int)), '\"\\\\é\n', id)", "boolean": "id % 3 = 0", "binary": "unhex(hex(id * 7919))"}[kind]
    df = spark.range(400).selectExpr("id", f"cast(if(id % 11 = 0, null, {made}) as {kind}) AS k", "id % 5 AS x")
    read = lambda bounded: sorted(map(tuple, ranks.prefix_sums(df, [("k", False), ("id", True)], {"s": F.col("x")}, bounded=bounded, partitions=7)
                                      .select("id", "s").collect()))
    assert read(False) == read(True)


@pytest.mark.parametrize("small", [0, 10_000])
def test_frozen_input_is_evaluated_once(spark, monkeypatch, small):
    monkeypatch.setattr(ranks, "SMALL", small)
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    df = spark.createDataFrame([(i % 3, i) for i in range(600)], "g long, x long").mapInArrow(counted, "g long, x long")
    got = ranks.grouped_prefix_sums(df, ["g"], [("x", True)], {"s": F.lit(1).cast("long")}, freeze=True)
    assert {r.x: r.s for r in got.collect()} == {i: i // 3 + 1 for i in range(600)}
    assert read.value == 600
