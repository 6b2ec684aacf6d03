"""Tests of the third round's findings: each builds its own rows."""

import numpy as np
from pyspark.sql import functions as F

from paths import SF_SMALL
from ebbflow.operators import archetypes, clean, hypothesis, ranks, select
from ebbflow.plans import datasets


def test_log_rank_of_counts_whose_products_outgrow_a_long(spark):
    n = 100_000
    df = spark.range(2 * n).select(
        F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("g"),
        F.when(F.col("id") % 8 < 3, 1).otherwise(2).alias("t"), F.lit(1).alias("e"))
    got = hypothesis.log_rank_statistic(df, "t", "e", "g", "a", "b", bounded=True).first()
    oe = v = 0.0
    for n1, n2, d1, d2 in ((n, n, n // 2, n // 4), (n // 2, 3 * n // 4, n // 2, 3 * n // 4)):
        m, d = n1 + n2, d1 + d2
        oe += d1 - d * n1 / m
        v += n1 * n2 * d * (m - d) / (m * m * (m - 1))  # whole numbers of any size
    assert got.observed_a == n
    assert np.isclose(got.log_rank_chi2, oe * oe / v, rtol=1e-12)


def _points(spark):
    """Three far groups of 40 rows, every row twice, and one row of nulls."""
    rows = [(10.0 * (i % 3) + (i * 7 % 11) / 10, -5.0 * (i % 3) + (i * 5 % 13) / 10) for i in range(120)]
    return spark.createDataFrame([*rows, *rows, (None, None)], "a double, b double")


def test_restarts_of_k_means_share_their_passes(spark, monkeypatch):
    passes = []
    assign = archetypes._assign
    monkeypatch.setattr(archetypes, "_assign", lambda blocks, runs: passes.append(len(runs)) or assign(blocks, runs))
    got = archetypes.kmeans_segments(_points(spark), ["a", "b"], k=3).toPandas()
    assert passes[0] == 10 and len(passes) <= max(20, passes.count(10))
    assert list(got.columns) == ["a", "b", "segment"] and len(got) == 241
    assert got.groupby(got.a.floordiv(5)).segment.nunique().eq(1).all() and got.segment.nunique() == 3
    assert set(map(tuple, got[["a", "b"]].to_numpy()[-1:])) == {(0.0, 0.0)}


def test_feature_table_has_methods_that_the_jvm_compiles(spark, monkeypatch):
    name, seen = "spark.sql.codegen.hugeMethodLimit", []
    before = spark.conf.get(name)
    monkeypatch.setattr(datasets, "_MATERIALIZED", {})
    monkeypatch.setattr(datasets, "build_customers", lambda *_: spark.range(1))
    monkeypatch.setattr(datasets, "materialize", lambda df, tag: seen.append(spark.conf.get(name)) or df)
    datasets.customers(spark, SF_SMALL)
    assert seen == ["8000"] and spark.conf.get(name) == before


def _numbers(spark, n=6000):
    """A column of different values, one of few with nulls, one with infinities, NaN and negative zero, one without a value."""
    i = F.col("id")
    odd = F.when(i % 50 == 0, float("nan")).when(i % 50 == 1, float("inf")).when(i % 50 == 2, float("-inf")).when(i % 50 == 3, -0.0)
    return spark.range(n).repartition(5).select(
        "id", ((i * 7919) % n / 7.0).alias("x"), F.when(i % 4 > 0, i % 3).alias("k"), odd.otherwise(i % 40).alias("odd"),
        F.lit(None).cast("double").alias("nothing"), (i % 5 == 0).cast("int").alias("y"))


def _small(monkeypatch):
    monkeypatch.setattr(ranks, "SMALL", 100)
    monkeypatch.setattr(ranks, "BRACKET_SAMPLE", 4000)


COLS, LEVELS = ["x", "k", "odd", "nothing"], [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]


def _rows(df):
    return sorted(repr(tuple(r)) for r in df.collect())


def test_coarse_histogram_is_smaller_and_gives_exact_quantiles(spark, monkeypatch):
    df = _numbers(spark)
    _small(monkeypatch)
    whole = ranks.histogram(df, COLS)
    coarse = ranks.coarse_histogram(df, COLS, LEVELS[1:-1])
    assert whole.agg(F.sum("cnt")).first() == coarse.agg(F.sum("cnt")).first()
    assert coarse.where("column = 'x'").count() < 0.7 * whole.where("column = 'x'").count()
    assert _rows(ranks.histogram_quantiles(coarse, ["column"], LEVELS[1:-1])) == _rows(ranks.histogram_quantiles(whole, ["column"], LEVELS[1:-1]))
    assert _rows(ranks.grouped_quantiles(df, COLS, LEVELS, reread=True)) == _rows(ranks.grouped_quantiles(df, COLS, LEVELS))


def test_quantiles_outside_their_brackets_are_counted_value_by_value(spark, monkeypatch):
    df = _numbers(spark)
    _small(monkeypatch)
    monkeypatch.setattr(ranks, "_brackets", lambda *_: {"x": ([10.0, 700.0], [11.0, 701.0]), "k": ([1.0], [1.0])})
    assert _rows(ranks.grouped_quantiles(df, COLS, LEVELS, reread=True)) == _rows(ranks.grouped_quantiles(df, COLS, LEVELS))


def test_statistics_of_many_rows_equal_those_of_few(spark, monkeypatch):
    df = _numbers(spark)
    few = lambda: _rows(clean.iqr_bounds(df, ["x", "k", "nothing"]))
    plain, mi = few(), _rows(select.mutual_information(df, ["x", "k"], "y").select("feature", F.round("mutual_information", 9)))
    _small(monkeypatch)
    assert few() == plain
    assert _rows(select.mutual_information(df, ["x", "k"], "y").select("feature", F.round("mutual_information", 9))) == mi


def test_cut_key_without_ordering_all_rows(spark, monkeypatch):
    i = F.col("id")
    df = spark.range(3000).repartition(4).select(F.when(i % 10 > 0, i % 7).alias("a"), (i / 2).cast("long").alias("b"))
    label = lambda frac: ranks.first_fraction_flag(df, ["a", "b"], frac, "part", "first", "rest")
    fractions = [0.0, 0.5, 1.0]
    plain = [_rows(label(f)) for f in fractions]
    monkeypatch.setattr(ranks, "SMALL", 100)
    monkeypatch.setattr(ranks, "prefix_sums", lambda *_, **__: 1 / 0)
    monkeypatch.setattr(ranks, "grouped_prefix_sums", lambda *_, **__: 1 / 0)
    assert [_rows(label(f)) for f in fractions] == plain
