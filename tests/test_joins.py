"""Checked key joins."""

import pytest

from ebbflow.operators import joins


def frame(spark, rows, value):
    return spark.createDataFrame(rows, f"k long, {value} string")


def test_left_rows_keep_their_place_and_null_keys_have_no_partner(spark):
    left = frame(spark, [(1, "a"), (2, None), (None, "x"), (None, "x")], "l")
    right = frame(spark, [(2, "b"), (3, "c"), (None, "y")], "r")
    assert sorted(map(str, map(tuple, joins.one_to_one(left, right, "k").collect()))) == sorted(
        map(str, [(1, "a", None), (2, None, "b"), (None, "x", None), (None, "x", None)]))
    assert [tuple(r) for r in joins.one_to_one(left, right, "k", "inner").collect()] == [(2, None, "b")]
    assert joins.one_to_one(left.limit(0), right, "k").count() == 0


@pytest.mark.parametrize("side", ["left", "right"])
def test_a_repeated_key_is_an_error(spark, side):
    once, twice = [(1, "a"), (2, "b")], [(1, "a"), (1, "b")]
    left = frame(spark, twice if side == "left" else once, "l")
    right = frame(spark, twice if side == "right" else once, "r")
    with pytest.raises(Exception, match=f"the {side} table repeats key 1"):
        joins.one_to_one(left, right, "k").collect()


def test_report_counts_what_a_join_would_meet(spark):
    left = frame(spark, [(1, "a"), (2, "b"), (2, "b"), (4, "d"), (None, "x")], "l")
    right = frame(spark, [(1, "a"), (2, "b"), (3, "c"), (3, "c"), (5, "e"), (None, "y"), (None, "y")], "r")
    assert joins.key_report(left, right, "k").first().asDict() == {
        "matched": 2, "left_only": 1, "right_only": 2, "left_repeated": 1, "right_repeated": 1, "left_null": 1, "right_null": 2}
