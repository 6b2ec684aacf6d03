"""Key joins that check their keys (inventory E4, E5)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _once(df: DataFrame, key: str, side: str) -> DataFrame:
    """``df`` with one row per key; a repeated key fails the job. Null keys stay rows of their own."""
    rest = [c for c in df.columns if c != key]
    whole = F.struct(*rest) if rest else F.lit(None).cast("int")
    grouped = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.first(whole).alias("_r"))
    check = F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit(f"the {side} table repeats key "), F.col(key).cast("string"))))
    # the key passes through the check, so that no plan can leave it out
    one = grouped.withColumn(key, F.coalesce(check.cast(df.schema[key].dataType), F.col(key)))
    return one.select(key, "_r.*") if rest else one.select(key)


def one_to_one(left: DataFrame, right: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Join on a key that neither table may repeat (an error otherwise), never by position. Both
    sides are checked by an aggregation on the key, whose partitioning the join reuses. Rows of
    ``left`` with a null key are kept without a partner if ``how`` is ``left``."""
    joined = _once(left, key, "left").join(_once(right, key, "right"), key, how)
    if how != "left":
        return joined
    lost = left.where(F.col(key).isNull())
    absent = [f for f in right.schema.fields if f.name != key]
    return joined.unionByName(lost.withColumns({f.name: F.lit(None).cast(f.dataType) for f in absent}) if absent else lost)


def key_report(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row with what a one-to-one join of the tables would meet: keys in both, in one of them
    only, repeated keys and rows without a key."""
    count = lambda df, name: df.groupBy(key).agg(F.count(F.lit(1)).alias(name))
    both = count(left.where(F.col(key).isNotNull()), "_l").join(count(right.where(F.col(key).isNotNull()), "_r"), key, "full")
    number = lambda cond: F.count(F.when(cond, 1))
    l, r = F.col("_l"), F.col("_r")
    keys = both.agg(number(l.isNotNull() & r.isNotNull()).alias("matched"), number(r.isNull()).alias("left_only"),
                    number(l.isNull()).alias("right_only"), number(l > 1).alias("left_repeated"), number(r > 1).alias("right_repeated"))
    nulls = lambda df, name: df.agg(F.count(F.when(F.col(key).isNull(), 1)).alias(name))
    return keys.crossJoin(F.broadcast(nulls(left, "left_null"))).crossJoin(F.broadcast(nulls(right, "right_null")))  # one row each
