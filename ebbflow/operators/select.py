"""Feature selection (inventory D1–D5, D7).

Many-column statistics are one unpivot + one grouped aggregation; only p×p
matrices (VIF) ever reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbflow.functions.columns import attach

from ebbflow.operators.clean import numeric_columns
from ebbflow.operators.ranks import coarse_histogram, histogram_quantiles


def align_features(df: DataFrame, names: list[str] | None, target: str = "Churn_binary",
                   exclude=("customer_id",)) -> tuple[DataFrame, list[str]]:
    """Listed features that exist (else every numeric column), minus the
    target and ids, nulls → 0. Returns (frame, feature list)."""
    if names:
        cols = [c for c in names if c in df.columns and c != target]
    else:
        cols = [c for c in numeric_columns(df, drop=(target, *exclude))]
    return df.fillna(0, subset=cols), cols


def mutual_information(df: DataFrame, features: list[str], target: str = "Churn_binary",
                       bins: int = 10) -> DataFrame:
    """D1 (re-aimed): plug-in mutual information (nats) between each feature, in
    bins between its exact quantiles, and the target. One coarse histogram of (feature,
    value, target) gives quantiles and contingency cells for all features. A value
    is in the bin of the number of inner quantiles below it, so equal quantiles
    leave bins empty and a feature with few values keeps one bin per value."""
    levels = [i / bins for i in range(1, bins)]
    h = (coarse_histogram(df.select(F.col(target).alias("_y"), *features), features, levels, ["_y"])
         .select(F.col("column").alias("feature"), "v", "_y", "cnt"))
    values = h.groupBy("feature", "v").agg(F.sum("cnt").alias("cnt"))
    inner = histogram_quantiles(values, ["feature"], levels)
    below = F.size(F.filter("q", lambda e: e < F.col("v")))
    cells = (h.join(F.broadcast(inner), "feature").withColumn("_b", below)
             .groupBy("feature", "_b", "_y").agg(F.sum("cnt").alias("_nxy"), F.first("n").alias("_n")))
    px = cells.groupBy("feature", "_b").agg(F.sum("_nxy").alias("_nx"))
    py = cells.groupBy("feature", "_y").agg(F.sum("_nxy").alias("_ny"))
    j = cells.join(px, ["feature", "_b"]).join(py, ["feature", "_y"])
    term = (F.col("_nxy") / F.col("_n")) * F.log(
        (F.col("_nxy") * F.col("_n")).cast("double") / (F.col("_nx") * F.col("_ny")).cast("double"))
    return j.groupBy("feature").agg(F.sum(term).alias("mutual_information"))


def select_by_quantile(scores: DataFrame, score: str = "mutual_information", q: float = 0.25,
                       target: str | None = "Churn_binary", name: str = "feature") -> DataFrame:
    """Keep features whose score is above the q-quantile; optionally append
    the target as a kept row."""
    cut = scores.agg(F.percentile(F.col(score), F.lit(q)).alias("_cut"))
    kept = scores.transform(attach, cut).where(F.col(score) > F.col("_cut")).select(name, score)
    if target:
        kept = kept.unionByName(scores.sparkSession.createDataFrame(
            [(target, None)], f"{name} string, {score} double"))
    return kept


def top_k_features(scores: DataFrame, k: int = 10, score: str = "mutual_information",
                   name: str = "feature") -> DataFrame:
    """D3: top k by score (name tie-break) — a top-k report."""
    return scores.orderBy(F.desc(score), name).limit(k)


def cross_products(df: DataFrame, features: list[str]) -> np.ndarray:
    """XᵀX of the features (nulls as 0): each task adds up its rows' products, the
    p×p sums are added per cell."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = np.zeros((len(features), len(features)))
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], 1)
            g += x.T @ x
        i, j = np.indices(g.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(g.ravel())],
                                         names=["i", "j", "s"])

    x = df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"x{k}") for k, c in enumerate(features)])
    g = np.zeros((len(features), len(features)))
    for i, j, total in x.mapInArrow(partial, "i long, j long, s double").groupBy("i", "j").agg(F.sum("s")).collect():
        g[i, j] = total
    return g


def vif(df: DataFrame, features: list[str]) -> DataFrame:
    """Variance inflation factors with the uncentred R² (no constant):
    VIFᵢ = (XᵀX)ᵢᵢ·((XᵀX)⁻¹)ᵢᵢ over all features, from one pass; the p×p inverse
    is on the driver. A feature that the others determine (its column is linearly
    dependent) gets +inf, an all-zero one too."""
    g = cross_products(df, features)
    scale = np.sqrt(np.diag(g))
    vals = np.full(len(features), np.inf)
    live = np.flatnonzero(scale > 0)
    if len(live):
        w, v = np.linalg.eigh(g[np.ix_(live, live)] / np.outer(scale[live], scale[live]))
        null = w <= len(live) * 1e-13 * w[-1]
        part = (v[:, null] ** 2).sum(1) > 1e-9  # takes part in a dependency
        inverse = (v[:, ~null] ** 2 / w[~null]).sum(1)
        vals[live] = np.where(part, np.inf, inverse)
    return df.sparkSession.createDataFrame(list(zip(features, map(float, vals))), "feature string, vif double")


def drop_high_vif(df: DataFrame, features: list[str], limit: float = 10.0) -> DataFrame:
    """The features with VIF ≤ limit (infinite VIF is dropped), with their VIF."""
    return vif(df, features).where(F.col("vif") <= limit)


def corr_with_target(df: DataFrame, target: str = "Churn_binary", k: int = 5,
                     features: list[str] | None = None) -> DataFrame:
    """Pearson correlation of every numeric column with the target (one
    aggregation), ordered by |r| desc; top k."""
    cols = features or numeric_columns(df, drop=(target, "customer_id"))
    wide = df.agg(*[F.corr(F.col(c).cast("double"), F.col(target).cast("double")).alias(c)
                    for c in cols])
    long = wide.unpivot([], cols, "feature", "correlation").where(F.col("correlation").isNotNull())
    return long.orderBy(F.desc(F.abs("correlation")), "feature").limit(k)
