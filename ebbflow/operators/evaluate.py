"""Exact model evaluation and prediction tables (inventory K1, K2, K6, K8–K13,
K16–K18).

All ranking metrics are computed from a *distinct-score* table — one row per
(score value, model) with positive/negative counts — followed by distributed
prefix sums (``ranks.prefix_sums``). Ties get the average-rank treatment of the
exact metrics (not the 1000-bin approximation of ``BinaryClassificationEvaluator``).
Sums that feed a ratio are integers, so each metric is a single division.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbflow.functions.columns import attach, flag, risk_tier
from ebbflow.operators.ranks import (avg_rank_desc_int, first_fraction_flag, global_row_number,
                                    grouped_prefix_sums, prefix_sums)


def _score_table(df: DataFrame, p: str, y: str, by: list[str]) -> DataFrame:
    """(by..., p, pos, neg) per distinct score — one partial aggregation."""
    return df.groupBy(*by, p).agg(F.sum(flag(F.col(y) == 1)).cast("long").alias("pos"),
                                  F.sum(flag(F.col(y) != 1)).cast("long").alias("neg"))


def roc_auc(df: DataFrame, p: str = "churn_probability", y: str = "Churn_binary",
            by: list[str] | None = None, bounded: bool = False) -> DataFrame:
    """K8: exact ROC-AUC (Mann–Whitney U / (n₁·n₀), ties count one half).

    AUC = (2·Σ pos_v·neg_below_v + Σ pos_v·neg_v) / (2·n₁·n₀).
    """
    by = by or []
    return auc_of_counts(_score_table(df, p, y, by), p, by, bounded)


def auc_of_counts(t: DataFrame, p: str, by: list[str], bounded: bool = False) -> DataFrame:
    """K8 from a table (by…, p, pos, neg) of the rows of either class per distinct score."""
    cum = grouped_prefix_sums(t, by, [(p, True)], {"_neg_le": F.col("neg")}, bounded=bounded, freeze=True)
    g = cum.groupBy(*by).agg(
        F.sum(F.col("pos") * (F.col("_neg_le") - F.col("neg")) * 2
              + F.col("pos") * F.col("neg")).alias("_u2"),
        F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    return g.select(*by, (F.col("_u2").cast("double")
                          / (F.col("n_pos") * F.col("n_neg") * 2).cast("double")).alias("auc"),
                    "n_pos", "n_neg")


def average_precision(df: DataFrame, p: str = "churn_probability", y: str = "Churn_binary",
                      by: list[str] | None = None, bounded: bool = False,
                      digits: int = 10) -> DataFrame:
    """K9: AP = Σ_v (pos_v / n₁) · TP_v / (TP_v + FP_v) over thresholds taken
    in descending score order (step-wise, not the trapezoid ``areaUnderPR``)."""
    by = by or []
    t = _score_table(df, p, y, by)
    cum = grouped_prefix_sums(t, by, [(p, False)], {"_tp": F.col("pos"), "_fp": F.col("neg")}, bounded=bounded, freeze=True)
    g = cum.groupBy(*by).agg(
        F.sum(F.col("pos").cast("double") * F.col("_tp") / (F.col("_tp") + F.col("_fp")))
        .alias("_s"), F.sum("pos").alias("_n1"))
    return g.select(*by, F.round(F.col("_s") / F.col("_n1"), digits).alias("average_precision"))


def threshold_metrics(df: DataFrame, p: str = "churn_probability", y: str = "Churn_binary",
                      threshold: float = 0.5, by: list[str] | None = None) -> DataFrame:
    """Confusion counts, precision, recall, F1 at a threshold; 0/0 → 0."""
    by = by or []
    pred = F.col(p) >= threshold
    pos = F.col(y) == 1
    g = (df.groupBy(*by) if by else df.groupBy()).agg(
        F.sum(flag(pred & pos)).cast("long").alias("tp"),
        F.sum(flag(pred & ~pos)).cast("long").alias("fp"),
        F.sum(flag(~pred & ~pos)).cast("long").alias("tn"),
        F.sum(flag(~pred & pos)).cast("long").alias("fn"))
    div = lambda a, b: F.coalesce(a.cast("double") / F.nullif(b, F.lit(0)).cast("double"),
                                  F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return g.select(*by, "tp", "fp", "tn", "fn",
                    div(tp, tp + fp).alias("precision"), div(tp, tp + fn).alias("recall"),
                    div(tp * 2, tp * 2 + fp + fn).alias("f1"))


def roc_points(df: DataFrame, p: str = "churn_probability", y: str = "Churn_binary",
               bounded: bool = False) -> DataFrame:
    """(threshold, fpr, tpr, recall, precision) per distinct score,
    thresholds descending."""
    t = _score_table(df, p, y, [])
    cum = prefix_sums(t, [(p, False)], {"_tp": F.col("pos"), "_fp": F.col("neg")},
                      bounded=bounded, freeze=True)
    tot = t.agg(F.sum("pos").alias("_n1"), F.sum("neg").alias("_n0"))
    c = cum.transform(attach, tot)
    return c.select(F.col(p).alias("threshold"),
                    (F.col("_fp").cast("double") / F.col("_n0")).alias("fpr"),
                    (F.col("_tp").cast("double") / F.col("_n1")).alias("tpr"),
                    (F.col("_tp").cast("double") / (F.col("_tp") + F.col("_fp"))).alias("precision"))


def lift_curve(df: DataFrame, p: str = "churn_probability", y: str = "Churn_binary",
               cents: str = "monthly_cents", key: str = "customer_id") -> DataFrame:
    """Per row in (p desc, id) order: position, cumulative churners,
    cumulative share, cumulative saved MRR and lift. Distributed row positions."""
    small = df.select(key, p, F.col(y).cast("long").alias("_y"),
                      (F.col(y) * F.col(cents)).cast("long").alias("_c"))
    cum = prefix_sums(small, [(p, False), (key, True)],
                      {"position": F.lit(1).cast("long"), "cumulative_churn": F.col("_y"),
                       "_cum_c": F.col("_c")})
    tot = small.agg(F.count(F.lit(1)).alias("_n"), F.sum("_y").alias("_yt"))
    c = cum.transform(attach, tot)
    return c.select(key, p, "position", "cumulative_churn",
                    (F.col("position").cast("double") / F.col("_n")).alias("cumulative_pct"),
                    (F.col("_cum_c").cast("double") / 100.0).alias("cumulative_mrr_saved"),
                    ((F.col("cumulative_churn") * F.col("_n")).cast("double")
                     / (F.col("position") * F.col("_yt")).cast("double")).alias("lift"))


def lift_summary(lift: DataFrame, share: float = 0.2) -> DataFrame:
    """Saved MRR within the top ``share`` of rows and the lift there."""
    n = lift.agg(F.max("position").alias("_n"))
    cut = F.floor(F.col("_n") * share)
    top = lift.transform(attach, n).where(F.col("position") <= cut)
    return top.agg(F.max("cumulative_mrr_saved").alias("top_mrr_saved"),
                   F.max("cumulative_churn").alias("top_churners"),
                   F.max("position").alias("top_n"))


def temporal_split(df: DataFrame, order: str = "tenure", key: str = "customer_id",
                   frac: float = 0.8) -> DataFrame:
    """K1: the first ⌊frac·n⌋ rows in (order, key) are ``train``, the rest ``test``.
    Distributed positions over the two key columns only; rows are labelled by
    comparing (order, key) with the cut key."""
    return first_fraction_flag(df, [order, key], frac, "split", "train", "test")


def stratified_split(df: DataFrame, y: str = "Churn_binary", test_frac: float = 0.2,
                     seed: int = 42, key: str = "customer_id") -> DataFrame:
    """K2: per class, the first round(test_frac·n_c) rows in hash order are
    ``test``. Positions are computed on the narrow (class, hash, id) keys with
    range partitioning (the majority class is not one task); each class's cut
    key (one row per class) labels the rows by a struct comparison."""
    h = df.withColumn("_h", F.xxhash64(F.col(key), F.lit(seed)))
    keys = h.select(y, "_h", key)
    pos = prefix_sums(keys, [(y, True), ("_h", True), (key, True)], {"_all": F.lit(1).cast("long")})
    per = pos.groupBy(y).agg(F.count(F.lit(1)).alias("_nc"), F.min("_all").alias("_s"))
    cut = (pos.join(F.broadcast(per), y)
           .where(F.col("_all") - F.col("_s") + 1 == F.round(F.col("_nc") * test_frac))
           .select(y, F.struct("_h", key).alias("_cut")))
    out = h.join(F.broadcast(cut), y, "left")
    return (out.withColumn("split", F.when(F.struct("_h", key) <= F.col("_cut"), "test")
                           .otherwise("train")).drop("_h", "_cut"))


def class_weights(df: DataFrame, y: str = "Churn_binary") -> DataFrame:
    """K6: balanced weight n/(2·n_c) per class and the positive weight neg/pos."""
    c = df.groupBy(y).agg(F.count(F.lit(1)).alias("n_c"))
    tot = df.agg(F.count(F.lit(1)).alias("_n"), F.sum(flag(F.col(y) == 1)).alias("_pos"))
    return (c.transform(attach, tot).select(
        y, "n_c", (F.col("_n").cast("double") / (F.col("n_c") * 2)).alias("balanced_weight"),
        ((F.col("_n") - F.col("_pos")).cast("double") / F.col("_pos")).alias("pos_weight")))


def with_class_weight(df: DataFrame, y: str = "Churn_binary", name: str = "weight") -> DataFrame:
    """Attach the balanced weight as a column (for ``weightCol`` in MLlib)."""
    w = class_weights(df, y).select(y, F.col("balanced_weight").alias(name))
    return df.join(F.broadcast(w), y)


def risk_tier_counts(df: DataFrame, p: str = "churn_probability", rule: str = "ge") -> DataFrame:
    """Tier counts."""
    return (df.groupBy(risk_tier(p, rule).alias("risk_tier"))
            .agg(F.count(F.lit(1)).alias("customers")).orderBy("risk_tier"))


def customer_predictions(df: DataFrame, p: str = "churn_probability", y: str = "Churn_binary",
                         m: str = "MonthlyCharges", key: str = "customer_id",
                         survival: DataFrame | None = None,
                         archetypes: DataFrame | None = None,
                         tier_rule: str = "cut") -> DataFrame:
    """One row per customer; survival and archetype columns are left joins
    on the key (never positional), priority = descending average rank of the
    12-month CLV at risk, truncated."""
    out = df.select(key, F.col(y).alias("Churn_binary"), F.col(p).alias("churn_probability"),
                    risk_tier(p, tier_rule).alias("risk_tier"),
                    F.col(m).alias("monthly_charges"))
    if survival is not None:
        out = out.join(survival, key, "left")
    if archetypes is not None:
        out = out.join(archetypes, key, "left")
    out = out.withColumn("clv_at_risk_12m",
                         F.col("monthly_charges") * 12 * F.col("churn_probability"))
    return avg_rank_desc_int(out, "clv_at_risk_12m", "intervention_priority")


def impact_summary(preds: DataFrame, share: float = 0.2) -> DataFrame:
    """Total MRR, High-tier MRR and the MRR of the top ⌊share·n⌋ by
    priority (priority ties broken by id)."""
    ranked = global_row_number(preds.select("customer_id", "intervention_priority",
                                            "monthly_charges", "risk_tier"),
                               [("intervention_priority", True), ("customer_id", True)], "_pos", freeze=True)
    n = preds.agg(F.count(F.lit(1)).alias("_n"))
    r = ranked.transform(attach, n)
    cents = F.round(F.col("monthly_charges") * 100).cast("long")
    money = lambda e: F.sum(e).cast("double") / 100.0
    return r.agg(money(cents).alias("total_mrr"),
                 money(F.when(F.col("risk_tier") == "High", cents).otherwise(0))
                 .alias("high_tier_mrr"),
                 money(F.when(F.col("_pos") <= F.floor(F.col("_n") * share), cents).otherwise(0))
                 .alias("top_share_mrr"))


def compare_models(scores: DataFrame, y: str = "Churn_binary", p: str = "p",
                   model: str = "model", threshold: float = 0.5) -> DataFrame:
    """Metrics per model from a long (model, id, p, y) table in one job
    family; ``best`` marks the highest AUC (first model name wins ties)."""
    auc = roc_auc(scores, p, y, by=[model])
    ap = average_precision(scores, p, y, by=[model])
    th = threshold_metrics(scores, p, y, threshold, by=[model])
    t = auc.join(ap, model).join(th, model)
    best = t.agg(F.min_by(F.col(model), F.struct(-F.col("auc"), F.col(model))).alias("_best"))
    return (t.transform(attach, best).withColumn("best", F.col(model) == F.col("_best"))
            .drop("_best"))
