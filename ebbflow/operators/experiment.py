"""Experiment design and read-outs (inventory L1–L3, L5–L7).

Outcomes are observed columns (no simulation). Every read-out is one grouped
aggregation by arm, pivoted to a single row with conditional aggregates.
"""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbflow.functions.columns import attach, flag
from ebbflow.functions.stats import chi2_sf_expr, two_sided_norm_p
from ebbflow.operators.ranks import first_fraction_flag


def eligible_pool(preds: DataFrame, p: str = "churn_probability", min_p: float = 0.3,
                  cents: str = "monthly_cents") -> DataFrame:
    """L1: customers with p ≥ ``min_p``; n and MRR."""
    pool = preds.where(F.col(p) >= min_p)
    return pool.agg(F.count(F.lit(1)).alias("pool_size"),
                    (F.sum(F.col(cents)).cast("double") / 100.0).alias("pool_mrr"))


def assign_groups(df: DataFrame, key: str = "customer_id", seed: int = 42,
                  method: str = "hash_rank") -> DataFrame:
    """L2: control/treatment arms.

    ``hash_rank``: order by xxhash64(key, seed), first ⌊n/2⌋ → control (exact
    halves, distributed positions). ``mod2``: key parity (streaming-friendly,
    no global pass).
    """
    if method == "mod2":
        return df.withColumn("group", F.when(F.col(key) % 2 == 0, "control").otherwise("treatment"))
    h = df.withColumn("_h", F.xxhash64(F.col(key), F.lit(seed)))
    return first_fraction_flag(h, ["_h", key], 0.5, "group", "control", "treatment").drop("_h")


def power_table(df: DataFrame, y: str = "Churn_binary", pool: DataFrame | None = None,
                effects=(0.05, 0.10, 0.15, 0.20), alpha: float = 0.05,
                power: float = 0.80) -> DataFrame:
    """L3: per relative effect, treatment rate, n per arm, total and whether the
    pool is large enough. Baseline by one aggregation; z values are literals."""
    spark: SparkSession = df.sparkSession
    za = NormalDist().inv_cdf(1 - alpha / 2)
    zb = NormalDist().inv_cdf(power)
    base = df.agg(F.avg(F.col(y).cast("double")).alias("p_control"))
    if pool is not None:
        base = base.transform(attach, pool.agg(F.count(F.lit(1)).alias("_pool")))
    else:
        base = base.withColumn("_pool", F.lit(None).cast("long"))
    eff = spark.createDataFrame([(float(e),) for e in effects], "effect_size double")
    p1 = F.col("p_control")
    p2 = p1 * (1 - F.col("effect_size"))
    pbar = (p1 + p2) / 2
    num = (F.lit(za) * F.sqrt(pbar * (1 - pbar) * 2)
           + F.lit(zb) * F.sqrt(p1 * (1 - p1) + p2 * (1 - p2)))
    n = F.ceil(num * num / ((p1 - p2) * (p1 - p2))).cast("long")
    out = eff.transform(attach, base).select(
        "effect_size", "p_control", p2.alias("p_treatment"), n.alias("n_per_arm"), "_pool")
    return out.withColumn("total_n", F.col("n_per_arm") * 2).withColumn(
        "feasible", F.col("total_n") <= F.col("_pool")).drop("_pool")


def ab_readout(df: DataFrame, group: str = "group", outcome: str = "churned",
               cents: str = "monthly_cents", control="control", treatment="treatment",
               alpha: float = 0.05) -> DataFrame:
    """Arm sizes and rates, absolute/relative reduction, Yates χ² and pooled
    z on the 2×2 table, MRR lost per arm, saved (monthly and ×12)."""
    c, t = F.col(group) == control, F.col(group) == treatment
    y = F.col(outcome)
    a = df.agg(
        F.sum(flag(c)).alias("n_control"), F.sum(flag(t)).alias("n_treatment"),
        F.sum(F.when(c, y).otherwise(0)).alias("x_control"),
        F.sum(F.when(t, y).otherwise(0)).alias("x_treatment"),
        F.sum(F.when(c, y * F.col(cents)).otherwise(0)).alias("_lc"),
        F.sum(F.when(t, y * F.col(cents)).otherwise(0)).alias("_lt"))
    n1, n2, x1, x2 = (F.col(k) for k in ("n_control", "n_treatment", "x_control", "x_treatment"))
    r1 = x1 / n1.cast("double")
    r2 = x2 / n2.cast("double")
    n = (n1 + n2).cast("double")
    # 2×2 χ² with Yates correction, cells (arm × churned/retained)
    cells = [(x1, n1, x1 + x2), (n1 - x1, n1, n - x1 - x2),
             (x2, n2, x1 + x2), (n2 - x2, n2, n - x1 - x2)]
    chi = None
    for o, rt, ct in cells:
        e = rt * ct / n
        dev = F.abs(o - e)
        dev = dev - F.least(F.lit(0.5), dev)
        term = dev * dev / e
        chi = term if chi is None else chi + term
    pool = (x1 + x2) / n
    z = (r1 - r2) / F.sqrt(pool * (1 - pool) * (1 / n1 + 1 / n2))
    out = a.select(
        "n_control", "n_treatment", "x_control", "x_treatment",
        r1.alias("control_rate"), r2.alias("treatment_rate"),
        (r1 - r2).alias("absolute_reduction"), ((r1 - r2) / r1).alias("relative_reduction"),
        chi.alias("chi2"), z.alias("z"),
        (F.col("_lc").cast("double") / 100).alias("control_mrr_lost"),
        (F.col("_lt").cast("double") / 100).alias("treatment_mrr_lost"),
        ((F.col("_lc") - F.col("_lt")).cast("double") / 100).alias("mrr_saved"),
        ((F.col("_lc") - F.col("_lt")) * 12).cast("double").alias("_a"))
    out = (out.withColumn("annual_saved", F.col("_a") / 100).drop("_a")
           .withColumn("p_chi2", chi2_sf_expr("chi2", F.lit(1)))
           .withColumn("p_z", two_sided_norm_p("z")))
    return out.withColumn("significant", F.col("p_z") < alpha)


def did(df: DataFrame, group: str = "group", period: str = "period", outcome: str = "churned",
        control="control", treatment="treatment", pre="pre", post="post") -> DataFrame:
    """(T_post − T_pre) − (C_post − C_pre) and the counterfactual level."""
    g = df.groupBy(group, period).agg(F.sum(F.col(outcome)).alias("_x"),
                                      F.count(F.lit(1)).alias("_n"))

    def rate(gv, pv):
        m = (F.col(group) == gv) & (F.col(period) == pv)
        return (F.sum(F.when(m, F.col("_x"))).cast("double") / F.sum(F.when(m, F.col("_n"))))

    a = g.agg(rate(control, pre).alias("control_pre"), rate(control, post).alias("control_post"),
              rate(treatment, pre).alias("treatment_pre"),
              rate(treatment, post).alias("treatment_post"))
    dc = F.col("control_post") - F.col("control_pre")
    dt = F.col("treatment_post") - F.col("treatment_pre")
    return a.select("*", (dt - dc).alias("did_estimate"),
                    (F.col("treatment_pre") + dc).alias("counterfactual_post"))


def segment_readout(df: DataFrame, seg: str = "Contract", group: str = "group",
                    outcome: str = "churned", control="control", treatment="treatment",
                    min_rows: int = 5) -> DataFrame:
    """Per segment, rate and n in each arm; both arms need > ``min_rows``."""
    c, t = F.col(group) == control, F.col(group) == treatment
    g = df.groupBy(seg).agg(
        F.sum(flag(c)).alias("n_control"), F.sum(flag(t)).alias("n_treatment"),
        F.sum(F.when(c, F.col(outcome)).otherwise(0)).alias("_xc"),
        F.sum(F.when(t, F.col(outcome)).otherwise(0)).alias("_xt"))
    return (g.where((F.col("n_control") > min_rows) & (F.col("n_treatment") > min_rows))
            .select(seg, F.col("n_control").cast("long").alias("n_control"),
                    F.col("n_treatment").cast("long").alias("n_treatment"),
                    (F.col("_xc") / F.col("n_control").cast("double")).alias("control_rate"),
                    (F.col("_xt") / F.col("n_treatment").cast("double")).alias("treatment_rate"))
            .orderBy(seg))


def experiment_frame(preds: DataFrame, p: str = "churn_probability", min_p: float = 0.3,
                     key: str = "customer_id", outcome: str = "Churn_binary",
                     date: str = "start_date", method: str = "mod2") -> DataFrame:
    """Observed experiment table: pool (L1) → arms (L2) → outcome, period
    (pre/post by the pool's median start day)."""
    pool = preds.where(F.col(p) >= min_p)
    arms = assign_groups(pool, key, method=method)
    day = F.datediff(F.col(date), F.lit("1970-01-01").cast("date"))
    med = pool.agg(F.percentile(day, F.lit(0.5)).alias("_med"))
    return (arms.transform(attach, med)
            .withColumn("period", F.when(day <= F.col("_med"), "pre").otherwise("post"))
            .withColumn("churned", F.col(outcome)).drop("_med"))
