"""Segment SQL, cohorts and RFM (inventory F1–F26, G1–G6, E9–E11, E14).

Money is aggregated as BIGINT cents and divided once at the end, so sums do not
depend on partitioning (double sums do) and match the SQL oracle bit for bit.
Every operator is one partial (map-side) aggregation on low-cardinality keys;
shares of total use a one-row total cross-joined as a broadcast instead of an
un-partitioned ``SUM(...) OVER ()``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ebbflow.functions.columns import (attach, CHARGE_EDGES_F, CHARGE_LABELS_F, FREQUENCY_EDGES_G,
                                       TENURE_EDGES_D, TENURE_EDGES_E, TENURE_LABELS_D,
                                       TENURE_LABELS_E, bucketize, flag, pct, ratio,
                                       sum_cols, tenure_cohort_sql, value_segment)
from ebbflow.operators.features import SERVICE_COLS, qcuts
from ebbflow.operators.ranks import global_row_number, grouped_quantiles, ntile_from_position

Y = "Churn_binary"
CENTS = "monthly_cents"
TCENTS = "total_cents"


def _n():
    return F.count(F.lit(1))


def _churned(y=Y):
    return F.sum(F.col(y)).cast("long")


def _money(cents_sum):
    return cents_sum.cast("double") / F.lit(100.0)


def _avg_money(cents_col, n_expr):
    """sum(cents) / (n · 100): one exact division."""
    return F.sum(F.col(cents_col)).cast("double") / (n_expr * 100).cast("double")


def _standard(y=Y, cents=CENTS):
    """customers, churn_rate_pct, avg_monthly_charges."""
    return [_n().alias("customers"),
            pct(F.sum(F.col(y)), _n()).alias("churn_rate_pct"),
            _avg_money(cents, _n()).alias("avg_monthly_charges")]


def churn_by_segment(df: DataFrame, dims=("Contract", "InternetService"), y=Y,
                     cents=CENTS) -> DataFrame:
    """F1."""
    return (df.groupBy(*dims).agg(
        _n().alias("total_customers"), _churned(y).alias("churned"),
        pct(F.sum(F.col(y)), _n()).alias("churn_rate_pct"),
        _avg_money(cents, _n()).alias("avg_monthly_charges"),
        _money(F.sum(F.col(cents))).alias("total_mrr"))
        .orderBy(F.desc("churn_rate_pct"), *dims))


def revenue_at_risk_cohort(df: DataFrame, tenure="tenure", y=Y, cents=CENTS) -> DataFrame:
    """SQL tenure cohorts (scheme b) with conditional money sums."""
    lost = F.when(F.col(y) == 1, F.col(cents)).otherwise(0)
    return (df.withColumn("tenure_cohort", tenure_cohort_sql(tenure))
            .groupBy("tenure_cohort").agg(
                _n().alias("customers"), _churned(y).alias("churned"),
                pct(F.sum(F.col(y)), _n()).alias("churn_rate_pct"),
                _money(F.sum(lost)).alias("mrr_at_risk"),
                _money(F.sum(lost * 12)).alias("annual_revenue_at_risk"))
            .orderBy(F.desc("churn_rate_pct"), "tenure_cohort"))


def payment_method_risk(df: DataFrame, y=Y, cents=CENTS) -> DataFrame:
    """F3."""
    return (df.groupBy("PaymentMethod").agg(
        *_standard(y, cents), _money(F.sum(F.col(cents) * F.col(y))).alias("mrr_lost"))
        .orderBy(F.desc("churn_rate_pct"), "PaymentMethod"))


def service_adoption_churn(df: DataFrame, score="service_adoption_score", y=Y,
                           cents=CENTS) -> DataFrame:
    """F4."""
    return (df.where(F.col(score).isNotNull()).groupBy(score)
            .agg(*_standard(y, cents)).orderBy(score))


def clv_at_risk_decile(df: DataFrame, key="customer_id", y=Y, cents=CENTS,
                       tiles: int = 10) -> DataFrame:
    """``NTILE(10) OVER (ORDER BY MonthlyCharges DESC, id)``.

    The global position comes from distributed prefix sums (no single-partition
    window); the tile is then plain arithmetic on (position, n).
    """
    small = df.select(key, y, cents)
    ranked = global_row_number(small, [(cents, False), (key, True)], "_pos")
    n = small.agg(_n().alias("_n"))
    tiled = (ranked.transform(attach, n)
             .withColumn("charge_decile", ntile_from_position(F.col("_pos"), F.col("_n"), tiles)))
    return (tiled.groupBy("charge_decile").agg(
        *_standard(y, cents), _money(F.sum(F.col(cents) * 24 * F.col(y))).alias("clv_at_risk"))
        .orderBy("charge_decile"))


def contract_window_analysis(df: DataFrame, dim="Contract", y=Y, cents=CENTS) -> DataFrame:
    """Shares of the grand total (total as a broadcast 1-row frame)."""
    risk = F.col(cents) * F.col(y)
    g = df.groupBy(dim).agg(
        _n().alias("total"), _churned(y).alias("churned"),
        pct(F.sum(F.col(y)), _n()).alias("churn_rate"),
        _avg_money(cents, _n()).alias("avg_mrr"),
        F.sum(F.col(cents)).alias("_mrr"), F.sum(risk).alias("_risk"))
    tot = df.agg(F.sum(F.col(cents)).alias("_all_mrr"), F.sum(risk).alias("_all_risk"))
    return (g.transform(attach, tot).select(
        dim, "total", "churned", "churn_rate", "avg_mrr",
        _money(F.col("_mrr")).alias("total_mrr"),
        pct(F.col("_mrr"), F.col("_all_mrr")).alias("mrr_share_pct"),
        pct(F.col("_risk"), F.col("_all_risk")).alias("risk_share_pct"))
        .orderBy(F.desc("churn_rate"), dim))


def senior_risk_profile(df: DataFrame, y=Y, cents=CENTS) -> DataFrame:
    """F7."""
    return (df.groupBy(
        F.when(F.col("SeniorCitizen") == 1, "Senior").otherwise("Non-Senior").alias("segment"),
        F.when(F.col("Partner") == 1, "Has Partner").otherwise("No Partner").alias("partner_status"))
        .agg(*_standard(y, cents)).orderBy(F.desc("churn_rate_pct"), "segment", "partner_status"))


def cumulative_mrr_loss(df: DataFrame, tenure="tenure", y=Y, cents=CENTS,
                        limit: int | None = 15) -> DataFrame:
    """Running sum over tenure (≤ 73 aggregated rows → bounded window).

    The LIMIT is the report's feature (first 15 tenure months)."""
    per = df.groupBy(tenure).agg(
        F.sum(F.when(F.col(y) == 1, F.col(cents)).otherwise(0)).alias("_lost"))
    w = Window.orderBy(tenure).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    out = per.select(tenure, _money(F.col("_lost")).alias("mrr_lost_at_tenure"),
                     _money(F.sum("_lost").over(w)).alias("cumulative_mrr_lost")).orderBy(tenure)
    return out.limit(limit) if limit else out


def fiber_optic_deep_dive(df: DataFrame, y=Y, cents=CENTS) -> DataFrame:
    """F9 (encoded 0/1 flags only, X12)."""
    return (df.where(F.col("InternetService") == "Fiber optic").groupBy(
        "InternetService",
        F.when(F.col("TechSupport") == 1, "Has TechSupport").otherwise("No TechSupport")
        .alias("tech_support_status"),
        F.when(F.col("OnlineSecurity") == 1, "Secured").otherwise("Unsecured")
        .alias("security_status"))
        .agg(*_standard(y, cents))
        .orderBy(F.desc("churn_rate_pct"), "tech_support_status", "security_status"))


def intervention_roi(df: DataFrame, dims=("Contract", "InternetService"), y=Y, cents=CENTS,
                     min_rate_pct: float = 20.0, top: int = 8) -> DataFrame:
    """segments above a churn-rate floor, top ``top`` by annual risk
    (top-k report; ties broken by the segment key)."""
    risk = F.col(cents) * F.col(y)
    seg = df.groupBy(*dims).agg(
        _n().alias("total"), _churned(y).alias("churned"),
        pct(F.sum(F.col(y)), _n()).alias("churn_rate"),
        _avg_money(cents, _n()).alias("avg_mrr"), F.sum(risk).alias("_risk"))
    r = F.col("_risk")
    return (seg.where(F.col("churn_rate") > min_rate_pct).select(
        *dims, "total", "churn_rate", "avg_mrr", _money(r).alias("mrr_at_risk"),
        _money(r * 12).alias("annual_risk"),
        ((r * 15).cast("double") / F.lit(10000.0)).alias("cost_15pct_discount"),
        ((r * 1200).cast("double") / F.nullif(r * 180, F.lit(0)).cast("double"))
        .alias("intervention_roi_x"))
        .orderBy(F.desc("annual_risk"), *dims).limit(top))


def churn_by_contract(df: DataFrame, y=Y) -> DataFrame:
    """F11."""
    return (df.groupBy("Contract").agg(
        _n().alias("total_customers"), _churned(y).alias("churned"),
        pct(F.sum(F.col(y)), _n()).alias("churn_rate_pct"))
        .orderBy(F.desc("churn_rate_pct"), "Contract"))


def revenue_metrics(df: DataFrame, cents=CENTS, tcents=TCENTS) -> DataFrame:
    """averages over present values (TotalCharges may be null)."""
    return (df.groupBy("Contract").agg(
        _n().alias("customers"),
        _avg_money(cents, _n()).alias("avg_monthly"),
        _avg_money(tcents, F.count(F.col(tcents))).alias("avg_total"),
        _money(F.sum(F.col(tcents))).alias("total_revenue"))
        .orderBy(F.desc("total_revenue"), "Contract"))


def ltv_segments(df: DataFrame, total="TotalCharges", y=Y) -> DataFrame:
    """value segment share of all customers (total as a broadcast row)."""
    g = df.groupBy(value_segment(total).alias("value_segment")).agg(
        _n().alias("customers"), ratio(F.sum(F.col(y)), _n()).alias("churn_rate"))
    tot = df.agg(_n().alias("_all"))
    return (g.transform(attach, tot)
            .select("value_segment", "customers",
                    pct(F.col("customers"), F.col("_all")).alias("pct_of_total"), "churn_rate")
            .orderBy(F.desc("customers"), "value_segment"))


def rate_by(df: DataFrame, dims, target=Y, value=CENTS) -> DataFrame:
    """count, target rate and mean value per key."""
    return (df.groupBy(*dims).agg(
        _n().alias("customers"), ratio(F.sum(F.col(target)), _n()).alias("rate"),
        _avg_money(value, _n()).alias("mean_value")).orderBy(*dims))


def revenue_lost_by(df: DataFrame, dim: str, y=Y, cents=CENTS) -> DataFrame:
    """F16: Σ monthly charge over churned customers per key."""
    return (df.where(F.col(y) == 1).groupBy(dim)
            .agg(_money(F.sum(F.col(cents))).alias("revenue_lost")).orderBy(dim))


def business_impact(df: DataFrame, score="base_risk_score", cutoff: float = 6, y=Y,
                    cents=CENTS) -> DataFrame:
    """one conditional aggregation."""
    churn_c = F.sum(F.when(F.col(y) == 1, F.col(cents)).otherwise(0))
    high = F.col(score) >= cutoff
    return df.agg(
        _money(F.sum(F.col(cents))).alias("total_mrr"),
        _money(churn_c).alias("churned_mrr"),
        pct(churn_c, F.sum(F.col(cents))).alias("churned_mrr_pct"),
        F.sum(flag(high)).cast("long").alias("high_risk_customers"),
        _money(F.sum(F.when(high, F.col(cents)).otherwise(0))).alias("high_risk_mrr"))


def with_without_service(df: DataFrame, services=SERVICE_COLS, y=Y) -> DataFrame:
    """churn rate with vs without each service — one unpivot, one groupBy."""
    long = df.select(y, *services).unpivot(y, list(services), "service", "adopted")
    return (long.groupBy("service").agg(
        pct(F.sum(F.when(F.col("adopted") == 1, F.col(y))),
            F.sum(flag(F.col("adopted") == 1))).alias("with_service_pct"),
        pct(F.sum(F.when(F.col("adopted") != 1, F.col(y))),
            F.sum(flag(F.col("adopted") != 1))).alias("without_service_pct"))
        .orderBy("service"))


PROFILE_FLAGS = ["SeniorCitizen", "Partner", "Dependents", "PhoneService", "PaperlessBilling"]


def profile_by_target(df: DataFrame, flags=PROFILE_FLAGS, y=Y) -> DataFrame:
    """mean % of each flag for churned vs retained (long form)."""
    long = df.select(y, *flags).unpivot(y, list(flags), "feature", "v")
    return (long.groupBy("feature", y).agg(pct(F.sum("v"), _n()).alias("mean_pct"))
            .orderBy("feature", y))


def executive_kpis(df: DataFrame, preds: DataFrame, p="churn_probability", y=Y,
                   cents=CENTS, high: float = 0.6) -> DataFrame:
    """customer KPIs × prediction KPIs (two 1-row aggregates)."""
    churn_c = F.sum(F.when(F.col(y) == 1, F.col(cents)).otherwise(0))
    a = df.agg(_n().alias("customers"),
               F.sum(flag(F.col(y) == 0)).cast("long").alias("retained"),
               _churned(y).alias("churned"),
               pct(F.sum(F.col(y)), _n()).alias("churn_pct"),
               _money(churn_c).alias("mrr_at_risk"),
               _money(churn_c * 12).alias("annual_risk"))
    b = preds.agg(F.sum(flag(F.col(p) >= high)).cast("long").alias("high_risk_now"))
    return a.transform(attach, b)


def revenue_kpis(df: DataFrame, y=Y, cents=CENTS) -> DataFrame:
    """MRR totals and average CLV (retained 24×, churned 8×)."""
    is_c, is_r = F.col(y) == 1, F.col(y) == 0
    return df.agg(
        _money(F.sum(F.col(cents))).alias("total_mrr"),
        _money(F.sum(F.when(is_c, F.col(cents)).otherwise(0))).alias("churned_mrr"),
        (F.sum(F.when(is_r, F.col(cents) * 24)).cast("double")
         / (F.sum(flag(is_r)) * 100).cast("double")).alias("avg_clv_retained"),
        (F.sum(F.when(is_c, F.col(cents) * 8)).cast("double")
         / (F.sum(flag(is_c)) * 100).cast("double")).alias("avg_clv_churned"))


def charge_band_churn(df: DataFrame, m="MonthlyCharges", y=Y) -> DataFrame:
    """charge band (scheme f); charges outside the bands are dropped (null bin)."""
    return (df.withColumn("charge_band", bucketize(m, CHARGE_EDGES_F, CHARGE_LABELS_F))
            .where(F.col("charge_band").isNotNull()).groupBy("charge_band")
            .agg(_n().alias("customers"), pct(F.sum(F.col(y)), _n()).alias("churn_rate_pct"))
            .orderBy("charge_band"))


def histogram(df: DataFrame, c: str, bins: int, by: list[str] | None = None) -> DataFrame:
    """equal-width histogram over [min, max] of an integer column (cents,
    months); bin = (x − min)·bins div (max − min), last edge closed."""
    by = by or []
    mm = df.agg(F.min(c).alias("_lo"), F.max(c).alias("_hi"))
    x, lo, hi = F.col(c).cast("long"), F.col("_lo").cast("long"), F.col("_hi").cast("long")
    b = F.when(hi == lo, F.lit(0)).otherwise(
        F.least(F.lit(bins - 1), F.floor(((x - lo) * bins) / (hi - lo)))).cast("long")
    return (df.where(F.col(c).isNotNull()).transform(attach, mm)
            .withColumn("bin", b).groupBy(*by, "bin", "_lo", "_hi")
            .agg(_n().alias("count"))
            .select(*by, "bin", "count",
                    (lo + (hi - lo) * F.col("bin") / F.lit(float(bins))).alias("bin_start"))
            .orderBy(*by, "bin"))


def box_stats(df: DataFrame, c: str, by: list[str]) -> DataFrame:
    """exact five-number summary per group, from one histogram of (group, value):
    the least and the greatest value are the quantiles 0 and 1."""
    q = lambda i: F.col("q")[i]
    return (grouped_quantiles(df, [c], [0.0, 0.25, 0.5, 0.75, 1.0], by)
            .select(*by, q(0).alias("min"), q(1).alias("q1"), q(2).alias("median"), q(3).alias("q3"), q(4).alias("max")).orderBy(*by))


def scatter_extract(df: DataFrame, cols, key="customer_id", n: int = 1000,
                    seed: int = 42) -> DataFrame:
    """a reproducible sample of points (hash order + limit; sampling is the
    feature here). TakeOrdered keeps only n rows per task."""
    return (df.select(key, *cols)
            .orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n))


def two_group_ratio(df: DataFrame, cond, y=Y, against=None) -> DataFrame:
    """rate with a condition vs without it, or vs rows of another condition
    ``against``, and their ratio."""
    c = F.col(cond) == 1 if isinstance(cond, str) else cond
    other = ~c | c.isNull() if against is None else against
    with_r = ratio(F.sum(F.when(c, F.col(y))), F.sum(flag(c)))
    wo_r = ratio(F.sum(F.when(other, F.col(y))), F.nullif(F.sum(flag(other)), F.lit(0)))
    return (df.agg(with_r.alias("rate_with"), wo_r.alias("rate_without"))
            .withColumn("ratio", F.col("rate_without") / F.col("rate_with")))


# ------------------------------------------------------------------ cohorts
def cohort_retention(df: DataFrame, y=Y, cents=CENTS, tcents=TCENTS) -> DataFrame:
    """G1: scheme d cohorts (tenure 0 is outside, pandas ``cut``)."""
    return (df.withColumn("cohort", bucketize("tenure", TENURE_EDGES_D, TENURE_LABELS_D))
            .where(F.col("cohort").isNotNull()).groupBy("cohort").agg(
                _churned(y).alias("churned"), _n().alias("customers"),
                _avg_money(cents, _n()).alias("mean_monthly"),
                _avg_money(tcents, F.count(F.col(tcents))).alias("mean_total"),
                (1 - ratio(F.sum(F.col(y)), _n())).alias("retention"))
            .orderBy("cohort"))


def cohort_summary(df: DataFrame, y=Y) -> DataFrame:
    """Scheme e cohorts with retained and churn percentages."""
    return (df.withColumn("cohort", bucketize("tenure", TENURE_EDGES_E, TENURE_LABELS_E))
            .where(F.col("cohort").isNotNull()).groupBy("cohort").agg(
                _n().alias("total"), _churned(y).alias("churned"),
                pct(F.sum(flag(F.col(y) == 0)), _n()).alias("retained_pct"),
                pct(F.sum(F.col(y)), _n()).alias("churn_pct"))
            .orderBy("cohort"))


def rfm_scores(df: DataFrame, services=SERVICE_COLS) -> DataFrame:
    """r = qcut3(tenure), f = cut(#services, [-1,1,3,6]), m = qcut3(charges)."""
    out = df.withColumn("rfm_frequency", sum_cols([flag(F.col(s) == 1) for s in services]))
    out = qcuts(out, {"tenure": "r_score", "MonthlyCharges": "m_score"}, 3)
    out = out.withColumn("f_score", bucketize("rfm_frequency", FREQUENCY_EDGES_G))
    return out.withColumn("rfm_total", F.col("r_score") + F.col("f_score") + F.col("m_score"))


def rfm_segment(total) -> F.Column:
    """G4."""
    x = F.col(total) if isinstance(total, str) else total
    return (F.when(x >= 8, "Champion").when(x >= 6, "Loyal").when(x >= 5, "Potential")
            .when(x >= 4, "At Risk").otherwise("Hibernating"))


def rfm_summary(df: DataFrame, y=Y, cents=CENTS) -> DataFrame:
    """G5 over ``rfm_scores`` output."""
    return (df.withColumn("rfm_segment", rfm_segment("rfm_total")).groupBy("rfm_segment").agg(
        _n().alias("count"), pct(F.sum(F.col(y)), _n()).alias("churn_rate"),
        _avg_money(cents, _n()).alias("avg_mrr"),
        _money(F.sum(F.col(cents))).alias("total_mrr")).orderBy("rfm_segment"))


def segment_drilldown(df: DataFrame, seg_col: str, seg: str, y=Y, cents=CENTS) -> dict:
    """KPIs plus contract and internet distributions for one segment."""
    s = df.where(F.col(seg_col) == seg)
    kpis = s.agg(_n().alias("customers"), pct(F.sum(F.col(y)), _n()).alias("churn_rate_pct"),
                 _avg_money(cents, _n()).alias("avg_monthly"),
                 _money(F.sum(F.col(cents))).alias("total_mrr"),
                 ratio(F.sum("tenure"), _n()).alias("avg_tenure"),
                 (ratio(F.sum(F.col(y)), _n()) > 0.3).alias("high_priority"))
    return {"kpis": kpis, "contract": value_counts(s, "Contract"),
            "internet": value_counts(s, "InternetService")}


# ------------------------------------------------------------------ E9–E11, E14
def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """Contingency counts in long form."""
    return df.groupBy(a, b).agg(_n().alias("count")).orderBy(a, b)


def pivot_rate(df: DataFrame, row: str, col: str, values: list, y=Y) -> DataFrame:
    """Churn % pivot with an explicit value list (no extra distinct job)."""
    return (df.groupBy(row).pivot(col, values)
            .agg(pct(F.sum(F.col(y)), _n())).orderBy(row))


def value_counts(df: DataFrame, c: str) -> DataFrame:
    """E11."""
    return df.groupBy(c).agg(_n().alias("count")).orderBy(F.desc("count"), c)


def top_k(df: DataFrame, by: str, k: int, key="customer_id", descending=True) -> DataFrame:
    """nlargest/nsmallest with an id tie-break (TakeOrderedAndProject)."""
    o = F.desc(by) if descending else F.asc(by)
    return df.orderBy(o, key).limit(k)
