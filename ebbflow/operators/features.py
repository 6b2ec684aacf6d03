"""Feature factory (inventory C1–C18).

Every group is a pure column projection (``withColumns``) except the table-wide
statistics (quantile cut-offs, percentile ranks), which are fitted once into a
one-row stats frame and cross-joined back as a broadcast (C18). The same
``engineer_features`` code path serves training and scoring, so frozen training
statistics give scoring the same cut-offs (no train/serve skew).
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbflow.functions.columns import (attach, exactly_one, TENURE_EDGES_A, TENURE_EDGES_C, bucketize,
                                       flag, sum_cols)
from ebbflow.operators.ranks import pct_rank_avg, quantile_row

SERVICE_COLS = ["OnlineSecurity", "OnlineBackup", "DeviceProtection", "TechSupport",
                "StreamingTV", "StreamingMovies"]
POLY_BASE = ["tenure", "MonthlyCharges", "service_adoption_score", "base_risk_score",
             "charge_per_service"]

def _mtt():
    return F.col("MonthlyCharges"), F.col("TotalCharges"), F.col("tenure")


# ---------------------------------------------------------------- C18 stats
def fit_feature_stats(df: DataFrame, charge: str = "MonthlyCharges") -> DataFrame:
    """One-row frame of the table-wide cut-offs (exact, interpolated quantiles)."""
    q = F.percentile(F.col(charge), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return df.agg(q.alias("_q")).select(
        F.col("_q")[0].alias("charge_q25"), F.col("_q")[1].alias("charge_q50"),
        F.col("_q")[2].alias("charge_q75"))


# ---------------------------------------------------------------- groups
def charge_features(df: DataFrame) -> DataFrame:
    """C1 + the threshold part of C2 (needs charge_q25/q50/q75 columns)."""
    m, T_, t = _mtt()
    df = df.withColumns({
        "charge_per_month": T_ / (t + 1),
        "charge_to_monthly_ratio": T_ / (m * (t + 1) + 1),
        "is_high_charger": flag(m > F.col("charge_q75")),
        "is_low_charger": flag(m < F.col("charge_q25")),
        "charge_above_median": flag(m > F.col("charge_q50")),
        "monthly_to_total_ratio": m / (T_ + 1),
        "expected_lifetime_value": m * 24,
    })
    return df.withColumns({
        "actual_vs_expected_clv": T_ / (F.col("expected_lifetime_value") + 1),
        "charge_trend": m / (F.col("charge_per_month") + 1),
        "revenue_efficiency": T_ / (t * m + 1),
    })


def tenure_features(df: DataFrame) -> DataFrame:
    """C3."""
    m, T_, t = _mtt()
    return df.withColumns({
        "tenure_squared": (t * t).cast("long"),
        "tenure_log": F.log1p(t),
        "is_new_customer": flag(t <= 6),
        "is_early_customer": flag(t <= 12),
        "is_loyal_customer": flag(t >= 48),
        "is_veteran_customer": flag(t >= 60),
        "tenure_bucket": bucketize(t, TENURE_EDGES_A, [1.0, 2.0, 3.0, 4.0, 5.0]),
        "months_remaining_1yr": F.greatest(F.lit(0), 12 - t),
        "months_remaining_2yr": F.greatest(F.lit(0), 24 - t),
        "contract_age_ratio": t / F.lit(24.0),
    })


def service_features(df: DataFrame, services=SERVICE_COLS) -> DataFrame:
    """C4 over the six 0/1 service flags."""
    m, T_, t = _mtt()
    sec, bak, dev, sup, tv, mov = [F.col(c) for c in services]
    df = df.withColumns({
        "service_adoption_score": sum_cols(services),
        "security_bundle": sec + bak + dev,
        "entertainment_bundle": tv + mov,
        "support_bundle": sup + dev,
    })
    s = F.col("service_adoption_score")
    return df.withColumns({
        "service_adoption_pct": s / F.lit(float(len(services))),
        "is_single_service": flag(s <= 1),
        "is_full_service": flag(s == len(services)),
        "has_any_security": flag(F.col("security_bundle") > 0),
        "has_entertainment": flag(F.col("entertainment_bundle") > 0),
        "services_per_dollar": s / (m + 1),
        "charge_per_service": m / (s + 1),
    })


def contract_features(df: DataFrame) -> DataFrame:
    """C5 (payment matching is case-insensitive everywhere, X5)."""
    pm = F.col("PaymentMethod")
    df = df.withColumns({
        "is_month_to_month": flag(F.col("Contract") == "Month-to-month"),
        "is_one_year": flag(F.col("Contract") == "One year"),
        "is_two_year": flag(F.col("Contract") == "Two year"),
        "has_auto_pay": flag(pm.ilike("%automatic%")),
        "uses_electronic": flag(pm.ilike("%electronic%")),
        "uses_mailed_check": flag(pm.ilike("%mailed%")),
    })
    auto = F.col("has_auto_pay")
    return df.withColumns({
        "paperless_no_auto": flag((F.col("PaperlessBilling") == 1) & (auto == 0)),
        "contract_risk_score": F.col("is_month_to_month") * 3 + (1 - auto) * 2,
    })


def internet_features(df: DataFrame) -> DataFrame:
    """C6 (needs has_any_security, is_high_charger)."""
    net = F.col("InternetService")
    df = df.withColumns({
        "has_fiber": flag(net == "Fiber optic"),
        "has_dsl": flag(net == "DSL"),
        "no_internet": flag(net == "No"),
    })
    fiber = F.col("has_fiber") == 1
    return df.withColumns({
        "fiber_no_security": flag(fiber & (F.col("has_any_security") == 0)),
        "fiber_no_support": flag(fiber & (F.col("TechSupport") == 0)),
        "fiber_high_charge": flag(fiber & (F.col("is_high_charger") == 1)),
    })


def demographic_features(df: DataFrame) -> DataFrame:
    """C7."""
    df = df.withColumns({
        "is_senior": F.col("SeniorCitizen").cast("int"),
        "has_partner": F.col("Partner").cast("int"),
        "has_dependents": F.col("Dependents").cast("int"),
        "has_family": flag((F.col("Partner") + F.col("Dependents")) > 0),
    })
    senior = F.col("is_senior") == 1
    return df.withColumns({
        "senior_alone": flag(senior & (F.col("has_family") == 0)),
        "young_family": flag((F.col("is_senior") == 0) & (F.col("has_family") == 1)),
        "senior_month_to_month": flag(senior & (F.col("is_month_to_month") == 1)),
    })


def risk_scores(df: DataFrame) -> DataFrame:
    """C8 composite scores."""
    m, T_, t = _mtt()
    c = F.col
    df = df.withColumn("base_risk_score",
                       c("is_month_to_month") * 3 + c("is_new_customer") * 2
                       + c("is_single_service") * 2 + c("is_high_charger")
                       + (1 - c("has_auto_pay")))
    df = df.withColumn("advanced_risk_score",
                       c("base_risk_score") * 1.0 + c("fiber_no_security") * 2.0
                       + c("fiber_high_charge") * 1.5 + c("paperless_no_auto") * 1.0
                       + c("senior_month_to_month") * 1.5)
    return df.withColumn("clv_at_risk", m * 12 * c("advanced_risk_score") / 10)


def interaction_features(df: DataFrame, base=POLY_BASE) -> DataFrame:
    """Interaction-only degree-2 products, nulls → 0 first."""
    z = {b: F.coalesce(F.col(b).cast("double"), F.lit(0.0)) for b in base}
    return df.withColumns({f"poly_{a}_{b}": z[a] * z[b] for a, b in combinations(base, 2)})


# Category encodings of the second feature generation.
CONTRACT_CODES = {"Month-to-month": 0, "One year": 1, "Two year": 2}
INTERNET_CODES = {"Fiber optic": 2, "DSL": 1, "No": 0}


def _map_literal(d: dict) -> F.Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def second_gen_features(df: DataFrame) -> DataFrame:
    """Each feature only when its inputs exist; unmapped category → null."""
    m, T_, t = _mtt()
    cols = set(df.columns)
    out = {}
    if {"TotalCharges", "MonthlyCharges"} <= cols:
        out["MonthlyCharges_log"] = F.log1p(m)
        out["TotalCharges_log"] = F.log1p(T_)
        out["AvgMonthlyCharge"] = T_ / (t + 1)
    if "tenure" in cols:
        out["tenure_log"] = F.log1p(t)
        out["tenure_months_group"] = bucketize(t, TENURE_EDGES_C,
                                               ["0-6", "6-12", "12-24", "24-60", "60+"])
        out["is_new_customer"] = flag(t <= 6)
        out["is_at_risk"] = flag(t <= 12)
    if "Contract" in cols:
        out["Contract_encoded"] = _map_literal(CONTRACT_CODES)[F.col("Contract")]
    if "InternetService" in cols:
        out["InternetService_encoded"] = _map_literal(INTERNET_CODES)[F.col("InternetService")]
    present = [c for c in SERVICE_COLS if c in cols]
    if present:
        dtypes = dict(df.dtypes)
        out["num_services"] = sum_cols([
            flag(F.col(c) == "Yes") if dtypes[c] == "string" else flag(F.col(c) == 1)
            for c in present])
    df = df.withColumns(out)
    more = {}
    if {"tenure", "MonthlyCharges"} <= cols:
        more["tenure_x_charges"] = t * m
    if "num_services" in df.columns and "tenure" in cols:
        more["services_x_tenure"] = F.col("num_services") * t
    return df.withColumns(more) if more else df


# ---------------------------------------------------------------- C13, C14
def quantile_flags(df: DataFrame, c: str, q: float, op: str, name: str) -> DataFrame:
    """Strict comparison with the exact interpolated quantile (broadcast 1 row)."""
    cut = quantile_row(df, {c: [q]}).select(F.col(c)[0].alias("_cut"))
    cmp = {">": F.col(c) > F.col("_cut"), "<": F.col(c) < F.col("_cut"),
           ">=": F.col(c) >= F.col("_cut"), "<=": F.col(c) <= F.col("_cut")}[op]
    return df.transform(attach, cut).withColumn(name, flag(cmp)).drop("_cut")


def qcut(df: DataFrame, c: str, q: int, name: str, labels=None) -> DataFrame:
    """C14: equal-frequency bins from exact quantile edges, right-closed, lowest
    included (pandas ``qcut``); edges are one broadcast row."""
    return qcuts(df, {c: name}, q, labels)


def qcuts(df: DataFrame, names: dict[str, str], q: int, labels=None) -> DataFrame:
    """C14 for several columns (column → name of its bin): one histogram gives all edges."""
    edges = quantile_row(df, {c: [i / q for i in range(q + 1)] for c in names})
    out = df.transform(attach, edges.select(*[F.col(c).alias(f"_e_{c}") for c in names]))
    labels = labels or list(range(1, q + 1))

    def bin_of(x: Column, e: Column) -> Column:
        expr = None
        for i in range(q):
            cond = ((x >= e[i]) if i == 0 else (x > e[i])) & (x <= e[i + 1])
            expr = F.when(cond, F.lit(labels[i])) if expr is None else expr.when(cond, F.lit(labels[i]))
        return expr

    return out.withColumns({name: bin_of(F.col(c), F.col(f"_e_{c}")) for c, name in names.items()}).drop(*[f"_e_{c}" for c in names])


# ---------------------------------------------------------------- C15–C17
# Fallback macro signals used when a source is unavailable.
MACRO_DEFAULTS = {
    "macro_gdp_growth": 2.5, "macro_inflation": 3.2, "macro_unemployment": 3.8,
    "macro_gni_per_capita": 76000.0, "trend_churn_intent": 50.0,
    "trend_switch_carrier": 50.0, "trend_churn_velocity": 0.0, "macro_telecom_sector": 0.0,
}


def derive_macro(macro: DataFrame) -> DataFrame:
    """Fill missing signals with defaults and add the two derived indices."""
    cols = set(macro.columns)
    filled = macro.select(*[
        (F.coalesce(F.col(k).cast("double"), F.lit(v)) if k in cols else F.lit(v)).alias(k)
        for k, v in MACRO_DEFAULTS.items()])
    return filled.withColumns({
        "macro_stress_index": F.col("macro_inflation") + F.col("macro_unemployment")
        - F.col("macro_gdp_growth"),
        "macro_consumer_pressure": F.col("macro_inflation") * F.col("macro_unemployment"),
    })


def add_macro(df: DataFrame, macro: DataFrame) -> DataFrame:
    """Constant columns onto every row; a macro frame of several rows is an error."""
    return df.transform(attach, exactly_one(macro, "the macro table"))


def trend_velocity(series: DataFrame, ts: str, value: str, k: int = 4,
                   by: list[str] | None = None) -> DataFrame:
    """C17: mean of the last k points minus mean of the first k, plus the mean.

    With a key, positions come from ``row_number`` partitioned by it. Without one the
    first and last k points are two top-k reads, so the series is never in one task.
    """
    from pyspark.sql import Window
    v = F.col(value).cast("double")
    if not by:
        points = series.select(F.col(ts), v.alias("_v"))
        last = points.orderBy(F.col(ts).desc()).limit(k).agg(F.avg("_v").alias("_last"))
        first = points.orderBy(F.col(ts).asc()).limit(k).agg(F.avg("_v").alias("_first"))
        return (points.agg(F.avg("_v").alias("mean_value")).transform(attach, last).transform(attach, first)
                .select((F.col("_last") - F.col("_first")).alias("velocity"), "mean_value"))
    w_asc = Window.partitionBy(*by).orderBy(F.col(ts).asc())
    w_desc = Window.partitionBy(*by).orderBy(F.col(ts).desc())
    r = series.select(*by, v.alias("_v"), F.row_number().over(w_asc).alias("_ra"),
                      F.row_number().over(w_desc).alias("_rd"))
    return r.groupBy(*by).agg(
        (F.avg(F.when(F.col("_rd") <= k, F.col("_v")))
         - F.avg(F.when(F.col("_ra") <= k, F.col("_v")))).alias("velocity"),
        F.avg("_v").alias("mean_value"),
    )


# ---------------------------------------------------------------- C18 entry
def engineer_features(df: DataFrame, stats: DataFrame | None = None,
                      percentiles: bool = True, interactions: bool = True) -> DataFrame:
    """All phase-one feature groups in dependency order.

    ``stats`` (from ``fit_feature_stats``) is the frozen one-row cut-off table;
    when omitted it is fitted on ``df`` (training); ``"attached"`` means the
    cut-off columns are already present on ``df``. Percentile ranks (C2) are
    average ranks over ``df`` itself.
    """
    if isinstance(stats, str) and stats == "attached":
        out = df  # charge_q25/q50/q75 columns are already on every row
    else:
        out = df.transform(attach, fit_feature_stats(df) if stats is None else stats)
    out = charge_features(out)
    out = tenure_features(out)
    out = service_features(out)
    out = contract_features(out)
    out = internet_features(out)
    out = demographic_features(out)
    out = risk_scores(out)
    if interactions:
        out = interaction_features(out)
    out = out.drop("charge_q25", "charge_q50", "charge_q75")
    if percentiles:
        out = pct_rank_avg(out, "MonthlyCharges", "monthly_charge_percentile")
        out = pct_rank_avg(out, "TotalCharges", "total_charge_percentile")
    return out


