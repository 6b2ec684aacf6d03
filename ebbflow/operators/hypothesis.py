"""Hypothesis tests (inventory H1–H5).

Statistics are computed distributed (contingency counts, distinct-value
histograms, per-time risk sets), p-values are column expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ebbflow.functions.columns import attach, flag
from ebbflow.functions.stats import chi2_sf_expr, ks_p_expr, two_sided_norm_p
from ebbflow.operators.ranks import grouped_prefix_sums
from ebbflow.session import materialize


def contingency(df: DataFrame, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    """Observed cells of the r×c table of two categories: (by…, a, b, observed).
    Rows with a null category are left out, as in a crosstab; empty cells have no row."""
    return (df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*(by or []), a, b)
            .agg(F.count(F.lit(1)).cast("long").alias("observed")))


def chi2_statistic(df: DataFrame, a: str, b: str, by: list[str] | None = None,
                   yates: bool = True) -> DataFrame:
    """H1 statistic: Pearson χ² of independence, with Yates' correction on 2×2
    tables, plus dof and n per ``by`` group.

    Without correction χ² = n(ΣO²/(R·C) − 1), which needs no empty cells. On a 2×2
    table |O − E| is the same in all four, and Σ1/E = n·Σ1/R·Σ1/C."""
    by = by or []
    o = F.col("observed")
    cells = contingency(df, a, b, by).select(
        *by, a, b, o, F.sum(o).over(Window.partitionBy(*by, a)).alias("_rt"),
        F.sum(o).over(Window.partitionBy(*by, b)).alias("_ct"))
    rt, ct = F.col("_rt").cast("double"), F.col("_ct").cast("double")
    g = cells.groupBy(*by).agg(
        F.sum(o).alias("n"), F.sum(o * o / (rt * ct)).alias("_q"), F.sum(o / (rt * rt)).alias("_sr"),
        F.sum(o / (ct * ct)).alias("_sc"), F.count_distinct(a).alias("_r"), F.count_distinct(b).alias("_c"),
        F.max(F.struct(o.alias("o"), rt.alias("rt"), ct.alias("ct"))).alias("_cell"))
    dof = (F.col("_r") - 1) * (F.col("_c") - 1)
    plain = F.col("n") * (F.col("_q") - 1)
    dev = F.abs(F.col("_cell.o") - F.col("_cell.rt") * F.col("_cell.ct") / F.col("n"))
    dev = dev - F.least(F.lit(0.5), dev)
    chi2 = F.when(dof == 1, dev * dev * F.col("n") * F.col("_sr") * F.col("_sc")).otherwise(plain) if yates else plain
    return g.select(*by, F.greatest(chi2, F.lit(0.0)).alias("chi2"), dof.cast("long").alias("dof"),
                    F.col("n").cast("long").alias("n"))


def chi2_independence(df: DataFrame, a: str, b: str, by: list[str] | None = None,
                      yates: bool = True) -> DataFrame:
    """H1: statistic, dof and p-value."""
    s = chi2_statistic(df, a, b, by, yates)
    return s.withColumn("p_value", chi2_sf_expr("chi2", "dof"))


def ks_statistic(df: DataFrame, c: str, group: str, a, b,
                 by: list[str] | None = None, bounded: bool = False) -> DataFrame:
    """H2 statistic: D = max_v |F_a(v) − F_b(v)| = max |cum_a·n_b − cum_b·n_a| / (n_a·n_b),
    exact, from a distinct-value histogram and prefix sums over its values."""
    by = by or []
    h = (df.where(F.col(c).isNotNull() & F.col(group).isin(a, b))
         .groupBy(*by, F.col(c).alias("_v"))
         .agg(F.sum(flag(F.col(group) == a)).cast("long").alias("_ca"),
              F.sum(flag(F.col(group) == b)).cast("long").alias("_cb")))
    if not bounded:
        h = materialize(h, "histogram")
    cum = grouped_prefix_sums(h, by, [("_v", True)],
                              {"_cum_a": F.col("_ca"), "_cum_b": F.col("_cb")}, bounded=bounded)
    n = h.groupBy(*by).agg(F.sum("_ca").alias("n_a"), F.sum("_cb").alias("n_b"))
    j = cum.join(n, by) if by else cum.transform(attach, n)
    g = j.groupBy(*by, "n_a", "n_b").agg(
        F.max(F.abs(F.col("_cum_a") * F.col("n_b") - F.col("_cum_b") * F.col("n_a")))
        .alias("_num"))
    return g.select(*by, (F.col("_num").cast("double") / (F.col("n_a") * F.col("n_b")).cast("double"))
                    .alias("ks_statistic"), "n_a", "n_b")


def ks_two_sample(df: DataFrame, c: str, group: str, a, b, by: list[str] | None = None,
                  bounded: bool = False) -> DataFrame:
    """H2: statistic and asymptotic p-value."""
    s = ks_statistic(df, c, group, a, b, by, bounded)
    return s.withColumn("ks_p_value", ks_p_expr("ks_statistic", F.col("n_a").cast("double"),
                                                F.col("n_b").cast("double")))


def two_proportion_z(df: DataFrame, group: str, outcome: str, a, b) -> DataFrame:
    """H3: pooled two-proportion z-test (a vs b) from one aggregation."""
    g = df.agg(
        F.sum(flag(F.col(group) == a)).alias("n1"), F.sum(flag(F.col(group) == b)).alias("n2"),
        F.sum(F.when(F.col(group) == a, F.col(outcome)).otherwise(0)).alias("x1"),
        F.sum(F.when(F.col(group) == b, F.col(outcome)).otherwise(0)).alias("x2"))
    p1 = F.col("x1") / F.col("n1")
    p2 = F.col("x2") / F.col("n2")
    pool = (F.col("x1") + F.col("x2")) / (F.col("n1") + F.col("n2"))
    z = (p1 - p2) / F.sqrt(pool * (1 - pool) * (1 / F.col("n1") + 1 / F.col("n2")))
    return (g.select("n1", "n2", "x1", "x2", p1.alias("rate_1"), p2.alias("rate_2"),
                     z.alias("z"))
            .withColumn("p_value", two_sided_norm_p("z")))


# The five churn-driver hypotheses (name, column, level a, level b).
# The test is over all levels of the column, the rates are those of a and b.
HYPOTHESES = [
    ("month_to_month", "is_month_to_month", "1", "0"),
    ("single_service", "is_single_service", "1", "0"),
    ("fiber_internet", "InternetService", "Fiber optic", "DSL"),
    ("high_charge", "is_high_charger", "1", "0"),
    ("new_customer", "is_new_customer", "1", "0"),
]


def hypothesis_suite(df: DataFrame, y: str = "Churn_binary", hypotheses=HYPOTHESES,
                     alpha: float = 0.05) -> DataFrame:
    """H4: every hypothesis from one aggregation — each row gives one (hypothesis,
    level, outcome) entry per hypothesis; χ² over the levels, rates of a and b."""
    entries = F.array(*[F.struct(F.lit(n).alias("hypothesis"), F.col(c).cast("string").alias("level"),
                                 F.lit(a).alias("a"), F.lit(b).alias("b")) for n, c, a, b in hypotheses])
    long = df.select(F.col(y), F.explode(entries).alias("e")).select(y, "e.*")
    small = long.groupBy("hypothesis", "level", "a", "b", y).agg(F.count(F.lit(1)).alias("_n"))
    rate = lambda lv: (F.sum(F.when(F.col("level") == F.col(lv), F.col(y) * F.col("_n"))).cast("double")
                       / F.sum(F.when(F.col("level") == F.col(lv), F.col("_n"))))
    rates = small.groupBy("hypothesis").agg(rate("a").alias("rate_a"), rate("b").alias("rate_b"))
    chi = chi2_independence(long, "level", y, by=["hypothesis"])
    return (rates.join(chi, "hypothesis")
            .withColumn("difference_pp", (F.col("rate_a") - F.col("rate_b")) * 100)
            .withColumn("confirmed", F.col("p_value") < alpha))


def log_rank_statistic(df: DataFrame, dur: str, evt: str, group: str, a, b,
                       bounded: bool = False) -> DataFrame:
    """H5 statistic: Σ(O−E) over event times, variance Σ n₁n₂d(n−d)/(n²(n−1)),
    χ² = (Σ(O−E))²/V; risk sets from suffix sums over distinct durations."""
    t = (df.where(F.col(group).isin(a, b)).groupBy(F.col(dur).alias("_t")).agg(
        F.sum(flag(F.col(group) == a)).cast("long").alias("_c1"),
        F.sum(flag(F.col(group) == b)).cast("long").alias("_c2"),
        F.sum(F.when(F.col(group) == a, F.col(evt)).otherwise(0)).cast("long").alias("_d1"),
        F.sum(F.when(F.col(group) == b, F.col(evt)).otherwise(0)).cast("long").alias("_d2")))
    from ebbflow.operators.ranks import prefix_sums
    r = prefix_sums(t, [("_t", False)], {"_n1": F.col("_c1"), "_n2": F.col("_c2")},
                    bounded=bounded, freeze=True)
    n1, n2 = F.col("_n1").cast("double"), F.col("_n2").cast("double")  # the products outgrow a long
    n = n1 + n2
    d = F.col("_d1") + F.col("_d2")
    e1 = d * n1 / n
    v = F.when(n > 1, n1 * n2 * d * (n - d) / (n * n * (n - 1))).otherwise(0.0)
    g = r.where(d > 0).agg(F.sum(F.col("_d1") - e1).alias("_oe"), F.sum(v).alias("_v"),
                           F.sum("_d1").alias("observed_a"), F.sum(e1).alias("expected_a"))
    return g.select((F.col("_oe") * F.col("_oe") / F.col("_v")).alias("log_rank_chi2"),
                    F.col("observed_a").cast("long").alias("observed_a"), "expected_a")


def log_rank(df: DataFrame, dur: str, evt: str, group: str, a, b,
             bounded: bool = False) -> DataFrame:
    """H5: statistic and p-value (χ², 1 dof)."""
    s = log_rank_statistic(df, dur, evt, group, a, b, bounded)
    return s.withColumn("p_value", chi2_sf_expr("log_rank_chi2", F.lit(1)))
