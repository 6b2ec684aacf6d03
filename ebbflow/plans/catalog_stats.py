"""Registered hypothesis-test, survival and experiment queries with oracles.

Statistics that are sums of non-integers are compared after ``round(·, 9)``;
p-values need distribution functions DuckDB lacks, so queries that carry them
are registered without an oracle next to a statistic-only twin that has one.
"""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import functions as F

from ebbflow.operators import experiment as L
from ebbflow.operators import hypothesis as H
from ebbflow.operators import survival as I
from ebbflow.plans import datasets as D
from ebbflow.plans.oracle_base import erfc_sql, ks_p_sql, norm_p_sql
from ebbflow.plans.oracle_features import on_customers

# The same normal quantiles the DataFrame code uses, as exact SQL literals.
Z975 = repr(NormalDist().inv_cdf(0.975))
Z80 = repr(NormalDist().inv_cdf(0.80))


def _c(fn):
    return lambda spark, sf: fn(D.customers(spark, sf))


def _chi(a, b):
    def q(spark, sf):
        s = H.chi2_statistic(D.customers(spark, sf), a, b)
        return s.select(F.round("chi2", 9).alias("chi2"), "dof", "n")
    return q


def _chi_body(a, b, yates, digits=9):
    corr = "abs(o - e) - least(0.5::DOUBLE, abs(o - e))" if yates else "abs(o - e)"
    stat = f"SUM(({corr}) * ({corr}) / e)"
    if digits is not None:
        stat = f"round({stat}, {digits})"
    return f"""
SELECT {stat} AS chi2,
       CAST((COUNT(DISTINCT av) - 1) * (COUNT(DISTINCT bv) - 1) AS BIGINT) AS dof,
       CAST(max(n) AS BIGINT) AS n
FROM (SELECT av, bv, CAST(o AS DOUBLE) AS o, rt * ct / CAST(n AS DOUBLE) AS e, n
      FROM (SELECT av, bv, coalesce(cnt, 0) AS o,
                   SUM(coalesce(cnt, 0)) OVER (PARTITION BY av) AS rt,
                   SUM(coalesce(cnt, 0)) OVER (PARTITION BY bv) AS ct,
                   SUM(coalesce(cnt, 0)) OVER () AS n
            FROM (SELECT DISTINCT {a} AS av FROM customers)
            CROSS JOIN (SELECT DISTINCT {b} AS bv FROM customers)
            LEFT JOIN (SELECT {a} AS a2, {b} AS b2, COUNT(*) AS cnt FROM customers GROUP BY 1, 2)
              ON av = a2 AND bv = b2))"""


def _chi_sql(a, b, yates):
    return on_customers(_chi_body(a, b, yates))


def q_suite_stats(spark, sf):
    r = H.hypothesis_suite(D.customers(spark, sf))
    return r.select("hypothesis", "rate_a", "rate_b", F.round("chi2", 9).alias("chi2"), "dof", "n",
                    "difference_pp")


# (hypothesis, column, level a, level b, Yates): written out here, not taken from the code
_SUITE = [("month_to_month", "is_month_to_month", "1", "0", True),
          ("single_service", "is_single_service", "1", "0", True),
          ("fiber_internet", "InternetService", "Fiber optic", "DSL", False),
          ("high_charge", "is_high_charger", "1", "0", True),
          ("new_customer", "is_new_customer", "1", "0", True)]


def _suite_parts():
    parts = []
    for name, col, lv_a, lv_b, yates in _SUITE:
        rate = lambda lv: (f"CAST(SUM(CASE WHEN CAST({col} AS VARCHAR) = '{lv}' THEN Churn_binary END) AS DOUBLE) "  # noqa: E731, B023
                           f"/ SUM(CAST(CAST({col} AS VARCHAR) = '{lv}' AS INTEGER))")  # noqa: B023
        parts.append(f"""SELECT '{name}' AS hypothesis, r.ra AS rate_a, r.rb AS rate_b, c.chi2, c.dof, c.n,
       (r.ra - r.rb) * 100 AS difference_pp
FROM (SELECT {rate(lv_a)} AS ra, {rate(lv_b)} AS rb FROM customers) r,
     ({_chi_body(col, "Churn_binary", yates=yates, digits=None)}) c""")
    return "\nUNION ALL\n".join(parts)


def _suite_sql():
    return on_customers(f"""
SELECT hypothesis, rate_a, rate_b, round(chi2, 9) AS chi2, dof, n, difference_pp FROM ({_suite_parts()})""")


def q_suite(spark, sf):
    r = H.hypothesis_suite(D.customers(spark, sf))
    return r.select("hypothesis", "rate_a", "rate_b", F.round("chi2", 9).alias("chi2"), "dof", "n",
                    F.round("p_value", 9).alias("p_value"), "difference_pp", "confirmed")


SQL_SUITE = on_customers(f"""
SELECT hypothesis, rate_a, rate_b, round(chi2, 9) AS chi2, dof, n, round(p, 9) AS p_value, difference_pp,
       p < 0.05 AS confirmed
FROM (SELECT *, CASE WHEN dof = 1 THEN {erfc_sql("sqrt(chi2 / 2)")} ELSE exp(-chi2 / 2) END AS p
      FROM ({_suite_parts()}))""")


def q_z_stats(spark, sf):
    r = H.two_proportion_z(D.customers(spark, sf), "has_auto_pay", "Churn_binary", 1, 0)
    return r.select("n1", "n2", "x1", "x2", "rate_1", "rate_2", F.round("z", 9).alias("z"))


SQL_Z_STATS = on_customers("""
SELECT n1, n2, x1, x2, r1 AS rate_1, r2 AS rate_2,
       round((r1 - r2) / sqrt(pool * (1 - pool) * (1 / n1 + 1 / n2)), 9) AS z
FROM (SELECT *, x1 / CAST(n1 AS DOUBLE) AS r1, x2 / CAST(n2 AS DOUBLE) AS r2,
             (x1 + x2) / CAST(n1 + n2 AS DOUBLE) AS pool
      FROM (SELECT CAST(SUM(CAST(has_auto_pay = 1 AS INTEGER)) AS BIGINT) AS n1,
                   CAST(SUM(CAST(has_auto_pay = 0 AS INTEGER)) AS BIGINT) AS n2,
                   CAST(SUM(CASE WHEN has_auto_pay = 1 THEN Churn_binary ELSE 0 END) AS BIGINT) AS x1,
                   CAST(SUM(CASE WHEN has_auto_pay = 0 THEN Churn_binary ELSE 0 END) AS BIGINT) AS x2
            FROM customers))""")


def q_z(spark, sf):
    r = H.two_proportion_z(D.customers(spark, sf), "has_auto_pay", "Churn_binary", 1, 0)
    return r.withColumn("z", F.round("z", 9)).withColumn("p_value", F.round("p_value", 9))


SQL_Z = on_customers(f"""
SELECT n1, n2, x1, x2, r1 AS rate_1, r2 AS rate_2, round(z, 9) AS z, round({norm_p_sql("z")}, 9) AS p_value
FROM (SELECT *, (r1 - r2) / sqrt(pool * (1 - pool) * (1 / n1 + 1 / n2)) AS z
      FROM (SELECT *, x1 / CAST(n1 AS DOUBLE) AS r1, x2 / CAST(n2 AS DOUBLE) AS r2,
                   (x1 + x2) / CAST(n1 + n2 AS DOUBLE) AS pool
            FROM (SELECT CAST(SUM(CAST(has_auto_pay = 1 AS INTEGER)) AS BIGINT) AS n1,
                         CAST(SUM(CAST(has_auto_pay = 0 AS INTEGER)) AS BIGINT) AS n2,
                         CAST(SUM(CASE WHEN has_auto_pay = 1 THEN Churn_binary ELSE 0 END) AS BIGINT) AS x1,
                         CAST(SUM(CASE WHEN has_auto_pay = 0 THEN Churn_binary ELSE 0 END) AS BIGINT) AS x2
                  FROM customers)))""")


def q_chi_internet(spark, sf):
    """3×2 table: dof 2, so the p-value is exp(−χ²/2) and SQL can check it."""
    r = H.chi2_independence(D.customers(spark, sf), "InternetService", "Churn_binary")
    return r.select(F.round("chi2", 9).alias("chi2"), "dof", "n", F.round("p_value", 9).alias("p_value"))


SQL_CHI_INTERNET = on_customers(
    "SELECT round(chi2, 9) AS chi2, dof, n, round(exp(-chi2 / 2), 9) AS p_value FROM chi",
    "chi AS (" + _chi_body("InternetService", "Churn_binary", yates=False, digits=None) + ")")


def q_ks(spark, sf):
    return H.ks_statistic(D.customers(spark, sf), "monthly_cents", "Churn_binary", 1, 0)


SQL_KS = on_customers("""
SELECT CAST(max(abs(cum_a * n_b - cum_b * n_a)) AS DOUBLE) / CAST(max(n_a) * max(n_b) AS DOUBLE)
         AS ks_statistic, CAST(max(n_a) AS BIGINT) AS n_a, CAST(max(n_b) AS BIGINT) AS n_b
FROM (SELECT SUM(ca) OVER w AS cum_a, SUM(cb) OVER w AS cum_b,
             SUM(ca) OVER () AS n_a, SUM(cb) OVER () AS n_b
      FROM (SELECT monthly_cents AS v, SUM(CAST(Churn_binary = 1 AS BIGINT)) AS ca,
                   SUM(CAST(Churn_binary = 0 AS BIGINT)) AS cb FROM customers GROUP BY 1)
      WINDOW w AS (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""")


def q_ks_tenure(spark, sf):
    r = H.ks_two_sample(D.customers(spark, sf), "tenure", "Churn_binary", 1, 0)
    return r.withColumn("ks_p_value", F.round("ks_p_value", 9))


SQL_KS_TENURE = on_customers(f"""
SELECT ks_statistic, n_a, n_b,
  round({ks_p_sql("ks_statistic", "CAST(n_a AS DOUBLE)", "CAST(n_b AS DOUBLE)")}, 9) AS ks_p_value
FROM ks""", """
ks AS (
SELECT CAST(max(abs(cum_a * n_b - cum_b * n_a)) AS DOUBLE) / CAST(max(n_a) * max(n_b) AS DOUBLE)
         AS ks_statistic, CAST(max(n_a) AS BIGINT) AS n_a, CAST(max(n_b) AS BIGINT) AS n_b
FROM (SELECT SUM(ca) OVER w AS cum_a, SUM(cb) OVER w AS cum_b,
             SUM(ca) OVER () AS n_a, SUM(cb) OVER () AS n_b
      FROM (SELECT tenure AS v, SUM(CAST(Churn_binary = 1 AS BIGINT)) AS ca,
                   SUM(CAST(Churn_binary = 0 AS BIGINT)) AS cb FROM customers GROUP BY 1)
      WINDOW w AS (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)))""")


def q_log_rank(spark, sf):
    s = H.log_rank_statistic(D.customers(spark, sf), "tenure", "Churn_binary", "Contract",
                             "Month-to-month", "Two year", bounded=True)
    return s.select(F.round("log_rank_chi2", 9).alias("log_rank_chi2"), "observed_a",
                    F.round("expected_a", 9).alias("expected_a"))


SQL_LOG_RANK = on_customers("""
SELECT round(oe * oe / v, 9) AS log_rank_chi2, CAST(o1 AS BIGINT) AS observed_a,
       round(e1s, 9) AS expected_a
FROM (SELECT SUM(d1 - e1) AS oe, SUM(v) AS v, SUM(d1) AS o1, SUM(e1) AS e1s
      FROM (SELECT d1, d1 + d2 AS d, (d1 + d2) * n1 / CAST(n1 + n2 AS DOUBLE) AS e1,
              CASE WHEN n1 + n2 > 1 THEN n1 * n2 * (d1 + d2) * (n1 + n2 - d1 - d2)
                   / CAST((n1 + n2) * (n1 + n2) * (n1 + n2 - 1) AS DOUBLE) ELSE 0.0 END AS v
            FROM (SELECT *, SUM(c1) OVER w AS n1, SUM(c2) OVER w AS n2
                  FROM (SELECT tenure AS t,
                          SUM(CAST(Contract = 'Month-to-month' AS BIGINT)) AS c1,
                          SUM(CAST(Contract = 'Two year' AS BIGINT)) AS c2,
                          SUM(CASE WHEN Contract = 'Month-to-month' THEN Churn_binary ELSE 0 END) AS d1,
                          SUM(CASE WHEN Contract = 'Two year' THEN Churn_binary ELSE 0 END) AS d2
                        FROM customers WHERE Contract IN ('Month-to-month', 'Two year') GROUP BY 1)
                  WINDOW w AS (ORDER BY t DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)))
      WHERE d > 0)""")


def q_log_rank_p(spark, sf):
    r = H.log_rank(D.customers(spark, sf), "tenure", "Churn_binary", "Contract", "Month-to-month", "Two year")
    return r.select(F.round("log_rank_chi2", 6).alias("log_rank_chi2"), "observed_a",
                    F.round("expected_a", 6).alias("expected_a"), F.round("p_value", 9).alias("p_value"))


_LOG_RANK_FROM = SQL_LOG_RANK[SQL_LOG_RANK.index("FROM (SELECT SUM(d1 - e1)"):]
SQL_LOG_RANK_P = SQL_LOG_RANK[:SQL_LOG_RANK.index("SELECT round(oe * oe / v, 9)")] + f"""
SELECT round(oe * oe / v, 6) AS log_rank_chi2, CAST(o1 AS BIGINT) AS observed_a, round(e1s, 6) AS expected_a,
       round({erfc_sql("sqrt(oe * oe / v / 2)")}, 9) AS p_value
{_LOG_RANK_FROM}"""


LIFE_CTE = """
lt AS (
  SELECT Contract, t, removed, events, removed - events AS censored,
    SUM(removed) OVER (PARTITION BY Contract ORDER BY t DESC
                       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS at_risk
  FROM (SELECT Contract, tenure AS t, COUNT(*) AS removed, SUM(Churn_binary) AS events
        FROM customers GROUP BY 1, 2)),
km AS (
  SELECT *, CASE WHEN zero > 0 THEN 0.0::DOUBLE ELSE exp(log_s) END AS survival,
    CASE WHEN zero = 0 AND log_s < 0
         THEN exp(-exp(ln(-log_s) + {Z975}::DOUBLE * sqrt(var) / log_s)) END AS ci_lower,
    CASE WHEN zero = 0 AND log_s < 0
         THEN exp(-exp(ln(-log_s) - {Z975}::DOUBLE * sqrt(var) / log_s)) END AS ci_upper
  FROM (SELECT *,
          SUM(CASE WHEN events < at_risk THEN ln(1 - events / CAST(at_risk AS DOUBLE)) ELSE 0.0 END)
            OVER w AS log_s,
          SUM(CASE WHEN events < at_risk THEN events / CAST(at_risk * (at_risk - events) AS DOUBLE)
                   ELSE 0.0 END) OVER w AS var,
          SUM(CAST(events >= at_risk AS INTEGER)) OVER w AS zero
        FROM lt
        WINDOW w AS (PARTITION BY Contract ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)))
""".replace("{Z975}", Z975)

SQL_LIFE = on_customers("""
SELECT Contract, t, CAST(removed AS BIGINT) AS removed, CAST(events AS BIGINT) AS events,
       CAST(censored AS BIGINT) AS censored, CAST(at_risk AS BIGINT) AS at_risk FROM lt""", LIFE_CTE)

SQL_KM = on_customers("""
SELECT Contract, t, CAST(at_risk AS BIGINT) AS at_risk, CAST(events AS BIGINT) AS events,
       CAST(censored AS BIGINT) AS censored, round(survival, 10) AS survival,
       round(ci_lower, 10) AS ci_lower, round(ci_upper, 10) AS ci_upper FROM km""", LIFE_CTE)

SQL_MEDIAN = on_customers("""
SELECT Contract, CAST(max(at_risk) AS BIGINT) AS n,
       coalesce(CAST(min(CASE WHEN survival <= 0.5 THEN t END) AS DOUBLE), 72.0::DOUBLE) AS median_survival
FROM km GROUP BY Contract HAVING max(at_risk) >= 10""", LIFE_CTE)

SQL_NAIVE = on_customers("""
SELECT Contract, COUNT(*) AS n, CAST(SUM(Churn_binary) AS BIGINT) AS events,
  CAST(SUM(CAST(Churn_binary = 0 AS INTEGER)) AS BIGINT) AS censored,
  CAST(COUNT(*) - SUM(Churn_binary) AS DOUBLE) / COUNT(*) AS survival_rate
FROM customers GROUP BY Contract""")


def _km(spark, sf):
    return I.kaplan_meier(D.customers(spark, sf), "tenure", "Churn_binary", ["Contract"],
                          bounded=True, digits=10)


def _by_internet(sql):
    return sql.replace("Contract", "InternetService")


_LIFE_INTERNET = _by_internet(LIFE_CTE)
SQL_LIFE_INTERNET = on_customers("""
SELECT InternetService, t, CAST(removed AS BIGINT) AS removed, CAST(events AS BIGINT) AS events,
       CAST(censored AS BIGINT) AS censored, CAST(at_risk AS BIGINT) AS at_risk FROM lt""", _LIFE_INTERNET)
SQL_KM_INTERNET = on_customers("""
SELECT InternetService, t, CAST(at_risk AS BIGINT) AS at_risk, CAST(events AS BIGINT) AS events,
       CAST(censored AS BIGINT) AS censored, round(survival, 6) AS survival,
       round(ci_lower, 6) AS ci_lower, round(ci_upper, 6) AS ci_upper FROM km""", _LIFE_INTERNET)
SQL_MEDIAN_INTERNET = on_customers("""
SELECT InternetService, CAST(max(at_risk) AS BIGINT) AS n,
       coalesce(CAST(min(CASE WHEN survival <= 0.5 THEN t END) AS DOUBLE), 72.0::DOUBLE) AS median_survival
FROM km GROUP BY InternetService HAVING max(at_risk) >= 10""", _LIFE_INTERNET)
SQL_NAIVE_ALL = on_customers("""
SELECT COUNT(*) AS n, CAST(SUM(Churn_binary) AS BIGINT) AS events,
  CAST(SUM(CAST(Churn_binary = 0 AS INTEGER)) AS BIGINT) AS censored,
  CAST(COUNT(*) - SUM(Churn_binary) AS DOUBLE) / COUNT(*) AS survival_rate FROM customers""")


def _km_internet(spark, sf):
    """By the path for any number of durations."""
    return I.kaplan_meier(D.customers(spark, sf), "tenure", "Churn_binary", ["InternetService"], digits=10)


def q_km_internet(spark, sf):
    km = _km_internet(spark, sf)
    return km.withColumns({c: F.round(c, 6) for c in ("survival", "ci_lower", "ci_upper")})


EXP_CTE = """
pool AS (SELECT *, date_diff('day', DATE '1970-01-01', CAST(start_date AS DATE)) AS day
         FROM customers WHERE churn_probability >= 0.3),
expt AS (
  SELECT *, CASE WHEN customer_id % 2 = 0 THEN 'control' ELSE 'treatment' END AS "group",
         CASE WHEN day <= (SELECT quantile_cont(day, 0.5) FROM pool) THEN 'pre' ELSE 'post' END AS period,
         Churn_binary AS churned
  FROM pool)"""


def _expt(spark, sf):
    return L.experiment_frame(D.customers(spark, sf))


SQL_POOL = on_customers("""
SELECT COUNT(*) AS pool_size, CAST(SUM(monthly_cents) AS DOUBLE) / 100.0::DOUBLE AS pool_mrr
FROM customers WHERE churn_probability >= 0.3""")

SQL_POWER = on_customers(f"""
SELECT effect_size, p_control, p_control * (1 - effect_size) AS p_treatment,
  CAST(ceil(num * num / ((p_control - p_control * (1 - effect_size))
                       * (p_control - p_control * (1 - effect_size)))) AS BIGINT) AS n_per_arm,
  CAST(ceil(num * num / ((p_control - p_control * (1 - effect_size))
                       * (p_control - p_control * (1 - effect_size)))) AS BIGINT) * 2 AS total_n,
  CAST(ceil(num * num / ((p_control - p_control * (1 - effect_size))
                       * (p_control - p_control * (1 - effect_size)))) AS BIGINT) * 2 <= pool_n AS feasible
FROM (SELECT e.effect_size, b.p_control, b.pool_n,
        {Z975}::DOUBLE * sqrt((b.p_control + b.p_control * (1 - e.effect_size)) / 2
             * (1 - (b.p_control + b.p_control * (1 - e.effect_size)) / 2) * 2)
        + {Z80}::DOUBLE * sqrt(b.p_control * (1 - b.p_control)
             + b.p_control * (1 - e.effect_size) * (1 - b.p_control * (1 - e.effect_size))) AS num
      FROM (SELECT unnest([0.05::DOUBLE, 0.1::DOUBLE, 0.15::DOUBLE, 0.2::DOUBLE]) AS effect_size) e
      CROSS JOIN (SELECT avg(CAST(Churn_binary AS DOUBLE)) AS p_control,
                         (SELECT COUNT(*) FROM customers WHERE churn_probability >= 0.3) AS pool_n
                  FROM customers) b)""")


def q_power(spark, sf):
    c = D.customers(spark, sf)
    return L.power_table(c, pool=c.where(F.col("churn_probability") >= 0.3))


READOUT_COLS = ["n_control", "n_treatment", "x_control", "x_treatment", "control_rate",
                "treatment_rate", "absolute_reduction", "relative_reduction", "chi2", "z",
                "control_mrr_lost", "treatment_mrr_lost", "mrr_saved", "annual_saved"]


def q_readout_stats(spark, sf):
    r = L.ab_readout(_expt(spark, sf))
    return r.select(*[F.round(c, 9).alias(c) if c in ("chi2", "z") else F.col(c)
                      for c in READOUT_COLS])


def _yates(o, e):
    d = f"abs(({o}) - ({e}))"
    return f"(({d} - least(0.5::DOUBLE, {d})) * ({d} - least(0.5::DOUBLE, {d})) / ({e}))"


_N = "CAST(n_control + n_treatment AS DOUBLE)"
_CHI_READOUT = " + ".join([
    _yates("x_control", f"n_control * (x_control + x_treatment) / {_N}"),
    _yates("n_control - x_control",
           f"n_control * (n_control + n_treatment - x_control - x_treatment) / {_N}"),
    _yates("x_treatment", f"n_treatment * (x_control + x_treatment) / {_N}"),
    _yates("n_treatment - x_treatment",
           f"n_treatment * (n_control + n_treatment - x_control - x_treatment) / {_N}"),
])

SQL_READOUT = on_customers(f"""
SELECT n_control, n_treatment, x_control, x_treatment, r1 AS control_rate, r2 AS treatment_rate,
  r1 - r2 AS absolute_reduction, (r1 - r2) / r1 AS relative_reduction,
  round({_CHI_READOUT}, 9) AS chi2,
  round((r1 - r2) / sqrt(pool * (1 - pool) * (1 / n_control + 1 / n_treatment)), 9) AS z,
  CAST(lc AS DOUBLE) / 100 AS control_mrr_lost, CAST(lt AS DOUBLE) / 100 AS treatment_mrr_lost,
  CAST(lc - lt AS DOUBLE) / 100 AS mrr_saved, CAST((lc - lt) * 12 AS DOUBLE) / 100 AS annual_saved
FROM (SELECT *, x_control / CAST(n_control AS DOUBLE) AS r1,
        x_treatment / CAST(n_treatment AS DOUBLE) AS r2,
        (x_control + x_treatment) / CAST(n_control + n_treatment AS DOUBLE) AS pool
      FROM (SELECT CAST(SUM(CAST("group" = 'control' AS INTEGER)) AS BIGINT) AS n_control,
                   CAST(SUM(CAST("group" = 'treatment' AS INTEGER)) AS BIGINT) AS n_treatment,
                   CAST(SUM(CASE WHEN "group" = 'control' THEN churned ELSE 0 END) AS BIGINT) AS x_control,
                   CAST(SUM(CASE WHEN "group" = 'treatment' THEN churned ELSE 0 END) AS BIGINT) AS x_treatment,
                   SUM(CASE WHEN "group" = 'control' THEN churned * monthly_cents ELSE 0 END) AS lc,
                   SUM(CASE WHEN "group" = 'treatment' THEN churned * monthly_cents ELSE 0 END) AS lt
            FROM expt))""", EXP_CTE)

def q_readout(spark, sf):
    r = L.ab_readout(_expt(spark, sf))
    return r.select(*[F.round(c, 9).alias(c) if c in ("chi2", "z", "p_chi2", "p_z") else F.col(c)
                      for c in [*READOUT_COLS, "p_chi2", "p_z", "significant"]])


_READ = SQL_READOUT[:SQL_READOUT.index("SELECT n_control, n_treatment, x_control")]
_READ_BODY = SQL_READOUT[len(_READ):]
SQL_READOUT_P = _READ + f"""
SELECT * EXCLUDE (chi2, z), round(chi2, 9) AS chi2, round(z, 9) AS z, round({erfc_sql("sqrt(chi2 / 2)")}, 9) AS p_chi2,
       round({norm_p_sql("z")}, 9) AS p_z, {norm_p_sql("z")} < 0.05 AS significant
FROM ({_READ_BODY.replace(f"round({_CHI_READOUT}, 9) AS chi2", f"{_CHI_READOUT} AS chi2").replace(
    "round((r1 - r2) / sqrt(pool * (1 - pool) * (1 / n_control + 1 / n_treatment)), 9) AS z",
    "(r1 - r2) / sqrt(pool * (1 - pool) * (1 / n_control + 1 / n_treatment)) AS z")})"""

SQL_DID = on_customers("""
SELECT control_pre, control_post, treatment_pre, treatment_post,
  (treatment_post - treatment_pre) - (control_post - control_pre) AS did_estimate,
  treatment_pre + (control_post - control_pre) AS counterfactual_post
FROM (SELECT
  CAST(SUM(CASE WHEN "group" = 'control' AND period = 'pre' THEN churned END) AS DOUBLE)
    / SUM(CASE WHEN "group" = 'control' AND period = 'pre' THEN 1 END) AS control_pre,
  CAST(SUM(CASE WHEN "group" = 'control' AND period = 'post' THEN churned END) AS DOUBLE)
    / SUM(CASE WHEN "group" = 'control' AND period = 'post' THEN 1 END) AS control_post,
  CAST(SUM(CASE WHEN "group" = 'treatment' AND period = 'pre' THEN churned END) AS DOUBLE)
    / SUM(CASE WHEN "group" = 'treatment' AND period = 'pre' THEN 1 END) AS treatment_pre,
  CAST(SUM(CASE WHEN "group" = 'treatment' AND period = 'post' THEN churned END) AS DOUBLE)
    / SUM(CASE WHEN "group" = 'treatment' AND period = 'post' THEN 1 END) AS treatment_post
  FROM expt)""", EXP_CTE)

SQL_SEGMENT_READOUT = on_customers("""
SELECT Contract, n_control, n_treatment, xc / CAST(n_control AS DOUBLE) AS control_rate,
       xt / CAST(n_treatment AS DOUBLE) AS treatment_rate
FROM (SELECT Contract, CAST(SUM(CAST("group" = 'control' AS INTEGER)) AS BIGINT) AS n_control,
        CAST(SUM(CAST("group" = 'treatment' AS INTEGER)) AS BIGINT) AS n_treatment,
        SUM(CASE WHEN "group" = 'control' THEN churned ELSE 0 END) AS xc,
        SUM(CASE WHEN "group" = 'treatment' THEN churned ELSE 0 END) AS xt
      FROM expt GROUP BY Contract)
WHERE n_control > 5 AND n_treatment > 5""", EXP_CTE)


QUERIES = {
    "chi2_contract_churn": (_chi("Contract", "Churn_binary"),
                            _chi_sql("Contract", "Churn_binary", yates=False)),
    "chi2_autopay_churn": (_chi("has_auto_pay", "Churn_binary"),
                           _chi_sql("has_auto_pay", "Churn_binary", yates=True)),
    "chi2_independence_internet": (q_chi_internet, SQL_CHI_INTERNET),
    "hypothesis_suite": (q_suite, SQL_SUITE),
    "hypothesis_suite_stats": (q_suite_stats, _suite_sql()),
    "ks_monthly_by_churn": (q_ks, SQL_KS),
    "ks_two_sample_tenure": (q_ks_tenure, SQL_KS_TENURE),
    "two_proportion_z_stats": (q_z_stats, SQL_Z_STATS),
    "two_proportion_z_autopay": (q_z, SQL_Z),
    "log_rank_contract": (q_log_rank, SQL_LOG_RANK),
    "log_rank_contract_p": (q_log_rank_p, SQL_LOG_RANK_P),
    "life_table_contract": (_c(lambda d: I.life_table(d, "tenure", "Churn_binary", ["Contract"],
                                                      bounded=True)), SQL_LIFE),
    "kaplan_meier_contract": (_km, SQL_KM),
    "median_survival_contract": (lambda spark, sf: I.median_survival(_km(spark, sf), ["Contract"]),
                                 SQL_MEDIAN),
    "naive_survival_contract": (_c(lambda d: I.naive_survival(d, by=["Contract"])), SQL_NAIVE),
    "life_table_internet": (_c(lambda d: I.life_table(d, "tenure", "Churn_binary", ["InternetService"])),
                            SQL_LIFE_INTERNET),
    "kaplan_meier_internet": (q_km_internet, SQL_KM_INTERNET),
    "median_survival_internet": (lambda spark, sf: I.median_survival(_km_internet(spark, sf), ["InternetService"]),
                                 SQL_MEDIAN_INTERNET),
    "naive_survival_overall": (_c(I.naive_survival), SQL_NAIVE_ALL),
    "eligible_pool": (_c(L.eligible_pool), SQL_POOL),
    "power_table": (q_power, SQL_POWER),
    "ab_readout_stats": (q_readout_stats, SQL_READOUT),
    "ab_readout": (q_readout, SQL_READOUT_P),
    "ab_readout_hash_arms": (lambda spark, sf: L.ab_readout(
        L.experiment_frame(D.customers(spark, sf), method="hash_rank")), None),
    "did": (lambda spark, sf: L.did(_expt(spark, sf)), SQL_DID),
    "segment_readout": (lambda spark, sf: L.segment_readout(_expt(spark, sf)), SQL_SEGMENT_READOUT),
}
