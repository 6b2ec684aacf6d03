"""Survival analysis (inventory I1–I3, I6–I9).

Everything starts from the life table — one row per (stratum, distinct
duration) — built with one partial aggregation; risk sets are suffix sums over
the durations of each stratum. Kaplan–Meier is a running sum of log factors
(product = exp of the sum), with an explicit zero guard for d = n.
"""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbflow.functions.columns import attach, flag
from ebbflow.operators.ranks import grouped_prefix_sums


def life_table(df: DataFrame, dur: str, evt: str, strata: list[str] | None = None,
               bounded: bool = False) -> DataFrame:
    """(strata…, t, removed, events, censored, at_risk) per distinct duration."""
    strata = strata or []
    g = (df.where(F.col(dur).isNotNull()).groupBy(*strata, F.col(dur).alias("t"))
         .agg(F.count(F.lit(1)).cast("long").alias("removed"),
              F.sum(F.col(evt)).cast("long").alias("events")))
    g = g.withColumn("censored", F.col("removed") - F.col("events"))
    return grouped_prefix_sums(g, strata, [("t", False)], {"at_risk": F.col("removed")},
                               bounded=bounded, freeze=True)


def kaplan_meier(df: DataFrame, dur: str, evt: str, strata: list[str] | None = None,
                 alpha: float = 0.05, bounded: bool = False, digits: int | None = None) -> DataFrame:
    """S(t) = Π_{s≤t}(1 − d_s/n_s) with the exponential-Greenwood
    (log(−log S)) confidence band."""
    strata = strata or []
    lt = life_table(df, dur, evt, strata, bounded)
    d, n = F.col("events"), F.col("at_risk")
    log_f = F.when(d < n, F.log(1 - d / n.cast("double"))).otherwise(F.lit(0.0))
    green = F.when(d < n, d / (n * (n - d)).cast("double")).otherwise(F.lit(0.0))
    cum = grouped_prefix_sums(lt, strata, [("t", True)],
                              {"_log_s": log_f, "_var": green, "_zero": flag(d >= n)},
                              bounded=bounded, freeze=True)
    z = NormalDist().inv_cdf(1 - alpha / 2)
    s = F.when(F.col("_zero") > 0, F.lit(0.0)).otherwise(F.exp(F.col("_log_s")))
    v = F.col("_log_s")
    ok = (F.col("_zero") == 0) & (v < 0)
    lower = F.when(ok, F.exp(-F.exp(F.log(-v) + z * F.sqrt(F.col("_var")) / v)))
    upper = F.when(ok, F.exp(-F.exp(F.log(-v) - z * F.sqrt(F.col("_var")) / v)))
    out = cum.select(*strata, "t", "at_risk", "events", "censored",
                     s.alias("survival"), lower.alias("ci_lower"), upper.alias("ci_upper"))
    if digits is not None:
        out = out.withColumns({c: F.round(c, digits) for c in ("survival", "ci_lower", "ci_upper")})
    return out


def median_survival(km: DataFrame, strata: list[str] | None = None, cap: float = 72,
                    min_n: int = 10) -> DataFrame:
    """First t with S(t) ≤ ½ (never → ``cap``); strata smaller than
    ``min_n`` are skipped."""
    strata = strata or []
    g = km.groupBy(*strata).agg(F.min(F.when(F.col("survival") <= 0.5, F.col("t"))).alias("_m"),
                                F.max("at_risk").alias("n"))
    return (g.where(F.col("n") >= min_n)
            .select(*strata, "n", F.coalesce(F.col("_m").cast("double"), F.lit(float(cap)))
                    .alias("median_survival")))


def naive_survival(df: DataFrame, evt: str = "Churn_binary", by: list[str] | None = None) -> DataFrame:
    """N, events, censored and the naive survival share (n − events)/n."""
    by = by or []
    g = df.groupBy(*by) if by else df.groupBy()
    return g.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(evt)).cast("long").alias("events"),
                 F.sum(flag(F.col(evt) == 0)).cast("long").alias("censored"),
                 ((F.count(F.lit(1)) - F.sum(F.col(evt))).cast("double")
                  / F.count(F.lit(1))).alias("survival_rate"))


# ------------------------------------------------------------------ Cox
import math  # noqa: E402
from dataclasses import dataclass  # noqa: E402

import numpy as np  # noqa: E402
from pyspark.sql import Column  # noqa: E402

from ebbflow.functions.stats import norm_sf  # noqa: E402
from ebbflow.operators.ranks import prefix_sums  # noqa: E402
from ebbflow.session import materialize  # noqa: E402


@dataclass
class CoxModel:
    covariates: list
    means: list
    stds: list
    beta_z: list                     # coefficients on the standardised scale
    se_z: list
    baseline: DataFrame | None = None  # (t, cumulative_hazard) at the distinct durations, z = 0
    loglik: float = 0.0
    iterations: int = 0

    def linear_predictor(self) -> Column:
        """x·β on the standardised scale; null where a covariate is."""
        z = [(F.col(c).cast("double") - m) / (s if s else 1.0)
             for c, m, s in zip(self.covariates, self.means, self.stds)]
        return sum((F.lit(b) * zc for b, zc in zip(self.beta_z, z)), F.lit(0.0))

    def summary(self, spark) -> DataFrame:
        rows = []
        for c, b, se, s in zip(self.covariates, self.beta_z, self.se_z, self.stds):
            coef = b / s if s else 0.0
            se_o = se / s if s else float("nan")
            zval = coef / se_o if se_o else float("nan")
            p = 2 * norm_sf(abs(zval)) if not math.isnan(zval) else float("nan")
            rows.append((c, coef, math.exp(coef), se_o, zval, p,
                         "***" if p < 0.001 else "**" if p < 0.01 else "*" if p < 0.05 else "",
                         "increases risk" if coef > 0 else "reduces risk"))
        df = spark.createDataFrame(rows, "covariate string, coef double, hazard_ratio double, "
                                         "se double, z double, p double, significance string, "
                                         "direction string")
        return df.orderBy(F.desc("hazard_ratio"))


#: Ties up to which Efron's sums are added term by term, and the terms nearest the
#: pole that always are; the rest is an integral with an end correction.
EFRON_DIRECT, EFRON_TAIL = 4096, 1024
_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(64)


def efron_sums(s0: float, e0: float, d: int) -> np.ndarray:
    """Σ over k < d of (ln φ, 1/φ, k/φ, 1/φ², k/φ², k²/φ²) with φ = s0 − k·e0/d.

    The cost does not depend on d: far from the pole at φ = 0 the terms are smooth in
    k, and Σ f(k) over a..b−1 is ∫ f over a−½..b−½ less (f'(b−½) − f'(a−½))/24, the
    integral by Gauss–Legendre in u = ln φ."""
    c = e0 / d

    def terms(k):
        phi = s0 - k * c
        return np.array([np.log(phi), 1 / phi, k / phi, 1 / phi ** 2, k / phi ** 2, k ** 2 / phi ** 2])

    first = 0 if d <= EFRON_DIRECT else d - EFRON_TAIL
    total = terms(np.arange(first, d, dtype=float)).sum(1)
    if first:
        lo, hi = math.log(s0 - (first - 0.5) * c), math.log(s0 + 0.5 * c)
        u = (hi + lo) / 2 + (hi - lo) / 2 * _NODES
        k = (s0 - np.exp(u)) / c
        total += (terms(k) * np.exp(u) * _WEIGHTS).sum(1) * (hi - lo) / 2 / c
        ends = np.array([-0.5, first - 0.5])
        slope = (terms(ends + 1e-3) - terms(ends - 1e-3)) / 2e-3
        total -= (slope[:, 1] - slope[:, 0]) / 24
    return total


def _cox_step(z: DataFrame, p: int, beta: list, dur: str, evt: str) -> tuple[float, np.ndarray, np.ndarray, DataFrame]:
    """Log-likelihood, gradient and Hessian (Efron ties) at ``beta``.

    One grouped aggregation gives per distinct duration Σw, Σw·x, Σw·xxᵀ over all rows
    and over events (w = exp(x·β)); risk sets are suffix sums of that table; each task
    adds up its durations' terms, and only p×p sums come back."""
    xb = sum((F.lit(beta[i]) * F.col(f"_z{i}") for i in range(p)), F.lit(0.0))
    w, e = F.exp(xb), F.col(evt) == 1
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    moment = [w, *[w * F.col(f"_z{i}") for i in range(p)], *[w * F.col(f"_z{i}") * F.col(f"_z{j}") for i, j in pairs]]
    m = len(moment)
    table = z.groupBy(F.col(dur).alias("_t")).agg(
        F.sum(F.when(e, 1).otherwise(0)).alias("_d"), F.sum(F.when(e, xb).otherwise(0.0)).alias("_xb"),
        *[F.sum(x).alias(f"_a{i}") for i, x in enumerate(moment)],
        *[F.sum(F.when(e, x).otherwise(0.0)).alias(f"_e{i}") for i, x in enumerate(moment)],
        *[F.sum(F.when(e, F.col(f"_z{i}")).otherwise(0.0)).alias(f"_x{i}") for i in range(p)])
    risk = prefix_sums(table, [("_t", False)], {f"_s{i}": F.col(f"_a{i}") for i in range(m)}, freeze=True)
    names = ["_d", "_xb", *[f"_s{i}" for i in range(m)], *[f"_e{i}" for i in range(m)], *[f"_x{i}" for i in range(p)]]

    def square(upper: np.ndarray) -> np.ndarray:
        out = np.zeros((p, p))
        for (i, j), v in zip(pairs, upper):
            out[i, j] = out[j, i] = v
        return out

    def partial(batches):
        import pyarrow as pa
        ll, g, h = 0.0, np.zeros(p), np.zeros((p, p))
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in names)):
                d, x = row[0], np.array(row[1:])
                s, ev, xs = x[1:1 + m], x[1 + m:1 + 2 * m], x[1 + 2 * m:]
                log, a1, b1, a2, b2, c2 = efron_sums(s[0], ev[0], d)
                s1, e1 = s[1:1 + p], ev[1:1 + p] / d
                ll += x[0] - log
                g += xs - (s1 * a1 - e1 * b1)
                h -= square(s[1 + p:]) * a1 - square(ev[1 + p:]) / d * b1
                cross = np.outer(s1, e1)
                h += np.outer(s1, s1) * a2 - (cross + cross.T) * b2 + np.outer(e1, e1) * c2
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(1 + p + p * p)), pa.array(np.concatenate([[ll], g, h.ravel()]))], names=["i", "v"])

    total = np.zeros(1 + p + p * p)
    for i, v in (risk.where("_d > 0").select(*names).mapInArrow(partial, "i long, v double")
                 .groupBy("i").agg(F.sum("v")).collect()):  # 1 + p + p² rows
        total[i] = v
    return total[0], total[1:1 + p], total[1 + p:].reshape(p, p), risk


def cox_fit(df: DataFrame, dur: str, evt: str, covariates: list[str], penalizer: float = 0.1,
            max_iter: int = 50, tol: float = 1e-9) -> CoxModel:
    """I4: Cox proportional hazards, Efron ties, L2 penalty on standardised
    covariates; objective = loglik/n − ½·λ·‖β‖². Newton–Raphson on the driver over
    p×p matrices. Rows with a null duration, event or covariate are left out. The
    driver's work depends on p alone; a task's on its distinct durations."""
    p = len(covariates)
    df = df.select(dur, evt, *covariates).dropna()
    mom = df.agg(F.count(F.lit(1)).alias("n"),
                 *[F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(covariates)],
                 *[F.stddev_pop(F.col(c).cast("double")).alias(f"s{i}") for i, c in enumerate(covariates)]
                 ).first()
    n = mom["n"]
    means = [mom[f"m{i}"] or 0.0 for i in range(p)]
    stds = [mom[f"s{i}"] or 0.0 for i in range(p)]
    z = materialize(df.select(F.col(dur), F.col(evt), *[
        ((F.col(c).cast("double") - means[i]) / (stds[i] if stds[i] else 1.0)).alias(f"_z{i}")
        for i, c in enumerate(covariates)]), "cox")
    beta = np.zeros(p)
    objective = lambda ll, b: ll / n - 0.5 * penalizer * float(b @ b)
    ll, g, h, risk = _cox_step(z, p, beta.tolist(), dur, evt)
    it = 0
    for it in range(1, max_iter + 1):
        step = np.linalg.solve(h / n - penalizer * np.eye(p), g / n - penalizer * beta)
        t = 1.0
        while True:
            cand = beta - t * step
            ll_c, g_c, h_c, risk_c = _cox_step(z, p, cand.tolist(), dur, evt)
            if objective(ll_c, cand) >= objective(ll, beta) - 1e-12 or t < 1e-4:
                break
            t /= 2
        done = np.max(np.abs(cand - beta)) < tol
        beta, ll, g, h, risk = cand, ll_c, g_c, h_c, risk_c
        if done:
            break
    se = np.sqrt(np.clip(np.diag(np.linalg.inv(penalizer * n * np.eye(p) - h)), 0, None))
    # Breslow baseline at the mean covariate (z = 0): hazard d(t) / Σ_{risk} w, summed up to t
    hazard = risk.select(F.col("_t").cast("double").alias("t"), (F.col("_d") / F.col("_s0")).alias("_h"))
    baseline = materialize(prefix_sums(hazard, [("t", True)], {"cumulative_hazard": F.col("_h")}, freeze=True)
                           .select("t", "cumulative_hazard"), "baseline")
    return CoxModel(covariates, means, stds, beta.tolist(), se.tolist(), baseline, float(ll), it)


def cox_predict_survival(df: DataFrame, model: CoxModel, times: list[float],
                         prefix: str = "survival_") -> DataFrame:
    """S(t|x) = S₀(t)^exp(x·β) at requested times (in the duration's own
    unit; X8) plus ``churn_prob_<t>`` = 1 − S(t|x), null where a covariate is null.
    The baseline at the requested times is one aggregation of its table."""
    at = model.baseline.agg(*[F.max(F.when(F.col("t") <= t, F.col("cumulative_hazard"))).alias(f"h{i}")
                              for i, t in enumerate(times)]).first()
    out = df.withColumn("_ph", F.exp(model.linear_predictor()))
    cols = {}
    for i, t in enumerate(times):
        name = str(t).rstrip("0").rstrip(".") if isinstance(t, float) else str(t)
        survival = F.exp(F.lit(-(at[f"h{i}"] or 0.0)) * F.col("_ph"))
        cols[f"{prefix}{name}"] = survival
        cols[f"churn_prob_{name}"] = 1 - survival
    return out.withColumns(cols).withColumnRenamed("_ph", "partial_hazard")


def expected_remaining(df: DataFrame, model: CoxModel, tenure: str | None = None,
                       name: str = "expected_months_remaining") -> DataFrame:
    """Σ_t S(t|x) over the baseline times (restricted mean, as the reference);
    with ``tenure`` the conditional form Σ_{t>tenure} S(t|x)/S(tenure|x). Null where a
    covariate is null. The baseline's steps come as one attached array, which an
    ``aggregate`` walks per row on the JVM side."""
    steps = model.baseline.agg(F.array_sort(F.collect_list(F.struct("t", F.col("cumulative_hazard").alias("h")))).alias("_base"))
    df = df.withColumn("_ph", F.exp(model.linear_predictor())).transform(attach, steps)
    if tenure is None:
        total = F.aggregate("_base", F.lit(0.0), lambda acc, b: acc + F.exp(-b["h"] * F.col("_ph")))
        return df.withColumn(name, total).drop("_ph", "_base")
    h_now = F.aggregate("_base", F.lit(0.0), lambda acc, b: F.when(b["t"] <= F.col(tenure), b["h"]).otherwise(acc))
    df = df.withColumn("_s_now", F.exp(-h_now * F.col("_ph")))
    total = F.aggregate("_base", F.lit(0.0), lambda acc, b: acc + F.when(
        b["t"] > F.col(tenure), F.exp(-b["h"] * F.col("_ph"))).otherwise(0.0))
    return df.withColumn(name, F.when(F.col("_s_now") > 0, total / F.col("_s_now"))).drop("_ph", "_s_now", "_base")


def concordance_index(df: DataFrame, dur: str, evt: str, risk: str) -> DataFrame:
    """I8: Harrell's C for a risk score (higher risk ⇒ earlier event): over pairs
    with t_i < t_j and an event at t_i, concordant if risk_i > risk_j, ties ½.

    Exact, for any number of durations: with the durations numbered in order, each
    pair parts at one level of the binary tree over the numbers, where its earlier
    duration is in the left half of a node and the later in the right. So every
    (duration, risk) cell appears once per level, and per node prefix sums over the
    risk count the right half's rows below each event of the left half."""
    cells = (df.where(F.col(dur).isNotNull() & F.col(risk).isNotNull())
             .groupBy(F.col(dur).alias("_t"), F.col(risk).alias("_r"))
             .agg(F.count(F.lit(1)).alias("_n"), F.sum(F.when(F.col(evt) == 1, 1).otherwise(0)).alias("_d")))
    cells = materialize(cells, "cells")
    numbered = prefix_sums(cells.select("_t").distinct(), [("_t", True)], {"_k": F.lit(1).cast("long")})
    times = cells.agg(F.count_distinct("_t")).first()[0]
    levels = max(1, (times - 1).bit_length())
    k = F.col("_k") - 1
    tree = (cells.join(numbered, "_t").withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))
            .withColumn("_node", F.call_function("shiftright", k, F.col("_level") + 1))
            .withColumn("_right", F.call_function("shiftright", k, F.col("_level")).bitwiseAND(F.lit(1).cast("long")) == 1))
    by_risk = materialize(tree.groupBy("_level", "_node", "_r").agg(
        F.sum(F.when(F.col("_right"), F.col("_n")).otherwise(0)).alias("_later"),
        F.sum(F.when(F.col("_right"), 0).otherwise(F.col("_d"))).alias("_events")), "levels")  # read by both sums
    cum = grouped_prefix_sums(by_risk, ["_level", "_node"], [("_r", True)], {"_upto": F.col("_later")})
    node = by_risk.groupBy("_level", "_node").agg((F.sum("_events") * F.sum("_later")).alias("_pairs"))
    conc = cum.agg(F.sum(F.col("_events") * (2 * F.col("_upto") - F.col("_later"))).alias("_conc2"))
    pairs = node.agg(F.sum("_pairs").alias("comparable_pairs"))
    return conc.transform(attach, pairs).select(
        (F.col("_conc2").cast("double") / (F.col("comparable_pairs") * 2).cast("double")).alias("concordance_index"),
        F.coalesce("comparable_pairs", F.lit(0)).cast("long").alias("comparable_pairs"))
