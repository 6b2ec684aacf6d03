"""Registered certificates of fitted results.

A fit has no closed SQL form, but its optimality does: each query evaluates the
conditions that the returned result must meet over all rows, and the oracle lists the
conditions as met. A wrong fit fails them.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbflow.operators import archetypes as J
from ebbflow.operators import evaluate as K
from ebbflow.operators import experiment as L
from ebbflow.operators import models as Mo
from ebbflow.operators import segments as S
from ebbflow.operators import select as Sel
from ebbflow.operators import survival as I
from ebbflow.operators.ranks import prefix_sums
from ebbflow.plans import catalog_models as CM
from ebbflow.plans import datasets as D
from ebbflow.plans.oracle_features import on_customers


def _all_true(names: list[str], column: str) -> str:
    return f"SELECT {column}, true AS holds FROM (VALUES {', '.join(f'({chr(39)}{n}{chr(39)})' for n in names)}) v({column})"


def _rows(frame: DataFrame, conditions: dict, column: str) -> DataFrame:
    """One row for each condition (an aggregate over ``frame``)."""
    pairs = F.array(*[F.struct(F.lit(n).alias(column), c.alias("holds")) for n, c in conditions.items()])
    return frame.agg(pairs.alias("p")).select(F.inline("p"))


# ------------------------------------------------------------------ Cox
def q_cox(spark, sf):
    """The penalised score of the partial likelihood (Efron ties, term by term) is zero at the estimate."""
    c = D.customers(spark, sf)
    penalty, names = 0.1, CM.COX_COVARIATES
    m = I.cox_fit(c, "tenure", "Churn_binary", names, penalizer=penalty)
    z = [(F.col(x).cast("double") - mean) / (sd if sd else 1.0) for x, mean, sd in zip(names, m.means, m.stds)]
    rows = c.select("tenure", "Churn_binary", *[e.alias(f"z{i}") for i, e in enumerate(z)])
    weight = F.exp(sum((F.lit(b) * F.col(f"z{i}") for i, b in enumerate(m.beta_z)), F.lit(0.0)))
    rows = rows.withColumn("w", weight)
    event = lambda x: F.sum(F.when(F.col("Churn_binary") == 1, x).otherwise(0.0))
    parts = range(len(names))
    table = rows.groupBy("tenure").agg(
        F.count(F.lit(1)).alias("n"), F.sum("Churn_binary").cast("long").alias("d"), F.sum("w").alias("s"), event(F.col("w")).alias("e"),
        *[F.sum(F.col("w") * F.col(f"z{i}")).alias(f"s{i}") for i in parts], *[event(F.col("w") * F.col(f"z{i}")).alias(f"e{i}") for i in parts],
        *[event(F.col(f"z{i}")).alias(f"x{i}") for i in parts])
    risk = prefix_sums(table, [("tenure", False)], {"r": F.col("s")} | {f"r{i}": F.col(f"s{i}") for i in parts}, freeze=True)
    share = F.col("k") / F.col("d")
    terms = risk.where("d > 0").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("d") - 1)).alias("k"))
    drawn = terms.agg(*[F.sum((F.col(f"r{i}") - share * F.col(f"e{i}")) / (F.col("r") - share * F.col("e"))).alias(f"m{i}") for i in parts])
    whole = table.agg(F.sum("n").alias("n"), *[F.sum(f"x{i}").alias(f"x{i}") for i in parts]).crossJoin(F.broadcast(drawn))  # one row each
    score = lambda i: F.max((F.col(f"x{i}") - F.col(f"m{i}")) / F.col("n") - F.lit(penalty * m.beta_z[i]))
    return _rows(whole, {x: F.abs(score(i)) < 1e-7 for i, x in enumerate(names)}, "covariate")


# ------------------------------------------------------------------ logistic regression
LOGISTIC = ["tenure", "MonthlyCharges", "service_adoption_score", "is_month_to_month", "has_fiber"]


def q_logistic(spark, sf):
    """The weighted score is zero for the intercept and each feature: residuals sum to zero against them."""
    c = D.customers(spark, sf)
    m = Mo.train_logistic(c, LOGISTIC)
    scored = K.with_class_weight(Mo.predict(m, c.select("customer_id", "Churn_binary", *LOGISTIC)))
    residual = F.col("weight") * (F.col("Churn_binary") - F.col("churn_probability"))
    zero = lambda x: F.abs(F.sum(residual * x) / F.sum("weight") / F.greatest(F.max(F.abs(x)), F.lit(1.0))) < 1e-4
    return _rows(scored, {"intercept": zero(F.lit(1.0))} | {x: zero(F.col(x).cast("double")) for x in LOGISTIC}, "term")


# ------------------------------------------------------------------ k-means
KMEANS = ["tenure", "MonthlyCharges", "TotalCharges"]


def q_kmeans(spark, sf):
    """No row is nearer to the mean of another segment than to that of its own, and no segment is empty."""
    c = J.kmeans_segments(D.customers(spark, sf).select("customer_id", *KMEANS), KMEANS, k=4)
    z = J.standardize(c, KMEANS)
    means = z.groupBy("segment").agg(F.array(*[F.avg(f"{x}_z") for x in KMEANS]).alias("m"))
    far = lambda m: sum((F.pow(F.col(f"{x}_z") - m[i], 2) for i, x in enumerate(KMEANS)), F.lit(0.0))
    one = means.agg(F.collect_list(F.struct("segment", "m")).alias("means"))  # a row per segment
    at = z.crossJoin(F.broadcast(one)).withColumn("near", F.transform("means", lambda e: F.struct(far(e.m).alias("far"), e.segment.alias("segment"))))
    own = F.filter("near", lambda e: e.segment == F.col("segment"))[0].far
    return _rows(at, {"own_mean_is_nearest": F.max(own - F.array_min(F.transform("near", lambda e: e.far))) < 1e-6,
                      "no_segment_is_empty": F.count_distinct("segment") == 4}, "condition")


# ------------------------------------------------------------------ principal components
PCA = ["tenure", "MonthlyCharges", "TotalCharges", "service_adoption_score"]


def q_project(spark, sf):
    """The two components are uncorrelated, ordered, and the first varies at least as much as any
    feature and any sum or difference of two."""
    p = J.standardize(J.project_2d(D.customers(spark, sf), PCA), PCA)
    z = [F.col(f"{x}_z") for x in PCA]
    pairs = [(a + s * b) / np.sqrt(2) for i, a in enumerate(z) for b in z[i + 1:] for s in (1, -1)]
    most = F.greatest(*[F.var_pop(x) for x in [*z, *pairs]])
    return _rows(p, {"uncorrelated": F.abs(F.covar_pop("pc1", "pc2")) < 1e-6, "ordered": F.var_pop("pc1") >= F.var_pop("pc2"),
                     "first_varies_most": F.var_pop("pc1") >= most - 1e-6, "second_varies": F.var_pop("pc2") > 0}, "condition")


# ------------------------------------------------------------------ variance inflation
VIF = ["tenure", "MonthlyCharges", "service_adoption_score", "charge_per_service", "is_month_to_month"]


def q_vif(spark, sf):
    """What each feature leaves after its regression on the others is orthogonal to them, and the
    feature's sum of squares over that of the rest is its VIF."""
    c = D.customers(spark, sf)
    found = {r["feature"]: r["vif"] for r in Sel.vif(c, VIF).collect()}
    g = Sel.cross_products(c, VIF)
    conditions = {}
    for i, x in enumerate(VIF):
        others = [j for j in range(len(VIF)) if j != i]
        b = np.linalg.solve(g[np.ix_(others, others)], g[others, i])
        value = lambda j: F.coalesce(F.col(VIF[j]).cast("double"), F.lit(0.0))
        rest = value(i) - sum((F.lit(float(w)) * value(j) for w, j in zip(b, others)), F.lit(0.0))
        apart = F.greatest(*[F.abs(F.sum(rest * value(j))) / F.sum(value(j) * value(j)) for j in others]) < 1e-6
        conditions[x] = apart & (F.abs(F.sum(value(i) * value(i)) / F.sum(rest * rest) / F.lit(found[x]) - 1) < 1e-6)
    return _rows(c, conditions, "feature")


# ------------------------------------------------------------------ splits and samples by hash
SQL_STRATIFIED = on_customers("""
SELECT Churn_binary, split, count FROM (
  SELECT Churn_binary, 'test' AS split, CAST(round(COUNT(*) * 0.2) AS BIGINT) AS count FROM customers GROUP BY 1
  UNION ALL SELECT Churn_binary, 'train', COUNT(*) - CAST(round(COUNT(*) * 0.2) AS BIGINT) FROM customers GROUP BY 1)""")


def q_hash_arms(spark, sf):
    """Sizes of the arms, and that every customer is in one."""
    arms = L.assign_groups(D.customers(spark, sf), method="hash_rank")
    return arms.groupBy("group").agg(F.count(F.lit(1)).alias("customers"), F.count_distinct("customer_id").alias("distinct_customers"))


SQL_HASH_ARMS = on_customers("""
SELECT 'control' AS "group", CAST(floor(COUNT(*) * 0.5) AS BIGINT) AS customers, CAST(floor(COUNT(*) * 0.5) AS BIGINT) AS distinct_customers FROM customers
UNION ALL SELECT 'treatment', COUNT(*) - CAST(floor(COUNT(*) * 0.5) AS BIGINT), COUNT(*) - CAST(floor(COUNT(*) * 0.5) AS BIGINT) FROM customers""")


def q_sample(spark, sf):
    """Sampled points are points of their customers, as many as asked for, each once."""
    c = D.customers(spark, sf)
    points = S.scatter_extract(c, ["tenure", "MonthlyCharges"], n=1000)
    same = points.join(c.select("customer_id", "tenure", "MonthlyCharges"), ["customer_id", "tenure", "MonthlyCharges"])
    return same.agg(F.count(F.lit(1)).alias("points"), F.count_distinct("customer_id").alias("customers"))


QUERIES = {
    "cox_certificate": (q_cox, _all_true(CM.COX_COVARIATES, "covariate")),
    "logistic_certificate": (q_logistic, _all_true(["intercept", *LOGISTIC], "term")),
    "kmeans_certificate": (q_kmeans, _all_true(["own_mean_is_nearest", "no_segment_is_empty"], "condition")),
    "projection_certificate": (q_project, _all_true(["uncorrelated", "ordered", "first_varies_most", "second_varies"], "condition")),
    "vif_certificate": (q_vif, _all_true(VIF, "feature")),
    "stratified_split": (lambda spark, sf: K.stratified_split(D.customers(spark, sf)).groupBy("Churn_binary", "split").count(), SQL_STRATIFIED),
    "hash_arms": (q_hash_arms, SQL_HASH_ARMS),
    "scatter_sample": (q_sample, on_customers("SELECT least(COUNT(*), 1000) AS points, least(COUNT(*), 1000) AS customers FROM customers")),
}
