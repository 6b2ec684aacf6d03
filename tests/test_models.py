"""Iterative / model operators: brute-force references on small fixtures and
optimality properties (SURVEY §5.2 c, d)."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from paths import SF_SMALL
from ebbflow.operators import models, select, survival
from ebbflow.operators.evaluate import roc_auc, temporal_split
from ebbflow.plans import datasets

COV = ["MonthlyCharges", "is_month_to_month", "service_adoption_score"]


@pytest.fixture(scope="module")
def cust(spark):
    return datasets.customers(spark, SF_SMALL)


def _efron_loglik(t, e, x, beta):
    """Brute-force Efron log-likelihood on standardised x."""
    xb = x @ beta
    w = np.exp(xb)
    ll = 0.0
    for tt in np.unique(t[e == 1]):
        ev = (t == tt) & (e == 1)
        risk = t >= tt
        d = ev.sum()
        ll += xb[ev].sum()
        for k in range(d):
            ll -= math.log(w[risk].sum() - k / d * w[ev].sum())
    return ll


def test_cox_matches_brute_force_optimum(cust):
    pdf = cust.select("tenure", "Churn_binary", *COV).toPandas()
    m = survival.cox_fit(cust, "tenure", "Churn_binary", COV, penalizer=0.1)
    x = pdf[COV].to_numpy(dtype=float)
    x = (x - x.mean(axis=0)) / x.std(axis=0)
    t, e, n = pdf["tenure"].to_numpy(), pdf["Churn_binary"].to_numpy(), len(pdf)
    b = np.array(m.beta_z)

    def obj(beta):
        return _efron_loglik(t, e, x, beta) / n - 0.05 * float(beta @ beta)
    # optimality: a small step in any direction does not improve the objective
    f0 = obj(b)
    for i in range(len(COV)):
        for s in (1e-3, -1e-3):
            d = np.zeros(len(COV))
            d[i] = s
            assert obj(b + d) <= f0 + 1e-12
    assert abs(m.loglik - _efron_loglik(t, e, x, b)) < 1e-6


def test_concordance_brute_force(spark):
    rows = [(1, 1, 0.9), (2, 1, 0.5), (2, 0, 0.5), (3, 1, 0.7), (4, 0, 0.1), (4, 1, 0.2), (5, 0, 0.9)]
    df = spark.createDataFrame(rows, "t int, e int, r double")
    got = survival.concordance_index(df, "t", "e", "r").first()
    conc = pairs = 0.0
    for ti, ei, ri in rows:
        if ei != 1:
            continue
        for tj, _, rj in rows:
            if tj > ti:
                pairs += 1
                conc += 1.0 if ri > rj else 0.5 if ri == rj else 0.0
    assert got.comparable_pairs == pairs
    assert abs(got.concordance_index - conc / pairs) < 1e-12


@pytest.mark.parametrize("s0,e0,d", [(10.0, 3.0, 1), (5000.0, 5000.0, 4096), (30000.0, 30000.0, 20000), (9e6, 4e4, 50000)])
def test_efron_sums_equal_the_terms(s0, e0, d):
    k = np.arange(d)
    phi = s0 - k * e0 / d
    want = [math.fsum(x) for x in (np.log(phi), 1 / phi, k / phi, 1 / phi ** 2, k / phi ** 2, k ** 2 / phi ** 2)]
    assert np.allclose(survival.efron_sums(s0, e0, d), want, rtol=1e-9)


def test_concordance_with_many_durations(spark):
    rng = np.random.default_rng(3)
    rows = [(float(t), int(e), float(r)) for t, e, r in zip(rng.integers(0, 90, 200), rng.integers(0, 2, 200), rng.integers(0, 9, 200))]
    got = survival.concordance_index(spark.createDataFrame(rows, "t double, e int, r double"), "t", "e", "r").first()
    pairs = [(a, b) for a in rows if a[1] for b in rows if b[0] > a[0]]
    conc = sum(1.0 if a[2] > b[2] else 0.5 if a[2] == b[2] else 0.0 for a, b in pairs)
    assert got.comparable_pairs == len(pairs) and abs(got.concordance_index - conc / len(pairs)) < 1e-12


def test_cox_leaves_null_rows_out(cust):
    holes = cust.withColumn("MonthlyCharges", F.when(F.col("customer_id") % 7 != 0, F.col("MonthlyCharges")))
    a = survival.cox_fit(holes, "tenure", "Churn_binary", COV)
    b = survival.cox_fit(holes.where("MonthlyCharges is not null"), "tenure", "Churn_binary", COV)
    assert np.allclose(a.beta_z, b.beta_z, atol=1e-9)
    p = survival.expected_remaining(survival.cox_predict_survival(holes, a, [12.0]), a)
    assert p.where("MonthlyCharges is null and (survival_12 is not null or expected_months_remaining is not null)").count() == 0
    assert p.where("MonthlyCharges is not null and survival_12 is null").count() == 0


def test_vif_over_more_than_thirty_features(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 34))
    x[:, 33] = x[:, 0] + x[:, 1]
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"c{i} double" for i in range(34)))
    got = {r.feature: r.vif for r in select.vif(df, df.columns).collect()}
    assert len(got) == 34 and all(math.isinf(got[f"c{i}"]) for i in (0, 1, 33)) and all(got[f"c{i}"] < 3 for i in range(2, 33))
    assert {r.feature for r in select.drop_high_vif(df, df.columns).collect()} == {f"c{i}" for i in range(2, 33)}


def test_predict_returns_its_input_unchanged(cust):
    feats = ["tenure", "MonthlyCharges"]
    model = models.train_logistic(cust, feats, max_iter=20)
    holes = cust.select("customer_id", *feats).withColumn("Churn_binary", F.lit(None).cast("int")).withColumn(
        "tenure", F.when(F.col("customer_id") % 3 != 0, F.col("tenure")))
    out = models.predict(model, holes)
    assert out.select(*holes.columns).exceptAll(holes).count() == 0
    zero = models.predict(model, holes.fillna(0, subset=feats)).select("customer_id", F.col("churn_probability").alias("q"))
    assert out.join(zero, "customer_id").where("abs(churn_probability - q) > 1e-12").count() == 0


def test_cox_prediction_monotone(cust):
    m = survival.cox_fit(cust, "tenure", "Churn_binary", COV)
    p = survival.cox_predict_survival(cust, m, [1.0, 12.0, 48.0]).select(
        "survival_1", "survival_12", "survival_48").collect()
    for r in p:
        assert 1.0 >= r.survival_1 >= r.survival_12 >= r.survival_48 >= 0.0
    er = survival.expected_remaining(cust, m).agg(F.min("expected_months_remaining")).first()[0]
    assert er >= 0


def test_vif_matches_numpy(cust):
    cols = ["tenure", "MonthlyCharges", "service_adoption_score"]
    got = {r.feature: r.vif for r in select.vif(cust, cols).collect()}
    x = cust.select(*cols).toPandas().to_numpy(dtype=float)
    g = x.T @ x
    inv = np.linalg.inv(g)
    for i, c in enumerate(cols):
        assert abs(got[c] - g[i, i] * inv[i, i]) < 1e-6 * max(1.0, got[c])


def test_logistic_and_tune(cust):
    feats = ["tenure", "MonthlyCharges", "service_adoption_score", "is_month_to_month"]
    s = temporal_split(cust)
    train, test = s.where(F.col("split") == "train"), s.where(F.col("split") == "test")
    lr = models.train_logistic(train, feats, max_iter=50)
    auc = roc_auc(models.predict(lr, test.select("customer_id", "Churn_binary", *feats))).first().auc
    assert 0.0 <= auc <= 1.0
    best, trials = models.tune(train, feats, n_trials=2, folds=2, parallelism=2,
                               space=dict(maxIter=(3, 5), maxDepth=(2, 3), stepSize=(0.05, 0.2),
                                          subsamplingRate=(0.8, 1.0),
                                          featureSubsetStrategy=(0.8, 1.0)))
    assert trials.count() == 2 and "maxIter" in best


def test_tree_contributions_follow_the_paths(spark):
    """A step of a path changes the margin by the difference of two nodes' values, for its feature."""
    import numpy as np
    table = models.TreeTable(np.array([0, 5]), np.array([1.0, 0.5]), np.array([0, -1, 1, -1, -1, -1]), np.array([0.5, 0, 2.0, 0, 0, 0]),
                             np.array([1, -1, 3, -1, -1, -1]), np.array([2, -1, 4, -1, -1, -1]), np.array([1.0, 0.0, 3.0, 2.0, 7.0, 4.0]))
    assert table.bias == 1.0 + 0.5 * 4.0
    got = table.contributions(np.array([[0.5, 9.0, 1.0], [0.6, 2.0, 1.0], [0.6, 2.1, 1.0]]))
    assert got.tolist() == [[-1.0, 0.0, 0.0], [2.0, -1.0, 0.0], [2.0, 4.0, 0.0]]


def test_contributions_add_up_with_nulls_and_unused_features(spark):
    cust = datasets.customers(spark, SF_SMALL)
    feats = ["tenure", "MonthlyCharges", "has_fiber", "constant"]
    df = cust.withColumn("constant", F.lit(3.0)).withColumn("tenure", F.when(F.col("customer_id") % 7 != 0, F.col("tenure")))
    for model, explain in ((models.train_logistic(df, feats, max_iter=30), models.linear_contributions),
                           (models.train_boosted(df, feats, preset=dict(maxIter=4, maxDepth=3)), models.tree_contributions)):
        margin = {r.customer_id: r.margin for r in models.margins(model, df).collect()}
        rows = explain(model, df, feats).collect()
        assert len(rows) == len(margin) == cust.count()
        for r in rows:
            assert abs(r.bias + sum(r.contributions) - margin[r.customer_id]) < 1e-9 and r.contributions[3] == 0


def test_permuted_scores_in_batches_equal_those_of_repeated_rows(spark, monkeypatch):
    cust = datasets.customers(spark, SF_SMALL)
    feats = ["tenure", "MonthlyCharges", "has_fiber", "service_adoption_score"]
    df = cust.select("customer_id", "Churn_binary", *feats)
    for model in (models.train_logistic(df, feats, max_iter=30), models.train_boosted(df, feats, preset=dict(maxIter=4, maxDepth=3))):
        read = lambda: {r.feature: (round(r.base_auc, 6), round(r.permuted_auc, 6))
                        for r in models.permutation_importance(model, df, feats).collect()}
        batches = read()
        with monkeypatch.context() as m:
            m.setattr(models, "LogisticRegressionModel", type(None))
            m.setattr(models, "GBTClassificationModel", type(None))
            assert read() == batches
        assert set(batches) == set(feats)


def test_concordance_counts_levels_once(spark):
    df = spark.createDataFrame([(i % 7, i % 2, float(i % 5)) for i in range(40)], "t int, e int, r double")
    got = survival.concordance_index(df, "t", "e", "r")
    assert "Generate" not in got._jdf.queryExecution().toString()  # the rows of all levels are written once


def test_contributions_are_added_up_before_the_join(spark):
    from ebbflow.plans.catalog_models import _adds_up
    given = spark.createDataFrame([(1, 0.5, [1.0, 2.0]), (2, 0.5, [0.0, 0.25]), (2, 0.5, None), (None, 0.5, [1.0])],
                                  "customer_id long, bias double, contributions array<double>")
    margin = spark.createDataFrame([(1, 3.5), (2, 1.0), (None, 1.5)], "customer_id long, margin double")
    got = _adds_up(given, margin)
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, 2, True), (2, 2, False), (2, None, None)], key=str)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("aggregate(")
