"""Hand-computed golden values on tiny fixtures (FIXTURES.md §1, §2, SURVEY §5.1)."""

import math
import os
import tempfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ebbflow.functions import stats
from ebbflow.functions.columns import TENURE_EDGES_A, bucketize
from ebbflow.operators import clean, experiment, features, scoring
from ebbflow.operators.archetypes import archetype_rule
from ebbflow.operators.ranks import ntile_from_position, pct_rank_avg, prefix_sums
from ebbflow.sources import tables

HEADER = ("customerID,gender,SeniorCitizen,Partner,Dependents,tenure,PhoneService,MultipleLines,"
          "InternetService,OnlineSecurity,OnlineBackup,DeviceProtection,TechSupport,StreamingTV,"
          "StreamingMovies,Contract,PaperlessBilling,PaymentMethod,MonthlyCharges,TotalCharges,Churn")
# telco_tiny: duplicate row (c01 twice), blank TotalCharges (c02), null category with tied
# modes (c05 Contract), 'No internet service', tenure 0/6/7/12/48/60/72, tied charges,
# an outlier (c09), 'ELECTRONIC CHECK', and three invalid rows (tenure 73, negative charge, flag 2).
ROWS = [
    "c01,Female,0,Yes,No,6,Yes,No,Fiber optic,No,No,No,No,Yes,No,Month-to-month,Yes,Electronic check,85.5,513,Yes",
    "c01,Female,0,Yes,No,6,Yes,No,Fiber optic,No,No,No,No,Yes,No,Month-to-month,Yes,Electronic check,85.5,513,Yes",
    "c02,Male,0,No,No,0,Yes,No,DSL,Yes,No,No,No,No,No,Two year,No,Mailed check,50.0, ,No",
    "c03,Male,1,No,No,7,Yes,No,No,No internet service,No internet service,No internet service,"
    "No internet service,No internet service,No internet service,One year,No,ELECTRONIC CHECK,20.0,140,No",
    "c04,Female,0,Yes,Yes,12,Yes,No,DSL,Yes,Yes,No,No,No,No,One year,Yes,Bank transfer (automatic),50.0,600,No",
    "c05,Male,0,No,No,48,Yes,No,Fiber optic,No,No,No,No,Yes,Yes,,Yes,Credit card (automatic),95.0,4560,Yes",
    "c06,Female,1,No,No,60,No,No,DSL,Yes,Yes,Yes,Yes,No,No,Two year,No,Mailed check,60.0,3600,No",
    "c07,Male,0,Yes,No,72,Yes,No,Fiber optic,Yes,Yes,Yes,Yes,Yes,Yes,Two year,Yes,Credit card (automatic),110.0,7920,No",
    "c08,Female,0,No,No,3,Yes,No,Fiber optic,No,No,No,No,No,No,Month-to-month,Yes,Electronic check,70.0,210,Yes",
    "c09,Male,0,No,No,24,Yes,No,DSL,No,No,No,No,No,No,Month-to-month,No,Mailed check,400.0,9600,No",
    "c10,Female,0,No,No,73,Yes,No,DSL,No,No,No,No,No,No,One year,No,Mailed check,30.0,2190,No",
    "c11,Male,0,No,No,5,Yes,No,DSL,No,No,No,No,No,No,Month-to-month,No,Mailed check,-5.0,10,No",
    "c12,Female,2,No,No,8,Yes,No,DSL,No,No,No,No,No,No,Month-to-month,No,Mailed check,40.0,320,Yes",
]


@pytest.fixture(scope="module")
def raw(spark):
    d = tempfile.mkdtemp(prefix="telco-tiny-")
    with open(os.path.join(d, "telco_tiny.csv"), "w") as f:
        f.write(HEADER + "\n" + "\n".join(ROWS) + "\n")
    return tables.read_customers(spark, d)


def test_read_and_coerce(raw):
    df = clean.coerce_numeric(raw, ["TotalCharges"])
    assert df.count() == 13
    assert df.where(F.col("TotalCharges").isNull()).select("customerID").first()[0] == "c02"


def test_dedupe(raw):
    out, report = clean.dedupe(raw)
    r = report.first()
    assert (r.rows_before, r.rows_after, r.removed) == (13, 12, 1)


def test_fill_mode_ties_smallest(raw):
    # Contract: Month-to-month ×5 (incl. the duplicate), One year ×3, Two year ×3, one null
    out = clean.fill_mode(raw.dropDuplicates(), ["Contract"])
    assert out.where(F.col("customerID") == "c05").first()["Contract"] == "Month-to-month"
    tie = raw.sparkSession.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "x string")
    assert clean.fill_mode(tie, ["x"]).where(F.col("x") == "a").count() == 3


def test_fill_median_exact(raw):
    df = clean.coerce_numeric(raw.dropDuplicates(), ["TotalCharges"])
    out = clean.fill_median(df, "TotalCharges")
    vals = sorted(v for v in pd.to_numeric(
        [r.split(",")[19] for r in ROWS[1:]], errors="coerce") if not math.isnan(v))
    assert out.where(F.col("customerID") == "c02").first()["TotalCharges"] == pd.Series(vals).median()


def test_encode_yes_no_and_auto(raw):
    enc = clean.encode_yes_no(raw, ["OnlineSecurity", "Partner"])
    assert enc.where(F.col("customerID") == "c03").first()["OnlineSecurity"] == 0
    auto = clean.auto_encode_yes_no(raw.dropDuplicates())
    types = dict(auto.dtypes)
    assert types["Partner"] == "int" and types["Churn"] == "int"
    assert types["OnlineSecurity"] == "string"  # has 'No internet service'
    assert types["Contract"] == "string"  # has a null


def test_iqr_cap_skips_degenerate(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 2.0), (0, 3.0), (0, 4.0), (1, 100.0)], "flag int, x double")
    out = clean.iqr_cap(df, ["flag", "x"]).collect()
    assert sorted(r.flag for r in out) == [0, 0, 0, 0, 1]
    assert max(r.x for r in out) == 4.0 + 1.5 * 2.0
    deg = clean.iqr_cap(df, ["flag"], cap_degenerate=True).collect()
    assert sorted(r.flag for r in deg) == [0, 0, 0, 0, 0]


def test_validate_rows(raw, spark):
    df = clean.coerce_numeric(raw.dropDuplicates(), ["TotalCharges"])
    df = clean.encode_yes_no(df, ["Partner", "Dependents", "PhoneService", "PaperlessBilling",
                                  *features.SERVICE_COLS])
    v = clean.validate_rows(df.fillna({"TotalCharges": 0.0, "Contract": "Month-to-month"}))
    bad = {r.customerID for r in v.where(~F.col("is_valid")).collect()}
    assert bad == {"c10", "c11", "c12"}


def _request(spark):
    # Example request (FIXTURES §2): tenure 3, m 85.5, T 256.5, MtM, Fiber, Electronic check,
    # paperless, no partner/dependents/senior, phone, only StreamingTV.
    return spark.createDataFrame([dict(
        customer_id=1, tenure=3, MonthlyCharges=85.5, TotalCharges=256.5, Contract="Month-to-month",
        InternetService="Fiber optic", PaymentMethod="Electronic check", PaperlessBilling=1,
        Partner=0, Dependents=0, SeniorCitizen=0, PhoneService=1, OnlineSecurity=0, OnlineBackup=0,
        DeviceProtection=0, TechSupport=0, StreamingTV=1, StreamingMovies=0)])


def test_example_request_features(spark):
    stats_row = spark.createDataFrame([(35.0, 64.76, 65.0)], "charge_q25 double, charge_q50 double, charge_q75 double")
    f = features.engineer_features(_request(spark), stats_row, percentiles=False).first()
    assert f.service_adoption_score == 1
    assert f.base_risk_score == 9
    assert f.advanced_risk_score == 13.5
    assert abs(f.clv_at_risk - 1385.1) < 1e-9
    assert f.uses_electronic == 1
    s = scoring.score_customers(_request(spark), stats=stats_row, as_of="2024-01-01 00:00:00").first()
    assert s.archetype == "Price Refugee"
    assert [x.weight for x in s.top_risk_factors] == [3.0, 2.5, 2.0, 1.5, 1.5]
    assert s.intervention.endswith("loyalty discount or plan downgrade immediately")


def test_case_insensitive_payment(raw):
    df = features.contract_features(clean.encode_yes_no(raw, ["PaperlessBilling"]))
    assert df.where(F.col("customerID") == "c03").first()["uses_electronic"] == 1


def test_bucketize_tenure_zero(spark):
    df = spark.createDataFrame([(0,), (6,), (7,), (72,)], "t int")
    a = [r[0] for r in df.select(bucketize("t", TENURE_EDGES_A)).collect()]
    b = [r[0] for r in df.select(bucketize("t", TENURE_EDGES_A, include_lowest=True)).collect()]
    assert a == [None, 1, 2, 5] and b == [1, 1, 2, 5]


def test_ab_golden(spark):
    rows = ([("control", 1)] * 76 + [("control", 0)] * 110
            + [("treatment", 1)] * 57 + [("treatment", 0)] * 129)
    df = spark.createDataFrame(rows, "group string, churned int").withColumn("monthly_cents", F.lit(5000))
    r = experiment.ab_readout(df).first()
    assert (r.n_control, r.n_treatment) == (186, 186)
    assert round(r.control_rate, 4) == 0.4086 and round(r.treatment_rate, 4) == 0.3065
    assert round(r.p_z, 4) == 0.0398
    assert round(r.p_chi2, 4) == 0.0515


def test_macro_derived(spark):
    m = spark.createDataFrame([(2.793, 2.95, 4.198)],
                              "macro_gdp_growth double, macro_inflation double, macro_unemployment double")
    r = features.derive_macro(m).first()
    assert abs(r.macro_stress_index - 4.355) < 1e-12
    assert abs(r.macro_consumer_pressure - 12.3841) < 1e-12


def test_pct_rank_matches_pandas(spark):
    vals = [3.0, 1.0, 2.0, 2.0, 5.0, 3.0, 3.0, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "id int, v double")
    got = {r.id: r.pr for r in pct_rank_avg(df, "v", "pr").collect()}
    exp = pd.Series(vals, dtype="float64").rank(pct=True)
    for i, e in enumerate(exp):
        assert (got[i] is None and math.isnan(e)) or abs(got[i] - e) < 1e-12


@pytest.mark.parametrize("n", [1, 7, 10, 23, 100])
def test_ntile_matches_sql(spark, n):
    df = spark.range(1, n + 1).withColumn("n", F.lit(n))
    got = [r[0] for r in df.select(ntile_from_position(F.col("id"), F.col("n"), 10)).collect()]
    q, rem = divmod(n, 10)
    exp, b = [], 1
    for tile in range(1, 11):
        size = q + (1 if tile <= rem else 0)
        exp += [tile] * size
    assert got == exp[:n]


def test_prefix_sums_match_cumsum(spark):
    df = spark.range(0, 500).withColumn("v", (F.col("id") * 7) % 13)
    out = prefix_sums(df, ["id"], {"c": F.col("v")}, partitions=5).orderBy("id").collect()
    run = 0
    for r in out:
        run += r.v
        assert r.c == run


def test_p_values():
    assert abs(stats.chi2_sf(3.841458820694124, 1) - 0.05) < 1e-9
    assert abs(stats.chi2_sf(5.991464547107979, 2) - 0.05) < 1e-9
    assert abs(stats.chi2_sf(7.814727903251178, 3) - 0.05) < 1e-7
    assert abs(stats.chi2_sf(11.070497693516351, 5) - 0.05) < 1e-7
    assert abs(2 * stats.norm_sf(1.959963984540054) - 0.05) < 1e-12
    assert stats.kolmogorov_sf(0.0, 100, 100) == 1.0
    assert stats.kolmogorov_sf(0.5, 100, 100) < 1e-8


# Kolmogorov's distribution at λ, to ten digits (from the theta function's other expansion)
KOLMOGOROV = {0.001: 1.0, 0.002: 1.0, 0.01: 1.0, 0.1: 1.0, 0.5: 0.9639452436, 1.0: 0.2699996717, 2.0: 0.0006709252558}


def test_kolmogorov_distribution(spark):
    from pyspark.sql import functions as F
    n = 1e6
    en = (n / 2) ** 0.5
    rows = [(lam, lam / (en + 0.12 + 0.11 / en)) for lam in KOLMOGOROV]
    got = {r.lam: r.p for r in spark.createDataFrame(rows, "lam double, d double").select(
        "lam", stats.ks_p_expr("d", F.lit(n), F.lit(n)).alias("p")).collect()}
    for lam, want in KOLMOGOROV.items():
        assert abs(stats.kolmogorov_q(lam) - want) < 1e-9
        assert abs(got[lam] - want) < 1e-9


def test_p_value_expressions_equal_the_functions(spark):
    from pyspark.sql import functions as F
    import math
    rows = [(x / 4, k) for x in range(0, 160, 3) for k in (1, 2, 3, 4, 5, 8, 11)]
    df = spark.createDataFrame(rows, "x double, k int")
    for r in df.select("x", "k", stats.chi2_sf_expr("x", "k").alias("p"), stats.erfc_expr("x").alias("e"),
                       stats.two_sided_norm_p(-F.col("x")).alias("z")).collect():
        assert math.isclose(r.p, stats.chi2_sf(r.x, r.k), rel_tol=1e-9, abs_tol=1e-13)
        assert math.isclose(r.e, math.erfc(r.x), rel_tol=1e-10, abs_tol=1e-15)
        assert math.isclose(r.z, 2 * stats.norm_sf(r.x), rel_tol=1e-10, abs_tol=1e-15)


def test_drift_of_a_nearly_equal_flag_is_none(spark):
    from ebbflow.operators import monitor
    rows = [("reference", int(i % 4 == 0)) for i in range(20000)] + [("current", int(i % 4 == 0 and i > 4)) for i in range(20000)]
    r = monitor.drift_report(spark.createDataFrame(rows, "window string, f int"), ["f"]).first()
    assert r.ks_p_value > 0.999 and not r.drift_detected


def test_chi2_without_empty_cells_and_on_non_string_levels(spark):
    rows = [(0.5, 1)] * 7 + [(0.5, 0)] * 3 + [(1.5, 1)] * 4 + [(2.5, 0)] * 6 + [(None, 1)]
    from ebbflow.operators import hypothesis
    r = hypothesis.chi2_statistic(spark.createDataFrame(rows, "a double, b int"), "a", "b").first()
    table = [[3, 7], [0, 4], [6, 0]]
    n, want = 20, 0.0
    for row in table:
        for j in range(2):
            e = sum(row) * sum(t[j] for t in table) / n
            want += (row[j] - e) ** 2 / e
    assert r.n == 20 and r.dof == 2 and abs(r.chi2 - want) < 1e-12


def test_a_macro_table_of_two_rows_is_an_error(spark):
    import pytest
    from ebbflow.functions.columns import exactly_one
    two = spark.createDataFrame([(1.0,), (2.0,)], "m double")
    with pytest.raises(Exception, match="must have one row"):
        features.add_macro(spark.range(1), two).collect()
    assert exactly_one(two.limit(0)).collect()[0].m is None


def test_read_customers_takes_every_matching_file(spark, tmp_path):
    line = open_line = "c{},Male,0,Yes,No,5,Yes,No,DSL,No,No,No,No,No,No,One year,No,Mailed check,20.5,100,No\n"
    head = ",".join(f.name for f in tables.TELCO_SCHEMA.fields) + "\n"
    del open_line
    for name, ids in (("telco_a.csv", [1, 2]), ("Telco_b.csv", [3]), ("other.csv", [4])):
        (tmp_path / name).write_text(head + "".join(line.format(i) for i in ids))
    assert tables.read_customers(spark, str(tmp_path)).count() == 3
    import pytest
    empty = tmp_path / "none"
    empty.mkdir()
    with pytest.raises(FileNotFoundError):
        tables.read_customers(spark, str(empty))


def test_archetype_rule_order(spark):
    df = spark.createDataFrame([(1, 1, 1, 1, 1, 30), (0, 0, 1, 1, 1, 30), (0, 0, 0, 0, 0, 30)],
                               "is_month_to_month int, is_high_charger int, is_new_customer int, "
                               "has_fiber int, fiber_no_security int, tenure int")
    got = [r.archetype for r in archetype_rule(df).collect()]
    assert got == ["Price Refugee", "Early Dropout", "Lifecycle Leaver"]


def test_exact_quantiles_match_numpy(spark):
    import numpy as np
    from ebbflow.operators.ranks import exact_quantiles
    vals = [0.3, 0.1, 0.7, 0.7, 0.2, 0.9, 0.55, 0.1, 0.45]
    df = spark.createDataFrame([(v,) for v in vals] + [(None,)], "x double")
    got = {r.level: r.quantile for r in exact_quantiles(df, "x", [0.0, 0.25, 0.5, 0.9, 1.0]).collect()}
    for q, v in got.items():
        assert abs(v - float(np.percentile(vals, q * 100))) < 1e-12
