"""Shared SQL prefix for the DuckDB oracle.

The oracle only sees the base parquet tables, so every oracle query starts from
the same ``subscriptions`` CTE (FIXTURES.md §3) written here once, by hand, in
plain SQL — independently of the DataFrame code in ``sources/subscriptions.py``.
"""

SUBSCRIPTIONS_CTES = """
ref AS (SELECT max(o_orderdate) AS ref_date FROM orders),
line_facts AS (
  SELECT l.l_orderkey,
         COUNT(*) AS n_lines,
         SUM(CASE WHEN l.l_returnflag = 'R' THEN 1 ELSE 0 END) AS n_returned,
         SUM(CAST(round(l.l_extendedprice * 100) AS BIGINT)) AS line_cents,
         MAX(CASE WHEN p.p_type = 'ECONOMY' THEN 1 ELSE 0 END) AS OnlineSecurity,
         MAX(CASE WHEN p.p_type = 'LARGE' THEN 1 ELSE 0 END) AS OnlineBackup,
         MAX(CASE WHEN p.p_type = 'MEDIUM' THEN 1 ELSE 0 END) AS DeviceProtection,
         MAX(CASE WHEN p.p_type = 'PROMO' THEN 1 ELSE 0 END) AS TechSupport,
         MAX(CASE WHEN p.p_type = 'SMALL' THEN 1 ELSE 0 END) AS StreamingTV,
         MAX(CASE WHEN p.p_type = 'STANDARD' THEN 1 ELSE 0 END) AS StreamingMovies
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
  GROUP BY l.l_orderkey
),
subscriptions AS (
  SELECT
    o.o_orderkey AS customer_id,
    CAST(least(72, floor(date_diff('day', CAST(o.o_orderdate AS DATE), CAST(r.ref_date AS DATE)) / 30)) AS INTEGER) AS tenure,
    CAST(1800 + floor(o.o_totalprice / 50) AS BIGINT) AS monthly_cents,
    CAST(1800 + floor(o.o_totalprice / 50) AS BIGINT) / 100.0::DOUBLE AS MonthlyCharges,
    CAST(floor(f.line_cents / 50) AS BIGINT) AS total_cents,
    CAST(floor(f.line_cents / 50) AS BIGINT) / 100.0::DOUBLE AS TotalCharges,
    CAST(coalesce(f.OnlineSecurity, 0) AS INTEGER) AS OnlineSecurity,
    CAST(coalesce(f.OnlineBackup, 0) AS INTEGER) AS OnlineBackup,
    CAST(coalesce(f.DeviceProtection, 0) AS INTEGER) AS DeviceProtection,
    CAST(coalesce(f.TechSupport, 0) AS INTEGER) AS TechSupport,
    CAST(coalesce(f.StreamingTV, 0) AS INTEGER) AS StreamingTV,
    CAST(coalesce(f.StreamingMovies, 0) AS INTEGER) AS StreamingMovies,
    CASE o.o_orderstatus WHEN 'F' THEN 'Month-to-month' WHEN 'O' THEN 'One year'
                         WHEN 'P' THEN 'Two year' END AS Contract,
    CASE WHEN c.c_mktsegment IN ('AUTOMOBILE', 'BUILDING') THEN 'Fiber optic'
         WHEN c.c_mktsegment IN ('FURNITURE', 'HOUSEHOLD') THEN 'DSL'
         WHEN c.c_mktsegment = 'MACHINERY' THEN 'No' END AS InternetService,
    CASE WHEN o.o_orderpriority IN ('1-URGENT', '5-LOW') THEN 'Electronic check'
         WHEN o.o_orderpriority = '2-HIGH' THEN 'Mailed check'
         WHEN o.o_orderpriority = '3-MEDIUM' THEN 'Bank transfer (automatic)'
         WHEN o.o_orderpriority = '4-NOT SPECIFIED' THEN 'Credit card (automatic)' END AS PaymentMethod,
    CASE WHEN c.c_custkey % 2 = 1 THEN 'Female' ELSE 'Male' END AS gender,
    CAST(c.c_custkey % 6 = 0 AS INTEGER) AS SeniorCitizen,
    CAST(c.c_nationkey % 2 = 1 AS INTEGER) AS Partner,
    CAST(c.c_nationkey % 3 = 0 AS INTEGER) AS Dependents,
    CAST(o.o_orderkey % 10 <> 0 AS INTEGER) AS PhoneService,
    CAST(o.o_orderkey % 2 = 1 AS INTEGER) AS PaperlessBilling,
    CAST(coalesce(f.n_lines > 0 AND 2 * f.n_returned >= f.n_lines, false) AS INTEGER) AS Churn_binary,
    o.o_orderdate AS start_date
  FROM orders o
  JOIN customer c ON o.o_custkey = c.c_custkey
  LEFT JOIN line_facts f ON f.l_orderkey = o.o_orderkey
  CROSS JOIN ref r
)"""


def with_ctes(*ctes: str, body: str) -> str:
    """``WITH <subscriptions ctes>, <extra ctes> <body>``."""
    parts = [SUBSCRIPTIONS_CTES.strip()] + [c.strip() for c in ctes if c]
    return "WITH " + ",\n".join(parts) + "\n" + body.strip()


def ks_p_sql(d: str, n1: str, n2: str) -> str:
    """Kolmogorov's distribution as the theta function, from either of its two
    expansions (they meet anywhere; here at 1.18), with Stephens' correction."""
    lam = (f"((sqrt(({n1}) * ({n2}) / (({n1}) + ({n2}))) + 0.12::DOUBLE "
           f"+ 0.11::DOUBLE / sqrt(({n1}) * ({n2}) / (({n1}) + ({n2})))) * ({d}))")
    y = f"exp(-pi() * pi() / (8 * {lam} * {lam}))"
    small = f"1 - sqrt(2 * pi()) / {lam} * ({y} + power({y}, 9) + power({y}, 25) + power({y}, 49))"
    z = f"exp(-2 * {lam} * {lam})"
    large = f"2 * ({z} - power({z}, 4) + power({z}, 9) - power({z}, 16))"
    return (f"CASE WHEN ({n1}) > 0 AND ({n2}) > 0 THEN CASE WHEN {lam} < 0.03 THEN 1.0::DOUBLE "
            f"WHEN {lam} < 1.18 THEN {small} ELSE {large} END END")


def erfc_sql(x: str) -> str:
    """2/√π ∫ₓ e^{−t²} dt by Simpson's rule over six units, for x ≥ 0."""
    return (f"(2 / sqrt(pi()) * 0.0005::DOUBLE * list_sum(list_transform(range(0, 4001), lambda i: "
            f"CASE WHEN i = 0 OR i = 4000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END "
            f"* exp(-power(({x}) + i * 0.0015::DOUBLE, 2)))))")


def norm_p_sql(z: str) -> str:
    """Two-sided p-value of a standard normal statistic."""
    return erfc_sql(f"abs({z}) / sqrt(2)")
