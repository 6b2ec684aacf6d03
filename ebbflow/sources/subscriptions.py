"""The telco-shaped ``subscriptions`` view over the star-schema tables.

One row per order: the order is the subscription contract, its lines are the
services on it. The column rules are fixed (see FIXTURES.md §3) so that Spark
and the SQL oracle run the same integer arithmetic.

Plan shape at scale:
  * lineitem is reduced to four narrow columns before anything else and joined
    to a 2-column projection of part (partkey, service bit); the join is a
    shuffle join chosen by Catalyst/AQE — part grows with the data, so it is
    never force-broadcast.
  * lines are aggregated per order with partial (map-side) aggregation; the six
    service flags travel as one ``bit_or`` byte instead of six columns.
  * the aggregated facts are left-joined to orders on the order key; customer is
    joined on the customer key. The only broadcast is the one-row reference date.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbflow.functions.columns import attach

from ebbflow.sources import tables

# Part type -> telco service column (FIXTURES.md §3).
SERVICE_BY_PART_TYPE = [
    ("ECONOMY", "OnlineSecurity"),
    ("LARGE", "OnlineBackup"),
    ("MEDIUM", "DeviceProtection"),
    ("PROMO", "TechSupport"),
    ("SMALL", "StreamingTV"),
    ("STANDARD", "StreamingMovies"),
]
SERVICE_COLS = [name for _, name in SERVICE_BY_PART_TYPE]

# Order status -> contract, market segment -> internet service,
# order priority -> payment method.
CONTRACT_BY_STATUS = [("F", "Month-to-month"), ("O", "One year"), ("P", "Two year")]
INTERNET_BY_SEGMENT = [
    ("AUTOMOBILE", "Fiber optic"), ("BUILDING", "Fiber optic"),
    ("FURNITURE", "DSL"), ("HOUSEHOLD", "DSL"), ("MACHINERY", "No"),
]
PAYMENT_BY_PRIORITY = [
    ("1-URGENT", "Electronic check"), ("5-LOW", "Electronic check"),
    ("2-HIGH", "Mailed check"), ("3-MEDIUM", "Bank transfer (automatic)"),
    ("4-NOT SPECIFIED", "Credit card (automatic)"),
]

MAX_TENURE = 72


def _lookup(col: str, pairs) -> F.Column:
    expr = None
    for key, value in pairs:
        expr = (F.when(F.col(col) == key, value) if expr is None
                else expr.when(F.col(col) == key, value))
    return expr


def line_facts(lineitem: DataFrame, part: DataFrame) -> DataFrame:
    """Per order: number of lines, returned lines, cents and the service bitmask."""
    bit = None
    for i, (ptype, _) in enumerate(SERVICE_BY_PART_TYPE):
        bit = (F.when(F.col("p_type") == ptype, F.lit(1 << i)) if bit is None
               else bit.when(F.col("p_type") == ptype, F.lit(1 << i)))
    part_bits = part.select("p_partkey", bit.otherwise(F.lit(0)).alias("svc_bit"))
    lines = lineitem.select("l_orderkey", "l_partkey", "l_extendedprice", "l_returnflag")
    joined = lines.join(part_bits, lines.l_partkey == part_bits.p_partkey, "inner")
    return joined.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("n_returned"),
        F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("line_cents"),
        F.bit_or("svc_bit").alias("svc_mask"),
    )


def build(orders: DataFrame, lineitem: DataFrame, part: DataFrame,
          customer: DataFrame) -> DataFrame:
    """Return the ``subscriptions`` DataFrame (one row per order)."""
    ref = orders.agg(F.max("o_orderdate").alias("ref_date"))
    facts = line_facts(lineitem, part)
    o = orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                      "o_orderdate", "o_orderpriority")
    c = customer.select("c_custkey", "c_nationkey", "c_mktsegment")
    base = (o.join(c, o.o_custkey == c.c_custkey, "inner")
             .join(facts, o.o_orderkey == facts.l_orderkey, "left")
             .transform(attach, ref))
    has_lines = F.col("n_lines").isNotNull()
    svc = [F.when(has_lines, F.shiftright(F.col("svc_mask"), i).bitwiseAND(1))
             .otherwise(0).cast("int").alias(name)
           for i, name in enumerate(SERVICE_COLS)]
    flag = lambda cond: F.when(cond, 1).otherwise(0).cast("int")
    monthly_cents = (F.lit(1800) + F.floor(F.col("o_totalprice") / 50)).cast("bigint")
    total_cents = F.floor(F.col("line_cents") / 50).cast("bigint")
    tenure = F.least(F.lit(MAX_TENURE),
                     F.floor(F.datediff(F.col("ref_date"), F.col("o_orderdate")) / 30)
                     ).cast("int")
    return base.select(
        F.col("o_orderkey").alias("customer_id"),
        tenure.alias("tenure"),
        monthly_cents.alias("monthly_cents"),
        (monthly_cents / F.lit(100.0)).alias("MonthlyCharges"),
        total_cents.alias("total_cents"),
        (total_cents / F.lit(100.0)).alias("TotalCharges"),
        *svc,
        _lookup("o_orderstatus", CONTRACT_BY_STATUS).alias("Contract"),
        _lookup("c_mktsegment", INTERNET_BY_SEGMENT).alias("InternetService"),
        _lookup("o_orderpriority", PAYMENT_BY_PRIORITY).alias("PaymentMethod"),
        F.when(F.col("c_custkey") % 2 == 1, "Female").otherwise("Male").alias("gender"),
        flag(F.col("c_custkey") % 6 == 0).alias("SeniorCitizen"),
        flag(F.col("c_nationkey") % 2 == 1).alias("Partner"),
        flag(F.col("c_nationkey") % 3 == 0).alias("Dependents"),
        flag(F.col("o_orderkey") % 10 != 0).alias("PhoneService"),
        flag(F.col("o_orderkey") % 2 == 1).alias("PaperlessBilling"),
        flag(has_lines & (F.col("n_returned") * 2 >= F.col("n_lines"))).alias("Churn_binary"),
        F.col("o_orderdate").alias("start_date"),
    )


def load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Build ``subscriptions`` from the parquet tables under ``sf_dir``."""
    t = lambda name: tables.read(spark, sf_dir, name)
    return build(t("orders"), t("lineitem"), t("part"), t("customer"))
