"""Customer-level attrition table derived from orders.

The test tables have no subscriber table, so one is derived without
leakage: a cutoff ``horizon_days`` before the last order date splits time.
Features come from orders on or before the cutoff, the label from the
orders after it (``churned = 'Yes'`` when there is none).

Plan shape: the cutoff is one tiny global aggregate turned into a literal;
orders are read once (4 columns, pruned at the scan) and aggregated per
customer with map-side partial aggregation, so a customer holding a third
of all orders collapses to one row per map task before the shuffle. The
per-customer result joins ``customer`` on the key; the nation/region
lookup is broadcast only after its size is checked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.sources.tables import load_table

# Fixed values of the adapter (part of its definition).
HORIZON_DAYS = 365
URGENT_PRIORITY = "1-URGENT"

ACTIVITY_COLUMNS = (
    "c_custkey",
    "c_mktsegment",
    "n_name",
    "r_name",
    "c_acctbal",
    "n_orders",
    "total_spend",
    "avg_spend",
    "tenure_days",
    "urgent_share",
    "churned",
)
CATEGORICAL = ("c_mktsegment", "n_name", "r_name")
NUMERIC = ("c_acctbal", "n_orders", "total_spend", "avg_spend", "tenure_days", "urgent_share")
KEY = "c_custkey"
TARGET = "churned"


def activity_frame(
    customer: DataFrame,
    orders: DataFrame,
    nation: DataFrame,
    region: DataFrame,
    horizon_days: int = HORIZON_DAYS,
) -> DataFrame:
    cutoff = _cutoff(orders, horizon_days)

    before = F.col("o_orderdate") <= cutoff
    per_customer = (
        orders.select("o_custkey", "o_orderdate", "o_totalprice", "o_orderpriority")
        .groupBy("o_custkey")
        .agg(
            F.count_if(before).alias("n_orders"),
            F.sum(F.when(before, F.col("o_totalprice"))).alias("total_spend"),
            F.min(F.when(before, F.col("o_orderdate"))).alias("first_order"),
            F.count_if(before & (F.col("o_orderpriority") == URGENT_PRIORITY)).alias("n_urgent"),
            F.count_if(F.col("o_orderdate") > cutoff).alias("n_after"),
        )
        .where(F.col("n_orders") > 0)
    )

    geo = nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        "n_nationkey", "n_name", "r_name"
    )

    joined = customer.select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment").join(
        per_customer, F.col("c_custkey") == F.col("o_custkey")
    )
    joined = joined.join(geo, F.col("c_nationkey") == F.col("n_nationkey"))

    return joined.select(
        F.col("c_custkey"),
        F.col("c_mktsegment"),
        F.col("n_name"),
        F.col("r_name"),
        F.col("c_acctbal"),
        F.col("n_orders"),
        F.col("total_spend"),
        (F.col("total_spend") / F.col("n_orders")).alias("avg_spend"),
        F.datediff(cutoff.cast("date"), F.col("first_order").cast("date")).alias("tenure_days"),
        (F.col("n_urgent") / F.col("n_orders")).alias("urgent_share"),
        F.when(F.col("n_after") > 0, F.lit("No")).otherwise(F.lit("Yes")).alias("churned"),
    )


def _cutoff(orders: DataFrame, horizon_days: int):
    """The cutoff as a typed literal.

    One global max (partial per task, a single value to the driver) is
    formatted and cast back to the column's own type, so the literal is
    exact for ``timestamp_ntz`` and session-time-zone consistent for
    ``timestamp``. A literal (instead of a scalar subquery referenced five
    times) keeps the orders scan single and lets the filter reach the scan.
    """
    dtype = orders.schema["o_orderdate"].dataType
    text = orders.select(
        F.date_format(
            F.max("o_orderdate") - F.make_dt_interval(days=F.lit(horizon_days)),
            "yyyy-MM-dd HH:mm:ss.SSSSSS",
        )
    ).first()[0]
    return F.lit(text).cast(dtype)


def load_activity(spark: SparkSession, data_dir: str, horizon_days: int = HORIZON_DAYS) -> DataFrame:
    return activity_frame(
        load_table(spark, data_dir, "customer"),
        load_table(spark, data_dir, "orders"),
        load_table(spark, data_dir, "nation"),
        load_table(spark, data_dir, "region"),
        horizon_days=horizon_days,
    )
