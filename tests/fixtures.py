"""Test inputs of FIXTURES.md: the subscriber schema (F1), scored rows
(F2), metrics documents (F3), confusion cells (F4) and edge frames (F5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The subscriber table's columns and the column roles used by
# the reference's MLlib script.
SUBSCRIBER_SCHEMA = (
    "customerID string, gender string, SeniorCitizen int, Partner string, Dependents string, "
    "tenure int, PhoneService string, MultipleLines string, InternetService string, "
    "OnlineSecurity string, OnlineBackup string, DeviceProtection string, TechSupport string, "
    "StreamingTV string, StreamingMovies string, Contract string, InternetCharges double, "
    "MonthlyCharges double, TotalCharges double, Churn string"
)
CATEGORICAL = [
    "gender", "Partner", "Dependents", "PhoneService", "MultipleLines", "InternetService",
    "OnlineSecurity", "OnlineBackup", "DeviceProtection", "TechSupport", "StreamingTV",
    "StreamingMovies", "Contract",
]
NUMERIC = ["SeniorCitizen", "tenure", "InternetCharges", "MonthlyCharges", "TotalCharges"]

# The ten previewed rows of the reference's log (values as printed).
PREVIEW_ROWS = [
    ("customer_1", "Male", 0, "No", "Yes", 51, "Yes", "Yes", "No", "No internet service", "No internet service", "No internet service", "No internet service", "No internet service", "No internet service", "Month-to-month", 0.0, 43.53, 2220.03, "No"),
    ("customer_2", "Male", 1, "Yes", "Yes", 14, "Yes", "Yes", "DSL", "No internet service", "No internet service", "Yes", "No internet service", "Yes", "No internet service", "Two year", 46.0, 109.39, 1531.46, "No"),
    ("customer_3", "Female", 0, "Yes", "No", 71, "No", "No", "DSL", "Yes", "No", "Yes", "Yes", "No", "Yes", "One year", 34.36, 99.36, 7054.56, "No"),
    ("customer_4", "Male", 1, "Yes", "No", 60, "Yes", "No phone service", "Fiber optic", "No internet service", "No internet service", "No", "No internet service", "Yes", "No internet service", "Two year", 65.56, 115.12, 6907.2, "No"),
    ("customer_5", "Male", 0, "Yes", "No", 20, "No", "No", "No", "No internet service", "No internet service", "No internet service", "No internet service", "No internet service", "No internet service", "One year", 0.0, 20.0, 400.0, "Yes"),
    ("customer_6", "Female", 0, "No", "Yes", 23, "Yes", "No phone service", "No", "No internet service", "No internet service", "No internet service", "No internet service", "No internet service", "No internet service", "Month-to-month", 0.0, 33.27, 765.21, "No"),
    ("customer_7", "Male", 1, "Yes", "Yes", 2, "Yes", "No", "Fiber optic", "No", "Yes", "Yes", "No internet service", "No internet service", "No", "One year", 77.01, 129.92, 259.84, "No"),
    ("customer_8", "Female", 0, "No", "Yes", 21, "Yes", "No phone service", "No", "No internet service", "No internet service", "No internet service", "No internet service", "No internet service", "No internet service", "Two year", 0.0, 35.25, 740.25, "No"),
    ("customer_9", "Female", 1, "Yes", "Yes", 52, "No", "Yes", "DSL", "Yes", "Yes", "No internet service", "Yes", "No internet service", "No", "One year", 43.86, 88.86, 4620.72, "No"),
    ("customer_10", "Female", 1, "Yes", "Yes", 1, "No", "No phone service", "Fiber optic", "Yes", "No", "No", "Yes", "No", "Yes", "Two year", 136.31, 191.31, 191.31, "No"),
]

# The nine published risk-list rows (customerID, Contract,
# InternetService, tenure, MonthlyCharges, churn_proba).
RISK_ROWS = [
    ("customer_1714", "Month-to-month", "Fiber optic", 2, 136.05, 0.8404514875482348),
    ("customer_117", "Month-to-month", "Fiber optic", 3, 199.07, 0.8218873903178892),
    ("customer_5055", "Month-to-month", "Fiber optic", 0, 196.33, 0.8204119818875456),
    ("customer_602", "One year", "Fiber optic", 2, 165.89, 0.8119824884237831),
    ("customer_1866", "Month-to-month", "Fiber optic", 1, 181.51, 0.8108931170673263),
    ("customer_2863", "Month-to-month", "Fiber optic", 4, 139.76, 0.8032354883730458),
    ("customer_32", "One year", "Fiber optic", 2, 138.35, 0.8032216213169816),
    ("customer_1410", "One year", "Fiber optic", 0, 128.11, 0.801421243376338),
    ("customer_4182", "Month-to-month", "Fiber optic", 3, 175.11, 0.8010405447203298),
]

# The two published metrics documents.
SKLEARN_METRICS_JSON = """{
  "Logistic Regression": {"time": "0.072", "accuracy": "0.857", "precision": "0.667", "recall": "0.013", "f1-score": "0.026"},
  "Random Forest": {"time": "0.481", "accuracy": "0.849", "precision": "0.340", "recall": "0.053", "f1-score": "0.091"},
  "Gradient Boosting": {"time": "0.779", "accuracy": "0.855", "precision": "0.440", "recall": "0.036", "f1-score": "0.067"}
}"""
SPARK_METRICS_JSON = """{
  "Logistic Regression": {"time": "10.553", "accuracy": "0.858", "f1-score": "0.792"},
  "Random Forest": {"time": "6.910", "accuracy": "0.858", "f1-score": "0.792"}
}"""

# Confusion cells (TP, FP, FN, TN) consistent with the published metrics.
CELLS = {
    "LR": (4, 2, 300, 1807),
    "RF": (16, 31, 288, 1778),
    "GB": (11, 14, 293, 1795),
    "all_negative": (0, 0, 142, 858),
}


def preview_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PREVIEW_ROWS, SUBSCRIBER_SCHEMA)


def cells_frame(spark: SparkSession, tp: int, fp: int, fn: int, tn: int) -> DataFrame:
    """(label, prediction) rows with the given confusion cells, built by
    exploding counts (no Python-side rows)."""
    spec = F.array(
        *[
            F.struct(F.lit(float(lab)).alias("label"), F.lit(float(pred)).alias("prediction"), F.lit(n).alias("n"))
            for lab, pred, n in ((1, 1, tp), (0, 1, fp), (1, 0, fn), (0, 0, tn))
        ]
    )
    return (
        spark.range(1)
        .select(F.inline(spec))
        .select("label", "prediction", F.explode(F.sequence(F.lit(1), F.greatest(F.col("n"), F.lit(1)))).alias("i"), "n")
        .where(F.col("n") > 0)
        .select("label", "prediction")
    )


def subscribers(spark: SparkSession, n: int, seed: int = 7, signal: float = 1.0) -> DataFrame:
    """Generated subscriber table (F1 rules) with planted attrition: the
    log-odds rise with month-to-month contracts, fiber, low tenure and high
    monthly charges. ``signal`` scales the planted effect."""
    r = lambda k: F.rand(seed + k)
    df = spark.range(n).select(
        F.concat(F.lit("customer_"), (F.col("id") + 1).cast("string")).alias("customerID"),
        F.when(r(1) < 0.5, "Male").otherwise("Female").alias("gender"),
        (r(2) < 0.5).cast("int").alias("SeniorCitizen"),
        F.when(r(3) < 0.5, "Yes").otherwise("No").alias("Partner"),
        F.when(r(4) < 0.5, "Yes").otherwise("No").alias("Dependents"),
        F.floor(r(5) * 73).cast("int").alias("tenure"),
        F.when(r(6) < 0.8, "Yes").otherwise("No").alias("PhoneService"),
        F.when(r(7) < 0.4, "Yes").when(r(7) < 0.8, "No").otherwise("No phone service").alias("MultipleLines"),
        F.when(r(8) < 0.35, "DSL").when(r(8) < 0.8, "Fiber optic").otherwise("No").alias("InternetService"),
        F.when(r(9) < 0.5, "Month-to-month").when(r(9) < 0.75, "One year").otherwise("Two year").alias("Contract"),
        (F.round(20 + r(10) * 100, 2)).alias("base"),
    )
    addon = lambda k: F.when(F.col("InternetService") == "No", "No internet service").when(r(k) < 0.5, "Yes").otherwise("No")
    df = df.select(
        "*",
        addon(11).alias("OnlineSecurity"),
        addon(12).alias("OnlineBackup"),
        addon(13).alias("DeviceProtection"),
        addon(14).alias("TechSupport"),
        addon(15).alias("StreamingTV"),
        addon(16).alias("StreamingMovies"),
        F.when(F.col("InternetService") == "No", F.lit(0.0)).otherwise(F.round(r(17) * 120, 2)).alias("InternetCharges"),
    )
    df = df.withColumn("MonthlyCharges", F.round(F.col("base") + F.col("InternetCharges"), 2))
    df = df.withColumn("TotalCharges", F.round(F.col("tenure") * F.col("MonthlyCharges"), 2))
    logit = (
        F.lit(-2.2)
        + F.lit(signal) * (
            F.when(F.col("Contract") == "Month-to-month", 2.0).otherwise(-1.0)
            + F.when(F.col("InternetService") == "Fiber optic", 1.0).otherwise(0.0)
            - F.col("tenure") / 18.0
            + (F.col("MonthlyCharges") - 100.0) / 40.0
        )
    )
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))
    df = df.withColumn("Churn", F.when(r(18) < p, "Yes").otherwise("No"))
    return df.select(
        "customerID", "gender", "SeniorCitizen", "Partner", "Dependents", "tenure", "PhoneService",
        "MultipleLines", "InternetService", "OnlineSecurity", "OnlineBackup", "DeviceProtection",
        "TechSupport", "StreamingTV", "StreamingMovies", "Contract", "InternetCharges", "MonthlyCharges",
        "TotalCharges", "Churn",
    )
