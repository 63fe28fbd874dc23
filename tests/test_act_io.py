import os

import pytest

from fixtures import RISK_ROWS, SKLEARN_METRICS_JSON, SPARK_METRICS_JSON
from riskframe.functions.frames import scratch_path
from riskframe.operators import act, evaluate
from riskframe.sources import io

RISK_SCHEMA = "customerID string, Contract string, InternetService string, tenure int, MonthlyCharges double, churn_proba double"


def test_published_risk_list_and_roi(spark):
    df = spark.createDataFrame(RISK_ROWS, RISK_SCHEMA)
    top = act.high_risk(df, "churn_proba", 0.80, 20, key=["customerID"]).collect()
    assert len(top) == 9 and top[0].customerID == "customer_1714"
    roi = act.retention_roi(act.at_risk(df)).first()
    assert (roi.n_targeted, roi.expected_gain, roi.expected_cost) == (9, 1350.0, 900.0)
    assert roi.roi_pct == pytest.approx(50.0)


def test_roi_of_nobody_is_null(spark):
    df = spark.createDataFrame(RISK_ROWS, RISK_SCHEMA)
    roi = act.retention_roi(act.at_risk(df, threshold=0.99)).first()
    assert roi.n_targeted == 0 and roi.roi_pct is None


def test_threshold_is_inclusive(spark):
    df = spark.createDataFrame([("a", 0.8), ("b", 0.7999)], "k string, churn_proba double")
    assert [r.k for r in act.at_risk(df).collect()] == ["a"]


def test_risk_profile(spark):
    df = spark.createDataFrame(RISK_ROWS, RISK_SCHEMA)
    prof = {r.column_name: r for r in act.risk_profile(df, ["Contract", "InternetService", "tenure", "MonthlyCharges", "x"]).collect()}
    assert prof["Contract"].top == "Month-to-month" and prof["Contract"].freq == 6
    assert prof["InternetService"].unique == 1
    assert prof["tenure"].max == 4.0


def _write_doc(spark, text):
    path = scratch_path(spark, "doc")
    local = path[len("file:"):] if path.startswith("file:") else path
    os.makedirs(local, exist_ok=True)
    with open(os.path.join(local, "part-0.json"), "w") as f:
        f.write(text)
    return path


def test_read_reference_metrics_documents(spark):
    sk = io.read_metrics(spark, _write_doc(spark, SKLEARN_METRICS_JSON), engine="sklearn", f1_means="f1")
    sp = io.read_metrics(spark, _write_doc(spark, SPARK_METRICS_JSON), engine="spark", f1_means="weighted_f1")
    rows = {(r.model, r.metric): r.value for r in sk.collect()}
    assert rows[("Random Forest", "recall")] == 0.053 and rows[("Gradient Boosting", "fit_seconds")] == 0.779
    cmp = {(r.model, r.metric): r for r in evaluate.compare_runs(sk, sp).collect()}
    # the two engines' F1 are different metrics and never meet in one row
    assert cmp[("Random Forest", "f1")].value_b is None
    assert cmp[("Random Forest", "weighted_f1")].value_a is None
    assert cmp[("Logistic Regression", "accuracy")].better == "b"
    assert cmp[("Logistic Regression", "fit_seconds")].better == "a"


def test_metrics_roundtrip(spark):
    tidy = spark.createDataFrame(
        [("LR", "accuracy", 0.8574), ("LR", "recall", 0.0131), ("RF", "accuracy", 0.849)],
        "model string, metric string, value double",
    )
    path = scratch_path(spark, "metrics")
    io.write_metrics(tidy, path)
    back = {(r.model, r.metric): r.value for r in io.read_metrics(spark, path).collect()}
    assert back == {("LR", "accuracy"): 0.857, ("LR", "recall"): 0.013, ("RF", "accuracy"): 0.849}


def test_csv_roundtrip_with_schema(spark):
    df = spark.createDataFrame(RISK_ROWS, RISK_SCHEMA)
    path = scratch_path(spark, "csv")
    io.write_table(df, path)
    back = io.read_table(spark, path, schema=df.schema)
    assert sorted(back.collect()) == sorted(df.collect())
    inferred = io.read_table(spark, path)
    assert dict(inferred.dtypes)["tenure"] == "int"


def test_reference_script_from_csv(spark):
    from fixtures import subscribers
    from riskframe.plans.workflow import reference_script

    csv = scratch_path(spark, "subscribers")
    io.write_table(subscribers(spark, 1200, seed=9), csv)
    doc = _write_doc(spark, SKLEARN_METRICS_JSON)
    out = reference_script(spark, csv, scratch_path(spark, "spark_metrics"), other_metrics=doc)
    assert out["shape"].first().n_cols == 20
    assert out["schema"].where("column_name = 'tenure'").first().data_type == "int"
    models = {r.model for r in out["metrics"].collect()}
    assert models == {"Logistic Regression", "Random Forest"}
    cmp = {(r.model, r.metric): r for r in out["comparison"].collect()}
    assert cmp[("Random Forest", "accuracy")].better in ("a", "b", "tie")
    assert cmp[("Random Forest", "weighted_f1")].value_b is None  # never matched with the other f1


def test_read_table_null_token(spark):
    path = scratch_path(spark, "nulls")
    local = path[len("file:"):] if path.startswith("file:") else path
    os.makedirs(local, exist_ok=True)
    with open(os.path.join(local, "part-0.csv"), "w") as f:
        f.write("id,x,s\n1,1.5,a\n2,NA,b\n3,,NA\n")
    df = io.read_table(spark, path, null_value="NA")
    rows = {r.id: r for r in df.collect()}
    assert dict(df.dtypes)["x"] == "double"
    assert rows[2].x is None and rows[3].x is None and rows[3].s is None and rows[1].s == "a"
