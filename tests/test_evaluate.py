import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.sql import functions as F

from fixtures import CELLS, cells_frame
from riskframe.operators import evaluate


def _summary(spark, cells):
    return evaluate.summary(cells_frame(spark, *cells)).first().asDict()


@pytest.mark.parametrize(
    "name,expected",
    [
        ("LR", (0.857, 0.667, 0.013, 0.026)),
        ("RF", (0.849, 0.340, 0.053, 0.091)),
        ("GB", (0.855, 0.440, 0.036, 0.067)),
    ],
)
def test_published_sklearn_metrics(spark, name, expected):
    s = _summary(spark, CELLS[name])
    got = tuple(round(s[k], 3) for k in ("accuracy", "precision", "recall", "f1"))
    assert got == expected


def test_always_negative_is_the_published_spark_result(spark):
    s = _summary(spark, CELLS["all_negative"])
    assert round(s["accuracy"], 3) == 0.858
    assert round(s["weighted_f1"], 4) == 0.7924
    assert s["precision"] == s["recall"] == s["f1"] == 0.0


def test_zero_division_cases(spark):
    # no row of class 1 at all
    s = _summary(spark, (0, 0, 0, 10))
    assert s["precision"] == s["recall"] == s["f1"] == 0.0
    assert s["accuracy"] == 1.0
    # empty frame
    empty = cells_frame(spark, 1, 0, 0, 0).where(F.lit(False))
    e = evaluate.summary(empty).first().asDict()
    assert e["accuracy"] == 0.0 and e["f1"] == 0.0 and e["weighted_f1"] == 0.0


def test_confusion_matrix_keeps_empty_cells(spark):
    cm = evaluate.confusion_matrix(cells_frame(spark, 0, 0, 3, 5)).collect()
    cells = {(r.label, r.prediction): r["count"] for r in cm}
    assert cells == {(0.0, 0.0): 5, (0.0, 1.0): 0, (1.0, 0.0): 3, (1.0, 1.0): 0}


def test_classification_report_rows(spark):
    rep = {r["class"]: r for r in evaluate.classification_report(cells_frame(spark, *CELLS["RF"])).collect()}
    assert set(rep) == {"0", "1", "accuracy", "macro avg", "weighted avg"}
    assert rep["1"].support == 304 and rep["0"].support == 1809
    assert round(rep["accuracy"].f1, 3) == 0.849 and rep["accuracy"].precision is None
    assert rep["macro avg"].f1 == pytest.approx((rep["0"].f1 + rep["1"].f1) / 2)


def test_select_best_by_recall_then_f1(spark):
    rows = []
    for name in ("LR", "RF", "GB"):
        rows.append(cells_frame(spark, *CELLS[name]).withColumn("model", F.lit(name)))
    long = rows[0].unionByName(rows[1]).unionByName(rows[2])
    report = evaluate.metrics_report(long)
    assert evaluate.select_best(report).first()["model"] == "RF"


def test_compare_runs_never_ranks_ambiguous_metric(spark):
    a = spark.createDataFrame([("m", "f1-score", 0.9), ("m", "accuracy", 0.8), ("m", "fit_seconds", 2.0)], "model string, metric string, value double")
    b = spark.createDataFrame([("m", "f1-score", 0.1), ("m", "accuracy", 0.8), ("m", "fit_seconds", 1.0)], "model string, metric string, value double")
    out = {r.metric: r.better for r in evaluate.compare_runs(a, b).collect()}
    assert out == {"f1-score": None, "accuracy": "tie", "fit_seconds": "b"}


def test_evaluator_scores_fold_without_positives(spark):
    ev = evaluate.ClassMetricEvaluator("recall")
    assert ev.evaluate(cells_frame(spark, 0, 0, 0, 5)) == 0.0
    assert ev.evaluate(cells_frame(spark, 3, 0, 1, 5)) == pytest.approx(0.75)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 2)), min_size=3, max_size=40))
def test_matches_mllib_evaluators(spark, pairs):
    df = spark.createDataFrame([(float(a), float(b)) for a, b in pairs], "label double, prediction double")
    s = evaluate.summary(df).first().asDict()
    acc = MulticlassClassificationEvaluator(metricName="accuracy").evaluate(df)
    wf1 = MulticlassClassificationEvaluator(metricName="f1").evaluate(df)
    assert s["accuracy"] == pytest.approx(acc)
    assert s["weighted_f1"] == pytest.approx(wf1)
    if any(a == 1 for a, _ in pairs):
        rec = MulticlassClassificationEvaluator(metricName="recallByLabel", metricLabel=1.0).evaluate(df)
        prec = MulticlassClassificationEvaluator(metricName="precisionByLabel", metricLabel=1.0).evaluate(df)
        assert s["recall"] == pytest.approx(rec)
        assert s["precision"] == pytest.approx(prec)
