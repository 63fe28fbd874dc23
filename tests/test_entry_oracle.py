"""Driver contract: entry, the query catalog and the SQL oracle."""

import __spark_entry__ as e
from conftest import SF_SMALL
from oracle_check import compare

EXPECTED = {
    "read_table", "read_metrics", "write_table", "write_metrics",
    "schema_report", "table_shape", "preview", "describe_numeric", "describe_text", "describe_mixed",
    "value_counts", "value_shares", "histogram", "duplicate_count", "null_counts", "null_total",
    "map_label", "binary_label", "features_and_target", "select_existing", "filter_at_least", "top_k",
    "index_categories", "one_hot", "standardize", "scale_vector", "assemble", "preprocess_pipeline",
    "random_split", "stratified_split", "stratified_folds",
    "fit_logistic", "fit_logistic_notebook", "fit_forest", "fit_forest_notebook", "fit_boosting",
    "predict", "score", "class_weights",
    "confusion_matrix", "accuracy", "precision_binary", "recall_binary", "f1_binary", "f1_weighted",
    "macro_scores", "classification_report", "metrics_report", "select_best", "cross_validate",
    "grid_search", "feature_importance", "compare_runs",
    "high_risk", "risk_profile", "retention_roi", "describe_lineitem", "risk_flow",
}


def test_catalog_covers_the_inventory():
    optional = {n for n in e.queries() if n.startswith("op") or n == "pipeline"}
    assert set(e.queries()) - optional == EXPECTED
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_runs(spark):
    df = e.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert "churn_proba" in df.columns and "c_custkey" in df.columns


def test_oracle_matches_at_small_scale(spark):
    res = compare(spark, SF_SMALL, names=sorted(EXPECTED & set(e.oracle_sql())), verbose=False)
    bad = {k: v for k, v in res.items() if v[0] != "ok"}
    assert not bad, bad


def test_plans_have_no_python_or_cartesian_nodes(spark):
    from plan_audit import audit, relational

    # scans that must read only the columns the query needs
    pruned = {
        "top_k": ["struct<o_orderkey:bigint,o_custkey:bigint,o_totalprice:double>"],
        "value_counts": ["struct<c_acctbal:double>"],
        "table_shape": ["struct<>"],
        "duplicate_count": ["struct<o_custkey:bigint>"],
        "confusion_matrix": ["struct<quality:int,toxic:int>"],
    }
    qs = e.queries()
    flagged = {}
    for name in relational(e.oracle_sql()):
        a = audit(qs[name](spark, SF_SMALL))
        if a["bad"]:
            flagged[name] = a["bad"]
        if name in pruned:
            assert a["scans"] == pruned[name], (name, a["scans"])
    assert not flagged, flagged


def test_entries_leave_nothing_cached(spark):
    from plan_audit import FITTING, relational

    qs = e.queries()
    kept = spark.sparkContext._jsc.getPersistentRDDs
    left = {}
    for name in [*relational(e.queries()), *sorted(FITTING - {"grid_search", "cross_validate", "fit_boosting"})]:
        before = kept().size()
        qs[name](spark, SF_SMALL).count()
        if kept().size() > before:
            left[name] = kept().size() - before
    assert not left, left
