import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from fixtures import CATEGORICAL, NUMERIC, subscribers
from riskframe.functions.frames import right_sized
from riskframe.operators import evaluate, features, models, project, split
from riskframe.operators.models import feature_importance
from riskframe.plans.workflow import mllib_flow


def test_indexer_frequency_then_alphabetical_and_unseen(spark):
    fit_df = spark.createDataFrame([(1, "b"), (2, "a"), (3, "c"), (4, "a"), (5, "b"), (6, "c")], "id long, c string")
    model = features.category_indexer(["c"]).fit(fit_df)
    assert model.labelsArray[0] == ["a", "b", "c"]
    new = spark.createDataFrame([(7, "a"), (8, "z"), (9, None)], "id long, c string")
    idx = [r.c_idx for r in model.transform(new).orderBy("id").collect()]
    assert idx == [0.0, 3.0, 3.0]


def test_one_hot_unseen_is_all_zero(spark):
    fit_df = spark.createDataFrame([(1, "x"), (2, "y"), (3, "y")], "id long, c string")
    from pyspark.ml import Pipeline

    model = Pipeline(stages=features.one_hot_encoder(["c"])).fit(fit_df)
    new = spark.createDataFrame([(1, "x"), (2, "q")], "id long, c string")
    vecs = [r.v for r in model.transform(new).orderBy("id").select(vector_to_array("c_ohe").alias("v")).collect()]
    assert vecs == [[0.0, 1.0], [0.0, 0.0]]
    cols = features.one_hot_columns(fit_df, ["c"], keep=["id"])
    assert cols.columns == ["id", "c_y", "c_x"]


def test_standardizer_population_std_and_constant_column(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0)], "x double, k double")
    out = features.standardize(df, ["x", "k"], ddof=0).collect()
    assert [round(r.x_std, 6) for r in out] == [-1.224745, 0.0, 1.224745]
    assert all(r.k_std == 0.0 for r in out)
    sample = features.standardize(df, ["x"], ddof=1).collect()
    assert [r.x_std for r in sample] == [-1.0, 0.0, 1.0]


def test_standardizer_roundtrip(spark, tmp_path):
    df = spark.createDataFrame([(1.0,), (3.0,)], "x double")
    model = features.ColumnStandardizer(inputCols=["x"], outputCols=["z"]).fit(df)
    path = str(tmp_path / "std")
    model.save(path)
    loaded = features.ColumnStandardizerModel.load(path)
    assert [r.z for r in loaded.transform(df).collect()] == [-1.0, 1.0]


def test_column_roles_from_schema(spark):
    df = subscribers(spark, 10)
    cat, num = features.column_roles(df, exclude=["customerID", "Churn"])
    assert cat == CATEGORICAL and num == NUMERIC


@pytest.fixture(scope="module")
def planted(spark):
    df = project.binary_label(subscribers(spark, 4000, seed=11, signal=3.0), "Churn", "Yes", "label")
    train, test = split.train_test(df, "label", "customerID", 0.3, seed=42)
    return right_sized(train), test


def test_planted_signal_is_learned(spark, planted):
    train, test = planted
    pipe = models.with_model(features.preprocess_pipeline(CATEGORICAL, NUMERIC, "ordinal"), models.logistic_spark())
    model, secs = models.fit_timed(pipe, train)
    scored = models.score(model, test, keep=["label"], with_prediction=True)
    s = evaluate.summary(scored).first()
    assert s.accuracy > 0.8 and s.recall > 0.6
    rows = scored.select("churn_proba", "prediction").collect()
    assert all(0.0 <= r.churn_proba <= 1.0 for r in rows)
    assert all((r.churn_proba > 0.5) == (r.prediction == 1.0) for r in rows)


def test_forest_importances_named_and_normalised(spark, planted):
    train, _ = planted
    rf = models.forest_notebook(max_depth=6)
    rf.setNumTrees(20)
    pipe = models.with_model(features.preprocess_pipeline(CATEGORICAL, NUMERIC, "onehot"), rf)
    model = pipe.fit(train)
    imps = feature_importance(model, train, CATEGORICAL, NUMERIC, k=100).collect()
    assert abs(sum(r.importance for r in imps) - 1.0) < 1e-6
    values = [r.importance for r in imps]
    assert values == sorted(values, reverse=True)
    names = {r.feature for r in imps}
    assert "num__tenure" in names and any(n.startswith("cat__Contract_") for n in names)


def test_boosting_and_weights(spark, planted):
    train, test = planted
    weighted = models.class_weights(train, "label")
    w = {r.label: r.weight for r in weighted.select("label", "weight").distinct().collect()}
    n1 = train.where("label = 1.0").count()
    n = train.count()
    assert w[1.0] == pytest.approx(n / (2 * n1))
    gb = models.boosting()
    gb.setMaxIter(5)
    pipe = models.with_model(features.preprocess_pipeline(CATEGORICAL, NUMERIC, "onehot"), gb)
    model = pipe.fit(train)
    assert models.predict(model, test, keep=["customerID"]).count() == test.count()


def test_depth_and_leaf_bound_the_forest(spark, planted):
    train, _ = planted
    small, _ = models.fit_forest(train, CATEGORICAL, NUMERIC, "notebook", max_depth=3, min_leaf=50)
    large, _ = models.fit_forest(train, CATEGORICAL, NUMERIC, "notebook", max_depth=8)
    assert 100 <= models.n_nodes(small) <= 100 * 15 < models.n_nodes(large)


def test_fixed_coefficient_score(spark):
    df = spark.createDataFrame([(0.0,), (2.0,)], "x double")
    out = [r.p for r in models.score({"intercept": 0.0, "x": 1.0}, df, out="p").collect()]
    assert out[0] == 0.5 and out[1] == pytest.approx(1 / (1 + 2.718281828459045**-2))


def test_mllib_flow_reports_both_models(spark):
    df = subscribers(spark, 1500, seed=5)
    res = mllib_flow(df, CATEGORICAL, NUMERIC, "Churn", "customerID")
    rep = {r.model: r for r in res.report.collect()}
    assert set(rep) == {"Logistic Regression", "Random Forest"}
    assert all(0.0 <= r.accuracy <= 1.0 and r.fit_seconds > 0 for r in rep.values())


def test_cross_validate_rows(spark, planted):
    train, _ = planted
    folded = split.stratified_folds(train, "label", "customerID", k=3)
    pipe = models.with_model(features.preprocess_pipeline(CATEGORICAL, NUMERIC), models.logistic_spark())
    out = evaluate.cross_validate(folded, pipe, "label", "fold", k=3).collect()
    sides = {(r.side, r.metric) for r in out}
    assert ("test", "macro_f1") in sides and ("train", "accuracy") in sides and ("fit", "fit_seconds") in sides
    assert all(r.std >= 0 for r in out)


def test_null_policy_is_explicit(spark):
    df = spark.createDataFrame(
        [("a", 1.0, 0.0), ("b", None, 1.0), ("a", 3.0, 0.0), (None, 5.0, 1.0)], "c string, x double, label double"
    )
    with pytest.raises(Exception):
        features.preprocess_pipeline(["c"], ["x"]).fit(df).transform(df).collect()
    skipped = features.preprocess_pipeline(["c"], ["x"], handle_invalid="skip").fit(df).transform(df)
    assert skipped.count() == 3
    imputed = features.preprocess_pipeline(["c"], ["x"], mode="onehot", handle_invalid="impute").fit(df).transform(df)
    vals = [r.v for r in imputed.select(vector_to_array("features").alias("v")).collect()]
    assert len(vals) == 4 and all(v[0] == v[0] for v in vals)  # no NaN
    names = features.slot_names(imputed, "features")
    assert [features.readable_name(n, ["x"], ["c"]) for n in names] == ["num__x", "cat__c_a", "cat__c_b"]


def test_notebook_flow_end_to_end(spark):
    from riskframe.plans.workflow import notebook_flow

    df = subscribers(spark, 800, seed=3, signal=3.0)
    res = notebook_flow(
        df, CATEGORICAL, NUMERIC, "Churn", "customerID", folds=2, grid="star",
        profile_cols=["Contract", "InternetService", "tenure", "MonthlyCharges"],
        forest_trees=20, boost_stages=10,
    )
    report = {r.model for r in res.report.collect()}
    assert report == {"Logistic Regression", "Random Forest", "Gradient Boosting"}
    assert res.extras["best_model"] in report
    assert len(res.extras["importances"].collect()) == 10
    assert {r.side for r in res.extras["cross_validation"].collect()} == {"test", "train", "fit"}
    grid = res.extras["grid"].collect()
    assert len(grid) == 8 and sum(r.is_best for r in grid) == 1
    assert all(0 <= r.cv_score <= 1 and 0 <= r.train_score <= 1 and r.fit_seconds > 0 for r in grid)
    assert len(workflow_grid()) == 72
    assert {r["class"] for r in res.extras["tuned_report"].collect()} >= {"0", "1", "accuracy"}
    assert {r.model for r in res.extras["classification_reports"].collect()} == report
    assert res.extras["missing"].first().n_missing == 0 and res.extras["duplicate_keys"].first().n_duplicates == 0
    scored = res.extras["scored"]
    assert scored.count() == 800
    assert {r.split for r in scored.select("split").distinct().collect()} == {"train", "test"}
    top = res.extras["high_risk"].collect()
    assert len(top) <= 20 and all(r.churn_proba >= 0.8 for r in top)
    roi = res.extras["roi"].first()
    assert roi.n_targeted >= len(top)
    cm = res.extras["confusion_matrix"].collect()
    n_test = res.extras["split_frame"].where("_split = 'test'").count()
    assert sum(r["count"] for r in cm) == n_test

    from riskframe.functions.frames import scratch_path
    from riskframe.plans.workflow import write_outputs
    from riskframe.sources import io

    paths = write_outputs(res, scratch_path(spark, "notebook-out"), key_cols=["customerID", "churn_proba"])
    assert io.read_table(spark, paths["scored"]).count() == 800
    assert io.read_table(spark, paths["importances"]).count() == 10
    assert io.read_metrics(spark, paths["metrics"]).select("model").distinct().count() == 3


def test_fixed_seed_repeats_on_fixed_partitioning(spark, planted):
    train, test = planted
    pipe = models.with_model(features.preprocess_pipeline(CATEGORICAL, NUMERIC), models.forest_spark())
    a = models.score(pipe.fit(train), test, keep=["customerID"]).orderBy("customerID").collect()
    b = models.score(pipe.fit(train), test, keep=["customerID"]).orderBy("customerID").collect()
    assert a == b


def test_explicit_threshold_raises_recall(spark, planted):
    train, test = planted
    model, _ = models.fit_logistic(train, CATEGORICAL, NUMERIC, "spark")
    default = evaluate.summary(models.score(model, test, keep=["label"], with_prediction=True)).first()
    low = evaluate.summary(models.score(model, test, keep=["label"], with_prediction=True, threshold=0.2)).first()
    assert low.recall >= default.recall
    fixed = models.score({"intercept": 0.0, "x": 1.0}, spark.createDataFrame([(0.1,), (-0.1,)], "x double"),
                         out="p", with_prediction=True, threshold=0.5)
    assert [r.prediction for r in fixed.collect()] == [1.0, 0.0]


def workflow_grid():
    from riskframe.plans.workflow import reference_grid

    return reference_grid(models.forest_notebook())


def test_grid_search_keeps_the_callers_pool_and_weights_by_fold(spark, planted):
    from pyspark.ml.tuning import ParamGridBuilder

    from riskframe.plans.workflow import weighted_preprocessing

    train, _ = planted
    folded = right_sized(split.stratified_folds(train, "label", "customerID", k=2))
    lr = models.logistic_spark().setWeightCol("w_balanced")
    grid = ParamGridBuilder().addGrid(lr.regParam, [0.01, 0.1]).build()
    spark.sparkContext.setLocalProperty("spark.scheduler.pool", "search")
    try:
        best, results = evaluate.grid_search(
            folded, weighted_preprocessing(CATEGORICAL, NUMERIC), lr, grid, "label", "fold", k=2, metric="f1", parallelism=2
        )
        assert spark.sparkContext.getLocalProperty("spark.scheduler.pool") == "search"
    finally:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)
    rows = results.collect()
    assert len(rows) == 2 and sum(r.is_best for r in rows) == 1
    assert all(r.fit_seconds is None for r in rows)
    assert best.transform(train).where("prediction is null").count() == 0
    w = evaluate.BalancedWeights().fit(folded.where("fold = 0"))
    n, pos = folded.where("fold = 0").count(), folded.where("fold = 0 and label = 1").count()
    assert w.weights[1.0] == pytest.approx(n / (2 * pos))


def test_too_many_levels_raise_with_the_columns_name(spark):
    df = spark.range(3000).select(
        F.concat(F.lit("customer_"), F.col("id").cast("string")).alias("name"), (F.col("id") % 3).cast("string").alias("kind")
    )
    for run in (
        lambda: features.index_categories(df, ["kind", "name"], max_levels=1000),
        lambda: features.one_hot(df, ["name"], max_levels=1000),
        lambda: features.one_hot_columns(df, ["kind", "name"]),
        lambda: features.preprocess_pipeline(["kind", "name"], [], max_levels=1000).fit(df),
    ):
        with pytest.raises(ValueError, match="name"):
            run()
    assert features.index_categories(df, ["kind"]).count() == 3000


def test_missing_labels_are_left_out(spark):
    df = spark.createDataFrame(
        [(1.0, 1.0), (0.0, 0.0), (None, 1.0), (1.0, None), (float("nan"), 0.0)], "label double, prediction double"
    )
    s = evaluate.summary(df).first()
    assert (s.n, s.accuracy, s.macro_f1) == (2.0, 1.0, 1.0)
