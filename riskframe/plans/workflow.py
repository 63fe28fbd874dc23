"""End-to-end flows of the reference, re-expressed Spark-first.

``mllib_flow`` is the MLlib script: label → preprocessing → split → fit
logistic regression and random forest → evaluate → tidy metrics.
``notebook_flow`` is the notebook: three learners on the one-hot path,
metrics, best model, confusion matrix, importances, cross-validation,
grid search, then score every customer → risk list → profile → ROI.

Differences from the reference that matter at scale: preprocessing is
fitted once per flow and its vector frame written (the reference fits it
once per model and re-reads the input for every fit); all metrics of all
models come from one aggregate; the split is a function of the key, not
of partitioning; only bounded results (model state, metrics, top-k) reach
the driver.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.functions.frames import right_sized, written
from riskframe.operators import act, evaluate, features, models, profile, project, split
from riskframe.operators.models import feature_importance  # noqa: F401  (re-export)


@dataclass
class FlowResult:
    models: dict = field(default_factory=dict)
    fit_seconds: dict = field(default_factory=dict)
    report: DataFrame | None = None
    extras: dict = field(default_factory=dict)


def _timings(spark, secs: dict) -> DataFrame:
    return spark.createDataFrame([(m, float(s)) for m, s in secs.items()], "model string, fit_seconds double")


def mllib_flow(
    df: DataFrame,
    categorical: Sequence[str],
    numeric: Sequence[str],
    target: str,
    key: str,
    positive="Yes",
    seed: int = 42,
    test_size: float = 0.3,
) -> FlowResult:
    """The MLlib script with its two learners (LR maxIter 100 / regParam
    0.05; forest of 100 trees), evaluated on a stratified hash split."""
    labelled = project.binary_label(df, target, positive, "label")
    tagged = written(split.stratified_split(labelled, "label", key, test_size, seed, out="_split"), "flow")
    train = right_sized(tagged.where(F.col("_split") == "train").drop("_split"))
    test = tagged.where(F.col("_split") == "test").drop("_split")
    prep = features.preprocess_pipeline(categorical, numeric, mode="ordinal")
    prep_model, prep_secs = models.fit_timed(prep, train)
    # the vectors keep the checkpointed frame's layout; learners cache their
    # own points and release them
    train_v = prep_model.transform(train).select(key, "label", "features")
    test_v = prep_model.transform(test).select(key, "label", "features")
    res = FlowResult()
    for name, learner in (
        ("Logistic Regression", models.logistic_spark()),
        ("Random Forest", models.forest_spark(seed=seed)),
    ):
        m, secs = models.fit_timed(learner, train_v)
        res.models[name] = m
        res.fit_seconds[name] = secs + prep_secs
    preds = None
    for name, m in res.models.items():
        p = m.transform(test_v).select(F.lit(name).alias("model"), "label", "prediction")
        preds = p if preds is None else preds.unionByName(p)
    res.report = evaluate.metrics_report(preds, fit_seconds=_timings(df.sparkSession, res.fit_seconds))
    res.extras["preprocess"] = prep_model
    res.extras["train"] = train
    return res


# The notebook's search mapped to MLlib's forest parameters.
GRID = {
    "weightCol": ["w_unit", "w_balanced"],
    "numTrees": [100, 200, 300],
    "maxDepth": [models.MAX_TREE_DEPTH, 8, 16],
    "minInstancesPerNode": [1, 5],
    "featureSubsetStrategy": ["sqrt", "log2"],
}


def reference_grid(forest) -> list[dict]:
    """All 72 combinations."""
    builder = ParamGridBuilder()
    for name, values in GRID.items():
        builder = builder.addGrid(forest.getParam(name), values)
    return builder.build()


def star_grid(forest) -> list[dict]:
    """The first value of every dimension, and each other value with the
    first ones of the rest: 8 combinations that vary all five dimensions."""
    base = {forest.getParam(name): values[0] for name, values in GRID.items()}
    return [base] + [
        base | {forest.getParam(name): v} for name, values in GRID.items() for v in values[1:]
    ]


def weighted_preprocessing(categorical: Sequence[str], numeric: Sequence[str]) -> Pipeline:
    """The one-hot preprocessing after a stage that learns the balanced class
    weights, so both are fitted on a fold's training side alone."""
    prep = features.preprocess_pipeline(categorical, numeric, mode="onehot")
    return Pipeline(stages=[evaluate.BalancedWeights("label", "w_balanced"), *prep.getStages()])


def notebook_flow(
    df: DataFrame,
    categorical: Sequence[str],
    numeric: Sequence[str],
    target: str,
    key: str,
    positive="Yes",
    seed: int = 42,
    test_size: float = 0.3,
    folds: int = 5,
    grid: str | None = "reference",
    threshold: float = act.THRESHOLD,
    top: int = act.TOP_K,
    profile_cols: Sequence[str] = (),
    parallelism: int = 1,
    forest_trees: int = models.N_TREES,
    boost_stages: int = models.GB_STAGES,
) -> FlowResult:
    """The notebook, end to end. ``grid="reference"`` searches its mapped
    grid (72 combinations × ``folds``, numbers of trees sharing a fit), ``"star"`` each dimension on its own
    (8 combinations), ``None`` skips the search and lists risks by the untuned
    forest. ``forest_trees`` / ``boost_stages`` default to the reference's
    100; with ``forest_trees`` other than that the grid's tree counts shrink
    in proportion. Times are measured with ``parallelism=1``.
    """

    def forest():
        return models.forest_notebook(seed=seed).setNumTrees(forest_trees)

    spark = df.sparkSession
    res = FlowResult()
    res.extras["missing"] = profile.null_total(df)
    res.extras["missing_by_column"] = profile.null_counts(df)
    res.extras["duplicates"] = profile.duplicate_count(df, df.columns)
    res.extras["duplicate_keys"] = profile.duplicate_count(df, [key])
    res.extras["target_shares"] = profile.value_shares(df, target)
    labelled = project.binary_label(df, target, positive, "label").withColumn("w_unit", F.lit(1.0))
    tagged = written(split.stratified_split(labelled, "label", key, test_size, seed, out="_split"), "flow")
    train = right_sized(tagged.where(F.col("_split") == "train").drop("_split"))
    test = tagged.where(F.col("_split") == "test").drop("_split")
    n_train = train.count()

    learners = {
        "Logistic Regression": models.logistic_notebook(n_train),
        "Random Forest": forest(),
        "Gradient Boosting": models.boosting(seed=seed).setMaxIter(boost_stages),
    }
    # preprocessing is fitted once for all three learners; each learner's fit
    # time includes it
    prep_model, prep_secs = models.fit_timed(
        features.preprocess_pipeline(categorical, numeric, mode="onehot"), train
    )
    train_v = prep_model.transform(train)
    preds = None
    for name, learner in learners.items():
        fitted, secs = models.fit_timed(learner, train_v)
        m = PipelineModel(stages=list(prep_model.stages) + [fitted])
        res.models[name], res.fit_seconds[name] = m, secs + prep_secs
        p = m.transform(test).select(F.lit(name).alias("model"), "label", "prediction")
        preds = p if preds is None else preds.unionByName(p)
    preds = written(preds, "predictions")
    res.report = evaluate.metrics_report(preds, fit_seconds=_timings(spark, res.fit_seconds))
    res.extras["classification_reports"] = evaluate.classification_report(preds, by=["model"])
    best_name = evaluate.select_best(res.report).first()["model"]
    res.extras["best_model"] = best_name
    res.extras["confusion_matrix"] = evaluate.confusion_matrix(
        preds.where(F.col("model") == best_name), "label", "prediction"
    )
    res.extras["importances"] = feature_importance(res.models["Random Forest"], train, categorical, numeric)

    rf_pipe = models.with_model(features.preprocess_pipeline(categorical, numeric, mode="onehot"), forest())
    if folds:
        # every fit and score reads the folds: dealt once
        all_folds = right_sized(split.stratified_folds(labelled, "label", key, folds, seed))
        res.extras["cross_validation"] = evaluate.cross_validate(all_folds, rf_pipe, "label", "fold", folds, parallelism)

    final = res.models["Random Forest"]
    if grid:
        if grid not in ("reference", "star"):
            raise ValueError("grid must be reference, star or None")
        rf = forest()
        combos = reference_grid(rf) if grid == "reference" else star_grid(rf)
        trees = rf.getParam("numTrees")
        combos = [c | {trees: max(1, c[trees] * forest_trees // models.N_TREES)} for c in combos]
        train_folds = right_sized(split.stratified_folds(train, "label", key, folds or 3, seed))
        t0 = time.perf_counter()
        final, res.extras["grid"] = evaluate.grid_search(
            train_folds, weighted_preprocessing(categorical, numeric), rf, combos, "label", "fold", folds or 3, "recall",
            parallelism, nested="numTrees",
        )
        res.extras["search_seconds"] = time.perf_counter() - t0
        t0 = time.perf_counter()
        tuned = written(final.transform(test).select("label", "prediction"), "tuned")
        res.extras["predict_seconds"] = time.perf_counter() - t0
        res.extras["tuned_report"] = evaluate.classification_report(tuned)

    # every customer is scored (the business case), and each row says
    # whether it was used for training, so the file is never mistaken for
    # held-out predictions
    scored = written(
        models.score(
            final, tagged.withColumnRenamed("_split", "split"), out="churn_proba", keep=df.columns + ["split"]
        ),
        "scored",
    )
    res.extras["scored"] = scored
    res.extras["high_risk"] = act.high_risk(scored, "churn_proba", threshold, top, key=[key])
    if profile_cols:
        res.extras["risk_profile"] = act.risk_profile(res.extras["high_risk"], profile_cols)
    res.extras["roi"] = act.retention_roi(act.at_risk(scored, "churn_proba", threshold))
    res.extras["split_frame"] = tagged
    return res


@dataclass
class RiskFlow:
    scored: DataFrame
    high_risk: DataFrame
    profile: DataFrame
    roi: DataFrame


def risk_flow(
    df: DataFrame,
    categorical: Sequence[str],
    numeric: Sequence[str],
    target: str,
    key: str,
    positive="Yes",
    threshold: float = act.THRESHOLD,
    top: int = act.TOP_K,
    profile_cols: Sequence[str] = (),
    seed: int = 42,
    test_size: float = 0.3,
) -> RiskFlow:
    """The business case with a trained model: split, fit the logistic preset
    on the training side, score every customer once (written), then the risk
    list, its profile and the return of a campaign."""
    labelled = project.binary_label(df, target, positive, "label")
    tagged = written(split.stratified_split(labelled, "label", key, test_size, seed, out="split"), "flow")
    train = right_sized(tagged.where(F.col("split") == "train"))
    model, _ = models.fit_logistic(train, categorical, numeric, "spark")
    scored = written(models.score(model, tagged, "churn_proba", keep=[*df.columns, "split"]), "scored")
    listed = written(act.high_risk(scored, "churn_proba", threshold, top, key=[key]), "risk-list")
    return RiskFlow(
        scored,
        listed.orderBy(F.desc("churn_proba"), key),
        act.risk_profile(listed, profile_cols),
        act.retention_roi(act.at_risk(scored, "churn_proba", threshold)),
    )


def reference_script(
    spark,
    csv_path: str,
    metrics_out: str,
    other_metrics: str | None = None,
    target: str = "Churn",
    key: str = "customerID",
    positive="Yes",
    categorical: Sequence[str] | None = None,
    numeric: Sequence[str] | None = None,
    seed: int = 42,
) -> dict:
    """The MLlib script end to end on a subscriber CSV: read with inferred
    schema, profile (shape, schema, preview, describe), label, preprocess,
    split, fit both learners, evaluate, write the metrics document and, if
    another engine's document is given, compare the two.

    Column roles default to the schema rule (text → categorical, numbers
    → numeric, key and target excluded). Returns the frames by name.
    """
    from riskframe.operators import profile
    from riskframe.sources import io

    raw = io.read_table(spark, csv_path, infer_schema=True)
    if categorical is None or numeric is None:
        cat, num = features.column_roles(raw, exclude=[key, target])
        categorical = cat if categorical is None else categorical
        numeric = num if numeric is None else numeric
    out = {
        "table": raw,
        "shape": profile.table_shape(raw),
        "schema": profile.schema_report(raw),
        "preview": profile.preview(raw, 5, order_by=[key]),
        "describe": profile.describe_text(raw),
    }
    flow = mllib_flow(raw, categorical, numeric, target, key, positive, seed)
    out["report"] = flow.report
    tidy = evaluate.tidy_metrics(flow.report)
    io.write_metrics(tidy, metrics_out)
    out["metrics"] = io.read_metrics(spark, metrics_out, engine="spark")
    if other_metrics is not None:
        other = io.read_metrics(spark, other_metrics, engine="other", f1_means="f1")
        out["comparison"] = evaluate.compare_runs(
            out["metrics"].drop("engine"), other.drop("engine")
        )
    out["flow"] = flow
    return out


def write_outputs(res: FlowResult, out_dir: str, key_cols: Sequence[str] | None = None) -> dict:
    """The notebook's result files, as CSV folders under ``out_dir``:
    every scored row, the risk list, the importances, plus the metrics
    document. Returns the paths."""
    from riskframe.sources import io

    base = out_dir.rstrip("/")
    paths = {
        "scored": f"{base}/predictions",
        "high_risk": f"{base}/top_risk",
        "importances": f"{base}/feature_importance",
        "metrics": f"{base}/metrics",
    }
    scored = res.extras["scored"]
    io.write_table(scored.select(*(key_cols or scored.columns)), paths["scored"])
    io.write_table(res.extras["high_risk"], paths["high_risk"])
    io.write_table(res.extras["importances"], paths["importances"])
    io.write_metrics(evaluate.tidy_metrics(res.report), paths["metrics"])
    return paths
