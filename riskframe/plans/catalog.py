"""One Spark query per operator of SURVEY §2, over the test tables.

Each entry takes ``(spark, data_dir)`` and returns a DataFrame over whole
tables (or frames Spark derives from them). Doubles are rounded to 6
places at the very end so results compare exactly with the SQL oracle
(sums in another order differ in the last bits).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.functions.columns import numeric_columns, round_doubles
from riskframe.functions.frames import right_sized, scratch_path, written
from riskframe.operators import act, evaluate, features, models, profile, project, search, split
from riskframe.operators.models import feature_importance
from riskframe.plans import workflow
from riskframe.sources import activity as act_src
from riskframe.sources import io
from riskframe.sources.tables import load_table

KEY = act_src.KEY
TARGET = act_src.TARGET
CATEGORICAL = list(act_src.CATEGORICAL)
NUMERIC = list(act_src.NUMERIC)

# Fixed values of the oracle-checkable scoring rule (hand-set coefficients:
# fewer past orders, a higher urgent share and a lower balance raise risk).
RISK_COEFFICIENTS = {
    "intercept": 2.5,
    "n_orders": -0.4,
    "urgent_share": 1.5,
    "c_acctbal": -0.00003,
}
HIST_EDGES = (-0.5, 0.5, 1.5)
PROFILE_COLS = ("c_mktsegment", "r_name", "tenure_days", "avg_spend")
LABEL_PAIR = ("quality", "toxic")


# --------------------------------------------------------------------------
# shared inputs
# --------------------------------------------------------------------------


def _t(spark, d, name) -> DataFrame:
    return load_table(spark, d, name)


def activity(spark, d) -> DataFrame:
    return act_src.load_activity(spark, d)


def labelled(spark, d) -> DataFrame:
    """Activity frame plus the MLlib label (``label`` = 1.0 for churned)."""
    return project.binary_label(activity(spark, d), TARGET, "Yes", "label")


def customer_with_gaps(spark, d) -> DataFrame:
    """Customer with missing cells by a value rule (negative balance → null,
    balance above 9500 → NaN, segment BUILDING → null)."""
    c = _t(spark, d, "customer")
    bal = (
        F.when(F.col("c_acctbal") < 0, F.lit(None).cast("double"))
        .when(F.col("c_acctbal") > 9500, F.lit(float("nan")))
        .otherwise(F.col("c_acctbal"))
    )
    seg = F.when(F.col("c_mktsegment") == "BUILDING", F.lit(None).cast("string")).otherwise(F.col("c_mktsegment"))
    return c.withColumn("c_acctbal", bal).withColumn("c_mktsegment", seg)


def scored(spark, d) -> DataFrame:
    return models.score(RISK_COEFFICIENTS, activity(spark, d), out="churn_proba")


def label_pairs(spark, d) -> DataFrame:
    lab, pred = LABEL_PAIR
    return _t(spark, d, "labels").select(F.col(lab).alias("label"), F.col(pred).alias("prediction"))


def model_runs(spark, d) -> DataFrame:
    """Long (model, label, prediction) frame: the toxic flag as a predictor
    of quality, and the two constant predictors."""
    lab, pred = LABEL_PAIR
    t = _t(spark, d, "labels")
    return (
        t.select(F.lit("toxic_flag").alias("model"), F.col(lab).alias("label"), F.col(pred).alias("prediction"))
        .unionByName(t.select(F.lit("all_negative").alias("model"), F.col(lab).alias("label"), F.lit(0).alias("prediction")))
        .unionByName(t.select(F.lit("all_positive").alias("model"), F.col(lab).alias("label"), F.lit(1).alias("prediction")))
    )


def split_frames(spark, d):
    """Stratified 70/30 train/test of the labelled activity frame, written
    once; train is right-sized for the learners."""
    tagged = written(split.stratified_split(labelled(spark, d), "label", KEY, 0.3, seed=42, out="_split"), "entry")
    train = right_sized(tagged.where(F.col("_split") == "train").drop("_split"))
    test = tagged.where(F.col("_split") == "test").drop("_split")
    return train, test


# --------------------------------------------------------------------------
# 2.1 sources and sinks
# --------------------------------------------------------------------------


def q_read_table(spark, d):
    """``documents`` through CSV and back: texts with newlines, quotes and
    padding come back as they were; empty ones and nulls stay apart."""
    docs = _t(spark, d, "documents")
    path = scratch_path(spark, "read_table")
    io.write_table(docs, path)
    return io.read_table(spark, path, schema=docs.schema, null_value=[io.NULL_TOKEN, "NA"])


def q_write_table(spark, d):
    path = scratch_path(spark, "write_table")
    io.write_table(scored(spark, d), path)
    return io.read_table(spark, path, infer_schema=True)


def _metric_doc(spark, d) -> DataFrame:
    return evaluate.tidy_metrics(evaluate.metrics_report(model_runs(spark, d)))


def q_write_metrics(spark, d):
    path = scratch_path(spark, "write_metrics")
    io.write_metrics(_metric_doc(spark, d), path)
    text = spark.read.text(path, wholetext=True)
    return text.select(F.regexp_replace("value", r"\s+$", "").alias("value"))  # without the final newline


def q_read_metrics(spark, d):
    path = scratch_path(spark, "read_metrics")
    io.write_metrics(_metric_doc(spark, d), path)
    return io.read_metrics(spark, path, engine="labels")


# --------------------------------------------------------------------------
# 2.2 profiling
# --------------------------------------------------------------------------


def q_schema_report(spark, d):
    return profile.schema_report(_t(spark, d, "customer"))


def q_table_shape(spark, d):
    return profile.table_shape(_t(spark, d, "orders"))


def q_preview(spark, d):
    return profile.preview(_t(spark, d, "customer"), 5, order_by=["c_custkey"])


def q_describe_numeric(spark, d):
    return profile.describe_numeric(customer_with_gaps(spark, d))


def q_describe_lineitem(spark, d):
    return profile.describe_numeric(_t(spark, d, "lineitem"))


def q_describe_text(spark, d):
    c = _t(spark, d, "customer")
    desc = profile.describe_text(c)
    num = set(numeric_columns(c))
    cols = [x for x in desc.columns if x != "summary"]
    long = desc.select(
        "summary",
        F.inline(F.array(*[F.struct(F.lit(x).alias("column_name"), F.col(x).alias("value")) for x in cols])),
    )
    is_num = F.col("column_name").isin(*sorted(num)) if num else F.lit(False)
    return long.select(
        "summary",
        "column_name",
        F.when(~is_num & F.col("summary").isin("min", "max"), F.col("value")).alias("text_value"),
        F.when(is_num | (F.col("summary") == "count"), F.col("value").try_cast("double")).alias("num_value"),
    )


def q_describe_mixed(spark, d):
    return profile.describe_mixed(_t(spark, d, "orders"))


def q_value_counts(spark, d):
    return profile.value_counts(customer_with_gaps(spark, d), "c_acctbal")


def q_value_shares(spark, d):
    return profile.value_shares(customer_with_gaps(spark, d), "c_mktsegment")


def q_histogram(spark, d):
    return profile.histogram(labelled(spark, d), "label", HIST_EDGES)


def q_duplicate_count(spark, d):
    return profile.duplicate_count(_t(spark, d, "orders"), ["o_custkey"])


def q_null_counts(spark, d):
    return profile.null_counts(customer_with_gaps(spark, d))


def q_null_total(spark, d):
    return profile.null_total(customer_with_gaps(spark, d))


# --------------------------------------------------------------------------
# 2.3 projection, predicates, top-k
# --------------------------------------------------------------------------


def q_map_label(spark, d):
    out = project.map_label(activity(spark, d), TARGET, {"Yes": 1, "No": 0}, out="churn_flag")
    return out.select(KEY, TARGET, "churn_flag")


def q_binary_label(spark, d):
    return labelled(spark, d).select(KEY, TARGET, "label")


def q_features_and_target(spark, d):
    return project.features_and_target(activity(spark, d), TARGET, drop=[KEY])


def q_select_existing(spark, d):
    return project.select_existing(_t(spark, d, "customer"), ["c_custkey", "c_mktsegment", "c_phone", "c_acctbal"])


def q_filter_at_least(spark, d):
    return project.filter_at_least(_t(spark, d, "customer"), "c_acctbal", 8000.0)


def q_top_k(spark, d):
    o = _t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return project.top_k(o, "o_totalprice", 10, tie_break=["o_orderkey"])


# --------------------------------------------------------------------------
# 2.4 features
# --------------------------------------------------------------------------


def q_index_categories(spark, d):
    out = features.index_categories(activity(spark, d), CATEGORICAL)
    return out.select(KEY, *[c + features.IDX for c in CATEGORICAL])


def q_one_hot(spark, d):
    return features.one_hot_columns(activity(spark, d), ["c_mktsegment", "r_name"], keep=[KEY])


def q_standardize(spark, d):
    out = features.standardize(activity(spark, d), NUMERIC, ddof=0)
    return out.select(KEY, *[c + features.STD for c in NUMERIC])


def q_scale_vector(spark, d):
    a = features.assemble(activity(spark, d), NUMERIC, "features_raw")
    out = features.scale_vector(a, "features_raw", "features")
    arr = vector_to_array(F.col("features"))
    return out.select(KEY, *[arr[i].alias(c + "_scaled") for i, c in enumerate(NUMERIC)])


def q_assemble(spark, d):
    """The assembled vector, one column per slot (``<input>_slot``)."""
    out = features.assemble(activity(spark, d), NUMERIC, "features")
    arr = vector_to_array(F.col("features"))
    return out.select(KEY, *[arr[i].alias(c + "_slot") for i, c in enumerate(NUMERIC)])


def q_preprocess_pipeline(spark, d):
    """The MLlib-path pipeline (index, assemble, scale) fitted on the
    activity table; the scaled vector one column per slot."""
    a = activity(spark, d)
    pipe = features.preprocess_pipeline(CATEGORICAL, NUMERIC, mode="ordinal")
    out = pipe.fit(a).transform(a)
    slots = [c + features.IDX for c in CATEGORICAL] + NUMERIC
    arr = vector_to_array(F.col("features"))
    return out.select(KEY, *[arr[i].alias(c + "_scaled") for i, c in enumerate(slots)])


# --------------------------------------------------------------------------
# 2.5 splits
# --------------------------------------------------------------------------


def q_random_split(spark, d):
    parts = split.random_split(activity(spark, d), (0.7, 0.3), seed=42, by=KEY)
    train, test = (p.select(KEY, F.lit(n).alias("split")) for p, n in zip(parts, ("train", "test")))
    return train.unionByName(test)


def q_stratified_split(spark, d):
    return split.stratified_split(activity(spark, d), TARGET, KEY, 0.3, seed=42).select(KEY, TARGET, "split")


def q_stratified_folds(spark, d):
    return split.stratified_folds(activity(spark, d), TARGET, KEY, k=5, seed=42).select(KEY, TARGET, "fold")


# --------------------------------------------------------------------------
# 2.6 models
# --------------------------------------------------------------------------


def _fit_checks(spark, d, fit, calibrated: bool = False, shown: bool = False) -> DataFrame:
    """A real fit, scored on every test row. What SQL can know of it is
    checked, not the scores: the rows and labels, that probabilities are in
    [0, 1] and that the prediction is ``probability > 0.5``. A logistic
    regression's intercept is not penalised, so at the optimum its mean
    probability on the training rows is their positive share. ``shown`` adds
    the scores themselves, to 4 places."""
    train, test = split_frames(spark, d)
    model, _ = fit(train)
    p = F.col("churn_proba")
    out = models.score(model, test, keep=[KEY, "label"], with_prediction=True).select(
        KEY,
        "label",
        p.between(0.0, 1.0).alias("probability_valid"),
        ((p > 0.5) == (F.col("prediction") == 1.0)).alias("prediction_follows"),
        *([F.round(p, 4).alias("churn_proba")] if shown else []),
    )
    if calibrated:
        mean, share = models.score(model, train, keep=["label"]).agg(F.avg("churn_proba"), F.avg("label")).first()
        out = out.withColumns({"train_share": F.lit(share), "mean_is_share": F.lit(abs(mean - share) < 1e-3)})
    return out


def q_fit_logistic(spark, d):
    return _fit_checks(spark, d, lambda t: models.fit_logistic(t, CATEGORICAL, NUMERIC, "spark"), True)


def q_fit_logistic_notebook(spark, d):
    """Its optimum is unique: SQL fits the same objective by other means and
    compares the scores."""
    return _fit_checks(spark, d, lambda t: models.fit_logistic(t, CATEGORICAL, NUMERIC, "notebook"), True, True)


def q_fit_forest(spark, d):
    return _fit_checks(spark, d, lambda t: models.fit_forest(t, CATEGORICAL, NUMERIC, "spark"))


def q_fit_forest_notebook(spark, d):
    return _fit_checks(spark, d, lambda t: models.fit_forest(t, CATEGORICAL, NUMERIC, "notebook"))


def q_fit_boosting(spark, d):
    return _fit_checks(spark, d, lambda t: models.fit_boosting(t, CATEGORICAL, NUMERIC))


def q_predict(spark, d):
    """A real fit; checked is that every test row gets class 0 or 1."""
    train, test = split_frames(spark, d)
    pipe = models.with_model(features.preprocess_pipeline(CATEGORICAL, NUMERIC), models.logistic_spark())
    model = pipe.fit(train)
    return models.predict(model, test, keep=[KEY]).select(KEY, F.col("prediction").isin(0.0, 1.0).alias("is_class"))


def q_score(spark, d):
    return scored(spark, d).select(KEY, "churn_proba")


def q_class_weights(spark, d):
    return models.class_weights(activity(spark, d), TARGET).select(KEY, TARGET, "weight")


def q_feature_importance(spark, d):
    """A real fit of the notebook's forest; checked are the names of all
    slots, that no importance is negative and that they sum to one."""
    train, _ = split_frames(spark, d)
    pipe = models.with_model(features.preprocess_pipeline(CATEGORICAL, NUMERIC, mode="onehot"), models.forest_unlimited())
    found = feature_importance(pipe.fit(train), train, CATEGORICAL, NUMERIC, k=1_000_000)
    total = found.agg(F.sum("importance")).first()[0]
    return found.select("feature", (F.col("importance") >= 0).alias("is_share"), F.lit(total).alias("total"))


# --------------------------------------------------------------------------
# 2.7 evaluation
# --------------------------------------------------------------------------


def q_confusion_matrix(spark, d):
    return evaluate.confusion_matrix(label_pairs(spark, d), labels=(0, 1))


def q_accuracy(spark, d):
    return evaluate.accuracy(label_pairs(spark, d))


def q_precision_binary(spark, d):
    return evaluate.precision_binary(label_pairs(spark, d))


def q_recall_binary(spark, d):
    return evaluate.recall_binary(label_pairs(spark, d))


def q_f1_binary(spark, d):
    return evaluate.f1_binary(label_pairs(spark, d))


def q_f1_weighted(spark, d):
    return evaluate.f1_weighted(label_pairs(spark, d))


def q_macro_scores(spark, d):
    return evaluate.macro_scores(label_pairs(spark, d))


def q_classification_report(spark, d):
    return evaluate.classification_report(label_pairs(spark, d))


def q_metrics_report(spark, d):
    return evaluate.metrics_report(model_runs(spark, d))


def q_select_best(spark, d):
    return evaluate.select_best(evaluate.metrics_report(model_runs(spark, d)))


def q_compare_runs(spark, d):
    runs = model_runs(spark, d)
    a = runs.where(F.col("model") == "toxic_flag").withColumn("model", F.lit("quality"))
    b = runs.where(F.col("model") == "all_negative").withColumn("model", F.lit("quality"))
    return evaluate.compare_runs(
        evaluate.tidy_metrics(evaluate.metrics_report(a)), evaluate.tidy_metrics(evaluate.metrics_report(b))
    )


def _label_folds(spark, d) -> DataFrame:
    """``labels`` in five folds, each row once per fold as test or train."""
    lab, pred = LABEL_PAIR
    folded = split.stratified_folds(_t(spark, d, "labels"), lab, "doc_id", k=5, seed=42)
    return folded.withColumn("fold_id", F.explode(F.sequence(F.lit(0), F.lit(4)))).select(
        "fold_id",
        F.when(F.col("fold") == F.col("fold_id"), "test").otherwise("train").alias("side"),
        F.col(lab).alias("label"),
        F.col(pred).alias("prediction"),
    )


def _checked(score: Column) -> Column:
    return F.when(score.between(0.0, 1.0), 1.0).otherwise(0.0)


def q_cross_validate(spark, d):
    """Source ``fitted``: the notebook's forest (one-hot, unlimited depth)
    fitted and scored on five folds; SQL knows only that the means are shares
    (1.0 if so). Source ``labels``: the same aggregation over the folds of
    ``labels``, whose values SQL computes."""
    folded = right_sized(split.stratified_folds(labelled(spark, d), "label", KEY, k=5, seed=42))
    prep = features.preprocess_pipeline(CATEGORICAL, NUMERIC, mode="onehot")
    # small training frames use few partitions: run fits side by side
    fitted = evaluate.cross_validate(
        folded, models.with_model(prep, models.forest_unlimited()), "label", "fold", k=5, parallelism=4
    )
    known = evaluate.fold_scores(_label_folds(spark, d))
    none = F.lit(None).cast("double")
    return fitted.select(
        F.lit("fitted").alias("source"), "side", "metric", _checked(F.col("mean")).alias("mean"), none.alias("std")
    ).unionByName(known.select(F.lit("labels").alias("source"), "side", "metric", "mean", "std"))


def q_grid_search(spark, d):
    """Source ``fitted``: the reference's whole grid, 216 combinations, over
    the training rows in five folds. SQL knows the combinations, that both
    scores are shares (1.0 if so) and that one is best. Source ``tuned``: the
    best combination fitted on all training rows and scored on the test rows,
    whose support SQL knows. Source ``labels``: the mean test recall over the
    folds of ``labels``."""
    train, test = split_frames(spark, d)
    folded = right_sized(split.stratified_folds(train, "label", KEY, k=5, seed=42))
    best_model, results = search.search_forests(
        folded,
        features.preprocess_pipeline(CATEGORICAL, NUMERIC, mode="onehot"),
        search.combinations(search.FOREST_GRID),
        "label",
        "fold",
        k=5,
        metric="recall",
    )
    tuned = evaluate.classification_report(models.predict(best_model, test, keep=["label"])).select(
        F.lit("tuned").alias("source"),
        F.concat(F.lit("support "), F.col("class")).alias("params"),
        F.when(F.col("f1").between(0.0, 1.0), F.col("support").cast("double")).alias("value"),
    )
    fitted = results.select(
        F.lit("fitted").alias("source"),
        "params",
        (_checked(F.col("cv_score")) * _checked(F.col("train_score"))).alias("value"),
    )
    best = results.agg(F.count_if("is_best").cast("double").alias("value")).select(
        F.lit("fitted").alias("source"), F.lit("is_best").alias("params"), "value"
    )
    folds = evaluate.summary(_label_folds(spark, d).where("side = 'test'"), by=["fold_id"])
    known = folds.agg(F.avg("recall").alias("value")).select(
        F.lit("labels").alias("source"), F.lit("recall").alias("params"), "value"
    )
    return fitted.unionByName(best).unionByName(tuned).unionByName(known)


# --------------------------------------------------------------------------
# 2.8 acting on scores
# --------------------------------------------------------------------------


def q_high_risk(spark, d):
    return act.high_risk(scored(spark, d), "churn_proba", act.THRESHOLD, act.TOP_K, key=[KEY])


def q_risk_profile(spark, d):
    top = act.high_risk(scored(spark, d), "churn_proba", act.THRESHOLD, act.TOP_K, key=[KEY])
    return act.risk_profile(top, PROFILE_COLS)


# Fixed value: the activity table has a base rate of 21 % and little signal.
FLOW_THRESHOLD = 0.2


def risk_flow(spark, d) -> workflow.RiskFlow:
    """The trained path over the activity table."""
    return workflow.risk_flow(
        activity(spark, d), CATEGORICAL, NUMERIC, TARGET, KEY, threshold=FLOW_THRESHOLD, profile_cols=PROFILE_COLS
    )


def q_risk_flow(spark, d):
    """Trained model to campaign; checked are the counts and the rules
    between the results, not the scores."""
    flow = risk_flow(spark, d)
    listed = flow.high_risk.select("churn_proba").collect()  # at most TOP_K
    p = [r[0] for r in listed]
    roi = flow.roi.first()
    at_risk = flow.scored.where(F.col("churn_proba") >= FLOW_THRESHOLD).count()
    good = (
        len(p) == min(act.TOP_K, at_risk)
        and p == sorted(p, reverse=True)
        and all(x >= FLOW_THRESHOLD for x in p)
        and roi["n_targeted"] == at_risk
    )
    rows = flow.scored.groupBy("split").agg(F.count(F.lit(1)).alias("n_scored"))
    return rows.select(
        "split", "n_scored", F.lit(good).alias("list_follows"), F.lit(flow.profile.count()).cast("long").alias("n_profiled")
    )


def q_retention_roi(spark, d):
    return act.retention_roi(act.at_risk(scored(spark, d), "churn_proba", act.THRESHOLD))


# --------------------------------------------------------------------------

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    # 2.1
    "read_table": q_read_table,
    "read_metrics": q_read_metrics,
    "write_table": q_write_table,
    "write_metrics": q_write_metrics,
    # 2.2
    "schema_report": q_schema_report,
    "table_shape": q_table_shape,
    "preview": q_preview,
    "describe_numeric": q_describe_numeric,
    "describe_lineitem": q_describe_lineitem,
    "describe_text": q_describe_text,
    "describe_mixed": q_describe_mixed,
    "value_counts": q_value_counts,
    "value_shares": q_value_shares,
    "histogram": q_histogram,
    "duplicate_count": q_duplicate_count,
    "null_counts": q_null_counts,
    "null_total": q_null_total,
    # 2.3
    "map_label": q_map_label,
    "binary_label": q_binary_label,
    "features_and_target": q_features_and_target,
    "select_existing": q_select_existing,
    "filter_at_least": q_filter_at_least,
    "top_k": q_top_k,
    # 2.4
    "index_categories": q_index_categories,
    "one_hot": q_one_hot,
    "standardize": q_standardize,
    "scale_vector": q_scale_vector,
    "assemble": q_assemble,
    "preprocess_pipeline": q_preprocess_pipeline,
    # 2.5
    "random_split": q_random_split,
    "stratified_split": q_stratified_split,
    "stratified_folds": q_stratified_folds,
    # 2.6
    "fit_logistic": q_fit_logistic,
    "fit_logistic_notebook": q_fit_logistic_notebook,
    "fit_forest": q_fit_forest,
    "fit_forest_notebook": q_fit_forest_notebook,
    "fit_boosting": q_fit_boosting,
    "predict": q_predict,
    "score": q_score,
    "class_weights": q_class_weights,
    # 2.7
    "confusion_matrix": q_confusion_matrix,
    "accuracy": q_accuracy,
    "precision_binary": q_precision_binary,
    "recall_binary": q_recall_binary,
    "f1_binary": q_f1_binary,
    "f1_weighted": q_f1_weighted,
    "macro_scores": q_macro_scores,
    "classification_report": q_classification_report,
    "metrics_report": q_metrics_report,
    "select_best": q_select_best,
    "cross_validate": q_cross_validate,
    "grid_search": q_grid_search,
    "feature_importance": q_feature_importance,
    "compare_runs": q_compare_runs,
    # 2.8
    "high_risk": q_high_risk,
    "risk_profile": q_risk_profile,
    "retention_roi": q_retention_roi,
    "risk_flow": q_risk_flow,
}


def _rounded(fn):
    def run(spark: SparkSession, data_dir: str) -> DataFrame:
        return round_doubles(fn(spark, data_dir), 6)

    run.__name__ = fn.__name__
    run.__doc__ = fn.__doc__
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _rounded(fn) for name, fn in _QUERIES.items()}
