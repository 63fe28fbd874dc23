"""Evaluation and model selection.

Every metric is derived from one distributed aggregate,
``groupBy(by..., label, prediction).count()``: a scan with map-side partial
aggregation whose result has at most ``groups × classes²`` rows. The
per-class and summary arithmetic then runs on that tiny frame, still as
DataFrame expressions (nothing is collected unless a caller asks for a
number).

Names are explicit: ``precision``/``recall``/``f1`` are for the positive
class, ``macro_*`` unweighted class means, ``weighted_*`` support-weighted
means (what MLlib calls "f1"). Every 0/0 is 0.0 — a class that never occurs
or is never predicted does not raise, and an empty input gives 0.0. Rows whose
label or prediction is missing (null or NaN) are left out of every metric.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Model, PipelineModel
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasLabelCol, HasOutputCol, HasPredictionCol
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.functions.columns import f_score, safe_ratio
from riskframe.functions.frames import written
from riskframe.operators.ensembles import nested_predictions

POSITIVE = 1.0

# Metric vocabulary (fixed). "f1" alone always means the positive class.
METRICS = (
    "accuracy",
    "precision",
    "recall",
    "f1",
    "macro_precision",
    "macro_recall",
    "macro_f1",
    "weighted_precision",
    "weighted_recall",
    "weighted_f1",
)
LOWER_IS_BETTER = ("fit_seconds", "time")


def confusion_counts(
    df: DataFrame,
    label: str = "label",
    prediction: str = "prediction",
    weight: str | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """``(by..., label, prediction, n)`` with label/prediction as double and
    ``n`` the (weighted) row count as double, without rows where either is
    missing."""
    there = [F.col(c).isNotNull() & ~F.isnan(c) for c in ("label", "prediction")]
    n = F.sum(F.col(weight).cast("double")) if weight else F.count(F.lit(1)).cast("double")
    return (
        df.select(
            *by,
            F.col(label).cast("double").alias("label"),
            F.col(prediction).cast("double").alias("prediction"),
            *([F.col(weight)] if weight else []),
        )
        .where(there[0] & there[1])
        .groupBy(*by, "label", "prediction")
        .agg(n.alias("n"))
    )


def per_class(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per class (the union of true and predicted labels): support, tp,
    predicted, precision, recall, f1."""
    zero = F.lit(0.0)
    contrib = counts.select(
        *by,
        F.explode(
            F.array(
                F.struct(
                    F.col("label").alias("cls"),
                    F.col("n").alias("support"),
                    F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(zero).alias("tp"),
                    zero.alias("predicted"),
                ),
                F.struct(
                    F.col("prediction").alias("cls"),
                    zero.alias("support"),
                    zero.alias("tp"),
                    F.col("n").alias("predicted"),
                ),
            )
        ).alias("c"),
    ).select(*by, "c.*")
    per = contrib.groupBy(*by, "cls").agg(
        F.sum("support").alias("support"),
        F.sum("tp").alias("tp"),
        F.sum("predicted").alias("predicted"),
    )
    p = safe_ratio("tp", "predicted")
    r = safe_ratio("tp", "support")
    return per.withColumn("precision", p).withColumn("recall", r).withColumn(
        "f1", f_score(F.col("precision"), F.col("recall"))
    )


def summary(
    df: DataFrame,
    label: str = "label",
    prediction: str = "prediction",
    positive: float = POSITIVE,
    weight: str | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """All metrics of ``METRICS`` plus ``n``, one row per group."""
    per = per_class(confusion_counts(df, label, prediction, weight, by), by)
    is_pos = F.col("cls") == F.lit(float(positive))

    def pos(c: str):
        return F.coalesce(F.max(F.when(is_pos, F.col(c))), F.lit(0.0))

    def weighted(c: str):
        return safe_ratio(F.sum(F.col(c) * F.col("support")), F.sum("support"))

    agg = per.groupBy(*by).agg(
        F.coalesce(F.sum("support"), F.lit(0.0)).alias("n"),
        safe_ratio(F.sum("tp"), F.sum("support")).alias("accuracy"),
        pos("precision").alias("precision"),
        pos("recall").alias("recall"),
        pos("f1").alias("f1"),
        F.coalesce(F.avg("precision"), F.lit(0.0)).alias("macro_precision"),
        F.coalesce(F.avg("recall"), F.lit(0.0)).alias("macro_recall"),
        F.coalesce(F.avg("f1"), F.lit(0.0)).alias("macro_f1"),
        weighted("precision").alias("weighted_precision"),
        weighted("recall").alias("weighted_recall"),
        weighted("f1").alias("weighted_f1"),
    )
    return agg


def confusion_matrix(
    df: DataFrame,
    label: str = "label",
    prediction: str = "prediction",
    labels: Sequence[float] = (0.0, 1.0),
) -> DataFrame:
    """Full ``len(labels)²`` grid in the given label order; empty cells are
    0; values outside ``labels`` are ignored (sklearn ``labels=``)."""
    k = len(labels)
    values = F.array(*[F.lit(float(v)) for v in labels])
    grid = df.sparkSession.range(k * k).select(
        values[(F.col("id") / k).cast("int")].alias("label"),
        values[(F.col("id") % k).cast("int")].alias("prediction"),
    )
    counts = confusion_counts(df, label, prediction)
    return (
        F.broadcast(grid)
        .join(counts, ["label", "prediction"], "left")
        .select("label", "prediction", F.coalesce(F.col("n"), F.lit(0.0)).cast("long").alias("count"))
    )


def accuracy(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return summary(df, label, prediction).select("accuracy")


def precision_binary(df: DataFrame, label="label", prediction="prediction", positive=POSITIVE) -> DataFrame:
    return summary(df, label, prediction, positive).select("precision")


def recall_binary(df: DataFrame, label="label", prediction="prediction", positive=POSITIVE) -> DataFrame:
    return summary(df, label, prediction, positive).select("recall")


def f1_binary(df: DataFrame, label="label", prediction="prediction", positive=POSITIVE) -> DataFrame:
    return summary(df, label, prediction, positive).select("f1")


def f1_weighted(df: DataFrame, label="label", prediction="prediction") -> DataFrame:
    """Support-weighted F1 — MLlib's ``metricName="f1"``."""
    return summary(df, label, prediction).select("weighted_f1")


def macro_scores(df: DataFrame, label="label", prediction="prediction") -> DataFrame:
    return summary(df, label, prediction).select("macro_precision", "macro_recall", "macro_f1")


def _class_name(c):
    return F.when(c == F.floor(c), c.cast("long").cast("string")).otherwise(c.cast("string"))


def classification_report(
    df: DataFrame, label="label", prediction="prediction", by: Sequence[str] = ()
) -> DataFrame:
    """sklearn's report as rows, for each group of ``by``: one per class,
    then ``accuracy`` (value in ``f1``, precision/recall null), ``macro avg``
    and ``weighted avg``."""
    per = per_class(confusion_counts(df, label, prediction, by=by), by)
    classes = per.select(
        *by,
        _class_name(F.col("cls")).alias("class"),
        "precision",
        "recall",
        "f1",
        F.col("support").cast("long").alias("support"),
    )
    null = F.lit(None).cast("double")

    def line(name: str, *values) -> Column:
        cols = [v.alias(c) for v, c in zip(values, ("precision", "recall", "f1"))]
        return F.struct(F.lit(name).alias("class"), *cols, F.col("n").cast("long").alias("support"))

    means = [
        line(f"{kind} avg", *[F.col(f"{kind}_{m}") for m in ("precision", "recall", "f1")])
        for kind in ("macro", "weighted")
    ]
    s = summary(df, label, prediction, by=by)
    rows = s.select(*by, F.inline(F.array(line("accuracy", null, null, F.col("accuracy")), *means)))
    return classes.unionByName(rows)


def metrics_report(
    df: DataFrame,
    model: str = "model",
    label: str = "label",
    prediction: str = "prediction",
    positive: float = POSITIVE,
    fit_seconds: DataFrame | None = None,
) -> DataFrame:
    """One row per model from a long (model, label, prediction) frame:
    accuracy, positive-class precision/recall/f1 and weighted f1, all from
    a single aggregate. ``fit_seconds`` (model, fit_seconds) is joined when
    given (wall times are measured on the driver, so they are not data)."""
    s = summary(df, label, prediction, positive, by=[model]).select(
        F.col(model).alias("model"), "accuracy", "precision", "recall", "f1", "weighted_f1"
    )
    if fit_seconds is not None:
        s = s.join(F.broadcast(fit_seconds), "model", "left")
    return s


def select_best(report: DataFrame, order: Sequence[str] = ("recall", "f1")) -> DataFrame:
    """Best model: highest recall, then F1, then model name (deterministic)."""
    return report.orderBy(*[F.desc(c) for c in order], F.asc("model")).limit(1)


def tidy_metrics(report: DataFrame, engine: str | None = None) -> DataFrame:
    """Wide report -> (engine, model, metric, value) rows."""
    values = [c for c in report.columns if c != "model"]
    long = report.select(
        "model",
        F.inline(
            F.array(
                *[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in values]
            )
        ),
    )
    if engine is not None:
        long = long.select(F.lit(engine).alias("engine"), "model", "metric", "value")
    return long


def compare_runs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Side-by-side (model, metric, value_a, value_b, better) of two tidy
    metric frames. ``better`` is 'a', 'b' or 'tie' (lower wins for times),
    and null when only one side has the metric or the metric is not a
    defined name (an unqualified "f1-score" from two engines may be two
    different quantities and is never ranked)."""
    known = list(METRICS) + list(LOWER_IS_BETTER)
    va, vb = F.col("value_a"), F.col("value_b")
    lower = F.col("metric").isin(*LOWER_IS_BETTER)
    better = (
        F.when(~F.col("metric").isin(*known) | va.isNull() | vb.isNull(), F.lit(None).cast("string"))
        .when(va == vb, F.lit("tie"))
        .when((va > vb) != lower, F.lit("a"))
        .otherwise(F.lit("b"))
    )
    ja = a.select("model", "metric", F.col("value").alias("value_a"))
    jb = b.select("model", "metric", F.col("value").alias("value_b"))
    return ja.join(jb, ["model", "metric"], "full").select("model", "metric", "value_a", "value_b", better.alias("better"))


# --------------------------------------------------------------------------
# Evaluator for model search, and cross-validation
# --------------------------------------------------------------------------


class ClassMetricEvaluator(Evaluator, HasLabelCol, HasPredictionCol):
    """MLlib ``Evaluator`` over the same aggregate, for ``CrossValidator``:
    any name of ``METRICS`` (default positive-class recall, the notebook's
    ``scoring="recall"``). A fold without positives scores 0.0 instead of
    raising as MLlib's by-label metrics do."""

    metricName = Param(Params._dummy(), "metricName", "metric", typeConverter=TypeConverters.toString)
    positive = Param(Params._dummy(), "positive", "positive label", typeConverter=TypeConverters.toFloat)

    def __init__(self, metricName="recall", labelCol="label", predictionCol="prediction", positive=POSITIVE):
        super().__init__()
        if metricName not in METRICS:
            raise ValueError(f"unknown metric {metricName!r}; use one of {METRICS}")
        self._set(metricName=metricName, labelCol=labelCol, predictionCol=predictionCol, positive=positive)

    def _evaluate(self, dataset: DataFrame) -> float:
        name = self.getOrDefault(self.metricName)
        row = summary(
            dataset, self.getLabelCol(), self.getPredictionCol(), self.getOrDefault(self.positive)
        ).select(name).first()
        return float(row[0]) if row and row[0] is not None else 0.0

    def isLargerBetter(self) -> bool:
        return True


FOLD_METRICS = ("accuracy", "macro_precision", "macro_recall", "macro_f1")


def fold_scores(
    predictions: DataFrame, label: str = "label", prediction: str = "prediction", positive: float = POSITIVE
) -> DataFrame:
    """``(side, metric, mean, std)`` over folds, with the population std,
    from rows ``(fold_id, side, label, prediction)`` in one aggregate."""
    per_fold = summary(predictions, label, prediction, positive, by=["fold_id", "side"])
    long = per_fold.select(
        "side",
        F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in FOLD_METRICS])),
    )
    return long.groupBy("side", "metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def _side_by_side(spark, work, items, parallelism: int) -> list:
    """``work`` over ``items`` in driver threads that inherit the caller's job
    group and scheduler pool."""
    if parallelism <= 1:
        return [work(x) for x in items]
    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        return list(pool.map(inheritable_thread_target(spark)(work), items))


def cross_validate(
    df: DataFrame,
    estimator,
    label: str = "label",
    fold_col: str = "fold",
    k: int = 5,
    parallelism: int = 1,
    positive: float = POSITIVE,
) -> DataFrame:
    """k-fold evaluation over a frame that already has ``fold_col`` (see
    ``split.stratified_folds``; pass a written or right-sized frame, it is
    read by every fit): fits one model per fold, scores the held-out fold
    **and** the training side, and returns ``fold_scores``. With
    ``parallelism=1`` a ``fit_seconds`` row is added; fits that run side by
    side have no time of their own."""

    def one(i: int):
        train = df.where(F.col(fold_col) != i)
        t0 = time.perf_counter()
        model = estimator.fit(train)
        secs = time.perf_counter() - t0
        # both sides in one pass: a forest is read once
        side = F.when(F.col(fold_col) == i, "test").otherwise("train").alias("side")
        scored = model.transform(df.where(F.col(fold_col).isNotNull()))
        scored = scored.select(F.lit(i).alias("fold_id"), side, F.col(label), "prediction")
        return secs, scored

    spark = df.sparkSession
    results = _side_by_side(spark, one, range(k), parallelism)
    frames = [f for _, f in results]
    union = frames[0]
    for f in frames[1:]:
        union = union.unionByName(f)
    stats = fold_scores(union, label, "prediction", positive)
    if parallelism > 1:
        return stats
    secs = [s for s, _ in results]
    mean_t = sum(secs) / len(secs)
    std_t = (sum((s - mean_t) ** 2 for s in secs) / len(secs)) ** 0.5
    timing = spark.range(1).select(
        F.lit("fit").alias("side"), F.lit("fit_seconds").alias("metric"),
        F.lit(mean_t).alias("mean"), F.lit(std_t).alias("std"),
    )
    return stats.unionByName(timing)


def _param_value(v):
    return v if isinstance(v, (int, float, str, bool)) or v is None else str(v)


def param_text(params: dict) -> str:
    """``name=value;...`` in the order of the names."""
    return ";".join(f"{p.name}={_param_value(v)}" for p, v in sorted(params.items(), key=lambda kv: kv[0].name))


def _nested_groups(param_grid: list, nested: str | None) -> list[list[int]]:
    """Places of the combinations that share a fit: those that differ in the
    parameter ``nested`` alone."""
    if nested is None:
        return [[i] for i in range(len(param_grid))]
    groups: dict[str, list[int]] = {}
    for i, params in enumerate(param_grid):
        rest = {p: v for p, v in params.items() if p.name != nested}
        groups.setdefault(param_text(rest), []).append(i)
    return list(groups.values())


def grid_search(
    df: DataFrame,
    preprocess,
    learner,
    param_grid: list,
    label: str = "label",
    fold_col: str = "fold",
    k: int = 5,
    metric: str = "recall",
    parallelism: int = 1,
    nested: str | None = None,
):
    """Exhaustive search over precomputed folds; returns ``(best_model,
    results)``.

    ``preprocess`` is fitted once per fold, on that fold's training side
    alone, and its vectors are written once; every combination fits
    ``learner`` on them and is scored on both sides. ``results`` has one row
    per combination: ``combo, params, cv_score, cv_std, train_score,
    train_std`` (mean and population std of ``metric`` over the folds),
    ``fit_seconds, score_seconds`` (means over the folds; null if fits run
    side by side) and ``is_best`` (highest ``cv_score``, the first of equals).
    The best combination is fitted again on all rows, as a pipeline model.

    ``nested="numTrees"`` (forests only) fits the combinations that differ in
    the number of trees once, with the most of them, and scores each as the
    forest of its first trees, all in one pass over a side; seconds are then
    those of the shared fit. A prefix is a valid forest of its size, though
    not the one that MLlib draws when asked for fewer trees.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; use one of {METRICS}")
    if nested not in (None, "numTrees"):
        raise ValueError("only numTrees can be nested")
    spark = df.sparkSession
    evaluator = ClassMetricEvaluator(metricName=metric, labelCol=label)
    groups = _nested_groups(param_grid, nested)
    got: list[list[tuple]] = [[] for _ in param_grid]

    def sizes_of(group: list[int]) -> list[int]:
        param = learner.getParam(nested)
        return [param_grid[i].get(param, learner.getOrDefault(param)) for i in group]

    def prefix_scores(model, sizes: list[int], both: DataFrame) -> list[list[float]]:
        rows = nested_predictions(model, both, sizes, ["_side", label])
        found = summary(rows, label, "prediction", by=["_side", "n_trees"]).select("_side", "n_trees", metric).collect()
        score = {(r[0], r[1]): float(r[2]) if r[2] is not None else 0.0 for r in found}
        return [[score.get((side, n), 0.0) for n in sizes] for side in ("test", "train")]

    for fold in range(k):
        train = df.where(F.col(fold_col) != fold)
        prep = preprocess.fit(train)
        sides = [
            written(prep.transform(part), f"fold-{side}")
            for side, part in (("test", df.where(F.col(fold_col) == fold)), ("train", train))
        ]
        features = learner.getFeaturesCol()
        test, taught = (
            t.select(F.lit(side).alias("_side"), label, features) for side, t in zip(("test", "train"), sides)
        )
        both = test.unionByName(taught)

        def one(group):
            t0 = time.perf_counter()
            if nested is None:
                model = learner.fit(sides[1], param_grid[group[0]])
                t1 = time.perf_counter()
                scores = [[evaluator.evaluate(model.transform(side))] for side in sides]
            else:
                sizes = sizes_of(group)
                most = param_grid[group[0]] | {learner.getParam(nested): max(sizes)}
                model = learner.fit(sides[1], most)
                t1 = time.perf_counter()
                scores = prefix_scores(model, sizes, both)
            seconds = t1 - t0, time.perf_counter() - t1
            return [(*pair, *seconds) for pair in zip(*scores)]

        for group, rows in zip(groups, _side_by_side(spark, one, groups, parallelism)):
            for i, row in zip(group, rows):
                got[i].append(row)

    def mean_std(values):
        m = sum(values) / len(values)
        return m, (sum((v - m) ** 2 for v in values) / len(values)) ** 0.5

    rows = []
    for i, (params, scores) in enumerate(zip(param_grid, got)):
        test, taught, fit, score = (mean_std(x) for x in zip(*scores))
        timed = parallelism <= 1
        rows.append((i, param_text(params), *test, *taught, fit[0] if timed else None, score[0] if timed else None))
    best = max(range(len(rows)), key=lambda i: (rows[i][2], -i))
    results = spark.createDataFrame(
        [(*r, r[0] == best) for r in rows],
        "combo int, params string, cv_score double, cv_std double, train_score double, train_std double, "
        "fit_seconds double, score_seconds double, is_best boolean",
    )
    prep = preprocess.fit(df)
    fitted = learner.fit(written(prep.transform(df), "search-train"), param_grid[best])
    return PipelineModel(stages=[prep, fitted]), results


def class_weight_lookup(df: DataFrame, label: str) -> DataFrame:
    """(label, weight) with "balanced" weights n / (k · n_class); rows
    without a label are a class of their own."""
    # one row per class, written: the input is aggregated once
    counts = written(df.groupBy(label).agg(F.count(F.lit(1)).alias("_nc")), "classes")
    n = counts.select(F.sum("_nc")).scalar()
    k = counts.select(F.count(F.lit(1))).scalar()
    return counts.select(label, (n / (k * F.col("_nc"))).alias("weight"))


def with_class_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """Adds the balanced weight per row (``weightCol`` of the learners)."""
    lookup = class_weight_lookup(df, label).withColumnRenamed(label, "_label_w").withColumnRenamed("weight", out)
    return df.join(lookup, F.col(label).eqNullSafe(F.col("_label_w")), "left").drop("_label_w")


class BalancedWeights(Estimator, HasLabelCol, HasOutputCol):
    """Pipeline stage for weights computed inside each fit: learns the
    balanced weight of every class from the rows it is fitted on (one row per
    class on the driver; classification learners have few) and adds it to
    rows that have the label column."""

    def __init__(self, labelCol="label", outputCol="w_balanced"):
        super().__init__()
        self._set(labelCol=labelCol, outputCol=outputCol)

    def _fit(self, dataset: DataFrame) -> "BalancedWeightsModel":
        rows = dataset.groupBy(F.col(self.getLabelCol()).cast("double")).count().collect()
        n = sum(r[1] for r in rows)
        weights = {r[0]: n / (len(rows) * r[1]) for r in rows}
        return BalancedWeightsModel(self.getLabelCol(), self.getOutputCol(), weights)


class BalancedWeightsModel(Model, HasLabelCol, HasOutputCol):
    def __init__(self, labelCol="label", outputCol="w_balanced", weights=None):
        super().__init__()
        self._set(labelCol=labelCol, outputCol=outputCol)
        self.weights = dict(weights or {})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        if self.getLabelCol() not in dataset.columns:
            return dataset
        label = F.col(self.getLabelCol()).cast("double")
        weight = F.lit(1.0)
        for value, w in self.weights.items():
            weight = F.when(label.eqNullSafe(F.lit(value).cast("double")), F.lit(w)).otherwise(weight)
        return dataset.withColumn(self.getOutputCol(), weight)
