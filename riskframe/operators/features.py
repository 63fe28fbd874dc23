"""Feature engineering: encoders, scalers, assembly, and the
two preprocessing pipelines (the MLlib path and the one-hot path).

All stages are MLlib ``Estimator``/``Transformer`` objects so they compose
into a ``Pipeline`` and are fitted inside cross-validation folds.
Fitting statistics is one distributed aggregate; the fitted state (levels,
means, scales) is bounded by the number of columns and levels, not rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasOutputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

IDX = "_idx"
OHE = "_ohe"
STD = "_std"
IMP = "_imp"
# Category levels of one column that a fit accepts, and as plain columns.
MAX_LEVELS = 10_000
MAX_ONE_HOT_COLUMNS = 500


# --------------------------------------------------------------------------
# Categorical encoders
# --------------------------------------------------------------------------


def category_indexer(cols: Sequence[str], suffix: str = IDX) -> StringIndexer:
    """One multi-column ``StringIndexer``: most frequent level = 0, ties in
    alphabetical order, unseen and null levels to the extra index
    ``numLabels`` (``handleInvalid="keep"``). One indexer for all columns
    counts every column in the same pass."""
    return StringIndexer(
        inputCols=list(cols),
        outputCols=[c + suffix for c in cols],
        handleInvalid="keep",
        stringOrderType="frequencyDesc",
    )


def check_levels(df: DataFrame, cols: Sequence[str], max_levels: int = MAX_LEVELS) -> None:
    """Raise, naming the columns, if one has more than ``max_levels`` distinct
    values (by HyperLogLog, one aggregate for all). The fitted indexer keeps
    every level on the driver and one-hot makes a slot of each, so a key among
    the categories must not get that far. Nothing is ever cut."""
    if not cols:
        return
    row = df.agg(*[F.approx_count_distinct(F.col(c)) for c in cols]).first()
    wide = {c: n for c, n in zip(cols, row) if n > max_levels}
    if wide:
        raise ValueError(f"more than max_levels={max_levels} category levels (estimated): {wide}")


class LevelCheck(Estimator, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """``check_levels`` as a pipeline stage before an indexer."""

    maxLevels = Param(Params._dummy(), "maxLevels", "levels allowed", typeConverter=TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCols=None, maxLevels=MAX_LEVELS):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> "LevelCheckModel":
        check_levels(dataset, self.getInputCols(), self.getOrDefault(self.maxLevels))
        return LevelCheckModel()


class LevelCheckModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    """Passes rows on."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset


def index_categories(
    df: DataFrame, cols: Sequence[str], suffix: str = IDX, max_levels: int = MAX_LEVELS
) -> DataFrame:
    """Fit the indexer on ``df`` and add the ``<col>_idx`` columns."""
    check_levels(df, cols, max_levels)
    return category_indexer(cols, suffix).fit(df).transform(df)


def one_hot_encoder(cols: Sequence[str]) -> list:
    """Indexer + encoder stages. All real levels get a slot; the extra
    "unknown" index of the indexer is the dropped last slot, so an unseen
    level encodes as all zeros (sklearn ``handle_unknown="ignore"``).
    Vectors stay sparse."""
    return [
        category_indexer(cols),
        OneHotEncoder(
            inputCols=[c + IDX for c in cols],
            outputCols=[c + OHE for c in cols],
            dropLast=True,
            handleInvalid="error",
        ),
    ]


def one_hot(df: DataFrame, cols: Sequence[str], max_levels: int = MAX_LEVELS) -> DataFrame:
    """Fit and apply the one-hot stages; adds ``<col>_ohe`` vector columns."""
    check_levels(df, cols, max_levels)
    return Pipeline(stages=one_hot_encoder(cols)).fit(df).transform(df)


def one_hot_columns(
    df: DataFrame, cols: Sequence[str], keep: Sequence[str] = (), max_levels: int = MAX_ONE_HOT_COLUMNS
) -> DataFrame:
    """One-hot as plain 0/1 double columns named ``<col>_<level>`` (levels
    come from the fitted indexer, a bounded list), for inspection and for
    consumers that do not read vectors."""
    check_levels(df, cols, max_levels)
    model = Pipeline(stages=one_hot_encoder(cols)).fit(df)
    indexer = model.stages[0]
    out = model.transform(df)
    select = [F.col(k) for k in keep]
    for col, levels in zip(cols, indexer.labelsArray):
        arr = vector_to_array(F.col(col + OHE))
        for i, level in enumerate(levels):
            select.append(arr[i].alias(f"{col}_{level}"))
    return out.select(*select)


# --------------------------------------------------------------------------
# Column standardizer (population or sample std), an MLlib estimator
# --------------------------------------------------------------------------


class _StandardizerParams(HasInputCols, HasOutputCols):
    ddof = Param(
        Params._dummy(),
        "ddof",
        "delta degrees of freedom of the std: 0 = population, 1 = sample",
        typeConverter=TypeConverters.toInt,
    )

    def __init__(self, *args):
        super().__init__(*args)
        self._setDefault(ddof=0)

    def getDdof(self) -> int:
        return self.getOrDefault(self.ddof)


class ColumnStandardizer(Estimator, _StandardizerParams, DefaultParamsReadable, DefaultParamsWritable):
    """``(x - mean) / std`` per numeric column; a zero (or undefined) std
    divides by 1 so a constant column becomes 0. ``ddof=0`` is the
    population std of scikit-learn's scaler, ``ddof=1`` the sample std of
    MLlib's ``StandardScaler``. Fitting is one aggregate pass."""

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None, ddof=0):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> "ColumnStandardizerModel":
        cols = self.getInputCols()
        std = F.stddev_pop if self.getDdof() == 0 else F.stddev_samp
        aggs = []
        for i, c in enumerate(cols):
            x = F.col(c).cast("double")
            aggs += [F.avg(x).alias(f"m{i}"), std(x).alias(f"s{i}")]
        row = dataset.agg(*aggs).first()
        means, scales = [], []
        for i in range(len(cols)):
            m, s = row[f"m{i}"], row[f"s{i}"]
            means.append(float(m) if m is not None else 0.0)
            scales.append(float(s) if s not in (None, 0.0) and s == s else 1.0)
        outs = self.getOutputCols() if self.isSet(self.outputCols) else [c + STD for c in cols]
        return ColumnStandardizerModel(inputCols=cols, outputCols=outs, means=means, scales=scales)


class ColumnStandardizerModel(Model, HasInputCols, HasOutputCols, DefaultParamsReadable, DefaultParamsWritable):
    means = Param(Params._dummy(), "means", "fitted means", typeConverter=TypeConverters.toListFloat)
    scales = Param(Params._dummy(), "scales", "fitted divisors", typeConverter=TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None, means=None, scales=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        means = self.getOrDefault(self.means)
        scales = self.getOrDefault(self.scales)
        return dataset.withColumns(
            {
                out: (F.col(c).cast("double") - F.lit(m)) / F.lit(s)
                for c, out, m, s in zip(self.getInputCols(), self.getOutputCols(), means, scales)
            }
        )


def standardize(df: DataFrame, cols: Sequence[str], ddof: int = 0, suffix: str = STD) -> DataFrame:
    """Fit on ``df`` and add ``<col>_std`` columns."""
    est = ColumnStandardizer(inputCols=list(cols), outputCols=[c + suffix for c in cols], ddof=ddof)
    return est.fit(df).transform(df)


# --------------------------------------------------------------------------
# Vector assembly and the MLlib scaler
# --------------------------------------------------------------------------


def assembler(inputs: Sequence[str], out: str = "features", handle_invalid: str = "error") -> VectorAssembler:
    """``VectorAssembler``. ``error`` (default) rejects null/NaN inputs:
    with ``keep`` a null becomes NaN and poisons scaler statistics (SURVEY
    T12), so missing values must be handled explicitly before assembly."""
    return VectorAssembler(inputCols=list(inputs), outputCol=out, handleInvalid=handle_invalid)


def assemble(df: DataFrame, inputs: Sequence[str], out: str = "features", handle_invalid: str = "error") -> DataFrame:
    return assembler(inputs, out, handle_invalid).transform(df)


def vector_scaler(input_col: str = "features_raw", out: str = "features", with_mean: bool = True) -> StandardScaler:
    """MLlib ``StandardScaler``: centred, divided by the sample std."""
    return StandardScaler(inputCol=input_col, outputCol=out, withMean=with_mean, withStd=True)


def scale_vector(df: DataFrame, input_col: str = "features_raw", out: str = "features") -> DataFrame:
    return vector_scaler(input_col, out).fit(df).transform(df)


# --------------------------------------------------------------------------
# Pipelines
# --------------------------------------------------------------------------


def column_roles(df: DataFrame, exclude: Sequence[str] = ()) -> tuple[list[str], list[str]]:
    """(categorical, numeric) column names from the schema: strings are
    categorical, numeric types numeric (the notebook's dtype rule)."""
    skip = set(exclude)
    cat, num = [], []
    for f in df.schema.fields:
        if f.name in skip:
            continue
        if isinstance(f.dataType, T.StringType):
            cat.append(f.name)
        elif isinstance(f.dataType, T.NumericType):
            num.append(f.name)
    return cat, num


def preprocess_pipeline(
    categorical: Sequence[str],
    numeric: Sequence[str],
    mode: str = "ordinal",
    out: str = "features",
    scale: bool = True,
    handle_invalid: str = "error",
    impute_strategy: str = "mean",
    max_levels: int = MAX_LEVELS,
) -> Pipeline:
    """Per-type preprocessing as one unfitted ``Pipeline``.

    ``mode="ordinal"`` is the MLlib path: indexed categories and numerics
    assembled into ``features_raw`` and scaled by MLlib's scaler (sample
    std). With ``scale=False`` the indexed columns keep their nominal
    metadata, which tree learners use to split on categories as sets.

    ``mode="onehot"`` is the notebook path: numerics standardized with the
    population std, categories one-hot encoded, then assembled.

    Missing numerics (the null policy is explicit): ``handle_invalid`` is
    ``"error"`` (default), ``"skip"`` (drop the row), ``"keep"`` (NaN slot)
    or ``"impute"`` (an MLlib ``Imputer`` with ``impute_strategy`` — mean,
    median or mode — fitted on the training data, before scaling). Missing
    categories always go to the indexer's extra "unknown" level. A category
    of more than ``max_levels`` levels raises before anything is indexed.

    The assembled column before any vector scaling carries the slot names
    (``slot_names`` reads it).
    """
    categorical, numeric = list(categorical), list(numeric)
    stages = [LevelCheck(inputCols=categorical, maxLevels=max_levels)] if categorical else []
    nums = numeric
    assemble_invalid = handle_invalid
    if handle_invalid == "impute":
        if numeric:
            stages.append(
                Imputer(inputCols=numeric, outputCols=[c + IMP for c in numeric], strategy=impute_strategy)
            )
            nums = [c + IMP for c in numeric]
        assemble_invalid = "error"
    if mode == "ordinal":
        if categorical:
            stages.append(category_indexer(categorical))
        inputs = [c + IDX for c in categorical] + nums
        if scale:
            stages += [assembler(inputs, "features_raw", assemble_invalid), vector_scaler("features_raw", out)]
        else:
            stages += [assembler(inputs, out, assemble_invalid)]
        return Pipeline(stages=stages)
    if mode == "onehot":
        if categorical:
            stages += one_hot_encoder(categorical)
        inputs = []
        if nums:
            stages.append(ColumnStandardizer(inputCols=nums, outputCols=[c + STD for c in nums], ddof=0))
            inputs += [c + STD for c in nums]
        inputs += [c + OHE for c in categorical]
        stages.append(assembler(inputs, out, assemble_invalid))
        return Pipeline(stages=stages)
    raise ValueError(f"unknown mode {mode!r}: use 'ordinal' or 'onehot'")


def assembled_column(pipeline_model) -> str:
    """Name of the vector column that still carries slot metadata."""
    for stage in pipeline_model.stages:
        if isinstance(stage, VectorAssembler) or type(stage).__name__ == "VectorAssembler":
            return stage.getOutputCol()
    raise ValueError("pipeline has no VectorAssembler stage")


def readable_name(slot: str, numeric: Sequence[str], categorical: Sequence[str]) -> str:
    """Slot name in the notebook's style: ``num__x`` / ``cat__x_level``."""
    for c in categorical:
        if slot.startswith(c + OHE + "_"):
            return f"cat__{c}_{slot[len(c + OHE) + 1:]}"
        if slot == c + IDX:
            return f"cat__{c}"
    for c in numeric:
        if slot in (c, c + STD, c + IMP, c + IMP + STD):
            return f"num__{c}"
    return slot


def slot_names(df: DataFrame, vector_col: str) -> list[str]:
    """Slot names from the ML attribute metadata of an assembled column."""
    meta = df.schema[vector_col].metadata.get("ml_attr", {})
    n = meta.get("num_attrs")
    attrs = meta.get("attrs", {})
    pairs = []
    for group in attrs.values():
        for a in group:
            pairs.append((a["idx"], a.get("name", f"slot_{a['idx']}")))
    pairs.sort()
    names = [name for _, name in pairs]
    if n is not None and len(names) < n:
        names += [f"slot_{i}" for i in range(len(names), n)]
    return names
