"""Column expressions shared by the operators.

Everything here returns a ``pyspark.sql.Column`` built from built-in
functions, so it stays inside whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col_of(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_ratio(num: str | Column, den: str | Column) -> Column:
    """``num / den`` as double, 0.0 when the denominator is 0 or null.

    ``try_divide`` keeps ANSI mode from raising on 0/0; the metrics in
    this library define every 0/0 case as 0.0.
    """
    return F.coalesce(
        F.try_divide(col_of(num).cast("double"), col_of(den).cast("double")),
        F.lit(0.0),
    )


def f_score(precision: Column, recall: Column) -> Column:
    """Harmonic mean of precision and recall, 0.0 when both are 0."""
    return safe_ratio(F.lit(2.0) * precision * recall, precision + recall)


def stable_hash(keys: Iterable[str | Column], seed: int | str) -> Column:
    """Hex md5 of the key parts and the seed: a per-row random draw that does
    not depend on partitioning, task order or the engine (DuckDB's ``md5``
    gives the same string). A part is its length, a colon and its text; a
    null part is a dash, so different keys never read alike."""
    parts = []
    for k in keys:
        text = col_of(k).cast("string")
        parts.append(F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.md5(F.concat_ws("#", *parts, F.lit(str(seed))))


def hex_bucket(hash_col: Column, digits: int) -> Column:
    """Integer value of the first ``digits`` hex characters of a hash."""
    return F.conv(F.substring(hash_col, 1, digits), 16, 10).cast("int")


def hex_threshold(fraction: float, digits: int = 8) -> str:
    """Fixed-width lowercase hex string ``t`` such that comparing a hash
    prefix ``< t`` selects ``fraction`` of the hash space."""
    top = 16**digits
    value = min(top, max(0, int(round(fraction * top))))
    if value >= top:
        return "g" * digits  # sorts after every hex digit
    return format(value, f"0{digits}x")


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def linear_predictor(coefficients: Mapping[str, float], intercept: float = 0.0) -> Column:
    """``intercept + sum(w_i * x_i)`` over named numeric columns."""
    expr = F.lit(float(intercept))
    for name, weight in coefficients.items():
        expr = expr + F.lit(float(weight)) * F.col(name).cast("double")
    return expr


def is_missing(df: DataFrame, name: str) -> Column:
    """Null, or NaN for floating-point columns (the pandas notion of missing)."""
    dtype = df.schema[name].dataType
    c = F.col(name)
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double/float column; used to present results and to make
    them comparable across engines whose sums differ in the last bit."""
    out = []
    for field in df.schema.fields:
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            out.append(F.round(F.col(field.name).cast("double"), digits).alias(field.name))
        else:
            out.append(F.col(field.name))
    return df.select(*out)


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name not in skip
    ]


def text_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.StringType) and f.name not in skip
    ]
