"""Projection, predicates and top-k."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def map_label(df: DataFrame, col: str, mapping: Mapping, out: str | None = None) -> DataFrame:
    """Strict dictionary map (pandas ``Series.map``): an unmapped or null
    value becomes null. A literal map lookup, evaluated in codegen."""
    lookup = F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])
    return df.withColumn(out or col, F.try_element_at(lookup, F.col(col)))


def binary_label(df: DataFrame, col: str, positive="Yes", out: str = "label") -> DataFrame:
    """1.0 where ``col == positive``, else 0.0 — null too (the MLlib path)."""
    return df.withColumn(
        out, F.when(F.col(col) == F.lit(positive), F.lit(1.0)).otherwise(F.lit(0.0))
    )


def features_and_target(
    df: DataFrame, label: str, drop: Sequence[str] = (), target: str = "target"
) -> DataFrame:
    """X and y in one frame: the listed columns are dropped and the label
    column becomes the last column, named ``target``."""
    feats = [c for c in df.columns if c != label and c not in set(drop)]
    return df.select(*feats, F.col(label).alias(target))


def select_existing(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Project only the listed columns that exist, in the listed order."""
    present = set(df.columns)
    return df.select(*[c for c in cols if c in present])


def filter_at_least(df: DataFrame, col: str, threshold: float) -> DataFrame:
    """Inclusive threshold filter (``>=``)."""
    return df.where(F.col(col) >= F.lit(threshold))


def top_k(df: DataFrame, col: str, k: int, tie_break: Sequence[str] = ()) -> DataFrame:
    """k rows with the largest ``col`` (ties by ``tie_break`` ascending).
    Planned as ``TakeOrderedAndProject``: every task keeps its own k best,
    one merge of ``tasks × k`` rows — never a global sort."""
    return df.orderBy(F.desc(col), *[F.asc(c) for c in tie_break]).limit(k)
