"""Acting on scores: risk list, its profile, retention ROI."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.functions.frames import written
from riskframe.operators.profile import describe_mixed
from riskframe.operators.project import filter_at_least, select_existing, top_k

# Fixed values of the reference's business case.
THRESHOLD = 0.80
TOP_K = 20
LOSS_PER_MONTH = 500.0
COST_PER_CUSTOMER = 100.0
WIN_RATE = 0.1
MONTHS_SAVED = 3


def at_risk(df: DataFrame, score_col: str = "churn_proba", threshold: float = THRESHOLD) -> DataFrame:
    """Every row at or above the threshold (inclusive)."""
    return filter_at_least(df, score_col, threshold)


def high_risk(
    df: DataFrame,
    score_col: str = "churn_proba",
    threshold: float = THRESHOLD,
    k: int = TOP_K,
    key: Sequence[str] = (),
) -> DataFrame:
    """At most ``k`` rows at or above the threshold, highest score first
    (ties by ``key``): a filter pushed below a per-task top-k."""
    return top_k(at_risk(df, score_col, threshold), score_col, k, tie_break=key)


def risk_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Mixed describe of the listed (existing) columns of a risk list. The
    list's rows are written first: what made them runs once."""
    return describe_mixed(written(select_existing(df, cols), "risk-list"))


def retention_roi(
    targeted: DataFrame,
    loss_per_month: float = LOSS_PER_MONTH,
    cost_per_customer: float = COST_PER_CUSTOMER,
    win_rate: float = WIN_RATE,
    months_saved: float = MONTHS_SAVED,
    segment: Sequence[str] = (),
) -> DataFrame:
    """N targeted customers → expected gain ``N·rate·loss·months``, cost
    ``N·cost`` and ROI % ``(gain - cost) / cost · 100`` (null when N = 0).
    N counts **all** rows passed in (all at-risk customers, not the top k);
    ``segment`` gives one row per segment."""
    n = F.count(F.lit(1))
    agg = targeted.groupBy(*segment).agg(n.alias("n_targeted"))
    gain = F.col("n_targeted") * F.lit(float(win_rate * loss_per_month * months_saved))
    cost = F.col("n_targeted") * F.lit(float(cost_per_customer))
    return agg.select(
        *segment,
        "n_targeted",
        gain.alias("expected_gain"),
        cost.alias("expected_cost"),
        (F.try_divide(gain - cost, cost) * F.lit(100.0)).alias("roi_pct"),
    )
