"""Column-level helpers (built-in Spark expressions only)."""

from riskframe.functions.columns import (
    col_of,
    f_score,
    hex_bucket,
    hex_threshold,
    is_missing,
    linear_predictor,
    numeric_columns,
    round_doubles,
    safe_ratio,
    sigmoid,
    stable_hash,
    text_columns,
)

__all__ = [
    "col_of",
    "f_score",
    "hex_bucket",
    "hex_threshold",
    "is_missing",
    "linear_predictor",
    "numeric_columns",
    "round_doubles",
    "safe_ratio",
    "sigmoid",
    "stable_hash",
    "text_columns",
]
