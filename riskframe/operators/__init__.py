"""Operators: profiling, projection, features, splits, models, evaluation, action."""

from riskframe.operators import act, evaluate, features, models, profile, project, split

__all__ = ["act", "evaluate", "features", "models", "profile", "project", "split"]
