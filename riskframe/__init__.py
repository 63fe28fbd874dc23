"""riskframe — customer-attrition analytics as Spark DataFrame/MLlib operators.

profile -> prepare -> split -> train -> evaluate -> score -> act, every step a
function of DataFrames (or an MLlib Estimator/Transformer). The caller owns
the SparkSession; nothing here creates or stops one.

    import riskframe as rf
    rf.profile.describe_numeric(df)
    train, test = rf.split.train_test(df, "label", "customerID")
    model, secs = rf.models.fit_logistic(train, cat_cols, num_cols)
"""

from riskframe.operators import act, evaluate, features, models, profile, project, split
from riskframe.sources import activity, io

__version__ = "0.1.0"

__all__ = ["act", "activity", "evaluate", "features", "io", "models", "profile", "project", "split"]
