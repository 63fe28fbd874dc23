"""Penalised logistic regression by Newton steps.

Each step is one aggregate over the rows: the Gram matrix of the rows scaled
by the square root of their weight holds the Hessian and the gradient. The
system solved on the driver has one row for each feature, so a fit is some
six passes, however many rows there are.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.functions.columns import sigmoid
from riskframe.functions.frames import written

#: Features that a Gram matrix on the driver is meant for.
MAX_FEATURES = 4096


def _dot(x: Column, weights: np.ndarray) -> Column:
    product = F.zip_with(x, F.array(*[F.lit(float(w)) for w in weights]), lambda a, b: a * b)
    return F.aggregate(product, F.lit(0.0), lambda a, v: a + v)


class NewtonLogistic(Estimator, HasFeaturesCol, HasLabelCol):
    """Minimises ``sum of log losses + penalty / 2 * |w|^2``, the intercept
    unpenalised (``penalty = 1 / C``). A step that does not shorten the
    gradient is halved; the fit ends when no gradient entry exceeds ``tol`` times the rows.
    Rows without a label are left out; without rows, or with one class only and
    no penalty, there is no finite optimum and the fit stops after
    ``max_iter`` steps."""

    def __init__(self, penalty: float = 1.0, max_iter: int = 50, tol: float = 1e-10, featuresCol="features", labelCol="label"):
        super().__init__()
        self._set(featuresCol=featuresCol, labelCol=labelCol)
        self.penalty, self.max_iter, self.tol = penalty, max_iter, tol

    def setLabelCol(self, value: str) -> NewtonLogistic:
        return self._set(labelCol=value)

    def _fit(self, dataset: DataFrame) -> NewtonLogisticModel:
        label = F.col(self.getLabelCol()).cast("double")
        x = F.concat(vector_to_array(self.getFeaturesCol()), F.array(F.lit(1.0)))
        rows = written(dataset.where(label.isNotNull()).select(x.alias("x"), label.alias("y")), "newton")
        told = rows.agg(F.count("*"), F.max(F.size("x"))).first()
        n, p = told[0], told[1] or 1
        if p - 1 > MAX_FEATURES:
            raise ValueError(f"{p - 1} features are too many for Newton steps")
        penalty = np.full(p, float(self.penalty))
        penalty[-1] = 0.0
        beta, gradient, steps = np.zeros(p), np.zeros(p), 0
        last, step = None, np.zeros(p)  # the point before, and the step from it
        while n:
            hessian, new = self._moments(rows, beta, p)
            new = new - penalty * beta
            if last is not None and np.linalg.norm(new) > np.linalg.norm(gradient) and np.abs(step).max() > 1e-12:
                step = step / 2  # too far
                beta = last + step
                continue
            gradient = new
            if np.abs(gradient).max() <= self.tol * n or steps == self.max_iter:
                break
            step = np.linalg.lstsq(hessian + np.diag(penalty), gradient, rcond=None)[0]
            last, beta, steps = beta, beta + step, steps + 1
        return NewtonLogisticModel(beta[:-1], beta[-1], steps, np.abs(gradient).max(), self.getFeaturesCol())

    @staticmethod
    def _moments(rows: DataFrame, beta: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray]:
        """Hessian and gradient of the unpenalised part."""
        mu = sigmoid(F.col("m"))
        weighed = rows.select("x", "y", _dot(F.col("x"), beta).alias("m")).select("x", (F.col("y") - mu).alias("r"), F.greatest(F.sqrt(mu * (1 - mu)), F.lit(1e-8)).alias("s"))
        both = F.concat(F.transform("x", lambda v: v * F.col("s")), F.array(F.col("r") / F.col("s")))
        frame = MLUtils.convertVectorColumnsFromML(weighed.select(array_to_vector(both).alias("v")), "v")
        gram = RowMatrix(frame, 0, p + 1).computeGramianMatrix().toArray()
        return gram[:p, :p], gram[:p, p]


class NewtonLogisticModel(Model, HasFeaturesCol):
    """Adds ``probability`` (vector) and ``prediction`` (probability above a
    half). ``coefficients`` and ``intercept`` are those of the optimum,
    ``n_steps`` and ``gradient`` (its largest entry) tell how it was reached."""

    def __init__(self, coefficients=(), intercept: float = 0.0, n_steps: int = 0, gradient: float = 0.0, featuresCol="features"):
        super().__init__()
        self._set(featuresCol=featuresCol)
        self.coefficients, self.intercept = DenseVector(coefficients), float(intercept)
        self.n_steps, self.gradient = n_steps, float(gradient)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        margin = _dot(vector_to_array(self.getFeaturesCol()), self.coefficients.toArray()) + F.lit(self.intercept)
        scored = dataset.withColumn("_p", sigmoid(margin))
        return scored.withColumns(
            {"probability": array_to_vector(F.array(1 - F.col("_p"), F.col("_p"))), "prediction": (F.col("_p") > 0.5).cast("double")}
        ).drop("_p")
