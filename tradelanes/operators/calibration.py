"""Weights of the composite score learnt from outcomes that were confirmed."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SUB_SCORES = ("sci_norm", "crs_norm", "his_norm")


def fit_outcomes(
    scored: DataFrame, outcome: str, inputs: tuple[str, ...] = SUB_SCORES, weight: str | None = None, max_iter: int = 200
) -> LogisticRegressionModel:
    """Logistic regression of a 0/1 outcome on sub-scores, without penalty.

    Every iteration is one aggregation over the rows where they lie; the driver
    sees a gradient of one number an input. Rows without outcome or without
    one of the inputs play no part. Rows that agree in all inputs and the
    outcome may be given once with their number as ``weight``.
    """
    names = [*inputs, outcome, *([weight] if weight else [])]
    rows = scored.select(*[F.col(n).cast("double").alias(n) for n in names]).dropna()
    strange = rows.agg(
        F.count_if(~F.col(outcome).isin(0.0, 1.0)).alias("strange"), F.min(outcome).alias("least"), F.max(outcome).alias("most")
    ).first()
    if strange["strange"]:
        raise ValueError(f"{outcome} must be 0 or 1")
    if strange["least"] == strange["most"]:
        raise ValueError(f"{outcome} needs rows of both kinds")
    vectors = VectorAssembler(inputCols=list(inputs), outputCol="_inputs").transform(rows)
    settings = {"weightCol": weight} if weight else {}
    machine = LogisticRegression(
        featuresCol="_inputs", labelCol=outcome, family="binomial", regParam=0.0, tol=1e-12, maxIter=max_iter, **settings
    )
    return machine.fit(vectors)


def weight_calibration(
    scored: DataFrame, outcome: str, inputs: tuple[str, ...] = SUB_SCORES, weight: str | None = None
) -> DataFrame:
    """``input``, ``coefficient`` and ``weight`` of each sub-score, and the ``intercept``.

    The weight is the input's share of all positive coefficients, ready for
    the weighted score: an input that does not raise the odds of a confirmed
    outcome gets 0. Where none does, the weights are undefined.
    """
    model = fit_outcomes(scored, outcome, inputs, weight)
    found = list(zip(inputs, model.coefficients.tolist(), strict=True))
    whole = sum(max(c, 0.0) for _, c in found)
    rows = [(name, c, max(c, 0.0) / whole if whole else None, model.intercept) for name, c in found]
    return scored.sparkSession.createDataFrame(rows, "input string, coefficient double, weight double, intercept double")
