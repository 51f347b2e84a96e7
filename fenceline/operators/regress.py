"""Least squares against Huber's robust regression."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import special
from ..functions.columns import add
from ..functions.lineage import spread
from ..functions.rank import TASK_ROWS, column_quantiles
from .correlate import complete_numbers

# Huber's tuning constant, the normal quartile that scales the
# median absolute residual, and the weight under which a row counts as ignored.
HUBER = 1.345
NORMAL_QUARTILE = 0.6744897501960817
IGNORED_WEIGHT = 0.0021

COEFFICIENTS = "model string, term string, estimate double, std_error double, statistic double, p_value double"


def _prepare(df: DataFrame, target: str, predictors: Sequence[str]) -> tuple[DataFrame, int]:
    if len(predictors) < 2:
        raise ValueError("at least two predictors are needed")
    data = spread(complete_numbers(df, [target, *predictors])).persist(StorageLevel.MEMORY_AND_DISK)
    n = data.count()
    if n < 10:
        data.unpersist()
        raise ValueError("at least 10 complete rows are needed")
    return data, n


def _fit(
    data: DataFrame, target: str, predictors: Sequence[str], means: Sequence[float], weight: Column | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """(intercept and coefficients, X'X of the centred predictors) of weighted least squares in one pass.

    Columns are centred by given means first, which keeps the sums well scaled.
    """
    w = F.lit(1.0) if weight is None else weight
    names = [target, *predictors]
    x = [F.col(c) - F.lit(float(m)) for c, m in zip(names, means)]
    p = len(names)
    sums = {(-1, -1): F.sum(w)}
    for i in range(p):
        sums[(-1, i)] = F.sum(w * x[i])
        for j in range(i, p):
            sums[(i, j)] = F.sum(w * x[i] * x[j])
    row = data.agg(*[s.alias(f"s{k}") for k, s in enumerate(sums.values())]).first()
    total = dict(zip(sums, row))
    gram = np.zeros((p, p))
    gram[0, 0] = total[(-1, -1)]
    right = np.zeros(p)
    right[0] = total[(-1, 0)]
    for i in range(1, p):
        gram[0, i] = gram[i, 0] = total[(-1, i)]
        right[i] = total[(0, i)]
        for j in range(i, p):
            gram[i, j] = gram[j, i] = total[(i, j)]
    scale = 1.0 / np.sqrt(np.maximum(np.diag(gram), 1e-300))
    solved = scale * np.linalg.lstsq(gram * np.outer(scale, scale), right * scale, rcond=None)[0]
    slopes = solved[1:]
    intercept = solved[0] + means[0] - float(np.dot(slopes, means[1:]))
    return np.array([intercept, *slopes]), gram


def _means(data: DataFrame, names: Sequence[str]) -> list[float]:
    return [float(v) for v in data.agg(*[F.avg(c) for c in names]).first()]


def _residual(target: str, predictors: Sequence[str], coefficients: Sequence[float], intercept: float) -> Column:
    return F.col(target) - add([F.lit(float(intercept)), *[F.lit(float(b)) * F.col(c) for b, c in zip(coefficients, predictors)]])


def _inverse_gram(gram: np.ndarray, means: Sequence[float]) -> np.ndarray:
    """Inverse of X'X with the intercept first, from unweighted sums about the means."""
    inner, mean = np.linalg.inv(gram[1:, 1:]), np.asarray(means)
    full = np.zeros_like(gram)
    full[1:, 1:] = inner
    full[0, 1:] = full[1:, 0] = -inner @ mean
    full[0, 0] = 1.0 / gram[0, 0] + mean @ inner @ mean
    return full


def least_squares(df: DataFrame, target: str, predictors: Sequence[str], task_rows: int = TASK_ROWS) -> tuple[DataFrame, DataFrame]:
    """(coefficients, summary) of ordinary least squares over complete rows."""
    data, n = _prepare(df, target, predictors)
    try:
        return _least_squares(data, n, target, predictors, task_rows)
    finally:
        data.unpersist()


def _least_squares(data: DataFrame, n: int, target: str, predictors: Sequence[str], task_rows: int):
    spark = data.sparkSession
    means = _means(data, [target, *predictors])
    fitted, gram = _fit(data, target, predictors, means)
    b0, *b = (float(v) for v in fitted)
    residual = _residual(target, predictors, b, b0)
    p = len(predictors)
    sums = data.agg(F.sum(residual * residual), F.var_pop(target) * n).first()
    sse, sst = float(sums[0]), float(sums[1])
    dof = n - p - 1
    mse = sse / dof
    errors = np.sqrt(mse * np.diag(_inverse_gram(gram, means[1:])))
    rows = []
    for term, estimate, error in zip(["intercept", *predictors], [b0, *b], errors):
        t = estimate / error
        rows.append(("least squares", term, float(estimate), float(error), float(t), float(special.t_two_sided(t, dof))))
    r2 = 1.0 - sse / sst
    f = (sst - sse) / p / mse
    quartiles = column_quantiles(data.select(residual.alias("r")), ["r"], [0.0, 0.25, 0.5, 0.75, 1.0], n, task_rows)["r"]
    summary = spark.createDataFrame(
        [(
            "least squares", n, r2, 1 - (1 - r2) * (n - 1) / dof, f, float(special.f_sf(f, p, dof)), math.sqrt(mse),
            *[float(q) for q in quartiles],
        )],
        "model string, n long, r_squared double, adjusted_r_squared double, f double, f_p_value double, "
        "residual_error double, residual_min double, residual_q1 double, residual_median double, residual_q3 double, residual_max double",
    )
    return spark.createDataFrame(rows, COEFFICIENTS), summary


def huber_regression(
    df: DataFrame, target: str, predictors: Sequence[str], rounds: int = 50, tolerance: float = 1e-6,
    task_rows: int = TASK_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """(coefficients, summary) by iteratively reweighted least squares with the MAD as scale.

    The current coefficients enter the next round as literals, so the plan stays a
    scan of the persisted rows however many rounds it takes.
    """
    data, n = _prepare(df, target, predictors)
    try:
        return _huber(data, n, target, predictors, rounds, tolerance, task_rows)
    finally:
        data.unpersist()


def huber_rows(
    df: DataFrame, coefficients: DataFrame, summary: DataFrame, target: str, predictors: Sequence[str], row_id: str
) -> DataFrame:
    """row_id, residual, weight and ignored of every complete row, from what huber_regression() returns.

    A few coefficients reach the driver; the rows are one scan.
    """
    fitted = {r["term"]: r["estimate"] for r in coefficients.where("model = 'huber'").collect()}
    scale = summary.where("model = 'huber'").first()["residual_error"]
    data = complete_numbers(df, [target, *predictors], [row_id])
    residual = _residual(target, predictors, [fitted[c] for c in predictors], fitted["intercept"])
    size = F.abs(residual) / F.lit(scale)
    weight = F.when(size <= HUBER, 1.0).otherwise(HUBER / size) if scale else F.lit(1.0)
    return data.select(row_id, residual.alias("residual"), weight.alias("weight")).withColumn(
        "ignored", F.col("weight") < IGNORED_WEIGHT
    )


def _huber(data, n, target, predictors, rounds, tolerance, task_rows):
    spark = data.sparkSession
    means = _means(data, [target, *predictors])
    current, gram = _fit(data, target, predictors, means)

    def scale_of(residual: Column) -> float:
        sized = data.select(F.abs(residual).alias("a"))
        return column_quantiles(sized, ["a"], [0.5], n, task_rows)["a"][0] / NORMAL_QUARTILE

    def weight_of(residual: Column, scale: float) -> Column:
        size = F.abs(residual) / F.lit(scale)
        return F.when(size <= HUBER, 1.0).otherwise(HUBER / size)

    residual = _residual(target, predictors, current[1:], current[0])
    scale = scale_of(residual)
    for _ in range(rounds):
        if scale == 0:
            break
        previous, (current, _) = current, _fit(data, target, predictors, means, weight_of(residual, scale))
        residual = _residual(target, predictors, current[1:], current[0])
        scale = scale_of(residual)
        if np.max(np.abs(current - previous) / np.maximum(np.abs(previous), 1e-12)) < tolerance:
            break
    p, dof = len(predictors), n - len(predictors) - 1
    inside = F.abs(residual) / F.lit(scale) <= HUBER
    psi = F.when(inside, residual / F.lit(scale)).otherwise(HUBER * F.signum(residual))
    weight = weight_of(residual, scale)
    sums = data.agg(
        F.avg(inside.cast("double")).alias("m"), F.sum(psi * psi).alias("psi2"),
        F.count_if(weight < IGNORED_WEIGHT).alias("ignored"), F.avg(weight).alias("mean_weight"),
        F.count_if(weight < 1.0).alias("reduced"),
    ).first()
    m = float(sums["m"])
    # Huber's first covariance form; psi' is 0 or 1, so its variance is m (1 - m).
    k = 1.0 + (p + 1) / n * (m * (1 - m)) / (m * m)
    factor = k * k * (float(sums["psi2"]) / dof) * scale**2 / (m * m)
    errors = np.sqrt(factor * np.diag(_inverse_gram(gram, means[1:])))
    rows = []
    for term, estimate, error in zip(["intercept", *predictors], current, errors):
        z = estimate / error
        rows.append(("huber", term, float(estimate), float(error), float(z), float(2 * special.norm_sf(abs(z)))))
    quartiles = column_quantiles(data.select(weight.alias("w")), ["w"], [0.0, 0.25, 0.5, 0.75, 1.0], n, task_rows)["w"]
    summary = spark.createDataFrame(
        [("huber", n, float(scale), *[float(q) for q in quartiles], float(sums["mean_weight"]), sums["reduced"], sums["ignored"])],
        "model string, n long, residual_error double, weight_min double, weight_q1 double, weight_median double, "
        "weight_q3 double, weight_max double, weight_mean double, reduced_rows long, ignored_rows long",
    )
    return spark.createDataFrame(rows, COEFFICIENTS), summary


def compare_regressions(
    least: tuple[DataFrame, DataFrame], robust: tuple[DataFrame, DataFrame]
) -> tuple[DataFrame, DataFrame]:
    """(per predictor changes, one-row verdict) of least squares against Huber.

    A predictor is influenced if its coefficient moves by more than 0.1 or 10 %.
    """
    a = least[0].where("term <> 'intercept'").select("term", F.col("estimate").alias("least_squares"))
    b = robust[0].where("term <> 'intercept'").select("term", F.col("estimate").alias("huber"))
    change = F.abs(F.col("least_squares") - F.col("huber"))
    percent = F.when(F.abs("least_squares") > 1e-10, change / F.abs("least_squares") * 100).otherwise(0.0)
    changes = a.join(b, "term").select(
        "term", "least_squares", "huber", change.alias("change"), percent.alias("change_percent"),
        ((change > 0.1) | (percent > 10)).alias("influenced"),
    )
    linear = least[1].first()["residual_error"]
    robust_error = robust[1].first()["residual_error"]
    verdict = changes.agg(F.bool_or("influenced").alias("influenced")).select(
        "influenced", F.lit(linear).alias("least_squares_error"), F.lit(robust_error).alias("huber_error"),
        F.lit((linear - robust_error) / linear * 100 if linear > 0 else 0.0).alias("error_change_percent"),
    )
    return changes, verdict
