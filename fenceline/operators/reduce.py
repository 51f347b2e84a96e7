"""Standardising, principal components and how they separate the groups."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..functions.columns import add, number
from .correlate import complete_numbers
from .multivariate import covariance


def scale_factors(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """(mean, population std) per column; a constant column gets 1 as its divisor."""
    row = df.agg(*[F.struct(F.avg(number(c)), F.stddev_pop(number(c))).alias(c) for c in columns]).first()
    return {c: (row[c][0] or 0.0, row[c][1] or 1.0) for c in columns}


def standardise(df: DataFrame, columns: Sequence[str], factors: dict | None = None) -> DataFrame:
    """Columns as (x - mean) / population std."""
    factors = factors or scale_factors(df, columns)
    return df.withColumns({
        c: (number(c) - F.lit(float(factors[c][0]))) / F.lit(float(factors[c][1])) for c in columns
    })


@dataclass
class Components:
    """Fitted principal components of standardised columns."""

    columns: list[str]
    n: int
    mean: np.ndarray
    std: np.ndarray
    eigenvalues: np.ndarray
    loadings: np.ndarray  # one row per component
    kaiser: int
    n80: int
    n90: int
    recommended: int

    def table(self, spark) -> DataFrame:
        """component, eigenvalue, explained and cumulative percentage, Kaiser mark, recommended mark."""
        share = self.eigenvalues / self.eigenvalues.sum()
        rows = [
            (i + 1, float(e), float(100 * share[i]), float(100 * share[: i + 1].sum()), bool(e > 1), i < self.recommended)
            for i, e in enumerate(self.eigenvalues)
        ]
        return spark.createDataFrame(
            rows, "component int, eigenvalue double, explained double, cumulative double, kaiser boolean, recommended boolean"
        )

    def loading_table(self, spark, components: int | None = None) -> DataFrame:
        """Loadings of the first ``components``, all by default."""
        rows = [
            (i + 1, c, float(self.loadings[i, j]), float(abs(self.loadings[i, j])))
            for i in range(len(self.eigenvalues) if components is None else min(components, len(self.eigenvalues)))
            for j, c in enumerate(self.columns)
        ]
        return spark.createDataFrame(rows, "component int, variable string, loading double, abs_loading double")

    def choice(self, spark) -> DataFrame:
        return spark.createDataFrame(
            [(self.kaiser, self.n80, self.n90, self.recommended)], "kaiser int, n80 int, n90 int, recommended int"
        )

    def scores(self, df: DataFrame, keep: Sequence[str], count: int | None = None) -> DataFrame:
        """keep..., pc1, pc2, ... of complete rows as dot products with literals."""
        count = max(2, count or self.recommended)
        count = min(count, len(self.eigenvalues))
        data = complete_numbers(df, self.columns, keep)
        z = [(F.col(c) - F.lit(float(m))) / F.lit(float(s)) for c, m, s in zip(self.columns, self.mean, self.std)]
        return data.select(*keep, *[
            add(F.lit(float(w)) * x for w, x in zip(self.loadings[i], z)).alias(f"pc{i + 1}") for i in range(count)
        ])


def fit_components(df: DataFrame, columns: Sequence[str]) -> Components:
    """Principal components from one covariance pass; only p x p numbers reach the driver.

    The sign of a component makes its largest loading positive.
    """
    if len(columns) < 2:
        raise ValueError("at least two variables are needed")
    n, mean, cov = covariance(df, columns)
    if n < 5:
        raise ValueError("at least 5 complete rows are needed")
    std = np.sqrt(np.diag(cov) * (n - 1) / n)
    std[std == 0] = 1.0
    values, vectors = np.linalg.eigh(cov / np.outer(std, std))
    order = np.argsort(values)[::-1][: min(len(columns), n - 1)]
    values, loadings = np.maximum(values[order], 0.0), vectors[:, order].T
    for row in loadings:
        if row[np.argmax(np.abs(row))] < 0:
            row *= -1
    cumulative = np.cumsum(values) / values.sum()
    kaiser = int((values > 1).sum())
    n80, n90 = (int(np.argmax(cumulative >= level - 1e-12)) + 1 for level in (0.80, 0.90))
    recommended = min(max(kaiser, n80), len(values))
    return Components(list(columns), n, mean, std, values, loadings, kaiser, n80, n90, recommended)


def group_separation(df: DataFrame, columns: Sequence[str], flag: str = "is_outlier") -> DataFrame:
    """One row: group centroids in the first two components and their distances.

    Mahalanobis uses the pooled covariance; separation is high above 3, moderate
    above 1.5. Counts before and after leaving out incomplete rows are included.
    """
    fitted = fit_components(df, columns)
    groups = {
        r["is_outlier"]: r
        for r in fitted.scores(df.withColumnRenamed(flag, "is_outlier"), ["is_outlier"], 2)
        .groupBy("is_outlier")
        .agg(
            F.count("*").alias("n"), F.avg("pc1").alias("m1"), F.avg("pc2").alias("m2"),
            F.var_samp("pc1").alias("v1"), F.var_samp("pc2").alias("v2"), F.covar_samp("pc1", "pc2").alias("c"),
        )
        .collect()
    }
    before = {r[0]: r[1] for r in df.groupBy(flag).count().collect()}
    a, b = groups.get(True), groups.get(False)
    centre = {k: (g["m1"], g["m2"]) if g else (0.0, 0.0) for k, g in ((True, a), (False, b))}
    gap = np.array(centre[True]) - np.array(centre[False])
    mahalanobis = None
    if a and b and a["n"] + b["n"] > 2:
        pooled = sum(
            (g["n"] - 1) * np.array([[g["v1"] or 0.0, g["c"] or 0.0], [g["c"] or 0.0, g["v2"] or 0.0]]) for g in (a, b)
        ) / (a["n"] + b["n"] - 2)
        if np.linalg.det(pooled) > 0:
            mahalanobis = float(np.sqrt(gap @ np.linalg.inv(pooled) @ gap))
    distance = float(np.hypot(*gap))
    measured = distance if mahalanobis is None else mahalanobis
    label = "high" if measured > 3 else "moderate" if measured > 1.5 else "low"
    return df.sparkSession.createDataFrame(
        [(
            before.get(True, 0), before.get(False, 0), a["n"] if a else 0, b["n"] if b else 0,
            *map(float, (*centre[True], *centre[False])), distance, mahalanobis, label,
        )],
        "outliers_before long, normals_before long, outliers long, normals long, outlier_pc1 double, outlier_pc2 double, "
        "normal_pc1 double, normal_pc2 double, distance double, mahalanobis double, separation string",
    )
