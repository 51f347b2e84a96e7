"""Univariate detectors: quartile fences, z-score and median absolute deviation.

Each detector is fitted to the table by aggregates (a few numbers per variable)
and then is a plain Column expression, so flagging adds no shuffle and stays in
generated code.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import add, any_of, melt, number, numbers
from ..functions.lineage import broadcast_if_small
from ..functions.rank import TASK_ROWS, column_quantiles, group_quantiles

# Fixed value: makes the MAD comparable to a standard deviation.
MAD_SCALE = 1.4826

# Fence factor unless another or the size rule is asked for.
FACTOR = 1.5


def dynamic_factor(n: int) -> float:
    """Fence factor by sample size: wider fences for small samples."""
    return 3.0 if n < 100 else 2.0 if n < 1000 else 1.5


@dataclass(frozen=True)
class Limits:
    """Values strictly outside [low, high] are outliers; None flags nothing."""

    low: float | None
    high: float | None

    def flag(self, column: str) -> Column:
        if self.low is None or self.high is None:
            return F.lit(False)
        x = number(column)
        return F.coalesce((x < self.low) | (x > self.high), F.lit(False))

    def rows(self, df: DataFrame, column: str) -> DataFrame:
        """Only the outlier rows; written so that the fences reach a parquet scan."""
        if self.low is None or self.high is None:
            return df.where(F.lit(False))
        x = F.col(column)
        return df.where((x < self.low) | (x > self.high)).where(~F.isnan(x))


@dataclass(frozen=True)
class Deviation:
    """Values further than `threshold` spreads from the centre are outliers."""

    centre: float | None
    spread: float | None
    threshold: float

    def score(self, column: str) -> Column:
        if not self.spread:
            return F.lit(None).cast("double")
        return F.abs(number(column) - F.lit(self.centre)) / F.lit(self.spread)

    def flag(self, column: str) -> Column:
        if not self.spread:
            return F.lit(False)
        return F.coalesce(self.score(column) > self.threshold, F.lit(False))


def moments(df: DataFrame, columns: Sequence[str]) -> dict[str, dict]:
    """n, mean, std, min and max of every column in one pass."""
    data = numbers(df, columns)
    row = data.agg(
        *[
            F.struct(
                F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"),
                F.min(c).alias("min"), F.max(c).alias("max"),
            ).alias(c)
            for c in columns
        ]
    ).first()
    return {c: row[c].asDict() for c in columns}


def fit_quartiles(
    df: DataFrame, columns: Sequence[str], stats: dict, task_rows: int = TASK_ROWS
) -> dict[str, list[float | None]]:
    """[Q1, median, Q3] of every column, for fit_iqr() and fit_mad() together."""
    rows = max((s["n"] for s in stats.values()), default=0)
    return column_quantiles(df, columns, [0.25, 0.5, 0.75], rows, task_rows)


def fit_iqr(
    df: DataFrame, columns: Sequence[str], factor: float = FACTOR,
    stats: dict | None = None, task_rows: int = TASK_ROWS, size_rule: bool = False, quartiles: dict | None = None,
) -> dict[str, Limits]:
    """Fences Q1 - f IQR and Q3 + f IQR; with size_rule, f follows the sample size."""
    stats = stats or moments(df, columns)
    quartiles = quartiles or fit_quartiles(df, columns, stats, task_rows)
    limits = {}
    for c in columns:
        q1, _, q3 = quartiles[c]
        if q1 is None or q3 == q1:
            limits[c] = Limits(None, None)
        else:
            f = dynamic_factor(stats[c]["n"]) if size_rule else factor
            limits[c] = Limits(q1 - f * (q3 - q1), q3 + f * (q3 - q1))
    return limits


def fit_zscore(
    df: DataFrame, columns: Sequence[str], threshold: float = 3.0, stats: dict | None = None
) -> dict[str, Deviation]:
    stats = stats or moments(df, columns)
    return {c: Deviation(stats[c]["mean"], stats[c]["std"], threshold) for c in columns}


def fit_mad(
    df: DataFrame, columns: Sequence[str], threshold: float = 3.0,
    stats: dict | None = None, task_rows: int = TASK_ROWS, quartiles: dict | None = None,
) -> dict[str, Deviation]:
    stats = stats or moments(df, columns)
    rows = max((s["n"] for s in stats.values()), default=0)
    quartiles = quartiles or fit_quartiles(df, columns, stats, task_rows)
    medians = {c: q[1] for c, q in quartiles.items()}
    known = [c for c in columns if medians[c] is not None]
    mads = {}
    if known:
        distances = df.select(*[F.abs(number(c) - F.lit(medians[c])).alias(c) for c in known])
        mads = {c: q[0] for c, q in column_quantiles(distances, known, [0.5], rows, task_rows).items()}
    return {
        c: Deviation(medians[c], MAD_SCALE * mads[c] if mads.get(c) else None, threshold) for c in columns
    }


def univariate_flags(
    df: DataFrame, columns: Sequence[str], factor: float = FACTOR,
    z_threshold: float = 3.0, mad_threshold: float = 3.0, task_rows: int = TASK_ROWS, size_rule: bool = False,
) -> DataFrame:
    """df with <column>_iqr, <column>_zscore and <column>_mad flags for every column."""
    stats = moments(df, columns)
    quartiles = fit_quartiles(df, columns, stats, task_rows)
    fits = {
        "iqr": fit_iqr(df, columns, factor, stats, task_rows, size_rule, quartiles),
        "zscore": fit_zscore(df, columns, z_threshold, stats),
        "mad": fit_mad(df, columns, mad_threshold, stats, task_rows, quartiles),
    }
    return df.select(
        "*", *[fit[c].flag(c).alias(f"{c}_{name}") for c in columns for name, fit in fits.items()]
    )


def univariate_score(columns: Sequence[str], min_methods: int = 2) -> Column:
    """Number of variables that at least two of the three detectors flag in a row."""
    votes = [add(F.col(f"{c}_{m}").cast("int") for m in ("iqr", "zscore", "mad")) for c in columns]
    return add((v >= min_methods).cast("int") for v in votes)


def any_univariate(columns: Sequence[str], method: str) -> Column:
    return any_of(F.col(f"{c}_{method}") for c in columns)


def group_fences(
    df: DataFrame, by: Sequence[str], columns: Sequence[str], factor: float = FACTOR,
    task_rows: int = TASK_ROWS, size_rule: bool = False,
) -> DataFrame:
    """Quartile fences within every group: by..., variable, n, q1, q3, low, high."""
    keys = [*by, "variable"]
    sizes = melt(df, columns, by).groupBy(*keys).agg(F.count("*").alias("n"))
    quartiles = (
        group_quantiles(df, by, columns, [0.25, 0.75], task_rows)
        .groupBy(*keys)
        .agg(
            F.max(F.when(F.col("p") == 0.25, F.col("value"))).alias("q1"),
            F.max(F.when(F.col("p") == 0.75, F.col("value"))).alias("q3"),
        )
    )
    f = (
        F.when(F.col("n") < 100, 3.0).when(F.col("n") < 1000, 2.0).otherwise(1.5)
        if size_rule
        else F.lit(float(factor))
    )
    iqr = F.col("q3") - F.col("q1")
    return sizes.join(quartiles, keys).select(
        *keys, "n", "q1", "q3",
        F.when(iqr != 0, F.col("q1") - f * iqr).alias("low"),
        F.when(iqr != 0, F.col("q3") + f * iqr).alias("high"),
    )


def group_iqr_flags(
    df: DataFrame, by: Sequence[str], column: str, factor: float = FACTOR, task_rows: int = TASK_ROWS,
    size_rule: bool = False,
) -> DataFrame:
    """df with is_outlier from the fences of the row's own group."""
    fences = group_fences(df, by, [column], factor, task_rows, size_rule).select(*by, "low", "high")
    x = number(column)
    flag = F.coalesce((x < F.col("low")) | (x > F.col("high")), F.lit(False))
    joined = df.join(broadcast_if_small(fences), list(by), "left")
    return joined.select(*[joined[c] for c in df.columns], flag.alias("is_outlier"))
