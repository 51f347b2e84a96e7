"""Full outlier detection: all detectors, one combination rule, votes and counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import any_of, number
from ..functions.rank import TASK_ROWS
from ..operators import combine, multivariate, outlier_tests, univariate

UNIVARIATE = ("iqr", "zscore", "mad")
ALL_METHODS = (*UNIVARIATE, *combine.MULTIVARIATE, *combine.HYPOTHESIS)


def detect_outliers(
    df: DataFrame, columns: Sequence[str], row_id: str, methods: Sequence[str] = ALL_METHODS,
    strategy: str = "voting", min_univariate: int = 2, min_multivariate: int = 1,
    factor: float = univariate.FACTOR, z_threshold: float = 3.0, mad_threshold: float = 3.0,
    mahalanobis_threshold: float = 3.0, contamination: float = 0.05, alpha: float = 0.05,
    task_rows: int = TASK_ROWS, size_rule: bool = False,
) -> DataFrame:
    """df with one boolean column per method, uni_score and is_outlier.

    Only complete rows can be final outliers. A method that did not run (switched off, or
    dixon where no variable has 3 to 30 values) is null and decides nothing. Everything
    but the two ranking detectors (lof, isolation_forest) is a filter-like expression
    over literals.
    """
    columns, methods = list(columns), set(methods)
    unknown = methods - set(ALL_METHODS)
    if unknown:
        raise ValueError(f"unknown methods: {sorted(unknown)}")
    names = df.columns
    stats = univariate.moments(df, columns)
    fits: dict[str, dict] = {}
    quartiles = univariate.fit_quartiles(df, columns, stats, task_rows) if methods & {"iqr", "mad"} else None
    if "iqr" in methods:
        fits["iqr"] = univariate.fit_iqr(df, columns, factor, stats, task_rows, size_rule, quartiles)
    if "zscore" in methods:
        fits["zscore"] = univariate.fit_zscore(df, columns, z_threshold, stats)
    if "mad" in methods:
        fits["mad"] = univariate.fit_mad(df, columns, mad_threshold, stats, task_rows, quartiles)

    def by_variable(method: str, c: str) -> Column:
        return fits[method][c].flag(c) if method in fits else F.lit(False)

    votes = F.lit(0)
    for c in columns:
        agreeing = F.lit(0)
        for m in UNIVARIATE:
            agreeing = agreeing + by_variable(m, c).cast("int")
        votes = votes + (agreeing >= 2).cast("int")
    off = F.lit(None).cast("boolean")
    flags: dict[str, Column] = {m: any_of(by_variable(m, c) for c in columns) if m in methods else off for m in UNIVARIATE}
    flags.update(_hypothesis_flags(df, columns, row_id, methods, alpha, stats))
    flags["uni_score"] = votes
    result = df.withColumns(flags)

    if "mahalanobis" in methods:
        result = multivariate.mahalanobis(result, columns, mahalanobis_threshold).drop("mahalanobis_distance")
    if "lof" in methods:
        result = multivariate.lof(result, columns, row_id, contamination=contamination, task_rows=task_rows).drop("lof_score")
    if "isolation_forest" in methods:
        result = multivariate.isolation_forest(
            result, columns, row_id, contamination, task_rows=task_rows
        ).drop("isolation_forest_score")
    result = result.withColumns({m: off for m in combine.MULTIVARIATE if m not in methods})

    normal = False
    if strategy == "adaptive":
        normal = bool(outlier_tests.mostly_normal(df, columns, 0.05, task_rows).first()["is_normal"])
    complete = F.lit(True)
    for c in columns:
        complete = complete & number(c).isNotNull()

    def said(m: str) -> Column:
        return F.coalesce(F.col(m), F.lit(False))

    verdict = combine.final_verdict(
        strategy, F.col("uni_score"), said("mahalanobis"), said("lof"), said("isolation_forest"),
        any_of(said(m) for m in combine.HYPOTHESIS), normal, min_univariate, min_multivariate,
    )
    return result.withColumn("is_outlier", verdict & complete).select(
        *names, *ALL_METHODS, "uni_score", "is_outlier"
    )


def _hypothesis_flags(
    df: DataFrame, columns: Sequence[str], row_id: str, methods: set[str], alpha: float, stats: dict
) -> dict[str, Column]:
    off = F.lit(None).cast("boolean")
    flags = {m: off for m in combine.HYPOTHESIS}
    if "grubbs" in methods:  # at most one row per variable
        hits = [r[row_id] for r in outlier_tests.grubbs(df, columns, row_id, alpha).where("is_outlier").collect()]
        flags["grubbs"] = F.col(row_id).isin(hits) if hits else F.lit(False)
    small = [c for c in columns if 3 <= stats[c]["n"] <= 30]
    if "dixon" in methods and small:  # only variables of at most 30 values, two rows each
        hits = [r[row_id] for c in small for r in outlier_tests.dixon(df, [], c, row_id, alpha).where("is_outlier").collect()]
        flags["dixon"] = F.col(row_id).isin(hits) if hits else F.lit(False)
    if "rosner" in methods:
        flags["rosner"] = any_of(outlier_tests.fit_rosner(df, c, row_id, None, alpha).flag() for c in columns)
    return flags


def detection_counts(detected: DataFrame) -> DataFrame:
    """Rows flagged per method and finally, with percentages and a warning above half."""
    return combine.method_counts(detected, ALL_METHODS)


def detection_votes(detected: DataFrame, row_id: str) -> DataFrame:
    """Votes of every final outlier."""
    return combine.vote_detail(detected, row_id, ALL_METHODS)


def dataset_overview(df: DataFrame, columns: Sequence[str], row_id: str, task_rows: int = TASK_ROWS) -> DataFrame:
    """Outlier counts per variable (fences, z-score) and one line for the isolation forest on all variables."""
    from ..operators.explore import detector_counts

    each = detector_counts(df, columns, task_rows).select(
        "variable", "iqr_count", "zscore_count", F.lit(None).cast("long").alias("forest_count"),
        "iqr_percent", "zscore_percent", F.lit(None).cast("double").alias("forest_percent"), "total_values",
    )
    forest = multivariate.isolation_forest(df, columns, row_id, task_rows=task_rows).agg(
        F.count_if("isolation_forest").alias("forest_count"), F.count("*").alias("total_values")
    )
    everything = forest.select(
        F.lit("all variables").alias("variable"), F.lit(None).cast("long").alias("iqr_count"),
        F.lit(None).cast("long").alias("zscore_count"), "forest_count",
        F.lit(None).cast("double").alias("iqr_percent"), F.lit(None).cast("double").alias("zscore_percent"),
        (100.0 * F.col("forest_count") / F.col("total_values")).alias("forest_percent"), "total_values",
    )
    return each.unionByName(everything)
