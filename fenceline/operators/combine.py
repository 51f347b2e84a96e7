"""Combining detector votes into the final outlier set."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import add

MULTIVARIATE = ("mahalanobis", "lof", "isolation_forest")
HYPOTHESIS = ("grubbs", "dixon", "rosner")
STRATEGIES = ("voting", "adaptive", "union", "intersection")


def final_verdict(
    strategy: str, uni_score: Column, mahalanobis: Column, lof: Column, isolation_forest: Column,
    hypothesis: Column, data_is_normal: bool = False, min_univariate: int = 2, min_multivariate: int = 1,
) -> Column:
    """Boolean verdict of one row under a combination strategy.

    uni_score is the number of variables two univariate detectors agree on; a
    hypothesis-test flag always decides for outlier.
    """
    votes = add(f.cast("int") for f in (mahalanobis, lof, isolation_forest))
    any_multi = mahalanobis | lof | isolation_forest
    both = lof & isolation_forest
    if strategy == "voting":
        return hypothesis | (votes >= min_multivariate) | (uni_score >= min_univariate)
    if strategy == "union":
        return hypothesis | any_multi | (uni_score >= 1)
    if strategy == "intersection":
        return hypothesis | (any_multi & (uni_score >= 1))
    if strategy == "adaptive" and data_is_normal:
        return (
            F.when(hypothesis, True)
            .when(mahalanobis, uni_score >= 1)
            .otherwise(both | (uni_score >= 2))
        )
    if strategy == "adaptive":
        return hypothesis | both | (uni_score >= 2) | ((lof | isolation_forest) & (uni_score >= 1))
    raise ValueError(f"unknown strategy: {strategy}")


def outlier_metrics(df: DataFrame, flag: str = "is_outlier") -> DataFrame:
    """One row: total, outliers, normal and the outlier percentage with one decimal."""
    return df.agg(F.count("*").alias("total"), F.count_if(F.col(flag)).alias("outliers")).select(
        "total", "outliers", (F.col("total") - F.col("outliers")).alias("normal"),
        F.when(F.col("total") > 0, F.round(100.0 * F.col("outliers") / F.col("total"), 1))
        .otherwise(0.0).alias("percent"),
    )


def method_counts(df: DataFrame, methods: Sequence[str], flag: str = "is_outlier") -> DataFrame:
    """Rows flagged per method and finally, with the share of all rows and a warning above half.

    A method that did not run, null throughout, has null for all of them.
    """
    names = [*methods, flag]
    ran = {m: (F.count(m) > 0) | (F.count("*") == 0) for m in names}
    row = df.agg(F.count("*").alias("total"), *[F.when(ran[m], F.count_if(F.col(m))).alias(m) for m in names])
    entries = [
        F.struct(F.lit("final" if m == flag else m).alias("method"), F.col(m).alias("flagged"), F.col("total"))
        for m in names
    ]
    percent = F.round(100.0 * F.col("flagged") / F.col("total"), 2)
    return row.select(F.inline(F.array(*entries))).select(
        "method", "flagged", "total", percent.alias("percent"), (percent > 50).alias("too_many"),
    )


def vote_detail(df: DataFrame, row_id: str, methods: Sequence[str], flag: str = "is_outlier") -> DataFrame:
    """Votes of every final outlier with totals per family of methods; a method that did not run is null and has no vote."""
    uni = [m for m in methods if m in ("iqr", "zscore", "mad")]
    multi = [m for m in methods if m in MULTIVARIATE]
    hyp = [m for m in methods if m in HYPOTHESIS]

    def total(names):
        return add(F.coalesce(F.col(m).cast("int"), F.lit(0)) for m in names) if names else F.lit(0)

    return df.where(F.col(flag)).select(
        row_id, *methods, total(uni).alias("univariate_votes"), total(multi).alias("multivariate_votes"),
        total(hyp).alias("hypothesis_votes"),
        (total(uni) + total(multi) + total(hyp)).alias("total_votes"),
    )
