"""Survival curves, log-rank test and a one-covariate Cox model on folded event tables."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from ..functions import special
from ..functions.columns import number, scalar_function
from ..functions.lineage import cut_lineage
from ..functions.rank import TASK_ROWS, ranked_counts


def survival_pairs(
    df: DataFrame, time: str, event: str, flag: str = "is_outlier", event_value=None
) -> DataFrame:
    """(is_outlier, time, event) of complete rows, checked.

    event is boolean, 0/1, or text with event_value naming the event.
    """
    kind = df.schema[event].dataType
    if event_value is not None:
        happened = F.col(event) == F.lit(event_value)
    elif isinstance(kind, T.BooleanType):
        happened = F.col(event)
    elif isinstance(kind, T.NumericType):
        happened = F.col(event) == 1
    else:
        raise ValueError("name the event of a text column with event_value")
    numeric = event_value is None and isinstance(kind, T.NumericType)
    wrong = F.count_if(~F.col(event).isin(0, 1)) if numeric else F.lit(0)
    present = df.where(number(time).isNotNull() & F.col(event).isNotNull() & F.col(flag).isNotNull())
    facts = present.agg(
        F.count("*").alias("n"), F.count_if(F.col(flag)).alias("outliers"),
        F.count_if(number(time) <= 0).alias("not_positive"), wrong.alias("wrong"),
        F.count_distinct(event).alias("values"),
    ).first()
    if facts["wrong"]:
        raise ValueError("a numeric event column may only hold 0 and 1")
    if event_value is not None and facts["values"] != 2:
        raise ValueError("a text event column needs exactly two values")
    if facts["not_positive"]:
        raise ValueError("times must be positive")
    if facts["n"] < 10:
        raise ValueError("at least 10 complete rows are needed")
    if min(facts["outliers"], facts["n"] - facts["outliers"]) < 3:
        raise ValueError("each group needs at least 3 rows")
    return present.select(
        F.col(flag).alias("is_outlier"), number(time).alias("time"), happened.cast("long").alias("event")
    )


def kaplan_meier(pairs: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """is_outlier, time, at_risk, events, survival; a first point at time 0 with survival 1."""
    counts = pairs.groupBy("is_outlier", "time").agg(
        F.count("*").alias("cnt"), F.sum("event").alias("events")
    )
    at_risk = ranked_counts(counts, ["is_outlier"], "time", ["events"], task_rows).select(
        "is_outlier", "time", "cnt", "events", (F.col("n") - F.col("below")).alias("at_risk"), "n"
    )
    # The product of (at risk - events) / at risk telescopes: where nobody is censored, what is left of one
    # time is at risk at the next. So the curve is a ratio of counts, exact without censoring, times a running
    # sum of logs over the censored alone. The last time has no successor and no factor.
    left = F.col("at_risk") - F.col("events")
    censored = F.col("cnt") - F.col("events")
    logs = at_risk.withColumn("log_step", F.when(left > censored, F.log1p(-censored / left)).otherwise(0.0))
    running = ranked_counts(logs, ["is_outlier"], "time", ["events", "log_step"], task_rows)
    survived = (F.col("n") - F.col("below") - F.col("events")) / F.col("n") * F.exp(-F.col("below_log_step"))
    curve = running.select(
        "is_outlier", "time", (F.col("n") - F.col("below")).alias("at_risk"), "events", survived.alias("survival")
    )
    start = counts.groupBy("is_outlier").agg(F.sum("cnt").alias("at_risk")).select(
        "is_outlier", F.lit(0.0).alias("time"), "at_risk", F.lit(0).cast("long").alias("events"), F.lit(1.0).alias("survival")
    )
    return start.unionByName(curve)


def median_survival(curve: DataFrame) -> DataFrame:
    """First time at which survival is at most one half (within rounding), NULL if it never is."""
    return curve.groupBy("is_outlier").agg(
        F.min(F.when(F.col("survival") <= 0.5 * (1 + 1e-12), F.col("time"))).alias("median_survival")
    )


def risk_table(pairs: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """Event times of both groups together: time, d1, d0 (events), n1, n0 (at risk)."""
    one = F.col("is_outlier").cast("long")
    counts = pairs.groupBy("time").agg(
        F.count("*").alias("cnt"), F.sum(one).alias("c1"),
        F.sum(F.col("event") * one).alias("d1"), F.sum(F.col("event") * (1 - one)).alias("d0"),
    )
    total1 = pairs.agg(F.sum(one)).first()[0]
    ranked = ranked_counts(counts.withColumn("all_rows", F.lit(0)), ["all_rows"], "time", ["c1", "d1", "d0"], task_rows)
    n1 = F.lit(total1) - F.col("below_c1")
    return ranked.where(F.col("d1") + F.col("d0") > 0).select(
        "time", "d1", "d0", n1.alias("n1"), (F.col("n") - F.col("below") - n1).alias("n0")
    )


def log_rank(pairs: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """One row: observed and expected outlier events, chi-square (1 dof) and p."""
    d = F.col("d1") + F.col("d0")
    n = (F.col("n1") + F.col("n0")).cast("double")
    share = F.col("n1") / n
    variance = F.when(n > 1, d * share * (1 - share) * (n - d) / (n - 1)).otherwise(0.0)
    sums = risk_table(pairs, task_rows).agg(
        F.sum("d1").alias("observed"), F.sum(d * share).alias("expected"), F.sum(variance).alias("variance")
    )
    chi2 = (F.col("observed") - F.col("expected")) ** 2 / F.col("variance")
    return sums.withColumn("chi2", chi2).withColumn(
        "p_value", scalar_function(lambda x: special.chi2_sf(x, 1.0), F.col("chi2"))
    )


def cox_outlier(
    pairs: DataFrame, min_events: int = 5, tolerance: float = 1e-9, rounds: int = 50, task_rows: int = TASK_ROWS
) -> DataFrame:
    """Hazard ratio of outliers by Newton's method with Efron's treatment of ties.

    The risk table is materialised once; every step is one small sum over it.
    Efron's inner sums over tied events are closed forms (polygamma functions), so
    a time shared by a third of all rows costs no more than any other.
    """
    schema = "coef double, se double, hazard_ratio double, ci_low double, ci_high double, z double, p_value double"
    table = cut_lineage(risk_table(pairs, task_rows))
    spark = table.sparkSession
    events = table.agg(F.sum(F.col("d1") + F.col("d0"))).first()[0] or 0
    if events < min_events:
        return spark.createDataFrame([], schema)

    def derivatives(beta: float):
        theta = math.exp(beta)

        def part(batches):
            for pdf in batches:
                d1, d0, n1, n0 = (pdf[c].to_numpy(float) for c in ("d1", "d0", "n1", "n0"))
                d = d1 + d0
                a, b = n1 * theta, d1 * theta / d
                r, s = n0 + n1 * theta, (d0 + d1 * theta) / d
                upper, lower = r / s + 1.0, np.maximum(r / s - d + 1.0, 1.0)
                s1 = (special.digamma(upper) - special.digamma(lower)) / s
                s2 = (special.trigamma(lower) - special.trigamma(upper)) / (s * s)
                ratio = b / s
                k = a - ratio * r
                total = d * ratio + k * s1
                squares = d * ratio**2 + 2 * ratio * k * s1 + k * k * s2
                yield pd.DataFrame({"score": [float((d1 - total).sum())], "info": [float((total - squares).sum())]})

        row = table.mapInPandas(part, "score double, info double").agg(F.sum("score"), F.sum("info")).first()
        return row[0], row[1]

    beta = 0.0
    for _ in range(rounds):
        score, info = derivatives(beta)
        if not info or info <= 0:
            return spark.createDataFrame([], schema)
        step = max(-2.0, min(2.0, score / info))
        beta += step
        if abs(step) < tolerance:
            break
    _, info = derivatives(beta)
    se = 1.0 / math.sqrt(info)
    z = beta / se
    width = special.norm_ppf(0.975) * se
    return spark.createDataFrame(
        [(beta, se, math.exp(beta), math.exp(beta - width), math.exp(beta + width), z, 2 * special.norm_sf(abs(z)))],
        schema,
    )
