"""Hypothesis-test detectors (Grubbs, Dixon; Rosner is in its own module) and the normality test behind them."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import special
from ..functions.columns import melt, number, scalar_function
from ..functions.lineage import broadcast_if_small
from ..functions.rank import TASK_ROWS, ranked_values
from .rosner import fit_rosner, rosner_report  # noqa: F401
from .univariate import moments

# Dixon's critical Q for n = 3..30 at three significance levels.
DIXON_CRITICAL = {
    0.01: [
        0.988, 0.889, 0.780, 0.698, 0.637, 0.590, 0.555, 0.527, 0.502, 0.482, 0.465, 0.450, 0.438, 0.426,
        0.416, 0.407, 0.399, 0.391, 0.384, 0.378, 0.372, 0.367, 0.362, 0.357, 0.353, 0.349, 0.345, 0.341,
    ],
    0.05: [
        0.941, 0.765, 0.642, 0.560, 0.507, 0.468, 0.437, 0.412, 0.392, 0.376, 0.361, 0.349, 0.338, 0.329,
        0.320, 0.313, 0.306, 0.300, 0.295, 0.290, 0.285, 0.281, 0.277, 0.273, 0.269, 0.266, 0.263, 0.260,
    ],
    0.10: [
        0.886, 0.679, 0.557, 0.484, 0.434, 0.399, 0.370, 0.349, 0.332, 0.318, 0.305, 0.295, 0.286, 0.278,
        0.271, 0.265, 0.259, 0.254, 0.249, 0.245, 0.241, 0.238, 0.235, 0.232, 0.229, 0.227, 0.224, 0.222,
    ],
}

# Anderson-Darling points for a normal with estimated parameters,
# before the sample-size factor, and their significance levels.
ANDERSON_POINTS = ((0.15, 0.576), (0.10, 0.656), (0.05, 0.787), (0.025, 0.918), (0.01, 1.092))

# With test="by-size", samples up to this size are tested by Shapiro-Wilk, larger ones by Anderson-Darling.
SHAPIRO_LIMIT = 50
TESTS = ("anderson-darling", "shapiro-wilk", "by-size")


# ---------------------------------------------------------------- normality


def anderson_darling(df: DataFrame, columns: Sequence[str], task_rows: int = TASK_ROWS) -> DataFrame:
    """A-squared against a fitted normal per variable: variable, n, statistic.

    Copies of a value share one term (the rank weights of ties add up in closed
    form), so only distinct values are evaluated.
    """
    return anderson_groups(melt(df, columns), ["variable"], task_rows)


def anderson_groups(long: DataFrame, keys: Sequence[str], task_rows: int = TASK_ROWS) -> DataFrame:
    """anderson_darling() for every group of (keys..., x); a group is one named variable or a part of one."""
    keys = list(keys)
    stats = long.groupBy(*keys).agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"))
    ranked = ranked_values(long, keys, "x", task_rows).join(F.broadcast(stats), keys)

    @F.pandas_udf("double")
    def log_cdf(z: pd.Series) -> pd.Series:
        return pd.Series(special.log_norm_cdf(z.to_numpy()))

    z = (F.col("x") - F.col("mean")) / F.col("std")
    b, c, n = F.col("below").cast("double"), F.col("cnt").cast("double"), F.col("n").cast("double")
    left = (b + c) * (b + c) - b * b
    right = (n - b) * (n - b) - (n - b - c) * (n - b - c)
    terms = ranked.where(F.col("std") > 0).withColumns({"log_left": log_cdf(z), "log_right": log_cdf(-z)})
    return terms.groupBy(*keys, "n").agg(
        (-F.col("n") - F.sum(left * F.col("log_left") + right * F.col("log_right")) / F.col("n")).alias("statistic")
    )


def anderson_p(statistic: Column, n: Column) -> Column:
    """Largest tabled level whose point the statistic stays below, 0.001 beyond the last."""
    n = n.cast("double")
    shrink = 1.0 + 4.0 / n - 25.0 / n / n
    p = F.lit(0.001)
    for level, point in reversed(ANDERSON_POINTS):
        p = F.when(statistic < F.round(F.lit(point) / shrink, 3), level).otherwise(p)
    return p


def shapiro_wilk(df: DataFrame, columns: Sequence[str], task_rows: int = TASK_ROWS) -> DataFrame:
    """Royston's W and p per variable with at least 3 values: variable, n, statistic, p_value.

    The weight of a value is the sum of the normal scores of its ranks, taken in closed
    form, so copies of a value are one row and no variable is gathered. Without spread
    both are 1.
    """
    long = melt(df, columns)
    means = long.groupBy("variable").agg(F.avg("x").alias("mean"))

    @F.pandas_udf("double")
    def scores(below: pd.Series, cnt: pd.Series, n: pd.Series) -> pd.Series:
        out = np.zeros(len(n))
        for size in n.unique():
            mine = (n == size).to_numpy()
            b, c = below.to_numpy()[mine], cnt.to_numpy()[mine]
            out[mine] = special.score_sums(b + c, int(size)) - special.score_sums(b, int(size))
        return pd.Series(out)

    ranked = ranked_values(long, ["variable"], "x", task_rows).join(F.broadcast(means), "variable")
    x, b, c, n = (F.col(name) for name in ("x", "below", "cnt", "n"))
    away = x - F.col("mean")  # scores sum to 0, so the mean may go

    def at(rank: Column) -> Column:
        return F.max(F.when((b < rank) & (b + c >= rank), x))

    sums = ranked.where(n >= 3).groupBy("variable", "n").agg(
        F.sum(scores(b, c, n) * away).alias("scored"), (F.max("x") - F.min("x")).alias("outer_gap"),
        (at(n - 1) - at(F.lit(2))).alias("second_gap"), F.sum(c * away * away).alias("squares"),
    )
    w = scalar_function(special.shapiro_w, F.col("n").cast("double"), F.col("scored"), F.col("outer_gap"), F.col("second_gap"), F.col("squares"))
    return sums.select("variable", "n", w.alias("statistic")).select(
        "variable", "n", "statistic", scalar_function(special.shapiro_p, F.col("statistic"), F.col("n").cast("double")).alias("p_value")
    )


def normality(
    df: DataFrame, columns: Sequence[str], alpha: float = 0.05, task_rows: int = TASK_ROWS, test: str = TESTS[0]
) -> DataFrame:
    """Per variable: test, n, statistic, p_value, is_normal. Variables under 3 values have none.

    Both tests read ranks of folded values, see ``anderson_darling`` and ``shapiro_wilk``.
    """
    if test not in TESTS:
        raise ValueError(f"unknown test: {test}")
    stats = moments(df, columns)
    tested = [c for c in columns if stats[c]["n"] >= 3]
    small = [c for c in tested if test == "shapiro-wilk" or test == "by-size" and stats[c]["n"] <= SHAPIRO_LIMIT]
    large = [c for c in tested if c not in small]
    parts = []
    if large:
        parts.append(
            anderson_darling(df, large, task_rows).select(
                "variable", F.lit("anderson-darling").alias("test"), "n", "statistic",
                anderson_p(F.col("statistic"), F.col("n")).alias("p_value"),
            )
        )
    if small:
        parts.append(shapiro_wilk(df, small, task_rows).select("variable", F.lit("shapiro-wilk").alias("test"), "n", "statistic", "p_value"))
    if not parts:
        return df.sparkSession.createDataFrame(
            [], "variable string, test string, n long, statistic double, p_value double, is_normal boolean"
        )
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result.withColumn("is_normal", F.col("p_value") > alpha)


def mostly_normal(
    df: DataFrame, columns: Sequence[str], alpha: float = 0.05, task_rows: int = TASK_ROWS, test: str = TESTS[0]
) -> DataFrame:
    """One row: whether at least 60 % of the variables pass the normality test."""
    tested = normality(df, columns, alpha, task_rows, test)
    return tested.agg(
        F.count("*").alias("variables"), F.count_if("is_normal").alias("normal_variables")
    ).select(
        "variables", "normal_variables",
        F.when(F.col("variables") > 0, F.round(100.0 * F.col("normal_variables") / F.col("variables"), 1))
        .alias("normal_percent"),
        ((F.col("variables") > 0) & (F.col("normal_variables") >= 0.6 * F.col("variables"))).alias("is_normal"),
    )


# ---------------------------------------------------------------- Grubbs


def _grubbs_p(g: float, n: float) -> float:
    """One-sided tail times n, at t = G sqrt(n / (n - 2 + G^2))."""
    t = g * math.sqrt(n / (n - 2 + g * g))
    return max(0.0, min(1.0, n * special.t_sf(t, n - 2)))


def _grubbs_p_standard(g: float, n: float) -> float:
    """Bonferroni p of the two-sided test by the exact inversion of G to t."""
    rest = (n - 1) ** 2 - n * g * g
    if rest <= 0:
        return 0.0
    return min(1.0, 2.0 * n * special.t_sf(math.sqrt(n * (n - 2) * g * g / rest), n - 2))


def grubbs(df: DataFrame, columns: Sequence[str], row_id: str, alpha: float = 0.05) -> DataFrame:
    """The most extreme row of every variable and its Grubbs test.

    Two passes over all variables at once: moments, then the row furthest from the
    mean (ties: smallest row_id). Variables under 3 values or without variation
    are left out.
    """
    stats = moments(df, columns)
    usable = [c for c in columns if stats[c]["n"] >= 3 and stats[c]["std"]]
    schema = (
        f"variable string, {row_id} {df.schema[row_id].dataType.simpleString()}, value double, side string, g double, "
        "critical double, p_value double, p_value_standard double, is_outlier boolean, n long, mean double, std double"
    )
    if not usable:
        return df.sparkSession.createDataFrame([], schema)
    extreme = df.agg(*[
        F.min_by(
            F.struct(F.col(row_id).alias("id"), number(c).alias("x")),
            F.when(number(c).isNotNull(), F.struct(-F.abs(number(c) - F.lit(stats[c]["mean"])), F.col(row_id))),
        ).alias(f"c{i}")
        for i, c in enumerate(usable)
    ]).first()
    rows = []
    for i, c in enumerate(usable):
        n, mean, std = stats[c]["n"], stats[c]["mean"], stats[c]["std"]
        value = extreme[f"c{i}"]["x"]
        g = abs(value - mean) / std
        critical = special.grubbs_critical(n, alpha)
        rows.append((
            c, extreme[f"c{i}"]["id"], value, "max" if value > mean else "min", g, critical, _grubbs_p(g, n),
            _grubbs_p_standard(g, n), g > critical, n, mean, std,
        ))
    return df.sparkSession.createDataFrame(rows, schema)


def grubbs_report(
    df: DataFrame, columns: Sequence[str], row_id: str, alpha: float = 0.05, task_rows: int = TASK_ROWS,
    test: str = TESTS[0],
) -> DataFrame:
    """grubbs() with the normality test of each variable."""
    tested = normality(df, columns, alpha, task_rows, test).select(
        "variable", F.col("test").alias("normality_test"), F.col("p_value").alias("normality_p"), "is_normal"
    )
    return grubbs(df, columns, row_id, alpha).join(tested, "variable", "left")


# ---------------------------------------------------------------- Dixon


def _dixon_levels(n: Column, alpha: float) -> Column:
    known = [a for a in DIXON_CRITICAL if abs(a - alpha) < 0.001]
    values = DIXON_CRITICAL[known[0] if known else 0.05]
    return F.element_at(F.array(*[F.lit(v) for v in values]), (n - 2).cast("int"))


def dixon_p(q: Column, n: Column) -> Column:
    """p interpolated between the tabled levels; between half the 10 % point and it, from 1 down to 0.1."""
    strict, usual, loose = (_dixon_levels(n, a) for a in (0.01, 0.05, 0.10))
    return (
        F.when(q >= strict * 1.2, 0.001)
        .when(q >= strict, F.greatest(F.lit(0.0001), 0.01 - (q - strict) / (strict * 0.2) * 0.009))
        .when(q >= usual, 0.05 - (q - usual) / (strict - usual) * 0.04)
        .when(q >= loose, 0.10 - (q - loose) / (usual - loose) * 0.05)
        .when(q <= loose * 0.5, 1.0)
        .otherwise(1.0 - (q - loose * 0.5) / (loose * 0.5) * 0.90)
    )


def dixon(df: DataFrame, by: Sequence[str], column: str, row_id: str, alpha: float = 0.05) -> DataFrame:
    """Dixon's Q at both ends of every group of 3 to 30 rows.

    Returns by..., side, row_id, value, q, critical, p_value, is_outlier, n, status. The
    table of critical values ends at 30: a group outside 3 to 30 rows, or without
    spread, has one row with a status and no q. Groups are counted before any is
    gathered, so gathered groups are at most 30 rows.
    """
    by = list(by)
    data = df.select(F.lit(0).alias("_all"), *by, F.col(row_id).alias("_id"), number(column).alias("_x")).where(
        F.col("_x").isNotNull()
    )
    keys = ["_all", *by]
    sizes = data.groupBy(*keys).agg(F.count("*").alias("n"), F.max("_x").alias("hi"), F.min("_x").alias("lo"))
    fits = F.col("n").between(3, 30) & (F.col("hi") > F.col("lo"))
    fitting = sizes.where(fits).select(*keys)
    kinds = df.schema[row_id].dataType.simpleString()
    other = sizes.where(~fits).select(
        *by, F.lit(None).cast("string").alias("side"), F.lit(None).cast(kinds).alias(row_id),
        *[F.lit(None).cast("double").alias(c) for c in ("value", "q", "critical", "p_value")],
        F.lit(False).alias("is_outlier"), "n",
        F.when(F.col("n") > 30, "more than 30 rows").when(F.col("n") < 3, "under 3 rows").otherwise("no spread").alias("status"),
    )
    groups = (
        data.join(broadcast_if_small(fitting), keys, "left_semi")
        .groupBy(*keys)
        .agg(
            F.count("*").alias("n"),
            F.array_sort(F.collect_list(F.struct("_x", "_id"))).alias("up"),
        )
    )
    n = F.col("n").cast("int")

    def x(i: Column) -> Column:
        return F.element_at("up", i)["_x"]

    def row(i: Column) -> Column:
        return F.element_at("up", i)["_id"]

    one, two = F.lit(1), F.lit(2)
    spread = x(n) - x(one)
    ends = groups.where(spread > 0).select(
        *by, "n",
        F.explode(F.array(
            F.struct(F.lit("min").alias("side"), row(one).alias(row_id), x(one).alias("value"), ((x(two) - x(one)) / spread).alias("q")),
            F.struct(F.lit("max").alias("side"), row(n).alias(row_id), x(n).alias("value"), ((x(n) - x(n - 1)) / spread).alias("q")),
        )).alias("end"),
    ).select(*by, "n", "end.*")
    critical = _dixon_levels(F.col("n"), alpha)
    return ends.select(
        *by, "side", row_id, "value", "q", critical.alias("critical"), dixon_p(F.col("q"), F.col("n")).alias("p_value"),
        (F.col("q") > critical).alias("is_outlier"), "n", F.lit("tested").alias("status"),
    ).unionByName(other)
