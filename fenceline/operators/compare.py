"""Comparing the outlier group with the rest: descriptives and tests."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions import special
from ..functions.columns import (
    effect_label, finite, melt, melt_text, p_value_text, scalar_function, significance_code,
)
from ..functions.rank import TASK_ROWS, long_quantiles, ranked_counts
from .outlier_tests import anderson_groups, anderson_p


# Values of a variable per task when tables are simulated.
BLOCK_VALUES = 10_000


def _flagged(df: DataFrame, flag: str) -> DataFrame:
    return df.withColumn("is_outlier", F.coalesce(F.col(flag), F.lit(False)))


# ---------------------------------------------------------------- descriptives


def describe_groups(
    df: DataFrame, columns: Sequence[str], flag: str = "is_outlier", task_rows: int = TASK_ROWS
) -> DataFrame:
    """Per variable and group: n, mean, median, std, min, max, q25, q75, missing and its share.

    Statistics of an empty group are 0.
    """
    df = _flagged(df, flag)
    keys = ["variable", "is_outlier"]
    sizes = df.groupBy("is_outlier").agg(F.count("*").alias("rows"))
    names = F.explode(F.array(*[F.lit(c) for c in columns])).alias("variable")
    grid = sizes.select("is_outlier", "rows", names)
    long = melt(df, columns, ["is_outlier"])
    base = long.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"),
        F.min("x").alias("min"), F.max("x").alias("max"),
    )
    quantiles = (
        long_quantiles(long, keys, [0.25, 0.5, 0.75], task_rows)
        .groupBy(*keys)
        .agg(*[
            F.max(F.when(F.col("p") == p, F.col("value"))).alias(name)
            for p, name in ((0.25, "q25"), (0.5, "median"), (0.75, "q75"))
        ])
    )
    joined = grid.join(base, keys, "left").join(quantiles, keys, "left")
    n = F.coalesce(F.col("n"), F.lit(0))
    return joined.select(
        *keys, n.alias("n"),
        *[finite(F.col(c)).alias(c) for c in ("mean", "median", "std", "min", "max", "q25", "q75")],
        (F.col("rows") - n).alias("missing"),
        (100.0 * (F.col("rows") - n) / F.col("rows")).alias("missing_percent"),
    )


def category_proportions(df: DataFrame, columns: Sequence[str], flag: str = "is_outlier") -> DataFrame:
    """Frequency of every value per variable and group with its share of the group."""
    counts = (
        melt_text(_flagged(df, flag), columns, ["is_outlier"]).groupBy("variable", "is_outlier", "value").count()
    )
    totals = counts.groupBy("variable", "is_outlier").agg(F.sum("count").alias("total"))
    return counts.join(totals, ["variable", "is_outlier"]).select(
        "variable", "is_outlier", "value", "count", (F.col("count") / F.col("total")).alias("proportion")
    )


# ---------------------------------------------------------------- rank test


def mann_whitney(
    df: DataFrame, columns: Sequence[str], flag: str = "is_outlier", task_rows: int = TASK_ROWS
) -> DataFrame:
    """Mann-Whitney U of outliers against the rest, one row per variable.

    z and r carry no tie correction. ``method`` says where p comes from: ``exact``
    if no values are tied and the smaller group has at most 8, whatever the size of
    the other, else ``normal`` with tie and continuity correction. All variables are ranked in one distributed pass over folded
    (variable, value, count) rows.
    """
    counts = (
        melt(_flagged(df, flag), columns, ["is_outlier"])
        .groupBy("variable", "x")
        .agg(F.count("*").alias("cnt"), F.count_if("is_outlier").alias("outliers"))
    )
    cnt = F.col("cnt").cast("double")
    sums = (
        ranked_counts(counts, ["variable"], "x", ["outliers"], task_rows)
        .groupBy("variable")
        .agg(
            F.sum(F.col("outliers") * (F.col("below") + (F.col("cnt") + 1) / 2.0)).alias("rank_sum"),
            F.sum("outliers").alias("outliers_n"),
            F.sum("cnt").alias("n"),
            F.sum(cnt * cnt * cnt - cnt).alias("ties"),
        )
    )
    n1 = F.col("outliers_n").cast("double")
    n2 = (F.col("n") - F.col("outliers_n")).cast("double")
    u = F.col("rank_sum") - n1 * (n1 + 1) / 2
    z = (F.col("u") - n1 * n2 / 2) / F.sqrt(n1 * n2 * (n1 + n2 + 1) / 12)
    tested = sums.where((F.col("outliers_n") > 0) & (F.col("n") > F.col("outliers_n"))).withColumn("u", u)
    p = scalar_function(special.mann_whitney_p, F.col("u"), n1, n2, F.col("ties"))
    exact = (F.col("ties") == 0) & (F.least(n1, n2) <= special.EXACT_U_SAMPLE)
    return (
        tested.select(
            "variable", "u", z.alias("z"), (z / F.sqrt(n1 + n2)).alias("r"), p.alias("p_value"),
            F.when(exact, "exact").otherwise("normal").alias("method"),
            "outliers_n", (F.col("n") - F.col("outliers_n")).alias("normal_n"), "n",
        )
        .withColumn("significant", F.col("p_value") < 0.05)
        .withColumn("p_value_text", p_value_text(F.col("p_value")))
        .withColumn("significance", significance_code(F.col("p_value")))
    )


# ---------------------------------------------------------------- contingency tests


def contingency_tests(
    df: DataFrame, columns: Sequence[str], flag: str = "is_outlier", replicates: int = 10_000, seed: int = 42
) -> DataFrame:
    """Association of each categorical variable with the outlier label.

    Expected counts of at least 5: chi-square (Yates on 2x2). Otherwise Fisher's
    exact test on 2x2, and a permutation p with fixed margins on larger tables.
    """
    cells = _cells(df, columns, flag)
    summary = _chi_square(cells)
    # One row per variable: the driver sees nothing larger.
    wide = [
        r["variable"] for r in summary.where((F.col("rows") > 2) & (F.col("least_expected") < 5)).collect()
    ]
    simulated = permutation_p(cells.where(F.col("variable").isin(wide)), replicates, seed) if wide else None
    two = F.col("rows") == 2
    enough = F.col("least_expected") >= 5
    result = summary.withColumn(
        "test", F.when(enough, "chi-square").when(two, "fisher exact").otherwise("permutation")
    )
    chi2 = F.when(enough & two, F.col("chi2_yates")).otherwise(F.col("chi2_plain"))
    fisher = scalar_function(
        lambda a, b, c, d: special.fisher_two_sided(int(a), int(b), int(c), int(d)),
        *[F.when(two & ~enough, F.col(x)).cast("double") for x in ("a", "b", "c", "d")],
    )
    result = result.withColumn("chi2", chi2).withColumn("dof", (F.col("rows") - 1).cast("long"))
    result = result.withColumn("fisher_p", fisher).withColumn(
        "chi2_p", scalar_function(special.chi2_sf, F.col("chi2"), F.col("dof").cast("double"))
    )
    if simulated is not None:
        result = result.join(simulated.select("variable", "permutation_p"), "variable", "left")
    else:
        result = result.withColumn("permutation_p", F.lit(None).cast("double"))
    p = (
        F.when(F.col("test") == "chi-square", F.col("chi2_p"))
        .when(F.col("test") == "fisher exact", F.col("fisher_p"))
        .otherwise(F.col("permutation_p"))
    )
    size = F.sqrt(F.col("chi2") / F.col("n"))
    return result.select(
        "variable", "test", "chi2", "dof", p.alias("p_value"), (p < 0.05).alias("significant"),
        F.when(two, "phi").otherwise("cramer_v").alias("effect"), size.alias("effect_size"),
        effect_label(size).alias("effect_label"), "n", p_value_text(p).alias("p_value_text"),
    )


def _cells(df: DataFrame, columns: Sequence[str], flag: str) -> DataFrame:
    """variable, value, outliers, normals: the contingency table in long form."""
    return (
        melt_text(_flagged(df, flag), columns, ["is_outlier"])
        .groupBy("variable", "value")
        .agg(F.count_if("is_outlier").alias("outliers"), F.count_if(~F.col("is_outlier")).alias("normals"))
    )


def _chi_square(cells: DataFrame) -> DataFrame:
    totals = cells.groupBy("variable").agg(
        F.sum("outliers").alias("n1"), F.sum("normals").alias("n0"), F.count("*").alias("rows")
    )
    joined = cells.join(F.broadcast(totals), "variable")  # a row per variable named in the call
    n = F.col("n1") + F.col("n0")
    row = F.col("outliers") + F.col("normals")
    joined = joined.withColumns({"e1": row * F.col("n1") / n, "e0": row * F.col("n0") / n})
    gap = F.abs(F.col("outliers") - F.col("e1"))

    def term(distance):
        return distance * distance / F.col("e1") + distance * distance / F.col("e0")

    yates = gap - F.least(F.lit(0.5), gap)
    first, last = F.min_by, F.max_by
    return (
        joined.where((F.col("n1") > 0) & (F.col("n0") > 0) & (F.col("rows") > 1))
        .groupBy("variable")
        .agg(
            F.first("rows").alias("rows"), F.first(n).alias("n"),
            F.sum(term(gap)).alias("chi2_plain"), F.sum(term(yates)).alias("chi2_yates"),
            F.min(F.least("e1", "e0")).alias("least_expected"),
            first("outliers", "value").alias("a"), first("normals", "value").alias("b"),
            last("outliers", "value").alias("c"), last("normals", "value").alias("d"),
        )
    )


def permutation_p(cells: DataFrame, replicates: int = 10_000, seed: int = 42) -> DataFrame:
    """Share of random tables with the same margins whose chi-square reaches the observed one.

    No row is permuted: tables are drawn from the hypergeometric distribution.
    The values of a variable are split into blocks of about BLOCK_VALUES; a
    replicate draws the block totals first and then, block by block in parallel,
    the cells, so a variable with very many values never meets in one task.
    """
    observed = _chi_square(cells).select("variable", F.col("chi2_plain").alias("observed"))
    row = (F.col("outliers") + F.col("normals")).alias("row")
    totals = cells.groupBy("variable").agg(
        F.sum("outliers").alias("n1"), F.sum(F.col("outliers") + F.col("normals")).alias("n"),
        F.ceil(F.count("*") / BLOCK_VALUES).alias("blocks"),
    )
    blocks = (
        cells.select("variable", "value", row)
        .join(F.broadcast(totals), "variable")  # a row per variable named in the call
        .groupBy("variable", "n1", "n", F.pmod(F.xxhash64("value"), F.col("blocks")).alias("block"))
        .agg(F.array_sort(F.collect_list("row")).alias("rows"), F.sum("row").alias("block_rows"))
    )
    sizes = blocks.groupBy("variable").agg(
        F.array_sort(F.collect_list(F.struct("block", "block_rows"))).alias("sizes")
    )
    step = 250
    starts = F.explode(F.sequence(F.lit(0), F.lit(replicates - 1), F.lit(step))).alias("start")
    tasks = (
        blocks.join(F.broadcast(sizes), "variable")
        .select(
            "variable", "n1", "n", "block", "rows", F.col("sizes.block").alias("block_ids"),
            F.col("sizes.block_rows").alias("block_sizes"), starts,
        )
        .repartition("variable", "block", "start")
    )

    def draw(batches):
        for pdf in batches:
            out = []
            for t in pdf.itertuples(index=False):
                rows = np.asarray(t.rows, dtype=np.int64)
                sizes_ = np.asarray(t.block_sizes, dtype=np.int64)
                place = int(np.flatnonzero(np.asarray(t.block_ids) == t.block)[0])
                e1 = rows * (t.n1 / t.n)
                e0 = rows - e1
                for replicate in range(t.start, min(t.start + step, replicates)):
                    share = t.n1
                    if sizes_.size > 1:
                        between = np.random.default_rng([seed, replicate])
                        share = draw_margins(between, sizes_, t.n1)[place]
                    within = np.random.default_rng([seed, replicate, int(t.block) + 1])
                    gap = draw_margins(within, rows, share) - e1
                    out.append((t.variable, replicate, float((gap * gap / e1 + gap * gap / e0).sum())))
            yield pd.DataFrame(out, columns=["variable", "replicate", "chi2"])

    simulated = (
        tasks.mapInPandas(draw, "variable string, replicate long, chi2 double")
        .groupBy("variable", "replicate")
        .agg(F.sum("chi2").alias("chi2"))
    )
    reached = F.col("chi2") >= F.col("observed") - 1e-9 * F.greatest(F.lit(1.0), F.col("observed"))
    return (
        simulated.join(F.broadcast(observed), "variable")
        .groupBy("variable", "observed")
        .agg((F.count_if(reached) / F.count("*")).alias("permutation_p"), F.count("*").alias("replicates"))
    )


def draw_margins(rng: np.random.Generator, rows: np.ndarray, sample: int) -> np.ndarray:
    """How a sample without replacement of the given size spreads over the rows."""
    if int(rows.sum()) < 1_000_000_000:
        return rng.multivariate_hypergeometric(rows, int(sample), method="marginals")
    # numpy's exact sampler ends here; at this size the binomial (rare rows) and
    # normal (common rows) limits are indistinguishable from it.
    left, taken, out = int(rows.sum()), int(sample), np.zeros(rows.size, dtype=np.int64)
    for i, row in enumerate(rows):
        row = int(row)
        if row == left:
            out[i] = taken
        else:
            f = taken / left
            if row < 100_000:
                hit = int(rng.binomial(row, f))
            else:
                spread = (row * f * (1 - f) * (left - row) / (left - 1)) ** 0.5
                hit = int(round(rng.normal(row * f, spread)))
            out[i] = min(max(hit, taken - (left - row), 0), row, taken)
        left, taken = left - row, taken - int(out[i])
    return out


# ---------------------------------------------------------------- t test and profile


def student_t(
    df: DataFrame, columns: Sequence[str], flag: str = "is_outlier", alpha: float = 0.05, task_rows: int = TASK_ROWS
) -> DataFrame:
    """Equal-variance t test of every variable, with the gate of whether both groups pass Anderson-Darling at alpha.

    both_normal is false where a group has under 3 values or no spread.
    """
    long = melt(_flagged(df, flag), columns, ["is_outlier"])
    tested = anderson_groups(long, ["variable", "is_outlier"], task_rows).where("n >= 3")
    passed = tested.where(anderson_p(F.col("statistic"), F.col("n")) > alpha)
    gate = passed.groupBy("variable").agg((F.count("*") == 2).alias("both_normal"))
    return t_statistics(grouped_moments(df, columns, flag)).join(gate, "variable", "left").select(
        "variable", "t", "dof", "p_value", F.coalesce("both_normal", F.lit(False)).alias("both_normal")
    )


def t_statistics(groups: DataFrame) -> DataFrame:
    """t, degrees of freedom and two-sided p from (variable, is_outlier, n, mean, var)."""

    def of(outlier, c):
        return F.max(F.when(F.col("is_outlier") == outlier, F.col(c)))

    pairs = groups.groupBy("variable").agg(
        *[of(g, c).alias(f"{c}{i}") for i, g in ((1, True), (0, False)) for c in ("n", "mean", "var")]
    )
    dof = F.col("n1") + F.col("n0") - 2
    pooled = ((F.col("n1") - 1) * F.col("var1") + (F.col("n0") - 1) * F.col("var0")) / dof
    t = (F.col("mean1") - F.col("mean0")) / F.sqrt(pooled * (1 / F.col("n1") + 1 / F.col("n0")))
    computed = pairs.where((F.col("n1") >= 2) & (F.col("n0") >= 2)).select(
        "variable", t.alias("t"), dof.alias("dof")
    )
    return computed.withColumn(
        "p_value", scalar_function(special.t_two_sided, F.col("t"), F.col("dof").cast("double"))
    )


def grouped_moments(df: DataFrame, columns: Sequence[str], flag: str = "is_outlier") -> DataFrame:
    return (
        melt(_flagged(df, flag), columns, ["is_outlier"])
        .groupBy("variable", "is_outlier")
        .agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.var_samp("x").alias("var"))
    )


def suggest_id_columns(columns: Sequence[str], keywords: Sequence[str]) -> list[str]:
    """Columns whose name contains one of the keywords."""
    return [c for c in columns if any(k.lower() in c.lower() for k in keywords)]


def profile_groups(
    df: DataFrame, categorical: Sequence[str], numeric: Sequence[str], flag: str = "is_outlier",
    task_rows: int = TASK_ROWS,
) -> dict[str, DataFrame]:
    """Demographic profile: tests and proportions of categoricals, statistics and tests of numerics."""
    result = {
        "numeric_statistics": describe_groups(df, numeric, flag, task_rows),
        "mann_whitney": mann_whitney(df, numeric, flag, task_rows),
        "t_test": student_t(df, numeric, flag),
    }
    if categorical:
        cells = _cells(df, categorical, flag)
        summary = _chi_square(cells)
        two = F.col("rows") == 2
        chi2 = F.when(two, F.col("chi2_yates")).otherwise(F.col("chi2_plain"))
        fisher = scalar_function(
            lambda a, b, c, d: special.fisher_two_sided(int(a), int(b), int(c), int(d)),
            *[F.when(two & (F.col("least_expected") < 5), F.col(x)).cast("double") for x in ("a", "b", "c", "d")],
        )
        tests = summary.select(
            "variable", chi2.alias("chi2"), (F.col("rows") - 1).cast("long").alias("dof"), fisher.alias("fisher_p")
        )
        result["categorical_tests"] = tests.withColumn(
            "chi2_p", scalar_function(special.chi2_sf, F.col("chi2"), F.col("dof").cast("double"))
        )
        result["proportions"] = category_proportions(df, categorical, flag)
    return result


def group_bars(df: DataFrame, columns: Sequence[str], flag: str = "is_outlier") -> DataFrame:
    """Bar heights of the group comparison plots: variable, value, is_outlier, count."""
    return category_proportions(df, columns, flag).drop("proportion")


def group_boxes(df: DataFrame, columns: Sequence[str], flag: str = "is_outlier", task_rows: int = TASK_ROWS) -> DataFrame:
    """Box-plot numbers per variable and group."""
    return boxes_of(describe_groups(df, columns, flag, task_rows))


def boxes_of(described: DataFrame) -> DataFrame:
    """Box-plot numbers out of describe_groups()."""
    return described.select("variable", "is_outlier", "n", "min", "q25", "median", "q75", "max")


def available_analyses(kinds: DataFrame) -> DataFrame:
    """Which columns each analysis can use: analysis, variable."""
    numeric = F.col("kind").isin("continuous", "discrete")
    uses = F.array_compact(
        F.array(
            F.when(numeric, "regression"), F.when(numeric, "pca"), F.when(numeric, "clustering"),
            F.when(numeric, "correlation"), F.lit("classification"),
            F.when(~numeric, "contingency"),
        )
    )
    return kinds.select(F.explode(uses).alias("analysis"), "variable")
