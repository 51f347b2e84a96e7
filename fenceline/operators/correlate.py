"""Correlations of pairs, matrices and groups, and the networks built from them."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import special
from ..functions.columns import coerced, correlation_strength, finite, number, scalar_function
from ..functions.lineage import BROADCAST_ROWS, cut_lineage
from ..functions.rank import TASK_ROWS, average_rank, ranked_values, rows_with_ranks

# Pairs per aggregate; wider matrices are computed in several passes, so that no
# generated method or row grows with the square of the column count.
PAIRS_PER_PASS = 500

# Distinct values of all columns up to which their ranks are sent to the rows.
FOLDED_VALUES = BROADCAST_ROWS


def complete_numbers(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Numeric columns of rows without a missing value among them."""
    return df.select(*by, *[number(c).alias(c) for c in columns]).dropna("any", subset=list(columns))


def rank_columns(
    df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), task_rows: int = TASK_ROWS
) -> DataFrame:
    """Replace every column by its average rank (within by). Columns must be complete.

    Where the distinct values of all columns together are few (estimated first, counted
    after), they are folded, ranked and sent to the rows, which do not move. Otherwise
    all columns share one exchange of values by value piece, see ``rows_with_ranks``.
    """
    by, columns = list(by), list(columns)
    keyed = df.select(F.lit(0).alias("_all"), *by, *columns)
    keys = ["_all", *by]
    few = F.lit(0)
    for c in columns:
        few = few + F.approx_count_distinct(c)
    groups = keyed.groupBy(*keys).agg(few.alias("values"))
    if (groups.agg(F.sum("values")).first()[0] or 0) > FOLDED_VALUES:
        return rows_with_ranks(df, columns, by, task_rows)
    long = keyed.unpivot(keys, columns, "variable", "x")
    ranks = cut_lineage(
        ranked_values(long, [*keys, "variable"], "x", task_rows).select(*keys, "variable", "x", average_rank().alias("_rank"))
    )
    if ranks.count() > FOLDED_VALUES:  # the estimate was low
        return rows_with_ranks(df, columns, by, task_rows)
    for c in columns:
        mine = ranks.where(F.col("variable") == c).select(*keys, F.col("x").alias(c), "_rank")
        keyed = keyed.join(F.broadcast(mine), [*keys, c]).drop(c).withColumnRenamed("_rank", c)
    return keyed.select(*by, *columns)


def pair_correlations(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Pearson r of all column pairs in one pass: by..., first, second, r, n."""
    by = list(by)
    pairs = list(combinations(columns, 2))
    result = None
    for start in range(0, len(pairs), PAIRS_PER_PASS):
        part = pairs[start : start + PAIRS_PER_PASS]
        row = df.groupBy(*by).agg(
            F.count("*").alias("n"), *[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(part)]
        )
        entries = [
            F.struct(F.lit(a).alias("first"), F.lit(b).alias("second"), F.col(f"c{i}").alias("r"))
            for i, (a, b) in enumerate(part)
        ]
        chunk = row.select(*by, "n", F.inline(F.array(*entries)))
        result = chunk if result is None else result.unionByName(chunk)
    return result.select(*by, "first", "second", "r", "n")


def correlation_p(r: Column, n: Column) -> Column:
    """Two-sided p of a correlation by Student's t with n - 2 degrees of freedom."""

    def p(r_value: float, n_value: float) -> float:
        if n_value <= 2:
            return float("nan")
        if abs(r_value) >= 1.0 - 1e-15:
            return 0.0
        t = r_value * ((n_value - 2) / (1 - r_value * r_value)) ** 0.5
        return special.t_two_sided(t, n_value - 2)

    return scalar_function(p, r, n.cast("double"))


def relationship(df: DataFrame, first: str, second: str, task_rows: int = TASK_ROWS) -> DataFrame:
    """Pearson and Spearman of two (coerced) variables, with strength labels and a linearity note."""
    data = df.select(coerced(first).alias("a"), coerced(second).alias("b")).dropna()
    if first == second:
        result = data.agg(F.count("*").alias("n")).select("n", F.lit(1.0).alias("pearson"), F.lit(1.0).alias("spearman"))
    else:
        pearson = data.agg(F.count("*").alias("n"), finite(F.corr("a", "b")).alias("pearson"))
        spearman = rank_columns(data, ["a", "b"], (), task_rows).agg(finite(F.corr("a", "b"))).first()[0]
        result = pearson.withColumn("spearman", F.lit(spearman))
    return result.select(
        F.lit(first).alias("first"), F.lit(second).alias("second"), "n", "pearson", "spearman",
        correlation_strength(F.col("pearson")).alias("pearson_strength"),
        correlation_strength(F.col("spearman")).alias("spearman_strength"),
        (F.abs(F.col("pearson") - F.col("spearman")) > 0.1).alias("maybe_nonlinear"),
    )


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """All ordered pairs with Pearson r and two-sided p over complete rows; the diagonal is 1 and 0."""
    half = pair_correlations(complete_numbers(df, columns), columns)
    half = half.withColumn("p_value", correlation_p(F.col("r"), F.col("n"))).select("first", "second", "r", "p_value")
    other = half.select(F.col("second").alias("first"), F.col("first").alias("second"), "r", "p_value")
    diagonal = df.sparkSession.createDataFrame(
        [(c, c, 1.0, 0.0) for c in columns], "first string, second string, r double, p_value double"
    )
    return half.unionByName(other).unionByName(diagonal)


def trend_line(df: DataFrame, x: str, y: str) -> DataFrame:
    """Least-squares line of y on x and its end points over the range of x."""
    data = df.select(number(x).alias("x"), number(y).alias("y")).dropna()
    line = data.agg(
        F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"),
        F.min("x").alias("x_first"), F.max("x").alias("x_last"), F.count("*").alias("n"),
    )
    return line.withColumns({
        "y_first": F.col("slope") * F.col("x_first") + F.col("intercept"),
        "y_last": F.col("slope") * F.col("x_last") + F.col("intercept"),
    })


def compare_group_correlations(
    df: DataFrame, columns: Sequence[str], flag: str = "is_outlier", task_rows: int = TASK_ROWS
) -> DataFrame:
    """Pearson and Spearman of every pair in both groups and Fisher's test of their difference.

    Pairs without variation in a group are left out; groups under 3 complete rows
    give no result.
    """
    data = complete_numbers(df, columns, [flag]).withColumnRenamed(flag, "is_outlier")
    pearson = pair_correlations(data, columns, ["is_outlier"]).withColumnRenamed("r", "pearson")
    ranked = rank_columns(data, columns, ["is_outlier"], task_rows)
    spearman = pair_correlations(ranked, columns, ["is_outlier"]).withColumnRenamed("r", "spearman").drop("n")
    both = cut_lineage(pearson).join(cut_lineage(spearman), ["is_outlier", "first", "second"]).where(
        (F.col("n") >= 3) & F.col("pearson").isNotNull() & ~F.isnan("pearson")
    )

    def of(outlier: bool, c: str) -> Column:
        return F.max(F.when(F.col("is_outlier") == outlier, F.col(c)))

    wide = (
        both.groupBy("first", "second")
        .agg(
            of(True, "pearson").alias("outlier_pearson"), of(False, "pearson").alias("normal_pearson"),
            of(True, "spearman").alias("outlier_spearman"), of(False, "spearman").alias("normal_spearman"),
            of(True, "n").alias("outlier_n"), of(False, "n").alias("normal_n"),
        )
        .dropna(subset=["outlier_pearson", "normal_pearson"])
    )
    usable = (
        (F.abs("outlier_pearson") < 0.99) & (F.abs("normal_pearson") < 0.99)
        & (F.col("outlier_n") > 3) & (F.col("normal_n") > 3)
    )
    error = F.sqrt(1.0 / (F.col("outlier_n") - 3) + 1.0 / (F.col("normal_n") - 3))
    z = F.when(usable, (F.atanh("outlier_pearson") - F.atanh("normal_pearson")) / error)
    compared = wide.withColumns({
        "pearson_change": F.abs(F.col("outlier_pearson") - F.col("normal_pearson")),
        "spearman_change": F.abs(F.col("outlier_spearman") - F.col("normal_spearman")),
        "z": z,
    })
    p = scalar_function(lambda v: 2 * special.norm_sf(abs(v)), F.col("z"))
    return compared.withColumn("p_value", p).withColumn(
        "significant", (F.col("pearson_change") > 0.3) | F.coalesce(F.col("p_value") < 0.05, F.lit(False))
    )


def rank_correlations(
    df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), task_rows: int = TASK_ROWS
) -> DataFrame:
    """Spearman rho and p of all pairs over complete rows: by..., first, second, r, n, p_value."""
    ranked = rank_columns(complete_numbers(df, columns, by), columns, by, task_rows)
    # One row per pair and group from here on; the ranks behind it are costly.
    pairs = cut_lineage(pair_correlations(ranked, columns, by))
    return pairs.withColumn("p_value", correlation_p(F.col("r"), F.col("n")))


def cooccurrence(df: DataFrame, columns: Sequence[str], flag: str = "is_outlier", task_rows: int = TASK_ROWS) -> DataFrame:
    """Spearman pairs among outlier rows with a significance mark."""
    pairs = rank_correlations(df.where(F.col(flag)), columns, (), task_rows).where(F.col("n") >= 3)
    return pairs.withColumn("significant", F.coalesce(F.col("p_value") < 0.05, F.lit(False)))


def significant_share(pairs: DataFrame) -> DataFrame:
    return pairs.agg(
        F.count("*").alias("pairs"), F.count_if("significant").alias("significant_pairs"),
        (100.0 * F.count_if("significant") / F.count("*")).alias("percent"),
    )


def change_summary(compared: DataFrame) -> DataFrame:
    """One row from compare_group_correlations(): pairs tested, significant ones and their share, largest change."""
    return compared.agg(
        F.count("*").alias("pairs"), F.count_if("significant").alias("significant_pairs"),
        (100.0 * F.count_if("significant") / F.count("*")).alias("percent"),
        F.max("pearson_change").alias("largest_change"),
        F.max_by(F.concat_ws(" / ", "first", "second"), "pearson_change").alias("largest_pair"),
    )


def difference_matrix(compared: DataFrame, columns: Sequence[str]) -> DataFrame:
    """variable and one column per variable: outlier minus normal Pearson correlation, 0 on the diagonal."""
    gap = (F.col("outlier_pearson") - F.col("normal_pearson")).alias("gap")
    both = compared.select("first", "second", gap).unionByName(
        compared.select(F.col("second").alias("first"), F.col("first").alias("second"), gap)
    )
    cells = [F.max(F.when(F.col("second") == c, F.col("gap"))) for c in columns]
    return both.groupBy(F.col("first").alias("variable")).agg(
        *[F.when(F.first("first") == c, 0.0).otherwise(cell).alias(c) for c, cell in zip(columns, cells)]
    )


# ---------------------------------------------------------------- networks


def correlation_network(
    df: DataFrame, columns: Sequence[str], flag: str = "is_outlier", threshold: float = 0.5, alpha: float = 0.05,
    task_rows: int = TASK_ROWS,
) -> DataFrame:
    """Edges between strongly rank-correlated columns per group: is_outlier, first, second, r, p_value."""
    pairs = rank_correlations(df.withColumnRenamed(flag, "is_outlier"), columns, ["is_outlier"], task_rows)
    return pairs.where(
        (F.col("n") >= 3) & (F.abs("r") >= threshold) & (F.col("p_value") < alpha)
    ).select("is_outlier", "first", "second", "r", "p_value")


def degree_centrality(edges: DataFrame, nodes: Sequence[str]) -> DataFrame:
    """degree and degree / (nodes - 1) of every node of each group that has edges; hubs exceed 0.3."""
    ends = edges.select("is_outlier", F.col("first").alias("node")).unionByName(
        edges.select("is_outlier", F.col("second").alias("node"))
    )
    degrees = ends.groupBy("is_outlier", "node").agg(F.count("*").alias("degree"))
    names = F.array(*[F.lit(n) for n in nodes])
    grid = edges.select("is_outlier").distinct().select("is_outlier", F.explode(names).alias("node"))
    degree = F.coalesce(F.col("degree"), F.lit(0))
    centrality = degree / F.lit(max(len(nodes) - 1, 1)).cast("double")
    return grid.join(degrees, ["is_outlier", "node"], "left").select(
        "is_outlier", "node", degree.alias("degree"), centrality.alias("centrality"), (centrality > 0.3).alias("hub")
    )


def centrality_change(centrality: DataFrame, least: float = 0.1) -> DataFrame:
    """Nodes whose degree centrality differs between the groups by more than `least`."""

    def of(outlier: bool) -> Column:
        return F.coalesce(F.max(F.when(F.col("is_outlier") == outlier, F.col("centrality"))), F.lit(0.0))

    return (
        centrality.groupBy("node")
        .agg(of(True).alias("outlier_centrality"), of(False).alias("normal_centrality"))
        .withColumn("change", F.col("outlier_centrality") - F.col("normal_centrality"))
        .where(F.abs("change") > least)
    )


def hub_changes(centrality: DataFrame) -> DataFrame:
    """Hubs found only among outliers, only among the rest, or in both."""
    from .marks import compare_sets

    hubs = centrality.where("hub")
    sides = compare_sets(hubs.where("is_outlier"), hubs.where("NOT is_outlier"), "node")
    label = F.when(F.col("side") == "first only", "outlier only").when(
        F.col("side") == "second only", "normal only"
    ).otherwise("common")
    return sides.select("node", label.alias("side"))
