"""Statistics, histograms, densities and tabulations of one or two variables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.columns import coerced, melt, numbers
from ..functions.lineage import broadcast_if_small
from ..functions.rank import TASK_ROWS, long_quantiles
from .univariate import group_iqr_flags


def _value(df: DataFrame, variable: str, by: Sequence[str]) -> DataFrame:
    """Rows with a parsable value (and a present category): by..., x."""
    data = df.select(*by, coerced(variable).alias("x")).where(F.col("x").isNotNull())
    return data.dropna(subset=list(by)) if by else data


def variable_statistics(
    df: DataFrame, variable: str, by: Sequence[str] = (), task_rows: int = TASK_ROWS
) -> DataFrame:
    """n, mean, std, min, max, q1, median, q3, iqr and missing values, overall or per category."""
    by = list(by)
    keyed = df.select(F.lit(variable).alias("variable"), *by, coerced(variable).alias("x"))
    if by:
        keyed = keyed.dropna(subset=by)
    keys = ["variable", *by]
    base = keyed.groupBy(*keys).agg(
        F.count("x").alias("n"), (F.count("*") - F.count("x")).alias("missing"),
        F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"),
    )
    quantiles = (
        long_quantiles(keyed.where(F.col("x").isNotNull()), keys, [0.25, 0.5, 0.75], task_rows)
        .groupBy(*keys)
        .agg(*[
            F.max(F.when(F.col("p") == p, F.col("value"))).alias(name)
            for p, name in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))
        ])
    )
    return base.join(quantiles, keys, "left").withColumn("iqr", F.col("q3") - F.col("q1"))


def histogram(df: DataFrame, variable: str, by: Sequence[str] = (), bins: int = 30, size_rule: bool = False) -> DataFrame:
    """Equal-width counts: by..., bin, low, high, count; size_rule takes floor(sqrt n) bins, from 5 to ``bins``."""
    by = list(by)
    data = _value(df, variable, by)
    ranges = data.groupBy(*by).agg(
        F.min("x").alias("x0"), F.max("x").alias("x1"),
        (
            F.least(F.lit(bins), F.greatest(F.lit(5), F.floor(F.sqrt(F.count("*"))))) if size_rule else F.lit(bins)
        ).cast("long").alias("bins"),
    )
    ranges = ranges.withColumn("width", (F.col("x1") - F.col("x0")) / F.col("bins"))
    if by:
        located = data.join(broadcast_if_small(ranges), by)
    else:
        row = ranges.first()
        located = data.withColumns({
            c: F.lit(row[c]).cast("long" if c == "bins" else "double") for c in ("x0", "x1", "bins", "width")
        })
    position = F.when(
        F.col("width") > 0, F.least(F.col("bins") - 1, F.floor((F.col("x") - F.col("x0")) / F.col("width")))
    ).otherwise(0)
    return (
        located.withColumn("bin", position.cast("long"))
        .groupBy(*by, "bin", "x0", "width")
        .count()
        .select(
            *by, "bin", (F.col("x0") + F.col("bin") * F.col("width")).alias("low"),
            (F.col("x0") + (F.col("bin") + 1) * F.col("width")).alias("high"), "count",
        )
    )


def box_data(
    df: DataFrame, variable: str, row_id: str, by: Sequence[str] = (), task_rows: int = TASK_ROWS, size_rule: bool = False
) -> tuple[DataFrame, DataFrame]:
    """The five numbers of each box and the rows outside its fences (by..., row_id, value)."""
    by = list(by)
    five = variable_statistics(df, variable, by, task_rows).select(*by, "n", "min", "q1", "median", "q3", "max")
    parsed = df.select(row_id, *by, coerced(variable).alias("x")).where(F.col("x").isNotNull())
    if not by:
        parsed = parsed.withColumn("all_rows", F.lit(0))
    flagged = group_iqr_flags(parsed, by or ["all_rows"], "x", task_rows=task_rows, size_rule=size_rule).where("is_outlier")
    return five, flagged.select(*by, row_id, F.col("x").alias("value"))


def density(df: DataFrame, variable: str, category: str, steps: int = 100, proper: bool = False) -> DataFrame:
    """Density curve of each category on a grid of steps + 1 points: category, point, x, y.

    y counts the values closer than one step to the point, over step * n (so the
    curve integrates to 2; proper=True halves it). Categories with a single value
    or a single row get 10 points of a flat curve.
    """
    data = _value(df, variable, [category])
    ranges = data.groupBy(category).agg(
        F.count("*").alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1")
    )
    curve = ranges.where((F.col("n") >= 2) & (F.col("x0") < F.col("x1"))).withColumn(
        "step", (F.col("x1") - F.col("x0")) / steps
    )
    position = (F.col("x") - F.col("x0")) / F.col("step")
    cell = F.floor(position)
    # A value touches the grid point at or below it and, unless it sits on one, the next.
    near = F.when(position > cell, F.array(cell, cell + 1)).otherwise(F.array(cell))
    hits = (
        data.join(broadcast_if_small(curve), category)
        .select(category, F.explode(near).alias("point"))
        .groupBy(category, "point")
        .count()
    )
    grid = curve.select(category, "n", "x0", "step", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(steps).cast("long"))).alias("point"))
    scale = 2.0 if proper else 1.0
    drawn = grid.join(hits, [category, "point"], "left").select(
        category, "point", (F.col("x0") + F.col("point") * F.col("step")).alias("x"),
        (F.coalesce(F.col("count"), F.lit(0)) / (F.col("step") * F.col("n")) / scale).alias("y"),
    )
    flat = ranges.where((F.col("n") < 2) | (F.col("x0") == F.col("x1"))).select(
        category, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(9).cast("long"))).alias("point"), "x0"
    )
    flat = flat.select(
        category, "point", (F.col("x0") - 0.1 + F.col("point") * (0.2 / 9)).alias("x"), F.lit(1.0).alias("y")
    )
    return drawn.unionByName(flat)


def category_frequencies(df: DataFrame, variable: str) -> DataFrame:
    """value, count, percent of present values, distinct values and missing values."""
    counts = df.groupBy(F.col(variable).cast("string").alias("value")).count()
    totals = counts.agg(
        F.sum(F.when(F.col("value").isNotNull(), F.col("count"))).alias("total"),
        F.count("value").alias("distinct_values"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("count"))), F.lit(0)).alias("missing"),
    ).first()
    return counts.where(F.col("value").isNotNull()).select(
        "value", "count", (100.0 * F.col("count") / F.lit(totals["total"])).alias("percent"),
        F.lit(totals["distinct_values"]).cast("long").alias("distinct_values"),
        F.lit(totals["missing"]).cast("long").alias("missing"),
    )


def contingency(df: DataFrame, first: str, second: str) -> DataFrame:
    """Counts of value pairs with margins: a NULL value is a total over that variable."""
    pairs = df.select(
        F.col(first).cast("string").alias("first_value"), F.col(second).cast("string").alias("second_value")
    ).dropna()
    return pairs.cube("first_value", "second_value").agg(F.count("*").alias("count"))


def contingency_wide(df: DataFrame, first: str, second: str, values: Sequence[str] | None = None) -> DataFrame:
    """Crosstab: a row per value of `first`, a column per value of `second`."""
    pairs = df.select(first, F.col(second).cast("string").alias(second)).dropna()
    return pairs.groupBy(first).pivot(second, list(values) if values else None).count().fillna(0)


def top_frequencies(df: DataFrame, variable: str, k: int = 10) -> DataFrame:
    return df.groupBy(variable).count().dropna().orderBy(F.desc("count"), variable).limit(k)


def extremes(df: DataFrame, variable: str, row_id: str, k: int) -> DataFrame:
    """The k lowest and k highest rows: side, position, row_id, value."""
    data = df.select(row_id, coerced(variable).alias("value")).where(F.col("value").isNotNull())
    low = data.orderBy("value", row_id).limit(k).withColumn("side", F.lit("low"))
    high = data.orderBy(F.desc("value"), row_id).limit(k).withColumn("side", F.lit("high"))
    key = F.when(F.col("side") == "low", F.col("value")).otherwise(-F.col("value"))
    order = Window.partitionBy("side").orderBy(key, row_id)
    return low.unionByName(high).select("side", F.row_number().over(order).alias("position"), row_id, "value")


def ranked_by_size(df: DataFrame, score: str) -> DataFrame:
    """Rank a small result (one row per variable) by |score|, largest first."""
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc(F.abs(score)), *[c for c in df.columns if c != score])
    return df.withColumn("position", F.row_number().over(order))


def detector_counts(
    df: DataFrame, columns: Sequence[str], task_rows: int = TASK_ROWS
) -> DataFrame:
    """Quartile-fence and z-score outliers per variable and their share of present values."""
    from .univariate import fit_iqr, fit_zscore, moments

    stats = moments(df, columns)
    iqr, z = fit_iqr(df, columns, stats=stats, task_rows=task_rows), fit_zscore(df, columns, 3.0, stats)
    row = df.agg(*[
        F.struct(
            F.lit(c).alias("variable"),
            F.count_if(iqr[c].flag(c)).alias("iqr_count"),
            F.count_if(z[c].flag(c)).alias("zscore_count"),
            F.lit(stats[c]["n"]).cast("long").alias("total_values"),
        ).alias(f"c{i}")
        for i, c in enumerate(columns)
    ])
    counts = row.select(F.inline(F.array(*[f"c{i}" for i in range(len(columns))])))
    return counts.withColumns({
        "iqr_percent": F.col("iqr_count") / F.col("total_values") * 100,
        "zscore_percent": F.col("zscore_count") / F.col("total_values") * 100,
    })
