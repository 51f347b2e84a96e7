"""Column kinds and table summaries."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.columns import melt, melt_text, number, numbers
from ..functions.rank import TASK_ROWS, column_quantiles, ranked_values

CONTINUOUS, DISCRETE = "continuous", "discrete"
NOMINAL, BINARY, ORDINAL = "nominal", "binary", "ordinal"
KINDS = (CONTINUOUS, DISCRETE, NOMINAL, BINARY, ORDINAL)

# Fixed value: numeric columns with fewer distinct values per row are discrete.
DISCRETE_RATIO = 0.1


def is_numeric(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.NumericType)


def value_fold(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """variable (position in columns), number, text, cnt: every column's distinct values, missing (both null) included.

    Numbers are folded as doubles, other columns as text. Values are counted batch by
    batch where the rows are, so no copy of a row is made per column, and what is
    shuffled is what tasks found distinct.
    """
    columns = list(columns)
    numeric = [is_numeric(df, c) for c in columns]
    work = df.select(*[(number(f"`{c}`") if n else F.col(f"`{c}`").cast("string")).alias(f"c{i}") for i, (c, n) in enumerate(zip(columns, numeric))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, n in enumerate(numeric):
                counted = batch.column(i).value_counts()
                values, cnt = counted.field("values"), counted.field("counts").cast(pa.int64())
                none = pa.nulls(len(cnt), pa.string() if n else pa.float64())
                sides = (values, none) if n else (none, values)
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(i, pa.int32()), len(cnt)), *sides, cnt], names=["variable", "number", "text", "cnt"])

    parts = work.mapInArrow(run, "variable int, number double, text string, cnt long")
    return parts.groupBy("variable", "number", "text").agg(F.sum("cnt").alias("cnt"))


def distinct_values(df: DataFrame, columns: Sequence[str]) -> list[tuple[int, int, int]]:
    """(distinct values, missing values, rows) of every column, exact; one fold for all."""
    if not columns:
        return []
    missing = F.col("number").isNull() & F.col("text").isNull()
    found = value_fold(df, columns).groupBy("variable").agg(F.count_if(~missing).alias("d"), F.coalesce(F.sum(F.when(missing, F.col("cnt"))), F.lit(0)).alias("m"), F.sum("cnt").alias("n"))
    by_column = {r["variable"]: (r["d"], r["m"], r["n"]) for r in found.collect()}
    return [by_column.get(i, (0, 0, 0)) for i in range(len(columns))]


def infer_kinds(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """Kind of every column: variable, kind, distinct_values (missing ones count as one), rows.

    With exact=False distinct values are sketched first and only columns close to
    a decision (the 10 % ratio, or a handful of values) are counted exactly.
    """
    columns = list(columns or df.columns)
    numeric = {c for c in columns if is_numeric(df, c)}
    to_count, distinct, rows = columns, {}, 0
    if not exact:
        values = {c: number(c) if c in numeric else F.col(c) for c in columns}
        sketches = [F.struct(F.approx_count_distinct(values[c], 0.05).alias("d"), F.max(F.when(values[c].isNull(), 1).otherwise(0)).alias("missing")).alias(f"c{i}") for i, c in enumerate(columns)]
        row = df.agg(F.count("*").alias("rows"), *sketches).first()
        rows = row["rows"]
        distinct = {c: row[f"c{i}"]["d"] + (row[f"c{i}"]["missing"] or 0) for i, c in enumerate(columns)}
        limit = DISCRETE_RATIO * rows
        to_count = [c for c in columns if (0.75 * limit <= distinct[c] <= 1.25 * limit if c in numeric else distinct[c] <= 20)]
    for c, (d, missing, n) in zip(to_count, distinct_values(df, to_count)):
        distinct[c], rows = d + (missing > 0), n

    def kind(c: str) -> str:
        if c in numeric:
            return DISCRETE if rows and distinct[c] / rows < DISCRETE_RATIO else CONTINUOUS
        return BINARY if distinct[c] == 2 else NOMINAL

    return df.sparkSession.createDataFrame([(c, kind(c), distinct[c], rows) for c in columns], "variable string, kind string, distinct_values long, rows long")


def set_kinds(df: DataFrame, chosen: Mapping[str, str], exact: bool = True) -> DataFrame:
    """Kinds with the user's choice first; unknown columns are left out, the rest inferred."""
    wrong = set(chosen.values()) - set(KINDS)
    if wrong:
        raise ValueError(f"unknown kinds: {sorted(wrong)}")
    kept = {c: k for c, k in chosen.items() if c in df.columns}
    rest = [c for c in df.columns if c not in kept]
    spark = df.sparkSession
    parts = []
    if kept:
        parts.append(spark.createDataFrame(list(kept.items()), "variable string, kind string"))
    if rest:
        parts.append(infer_kinds(df, rest, exact).select("variable", "kind"))
    result = parts[0]
    for p in parts[1:]:
        result = result.unionByName(p)
    return result


def columns_of_kind(df: DataFrame, kinds: Sequence[str], row_id: str | None = None) -> list[str]:
    """Names of the columns whose inferred kind is one of `kinds`, without the id column."""
    found = infer_kinds(df, [c for c in df.columns if c != row_id]).collect()
    return [r["variable"] for r in found if r["kind"] in kinds]


def numeric_summary(df: DataFrame, columns: Sequence[str], task_rows: int = TASK_ROWS) -> DataFrame:
    """mean, median, std, min, max, missing and distinct values, one row per variable."""
    data = numbers(df, columns)
    medians = column_quantiles(df, columns, [0.5], task_rows=task_rows)
    distinct = dict(zip(columns, distinct_values(df, columns)))
    row = data.agg(
        F.count("*").alias("rows"),
        *[f(c).alias(f"{c}_{name}") for c in columns for name, f in (
            ("n", F.count), ("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max),
        )],
    )
    entries = [
        F.struct(
            F.lit(c).alias("variable"),
            F.col(f"{c}_mean").alias("mean"),
            F.lit(medians[c][0]).cast("double").alias("median"),
            F.col(f"{c}_std").alias("std"),
            F.col(f"{c}_min").alias("min"),
            F.col(f"{c}_max").alias("max"),
            (F.col("rows") - F.col(f"{c}_n")).alias("missing_values"),
            F.lit(distinct[c][0]).cast("long").alias("unique_values"),
        )
        for c in columns
    ]
    return row.select(F.inline(F.array(*entries)))


def value_counts(df: DataFrame, columns: Sequence[str], top: int | None = None) -> DataFrame:
    """Frequencies per variable: variable, value, count, position (count desc, then value)."""
    from pyspark.sql import Window

    counts = melt_text(df, columns).groupBy("variable", "value").count()
    order = Window.partitionBy("variable").orderBy(F.desc("count"), "value")
    if top is None:
        return counts
    # The limit is pushed below the shuffle, so at most `top` rows per task and variable move.
    return counts.withColumn("position", F.row_number().over(order)).where(F.col("position") <= top)


def categorical_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """unique_values, missing_values and most_common (ties: smallest value) per variable."""
    columns = list(columns)
    as_text = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in columns])
    name = F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("variable") + 1)
    counts = value_fold(as_text, columns).select(name.alias("variable"), F.col("text").alias("value"), F.col("cnt").alias("count"))
    present = F.col("value").isNotNull()
    return counts.groupBy("variable").agg(
        F.count_if(present).alias("unique_values"),
        F.coalesce(F.sum(F.when(~present, F.col("count"))), F.lit(0)).alias("missing_values"),
        F.min_by("value", F.when(present, F.struct(-F.col("count"), F.col("value")))).alias("most_common"),
    )


def modes(df: DataFrame, columns: Sequence[str]) -> dict[str, str | None]:
    found = {r["variable"]: r["most_common"] for r in categorical_summary(df, columns).collect()}
    return {c: found.get(c) for c in columns}


def missing_report(df: DataFrame) -> DataFrame:
    """Columns with missing values and how many: variable, missing, total_missing."""
    row = df.agg(*[F.count_if(_missing(df, c)).alias(c) for c in df.columns])
    total = F.lit(0)
    for c in df.columns:
        total = total + F.col(c)
    entries = [F.struct(F.lit(c).alias("variable"), F.col(c).alias("missing")) for c in df.columns]
    return (
        row.select(total.alias("total_missing"), F.inline(F.array(*entries)))
        .where(F.col("missing") > 0)
        .select("variable", "missing", F.col("total_missing").cast("long").alias("total_missing"))
    )


def _missing(df: DataFrame, column: str) -> Column:
    value = F.col(column)
    floating = isinstance(df.schema[column].dataType, (T.DoubleType, T.FloatType))
    return value.isNull() | F.isnan(value) if floating else value.isNull()


def quality_score(df: DataFrame) -> DataFrame:
    """One row: rows, cells, missing and the rounded percentage of filled cells."""
    missing = F.lit(0)
    for c in df.columns:
        missing = missing + _missing(df, c).cast("int")
    counts = df.agg(F.count("*").alias("rows"), F.sum(missing).alias("missing"))
    cells = F.col("rows") * len(df.columns)
    return counts.select(
        "rows", cells.alias("cells"), "missing",
        F.when(cells > 0, F.floor(100.0 * (cells - F.col("missing")) / cells + 0.5)).cast("long").alias("quality"),
    )


def population_summary(df: DataFrame, column: str, task_rows: int = TASK_ROWS) -> DataFrame:
    """n, mean, median, population std, min, max; q1 and q3 are the elements at n/4 and 3n/4."""
    long = melt(df, [column])
    ranked = ranked_values(long, ["variable"], "x", task_rows)
    reached = F.col("below") + F.col("cnt")
    n = F.col("n")

    def element(position: Column) -> Column:
        return F.min(F.when(reached > position, F.col("x")))

    picked = ranked.groupBy("variable").agg(
        element(F.floor(n * 0.25)).alias("q1"),
        element(F.floor(n * 0.75)).alias("q3"),
        ((element(F.floor((n - 1) / 2)) + element(F.floor(n / 2))) / 2).alias("median"),
    )
    base = long.groupBy("variable").agg(
        F.count("*").alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"),
        F.min("x").alias("min"), F.max("x").alias("max"),
    )
    return base.join(picked, "variable")
