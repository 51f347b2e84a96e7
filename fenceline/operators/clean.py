"""Casts, missing values, duplicates and outlier treatment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.columns import number
from ..functions.rank import TASK_ROWS, column_quantiles
from .profile import _missing, infer_kinds, is_numeric, modes
from .univariate import moments


# ---------------------------------------------------------------- filters and casts


def select_variable(df: DataFrame, variable: str, filter_column: str | None = None, filter_value=None) -> DataFrame:
    """Present values of one variable, optionally where filter_column equals filter_value."""
    if filter_column is not None:
        df = df.where(F.col(filter_column) == F.lit(filter_value))
    return df.select(variable).dropna()


def variable_overview(df: DataFrame, variable: str, filter_column: str | None = None, filter_value=None) -> DataFrame:
    """One row: variable, value_type, n and, for text, distinct categories."""
    chosen = select_variable(df, variable, filter_column, filter_value)
    numeric = is_numeric(df, variable)
    categories = F.lit(None).cast("long") if numeric else F.count_distinct(variable)
    return chosen.agg(F.count("*").alias("n"), categories.alias("categories")).select(
        F.lit(variable).alias("variable"),
        F.lit("numeric" if numeric else "categorical").alias("value_type"),
        "n", "categories",
    )


def split_groups(df: DataFrame, flag: str = "is_outlier") -> tuple[DataFrame, DataFrame]:
    """Rows with and without the outlier label."""
    return df.where(F.col(flag)), df.where(~F.col(flag))


def complete_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Listwise deletion over the chosen columns."""
    return df.dropna("any", subset=list(columns))


def convert(df: DataFrame, variable: str, target: str) -> DataFrame:
    """Cast one column to numeric, categorical, datetime or boolean; what does not parse is NULL."""
    source = df.schema[variable].dataType
    value = F.col(variable)
    if target == "numeric":
        cast = value.try_cast("double")
    elif target == "categorical":
        cast = value.cast("string")
    elif target == "datetime":
        cast = value.try_cast("timestamp")
    elif target == "boolean":
        if isinstance(source, T.BooleanType):
            cast = value
        elif isinstance(source, T.NumericType):
            cast = value != 0
        else:
            cast = F.length(value.cast("string")) > 0
    else:
        raise ValueError(f"unknown target type: {target}")
    return df.withColumn(variable, cast)


def convert_and_retype(df: DataFrame, variable: str, target: str) -> tuple[DataFrame, DataFrame]:
    """The converted table and the new kind of the column."""
    converted = convert(df, variable, target)
    return converted, infer_kinds(converted, [variable])


# ---------------------------------------------------------------- missing values


def fill_missing(
    df: DataFrame, strategy: str, value=None, columns: Sequence[str] | None = None, row_id: str | None = None,
    task_rows: int = TASK_ROWS,
) -> DataFrame:
    """drop, mean, median (numeric columns), mode (text columns) or constant (every column but row_id).

    Columns without missing values stay as they are, type included.
    """
    columns = [c for c in columns or df.columns if c != row_id]
    if strategy == "drop":
        return df.where(~_any_missing(df, columns))
    if strategy in ("mean", "median"):
        chosen = _with_gaps(df, [c for c in columns if is_numeric(df, c)])
        if not chosen:
            return df
        if strategy == "mean":
            stats = moments(df, chosen)
            fills = {c: stats[c]["mean"] for c in chosen}
        else:
            fills = {c: q[0] for c, q in column_quantiles(df, chosen, [0.5], task_rows=task_rows).items()}
        return df.withColumns({c: F.coalesce(number(c), F.lit(fills[c])) for c in chosen})
    if strategy == "mode":
        chosen = [c for c in columns if isinstance(df.schema[c].dataType, T.StringType)]
        fills = modes(df, chosen)
        return df.withColumns({c: F.coalesce(F.col(c), F.lit(fills[c])) for c in chosen})
    if strategy == "constant":
        return df.withColumns({
            c: F.when(_missing(df, c), F.lit(value).try_cast(df.schema[c].dataType)).otherwise(F.col(c))
            for c in columns
        })
    raise ValueError(f"unknown strategy: {strategy}")


def _with_gaps(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Those columns that have missing values, in one pass."""
    if not columns:
        return []
    row = df.agg(*[F.count_if(_missing(df, c)).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    return [c for c, n in zip(columns, row) if n]


def _any_missing(df: DataFrame, columns: Sequence[str]) -> Column:
    found = F.lit(False)
    for c in columns:
        found = found | _missing(df, c)
    return found


def imputation_report(before: DataFrame, after: DataFrame, strategy: str) -> DataFrame:
    """Per column with missing values before: counts before and after, with the row counts."""

    def counts(df: DataFrame, suffix: str) -> DataFrame:
        row = df.agg(
            F.count("*").alias("rows"), *[F.count_if(_missing(df, c)).alias(c) for c in before.columns]
        )
        entries = [F.struct(F.lit(c).alias("variable"), F.col(c).alias(f"missing_{suffix}")) for c in before.columns]
        return row.select(F.col("rows").alias(f"rows_{suffix}"), F.inline(F.array(*entries)))

    return (
        counts(before, "before")
        .join(counts(after, "after"), "variable")
        .where(F.col("missing_before") > 0)
        .select(
            F.lit(strategy).alias("strategy"), "variable", "missing_before", "missing_after",
            "rows_before", "rows_after", (F.col("rows_before") - F.col("rows_after")).alias("rows_removed"),
        )
    )


# ---------------------------------------------------------------- duplicates


def drop_duplicates(df: DataFrame, row_id: str, keep: str = "first", columns: Sequence[str] | None = None) -> DataFrame:
    """One row per set of equal rows (row_id aside), the first or last by row_id.

    A grouped min or max, so copies fold before the shuffle however many there are.
    """
    keys = list(columns or [c for c in df.columns if c != row_id])
    pick = {"first": F.min, "last": F.max}[keep]
    if set(keys) | {row_id} == set(df.columns):
        return df.groupBy(*keys).agg(pick(row_id).alias(row_id)).select(df.columns)
    rest = [c for c in df.columns if c not in keys and c != row_id]
    by = F.min_by if keep == "first" else F.max_by
    kept = df.groupBy(*keys).agg(
        pick(row_id).alias(row_id), by(F.struct(*rest), F.col(row_id)).alias("_rest")
    )
    return kept.select(*[F.col(f"_rest.{c}").alias(c) if c in rest else F.col(c) for c in df.columns])


# ---------------------------------------------------------------- outlier treatment


def _bounds(df: DataFrame, columns: Sequence[str], method: str, task_rows: int) -> dict[str, tuple]:
    """(low, high, min) of every column."""
    stats = moments(df, columns)
    if method == "zscore":
        return {
            c: (s["mean"] - 3 * s["std"], s["mean"] + 3 * s["std"], s["min"]) if s["std"] is not None
            else (None, None, s["min"])
            for c, s in stats.items()
        }
    if method != "iqr":
        raise ValueError(f"unknown method: {method}")
    rows = max((s["n"] for s in stats.values()), default=0)
    quartiles = column_quantiles(df, columns, [0.25, 0.75], rows, task_rows)
    result = {}
    for c, (q1, q3) in quartiles.items():
        fence = None if q1 is None else 1.5 * (q3 - q1)
        result[c] = (None, None, None) if fence is None else (q1 - fence, q3 + fence, stats[c]["min"])
    return result


def treat_outliers(
    df: DataFrame, method: str, strategy: str, columns: Sequence[str],
    mode: str = "sequential", task_rows: int = TASK_ROWS,
) -> DataFrame:
    """Remove, cap or log-transform by quartile fences (1.5) or |z| < 3.

    mode='sequential' recomputes the bounds of each column on the rows the columns
    before it kept; 'simultaneous' takes all bounds from one pass over the input.
    The bounds end up as literals, so the result is one filter or projection.
    """
    if strategy not in ("remove", "cap", "transform"):
        raise ValueError(f"unknown strategy: {strategy}")
    batches = [[c] for c in columns] if mode == "sequential" and strategy == "remove" else [list(columns)]
    for batch in batches:
        limits = _bounds(df, batch, method, task_rows)
        for c in batch:
            low, high, smallest = limits[c]
            x = number(c)
            if strategy == "remove":
                # Plain comparisons reach the scan; missing values and NaN fail them too.
                # A z-score keeps |z| < 3, a fence keeps its own bounds; a column without
                # spread has no z-score and loses nothing.
                plain = F.col(c).cast("double")
                if low is None:
                    df = df.where(F.lit(False))
                elif method == "iqr":
                    df = df.where((plain >= low) & (plain <= high))
                elif low != high:
                    df = df.where((plain > low) & (plain < high))
            elif strategy == "cap" and low is not None:
                capped = F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))
                df = df.withColumn(c, capped)
            elif strategy == "transform" and smallest is not None:
                df = df.withColumn(c, F.log1p(x - F.lit(smallest) + 1))
    return df


# ---------------------------------------------------------------- chains of steps


def clean(df: DataFrame, steps: Sequence[dict], row_id: str, task_rows: int = TASK_ROWS) -> tuple[DataFrame, DataFrame]:
    """Apply ordered steps; returns the table and one report row per step.

    Steps: {'step': 'missing', 'strategy', 'value'?, 'columns'?},
    {'step': 'duplicates', 'keep'}, {'step': 'outliers', 'method', 'strategy', 'columns'},
    {'step': 'convert', 'variable', 'target'}.
    """
    report = None
    rows = df.agg(F.count("*").alias("rows"))
    for position, step in enumerate(steps, start=1):
        kind = step["step"]
        if kind == "missing":
            df = fill_missing(df, step["strategy"], step.get("value"), step.get("columns"), row_id=row_id, task_rows=task_rows)
        elif kind == "duplicates":
            df = drop_duplicates(df, row_id, step.get("keep", "first"))
        elif kind == "outliers":
            df = treat_outliers(
                df, step["method"], step["strategy"], step["columns"], step.get("mode", "sequential"), task_rows
            )
        elif kind == "convert":
            df = convert(df, step["variable"], step["target"])
        else:
            raise ValueError(f"unknown step: {kind}")
        after = df.agg(F.count("*").alias("rows"))
        line = rows.select(F.lit(position).alias("position"), F.lit(kind).alias("step"), F.col("rows").alias("rows_before")).join(
            after.select(F.lit(position).alias("position"), F.col("rows").alias("rows_after")), "position"
        )
        report = line if report is None else report.unionByName(line)
        rows = after
    if report is None:
        report = df.sparkSession.createDataFrame(
            [], "position int, step string, rows_before long, rows_after long"
        )
    return df, report
