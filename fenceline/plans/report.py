"""Primary report: descriptives, proportions, tests and plot data of the two groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.columns import finite
from ..functions.lineage import cut_lineage
from ..functions.rank import TASK_ROWS
from ..operators import compare


def primary_report(
    df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], flag: str = "is_outlier",
    task_rows: int = TASK_ROWS,
) -> dict[str, DataFrame]:
    """All group comparisons of a marked table; NaN and infinities become 0."""
    described = cut_lineage(compare.describe_groups(df, numeric, flag, task_rows))  # two rows per named column
    parts = {
        "numeric": described,
        "mann_whitney": compare.mann_whitney(df, numeric, flag, task_rows),
        "boxes": compare.boxes_of(described),
    }
    if categorical:
        parts["categorical"] = compare.category_proportions(df, categorical, flag)
        parts["contingency_tests"] = compare.contingency_tests(df, categorical, flag)
        parts["bars"] = compare.group_bars(df, categorical, flag)
    return {name: clean_numbers(part) for name, part in parts.items()}


def clean_numbers(df: DataFrame) -> DataFrame:
    """Replace NULL, NaN and infinite values of floating columns by 0."""
    floating = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(*[finite(F.col(c)).alias(c) if c in floating else F.col(c) for c in df.columns])
