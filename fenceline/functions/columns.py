"""Column helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

# Fixed value: an odd multiplier of 27 bits whose products with 32-bit numbers spread over all bits.
MIX = 0x45D9F3B


def number(name: str) -> Column:
    """Column as double with NaN turned into NULL (aggregates skip NULL, not NaN)."""
    value = F.col(name).cast("double")
    return F.when(~F.isnan(value), value)


def coerced(name: str) -> Column:
    """Like number() for text input: what does not parse becomes NULL."""
    value = F.col(name).try_cast("double")
    return F.when(~F.isnan(value), value)


def numbers(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    return df.select(*keep, *[number(c).alias(c) for c in columns])


def nan_to_null(df: DataFrame) -> DataFrame:
    """Turn NaN into NULL in every floating column, once, at the door."""
    floating = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(
        *[F.when(~F.isnan(c), F.col(c)).alias(c) if c in floating else F.col(c) for c in df.columns]
    )


def melt(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), value: str = "x") -> DataFrame:
    """Long form (by..., variable, x) of numeric columns, missing values left out."""
    wide = numbers(df, columns, by)
    return wide.unpivot(list(by), list(columns), "variable", value).where(F.col(value).isNotNull())


def melt_text(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), value: str = "value") -> DataFrame:
    wide = df.select(*by, *[F.col(c).cast("string").alias(c) for c in columns])
    return wide.unpivot(list(by), list(columns), "variable", value).where(F.col(value).isNotNull())


def add(columns: Iterable[Column]) -> Column:
    columns = list(columns)
    total = columns[0]
    for c in columns[1:]:
        total = total + c
    return total


def any_of(columns: Iterable[Column]) -> Column:
    result = F.lit(False)
    for c in columns:
        result = result | c
    return result


def finite(value: Column, default: float = 0.0) -> Column:
    """Replace NULL, NaN and infinities by a default."""
    bad = value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
    return F.when(bad, F.lit(default)).otherwise(value)


def counted_uniform(row: Column, seed: int, axis: int) -> Column:
    """A number in [0, 1) that depends on the row's number, the seed and the axis alone, not on partitions.

    Two rounds of multiply and shift over 32 bits; rows beyond 2**32 go on with another start.
    """
    mask = F.lit((1 << 32) - 1)

    def mixed(h: Column) -> Column:
        return (h.bitwiseXOR(F.shiftright(h, 16)) * F.lit(MIX)).bitwiseAND(mask)

    start = F.lit((seed * 40503 + axis * 2654435761) & ((1 << 32) - 1))
    h = (row.bitwiseAND(mask) + F.shiftright(row, 32) * F.lit(97) + start).bitwiseAND(mask)
    h = mixed(mixed(h))
    return h.bitwiseXOR(F.shiftright(h, 16)) / F.lit(2.0**32)


def significance_code(p: Column) -> Column:
    return (
        F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").when(p < 0.1, ".").otherwise("")
    )


def p_value_text(p: Column, small_decimals: int = 6, decimals: int = 4) -> Column:
    """p as text: exponent form below 1e-6, more decimals below 1e-3."""
    return (
        F.when(p < 1e-6, F.format_string("%.2e", p))
        .when(p < 1e-3, F.format_string(f"%.{small_decimals}f", p))
        .otherwise(F.format_string(f"%.{decimals}f", p))
    )


def effect_label(size: Column) -> Column:
    """Band of a phi or Cramer's V."""
    return (
        F.when(size < 0.1, "small")
        .when(size < 0.3, "small to medium")
        .when(size < 0.5, "medium")
        .otherwise("large")
    )


def correlation_strength(r: Column) -> Column:
    size = F.abs(r)
    return (
        F.when(size >= 0.8, "very strong")
        .when(size >= 0.6, "strong")
        .when(size >= 0.4, "moderate")
        .when(size >= 0.2, "weak")
        .when(size > 0, "very weak")
        .otherwise("none")
    )


def keyword_category(name: str, table: Mapping[str, Sequence[str]], default: str = "other") -> str:
    """First category of the table that has a keyword within the name, regardless of case."""
    low = name.lower()
    return next((category for category, words in table.items() if any(w.lower() in low for w in words)), default)


def scalar_function(function, *arguments: Column) -> Column:
    """Apply a scalar Python function to an already aggregated result, Arrow-batched.

    A NULL argument gives NULL. Never use it on input rows.
    """
    @F.pandas_udf("double")
    def apply(frame: pd.DataFrame) -> pd.Series:
        return pd.Series(
            [
                None if any(pd.isna(v) for v in row) else function(*row)
                for row in frame.itertuples(index=False, name=None)
            ],
            dtype="float64",
        )

    return apply(F.struct(*[a.alias(f"a{i}") for i, a in enumerate(arguments)]))
