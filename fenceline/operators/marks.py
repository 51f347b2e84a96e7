"""Marking rows from a list of outlier ids and tabulating which detector flagged what."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import any_of
from ..functions.lineage import broadcast_if_small
from ..functions.rank import TASK_ROWS, ranked_values


def normal_id(value: Column) -> Column:
    """Id as trimmed text with a trailing .0 removed (1.0 is 1)."""
    return F.regexp_replace(F.trim(value.cast("string")), r"^(-?\d+)\.0+$", "$1")


def mark_outliers(df: DataFrame, ids: DataFrame, id_column: str, ids_column: str = "id") -> DataFrame:
    """df with is_outlier: true for all rows whose id is listed."""
    keys = ids.select(F.trim(F.col(ids_column).cast("string")).alias("_key")).distinct()
    marked = df.withColumn("_key", F.trim(F.col(id_column).cast("string"))).join(
        broadcast_if_small(keys.withColumn("_hit", F.lit(True))), "_key", "left"
    )
    return marked.select(*[F.col(c) for c in df.columns], F.coalesce(F.col("_hit"), F.lit(False)).alias("is_outlier"))


def mark_positions(df: DataFrame, ids: DataFrame, row_id: str, ids_column: str = "id") -> DataFrame:
    """df with is_outlier from ids of the form ID_n, or a bare n, that name the row itself."""
    text = F.regexp_replace(F.trim(F.col(ids_column).cast("string")), "^ID_", "")
    keys = ids.select(text.try_cast("long").alias("_key")).dropna().distinct()
    marked = df.join(
        broadcast_if_small(keys.withColumn("_hit", F.lit(True))), df[row_id].cast("long") == F.col("_key"), "left"
    )
    return marked.select(*[df[c] for c in df.columns], F.coalesce(F.col("_hit"), F.lit(False)).alias("is_outlier"))


def unmatched_ids(df: DataFrame, ids: DataFrame, id_column: str, ids_column: str = "id") -> DataFrame:
    """Listed ids no row has."""
    keys = ids.select(F.trim(F.col(ids_column).cast("string")).alias("id")).distinct()
    present = df.select(F.trim(F.col(id_column).cast("string")).alias("id"))
    return keys.join(present, "id", "left_anti")


def mark_listed(
    df: DataFrame, ids: DataFrame, id_column: str, row_id: str, ids_column: str = "id"
) -> tuple[DataFrame, DataFrame]:
    """(df with is_outlier, listed entries that name nothing) for a list that mixes ids and positions.

    An entry that some row has as its id marks all rows of that id. Any other entry of
    the form ID_n or n names the row with row_id n.
    """
    entry = F.trim(F.col(ids_column).cast("string"))
    listed = ids.select(entry.alias("_key")).dropna().distinct()
    present = df.select(F.trim(F.col(id_column).cast("string")).alias("_key")).distinct()
    named = listed.join(present, "_key", "left_semi").select("_key", F.lit(True).alias("_named"))
    rest = listed.join(present, "_key", "left_anti").withColumn("_place", F.regexp_replace("_key", "^ID_", "").try_cast("long"))
    rows = df.select(F.col(row_id).cast("long").alias("_place")).distinct()
    placed = rest.join(rows, "_place", "left_semi").select("_place", F.lit(True).alias("_placed")).distinct()
    keyed = df.withColumn("_key", F.trim(F.col(id_column).cast("string"))).withColumn("_place", F.col(row_id).cast("long"))
    marked = keyed.join(broadcast_if_small(named), "_key", "left").join(broadcast_if_small(placed), "_place", "left")
    flag = F.coalesce("_named", "_placed", F.lit(False)).alias("is_outlier")
    unmatched = rest.join(rows, "_place", "left_anti").select(F.col("_key").alias("id"))
    return marked.select(*df.columns, flag), unmatched


def mark_occurrences(
    df: DataFrame, ids: DataFrame, id_column: str, row_id: str, ids_column: str = "id", task_rows: int = TASK_ROWS
) -> DataFrame:
    """df with is_outlier: an id listed m times marks its first m rows by row_id."""
    listed = ids.select(normal_id(F.col(ids_column)).alias("_key")).groupBy("_key").agg(F.count("*").alias("_m"))
    keyed = df.select(normal_id(F.col(id_column)).alias("_key"), F.col(row_id).alias("x"))
    candidates = keyed.join(broadcast_if_small(listed), "_key").select("_key", "_m", "x")
    ranked = ranked_values(candidates, ["_key", "_m"], "x", task_rows)
    hits = ranked.where(F.col("below") < F.col("_m")).select(F.col("x").alias(row_id), F.lit(True).alias("_hit"))
    marked = df.join(broadcast_if_small(hits), row_id, "left")
    return marked.select(*df.columns, F.coalesce(F.col("_hit"), F.lit(False)).alias("is_outlier"))


def flags_long(df: DataFrame, row_id: str, methods: Mapping[str, Column]) -> DataFrame:
    """Long flags (row_id, method) of the rows each method flags."""
    hits = F.array(*[F.when(flag, F.lit(name)) for name, flag in methods.items()])
    return df.select(row_id, F.explode(F.array_compact(hits)).alias("method"))


def union_flags(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Rows flagged by any of several flag tables, once each."""
    result = first
    for other in others:
        result = result.unionByName(other)
    return result.distinct()


def any_flag(columns: Sequence[str]) -> Column:
    return any_of(F.coalesce(F.col(c), F.lit(False)) for c in columns)


def compare_sets(first: DataFrame, second: DataFrame, column: str) -> DataFrame:
    """Members of two sets labelled first only, second only or common."""
    a = first.select(column).distinct().withColumn("_a", F.lit(1))
    b = second.select(column).distinct().withColumn("_b", F.lit(1))
    side = F.when(F.col("_b").isNull(), "first only").when(F.col("_a").isNull(), "second only").otherwise("common")
    return a.join(b, column, "full").select(column, side.alias("side"))


def vote_matrix(flags: DataFrame, row_id: str, methods: Sequence[str]) -> DataFrame:
    """One row per flagged row with a 0/1 column per method."""
    return (
        flags.groupBy(row_id)
        .pivot("method", list(methods))
        .agg(F.max(F.lit(1)))
        .fillna(0, subset=list(methods))
    )


def method_flow(flags: DataFrame, final_ids: DataFrame, row_id: str) -> DataFrame:
    """How many rows flagged by each method ended as outlier or normal."""
    verdicts = flags.join(
        final_ids.select(row_id).distinct().withColumn("_final", F.lit(True)), row_id, "left"
    )
    verdict = F.when(F.col("_final"), "outlier").otherwise("normal")
    return verdicts.groupBy("method", verdict.alias("verdict")).agg(F.count("*").alias("rows"))
