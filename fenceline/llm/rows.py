"""Shared scaffolding: a function over whole texts as one map over Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.lineage import shared_folder

TEXT = "__text"

SPARK_TYPES = {
    pa.string(): "string",
    pa.int64(): "bigint",
    pa.int32(): "int",
    pa.float64(): "double",
    pa.bool_(): "boolean",
    pa.binary(): "binary",
    pa.list_(pa.float64()): "array<double>",
    pa.list_(pa.int64()): "array<bigint>",
    pa.list_(pa.string()): "array<string>",
}


def column(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col(f"`{name}`")


def numbered(df: DataFrame, name: str) -> DataFrame:
    """df with a number of every row in column ``name``, written once to the shared folder and read from there.

    Numbers taken while reading hold for one read only: a table's partitions follow the
    executors that are there when it is read. Stored, they stay with their rows.
    """
    path = f"{shared_folder(df.sparkSession)}/numbered-{uuid.uuid4().hex}"
    df.withColumn(name, F.monotonically_increasing_id()).write.parquet(path)
    return df.sparkSession.read.parquet(path)


def ddl(df: DataFrame, fields: Sequence[tuple[str, pa.DataType]]) -> str:
    """All of df's columns but the last, the text, and then the fields."""
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields[:-1]]
    return ", ".join(kept + [f"`{name}` {SPARK_TYPES[kind]}" for name, kind in fields])


def over_texts(
    df: DataFrame,
    text: str,
    keep: Sequence[str],
    function: Callable[[list[str]], Sequence],
    fields: Sequence[tuple[str, pa.DataType]],
    only: str | None = None,
    at_once: int = 1 << 30,
) -> DataFrame:
    """Columns ``keep`` of df with what ``function`` makes of every whole text.

    function gets the texts (or binaries) of a batch (null read as empty) and returns one
    sequence per field. A kept column of a field's name is replaced by the field.
    ``only`` names a boolean field: rows where it is false are left out. ``at_once`` is
    the most rows of a batch that function gets.
    """
    names = [name for name, _ in fields]
    keep = [c for c in keep if c not in names]
    # Kept columns travel under plain names, as a name with a dot cannot.
    empty = F.lit("").cast(df.select(column(text)).schema[0].dataType)
    work = df.select(*[column(c).alias(f"kept{i}") for i, c in enumerate(keep)], F.coalesce(column(text), empty).alias(TEXT))
    kinds = [kind for _, kind in fields]
    out_names = [*work.columns[:-1], *names]
    flag = names.index(only) if only else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, at_once) for whole in batches for at in range(0, max(1, whole.num_rows), at_once)):
            made = [pa.array(v, type=k) for v, k in zip(function(batch.column(batch.num_columns - 1).to_pylist()), kinds)]
            out = pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=out_names)
            yield out.filter(made[flag]) if flag is not None else out

    return work.mapInArrow(run, ddl(work, fields)).toDF(*keep, *names)
