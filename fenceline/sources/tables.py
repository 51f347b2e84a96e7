"""Sources and sinks: CSV and parquet in, pages and samples out, processed tables with lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.columns import nan_to_null
from ..functions.rank import TASK_ROWS, ranked_values

# Rows the driver may merge for one page; deeper pages are located by rank.
PAGE_MERGE_ROWS = 100_000

# Common Python names of the charsets Spark knows under another one.
CHARSETS = {"latin-1": "iso-8859-1", "latin1": "iso-8859-1", "windows-1252": "cp1252"}

# Bytes 0x80 to 0x9F in code page 1252. In ISO 8859-1 they are control characters that no text holds;
# five are free in the code page and stay as they are. All other bytes mean the same in both.
CODE_PAGE = {
    0x80: "€", 0x82: "‚", 0x83: "ƒ", 0x84: "„", 0x85: "…", 0x86: "†", 0x87: "‡", 0x88: "ˆ", 0x89: "‰", 0x8A: "Š", 0x8B: "‹", 0x8C: "Œ", 0x8E: "Ž",
    0x91: "‘", 0x92: "’", 0x93: "“", 0x94: "”", 0x95: "•", 0x96: "–", 0x97: "—", 0x98: "˜", 0x99: "™", 0x9A: "š", 0x9B: "›", 0x9C: "œ", 0x9E: "ž", 0x9F: "Ÿ",
}


def detect_encodings(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """file, encoding: utf-8 where every line is valid UTF-8, else cp1252 if a line has a byte from 0x80 to 0x9F, else latin-1.

    One scan over all bytes of the files, line by line; a row per file comes out.
    """
    raw = F.hex(F.col("value").cast("binary"))
    line = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.is_valid_utf8("value").alias("valid"), F.regexp_like(raw, F.lit("^(..)*[89].")).alias("control"),
    )
    found = line.groupBy("file").agg(F.every("valid").alias("valid"), F.some("control").alias("control"))
    return found.select("file", F.when(F.col("valid"), "utf-8").when(F.col("control"), "cp1252").otherwise("latin-1").alias("encoding"))


def read_csv(
    spark: SparkSession, path: str, encoding: str = "UTF-8", delimiter: str = ",",
    schema: T.StructType | None = None,
) -> DataFrame:
    """CSV with a header. Lines with too many fields are skipped; short lines are filled with NULL.

    Types are inferred in one pass over the file unless a schema is given; give one
    for large inputs. encoding="auto" finds every file's encoding first (one more
    scan) and reads the files of one encoding together, with the columns of the first.
    """
    if encoding != "auto":
        return read_csv_lines(spark, path, encoding, delimiter, schema)[0]
    files: dict[str, list[str]] = {}
    for r in detect_encodings(spark, path).collect():  # a row per file
        files.setdefault(r["encoding"], []).append(r["file"])
    out = None
    for charset in ("utf-8", "latin-1", "cp1252"):
        if charset in files:
            part = read_csv_lines(spark, sorted(files[charset]), charset, delimiter, schema)[0]
            schema = schema or part.schema
            out = part if out is None else out.union(part)
    return out if out is not None else read_csv_lines(spark, path, "utf-8", delimiter, schema)[0]


def read_csv_lines(
    spark: SparkSession, path: str | Sequence[str], encoding: str = "UTF-8", delimiter: str = ",",
    schema: T.StructType | None = None, header: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """(table as read_csv() gives it, rejected lines as line, fields and the values that fit).

    Ask the rejected lines for values too: Spark reads no CSV for a corrupt-line column alone.
    """
    charset = CHARSETS.get(encoding.lower(), encoding.lower())
    page = charset == "cp1252"  # outside Spark's list of charsets: read as ISO 8859-1, then by the table above
    options = {"header": header, "encoding": "iso-8859-1" if page else charset, "sep": delimiter}
    if schema is None:
        schema = spark.read.options(**options).csv(path, inferSchema=True).schema
        if page:
            table = str.maketrans(CODE_PAGE)
            schema = T.StructType([T.StructField(f.name.translate(table), f.dataType, f.nullable) for f in schema.fields])
    corrupt = "_fenceline_corrupt"
    # A line is judged by all its fields, so none may be pruned.
    parsed = (
        spark.read.options(**options, columnPruning=False)
        .schema(T.StructType([*schema.fields, T.StructField(corrupt, T.StringType())]))
        .csv(path, mode="PERMISSIVE", columnNameOfCorruptRecord=corrupt)
    )
    if page:
        bytes_, characters = "".join(map(chr, CODE_PAGE)), "".join(CODE_PAGE.values())
        parsed = parsed.withColumns({f.name: F.translate(F.col(f"`{f.name}`"), bytes_, characters) for f in parsed.schema.fields if f.dataType == T.StringType()})
    # Only lines the parser marked are counted: separators outside quotes.
    fields = F.size(F.split(F.col(corrupt), f"\\Q{delimiter}\\E(?=(?:[^\"]*\"[^\"]*\")*[^\"]*$)"))
    kept = parsed.where(F.col(corrupt).isNull() | (fields <= len(schema.fields)))
    rejected = parsed.where(F.col(corrupt).isNotNull() & (fields > len(schema.fields)))
    return nan_to_null(kept.drop(corrupt)), rejected.select(
        F.col(corrupt).alias("line"), fields.alias("fields"), F.struct(*[F.col(f"`{c}`") for c in schema.names]).alias("values")
    )


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return nan_to_null(df.select(*columns) if columns else df)


def require_rows(df: DataFrame) -> DataFrame:
    """Raise if the table has no columns or no rows."""
    if not df.columns:
        raise ValueError("the table has no columns")
    if df.isEmpty():
        raise ValueError("the table has no rows")
    return df


def preview(df: DataFrame, row_id: str, n: int = 10) -> DataFrame:
    """First n rows as text; missing values stay NULL."""
    return df.orderBy(row_id).limit(n).select(*[F.col(c).cast("string").alias(c) for c in df.columns])


def page_counts(df: DataFrame, page_size: int) -> DataFrame:
    """One row: total_rows, page_size, total_pages."""
    return df.agg(F.count("*").alias("total_rows")).select(
        "total_rows",
        F.lit(page_size).cast("long").alias("page_size"),
        F.ceil(F.col("total_rows") / page_size).alias("total_pages"),
    )


def page(df: DataFrame, row_id: str, number: int, size: int, task_rows: int = TASK_ROWS) -> DataFrame:
    """Page `number` (from 1) in row_id order.

    Shallow pages are a top-n; for deep ones the position of every row_id is found
    by distributed rank, so no task or driver merges the rows before the page.
    """
    skipped = (number - 1) * size
    if skipped + size <= PAGE_MERGE_ROWS:
        return df.orderBy(row_id).offset(skipped).limit(size)
    keyed = df.select(F.lit(0).alias("table"), F.col(row_id).alias("x"))
    wanted = ranked_values(keyed, ["table"], "x", task_rows).where(
        F.col("below").between(skipped, skipped + size - 1)
    )
    ids = wanted.select(F.col("x").alias(row_id))
    return df.join(F.broadcast(ids) if size <= PAGE_MERGE_ROWS else ids, row_id, "left_semi").orderBy(row_id)


def next_page(df: DataFrame, row_id: str, after, size: int) -> DataFrame:
    """The page following row_id `after`; the condition reaches the scan."""
    return df.where(F.col(row_id) > F.lit(after)).orderBy(row_id).limit(size)


def sample_table(df: DataFrame, columns: Sequence[str], row_id: str, n: int = 100) -> DataFrame:
    """Chosen columns of the first n rows as text: floats with two decimals, missing as N/A."""
    floating = {
        f.name for f in df.schema.fields
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType))
    }
    first = df.select(*dict.fromkeys([row_id, *columns])).orderBy(row_id).limit(n)
    texts = []
    for c in columns:
        value = F.col(c)
        text = F.format_string("%.2f", value.cast("double")) if c in floating else value.cast("string")
        missing = value.isNull() | F.isnan(value) if c in floating else value.isNull()
        texts.append(F.when(missing, F.lit("N/A")).otherwise(text).alias(c))
    return first.select(*texts)


def write_processed(
    df: DataFrame, path: str, source: str, steps: Sequence[str], rows_before: int, format: str = "parquet"
) -> DataFrame:
    """Write a processed table and return its lineage row.

    The written table is counted, so the input plan runs once.
    """
    writer = df.write.mode("errorifexists").format(format)
    if format == "csv":
        writer = writer.option("header", True)
    writer.save(path)
    spark = df.sparkSession
    written = spark.read.schema(df.schema).format(format)
    if format == "csv":
        written = written.option("header", True)
    return written.load(path).agg(F.count("*").alias("rows_after")).select(
        F.lit(source).alias("source"),
        F.lit(" > ".join(steps)).alias("steps"),
        F.lit(rows_before).cast("long").alias("rows_before"),
        "rows_after",
        (F.lit(rows_before) - F.col("rows_after")).alias("rows_removed"),
    )


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the cluster's shared folder; a local temporary one only in local mode."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None
    )
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        shared = tempfile.mkdtemp(prefix="fenceline-")
    return os.path.join(shared, f"{name}-{uuid.uuid4().hex}")
