"""Small tables of awkward rows, shared by the tests of this folder."""

from pyspark.sql import types as T

LONG = "Lorem ipsum 4111 1111 1111 1111, " * 20_000

ROWS = [
    (1, "Plain words with an address a.b@example.com and 10.0.0.1 in them.", "en", "a"),
    (2, None, "en", "a"),
    (3, "", None, "b"),
    (4, "word", "en", None),
    (None, "A row without an id, password = hunter2hunter2 here", "en", "a"),
    (5, LONG, "en", "b"),
    (6, "same text twice " * 9, "en", "a"),
    (7, "same text twice " * 9, "en", "a"),
    (7, "same text twice " * 9, "en", "a"),
    (7, "another text under a repeated id", "en", "b"),
    (8, " \t\n\x0b ", "en", "c"),
    (9, "naïve Straße İstanbul ſ 日本語 🙂 é", "de", "c"),
    (10, "tail blank ", "en", "c"),
    (11, "two  blanks and\n\nlines", "en", "c"),
]

SCHEMA = "doc_id bigint, text string, lang string, source string"

#: Names that operators use for their own columns.
CLASHES = ["score", "features", "fingerprint", "component_id", "row", "value", "id", "b", "size", "target", "taken", "start", "kind", "n_chars", "shard", "node", "m.gap"]


def documents(spark, rows=ROWS, clashes=True):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA)
    if clashes:
        df = df.select("*", *[F.lit("x").alias(c) for c in CLASHES])
    return df


def nothing(spark):
    return documents(spark, [])


def stored(df, folder):
    """Written and read again, as operators that read twice ask for."""
    path = f"{folder}/table"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


VECTORS = [
    (0, [0.5, -0.25, 1.0]), (100, [0.5, -0.25, 1.0]), (1, [0.5, -0.25, 1.0]), (1, [0.1, 0.2, 0.3]), (2, None), (3, [None, 1.0, 2.0]),
    (4, [float("nan"), 0.0, 0.0]), (5, [float("inf"), 0.0, 0.0]), (None, [1.0, 1.0, 1.0]), (6, [1.0, 2.0]), (7, []), (200, [1.0, 2.0]),
    (8, [-0.5, 0.25, -1.0]), (300, [9.0]),
]


def vectors(spark, rows=VECTORS):
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("score", T.StringType())])
    return spark.createDataFrame([(*r, "x") for r in rows], schema)
