"""Distinct values of all columns from one fold, without copies of rows."""

import contextlib
import io

from pyspark.sql import functions as F

from fenceline.operators import profile


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_fold(spark):
    rows = [(1, 1.0, "a", True, None), (2, -0.0, "a", True, None), (3, 0.0, None, False, None), (4, float("nan"), "", None, None), (5, None, "b", True, None)]
    df = spark.createDataFrame(rows, "`i.d` long, x double, s string, b boolean, n int").repartition(3)
    found = profile.distinct_values(df, df.columns)
    assert found == [(5, 0, 5), (2, 2, 5), (3, 1, 5), (2, 1, 5), (0, 5, 5)]
    assert profile.distinct_values(df.limit(0), ["x", "s"]) == [(0, 0, 0)] * 2
    kinds = {r["variable"]: (r["kind"], r["distinct_values"], r["rows"]) for r in profile.infer_kinds(df).collect()}
    assert kinds == {"i.d": ("continuous", 5, 5), "x": ("continuous", 3, 5), "s": ("nominal", 4, 5), "b": ("nominal", 3, 5), "n": ("continuous", 1, 5)}


def test_plans_have_no_expand(spark):
    df = spark.range(1000).select("id", (F.col("id") % 7).alias("a"), (F.col("id") % 3).cast("string").alias("s"))
    assert "Expand" not in plan(profile.value_fold(df, df.columns)) and "Expand" not in plan(profile.categorical_summary(df, ["s", "a"]))
    assert "Expand" not in plan(profile.numeric_summary(df, ["id", "a"]))
    assert [tuple(r) for r in profile.categorical_summary(df, ["s"]).collect()] == [("s", 3, 0, "0")]
    assert [r["unique_values"] for r in profile.numeric_summary(df, ["id", "a"]).collect()] == [1000, 7]
