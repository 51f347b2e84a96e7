import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fenceline.functions.rank import (
    average_rank, bounds_below, column_quantiles, group_quantiles, ranked_values, rows_with_ranks,
)
from fenceline.operators import correlate
from fenceline.operators.correlate import rank_correlations


def skewed_frame(spark, rows=5000, seed=7):
    """One value and one group hold about a third of all rows each."""
    rng = np.random.default_rng(seed)
    x = np.where(rng.random(rows) < 1 / 3, 5.0, np.round(rng.exponential(20, rows), 2))
    g = np.where(rng.random(rows) < 1 / 3, "hot", rng.integers(0, 6, rows).astype(str))
    data = [(i, str(g[i]), float(x[i])) for i in range(rows)]
    return spark.createDataFrame(data, "row_id long, g string, x double"), g, x


@pytest.mark.parametrize("task_rows", [1_000_000, 1000, 100, 20])
def test_column_quantiles_are_exact_on_both_paths(spark, task_rows):
    df, _, x = skewed_frame(spark)
    probs = [0.0, 0.25, 0.3333, 0.5, 0.75, 0.951, 1.0]
    got = column_quantiles(df, ["x"], probs, task_rows=task_rows)["x"]
    assert got == pytest.approx(list(np.quantile(x, probs)), abs=1e-9)


def test_quantiles_of_many_tasks_of_rows_take_two_scans(spark, monkeypatch):
    """No rounds of narrowing, each with its own scans, until brackets hold too many rows."""
    from fenceline.functions import rank

    monkeypatch.setattr(rank, "_select_quantiles", lambda *_: pytest.fail("narrowed in rounds"))
    df, _, x = skewed_frame(spark)
    got = column_quantiles(df, ["x"], [0.25, 0.95], task_rows=len(x) // 40)["x"]
    assert got == pytest.approx(list(np.quantile(x, [0.25, 0.95])), abs=1e-9)


@pytest.mark.parametrize("task_rows", [1_000_000, 50])
def test_group_quantiles(spark, task_rows):
    df, g, x = skewed_frame(spark)
    rows = group_quantiles(df, ["g"], ["x"], [0.25, 0.5], task_rows=task_rows).collect()
    got = {(r.g, r.p): r.value for r in rows}
    assert len(got) == 2 * len(set(g))
    for (key, p), value in got.items():
        assert value == pytest.approx(np.quantile(x[g == key], p), abs=1e-9)


@pytest.mark.parametrize("task_rows", [1_000_000, 100, 10])
def test_ranks_of_distinct_values(spark, task_rows):
    df, g, x = skewed_frame(spark)
    rows = ranked_values(df, ["g"], "x", task_rows).withColumn("rank", average_rank()).collect()
    assert sum(r.cnt for r in rows) == len(x)
    for r in rows:
        mine = x[g == r.g]
        assert r.n == mine.size
        assert r.below == (mine < r.x).sum()
        assert r["rank"] == pytest.approx((mine < r.x).sum() + ((mine == r.x).sum() + 1) / 2)


def test_bracketed_quantiles_match_percentiles(spark):
    from fenceline.functions.rank import _bracketed_quantiles

    df, _, x = skewed_frame(spark, rows=8000)
    probs = [0.0, 0.1, 0.25, 1 / 3, 0.5, 0.75, 0.99, 1.0]
    for accuracy in (50, 1000):
        got = _bracketed_quantiles(df.select("x"), ["x"], probs, accuracy)["x"]
        assert got == pytest.approx(list(np.quantile(x, probs)), abs=1e-9)


@pytest.mark.parametrize("task_rows", [1_000_000, 400, 30])
def test_ranks_of_all_columns_in_one_exchange(spark, task_rows):
    """Hot values, a constant column, a null group and names that clash with helper names."""
    rng = np.random.default_rng(3)
    rows = 3000
    hot = np.where(rng.random(rows) < 1 / 3, 5.0, np.round(rng.exponential(20, rows), 1))
    frame = pd.DataFrame({"g": rng.choice(["a", "b", None], rows), "_row": hot, "x y": rng.normal(size=rows), "_slot": 1.0})
    columns = ["_row", "x y", "_slot"]
    got = rows_with_ranks(spark.createDataFrame(frame), columns, ["g"], task_rows).toPandas()
    want = frame.groupby("g", dropna=False)[columns].rank()
    want.insert(0, "g", frame["g"])
    order = ["g", *columns]
    pd.testing.assert_frame_equal(
        got.fillna("-").sort_values(order, ignore_index=True), want.fillna("-").sort_values(order, ignore_index=True), check_dtype=False
    )


def test_ranks_of_all_columns_of_an_empty_table(spark):
    df = spark.createDataFrame([], "g string, x double, y double")
    assert rows_with_ranks(df, ["x", "y"], ["g"]).count() == 0


def test_one_exchange_of_values_for_any_number_of_columns(spark):
    df = spark.range(2000).select(*[F.rand(i).alias(f"c{i}") for i in range(6)])
    plan = rows_with_ranks(df, df.columns, (), 100)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2  # into value pieces, and rows together again


@pytest.mark.parametrize("length", [0, 1, 2, 3, 7, 8, 9, 100])
def test_binary_search_among_bounds(spark, length):
    bounds = F.array(*[F.lit(2.0 * i) for i in range(length)]) if length else F.array().cast("array<double>")
    df = spark.range(-2, 2 * length + 3).select(F.col("id").cast("double").alias("x"))
    rows = df.select("x", bounds_below(bounds, F.col("x"), length + 1).alias("n")).collect()
    assert all(r.n == sum(2.0 * i < r.x for i in range(length)) for r in rows)


def test_spearman_is_the_same_on_both_paths(spark, monkeypatch):
    df, _, _ = skewed_frame(spark)
    df = df.selectExpr("row_id % 2 = 0 AS odd", "x", "double(row_id * 7919 % 5003) AS y", "double(row_id % 3) AS z")
    few = rank_correlations(df, ["x", "y", "z"], ["odd"]).orderBy("odd", "first", "second").collect()
    monkeypatch.setattr(correlate, "FOLDED_VALUES", 0)
    many = rank_correlations(df, ["x", "y", "z"], ["odd"], 300).orderBy("odd", "first", "second").collect()
    assert len(few) == 6
    for a, b in zip(few, many):
        assert a[:3] == b[:3] and b.r == pytest.approx(a.r, abs=1e-12) and a.n == b.n
