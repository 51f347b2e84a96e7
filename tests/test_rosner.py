"""Rosner's peeling by bins against the definition, one row at a time."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fenceline.functions import special
from fenceline.operators import rosner


def peel(values, ids, k, stop, alpha=0.05):
    """(id, value, statistic) of every step up to the last that counts."""
    left = sorted((v, i) for v, i in zip(values, ids) if v is not None)
    total, steps, kept = len(left), [], 0
    while len(steps) < min(k, total - 1):
        x = np.array([v for v, _ in left])
        n, mean, std = len(x), x.mean(), x.std(ddof=1) if len(x) > 1 else 0.0
        if n < 3 or std <= 1e-12 * max(1.0, abs(mean)):
            break
        low = left[0]
        high = min((i, v) for v, i in left if v == left[-1][0])[::-1]
        down, up = mean - low[0], high[0] - mean
        take = low if down > up * (1 + 1e-12) or math.isclose(down, up, rel_tol=1e-12) and low[1] < high[1] else high
        statistic = abs(take[0] - mean) / std
        good = rosner.significant(statistic, n, alpha)
        if not good and stop == "first":
            break
        steps.append((take[1], take[0], statistic))
        left.remove(take)
        if good:
            kept = len(steps)
    return steps[:kept]


def tables():
    rng = np.random.default_rng(11)
    yield "normal", rng.normal(0, 1, 400)
    yield "planted", np.concatenate([rng.normal(0, 1, 500), [9.0, 8.5, -9.5, 8.0, 7.9, -30.0]])
    yield "cauchy", rng.standard_cauchy(900)
    yield "lognormal", rng.lognormal(0, 2, 900)
    yield "two sides", np.concatenate([rng.normal(0, 1, 600), rng.normal(40, 1, 20), rng.normal(-40, 1, 21)])
    yield "copies", np.concatenate([rng.integers(-3, 4, 700).astype(float), [50.0] * 30, [-51.0] * 25, [20.0] * 9])
    yield "masked", np.concatenate([rng.normal(0, 1, 300), [6.0, 6.1, 6.2, 6.3, 6.25, 6.15]])
    yield "uniform", rng.uniform(-1, 1, 500)
    yield "moved", 1e6 + rng.standard_t(2, 800)


@pytest.mark.parametrize("name, values", list(tables()), ids=lambda x: x if isinstance(x, str) else "")
@pytest.mark.parametrize("stop, settings", [("first", {}), ("first", {"page": 5, "bins": 16}), ("esd", {"page": 40, "bins": 32}), ("first", {"k": 3}), ("esd", {"k": 60, "page": 1})])
def test_against_the_definition(spark, name, values, stop, settings):
    ids = np.random.default_rng(1).permutation(len(values))
    k = settings.get("k") or max(1, int(0.1 * len(values)))
    want = peel(values.tolist(), ids.tolist(), k, stop)
    df = spark.createDataFrame([(int(i), float(v)) for i, v in zip(ids, values)], "row_id long, x double").repartition(3)
    fit = rosner.fit_rosner(df, "x", "row_id", stop=stop, **settings)
    assert {r["row_id"] for r in df.where(fit.flag()).collect()} == {i for i, _, _ in want} and fit.removed == len(want)
    steps = sorted(rosner.rosner_steps(df, fit).collect(), key=lambda r: r["step"])
    assert [r["step"] for r in steps] == list(range(1, len(want) + 1))
    assert [(r["row_id"], r["value"]) for r in steps] == [(i, v) for i, v, _ in want]
    assert [r["statistic"] for r in steps] == pytest.approx([s for _, _, s in want], rel=1e-6)
    for r in steps[:5]:
        n = len(values) - r["step"] + 1
        assert r["critical"] == pytest.approx(rosner.critical(n, 0.05))
        t = r["statistic"] * math.sqrt(n / (n - 2 + r["statistic"] ** 2))
        assert r["p_value"] == pytest.approx(min(1.0, 2 * n * special.t_sf(t, n - 2)))


def test_a_run_that_the_limit_cuts(spark):
    """Copies beyond the limit stay; those with the smallest ids go."""
    values = [0.0, 1.0, -1.0] * 60 + [100.0] * 12
    df = spark.createDataFrame([(1000 - i, v) for i, v in enumerate(values)], "row_id long, x double")
    for task_rows in (1_000_000, 4):
        fit = rosner.fit_rosner(df, "x", "row_id", k=5, task_rows=task_rows)
        flagged = sorted(r["row_id"] for r in df.where(fit.flag()).collect())
        assert flagged == sorted(1000 - i for i, v in enumerate(values) if v == 100.0)[:5] and fit.removed == 5
        assert [r["row_id"] for r in sorted(rosner.rosner_steps(df, fit, task_rows=task_rows).collect(), key=lambda r: r["step"])] == flagged


def test_many_rows_in_few_stretches(spark):
    """Nine hundred of 60000 rows lie far out on both sides; what the driver walks is short."""
    df = spark.range(60_000).select(
        F.col("id").alias("row_id"),
        F.when(F.col("id") % 100 == 0, 50.0 + F.col("id") / 1000.0).when(F.col("id") % 200 == 1, -60.0 - F.col("id") / 1500.0).otherwise(F.sin(F.col("id").cast("double"))).alias("x"),
    )
    fit = rosner.fit_rosner(df, "x", "row_id", page=50)
    assert fit.removed == 900 and df.where(fit.flag()).count() == 900
    assert df.where(fit.flag()).where("abs(x) < 40").count() == 0
    assert rosner.rosner_steps(df, fit).agg(F.count_distinct("step"), F.max("step")).first() == (900, 900)


@pytest.mark.parametrize("stop, k, copies", [("first", None, 1), ("esd", None, 3), ("first", 1000, 3), ("esd", 6001, 1)])
def test_dense_tails_on_both_sides(spark, monkeypatch, stop, k, copies):
    """No state between bins of two dense tails is certain; the driver still holds a piece of either end at a time."""
    p = (np.arange(6000) + 0.5) / 6000
    values = np.repeat(np.tan(np.pi * (p - 0.5)) * np.where(p < 0.5, 1.0, 1.0 + 0.1 * p), copies)
    ids = np.random.default_rng(2).permutation(len(values))
    df = spark.createDataFrame([(int(i), float(v)) for i, v in zip(ids, values)], "row_id long, x double").repartition(3)
    whole = rosner.fit_rosner(df, "x", "row_id", k=k, stop=stop, page=10**9)
    want = sorted(tuple(r) for r in rosner.rosner_steps(df, whole).select("step", "row_id").collect())
    held, walk = [], rosner.walk
    monkeypatch.setattr(rosner, "walk", lambda state, runs, *a, **b: held.append(len(runs)) or walk(state, runs, *a, **b))
    fit = rosner.fit_rosner(df, "x", "row_id", k=k, stop=stop, page=5, bins=16)
    monkeypatch.undo()
    assert max(held, default=0) <= 200 and len(fit.stretches) > 5
    assert (fit.removed, fit.low, fit.high) == (whole.removed, whole.low, whole.high) and fit.removed > 300
    assert sorted(tuple(r) for r in rosner.rosner_steps(df, fit).select("step", "row_id").collect()) == want


def test_small_and_constant_columns(spark):
    few = spark.createDataFrame([(i, float(i)) for i in range(20)], "row_id long, x double")
    assert rosner.fit_rosner(few, "x", "row_id").status == "too few rows"
    flat = spark.createDataFrame([(i, 5.0) for i in range(40)] + [(99, None)], "row_id long, x double")
    fit = rosner.fit_rosner(flat, "x", "row_id")
    assert fit.removed == 0 and flat.where(fit.flag()).count() == 0 and rosner.rosner_steps(flat, fit).count() == 0
    assert rosner.rosner_report(few, ["x"], "row_id").count() == 0
