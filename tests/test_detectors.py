import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fenceline.functions import special
from fenceline.operators import combine, multivariate, outlier_tests, univariate
from fenceline.plans.detect import detect_outliers

ELEVEN = [*map(float, range(1, 11)), 100.0]


def frame(spark, values, name="x"):
    return spark.createDataFrame([(i, None if v is None else float(v)) for i, v in enumerate(values)], f"row_id long, {name} double")


def flagged(df, flag):
    return {r["row_id"] for r in df.where(flag).collect()}


def test_hand_worked_goldens(spark):
    df = frame(spark, ELEVEN)
    limits = univariate.fit_iqr(df, ["x"])["x"]
    assert (limits.low, limits.high) == pytest.approx((-4.0, 16.0))
    limits = univariate.fit_iqr(df, ["x"], size_rule=True)["x"]
    assert (limits.low, limits.high) == pytest.approx((-11.5, 23.5))
    assert flagged(df, limits.flag("x")) == {10}
    assert flagged(df, univariate.fit_zscore(df, ["x"], 2.0)["x"].flag("x")) == {10}
    assert flagged(df, univariate.fit_zscore(df, ["x"])["x"].flag("x")) == set()
    assert flagged(df, univariate.fit_mad(df, ["x"])["x"].flag("x")) == {10}
    g = outlier_tests.grubbs(df, ["x"], "row_id").first()
    assert (g["row_id"], g["is_outlier"]) == (10, True)
    assert g["g"] == pytest.approx(2.99991, abs=1e-4)
    ends = {r["side"]: r for r in outlier_tests.dixon(df, [], "x", "row_id").collect()}
    assert ends["max"]["q"] == pytest.approx(90 / 99) and ends["max"]["is_outlier"]
    assert ends["min"]["q"] == pytest.approx(1 / 99) and not ends["min"]["is_outlier"]
    assert flagged(df, outlier_tests.fit_rosner(df, "x", "row_id").flag()) == set()


@pytest.mark.parametrize("values", [[], [1.0, 2.0], [5.0] * 12, [None] * 6, [100.0] * 18 + [500.0, 600.0]])
def test_edge_columns_flag_nothing(spark, values):
    df = frame(spark, values)
    for fit in (univariate.fit_iqr(df, ["x"]), univariate.fit_mad(df, ["x"])):
        assert flagged(df, fit["x"].flag("x")) == set()
    if len(set(values)) <= 1:
        assert flagged(df, univariate.fit_zscore(df, ["x"])["x"].flag("x")) == set()
        assert outlier_tests.grubbs(df, ["x"], "row_id").count() == 0


def test_nan_counts_as_missing(spark):
    df = frame(spark, [*ELEVEN, float("nan"), None])
    assert flagged(df, univariate.fit_iqr(df, ["x"])["x"].flag("x")) == {10}


def test_flags_do_not_change_with_scale_or_partitions(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(50, 5, 400), [120, -40, 90]])
    df = frame(spark, x)
    moved = df.withColumn("x", F.col("x") * -3.0 + 7.0).repartition(7)
    for fit in (univariate.fit_iqr, univariate.fit_zscore, univariate.fit_mad):
        assert flagged(df, fit(df, ["x"])["x"].flag("x")) == flagged(moved, fit(moved, ["x"])["x"].flag("x"))


# flags (uni, mahalanobis, lof, forest, hypothesis) -> voting, union, intersection, adaptive normal, adaptive other
RULES = [
    ((0, 1, 0, 0, 0), (1, 1, 0, 0, 0)),
    ((1, 1, 0, 0, 0), (1, 1, 1, 1, 0)),
    ((1, 0, 1, 0, 0), (1, 1, 1, 0, 1)),
    ((2, 0, 0, 0, 0), (1, 1, 0, 1, 1)),
    ((2, 1, 0, 0, 0), (1, 1, 1, 1, 1)),
    ((0, 0, 1, 1, 0), (1, 1, 0, 1, 1)),
    ((0, 0, 0, 0, 1), (1, 1, 1, 1, 1)),
    ((1, 0, 0, 0, 0), (0, 1, 0, 0, 0)),
]


def test_combination_rules(spark):
    df = spark.createDataFrame(
        [(i, f[0], *map(bool, f[1:])) for i, (f, _) in enumerate(RULES)],
        "i int, uni int, m boolean, l boolean, f boolean, h boolean",
    )
    args = [F.col(c) for c in ("uni", "m", "l", "f", "h")]
    got = df.select(
        "i",
        combine.final_verdict("voting", *args).alias("voting"),
        combine.final_verdict("union", *args).alias("union"),
        combine.final_verdict("intersection", *args).alias("intersection"),
        combine.final_verdict("adaptive", *args, data_is_normal=True).alias("normal"),
        combine.final_verdict("adaptive", *args).alias("other"),
    ).orderBy("i").collect()
    for row, (_, expected) in zip(got, RULES):
        assert tuple(map(int, row[1:])) == expected


def brute_lof(x, k):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    kd = np.sort(d, axis=1)[:, k - 1]
    near = [np.flatnonzero(d[i] <= kd[i]) for i in range(len(x))]
    lrd = np.array([1 / (np.maximum(kd[near[i]], d[i, near[i]]).mean() + 1e-10) for i in range(len(x))])
    return np.array([lrd[near[i]].mean() / lrd[i] for i in range(len(x))])


@pytest.mark.parametrize("leaf_rows", [16, 1000])
def test_lof_equals_brute_force_with_a_hot_copy(spark, leaf_rows):
    rng = np.random.default_rng(5)
    x = np.round(np.vstack([rng.normal(0, 1, (120, 2)), rng.normal(8, 3, (60, 2)), np.tile([[3.0, 3.0]], (90, 1))]), 2)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "row_id long, a double, b double")
    got = multivariate.lof_scores(df, ["a", "b"], "row_id", 10, leaf_rows).orderBy("row_id").toPandas()
    assert len(got) == len(x)
    assert got["lof_score"].to_numpy() == pytest.approx(brute_lof(x, 10), rel=1e-6)


def test_isolation_forest_finds_the_far_row_and_ignores_partitioning(spark):
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(0, 1, (400, 2)), [[15.0, 15.0]]])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "row_id long, a double, b double")
    one = multivariate.isolation_scores(df, ["a", "b"], "row_id").toPandas().set_index("row_id").sort_index()
    two = multivariate.isolation_scores(df.repartition(5), ["a", "b"], "row_id").toPandas().set_index("row_id").sort_index()
    assert one["isolation_forest_score"].idxmax() == 400
    pd.testing.assert_frame_equal(one, two)
    flagged_share = multivariate.isolation_forest(df, ["a", "b"], "row_id").where("isolation_forest").count()
    assert flagged_share == 20  # strictly above the 95 % point of 401 scores


def test_mahalanobis_singular_flags_nothing(spark):
    df = frame(spark, ELEVEN).withColumn("y", F.col("x") * 2)
    assert multivariate.mahalanobis(df, ["x", "y"]).where("mahalanobis").count() == 0


def test_rosner_small_pages_and_esd_rule(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(0, 1, 200), [9.0, 8.5, -9.5, 8.0, 7.9]])
    df = frame(spark, x)
    expected = {200, 201, 202, 203, 204}
    assert flagged(df, outlier_tests.fit_rosner(df, "x", "row_id").flag()) == expected
    assert flagged(df, outlier_tests.fit_rosner(df, "x", "row_id", page=2, bins=8).flag()) == expected
    assert flagged(df, outlier_tests.fit_rosner(df, "x", "row_id", stop="esd").flag()) == expected


def test_normality_picks_its_test_by_size(spark):
    rng = np.random.default_rng(4)
    normal = frame(spark, rng.normal(0, 1, 300))
    skewed = frame(spark, rng.exponential(1, 300))
    small = frame(spark, rng.normal(0, 1, 30))
    a, b, c = (outlier_tests.normality(d, ["x"], test="by-size").first() for d in (normal, skewed, small))
    assert outlier_tests.normality(small, ["x"]).first()["test"] == "anderson-darling"
    assert outlier_tests.normality(normal, ["x"], test="shapiro-wilk").first()["is_normal"]
    assert a["test"] == "anderson-darling" and a["is_normal"]
    assert not b["is_normal"] and b["p_value"] == 0.001
    assert c["test"] == "shapiro-wilk" and c["is_normal"]


@pytest.mark.parametrize("task_rows", [1_000_000, 50])
def test_shapiro_wilk_from_ranks(spark, task_rows):
    """Tied, hot, constant and short columns, one with a missing value, against the sorted sample."""
    rng = np.random.default_rng(8)
    n = 3000
    data = {
        "smooth": rng.normal(size=n), "tied": rng.integers(0, 5, n) * 1.0,
        "hot": np.where(rng.random(n) < 1 / 3, 5.0, np.round(rng.exponential(9, n), 1)), "flat": np.full(n, 2.0),
        "three": [1.0, 4.0, 9.0] + [None] * (n - 3), "two": [1.0, 2.0] + [None] * (n - 2), "nine": [*np.arange(9.0) ** 2] + [None] * (n - 9),
    }
    df = spark.createDataFrame(pd.DataFrame({c: pd.Series(v, dtype="float64") for c, v in data.items()}))
    rows = {r["variable"]: r for r in outlier_tests.shapiro_wilk(df, list(data), task_rows).collect()}
    assert set(rows) == set(data) - {"two"}
    for c, r in rows.items():
        x = np.array([v for v in data[c] if v is not None])
        w, p = special.shapiro_wilk(x)
        assert r["n"] == len(x) and r["statistic"] == pytest.approx(w, abs=1e-10) and r["p_value"] == pytest.approx(p, abs=1e-8)


def test_verdicts_nest(spark):
    rng = np.random.default_rng(6)
    data = pd.DataFrame(rng.normal(0, 1, (300, 2)), columns=["a", "b"])
    data.loc[:3] = [[9, 9], [9, 0], [0, -9], [5, 5]]
    df = spark.createDataFrame(data.assign(row_id=range(300)))
    sets = {
        s: flagged(detect_outliers(df, ["a", "b"], "row_id", strategy=s, min_univariate=1), "is_outlier")
        for s in ("intersection", "voting", "union")
    }
    assert sets["intersection"] <= sets["voting"] <= sets["union"]
    assert {0, 1, 2} <= sets["union"]
