"""Mutual information from nearest neighbours, against the definition."""

import numpy as np
import pandas as pd
import pytest

from fenceline.operators import information
from fenceline.operators.information import neighbour_information


def psi(n):
    return -0.5772156649015329 + sum(1.0 / i for i in range(1, n))


def brute(x, label, neighbours):
    sizes = {l: int((label == l).sum()) for l in set(label)}
    kept = np.array([sizes[l] > 1 for l in label])
    x, label = x[kept], label[kept]
    terms = []
    for i in range(len(x)):
        d = np.abs(x - x[i])
        others = np.arange(len(x)) != i
        k = min(neighbours, sizes[label[i]] - 1)
        r = np.sort(d[(label == label[i]) & others])[k - 1]
        if r == 0:
            k, m = int((d[(label == label[i]) & others] == 0).sum()), int((d[others] == 0).sum())
        else:
            m = int((d < r).sum())
        terms.append(psi(k) - psi(m) - psi(sizes[label[i]]))
    return max(psi(len(x)) + float(np.mean(terms)), 0.0)


@pytest.mark.parametrize("task_rows,neighbours", [(1_000_000, 3), (40, 3), (12, 5), (2, 1)])
def test_information_by_definition(spark, task_rows, neighbours):
    """Related, unrelated, tied and hot columns in quarters (exact distances), a label of two rows and one of one."""
    rng = np.random.default_rng(5)
    n = 260
    label = rng.choice(["a", "b", "c"], n, p=[0.6, 0.3, 0.1]).astype(object)
    label[0], label[1:3] = "once", "twice"
    data = {
        "related": np.round(4 * (rng.normal(size=n) + 2.0 * (label == "b"))) / 4,
        "other": rng.permutation(n) * 0.25,
        "tied": rng.integers(0, 3, n) * 1.0,
        "hot": np.where(rng.random(n) < 1 / 3, 5.0, rng.integers(0, 400, n) * 0.25),
    }
    df = spark.createDataFrame(pd.DataFrame({"y": label, **data})).repartition(3)
    got = {r.variable: r.mutual_information for r in neighbour_information(df, list(data), "y", neighbours, task_rows).collect()}
    assert set(got) == set(data)
    for name, x in data.items():
        assert got[name] == pytest.approx(brute(x, label, neighbours), abs=1e-8), name
    if neighbours > 1:  # a single neighbour is too noisy to rank by
        assert got["related"] > got["other"]


def test_information_without_rows_or_classes(spark):
    schema = "y string, x double"
    assert neighbour_information(spark.createDataFrame([], schema), ["x"], "y").count() == 0
    assert neighbour_information(spark.createDataFrame([("a", 1.0), ("b", 2.0)], schema), ["x"], "y").count() == 0
    # One class tells nothing; a second neighbour as far as the first lies outside, by the definition.
    for values, expected in (([1.0, 2.5, 5.0], 0.0), ([1.0, 2.5, 4.0], brute(np.array([1.0, 2.5, 4.0]), np.array(["a"] * 3), 3))):
        rows = [("a", v) for v in values] + [("a", None), (None, 3.0)]
        assert neighbour_information(spark.createDataFrame(rows, schema), ["x"], "y").collect()[0][1] == pytest.approx(expected, abs=1e-9)


def test_digamma(spark):
    df = spark.range(1, 60)
    for n, value in df.select("id", information.digamma(df["id"])).collect():
        assert value == pytest.approx(psi(n), abs=1e-9)
