"""Single linkage against all pairs."""

import numpy as np
import pytest

from fenceline.operators import linkage
from fenceline.operators.neighbours import _distances


def brute(x, groups):
    """The partition into so many groups, by Kruskal's rule over all pairs."""
    d = _distances(x, x)
    parent, left = list(range(len(x))), len(x)

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for _, i, j in sorted((d[i, j], i, j) for i in range(len(x)) for j in range(i)):
        a, b = find(i), find(j)
        if a != b and left > groups:
            parent[max(a, b)] = min(a, b)
            left -= 1
    return [find(i) for i in range(len(x))]


def spanning_heights(x):
    """Prim's rule."""
    points = np.unique(x, axis=0)
    near = np.full(len(points), np.inf)
    inside, at, heights = np.zeros(len(points), bool), 0, []
    for _ in range(len(points) - 1):
        inside[at] = True
        near = np.minimum(near, _distances(points[at : at + 1], points)[0])
        near[inside] = np.inf
        at = int(near.argmin())
        heights.append(near[at])
    return sorted(heights)


def tables():
    rng = np.random.default_rng(4)
    yield "blobs", np.concatenate([rng.normal(c, 0.3, (60, 2)) for c in ((0, 0), (6, 0), (0, 7), (30, 30))]), 4
    yield "chain", np.column_stack([np.arange(150.0) ** 1.1, np.zeros(150)]), 3
    yield "lognormal", rng.lognormal(0, 1.5, (220, 3)), 5
    yield "copies", np.concatenate([np.zeros((40, 2)), np.ones((40, 2)) * 9, rng.normal(20, 1, (60, 2))]), 3


@pytest.mark.parametrize("name, x, groups", list(tables()), ids=lambda v: v if isinstance(v, str) else "")
def test_against_all_pairs(spark, name, x, groups):
    columns = [f"c{i}" for i in range(x.shape[1])]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "row_id long, " + ", ".join(f"{c} double" for c in columns))
    found = linkage.single_linkage(df, columns, "row_id", groups, leaf_rows=32)
    heights = sorted(r["height"] for r in found["merges"].collect())
    assert heights == pytest.approx(spanning_heights(x))
    labels = [r["cluster"] for r in sorted(found["labels"].collect())]
    want = brute(x, groups)
    number = {}
    assert labels == [number.setdefault(w, len(number)) for w in want]


def test_few_rows(spark):
    schema = "row_id long, a double"
    one = linkage.single_linkage(spark.createDataFrame([(7, 1.0), (8, 1.0), (9, None)], schema), ["a"], "row_id", 2)
    assert sorted(map(tuple, one["labels"].collect())) == [(7, 0), (8, 0)] and one["merges"].count() == 0
    none = linkage.single_linkage(spark.createDataFrame([], schema), ["a"], "row_id", 2)
    assert none["labels"].count() == 0 and none["merges"].count() == 0
