"""The tree inside a task, and the engine on points that crowd together."""

import numpy as np
import pytest

from fenceline.operators import cluster, multivariate, neighbours


def clouds():
    rng = np.random.default_rng(8)
    yield rng.normal(0, 1, (700, 2))
    yield rng.lognormal(0, 2, (900, 3))
    yield np.concatenate([np.zeros((300, 2)), rng.normal(0, 1e-6, (300, 2)), rng.uniform(-9, 9, (100, 2))])
    yield rng.integers(0, 4, (400, 2)).astype(float)
    yield rng.normal(0, 1, (1, 2))


@pytest.mark.parametrize("x", list(clouds()), ids=["normal", "lognormal", "piles", "grid", "one"])
def test_pairs_within_a_radius(x):
    rng = np.random.default_rng(3)
    q = np.concatenate([x[:50], rng.normal(0, 3, (50, x.shape[1]))])
    nest = neighbours.Nest(x, 16)
    for radius in (0.0, 0.3, 2.0, np.inf):
        found = [p for part in nest.pairs(q, np.full(len(q), radius)) for p in zip(*part)]
        d = neighbours._distances(q, x)
        i, j = np.nonzero(d <= radius)
        assert sorted(found) == sorted(zip(i, j, d[i, j]))


@pytest.mark.parametrize("x", list(clouds()), ids=["normal", "lognormal", "piles", "grid", "one"])
@pytest.mark.parametrize("k", [1, 7, 40])
def test_first_bounds_and_nearest(x, k):
    w = np.random.default_rng(5).integers(1, 4, len(x))
    bound = neighbours.Nest(x, 16).first_bounds(w, k)
    d = neighbours._distances(x, x)
    copies = w[None, :] - np.eye(len(x), dtype=int)
    exact = neighbours._kth(d, copies, k)
    assert (bound >= exact).all() and (np.isfinite(bound) | np.isinf(exact) | (len(x) <= 4 * k)).all()
    i, j = np.nonzero((d <= bound[:, None]) & (copies > 0))
    kept = neighbours._nearest_k(i, j, d[i, j], copies[i, j], k)
    assert set(zip(i[kept], j[kept])) == {(a, b) for a, b in zip(i, j) if d[a, b] <= exact[a]}


def test_work_per_point_does_not_grow_with_the_leaf():
    rng = np.random.default_rng(1)
    seen = []
    for n in (4_000, 16_000):
        x = rng.lognormal(0, 1, (n, 2))
        nest = neighbours.Nest(x)
        bound = nest.first_bounds(np.ones(n, int), 10)
        seen.append(sum(len(part[0]) for part in nest.pairs(x, bound)) / n)
    assert seen[1] < 1.3 * seen[0] and seen[1] < 200


@pytest.mark.parametrize("busy", [20_000, 60])
def test_queries_of_a_leaf_in_parts(spark, monkeypatch, busy):
    """The same edges however many tasks a leaf's queries are dealt over."""
    monkeypatch.setattr(neighbours, "QUERIES_PER_TASK", busy)
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.lognormal(0, 1.5, (500, 2)), rng.normal(0, 0.01, (300, 2))])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "row_id long, a double, b double")
    points = df.selectExpr("row_id AS point", "1L AS weight", "a AS x0", "b AS x1")
    edges = neighbours.neighbour_edges(points, ["x0", "x1"], 8, 128).toPandas()
    d = neighbours._distances(x, x)
    exact = neighbours._kth(d, 1 - np.eye(len(x), dtype=int), 8)
    want = {(i, j) for i, j in zip(*np.nonzero(d <= exact[:, None])) if i != j}
    assert set(zip(edges["point"], edges["neighbour"])) == want and len(edges) == len(want)
    labels = cluster.dbscan(df, ["a", "b"], "row_id", 0.05, 6, leaf_rows=64).toPandas().set_index("row_id")
    assert (labels.sort_index()["is_core"].to_numpy() == ((d <= 0.05).sum(axis=1) >= 6)).all()
    assert multivariate.lof_scores(df, ["a", "b"], "row_id", 8, 128).count() == len(x)


@pytest.mark.parametrize("busy", [20_000, 60])
def test_outlier_factors_hand_on_rows_not_pairs(spark, monkeypatch, busy):
    """Exact factors of every row, also of rows that share an id, and nothing kept between steps that has a row per pair."""
    monkeypatch.setattr(neighbours, "QUERIES_PER_TASK", busy)
    kept = []

    def counted(df, cut=neighbours.cut_lineage):
        out = cut(df)
        kept.append(out.count())
        return out

    for module in (neighbours, multivariate):
        monkeypatch.setattr(module, "cut_lineage", counted)
    rng = np.random.default_rng(4)
    x = np.round(np.concatenate([rng.lognormal(0, 1.5, (600, 2)), rng.normal(0, 0.01, (200, 2)), np.full((40, 2), 3.0)]), 4)
    df = spark.createDataFrame([(i // 2, i, float(a), float(b)) for i, (a, b) in enumerate(x)], "row_id long, i long, a double, b double")
    d = neighbours._distances(x, x)
    np.fill_diagonal(d, np.inf)
    reach = np.sort(d, axis=1)[:, 11]
    near = [np.flatnonzero(row <= r) for row, r in zip(d, reach)]
    density = np.array([1 / (np.maximum(reach[j], d[i, j]).mean() + 1e-10) for i, j in enumerate(near)])
    want = np.array([density[j].mean() / density[i] for i, j in enumerate(near)])
    got = multivariate.lof_scores(df, ["a", "b"], "row_id", 12, 128).toPandas()
    assert np.bincount(got["row_id"]).tolist() == [2] * (len(x) // 2)
    assert got.sort_values(["row_id", "lof_score"])["lof_score"].to_numpy() == pytest.approx(np.sort(want.reshape(-1, 2), axis=1).ravel(), rel=1e-9)
    assert max(kept) < 2 * len(x)
