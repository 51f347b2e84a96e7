"""Steps whose cost must not grow faster than their input."""

import numpy as np
import pandas as pd

from fenceline.functions import components
from fenceline.operators import classify, cluster, linkage
from tests.test_linkage import spanning_heights


def test_rounds_of_components_do_not_follow_the_longest_path(spark, monkeypatch):
    rounds = []
    for module, name in ((cluster, "cut_lineage"), (components, "stored")):
        old = getattr(module, name)
        monkeypatch.setattr(module, name, lambda df, old=old: rounds.append(1) or old(df))
    n = 400
    order = np.random.default_rng(0).permutation(n)
    path = pd.DataFrame({"a": order[:-1], "b": order[1:]})
    nodes = spark.range(n + 1).select(cluster.F.col("id").alias("cell"))
    found = cluster._connected(nodes, spark.createDataFrame(path, "a long, b long"), driver_rows=0)
    assert {r["cell"]: r["label"] for r in found.collect()} == {**dict.fromkeys(range(n), 0), n: n}
    assert len(rounds) <= 20


def test_many_open_pairs_of_cells_share_a_task(spark):
    # Cells side by side; the rows of every second pair touch.
    rows = [(cell, cell % 3, float(cell), 10.0 * cell + side) for cell in range(200) for side in (0.0, 9.5 if cell % 2 else 9.0)]
    core = spark.createDataFrame(rows, "cell long, leaf long, x0 double, x1 double").withColumn("x0", cluster.F.lit(0.0))
    pairs = spark.createDataFrame([(c, c + 1) for c in range(199)], "a long, b long")
    found = cluster._touching(pairs, core, ["x0", "x1"], 0.75)
    assert sorted((r["a"], r["b"]) for r in found.collect()) == [(c, c + 1) for c in range(1, 199, 2)]
    few = cluster._touching(pairs, core, ["x0", "x1"], 0.75, task_rows=10)
    assert sorted((r["a"], r["b"]) for r in few.collect()) == [(c, c + 1) for c in range(1, 199, 2)]


def test_a_component_without_an_edge_asks_by_one_row_first(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(c, 0.1, (150, 2)) for c in (0.0, 5.0, 50.0)])
    points = spark.createDataFrame(pd.DataFrame(x, columns=["x0", "x1"]).assign(point=range(len(x))))
    asked, estimates, old = [], [], linkage._asked

    def count(labelled, asks, names, tree):
        asked.append((asks.count(), asks.select("label").distinct().count(), asks.agg({"radius": "max"}).first()[0]))
        estimates.append(int(str(labelled._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())))
        return old(labelled, asks, names, tree)

    monkeypatch.setattr(linkage, "_asked", count)
    edges = linkage.spanning_tree(points, ["x0", "x1"], leaf_rows=32).toPandas()
    assert np.allclose(sorted(edges["distance"]), spanning_heights(x))
    # The rounds that start without a known edge send one row of each component first; nobody asks for the far end.
    first = next(rows for rows in asked if rows[2] > 3)
    assert first[0] == first[1]
    # The estimated size of the labels must not multiply from round to round, or planning takes over.
    assert max(estimates) < 1 << 30


def test_training_rows_are_dealt_into_parts_of_bounded_size(spark):
    data = spark.range(1000).repartition(2)
    assert classify._in_parts(data, 1000, rows=100).rdd.getNumPartitions() == 10
    assert classify._in_parts(data, 1000, rows=600).rdd.getNumPartitions() == 2
