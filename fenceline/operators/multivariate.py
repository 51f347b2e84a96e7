"""Multivariate detectors: Mahalanobis distance, local outlier factor, isolation forest."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import add, number
from ..functions.lineage import cut_lineage
from ..functions.rank import TASK_ROWS, column_quantiles
from .correlate import PAIRS_PER_PASS, complete_numbers
from .neighbours import k_distances, neighbour_means, visits_of

# Neighbours of the local outlier factor unless asked otherwise.
NEIGHBOURS = 20


def covariance(df: DataFrame, columns: Sequence[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """n, mean vector and sample covariance of complete rows (p x p numbers reach the driver)."""
    data = complete_numbers(df, columns)
    p = len(columns)
    row = data.agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    n = row["n"]
    if n < 2:
        return n, np.zeros(p), np.zeros((p, p))
    matrix = np.zeros((p, p))
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    for start in range(0, len(pairs), PAIRS_PER_PASS):
        part = pairs[start : start + PAIRS_PER_PASS]
        values = data.agg(*[F.covar_samp(columns[i], columns[j]).alias(f"v{k}") for k, (i, j) in enumerate(part)]).first()
        for (i, j), v in zip(part, values):
            matrix[i, j] = matrix[j, i] = v
    return n, np.array([row[f"m{i}"] for i in range(p)]), matrix


def mahalanobis_distance(columns: Sequence[str], mean: np.ndarray, cov: np.ndarray) -> Column:
    """Distance as a plain expression: the length of the whitened row; NULL on incomplete rows."""
    whiten = np.linalg.inv(np.linalg.cholesky(cov))
    centred = [number(c) - F.lit(float(m)) for c, m in zip(columns, mean)]
    parts = []
    for i in range(len(columns)):
        part = add(F.lit(float(whiten[i, j])) * centred[j] for j in range(i + 1))
        parts.append(part * part)
    return F.sqrt(add(parts))


def mahalanobis(df: DataFrame, columns: Sequence[str], threshold: float = 3.0) -> DataFrame:
    """df with mahalanobis_distance and mahalanobis (distance above the threshold).

    Fewer than two columns or complete rows, or a singular covariance, flag nothing.
    """
    none = {"mahalanobis_distance": F.lit(None).cast("double"), "mahalanobis": F.lit(False)}
    if len(columns) < 2:
        return df.withColumns(none)
    n, mean, cov = covariance(df, columns)
    if n < 2 or np.linalg.det(cov) == 0:
        return df.withColumns(none)
    try:
        distance = mahalanobis_distance(columns, mean, cov)
    except np.linalg.LinAlgError:
        return df.withColumns(none)
    return df.withColumn("mahalanobis_distance", distance).withColumn(
        "mahalanobis", F.coalesce(F.col("mahalanobis_distance") > threshold, F.lit(False))
    )


def _flag_worst(df: DataFrame, scores: DataFrame, row_id: str, name: str, contamination: float, task_rows: int) -> DataFrame:
    """Join scores to df and flag those above the (1 - contamination) quantile."""
    if not 0.0 < contamination < 1.0:
        raise ValueError("contamination is a share between 0 and 1")
    cut = column_quantiles(scores, [f"{name}_score"], [1.0 - contamination], task_rows=task_rows)[f"{name}_score"][0]
    above = F.col(f"{name}_score") > F.lit(cut) if cut is not None else F.lit(False)
    return df.join(scores, row_id, "left").withColumn(name, F.coalesce(above, F.lit(False)))


def lof_scores(
    df: DataFrame, columns: Sequence[str], row_id: str, neighbours: int = NEIGHBOURS, leaf_rows: int = 1024
) -> DataFrame:
    """Exact local outlier factor of every complete row: row_id, lof_score.

    Equal rows are folded into one weighted point first. The neighbourhood of a
    row is every row within its k-distance (ties included). With no other row there is no score.
    """
    data = complete_numbers(df, columns, [row_id])
    n = data.count()
    empty = df.sparkSession.createDataFrame(
        [], f"{row_id} {df.schema[row_id].dataType.simpleString()}, lof_score double"
    )
    if n < 2:
        return empty
    k = min(neighbours, n - 1)
    names = [f"x{i}" for i in range(len(columns))]
    rows = data.select(row_id, *[F.col(c).alias(x) for c, x in zip(columns, names)])
    points = rows.groupBy(*names).agg(F.count("*").alias("weight"), F.min(row_id).isNotNull().alias("named"))
    points = cut_lineage(points.select(F.monotonically_increasing_id().alias("point"), "weight", "named", *names))
    ranged, tree = k_distances(points, names, k, leaf_rows)
    ranged = ranged.where("named").drop("named")
    visits = cut_lineage(visits_of(ranged.where(~F.col("alone")), names, tree))
    # Local reachability density; the small constant keeps piles of copies finite.
    reached = neighbour_means(ranged, visits, names, tree, "radius", "reach", reach=True)
    density = reached.withColumn("density", 1.0 / (F.col("reach") + 1e-10)).drop("reach")
    around = neighbour_means(density, visits, names, tree, "density", "around")
    scored = around.select(*names, (F.col("around") / F.col("density")).alias("lof_score"))
    return rows.join(scored, names).select(row_id, "lof_score")


def lof(
    df: DataFrame, columns: Sequence[str], row_id: str, neighbours: int = NEIGHBOURS,
    contamination: float = 0.05, leaf_rows: int = 1024, task_rows: int = TASK_ROWS,
) -> DataFrame:
    """df with lof_score and lof: the worst `contamination` share of scores."""
    scores = cut_lineage(lof_scores(df, columns, row_id, neighbours, leaf_rows))
    return _flag_worst(df, scores, row_id, "lof", contamination, task_rows)


# ---------------------------------------------------------------- isolation forest


def _path_correction(n: np.ndarray | float) -> np.ndarray:
    """Mean depth of an unsuccessful search among n rows."""
    n = np.asarray(n, dtype=float)
    euler = 0.5772156649015329
    big = 2.0 * (np.log(np.maximum(n - 1.0, 1.0)) + euler) - 2.0 * (n - 1.0) / np.maximum(n, 1.0)
    return np.where(n > 2, big, np.where(n == 2, 1.0, 0.0))


def _tree_samples(data: DataFrame, row_id: str, n: int, trees: int, sample: int, seed: int) -> DataFrame:
    """`sample` rows per tree, chosen by hashes of row_id and tree: tree, x0...

    Large tables are first thinned by hash to a few times the rows needed, so only
    those are given to the trees.
    """
    needed = trees * sample
    span = 1 << 30
    chance = F.pmod(F.xxhash64(F.col(row_id), F.lit(seed)), F.lit(span))
    pool = data
    if n > 8 * needed:
        pool = data.where(chance < F.lit(int(span * 8 * needed / n)))
        n = 8 * needed
    spread = pool.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    order = F.xxhash64(F.col(row_id), F.col("tree"), F.lit(seed + 1))
    spread = spread.withColumn("order", F.pmod(order, F.lit(span)))
    if n > 4 * sample:
        spread = spread.where(F.col("order") < F.lit(int(span * min(1.0, 4 * sample / n))))
    from pyspark.sql import Window

    pick = Window.partitionBy("tree").orderBy("order", row_id)
    return spread.withColumn("_rn", F.row_number().over(pick)).where(F.col("_rn") <= sample).drop("_rn", "order", row_id)


def _grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple]:
    """Random splits until single rows, equal rows or the depth limit; nodes in order of creation."""
    nodes: list[tuple] = []

    def build(rows: np.ndarray, depth: int) -> int:
        place = len(nodes)
        nodes.append(None)
        low, high = rows.min(axis=0), rows.max(axis=0)
        varying = np.flatnonzero(high > low)
        if depth >= limit or len(rows) <= 1 or varying.size == 0:
            nodes[place] = (-1, 0.0, -1, -1, depth + float(_path_correction(len(rows))))
            return place
        feature = int(rng.choice(varying))
        cut = rng.uniform(low[feature], high[feature])
        left = rows[:, feature] <= cut
        if left.all():
            left = rows[:, feature] < high[feature]
        nodes[place] = (feature, float(cut), build(rows[left], depth + 1), build(rows[~left], depth + 1), 0.0)
        return place

    build(x, 0)
    return nodes


def _steps(tree: pd.DataFrame) -> tuple[np.ndarray, ...]:
    """feature and cut of every node, its two children side by side, and depth; an end node leads to itself."""
    feature, cut, left, right, depth = (tree[c].to_numpy() for c in ("feature", "cut", "left", "right", "depth"))
    end, node = feature < 0, np.arange(len(feature))
    child = np.column_stack([np.where(end, node, left), np.where(end, node, right)]).astype(np.int64).ravel()
    return np.maximum(feature, 0).astype(np.int64), cut, child, depth


def isolation_scores(
    df: DataFrame, columns: Sequence[str], row_id: str, trees: int = 100, sample: int = 256, seed: int = 42
) -> DataFrame:
    """Anomaly score of every complete row: row_id, isolation_forest_score.

    Trees grow in parallel from hash samples; the forest (at most 2 * sample nodes
    per tree) is what the scoring tasks receive, and rows are scored in Arrow batches.
    """
    names = [f"x{i}" for i in range(len(columns))]
    data = complete_numbers(df, columns, [row_id]).select(
        row_id, *[F.col(c).alias(x) for c, x in zip(columns, names)]
    )
    n = data.count()
    if n < 2:
        return data.select(row_id, F.lit(None).cast("double").alias("isolation_forest_score")).limit(0)
    sample = min(sample, n)
    limit = max(1, math.ceil(math.log2(sample)))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        rows = pdf[names].to_numpy()
        rows = rows[np.lexsort(rows.T)]  # the tree must not depend on row order
        nodes = _grow(rows, np.random.default_rng([seed, tree]), limit)
        out = pd.DataFrame(nodes, columns=["feature", "cut", "left", "right", "depth"])
        return out.assign(tree=tree, node=range(len(nodes)), size=len(rows))

    forest = (
        _tree_samples(data, row_id, n, trees, sample, seed)
        .groupBy("tree")
        .applyInPandas(
            grow, "feature int, cut double, left int, right int, depth double, tree int, node int, size int"
        )
        .toPandas()
        .sort_values(["tree", "node"])
    )
    parts = [_steps(t) for _, t in forest.groupby("tree")]
    scale = float(_path_correction(float(forest["size"].max()))) or 1.0
    shared = df.sparkSession.sparkContext.broadcast(parts)

    def score(batches):
        for pdf in batches:
            x = pdf[names].to_numpy()
            total = np.zeros(len(x))
            flat = x.ravel()  # a row's values from its first one on
            firsts = np.arange(len(x)) * len(names)
            for feature, cut, child, depth in shared.value:
                at = np.zeros(len(x), dtype=np.int64)
                for _ in range(limit):
                    at = child.take(2 * at + (flat.take(firsts + feature.take(at)) > cut.take(at)))
                total += depth.take(at)
            yield pd.DataFrame({
                row_id: pdf[row_id],
                "isolation_forest_score": np.exp2(-total / len(shared.value) / scale),
            })

    return data.mapInPandas(score, f"{row_id} {df.schema[row_id].dataType.simpleString()}, isolation_forest_score double")


def isolation_forest(
    df: DataFrame, columns: Sequence[str], row_id: str, contamination: float = 0.05,
    trees: int = 100, sample: int = 256, seed: int = 42, task_rows: int = TASK_ROWS,
) -> DataFrame:
    """df with isolation_forest_score and isolation_forest: the worst share of scores."""
    scores = cut_lineage(isolation_scores(df, columns, row_id, trees, sample, seed))
    return _flag_worst(df, scores, row_id, "isolation_forest", contamination, task_rows)
