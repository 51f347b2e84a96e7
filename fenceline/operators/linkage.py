"""Single linkage: an exact minimum spanning tree of the rows, and its cuts.

The tree grows in rounds. In a round every component takes its shortest edge to a row of
another component, under one order of all edges (length, then the rows' numbers), so that
no cycle can close; the components that meet are joined, and their number at least halves.

A row's nearest rows are found once. As long as one of them is in another component, the
nearest such row is among them. A row that has only its own component around it matters
only if its k-th distance is below what its component has found already; it asks the
leaves within that length, skipping every branch of the split tree that its component
fills alone. A component that has found nothing yet first sends out one row, the nearest
to a row of another component in a bounded sample. Inside a task the length shrinks with
every edge found. What leaves a task is one edge per component and leaf.

Cutting the tree's longest edges gives the groups of single linkage exactly; the edges'
lengths are the heights at which groups merge. Equal rows are one point from the start.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.lineage import broadcast_if_small, cut_lineage, stored
from .cluster import _connected
from .neighbours import Nest, SplitTree, _distances, located_points, met, neighbour_edges, split_tree

NEAR = 8

# Rows of the sample that tells a component which of its rows asks first.
SCOUTS_SAMPLE = 4096


def _other_leaves(tree: SplitTree, x: np.ndarray, radius: np.ndarray, label: np.ndarray, least: np.ndarray, most: np.ndarray):
    """(row, leaf) of the leaves within a row's radius that hold some other label; least and most are of the labels below a node."""
    inner = (1 << tree.depth) - 1
    rows_found, leaves_found = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    stack = [(0, np.arange(len(x)), np.zeros_like(x))]
    limit = radius * radius * (1 + 1e-12)
    while stack:
        node, rows, offset = stack.pop()
        if least[node] > most[node]:
            continue  # no rows
        keep = ((offset * offset).sum(axis=1) <= limit[rows]) & ((least[node] != label[rows]) | (most[node] != label[rows]))
        rows, offset = rows[keep], offset[keep]
        if not rows.size:
            continue
        if node >= inner:
            rows_found.append(rows)
            leaves_found.append(np.full(rows.size, node - inner))
            continue
        f, cut = tree.feature[node], tree.cut[node]
        left, right = offset.copy(), offset.copy()
        if not np.isinf(cut):
            gap = x[rows, f] - cut
            left[:, f], right[:, f] = np.maximum(left[:, f], gap), np.maximum(right[:, f], -gap)
            stack.append((2 * node + 2, rows, right))
        stack.append((2 * node + 1, rows, left))
    return np.concatenate(rows_found), np.concatenate(leaves_found)


def _label_ranges(labelled: DataFrame, tree: SplitTree) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest label below every node of the tree; one row per leaf comes to the driver."""
    leaves = 1 << tree.depth
    least, most = np.full(leaves, np.iinfo(np.int64).max), np.full(leaves, -1)
    for r in labelled.groupBy("leaf").agg(F.min("label").alias("least"), F.max("label").alias("most")).collect():
        least[r["leaf"]], most[r["leaf"]] = r["least"], r["most"]
    lows, highs = [least], [most]
    while len(lows[0]) > 1:
        lows.insert(0, np.minimum(lows[0][0::2], lows[0][1::2]))
        highs.insert(0, np.maximum(highs[0][0::2], highs[0][1::2]))
    return np.concatenate(lows), np.concatenate(highs)


def _asked(labelled: DataFrame, asks: DataFrame, names: list[str], tree: SplitTree) -> DataFrame:
    """(label, distance, a, b, other): every asking component's shortest edge per leaf, within the rows' radius."""
    shared = labelled.sparkSession.sparkContext.broadcast((tree, *_label_ranges(labelled, tree)))
    fields = ["point", "label", *names, "radius"]
    coords = ", ".join(f"{x} double" for x in names)

    def visit(batches):
        own, least, most = shared.value
        for pdf in batches:
            rows, leaves = _other_leaves(own, pdf[names].to_numpy(), pdf["radius"].to_numpy(), pdf["label"].to_numpy(), least, most)
            yield pdf[fields].iloc[rows].assign(leaf=leaves)

    visits = cut_lineage(asks.select(*fields).mapInPandas(visit, f"point long, label long, {coords}, radius double, leaf long"))

    def answer(mine: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        best: dict[int, tuple] = {}
        ids, labels = mine["point"].to_numpy(), mine["label"].to_numpy()
        queries = queries.sort_values(["label", "radius", "point"])
        who, of, radius = queries["point"].to_numpy(), queries["label"].to_numpy(), queries["radius"].to_numpy().copy()
        for query, point, d in Nest(mine[names].to_numpy()).pairs(queries[names].to_numpy(), radius) if len(mine) else []:
            away = of[query] != labels[point]
            query, point, d = query[away], point[away], d[away]
            a, b = np.minimum(who[query], ids[point]), np.maximum(who[query], ids[point])
            order = np.lexsort((b, a, d, of[query]))
            first = order[np.flatnonzero(np.concatenate(([True], np.diff(of[query][order]) != 0)))] if len(order) else order
            for i in first:
                found = (d[i], int(a[i]), int(b[i]), int(labels[point[i]]))
                label = int(of[query[i]])
                best[label] = min(found, best.get(label, found))
                # Later queries of the component look no further; they lie side by side.
                same = slice(np.searchsorted(of, label), np.searchsorted(of, label, side="right"))
                np.minimum(radius[same], best[label][0], out=radius[same])
        return pd.DataFrame([(label, *found) for label, found in best.items()], columns=["label", "distance", "a", "b", "other"])

    return met(labelled, visits, "point", tree.rows).applyInPandas(answer, "label long, distance double, a long, b long, other long")


def _scouts(labelled: DataFrame, without: DataFrame, names: list[str], ends: Sequence[tuple], sample: int = SCOUTS_SAMPLE) -> DataFrame:
    """point, label, coordinates and radius of one row per label of ``without``: the nearest to a row of another label.

    The other rows are a sample of labelled, and ends, two rows (label, coordinates) of
    different labels, so that every row has one; the radius is the distance to it.
    """
    span, n = 1 << 30, labelled.count()
    chosen = labelled.where(F.pmod(F.xxhash64("point"), F.lit(span)) < F.lit(int(span * min(1.0, sample / max(1, n)))))
    rows = np.array([tuple(r) for r in chosen.select("label", *names).collect()] + [tuple(r) for r in ends], dtype=object)
    shared = labelled.sparkSession.sparkContext.broadcast((rows[:, 0].astype(np.int64), rows[:, 1:].astype(float)))
    coords = ", ".join(f"{x} double" for x in names)

    def reach(batches):
        labels, places = shared.value
        for pdf in batches:
            x, own = pdf[names].to_numpy(), pdf["label"].to_numpy()
            radius = np.zeros(len(pdf))
            for at in range(0, len(pdf), 256):
                here = slice(at, at + 256)
                d = _distances(x[here], places)
                d[own[here, None] == labels[None, :]] = np.inf
                radius[here] = d.min(axis=1)
            # One row of a label and batch is enough.
            out = pdf.assign(radius=radius).sort_values(["radius", "point"])
            yield out.drop_duplicates("label")[["point", "label", *names, "radius"]]

    found = without.select("point", "label", *names).mapInPandas(reach, f"point long, label long, {coords}, radius double")
    best = found.groupBy("label").agg(F.min(F.struct("radius", "point", *names)).alias("best"))
    return best.select("best.point", "label", *[f"best.{x}" for x in names], (F.col("best.radius") * (1 + 1e-9)).alias("radius"))


def spanning_tree(points: DataFrame, names: Sequence[str], leaf_rows: int = 512, near: int = NEAR) -> DataFrame:
    """Edges (a, b, distance), a < b, of the minimum spanning tree of points (distinct coordinates, column point a number from 0)."""
    names = list(names)
    spark = points.sparkSession
    tree = split_tree(points, names, leaf_rows)
    labelled = cut_lineage(located_points(points.select("point", *names), names, tree).withColumn("label", F.col("point")))
    edges = cut_lineage(
        neighbour_edges(points.withColumn("weight", F.lit(1).cast("long")), names, near, leaf_rows).select("point", "neighbour", "distance")
    )
    reach = cut_lineage(edges.groupBy("point").agg(F.max("distance").alias("reach")))
    parts = []
    while True:
        ends = labelled.agg(F.min(F.struct("label", *names)).alias("first"), F.max(F.struct("label", *names)).alias("last")).first()
        if ends["first"] is None or ends["first"]["label"] == ends["last"]["label"]:
            break
        label = labelled.select("point", "label")
        away = edges.join(label, "point").join(label.select(F.col("point").alias("neighbour"), F.col("label").alias("other")), "neighbour").where("label <> other")
        away = cut_lineage(away.select("point", "label", "distance", F.least("point", "neighbour").alias("a"), F.greatest("point", "neighbour").alias("b"), "other"))
        edge = F.struct("distance", "a", "b", "other")
        known = away.groupBy("label").agg(F.min(edge).alias("edge"))
        # A component without such an edge gets one of its own from the row that seems to be nearest to another.
        without = labelled.join(known.select("label"), "label", "left_anti")
        if not without.isEmpty():
            scouts = cut_lineage(_scouts(labelled, without, names, [(ends[e]["label"], *(ends[e][x] for x in names)) for e in ("first", "last")]))
            known = cut_lineage(known.unionByName(_asked(labelled, scouts, names, tree).groupBy("label").agg(F.min(edge).alias("edge"))))
        # Rows that have only their own component around them, as far as their component can still do better.
        inside = labelled.join(away.select("point").distinct(), "point", "left_anti").join(reach, "point", "left")
        asks = inside.join(known.select("label", F.col("edge.distance").alias("radius")), "label")
        asks = cut_lineage(asks.where("reach IS NULL OR reach < radius").select("point", "label", *names, "radius"))
        best = known
        if not asks.isEmpty():
            best = best.unionByName(_asked(labelled, asks, names, tree).select("label", edge.alias("edge")))
        best = cut_lineage(best.groupBy("label").agg(F.min("edge").alias("edge")).select("label", "edge.*"))
        parts.append(cut_lineage(best.select("a", "b", "distance").distinct()))
        joined = _connected(
            best.select(F.col("label").alias("cell")), best.select(F.col("label").alias("a"), F.col("other").alias("b"))
        ).select(F.col("cell").alias("label"), F.col("label").alias("into"))
        labelled = stored(labelled.join(broadcast_if_small(joined), "label").drop("label").withColumnRenamed("into", "label"))
    if not parts:
        return spark.createDataFrame([], "a long, b long, distance double")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def single_linkage(data: DataFrame, columns: Sequence[str], row_id: str, groups: int, leaf_rows: int = 512) -> dict[str, DataFrame]:
    """labels (row_id, cluster, numbered by the smallest row_id) of the cut into ``groups``, and merges (height, rows of the tree).

    Rows with a missing value take no part. Rows that equal one another are one point, so
    there may be fewer groups than asked for. At equal heights the edges between later
    points are cut first.
    """
    names = [f"x{i}" for i in range(len(columns))]
    rows = data.select(row_id, *[F.col(c).cast("double").alias(x) for c, x in zip(columns, names)]).dropna(subset=names)
    points = cut_lineage(rows.groupBy(*names).agg(F.count("*").alias("copies")).withColumn("point", F.monotonically_increasing_id()))
    edges = cut_lineage(spanning_tree(points, names, leaf_rows))
    cut = edges.orderBy(F.desc("distance"), F.desc("a"), F.desc("b")).limit(max(0, groups - 1))
    left = edges.join(broadcast_if_small(cut.select("a", "b")), ["a", "b"], "left_anti")
    found = cut_lineage(_connected(points.select(F.col("point").alias("cell")), left.select("a", "b")))
    of_rows = rows.join(points.select(*names, F.col("point").alias("cell")), names).join(found, "cell").select(row_id, "label")
    first = of_rows.groupBy("label").agg(F.min(row_id).alias("first")).collect()  # a row per group
    number = {r["label"]: i for i, r in enumerate(sorted(first, key=lambda r: r["first"]))}
    table = data.sparkSession.createDataFrame(list(number.items()) or [], "label long, cluster int")
    return {"labels": of_rows.join(F.broadcast(table), "label").select(row_id, "cluster"), "merges": edges.select(F.col("distance").alias("height"))}
