"""Exact nearest neighbours by space partitioning.

Points are spread over the leaves of a balanced split tree learnt from a bounded
sample. Every leaf answers its own points first, which bounds how far their k-th
neighbour can be; a point then visits only the other leaves its bound reaches.
Inside a task the points of a leaf have a tree of their own, so work per query does
not grow with the leaf, and the queries that meet a leaf are dealt over tasks. Nothing
is approximate: the sample only decides how even the leaves are.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.lineage import cut_lineage

# Leaves of the split tree and sampled points per leaf: bounds of what the driver
# gathers and the tasks receive (a few megabytes).
MAX_LEAVES = 1 << 15
SAMPLE_PER_LEAF = 24

# Points of the sample that travel with the tree. Distances to them bound a search whose own leaf has too few points.
ANCHORS = 256

# Queries of one leaf that go to one task; further ones meet a copy of the leaf's points in another.
QUERIES_PER_TASK = 20_000

# Points of a leaf of the tree inside a task, pairs compared at a time, and queries at most.
NEST_ROWS, PAIRS, TOGETHER = 64, 1 << 20, 1024


class SplitTree:
    """A complete binary tree of axis splits over boxes that cover all space."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.rows = len(sample)  # points that the tree is for
        self.depth = max(0, int(np.ceil(np.log2(max(1, leaves)))))
        self.anchors = sample[:: max(1, len(sample) // ANCHORS)][:ANCHORS]
        inner = (1 << self.depth) - 1
        self.feature = np.zeros(inner, dtype=np.int64)
        self.cut = np.full(inner, np.inf)  # everything left where no split is possible
        pending = {0: sample}
        for node in range(inner):
            rows = pending.pop(node, sample[:0])
            left = right = rows[:0]
            if len(rows) >= 2:
                for f in np.argsort(rows.min(axis=0) - rows.max(axis=0)):  # widest first
                    values = np.sort(rows[:, f])
                    cut = values[(len(values) - 1) // 2]
                    if cut == values[-1]:  # a pile at the top end: cut below it
                        under = values[values < cut]
                        if under.size == 0:
                            continue
                        cut = under[-1]
                    self.feature[node], self.cut[node] = f, cut
                    goes_left = rows[:, f] <= cut
                    left, right = rows[goes_left], rows[~goes_left]
                    break
                else:
                    left = rows
            pending[2 * node + 1], pending[2 * node + 2] = left, right

    def leaf(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), dtype=np.int64)
        rows = np.arange(len(x))
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[rows, self.feature[node]] > self.cut[node])
        return node - ((1 << self.depth) - 1)

    def reached(self, x: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) for every leaf box within radius of a row."""
        inner = (1 << self.depth) - 1
        found_rows, found_leaves = [], []
        # A row's offset to the current box, per axis; squared length is the distance.
        stack = [(0, np.arange(len(x)), np.zeros_like(x))]
        limit = radius * radius * (1 + 1e-12)
        while stack:
            node, rows, offset = stack.pop()
            near = (offset * offset).sum(axis=1) <= limit[rows]
            rows, offset = rows[near], offset[near]
            if rows.size == 0:
                continue
            if node >= inner:
                found_rows.append(rows)
                found_leaves.append(np.full(rows.size, node - inner))
                continue
            f, cut = self.feature[node], self.cut[node]
            if np.isinf(cut):
                stack.append((2 * node + 1, rows, offset))
                continue
            gap = x[rows, f] - cut
            left, right = offset.copy(), offset.copy()
            left[:, f] = np.maximum(left[:, f], gap)
            right[:, f] = np.maximum(right[:, f], -gap)
            stack.append((2 * node + 1, rows, left))
            stack.append((2 * node + 2, rows, right))
        if not found_rows:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate(found_rows), np.concatenate(found_leaves)


def split_tree(points: DataFrame, names: Sequence[str], leaf_rows: int) -> SplitTree:
    n = points.count()
    leaves = min(MAX_LEAVES, max(1, -(-n // leaf_rows)))
    wanted = max(1000, leaves * SAMPLE_PER_LEAF)
    span = 1 << 30
    chosen = points
    if n > wanted:
        chosen = points.where(F.pmod(F.xxhash64(*names), F.lit(span)) < F.lit(int(span * wanted / n)))
    sample = chosen.select(*names).toPandas().to_numpy(float).reshape(-1, len(names))
    tree = SplitTree(sample, leaves)
    tree.rows = n
    return tree


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances summed axis by axis (no cancellation for near points)."""
    total = np.zeros((len(a), len(b)))
    for i in range(a.shape[1]):
        gap = a[:, i, None] - b[None, :, i]
        total += gap * gap
    return np.sqrt(total)


def located_points(points: DataFrame, names: Sequence[str], tree: SplitTree) -> DataFrame:
    """points with the leaf each row falls into."""
    names = list(names)
    shared = points.sparkSession.sparkContext.broadcast(tree)
    layout = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in points.schema.fields)

    def locate(batches):
        for pdf in batches:
            yield pdf.assign(leaf=shared.value.leaf(pdf[names].to_numpy()))

    return points.mapInPandas(locate, layout + ", leaf long")


def _anchor_bounds(x: np.ndarray, anchors: np.ndarray, k: int, other: bool) -> np.ndarray:
    """Distance of the k-th nearest anchor; infinite if there are not as many."""
    d = _distances(x, anchors) if len(anchors) else np.zeros((len(x), 0))
    if other:
        d[d == 0] = np.inf
    return np.sort(d, axis=1)[:, k - 1] if d.shape[1] >= k else np.full(len(x), np.inf)


def met(located: DataFrame, asked: DataFrame, query: str = "query", queries: float = float("inf"), every: bool = False):
    """Points and queries cogrouped by leaf, the queries of a busy leaf in several parts that each get its points.

    No query asks a leaf twice, so with few ``queries`` in all no leaf is busy. every=True
    keeps leaves that nothing asks, and a first part (0) of every leaf.
    """
    if queries <= QUERIES_PER_TASK:
        return located.groupBy("leaf").cogroup(asked.groupBy("leaf"))
    parts = asked.groupBy("leaf").agg(F.ceil(F.count("*") / QUERIES_PER_TASK).cast("int").alias("parts"))
    parts = F.broadcast(parts)  # one row per leaf, MAX_LEAVES at most
    queries = asked.join(parts, "leaf").withColumn("part", F.pmod(F.xxhash64(query), "parts").cast("int")).drop("parts")
    points = located.join(parts, "leaf", "left" if every else "inner").withColumn("parts", F.coalesce("parts", F.lit(1)))
    points = points.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    return points.groupBy("leaf", "part").cogroup(queries.groupBy("leaf", "part"))


class Nest:
    """The points of one leaf under a tree of their own."""

    def __init__(self, x: np.ndarray, rows: int = NEST_ROWS):
        self.x = x
        self.tree = SplitTree(x, -(-len(x) // rows))
        self.of = self.tree.leaf(x)
        self.order = np.argsort(self.of, kind="stable")
        self.starts = np.searchsorted(self.of[self.order], np.arange((1 << self.tree.depth) + 1))

    def pairs(self, q: np.ndarray, radius: np.ndarray):
        """(query, point, distance) of all points within each query's radius, some queries at a time."""
        # So many queries at a time that their pairs stay bounded even where a radius reaches every point.
        step = max(1, min(TOGETHER, 4 * PAIRS // max(1, len(self.x))))
        for at in range(0, len(q), step):
            rows, boxes = self.tree.reached(q[at : at + step], radius[at : at + step])
            order = np.argsort(boxes, kind="stable")
            rows, boxes = rows[order], boxes[order]
            cuts = np.flatnonzero(np.diff(boxes)) + 1
            found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            held = 0
            for who in np.split(np.arange(len(rows)), cuts):
                if not len(who):
                    continue
                box = boxes[who[0]]
                mine = self.order[self.starts[box] : self.starts[box + 1]]
                if not len(mine):
                    continue
                asking = rows[who] + at
                for part in range(0, len(mine), 4096):  # a pile of points that no split divides
                    own = mine[part : part + 4096]
                    d = _distances(q[asking], self.x[own])
                    i, j = np.nonzero(d <= radius[asking][:, None])
                    found.append((asking[i], own[j], d[i, j]))
                    held += len(i)
            if held:
                yield tuple(np.concatenate(c) for c in zip(*found))

    def first_bounds(self, weight: np.ndarray, k: int) -> np.ndarray:
        """An upper bound of every point's k-th distance among the other copies and points, from its own box or some points of all boxes."""
        bound = np.full(len(self.x), np.inf)
        for box in range(len(self.starts) - 1):
            mine = self.order[self.starts[box] : self.starts[box + 1]]
            for part in range(0, len(mine), 256):
                asking, own = mine[part : part + 256], mine[: 4 * NEST_ROWS]
                bound[asking] = _kth(_distances(self.x[asking], self.x[own]), weight[own][None, :] - (asking[:, None] == own[None, :]), k)
        far = np.flatnonzero(np.isinf(bound))
        if len(far):
            some = self.order[:: max(1, len(self.x) // max(ANCHORS, 4 * k))]
            for part in range(0, len(far), 256):
                asking = far[part : part + 256]
                bound[asking] = _kth(_distances(self.x[asking], self.x[some]), weight[some][None, :] - (asking[:, None] == some[None, :]), k)
        return bound


def _kth(d: np.ndarray, copies: np.ndarray, k: int) -> np.ndarray:
    """Distance at which each row has seen k copies; infinite if there are not as many."""
    order = np.argsort(d, axis=1, kind="stable")
    sorted_d = np.take_along_axis(d, order, axis=1)
    enough = np.cumsum(np.take_along_axis(copies, order, axis=1), axis=1) >= k
    return np.where(enough.any(axis=1), sorted_d[np.arange(len(d)), enough.argmax(axis=1)], np.inf)


def _nearest_k(query: np.ndarray, point: np.ndarray, distance: np.ndarray, copies: np.ndarray, k: int) -> np.ndarray:
    """Positions of the pairs that a query's k nearest copies can need, all tied at the k-th distance included."""
    order = np.lexsort((distance, query))
    q, d, c = query[order], distance[order], copies[order]
    if not len(q):
        return order
    starts = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1])))
    # A pair is needed if the copies at strictly smaller distances are fewer than k.
    new = np.concatenate(([True], (q[1:] != q[:-1]) | (d[1:] > d[:-1])))
    before = np.concatenate(([0], np.cumsum(c)[:-1]))
    ahead = before[np.flatnonzero(new)][np.cumsum(new) - 1]
    base = np.repeat(before[starts], np.diff(np.append(starts, len(q))))
    return order[ahead - base < k]


def _kth_of_pairs(query: np.ndarray, distance: np.ndarray, copies: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Every query and the distance at which it has seen k copies; infinite if there are not as many.

    Queries are numbered from 0 and few at a time, so that short integers sort by digits.
    """
    order = np.argsort(distance)
    short = query.astype(np.uint16) if len(query) and query.max() < 1 << 16 else query
    order = order[np.argsort(short[order], kind="stable")]
    q, seen = query[order], np.cumsum(copies[order])
    if not len(q):
        return q, np.empty(0)
    starts = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1])))
    before = seen[starts] - copies[order[starts]]
    at = np.searchsorted(seen, before + k)
    enough = at < np.append(starts[1:], len(q))
    return q[starts], np.where(enough, distance[order[np.minimum(at, len(q) - 1)]], np.inf)


def nearest_rows(
    points: DataFrame, queries: DataFrame, names: Sequence[str], leaf_rows: int = 1024,
    within: float = float("inf"), other: bool = False,
) -> DataFrame:
    """query, distance, carry of the nearest point of every query (ties: smallest carry).

    points (distinct coordinates) has carry, queries has query. other=True leaves
    out a point with the query's own coordinates; queries with no point within the
    given distance are missing from the result.
    """
    names = list(names)
    tree = split_tree(points, names, leaf_rows)
    shared = points.sparkSession.sparkContext.broadcast(tree)
    coords = ", ".join(f"{x} double" for x in names)
    query_type = queries.schema["query"].dataType.simpleString()
    carry_type = points.schema["carry"].dataType.simpleString()
    located = located_points(points.select("carry", *names), names, tree)
    asked = located_points(queries.select("query", *names), names, tree)

    def search(mine: pd.DataFrame, q: pd.DataFrame, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mine = mine.sort_values("carry", kind="stable")
        x, carry = mine[names].to_numpy(), mine["carry"].to_numpy()
        best, label = np.full(len(q), np.inf), np.zeros(len(q), dtype=np.int64)
        if len(x) and len(q):
            nest, at = Nest(x), q[names].to_numpy()
            # Any point bounds the search: some of each part of the leaf.
            some = x[nest.order[:: max(1, len(x) // ANCHORS)]]
            radius = np.minimum(bound, np.concatenate([_anchor_bounds(at[i : i + 256], some, 1, other) for i in range(0, len(at), 256)]))
            for query, point, d in nest.pairs(at, radius):
                if other:
                    keep = d > 0
                    query, point, d = query[keep], point[keep], d[keep]
                order = np.lexsort((point, d, query))[::-1]  # the nearest, then the smallest carry, is written last
                best[query[order]], label[query[order]] = d[order], carry[point[order]]
        return best, label

    def own(mine: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        best, _ = search(mine, q, np.full(len(q), np.inf))
        far = np.flatnonzero(np.isinf(best)) if len(q) else []
        if len(far):  # nothing in the leaf: any point bounds the search
            best[far] = _anchor_bounds(q[names].to_numpy()[far], shared.value.anchors, 1, other)
        return q[["query", *names]].assign(bound=np.minimum(best, within))

    bounded = cut_lineage(met(located, asked).applyInPandas(own, f"query {query_type}, {coords}, bound double"))

    def visit(batches):
        for pdf in batches:
            rows, leaves = shared.value.reached(pdf[names].to_numpy(), pdf["bound"].to_numpy())
            yield pdf.iloc[rows].assign(leaf=leaves)

    visits = bounded.mapInPandas(visit, f"query {query_type}, {coords}, bound double, leaf long")

    def answer(mine: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        best, label = search(mine, q, q["bound"].to_numpy())
        keep = (best <= q["bound"].to_numpy()) & np.isfinite(best)
        return pd.DataFrame({"query": q["query"][keep], "distance": best[keep], "carry": label[keep]})

    answers = met(located, visits).applyInPandas(answer, f"query {query_type}, distance double, carry {carry_type}")
    return answers.groupBy("query").agg(F.min(F.struct("distance", "carry")).alias("m")).select(
        "query", "m.distance", "m.carry"
    )


def neighbour_edges(points: DataFrame, names: Sequence[str], k: int, leaf_rows: int = 1024) -> DataFrame:
    """Edges point -> neighbour (distance, weight) covering the k nearest rows of every point.

    points has point, weight (copies) and the coordinates; a point's other copies
    are neighbours at distance 0. All points tied at the k-th distance are kept.
    """
    names = list(names)
    tree = split_tree(points, names, leaf_rows)
    shared = points.sparkSession.sparkContext.broadcast(tree)
    id_type = points.schema["point"].dataType.simpleString()
    coords = ", ".join(f"{x} double" for x in names)
    layout = f"point {id_type}, weight long, {coords}, leaf long"
    located = located_points(points.select("point", "weight", *names), names, tree)

    def own_bound(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.assign(bound=_own_bounds(pdf[names].to_numpy(), pdf["weight"].to_numpy(), k, shared.value)[0])

    bounded = located.groupBy("leaf").applyInPandas(own_bound, layout + ", bound double")
    if tree.rows > QUERIES_PER_TASK:
        bounded = cut_lineage(bounded)  # read twice

    def visit(batches):
        for pdf in batches:
            rows, leaves = shared.value.reached(pdf[names].to_numpy(), pdf["bound"].to_numpy())
            visits = pdf.iloc[rows][["point", *names, "bound"]]
            yield visits.assign(leaf=leaves)

    visits = bounded.mapInPandas(visit, f"point {id_type}, {coords}, bound double, leaf long")
    return _nearest_of(located, visits, names, k, tree)


def _own_bounds(x: np.ndarray, weight: np.ndarray, k: int, tree: SplitTree) -> tuple[np.ndarray, np.ndarray]:
    """How far the k-th neighbour of every point of a leaf can be, and whether that is the k-th distance inside the leaf."""
    nest = Nest(x)
    bound = nest.first_bounds(weight, k)
    inside = np.isfinite(bound)
    near = np.flatnonzero(inside)
    for query, point, d in nest.pairs(x[near], bound[near]):
        query = near[query]
        who, closest = _kth_of_pairs(query, d, weight[point] - (query == point), k)
        bound[who] = closest
    far = np.flatnonzero(np.isinf(bound))
    if len(far):  # fewer than k rows in the leaf; an anchor that is the point itself does not count
        bound[far] = _anchor_bounds(x[far], tree.anchors, k, True)
    inside[far] = False
    return bound, inside


def _nearest_of(located: DataFrame, visits: DataFrame, names: list[str], k: int, tree: SplitTree) -> DataFrame:
    """point, neighbour, distance, weight of the k nearest rows that visiting points find, with all tied at the k-th distance."""
    id_type = located.schema["point"].dataType.simpleString()

    def search(mine: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        x, w, ids = mine[names].to_numpy(), mine["weight"].to_numpy(), mine["point"].to_numpy()
        q, bound, who = queries[names].to_numpy(), queries["bound"].to_numpy(), queries["point"].to_numpy()
        out = []
        # A bound is itself a distance computed this way, so equality is exact.
        for query, point, d in Nest(x).pairs(q, bound) if len(x) else []:
            copies = w[point] - (who[query] == ids[point])
            some = copies > 0
            query, point, d, copies = query[some], point[some], d[some], copies[some]
            keep = _nearest_k(query, point, d, copies, k)  # only what the k nearest of this leaf can need
            out.append(pd.DataFrame({"point": who[query[keep]], "neighbour": ids[point[keep]], "distance": d[keep], "weight": copies[keep]}))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"point": [], "neighbour": [], "distance": [], "weight": []})

    candidates = met(located, visits, "point", tree.rows).applyInPandas(search, f"point {id_type}, neighbour {id_type}, distance double, weight long")
    # A point's candidates are about k per visited leaf; rows strictly nearer than a
    # candidate decide whether it is still among the k nearest.
    tied = Window.partitionBy("point").orderBy("distance").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    same = Window.partitionBy("point", "distance")
    nearer = F.sum("weight").over(tied) - F.sum("weight").over(same)
    return candidates.withColumn("_nearer", nearer).where(F.col("_nearer") < k).drop("_nearer")


def k_distances(points: DataFrame, names: Sequence[str], k: int, leaf_rows: int = 1024) -> tuple[DataFrame, SplitTree]:
    """points with leaf, radius (exact distance of the k-th nearest row) and alone, and the tree that the leaves are of.

    points has point (unique), weight (copies) and distinct coordinates; a point's other
    copies are at distance 0. ``alone`` says that no other leaf lies within the radius: such
    a point is settled where it is, and only the others, at the edges of a leaf, visit.
    """
    names = list(names)
    tree = split_tree(points, names, leaf_rows)
    shared = points.sparkSession.sparkContext.broadcast(tree)
    located = located_points(points, names, tree)
    layout = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in located.schema.fields)

    def own(t: pa.Table) -> pa.Table:
        x = _matrix(t, names)
        bound, inside = _own_bounds(x, t["weight"].to_numpy(), k, shared.value)
        rows, leaves = shared.value.reached(x, bound)
        inside[rows[leaves != t["leaf"][0].as_py()]] = False
        return t.append_column("radius", pa.array(bound)).append_column("alone", pa.array(inside))

    bounded = cut_lineage(located.groupBy("leaf").applyInArrow(own, layout + ", radius double, alone boolean"))
    edge = bounded.where(~F.col("alone"))
    asked = visits_of(edge, names, tree, own=True).withColumnRenamed("radius", "bound")
    found = _nearest_of(bounded.select("point", "weight", *names, "leaf"), asked, names, k, tree)
    exact = cut_lineage(found.groupBy("point").agg(F.max("distance").alias("radius")))
    settled = edge.drop("radius").join(exact, "point").select(bounded.columns)
    return bounded.where("alone").unionByName(settled), tree


def visits_of(ranged: DataFrame, names: Sequence[str], tree: SplitTree, own: bool = False) -> DataFrame:
    """point, coordinates, radius and leaf for every leaf within a point's radius, its own only if asked for."""
    names = list(names)
    shared = ranged.sparkSession.sparkContext.broadcast(tree)

    def visit(batches):
        for pdf in batches:
            rows, leaves = shared.value.reached(pdf[names].to_numpy(), pdf["radius"].to_numpy())
            if not own:
                other = leaves != pdf["leaf"].to_numpy()[rows]
                rows, leaves = rows[other], leaves[other]
            yield pdf.iloc[rows][["point", *names, "radius"]].assign(leaf=leaves)

    coords = ", ".join(f"{x} double" for x in names)
    data = ranged.select("point", *names, "radius", "leaf")
    return data.mapInPandas(visit, f"point {data.schema['point'].dataType.simpleString()}, {coords}, radius double, leaf long")


def neighbour_means(
    ranged: DataFrame, visits: DataFrame, names: Sequence[str], tree: SplitTree, value: str, name: str, reach: bool = False,
) -> DataFrame:
    """ranged with the mean of ``value`` over the rows within every point's radius; points with none are left out.

    reach=True takes the distance where it is greater. ranged and tree are those of
    ``k_distances``, visits those of its points that are not alone to other leaves. Pairs
    are met inside the leaves and only their sums leave a task, one row per point and leaf.
    """
    names = list(names)
    fields = ranged.columns
    layout = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranged.schema.fields)

    def sums(mine: pa.Table, q: pa.Table) -> pa.Table:
        x, who = _matrix(mine, names), q["point"].to_numpy()
        order = np.lexsort(x.T)  # sums must not depend on the order of rows
        x = x[order]
        w, ids, v = (mine[c].to_numpy()[order] for c in ("weight", "point", value))
        total, copies = np.zeros(len(who)), np.zeros(len(who))
        for query, point, d in Nest(x).pairs(_matrix(q, names), q["radius"].to_numpy()) if len(x) else []:
            c = w[point] - (who[query] == ids[point])
            total += np.bincount(query, c * (np.maximum(v[point], d) if reach else v[point]), len(who))
            copies += np.bincount(query, c, len(who))
        return q.append_column("total", pa.array(total)).append_column("copies", pa.array(copies.astype(np.int64)))

    def answer(mine: pa.Table, q: pa.Table) -> pa.Table:
        # The leaf's own points ask in its first part. Visitors have no weight.
        asking = q.select(["point", *names, "radius"])
        if "part" in mine.column_names and len(mine) and mine["part"][0].as_py():
            mine, own = mine.select(fields), mine.select(fields).slice(0, 0)
        else:
            mine = own = mine.select(fields)
        return sums(mine, pa.concat_tables([own, asking], promote_options="default"))

    summed = cut_lineage(met(ranged, visits, "point", tree.rows, every=True).applyInArrow(answer, f"{layout}, total double, copies long"))
    guests = summed.where("weight IS NULL").groupBy("point").agg(F.sum("total").alias("more"), F.sum("copies").alias("others"))
    inside = summed.where("weight IS NOT NULL")
    edge = inside.where(~F.col("alone")).join(cut_lineage(guests), "point", "left").select(
        *fields, (F.col("total") + F.coalesce("more", F.lit(0.0))).alias("total"),
        (F.col("copies") + F.coalesce("others", F.lit(0))).alias("copies"),
    )
    both = inside.where("alone").unionByName(edge).where("copies > 0")
    return both.select(*fields, (F.col("total") / F.col("copies")).alias(name))


def _matrix(t: pa.Table, names: Sequence[str]) -> np.ndarray:
    return np.column_stack([t[c].to_numpy() for c in names])
