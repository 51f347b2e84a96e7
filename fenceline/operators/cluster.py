"""Clusters among outliers: k-means with its choice of k, merged groups, DBSCAN, tendency.

Clustering works on a prepared table (prepare): the chosen rows, gaps filled by
medians or incomplete rows left out, columns standardised.
"""

from __future__ import annotations

from collections.abc import Sequence
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import add, counted_uniform, number
from ..functions.components import components
from ..functions.lineage import BROADCAST_ROWS, broadcast_if_small, cut_lineage, spread
from ..functions.rank import TASK_ROWS, column_quantiles, ranked_values
from .correlate import complete_numbers
from .neighbours import PAIRS, Nest, SplitTree, located_points, met, nearest_rows, split_tree
from .reduce import fit_components, scale_factors, standardise

# Fixed value: the 95 % point of chi-square with 2 degrees of freedom.
ELLIPSE_95 = 5.991464547107979

# Micro-clusters that are merged into groups: bounds what reaches the driver.
MICRO_CLUSTERS = 200

# Independent fits submitted at a time.
CONCURRENT_FITS = 4

# Rows of either side that one task compares block by block, about.
COMPARED_ROWS = 100_000


def prepare(
    df: DataFrame, columns: Sequence[str], row_id: str, fill: bool = True, task_rows: int = TASK_ROWS
) -> DataFrame:
    """row_id and standardised columns; gaps get the column median, or drop the row with fill=False."""
    columns = list(columns)
    if fill:
        medians = column_quantiles(df, columns, [0.5], task_rows=task_rows)
        data = df.select(row_id, *[
            F.coalesce(number(c), F.lit(float(medians[c][0] if medians[c][0] is not None else 0.0))).alias(c) for c in columns
        ])
    else:
        data = complete_numbers(df, columns, [row_id])
    return cut_lineage(standardise(data, columns, scale_factors(data, columns)))


def _vectors(data: DataFrame, columns: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol="features").transform(spread(data))


def _concurrently(spark, function, items: Sequence) -> list:
    """Run independent model fits as concurrent Spark jobs."""
    with ThreadPool(min(CONCURRENT_FITS, max(1, len(items)))) as pool:
        return pool.map(inheritable_thread_target(spark)(function), items)


def fit_kmeans(vectors: DataFrame, k: int, restarts: int = 1, seed: int = 42) -> KMeansModel:
    """The cheapest of several k-means fits."""
    fits = _concurrently(
        vectors.sparkSession,
        lambda i: KMeans(k=k, seed=seed + i, maxIter=300, tol=1e-4).fit(vectors),
        range(restarts),
    )
    return min(fits, key=lambda m: m.summary.trainingCost)


def _square_distance(columns: Sequence[str], cluster: Column, centres: np.ndarray) -> Column:
    """Squared distance of a row to the centre of its cluster, as an expression."""
    return add(
        (F.col(c) - F.element_at(F.array(*[F.lit(float(v)) for v in centres[:, j]]), cluster.cast("int") + 1)) ** 2
        for j, c in enumerate(columns)
    )


def cluster_quality(labelled: DataFrame, columns: Sequence[str], label: str = "cluster") -> dict[str, float]:
    """wss, Calinski-Harabasz and Davies-Bouldin from per-cluster sums (k rows reach the driver)."""
    means = labelled.groupBy(label).agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in columns]).collect()
    means.sort(key=lambda r: r[label])
    renumber = {r[label]: i for i, r in enumerate(means)}
    centres = np.array([[r[c] for c in columns] for r in means], dtype=float)
    sizes = np.array([r["n"] for r in means], dtype=float)
    place = F.lit(None).cast("int")
    for old, new in renumber.items():
        place = F.when(F.col(label) == old, new).otherwise(place)
    square = _square_distance(columns, F.col("_place"), centres)
    spread = {
        r["_place"]: r
        for r in labelled.withColumn("_place", place).groupBy("_place")
        .agg(F.sum(square).alias("ss"), F.avg(F.sqrt(square)).alias("mean")).collect()
    }
    k, n = len(sizes), sizes.sum()
    wss = float(sum(r["ss"] for r in spread.values()))
    overall = (centres * sizes[:, None]).sum(axis=0) / n
    between = float((sizes * ((centres - overall) ** 2).sum(axis=1)).sum())
    calinski = (between / (k - 1)) / (wss / (n - k)) if k > 1 and n > k and wss > 0 else float("nan")
    worst = []
    for i in range(k):
        ratios = [
            (spread[i]["mean"] + spread[j]["mean"]) / np.linalg.norm(centres[i] - centres[j])
            for j in range(k) if j != i and (centres[i] != centres[j]).any()
        ]
        worst.append(max(ratios, default=0.0))
    return {"wss": wss, "calinski_harabasz": float(calinski), "davies_bouldin": float(np.mean(worst))}


def evaluate_k(
    data: DataFrame, columns: Sequence[str], largest: int = 10, restarts: int = 1, seed: int = 42
) -> DataFrame:
    """k, wss, silhouette, calinski_harabasz, davies_bouldin for k = 2..largest (at most the rows there are).

    The silhouette is Spark's, on squared Euclidean distance.
    """
    top = min(largest, data.count())
    vectors = cut_lineage(_vectors(data, columns))
    evaluator = ClusteringEvaluator(featuresCol="features", predictionCol="cluster")

    def measure(k: int) -> tuple:
        model = fit_kmeans(vectors, k, restarts, seed)
        labelled = model.setPredictionCol("cluster").transform(vectors)
        quality = cluster_quality(labelled, columns)
        return (
            k, float(model.summary.trainingCost), float(evaluator.evaluate(labelled)),
            quality["calinski_harabasz"], quality["davies_bouldin"],
        )

    rows = _concurrently(data.sparkSession, measure, range(2, top + 1))
    return data.sparkSession.createDataFrame(
        rows, "k int, wss double, silhouette double, calinski_harabasz double, davies_bouldin double"
    )


def choose_k(evaluated: DataFrame) -> DataFrame:
    """One row: the k each criterion votes for and the recommended one (silhouette's)."""
    rows = sorted(evaluated.collect(), key=lambda r: r["k"])  # at most nine rows
    ks = [r["k"] for r in rows]
    drops = -np.diff([r["wss"] for r in rows])
    if len(drops) >= 2:
        bend = int(np.argmax(drops[:-1] - drops[1:])) + 2
        elbow = ks[bend] if bend < len(ks) else ks[len(ks) // 2]
    else:
        elbow = ks[0] if ks else 2
    best = {
        c: (ks[int(pick([r[c] for r in rows]))] if rows else 2)
        for c, pick in (("silhouette", np.argmax), ("calinski_harabasz", np.argmax), ("davies_bouldin", np.argmin))
    }
    return evaluated.sparkSession.createDataFrame(
        [(elbow, best["silhouette"], best["calinski_harabasz"], best["davies_bouldin"], best["silhouette"])],
        "elbow int, silhouette int, calinski_harabasz int, davies_bouldin int, recommended int",
    )


def k_by_inertia_drop(evaluated: DataFrame) -> int:
    """The k just before the largest relative fall of the within sum of squares."""
    rows = sorted(evaluated.collect(), key=lambda r: r["k"])
    falls = [(a["wss"] - b["wss"]) / a["wss"] if a["wss"] > 0 else 0.0 for a, b in zip(rows, rows[1:])]
    return rows[int(np.argmax(falls))]["k"] if falls else 2


def kmeans_clusters(
    data: DataFrame, columns: Sequence[str], row_id: str, k: int, restarts: int = 10, seed: int = 42
) -> dict[str, DataFrame]:
    """labels (with PC coordinates), clusters (size, share, PC centre, 95 % ellipse) and quality."""
    vectors = cut_lineage(_vectors(data, columns))
    model = fit_kmeans(vectors, k, restarts, seed)
    labelled = cut_lineage(model.setPredictionCol("cluster").transform(vectors))
    quality = cluster_quality(labelled, columns)
    quality["silhouette"] = float(
        ClusteringEvaluator(featuresCol="features", predictionCol="cluster").evaluate(labelled)
    )
    return _cluster_view(labelled.drop("features"), columns, row_id, quality)


def _cluster_view(labelled: DataFrame, columns: Sequence[str], row_id: str, quality: dict) -> dict[str, DataFrame]:
    components = fit_components(labelled, columns)
    scores = components.scores(labelled, [row_id, "cluster"], 2)
    stats = scores.groupBy("cluster").agg(
        F.count("*").alias("size"), F.avg("pc1").alias("pc1"), F.avg("pc2").alias("pc2"),
        F.coalesce(F.var_samp("pc1"), F.lit(0.0)).alias("v1"), F.coalesce(F.var_samp("pc2"), F.lit(0.0)).alias("v2"),
        F.coalesce(F.covar_samp("pc1", "pc2"), F.lit(0.0)).alias("c"),
    )
    total = labelled.count()
    half = (F.col("v1") + F.col("v2")) / 2
    root = F.sqrt(((F.col("v1") - F.col("v2")) / 2) ** 2 + F.col("c") ** 2)
    clusters = stats.select(
        "cluster", "size", (100.0 * F.col("size") / F.lit(total)).alias("percent"), "pc1", "pc2",
        F.sqrt(ELLIPSE_95 * (half + root)).alias("ellipse_long"),
        F.sqrt(F.greatest(ELLIPSE_95 * (half - root), F.lit(0.0))).alias("ellipse_short"),
        (F.atan2(2 * F.col("c"), F.col("v1") - F.col("v2")) / 2).alias("ellipse_angle"),
    )
    spark = labelled.sparkSession
    return {
        "labels": scores,
        "clusters": clusters,
        "quality": spark.createDataFrame([tuple(quality.values())], ", ".join(f"{q} double" for q in quality)),
        "loadings": components.loading_table(spark, 2),
        "centres": labelled.groupBy("cluster").agg(*[F.avg(c).alias(c) for c in columns]),
    }


def hierarchical_groups(
    data: DataFrame, columns: Sequence[str], row_id: str, groups: int, linkage: str = "ward",
    micro: int = MICRO_CLUSTERS, seed: int = 42,
) -> dict[str, DataFrame]:
    """Agglomerated groups: k-means micro-clusters merged by ward or centroid distance.

    Rows are clustered on Spark into `micro` small clusters (fewer only if there are
    fewer rows; quality names the number); only their sizes and centres, micro x p
    numbers, are merged on the driver.
    """
    if linkage not in ("ward", "centroid"):
        raise ValueError(f"unknown linkage: {linkage}")
    vectors = cut_lineage(_vectors(data, columns))
    micro = max(groups, min(micro, vectors.count()))
    model = fit_kmeans(vectors, micro, 1, seed)
    small = cut_lineage(model.setPredictionCol("micro").transform(vectors))
    found = small.groupBy("micro").agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in columns]).collect()
    members = {i: [r["micro"]] for i, r in enumerate(found)}
    size = {i: float(r["n"]) for i, r in enumerate(found)}
    centre = {i: np.array([r[c] for c in columns]) for i, r in enumerate(found)}
    heights = []
    while len(members) > groups:
        ids = sorted(members)
        points = np.array([centre[i] for i in ids])
        square = ((points[:, None, :] - points[None, :, :]) ** 2).sum(axis=2)
        n = np.array([size[i] for i in ids])
        cost = 2 * n[:, None] * n[None, :] / (n[:, None] + n[None, :]) * square if linkage == "ward" else square
        np.fill_diagonal(cost, np.inf)
        a, b = np.unravel_index(np.argmin(cost), cost.shape)
        heights.append(float(np.sqrt(cost[a, b])))
        a, b = ids[min(a, b)], ids[max(a, b)]
        centre[a] = (size[a] * centre[a] + size[b] * centre[b]) / (size[a] + size[b])
        size[a] += size.pop(b)
        members[a] += members.pop(b)
        centre.pop(b)
    mapping = {m: g for g, i in enumerate(sorted(members)) for m in members[i]}
    lookup = F.array(*[F.lit(mapping.get(m, 0)) for m in range(max(mapping) + 1)])
    labelled = small.withColumn("cluster", F.element_at(lookup, F.col("micro") + 1)).drop("micro")
    labelled = cut_lineage(labelled)
    quality = cluster_quality(labelled, columns)
    quality["silhouette"] = float(
        ClusteringEvaluator(featuresCol="features", predictionCol="cluster").evaluate(labelled)
    ) if groups > 1 else float("nan")
    quality["cut_height"] = heights[-1] if heights else 0.0
    quality["micro_clusters"] = float(len(found))
    return _cluster_view(labelled.drop("features"), columns, row_id, quality)


def outlier_subtypes(
    df: DataFrame, columns: Sequence[str], row_id: str, restarts: int = 10, seed: int = 42, largest: int = 5,
) -> dict[str, DataFrame]:
    """k-means of complete outlier rows with k = 2..largest by silhouette."""
    data = prepare(df, columns, row_id, fill=False)
    evaluated = evaluate_k(data, columns, largest, 1, seed)
    k = choose_k(evaluated).first()["silhouette"]
    return {"evaluated": evaluated, **kmeans_clusters(data, columns, row_id, k, restarts, seed)}


def clustering_tendency(data: DataFrame, columns: Sequence[str], seed: int = 42, leaf_rows: int = 1024) -> DataFrame:
    """Hopkins statistic over all rows: near 1 clustered, near one half uniform.

    As many uniform points as rows are drawn on Spark, each from its number and the seed,
    so that they do not depend on partitions; nearest rows are found exactly by space
    partitioning.
    """
    columns = list(columns)
    names = [f"x{i}" for i in range(len(columns))]
    rows = data.select(*[F.col(c).alias(x) for c, x in zip(columns, names)]).dropna()
    points = cut_lineage(rows.groupBy(*names).agg(F.count("*").alias("weight")))
    span = rows.agg(*[F.min(x).alias(f"low_{x}") for x in names], *[F.max(x).alias(f"high_{x}") for x in names]).first()
    n = rows.count()

    def total(queries: DataFrame, other: bool) -> float:
        asked = cut_lineage(queries.withColumn("query", F.monotonically_increasing_id()))
        found = nearest_rows(points.withColumn("carry", F.lit(0).cast("long")), asked, names, leaf_rows, other=other)
        return found.agg(F.sum("distance")).first()[0] or 0.0

    # A row with copies has its nearest row at distance 0.
    real = total(points.where("weight = 1").select(*names), True)
    drawn = total(
        data.sparkSession.range(n).select(*[
            (F.lit(span[f"low_{x}"]) + counted_uniform(F.col("id"), seed, i) * F.lit(span[f"high_{x}"] - span[f"low_{x}"])).alias(x)
            for i, x in enumerate(names)
        ]),
        False,
    )
    h = drawn / (drawn + real) if drawn + real > 0 else float("nan")
    label = "strong" if h > 0.7 else "moderate" if h > 0.5 else "weak"
    return data.sparkSession.createDataFrame([(n, float(h), label)], "n long, hopkins double, tendency string")


# ---------------------------------------------------------------- DBSCAN


def dbscan(
    data: DataFrame, columns: Sequence[str], row_id: str, eps: float, min_rows: int, leaf_rows: int = 512,
) -> DataFrame:
    """row_id, cluster (-1 noise), is_core by density with radius eps.

    Equal rows are folded first. Neighbour counts come from a split tree: leaves
    wholly inside the radius count as a sum, only leaves cut by it are visited, and
    counts (never pairs) leave a task. Core rows are joined into clusters through
    cells whose rows are all within eps of each other, so a dense cluster is a
    handful of cells however many rows it has. A border row takes the cluster of
    its nearest core row.
    """
    columns = list(columns)
    names = [f"x{i}" for i in range(len(columns))]
    rows = data.select(row_id, *[F.col(c).alias(x) for c, x in zip(columns, names)]).dropna()
    points = cut_lineage(
        rows.groupBy(*names).agg(F.count("*").alias("weight"), F.min(row_id).alias("point"))
    )
    tree = split_tree(points, names, leaf_rows)
    # A leaf's rows lie together, so that a batch of them walks few branches of the tree.
    located = cut_lineage(located_points(points, names, tree).repartition("leaf").sortWithinPartitions("leaf"))
    core = cut_lineage(_mark_core(located, names, tree, eps, min_rows))
    if core.where("is_core").isEmpty():
        return rows.select(row_id, F.lit(-1).cast("long").alias("cluster"), F.lit(False).alias("is_core"))
    labels = _join_cells(core.where("is_core"), names, eps)
    cored = core.where("is_core").select("point", *names).withColumn("grid", _cell(names, eps))
    core_labels = cut_lineage(cored.join(labels, "grid").select("point", *names, "label"))
    numbered = _number_labels(core_labels)
    core_labels = cut_lineage(core_labels.join(numbered, "label").select("point", *names, "cluster"))
    border = _border_clusters(core.where("NOT is_core"), core_labels, names, eps, leaf_rows)
    everything = core_labels.select("point", "cluster").unionByName(border.select("point", "cluster"))
    by_point = (
        core.join(everything, "point", "left")
        .select(*names, F.coalesce("cluster", F.lit(-1)).cast("long").alias("cluster"), "is_core")
    )
    return rows.join(by_point, names).select(row_id, "cluster", "is_core")


def _mark_core(located: DataFrame, names: list[str], tree: SplitTree, eps: float, least: int) -> DataFrame:
    """located with is_core: at least `least` rows (itself included) within eps."""
    leaf_facts = located.groupBy("leaf").agg(
        F.sum("weight").alias("w"), *[F.min(x).alias(f"low_{x}") for x in names], *[F.max(x).alias(f"high_{x}") for x in names]
    ).collect()  # one row per leaf of the tree
    leaves = 1 << tree.depth
    low, high = np.full((leaves, len(names)), np.inf), np.full((leaves, len(names)), -np.inf)
    weight = np.zeros(leaves)
    for r in leaf_facts:
        low[r["leaf"]] = [r[f"low_{x}"] for x in names]
        high[r["leaf"]] = [r[f"high_{x}"] for x in names]
        weight[r["leaf"]] = r["w"]
    # Boxes and sums of inner nodes, from the leaves up.
    boxes_low, boxes_high, sums = [low], [high], [weight]
    while len(sums[0]) > 1:
        boxes_low.insert(0, np.minimum(boxes_low[0][0::2], boxes_low[0][1::2]))
        boxes_high.insert(0, np.maximum(boxes_high[0][0::2], boxes_high[0][1::2]))
        sums.insert(0, sums[0][0::2] + sums[0][1::2])
    box_low, box_high, total = np.vstack(boxes_low), np.vstack(boxes_high), np.concatenate(sums)
    shared = located.sparkSession.sparkContext.broadcast((box_low, box_high, total))
    inner, limit = leaves - 1, eps * eps
    id_type = located.schema["point"].dataType.simpleString()
    coords = ", ".join(f"{x} double" for x in names)

    def sure(batches):
        lows, highs, weights = shared.value
        for pdf in batches:
            x = pdf[names].to_numpy()
            counted = np.zeros(len(x))
            visit_rows, visit_leaves = [], []
            stack = [(0, np.arange(len(x)))]
            while stack:
                node, who = stack.pop()
                if weights[node] == 0:
                    continue
                who = who[counted[who] < least]
                p = x[who]
                gap = np.maximum(np.maximum(lows[node] - p, p - highs[node]), 0.0)
                far = np.maximum(np.abs(p - lows[node]), np.abs(p - highs[node]))
                near = (gap * gap).sum(axis=1) <= limit * (1 + 1e-12)
                whole = near & ((far * far).sum(axis=1) <= limit * (1 - 1e-12))
                counted[who[whole]] += weights[node]
                part = who[near & ~whole]
                if part.size == 0:
                    continue
                if node >= inner:
                    visit_rows.append(part)
                    visit_leaves.append(np.full(part.size, node - inner))
                else:
                    stack.append((2 * node + 1, part))
                    stack.append((2 * node + 2, part))
            # leaf -1 carries the sure count; other rows ask a leaf for its share
            base = pdf[["point", *names]].assign(leaf=-1, counted=counted)
            yield base
            if visit_rows:
                r, l = np.concatenate(visit_rows), np.concatenate(visit_leaves)
                open_ = counted[r] < least
                ask = pdf.iloc[r[open_]][["point", *names]]
                yield ask.assign(leaf=l[open_], counted=0.0)

    asked = cut_lineage(
        located.mapInPandas(sure, f"point {id_type}, {coords}, leaf long, counted double")
    )

    def answer(mine: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        x, w = mine[names].to_numpy(), mine["weight"].to_numpy(float)
        q = queries[names].to_numpy()
        counts = np.zeros(len(q))
        for query, point, _ in Nest(x).pairs(q, np.full(len(q), eps)) if len(x) else []:
            counts += np.bincount(query, weights=w[point], minlength=len(q))
        return pd.DataFrame({"point": queries["point"], "counted": counts})

    shares = met(located, asked.where("leaf >= 0"), "point", tree.rows).applyInPandas(answer, f"point {id_type}, counted double")
    counts = (
        asked.where("leaf < 0").select("point", "counted").unionByName(shares)
        .groupBy("point").agg(F.sum("counted").alias("counted"))
    )
    return located.join(counts, "point").withColumn("is_core", F.col("counted") >= least).drop("counted")


def _cell(names: Sequence[str], eps: float) -> Column:
    """Grid cell whose rows are all within eps of each other."""
    side = eps / len(names) ** 0.5 * (1 - 1e-9)
    return F.concat_ws("_", *[F.floor(F.col(x) / F.lit(side)).cast("string") for x in names])


def _core_cells(core: DataFrame, names: list[str], eps: float) -> DataFrame:
    """Cells of core rows (grid, and cell, a number): box centre, tight box and the extreme rows along every axis."""
    celled = core.withColumn("grid", _cell(names, eps))
    boxes = celled.groupBy("grid").agg(
        *[F.min(x).alias(f"low_{x}") for x in names],
        *[F.max(x).alias(f"high_{x}") for x in names],
        F.flatten(F.array(*[p(F.array(*names), F.col(x)) for x in names for p in (F.min_by, F.max_by)])).alias("corners"),
    )
    centres = [((F.col(f"low_{x}") + F.col(f"high_{x}")) / 2).alias(x) for x in names]
    return cut_lineage(boxes.select("*", *centres, F.monotonically_increasing_id().alias("cell")))


def _join_cells(core: DataFrame, names: list[str], eps: float) -> DataFrame:
    """grid, label: cells connect if two of their core rows are within eps.

    Most neighbouring cells are settled by their boxes and extreme rows. Rows are
    only compared for pairs still open whose cells are not connected anyway; what
    they add joins the groups found so far.
    """
    cells = _core_cells(core, names, eps)
    pairs = cut_lineage(_near_cells(cells, names, eps))
    labels = cut_lineage(_connected(cells.select("cell"), pairs.where("sure").select("a", "b")))
    of_a = labels.select(F.col("cell").alias("a"), F.col("label").alias("label_a"))
    of_b = labels.select(F.col("cell").alias("b"), F.col("label").alias("label_b"))
    open_pairs = cut_lineage(pairs.where("NOT sure").drop("sure").join(of_a, "a").join(of_b, "b").where("label_a <> label_b"))
    if not open_pairs.isEmpty():
        open_cells = open_pairs.select(F.col("a").alias("cell")).union(open_pairs.select("b")).distinct()
        asked = cells.select("grid", "cell").join(open_cells, "cell")
        rows = cut_lineage(core.withColumn("grid", _cell(names, eps)).join(asked, "grid").select("cell", "leaf", *names))
        found = _touching(open_pairs.select("a", "b"), rows, names, eps)
        between = cut_lineage(open_pairs.join(found, ["a", "b"]).select(F.col("label_a").alias("a"), F.col("label_b").alias("b")).distinct())
        groups = _connected(labels.select(F.col("label").alias("cell")).distinct(), between)
        labels = labels.join(groups.select(F.col("cell").alias("label"), F.col("label").alias("group")), "label").select("cell", F.col("group").alias("label"))
    return cells.select("grid", "cell").join(labels, "cell").select("grid", "label")


def _near_cells(cells: DataFrame, names: list[str], eps: float) -> DataFrame:
    """a, b, sure for cells (a < b) whose boxes are within eps."""
    tree = split_tree(cells, names, 256)
    shared = cells.sparkSession.sparkContext.broadcast(tree)
    box = [f"{side}_{x}" for side in ("low", "high") for x in names]
    layout = "cell long, corners array<double>, " + ", ".join(f"{c} double" for c in [*box, *names])
    fields = ["cell", "corners", *box, *names]

    def locate(batches):
        for pdf in batches:
            yield pdf.assign(leaf=shared.value.leaf(pdf[names].to_numpy()))

    def visit(batches):
        # A cell is at most eps across, so centres of near cells are within 2 eps.
        for pdf in batches:
            rows, leaves = shared.value.reached(pdf[names].to_numpy(), np.full(len(pdf), 2 * eps))
            yield pdf.iloc[rows].assign(leaf=leaves)

    located = cells.select(*fields).mapInPandas(locate, layout + ", leaf long")
    visits = cells.select(*fields).mapInPandas(visit, layout + ", leaf long")
    lows, highs = box[: len(names)], box[len(names) :]

    def match(mine: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        p = len(names)
        m_low, m_high, ids = mine[lows].to_numpy(), mine[highs].to_numpy(), mine["cell"].to_numpy()
        q_low, q_high, who = queries[lows].to_numpy(), queries[highs].to_numpy(), queries["cell"].to_numpy()
        if not len(mine) or not len(queries):
            return pd.DataFrame({"a": [], "b": [], "sure": []})
        m_ends, q_ends = (np.stack(f["corners"].to_numpy()).reshape(len(f), 2 * p, p) for f in (mine, queries))
        out, step = [], max(1, PAIRS // (len(mine) * 4 * p))
        for at in range(0, len(queries), step):
            here = slice(at, at + step)
            gap = np.zeros((len(who[here]), len(mine)))
            for i in range(p):
                g = np.maximum(np.maximum(q_low[here, None, i] - m_high[None, :, i], m_low[None, :, i] - q_high[here, None, i]), 0.0)
                gap += g * g
            a, b = np.nonzero((gap <= eps * eps * (1 + 1e-12)) & (ids[None, :] > who[here][:, None]))
            d = np.zeros((len(a), 2 * p, 2 * p))
            for i in range(p):
                g = q_ends[at + a][:, :, None, i] - m_ends[b][:, None, :, i]
                d += g * g
            out.append(pd.DataFrame({"a": who[at + a], "b": ids[b], "sure": (np.sqrt(d) <= eps).any(axis=(1, 2))}))
        return pd.concat(out, ignore_index=True)

    return met(located, visits, "cell", tree.rows).applyInPandas(match, "a long, b long, sure boolean")


def _touching(pairs: DataFrame, core: DataFrame, names: list[str], eps: float, task_rows: int = COMPARED_ROWS) -> DataFrame:
    """The pairs of cells with two core rows within eps.

    Rows of a cell are split by tree leaf, so a compared block is at most two
    leaves large, and blocks too far apart are never built. A task compares as many
    blocks as have about ``task_rows`` rows.
    """
    blocks = core.groupBy("cell", "leaf").agg(
        F.count("*").alias("rows"), *[F.min(x).alias(f"low_{x}") for x in names], *[F.max(x).alias(f"high_{x}") for x in names]
    )

    def side(s: str) -> DataFrame:
        return blocks.select(
            F.col("cell").alias(s), F.col("leaf").alias(f"leaf_{s}"), F.col("rows").alias(f"rows_{s}"),
            *[F.col(f"{e}_{x}").alias(f"{e}_{x}_{s}") for e in ("low", "high") for x in names],
        )

    gap = [
        F.greatest(F.col(f"low_{x}_a") - F.col(f"high_{x}_b"), F.col(f"low_{x}_b") - F.col(f"high_{x}_a"), F.lit(0.0))
        for x in names
    ]
    near = pairs.join(side("a"), "a").join(side("b"), "b").where(add(g * g for g in gap) <= eps * eps * (1 + 1e-12))
    near = cut_lineage(
        near.select("a", "b", "leaf_a", "leaf_b", (F.col("rows_a") + F.col("rows_b")).alias("rows"), F.monotonically_increasing_id().alias("block"))
    )
    tasks = -(-(near.agg(F.sum("rows")).first()[0] or 0) // task_rows) or 1
    dealt = near.withColumn("task", F.pmod(F.xxhash64("block"), F.lit(tasks)))

    def rows_of(s: str) -> DataFrame:
        # Columns of their own on either side, or the two sides could not be told apart.
        own = core.select(F.col("cell").alias(s), F.col("leaf").alias(f"leaf_{s}"), *[F.col(x).alias(x) for x in names])
        return dealt.toDF(*dealt.columns).join(own, [s, f"leaf_{s}"]).select("a", "b", "block", "task", *names).groupBy("task")

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        # Every block has rows on both sides.
        left, right = left.sort_values("block", kind="stable"), right.sort_values("block", kind="stable")
        known, starts = np.unique(left["block"].to_numpy(), return_index=True)
        ends = np.append(starts[1:], len(left))
        others = np.searchsorted(right["block"].to_numpy(), known), np.searchsorted(right["block"].to_numpy(), known, side="right")
        p, q = left[names].to_numpy(), right[names].to_numpy()
        hits = []
        for start, end, first, last in zip(starts.tolist(), ends.tolist(), *(o.tolist() for o in others)):
            mine = q[None, first:last]
            for at in range(start, end, 256):
                if (np.sqrt(((p[at : min(at + 256, end), None] - mine) ** 2).sum(axis=2)) <= eps).any():
                    hits.append(start)
                    break
        return left[["a", "b"]].iloc[hits].drop_duplicates()

    return rows_of("a").cogroup(rows_of("b")).applyInPandas(compare, "a long, b long").distinct()


def _stars(edges: DataFrame) -> DataFrame:
    """Edges (a, b) that connect the same nodes: in every batch a node meets its component's first node at once, so paths get shorter."""
    kind = edges.schema["a"].dataType.simpleString()

    def contract(batches):
        for pdf in batches:
            codes, nodes = pd.factorize(np.concatenate([pdf["a"].to_numpy(), pdf["b"].to_numpy()]))
            parent = list(range(len(nodes)))
            for a, b in zip(codes[: len(pdf)].tolist(), codes[len(pdf) :].tolist()):
                while parent[a] != a:
                    parent[a] = a = parent[parent[a]]
                while parent[b] != b:
                    parent[b] = b = parent[parent[b]]
                parent[max(a, b)] = min(a, b)
            for k in range(len(parent)):  # a parent comes before its children
                parent[k] = parent[parent[k]]
            away = np.flatnonzero(np.array(parent, dtype=np.int64) != np.arange(len(parent)))
            yield pd.DataFrame({"a": nodes[away], "b": nodes[np.array(parent, dtype=np.int64)[away]]})

    return edges.select("a", "b").mapInPandas(contract, f"a {kind}, b {kind}")


def _connected(nodes: DataFrame, edges: DataFrame, driver_rows: int = BROADCAST_ROWS) -> DataFrame:
    """cell, label: the smallest cell of each connected component.

    Edge lists counted to be small are joined on the driver, larger ones by
    ``components``, whose rounds grow with the logarithm of the longest path.
    """
    few = edges.limit(driver_rows + 1).collect()
    if len(few) <= driver_rows:
        parent: dict = {}

        def top(c):
            while parent.get(c, c) != c:
                parent[c] = parent.get(parent[c], parent[c])
                c = parent[c]
            return c

        for e in few:
            a, b = sorted((top(e["a"]), top(e["b"])))
            parent[a] = a
            parent[b] = a
        kind = edges.schema["a"].dataType.simpleString()
        found = edges.sparkSession.createDataFrame([(c, top(c)) for c in parent], f"cell {kind}, label {kind}")
        found = broadcast_if_small(found)
    else:
        found = components(_stars(edges)).select(F.col("node").alias("cell"), F.col("component").alias("label"))
    return nodes.select("cell").join(found, "cell", "left").select("cell", F.coalesce("label", "cell").alias("label"))


def _number_labels(core_labels: DataFrame) -> DataFrame:
    """label, cluster: clusters numbered from 0 by their first core row."""
    first = core_labels.groupBy("label").agg(F.min("point").alias("x"))
    placed = ranked_values(first.withColumn("all_rows", F.lit(0)), ["all_rows"], "x").select(
        "x", F.col("below").alias("cluster")
    )
    return first.join(placed, "x").select("label", "cluster")


def _border_clusters(
    others: DataFrame, core_labels: DataFrame, names: list[str], eps: float, leaf_rows: int
) -> DataFrame:
    """point, cluster of the rows that are not core but within eps of a core row."""
    found = nearest_rows(
        core_labels.select(*names, F.col("cluster").alias("carry")),
        others.select(F.col("point").alias("query"), *names), names, leaf_rows, within=eps,
    )
    return found.select(F.col("query").alias("point"), F.col("carry").alias("cluster"))
