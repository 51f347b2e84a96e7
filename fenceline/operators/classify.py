"""Classifiers that tell outliers from the rest, and how good they are."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import special
from ..functions.columns import number, scalar_function
from ..functions.lineage import broadcast_if_small, cut_lineage, spread
from ..functions.rank import TASK_ROWS, column_quantiles, ranked_counts, ranked_values
from .information import neighbour_information
from .profile import is_numeric
from .reduce import scale_factors, standardise


# Training rows of a forest that one task reads. Each carries a weight for every tree, about half a kilobyte for 100 trees.
FOREST_ROWS = 400_000


# ---------------------------------------------------------------- preparation


def encode(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Complete rows with text columns replaced by alphabetical codes 0, 1, ..."""
    columns = list(columns)
    text = [c for c in columns if not is_numeric(df, c)]
    data = df.select(
        *keep, *[F.col(c).cast("string").alias(c) if c in text else number(c).alias(c) for c in columns]
    ).dropna("any", subset=columns)
    if not text:
        return data
    for c in text:
        codes = _alphabetical_codes(data.select(F.col(c).alias("_value")).distinct())
        data = data.join(broadcast_if_small(codes), F.col(c) == F.col("_value")).withColumn(c, F.col("_code")).drop("_value", "_code")
    return data.select(*keep, *columns)


def _alphabetical_codes(values: DataFrame) -> DataFrame:
    """_value, _code: how many of the distinct values come before it.

    Values are dealt out by ranges and numbered inside each; only the sizes of the
    ranges meet in one task.
    """
    ranged = cut_lineage(values.repartitionByRange("_value").withColumn("_piece", F.spark_partition_id()))
    before = Window.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("_piece").count().select("_piece", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_piece").orderBy("_value")
    numbered = ranged.withColumn("_place", F.row_number().over(inside) - 1)
    return numbered.join(F.broadcast(starts), "_piece").select(  # one row per range
        "_value", (F.col("_start") + F.col("_place")).cast("double").alias("_code")
    )


def stratified_split(
    df: DataFrame, label: str, row_id: str, test_share: float = 0.2, order: Column | None = None,
    task_rows: int = TASK_ROWS,
) -> DataFrame:
    """df with is_test: round(n * test_share) of a label's n rows, the first by a hash of row_id; one row at least trains.

    The cut of each label is an exact order statistic, so no label is sorted in one
    task and the split is the same however rows are distributed. Rows that tie at the
    cut train.
    """
    position = order if order is not None else F.xxhash64(F.col(row_id), F.lit(42))
    keyed = df.withColumn("_order", position)
    ranked = ranked_values(keyed.select(F.col(label).alias("_label"), F.col("_order").alias("x")), ["_label"], task_rows=task_rows)
    wanted = F.least(F.round(F.col("n") * test_share), F.col("n") - 1)
    cuts = ranked.where((F.col("below") <= wanted) & (wanted < F.col("below") + F.col("cnt"))).select("_label", F.col("x").alias("_cut"))
    split = keyed.join(broadcast_if_small(cuts), F.col(label).eqNullSafe(F.col("_label")))
    return split.withColumn("is_test", F.col("_order") < F.col("_cut")).drop("_order", "_label", "_cut")


# ---------------------------------------------------------------- metrics


def roc_curve(scored: DataFrame, label: str = "label", score: str = "score", task_rows: int = TASK_ROWS) -> DataFrame:
    """threshold, tp, fp, tpr, fpr for thresholds descending, from (0, 0)."""
    folded = scored.groupBy((-F.col(score)).alias("x")).agg(
        F.count("*").alias("cnt"), F.sum(F.col(label).cast("long")).alias("positives")
    )
    totals = scored.agg(F.sum(F.col(label).cast("long")), F.count("*")).first()
    p, n = totals[0] or 0, totals[1] - (totals[0] or 0)
    ranked = ranked_counts(folded.withColumn("all_rows", F.lit(0)), ["all_rows"], "x", ["positives"], task_rows)
    tp = F.col("below_positives") + F.col("positives")
    fp = F.col("below") + F.col("cnt") - tp
    points = ranked.select((-F.col("x")).alias("threshold"), tp.alias("tp"), fp.alias("fp"))
    start = scored.sparkSession.createDataFrame([(1.0, 0, 0)], "threshold double, tp long, fp long")
    return start.unionByName(points).select(
        "threshold", "tp", "fp", (F.col("tp") / F.lit(float(max(p, 1)))).alias("tpr"),
        (F.col("fp") / F.lit(float(max(n, 1)))).alias("fpr"),
    )


def area_under_roc(scored: DataFrame, label: str = "label", score: str = "score", task_rows: int = TASK_ROWS) -> float:
    """Share of (positive, negative) pairs ranked rightly, ties half; 0.5 with one class only."""
    folded = scored.groupBy(F.col(score).alias("x")).agg(
        F.count_if(F.col(label).cast("int") == 0).alias("cnt"), F.sum(F.col(label).cast("long")).alias("positives")
    )
    ranked = ranked_counts(folded.withColumn("all_rows", F.lit(0)), ["all_rows"], "x", ["positives"], task_rows)
    row = ranked.agg(
        F.sum(F.col("positives") * (F.col("below") + F.col("cnt") / 2.0)), F.sum("positives"), F.sum("cnt")
    ).first()
    return float(row[0]) / (float(row[1]) * float(row[2])) if row[1] and row[2] else 0.5


def classification_metrics(
    scored: DataFrame, label: str = "label", score: str = "score", threshold: float = 0.5, task_rows: int = TASK_ROWS
) -> DataFrame:
    """One row: auc, tp, fp, tn, fn, accuracy, precision, recall (sensitivity), specificity, f1."""
    positive, hit = F.col(label).cast("int") == 1, F.col(score) > threshold
    counts = scored.agg(
        F.count_if(positive & hit).alias("tp"), F.count_if(~positive & hit).alias("fp"),
        F.count_if(~positive & ~hit).alias("tn"), F.count_if(positive & ~hit).alias("fn"),
    )

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(0.0)

    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return counts.select(
        F.lit(area_under_roc(scored, label, score, task_rows)).alias("auc"), "tp", "fp", "tn", "fn",
        ratio(tp + tn, tp + fp + tn + fn).alias("accuracy"), precision.alias("precision"), recall.alias("recall"),
        ratio(tn, tn + fp).alias("specificity"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


# ---------------------------------------------------------------- feature ranking


def _binned_information(data: DataFrame, columns: list[str], bins: int, n_rows: int, task_rows: int) -> DataFrame:
    edges = column_quantiles(data, columns, [i / bins for i in range(1, bins)], n_rows, task_rows)
    binned = data.select("label", *[
        sum(((F.col(c) > F.lit(e)).cast("int") for e in sorted(set(edges[c]))), F.lit(0)).alias(c) for c in columns
    ])
    cells = binned.unpivot(["label"], columns, "variable", "bin").groupBy("variable", "label", "bin").count()
    by_bin = Window.partitionBy("variable", "bin")
    by_label = Window.partitionBy("variable", "label")
    total = F.lit(float(n_rows))
    term = F.col("count") / total * F.log(
        F.col("count") * total / (F.sum("count").over(by_bin) * F.sum("count").over(by_label))
    )
    return cells.withColumn("term", term).groupBy("variable").agg(
        F.greatest(F.sum("term"), F.lit(0.0)).alias("mutual_information")
    )


def rank_features(
    df: DataFrame, columns: Sequence[str], flag: str = "is_outlier", bins: int = 10, task_rows: int = TASK_ROWS,
    neighbours: int | None = None,
) -> DataFrame:
    """Features by the mean of their scaled F statistic and mutual information with the label.

    Mutual information (in nats) is taken over quantile bins of the feature, or, given a
    number of neighbours, estimated from them (see ``information.neighbour_information``).
    """
    columns = list(columns)
    data = df.select(F.col(flag).alias("label"), *[number(c).alias(c) for c in columns]).dropna("any")
    n_rows = data.count()
    row = data.groupBy("label").agg(
        F.count("*").alias("n"),
        *[F.struct(F.avg(c).alias("m"), F.var_pop(c).alias("v")).alias(f"c{i}") for i, c in enumerate(columns)],
    ).collect()  # one row per label
    if neighbours is None:
        information = _binned_information(data, columns, bins, n_rows, task_rows)
    else:
        information = neighbour_information(data, columns, "label", neighbours, task_rows)
    rows = []
    for i, c in enumerate(columns):
        mean = sum(r["n"] * r[f"c{i}"]["m"] for r in row) / n_rows
        between = sum(r["n"] * (r[f"c{i}"]["m"] - mean) ** 2 for r in row)
        within = sum(r["n"] * r[f"c{i}"]["v"] for r in row)
        d1, d2 = len(row) - 1, n_rows - len(row)
        f = (between / d1) / (within / d2) if d1 > 0 and d2 > 0 and within > 0 else 0.0
        rows.append((c, float(f), special.f_sf(f, d1, d2) if f > 0 else 1.0))
    scores = df.sparkSession.createDataFrame(rows, "variable string, f double, f_p_value double")
    everything = Window.partitionBy(F.lit(0))  # one row per named column
    joined = scores.join(information, "variable")

    def scaled(c: str) -> Column:
        top = F.max(c).over(everything)
        return F.when(top > 0, F.col(c) / top).otherwise(0.0)

    combined = (scaled("f") + scaled("mutual_information")) / 2
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("importance"), "variable")
    return joined.withColumn("importance", combined).withColumn("position", F.row_number().over(order))


def select_features(ranking: DataFrame, max_features: int) -> list[str]:
    return [r["variable"] for r in ranking.where(F.col("position") <= max_features).orderBy("position").collect()]


# ---------------------------------------------------------------- models


def _split_data(df, columns, row_id, flag, test_share, task_rows):
    marked = df.withColumn("label", F.col(flag).cast("double"))
    coded = encode(marked, columns, [row_id, "label"])
    return cut_lineage(spread(stratified_split(coded, "label", row_id, test_share, task_rows=task_rows)))


def _class_counts(data: DataFrame) -> dict[float, int]:
    return {r["label"]: r["count"] for r in data.groupBy("label").count().collect()}


def logistic_characterisation(
    df: DataFrame, columns: Sequence[str], row_id: str, flag: str = "is_outlier", c: float = 1.0,
    test_share: float = 0.2, max_features: int | None = None, task_rows: int = TASK_ROWS,
) -> dict[str, DataFrame]:
    """Ridge logistic regression of the outlier label: metrics, roc, coefficients, wald, warnings, selection.

    Trained on the standardised training part, measured on the test part. With
    max_features only the best ranked features are kept if there are more; text is
    ranked by its codes. selection says of every feature whether it was kept.
    """
    columns = offered = [x for x in columns if x != row_id]
    if max_features and len(columns) > max_features:
        coded = encode(df, columns, [flag])
        columns = select_features(rank_features(coded, columns, flag, task_rows=task_rows), max_features)
    data = _split_data(df, columns, row_id, flag, test_share, task_rows)
    sizes = _class_counts(data)
    if sum(sizes.values()) < 20 or len(sizes) < 2:
        raise ValueError("at least 20 complete rows of two classes are needed")
    factors = scale_factors(data.where("NOT is_test"), columns)
    scaled = standardise(data, columns, factors)
    train, test = scaled.where("NOT is_test"), scaled.where("is_test")
    train_sizes, test_sizes = _class_counts(train), _class_counts(test)
    n_train = sum(train_sizes.values())
    assembler = VectorAssembler(inputCols=columns, outputCol="features")
    vectors = assembler.transform(train).persist(StorageLevel.MEMORY_AND_DISK)
    model = LogisticRegression(
        maxIter=1000, tol=1e-7, regParam=1.0 / (c * n_train), elasticNetParam=0.0, standardization=False
    ).fit(vectors)
    scored = model.transform(assembler.transform(test)).select(
        "label", vector_to_array("probability")[1].alias("score")
    )
    scored = cut_lineage(scored)
    spark = df.sparkSession
    coefficients = spark.createDataFrame(
        [("intercept", float(model.intercept)), *[(x, float(b)) for x, b in zip(columns, model.coefficients)]],
        "term string, estimate double",
    )
    metrics = classification_metrics(scored, task_rows=task_rows)
    result = metrics.first()
    span = scored.agg(F.min("score"), F.max("score")).first()
    wald = wald_table(vectors, columns)
    vectors.unpersist()
    warnings = {
        "few rows per variable": len(columns) > n_train / 10,
        "minority class under 5 in training": len(train_sizes) < 2 or min(train_sizes.values()) < 5,
        "minority class under 5 in test": len(test_sizes) < 2 or min(test_sizes.values()) < 5,
        "possible perfect separation": span[0] is not None and (span[0] < 0.001 or span[1] > 0.999),
        "suspiciously perfect metrics": result["auc"] >= 0.99 and result["accuracy"] >= 0.99,
    }
    return {
        "metrics": metrics,
        "roc": roc_curve(scored, task_rows=task_rows),
        "coefficients": coefficients,
        "wald": wald,
        "warnings": spark.createDataFrame(list(warnings.items()), "warning string, raised boolean"),
        "selection": spark.createDataFrame([(x, x in columns) for x in offered], "variable string, kept boolean"),
    }


def wald_table(vectors: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Unpenalised logit: estimate, std_error, z, p_value, odds ratio (estimate clipped to 50) and extreme mark."""
    model = GeneralizedLinearRegression(family="binomial", link="logit", maxIter=35, tol=1e-8).fit(vectors)
    summary = model.summary
    errors, z, p = summary.coefficientStandardErrors, summary.tValues, summary.pValues
    # Spark lists the intercept last.
    terms = [*columns, "intercept"]
    estimates = [*model.coefficients, model.intercept]
    rows = [
        (t, float(b), float(e), float(zz), float(pp), math.exp(max(-50.0, min(50.0, float(b)))), bool(abs(b) > 20))
        for t, b, e, zz, pp in zip(terms, estimates, errors, z, p)
    ]
    return vectors.sparkSession.createDataFrame(
        rows, "term string, estimate double, std_error double, z double, p_value double, odds_ratio double, extreme boolean"
    )


def _in_parts(data: DataFrame, n: int, rows: int = FOREST_ROWS) -> DataFrame:
    """data, whose n rows are dealt anew only if its partitions would have more than ``rows`` on average."""
    parts = -(-n // rows)
    return data.repartition(parts) if data.rdd.getNumPartitions() < parts else data


def random_forest(
    df: DataFrame, columns: Sequence[str], row_id: str, flag: str = "is_outlier", test_share: float = 0.2,
    seed: int = 42, task_rows: int = TASK_ROWS, trees: int = 100, depth: int = 10, leaf: int = 1,
) -> dict[str, DataFrame]:
    """Balanced random forest of the outlier label: metrics, roc, importance, warnings."""
    columns = [x for x in columns if x != row_id]
    data = _split_data(df, columns, row_id, flag, test_share, task_rows)
    train = data.where("NOT is_test")
    sizes = _class_counts(train)
    if len(sizes) < 2 or len(_class_counts(data.where("is_test"))) < 2:
        raise ValueError("both classes must occur in the training and the test part")
    n = sum(sizes.values())
    weight = F.when(F.col("label") == 1.0, n / (2.0 * sizes[1.0])).otherwise(n / (2.0 * sizes[0.0]))
    assembler = VectorAssembler(inputCols=columns, outputCol="features")
    model = RandomForestClassifier(
        numTrees=trees, maxDepth=depth, maxMemoryInMB=1024, minInstancesPerNode=leaf, featureSubsetStrategy="sqrt", weightCol="weight",
        seed=seed,
    ).fit(assembler.transform(_in_parts(train.withColumn("weight", weight), n)))
    scored = cut_lineage(
        model.transform(assembler.transform(data.where("is_test"))).select(
            "label", vector_to_array("probability")[1].alias("score")
        )
    )
    spark = df.sparkSession
    importance = spark.createDataFrame(
        [(c, float(v)) for c, v in zip(columns, model.featureImportances.toArray())], "variable string, importance double"
    )
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("importance"), "variable")  # one row per named column
    metrics = classification_metrics(scored, task_rows=task_rows)
    result = metrics.first()
    perfect = result["auc"] >= 0.999 and result["accuracy"] >= 0.999
    return {
        "metrics": metrics,
        "roc": roc_curve(scored, task_rows=task_rows),
        "importance": importance.withColumn("position", F.row_number().over(order)),
        "warnings": spark.createDataFrame([("possible overfit", perfect)], "warning string, raised boolean"),
    }
