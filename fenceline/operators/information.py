"""Mutual information of numeric features with a label, by nearest neighbours."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import number
from ..functions.lineage import cut_lineage
from ..functions.rank import TASK_ROWS, ranked_counts

# Values whose distance from an end of an interval is below this share of their size lie on it.
ON_THE_END = 1e-12


def digamma(n: Column) -> Column:
    """Digamma of positive whole numbers: the series at n + 8, taken back by the recurrence."""
    z = n.cast("double") + 8.0
    series = F.log(z) - 1 / (2 * z) - 1 / (12 * z**2) + 1 / (120 * z**4) - 1 / (252 * z**6)
    for i in range(8):
        series = series - 1.0 / (n + i)
    return series


def neighbour_information(
    df: DataFrame, columns: Sequence[str], label: str, neighbours: int = 3, task_rows: int = TASK_ROWS
) -> DataFrame:
    """variable and mutual_information (nats, not below 0) of every column with the label.

    For a row let r be the distance to its k-th nearest other row of the same label,
    k = min(neighbours, rows of the label - 1), and m the rows of any label closer than
    r, itself included. The estimate is psi(N) + mean psi(k) - mean psi(rows of the label)
    - mean psi(m), over rows whose label occurs twice at least. Where r is 0, k and m are
    the other rows of equal value with the same and with any label.

    Rows are folded to (variable, label, value, count) once. Neighbours are found in
    pieces of sorted distinct values that overlap by k values, and m from ranks: the ends
    of the intervals are ranked among the values, so no pair of rows is ever made. Rows
    with a missing value in any column or label are left out; without rows left there is
    no result row.
    """
    columns = list(columns)
    data = df.select(F.col(label).alias("label"), *[number(c).alias(c) for c in columns]).dropna("any")
    counts = data.unpivot(["label"], columns, "variable", "x").groupBy("variable", "label", "x").agg(F.count("*").alias("cnt"))
    counts = cut_lineage(counts.withColumn("one", F.lit(1)))
    ranked = ranked_counts(counts, ["variable", "label"], "x", ["one"], task_rows).where(F.col("n") > 1)
    ranked = cut_lineage(ranked.select("variable", "label", "x", "cnt", "n", F.col("below_one").alias("position")))

    size = max(task_rows // 2, 2 * neighbours)
    home, at = F.floor(F.col("position") / size), F.col("position") % size
    visits = F.array(home, F.when(at < neighbours, home - 1), F.when(at >= size - neighbours, home + 1))
    pieces = ranked.withColumn("home", home).withColumn("piece", F.explode(F.array_compact(visits)))
    sorted_values = Window.partitionBy("variable", "label", "piece").orderBy("x")

    def near(i: int, step) -> Column:
        return F.struct(F.abs(step("x", i).over(sorted_values) - F.col("x")).alias("d"), step("cnt", i).over(sorted_values).alias("c"))

    around = F.array(*[near(i, step) for i in range(1, neighbours + 1) for step in (F.lag, F.lead)])
    around = pieces.withColumn("around", around).where(F.col("piece") == F.col("home"))
    k = F.least(F.lit(neighbours), F.col("n") - 1)

    def within(e: Column) -> Column:
        """Other rows of the label no farther than e."""
        closer = F.filter("around", lambda f: f["d"] <= e["d"])
        return F.col("cnt") - 1 + F.aggregate(closer, F.lit(0).cast("long"), lambda total, f: total + f["c"])

    reach = F.array_min(F.transform(F.filter("around", lambda e: e["d"].isNotNull() & (within(e) >= k)), lambda e: e["d"]))
    points = around.select(
        "variable", "label", "x", "cnt", "n", F.when(F.col("cnt") > k, 0.0).otherwise(reach).alias("r"), k.alias("k")
    )
    slack = (F.abs("x") + F.col("r")) * ON_THE_END
    points = cut_lineage(
        points.withColumn("low", F.col("x") - F.col("r") + slack).withColumn("high", F.col("x") + F.col("r") - slack)
    )

    # Rows of any label, ranked together with the ends of the intervals (which count nothing).
    def ends(c: str) -> DataFrame:
        return points.where("r > 0").select("variable", F.col(c).alias("x"), F.lit(0).cast("long").alias("cnt"))

    merged = points.select("variable", "x", "cnt").unionByName(ends("low")).unionByName(ends("high"))
    merged = merged.groupBy("variable", "x").agg(F.sum("cnt").alias("cnt"))
    ranks = cut_lineage(ranked_counts(merged, ["variable"], "x", (), task_rows).select("variable", "x", "cnt", "below"))

    def looked_up(on: str, name: str, value: Column) -> DataFrame:
        return ranks.select("variable", F.col("x").alias(on), value.alias(name))

    found = (
        points.join(looked_up("x", "copies", F.col("cnt")), ["variable", "x"])
        .join(looked_up("low", "upto", F.col("below") + F.col("cnt")), ["variable", "low"], "left")
        .join(looked_up("high", "under", F.col("below")), ["variable", "high"], "left")
    )
    tied = F.col("r") == 0
    inside = F.greatest(F.col("under") - F.col("upto"), F.col("copies"))
    of_label = F.when(tied, F.col("cnt") - 1).otherwise(F.col("k"))
    of_any = F.when(tied, F.col("copies") - 1).otherwise(inside)
    term = F.col("cnt") * (digamma(of_label) - digamma(of_any) - digamma(F.col("n")))
    total = F.sum("cnt")
    return found.groupBy("variable").agg(
        F.greatest(digamma(total) + F.sum(term) / total, F.lit(0.0)).alias("mutual_information")
    )
