"""Exact order statistics that never put a whole column into one task.

``ranked_values`` gives the position of every distinct value of a variable,
``group_quantiles`` / ``column_quantiles`` interpolated quantiles. Both take
Spark's built-in way (a window, ``percentile``) while the largest group is within
a checked size, and otherwise narrow or split the group by value ranges first.
Equal values are always folded into (value, count) before a shuffle, so a value
that fills a third of the table is one row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .columns import melt, numbers
from .lineage import BROADCAST_ROWS, broadcast_if_small, cut_lineage

# Largest group handed to one window or percentile task.
TASK_ROWS = 1_000_000

# Up to here one percentile aggregate is the quickest way to a quantile.
PERCENTILE_ROWS = 20_000

# Up to so many times task_rows, two scans bracket a quantile: six rows in SKETCH_ACCURACY at most lie between, 60,000 by default.
BRACKET_TASKS = 100

# Sketch resolution for value ranges; each narrowing step shrinks a range about
# accuracy / 4 times.
SKETCH_ACCURACY = 10_000


# ---------------------------------------------------------------- ranks


# Most value pieces of one key; a sketch of four times this accuracy keeps them even.
PIECES = 100_000


def pieces_for(rows: int, task_rows: int) -> int:
    """Value pieces that hold about task_rows / 2 of so many rows each."""
    return min(PIECES, max(2, -(-2 * rows // task_rows)))


def piece_bounds(value: str, pieces: int) -> Column:
    """Aggregate: the distinct ascending bounds of about equal pieces of value, by a sketch."""
    fractions = [i / pieces for i in range(1, pieces)]
    return F.array_sort(F.array_distinct(F.percentile_approx(value, fractions, max(SKETCH_ACCURACY, 4 * pieces))))


def bounds_below(bounds: Column, value: Column, pieces: int) -> Column:
    """How many entries of an ascending array are less than value, by binary search; 0 for a null array.

    ``pieces`` is at least the length of the array plus one.
    """
    steps = [1 << i for i in reversed(range(max(1, (pieces - 1).bit_length())))]

    def step(found: Column, jump: Column) -> Column:
        return F.when(F.get(bounds, found + jump - 1) < value, found + jump).otherwise(found)

    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), step)


def rows_with_ranks(
    df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), task_rows: int = TASK_ROWS
) -> DataFrame:
    """by and columns, every column replaced by its average rank (within by), with one exchange of values.

    Columns are complete doubles. A sketch gives bounds of value pieces per column; a
    count per piece, and of rows that equal a bound, gives every piece its offset, a
    bounded table. A value that fills more than a piece is a bound, so its rows know
    their rank at once and never meet in a task. The other values are ranked inside
    their piece by one window over all columns, and rows are put together once by
    their number, whatever the number of columns. Rows are numbered in a checkpoint, so
    that a lost executor cannot number them anew.
    """
    by, columns = list(by), list(columns)
    # Names that no column of the caller can clash with.
    keys = [f"_by{i}" for i in range(len(by))]
    names = [f"_x{i}" for i in range(len(columns))]
    rows = cut_lineage(
        df.select(
            F.monotonically_increasing_id().alias("_row"),
            *[F.col(c).alias(k) for c, k in zip(by, keys)], *[F.col(c).alias(n) for c, n in zip(columns, names)],
        )
    )
    pieces = pieces_for(rows.count(), task_rows)
    long = rows.unpivot(["_row", *keys], names, "_variable", "_x")
    label = [*keys, "_variable"]
    bounds = cut_lineage(long.groupBy(*label).agg(piece_bounds("_x", pieces).alias("_bounds")))  # fix one sketch

    def same(on: Sequence[str]) -> Column:
        tests = [F.col(f"_l.{c}").eqNullSafe(F.col(f"_r.{c}")) for c in on]
        result = tests[0]
        for t in tests[1:]:
            result = result & t
        return result

    lower = bounds_below(F.col("_bounds"), F.col("_x"), pieces)
    slotted = (
        long.alias("_l").join(broadcast_if_small(bounds, BROADCAST_ROWS // pieces).alias("_r"), same(label))
        .select("_row", *[F.col(f"_l.{c}").alias(c) for c in label], "_x", "_bounds", lower.alias("_lower"))
    )
    # Odd slots hold the rows that equal a bound, even ones the values between two bounds.
    at_bound = F.coalesce(F.get("_bounds", F.col("_lower")) == F.col("_x"), F.lit(False))
    slotted = slotted.select("_row", *label, "_x", (2 * F.col("_lower") + at_bound.cast("int")).alias("_slot"))
    before = Window.partitionBy(*label).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut_lineage(
        slotted.groupBy(*label, "_slot").agg(F.count("*").alias("_cnt"))
        .withColumn("_under", F.coalesce(F.sum("_cnt").over(before), F.lit(0)))
    )
    place = [*label, "_slot"]
    placed = (
        slotted.alias("_l").join(broadcast_if_small(offsets).alias("_r"), same(place))
        .select("_row", *[F.col(f"_l.{c}").alias(c) for c in place], "_x", "_under", "_cnt")
    )
    odd = F.col("_slot") % 2 == 1
    known = placed.where(odd).select("_row", *label, (F.col("_under") + (F.col("_cnt") + 1) / 2.0).alias("_rank"))
    inside = Window.partitionBy(*place).orderBy("_x")
    upto = inside.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    found = placed.where(~odd).select(
        "_row", *label,
        (F.col("_under") + (F.rank().over(inside) + F.count("*").over(upto)) / 2.0).alias("_rank"),
    )
    return known.unionByName(found).groupBy("_row", *keys).agg(
        *[F.max(F.when(F.col("_variable") == n, F.col("_rank"))).alias(n) for n in names]
    ).select(*[F.col(k).alias(c) for c, k in zip(by, keys)], *[F.col(n).alias(c) for c, n in zip(columns, names)])


def ranked_values(long: DataFrame, keys: Sequence[str], value: str = "x", task_rows: int = TASK_ROWS) -> DataFrame:
    """Rank the distinct values of every key.

    Returns keys, value, cnt (copies), below (rows with a smaller value) and n
    (rows of the key). The first rank of a value is below + 1, its average rank
    below + (cnt + 1) / 2.
    """
    counts = long.groupBy(*keys, value).agg(F.count("*").alias("cnt"))
    return ranked_counts(counts, keys, value, [], task_rows)


def ranked_counts(
    counts: DataFrame, keys: Sequence[str], value: str, extra: Sequence[str] = (), task_rows: int = TASK_ROWS
) -> DataFrame:
    """As ranked_values for (keys, value, cnt) that is already folded.

    ``extra`` names further additive columns; each gets a ``below_<name>`` column.
    """
    keys = list(keys)
    sizes = counts.groupBy(*keys).agg(F.count("*").alias("distinct_values"))
    biggest = sizes.agg(F.max("distinct_values")).first()[0] or 0
    sums = ["cnt", *extra]
    names = {"cnt": "below", **{c: f"below_{c}" for c in extra}}

    if biggest <= task_rows:
        whole = Window.partitionBy(*keys)
        running = whole.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return counts.select(
            *keys, value, *sums,
            *[(F.sum(c).over(running) - F.col(c)).alias(names[c]) for c in sums],
            F.sum("cnt").over(whole).alias("n"),
        )

    counts = cut_lineage(counts)  # read three times below, folded once
    # Value ranges for the large keys only, about task_rows / 2 distinct values each.
    pieces = pieces_for(biggest, task_rows)
    sizes = counts.groupBy(*keys).agg(F.count("*").alias("distinct_values"))
    large = sizes.where(F.col("distinct_values") > task_rows).select(*keys)
    bounds = (
        counts.join(broadcast_if_small(large), keys, "left_semi")
        .groupBy(*keys)
        .agg(piece_bounds(value, pieces).alias("bounds"))
    )
    bounds = cut_lineage(bounds)  # sketches may differ between runs; fix one
    located = counts.join(broadcast_if_small(bounds, BROADCAST_ROWS // pieces), keys, "left").withColumn(
        "piece", bounds_below(F.col("bounds"), F.col(value), pieces)
    )
    inside = Window.partitionBy(*keys, "piece")
    running = inside.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = located.select(
        *keys, "piece", value, *sums,
        *[(F.sum(c).over(running) - F.col(c)).alias(names[c]) for c in sums],
    )
    # At most `pieces` rows per key from here on.
    before = Window.partitionBy(*keys).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        located.groupBy(*keys, "piece")
        .agg(*[F.sum(c).alias(f"total_{c}") for c in sums])
        .select(
            *keys, "piece",
            *[F.coalesce(F.sum(f"total_{c}").over(before), F.lit(0)).alias(f"offset_{c}") for c in sums],
            F.sum("total_cnt").over(Window.partitionBy(*keys)).alias("n"),
        )
    )
    return placed.join(offsets, [*keys, "piece"]).select(
        *keys, value, *sums,
        *[(F.col(names[c]) + F.col(f"offset_{c}")).alias(names[c]) for c in sums],
        "n",
    )


def average_rank(below: Column | None = None, cnt: Column | None = None) -> Column:
    below = F.col("below") if below is None else below
    cnt = F.col("cnt") if cnt is None else cnt
    return below + (cnt + 1) / 2.0


# ---------------------------------------------------------------- quantiles


def column_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    rows: int | None = None,
    task_rows: int = TASK_ROWS,
) -> dict[str, list[float | None]]:
    """Interpolated quantiles of whole columns as {column: [one value per prob]}."""
    columns = list(columns)
    data = numbers(df, columns)
    if rows is None:
        rows = data.count()
    if rows <= min(task_rows, PERCENTILE_ROWS):
        return _percentiles(data, columns, probs)
    if rows <= task_rows * BRACKET_TASKS:
        return _bracketed_quantiles(data, columns, probs)
    found = _select_quantiles(melt(df, columns), ["variable"], probs, task_rows).collect()
    result = {c: [None] * len(probs) for c in columns}
    order = {float(p): i for i, p in enumerate(probs)}
    for r in found:
        result[r["variable"]][order[r["p"]]] = r["value"]
    return result


def _percentiles(data: DataFrame, columns: list[str], probs: Sequence[float]) -> dict[str, list[float | None]]:
    levels = F.array(*[F.lit(float(p)) for p in probs])
    row = data.agg(*[F.percentile(c, levels).alias(c) for c in columns]).first()
    return {c: list(row[c]) if row[c] is not None else [None] * len(probs) for c in columns}


def _bracketed_quantiles(
    data: DataFrame, columns: list[str], probs: Sequence[float], accuracy: int = SKETCH_ACCURACY
) -> dict[str, list[float | None]]:
    """Exact quantiles from two scans without a shuffle of rows.

    A sketch brackets every quantile by two values of the column; the second scan
    counts what lies below and at the ends and gathers what lies strictly between,
    a few rows in accuracy (a frequent value is an end, never between). Should a
    sketch miss, the counts show it and that column takes the slower way.
    """
    margin = 2.0 / accuracy
    levels = [min(1.0, max(0.0, p + d)) for p in probs for d in (-margin, margin)]
    ends = data.agg(*[F.percentile_approx(c, levels, accuracy).alias(c) for c in columns]).first()
    known = [c for c in columns if ends[c] is not None]
    facts = []
    for c in known:
        x = F.col(c)
        for i in range(len(probs)):
            low, high = F.lit(ends[c][2 * i]), F.lit(ends[c][2 * i + 1])
            facts.append(
                F.struct(
                    F.count_if(x < low).alias("below"), F.count_if(x == low).alias("at_low"),
                    F.sort_array(F.collect_list(F.when((x > low) & (x < high), x))).alias("between"),
                    F.count_if((x == high) & (high > low)).alias("at_high"), F.count(x).alias("n"),
                ).alias(f"f{len(facts)}")
            )
    row = data.agg(*facts).first() if facts else ()
    result: dict[str, list[float | None]] = {c: [None] * len(probs) for c in columns}
    missed = []
    for j, c in enumerate(known):
        for i, p in enumerate(probs):
            f = row[j * len(probs) + i]
            low, high = ends[c][2 * i], ends[c][2 * i + 1]
            position = (f["n"] - 1) * p
            k = int(position)

            def at(rank: int) -> float | None:
                rank -= f["below"]
                if rank < 0:
                    return None
                if rank < f["at_low"]:
                    return low
                rank -= f["at_low"]
                if rank < len(f["between"]):
                    return f["between"][rank]
                return high if rank - len(f["between"]) < f["at_high"] else None

            lower, upper = at(k), at(min(k + 1, f["n"] - 1))
            if lower is None or upper is None:
                missed.append(c)
                break
            result[c][i] = lower + (upper - lower) * (position - k)
    if missed:
        result.update(_percentiles(data, missed, probs))
    return result


def group_quantiles(
    df: DataFrame,
    by: Sequence[str],
    columns: Sequence[str],
    probs: Sequence[float],
    task_rows: int = TASK_ROWS,
) -> DataFrame:
    """Interpolated quantiles per group in long form: by..., variable, p, value."""
    return long_quantiles(melt(df, columns, by), [*by, "variable"], probs, task_rows)


def long_quantiles(long: DataFrame, keys: Sequence[str], probs: Sequence[float], task_rows: int = TASK_ROWS) -> DataFrame:
    """Quantiles of x per key of a long table."""
    keys = list(keys)
    biggest = long.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    if biggest > task_rows:
        return _select_quantiles(long, keys, probs, task_rows)
    levels = F.array(*[F.lit(float(p)) for p in probs])
    return (
        long.groupBy(*keys)
        .agg(F.percentile("x", levels).alias("q"))
        .select(*keys, F.inline(F.arrays_zip(levels.alias("p"), F.col("q").alias("value"))))
    )


def _select_quantiles(long: DataFrame, keys: list[str], probs: Sequence[float], task_rows: int) -> DataFrame:
    """Selection by narrowing value ranges.

    Every wanted position keeps a range [low, high] with `below` rows under it and
    `inside` rows in it, counted exactly. A sketch proposes a narrower range, one
    counting pass accepts it if the position is really inside, and only when the
    range holds few distinct values are those sorted. Data is scanned, never
    shuffled, until then.
    """
    wanted = F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("p")
    targets = (
        long.groupBy(*keys)
        .agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
        .select(*keys, wanted, "n", "low", "high")
        .withColumn("position", (F.col("n") - 1) * F.col("p"))
        .withColumn("k", F.floor("position"))
        .withColumn("below", F.lit(0).cast("long"))
        .withColumn("inside", F.col("n"))
        .withColumn("distinct_values", F.col("n"))
    )
    targets = cut_lineage(targets)
    in_range = F.col("x").between(F.col("low"), F.col("high"))
    label = [*keys, "p"]
    margin = 4.0 / SKETCH_ACCURACY
    previous = None
    while True:
        open_ranges = targets.where((F.col("distinct_values") > task_rows) & (F.col("low") < F.col("high")))
        state = open_ranges.agg(F.count("*"), F.sum("inside")).first()
        if not state[0] or tuple(state) == previous:
            break
        previous = tuple(state)
        fraction = (F.col("k") - F.col("below")) / F.col("inside")
        proposal = (
            long.join(broadcast_if_small(open_ranges.select(*keys, "p", "low", "high")), keys)
            .where(in_range)
            .groupBy(*label)
            .agg(F.percentile_approx("x", [i / 1000 for i in range(1001)], SKETCH_ACCURACY).alias("grid"))
        )
        moved = (
            open_ranges.join(proposal, label)
            .withColumn("first", F.greatest(F.lit(0), F.floor((fraction - margin) * 1000)).cast("int"))
            .withColumn(
                "last",
                F.least(F.lit(1000), F.ceil((fraction + margin + 1 / F.col("inside")) * 1000)).cast("int"),
            )
            .withColumn("new_low", F.element_at("grid", F.col("first") + 1))
            .withColumn("new_high", F.element_at("grid", F.col("last") + 1))
            .drop("grid", "first", "last")
        )
        moved = cut_lineage(moved)
        counted = (
            long.join(broadcast_if_small(moved.select(*label, "low", "high", "new_low", "new_high")), keys)
            .where(in_range)
            .groupBy(*label)
            .agg(
                F.count_if(F.col("x") < F.col("new_low")).alias("skipped"),
                F.count_if(F.col("x").between(F.col("new_low"), F.col("new_high"))).alias("kept"),
                F.approx_count_distinct(
                    F.when(F.col("x").between(F.col("new_low"), F.col("new_high")), F.col("x"))
                ).alias("kept_distinct"),
            )
        )
        new_below = F.col("below") + F.col("skipped")
        holds = (new_below <= F.col("k")) & (
            F.least(F.col("k") + 1, F.col("n") - 1) < new_below + F.col("kept")
        )
        narrowed = moved.join(counted, label).select(
            *keys, "p", "n",
            F.when(holds, F.col("new_low")).otherwise(F.col("low")).alias("low"),
            F.when(holds, F.col("new_high")).otherwise(F.col("high")).alias("high"),
            "position", "k",
            F.when(holds, new_below).otherwise(F.col("below")).alias("below"),
            F.when(holds, F.col("kept")).otherwise(F.col("inside")).alias("inside"),
            F.when(holds, F.col("kept_distinct")).otherwise(F.col("distinct_values")).alias("distinct_values"),
        )
        closed = targets.where(~((F.col("distinct_values") > task_rows) & (F.col("low") < F.col("high"))))
        targets = cut_lineage(closed.select(narrowed.columns).unionByName(narrowed))

    values = (
        long.join(broadcast_if_small(targets), keys)
        .where(in_range)
        .groupBy(*label, "position", "k", "below", "x")
        .agg(F.count("*").alias("cnt"))
    )
    # Ranges that no sketch could narrow further still rank in value pieces.
    ranked = ranked_counts(
        values.select(*label, "position", "k", F.col("below").alias("under"), "x", "cnt"),
        [*label, "position", "k", "under"], "x", (), max(task_rows, 1),
    )
    reached = F.col("under") + F.col("below") + F.col("cnt")
    fraction = F.col("position") - F.col("k")
    return (
        ranked.withColumn("reached", reached)
        .groupBy(*label, "position", "k")
        .agg(
            F.min(F.when(F.col("reached") > F.col("k"), F.col("x"))).alias("lower"),
            F.min(F.when(F.col("reached") > F.col("k") + 1, F.col("x"))).alias("upper"),
        )
        .select(
            *label,
            (F.col("lower") + (F.coalesce(F.col("upper"), F.col("lower")) - F.col("lower")) * fraction).alias("value"),
        )
    )
