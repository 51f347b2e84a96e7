"""One- and two-variable exploration, rankings."""

from pyspark.sql import functions as F

from fenceline.functions.rank import average_rank, ranked_values
from fenceline.operators import explore as e

from .registry import check, r, rounded, table
from .tables import GAPPY_SQL, gappy

STATS = """count(value)::BIGINT AS n, (count(*) - count(value))::BIGINT AS missing, round(avg(value), 6) AS mean,
  round(stddev_samp(value), 6) AS std, min(value) AS min, max(value) AS max, round(quantile_cont(value, 0.25), 6) AS q1,
  round(median(value), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q3,
  round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) AS iqr"""
STAT_COLUMNS = ["mean", "std", "q1", "median", "q3", "iqr"]


@check("variable_statistics", f"SELECT 'value' AS variable, {STATS} FROM {GAPPY_SQL}")
def variable_statistics(spark, d):
    return rounded(e.variable_statistics(gappy(spark, d), "value"), *STAT_COLUMNS)


@check(
    "statistics_by_category",
    f"SELECT 'value' AS variable, event_type, {STATS} FROM {GAPPY_SQL} WHERE event_type IS NOT NULL GROUP BY event_type",
)
def statistics_by_category(spark, d):
    return rounded(e.variable_statistics(gappy(spark, d), "value", ["event_type"]), *STAT_COLUMNS)


HISTOGRAM = """WITH d AS (SELECT {by} value AS x FROM {source} WHERE value IS NOT NULL {present}),
  s AS (SELECT {by} min(x) x0, max(x) x1, {bins}::BIGINT AS bins FROM d {group}),
  w AS (SELECT *, (x1 - x0) / bins AS width FROM s)
  SELECT {by} least(bins - 1, floor((x - x0) / width))::BIGINT AS bin,
    round(x0 + least(bins - 1, floor((x - x0) / width)) * width, 6) AS low,
    round(x0 + (least(bins - 1, floor((x - x0) / width)) + 1) * width, 6) AS high, count(*)::BIGINT AS count
  FROM d {join} GROUP BY ALL"""


@check(
    "histogram_size_rule",
    HISTOGRAM.format(bins="least(30, greatest(5, floor(sqrt(count(*)))))", by="", source="(SELECT s_acctbal AS value FROM supplier)", present="", group="", join=", w"),
)
def histogram_size_rule(spark, d):
    return rounded(e.histogram(table(spark, d, "supplier"), "s_acctbal", size_rule=True), "low", "high")


@check("histogram", HISTOGRAM.format(bins=30, by="", source=GAPPY_SQL, present="", group="", join=", w"))
def histogram(spark, d):
    return rounded(e.histogram(gappy(spark, d), "value"), "low", "high")


@check(
    "histogram_by_category",
    HISTOGRAM.format(
        bins=30, by="event_type,", source=GAPPY_SQL, present="AND event_type IS NOT NULL", group="GROUP BY event_type",
        join="JOIN w USING (event_type)",
    ),
)
def histogram_by_category(spark, d):
    return rounded(e.histogram(gappy(spark, d), "value", ["event_type"]), "low", "high")


@check("box_numbers", "SELECT count(*)::BIGINT AS n, min(value) AS min, round(quantile_cont(value, 0.25), 6) AS q1, "
       "round(median(value), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q3, max(value) AS max FROM events")
def box_numbers(spark, d):
    five, _ = e.box_data(table(spark, d, "events"), "value", "event_id")
    return rounded(five, "q1", "median", "q3")


BOX_POINTS_SQL = """WITH q AS (SELECT event_type, quantile_cont(value, 0.25) q1, quantile_cont(value, 0.75) q3, {} AS k FROM events GROUP BY 1)
    SELECT event_type, event_id, value FROM events JOIN q USING (event_type)
    WHERE value < q1 - k * (q3 - q1) OR value > q3 + k * (q3 - q1)"""


@check("box_points", BOX_POINTS_SQL.format("1.5"))
def box_points(spark, d):
    return e.box_data(table(spark, d, "events"), "value", "event_id", ["event_type"])[1]


@check("box_points_size_rule", BOX_POINTS_SQL.format("CASE WHEN count(*) < 100 THEN 3.0 WHEN count(*) < 1000 THEN 2.0 ELSE 1.5 END"))
def box_points_size_rule(spark, d):
    return e.box_data(table(spark, d, "events"), "value", "event_id", ["event_type"], size_rule=True)[1]


@check(
    "density_curve",
    """WITH d AS (SELECT event_type, value AS x FROM events),
    s AS (SELECT event_type, count(*) n, min(x) x0, (max(x) - min(x)) / 100 AS step FROM d GROUP BY 1),
    g AS (SELECT event_type, unnest(range(0, 101)) AS point FROM s),
    p AS (SELECT event_type, (x - x0) / step AS pos FROM d JOIN s USING (event_type)),
    h AS (SELECT event_type, point, count(*) c FROM (
       SELECT event_type, floor(pos)::BIGINT AS point FROM p
       UNION ALL SELECT event_type, floor(pos)::BIGINT + 1 FROM p WHERE pos > floor(pos)) GROUP BY 1, 2)
    SELECT event_type, point::BIGINT AS point, round(x0 + point * step, 6) AS x, round(coalesce(c, 0) / (step * n), 6) AS y
    FROM g JOIN s USING (event_type) LEFT JOIN h USING (event_type, point)""",
)
def density_curve(spark, d):
    return rounded(e.density(table(spark, d, "events"), "value", "event_type"), "x", "y")


@check(
    "category_frequencies",
    f"""WITH f AS (SELECT event_type v, count(*) n FROM {GAPPY_SQL} GROUP BY 1)
    SELECT v AS value, n::BIGINT AS count, round(100.0 * n::DOUBLE / (SELECT sum(n) FROM f WHERE v IS NOT NULL), 6) AS percent,
      (SELECT count(v) FROM f)::BIGINT AS distinct_values, coalesce((SELECT n FROM f WHERE v IS NULL), 0)::BIGINT AS missing
    FROM f WHERE v IS NOT NULL""",
)
def category_frequencies(spark, d):
    return rounded(e.category_frequencies(gappy(spark, d), "event_type"), "percent")


@check(
    "contingency_table",
    """SELECT l_returnflag AS first_value, l_linestatus AS second_value, count(*)::BIGINT AS count
    FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""",
)
def contingency_table(spark, d):
    return e.contingency(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus")


@check(
    "contingency_crosstab",
    """SELECT l_returnflag, count(*) FILTER (l_linestatus = 'F')::BIGINT AS "F", count(*) FILTER (l_linestatus = 'O')::BIGINT AS "O"
    FROM lineitem GROUP BY 1""",
)
def contingency_crosstab(spark, d):
    return e.contingency_wide(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus", ["F", "O"])


@check(
    "detector_counts",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS variable, sum((x < q1 - k * (q3 - q1) OR x > q3 + k * (q3 - q1))::INT)::BIGINT AS iqr_count,
        sum((abs(x - m) / sd > 3)::INT)::BIGINT AS zscore_count, count(*)::BIGINT AS total_values,
        round(sum((x < q1 - k * (q3 - q1) OR x > q3 + k * (q3 - q1))::INT)::DOUBLE / count(*) * 100, 6) AS iqr_percent,
        round(sum((abs(x - m) / sd > 3)::INT)::DOUBLE / count(*) * 100, 6) AS zscore_percent
        FROM (SELECT {c} AS x FROM {t}), (SELECT quantile_cont({c}, 0.25) q1, quantile_cont({c}, 0.75) q3, avg({c}) m,
          stddev_samp({c}) sd, CASE WHEN count(*) < 100 THEN 3.0 WHEN count(*) < 1000 THEN 2.0 ELSE 1.5 END k FROM {t})"""
        for c, t in (("value", "events"), ("user_id", "events"))
    ),
)
def detector_counts(spark, d):
    counts = e.detector_counts(table(spark, d, "events"), ["value", "user_id"])
    return rounded(counts, "iqr_percent", "zscore_percent")


@check("value_ranks", """SELECT value AS x, round(avg(rn), 6) AS average_rank, min(rn)::BIGINT AS first_rank, count(*)::BIGINT AS cnt
       FROM (SELECT value, row_number() OVER (ORDER BY value) rn FROM events) GROUP BY 1""")
def value_ranks(spark, d):
    long = table(spark, d, "events").select(F.lit("value").alias("variable"), F.col("value").alias("x"))
    return ranked_values(long, ["variable"]).select(
        "x", r(average_rank()).alias("average_rank"), (F.col("below") + 1).alias("first_rank"), "cnt"
    )


@check("value_ranks_in_groups", """SELECT event_type, value AS x, round(avg(rn), 6) AS average_rank, count(*)::BIGINT AS cnt
       FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) rn FROM events) GROUP BY 1, 2""")
def value_ranks_in_groups(spark, d):
    long = table(spark, d, "events").select("event_type", F.col("value").alias("x"))
    # A small task size, so that the split by value ranges is what is checked.
    return ranked_values(long, ["event_type"], task_rows=500).select(
        "event_type", "x", r(average_rank()).alias("average_rank"), "cnt"
    )


@check(
    "lowest_and_highest",
    """SELECT 'low' AS side, row_number() OVER (ORDER BY value, event_id)::INT AS position, event_id, value FROM events
       QUALIFY position <= 5 UNION ALL
       SELECT 'high', row_number() OVER (ORDER BY value DESC, event_id)::INT AS position, event_id, value FROM events QUALIFY position <= 5""",
)
def lowest_and_highest(spark, d):
    return e.extremes(table(spark, d, "events"), "value", "event_id", 5)


@check(
    "top_frequencies",
    "SELECT p_brand, count(*)::BIGINT AS count FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
)
def top_frequencies(spark, d):
    return e.top_frequencies(table(spark, d, "part"), "p_brand")


@check(
    "ranked_by_size",
    """SELECT *, row_number() OVER (ORDER BY abs(score) DESC, event_type)::INT AS position FROM (
       SELECT event_type, round(avg(value) - (SELECT avg(value) FROM events), 6) AS score FROM events GROUP BY 1)""",
)
def ranked_by_size(spark, d):
    events = table(spark, d, "events")
    overall = events.agg(F.avg("value")).first()[0]
    scores = events.groupBy("event_type").agg(r(F.avg("value") - F.lit(overall)).alias("score"))
    return e.ranked_by_size(scores, "score")
