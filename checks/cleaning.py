"""Missing values, duplicates and outlier treatment."""

from pyspark.sql import functions as F

from fenceline.operators import clean as c

from .registry import check, r, rounded, table
from .tables import GAPPY_SQL, gappy


@check("missing_drop", f"SELECT * FROM {GAPPY_SQL} WHERE value IS NOT NULL AND event_type IS NOT NULL")
def missing_drop(spark, d):
    return c.fill_missing(gappy(spark, d), "drop")


FILLED_SQL = f"""SELECT event_id, user_id, event_type, round(coalesce(value, (SELECT {{}}(value) FROM {GAPPY_SQL})), 6) AS value,
    'bigint' AS id_type FROM {GAPPY_SQL}"""


def filled(spark, d, strategy):
    after = c.fill_missing(gappy(spark, d), strategy)
    return rounded(after, "value").withColumn("id_type", F.lit(dict(after.dtypes)["event_id"]))


@check("missing_mean", FILLED_SQL.format("avg"))
def missing_mean(spark, d):
    return filled(spark, d, "mean")


@check("missing_median", FILLED_SQL.format("median"))
def missing_median(spark, d):
    return filled(spark, d, "median")


@check(
    "missing_mode",
    f"""SELECT event_id, coalesce(event_type, (SELECT event_type FROM {GAPPY_SQL} WHERE event_type IS NOT NULL
        GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS event_type FROM {GAPPY_SQL}""",
)
def missing_mode(spark, d):
    return c.fill_missing(gappy(spark, d), "mode").select("event_id", "event_type")


@check(
    "missing_constant",
    f"SELECT event_id, user_id, coalesce(event_type, '0') AS event_type, coalesce(value, 0) AS value FROM {GAPPY_SQL}",
)
def missing_constant(spark, d):
    return c.fill_missing(gappy(spark, d), "constant", value=0)


@check(
    "imputation_report",
    f"""WITH m AS (SELECT count(*) n, sum((event_type IS NULL)::INT) a, sum((value IS NULL)::INT) b FROM {GAPPY_SQL})
    SELECT 'median' AS strategy, 'event_type' AS variable, a::BIGINT AS missing_before, a::BIGINT AS missing_after,
      n::BIGINT AS rows_before, n::BIGINT AS rows_after, 0::BIGINT AS rows_removed FROM m WHERE a > 0
    UNION ALL SELECT 'median', 'value', b::BIGINT, 0::BIGINT, n, n, 0 FROM m WHERE b > 0""",
)
def imputation_report(spark, d):
    before = gappy(spark, d)
    return c.imputation_report(before, c.fill_missing(before, "median"), "median")


@check("duplicates_first", "SELECT min(event_id) AS event_id, event_type, user_id FROM events GROUP BY event_type, user_id")
def duplicates_first(spark, d):
    return c.drop_duplicates(table(spark, d, "events").select("event_id", "event_type", "user_id"), "event_id")


@check("duplicates_last", "SELECT max(event_id) AS event_id, event_type, user_id FROM events GROUP BY event_type, user_id")
def duplicates_last(spark, d):
    return c.drop_duplicates(table(spark, d, "events").select("event_id", "event_type", "user_id"), "event_id", "last")


BOUNDS = {
    "iqr": """SELECT quantile_cont(value, 0.25) - 1.5 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) lo,
              quantile_cont(value, 0.75) + 1.5 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) hi,
              min(value) mn FROM events""",
    "zscore": "SELECT avg(value) - 3 * stddev_samp(value) lo, avg(value) + 3 * stddev_samp(value) hi, min(value) mn FROM events",
}

for _method, _bounds in BOUNDS.items():
    for _strategy, _what in (
        ("remove", "value AS value FROM events, b WHERE value >= lo AND value <= hi"),
        ("cap", "least(greatest(value, lo), hi) AS value FROM events, b"),
        ("transform", "ln(1 + value - mn + 1) AS value FROM events, b"),
    ):
        if (_method, _strategy) == ("zscore", "transform"):
            continue  # the same formula as after fences

        def _treat(spark, d, method=_method, strategy=_strategy):
            events = table(spark, d, "events").select("event_id", "value")
            return rounded(c.treat_outliers(events, method, strategy, ["value"]), "value", digits=5)

        check(
            f"treat_{_method}_{_strategy}",
            f"WITH b AS ({_bounds}) SELECT event_id, round(value, 5) AS value FROM (SELECT event_id, {_what})",
        )(_treat)


@check(
    "treat_columns_in_turn",
    """WITH src AS (SELECT event_id, value, value * value / 100 AS gap FROM events),
    b0 AS (SELECT quantile_cont(value, 0.25) q1, quantile_cont(value, 0.75) q3 FROM src),
    t0 AS (SELECT src.* FROM src, b0 WHERE value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)),
    b1 AS (SELECT quantile_cont(gap, 0.25) q1, quantile_cont(gap, 0.75) q3 FROM t0)
    SELECT event_id, value FROM t0, b1 WHERE gap BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)""",
)
def treat_columns_in_turn(spark, d):
    events = table(spark, d, "events").select(
        "event_id", "value", (F.col("value") * F.col("value") / 100).alias("gap")
    )
    return c.treat_outliers(events, "iqr", "remove", ["value", "gap"]).select("event_id", "value")


@check(
    "treat_columns_at_once",
    """WITH src AS (SELECT event_id, value, value * value / 100 AS gap FROM events),
    b AS (SELECT quantile_cont(value, 0.25) a1, quantile_cont(value, 0.75) a3,
                 quantile_cont(gap, 0.25) g1, quantile_cont(gap, 0.75) g3 FROM src)
    SELECT event_id, value FROM src, b
    WHERE value BETWEEN a1 - 1.5 * (a3 - a1) AND a3 + 1.5 * (a3 - a1) AND gap BETWEEN g1 - 1.5 * (g3 - g1) AND g3 + 1.5 * (g3 - g1)""",
)
def treat_columns_at_once(spark, d):
    events = table(spark, d, "events").select(
        "event_id", "value", (F.col("value") * F.col("value") / 100).alias("gap")
    )
    return c.treat_outliers(events, "iqr", "remove", ["value", "gap"], mode="simultaneous").select("event_id", "value")


STEPS = [
    {"step": "missing", "strategy": "median", "columns": ["value"]},
    {"step": "missing", "strategy": "drop"},
    {"step": "duplicates", "keep": "first"},
    {"step": "outliers", "method": "iqr", "strategy": "remove", "columns": ["value"]},
]
STEPS_SQL = f"""WITH s0 AS (SELECT event_id, event_type, round(value) AS value FROM {GAPPY_SQL}),
  s1 AS (SELECT event_id, event_type, coalesce(value, (SELECT median(value) FROM s0)) AS value FROM s0),
  s2 AS (SELECT * FROM s1 WHERE event_type IS NOT NULL),
  s3 AS (SELECT min(event_id) AS event_id, event_type, value FROM s2 GROUP BY 2, 3),
  b AS (SELECT quantile_cont(value, 0.25) q1, quantile_cont(value, 0.75) q3 FROM s3),
  s4 AS (SELECT s3.* FROM s3, b WHERE value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))"""


def _cleaned(spark, d):
    events = gappy(spark, d).select("event_id", "event_type", F.round("value").alias("value"))
    return c.clean(events, STEPS, "event_id")


@check("cleaned_table", f"{STEPS_SQL} SELECT event_id, event_type, value FROM s4")
def cleaned_table(spark, d):
    return _cleaned(spark, d)[0]


@check(
    "cleaning_report",
    f"""{STEPS_SQL}, n AS (SELECT (SELECT count(*) FROM s0) n0, (SELECT count(*) FROM s1) n1, (SELECT count(*) FROM s2) n2,
      (SELECT count(*) FROM s3) n3, (SELECT count(*) FROM s4) n4)
    SELECT 1 AS position, 'missing' AS step, n0 AS rows_before, n1 AS rows_after FROM n
    UNION ALL SELECT 2, 'missing', n1, n2 FROM n UNION ALL SELECT 3, 'duplicates', n2, n3 FROM n
    UNION ALL SELECT 4, 'outliers', n3, n4 FROM n""",
)
def cleaning_report(spark, d):
    return _cleaned(spark, d)[1]


# Ids with gaps and beyond what a double holds; no step may touch them.
IDLESS_SQL = f"(SELECT CASE WHEN event_id % 17 <> 0 THEN event_id + 9007199254740993 END AS event_id, event_type, value FROM {GAPPY_SQL})"


@check(
    "cleaned_table_keeps_ids",
    f"""SELECT event_id, coalesce(event_type, 'none') AS event_type, round(coalesce(value, (SELECT avg(value) FROM {IDLESS_SQL})), 6) AS value FROM {IDLESS_SQL}""",
)
def cleaned_table_keeps_ids(spark, d):
    events = gappy(spark, d).select(F.when(F.col("event_id") % 17 != 0, F.col("event_id") + 9007199254740993).alias("event_id"), "event_type", "value")
    steps = [{"step": "missing", "strategy": "mean"}, {"step": "missing", "strategy": "constant", "value": "none"}]
    return rounded(c.clean(events, steps, "event_id")[0], "value")
