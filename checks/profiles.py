"""Kinds and summaries."""

from pyspark.sql import functions as F

from fenceline.operators import profile as p

from .registry import check, r, rounded, table
from .tables import GAPPY_SQL, gappy


def _kind_sql(source, numeric, text):
    parts = []
    for c in numeric:
        d = f"count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)"
        parts.append(
            f"SELECT '{c}' AS variable, CASE WHEN ({d}) / count(*) < 0.1 THEN 'discrete' ELSE 'continuous' END AS kind, "
            f"({d})::BIGINT AS distinct_values, count(*)::BIGINT AS rows FROM {source}"
        )
    for c in text:
        d = f"count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)"
        parts.append(
            f"SELECT '{c}', CASE WHEN ({d}) = 2 THEN 'binary' ELSE 'nominal' END, ({d})::BIGINT, count(*)::BIGINT FROM {source}"
        )
    return " UNION ALL ".join(parts)


KINDS_SQL = _kind_sql("lineitem", ["l_quantity", "l_extendedprice", "l_discount"], ["l_returnflag", "l_linestatus"])
LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus"]


@check("column_kinds", KINDS_SQL)
def column_kinds(spark, d):
    return p.infer_kinds(table(spark, d, "lineitem"), LINE)


@check(
    "column_kinds_sketched",
    f"SELECT variable, kind, rows FROM ({KINDS_SQL})",
)
def column_kinds_sketched(spark, d):
    return p.infer_kinds(table(spark, d, "lineitem"), LINE, exact=False).drop("distinct_values")


@check("column_kinds_with_gaps", _kind_sql(GAPPY_SQL, ["value", "user_id"], ["event_type"]))
def column_kinds_with_gaps(spark, d):
    return p.infer_kinds(gappy(spark, d), ["value", "user_id", "event_type"])


@check("variable_list", f"SELECT variable, kind, distinct_values FROM ({KINDS_SQL})")
def variable_list(spark, d):
    return p.infer_kinds(table(spark, d, "lineitem"), LINE).select("variable", "kind", "distinct_values")


def _numeric_sql(source, columns):
    return " UNION ALL ".join(
        f"SELECT '{c}' AS variable, round(avg({c}), 6) AS mean, round(median({c}), 6) AS median, "
        f"round(stddev_samp({c}), 6) AS std, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, "
        f"(count(*) - count({c}))::BIGINT AS missing_values, count(DISTINCT {c})::BIGINT AS unique_values FROM {source}"
        for c in columns
    )


@check("numeric_summary", _numeric_sql(GAPPY_SQL, ["value", "user_id"]))
def numeric_summary(spark, d):
    return rounded(p.numeric_summary(gappy(spark, d), ["value", "user_id"]), "mean", "median", "std")


@check(
    "categorical_summary",
    f"""WITH f AS (SELECT event_type v, count(*) n FROM {GAPPY_SQL} GROUP BY 1)
    SELECT 'event_type' AS variable, count(v)::BIGINT AS unique_values,
      coalesce(sum(CASE WHEN v IS NULL THEN n END), 0)::BIGINT AS missing_values,
      (SELECT v FROM f WHERE v IS NOT NULL ORDER BY n DESC, v LIMIT 1) AS most_common FROM f""",
)
def categorical_summary(spark, d):
    return p.categorical_summary(gappy(spark, d), ["event_type"])


@check(
    "top_ten_values",
    """SELECT variable, value, count::BIGINT AS count, position FROM (
      SELECT *, row_number() OVER (PARTITION BY variable ORDER BY count DESC, value)::INT AS position FROM (
        SELECT 'p_brand' AS variable, p_brand AS value, count(*) AS count FROM part GROUP BY 2
        UNION ALL SELECT 'p_type', p_type, count(*) FROM part GROUP BY 2)) WHERE position <= 10""",
)
def top_ten_values(spark, d):
    return p.value_counts(table(spark, d, "part"), ["p_brand", "p_type"], top=10)


@check(
    "quality_score",
    f"""WITH m AS (SELECT count(*) n, sum((event_type IS NULL)::INT + (value IS NULL)::INT) miss FROM {GAPPY_SQL})
    SELECT n::BIGINT AS rows, (4 * n)::BIGINT AS cells, miss::BIGINT AS missing,
      floor(100.0 * (4 * n - miss)::DOUBLE / (4 * n) + 0.5)::BIGINT AS quality FROM m""",
)
def quality_score(spark, d):
    return p.quality_score(gappy(spark, d))


@check(
    "missing_report",
    f"""WITH m AS (SELECT sum((event_type IS NULL)::INT) a, sum((value IS NULL)::INT) b FROM {GAPPY_SQL})
    SELECT 'event_type' AS variable, a::BIGINT AS missing, (a + b)::BIGINT AS total_missing FROM m WHERE a > 0
    UNION ALL SELECT 'value', b::BIGINT, (a + b)::BIGINT FROM m WHERE b > 0""",
)
def missing_report(spark, d):
    return p.missing_report(gappy(spark, d))


@check(
    "population_summary",
    """WITH s AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS k, count(*) OVER () AS n FROM events)
    SELECT 'value' AS variable, count(*)::BIGINT AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std,
      min(value) AS min, max(value) AS max, max(CASE WHEN k = floor(n * 0.25) THEN value END) AS q1,
      max(CASE WHEN k = floor(n * 0.75) THEN value END) AS q3, round(median(value), 6) AS median FROM s""",
)
def population_summary(spark, d):
    return rounded(p.population_summary(table(spark, d, "events"), "value"), "mean", "std", "median")
