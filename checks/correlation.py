"""Correlations, trend lines and correlation networks."""

from pyspark.sql import functions as F

from fenceline.operators import correlate as k

from .comparison import EVENTS_SQL, events_flagged
from .registry import ORACLES, check, r, rounded, table
from .sqlmath import norm_two_sided, t_two_sided

COLUMNS = ["value", "user_id", "load", "slot"]
# Four numeric columns of events, two of them related.
DATA_SQL = f"""{EVENTS_SQL}, data AS (SELECT event_id, is_outlier, value, user_id, value * user_id AS load, slot FROM events_flagged)"""


def data(spark, d):
    return events_flagged(spark, d).withColumn("load", F.col("value") * F.col("user_id"))


PAIRS = [(a, b) for i, a in enumerate(COLUMNS) for b in COLUMNS[i + 1 :]]


def ranked_sql(by, source="data"):
    """data with every column replaced by its average rank (within by)."""
    part = f"PARTITION BY {by} " if by else ""
    tie = f"PARTITION BY {by + ', ' if by else ''}"
    ranks = ", ".join(f"row_number() OVER ({part}ORDER BY {c}) AS r_{c}" for c in COLUMNS)
    averages = ", ".join(f"avg(r_{c}) OVER ({tie}{c}) AS {c}" for c in COLUMNS)
    return f"SELECT is_outlier, {averages} FROM (SELECT *, {ranks} FROM {source})"


def pairs_sql(source, by, name="r"):
    return " UNION ALL ".join(
        f"SELECT {by + ', ' if by else ''}'{a}' AS first, '{b}' AS second, corr({a}, {b}) AS {name}, count(*) AS n "
        f"FROM {source} {'GROUP BY ' + by if by else ''}"
        for a, b in PAIRS
    )


T = "r * sqrt((n - 2) / (1 - r * r))"

STRENGTH = """CASE WHEN abs({0}) >= 0.8 THEN 'very strong' WHEN abs({0}) >= 0.6 THEN 'strong' WHEN abs({0}) >= 0.4 THEN 'moderate'
  WHEN abs({0}) >= 0.2 THEN 'weak' WHEN abs({0}) > 0 THEN 'very weak' ELSE 'none' END"""


@check(
    "relationship",
    f"""WITH {DATA_SQL}, rk AS ({ranked_sql('')}),
    c AS (SELECT (SELECT count(*) FROM data) AS n, (SELECT corr(value, load) FROM data) AS p, (SELECT corr(value, load) FROM rk) AS s)
    SELECT 'value' AS first, 'load' AS second, n::BIGINT AS n, round(p, 6) AS pearson, round(s, 6) AS spearman,
      {STRENGTH.format('p')} AS pearson_strength, {STRENGTH.format('s')} AS spearman_strength, abs(p - s) > 0.1 AS maybe_nonlinear FROM c""",
)
def relationship(spark, d):
    return rounded(k.relationship(data(spark, d), "value", "load"), "pearson", "spearman")


@check(
    "correlation_matrix",
    f"""WITH {DATA_SQL}, h AS (SELECT first, second, r, {t_two_sided(T, '(n - 2)')} AS p FROM ({pairs_sql('data', '')}))
    SELECT first, second, round(r, 6) AS r, round(p, 6) AS p_value FROM h UNION ALL SELECT second, first, round(r, 6), round(p, 6) FROM h
    UNION ALL SELECT unnest({COLUMNS}) AS first, unnest({COLUMNS}), 1.0, 0.0""",
)
def correlation_matrix(spark, d):
    return rounded(k.correlation_matrix(data(spark, d), COLUMNS), "r", "p_value")


@check(
    "trend_line",
    """SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept,
      min(l_quantity) AS x_first, max(l_quantity) AS x_last, count(*)::BIGINT AS n,
      round(regr_slope(l_extendedprice, l_quantity) * min(l_quantity) + regr_intercept(l_extendedprice, l_quantity), 4) AS y_first,
      round(regr_slope(l_extendedprice, l_quantity) * max(l_quantity) + regr_intercept(l_extendedprice, l_quantity), 4) AS y_last FROM lineitem""",
)
def trend_line(spark, d):
    line = k.trend_line(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice")
    return rounded(line, "slope", "intercept", "y_first", "y_last", digits=4)


Z = "(atanh(op) - atanh(np)) / sqrt(1.0 / (on_ - 3) + 1.0 / (nn - 3))"


@check(
    "compare_group_correlations",
    f"""WITH {DATA_SQL}, rk AS ({ranked_sql('is_outlier')}), pe AS ({pairs_sql('data', 'is_outlier', 'p')}),
    sp AS ({pairs_sql('rk', 'is_outlier', 's')}),
    w AS (SELECT first, second, max(p) FILTER (is_outlier) op, max(p) FILTER (NOT is_outlier) np, max(s) FILTER (is_outlier) os,
      max(s) FILTER (NOT is_outlier) ns, max(pe.n) FILTER (is_outlier) on_, max(pe.n) FILTER (NOT is_outlier) nn
      FROM pe JOIN sp USING (is_outlier, first, second) GROUP BY 1, 2),
    z AS (SELECT *, CASE WHEN abs(op) < 0.99 AND abs(np) < 0.99 THEN {Z} END AS z FROM w),
    q AS (SELECT *, CASE WHEN z IS NOT NULL THEN {norm_two_sided('z')} END AS pv FROM z)
    SELECT first, second, round(op, 6) AS outlier_pearson, round(np, 6) AS normal_pearson, round(os, 6) AS outlier_spearman,
      round(ns, 6) AS normal_spearman, on_::BIGINT AS outlier_n, nn::BIGINT AS normal_n, round(abs(op - np), 6) AS pearson_change,
      round(abs(os - ns), 6) AS spearman_change, round(z, 6) AS z, round(pv, 6) AS p_value,
      abs(op - np) > 0.3 OR coalesce(pv < 0.05, false) AS significant FROM q""",
)
def compare_group_correlations(spark, d):
    compared = k.compare_group_correlations(data(spark, d), COLUMNS)
    return rounded(
        compared, "outlier_pearson", "normal_pearson", "outlier_spearman", "normal_spearman",
        "pearson_change", "spearman_change", "z", "p_value",
    )


@check(
    "correlation_change_summary",
    f"""SELECT count(*)::BIGINT AS pairs, sum(significant::INT)::BIGINT AS significant_pairs,
      round(100.0 * sum(significant::INT)::DOUBLE / count(*), 6) AS percent, max(pearson_change) AS largest_change,
      arg_max(first || ' / ' || second, pearson_change) AS largest_pair FROM ({ORACLES['compare_group_correlations']})""",
)
def correlation_change_summary(spark, d):
    summary = k.change_summary(k.compare_group_correlations(data(spark, d), COLUMNS))
    return rounded(summary, "percent", "largest_change")


RANK_PAIRS_SQL = f"""{DATA_SQL}, rk AS ({ranked_sql('is_outlier')}), rp AS ({pairs_sql('rk', 'is_outlier')}),
    rpp AS (SELECT *, CASE WHEN abs(r) >= 1 - 1e-15 THEN 0.0 ELSE {t_two_sided(T, '(n - 2)')} END AS p FROM rp)"""


@check(
    "cooccurrence",
    f"""WITH {RANK_PAIRS_SQL} SELECT first, second, round(r, 6) AS r, n::BIGINT AS n, round(p, 6) AS p_value, p < 0.05 AS significant
    FROM rpp WHERE is_outlier""",
)
def cooccurrence(spark, d):
    return rounded(k.cooccurrence(data(spark, d), COLUMNS), "r", "p_value")


@check(
    "cooccurrence_share",
    f"""WITH {RANK_PAIRS_SQL} SELECT count(*)::BIGINT AS pairs, sum((p < 0.05)::INT)::BIGINT AS significant_pairs,
    round(100.0 * sum((p < 0.05)::INT)::DOUBLE / count(*), 4) AS percent FROM rpp WHERE is_outlier""",
)
def cooccurrence_share(spark, d):
    return rounded(k.significant_share(k.cooccurrence(data(spark, d), COLUMNS)), "percent", digits=4)


EDGES_SQL = f"{RANK_PAIRS_SQL}, edges AS (SELECT is_outlier, first, second, r, p FROM rpp WHERE abs(r) >= 0.35 AND p < 0.05)"


def edges(spark, d):
    return k.correlation_network(data(spark, d), COLUMNS, threshold=0.35)


@check("correlation_network", f"WITH {EDGES_SQL} SELECT is_outlier, first, second, round(r, 6) AS r, round(p, 6) AS p_value FROM edges")
def correlation_network(spark, d):
    return rounded(edges(spark, d), "r", "p_value")


CENTRALITY_SQL = f"""{EDGES_SQL}, ends AS (SELECT is_outlier, first AS node FROM edges UNION ALL SELECT is_outlier, second FROM edges),
    grid AS (SELECT DISTINCT is_outlier, unnest({COLUMNS}) AS node FROM edges),
    cent AS (SELECT g.is_outlier, g.node, count(e.node) AS degree, count(e.node) / 3.0 AS centrality FROM grid g
      LEFT JOIN ends e ON g.is_outlier = e.is_outlier AND g.node = e.node GROUP BY 1, 2)"""


@check(
    "degree_centrality",
    f"WITH {CENTRALITY_SQL} SELECT is_outlier, node, degree::BIGINT AS degree, round(centrality::DOUBLE, 6) AS centrality, centrality > 0.3 AS hub FROM cent",
)
def degree_centrality(spark, d):
    return rounded(k.degree_centrality(edges(spark, d), COLUMNS), "centrality")


@check(
    "centrality_change",
    f"""WITH {CENTRALITY_SQL}, w AS (SELECT node, coalesce(max(centrality) FILTER (is_outlier), 0)::DOUBLE o,
      coalesce(max(centrality) FILTER (NOT is_outlier), 0)::DOUBLE n FROM cent GROUP BY 1)
    SELECT node, round(o, 6) AS outlier_centrality, round(n, 6) AS normal_centrality, round(o - n, 6) AS change FROM w WHERE abs(o - n) > 0.1""",
)
def centrality_change(spark, d):
    changed = k.centrality_change(k.degree_centrality(edges(spark, d), COLUMNS))
    return rounded(changed, "outlier_centrality", "normal_centrality", "change")


@check(
    "hub_changes",
    f"""WITH {CENTRALITY_SQL}, h AS (SELECT node, bool_or(is_outlier) o, bool_or(NOT is_outlier) n FROM cent WHERE centrality > 0.3 GROUP BY 1)
    SELECT node, CASE WHEN o AND n THEN 'common' WHEN o THEN 'outlier only' ELSE 'normal only' END AS side FROM h""",
)
def hub_changes(spark, d):
    return k.hub_changes(k.degree_centrality(edges(spark, d), COLUMNS))
