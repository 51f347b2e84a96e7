"""Marking rows from id lists and combining detector votes."""

from pyspark.sql import functions as F

from fenceline.operators import combine as k
from fenceline.operators import marks as m
from fenceline.operators import univariate as u

from .registry import check, r, rounded, table

# Ids listed as outliers: the customers of the dearest orders, so that ids may repeat.
LISTED_SQL = "(SELECT o_custkey AS id FROM orders WHERE o_totalprice > 490000)"


def listed(spark, d):
    return table(spark, d, "orders").where("o_totalprice > 490000").select(F.col("o_custkey").alias("id"))


@check("mark_by_id", f"SELECT o_orderkey, o_custkey, o_custkey IN (SELECT id FROM {LISTED_SQL}) AS is_outlier FROM orders")
def mark_by_id(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return m.mark_outliers(orders, listed(spark, d), "o_custkey")


@check(
    "mark_by_position",
    f"SELECT c_custkey, c_custkey IN (SELECT id FROM {LISTED_SQL}) AS is_outlier FROM customer",
)
def mark_by_position(spark, d):
    ids = listed(spark, d).select(
        F.when(F.col("id") < 700, F.concat(F.lit("ID_"), F.col("id"))).otherwise(F.col("id").cast("string")).alias("id")
    )
    return m.mark_positions(table(spark, d, "customer").select("c_custkey"), ids, "c_custkey")


@check(
    "unmatched_ids",
    "SELECT DISTINCT o_custkey::VARCHAR AS id FROM orders WHERE o_custkey NOT IN (SELECT s_suppkey FROM supplier)",
)
def unmatched_ids(spark, d):
    ids = table(spark, d, "orders").select(F.col("o_custkey").alias("id"))
    return m.unmatched_ids(table(spark, d, "supplier"), ids, "s_suppkey")


# A list that mixes customer numbers, row names and entries that name nothing.
MIXED_SQL = """k AS (SELECT DISTINCT o_custkey::VARCHAR AS id FROM orders WHERE o_custkey % 97 = 0),
    p AS (SELECT o_orderkey FROM orders WHERE o_orderkey % 101 = 0)"""


def mixed(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    ids = orders.where("o_custkey % 97 = 0").select(F.col("o_custkey").cast("string").alias("id"))
    ids = ids.unionAll(orders.where("o_orderkey % 101 = 0").select(F.concat(F.lit("ID_"), "o_orderkey")))
    ids = ids.unionAll(orders.where("o_orderkey % 103 = 0").select(F.concat(F.lit("none-"), F.col("o_orderkey"))))
    return m.mark_listed(orders, ids, "o_custkey", "o_orderkey")


@check(
    "mark_listed",
    f"WITH {MIXED_SQL} SELECT o_orderkey, o_custkey, o_custkey % 97 = 0 OR o_orderkey IN (SELECT o_orderkey FROM p) AS is_outlier FROM orders",
)
def mark_listed(spark, d):
    return mixed(spark, d)[0]


@check("mark_listed_unmatched", "SELECT 'none-' || o_orderkey AS id FROM orders WHERE o_orderkey % 103 = 0")
def mark_listed_unmatched(spark, d):
    return mixed(spark, d)[1]


OCCURRENCES_SQL = f"""WITH n AS (SELECT id, count(*) m FROM {LISTED_SQL} GROUP BY 1),
    o AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) rn FROM orders)
    SELECT o_orderkey, o_custkey, coalesce(rn <= m, false) AS is_outlier FROM o LEFT JOIN n ON o_custkey = id"""


@check("mark_by_occurrence", OCCURRENCES_SQL)
def mark_by_occurrence(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    ids = listed(spark, d).select(F.format_string("%.1f", F.col("id").cast("double")).alias("id"))
    return m.mark_occurrences(orders, ids, "o_custkey", "o_orderkey")


# Univariate flags of two variables of events, in SQL.
FLAGS_SQL = """
  src AS (SELECT event_id, value, value * user_id AS load FROM events),
  q AS (SELECT CASE WHEN count(*) < 100 THEN 3.0 WHEN count(*) < 1000 THEN 2.0 ELSE 1.5 END k,
      quantile_cont(value, 0.25) a1, quantile_cont(value, 0.75) a3, quantile_cont(load, 0.25) b1, quantile_cont(load, 0.75) b3,
      median(value) amed, median(load) bmed, avg(value) am, avg(load) bm, stddev_samp(value) asd, stddev_samp(load) bsd FROM src),
  md AS (SELECT 1.4826 * median(abs(value - amed)) amad, 1.4826 * median(abs(load - bmed)) bmad FROM src, q),
  uni AS (SELECT event_id,
      (value < a1 - k * (a3 - a1) OR value > a3 + k * (a3 - a1)) AS value_iqr, abs(value - am) / asd > 3 AS value_zscore,
      abs(value - amed) / amad > 3 AS value_mad,
      (load < b1 - k * (b3 - b1) OR load > b3 + k * (b3 - b1)) AS load_iqr, abs(load - bm) / bsd > 3 AS load_zscore,
      abs(load - bmed) / bmad > 3 AS load_mad FROM src, q, md),
  scored AS (SELECT *, (value_iqr::INT + value_zscore::INT + value_mad::INT >= 2)::INT
      + (load_iqr::INT + load_zscore::INT + load_mad::INT >= 2)::INT AS uni_score FROM uni)"""


def flagged(spark, d):
    events = table(spark, d, "events").select("event_id", "value", (F.col("value") * F.col("user_id")).alias("load"))
    return u.univariate_flags(events, ["value", "load"])


@check("univariate_flags", f"WITH {FLAGS_SQL} SELECT * FROM uni")
def univariate_flags(spark, d):
    return flagged(spark, d).drop("value", "load")


@check("univariate_score", f"WITH {FLAGS_SQL} SELECT event_id, uni_score FROM scored")
def univariate_score(spark, d):
    return flagged(spark, d).select("event_id", u.univariate_score(["value", "load"]).alias("uni_score"))


METHODS = ["iqr", "zscore", "mad"]
WIDE_SQL = """wide AS (SELECT *, value_iqr OR load_iqr AS iqr, value_zscore OR load_zscore AS zscore,
    value_mad OR load_mad AS mad FROM scored)"""
LONG_SQL = f"""{FLAGS_SQL}, {WIDE_SQL}, long AS (SELECT event_id, 'iqr' AS method FROM wide WHERE iqr
    UNION ALL SELECT event_id, 'zscore' FROM wide WHERE zscore UNION ALL SELECT event_id, 'mad' FROM wide WHERE mad)"""


def wide(spark, d):
    return flagged(spark, d).withColumns({n: u.any_univariate(["value", "load"], n) for n in METHODS})


def long_flags(spark, d):
    return m.flags_long(wide(spark, d), "event_id", {n: F.col(n) for n in METHODS})


@check("union_of_flags", f"WITH {LONG_SQL} SELECT DISTINCT event_id FROM long")
def union_of_flags(spark, d):
    df = wide(spark, d)
    return m.union_flags(*[df.where(F.col(n)).select("event_id") for n in METHODS])


@check("flags_long", f"WITH {LONG_SQL} SELECT event_id, method FROM long")
def flags_long(spark, d):
    return long_flags(spark, d)


@check(
    "set_comparison",
    """WITH a AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase'),
    b AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'error')
    SELECT user_id, CASE WHEN user_id NOT IN (SELECT user_id FROM b) THEN 'first only' ELSE 'common' END AS side FROM a
    UNION ALL SELECT user_id, 'second only' FROM b WHERE user_id NOT IN (SELECT user_id FROM a)""",
)
def set_comparison(spark, d):
    events = table(spark, d, "events")
    return m.compare_sets(
        events.where("event_type = 'purchase'"), events.where("event_type = 'error'"), "user_id"
    )


@check(
    "vote_matrix",
    f"WITH {LONG_SQL} SELECT event_id, iqr::INT AS iqr, zscore::INT AS zscore, mad::INT AS mad FROM wide WHERE iqr OR zscore OR mad",
)
def vote_matrix(spark, d):
    return m.vote_matrix(long_flags(spark, d), "event_id", METHODS)


@check(
    "method_flow",
    f"""WITH {LONG_SQL} SELECT method, CASE WHEN uni_score >= 1 THEN 'outlier' ELSE 'normal' END AS verdict, count(*)::BIGINT AS rows
    FROM long JOIN scored USING (event_id) GROUP BY 1, 2""",
)
def method_flow(spark, d):
    final = flagged(spark, d).where(u.univariate_score(["value", "load"]) >= 1).select("event_id")
    return m.method_flow(long_flags(spark, d), final, "event_id")


# Votes derived from the events themselves, to check every rule on every mix of votes.
VOTES_SQL = """votes AS (SELECT event_id, (user_id % 3)::INT AS uni, value > 40 AS mahal, event_type IN ('click', 'view') AS lof,
    user_id % 2 = 0 AS forest, value > 150 AS hyp FROM events)"""
RULES = {
    "voting": "hyp OR mahal::INT + lof::INT + forest::INT >= 1 OR uni >= 2",
    "voting_two": "hyp OR mahal::INT + lof::INT + forest::INT >= 2 OR uni >= 2",
    "adaptive_normal": "CASE WHEN hyp THEN true WHEN mahal THEN uni >= 1 WHEN lof AND forest THEN true ELSE uni >= 2 END",
    "adaptive_other": """CASE WHEN hyp THEN true WHEN lof AND forest THEN true WHEN uni >= 2 THEN true
                         ELSE (lof OR forest) AND uni >= 1 END""",
    "union": "uni >= 1 OR mahal OR lof OR forest OR hyp",
    "intersection": "hyp OR (uni >= 1 AND (mahal OR lof OR forest))",
}
CALLS = {
    "voting": ("voting", False, 1),
    "voting_two": ("voting", False, 2),
    "adaptive_normal": ("adaptive", True, 1),
    "adaptive_other": ("adaptive", False, 1),
    "union": ("union", False, 1),
    "intersection": ("intersection", False, 1),
}


def voted(spark, d, rule):
    strategy, normal, min_multi = CALLS[rule]
    verdict = k.final_verdict(
        strategy, (F.col("user_id") % 3), F.col("value") > 40, F.col("event_type").isin("click", "view"),
        F.col("user_id") % 2 == 0, F.col("value") > 150, normal, 2, min_multi,
    )
    return table(spark, d, "events").select("event_id", verdict.alias("is_outlier"))


for _rule, _sql in RULES.items():
    check(f"combine_{_rule}", f"WITH {VOTES_SQL} SELECT event_id, {_sql} AS is_outlier FROM votes")(
        lambda spark, d, rule=_rule: voted(spark, d, rule)
    )


@check(
    "outlier_metrics",
    """WITH s AS (SELECT avg(value) m, stddev_samp(value) sd FROM events), f AS (SELECT abs(value - m) / sd > 3 o FROM events, s)
    SELECT count(*)::BIGINT AS total, sum(o::INT)::BIGINT AS outliers, (count(*) - sum(o::INT))::BIGINT AS normal,
      round(100.0 * sum(o::INT)::DOUBLE / count(*), 1) AS percent FROM f""",
)
def outlier_metrics(spark, d):
    events = table(spark, d, "events")
    return k.outlier_metrics(events.withColumn("is_outlier", u.fit_zscore(events, ["value"])["value"].flag("value")))


@check(
    "vote_detail",
    f"""WITH {LONG_SQL} SELECT event_id, iqr, zscore, mad, iqr::INT + zscore::INT + mad::INT AS univariate_votes,
      0 AS multivariate_votes, 0 AS hypothesis_votes, iqr::INT + zscore::INT + mad::INT AS total_votes
    FROM wide WHERE uni_score >= 1""",
)
def vote_detail(spark, d):
    final = u.univariate_score(["value", "load"]) >= 1
    return k.vote_detail(wide(spark, d).withColumn("is_outlier", final), "event_id", METHODS)


@check(
    "method_counts",
    f"""WITH {LONG_SQL}, n AS (SELECT count(*) t, sum(iqr::INT) i, sum(zscore::INT) z, sum(mad::INT) m, sum((uni_score >= 1)::INT) f FROM wide)
    """ + " UNION ALL ".join(
        f"""SELECT '{name}' AS method, {c}::BIGINT AS flagged, t::BIGINT AS total, round(100.0 * {c}::DOUBLE / t, 2) AS percent,
        100.0 * {c} / t > 50 AS too_many FROM n"""
        for name, c in (("iqr", "i"), ("zscore", "z"), ("mad", "m"), ("final", "f"))
    ),
)
def method_counts(spark, d):
    final = u.univariate_score(["value", "load"]) >= 1
    return k.method_counts(wide(spark, d).withColumn("is_outlier", final), METHODS)
