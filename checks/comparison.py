"""Outlier group against the rest: descriptives, tests, profile."""

from pyspark.sql import functions as F

from fenceline.functions.columns import p_value_text, significance_code
from fenceline.operators import compare as c
from fenceline.operators import profile as p
from fenceline.operators import univariate as u

from .registry import check, r, rounded, table
from .sqlmath import chi2_sf, norm_two_sided, t_two_sided

# Order lines of outlying price per unit; flags by z-score of the discounted price.
ORDERS_SQL = """orders_flagged AS (SELECT o_orderkey, o_orderstatus, o_orderpriority, o_totalprice, o_custkey,
    CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_totalprice / 1000 END AS thousands,
    o_totalprice > (SELECT avg(o_totalprice) + 1.2 * stddev_samp(o_totalprice) FROM orders) AS is_outlier FROM orders)"""

EVENTS_SQL = """events_flagged AS (SELECT event_id, event_type, user_id, value, user_id % 10 AS slot,
    abs(value - (SELECT avg(value) FROM events)) / (SELECT stddev_samp(value) FROM events) > 2 AS is_outlier FROM events)"""


def orders_flagged(spark, d):
    orders = table(spark, d, "orders")
    s = u.moments(orders, ["o_totalprice"])["o_totalprice"]
    return orders.select(
        "o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice", "o_custkey",
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_totalprice") / 1000).alias("thousands"),
        (F.col("o_totalprice") > s["mean"] + 1.2 * s["std"]).alias("is_outlier"),
    )


def events_flagged(spark, d):
    events = table(spark, d, "events")
    fit = u.fit_zscore(events, ["value"], 2.0)["value"]
    return events.select(
        "event_id", "event_type", "user_id", "value", (F.col("user_id") % 10).alias("slot"),
        fit.flag("value").alias("is_outlier"),
    )


def describe_sql(columns, source="orders_flagged"):
    return " UNION ALL ".join(
        f"""SELECT '{v}' AS variable, is_outlier, count({v})::BIGINT AS n, round(coalesce(avg({v}), 0), 4) AS mean,
        round(coalesce(median({v}), 0), 4) AS median, round(coalesce(stddev_samp({v}), 0), 4) AS std,
        coalesce(min({v}), 0)::DOUBLE AS min, coalesce(max({v}), 0)::DOUBLE AS max,
        round(coalesce(quantile_cont({v}, 0.25), 0), 4) AS q25, round(coalesce(quantile_cont({v}, 0.75), 0), 4) AS q75,
        (count(*) - count({v}))::BIGINT AS missing,
        round(100.0 * (count(*) - count({v}))::DOUBLE / count(*), 4) AS missing_percent FROM {source} GROUP BY is_outlier"""
        for v in columns
    )


NUMERIC = ["o_totalprice", "thousands"]
ROUND4 = ["mean", "median", "std", "q25", "q75", "missing_percent"]


@check("group_descriptives", f"WITH {ORDERS_SQL} {describe_sql(NUMERIC)}")
def group_descriptives(spark, d):
    return rounded(c.describe_groups(orders_flagged(spark, d), NUMERIC), *ROUND4, digits=4)


def proportions_sql(columns):
    return " UNION ALL ".join(
        f"""SELECT '{v}' AS variable, is_outlier, {v} AS value, count(*)::BIGINT AS count,
        round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY is_outlier), 6) AS proportion
        FROM orders_flagged GROUP BY is_outlier, {v}"""
        for v in columns
    )


@check("group_proportions", f"WITH {ORDERS_SQL} {proportions_sql(['o_orderstatus', 'o_orderpriority'])}")
def group_proportions(spark, d):
    shares = c.category_proportions(orders_flagged(spark, d), ["o_orderstatus", "o_orderpriority"])
    return rounded(shares, "proportion")


@check(
    "group_bars",
    f"WITH {ORDERS_SQL} SELECT 'o_orderstatus' AS variable, is_outlier, o_orderstatus AS value, count(*)::BIGINT AS count "
    "FROM orders_flagged GROUP BY ALL",
)
def group_bars(spark, d):
    return c.group_bars(orders_flagged(spark, d), ["o_orderstatus"])


@check(
    "group_boxes",
    f"WITH {ORDERS_SQL} SELECT variable, is_outlier, n, min, q25, median, q75, max FROM ({describe_sql(NUMERIC)})",
)
def group_boxes(spark, d):
    return rounded(c.group_boxes(orders_flagged(spark, d), NUMERIC), "q25", "median", "q75", digits=4)


def mann_whitney_sql(columns, source):
    parts = []
    for v in columns:
        parts.append(
            f"""SELECT '{v}' AS variable, is_outlier, x, avg(rn) OVER (PARTITION BY x) AS rank,
            count(*) OVER (PARTITION BY x) AS ties FROM (SELECT is_outlier, {v} AS x, row_number() OVER (ORDER BY {v}) AS rn
            FROM {source} WHERE {v} IS NOT NULL)"""
        )
    return f"""ranked AS ({' UNION ALL '.join(parts)}),
      sums AS (SELECT variable, count(*)::DOUBLE AS n, sum(is_outlier::INT)::DOUBLE AS n1,
        sum(CASE WHEN is_outlier THEN rank ELSE 0 END) AS rs, sum(ties::DOUBLE * ties - 1) AS tie FROM ranked GROUP BY 1),
      us AS (SELECT variable, n, n1, n - n1 AS n2, tie, rs - n1 * (n1 + 1) / 2 AS u FROM sums),
      zs AS (SELECT *, (u - n1 * n2 / 2) / sqrt(n1 * n2 * (n + 1) / 12) AS z,
        (greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / sqrt(n1 * n2 / 12 * ((n + 1) - tie / (n * (n - 1)))) AS zc FROM us),
      mw AS (SELECT variable, u, z, z / sqrt(n) AS r, least(1.0, {norm_two_sided('zc')}) AS p_value,
        n1::BIGINT AS outliers_n, n2::BIGINT AS normal_n, n::BIGINT AS n FROM zs)"""


MW_EVENTS = f"{EVENTS_SQL}, {mann_whitney_sql(['user_id', 'slot'], 'events_flagged')}"


@check(
    "mann_whitney",
    f"""WITH {MW_EVENTS} SELECT variable, round(u, 3) AS u, round(z, 6) AS z, round(r, 6) AS r, round(p_value, 6) AS p_value,
    outliers_n, normal_n, n, p_value < 0.05 AS significant FROM mw""",
)
def mann_whitney(spark, d):
    tested = c.mann_whitney(events_flagged(spark, d), ["user_id", "slot"])
    return rounded(rounded(tested, "z", "r", "p_value"), "u", digits=3).drop("p_value_text", "significance", "method")


@check(
    "p_value_text",
    f"""WITH {MW_EVENTS} SELECT variable, CASE WHEN p_value < 1e-6 THEN printf('%.2e', p_value) WHEN p_value < 1e-3
      THEN printf('%.6f', p_value) ELSE printf('%.4f', p_value) END AS text FROM mw""",
)
def p_value_texts(spark, d):
    tested = c.mann_whitney(events_flagged(spark, d), ["user_id", "slot"])
    return tested.select("variable", p_value_text(F.col("p_value")).alias("text"))


@check(
    "significance_codes",
    """SELECT event_id, CASE WHEN value / 100 < 0.001 THEN '***' WHEN value / 100 < 0.01 THEN '**' WHEN value / 100 < 0.05 THEN '*'
       WHEN value / 100 < 0.1 THEN '.' ELSE '' END AS code FROM events""",
)
def significance_codes(spark, d):
    return table(spark, d, "events").select("event_id", significance_code(F.col("value") / 100).alias("code"))


def chi_square_sql(columns, source):
    """Pearson and Yates statistics per variable, from cells in long form."""
    cells = " UNION ALL ".join(
        f"""SELECT '{v}' AS variable, {v}::VARCHAR AS value, sum(is_outlier::INT)::DOUBLE AS o1, sum((NOT is_outlier)::INT)::DOUBLE AS o0
        FROM {source} WHERE {v} IS NOT NULL GROUP BY 2"""
        for v in columns
    )
    return f"""cells AS ({cells}),
      margins AS (SELECT variable, sum(o1) n1, sum(o0) n0, count(*) k FROM cells GROUP BY 1),
      ex AS (SELECT *, (o1 + o0) * n1 / (n1 + n0) AS e1, (o1 + o0) * n0 / (n1 + n0) AS e0 FROM cells JOIN margins USING (variable)),
      chi AS (SELECT variable, any_value(k) AS k, any_value(n1 + n0) AS n, min(least(e1, e0)) AS least_e,
        sum((o1 - e1) * (o1 - e1) / e1 + (o0 - e0) * (o0 - e0) / e0) AS plain,
        sum(pow(abs(o1 - e1) - least(0.5, abs(o1 - e1)), 2) * (1 / e1 + 1 / e0)) AS yates FROM ex WHERE n1 > 0 AND n0 > 0 AND k > 1 GROUP BY 1),
      picked AS (SELECT variable, k, n, least_e, CASE WHEN k = 2 AND least_e >= 5 THEN yates ELSE plain END AS chi2 FROM chi)"""


# Two categories, five categories, and two with a rare one.
CATEGORIES_SQL = f"""{EVENTS_SQL}, ev AS (SELECT *, CASE WHEN slot < 5 THEN 'low' ELSE 'high' END AS half FROM events_flagged)"""


def events_with_half(spark, d):
    return events_flagged(spark, d).withColumn("half", F.when(F.col("slot") < 5, "low").otherwise("high"))


EFFECT = """CASE WHEN sqrt(chi2 / n) < 0.1 THEN 'small' WHEN sqrt(chi2 / n) < 0.3 THEN 'small to medium'
  WHEN sqrt(chi2 / n) < 0.5 THEN 'medium' ELSE 'large' END"""


@check(
    "chi_square_tests",
    f"""WITH {CATEGORIES_SQL}, {chi_square_sql(['event_type', 'half'], 'ev')}
    SELECT variable, 'chi-square' AS test, round(chi2, 6) AS chi2, (k - 1)::BIGINT AS dof,
      round({chi2_sf('chi2', '(k - 1)')}, 6) AS p_value, {chi2_sf('chi2', '(k - 1)')} < 0.05 AS significant,
      CASE WHEN k = 2 THEN 'phi' ELSE 'cramer_v' END AS effect, round(sqrt(chi2 / n), 6) AS effect_size, {EFFECT} AS effect_label,
      n::BIGINT AS n FROM picked""",
)
def chi_square_tests(spark, d):
    tests = c.contingency_tests(events_with_half(spark, d), ["event_type", "half"])
    return rounded(tests, "chi2", "p_value", "effect_size").drop("p_value_text")


# A 2 x 2 table with a rare cell: suppliers of one nation among those with a large negative balance.
SUPPLIERS_SQL = """sup AS (SELECT s_suppkey, CASE WHEN s_nationkey < 3 THEN 'first nations' ELSE 'other' END AS home,
    s_acctbal < 0 AS is_outlier FROM supplier)"""


def suppliers_flagged(spark, d):
    return table(spark, d, "supplier").select(
        "s_suppkey", F.when(F.col("s_nationkey") < 3, "first nations").otherwise("other").alias("home"),
        (F.col("s_acctbal") < 0).alias("is_outlier"),
    )


@check(
    "fisher_exact_test",
    f"""WITH {SUPPLIERS_SQL}, {chi_square_sql(['home'], 'sup')},
    t AS (SELECT max(CASE WHEN value = 'first nations' THEN o1 END) a, max(CASE WHEN value = 'first nations' THEN o0 END) b,
      max(CASE WHEN value = 'other' THEN o1 END) c, max(CASE WHEN value = 'other' THEN o0 END) d FROM cells),
    ks AS (SELECT *, unnest(range(greatest(0, a + c - (c + d))::BIGINT, least(a + b, a + c)::BIGINT + 1)) AS k FROM t),
    ps AS (SELECT a, k, exp(lgamma(a + b + 1) - lgamma(k + 1) - lgamma(a + b - k + 1) + lgamma(c + d + 1) - lgamma(a + c - k + 1)
      - lgamma(d + c - a - c + k + 1) - lgamma(a + b + c + d + 1) + lgamma(a + c + 1) + lgamma(b + d + 1)) AS p FROM ks),
    f AS (SELECT sum(p) AS p FROM ps WHERE p <= (SELECT max(CASE WHEN k = a THEN p END) FROM ps) * (1 + 1e-7)),
    z AS (SELECT *, CASE WHEN least_e < 5 THEN f.p ELSE {chi2_sf('chi2', '1')} END AS pv FROM picked, f)
    SELECT variable, CASE WHEN least_e < 5 THEN 'fisher exact' ELSE 'chi-square' END AS test, round(chi2, 6) AS chi2, 1::BIGINT AS dof,
      round(pv, 6) AS p_value, pv < 0.05 AS significant, 'phi' AS effect, round(sqrt(chi2 / n), 6) AS effect_size, {EFFECT} AS effect_label,
      n::BIGINT AS n FROM z""",
)
def fisher_exact_test(spark, d):
    tests = c.contingency_tests(suppliers_flagged(spark, d), ["home"])
    return rounded(tests, "chi2", "p_value", "effect_size").drop("p_value_text")


@check("permutation_test")
def permutation_test(spark, d):
    supplier = table(spark, d, "supplier").select(
        F.col("s_nationkey").cast("string").alias("nation"), (F.col("s_acctbal") < 0).alias("is_outlier")
    )
    return rounded(c.contingency_tests(supplier, ["nation"]), "chi2", "effect_size")


# ---------------------------------------------------------------- profile


@check(
    "profile_categorical_tests",
    f"""WITH {CATEGORIES_SQL}, {chi_square_sql(['event_type', 'half'], 'ev').replace('AND least_e >= 5 ', '')}
    SELECT variable, round(chi2, 6) AS chi2, (k - 1)::BIGINT AS dof, NULL::DOUBLE AS fisher_p,
      round({chi2_sf('chi2', '(k - 1)')}, 6) AS chi2_p FROM picked""",
)
def profile_categorical_tests(spark, d):
    profile = c.profile_groups(events_with_half(spark, d), ["event_type", "half"], ["user_id"])
    return rounded(profile["categorical_tests"], "chi2", "fisher_p", "chi2_p")


@check("profile_numeric", f"WITH {ORDERS_SQL} {describe_sql(['thousands'])}")
def profile_numeric(spark, d):
    profile = c.profile_groups(orders_flagged(spark, d), ["o_orderstatus"], ["thousands"])
    return rounded(profile["numeric_statistics"], *ROUND4, digits=4)


@check(
    "student_t",
    f"""WITH {EVENTS_SQL}, g AS (SELECT is_outlier o, count(*)::DOUBLE n, avg(user_id) m, var_samp(user_id) v FROM events_flagged GROUP BY 1),
    s AS (SELECT a.n + b.n - 2 AS dof, (a.m - b.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2) * (1 / a.n + 1 / b.n)) AS t
      FROM g a, g b WHERE a.o AND NOT b.o)
    SELECT 'user_id' AS variable, round(t, 6) AS t, dof::BIGINT AS dof, round({t_two_sided('t', 'dof')}, 6) AS p_value FROM s""",
)
def student_t(spark, d):
    return rounded(c.t_statistics(c.grouped_moments(events_flagged(spark, d), ["user_id"])), "t", "p_value")


NATIONS_SQL = """(SELECT avg(c_acctbal) AS mean_balance, any_value(n_regionkey) < 2 AS is_outlier
    FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY c_nationkey)"""


def student_t_gate_sql(normality_sql):
    """SQL of the t test with its gate, given the SQL of the normality test."""
    gates = " UNION ALL ".join(
        normality_sql(["mean_balance"], f"(SELECT * FROM {NATIONS_SQL} WHERE is_outlier = {flag})") for flag in ("true", "false")
    )
    return f"""WITH g AS (SELECT is_outlier o, count(*)::DOUBLE n, avg(mean_balance) m, var_samp(mean_balance) v FROM {NATIONS_SQL} GROUP BY 1),
    s AS (SELECT a.n + b.n - 2 AS dof, (a.m - b.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2) * (1 / a.n + 1 / b.n)) AS t
      FROM g a, g b WHERE a.o AND NOT b.o)
    SELECT 'mean_balance' AS variable, round(t, 6) AS t, dof::BIGINT AS dof, round({t_two_sided('t', 'dof')}, 6) AS p_value,
      (SELECT bool_and(is_normal) FROM ({gates})) AS both_normal FROM s"""


def student_t_after_normality(spark, d):
    # Mean balances of nations are close to normal, single balances are not.
    nations = table(spark, d, "customer").groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("mean_balance"))
    regions = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    flagged = nations.join(regions, "c_nationkey").withColumn("is_outlier", F.col("n_regionkey") < 2)
    return rounded(c.student_t(flagged, ["mean_balance"]), "t", "p_value")


@check(
    "available_analyses",
    """WITH k(variable, numeric) AS (VALUES ('o_totalprice', true), ('o_custkey', true), ('o_orderstatus', false))
    SELECT a AS analysis, variable FROM k, (VALUES ('regression'), ('pca'), ('clustering'), ('correlation')) v(a)
      WHERE numeric AND (SELECT count(*) FROM orders) > 0
    UNION ALL SELECT 'classification', variable FROM k UNION ALL SELECT 'contingency', variable FROM k WHERE NOT numeric""",
)
def available_analyses(spark, d):
    orders = table(spark, d, "orders").select("o_totalprice", "o_custkey", "o_orderstatus")
    return c.available_analyses(p.infer_kinds(orders))
