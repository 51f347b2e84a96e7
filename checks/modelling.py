"""Regression, principal components, classifiers."""

from pyspark.sql import functions as F

from fenceline.operators import classify as c
from fenceline.operators import reduce as rd
from fenceline.operators import regress as g

from .comparison import EVENTS_SQL, events_flagged
from .registry import check, r, rounded, table
from .sqlmath import f_sf, t_two_sided, norm_two_sided

# Price per line by quantity and discount: two predictors, so least squares has a closed form.
LINE_SQL = """l AS (SELECT l_extendedprice AS y, l_quantity AS a, l_discount AS b FROM lineitem),
  m AS (SELECT count(*)::DOUBLE n, avg(y) my, avg(a) ma, avg(b) mb, var_pop(a) * count(*) saa, var_pop(b) * count(*) sbb,
    covar_pop(a, b) * count(*) sab, covar_pop(a, y) * count(*) say, covar_pop(b, y) * count(*) sby, var_pop(y) * count(*) syy FROM l),
  d AS (SELECT *, saa * sbb - sab * sab AS det FROM m),
  c AS (SELECT *, (say * sbb - sby * sab) / det AS b1, (sby * saa - say * sab) / det AS b2 FROM d),
  e AS (SELECT *, my - b1 * ma - b2 * mb AS b0, syy - b1 * say - b2 * sby AS sse, n - 3 AS dof FROM c),
  s AS (SELECT *, sqrt(sse / dof * sbb / det) AS e1, sqrt(sse / dof * saa / det) AS e2,
    sqrt(sse / dof * (1 / n + (ma * ma * sbb - 2 * ma * mb * sab + mb * mb * saa) / det)) AS e0 FROM e)"""


def _least(spark, d):
    return g.least_squares(table(spark, d, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount"])


@check(
    "least_squares",
    f"WITH {LINE_SQL} " + " UNION ALL ".join(
        f"""SELECT '{t}' AS term, round({b}, 4) AS estimate, round({e}, 4) AS std_error, round({b} / {e}, 4) AS statistic,
        round({t_two_sided(f'{b} / {e}', 'dof')}, 4) AS p_value FROM s"""
        for t, b, e in (("intercept", "b0", "e0"), ("l_quantity", "b1", "e1"), ("l_discount", "b2", "e2"))
    ),
)
def least_squares(spark, d):
    coefficients = _least(spark, d)[0].drop("model")
    return rounded(coefficients, "estimate", "std_error", "statistic", "p_value", digits=4)


@check(
    "least_squares_summary",
    f"""WITH {LINE_SQL}, f AS (SELECT *, 1 - sse / syy AS r2, (syy - sse) / 2 / (sse / dof) AS f FROM s),
    q AS (SELECT quantile_cont(y - b0 - b1 * a - b2 * b, [0.0, 0.25, 0.5, 0.75, 1.0]) AS q FROM l, s)
    SELECT n::BIGINT AS n, round(r2, 6) AS r_squared, round(1 - (1 - r2) * (n - 1) / dof, 6) AS adjusted_r_squared, round(f, 4) AS f,
      round({f_sf('f', '2', 'dof')}, 4) AS f_p_value, round(sqrt(sse / dof), 4) AS residual_error, round(q[1], 3) AS residual_min,
      round(q[2], 3) AS residual_q1, round(q[3], 3) AS residual_median, round(q[4], 3) AS residual_q3, round(q[5], 3) AS residual_max FROM f, q""",
)
def least_squares_summary(spark, d):
    summary = rounded(_least(spark, d)[1], "r_squared", "adjusted_r_squared")
    summary = rounded(summary, "f", "f_p_value", "residual_error", digits=4)
    return rounded(
        summary, *[f"residual_{x}" for x in ("min", "q1", "median", "q3", "max")], digits=3
    ).drop("model")


REWEIGHTINGS = 25


def huber_sql():
    """CTEs of the reweighting rounds, written out: ft (rows), b<i> (coefficients), r<i> (residuals), s<i> (scale)."""
    size = "(abs(e) / scale)"
    weight = f"CASE WHEN {size} <= {g.HUBER} THEN 1.0::DOUBLE ELSE {g.HUBER} / {size} END"

    def fit(source):
        return f"""SELECT my - (cay * vh - chy * cah) / (va * vh - cah * cah) * ma - (chy * va - cay * cah) / (va * vh - cah * cah) * mh AS b0,
          (cay * vh - chy * cah) / (va * vh - cah * cah) AS b1, (chy * va - cay * cah) / (va * vh - cah * cah) AS b2 FROM (
          SELECT ma, mh, my, sum(w * (a - ma) ** 2) AS va, sum(w * (h - mh) ** 2) AS vh, sum(w * (a - ma) * (h - mh)) AS cah,
            sum(w * (a - ma) * (y - my)) AS cay, sum(w * (h - mh) * (y - my)) AS chy
          FROM {source}, (SELECT sum(w * a) / sum(w) AS ma, sum(w * h) / sum(w) AS mh, sum(w * y) / sum(w) AS my FROM {source}) GROUP BY ma, mh, my)"""

    parts = [
        "ft AS MATERIALIZED (SELECT value::DOUBLE AS y, user_id::DOUBLE AS a, hour(ts)::DOUBLE AS h FROM events)",
        "w0 AS (SELECT *, 1.0::DOUBLE AS w FROM ft)", f"b0 AS MATERIALIZED ({fit('w0')})",
    ]
    for i in range(REWEIGHTINGS + 1):
        parts += [
            f"r{i} AS MATERIALIZED (SELECT y, a, h, y - b0 - b1 * a - b2 * h AS e FROM ft, b{i})",
            f"s{i} AS MATERIALIZED (SELECT quantile_cont(abs(e), 0.5) / {g.NORMAL_QUARTILE!r}::DOUBLE AS scale FROM r{i})",
            f"w{i + 1} AS MATERIALIZED (SELECT y, a, h, e, scale, {weight} AS w FROM r{i}, s{i})",
        ]
        if i < REWEIGHTINGS:
            parts.append(f"b{i + 1} AS MATERIALIZED ({fit(f'w{i + 1}')})")
    return ", ".join(parts)


HUBER_SQL = huber_sql()


def _huber(spark, d):
    events = table(spark, d, "events").withColumn("hour", F.hour(F.col("ts").cast("timestamp")))
    predictors = ["user_id", "hour"]
    return g.least_squares(events, "value", predictors), g.huber_regression(events, "value", predictors, tolerance=1e-11)


@check(
    "huber_regression",
    f"""WITH {HUBER_SQL}, k AS (SELECT count(*)::DOUBLE AS n, avg((w = 1)::INT) AS m, any_value(scale) AS scale,
      sum(CASE WHEN w = 1 THEN e / scale ELSE {g.HUBER} END ** 2) AS psi2, avg(a) AS ma, avg(h) AS mh, var_pop(a) * count(*) AS va,
      var_pop(h) * count(*) AS vh, covar_pop(a, h) * count(*) AS cah FROM w{REWEIGHTINGS + 1}),
    f AS (SELECT *, va * vh - cah * cah AS det, (1 + 3 / n * (m * (1 - m)) / (m * m)) ** 2 * (psi2 / (n - 3)) * scale ** 2 / (m * m) AS factor FROM k),
    c AS (SELECT 'intercept' AS term, b0 AS b, sqrt(factor * (1 / n + (ma * ma * vh - 2 * ma * mh * cah + mh * mh * va) / det)) AS e FROM f, b{REWEIGHTINGS}
      UNION ALL SELECT 'user_id', b1, sqrt(factor * vh / det) FROM f, b{REWEIGHTINGS} UNION ALL SELECT 'hour', b2, sqrt(factor * va / det) FROM f, b{REWEIGHTINGS})
    SELECT 'huber' AS model, term, round(b, 6) AS estimate, round(e, 6) AS std_error, round(b / e, 5) AS statistic, round({norm_two_sided('b / e')}, 6) AS p_value FROM c""",
)
def huber_regression(spark, d):
    return rounded(rounded(_huber(spark, d)[1][0], "estimate", "std_error", "p_value"), "statistic", digits=5)


@check(
    "huber_weights",
    f"""WITH {HUBER_SQL}, k AS (SELECT count(*)::BIGINT AS n, any_value(scale) AS scale, quantile_cont(w, [0.0, 0.25, 0.5, 0.75, 1.0]) AS q, avg(w) AS mean,
      count(*) FILTER (w < 1)::BIGINT AS reduced, count(*) FILTER (w < {g.IGNORED_WEIGHT})::BIGINT AS ignored FROM w{REWEIGHTINGS + 1})
    SELECT 'huber' AS model, n, round(scale, 6) AS residual_error, round(q[1], 6) AS weight_min, round(q[2], 6) AS weight_q1, round(q[3], 6) AS weight_median,
      round(q[4], 6) AS weight_q3, round(q[5], 6) AS weight_max, round(mean, 6) AS weight_mean, reduced AS reduced_rows, ignored AS ignored_rows FROM k""",
)
def huber_weights(spark, d):
    return rounded(_huber(spark, d)[1][1], "residual_error", *[f"weight_{x}" for x in ("min", "q1", "median", "q3", "max", "mean")])


CHANGES_SQL = f"""{HUBER_SQL}, both_fits AS (SELECT 'user_id' AS term, l.b1 AS l, h.b1 AS h FROM b0 l, b{REWEIGHTINGS} h
    UNION ALL SELECT 'hour', l.b2, h.b2 FROM b0 l, b{REWEIGHTINGS} h),
    ch AS (SELECT *, abs(l - h) AS change, CASE WHEN abs(l) > 1e-10 THEN abs(l - h) / abs(l) * 100 ELSE 0 END AS percent FROM both_fits)"""


@check(
    "regression_changes",
    f"""WITH {CHANGES_SQL} SELECT term, round(l, 6) AS least_squares, round(h, 6) AS huber, round(change, 6) AS change,
    round(percent, 4) AS change_percent, change > 0.1 OR percent > 10 AS influenced FROM ch""",
)
def regression_changes(spark, d):
    changes = g.compare_regressions(*_huber(spark, d))[0]
    return rounded(rounded(changes, "least_squares", "huber", "change"), "change_percent", digits=4)


@check(
    "regression_verdict",
    f"""WITH {CHANGES_SQL}, v AS (SELECT (SELECT bool_or(change > 0.1 OR percent > 10) FROM ch) AS influenced,
      (SELECT sqrt(sum(e * e) / (count(*) - 3)) FROM r0) AS l, (SELECT scale FROM s{REWEIGHTINGS}) AS h)
    SELECT influenced, round(l, 6) AS least_squares_error, round(h, 6) AS huber_error, round((l - h) / l * 100, 4) AS error_change_percent FROM v""",
)
def regression_verdict(spark, d):
    verdict = g.compare_regressions(*_huber(spark, d))[1]
    return rounded(rounded(verdict, "least_squares_error", "huber_error"), "error_change_percent", digits=4)


# ---------------------------------------------------------------- components


@check(
    "standardised",
    """SELECT o_orderkey, round((o_totalprice - (SELECT avg(o_totalprice) FROM orders)) / (SELECT stddev_pop(o_totalprice) FROM orders), 6) AS o_totalprice,
      round((o_custkey - (SELECT avg(o_custkey) FROM orders)) / (SELECT stddev_pop(o_custkey) FROM orders), 6) AS o_custkey FROM orders""",
)
def standardised(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_custkey")
    return rounded(rd.standardise(orders, ["o_totalprice", "o_custkey"]), "o_totalprice", "o_custkey")


def loads(spark, d):
    return events_flagged(spark, d).withColumn("load", F.col("value") * F.col("user_id"))


# Two variables: the eigenvalues of their correlation are 1 + r and 1 - r (times
# n / (n - 1)), both components lie on the diagonals.
PAIR_SQL = f"""{EVENTS_SQL}, p AS (SELECT event_id, is_outlier, value, value * user_id AS load FROM events_flagged),
  st AS (SELECT count(*)::DOUBLE n, avg(value) ma, avg(load) mb, stddev_pop(value) sa, stddev_pop(load) sb, corr(value, load) r FROM p),
  sc AS (SELECT event_id, is_outlier, ((value - ma) / sa + (load - mb) / sb) / sqrt(2) AS pc1, abs(((value - ma) / sa - (load - mb) / sb) / sqrt(2)) AS pc2_size,
    ((value - ma) / sa - (load - mb) / sb) / sqrt(2) AS pc2 FROM p, st)"""


@check(
    "principal_components",
    f"""WITH {PAIR_SQL} SELECT 1 AS component, round((1 + r) * n / (n - 1), 6) AS eigenvalue, round(50 * (1 + r), 6) AS explained,
      round(50 * (1 + r), 6) AS cumulative, (1 + r) * n / (n - 1) > 1 AS kaiser, true AS recommended FROM st
    UNION ALL SELECT 2, round((1 - r) * n / (n - 1), 6), round(50 * (1 - r), 6), 100.0, false, (1 + r) / 2 < 0.8 FROM st""",
)
def principal_components(spark, d):
    fitted = rd.fit_components(loads(spark, d), ["value", "load"])
    return rounded(fitted.table(spark), "eigenvalue", "explained", "cumulative")


@check(
    "component_scores",
    f"WITH {PAIR_SQL} SELECT event_id, round(pc1, 5) AS pc1, round(pc2_size, 5) AS pc2_size FROM sc",
)
def component_scores(spark, d):
    df = loads(spark, d)
    scores = rd.fit_components(df, ["value", "load"]).scores(df, ["event_id"], 2)
    return scores.select("event_id", r("pc1", 5).alias("pc1"), r(F.abs("pc2"), 5).alias("pc2_size"))


@check("component_loadings")
def component_loadings(spark, d):
    df = loads(spark, d)
    return rounded(rd.fit_components(df, ["value", "load", "user_id"]).loading_table(spark), "loading", "abs_loading")


@check(
    "component_choice",
    f"""WITH {PAIR_SQL} SELECT 1 AS kaiser, CASE WHEN (1 + r) / 2 >= 0.8 THEN 1 ELSE 2 END AS n80,
      CASE WHEN (1 + r) / 2 >= 0.9 THEN 1 ELSE 2 END AS n90, CASE WHEN (1 + r) / 2 >= 0.8 THEN 1 ELSE 2 END AS recommended FROM st""",
)
def component_choice(spark, d):
    return rd.fit_components(loads(spark, d), ["value", "load"]).choice(spark)


@check(
    "group_separation",
    f"""WITH {PAIR_SQL}, g AS (SELECT is_outlier o, count(*)::DOUBLE n, avg(pc1) m1, avg(pc2) m2, var_samp(pc1) v1, var_samp(pc2) v2, covar_samp(pc1, pc2) c FROM sc GROUP BY 1),
    w AS (SELECT a.n AS n1, b.n AS n0, a.m1 - b.m1 AS d1, a.m2 - b.m2 AS d2, ((a.n - 1) * a.v1 + (b.n - 1) * b.v1) / (a.n + b.n - 2) AS v1,
      ((a.n - 1) * a.v2 + (b.n - 1) * b.v2) / (a.n + b.n - 2) AS v2, ((a.n - 1) * a.c + (b.n - 1) * b.c) / (a.n + b.n - 2) AS c
      FROM g a, g b WHERE a.o AND NOT b.o),
    x AS (SELECT *, sqrt((d1 * d1 * v2 - 2 * d1 * d2 * c + d2 * d2 * v1) / (v1 * v2 - c * c)) AS mh FROM w)
    SELECT n1::BIGINT AS outliers, n0::BIGINT AS normals, round(sqrt(d1 * d1 + d2 * d2), 5) AS distance, round(mh, 5) AS mahalanobis,
      CASE WHEN mh > 3 THEN 'high' WHEN mh > 1.5 THEN 'moderate' ELSE 'low' END AS separation FROM x""",
)
def group_separation(spark, d):
    found = rd.group_separation(loads(spark, d), ["value", "load"])
    return rounded(
        found.select("outliers", "normals", "distance", "mahalanobis", "separation"), "distance", "mahalanobis", digits=5
    )


# ---------------------------------------------------------------- classifiers


@check(
    "encoded_text",
    """SELECT o_orderkey, (dense_rank() OVER (ORDER BY o_orderpriority) - 1)::DOUBLE AS o_orderpriority,
      (dense_rank() OVER (ORDER BY o_orderstatus) - 1)::DOUBLE AS o_orderstatus, o_totalprice FROM orders""",
)
def encoded_text(spark, d):
    return c.encode(table(spark, d, "orders"), ["o_orderpriority", "o_orderstatus", "o_totalprice"], ["o_orderkey"])


@check(
    "stratified_split",
    "SELECT o_orderstatus, count(*) AS n, round(count(*) * 0.2)::BIGINT AS n_test FROM orders GROUP BY 1",
)
def stratified_split(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    split = c.stratified_split(orders, "o_orderstatus", "o_orderkey")
    return split.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.count_if("is_test").alias("n_test"))


# Scores given by the data: is a purchase told by the value (rounded, so scores tie)?
SCORED_SQL = "s AS (SELECT (event_type = 'purchase')::INT AS label, round(value) / 500 AS score FROM events)"


def scored(spark, d):
    return table(spark, d, "events").select(
        (F.col("event_type") == "purchase").cast("int").alias("label"), (F.round("value") / 500).alias("score")
    )


@check(
    "roc_curve",
    f"""WITH {SCORED_SQL}, t AS (SELECT score, sum(label) p, count(*) - sum(label) n FROM s GROUP BY 1),
    cum AS (SELECT score, sum(p) OVER (ORDER BY score DESC) tp, sum(n) OVER (ORDER BY score DESC) fp FROM t)
    SELECT score AS threshold, tp::BIGINT AS tp, fp::BIGINT AS fp, round(tp::DOUBLE / (SELECT sum(p) FROM t), 6) AS tpr,
      round(fp::DOUBLE / (SELECT sum(n) FROM t), 6) AS fpr FROM cum UNION ALL SELECT 1.0, 0, 0, 0.0, 0.0""",
)
def roc_curve(spark, d):
    return rounded(c.roc_curve(scored(spark, d)), "tpr", "fpr")


@check(
    "classification_metrics",
    f"""WITH {SCORED_SQL}, r AS (SELECT label, avg(rn) OVER (PARTITION BY score) AS rk FROM (SELECT label, score, row_number() OVER (ORDER BY score) rn FROM s)),
    a AS (SELECT (sum(rk) FILTER (label = 1) - sum(label) * (sum(label) + 1) / 2.0)::DOUBLE / (sum(label) * (count(*) - sum(label))) AS auc FROM r),
    k AS (SELECT count(*) FILTER (label = 1 AND score > 0.1)::DOUBLE tp, count(*) FILTER (label = 0 AND score > 0.1)::DOUBLE fp,
      count(*) FILTER (label = 0 AND score <= 0.1)::DOUBLE tn, count(*) FILTER (label = 1 AND score <= 0.1)::DOUBLE fn FROM s)
    SELECT round(auc, 6) AS auc, tp::BIGINT AS tp, fp::BIGINT AS fp, tn::BIGINT AS tn, fn::BIGINT AS fn, round((tp + tn) / (tp + fp + tn + fn), 6) AS accuracy,
      round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(tn / (tn + fp), 6) AS specificity,
      round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM a, k""",
)
def classification_metrics(spark, d):
    return rounded(
        c.classification_metrics(scored(spark, d), threshold=0.1), "auc", "accuracy", "precision", "recall", "specificity", "f1"
    )


FEATURES = ["user_id", "slot", "load"]
_F = " UNION ALL ".join(
    f"""SELECT '{v}' AS variable, (sum(n * (m - g) * (m - g)) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*))) AS f, sum(n) - count(*) AS d2
    FROM (SELECT is_outlier, count(*)::DOUBLE n, avg({v}) m, var_pop({v}) v, (SELECT avg({v}) FROM ft) g FROM ft GROUP BY 1)"""
    for v in FEATURES
)
_MI = " UNION ALL ".join(
    f"""SELECT '{v}' AS variable, sum(c / n * ln(c * n / (nb * nl))) AS mi FROM (SELECT c, sum(c) OVER () n, sum(c) OVER (PARTITION BY b) nb, sum(c) OVER (PARTITION BY l) nl
    FROM (SELECT is_outlier l, len(list_filter(list_distinct(q), lambda e: x > e)) AS b, count(*)::DOUBLE c
      FROM (SELECT is_outlier, {v}::DOUBLE AS x FROM ft), (SELECT quantile_cont({v}::DOUBLE, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) q FROM ft) GROUP BY 1, 2))"""
    for v in FEATURES
)


@check(
    "feature_ranking",
    f"""WITH {EVENTS_SQL}, ft AS (SELECT is_outlier, user_id, slot, value * user_id AS load FROM events_flagged), f AS ({_F}), mi AS ({_MI}),
    j AS (SELECT variable, f, d2, greatest(mi, 0) AS mi, (f / max(f) OVER () + mi / max(mi) OVER ()) / 2 AS importance FROM f JOIN mi USING (variable))
    SELECT variable, round(f, 4) AS f, round({f_sf('f', '1', 'd2')}, 5) AS f_p_value, round(mi, 6) AS mutual_information, round(importance, 6) AS importance,
      row_number() OVER (ORDER BY importance DESC, variable)::INT AS position FROM j""",
)
def feature_ranking(spark, d):
    ranking = c.rank_features(loads(spark, d), FEATURES)
    return rounded(rounded(rounded(ranking, "f", digits=4), "f_p_value", digits=5), "mutual_information", "importance")


def psi(n):
    """Digamma of whole numbers from 1, in SQL."""
    back = " - ".join(f"1.0::DOUBLE / ({n} + {i})" for i in range(8))
    z = f"({n} + 8)::DOUBLE"
    return f"(ln({z}) - 1 / (2 * {z}) - 1 / (12 * {z} ** 2) + 1 / (120 * {z} ** 4) - 1 / (252 * {z} ** 6) - {back})"


_STEPS = ", ".join(f"x - lag(x, {i}) OVER w, lead(x, {i}) OVER w - x" for i in (1, 2, 3))


def _neighbours_sql(v):
    """Estimate from the third neighbour in the class: every row's radius, then a count of all rows inside it."""
    return f"""SELECT '{v}' AS variable, greatest(any_value({psi('nn')}) + sum(c * ({psi('k')} - {psi('m')} - {psi('nl')})) / sum(c), 0) AS mi FROM (
      WITH t AS (SELECT is_outlier AS l, {v}::DOUBLE AS x FROM ft), vals AS (SELECT x AS v, count(*) AS t FROM t GROUP BY 1),
      rad AS (SELECT l, x, list_sort(list_filter([{_STEPS}], lambda d: d IS NOT NULL))[3] AS r FROM t WINDOW w AS (PARTITION BY l ORDER BY x)),
      pts AS (SELECT l, x, r, count(*) AS c FROM rad GROUP BY ALL),
      lim AS (SELECT *, x - r + (abs(x) + r) * 1e-12::DOUBLE AS lo, x + r - (abs(x) + r) * 1e-12::DOUBLE AS hi FROM pts),
      m AS (SELECT l, x, c, 3 AS k, sum(t)::BIGINT AS m FROM lim JOIN vals ON v > lo AND v < hi WHERE r > 0 GROUP BY l, x, c
        UNION ALL SELECT l, x, c, c - 1, (t - 1)::BIGINT FROM lim JOIN vals ON v = x WHERE r = 0)
      SELECT m.*, (SELECT count(*) FROM t) AS nn, (SELECT count(*) FROM t WHERE t.l = m.l) AS nl FROM m)"""


_KNN = " UNION ALL ".join(_neighbours_sql(v) for v in FEATURES)


@check(
    "feature_ranking_neighbours",
    f"""WITH {EVENTS_SQL}, ft AS (SELECT is_outlier, user_id, slot, value * user_id AS load FROM events_flagged), f AS ({_F}), mi AS ({_KNN}),
    j AS (SELECT variable, f, d2, mi, (f / max(f) OVER () + CASE WHEN max(mi) OVER () > 0 THEN mi / max(mi) OVER () ELSE 0 END) / 2 AS importance
      FROM f JOIN mi USING (variable))
    SELECT variable, round(f, 4) AS f, round({f_sf('f', '1', 'd2')}, 5) AS f_p_value, round(mi, 6) AS mutual_information, round(importance, 6) AS importance,
      row_number() OVER (ORDER BY importance DESC, variable)::INT AS position FROM j""",
)
def feature_ranking_neighbours(spark, d):
    ranking = c.rank_features(loads(spark, d), FEATURES, neighbours=3)
    return rounded(rounded(rounded(ranking, "f", digits=4), "f_p_value", digits=5), "mutual_information", "importance")


def marked_orders(spark, d):
    """Orders on the dear side, told by customer, status and month (noise on purpose)."""
    orders = table(spark, d, "orders")
    cut = orders.agg(F.avg("o_totalprice") + F.stddev_samp("o_totalprice")).first()[0]
    return orders.select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", F.month("o_orderdate").alias("month"),
        (F.col("o_totalprice") * (1 + F.col("o_custkey") / 3000)).alias("adjusted"),
        (F.col("o_totalprice") > cut).alias("is_outlier"),
    )


PREDICTORS = ["o_custkey", "month", "adjusted", "o_orderstatus", "o_orderpriority"]


@check("logistic_metrics")
def logistic_metrics(spark, d):
    return c.logistic_characterisation(marked_orders(spark, d), PREDICTORS, "o_orderkey")["metrics"]


@check("logistic_wald")
def logistic_wald(spark, d):
    return c.logistic_characterisation(marked_orders(spark, d), PREDICTORS, "o_orderkey")["wald"]


@check("random_forest_metrics")
def random_forest_metrics(spark, d):
    return c.random_forest(marked_orders(spark, d), PREDICTORS, "o_orderkey")["metrics"]


@check("random_forest_importance")
def random_forest_importance(spark, d):
    return c.random_forest(marked_orders(spark, d), PREDICTORS, "o_orderkey")["importance"]
