"""Survival until a user's next event; the event is that it is a purchase."""

from pyspark.sql import Window, functions as F

from fenceline.operators import survival as s
from fenceline.operators import univariate as u

from .registry import check, r, rounded, table
from .sqlmath import chi2_sf, norm_two_sided

PAIRS_SQL = """q AS (SELECT quantile_cont(value, 0.25) q1, quantile_cont(value, 0.75) q3 FROM events),
  nx AS (SELECT user_id, value, epoch_us(lead(ts) OVER w) - epoch_us(ts) AS gap, lead(event_type) OVER w AS next_type
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
  pairs AS (SELECT (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS is_outlier, ceil(gap / 3600000000.0) AS time,
    (next_type = 'purchase')::INT AS event FROM nx, q WHERE gap > 0),
  n AS (SELECT is_outlier, count(*) AS total FROM pairs GROUP BY 1),
  t AS (SELECT is_outlier, time, count(*) AS c, sum(event) AS d FROM pairs GROUP BY 1, 2),
  risk AS (SELECT is_outlier, time, d, total - coalesce(sum(c) OVER (PARTITION BY is_outlier ORDER BY time
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at_risk FROM t JOIN n USING (is_outlier)),
  km AS (SELECT is_outlier, time, at_risk, d, product(1 - d / at_risk) OVER (PARTITION BY is_outlier ORDER BY time) AS survival FROM risk)"""


def pairs(spark, d):
    events = table(spark, d, "events")
    limits = u.fit_iqr(events, ["value"], 1.5)["value"]
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    gaps = events.select(
        limits.flag("value").alias("is_outlier"), (F.lead(micros).over(w) - micros).alias("gap"),
        F.lead("event_type").over(w).alias("next_type"),
    ).where("gap > 0")
    prepared = gaps.select(
        "is_outlier", F.ceil(F.col("gap") / 3600000000.0).cast("double").alias("hours"),
        F.when(F.col("next_type") == "purchase", "purchase").otherwise("other").alias("outcome"),
    )
    return s.survival_pairs(prepared, "hours", "outcome", event_value="purchase")


@check("survival_pairs", f"WITH {PAIRS_SQL} SELECT is_outlier, time::DOUBLE AS time, event::BIGINT AS event FROM pairs")
def survival_pairs(spark, d):
    return pairs(spark, d)


@check(
    "kaplan_meier",
    f"""WITH {PAIRS_SQL} SELECT is_outlier, time::DOUBLE AS time, at_risk::BIGINT AS at_risk, d::BIGINT AS events, round(survival, 6) AS survival FROM km
    UNION ALL SELECT is_outlier, 0.0, total, 0, 1.0 FROM n""",
)
def kaplan_meier(spark, d):
    return rounded(s.kaplan_meier(pairs(spark, d)), "survival")


@check(
    "median_survival",
    f"WITH {PAIRS_SQL} SELECT is_outlier, (min(time) FILTER (survival <= 0.5))::DOUBLE AS median_survival FROM km GROUP BY 1",
)
def median_survival(spark, d):
    return s.median_survival(s.kaplan_meier(pairs(spark, d)))


@check(
    "log_rank",
    f"""WITH {PAIRS_SQL}, times AS (SELECT DISTINCT time FROM pairs WHERE event = 1),
    e AS (SELECT time, sum(CASE WHEN p.time = t.time AND event = 1 AND is_outlier THEN 1 ELSE 0 END)::DOUBLE d1,
      sum(CASE WHEN p.time = t.time AND event = 1 THEN 1 ELSE 0 END)::DOUBLE d, sum(is_outlier::INT)::DOUBLE n1, count(*)::DOUBLE n
      FROM (SELECT time AS tt FROM times) q, LATERAL (SELECT q.tt AS time) t, pairs p WHERE p.time >= q.tt GROUP BY ALL),
    s AS (SELECT sum(d1) o, sum(d * n1 / n) e, sum(CASE WHEN n > 1 THEN d * (n1 / n) * (1 - n1 / n) * (n - d) / (n - 1) ELSE 0 END) v FROM e)
    SELECT o::BIGINT AS observed, round(e, 5) AS expected, round(v, 5) AS variance, round((o - e) * (o - e) / v, 5) AS chi2,
      round({chi2_sf('(o - e) * (o - e) / v', '1')}, 5) AS p_value FROM s""".replace(
        "e AS (SELECT time, sum", "e AS (SELECT t.time, sum"
    ),
)
def log_rank(spark, d):
    return rounded(s.log_rank(pairs(spark, d)), "expected", "variance", "chi2", "p_value", digits=5)


NEWTON_STEPS = 10


def cox_sql():
    """Newton's method in so many steps over the risk table, Efron's share of every tied event written out."""
    hazard = "(n1 * exp(beta) - j / d * d1 * exp(beta)) / (n0 + n1 * exp(beta) - j / d * (d0 + d1 * exp(beta)))"
    sums = f"sum(d1 / d) - sum({hazard}) AS score, sum({hazard}) - sum(({hazard}) ** 2) AS info"
    steps = ["b0 AS (SELECT 0.0::DOUBLE AS beta)"] + [
        f"b{i} AS (SELECT beta + score / info AS beta FROM (SELECT beta, {sums} FROM tied, b{i - 1} GROUP BY beta))" for i in range(1, NEWTON_STEPS + 1)
    ]
    return f"""WITH {PAIRS_SQL},
    times AS (SELECT time, sum((is_outlier AND event = 1)::INT)::DOUBLE AS d1, sum((NOT is_outlier AND event = 1)::INT)::DOUBLE AS d0,
      sum(is_outlier::INT)::DOUBLE AS c1, sum((NOT is_outlier)::INT)::DOUBLE AS c0 FROM pairs GROUP BY time),
    rt AS (SELECT d1, d0, d1 + d0 AS d, sum(c1) OVER w AS n1, sum(c0) OVER w AS n0 FROM times WINDOW w AS (ORDER BY time DESC)),
    tied AS (SELECT *, unnest(range(0, d::BIGINT))::DOUBLE AS j FROM rt WHERE d > 0), {", ".join(steps)},
    e AS (SELECT beta, 1 / sqrt(info) AS se FROM (SELECT beta, {sums} FROM tied, b{NEWTON_STEPS} GROUP BY beta))
    SELECT round(beta, 6) AS coef, round(se, 6) AS se, round(exp(beta), 6) AS hazard_ratio, round(exp(beta - 1.959963984540054 * se), 6) AS ci_low,
      round(exp(beta + 1.959963984540054 * se), 6) AS ci_high, round(beta / se, 6) AS z, round({norm_two_sided('beta / se')}, 6) AS p_value FROM e"""


@check("cox_outlier", cox_sql())
def cox_outlier(spark, d):
    return rounded(s.cox_outlier(pairs(spark, d)), "coef", "se", "hazard_ratio", "ci_low", "ci_high", "z", "p_value")
