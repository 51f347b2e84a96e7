from pyspark.sql import functions as F

from fenceline.operators import univariate as u

from .registry import check, r, table

LINE = ["l_quantity", "l_extendedprice", "l_discount"]


@check(
    "iqr_flags",
    """
    WITH q AS (SELECT quantile_cont(value, 0.25) q1, quantile_cont(value, 0.75) q3, count(*) n FROM events),
    f AS (SELECT q1, q3, q3 - q1 AS iqr, 1.5 AS k FROM q)
    SELECT event_id, value, (iqr <> 0 AND (value < q1 - k * iqr OR value > q3 + k * iqr)) AS is_outlier
    FROM events, f
    """,
)
def iqr_flags(spark, d):
    events = table(spark, d, "events")
    limits = u.fit_iqr(events, ["value"])["value"]
    return events.select("event_id", "value", limits.flag("value").alias("is_outlier"))


@check(
    "group_iqr_summary",
    """
    WITH q AS (SELECT event_type, quantile_cont(value, 0.25) q1, quantile_cont(value, 0.75) q3, count(*) n
               FROM events GROUP BY 1),
    f AS (SELECT *, 1.5 AS k FROM q),
    m AS (SELECT e.event_type, (value < q1 - k * (q3 - q1) OR value > q3 + k * (q3 - q1)) AS o
          FROM events e JOIN f USING (event_type))
    SELECT event_type, count(*)::BIGINT AS n, sum(o::INT)::BIGINT AS outliers,
           round(100.0 * sum(o::INT)::DOUBLE / count(*), 4) AS pct
    FROM m GROUP BY 1
    """,
)
def group_iqr_summary(spark, d):
    events = table(spark, d, "events")
    flagged = u.group_iqr_flags(events, ["event_type"], "value")
    return flagged.groupBy("event_type").agg(
        F.count("*").alias("n"),
        F.count_if("is_outlier").alias("outliers"),
        r(100.0 * F.count_if("is_outlier") / F.count("*"), 4).alias("pct"),
    )


@check(
    "group_fences_size_rule",
    """
    WITH q AS (SELECT s_nationkey, quantile_cont(s_acctbal, 0.25) q1, quantile_cont(s_acctbal, 0.75) q3, count(*) n FROM supplier GROUP BY 1
      UNION ALL SELECT 100, quantile_cont(s_acctbal, 0.25), quantile_cont(s_acctbal, 0.75), count(*) FROM supplier
      UNION ALL SELECT 101, quantile_cont(c_acctbal, 0.25), quantile_cont(c_acctbal, 0.75), count(*) FROM customer),
    f AS (SELECT *, CASE WHEN n < 100 THEN 3.0 WHEN n < 1000 THEN 2.0 ELSE 1.5 END AS k FROM q)
    SELECT s_nationkey AS place, 'balance' AS variable, n::BIGINT AS n, round(CASE WHEN q3 <> q1 THEN q1 - k * (q3 - q1) END, 6) AS low,
      round(CASE WHEN q3 <> q1 THEN q3 + k * (q3 - q1) END, 6) AS high FROM f
    """,
)
def group_fences_size_rule(spark, d):
    supplier, customer = table(spark, d, "supplier"), table(spark, d, "customer")
    rows = supplier.select(F.explode(F.array(F.col("s_nationkey").cast("long"), F.lit(100).cast("long"))).alias("place"), F.col("s_acctbal").alias("balance"))
    rows = rows.unionAll(customer.select(F.lit(101).cast("long"), "c_acctbal"))
    fences = u.group_fences(rows, ["place"], ["balance"], size_rule=True)
    return fences.select("place", "variable", "n", r("low").alias("low"), r("high").alias("high"))


@check(
    "zscore_flags",
    """
    WITH s AS (SELECT avg(value) m, stddev_samp(value) sd FROM events)
    SELECT event_id, round(abs(value - m) / sd, 6) AS z, abs(value - m) / sd > 3 AS is_outlier FROM events, s
    """,
)
def zscore_flags(spark, d):
    events = table(spark, d, "events")
    fit = u.fit_zscore(events, ["value"])["value"]
    return events.select("event_id", r(fit.score("value")).alias("z"), fit.flag("value").alias("is_outlier"))


@check(
    "mad_flags",
    """
    WITH m AS (SELECT median(value) med FROM events),
    d AS (SELECT 1.4826 * median(abs(value - med)) s FROM events, m)
    SELECT event_id, round(abs(value - med) / s, 6) AS score, abs(value - med) / s > 3 AS is_outlier
    FROM events, m, d
    """,
)
def mad_flags(spark, d):
    events = table(spark, d, "events")
    fit = u.fit_mad(events, ["value"])["value"]
    return events.select("event_id", r(fit.score("value")).alias("score"), fit.flag("value").alias("is_outlier"))
