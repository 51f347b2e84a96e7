"""Clusters among outliers."""

from pyspark.sql import functions as F

from fenceline.functions.columns import MIX
from fenceline.operators import cluster as k
from fenceline.operators import linkage
from fenceline.operators import univariate as u

from .registry import check, r, rounded, table

COLUMNS = ["value", "user_id"]


def outliers(spark, d):
    """The outlier rows of events by the usual fences."""
    events = table(spark, d, "events")
    limits = u.fit_iqr(events, ["value"], 1.5)["value"]
    return limits.rows(events, "value").select("event_id", "value", F.col("user_id").cast("double").alias("user_id"))


@check(
    "clustering_input",
    """WITH q AS (SELECT quantile_cont(value, 0.25) q1, quantile_cont(value, 0.75) q3 FROM events),
    o AS (SELECT event_id, value, user_id FROM events, q WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1))
    SELECT event_id, round((value - (SELECT avg(value) FROM o)) / (SELECT stddev_pop(value) FROM o), 6) AS value,
      round((user_id - (SELECT avg(user_id) FROM o)) / (SELECT stddev_pop(user_id) FROM o), 6) AS user_id FROM o""",
)
def clustering_input(spark, d):
    return rounded(k.prepare(outliers(spark, d), COLUMNS, "event_id"), *COLUMNS)


@check("choose_k")
def choose_k(spark, d):
    return k.choose_k(k.evaluate_k(k.prepare(outliers(spark, d), COLUMNS, "event_id"), COLUMNS))


@check("k_criteria")
def k_criteria(spark, d):
    return k.evaluate_k(k.prepare(outliers(spark, d), COLUMNS, "event_id"), COLUMNS)


@check("k_by_inertia_drop")
def k_by_inertia_drop(spark, d):
    evaluated = k.evaluate_k(k.prepare(outliers(spark, d), COLUMNS, "event_id"), COLUMNS)
    return spark.createDataFrame([(k.k_by_inertia_drop(evaluated),)], "k int")


@check("kmeans_clusters")
def kmeans_clusters(spark, d):
    data = k.prepare(outliers(spark, d), COLUMNS, "event_id")
    return k.kmeans_clusters(data, COLUMNS, "event_id", 4)["clusters"]


# With the labels given by the data (event type), the quality sums are plain SQL.
@check(
    "cluster_quality",
    """WITH e AS (SELECT event_type t, value / 100 AS a, user_id / 100 AS b FROM events),
    c AS (SELECT t, count(*)::DOUBLE n, avg(a) ca, avg(b) cb FROM e GROUP BY 1),
    j AS (SELECT e.*, ca, cb, (a - ca) * (a - ca) + (b - cb) * (b - cb) AS sq FROM e JOIN c USING (t)),
    s AS (SELECT t, sum(sq) ss, avg(sqrt(sq)) md FROM j GROUP BY 1), o AS (SELECT avg(a) ga, avg(b) gb, count(*)::DOUBLE n FROM e),
    b AS (SELECT sum(c.n * ((ca - ga) * (ca - ga) + (cb - gb) * (cb - gb))) bt FROM c, o),
    db AS (SELECT x.t, max((sx.md + sy.md) / sqrt(pow(x.ca - y.ca, 2) + pow(x.cb - y.cb, 2))) m FROM c x JOIN c y ON x.t <> y.t
      JOIN s sx ON sx.t = x.t JOIN s sy ON sy.t = y.t GROUP BY 1)
    SELECT round((SELECT sum(ss) FROM s), 4) AS wss, round(bt / ((SELECT count(*) FROM c) - 1) / ((SELECT sum(ss) FROM s) / (n - (SELECT count(*) FROM c))), 4) AS calinski_harabasz,
      round((SELECT avg(m) FROM db), 4) AS davies_bouldin FROM b, o""",
)
def cluster_quality(spark, d):
    events = table(spark, d, "events").select(
        "event_type", (F.col("value") / 100).alias("a"), (F.col("user_id") / 100).alias("b")
    )
    quality = k.cluster_quality(events, ["a", "b"], "event_type")
    return rounded(
        spark.createDataFrame([tuple(quality.values())], "wss double, calinski_harabasz double, davies_bouldin double"),
        "wss", "calinski_harabasz", "davies_bouldin", digits=4,
    )


@check("hierarchical_groups")
def hierarchical_groups(spark, d):
    data = k.prepare(outliers(spark, d), COLUMNS, "event_id")
    return k.hierarchical_groups(data, COLUMNS, "event_id", 4)["clusters"]


def uniform_sql(row, seed, axis):
    """The library's numbered draws."""
    start = (seed * 40503 + axis * 2654435761) & ((1 << 32) - 1)
    h = f"(({row} & 4294967295) + ({row} >> 32) * 97 + {start}) & 4294967295"
    for _ in range(2):
        h = f"(xor({h}, ({h}) >> 16) * {MIX}) & 4294967295"
    return f"(xor({h}, ({h}) >> 16) / 4294967296.0)"


HOPKINS_SQL = f"""WITH q AS (SELECT quantile_cont(value, 0.25) q1, quantile_cont(value, 0.75) q3 FROM events),
  o AS (SELECT event_id, value, user_id::DOUBLE AS u FROM events, q WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)),
  f AS (SELECT avg(value) vm, stddev_pop(value) vs, avg(u) um, stddev_pop(u) us FROM o),
  p AS (SELECT event_id, (value - vm) / vs AS x, (u - um) / us AS y FROM o, f),
  s AS (SELECT min(x) x0, max(x) - min(x) xs, min(y) y0, max(y) - min(y) ys, count(*) n FROM p),
  w AS (SELECT a.event_id, min(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) AS d FROM p a JOIN p b ON a.event_id <> b.event_id GROUP BY 1),
  r AS (SELECT i, x0 + {uniform_sql('i', 42, 0)} * xs AS x, y0 + {uniform_sql('i', 42, 1)} * ys AS y FROM s, (SELECT unnest(range(0, (SELECT n FROM s))) AS i)),
  z AS (SELECT i, min(sqrt((r.x - p.x) ** 2 + (r.y - p.y) ** 2)) AS d FROM r, p GROUP BY 1),
  h AS (SELECT (SELECT n FROM s) AS n, (SELECT sum(d) FROM z) AS drawn, (SELECT sum(d) FROM w) AS own)
  SELECT n, round(drawn / (drawn + own), 6) AS hopkins, CASE WHEN drawn / (drawn + own) > 0.7 THEN 'strong' WHEN drawn / (drawn + own) > 0.5 THEN 'moderate' ELSE 'weak' END AS tendency FROM h"""


@check("clustering_tendency", HOPKINS_SQL)
def clustering_tendency(spark, d):
    return rounded(k.clustering_tendency(k.prepare(outliers(spark, d), COLUMNS, "event_id"), COLUMNS), "hopkins")


@check("outlier_subtypes")
def outlier_subtypes(spark, d):
    return k.outlier_subtypes(outliers(spark, d), COLUMNS, "event_id", restarts=3)["clusters"]


def dbscan_sql(points, key, eps, least):
    """All near pairs, then a walk along core rows."""
    return f"""WITH RECURSIVE p AS ({points}),
  nb AS (SELECT a.id AS i, b.id AS j, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM p a JOIN p b
    ON abs(a.x - b.x) <= {eps} AND abs(a.y - b.y) <= {eps}),
  near AS (SELECT * FROM nb WHERE d <= {eps}), core AS (SELECT i AS id FROM near GROUP BY 1 HAVING count(*) >= {least}),
  walk AS (SELECT id, id AS root FROM core UNION SELECT near.j, walk.root FROM walk JOIN near ON near.i = walk.id JOIN core ON core.id = near.j),
  lab AS (SELECT id, min(root) AS root FROM walk GROUP BY 1),
  num AS (SELECT root, row_number() OVER (ORDER BY root) - 1 AS cluster FROM (SELECT DISTINCT root FROM lab)),
  cc AS (SELECT id, cluster FROM lab JOIN num USING (root)),
  bord AS (SELECT near.i AS id, cluster, row_number() OVER (PARTITION BY near.i ORDER BY d, cluster) AS rn FROM near JOIN cc ON cc.id = near.j
    WHERE near.i NOT IN (SELECT id FROM core))
  SELECT p.id AS {key}, coalesce(cc.cluster, bord.cluster, -1)::BIGINT AS cluster, p.id IN (SELECT id FROM core) AS is_core
  FROM p LEFT JOIN cc ON cc.id = p.id LEFT JOIN bord ON bord.id = p.id AND rn = 1"""


# Customers at their balance and nation: many small dense groups, borders and noise.
DBSCAN_SQL = dbscan_sql("SELECT c_custkey AS id, c_acctbal / 400 AS x, c_nationkey * 0.9 AS y FROM customer", "c_custkey", 0.5, 4)


@check("dbscan", DBSCAN_SQL)
def dbscan(spark, d):
    customers = table(spark, d, "customer").select(
        "c_custkey", (F.col("c_acctbal") / 400).alias("x"), (F.col("c_nationkey") * 0.9).alias("y")
    )
    return k.dbscan(customers, ["x", "y"], "c_custkey", 0.5, 4, leaf_rows=128)


@check("dbscan_events", dbscan_sql("SELECT event_id AS id, value AS x, user_id * 2.0 AS y FROM events", "event_id", 2.0, 3))
def dbscan_events(spark, d):
    events = table(spark, d, "events").select("event_id", F.col("value").alias("x"), (F.col("user_id") * 2.0).alias("y"))
    return k.dbscan(events, ["x", "y"], "event_id", 2.0, 3, leaf_rows=256)


# The spanning tree by Prim's rule; the groups are what hangs together without its longest edges.
LINKAGE_SQL = """WITH RECURSIVE p AS (SELECT s_suppkey AS id, s_acctbal AS x, s_nationkey * 200.0 AS y FROM supplier),
  e AS (SELECT a.id AS i, b.id AS j, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM p a JOIN p b ON a.id <> b.id),
  t AS (SELECT [min(id)] AS seen, NULL::BIGINT AS i, NULL::BIGINT AS j, NULL::DOUBLE AS d FROM p UNION ALL
    SELECT list_append(seen, j), i, j, d FROM (SELECT t.seen, e.i, e.j, e.d FROM t JOIN e ON list_contains(t.seen, e.i) AND NOT list_contains(t.seen, e.j) ORDER BY e.d LIMIT 1)),
  k AS (SELECT i, j FROM t WHERE j IS NOT NULL ORDER BY d DESC OFFSET 3),
  both_ways AS (SELECT i, j FROM k UNION SELECT j, i FROM k),
  walk AS (SELECT id, id AS root FROM p UNION SELECT b.j, walk.root FROM walk JOIN both_ways b ON b.i = walk.id),
  lab AS (SELECT id, min(root) AS root FROM walk GROUP BY 1)"""


def suppliers(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", "s_acctbal", (F.col("s_nationkey") * 200.0).alias("place"))


@check("single_linkage_heights", f"{LINKAGE_SQL} SELECT round(d, 6) AS height FROM t WHERE d > 0")
def single_linkage_heights(spark, d):
    return rounded(linkage.single_linkage(suppliers(spark, d), ["s_acctbal", "place"], "s_suppkey", 4)["merges"], "height")


@check("single_linkage_groups", f"{LINKAGE_SQL} SELECT id AS s_suppkey, (dense_rank() OVER (ORDER BY root) - 1)::INT AS cluster FROM lab")
def single_linkage_groups(spark, d):
    return linkage.single_linkage(suppliers(spark, d), ["s_acctbal", "place"], "s_suppkey", 4)["labels"]
