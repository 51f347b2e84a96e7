"""Sources, sinks, filters and casts."""

from pyspark.sql import functions as F, types as T

from fenceline.operators import clean as c
from fenceline.operators import profile as p
from fenceline.sources import tables as t

from .registry import check, r, table

# Events with gaps: small values and one type count as missing.
GAPPY_SQL = (
    "(SELECT event_id, user_id, nullif(event_type, 'error') AS event_type, "
    "CASE WHEN value < 5 THEN NULL ELSE value END AS value FROM events)"
)


def gappy(spark, d):
    return table(spark, d, "events").select(
        "event_id", "user_id",
        F.nullif("event_type", F.lit("error")).alias("event_type"),
        F.when(F.col("value") >= 5, F.col("value")).alias("value"),
    )


@check("csv_round_trip", f"SELECT event_id, user_id, event_type, value FROM {GAPPY_SQL}")
def csv_round_trip(spark, d):
    path = t.scratch_path(spark, "events-csv")
    gappy(spark, d).write.option("header", True).csv(path)
    return t.read_csv(spark, path).select(
        F.col("event_id").cast("long"), F.col("user_id").cast("long"), "event_type", "value"
    )


NAMES_SQL = """SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'Zoë – € ' WHEN 1 THEN 'Zoë né ' ELSE 'Zoë – 日本 ' END || c_name AS c_name, c_acctbal FROM customer"""


@check("csv_encodings", NAMES_SQL)
def csv_encodings(spark, d):
    """Files in code page 1252, in ISO 8859-1 and in UTF-8 under one folder."""
    path = t.scratch_path(spark, "customers-csv")
    for rest, start, charset in ((0, "Zoë \x96 \x80 ", "ISO-8859-1"), (1, "Zoë né ", "ISO-8859-1"), (2, "Zoë – 日本 ", "UTF-8")):
        own = table(spark, d, "customer").where(F.col("c_custkey") % 3 == rest)
        own = own.select("c_custkey", F.concat(F.lit(start), "c_name").alias("c_name"), "c_acctbal")
        own.write.mode("append").options(header=True, encoding=charset).csv(path)
    found = t.read_csv(spark, path, encoding="auto")
    return found.select(F.col("c_custkey").cast("long"), "c_name", F.col("c_acctbal").cast("double"))


@check("parquet_read", "SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders")
def parquet_read(spark, d):
    df = t.read_parquet(spark, f"{d}/orders.parquet", ["o_orderkey", "o_totalprice", "o_orderpriority"])
    return t.require_rows(df)


@check(
    "write_lineage",
    f"""SELECT 'events' AS source, 'missing:drop' AS steps, (SELECT count(*) FROM events)::BIGINT AS rows_before,
        count(*)::BIGINT AS rows_after, ((SELECT count(*) FROM events) - count(*))::BIGINT AS rows_removed
        FROM {GAPPY_SQL} WHERE value IS NOT NULL AND event_type IS NOT NULL""",
)
def write_lineage(spark, d):
    before = gappy(spark, d)
    after = c.fill_missing(before, "drop")
    path = t.scratch_path(spark, "events-clean")
    return t.write_processed(after, path, "events", ["missing:drop"], before.count())


@check(
    "csv_rejected_lines",
    "SELECT event_id || ',' || user_id || ',x' AS line, 3::INTEGER AS fields, event_id FROM events WHERE event_id % 10 = 3",
)
def csv_rejected_lines(spark, d):
    path = t.scratch_path(spark, "events-broken")
    extra = F.when(F.col("event_id") % 10 == 3, F.lit(",x")).otherwise(F.lit(""))
    lines = table(spark, d, "events").select(F.concat(F.col("event_id"), F.lit(","), F.col("user_id"), extra).alias("value"))
    lines.write.text(path)
    schema = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("user_id", T.LongType())])
    _, rejected = t.read_csv_lines(spark, path, schema=schema, header=False)
    return rejected.select("line", "fields", "values.event_id")


@check(
    "preview_rows",
    f"""SELECT event_id::VARCHAR AS event_id, user_id::VARCHAR AS user_id, event_type, value::VARCHAR AS value
        FROM {GAPPY_SQL} ORDER BY event_id::BIGINT LIMIT 10""".replace("event_id::BIGINT", "try_cast(event_id AS BIGINT)"),
)
def preview_rows(spark, d):
    return t.preview(gappy(spark, d), "event_id")


@check("page_of_rows", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 100")
def page_of_rows(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return t.page(orders, "o_orderkey", 3, 50)


@check(
    "page_counts",
    "SELECT count(*)::BIGINT AS total_rows, 50::BIGINT AS page_size, ceil(count(*) / 50.0)::BIGINT AS total_pages FROM orders",
)
def page_counts(spark, d):
    return t.page_counts(table(spark, d, "orders"), 50)


@check(
    "next_page_of_rows",
    "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey > 149 ORDER BY o_orderkey LIMIT 50",
)
def next_page_of_rows(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return t.next_page(orders, "o_orderkey", 149, 50)


@check(
    "sample_table",
    f"""SELECT coalesce(printf('%.2f', value), 'N/A') AS value, coalesce(event_type, 'N/A') AS event_type,
        user_id::VARCHAR AS user_id FROM {GAPPY_SQL} ORDER BY event_id LIMIT 100""",
)
def sample_table(spark, d):
    return t.sample_table(gappy(spark, d), ["value", "event_type", "user_id"], "event_id", 100)


@check("variable_where", f"SELECT value FROM {GAPPY_SQL} WHERE event_type = 'click' AND value IS NOT NULL")
def variable_where(spark, d):
    return c.select_variable(gappy(spark, d), "value", "event_type", "click")


@check(
    "variable_overview",
    f"""SELECT 'event_type' AS variable, 'categorical' AS value_type, count(*)::BIGINT AS n,
        count(DISTINCT event_type)::BIGINT AS categories FROM {GAPPY_SQL} WHERE event_type IS NOT NULL
        UNION ALL SELECT 'value', 'numeric', count(*), NULL FROM {GAPPY_SQL} WHERE value IS NOT NULL""",
)
def variable_overview(spark, d):
    df = gappy(spark, d)
    return c.variable_overview(df, "event_type").unionByName(c.variable_overview(df, "value"))


@check(
    "group_filter",
    "SELECT event_id, value FROM events, (SELECT avg(value) m, stddev_samp(value) s FROM events) WHERE abs(value - m) / s > 3",
)
def group_filter(spark, d):
    from fenceline.operators.univariate import fit_zscore

    events = table(spark, d, "events").select("event_id", "value")
    marked = events.withColumn("is_outlier", fit_zscore(events, ["value"])["value"].flag("value"))
    return c.split_groups(marked)[0].drop("is_outlier")


@check(
    "complete_rows",
    f"SELECT event_id, event_type, value FROM {GAPPY_SQL} WHERE event_type IS NOT NULL AND value IS NOT NULL",
)
def complete_rows(spark, d):
    return c.complete_rows(gappy(spark, d), ["event_type", "value"]).drop("user_id")


@check(
    "cast_numeric",
    "SELECT p_partkey, TRY_CAST(regexp_replace(p_brand, '^Brand#', '') AS DOUBLE) AS brand_number, "
    "TRY_CAST(p_type AS DOUBLE) AS p_type FROM part",
)
def cast_numeric(spark, d):
    parts = table(spark, d, "part").select(
        "p_partkey", F.regexp_replace("p_brand", "^Brand#", "").alias("brand_number"), "p_type"
    )
    return c.convert(c.convert(parts, "brand_number", "numeric"), "p_type", "numeric")


@check("cast_categorical", "SELECT p_partkey, p_size::VARCHAR AS p_size FROM part")
def cast_categorical(spark, d):
    return c.convert(table(spark, d, "part").select("p_partkey", "p_size"), "p_size", "categorical")


@check(
    "cast_datetime",
    """SELECT o_orderkey, TRY_CAST(CASE WHEN o_orderstatus = 'P' THEN o_orderpriority
       ELSE strftime(o_orderdate, '%Y-%m-%d') END AS TIMESTAMP) AS moment FROM orders""",
)
def cast_datetime(spark, d):
    orders = table(spark, d, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "P", F.col("o_orderpriority"))
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("moment"),
    )
    return c.convert(orders, "moment", "datetime").withColumn("moment", F.col("moment").cast("timestamp_ntz"))


@check("cast_boolean", "SELECT l_orderkey, l_discount <> 0 AS l_discount, length(l_returnflag) > 0 AS l_returnflag FROM lineitem")
def cast_boolean(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_discount", "l_returnflag")
    return c.convert(c.convert(lines, "l_discount", "boolean"), "l_returnflag", "boolean")


@check(
    "cast_and_retype",
    """SELECT 'p_size' AS variable, CASE WHEN count(DISTINCT p_size) = 2 THEN 'binary' ELSE 'nominal' END AS kind,
       count(DISTINCT p_size)::BIGINT AS distinct_values, count(*)::BIGINT AS rows FROM part""",
)
def cast_and_retype(spark, d):
    return c.convert_and_retype(table(spark, d, "part"), "p_size", "categorical")[1]


@check(
    "chosen_kinds",
    """SELECT * FROM (VALUES ('l_quantity', 'ordinal'), ('l_linestatus', 'binary'), ('l_returnflag', 'nominal')) v(variable, kind)
       UNION ALL SELECT 'l_extendedprice', CASE WHEN count(DISTINCT l_extendedprice) / count(*) < 0.1
       THEN 'discrete' ELSE 'continuous' END FROM lineitem""",
)
def chosen_kinds(spark, d):
    lines = table(spark, d, "lineitem").select("l_quantity", "l_linestatus", "l_returnflag", "l_extendedprice")
    return p.set_kinds(lines, {"l_quantity": "ordinal", "absent": "nominal"})
