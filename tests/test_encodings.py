"""Encodings of CSV files, and draws that do not depend on partitions."""

import pytest

from fenceline.functions.columns import counted_uniform
from fenceline.operators import cluster
from fenceline.sources import tables
from pyspark.sql import functions as F


@pytest.mark.parametrize("text, encoding, found", [
    ("id,näme\n1,é\n", "utf-8", "utf-8"), ("id,näme\n1,é\n2,plain\n", "latin-1", "latin-1"), ("id,näme\n1,“€” – é\n", "cp1252", "cp1252"),
    ("id,n\n1,plain\n", "latin-1", "utf-8"), ("id,n\n" + "1,plain\n" * 3000 + "2,é\n", "latin-1", "latin-1"),
])
def test_detected(spark, tmp_path, text, encoding, found):
    path = tmp_path / "a.csv"
    path.write_bytes(text.encode(encoding))
    before = spark.conf.get("spark.sql.legacy.javaCharsets")
    assert [r["encoding"] for r in tables.detect_encodings(spark, str(path)).collect()] == [found]
    df = tables.read_csv(spark, str(path), encoding="auto")
    lines = text.split("\n")
    assert df.columns == lines[0].split(",") and sorted(str(r[1]) for r in df.collect()) == sorted(x.split(",")[1] for x in lines[1:-1])
    assert spark.conf.get("spark.sql.legacy.javaCharsets") == before


def test_files_of_several_encodings(spark, tmp_path):
    for name, encoding, value in (("a", "utf-8", "日本"), ("b", "latin-1", "é"), ("c", "cp1252", "Š™"), ("d", "utf-8", "x")):
        (tmp_path / f"{name}.csv").write_bytes(f"id,name\n{ord(name)},{value}\n".encode(encoding))
    rows = {(r["id"], r["name"]) for r in tables.read_csv(spark, str(tmp_path), encoding="auto").collect()}
    assert rows == {(97, "日本"), (98, "é"), (99, "Š™"), (100, "x")}


def test_draws_do_not_depend_on_partitions(spark):
    draws = [sorted(r[0] for r in spark.range(0, 5000, 1, n).select(counted_uniform(F.col("id"), 7, 1)).collect()) for n in (1, 64)]
    assert draws[0] == draws[1] and 0 <= draws[0][0] and draws[0][-1] < 1
    assert max(abs(x - (i + 0.5) / 5000) for i, x in enumerate(draws[0])) < 0.03
    both = spark.range(20_000).select(counted_uniform(F.col("id"), 7, 0).alias("a"), counted_uniform(F.col("id"), 7, 1).alias("b"))
    assert abs(both.agg(F.corr("a", "b")).first()[0]) < 0.03
    data = spark.range(300).selectExpr("id AS row_id", "sin(id) AS a", "cos(3 * id) AS b")
    seen = {cluster.clustering_tendency(data.repartition(n), ["a", "b"]).first()["hopkins"] for n in (1, 64)}
    assert max(seen) - min(seen) < 1e-9
