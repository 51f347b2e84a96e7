"""Chains of cleaning steps leave the row id alone and pass their settings on."""

import pytest

from fenceline.operators import clean


@pytest.mark.parametrize("strategy, value, filled", [("mean", None, 2.0), ("median", None, 2.0), ("constant", 7.0, 7.0)])
@pytest.mark.parametrize("task_rows", [1_000_000, 1])
def test_ids_stay(spark, strategy, value, filled, task_rows):
    ids = [1, 2**53 + 1, None, -5]
    df = spark.createDataFrame([(i, x) for i, x in zip(ids, [1.0, None, 2.0, 3.0])], "row_id long, x double")
    out, report = clean.clean(df, [{"step": "missing", "strategy": strategy, "value": value}], "row_id", task_rows=task_rows)
    assert out.schema["row_id"].dataType.simpleString() == "bigint"
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(zip(ids, [1.0, filled, 2.0, 3.0]), key=repr)
    assert [tuple(r) for r in report.collect()] == [(1, "missing", 4, 4)]


def test_settings_reach_the_quantiles(spark, monkeypatch):
    seen = []
    inner = clean.column_quantiles
    monkeypatch.setattr(clean, "column_quantiles", lambda df, columns, probs, *a, **b: seen.append((a, b)) or inner(df, columns, probs, *a, **b))
    df = spark.createDataFrame([(1, 1.0), (2, None), (3, 5.0)], "row_id long, x double")
    clean.clean(df, [{"step": "missing", "strategy": "median"}], "row_id", task_rows=7)[0].collect()
    assert seen == [((), {"task_rows": 7})]
