import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fenceline.operators import classify, clean, cluster, compare, correlate, marks, outlier_tests, profile, reduce, regress, survival
from fenceline.functions.columns import keyword_category
from fenceline.sources import tables


def brute_dbscan(x, eps, least):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    core = (d <= eps).sum(axis=1) >= least
    label = np.full(len(x), -1)
    number = 0
    for i in np.flatnonzero(core):
        if label[i] >= 0:
            continue
        todo = [i]
        while todo:
            j = todo.pop()
            if label[j] < 0:
                label[j] = number
                todo += [m for m in np.flatnonzero((d[j] <= eps) & core) if label[m] < 0]
        number += 1
    for i in np.flatnonzero(~core):
        near = np.flatnonzero((d[i] <= eps) & core)
        if near.size:
            label[i] = min((d[i, j], label[j]) for j in near)[1]
    return label, core


@pytest.mark.parametrize("dims", [1, 2, 3])
def test_dbscan_equals_brute_force_with_hot_copies(spark, dims):
    rng = np.random.default_rng(dims)
    x = np.vstack([
        rng.normal(0, 0.6, (150, dims)), rng.normal(4, 0.8, (80, dims)), rng.uniform(-4, 8, (60, dims)),
        np.full((120, dims), 2.0),
    ])
    columns = [f"c{i}" for i in range(dims)]
    df = spark.createDataFrame(pd.DataFrame(x, columns=columns).assign(row_id=range(len(x))))
    got = cluster.dbscan(df, columns, "row_id", 0.5, 5, leaf_rows=32).orderBy("row_id").toPandas()
    label, core = brute_dbscan(x, 0.5, 5)
    assert (got["is_core"].to_numpy() == core).all()
    assert (got["cluster"].to_numpy() == label).all()


def test_components_on_the_driver_and_on_spark(spark):
    edges = spark.createDataFrame([("a", "b"), ("c", "b"), ("d", "e"), ("c", "f"), ("f", "g")], "a string, b string")
    nodes = spark.createDataFrame([(c,) for c in "abcdefgh"], "cell string")
    expected = {"a": "a", "b": "a", "c": "a", "f": "a", "g": "a", "d": "d", "e": "d", "h": "h"}
    for driver_rows in (100, 0):
        assert {r["cell"]: r["label"] for r in cluster._connected(nodes, edges, driver_rows).collect()} == expected


def test_clusters_and_tendency(spark):
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(0, 0.2, (60, 2)), rng.normal(5, 0.2, (60, 2)), rng.normal([0, 5], 0.2, (60, 2))])
    df = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b"]).assign(row_id=range(180)))
    data = cluster.prepare(df, ["a", "b"], "row_id")
    evaluated = cluster.evaluate_k(data, ["a", "b"], largest=5, restarts=3)
    assert cluster.choose_k(evaluated).first()["recommended"] == 3
    found = cluster.kmeans_clusters(data, ["a", "b"], "row_id", 3, restarts=3)
    assert sorted(r["size"] for r in found["clusters"].collect()) == [60, 60, 60]
    for linkage in ("ward", "centroid"):
        merged = cluster.hierarchical_groups(data, ["a", "b"], "row_id", 3, linkage)
        assert sorted(r["size"] for r in merged["clusters"].collect()) == [60, 60, 60]
    assert cluster.clustering_tendency(data, ["a", "b"], leaf_rows=32).first()["tendency"] == "strong"


def brute_cox(time, event, group):
    beta = 0.0
    for _ in range(50):
        score = info = 0.0
        theta = np.exp(beta)
        for t in np.unique(time[event == 1]):
            risk, dead = time >= t, (time == t) & (event == 1)
            r0, r1 = (risk & (group == 0)).sum(), (risk & (group == 1)).sum() * theta
            d0, d1 = (dead & (group == 0)).sum(), (dead & (group == 1)).sum()
            d = d0 + d1
            score += d1
            for l in range(d):
                p = (r1 - l / d * d1 * theta) / (r0 + r1 - l / d * (d0 + d1 * theta))
                score -= p
                info += p * (1 - p)
        beta += score / info
    return beta, 1 / np.sqrt(info)


def test_cox_equals_brute_force_with_ties(spark):
    rng = np.random.default_rng(8)
    group = rng.integers(0, 2, 200)
    time = np.ceil(rng.exponential(6 / (1 + group), 200))
    event = (rng.random(200) < 0.8).astype(int)
    df = spark.createDataFrame([(bool(g), float(t), int(e)) for g, t, e in zip(group, time, event)], "is_outlier boolean, time double, event int")
    pairs = survival.survival_pairs(df, "time", "event")
    row = survival.cox_outlier(pairs).first()
    beta, se = brute_cox(time, event, group)
    assert row["coef"] == pytest.approx(beta, abs=1e-6)
    assert row["se"] == pytest.approx(se, rel=1e-6)
    # pieces of few distinct times give the same curve
    whole = survival.kaplan_meier(pairs).orderBy("is_outlier", "time").collect()
    split = survival.kaplan_meier(pairs, task_rows=4).orderBy("is_outlier", "time").collect()
    assert [tuple(r)[:4] for r in whole] == [tuple(r)[:4] for r in split]
    assert [r["survival"] for r in whole] == pytest.approx([r["survival"] for r in split])


def test_survival_input_checks(spark):
    df = spark.createDataFrame([(i % 2 == 0, float(i), i % 2) for i in range(20)], "is_outlier boolean, time double, event int")
    with pytest.raises(ValueError, match="positive"):
        survival.survival_pairs(df, "time", "event")
    with pytest.raises(ValueError, match="0 and 1"):
        survival.survival_pairs(df.withColumn("event", F.lit(3)), "time", "event")


def test_huber_resists_outliers_and_matches_numpy(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(0, 1, (300, 2))
    y = 1 + 2 * x[:, 0] - x[:, 1] + rng.normal(0, 0.3, 300)
    y[:20] += 15
    df = spark.createDataFrame(pd.DataFrame({"y": y, "a": x[:, 0], "b": x[:, 1]}))
    design = np.column_stack([np.ones(300), x])
    beta = np.linalg.lstsq(design, y, rcond=None)[0]
    least = regress.least_squares(df, "y", ["a", "b"])
    assert [r["estimate"] for r in least[0].collect()] == pytest.approx(list(beta), abs=1e-8)
    for _ in range(200):
        r = y - design @ beta
        s = np.median(np.abs(r)) / regress.NORMAL_QUARTILE
        w = np.minimum(1, regress.HUBER / np.maximum(np.abs(r / s), 1e-12))
        beta = np.linalg.solve(design.T @ (design * w[:, None]), design.T @ (w * y))
    robust = regress.huber_regression(df, "y", ["a", "b"], tolerance=1e-10)
    assert [r["estimate"] for r in robust[0].collect()] == pytest.approx(list(beta), abs=1e-6)
    changes, verdict = regress.compare_regressions(least, robust)
    assert changes.count() == 2 and verdict.first()["error_change_percent"] > 0


def test_mann_whitney_with_a_hot_value(spark):
    rng = np.random.default_rng(10)
    x = np.where(rng.random(900) < 1 / 3, 4.0, np.round(rng.exponential(5, 900), 1))
    g = rng.random(900) < 0.2
    df = spark.createDataFrame([(bool(a), float(b)) for a, b in zip(g, x)], "is_outlier boolean, x double")
    u = sum((x[g] > v).sum() + (x[g] == v).sum() / 2 for v in x[~g])
    for task_rows in (1_000_000, 10):
        row = compare.mann_whitney(df, ["x"], task_rows=task_rows).first()
        assert row["u"] == pytest.approx(u)
    assert 0 < row["p_value"] <= 1


def test_mann_whitney_of_few_against_many_names_its_method(spark):
    n = 100_001
    df = spark.range(n + 1).select((F.col("id") == n).alias("is_outlier"), F.col("id").cast("double").alias("x"), (F.col("id") % 1000).alias("tied"))
    rows = {r["variable"]: r for r in compare.mann_whitney(df, ["x", "tied"]).collect()}
    assert rows["x"]["p_value"] == pytest.approx(2 / (n + 1)) and rows["x"]["significant"]
    assert (rows["x"]["method"], rows["tied"]["method"]) == ("exact", "normal")


def test_permutation_p_agrees_with_chi_square(spark, monkeypatch):
    rng = np.random.default_rng(11)
    df = spark.createDataFrame(
        [(bool(o), f"v{v}") for o, v in zip(rng.random(600) < 0.3, rng.integers(0, 8, 600))], "is_outlier boolean, c string"
    )
    cells = compare._cells(df, ["c"], "is_outlier")
    chi2 = compare.contingency_tests(df, ["c"]).first()
    simulated = compare.permutation_p(cells, 4000).first()
    assert simulated["permutation_p"] == pytest.approx(chi2["p_value"], abs=0.04)
    monkeypatch.setattr(compare, "BLOCK_VALUES", 3)
    blocked = compare.permutation_p(cells, 4000).first()
    assert blocked["replicates"] == 4000
    assert blocked["permutation_p"] == pytest.approx(chi2["p_value"], abs=0.04)


def test_large_margins_are_drawn_whole():
    rng = np.random.default_rng(0)
    rows = np.array([3, 2_000_000_000, 500_000, 40_000_000])
    drawn = compare.draw_margins(rng, rows, 700_000_000)
    assert drawn.sum() == 700_000_000 and (drawn >= 0).all() and (drawn <= rows).all()


def test_spearman_ranks_in_pieces(spark):
    rng = np.random.default_rng(12)
    a = np.round(rng.normal(0, 1, 500), 1)
    b = np.round(a + rng.normal(0, 1, 500), 1)
    df = spark.createDataFrame(pd.DataFrame({"a": a, "b": b}))
    expected = np.corrcoef(pd.Series(a).rank(), pd.Series(b).rank())[0, 1]
    for task_rows in (1_000_000, 20):
        assert correlate.rank_correlations(df, ["a", "b"], (), task_rows).first()["r"] == pytest.approx(expected)


def test_components_of_constant_and_scaled_columns(spark):
    rng = np.random.default_rng(13)
    x = rng.normal(0, 1, (200, 3)) @ np.array([[1, 0.5, 0], [0, 1, 0], [0, 0, 2]])
    df = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b", "c"]).assign(row_id=range(200)))
    fitted = reduce.fit_components(df, ["a", "b", "c"])
    z = (x - x.mean(0)) / x.std(0)
    expected = np.sort(np.linalg.eigvalsh(np.cov(z.T)))[::-1]
    assert fitted.eigenvalues == pytest.approx(expected)
    scores = fitted.scores(df, ["row_id"], 3).orderBy("row_id").toPandas()[["pc1", "pc2", "pc3"]].to_numpy()
    assert np.cov(scores.T) == pytest.approx(np.diag(expected), abs=1e-9)


def test_mark_occurrences_of_a_hot_id(spark):
    df = spark.createDataFrame([(i, 7 if i % 3 == 0 else i) for i in range(300)], "row_id long, subject long")
    ids = spark.createDataFrame([("7.0",), (" 7",), ("4",), ("999",)], "id string")
    for task_rows in (1_000_000, 10):
        got = {r["row_id"] for r in marks.mark_occurrences(df, ids, "subject", "row_id", task_rows=task_rows).where("is_outlier").collect()}
        assert got == {0, 3, 4}
    assert [r["id"] for r in marks.unmatched_ids(df, ids.where("id = '999'"), "subject").collect()] == ["999"]


def test_cleaning_keeps_first_and_last_copy(spark):
    df = spark.createDataFrame([(i, i % 2, "a") for i in range(9)], "row_id long, x int, y string")
    assert {r["row_id"] for r in clean.drop_duplicates(df, "row_id").collect()} == {0, 1}
    assert {r["row_id"] for r in clean.drop_duplicates(df, "row_id", "last").collect()} == {7, 8}
    only = clean.drop_duplicates(df, "row_id", columns=["y"])
    assert [tuple(r) for r in only.collect()] == [(0, 0, "a")]


def test_bad_csv_lines(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('id,name,v\n1,"a,b",2.5\n2,c\n3,d,4.5,9\n4,é,\n', encoding="latin-1")
    for encoding in ("latin-1", "cp1252"):
        rows = tables.read_csv(spark, str(path), encoding=encoding).orderBy("id").collect()
        assert [tuple(r) for r in rows] == [(1, "a,b", 2.5), (2, "c", None), (4, "é", None)]
    with pytest.raises(ValueError):
        tables.require_rows(spark.createDataFrame([], "a int"))


def test_deep_page_equals_shallow_page(spark, monkeypatch):
    df = spark.range(1000).withColumnRenamed("id", "row_id")
    shallow = [r[0] for r in tables.page(df, "row_id", 4, 100).collect()]
    monkeypatch.setattr(tables, "PAGE_MERGE_ROWS", 10)
    deep = [r[0] for r in tables.page(df, "row_id", 4, 100, task_rows=50).collect()]
    assert shallow == deep == list(range(300, 400))


def test_kinds(spark):
    df = spark.createDataFrame(
        [(i * 1.5, i % 3, "ab"[i % 2], "abcd"[i % 4], i % 2 == 0) for i in range(100)],
        "c double, d int, b string, n string, t boolean",
    )
    expected = {"c": "continuous", "d": "discrete", "b": "binary", "n": "nominal", "t": "binary"}
    for exact in (True, False):
        assert {r["variable"]: r["kind"] for r in profile.infer_kinds(df, exact=exact).collect()} == expected


def test_classifiers_learn_and_warn(spark):
    rng = np.random.default_rng(14)
    x = rng.normal(0, 1, (400, 2))
    y = x[:, 0] + rng.normal(0, 0.7, 400) > 0.8
    df = spark.createDataFrame(pd.DataFrame({"row_id": range(400), "a": x[:, 0], "b": x[:, 1], "is_outlier": y}))
    logistic = classify.logistic_characterisation(df, ["a", "b"], "row_id")
    assert logistic["metrics"].first()["auc"] > 0.75
    wald = {r["term"]: r for r in logistic["wald"].collect()}
    assert wald["a"]["p_value"] < 1e-6 < wald["b"]["p_value"]
    forest = classify.random_forest(df, ["a", "b"], "row_id")
    assert forest["importance"].orderBy("position").first()["variable"] == "a"
    with pytest.raises(ValueError):
        classify.logistic_characterisation(df.limit(10), ["a", "b"], "row_id")


def test_median_survival_on_the_half(spark):
    """Without censoring the curve is a ratio of counts: it meets one half exactly at the sixth of twelve times."""
    rows = [(flag, float(t), 1) for flag in (True, False) for t in range(1, 13)]
    curve = survival.kaplan_meier(spark.createDataFrame(rows, "is_outlier boolean, time double, event long"))
    assert {r["median_survival"] for r in survival.median_survival(curve).collect()} == {6.0}


def test_survival_with_censoring(spark):
    rng = np.random.default_rng(21)
    rows = [(bool(i % 3), float(t), int(e)) for i, (t, e) in enumerate(zip(rng.integers(1, 15, 120), rng.integers(0, 2, 120)))]
    got = {(r["is_outlier"], r["time"]): r["survival"] for r in survival.kaplan_meier(spark.createDataFrame(rows, "is_outlier boolean, time double, event long")).collect()}
    for flag in (True, False):
        alive, own = 1.0, [(t, e) for f, t, e in rows if f == flag]
        for t in sorted({t for t, _ in own}):
            alive *= 1 - sum(e for u, e in own if u == t) / sum(u >= t for u, _ in own)
            assert got[(flag, t)] == pytest.approx(alive, abs=1e-12)


def test_filling_keeps_types_and_ids(spark):
    big = 2**53 + 1
    df = spark.createDataFrame([(big, 1, 1.0), (big + 1, None, None), (big + 2, 4, 3.0)], "id long, n int, x double")
    for strategy in ("mean", "median"):
        filled = clean.fill_missing(df, strategy)
        assert dict(filled.dtypes)["id"] == "bigint" and [r["id"] for r in filled.orderBy("id").collect()] == [big, big + 1, big + 2]
        assert clean.fill_missing(df.select("id"), strategy).dtypes == [("id", "bigint")]
    assert dict(clean.fill_missing(df, "mean", columns=["x"]).dtypes)["n"] == "int"


def test_split_of_small_classes(spark):
    rows = [("one", 0)] + [("six", 10 + i) for i in range(6)] + [("many", 100 + i) for i in range(250)]
    split = classify.stratified_split(spark.createDataFrame(rows, "label string, id long"), "label", "id")
    got = {r["label"]: r["n"] for r in split.where("is_test").groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert got == {"six": 1, "many": 50} and split.count() == len(rows)


def test_codes_of_many_texts(spark):
    words = [f"w{i:05d}" for i in range(3000)]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "id long, word string")
    got = {r["id"]: r["word"] for r in classify.encode(df, ["word"], ["id"]).collect()}
    assert got == {i: float(i) for i in range(3000)}


def test_t_test_of_large_groups(spark):
    df = spark.range(24000).select((F.col("id") % 2 == 0).alias("is_outlier"), F.randn(3).alias("x"), (F.rand(4) * 2).alias("y"))
    rows = {r["variable"]: r for r in compare.student_t(df, ["x", "y"]).collect()}
    assert rows["x"]["both_normal"] and not rows["y"]["both_normal"] and rows["x"]["dof"] == 23998


def test_normality_counts_every_variable(spark):
    df = spark.range(4000).select(*[F.randn(i).alias(f"n{i}") for i in range(5)], *[F.rand(i).alias(f"u{i}") for i in range(5)])
    row = outlier_tests.mostly_normal(df, df.columns).first()
    passed = {r["variable"] for r in outlier_tests.normality(df, df.columns).where("is_normal").collect()}
    assert row["variables"] == 10 and row["normal_variables"] == len(passed) > 0 and not any(c.startswith("u") for c in passed)


def test_dixon_says_which_groups_it_leaves(spark):
    rows = [("big", i, float(i)) for i in range(40)] + [("flat", i, 1.0) for i in range(5)] + [("two", i, float(i)) for i in range(2)] + [("ok", i, float(i * i)) for i in range(6)]
    got = outlier_tests.dixon(spark.createDataFrame(rows, "g string, id long, x double"), ["g"], "x", "id").collect()
    assert {(r["g"], r["status"]) for r in got} == {("big", "more than 30 rows"), ("flat", "no spread"), ("two", "under 3 rows"), ("ok", "tested")}
    assert all((r["q"] is None) == (r["status"] != "tested") for r in got)


def test_rejected_csv_lines(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("id,name\n1,a\n2,b,c\n3,d\n4,e,f,g\n")
    kept, rejected = tables.read_csv_lines(spark, str(path))
    assert sorted(r["id"] for r in kept.collect()) == [1, 3]
    assert sorted((r["line"], r["fields"], r["values"]["id"]) for r in rejected.collect()) == [("2,b,c", 3, 2), ("4,e,f,g", 4, 4)]


def test_mixed_list_of_ids_and_positions(spark):
    df = spark.createDataFrame([(i, str(100 + i // 2)) for i in range(10)], "row_id long, code string")
    listed = spark.createDataFrame([("102",), ("ID_0",), ("7",), ("x",), ("ID_55",), (None,), ("102",)], "id string")
    marked, unmatched = marks.mark_listed(df, listed, "code", "row_id")
    assert sorted(r["row_id"] for r in marked.where("is_outlier").collect()) == [0, 4, 5, 7] and marked.count() == 10
    assert sorted(r["id"] for r in unmatched.collect()) == ["ID_55", "x"]


def test_huber_weights_of_rows(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(0, 1, 300)
    z = rng.normal(0, 1, 300)
    y = 2 * x - z + 1 + rng.normal(0, 0.2, 300)
    y[:3] += 500
    df = spark.createDataFrame(pd.DataFrame({"id": range(300), "x": x, "z": z, "y": y}))
    coefficients, summary = regress.huber_regression(df, "y", ["x", "z"])
    rows = regress.huber_rows(df, coefficients, summary, "y", ["x", "z"], "id").toPandas().set_index("id")
    told = summary.first()
    assert set(rows.index[rows["ignored"]]) == {0, 1, 2} and told["ignored_rows"] == 3
    assert (rows["weight"] < 1).sum() == told["reduced_rows"] and rows["weight"].mean() == pytest.approx(told["weight_mean"])


def test_summary_of_correlation_changes(spark):
    compared = spark.createDataFrame(
        [("a", "b", 0.9, 0.1, True, 0.8), ("a", "c", 0.2, 0.3, False, 0.1), ("b", "c", -0.5, 0.0, True, 0.5)],
        "first string, second string, outlier_pearson double, normal_pearson double, significant boolean, pearson_change double",
    )
    row = correlate.change_summary(compared).first()
    assert (row["pairs"], row["significant_pairs"], row["largest_pair"]) == (3, 2, "a / b")
    matrix = {r["variable"]: r for r in correlate.difference_matrix(compared, ["a", "b", "c"]).collect()}
    assert matrix["a"]["b"] == matrix["b"]["a"] == pytest.approx(0.8) and matrix["c"]["c"] == 0.0 and matrix["c"]["b"] == pytest.approx(-0.5)


def test_categories_by_keyword():
    table = {"money": ["price", "cost"], "time": ["date", "hour"]}
    assert [keyword_category(c, table) for c in ("Unit_Price", "ship_date", "cost_per_hour", "colour")] == ["money", "time", "money", "other"]


def test_busy_leaves_and_far_queries(spark, monkeypatch):
    """Queries far from all points meet one leaf; their work is dealt out, and the answers stay exact."""
    from fenceline.operators import neighbours

    monkeypatch.setattr(neighbours, "QUERIES_PER_TASK", 40)
    rng = np.random.default_rng(31)
    x = rng.lognormal(0, 1.5, (400, 2))
    q = rng.uniform(0, x.max(), (300, 2))
    points = spark.createDataFrame(pd.DataFrame({"carry": range(400), "x0": x[:, 0], "x1": x[:, 1]}))
    asked = spark.createDataFrame(pd.DataFrame({"query": range(300), "x0": q[:, 0], "x1": q[:, 1]}))
    got = neighbours.nearest_rows(points, asked, ["x0", "x1"], leaf_rows=32).toPandas().sort_values("query")
    d = np.sqrt(((q[:, None] - x[None]) ** 2).sum(axis=2))
    assert got["distance"].to_numpy() == pytest.approx(d.min(axis=1)) and len(got) == 300
