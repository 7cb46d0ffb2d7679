"""Studies, reports and designs on small tables: nulls, empty groups and what must be refused."""

import io
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.functions.hashing import md5_share
from tallyloom.operators import design, evaluation, learners, linear, modelling, panel, resample, validation
from tallyloom.sources import landed


def test_estimates_keep_their_digits_far_from_zero(spark):
    rng = np.random.default_rng(3)
    x, z = 1e9 + rng.normal(size=200), 2e7 + 1e-3 * rng.normal(size=200)
    y = 3 * (x - 1e9) - 500 * (z - 2e7) + 0.1 * rng.normal(size=200)
    df = spark.createDataFrame([("g", *map(float, r)) for r in zip(x, z, y)], "g string, x double, z double, y double")
    got = {r["term"]: r for r in linear.ols(df, "g", ["x", "z"], "y").collect()}
    a = np.column_stack([x - x.mean(), z - z.mean()])
    want = np.linalg.lstsq(a, y - y.mean(), rcond=None)[0]
    assert np.allclose([got["x"]["beta"], got["z"]["beta"]], want, rtol=1e-6)
    assert np.isfinite([r["vif"] for r in linear.vif(df, "g", ["x", "z"]).collect()]).all()


def test_interrupted_designs_refuse_breaks_at_edges(spark):
    df = spark.createDataFrame([("a", i) for i in range(10)], "s string, t int")
    for at in (0, 10):
        with pytest.raises(ValueError):
            design.interrupted_design(df, "s", "t", at)
    with pytest.raises(ValueError):
        design.interrupted_design(df, "s", "t", 9, bend=True)
    assert design.interrupted_design(df, "s", "t", 4, 4, 1).select("season_1", "step").collect()[0] == (1.0, 0.0)


def test_columns_are_taken_free_of_redundant_controls(spark):
    rng = np.random.default_rng(4)
    rows = [("a", *map(float, r)) for r in rng.normal(size=(60, 3))]
    df = spark.createDataFrame(rows, "g string, c double, x double, y double").withColumn("c2", 2 * F.col("c"))
    got = np.array([(r["x"], r["y"], r["c"]) for r in design.residualised(df, "g", ["c", "c2"], ["x", "y"]).collect()])
    assert np.allclose(got[:, :2].mean(axis=0), 0) and np.allclose(got[:, :2].T @ got[:, 2], 0, atol=1e-9)


def test_hac_of_several_regressors_equals_the_sandwich(spark):
    rng = np.random.default_rng(5)
    n, lags = 80, 3
    m = rng.normal(size=(n, 3)).cumsum(axis=0)
    df = spark.createDataFrame([("a", i, *map(float, r)) for i, r in enumerate(m)], "s string, t int, x double, c double, y double")
    got = design.hac_column(df, "s", "t", "x", ["c"], "y", lags).first()
    a = np.column_stack([np.ones(n), m[:, 0], m[:, 1]])
    inverse = np.linalg.inv(a.T @ a)
    beta = inverse @ a.T @ m[:, 2]
    u = a * (m[:, 2] - a @ beta)[:, None]
    s = u.T @ u
    for k in range(1, lags + 1):
        g = u[k:].T @ u[:-k]
        s += (1 - k / (lags + 1)) * (g + g.T)
    assert np.isclose(got["beta"], beta[1]) and np.isclose(got["se_hac"], np.sqrt((inverse @ s @ inverse)[1, 1] * n / (n - 3)))


def test_intervals_hold_points_at_their_lower_edge_and_none_beyond(spark):
    points = spark.createDataFrame([("a", t) for t in (0, 1, 2, 5, 9)] + [("b", 3), (None, 1)], "k string, t long")
    edges = spark.createDataFrame([("a", 1), ("a", 1), ("a", 5), ("a", 9), ("b", 1), (None, 0), (None, 4)], "k string, t long")
    got = sorted((r["k"], r["t"], r["gap"], r["wait"]) for r in panel.in_interval(points, edges, "k", "t", "t").filter("k is not null").collect())
    assert got == [("a", 1, 4, 4), ("a", 2, 4, 3), ("a", 5, 4, 4)]


def test_isotonic_fits_do_not_fall(spark):
    rng = np.random.default_rng(6)
    rows = [("g", round(float(p), 2), int(rng.random() < p)) for p in rng.random(500)]
    fit = validation.isotonic(spark.createDataFrame(rows, "g string, p double, y int"), "g", "p", "y").orderBy("score").collect()
    values = [r["fitted"] for r in fit]
    assert all(a <= b for a, b in zip(values, values[1:])) and np.isclose(sum(r["n"] * r["fitted"] for r in fit), sum(y for *_, y in rows))


def test_scores_are_rounded_by_their_binary_values_as_in_sql(spark):
    import duckdb

    from tallyloom.plans.base import binned

    want = dict(duckdb.sql("SELECT p, round(p, 2) FROM (SELECT round(i / 10000.0::DOUBLE, 4) AS p FROM range(10001) t(i))").fetchall())
    rows = spark.range(10001).select(F.round(F.col("id") / 10000, 4).alias("p")).select("p", binned("p", 2).alias("score")).collect()
    assert {r["p"]: r["score"] for r in rows} == want and want[0.575] == 0.57


def test_coverage_counts_scores_that_are_missing_as_the_largest(spark):
    df = spark.createDataFrame([(i, None if i % 4 == 0 else float(i)) for i in range(400)], "id long, s double").repartition(3)
    dealt = df.select("s", *[(md5_share(resample.key("s", F.lit(r), "id")) < 0.5).alias(str(r)) for r in range(3)]).collect()
    for alpha in (0.4, 0.1):
        got = {r["rep"]: r["coverage"] for r in resample.split_coverage(df, "id", "s", 3, alpha, 0.5, "s").collect()}
        for rep in range(3):
            cal, test = ([r["s"] for r in dealt if r[str(rep)] == c] for c in (True, False))
            cut = sorted(np.inf if s is None else s for s in cal)[min(len(cal), int(np.ceil((len(cal) + 1) * (1 - alpha) - 1e-9))) - 1]
            assert got[rep] == (None if cut == np.inf else pytest.approx(np.mean([s <= cut for s in test if s is not None])))


def test_exact_shapley_values_add_up(spark):
    df = spark.createDataFrame([(i, float(i), float(i * i % 7), 1.0) for i in range(20)], "row long, a double, b double, c double")
    predict = lambda f: f["a"] * f["b"] - f["c"]
    got = {r["row"]: r["s"] for r in modelling.exact_shapley(df, "row", ["a", "b", "c"], predict).groupBy("row").agg(F.sum("value").alias("s")).collect()}
    m = df.agg(F.avg("a"), F.avg("b"), F.avg("c")).first()
    assert all(np.isclose(got[i], i * (i * i % 7) - 1 - (m[0] * m[1] - m[2])) for i in range(20))
    with pytest.raises(ValueError):
        modelling.exact_shapley(df, "row", [f"x{i}" for i in range(13)], predict)


def test_kmeans_keeps_the_centre_of_an_empty_cluster(spark):
    df = spark.createDataFrame([(i, [float(i % 2), 0.0]) for i in range(10)], "id long, vec array<double>")
    rows, centres = modelling.kmeans(df, "id", "vec", [[0.0, 0.0], [1.0, 0.0], [50.0, 50.0]], 2)
    assert centres == [[0.0, 0.0], [1.0, 0.0], [50.0, 50.0]] and {r["cluster"] for r in rows.collect()} == {0, 1}


def test_clouds_of_zero_rows_and_constant_dimensions(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [3.0, 0.0])], "id long, vec array<double>")
    at = lambda kind: {r["id"]: r["vec"] for r in modelling.normalised_cloud(df, "id", "vec", kind).collect()}
    assert at("l2") == {1: [0.0, 0.0], 2: [1.0, 0.0]} and at("whitened") == {1: [-1.0, 0.0], 2: [1.0, 0.0]}
    with pytest.raises(ValueError):
        modelling.normalised_cloud(df, "id", "vec", "other")


def test_nulls_are_a_value_of_their_own_for_folds(spark):
    df = spark.createDataFrame([(1, "x", None), (2, "x", None), (3, "x", ""), (4, None, "x")], "id long, a string, b string")
    fold = {r["id"]: r["fold"] for r in validation.duplicate_aware_folds(df, ["a", "b"], 10_000, "s").collect()}
    assert fold[1] == fold[2] and len({fold[1], fold[3], fold[4]}) == 3


def test_studies_of_empty_tables_have_no_rows(spark):
    e = spark.createDataFrame([], "id long, g string, x double, y double, l boolean, v array<double>")
    assert evaluation.exact_match(e, ["g"], "g", "g").filter("g is not null").count() == 0
    assert validation.isotonic(e, "g", "x", "y").count() == 0
    assert linear.ols(e, "g", ["x"], "y").count() == 0
    assert resample.stratified_folds(e, "g", "id", 5, "s").count() == 0
    assert resample.bootstrap_means(e, "g", "id", "y", 3, "s").count() == 0
    assert modelling.normalised_cloud(e, "id", "v", "l2").count() == 0


def test_lasso_without_penalty_is_least_squares(spark):
    rng = np.random.default_rng(8)
    rows = [("g", *map(float, r)) for r in rng.normal(size=(100, 3))]
    got = {(r["alpha"], r["term"]): r["beta"] for r in learners.lasso_path(spark.createDataFrame(rows, "g string, a double, b double, y double"), "g", ["a", "b"], "y", [0.0, 100.0]).collect()}
    m = np.array([r[1:] for r in rows])
    z = (m[:, :2] - m[:, :2].mean(axis=0)) / m[:, :2].std(axis=0)
    want = np.linalg.lstsq(z, m[:, 2] - m[:, 2].mean(), rcond=None)[0]
    assert np.allclose([got[0.0, "a"], got[0.0, "b"]], want) and got[100.0, "a"] == got[100.0, "b"] == 0


def test_further_readers_refuse_what_is_wrong(spark, tmp_path):
    put = lambda name, text: (tmp_path / name).write_text(text) and f"file://{tmp_path}/{name}"
    with pytest.raises(ValueError, match="no rows: E1 gone"):
        landed.statistic_json(spark, put("e.json", '{"RESULT":{"CODE":"E1","MESSAGE":"gone"}}'))
    row = '{"StatisticSearch":{"list_total_count":1,"row":[{"STAT_CODE":"1","ITEM_CODE1":"a","UNIT_NAME":"u","TIME":"%s","DATA_VALUE":"1,234.5"}]}}'
    with pytest.raises(Exception, match="no such time"):
        landed.statistic_json(spark, put("t.json", row % "1999W1")).collect()
    got = landed.statistic_json(spark, put("s.json", row % "199902S2")).first()
    assert (got["cycle"], str(got["date"]), got["value"]) == ("SM", "1999-02-28", 1234.5)
    with pytest.raises(ValueError, match="begins with Year"):
        landed.survey_wide(spark, put("w.csv", "a,b\n1,2\n"))
    t = spark.createDataFrame([(1, 2.0, 3.0, 9.0)], "a int, b double, c double, d double")
    with pytest.raises(ValueError, match="away from their total"):
        landed.power_table(t, ["y", "w", "s", "t"], "w", "s", "t", 0.5)
    with pytest.raises(ValueError, match="columns"):
        landed.power_table(t, ["y"], "w", "s", "t", 0.5)
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("x.csv", "a\n1\n")
    (tmp_path / "x.zip").write_bytes(held.getvalue())
    with pytest.raises(ValueError, match="unpack it"):
        landed.zipped_csv(spark, f"file://{tmp_path}/x.zip", "a int", max_bytes=10)
    assert [r["a"] for r in landed.zipped_csv(spark, f"file://{tmp_path}/x.zip", "a int").collect()] == [1]
