"""Seasonal forecasts, chained regressions, sampled attributions, greedy selection, moving components and refits in a stream against plain versions."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyloom.functions.ranks import percentile, percentiles_by, running_by
from tallyloom.operators import attribution, imputation, regularised, selection, smoothing, spectra
from tallyloom.streaming import refits


def test_seasonal_forecast_follows_season_and_trend_and_falls_back(spark):
    rows = [("s", i, 10 + 0.5 * i + [0, 3, -2, 1][i % 4]) for i in range(40)] + [("t", i, 5.0 + i) for i in range(11)] + [("n", i, float(i)) for i in range(5)] + [("s", 99, None), ("e", 0, None), ("e", 1, float("nan"))]
    got = smoothing.seasonal_paths(spark.createDataFrame(rows, "k string, i int, v double").repartition(3), "k", "i", "v", 4, 6, [0.1, 0.5, 0.9], 50, "x").collect()
    assert {r["k"]: r["method"] for r in got} == {"s": "season", "t": "trend", "n": "naive"}
    for r in got:
        if r["k"] == "s":
            assert r["forecast"] == pytest.approx(10 + 0.5 * (40 + r["step"]) + [0, 3, -2, 1][r["step"] % 4], abs=1.0)
    q = {(r["k"], r["step"], r["level"]): r["quantile"] for r in got}
    assert all(q[k, s, 0.1] <= q[k, s, 0.5] <= q[k, s, 0.9] for k, s, _ in q)
    assert [q["n", s, 0.5] for s in range(6)] == pytest.approx([4 + math.sqrt(s + 1) for s in range(6)])


def test_chained_regressions_equal_plain_rounds(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 3)) @ np.array([[1, 0.8, 0], [0, 0.5, 0.3], [0, 0, 1]]) + 4
    x[rng.random(x.shape) < 0.2] = np.nan
    x[0] = np.nan
    df = spark.createDataFrame([[None if np.isnan(v) else float(v) for v in r] + [i] for i, r in enumerate(x)], "a double, b double, c double, id long").repartition(3)
    means = np.nanmean(x, 0)
    now, gap = np.where(np.isnan(x), means, x), np.isnan(x)
    for _ in range(3):
        new = now.copy()
        for j in range(3):
            z = np.column_stack([np.delete(now, j, 1), np.ones(300)])
            own = ~gap[:, j]
            new[gap[:, j], j] = z[gap[:, j]] @ np.linalg.lstsq(z[own], x[own, j], rcond=None)[0]
        now = new
    chain = imputation.fit_chain(df, ["a", "b", "c"], 3)
    got = {r["id"]: r["v"] for r in imputation.filled(df, ["a", "b", "c"], chain, "v").collect()}
    assert all(got[i] == pytest.approx(list(now[i]), abs=1e-6) for i in range(300))
    none = imputation.fit_chain(df.limit(0), ["a", "b"], 2)
    assert none.fill(np.array([[np.nan, 2.0]])).tolist() == [[0.0, 2.0]]


def test_sampled_values_are_efficient_and_exact_ones_are_their_mean(spark):
    f = lambda x: x[..., 0] * x[..., 1] + np.maximum(x[..., 2], 0)
    rng = random.Random(2)
    df = spark.createDataFrame([(i, rng.gauss(0, 1), rng.gauss(0, 1), rng.gauss(0, 1)) for i in range(40)] + [(99, None, 1.0, 1.0)], "id long, a double, b double, c double").repartition(2)
    back = attribution.background_rows(df.filter("id < 40"), ["a", "b", "c"], 5, "s")
    s = {(r["id"], r["feature"]): r for r in attribution.sampled_shapley(df, ["a", "b", "c"], f, back, 40, "s").collect()}
    e = {(r["id"], r["feature"]): r["exact"] for r in attribution.exact_values(df, ["a", "b", "c"], f, back).collect()}
    assert s[99, "a"]["value"] is None and e[99, "a"] is None
    for (i, k), r in s.items():
        if i < 40:
            assert abs(r["gap"]) < 1e-9 and abs(r["value"] - e[i, k]) <= 5 * r["error"] + 1e-9
            if k == "c":  # adds up with the rest, so every order gives the same
                assert r["value"] == pytest.approx(e[i, k])
    with pytest.raises(ValueError):
        attribution.exact_values(df, ["a"] * 13, f, back)
    table = attribution.agreement(attribution.sampled_shapley(df, ["a", "b", "c"], f, back, 40, "s"), attribution.exact_values(df, ["a", "b", "c"], f, back))
    assert {r["n"] for r in table.collect()} == {40}


def test_sampled_and_exact_values_meet_without_a_join(spark):
    from pyspark.sql import DataFrame

    f = lambda x: x[..., 0] * x[..., 1] + np.maximum(x[..., 2], 0)
    df = spark.createDataFrame([(i, i % 7 - 3.0, i % 5 - 2.0, i % 3 - 1.0) for i in range(30)] + [(99, None, 1.0, 1.0)], "id long, a double, b double, c double").repartition(2)
    back = attribution.background_rows(df.filter("id < 30"), ["a", "b", "c"], 4, "s")
    two = attribution.agreement(attribution.sampled_shapley(df, ["a", "b", "c"], f, back, 6, "s"), attribution.exact_values(df, ["a", "b", "c"], f, back))
    with pytest.MonkeyPatch.context() as m:
        m.delattr(DataFrame, "join")
        one = attribution.agreement(attribution.sampled_and_exact(df, ["a", "b", "c"], f, back, 6, "s"))
    rows = lambda t: sorted((r["feature"], r["n"], *[round(r[c], 9) for c in ("mean_abs", "mean_error", "worst", "within")]) for r in t.collect())
    assert rows(one) == rows(two) and {r[1] for r in rows(one)} == {30}


def test_greedy_selection_equals_refits_on_rows(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 5))
    x[:, 4] = 2 * x[:, 0]  # never a second candidate
    y = x[:, 0] + 0.4 * x[:, 2] + rng.normal(size=400)
    part = np.array(["train", "holdout", "fresh"])[np.arange(400) % 3]
    rows = [(*map(float, r), float(t), p) for r, t, p in zip(x, y, part)] + [(None, 1.0, 1.0, 1.0, 1.0, 1.0, "train"), (1.0, 1.0, 1.0, 1.0, 1.0, 1.0, None)]
    names = list("abcde")
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double, y double, part string").repartition(3)
    got = selection.greedy_selection(df, names, names, "y", "part", 5).collect()
    chosen = []

    def errors(cols):
        z = np.column_stack([x[:, cols], np.ones(400)])
        b = np.linalg.lstsq(z[part == "train"], y[part == "train"], rcond=None)[0]
        return {p: float(np.square(y - z @ b)[part == p].mean()) for p in ("train", "holdout", "fresh")}

    for r in got:
        left = [j for j in range(5) if j not in chosen and not (j in (0, 4) and {0, 4} & set(chosen))]
        chosen.append(min(left, key=lambda j: (round(errors([*chosen, j])["holdout"], 9), j)))
        assert names[chosen[-1]] == r["feature"]
        assert errors(chosen) == pytest.approx({p: r[p] for p in ("train", "holdout", "fresh")})
    assert len(got) == 4 and selection.greedy_selection(df.limit(0), names, names, "y", "part", 5).count() == 0


def test_products_of_parts_compute_their_columns_once(spark):
    seen, part = spark.sparkContext.accumulator(0), F.lit("train")

    @F.pandas_udf("double")
    def costly(x: pd.Series) -> pd.Series:
        seen.add(len(x))
        return x * 2.0

    df = spark.createDataFrame([(float(i), 1.0 if i else None) for i in range(50)], "a double, y double").withColumns({"b": costly("a"), "part": part})
    grams = selection.part_grams(df, ["a", "b"], "y", "part")
    assert grams["train"][-1, -1] == 49 and grams["train"][1, -1] == 2 * sum(range(50)) and seen.value == 50


def test_votes_of_better_submissions_gain_on_public_rows_only(spark):
    df = spark.range(2000).select("id", (F.pmod(F.xxhash64("id"), F.lit(2))).cast("int").alias("y"))
    got = {r["submissions"]: r for r in selection.submission_votes(df, "id", "y", [1, 200], "s").collect()}
    assert got[200]["public"] > 0.55 > got[200]["private"] > 0.45 and 50 < got[200]["better"] < 150


def test_component_stabilities_are_rows_where_bounds_are_below_one(spark):
    x = np.random.default_rng(8).normal(size=(3000, 2)) * [10, 1]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, a double, b double")
    got = spectra.component_stabilities(df, "id", ["a", "b"], 5, "s").collect()
    assert len(got) == 2 and all(0 < r["bound"] < 1 for r in got)


def test_component_stability_equals_plain_replicates(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(200, 4)) * [3, 2, 1, 0.2]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)] + [(900, None, 1.0, 1.0, 1.0)], "id long, a double, b double, c double, d double").repartition(3)
    cov = spectra.replicate_covariances(df, "id", list("abcd"), 6, "s")
    assert cov[0] == pytest.approx(np.cov(x.T, bias=True))
    from tallyloom.functions.hashing import md5_share
    from tallyloom.operators.resample import key, poisson

    w = df.filter("id < 900").orderBy("id").select(*[poisson(md5_share(key("s", F.lit(r), "id"))).alias(f"w{r}") for r in range(1, 7)]).toPandas().to_numpy()
    for r in range(6):
        assert cov[r + 1] == pytest.approx(np.cov(np.repeat(x, w[:, r], 0).T, bias=True))
    rows = spectra.stability(cov)
    value, vector = np.linalg.eigh(cov[0])
    for i, row in enumerate(rows):
        assert row[1] == pytest.approx(value[3 - i])
        angles = [math.degrees(math.acos(min(1, abs(np.linalg.eigh(c)[1][:, 3 - i] @ vector[:, 3 - i])))) for c in cov[1:]]
        assert row[4] == pytest.approx(np.mean(angles), abs=1e-6) and row[5] == pytest.approx(max(angles), abs=1e-6) and row[2] <= row[3]
    assert rows[0][7] == pytest.approx(rows[0][4], abs=1e-5) and rows[-1][7] == 0 and all(0 <= r[8] <= 1 for r in rows)
    assert rows[3][6] == 0 and spectra.stability(np.array([[[2.0]], [[1.0]]]))[0][:4] == (1, 2.0, 1.0, 1.0)


def refit_rows(seed=3):
    rng = random.Random(seed)
    return [(p, rng.random(), 2 * rng.random() + 0.1 * p) for p in range(8) for _ in range(30)] + [(3, None, 1.0), (None, 1.0, 1.0)]


def brute_refits(rows):
    good, out = [r for r in rows if None not in r], {}
    for p in sorted({r[0] for r in good}):
        own, past = [r for r in good if r[0] == p], np.array([r[1:] for r in good if r[0] < p])
        if len(past):
            slope, start = np.polyfit(past[:, 0], past[:, 1], 1)
        out[p] = (len(own), len(own) if len(past) else 0, np.mean([(y - start - slope * x) ** 2 for _, x, y in own]) if len(past) else None)
    return out


def test_refits_within_a_stream_survive_restarts_and_replays(spark, tmp_path):
    rows, source, folder = refit_rows(), str(tmp_path / "in"), str(tmp_path / "out")
    schema = "period int, x double, y double"
    want = {p: (n, s, None if m is None else pytest.approx(m)) for p, (n, s, m) in brute_refits(rows).items()}
    for part in (range(0, 3), range(3, 5), range(5, 8)):  # stopped and started again for each part
        spark.createDataFrame([r for r in rows if r[0] in part], schema).coalesce(1).write.mode("append").parquet(source)
        refits.refit_stream(spark.readStream.schema(schema).parquet(source), folder)
    result = lambda: {r["period"]: (r["n"], r["scored"], r["mse"]) for r in refits.refit_errors(spark, folder).collect()}
    assert result() == want
    refits.scored_batch(spark.createDataFrame([r for r in rows if r[0] in range(3, 5)], schema), 1, folder)  # a batch that is run again
    assert result() == want
    assert refits.refit_errors(spark, str(tmp_path / "none")).count() == 0


def test_percentiles_of_large_groups_and_null_keys(spark):
    df = spark.range(200_000).select(F.when(F.col("id") < 199_000, "big").when(F.col("id") < 199_900, "small").alias("g"), (F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 7).alias("v"))
    df = df.union(spark.createDataFrame([("big", None), ("none", None)], "g string, v double"))
    got = {r["g"]: r["q"] for r in percentiles_by(df, ["g"], "v", [0.0, 0.25, 0.5, 0.999, 1.0], "q").collect()}
    own = df.toPandas().dropna(subset=["v"])
    for g in ("big", "small", None):
        v = own[own["g"].isna() if g is None else own["g"] == g]["v"]
        assert got[g] == pytest.approx(list(np.percentile(v, [0, 25, 50, 99.9, 100])))
    assert set(got) == {"big", "small", None}
    assert percentile(df, "v", 0.9) == pytest.approx(np.percentile(own["v"], 90)) and percentile(df.limit(0), "v", 0.5) is None
    runs = running_by(spark.createDataFrame([("a", 1, 2), (None, 1, 3), (None, 2, 4), ("a", 3, 5)], "g string, i int, n int"), ["g"], ["i"], {"upto": "n"}, {"all": "n"})
    assert sorted((str(r["g"]), r["i"], r["upto"], r["all"]) for r in runs.collect()) == [("None", 1, 3, 7), ("None", 2, 7, 7), ("a", 1, 2, 7), ("a", 3, 7, 7)]


def test_logistic_recalibration_of_odd_groups(spark):
    rng = random.Random(8)
    rows = [("a", p, int(rng.random() < 1 / (1 + math.exp(-(0.5 + 2 * math.log(p / (1 - p))))))) for p in (rng.uniform(0.05, 0.95) for _ in range(3000))]
    rows += [("one", 0.3, 1), ("split", 0.2, 0), ("split", 0.8, 1), (None, 0.4, 0), (None, 0.6, 1), ("a", 0.0, 1), ("a", 1.0, 0), ("a", None, 1), ("edge", 1.0, 1)]
    got = {r["g"]: r for r in regularised.platt(spark.createDataFrame(rows, "g string, p double, y int"), "g", "p", "y").collect()}
    assert set(got) == {"a", "one", "split", None} and got["a"]["n"] == 3000
    assert got["a"]["intercept"] == pytest.approx(0.5, abs=0.15) and got["a"]["slope"] == pytest.approx(2, abs=0.2) and got["a"]["calibrated"] < got["a"]["raw"]
    assert all(math.isfinite(r["slope"]) for r in got.values())


def test_chosen_penalty_equals_fits_on_rows(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(250, 3)) * [1, 5, 0]
    y = 2 * x[:, 0] + rng.normal(size=250)
    df = spark.createDataFrame([(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))] + [(999, None, 1.0, 1.0, 1.0)], "id long, a double, b double, c double, y double")
    table, terms = regularised.chosen_lasso(df, "id", ["a", "b", "c"], "y", [0.01, 0.3, 5.0], 4, "s")
    curve = {r["alpha"]: r for r in table.collect()}
    assert curve[5.0]["mse"] > curve[0.3]["mse"] and sum(r["least"] for r in curve.values()) == sum(r["one_error"] for r in curve.values()) == 1
    assert max(a for a, r in curve.items() if r["one_error"]) >= max(a for a, r in curve.items() if r["least"])
    found = {(r["rule"], r["term"]): r for r in terms.collect()}
    assert found["least", "a"]["positive"] == 4 and found["least", "c"]["zero"] == 4 and found["least", "c"]["beta"] == 0
    z = (x[:, 0] - x[:, 0].mean()) / x[:, 0].std()
    alpha = next(a for a, r in curve.items() if r["least"])
    assert found["least", "a"]["beta"] == pytest.approx(np.mean(z * (y - y.mean())) - alpha, abs=0.05)
    assert regularised.chosen_lasso(df.limit(0), "id", ["a"], "y", [0.1], 3, "s")[0].count() == 0


def test_parallel_analysis_keeps_what_is_above_noise(spark):
    rng = np.random.default_rng(11)
    f = rng.normal(size=(400, 1))
    x = np.hstack([f + 0.3 * rng.normal(size=(400, 3)), rng.normal(size=(400, 2)), np.ones((400, 1))])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)] + [(999, None, 1.0, 1.0, 1.0, 1.0, 1.0)], "id long, a double, b double, c double, d double, e double, f double")
    rows = spectra.parallel_analysis(df, "id", list("abcdef"), 8, 0.95, "s").collect()
    with np.errstate(invalid="ignore"):
        own = np.nan_to_num(np.corrcoef(x.T))
    own[5, 5] = 0
    assert [r["eigenvalue"] for r in rows] == pytest.approx(sorted(np.linalg.eigvalsh(own), reverse=True), abs=1e-9)
    assert [r["kept"] for r in rows] == [True] + [False] * 5 and all(r["noise"] <= r["cut"] for r in rows)


def test_component_usefulness_equals_fits_on_rows(spark):
    from tallyloom.functions.hashing import md5_share
    from tallyloom.operators.resample import key

    rng = np.random.default_rng(12)
    x = rng.normal(size=(150, 3)) * [4, 1, 0.5]
    y = x[:, 1] + 0.3 * rng.normal(size=150)
    df = spark.createDataFrame([(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))], "id long, a double, b double, c double, y double")
    fold = np.array([r["f"] for r in df.orderBy("id").select(F.floor(md5_share(key("s", "id")) * 4).cast("int").alias("f")).collect()])
    got = {(r["scaled"], r["k"]): r for r in spectra.component_usefulness(df, "id", ["a", "b", "c"], "y", 4, "s").collect()}
    for scaled in (False, True):
        own = (x - x.mean(0)) / (x.std(0) if scaled else 1)
        value, vector = np.linalg.eigh(np.cov(own.T, bias=True))
        for k in (1, 2, 3):
            assert got[scaled, k]["share"] == pytest.approx(value[::-1][:k].sum() / value.sum())
            assert got[scaled, k]["squared_r"] == pytest.approx(np.corrcoef(own @ vector[:, 3 - k], y)[0, 1] ** 2)
            error = level = 0.0
            for f in range(4):
                a, b = fold != f, fold == f
                m, s = x[a].mean(0), x[a].std(0) if scaled else 1
                w = np.linalg.eigh(np.cov(((x[a] - m) / s).T, bias=True))[1][:, ::-1][:, :k]
                z = [np.column_stack([(x[i] - m) / s @ w, np.ones(i.sum())]) for i in (a, b)]
                c = np.linalg.lstsq(z[0], y[a], rcond=None)[0]
                error, level = error + np.square(y[b] - z[1] @ c).sum(), level + np.square(y[b] - y[a].mean()).sum()
            assert got[scaled, k]["held_out"] == pytest.approx(1 - error / level)
    assert got[False, 1]["dominant"] == "a" and spectra.component_usefulness(df.limit(0), "id", ["a"], "y", 3, "s").count() == 0


def test_leverages_equal_refits_without_the_row(spark):
    rng = np.random.default_rng(13)
    x = np.column_stack([rng.normal(size=40), rng.normal(size=40), np.zeros(40)])
    x[0, 2] = 1.0  # one row alone decides the third coefficient
    y = x @ [1, -2, 5] + rng.normal(size=40)
    df = spark.createDataFrame([(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))] + [(99, None, 1.0, 1.0, 1.0)], "id long, a double, b double, c double, y double").repartition(3)
    got = {r["id"]: r for r in spectra.leverages(df, "id", ["a", "b", "c"], "y").collect()}
    z = np.column_stack([x, np.ones(40)])
    full = np.linalg.lstsq(z, y, rcond=None)[0]
    assert got[0]["leverage"] == pytest.approx(1) and got[0]["cook"] is None and got[0]["dfbeta"] is None and got[0]["flagged"] and len(got) == 40
    for i in range(1, 40):
        left = np.arange(40) != i
        move = full - np.linalg.lstsq(z[left], y[left], rcond=None)[0]
        assert got[i]["dfbeta"] == pytest.approx(list(move[:3]), abs=1e-8)
        s2 = np.square(y - z @ full).sum() / 36
        assert got[i]["cook"] == pytest.approx(move @ (z.T @ z) @ move / (4 * s2), abs=1e-9)


def test_months_of_nothing_go(spark):
    from tallyloom.operators.cleaning import months_long

    df = spark.createDataFrame([(2001, 1.0, 0.0, None), (2002, 0.0, 4.0, 5.0)], "year int, a double, b double, c double")
    assert sorted(tuple(r) for r in months_long(df, "year", ["a", "b", "c"]).collect()) == [(2001, 1, 1.0), (2002, 2, 4.0), (2002, 3, 5.0)]


def test_domain_weights_equal_plain_newton_steps(spark):
    rng = np.random.default_rng(14)
    x, y = rng.normal(size=(300, 3)) * [1, 4, 0], rng.random(300) < 0.3
    x[y, 0] += 1
    rows = [(i, *map(float, r), bool(t)) for i, (r, t) in enumerate(zip(x, y))] + [(900, None, 1.0, 1.0, True), (901, 1.0, 1.0, 1.0, None)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, new boolean").repartition(3)
    sd = np.where(x.std(0) > 0, x.std(0), 1)
    z, beta = np.column_stack([(x - x.mean(0)) / sd, np.ones(300)]), np.zeros(4)
    for _ in range(8):
        p = 1 / (1 + np.exp(-z @ beta))
        beta += np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + 1e-6 * np.eye(4), z.T @ (y - p) - 1e-6 * beta)
    got = {r["id"]: r["weight"] for r in regularised.domain_weights(df, "id", ["a", "b", "c"], "new").collect()}
    assert got == {i: pytest.approx(math.exp(z[i] @ beta) * (~y).sum() / y.sum()) for i in range(300) if not y[i]}
    assert regularised.domain_weights(df.filter("new"), "id", ["a"], "new").count() == 0


def test_gaps_are_drawn_once_for_all_studies(spark):
    """Every value of a gap's condition is asked for once a row, however many studies and rounds there are."""
    asked = spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def out(i):
        asked.add(1)
        return i % 3 == 0

    df = spark.createDataFrame([(i, float(i % 7), float(i % 7 + i % 2) if i else None) for i in range(60)], "id long, a double, b double").repartition(2)
    gaps = {"one": [out("id"), F.col("id") % 5 == 0], "none": [F.lit(False), F.lit(None).cast("boolean")]}
    studies = [("s", "one", "one"), ("t", "one", "none"), ("u", "one", "one")]
    got = {(r["study"], r["method"]): (r["cells"], r["rmse"]) for r in imputation.mechanism_errors(df, ["a", "b"], gaps, studies, 2).collect()}
    assert asked.value == 60
    # an unknown condition takes its cell out; a value that is null at first is no cell
    assert got["s", "chained"] == got["u", "chained"] and got["s", "mean"][0] == 20 + 11 and got["t", "mean"][0] == 59
    chain = imputation.fit_chain(df.select(F.when(F.col("id") % 3 != 0, F.col("a")).alias("a"), F.when(F.col("id") % 5 != 0, F.col("b")).alias("b")), ["a", "b"], 2)
    x = np.array([[np.nan if i % 3 == 0 else i % 7, np.nan if i % 5 == 0 else i % 7 + i % 2] for i in range(60)], float)
    truth = np.array([[i % 7, i % 7 + i % 2 if i else np.nan] for i in range(60)], float)
    at = np.isnan(x) & ~np.isnan(truth)
    assert got["s", "chained"][1] == pytest.approx(float(np.sqrt(np.square(((chain.fill(x) - truth) / np.nanstd(truth, 0))[at]).mean())))
