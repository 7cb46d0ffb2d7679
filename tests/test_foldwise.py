"""Leaks and searches against fits to the rows themselves."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.operators import foldwise as W

XS = ["a", "b", "c"]


def fitted(x, y, ridge, sd=None):
    sd = np.where(x.std(0) > 1e-9, x.std(0), np.inf) if sd is None else sd
    z = (x - x.mean(0)) / sd
    beta = np.linalg.lstsq(np.vstack([z, np.sqrt(ridge) * np.eye(x.shape[1])]), np.append(y - y.mean(), np.zeros(x.shape[1])), rcond=None)[0] / sd
    return lambda t: y.mean() + (t - x.mean(0)) @ beta


def mse(predict, x, y):
    return float(np.mean((predict(x) - y) ** 2))


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(21)
    n = 240
    x = rng.normal(size=(n, 3)) * [1.0, 5.0, 0.2] + [0.0, 3.0, 1.0]
    y = (x[:, 0] + 0.3 * x[:, 1] + rng.normal(size=n) > 1).astype(float)
    df = spark.createDataFrame([(i, *map(float, x[i]), float(y[i])) for i in range(n)], "id long, a double, b double, c double, y double")
    base = [r["h"] for r in df.orderBy("id").select(F.xxhash64(F.lit("s"), F.col("id").cast("string")).alias("h")).collect()]
    return df, x, y, np.array(base)


def test_leaks_equal_fits_to_rows(spark, rows):
    df, x, y, base = rows
    n, reps, folds, noise, levels = len(y), 2, 4, 12, 30
    got = {r["leak"]: r for r in W.leak_table(df, "id", XS, "y", "s", reps, folds, 0.25, levels, noise, 3).collect()}
    u = W.draws(base, noise + 3 + 1 + 2 * reps)
    seen, level = u[:, noise : noise + 3] >= 0.25, (u[:, noise + 3] * levels).astype(int)
    wide = np.column_stack([x, u[:, :noise]])
    want = {k: [] for k in got}

    def fill(by):
        m = np.array([x[by & seen[:, j], j].mean() for j in range(3)])
        return np.where(seen, x, m)

    def code(by):
        m = {k: y[by & (level == k)].mean() for k in range(levels) if (by & (level == k)).any()}
        return np.column_stack([[m.get(k, y[by].mean()) for k in level], x])

    def choose(by):
        r = np.abs([np.corrcoef(wide[by, j], y[by])[0, 1] for j in range(wide.shape[1])])
        return wide[:, sorted(np.argsort(-r, kind="stable")[:3])]

    for r in range(reps):
        one, two = ((u[:, noise + 4 + k * reps + r] * folds).astype(int) for k in (0, 1))
        every = np.ones(n, bool)
        for f in range(folds):
            a, b = one != f, one == f
            score = lambda m, sd=None: mse(fitted(m[a], y[a], 1.0, sd), m[b], y[b])
            want["standardise"].append((score(x, x.std(0)), score(x)))
            want["impute"].append((score(fill(every)), score(fill(a))))
            want["encode"].append((score(code(every)), score(code(a))))
            want["select"].append((score(choose(every)), score(choose(a))))
            xx, yy, apart = np.vstack([x, x]), np.append(y, y), np.append(one, two)
            together = np.append(one, one)
            want["duplicate"].append(tuple(mse(fitted(xx[d != f], yy[d != f], 1.0), xx[d == f], yy[d == f]) for d in (apart, together)))
    assert set(got) == {"standardise", "impute", "encode", "select", "duplicate"}
    for k, v in want.items():
        leaky, honest = np.mean(v, axis=0)
        assert np.allclose([got[k]["leaky"], got[k]["honest"], got[k]["gap"]], [leaky, honest, honest - leaky], atol=1e-8), k
        assert got[k]["uses_label"] == (k in ("encode", "select"))
    assert got["encode"]["gap"] > 10 * abs(got["standardise"]["gap"])


def test_searches_equal_fits_to_rows(spark, rows):
    df, x, y, base = rows
    reps, folds = 3, 3
    got = {r["size"]: r for r in W.nested_tuning(df, "id", XS, "y", "s", [1, 9], reps, 0.5, folds).collect()}
    u = W.draws(base, 2 * reps)
    for size in (1, 9):
        grid, per = W.grid(size, 3), []
        for r in range(reps):
            drawn = u[:, r] < 0.5
            cell = np.where(drawn, (u[:, reps + r] * folds * folds).astype(int), -1)
            outer, inner = np.where(drawn, cell // folds, -1), np.where(drawn, cell % folds, -1)

            def cv(mask, g):
                ridge, k = g
                return np.mean([mse(fitted(x[mask & (inner != f), :k], y[mask & (inner != f)], ridge), x[mask & (inner == f), :k], y[mask & (inner == f)]) for f in range(folds)])

            fit = lambda mask, g: fitted(x[mask, : g[1]], y[mask], g[0])
            errors = [cv(drawn, g) for g in grid]
            fresh = [mse(fit(drawn, g), x[~drawn, : g[1]], y[~drawn]) for g in grid]
            nested = []
            for o in range(folds):
                rest = drawn & (outer != o)
                g = grid[int(np.argmin(np.round([cv(rest, g) for g in grid], 12)))]
                nested.append(mse(fit(rest, g), x[outer == o, : g[1]], y[outer == o]))
            best = int(np.argmin(np.round(errors, 12)))
            per.append((errors[best], fresh[best], min(fresh), np.mean(nested)))
        e, g = np.array(per), got[size]
        assert g["settings"] == len(grid)
        assert np.allclose([g["best"], g["fresh"], g["oracle"], g["nested"]], e.mean(0), atol=1e-8)
        for name, d in (("optimism", e[:, 1] - e[:, 0]), ("nested_gap", e[:, 1] - e[:, 3])):
            assert np.allclose([g[name], g[f"{name}_se"]], [d.mean(), d.std(ddof=1) / np.sqrt(reps)], atol=1e-8)
    assert got[1]["settings"] == 1 and got[9]["settings"] == 9


def test_studies_of_few_rows_have_no_rows(spark):
    columns = "id long, a double, b double, c double, y double"
    for rows in ([], [(1, 1.0, 2.0, 3.0, 1.0)], [(i, None, 1.0, 1.0, 1.0) for i in range(9)], [(None, 1.0, 1.0, 1.0, 1.0)] * 9):
        df = spark.createDataFrame(rows, columns)
        assert W.leak_table(df, "id", XS, "y", "s", 2, 3).count() == 0 and W.nested_tuning(df, "id", XS, "y", "s", [1, 4]).count() == 0
    constant = spark.createDataFrame([(i, 1.0, float(i), 2.0, 1.0) for i in range(60)], columns)
    assert all(abs(r["leaky"]) < 1e-12 for r in W.leak_table(constant, "id", XS, "y", "s", 1, 3).collect())
