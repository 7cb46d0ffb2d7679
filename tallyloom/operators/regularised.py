"""Fits with a penalty that the data choose, and scores recalibrated by a logistic curve."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.blocks import summed, vectors
from tallyloom.functions.hashing import md5_share
from tallyloom.functions.storage import written
from tallyloom.operators.resample import key


def platt(df: DataFrame, by: str, p: str, y: str, steps: int = 8, ridge: float = 1e-6) -> DataFrame:
    """(by, n, intercept, slope, raw, calibrated): the logistic fit of 0/1 labels to the log-odds of scores between 0 and 1, after so many of Newton's steps from
    intercept 0 and slope 1, and the mean log loss of the scores and of the fit. A step is one aggregate of five sums by group, over scores that are
    counted first; groups may be many. `ridge` is the penalty on both coefficients' squares, which keeps separable groups finite. Scores of 0 and 1, and
    nulls, are left out."""
    c = F.col(p).cast("double")
    d = df.filter((c > 0) & (c < 1) & F.col(y).isNotNull()).groupBy(F.col(by).alias("g"), F.log(c / (1 - c)).alias("z")).agg(F.count("*").cast("double").alias("n"), F.sum(F.col(y).cast("double")).alias("s"))
    d = written(d, "scores")
    state = d.select("g").distinct().select(F.col("g").alias("k"), F.lit(0.0).alias("a"), F.lit(1.0).alias("b"))
    same = F.col("g").eqNullSafe(F.col("k"))
    for _ in range(steps):
        q = 1 / (1 + F.exp(-(F.col("a") + F.col("b") * F.col("z"))))
        w, left = F.col("n") * q * (1 - q), F.col("s") - F.col("n") * q
        sums = d.join(state, same).groupBy("k", "a", "b").agg(F.sum(left).alias("u"), F.sum(left * F.col("z")).alias("v"), (F.sum(w) + ridge).alias("aa"), F.sum(w * F.col("z")).alias("ab"), (F.sum(w * F.col("z") * F.col("z")) + ridge).alias("bb"))
        u, v = F.col("u") - ridge * F.col("a"), F.col("v") - ridge * F.col("b")
        det = F.col("aa") * F.col("bb") - F.col("ab") * F.col("ab")
        state = written(sums.select("k", (F.col("a") + (F.col("bb") * u - F.col("ab") * v) / det).alias("a"), (F.col("b") + (F.col("aa") * v - F.col("ab") * u) / det).alias("b")), "state")
    loss = lambda t: F.sum(F.col("n") * F.log(1 + F.exp(t)) - F.col("s") * t) / F.sum("n")
    fit = d.join(state, same).groupBy("k", "a", "b").agg(F.sum("n").cast("long").alias("n"), loss(F.col("z")).alias("raw"), loss(F.col("a") + F.col("b") * F.col("z")).alias("calibrated"))
    return fit.select(F.col("k").alias(by), "n", F.col("a").alias("intercept"), F.col("b").alias("slope"), "raw", "calibrated")


def _lasso(m: np.ndarray, alpha: float, sweeps: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From the matrix of products of (columns, y, 1) the standardised coefficients by coordinate descent, and the columns' and y's means and the columns' deviations."""
    p, n = len(m) - 2, m[-1, -1]
    mean = m[-1, :-1] / n
    cov = m[:-1, :-1] / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov)[:p], 0))
    sd = np.where(sd > 1e-12 * np.maximum(1, np.abs(mean[:p])), sd, np.inf)
    r, c, beta = cov[:p, :p] / np.outer(sd, sd), cov[:p, p] / sd, np.zeros(p)
    for _ in range(sweeps):
        for j in range(p):
            left = c[j] - r[j] @ beta + r[j, j] * beta[j]
            beta[j] = np.sign(left) * max(abs(left) - alpha, 0.0)
    return beta, mean, sd


def chosen_lasso(df: DataFrame, row_id: str, xs: list[str], y: str, alphas: list[float], folds: int, seed: str, sweeps: int = 200) -> tuple[DataFrame, DataFrame]:
    """(alpha, mse, error, least, one_error) for each penalty: its mean squared error over held-out folds, the standard error of that (deviation of the folds' errors over
    the root of their number), whether it is least, and whether it is the largest penalty within one standard error of the least; and (rule, term, beta, positive,
    negative, zero) for both choices: standardised coefficients on all rows, and in how many folds the coefficient has each sign.

    Folds follow from a hash of the id. All fits and errors follow from one matrix of products for each fold, so rows are read once. Rows with nulls are left
    out; constant columns have coefficient 0; folds without rows don't count."""
    cols = [F.col(c).cast("double") for c in (*xs, y)]
    d = df.select(F.array(*cols, F.lit(1.0)).alias("v"), F.floor(md5_share(key(seed, row_id)) * folds).cast("int").alias("f")).filter(~F.exists("v", lambda x: x.isNull() | F.isnan(x)))
    p = len(xs)

    def add(t, batch):
        x, f = vectors(batch.column("v"), batch.num_rows), batch.column("f").to_numpy()
        for i in range(folds):
            t[0][i] += x[f == i].T @ x[f == i]

    (grams,) = summed(d, ["v", "f"], [(folds, p + 2, p + 2)], add)
    total, spark = grams.sum(0), df.sparkSession
    own = [g for g in grams if 0 < g[-1, -1] < total[-1, -1]]
    rows, fits = [], {}
    for alpha in alphas:
        errors, signs = [], []
        for g in own:
            beta, mean, sd = _lasso(total - g, alpha, sweeps)
            b = np.append(beta / sd, [-1.0, mean[p] - (beta / sd) @ mean[:p]])
            errors.append(float(b @ g @ b / g[-1, -1]))
            signs.append(np.sign(np.round(beta, 12)))
        if errors:
            rows.append((float(alpha), float(np.mean(errors)), float(np.std(errors) / np.sqrt(len(errors)))))
            fits[float(alpha)] = np.array(signs)
    curve, terms = "alpha double, mse double, error double, least boolean, one_error boolean", "rule string, term string, beta double, positive long, negative long, zero long"
    if not rows:
        return spark.createDataFrame([], curve), spark.createDataFrame([], terms)
    least = min(rows, key=lambda r: (round(r[1], 9), -r[0]))
    wide = max(r[0] for r in rows if r[1] <= least[1] + least[2])
    table = spark.createDataFrame([(*r, r[0] == least[0], r[0] == wide) for r in rows], curve)
    out = []
    for rule, alpha in (("least", least[0]), ("one error", wide)):
        beta = _lasso(total, alpha, sweeps)[0]
        out += [(rule, x, float(beta[j]), *(int((fits[alpha][:, j] == s).sum()) for s in (1, -1, 0))) for j, x in enumerate(xs)]
    return table, spark.createDataFrame(out, terms)


def domain_weights(df: DataFrame, row_id: str, features: list[str], new: str, steps: int = 8, ridge: float = 1e-6) -> DataFrame:
    """(id, weight) of the rows whose flag `new` is false: how much likelier a row is among the new ones, by a logistic classifier of the flag: p / (1 - p) times the number of
    old rows over that of new ones. Features are divided by their deviations about their means; the fit takes so many of Newton's steps from 0 with a penalty of
    `ridge` on all coefficients' squares. A step is one pass of sums. Rows with nulls are left out; without rows of both kinds there are no weights."""
    p = len(features)
    d = df.select(F.col(row_id).alias("id"), F.array(*[F.col(f).cast("double") for f in features], F.lit(1.0)).alias("v"), F.col(new).cast("double").alias("y")).filter(~F.exists("v", lambda x: x.isNull() | F.isnan(x)) & F.col("y").isNotNull())

    def moments(t, batch):
        x = vectors(batch.column("v"), batch.num_rows)
        t[0] += x.sum(0)
        t[1] += np.square(x).sum(0)
        t[2] += batch.column("y").to_numpy().sum()

    s, q, n_new = summed(d, ["v", "y"], [(p + 1,), (p + 1,), (1,)], moments)
    n, n_new = s[-1], float(n_new[0])
    if not 0 < n_new < n:
        return d.select("id", F.lit(0.0).alias("weight")).limit(0)
    mean = np.append(s[:p] / n, 0.0)
    sd = np.append(np.sqrt(np.maximum(q[:p] / n - mean[:p] ** 2, 0)), 1.0)
    sd, beta = np.where(sd > 1e-12, sd, 1.0), np.zeros(p + 1)
    for _ in range(steps):

        def newton(t, batch, beta=beta):
            x = (vectors(batch.column("v"), batch.num_rows) - mean) / sd
            prob = 1 / (1 + np.exp(-(x @ beta)))
            t[0] += x.T @ (batch.column("y").to_numpy() - prob)
            t[1] += x.T @ (x * (prob * (1 - prob))[:, None])

        g, h = summed(d, ["v", "y"], [(p + 1,), (p + 1, p + 1)], newton)
        beta = beta + np.linalg.solve(h + ridge * np.eye(p + 1), g - ridge * beta)
    odds = F.aggregate(F.zip_with("v", F.array(*[F.lit(float(b)) for b in beta / sd]), lambda a, b: a * b), F.lit(float(-(beta / sd) @ mean)), lambda a, b: a + b)
    return d.filter("y = 0").select("id", (F.exp(odds) * ((n - n_new) / n_new)).alias("weight"))
