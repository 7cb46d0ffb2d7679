"""Regression and matrix operators from distributed sums of products.

One pass sums x_i x_j by group; a group's p x p matrix is solved in Arrow
batches of such rows. Rows never leave the executors, so a group may be of any
size; p is a few hundred at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.storage import written


def gram(df: DataFrame, by: str, columns: list[str | Column], weight: Column | None = None) -> DataFrame:
    """(by, n, gram): the p x p sums of products, row by row, over rows without nulls."""
    cols = [F.col(c) if isinstance(c, str) else c for c in columns]
    p = len(cols)
    named = df.select(F.col(by).alias(by), *[c.cast("double").alias(f"_x{i}") for i, c in enumerate(cols)], (F.lit(1.0) if weight is None else weight).alias("_w")).na.drop()
    sums = [F.sum(F.col("_w") * F.col(f"_x{i}") * F.col(f"_x{j}")).alias(f"_s{i}_{j}") for i in range(p) for j in range(i, p)]
    g = named.groupBy(by).agg(F.count("*").alias("n"), *sums)
    return g.select(by, "n", F.array(*[F.col(f"_s{min(i, j)}_{max(i, j)}") for i in range(p) for j in range(p)]).alias("gram"))


def centred_gram(df: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """(by, n, gram, mean): sums of products of the columns less their group's means, over rows without nulls. A first pass gets the means, so that
    columns with a large mean and a small spread keep their digits."""
    p = len(columns)
    rows = df.select(F.col(by).alias(by), *[F.col(c).cast("double").alias(f"_c{i}") for i, c in enumerate(columns)]).na.drop(subset=[f"_c{i}" for i in range(p)])
    means = rows.groupBy(F.col(by).alias("_by")).agg(*[F.avg(f"_c{i}").alias(f"_m{i}") for i in range(p)])
    less = rows.join(means, F.col(by).eqNullSafe(F.col("_by"))).select(by, *[(F.col(f"_c{i}") - F.col(f"_m{i}")).alias(f"_d{i}") for i in range(p)])
    g = gram(less, by, [f"_d{i}" for i in range(p)])
    return g.join(means, F.col(by).eqNullSafe(F.col("_by"))).select(by, "n", "gram", F.array(*[F.col(f"_m{i}") for i in range(p)]).alias("mean"))


def _solved(g: DataFrame, by: str, p: int, schema: str, f) -> DataFrame:
    """Applies f(key, n, matrix) -> rows, or f(n, matrix, mean) where there are means, to every row of a gram table."""
    kind = g.schema[by].dataType.simpleString()
    names = [x.split()[0] for x in schema.split(", ")]
    more = ["mean"] if "mean" in g.columns else []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(k, *row) for k, n, m, *rest in zip(b[by], b["n"], b["gram"], *[b[c] for c in more]) for row in f(n, np.array(m, float).reshape(p, p), *[np.array(r, float) for r in rest])]
            yield pd.DataFrame(out, columns=[by, *names])

    return g.mapInPandas(run, f"{by} {kind}, {schema}")


def _scaled(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A matrix of products with a diagonal of ones, and the roots of its old one; columns of nothing have a root of 1 and a diagonal of 0."""
    d = np.sqrt(np.maximum(np.diag(m), 0))
    d[d == 0] = 1
    return m / np.outer(d, d), d


def ols(df: DataFrame, by: str, xs: list[str], y: str, intercept: bool = True) -> DataFrame:
    """(by, term, beta, se, t, r2, n) of a regression for each group. A singular design has null estimates. With an intercept columns are taken from their
    means, and in any case they are scaled before the rank is judged and the equations are solved."""
    terms = ["(intercept)"] * intercept + xs
    g = centred_gram(df, by, [*xs, y]) if intercept else gram(df, by, [*xs, y])
    p, k = len(xs), len(terms)

    def solve(n, m, mean=None):
        r, d = _scaled(m[:p, :p])
        xy, yy = m[:p, p], m[p, p]
        if n <= k or np.linalg.matrix_rank(r) < p:
            return [(t, None, None, None, None, int(n)) for t in terms]
        inverse = np.linalg.inv(r) / np.outer(d, d)
        beta = np.linalg.solve(r, xy / d) / d
        rss = max(0.0, yy - beta @ xy)
        s2, var = rss / (n - k), np.diag(inverse)
        if intercept:
            beta, var = np.append(mean[p] - beta @ mean[:p], beta), np.append(1 / n + mean[:p] @ inverse @ mean[:p], var)
        se = np.sqrt(var * s2)
        return [(t, float(b), float(s), float(b / s) if s > 0 else None, float(1 - rss / yy) if yy > 0 else None, int(n)) for t, b, s in zip(terms, beta, se)]

    return _solved(g, by, p + 1, "term string, beta double, se double, t double, r2 double, n long", solve)


def ridge_path(df: DataFrame, by: str, xs: list[str], y: str, alphas: list[float]) -> DataFrame:
    """(by, alpha, term, beta, df): (X'X + alpha I)^-1 X'y for every alpha from one decomposition; the intercept is penalised like the rest, nothing is standardised."""
    terms = ["(intercept)", *xs]
    p = len(terms)

    def solve(n, m):
        values, vectors = np.linalg.eigh(m[:p, :p])
        values = np.maximum(values, 0)
        xy = vectors.T @ m[:p, p]
        return [(float(a), t, float(b), float(np.sum(values / (values + a)) if a > 0 else np.sum(values > 0))) for a in alphas for t, b in zip(terms, vectors @ (xy / (values + a)))]

    return _solved(gram(df, by, [F.lit(1.0), *xs, y]), by, p + 1, "alpha double, term string, beta double, df double", solve)


def vif(df: DataFrame, by: str, xs: list[str]) -> DataFrame:
    """(by, term, vif): the diagonal of the inverse correlation matrix; infinite for a column that others determine."""
    def solve(n, m, mean):
        r, _ = _scaled(m)
        v = np.diag(np.linalg.inv(r)) if np.linalg.matrix_rank(r) == len(xs) else np.full(len(xs), np.inf)
        return [(t, float(x)) for t, x in zip(xs, v)]

    return _solved(centred_gram(df, by, xs), by, len(xs), "term string, vif double", solve)


def condition(df: DataFrame, by: str, xs: list[str]) -> DataFrame:
    """(by, variant, kappa, digits): condition numbers of the raw, the centred, the column-scaled and the standardised design, all from one matrix."""
    def solve(n, m, mean):
        centred = m
        raw = m + n * np.outer(mean, mean)
        scaled = raw / np.sqrt(np.outer(np.diag(raw), np.diag(raw)))
        standard = centred / np.sqrt(np.outer(np.diag(centred), np.diag(centred)))
        out = []
        for name, c in (("raw", raw), ("centred", centred), ("scaled", scaled), ("standardised", standard)):
            v = np.linalg.eigvalsh(c)
            k = float(np.sqrt(v[-1] / v[0])) if v[0] > 0 else float("inf")
            out.append((name, k, float(np.log10(k))))
        return out

    return _solved(centred_gram(df, by, xs), by, len(xs), "variant string, kappa double, digits double", solve)


def spectrum(df: DataFrame, by: str, xs: list[str]) -> DataFrame:
    """(by, component, eigenvalue, share, gap, vector) of the correlation matrix, largest first; the sign makes the largest entry positive."""
    def solve(n, m, mean):
        values, vectors = np.linalg.eigh(_scaled(m)[0])
        values, vectors = values[::-1], vectors[:, ::-1]
        out = []
        for i, v in enumerate(values):
            x = vectors[:, i] * np.sign(vectors[np.argmax(np.abs(vectors[:, i])), i])
            out.append((i, float(v), float(v / values.sum()), float(v - values[i + 1]) if i + 1 < len(values) else None, [float(z) for z in x]))
        return out

    return _solved(centred_gram(df, by, xs), by, len(xs), "component int, eigenvalue double, share double, gap double, vector array<double>", solve)


def psd_repair(df: DataFrame, by: str, xs: list[str], min_overlap: int = 4) -> DataFrame:
    """(by, least, is_psd, change) of the matrix of pairwise correlations over rows that have both: its least eigenvalue, and the largest change
    of an entry when negative eigenvalues are cut and the diagonal is made 1 again."""
    pairs = pairwise_correlation(df, by, xs, min_overlap).groupBy(by).agg(F.sort_array(F.collect_list(F.struct("a", "b", "r"))).alias("p"))
    kind, size, order = df.schema[by].dataType.simpleString(), len(xs), {x: i for i, x in enumerate(xs)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, ps in zip(batch[by], batch["p"]):
                s = np.eye(size)
                for e in ps:
                    i, j = order[e["a"]], order[e["b"]]
                    s[i, j] = s[j, i] = np.nan if e["r"] is None else e["r"]
                if np.isnan(s).any():
                    out.append((k, None, None, None))
                    continue
                v, u = np.linalg.eigh(s)
                fixed = (u * np.maximum(v, 0)) @ u.T
                d = np.sqrt(np.diag(fixed))
                fixed = fixed / np.outer(d, d)
                out.append((k, float(v[0]), bool(v[0] >= -1e-10 * max(1, np.abs(s).max())), float(np.abs(fixed - s).max())))
            yield pd.DataFrame(out, columns=[by, "least", "is_psd", "change"])

    return pairs.mapInPandas(run, f"{by} {kind}, least double, is_psd boolean, change double")


def pairwise_correlation(df: DataFrame, by: str, xs: list[str], min_overlap: int = 4) -> DataFrame:
    """(by, a, b, r, n) of every two columns over rows that have both; null below a minimum of rows. All pairs are sums of one pass."""
    aggs = []
    for i, j in combinations(range(len(xs)), 2):
        aggs += [F.corr(xs[i], xs[j]).alias(f"_r{i}_{j}"), F.count_if(F.col(xs[i]).isNotNull() & F.col(xs[j]).isNotNull()).alias(f"_n{i}_{j}")]
    g = df.groupBy(by).agg(*aggs)
    rows = [F.struct(F.lit(xs[i]).alias("a"), F.lit(xs[j]).alias("b"), F.col(f"_r{i}_{j}").alias("r"), F.col(f"_n{i}_{j}").alias("n")) for i, j in combinations(range(len(xs)), 2)]
    return g.select(by, F.explode(F.array(*rows)).alias("p")).select(by, "p.a", "p.b", F.when(F.col("p.n") >= min_overlap, F.col("p.r")).alias("r"), "p.n")


def complete_case_correlation(df: DataFrame, by: str, xs: list[str]) -> DataFrame:
    """The same over the rows that have every column."""
    return pairwise_correlation(df.na.drop(subset=xs), by, xs, 1)


def leverage(df: DataFrame, by: str, row: str, x: str, y: str) -> DataFrame:
    """(by, row, h, residual, cook, flagged) of a regression on one regressor: sums by group, then columns. Saturated rows have a null distance."""
    m = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    s = m.groupBy(by).agg(F.count("*").alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.regr_sxx(y, x).alias("sxx"), F.regr_sxy(y, x).alias("sxy"), F.regr_syy(y, x).alias("syy"))
    d = m.select(by, row, x, y).join(s, by)
    slope = F.col("sxy") / F.col("sxx")
    h = 1 / F.col("n") + F.pow(F.col(x) - F.col("mx"), F.lit(2)) / F.col("sxx")
    e = F.col(y) - F.col("my") - slope * (F.col(x) - F.col("mx"))
    s2 = (F.col("syy") - slope * F.col("sxy")) / (F.col("n") - 2)
    d = d.select(by, row, h.alias("h"), e.alias("residual"), s2.alias("s2"), "n")
    cook = F.when(F.col("h") < 1 - 1e-10, F.col("residual") * F.col("residual") * F.col("h") / (2 * F.col("s2") * F.pow(1 - F.col("h"), F.lit(2))))
    return d.select(by, row, "h", "residual", cook.alias("cook"), (F.col("h") > 6 / F.col("n")).alias("flagged"))


def irls(df: DataFrame, xs: list[str], y: str, max_iter: int = 50, tol: float = 1e-10, ridge: float = 0.0, floor: float = 1e-10) -> list[dict]:
    """Logistic regression by weighted least squares: each step is one sum of products over the rows, which are written once; the last step's estimates and
    standard errors."""
    terms = ["(intercept)", *xs]
    rows = written(df.select(F.lit(1).alias("k"), *[F.col(c).cast("double").alias(c) for c in xs], F.col(y).cast("double").alias("y")).na.drop(), "irls")
    beta = np.zeros(len(terms))
    cov = np.eye(len(terms))
    for _ in range(max_iter):
        eta = sum((float(b) * F.col(c) for b, c in zip(beta[1:], xs)), F.lit(float(beta[0])))
        p = 1 / (1 + F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), eta))))
        w = F.greatest(p * (1 - p), F.lit(floor))
        z = eta + (F.col("y") - p) / w
        g = gram(rows.select("k", *xs, w.alias("w"), z.alias("z")), "k", [F.lit(1.0), *xs, "z"], F.col("w")).first()
        m = np.array(g["gram"]).reshape(len(terms) + 1, -1)
        a = m[:-1, :-1] + ridge * np.eye(len(terms))
        new, cov = np.linalg.solve(a, m[:-1, -1]), np.linalg.inv(a)
        done = np.max(np.abs(new - beta)) < tol
        beta = new
        if done:
            break
    return [{"term": t, "beta": float(b), "se": float(s)} for t, b, s in zip(terms, beta, np.sqrt(np.diag(cov)))]


def separation(df: DataFrame, columns: list[str], y: str) -> DataFrame:
    """(column, level, rows, outcome) of levels with one outcome only."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("level")) for c in columns])).alias("c"), F.col(y).alias("y")).select("c.*", "y")
    g = long.groupBy("column", "level").agg(F.count("*").alias("rows"), F.min("y").alias("lo"), F.max("y").alias("hi"))
    return g.filter("lo = hi").select("column", "level", "rows", F.col("lo").alias("outcome"))


def adf(df: DataFrame, series: str, order: str, value: str) -> DataFrame:
    """(series, t, gamma, n): the t of the level's coefficient in a regression of the change on a constant and the level before."""
    w = Window.partitionBy(series).orderBy(order)
    d = df.select(series, (F.col(value) - F.lag(value).over(w)).alias("d"), F.lag(value).over(w).alias("l")).filter("d is not null and l is not null")
    g = d.groupBy(series).agg(F.regr_slope("d", "l").alias("gamma"), F.regr_sxx("d", "l").alias("sxx"), F.regr_syy("d", "l").alias("syy"), F.regr_sxy("d", "l").alias("sxy"), F.count("*").alias("n"))
    se = F.sqrt((F.col("syy") - F.col("gamma") * F.col("sxy")) / (F.col("n") - 2) / F.col("sxx"))
    return g.select(series, (F.col("gamma") / se).alias("t"), "gamma", "n")


def cointegration(pairs: DataFrame, key: str, order: str, x: str, y: str) -> DataFrame:
    """(key, t, n): the same without a constant on the residuals of y on x, for each pair of series."""
    s = pairs.groupBy(key).agg(F.regr_slope(y, x).alias("b"), F.regr_intercept(y, x).alias("a"))
    e = pairs.join(s, key).select(key, order, (F.col(y) - F.col("a") - F.col("b") * F.col(x)).alias("e"))
    w = Window.partitionBy(key).orderBy(order)
    d = e.select(key, (F.col("e") - F.lag("e").over(w)).alias("d"), F.lag("e").over(w).alias("l")).filter("d is not null")
    g = d.groupBy(key).agg(F.sum(F.col("d") * F.col("l")).alias("dl"), F.sum(F.col("l") * F.col("l")).alias("ll"), F.sum(F.col("d") * F.col("d")).alias("dd"), F.count("*").alias("n"))
    gamma = F.col("dl") / F.col("ll")
    return g.select(key, (gamma / F.sqrt((F.col("dd") - gamma * F.col("dl")) / (F.col("n") - 1) / F.col("ll"))).alias("t"), "n")


def break_scan(df: DataFrame, series: str, order: str, value: str, trim: float = 0.15, bend: bool = False) -> DataFrame:
    """(series, tau, coef, t, ssr) of a step, or a bend, at every inner date, beside a constant and a trend.

    The value and each candidate are taken free of constant and trend by sums
    that are closed in tau or windows over the series, so a series costs one
    pass, not one regression a date.
    """
    w = Window.partitionBy(series).orderBy(order)
    upto = w.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(series)
    d = df.select(series, order, F.col(value).alias("y"), (F.row_number().over(w) - 1).cast("double").alias("i"), F.count("*").over(whole).cast("double").alias("n"))
    m, s1 = (F.col("n") - 1) / 2, F.col("n") * (F.col("n") * F.col("n") - 1) / 12
    d = d.withColumns({"my": F.avg("y").over(whole), "b": F.sum((F.col("i") - m) * F.col("y")).over(whole) / s1})
    d = d.withColumn("e", F.col("y") - F.col("my") - F.col("b") * (F.col("i") - m))
    # sums from a row on are totals less running sums: a frame that is open ahead would be summed again for every row
    left = lambda c: F.sum(c).over(whole) - F.coalesce(F.sum(c).over(upto), F.lit(0.0))
    d = d.withColumns({"ee": F.sum(F.col("e") * F.col("e")).over(whole), "after": left(F.col("e")), "after_i": left(F.col("e") * F.col("i"))})
    n, tau, k = F.col("n"), F.col("i"), F.col("n") - F.col("i")
    if bend:
        # z = max(i - tau, 0): its sums over i
        z1, z2 = k * (k - 1) / 2, (k - 1) * k * (2 * k - 1) / 6
        zi = z2 + tau * z1
        ze = F.col("after_i") - tau * F.col("after")
    else:
        z1 = z2 = k
        zi = k * (tau + n - 1) / 2
        ze = F.col("after")
    zz = z2 - z1 * z1 / n - F.pow(zi - m * z1, F.lit(2)) / s1
    coef = ze / zz
    ssr = F.col("ee") - ze * coef
    inner = (tau >= F.floor(n * trim)) & (tau < F.ceil(n * (1 - trim)))
    return d.filter(inner).select(series, tau.cast("long").alias("tau"), coef.alias("coef"), (coef / F.sqrt(ssr / (n - 3) / zz)).alias("t"), ssr.alias("ssr"))


def best_break(scan: DataFrame, series: str) -> DataFrame:
    """(series, tau, coef, sup_t, above): the date of least squares, the largest |t|, and the share of dates with |t| above 1.96."""
    return scan.groupBy(series).agg(F.min_by("tau", F.struct("ssr", "tau")).alias("tau"), F.min_by("coef", F.struct("ssr", "tau")).alias("coef"), F.max(F.abs("t")).alias("sup_t"), F.avg((F.abs("t") > 1.96).cast("double")).alias("above"))


def shape_race(steps: DataFrame, bends: DataFrame, series: str) -> DataFrame:
    """(series, shape, gain): the shape of less squared error at its best date, and 1 - least / largest."""
    a = steps.groupBy(series).agg(F.min("ssr").alias("step"))
    b = bends.groupBy(series).agg(F.min("ssr").alias("bend"))
    return a.join(b, series).select(series, F.when(F.col("step") <= F.col("bend"), "step").otherwise("bend").alias("shape"), (1 - F.least("step", "bend") / F.greatest("step", "bend")).alias("gain"))


def hac_step(df: DataFrame, series: str, order: str, x: str, y: str, lags: int) -> DataFrame:
    """(series, beta, se_ols, se_hac, n) of y on x with an intercept: Bartlett-weighted products of scores, scaled by n / (n - 2)."""
    d = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    s = d.groupBy(series).agg(F.count("*").alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.regr_sxx(y, x).alias("sxx"), F.regr_sxy(y, x).alias("sxy"), F.regr_syy(y, x).alias("syy"))
    beta = F.col("sxy") / F.col("sxx")
    c = F.col(x) - F.col("mx")
    u = d.join(s, series).select(series, order, "n", "sxx", beta.alias("beta"), ((F.col("syy") - beta * F.col("sxy")) / (F.col("n") - 2) / F.col("sxx")).alias("v"), (c * (F.col(y) - F.col("my") - beta * c)).alias("u"))
    w = Window.partitionBy(series).orderBy(order)
    u = u.withColumns({f"u{i}": F.lag("u", i).over(w) for i in range(1, lags + 1)})
    total = F.sum(F.col("u") * F.col("u")) + sum((2 * (1 - i / (lags + 1)) * F.coalesce(F.sum(F.col("u") * F.col(f"u{i}")), F.lit(0.0)) for i in range(1, lags + 1)), F.lit(0.0))
    g = u.groupBy(series, "n", "sxx", "beta", "v").agg(total.alias("meat"))
    return g.select(series, "beta", F.sqrt("v").alias("se_ols"), F.sqrt(F.col("meat") * F.col("n") / (F.col("n") - 2) / (F.col("sxx") * F.col("sxx"))).alias("se_hac"), "n")
