"""Studies of small learners whose fits are sums: retraining, stacking, extrapolation, penalties, mixtures, monotone fits, equivariance, ranks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.hashing import md5_normal_pair, md5_share
from tallyloom.functions.special import normal_cdf
from tallyloom.functions.ranks import percentile
from tallyloom.functions.storage import written
from tallyloom.operators.linear import _scaled, _solved, centred_gram
from tallyloom.operators.resample import key, poisson, with_replicates
from tallyloom.operators.validation import isotonic

_SUMS = ("n", "sx", "sy", "sxx", "sxy", "syy")


def _sums(x: Column, y: Column) -> list[Column]:
    return [F.count("*").cast("double").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"), F.sum(x * y).alias("sxy"), F.sum(y * y).alias("syy")]


def _line(prefix: str) -> tuple[Column, Column]:
    """Slope and intercept from sums; a mean where x has no spread."""
    n, sx, sy, sxx, sxy = (F.col(prefix + c) for c in _SUMS[:5])
    spread = sxx - sx * sx / n
    b = F.when(spread > 1e-12, (sxy - sx * sy / n) / spread).otherwise(0.0)
    return b, (sy - b * sx) / n


def retraining(df: DataFrame, period: str, x: str, y: str, warm: int, delays: list[int], windows: list[int]) -> DataFrame:
    """(policy, delay, period, mse) of a line that is fitted once to the first `warm` periods (static), to all that is labelled (expanding), or to the last w
    labelled periods (window w); labels come `delay` periods late. Periods are one row of sums, which policies add up; columns are taken from
    their means first."""
    m = df.agg(F.avg(x), F.avg(y)).first()
    per = written(df.groupBy(F.col(period).cast("long").alias("t")).agg(*_sums(F.col(x) - m[0], F.col(y) - m[1])), "periods")
    start = per.agg(F.min("t")).first()[0] or 0
    own = Window.orderBy("t")  # one row a period
    out = None
    for delay in delays:
        policies = {"static": None, "expanding": own.rangeBetween(Window.unboundedPreceding, -1 - delay)} | {f"window {w}": own.rangeBetween(-w - delay, -1 - delay) for w in windows}
        for name, frame in policies.items():
            if frame is None:
                first = per.filter(F.col("t") < start + warm).agg(*[F.sum(c).alias(c) for c in _SUMS]).first()
                d = per.withColumns({f"t{c}": F.lit(first[c]) for c in _SUMS})
            else:
                d = per.withColumns({f"t{c}": F.sum(c).over(frame) for c in _SUMS})
            d = d.filter((F.col("t") >= start + warm + delay) & (F.col("tn") > 0))
            b, a = _line("t")
            d = d.withColumns({"b": b, "a": a})
            a, b, n = F.col("a"), F.col("b"), F.col("n")
            error = F.col("syy") - 2 * a * F.col("sy") - 2 * b * F.col("sxy") + n * a * a + 2 * a * b * F.col("sx") + b * b * F.col("sxx")
            part = d.select(F.lit(name).alias("policy"), F.lit(delay).alias("delay"), F.col("t").alias("period"), (error / n).alias("mse"))
            out = part if out is None else out.unionByName(part)
    return out


def stacking(df: DataFrame, level: str, x: str, y: str, fold: str) -> DataFrame:
    """(trained_on, w_level, w_line, mse) of least-squares weights, without a constant, of two members, the mean by level and a line, from predictions on rows that they were fitted to
    (in sample) or on other folds (out of fold), with the squared error of the out-of-fold members under these weights, and of plain halves. Levels and folds are rows of sums."""
    g = df.groupBy(level, fold).agg(*_sums(F.col(x).cast("double"), F.col(y).cast("double")))
    by_level, by_fold, every = Window.partitionBy(level), Window.partitionBy(fold), Window.partitionBy()
    total = lambda c, w: F.sum(c).over(w)
    g = g.withColumns({f"l{c}": total(c, by_level) for c in ("n", "sy")} | {f"f{c}": total(c, by_fold) for c in _SUMS} | {f"a{c}": total(c, every) for c in _SUMS})  # one row a level and fold
    g = g.withColumns({f"o{c}": F.col(f"a{c}") - F.col(f"f{c}") for c in _SUMS})
    (bi, ai), (bo, ao) = _line("a"), _line("o")
    g = g.withColumns({
        "mi": F.col("lsy") / F.col("ln"), "mo": F.when(F.col("ln") > F.col("n"), (F.col("lsy") - F.col("sy")) / (F.col("ln") - F.col("n"))).otherwise(F.col("osy") / F.col("on")),
        "bi": bi, "ai": ai, "bo": bo, "ao": ao,
    })
    n, sx, sy, sxx, sxy, syy = (F.col(c) for c in _SUMS)

    def moments(s: str) -> list[Column]:
        m, a, b = F.col(f"m{s}"), F.col(f"a{s}"), F.col(f"b{s}")
        return [F.sum(n * m * m).alias(f"mm{s}"), F.sum(m * (n * a + b * sx)).alias(f"ml{s}"), F.sum(n * a * a + 2 * a * b * sx + b * b * sxx).alias(f"ll{s}"), F.sum(m * sy).alias(f"my{s}"), F.sum(a * sy + b * sxy).alias(f"ly{s}")]

    t = g.agg(*moments("i"), *moments("o"), F.sum(syy).alias("yy"), F.sum(n).alias("n"))
    out = None
    for name, s in (("in sample", "i"), ("out of fold", "o"), ("average", "")):
        if s:
            det = F.col(f"mm{s}") * F.col(f"ll{s}") - F.col(f"ml{s}") * F.col(f"ml{s}")
            u, v = (F.col(f"my{s}") * F.col(f"ll{s}") - F.col(f"ly{s}") * F.col(f"ml{s}")) / det, (F.col(f"ly{s}") * F.col(f"mm{s}") - F.col(f"my{s}") * F.col(f"ml{s}")) / det
        else:
            u = v = F.lit(0.5)
        d = t.withColumns({"u": u, "v": v})
        u, v = F.col("u"), F.col("v")
        error = F.col("yy") - 2 * u * F.col("myo") - 2 * v * F.col("lyo") + u * u * F.col("mmo") + 2 * u * v * F.col("mlo") + v * v * F.col("llo")
        part = d.select(F.lit(name).alias("trained_on"), u.alias("w_level"), v.alias("w_line"), (error / F.col("n")).alias("mse"))
        out = part if out is None else out.unionByName(part)
    return out


def extrapolation_bands(df: DataFrame, x: str, y: str, edge: float, width: float) -> DataFrame:
    """(band, n, line, level) beyond the range of training (x up to the edge): squared error by distance band of a line fitted within it, and of the mean of its last band."""
    fit = df.filter(F.col(x) <= edge).agg(F.regr_slope(y, x).alias("b"), F.regr_intercept(y, x).alias("a"), F.avg(F.when(F.col(x) > edge - width, F.col(y))).alias("m")).first()
    band = F.when(F.col(x) <= edge, F.lit(0)).otherwise(F.ceil((F.col(x) - edge) / width)).cast("int")
    square = lambda c: F.avg(F.pow(F.col(y) - c, F.lit(2)))
    return df.groupBy(band.alias("band")).agg(F.count("*").alias("n"), square(F.lit(fit["a"]) + F.lit(fit["b"]) * F.col(x)).alias("line"), square(F.lit(fit["m"])).alias("level"))


def lasso_path(df: DataFrame, by: str, xs: list[str], y: str, alphas: list[float], sweeps: int = 200) -> DataFrame:
    """(by, alpha, term, beta): coefficients of standardised columns that minimise half the mean squared error plus alpha times their absolute sum, by coordinate descent on the
    correlations, which are one row of sums. The intercept isn't penalised and isn't given."""
    p = len(xs)

    def solve(n, m, mean):
        r, d = _scaled(m[:p, :p])
        c = m[:p, p] / d / np.sqrt(n)
        out = []
        for alpha in alphas:
            beta = np.zeros(p)
            for _ in range(sweeps):
                for j in range(p):
                    left = c[j] - r[j] @ beta + r[j, j] * beta[j]
                    beta[j] = np.sign(left) * max(abs(left) - alpha, 0.0)
            out += [(float(alpha), x, float(b)) for x, b in zip(xs, beta)]
        return out

    return _solved(centred_gram(df, by, [*xs, y]), by, p + 1, "alpha double, term string, beta double", solve)


def mixture_order(df: DataFrame, value: str, steps: int, digits: int) -> DataFrame:
    """(k, log_likelihood, bic, icl) of one normal and of two, the latter from the means of the values below and above the mean, after so many steps of EM.
    Values are counted by distinct rounded value first; each step is one row of sums."""
    d = written(df.select(F.round(F.col(value), digits).alias("v")).filter("v is not null").groupBy("v").agg(F.count("*").cast("double").alias("n")), "values")
    mean = F.sum(F.col("n") * F.col("v")) / F.sum("n")
    n, m, q = d.agg(F.sum("n"), mean, F.sum(F.col("n") * F.col("v") * F.col("v")) / F.sum("n")).first()
    var = q - m * m
    low, high = d.agg(*[F.sum(F.when(c, F.col("n") * F.col("v"))) / F.sum(F.when(c, F.col("n"))) for c in (F.col("v") < m, F.col("v") >= m)]).first()
    density = lambda mu, s2: F.exp(-F.pow(F.col("v") - mu, F.lit(2)) / (2 * s2)) / float(np.sqrt(2 * np.pi * s2))
    state = [0.5, low, var, 0.5, high, var]
    for _ in range(steps):
        w1, m1, s1, w2, m2, s2 = state
        a, b = w1 * density(m1, s1), w2 * density(m2, s2)
        r1, r2 = F.col("n") * a / (a + b), F.col("n") * b / (a + b)
        v = F.col("v")
        g = d.agg(*[F.sum(c) for r in (r1, r2) for c in (r, r * v, r * v * v)]).first()
        state = []
        for k in (0, 3):
            mu = g[k + 1] / g[k]
            state += [g[k] / n, mu, g[k + 2] / g[k] - mu * mu]
    w1, m1, s1, w2, m2, s2 = state
    a, b = w1 * density(m1, s1), w2 * density(m2, s2)
    term = lambda p: F.when(p > 0, p * F.log(p)).otherwise(0.0)
    one, two, entropy = d.agg(F.sum(F.col("n") * F.log(density(m, var))), F.sum(F.col("n") * F.log(a + b)), -F.sum(F.col("n") * (term(a / (a + b)) + term(b / (a + b))))).first()
    bic = [-2 * one + 2 * np.log(n), -2 * two + 5 * np.log(n)]
    rows = [(1, float(one), float(bic[0]), float(bic[0])), (2, float(two), float(bic[1]), float(bic[1] + 2 * entropy))]
    return df.sparkSession.createDataFrame(rows, "k int, log_likelihood double, bic double, icl double")


def monotone_cost(df: DataFrame, row_id: str, x: str, y: str, share: float, seed: str) -> DataFrame:
    """(fit, train, test): squared error of the mean by distinct x and of its non-decreasing fit, on the rows that they were fitted to and on the others; x that wasn't seen is left out."""
    d = df.select(F.lit(1).alias("g"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), (md5_share(key(seed, row_id)) < share).alias("used"))
    fit = isotonic(d.filter("used"), "g", "x", "y").select(F.col("score").alias("x"), F.col("fitted").alias("monotone"))
    free = d.filter("used").groupBy("x").agg(F.avg("y").alias("free"))
    both = d.groupBy("x", "used").agg(F.count("*").alias("n"), F.sum("y").alias("s"), F.sum(F.col("y") * F.col("y")).alias("q")).join(fit, "x").join(free, "x")
    error = lambda c, used: F.sum(F.when(F.col("used") == used, F.col("q") - 2 * F.col(c) * F.col("s") + F.col("n") * F.col(c) * F.col(c))) / F.sum(F.when(F.col("used") == used, F.col("n")))
    t = both.agg(*[error(c, u).alias(f"{c}_{u}") for c in ("free", "monotone") for u in (True, False)])
    return t.select(F.explode(F.array(*[F.struct(F.lit(c).alias("fit"), F.col(f"{c}_True").alias("train"), F.col(f"{c}_False").alias("test")) for c in ("free", "monotone")])).alias("r")).select("r.*")


def scale_equivariance(df: DataFrame, x: str, y: str, scales: list[float], cut: float) -> DataFrame:
    """(rule, scale, slope, gap): one reweighted slope whose weights fall beyond a cut, taken as it is (fixed) or as a multiple of the median absolute residual (relative), of targets times a
    scale, divided by it again, and its relative distance from the slope at scale 1."""
    out = None
    fit = df.agg(F.regr_slope(y, x).alias("b"), F.regr_intercept(y, x).alias("a")).first()
    e = df.select(F.col(x).alias("x"), F.col(y).alias("y"), (F.col(y) - fit["a"] - fit["b"] * F.col(x)).alias("e"))
    mad = percentile(e, F.abs("e"), 0.5)
    for rule in ("fixed", "relative"):
        for s in scales:
            limit = cut if rule == "fixed" else cut * mad * s
            w = F.least(F.lit(1.0), F.lit(limit) / F.greatest(F.abs(F.col("e") * s), F.lit(1e-300)))
            g = e.select(w.alias("w"), "x", (F.col("y") * s).alias("y")).agg(F.sum("w").alias("w"), *[F.sum(c).alias(k) for k, c in (("x", F.col("w") * F.col("x")), ("y", F.col("w") * F.col("y")), ("xx", F.col("w") * F.col("x") * F.col("x")), ("xy", F.col("w") * F.col("x") * F.col("y")))])
            slope = (F.col("xy") - F.col("x") * F.col("y") / F.col("w")) / (F.col("xx") - F.col("x") * F.col("x") / F.col("w")) / s
            part = g.select(F.lit(rule).alias("rule"), F.lit(float(s)).alias("scale"), slope.alias("slope"))
            out = part if out is None else out.unionByName(part)
    base = F.max(F.when(F.col("scale") == 1.0, F.col("slope"))).over(Window.partitionBy("rule"))  # one row a rule and scale
    return out.withColumn("gap", F.abs(F.col("slope") / base - 1))


def scale_null(df: DataFrame, row_id: str, x: str, y: str, scale: str, quantile: float, reps: int, seed: str) -> DataFrame:
    """One row: the correlation over rows whose scale is above a quantile, the mean of the same where pairs of constant correlation are drawn again under the same scales, and the share of replicates
    that reach the first."""
    rho, cut = df.agg(F.corr(F.col(x) / F.col(scale), F.col(y) / F.col(scale))).first()[0], percentile(df, scale, quantile)
    top = df.filter(F.col(scale) > cut)
    seen = top.agg(F.corr(x, y)).first()[0]
    text = lambda part: key(seed, F.lit(part), "rep", row_id)
    d = with_replicates(top.select(row_id, scale), reps).withColumns({"a": md5_normal_pair(text("a")), "b": md5_normal_pair(text("b"))})
    r = d.groupBy("rep").agg(F.corr(F.col(scale) * F.col("a"), F.col(scale) * (rho * F.col("a") + float(np.sqrt(max(0.0, 1 - rho * rho))) * F.col("b"))).alias("r"))
    return r.agg(F.lit(seen).cast("double").alias("turbulent"), F.avg("r").alias("under_null"), F.avg((F.col("r") >= F.lit(seen)).cast("double")).alias("p"))


def rank_rules(df: DataFrame, by: str, xs: list[str], noise: float) -> DataFrame:
    """(by, singular, elbow, edge, hard, n): singular values of the standardised columns, and how many stand before the farthest one below the chord (elbow), above noise (sqrt n + sqrt p),
    and above the optimal hard threshold for that noise."""
    p = len(xs)
    kind = df.schema[by].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, n, m in zip(b[by], b["n"], b["gram"]):
                s = np.sqrt(np.maximum(np.linalg.eigvalsh(_scaled(np.array(m, float).reshape(p, p))[0])[::-1] * n, 0))
                line = s[0] + (s[-1] - s[0]) * np.arange(p) / max(1, p - 1)
                beta = min(n, p) / max(n, p)
                threshold = np.sqrt(2 * (beta + 1) + 8 * beta / (beta + 1 + np.sqrt(beta * beta + 14 * beta + 1))) * np.sqrt(max(n, p)) * noise
                out.append((k, [float(v) for v in s], int(np.argmax(line - s)), int((s > noise * (np.sqrt(n) + np.sqrt(p))).sum()), int((s > threshold).sum()), int(n)))
            yield pd.DataFrame(out, columns=[by, "singular", "elbow", "edge", "hard", "n"])

    return centred_gram(df, by, xs).drop("mean").mapInPandas(run, f"{by} {kind}, singular array<double>, elbow int, edge int, hard int, n long")


def result_audit(df: DataFrame, keys: list[str], effect: str, noise: str, z: str, n: str, rho: str, periods: float) -> DataFrame:
    """Per reported effect with its noise and z: the rows that these imply, the independent ones among n with a common correlation, the ratio of effect to noise over a
    year, and the cost that leaves nothing of the effect."""
    ratio = F.col(effect) / F.col(noise)
    return df.select(*keys, F.pow(F.col(z) / ratio, F.lit(2)).alias("implied_n"), (F.col(n) / (1 + (F.col(n) - 1) * F.col(rho))).alias("independent"), (ratio * float(np.sqrt(periods))).alias("annual_ratio"), F.abs(effect).alias("breakeven"))


def feature_importances(df: DataFrame, by: str, xs: list[str], y: str) -> DataFrame:
    """(by, term, drop, permuted, squared_r): of a regression, by how much its R2 falls without a column, the rise of the squared error that permuting the column is expected to bring, over the
    variance of y, and the squared correlation with y alone. All of it follows from one row of sums."""
    p = len(xs)

    def solve(n, m, mean):
        r, d = _scaled(m)
        fit = lambda idx: float(r[idx, p] @ np.linalg.pinv(r[np.ix_(idx, idx)], hermitian=True) @ r[idx, p]) if idx else 0.0
        beta = np.linalg.pinv(r[:p, :p], hermitian=True) @ r[:p, p]
        full = fit(list(range(p)))
        return [(x, full - fit([j for j in range(p) if j != i]), float(2 * beta[i] ** 2), float(r[i, p] ** 2)) for i, x in enumerate(xs)]

    return _solved(centred_gram(df, by, [*xs, y]), by, p + 1, "term string, drop double, permuted double, squared_r double", solve)


def component_stability(df: DataFrame, row_id: str, a: str, b: str, reps: int, seed: str) -> DataFrame:
    """(rep, first, second, angle) of the covariance matrix of two columns under Poisson weights of the rows: its eigenvalues and the angle, in degrees, of its first
    component to that of all rows. A replicate is one row of weighted sums about the means."""
    m = df.agg(F.avg(a), F.avg(b), F.var_pop(a), F.covar_pop(a, b), F.var_pop(b)).first()
    whole = 0.5 * np.arctan2(2 * m[3], m[2] - m[4])
    d = with_replicates(df.select(row_id, (F.col(a) - m[0]).alias("_a"), (F.col(b) - m[1]).alias("_b")), reps).withColumn("w", poisson(md5_share(key(seed, "rep", row_id))))
    w, x, y = F.col("w"), F.col("_a"), F.col("_b")
    g = d.groupBy("rep").agg(*[F.sum(c).alias(n) for n, c in (("n", w), ("x", w * x), ("y", w * y), ("xx", w * x * x), ("xy", w * x * y), ("yy", w * y * y))])
    cov = lambda p, q, r: F.col(p) / F.col("n") - F.col(q) * F.col(r) / (F.col("n") * F.col("n"))
    g = g.select("rep", cov("xx", "x", "x").alias("p"), cov("xy", "x", "y").alias("q"), cov("yy", "y", "y").alias("r"))
    half, mean = F.sqrt(F.pow((F.col("p") - F.col("r")) / 2, F.lit(2)) + F.col("q") * F.col("q")), (F.col("p") + F.col("r")) / 2
    turn = F.abs(0.5 * F.atan2(2 * F.col("q"), F.col("p") - F.col("r")) - float(whole))
    return g.select("rep", (mean + half).alias("first"), (mean - half).alias("second"), F.degrees(F.least(turn, float(np.pi) - turn)).alias("angle"))


def stump_bootstrap(df: DataFrame, row_id: str, features: list[str], y: str, reps: int, seed: str) -> DataFrame:
    """(rep, feature, split, gain, root) of 0/1 labels under Poisson weights of the rows: each feature's split (values up to it go left) of largest fall in Gini impurity, the smallest of
    equals, and whether it is the replicate's best (the first feature by name of equals). Values are counted by replicate first, so round them."""
    d = with_replicates(df.select(row_id, *features, F.col(y).cast("double").alias("y")), reps).withColumn("w", poisson(md5_share(key(seed, "rep", row_id))).cast("double"))
    long = d.filter("w > 0").select("rep", "w", "y", F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features])).alias("f"))
    g = long.groupBy("rep", "f.feature", "f.v").agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("y")).alias("s"))
    every = Window.partitionBy("rep", "feature")
    upto = every.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)  # distinct values
    g = g.select("rep", "feature", "v", F.sum("n").over(upto).alias("ln"), F.sum("s").over(upto).alias("ls"), F.sum("n").over(every).alias("n"), F.sum("s").over(every).alias("s")).filter("ln < n")
    impurity = lambda s, n: 2 * s * (n - s) / n
    gain = (impurity(F.col("s"), F.col("n")) - impurity(F.col("ls"), F.col("ln")) - impurity(F.col("s") - F.col("ls"), F.col("n") - F.col("ln"))) / F.col("n")
    best = g.withColumn("gain", F.round(gain, 9)).groupBy("rep", "feature").agg(F.max(F.struct("gain", (-F.col("v")).alias("v"))).alias("b")).select("rep", "feature", (-F.col("b.v")).alias("split"), F.col("b.gain").alias("gain"))
    return best.withColumn("root", F.row_number().over(Window.partitionBy("rep").orderBy(F.desc("gain"), "feature")) == 1)


def collateral_stress(df: DataFrame, keys: list[str], junior: str, senior: str, recovery: str, sigma: float, drift: float, term: float) -> DataFrame:
    """keys with attachment (collateral over today's value that just covers both claims), required_fall, breach (the chance of less than that) and loss_per_year, all but the first in percent, under
    a lognormal value: what the junior claim loses is what both claims together lose less what the senior one alone does, each the price of a put on the recovered collateral."""
    s, mean = sigma * float(np.sqrt(term)), (drift - sigma * sigma / 2) * term

    @F.pandas_udf("double")
    def cdf(z: pd.Series) -> pd.Series:
        return z.map(normal_cdf, na_action="ignore")

    def short(claim: Column) -> Column:
        d = (F.log(claim / F.col(recovery)) - mean) / s
        return F.when(claim > 0, claim * cdf(d) - F.col(recovery) * float(np.exp(drift * term)) * cdf(d - s)).otherwise(0.0)

    at = (F.col(senior) + F.col(junior)) / F.col(recovery)
    d = df.filter((F.col(junior) > 0) & (F.col(senior) >= 0) & (F.col(recovery) > 0))
    loss = F.greatest(F.lit(0.0), short(F.col(senior) + F.col(junior)) - short(F.col(senior)))
    return d.select(*keys, at.alias("attachment"), (100 * (1 - at)).alias("required_fall"), (100 * cdf((F.log(at) - mean) / s)).alias("breach"), (100 * loss / (F.col(junior) * term)).alias("loss_per_year"))


def boosting_curve(df: DataFrame, row_id: str, x: str, y: str, bins: int, rounds: int, rate: float, flip: float, share: float, seed: str) -> DataFrame:
    """(round, train, test): squared error by round of boosted stumps on one feature in [0, 1), cut into equal bins, where a share of the training labels (0 or 1) is flipped by hash. Rows are summed up by
    bin first, so a round is work on so many bins; of equally good splits the lowest counts."""
    d = df.select(F.least(F.lit(bins - 1), F.floor(F.col(x) * bins)).cast("int").alias("bin"), F.col(y).cast("double").alias("y"), (md5_share(key(seed, F.lit("part"), row_id)) < share).alias("train"), (md5_share(key(seed, F.lit("flip"), row_id)) < flip).alias("flipped"))
    d = d.withColumn("y", F.when(F.col("train") & F.col("flipped"), 1 - F.col("y")).otherwise(F.col("y")))
    per = d.groupBy("bin", "train").agg(F.count("*").alias("n"), F.sum("y").alias("s"), F.sum(F.col("y") * F.col("y")).alias("q"))

    def boost(rows: pd.DataFrame) -> pd.DataFrame:
        own = {t: np.zeros((3, bins)) for t in (True, False)}
        for b, t, *sums in rows[["bin", "train", "n", "s", "q"]].itertuples(index=False):
            own[t][:, b] = sums
        (n, s, _), f, out = own[True], np.zeros(bins), []
        for k in range(rounds + 1):
            error = {t: float((q - 2 * f * z + m * f * f).sum() / m.sum()) if m.sum() else None for t, (m, z, q) in own.items()}
            out.append((k, error[True], error[False]))
            left, size = np.cumsum(s - n * f), np.cumsum(n)
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.round(np.where((size > 0) & (size < size[-1]), left**2 / size + (left[-1] - left) ** 2 / (size[-1] - size), -1.0), 9)
            at = int(np.argmax(gain[:-1])) if bins > 1 else 0
            if bins < 2 or gain[at] < 0:
                continue
            f[: at + 1] += rate * left[at] / size[at]
            f[at + 1 :] += rate * (left[-1] - left[at]) / (size[-1] - size[at])
        return pd.DataFrame(out, columns=["round", "train", "test"])

    return per.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(boost, "round int, train double, test double")  # two rows a bin
