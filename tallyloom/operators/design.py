"""Designs of ordered series: interruptions, controls, lags, and what resamples say about breaks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.operators.linear import _scaled, _solved, break_scan, centred_gram
from tallyloom.operators.resample import block_bootstrap, numbered


def interrupted_design(df: DataFrame, series: str, order: str, break_at: int, season: int = 0, start: int = 0, bend: bool = False) -> DataFrame:
    """df with `trend` (0 to 1), `step` (1 from the break on) or `bend` (periods since it, over n - 1), and flags season_1 .. season_<m - 1> of the place in the season,
    the first row being in place `start`. A break at an edge, where its column is constant, is an error."""
    d = numbered(df, series, order, "_i")
    n = F.count("*").over(Window.partitionBy(series))
    d = d.withColumn("_n", n)
    least = df.groupBy(series).agg(F.count("*").alias("n")).agg(F.min("n")).first()[0]
    if not 0 < break_at < (least or 0) - bend:
        raise ValueError(f"a break at {break_at} leaves nothing on one side of a series of {least}")
    since = F.greatest(F.lit(0), F.col("_i") - break_at) / (F.col("_n") - 1)
    cols = {"trend": F.col("_i") / F.greatest(F.lit(1), F.col("_n") - 1), "bend" if bend else "step": since if bend else (F.col("_i") >= break_at).cast("double")}
    cols |= {f"season_{k}": ((F.col("_i") + start) % season == k).cast("double") for k in range(1, season)}
    return d.withColumns(cols).drop("_i", "_n")


def residualised(df: DataFrame, by: str, controls: list[str], columns: list[str]) -> DataFrame:
    """df, over rows that have all of these, with each of the columns less what a constant and the controls explain of it. Controls that others determine add nothing."""
    p, q = len(controls), len(columns)
    rows = df.na.drop(subset=[*controls, *columns])

    def solve(n, m, mean):
        r, d = _scaled(m[:p, :p])
        b = (np.linalg.pinv(r, hermitian=True) @ (m[:p, p:] / d[:, None])) / d[:, None]
        return [([float(x) for x in b.T.ravel()], [float(x) for x in mean])]

    fit = _solved(centred_gram(rows, by, [*controls, *columns]), by, p + q, "_b array<double>, _mean array<double>", solve).withColumnRenamed(by, "_by")
    d = rows.join(fit, F.col(by).eqNullSafe(F.col("_by"))).drop("_by")
    left = lambda j: F.col(columns[j]) - F.get("_mean", F.lit(p + j)) - sum((F.get("_b", F.lit(j * p + i)) * (F.col(c) - F.get("_mean", F.lit(i))) for i, c in enumerate(controls)), F.lit(0.0))
    return d.withColumns({c: left(j) for j, c in enumerate(columns)}).drop("_b", "_mean")


def newey_west_lags(n: Column) -> Column:
    return F.floor(4 * F.pow(n / 100, F.lit(2 / 9))).cast("int")


def hac_column(df: DataFrame, series: str, order: str, x: str, controls: list[str], y: str, lags: int) -> DataFrame:
    """(series, beta, se_ols, se_hac, n) of one column of a regression beside a constant and any controls: both sides are taken free of these first, which leaves
    the column's estimate and its robust variance as they are. Bartlett weights, scaled by n / (n - k)."""
    k = len(controls) + 2
    d = residualised(df.select(series, order, x, y, *controls), series, controls, [x, y])
    s = d.groupBy(series).agg(F.count("*").alias("n"), F.sum(F.col(x) * F.col(x)).alias("xx"), F.sum(F.col(x) * F.col(y)).alias("xy"), F.sum(F.col(y) * F.col(y)).alias("yy"))
    s = s.withColumn("beta", F.col("xy") / F.col("xx"))
    u = d.join(s, series).select(series, order, (F.col(x) * (F.col(y) - F.col("beta") * F.col(x))).alias("u"))
    w = Window.partitionBy(series).orderBy(order)
    u = u.withColumns({f"u{i}": F.lag("u", i).over(w) for i in range(1, lags + 1)})
    total = F.sum(F.col("u") * F.col("u")) + sum((2 * (1 - i / (lags + 1)) * F.coalesce(F.sum(F.col("u") * F.col(f"u{i}")), F.lit(0.0)) for i in range(1, lags + 1)), F.lit(0.0))
    g = u.groupBy(series).agg(total.alias("meat")).join(s, series)
    free = F.col("n") - k
    return g.select(
        series, "beta", F.sqrt((F.col("yy") - F.col("beta") * F.col("xy")) / free / F.col("xx")).alias("se_ols"), F.sqrt(F.col("meat") * F.col("n") / free / (F.col("xx") * F.col("xx"))).alias("se_hac"), "n"
    )


def lag_regression(df: DataFrame, series: str, order: str, value: str, lags: int, degree: int = 1, ridge: float = 0.0) -> DataFrame:
    """(series, term, beta, n): the value on powers up to a degree of its lags, standardised (population deviation) with an unpenalised constant; the largest |beta| first is
    up to the reader. A term without spread has a coefficient of 0."""
    w = Window.partitionBy(series).orderBy(order)
    terms = {f"lag{i}" + (f"^{e}" if e > 1 else ""): F.pow(F.lag(value, i).over(w), F.lit(e)) if e > 1 else F.lag(value, i).over(w) for i in range(1, lags + 1) for e in range(1, degree + 1)}
    d = df.select(series, F.col(value).alias("_y"), *[c.alias(t) for t, c in terms.items()])
    names, p = list(terms), len(terms)

    def solve(n, m, mean):
        r, d = _scaled(m[:p, :p])
        xy = m[:p, p] / d / np.sqrt(n)
        beta = np.linalg.lstsq(r + ridge / n * np.eye(p), xy, rcond=None)[0]
        return [("(constant)", float(mean[p]), int(n)), *[(t, float(b), int(n)) for t, b in zip(names, beta)]]

    return _solved(centred_gram(d, series, [*names, "_y"]), series, p + 1, "term string, beta double, n long", solve)


def detrended(df: DataFrame, series: str, order: str, value: str) -> DataFrame:
    """(series, order, i, n, fitted, e): a line in time by series, and what it leaves."""
    d = numbered(df.select(series, order, F.col(value).cast("double").alias("y")), series, order, "i")
    f = d.groupBy(series).agg(F.regr_slope("y", "i").alias("b"), F.regr_intercept("y", "i").alias("a"), F.count("*").alias("n"))
    return d.join(f, series).select(series, order, "i", "n", (F.col("a") + F.col("b") * F.col("i")).alias("fitted"), (F.col("y") - F.col("a") - F.col("b") * F.col("i")).alias("e"))


def _replicates(resid: DataFrame, series: str, order: str, block: int, reps: int, seed: str) -> DataFrame:
    """(key, series, rep, place, e): block resamples of residuals; key names a series and replicate."""
    b = block_bootstrap(resid, series, order, "e", block, reps, seed).withColumnRenamed("value", "e")
    return b.withColumn("key", F.concat_ws("#", F.col(series).cast("string"), F.col("rep").cast("string")))


def sup_t(df: DataFrame, series: str, order: str, value: str, block: int, reps: int, seed: str, bend: bool = False, shift: float = 0.0, at: float = 0.5) -> DataFrame:
    """(series, rep, sup_t, tau): the largest |t| of a scan, and the date of least squares, of resamples of the residuals from a line, with a step of so many residual deviations put in at a share of the
    length. All replicates are scanned at once."""
    resid = detrended(df, series, order, value)
    sd = resid.groupBy(series).agg(F.stddev_pop("e").alias("sd"), F.count("*").alias("n"))
    b = _replicates(resid, series, order, block, reps, seed).join(sd, series)
    b = b.withColumn("y", F.col("e") + F.when(F.col("place") >= F.floor(F.col("n") * at), shift * F.col("sd")).otherwise(0.0))
    scan = break_scan(b, "key", "place", "y", bend=bend)
    best = scan.groupBy("key").agg(F.max(F.abs("t")).alias("sup_t"), F.min_by("tau", F.struct("ssr", "tau")).alias("tau"))
    return best.select(F.regexp_extract("key", r"^(.*)#\d+$", 1).alias(series), F.regexp_extract("key", r"#(\d+)$", 1).cast("int").alias("rep"), "sup_t", "tau")


def critical_values(draws: DataFrame, series: str, level: float = 0.05) -> DataFrame:
    """(series, critical, size): the quantile of sup |t| without a break, and how often it passes 1.96."""
    return draws.groupBy(series).agg(F.percentile("sup_t", 1 - level).alias("critical"), F.avg((F.col("sup_t") > 1.96).cast("double")).alias("size"))


def power_by_shift(draws: dict[float, DataFrame], critical: DataFrame, series: str) -> DataFrame:
    """(series, shift, power): share of replicates with a shift whose sup |t| passes the series' critical value."""
    out = None
    for shift, d in draws.items():
        part = d.join(critical, series).groupBy(series).agg(F.avg((F.col("sup_t") > F.col("critical")).cast("double")).alias("power")).select(series, F.lit(shift).alias("shift"), "power")
        out = part if out is None else out.unionByName(part)
    return out


def detectable_shift(power: DataFrame, series: str, target: float = 0.8) -> DataFrame:
    """(series, shift): the smallest shift of the grid whose power reaches the target; null if none does."""
    return power.groupBy(series).agg(F.min(F.when(F.col("power") >= target, F.col("shift"))).alias("shift"))


def date_interval(df: DataFrame, series: str, order: str, value: str, block: int, reps: int, seed: str, level: float = 0.9) -> DataFrame:
    """(series, tau, lower, upper): the date of a step by least squares, and quantiles of the dates of series made of its fit and resampled residuals."""
    d = numbered(df.select(series, order, F.col(value).cast("double").alias("y")), series, order, "i")
    scan = break_scan(d.select(series, F.col("i").alias("at"), "y"), series, "at", "y")
    best = scan.groupBy(series).agg(F.min_by("tau", F.struct("ssr", "tau")).alias("tau"))
    d = d.join(best, series).withColumns({"step": (F.col("i") >= F.col("tau")).cast("double"), "time": F.col("i").cast("double")})
    left = residualised(d.withColumn("e", F.col("y")), series, ["time", "step"], ["e"]).withColumn("fitted", F.col("y") - F.col("e"))
    b = _replicates(left.select(series, F.col("i").alias("at"), "e"), series, "at", block, reps, seed)
    b = b.select(series, "key", "place", "e").join(left.select(series, F.col("i").alias("place"), "fitted"), [series, "place"]).withColumn("y", F.col("fitted") + F.col("e"))
    again = break_scan(b.select("key", "place", "y"), "key", "place", "y").groupBy("key").agg(F.min_by("tau", F.struct("ssr", "tau")).alias("t"))
    again = again.select(F.regexp_extract("key", r"^(.*)#\d+$", 1).alias(series), "t")
    q = F.percentile("t", [(1 - level) / 2, (1 + level) / 2])
    return again.groupBy(series).agg(q.alias("q")).join(best, series).select(series, "tau", F.get("q", F.lit(0)).alias("lower"), F.get("q", F.lit(1)).alias("upper"))


def deletion_influence(df: DataFrame, by: str, row: str, x: str, y: str) -> DataFrame:
    """(by, row, h, dfbeta_intercept, dfbeta_slope): leverage of each row of a line and by how much both estimates change without it; null where the row alone fixes the slope."""
    m = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    s = m.groupBy(by).agg(F.count("*").alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.regr_sxx(y, x).alias("sxx"), F.regr_sxy(y, x).alias("sxy"))
    d = m.select(by, row, x, y).join(s, by)
    c, b = F.col(x) - F.col("mx"), F.col("sxy") / F.col("sxx")
    h = 1 / F.col("n") + c * c / F.col("sxx")
    e = F.col(y) - F.col("my") - b * c
    d = d.select(by, row, h.alias("h"), (e * c / F.col("sxx")).alias("_s"), (e * (1 / F.col("n") - F.col("mx") * c / F.col("sxx"))).alias("_i"))
    ok = lambda v: F.when(F.col("h") < 1 - 1e-10, F.col(v) / (1 - F.col("h")))
    return d.select(by, row, "h", ok("_i").alias("dfbeta_intercept"), ok("_s").alias("dfbeta_slope"))
