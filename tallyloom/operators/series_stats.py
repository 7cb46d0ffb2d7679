"""Statistics of ordered series: dependence, conditional correlation, seasons, noise scales."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.ranks import percentiles_by


def stylised_facts(df: DataFrame, path: str, order: str, value: str) -> DataFrame:
    """One row: pooled standard deviation and excess kurtosis (both of the population), and the means over paths of the lag-1 correlations of
    r, of |r|, and of r with the next |r|, each with its standard error; never across the join of two paths."""
    w = Window.partitionBy(path).orderBy(order)
    r = F.col(value)
    d = df.select(path, r.alias("r"), F.lead(r).over(w).alias("n"))
    per = d.groupBy(path).agg(F.corr("r", "n").alias("a"), F.corr(F.abs("r"), F.abs("n")).alias("b"), F.corr("r", F.abs("n")).alias("c"))
    pooled = df.agg(F.stddev_pop(value).alias("sd"), F.kurtosis(value).alias("kurtosis")).withColumn("k", F.lit(1))
    se = lambda c: (F.stddev_samp(c) / F.sqrt(F.count(c))).alias(f"{c}_se")
    means = per.agg(*[x for c in "abc" for x in (F.avg(c).alias(c), se(c))]).withColumn("k", F.lit(1))
    names = {"a": "autocorrelation", "b": "clustering", "c": "asymmetry"}
    return pooled.join(means, "k").select("sd", "kurtosis", *[F.col(c + s).alias(n + s) for c, n in names.items() for s in ("", "_se")])


def autocorrelation(df: DataFrame, series: str, order: str, value: str, lags: int) -> DataFrame:
    """(series, lag, rho) by the whole sample's mean and lag-0 sum, for all lags in one pass."""
    w = Window.partitionBy(series).orderBy(order)
    d = df.filter(F.col(value).isNotNull()).select(series, order, (F.col(value) - F.avg(value).over(Window.partitionBy(series))).alias("c"))
    d = d.select(series, "c", *[F.lag("c", k).over(w).alias(f"c{k}") for k in range(1, lags + 1)])
    g = d.groupBy(series).agg(F.sum(F.col("c") * F.col("c")).alias("s"), *[F.sum(F.col("c") * F.col(f"c{k}")).alias(f"s{k}") for k in range(1, lags + 1)])
    return g.select(series, F.posexplode(F.array(*[F.try_divide(F.col(f"s{k}"), F.col("s")) for k in range(1, lags + 1)])).alias("lag", "rho")).withColumn("lag", F.col("lag") + 1)


def effective_n(acf: DataFrame, counts: DataFrame, series: str, lags: int) -> DataFrame:
    """(series, inflation, effective_n): 1 + 2 sum (1 - k / (L + 1)) rho_k, and n over it (null if that is 0 or less)."""
    v = acf.groupBy(series).agg((1 + 2 * F.sum((1 - F.col("lag") / (lags + 1)) * F.col("rho"))).alias("inflation"))
    return v.join(counts, series).select(series, "inflation", F.when(F.col("inflation") > 0, F.col("n") / F.col("inflation")).alias("effective_n"))


def conditional_correlation(df: DataFrame, by: str, x: str, y: str, cuts: list[float]) -> DataFrame:
    """(by, q, n, r, r_calm, ratio, predicted, corrected): correlations of the rows whose |x| reaches its q-quantile and of the others, the ratio of
    x's variances, the turbulent correlation that a constant dependence would show, and the correlation freed of that ratio."""
    q = percentiles_by(df, [by], F.abs(x), cuts, "c").select(by, F.posexplode("c").alias("i", "cut"))
    d = df.join(q, by).select(by, "i", F.col(x).alias("x"), F.col(y).alias("y"), (F.abs(x) >= F.col("cut")).alias("t"))
    when = lambda c, t: F.when(F.col("t") == t, F.col(c))
    g = d.groupBy(by, "i").agg(F.count_if("t").alias("n"), F.corr(when("x", True), when("y", True)).alias("r"), F.corr(when("x", False), when("y", False)).alias("r_calm"), F.corr("x", "y").alias("all"), (F.var_samp(when("x", True)) / F.var_samp("x")).alias("ratio"))
    r, a, v = F.col("r"), F.col("all"), F.col("ratio")
    at = F.element_at(F.array(*[F.lit(c) for c in cuts]), F.col("i") + 1)
    return g.select(by, at.alias("q"), "n", "r", "r_calm", "ratio", (a * F.sqrt(v) / F.sqrt(a * a * v + 1 - a * a)).alias("predicted"), (r / F.sqrt(v - r * r * (v - 1))).alias("corrected"))


def covariance_shares(df: DataFrame, by: str, x: str, y: str, turbulent: str) -> DataFrame:
    """(by, log_ratio, rho, sx, sy): the logarithm of the covariance's change between the two states, and its parts."""
    when = lambda c, t: F.when(F.col(turbulent) == t, F.col(c))
    part = lambda f: F.log(f(True) / f(False))
    g = df.groupBy(by).agg(
        part(lambda t: F.abs(F.covar_samp(when(x, t), when(y, t)))).alias("log_ratio"), part(lambda t: F.abs(F.corr(when(x, t), when(y, t)))).alias("rho"),
        part(lambda t: F.stddev_samp(when(x, t))).alias("sx"), part(lambda t: F.stddev_samp(when(y, t))).alias("sy"),
    )
    return g


def lagged_tails(df: DataFrame, series: str, order: str, value: str, tail: float) -> DataFrame:
    """(series, p, base, lift): the chance of a value in the top tail given that the one before was in the bottom tail, against the plain share."""
    q = df.groupBy(series).agg(F.percentile(value, [tail, 1 - tail]).alias("q"))
    w = Window.partitionBy(series).orderBy(order)
    d = df.join(q, series).select(series, (F.col(value) >= F.get("q", F.lit(1))).cast("double").alias("top"), F.lag(F.col(value) <= F.get("q", F.lit(0))).over(w).alias("low"))
    p = F.avg(F.when(F.col("low"), F.col("top")))
    return d.groupBy(series).agg(p.alias("p"), F.avg("top").alias("base"), (p / F.avg("top")).alias("lift"))


def month_adjusted(df: DataFrame, series: str, date: str, value: str, excluded: list[int], least: int = 3) -> DataFrame:
    """(series, date, adjusted): value less its month's mean plus the overall mean; means leave out the years given, all rows are adjusted.
    A month of fewer rows than the least is an error."""
    fit = df.filter(~F.year(date).isin(excluded)) if excluded else df
    m = fit.groupBy(series, F.month(date).alias("_month")).agg(F.avg(value).alias("_m"), F.count(value).alias("_c"))
    a = fit.groupBy(series).agg(F.avg(value).alias("_a"))
    d = df.withColumn("_month", F.month(date)).join(m, [series, "_month"]).join(a, series)
    mean = F.when(F.col("_c") >= least, F.col("_m")).otherwise(F.raise_error(F.lit("a month has too few rows")).cast("double"))
    return d.select(series, date, (F.col(value) - mean + F.col("_a")).alias("adjusted"))


def noise_scale(df: DataFrame, series: str, order: str, value: str) -> DataFrame:
    """(series, sd, robust, n): the noise of a smooth series from its second differences, their root mean square over sqrt(6), and 1.4826 times their median size over sqrt(6)."""
    w = Window.partitionBy(series).orderBy(order)
    d = df.select(series, (F.col(value) - 2 * F.lag(value, 1).over(w) + F.lag(value, 2).over(w)).alias("d")).filter("d is not null")
    return d.groupBy(series).agg((F.sqrt(F.avg(F.col("d") * F.col("d"))) / F.sqrt(F.lit(6.0))).alias("sd"), (1.4826 * F.percentile(F.abs("d"), 0.5) / F.sqrt(F.lit(6.0))).alias("robust"), F.count("*").alias("n"))


def rolling_noise_scale(df: DataFrame, series: str, order: str, value: str, window: int) -> DataFrame:
    """(series, order, scale) over full windows of second differences."""
    w = Window.partitionBy(series).orderBy(order)
    d = df.select(series, order, (F.col(value) - 2 * F.lag(value, 1).over(w) + F.lag(value, 2).over(w)).alias("d")).filter("d is not null")
    f = w.rowsBetween(-(window - 1), 0)
    d = d.select(series, order, (F.sqrt(F.avg(F.col("d") * F.col("d")).over(f)) / F.sqrt(F.lit(6.0))).alias("scale"), F.count("*").over(f).alias("_n"))
    return d.filter(F.col("_n") == window).drop("_n")


def scale_removed(adjusted: DataFrame, plain: DataFrame, series: str, order: str) -> DataFrame:
    """(series, removed): 1 less the ratio of noise scales of an adjusted series (a) and the one it came from (v)."""
    a = noise_scale(adjusted, series, order, "a").select(series, F.col("sd").alias("sa"))
    b = noise_scale(plain, series, order, "v").select(series, F.col("sd").alias("sb"))
    return a.join(b, series).select(series, (1 - F.col("sa") / F.col("sb")).alias("removed"))
