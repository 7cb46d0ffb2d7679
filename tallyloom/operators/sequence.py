"""Operators along an ordered series: (series, order, value), a window of one series at a time."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.ranks import running_by


def ewma_scale(df: DataFrame, series: str, order: str, value: str, lam: float = 0.94, warmup: int = 60) -> DataFrame:
    """Past-only scale: v is the sample variance of the first `warmup` points, then v <- lam v + (1 - lam) x^2 of the point before.
    In closed form over a frame so long that what it leaves out is below 1e-12 of the weight, so no loop runs over rows. Series of
    `warmup` points or fewer give no rows."""
    reach = int(np.ceil(np.log(1e-12) / np.log(lam)))
    w = Window.partitionBy(series).orderBy(order)
    d = df.filter(F.col(value).isNotNull()).select(series, order, F.col(value).alias("x"), (F.row_number().over(w) - 1).alias("t"))
    start = d.filter(F.col("t") < warmup).groupBy(series).agg(F.var_samp("x").alias("v0"))
    frame = w.rowsBetween(-reach, -1)
    # points of the warm-up have weight 0; lam^(last - i) is lam^-(i - last) within the frame
    past = F.collect_list(F.when(F.col("t") >= warmup, F.col("x")).otherwise(F.lit(0.0))).over(frame)
    summed = F.aggregate(past, F.lit(0.0), lambda a, x: a * lam + (1 - lam) * x * x)
    d = d.withColumn("s", summed).filter(F.col("t") >= warmup).join(start, series)
    return d.select(series, order, F.col("x").alias(value), F.sqrt(F.pow(F.lit(lam), F.col("t") - warmup) * F.col("v0") + F.col("s")).alias("scale"))


def devolatilised(df: DataFrame, series: str, order: str, value: str, lam: float = 0.94, warmup: int = 60) -> DataFrame:
    s = ewma_scale(df, series, order, value, lam, warmup)
    return s.filter("scale > 0").select(series, order, (F.col(value) / F.col("scale")).alias("z"))


def centred_scale(df: DataFrame, series: str, order: str, value: str, window: int = 21) -> DataFrame:
    """Two-sided rolling standard deviation of half a window of points at least, then filled backwards and forwards."""
    half = window // 2
    w = Window.partitionBy(series).orderBy(order)
    f = w.rowsBetween(-half, half)
    sd = F.when(F.count(value).over(f) >= half, F.stddev_samp(value).over(f))
    d = df.select(series, order, sd.alias("s"))
    # the next one in order is the last one backwards: a frame that is open ahead would be read again for every row
    back = Window.partitionBy(series).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    filled = F.coalesce("s", F.last("s", ignorenulls=True).over(back), F.last("s", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.select(series, order, filled.alias("scale"))


def rolling_mean_full(df: DataFrame, series: str, order: str, value: str, window: int) -> DataFrame:
    """Means over full windows only."""
    w = Window.partitionBy(series).orderBy(order)
    d = df.select(series, order, F.avg(value).over(w.rowsBetween(-(window - 1), 0)).alias("mean"), F.row_number().over(w).alias("_i"))
    return d.filter(F.col("_i") >= window).drop("_i")


def within_window_clustering(df: DataFrame, series: str, order: str, value: str, lengths: list[int]) -> DataFrame:
    """Mean over all windows of a length of the lag-1 correlation of |value| within the window, from sums over frames."""
    w = Window.partitionBy(series).orderBy(order)
    d = df.select(series, order, F.abs(value).alias("x"), F.lag(F.abs(value)).over(w).alias("b"), F.row_number().over(w).alias("i"))
    out = None
    for n in lengths:
        f = w.rowsBetween(-(n - 2), 0)
        part = d.select(series, F.lit(n).alias("length"), "i", F.corr("x", "b").over(f).alias("r")).filter(F.col("i") >= n)
        part = part.groupBy(series, "length").agg(F.avg("r").alias("clustering"), F.count("*").alias("windows"))
        out = part if out is None else out.unionByName(part)
    return out


def episodes(df: DataFrame, series: str, order: str, flag: str) -> DataFrame:
    """First place and length of every stretch of rows whose flag is set."""
    w = Window.partitionBy(series).orderBy(order)
    d = df.select(series, order, F.row_number().over(w).alias("i"), F.sum(F.col(flag).cast("int")).over(w).alias("c"), F.col(flag).alias("f")).filter("f")
    return d.groupBy(series, (F.col("i") - F.col("c")).alias("g")).agg(F.min(order).alias("first"), F.count("*").alias("length")).drop("g")


def rolling_origin(df: DataFrame, series: str, order: str, folds: int, val_len: int, min_train: int) -> DataFrame:
    """(series, order, fold, role): expanding training sets, each followed by val_len rows. A series too short for its folds is an error."""
    w = Window.partitionBy(series).orderBy(order)
    d = df.select(series, order, F.row_number().over(w).alias("i"), F.count("*").over(Window.partitionBy(series)).alias("n"))
    step = F.when(F.col("n") - min_train >= folds * val_len, F.floor((F.col("n") - min_train - val_len) / F.greatest(F.lit(folds - 1), F.lit(1)))).otherwise(F.raise_error(F.lit("a series is too short for its folds")).cast("long"))
    d = d.select(series, order, "i", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("fold"), step.alias("step"))
    end = F.lit(min_train) + F.col("fold") * F.col("step")
    role = F.when(F.col("i") <= end, "train").when(F.col("i") <= end + val_len, "validate")
    return d.select(series, order, "fold", role.alias("role")).filter("role is not null")


def backtest_origins(df: DataFrame, series: str, order: str, horizon: int, min_context: int) -> DataFrame:
    """(series, order, origin): horizons from the end backwards that don't overlap, while enough rows lie before them."""
    back, whole = Window.partitionBy(series).orderBy(F.desc(order)), Window.partitionBy(series)
    d = df.select(series, order, F.floor((F.row_number().over(back) - 1) / horizon).alias("origin"), F.count("*").over(whole).alias("n"))
    return d.filter(F.col("n") - (F.col("origin") + 1) * horizon >= min_context).drop("n")


def seasonal_naive(df: DataFrame, series: str, order: str, value: str, season: int, horizon: int, levels: list[float]) -> DataFrame:
    """For each step ahead of a series' end: the value a season before, and quantiles from season-step errors widened by sqrt(1 + step // season)."""
    w, back = Window.partitionBy(series).orderBy(order), Window.partitionBy(series).orderBy(F.desc(order))
    d = df.select(series, F.col(value).alias("v"), (F.col(value) - F.lag(value, season).over(w)).alias("e"), F.row_number().over(back).alias("b"))
    q = d.groupBy(series).agg(F.percentile("e", levels).alias("q"))
    tail = d.filter(F.col("b") <= season).select(series, "v", (F.lit(season) - F.col("b")).alias("phase"))
    steps = tail.select(series, "v", F.explode(F.filter(F.sequence(F.lit(0), F.lit(horizon - 1)), lambda s: s % season == F.col("phase"))).alias("step"))
    out = steps.join(q, series)
    wide = F.sqrt(1 + F.floor(F.col("step") / season))
    return out.select(series, "step", F.col("v").alias("forecast"), F.posexplode("q").alias("level", "e")).select(series, "step", "forecast", F.element_at(F.array(*[F.lit(x) for x in levels]), F.col("level") + 1).alias("level"), (F.col("forecast") + wide * F.col("e")).alias("quantile"))


def breach_counts(df: DataFrame, series: str, order: str, breach: str) -> DataFrame:
    w = Window.partitionBy(series).orderBy(order)
    d = df.select(series, F.col(breach).cast("int").alias("b"), F.lag(F.col(breach).cast("int")).over(w).alias("p"))
    n = lambda i, j: F.count_if((F.col("p") == i) & (F.col("b") == j))
    return d.groupBy(series).agg(F.count("*").alias("n"), F.sum("b").alias("x"), n(0, 0).alias("n00"), n(0, 1).alias("n01"), n(1, 0).alias("n10"), n(1, 1).alias("n11"))


def _xlogy(x, y):
    return F.when(x == 0, 0.0).otherwise(x * F.log(F.when(y > 0, y)))


def var_backtest(df: DataFrame, series: str, order: str, breach: str, alpha: float) -> DataFrame:
    """Likelihood ratios of the breach rate against alpha, and of independence of breaches (null where it isn't identified)."""
    c = breach_counts(df, series, order, breach)
    n, x = F.col("n").cast("double"), F.col("x").cast("double")
    pof = -2 * (_xlogy(n - x, F.lit(1 - alpha)) + _xlogy(x, F.lit(alpha)) - _xlogy(n - x, 1 - x / n) - _xlogy(x, x / n))
    n00, n01, n10, n11 = (F.col(k).cast("double") for k in ("n00", "n01", "n10", "n11"))
    p01, p11, p = n01 / (n00 + n01), F.try_divide(n11, n10 + n11), (n01 + n11) / (n00 + n01 + n10 + n11)
    ind = -2 * (_xlogy(n00 + n10, 1 - p) + _xlogy(n01 + n11, p) - _xlogy(n00, 1 - p01) - _xlogy(n01, p01) - _xlogy(n10, 1 - p11) - _xlogy(n11, p11))
    return c.select("*", pof.alias("lr_rate"), F.when((n10 + n11 > 0) & (n01 + n11 > 0), ind).alias("lr_independence"))


def loss_difference(df: DataFrame, series: str, order: str, y: str, a: str, b: str, h: int) -> DataFrame:
    """Mean difference of squared errors, its variance with h - 1 autocovariances, the statistic, and the small-sample factor on it."""
    w = Window.partitionBy(series).orderBy(order)
    d = df.select(series, order, (F.pow(F.col(y) - F.col(a), F.lit(2)) - F.pow(F.col(y) - F.col(b), F.lit(2))).alias("d")).filter("d is not null")
    m = d.groupBy(series).agg(F.avg("d").alias("m"), F.count("*").alias("n"))
    c = d.join(m, series).select(series, order, "n", "m", (F.col("d") - F.col("m")).alias("c"))
    terms = [F.lag("c", i).over(w).alias(f"c{i}") for i in range(1, h)]
    c = c.select(series, "n", "m", "c", *terms)
    var = F.sum(F.col("c") * F.col("c")) + 2 * sum((F.coalesce(F.sum(F.col("c") * F.col(f"c{i}")), F.lit(0.0)) for i in range(1, h)), F.lit(0.0))
    g = c.groupBy(series, "n", "m").agg((var / F.first("n")).alias("v"))
    factor = F.sqrt((F.col("n") + 1 - 2 * h + h * (h - 1) / F.col("n")) / F.col("n"))
    ok = (F.col("v") > 0) & (F.col("n") >= 10)
    return g.select(series, "n", F.col("m").alias("mean_difference"), F.when(ok, F.col("m") / F.sqrt(F.col("v") / F.col("n")) * factor).alias("statistic"))


def first_exceedance(df: DataFrame, by: list[str], step: str, error: str, threshold: float) -> DataFrame:
    """The first step whose error passes the threshold, or the number of steps."""
    return df.groupBy(*by).agg(F.coalesce(F.min(F.when(F.col(error) > threshold, F.col(step))), F.count("*")).alias("valid_steps"))


def uniformity(df: DataFrame, by: str, u: str) -> DataFrame:
    """One-sample Kolmogorov-Smirnov distance from the uniform distribution, over distinct values."""
    d = running_by(df.groupBy(by, F.col(u).alias("u")).agg(F.count("*").alias("c")), [by], ["u"], {"upto": "c"}, {"n": "c"})
    return d.groupBy(by).agg(F.max(F.greatest(F.col("upto") / F.col("n") - F.col("u"), F.col("u") - (F.col("upto") - F.col("c")) / F.col("n"))).alias("ks"), F.first("n").alias("n"))


def holt(df: DataFrame, series: str, order: str, value: str, horizon: int, levels: list[float], min_rows: int = 10) -> DataFrame:
    """Damped additive trend, its three parameters by least squared one-step error on a small grid, one series a group;
    quantiles widen residual quantiles by sqrt(step + 1). Series of fewer rows repeat their last value and are flagged."""

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order)
        y = rows[value].to_numpy(float)
        y = y[np.isfinite(y)]
        fallback = len(y) < min_rows
        if fallback:
            point, residual = np.full(horizon, y[-1] if len(y) else np.nan), np.zeros(1)
        else:
            grid = np.array(np.meshgrid([0.1, 0.3, 0.5, 0.8], [0.01, 0.1, 0.3], [0.8, 0.9, 0.98])).reshape(3, -1)
            a, b, f = grid
            level, trend = np.full(len(a), y[0]), np.full(len(a), y[1] - y[0])
            errors = []
            for v in y[1:]:
                ahead = level + f * trend
                errors.append(v - ahead)
                new = ahead + a * (v - ahead)
                trend = f * trend + a * b * (v - ahead)
                level = new
            errors = np.array(errors)
            best = int(np.argmin((errors**2).sum(axis=0)))
            residual = errors[:, best]
            point = level[best] + trend[best] * np.cumsum(f[best] ** np.arange(1, horizon + 1))
        q = np.quantile(residual, levels)
        out = [(rows[series].iloc[0], s, float(point[s]), lv, float(point[s] + e * np.sqrt(s + 1)), fallback) for s in range(horizon) for lv, e in zip(levels, q)]
        return pd.DataFrame(out, columns=[series, "step", "forecast", "level", "quantile", "fallback"])

    kind = df.schema[series].dataType.simpleString()
    return df.select(series, order, value).groupBy(series).applyInPandas(fit, f"{series} {kind}, step int, forecast double, level double, quantile double, fallback boolean")


def matched_absence(lengths: DataFrame, series: str, seed: str) -> DataFrame:
    """(series, first, length): for each series' n rows, spells of given lengths placed at random without overlap or touch, longest
    first; each is equally likely at all places that are left, and has a null place if there are none. lengths has (series,
    n, lengths array). The places follow from the seed and the series."""
    def place(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in rows:
            out = []
            for s, n, ls in zip(batch[series], batch["n"], batch["lengths"]):
                rng = np.random.default_rng(int.from_bytes(hashlib.sha256(f"{seed}:{s}".encode()).digest()[:8], "big"))
                taken = np.zeros(int(n), bool)
                for length in sorted(map(int, ls), reverse=True):
                    # no taken row from the one before the spell to the one after it
                    held = np.concatenate([[0], np.cumsum(np.concatenate([[False], taken, [False]]))])
                    free = np.flatnonzero(held[length + 2 :] == held[: -(length + 2)]) if length <= n else np.zeros(0, int)
                    a = int(free[rng.integers(len(free))]) if len(free) else None
                    if a is not None:
                        taken[a : a + length] = True
                    out.append((s, a, length))
            yield pd.DataFrame(out, columns=[series, "first", "length"]).astype({"first": "Int64"})

    kind = lengths.schema[series].dataType.simpleString()
    return lengths.select(series, "n", "lengths").mapInPandas(place, f"{series} {kind}, first long, length long")
