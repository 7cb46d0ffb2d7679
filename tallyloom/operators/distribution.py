"""Inequality, poverty, concentration and composition of a value column, by group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.ranks import percentiles_by, ranked, ranked_by


def gini(df: DataFrame, value: str) -> DataFrame:
    """2 sum(i x_i) / (n^2 mean) - (n + 1) / n over ranks from 1; one row. Ranks come from a range partition, not from one task."""
    g = ranked(df.select(F.col(value).alias("x")).filter("x is not null"), ["x"]).agg(F.count("*").alias("n"), F.sum("x").alias("s"), F.sum(F.col("rank") * F.col("x")).alias("rx"))
    return g.select((2 * F.col("rx") / (F.col("n") * F.col("s")) - (F.col("n") + 1) / F.col("n")).alias("gini"))


def lorenz(df: DataFrame, value: str, points: int = 101) -> DataFrame:
    """(population, income) at evenly spaced population shares, interpolated between the two rows around."""
    sums = ranked(df.select(F.col(value).alias("x")).filter("x is not null"), ["x"], {"upto": "x"})
    total = sums.agg(F.count("*").alias("n"), F.sum("x").alias("s"))
    n, s = total.first()
    grid = df.sparkSession.range(points).select((F.col("id") / F.lit(float(points - 1))).alias("population"))
    at = grid.select("population", F.floor(F.col("population") * n + 1e-9).cast("long").alias("rank"))
    below = at.join(sums.select("rank", "upto"), "rank", "left").select("population", "rank", F.coalesce("upto", F.lit(0.0)).alias("lo"))
    above = below.join(sums.select((F.col("rank") - 1).alias("rank"), F.col("x").alias("next")), "rank", "left")
    part = F.greatest(F.lit(0.0), F.col("population") * n - F.col("rank"))
    return above.select("population", ((F.col("lo") + part * F.coalesce("next", F.lit(0.0))) / s).alias("income"))


def poverty(df: DataFrame, by: str, value: str, fraction: float = 0.5) -> DataFrame:
    """Line (a fraction of the median), headcount below it, gap index, and mean shortfall of the poor; zeros when there are none."""
    line = percentiles_by(df, [by], value, [0.5], "q").select(by, (F.get("q", F.lit(0)) * fraction).alias("line"))
    poor = F.col(value) < F.col("line")
    gap = F.when(poor, (F.col("line") - F.col(value)) / F.col("line"))
    return df.filter(F.col(value).isNotNull()).join(line, by).groupBy(by, "line").agg(
        F.avg(poor.cast("double")).alias("headcount"), F.avg(F.coalesce(gap, F.lit(0.0))).alias("gap"), F.coalesce(F.avg(gap), F.lit(0.0)).alias("shortfall")
    )


def battery(df: DataFrame, by: str, value: str) -> DataFrame:
    """Percentile ratios, mean over median, shares of the bottom tenth and the top hundredth, Gini, all by group."""
    q = df.groupBy(by).agg(F.count(value).alias("n"), F.avg(value).alias("mean")).join(percentiles_by(df, [by], value, [0.1, 0.5, 0.9], "q"), by)
    # ranks within a group: the rank of a value is the rows of smaller values, counted over distinct values
    distinct = df.select(by, F.col(value).alias("x")).filter("x is not null").groupBy(by, "x").agg(F.count("*").alias("c"))
    d = ranked_by(distinct, [by], ["x"], {"below": "c"}, "_i").withColumn("below", F.col("below") - F.col("c")).join(q.select(by, "n"), by)
    bottom, top = F.floor(F.col("n") * 0.1), F.col("n") - F.floor(F.col("n") * 0.01)
    in_bottom = F.greatest(F.lit(0), F.least(F.col("c"), bottom - F.col("below")))
    in_top = F.greatest(F.lit(0), F.least(F.col("c"), F.col("below") + F.col("c") - top))
    rank_sum = F.col("x") * (F.col("c") * F.col("below") + F.col("c") * (F.col("c") + 1) / 2)
    g = d.groupBy(by).agg(F.sum(F.col("x") * F.col("c")).alias("s"), F.sum(rank_sum).alias("rx"), F.sum(in_bottom * F.col("x")).alias("b"), F.sum(in_top * F.col("x")).alias("t"))
    p10, p50, p90 = (F.get("q", F.lit(i)) for i in range(3))
    return q.join(g, by).select(
        by, (2 * F.col("rx") / (F.col("n") * F.col("s")) - (F.col("n") + 1) / F.col("n")).alias("gini"), (p90 / p10).alias("p90_p10"), (p50 / p10).alias("p50_p10"), (p90 / p50).alias("p90_p50"),
        (F.col("b") / F.col("s")).alias("bottom_share"), (F.col("t") / F.col("s")).alias("top_share"), (F.col("mean") / p50).alias("mean_median"),
    )


def agreement(a: DataFrame, b: DataFrame, by: str) -> DataFrame:
    """(by, measure, relative difference) of two batteries."""
    measures = [c for c in a.columns if c != by]
    both = a.join(b.select(by, *[F.col(c).alias(f"_{c}") for c in measures]), by)
    rel = [F.struct(F.lit(c).alias("measure"), F.try_divide(F.abs(F.col(c) - F.col(f"_{c}")), F.abs(F.col(c))).alias("relative")) for c in measures]
    return both.select(by, F.explode(F.array(*rel)).alias("m")).select(by, "m.*")


def stressed_gini(df: DataFrame, value: str, scale: float, share: float = 0.1, poorest: bool = True) -> DataFrame:
    """Gini before and after the poorest (or richest) share of rows is scaled."""
    rows = ranked(df.select(F.col(value).alias("x")).filter("x is not null"), ["x"])
    n = rows.count()
    k = int(share * n)
    hit = F.col("rank") <= k if poorest else F.col("rank") > n - k
    after = rows.select(F.when(hit, F.col("x") * scale).otherwise(F.col("x")).alias("x"))
    return gini(rows.select("x"), "x").select(F.lit("before").alias("state"), "gini").union(gini(after, "x").select(F.lit("after"), "gini"))


def rank_sensitivity(df: DataFrame, value: str, stride: int) -> DataFrame:
    """dG/dx at every stride-th rank, from ranks and totals: 2 i / (n s) - 2 R / (n s^2), with R the sum of i x_i."""
    rows = ranked(df.select(F.col(value).alias("x")).filter("x is not null"), ["x"])
    n, s, big = rows.agg(F.count("*"), F.sum("x"), F.sum(F.col("rank") * F.col("x"))).first()
    return rows.filter(F.col("rank") % stride == 0).select("rank", (2 * F.col("rank") / (n * s) - 2 * big / (n * s * s)).alias("slope"))


def herfindahl(df: DataFrame, by: str, weight: str, rho: float = 0.5) -> DataFrame:
    """HHI of weights as shares, and 1 / (rho + (1 - rho) HHI) effective bets: sums of w and w^2, no window."""
    g = df.groupBy(by).agg((F.sum(F.col(weight) * F.col(weight)) / F.pow(F.sum(weight), F.lit(2))).alias("hhi"))
    return g.select(by, "hhi", (1 / (rho + (1 - rho) * F.col("hhi"))).alias("effective_bets"))


def size_biased(df: DataFrame, by: str, size: str) -> DataFrame:
    """Mean as counted, mean as experienced m + var / m, and expected wait E[g^2] / 2m."""
    m = F.avg(size)
    return df.groupBy(by).agg(m.alias("mean"), (m + F.var_pop(size) / m).alias("experienced"), (F.avg(F.col(size) * F.col(size)) / (2 * m)).alias("wait"), (m / 2).alias("naive_wait"))


def entry_effect(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """Growth of median and mean as published, over all rows of two periods, and of the matched rows that both periods have."""
    both = before.select(key, F.col(value).alias("b")).join(after.select(key, F.col(value).alias("a")), key)
    stats = lambda df, c, p: df.agg(F.percentile(c, 0.5).alias(f"med_{p}"), F.avg(c).alias(f"mean_{p}"))
    one = stats(before.select(F.col(value).alias("v")), "v", "b").withColumn("_k", F.lit(1)).join(stats(after.select(F.col(value).alias("v")), "v", "a").withColumn("_k", F.lit(1)), "_k")
    two = both.agg(F.percentile("b", 0.5).alias("mb"), F.percentile("a", 0.5).alias("ma"), F.avg("b").alias("eb"), F.avg("a").alias("ea")).withColumn("_k", F.lit(1))
    return one.join(two, "_k").select(
        (F.col("med_a") / F.col("med_b") - 1).alias("median_published"), (F.col("mean_a") / F.col("mean_b") - 1).alias("mean_published"), (F.col("ma") / F.col("mb") - 1).alias("median_matched"), (F.col("ea") / F.col("eb") - 1).alias("mean_matched")
    )


def period_rates(df: DataFrame, year: str, age: str, rate: str) -> DataFrame:
    """Total rate and mean age by year, the centred change of the mean age, and the tempo-adjusted total rate / (1 - change)."""
    g = df.groupBy(year).agg(F.sum(rate).alias("total"), (F.sum(F.col(age) * F.col(rate)) / F.sum(rate)).alias("mean_age"))
    w = Window.orderBy(year)  # one row a year
    g = g.withColumn("change", (F.lead("mean_age").over(w) - F.lag("mean_age").over(w)) / 2)
    return g.withColumn("adjusted", F.when(F.col("change") < 1, F.col("total") / (1 - F.col("change"))))


def winsor_rms(df: DataFrame, by: str, value: str, trim: float) -> DataFrame:
    """Root mean square of deviations from the median, with |deviation| cut at its 1 - trim quantile; and 1.4826 times the median |deviation|."""
    med = percentiles_by(df, [by], value, [0.5], "q").select(by, F.get("q", F.lit(0)).alias("_m"))
    dev = df.filter(F.col(value).isNotNull()).join(med, by).select(by, F.abs(F.col(value) - F.col("_m")).alias("d"))
    q = percentiles_by(dev, [by], "d", [0.5, 1 - trim], "q")
    cut = F.least(F.col("d"), F.get("q", F.lit(1)))
    return dev.join(q, by).groupBy(by).agg(F.sqrt(F.avg(cut * cut)).alias("winsor_rms"), (F.first(F.get("q", F.lit(0))) * 1.4826).alias("mad_scale"))


def tau_scale(df: DataFrame, by: str, value: str, c: float = 3.0) -> DataFrame:
    """s sqrt(mean(min((u / c)^2, 1)) c^2) of u = x / s about 0, with s the MAD about 0."""
    s = percentiles_by(df, [by], F.abs(value), [0.5], "q").select(by, (F.get("q", F.lit(0)) * 1.4826).alias("s"))
    u = F.col(value) / F.col("s") / c
    return df.join(s, by).groupBy(by, "s").agg((F.first("s") * c * F.sqrt(F.avg(F.least(u * u, F.lit(1.0))))).alias("tau"))


