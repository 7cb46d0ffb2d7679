"""Panels (indicator, country, year, value), pairs of series, alignment and interval joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.ranks import last_seen, ranked, ranked_by
from tallyloom.functions.storage import written


def complete_panel(panel: DataFrame, indicator: str, entity: str, period: str, value: str, periods: int, indicators: int) -> DataFrame:
    """Rows of the entities that have every period of every indicator and no constant series. Both counts are aggregates; the panel meets them in a semi-join."""
    per = panel.filter(F.col(value).isNotNull()).groupBy(entity, indicator).agg(F.countDistinct(period).alias("n"), F.max(value).alias("hi"), F.min(value).alias("lo"))
    good = per.groupBy(entity).agg(F.sum("n").alias("cells"), F.min(F.col("hi") - F.col("lo")).alias("least"))
    return panel.join(good.filter((F.col("cells") == periods * indicators) & (F.col("least") > 0)), entity, "left_semi")


def standardised(df: DataFrame, series: str, value: str) -> DataFrame:
    """(series, value) scaled so that the sum of products of two series over common times is their correlation."""
    m = df.groupBy(series).agg(F.avg(value).alias("_m"), F.sqrt(F.var_pop(value) * F.count(value)).alias("_s"))
    return df.join(m, series).withColumn("z", (F.col(value) - F.col("_m")) / F.col("_s")).drop("_m", "_s")


def pair_correlations(df: DataFrame, series: str, time: str, value: str, labels: list[str]) -> DataFrame:
    """Pearson r of every two series of a complete panel: an equi-join on time and a sum, combined before the shuffle.
    (a, b, a_<label>.., b_<label>.., r) with a < b. Series that are constant have no r and are left out."""
    z = standardised(df, series, value).filter("z is not null")
    left = z.select(time, F.col(series).alias("a"), F.col("z").alias("za"), *[F.col(c).alias(f"a_{c}") for c in labels])
    right = z.select(time, F.col(series).alias("b"), F.col("z").alias("zb"), *[F.col(c).alias(f"b_{c}") for c in labels])
    keys = ["a", "b", *[f"{s}_{c}" for c in labels for s in "ab"]]
    return left.join(right, time).filter("a < b").groupBy(*keys).agg(F.sum(F.col("za") * F.col("zb")).alias("r"))


def pair_summary(pairs: DataFrame, kind: str, cuts: tuple[float, ...] = (0.5, 0.8, 0.9, 0.96)) -> DataFrame:
    """Per kind of pair: count, median |r|, and the share above each cut."""
    return pairs.groupBy(kind).agg(F.count("*").alias("n"), F.percentile(F.abs("r"), 0.5).alias("median_abs_r"), *[F.avg((F.abs("r") > c).cast("double")).alias(f"above_{str(c)[2:]}") for c in cuts])


def strongest_pairs(pairs: DataFrame, top: int) -> DataFrame:
    return pairs.orderBy(F.desc(F.abs("r")), "a", "b").limit(top)


def aligned(x: DataFrame, y: DataFrame, date: str, lead: bool) -> DataFrame:
    """Inner join of (date, x) and (date, y) on equal dates; with lead, y of its own next row stands under the date. Nulls go."""
    if lead:
        placed = ranked(y.select(date, "y"), [date], rank="_i")
        y = placed.select(date, "_i").join(placed.select((F.col("_i") - 1).alias("_i"), "y"), "_i").select(date, "y")
    return x.join(y, date).filter("x is not null and y is not null")


def aligned_by(x: DataFrame, y: DataFrame, key: str, date: str, lead: bool) -> DataFrame:
    """The same for many series at once."""
    if lead:
        y = y.select(key, date, F.lead("y").over(Window.partitionBy(key).orderBy(date)).alias("y"))
    return x.join(y, [key, date]).filter("x is not null and y is not null")


def in_interval(points: DataFrame, edges: DataFrame, key: str, at: str, edge: str) -> DataFrame:
    """For each point the right-open interval between edges of its key that holds it: gap and remaining wait. Each edge takes
    the next one of its key along; points and edges are sorted as one table, and the last interval so far is carried on, so
    no pair is formed and a key may spread over many tasks."""
    ends = written(ranked_by(edges.select(F.col(key).alias("k"), F.col(edge).alias("lo")).distinct(), ["k"], ["lo"]), "edges")
    ends = ends.join(ends.select("k", (F.col("rank") - 1).alias("rank"), F.col("lo").alias("hi")), ["k", "rank"]).select("k", F.struct("lo", "hi").alias("span"))
    both = points.select(F.col(key).alias("k"), F.col(at).alias("t"), F.lit(1).alias("is_point"), F.lit(None).cast(ends.schema["span"].dataType).alias("span"))
    both = both.union(ends.select("k", "span.lo", F.lit(0), "span"))
    found = last_seen(both, ["k"], ["t", "is_point"], "span", "held").filter("is_point = 1 and t < held.hi")
    return found.select(F.col("k").alias(key), "t", (F.col("held.hi") - F.col("held.lo")).alias("gap"), (F.col("held.hi") - F.col("t")).alias("wait"))


def paired_runs(a: DataFrame, b: DataFrame, keys: list[str], metric: str, by: str) -> DataFrame:
    """Two result tables on equal keys, positive and finite scores only: geometric mean ratio and share of wins, by group."""
    both = a.select(*keys, F.col(metric).alias("_a")).join(b.select(*keys, F.col(metric).alias("_b")), keys)
    good = both.filter("_a > 0 and _b > 0 and not isnan(_a) and not isnan(_b) and _a < double('infinity') and _b < double('infinity')")
    return good.groupBy(by).agg(F.count("*").alias("n"), F.exp(F.avg(F.log(F.col("_a") / F.col("_b")))).alias("ratio"), F.avg((F.col("_a") < F.col("_b")).cast("double")).alias("wins"))


def share_of_key(df: DataFrame, period: str, key: str, chosen: object, weight: str, value: str) -> DataFrame:
    """Per period: the share of one key by weight and by value, and unit values of it and of all."""
    own = F.col(key) == F.lit(chosen)
    g = df.groupBy(period).agg(F.sum(weight).alias("w"), F.sum(value).alias("v"), F.sum(F.when(own, F.col(weight))).alias("kw"), F.sum(F.when(own, F.col(value))).alias("kv")).filter("kw is not null")
    return g.select(period, (F.col("kw") / F.col("w")).alias("share_weight"), (F.col("kv") / F.col("v")).alias("share_value"), (F.col("kv") / F.col("kw")).alias("unit_key"), (F.col("v") / F.col("w")).alias("unit_all"))
