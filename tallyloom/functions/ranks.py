"""Ranks, running sums and order statistics over a whole table, without gathering it in one task.

The table is range-partitioned by the order and written, so that every row keeps
its partition and place; the rows before a partition are a sum over one row a
partition. Rows of equal order columns lie in one partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import written


def ranked(df: DataFrame, order: list[str | Column], sums: dict[str, str] | None = None, rank: str = "rank") -> DataFrame:
    """df with the 1-based rank in the order given, and for each of sums, {new column: summed column}, the sum up to and
    including the row. Ties are broken arbitrarily unless the order is total."""
    sums = sums or {}
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    placed = df.repartitionByRange(*cols).sortWithinPartitions(*cols).withColumn("_at", F.monotonically_increasing_id())
    placed = written(placed.withColumn("_part", F.shiftright("_at", 33)), "ranked")
    parts = placed.groupBy("_part").agg(F.count("*").alias("_n"), *[F.sum(c).alias(f"_s{i}") for i, c in enumerate(sums.values())])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    parts = parts.select("_part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ["_n", *[f"_s{i}" for i in range(len(sums))]]])
    within = Window.partitionBy("_part").orderBy("_at")
    out = placed.join(F.broadcast(parts), "_part")
    place = F.col("_at") - F.shiftleft(F.col("_part"), 33) + 1
    out = out.withColumn(rank, place + F.col("_n_before"))
    for i, (name, c) in enumerate(sums.items()):
        out = out.withColumn(name, F.coalesce(F.sum(c).over(within), F.lit(0)) + F.col(f"_s{i}_before"))
    return out.drop("_at", "_part", "_n_before", *[f"_s{i}_before" for i in range(len(sums))])


def _placed(df: DataFrame, by: list[str], cols: list[Column], name: str) -> DataFrame:
    """df range-partitioned and sorted by (by, cols) and written, with its partition and place."""
    keys = [*[F.col(c) for c in by], *cols]
    placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    return written(placed.withColumn("_part", F.shiftright("_at", 33)), name)


def ranked_by(df: DataFrame, by: list[str], order: list[str | Column], sums: dict[str, str] | None = None, rank: str = "rank") -> DataFrame:
    """As `ranked`, within groups of any size: a group spreads over as many partitions as it fills. Besides one row a group
    and partition nothing is gathered."""
    sums = sums or {}
    placed = _placed(df, by, [F.col(c) if isinstance(c, str) else c for c in order], "ranked_by")
    parts = placed.groupBy("_part", *by).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"), *[F.coalesce(F.sum(c), F.lit(0)).alias(f"_s{i}") for i, c in enumerate(sums.values())])
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = ["_n", *[f"_s{i}" for i in range(len(sums))]]
    parts = parts.select("_part", *[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], "_first", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in totals])
    same = placed["_part"] == parts["_part"]
    for i, c in enumerate(by):
        same &= placed[c].eqNullSafe(parts[f"_by{i}"])
    out = placed.join(parts, same).drop(parts["_part"]).withColumn(rank, F.col("_at") - F.col("_first") + 1 + F.col("_n_before"))
    within = Window.partitionBy("_part", *by).orderBy("_at")
    for i, (name, c) in enumerate(sums.items()):
        out = out.withColumn(name, F.coalesce(F.sum(c).over(within), F.lit(0)) + F.col(f"_s{i}_before"))
    return out.drop("_at", "_part", "_first", *[f"_by{i}" for i in range(len(by))], *[f"{c}_before" for c in totals])


def last_seen(df: DataFrame, by: list[str], order: list[str | Column], value: str, name: str) -> DataFrame:
    """df with the last value that isn't null so far in its group, in the order given, the row's own included. Groups may be
    of any size: rows carry values within a range partition, and a row a group and partition carries them on."""
    placed = _placed(df, by, [F.col(c) if isinstance(c, str) else c for c in order], "last_seen")
    parts = placed.filter(F.col(value).isNotNull()).groupBy("_part", *by).agg(F.max_by(value, "_at").alias("_last"))
    every = placed.groupBy("_part", *by).agg(F.count("*").alias("_n"))
    same = [F.col(f"e.{c}").eqNullSafe(F.col(f"p.{c}")) for c in ["_part", *by]]
    rows = every.alias("e").join(parts.alias("p"), same, "left").select("e._part", *[F.col(f"e.{c}").alias(f"_by{i}") for i, c in enumerate(by)], "p._last")
    before = Window.partitionBy(*[f"_by{i}" for i in range(len(by))]).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carry = rows.withColumn("_carry", F.last("_last", ignorenulls=True).over(before)).filter("_carry is not null").drop("_last")
    held = placed["_part"] == carry["_part"]
    for i, c in enumerate(by):
        held &= placed[c].eqNullSafe(carry[f"_by{i}"])
    out = placed.join(carry, held, "left").drop(carry["_part"])
    within = Window.partitionBy("_part", *by).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumn(name, F.coalesce(F.last(value, ignorenulls=True).over(within), F.col("_carry")))
    return out.drop("_at", "_part", "_carry", *[f"_by{i}" for i in range(len(by))])


def running_by(df: DataFrame, by: list[str], order: list[str | Column], sums: dict[str, str], totals: dict[str, str]) -> DataFrame:
    """df with running sums in its groups, {new column: summed column}, the row included, and with the groups' totals, {new
    column: summed column}. Groups may be of any size and their keys null."""
    rows = ranked_by(df, by, order, sums, rank="_rank").drop("_rank")
    every = df.groupBy(*by).agg(*[F.sum(c).alias(name) for name, c in totals.items()]).withColumnsRenamed({c: f"_t_{c}" for c in by})
    same = [rows[c].eqNullSafe(every[f"_t_{c}"]) for c in by]
    return rows.join(every, same).drop(*[f"_t_{c}" for c in by])


def percentiles_by(df: DataFrame, by: list[str], column: str | Column, shares: list[float], name: str) -> DataFrame:
    """(by, name): an array of the percentiles of each group's values that aren't null, linear between the two nearest. No task
    holds the distinct values of a group."""
    v = F.col(column) if isinstance(column, str) else column
    counted = df.select(*by, v.cast("double").alias("_v")).filter(F.col("_v").isNotNull()).groupBy(*by, "_v").agg(F.count("*").alias("_c"))
    rows = running_by(counted, by, ["_v"], {"_upto": "_c"}, {"_n": "_c"})
    at = lambda place: F.min(F.when(F.col("_upto") > place, F.col("_v")))
    found, cuts = [], []
    for i, share in enumerate(shares):
        place = (F.col("_n") - 1) * share
        found += [at(F.floor(place)).alias(f"_lo{i}"), at(F.ceil(place)).alias(f"_hi{i}"), F.first(place - F.floor(place)).alias(f"_w{i}")]
        cuts.append(F.col(f"_lo{i}") * (1 - F.col(f"_w{i}")) + F.col(f"_hi{i}") * F.col(f"_w{i}"))
    return rows.groupBy(*by).agg(*found).select(*by, F.array(*cuts).alias(name))


def percentile(df: DataFrame, column: str | Column, share: float) -> float | None:
    """A percentile of a whole table's values that aren't null, linear between the two nearest order statistics; null without values."""
    v = df.select((F.col(column) if isinstance(column, str) else column).cast("double").alias("v"))
    n = v.filter(F.col("v").isNotNull() & ~F.isnan("v")).count()
    if not n:
        return None
    place = (n - 1) * share
    low = order_statistic(v, "v", int(place) + 1)
    return low if place == int(place) else low * (1 - place + int(place)) + order_statistic(v, "v", int(place) + 2) * (place - int(place))


def order_statistic(df: DataFrame, column: str, k: int) -> float | None:
    """The k-th smallest value that isn't null; null beyond their number. Every pass narrows a range of values by
    approximate quantiles; the last one picks among the few rows left."""
    rows = df.select(F.col(column).alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    n = rows.count()
    if not 1 <= k <= n:
        return None
    low, high, skipped = None, None, 0
    while True:
        inside = rows
        if low is not None:
            inside = inside.filter(F.col("v") >= low)
        if high is not None:
            inside = inside.filter(F.col("v") <= high)
        size, least, most = inside.agg(F.count("*"), F.min("v"), F.max("v")).first()
        if least == most or size <= 10_000:
            break
        share = (k - skipped) / size
        a, b = inside.stat.approxQuantile("v", [max(0.0, share - 0.02), min(1.0, share + 0.02)], 0.005)
        below = inside.filter(F.col("v") < a).count()
        upto = inside.filter(F.col("v") <= b).count()
        if not below < k - skipped <= upto:
            a, b, below = least, most, 0
        if (a, b) == (least, most):
            break
        low, high, skipped = a, b, skipped + below
    if least == most:
        return least
    # ties at one value collapse, so few rows reach the driver
    for value, count in inside.groupBy("v").count().orderBy("v").toLocalIterator():
        skipped += count
        if skipped >= k:
            return value
    return None
