"""Resampling, permutation and splits. Every choice follows from an MD5 of seed, replicate and key, so reruns and partitions don't change it."""

from __future__ import annotations

from math import exp, factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.hashing import md5_share
from tallyloom.functions.ranks import ranked, ranked_by, running_by
from tallyloom.functions.storage import written


def key(seed: str, *cols: Column | str) -> Column:
    """The text that a choice follows from."""
    return F.concat_ws(":", F.lit(seed), *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols])


def poisson(u: Column, most: int = 8) -> Column:
    """Poisson(1) counts from a uniform share; above `most` the chance is below 2e-6."""
    upto, out = 0.0, F.lit(most)
    bounds = []
    for k in range(most):
        upto += exp(-1) / factorial(k)
        bounds.append((k, upto))
    for k, b in reversed(bounds):
        out = F.when(u < round(b, 12), k).otherwise(out)
    return out


def with_replicates(df: DataFrame, reps: int) -> DataFrame:
    return df.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))


def bootstrap_means(df: DataFrame, by: str, unit: str, value: str, reps: int, seed: str) -> DataFrame:
    """(by, rep, mean): weighted means by Poisson counts of units; rows of a unit share its count, so each unit is summed up
    before it is drawn. Sums over units are combined before the shuffle."""
    units = df.select(by, unit, value).groupBy(by, unit).agg(F.sum(value).alias("_v"), F.count("*").alias("_n"))
    d = with_replicates(units, reps).withColumn("_w", poisson(md5_share(key(seed, "rep", unit))))
    return d.groupBy(by, "rep").agg(F.try_divide(F.sum(F.col("_w") * F.col("_v")), F.sum(F.col("_w") * F.col("_n"))).alias("mean"))


def percentile_interval(draws: DataFrame, by: str, value: str, level: float = 0.9) -> DataFrame:
    q = F.percentile(value, [(1 - level) / 2, (1 + level) / 2])
    return draws.groupBy(by).agg(F.avg(value).alias("centre"), q.alias("q")).select(by, "centre", F.get("q", F.lit(0)).alias("lower"), F.get("q", F.lit(1)).alias("upper"))


def paired_bootstrap(df: DataFrame, by: str, unit: str, a: str, b: str, reps: int, seed: str) -> DataFrame:
    """(by, rep, percent): 100 (mean b - mean a) / mean a, with the same counts for both columns."""
    units = df.select(by, unit, a, b).groupBy(by, unit).agg(F.sum(a).alias("_a"), F.sum(b).alias("_b"))
    d = with_replicates(units, reps).withColumn("_w", poisson(md5_share(key(seed, "rep", unit))))
    total = lambda c: F.sum(F.col("_w") * F.col(c))
    return d.groupBy(by, "rep").agg((100 * (total("_b") - total("_a")) / total("_a")).alias("percent"))


def block_indices(lengths: DataFrame, series: str, n: str, block: int, reps: int, seed: str) -> DataFrame:
    """(series, rep, place, position): for each replicate a run of positions of length n, made of blocks whose starts are uniform in [0, n - block]."""
    d = lengths.select(series, F.col(n).cast("long").alias("n"), F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"))
    d = d.select(series, "n", "rep", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / block) - 1)).alias("b"))
    start = F.floor(md5_share(key(seed, series, "rep", "b")) * (F.col("n") - block + 1))
    d = d.select(series, "n", "rep", "b", start.alias("start")).select(series, "n", "rep", "b", "start", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(block - 1).cast("long"))).alias("i"))
    d = d.withColumn("place", F.col("b") * block + F.col("i")).filter("place < n")
    return d.select(series, "rep", "place", (F.col("start") + F.col("i")).alias("position"))


def numbered(df: DataFrame, series: str, order: str, name: str = "position") -> DataFrame:
    return df.withColumn(name, (F.row_number().over(Window.partitionBy(series).orderBy(order)) - 1).cast("long"))


def block_bootstrap(df: DataFrame, series: str, order: str, value: str, block: int, reps: int, seed: str) -> DataFrame:
    """(series, rep, place, value): moving-block resamples."""
    rows = numbered(df.select(series, order, value), series, order)
    n = rows.groupBy(series).agg(F.count("*").alias("n"))
    return block_indices(n, series, "n", block, reps, seed).join(rows.select(series, "position", value), [series, "position"]).select(series, "rep", "place", value)


def permuted(df: DataFrame, by: str, unit: str, value: str, rep: int, seed: str) -> DataFrame:
    """df with `shuffled`: the column's values in the order of a hash of the unit, within groups, by a join of two numberings."""
    a = ranked_by(df, [by], [unit], rank="_i")
    h = df.select(by, F.col(value).alias("shuffled"), F.md5(key(seed, F.lit(rep), unit)).alias("_h"), F.col(unit).alias("_u"))
    return a.join(ranked_by(h, [by], ["_h", "_u"], rank="_i").drop("_h", "_u"), [by, "_i"]).drop("_i")


def drawn_labels(df: DataFrame, unit: str, p: str, reps: int, seed: str) -> DataFrame:
    """df for each replicate with `drawn`: 1 with probability p."""
    return with_replicates(df, reps).withColumn("drawn", (md5_share(key(seed, "rep", unit)) < F.col(p)).cast("int"))


def subsets(df: DataFrame, by: str, unit: str, size: int, reps: int, seed: str) -> DataFrame:
    """Of each group and replicate the `size` rows of smallest hash."""
    w = Window.partitionBy(by, "rep").orderBy(F.md5(key(seed, "rep", unit)), unit)
    return with_replicates(df, reps).withColumn("_i", F.row_number().over(w)).filter(F.col("_i") <= size).drop("_i")


def stratified_folds(df: DataFrame, label: str, unit: str, k: int, seed: str) -> DataFrame:
    """Folds that hold each label evenly: the place in hash order within a label, modulo k."""
    d = ranked_by(df.withColumn("_h", F.md5(key(seed, unit))), [label], ["_h", unit], rank="_i")
    return d.withColumn("fold", ((F.col("_i") - 1) % k).cast("int")).drop("_h", "_i")


def grouped_folds(df: DataFrame, group: str, k: int, seed: str) -> DataFrame:
    """All rows of a group in one fold."""
    return df.withColumn("fold", F.floor(md5_share(key(seed, group)) * k).cast("int"))


def block_folds(df: DataFrame, series: str, order: str, k: int) -> DataFrame:
    """k contiguous folds."""
    return df.withColumn("fold", F.ntile(k).over(Window.partitionBy(series).orderBy(order)) - 1)


def split_coverage(df: DataFrame, unit: str | Column, score: str, reps: int, alpha: float, share: float, seed: str) -> DataFrame:
    """(rep, coverage): calibration and test dealt by a hash of the unit; the cut is the ceil((n + 1)(1 - alpha))-th smallest calibration score, or the largest."""
    u = F.col(unit) if isinstance(unit, str) else unit
    d = with_replicates(df.select(u.alias("_u"), F.col(score).alias("s")), reps).withColumn("cal", md5_share(key(seed, "rep", "_u")) < share)
    tested = ~F.col("cal") & F.col("s").isNotNull()
    c = written(d.groupBy("rep", "s").agg(F.count_if("cal").alias("c"), F.count_if(tested).alias("t"), F.count_if(~F.col("cal")).alias("o")), "dealt")  # hashes once
    c = running_by(c, ["rep"], [F.col("s").isNull(), "s"], {"upto": "c", "below": "t"}, {"n": "c", "tests": "t", "others": "o"}).filter("n > 0 and others > 0")
    k = F.least(F.ceil((F.col("n") + 1) * (1 - alpha) - 1e-9), F.col("n"))
    inside = F.min(F.when(F.col("s").isNotNull() & (F.col("upto") >= k), F.col("below"))).cast("double")
    return c.groupBy("rep").agg(F.try_divide(inside, F.first("tests")).alias("coverage"))


def at_most(df: DataFrame, by: str, unit: str, k: int, seed: str) -> DataFrame:
    """At most k rows a group, those of smallest hash; k may be large."""
    d = ranked_by(df.withColumn("_h", F.md5(key(seed, unit))), [by], ["_h", unit], rank="_i")
    return d.filter(F.col("_i") <= k).drop("_h", "_i")


def shuffled(df: DataFrame, unit: str, seed: str) -> DataFrame:
    """df with `position`, the place in a seeded permutation of the rows: ranks over a range partition of the hashes."""
    return ranked(df.withColumn("_h", F.md5(key(seed, unit))), ["_h", unit], rank="position").drop("_h")


def oversampled(df: DataFrame, label: str, unit: str, seed: str) -> DataFrame:
    """The rarer of two labels repeated to parity: every row floor(ratio) times, and the rows of smallest hash once more."""
    n = df.groupBy(label).agg(F.count("*").alias("n"))
    big = n.agg(F.max("n")).first()[0]
    d = ranked_by(df.withColumn("_h", F.md5(key(seed, unit))), [label], ["_h", unit], rank="_i").drop("_h").join(n, label)
    times = F.floor(big / F.col("n")) + F.when(F.col("_i") <= big % F.col("n"), 1).otherwise(0)
    return d.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), times.cast("long")))).drop("n", "_i")


def undersampled(df: DataFrame, label: str, unit: str, seed: str) -> DataFrame:
    least = df.groupBy(label).agg(F.count("*").alias("n")).agg(F.min("n")).first()[0]
    return at_most(df, label, unit, least, seed)


def class_weights(df: DataFrame, label: str) -> DataFrame:
    n = df.groupBy(label).agg(F.count("*").alias("n"))
    total, classes = n.agg(F.sum("n"), F.count("*")).first()
    return n.select(label, (F.lit(float(total)) / (classes * F.col("n"))).alias("weight"))


def contiguous_draws(df: DataFrame, series: str, order: str, value: str, size: int, reps: int, seed: str) -> DataFrame:
    """(series, rep, kurtosis, n) of random contiguous stretches of a size."""
    rows = numbered(df.select(series, order, value), series, order)
    n = rows.groupBy(series).agg(F.count("*").alias("n")).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    starts = n.select(series, "rep", F.floor(md5_share(key(seed, series, "rep")) * (F.col("n") - size + 1)).alias("start"))
    d = starts.select(series, "rep", F.explode(F.sequence("start", F.col("start") + size - 1)).alias("position")).join(rows, [series, "position"])
    return d.groupBy(series, "rep").agg(F.kurtosis(value).alias("kurtosis"), F.count("*").alias("n"))


def masked(df: DataFrame, unit: str, column: str, chance: Column, seed: str) -> DataFrame:
    """df with cells of a column set to null with the chance given, and `was_masked`."""
    hit = md5_share(key(seed, F.lit(column), unit)) < chance
    return df.withColumns({"was_masked": hit, column: F.when(~hit, F.col(column))})


def contaminated(df: DataFrame, unit: str, y: str, fraction: float, shift: Column, seed: str) -> DataFrame:
    """df with a share of rows shifted in y, chosen by hash, and `is_outlier`."""
    hit = md5_share(key(seed, unit)) < fraction
    return df.withColumns({"is_outlier": hit, y: F.when(hit, F.col(y) + shift).otherwise(F.col(y))})


def leveraged(df: DataFrame, unit: str, x: str, y: str, fraction: float, at: float, wrong: float, seed: str) -> DataFrame:
    """df with a share of rows moved to a far x with a wrong y."""
    hit = md5_share(key(seed, unit)) < fraction
    return df.withColumns({"is_leverage": hit, x: F.when(hit, F.lit(at)).otherwise(F.col(x)), y: F.when(hit, F.lit(wrong)).otherwise(F.col(y))})
