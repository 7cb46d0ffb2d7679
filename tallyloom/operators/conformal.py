"""Prediction intervals and sets from calibration scores.

A calibration score's order statistic is taken from distinct scores with their
counts and running sums over range partitions, so a group may be of any size;
ties of a score stay together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.ranks import ranked, running_by


def quantile(calibration: DataFrame, by: str, score: Column, alpha: float, clip: bool = False) -> DataFrame:
    """(by, q, n): the ceil((n + 1)(1 - alpha))-th smallest score that is finite; infinite beyond n, or the largest with clip."""
    d = calibration.select(by, score.alias("s")).filter("s is not null and not isnan(s) and s < double('infinity')").groupBy(by, "s").agg(F.count("*").alias("c"))
    d = running_by(d, [by], ["s"], {"upto": "c"}, {"n": "c"})
    k = F.ceil((F.col("n") + 1) * (1 - alpha) - 1e-9)
    k = F.least(k, F.col("n")) if clip else k
    return d.groupBy(by).agg(F.coalesce(F.min(F.when(F.col("upto") >= k, F.col("s"))), F.lit(float("inf"))).alias("q"), F.first("n").alias("n"))


def split(calibration: DataFrame, test: DataFrame, by: str, pred: str, truth: str, alpha: float, scale: str | None = None) -> DataFrame:
    """test with lower and upper: pred -+ q of |residual|, or of |residual| / scale times the scale, which must be above 0."""
    size = F.col(scale) if scale else F.lit(1.0)
    q = quantile(calibration, by, F.abs(F.col(truth) - F.col(pred)) / size, alpha).select(by, "q")
    return test.join(q, by).withColumns({"lower": F.col(pred) - F.col("q") * size, "upper": F.col(pred) + F.col("q") * size}).drop("q")


def cqr(calibration: DataFrame, test: DataFrame, by: str, lo: str, hi: str, truth: str, alpha: float) -> DataFrame:
    """Quantile bounds widened, or tightened, by q of max(lo - y, y - hi)."""
    q = quantile(calibration, by, F.greatest(F.col(lo) - F.col(truth), F.col(truth) - F.col(hi)), alpha).select(by, "q")
    return test.join(q, by).withColumns({"lower": F.col(lo) - F.col("q"), "upper": F.col(hi) + F.col("q")}).drop("q")


def weighted(calibration: DataFrame, test: DataFrame, pred: str, truth: str, weight: str, alpha: float) -> DataFrame:
    """Per test row the first score at which the calibration weight so far reaches (1 - alpha)(all of it + the row's own); infinite if none.
    Running weights are over ranges of the score. A test row finds its score among all by one sort of both, as of the last before it."""
    s = calibration.select(F.abs(F.col(truth) - F.col(pred)).alias("s"), F.col(weight).alias("w")).groupBy("s").agg(F.sum("w").alias("w"))
    total = s.agg(F.sum("w")).first()[0]
    run = ranked(s, ["s"], {"upto": "w"}).select(F.col("upto").alias("at"), F.col("s"))
    need = test.withColumn("at", (1 - alpha) * (total + F.col(weight)) - 1e-9)
    # the smallest score with upto >= at: from the far end, the last score seen
    both = run.select("at", "s", F.lit(None).cast("struct<%s>" % ",".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in test.schema)).alias("row"), F.lit(0).alias("is_row"))
    both = both.union(need.select("at", F.lit(None).cast("double"), F.struct(*test.columns), F.lit(1)))
    placed = ranked(both, [F.desc("at"), "is_row"], rank="place")
    # scores fall as places rise, so the least score before a row is the running minimum
    part = placed.withColumn("block", F.floor(F.col("place") / 100_000))
    firsts = part.groupBy("block").agg(F.min("s").alias("m"))
    before = firsts.withColumn("m", F.min("m").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)))
    inside = F.min("s").over(Window.partitionBy("block").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    found = part.withColumn("i", inside).join(F.broadcast(before), "block").withColumn("q", F.coalesce(F.least("i", "m"), F.lit(float("inf")))).filter("is_row = 1")
    return found.select("row.*", "q").withColumns({"lower": F.col(pred) - F.col("q"), "upper": F.col(pred) + F.col("q")})


def effective_size(df: DataFrame, by: str, weight: str) -> DataFrame:
    return df.groupBy(by).agg((F.pow(F.sum(weight), F.lit(2)) / F.sum(F.col(weight) * F.col(weight))).alias("effective_n"))


def sets(calibration: DataFrame, test: DataFrame, by: str, p: str, y: str, alpha: float) -> DataFrame:
    """test with the classes whose probability is at least 1 - q of 1 - p[y]; the order statistic is the largest score where there are too few."""
    score = 1 - F.get(p, F.col(y).cast("int"))
    q = quantile(calibration, by, score, alpha, clip=True).select(by, "q")
    members = F.filter(F.transform(F.col(p), lambda v, i: F.when(v >= 1 - F.col("q") - 1e-12, i)), lambda i: i.isNotNull())
    return test.join(q, by).withColumn("members", members).drop("q")


def set_report(df: DataFrame, by: str, y: str) -> DataFrame:
    n = F.size("members")
    return df.groupBy(by).agg(
        F.avg(F.array_contains("members", F.col(y).cast("int")).cast("double")).alias("coverage"), F.avg(n.cast("double")).alias("size"), F.avg((n == 1).cast("double")).alias("single"), F.avg((n == 0).cast("double")).alias("empty")
    )


def adaptive_score(p: str, y: Column, u: Column) -> Column:
    """Probability of all classes likelier than y, plus u times y's own."""
    own = F.get(p, y.cast("int"))
    return F.aggregate(F.filter(F.col(p), lambda v: v > own), F.lit(0.0), lambda a, v: a + v) + u * own


def crossing_rate(df: DataFrame, by: str, quantiles: str) -> DataFrame:
    """Share of rows whose quantiles are out of order."""
    return df.groupBy(by).agg(F.avg((F.col(quantiles) != F.array_sort(quantiles)).cast("double")).alias("crossing"))


def temperature_table(df: DataFrame, by: str, p: str, y: str, grid: list[float]) -> DataFrame:
    """Log loss and error of calibration in the large by temperature of binary log-odds, for all of a grid in one pass."""
    t = df.select(by, F.col(y).cast("double").alias("y"), F.log(F.col(p) / (1 - F.col(p))).alias("z"), F.explode(F.array(*[F.lit(x) for x in grid])).alias("temperature"))
    q = 1 / (1 + F.exp(-F.col("z") / F.col("temperature")))
    return t.groupBy(by, "temperature").agg((-F.avg(F.col("y") * F.log(q) + (1 - F.col("y")) * F.log(1 - q))).alias("log_loss"), (F.avg(q) - F.avg("y")).alias("bias"))


def best_temperature(table: DataFrame, by: str) -> DataFrame:
    return table.groupBy(by).agg(F.min_by("temperature", F.struct("log_loss", "temperature")).alias("temperature"))
