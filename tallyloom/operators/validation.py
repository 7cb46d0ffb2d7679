"""Studies of validation: folds against held-out rows, tests of fold differences, selection, tuning, leaks, recalibration, densities.

Models are lines or level means, whose fits and errors follow from sums, so a
study of many replicates and folds is one aggregate and no loop of fits.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.hashing import md5_share
from tallyloom.functions.ranks import last_seen, percentile, ranked
from tallyloom.functions.storage import written
from tallyloom.operators.resample import key, permuted, with_replicates

_SUMS = {"n": lambda x, y: F.count("*"), "sx": lambda x, y: F.sum(x), "sy": lambda x, y: F.sum(y), "sxx": lambda x, y: F.sum(x * x), "sxy": lambda x, y: F.sum(x * y), "syy": lambda x, y: F.sum(y * y)}


def fold_errors(df: DataFrame, row_id: str, x: str, y: str, folds: int, reps: int, seed: str) -> DataFrame:
    """(rep, fold, n, train, line, mean): mean squared errors on a fold of a line and of a mean fitted to the other folds. Both columns are
    taken from their means first, so that sums of squares keep their digits; a fold is one row of six sums."""
    m = df.agg(F.avg(x), F.avg(y)).first()
    d = with_replicates(df.select(row_id, (F.col(x) - m[0]).alias("_x"), (F.col(y) - m[1]).alias("_y")), reps)
    d = d.withColumn("fold", F.floor(md5_share(key(seed, "rep", row_id)) * folds).cast("int"))
    own = d.groupBy("rep", "fold").agg(*[f(F.col("_x"), F.col("_y")).alias(c) for c, f in _SUMS.items()])
    w = Window.partitionBy("rep")  # one row a fold
    o = own.select("rep", "fold", *_SUMS, *[(F.sum(c).over(w) - F.col(c)).alias(f"o{c}") for c in _SUMS])
    b = (F.col("osxy") - F.col("osx") * F.col("osy") / F.col("on")) / (F.col("osxx") - F.col("osx") * F.col("osx") / F.col("on"))
    o = o.withColumn("b", b).withColumn("a", (F.col("osy") - F.col("b") * F.col("osx")) / F.col("on")).withColumn("m", F.col("osy") / F.col("on"))
    a, b, n = F.col("a"), F.col("b"), F.col("n")
    line = F.col("syy") - 2 * a * F.col("sy") - 2 * b * F.col("sxy") + n * a * a + 2 * a * b * F.col("sx") + b * b * F.col("sxx")
    mean = F.col("syy") - 2 * F.col("m") * F.col("sy") + n * F.col("m") * F.col("m")
    return o.select("rep", "fold", "n", F.col("on").alias("train"), (line / n).alias("line"), (mean / n).alias("mean"))


def estimate_against_truth(errors: DataFrame, truth: float, z: float = 1.96) -> DataFrame:
    """(rep, estimate, se, covers): the mean error over folds, its standard error from the folds, and whether its interval holds the error on fresh rows."""
    g = errors.groupBy("rep").agg(F.avg("line").alias("estimate"), (F.stddev_samp("line") / F.sqrt(F.count("*"))).alias("se"))
    return g.withColumn("covers", F.abs(F.col("estimate") - truth) <= z * F.col("se"))


def fold_tests(errors: DataFrame) -> DataFrame:
    """One row of t statistics of the difference in error of two models from a table of folds: the first repeat's folds taken as
    independent, all folds of all repeats, these with the variance corrected by test over train size, and the first two folds of five repeats."""
    d = errors.select("rep", "fold", (F.col("line") - F.col("mean")).alias("d"), F.col("n").alias("test"), "train")
    t = lambda when, scale: F.avg(when) / F.sqrt(F.var_samp(when) * scale)
    first = F.when(F.col("rep") == 0, F.col("d"))
    g = d.agg(
        t(first, 1 / F.count(first)).alias("k_fold"), t(F.col("d"), 1 / F.count("*")).alias("repeated"), t(F.col("d"), 1 / F.count("*") + F.sum("test") / F.sum("train")).alias("corrected")
    )
    two = d.filter("fold < 2 and rep < 5").groupBy("rep").agg(F.var_samp("d").alias("v"), F.max(F.when(F.col("fold") == 0, F.col("d"))).alias("d0"))
    five = two.agg(F.max(F.when(F.col("rep") == 0, F.col("d0"))) / F.sqrt(F.avg("v"))).first()[0]
    return g.withColumn("five_by_two", F.lit(five).cast("double"))


def selected_on_holdout(long: DataFrame, feature: str, part: str, value: str, label: str, sizes: list[int]) -> DataFrame:
    """(selected, reused, fresh): features whose correlation with the label has one sign in 'train' and 'holdout', the strongest first, and
    their mean signed correlation in the reused holdout and in 'fresh'. long has a row for each row and feature; a feature is one row of three correlations."""
    at = lambda p: F.corr(F.when(F.col(part) == p, F.col(value)), F.when(F.col(part) == p, F.col(label)))
    c = long.groupBy(feature).agg(at("train").alias("_t"), at("holdout").alias("_h"), at("fresh").alias("_f")).filter("_t * _h > 0")
    c = c.withColumn("i", F.row_number().over(Window.orderBy(F.desc(F.round(F.abs(F.col("_t") + F.col("_h")), 9)), feature)))  # one row a feature
    s = c.withColumn("selected", F.explode(F.array(*[F.lit(k) for k in sizes]))).filter("i <= selected")
    return s.groupBy("selected").agg(F.avg(F.signum("_h") * F.col("_h")).alias("reused"), F.avg(F.signum("_h") * F.col("_f")).alias("fresh"))


def tuning_optimism(df: DataFrame, row_id: str, p: str, y: str, sizes: list[int], reps: int, share: float, seed: str) -> DataFrame:
    """(size, reused, fresh): accuracy of the best of a grid of thresholds on the rows that it was chosen on, and on the others, averaged over
    repeats. Thresholds of a size s are 1/(s + 1) .. s/(s + 1); of equally good ones the smallest."""
    d = with_replicates(df.select(row_id, p, F.col(y).cast("int").alias("y")), reps).withColumn("chosen_on", md5_share(key(seed, "rep", row_id)) < share)
    grid = F.explode(F.array(*[F.struct(F.lit(s).alias("size"), F.lit((i + 1) / (s + 1)).alias("t")) for s in sizes for i in range(s)]))
    d = d.groupBy("rep", "chosen_on", p, "y").agg(F.count("*").alias("n")).withColumn("g", grid)
    ok = F.when((F.col(p) >= F.col("g.t")).cast("int") == F.col("y"), F.col("n")).otherwise(0)
    a = d.groupBy("rep", "g.size", "g.t").agg(*[(F.sum(F.when(c, ok)) / F.sum(F.when(c, F.col("n")))).alias(x) for x, c in (("reused", F.col("chosen_on")), ("fresh", ~F.col("chosen_on")))])
    best = a.groupBy("rep", "size").agg(F.max(F.struct("reused", -F.col("t"), "fresh")).alias("b"))
    return best.groupBy("size").agg(F.avg("b.reused").alias("reused"), F.avg("b.fresh").alias("fresh"))


def encoding_leak(df: DataFrame, level: str, label: str, fold: str) -> DataFrame:
    """One row: squared error of the mean label of a level over all rows, the row itself included, over the rows of other folds, and of
    the overall mean. A level and fold are one row of sums."""
    g = df.groupBy(level, fold).agg(F.sum(label).alias("s"), F.sum(F.col(label) * F.col(label)).alias("q"), F.count("*").alias("n"))
    w = Window.partitionBy(level)
    prior = df.agg(F.avg(label)).first()[0]
    g = g.withColumns({"all_s": F.sum("s").over(w), "all_n": F.sum("n").over(w)})
    leaky = F.col("all_s") / F.col("all_n")
    honest = F.when(F.col("all_n") > F.col("n"), (F.col("all_s") - F.col("s")) / (F.col("all_n") - F.col("n"))).otherwise(F.lit(prior))
    error = lambda c: F.sum(F.col("q") - 2 * c * F.col("s") + F.col("n") * c * c) / F.sum("n")
    return g.agg(error(leaky).alias("leaky"), error(honest).alias("in_fold"), error(F.lit(prior)).alias("constant"))


def duplicate_aware_folds(df: DataFrame, columns: list[str], k: int, seed: str) -> DataFrame:
    """df with `fold`: rows that are equal in the columns (a null is a value of its own) share one, as it follows from a hash of these alone."""
    text = F.concat_ws("\x1f", F.lit(seed), *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in columns])
    return df.withColumn("fold", F.floor(md5_share(text) * k).cast("int"))


def off_support(df: DataFrame, row_id: str, a: str, b: str, level: float, seed: str) -> DataFrame:
    """One row: the Mahalanobis distance that a share of the rows stays below, and the share of rows that lie beyond it once a is permuted."""
    m = df.agg(F.avg(a).alias("ma"), F.avg(b).alias("mb"), F.var_pop(a).alias("va"), F.var_pop(b).alias("vb"), F.covar_pop(a, b).alias("c")).first()
    det = m["va"] * m["vb"] - m["c"] ** 2

    def distance(x: Column, y: Column) -> Column:
        x, y = x - m["ma"], y - m["mb"]
        return (m["vb"] * x * x - 2 * m["c"] * x * y + m["va"] * y * y) / det

    cut = percentile(df, distance(F.col(a), F.col(b)), level)
    p = permuted(df.select(F.lit(0).alias("_all"), row_id, a, b), "_all", row_id, a, 0, seed)
    return p.agg(F.lit(cut).alias("cut"), F.avg((distance(F.col("shuffled"), F.col(b)) > cut).cast("double")).alias("off"))


def _pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks (g, score, n, s) in order of (g, score), pooled with the one before while out of order; a block goes by its lowest score."""
    kind, keys, scores, sizes, sums = None, [], [], [], []
    for batch in batches:
        kind = batch.schema.field("g").type
        for g, score, n, s in zip(*(batch.column(c).to_pylist() for c in ("g", "score", "n", "s"))):
            keys.append(g), scores.append(score), sizes.append(n), sums.append(s)
            while len(sums) > 1 and keys[-2] == keys[-1] and sums[-2] * sizes[-1] >= sums[-1] * sizes[-2]:
                n, s = sizes.pop(), sums.pop()
                keys.pop(), scores.pop()
                sizes[-1] += n
                sums[-1] += s
    if keys:
        yield pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.array(scores, pa.float64()), pa.array(sizes, pa.int64()), pa.array(sums, pa.float64())], names=["g", "score", "n", "s"])


def isotonic(df: DataFrame, by: str, p: str, y: str, at_once: int = 200_000) -> DataFrame:
    """(by, score, n, fitted): the non-decreasing fit of least squares to the label by score. Null scores, NaN and null labels are left out; a null group is one.

    Scores are counted first. Tasks pool neighbours that are out of order within range
    partitions of about at_once blocks; as long as blocks of two partitions are out of
    order, what is left is dealt anew between other bounds. The order of pooling doesn't change the
    fit, so groups may have any number of distinct scores, and none is gathered."""
    kind, score = df.schema[by].dataType.simpleString(), F.col(p).cast("double")
    d = df.filter(score.isNotNull() & ~F.isnan(score) & F.col(y).isNotNull())
    d = written(d.groupBy(F.col(by).alias("g"), score.alias("score")).agg(F.count("*").alias("n"), F.sum(F.col(y).cast("double")).alias("s")), "counted")
    blocks, parts, last = d, max(1, ceil(d.count() / at_once)), 0
    while True:
        placed = blocks.select("g", "score", "n", "s").repartitionByRange(parts, "g", "score").sortWithinPartitions("g", "score")
        blocks = written(placed.mapInArrow(_pooled, f"g {kind}, score double, n long, s double").withColumn("part", F.spark_partition_id()), "pooled")
        if parts == 1:
            break
        end = F.struct("s", "n")
        ends = blocks.groupBy("g", "part").agg(F.min_by(end, "score").alias("first"), F.max_by(end, "score").alias("last"))
        left = F.lag("last").over(Window.partitionBy("g").orderBy("part"))  # one row a group and partition
        ends = ends.withColumn("left", left)
        if ends.filter("left.s * first.n >= first.s * left.n").isEmpty():
            break
        last, parts = parts, max(1, ceil(blocks.count() / at_once))
        parts += parts == last and parts > 1
    starts = blocks.select("g", "score", F.lit(None).cast("long").alias("n"), (F.col("s") / F.col("n")).alias("level"))
    rows = d.select("g", "score", "n", F.lit(None).cast("double").alias("level")).unionByName(starts)
    held = last_seen(rows, ["g"], ["score", F.col("n").isNotNull()], "level", "fitted")
    return held.filter("n is not null").select(F.col("g").alias(by), "score", "n", "fitted")


def recalibration_by_size(df: DataFrame, row_id: str, p: str, y: str, shares: list[float], seed: str) -> DataFrame:
    """(share, raw, recalibrated): squared error on the rows of the upper half of the hashes of the score, and of its isotonic fit to nested samples
    of the others; a score takes the fit of the largest fitted score below it, or of the smallest."""
    d = df.select(p, F.col(y).cast("double").alias("y"), md5_share(key(seed, row_id)).alias("u"))
    grid = F.explode(F.array(*[F.lit(s) for s in shares]))
    fit = isotonic(d.filter("u < 0.5").withColumn("share", grid).filter("u < share"), "share", p, "y")
    test = d.filter("u >= 0.5").groupBy(F.col(p).cast("double").alias("score")).agg(F.count("*").alias("n"), F.sum("y").alias("s"), F.sum(F.col("y") * F.col("y")).alias("q")).withColumn("share", grid)
    both = test.select("share", "score", "n", "s", "q", F.lit(None).cast("double").alias("fitted")).union(fit.select("share", "score", F.lit(None), F.lit(None), F.lit(None), "fitted"))
    held = last_seen(both, ["share"], ["score", F.col("n").isNotNull()], "fitted", "held").filter("n is not null")
    rows = held.join(F.broadcast(fit.groupBy("share").agg(F.min("fitted").alias("lowest"))), "share", "left").withColumn("f", F.coalesce("held", "lowest"))  # a row a share
    error = lambda c: F.sum(F.col("q") - 2 * c * F.col("s") + F.col("n") * c * c) / F.sum("n")
    return rows.groupBy("share").agg(error(F.col("score")).alias("raw"), error(F.col("f")).alias("recalibrated"))


def aps_sets(df: DataFrame, row_id: str, probabilities: str, label: str, alpha: float, share: float, seed: str) -> DataFrame:
    """(row_id, in_set, size) of the rows that aren't for calibration: randomised adaptive prediction sets. A class's score is the probability of all likelier
    classes (the smaller of equals first) and a share u of its own; the cut is the ceil((n + 1)(1 - alpha))-th smallest score of the
    calibration rows' labels, by ranks over range partitions."""
    u = md5_share(key(seed, F.lit("u"), row_id))
    order = F.array_sort(F.transform(probabilities, lambda q, i: F.struct((-q).alias("m"), i.alias("c"))))
    d = df.select(row_id, label, u.alias("u"), (md5_share(key(seed, F.lit("part"), row_id)) < share).alias("cal"), order.alias("o"))
    scores = F.transform("o", lambda x, i: F.struct(x["c"].alias("c"), (F.aggregate(F.slice("o", F.lit(1), i), F.lit(0.0), lambda t, z: t - z["m"]) - F.col("u") * x["m"]).alias("s")))
    d = d.select(row_id, label, "cal", scores.alias("scores"))
    own = F.get(F.filter("scores", lambda x: x["c"] == F.col(label)), F.lit(0))["s"]
    cal = ranked(d.filter("cal").select(F.round(own, 12).alias("s")), ["s"], rank="i")
    n = cal.count()
    k = min(n, int(np.ceil((n + 1) * (1 - alpha) - 1e-9)))
    cut = cal.filter(F.col("i") == k).first()
    cut = float("inf") if cut is None else cut["s"]
    inside = F.filter("scores", lambda x: F.round(x["s"], 12) <= cut)
    return d.filter("not cal").select(row_id, F.exists(inside, lambda x: x["c"] == F.col(label)).alias("in_set"), F.size(inside).alias("size"))


def selective_labels(df: DataFrame, row_id: str, x: str, y: str, accept_below: float, explore: float, seed: str) -> DataFrame:
    """(trained_on, rows, predicted, actual): lines fitted to accepted rows only, to these and a hashed share of refused ones, and to all, and what they
    say of the refused rows against what happened. Each fit is one row of sums."""
    d = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), (F.col(x) < accept_below).alias("accepted"), (md5_share(key(seed, row_id)) < explore).alias("explored"))
    out = None
    at, actual = (F.lit(v).cast("double") for v in d.filter("not accepted").agg(F.avg("x"), F.avg("y")).first())
    for name, used in (("accepted", F.col("accepted")), ("explored", F.col("accepted") | F.col("explored")), ("all", F.lit(True))):
        fit = d.filter(used).agg(F.count("*").alias("rows"), F.regr_slope("y", "x").alias("b"), F.regr_intercept("y", "x").alias("a"))
        part = fit.select(F.lit(name).alias("trained_on"), "rows", (F.col("a") + F.col("b") * at).alias("predicted"), actual.alias("actual"))
        out = part if out is None else out.unionByName(part)
    return out
