"""Scores of predictions: ranking, calibration, costs, fairness, paired comparisons.

Ranking measures first collapse the table to one row a distinct score with its
counts of positives and negatives, combined before the shuffle; running sums
then go over range partitions of that table, whatever the size of a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.ranks import percentile, percentiles_by, ranked_by, running_by


def by_score(df: DataFrame, by: str, p: str, y: str) -> DataFrame:
    """(by, p, pos, neg, pos_above, neg_above, n_pos, n_neg): counts at each score and of all higher ones."""
    d = df.filter(F.col(p).isNotNull() & F.col(y).isNotNull()).groupBy(by, F.col(p).alias("p")).agg(F.sum(F.col(y).cast("long")).alias("pos"), F.sum(1 - F.col(y).cast("long")).alias("neg"))
    d = running_by(d, [by], [F.desc("p")], {"pos_above": "pos", "neg_above": "neg"}, {"n_pos": "pos", "n_neg": "neg"})
    return d.withColumns({"pos_above": F.col("pos_above") - F.col("pos"), "neg_above": F.col("neg_above") - F.col("neg")})


def ranking_scores(df: DataFrame, by: str, p: str, y: str, recall: float = 0.8, fpr: float = 0.05) -> DataFrame:
    """AUC (ties count half), average precision (steps), precision at the first cut of enough recall, and the best recall within a false-positive rate."""
    c = by_score(df, by, p, y)
    tp, fp = F.col("pos_above") + F.col("pos"), F.col("neg_above") + F.col("neg")
    precision = tp / (tp + fp)
    return c.groupBy(by).agg(
        F.try_divide(F.sum(F.col("neg") * (F.col("pos_above") + F.col("pos") / 2)), F.first(F.col("n_pos") * F.col("n_neg"))).alias("auc"),
        F.try_divide(F.sum(F.col("pos") * precision), F.first("n_pos")).alias("average_precision"),
        F.max_by(precision, F.when(tp >= recall * F.col("n_pos"), F.col("p"))).alias("precision_at_recall"),
        F.max(F.when(fp <= fpr * F.col("n_neg"), F.try_divide(tp, F.col("n_pos"))).otherwise(0.0)).alias("recall_at_fpr"),
    )


def threshold_scores(df: DataFrame, by: str, p: str, y: str, threshold: float) -> DataFrame:
    """Log loss with clipped scores, Brier score, recall, precision and share flagged at p >= threshold."""
    c = F.least(F.greatest(F.col(p), F.lit(1e-7)), F.lit(1 - 1e-7))
    flag, pos = (F.col(p) >= threshold).cast("double"), F.col(y).cast("double")
    return df.groupBy(by).agg(
        F.count("*").alias("n"), (-F.avg(pos * F.log(c) + (1 - pos) * F.log(1 - c))).alias("log_loss"), F.avg(F.pow(F.col(p) - pos, F.lit(2))).alias("brier"),
        F.try_divide(F.sum(flag * pos), F.sum(pos)).alias("recall"), F.try_divide(F.sum(flag * pos), F.sum(flag)).alias("precision"), F.avg(flag).alias("flagged"),
    )


def bin_closed_above(c: Column, bins: int) -> Column:
    """Bins (lo, hi] of equal width numbered from 1; the first also holds everything below it. By comparison with the edges, so a value on an edge is in the lower bin."""
    guess = F.greatest(F.lit(1), F.least(F.lit(bins), F.ceil(c * bins).cast("int")))
    return F.when((guess > 1) & (c <= (guess - 1) / F.lit(float(bins))), guess - 1).when((guess < bins) & (c > guess / F.lit(float(bins))), guess + 1).otherwise(guess)


def bin_closed_below(c: Column, bins: int) -> Column:
    """Bins [lo, hi) numbered from 0, with the top value in the last."""
    return F.least(F.floor(c * bins).cast("int"), F.lit(bins - 1))


def calibration_error(df: DataFrame, by: str, p: str, y: str, bins: int = 15, closed_above: bool = True) -> DataFrame:
    """Expected calibration error: the sum over bins of share times |accuracy - confidence|."""
    b = bin_closed_above(F.col(p), bins) if closed_above else bin_closed_below(F.col(p), bins)
    g = df.groupBy(by, b.alias("bin")).agg(F.count("*").alias("k"), F.avg(p).alias("conf"), F.avg(F.col(y).cast("double")).alias("acc"))
    return g.groupBy(by).agg((F.sum(F.col("k") * F.abs(F.col("acc") - F.col("conf"))) / F.sum("k")).alias("ece"))


def debiased_l2(df: DataFrame, by: str, p: str, y: str, bins: int = 15) -> DataFrame:
    """Signed root of the sum of share ((acc - conf)^2 - acc (1 - acc) / (k - 1)), over bins of two rows or more."""
    g = df.groupBy(by, bin_closed_above(F.col(p), bins).alias("bin")).agg(F.count("*").alias("k"), F.avg(p).alias("conf"), F.avg(F.col(y).cast("double")).alias("acc"))
    n = df.groupBy(by).agg(F.count("*").alias("n"))
    term = F.pow(F.col("acc") - F.col("conf"), F.lit(2)) - F.col("acc") * (1 - F.col("acc")) / (F.col("k") - 1)
    s = g.filter("k > 1").join(n, by).groupBy(by).agg(F.sum(F.col("k") / F.col("n") * term).alias("s"))
    return s.select(by, (F.signum("s") * F.sqrt(F.abs("s"))).alias("l2"))


def selective_risk(df: DataFrame, by: str, score: str, correct: str, row_id: str, coverage: float = 0.2) -> DataFrame:
    """Mean of the running error in descending score (AURC), and accuracy of the most confident share; equal scores in order of row id."""
    d = df.select(by, (-F.col(score)).alias("_s"), row_id, F.col(correct).cast("double").alias("c")).withColumn("_e", 1 - F.col("c"))
    d = ranked_by(d, [by], ["_s", row_id], {"_wrong": "_e"}, "i").join(df.groupBy(by).agg(F.count("*").alias("n")), by)
    return d.groupBy(by).agg(F.avg(F.col("_wrong") / F.col("i")).alias("aurc"), F.avg(F.when(F.col("i") <= F.floor(F.col("n") * coverage), F.col("c"))).alias("accuracy_at_coverage"))


def group_rates(df: DataFrame, by: str, p: str, y: str, threshold: float) -> DataFrame:
    """Base rate, flag rate, false-positive and false-negative rates, positive predictive value, calibration gap."""
    f, t = (F.col(p) >= threshold).cast("double"), F.col(y).cast("double")
    return df.groupBy(by).agg(
        F.avg(t).alias("base"), F.avg(f).alias("flag"), F.try_divide(F.sum(f * (1 - t)), F.sum(1 - t)).alias("fpr"), F.try_divide(F.sum((1 - f) * t), F.sum(t)).alias("fnr"),
        F.try_divide(F.sum(f * t), F.sum(f)).alias("ppv"), (F.avg(p) - F.avg(t)).alias("gap"),
    )


def equal_fpr_thresholds(df: DataFrame, by: str, p: str, y: str, fpr: float) -> DataFrame:
    return percentiles_by(df.filter(F.col(y) == 0), [by], p, [1 - fpr], "q").select(by, F.get("q", F.lit(0)).alias("threshold"))


def cost_at(df: DataFrame, by: str, p: str, y: str, threshold: float, ratio: float) -> DataFrame:
    """Mean of ratio times missed positives plus flagged negatives."""
    f, t = (F.col(p) >= threshold).cast("double"), F.col(y).cast("double")
    return df.groupBy(by).agg(F.avg(ratio * (1 - f) * t + f * (1 - t)).alias("cost"))


def best_cost(df: DataFrame, by: str, p: str, y: str, ratio: float) -> DataFrame:
    """The least cost over all cuts between distinct scores, those that flag all or nothing included."""
    c = by_score(df, by, p, y)
    cost = (ratio * (F.col("n_pos") - F.col("pos_above") - F.col("pos")) + F.col("neg_above") + F.col("neg")) / (F.col("n_pos") + F.col("n_neg"))
    none = ratio * F.col("n_pos") / (F.col("n_pos") + F.col("n_neg"))
    return c.groupBy(by).agg(F.least(F.min(cost), F.min(none)).alias("best_cost"))


def paired(df: DataFrame, by: str, a: str, b: str) -> DataFrame:
    """Two correctness columns on the same rows: only a, only b, discordance, paired and unpaired standard errors of the difference."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    n = F.count("*")
    pa, pb, d = F.avg(x), F.avg(y), F.avg(x - y)
    return df.groupBy(by).agg(
        n.alias("n"), F.sum((x > y).cast("long")).alias("only_a"), F.sum((y > x).cast("long")).alias("only_b"), F.avg((x != y).cast("double")).alias("discordance"), d.alias("difference"),
        F.sqrt((F.avg((x - y) * (x - y)) - d * d) / n).alias("se_paired"), F.sqrt((pa * (1 - pa) + pb * (1 - pb)) / n).alias("se_unpaired"),
    )


def clustered_error(df: DataFrame, by: str, cluster: str, value: str) -> DataFrame:
    """Naive and cluster standard errors of a mean, and 1 - within / total variance."""
    g = df.groupBy(by, cluster).agg(F.avg(value).alias("_m"), F.var_pop(value).alias("_v"), F.count("*").alias("_n"))
    c = g.groupBy(by).agg((F.stddev_samp("_m") / F.sqrt(F.count("*"))).alias("se_cluster"), (F.sum(F.col("_v") * F.col("_n")) / F.sum("_n")).alias("within"))
    t = df.groupBy(by).agg((F.stddev_pop(value) / F.sqrt(F.count("*"))).alias("se_naive"), F.var_pop(value).alias("total"))
    return c.join(t, by).select(by, "se_naive", "se_cluster", (1 - F.col("within") / F.col("total")).alias("icc"))


def lag_correlations(df: DataFrame, by: str, sequence: str, order: str, value: str, lags: int) -> DataFrame:
    """Correlation of a column with itself some steps back in its sequence, by group and lag."""
    w = Window.partitionBy(sequence).orderBy(order)
    d = df.select(by, F.col(value).alias("x"), F.array(*[F.lag(value, i).over(w) for i in range(1, lags + 1)]).alias("a"))
    return d.select(by, "x", F.posexplode("a").alias("lag", "b")).filter("b is not null").groupBy(by, (F.col("lag") + 1).alias("lag")).agg(F.corr("x", "b").alias("r"), F.count("*").alias("n"))


def judged(df: DataFrame, by: str, score: str, truth: str) -> DataFrame:
    """A judge's threshold is the pooled quantile that passes as many as are right; rates by source, of right and of wrong ones."""
    share = df.agg(F.avg(F.col(truth).cast("double"))).first()[0]
    cut = percentile(df, score, 1 - share)
    ok, t = (F.col(score) >= cut).cast("double"), F.col(truth).cast("double")
    return df.groupBy(by).agg(F.avg(ok).alias("judged"), F.avg(t).alias("actual"), F.avg(F.when(t == 1, ok)).alias("pass_right"), F.avg(F.when(t == 0, ok)).alias("pass_wrong"))


def prediction_powered(df: DataFrame, by: str, judge: str, truth: str, labelled: str) -> DataFrame:
    """Judge mean of the unlabelled plus mean error of the labelled, with the factor on the judge that gives least variance."""
    lab, un = F.col(labelled), ~F.col(labelled)
    j, t = F.col(judge).cast("double"), F.col(truth).cast("double")
    g = df.groupBy(by).agg(
        F.sum(lab.cast("long")).alias("n"), F.sum(un.cast("long")).alias("m"), F.avg(F.when(lab, t)).alias("t"), F.avg(F.when(lab, j)).alias("jl"), F.avg(F.when(un, j)).alias("ju"),
        F.covar_samp(F.when(lab, t), F.when(lab, j)).alias("c"), F.var_samp(F.when(lab, j)).alias("vj"), F.var_samp(F.when(un, j)).alias("vu"), F.var_samp(F.when(lab, t)).alias("vt"),
    )
    lam = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.try_divide(F.col("c"), (1 + F.col("n") / F.col("m")) * F.col("vj"))))
    g = g.withColumn("lambda", lam)
    var = F.col("lambda") * F.col("lambda") * F.col("vu") / F.col("m") + (F.col("vt") + F.col("lambda") * F.col("lambda") * F.col("vj") - 2 * F.col("lambda") * F.col("c")) / F.col("n")
    return g.select(by, "lambda", (F.col("lambda") * F.col("ju") + F.col("t") - F.col("lambda") * F.col("jl")).alias("estimate"), F.sqrt(var).alias("se"), F.col("ju").alias("judge_only"), F.col("t").alias("label_only"))


def interval_coverage(df: DataFrame, by: str | Column, y: str, lower: str, upper: str) -> DataFrame:
    """Coverage, mean width and median width by group."""
    width = F.col(upper) - F.col(lower)
    key = F.col(by) if isinstance(by, str) else by
    return df.groupBy(key).agg(F.count("*").alias("n"), F.avg(F.col(y).between(F.col(lower), F.col(upper)).cast("double")).alias("coverage"), F.avg(width).alias("mean_width"), F.percentile(width, 0.5).alias("median_width"))


def forecast_errors(df: DataFrame, by: list[str], y: str, p: str, last: str) -> DataFrame:
    """RMSE, MAE, RMSE over the truth's RMS, R^2, and the share of right directions among changes that aren't 0; nulls are skipped."""
    e, t = F.col(p) - F.col(y), F.col(y)
    moved = F.signum(F.col(y) - F.col(last))
    g = df.filter(F.col(y).isNotNull() & F.col(p).isNotNull()).groupBy(*by).agg(
        F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), (F.sqrt(F.avg(e * e)) / F.sqrt(F.avg(t * t))).alias("nrmse"), (1 - F.avg(e * e) / F.var_pop(t)).alias("r2"),
        F.avg(F.when(moved != 0, (moved == F.signum(F.col(p) - F.col(last))).cast("double"))).alias("direction"),
    )
    return g


def pinball(df: DataFrame, by: list[str], y: str, q: str, level: float) -> DataFrame:
    d = F.col(y) - F.col(q)
    return df.groupBy(*by).agg(F.avg(F.greatest(level * d, (level - 1) * d)).alias("pinball"))


def geometric(df: DataFrame, by: str, metric: str) -> DataFrame:
    return df.filter(F.col(metric).isNotNull()).groupBy(by).agg(F.exp(F.avg(F.log(F.greatest(F.col(metric), F.lit(1e-6))))).alias("geomean"), F.count("*").alias("n"))


def time_weighted(df: DataFrame, by: str, ret: str, periods: float = 252.0) -> DataFrame:
    """prod(1 + r)^(periods / n) - 1, by logarithms."""
    return df.groupBy(by).agg((F.exp(F.sum(F.log1p(ret)) * periods / F.count("*")) - 1).alias("time_weighted"))


def drawdown(df: DataFrame, by: str, order: str, ret: str) -> DataFrame:
    """The deepest fall of the running product below its running maximum (the start counts)."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    d = df.select(by, order, F.sum(F.log1p(ret)).over(w).alias("level"))
    d = d.withColumn("top", F.greatest(F.lit(0.0), F.max("level").over(w)))
    return d.groupBy(by).agg((1 - F.exp(F.min(F.col("level") - F.col("top")))).alias("drawdown"))


def without_best(df: DataFrame, by: str, ret: str, order: str, k: int) -> DataFrame:
    """Total return with all rows, and without the k best and the k worst."""
    up, down = Window.partitionBy(by).orderBy(F.desc(ret), order), Window.partitionBy(by).orderBy(ret, order)
    d = df.select(by, F.log1p(ret).alias("l"), F.row_number().over(up).alias("u"), F.row_number().over(down).alias("d"))
    total = lambda c: F.exp(F.sum(F.when(c, F.col("l")))) - 1
    return d.groupBy(by).agg(total(F.lit(True)).alias("all_days"), total(F.col("u") > k).alias("without_best"), total(F.col("d") > k).alias("without_worst"))


def adjacency(df: DataFrame, key: str, order: str, by: str) -> DataFrame:
    """Share of rows whose predecessor within the group has the same key."""
    w = Window.partitionBy(by).orderBy(order)
    d = df.select(by, (F.lag(key).over(w) == F.col(key)).cast("double").alias("same"))
    return d.groupBy(by).agg(F.avg(F.coalesce("same", F.lit(0.0))).alias("twin_share"))
