"""Reports on predictions, items and replicates: targeting, bias and variance, leaderboards, leaks, choices, gradings, learning curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.hashing import md5_share
from tallyloom.functions.ranks import percentile, ranked
from tallyloom.operators.resample import key, poisson, with_replicates


def uplift_scores(df: DataFrame, arm: str, x: str, y: str, digits: int = 9) -> DataFrame:
    """df with `risk`, the outcome that a line fitted to arm 0 expects, and `uplift`, by how much one fitted to arm 1 expects less.
    Each arm is one row of sums."""
    one = lambda a, f: f(F.when(F.col(arm) == a, F.col(y)), F.when(F.col(arm) == a, F.col(x)))
    fit = df.agg(*[one(a, f).alias(f"{n}{a}") for a in (0, 1) for n, f in (("b", F.regr_slope), ("a", F.regr_intercept))]).first()
    at = lambda a: fit[f"a{a}"] + fit[f"b{a}"] * F.col(x)
    return df.withColumns({"risk": F.round(at(0), digits), "uplift": F.round(at(0) - at(1), digits)})


def budget_value(df: DataFrame, arm: str, y: str, policies: list[str], row_id: str, share: float) -> DataFrame:
    """(policy, targeted, value): outcomes prevented per 1,000 rows if the share of highest score is treated, read off the arms within it."""
    n = df.count()
    out = None
    for p in policies:
        top = ranked(df.select(arm, y, row_id, (-F.col(p)).alias("_s")), ["_s", row_id], rank="_i").filter(F.col("_i") <= F.floor(F.lit(n) * share))
        mean = lambda a: F.avg(F.when(F.col(arm) == a, F.col(y).cast("double")))
        part = top.agg(F.count("*").alias("targeted"), (1000 * (mean(0) - mean(1))).alias("value")).select(F.lit(p).alias("policy"), "targeted", "value")
        out = part if out is None else out.unionByName(part)
    return out


def bias_variance(draws: DataFrame, truth: DataFrame, point: str, pred: str, true: str) -> DataFrame:
    """One row: squared bias and variance of replicated predictions, averaged over points, and the correlation that a squared
    error of one replicate and that of their average imply."""
    g = draws.groupBy(point).agg(F.avg(pred).alias("m"), F.var_pop(pred).alias("v"), F.count("*").alias("k")).join(truth, point)
    return g.agg(F.avg(F.pow(F.col("m") - F.col(true), F.lit(2))).alias("bias2"), F.avg("v").alias("variance"), F.count("*").alias("points"))


def item_draws(graded: DataFrame, item: str, n: int, draws: int, seed: str) -> DataFrame:
    """(draw, item): the n items of smallest hash of each draw. n is a few hundred, so tasks send on n rows a draw at most."""
    items = with_replicates(graded.select(item).distinct(), draws).withColumnRenamed("rep", "draw")
    w = Window.partitionBy("draw").orderBy(F.md5(key(seed, "draw", item)), item)
    return items.withColumn("_i", F.row_number().over(w)).filter(F.col("_i") <= n).drop("_i")


def leaderboard_draws(graded: DataFrame, model: str, item: str, ok: str, n: int, draws: int, seed: str) -> DataFrame:
    """(draw, top_right, order_right, wrong_pairs): the ranking of models on n drawn items against that on all of them.
    graded has a row for each model and item; there are few models. Equal scores are ordered by model."""
    full = graded.groupBy(model).agg(F.avg(F.col(ok).cast("double")).alias("full"))
    part = graded.join(item_draws(graded, item, n, draws, seed), item).groupBy("draw", model).agg(F.avg(F.col(ok).cast("double")).alias("part")).join(full, model)
    by = lambda c: Window.partitionBy("draw").orderBy(F.desc(c), model)
    placed = part.withColumns({"place": F.row_number().over(by("full")), "seen": F.row_number().over(by("part"))})
    order = placed.groupBy("draw").agg(F.max(((F.col("place") == 1) & (F.col("seen") == 1)).cast("int")).alias("top_right"), F.min((F.col("place") == F.col("seen")).cast("int")).alias("order_right"))
    other = placed.select("draw", F.col("place").alias("place2"), F.col("seen").alias("seen2"))
    wrong = placed.join(other, "draw").filter("place < place2").groupBy("draw").agg(F.avg((F.col("seen") > F.col("seen2")).cast("double")).alias("wrong_pairs"))
    return order.join(wrong, "draw")


def contamination_report(df: DataFrame, leaked: str, ok: str, lp: str, base: str) -> DataFrame:
    """One row on items that a model has seen (leaked) against fresh ones: accuracies and their gap, the chance that a leaked
    item has the larger log-likelihood, that it has the larger gain over a base model (ties half), the share of leaked items above the 95th
    percentile of fresh ones, and Welch's t. Scores are counted by distinct value, so round them."""
    def auc(score: Column) -> float | None:
        g = df.select(score.alias("s"), F.col(leaked).alias("l")).groupBy("s").agg(F.count_if("l").alias("a"), F.count_if(~F.col("l")).alias("b"))
        g = ranked(g, ["s"], {"below": "b"}, "_i")
        return g.agg(F.sum(F.col("a") * (F.col("below") - F.col("b") / 2)).alias("u"), F.sum("a").alias("na"), F.sum("b").alias("nb")).select(F.try_divide(F.col("u"), F.col("na") * F.col("nb"))).first()[0]

    is_, not_ = (lambda c: F.when(F.col(leaked), c)), (lambda c: F.when(~F.col(leaked), c))
    cut = percentile(df, not_(F.col(lp)), 0.95)
    m = df.agg(
        F.avg(is_(F.col(ok).cast("double"))).alias("accuracy_leaked"), F.avg(not_(F.col(ok).cast("double"))).alias("accuracy_fresh"),
        F.avg(is_((F.col(lp) > F.lit(cut)).cast("double"))).alias("tpr_at_5"),
        ((F.avg(is_(F.col(lp))) - F.avg(not_(F.col(lp)))) / F.sqrt(F.var_samp(is_(F.col(lp))) / F.count(is_(F.col(lp))) + F.var_samp(not_(F.col(lp))) / F.count(not_(F.col(lp))))).alias("welch_t"),
    )
    one = m.withColumn("gap", F.col("accuracy_leaked") - F.col("accuracy_fresh"))
    return one.withColumns({"loss_auc": F.lit(auc(F.col(lp))).cast("double"), "reference_auc": F.lit(auc(F.round(F.col(lp) - F.col(base), 9))).cast("double")})


def choice_scores(options: DataFrame, item: str, option: str, lp: str, length: str, right: str) -> DataFrame:
    """(scoring, items, accuracy, shorter): for the summed and the length-normalised log-likelihood, the share of items whose best
    option is right, and of those whose best option is shorter than the right one. Of equal options the smallest wins."""
    own = F.max(F.when(F.col(right), F.col(length))).alias("right_length")
    best = lambda score: F.max_by(F.struct(F.col(right).alias("ok"), F.col(length).alias("n")), F.struct(score, -F.col(option)))
    g = options.filter(F.col(length) > 0).groupBy(item).agg(own, best(F.col(lp)).alias("summed"), best(F.round(F.col(lp) / F.col(length), 9)).alias("normalised"))
    long = g.select("right_length", F.explode(F.array(*[F.struct(F.lit(s).alias("scoring"), F.col(s).alias("best")) for s in ("summed", "normalised")])).alias("x")).select("right_length", "x.*")
    return long.groupBy("scoring").agg(F.count("*").alias("items"), F.avg(F.col("best.ok").cast("double")).alias("accuracy"), F.avg((F.col("best.n") < F.col("right_length")).cast("double")).alias("shorter"))


def exact_match(graded: DataFrame, slices: list[str], answer: str, expected: str) -> DataFrame:
    """(slices.., n, accuracy, longer, first_wrong) over every roll-up of the slices: share of exact matches, of wrong answers that are
    longer than they should be, and the mean place of the first wrong character of wrong answers (after the end counts as a place)."""
    a, e = F.coalesce(answer, F.lit("")), F.coalesce(expected, F.lit(""))
    top = F.greatest(F.length(a), F.length(e))
    places = F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), top)), lambda i: F.substr(a, i, F.lit(1)) != F.substr(e, i, F.lit(1)))
    d = graded.select(*slices, (a == e).alias("ok"), (F.length(a) > F.length(e)).alias("long"), F.get(places, F.lit(0)).alias("at"))
    wrong = lambda c: F.avg(F.when(~F.col("ok"), c))
    return d.rollup(*slices).agg(F.count("*").alias("n"), F.avg(F.col("ok").cast("double")).alias("accuracy"), wrong(F.col("long").cast("double")).alias("longer"), wrong(F.col("at").cast("double")).alias("first_wrong"))


def learning_curve(df: DataFrame, row_id: str, x: str, y: str, shares: list[float], seed: str) -> DataFrame:
    """(share, n, mse) of a line fitted to nested hash samples and tested on the rows of the upper half of the hashes.
    Every size is one row of sums, and errors follow from sums of products, so the rows are read twice."""
    u = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), md5_share(key(seed, row_id)).alias("u"))
    grid = F.explode(F.array(*[F.lit(s) for s in shares]))
    fits = u.filter("u < 0.5").withColumn("share", grid).filter("u < share").groupBy("share").agg(F.count("*").alias("n"), F.regr_slope("y", "x").alias("b"), F.regr_intercept("y", "x").alias("a"))
    test = u.filter("u >= 0.5").withColumn("share", grid).join(F.broadcast(fits), "share")  # one row a size
    return test.groupBy("share", "n").agg(F.avg(F.pow(F.col("y") - F.col("a") - F.col("b") * F.col("x"), F.lit(2))).alias("mse"))


def curve_fit(curve: DataFrame, n: str, error: str, until: int) -> DataFrame:
    """One row: error = scale n^-power fitted in logarithms to sizes up to one, and the relative error at the largest size."""
    used = F.col(n) <= until
    ln = lambda c: F.when(used, F.log(c))
    g = curve.agg(F.regr_slope(ln(error), ln(n)).alias("s"), F.regr_intercept(ln(error), ln(n)).alias("i"), F.max(n).alias("n"), F.max_by(error, n).alias("e"))
    return g.select((-F.col("s")).alias("power"), F.exp("i").alias("scale"), (F.exp(F.col("i") + F.col("s") * F.log("n")) / F.col("e") - 1).alias("relative_error"))


def out_of_bag(df: DataFrame, row_id: str, level: str, y: str, sizes: list[int], seed: str) -> DataFrame:
    """(members, mse, no_vote): each member is the mean by level of a Poisson-weighted resample; a row is predicted by the members whose
    resample missed it. Error over rows with a vote, and the rows without one, by the number of members."""
    d = with_replicates(df.select(row_id, level, F.col(y).cast("double").alias("y")), max(sizes)).withColumn("w", poisson(md5_share(key(seed, "rep", row_id))))
    means = d.groupBy("rep", level).agg(F.try_divide(F.sum(F.col("w") * F.col("y")), F.sum("w")).alias("m"))
    votes = d.filter("w = 0").join(means, ["rep", level])
    cols = [F.avg(F.when(F.col("rep") < s, F.col("m"))).alias(f"p{s}") for s in sizes]
    per = df.select(row_id, F.col(y).cast("double").alias("y")).join(votes.groupBy(row_id).agg(*cols), row_id, "left")
    rows = F.explode(F.array(*[F.struct(F.lit(s).alias("members"), F.col(f"p{s}").alias("p")) for s in sizes]))
    g = per.select("y", rows.alias("x")).select("y", "x.*")
    return g.groupBy("members").agg(F.avg(F.pow(F.col("y") - F.col("p"), F.lit(2))).alias("mse"), F.count_if(F.col("p").isNull()).alias("no_vote"))


def pool_summary(catalogue: DataFrame, source: str, frequency: str, length: str, context: int, horizon: int) -> DataFrame:
    """(source, frequency, series, evaluable) over the cube of both: series, and those long enough for one forecast origin at least."""
    return catalogue.cube(source, frequency).agg(F.count("*").alias("series"), F.count_if(F.col(length) >= context + horizon).alias("evaluable"))


def trial_audit(df: DataFrame, keys: list[str], low: str, high: str, hr: str, z: float = 1.959963984540054, share: float = 0.5, digits: int = 2) -> DataFrame:
    """Per reported hazard ratio and interval: the events that its width implies, 4 z^2 / (f (ln U - ln L)^2) with
    f = p (1 - p) and p = share HR / (share HR + 1 - share), the range of these that rounding leaves open, and events needed to detect the ratio
    with 80 % power."""
    p = share * F.col(hr) / (share * F.col(hr) + 1 - share)
    f = p * (1 - p)
    half = 0.5 * 10.0**-digits
    events = lambda a, b: 4 * z * z / (f * F.pow(F.log(b) - F.log(a), F.lit(2)))
    lo, hi = F.col(low), F.col(high)
    need = F.lit((z + 0.8416212335729143) ** 2) / (f * F.pow(F.log(F.col(hr)), F.lit(2)))
    return df.filter((lo > half) & (hi > lo + 2 * half) & (F.col(hr) > 0)).select(
        *keys, events(lo, hi).alias("events"), events(lo - half, hi + half).alias("least"), events(lo + half, hi - half).alias("most"), F.when(F.col(hr) != 1, need).alias("needed")
    )
