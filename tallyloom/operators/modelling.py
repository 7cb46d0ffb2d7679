"""Clusters, neighbours-based scores, effects of features, and preparation of designs and point clouds."""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.hashing import md5_share
from tallyloom.functions.ranks import ranked
from tallyloom.functions.storage import written
from tallyloom.operators.learning import distance, neighbours
from tallyloom.operators.resample import key


def long_vectors(df: DataFrame, row_id: str, vec: str) -> DataFrame:
    """(row_id, dim, v): a row for each entry."""
    return df.select(row_id, F.posexplode(vec).alias("dim", "v")).withColumn("v", F.col("v").cast("double"))


def kmeans(df: DataFrame, row_id: str, vec: str, start: list[list[float]], steps: int) -> tuple[DataFrame, list[list[float]]]:
    """df with `cluster` and `d2` after a number of Lloyd's steps from the centres given, and the centres. Of equally near centres the first counts; an
    empty cluster keeps its centre. A step is one aggregate of clusters x dimensions sums; k centres are literals."""
    def assigned(centres: list[list[float]]) -> DataFrame:
        square = lambda c: F.aggregate(F.zip_with(vec, F.array(*map(F.lit, c)), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
        near = F.array_min(F.array(*[F.struct(F.round(square(c), 9).alias("d2"), F.lit(i).alias("c")) for i, c in enumerate(centres)]))
        return df.withColumn("_n", near).withColumns({"cluster": F.col("_n.c"), "d2": F.col("_n.d2")}).drop("_n")

    centres = [list(map(float, c)) for c in start]
    for _ in range(steps):
        sums = assigned(centres).select("cluster", F.posexplode(vec).alias("dim", "v")).groupBy("cluster", "dim").agg(F.avg("v").alias("m")).collect()  # k x dimensions rows
        for r in sums:
            centres[r["cluster"]][r["dim"]] = r["m"]
    return assigned(centres), centres


def kmeans_scan(df: DataFrame, row_id: str, vec: str, label: str, ks: list[int], steps: int) -> DataFrame:
    """(k, inertia, silhouette, purity) by number of clusters, from the k rows of smallest id: the sum of squared distances, the mean simplified
    silhouette (distances to centres, not to points), and the share of rows with the commonest label of their cluster."""
    first = [list(map(float, r[vec])) for r in df.orderBy(row_id).limit(max(ks)).collect()]
    out = None
    for k in ks:
        d, centres = kmeans(df, row_id, vec, first[:k], steps)
        far = [F.when(F.col("cluster") != i, distance(F.col(vec), F.array(*map(F.lit, c)))) for i, c in enumerate(centres)]
        other, own = (F.least(*far) if k > 1 else F.lit(None).cast("double")), F.sqrt("d2")
        d = d.withColumn("s", (other - own) / F.greatest(other, own))
        n = d.groupBy("cluster", label).agg(F.count("*").alias("n"), F.sum("d2").alias("d2"), F.sum("s").alias("s")).groupBy("cluster").agg(F.max("n").alias("top"), F.sum("n").alias("n"), F.sum("d2").alias("d2"), F.sum("s").alias("s"))
        part = n.agg(F.sum("d2").alias("inertia"), (F.sum("s") / F.sum("n")).alias("silhouette"), (F.sum("top") / F.sum("n")).alias("purity")).select(F.lit(k).alias("k"), "inertia", "silhouette", "purity")
        out = part if out is None else out.unionByName(part)
    return out


def anomaly_scores(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """(id, kth, lof) of the rows asked for: the distance to the k-th neighbour among all rows, and the local outlier factor. Neighbours
    of neighbours are asked for as well, so three query sets meet the rows. Where all reach distances are 0 the density is infinite, and lof 0 or NaN, as in SQL."""
    one = written(neighbours(queries, rows, k), "first_neighbours")
    more = lambda near: rows.join(near.select("id").distinct(), "id", "left_semi")
    two = written(neighbours(more(one), rows, k), "second_neighbours")
    done = one.select("query").union(two.select("query")).distinct()
    three = neighbours(more(two).join(done.withColumnRenamed("query", "id"), "id", "left_anti"), rows, k)
    kth = one.union(two).union(three).filter(F.col("rank") == k).groupBy("query").agg(F.min("d").alias("kth"))
    kth = written(kth, "kth")

    def density(near: DataFrame) -> DataFrame:
        """(query, lrd): one over the mean reach distance to the neighbours."""
        reach = near.join(kth.select(F.col("query").alias("id"), "kth"), "id").withColumn("reach", F.greatest("d", "kth"))
        return reach.groupBy("query").agg(F.avg("reach").alias("reach")).select("query", F.when(F.col("reach") == 0, float("inf")).otherwise(1 / F.when(F.col("reach") != 0, F.col("reach"))).alias("lrd"))

    own = density(one)
    others = density(two).withColumnsRenamed({"query": "id", "lrd": "other"})
    ratio = one.join(others, "id").groupBy("query").agg(F.avg("other").alias("others")).join(own, "query")
    return ratio.join(kth, "query").select(F.col("query").alias("id"), "kth", (F.col("others") / F.col("lrd")).alias("lof"))


def smote(df: DataFrame, row_id: str, vec: str, label: str, rare: object, k: int, seed: str) -> DataFrame:
    """(base, copy, neighbour, vec): points on the way from rows of the rarer label to one of their k nearest of that label, as many as other rows
    are more. Every row is a base equally often, those of smallest hash once more; the neighbour and the place follow from a hash."""
    own = df.filter(F.col(label) == F.lit(rare)).select(F.col(row_id).alias("id"), F.col(vec).alias("vec"))
    n, total = own.count(), df.count()
    need = max(0, total - 2 * n)
    base = ranked(own.withColumn("_h", F.md5(key(seed, "id"))), ["_h", "id"], rank="_i").drop("_h")
    times = F.lit(need // max(1, n)) + F.when(F.col("_i") <= need % max(1, n), 1).otherwise(0)
    base = base.withColumn("_times", times).filter("_times > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times").cast("long"))))
    base = base.select(F.col("id").alias("base"), "copy", F.col("vec").alias("a"), (F.floor(md5_share(key(seed, F.lit("near"), "id", "copy")) * F.least(F.lit(k), F.lit(max(1, n - 1)))) + 1).alias("rank"))
    near = neighbours(own, own, k).select(F.col("query").alias("base"), "rank", F.col("id").alias("neighbour"))
    both = base.join(near, ["base", "rank"]).join(own.select(F.col("id").alias("neighbour"), F.col("vec").alias("b")), "neighbour")
    u = md5_share(key(seed, F.lit("way"), "base", "copy"))
    return both.withColumn("u", u).select("base", "copy", "neighbour", F.zip_with("a", "b", lambda x, y: x.cast("double") + F.col("u") * (y.cast("double") - x.cast("double"))).alias("vec"))


def knn_imputed(df: DataFrame, row_id: str, column: str, by: list[str], k: int, at: str) -> DataFrame:
    """(row_id, filled) for the rows whose column is null: its mean over the k rows nearest in the other columns, which are scaled by their standard
    deviation. `at` names a flag: rows without a value and with it are the stated queries."""
    sd = df.agg(*[F.stddev_pop(c).alias(c) for c in by]).first()
    vec = F.array(*[F.col(c).cast("double") / (sd[c] or 1.0) for c in by])
    d = df.select(F.col(row_id).alias("id"), vec.alias("vec"), F.col(column).alias("v"), F.col(at).alias("asked"))
    near = neighbours(d.filter("v is null and asked"), d.filter("v is not null"), k)
    return near.join(d.select("id", "v"), "id").groupBy(F.col("query").alias(row_id)).agg(F.avg("v").alias("filled"))


def accumulated_effects(df: DataFrame, feature: str, edges: list[float], predict, others: list[str]) -> DataFrame:
    """(at, effect) at the upper edge of each bin, both ends in the first: differences of the prediction between a bin's edges, averaged over its rows and
    added up, less their mean over rows."""
    n = len(edges) - 1
    b = F.least(F.lit(n - 1), F.greatest(F.lit(0), sum(((F.col(feature) > e).cast("int") for e in edges[1:]), F.lit(0))))
    at = lambda i: F.get(F.array(*map(F.lit, edges)), i)
    d = df.filter((F.col(feature) >= edges[0]) & (F.col(feature) <= edges[-1])).withColumn("_b", b)
    rest = {o: F.col(o) for o in others}
    step = predict({feature: at(F.col("_b") + 1), **rest}) - predict({feature: at(F.col("_b")), **rest})
    g = d.groupBy("_b").agg(F.avg(step).alias("step"), F.count("*").alias("n"))
    g = g.withColumn("effect", F.sum("step").over(Window.orderBy("_b")))  # one row a bin
    every = Window.partitionBy()
    return g.select(at(F.col("_b") + 1).alias("at"), (F.col("effect") - F.sum(F.col("effect") * F.col("n")).over(every) / F.sum("n").over(every)).alias("effect"))


def exact_shapley(df: DataFrame, row: str, features: list[str], predict, most: int = 12) -> DataFrame:
    """(row, feature, value): Shapley values against the row of means, over all coalitions of a dozen features at most, as columns; a row's
    values add up to its prediction less that of the means."""
    if len(features) > most:
        raise ValueError(f"{len(features)} features have too many coalitions")
    m = df.agg(*[F.avg(c).alias(c) for c in features]).first()
    p, names = len(features), {}
    for size in range(p + 1):
        for s in combinations(features, size):
            names[frozenset(s)] = predict({c: F.col(c) if c in s else F.lit(float(m[c])) for c in features})
    d = df.select(row, *[v.alias(f"_v{i}") for i, v in enumerate(names.values())])
    at = {s: F.col(f"_v{i}") for i, s in enumerate(names)}
    parts = []
    for c in features:
        terms = [factorial(len(s)) * factorial(p - len(s) - 1) / factorial(p) * (at[s | {c}] - at[s]) for s in names if c not in s]
        parts.append(F.struct(F.lit(c).alias("feature"), reduce(lambda a, b: a + b, terms).alias("value")))
    return d.select(row, F.explode(F.array(*parts)).alias("x")).select(row, "x.*")


def shortcut_audit(df: DataFrame, row_id: str, y: str, score: str, rates: list[float], seed: str) -> DataFrame:
    """(rate, as_trained, clean, wrong): accuracy of a rule that follows a marker where there is one, else a score of 0.5 or more. The marker
    agrees with the label at the rate of training, is absent, or contradicts it, at the same rate."""
    d = df.select(F.col(y).cast("int").alias("y"), (F.col(score) >= 0.5).cast("int").alias("s"), md5_share(key(seed, row_id)).alias("u")).withColumn("rate", F.explode(F.array(*map(F.lit, rates))))
    marked = F.col("u") < F.col("rate")
    right = lambda guess: F.avg((guess == F.col("y")).cast("double"))
    return d.groupBy("rate").agg(right(F.when(marked, F.col("y")).otherwise(F.col("s"))).alias("as_trained"), right(F.col("s")).alias("clean"), right(F.when(marked, 1 - F.col("y")).otherwise(F.col("s"))).alias("wrong"))


def naive_bayes(df: DataFrame, row_id: str, y: str, features: list[str], copies: int) -> DataFrame:
    """(row_id, y, log_odds, inflated): Gaussian naive Bayes log-odds of label 1, and with the first feature there so many times. The model is one row of sums."""
    stats = [F.avg(y).alias("prior")]
    for f in features:
        for c in (0, 1):
            v = F.when(F.col(y) == c, F.col(f))
            stats += [F.avg(v).alias(f"m{c}_{f}"), F.var_pop(v).alias(f"v{c}_{f}")]
    m = df.agg(*stats).first()
    lp = lambda f, c: -0.5 * F.log(F.lit(m[f"v{c}_{f}"])) - F.pow(F.col(f) - m[f"m{c}_{f}"], F.lit(2)) / (2 * m[f"v{c}_{f}"])
    parts = [lp(f, 1) - lp(f, 0) for f in features]
    odds = reduce(lambda a, b: a + b, parts, F.log(F.lit(m["prior"] / (1 - m["prior"]))))
    return df.select(row_id, F.col(y).alias("y"), odds.alias("log_odds"), (odds + (copies - 1) * parts[0]).alias("inflated"))


def anova_filter(long: DataFrame, fold: str, feature: str, value: str, label: str, top: int) -> DataFrame:
    """(fold, feature, f, kept): the F statistic of each feature over the rows outside a fold, and whether it is one of the best there. long has a
    row for each row and feature; a fold, feature and label are one row of three sums."""
    g = long.groupBy(fold, feature, label).agg(F.count("*").alias("n"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("q"))
    w = Window.partitionBy(feature, label)
    g = g.select(fold, feature, label, *[(F.sum(c).over(w) - F.col(c)).alias(c) for c in ("n", "s", "q")]).filter("n > 0")
    t = g.groupBy(fold, feature).agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"), F.count("*").alias("k"))
    between = (F.col("b") - F.col("s") * F.col("s") / F.col("n")) / (F.col("k") - 1)
    t = t.select(fold, feature, (between / ((F.col("q") - F.col("b")) / (F.col("n") - F.col("k")))).alias("f"))
    return t.withColumn("kept", F.row_number().over(Window.partitionBy(fold).orderBy(F.desc(F.round("f", 9)), feature)) <= top)


def normalised_cloud(df: DataFrame, row_id: str, vec: str, kind: str) -> DataFrame:
    """(row_id, vec): raw, centred, l2 (a row's length becomes 1, a zero row stays) or whitened (each dimension over its population standard
    deviation, a constant one over 1). Means and deviations are one row a dimension."""
    if kind == "raw":
        return df.select(row_id, F.transform(vec, lambda x: x.cast("double")).alias("vec"))
    if kind == "l2":
        size = F.sqrt(F.aggregate(vec, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
        return df.select(row_id, vec, size.alias("_n")).select(row_id, F.transform(vec, lambda x: F.when(F.col("_n") > 0, x.cast("double") / F.col("_n")).otherwise(0.0)).alias("vec"))
    if kind not in ("centred", "whitened"):
        raise ValueError(f"no such kind: {kind}")
    m = {r["dim"]: r for r in long_vectors(df, row_id, vec).groupBy("dim").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).collect()}
    means = F.array(*[F.lit(m[i]["m"]) for i in range(len(m))])
    scales = F.array(*[F.lit(m[i]["s"] if kind == "whitened" and m[i]["s"] > 0 else 1.0) for i in range(len(m))])
    return df.select(row_id, F.zip_with(F.zip_with(vec, means, lambda x, y: x.cast("double") - y), scales, lambda x, s: x / s).alias("vec"))


def equilibrated(df: DataFrame, columns: list[str], variant: str) -> DataFrame:
    """df with its columns scaled to length 1 (scaled), less their means (centred), or both with the sample deviation (standardised); a column of
    length or deviation 0 is divided by 1."""
    stats = df.agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("m", F.avg), ("s", F.stddev_samp), ("q", lambda c: F.sqrt(F.sum(F.col(c) * F.col(c)))))]).first()
    shift = lambda i: stats[f"m{i}"] if variant in ("centred", "standardised") else 0.0
    scale = lambda i: (stats[f"q{i}"] if variant == "scaled" else stats[f"s{i}"] if variant == "standardised" else 1.0) or 1.0
    return df.withColumns({c: (F.col(c) - shift(i)) / scale(i) for i, c in enumerate(columns)})


def equal_gini_stress(df: DataFrame, value: str, share: float, scale: float) -> DataFrame:
    """One row: the Gini coefficient, that after the smallest share of values is multiplied by `scale`, and the factor on the largest share that
    gives the same coefficient. While order holds, a coefficient is a ratio of sums that are linear in the factor."""
    d = ranked(df.select(F.col(value).cast("double").alias("v")).filter("v is not null"), ["v"], rank="i")
    n = d.count()
    low, high = F.col("i") <= int(n * share), F.col("i") > n - int(n * share)
    g = d.agg(
        F.sum("v").alias("t"), F.sum(F.col("i") * F.col("v")).alias("r"), F.sum(F.when(low, F.col("v"))).alias("lt"), F.sum(F.when(low, F.col("i") * F.col("v"))).alias("lr"),
        F.sum(F.when(high, F.col("v"))).alias("ht"), F.sum(F.when(high, F.col("i") * F.col("v"))).alias("hr"),
    )
    gini = lambda r, t: 2 * r / (n * t) - (n + 1) / n
    stressed = gini(F.col("r") + (scale - 1) * F.col("lr"), F.col("t") + (scale - 1) * F.col("lt"))
    k = (F.col("stressed") + (n + 1) / n) * n / 2  # r / t that is asked for
    return g.withColumns({"gini": gini(F.col("r"), F.col("t")), "stressed": stressed}).select("gini", "stressed", (1 + (k * F.col("t") - F.col("r")) / (F.col("hr") - k * F.col("ht"))).alias("factor"))


def density_ratio(df: DataFrame, sample: str, feature: str, edges: list[float]) -> DataFrame:
    """(bin, weight, old, new): share of new rows over share of old ones by bin of a feature, as a domain classifier by bins has it; null where no old row is."""
    b = sum(((F.col(feature) >= e).cast("int") for e in edges), F.lit(0))
    g = df.groupBy(b.alias("bin")).agg(F.count_if(~F.col(sample)).alias("old"), F.count_if(F.col(sample)).alias("new"))
    total = df.agg(F.count_if(~F.col(sample)).alias("a"), F.count_if(F.col(sample)).alias("b")).first()
    return g.select("bin", F.when(F.col("old") > 0, F.col("new") / F.col("old") * (total["a"] / max(1, total["b"]))).alias("weight"), "old", "new")
