"""Trees from histograms, many at once: bootstrapped, boosted and isolation trees.

Rows keep their features as small bin numbers. A level of all trees together is
one pass: tasks find the node of every row in every tree, sum weights, labels
and curvatures by (tree, node, feature, bin), and send on these sums. The best
splits are a window over so many sums, and they alone reach the driver, where a
tree is a list of nodes: node 1 is the root, nodes 2i and 2i + 1 follow node i.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.hashing import md5_share
from tallyloom.functions.ranks import order_statistic, ranked_by
from tallyloom.functions.storage import written
from tallyloom.operators.resample import key, poisson


@dataclass
class Tree:
    """Splits by node as (feature, bin, gain): values up to the bin go left; and leaf values by node."""

    splits: dict[int, tuple[int, int, float]] = field(default_factory=dict)
    values: dict[int, float] = field(default_factory=dict)

    def nodes(self, bins: np.ndarray, depth: int) -> np.ndarray:
        """The node of each row after `depth` levels; one without a split keeps its rows."""
        at = np.ones(len(bins), np.int64)
        for _ in range(depth):
            new = at.copy()
            for node in np.unique(at).tolist():
                if node in self.splits:
                    f, b, _ = self.splits[node]
                    own = at == node
                    new[own] = 2 * node + (bins[own, f] > b)
            at = new
        return at

    def predict(self, bins: np.ndarray, depth: int) -> np.ndarray:
        at = self.nodes(bins, depth)
        out = np.zeros(len(bins))
        for node in np.unique(at).tolist():
            out[at == node] = self.values.get(node, 0.0)
        return out


def binned(df: DataFrame, row_id: str, features: list[str], y: str, bins: int, keep: list[str] | None = None) -> DataFrame:
    """(id, y, bins, keep) of rows with a label: each feature in `bins` equal steps from its smallest to its largest value; null and NaN are bin -1."""
    ends = df.agg(*[f(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))).alias(f"{n}_{i}") for i, c in enumerate(features) for n, f in (("lo", F.min), ("hi", F.max))]).first()

    def cut(i: int, c: str) -> Column:
        lo, hi, x = ends[f"lo_{i}"], ends[f"hi_{i}"], F.col(c).cast("double")
        if lo is None or hi <= lo:
            return F.when(x.isNull() | F.isnan(x), -1).otherwise(0)
        return F.when(x.isNull() | F.isnan(x), -1).otherwise(F.least(F.lit(bins - 1), F.floor((x - lo) / (hi - lo) * bins))).cast("int")

    rows = df.filter(F.col(y).isNotNull()).select(F.col(row_id).alias("id"), F.col(y).cast("double").alias("y"), F.array(*[cut(i, c) for i, c in enumerate(features)]).alias("bins"), *(keep or []))
    return written(rows, "binned")


def _matrix(col: pa.Array, n: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def _best_splits(table: DataFrame, trees: list[Tree], masks: list[list[int]], level: int, bins: int, rows_of, gini: bool, least: int) -> list:
    """One level: the best split of each open node of each tree. rows_of gives for a batch the (rows x trees) weights, labels and curvatures, or
    arrays of one column that hold for all trees. Each result has the sums of both sides."""
    n_trees, width, p = len(trees), 1 << level, len(masks[0])

    def sums(batches):
        total = np.zeros((n_trees, width, p, bins + 1, 3))
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("bins"), batch.num_rows)
            w, s, h = rows_of(batch, x)
            for t, tree in enumerate(trees):
                at = tree.nodes(x, level) - width
                c = min(t, w.shape[1] - 1)
                own = np.flatnonzero((w[:, c] > 0) & (at >= 0))
                for f in range(p):
                    if masks[t][f]:
                        cell = at[own] * (bins + 1) + x[own, f] + 1
                        for i, v in enumerate((w[own, c], s[own, c], h[own, c])):
                            total[t, :, f, :, i] += np.bincount(cell, v, width * (bins + 1)).reshape(width, bins + 1)
        where = np.nonzero(total[..., 0])
        yield pa.RecordBatch.from_arrays([*(pa.array(a.astype(np.int32)) for a in where), *(pa.array(total[..., i][where]) for i in range(3))], names=["tree", "node", "feature", "bin", "n", "s", "h"])

    cells = table.mapInArrow(sums, "tree int, node int, feature int, bin int, n double, s double, h double")
    cells = cells.repartition("tree", "node")  # one shuffle for sums, running sums and best splits; a task sends a row a bin at most
    cells = cells.groupBy("tree", "node", "feature", "bin").agg(*[F.sum(c).alias(c) for c in "nsh"])
    every = Window.partitionBy("tree", "node", "feature")
    upto = every.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)  # as many rows as bins
    d = cells.select("tree", "node", "feature", (F.col("bin") - 1).alias("bin"), *[F.sum(c).over(w).alias(f"{x}{c}") for c in "nsh" for x, w in (("l", upto), ("", every))])
    side = (lambda n, s: s * (n - s) / n) if gini else (lambda n, s: -s * s / n)
    rn, rs, n, s, ln, ls = F.col("n") - F.col("ln"), F.col("s") - F.col("ls"), F.col("n"), F.col("s"), F.col("ln"), F.col("ls")
    d = d.filter((F.col("ln") >= least) & (rn >= least) & (rn > 0))
    gain = (2.0 if gini else 1.0) * (side(n, s) - side(ln, ls) - side(rn, rs))
    best = d.withColumn("gain", F.round(gain, 9)).filter("gain > 0").groupBy("tree", "node")
    row = F.struct("gain", (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"), "n", "s", "h", "ln", "ls", "lh")
    return best.agg(F.max(row).alias("r")).select("tree", (F.col("node") + width).alias("node"), "r.*").collect()  # a row an open node


def _grown(table: DataFrame, n_trees: int, masks: list[list[int]], depth: int, bins: int, rows_of, gini: bool, least: int, leaf) -> list[Tree]:
    trees = [Tree() for _ in range(n_trees)]
    for level in range(depth):
        for r in _best_splits(table, trees, masks, level, bins, rows_of, gini, least):
            t = trees[r["tree"]]
            t.splits[r["node"]] = (-r["f"], -r["b"], r["gain"])
            t.values[2 * r["node"]] = leaf(r["ln"], r["ls"], r["lh"])
            t.values[2 * r["node"] + 1] = leaf(r["n"] - r["ln"], r["s"] - r["ls"], r["h"] - r["lh"])
            t.values.setdefault(1, leaf(r["n"], r["s"], r["h"]))
    return trees


def bootstrapped(table: DataFrame, features: int, bins: int, reps: int, depth: int, seed: str, least: int = 1, dropped: bool = False) -> tuple[list[Tree], list[int]]:
    """Gini trees of 0/1 labels under Poisson weights of the rows (replicate 0: all weights 1), and which feature each one lacks (-1: none).
    With `dropped`, replicate 0 is grown once more without each feature."""
    lacks = [-1] * reps + (list(range(features)) if dropped else [])
    masks = [[int(f != lack) for f in range(features)] for lack in lacks]
    u = [F.lit(1)] + [poisson(md5_share(key(seed, F.lit(r), "id"))).cast("int") for r in range(1, reps)]
    weighted = written(table.withColumn("w", F.array(*u)), "weighted")

    def rows_of(batch, x):
        w = _matrix(batch.column("w"), batch.num_rows).astype(float)
        w = w[:, list(range(reps)) + [0] * (len(lacks) - reps)]
        s = w * batch.column("y").to_numpy()[:, None]
        return w, s, np.zeros_like(w)

    trees = _grown(weighted, len(lacks), masks, depth, bins, rows_of, True, least, lambda n, s, h: s / n)
    if any(1 not in t.values for t in trees):  # no split was worth it
        n, s = weighted.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0.0))).first()
        for t in trees:
            t.values.setdefault(1, s / n if n else 0.0)
    return trees, lacks


def tree_rows(spark, trees: list[Tree], names: list[str]) -> DataFrame:
    """(rep, node, feature, bin, gain) of all splits."""
    rows = [(t, node, names[f], b, g) for t, tree in enumerate(trees) for node, (f, b, g) in sorted(tree.splits.items())]
    return spark.createDataFrame(rows, "rep int, node int, feature string, bin int, gain double")


def votes(table: DataFrame, trees: list[Tree], depth: int) -> DataFrame:
    """(id, y, votes): for each row how many trees give it more than a half, as 0/1 by tree."""

    def rows(batches):
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("bins"), batch.num_rows)
                v = np.stack([t.predict(x, depth) > 0.5 for t in trees], 1).astype(np.int32)
                ends = np.arange(len(v) + 1, dtype=np.int32) * len(trees)
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("y"), pa.ListArray.from_arrays(ends, pa.array(v.ravel()))], names=["id", "y", "votes"])

    return table.select("id", "y", "bins").mapInArrow(rows, "id long, y double, votes array<int>")


def reliability(spark, train: DataFrame, test: DataFrame, names: list[str], bins: int, reps: int, depth: int, seed: str) -> tuple[DataFrame, DataFrame]:
    """Per replicate (rep, root, top, same_top, accuracy), replicate 0 being the tree of all rows and `top` the features of its first three levels; and one row
    (trees, root_same, sets, modal_share, accuracy_sd, pair_disagreement, any_disagree). The share of pairs of replicates that disagree follows from each row's
    number of votes, so no pair of trees is formed."""
    trees, _ = bootstrapped(train, len(names), bins, reps + 1, depth, seed)
    v = written(votes(test, trees, depth), "votes")
    hits = v.select("y", F.posexplode("votes").alias("rep", "vote")).groupBy("rep").agg(F.avg((F.col("vote") == F.col("y")).cast("double")).alias("accuracy"))
    splits = tree_rows(spark, trees, names)
    top = splits.filter("node < 8").groupBy("rep").agg(F.max(F.when(F.col("node") == 1, F.col("feature"))).alias("root"), F.concat_ws(",", F.array_sort(F.collect_set("feature"))).alias("top"))
    each = written(hits.join(top, "rep", "left").select("rep", "root", F.coalesce("top", F.lit("")).alias("top"), "accuracy"), "replicates")
    full = each.filter("rep = 0").select(F.col("root").alias("r0"), F.col("top").alias("t0"))
    each = each.crossJoin(F.broadcast(full)).withColumns({"same_root": F.col("root").eqNullSafe(F.col("r0")), "same_top": F.col("top") == F.col("t0")}).drop("r0", "t0")  # one row
    b = each.filter("rep > 0")
    sets = b.groupBy("top").agg(F.count("*").alias("n")).agg(F.count("*").alias("sets"), (F.max("n") / reps).alias("modal_share"))
    own = b.agg(F.count("*").alias("trees"), F.avg(F.col("same_root").cast("double")).alias("root_same"), F.stddev_pop("accuracy").alias("accuracy_sd"))
    c = F.aggregate(F.slice("votes", 2, reps), F.lit(0), lambda s, x: s + x)
    apart = v.select(c.alias("c")).agg((F.sum(F.col("c") * (reps - F.col("c"))) / (F.count("*") * (reps * (reps - 1) / 2))).alias("pair_disagreement"), F.avg(((F.col("c") > 0) & (F.col("c") < reps)).cast("double")).alias("any_disagree"))
    return each, own.crossJoin(sets).crossJoin(apart)  # one row each


def importances(spark, train: DataFrame, test: DataFrame, names: list[str], bins: int, reps: int, depth: int, seed: str) -> DataFrame:
    """(feature, impurity, permuted, dropped): of bootstrapped trees the mean fall in Gini impurity a row that a feature's splits bring, on the training rows; the
    rise of the vote's error on the test rows that permuting the feature is expected to bring, its bins being drawn from all test rows; and the rise of
    the error of the tree of all rows when it is grown without the feature."""
    p = len(names)
    trees, lacks = bootstrapped(train, p, bins, reps + 1, depth, seed, dropped=True)
    n = train.count()
    shares = test.select(F.posexplode("bins").alias("f", "b")).groupBy("f", "b").agg(F.count("*").alias("n")).collect()  # features x bins
    marginal = [[(r["b"], r["n"]) for r in shares if r["f"] == f] for f in range(p)]
    forest, whole, without = trees[1 : reps + 1], trees[0], trees[reps + 1 :]

    def rows(batches):
        total = np.zeros(2 + 2 * p)
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = _matrix(batch.column("bins"), batch.num_rows).copy(), batch.column("y").to_numpy() > 0.5
            vote = lambda z: sum(t.predict(z, depth) > 0.5 for t in forest) > len(forest) / 2
            total[0] += (vote(x) != y).sum()
            total[1] += ((whole.predict(x, depth) > 0.5) != y).sum()
            for f in range(p):
                own, size = x[:, f].copy(), sum(m for _, m in marginal[f])
                for b, m in marginal[f]:
                    x[:, f] = b
                    total[2 + f] += (vote(x) != y).sum() * m / size
                x[:, f] = own
                total[2 + p + f] += ((without[f].predict(x, depth) > 0.5) != y).sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["i", "s"])

    m = test.count()
    e = {r["i"]: r["s"] / m for r in test.select("y", "bins").mapInArrow(rows, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).collect()} if m else {}
    gains = [sum(g for t in forest for f, _, g in t.splits.values() if f == i) / (len(forest) * max(1, n)) for i in range(p)]
    out = [(names[i], gains[i], e[2 + i] - e[0] if e else None, e[2 + p + i] - e[1] if e else None) for i in range(p)]
    return spark.createDataFrame(out, "feature string, impurity double, permuted double, dropped double")


def boosted(train: DataFrame, features: int, bins: int, rounds: int, depth: int, rate: float, least: int = 1) -> tuple[float, list[Tree]]:
    """The first score and the trees of gradient boosting of 0/1 labels by log loss: each tree splits by the fall in squared error of the residuals,
    and a leaf adds rate times their sum over the sum of p(1 - p)."""
    n, s = train.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0.0))).first()
    share = min(max(s / n if n else 0.5, 1e-9), 1 - 1e-9)
    first, trees = float(np.log(share / (1 - share))), []
    for _ in range(rounds):
        so_far = list(trees)

        def rows_of(batch, x, so_far=so_far):
            p = 1 / (1 + np.exp(-sum((t.predict(x, depth) for t in so_far), np.full(len(x), first))))
            return np.ones((len(x), 1)), (batch.column("y").to_numpy() - p)[:, None], (p * (1 - p))[:, None]

        trees += _grown(train, 1, [[1] * features], depth, bins, rows_of, False, least, lambda n, s, h: rate * s / max(h, 1e-12))
    return first, trees


def boosting_curve(train: DataFrame, test: DataFrame, features: int, bins: int, rounds: int, depth: int, rate: float) -> DataFrame:
    """(part, round, log_loss, error) after every round, 0 being the first score alone; part is train or test. A score above 0 counts as 1."""
    first, trees = boosted(train, features, bins, rounds, depth, rate)

    def staged(batches):
        total, n = np.zeros((rounds + 1, 2)), 0
        for batch in batches:
            if batch.num_rows:
                x, y = _matrix(batch.column("bins"), batch.num_rows), batch.column("y").to_numpy()
                score, n = np.full(len(x), first), n + len(x)
                for k in range(rounds + 1):
                    score = score if k == 0 else score + trees[k - 1].predict(x, depth)
                    p = np.clip(1 / (1 + np.exp(-score)), 1e-12, 1 - 1e-12)
                    total[k] += -(y * np.log(p) + (1 - y) * np.log(1 - p)).sum(), ((score > 0) != (y > 0.5)).sum()
        k = np.arange(rounds + 1, dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(total[:, 0]), pa.array(total[:, 1]), pa.array(np.full(rounds + 1, n, np.int64))], names=["round", "l", "e", "n"])

    out = None
    for part, d in (("train", train), ("test", test)):
        s = d.select("y", "bins").mapInArrow(staged, "round int, l double, e double, n long").groupBy("round").agg(*[F.sum(c).alias(c) for c in "len"])
        s = s.select(F.lit(part).alias("part"), "round", (F.col("l") / F.col("n")).alias("log_loss"), (F.col("e") / F.col("n")).alias("error"))
        out = s if out is None else out.union(s)
    return out


# isolation trees


def _average_path(n: float) -> float:
    """The mean path length of an unsuccessful search among n."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def isolation_trees(df: DataFrame, dims: int, trees: int, size: int, seed: str) -> dict[int, list[tuple]]:
    """By tree (node, dim, cut, n) of trees grown from `size` rows each, those of smallest hash of seed, tree and id. A node takes the dimension that a
    hash of seed, tree and node names, and is cut at a share, by another hash, of the way from its smallest to its largest value there; a node of one
    row, of equal values, or at depth ceil(log2(size)) is a leaf. Trees are grown each in one task, from `size` rows; so many numbers reach the driver."""
    n = df.count()
    share = min(1.0, 8.0 * size / max(1, n))  # eight times what is needed, so that none comes short
    asked = df.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).withColumn("u", md5_share(key(seed, F.lit("row"), "tree", "id")))
    near = ranked_by(asked.filter(F.col("u") <= share), ["tree"], ["u", "id"], rank="i").filter(F.col("i") <= size).select("tree", "vec")
    depth = int(np.ceil(np.log2(max(2, size))))
    draws = df.sparkSession.range(1, 1 << depth).select(F.col("id").alias("node")).withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    draws = draws.select("tree", "node", F.floor(md5_share(key(seed, F.lit("dim"), "tree", "node")) * dims).cast("int").alias("dim"), md5_share(key(seed, F.lit("cut"), "tree", "node")).alias("u"))

    def grow(rows: pa.Table, drawn: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return pa.table({c: pa.array([], t) for c, t in (("tree", pa.int32()), ("node", pa.int64()), ("dim", pa.int32()), ("cut", pa.float64()), ("n", pa.int64()))})
        x = np.array(rows.column("vec").to_pylist(), float)
        how = {a: (b, c) for a, b, c in zip(*(drawn.column(c).to_pylist() for c in ("node", "dim", "u")))}
        out, todo = [], [(1, np.arange(len(x)))]
        while todo:
            node, own = todo.pop()
            dim, u = how.get(node, (0, 0.0))
            lo, hi = x[own, dim].min(), x[own, dim].max()
            if node >= 1 << depth or len(own) <= 1 or lo == hi:
                out.append((node, -1, 0.0, len(own)))
                continue
            at = lo + u * (hi - lo)
            out.append((node, dim, at, len(own)))
            todo += [(2 * node, own[x[own, dim] <= at]), (2 * node + 1, own[x[own, dim] > at])]
        node, dim, at, n = zip(*out)
        tree = rows.column("tree")[0].as_py()
        return pa.table({"tree": pa.array([tree] * len(node), pa.int32()), "node": pa.array(node, pa.int64()), "dim": pa.array(dim, pa.int32()), "cut": pa.array(at, pa.float64()), "n": pa.array(n, pa.int64())})

    grown = near.groupBy("tree").cogroup(draws.groupBy("tree")).applyInArrow(grow, "tree int, node long, dim int, cut double, n long").collect()
    out: dict[int, list[tuple]] = {}
    for r in grown:
        out.setdefault(r["tree"], []).append((r["node"], r["dim"], r["cut"], r["n"]))
    return out


def isolation_scores(df: DataFrame, dims: int, trees: int, size: int, seed: str) -> DataFrame:
    """df(id, vec, ...) with `score` in (0, 1): 2 to the power of minus the mean path length in the trees over that of a search among `size` rows. Higher is
    odder. Null vectors have no score."""
    sound = df.filter("vec is not null")
    grown = isolation_trees(sound.select("id", "vec"), dims, trees, size, seed)
    norm = _average_path(size)

    @F.pandas_udf("double")
    def score(vec):
        x = np.array([[0.0] * dims if v is None else v for v in vec], float).reshape(len(vec), dims)
        total = np.zeros(len(x))
        for nodes in grown.values():
            own = {node: (dim, at, n) for node, dim, at, n in nodes}
            at = np.ones(len(x), np.int64)
            todo = [1]
            while todo:
                node = todo.pop()
                here = np.flatnonzero(at == node)
                dim, cut, n = own[node]
                if dim < 0:
                    total[here] += int(node).bit_length() - 1 + _average_path(n)
                else:
                    at[here] = 2 * node + (x[here, dim] > cut)
                    todo += [2 * node, 2 * node + 1]
        import pandas as pd

        return pd.Series(2.0 ** (-total / max(1, len(grown)) / norm) if norm else np.full(len(x), 0.5))

    return df.withColumn("score", F.when(F.col("vec").isNotNull(), score("vec")))


def flagged(scores: DataFrame, score: str, label: str, rates: list[float]) -> DataFrame:
    """(rate, flagged, precision, recall): with the ceil(rate n) highest scores flagged, and those equal to the last of them."""
    n = scores.filter(F.col(score).isNotNull()).count()
    cuts = [(r, order_statistic(scores, score, n - int(np.ceil(r * n)) + 1)) for r in rates] if n else []
    y = F.col(label).cast("double")
    sums = scores.agg(F.sum(y).alias("all"), *[f.alias(f"{c}{i}") for i, (_, cut) in enumerate(cuts) for c, f in (("n", F.count(F.when(F.col(score) >= cut, 1))), ("s", F.sum(F.when(F.col(score) >= cut, y))))])
    if not cuts:
        return sums.selectExpr("0D as rate", "0D as flagged", "0D as precision", "0D as recall").limit(0)
    return sums.select(F.inline(F.array(*[F.struct(F.lit(r).alias("rate"), (F.col(f"n{i}") / n).alias("flagged"), (F.col(f"s{i}") / F.col(f"n{i}")).alias("precision"), (F.col(f"s{i}") / F.col("all")).alias("recall")) for i, (r, _) in enumerate(cuts)])))


def rank_auc(scores: DataFrame, by: list[str], score: str, label: str) -> DataFrame:
    """(by, n, auc): the share of pairs of a 1 and a 0 whose scores are in that order, half of ties, from ranks by group of any size."""
    counted = scores.filter(F.col(score).isNotNull()).groupBy(*by, F.col(score).alias("_v")).agg(F.count("*").alias("_n"), F.sum(F.col(label).cast("double")).alias("_p"))
    rows = ranked_by(counted.withColumn("_q", F.col("_n") - F.col("_p")), by, ["_v"], sums={"_below": "_q"}, rank="_i")
    won = F.sum(F.col("_p") * (F.col("_below") - F.col("_q") / 2))
    return rows.groupBy(*by).agg(F.sum("_n").alias("n"), (won / (F.sum("_p") * F.sum("_q"))).alias("auc"))
