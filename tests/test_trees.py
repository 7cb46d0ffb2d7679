"""Trees against plain versions: splits, importances, flags, areas under the curve; nulls, ties, constant features, empty tables."""

import random

import numpy as np
import pytest

from tallyloom.operators import trees as T

NAMES = ["a", "b", "c"]


def rows(seed=1, n=160):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        a, b = rng.randrange(6), rng.random()
        y = int(a + 3 * b + rng.gauss(0, 0.7) > 4)
        out.append((i, None if i % 17 == 0 else float(a), float("nan") if i % 23 == 0 else b, 5.0, None if i % 40 == 39 else y, i % 3 > 0))
    return out


def frame(spark, data):
    return spark.createDataFrame(data, "id long, a double, b double, c double, y int, train boolean").repartition(3)


def bins_of(data, count):
    own = [d for d in data if d[4] is not None]
    cut = []
    for j in (1, 2, 3):
        good = [d[j] for d in data if d[j] is not None and d[j] == d[j]]
        lo, hi = min(good), max(good)
        cut.append([-1 if d[j] is None or d[j] != d[j] else 0 if hi <= lo else min(count - 1, int((d[j] - lo) / (hi - lo) * count)) for d in own])
    return np.array(cut).T, np.array([d[4] for d in own], float), np.array([d[5] for d in own])


def brute_tree(x, y, depth, mask=(1, 1, 1)):
    gini = lambda v: 2 * v.sum() * (len(v) - v.sum()) / len(v)

    def grow(own, node, level):
        out = {node: y[own].mean()}, {}
        options = []
        if level < depth:
            for f in range(3):
                for b in sorted(set(x[own, f])) if mask[f] else []:
                    left, right = own[x[own, f] <= b], own[x[own, f] > b]
                    if len(left) and len(right):
                        options.append((-round(gini(y[own]) - gini(y[left]) - gini(y[right]), 9), f, b))
        if options and min(options)[0] < 0:
            g, f, b = min(options)
            out[1][node] = (f, b, -g)
            for part, child in ((own[x[own, f] <= b], 2 * node), (own[x[own, f] > b], 2 * node + 1)):
                v, s = grow(part, child, level + 1)
                out[0].update(v)
                out[1].update(s)
        return out

    return grow(np.arange(len(y)), 1, 0)


def predict(tree, x):
    values, splits = tree
    out = []
    for r in x:
        node = 1
        while node in splits:
            f, b, _ = splits[node]
            node = 2 * node + int(r[f] > b)
        out.append(values[node])
    return np.array(out)


def test_trees_and_importances_equal_brute_force(spark):
    data = rows()
    table = T.binned(frame(spark, data), "id", NAMES, "y", 5, ["train"])
    x, y, train = bins_of(data, 5)
    trees, lacks = T.bootstrapped(table.filter("train"), 3, 5, 3, 3, "s", dropped=True)
    assert lacks == [-1, -1, -1, 0, 1, 2]
    for tree, lack in zip(trees, lacks):
        if tree is trees[0] or lack >= 0:
            want = brute_tree(x[train], y[train], 3, [f != lack for f in range(3)])
            assert tree.splits == want[1]
            assert {k: pytest.approx(v) for k, v in tree.values.items()} == want[0]
    got = {r["feature"]: r for r in T.importances(spark, table.filter("train"), table.filter("not train"), NAMES, 5, 2, 3, "s").collect()}
    forest = [(t.values, t.splits) for t in trees[1:3]]
    xt, yt = x[~train], y[~train] > 0.5
    vote = lambda z: sum(predict(t, z) > 0.5 for t in forest) > 1
    whole = (predict(brute_tree(x[train], y[train], 3), xt) > 0.5) != yt
    for i, name in enumerate(NAMES):
        errors = []
        for b in xt[:, i]:  # the mean over all rows that the feature could be taken from
            z = xt.copy()
            z[:, i] = b
            errors.append((vote(z) != yt).mean())
        assert got[name]["permuted"] == pytest.approx(np.mean(errors) - (vote(xt) != yt).mean())
        less = brute_tree(x[train], y[train], 3, [f != i for f in range(3)])
        assert got[name]["dropped"] == pytest.approx(((predict(less, xt) > 0.5) != yt).mean() - whole.mean())
        assert got[name]["impurity"] == pytest.approx(sum(g for _, s in forest for f, _, g in s.values() if f == i) / 2 / train.sum())
    assert got["c"]["impurity"] == got["c"]["permuted"] == got["c"]["dropped"] == 0 and got["a"]["impurity"] > 0


def test_boosting_lowers_training_loss_and_survives_one_class(spark):
    table = T.binned(frame(spark, rows(2)), "id", NAMES, "y", 5, ["train"])
    curve = T.boosting_curve(table.filter("train"), table.filter("not train"), 3, 5, 5, 2, 0.4).collect()
    loss = [r["log_loss"] for r in sorted(curve, key=lambda r: r["round"]) if r["part"] == "train"]
    assert len(loss) == 6 and all(b < a for a, b in zip(loss, loss[1:]))
    same = table.filter("train and y = 1")
    assert {r["error"] for r in T.boosting_curve(same, same, 3, 5, 2, 2, 0.4).collect()} == {0.0}


def test_trees_without_rows_or_splits(spark):
    table = T.binned(frame(spark, rows(3)), "id", NAMES, "y", 5, ["train"])
    trees, _ = T.bootstrapped(table.filter("id < 0"), 3, 5, 2, 2, "s")
    assert [t.splits for t in trees] == [{}, {}]
    each, one = T.reliability(spark, table.filter("y = 1"), table, NAMES, 5, 4, 2, "s")
    assert each.filter("root is not null or top <> ''").count() == 0 and one.first()["pair_disagreement"] == 0


def test_isolation_puts_far_rows_first_and_leaves_nulls(spark):
    rng = np.random.default_rng(4)
    data = [(i, [float(v) for v in rng.normal(size=2) + (8 if i < 6 else 0)], int(i < 6)) for i in range(300)] + [(999, None, 0)]
    df = spark.createDataFrame(data, "id long, vec array<double>, y int").repartition(3)
    got = T.isolation_scores(df, 2, 20, 64, "s").cache()
    scores = {r["id"]: r["score"] for r in got.collect()}
    assert scores[999] is None and all(0 < s < 1 for i, s in scores.items() if i != 999)
    assert T.rank_auc(got.withColumn("all", got["id"] * 0), ["all"], "score", "y").first()["auc"] > 0.99
    few = T.isolation_scores(df.filter("id < 3"), 2, 5, 64, "s").collect()
    assert all(0 < r["score"] < 1 for r in few)
    assert T.isolation_scores(df.limit(0), 2, 5, 64, "s").count() == 0


def test_flags_take_all_that_tie_with_the_last(spark):
    df = spark.createDataFrame([(0.9, 1), (0.5, 1), (0.5, 0), (0.1, 0), (None, 1)], "s double, y int")
    got = {r["rate"]: (r["flagged"], r["precision"], r["recall"]) for r in T.flagged(df, "s", "y", [0.25, 0.5]).collect()}
    assert got[0.25] == (0.25, 1.0, pytest.approx(1 / 3)) and got[0.5] == (0.75, pytest.approx(2 / 3), pytest.approx(2 / 3))
    assert T.flagged(df.limit(0), "s", "y", [0.5]).count() == 0


def test_area_under_the_curve_counts_ties_half(spark):
    rng = random.Random(1)
    data = [(rng.choice("ab"), rng.randrange(6) / 5, rng.randrange(2)) for _ in range(80)] + [("a", None, 1)]
    got = {r["g"]: r["auc"] for r in T.rank_auc(spark.createDataFrame(data, "g string, s double, y int"), ["g"], "s", "y").collect()}
    for g in "ab":
        pos, neg = ([s for h, s, y in data if h == g and s is not None and y == k] for k in (1, 0))
        assert got[g] == pytest.approx(np.mean([(p > q) + 0.5 * (p == q) for p in pos for q in neg]))
