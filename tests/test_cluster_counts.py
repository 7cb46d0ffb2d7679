"""How many clusters: mixtures, gaps, stability and silhouettes against plain versions and known shapes."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.functions import blocks
from tallyloom.operators import cluster_counts as C
from tallyloom.operators import learning as L
from tallyloom.operators import modelling as M


def frame(spark, x):
    return spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)] + [(None, [0.0] * len(x[0])), (10_000, None), (10_001, [float("nan")] * len(x[0]))], "id long, vec array<double>").repartition(3)


def three(n=240, seed=0):
    rng = np.random.default_rng(seed)
    return np.array([[0, 0], [6, 0], [3, 5]])[np.arange(n) % 3] + rng.normal(size=(n, 2)) * 0.6


def test_mixtures_pick_three_and_grow_likelier(spark):
    df = frame(spark, three())
    rows = {r["k"]: r for r in C.mixture_orders(df, [1, 2, 3, 4], 3, 12, "s").collect()}
    assert min(rows, key=lambda k: rows[k]["bic"]) == min(rows, key=lambda k: rows[k]["icl"]) == 3
    n, x = 240, three()
    cov = np.cov(x.T, bias=True) + 1e-6 * np.trace(np.cov(x.T, bias=True)) / 2 * np.eye(2)
    z = x - x.mean(0)
    ll = (-0.5 * (2 * math.log(2 * math.pi) + math.log(np.linalg.det(cov)) + np.einsum("np,pq,nq->n", z, np.linalg.inv(cov), z))).sum()
    assert rows[1]["log_likelihood"] == pytest.approx(ll, abs=1e-5) and rows[1]["bic"] == pytest.approx(-2 * ll + 5 * math.log(n), abs=1e-4)
    steps = [C.mixture_orders(df, [3], 1, s, "s").first()["log_likelihood"] for s in (0, 2, 4)]
    assert steps[0] < steps[1] < steps[2]


def test_more_components_than_rows_and_no_rows(spark):
    df = frame(spark, three(3))
    assert [r["k"] for r in C.mixture_orders(df, [1, 2, 9], 1, 2, "s").collect()] == [1, 2]
    assert C.mixture_orders(df.filter("id < 0"), [1], 1, 2, "s").count() == C.gap_statistic(df.filter("id < 0"), [1], 2, 2, "s").count() == 0
    assert C.subsample_stability(df.filter("id < 0"), [2], 2, 0.8, 2, "s").count() == 0


def test_gap_finds_three_groups_and_one_square(spark):
    rule = lambda x: [r["k"] for r in C.gap_statistic(frame(spark, x), [1, 2, 3, 4], 4, 8, "s").filter("rule").collect()]
    assert rule(three()) == [3]
    assert rule(np.random.default_rng(3).random((300, 2))) == [1]


def test_stability_is_highest_at_the_true_number(spark):
    got = {r["k"]: r["ari"] for r in C.subsample_stability(frame(spark, three()), [2, 3, 5], 3, 0.8, 8, "s").collect()}
    assert max(got, key=got.get) == 3 and got[3] > 0.95


def brute_silhouettes(x, label):
    out = {}
    for i, v in enumerate(x):
        mean = {c: [math.dist(v, w) for j, w in enumerate(x) if label[j] == c and j != i] for c in set(label)}
        far = [sum(d) / len(d) for c, d in mean.items() if c != label[i]]
        own = mean[label[i]]
        out[i] = None if not far else 0.0 if not own else (min(far) - sum(own) / len(own)) / max(min(far), sum(own) / len(own)) if max(min(far), sum(own) / len(own)) else 0.0
    return out


def test_silhouettes_equal_brute_force_in_small_blocks(spark, monkeypatch):
    x = np.round(three(60), 2)
    x[7], label = x[10], [i % 3 for i in range(59)] + [9]
    monkeypatch.setattr(C, "met_in_blocks", lambda *a: blocks.met_in_blocks(*a, size=17))
    df = spark.createDataFrame([(i, [float(a) for a in v], c) for i, (v, c) in enumerate(zip(x, label))], "id long, vec array<double>, cluster int")
    want = brute_silhouettes(x, label)
    assert {r["id"]: r["silhouette"] for r in C.silhouettes(df).collect()} == {i: pytest.approx(s) for i, s in want.items()}
    some = C.silhouettes(df, df.filter("id % 10 = 0")).collect()
    assert {r["id"] for r in some} == set(range(0, 60, 10)) and all(r["silhouette"] == pytest.approx(want[r["id"]]) for r in some)
    assert {r["silhouette"] for r in C.silhouettes(df.filter("cluster = 1")).collect()} == {None}


def test_neighbours_in_small_blocks_equal_brute_force(spark):
    x = np.float32(np.round(three(90), 2))
    x[5] = x[80]
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "id long, vec array<float>")
    got = {}
    for r in L.neighbours(df.filter("id % 7 = 0"), df, 4, at_once=13).collect():
        got.setdefault(r["query"], {})[r["rank"]] = r["id"]
    for q, near in got.items():
        want = sorted((round(float(np.sqrt(np.square(x[q].astype(float) - x[j].astype(float)).sum())), 9), j) for j in range(90) if j != q)[:4]
        assert [near[i] for i in range(1, 5)] == [j for _, j in want]
    assert len(got) == 13 and L.neighbours(df.limit(0), df, 3).count() == L.neighbours(df, df.limit(0), 3).count() == 0


def test_neighbours_among_copies_take_the_smaller_ids_and_keep_all_digits(spark):
    rng = np.random.default_rng(11)
    x = np.concatenate([np.repeat([[0.25, 0.5, 0.75]], 300, 0), 1000 + np.round(rng.random((60, 3)), 6), rng.normal(size=(140, 3))])
    x = x[rng.permutation(len(x))]
    df = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(x)] + [(900, None), (901, [float("nan")] * 3)], "id long, vec array<double>").repartition(5)
    got = {}
    for r in L.neighbours(df.filter("id % 3 = 0"), df, 4, at_once=40).collect():
        got.setdefault(r["query"], {})[r["rank"]] = (r["id"], round(r["d"], 9))
    for i in range(0, len(x), 3):
        d = np.round(np.sqrt(((x - x[i]) ** 2).sum(1)), 9)
        want = [(int(j), float(d[j])) for j in np.lexsort((np.arange(len(x)), d)) if j != i][:4]
        assert [got[i][n] for n in (1, 2, 3, 4)] == want


def test_outlier_factors_of_copies_divide_by_no_zero(spark):
    df = spark.createDataFrame([(i, [float(i % 4 == 0), 0.0]) for i in range(40)] + [(40 + i, [5.0 + i * i, 1.0]) for i in range(6)], "id long, vec array<double>")
    got = {r["id"]: r["lof"] for r in M.anomaly_scores(df, df, 3).collect()}
    assert len(got) == 46 and np.isnan(got[0]) and np.isfinite(got[45])


def test_mean_silhouettes_of_several_clusterings_equal_those_of_each(spark, monkeypatch):
    df = spark.createDataFrame([(i, [float(i % 9), float(i * i % 5)], i % 3, i % 2, 7, min(i, 1)) for i in range(80)], "id long, vec array<double>, a long, b long, one long, lone long")
    want = {c: C.silhouettes(df.withColumn("cluster", F.col(c))).agg(F.avg("silhouette")).first()[0] for c in ("a", "b", "one", "lone")}
    met, each = [], C.met_in_blocks
    monkeypatch.setattr(C, "met_in_blocks", lambda asked, rows, *rest: met.append(rows.count()) or each(asked, rows, *rest))
    got = {r["clusters"]: r["silhouette"] for r in C.silhouette_means(df, ["a", "b", "one", "lone"], size=9).collect()}
    assert met == [df.select("vec", "a", "b", "one", "lone").distinct().count()]  # distances once for all, and once for copies
    assert got["one"] is None and all(got[c] == pytest.approx(want[c]) for c in ("a", "b", "lone"))
