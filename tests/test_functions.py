"""Shared functions against closed forms and plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import ranks, special
from tallyloom.functions.hashing import md5_normal_pair, stable_share, uniform


def test_ranks_and_running_sums(spark):
    rng = random.Random(1)
    values = [rng.randrange(50) / 2 for _ in range(500)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v double").repartition(7)
    got = ranks.ranked(df, ["v", "i"], {"upto": "v"}).orderBy("rank").collect()
    total = 0.0
    for n, (v, i) in enumerate(sorted((v, i) for i, v in enumerate(values)), 1):
        total += v
        r = got[n - 1]
        assert (r["i"], r["rank"]) == (i, n) and r["upto"] == pytest.approx(total)


def test_order_statistics(spark):
    rng = random.Random(2)
    values = [rng.gauss(0, 1) if rng.random() < 0.8 else 0.25 for _ in range(30_000)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "v double").repartition(5)
    for k in (1, 2, 15_000, 29_999, 30_000):
        assert ranks.order_statistic(df, "v", k) == sorted(values)[k - 1]
    assert ranks.order_statistic(df, "v", 30_001) is None


def test_distribution_functions():
    assert special.normal_cdf(1.959963984540054) == pytest.approx(0.975)
    assert special.normal_quantile(0.975) == pytest.approx(1.959963984540054)
    assert special.chi2_1_tail(3.841458820694124) == pytest.approx(0.05)
    assert special.t_tail(2.2281388519649385, 10) == pytest.approx(0.05)
    assert special.binomial_two_sided(2, 10) == pytest.approx(2 * (1 + 10 + 45) / 1024)
    assert special.binomial_cdf(3, 10, 0.3) == pytest.approx(sum(math.comb(10, k) * 0.3**k * 0.7 ** (10 - k) for k in range(4)))
    assert special.expected_best(1, 50) == pytest.approx(0.5)
    n = special.trials_to_reach(0.65, 50)
    assert special.expected_best(n, 50) >= 0.65 > special.expected_best(n - 1, 50)
    assert special.kolmogorov_tail(1.3580986 / math.sqrt(1000), 1000) == pytest.approx(0.05, abs=1e-4)


def test_hash_numbers_follow_from_keys(spark):
    df = spark.range(20_000)
    u = uniform(7, F.col("id"))
    s = df.select(u.alias("u"), md5_normal_pair(F.col("id").cast("string")).alias("z"), stable_share(F.col("id").cast("string")).alias("s"))
    a = s.agg(F.avg("u"), F.min("u"), F.max("u"), F.avg("z"), F.stddev("z"), F.avg("s")).first()
    assert abs(a[0] - 0.5) < 0.01 and 0 <= a[1] and a[2] < 1 and abs(a[3]) < 0.03 and abs(a[4] - 1) < 0.03 and abs(a[5] - 0.5) < 0.01
    assert s.repartition(9).agg(F.sum("u")).first()[0] == pytest.approx(s.agg(F.sum("u")).first()[0])


def test_ranks_and_sums_within_groups_of_any_size(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["a", "b", None]) if i % 3 else "a", rng.random(), i % 7) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, x double, v long").repartition(7)
    got = ranks.ranked_by(df, ["g"], ["x"], {"upto": "v"}).collect()
    assert len(got) == len(rows)
    for g in ("a", "b", None):
        own = sorted((x, v) for k, x, v in rows if k == g)
        want, total = {}, 0
        for i, (x, v) in enumerate(own, 1):
            total += v
            want[x] = (i, total)
        assert {r["x"]: (r["rank"], r["upto"]) for r in got if r["g"] == g} == want
    assert ranks.ranked_by(df.limit(0), ["g"], ["x"]).count() == 0


def test_last_values_are_carried_over_partitions(spark):
    rng = random.Random(7)
    rows = [(rng.choice(["a", "b", None]), i, rng.randrange(100) if rng.random() < 0.02 else None) for i in range(2000)]
    got = {(r["g"], r["t"]): r["seen"] for r in ranks.last_seen(spark.createDataFrame(rows, "g string, t long, v long").repartition(5), ["g"], ["t"], "v", "seen").collect()}
    last = {}
    for g, t, v in rows:
        last[g] = v if v is not None else last.get(g)
        assert got[g, t] == last[g]


def test_isotonic_fits_of_one_group_over_many_partitions(spark):
    import numpy as np
    from pyspark.sql import functions as F

    from tallyloom.operators import validation

    rng = np.random.default_rng(8)
    n = 4000
    x = np.arange(n) / n
    for name, y in {"rising": x + 0.3 * rng.normal(size=n), "falling": 1 - x + 0.01 * rng.normal(size=n), "wave": np.sin(9 * x), "steps": np.floor(20 * x) + 0.0, "bent": np.abs(x - 0.5)}.items():
        df = spark.createDataFrame([(None if i % 2 else "a", float(v), float(w)) for i, (v, w) in enumerate(zip(x, y))], "g string, p double, y double")
        for at_once in (90, 10**6) if name == "wave" else (90,):
            got = {(r["g"], r["score"]): r["fitted"] for r in validation.isotonic(df, "g", "p", "y", at_once).collect()}
            assert len(got) == n
            for odd, g in ((0, "a"), (1, None)):
                own = y[odd::2]
                # slopes of the greatest convex line below the running sums
                total, hull = np.concatenate([[0.0], np.cumsum(own)]), [0]
                for k in range(1, len(total)):
                    while len(hull) > 1 and (total[hull[-1]] - total[hull[-2]]) * (k - hull[-1]) >= (total[k] - total[hull[-1]]) * (hull[-1] - hull[-2]):
                        hull.pop()
                    hull.append(k)
                want = np.concatenate([np.full(b - a, (total[b] - total[a]) / (b - a)) for a, b in zip(hull, hull[1:])])
                assert np.allclose([got[g, float(v)] for v in x[odd::2]], want, atol=1e-9), (name, at_once)
    left = spark.createDataFrame([("a", None, 1.0), ("a", float("nan"), 1.0), ("a", 0.5, None), ("a", 0.25, 2.0)], "g string, p double, y double")
    assert [tuple(r) for r in validation.isotonic(left, "g", "p", "y").collect()] == [("a", 0.25, 1, 2.0)]
    assert validation.isotonic(left.filter(F.lit(False)), "g", "p", "y").count() == 0
