"""Audits of reported trials: what must hold of z, bounds and ratios, and what has no answer."""

import math

import numpy as np
from pyspark.sql import functions as F

from tallyloom.operators import trials as T


def test_z_and_bounds_are_those_of_tables(spark):
    df = spark.createDataFrame([(0.05, 0.6), (0.001, 1.0), (1.0, 0.0), (0.0, 1.5), (None, None)], "p double, t double")
    a = F.lit(0.05)
    got = df.select(T.z_for_p(F.col("p")).alias("z"), T.z_for_p(F.col("p"), False).alias("one"), T.obrien_fleming(F.col("t"), a).alias("f"), T.pocock(F.col("t"), a).alias("o"), T.z_for_level(1 - F.col("p")).alias("l")).collect()
    assert np.allclose([got[0]["z"], got[0]["one"], got[1]["z"]], [1.959964, 1.644854, 3.290527], atol=1e-5)
    assert math.isclose(got[0]["f"], 2.5303, abs_tol=1e-3) and math.isclose(got[1]["f"], got[1]["o"], abs_tol=1e-9) and math.isclose(got[1]["o"], 1.959964, abs_tol=1e-5)
    assert got[0]["o"] < got[0]["f"] and math.isclose(got[0]["l"], got[0]["z"], abs_tol=1e-9)
    assert all(v is None for r in got[2:] for v in r.asDict().values())


def test_detectable_ratios_are_fixed_points(spark):
    df = spark.createDataFrame([(200.0, 2.5), (50.0, 1.96), (0.0, 2.0), (10.0, -1.0)], "d double, z double")
    got = [r["h"] for r in df.select(T.detectable(F.col("d"), F.col("z")).alias("h")).collect()]
    for (d, z), h in zip([(200.0, 2.5), (50.0, 1.96)], got):
        s = h / (h + 1)
        assert math.isclose(h, math.exp(-z / math.sqrt(d * s * (1 - s))), rel_tol=1e-6)
    assert got[2:] == [None, None]


def test_audits_undo_what_a_design_prints(spark):
    # z of 200 events at a ratio of 0.7, and back
    s = 0.7 / 1.7
    z = abs(math.log(0.7)) * math.sqrt(200 * s * (1 - s))
    p = math.erfc(z / math.sqrt(2))
    rows = [("a", 0.7, p, 200.0, 0.6), ("b", 1.0, 0.5, 100.0, 0.5), ("c", -1.0, 0.5, 0.0, None), (None, None, None, None, None)]
    got = {r["k"]: r for r in T.interim_audit(spark.createDataFrame(rows, "k string, hr double, p double, d double, t double"), ["k"], "hr", "p", "d", "t").collect()}
    a = got["a"]
    assert math.isclose(a["events_from_p"], 200, rel_tol=1e-9) and math.isclose(a["z"], z, rel_tol=1e-9) and a["crossed"] is (z >= a["obrien_fleming"])
    assert math.isclose(a["required"], (1.959964 + 1.281552) ** 2 / (0.25 * math.log(0.7) ** 2), rel_tol=1e-5)
    assert math.isclose(math.log(a["high"] / a["low"]), 2 * 1.959964 / math.sqrt(200 * s * (1 - s)), rel_tol=1e-6)
    assert got["b"]["events_from_p"] is None and got["b"]["required"] is None and got["c"]["low"] is None and got[None]["z"] is None
    results = spark.createDataFrame([("a", 0.02, 0.4, 0.01, 10.0, 0.2), ("b", 0.0, 0.4, 0.5, 1.0, 0.0), ("c", 0.1, 0.0, 2.0, 1.0, 0.0)], "k string, e double, s double, p double, n double, rho double")
    r = {x["k"]: x for x in T.result_audit_by_p(results, ["k"], "e", "s", "p", "n", "rho", 252.0).collect()}
    assert math.isclose(r["a"]["implied_n"], (2.5758293 / 0.05) ** 2, rel_tol=1e-6) and math.isclose(r["a"]["independent"], 10 / 2.8) and math.isclose(r["a"]["annual_ratio"], 0.05 * math.sqrt(10 / 2.8 * 252))
    assert r["b"]["implied_n"] is None and r["c"]["implied_n"] is None and r["c"]["annual_ratio"] is None
