"""Operators that SQL can't express, and edge cases, against plain numpy and Python."""

import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.functions.storage import fresh_dir
from tallyloom.operators import cleaning, conformal, distribution, learning, linear, resample, scoring, sequence
from tallyloom.sources import landed
from tallyloom.streaming import sequential


def test_log_returns_refuse_levels_of_zero(spark):
    df = spark.createDataFrame([("a", 1, 10.0), ("a", 2, 0.0)], "s string, t int, v double")
    with pytest.raises(Exception, match="0 or less"):
        cleaning.log_returns(df, "s", "t", "v").collect()


def test_irls_is_the_maximum_of_the_likelihood(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 2))
    y = (rng.random(400) < 1 / (1 + np.exp(-(0.3 + x @ [1.0, -0.5])))).astype(float)
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)], "a double, b double, y double")
    got = linear.irls(df, ["a", "b"], "y")
    beta = np.array([g["beta"] for g in got])
    design = np.column_stack([np.ones(400), x])
    p = 1 / (1 + np.exp(-design @ beta))
    assert np.allclose(design.T @ (y - p), 0, atol=1e-6)
    assert np.allclose([g["se"] for g in got], np.sqrt(np.diag(np.linalg.inv(design.T @ (design * (p * (1 - p))[:, None])))), rtol=1e-6)


def test_ols_by_group_and_singular_designs(spark):
    rng = np.random.default_rng(2)
    rows = [("a", *map(float, r)) for r in rng.normal(size=(50, 3))] + [("b", 1.0, 2.0, float(i)) for i in range(5)]
    got = {(r["g"], r["term"]): r for r in linear.ols(spark.createDataFrame(rows, "g string, x double, z double, y double"), "g", ["x", "z"], "y").collect()}
    m = np.array([r[1:] for r in rows if r[0] == "a"])
    design = np.column_stack([np.ones(50), m[:, :2]])
    beta, rss, *_ = np.linalg.lstsq(design, m[:, 2], rcond=None)
    se = np.sqrt(np.diag(np.linalg.inv(design.T @ design)) * rss[0] / 47)
    for i, t in enumerate(["(intercept)", "x", "z"]):
        assert got["a", t]["beta"] == pytest.approx(beta[i]) and got["a", t]["se"] == pytest.approx(se[i])
        assert got["b", t]["beta"] is None


@pytest.mark.parametrize("bend", [False, True])
def test_break_scan_equals_a_regression_at_each_date(spark, bend):
    rng = np.random.default_rng(3)
    y = rng.normal(size=40).cumsum()
    got = {r["tau"]: r for r in linear.break_scan(spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(y)], "s string, t int, y double"), "s", "t", "y", bend=bend).collect()}
    assert set(got) == set(range(6, 34))
    i = np.arange(40)
    for tau, r in got.items():
        z = np.maximum(i - tau, 0) if bend else (i >= tau)
        design = np.column_stack([np.ones(40), i, z]).astype(float)
        beta, rss, *_ = np.linalg.lstsq(design, y, rcond=None)
        se = math.sqrt(np.linalg.inv(design.T @ design)[2, 2] * rss[0] / 37)
        assert r["coef"] == pytest.approx(beta[2]) and r["ssr"] == pytest.approx(rss[0]) and r["t"] == pytest.approx(beta[2] / se)


def test_psd_repair_of_an_impossible_matrix(spark):
    rng = np.random.default_rng(4)
    a = rng.normal(size=60)
    rows = [("g", float(v), float(v), None) for v in a[:20]] + [("g", None, float(v), float(v)) for v in a[20:40]] + [("g", float(v), None, float(-v)) for v in a[40:]]
    got = linear.psd_repair(spark.createDataFrame(rows, "g string, x double, y double, z double"), "g", ["x", "y", "z"]).first()
    assert got["least"] < -0.9 and got["is_psd"] is False and got["change"] > 0.1


def test_cox_solves_its_score(spark):
    rng = random.Random(5)
    rows = [(float(rng.randrange(1, 30)), rng.random() < 0.7, i % 2) for i in range(200)]
    got = learning.cox_two_arm(spark.createDataFrame(rows, "t double, e boolean, arm int"), "t", "e", "arm")
    score = 0.0
    for t in {r[0] for r in rows if r[1]}:
        d = [r for r in rows if r[0] == t and r[1]]
        r1, r0 = (sum(r[0] >= t and r[2] == a for r in rows) for a in (1, 0))
        score += sum(r[2] for r in d) - len(d) * r1 * math.exp(got["beta"]) / (r0 + r1 * math.exp(got["beta"]))
    assert abs(score) < 1e-6 and got["se"] > 0


def test_money_weighted_return_balances_flows(spark):
    flows = [("a", 0, 100.0, 150.0), ("a", 100, 20.0, 150.0), ("a", 252, -10.0, 150.0), ("b", 0, -5.0, 9.0)]
    got = {r["k"]: r["rate"] for r in learning.money_weighted(spark.createDataFrame(flows, "k string, t int, v double, f double"), "k", "t", "v", "f").collect()}
    assert sum(v * (1 + got["a"]) ** ((252 - t) / 252) for k, t, v, _ in flows if k == "a") == pytest.approx(150, abs=1e-6)
    assert got["b"] is None


def test_money_weighted_returns_of_many_accounts_are_found_in_batches(spark):
    flows = spark.range(600).selectExpr("id % 200 as k", "cast(id div 200 * 126 as int) as t", "100D + id % 7 as v", "cast(310 + id % 200 as double) as f")
    found = learning.money_weighted(flows, "k", "t", "v", "f")
    assert "InPandas" not in found._jdf.queryExecution().toString()  # no pandas table an account
    got = {r["k"]: r["rate"] for r in found.collect()}
    own = {}
    for r in flows.collect():
        own.setdefault(r["k"], []).append(r)
    assert len(got) == 200 and all(sum(r["v"] * (1 + got[k]) ** ((252 - r["t"]) / 252) for r in rows) == pytest.approx(rows[0]["f"], abs=1e-5) for k, rows in own.items())


def test_holt_flags_short_series(spark):
    rows = [("long", i, 10.0 + 2 * i) for i in range(40)] + [("short", i, float(i)) for i in range(4)]
    got = sequence.holt(spark.createDataFrame(rows, "s string, t int, v double"), "s", "t", "v", 3, [0.5]).collect()
    assert all(r["fallback"] == (r["s"] == "short") for r in got)
    assert [r["forecast"] for r in got if r["s"] == "short"] == [3.0] * 3
    ahead = {r["step"]: r["forecast"] for r in got if r["s"] == "long"}
    assert all(abs(ahead[s] - (90 + 2 * s)) < 3 for s in range(3))


def test_matched_absence_places_spells_without_overlap(spark):
    got = sequence.matched_absence(spark.createDataFrame([("a", 100, [10, 5, 5, 3])], "s string, n long, lengths array<long>"), "s", "seed").collect()
    assert sorted(r["length"] for r in got) == [3, 5, 5, 10]
    days = [d for r in got for d in range(r["first"], r["first"] + r["length"])]
    assert len(days) == len(set(days)) and 0 <= min(days) and max(days) < 100


def test_conformal_quantile_is_infinite_with_too_few_scores(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(5)] + [("b", float(i)) for i in range(1, 20)] + [("b", None), ("b", float("inf"))], "g string, s double")
    got = {r["g"]: r["q"] for r in conformal.quantile(df, "g", F.col("s"), 0.1).collect()}
    assert got == {"a": float("inf"), "b": 18.0}
    assert {r["g"]: r["q"] for r in conformal.quantile(df, "g", F.col("s"), 0.1, clip=True).collect()}["a"] == 4.0


def test_scores_do_not_depend_on_partitions(spark):
    rng = random.Random(6)
    rows = [("g", round(rng.random(), 1), rng.randrange(2)) for _ in range(300)]
    df = spark.createDataFrame(rows, "g string, p double, y int")
    pos, neg = [p for _, p, y in rows if y], [p for _, p, y in rows if not y]
    auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg)
    for n in (1, 7):
        assert scoring.ranking_scores(df.repartition(n), "g", "p", "y").first()["auc"] == pytest.approx(auc)


def test_bins_hold_their_upper_edges(spark):
    edges = spark.range(16).select((F.col("id") / 15.0).alias("c")).select(scoring.bin_closed_above(F.col("c"), 15).alias("a"), scoring.bin_closed_below(F.col("c"), 15).alias("b")).collect()
    assert [r["a"] for r in edges] == [1, *range(1, 16)]
    assert edges[-1]["b"] == 14


def test_gini_of_equal_and_of_single_holders(spark):
    assert distribution.gini(spark.createDataFrame([(5.0,)] * 10, "x double"), "x").first()["gini"] == pytest.approx(0)
    assert distribution.gini(spark.createDataFrame([(0.0,)] * 9 + [(5.0,)], "x double"), "x").first()["gini"] == pytest.approx(0.9)


def test_poisson_counts_have_mean_and_variance_one(spark):
    from tallyloom.functions.hashing import md5_share

    w = spark.range(20_000).select(resample.poisson(md5_share(F.col("id").cast("string"))).alias("w")).agg(F.avg("w"), F.var_samp("w")).first()
    assert abs(w[0] - 1) < 0.03 and abs(w[1] - 1) < 0.05


def test_neighbours_equal_brute_force(spark):
    rng = np.random.default_rng(7)
    v = rng.normal(size=(120, 5))
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "id long, vec array<double>").repartition(4)
    got = {(r["query"], r["rank"]): r["id"] for r in learning.neighbours(df.filter("id < 6"), df, 3, at_once=4).collect()}
    for q in range(6):
        order = [i for i in np.argsort(np.linalg.norm(v - v[q], axis=1)) if i != q][:3]
        assert [got[q, k + 1] for k in range(3)] == order


def test_readers_refuse_what_is_wrong(spark, tmp_path):
    (tmp_path / "pipe.txt").write_text("a|b|c\na|b\n")
    with pytest.raises(ValueError, match="fields"):
        landed.pipe_table(spark, f"file://{tmp_path}/pipe.txt", ["x", "y", "z"])
    (tmp_path / "sdmx.csv").write_text("A,TIME_PERIOD\n1,2020-Q1\n")
    with pytest.raises(ValueError, match="OBS_VALUE"):
        landed.sdmx_csv(spark, f"file://{tmp_path}/sdmx.csv")
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "1.json").write_text('[{"page":1,"pages":2},[{"indicator":{"id":"i","value":"v"},"country":{"id":"c","value":"C"},"countryiso3code":"CCC","date":"2000","value":null}]]')
    with pytest.raises(ValueError, match="1 of 2"):
        landed.paged_json(spark, f"file://{tmp_path}/p")
    (tmp_path / "p" / "1.json").write_text('[{"message":"no such thing"}]')
    with pytest.raises(ValueError, match="no rows"):
        landed.paged_json(spark, f"file://{tmp_path}/p")
    (tmp_path / "prices.csv").write_text("date,close\n2020/01/02,\"1,234.56\"\n")
    with pytest.raises(ValueError, match="least"):
        landed.price_file(spark, f"file://{tmp_path}/prices.csv")
    assert landed.price_file(spark, f"file://{tmp_path}/prices.csv", min_rows=1).first()["close"] == 1234.56
    with pytest.raises(ValueError, match="terms"):
        landed.quotes(spark, f"file://{tmp_path}/prices.csv", accept_terms=False)
    with pytest.raises(ValueError, match="metadata"):
        landed.years_to_long(spark.createDataFrame([("A", "1")], "iso3 string, `2000` string"), ["iso3"])


def test_zipped_csv_and_changed_vintages(spark, tmp_path):
    import zipfile

    for name, rows in (("a.zip", "x,y\n1,2\n,3\n"), ("b.zip", "x,y\n4,5\n")):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            z.writestr("data.csv", "preamble\n" + rows)
            z.writestr("notes.txt", "no")
    got = landed.zipped_csv(spark, f"file://{tmp_path}/*.zip", "x int, y double", skip=1).collect()
    assert sorted((str(r["x"]), r["y"]) for r in got) == [("1", 2.0), ("4", 5.0), ("None", 3.0)]
    before = spark.createDataFrame(landed.manifest(spark, f"file://{tmp_path}/*.zip").collect())
    (tmp_path / "b.zip").write_bytes(b"other")
    assert [r["file"] for r in landed.changed(before, landed.manifest(spark, f"file://{tmp_path}/*.zip")).collect()] == ["b.zip"]


def test_the_largest_member_stands_in_for_a_name_that_changed(spark, tmp_path):
    import zipfile

    def pack(name, members):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            for k, v in members.items():
                z.writestr(k, v)

    pack("a.zip", {"x/API_1.csv": "note\nv\n1\n", "x/big.csv": "note\nv\n" + "9\n" * 99})
    pack("b.zip", {"METADATA_all.csv": "note\nv\n" + "8\n" * 99, "z.csv": "note\nv\n7\n", "y.csv": "note\nv\n2\n3\n", "y.txt": "9" * 999})
    read = lambda f: [r["v"] for r in landed.zipped_csv(spark, f"file://{tmp_path}/{f}", "v int", r"API_.*\.csv$", 1, largest=True).collect()]
    assert read("a.zip") == [1] and read("b.zip") == [2, 3]
    pack("c.zip", {"metadata.csv": "v\n1\n"})
    with pytest.raises(Exception, match="no table"):
        read("c.zip")
    named = spark.createDataFrame([(None, "b"), ("c", "a")], "`Indicator Name` string, indicator string")
    assert landed.indicator_name(named) == "c" and landed.indicator_name(named.filter("indicator = 'b'")) == "b" and landed.indicator_name(named.select(F.lit(1).alias("x"))) == "unknown indicator"


def test_months_of_a_matrix_and_peaks_by_place(spark):
    m = spark.createDataFrame([(2020, "1,200.5", "0", "-"), (2021, None, "3", "")], "year int, `1M` string, `2M` string, `12M` string")
    assert sorted((str(r["date"]), r["value"]) for r in landed.month_matrix(m, "year").collect()) == [("2020-01-01", 1200.5), ("2021-02-01", 3.0)]
    for columns in (["year", "13M"], ["y", "1M"], ["year", "a"]):
        with pytest.raises(ValueError):
            landed.month_matrix(spark.createDataFrame([(2020, "1")], columns), "year")
    with pytest.raises(ValueError):
        landed.month_matrix(spark.createDataFrame([(2020, "1", "2")], ["year", "1M", "01M"]), "year")
    p = spark.createDataFrame([("2020", "1", "1,000"), ("2021", "8", "2,000"), ("2022", "2", "-")], "a string, b string, c string")
    got = landed.peak_table(p, ["year", "month", "peak"], "year", "month", "peak", []).collect()
    assert [(r["year"], r["peak"], r["winter_peak"]) for r in got] == [(2020, 1000.0, True), (2021, 2000.0, False)]
    with pytest.raises(ValueError):
        landed.peak_table(p, ["year"], "year", "month", "peak", [])


def test_streams_equal_their_recursions(spark):
    rng = random.Random(8)
    start = datetime(2024, 1, 1)
    rows = [(k, start + timedelta(minutes=3 * i + j), rng.gauss(0, 1)) for i in range(80) for j, k in enumerate("ab")]
    path = fresh_dir(spark, "stream")
    mixed = rows[:]
    rng.shuffle(mixed)
    spark.createDataFrame(mixed, "k string, ts timestamp, v double").repartition(3).write.parquet(path)
    stream = lambda: spark.readStream.schema("k string, ts timestamp, v double").parquet(path).withWatermark("ts", "0 seconds")
    got = {(r["k"], r["ts"]): r["scale"] for r in sequential.result(spark, sequential.online_ewma(stream(), "k", "ts", "v"), "e").collect()}
    bands = {(r["k"], r["ts"]): r for r in sequential.result(spark, sequential.adaptive_conformal(stream().withColumn("p", F.lit(0.0)), "k", "ts", "p", "v", window=30), "c").collect()}
    for k in "ab":
        own = [(t, v) for a, t, v in rows if a == k]
        var = float(np.var([v for _, v in own[:20]], ddof=1))
        level, scores = 0.1, []
        for i, (t, v) in enumerate(own[:-1]):  # the watermark doesn't pass the last row
            if i >= 20:
                assert got[k, t] == pytest.approx(var**0.5)
                var = 0.94 * var + 0.06 * v * v
            need = math.ceil((len(scores) + 1) * (1 - min(max(level, 1e-6), 1 - 1e-6)) - 1e-12)
            q = sorted(scores)[need - 1] if scores and need <= len(scores) else float("inf")
            assert bands[k, t]["upper"] == pytest.approx(q) and bands[k, t]["level"] == pytest.approx(level)
            level = min(1.0, max(0.0, level + 0.01 * (0.1 - (abs(v) > q))))
            scores = (scores + [abs(v)])[-30:]


def test_keys_of_a_stream_share_rows_of_state_and_may_be_null(spark, tmp_path):
    import datetime as dt

    noon = dt.datetime(2024, 1, 1, 12)
    rows = [(None if k == 7 else k * 10**15 + 1, noon + dt.timedelta(seconds=i), float(k + i)) for k in range(40) for i in range(5)]
    path, zone = str(tmp_path / "s"), spark.conf.get("spark.sql.session.timeZone")
    spark.createDataFrame(rows, "k long, ts timestamp, v double").repartition(3).write.parquet(path)
    stream = spark.readStream.schema("k long, ts timestamp, v double").parquet(path).withWatermark("ts", "0 seconds")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        q = sequential.online_ewma(stream, "k", "ts", "v", warmup=2, buckets=4).writeStream.format("memory").queryName("shared_state").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
        got = {(r["k"], r["t"]): r["scale"] for r in spark.table("shared_state").selectExpr("k", "unix_micros(ts) as t", "scale").collect()}
        assert 1 <= q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 4
        # of five rows of a key two warm up
        micros = sorted(r[0] for r in spark.read.parquet(path).selectExpr("unix_micros(ts)").distinct().collect())
        assert set(got) == {(k, t) for k in {r[0] for r in rows} for t in micros[2:]} and all(got[k, micros[2]] == pytest.approx(0.5**0.5) for k, _ in got)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_streams_hold_every_row_up_to_their_end(spark):
    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.001"
    events = spark.read.parquet(f"{sf}/events.parquet").filter("value is not null")
    rows = lambda name: entry.queries()[name](spark, sf)
    want = {r["d"]: r["n"] for r in events.groupBy(F.unix_micros(F.date_trunc("day", F.col("ts").cast("timestamp"))).alias("d")).agg(F.count("*").alias("n")).collect()}
    assert {r["start"]: r["n"] for r in rows("streaming_drift").collect()} == want
    assert rows("streaming_adaptive_conformal").count() == events.count()
    per_key = [r["n"] for r in events.groupBy("user_id").agg(F.count("*").alias("n")).collect()]
    assert rows("streaming_ewma").count() == sum(max(0, n - 20) for n in per_key)
