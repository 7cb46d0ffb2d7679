"""Queries of the cleaning operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions.hashing import stable_share
from tallyloom.operators import cleaning as C

from .base import DAILY, DAILY_P, MONTHLY, RETURNS, SCORED, daily, daily_by_priority, monthly, r, returns, scored, table
from .registry import query

_ODD = """CASE o_orderkey % 7 WHEN 0 THEN '(' || CAST(o_custkey AS VARCHAR) || '.5)' WHEN 1 THEN ' 1,' || CAST(100 + o_custkey % 900 AS VARCHAR) || ' ' WHEN 2 THEN '--' WHEN 3 THEN 'N/A' WHEN 4 THEN 'x' || o_orderstatus ELSE CAST(o_custkey AS VARCHAR) END"""


@query(f"""SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN -(o_custkey + 0.5) WHEN 1 THEN 1000 + 100 + o_custkey % 900 WHEN 2 THEN NULL WHEN 3 THEN NULL WHEN 4 THEN NULL ELSE o_custkey END::DOUBLE AS number FROM orders""")
def number_cleaning(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", C.to_number(F.expr(_ODD.replace("VARCHAR", "STRING"))).alias("number"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS day FROM orders""")
def date_cleaning(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    shown = F.when(F.col("o_orderkey") % 4 == 0, F.date_format("o_orderdate", "yyyy.MM.dd")).when(F.col("o_orderkey") % 4 == 1, F.date_format("o_orderdate", "yyyyMMdd")).when(F.col("o_orderkey") % 4 == 2, F.date_format("o_orderdate", "yyyy/MM/dd")).otherwise("soon")
    return o.select("o_orderkey", C.to_dates(shown).alias("day"))


@query("""SELECT CAST(o_orderdate AS DATE) AS date, arg_max(o_totalprice, o_orderkey) AS price, arg_max(o_custkey::DOUBLE, o_orderkey) AS cust FROM orders GROUP BY 1""")
def tidy_last_wins(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyyMMdd").alias("d"), F.col("o_totalprice").alias("price"), F.col("o_custkey").alias("cust"), "o_orderkey")
    return C.tidy(o, "d", ["price", "cust"], "o_orderkey")


@query(f"""WITH {DAILY_P} SELECT coalesce(a.date, b.date) AS date, a.value AS high, b.value AS low FROM (SELECT * FROM dp WHERE series = '2-HIGH') a FULL JOIN (SELECT * FROM dp WHERE series = '5-LOW') b ON a.date = b.date""")
def merge_two_sources(spark, sf_dir):
    d = daily_by_priority(spark, sf_dir)
    return C.merge_sources([("high", d.filter("series = '2-HIGH'").drop("series")), ("low", d.filter("series = '5-LOW'").drop("series"))])


@query(f"WITH {RETURNS} SELECT series, date, round(ret, 6) AS ret FROM rets")
def log_return_series(spark, sf_dir):
    return returns(spark, sf_dir).select("series", "date", r("ret").alias("ret"))


@query(f"WITH {RETURNS} SELECT series, date, round(100 * (exp(ret / 100 + 0.05 / 252) - 1), 6) AS simple FROM rets")
def simple_return_series(spark, sf_dir):
    return returns(spark, sf_dir).select("series", "date", r(C.simple_from_log(F.col("ret"), 0.05)).alias("simple"))


@query(f"""WITH {RETURNS}, m AS (SELECT series, ret, date, avg(ret) OVER (PARTITION BY series) AS m FROM rets),
g AS (SELECT series, count(*) AS n, min(date) AS first, max(date) AS last, avg(ret) AS mean, stddev_samp(ret) AS sd, avg((ret - m) ** 3) AS m3, avg((ret - m) ** 4) AS m4,
 quantile_cont(abs(ret), 0.5) AS a, quantile_cont(abs(ret), 0.9) AS b, quantile_cont(abs(ret), 0.99) AS c FROM m GROUP BY series)
SELECT series, n, first, last, round(mean, 6) AS mean, round(sd, 6) AS sd, round(sd * sqrt(252), 6) AS sd_annual, round(m3 / sd ** 3, 6) AS skew, round(m4 / sd ** 4 - 3, 6) AS kurtosis,
 CASE WHEN round(n * 0.5) >= 10 THEN round(a, 6) END AS q5, CASE WHEN round(n * 0.1) >= 10 THEN round(b, 6) END AS q9, CASE WHEN round(n * 0.01) >= 10 THEN round(c, 6) END AS q99 FROM g""")
def publishable_statistics(spark, sf_dir):
    p = C.publishable(returns(spark, sf_dir), "series", "date", "ret")
    return p.select("series", "n", "first", "last", *[r(c).alias(c) for c in ("mean", "sd", "sd_annual", "skew", "kurtosis", "q5", "q9", "q99")])


@query(f"""WITH {DAILY_P}, d AS (SELECT series, date, value - 2 * lag(value, 1) OVER w + lag(value, 2) OVER w AS diff FROM dp WINDOW w AS (PARTITION BY series ORDER BY date)) SELECT series, date, round(diff, 2) AS diff FROM d WHERE diff IS NOT NULL""")
def second_differences(spark, sf_dir):
    return C.difference(daily_by_priority(spark, sf_dir), "series", "date", "value", 2).select("series", "date", r("diff", 2).alias("diff"))


@query(f"""WITH {MONTHLY} SELECT * FROM (SELECT series, date, value AS y, lag(value, 1) OVER w AS x1, lag(value, 2) OVER w AS x2, lag(value, 3) OVER w AS x3 FROM monthly WINDOW w AS (PARTITION BY series ORDER BY date)) WHERE x3 IS NOT NULL""")
def lag_design_matrix(spark, sf_dir):
    return C.lag_design(monthly(spark, sf_dir), "series", "date", "value", 3)


@query(f"""WITH {MONTHLY}, f AS (SELECT max(a) AS at FROM (SELECT series, min(date) AS a FROM monthly GROUP BY 1)), b AS (SELECT series, value AS base FROM monthly, f WHERE date = f.at)
SELECT series, date, round(value / base * 100, 6) AS indexed FROM monthly JOIN b USING (series)""")
def rebased_to_100(spark, sf_dir):
    return C.rebased(monthly(spark, sf_dir), "series", "date", "value").select("series", "date", r("indexed").alias("indexed"))


_SPARSE = "sparse AS (SELECT o_custkey AS series, CAST(date_trunc('month', o_orderdate) AS DATE) AS date, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1, 2)"


def _sparse(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_custkey").alias("series"), F.to_date(F.date_trunc("month", "o_orderdate")).alias("date")).agg(F.round(F.sum("o_totalprice"), 2).alias("value"))


_GRID = _SPARSE + ", grid AS (SELECT series, CAST(unnest(generate_series(a, b, INTERVAL 1 MONTH)) AS DATE) AS date FROM (SELECT series, min(date) AS a, max(date) AS b FROM sparse GROUP BY 1))"


@query(f"WITH {_GRID} SELECT series, date, value FROM grid LEFT JOIN sparse USING (series, date)")
def calendar_grid(spark, sf_dir):
    return C.on_month_grid(_sparse(spark, sf_dir), "series", "date", "value")


@query(f"WITH {_GRID} SELECT series, date FROM grid ANTI JOIN sparse USING (series, date)")
def calendar_gaps(spark, sf_dir):
    return C.month_gaps(_sparse(spark, sf_dir), "series", "date")


@query(f"""WITH {_GRID}, n AS (SELECT g.series, g.date, value, row_number() OVER w - count(value) OVER (PARTITION BY g.series ORDER BY g.date ROWS UNBOUNDED PRECEDING) AS k FROM grid g LEFT JOIN sparse s ON g.series = s.series AND g.date = s.date WINDOW w AS (PARTITION BY g.series ORDER BY g.date))
SELECT series, min(date) AS first, max(date) AS last, count(*) AS length FROM n WHERE value IS NOT NULL GROUP BY series, k HAVING count(*) >= 2""")
def contiguous_runs(spark, sf_dir):
    return C.runs(C.on_month_grid(_sparse(spark, sf_dir), "series", "date", "value"), "series", "date", "value", 2)


@query(f"""WITH {_GRID}, n AS (SELECT g.series, g.date, value, row_number() OVER w - count(value) OVER (PARTITION BY g.series ORDER BY g.date ROWS UNBOUNDED PRECEDING) AS k FROM grid g LEFT JOIN sparse s ON g.series = s.series AND g.date = s.date WINDOW w AS (PARTITION BY g.series ORDER BY g.date)),
t AS (SELECT series, min(date) AS first, count(*) AS length FROM n WHERE value IS NOT NULL GROUP BY series, k) SELECT series, first, length FROM t QUALIFY row_number() OVER (PARTITION BY series ORDER BY length DESC, first) = 1""")
def longest_run(spark, sf_dir):
    t = C.runs(C.on_month_grid(_sparse(spark, sf_dir), "series", "date", "value"), "series", "date", "value")
    best = F.max_by(F.struct("first", "length"), F.struct("length", -F.unix_date("first")))
    return t.groupBy("series").agg(best.alias("b")).select("series", "b.first", "b.length")


@query(f"WITH {DAILY} SELECT CAST(floor(year(date) / 10) * 10 AS INTEGER) AS decade, count(*) AS n, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS sd FROM daily GROUP BY 1 HAVING count(*) >= 30")
def decade_buckets(spark, sf_dir):
    return C.by_decade(daily(spark, sf_dir), "date", "value", 30).select("decade", "n", r("mean", 4).alias("mean"), r("sd", 4).alias("sd"))


@query(f"WITH {DAILY} SELECT date BETWEEN DATE '1996-03-01' AND DATE '1996-09-30' OR date BETWEEN DATE '1999-01-01' AND DATE '1999-12-31' AS inside, count(*) AS n, round(sum(value), 2) AS total FROM daily GROUP BY 1")
def window_mask(spark, sf_dir):
    d = daily(spark, sf_dir).withColumn("inside", C.in_windows(F.col("date"), [("1996-03-01", "1996-09-30"), ("1999-01-01", "1999-12-31")]))
    return d.groupBy("inside").agg(F.count("*").alias("n"), r(F.sum("value"), 2).alias("total"))


@query(f"WITH {RETURNS}, c AS (SELECT series, quantile_cont(abs(ret), 0.9) AS cut FROM rets GROUP BY 1) SELECT series, date, abs(ret) >= cut AS turbulent FROM rets JOIN c USING (series)")
def turbulent_days(spark, sf_dir):
    return C.turbulent(returns(spark, sf_dir), "ret", 0.9, "series").select("series", "date", "turbulent")


@query("SELECT text, min(doc_id) AS doc_id FROM documents GROUP BY text")
def first_of_duplicates(spark, sf_dir):
    return C.first_of_text(table(spark, sf_dir, "documents").select("text", "doc_id"), "text", "doc_id")


@query("SELECT o_orderkey, round(('0x' || substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0, 12) AS share, CASE WHEN o_orderstatus = 'P' THEN 'test' WHEN ('0x' || substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0 < 0.8 THEN 'train' ELSE 'test' END AS part FROM orders")
def hash_split(spark, sf_dir):
    share = stable_share(F.col("o_orderkey").cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", r(share, 12).alias("share"), F.when(F.col("o_orderstatus") == "P", "test").when(share < 0.8, "train").otherwise("test").alias("part"))


@query(f"""WITH {SCORED}, a AS (SELECT id, [p, (1 - p) * 0.7, (1 - p) * 0.3] AS v FROM scored), t AS (SELECT id, list_transform(v, lambda x: x ** 0.5) AS e FROM a)
SELECT id, round(e[1] / list_sum(e), 6) AS p1, round(e[2] / list_sum(e), 6) AS p2, round(e[3] / list_sum(e), 6) AS p3 FROM t""")
def temperature_scaling(spark, sf_dir):
    p = F.array(F.col("p"), (1 - F.col("p")) * 0.7, (1 - F.col("p")) * 0.3)
    t = scored(spark, sf_dir).select("id", C.softmax_temperature(p, 2.0).alias("t"))
    return t.select("id", *[r(F.get("t", F.lit(i))).alias(f"p{i + 1}") for i in range(3)])


@query(f"""WITH {SCORED}, a AS (SELECT id, [p, (1 - p) * 0.7, (1 - p) * 0.3] AS v FROM scored)
SELECT id, round(list_max(v), 6) AS confidence, round(-list_sum(list_transform(v, lambda x: x * ln(greatest(x, 1e-12)))), 6) AS entropy,
 round(ln(list_reverse_sort(v)[1]) - ln(list_reverse_sort(v)[2]), 6) AS margin FROM a""")
def confidence_entropy_margin(spark, sf_dir):
    p = F.array(F.col("p"), (1 - F.col("p")) * 0.7, (1 - F.col("p")) * 0.3)
    return scored(spark, sf_dir).select("id", r(F.array_max(p)).alias("confidence"), r(C.entropy(p)).alias("entropy"), r(C.margin(p)).alias("margin"))


@query(f"WITH {SCORED} SELECT id, round(o / (1 + o), 6) AS corrected FROM (SELECT id, p / greatest(1 - p, 1e-12) * (0.1 / 0.9) / (0.5 / 0.5) AS o FROM scored)")
def prior_correction(spark, sf_dir):
    return scored(spark, sf_dir).select("id", r(C.prior_correct(F.col("p"), 0.5, 0.1)).alias("corrected"))
