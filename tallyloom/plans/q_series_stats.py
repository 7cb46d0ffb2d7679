"""Queries of statistics of ordered series."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import series_stats as S

from .base import DAILY_P, MONTHLY, RETURNS, monthly, r, returns
from .registry import query

_PAIR = RETURNS + ", xy AS (SELECT a.date, 'all' AS g, a.ret AS x, b.ret AS y FROM rets a JOIN rets b ON a.date = b.date WHERE a.series = '1-URGENT' AND b.series = '5-LOW')"


def _xy(spark, sf_dir):
    m = returns(spark, sf_dir)
    x = m.filter("series = '1-URGENT'").select("date", F.col("ret").alias("x"))
    return x.join(m.filter("series = '5-LOW'").select("date", F.col("ret").alias("y")), "date").withColumn("g", F.lit("all"))


@query(f"""WITH {RETURNS}, d AS (SELECT series, ret AS r, lead(ret) OVER (PARTITION BY series ORDER BY date) AS n FROM rets), p AS (SELECT series, corr(r, n) AS a, corr(abs(r), abs(n)) AS b, corr(r, abs(n)) AS c FROM d GROUP BY 1)
SELECT (SELECT round(stddev_pop(ret), 6) FROM rets) AS sd, (SELECT round(kurtosis_pop(ret), 6) FROM rets) AS kurtosis, round(avg(a), 6) AS autocorrelation, round(stddev_samp(a) / sqrt(count(a)), 6) AS autocorrelation_se,
 round(avg(b), 6) AS clustering, round(stddev_samp(b) / sqrt(count(b)), 6) AS clustering_se, round(avg(c), 6) AS asymmetry, round(stddev_samp(c) / sqrt(count(c)), 6) AS asymmetry_se FROM p""")
def stylised_facts(spark, sf_dir):
    s = S.stylised_facts(returns(spark, sf_dir), "series", "date", "ret")
    return s.select(*[r(c).alias(c) for c in s.columns])


_ACF = f"""{RETURNS}, c AS (SELECT series, date, ret - avg(ret) OVER (PARTITION BY series) AS c FROM rets), l AS (SELECT series, k AS lag, c, lag(c, k) OVER (PARTITION BY series, k ORDER BY date) AS b FROM c, range(1, 11) t(k)), acf AS (SELECT series, lag, sum(c * b) / sum(c * c) AS rho FROM l GROUP BY 1, 2)"""


@query(f"WITH {_ACF} SELECT series, lag::INT AS lag, round(rho, 6) AS rho FROM acf")
def autocorrelation(spark, sf_dir):
    return S.autocorrelation(returns(spark, sf_dir), "series", "date", "ret", 10).select("series", "lag", r("rho").alias("rho"))


@query(f"WITH {_ACF}, v AS (SELECT series, 1 + 2 * sum((1 - lag / 11) * rho) AS v FROM acf GROUP BY 1) SELECT series, round(v, 6) AS inflation, round(CASE WHEN v > 0 THEN n / v END, 4) AS effective_n FROM v JOIN (SELECT series, count(*) AS n FROM rets GROUP BY 1) USING (series)")
def effective_series_length(spark, sf_dir):
    m = returns(spark, sf_dir)
    e = S.effective_n(S.autocorrelation(m, "series", "date", "ret", 10), m.groupBy("series").agg(F.count("*").alias("n")), "series", 10)
    return e.select("series", r("inflation").alias("inflation"), r("effective_n", 4).alias("effective_n"))


@query(f"""WITH {_PAIR}, q AS (SELECT quantile_cont(abs(x), [0.5, 0.8, 0.9]) AS c FROM xy), d AS (SELECT q, x, y, abs(x) >= cut AS t FROM xy, (SELECT unnest([0.5, 0.8, 0.9])::DOUBLE AS q, unnest(c) AS cut FROM q)),
g AS (SELECT q, count(*) FILTER (t) AS n, corr(x, y) FILTER (t) AS r, corr(x, y) FILTER (NOT t) AS r_calm, corr(x, y) AS a, var_samp(x) FILTER (t) / var_samp(x) AS v FROM d GROUP BY 1)
SELECT 'all' AS g, q, n, round(r, 6) AS r, round(r_calm, 6) AS r_calm, round(v, 6) AS ratio, round(a * sqrt(v) / sqrt(a * a * v + 1 - a * a), 6) AS predicted, round(r / sqrt(v - r * r * (v - 1)), 6) AS corrected FROM g""")
def conditional_correlation(spark, sf_dir):
    c = S.conditional_correlation(_xy(spark, sf_dir), "g", "x", "y", [0.5, 0.8, 0.9])
    return c.select("g", "q", "n", *[r(x).alias(x) for x in ("r", "r_calm", "ratio", "predicted", "corrected")])


@query(f"""WITH {_PAIR}, t AS (SELECT *, abs(x) >= 100 AS t FROM xy) SELECT 'all' AS g, round(ln(abs(covar_samp(x, y) FILTER (t)) / abs(covar_samp(x, y) FILTER (NOT t))), 5) AS log_ratio, round(ln(abs(corr(x, y) FILTER (t)) / abs(corr(x, y) FILTER (NOT t))), 5) AS rho,
 round(ln(stddev_samp(x) FILTER (t) / stddev_samp(x) FILTER (NOT t)), 5) AS sx, round(ln(stddev_samp(y) FILTER (t) / stddev_samp(y) FILTER (NOT t)), 5) AS sy FROM t""")
def covariance_decomposition(spark, sf_dir):
    c = S.covariance_shares(_xy(spark, sf_dir).withColumn("t", F.abs("x") >= 100), "g", "x", "y", "t")
    return c.select("g", *[r(x, 5).alias(x) for x in ("log_ratio", "rho", "sx", "sy")])


@query(f"""WITH {RETURNS}, q AS (SELECT series, quantile_cont(ret, 0.1) AS a, quantile_cont(ret, 0.9) AS b FROM rets GROUP BY 1), d AS (SELECT rets.series, (ret >= b)::INT AS top, lag(ret <= a) OVER (PARTITION BY rets.series ORDER BY date) AS low FROM rets JOIN q ON q.series = rets.series)
SELECT series, round(avg(top) FILTER (low), 6) AS p, round(avg(top), 6) AS base, round(avg(top) FILTER (low) / avg(top), 6) AS lift FROM d GROUP BY 1""")
def lagged_tail_rates(spark, sf_dir):
    t = S.lagged_tails(returns(spark, sf_dir), "series", "date", "ret", 0.1)
    return t.select("series", *[r(c).alias(c) for c in ("p", "base", "lift")])


_ADJ = f"{MONTHLY}, f AS (SELECT * FROM monthly WHERE year(date) <> 1998), m AS (SELECT series, month(date) AS mo, avg(value) AS m FROM f GROUP BY 1, 2), a AS (SELECT series, avg(value) AS a FROM f GROUP BY 1), adj AS (SELECT monthly.series, date, value, value - m + a AS adjusted FROM monthly JOIN m ON m.series = monthly.series AND m.mo = month(date) JOIN a ON a.series = monthly.series)"


@query(f"WITH {_ADJ} SELECT series, date, round(adjusted, 2) AS adjusted FROM adj")
def month_adjustment(spark, sf_dir):
    return S.month_adjusted(monthly(spark, sf_dir), "series", "date", "value", [1998]).select("series", "date", r("adjusted", 2).alias("adjusted"))


_SECOND = "s AS (SELECT series, date, {v} - 2 * lag({v}, 1) OVER w + lag({v}, 2) OVER w AS d FROM {t} WINDOW w AS (PARTITION BY series ORDER BY date))"


@query(f"WITH {DAILY_P}, {_SECOND.format(v='value', t='dp')} SELECT series, round(sqrt(avg(d * d)) / sqrt(6), 2) AS sd, round(1.4826 * quantile_cont(abs(d), 0.5) / sqrt(6), 2) AS robust, count(d) AS n FROM s GROUP BY 1")
def noise_scale(spark, sf_dir):
    from .base import daily_by_priority

    n = S.noise_scale(daily_by_priority(spark, sf_dir), "series", "date", "value")
    return n.select("series", r("sd", 2).alias("sd"), r("robust", 2).alias("robust"), "n")


@query(f"WITH {MONTHLY}, {_SECOND.format(v='value', t='monthly')}, f AS (SELECT series, date, sqrt(avg(d * d) OVER w) / sqrt(6) AS scale, count(d) OVER w AS n FROM s WHERE d IS NOT NULL WINDOW w AS (PARTITION BY series ORDER BY date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)) SELECT series, date, round(scale, 2) AS scale FROM f WHERE n = 12")
def rolling_noise_scale(spark, sf_dir):
    return S.rolling_noise_scale(monthly(spark, sf_dir), "series", "date", "value", 12).select("series", "date", r("scale", 2).alias("scale"))


@query(f"WITH {_ADJ}, sa AS (WITH {_SECOND.format(v='adjusted', t='adj')} SELECT series, sqrt(avg(d * d)) AS a FROM s GROUP BY 1), sb AS (WITH {_SECOND.format(v='value', t='adj')} SELECT series, sqrt(avg(d * d)) AS b FROM s GROUP BY 1) SELECT series, round(1 - a / b, 6) AS removed FROM sa JOIN sb USING (series)")
def seasonal_wedge(spark, sf_dir):
    m = monthly(spark, sf_dir)
    a = S.month_adjusted(m, "series", "date", "value", [1998]).withColumnRenamed("adjusted", "a")
    return S.scale_removed(a, m.withColumnRenamed("value", "v"), "series", "date").select("series", r("removed").alias("removed"))
