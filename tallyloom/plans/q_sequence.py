"""Queries along ordered series."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyloom.operators import sequence as Q

from .base import DAILY_P, MONTHLY, RETURNS, daily_by_priority, monthly, r, returns
from .registry import query

_EWMA = f"""{RETURNS}, n AS (SELECT series, date, ret, row_number() OVER (PARTITION BY series ORDER BY date) - 1 AS t FROM rets), v AS (SELECT series, var_samp(ret) AS v0 FROM n WHERE t < 60 GROUP BY 1),
k AS (SELECT n.series, n.date, n.ret, n.t, v0, row_number() OVER (PARTITION BY n.series ORDER BY n.date) AS i FROM n JOIN v ON n.series = v.series WHERE t >= 60),
e AS (SELECT series, i, date, ret, v0 AS v FROM k WHERE i = 1 UNION ALL SELECT k.series, k.i, k.date, k.ret, 0.94::DOUBLE * e.v + 0.06::DOUBLE * e.ret * e.ret FROM e JOIN k ON k.series = e.series AND k.i = e.i + 1)"""


@query(f"WITH RECURSIVE {_EWMA} SELECT series, date, round(sqrt(v), 6) AS scale FROM e")
def ewma_scale(spark, sf_dir):
    return Q.ewma_scale(returns(spark, sf_dir), "series", "date", "ret").select("series", "date", r("scale").alias("scale"))


@query(f"WITH RECURSIVE {_EWMA} SELECT series, date, round(ret / sqrt(v), 6) AS z FROM e")
def devolatilised_returns(spark, sf_dir):
    return Q.devolatilised(returns(spark, sf_dir), "series", "date", "ret").select("series", "date", r("z").alias("z"))


@query(f"""WITH {RETURNS}, s AS (SELECT series, date, CASE WHEN count(ret) OVER f >= 10 THEN stddev_samp(ret) OVER f END AS s FROM rets WINDOW f AS (PARTITION BY series ORDER BY date ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING))
SELECT series, date, round(coalesce(s, first_value(s IGNORE NULLS) OVER (PARTITION BY series ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), last_value(s IGNORE NULLS) OVER (PARTITION BY series ORDER BY date ROWS UNBOUNDED PRECEDING)), 6) AS scale FROM s""")
def centred_rolling_scale(spark, sf_dir):
    return Q.centred_scale(returns(spark, sf_dir), "series", "date", "ret").select("series", "date", r("scale").alias("scale"))


@query(f"""WITH {RETURNS}, c AS (SELECT series, date, (abs(ret) < 150)::INT AS c FROM rets), w AS (SELECT series, date, avg(c) OVER (PARTITION BY series ORDER BY date ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS mean, row_number() OVER (PARTITION BY series ORDER BY date) AS i FROM c) SELECT series, date, round(mean, 6) AS mean FROM w WHERE i >= 100""")
def rolling_coverage(spark, sf_dir):
    c = returns(spark, sf_dir).select("series", "date", (F.abs("ret") < 150).cast("double").alias("c"))
    return Q.rolling_mean_full(c, "series", "date", "c", 100).select("series", "date", r("mean").alias("mean"))


def _clustering(n: int) -> str:
    return f"""SELECT series, {n} AS length, round(avg(r), 6) AS clustering, count(*) AS windows FROM (SELECT series, i, corr(x, b) OVER (PARTITION BY series ORDER BY date ROWS BETWEEN {n - 2} PRECEDING AND CURRENT ROW) AS r FROM l) WHERE i >= {n} GROUP BY 1"""


@query(f"WITH {RETURNS}, l AS (SELECT series, date, abs(ret) AS x, lag(abs(ret)) OVER (PARTITION BY series ORDER BY date) AS b, row_number() OVER (PARTITION BY series ORDER BY date) AS i FROM rets) {_clustering(20)} UNION ALL {_clustering(60)}")
def clustering_within_windows(spark, sf_dir):
    return Q.within_window_clustering(returns(spark, sf_dir), "series", "date", "ret", [20, 60]).select("series", "length", r("clustering").alias("clustering"), "windows")


@query(f"""WITH {RETURNS}, f AS (SELECT series, date, row_number() OVER (PARTITION BY series ORDER BY date) AS i, sum((ret < 0)::INT) OVER (PARTITION BY series ORDER BY date ROWS UNBOUNDED PRECEDING) AS c, ret < 0 AS f FROM rets) SELECT series, min(date) AS first, count(*) AS length FROM f WHERE f GROUP BY series, i - c""")
def negative_episodes(spark, sf_dir):
    return Q.episodes(returns(spark, sf_dir).withColumn("f", F.col("ret") < 0), "series", "date", "f")


_FOLDS = """n AS (SELECT series, date, row_number() OVER (PARTITION BY series ORDER BY date) AS i, count(*) OVER (PARTITION BY series) AS n FROM monthly),
f AS (SELECT series, date, i, fold::INT AS fold, 30 + fold * floor((n - 30 - 12) / 2) AS e FROM n, range(3) t(fold))"""


@query(f"WITH {MONTHLY}, {_FOLDS} SELECT series, date, fold, CASE WHEN i <= e THEN 'train' ELSE 'validate' END AS role FROM f WHERE i <= e + 12")
def rolling_origin_folds(spark, sf_dir):
    return Q.rolling_origin(monthly(spark, sf_dir), "series", "date", 3, 12, 30)


@query(f"WITH {MONTHLY}, n AS (SELECT series, date, (row_number() OVER (PARTITION BY series ORDER BY date DESC) - 1) // 6 AS origin, count(*) OVER (PARTITION BY series) AS n FROM monthly) SELECT series, date, origin FROM n WHERE n - (origin + 1) * 6 >= 24")
def backtest_origins(spark, sf_dir):
    return Q.backtest_origins(monthly(spark, sf_dir), "series", "date", 6, 24)


@query(f"""WITH {MONTHLY}, d AS (SELECT series, value AS v, value - lag(value, 12) OVER (PARTITION BY series ORDER BY date) AS e, row_number() OVER (PARTITION BY series ORDER BY date DESC) AS b FROM monthly), q AS (SELECT series, quantile_cont(e, 0.1) AS a, quantile_cont(e, 0.9) AS c FROM d GROUP BY 1),
s AS (SELECT d.series, step::INT AS step, v, a, c FROM d JOIN range(18) t(step) ON step % 12 = 12 - b JOIN q ON q.series = d.series WHERE b <= 12)
SELECT series, step, v AS forecast, 0.1::DOUBLE AS level, round(v + sqrt(1 + step // 12) * a, 4) AS quantile FROM s UNION ALL SELECT series, step, v, 0.9, round(v + sqrt(1 + step // 12) * c, 4) FROM s""")
def seasonal_naive_forecast(spark, sf_dir):
    f = Q.seasonal_naive(monthly(spark, sf_dir), "series", "date", "value", 12, 18, [0.1, 0.9])
    return f.select("series", "step", "forecast", "level", r("quantile", 4).alias("quantile"))


_BREACH = f"""{RETURNS}, b AS (SELECT series, date, (ret < -120)::INT AS b, lag((ret < -120)::INT) OVER (PARTITION BY series ORDER BY date) AS p FROM rets),
c AS (SELECT series, count(*) AS n, sum(b)::BIGINT AS x, count(*) FILTER (p = 0 AND b = 0) AS n00, count(*) FILTER (p = 0 AND b = 1) AS n01, count(*) FILTER (p = 1 AND b = 0) AS n10, count(*) FILTER (p = 1 AND b = 1) AS n11 FROM b GROUP BY 1)"""
_XL = "CASE WHEN {x} = 0 THEN 0 ELSE {x} * ln({y}) END"


def _xl(x: str, y: str) -> str:
    return _XL.format(x=x, y=y)


@query(f"""WITH {_BREACH}, p AS (SELECT *, n01 / (n00 + n01) AS p01, n11 / nullif(n10 + n11, 0) AS p11, (n01 + n11) / (n - 1) AS p FROM c)
SELECT series, n, x, n00, n01, n10, n11, round(-2 * ({_xl('(n - x)', '0.95')} + {_xl('x', '0.05')} - {_xl('(n - x)', '(1 - x / n)')} - {_xl('x', '(x / n)')}), 6) AS lr_rate,
 CASE WHEN n10 + n11 > 0 AND n01 + n11 > 0 THEN round(-2 * ({_xl('(n00 + n10)', '(1 - p)')} + {_xl('(n01 + n11)', 'p')} - {_xl('n00', '(1 - p01)')} - {_xl('n01', 'p01')} - {_xl('n10', '(1 - p11)')} - {_xl('n11', 'p11')}), 6) END AS lr_independence FROM p""")
def var_backtest(spark, sf_dir):
    b = Q.var_backtest(returns(spark, sf_dir).withColumn("b", F.col("ret") < -120), "series", "date", "b", 0.05)
    return b.select("series", "n", "x", "n00", "n01", "n10", "n11", r("lr_rate").alias("lr_rate"), r("lr_independence").alias("lr_independence"))


@query(f"""WITH {DAILY_P}, l AS (SELECT series, date, value / 1e5 AS y, lag(value, 1) OVER w / 1e5 AS a, lag(value, 7) OVER w / 1e5 AS b FROM dp WINDOW w AS (PARTITION BY series ORDER BY date)), d AS (SELECT series, date, (y - a) ** 2 - (y - b) ** 2 AS d FROM l WHERE b IS NOT NULL),
m AS (SELECT series, date, d - avg(d) OVER (PARTITION BY series) AS c, avg(d) OVER (PARTITION BY series) AS m, count(*) OVER (PARTITION BY series) AS n FROM d), k AS (SELECT series, n, m, c, lag(c, 1) OVER (PARTITION BY series ORDER BY date) AS c1, lag(c, 2) OVER (PARTITION BY series ORDER BY date) AS c2 FROM m),
g AS (SELECT series, n, m, (sum(c * c) + 2 * (sum(c * c1) + sum(c * c2))) / n AS v FROM k GROUP BY 1, 2, 3) SELECT series, n, round(m, 4) AS mean_difference, CASE WHEN v > 0 AND n >= 10 THEN round(m / sqrt(v / n) * sqrt((n + 1 - 6 + 6 / n) / n), 4) END AS statistic FROM g""")
def forecast_comparison_test(spark, sf_dir):
    w = Window.partitionBy("series").orderBy("date")
    v = F.col("value") / 1e5
    d = daily_by_priority(spark, sf_dir).select("series", "date", v.alias("y"), F.lag(v, 1).over(w).alias("a"), F.lag(v, 7).over(w).alias("b")).filter("b is not null")
    t = Q.loss_difference(d, "series", "date", "y", "a", "b", 3)
    return t.select("series", "n", r("mean_difference", 4).alias("mean_difference"), r("statistic", 4).alias("statistic"))


@query(f"""WITH {MONTHLY}, n AS (SELECT series, value, row_number() OVER (PARTITION BY series ORDER BY date) - 1 AS i FROM monthly), e AS (SELECT series, i // 12 AS origin, i % 12 AS step, abs(value / first_value(value) OVER (PARTITION BY series, i // 12 ORDER BY i) - 1) AS e FROM n)
SELECT series, origin, coalesce(min(step) FILTER (e > 0.25), count(*)) AS valid_steps FROM e GROUP BY 1, 2""")
def valid_prediction_steps(spark, sf_dir):
    w = Window.partitionBy("series").orderBy("date")
    n = monthly(spark, sf_dir).select("series", "value", (F.row_number().over(w) - 1).cast("long").alias("i"))
    n = n.select("series", F.floor(F.col("i") / 12).alias("origin"), (F.col("i") % 12).alias("step"), "value", "i")
    e = n.withColumn("e", F.abs(F.col("value") / F.first("value").over(Window.partitionBy("series", "origin").orderBy("i")) - 1))
    return Q.first_exceedance(e, ["series", "origin"], "step", "e", 0.25)


@query(f"""WITH {DAILY_P}, u AS (SELECT series, round(percent_rank() OVER (ORDER BY value), 3) AS u FROM dp), d AS (SELECT series, u, count(*) AS c FROM u GROUP BY 1, 2), w AS (SELECT series, u, c, sum(c) OVER (PARTITION BY series ORDER BY u ROWS UNBOUNDED PRECEDING) AS k, sum(c) OVER (PARTITION BY series) AS n FROM d)
SELECT series, round(max(greatest(k / n - u, u - (k - c) / n)), 6) AS ks, any_value(n)::BIGINT AS n FROM w GROUP BY 1""")
def pit_uniformity(spark, sf_dir):
    from tallyloom.functions.ranks import ranked

    d = daily_by_priority(spark, sf_dir)
    # the share of smaller values, with ties at the rank of the first
    k = ranked(d, ["value", "series", "date"])
    n = k.count()
    first = k.groupBy("value").agg(F.min("rank").alias("f"))
    u = k.join(first, "value").select("series", F.round((F.col("f") - 1) / (n - 1), 3).alias("u"))
    return Q.uniformity(u, "series", "u").select("series", r("ks").alias("ks"), "n")


_GRID = "g AS (SELECT a, b, f, row_number() OVER (ORDER BY b, a, f) AS gi FROM (VALUES (0.1::DOUBLE), (0.3::DOUBLE), (0.5::DOUBLE), (0.8::DOUBLE)) t(a), (VALUES (0.01::DOUBLE), (0.1::DOUBLE), (0.3::DOUBLE)) u(b), (VALUES (0.8::DOUBLE), (0.9::DOUBLE), (0.98::DOUBLE)) v(f))"


@query(f"""WITH RECURSIVE {MONTHLY}, y AS (SELECT series, value AS y, row_number() OVER (PARTITION BY series ORDER BY date) - 1 AS i FROM monthly), {_GRID},
s AS (SELECT p.series, gi, a, b, f, 0 AS i, p.y AS level, q.y - p.y AS trend, 0.0::DOUBLE AS sse, []::DOUBLE[] AS errors FROM y p JOIN y q ON p.series = q.series AND p.i = 0 AND q.i = 1, g
 UNION ALL SELECT s.series, gi, a, b, f, s.i + 1, level + f * trend + a * (y - level - f * trend), f * trend + a * b * (y - level - f * trend), sse + (y - level - f * trend) ** 2, list_append(errors, y - level - f * trend) FROM s JOIN y ON y.series = s.series AND y.i = s.i + 1),
e AS (SELECT * FROM s QUALIFY i = max(i) OVER (PARTITION BY series) AND row_number() OVER (PARTITION BY series ORDER BY i DESC, sse, gi) = 1),
h AS (SELECT series, step, level + trend * list_sum(list_transform(range(1, step + 2), lambda j: f ** j)) AS point,
 [list_aggregate(errors, 'quantile_cont', 0.1), list_aggregate(errors, 'quantile_cont', 0.5), list_aggregate(errors, 'quantile_cont', 0.9)] AS qs FROM e, range(6) t(step))
SELECT series, step::INT AS step, round(point, 1) AS forecast, lv AS level, round(point + qs[j] * sqrt(step + 1), 1) AS quantile, false AS fallback FROM h, (VALUES (0.1::DOUBLE, 1), (0.5::DOUBLE, 2), (0.9::DOUBLE, 3)) l(lv, j)""")
def exponential_smoothing_forecast(spark, sf_dir):
    h = Q.holt(monthly(spark, sf_dir), "series", "date", "value", 6, [0.1, 0.5, 0.9])
    return h.withColumns({"forecast": r("forecast", 1), "quantile": r("quantile", 1)})


@query()
def matched_absence(spark, sf_dir):
    d = returns(spark, sf_dir).withColumn("f", F.col("ret") < -100)
    spells = Q.episodes(d, "series", "date", "f").groupBy("series").agg(F.collect_list("length").alias("lengths"))
    n = d.groupBy("series").agg(F.count("*").alias("n"))
    return Q.matched_absence(n.join(spells, "series"), "series", "absence")
