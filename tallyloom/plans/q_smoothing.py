"""Queries of seasonal forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import smoothing as S

from .base import MONTHLY, monthly, r
from .registry import query

SEASON, HORIZON, LEVELS, PATHS = 12, 6, [0.1, 0.5, 0.9], 60


def _series(spark, sf_dir):
    """Monthly totals of which one priority is cut to 20 months and another to 6."""
    most = F.when(F.col("series") == "2-HIGH", "1996-08-31").when(F.col("series") == "3-MEDIUM", "1995-06-30").otherwise("2999-12-31")
    return monthly(spark, sf_dir).filter(F.col("date") <= most.cast("date")).withColumn("value", F.col("value") / 1000)


_A, _B, _G, _F = "(VALUES (0.1::DOUBLE), (0.3::DOUBLE), (0.6::DOUBLE)) ta(a)", "(VALUES (0.01::DOUBLE), (0.1::DOUBLE)) tb(b)", "(VALUES (0.05::DOUBLE), (0.3::DOUBLE)) tg(g)", "(VALUES (0.9::DOUBLE), (0.98::DOUBLE)) tf(f)"
_FIT = f"""{MONTHLY}, y AS MATERIALIZED (SELECT series, value / 1000 AS y, row_number() OVER (PARTITION BY series ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY series) AS n FROM monthly
  WHERE date <= CASE series WHEN '2-HIGH' THEN DATE '1996-08-31' WHEN '3-MEDIUM' THEN DATE '1995-06-30' ELSE DATE '2999-12-31' END),
grid AS (SELECT a, b, g, f, row_number() OVER (ORDER BY a, b, g, f) AS gi FROM {_A}, {_B}, {_G}, {_F}),
lists AS (SELECT series, any_value(n) AS n, list(y ORDER BY i) AS ys, CASE WHEN any_value(n) >= {2 * SEASON + 4} THEN {SEASON} ELSE 1 END AS m FROM y GROUP BY series HAVING any_value(n) >= 10),
s AS (SELECT series, gi, a, b, CASE WHEN m > 1 THEN g ELSE 0 END AS g, f, m AS i, CASE WHEN m > 1 THEN list_avg(ys[1:m]) ELSE ys[1] END AS level, CASE WHEN m > 1 THEN (list_avg(ys[m + 1:2 * m]) - list_avg(ys[1:m])) / m ELSE ys[2] - ys[1] END AS trend,
   CASE WHEN m > 1 THEN list_transform(ys[1:m], lambda v: v - list_avg(ys[1:m])) ELSE [0.0::DOUBLE] END AS season, 0.0::DOUBLE AS sse FROM lists, grid
 UNION ALL SELECT series, gi, a, b, g, f, i + 1, level + f * trend + a * e, f * trend + a * b * e, list_transform(range(1, m + 1), lambda j: season[j] + CASE WHEN j = i % m + 1 THEN g * e ELSE 0 END), sse + e * e
  FROM (SELECT s.*, m, ys[i + 1] - level - f * trend - season[i % m + 1] AS e FROM s JOIN lists USING (series) WHERE i < n)),
best AS MATERIALIZED (SELECT s.*, m, n, sqrt(sse / (n - m)) AS sigma FROM s JOIN lists USING (series) WHERE i = n QUALIFY row_number() OVER (PARTITION BY series ORDER BY round(sse, 6), gi) = 1)"""


def _u(part: str) -> str:
    return f"(('0x' || substr(md5('season:' || series || ':' || p || ':' || h || ':{part}'), 1, 13))::BIGINT / 16.0::DOUBLE ** 13)"


_PATHS = f"""noise AS (SELECT series, p, h, CASE WHEN p < 0 THEN 0 ELSE sigma * sqrt(-2 * ln(1 - {_u('a')})) * cos(2 * pi() * {_u('b')}) END AS z FROM best, range(-1, {PATHS}) t(p), range({HORIZON}) k(h)),
walk AS (SELECT best.series, p, 0 AS h, level, trend, season, NULL::DOUBLE AS v FROM best, range(-1, {PATHS}) t(p)
 UNION ALL SELECT series, p, h + 1, level + f * trend + a * z, f * trend + a * b * z, list_transform(range(1, m + 1), lambda j: season[j] + CASE WHEN j = at_ THEN g * z ELSE 0 END), level + f * trend + season[at_] + z
  FROM (SELECT walk.series, walk.p, walk.h, walk.level, walk.trend, walk.season, z, a, b, g, f, m, ((n + walk.h) % m + 1)::INT AS at_ FROM walk JOIN best ON best.series = walk.series JOIN noise ON noise.series = walk.series AND noise.p = walk.p AND noise.h = walk.h)),
q AS (SELECT series, h - 1 AS step, max(v) FILTER (p = -1) AS forecast, quantile_cont(v, [0.1, 0.5, 0.9]) FILTER (p >= 0) AS qs FROM walk WHERE h > 0 GROUP BY 1, 2),
short AS (SELECT series, list(y ORDER BY i) AS ys FROM y WHERE n < 10 GROUP BY series),
naive AS (SELECT series, ys[-1] AS forecast, list_transform(range(1, len(ys)), lambda j: ys[j + 1] - ys[j]) AS d FROM short),
every AS (SELECT series, CASE WHEN m > 1 THEN 'season' ELSE 'trend' END AS method, step, forecast, unnest([0.1, 0.5, 0.9]) AS level, unnest(qs) AS quantile FROM q JOIN best USING (series)
 UNION ALL SELECT series, 'naive', step, forecast, lv, forecast + list_aggregate(d, 'quantile_cont', lv) * sqrt(step + 1) FROM naive, range({HORIZON}) t(step), (VALUES (0.1::DOUBLE), (0.5::DOUBLE), (0.9::DOUBLE)) l(lv))"""
_PATHS = _PATHS.replace("list_aggregate(d, 'quantile_cont', lv)", "CASE lv WHEN 0.1 THEN list_aggregate(d, 'quantile_cont', 0.1) WHEN 0.5 THEN list_aggregate(d, 'quantile_cont', 0.5) ELSE list_aggregate(d, 'quantile_cont', 0.9) END")


@query(f"WITH RECURSIVE {_FIT}, {_PATHS} SELECT series, method, step::INT AS step, round(forecast, 3) AS forecast, level::DOUBLE AS level, round(quantile, 3) AS quantile FROM every")
def seasonal_forecast(spark, sf_dir):
    p = S.seasonal_paths(_series(spark, sf_dir), "series", "date", "value", SEASON, HORIZON, LEVELS, PATHS, "season")
    return p.withColumns({"forecast": r("forecast", 3), "quantile": r("quantile", 3)})


@query(f"WITH RECURSIVE {_FIT}, {_PATHS} SELECT method, count(DISTINCT series) AS series, round(avg(quantile) FILTER (level > 0.8) - avg(quantile) FILTER (level < 0.2), 3) AS width FROM every GROUP BY 1")
def forecast_fallbacks(spark, sf_dir):
    p = S.seasonal_paths(_series(spark, sf_dir), "series", "date", "value", SEASON, HORIZON, LEVELS, PATHS, "season")
    at = lambda c: F.avg(F.when(c, F.col("quantile")))
    return p.groupBy("method").agg(F.countDistinct("series").alias("series"), r(at(F.col("level") > 0.8) - at(F.col("level") < 0.2), 3).alias("width"))
