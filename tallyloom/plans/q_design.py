"""Queries of designs of ordered series and of what resamples say about breaks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import design as D
from tallyloom.operators.resample import numbered

from .base import r, table
from .q_linear import _M, _STEP, _monthly
from .q_resample import _u
from .registry import query


@query(f"""WITH {_M} SELECT series, date, round(i / (n - 1), 6) AS trend, (i >= 40)::INT::DOUBLE AS step, {', '.join(f'((i + 3) % 12 = {k})::INT::DOUBLE AS season_{k}' for k in range(1, 12))} FROM k""")
def interrupted_design(spark, sf_dir):
    d = D.interrupted_design(_monthly(spark, sf_dir).select("series", "date"), "series", "date", 40, 12, 3)
    return d.select("series", "date", r("trend").alias("trend"), "step", *[f"season_{k}" for k in range(1, 12)])


@query(f"""WITH {_M}, z AS (SELECT series, i, n, y, (i >= 40)::INT::DOUBLE AS z FROM k), f AS (SELECT series, regr_slope(y, i) AS by_, regr_intercept(y, i) AS ay, regr_slope(z, i) AS bz, regr_intercept(z, i) AS az FROM z GROUP BY 1),
e AS (SELECT series, i, n, y - ay - by_ * i AS ey, z - az - bz * i AS ez FROM z JOIN f USING (series)), s AS (SELECT series, any_value(n) AS n, sum(ez * ez) AS xx, sum(ez * ey) AS xy, sum(ey * ey) AS yy FROM e GROUP BY 1),
u AS (SELECT series, i, ez * (ey - xy / xx * ez) AS u FROM e JOIN s USING (series)), l AS (SELECT *, lag(u, 1) OVER w AS a, lag(u, 2) OVER w AS b, lag(u, 3) OVER w AS c FROM u WINDOW w AS (PARTITION BY series ORDER BY i)),
m AS (SELECT series, sum(u * u) + 1.5 * sum(u * a) + 1.0 * sum(u * b) + 0.5 * sum(u * c) AS meat FROM l GROUP BY 1)
SELECT series, round(xy / xx, 6) AS beta, round(sqrt((yy - xy * xy / xx) / (n - 3) / xx), 6) AS se_ols, round(sqrt(meat * n / (n - 3) / (xx * xx)), 6) AS se_hac, n FROM s JOIN m USING (series)""")
def step_beside_trend(spark, sf_dir):
    x = numbered(_monthly(spark, sf_dir), "series", "date", "i").withColumns({"x": (F.col("i") >= 40).cast("double"), "time": F.col("i").cast("double")})
    h = D.hac_column(x, "series", "date", "x", ["time"], "y", 3)
    return h.select("series", r("beta").alias("beta"), r("se_ols").alias("se_ols"), r("se_hac").alias("se_hac"), "n")


@query(f"""WITH {_M}, l AS (SELECT series, y, lag(y, 1) OVER w AS a, lag(y, 2) OVER w AS b FROM k WINDOW w AS (PARTITION BY series ORDER BY i)), g AS (SELECT * FROM l WHERE b IS NOT NULL),
s AS (SELECT series, count(*) AS n, avg(y) AS my, stddev_pop(a) AS sa, stddev_pop(b) AS sb, corr(a, b) AS c, covar_pop(a, y) AS ay, covar_pop(b, y) AS by_ FROM g GROUP BY 1),
t AS (SELECT *, (ay / sa - c * by_ / sb) / (1 - c * c) AS b1, (by_ / sb - c * ay / sa) / (1 - c * c) AS b2 FROM s)
SELECT series, unnest(['(constant)', 'lag1', 'lag2']) AS term, round(unnest([my, b1, b2]), 5) AS beta, n FROM t""")
def lag_regression(spark, sf_dir):
    return D.lag_regression(_monthly(spark, sf_dir), "series", "date", "y", 2).select("series", "term", r("beta", 5).alias("beta"), "n")


@query("""WITH m AS (SELECT p_brand AS g, count(*) AS n, avg(p_size) AS mx, avg(p_retailprice) AS my, regr_sxx(p_retailprice, p_size) AS sxx, regr_sxy(p_retailprice, p_size) AS sxy FROM part GROUP BY 1),
d AS (SELECT p_brand, p_partkey, n, mx, sxx, p_size - mx AS c, p_retailprice - my - sxy / sxx * (p_size - mx) AS e FROM part JOIN m ON g = p_brand), h AS (SELECT *, 1 / n + c * c / sxx AS h FROM d)
SELECT p_brand, p_partkey, round(h, 6) AS h, CASE WHEN h < 1 - 1e-10 THEN round(e * (1 / n - mx * c / sxx) / (1 - h), 5) + 0.0 END AS dfbeta_intercept, CASE WHEN h < 1 - 1e-10 THEN round(e * c / sxx / (1 - h), 6) + 0.0 END AS dfbeta_slope FROM h""")
def deletion_influence(spark, sf_dir):
    d = D.deletion_influence(table(spark, sf_dir, "part").withColumn("x", F.col("p_size").cast("double")), "p_brand", "p_partkey", "x", "p_retailprice")
    return d.select("p_brand", "p_partkey", r("h").alias("h"), (r("dfbeta_intercept", 5) + 0.0).alias("dfbeta_intercept"), (r("dfbeta_slope") + 0.0).alias("dfbeta_slope"))


def _draws(k: str, reps: int, seed: str, shift: float) -> str:
    """CTE k (series, i, y, n) of resampled residuals of a table r (series, i, e, n, sd), to be scanned."""
    return f"""b{k} AS (SELECT series, n, rep, bk, floor({_u(f"'{seed}:' || series || ':' || rep || ':' || bk")} * (n - 12 + 1))::BIGINT AS start FROM (SELECT series, any_value(n) AS n FROM r GROUP BY 1), range({reps}) t(rep), range(100) u(bk) WHERE bk < ceil(n / 12)),
p{k} AS (SELECT series, rep, n, bk * 12 + j AS place, start + j AS i FROM b{k}, range(12) v(j) WHERE bk * 12 + j < n),
k AS (SELECT p{k}.series || '#' || rep AS series, place AS i, p{k}.n, e + CASE WHEN place >= floor(p{k}.n * 0.5::DOUBLE) THEN {shift}::DOUBLE * sd ELSE 0 END AS y FROM p{k} JOIN r ON r.series = p{k}.series AND r.i = p{k}.i)"""


_RESID = f"{_M}, f AS (SELECT series, regr_slope(y, i) AS b, regr_intercept(y, i) AS a FROM k GROUP BY 1), r AS (SELECT k.series, i, n, y - a - b * i AS e, stddev_pop(y - a - b * i) OVER (PARTITION BY k.series) AS sd FROM k JOIN f USING (series))"


def _sup_sql(name: str, shift: float) -> str:
    return f"{name} AS (WITH {_draws('', 20, 'sup', shift)}, {_STEP}, s AS (SELECT series, max(abs(coef / sqrt(ssr / (n - 3) / zz))) AS sup_t FROM scan GROUP BY 1) SELECT regexp_extract(series, '^(.*)#', 1) AS series, sup_t FROM s)"


@query(f"WITH {_RESID}, {_sup_sql('null_', 0.0)} SELECT series, round(quantile_cont(sup_t, 0.95), 5) AS critical, round(avg((sup_t > 1.96)::INT), 6) AS size FROM null_ GROUP BY 1")
def break_critical_values(spark, sf_dir):
    c = D.critical_values(D.sup_t(_monthly(spark, sf_dir), "series", "date", "y", 12, 20, "sup"), "series")
    return c.select("series", r("critical", 5).alias("critical"), r("size").alias("size"))


_POWER = f"{_RESID}, {_sup_sql('null_', 0.0)}, {_sup_sql('one_', 1.0)}, {_sup_sql('two_', 3.0)}, c AS (SELECT series, quantile_cont(sup_t, 0.95) AS critical FROM null_ GROUP BY 1), power_ AS (SELECT series, shift, avg((sup_t > critical)::INT) AS power FROM (SELECT series, 1.0::DOUBLE AS shift, sup_t FROM one_ UNION ALL SELECT series, 3.0::DOUBLE, sup_t FROM two_) JOIN c USING (series) GROUP BY 1, 2)"


def _power(spark, sf_dir):
    m = _monthly(spark, sf_dir)
    draws = {s: D.sup_t(m, "series", "date", "y", 12, 20, "sup", shift=s) for s in (0.0, 1.0, 3.0)}
    return D.power_by_shift({s: draws[s] for s in (1.0, 3.0)}, D.critical_values(draws[0.0], "series"), "series")


@query(f"WITH {_POWER} SELECT series, shift, round(power, 6) AS power FROM power_")
def break_power(spark, sf_dir):
    return _power(spark, sf_dir).select("series", "shift", r("power").alias("power"))


@query(f"WITH {_POWER} SELECT series, min(shift) FILTER (power >= 0.8) AS shift FROM power_ GROUP BY 1")
def detectable_shift(spark, sf_dir):
    return D.detectable_shift(_power(spark, sf_dir), "series")


_FITTED = """best AS (SELECT series, arg_min(tau, struct_pack(a := ssr, b := tau)) AS tau FROM scan GROUP BY 1), g AS (SELECT k.series, i, n, y, tau, (i >= tau)::INT::DOUBLE AS z FROM k JOIN best USING (series)),
h AS (SELECT series, regr_slope(y, i) AS by_, regr_intercept(y, i) AS ay, regr_slope(z, i) AS bz, regr_intercept(z, i) AS az FROM g GROUP BY 1), c AS (SELECT series, sum((z - az - bz * i) * (y - ay - by_ * i)) / sum((z - az - bz * i) ** 2) AS coef FROM g JOIN h USING (series) GROUP BY 1),
o AS (SELECT g.series, i, n, tau, y - (y - ay - by_ * i - coef * (z - az - bz * i)) AS fitted, y - ay - by_ * i - coef * (z - az - bz * i) AS e FROM g JOIN h USING (series) JOIN c USING (series))"""


@query(f"""WITH {_M}, o AS (WITH {_STEP}, {_FITTED} SELECT * FROM o), b AS (SELECT series, n, rep, bk, floor({_u("'date:' || series || ':' || rep || ':' || bk")} * (n - 12 + 1))::BIGINT AS start FROM (SELECT series, any_value(n) AS n FROM o GROUP BY 1), range(20) t(rep), range(100) u(bk) WHERE bk < ceil(n / 12)),
p AS (SELECT series, rep, n, bk * 12 + j AS place, start + j AS i FROM b, range(12) v(j) WHERE bk * 12 + j < n),
again AS (WITH k AS (SELECT p.series || '#' || rep AS series, place AS i, p.n, a.fitted + q.e AS y FROM p JOIN o a ON a.series = p.series AND a.i = p.place JOIN o q ON q.series = p.series AND q.i = p.i), {_STEP} SELECT series, arg_min(tau, struct_pack(a := ssr, b := tau)) AS t FROM scan GROUP BY 1)
SELECT s.series, any_value(tau) AS tau, quantile_cont(t, 0.05) AS lower, quantile_cont(t, 0.95) AS upper FROM again JOIN (SELECT DISTINCT series, tau FROM o) s ON s.series = regexp_extract(again.series, '^(.*)#', 1) GROUP BY 1""")
def break_date_interval(spark, sf_dir):
    return D.date_interval(_monthly(spark, sf_dir).select("series", "date", "y"), "series", "date", "y", 12, 20, "date")
