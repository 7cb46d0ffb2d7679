"""Queries of regressions and matrices."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import linear as L

from .base import MONTHLY, SCORED, monthly, r, scored, table
from .registry import query

_L = "l AS (SELECT l_returnflag AS g, l_orderkey * 10 + l_linenumber AS id, l_quantity AS q, l_extendedprice AS e, l_discount AS d, l_tax AS t FROM lineitem)"


def _lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("g"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("e"), F.col("l_discount").alias("d"), F.col("l_tax").alias("t"))


# two regressors by Cramer's rule on sample covariances
_OLS2 = f"""{_L}, m AS (SELECT g, count(*) AS n, avg(q) AS mq, avg(d) AS md, avg(e) AS me, var_pop(q) AS qq, var_pop(d) AS dd, covar_pop(q, d) AS qd, covar_pop(q, e) AS qe, covar_pop(d, e) AS de, var_pop(e) AS ee FROM l GROUP BY 1),
b AS (SELECT *, (qe * dd - de * qd) / (qq * dd - qd * qd) AS bq, (de * qq - qe * qd) / (qq * dd - qd * qd) AS bd FROM m), s AS (SELECT *, ee - bq * qe - bd * de AS rss FROM b)"""


@query(f"""WITH {_OLS2} SELECT g, 'q' AS term, round(bq, 4) AS beta, round(sqrt(rss * n / (n - 3) * dd / (qq * dd - qd * qd) / n), 4) AS se, round(1 - rss / ee, 6) AS r2, n FROM s
UNION ALL SELECT g, 'd', round(bd, 4), round(sqrt(rss * n / (n - 3) * qq / (qq * dd - qd * qd) / n), 4), round(1 - rss / ee, 6), n FROM s""")
def batched_ols(spark, sf_dir):
    o = L.ols(_lines(spark, sf_dir), "g", ["q", "d"], "e").filter("term <> '(intercept)'")
    return o.select("g", "term", r("beta", 4).alias("beta"), r("se", 4).alias("se"), r("r2").alias("r2"), "n")


@query(f"""WITH {_L}, a AS (SELECT unnest([0.0, 10.0, 1000.0])::DOUBLE AS alpha), m AS (SELECT g, count(*) AS n, sum(q) AS s, sum(q * q) AS qq, sum(e) AS se, sum(q * e) AS qe FROM l GROUP BY 1)
SELECT g, alpha, 'q' AS term, round(((n + alpha) * qe - s * se) / ((n + alpha) * (qq + alpha) - s * s), 4) AS beta, round((n * (qq + alpha) + qq * (n + alpha) - 2 * s * s) / ((n + alpha) * (qq + alpha) - s * s), 6) AS df FROM m, a""")
def ridge_path(spark, sf_dir):
    o = L.ridge_path(_lines(spark, sf_dir), "g", ["q"], "e", [0.0, 10.0, 1000.0]).filter("term = 'q'")
    return o.select("g", "alpha", "term", r("beta", 4).alias("beta"), r("df").alias("df"))


@query(f"""WITH {_L}, c AS (SELECT g, corr(q, e) AS a, corr(q, t) AS b, corr(e, t) AS c FROM l GROUP BY 1), d AS (SELECT *, 1 - a * a - b * b - c * c + 2 * a * b * c AS det FROM c)
SELECT g, unnest(['q', 'e', 't']) AS term, round(unnest([(1 - c * c) / det, (1 - b * b) / det, (1 - a * a) / det]), 6) AS vif FROM d""")
def variance_inflation(spark, sf_dir):
    return L.vif(_lines(spark, sf_dir), "g", ["q", "e", "t"]).select("g", "term", r("vif").alias("vif"))


@query(f"""WITH {_L}, m AS (SELECT g, sum(q * q) AS a, sum(t * t) AS b, sum(q * t) AS c, var_pop(q) * count(*) AS ca, var_pop(t) * count(*) AS cb, covar_pop(q, t) * count(*) AS cc FROM l GROUP BY 1),
v AS (SELECT g, unnest(['raw', 'centred', 'scaled', 'standardised']) AS variant, unnest([a, ca, 1, 1]) AS a, unnest([b, cb, 1, 1]) AS b, unnest([c, cc, c / sqrt(a * b), cc / sqrt(ca * cb)]) AS c FROM m),
k AS (SELECT g, variant, sqrt(((a + b) + sqrt((a - b) ** 2 + 4 * c * c)) / ((a + b) - sqrt((a - b) ** 2 + 4 * c * c))) AS kappa FROM v) SELECT g, variant, round(kappa, 3) AS kappa, round(log10(kappa), 4) AS digits FROM k""")
def condition_numbers(spark, sf_dir):
    return L.condition(_lines(spark, sf_dir), "g", ["q", "t"]).select("g", "variant", r("kappa", 3).alias("kappa"), r("digits", 4).alias("digits"))


@query(f"""WITH {_L}, c AS (SELECT g, corr(q, e) AS r FROM l GROUP BY 1) SELECT g, unnest([0, 1])::INT AS component, round(unnest([1 + abs(r), 1 - abs(r)]), 6) AS eigenvalue, round(unnest([(1 + abs(r)) / 2, (1 - abs(r)) / 2]), 6) AS share, round(unnest([2 * abs(r), NULL]), 6) AS gap FROM c""")
def correlation_spectrum(spark, sf_dir):
    return L.spectrum(_lines(spark, sf_dir), "g", ["q", "e"]).select("g", "component", r("eigenvalue").alias("eigenvalue"), r("share").alias("share"), r("gap").alias("gap"))


_HOLES = "h AS (SELECT g, CASE WHEN id % 3 <> 0 THEN q END AS q, CASE WHEN id % 5 <> 0 THEN e END AS e, CASE WHEN id % 7 <> 0 THEN t END AS t FROM l)"


def _holes(spark, sf_dir):
    l = _lines(spark, sf_dir)
    return l.select("g", F.when(F.col("id") % 3 != 0, F.col("q")).alias("q"), F.when(F.col("id") % 5 != 0, F.col("e")).alias("e"), F.when(F.col("id") % 7 != 0, F.col("t")).alias("t"))


@query(f"""WITH {_L}, {_HOLES} SELECT g, 'q' AS a, 'e' AS b, round(corr(q, e), 6) AS r, count(*) FILTER (q IS NOT NULL AND e IS NOT NULL) AS n FROM h GROUP BY 1 UNION ALL SELECT g, 'q', 't', round(corr(q, t), 6), count(*) FILTER (q IS NOT NULL AND t IS NOT NULL) FROM h GROUP BY 1
UNION ALL SELECT g, 'e', 't', round(corr(e, t), 6), count(*) FILTER (e IS NOT NULL AND t IS NOT NULL) FROM h GROUP BY 1""")
def pairwise_correlation(spark, sf_dir):
    return L.pairwise_correlation(_holes(spark, sf_dir), "g", ["q", "e", "t"]).select("g", "a", "b", r("r").alias("r"), "n")


@query(f"""WITH {_L}, {_HOLES}, c AS (SELECT * FROM h WHERE q IS NOT NULL AND e IS NOT NULL AND t IS NOT NULL) SELECT g, 'q' AS a, 'e' AS b, round(corr(q, e), 6) AS r, count(*) AS n FROM c GROUP BY 1 UNION ALL SELECT g, 'q', 't', round(corr(q, t), 6), count(*) FROM c GROUP BY 1 UNION ALL SELECT g, 'e', 't', round(corr(e, t), 6), count(*) FROM c GROUP BY 1""")
def complete_case_correlation(spark, sf_dir):
    return L.complete_case_correlation(_holes(spark, sf_dir), "g", ["q", "e", "t"]).select("g", "a", "b", r("r").alias("r"), "n")


@query(f"""WITH {_L}, {_HOLES}, c AS (SELECT g, corr(q, e) AS a, corr(q, t) AS b, corr(e, t) AS c FROM h GROUP BY 1), p AS (SELECT *, sqrt((a * a + b * b + c * c) / 3) AS p FROM c),
v AS (SELECT g, 1 + 2 * p * cos(acos(greatest(-1, least(1, a * b * c / p ** 3))) / 3 + 2 * pi() / 3) AS least FROM p) SELECT g, round(least, 6) AS least, least >= -1e-10 AS is_psd, 0.0::DOUBLE AS change FROM v WHERE least >= 0""")
def psd_repair(spark, sf_dir):
    p = L.psd_repair(_holes(spark, sf_dir), "g", ["q", "e", "t"])
    return p.select("g", r("least").alias("least"), "is_psd", (r("change") + 0.0).alias("change"))


@query(f"""WITH {_L}, s AS (SELECT g, count(*) AS n, avg(q) AS mx, avg(e) AS my, regr_sxx(e, q) AS sxx, regr_sxy(e, q) AS sxy, regr_syy(e, q) AS syy FROM l GROUP BY 1), h AS (SELECT g, id, n, 1 / n + (q - mx) ** 2 / sxx AS h, e - my - sxy / sxx * (q - mx) AS u, (syy - sxy * sxy / sxx) / (n - 2) AS s2 FROM l JOIN s USING (g))
SELECT g, id, round(h * 1e6, 4) AS h, round(u, 3) AS residual, round(u * u * h / (2 * s2 * (1 - h) ** 2) * 1e6, 3) AS cook, h > 6 / n AS flagged FROM h""")
def leverage_and_cook(spark, sf_dir):
    v = L.leverage(_lines(spark, sf_dir), "g", "id", "q", "e")
    return v.select("g", "id", r(F.col("h") * 1e6, 4).alias("h"), r("residual", 3).alias("residual"), r(F.col("cook") * 1e6, 3).alias("cook"), "flagged")


@query(f"""WITH RECURSIVE {SCORED}, d AS (SELECT ln(p / (1 - p)) AS x, y FROM scored), steps AS (SELECT 0 AS i, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b, 0.0::DOUBLE AS sa, 0.0::DOUBLE AS sb
 UNION ALL SELECT i + 1, a + (hbb * ga - hab * gb) / det, b + (haa * gb - hab * ga) / det, sqrt(hbb / det), sqrt(haa / det) FROM (SELECT *, haa * hbb - hab * hab AS det FROM (SELECT i, a, b, sum(y - q) AS ga, sum((y - q) * x) AS gb, sum(q * (1 - q)) AS haa, sum(q * (1 - q) * x) AS hab, sum(q * (1 - q) * x * x) AS hbb
  FROM (SELECT i, a, b, x, y, 1 / (1 + exp(-a - b * x)) AS q FROM steps, d WHERE i < 25) GROUP BY i, a, b)))
SELECT unnest(['(intercept)', 'x']) AS term, round(unnest([a, b]), 5) AS beta, round(unnest([sa, sb]), 5) AS se FROM steps WHERE i = 25""")
def irls_logistic(spark, sf_dir):
    s = scored(spark, sf_dir).withColumn("x", F.log(F.col("p") / (1 - F.col("p"))))
    fit = spark.createDataFrame(L.irls(s, ["x"], "y"), "term string, beta double, se double")
    return fit.select("term", r("beta", 5).alias("beta"), r("se", 5).alias("se"))


@query(f"""WITH o AS (SELECT o_orderstatus, o_orderpriority, (o_orderstatus = 'F' OR o_totalprice > 250000)::INT AS y FROM orders), c AS (SELECT 'o_orderstatus' AS "column", o_orderstatus AS level, y FROM o UNION ALL SELECT 'o_orderpriority', o_orderpriority, y FROM o)
SELECT "column", level, count(*) AS rows, min(y) AS outcome FROM c GROUP BY 1, 2 HAVING min(y) = max(y)""")
def separation_check(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority", ((F.col("o_orderstatus") == "F") | (F.col("o_totalprice") > 250000)).cast("int").alias("y"))
    return L.separation(o, ["o_orderstatus", "o_orderpriority"], "y")


_M = f"{MONTHLY}, k AS (SELECT series, date, value / 1e6 AS y, row_number() OVER (PARTITION BY series ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY series) AS n FROM monthly)"


def _monthly(spark, sf_dir):
    return monthly(spark, sf_dir).withColumn("y", F.col("value") / 1e6)


@query(f"""WITH {_M}, d AS (SELECT series, y - lag(y) OVER w AS d, lag(y) OVER w AS l FROM k WINDOW w AS (PARTITION BY series ORDER BY i)), g AS (SELECT series, regr_slope(d, l) AS b, regr_sxx(d, l) AS sxx, regr_syy(d, l) AS syy, regr_sxy(d, l) AS sxy, count(d) AS n FROM d GROUP BY 1)
SELECT series, round(b / sqrt((syy - b * sxy) / (n - 2) / sxx), 6) AS t, round(b, 6) AS gamma, n FROM g""")
def unit_root(spark, sf_dir):
    return L.adf(_monthly(spark, sf_dir), "series", "date", "y").select("series", r("t").alias("t"), r("gamma").alias("gamma"), "n")


@query(f"""WITH {_M}, p AS (SELECT a.series || '|' || b.series AS pair, a.date, a.y AS x, b.y AS y FROM k a JOIN k b ON a.date = b.date AND a.series < b.series), s AS (SELECT pair, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM p GROUP BY 1), e AS (SELECT pair, date, y - a - b * x AS e FROM p JOIN s USING (pair)),
d AS (SELECT pair, e - lag(e) OVER w AS d, lag(e) OVER w AS l FROM e WINDOW w AS (PARTITION BY pair ORDER BY date)), g AS (SELECT pair, sum(d * l) AS dl, sum(l * l) FILTER (d IS NOT NULL) AS ll, sum(d * d) AS dd, count(d) AS n FROM d GROUP BY 1)
SELECT pair, round(dl / ll / sqrt((dd - dl * dl / ll) / (n - 1) / ll), 6) AS t, n FROM g""")
def cointegration(spark, sf_dir):
    m = _monthly(spark, sf_dir).select("series", "date", "y")
    b = m.select(F.col("series").alias("other"), "date", F.col("y").alias("y2"))
    p = m.join(b, "date").filter("series < other").select(F.concat_ws("|", "series", "other").alias("pair"), "date", F.col("y").alias("x"), F.col("y2").alias("y"))
    return L.cointegration(p, "pair", "date", "x", "y").select("pair", r("t").alias("t"), "n")


def _scan_sql(z: str) -> str:
    return f"""z AS (SELECT a.series, t.i AS tau, a.i, a.y, a.n, {z} AS z FROM k a JOIN (SELECT series, i FROM k WHERE i >= floor(n * 0.15::DOUBLE) AND i < ceil(n * 0.85::DOUBLE)) t ON a.series = t.series),
f AS (SELECT series, tau, regr_slope(y, i) AS by_, regr_intercept(y, i) AS ay, regr_slope(z, i) AS bz, regr_intercept(z, i) AS az FROM z GROUP BY 1, 2),
e AS (SELECT series, tau, n, y - ay - by_ * i AS ey, z - az - bz * i AS ez FROM z JOIN f USING (series, tau)),
scan AS (SELECT series, tau, sum(ez * ey) / sum(ez * ez) AS coef, sum(ez * ez) AS zz, sum(ey * ey) - sum(ez * ey) ** 2 / sum(ez * ez) AS ssr, any_value(n) AS n FROM e GROUP BY 1, 2)"""


_STEP, _BEND = _scan_sql("(a.i >= t.i)::INT"), _scan_sql("greatest(a.i - t.i, 0)")


@query(f"WITH {_M}, {_STEP} SELECT series, tau, round(coef, 6) AS coef, round(coef / sqrt(ssr / (n - 3) / zz), 6) AS t, round(ssr, 6) AS ssr FROM scan")
def step_scan(spark, sf_dir):
    return L.break_scan(_monthly(spark, sf_dir), "series", "date", "y").select("series", "tau", r("coef").alias("coef"), r("t").alias("t"), r("ssr").alias("ssr"))


@query(f"WITH {_M}, {_BEND} SELECT series, tau, round(coef, 6) AS coef, round(coef / sqrt(ssr / (n - 3) / zz), 6) AS t, round(ssr, 6) AS ssr FROM scan")
def bend_scan(spark, sf_dir):
    return L.break_scan(_monthly(spark, sf_dir), "series", "date", "y", bend=True).select("series", "tau", r("coef").alias("coef"), r("t").alias("t"), r("ssr").alias("ssr"))


@query(f"WITH {_M}, {_STEP}, t AS (SELECT *, coef / sqrt(ssr / (n - 3) / zz) AS t FROM scan) SELECT series, arg_min(tau, ssr) AS tau, round(arg_min(coef, ssr), 6) AS coef, round(max(abs(t)), 6) AS sup_t, round(avg((abs(t) > 1.96)::INT), 6) AS above FROM t GROUP BY 1")
def best_break(spark, sf_dir):
    b = L.best_break(L.break_scan(_monthly(spark, sf_dir), "series", "date", "y"), "series")
    return b.select("series", "tau", r("coef").alias("coef"), r("sup_t").alias("sup_t"), r("above").alias("above"))


@query(f"WITH {_M}, s AS (WITH {_STEP} SELECT series, min(ssr) AS a FROM scan GROUP BY 1), b AS (WITH {_BEND} SELECT series, min(ssr) AS b FROM scan GROUP BY 1) SELECT series, CASE WHEN a <= b THEN 'step' ELSE 'bend' END AS shape, round(1 - least(a, b) / greatest(a, b), 6) AS gain FROM s JOIN b USING (series)")
def step_or_bend(spark, sf_dir):
    m = _monthly(spark, sf_dir)
    race = L.shape_race(L.break_scan(m, "series", "date", "y"), L.break_scan(m, "series", "date", "y", bend=True), "series")
    return race.select("series", "shape", r("gain").alias("gain"))


@query(f"""WITH {_M}, x AS (SELECT series, i, y, (i >= 40)::INT::DOUBLE AS x FROM k), s AS (SELECT series, count(*) AS n, avg(x) AS mx, avg(y) AS my, regr_sxx(y, x) AS sxx, regr_sxy(y, x) AS sxy, regr_syy(y, x) AS syy FROM x GROUP BY 1),
u AS (SELECT series, i, n, sxx, sxy / sxx AS beta, (syy - sxy * sxy / sxx) / (n - 2) / sxx AS v, (x - mx) * (y - my - sxy / sxx * (x - mx)) AS u FROM x JOIN s USING (series)), l AS (SELECT *, lag(u, 1) OVER w AS a, lag(u, 2) OVER w AS b, lag(u, 3) OVER w AS c FROM u WINDOW w AS (PARTITION BY series ORDER BY i))
SELECT series, round(any_value(beta), 6) AS beta, round(sqrt(any_value(v)), 6) AS se_ols, round(sqrt((sum(u * u) + 1.5 * sum(u * a) + 1.0 * sum(u * b) + 0.5 * sum(u * c)) * any_value(n / (n - 2) / sxx / sxx)), 6) AS se_hac, any_value(n) AS n FROM l GROUP BY 1""")
def hac_step_test(spark, sf_dir):
    from tallyloom.operators.resample import numbered

    x = numbered(_monthly(spark, sf_dir), "series", "date", "i").withColumn("x", (F.col("i") >= 40).cast("double"))
    h = L.hac_step(x, "series", "date", "x", "y", 3)
    return h.select("series", r("beta").alias("beta"), r("se_ols").alias("se_ols"), r("se_hac").alias("se_hac"), "n")
