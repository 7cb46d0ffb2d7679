"""Queries of chosen penalties and of logistic recalibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import regularised as G

from .base import SCORED, r, scored, table
from .q_resample import _u
from .registry import query

_STEP = "n * (1 / (1 + exp(-(a + b * z))))"


@query(f"""WITH RECURSIVE {SCORED}, d AS MATERIALIZED (SELECT g, ln(p / (1 - p)) AS z, count(*)::DOUBLE AS n, sum(y)::DOUBLE AS s FROM scored WHERE p > 0 AND p < 1 AND y IS NOT NULL GROUP BY 1, 2),
e AS (SELECT DISTINCT g, 0 AS i, 0.0::DOUBLE AS a, 1.0::DOUBLE AS b FROM d UNION ALL
 SELECT g, i + 1, a + (bb * u - ab * v) / (aa * bb - ab * ab), b + (aa * v - ab * u) / (aa * bb - ab * ab) FROM (
  SELECT g, i, a, b, sum(l) - 1e-6 * a AS u, sum(l * z) - 1e-6 * b AS v, sum(w) + 1e-6 AS aa, sum(w * z) AS ab, sum(w * z * z) + 1e-6 AS bb FROM (
   SELECT e.g, i, a, b, z, s - {_STEP} AS l, {_STEP} * (1 - 1 / (1 + exp(-(a + b * z)))) AS w FROM e JOIN d ON d.g = e.g WHERE i < 8) GROUP BY g, i, a, b))
SELECT g, sum(n)::BIGINT AS n, round(any_value(a), 5) AS intercept, round(any_value(b), 5) AS slope, round(sum(n * ln(1 + exp(z)) - s * z) / sum(n), 6) AS raw, round(sum(n * ln(1 + exp(a + b * z)) - s * (a + b * z)) / sum(n), 6) AS calibrated FROM d JOIN e USING (g) WHERE i = 8 GROUP BY g""")
def platt_recalibration(spark, sf_dir):
    c = G.platt(scored(spark, sf_dir), "g", "p", "y")
    return c.select("g", "n", r("intercept", 5).alias("intercept"), r("slope", 5).alias("slope"), r("raw").alias("raw"), r("calibrated").alias("calibrated"))


ALPHAS, FOLDS = [0.001, 0.03, 0.1, 0.3, 1.0, 3.0], 5
_CV = f"""t AS MATERIALIZED (SELECT l_quantity::DOUBLE AS x, l_discount::DOUBLE AS z, l_extendedprice / 10000 AS y, floor({_u("'lasso:' || l_orderkey")} * {FOLDS})::INT AS f FROM lineitem),
c AS (SELECT k AS f, avg(x) AS mx, avg(z) AS mz, avg(y) AS my, stddev_pop(x) AS sx, stddev_pop(z) AS sz, corr(x, z) AS r, covar_pop(x, y) / stddev_pop(x) AS ca, covar_pop(z, y) / stddev_pop(z) AS cb FROM t JOIN range(-1, {FOLDS}) q(k) ON t.f <> k GROUP BY 1),
s AS (SELECT f, alpha, 0 AS i, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b FROM c, (SELECT unnest({ALPHAS}::DOUBLE[]) AS alpha)
 UNION ALL SELECT f, alpha, i + 1, na, sign(cb - r * na) * greatest(abs(cb - r * na) - alpha, 0) FROM (SELECT s.*, r, cb, sign(ca - r * b) * greatest(abs(ca - r * b) - alpha, 0) AS na FROM s JOIN c USING (f) WHERE i < 200)),
fit AS MATERIALIZED (SELECT s.*, mx, mz, my, sx, sz FROM s JOIN c USING (f) WHERE i = 200),
m AS (SELECT alpha, avg(e) AS mse, stddev_pop(e) / sqrt({FOLDS}) AS error FROM (SELECT alpha, f, avg((y - my - a * (x - mx) / sx - b * (z - mz) / sz) ** 2) AS e FROM fit JOIN t USING (f) GROUP BY 1, 2) GROUP BY 1),
best AS (SELECT * FROM m ORDER BY round(mse, 9), alpha DESC LIMIT 1), wide AS (SELECT max(m.alpha) AS alpha FROM m, best WHERE m.mse <= best.mse + best.error)"""


def _chosen(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").withColumn("y", F.col("l_extendedprice") / 10000)
    return G.chosen_lasso(l, "l_orderkey", ["l_quantity", "l_discount"], "y", ALPHAS, FOLDS, "lasso")


@query(f"WITH RECURSIVE {_CV} SELECT alpha, round(mse, 6) AS mse, round(error, 6) AS error, alpha = (SELECT alpha FROM best) AS least, alpha = (SELECT alpha FROM wide) AS one_error FROM m")
def lasso_choice(spark, sf_dir):
    c = _chosen(spark, sf_dir)[0]
    return c.select("alpha", r("mse").alias("mse"), r("error").alias("error"), "least", "one_error")


@query(f"""WITH RECURSIVE {_CV}, rule AS (SELECT 'least' AS rule, alpha FROM best UNION ALL SELECT 'one error', alpha FROM wide), long AS (SELECT rule, f, unnest(['l_quantity', 'l_discount']) AS term, round(unnest([a, b]), 12) AS beta FROM rule JOIN fit USING (alpha))
SELECT rule, term, round(max(beta) FILTER (f = -1), 6) + 0.0 AS beta, count(*) FILTER (f >= 0 AND beta > 0) AS positive, count(*) FILTER (f >= 0 AND beta < 0) AS negative, count(*) FILTER (f >= 0 AND beta = 0) AS zero FROM long GROUP BY 1, 2""")
def lasso_signs(spark, sf_dir):
    return _chosen(spark, sf_dir)[1].withColumn("beta", r("beta") + 0.0)


_DOMAIN = """d AS MATERIALIZED (SELECT o_orderkey AS id, o_totalprice / 100000 AS x, (year(o_orderdate) >= 1999 OR o_totalprice > 280000)::INT AS y FROM orders),
t AS MATERIALIZED (SELECT id, y, (x - (SELECT avg(x) FROM d)) / (SELECT stddev_pop(x) FROM d) AS z FROM d),
e AS (SELECT 0 AS i, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b UNION ALL SELECT i + 1, a + (bb * u - ab * v) / (aa * bb - ab * ab), b + (aa * v - ab * u) / (aa * bb - ab * ab) FROM (
 SELECT i, a, b, sum(y - p) - 1e-6 * a AS u, sum((y - p) * z) - 1e-6 * b AS v, sum(p * (1 - p)) + 1e-6 AS aa, sum(p * (1 - p) * z) AS ab, sum(p * (1 - p) * z * z) + 1e-6 AS bb FROM (SELECT i, a, b, y, z, 1 / (1 + exp(-(a + b * z))) AS p FROM e, t WHERE i < 8) GROUP BY i, a, b))"""


@query(f"WITH RECURSIVE {_DOMAIN} SELECT id, round(exp(a + b * z) * (SELECT sum(1 - y) / sum(y) FROM t), 6) AS weight FROM t, e WHERE i = 8 AND y = 0")
def classifier_weights(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") / 100000).alias("x"), ((F.year("o_orderdate") >= 1999) | (F.col("o_totalprice") > 280000)).alias("new"))
    return G.domain_weights(o, "o_orderkey", ["x"], "new").select("id", r("weight").alias("weight"))
