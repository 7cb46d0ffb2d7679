"""Queries of studies of small learners."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions.hashing import md5_share
from tallyloom.operators import learners as K
from tallyloom.operators import resample as R

from .base import SCORED, binned, r, scored, table
from .q_resample import _poisson, _u
from .registry import query

_MONTHS = "o AS (SELECT (year(o_orderdate) - 1995) * 12 + month(o_orderdate) AS t, (o_custkey % 100)::DOUBLE AS x, o_totalprice / 1000 AS y FROM orders)"


def _policy(name: str, delay: int, on: str) -> str:
    return f"""SELECT '{name}' AS policy, {delay} AS delay, t AS period, avg((y - a - b * x) ** 2) AS mse FROM o JOIN (SELECT p.t, coalesce(regr_slope(y, x), 0) AS b, avg(y) - coalesce(regr_slope(y, x), 0) * avg(x) AS a FROM p JOIN o ON {on} WHERE p.t >= p.s + 12 + {delay} GROUP BY 1) USING (t) GROUP BY 3"""


@query(f"""WITH {_MONTHS}, p AS (SELECT DISTINCT t, min(t) OVER () AS s FROM o), f AS ({' UNION ALL '.join(_policy(n, d, on) for d in (0, 6) for n, on in (('static', 'o.t < p.s + 12'), ('expanding', f'o.t < p.t - {d}'), ('window 6', f'o.t BETWEEN p.t - 6 - {d} AND p.t - 1 - {d}')))})
SELECT policy, delay, period, round(mse, 3) AS mse FROM f""")
def retraining_policies(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(((F.year("o_orderdate") - 1995) * 12 + F.month("o_orderdate")).alias("t"), (F.col("o_custkey") % 100).cast("double").alias("x"), (F.col("o_totalprice") / 1000).alias("y"))
    return K.retraining(o, "t", "x", "y", 12, [0, 6], [6]).select("policy", "delay", "period", r("mse", 3).alias("mse"))


@query(f"""WITH {SCORED}, d AS (SELECT g, p AS x, y::DOUBLE AS y, floor({_u("'stack:' || id")} * 4)::INT AS fold FROM scored), l AS (SELECT g, sum(y) AS s, count(*) AS n FROM d GROUP BY 1), lf AS (SELECT g, fold, sum(y) AS s, count(*) AS n FROM d GROUP BY 1, 2),
f AS (SELECT k.fold, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, avg(y) AS m FROM (SELECT DISTINCT fold FROM d) k JOIN d ON d.fold <> k.fold GROUP BY 1), w AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM d),
e AS (SELECT y, l.s / l.n AS mi, w.a + w.b * x AS li, CASE WHEN l.n > lf.n THEN (l.s - lf.s) / (l.n - lf.n) ELSE f.m END AS mo, f.a + f.b * x AS lo FROM d JOIN l USING (g) JOIN lf USING (g, fold) JOIN f USING (fold), w),
c AS (SELECT 'in sample' AS trained_on, sum(mi * mi) AS mm, sum(mi * li) AS ml, sum(li * li) AS ll, sum(mi * y) AS my, sum(li * y) AS ly FROM e UNION ALL SELECT 'out of fold', sum(mo * mo), sum(mo * lo), sum(lo * lo), sum(mo * y), sum(lo * y) FROM e),
u AS (SELECT trained_on, (my * ll - ly * ml) / (mm * ll - ml * ml) AS wm, (ly * mm - my * ml) / (mm * ll - ml * ml) AS wl FROM c UNION ALL SELECT 'average', 0.5, 0.5)
SELECT trained_on, round(any_value(wm), 5) AS w_level, round(any_value(wl), 5) AS w_line, round(avg((y - wm * mo - wl * lo) ** 2), 6) AS mse FROM e, u GROUP BY 1""")
def stacking(spark, sf_dir):
    d = scored(spark, sf_dir).withColumn("fold", F.floor(md5_share(R.key("stack", "id")) * 4).cast("int"))
    return K.stacking(d, "g", "p", "y", "fold").select("trained_on", r("w_level", 5).alias("w_level"), r("w_line", 5).alias("w_line"), r("mse").alias("mse"))


@query("""WITH l AS (SELECT l_quantity AS x, l_extendedprice / 1000 AS y FROM lineitem), f AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a, avg(y) FILTER (x > 15) AS m FROM l WHERE x <= 25)
SELECT CASE WHEN x <= 25 THEN 0 ELSE ceil((x - 25) / 10) END::INT AS band, count(*) AS n, round(avg((y - a - b * x) ** 2), 4) AS line, round(avg((y - m) ** 2), 4) AS level FROM l, f GROUP BY 1""")
def extrapolation_bands(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"))
    return K.extrapolation_bands(l, "x", "y", 25.0, 10.0).select("band", "n", r("line", 4).alias("line"), r("level", 4).alias("level"))


@query("""WITH RECURSIVE c AS (SELECT l_returnflag AS g, corr(l_quantity, l_discount) AS r, covar_pop(l_quantity, y) / stddev_pop(l_quantity) AS ca, covar_pop(l_discount, y) / stddev_pop(l_discount) AS cb FROM (SELECT *, l_extendedprice / 10000 AS y FROM lineitem) GROUP BY 1),
s AS (SELECT g, alpha, 0 AS i, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b FROM c, (VALUES (0.0::DOUBLE), (0.001::DOUBLE), (0.1::DOUBLE), (1.0::DOUBLE), (9.0::DOUBLE)) t(alpha)
 UNION ALL SELECT g, alpha, i + 1, na, sign(cb - r * na) * greatest(abs(cb - r * na) - alpha, 0) FROM (SELECT s.*, r, cb, sign(ca - r * b) * greatest(abs(ca - r * b) - alpha, 0) AS na FROM s JOIN c USING (g) WHERE i < 200))
SELECT g, alpha, unnest(['l_quantity', 'l_discount']) AS term, round(unnest([a, b]), 6) + 0.0 AS beta FROM s WHERE i = 200""")
def lasso_path(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").withColumns({"g": F.col("l_returnflag"), "y": F.col("l_extendedprice") / 10000})
    return K.lasso_path(l, "g", ["l_quantity", "l_discount"], "y", [0.0, 0.001, 0.1, 1.0, 9.0]).select("g", "alpha", "term", (r("beta") + 0.0).alias("beta"))


_N = "exp(-((v - {m}) ** 2) / (2 * {s})) / sqrt(2 * pi() * {s})"


@query(f"""WITH RECURSIVE d AS (SELECT round(o_totalprice / 1000, 0) AS v, count(*)::DOUBLE AS n FROM orders GROUP BY 1), t AS (SELECT sum(n) AS n, sum(n * v) / sum(n) AS m, sum(n * v * v) / sum(n) - (sum(n * v) / sum(n)) ** 2 AS s FROM d),
h AS (SELECT sum(d.n * v) FILTER (v < m) / sum(d.n) FILTER (v < m) AS lo, sum(d.n * v) FILTER (v >= m) / sum(d.n) FILTER (v >= m) AS hi FROM d, t),
e AS (SELECT 0 AS i, 0.5::DOUBLE AS w1, lo AS m1, s AS s1, 0.5::DOUBLE AS w2, hi AS m2, s AS s2 FROM h, t UNION ALL
 SELECT i + 1, a0 / tot, a1 / a0, a2 / a0 - (a1 / a0) ** 2, b0 / tot, b1 / b0, b2 / b0 - (b1 / b0) ** 2 FROM (SELECT i, any_value(tot) AS tot, sum(n * r) AS a0, sum(n * r * v) AS a1, sum(n * r * v * v) AS a2, sum(n * (1 - r)) AS b0, sum(n * (1 - r) * v) AS b1, sum(n * (1 - r) * v * v) AS b2
  FROM (SELECT i, d.n, v, t.n AS tot, w1 * {_N.format(m='m1', s='s1')} / (w1 * {_N.format(m='m1', s='s1')} + w2 * {_N.format(m='m2', s='s2')}) AS r FROM e, d, t WHERE i < 15) GROUP BY i)),
z AS (SELECT d.n, v, w1 * {_N.format(m='m1', s='s1')} AS a, w2 * {_N.format(m='m2', s='s2')} AS b, {_N.format(m='t.m', s='t.s')} AS one FROM d, t, e WHERE i = 15),
l AS (SELECT sum(n * ln(one)) AS one, sum(n * ln(a + b)) AS two, -sum(n * (CASE WHEN a > 0 THEN a / (a + b) * ln(a / (a + b)) ELSE 0 END + CASE WHEN b > 0 THEN b / (a + b) * ln(b / (a + b)) ELSE 0 END)) AS ent, sum(n) AS n FROM z)
SELECT 1 AS k, round(one, 2) AS log_likelihood, round(-2 * one + 2 * ln(n), 2) AS bic, round(-2 * one + 2 * ln(n), 2) AS icl FROM l UNION ALL SELECT 2, round(two, 2), round(-2 * two + 5 * ln(n), 2), round(-2 * two + 5 * ln(n) + 2 * ent, 2) FROM l""")
def mixture_order(spark, sf_dir):
    m = K.mixture_order(table(spark, sf_dir, "orders").withColumn("v", F.col("o_totalprice") / 1000), "v", 15, 0)
    return m.select("k", *[r(c, 2).alias(c) for c in ("log_likelihood", "bic", "icl")])


@query(f"""WITH p AS (SELECT p_size::DOUBLE AS x, p_retailprice AS y, {_u("'mono:' || p_partkey")} < 0.5 AS used FROM part), b AS (SELECT 1 AS g, x AS score, count(*) AS n, sum(y) AS s FROM p WHERE used GROUP BY 2),
c AS (SELECT a.score AS f, z.score AS e, sum(m.s) / sum(m.n) AS mean FROM b a JOIN b z ON z.score >= a.score JOIN b m ON m.score BETWEEN a.score AND z.score GROUP BY 1, 2),
i AS (SELECT score AS x, max(low) AS monotone FROM (SELECT b.score, c.f, min(c.mean) AS low FROM b JOIN c ON c.f <= b.score AND c.e >= b.score GROUP BY 1, 2) GROUP BY 1), e AS (SELECT p.*, monotone, b.s / b.n AS free FROM p JOIN i USING (x) JOIN b ON b.score = p.x)
SELECT 'free' AS fit, round(avg((y - free) ** 2) FILTER (used), 3) AS train, round(avg((y - free) ** 2) FILTER (NOT used), 3) AS test FROM e UNION ALL SELECT 'monotone', round(avg((y - monotone) ** 2) FILTER (used), 3), round(avg((y - monotone) ** 2) FILTER (NOT used), 3) FROM e""")
def monotone_cost(spark, sf_dir):
    return K.monotone_cost(table(spark, sf_dir, "part"), "p_partkey", "p_size", "p_retailprice", 0.5, "mono").select("fit", r("train", 3).alias("train"), r("test", 3).alias("test"))


@query("""WITH l AS (SELECT l_quantity AS x, l_extendedprice / 1000 AS y FROM lineitem), f AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM l), e AS (SELECT x, y, y - a - b * x AS e FROM l, f), m AS (SELECT quantile_cont(abs(e), 0.5) AS mad FROM e),
w AS (SELECT rule, s, x, y * s AS y, least(1, CASE WHEN rule = 'fixed' THEN 1.5::DOUBLE ELSE 1.5::DOUBLE * mad * s END / greatest(abs(e * s), 1e-300)) AS w FROM e, m, (VALUES ('fixed'), ('relative')) k(rule), (VALUES (0.1::DOUBLE), (1.0::DOUBLE), (10.0::DOUBLE)) t(s)),
g AS (SELECT rule, s AS scale, (sum(w * x * y) - sum(w * x) * sum(w * y) / sum(w)) / (sum(w * x * x) - sum(w * x) ** 2 / sum(w)) / s AS slope FROM w GROUP BY rule, s)
SELECT rule, scale, round(slope, 6) AS slope, round(abs(slope / max(slope) FILTER (scale = 1) OVER (PARTITION BY rule) - 1), 6) AS gap FROM g""")
def scale_equivariance(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"))
    return K.scale_equivariance(l, "x", "y", [0.1, 1.0, 10.0], 1.5).select("rule", "scale", r("slope").alias("slope"), r("gap").alias("gap"))


def _normal(part: str) -> str:
    text = f"'scale:{part}:' || rep || ':' || id"
    return f"sqrt(-2 * ln(1 - {_u(text + chr(32) + '||' + chr(32) + chr(39) + ':a' + chr(39))})) * cos(2 * pi() * {_u(text + chr(32) + '||' + chr(32) + chr(39) + ':b' + chr(39))})"


@query(f"""WITH d AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_extendedprice - 35000 AS x, (l_discount - 0.05) * 1000000 AS y, l_quantity AS s FROM lineitem), k AS (SELECT corr(x / s, y / s) AS rho, quantile_cont(s, 0.9) AS cut FROM d), t AS (SELECT d.* FROM d, k WHERE s > cut),
z AS (SELECT rep, s, {_normal('a')} AS a, {_normal('b')} AS b FROM t, range(10) u(rep)), r AS (SELECT rep, corr(s * a, s * (rho * a + sqrt(1 - rho * rho) * b)) AS r FROM z, k GROUP BY 1)
SELECT round((SELECT corr(x, y) FROM t), 6) AS turbulent, round(avg(r), 6) AS under_null, round(avg((r >= (SELECT corr(x, y) FROM t))::INT), 6) AS p FROM r""")
def scale_null(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    d = l.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_extendedprice") - 35000).alias("x"), ((F.col("l_discount") - 0.05) * 1000000).alias("y"), F.col("l_quantity").alias("s"))
    return K.scale_null(d, "id", "x", "y", "s", 0.9, 10, "scale").select(*[r(c).alias(c) for c in ("turbulent", "under_null", "p")])


@query("""WITH c AS (SELECT l_returnflag AS g, count(*) AS n, corr(l_quantity, l_extendedprice) AS r FROM lineitem GROUP BY 1), s AS (SELECT g, n, sqrt(n * (1 + abs(r))) AS a, sqrt(n * (1 - abs(r))) AS b, 2 / n AS beta FROM c),
t AS (SELECT *, sqrt(2 * (beta + 1) + 8 * beta / (beta + 1 + sqrt(beta * beta + 14 * beta + 1))) * sqrt(n) * 0.8 AS hard FROM s)
SELECT g, round(a, 5) AS first, round(b, 5) AS second, 0 AS elbow, (a > 0.8 * (sqrt(n) + sqrt(2)))::INT + (b > 0.8 * (sqrt(n) + sqrt(2)))::INT AS edge, (a > hard)::INT + (b > hard)::INT AS hard, n FROM t""")
def rank_rules(spark, sf_dir):
    k = K.rank_rules(table(spark, sf_dir, "lineitem").withColumn("g", F.col("l_returnflag")), "g", ["l_quantity", "l_extendedprice"], 0.8)
    return k.select("g", r(F.get("singular", F.lit(0)), 5).alias("first"), r(F.get("singular", F.lit(1)), 5).alias("second"), "elbow", "edge", "hard", "n")


@query("""WITH g AS (SELECT o_orderpriority AS source, avg(o_totalprice) / 1000 - 150 AS effect, stddev_samp(o_totalprice) / 1000 AS noise, count(*) AS n FROM orders GROUP BY 1)
SELECT source, round((1.96::DOUBLE / (effect / noise)) ** 2, 3) AS implied_n, round(n / (1 + (n - 1) * 0.1::DOUBLE), 5) AS independent, round(effect / noise * sqrt(252), 5) AS annual_ratio, round(abs(effect), 5) AS breakeven FROM g""")
def reported_result_audit(spark, sf_dir):
    g = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("source")).agg((F.avg("o_totalprice") / 1000 - 150).alias("effect"), (F.stddev_samp("o_totalprice") / 1000).alias("noise"), F.count("*").alias("n"))
    a = K.result_audit(g.withColumns({"z": F.lit(1.96), "rho": F.lit(0.1)}), ["source"], "effect", "noise", "z", "n", "rho", 252.0)
    return a.select("source", r("implied_n", 3).alias("implied_n"), *[r(c, 5).alias(c) for c in ("independent", "annual_ratio", "breakeven")])


@query("""WITH c AS (SELECT l_returnflag AS g, corr(l_quantity, l_discount) AS r, corr(l_quantity, l_extendedprice) AS a, corr(l_discount, l_extendedprice) AS b FROM lineitem GROUP BY 1), f AS (SELECT *, (a - r * b) / (1 - r * r) AS ba, (b - r * a) / (1 - r * r) AS bb FROM c)
SELECT g, unnest(['l_quantity', 'l_discount']) AS term, round(unnest([a * ba + b * bb - b * b, a * ba + b * bb - a * a]), 6) + 0.0 AS "drop", round(unnest([2 * ba * ba, 2 * bb * bb]), 6) AS permuted, round(unnest([a * a, b * b]), 6) AS squared_r FROM f""")
def feature_importances(spark, sf_dir):
    i = K.feature_importances(table(spark, sf_dir, "lineitem").withColumn("g", F.col("l_returnflag")), "g", ["l_quantity", "l_discount"], "l_extendedprice")
    return i.select("g", "term", (r("drop") + 0.0).alias("drop"), r("permuted").alias("permuted"), r("squared_r").alias("squared_r"))


@query(f"""WITH d AS (SELECT p_partkey AS id, p_size::DOUBLE AS a, p_retailprice / 20 AS b FROM part), t AS (SELECT 0.5 * atan2(2 * covar_pop(a, b), var_pop(a) - var_pop(b)) AS whole, avg(a) AS ma, avg(b) AS mb FROM d),
u AS (SELECT rep::INT AS rep, a - ma AS a, b - mb AS b, whole, {_u("'turn:' || rep || ':' || id")} AS u FROM d, t, range(20) v(rep)), w AS (SELECT *, {_poisson('u')} AS w FROM u),
g AS (SELECT rep, any_value(whole) AS whole, sum(w * a * a) / sum(w) - (sum(w * a) / sum(w)) ** 2 AS p, sum(w * a * b) / sum(w) - sum(w * a) * sum(w * b) / sum(w) ** 2 AS q, sum(w * b * b) / sum(w) - (sum(w * b) / sum(w)) ** 2 AS r FROM w GROUP BY 1),
e AS (SELECT rep, (p + r) / 2 AS m, sqrt(((p - r) / 2) ** 2 + q * q) AS h, abs(0.5 * atan2(2 * q, p - r) - whole) AS turn FROM g)
SELECT rep, round(m + h, 5) AS first, round(m - h, 5) AS second, round(degrees(least(turn, pi() - turn)), 5) AS angle FROM e""")
def component_stability(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("a"), (F.col("p_retailprice") / 20).alias("b"))
    return K.component_stability(p, "id", "a", "b", 20, "turn").select("rep", *[r(c, 5).alias(c) for c in ("first", "second", "angle")])


@query(f"""WITH {SCORED}, d AS (SELECT id, round(p, 2) AS a, id % 17 AS b, y FROM scored), u AS (SELECT rep::INT AS rep, a, b, y, {_u("'stump:' || rep || ':' || id")} AS u FROM d, range(20) t(rep)), w AS (SELECT *, {_poisson('u')} AS w FROM u),
l AS (SELECT rep, 'a' AS feature, a AS v, w, y FROM w WHERE w > 0 UNION ALL SELECT rep, 'b', b, w, y FROM w WHERE w > 0), g AS (SELECT rep, feature, v, sum(w)::DOUBLE AS n, sum(w * y)::DOUBLE AS s FROM l GROUP BY 1, 2, 3),
c AS (SELECT rep, feature, v, sum(n) OVER o AS ln, sum(s) OVER o AS ls, sum(n) OVER (PARTITION BY rep, feature) AS n, sum(s) OVER (PARTITION BY rep, feature) AS s FROM g WINDOW o AS (PARTITION BY rep, feature ORDER BY v ROWS UNBOUNDED PRECEDING)),
k AS (SELECT rep, feature, v, round((2 * s * (n - s) / n - 2 * ls * (ln - ls) / ln - 2 * (s - ls) * (n - ln - s + ls) / (n - ln)) / n, 9) AS gain FROM c WHERE ln < n),
b AS (SELECT rep, feature, v::DOUBLE AS split, gain FROM k QUALIFY row_number() OVER (PARTITION BY rep, feature ORDER BY gain DESC, v) = 1)
SELECT rep, feature, split, round(gain, 6) AS gain, row_number() OVER (PARTITION BY rep ORDER BY gain DESC, feature) = 1 AS root FROM b""")
def stump_bootstrap(spark, sf_dir):
    s = scored(spark, sf_dir).select("id", binned("p", 2).alias("a"), (F.col("id") % 17).alias("b"), "y")
    return K.stump_bootstrap(s, "id", ["a", "b"], "y", 20, "stump").select("rep", "feature", "split", r("gain").alias("gain"), "root")


def _phi(z: str) -> str:
    """The normal distribution function by Simpson's rule over 400 steps."""
    return f"(0.5 + ({z}) / 1200 / sqrt(2 * pi()) * list_sum(list_transform(range(0, 401), lambda i: CASE WHEN i IN (0, 400) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-(({z}) * i / 400) ** 2 / 2))))".replace("exp(-((", "exp(-1 * ((")


@query(f"""WITH o AS (SELECT o_orderpriority AS cohort, round(o_totalprice / 1000000, 2) AS junior, 0.4::DOUBLE + (o_custkey % 3) / 10.0::DOUBLE AS senior, count(*) AS n FROM orders WHERE round(o_totalprice / 1000000, 2) > 0 GROUP BY 1, 2, 3),
d AS (SELECT *, (senior + junior) / 0.9::DOUBLE AS k, senior / 0.9::DOUBLE AS l, 0.2::DOUBLE * sqrt(2.0::DOUBLE) AS s, (0.01::DOUBLE - 0.02::DOUBLE) * 2 AS m FROM o), z AS (SELECT *, (ln(k) - m) / s AS zk, (ln(l) - m) / s AS zl FROM d),
p AS (SELECT *, {_phi('zk')} AS pk, {_phi('zk - s')} AS qk, {_phi('zl')} AS pl, {_phi('zl - s')} AS ql FROM z),
e AS (SELECT *, greatest(0, (senior + junior) * pk - 0.9 * exp(0.02::DOUBLE) * qk - senior * pl + 0.9 * exp(0.02::DOUBLE) * ql) AS loss FROM p)
SELECT cohort, sum(n)::BIGINT AS loans, round(sum(n * junior * k) / sum(n * junior), 5) AS attachment, round(sum(n * junior * 100 * (1 - k)) / sum(n * junior), 4) AS required_fall, round(sum(n * junior * 100 * pk) / sum(n * junior), 4) AS breach, round(sum(n * 100 * loss / 2) / sum(n * junior), 4) AS loss_per_year FROM e GROUP BY 1""")
def collateral_stress(spark, sf_dir):
    junior, senior = F.round(F.col("o_totalprice") / 1000000, 2), 0.4 + (F.col("o_custkey") % 3) / 10.0
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("cohort"), junior.alias("junior"), senior.alias("senior")).agg(F.count("*").alias("n")).withColumn("recovery", F.lit(0.9))
    c = K.collateral_stress(o, ["cohort", "junior", "n"], "junior", "senior", "recovery", 0.2, 0.01, 2.0)
    mean = lambda x, digits: F.round(F.sum(F.col("n") * F.col("junior") * F.col(x)) / F.sum(F.col("n") * F.col("junior")), digits).alias(x)
    return c.groupBy("cohort").agg(F.sum("n").alias("loans"), mean("attachment", 5), *[mean(x, 4) for x in ("required_fall", "breach", "loss_per_year")])


@query(f"""WITH RECURSIVE {SCORED}, d AS (SELECT least(19, floor(p * 20))::INT AS bin, {_u("'boost:part:' || id")} < 0.6 AS train, CASE WHEN {_u("'boost:part:' || id")} < 0.6 AND {_u("'boost:flip:' || id")} < 0.1 THEN 1 - y ELSE y END AS y FROM scored),
g AS (SELECT b, t.train, coalesce(count(d.y), 0) AS n, coalesce(sum(d.y), 0)::DOUBLE AS s FROM range(20) k(b) CROSS JOIN (VALUES (true), (false)) t(train) LEFT JOIN d ON d.bin = b AND d.train = t.train GROUP BY 1, 2),
l AS (SELECT list(n ORDER BY b) FILTER (train) AS n, list(s ORDER BY b) FILTER (train) AS s, list(n ORDER BY b) FILTER (NOT train) AS m, list(s ORDER BY b) FILTER (NOT train) AS z FROM g),
r AS (SELECT 0 AS k, list_transform(range(20), lambda i: 0.0::DOUBLE) AS f UNION ALL
 SELECT k + 1, list_transform(range(1, 21), lambda i: f[i] + 0.3::DOUBLE * CASE WHEN i <= at_ THEN lft[at_] / sz[at_] ELSE (lft[20] - lft[at_]) / (sz[20] - sz[at_]) END) FROM (SELECT *, list_position(gain, list_max(gain)) AS at_ FROM (
  SELECT k, f, lft, sz, list_transform(range(1, 20), lambda j: CASE WHEN sz[j] > 0 AND sz[j] < sz[20] THEN round(lft[j] ** 2 / sz[j] + (lft[20] - lft[j]) ** 2 / (sz[20] - sz[j]), 9) ELSE -1 END) AS gain FROM (
   SELECT k, f, list_transform(range(1, 21), lambda j: list_sum(list_transform(range(1, j + 1), lambda i: s[i] - n[i] * f[i]))) AS lft, list_transform(range(1, 21), lambda j: list_sum(n[1:j])) AS sz FROM r, l WHERE k < 15))))
SELECT k AS round, round(list_sum(list_transform(range(1, 21), lambda i: s[i] - 2 * f[i] * s[i] + n[i] * f[i] * f[i])) / list_sum(n), 6) AS train, round(list_sum(list_transform(range(1, 21), lambda i: z[i] - 2 * f[i] * z[i] + m[i] * f[i] * f[i])) / list_sum(m), 6) AS test FROM r, l""")
def boosting_curve(spark, sf_dir):
    return K.boosting_curve(scored(spark, sf_dir), "id", "p", "y", 20, 15, 0.3, 0.1, 0.6, "boost").select("round", r("train").alias("train"), r("test").alias("test"))
