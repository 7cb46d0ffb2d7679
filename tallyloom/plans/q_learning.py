"""Queries of data work around models."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyloom.operators import learning as M

from .base import SCORED, r, scored, table
from .registry import query


@query("WITH p AS (SELECT p_brand AS level, (p_size > 25)::INT AS y FROM part), m AS (SELECT avg(y) AS prior FROM p) SELECT level, round((sum(y) + 10 * any_value(prior)) / (count(*) + 10), 6) AS code FROM p, m GROUP BY 1")
def target_encoding(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("level"), (F.col("p_size") > 25).cast("int").alias("y"))
    return M.target_encoded(p, "level", "y", 10.0).select("level", r("code").alias("code"))


@query("""WITH p AS (SELECT p_partkey, p_brand AS level, p_partkey % 5 AS fold, (p_size > 25)::INT AS y FROM part), m AS (SELECT avg(y) AS prior FROM p), o AS (SELECT level, fold, sum(y) AS s, count(*) AS c FROM p GROUP BY 1, 2), t AS (SELECT level, fold, sum(s) OVER (PARTITION BY level) - s AS s, sum(c) OVER (PARTITION BY level) - c AS c FROM o)
SELECT p_partkey, round((s + 10 * prior) / (c + 10), 6) AS code FROM p JOIN t USING (level, fold), m""")
def cross_fitted_encoding(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("level"), (F.col("p_partkey") % 5).alias("fold"), (F.col("p_size") > 25).cast("int").alias("y"))
    return M.cross_fitted_encoding(p, "level", "y", "fold", 10.0).select("p_partkey", r("code").alias("code"))


@query("""WITH p AS (SELECT p_partkey, p_brand AS g, CASE WHEN p_partkey % 4 <> 0 THEN p_size END AS x FROM part), m AS (SELECT g, avg(x) AS m FROM p GROUP BY 1) SELECT p_partkey, round(coalesce(x, m), 6) AS x, x IS NULL AS x_missing FROM p JOIN m USING (g)""")
def mean_imputation(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("g"), F.when(F.col("p_partkey") % 4 != 0, F.col("p_size")).alias("x"))
    return M.imputed(p, ["x"], "g").select("p_partkey", r("x").alias("x"), "x_missing")


_VEC = "v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)"


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), "label")


def _neighbours(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return M.neighbours(v.filter("id % 50 = 0"), v, 5)


@query(f"WITH {_VEC}, d AS (SELECT a.vec_id AS query, b.vec_id AS id, list_distance(a.e, b.e) AS d FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0), k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(d, 9), id) AS rank FROM d) SELECT query, rank::INT AS rank, round(d, 4) AS d FROM k WHERE rank <= 5")
def nearest_neighbours(spark, sf_dir):
    return _neighbours(spark, sf_dir).select("query", "rank", r("d", 4).alias("d"))


@query(f"WITH {_VEC}, d AS (SELECT a.vec_id AS query, a.label AS l, b.label AS m, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_distance(a.e, b.e), 9), b.vec_id) AS k FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0) SELECT query, round(avg((l = m)::INT), 6) AS same_label FROM d WHERE k <= 5 GROUP BY 1")
def neighbour_label_share(spark, sf_dir):
    v = _vectors(spark, sf_dir).select("id", "label")
    n = _neighbours(spark, sf_dir).join(v, "id").join(v.select(F.col("id").alias("query"), F.col("label").alias("own")), "query")
    return n.groupBy("query").agg(r(F.avg((F.col("label") == F.col("own")).cast("double"))).alias("same_label"))


_CLUSTER = "c AS (SELECT vec_id, label, (embedding[1] > 0)::INT * 2 + (embedding[2] > 0)::INT AS c FROM embeddings)"


def _clusters(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select("label", ((F.get("embedding", F.lit(0)) > 0).cast("int") * 2 + (F.get("embedding", F.lit(1)) > 0).cast("int")).alias("c"))


@query(f"WITH {_CLUSTER}, n AS (SELECT c, label, count(*) AS n FROM c GROUP BY 1, 2) SELECT c, sum(n)::BIGINT AS size, arg_max(label, n * 1000 + label) AS label, round(max(n) / sum(n), 6) AS purity FROM n GROUP BY 1")
def cluster_purity(spark, sf_dir):
    return M.purity(_clusters(spark, sf_dir), "c", "label").select("c", "size", "label", r("purity").alias("purity"))


@query(f"""WITH {_CLUSTER}, n AS (SELECT c, label, count(*) AS n FROM c GROUP BY 1, 2), b AS (SELECT sum(n * (n - 1) / 2) AS b, sum(n) AS t FROM n), x AS (SELECT sum(n * (n - 1) / 2) AS x FROM (SELECT sum(n) AS n FROM n GROUP BY c)), y AS (SELECT sum(n * (n - 1) / 2) AS y FROM (SELECT sum(n) AS n FROM n GROUP BY label))
SELECT round((b - x * y / (t * (t - 1) / 2)) / ((x + y) / 2 - x * y / (t * (t - 1) / 2)), 6) AS ari FROM b, x, y""")
def adjusted_rand(spark, sf_dir):
    return M.adjusted_rand(_clusters(spark, sf_dir), "c", "label").select(r("ari").alias("ari"))


_DRIFT = "s AS (SELECT o_orderdate >= TIMESTAMP '1998-01-01' AS late, o_totalprice AS price, o_custkey::DOUBLE AS cust FROM orders), l AS (SELECT late, unnest(['price', 'cust']) AS feature, unnest([price, cust]) AS v FROM s)"


def _drift(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select((F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz")).alias("late"), F.col("o_totalprice").alias("price"), F.col("o_custkey").cast("double").alias("cust"), "o_orderpriority")


@query(f"""WITH {_DRIFT}, d AS (SELECT feature, v, sum((NOT late)::INT) AS a, sum(late::INT) AS b FROM l GROUP BY 1, 2), u AS (SELECT feature, sum(a) OVER w AS ua, sum(b) OVER w AS ub, sum(a) OVER (PARTITION BY feature) AS na, sum(b) OVER (PARTITION BY feature) AS nb FROM d WINDOW w AS (PARTITION BY feature ORDER BY v ROWS UNBOUNDED PRECEDING))
SELECT feature, round(max(abs(ua / na - ub / nb)), 6) AS ks, any_value(na)::BIGINT AS n0, any_value(nb)::BIGINT AS n1 FROM u GROUP BY 1""")
def drift_monitor(spark, sf_dir):
    return M.two_sample_ks(_drift(spark, sf_dir), "late", ["price", "cust"]).select("feature", r("ks").alias("ks"), "n0", "n1")


@query("SELECT o_orderpriority, count(*) FILTER (o_orderdate < TIMESTAMP '1998-01-01') AS before, count(*) FILTER (o_orderdate >= TIMESTAMP '1998-01-01') AS after FROM orders GROUP BY 1")
def label_shift(spark, sf_dir):
    return M.label_shift(_drift(spark, sf_dir), "late", "o_orderpriority")


_SURV = """g AS (SELECT o_custkey, date_diff('day', o_orderdate, coalesce(lead(o_orderdate) OVER w, TIMESTAMP '2001-08-01'))::DOUBLE AS t, lead(o_orderdate) OVER w IS NOT NULL AS e, (o_orderpriority < '3')::INT AS arm FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
c AS (SELECT t AS time, sum((e AND arm = 0)::INT) AS d0, sum((e AND arm = 1)::INT) AS d1, sum((arm = 0)::INT) AS c0, sum((arm = 1)::INT) AS c1 FROM g GROUP BY 1), k AS (SELECT time, d0, d1, sum(c0) OVER (ORDER BY time DESC ROWS UNBOUNDED PRECEDING) AS r0, sum(c1) OVER (ORDER BY time DESC ROWS UNBOUNDED PRECEDING) AS r1 FROM c)"""


def _survival(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    nxt = F.lead("o_orderdate").over(w)
    days = F.datediff(F.to_date(F.coalesce(nxt, F.lit("2001-08-01").cast("timestamp_ntz"))), F.to_date("o_orderdate"))
    return table(spark, sf_dir, "orders").select(days.cast("double").alias("t"), nxt.isNotNull().alias("e"), (F.col("o_orderpriority") < "3").cast("int").alias("arm"))


@query(f"WITH {_SURV} SELECT time, d0::BIGINT AS d0, d1::BIGINT AS d1, r0::BIGINT AS r0, r1::BIGINT AS r1 FROM k WHERE d0 + d1 > 0")
def risk_table(spark, sf_dir):
    return M.risk_table(_survival(spark, sf_dir), "t", "e", "arm")


@query(f"WITH {_SURV}, s AS (SELECT sum(d1) AS o, sum((d0 + d1) * r1 / (r0 + r1)) AS x, sum((d0 + d1) * (r1 / (r0 + r1)) * (1 - r1 / (r0 + r1))) AS i FROM k WHERE d0 + d1 > 0) SELECT o::BIGINT AS observed, round(x, 4) AS expected, round(i, 4) AS information, round((o - x) / sqrt(i), 6) AS z FROM s")
def log_rank(spark, sf_dir):
    l = M.log_rank(_survival(spark, sf_dir), "t", "e", "arm")
    return l.select("observed", r("expected", 4).alias("expected"), r("information", 4).alias("information"), r("z").alias("z"))


@query(f"""WITH RECURSIVE {_SURV}, v AS (SELECT d0, d1, r0, r1 FROM k WHERE d0 + d1 > 0), steps AS (SELECT 0 AS i, 0.0::DOUBLE AS beta, 0.0::DOUBLE AS se
 UNION ALL SELECT i + 1, beta + sum(d1 - (d0 + d1) * p) / sum((d0 + d1) * p * (1 - p)), 1 / sqrt(sum((d0 + d1) * p * (1 - p))) FROM (SELECT i, beta, d0, d1, r1 * exp(beta) / (r0 + r1 * exp(beta)) AS p FROM steps, v WHERE i < 15) GROUP BY i, beta)
SELECT round(arg_max(beta, i), 6) AS beta, round(arg_max(se, i), 6) AS se FROM steps""")
def cox_two_arm(spark, sf_dir):
    fit = spark.createDataFrame([M.cox_two_arm(_survival(spark, sf_dir), "t", "e", "arm")], "beta double, se double")
    return fit.select(r("beta").alias("beta"), r("se").alias("se"))


_ANC = "l AS (SELECT (l_returnflag = 'R')::INT AS g, l_extendedprice AS y, l_quantity AS x FROM lineitem), s AS (SELECT g, avg(y) AS my, avg(x) AS mx, avg(y / x) AS mr, regr_sxx(y, x) AS sxx, regr_sxy(y, x) AS sxy FROM l GROUP BY 1)"


@query(f"WITH {_ANC} SELECT round(max(my) FILTER (g = 1) - max(my) FILTER (g = 0), 4) AS total, round(max(mr) FILTER (g = 1) - max(mr) FILTER (g = 0), 4) AS ratio, round(max(my) FILTER (g = 1) - max(my) FILTER (g = 0) - sum(sxy) / sum(sxx) * (max(mx) FILTER (g = 1) - max(mx) FILTER (g = 0)), 4) AS adjusted FROM s")
def covariate_adjusted_difference(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("g"), F.col("l_extendedprice").alias("y"), F.col("l_quantity").alias("x"))
    a = M.ancova(l, "g", "y", "x")
    return a.select(*[r(c, 4).alias(c) for c in a.columns])


@query("WITH m AS (SELECT var_pop(l_quantity) AS xx, var_pop(l_discount) AS zz, covar_pop(l_quantity, l_discount) AS xz, covar_pop(l_quantity, l_extendedprice) AS xy, covar_pop(l_discount, l_extendedprice) AS zy FROM lineitem) SELECT round(xy / xx, 4) AS naive, round((xy * zz - zy * xz) / (xx * zz - xz * xz), 4) AS adjusted, round((zy * xx - xy * xz) / (xx * zz - xz * xz) * xz / xx, 4) AS bias FROM m")
def omitted_variable_bias(spark, sf_dir):
    a = M.adjusted_effect(table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_quantity", "l_discount")
    return a.select(*[r(c, 4).alias(c) for c in a.columns])


_COEF = {"l_quantity": 1000.0, "l_discount": -500.0}


@query("WITH m AS (SELECT avg(l_quantity) AS q, avg(l_discount) AS d FROM lineitem) SELECT l_orderkey * 10 + l_linenumber AS id, unnest(['l_quantity', 'l_discount']) AS feature, round(unnest([1000 * (l_quantity - q), -500 * (l_discount - d)]), 4) AS value FROM lineitem, m")
def linear_attribution(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").withColumn("id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return M.linear_attribution(l, "id", _COEF).select("id", "feature", r("value", 4).alias("value"))


def _predict(c):
    return c["p_size"] * 20.0 + c["p_retailprice"] * 0.5


@query("""WITH p AS (SELECT p_partkey AS i, p_size::DOUBLE AS a, p_retailprice AS b, p_size * 20.0::DOUBLE + p_retailprice AS y FROM part), base AS (SELECT avg((a * 20 + b * 0.5 - y) ** 2) AS e FROM p), n AS (SELECT *, row_number() OVER (ORDER BY i) AS k FROM p),
sa AS (SELECT rep, a AS s, row_number() OVER (PARTITION BY rep ORDER BY md5('imp:p_size:' || rep || ':' || i), i) AS k FROM p, range(3) t(rep)), sb AS (SELECT rep, b AS s, row_number() OVER (PARTITION BY rep ORDER BY md5('imp:p_retailprice:' || rep || ':' || i), i) AS k FROM p, range(3) t(rep)),
r AS (SELECT 'p_size' AS feature, rep, avg((s * 20 + b * 0.5 - y) ** 2) - (SELECT e FROM base) AS rise FROM n JOIN sa USING (k) GROUP BY 2 UNION ALL SELECT 'p_retailprice', rep, avg((a * 20 + s * 0.5 - y) ** 2) - (SELECT e FROM base) FROM n JOIN sb USING (k) GROUP BY 2)
SELECT feature, round(avg(rise), 3) AS importance, round(stddev_pop(rise), 3) AS sd FROM r GROUP BY 1""")
def permutation_importance(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice", (F.col("p_size") * 20.0 + F.col("p_retailprice")).alias("y"))
    i = M.permutation_importance(p, "p_partkey", ["p_size", "p_retailprice"], _predict, "y", 3, "imp")
    return i.select("feature", r("importance", 3).alias("importance"), r("sd", 3).alias("sd"))


@query("""SELECT g.v AS "at", round(avg(g.v * 20 + p_retailprice * 0.5), 4) AS mean FROM part, (SELECT unnest([1.0, 10.0, 25.0, 50.0])::DOUBLE AS v) g GROUP BY 1""")
def partial_dependence(spark, sf_dir):
    d = M.partial_dependence(table(spark, sf_dir, "part").select("p_retailprice"), "p_size", [1.0, 10.0, 25.0, 50.0], _predict, ["p_retailprice"])
    return d.select("at", r("mean", 4).alias("mean"))


_MEMBERS = f"{SCORED}, m AS (SELECT id, y, unnest(['a', 'b', 'c']) AS m, unnest([p, p * p, 1 - p]) AS p FROM scored)"


def _members(spark, sf_dir):
    s = scored(spark, sf_dir)
    p = F.col("p")
    return s.select("id", "y", F.explode(F.array(F.struct(F.lit("a").alias("m"), p.alias("p")), F.struct(F.lit("b").alias("m"), (p * p).alias("p")), F.struct(F.lit("c").alias("m"), (1 - p).alias("p")))).alias("x")).select("id", "y", "x.*")


@query(f"WITH {_MEMBERS}, g AS (SELECT id, y, avg(p) AS q, avg((p - y) ** 2) AS e, var_pop(p) AS a FROM m GROUP BY 1, 2) SELECT round(avg((q - y) ** 2), 6) AS ensemble, round(avg(e), 6) AS members, round(avg(a), 6) AS ambiguity FROM g")
def ensemble_ambiguity(spark, sf_dir):
    a = M.ensemble_ambiguity(_members(spark, sf_dir), "id", "m", "p", "y")
    return a.select(*[r(c).alias(c) for c in a.columns])


@query(f"WITH {_MEMBERS} SELECT a.m AS a, b.m AS b, round(avg(((a.p >= 0.5) <> (b.p >= 0.5))::INT), 6) AS disagree FROM m a JOIN m b ON a.id = b.id AND a.m < b.m GROUP BY 1, 2")
def prediction_multiplicity(spark, sf_dir):
    m = _members(spark, sf_dir).withColumn("c", F.col("p") >= 0.5)
    return M.multiplicity(m, "id", "m", "c").select("a", "b", r("disagree").alias("disagree"))


@query("""WITH s AS (SELECT o_orderpriority AS search, count(DISTINCT o_custkey) % 40 + 1 AS models, count(*) % 90 + 10 AS rows FROM orders GROUP BY 1), j AS (SELECT search, models, rows, unnest(range(rows)) AS j FROM s),
c AS (SELECT *, sum(exp(lgamma(rows + 1) - lgamma(j + 1) - lgamma(rows - j + 1) - rows * ln(2))) OVER (PARTITION BY search ORDER BY j) AS cdf FROM j)
SELECT search, models, rows, round(sum(1 - least(1, cdf) ** models) / rows, 6) AS expected FROM c GROUP BY 1, 2, 3""")
def multiple_search_benchmark(spark, sf_dir):
    s = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("search")).agg((F.countDistinct("o_custkey") % 40 + 1).alias("models"), (F.count("*") % 90 + 10).alias("rows"))
    return M.expected_best_table(s, "search", "models", "rows").withColumn("expected", r("expected"))


@query("""WITH RECURSIVE f AS (SELECT o_custkey AS k, date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS t, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2), a AS (SELECT k, list(v) AS vs, list((top - t) / 252.0::DOUBLE) AS ys, sum(v) * 1.3 AS final FROM (SELECT *, max(t) OVER (PARTITION BY k) AS top FROM f) GROUP BY 1),
s AS (SELECT 0 AS i, k, -0.999::DOUBLE AS lo, 100.0::DOUBLE AS hi FROM a UNION ALL SELECT i + 1, k, CASE WHEN gap < 0 THEN (lo + hi) / 2 ELSE lo END, CASE WHEN gap < 0 THEN hi ELSE (lo + hi) / 2 END
 FROM (SELECT i, k, lo, hi, list_sum(list_transform(list_zip(vs, ys), lambda z: z[1] * (1 + (lo + hi) / 2) ** z[2])) - final AS gap FROM s JOIN a USING (k) WHERE i < 45)),
e AS (SELECT k, (list_sum(list_transform(list_zip(vs, ys), lambda z: z[1] * 0.001::DOUBLE ** z[2])) - final) * (list_sum(list_transform(list_zip(vs, ys), lambda z: z[1] * 101.0::DOUBLE ** z[2])) - final) > 0 AS none_ FROM a)
SELECT k, CASE WHEN NOT none_ THEN round((lo + hi) / 2, 6) END AS rate FROM s JOIN e USING (k) WHERE i = 45""")
def money_weighted_return(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    f = o.groupBy(F.col("o_custkey").alias("k"), F.datediff(F.to_date("o_orderdate"), F.lit("1995-01-01").cast("date")).alias("t")).agg(F.sum("o_totalprice").alias("v"))
    total = f.groupBy("k").agg((F.sum("v") * 1.3).alias("final"))
    return M.money_weighted(f.join(total, "k"), "k", "t", "v", "final").withColumn("rate", r("rate"))
