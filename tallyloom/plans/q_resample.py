"""Queries of resampling, permutation and splits."""

from __future__ import annotations

from math import exp, factorial

from pyspark.sql import functions as F

from tallyloom.operators import resample as R

from .base import PREDICTED, RETURNS, SCORED, predicted, r, returns, scored, table
from .registry import query


def _u(text: str) -> str:
    return f"('0x' || substr(md5({text}), 1, 13))::UBIGINT::DOUBLE / 4503599627370496.0::DOUBLE"


def _poisson(u: str) -> str:
    upto, out = 0.0, "CASE "
    for k in range(8):
        upto += exp(-1) / factorial(k)
        out += f"WHEN {u} < {round(upto, 12)}::DOUBLE THEN {k} "
    return out + "ELSE 8 END"


_BOOT = f"""{SCORED}, u AS (SELECT g, rep::INT AS rep, y, p, {_u("'boot:' || rep || ':' || id")} AS u FROM scored, range(20) t(rep)), w AS (SELECT *, {_poisson('u')} AS w FROM u)"""


@query(f"WITH {_BOOT} SELECT g, rep, round(sum(w * y) / nullif(sum(w), 0), 6) AS mean FROM w GROUP BY 1, 2")
def iid_bootstrap(spark, sf_dir):
    return R.bootstrap_means(scored(spark, sf_dir), "g", "id", "y", 20, "boot").select("g", "rep", r("mean").alias("mean"))


@query(f"WITH {_BOOT}, m AS (SELECT g, rep, sum(w * y) / nullif(sum(w), 0) AS m FROM w GROUP BY 1, 2) SELECT g, round(avg(m), 6) AS centre, round(quantile_cont(m, 0.05), 6) AS lower, round(quantile_cont(m, 0.95), 6) AS upper FROM m GROUP BY 1")
def bootstrap_interval(spark, sf_dir):
    i = R.percentile_interval(R.bootstrap_means(scored(spark, sf_dir), "g", "id", "y", 20, "boot"), "g", "mean")
    return i.select("g", r("centre").alias("centre"), r("lower").alias("lower"), r("upper").alias("upper"))


@query(f"WITH {_BOOT} SELECT g, rep, round(100 * (sum(w * p) - sum(w * y)) / sum(w * y), 4) AS percent FROM w GROUP BY 1, 2 HAVING sum(w * y) > 0")
def paired_bootstrap(spark, sf_dir):
    return R.paired_bootstrap(scored(spark, sf_dir), "g", "id", "y", "p", 20, "boot").filter("percent is not null").select("g", "rep", r("percent", 4).alias("percent"))


@query(f"""WITH c AS (SELECT l_returnflag AS g, l_orderkey AS k, l_quantity AS v FROM lineitem), u AS (SELECT g, rep::INT AS rep, v, {_u("'cluster:' || rep || ':' || k")} AS u FROM c, range(10) t(rep)), w AS (SELECT *, {_poisson('u')} AS w FROM u) SELECT g, rep, round(sum(w * v) / sum(w), 6) AS mean FROM w GROUP BY 1, 2""")
def cluster_bootstrap(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("g"), F.col("l_orderkey").alias("k"), F.col("l_quantity").alias("v"))
    return R.bootstrap_means(l, "g", "k", "v", 10, "cluster").select("g", "rep", r("mean").alias("mean"))


_BLOCK = f"""{RETURNS}, n AS (SELECT series, count(*) AS n FROM rets GROUP BY 1), s AS (SELECT series, n, rep::INT AS rep, b, floor({_u("'block:' || series || ':' || rep || ':' || b")} * (n - 20 + 1))::BIGINT AS start FROM n, range(5) t(rep), range(1000) k(b) WHERE b < ceil(n / 20)),
x AS (SELECT series, rep, b * 20 + i AS place, start + i AS position FROM s, range(20) j(i) WHERE b * 20 + i < n), v AS (SELECT series, ret, row_number() OVER (PARTITION BY series ORDER BY date) - 1 AS position FROM rets)"""


@query(f"WITH {_BLOCK} SELECT series, rep, place, round(ret, 6) AS ret FROM x JOIN v USING (series, position)")
def moving_block_bootstrap(spark, sf_dir):
    return R.block_bootstrap(returns(spark, sf_dir), "series", "date", "ret", 20, 5, "block").select("series", "rep", "place", r("ret").alias("ret"))


@query(f"""WITH {SCORED}, a AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY id) AS i FROM scored), b AS (SELECT g, p AS shuffled, row_number() OVER (PARTITION BY g ORDER BY md5('perm:0:' || id), id) AS i FROM scored) SELECT a.id, a.p, b.shuffled FROM a JOIN b USING (g, i)""")
def permutation(spark, sf_dir):
    return R.permuted(scored(spark, sf_dir), "g", "id", "p", 0, "perm").select("id", "p", "shuffled")


@query(f"""WITH {SCORED}, d AS (SELECT g, rep::INT AS rep, p, ({_u("'null:' || rep || ':' || id")} < p)::INT AS y FROM scored, range(20) t(rep)), b AS (SELECT g, rep, least(floor(p * 10), 9) AS b, count(*) AS k, avg(p) AS c, avg(y) AS a FROM d GROUP BY 1, 2, 3) SELECT g, rep, round(sum(k * abs(a - c)) / sum(k), 6) AS ece FROM b GROUP BY 1, 2""")
def label_resampling_null(spark, sf_dir):
    from tallyloom.operators.scoring import calibration_error

    d = R.drawn_labels(scored(spark, sf_dir), "id", "p", 20, "null").withColumn("gr", F.struct("g", "rep"))
    e = calibration_error(d, "gr", "p", "drawn", 10, closed_above=False)
    return e.select("gr.g", "gr.rep", r("ece").alias("ece"))


@query(f"""WITH {SCORED}, d AS (SELECT g, rep::INT AS rep, p, y, row_number() OVER (PARTITION BY g, rep ORDER BY md5('sub:' || rep || ':' || id), id) AS i FROM scored, range(10) t(rep)) SELECT g, rep, round(avg((p - y) ** 2), 6) AS brier FROM d WHERE i <= 30 GROUP BY 1, 2""")
def subset_stability(spark, sf_dir):
    d = R.subsets(scored(spark, sf_dir), "g", "id", 30, 10, "sub")
    return d.groupBy("g", "rep").agg(r(F.avg(F.pow(F.col("p") - F.col("y"), F.lit(2)))).alias("brier"))


@query(f"WITH {SCORED} SELECT id, ((row_number() OVER (PARTITION BY y ORDER BY md5('fold:' || id), id) - 1) % 5)::INT AS fold FROM scored")
def stratified_folds(spark, sf_dir):
    return R.stratified_folds(scored(spark, sf_dir), "y", "id", 5, "fold").select("id", "fold")


@query(f"SELECT l_orderkey, l_linenumber, floor({_u(chr(39) + 'group:' + chr(39) + ' || l_orderkey')} * 5)::INT AS fold FROM lineitem")
def grouped_folds(spark, sf_dir):
    return R.grouped_folds(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey", 5, "group")


@query(f"WITH {RETURNS} SELECT series, date, (ntile(5) OVER (PARTITION BY series ORDER BY date) - 1)::INT AS fold FROM rets")
def block_folds(spark, sf_dir):
    return R.block_folds(returns(spark, sf_dir), "series", "date", 5).select("series", "date", "fold")


def _split_sql(unit: str) -> str:
    u = _u("'split:' || rep || ':' || u")
    return f"""WITH {PREDICTED}, d AS (SELECT rep::INT AS rep, s, {u} < 0.5 AS cal FROM (SELECT {unit} AS u, abs(truth - pred) AS s FROM predicted), range(5) t(rep)), o AS (SELECT rep, s, row_number() OVER (PARTITION BY rep ORDER BY s) AS i, count(*) OVER (PARTITION BY rep) AS n FROM d WHERE cal),
c AS (SELECT rep, min(s) AS cut FROM o WHERE i >= least(ceil((n + 1) * 0.9::DOUBLE - 1e-9), n) GROUP BY 1) SELECT rep, round(avg((s <= cut)::INT), 6) AS coverage FROM d JOIN c USING (rep) WHERE NOT cal GROUP BY 1"""


@query(_split_sql("id"))
def split_variability(spark, sf_dir):
    p = predicted(spark, sf_dir).withColumn("s", F.abs(F.col("truth") - F.col("pred")))
    return R.split_coverage(p, "id", "s", 5, 0.1, 0.5, "split").select("rep", r("coverage").alias("coverage"))


@query(_split_sql("id // 1000"))
def grouped_split_variability(spark, sf_dir):
    p = predicted(spark, sf_dir).withColumn("s", F.abs(F.col("truth") - F.col("pred")))
    return R.split_coverage(p, F.floor(F.col("id") / 1000), "s", 5, 0.1, 0.5, "split").select("rep", r("coverage").alias("coverage"))


@query("SELECT o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('slice:' || o_orderkey), o_orderkey) <= 40")
def monitor_slice(spark, sf_dir):
    return R.at_most(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderkey", 40, "slice").select("o_orderkey")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY md5('order:' || o_orderkey), o_orderkey) AS position FROM orders")
def seeded_shuffle(spark, sf_dir):
    return R.shuffled(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", "order")


_LABEL = "l AS (SELECT doc_id, quality FROM labels), n AS (SELECT quality, count(*) AS n FROM l GROUP BY 1), b AS (SELECT max(n) AS big, min(n) AS small FROM n)"


@query(f"""WITH {_LABEL}, k AS (SELECT l.*, n, big, row_number() OVER (PARTITION BY quality ORDER BY md5('over:' || doc_id), doc_id) AS i FROM l JOIN n USING (quality), b)
SELECT doc_id, quality, unnest(generate_series(1, (big // n + CASE WHEN i <= big % n THEN 1 ELSE 0 END)::BIGINT)) AS copy FROM k""")
def oversampling(spark, sf_dir):
    return R.oversampled(table(spark, sf_dir, "labels").select("doc_id", "quality"), "quality", "doc_id", "over")


@query(f"WITH {_LABEL} SELECT doc_id, quality FROM (SELECT l.*, small, row_number() OVER (PARTITION BY quality ORDER BY md5('under:' || doc_id), doc_id) AS i FROM l, b) WHERE i <= small")
def undersampling(spark, sf_dir):
    return R.undersampled(table(spark, sf_dir, "labels").select("doc_id", "quality"), "quality", "doc_id", "under")


@query(f"WITH {_LABEL} SELECT quality, round((SELECT sum(n) FROM n)::DOUBLE / ((SELECT count(*) FROM n) * n), 6) AS weight FROM n")
def balanced_class_weights(spark, sf_dir):
    return R.class_weights(table(spark, sf_dir, "labels"), "quality").select("quality", r("weight").alias("weight"))


@query(f"""WITH {RETURNS}, v AS (SELECT series, ret, row_number() OVER (PARTITION BY series ORDER BY date) - 1 AS position FROM rets), n AS (SELECT series, count(*) AS n FROM v GROUP BY 1), s AS (SELECT series, rep::INT AS rep, floor({_u("'draw:' || series || ':' || rep")} * (n - 60 + 1))::BIGINT AS a FROM n, range(10) t(rep))
SELECT s.series, rep, round(kurtosis_pop(ret), 6) AS kurtosis, count(*) AS n FROM s JOIN v ON v.series = s.series AND position BETWEEN a AND a + 59 GROUP BY 1, 2""")
def contiguous_draws(spark, sf_dir):
    return R.contiguous_draws(returns(spark, sf_dir), "series", "date", "ret", 60, 10, "draw").select("series", "rep", r("kurtosis").alias("kurtosis"), "n")


@query(f"""WITH m AS (SELECT p_partkey, {_u("'mask:p_size:' || p_partkey")} < 0.3 * p_size / 25.0::DOUBLE AS was_masked, p_size FROM part) SELECT p_partkey, was_masked, CASE WHEN NOT was_masked THEN p_size END AS p_size FROM m""")
def missingness_injection(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    return R.masked(p, "p_partkey", "p_size", 0.3 * F.col("p_size") / 25.0, "mask").select("p_partkey", "was_masked", "p_size")


@query(f"""WITH m AS (SELECT p_partkey, {_u("'outlier:' || p_partkey")} < 0.1 AS is_outlier, p_retailprice FROM part) SELECT p_partkey, is_outlier, round(CASE WHEN is_outlier THEN p_retailprice + 20000 ELSE p_retailprice END, 4) AS y FROM m""")
def vertical_outliers(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").alias("y"))
    return R.contaminated(p, "p_partkey", "y", 0.1, F.lit(20000.0), "outlier").select("p_partkey", "is_outlier", r("y", 4).alias("y"))


@query(f"""WITH m AS (SELECT p_partkey, {_u("'lever:' || p_partkey")} < 0.1 AS hit, p_size::DOUBLE AS x, p_retailprice AS y FROM part) SELECT p_partkey, hit AS is_leverage, CASE WHEN hit THEN 500.0::DOUBLE ELSE x END AS x, CASE WHEN hit THEN -100.0::DOUBLE ELSE y END AS y FROM m""")
def leverage_points(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"))
    return R.leveraged(p, "p_partkey", "x", "y", 0.1, 500.0, -100.0, "lever").select("p_partkey", "is_leverage", "x", "y")
