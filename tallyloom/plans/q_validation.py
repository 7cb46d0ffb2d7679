"""Queries of studies of validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions.hashing import md5_share
from tallyloom.operators import resample as R
from tallyloom.operators import validation as V

from .base import SCORED, binned, r, scored, table
from .q_resample import _u
from .registry import query

_ROWS = "rows_ AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_quantity AS x, l_extendedprice / 1000 AS y FROM lineitem)"
_FOLDS = f"""{_ROWS}, held AS (SELECT * FROM rows_ WHERE {_u("'half:' || id")} < 0.5), m AS (SELECT avg(x) AS mx, avg(y) AS my FROM held),
d AS (SELECT rep::INT AS rep, floor({_u("'cv:' || rep || ':' || id")} * 10)::INT AS fold, x - mx AS x, y - my AS y FROM held, m, range(5) t(rep)),
o AS (SELECT rep, fold, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy, sum(y * y) AS syy FROM d GROUP BY 1, 2),
q AS (SELECT *, sum(n) OVER w - n AS on_, sum(sx) OVER w - sx AS osx, sum(sy) OVER w - sy AS osy, sum(sxx) OVER w - sxx AS osxx, sum(sxy) OVER w - sxy AS osxy FROM o WINDOW w AS (PARTITION BY rep)),
f AS (SELECT rep, fold, n, on_, (osxy - osx * osy / on_) / (osxx - osx * osx / on_) AS b, osy / on_ AS mean, osx / on_ AS mxo FROM q),
e AS (SELECT rep, fold, any_value(f.n) AS n, any_value(on_)::BIGINT AS train, avg((y - (mean - b * mxo) - b * x) ** 2) AS line, avg((y - mean) ** 2) AS mean FROM d JOIN f USING (rep, fold) GROUP BY 1, 2)"""


def _rows(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"))
    return l.withColumn("half", md5_share(R.key("half", "id")) < 0.5)


def _errors(spark, sf_dir):
    return V.fold_errors(_rows(spark, sf_dir).filter("half"), "id", "x", "y", 10, 5, "cv")


@query(f"WITH {_FOLDS} SELECT rep, fold, n, train, round(line, 5) AS line, round(mean, 5) AS mean FROM e")
def fold_errors(spark, sf_dir):
    return _errors(spark, sf_dir).select("rep", "fold", "n", "train", r("line", 5).alias("line"), r("mean", 5).alias("mean"))


@query(f"""WITH {_FOLDS}, l AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM held), t AS (SELECT avg((y - a - b * x) ** 2) AS truth FROM rows_, l WHERE NOT {_u("'half:' || id")} < 0.5)
SELECT rep, round(avg(line), 5) AS estimate, round(stddev_samp(line) / sqrt(count(*)), 5) AS se, abs(avg(line) - any_value(truth)) <= 1.96::DOUBLE * stddev_samp(line) / sqrt(count(*)) AS covers FROM e, t GROUP BY 1""")
def fold_estimate_against_truth(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    fit = rows.filter("half").agg(F.regr_slope("y", "x").alias("b"), F.regr_intercept("y", "x").alias("a")).first()
    truth = rows.filter("not half").agg(F.avg(F.pow(F.col("y") - fit["a"] - fit["b"] * F.col("x"), F.lit(2)))).first()[0]
    e = V.estimate_against_truth(_errors(spark, sf_dir), truth)
    return e.select("rep", r("estimate", 5).alias("estimate"), r("se", 5).alias("se"), "covers")


@query(f"""WITH {_FOLDS}, dd AS (SELECT rep, fold, line - mean AS d, n, train FROM e), t AS (SELECT rep, var_samp(d) AS v, max(d) FILTER (fold = 0) AS d0 FROM dd WHERE fold < 2 AND rep < 5 GROUP BY 1)
SELECT round(avg(d) FILTER (rep = 0) / sqrt(var_samp(d) FILTER (rep = 0) / count(*) FILTER (rep = 0)), 4) AS k_fold, round(avg(d) / sqrt(var_samp(d) / count(*)), 4) AS repeated,
 round(avg(d) / sqrt(var_samp(d) * (1 / count(*) + sum(n) / sum(train))), 4) AS corrected, round((SELECT max(d0) FILTER (rep = 0) / sqrt(avg(v)) FROM t), 4) AS five_by_two FROM dd""")
def fold_difference_tests(spark, sf_dir):
    t = V.fold_tests(_errors(spark, sf_dir))
    return t.select(*[r(c, 4).alias(c) for c in ("k_fold", "repeated", "corrected", "five_by_two")])


@query(f"""WITH l AS (SELECT unnest(range(64))::INT AS f, unnest(embedding)::DOUBLE AS v, label % 2 AS y, {_u("'part:' || vec_id")} AS u FROM embeddings),
c AS (SELECT f, corr(v, y) FILTER (u < 0.1) AS t, corr(v, y) FILTER (u >= 0.1 AND u < 0.2) AS h, corr(v, y) FILTER (u >= 0.2) AS n FROM l GROUP BY 1),
o AS (SELECT *, row_number() OVER (ORDER BY round(abs(t + h), 9) DESC, f) AS i FROM c WHERE t * h > 0)
SELECT k AS selected, round(avg(sign(h) * h), 6) AS reused, round(avg(sign(h) * n), 6) AS fresh FROM o, (VALUES (2), (5), (10)) s(k) WHERE i <= k GROUP BY 1""")
def reused_holdout(spark, sf_dir):
    u = md5_share(R.key("part", "vec_id"))
    part = F.when(u < 0.1, "train").when(u < 0.2, "holdout").otherwise("fresh")
    e = table(spark, sf_dir, "embeddings").select(part.alias("part"), (F.col("label") % 2).alias("y"), F.posexplode("embedding").alias("f", "v")).withColumn("v", F.col("v").cast("double"))
    s = V.selected_on_holdout(e, "f", "part", "v", "y", [2, 5, 10])
    return s.select("selected", r("reused").alias("reused"), r("fresh").alias("fresh"))


@query(f"""WITH {SCORED}, d AS (SELECT rep::INT AS rep, p, y, {_u("'tune:' || rep || ':' || id")} < 0.3 AS c FROM scored, range(10) t(rep)), g AS (SELECT s AS size, i / (s + 1) AS t FROM (VALUES (1), (4), (16)) k(s), range(1, 17) j(i) WHERE i <= s),
a AS (SELECT rep, size, t, avg(((p >= t)::INT = y)::INT) FILTER (c) AS reused, avg(((p >= t)::INT = y)::INT) FILTER (NOT c) AS fresh FROM d, g GROUP BY 1, 2, 3),
b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY rep, size ORDER BY reused DESC, t) = 1) SELECT size, round(avg(reused), 6) AS reused, round(avg(fresh), 6) AS fresh FROM b GROUP BY 1""")
def tuning_optimism(spark, sf_dir):
    t = V.tuning_optimism(scored(spark, sf_dir), "id", "p", "y", [1, 4, 16], 10, 0.3, "tune")
    return t.select("size", r("reused").alias("reused"), r("fresh").alias("fresh"))


@query(f"""WITH o AS (SELECT o_custkey AS l, o_totalprice / 100000 AS y, floor({_u("'leak:' || o_orderkey")} * 5)::INT AS fold FROM orders), p AS (SELECT avg(y) AS prior FROM o),
a AS (SELECT l, sum(y) AS s, count(*) AS n FROM o GROUP BY 1), f AS (SELECT l, fold, sum(y) AS s, count(*) AS n FROM o GROUP BY 1, 2)
SELECT round(avg((y - a.s / a.n) ** 2), 6) AS leaky, round(avg((y - CASE WHEN a.n > f.n THEN (a.s - f.s) / (a.n - f.n) ELSE prior END) ** 2), 6) AS in_fold, round(avg((y - prior) ** 2), 6) AS "constant" FROM o JOIN a USING (l) JOIN f USING (l, fold), p""")
def encoding_leak(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("l"), (F.col("o_totalprice") / 100000).alias("y"), F.floor(md5_share(R.key("leak", "o_orderkey")) * 5).cast("int").alias("fold"))
    return V.encoding_leak(o, "l", "y", "fold").select(*[r(c).alias(c) for c in ("leaky", "in_fold", "constant")])


@query(f"""WITH d AS (SELECT doc_id, floor({_u("'dup' || chr(31) || coalesce('=' || text, '-') || chr(31) || coalesce('=' || lang, '-')")} * 5)::INT AS fold FROM documents) SELECT doc_id, fold FROM d""")
def duplicate_aware_folds(spark, sf_dir):
    return V.duplicate_aware_folds(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), ["text", "lang"], 5, "dup").select("doc_id", "fold")


@query("""WITH k AS (SELECT p_partkey AS id, p_size::DOUBLE AS a, p_retailprice AS b FROM part), m AS (SELECT avg(a) AS ma, avg(b) AS mb, var_pop(a) AS va, var_pop(b) AS vb, covar_pop(a, b) AS c FROM k),
x AS (SELECT a.b, s.a FROM (SELECT *, row_number() OVER (ORDER BY id) AS i FROM k) a JOIN (SELECT a, row_number() OVER (ORDER BY md5('off:0:' || id), id) AS i FROM k) s USING (i)),
r AS (SELECT quantile_cont((vb * (a - ma) ** 2 - 2 * c * (a - ma) * (b - mb) + va * (b - mb) ** 2) / (va * vb - c * c), 0.9) AS cut FROM k, m)
SELECT round(any_value(cut), 6) AS cut, round(avg(((vb * (x.a - ma) ** 2 - 2 * c * (x.a - ma) * (x.b - mb) + va * (x.b - mb) ** 2) / (va * vb - c * c) > cut)::INT), 6) AS off FROM x, m, r""")
def off_support_share(spark, sf_dir):
    k = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("a"), F.col("p_retailprice").alias("b"))
    return V.off_support(k, "id", "a", "b", 0.9, "off").select(r("cut").alias("cut"), r("off").alias("off"))


_ISO = f"{SCORED}, b AS (SELECT g, round(p, 2) AS score, count(*) AS n, sum(y)::DOUBLE AS s FROM scored GROUP BY 1, 2)"


def _max_min(src: str, by: str) -> str:
    """The isotonic fit at a score: the largest, over starts up to it, of the smallest mean of a stretch from there to it or beyond."""
    return f"""SELECT {by}, score, max(low) AS fitted FROM (SELECT i.{by}, i.score, a.score AS start, min(t.s / t.n) AS low FROM {src} i JOIN {src} a ON a.{by} = i.{by} AND a.score <= i.score
 JOIN (SELECT a.{by}, a.score AS f, z.score AS e, sum(m.s) AS s, sum(m.n) AS n FROM {src} a JOIN {src} z ON z.{by} = a.{by} AND z.score >= a.score JOIN {src} m ON m.{by} = a.{by} AND m.score BETWEEN a.score AND z.score GROUP BY 1, 2, 3) t
 ON t.{by} = i.{by} AND t.f = a.score AND t.e >= i.score GROUP BY 1, 2, 3) GROUP BY 1, 2"""


@query(f"WITH {_ISO}, f AS ({_max_min('b', 'g')}) SELECT g, score, n, round(fitted, 6) AS fitted FROM f JOIN b USING (g, score)")
def isotonic_recalibration(spark, sf_dir):
    s = scored(spark, sf_dir).withColumn("score", binned("p", 2))
    return V.isotonic(s, "g", "score", "y").select("g", "score", "n", r("fitted").alias("fitted"))


@query(f"""WITH {SCORED}, u AS (SELECT round(p, 2) AS score, y, {_u("'size:' || id")} AS u FROM scored), k(share) AS (VALUES (0.1::DOUBLE), (0.2::DOUBLE), (0.5::DOUBLE)),
b AS (SELECT share, score, count(*) AS n, sum(y)::DOUBLE AS s FROM u, k WHERE u < share AND u < 0.5 GROUP BY 1, 2), f AS ({_max_min('b', 'share')}), t AS (SELECT share, score, y FROM u, k WHERE u >= 0.5),
h AS (SELECT share, score, y, coalesce((SELECT arg_max(fitted, f.score) FROM f WHERE f.share = t.share AND f.score <= t.score), (SELECT min(fitted) FROM f WHERE f.share = t.share)) AS fitted FROM t)
SELECT share, round(avg((y - score) ** 2), 6) AS raw, round(avg((y - fitted) ** 2), 6) AS recalibrated FROM h GROUP BY 1""")
def recalibration_by_size(spark, sf_dir):
    s = scored(spark, sf_dir).withColumn("score", binned("p", 2))
    return V.recalibration_by_size(s, "id", "score", "y", [0.1, 0.2, 0.5], "size").select("share", r("raw").alias("raw"), r("recalibrated").alias("recalibrated"))


@query(f"""WITH {SCORED}, k AS (SELECT id, y, {_u("'aps:u:' || id")} AS u, {_u("'aps:part:' || id")} < 0.5 AS cal, [round(p * 0.7, 6), round((1 - p) * 0.7, 6), 0.3::DOUBLE] AS q FROM scored),
l AS (SELECT id, y, u, cal, unnest(q) AS q, unnest(range(3)) AS c FROM k), s AS (SELECT id, y, cal, c, round(coalesce(sum(q) OVER (PARTITION BY id ORDER BY q DESC, c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + u * q, 12) AS s FROM l),
o AS (SELECT s, row_number() OVER (ORDER BY s) AS i, count(*) OVER () AS n FROM s WHERE cal AND c = y), t AS (SELECT min(s) AS cut FROM o WHERE i >= least(ceil((n + 1) * 0.9::DOUBLE - 1e-9), n))
SELECT id, coalesce(bool_or(c = y AND s <= cut), false) AS in_set, count(*) FILTER (s <= cut)::INT AS size FROM s, t WHERE NOT cal GROUP BY 1""")
def adaptive_prediction_sets(spark, sf_dir):
    q = F.array(F.round(F.col("p") * 0.7, 6), F.round((1 - F.col("p")) * 0.7, 6), F.lit(0.3))
    return V.aps_sets(scored(spark, sf_dir).select("id", "y", q.alias("q")), "id", "q", "y", 0.1, 0.5, "aps").select("id", "in_set", "size")


@query(f"""WITH {SCORED}, d AS (SELECT p AS x, y, p < 0.6 AS a, {_u("'explore:' || id")} < 0.2 AS e FROM scored), f AS (SELECT avg(x) AS mx, avg(y) AS actual FROM d WHERE NOT a),
k AS (SELECT 'accepted' AS trained_on, x, y FROM d WHERE a UNION ALL SELECT 'explored', x, y FROM d WHERE a OR e UNION ALL SELECT 'all', x, y FROM d)
SELECT trained_on, count(*) AS rows, round(regr_intercept(y, x) + regr_slope(y, x) * any_value(mx), 6) AS predicted, round(any_value(actual), 6) AS actual FROM k, f GROUP BY 1""")
def selective_labels(spark, sf_dir):
    s = V.selective_labels(scored(spark, sf_dir), "id", "p", "y", 0.6, 0.2, "explore")
    return s.select("trained_on", "rows", r("predicted").alias("predicted"), r("actual").alias("actual"))
