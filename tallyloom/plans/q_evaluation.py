"""Queries of reports on predictions, items and replicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions.hashing import md5_share
from tallyloom.operators import evaluation as E
from tallyloom.operators import resample as R

from .base import SCORED, r, scored, table
from .q_resample import _poisson, _u
from .registry import query

_ARM = f"""{SCORED}, a AS (SELECT *, CASE WHEN {_u("'arm:' || id")} < 0.5 THEN 0 ELSE 1 END AS arm FROM scored)"""


@query(f"""WITH {_ARM}, f AS (SELECT regr_slope(y, p) FILTER (arm = 0) AS b0, regr_intercept(y, p) FILTER (arm = 0) AS a0, regr_slope(y, p) FILTER (arm = 1) AS b1, regr_intercept(y, p) FILTER (arm = 1) AS a1 FROM a),
s AS (SELECT a.*, round(a0 + b0 * p, 9) AS risk, round(a0 + b0 * p - a1 - b1 * p, 9) AS uplift FROM a, f),
l AS (SELECT 'risk' AS policy, id, arm, y, risk AS score FROM s UNION ALL SELECT 'uplift', id, arm, y, uplift FROM s),
t AS (SELECT *, row_number() OVER (PARTITION BY policy ORDER BY score DESC, id) AS i, count(*) OVER (PARTITION BY policy) AS n FROM l)
SELECT policy, count(*) AS targeted, round(1000 * (avg(y) FILTER (arm = 0) - avg(y) FILTER (arm = 1)), 4) AS value FROM t WHERE i <= floor(n * 0.2::DOUBLE) GROUP BY 1""")
def uplift_budget(spark, sf_dir):
    s = scored(spark, sf_dir).withColumn("arm", F.when(md5_share(R.key("arm", "id")) < 0.5, 0).otherwise(1))
    v = E.budget_value(E.uplift_scores(s, "arm", "p", "y"), "arm", "y", ["risk", "uplift"], "id", 0.2)
    return v.select("policy", "targeted", r("value", 4).alias("value"))


_LINES = "l AS (SELECT l_orderkey AS k, l_linenumber AS i, l_quantity AS x, l_extendedprice / 1000 AS y FROM lineitem)"


@query(f"""WITH {_LINES}, d AS (SELECT rep::INT AS rep, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM l, range(10) t(rep) WHERE {_u("'bv:' || rep || ':' || k")} < 0.02 GROUP BY 1),
f AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM l), q AS (SELECT p, d.a + d.b * p AS pred, f.a + f.b * p AS truth FROM d, f, range(1, 51) t(p)),
g AS (SELECT p, (avg(pred) - any_value(truth)) ** 2 AS b2, var_pop(pred) AS v FROM q GROUP BY 1) SELECT round(avg(b2), 4) AS bias2, round(avg(v), 4) AS variance, count(*) AS points FROM g""")
def bias_and_variance(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"))
    fit = [F.regr_slope("y", "x").alias("b"), F.regr_intercept("y", "x").alias("a")]
    drawn = R.with_replicates(l, 10).filter(md5_share(R.key("bv", "rep", "k")) < 0.02).groupBy("rep").agg(*fit)
    at = F.explode(F.sequence(F.lit(1), F.lit(50))).alias("point")
    preds = drawn.select("rep", "a", "b", at).select("rep", "point", (F.col("a") + F.col("b") * F.col("point")).alias("pred"))
    truth = l.agg(*fit).select("a", "b", at).select("point", (F.col("a") + F.col("b") * F.col("point")).alias("truth"))
    b = E.bias_variance(preds, truth, "point", "pred", "truth")
    return b.select(r("bias2", 4).alias("bias2"), r("variance", 4).alias("variance"), "points")


_GRADED = f"{SCORED}, graded AS (SELECT m::INT AS model, id AS item, ((p >= m / 10.0::DOUBLE)::INT = y) AS ok FROM scored, range(1, 10, 2) t(m))"


@query(f"""WITH {_GRADED}, items AS (SELECT DISTINCT item FROM graded), s AS (SELECT draw::INT AS draw, item FROM items, range(20) t(draw) QUALIFY row_number() OVER (PARTITION BY draw ORDER BY md5('board:' || draw || ':' || item), item) <= 40),
f AS (SELECT model, avg(ok::INT) AS full_ FROM graded GROUP BY 1), q AS (SELECT draw, model, avg(ok::INT) AS part FROM graded JOIN s USING (item) GROUP BY 1, 2),
o AS (SELECT draw, row_number() OVER (PARTITION BY draw ORDER BY full_ DESC, model) AS t, row_number() OVER (PARTITION BY draw ORDER BY part DESC, model) AS s FROM q JOIN f USING (model)),
w AS (SELECT a.draw, round(avg((a.s > b.s)::INT), 6) AS wrong_pairs FROM o a JOIN o b ON a.draw = b.draw AND a.t < b.t GROUP BY 1)
SELECT draw, max((t = 1 AND s = 1)::INT)::INT AS top_right, min((t = s)::INT)::INT AS order_right, any_value(wrong_pairs) AS wrong_pairs FROM o JOIN w USING (draw) GROUP BY 1""")
def leaderboard_draws(spark, sf_dir):
    s = scored(spark, sf_dir).withColumn("model", F.explode(F.array(*[F.lit(m) for m in range(1, 10, 2)])))
    g = s.select("model", F.col("id").alias("item"), ((F.col("p") >= F.col("model") / 10.0).cast("int") == F.col("y")).alias("ok"))
    b = E.leaderboard_draws(g, "model", "item", "ok", 40, 20, "board")
    return b.select("draw", "top_right", "order_right", r("wrong_pairs").alias("wrong_pairs"))


@query(f"""WITH {SCORED}, c AS (SELECT {_u("'leak:' || id")} < 0.3 AS l, (p >= 0.6)::INT = y AS ok, p AS lp, round(1 - p * p, 4) AS base FROM scored), d AS (SELECT *, round(lp - base, 9) AS g FROM c),
u AS (SELECT avg(CASE WHEN a.lp > b.lp THEN 1 WHEN a.lp = b.lp THEN 0.5 ELSE 0 END) AS loss_auc, avg(CASE WHEN a.g > b.g THEN 1 WHEN a.g = b.g THEN 0.5 ELSE 0 END) AS reference_auc FROM d a, d b WHERE a.l AND NOT b.l),
k AS (SELECT quantile_cont(lp, 0.95) AS cut FROM d WHERE NOT l)
SELECT round(avg(ok::INT) FILTER (l), 6) AS accuracy_leaked, round(avg(ok::INT) FILTER (NOT l), 6) AS accuracy_fresh, round(avg(ok::INT) FILTER (l) - avg(ok::INT) FILTER (NOT l), 6) AS gap, round(avg((lp > (SELECT cut FROM k))::INT) FILTER (l), 6) AS tpr_at_5,
 round((avg(lp) FILTER (l) - avg(lp) FILTER (NOT l)) / sqrt(var_samp(lp) FILTER (l) / count(*) FILTER (l) + var_samp(lp) FILTER (NOT l) / count(*) FILTER (NOT l)), 6) AS welch_t,
 round((SELECT loss_auc FROM u), 6) AS loss_auc, round((SELECT reference_auc FROM u), 6) AS reference_auc FROM d""")
def leak_report(spark, sf_dir):
    s = scored(spark, sf_dir).select((md5_share(R.key("leak", "id")) < 0.3).alias("l"), ((F.col("p") >= 0.6).cast("int") == F.col("y")).alias("ok"), F.col("p").alias("lp"), F.round(1 - F.col("p") * F.col("p"), 4).alias("base"))
    c = E.contamination_report(s, "l", "ok", "lp", "base")
    return c.select(*[r(x).alias(x) for x in ("accuracy_leaked", "accuracy_fresh", "gap", "tpr_at_5", "welch_t", "loss_auc", "reference_auc")])


@query(f"""WITH o AS (SELECT conv_id AS item, turn AS option, length(text) AS n, round(-length(text) * (0.5 + {_u("'lp:' || conv_id || ':' || turn")}), 6) AS lp, turn = min(turn) OVER (PARTITION BY conv_id) AS ok FROM conversations),
k AS (SELECT item, max(n) FILTER (ok) AS rn FROM o WHERE n > 0 GROUP BY 1), s AS (SELECT 'summed' AS scoring, item, option, n, ok, lp AS score FROM o WHERE n > 0 UNION ALL SELECT 'normalised', item, option, n, ok, round(lp / n, 9) FROM o WHERE n > 0),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY scoring, item ORDER BY score DESC, option) = 1)
SELECT scoring, count(*) AS items, round(avg(ok::INT), 6) AS accuracy, round(avg((n < rn)::INT), 6) AS shorter FROM b JOIN k USING (item) GROUP BY 1""")
def multiple_choice(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    first = c.groupBy("conv_id").agg(F.min("turn").alias("first"))
    lp = F.round(-F.length("text") * (0.5 + md5_share(R.key("lp", "conv_id", "turn"))), 6)
    o = c.join(first, "conv_id").select(F.col("conv_id").alias("item"), F.col("turn").alias("option"), lp.alias("lp"), F.length("text").alias("n"), (F.col("turn") == F.col("first")).alias("ok"))
    s = E.choice_scores(o, "item", "option", "lp", "n", "ok")
    return s.select("scoring", "items", r("accuracy").alias("accuracy"), r("shorter").alias("shorter"))


@query("""WITH g AS (SELECT o_orderpriority AS task, o_orderstatus AS status, round(o_totalprice)::BIGINT::VARCHAR AS e, floor(o_totalprice)::BIGINT::VARCHAR AS a FROM orders),
w AS (SELECT *, list_filter(range(1, greatest(length(a), length(e)) + 1), lambda i: a[i] <> e[i])[1] AS at_ FROM g)
SELECT task, status, count(*) AS n, round(avg((a = e)::INT), 6) AS accuracy, round(avg((length(a) > length(e))::INT) FILTER (a <> e), 6) AS longer, round(avg(at_) FILTER (a <> e), 6) AS first_wrong FROM w GROUP BY ROLLUP (task, status)""")
def exact_match_grading(spark, sf_dir):
    text = lambda c: c.cast("long").cast("string")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("task"), F.col("o_orderstatus").alias("status"), text(F.round("o_totalprice")).alias("e"), text(F.floor("o_totalprice")).alias("a"))
    return E.exact_match(o, ["task", "status"], "a", "e").select("task", "status", "n", r("accuracy").alias("accuracy"), r("longer").alias("longer"), r("first_wrong").alias("first_wrong"))


_CURVE = f"""{_LINES}, u AS (SELECT x, y, {_u("'curve:' || (k * 10 + i)")} AS u FROM l), g(share) AS (VALUES (0.01::DOUBLE), (0.02::DOUBLE), (0.05::DOUBLE), (0.1::DOUBLE), (0.4::DOUBLE)),
f AS (SELECT share, count(*) AS n, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM u, g WHERE u < share AND u < 0.5 GROUP BY 1),
c AS (SELECT share, n, avg((y - a - b * x) ** 2) AS mse FROM u, f WHERE u >= 0.5 GROUP BY 1, 2)"""


def _curve(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"))
    return E.learning_curve(l, "id", "x", "y", [0.01, 0.02, 0.05, 0.1, 0.4], "curve")


@query(f"WITH {_CURVE} SELECT share, n, round(mse, 6) AS mse FROM c")
def learning_curve(spark, sf_dir):
    return _curve(spark, sf_dir).select("share", "n", r("mse").alias("mse"))


@query(f"WITH {_CURVE}, k AS (SELECT regr_slope(ln(mse), ln(n)) FILTER (share < 0.3) AS s, regr_intercept(ln(mse), ln(n)) FILTER (share < 0.3) AS i, max(n) AS n, arg_max(mse, n) AS e FROM c) SELECT round(-s, 6) AS power, round(exp(i), 4) AS scale, round(exp(i + s * ln(n)) / e - 1, 6) AS relative_error FROM k")
def learning_curve_fit(spark, sf_dir):
    c = _curve(spark, sf_dir)
    until = c.filter("share < 0.3").agg(F.max("n")).first()[0]
    f = E.curve_fit(c, "n", "mse", until)
    return f.select(r("power").alias("power"), r("scale", 4).alias("scale"), r("relative_error").alias("relative_error"))


@query(f"""WITH {SCORED}, d AS (SELECT rep::INT AS rep, id, g, y, {_u("'oob:' || rep || ':' || id")} AS u FROM scored, range(10) t(rep)), w AS (SELECT *, {_poisson('u')} AS w FROM d),
m AS (SELECT rep, g, sum(w * y) / nullif(sum(w), 0) AS m FROM w GROUP BY 1, 2), v AS (SELECT id, rep, m FROM w JOIN m USING (rep, g) WHERE w = 0),
p AS (SELECT s.id, y, members, avg(m) AS p FROM scored s CROSS JOIN (VALUES (2), (5), (10)) k(members) LEFT JOIN v ON v.id = s.id AND v.rep < members GROUP BY 1, 2, 3)
SELECT members::INT AS members, round(avg((y - p) ** 2), 6) AS mse, count(*) FILTER (p IS NULL) AS no_vote FROM p GROUP BY 1""")
def out_of_bag_error(spark, sf_dir):
    return E.out_of_bag(scored(spark, sf_dir), "id", "g", "y", [2, 5, 10], "oob").select("members", r("mse").alias("mse"), "no_vote")


@query("""WITH s AS (SELECT c_mktsegment AS source, n_name AS nation, o_custkey, count(DISTINCT date_trunc('month', o_orderdate)) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2, 3)
SELECT source, nation, count(*) AS series, count(*) FILTER (n >= 12) AS evaluable FROM s GROUP BY CUBE (source, nation)""")
def series_pool_summary(spark, sf_dir):
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    rows = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    s = rows.groupBy(F.col("c_mktsegment").alias("source"), F.col("n_name").alias("nation"), "o_custkey").agg(F.countDistinct(F.date_trunc("month", "o_orderdate")).alias("n"))
    return E.pool_summary(s, "source", "nation", "n", 8, 4)


@query("""WITH g AS (SELECT o_orderpriority AS trial, count(*) FILTER (o_orderstatus = 'F') AS a, count(*) FILTER (o_orderstatus = 'O') AS b FROM orders GROUP BY 1),
h AS (SELECT trial, round(a / b, 2) AS hr, round(exp(ln(a / b) - 1.96::DOUBLE * sqrt(1 / a + 1 / b)), 2) AS lo, round(exp(ln(a / b) + 1.96::DOUBLE * sqrt(1 / a + 1 / b)), 2) AS hi FROM g),
f AS (SELECT *, (0.5 * hr / (0.5 * hr + 0.5)) * (1 - 0.5 * hr / (0.5 * hr + 0.5)) AS f, 4 * 1.959963984540054::DOUBLE ** 2 AS z FROM h WHERE hi > lo + 0.01)
SELECT trial, round(z / (f * (ln(hi) - ln(lo)) ** 2), 4) AS events, round(z / (f * (ln(hi + 0.005::DOUBLE) - ln(lo - 0.005::DOUBLE)) ** 2), 4) AS least, round(z / (f * (ln(hi - 0.005::DOUBLE) - ln(lo + 0.005::DOUBLE)) ** 2), 4) AS most,
 CASE WHEN hr <> 1 THEN round((1.959963984540054::DOUBLE + 0.8416212335729143::DOUBLE) ** 2 / (f * ln(hr) ** 2), 4) END AS needed FROM f""")
def reported_trial_audit(spark, sf_dir):
    g = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("trial")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("a"), F.count_if(F.col("o_orderstatus") == "O").alias("b"))
    ratio, se = F.col("a") / F.col("b"), 1.96 * F.sqrt(1 / F.col("a") + 1 / F.col("b"))
    h = g.select("trial", F.round(ratio, 2).alias("hr"), F.round(F.exp(F.log(ratio) - se), 2).alias("lo"), F.round(F.exp(F.log(ratio) + se), 2).alias("hi"))
    return E.trial_audit(h, ["trial"], "lo", "hi", "hr").select("trial", *[r(c, 4).alias(c) for c in ("events", "least", "most", "needed")])
