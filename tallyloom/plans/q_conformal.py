"""Queries of prediction intervals and sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import conformal as C

from .base import PREDICTED, SCORED, predicted, r, scored
from .registry import query


def _parts(spark, sf_dir):
    p = predicted(spark, sf_dir).withColumn("g", F.col("grp"))
    return p.filter("part = 'calibration'"), p.filter("part = 'test'")


def _order_sql(score: str, clip: bool = False, source: str = "predicted", where: str = "part = 'calibration'", by: str = "grp", alpha: float = 0.1) -> str:
    k = f"least(ceil((n + 1) * {1 - alpha}::DOUBLE - 1e-9), n)" if clip else f"ceil((n + 1) * {1 - alpha}::DOUBLE - 1e-9)"
    return f"q AS (SELECT {by}, coalesce(min(s) FILTER (i >= {k}), 'inf'::DOUBLE) AS q, any_value(n) AS n FROM (SELECT {by}, {score} AS s, row_number() OVER (PARTITION BY {by} ORDER BY {score}) AS i, count(*) OVER (PARTITION BY {by}) AS n FROM {source} WHERE {where}) GROUP BY {by})"


@query(f"WITH {PREDICTED}, {_order_sql('abs(truth - pred)')} SELECT grp, round(q, 4) AS q, n FROM q")
def conformal_quantile(spark, sf_dir):
    cal, _ = _parts(spark, sf_dir)
    return C.quantile(cal, "grp", F.abs(F.col("truth") - F.col("pred")), 0.1).select("grp", r("q", 4).alias("q"), "n")


@query(f"WITH {PREDICTED}, {_order_sql('abs(truth - pred)')} SELECT id, round(pred - q, 4) AS lower, round(pred + q, 4) AS upper FROM predicted JOIN q USING (grp) WHERE part = 'test'")
def split_conformal(spark, sf_dir):
    cal, test = _parts(spark, sf_dir)
    return C.split(cal, test, "grp", "pred", "truth", 0.1).select("id", r("lower", 4).alias("lower"), r("upper", 4).alias("upper"))


@query(f"WITH {PREDICTED}, {_order_sql('abs(truth - pred) / scale')} SELECT id, round(pred - q * scale, 4) AS lower, round(pred + q * scale, 4) AS upper FROM predicted JOIN q USING (grp) WHERE part = 'test'")
def normalised_conformal(spark, sf_dir):
    cal, test = _parts(spark, sf_dir)
    return C.split(cal, test, "grp", "pred", "truth", 0.1, "scale").select("id", r("lower", 4).alias("lower"), r("upper", 4).alias("upper"))


@query(f"WITH {PREDICTED}, {_order_sql('greatest(pred * 0.9 - truth, truth - pred * 1.6)')} SELECT id, round(pred * 0.9 - q, 4) AS lower, round(pred * 1.6 + q, 4) AS upper FROM predicted JOIN q USING (grp) WHERE part = 'test'")
def conformalised_quantiles(spark, sf_dir):
    cal, test = (f.withColumns({"lo": F.col("pred") * 0.9, "hi": F.col("pred") * 1.6}) for f in _parts(spark, sf_dir))
    return C.cqr(cal, test, "grp", "lo", "hi", "truth", 0.1).select("id", r("lower", 4).alias("lower"), r("upper", 4).alias("upper"))


@query(f"""WITH {PREDICTED}, s AS (SELECT s, sum(w) OVER (ORDER BY s RANGE UNBOUNDED PRECEDING) AS u FROM (SELECT abs(truth - pred) AS s, sum(weight) AS w FROM predicted WHERE part = 'calibration' GROUP BY 1)), t AS (SELECT max(u) AS t FROM s),
n AS (SELECT id, pred, weight, 0.9::DOUBLE * (t + weight) - 1e-9 AS a FROM predicted, t WHERE part = 'test') SELECT n.id, round(pred - coalesce(s.s, 'inf'::DOUBLE), 4) AS lower, round(pred + coalesce(s.s, 'inf'::DOUBLE), 4) AS upper FROM n ASOF LEFT JOIN s ON n.a <= s.u""")
def weighted_conformal(spark, sf_dir):
    cal, test = _parts(spark, sf_dir)
    return C.weighted(cal, test.select("id", "pred", "weight"), "pred", "truth", "weight", 0.1).select("id", r("lower", 4).alias("lower"), r("upper", 4).alias("upper"))


@query(f"WITH {PREDICTED} SELECT grp, round(sum(weight) ** 2 / sum(weight * weight), 4) AS effective_n FROM predicted GROUP BY 1")
def effective_sample_size(spark, sf_dir):
    return C.effective_size(predicted(spark, sf_dir), "grp", "weight").select("grp", r("effective_n", 4).alias("effective_n"))


_SETS = f"""{SCORED}, c AS (SELECT id, g, y, [1 - p, p] AS v, id % 2 = 0 AS cal FROM scored), {_order_sql('1 - v[y + 1]', True, 'c', 'cal', 'g')}, m AS (SELECT c.g, c.id, c.y, list_filter([CASE WHEN v[1] >= 1 - q - 1e-12 THEN 0 END, CASE WHEN v[2] >= 1 - q - 1e-12 THEN 1 END], lambda x: x IS NOT NULL) AS s FROM c JOIN q USING (g) WHERE NOT cal)"""


def _classes(spark, sf_dir):
    c = scored(spark, sf_dir).select("id", "g", "y", F.array(1 - F.col("p"), F.col("p")).alias("v"), (F.col("id") % 2 == 0).alias("cal"))
    return C.sets(c.filter("cal"), c.filter("not cal"), "g", "v", "y", 0.1)


@query(f"WITH {_SETS} SELECT id, array_to_string(s, ',') AS members FROM m")
def conformal_class_sets(spark, sf_dir):
    return _classes(spark, sf_dir).select("id", F.concat_ws(",", F.transform("members", lambda i: i.cast("string"))).alias("members"))


@query(f"WITH {_SETS} SELECT g, round(avg(list_contains(s, y)::INT), 6) AS coverage, round(avg(len(s)), 6) AS size, round(avg((len(s) = 1)::INT), 6) AS single, round(avg((len(s) = 0)::INT), 6) AS empty FROM m GROUP BY 1")
def conformal_set_report(spark, sf_dir):
    s = C.set_report(_classes(spark, sf_dir), "g", "y")
    return s.select("g", *[r(c).alias(c) for c in ("coverage", "size", "single", "empty")])


@query(f"""WITH {SCORED}, u AS (SELECT id, g, y, p, ('0x' || substr(md5('aps:' || id), 1, 13))::UBIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS u FROM scored)
SELECT id, round(CASE WHEN (CASE WHEN y = 1 THEN p ELSE 1 - p END) < 0.5 THEN (CASE WHEN y = 1 THEN 1 - p ELSE p END) ELSE 0 END + u * (CASE WHEN y = 1 THEN p ELSE 1 - p END), 6) AS score FROM u""")
def adaptive_set_scores(spark, sf_dir):
    from tallyloom.functions.hashing import md5_share

    u = md5_share(F.concat(F.lit("aps:"), F.col("id").cast("string")))
    s = scored(spark, sf_dir).select("id", "y", F.array(1 - F.col("p"), F.col("p")).alias("v"), u.alias("u"))
    return s.select("id", r(C.adaptive_score("v", F.col("y"), F.col("u"))).alias("score"))


@query(f"WITH {PREDICTED} SELECT grp, round(avg((pred * 0.9 > pred + 20 * (scale - 20) OR pred + 20 * (scale - 20) > pred * 1.1)::INT), 6) AS crossing FROM predicted GROUP BY 1")
def quantile_crossing_rate(spark, sf_dir):
    p = predicted(spark, sf_dir).withColumn("q", F.array(F.col("pred") * 0.9, F.col("pred") + 20 * (F.col("scale") - 20), F.col("pred") * 1.1))
    return C.crossing_rate(p, "grp", "q").select("grp", r("crossing").alias("crossing"))


_T = f"{SCORED}, t AS (SELECT g, temperature, y, 1 / (1 + exp(-ln(p / (1 - p)) / temperature)) AS q FROM scored, (SELECT unnest([0.5, 1.0, 2.0, 4.0])::DOUBLE AS temperature)), l AS (SELECT g, temperature, -avg(y * ln(q) + (1 - y) * ln(1 - q)) AS log_loss, avg(q) - avg(y) AS bias FROM t GROUP BY 1, 2)"


@query(f"WITH {_T} SELECT g, temperature, round(log_loss, 6) AS log_loss, round(bias, 6) AS bias FROM l")
def temperature_table(spark, sf_dir):
    return C.temperature_table(scored(spark, sf_dir), "g", "p", "y", [0.5, 1.0, 2.0, 4.0]).select("g", "temperature", r("log_loss").alias("log_loss"), r("bias").alias("bias"))


@query(f"WITH {_T} SELECT g, arg_min(temperature, log_loss) AS temperature FROM l GROUP BY 1")
def best_temperature(spark, sf_dir):
    return C.best_temperature(C.temperature_table(scored(spark, sf_dir), "g", "p", "y", [0.5, 1.0, 2.0, 4.0]), "g")
