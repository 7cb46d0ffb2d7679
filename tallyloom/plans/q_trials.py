"""Queries that audit reported trials and results."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import trials as T

from .base import r, table
from .registry import query


def _tail(z: str) -> str:
    """SQL of the chance that a standard normal number exceeds z >= 0: one half less the density times z + z^3/3 + z^5/(3 5) + ..."""
    terms = f"list_sum(list_transform(range(150), lambda k: exp((2 * k + 1) * ln(greatest({z}, 1e-300::DOUBLE)) - (k + 1) * ln(2) - lgamma(k + 1.5::DOUBLE) + 0.5::DOUBLE * ln(pi()))))"
    return f"(0.5::DOUBLE - exp(-0.5::DOUBLE * ({z}) ** 2) / sqrt(2 * pi()) * {terms})"


#: z by halving an interval, from a table tails(k, kind, tail).
_QUANTILES = f"""halved AS (SELECT k, kind, tail, 0::DOUBLE AS lo, 9::DOUBLE AS hi, 0 AS i FROM tails UNION ALL
 SELECT k, kind, tail, CASE WHEN {_tail('(lo + hi) / 2')} > tail THEN (lo + hi) / 2 ELSE lo END, CASE WHEN {_tail('(lo + hi) / 2')} > tail THEN hi ELSE (lo + hi) / 2 END, i + 1 FROM halved WHERE i < 60),
z AS (SELECT k, kind, (lo + hi) / 2 AS z FROM halved WHERE i = 60)"""
_P = "round(greatest(0.0001::DOUBLE, least(0.9999::DOUBLE, 2 * {})), 4)"


def _rounded_p(z):
    return F.round(F.greatest(F.lit(0.0001), F.least(F.lit(0.9999), 2 * T.upper_tail(z))), 4)


_AB = "count(*) FILTER (o_orderstatus = 'F')::DOUBLE AS a, count(*) FILTER (o_orderstatus = 'O')::DOUBLE AS b"
_F = "(0.5::DOUBLE * {0} / (0.5::DOUBLE * {0} + 0.5::DOUBLE)) * (1 - 0.5::DOUBLE * {0} / (0.5::DOUBLE * {0} + 0.5::DOUBLE))"
_STEP = f"exp(-{{z}} / sqrt(d * {_F.format('h')}))"


@query(f"""WITH RECURSIVE g AS (SELECT o_orderpriority AS k, {_AB}, avg((o_totalprice > 150000)::INT) AS t FROM orders GROUP BY 1), s AS (SELECT *, round(a / b, 2) AS hr, a + b AS d, abs(ln(a / b)) / sqrt(1 / a + 1 / b) AS zz FROM g),
h AS (SELECT *, {_P.format(_tail('zz'))} AS p FROM s), tails AS (SELECT k, 'p' AS kind, p / 2 AS tail FROM h UNION ALL SELECT k, 'pocock', 0.05::DOUBLE * ln(1 + (exp(1) - 1) * t) / 2 FROM h UNION ALL SELECT k, 'full', 0.025::DOUBLE FROM h UNION ALL SELECT k, 'power', 0.1::DOUBLE FROM h),
{_QUANTILES}, w AS (SELECT h.*, zp.z AS z, zo.z AS pocock, zf.z / sqrt(t) AS fleming, zf.z AS za, zb.z AS zb FROM h JOIN z zp ON zp.k = h.k AND zp.kind = 'p' JOIN z zo ON zo.k = h.k AND zo.kind = 'pocock' JOIN z zf ON zf.k = h.k AND zf.kind = 'full' JOIN z zb ON zb.k = h.k AND zb.kind = 'power'),
fp AS (SELECT k, d, kind, bound, 1::DOUBLE AS h, 0 AS i FROM (SELECT k, d, 'f' AS kind, fleming AS bound FROM w UNION ALL SELECT k, d, 'o', pocock FROM w) UNION ALL SELECT k, d, kind, bound, {_STEP.format(z='bound')}, i + 1 FROM fp WHERE i < 40)
SELECT w.k AS trial, round(z, 6) AS z, CASE WHEN hr <> 1 THEN round(z ** 2 / ({_F.format('hr')} * ln(hr) ** 2), 4) END AS events_from_p, round(fleming, 6) AS obrien_fleming, round(pocock, 6) AS pocock, round(f.h, 6) AS detectable_obrien_fleming, round(o.h, 6) AS detectable_pocock,
 z >= fleming AS crossed, CASE WHEN hr <> 1 THEN round((za + zb) ** 2 / (0.25::DOUBLE * ln(hr) ** 2), 4) END AS required, round(hr * exp(-za / sqrt(w.d * {_F.format("hr")})), 6) AS low, round(hr * exp(za / sqrt(w.d * {_F.format("hr")})), 6) AS high
FROM w JOIN fp f ON f.k = w.k AND f.kind = 'f' AND f.i = 40 JOIN fp o ON o.k = w.k AND o.kind = 'o' AND o.i = 40""")
def interim_trial_audit(spark, sf_dir):
    g = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("trial")).agg(
        F.count_if(F.col("o_orderstatus") == "F").cast("double").alias("a"), F.count_if(F.col("o_orderstatus") == "O").cast("double").alias("b"), F.avg((F.col("o_totalprice") > 150000).cast("int")).alias("t")
    )
    a, b = F.col("a"), F.col("b")
    h = g.select("trial", F.round(a / b, 2).alias("hr"), (a + b).alias("events"), "t", _rounded_p(F.abs(F.log(a / b)) / F.sqrt(1 / a + 1 / b)).alias("p"))
    audit = T.interim_audit(h, ["trial"], "hr", "p", "events", "t")
    return audit.select("trial", "crossed", *[r(c).alias(c) for c in ("z", "obrien_fleming", "pocock", "detectable_obrien_fleming", "detectable_pocock", "low", "high")], *[r(c, 4).alias(c) for c in ("events_from_p", "required")])


@query(f"""WITH RECURSIVE m AS (SELECT avg(o_totalprice) / 1000 AS m FROM orders), g AS (SELECT o_custkey % 25 AS k, avg(o_totalprice) / 1000 AS mean, stddev_samp(o_totalprice) / 1000 AS noise, count(*)::DOUBLE AS n FROM orders GROUP BY 1), s AS (SELECT k, mean - m AS effect, noise, n FROM g, m),
h AS (SELECT *, {_P.format(_tail('(abs(effect) / noise * sqrt(n))'))} AS p FROM s), tails AS (SELECT k, 'p' AS kind, p / 2 AS tail FROM h), {_QUANTILES}
SELECT h.k AS source, round(z, 6) AS z, round((z / (effect / noise)) ** 2, 3) AS implied_n, round(n / (1 + (n - 1) * 0.05::DOUBLE), 6) AS independent, round(effect / noise * sqrt(n / (1 + (n - 1) * 0.05::DOUBLE)) * sqrt(252), 5) AS annual_ratio FROM h JOIN z USING (k)""")
def result_audit_by_p(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    m = o.agg(F.avg("o_totalprice") / 1000).first()[0]
    g = o.groupBy((F.col("o_custkey") % 25).alias("source")).agg((F.avg("o_totalprice") / 1000).alias("mean"), (F.stddev_samp("o_totalprice") / 1000).alias("noise"), F.count("*").cast("double").alias("n"))
    g = g.select("source", (F.col("mean") - m).alias("effect"), "noise", "n", F.lit(0.05).alias("rho"))
    g = g.withColumn("p", _rounded_p(F.abs("effect") / F.col("noise") * F.sqrt("n")))
    a = T.result_audit_by_p(g, ["source"], "effect", "noise", "p", "n", "rho", 252.0)
    return a.select("source", r("z").alias("z"), r("implied_n", 3).alias("implied_n"), r("independent").alias("independent"), r("annual_ratio", 5).alias("annual_ratio"))
