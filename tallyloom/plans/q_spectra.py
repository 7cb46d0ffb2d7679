"""Queries of components beyond noise, of their use, of influence in regressions of several columns, and of matrices of months."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import cleaning as C
from tallyloom.operators import spectra as P

from .base import r, table
from .registry import query

REPS = 20


def _u(part: str, c: str) -> str:
    return f"(('0x' || substr(md5('noise:' || k || ':{c}:' || id || ':{part}'), 1, 13))::BIGINT / 16.0::DOUBLE ** 13)"


def _normal(c: str) -> str:
    return f"sqrt(-2 * ln(1 - {_u('a', c)})) * cos(2 * pi() * {_u('b', c)})"


@query(f"""WITH z AS (SELECT k, corr({_normal('p_size')}, {_normal('p_retailprice')}) AS r FROM (SELECT p_partkey AS id FROM part), range({REPS}) t(k) GROUP BY k), d AS (SELECT corr(p_size, p_retailprice) AS r FROM part),
v AS (SELECT i, (SELECT 1 + s * abs(r) FROM d) AS eigenvalue, avg(1 + s * abs(z.r)) AS noise, quantile_cont(1 + s * abs(z.r), 0.95) AS cut FROM z, (VALUES (1, 1), (2, -1)) q(i, s) GROUP BY i, s)
SELECT i AS component, round(eigenvalue, 6) AS eigenvalue, round(noise, 6) AS noise, round(cut, 6) AS cut, bool_and(eigenvalue > cut) OVER (ORDER BY i) AS kept FROM v""")
def parallel_analysis(spark, sf_dir):
    a = P.parallel_analysis(table(spark, sf_dir, "part"), "p_partkey", ["p_size", "p_retailprice"], REPS, 0.95, "noise")
    return a.select("component", *[r(c).alias(c) for c in ("eigenvalue", "noise", "cut")], "kept")


@query("""WITH p AS (SELECT p_partkey AS id, p_size::DOUBLE AS x, (p_partkey % 7)::DOUBLE AS z, p_retailprice AS y FROM part), m AS (SELECT count(*) AS n, avg(x) AS mx, avg(z) AS mz, avg(y) AS my, sum(x * x) - count(*) * avg(x) ** 2 AS xx, sum(x * z) - count(*) * avg(x) * avg(z) AS xz,
 sum(z * z) - count(*) * avg(z) ** 2 AS zz, sum((x - 25) * (y - 1000)) - count(*) * (avg(x) - 25) * (avg(y) - 1000) AS xy, sum((z - 3) * (y - 1000)) - count(*) * (avg(z) - 3) * (avg(y) - 1000) AS zy, sum((y - 1000) ** 2) - count(*) * (avg(y) - 1000) ** 2 AS yy FROM p),
b AS (SELECT *, (zz * xy - xz * zy) / (xx * zz - xz * xz) AS bx, (xx * zy - xz * xy) / (xx * zz - xz * xz) AS bz, xx * zz - xz * xz AS det FROM m), s AS (SELECT *, (yy - bx * xy - bz * zy) / (n - 3) AS s2 FROM b),
h AS (SELECT id, 1.0::DOUBLE / n + (zz * (x - mx) ** 2 - 2 * xz * (x - mx) * (z - mz) + xx * (z - mz) ** 2) / det AS h, y - my - bx * (x - mx) - bz * (z - mz) AS e, (zz * (x - mx) - xz * (z - mz)) / det AS gx, (xx * (z - mz) - xz * (x - mx)) / det AS gz, s2, n FROM p, s)
SELECT id, round(h, 8) AS leverage, round(e, 4) AS residual, round(e * e * h / (3 * s2 * (1 - h) ** 2), 7) AS cook, round(gx * e / (1 - h), 6) + 0.0 AS dfbeta_size, round(gz * e / (1 - h), 6) + 0.0 AS dfbeta_week, h > 6 / n AS flagged FROM h""")
def several_leverages(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("week", F.col("p_partkey") % 7)
    v = P.leverages(p, "p_partkey", ["p_size", "week"], "p_retailprice")
    move = lambda i: r(F.get("dfbeta", F.lit(i))) + 0.0
    return v.select("id", r("leverage", 8).alias("leverage"), r("residual", 4).alias("residual"), r("cook", 7).alias("cook"), move(0).alias("dfbeta_size"), move(1).alias("dfbeta_week"), "flagged")


@query()
def component_usefulness(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", *[(F.get("embedding", F.lit(i)).cast("double") * (10 if i == 0 else 1)).alias(f"c{i}") for i in range(6)])
    u = P.component_usefulness(e, "vec_id", [f"c{i}" for i in range(6)], "label", 5, "useful")
    return u.select("scaled", "k", r("share").alias("share"), r("squared_r").alias("squared_r"), r("held_out").alias("held_out"), "dominant")


_MONTHS = [f"m{i}" for i in range(1, 13)]


@query("""SELECT year(o_orderdate)::INT AS year, month(o_orderdate)::INT AS month, round(sum(o_totalprice), 2) AS value FROM orders WHERE o_orderpriority = '5-LOW' AND month(o_orderdate) <> 2 GROUP BY 1, 2 HAVING round(sum(o_totalprice), 2) <> 0""")
def month_matrix(spark, sf_dir):
    o = table(spark, sf_dir, "orders").filter("o_orderpriority = '5-LOW'")
    at = lambda i: F.round(F.coalesce(F.sum(F.when((F.month("o_orderdate") == i) & F.lit(i != 2), F.col("o_totalprice"))), F.lit(0.0)), 2)
    wide = o.groupBy(F.year("o_orderdate").alias("year")).agg(*[at(i).alias(m) for i, m in enumerate(_MONTHS, 1)])
    return C.months_long(wide, "year", _MONTHS)
