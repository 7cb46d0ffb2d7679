"""Queries of inequality, concentration and composition."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import distribution as D

from .base import DAILY_P, RETURNS, daily_by_priority, r, returns, table
from .registry import query

_X = "x AS (SELECT c_acctbal AS x, c_mktsegment AS g FROM customer WHERE c_acctbal > 0)"
_GINI = "2 * sum(i * x) / (count(*) * sum(x)) - (count(*) + 1) / count(*)"


def _x(spark, sf_dir):
    return table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_acctbal").alias("x"), F.col("c_mktsegment").alias("g"))


@query(f"WITH {_X} SELECT round({_GINI}, 6) AS gini FROM (SELECT x, row_number() OVER (ORDER BY x) AS i FROM x)")
def gini(spark, sf_dir):
    return D.gini(_x(spark, sf_dir), "x").select(r("gini").alias("gini"))


@query(f"""WITH {_X}, s AS (SELECT x, row_number() OVER (ORDER BY x) AS i, sum(x) OVER (ORDER BY x ROWS UNBOUNDED PRECEDING) AS u FROM x), t AS (SELECT count(*) AS n, sum(x) AS s FROM x),
g AS (SELECT id / 100.0::DOUBLE AS population, floor(id / 100.0::DOUBLE * n + 1e-9)::BIGINT AS i FROM range(101) r(id), t)
SELECT population, round((coalesce(a.u, 0) + greatest(0, population * n - g.i) * coalesce(b.x, 0)) / t.s, 6) AS income FROM g, t LEFT JOIN s a ON a.i = g.i LEFT JOIN s b ON b.i = g.i + 1""")
def lorenz_curve(spark, sf_dir):
    return D.lorenz(_x(spark, sf_dir), "x").select("population", r("income").alias("income"))


@query(f"""WITH {_X}, l AS (SELECT g, 0.5 * quantile_cont(x, 0.5) AS line FROM x GROUP BY 1) SELECT g, round(line, 4) AS line, round(avg((x < line)::INT), 6) AS headcount, round(avg(CASE WHEN x < line THEN (line - x) / line ELSE 0 END), 6) AS gap,
 round(coalesce(avg(CASE WHEN x < line THEN (line - x) / line END), 0), 6) AS shortfall FROM x JOIN l USING (g) GROUP BY g, line""")
def poverty_measures(spark, sf_dir):
    return D.poverty(_x(spark, sf_dir), "g", "x").select("g", r("line", 4).alias("line"), r("headcount").alias("headcount"), r("gap").alias("gap"), r("shortfall").alias("shortfall"))


_BATTERY = f"""{_X}, k AS (SELECT g, x, row_number() OVER (PARTITION BY g ORDER BY x) AS i, count(*) OVER (PARTITION BY g) AS n FROM x)
SELECT g, {_GINI} AS gini, quantile_cont(x, 0.9) / quantile_cont(x, 0.1) AS p90_p10, quantile_cont(x, 0.5) / quantile_cont(x, 0.1) AS p50_p10, quantile_cont(x, 0.9) / quantile_cont(x, 0.5) AS p90_p50,
 sum(x) FILTER (i <= floor(n * 0.1::DOUBLE)) / sum(x) AS bottom_share, sum(x) FILTER (i > n - floor(n * 0.01::DOUBLE)) / sum(x) AS top_share, avg(x) / quantile_cont(x, 0.5) AS mean_median FROM k GROUP BY g"""
_MEASURES = ["gini", "p90_p10", "p50_p10", "p90_p50", "bottom_share", "top_share", "mean_median"]


@query(f"WITH b AS (WITH {_BATTERY}) SELECT g, {', '.join(f'round(coalesce({m}, 0), 6) AS {m}' for m in _MEASURES)} FROM b")
def distribution_battery(spark, sf_dir):
    return D.battery(_x(spark, sf_dir), "g", "x").select("g", *[r(m).alias(m) for m in _MEASURES])


@query(f"""WITH a AS (WITH {_BATTERY}), b AS (WITH {_BATTERY.replace("c_acctbal > 0", "c_acctbal > 100")}), u AS (SELECT * FROM (SELECT g, unnest({_MEASURES}) AS measure, unnest([{', '.join(f'a.{m}' for m in _MEASURES)}]) AS v, unnest([{', '.join(f'b.{m}' for m in _MEASURES)}]) AS w FROM a JOIN b USING (g)))
SELECT g, measure, round(abs(v - w) / abs(v), 6) AS relative FROM u WHERE measure NOT IN ('top_share', 'bottom_share')""")
def battery_agreement(spark, sf_dir):
    x = _x(spark, sf_dir)
    out = D.agreement(D.battery(x, "g", "x"), D.battery(x.filter("x > 100"), "g", "x"), "g").filter("measure not in ('top_share', 'bottom_share')")
    return out.select("g", "measure", r("relative").alias("relative"))


@query(f"""WITH {_X}, k AS (SELECT x, row_number() OVER (ORDER BY x) AS i, count(*) OVER () AS n FROM x), a AS (SELECT 'after' AS state, CASE WHEN i <= floor(0.1::DOUBLE * n) THEN x * 0.5 ELSE x END AS x FROM k UNION ALL SELECT 'before', x FROM x)
SELECT state, round({_GINI}, 6) AS gini FROM (SELECT state, x, row_number() OVER (PARTITION BY state ORDER BY x) AS i FROM a) GROUP BY state""")
def stressed_gini(spark, sf_dir):
    return D.stressed_gini(_x(spark, sf_dir), "x", 0.5).select("state", r("gini").alias("gini"))


@query(f"""WITH {_X}, k AS (SELECT x, row_number() OVER (ORDER BY x) AS i FROM x), t AS (SELECT count(*) AS n, sum(x) AS s, sum(i * x) AS b FROM k) SELECT i AS rank, round((2 * i / (n * s) - 2 * b / (n * s * s)) * 1e9, 4) AS slope FROM k, t WHERE i % 50 = 0""")
def rank_sensitivity(spark, sf_dir):
    return D.rank_sensitivity(_x(spark, sf_dir), "x", 50).select("rank", r(F.col("slope") * 1e9, 4).alias("slope"))


@query("SELECT o_custkey AS k, round(sum(w * w) / sum(w) ** 2, 6) AS hhi, round(1 / (0.5 + 0.5 * sum(w * w) / sum(w) ** 2), 6) AS effective_bets FROM (SELECT o_custkey, o_totalprice AS w FROM orders) GROUP BY 1")
def concentration(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("w"))
    return D.herfindahl(o, "k", "w").select("k", r("hhi").alias("hhi"), r("effective_bets").alias("effective_bets"))


@query("""WITH g AS (SELECT o_custkey % 10 AS k, date_diff('day', lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), o_orderdate)::DOUBLE AS gap FROM orders)
SELECT k, round(avg(gap), 6) AS mean, round(avg(gap) + var_pop(gap) / avg(gap), 6) AS experienced, round(avg(gap * gap) / (2 * avg(gap)), 6) AS wait, round(avg(gap) / 2, 6) AS naive_wait FROM g WHERE gap IS NOT NULL GROUP BY k""")
def size_biased_means(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = table(spark, sf_dir, "orders")
    g = o.select((F.col("o_custkey") % 10).alias("k"), F.datediff(F.to_date("o_orderdate"), F.to_date(F.lag("o_orderdate").over(w))).cast("double").alias("gap")).filter("gap is not null")
    return D.size_biased(g, "k", "gap").select("k", *[r(c).alias(c) for c in ("mean", "experienced", "wait", "naive_wait")])


_WAGE = "w AS (SELECT o_custkey AS k, year(o_orderdate) AS y, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2), b AS (SELECT k, v FROM w WHERE y = 1996), a AS (SELECT k, v FROM w WHERE y = 1997), m AS (SELECT b.v AS bv, a.v AS av FROM b JOIN a USING (k))"


@query(f"""WITH {_WAGE} SELECT round((SELECT quantile_cont(v, 0.5) FROM a) / (SELECT quantile_cont(v, 0.5) FROM b) - 1, 6) AS median_published, round((SELECT avg(v) FROM a) / (SELECT avg(v) FROM b) - 1, 6) AS mean_published,
 round((SELECT quantile_cont(av, 0.5) / quantile_cont(bv, 0.5) FROM m) - 1, 6) AS median_matched, round((SELECT avg(av) / avg(bv) FROM m) - 1, 6) AS mean_matched""")
def composition_effect(spark, sf_dir):
    w = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k"), F.year("o_orderdate").alias("y")).agg(F.sum("o_totalprice").alias("v"))
    e = D.entry_effect(w.filter("y = 1996"), w.filter("y = 1997"), "k", "v")
    return e.select(*[r(c).alias(c) for c in e.columns])


_RATES = "rates AS (SELECT year(o_orderdate) AS year, month(o_orderdate) AS age, count(*)::DOUBLE / 1000 AS rate FROM orders GROUP BY 1, 2), g AS (SELECT year, sum(rate) AS total, sum(age * rate) / sum(rate) AS mean_age FROM rates GROUP BY 1), h AS (SELECT *, (lead(mean_age) OVER (ORDER BY year) - lag(mean_age) OVER (ORDER BY year)) / 2 AS change FROM g)"


@query(f"WITH {_RATES} SELECT year::INT AS year, round(total, 6) AS total, round(mean_age, 6) AS mean_age, round(change, 6) AS change, round(CASE WHEN change < 1 THEN total / (1 - change) END, 6) AS adjusted FROM h")
def tempo_adjusted_rates(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    rates = o.groupBy(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("age")).agg((F.count("*") / 1000.0).alias("rate"))
    return D.period_rates(rates, "year", "age", "rate").select("year", *[r(c).alias(c) for c in ("total", "mean_age", "change", "adjusted")])


@query(f"""WITH {RETURNS}, m AS (SELECT series, abs(ret - quantile_cont(ret, 0.5) OVER (PARTITION BY series)) AS d FROM rets), q AS (SELECT series, quantile_cont(d, 0.5) AS a, quantile_cont(d, 0.9) AS b FROM m GROUP BY 1)
SELECT series, round(sqrt(avg(least(d, b) ** 2)), 6) AS winsor_rms, round(1.4826 * any_value(a), 6) AS mad_scale FROM m JOIN q USING (series) GROUP BY 1""")
def robust_scales(spark, sf_dir):
    return D.winsor_rms(returns(spark, sf_dir), "series", "ret", 0.1).select("series", r("winsor_rms").alias("winsor_rms"), r("mad_scale").alias("mad_scale"))


@query(f"""WITH {RETURNS}, s AS (SELECT series, 1.4826 * quantile_cont(abs(ret), 0.5) AS s FROM rets GROUP BY 1) SELECT series, round(any_value(s) * 3 * sqrt(avg(least((ret / s / 3) ** 2, 1))), 6) AS tau FROM rets JOIN s USING (series) GROUP BY 1""")
def tau_scale(spark, sf_dir):
    return D.tau_scale(returns(spark, sf_dir), "series", "ret").select("series", r("tau").alias("tau"))
