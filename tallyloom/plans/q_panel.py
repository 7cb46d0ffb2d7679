"""Queries of panels, joins and alignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import panel as P

from .base import DAILY_P, PANEL, daily_by_priority, panel, r, table
from .registry import query

# Quarterly totals of region and priority on a complete grid; a cell without orders is 0.
_CELLS = """q AS (SELECT r_name AS region, o_orderpriority AS priority, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS quarter, round(sum(o_totalprice), 2) AS value
 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2, 3),
cells AS (SELECT s.region, s.priority, s.region || '/' || s.priority AS series, t.quarter, coalesce(q.value, 0) AS value FROM (SELECT DISTINCT region, priority FROM q) s, (SELECT DISTINCT quarter FROM q) t
 LEFT JOIN q ON q.region = s.region AND q.priority = s.priority AND q.quarter = t.quarter)"""
_LEVELS = """levels AS (SELECT 'levels' AS kind, series, region, priority, quarter, value FROM cells UNION ALL
 SELECT 'differences', series, region, priority, quarter, d FROM (SELECT *, value - lag(value) OVER (PARTITION BY series ORDER BY quarter) AS d FROM cells) WHERE d IS NOT NULL)"""
_PAIRS = """pairs AS (SELECT a.kind, a.series AS a, b.series AS b, CASE WHEN a.region = b.region THEN 'same region' WHEN a.priority = b.priority THEN 'same priority' ELSE 'unrelated' END AS pair, corr(a.value, b.value) AS r
 FROM levels a JOIN levels b ON a.kind = b.kind AND a.quarter = b.quarter AND a.series < b.series GROUP BY ALL)"""


def _cells(spark, sf_dir):
    o, c, n, g = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    rows = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(g, n.n_regionkey == g.r_regionkey)
    q = rows.groupBy(F.col("r_name").alias("region"), F.col("o_orderpriority").alias("priority"), F.to_date(F.date_trunc("quarter", "o_orderdate")).alias("quarter")).agg(F.round(F.sum("o_totalprice"), 2).alias("value"))
    ends = q.agg(F.min("quarter").alias("a"), F.max("quarter").alias("b")).first()
    grid = q.select("region", "priority").distinct().withColumn("quarter", F.explode(F.sequence(F.lit(ends["a"]), F.lit(ends["b"]), F.expr("interval 3 months"))))
    cells = grid.join(q, ["region", "priority", "quarter"], "left").fillna(0.0, ["value"])
    return cells.withColumn("series", F.concat_ws("/", "region", "priority"))


def _pairs(spark, sf_dir):
    from tallyloom.operators.cleaning import difference

    levels = _cells(spark, sf_dir)
    labels = levels.select("series", "region", "priority").distinct()
    diffs = difference(levels, "series", "quarter", "value").withColumnRenamed("diff", "value").join(labels, "series")
    out = None
    for kind, f in (("levels", levels), ("differences", diffs)):
        p = P.pair_correlations(f, "series", "quarter", "value", ["region", "priority"])
        pair = F.when(F.col("a_region") == F.col("b_region"), "same region").when(F.col("a_priority") == F.col("b_priority"), "same priority").otherwise("unrelated")
        p = p.select(F.lit(kind).alias("kind"), "a", "b", pair.alias("pair"), "r")
        out = p if out is None else out.union(p)
    return out


@query(f"""WITH {_CELLS}, {_LEVELS}, {_PAIRS} SELECT kind, pair, count(*) AS n, round(quantile_cont(abs(r), 0.5), 6) AS median_abs_r, round(avg((abs(r) > 0.5)::INT), 6) AS above_5, round(avg((abs(r) > 0.8)::INT), 6) AS above_8,
 round(avg((abs(r) > 0.9)::INT), 6) AS above_9, round(avg((abs(r) > 0.96)::INT), 6) AS above_96 FROM pairs GROUP BY 1, 2""")
def panel_pair_summary(spark, sf_dir):
    p = _pairs(spark, sf_dir).withColumn("key", F.struct("kind", "pair"))
    s = P.pair_summary(p, "key")
    return s.select("key.kind", "key.pair", "n", *[r(c).alias(c) for c in ("median_abs_r", "above_5", "above_8", "above_9", "above_96")])


@query(f"WITH {_CELLS}, {_LEVELS}, {_PAIRS} SELECT kind, a, b, pair, round(r, 6) AS r FROM pairs")
def pair_correlation_matrix(spark, sf_dir):
    return _pairs(spark, sf_dir).select("kind", "a", "b", "pair", r("r").alias("r"))


@query(f"WITH {_CELLS}, {_LEVELS}, {_PAIRS} SELECT a, b, round(r, 6) AS r FROM pairs WHERE kind = 'levels' AND pair = 'unrelated' ORDER BY abs(r) DESC, a, b LIMIT 10")
def strongest_unrelated_pairs(spark, sf_dir):
    p = _pairs(spark, sf_dir).filter("kind = 'levels' and pair = 'unrelated'")
    return P.strongest_pairs(p, 10).select("a", "b", r("r").alias("r"))


@query(f"""WITH {PANEL}, w AS (SELECT * FROM panel WHERE year BETWEEN 1995 AND 2000), good AS (SELECT country FROM (SELECT country, indicator, count(DISTINCT year) AS n, max(value) - min(value) AS s FROM w GROUP BY 1, 2) GROUP BY 1 HAVING sum(n) = 30 AND min(s) > 0)
SELECT indicator, country, year, value FROM w WHERE country IN (SELECT country FROM good)""")
def complete_panel(spark, sf_dir):
    w = panel(spark, sf_dir).filter("year between 1995 and 2000")
    return P.complete_panel(w, "indicator", "country", "year", "value", 6, 5).select("indicator", "country", "year", "value")


@query(f"""WITH {DAILY_P}, x AS (SELECT date, value AS x FROM dp WHERE series = '2-HIGH'), y AS (SELECT date, lead(value) OVER (ORDER BY date) AS y FROM dp WHERE series = '5-LOW') SELECT date, x, y FROM x JOIN y USING (date) WHERE y IS NOT NULL""")
def lead_aligned(spark, sf_dir):
    d = daily_by_priority(spark, sf_dir)
    y = d.filter("series = '5-LOW'").select(F.lit(0).alias("k"), "date", F.col("value").alias("y"))
    x = d.filter("series = '2-HIGH'").select(F.lit(0).alias("k"), "date", F.col("value").alias("x"))
    return P.aligned_by(x, y, "k", "date", True).select("date", "x", "y")


_EDGES = "edges AS (SELECT o_custkey % 50 AS k, epoch(o_orderdate)::BIGINT // 86400 AS t FROM orders GROUP BY ALL), points AS (SELECT o_custkey % 50 AS k, 9131 + o_orderkey % 2400 AS t FROM orders)"


@query(f"""WITH {_EDGES}, g AS (SELECT k, t AS lo, lead(t) OVER (PARTITION BY k ORDER BY t) AS hi FROM edges)
SELECT p.k, p.t, hi - lo AS gap, hi - p.t AS wait FROM points p JOIN g ON p.k = g.k AND p.t >= lo AND p.t < hi""")
def point_in_interval(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = (F.col("o_custkey") % 50).alias("k")
    edges = o.select(k, F.unix_date(F.to_date("o_orderdate")).cast("long").alias("t")).distinct()
    points = o.select(k, (F.lit(9131).cast("long") + F.col("o_orderkey") % 2400).alias("t"))
    return P.in_interval(points, edges, "k", "t", "t")


@query("""WITH s AS (SELECT o_orderpriority AS series, o_orderkey % 97 AS origin, avg(o_totalprice) AS a, median(o_totalprice) AS b FROM orders GROUP BY 1, 2)
SELECT series, count(*) AS n, round(exp(avg(ln(a / b))), 6) AS ratio, round(avg((a < b)::INT), 6) AS wins FROM s GROUP BY 1""")
def paired_run_ratio(spark, sf_dir):
    s = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("series"), (F.col("o_orderkey") % 97).alias("origin")).agg(F.avg("o_totalprice").alias("a"), F.percentile("o_totalprice", 0.5).alias("b"))
    out = P.paired_runs(s.select("series", "origin", F.col("a").alias("m")), s.select("series", "origin", F.col("b").alias("m")), ["series", "origin"], "m", "series")
    return out.select("series", "n", r("ratio").alias("ratio"), r("wins").alias("wins"))


@query("""WITH l AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS month, l_returnflag AS k, l_quantity AS w, l_extendedprice AS v FROM lineitem)
SELECT month, round(sum(w) FILTER (k = 'R') / sum(w), 6) AS share_weight, round(sum(v) FILTER (k = 'R') / sum(v), 6) AS share_value, round(sum(v) FILTER (k = 'R') / sum(w) FILTER (k = 'R'), 4) AS unit_key, round(sum(v) / sum(w), 4) AS unit_all
FROM l GROUP BY 1 HAVING sum(w) FILTER (k = 'R') IS NOT NULL""")
def share_of_one_key(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select(F.to_date(F.date_trunc("month", "l_shipdate")).alias("month"), F.col("l_returnflag").alias("k"), F.col("l_quantity").alias("w"), F.col("l_extendedprice").alias("v"))
    s = P.share_of_key(l, "month", "k", "R", "w", "v")
    return s.select("month", r("share_weight").alias("share_weight"), r("share_value").alias("share_value"), r("unit_key", 4).alias("unit_key"), r("unit_all", 4).alias("unit_all"))
