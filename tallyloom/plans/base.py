"""Tables that several queries start from, and the SQL of the same tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r(c: str | Column, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def binned(c: str, digits: int) -> Column:
    """A double rounded by its binary value, as DuckDB rounds: 0.575 * 100 is below 57.5. `F.round` goes by the shortest decimal and gives 0.58."""
    return F.round(F.col(c) * 10.0**digits) / 10.0**digits


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, value): totals of orders by day."""
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.to_date("o_orderdate").alias("date")).agg(F.round(F.sum("o_totalprice"), 2).alias("value"))


def daily_by_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("series"), F.to_date("o_orderdate").alias("date")).agg(F.round(F.sum("o_totalprice"), 2).alias("value"))


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series, date, value): totals of orders by priority and month."""
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("series"), F.to_date(F.date_trunc("month", "o_orderdate")).alias("date")).agg(F.round(F.sum("o_totalprice"), 2).alias("value"))


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series, date, ret): log changes of daily totals by priority, in percent."""
    from tallyloom.operators.cleaning import log_returns

    return log_returns(daily_by_priority(spark, sf_dir), "series", "date", "value")


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(indicator, country, year, value): yearly order totals by priority and nation."""
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    rows = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return rows.groupBy(F.col("o_orderpriority").alias("indicator"), F.col("n_name").alias("country"), F.year("o_orderdate").alias("year")).agg(F.round(F.sum("o_totalprice"), 2).alias("value"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, p, y, g): a fixed score of labelled documents from their length, the quality label, and the language."""
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    p = F.round(F.least(F.lit(0.99), F.greatest(F.lit(0.01), F.lit(1.0) - F.col("n_chars") / (F.col("n_chars") + 6000.0))), 4)
    return d.join(l, "doc_id").select(F.col("doc_id").alias("id"), p.alias("p"), F.col("quality").alias("y"), F.col("lang").alias("g"))


def predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, pred, truth, scale, weight, grp, part): a fixed linear prediction of line prices, half of them for calibration."""
    l = table(spark, sf_dir, "lineitem")
    return l.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_quantity") * 1000.0).alias("pred"), F.col("l_extendedprice").alias("truth"), (F.col("l_quantity") + 1.0).alias("scale"),
        (F.col("l_discount") + 0.01).alias("weight"), F.col("l_returnflag").alias("grp"), F.when((F.col("l_orderkey") + F.col("l_linenumber")) % 2 == 0, "calibration").otherwise("test").alias("part"),
    )


DAILY = "daily AS (SELECT CAST(o_orderdate AS DATE) AS date, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1)"
DAILY_P = "dp AS (SELECT o_orderpriority AS series, CAST(o_orderdate AS DATE) AS date, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1, 2)"
MONTHLY = "monthly AS (SELECT o_orderpriority AS series, CAST(date_trunc('month', o_orderdate) AS DATE) AS date, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1, 2)"
RETURNS = DAILY_P + """, rets AS (SELECT series, date, ret FROM (SELECT series, date, 100 * (ln(value) - lag(ln(value)) OVER (PARTITION BY series ORDER BY date)) AS ret FROM dp) WHERE ret IS NOT NULL)"""
PANEL = """panel AS (SELECT o_orderpriority AS indicator, n_name AS country, CAST(year(o_orderdate) AS INTEGER) AS year, round(sum(o_totalprice), 2) AS value
 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2, 3)"""
SCORED = """scored AS (SELECT doc_id AS id, round(least(0.99, greatest(0.01, 1.0::DOUBLE - n_chars / (n_chars + 6000.0::DOUBLE))), 4)::DOUBLE AS p, quality AS y, lang AS g FROM documents JOIN labels USING (doc_id))"""
PREDICTED = """predicted AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_quantity * 1000.0::DOUBLE AS pred, l_extendedprice AS truth, l_quantity + 1.0::DOUBLE AS scale, l_discount + 0.01::DOUBLE AS weight,
 l_returnflag AS grp, CASE WHEN (l_orderkey + l_linenumber) % 2 = 0 THEN 'calibration' ELSE 'test' END AS part FROM lineitem)"""
