"""Queries of leaks across folds and of searches that are scored on their own folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import foldwise as W

from .base import r, table
from .registry import query


def _lines(spark, sf_dir):
    """(id, six measures of a line, price): quantity, discount, tax, days to ship and to receive, and the line's number."""
    l = table(spark, sf_dir, "lineitem")
    days = lambda a, b: F.datediff(F.to_date(a), F.to_date(b)).cast("double")
    return l.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"),
        F.month("l_shipdate").cast("double").alias("month"), days("l_shipdate", F.lit("1992-01-01")).alias("day"), F.col("l_linenumber").alias("number"), (F.col("l_extendedprice") / 10000).alias("price"),
    )


_XS = ["quantity", "discount", "tax", "month", "day", "number"]


@query()
def leak_table(spark, sf_dir):
    s = W.leak_table(_lines(spark, sf_dir), "id", _XS, "price", "leaks")
    return s.select("leak", "uses_label", *[r(c, 9).alias(c) for c in ("leaky", "honest", "gap")])


@query()
def nested_tuning(spark, sf_dir):
    s = W.nested_tuning(_lines(spark, sf_dir), "id", _XS, "price", "nested", [1, 4, 16, 64])
    return s.select("size", "settings", *[r(c, 9).alias(c) for c in s.columns[2:]])
