"""Connected components of large edge tables, by DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch


def _stars(edges: DataFrame) -> DataFrame:
    """One round: every node's larger neighbours, then every node and its smaller ones, are tied to the smallest
    around (the alternating large and small stars of Kiveris et al., 2014). A node's minimum is an aggregate that
    is combined before the shuffle, and it meets the edges in a join that splits hot nodes."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.union(least.select("u", F.col("m").alias("v"))).distinct()


def _print(edges: DataFrame) -> tuple:
    """What stays the same between two rounds only if the edges do."""
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """edges(u, v) of any orderable type -> node, component: the smallest node that is reachable.

    Only nodes of edges between different nodes are returned; nulls take no
    part, repeated and reversed edges change nothing. Each round is written to
    the shared folder, so a lost executor costs no earlier round.
    """
    now = scratch.written(
        edges.filter("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name
    )
    before = _print(now)
    while before[0]:
        now = scratch.replaced(now, _stars(now), name)
        after = _print(now)
        if after == before:
            break
        before = after
    top = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(top)
