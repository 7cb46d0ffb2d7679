"""Spanning forests of large edge tables, in rounds that each at least halve the components that can still grow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import written


def _least(edges: DataFrame) -> DataFrame:
    """(g, c, to, w, u, v): each component's least edge, by weight and then by its ends."""
    both = edges.select("g", F.col("cu").alias("c"), F.col("cv").alias("to"), "w", "u", "v").union(edges.select("g", F.col("cv"), F.col("cu"), "w", "u", "v"))
    return both.groupBy("g", "c").agg(F.min(F.struct("w", "u", "v", "to")).alias("e")).select("g", "c", "e.to", "e.w", "e.u", "e.v")


def _roots(parents: DataFrame) -> DataFrame:
    """(g, c, root) from parents(g, c, root) whose chains end in a node that is its own: every round doubles how far a node looks."""
    now = written(parents, "roots")
    while True:
        above = now.select("g", F.col("c").alias("root"), F.col("root").alias("next"))
        step = written(now.join(above, ["g", "root"]).select("g", "c", "next", (F.col("next") != F.col("root")).alias("moved")), "roots")
        if step.filter("moved").isEmpty():
            return now
        now = step.select("g", "c", F.col("next").alias("root"))


def spanning_forest(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """edges(g, u, v, w) -> the edges (g, u, v, w) of a minimum spanning forest of each graph g, and (g, node, component) of
    all nodes with an edge, component being the smallest node.

    Boruvka's rounds: each component takes its least edge; components so tied
    are one from then on, and of the edges between two components the least is
    kept. Ties of weight go by the smaller ends, so the forest is one and the
    same however rows are dealt. Repeated and reversed edges change nothing;
    edges of null ends, or from a node to itself, take no part."""
    ends = edges.filter("u is not null and v is not null and u <> v").select("g", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "w")
    now = written(ends.groupBy("g", "u", "v").agg(F.min("w").alias("w")).select("g", F.col("u").alias("cu"), F.col("v").alias("cv"), "w", "u", "v"), "edges")
    labels = written(now.select("g", F.col("u").alias("node")).union(now.select("g", "v")).distinct().withColumn("component", F.col("node")), "labels")
    picked = now.select("g", "u", "v", "w").limit(0)
    while not now.isEmpty():
        least = written(_least(now), "least")
        picked = picked.union(least.select("g", "u", "v", "w").distinct())
        # of two components that take the same edge the smaller is the root
        back = least.select("g", F.col("c").alias("to"), F.col("to").alias("c"), F.lit(True).alias("mutual"))
        up = least.join(back, ["g", "c", "to"], "left").select("g", "c", F.when(F.col("mutual") & (F.col("c") < F.col("to")), F.col("c")).otherwise(F.col("to")).alias("root"))
        roots = _roots(up)
        nodes = roots.withColumnRenamed("c", "component")
        labels = written(labels.join(nodes, ["g", "component"], "left").select("g", "node", F.coalesce("root", "component").alias("component")), "labels")
        a, b = (roots.select("g", F.col("c").alias(c), F.col("root").alias(f"r{c}")) for c in ("cu", "cv"))
        moved = now.join(a, ["g", "cu"]).join(b, ["g", "cv"]).filter("rcu <> rcv")
        kept = moved.groupBy("g", F.least("rcu", "rcv").alias("cu"), F.greatest("rcu", "rcv").alias("cv")).agg(F.min(F.struct("w", "u", "v")).alias("e"))
        now = written(kept.select("g", "cu", "cv", "e.w", "e.u", "e.v"), "edges")
    least_node = labels.groupBy("g", "component").agg(F.min("node").alias("name"))
    return picked.distinct(), labels.join(least_node, ["g", "component"]).select("g", "node", F.col("name").alias("component"))


def squared(a: Column, b: Column) -> Column:
    """The squared distance of two arrays of numbers."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
