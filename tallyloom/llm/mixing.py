"""Mixing sources to target weights by a tree of budgets, by DataFrame operations alone.

A budget of tokens goes down a tree of domains, languages and sources. At each
node children share by weight, no child takes more than it can give (its
tokens times the epochs allowed), and what one can't give goes to its siblings
by weight; only what all siblings can't give is left to the level above. A leaf
then takes its documents in whole epochs, and of one more epoch the prefix that
fits, in an order seeded by epoch and document.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scratch

#: Hexadecimal digits of the order key that part a leaf's documents into buckets, so that no task orders a whole leaf.
BUCKET_DIGITS = 3


@dataclass(frozen=True)
class Tree:
    """Levels from the root: (name, column expression in SQL, weights by value, weight of other values). Weights are whole numbers."""

    levels: list[tuple[str, str, dict[str, int], int]]
    tokens: str = "regexp_count(coalesce(text, ''), '[^ \\\\t-\\\\r]+')"
    max_epochs: int = 4
    seed: str = "mix"
    budget_percent: int = 100
    id_col: str = "doc_id"
    names: list[str] = field(init=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "names", [x[0] for x in self.levels])


def _weight(column: str, weights: dict[str, int], other: int) -> Column:
    out = F.lit(other)
    for value, w in weights.items():
        out = F.when(F.col(column) == value, w).otherwise(out)
    return out.cast("long")


def fill(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """nodes(parent..., name, cap, weight, budget of the parent) -> the same with alloc: min(cap, level * weight) in whole
    tokens, for the level at which the children take the budget. In order of cap / weight, the first children are full."""
    big = lambda c: F.col(c).cast("decimal(38,0)")
    order = Window.partitionBy(*parent).orderBy(F.col("cap") / F.col("weight"), name)
    up = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*parent)
    live = nodes.filter("weight > 0")
    live = live.withColumns({"cap_before": F.coalesce(F.sum("cap").over(up), F.lit(0)), "weight_left": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(up), F.lit(0))})
    live = live.withColumn("full", big("cap") * big("weight_left") <= (big("budget") - big("cap_before")) * big("weight"))
    live = live.withColumns(
        {
            "spent": F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(every), F.lit(0)),
            "sharing": F.sum(F.when(~F.col("full"), F.col("weight"))).over(every),
        }
    )
    part = F.expr("cast(cast(budget - spent as decimal(38,0)) * cast(weight as decimal(38,0)) div sharing as bigint)")
    return live.withColumn("alloc", F.when(F.col("full"), F.col("cap")).otherwise(part)).drop("cap_before", "weight_left", "full", "spent", "sharing")


def budgets(leaves: DataFrame, tree: Tree) -> DataFrame:
    """leaves(levels..., tokens) -> the same with alloc, the tokens that each leaf is to give. Leaves of weight 0, or under a
    node of weight 0, are left out, and no node counts on them; the budget is a share of all leaves' tokens."""
    names = tree.names
    given = None
    total = leaves.agg(F.sum("tokens")).first()[0] or 0
    for name, _, weights, other in tree.levels:
        leaves = leaves.filter(_weight(name, weights, other) > 0)
    for depth, (name, _, weights, other) in enumerate(tree.levels):
        here, parent = names[: depth + 1], names[:depth]
        nodes = leaves.groupBy(*here).agg((F.sum("tokens") * tree.max_epochs).alias("cap"), F.sum("tokens").alias("tokens"))
        nodes = nodes.withColumn("weight", _weight(name, weights, other))
        if given is None:
            nodes = nodes.withColumn("budget", F.lit(total * tree.budget_percent // 100).cast("long"))
        else:
            nodes = nodes.join(given, parent)
        given = fill(nodes, parent, name).select(*here, "tokens", F.col("alloc").alias("budget"))
        if depth < len(names) - 1:
            given = given.drop("tokens")
    return scratch.written(given.withColumnRenamed("budget", "alloc"), "budgets")


def _key(tree: Tree, epoch: Column, doc: Column) -> Column:
    return F.md5(F.concat(F.lit(tree.seed + ":"), epoch.cast("string"), F.lit(":"), F.coalesce(doc.cast("string"), F.lit(""))))


def leaf_cuts(docs: DataFrame, tree: Tree) -> DataFrame:
    """Per leaf: tokens, alloc, whole (epochs taken whole), and cut: of the epoch after them, documents up to this key are taken (null: none)."""
    cols = [F.coalesce(F.expr(e).cast("string"), F.lit("unknown")).alias(n) for n, e, _, _ in tree.levels]
    narrow = scratch.written(docs.select(*cols, F.col(tree.id_col).alias("id"), F.expr(tree.tokens).cast("long").alias("tokens")), "lengths")
    names = tree.names
    leaves = budgets(narrow.groupBy(*names).agg(F.sum("tokens").alias("tokens")).filter("tokens > 0"), tree)
    leaves = leaves.withColumns({"whole": F.expr("alloc div tokens"), "rest": F.expr("alloc % tokens")})
    keyed = narrow.join(leaves.filter("rest > 0").select(*names, "whole", "rest"), names)
    keyed = keyed.select(*names, "rest", "tokens", _key(tree, F.col("whole") + 1, F.col("id")).alias("key")).withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS))
    sums = keyed.groupBy(*names, "rest", "bucket").agg(F.sum("tokens").alias("tokens"), F.max("key").alias("top"))
    along = Window.partitionBy(*names).orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = scratch.written(sums.withColumn("upto", F.sum("tokens").over(along)), "bucket_sums")
    below = sums.filter("upto <= rest").groupBy(*names).agg(F.max("top").alias("below"))
    edge = sums.filter("upto > rest and upto - tokens <= rest").select(*names, "bucket", (F.col("rest") - F.col("upto") + F.col("tokens")).alias("room"))
    # documents of equal key are taken or left together
    inside = keyed.join(edge, [*names, "bucket"]).withColumn("sum", F.sum("tokens").over(Window.partitionBy(*names, "bucket").orderBy("key")))
    within = inside.filter("sum <= room").groupBy(*names).agg(F.max("key").alias("within"))
    return leaves.join(below, names, "left").join(within, names, "left").select(*names, "tokens", "alloc", "whole", F.greatest("below", "within").alias("cut"))


def mix(docs: DataFrame, tree: Tree) -> DataFrame:
    """(row, levels..., n_tokens, epoch) for each time that a document is taken; row is a struct of all columns of docs.

    The columns that the tree's expressions name must be in docs. A null level is
    the value "unknown"; a null text has no tokens. A leaf without tokens gives
    nothing, so its documents go, and so do leaves of weight 0 or under a node of weight 0. Documents of equal
    id in a leaf share a place in its order. Up to one token a node is lost to
    rounding, and the prefix ends before the document that would pass the budget.
    """
    cuts = scratch.written(leaf_cuts(docs, tree), "cuts")
    cols = [F.coalesce(F.expr(e).cast("string"), F.lit("unknown")).alias(f"_{n}") for n, e, _, _ in tree.levels]
    row = F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]).alias("row")
    wide = docs.select(row, F.col(tree.id_col).alias("_id"), F.expr(tree.tokens).cast("long").alias("_tokens"), *cols)
    of = cuts.select(*[F.col(n).alias(f"_{n}") for n in tree.names], "whole", "cut")
    joined = wide.join(of, [f"_{n}" for n in tree.names])
    times = F.col("whole") + F.when(_key(tree, F.col("whole") + 1, F.col("_id")) <= F.col("cut"), 1).otherwise(0)
    taken = joined.withColumn("_times", times).filter("_times > 0")
    return taken.select("row", *[F.col(f"_{n}").alias(n) for n in tree.names], F.col("_tokens").alias("n_tokens"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times"))).alias("epoch"))
