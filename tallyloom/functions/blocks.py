"""Work in Arrow batches: totals of arrays over all rows, two tables of which every row meets every row of the other, block by block, and cells of space."""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def summed(table: DataFrame, columns: list[str], shapes: list[tuple[int, ...]], add) -> list[np.ndarray]:
    """Totals of arrays that tasks fill from batches: add(totals, batch). A row a task and array entry that isn't 0 is shuffled."""

    def rows(batches):
        totals = [np.zeros(s) for s in shapes]
        for batch in batches:
            if batch.num_rows:
                add(totals, batch)
        flat = np.concatenate([t.ravel() for t in totals]) if totals else np.zeros(0)
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(flat[at])], names=["i", "s"])

    out = np.zeros(sum(int(np.prod(s)) for s in shapes))
    found = table.select(*columns).mapInArrow(rows, "i long, s double").groupBy("i").agg(F.sum("s").alias("s")).toArrow()
    out[found.column("i").to_numpy()] = found.column("s").to_numpy()
    ends = np.cumsum([0, *[int(np.prod(s)) for s in shapes]])
    return [out[a:b].reshape(s) for a, b, s in zip(ends, ends[1:], shapes)]


def vectors(col: pa.Array, n: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(float)


def met_in_blocks(asked: DataFrame, rows: DataFrame, meet, schema: str, size: int = 8192, wide: int | None = None) -> DataFrame:
    """meet(block of asked, block of rows), Arrow tables to Arrow table, for every two blocks of about `size` rows, or `wide` of the second table. A row goes to as many tasks as the other side has
    blocks; a task holds two blocks, and nothing passes through the driver."""
    n, m = (max(1, ceil(d.count() / s)) for d, s in ((asked, size), (rows, wide or size)))
    a = asked.withColumns({"_a": F.pmod(F.xxhash64("id"), F.lit(n)), "_b": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long")))})
    b = rows.withColumns({"_b": F.pmod(F.xxhash64("id"), F.lit(m)), "_a": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))})
    # columns of their own, as both sides may come from one table
    a, b = (d.select(*[F.col(c).alias(f"{side}_{c}") for c in d.columns]).toDF(*d.columns) for side, d in (("a", a), ("b", b)))
    none = to_arrow_schema(StructType.fromDDL(schema)).empty_table()

    def both(x: pa.Table, y: pa.Table) -> pa.Table:
        return meet(x, y) if x.num_rows and y.num_rows else none

    return a.groupBy("_a", "_b").cogroup(b.groupBy("_a", "_b")).applyInArrow(both, schema)


class Cells:
    """Cells of space, the leaves of a tree of medians of a sample, each of about equally many rows. Any sample gives correct cells; it only decides how even they are."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth, self.dim, self.cut = depth, np.zeros(1 << depth, np.int64), np.full(1 << depth, np.inf)
        own = {1: sample}
        for node in range(1, 1 << depth):
            x = own.pop(node)
            if len(x):
                self.dim[node] = np.ptp(x, axis=0).argmax()
                self.cut[node] = np.median(x[:, self.dim[node]])
            right = x[:, self.dim[node]] > self.cut[node]
            own[2 * node], own[2 * node + 1] = x[~right], x[right]

    def of(self, x: np.ndarray) -> np.ndarray:
        at = np.ones(len(x), np.int64)
        for _ in range(self.depth):
            at = 2 * at + (x[np.arange(len(x)), self.dim[at]] > self.cut[at])
        return at - (1 << self.depth)
