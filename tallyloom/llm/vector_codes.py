"""Product codes of vectors: integer parts, a codebook for each part position, and exact nearest entries behind bounds.

Rounds of assigning and averaging keep, for each part of each vector and each
block of codebook entries, a lower bound of the distance to the block's entries
and the round that the bound was made in. As all earlier codebooks are kept, a
bound of round T is lowered in round t by the true distance between an entry's
places in T and in t, the norm of the sum of its moves, and not by the sum of
the norms (Newling and Fleuret, 2016). Only blocks whose lowered bound doesn't
exceed the exact distance to the entry held so far are scanned again, by one
matrix product of whole numbers, so the result is that of full scans.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import scratch

#: Entries that share a bound.
BLOCK = 16
#: Components are held to this many units either side of zero, so that squared distances stay exact.
REACH = 1 << 22
#: Kept off every bound, against rounding.
SLACK = 1e-4


def whole_numbers(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int, parts: int) -> DataFrame:
    """(vec_id, label, x): vectors without null or non-finite components as floor(scale * component), of the commonest length that parts divides."""
    y = F.col("y")
    sound = F.col("y").isNotNull() & (F.size("y") > 0) & (F.size("y") % parts == 0) & ~F.exists("y", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    own = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("y")).filter(sound)
    size = own.groupBy(F.size("y").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").limit(1).collect()
    held = F.transform(y, lambda v: F.floor(F.least(F.greatest(v * scale, F.lit(float(-REACH))), F.lit(float(REACH)))).cast("int"))
    return own.filter(F.size("y") == (size[0]["size"] if size else 0)).select("vec_id", "label", held.alias("x"))


def nearest(x: np.ndarray, books: list[np.ndarray], held: np.ndarray | None, low: np.ndarray | None, stamp: np.ndarray | None):
    """For rows x of whole numbers the index of the nearest entry of books[-1] (ties: the lowest), the squared distance, the
    bounds by block, their rounds, and how many entries each row was held against. held, low and stamp come from an earlier round."""
    now, book, n = len(books) - 1, books[-1], len(x)
    blocks = [slice(i, i + BLOCK) for i in range(0, len(book), BLOCK)]
    if held is None:
        before, apart = np.full(n, -1), np.full(n, np.inf)
        low, stamp = np.zeros((n, len(blocks))), np.zeros((n, len(blocks)), np.uint8)
        open_ = np.ones(low.shape, bool)
        lowered = low
    else:
        before, apart = held, np.square(x - book[held]).sum(1)
        move = [np.sqrt(np.square(book - old).sum(1)) for old in books]
        net = np.array([[m[b].max() for b in blocks] for m in move])
        lowered = low - net[stamp, np.arange(len(blocks))] - SLACK
        open_ = np.sqrt(apart)[:, None] >= lowered
    at, best = before.copy(), apart.copy()
    one, two, who = np.full(open_.shape, np.inf), np.full(open_.shape, np.inf), np.full(open_.shape, -1)
    xx, cc = np.square(x).sum(1), np.square(book).sum(1)
    for g, b in enumerate(blocks):
        r = np.flatnonzero(open_[:, g])
        if not len(r):
            continue
        d = xx[r, None] + cc[b] - 2 * (x[r] @ book[b].T)
        i = d.argmin(1)
        first = d[np.arange(len(r)), i]
        d[np.arange(len(r)), i] = np.inf
        one[r, g], two[r, g], who[r, g] = first, d.min(1), i + b.start
        nearer = (first < best[r]) | ((first == best[r]) & (who[r, g] < at[r]))
        at[r[nearer]], best[r[nearer]] = who[r[nearer], g], first[nearer]
    # the entry held is no part of its block's bound
    made = np.sqrt(np.where(who == at[:, None], two, one))
    low, stamp = np.where(open_, np.minimum(made, 1e30), low), np.where(open_, np.uint8(now), stamp)
    if held is not None:
        left = np.flatnonzero(at != before)
        left = left[~open_[left, before[left] // BLOCK]]
        g = before[left] // BLOCK
        low[left, g], stamp[left, g] = np.minimum(lowered[left, g], np.sqrt(apart[left])), now
    scanned = open_ @ np.array([b.stop - b.start for b in blocks])
    return at, best, np.nextafter(low.astype(np.float32), np.float32(-1)), stamp, np.minimum(scanned, len(blocks) * BLOCK)


def _assigned(table: DataFrame, books: list[list[np.ndarray]], parts: int) -> DataFrame:
    """The table with code, low, stamp, error and n_scanned of one more round; books[part] is that part's codebooks, oldest first."""
    fresh = "code" not in table.columns
    base = [f for f in table.schema.fields if f.name in ("vec_id", "label", "x")]
    more = [T.StructField("code", T.BinaryType()), T.StructField("low", T.BinaryType()), T.StructField("stamp", T.BinaryType()), T.StructField("error", T.LongType()), T.StructField("n_scanned", T.LongType())]
    blocks = -(-len(books[0][0]) // BLOCK)

    def cells(col: pa.Array, kind: type, shape: tuple[int, ...]) -> np.ndarray:
        return np.frombuffer(b"".join(col.to_pylist()), kind).reshape(shape)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, parts, -1)
            if fresh:
                error, scanned = np.zeros(n), np.zeros(n, np.int64)
            else:
                code, low, stamp = cells(batch.column("code"), np.uint8, (n, parts)), cells(batch.column("low"), np.float32, (n, parts, blocks)), cells(batch.column("stamp"), np.uint8, (n, parts, blocks))
                error, scanned = np.zeros(n), batch.column("n_scanned").to_numpy()
            out = []
            for p in range(parts):
                history = [b.astype(np.float64) for b in books[p]]
                before = (None, None, None) if fresh else (code[:, p].astype(np.int64), low[:, p].astype(np.float64), stamp[:, p])
                at, best, bound, made, tried = nearest(np.ascontiguousarray(x[:, p]), history, *before)
                error, scanned = error + best, scanned + tried
                out.append((at.astype(np.uint8), bound, made))
            packed = [np.stack([o[i] for o in out], 1) for i in range(3)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(f.name) for f in base), *(pa.array([r.tobytes() for r in a], pa.binary()) for a in packed), pa.array(error.astype(np.int64)), pa.array(scanned.astype(np.int64))],
                names=[f.name for f in base + more],
            )

    return table.mapInArrow(rows, T.StructType(base + more))


def _means(table: DataFrame, books: list[np.ndarray], parts: int) -> list[np.ndarray]:
    """The next codebooks: floors of the means of each entry's parts. One row a task and entry is shuffled, one an entry collected."""
    entries, width = books[0].shape

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, parts, width)
            code = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(batch.num_rows, parts)
            for p in range(parts):
                order = np.argsort(code[:, p], kind="stable")
                of, first = np.unique(code[order, p], return_index=True)
                if len(of):
                    total[p, of] += np.add.reduceat(x[order, p], first, axis=0)
                n[p] += np.bincount(code[:, p], minlength=entries)
        p, e = np.nonzero(n)
        sums = pa.ListArray.from_arrays(np.arange(len(p) + 1, dtype=np.int32) * width, pa.array(total[p, e].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(n[p, e]), sums], names=["part", "entry", "n", "s"])

    cells = table.select("x", "code").mapInArrow(rows, "part int, entry int, n long, s array<long>")
    found = cells.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(width)])
    out = [b.copy() for b in books]
    for r in found.collect():
        out[r["part"]][r["entry"]] = [r[f"s{i}"] // r["n"] for i in range(width)]
    return out


def encode(
    vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """A row for each vector kept: vec_id, label, code, error, label_error, codebooks_sha256 and n_scanned.

    Components become floor(scale * component); vectors are cut into equal
    parts. Each part position's codebook starts as that part of the `entries`
    (at most 256) smallest kept ids; `rounds` times every part takes its nearest
    entry and every entry becomes the floor of the mean of its parts, and parts
    are assigned once more. n_scanned counts the entries that the row's parts
    were held against in all rounds, of (rounds + 1) * parts * entries.

    Vectors that are null or empty, that hold null or non-finite components, or
    whose length isn't the commonest one that `parts` divides, are dropped. Null
    ids come after all others, equal ids are ordered by their vectors; each row
    is coded for itself, so equal rows have equal codes. Components beyond 2^22
    units either side of 0 count as 2^22. With fewer kept rows than entries the
    codebooks are as short. Null labels are one label. No kept row: no rows.
    """
    if not 1 <= entries <= 256:
        raise ValueError("an index is one byte: 1 to 256 entries")
    table = scratch.written(whole_numbers(vectors, id_col, vector_col, label_col, scale, parts), "vectors")
    first = np.array([r["x"] for r in table.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).select("x").collect()], np.int64)
    if not len(first):
        return table.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"), F.lit(0).cast("long").alias("n_scanned"))
    books = [[np.ascontiguousarray(b)] for b in np.moveaxis(first.reshape(len(first), parts, -1), 1, 0)]
    for _ in range(rounds):
        table = scratch.replaced(table, _assigned(table, books, parts), "vectors")
        for own, new in zip(books, _means(table, [b[-1] for b in books], parts)):
            own.append(new)
    table = scratch.replaced(table, _assigned(table, books, parts), "vectors")
    sha = hashlib.sha256(",".join(str(v) for b in books for v in b[-1].ravel()).encode()).hexdigest()
    totals = scratch.written(table.groupBy("label").agg(F.sum("error").alias("label_error")).select(F.col("label").alias("of"), "label_error"), "errors")
    coded = table.select("vec_id", "label", F.lower(F.hex("code")).alias("code"), "error", "n_scanned")
    return coded.join(totals, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "label", "code", "error", "label_error", F.lit(sha).alias("codebooks_sha256"), "n_scanned")
