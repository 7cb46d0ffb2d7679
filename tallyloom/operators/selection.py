"""What a holdout that is asked again and again still says: greedy selection, and votes of submissions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.blocks import summed, vectors
from tallyloom.functions.hashing import md5_share
from tallyloom.functions.storage import written
from tallyloom.operators.resample import key

PARTS = ("train", "holdout", "fresh")


def part_grams(df: DataFrame, columns: list[str | Column], y: str | Column, part: str) -> dict[str, np.ndarray]:
    """For each part (train, holdout, fresh) the matrix of products of (columns, y, 1), over rows without nulls: all that any regression on them needs."""
    value = [(F.col(c) if isinstance(c, str) else c).cast("double") for c in (*columns, y)]
    d = df.select(F.array(*value, F.lit(1.0)).alias("v"), F.coalesce(F.array_position(F.array(*map(F.lit, PARTS)), F.col(part)), F.lit(0)).cast("int").alias("p"))
    p = len(columns) + 2

    def add(t, batch):
        x, at = vectors(batch.column("v"), batch.num_rows), batch.column("p").to_numpy()
        whole = ~np.isnan(x).any(1)  # nulls are NaN here; a filter in Spark would compute all columns once more
        x, at = x[whole], at[whole]
        for i in range(len(PARTS)):
            own = x[at == i + 1]
            t[0][i] += own.T @ own

    (gram,) = summed(d, ["v", "p"], [(len(PARTS), p, p)], add)
    return dict(zip(PARTS, gram))


def swept(m: np.ndarray, k: int) -> np.ndarray:
    """The matrix with row and column k swept: afterwards the columns swept so far predict the rest, and what is left of the rest is its residual products."""
    out = m - np.outer(m[:, k], m[k]) / m[k, k]
    out[k], out[:, k] = m[k] / m[k, k], m[:, k] / m[k, k]
    out[k, k] = -1 / m[k, k]
    return out


def greedy_selection(df: DataFrame, columns: list[str | Column], names: list[str], y: str | Column, part: str, steps: int, by: str = "holdout") -> DataFrame:
    """(step, feature, train, holdout, fresh): least squares with a constant, fitted on the training rows; each step adds the column that lowers the mean squared error
    of the part `by` most (of equals to 9 digits the first), whether or not it lowers it. Errors follow from the parts' matrices of products, and the training one is
    swept column by column, so a step needs no rows. Columns that the chosen ones already determine aren't candidates."""
    grams = part_grams(df, columns, y, part)
    p, n = len(columns), {k: g[-1, -1] for k, g in grams.items()}
    if not all(n.values()):
        return df.sparkSession.createDataFrame([], "step int, feature string, train double, holdout double, fresh double")

    def error(m: np.ndarray, chosen: list[int], which: str) -> float:
        b = np.zeros(p + 2)
        b[[*chosen, p + 1]] = -m[[*chosen, p + 1], p]
        b[p] = 1.0
        return float(b @ grams[which] @ b / n[which])

    now, chosen, rows = swept(grams["train"], p + 1), [], []
    for step in range(1, min(steps, p) + 1):
        left = [j for j in range(p) if j not in chosen and now[j, j] > 1e-9 * grams["train"][j, j]]
        if not left:
            break
        trials = [(round(error(m := swept(now, j), [*chosen, j], by), 9), j) for j in left]
        j = min(trials)[1]
        now, chosen = swept(now, j), [*chosen, j]
        rows.append((step, names[j], *(error(now, chosen, w) for w in PARTS)))
    return df.sparkSession.createDataFrame(rows, "step int, feature string, train double, holdout double, fresh double")


def submission_votes(df: DataFrame, row_id: str, y: str, counts: list[int], seed: str) -> DataFrame:
    """(submissions, better, public, private): random 0/1 submissions, by hashes of seed, number and id, of which those right on more than half of the public rows are kept;
    the accuracy of their majority (ties count 0; without any, the first submission) on public and private rows. A row is public by a hash. A submission is a count in the
    first pass and a share of the vote in the second; none is a table of its own."""
    most = max(counts)
    guess = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: (md5_share(F.concat_ws(":", F.lit(seed), F.lit("guess"), i.cast("string"), F.col("id").cast("string"))) < 0.5).cast("int"))
    d = df.filter(F.col(y).isNotNull()).select(F.col(row_id).alias("id"), F.col(y).cast("int").alias("y"))
    d = written(d.select("y", (md5_share(key(seed, F.lit("public"), "id")) < 0.5).alias("public"), guess.alias("g")), "guesses")

    def right(t, batch):
        g, y_, public = vectors(batch.column("g"), batch.num_rows), batch.column("y").to_numpy(), batch.column("public").to_numpy(zero_copy_only=False)
        t[0] += (g == y_[:, None])[public].sum(0)
        t[1] += public.sum()

    hits, n = summed(d, ["y", "public", "g"], [(most,), (1,)], right)
    kept = [[i for i in range(k) if hits[i] > n[0] / 2] for k in counts]

    def votes(t, batch):
        g, y_, public = vectors(batch.column("g"), batch.num_rows), batch.column("y").to_numpy(), batch.column("public").to_numpy(zero_copy_only=False)
        for i, own in enumerate(kept):
            v = g[:, own].mean(1) > 0.5 if own else g[:, 0] > 0.5
            for j, rows in enumerate((public, ~public)):
                t[0][i, j] += (v == (y_ > 0.5))[rows].sum()
                t[1][i, j] += rows.sum()

    won, of = summed(d, ["y", "public", "g"], [(len(counts), 2), (len(counts), 2)], votes)
    share = [[float(a / b) if b else None for a, b in zip(x, z)] for x, z in zip(won, of)]
    return df.sparkSession.createDataFrame([(k, len(own), *s) for k, own, s in zip(counts, kept, share)], "submissions int, better long, public double, private double")
