"""Filling gaps by chained regressions, and what that costs by how the gaps came about."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.blocks import summed, vectors
from tallyloom.functions.storage import written


@dataclass
class Chain:
    """Means of the columns and, for each round, a row of coefficients for each column: of the others' deviations from their means, and a constant."""

    means: np.ndarray
    rounds: list[np.ndarray]

    def fill(self, x: np.ndarray) -> np.ndarray:
        """x with its gaps (NaN) filled: by means, then in every round by the regressions on the round before. Cells that are there never change."""
        gap = np.isnan(x)
        now = np.where(gap, 0.0, x - self.means)
        for b in self.rounds:
            now = np.where(gap, now @ b[:, :-1].T + b[:, -1], now)
        return now + self.means


def _vector(columns: list[str | Column]) -> Column:
    value = [(F.col(c) if isinstance(c, str) else c).cast("double") for c in columns]
    return F.array(*[F.coalesce(v, F.lit(float("nan"))) for v in value])


def _fits(table: DataFrame, columns: list[str], views: list, p: int, rounds: int) -> list[Chain]:
    """A chain for each view, a function of a batch that gives its matrix with gaps as NaN. A round is one pass for all chains."""

    def whole(t, batch):
        for i, view in enumerate(views):
            x = view(batch)
            t[0][i] += (~np.isnan(x)).sum(0)
            t[1][i] += np.nansum(x, 0)

    n, s = summed(table, columns, [(len(views), p)] * 2, whole)
    chains = [Chain(m, []) for m in s / np.maximum(n, 1)]
    for _ in range(rounds):

        def products(t, batch, chains=chains):
            for i, (view, chain) in enumerate(zip(views, chains)):
                x = view(batch)
                z = np.column_stack([chain.fill(x) - chain.means, np.ones(len(x))])
                for j in range(p):
                    own = z[~np.isnan(x[:, j])]
                    t[0][i, j] += own.T @ own

        (grams,) = summed(table, columns, [(len(views), p, p + 1, p + 1)], products)
        fitted = []
        for chain, gram in zip(chains, grams):
            b = np.zeros((p, p + 1))
            for j in range(p):
                others = [c for c in range(p + 1) if c != j]
                b[j, others] = np.linalg.pinv(gram[j][np.ix_(others, others)], hermitian=True) @ gram[j][others, j]
            fitted.append(Chain(chain.means, [*chain.rounds, b]))
        chains = fitted
    return chains


def fit_chain(df: DataFrame, columns: list[str | Column], rounds: int, rows: str = "true") -> Chain:
    """Chained regressions of each column on the others, over the rows where it is there, with gaps as the round before filled them. A round is one aggregate of
    a matrix of products for each column; rows are filled again on the way, and none but the columns are written. A column without values has mean 0."""
    table = written(df.filter(rows).select(_vector(columns).alias("v")), "seen")
    return _fits(table, ["v"], [lambda batch: vectors(batch.column("v"), batch.num_rows)], len(columns), rounds)[0]


def filled(df: DataFrame, columns: list[str | Column], chain: Chain, name: str) -> DataFrame:
    """df with an array `name` of the columns, gaps filled."""

    @F.pandas_udf("array<double>")
    def fill(v):
        return type(v)(list(chain.fill(np.array(v.tolist(), float).reshape(len(v), -1))))

    return df.withColumn(name, fill(_vector(columns)))


def mechanism_errors(df: DataFrame, columns: list[str], gaps: dict[str, list[Column]], studies: list[tuple[str, str, str]], rounds: int) -> DataFrame:
    """(study, method, cells, rmse): the root mean squared error of filled cells, in standard deviations of their column over all rows, by means and by chained
    regressions. gaps names mechanisms: for each column where it is taken out. A study (name, fitted, applied) is fitted under one mechanism and
    fills the gaps of another, so a change of policy after the fit is a study of its own. Columns and gaps are written once; a pass serves all studies."""
    sd = np.array([x or 1.0 for x in df.agg(*[F.stddev_pop(c) for c in columns]).first()])
    names, p = list(gaps), len(columns)
    # gaps are drawn once for all passes
    taken = F.array(*[F.coalesce(g, F.lit(True)) for m in names for g in gaps[m]])
    table = written(df.select(_vector(columns).alias("truth"), taken.alias("taken")), "gaps")

    def matrix(batch, name):
        return vectors(batch.column(name), batch.num_rows)

    def seen(m):
        at = names.index(m) * p
        return lambda batch: np.where(matrix(batch, "taken")[:, at : at + p] > 0, np.nan, matrix(batch, "truth"))

    fitted = list(dict.fromkeys(f for _, f, _ in studies))
    chains = dict(zip(fitted, _fits(table, ["truth", "taken"], [seen(m) for m in fitted], p, rounds)))

    def errors(t, batch):
        truth = matrix(batch, "truth")
        for i, (_, f, applied) in enumerate(studies):
            x = seen(applied)(batch)
            gap = np.isnan(x) & ~np.isnan(truth)
            t[0][i] += gap.sum()
            for j, chain in enumerate((Chain(chains[f].means, []), chains[f])):
                t[1][i, j] += (np.square((chain.fill(x) - truth) / sd)[gap]).sum()

    n, s = summed(table, ["truth", "taken"], [(len(studies),), (len(studies), 2)], errors)
    out = [(name, method, int(n[i]), float(np.sqrt(s[i, j] / n[i])) if n[i] else None) for i, (name, *_) in enumerate(studies) for j, method in enumerate(("mean", "chained"))]
    return df.sparkSession.createDataFrame(out, "study string, method string, cells long, rmse double")
