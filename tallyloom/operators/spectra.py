"""Principal components of a table: how far other samples would move them, how many stand out, what they are good for; and the pull of single rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.blocks import summed, vectors
from tallyloom.functions.hashing import md5_normal_pair, md5_share
from tallyloom.operators.resample import key, poisson


def replicate_covariances(df: DataFrame, row_id: str, columns: list[str], reps: int, seed: str) -> np.ndarray:
    """The covariance matrices of all rows and of `reps` replicates, in which rows have Poisson weights from a hash of seed, replicate and id. A row meets all its
    weights in one Arrow batch, so none is repeated for a replicate. Rows with a null or NaN column take no part."""
    p = len(columns)
    u = F.transform(F.sequence(F.lit(1), F.lit(reps)), lambda r: md5_share(key(seed, r, row_id)))  # one expression, whatever the number of replicates
    w = F.concat(F.array(F.lit(1)), F.transform(u, lambda x: poisson(x).cast("int"))) if reps else F.array(F.lit(1))
    d = df.select(F.array(*[F.col(c).cast("double") for c in columns]).alias("v"), w.alias("w")).filter(~F.exists("v", lambda x: x.isNull() | F.isnan(x)))
    middle = d.agg(*[F.avg(F.get("v", F.lit(i))) for i in range(p)]).first()
    centre = np.array([m or 0.0 for m in middle])

    def add(t, batch):
        x, w = vectors(batch.column("v"), batch.num_rows) - centre, vectors(batch.column("w"), batch.num_rows)
        t[0] += w.sum(0)
        t[1] += w.T @ x
        t[2] += np.einsum("nr,np,nq->rpq", w, x, x, optimize=True)

    n, s, q = summed(d, ["v", "w"], [(reps + 1,), (reps + 1, p), (reps + 1, p, p)], add)
    n = np.maximum(n, 1)
    m = s / n[:, None]
    return q / n[:, None, None] - np.einsum("rp,rq->rpq", m, m)


def components(cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, largest first, and their vectors as rows, each with its largest entry (the first of equals to 9 digits) positive."""
    value, vector = np.linalg.eigh(cov)
    value, vector = value[::-1], vector.T[::-1]
    top = np.round(np.abs(vector), 9).argmax(1)
    return value, vector * np.where(vector[np.arange(len(value)), top] < 0, -1.0, 1.0)[:, None]


def stability(cov: np.ndarray) -> list[tuple]:
    """From covariance matrices, the first of all rows: for each component (i, eigenvalue, least, most, angle, worst, swapped, plane, bound).

    least and most are the range of its eigenvalue over replicates; angle and worst the mean and largest angle, in degrees, to the replicate's i-th component,
    whatever its sign; swapped the share of replicates in which another component is nearer to it; plane the mean largest angle between the planes of the first i
    components, in degrees (0 for all of them); bound that of Davis and Kahan for the i-th component, twice the mean spectral norm of the difference over the
    distance to the nearest other eigenvalue, as a sine (1 at most)."""
    value, vector = components(cov[0])
    p, reps = len(value), [components(c) for c in cov[1:]]
    norms = [float(np.abs(np.linalg.eigvalsh(c - cov[0])).max()) for c in cov[1:]]
    degrees = lambda c: float(np.degrees(np.arccos(np.clip(c, 0.0, 1.0))))
    out = []
    for i in range(p):
        alike = [np.abs(v @ vector[i]) for _, v in reps]
        angles = [degrees(a[i]) for a in alike]
        planes = [degrees(np.linalg.svd(vector[: i + 1] @ v[: i + 1].T, compute_uv=False).min()) if i < p - 1 else 0.0 for _, v in reps]
        gap = min(abs(value[i] - value[j]) for j in range(p) if j != i) if p > 1 else np.inf
        bound = float(min(1.0, 2 * np.mean(norms) / gap)) if gap > 0 else 1.0
        own = [e[i] for e, _ in reps]
        out.append((i + 1, float(value[i]), float(min(own)), float(max(own)), float(np.mean(angles)), max(angles), float(np.mean([a.argmax() != i for a in alike])), float(np.mean(planes)), bound))
    return out


def component_stabilities(df: DataFrame, row_id: str, columns: list[str], reps: int, seed: str) -> DataFrame:
    """The rows of `stability` for the covariance matrix of some columns. Only (reps + 1) p x p matrices are collected."""
    schema = "component int, eigenvalue double, least double, most double, angle double, worst double, swapped double, plane double, bound double"
    return df.sparkSession.createDataFrame(stability(replicate_covariances(df, row_id, columns, reps, seed)), schema)


def parallel_analysis(df: DataFrame, row_id: str, columns: list[str], reps: int, level: float, seed: str) -> DataFrame:
    """(component, eigenvalue, noise, cut, kept) of a correlation matrix: beside each eigenvalue the mean and the `level` quantile of those of `reps` tables of as many rows of
    normal noise, which follows from hashes of seed, replicate, column and id, and whether it and all before it are above the quantile. Constant columns
    have correlations of 0. Noise is drawn and summed up where the rows are."""
    p = len(columns)
    noise = F.array(*[md5_normal_pair(key(seed, F.lit(r), F.lit(c), row_id)) for r in range(reps) for c in columns])
    d = df.select(F.array(*[F.col(c).cast("double") for c in columns]).alias("v"), noise.alias("z")).filter(~F.exists("v", lambda x: x.isNull() | F.isnan(x)))
    middle = d.agg(*[F.avg(F.get("v", F.lit(i))) for i in range(p)]).first()
    centre = np.array([m or 0.0 for m in middle])

    def add(t, batch):
        n = batch.num_rows
        x = np.concatenate([(vectors(batch.column("v"), n) - centre)[:, None], vectors(batch.column("z"), n).reshape(n, reps, p)], 1)
        t[0] += n
        t[1] += x.sum(0)
        t[2] += np.einsum("nrp,nrq->rpq", x, x, optimize=True)

    n, s, q = summed(d, ["v", "z"], [(1,), (reps + 1, p), (reps + 1, p, p)], add)
    n = max(1.0, float(n[0]))
    cov = q / n - np.einsum("rp,rq->rpq", s / n, s / n)
    sd = np.sqrt(np.maximum(np.einsum("rpp->rp", cov), 0))
    sd = np.where(sd > 1e-12, sd, np.inf)
    values = np.linalg.eigvalsh(cov / sd[:, :, None] / sd[:, None, :])[:, ::-1]
    cut = np.quantile(values[1:], level, axis=0)
    kept = np.logical_and.accumulate(values[0] > cut)
    rows = [(i + 1, float(values[0, i]), float(values[1:, i].mean()), float(cut[i]), bool(kept[i])) for i in range(p)]
    return df.sparkSession.createDataFrame(rows, "component int, eigenvalue double, noise double, cut double, kept boolean")


def component_usefulness(df: DataFrame, row_id: str, columns: list[str], y: str, folds: int, seed: str) -> DataFrame:
    """(scaled, k, share, squared_r, held_out, dominant) for k principal components of columns as they are and divided by their deviations: the share of variance of the first
    k, the squared correlation of the k-th with y, R2 on held-out folds of the regression on the first k whose means, deviations and components are of the other
    folds, and the column of largest weight in the k-th (the first of equals). Folds follow from a hash of the id; all follows from a matrix of products for each
    fold. Rows with nulls take no part; a column that doesn't vary stays as it is."""
    p = len(columns)
    d = df.select(F.array(*[F.col(c).cast("double") for c in (*columns, y)], F.lit(1.0)).alias("v"), F.floor(md5_share(key(seed, row_id)) * folds).cast("int").alias("f"))
    d = d.filter(~F.exists("v", lambda x: x.isNull() | F.isnan(x)))

    def add(t, batch):
        x, f = vectors(batch.column("v"), batch.num_rows), batch.column("f").to_numpy()
        for i in range(folds):
            t[0][i] += x[f == i].T @ x[f == i]

    (grams,) = summed(d, ["v", "f"], [(folds, p + 2, p + 2)], add)

    def fit(m: np.ndarray, scaled: bool):
        n = m[-1, -1]
        mean = m[-1, :-1] / n
        cov = m[:-1, :-1] / n - np.outer(mean, mean)
        sd = np.sqrt(np.maximum(np.diag(cov)[:p], 0))
        size = np.where((sd > 1e-12) & scaled, sd, 1.0)
        value, vector = components(cov[:p, :p] / np.outer(size, size))
        return mean, cov, vector / size, value, vector

    rows, total = [], grams.sum(0)
    for scaled in (False, True):
        if not total[-1, -1]:
            break
        mean, cov, weight, value, vector = fit(total, scaled)
        held = {k: [0.0, 0.0] for k in range(1, p + 1)}
        for g in grams:
            if not 0 < g[-1, -1] < total[-1, -1]:
                continue
            m, c, w, _, _ = fit(total - g, scaled)
            for k in range(1, p + 1):
                inner = w[:k] @ c[:p, :p] @ w[:k].T
                beta = np.linalg.pinv(inner, hermitian=True) @ (w[:k] @ c[:p, p])
                b = np.append(beta @ w[:k], [-1.0, m[p] - beta @ w[:k] @ m[:p]])
                level = np.append(np.zeros(p), [-1.0, m[p]])
                held[k][0] += b @ g @ b
                held[k][1] += level @ g @ level
        for k in range(1, p + 1):
            own = weight[k - 1] @ cov[:p, :p] @ weight[k - 1]
            squared = (weight[k - 1] @ cov[:p, p]) ** 2 / (own * cov[p, p]) if own > 1e-12 and cov[p, p] > 0 else None
            r2 = 1 - held[k][0] / held[k][1] if held[k][1] > 0 else None
            rows.append((scaled, k, float(value[:k].sum() / max(value.sum(), 1e-300)), None if squared is None else float(squared), None if r2 is None else float(r2), columns[int(np.round(np.abs(vector[k - 1]), 9).argmax())]))
    return df.sparkSession.createDataFrame(rows, "scaled boolean, k int, share double, squared_r double, held_out double, dominant string")


def leverages(df: DataFrame, row_id: str, columns: list[str], y: str, multiple: float = 2.0) -> DataFrame:
    """(id, leverage, residual, cook, dfbeta, flagged) of a regression with a constant on several columns: the diagonal of the hat matrix, what leaving the row out
    would do to all fits (Cook's distance) and to the columns' coefficients, and whether the leverage is above `multiple` times their mean. cook and dfbeta are null
    where the leverage is 1. Two rows of sums reach the driver; each row then follows from its own columns. Rows with nulls are left out."""
    p = len(columns)
    d = df.select(F.col(row_id).alias("id"), F.array(*[F.col(c).cast("double") for c in (*columns, y)]).alias("v")).filter(~F.exists("v", lambda x: x.isNull() | F.isnan(x)))
    first = d.agg(F.count("*"), *[F.avg(F.get("v", F.lit(i))) for i in range(p + 1)]).first()
    n, mean = first[0], np.array([m or 0.0 for m in first[1:]])

    def add(t, batch):
        x = vectors(batch.column("v"), batch.num_rows) - mean
        t[0] += x.T @ x

    (gram,) = summed(d, ["v"], [(p + 1, p + 1)], add)
    inverse = np.linalg.pinv(gram[:p, :p], hermitian=True)
    beta = inverse @ gram[:p, p]
    rank = int(np.linalg.matrix_rank(gram[:p, :p], hermitian=True)) + 1 if n else 1
    s2 = float(gram[p, p] - beta @ gram[:p, p]) / (n - rank) if n > rank else float("nan")

    def rows(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = vectors(batch.column("v"), batch.num_rows) - mean
            h = np.einsum("np,pq,nq->n", x[:, :p], inverse, x[:, :p]) + 1 / n
            e, full = x[:, p] - x[:, :p] @ beta, h >= 1 - 1e-10
            with np.errstate(divide="ignore", invalid="ignore"):
                cook, move = e * e * h / (rank * s2 * (1 - h) ** 2), (x[:, :p] @ inverse) * (e / (1 - h))[:, None]
            ends = np.arange(len(x) + 1, dtype=np.int32) * p
            lists = pa.ListArray.from_arrays(ends, pa.array(np.where(full[:, None], np.nan, move).ravel()), mask=pa.array(full))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(h), pa.array(e), pa.array(cook, mask=full | ~np.isfinite(cook)), lists, pa.array(h > multiple * rank / n)], names=["id", "leverage", "residual", "cook", "dfbeta", "flagged"])

    return d.mapInArrow(rows, f"id {d.schema['id'].dataType.simpleString()}, leverage double, residual double, cook double, dfbeta array<double>, flagged boolean")
