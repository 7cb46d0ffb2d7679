"""Steps that are fitted outside or inside the folds, and searches whose best is scored on the folds that chose it.

Every fit, fill, code, choice of columns and error follows from sums of products by
repeat and fold, so one pass over the rows serves all of them; the rest is small
algebra. Random numbers of a row follow from a hash of its id, so rows of one id share them.
"""

from __future__ import annotations

from math import ceil, sqrt

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.blocks import summed, vectors


def draws(base: np.ndarray, count: int) -> np.ndarray:
    """A row of so many numbers in [0, 1) for each 64-bit hash: the hash and multiples of an odd number, mixed by shifts and products."""
    # fixed values: increment and multipliers of the SplitMix64 generator
    step, first, second = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
    z = base.astype(np.int64).view(np.uint64)[:, None] + step * np.arange(1, count + 1, dtype=np.uint64)
    z = (z ^ (z >> np.uint64(30))) * first
    z = (z ^ (z >> np.uint64(27))) * second
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53)


def _rows(df: DataFrame, row_id: str, xs: list[str], y: str, seed: str) -> DataFrame:
    d = df.filter(F.col(row_id).isNotNull()).select(F.array(*[F.col(c).cast("double") for c in (*xs, y)], F.lit(1.0)).alias("v"), F.xxhash64(F.lit(seed), F.col(row_id).cast("string")).alias("h"))
    return d.filter(~F.exists("v", lambda v: v.isNull() | F.isnan(v)))


def _deviations(g: np.ndarray) -> np.ndarray:
    p, n = len(g) - 2, g[-1, -1]
    mean = g[-1, :p] / n
    sd = np.sqrt(np.maximum(np.diag(g)[:p] / n - mean**2, 0))
    return np.where(sd > 1e-9 * np.maximum(1, np.abs(mean)), sd, np.inf)


def _fit(g: np.ndarray, ridge: float, sd: np.ndarray | None = None) -> np.ndarray:
    """From products of (columns, y, 1) the weights b whose product with a row is the fitted value less y: least squares with a penalty on the squares of the
    coefficients of columns divided by sd, their own deviations if none are given."""
    p, n = len(g) - 2, g[-1, -1]
    sd, mean = _deviations(g) if sd is None else sd, g[-1, :-1] / n
    cov = g[:-1, :-1] / n - np.outer(mean, mean)
    beta = np.linalg.solve(cov[:p, :p] / np.outer(sd, sd) + ridge / n * np.eye(p), cov[:p, p] / sd) / sd
    return np.append(beta, [-1.0, mean[p] - beta @ mean[:p]])


def _error(b: np.ndarray, g: np.ndarray) -> float:
    return float(b @ g @ b / g[-1, -1])


def leak_table(df: DataFrame, row_id: str, xs: list[str], y: str, seed: str, reps: int = 5, folds: int = 5, hidden: float = 0.2, levels: int = 200, noise: int = 100, kept: int = 5, ridge: float = 1.0) -> DataFrame:
    """(leak, uses_label, leaky, honest, gap): mean squared errors over held-out folds and repeats, of a step that saw all rows and of the same step in the training folds
    alone, and by how much the leak flatters. The model is a line in all columns with a penalty.

    standardise: deviations that the penalty goes by. impute: means in the place of a hidden share of values. encode: mean label
    of a meaningless level, of which there are so many. select: so many columns of strongest correlation, noise columns among them. duplicate: every row twice, copies dealt
    to folds apart or together. Rows with nulls are left out; folds without rows or without others count for nothing, and without any there are no rows. The driver holds
    reps x folds x ((columns + noise)^2 + levels x columns) numbers, whatever the number of rows."""
    p, q = len(xs), len(xs) + noise

    def add(t, batch):
        v = vectors(batch.column("v"), batch.num_rows)
        u = draws(batch.column("h").to_numpy(), noise + p + 1 + 2 * reps)
        wide = np.column_stack([v[:, :p], u[:, :noise], v[:, p:]])
        seen = (u[:, noise:q] >= hidden).astype(float)
        holes = np.column_stack([v[:, :p] * seen, 1 - seen, v[:, p:]])
        level = (u[:, q] * levels).astype(int)
        first, second = (np.minimum(folds - 1, (u[:, q + 1 + k * reps : q + 1 + (k + 1) * reps] * folds).astype(int)) for k in (0, 1))
        for r in range(reps):
            for f in range(folds):
                at, copy = first[:, r] == f, second[:, r] == f
                t[0][r, f] += wide[at].T @ wide[at]
                t[1][r, f] += holes[at].T @ holes[at]
                np.add.at(t[2][r, f], level[at], v[at])
                t[3][r, f] += v[copy].T @ v[copy]

    wide, holes, by_level, copies = summed(_rows(df, row_id, xs, y, seed), ["v", "h"], [(reps, folds, q + 2, q + 2), (reps, folds, 2 * p + 2, 2 * p + 2), (reps, folds, levels, p + 2), (reps, folds, p + 2, p + 2)], add)
    own = [*range(p), q, q + 1]

    def filled(by: np.ndarray, g: np.ndarray) -> np.ndarray:
        m = np.zeros((2 * p + 2, p + 2))
        m[:p, :p], m[2 * p :, p:] = np.eye(p), np.eye(2)
        known = by[-1, -1] - np.diag(by)[p : 2 * p]
        m[range(p, 2 * p), range(p)] = by[-1, :p] / np.maximum(known, 1)
        return m.T @ g @ m

    def coded(by: np.ndarray, at: np.ndarray, g: np.ndarray) -> np.ndarray:
        code = np.where(by[:, -1] > 0, by[:, p] / np.maximum(by[:, -1], 1), by[:, p].sum() / by[:, -1].sum())
        cross = code @ at
        return np.block([[np.array([[code**2 @ at[:, -1]]]), cross[None]], [cross[:, None], g]])

    def chosen(by: np.ndarray) -> list[int]:
        n, mean = by[-1, -1], by[-1, : q + 1] / by[-1, -1]
        cov = by[:q, q] / n - mean[:q] * mean[q]
        strength = np.round(np.abs(cov / _deviations(by)), 12)
        return [*sorted(np.argsort(-strength, kind="stable")[:kept].tolist()), q, q + 1]

    found: dict[str, list[tuple[float, float]]] = {}

    def both(name, leaky, honest):
        found.setdefault(name, []).append(tuple(_error(_fit(train, ridge, sd), test) for train, test, sd in (leaky, honest)))

    for r in range(reps):
        w, h, l, c = (t[r].sum(0) for t in (wide, holes, by_level, copies))
        for f in range(folds):
            a, b = w - wide[r, f], wide[r, f]
            if not 0 < b[-1, -1] < w[-1, -1]:
                continue
            plain, test, ix = a[np.ix_(own, own)], b[np.ix_(own, own)], np.ix_
            both("standardise", (plain, test, _deviations(w[ix(own, own)])), (plain, test, None))
            ha, hb, la, lb = h - holes[r, f], holes[r, f], l - by_level[r, f], by_level[r, f]
            both("impute", (filled(h, ha), filled(h, hb), None), (filled(ha, ha), filled(ha, hb), None))
            both("encode", (coded(l, la, plain), coded(l, lb, test), None), (coded(la, la, plain), coded(la, lb, test), None))
            s, i = chosen(w), chosen(a)
            both("select", (a[ix(s, s)], b[ix(s, s)], None), (a[ix(i, i)], b[ix(i, i)], None))
            both("duplicate", (plain + c - copies[r, f], test + copies[r, f], None), (2 * plain, 2 * test, None))
    out = []
    for name, errors in found.items():
        leaky, honest = np.mean(errors, axis=0)
        out.append((name, name in ("encode", "select"), float(leaky), float(honest), float(honest - leaky)))
    return df.sparkSession.createDataFrame(out, "leak string, uses_label boolean, leaky double, honest double, gap double")


def grid(size: int, columns: int) -> list[tuple[float, int]]:
    """About so many settings: penalties, a tenth each of the one before, by numbers of leading columns, evenly spread."""
    wide = max(1, round(sqrt(size)))
    numbers = sorted({max(1, ceil(columns * (i + 1) / wide)) for i in range(wide)})
    return [(100.0 * 0.1**i, k) for i in range(max(1, size // wide)) for k in numbers]


def nested_tuning(df: DataFrame, row_id: str, xs: list[str], y: str, seed: str, sizes: list[int], reps: int = 10, share: float = 0.2, folds: int = 5) -> DataFrame:
    """(size, settings, best, fresh, oracle, nested, optimism, optimism_se, nested_gap, nested_gap_se), errors being mean squares: for grids of settings, the least error over
    folds, the error on fresh rows of that setting refitted to all drawn rows, the least error that any setting has there, and the error of the whole search over outer
    folds, each of which is left out of its search; how much better than fresh the first and the last look, and the standard errors over repeats.

    A repeat draws a share of the rows by hash, the others are fresh. Of settings that are equally good the first counts. Repeats without fresh rows, or with an
    empty fold, outer or within one, are left out. The driver holds reps x folds^2 x columns^2 numbers, whatever the number of rows."""
    p, cells = len(xs), folds * folds

    def add(t, batch):
        v, u = vectors(batch.column("v"), batch.num_rows), draws(batch.column("h").to_numpy(), 2 * reps)
        at = np.where(u[:, :reps] < share, (u[:, reps:] * cells).astype(int), cells)
        for r in range(reps):
            for c in np.unique(at[:, r]):
                t[0][r, c] += v[at[:, r] == c].T @ v[at[:, r] == c]

    (grams,) = summed(_rows(df, row_id, xs, y, seed), ["v", "h"], [(reps, cells + 1, p + 2, p + 2)], add)
    cut = lambda g, k: g[np.ix_([*range(k), p, p + 1], [*range(k), p, p + 1])]

    def over_folds(parts: np.ndarray, settings: list[tuple[float, int]]) -> np.ndarray:
        total = parts.sum(0)
        return np.array([np.mean([_error(_fit(cut(total - g, k), ridge), cut(g, k)) for g in parts]) for ridge, k in settings])

    def first_least(errors: np.ndarray) -> int:
        return int(np.argmin(np.round(errors, 12)))

    out = []
    for size in sizes:
        settings, rows = grid(size, p), []
        for r in range(reps):
            own, fresh = grams[r, :cells].reshape(folds, folds, p + 2, p + 2), grams[r, cells]
            if own[:, :, -1, -1].min() <= 0 or fresh[-1, -1] <= 0:
                continue
            total = own.sum((0, 1))
            errors = over_folds(own.sum(0), settings)
            at_fresh = [_error(_fit(cut(total, k), ridge), cut(fresh, k)) for ridge, k in settings]
            nested = []
            for o in range(folds):
                inner = own.sum(0) - own[o]
                ridge, k = settings[first_least(over_folds(inner, settings))]
                nested.append(_error(_fit(cut(inner.sum(0), k), ridge), cut(own[o].sum(0), k)))
            best = first_least(errors)
            rows.append((errors[best], at_fresh[best], min(at_fresh), np.mean(nested)))
        if rows:
            e = np.array(rows)
            gaps = [e[:, 1] - e[:, 0], e[:, 1] - e[:, 3]]
            spread = [(float(g.mean()), float(g.std(ddof=1) / sqrt(len(g))) if len(g) > 1 else None) for g in gaps]
            out.append((size, len(settings), *map(float, e.mean(0)), *spread[0], *spread[1]))
    columns = ("best", "fresh", "oracle", "nested", "optimism", "optimism_se", "nested_gap", "nested_gap_se")
    return df.sparkSession.createDataFrame(out, "size int, settings int, " + ", ".join(f"{c} double" for c in columns))
