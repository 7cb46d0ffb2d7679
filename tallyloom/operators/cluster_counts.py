"""How many clusters: mixtures of normals, k-means on data and reference sets, silhouettes, stability.

All models of a study (numbers of clusters, starts, reference sets, subsamples)
take each step together: tasks add up what every model needs of their rows,
and so many sums, by model and cluster, are all that is shuffled and collected.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.blocks import met_in_blocks, summed, vectors
from tallyloom.functions.hashing import md5_share
from tallyloom.functions.storage import written
from tallyloom.operators.resample import key


def sound(df: DataFrame) -> DataFrame:
    """(id, vec) of rows whose id and vector aren't null and whose components are finite, written once."""
    d = df.filter("id is not null and vec is not null").select("id", F.transform("vec", lambda x: x.cast("double")).alias("vec"))
    return written(d.filter(~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))), "points")


def first_rows(table: DataFrame, k: int, seed: str) -> np.ndarray:
    """The vectors of the k rows of smallest hash."""
    return np.array([r["vec"] for r in table.orderBy(F.md5(key(seed, "id")), "id").limit(k).select("vec").collect()], float)


# mixtures


@dataclass
class Mixture:
    weight: np.ndarray
    mean: np.ndarray
    cov: np.ndarray

    def shares(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row the log density and the components' shares of it."""
        d = x.shape[1]
        logs = np.empty((len(x), len(self.weight)))
        for j, (w, m, c) in enumerate(zip(self.weight, self.mean, self.cov)):
            root = np.linalg.cholesky(c)
            z = np.linalg.solve(root, (x - m).T)
            logs[:, j] = (np.log(w) if w > 0 else -np.inf) - 0.5 * (d * np.log(2 * np.pi) + np.square(z).sum(0)) - np.log(np.diag(root)).sum()
        top = logs.max(1, keepdims=True)
        total = top[:, 0] + np.log(np.exp(logs - top).sum(1))
        return total, np.exp(logs - total[:, None])


def mixtures(df: DataFrame, ks: list[int], starts: int, steps: int, seed: str, ridge: float = 1e-6) -> tuple[list[tuple[int, int]], list[Mixture], DataFrame]:
    """Mixtures of normals with full covariances for each k and start, after so many steps of EM, and the table they are of. Means start at the k rows of smallest
    hash of seed and start, covariances at that of all rows, weights equal; `ridge` times the mean variance of all rows is added to the diagonals. A step is one
    aggregate, about the mean of all rows, of sums and products weighted by all models' shares."""
    table = sound(df)
    dims = table.select(F.max(F.size("vec"))).first()[0] or 1

    def whole(t, batch):
        x = vectors(batch.column("vec"), batch.num_rows)
        t[0] += len(x)
        t[1] += x.sum(0)

    n, s = summed(table, ["vec"], [(1,), (dims,)], whole)
    n, centre = float(n[0]), s / max(1.0, float(n[0]))

    def about(t, batch):
        x = vectors(batch.column("vec"), batch.num_rows) - centre
        t[0] += x.T @ x

    (gram,) = summed(table, ["vec"], [(dims, dims)], about)
    cov = gram / max(1.0, n)
    extra = ridge * max(float(np.trace(cov)) / dims, 1e-12) * np.eye(dims)
    names = [(k, s) for k in ks for s in range(starts) if k <= n]
    models = []
    for k, s in names:
        models.append(Mixture(np.full(k, 1 / k), first_rows(table, k, f"{seed}:{s}"), np.repeat((cov + extra)[None], k, 0)))
    for _ in range(steps):
        now = list(models)

        def weighted(t, batch, now=now):
            x = vectors(batch.column("vec"), batch.num_rows)
            for i, m in enumerate(now):
                r, y = m.shares(x)[1], x - centre
                t[3 * i] += r.sum(0)
                t[3 * i + 1] += r.T @ y
                t[3 * i + 2] += np.einsum("nj,np,nq->jpq", r, y, y)

        shapes = [shape for k, _ in names for shape in ((k,), (k, dims), (k, dims, dims))]
        got, models = summed(table, ["vec"], shapes, weighted), []
        for i, old in enumerate(now):
            size, first, second = got[3 * i : 3 * i + 3]
            held = size > 1e-9  # a component without rows stays where it was
            w = np.where(held, size, 1.0)
            mean = first / w[:, None]
            own = second / w[:, None, None] - np.einsum("jp,jq->jpq", mean, mean) + extra
            models.append(Mixture(size / n, np.where(held[:, None], mean + centre, old.mean), np.where(held[:, None, None], own, old.cov)))
    return names, models, table


def mixture_orders(df: DataFrame, ks: list[int], starts: int, steps: int, seed: str) -> DataFrame:
    """(k, start, log_likelihood, bic, icl): of each k the start of largest likelihood (the first of equals to 6 digits). BIC is -2 times it plus ln(n) for each free
    parameter; ICL adds twice the entropy of the shares."""
    names, models, table = mixtures(df, ks, starts, steps, seed)

    def score(t, batch):
        x = vectors(batch.column("vec"), batch.num_rows)
        t[1] += len(x)
        for i, m in enumerate(models):
            total, r = m.shares(x)
            t[0][i] += total.sum(), -(r * np.log(np.maximum(r, 1e-300))).sum()

    (scores, n) = summed(table, ["vec"], [(len(models), 2), (1,)], score) if models else (np.zeros((0, 2)), np.zeros(1))
    rows = []
    for k in ks:
        own = [(round(scores[i, 0], 6), -s, scores[i, 1]) for i, (m, s) in enumerate(names) if m == k]
        if own:
            ll, s, entropy = max(own, key=lambda r: r[:2])
            d = models[0].mean.shape[1]
            bic = -2 * ll + (k - 1 + k * d + k * d * (d + 1) // 2) * np.log(n[0])
            rows.append((k, -s, float(ll), float(bic), float(bic + 2 * entropy)))
    return df.sparkSession.createDataFrame(rows, "k int, start int, log_likelihood double, bic double, icl double")


# k-means of many sets at once


def lloyd(table: DataFrame, columns: list[str], sets, models: list[tuple[int, np.ndarray]], steps: int) -> list[np.ndarray]:
    """Centres after so many of Lloyd's steps of every model (set, first centres). sets(batch) gives the (rows, weights) of all sets; of centres equally near to
    9 digits the first counts, one without rows stays."""
    centres = [np.array(c, float) for _, c in models]
    for _ in range(steps):
        now = list(centres)

        def step(t, batch, now=now):
            own = sets(batch)
            for i, ((s, _), c) in enumerate(zip(models, now)):
                x, w = own[s]
                at = nearest(x, c)[0]
                t[2 * i] += np.bincount(at, w, len(c))
                for d in range(x.shape[1]):
                    t[2 * i + 1][:, d] += np.bincount(at, w * x[:, d], len(c))

        got = summed(table, columns, [shape for c in centres for shape in ((len(c),), c.shape)], step)
        centres = [np.where(got[2 * i][:, None] > 0, got[2 * i + 1] / np.maximum(got[2 * i], 1e-300)[:, None], c) for i, c in enumerate(centres)]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = np.stack([np.square(x - c).sum(1) for c in centres], 1)
    at = np.round(d, 9).argmin(1)
    return at, d[np.arange(len(x)), at]


def gap_statistic(df: DataFrame, ks: list[int], refs: int, steps: int, seed: str) -> DataFrame:
    """(k, log_inertia, gap, se, rule): the mean log inertia of `refs` reference sets less the data's own, its standard error, and whether k is the one of the rule: the
    first whose gap is at least the next one's less its error, the last if there is none.

    A reference set has as many rows, uniform in the box of the data along its principal axes; each row follows from a hash of set, id and axis. An
    axis points to where its largest component is positive. k-means starts at the k rows of smallest hash of each set and takes so many steps."""
    table = sound(df)
    dims = table.select(F.max(F.size("vec"))).first()[0] or 1

    def moments(t, batch):
        x = vectors(batch.column("vec"), batch.num_rows)
        t[0] += len(x)
        t[1] += x.sum(0)
        t[2] += x.T @ x

    n, s, q = summed(table, ["vec"], [(1,), (dims,), (dims, dims)], moments)
    if not n[0]:
        return df.sparkSession.createDataFrame([], "k int, log_inertia double, gap double, se double, rule boolean")
    mean = s / n[0]
    axes = np.linalg.eigh(q / n[0] - np.outer(mean, mean))[1].T[::-1]
    axes = axes * np.sign(axes[np.arange(dims), np.abs(axes).argmax(1)])[:, None]
    on_axis = [F.aggregate(F.zip_with("vec", F.array(*map(F.lit, a.tolist())), lambda x, y: x * y), F.lit(0.0), lambda u, v: u + v) for a in axes]
    ends = table.select(*[c.alias(f"a{i}") for i, c in enumerate(on_axis)]).agg(*[f(f"a{i}").alias(f"{g}{i}") for i in range(dims) for g, f in (("lo", F.min), ("hi", F.max))]).first()
    u = [F.array(*[md5_share(key(seed, F.lit("ref"), F.lit(r), "id", F.lit(i))) for i in range(dims)]) for r in range(refs)]
    drawn = written(table.select("id", "vec", F.array(*u).alias("u"), F.md5(key(seed, "id")).alias("order")), "drawn")
    lo, hi = (np.array([ends[f"{g}{i}"] for i in range(dims)]) for g in ("lo", "hi"))
    placed = lambda v: (lo + v * (hi - lo)) @ axes
    first = drawn.orderBy("order", "id").limit(max(ks)).select("vec", "u").collect()
    begin = [np.array([r["vec"] for r in first], float)] + [placed(np.array([r["u"][i] for r in first], float)) for i in range(refs)]
    models = [(i, begin[i][:k]) for k in ks for i in range(refs + 1) if k <= len(first)]

    def sets(batch):
        m = batch.num_rows
        own = batch.column("u").flatten().flatten().to_numpy(zero_copy_only=False).reshape(m, refs, dims) if refs else np.zeros((m, 0, dims))
        return [(vectors(batch.column("vec"), m), np.ones(m))] + [(placed(own[:, i]), np.ones(m)) for i in range(refs)]

    centres = lloyd(drawn, ["vec", "u"], sets, models, steps)

    def inertia(t, batch):
        own = sets(batch)
        for i, ((s, _), c) in enumerate(zip(models, centres)):
            t[0][i] += nearest(own[s][0], c)[1].sum()

    (total,) = summed(drawn, ["vec", "u"], [(len(models),)], inertia)
    rows = []
    for k in sorted({len(c) for _, c in models}):
        own = [float(np.log(max(v, 1e-300))) for (_, c), v in zip(models, total) if len(c) == k]
        rows.append([k, own[0], float(np.mean(own[1:]) - own[0]), float(np.std(own[1:]) * np.sqrt(1 + 1 / refs))])
    rule = next((a[0] for a, b in zip(rows, rows[1:]) if a[2] >= b[2] - b[3]), rows[-1][0])
    return df.sparkSession.createDataFrame([(*r, r[0] == rule) for r in rows], "k int, log_inertia double, gap double, se double, rule boolean")


def subsample_stability(df: DataFrame, ks: list[int], pairs: int, share: float, steps: int, seed: str) -> DataFrame:
    """(k, pairs, ari): the mean adjusted Rand index, over pairs of subsamples, of the clusters that k-means of either finds among the rows of both. A row is in a
    subsample by a hash below `share`; k-means starts at the subsample's k rows of smallest hash. The index follows from k x k counts."""
    table = sound(df)
    u = F.array(*[md5_share(key(seed, F.lit("half"), F.lit(p), F.lit(h), "id")) for p in range(pairs) for h in (0, 1)])
    drawn = written(table.select("id", "vec", u.alias("u"), F.md5(key(seed, "id")).alias("order")), "drawn")
    models = []
    for s in range(2 * pairs):
        first = np.array([r["vec"] for r in drawn.filter(F.get("u", F.lit(s)) < share).orderBy("order", "id").limit(max(ks)).select("vec").collect()], float)
        models += [(s, first[:k]) for k in ks if k <= len(first)]

    def sets(batch):
        x, v = vectors(batch.column("vec"), batch.num_rows), vectors(batch.column("u"), batch.num_rows)
        return [(x, (v[:, s] < share).astype(float)) for s in range(2 * pairs)]

    centres = dict(zip([(s, len(c)) for s, c in models], lloyd(drawn, ["vec", "u"], sets, models, steps)))
    both = [(p, k) for k in ks for p in range(pairs) if (2 * p, k) in centres and (2 * p + 1, k) in centres]

    def counts(t, batch):
        own = sets(batch)
        for i, (p, k) in enumerate(both):
            x, w = own[2 * p]
            a, b = (nearest(x, centres[2 * p + h, k])[0] for h in (0, 1))
            t[i] += np.bincount(a * k + b, w * own[2 * p + 1][1], k * k).reshape(k, k)

    tables = summed(drawn, ["vec", "u"], [(k, k) for _, k in both], counts) if both else []
    two, rows = lambda v: (v * (v - 1) / 2).sum(), []
    for k in ks:
        scores = []
        for (_, m), t in zip(both, tables):
            if m == k and t.sum() > 1:
                one, other, all_ = two(t.sum(0)), two(t.sum(1)), t.sum() * (t.sum() - 1) / 2
                expected, top = one * other / all_, (one + other) / 2
                scores.append(1.0 if top == expected else float((two(t) - expected) / (top - expected)))
        if scores:
            rows.append((k, len(scores), float(np.mean(scores))))
    return df.sparkSession.createDataFrame(rows, "k int, pairs long, ari double")


# silhouettes


def silhouettes(df: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """df(id, vec, cluster) -> (id, cluster, own, other, silhouette) of all rows, or of those asked for, against all rows: the mean distance to the rest of the row's
    cluster, the least mean distance to another, and their difference over the larger. A row alone in its cluster has 0; with one cluster there is no value.
    Distances are summed by cluster in the task that computes them."""

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        ids, clusters = a.column("id").to_pylist(), np.array(b.column("cluster").to_pylist(), np.int64)
        kinds, where = np.unique(clusters, return_inverse=True)
        x, y = np.array(a.column("vec").to_pylist(), float), np.array(b.column("vec").to_pylist(), float)
        sums, step = np.zeros((len(x), len(kinds))), max(1, 2_000_000 // max(1, len(x)))
        for i in range(0, len(y), step):
            part = y[i : i + step]
            d = np.sqrt(sum(np.square(x[:, j, None] - part[None, :, j]) for j in range(x.shape[1])))
            for c in np.unique(where[i : i + step]).tolist():
                sums[:, c] += d[:, where[i : i + step] == c].sum(1)
        sizes = np.bincount(where)
        return pa.table({"id": pa.array(np.repeat(ids, len(kinds))), "with": pa.array(np.tile(kinds, len(ids))), "s": pa.array(sums.ravel()), "n": pa.array(np.tile(sizes, len(ids)).astype(np.int64))})

    df = df.filter("id is not null and vec is not null and cluster is not null").select("id", "vec", F.col("cluster").cast("long").alias("cluster"))
    asked = df if asked is None else df.join(asked.select("id"), "id", "left_semi")
    sums = met_in_blocks(asked.select("id", "vec"), df, meet, "id long, with long, s double, n long").groupBy("id", "with").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    each = sums.join(asked.select("id", "cluster"), "id").groupBy("id", "cluster")
    same = F.col("with") == F.col("cluster")
    out = each.agg(F.max(F.when(same, F.col("n"))).alias("n"), F.max(F.when(same & (F.col("n") > 1), F.col("s") / (F.col("n") - 1))).alias("own"), F.min(F.when(~same, F.col("s") / F.col("n"))).alias("other"))
    top = F.greatest("own", "other")
    value = F.when(F.col("other").isNull(), None).when(F.col("n") == 1, 0.0).when(top > 0, (F.col("other") - F.col("own")) / top).otherwise(0.0)
    return out.select("id", "cluster", "own", "other", value.alias("silhouette"))


def silhouette_means(df: DataFrame, clusters: list[str], size: int = 8192) -> DataFrame:
    """(clusters, silhouette): the mean silhouette of all rows of df(id, vec, ...) in each of several clusterings, columns of small whole numbers; null with one cluster.

    Rows of equal vector and clusters are one point with a weight. Every two points meet once, in blocks, for all clusterings together, and a task sends on a sum for each
    point and cluster, so work is the square of the number of points; a task holds `size` points and eight times as many of the others."""
    d = df.filter(" and ".join(f"{c} is not null" for c in ("id", "vec", *clusters))).select("vec", F.array(*[F.col(c).cast("long") for c in clusters]).alias("c"))
    points = written(d.groupBy("vec", "c").agg(F.count("*").alias("w")).withColumn("id", F.monotonically_increasing_id()), "points")
    sizes = points.select(F.posexplode("c").alias("which", "with"), "w").groupBy("which", "with").agg(F.sum("w").alias("n")).collect()  # a row a cluster
    place = {(r["which"], r["with"]): i for i, r in enumerate(sorted(sizes, key=lambda r: (r["which"], r["with"])))}
    sizes = {(r["which"], r["with"]): r["n"] for r in sizes}
    which, total = np.array([a for a, _ in place], int), np.array([sizes[p] for p in place], float)

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        x, y = (vectors(t.column("vec").combine_chunks(), t.num_rows) for t in (a, b))
        w, kinds = b.column("w").to_numpy(), vectors(b.column("c").combine_chunks(), b.num_rows).astype(int)
        member, sums = np.zeros((len(y), len(place))), np.zeros((len(x), len(place)))
        for i in range(len(clusters)):
            for c in np.unique(kinds[:, i]).tolist():
                member[kinds[:, i] == c, place[i, c]] = 1
        member *= w[:, None]
        for i in range(0, len(x), 128):  # tiles of 1 MB, filled in place
            for k in range(0, len(y), 1024):
                some, part = x[i : i + 128], y[k : k + 1024]
                d = np.zeros((len(some), len(part)))
                for j in range(x.shape[1]):
                    gap = some[:, j, None] - part[None, :, j]
                    gap *= gap
                    d += gap
                sums[i : i + 128] += np.sqrt(d, out=d) @ member[k : k + 1024]
        ends = np.arange(len(x) + 1, dtype=np.int32) * len(place)
        return pa.table({"id": a.column("id"), "s": pa.ListArray.from_arrays(ends, pa.array(sums.ravel()))})

    met = met_in_blocks(points.select("id", "vec"), points, meet, "id long, s array<double>", size, 8 * size)
    added = met.groupBy("id").agg(F.array(*[F.sum(F.get("s", F.lit(i))) for i in range(len(place))]).alias("s"))

    def add(t, batch):
        s, w, kinds = vectors(batch.column("s"), batch.num_rows), batch.column("w").to_numpy(), vectors(batch.column("c"), batch.num_rows).astype(int)
        for i in range(len(clusters)):
            here = np.flatnonzero(which == i)
            if len(here) < 2:
                continue
            own = np.array([place[i, c] - here[0] for c in kinds[:, i].tolist()])
            row, part, n = np.arange(len(s)), s[:, here], total[here]
            mine = part[row, own] / np.maximum(1, n[own] - 1)
            far = part / n
            far[row, own] = np.inf
            far = far.min(1)
            top = np.maximum(mine, far)
            t[0][i] += (w * np.where((n[own] > 1) & (top > 0), (far - mine) / np.where(top > 0, top, 1), 0)).sum()
            t[1][i] += w.sum()

    s, n = summed(points.select("id", "w", "c").join(added, "id"), ["s", "w", "c"], [(len(clusters),)] * 2, add)
    return df.sparkSession.createDataFrame([(c, float(s[i] / n[i]) if n[i] else None) for i, c in enumerate(clusters)], "clusters string, silhouette double")
