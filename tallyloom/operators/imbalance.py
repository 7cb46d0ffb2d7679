"""What resampling a rare class changes: ranking, probabilities and decisions of one model under every remedy, on shared training sets."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.blocks import summed, vectors
from tallyloom.functions.hashing import md5_share
from tallyloom.functions.storage import written
from tallyloom.operators.modelling import smote
from tallyloom.operators.resample import key
from tallyloom.operators.scoring import by_score, ranking_scores, threshold_scores
from tallyloom.operators.trees import Tree, _grown

METHODS = ("plain", "oversample", "smote", "undersample", "weights")
#: The scores of the oversampled model, moved back to the share of rare rows that it was drawn from.
CORRECTED = "oversample, prior corrected"


def training_sets(df: DataFrame, row_id: str, vec: str, y: str, reps: int, share: float, seed: str) -> DataFrame:
    """(id, vec, y, rep, u): rows dealt by a hash of their id into as many disjoint training sets, which hold the given share of all rows, and the test set, whose rep is
    null; u is a hash in [0, 1) for draws. Rows with a null id, vector, entry or label are left out."""
    d = df.select(F.col(row_id).alias("id"), F.transform(vec, lambda v: v.cast("double")).alias("vec"), F.col(y).cast("int").alias("y")).filter("id is not null and vec is not null and y is not null")
    d = d.filter(~F.exists("vec", lambda v: v.isNull() | F.isnan(v)))
    at = md5_share(key(seed, F.lit("set"), "id"))
    return d.withColumns({"rep": F.when(at < share, F.floor(at / share * reps).cast("int")), "u": md5_share(key(seed, F.lit("take"), "id"))})


def _weights(y: np.ndarray, u: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A column of weights for each method, of real rows of one training set with `counts` rows of either label."""
    most, rare = counts
    times = most / rare
    copies = np.maximum(1, np.floor(times) + (u < times - np.floor(times)))
    one = np.ones(len(y))
    balanced = np.where(y == 1, counts.sum() / (2 * rare), counts.sum() / (2 * most))
    return np.column_stack([one, np.where(y == 1, copies, 1), one, np.where(y == 1, 1, u < rare / most), balanced])


@dataclass
class Sets:
    """Training sets with their synthetic rows: (vec, y, rep, u, drawn); the columns, real rows by set and label, sets that have both labels, and the share of
    label 1 that a method trains on."""

    rows: DataFrame
    columns: int
    counts: np.ndarray
    used: list[int]
    trained: np.ndarray


def _own(batch: pa.RecordBatch, i: int, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of a batch are of set i, and their weights by method."""
    y, u, rep = (batch.column(c).to_numpy() for c in ("y", "u", "rep"))
    drawn, at = batch.column("drawn").to_numpy(zero_copy_only=False), rep == i
    return at, np.where(drawn[at, None], _weights(y[at], u[at], counts[i]), [name == "smote" for name in METHODS])


def resampled_sets(train: DataFrame, reps: int, k: int, seed: str) -> Sets | None:
    """Real rows are never copied, as copies, discards and class weights are weights; only synthetic rows are added. None without rows."""
    real = written(train, "train")
    one = real.select(F.size("vec")).first()
    if one is None:
        return None

    def labels(t, batch):
        np.add.at(t[0], (batch.column("rep").to_numpy(), batch.column("y").to_numpy()), 1)

    (counts,) = summed(real, ["y", "rep"], [(reps, 2)], labels)
    used = [i for i in range(reps) if counts[i].min() > 0]
    rows = real.select("vec", "y", "rep", "u", F.lit(True).alias("drawn"))
    for i in used:
        made = smote(real.filter(F.col("rep") == i), "id", "vec", "y", 1, k, f"{seed}:{i}")
        rows = rows.unionByName(made.select("vec", F.lit(1).alias("y"), F.lit(i).alias("rep"), F.lit(0.0).alias("u"), F.lit(False).alias("drawn")))
    rows = written(rows, "resampled")

    def totals(t, batch):
        for i in used:
            at, w = _own(batch, i, counts)
            t[0][i, :, 0] += w.sum(0)
            t[0][i, :, 1] += w.T @ batch.column("y").to_numpy()[at]

    (both,) = summed(rows, ["y", "rep", "u", "drawn"], [(reps, len(METHODS), 2)], totals)
    return Sets(rows, one[0], counts, used, both[..., 1] / np.maximum(both[..., 0], 1e-12))


def logistic_fits(sets: Sets, steps: int = 12, ridge: float = 1.0) -> list[tuple[int, str, np.ndarray]]:
    """(set, method, coefficients and intercept) of logistic fits. A step of Newton's is one pass that adds up the gradients and curvatures of all sets and methods.
    `ridge` penalises squares of the coefficients of columns standardised by the set's real rows, not the intercept."""
    reps, p, m = len(sets.counts), sets.columns, len(METHODS)

    def moments(t, batch):
        real = batch.column("drawn").to_numpy(zero_copy_only=False)
        x, rep = vectors(batch.column("vec"), batch.num_rows)[real], batch.column("rep").to_numpy()[real]
        np.add.at(t[0], rep, x)
        np.add.at(t[1], rep, x * x)

    s, q = summed(sets.rows, ["vec", "rep", "drawn"], [(reps, p), (reps, p)], moments)
    n = np.maximum(sets.counts.sum(1), 1)[:, None]
    mean = s / n
    sd = np.sqrt(np.maximum(q / n - mean**2, 0))
    sd = np.where(sd > 1e-12, sd, 1.0)
    beta, used, counts = np.zeros((reps, m, p + 1)), sets.used, sets.counts
    for _ in range(steps):

        def newton(t, batch, beta=beta):
            x, y = vectors(batch.column("vec"), batch.num_rows), batch.column("y").to_numpy()
            for i in used:
                at, w = _own(batch, i, counts)
                z = np.column_stack([(x[at] - mean[i]) / sd[i], np.ones(at.sum())])
                for j in range(m):
                    prob = 1 / (1 + np.exp(-np.clip(z @ beta[i, j], -500, 500)))
                    t[0][i, j] += z.T @ (w[:, j] * (y[at] - prob))
                    t[1][i, j] += z.T @ (z * (w[:, j] * prob * (1 - prob))[:, None])

        g, h = summed(sets.rows, ["vec", "y", "rep", "u", "drawn"], [(reps, m, p + 1), (reps, m, p + 1, p + 1)], newton)
        penalty = np.append(np.full(p, float(ridge)), 0.0)
        beta = beta.copy()
        for i in used:
            for j in range(m):
                beta[i, j] += np.linalg.solve(h[i, j] + np.diag(penalty + 1e-9), g[i, j] - penalty * beta[i, j])
    slopes = beta[:, :, :p] / sd[:, None]
    return [(i, name, np.append(slopes[i, j], beta[i, j, p] - slopes[i, j] @ mean[i])) for i in used for j, name in enumerate(METHODS)]


def _bins(edges: np.ndarray, x: np.ndarray, bins: int) -> np.ndarray:
    """Equal steps between each column's ends, (2 x columns); what lies beyond them is in the outer bins."""
    low, high = edges
    return np.clip(np.floor((x - low) / np.where(high > low, high - low, 1.0) * bins), 0, bins - 1).astype(np.int32)


def weighted_cells(sets: Sets, edges: np.ndarray, bins: int) -> DataFrame:
    """(y, rep, w, bins, n): how many rows of a training set have the same bins, label and weights, w by method. Trees see no more of a row, so they grow from
    these, whose number follows the bins that occur and not the rows."""
    used, counts = sets.used, sets.counts

    def rows(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _bins(edges, vectors(batch.column("vec"), batch.num_rows), bins)
            for i in used:
                at, w = _own(batch, i, counts)
                n, (p, m) = int(at.sum()), (x.shape[1], w.shape[1])
                lists = [pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * k, pa.array(v.ravel())) for k, v in ((m, w.astype(float)), (p, x[at]))]
                yield pa.RecordBatch.from_arrays([pa.array(batch.column("y").to_numpy()[at]), pa.array(np.full(n, i, np.int32)), *lists], names=["y", "rep", "w", "bins"])

    cells = sets.rows.select("vec", "y", "rep", "u", "drawn").mapInArrow(rows, "y int, rep int, w array<double>, bins array<int>")
    return written(cells.groupBy("y", "rep", "w", "bins").agg(F.count("*").alias("n")), "binned")


def boosted_fits(sets: Sets, bins: int = 32, rounds: int = 10, depth: int = 3, rate: float = 0.3, least: int = 5) -> tuple[np.ndarray, list[tuple[int, str, float, list[Tree]]]]:
    """The columns' ends, and (set, method, first score, trees) of gradient boosting by log loss. Trees of all sets and methods grow together, one pass a level and
    round over the rows that differ in bins, label or weights; a leaf has at least so much weight."""
    ends = sets.rows.select(*[F.get("vec", F.lit(c)).alias(f"c{c}") for c in range(sets.columns)]).agg(*[f(f"c{c}") for f in (F.min, F.max) for c in range(sets.columns)]).first()
    edges, used, m = np.array(ends, float).reshape(2, -1), sets.used, len(METHODS)
    binned, n = weighted_cells(sets, edges, bins), len(used) * m
    share = np.clip(sets.trained[used].ravel(), 1e-9, 1 - 1e-9)
    first, grown = np.log(share / (1 - share)), [[] for _ in range(n)]
    for _ in range(rounds):
        so_far = [list(t) for t in grown]

        def rows_of(batch, x, so_far=so_far):
            y, rep = batch.column("y").to_numpy(), batch.column("rep").to_numpy()
            weight = vectors(batch.column("w"), len(x)) * batch.column("n").to_numpy()[:, None]
            w, s, h = (np.zeros((len(x), n)) for _ in range(3))
            for a, i in enumerate(used):
                at = np.flatnonzero(rep == i)
                for j in range(m):
                    t = a * m + j
                    p = 1 / (1 + np.exp(-sum((tree.predict(x[at], depth) for tree in so_far[t]), np.full(len(at), first[t]))))
                    w[at, t], s[at, t], h[at, t] = weight[at, j], weight[at, j] * (y[at] - p), weight[at, j] * p * (1 - p)
            return w, s, h

        for t, tree in enumerate(_grown(binned, n, [[1] * sets.columns] * n, depth, bins, rows_of, False, least, lambda n, s, h: rate * s / max(h, 1e-12))):
            grown[t].append(tree)
    return edges, [(used[t // m], METHODS[t % m], float(first[t]), grown[t]) for t in range(n)]


def resampled_scores(df: DataFrame, row_id: str, vec: str, y: str, reps: int, share: float, seed: str, k: int = 5, model: str = "logistic", recall: float = 0.8, **settings) -> DataFrame:
    """(rep, method, auc, average_precision, precision_at_recall, mean_p, log_loss, brier, recall_half, precision_half, plain_precision, plain_threshold): for every training
    set and remedy, the scores of the test rows, at a cut of one half too, and what the plain model's precision is at the first cut that finds as many rare rows as the
    method does at one half. Label 1 is the rare one; the model is "logistic" or "boosted", with the settings of `logistic_fits` or `boosted_fits`.

    Remedies: none; rare rows counted so often that the labels are even (the whole part of
    the ratio for all, once more by hash); points between rare neighbours; other rows kept
    by hash at the ratio's inverse; balanced weights. The oversampled model appears a second time with its odds
    multiplied by the ratio of the drawn to the trained prior odds. Training sets without rows of both labels have no rows. A
    test row is scored by reps x 6 models, and these scores, rounded to nine digits, are ranked over range partitions."""
    if model not in ("logistic", "boosted"):
        raise ValueError(f"no model {model}")
    d = written(training_sets(df, row_id, vec, y, reps, share, seed), "dealt")  # what vectors are made of is read once
    sets = resampled_sets(d.filter("rep is not null"), reps, k, seed)
    logits, models = (lambda x: np.zeros((len(x), 0))), []
    if sets is not None and sets.used:
        if model == "logistic":
            fits = logistic_fits(sets, **settings)
            slopes = np.array([b for *_, b in fits])
            logits = lambda x: x @ slopes[:, :-1].T + slopes[:, -1]
        else:
            bins, depth = settings.get("bins", 32), settings.get("depth", 3)
            edges, fits = boosted_fits(sets, **settings)

            def logits(x):
                b = _bins(edges, x, bins)
                return np.column_stack([sum((t.predict(b, depth) for t in trees), np.full(len(x), first)) for *_, first, trees in fits])

        odds = lambda r: r / (1 - r)
        models = [(f[0], f[1], at, 0.0) for at, f in enumerate(fits)]
        for i, name, at, _ in list(models):
            was, became = float(sets.counts[i, 1] / sets.counts[i].sum()), float(sets.trained[i, METHODS.index(name)])
            if name == "oversample" and became < 1:
                models.append((i, CORRECTED, at, float(np.log(odds(was) / odds(became)))))
    source, moved = np.array([at for _, _, at, _ in models], int), np.array([s for *_, s in models])
    spark = df.sparkSession
    names = "rep int, method string, model int"
    named = spark.createDataFrame([(i, name, at) for at, (i, name, *_) in enumerate(models)], names)

    def score(batches):
        for batch in batches:
            if batch.num_rows and len(source):
                z = logits(vectors(batch.column("vec"), batch.num_rows))[:, source] + moved
                prob = np.round(1 / (1 + np.exp(-np.clip(z, -500, 500))), 9)
                named = np.tile(np.arange(len(source), dtype=np.int32), len(z))
                yield pa.RecordBatch.from_arrays([pa.array(named), pa.array(prob.ravel()), pa.array(np.repeat(batch.column("y").to_numpy(), len(source)))], names=["model", "p", "y"])

    scored = written(d.filter("rep is null").select("vec", "y").mapInArrow(score, "model int, p double, y int"), "scored")
    ranking = ranking_scores(scored, "model", "p", "y", recall).drop("recall_at_fpr")
    half = threshold_scores(scored, "model", "p", "y", 0.5).select("model", "log_loss", "brier", F.col("recall").alias("recall_half"), F.col("precision").alias("precision_half"))
    means = scored.groupBy("model").agg(F.avg("p").alias("mean_p"))
    every = written(named.join(ranking, "model").join(half, "model").join(means, "model"), "scores")
    plain = by_score(scored.join(F.broadcast(named.filter("method = 'plain'").select("model", "rep")), "model"), "rep", "p", "y")  # a row a training set
    tp, fp = F.col("pos_above") + F.col("pos"), F.col("neg_above") + F.col("neg")
    reach = plain.join(F.broadcast(every.select("rep", "method", "recall_half")), "rep").filter((tp >= F.col("recall_half") * F.col("n_pos") - 1e-9) & (F.col("recall_half") > 0))  # a row a model
    matched = reach.groupBy("rep", "method").agg(F.max_by(tp / (tp + fp), "p").alias("plain_precision"), F.max("p").alias("plain_threshold"))
    return every.drop("model").join(matched, ["rep", "method"], "left")


def paired_remedies(scores: DataFrame) -> DataFrame:
    """(method, reps, means of all scores, and for AUC, average precision and precision at recall the mean difference from the plain model on the same training set and its
    standard error) over the training sets."""
    columns = [c for c in scores.columns if c not in ("rep", "method")]
    compared = ("auc", "average_precision", "precision_at_recall")
    plain = scores.filter("method = 'plain'").select("rep", *[F.col(c).alias(f"_{c}") for c in compared])
    gap = {c: F.col(c) - F.col(f"_{c}") for c in compared}
    means = [F.avg(c).alias(c) for c in columns]
    gaps = [e for c in compared for e in (F.avg(gap[c]).alias(f"{c}_gap"), (F.stddev_samp(gap[c]) / F.sqrt(F.count(gap[c]))).alias(f"{c}_gap_se"))]
    return scores.join(plain, "rep").groupBy("method").agg(F.count("*").alias("reps"), *means, *gaps)
