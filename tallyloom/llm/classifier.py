"""A quality classifier on random-indexing word vectors.

Each word (by hash, one of `words` rows) has a sparse random index vector that
follows from its number alone. A word's vector is the sum of the index vectors
of its neighbours over the whole corpus: sums of whole numbers, so that order
and partitions change nothing. A document's vector is the weighted mean over
its words; a two-layer network in numpy, fitted on a bounded sample of
labelled documents, gives a probability that is calibrated by a temperature.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch, text


@dataclass(frozen=True)
class Settings:
    """The table of vectors has words x size numbers, 2 MB here, so it may be broadcast; at most sample_rows labelled rows are fitted on."""

    words: int = 8192
    size: int = 64
    spots: int = 2
    reach: int = 2
    rare: float = 1e-3
    sample_rows: int = 20_000
    hidden: int = 32
    epochs: int = 60
    rate: float = 3e-3
    decay: float = 1e-4
    seed: int = 7
    calibration_share: float = 0.2


def index_vectors(s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Of each word the places of its index vector that aren't 0, and their signs."""
    h = text.mix(np.arange(s.words * s.spots, dtype=np.uint64) + np.uint64(s.seed) * np.uint64(1_000_003)).reshape(s.words, s.spots)
    return (h % np.uint64(s.size)).astype(np.int64), np.where((h >> np.uint64(40)) & np.uint64(1), 1.0, -1.0)


def _numbers(col: pa.Array, s: Settings) -> tuple[np.ndarray, text.Words]:
    words = text.Words(col, text.MIXED)
    return (words.hash % np.uint64(s.words)).astype(np.int64), words


def word_vectors(docs: DataFrame, s: Settings = Settings(), text_col: str = "text") -> np.ndarray:
    """words x (size + 1): the context vector and, last, the count of each word over all documents. Each task sends one
    table of sums; the shuffle adds them up by word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spots, signs = index_vectors(s)
        total = np.zeros(s.words * s.size)
        seen = np.zeros(s.words)
        for part in text.slices(batches, "x", 1 << 20):
            w, words = _numbers(part.column("x"), s)
            seen += np.bincount(w, minlength=s.words)
            for o in range(1, s.reach + 1):
                if len(w) <= o:
                    continue
                near = words.text[o:] == words.text[:-o]
                a, b = w[:-o][near], w[o:][near]
                for mine, other in ((a, b), (b, a)):
                    for j in range(s.spots):
                        total += np.bincount(mine * s.size + spots[other, j], signs[other, j], s.words * s.size)
        keep = np.flatnonzero(seen)
        table = total.reshape(s.words, s.size)[keep]
        yield pa.RecordBatch.from_arrays([pa.array(keep), *[pa.array(table[:, j]) for j in range(s.size)], pa.array(seen[keep])], names=["word", *[f"c{j}" for j in range(s.size + 1)]])

    names = [f"c{j}" for j in range(s.size + 1)]
    sums = docs.select(F.col(text_col).alias("x")).mapInArrow(count, "word long, " + ", ".join(f"{n} double" for n in names))
    out = np.zeros((s.words, s.size + 1))
    for r in sums.groupBy("word").agg(*[F.sum(n).alias(n) for n in names]).collect():  # at most `words` rows
        out[r["word"]] = [r[n] for n in names]
    return out


def weighted(table: np.ndarray, s: Settings) -> np.ndarray:
    """Word vectors of length 1, scaled down for common words."""
    v, n = table[:, :-1], table[:, -1]
    v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    share = n / max(n.sum(), 1)
    return (v * (s.rare / (s.rare + share))[:, None]).astype(np.float32)


def pooled(col: pa.Array, vectors: np.ndarray, s: Settings) -> np.ndarray:
    """Per text: the mean vector of its words, its length, and the logarithm of the number of words. Texts without words have zeros."""
    w, words = _numbers(col, s)
    out = np.zeros((words.n_texts, s.size + 2))
    some = np.flatnonzero(words.count)
    if len(some):
        out[some, : s.size] = np.add.reduceat(vectors[w], words.first[:-1][some], axis=0) / words.count[some, None]
    out[:, s.size] = np.linalg.norm(out[:, : s.size], axis=1)
    out[:, s.size + 1] = np.log1p(words.count)
    return out


@dataclass
class Network:
    """Standardised inputs, a tanh layer, one output; log-odds are divided by the temperature."""

    mean: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray] = field(default_factory=list)
    temperature: float = 1.0
    constant: float | None = None

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.layers
        return (np.tanh((x - self.mean) / self.scale @ a + b) @ c + d)[:, 0]

    def probability(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.log_odds(x) / self.temperature, -40, 40)))


def _loss(z: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, z) - y * z))


def fit(x: np.ndarray, y: np.ndarray, s: Settings = Settings()) -> Network:
    """Adam on the log loss; the temperature is the one of least log loss on a share held back. With one class, or no rows, the score is constant."""
    if len(y) == 0 or y.min() == y.max():
        return Network(np.zeros(x.shape[1]), np.ones(x.shape[1]), constant=float(y[0]) if len(y) else 0.5)
    rng = np.random.default_rng(s.seed)
    order = rng.permutation(len(y))
    held = order[: max(1, int(len(y) * s.calibration_share))]
    used = order[len(held) :] if len(order) > len(held) else order
    net = Network(x[used].mean(axis=0), x[used].std(axis=0) + 1e-6)
    net.layers = [rng.normal(0, (1 / x.shape[1]) ** 0.5, (x.shape[1], s.hidden)), np.zeros(s.hidden), rng.normal(0, (1 / s.hidden) ** 0.5, (s.hidden, 1)), np.zeros(1)]
    first, second = [np.zeros_like(p) for p in net.layers], [np.zeros_like(p) for p in net.layers]
    z, t = (x[used] - net.mean) / net.scale, y[used].astype(float)
    step = 0
    for _ in range(s.epochs):
        shuffled = rng.permutation(len(t))
        for at in range(0, len(t), 256):
            rows = shuffled[at : at + 256]
            a, b, c, d = net.layers
            h = np.tanh(z[rows] @ a + b)
            p = 1 / (1 + np.exp(-np.clip(h @ c + d, -40, 40)))
            g = (p - t[rows, None]) / len(rows)
            back = g @ c.T * (1 - h * h)
            grads = [z[rows].T @ back + s.decay * a, back.sum(axis=0), h.T @ g + s.decay * c, g.sum(axis=0)]
            step += 1
            for i, grad in enumerate(grads):
                first[i] = 0.9 * first[i] + 0.1 * grad
                second[i] = 0.999 * second[i] + 0.001 * grad * grad
                net.layers[i] = net.layers[i] - s.rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    odds = net.log_odds(x[held])
    net.temperature = float(min(np.geomspace(0.25, 8, 101), key=lambda k: _loss(odds / k, y[held])))
    return net


def score(docs: DataFrame, labels: DataFrame, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", cut: float = 0.7) -> DataFrame:
    """A row for each document: doc_id, held_out (crc32 of the id as text, modulo 4, is 2), score from 0 to 1, predicted (1 from the cut on).

    Only labels of documents that aren't held out are read; the sample is those
    of smallest hash. Null labels are left out; of several labels of one id the
    smallest counts, and of several texts the first in order. Null and empty texts are scored by their empty vector. A
    null id is never held out. Other columns are left out.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("x"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    vectors = weighted(word_vectors(docs, s, "x"), s)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y")).filter(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & ~held_out)
    sample = known.groupBy("doc_id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(s.sample_rows)
    sample = scratch.written(sample, "sample")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text.slices(batches, "x", 1 << 20):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), pa.array(list(pooled(part.column("x"), shared.value, s)), pa.list_(pa.float64()))], names=["doc_id", "y", "v"])

    rows = docs.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "y").agg(F.min("x").alias("x")).mapInArrow(features, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, y int, v array<double>")
    got = rows.toPandas().sort_values("doc_id", kind="stable")
    x = np.array(got["v"].tolist()).reshape(len(got), s.size + 2)
    net = docs.sparkSession.sparkContext.broadcast(fit(x, got["y"].to_numpy(), s))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text.slices(batches, "x", 1 << 20):
            p = net.value.probability(pooled(part.column("x"), shared.value, s))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(p), pa.array((p >= cut).astype(np.int32))], names=["doc_id", "score", "predicted"])

    scored = docs.mapInArrow(judge, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, predicted int")
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")
