"""Shapley values against a background sample: exact by subsets, and sampled by permutations."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.blocks import vectors
from tallyloom.operators.resample import key

Predict = Callable[[np.ndarray], np.ndarray]


def background_rows(df: DataFrame, features: list[str], size: int, seed: str) -> np.ndarray:
    """The features of the `size` rows of smallest hash: a bounded sample, and the only rows that reach the driver."""
    rows = df.orderBy(F.md5(key(seed, F.lit("background"), "id")), "id").limit(size).select(*[F.col(f).cast("double").alias(f) for f in features]).collect()
    return np.array([list(r) for r in rows], float).reshape(len(rows), len(features))


def _value(predict: Predict, x: np.ndarray, inside: np.ndarray, background: np.ndarray) -> np.ndarray:
    """For rows x the mean prediction over the background of what is inside a set taken from the row, and the rest from the background."""
    total = np.zeros(len(x))
    for b in background:
        total += predict(np.where(inside, x, b))
    return total / len(background)


def _ranks(features: list[str], pairs: int, seed: str) -> Column:
    """The place of each feature in each of `pairs` permutations, which are ordered by a hash of seed, id, pair and feature."""
    orders = F.array(*[F.array(*[F.md5(key(seed, "id", F.lit(p), F.lit(f))) for f in features]) for p in range(pairs)])
    return F.transform(orders, lambda o: F.transform(o, lambda v: F.size(F.filter(o, lambda w: w < v))))


def _sampled(x: np.ndarray, place: np.ndarray, predict: Predict, background: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values and errors (n x d), and the gap of each row."""
    n, pairs, d = place.shape
    none = _value(predict, x, np.zeros((n, d), bool), background)
    steps = np.zeros((pairs, n, d))
    for p in range(pairs):
        for own in (place[:, p], d - 1 - place[:, p]):
            before = none
            for k in range(d):
                after = _value(predict, x, own <= k, background)
                steps[p, np.arange(n), (own == k).argmax(1)] += (after - before) / 2
                before = after
    value = steps.mean(0)
    error = steps.std(0, ddof=1) / np.sqrt(pairs) if pairs > 1 else np.full((n, d), np.nan)
    return value, error, value.sum(1) - (predict(x) - none)


def _exact(x: np.ndarray, predict: Predict, background: np.ndarray) -> np.ndarray:
    d = x.shape[1]
    sets = [s for size in range(d + 1) for s in combinations(range(d), size)]
    v = {s: _value(predict, x, np.isin(np.arange(d), s)[None], background) for s in sets}
    out = np.zeros(x.shape)
    for j in range(d):
        for s in sets:
            if j not in s:
                out[:, j] += factorial(len(s)) * factorial(d - len(s) - 1) / factorial(d) * (v[tuple(sorted((*s, j)))] - v[s])
    return out


def _by_feature(table: DataFrame, features: list[str], names: list[str], found: Callable[[pa.RecordBatch, np.ndarray], tuple]) -> DataFrame:
    """(id, feature, names) from table(id, x, ...): found(batch, x) gives a matrix (n x d) for each name; NaN becomes null."""
    d = len(features)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if n:
                out = [pa.array(v.ravel(), mask=np.isnan(v.ravel())) for v in found(batch, vectors(batch.column("x"), n))]
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(np.repeat(np.arange(n), d))), pa.array(features * n), *out], names=["id", "feature", *names])

    return table.mapInArrow(rows, f"id {table.schema['id'].dataType.simpleString()}, feature string, {', '.join(f'{c} double' for c in names)}")


def _places(batch: pa.RecordBatch, pairs: int, d: int) -> np.ndarray:
    return batch.column("rank").flatten().flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, pairs, d)


def _features(features: list[str]) -> Column:
    return F.array(*[F.col(f).cast("double") for f in features]).alias("x")


def sampled_shapley(df: DataFrame, features: list[str], predict: Predict, background: np.ndarray, pairs: int, seed: str) -> DataFrame:
    """df(id, features) -> (id, feature, value, error, gap) from `pairs` permutations and their reverses, each ordered by a hash of seed, id, pair and feature: a
    feature's value is the mean step of the prediction when it joins those before it, its standard error that of the pairs' means (null with one), and gap by how much
    the values' sum misses the prediction less its mean over the background. Rows with a null feature have null values."""
    d = len(features)

    def found(batch, x):
        value, error, gap = _sampled(x, _places(batch, pairs, d), predict, background)
        return value, error, np.repeat(gap[:, None], d, 1)

    return _by_feature(df.select("id", _features(features), _ranks(features, pairs, seed).alias("rank")), features, ["value", "error", "gap"], found)


def exact_values(df: DataFrame, features: list[str], predict: Predict, background: np.ndarray) -> DataFrame:
    """df(id, features) -> (id, feature, exact) by all subsets of up to a dozen features, against the same background."""
    if len(features) > 12:
        raise ValueError("subsets of at most 12 features are enumerated; sample them instead")
    return _by_feature(df.select("id", _features(features)), features, ["exact"], lambda batch, x: (_exact(x, predict, background),))


def sampled_and_exact(df: DataFrame, features: list[str], predict: Predict, background: np.ndarray, pairs: int, seed: str) -> DataFrame:
    """(id, feature, value, error, exact): what `sampled_shapley` and `exact_values` give for each row, in one pass, so that the two need no join."""
    if len(features) > 12:
        raise ValueError("subsets of at most 12 features are enumerated; sample them instead")
    d = len(features)

    def found(batch, x):
        return *_sampled(x, _places(batch, pairs, d), predict, background)[:2], _exact(x, predict, background)

    return _by_feature(df.select("id", _features(features), _ranks(features, pairs, seed).alias("rank")), features, ["value", "error", "exact"], found)


def agreement(sampled: DataFrame, exact: DataFrame | None = None) -> DataFrame:
    """(feature, n, mean_abs, mean_error, worst, within): of each feature the mean size of its exact values, the mean standard error, the largest difference of sampled and
    exact, and the share of rows where it is at most three standard errors. Without exact, sampled holds both, as from `sampled_and_exact`, and nothing is joined."""
    both = sampled if exact is None else sampled.join(exact, ["id", "feature"])
    d = F.abs(F.col("value") - F.col("exact"))
    within: Column = F.avg((d <= 3 * F.col("error") + 1e-12).cast("double"))
    return both.groupBy("feature").agg(F.count("value").alias("n"), F.avg(F.abs("exact")).alias("mean_abs"), F.avg("error").alias("mean_error"), F.max(d).alias("worst"), within.alias("within"))
