"""Exponential smoothing with a season, and forecasts by simulated paths."""

from __future__ import annotations

import hashlib
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Steps of level, trend, season and damping that are tried, in this order.
GRID = list(product((0.1, 0.3, 0.6), (0.01, 0.1), (0.05, 0.3), (0.9, 0.98)))


def _share(text: str) -> float:
    return int(hashlib.md5(text.encode()).hexdigest()[:13], 16) / 16.0**13


def _normals(seed: str, name: object, paths: int, horizon: int) -> np.ndarray:
    """Standard normal numbers by Box and Muller from two shares of a hash of seed, series, path and step."""
    keys = [f"{seed}:{name}:{p}:{h}" for p in range(paths) for h in range(horizon)]
    a, b = (np.array([_share(f"{k}:{x}") for k in keys]).reshape(paths, horizon) for x in "ab")
    return np.sqrt(-2 * np.log(1 - a)) * np.cos(2 * np.pi * b)


def seasonal_paths(df: DataFrame, series: str, order: str, value: str, season: int, horizon: int, levels: list[float], paths: int, seed: str, least: int = 10) -> DataFrame:
    """(series, method, step, forecast, level, quantile): damped additive trend with an additive season where a series has 2 season + 4 values or more (method
    'season'), without one from `least` values on ('trend'), and else the last value with quantiles of its changes widened by sqrt(step + 1) ('naive').

    The four parameters have the least sum of squared one-step errors on a small grid, the first of equals; a season starts from the first one's
    deviations from its mean, the trend from the difference of the first two seasons' means. Quantiles are of so many paths that run on with
    normal errors of the fitted size, which follow from a hash of seed, series, path and step. Null and NaN values are left out; one series is one
    group. A series without values has no rows."""

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        name = rows[series].iloc[0]
        y = rows.sort_values(order)[value].to_numpy(float)
        y = y[np.isfinite(y)]
        columns = [series, "method", "step", "forecast", "level", "quantile"]
        if not len(y):
            return pd.DataFrame([], columns=columns)
        if len(y) < least:
            change = np.diff(y) if len(y) > 3 else np.zeros(1)
            q = np.quantile(change, levels)
            return pd.DataFrame([(name, "naive", s, float(y[-1]), lv, float(y[-1] + e * np.sqrt(s + 1))) for s in range(horizon) for lv, e in zip(levels, q)], columns=columns)
        m = season if season > 1 and len(y) >= 2 * season + 4 else 1
        a, b, g, f = (np.array(c) for c in zip(*GRID))
        if m > 1:
            first = y[:m].mean()
            level, trend, s = np.full(len(a), first), np.full(len(a), (y[m : 2 * m].mean() - first) / m), np.repeat((y[:m] - first)[:, None], len(a), 1)
        else:
            level, trend, s, g = np.full(len(a), y[0]), np.full(len(a), y[1] - y[0]), np.zeros((1, len(a))), np.zeros(len(a))
        sse = np.zeros(len(a))
        for i in range(m, len(y)):
            ahead = level + f * trend
            e = y[i] - ahead - s[i % m]
            sse += e * e
            level, trend = ahead + a * e, f * trend + a * b * e
            s[i % m] += g * e
        best = int(np.argmin(np.round(sse, 6)))
        a, b, g, f = GRID[best][0], GRID[best][1], (GRID[best][2] if m > 1 else 0.0), GRID[best][3]
        sigma = float(np.sqrt(sse[best] / (len(y) - m)))

        def run(z: np.ndarray) -> np.ndarray:
            lv, t, own, out = np.full(len(z), level[best]), np.full(len(z), trend[best]), np.repeat(s[:, best][None], len(z), 0), []
            for h in range(z.shape[1]):
                at = (len(y) + h) % m
                ahead = lv + f * t
                out.append(ahead + own[:, at] + z[:, h])
                lv, t = ahead + a * z[:, h], f * t + a * b * z[:, h]
                own[:, at] += g * z[:, h]
            return np.array(out)

        point = run(np.zeros((1, horizon)))[:, 0]
        q = np.quantile(run(sigma * _normals(seed, name, paths, horizon)), levels, axis=1)
        method = "season" if m > 1 else "trend"
        return pd.DataFrame([(name, method, s, float(point[s]), lv, float(q[i, s])) for s in range(horizon) for i, lv in enumerate(levels)], columns=columns)

    kind = df.schema[series].dataType.simpleString()
    return df.select(series, order, value).groupBy(series).applyInPandas(fit, f"{series} {kind}, method string, step int, forecast double, level double, quantile double")
