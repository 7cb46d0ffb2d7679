"""Queries of sampled Shapley values."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tallyloom.operators import attribution as A

from .base import r, table
from .registry import query

FEATURES, PAIRS, BACKGROUND = ["a", "b", "c", "d"], 6, 6


def predict(x: np.ndarray) -> np.ndarray:
    """A fixed function with steps and products of four columns."""
    a, b, c, d = (x[..., i] for i in range(4))
    return a * b + 2 * np.maximum(c - 0.5, 0) * a + np.where(d > 0.5, b, c * d)


def _rows(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("id"), (F.col("p_size") / 50).alias("a"), (F.col("p_retailprice") / 2000).alias("b"), (F.col("p_partkey") % 7 / 7).alias("c"), (F.col("p_partkey") % 5 / 5).alias("d"))


_F = "({a} * {b} + 2 * greatest({c} - 0.5, 0) * {a} + CASE WHEN {d} > 0.5 THEN {b} ELSE {c} * {d} END)"
_MIX = _F.format(**{f: f"CASE WHEN s & {1 << i} > 0 THEN x.{f} ELSE g.{f} END" for i, f in enumerate(FEATURES)})
_VALUES = f"""x AS MATERIALIZED (SELECT p_partkey AS id, p_size / 50.0::DOUBLE AS a, p_retailprice / 2000.0::DOUBLE AS b, (p_partkey % 7) / 7.0::DOUBLE AS c, (p_partkey % 5) / 5.0::DOUBLE AS d FROM part),
g AS MATERIALIZED (SELECT * FROM x ORDER BY md5('shapley:background:' || id), id LIMIT {BACKGROUND}), v AS MATERIALIZED (SELECT x.id, s, avg({_MIX}) AS v FROM x, g, range({1 << len(FEATURES)}) t(s) GROUP BY 1, 2),
o AS (SELECT id, p, j, row_number() OVER (PARTITION BY id, p ORDER BY md5('shapley:' || id || ':' || p || ':' || f)) - 1 AS place FROM x, range({PAIRS}) t(p), (VALUES (0, 'a'), (1, 'b'), (2, 'c'), (3, 'd')) n(j, f)),
q AS (SELECT m.id, m.p, m.j, coalesce(sum(1 << z.j) FILTER (z.place < m.place), 0)::BIGINT AS low, coalesce(sum(1 << z.j) FILTER (z.place > m.place), 0)::BIGINT AS high FROM o m JOIN o z USING (id, p) GROUP BY ALL),
step AS (SELECT q.id, q.p, q.j, (b.v - a.v + e.v - c.v) / 2 AS s FROM q JOIN v a ON a.id = q.id AND a.s = low JOIN v b ON b.id = q.id AND b.s = low + (1 << j) JOIN v c ON c.id = q.id AND c.s = high JOIN v e ON e.id = q.id AND e.s = high + (1 << j)),
phi AS (SELECT id, j, 'abcd'[j + 1] AS feature, avg(s) AS value, stddev_samp(s) / sqrt({PAIRS}) AS error FROM step GROUP BY 1, 2)"""


@query(f"WITH {_VALUES}, whole AS (SELECT id, sum(value) AS s FROM phi GROUP BY 1) SELECT phi.id, feature, round(value, 8) + 0.0 AS value, round(error, 8) AS error, abs(whole.s - (t.v - n.v)) < 1e-9 AS efficient FROM phi JOIN whole USING (id) JOIN v t ON t.id = phi.id AND t.s = {(1 << len(FEATURES)) - 1} JOIN v n ON n.id = phi.id AND n.s = 0")
def sampled_shapley(spark, sf_dir):
    d = _rows(spark, sf_dir)
    s = A.sampled_shapley(d, FEATURES, predict, A.background_rows(d, FEATURES, BACKGROUND, "shapley"), PAIRS, "shapley")
    return s.select("id", "feature", (r("value", 8) + 0.0).alias("value"), r("error", 8).alias("error"), (F.abs("gap") < 1e-9).alias("efficient"))


_WEIGHT = {0: "1.0::DOUBLE / 4", 1: "1.0::DOUBLE / 12", 2: "1.0::DOUBLE / 12", 3: "1.0::DOUBLE / 4"}


@query(f"""WITH {_VALUES}, exact AS (SELECT a.id, j, sum((b.v - a.v) * CASE bit_count(a.s) {' '.join(f'WHEN {k} THEN {w}' for k, w in _WEIGHT.items())} END) AS exact FROM v a JOIN range(4) t(j) ON (a.s & (1 << j)) = 0 JOIN v b ON b.id = a.id AND b.s = a.s + (1 << j) GROUP BY 1, 2)
SELECT feature, count(*) AS n, round(avg(abs(exact)), 6) AS mean_abs, round(avg(error), 6) AS mean_error, round(max(abs(value - exact)), 6) AS worst, round(avg((abs(value - exact) <= 3 * error + 1e-12)::INT), 6) AS within FROM phi JOIN exact USING (id, j) GROUP BY 1""")
def shapley_agreement(spark, sf_dir):
    d = _rows(spark, sf_dir)
    b = A.background_rows(d, FEATURES, BACKGROUND, "shapley")
    g = A.agreement(A.sampled_and_exact(d, FEATURES, predict, b, PAIRS, "shapley"))
    return g.select("feature", "n", *[r(c).alias(c) for c in ("mean_abs", "mean_error", "worst", "within")])
