"""Queries of chained regressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions.hashing import md5_share
from tallyloom.operators import imputation as I
from tallyloom.operators import resample as R

from .base import r, table
from .q_resample import _u
from .registry import query

COLUMNS, ROUNDS = ["a", "b", "c"], 3
STUDIES = [("random", "random", "random"), ("large values", "large", "large"), ("by label", "label", "label"), ("policy change", "label", "random")]


def _rows(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    return l.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_quantity").cast("double").alias("a"), (F.col("l_extendedprice") / 1000).alias("b"), (F.col("l_quantity") * 0.3 + F.col("l_linenumber")).alias("c"), (F.col("l_returnflag") == "R").alias("y"))


def _gaps():
    u = lambda m, c: md5_share(R.key("gap", F.lit(m), F.lit(c), "id"))
    large = {"a": F.col("a") > 25, "b": F.col("b") > 38, "c": F.col("c") > 11}
    return {
        "random": [u("random", c) < 0.2 for c in COLUMNS], "large": [(u("large", c) < 0.4) & large[c] for c in COLUMNS],
        "label": [u("label", c) < F.when(F.col("y"), 0.5).otherwise(0.08) for c in COLUMNS],
    }


_ROWS = "x AS MATERIALIZED (SELECT row_number() OVER () AS k, l_orderkey * 10 + l_linenumber AS id, l_quantity::DOUBLE AS a, l_extendedprice / 1000 AS b, l_quantity * 0.3::DOUBLE + l_linenumber AS c, l_returnflag = 'R' AS y FROM lineitem)"


def _share(m: str, c: str) -> str:
    return _u(f"'gap:{m}:{c}:' || id")


_GAP = {
    "random": {c: f"{_share('random', c)} < 0.2" for c in "abc"}, "large": {c: f"({_share('large', c)} < 0.4 AND {c} > {v})" for c, v in (("a", 25), ("b", 38), ("c", 11))},
    "label": {c: f"{_share('label', c)} < CASE WHEN y THEN 0.5 ELSE 0.08 END" for c in "abc"},
}


def _chain_sql(name: str, fitted: str, applied: str) -> str:
    """CTEs of one study: rounds of three regressions on the fitted gaps, and the same ones on the applied gaps; {name}e has the errors."""
    seen = lambda m: ", ".join(f"CASE WHEN NOT {_GAP[m][c]} THEN {c} END AS {c}" for c in "abc")
    start = lambda src: ", ".join(f"coalesce({c} - m{c}, 0) AS d{c}, {c} IS NULL AS g{c}" for c in "abc")
    parts = [f"{name}s AS MATERIALIZED (SELECT k, id, {seen(fitted)} FROM x), {name}t AS MATERIALIZED (SELECT k, id, {seen(applied)} FROM x), {name}m AS (SELECT avg(a) AS ma, avg(b) AS mb, avg(c) AS mc FROM {name}s)"]
    parts += [f"{name}f0 AS MATERIALIZED (SELECT k, id, {start('s')} FROM {name}s, {name}m), {name}p0 AS MATERIALIZED (SELECT k, id, {start('t')} FROM {name}t, {name}m)"]
    for i in range(ROUNDS):
        fits = []
        for c, (u, v) in {"a": "bc", "b": "ac", "c": "ab"}.items():
            w = f"FILTER (NOT g{c})"
            cov = lambda p, q: f"covar_pop(d{p}, d{q}) {w}"
            det = f"(var_pop(d{u}) {w} * var_pop(d{v}) {w} - ({cov(u, v)}) ** 2)"
            b1, b2 = f"(({cov(c, u)}) * var_pop(d{v}) {w} - ({cov(c, v)}) * ({cov(u, v)})) / {det}", f"(({cov(c, v)}) * var_pop(d{u}) {w} - ({cov(c, u)}) * ({cov(u, v)})) / {det}"
            fits.append(f"{b1} AS {c}1, {b2} AS {c}2, avg(d{c}) {w} - ({b1}) * avg(d{u}) {w} - ({b2}) * avg(d{v}) {w} AS {c}0")
        parts.append(f"{name}b{i} AS MATERIALIZED (SELECT {', '.join(fits)} FROM {name}f{i})")
        step = ", ".join(f"CASE WHEN g{c} THEN {c}1 * d{u} + {c}2 * d{v} + {c}0 ELSE d{c} END AS d{c}, g{c}" for c, (u, v) in {"a": "bc", "b": "ac", "c": "ab"}.items())
        parts.append(f"{name}f{i + 1} AS MATERIALIZED (SELECT k, id, {step} FROM {name}f{i}, {name}b{i}), {name}p{i + 1} AS MATERIALIZED (SELECT k, id, {step} FROM {name}p{i}, {name}b{i})")
    error = lambda i: " + ".join(f"coalesce(sum(((d{c} + m{c} - x.{c}) / s{c}) ** 2) FILTER (g{c}), 0)" for c in "abc")
    cells = "count(*) FILTER (ga) + count(*) FILTER (gb) + count(*) FILTER (gc)"
    parts.append(f"{name}e AS (" + " UNION ALL ".join(f"SELECT '{m}' AS method, {cells} AS cells, sqrt(({error(i)}) / ({cells})) AS rmse FROM {name}p{i} JOIN x USING (k), {name}m, sd" for m, i in (("mean", 0), ("chained", ROUNDS))) + ")")
    return ", ".join(parts)


_ALL = ", ".join(_chain_sql(f"k{i}_", f, a) for i, (_, f, a) in enumerate(STUDIES))
_UNION = " UNION ALL ".join(f"SELECT '{n}' AS study, method, cells, round(rmse, 5) AS rmse FROM k{i}_e" for i, (n, _, _) in enumerate(STUDIES))


@query(f"WITH {_ROWS}, sd AS (SELECT stddev_pop(a) AS sa, stddev_pop(b) AS sb, stddev_pop(c) AS sc FROM x), {_ALL} {_UNION}")
def imputation_errors(spark, sf_dir):
    return I.mechanism_errors(_rows(spark, sf_dir), COLUMNS, _gaps(), STUDIES, ROUNDS).withColumn("rmse", r("rmse", 5))


@query(f"WITH {_ROWS}, sd AS (SELECT 1.0 AS sa, 1.0 AS sb, 1.0 AS sc), {_chain_sql('k_', 'random', 'random')} SELECT id, round(da + ma, 5) AS a, round(db + mb, 5) AS b, round(dc + mc, 5) AS c FROM k_p{ROUNDS}, k_m WHERE ga OR gb OR gc")
def chained_imputation(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    holes = _gaps()["random"]
    seen = rows.select("id", *[F.when(~g, F.col(c)).alias(c) for c, g in zip(COLUMNS, holes)])
    f = I.filled(seen, COLUMNS, I.fit_chain(seen, COLUMNS, ROUNDS), "v").filter("a is null or b is null or c is null")
    return f.select("id", *[r(F.get("v", F.lit(i)), 5).alias(c) for i, c in enumerate(COLUMNS)])
