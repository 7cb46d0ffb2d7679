"""Queries of how many clusters there are."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.operators import cluster_counts as C
from tallyloom.operators import modelling as M

from .base import r, table
from .q_resample import _u
from .registry import query


def _points(spark, sf_dir):
    """Two columns in which the labels of the embeddings lie apart."""
    e = table(spark, sf_dir, "embeddings")
    x, y = F.get("embedding", F.lit(0)).cast("double") + (F.col("label") % 3) * 0.8, F.get("embedding", F.lit(1)).cast("double") + F.floor(F.col("label") / 5) * 0.9
    return e.select(F.col("vec_id").alias("id"), F.array(F.round(x, 4), F.round(y, 4)).alias("vec"))


_POINTS = "p AS MATERIALIZED (SELECT vec_id AS id, round(embedding[1]::DOUBLE + (label % 3) * 0.8::DOUBLE, 4) AS x, round(embedding[2]::DOUBLE + floor(label / 5) * 0.9::DOUBLE, 4) AS y FROM embeddings)"


def _em_sql(ks: list[int], starts: int, steps: int) -> str:
    models = ", ".join(f"({k}, {s})" for k in ks for s in range(starts))
    log = "ln(w) - 0.5 * (2 * ln(2 * pi()) + ((x - mx) ** 2 * cyy - 2 * (x - mx) * (y - my) * cxy + (y - my) ** 2 * cxx) / (cxx * cyy - cxy * cxy)) - 0.5 * ln(cxx * cyy - cxy * cxy)"
    parts = [f"""{_POINTS}, m(k, start) AS (VALUES {models}), a AS (SELECT count(*) AS n, avg(x) AS ax, avg(y) AS ay, var_pop(x) AS vx, covar_pop(x, y) AS vxy, var_pop(y) AS vy FROM p),
e AS (SELECT *, 1e-6 * greatest((vx + vy) / 2, 1e-12) AS ridge FROM a),
z0 AS MATERIALIZED (SELECT k, start, j, 1.0::DOUBLE / k AS w, x AS mx, y AS my, vx + ridge AS cxx, vxy AS cxy, vy + ridge AS cyy FROM (SELECT k, start, x, y, row_number() OVER (PARTITION BY k, start ORDER BY md5('mix:' || start || ':' || id), id) AS j FROM m, p) t, e WHERE j <= k)"""]
    for i in range(steps + 1):
        parts.append(f"l{i} AS MATERIALIZED (SELECT k, start, j, id, x, y, l, max(l) OVER o + ln(sum(exp(l - top)) OVER o) AS total FROM (SELECT k, start, j, id, x, y, {log} AS l, max({log}) OVER (PARTITION BY k, start, id) AS top FROM z{i}, p) WINDOW o AS (PARTITION BY k, start, id))")
        if i < steps:
            parts.append(f"""z{i + 1} AS MATERIALIZED (SELECT k, start, j, s / n AS w, sx / s + ax AS mx, sy / s + ay AS my, sxx / s - (sx / s) ** 2 + ridge AS cxx, sxy / s - sx / s * (sy / s) AS cxy, syy / s - (sy / s) ** 2 + ridge AS cyy
  FROM (SELECT k, start, j, sum(r) AS s, sum(r * dx) AS sx, sum(r * dy) AS sy, sum(r * dx * dx) AS sxx, sum(r * dx * dy) AS sxy, sum(r * dy * dy) AS syy FROM (SELECT k, start, j, exp(l - total) AS r, x - ax AS dx, y - ay AS dy FROM l{i}, e) GROUP BY 1, 2, 3), e)""")
    return ", ".join(parts) + f""", s AS (SELECT k, start, round(sum(total) FILTER (j = 1), 6) AS ll, -sum(exp(l - total) * greatest(l - total, ln(1e-300))) AS ent FROM l{steps} GROUP BY 1, 2),
b AS (SELECT *, -2 * ll + (k - 1 + 2 * k + 3 * k) * ln((SELECT n FROM a)) AS bic FROM s QUALIFY row_number() OVER (PARTITION BY k ORDER BY ll DESC, start) = 1)
SELECT k, start, round(ll, 3) AS log_likelihood, round(bic, 3) AS bic, round(bic + 2 * ent, 3) AS icl, bic = min(bic) OVER () AS by_bic, bic + 2 * ent = min(bic + 2 * ent) OVER () AS by_icl FROM b"""


@query(f"WITH {_em_sql([1, 2, 3, 4, 5, 6, 7], 2, 8)}")
def mixture_orders(spark, sf_dir):
    m = C.mixture_orders(_points(spark, sf_dir), [1, 2, 3, 4, 5, 6, 7], 2, 8, "mix")
    low = m.agg(F.min("bic").alias("lb"), F.min("icl").alias("li"))
    m = m.crossJoin(F.broadcast(low))  # one row
    return m.select("k", "start", r("log_likelihood", 3).alias("log_likelihood"), r("bic", 3).alias("bic"), r("icl", 3).alias("icl"), (F.col("bic") == F.col("lb")).alias("by_bic"), (F.col("icl") == F.col("li")).alias("by_icl"))


def _lloyd_sql(source: str, start: str, steps: int) -> str:
    """CTEs from {source}(s, id, x, y, w) and {start}(s, k, j, x, y) to n{steps}(s, k, id, j, d2, w) by Lloyd's steps of all (s, k)."""
    parts = [f"c0 AS MATERIALIZED (SELECT s, k, j, x AS cx, y AS cy FROM {start})"]
    for i in range(steps + 1):
        parts.append(f"n{i} AS MATERIALIZED (SELECT s, k, id, j, x, y, w, (x - cx) ** 2 + (y - cy) ** 2 AS d2 FROM {source} JOIN c{i} USING (s) QUALIFY row_number() OVER (PARTITION BY s, k, id ORDER BY round((x - cx) ** 2 + (y - cy) ** 2, 9), j) = 1)")
        if i < steps:
            parts.append(f"c{i + 1} AS MATERIALIZED (SELECT s, k, j, coalesce(m.x, cx) AS cx, coalesce(m.y, cy) AS cy FROM c{i} LEFT JOIN (SELECT s, k, j, sum(w * x) / sum(w) AS x, sum(w * y) / sum(w) AS y FROM n{i} GROUP BY 1, 2, 3 HAVING sum(w) > 0) m USING (s, k, j))")
    return ", ".join(parts)


_AXES = """a AS (SELECT avg(x) AS ax, avg(y) AS ay, var_pop(x) AS vx, covar_pop(x, y) AS vxy, var_pop(y) AS vy FROM p), t AS (SELECT 0.5 * atan2(2 * vxy, vx - vy) AS t FROM a),
ax AS (SELECT cos(t) * s1 AS x1, sin(t) * s1 AS y1, -sin(t) * s2 AS x2, cos(t) * s2 AS y2 FROM (SELECT t, CASE WHEN abs(cos(t)) >= abs(sin(t)) THEN sign(cos(t)) ELSE sign(sin(t)) END AS s1, CASE WHEN abs(sin(t)) >= abs(cos(t)) THEN sign(-sin(t)) ELSE sign(cos(t)) END AS s2 FROM t)),
b AS (SELECT min(x * x1 + y * y1) AS l1, max(x * x1 + y * y1) AS h1, min(x * x2 + y * y2) AS l2, max(x * x2 + y * y2) AS h2 FROM p, ax)"""


@query(f"""WITH {_POINTS}, {_AXES}, ref AS (SELECT r, id, l1 + {_u("'gap:ref:' || r || ':' || id || ':0'")} * (h1 - l1) AS u, l2 + {_u("'gap:ref:' || r || ':' || id || ':1'")} * (h2 - l2) AS v FROM p, range(3) t(r), b),
sets AS MATERIALIZED (SELECT 0 AS s, id, x, y, 1 AS w FROM p UNION ALL SELECT r + 1, id, u * x1 + v * x2, u * y1 + v * y2, 1 FROM ref, ax), o AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY md5('gap:' || id), id) AS j FROM sets),
start AS (SELECT s, k, j, x, y FROM o, (SELECT unnest([1, 2, 3, 4, 5, 6]) AS k) WHERE j <= k), {_lloyd_sql('sets', 'start', 5)},
i AS (SELECT s, k, ln(sum(d2)) AS l FROM n5 GROUP BY 1, 2), g AS (SELECT k, max(l) FILTER (s = 0) AS own, avg(l) FILTER (s > 0) - max(l) FILTER (s = 0) AS gap, stddev_pop(l) FILTER (s > 0) * sqrt(1 + 1.0::DOUBLE / 3) AS se FROM i GROUP BY k),
q AS (SELECT *, coalesce(gap >= lead(gap) OVER (ORDER BY k) - lead(se) OVER (ORDER BY k), true) AS fits FROM g)
SELECT k, round(own, 5) AS log_inertia, round(gap, 5) AS gap, round(se, 5) AS se, k = (SELECT min(k) FROM q WHERE fits) AS rule FROM q""")
def gap_statistic(spark, sf_dir):
    g = C.gap_statistic(_points(spark, sf_dir), [1, 2, 3, 4, 5, 6], 3, 5, "gap")
    return g.select("k", r("log_inertia", 5).alias("log_inertia"), r("gap", 5).alias("gap"), r("se", 5).alias("se"), "rule")


@query(f"""WITH {_POINTS}, sets AS MATERIALIZED (SELECT (2 * b + h)::INT AS s, id, x, y, ({_u("'stable:half:' || b || ':' || h || ':' || id")} < 0.8)::INT AS w FROM p, range(4) t(b), range(2) u(h)),
o AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY md5('stable:' || id), id) AS j FROM sets WHERE w = 1), start AS (SELECT s, k, j, x, y FROM o, (SELECT unnest([2, 3, 4, 5, 6]) AS k) WHERE j <= k), {_lloyd_sql('sets', 'start', 5)},
c AS (SELECT a.s // 2 AS b, a.k, a.j AS i, z.j AS j, count(*) AS n FROM n5 a JOIN n5 z ON z.s = a.s + 1 AND z.k = a.k AND z.id = a.id WHERE a.s % 2 = 0 AND a.w = 1 AND z.w = 1 GROUP BY ALL),
f AS (SELECT b, k, sum(n * (n - 1) / 2) AS both_, sum(n) AS n FROM c GROUP BY 1, 2), g AS (SELECT b, k, sum(n * (n - 1) / 2) AS one FROM (SELECT b, k, i, sum(n) AS n FROM c GROUP BY ALL) GROUP BY 1, 2), h AS (SELECT b, k, sum(n * (n - 1) / 2) AS two FROM (SELECT b, k, j, sum(n) AS n FROM c GROUP BY ALL) GROUP BY 1, 2)
SELECT k, count(*) AS pairs, round(avg(CASE WHEN (one + two) / 2 = one * two / (n * (n - 1) / 2) THEN 1 ELSE (both_ - one * two / (n * (n - 1) / 2)) / ((one + two) / 2 - one * two / (n * (n - 1) / 2)) END), 5) AS ari FROM f JOIN g USING (b, k) JOIN h USING (b, k) GROUP BY k""")
def subsample_stability(spark, sf_dir):
    return C.subsample_stability(_points(spark, sf_dir), [2, 3, 4, 5, 6], 4, 0.8, 5, "stable").select("k", "pairs", r("ari", 5).alias("ari"))


@query(f"""WITH {_POINTS}, sets AS MATERIALIZED (SELECT 0 AS s, id, x, y, 1 AS w FROM p), o AS (SELECT *, row_number() OVER (ORDER BY id) AS j FROM sets), start AS (SELECT s, k, j, x, y FROM o, (SELECT unnest([2, 3, 4, 5, 6]) AS k) WHERE j <= k), {_lloyd_sql('sets', 'start', 4)},
d AS (SELECT a.k, a.id, a.j, b.j AS other, sum(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) AS s, count(*) AS n FROM n4 a JOIN n4 b ON a.k = b.k GROUP BY ALL),
v AS (SELECT k, id, max(n) FILTER (j = other) AS n, max(s / (n - 1)) FILTER (j = other AND n > 1) AS own, min(s / n) FILTER (j <> other) AS far FROM d GROUP BY 1, 2)
SELECT k, round(avg(CASE WHEN n = 1 THEN 0 WHEN greatest(own, far) > 0 THEN (far - own) / greatest(own, far) ELSE 0 END), 6) AS silhouette FROM v WHERE far IS NOT NULL GROUP BY k""")
def exact_silhouette(spark, sf_dir):
    p = _points(spark, sf_dir)
    first = [list(x["vec"]) for x in p.orderBy("id").limit(6).collect()]
    for k in [2, 3, 4, 5, 6]:
        p = M.kmeans(p, "id", "vec", first[:k], 4)[0].withColumnRenamed("cluster", f"k{k}").drop("d2")
    s = C.silhouette_means(p, [f"k{k}" for k in [2, 3, 4, 5, 6]])
    return s.select(F.substring("clusters", 2, 9).cast("int").alias("k"), r("silhouette").alias("silhouette"))
