"""Queries of clusters by density and by linkage."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions.ranks import ranked
from tallyloom.operators import density as D
from tallyloom.operators import learning as L

from .base import r, table
from .registry import query

RADII = [0.0123, 0.0217, 0.0411, 0.0833]
LEAST = 5


def _points(spark, sf_dir, dims: int):
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.transform(F.slice("embedding", 1, dims), lambda x: F.round(x.cast("double"), 3)).alias("vec"), "label")


_POINTS = "p AS (SELECT vec_id AS id, round(embedding[1]::DOUBLE, 3) AS x, round(embedding[2]::DOUBLE, 3) AS y, label FROM embeddings)"


def _labels_sql(rounds: int = 24) -> str:
    """CTEs that end in l(eps, id, core, cluster): the smallest label around, then that label's own, again and again."""
    parts = [f"""{_POINTS}, eps AS (SELECT unnest({RADII}::DOUBLE[]) AS eps),
near AS MATERIALIZED (SELECT eps, a.id AS u, b.id AS v, (a.x - b.x) ** 2 + (a.y - b.y) ** 2 AS d2 FROM eps, p a, p b WHERE (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= eps * eps),
core AS (SELECT eps, u AS id FROM near GROUP BY eps, u HAVING count(*) >= {LEAST}),
link AS MATERIALIZED (SELECT near.* FROM near JOIN core a ON a.eps = near.eps AND a.id = u JOIN core b ON b.eps = near.eps AND b.id = v), l0 AS (SELECT eps, id, id AS c FROM core)"""]
    for i in range(rounds):
        parts.append(f"m{i} AS (SELECT link.eps, u AS id, min(c) AS c FROM link JOIN l{i} ON l{i}.eps = link.eps AND l{i}.id = v GROUP BY 1, 2), l{i + 1} AS MATERIALIZED (SELECT a.eps, a.id, b.c FROM m{i} a JOIN m{i} b ON a.eps = b.eps AND b.id = a.c)")
    parts.append(f"""edge AS (SELECT near.eps, u AS id, v FROM near JOIN core ON core.eps = near.eps AND core.id = v WHERE (near.eps, u) NOT IN (SELECT (eps, id) FROM core)
  QUALIFY row_number() OVER (PARTITION BY near.eps, u ORDER BY d2, v) = 1),
l AS (SELECT eps.eps, p.id, label, c.c IS NOT NULL AS core, coalesce(c.c, e.c, -1) AS cluster FROM eps CROSS JOIN p LEFT JOIN l{rounds} c ON c.eps = eps.eps AND c.id = p.id
  LEFT JOIN (SELECT edge.eps, edge.id, c FROM edge JOIN l{rounds} n ON n.eps = edge.eps AND n.id = edge.v) e ON e.eps = eps.eps AND e.id = p.id)""")
    return ", ".join(parts)


@query(f"WITH {_labels_sql()} SELECT eps, id, core, cluster FROM l")
def density_labels(spark, sf_dir):
    return D.density_clusters(_points(spark, sf_dir, 2), RADII, LEAST).select("eps", "id", "core", "cluster")


@query(f"""WITH {_labels_sql()}, named AS (SELECT *, CASE WHEN cluster >= 0 THEN cluster ELSE -2 - id END AS c FROM l), n AS (SELECT eps, c, label, count(*) AS n FROM named GROUP BY 1, 2, 3),
s AS (SELECT eps, sum(n * (n - 1) / 2) AS both_, sum(n) AS n FROM n GROUP BY 1), a AS (SELECT eps, sum(n * (n - 1) / 2) AS one FROM (SELECT eps, c, sum(n) AS n FROM n GROUP BY 1, 2) GROUP BY 1),
b AS (SELECT eps, sum(n * (n - 1) / 2) AS two FROM (SELECT eps, label, sum(n) AS n FROM n GROUP BY 1, 2) GROUP BY 1), t AS (SELECT eps, count(DISTINCT cluster) FILTER (cluster >= 0) AS clusters, avg((cluster < 0)::INT) AS noise FROM l GROUP BY 1)
SELECT eps, clusters, round(noise, 6) AS noise, round(CASE WHEN (one + two) / 2 = one * two / (n * (n - 1) / 2) THEN 1 ELSE (both_ - one * two / (n * (n - 1) / 2)) / ((one + two) / 2 - one * two / (n * (n - 1) / 2)) END, 6) AS ari
FROM s JOIN a USING (eps) JOIN b USING (eps) JOIN t USING (eps)""")
def density_sweep(spark, sf_dir):
    p = _points(spark, sf_dir, 2)
    s = D.sweep(D.density_clusters(p, RADII, LEAST), p.select("id", "label"))
    return s.select("eps", "clusters", r("noise").alias("noise"), r("ari").alias("ari"))


@query("""WITH e AS (SELECT vec_id AS id, list_transform(embedding[1:8], lambda z: z::DOUBLE) AS v FROM embeddings),
k AS (SELECT a.id, sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) ** 2))) AS d FROM e a JOIN e b ON a.id <> b.id WHERE a.id % 50 = 0 QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY round(d, 9), b.id) = 4),
s AS (SELECT round(d, 6) AS d, row_number() OVER (ORDER BY round(d, 6)) AS i, count(*) OVER () AS n, min(round(d, 6)) OVER () AS lo, max(round(d, 6)) OVER () AS hi FROM k)
SELECT n, d AS knee FROM s ORDER BY round((i - 1) / greatest(1, n - 1) - CASE WHEN hi > lo THEN (d - lo) / (hi - lo) ELSE 0 END, 12) DESC, i LIMIT 1""")
def k_distance_knee(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.transform(F.slice("embedding", 1, 8), lambda x: x.cast("double")).alias("vec"))
    kth = L.neighbours(e.filter("id % 50 = 0"), e, 4).filter("rank = 4").select(r("d").alias("d"), F.lit(1).alias("g"))
    return D.knee(kth, "d", ["g"]).select("n", "knee")


#: Prim's steps: the distances of all points to the tree, the nearest point's taken and the rest brought up to date.
_PRIM = f"""WITH RECURSIVE {_POINTS}, a AS (SELECT list(x ORDER BY id) AS xs, list(y ORDER BY id) AS ys, count(*) AS n FROM p),
prim AS (SELECT 0 AS step, list_transform(range(1, n + 1), lambda i: CASE WHEN i = 1 THEN 0.0::DOUBLE ELSE 1e300::DOUBLE END) AS d, NULL::DOUBLE AS w FROM a
  UNION ALL SELECT step + 1, list_transform(range(1, n + 1), lambda i: CASE WHEN d[i] < 0 OR i = j THEN -1.0 ELSE least(d[i], sqrt((xs[i] - xs[j]) ** 2 + (ys[i] - ys[j]) ** 2)) END), d[j]
  FROM (SELECT step, d, list_position(d, list_min(list_filter(d, lambda z: z >= 0))) AS j FROM prim), a WHERE step < n),
deaths AS (SELECT w FROM prim WHERE step > 1)"""


@query(f"{_PRIM} SELECT row_number() OVER (ORDER BY w) AS i, round(w, 9) AS death FROM deaths")
def linkage_heights(spark, sf_dir):
    tree = D.minimum_spanning_tree(_points(spark, sf_dir, 2))
    return ranked(tree.select("w"), ["w"], rank="i").select("i", r("w", 9).alias("death"))


@query(f"""{_PRIM}, s AS (SELECT w, row_number() OVER (ORDER BY w) AS i, w - lag(w) OVER (ORDER BY w) AS jump, count(*) OVER () AS n FROM deaths)
SELECT any_value(n) + 1 AS n_points, round(max(w), 9) AS longest, round(max(w) / max(w) FILTER (i = n - 1), 6) AS separation_ratio, round((max(w) - min(w)) / avg(w), 6) AS spread_ratio,
 any_value(n) + 2 - arg_max(i, {{'j': round(jump, 12), 'i': -i}}) FILTER (jump IS NOT NULL) AS gap_k, 1 + count(*) FILTER (w > 0.02) AS alive_002, 1 + count(*) FILTER (w > 0.1) AS alive_01 FROM s""")
def persistence_summary(spark, sf_dir):
    tree = D.minimum_spanning_tree(_points(spark, sf_dir, 2))
    alive = D.alive_at(tree, [0.02, 0.1]).agg(F.max(F.when(F.col("radius") == 0.02, F.col("alive"))).alias("alive_002"), F.max(F.when(F.col("radius") == 0.1, F.col("alive"))).alias("alive_01"))
    b = D.barcode(tree).crossJoin(F.broadcast(alive))  # one row each
    return b.select("n_points", r("longest", 9).alias("longest"), r("separation_ratio").alias("separation_ratio"), r("spread_ratio").alias("spread_ratio"), "gap_k", "alive_002", "alive_01")
