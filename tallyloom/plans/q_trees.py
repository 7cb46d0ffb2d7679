"""Queries of trees: bootstrapped, boosted, isolation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions.hashing import md5_share
from tallyloom.operators import modelling as M
from tallyloom.operators import resample as R
from tallyloom.operators import trees as T

from .base import r, table
from .q_resample import _poisson, _u
from .registry import query

NAMES = ["chars", "language", "source", "number"]
BINS, DEPTH, REPS = 12, 3, 20


def _labelled(spark, sf_dir):
    """Rows of labelled documents: four features and the quality label, seven in ten for training."""
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = d.join(l, "doc_id").select(
        F.col("doc_id").alias("id"), F.col("quality").alias("y"), F.least(F.col("n_chars"), F.lit(6000)).alias("chars"), F.ascii("lang").alias("language"),
        F.regexp_extract("source", r"(\d+)$", 1).try_cast("int").alias("source"), (F.col("doc_id") % 11).alias("number"),
    )
    return T.binned(rows.withColumn("train", md5_share(R.key("tree:part", "id")) < 0.7), "id", NAMES, "y", BINS, ["train"])


_BINNED = f"""raw AS (SELECT doc_id AS id, quality::DOUBLE AS y, {_u("'tree:part:' || doc_id")} < 0.7 AS train, [least(n_chars, 6000)::DOUBLE, ascii(lang)::DOUBLE, TRY_CAST(regexp_extract(source, '(\\d+)$', 1) AS INT)::DOUBLE, (doc_id % 11)::DOUBLE] AS v
  FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL),
cells AS (SELECT id, y, train, unnest(v) AS v, unnest(range({len(NAMES)})) AS f FROM raw), ends AS (SELECT f, min(v) AS lo, max(v) AS hi FROM cells GROUP BY f),
x AS MATERIALIZED (SELECT id, y, train, f, CASE WHEN v IS NULL THEN -1 WHEN hi <= lo THEN 0 ELSE least({BINS - 1}, floor((v - lo) / (hi - lo) * {BINS})) END::INT AS b FROM cells JOIN ends USING (f))"""


def _trees_sql(prefix: str, weighted: str, depth: int, gini: bool, leaf: str) -> str:
    """CTEs that grow trees level by level from {weighted}(rep, id, f, b, w, s, h, train) -> {prefix}s(rep, node, f, cut, gain), {prefix}l(rep, node, value), {prefix}n(rep, id, node)."""
    side = "({s}) * (({n}) - ({s})) / ({n})" if gini else "-(({s}) * ({s})) / ({n})"
    parts = [f"{prefix}n0 AS MATERIALIZED (SELECT DISTINCT rep, id, 1 AS node FROM {weighted})"]
    for i in range(depth):
        parts.append(f"""{prefix}h{i} AS (SELECT rep, node, f, b, sum(w) AS n, sum(s) AS s, sum(h) AS h FROM {weighted} JOIN {prefix}n{i} USING (rep, id) WHERE train AND w > 0 AND node >= {1 << i} GROUP BY ALL),
{prefix}c{i} AS (SELECT rep, node, f, b, sum(n) OVER o AS ln, sum(s) OVER o AS ls, sum(h) OVER o AS lh, sum(n) OVER a AS n, sum(s) OVER a AS s, sum(h) OVER a AS h FROM {prefix}h{i} WINDOW o AS (PARTITION BY rep, node, f ORDER BY b ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY rep, node, f)),
{prefix}b{i} AS MATERIALIZED (SELECT *, round({'2.0' if gini else '1.0'} * ({side.format(n='n', s='s')} - {side.format(n='ln', s='ls').replace('-((', '-1 * ((') if gini else '(' + side.format(n='ln', s='ls') + ')'} - ({side.format(n='n - ln', s='s - ls')})), 9) AS gain
  FROM {prefix}c{i} WHERE n - ln > 0 QUALIFY gain > 0 AND row_number() OVER (PARTITION BY rep, node ORDER BY gain DESC, f, b) = 1),
{prefix}n{i + 1} AS MATERIALIZED (SELECT n.rep, n.id, CASE WHEN s.f IS NULL THEN n.node ELSE 2 * n.node + (x.b > s.b)::INT END AS node FROM {prefix}n{i} n LEFT JOIN {prefix}b{i} s ON s.rep = n.rep AND s.node = n.node LEFT JOIN x ON x.id = n.id AND x.f = s.f)""")
    splits = " UNION ALL ".join(f"SELECT rep, node, f, b, gain, ln, ls, lh, n, s, h FROM {prefix}b{i}" for i in range(depth))
    parts.append(f"""{prefix}s AS MATERIALIZED ({splits}),
{prefix}l AS MATERIALIZED (SELECT rep, 2 * node AS node, {leaf.format(n='ln', s='ls', h='lh')} AS value FROM {prefix}s UNION ALL SELECT rep, 2 * node + 1, {leaf.format(n='(n - ln)', s='(s - ls)', h='(h - lh)')} FROM {prefix}s
  UNION ALL SELECT rep, 1, {leaf.format(n='sum(w)', s='sum(s)', h='sum(h)')} FROM {weighted} WHERE train AND w > 0 AND f = 0 GROUP BY rep)""")
    return ", ".join(parts)


_FOREST = f"""{_BINNED}, wt AS (SELECT id, rep::INT AS rep, CASE WHEN rep = 0 THEN 1 ELSE w END AS w FROM (SELECT id, rep, u, {_poisson('u')} AS w FROM (SELECT id, rep, {_u("'tree:' || rep || ':' || id")} AS u FROM raw, range({REPS + 1}) t(rep)))),
wx AS MATERIALIZED (SELECT rep, id, f, b, train, y, w::DOUBLE AS w, w * y AS s, 0.0::DOUBLE AS h FROM x JOIN wt USING (id)),
{_trees_sql('t', 'wx', DEPTH, True, '{s} / {n}')},
vote AS (SELECT n.rep, n.id, raw.y, (l.value > 0.5)::INT AS vote FROM tn{DEPTH} n JOIN raw USING (id) JOIN tl l ON l.rep = n.rep AND l.node = n.node WHERE NOT train),
names AS (SELECT unnest({NAMES}) AS name, unnest(range({len(NAMES)})) AS f),
rep AS (SELECT v.rep, any_value(root) AS root, coalesce(any_value(top), '') AS top, avg((vote = y)::INT) AS accuracy FROM vote v LEFT JOIN (SELECT rep, max(name) FILTER (node = 1) AS root, string_agg(DISTINCT name, ',' ORDER BY name) AS top FROM ts JOIN names USING (f) WHERE node < 8 GROUP BY rep) t ON t.rep = v.rep GROUP BY v.rep)"""


def _parts(spark, sf_dir):
    rows = _labelled(spark, sf_dir)
    return rows.filter("train"), rows.filter("not train")


@query(f"WITH {_FOREST} SELECT rep, root, top, round(accuracy, 6) AS accuracy, root IS NOT DISTINCT FROM (SELECT root FROM rep WHERE rep = 0) AS same_root, top = (SELECT top FROM rep WHERE rep = 0) AS same_top FROM rep")
def tree_bootstrap(spark, sf_dir):
    each, _ = T.reliability(spark, *_parts(spark, sf_dir), NAMES, BINS, REPS, DEPTH, "tree")
    return each.select("rep", "root", "top", r("accuracy").alias("accuracy"), "same_root", "same_top")


@query(f"""WITH {_FOREST}, c AS (SELECT id, sum(vote) AS c FROM vote WHERE rep > 0 GROUP BY id), s AS (SELECT count(*) AS sets, max(n) / {REPS} AS modal FROM (SELECT top, count(*) AS n FROM rep WHERE rep > 0 GROUP BY top))
SELECT (SELECT count(*) FROM rep WHERE rep > 0) AS trees, (SELECT round(avg((root IS NOT DISTINCT FROM (SELECT root FROM rep WHERE rep = 0))::INT), 6) FROM rep WHERE rep > 0) AS root_same, (SELECT round(stddev_pop(accuracy), 6) FROM rep WHERE rep > 0) AS accuracy_sd,
 sets, round(modal, 6) AS modal_share, (SELECT round(sum(c * ({REPS} - c)) / (count(*) * {REPS * (REPS - 1) // 2}), 6) FROM c) AS pair_disagreement, (SELECT round(avg((c > 0 AND c < {REPS})::INT), 6) FROM c) AS any_disagree FROM s""")
def tree_disagreement(spark, sf_dir):
    _, all_ = T.reliability(spark, *_parts(spark, sf_dir), NAMES, BINS, REPS, DEPTH, "tree")
    return all_.select("trees", r("root_same").alias("root_same"), r("accuracy_sd").alias("accuracy_sd"), "sets", r("modal_share").alias("modal_share"), r("pair_disagreement").alias("pair_disagreement"), r("any_disagree").alias("any_disagree"))


@query(f"""WITH {_FOREST} SELECT name AS feature, round(coalesce(g, 0) / ({REPS} * (SELECT count(*) FROM raw WHERE train)), 6) AS impurity FROM names LEFT JOIN (SELECT f, sum(gain) AS g FROM ts WHERE rep > 0 GROUP BY f) USING (f)""")
def tree_impurity(spark, sf_dir):
    return T.importances(spark, *_parts(spark, sf_dir), NAMES, BINS, REPS, DEPTH, "tree").select("feature", r("impurity").alias("impurity"))


@query()
def tree_importances(spark, sf_dir):
    i = T.importances(spark, *_parts(spark, sf_dir), NAMES, BINS, REPS, DEPTH, "tree")
    return i.select("feature", r("impurity").alias("impurity"), r("permuted").alias("permuted"), r("dropped").alias("dropped"))


def _boost_sql(rounds: int, depth: int, rate: float) -> str:
    parts = [f"g0 AS MATERIALIZED (SELECT id, y, train, (SELECT ln(avg(y) / (1 - avg(y))) FROM raw WHERE train) AS score FROM raw)"]
    for k in range(rounds):
        parts.append(f"w{k} AS MATERIALIZED (SELECT 0 AS rep, x.id, f, b, x.train, 1.0::DOUBLE AS w, g.y - 1 / (1 + exp(-score)) AS s, 1 / (1 + exp(-score)) * (1 - 1 / (1 + exp(-score))) AS h FROM x JOIN g{k} g ON g.id = x.id)")
        parts.append(_trees_sql(f"q{k}_", f"w{k}", depth, False, f"{rate} * {{s}} / greatest({{h}}, 1e-12)"))
        parts.append(f"g{k + 1} AS MATERIALIZED (SELECT g.id, y, train, score + CASE WHEN l.node = 1 THEN 0 ELSE l.value END AS score FROM g{k} g JOIN q{k}_n{depth} n ON n.id = g.id JOIN q{k}_l l ON l.node = n.node)")
    every = " UNION ALL ".join(f"SELECT {k} AS round, train, y, score FROM g{k}" for k in range(rounds + 1))
    return f"""WITH {_BINNED}, {', '.join(parts)}, a AS ({every}) SELECT CASE WHEN train THEN 'train' ELSE 'test' END AS part, round, round(avg(-(y * ln(1 / (1 + exp(-score))) + (1 - y) * ln(1 - 1 / (1 + exp(-score))))), 6) AS log_loss, round(avg(((score > 0) <> (y > 0.5))::INT), 6) AS error FROM a GROUP BY 1, 2"""


@query(_boost_sql(6, 3, 0.3))
def boosted_trees(spark, sf_dir):
    c = T.boosting_curve(*_parts(spark, sf_dir), len(NAMES), BINS, 6, 3, 0.3)
    return c.select("part", "round", r("log_loss").alias("log_loss"), r("error").alias("error"))


ISO_DIMS, ISO_TREES, ISO_SIZE = 4, 16, 64
ISO_DEPTH = 6


def _planted(spark, sf_dir):
    """Rows of the first columns of the embeddings, one in 25 of them moved away."""
    e = table(spark, sf_dir, "embeddings").withColumn("y", (F.col("vec_id") % 25 == 0).cast("int"))
    return e.select(F.col("vec_id").alias("id"), F.transform(F.slice("embedding", 1, ISO_DIMS), lambda x: F.round(x.cast("double"), 4) + F.col("y") * 0.35).alias("vec"), "y")


def _isolation_sql() -> str:
    parts = [f"""e AS MATERIALIZED (SELECT vec_id AS id, (vec_id % 25 = 0)::INT AS y, list_transform(embedding[1:{ISO_DIMS}], lambda z: round(z::DOUBLE, 4) + (vec_id % 25 = 0)::INT * 0.35::DOUBLE) AS v FROM embeddings), t AS (SELECT unnest(range({ISO_TREES}))::INT AS tree),
how AS MATERIALIZED (SELECT tree, node, floor({_u("'iso:dim:' || tree || ':' || node")} * {ISO_DIMS})::INT + 1 AS dim, {_u("'iso:cut:' || tree || ':' || node")} AS u FROM t, range(1, {1 << ISO_DEPTH}) k(node)),
s0 AS MATERIALIZED (SELECT tree, id, v, 1::BIGINT AS node FROM e, t QUALIFY row_number() OVER (PARTITION BY tree ORDER BY {_u("'iso:row:' || tree || ':' || id")}, id) <= {ISO_SIZE}), p0 AS MATERIALIZED (SELECT tree, id, v, 1::BIGINT AS node FROM e, t)"""]
    for i in range(ISO_DEPTH):
        parts.append(f"""c{i} AS MATERIALIZED (SELECT tree, node, dim, lo + u * (hi - lo) AS cut FROM (SELECT s.tree, s.node, any_value(dim) AS dim, any_value(u) AS u, min(v[dim]) AS lo, max(v[dim]) AS hi, count(*) AS n FROM s{i} s JOIN how USING (tree, node) WHERE node >= {1 << i} GROUP BY 1, 2) WHERE n > 1 AND hi > lo),
s{i + 1} AS MATERIALIZED (SELECT tree, id, v, CASE WHEN dim IS NULL THEN node ELSE 2 * node + (v[dim] > cut)::INT END AS node FROM s{i} LEFT JOIN c{i} USING (tree, node)),
p{i + 1} AS MATERIALIZED (SELECT tree, id, v, CASE WHEN dim IS NULL THEN node ELSE 2 * node + (v[dim] > cut)::INT END AS node FROM p{i} LEFT JOIN c{i} USING (tree, node))""")
    path = "CASE WHEN {n} <= 1 THEN 0 WHEN {n} = 2 THEN 1 ELSE 2 * (ln({n} - 1) + 0.5772156649015329) - 2 * ({n} - 1) / {n} END"
    parts.append(f"""leaf AS (SELECT tree, node, count(*)::DOUBLE AS n FROM s{ISO_DEPTH} GROUP BY 1, 2),
scores AS MATERIALIZED (SELECT id, y, round(2 ** (-avg(floor(log2(node) + 1e-9) + {path.format(n='leaf.n')}) / ({path.format(n=f'{ISO_SIZE}.0::DOUBLE')})), 9) AS score FROM p{ISO_DEPTH} JOIN leaf USING (tree, node) JOIN e USING (id) GROUP BY id, y)""")
    return ", ".join(parts)


def _isolation(spark, sf_dir):
    s = T.isolation_scores(_planted(spark, sf_dir), ISO_DIMS, ISO_TREES, ISO_SIZE, "iso")
    return s.select("id", "y", r("score", 9).alias("score"))


@query(f"WITH {_isolation_sql()} SELECT id, y, round(score, 6) AS score FROM scores")
def isolation_scores(spark, sf_dir):
    return _isolation(spark, sf_dir).withColumn("score", r("score"))


@query(f"""WITH {_isolation_sql()}, n AS (SELECT count(*) AS n FROM scores), rate AS (SELECT unnest([0.01, 0.04, 0.1]::DOUBLE[]) AS rate), cut AS (SELECT rate, (SELECT list(score ORDER BY score DESC) FROM scores)[ceil(rate * n)::INT] AS cut FROM rate, n)
SELECT rate, round(count(*) FILTER (score >= cut) / count(*), 6) AS flagged, round(sum(y) FILTER (score >= cut) / count(*) FILTER (score >= cut), 6) AS precision, round(sum(y) FILTER (score >= cut) / sum(y), 6) AS recall FROM cut, scores GROUP BY rate""")
def isolation_flags(spark, sf_dir):
    f = T.flagged(_isolation(spark, sf_dir), "score", "y", [0.01, 0.04, 0.1])
    return f.select("rate", *[r(c).alias(c) for c in ("flagged", "precision", "recall")])


_D = "sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) ** 2)))"


@query(f"""WITH {_isolation_sql()}, n AS MATERIALIZED (SELECT a.id AS q, b.id AS id, {_D} AS d FROM e a JOIN e b ON a.id <> b.id QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY round(d, 9), b.id) <= 5),
k AS (SELECT q, max(d) AS kth FROM n GROUP BY 1), l AS (SELECT n.q, 1 / avg(greatest(d, kth)) AS lrd FROM n JOIN k ON k.q = n.id GROUP BY 1), f AS (SELECT n.q, avg(o.lrd) / any_value(l.lrd) AS lof FROM n JOIN l ON l.q = n.q JOIN l o ON o.q = n.id GROUP BY 1),
a AS (SELECT 'isolation' AS method, score, y FROM scores WHERE (id // 5) % 10 = 0 UNION ALL SELECT 'neighbour distance', round(kth, 6), y FROM k JOIN e ON e.id = q WHERE (q // 5) % 10 = 0 UNION ALL SELECT 'local outlier factor', round(lof, 6), y FROM f JOIN e ON e.id = q WHERE (q // 5) % 10 = 0)
SELECT method, count(*) AS n, round(avg(auc), 6) AS auc FROM (SELECT x.method, x.score, (SELECT avg((x.score > z.score)::INT + 0.5 * (x.score = z.score)::INT) FROM a z WHERE z.method = x.method AND z.y = 0) AS auc, y FROM a x) WHERE y = 1 GROUP BY 1""".replace("count(*) AS n, round(avg(auc), 6) AS auc FROM (", "(SELECT count(*) FROM a w WHERE w.method = u.method) AS n, round(avg(auc), 6) AS auc FROM (").replace(") WHERE y = 1 GROUP BY 1", ") u WHERE y = 1 GROUP BY method"))
def anomaly_methods(spark, sf_dir):
    rows = _planted(spark, sf_dir)
    asked = rows.filter("floor(id / 5) % 10 = 0")  # stated queries, against all rows
    iso = _isolation(spark, sf_dir).join(asked.select("id"), "id").select(F.lit("isolation").alias("method"), "score", "y")
    near = M.anomaly_scores(asked.select("id", "vec"), rows.select("id", "vec"), 5).join(asked.select("id", "y"), "id")
    more = [near.select(F.lit(name).alias("method"), r(c).alias("score"), "y") for name, c in (("neighbour distance", "kth"), ("local outlier factor", "lof"))]
    return T.rank_auc(iso.union(more[0]).union(more[1]), ["method"], "score", "y").select("method", "n", r("auc").alias("auc"))
