"""Queries of selection on a reused holdout, of component stability, and of refits within a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions.hashing import md5_normal_pair, md5_share
from tallyloom.functions.storage import fresh_dir
from tallyloom.operators import resample as R
from tallyloom.operators import selection as S
from tallyloom.operators import spectra as P
from tallyloom.streaming import refits

from .base import r, table
from .q_resample import _u
from .registry import query

NOISE, STEPS = 16, 6


def _worlds(spark, sf_dir):
    """Parts with two columns that matter, sixteen of noise, and a target of both and noise."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") / 10).alias("real0"), (F.col("p_retailprice") / 100).alias("real1"))
    z = lambda i: md5_normal_pair(R.key("noise", F.lit(i), "id"))
    u = md5_share(R.key("world", "id"))
    p = p.withColumns({f"noise{i}": F.round(z(i), 6) for i in range(NOISE)} | {"e": z(NOISE)})
    part = F.when(u < 0.1, "train").when(u < 0.2, "holdout").otherwise("fresh")
    return p.withColumns({"y": F.round(F.col("real0") * 0.3 + F.col("real1") * 0.1 + F.col("e"), 6), "part": part})


@query()
def greedy_holdout(spark, sf_dir):
    names = [f"noise{i}" for i in range(NOISE)] + ["real0", "real1"]
    g = S.greedy_selection(_worlds(spark, sf_dir), names, names, "y", "part", STEPS)
    return g.select("step", "feature", *[r(c).alias(c) for c in S.PARTS])


COUNTS = [1, 10, 40, 120]


@query(f"""WITH d AS MATERIALIZED (SELECT doc_id AS id, quality::INT AS y, {_u("'vote:public:' || doc_id")} < 0.5 AS pub FROM labels WHERE quality IS NOT NULL),
g AS MATERIALIZED (SELECT id, y, pub, i, ({_u("'vote:guess:' || i || ':' || id")} < 0.5)::INT AS g FROM d, range({max(COUNTS)}) t(i)),
ok AS (SELECT i FROM g WHERE pub GROUP BY i HAVING 2 * sum((g = y)::INT) > count(*)), k AS (SELECT unnest({COUNTS}) AS k),
kept AS (SELECT k, i FROM k JOIN ok ON i < k), own AS (SELECT k, i FROM kept UNION ALL SELECT k, 0 FROM k WHERE k NOT IN (SELECT k FROM kept)),
v AS (SELECT k, id, any_value(y) AS y, any_value(pub) AS pub, (avg(g) > 0.5)::INT AS v FROM own JOIN g USING (i) GROUP BY k, id)
SELECT k AS submissions, (SELECT count(*) FROM kept WHERE kept.k = v.k) AS better, round(avg((v = y)::INT) FILTER (pub), 6) AS public, round(avg((v = y)::INT) FILTER (NOT pub), 6) AS private FROM v GROUP BY k""")
def leaderboard_votes(spark, sf_dir):
    v = S.submission_votes(table(spark, sf_dir, "labels"), "doc_id", "quality", COUNTS, "vote")
    return v.select("submissions", "better", r("public").alias("public"), r("private").alias("private"))


@query()
def component_stabilities(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", *[F.get("embedding", F.lit(i)).cast("double").alias(f"c{i}") for i in range(6)])
    s = P.component_stabilities(e, "vec_id", [f"c{i}" for i in range(6)], 40, "spectrum")
    return s.select("component", *[r(c).alias(c) for c in ("eigenvalue", "least", "most", "angle", "worst", "swapped", "plane", "bound")])


@query("""WITH e AS (SELECT CAST(ts AS DATE) AS period, (hour(ts) + minute(ts) / 60.0)::DOUBLE AS x, value AS y FROM events WHERE value IS NOT NULL AND ts IS NOT NULL), s AS (SELECT period, count(*) AS n, sum(x) AS x, sum(y) AS y, sum(x * x) AS xx, sum(x * y) AS xy FROM e GROUP BY 1),
c AS (SELECT period, sum(n) OVER w AS n, sum(x) OVER w AS x, sum(y) OVER w AS y, sum(xx) OVER w AS xx, sum(xy) OVER w AS xy FROM s WINDOW w AS (ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT period, (xy - x * y / n) / (xx - x * x / n) AS slope, n, x, y FROM c), l AS (SELECT period, slope, (y - slope * x) / n AS start FROM f)
SELECT epoch_us(period::TIMESTAMP) AS period, count(*) AS n, count(start) AS scored, round(avg((y - start - slope * x) ** 2), 4) AS mse FROM e LEFT JOIN l USING (period) GROUP BY 1""")
def streaming_refits(spark, sf_dir):
    path = f"{sf_dir}/events.parquet"
    s = spark.readStream.schema(spark.read.parquet(path).schema).option("recursiveFileLookup", True).parquet(f"{path}*")
    s = s.select(F.to_date("ts").alias("period"), (F.hour("ts") + F.minute("ts") / 60).alias("x"), F.col("value").alias("y"))
    folder = fresh_dir(spark, "refits")
    refits.refit_stream(s, folder)
    e = refits.refit_errors(spark, folder)
    return e.select(F.unix_micros(F.col("period").cast("timestamp")).alias("period"), "n", "scored", r("mse", 4).alias("mse"))
