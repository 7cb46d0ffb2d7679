"""Queries of the streams: the events table as a file stream, run to its end."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.streaming import sequential as Q

from .base import r, table
from .registry import query


def _stream(spark, sf_dir):
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    # a file stream takes a folder or a pattern
    s = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"{sf_dir}/events.parquet*")
    return s.select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")



def _ended(spark, sf_dir):
    """The stream of rows with a value, what closes it, and the time of the row that does."""
    end = table(spark, sf_dir, "events").agg(F.max("ts").cast("timestamp") + F.expr("interval 3 days")).first()[0]
    s, close = Q.with_end(spark, _stream(spark, sf_dir), {"ts": end, "value": 0.0})
    return s.filter("value is not null"), close, end


_ORDERED = "o AS (SELECT user_id AS k, epoch_us(ts) AS t, value AS x, row_number() OVER (PARTITION BY user_id ORDER BY ts, value) AS i FROM events WHERE value IS NOT NULL)"


@query(f"""WITH RECURSIVE {_ORDERED}, w AS (SELECT k, var_samp(x) AS v FROM o WHERE i <= 20 GROUP BY 1 HAVING count(*) = 20),
s AS (SELECT k, 21 AS i, v FROM w UNION ALL SELECT s.k, s.i + 1, 0.94::DOUBLE * v + 0.06::DOUBLE * x * x FROM s JOIN o ON o.k = s.k AND o.i = s.i)
SELECT s.k AS user_id, t, round(sqrt(v), 6) AS scale FROM s JOIN o ON o.k = s.k AND o.i = s.i""")
def streaming_ewma(spark, sf_dir):
    s, close, end = _ended(spark, sf_dir)
    found = Q.result(spark, Q.online_ewma(s.withWatermark("ts", "0 seconds"), "user_id", "ts", "value").filter(F.col("ts") < F.lit(end)), "ewma", close)
    return found.select("user_id", F.unix_micros("ts").alias("t"), r("scale").alias("scale"))


@query(f"""WITH RECURSIVE {_ORDERED}, s AS (SELECT DISTINCT k, 0 AS i, 0.1::DOUBLE AS next, []::DOUBLE[] AS scores, 0::BIGINT AS t, 0.0::DOUBLE AS q, 0.0::DOUBLE AS level FROM o
 UNION ALL SELECT k, i, least(1, greatest(0, level + 0.01::DOUBLE * (0.1::DOUBLE - (abs(x - 50) > q)::INT))), list_append(scores, abs(x - 50))[greatest(1, len(scores) - 198):], t, q, level FROM (
  SELECT o.k, o.i, o.t, x, next AS level, scores, CASE WHEN (len(scores) + 1) * (1 - least(greatest(next, 1e-6), 1 - 1e-6)) <= len(scores) THEN list_sort(scores)[least(len(scores), greatest(1, ceil((len(scores) + 1) * (1 - least(greatest(next, 1e-6), 1 - 1e-6)))))::INT] ELSE 'inf'::DOUBLE END AS q FROM s JOIN o ON o.k = s.k AND o.i = s.i + 1))
SELECT k AS user_id, t, CASE WHEN q < 'inf'::DOUBLE THEN round(50 - q, 6) END AS lower, CASE WHEN q < 'inf'::DOUBLE THEN round(50 + q, 6) END AS upper, round(level, 6) AS level FROM s WHERE i > 0""")
def streaming_adaptive_conformal(spark, sf_dir):
    s, close, end = _ended(spark, sf_dir)
    s = s.withColumn("pred", F.lit(50.0)).withWatermark("ts", "0 seconds")
    found = Q.result(spark, Q.adaptive_conformal(s, "user_id", "ts", "pred", "value").filter(F.col("ts") < F.lit(end)), "conformal", close)
    bounded = lambda c: F.when(F.abs(c) < float("inf"), r(c)).alias(c)
    return found.select("user_id", F.unix_micros("ts").alias("t"), bounded("lower"), bounded("upper"), r("level").alias("level"))


@query("""WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.5) AS b, quantile_cont(value, 0.75) AS c FROM events),
w AS (SELECT date_trunc('day', ts) AS d, count(*) AS n, count(*) FILTER (value <= a) / count(*) AS fa, count(*) FILTER (value <= b) / count(*) AS fb, count(*) FILTER (value <= c) / count(*) AS fc FROM events, q WHERE value IS NOT NULL GROUP BY 1)
SELECT epoch_us(d) AS start, n, round(greatest(abs(fa - 0.25), abs(fb - 0.5), abs(fc - 0.75)), 6) AS ks FROM w""")
def streaming_drift(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    edges = [float(x) for x in e.agg(F.percentile("value", [0.25, 0.5, 0.75])).first()[0]]
    s, close, end = _ended(spark, sf_dir)
    found = Q.result(spark, Q.windowed_drift(s, "ts", "value", edges, [1.0, 1.0, 1.0, 1.0], "1 day"), "drift", close)
    return found.filter(F.col("start") < F.date_trunc("day", F.lit(end))).select(F.unix_micros("start").alias("start"), "n", r("ks").alias("ks"))


@query("""WITH p AS (SELECT event_id // 2 AS k, ts AS made, value AS score FROM events WHERE event_id % 2 = 0), l AS (SELECT (event_id - 1) // 2 AS k, ts + INTERVAL 1 HOUR AS arrived, event_type FROM events WHERE event_id % 2 = 1)
SELECT k, epoch_us(made) AS made, score, epoch_us(arrived) AS arrived, event_type FROM p JOIN l USING (k) WHERE arrived >= made AND arrived <= made + INTERVAL 400 DAY""")
def streaming_delayed_labels(spark, sf_dir):
    s = _stream(spark, sf_dir)
    p = s.filter("event_id % 2 = 0").select((F.col("event_id") / 2).cast("long").alias("k"), F.col("ts").alias("made"), F.col("value").alias("score"))
    l = s.filter("event_id % 2 = 1").select(((F.col("event_id") - 1) / 2).cast("long").alias("k"), (F.col("ts") + F.expr("interval 1 hour")).alias("arrived"), "event_type")
    found = Q.result(spark, Q.delayed_labels(p, l, "k", "made", "arrived", "400 days"), "labels")
    return found.select("k", F.unix_micros("made").alias("made"), "score", F.unix_micros("arrived").alias("arrived"), "event_type")
