"""A line that is refitted within a stream, from sums that are written once for each batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SUMS = {"n": "1D", "x": "x", "y": "y", "xx": "x * x", "xy": "x * y"}


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _earlier(spark: SparkSession, folder: str, batch: int) -> DataFrame | None:
    """The sums by period of all batches before one."""
    p, fs = _path(spark, f"{folder}/sums")
    if not fs.exists(p):
        return None
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    own = [n for n in names if n.startswith("batch=") and int(n.partition("=")[2]) < batch]
    return spark.read.parquet(*[f"{folder}/sums/{n}" for n in own]) if own else None


def scored_batch(batch: DataFrame, number: int, folder: str) -> None:
    """Scores a batch of (period, x, y) and keeps its sums. A row's line is that of all rows of earlier periods, of this batch and those before it; without two different
    x among them it is their mean, and without any there is no score. Scores and sums are written under the batch's number and overwrite what
    an earlier try has left, and a batch reads only sums of smaller numbers: a batch that is run again changes nothing."""
    spark = batch.sparkSession
    rows = batch.filter("period is not null and x is not null and y is not null").select("period", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    own = rows.groupBy("period").agg(*[F.sum(F.expr(e)).alias(f"s_{c}") for c, e in SUMS.items()])
    own.write.mode("overwrite").parquet(f"{folder}/sums/batch={number}")
    own = spark.read.parquet(f"{folder}/sums/batch={number}")
    before = _earlier(spark, folder, number)
    every = (own if before is None else own.unionByName(before)).groupBy("period").agg(*[F.sum(f"s_{c}").alias(f"s_{c}") for c in SUMS])
    past = Window.orderBy("period").rowsBetween(Window.unboundedPreceding, -1)  # a row a period
    fit = every.select("period", *[F.sum(f"s_{c}").over(past).alias(c) for c in SUMS])
    spread = F.col("xx") - F.col("x") * F.col("x") / F.col("n")
    slope = F.when(spread > 1e-9 * F.col("xx"), (F.col("xy") - F.col("x") * F.col("y") / F.col("n")) / spread).otherwise(0.0)
    line = fit.filter("n > 0").select("period", slope.alias("slope"), ((F.col("y") - slope * F.col("x")) / F.col("n")).alias("start"))
    scores = rows.join(line, "period", "left").withColumn("e", F.col("y") - F.col("start") - F.col("slope") * F.col("x"))
    errors = scores.groupBy("period").agg(F.count("*").alias("n"), F.count("e").alias("scored"), F.sum(F.col("e") * F.col("e")).alias("square"))
    errors.write.mode("overwrite").parquet(f"{folder}/errors/batch={number}")


def refit_stream(stream: DataFrame, folder: str) -> None:
    """Runs a stream of (period, x, y) to the end of what is there, batch by batch; its checkpoint, sums and errors are in the folder, from which it goes on."""
    (stream.writeStream.foreachBatch(lambda batch, number: scored_batch(batch, number, folder)).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination())


def refit_errors(spark: SparkSession, folder: str) -> DataFrame:
    """(period, n, scored, mse) of all batches so far."""
    p, fs = _path(spark, f"{folder}/errors")
    if not fs.exists(p):
        return spark.createDataFrame([], "period date, n long, scored long, mse double")
    e = spark.read.parquet(*[f"{folder}/errors/{s.getPath().getName()}" for s in fs.listStatus(p)])
    return e.groupBy("period").agg(F.sum("n").alias("n"), F.sum("scored").alias("scored"), (F.sum("square") / F.sum("scored")).alias("mse"))
