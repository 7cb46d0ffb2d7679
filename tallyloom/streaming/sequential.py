"""Sequential algorithms as streams: state by key, late rows bounded by a watermark, the same rows as in batch.

Rows of a key may arrive out of order within the watermark. They are held back
until it has passed them and are then replayed in order, so the state is the
recursion's own few numbers and the rows within the delay. Keys are dealt to buckets
by hash, which share a call of Python.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


#: Groups that keys are dealt to by hash, each a call of Python and a row of state.
BUCKETS = 1024


def _replayed(stream: DataFrame, key: str, time: str, columns: list[str], out: str, start: Callable[[], list], step: Callable[[list, tuple], tuple | None], buckets: int) -> DataFrame:
    """Applies step(memory, row values) in order of time to each key's rows once the watermark has passed them. Keys share a call and a row of state by bucket,
    as a call of Python costs more than a key's rows; state is held as bytes of numbers."""
    kind = stream.schema[key].dataType.simpleString()
    names = [key, "_t", *[x.split()[0] for x in out.split(", ")]]

    def run(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known, sizes, numbers, *held = state.get if state.exists else ([], *[b""] * 5)
        known = list(known)
        index = {k: i for i, k in enumerate(known)}
        memory = [m.tolist() for m in np.split(np.frombuffer(numbers), np.cumsum(np.frombuffer(sizes, np.int64))[:-1])] if known else []
        parts = [(np.frombuffer(held[0], np.int64), np.frombuffer(held[1], np.int64), np.frombuffer(held[2]).reshape(-1, len(columns)))]
        for b in batches:
            codes, found = pd.factorize(b[key], use_na_sentinel=False)
            found = [None if pd.isna(k) else k for k in found]
            for k in found:
                if k not in index:
                    index[k] = len(known)
                    known.append(k)
                    memory.append(start())
            parts.append((np.array([index[k] for k in found], np.int64)[codes], b["_t"].to_numpy(np.int64), b[columns].to_numpy(float)))
        who, at, values = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((*values.T[::-1], at, who))
        who, at, values = who[order], at[order], values[order]
        done = at <= state.getCurrentWatermarkMs() * 1000
        rows = []
        for w, t, r in zip(who[done].tolist(), at[done].tolist(), values[done].tolist()):
            if (got := step(memory[w], r)) is not None:
                rows.append((known[w], t, *got))
        left = who[~done], at[~done], values[~done]
        sizes = np.array([len(m) for m in memory], np.int64)
        state.update((known, sizes.tobytes(), np.array([x for m in memory for x in m], float).tobytes(), *[x.tobytes() for x in left]))
        if len(left[1]):
            state.setTimeoutTimestamp(max(int(left[1].min() // 1000), state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame(rows, columns=names)

    state_type = "known array<string>, sizes binary, numbers binary, who binary, at binary, vals binary"
    dealt = stream.select(F.pmod(F.xxhash64(key), F.lit(buckets)).alias("_b"), F.col(key).cast("string").alias(key), time, F.unix_micros(time).alias("_t"), *columns)
    found = dealt.groupBy("_b").applyInPandasWithState(run, f"{key} string, _t long, {out}", state_type, "append", GroupStateTimeout.EventTimeTimeout)
    return found.select(F.col(key).cast(kind).alias(key), F.timestamp_micros("_t").alias(time), *names[2:])


def online_ewma(stream: DataFrame, key: str, time: str, value: str, lam: float = 0.94, warmup: int = 20, buckets: int = BUCKETS) -> DataFrame:
    """(key, time, scale): the scale before each point is seen, from the warm-up's sample variance on. The stream has a watermark on time."""

    def step(memory: list, row: tuple):
        # count, mean and sum of squares of the warm-up; then the variance
        n, mean, m2, v = memory
        x = row[0]
        if n < warmup:
            n += 1
            d = x - mean
            mean += d / n
            m2 += d * (x - mean)
            memory[:] = [n, mean, m2, m2 / (n - 1) if n == warmup else 0.0]
            return None
        memory[3] = lam * v + (1 - lam) * x * x
        return (v**0.5,)

    return _replayed(stream, key, time, [value], "scale double", lambda: [0.0, 0.0, 0.0, 0.0], step, buckets)


def adaptive_conformal(stream: DataFrame, key: str, time: str, pred: str, truth: str, alpha: float = 0.1, gamma: float = 0.01, window: int = 200, buckets: int = BUCKETS) -> DataFrame:
    """(key, time, lower, upper, level): the interval from the last scores at the current level, unbounded at first; the level
    moves by gamma times (alpha - miss) and stays within [0, 1]."""

    def step(memory: list, row: tuple):
        level, scores = memory[0], memory[1:]
        p, y = row
        if scores:
            share = 1 - min(max(level, 1e-6), 1 - 1e-6)
            k = min(len(scores), max(1, -int(-(len(scores) + 1) * share // 1)))
            q = sorted(scores)[k - 1] if (len(scores) + 1) * share <= len(scores) else float("inf")
        else:
            q = float("inf")
        miss = float(abs(y - p) > q)
        memory[:] = [min(1.0, max(0.0, level + gamma * (alpha - miss))), *(scores + [abs(y - p)])[-window:]]
        return (p - q, p + q, level)

    return _replayed(stream, key, time, [pred, truth], "lower double, upper double, level double", lambda: [alpha], step, buckets)


def windowed_drift(stream: DataFrame, time: str, value: str, edges: list[float], reference: list[float], width: str = "30 days", delay: str = "1 day") -> DataFrame:
    """(window start, n, ks): per tumbling window the largest gap between its histogram's running share and the reference's, on
    fixed bins. Sums of bins are the state; rows later than the watermark are left out."""
    bins = F.aggregate(F.array(*[F.lit(e) for e in edges]), F.lit(0), lambda a, e: a + (F.col(value) > e).cast("int"))
    counts = [F.count_if(F.col("_bin") == i).alias(f"_c{i}") for i in range(len(edges) + 1)]
    w = stream.withWatermark(time, delay).withColumn("_bin", bins).groupBy(F.window(time, width).alias("w")).agg(F.count("*").alias("n"), *counts)
    gaps, upto = [], F.lit(0)
    for i in range(len(edges)):
        upto = upto + F.col(f"_c{i}")
        gaps.append(F.abs(upto / F.col("n") - float(sum(reference[: i + 1]) / sum(reference))))
    return w.select(F.col("w.start").alias("start"), "n", (F.greatest(*gaps) if len(gaps) > 1 else gaps[0]).alias("ks"))


def delayed_labels(predictions: DataFrame, labels: DataFrame, key: str, made: str, arrived: str, within: str = "7 days", delay: str = "1 day") -> DataFrame:
    """Predictions joined with labels that arrive up to a time after them: two streams, both with watermarks, so state is bounded."""
    p = predictions.withWatermark(made, delay).alias("p")
    l = labels.withWatermark(arrived, delay).alias("l")
    on = (F.col(f"p.{key}") == F.col(f"l.{key}")) & (F.col(f"l.{arrived}") >= F.col(f"p.{made}")) & (F.col(f"l.{arrived}") <= F.col(f"p.{made}") + F.expr(f"interval {within}"))
    return p.join(l, on).drop(F.col(f"l.{key}"))


def run_once(df: DataFrame, path: str, checkpoint: str) -> None:
    """Runs a stream over what is there, into Parquet files."""
    q = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def with_end(spark: SparkSession, stream: DataFrame, values: dict) -> tuple[DataFrame, Callable[[], None]]:
    """The stream, without a watermark yet, with room for one last row of these values (others null), and what adds that row.
    Its time has to be beyond all rows and windows by the delay; the caller leaves it out of the result."""
    from tallyloom.functions.storage import fresh_dir

    folder = fresh_dir(spark, "end")
    row = spark.range(1).select(*[F.lit(values.get(f.name)).cast(f.dataType).alias(f.name) for f in stream.schema])
    row.limit(0).write.parquet(folder)
    return stream.union(spark.readStream.schema(stream.schema).parquet(folder)), lambda: row.write.mode("append").parquet(folder)


def result(spark: SparkSession, df: DataFrame, name: str, close: Callable[[], None] | None = None) -> DataFrame:
    """The rows of a stream that has been run to its end. Without close, from with_end(), the end is where the watermark stops;
    close is called once all rows are in, and the stream goes on from there."""
    from tallyloom.functions.storage import fresh_dir

    out, checkpoint = fresh_dir(spark, name), fresh_dir(spark, f"{name}-checkpoint")
    run_once(df, out, checkpoint)
    if close is not None:
        close()
        run_once(df, out, checkpoint)
    return spark.read.schema(df.schema).parquet(out)
