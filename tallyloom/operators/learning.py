"""Data work around models: encodings, neighbours, clusters, drift, survival, attribution."""

from __future__ import annotations

from math import ceil, log2

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.blocks import Cells, summed, vectors
from tallyloom.functions.ranks import ranked, running_by
from tallyloom.functions.storage import written


def target_encoded(df: DataFrame, level: str, label: str, smoothing: float) -> DataFrame:
    """(level, code): (sum + m prior) / (count + m); what isn't there takes the prior at join time."""
    prior = df.agg(F.avg(label)).first()[0]
    return df.groupBy(level).agg(((F.sum(label) + smoothing * prior) / (F.count("*") + smoothing)).alias("code"))


def cross_fitted_encoding(df: DataFrame, level: str, label: str, fold: str, smoothing: float) -> DataFrame:
    """df with `code` from the other folds only: totals less the fold's own, both aggregates of one row a level and fold."""
    prior = df.agg(F.avg(label)).first()[0]
    own = df.groupBy(level, fold).agg(F.sum(label).alias("s"), F.count("*").alias("c"))
    w = Window.partitionBy(level)
    own = own.select(level, fold, (F.sum("s").over(w) - F.col("s")).alias("s"), (F.sum("c").over(w) - F.col("c")).alias("c"))
    return df.join(own, [level, fold]).withColumn("code", (F.col("s") + smoothing * prior) / (F.col("c") + smoothing)).drop("s", "c")


def imputed(df: DataFrame, columns: list[str], by: str | None = None) -> DataFrame:
    """Nulls take the mean (of their group), with a flag column for each."""
    keys = [by] if by else []
    means = df.groupBy(*keys).agg(*[F.avg(c).alias(f"_m_{c}") for c in columns])
    out = df.withColumn("_all", F.lit(1)).join(means.withColumn("_all", F.lit(1)), ["_all", *keys]).drop("_all")
    out = out.withColumns({f"{c}_missing": F.col(c).isNull() for c in columns} | {c: F.coalesce(F.col(c).cast("double"), F.col(f"_m_{c}")) for c in columns})
    return out.drop(*[f"_m_{c}" for c in columns])


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x.cast("double")))


def _best(who: np.ndarray, own: np.ndarray, d: np.ndarray, k: int) -> np.ndarray:
    """Places of the k first of each `who`, by distance to nine digits and id."""
    order = np.lexsort((own, np.round(d, 9), who))
    who = who[order]
    return order[np.arange(len(who)) - np.searchsorted(who, who) < k]


def neighbours(queries: DataFrame, rows: DataFrame, k: int, at_once: int = 8192) -> DataFrame:
    """(query, id, rank, d): the exact k nearest of all rows for a stated set of queries, a row itself left out; of equal distances, to nine digits, the smaller id
    counts. Rows with nulls or components that aren't finite take no part.

    Rows are dealt to cells of space, of at_once rows or a quarter of it up to eight dimensions. A query first meets its own cell, which bounds
    its k-th distance, and then every cell whose box is within the bound. A task holds a cell, or a part of one that holds many copies, and at most some
    8 at_once queries; what passes through the driver is a sample of about 20,000 rows and the cells' boxes. In few dimensions the cells that a query meets don't
    grow with the rows; in many they are all of them, and work grows with queries x rows.
    """
    q, r = (d.select(F.col("id").cast("long").alias("id"), F.transform("vec", lambda x: x.cast("double")).alias("vec")) for d in (queries, rows))
    sound = "id is not null and vec is not null and not exists(vec, x -> x is null or isnan(x) or abs(x) = double('inf'))"
    q, r = q.filter(sound), r.filter(sound)
    spark, n = rows.sparkSession, r.count()
    first = r.select("vec").first()
    if first is None:
        return spark.createDataFrame([], "query long, id long, d double, rank int")
    dims = len(first["vec"])
    size = at_once if dims > 8 else max(1, at_once // 4)
    sample = r.filter(F.pmod(F.xxhash64(F.lit("cells"), "id"), F.lit(max(1, n // 20_000))) == 0).select("vec").toArrow()
    cells = Cells(np.array(sample.column("vec").to_pylist(), float).reshape(-1, dims), ceil(log2(max(1, n / size))))
    count = 1 << cells.depth

    def placed(batches):
        for b in batches:
            if b.num_rows:
                yield b.append_column("cell", pa.array(cells.of(vectors(b.column("vec"), b.num_rows))))

    r = written(r.mapInArrow(placed, "id long, vec array<double>, cell long"), "cells")
    sides = [F.array(*[f(F.get("vec", F.lit(i))) for i in range(dims)]) for f in (F.min, F.max)]
    parts, low, high = np.zeros(count, np.int64), np.full((count, dims), np.inf), np.full((count, dims), np.inf)
    for c, m, a, b in r.groupBy("cell").agg(F.count("*"), *sides).collect():
        parts[c], low[c], high[c] = ceil(m / (4 * size)), a, b

    def apart(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances, and by how much each row's may be off."""
        a, b = (x * x).sum(1), (y * y).sum(1)
        return a[:, None] + b[None] - 2 * x @ y.T, 1e-13 * (a + b.max())

    def steps(t: pa.Table, u: pa.Table):
        x, y = (vectors(v.column("vec").combine_chunks(), v.num_rows) for v in (t, u))
        step = max(1, 2_000_000 // len(y))  # a matrix of 16 MB
        for i in range(0, len(x), step):
            yield slice(i, i + step), x[i : i + step], y

    def bound(t: pa.Table, u: pa.Table) -> pa.Table:
        ids, own, out = t.column("id").to_numpy(), u.column("id").to_numpy() if u.num_rows else None, np.full(t.num_rows, np.inf)
        if t.num_rows and u.num_rows > k:
            for here, x, y in steps(t, u):
                d, off = apart(x, y)
                d[ids[here, None] == own[None]] = np.inf
                out[here] = np.sqrt(np.maximum(0, np.partition(d, k - 1, axis=1)[:, k - 1] + off))
        return pa.table({"id": ids, "vec": t.column("vec"), "bound": out})

    def near(t: pa.Table, u: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if t.num_rows and u.num_rows:
            ids, own, most = t.column("id").to_numpy(), u.column("id").to_numpy(), t.column("bound").to_numpy() + 2e-9
            for here, x, y in steps(t, u):
                d, off = apart(x, y)
                who, which = np.nonzero(d <= (most[here] ** 2 + off)[:, None])
                other = ids[here][who] != own[which]
                who, which = who[other], which[other]
                exact = np.sqrt(((x[who] - y[which]) ** 2).sum(1))
                top = _best(who, own[which], exact, k)
                out.append((ids[here][who[top]], own[which[top]], exact[top]))
        a, b, c = (np.concatenate(v) for v in zip(*out))
        return pa.table({"query": a, "id": b, "d": c})

    def within(x: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs (row, cell) of which the cell's box is within the row's bound."""
        d = np.zeros((len(x), count))
        for i in range(dims):
            d += np.square(np.maximum(0, np.maximum(low[None, :, i] - x[:, None, i], x[:, None, i] - high[None, :, i])))
        return np.nonzero((d <= np.square(most + 2e-9)[:, None] * (1 + 1e-12)) & (parts > 0)[None])

    def in_steps(batch: pa.RecordBatch):
        x, most, step = vectors(batch.column("vec"), batch.num_rows), batch.column("bound").to_numpy(), max(1, 2_000_000 // count)
        for i in range(0, len(x), step):
            yield i, *within(x[i : i + step], most[i : i + step])

    def meet(a: DataFrame, f, schema: str, load: np.ndarray) -> DataFrame:
        """f of the queries of a(id, vec, bound, cell, part) and each part of a cell's rows; `load` is the queries of a cell."""
        blocks = np.maximum(1, -(-load // (8 * at_once))).astype(np.int64)

        def dealt(batches, copied: bool):
            for b in batches:
                if not b.num_rows:
                    continue
                cell, ids = b.column("cell").to_numpy(), b.column("id").to_numpy()
                mix = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                times = blocks[cell] if copied else np.ones(len(cell), np.int64)
                row = np.repeat(np.arange(len(cell)), times)
                block = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times) if copied else (mix % blocks[cell].astype(np.uint64)).astype(np.int64)
                part = b.column("part").to_numpy() if "part" in b.schema.names else (mix % parts[cell].astype(np.uint64)).astype(np.int64)
                out = b.take(pa.array(row)) if copied else b
                keep = [c for c in out.schema.names if c != "part"]
                yield pa.RecordBatch.from_arrays([*[out.column(c) for c in keep], pa.array(part[row]), pa.array(block)], names=[*keep, "part", "block"])

        kind = "id long, vec array<double>, cell long, part long, block long"
        b = r.mapInArrow(lambda x: dealt(x, True), kind)
        a = a.mapInArrow(lambda x: dealt(x, False), kind.replace("cell", "bound double, cell"))
        a, b = (d.select(*[F.col(c).alias(f"{side}_{c}") for c in d.columns]).toDF(*d.columns) for side, d in (("a", a), ("b", b)))
        keys = ["cell", "part", "block"]
        return a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInArrow(f, schema)

    def home(batches):
        for b in batches:
            if b.num_rows:
                cell = cells.of(vectors(b.column("vec"), b.num_rows))
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("vec"), pa.array(np.full(len(cell), np.inf)), pa.array(cell), pa.array(np.zeros(len(cell), np.int64))], names=["id", "vec", "bound", "cell", "part"])

    def visits(batches):
        for b in batches:
            for i, who, cell in in_steps(b) if b.num_rows else ():
                times = parts[cell]
                row, part = np.repeat(np.arange(len(cell)), times), np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                for j in range(0, len(row), 10_000):
                    own = row[j : j + 10_000]
                    out = b.take(pa.array(who[own] + i))
                    yield pa.RecordBatch.from_arrays([*[out.column(c) for c in ("id", "vec", "bound")], pa.array(cell[own]), pa.array(part[j : j + 10_000])], names=["id", "vec", "bound", "cell", "part"])

    asked = "id long, vec array<double>, bound double, cell long, part long"
    at_home = q.mapInArrow(home, asked)

    def count_home(t, batch):
        t[0] += np.bincount(batch.column("cell").to_numpy(), minlength=count)

    def count_visits(t, batch):
        for _, _, cell in in_steps(batch):
            t[0] += np.bincount(cell, minlength=count)

    (load,) = summed(at_home, ["cell"], [(count,)], count_home)
    bounded = written(meet(at_home, bound, "id long, vec array<double>, bound double", load), "bounded")
    (load,) = summed(bounded, ["vec", "bound"], [(count,)], count_visits)
    every = meet(bounded.mapInArrow(visits, asked), near, "query long, id long, d double", load)
    best = every.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.round("d", 9), "id")))
    return best.filter(F.col("rank") <= k)


def purity(df: DataFrame, cluster: str, label: str) -> DataFrame:
    """(cluster, size, label, purity): the commonest label of each cluster and its share."""
    n = df.groupBy(cluster, label).agg(F.count("*").alias("n"))
    return n.groupBy(cluster).agg(F.sum("n").alias("size"), F.max_by(label, F.struct("n", label)).alias("label"), (F.max("n") / F.sum("n")).alias("purity"))


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: the adjusted Rand index of two labellings, from counts of a contingency table."""
    pairs = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    n = df.groupBy(a, b).agg(F.count("*").alias("n"))
    both = n.agg(pairs("n").alias("both"), F.sum("n").alias("total")).withColumn("k", F.lit(1))
    one = n.groupBy(a).agg(F.sum("n").alias("n")).agg(pairs("n").alias("one")).withColumn("k", F.lit(1))
    two = n.groupBy(b).agg(F.sum("n").alias("n")).agg(pairs("n").alias("two")).withColumn("k", F.lit(1))
    t = F.col("total") * (F.col("total") - 1) / 2
    expected, top = F.col("one") * F.col("two") / t, (F.col("one") + F.col("two")) / 2
    return both.join(one, "k").join(two, "k").select(F.when(top == expected, 1.0).otherwise((F.col("both") - expected) / (top - expected)).alias("ari"))


def two_sample_ks(df: DataFrame, sample: str, features: list[str]) -> DataFrame:
    """(feature, ks, n0, n1) between rows with sample false and true: running counts over distinct values of each feature."""
    long = df.select(F.col(sample).cast("int").alias("s"), F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features])).alias("x")).select("s", "x.*").filter("v is not null")
    d = long.groupBy("feature", "v").agg(F.sum(1 - F.col("s")).alias("a"), F.sum("s").alias("b"))
    d = running_by(d, ["feature"], ["v"], {"ua": "a", "ub": "b"}, {"na": "a", "nb": "b"})
    return d.groupBy("feature").agg(F.max(F.abs(F.col("ua") / F.col("na") - F.col("ub") / F.col("nb"))).alias("ks"), F.first("na").alias("n0"), F.first("nb").alias("n1"))


def label_shift(df: DataFrame, sample: str, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count_if(~F.col(sample)).alias("before"), F.count_if(F.col(sample)).alias("after"))


def risk_table(df: DataFrame, time: str, event: str, arm: str) -> DataFrame:
    """(time, d0, d1, r0, r1) of every event time: events and rows at risk by arm. Counts by time are combined before the shuffle;
    running sums go over range partitions of distinct times."""
    t = df.groupBy(F.col(time).alias("time")).agg(*[F.count_if((F.col(arm) == a) & F.col(event)).alias(f"d{a}") for a in (0, 1)], *[F.count_if(F.col(arm) == a).alias(f"c{a}") for a in (0, 1)])
    t = ranked(t.withColumn("_down", -F.col("time").cast("double")), ["_down"], {"r0": "c0", "r1": "c1"})
    return t.select("time", "d0", "d1", "r0", "r1").filter("d0 + d1 > 0")


def log_rank(df: DataFrame, time: str, event: str, arm: str) -> DataFrame:
    """One row: observed and expected events of arm 1, variance, z, at a hazard ratio of 1."""
    t = risk_table(df, time, event, arm)
    d, n = F.col("d0") + F.col("d1"), F.col("r0") + F.col("r1")
    p = F.col("r1") / n
    g = t.agg(F.sum("d1").alias("observed"), F.sum(d * p).alias("expected"), F.sum(d * p * (1 - p)).alias("information"))
    return g.select("observed", "expected", "information", ((F.col("observed") - F.col("expected")) / F.sqrt("information")).alias("z"))


def cox_two_arm(df: DataFrame, time: str, event: str, arm: str, steps: int = 25, tol: float = 1e-10) -> dict:
    """Log hazard ratio of arm 1 and its standard error: Newton steps, each a sum over the table of event times, which is written once."""
    t = written(risk_table(df, time, event, arm), "risk")
    beta = 0.0
    for _ in range(steps):
        d, w = F.col("d0") + F.col("d1"), F.col("r1") * F.exp(F.lit(beta))
        p = w / (F.col("r0") + w)
        score, info = t.agg(F.sum(F.col("d1") - d * p), F.sum(d * p * (1 - p))).first()
        if not info:
            return {"beta": None, "se": None}
        beta += score / info
        if abs(score / info) < tol:
            break
    return {"beta": beta, "se": info**-0.5}


def ancova(df: DataFrame, group: str, y: str, x: str) -> DataFrame:
    """One row: the effect of group 1 on totals, on y / x, and at equal x by a common slope."""
    g = df.groupBy(group).agg(F.avg(y).alias("my"), F.avg(x).alias("mx"), F.avg(F.col(y) / F.col(x)).alias("mr"), F.regr_sxx(y, x).alias("sxx"), F.regr_sxy(y, x).alias("sxy"))
    one = lambda c: F.max(F.when(F.col(group) == 1, F.col(c))) - F.max(F.when(F.col(group) == 0, F.col(c)))
    return g.agg(one("my").alias("total"), one("mr").alias("ratio"), (one("my") - F.sum("sxy") / F.sum("sxx") * one("mx")).alias("adjusted"))


def adjusted_effect(df: DataFrame, y: str, x: str, z: str) -> DataFrame:
    """One row: slope of y on x alone, slope with z beside it, and the bias that leaving z out brings."""
    m = df.agg(F.var_pop(x).alias("xx"), F.var_pop(z).alias("zz"), F.covar_pop(x, z).alias("xz"), F.covar_pop(x, y).alias("xy"), F.covar_pop(z, y).alias("zy"))
    det = F.col("xx") * F.col("zz") - F.col("xz") * F.col("xz")
    bz = (F.col("zy") * F.col("xx") - F.col("xy") * F.col("xz")) / det
    return m.select((F.col("xy") / F.col("xx")).alias("naive"), ((F.col("xy") * F.col("zz") - F.col("zy") * F.col("xz")) / det).alias("adjusted"), (bz * F.col("xz") / F.col("xx")).alias("bias"))


def linear_attribution(df: DataFrame, row: str, coefficients: dict[str, float]) -> DataFrame:
    """(row, feature, value): coefficient times the distance from the feature's mean; values of a row add up to its prediction less the mean one."""
    means = df.agg(*[F.avg(c).alias(c) for c in coefficients]).first()
    parts = [F.struct(F.lit(c).alias("feature"), (b * (F.col(c) - means[c])).alias("value")) for c, b in coefficients.items()]
    return df.select(row, F.explode(F.array(*parts)).alias("p")).select(row, "p.*")


def permutation_importance(df: DataFrame, row: str, features: list[str], predict, y: str, reps: int, seed: str) -> DataFrame:
    """(feature, importance, sd): rise of the mean squared error when a column is permuted by the hash of (repeat, row). Rows are
    numbered once by their ids, and each column's values once a repeat, over range partitions."""
    base = df.agg(F.avg(F.pow(predict({f: F.col(f) for f in features}) - F.col(y), F.lit(2)))).first()[0]
    rows = written(ranked(df.select(row, *features, y), [row], rank="_i"), "rows")
    out = None
    for f in features:
        for rep in range(reps):
            h = df.select(F.col(f).alias("shuffled"), F.md5(F.concat_ws(":", F.lit(f"{seed}:{f}:{rep}"), F.col(row).cast("string"))).alias("_h"), F.col(row).alias("_u"))
            p = rows.join(ranked(h, ["_h", "_u"], rank="_i").select("_i", "shuffled"), "_i")
            e = predict({g: F.col("shuffled") if g == f else F.col(g) for g in features}) - F.col(y)
            part = p.agg((F.avg(e * e) - base).alias("rise")).select(F.lit(f).alias("feature"), "rise")
            out = part if out is None else out.unionByName(part)
    return out.groupBy("feature").agg(F.avg("rise").alias("importance"), F.stddev_pop("rise").alias("sd"))


def partial_dependence(df: DataFrame, feature: str, grid: list[float], predict, others: list[str]) -> DataFrame:
    """(at, mean): mean prediction with the feature set to each grid value."""
    d = df.select(*others, F.explode(F.array(*[F.lit(g) for g in grid])).alias("at"))
    return d.groupBy("at").agg(F.avg(predict({feature: F.col("at"), **{o: F.col(o) for o in others}})).alias("mean"))


def ensemble_ambiguity(df: DataFrame, item: str, member: str, p: str, y: str) -> DataFrame:
    """One row: error of the averaged prediction, mean error of members, and their disagreement; the first is the second less the third."""
    g = df.groupBy(item, y).agg(F.avg(p).alias("m"), F.avg(F.pow(F.col(p) - F.col(y), F.lit(2))).alias("e"), F.var_pop(p).alias("a"))
    return g.agg(F.avg(F.pow(F.col("m") - F.col(y), F.lit(2))).alias("ensemble"), F.avg("e").alias("members"), F.avg("a").alias("ambiguity"))


def multiplicity(df: DataFrame, item: str, model: str, choice: str) -> DataFrame:
    """(a, b, disagree): share of items on which two models differ; joined on the item, summed before the shuffle."""
    a = df.select(item, F.col(model).alias("a"), F.col(choice).alias("ca"))
    b = df.select(item, F.col(model).alias("b"), F.col(choice).alias("cb"))
    return a.join(b, item).filter("a < b").groupBy("a", "b").agg(F.avg((F.col("ca") != F.col("cb")).cast("double")).alias("disagree"))


def expected_best_table(df: DataFrame, search: str, models: str, rows: str) -> DataFrame:
    """(search, models, rows, expected): the best share right that so many coin-flipping models reach on so many rows."""
    from tallyloom.functions.special import expected_best

    @F.pandas_udf("double")
    def best(m: pd.Series, n: pd.Series) -> pd.Series:
        known: dict[tuple[int, int], float] = {}
        return pd.Series([known.setdefault((a, b), expected_best(a, b)) if (a, b) not in known else known[a, b] for a, b in zip(m.astype(int), n.astype(int))])

    return df.select(search, models, rows, best(models, rows).alias("expected"))


def money_weighted(flows: DataFrame, account: str, t: str, amount: str, final: str, periods: float = 252.0) -> DataFrame:
    """(account, rate): annualised rate at which dated flows (in: positive) grow to the final value, by bisection, that of all accounts of a batch at once."""
    kind = flows.schema[account].dataType.simpleString()

    def solve(batches):
        for b in batches:
            if not b.num_rows:
                continue
            n = b.column("n").to_numpy()
            flow, years = (b.column(c).flatten().to_numpy(zero_copy_only=False).astype(float) for c in ("v", "age"))
            value, who = b.column("final").to_numpy(zero_copy_only=False).astype(float), np.repeat(np.arange(len(n)), n)
            years /= periods

            def gap(r: np.ndarray) -> np.ndarray:
                return np.bincount(who, flow * (1 + r)[who] ** years, len(n)) - value

            lo, hi = np.full(len(n), -0.999), np.full(len(n), 100.0)
            none = gap(lo) * gap(hi) > 0
            while len(n) and (hi - lo).max() > 1e-10:
                mid = (lo + hi) / 2
                up = gap(mid) < 0
                lo, hi = np.where(up, mid, lo), np.where(up, hi, mid)
            yield pa.RecordBatch.from_arrays([b.column("k"), pa.array((lo + hi) / 2, mask=none)], names=[account, "rate"])

    each = F.sort_array(F.collect_list(F.struct(F.col(t).alias("t"), F.col(amount).cast("double").alias("v"))))
    d = flows.groupBy(F.col(account).alias("k")).agg(each.alias("f"), F.first(F.col(final).cast("double")).alias("final"), F.max(t).alias("top"))
    d = d.select("k", "final", F.size("f").alias("n"), F.transform("f", lambda x: x["v"]).alias("v"), F.transform("f", lambda x: (F.col("top") - x["t"]).cast("double")).alias("age"))
    return d.mapInArrow(solve, f"{account} {kind}, rate double")
