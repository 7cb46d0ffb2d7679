"""Column cleaning, differences, calendars and runs of long tables (series, date, value)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Texts that mean a missing number.
MISSING = ["", "-", "--", ".", "N/A", "nan", "null"]


def to_number(c: str | Column) -> Column:
    """White space and commas go, (12.3) is -12.3, marks of absence and anything else are null."""
    bare = F.regexp_replace(F.col(c) if isinstance(c, str) else c, r"[\s ,]", "")
    negative = F.regexp_extract(bare, r"^\((.*)\)$", 1)
    bare = F.when(negative != "", F.concat(F.lit("-"), negative)).otherwise(bare)
    return F.when(bare.isin(MISSING), None).otherwise(bare).try_cast("double")


def to_dates(c: str | Column) -> Column:
    """Dots and slashes count as dashes; 8 digits are yyyyMMdd; what isn't a date is null."""
    bare = F.regexp_replace(F.trim(F.col(c) if isinstance(c, str) else c), r"[./]", "-")
    digits = F.regexp_replace(bare, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")
    return F.when(digits.rlike(r"^\d{4}-\d{1,2}-\d{1,2}"), digits).try_cast("date")


#: Bytes of texts that are looked at together.
AT_ONCE = 4_000_000
#: Counts of five classes share a 64-bit number, 12 bits each, so they are taken over stretches of as many bytes as fit, then added up.
_BITS, _SHARED = 12, 5
_STRETCH = (1 << _BITS) - 1


def character_counts(df: DataFrame, text: str, classes: dict[str, str], length: str = "n_chars") -> DataFrame:
    """df without its texts, with their code points and, for each {new column: ASCII characters}, how many of a text's are among these; null for null texts.
    One look at each byte serves five classes."""
    kinds = np.zeros((len(classes) + 1, 256), np.uint64)
    kinds[0] = (np.arange(256) & 0xC0) != 0x80  # all but the continuations of a code point
    for i, own in enumerate(classes.values(), 1):
        kinds[i, list(own.encode("ascii"))] = 1
    shifts = np.uint64(_BITS) * np.arange(_SHARED, dtype=np.uint64)
    codes = [(i, (kinds[i : i + _SHARED] << shifts[: len(kinds) - i, None]).sum(0, dtype=np.uint64)) for i in range(0, len(kinds), _SHARED)]
    names = [c for c in df.columns if c != text]
    new = [length, *classes]

    def rows(batches):
        for batch in batches:
            col = batch.column("_text").cast(pa.large_binary())
            off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
            data = np.frombuffer(col.buffers()[2] or b"", np.uint8)
            none = col.is_null().to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff((off[1:] - off[0]) // AT_ONCE)) + 1).tolist(), len(col)]
            found = np.zeros((len(new), len(col)), np.int64)
            for a, b in zip(cuts, cuts[1:]):
                pieces = -(-np.diff(off[a : b + 1]) // _STRETCH)
                some = np.flatnonzero(pieces)
                if not len(some):
                    continue
                own, first = data[off[a] : off[b]], np.cumsum(pieces) - pieces
                start = np.repeat(off[a:b] - off[a], pieces) + _STRETCH * (np.arange(pieces.sum()) - np.repeat(first, pieces))
                for i, code in codes:
                    sums = np.add.reduceat(code[own], start)
                    for j, shift in enumerate(shifts[: len(kinds) - i], i):
                        found[j, a + some] = np.add.reduceat(((sums >> shift) & np.uint64(_STRETCH)).astype(np.int64), first[some])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *(pa.array(n, mask=none) for n in found)], names=[*names, *new])

    schema = df.select(*names, *[F.lit(None).cast("long").alias(c) for c in new]).schema
    return df.select(*names, F.col(text).alias("_text")).mapInArrow(rows, schema)


def tidy(df: DataFrame, date: str, values: list[str], sequence: str) -> DataFrame:
    """One row a date, that of the highest sequence number; values are doubles, bad text is null. Rows without a date go."""
    rows = df.select(to_dates(date).alias("date"), *[to_number(F.col(v).cast("string")).alias(v) for v in values], F.col(sequence).alias("_seq")).filter("date is not null")
    return rows.groupBy("date").agg(F.max_by(F.struct(*values), "_seq").alias("_v")).select("date", "_v.*")


def merge_sources(frames: list[tuple[str, DataFrame]]) -> DataFrame:
    """Full outer join of (name, frame of date and value) on date: one shuffle of the union, then a pivot by name."""
    union = None
    for name, f in frames:
        part = f.select("date", F.lit(name).alias("series"), "value")
        union = part if union is None else union.unionByName(part)
    return union.groupBy("date").pivot("series", [n for n, _ in frames]).agg(F.first("value", ignorenulls=True))


def log_returns(df: DataFrame, series: str, date: str, value: str, percent: bool = True) -> DataFrame:
    """Nulls are left out before differencing; a level of 0 or less is an error."""
    w = Window.partitionBy(series).orderBy(date)
    level = F.when(F.col(value) > 0, F.col(value)).otherwise(F.raise_error(F.lit("a level is 0 or less")).cast("double"))
    ret = (F.log(level) - F.lag(F.log(level)).over(w)) * (100.0 if percent else 1.0)
    return df.filter(F.col(value).isNotNull()).select(series, date, ret.alias("ret")).filter("ret is not null")


def simple_from_log(c: Column, drift_annual: float = 0.0, periods: float = 252.0) -> Column:
    return (F.exp(c / 100.0 + drift_annual / periods) - 1) * 100.0


def difference(df: DataFrame, series: str, date: str, value: str, order: int = 1) -> DataFrame:
    """First or second differences; the head of each series, which has none, goes."""
    w = Window.partitionBy(series).orderBy(date)
    now, one, two = F.col(value), F.lag(value, 1).over(w), F.lag(value, 2).over(w)
    d = now - one if order == 1 else now - 2 * one + two
    return df.select(series, date, d.alias("diff")).filter("diff is not null")


def lag_design(df: DataFrame, series: str, date: str, value: str, lags: int) -> DataFrame:
    w = Window.partitionBy(series).orderBy(date)
    out = df.select(series, date, F.col(value).alias("y"), *[F.lag(value, i).over(w).alias(f"x{i}") for i in range(1, lags + 1)])
    return out.filter(F.col(f"x{lags}").isNotNull())


def rebased(df: DataFrame, series: str, date: str, value: str, base: float = 100.0) -> DataFrame:
    """Every series over its value at the latest of the series' first dates, times the base."""
    firsts = df.filter(F.col(value).isNotNull()).groupBy(series).agg(F.min(date).alias("f")).agg(F.max("f").alias("f")).first()["f"]
    at = df.filter(F.col(date) == F.lit(firsts)).groupBy(series).agg(F.max(value).alias("_base"))
    return df.join(at, series).select(series, date, (F.col(value) / F.col("_base") * base).alias("indexed"))


def month_grid(df: DataFrame, series: str, date: str) -> DataFrame:
    """(series, date) of every month from a series' first to its last."""
    ends = df.groupBy(series).agg(F.min(date).alias("a"), F.max(date).alias("b"))
    return ends.select(series, F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias(date))


def on_month_grid(df: DataFrame, series: str, date: str, value: str) -> DataFrame:
    """The series on the complete grid; months without a row are null."""
    return month_grid(df, series, date).join(df.select(series, date, value), [series, date], "left")


def month_gaps(df: DataFrame, series: str, date: str) -> DataFrame:
    return month_grid(df, series, date).join(df.select(series, date), [series, date], "left_anti")


def runs(df: DataFrame, series: str, order: str, value: str, min_run: int = 1) -> DataFrame:
    """Maximal stretches of rows whose value isn't null: series, first and last place in order, length."""
    w = Window.partitionBy(series).orderBy(order)
    numbered = df.select(series, order, F.row_number().over(w).alias("_i"), F.sum(F.col(value).isNotNull().cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("_c"), F.col(value).alias("_v"))
    islands = numbered.filter("_v is not null").groupBy(series, (F.col("_i") - F.col("_c")).alias("_g"))
    return islands.agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("length")).filter(F.col("length") >= min_run).drop("_g")


def by_decade(df: DataFrame, date: str, value: str, min_rows: int) -> DataFrame:
    decade = (F.floor(F.year(date) / 10) * 10).cast("int").alias("decade")
    return df.groupBy(decade).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd")).filter(F.col("n") >= min_rows)


def in_windows(c: Column, windows: list[tuple[str, str]]) -> Column:
    """True within any of the inclusive date windows."""
    out = F.lit(False)
    for a, b in windows:
        out = out | c.between(F.lit(a).cast("date"), F.lit(b).cast("date"))
    return out


def turbulent(df: DataFrame, value: str, q: float, by: str) -> DataFrame:
    """df with `turbulent`: |value| at or above its interpolated quantile within the group."""
    cut = df.groupBy(by).agg(F.percentile(F.abs(value), q).alias("_cut"))
    return df.join(cut, by).withColumn("turbulent", F.abs(F.col(value)) >= F.col("_cut")).drop("_cut")


def first_of_text(df: DataFrame, text: str, order: str) -> DataFrame:
    """The row of lowest order for each text: an aggregate, so that copies are combined before the shuffle."""
    others = [c for c in df.columns if c != text]
    return df.groupBy(text).agg(F.min_by(F.struct(*others), order).alias("_r")).select(text, "_r.*")


def softmax_temperature(p: Column, t: float) -> Column:
    """softmax(log(p) / t) of an array of probabilities, with a floor under the logarithm."""
    scaled = F.transform(p, lambda x: F.log(F.greatest(x, F.lit(1e-300))) / t)
    top = F.array_max(scaled)
    e = F.transform(scaled, lambda x: F.exp(x - top))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.transform(e, lambda x: x / total)


def entropy(p: Column) -> Column:
    return F.aggregate(p, F.lit(0.0), lambda a, x: a - x * F.log(F.greatest(x, F.lit(1e-12))))


def margin(p: Column) -> Column:
    """The gap of the logarithms of the two largest."""
    s = F.sort_array(p, asc=False)
    return F.log(F.greatest(F.get(s, F.lit(0)), F.lit(1e-12))) - F.log(F.greatest(F.get(s, F.lit(1)), F.lit(1e-12)))


def prior_correct(p: Column, trained: float, true: float) -> Column:
    odds = p / F.greatest(1 - p, F.lit(1e-12)) * (true / (1 - true)) / (trained / (1 - trained))
    return odds / (1 + odds)


def publishable(df: DataFrame, by: str, date: str, value: str, quantiles: tuple[float, ...] = (0.5, 0.9, 0.99), min_tail: int = 10) -> DataFrame:
    """Counts, dates, moments with the sample variance, and quantiles of |value| of which enough rows lie beyond; no extremes."""
    mean = df.groupBy(by).agg(F.avg(value).alias("_m"))
    d = F.col(value) - F.col("_m")
    g = df.join(mean, by).groupBy(by).agg(
        F.count("*").alias("n"), F.min(date).alias("first"), F.max(date).alias("last"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"),
        F.avg(d * d * d).alias("_m3"), F.avg(d * d * d * d).alias("_m4"), F.percentile(F.abs(value), list(quantiles)).alias("_q"),
    )
    out = g.select(by, "n", "first", "last", "mean", "sd", (F.col("sd") * F.sqrt(F.lit(252.0))).alias("sd_annual"), (F.col("_m3") / F.pow("sd", F.lit(3))).alias("skew"), (F.col("_m4") / F.pow("sd", F.lit(4)) - 3).alias("kurtosis"), "_q")
    for i, q in enumerate(quantiles):
        out = out.withColumn(f"q{str(q)[2:]}", F.when(F.round(F.col("n") * min(q, 1 - q)) >= min_tail, F.get("_q", F.lit(i))))
    return out.drop("_q")


def months_long(wide: DataFrame, year: str, months: list[str]) -> DataFrame:
    """(year, month, value) from a table of a row a year and a column a month, in order: months that are null or 0, which such tables use for what isn't there, go."""
    long = wide.unpivot(year, [F.col(m).cast("double").alias(str(i)) for i, m in enumerate(months, 1)], "month", "value")
    return long.filter("value is not null and value <> 0").select(year, F.col("month").cast("int").alias("month"), "value")
