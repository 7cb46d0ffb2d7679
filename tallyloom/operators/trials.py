"""Audits of reported trials and results: sizes that a p-value implies, bounds of a first look, and the effects that can cross them."""

from __future__ import annotations

from math import e
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tallyloom.functions.special import normal_cdf


@F.pandas_udf(DoubleType())
def upper_quantile(tail: pd.Series) -> pd.Series:
    """The z that a standard normal number exceeds with this chance; null outside (0, 1)."""
    normal = NormalDist()
    return pd.Series([-normal.inv_cdf(t) if 0 < t < 1 else None for t in tail], dtype=float)


@F.pandas_udf(DoubleType())
def upper_tail(z: pd.Series) -> pd.Series:
    """The chance that a standard normal number exceeds z."""
    return pd.Series([normal_cdf(-v) if v == v else None for v in z], dtype=float)


def z_for_p(p: Column, two_sided: bool = True) -> Column:
    """The |z| behind a reported p; of a p that is an upper bound it is a lower one. Null unless 0 < p < 1."""
    p = p.cast("double")
    return F.when((p > 0) & (p < 1), upper_quantile(p / 2 if two_sided else p))


def z_for_level(level: Column) -> Column:
    """The multiple of the standard error behind a two-sided interval of this level."""
    return z_for_p(1 - level)


def obrien_fleming(fraction: Column, alpha: Column, two_sided: bool = True) -> Column:
    """The bound of the first look at a share of the information, by spending as O'Brien and Fleming: nothing was spent before, so it is the
    full bound over the root of the share. Null unless 0 < share <= 1. Bounds of later looks depend on the earlier ones and aren't given."""
    return F.when((fraction > 0) & (fraction <= 1), z_for_p(alpha, two_sided) / F.sqrt(fraction))


def pocock(fraction: Column, alpha: Column, two_sided: bool = True) -> Column:
    """As `obrien_fleming`, by spending alpha log(1 + (e - 1) share)."""
    return F.when((fraction > 0) & (fraction <= 1), z_for_p(alpha * F.log1p((e - 1) * fraction), two_sided))


def information(hr: Column, share: float = 0.5) -> Column:
    """Information of an event: s (1 - s), where s is the share of events in the first arm, which had this share of the patients."""
    s = share * hr / (share * hr + 1 - share)
    return s * (1 - s)


def detectable(events: Column, z: Column, share: float = 0.5, rounds: int = 40) -> Column:
    """The largest hazard ratio below 1 that can cross a bound z > 0 with so many events: exp(-z / sqrt(events x information)), where the information depends
    on the ratio, so the formula is applied again and again from 1."""
    step = lambda h, _: F.exp(-z / F.sqrt(events * information(h, share)))
    return F.when((z > 0) & (events > 0), F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.lit(1.0), step))


def interim_audit(df: DataFrame, keys: list[str], hr: str, p: str, events: str, fraction: str, alpha: float = 0.05, power: float = 0.9, share: float = 0.5) -> DataFrame:
    """(keys, z, events_from_p, obrien_fleming, pocock, detectable_obrien_fleming, detectable_pocock, crossed, required, low, high) for each trial that reports a hazard
    ratio, its two-sided p, its events and the share of planned events: z behind p and the events that both imply; bounds of a first look and the ratios that could
    cross them; whether z reached the first bound; the events that a design needs for the ratio by its allocation; and the interval that so many events print.
    Ratios of 1 imply no events; nulls, and ratios and events that aren't positive, give nulls."""
    h, n, t, a = F.col(hr).cast("double"), F.col(events).cast("double"), F.col(fraction).cast("double"), F.lit(alpha)
    h, n = F.when(h > 0, h), F.when(n > 0, n)
    d = df.select(*keys, h.alias("_h"), n.alias("_n"), z_for_p(F.col(p)).alias("z"), obrien_fleming(t, a).alias("obrien_fleming"), pocock(t, a).alias("pocock"))
    h, n, z = F.col("_h"), F.col("_n"), F.col("z")
    square, normal = F.when(h != 1, F.pow(F.log(h), F.lit(2))), NormalDist()
    za, zb = normal.inv_cdf(1 - alpha / 2), normal.inv_cdf(power)
    half = za / F.sqrt(n * information(h, share))
    return d.select(
        *keys, "z", (z * z / (information(h, share) * square)).alias("events_from_p"), "obrien_fleming", "pocock", detectable(n, F.col("obrien_fleming"), share).alias("detectable_obrien_fleming"),
        detectable(n, F.col("pocock"), share).alias("detectable_pocock"), (z >= F.col("obrien_fleming")).alias("crossed"), ((za + zb) ** 2 / (share * (1 - share) * square)).alias("required"),
        (h * F.exp(-half)).alias("low"), (h * F.exp(half)).alias("high"),
    )


def result_audit_by_p(df: DataFrame, keys: list[str], effect: str, noise: str, p: str, n: str, rho: str, periods: float, two_sided: bool = True) -> DataFrame:
    """(keys, z, implied_n, independent, annual_ratio) for each reported effect with the noise of one observation and its p: the z behind p, the smallest sample that gives
    both, the independent ones among n positions of a common correlation, and the ratio of effect to noise over a year, held in these. An effect of 0
    implies no sample, noise that isn't positive nothing."""
    ratio = F.when(F.col(noise) > 0, F.col(effect).cast("double") / F.col(noise))
    d = df.select(*keys, ratio.alias("_r"), z_for_p(F.col(p), two_sided).alias("z"), (F.col(n) / (1 + (F.col(n) - 1) * F.col(rho))).alias("independent"))
    implied = F.when(F.col("_r") != 0, F.pow(F.col("z") / F.col("_r"), F.lit(2)))
    return d.select(*keys, "z", implied.alias("implied_n"), "independent", (F.col("_r") * F.sqrt("independent") * float(periods) ** 0.5).alias("annual_ratio"))
