"""Random numbers that follow from keys, so that reruns and other partitions give the same."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(*keys: Column | str | int) -> Column:
    """In [0, 1), from a 64-bit hash of the keys."""
    cols = [F.lit(k) if isinstance(k, int) else k for k in keys]
    return F.xxhash64(*cols).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))


def stable_share(text: Column | str) -> Column:
    """In [0, 1): the first 8 bytes of SHA-256 of a text over 2**64, the same on every system."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(float(1 << 64))


def md5_share(text: Column) -> Column:
    """In [0, 1): the first 13 hexadecimal digits of MD5 of a text over 16**13."""
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def md5_normal_pair(text: Column) -> Column:
    """A standard normal number by Box and Muller from two shares of one key."""
    a, b = md5_share(F.concat(text, F.lit(":a"))), md5_share(F.concat(text, F.lit(":b")))
    return F.sqrt(-2 * F.log(1 - a)) * F.cos(2 * F.pi() * b)
