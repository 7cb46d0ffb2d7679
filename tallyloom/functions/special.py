"""Distribution functions, for tiny results on the driver and for Arrow batches."""

from __future__ import annotations

from math import erfc, exp, lgamma, log, log1p, sqrt
from statistics import NormalDist

_NORMAL = NormalDist()


def normal_cdf(z: float) -> float:
    return 0.5 * erfc(-z / sqrt(2))


def normal_quantile(p: float) -> float:
    return _NORMAL.inv_cdf(p)


def chi2_1_tail(x: float) -> float:
    return erfc(sqrt(max(x, 0) / 2))


def _fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function, by Lentz's method."""
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 500):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + top / c
            c = c if abs(c) > tiny else tiny
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return out


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log1p(-x))
    return front * _fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _fraction(b, a, 1 - x) / b


def t_tail(t: float, df: float) -> float:
    """Two-sided p of Student's t."""
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def binomial_two_sided(k: int, n: int) -> float:
    """Exact two-sided p of k of n at one half."""
    if n == 0:
        return 1.0
    low = min(k, n - k)
    return min(1.0, 2 * exp(_log_sum(n, low) - n * log(2)))


def _log_sum(n: int, k: int) -> float:
    terms = [lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) for i in range(k + 1)]
    top = max(terms)
    return top + log(sum(exp(t - top) for t in terms))


def kolmogorov_tail(d: float, n: float) -> float:
    """Asymptotic p of the Kolmogorov-Smirnov statistic at effective size n."""
    x = d * sqrt(n)
    if x < 0.2:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (j - 1) * exp(-2 * (j * x) ** 2) for j in range(1, 101))))


def binomial_cdf(k: int, n: int, p: float) -> float:
    if k >= n:
        return 1.0
    if k < 0:
        return 0.0
    return 1 - incomplete_beta(k + 1, n - k, p)


def expected_best(models: int, rows: int, p: float = 0.5) -> float:
    """Expected best share right of so many models that guess right with probability p on so many rows."""
    return sum(1 - binomial_cdf(k, rows, p) ** models for k in range(rows)) / rows


def trials_to_reach(target: float, rows: int, p: float = 0.5) -> int | None:
    """The fewest models whose expected best reaches the target."""
    low, high = 1, 1
    while expected_best(high, rows, p) < target:
        high *= 2
        if high > 1 << 40:
            return None
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if expected_best(mid, rows, p) >= target else (mid + 1, high)
    return low


__all__ = ["binomial_cdf", "binomial_two_sided", "chi2_1_tail", "expected_best", "incomplete_beta", "kolmogorov_tail", "normal_cdf", "normal_quantile", "t_tail", "trials_to_reach"]
