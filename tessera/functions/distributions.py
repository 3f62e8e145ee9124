"""Tail probabilities that test statistics need, in plain Python: Student's t, noncentral t, normal, exact signed ranks."""

from __future__ import annotations

import math

import numpy as np


def beta_inc(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 0.0
    f = 1.0
    for i in range(500):
        m = i // 2
        n = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + n * d or tiny)
        c = 1 + n / c or tiny
        f *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * (f - 1)


def t_sf(t: float, df: float) -> float:
    """P(T > t)."""
    tail = 0.5 * beta_inc(df / 2, 0.5, df / (df + t * t))
    return tail if t >= 0 else 1 - tail


def t_ppf(p: float, df: float) -> float:
    lo, hi = -1e4, 1e4
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 1 - t_sf(mid, df) < p else (lo, mid)
    return (lo + hi) / 2


def normal_cdf(z):
    return 0.5 * math.erfc(-z / math.sqrt(2))


def nct_cdf(t: float, df: float, shift: float) -> float:
    """P(T <= t) of the noncentral t, integrating over the chi density on a fine grid."""
    s = np.linspace(1e-6, 1 + 12 / math.sqrt(2 * df) + 2, 20_001)
    log_density = df * np.log(s) - df * s * s / 2 + math.log(2) + (df / 2) * math.log(df / 2) - math.lgamma(df / 2) - np.log(s)
    z = np.array([normal_cdf(t * x - shift) for x in s])
    y = z * np.exp(log_density)
    return float(((y[1:] + y[:-1]) / 2 * np.diff(s)).sum())


def paired_power(dz: float, n: float, alpha: float = 0.05) -> float:
    """Power of a one-sided paired t-test; 0 where there are no degrees of freedom."""
    return 0.0 if n <= 1 or not math.isfinite(dz) else 1 - nct_cdf(t_ppf(1 - alpha, n - 1), n - 1, dz * math.sqrt(n))


def n_for_power(dz: float, power: float, alpha: float = 0.05, most: int = 2000) -> int:
    """The least n from 3 that reaches the power, by bisection; `most` where none does."""
    if dz <= 0 or not math.isfinite(dz) or paired_power(dz, most, alpha) < power:
        return most
    lo, hi = 2, most
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if paired_power(dz, mid, alpha) >= power else (mid, hi)
    return max(hi, 3)


def signed_rank_z(w: float, n: int, tie_sum: float = 0.0) -> float:
    """How many deviations a signed-rank sum lies from its mean; ties of t equal differences give t^3 - t each to tie_sum."""
    spread = n * (n + 1) * (2 * n + 1) / 24 - tie_sum / 48
    return (w - n * (n + 1) / 4) / math.sqrt(spread) if spread > 0 else 0.0


def signed_rank_p(w: float, n: int, ranks: list[float] | None = None, tie_sum: float = 0.0) -> float:
    """Two-sided p of a signed-rank sum without zeros. With the ranks (1..n if there are no ties), which may be halves, it is exact: the
    share of all choices of signs that reach as far; beyond 50 pairs, or without ranks where there are ties, it is normal."""
    if n == 0:
        return 1.0
    if n > 50 or (ranks is None and tie_sum):
        return min(1.0, 2 * normal_cdf(-abs(signed_rank_z(w, n, tie_sum))))
    doubled = [round(2 * r) for r in (ranks if ranks is not None else range(1, n + 1))]
    ways = np.zeros(sum(doubled) + 1)
    ways[0] = 1
    for k in doubled:
        ways[k:] = ways[k:] + np.concatenate((np.zeros(0), ways[: len(ways) - k].copy()))
    share, at = np.cumsum(ways) / ways.sum(), round(2 * w)
    return float(min(1.0, 2 * min(share[at], 1 - (share[at - 1] if at else 0))))
