"""Tail probabilities of a handful of distributions, on scalars.

Spark computes the statistics; only these few numbers reach the driver.
"""

from __future__ import annotations

import math

import numpy as np

_TINY = 1e-300


def normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2.0))


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def _gamma_q(a: float, x: float) -> float:
    """Upper regularised incomplete gamma Q(a, x): series below a + 1, Lentz fraction above."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1.0 - front * total)
    b = x + 1 - a
    c, d = 1 / _TINY, 1 / b
    h = d
    for i in range(1, 100_000):
        an = -i * (i - a)
        b += 2
        d = 1 / ((an * d + b) or _TINY)
        c = (b + an / c) or _TINY
        h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * h


def chi2_sf(x: float, df: float) -> float:
    return _gamma_q(df / 2.0, x / 2.0)


def _beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b) by its continued fraction."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - _beta_i(b, a, 1 - x)
    log_front = (
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    c, d = 1.0, 1 / ((1 - (a + b) * x / (a + 1)) or _TINY)
    h = d
    for m in range(1, 100_000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d = 1 / ((1 + even * d) or _TINY)
        c = (1 + even / c) or _TINY
        h *= c * d
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / ((1 + odd * d) or _TINY)
        c = (1 + odd / c) or _TINY
        h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return math.exp(log_front) * h / a


def t_two_sided(t: float, df: float) -> float:
    if math.isinf(t):
        return 0.0
    return _beta_i(df / 2.0, 0.5, df / (df + t * t))


def f_sf(f: float, d1: float, d2: float) -> float:
    if f <= 0:
        return 1.0
    if math.isinf(f):
        return 0.0
    return _beta_i(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f))


def correlation_p(r: float, n: int) -> float:
    """Two-sided p of a correlation with n - 2 degrees of freedom."""
    if n < 3:
        return 1.0
    if abs(r) >= 1:
        return 0.0
    return t_two_sided(r * math.sqrt((n - 2) / (1 - r * r)), n - 2)


def mann_whitney_p(u1: float, n1: int, n2: int, tie_term: float) -> float:
    """Two-sided p of U. Exact when a group has at most 8 values and nothing is tied."""
    top = max(u1, n1 * n2 - u1)
    if tie_term == 0 and min(n1, n2) <= 8:
        return min(1.0, 2.0 * u_at_most(n1 * n2 - math.ceil(top), n1, n2))
    n = n1 + n2
    sd = math.sqrt(n1 * n2 / 12.0 * ((n + 1) - tie_term / (n * (n - 1.0))))
    if sd == 0:
        return 1.0
    return min(1.0, 2.0 * normal_sf((top - n1 * n2 / 2.0 - 0.5) / sd))


def u_at_most(u: int, n1: int, n2: int) -> float:
    """P(U <= u) without ties, exact for a small group beside one of any size.

    U counts partitions into at most ``small`` parts of at most ``large``: coefficients of the product of
    (1 - q^(large + i)) / (1 - q^i). The numerator is expanded; what is left is a coefficient of
    1 / ((1 - q) prod(1 - q^i)), a quasi-polynomial of period lcm(1..small).
    """
    small, large = sorted((n1, n2))
    if small == 0 or u < 0:
        return float(u >= 0)
    period = math.lcm(*range(1, small + 1))
    numerator = [1]
    for i in (1, *range(1, small + 1)):  # times 1 + q^i + ... + q^(period - i)
        summed = numerator + [0] * (period - i)
        for j in range(i, len(summed)):
            summed[j] += summed[j - i]
        numerator = [c - (summed[j - period] if j >= period else 0) for j, c in enumerate(summed)]
    factors = small + 1

    def partitions(m: int) -> int:
        start = m % period
        return sum(numerator[j] * math.comb((m - j) // period + factors - 1, factors - 1)
                   for j in range(start, min(m, len(numerator) - 1) + 1, period))

    ways = 0
    for chosen in range(1 << small):
        shift = sum(large + i + 1 for i in range(small) if chosen >> i & 1)
        if shift <= u:
            ways += (-1) ** chosen.bit_count() * partitions(u - shift)
    return ways / math.comb(small + large, small)


def kolmogorov_sf(x: float) -> float:
    if x <= 0:
        return 1.0
    if x < 1.0:
        k = np.arange(1, 60)
        return 1.0 - math.sqrt(2 * math.pi) / x * float(
            np.exp(-((2 * k - 1) ** 2) * math.pi**2 / (8 * x * x)).sum()
        )
    k = np.arange(1, 60)
    return float(min(1.0, max(0.0, 2 * ((-1.0) ** (k - 1) * np.exp(-2 * (k * x) ** 2)).sum())))


def ks_two_sample_p(d: float, n1: int, n2: int) -> float:
    """Exact lattice-path p up to 10,000 points in the larger sample, else asymptotic."""
    small, large = sorted((n1, n2))
    if large > 10_000:
        return kolmogorov_sf(d * math.sqrt(n1 * n2 / (n1 + n2)))
    # Chance that a random merge of the samples stays strictly closer than d.
    q = (0.5 + math.floor(d * small * large - 1e-7)) / (small * large)
    j = np.arange(large + 1) / large
    u = (j <= q).astype(float)
    for i in range(1, small + 1):
        allowed = np.abs(i / small - j) <= q
        u = np.cumsum(np.where(allowed, i / (i + large) * u, 0.0)) * allowed
    return float(min(1.0, max(0.0, 1.0 - u[-1])))


def fisher_exact_p(a: int, b: int, c: int, d: int) -> float:
    """Two-sided p of a 2×2 table: all tables no likelier than the one seen."""
    row, col, n = a + b, a + c, a + b + c + d
    lo, hi = max(0, row + col - n), min(row, col)

    def log_p(x: int) -> float:
        return _log_choose(col, x) + _log_choose(n - col, row - x) - _log_choose(n, row)

    seen = log_p(a)
    total = sum(math.exp(p) for p in map(log_p, range(lo, hi + 1)) if p <= seen + 1e-7)
    return min(1.0, total)


def _log_choose(n: int, k: int) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def normal_quantile(p: float) -> float:
    from statistics import NormalDist

    return NormalDist().inv_cdf(p)


def shapiro_p(values: np.ndarray) -> float:
    """Shapiro-Wilk p for 3 ≤ n ≤ 50 by Royston's 1995 approximation."""
    x = np.sort(np.asarray(values, dtype=float))
    n = len(x)
    m = np.array([normal_quantile((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    norm = float(m @ m)
    u = 1 / math.sqrt(n)
    a = np.zeros(n)
    if n == 3:
        a[0], a[-1] = -math.sqrt(0.5), math.sqrt(0.5)
    else:
        # Polynomial coefficients published by Royston (1995).
        last = np.polyval([-2.706056, 4.434685, -2.07119, -0.147981, 0.221157, m[-1] / math.sqrt(norm)], u)
        if n > 5:
            second = np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, m[-2] / math.sqrt(norm)], u)
            phi = (norm - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * second**2)
            a[2:-2] = m[2:-2] / math.sqrt(phi)
            a[1], a[-2] = -second, second
        else:
            phi = (norm - 2 * m[-1] ** 2) / (1 - 2 * last**2)
            a[1:-1] = m[1:-1] / math.sqrt(phi)
        a[0], a[-1] = -last, last
    w = float(a @ x) ** 2 / float(((x - x.mean()) ** 2).sum())
    w = min(w, 1.0)
    if n == 3:
        return max(0.0, min(1.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75)))))
    if w >= 1.0:
        return 1.0
    if n <= 11:
        g = -2.273 + 0.459 * n
        stat = -math.log(g - math.log1p(-w))
        mean = np.polyval([-0.0006714, 0.025054, -0.39978, 0.5440], n)
        sd = math.exp(np.polyval([-0.0020322, 0.062767, -0.77857, 1.3822], n))
    else:
        stat, ln = math.log1p(-w), math.log(n)
        mean = np.polyval([0.0038915, -0.083751, -0.31082, -1.5861], ln)
        sd = math.exp(np.polyval([0.0030302, -0.082676, -0.4803], ln))
    return normal_sf((stat - mean) / sd)
