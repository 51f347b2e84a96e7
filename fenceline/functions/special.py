"""Distribution functions for test statistics.

They run on aggregates (one value per variable, pair or group), so plain scalar
code is enough; Spark SQL has no erf, gamma or normal CDF of its own.
"""

from __future__ import annotations

import math
from functools import cache, lru_cache
from statistics import NormalDist

import numpy as np

_TINY = 1e-300
_EPS = 1e-15
_STANDARD = NormalDist()

# Beyond this many degrees of freedom Student's t is taken from the normal with
# a second-order correction (error below 1e-12 there).
_T_NORMAL_DF = 1e7


def norm_cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2.0))


def norm_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2.0))


def norm_ppf(p: float) -> float:
    if p <= 0.0:
        return -math.inf
    if p >= 1.0:
        return math.inf
    return _STANDARD.inv_cdf(p)


def log_norm_cdf(z: np.ndarray) -> np.ndarray:
    """ln Phi(z) element-wise; the far left tail uses the asymptotic expansion."""
    z = np.asarray(z, dtype=float)
    out = np.empty_like(z)
    far = z < -30.0
    near = z[~far]
    erfc = np.fromiter((math.erfc(v) for v in -near / math.sqrt(2.0)), float, near.size)
    out[~far] = np.log(0.5 * erfc)
    t = z[far]
    out[far] = -0.5 * t * t - np.log(-t) - 0.5 * math.log(2 * math.pi) + np.log1p(-1.0 / (t * t))
    return out


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > _TINY else _TINY)
    result = d
    for m in range(1, 200_000):
        for numerator in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + numerator * d
            d = 1.0 / (d if abs(d) > _TINY else _TINY)
            c = 1.0 + numerator / c
            c = c if abs(c) > _TINY else _TINY
            step = c * d
            result *= step
        if abs(step - 1.0) < _EPS:
            return result
    raise ArithmeticError(f"incomplete beta function does not converge: a={a}, b={b}, x={x}")


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    log_front = (
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    front = math.exp(log_front)
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def gamma_q(a: float, x: float) -> float:
    """Regularised upper incomplete gamma Q(a, x)."""
    if x <= 0.0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1.0:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * _EPS:
            k += 1.0
            term *= x / k
            total += term
        return 1.0 - total * front
    b = x + 1.0 - a
    c, d = 1.0 / _TINY, 1.0 / b
    result = d
    for i in range(1, 100_000):
        numerator = -i * (i - a)
        b += 2.0
        d = numerator * d + b
        d = 1.0 / (d if abs(d) > _TINY else _TINY)
        c = b + numerator / c
        c = c if abs(c) > _TINY else _TINY
        step = c * d
        result *= step
        if abs(step - 1.0) < _EPS:
            return result * front
    raise ArithmeticError(f"incomplete gamma function does not converge: a={a}, x={x}")


def t_sf(t: float, df: float) -> float:
    """P(T > t)."""
    if math.isinf(t):
        return 0.0 if t > 0 else 1.0
    if df > _T_NORMAL_DF:
        return norm_sf(t * (1.0 - 1.0 / (4.0 * df)) / math.sqrt(1.0 + t * t / (2.0 * df)))
    if t * t < df:
        # small |t|: the complement keeps precision
        half = 0.5 * beta_inc(0.5, df / 2.0, t * t / (df + t * t))
        return 0.5 - half if t > 0 else 0.5 + half
    tail = 0.5 * beta_inc(df / 2.0, 0.5, df / (df + t * t))
    return tail if t > 0 else 1.0 - tail


def t_cdf(t: float, df: float) -> float:
    return t_sf(-t, df)


def t_two_sided(t: float, df: float) -> float:
    return min(1.0, 2.0 * t_sf(abs(t), df))


def t_isf(q: float, df: float) -> float:
    """Upper quantile: the t with P(T > t) = q, by bracketing and bisection."""
    if q > 0.5:
        return -t_isf(1.0 - q, df)
    low, high = 0.0, 1.0
    while t_sf(high, df) > q:
        low, high = high, high * 2.0
    while high - low > 1e-13 * max(1.0, high):
        middle = 0.5 * (low + high)
        if middle in (low, high):
            break
        if t_sf(middle, df) > q:
            low = middle
        else:
            high = middle
    return 0.5 * (low + high)


def f_sf(f: float, d1: float, d2: float) -> float:
    if not f > 0.0:
        return 1.0
    return beta_inc(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f))


def chi2_sf(x: float, df: float) -> float:
    return gamma_q(df / 2.0, x / 2.0)


def grubbs_critical(n: int, alpha: float) -> float:
    """Two-sided Grubbs bound for the largest studentised deviation of n values."""
    if n < 3:
        return math.inf
    t = t_isf(alpha / (2.0 * n), n - 2)
    return (n - 1) / math.sqrt(n) * math.sqrt(t * t / (n - 2 + t * t))


def fisher_two_sided(a: int, b: int, c: int, d: int) -> float:
    """Two-sided Fisher exact p: sum of all tables no likelier than the given one."""
    row, col, total = a + b, a + c, a + b + c + d
    first, last = max(0, row + col - total), min(row, col)

    def log_p(k: int) -> float:
        return (
            math.lgamma(row + 1) - math.lgamma(k + 1) - math.lgamma(row - k + 1)
            + math.lgamma(total - row + 1) - math.lgamma(col - k + 1)
            - math.lgamma(total - row - col + k + 1)
            - math.lgamma(total + 1) + math.lgamma(col + 1) + math.lgamma(total - col + 1)
        )

    # The probabilities fall off on both sides of the mode, so each tail stops
    # once its terms no longer count; work does not grow with the table total.
    bound = log_p(a) + 1e-7
    mode = min(last, max(first, (row + 1) * (col + 1) // (total + 2)))
    p = 0.0
    for start, step in ((mode, -1), (mode + 1, 1)):
        k = _first_at_most(log_p, bound, start, first if step < 0 else last, step)
        while k is not None and first <= k <= last:
            term = math.exp(log_p(k))
            p += term
            if term < p * 1e-18:
                break
            k += step
    return min(1.0, p)


def _first_at_most(log_p, bound, start, end, step):
    """First k from start towards end with log_p(k) <= bound (log_p is monotone there)."""
    if (start - end) * step > 0 or log_p(end) > bound:
        return None
    low, high = 0, abs(end - start)
    while low < high:
        middle = (low + high) // 2
        if log_p(start + step * middle) <= bound:
            high = middle
        else:
            low = middle + 1
    return start + step * low


# Ranks at either end whose normal scores are summed one by one; further in, sums are integrals
# with a correction whose rest is below 1e-12 a score.
_EDGE_SCORES = 1000


@lru_cache(maxsize=64)
def _edge_scores(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Cumulative sums of the lowest normal scores of n ranks, and of their squares."""
    m = np.array([0.0] + [norm_ppf((i - 0.375) / (n + 0.25)) for i in range(1, min(n // 2, _EDGE_SCORES) + 1)])
    return np.cumsum(m), np.cumsum(m * m)


def _score_integral(n: int, upto: np.ndarray, squares: bool) -> np.ndarray:
    """Sum of scores (or squares) of the ranks over _EDGE_SCORES up to `upto`, at most n / 2, by Euler and Maclaurin."""

    def parts(rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = (rank + 0.5 - 0.375) / (n + 0.25)
        z = np.fromiter(map(_STANDARD.inv_cdf, p), float, p.size)
        density = np.exp(-0.5 * z * z) / math.sqrt(2 * math.pi)
        whole = p - z * density if squares else -density
        slope = (2 * z if squares else 1.0) / density
        return whole, slope

    (high, high_slope), (low, low_slope) = parts(upto), parts(np.array([float(_EDGE_SCORES)]))
    return (n + 0.25) * (high - low) - (high_slope - low_slope) / (24 * (n + 0.25))


def score_sums(ranks: np.ndarray, n: int) -> np.ndarray:
    """Sum of the normal scores of ranks 1 to each of `ranks` (0 to n) out of n."""
    edge, _ = _edge_scores(n)
    k = np.minimum(ranks, n - ranks).astype(np.int64)  # scores are symmetric and sum to 0
    out = edge[np.minimum(k, len(edge) - 1)]
    inner = k > _EDGE_SCORES
    if inner.any():
        out[inner] += _score_integral(n, k[inner].astype(float), False)
    return out


def _shapiro_weights(n: int) -> tuple[float, float, float]:
    """Weights of the highest and second highest value and what other scores are multiplied by, n > 3."""
    _, squares = _edge_scores(n)
    mm = 2 * float(squares[-1])
    if n // 2 > _EDGE_SCORES:
        mm += 2 * float(_score_integral(n, np.array([float(n // 2)]), True)[0])
    top, next_top = -norm_ppf(0.625 / (n + 0.25)), -norm_ppf(1.625 / (n + 0.25))
    u = 1.0 / math.sqrt(n)
    # Royston's polynomial corrections of the two outer weights.
    outer = float(np.polyval([-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, 0.0], u)) + top / math.sqrt(mm)
    if n <= 5:
        rest = 1 / math.sqrt((mm - 2 * top**2) / (1 - 2 * outer**2))
        return outer, next_top * rest, rest
    second = float(np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, 0.0], u)) + next_top / math.sqrt(mm)
    return outer, second, 1 / math.sqrt((mm - 2 * top**2 - 2 * next_top**2) / (1 - 2 * outer**2 - 2 * second**2))


def shapiro_w(n: float, scored: float, outer_gap: float, second_gap: float, squares: float) -> float:
    """Royston's W from sums over a sample of n >= 3 values.

    `scored` is the sum of normal score times value in order of rank, the gaps are highest
    minus lowest and second highest minus second lowest value, `squares` is the sum of
    squared deviations from the mean. 1 without spread.
    """
    n = int(n)
    if n < 3 or outer_gap == 0 or squares == 0:
        return 1.0
    if n == 3:
        return min(1.0, 0.5 * outer_gap**2 / squares)
    outer, second, rest = _shapiro_weights(n)
    top, next_top = -norm_ppf(0.625 / (n + 0.25)), -norm_ppf(1.625 / (n + 0.25))
    total = rest * scored + (outer - rest * top) * outer_gap + (second - rest * next_top) * second_gap
    return min(1.0, total**2 / squares)


def shapiro_p(w: float, n: float) -> float:
    """Royston's p of W; fitted by its author for n up to 5000, an extrapolation beyond."""
    if n < 3 or w >= 1.0:
        return 1.0
    if n == 3:
        p = 6.0 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75)))
        return min(1.0, max(0.0, p))
    # Royston's normalising transforms of 1 - W.
    if n <= 11:
        g = -2.273 + 0.459 * n
        y = math.log(1.0 - w)
        if y >= g:
            return 1e-99
        y = -math.log(g - y)
        mu = np.polyval([-0.0006714, 0.025054, -0.39978, 0.5440], n)
        sigma = math.exp(np.polyval([-0.0020322, 0.062767, -0.77857, 1.3822], n))
    else:
        y, ln = math.log(1.0 - w), math.log(n)
        mu = np.polyval([0.0038915, -0.083751, -0.31082, -1.5861], ln)
        sigma = math.exp(np.polyval([0.0030302, -0.082676, -0.4803], ln))
    return norm_sf(float(y - mu) / sigma)


def shapiro_wilk(values: np.ndarray) -> tuple[float, float]:
    """W and p of a sample in memory."""
    x = np.sort(np.asarray(values, dtype=float))
    n = x.size
    if n < 3:
        return 1.0, 1.0
    scored = float(np.diff(score_sums(np.arange(n + 1), n)) @ (x - x.mean()))
    w = shapiro_w(n, scored, float(x[-1] - x[0]), float(x[-2] - x[1]), float(((x - x.mean()) ** 2).sum()))
    return w, shapiro_p(w, n)


#: The exact distribution of U is used, whatever the larger sample's size, when no
#: values are tied and the smaller sample has at most this many.
EXACT_U_SAMPLE = 8


@cache
def _box_numerator(m: int) -> tuple[int, list[int]]:
    """L and N with 1 / ((1 - x) (1 - x) (1 - x^2) ... (1 - x^m)) = N(x) / (1 - x^L)^(m + 1), in whole numbers."""
    period, numerator = math.lcm(*range(1, m + 1)), [1]
    for step in (1, *range(1, m + 1)):
        widened = [0] * (len(numerator) + period - step)  # times 1 + x^step + x^(2 step) + ... below x^L
        for k in range(len(widened)):
            widened[k] = (widened[k - step] if k >= step else 0) + (numerator[k] if k < len(numerator) else 0)
            if k >= period:
                widened[k] -= numerator[k - period] if k - period < len(numerator) else 0
        numerator = widened
    return period, numerator


def _orders_up_to(u: int, m: int, n: int) -> int:
    """Number of orders of m and n untied values whose U is at most u; work depends on m alone.

    The generating function of U is the Gaussian binomial, prod (1 - x^(n + i)) / (1 - x^i)
    for i up to m: its numerator has 2^m terms, its denominator the closed counts of
    ``_box_numerator``.
    """
    period, numerator = _box_numerator(m)
    shifts = {0: 1}
    for i in range(1, m + 1):
        moved = dict(shifts)
        for shift, sign in shifts.items():
            if shift + n + i <= u:
                moved[shift + n + i] = moved.get(shift + n + i, 0) - sign
        shifts = moved
    total = 0
    for shift, sign in shifts.items():
        t = u - shift
        for j in range(t % period, min(t + 1, len(numerator)), period):
            total += sign * numerator[j] * math.comb((t - j) // period + m, m)
    return total


def mann_whitney_exact(u: float, n1: int, n2: int) -> float:
    """Two-sided exact p of U for untied samples, the smaller one small, the other of any size."""
    m, n = min(n1, n2), max(n1, n2)
    low = math.floor(min(u, n1 * n2 - u))
    return min(1.0, 2 * _orders_up_to(low, m, n) / math.comb(m + n, m))


def mann_whitney_p(u: float, n1: float, n2: float, ties: float) -> float:
    """Two-sided p: exact for a small untied sample, else normal with continuity and tie correction.

    ties is the sum of t^3 - t.
    """
    n = n1 + n2
    if ties == 0 and min(n1, n2) <= EXACT_U_SAMPLE:
        return mann_whitney_exact(u, int(n1), int(n2))
    variance = n1 * n2 / 12.0 * ((n + 1) - ties / (n * (n - 1)))
    if variance <= 0:
        return 1.0
    z = (max(u, n1 * n2 - u) - n1 * n2 / 2.0 - 0.5) / math.sqrt(variance)
    return min(1.0, 2.0 * norm_sf(z))


def digamma(x: np.ndarray) -> np.ndarray:
    """psi(x) for x > 0: shifted up to x >= 10, then the asymptotic series."""
    x = np.array(x, dtype=float)
    total = np.zeros_like(x)
    for _ in range(10):
        small = x < 10.0
        total[small] -= 1.0 / x[small]
        x[small] += 1.0
    y = 1.0 / (x * x)
    series = y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132))))
    return total + np.log(x) - 0.5 / x - series


def trigamma(x: np.ndarray) -> np.ndarray:
    """psi'(x) for x > 0."""
    x = np.array(x, dtype=float)
    total = np.zeros_like(x)
    for _ in range(10):
        small = x < 10.0
        total[small] += 1.0 / (x[small] * x[small])
        x[small] += 1.0
    y = 1.0 / (x * x)
    return total + 1.0 / x + y / 2 + y / x * (1 / 6 - y * (1 / 30 - y * (1 / 42 - y / 30)))
