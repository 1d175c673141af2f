"""Distribution functions and p-value adjustment, in plain Python for the driver, and draws by hash for tasks."""

from __future__ import annotations

import math
from collections.abc import Sequence
from statistics import NormalDist

import numpy as np

_NORMAL = NormalDist()


def normal_quantile(p: float) -> float:
    return _NORMAL.inv_cdf(p)


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function: series below a + 1, else continued fraction (Lentz)."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-17:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1.0 - front * total)
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1 / (d if abs(d) > tiny else tiny)
        c = b + an / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return front * h


def chi2_upper(x: float, df: float) -> float:
    return gamma_upper(df / 2, x / 2)


def beta_lower(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_lower(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 10_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return front * h


def student_two_sided(t: float, df: float) -> float:
    return beta_lower(df / 2, 0.5, df / (df + t * t))


def fisher_combined(ps: Sequence[float]) -> tuple[float, float] | None:
    """Fisher's statistic and p of independent p-values; None for fewer than two valid ones."""
    ok = [max(p, 1e-300) for p in ps if p is not None and math.isfinite(p)]
    if len(ok) < 2:
        return None
    stat = -2 * sum(map(math.log, ok))
    return stat, chi2_upper(stat, 2 * len(ok))


def bh_adjust(ps: Sequence[float | None]) -> list[float | None]:
    """Benjamini-Hochberg; missing p-values stay missing and don't count."""
    at = sorted((i for i, p in enumerate(ps) if p is not None and not math.isnan(p)), key=lambda i: ps[i])
    out, low = list(ps), 1.0
    for rank in range(len(at), 0, -1):
        low = min(low, ps[at[rank - 1]] * len(at) / rank)
        out[at[rank - 1]] = low
    return out


def average_ranks(xs: Sequence[float]) -> list[float]:
    order = sorted(range(len(xs)), key=lambda i: xs[i])
    out, i = [0.0] * len(xs), 0
    while i < len(order):
        j = i
        while j + 1 < len(order) and xs[order[j + 1]] == xs[order[i]]:
            j += 1
        for k in order[i : j + 1]:
            out[k] = (i + j) / 2 + 1
        i = j + 1
    return out


def spearman(xs: Sequence[float], ys: Sequence[float]) -> tuple[float, float]:
    """Spearman's rho and its two-sided p by Student's t."""
    a, b = average_ranks(xs), average_ranks(ys)
    n, ma, mb = len(a), sum(a) / len(a), sum(b) / len(b)
    num = sum((x - ma) * (y - mb) for x, y in zip(a, b, strict=True))
    den = math.sqrt(sum((x - ma) ** 2 for x in a) * sum((y - mb) ** 2 for y in b))
    rho = max(-1.0, min(1.0, num / den))
    if n < 3 or abs(rho) == 1:
        return rho, 0.0
    return rho, student_two_sided(rho * math.sqrt((n - 2) / (1 - rho * rho)), n - 2)


def mixed(keys: np.ndarray, stream: int, seed: int) -> np.ndarray:
    """Unsigned 64-bit numbers drawn for each key: the splitmix64 finaliser over key, stream and seed."""
    with np.errstate(over="ignore"):
        z = np.asarray(keys).astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (stream + 1) + 0xD1B54A32D192ED03 * (seed + 1)) % 2**64)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))
