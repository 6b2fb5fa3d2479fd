"""Statistics of benchmark scores that need no table: quantiles and p-values of Student's t, effect sizes, intervals."""

from __future__ import annotations

import math


def _beta_fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function, by Lentz's method."""
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def beta_cdf(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_cdf(t: float, df: float) -> float:
    tail = beta_cdf(df / 2, 0.5, df / (df + t * t)) / 2
    return 1 - tail if t > 0 else tail


def t_quantile(p: float, df: float) -> float:
    low, high = -1.0, 1.0
    while t_cdf(low, df) > p:
        low *= 2
    while t_cdf(high, df) < p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if t_cdf(mid, df) < p else (low, mid)
    return (low + high) / 2


def _mean_var(x: list[float]) -> tuple[float, float]:
    m = sum(x) / len(x)
    return m, sum((v - m) ** 2 for v in x) / (len(x) - 1) if len(x) > 1 else 0.0


def confidence_interval(x: list[float], level: float = 0.95) -> tuple[float, float, float]:
    """Mean, low and high; a point for one value, zeros for none."""
    if not x:
        return 0.0, 0.0, 0.0
    m, v = _mean_var(x)
    if len(x) == 1:
        return m, m, m
    half = t_quantile((1 + level) / 2, len(x) - 1) * math.sqrt(v / len(x))
    return m, m - half, m + half


def cohens_d(a: list[float], b: list[float]) -> tuple[float, str]:
    """(b - a) in pooled deviations, and its band."""
    if len(a) < 2 or len(b) < 2:
        return 0.0, "insufficient"
    (ma, va), (mb, vb) = _mean_var(a), _mean_var(b)
    s = math.sqrt(((len(a) - 1) * va + (len(b) - 1) * vb) / (len(a) + len(b) - 2))
    d = (mb - ma) / s if s > 0 else 0.0
    return d, effect_band(d)


def effect_band(d: float) -> str:
    return next((name for limit, name in ((0.2, "negligible"), (0.5, "small"), (0.8, "medium")) if abs(d) < limit), "large")


def paired_t(a: list[float], b: list[float]) -> tuple[float, float]:
    """Statistic and two-sided p of b - a; p is 1 where there are no two pairs."""
    if len(a) != len(b) or len(a) < 2:
        return 0.0, 1.0
    m, v = _mean_var([y - x for x, y in zip(a, b)])
    if v == 0:
        return (0.0, 1.0) if m == 0 else (math.copysign(math.inf, m), 0.0)
    t = m / math.sqrt(v / len(a))
    return t, 2 * (1 - t_cdf(abs(t), len(a) - 1))


def independent_t(a: list[float], b: list[float]) -> tuple[float, float]:
    """As `paired_t`, for independent samples of equal variance."""
    if len(a) < 2 or len(b) < 2:
        return 0.0, 1.0
    (ma, va), (mb, vb) = _mean_var(a), _mean_var(b)
    df = len(a) + len(b) - 2
    s = ((len(a) - 1) * va + (len(b) - 1) * vb) / df
    if s == 0:
        return (0.0, 1.0) if ma == mb else (math.copysign(math.inf, mb - ma), 0.0)
    t = (mb - ma) / math.sqrt(s * (1 / len(a) + 1 / len(b)))
    return t, 2 * (1 - t_cdf(abs(t), df))


def generalization(raw_train: list[float], raw_test: list[float], train: list[float], test: list[float]) -> dict[str, float]:
    """What deduplication of the training data did to test scores, over seeds."""
    gains = [b - a for a, b in zip(raw_test, test)]
    mean, low, high = confidence_interval(gains)
    gap = lambda x, y: sum(x) / len(x) - sum(y) / len(y) if x and y else 0.0
    d, band = cohens_d(raw_test, test)
    t, p = paired_t(raw_test, test)
    return {"improvement": mean, "low": low, "high": high, "gap_reduction": gap(raw_train, raw_test) - gap(train, test), "effect": d, "band": band, "p_one_sided": p / 2 if t > 0 else 1 - p / 2}
