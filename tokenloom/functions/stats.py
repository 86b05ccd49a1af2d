"""Distributions and solvers in plain NumPy: beta, t and F tails, ranks, hulls, bounded least squares."""

from __future__ import annotations

import math

import numpy as np


def beta_cdf(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function, by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_cdf(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or tiny)
    f = d
    for m in range(1, 400):
        for sign in (1, -1):
            if sign > 0:
                term = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
            else:
                term = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            d = 1 / ((1 + term * d) or tiny)
            c = (1 + term / c) or tiny
            f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * f


def t_sf(t: float, dof: float) -> float:
    """P(T > t)."""
    tail = beta_cdf(dof / (dof + t * t), dof / 2, 0.5) / 2
    return tail if t >= 0 else 1 - tail


def f_sf(f: float, d1: float, d2: float) -> float:
    return 1.0 if f <= 0 else beta_cdf(d2 / (d2 + d1 * f), d2 / 2, d1 / 2)


def t_quantile(p: float, dof: float) -> float:
    """The t with P(T <= t) = p, by bisection."""
    low, high = -1e3, 1e3
    while t_sf(high, dof) > 1 - p:
        high *= 10
    while 1 - t_sf(low, dof) > p:
        low *= 10
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - t_sf(mid, dof) < p else (low, mid)
    return (low + high) / 2


def correlation_p(r: float | None, dof: int) -> float | None:
    """Two-sided p of a correlation with dof degrees of freedom: n - 2, one less for each covariate."""
    if r is None or not math.isfinite(r) or dof <= 0:
        return None
    r = max(-1.0, min(1.0, r))
    return 0.0 if abs(r) == 1 else 2 * t_sf(abs(r) * math.sqrt(dof / (1 - r * r)), dof)


def average_ranks(x: np.ndarray) -> np.ndarray:
    _, inverse, count = np.unique(x, return_inverse=True, return_counts=True)
    last = np.cumsum(count)
    return (last - (count - 1) / 2)[inverse]


def hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull in the plane, counter-clockwise, by the monotone chain."""
    p = sorted(set(map(tuple, np.asarray(points, float).tolist())))
    if len(p) < 3:
        return np.array(p)

    def half(rows):
        out = []
        for q in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(half(p) + half(p[::-1]))


def outside_fraction(reference: np.ndarray, points: np.ndarray) -> float:
    """Share of points outside the hull of reference points; nan where those span no area."""
    corners = hull(reference)
    if len(corners) < 3 or not len(points):
        return math.nan
    a, b = corners, np.roll(corners, -1, axis=0)
    side = (b[:, 0] - a[:, 0])[:, None] * (points[:, 1][None] - a[:, 1][:, None]) - (b[:, 1] - a[:, 1])[:, None] * (points[:, 0][None] - a[:, 0][:, None])
    return float((side < -1e-12 * (1 + np.abs(corners).max())).any(axis=0).mean())


def bounded_least_squares(f, start: np.ndarray, low: np.ndarray, high: np.ndarray, steps: int = 400) -> tuple[np.ndarray, float]:
    """Projected Levenberg-Marquardt: parameters within bounds that make the residuals f(p) least in squares."""
    p = np.clip(np.asarray(start, float), low, high)
    r = f(p)
    best, damp = float(r @ r), 1e-2
    for _ in range(steps):
        h = 1e-6 * np.maximum(1.0, np.abs(p))
        h = np.where(p + h > high, -h, h)
        j = np.stack([(f(p + np.eye(len(p))[k] * h[k]) - r) / h[k] for k in range(len(p))], axis=1)
        a, g = j.T @ j, j.T @ r
        for _ in range(30):
            free = ~(((p <= low) & (g > 0)) | ((p >= high) & (g < 0)))
            move = np.zeros(len(p))
            if free.any():
                m = a[np.ix_(free, free)] + damp * np.diag(np.maximum(np.diag(a)[free], 1e-12))
                move[free] = -np.linalg.lstsq(m, g[free], rcond=None)[0]
            new = np.clip(p + move, low, high)
            s = f(new)
            rss = float(s @ s)
            if rss < best:
                break
            damp *= 4
        else:
            return p, best
        gain, p, r, best, damp = best - rss, new, s, rss, max(damp / 6, 1e-12)
        if gain <= 1e-14 * (1 + best):
            break
    return p, best
