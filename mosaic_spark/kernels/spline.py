"""Monotone cubic interpolation: a cubic spline whose slopes are filtered so that
the curve follows the data's rises and falls (Hyman 1983), on the spline of
Forsythe, Malcolm and Moler with end cubics through four points."""

from __future__ import annotations

import numpy as np


def _third_difference(x: np.ndarray, y: np.ndarray) -> float:
    d = y
    for k in range(1, 4):
        d = np.diff(d) / (x[k:] - x[:-k])
    return float(d[0])


def spline_slopes(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Slopes at the knots of the cubic spline."""
    n = len(x)
    h, s = np.diff(x), np.diff(y) / np.diff(x)
    if n == 2:
        return np.repeat(s, 2)
    low, mid, high, rhs = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    low[1:-1], mid[1:-1], high[1:-1], rhs[1:-1] = h[:-1], 2 * (h[:-1] + h[1:]), h[1:], np.diff(s)
    mid[0], high[0], low[-1], mid[-1] = -h[0], h[0], h[-1], -h[-1]
    if n > 3:
        rhs[0] = h[0] ** 2 * _third_difference(x[:4], y[:4])
        rhs[-1] = -h[-1] ** 2 * _third_difference(x[-4:], y[-4:])
    for i in range(1, n):
        f = low[i] / mid[i - 1]
        mid[i] -= f * high[i - 1]
        rhs[i] -= f * rhs[i - 1]
    c = np.zeros(n)
    c[-1] = rhs[-1] / mid[-1]
    for i in range(n - 2, -1, -1):
        c[i] = (rhs[i] - high[i] * c[i + 1]) / mid[i]
    return np.append(s - h * (c[1:] + 2 * c[:-1]), s[-1] + h[-1] * (c[-2] + 2 * c[-1]))


def monotone_slopes(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Slopes limited to three times the smaller neighbouring secant, and to the
    secants' sign where these agree."""
    b, s = spline_slopes(x, y), np.diff(y) / np.diff(x)
    left, right = np.concatenate([s[:1], s]), np.concatenate([s, s[-1:]])
    most = 3 * np.minimum(np.abs(left), np.abs(right))
    rising = np.where(left * right > 0, right, b) >= 0
    return np.where(rising, np.clip(b, 0, most), np.clip(b, -most, 0))


class MonotoneCurve:
    """y(x) through knots; beyond the ends the end value."""

    def __init__(self, x, y) -> None:
        x, y = np.asarray(x, float), np.asarray(y, float)
        self.x, at, n = np.unique(x, return_inverse=True, return_counts=True)
        if len(self.x) < 2:
            raise ValueError("a curve needs at least 2 distinct values")
        self.y = np.bincount(at, y) / n
        self.slope = monotone_slopes(self.x, self.y)

    def __call__(self, v) -> np.ndarray:
        v = np.clip(np.asarray(v, float), self.x[0], self.x[-1])
        i = np.clip(np.searchsorted(self.x, v, "right") - 1, 0, len(self.x) - 2)
        h = self.x[i + 1] - self.x[i]
        t = (v - self.x[i]) / h
        a, b = (1 + 2 * t) * (1 - t) ** 2, t * (1 - t) ** 2
        return a * self.y[i] + b * h * self.slope[i] + (1 - a) * self.y[i + 1] - t**2 * (1 - t) * h * self.slope[i + 1]
