"""Gradient-boosted trees for the logistic loss, and Platt scaling, in numpy."""

from __future__ import annotations

import numpy as np


def _best_split(x: np.ndarray, g: np.ndarray, h: np.ndarray, least: int) -> tuple[float, int, float]:
    best = (0.0, -1, 0.0)
    total_g, total_h = g.sum(), h.sum()
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v = x[order, f]
        cg, ch = np.cumsum(g[order])[:-1], np.cumsum(h[order])[:-1]
        ok = v[1:] > v[:-1]
        ok[: least - 1] = ok[len(ok) - least + 1 :] = False
        if not ok.any():
            continue
        gain = cg**2 / (ch + 1) + (total_g - cg) ** 2 / (total_h - ch + 1) - total_g**2 / (total_h + 1)
        gain[~ok] = 0
        k = int(gain.argmax())
        if gain[k] > best[0] + 1e-9:
            best = (float(gain[k]), f, float((v[k] + v[k + 1]) / 2))
    return best


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, least: int) -> list:
    if depth and len(g) >= 2 * least:
        gain, f, cut = _best_split(x, g, h, least)
        if f >= 0 and gain > 1e-3:
            low = x[:, f] <= cut
            return [f, cut, _grow(x[low], g[low], h[low], depth - 1, least), _grow(x[~low], g[~low], h[~low], depth - 1, least)]
    return [-1, float(g.sum() / (h.sum() + 1)), None, None]


def _value(tree: list, x: np.ndarray) -> np.ndarray:
    f, v, low, high = tree
    if f < 0:
        return np.full(len(x), v)
    left = x[:, f] <= v
    out = np.empty(len(x))
    out[left], out[~left] = _value(low, x[left]), _value(high, x[~left])
    return out


def raw(model: dict, x: np.ndarray) -> np.ndarray:
    out = np.full(len(x), model["bias"])
    for t in model["trees"]:
        out += model["rate"] * _value(t, x)
    return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.3, least: int = 8) -> dict:
    y = y.astype(float)
    bias = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    now, grown = np.full(len(y), bias), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-now))
        t = _grow(x, y - p, p * (1 - p), depth, least)
        grown.append(t)
        now += rate * _value(t, x)
    return {"bias": bias, "rate": rate, "trees": grown}


def platt(s: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(a, b) such that 1 / (1 + exp(-(a s + b))) is the chance that a row of raw score ``s`` is positive."""
    y = y.astype(float)
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps on the two parameters
        p = 1 / (1 + np.exp(-(a * s + b)))
        w = p * (1 - p) + 1e-9
        grad = np.array([((p - target) * s).sum() + 1e-3 * (a - 1), (p - target).sum()])
        hess = np.array([[(w * s * s).sum() + 1e-3, (w * s).sum()], [(w * s).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(hess, grad)
        a, b = a - float(np.clip(step[0], -1, 1)), b - float(np.clip(step[1], -1, 1))
    return a, b
