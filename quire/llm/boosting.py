"""Gradient-boosted trees over distinct feature vectors and how often each occurs:
trained with numpy on the driver, applied as a column expression in the JVM."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

TREES, DEPTH, RATE, LEAST = 24, 3, 0.3, 5


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _grow(x, g, h, w, depth):
    """Second-order tree: (feature, bound, left, right), or a leaf's value. ``g`` and
    ``h`` are sums over the ``w`` examples of each vector."""
    value = float(-g.sum() / (h.sum() + 1.0))
    if depth == 0 or w.sum() < 2 * LEAST:
        return value
    best, base = (1e-6, None, None), g.sum() ** 2 / (h.sum() + 1.0)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, cg, ch, n = x[order, f], np.cumsum(g[order]), np.cumsum(h[order]), np.cumsum(w[order])
        cut = np.flatnonzero(v[1:] > v[:-1])
        cut = cut[(n[cut] >= LEAST) & (n[-1] - n[cut] >= LEAST)]
        if not len(cut):
            continue
        gain = cg[cut] ** 2 / (ch[cut] + 1) + (cg[-1] - cg[cut]) ** 2 / (ch[-1] - ch[cut] + 1) - base
        j = int(gain.argmax())
        if gain[j] > best[0]:
            best = (float(gain[j]), f, float((v[cut[j]] + v[cut[j] + 1]) / 2))
    if best[1] is None:
        return value
    left = x[:, best[1]] <= best[2]
    return (best[1], best[2], _grow(x[left], g[left], h[left], w[left], depth - 1),
            _grow(x[~left], g[~left], h[~left], w[~left], depth - 1))


def _apply(tree, x):
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    left = x[:, tree[0]] <= tree[1]
    out = np.empty(len(x))
    out[left], out[~left] = _apply(tree[2], x[left]), _apply(tree[3], x[~left])
    return out


def train(x: np.ndarray, y: np.ndarray, w: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> list:
    """Trees whose values sum to the log odds (first entry: the base log odds); ``w`` is
    the number of examples of each vector and label."""
    p = np.clip((w * y).sum() / w.sum(), 1e-3, 1 - 1e-3)
    score = np.full(len(y), np.log(p / (1 - p)))
    out = [float(score[0])]
    for _ in range(trees):
        q = _sigmoid(score)
        tree = _grow(x, w * (q - y), w * q * (1 - q), w, depth)
        score = score + RATE * _apply(tree, x)
        out.append(tree)
    return out


def log_odds(model: list, x: np.ndarray) -> np.ndarray:
    return model[0] + RATE * sum(_apply(t, x) for t in model[1:])


def threshold(model: list, x: np.ndarray, y: np.ndarray, w: np.ndarray, precision: float) -> float | None:
    """Least log odds, midway between held-out scores, above which the share of true
    examples, with Laplace's correction, is at least ``precision``; None if there
    is none."""
    s = log_odds(model, x)
    order = np.argsort(-s, kind="stable")
    s, hits, n = s[order], np.cumsum((w * y)[order]), np.cumsum(w[order])
    last = np.append(s[1:] < s[:-1], True)
    fine = np.flatnonzero(last & ((hits + 1) / (n + 2) >= precision))
    if not len(fine):
        return None
    k = fine[-1]
    return float(s[k] if k + 1 == len(s) else (s[k] + s[k + 1]) / 2)


def expression(model: list, features: list[Column]) -> Column:
    """The model's log odds as a column."""
    def of(tree):
        if not isinstance(tree, tuple):
            return F.lit(RATE * tree)
        return F.when(features[tree[0]] <= F.lit(tree[1]), of(tree[2])).otherwise(of(tree[3]))

    out = F.lit(model[0])
    for tree in model[1:]:
        out = out + of(tree)
    return out
