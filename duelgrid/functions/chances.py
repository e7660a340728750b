"""Sums of class probabilities over many contexts, for blocks of contexts and players, and their interpolation in one coefficient."""

from __future__ import annotations

import numpy as np

#: Largest error of an interpolated probability.
ACCURACY = 1e-12
#: Ranges of exponents up to which products of exponentials neither overflow nor vanish.
SAFE = 300.0


def class_sums(base: np.ndarray, scale: np.ndarray, weight: np.ndarray, own: np.ndarray) -> np.ndarray:
    """[player, class]: sums over contexts of weight x P(class), at predictors base [context, class] + scale x own [player, class].

    One column is a binary model, more are a softmax. exp(base + scale x own) is a product, so a block needs exponentials
    of its contexts and of its players only, and the sums are products of matrices. Where the exponents are too large for
    that, each pair is computed by itself.
    """
    out = np.zeros((len(own), base.shape[1]))
    for s in np.unique(scale):
        at = scale == s
        b, w, o = base[at], weight[at], s * own
        if base.shape[1] == 1:
            if max(np.abs(b).max(), np.abs(o).max(initial=0.0)) > SAFE:
                out[:, 0] += w @ (1 / (1 + np.exp(-np.clip(b + o.T, -700, 700))))
            else:
                out[:, 0] += w @ (1 / (1 + np.exp(-b) * np.exp(-o.T)))
            continue
        b, o = b - b.max(axis=1, keepdims=True), o - o.max(axis=1, keepdims=True)
        if -b.min() - o.min(initial=0.0) > SAFE:
            for row, x in zip(b, w):
                eta = row + o
                powers = np.exp(eta - eta.max(axis=1, keepdims=True))
                out += x * powers / powers.sum(axis=1, keepdims=True)
            continue
        a, p = np.exp(b), np.exp(o)
        shares = w[:, None] / (a @ p.T)
        out += p * (shares.T @ a)
    return out


def node_count(half: float, accuracy: float = ACCURACY) -> int:
    """Chebyshev points that interpolate logistic(b + s x), |s| <= 1, on an interval of half width `half` within `accuracy`.

    The function is analytic, and at most 1 in size, where the imaginary part of s x is at most pi / 2, so inside the ellipse
    whose parameter rho is q + sqrt(q^2 + 1) with q = pi / (2 half). There the error of n + 1 points is at most 4 rho^-n / (rho - 1),
    whatever b and s are, and so is that of any mean of such functions.
    """
    if half <= 0:
        return 1
    q = np.pi / (2 * half)
    log_rho = np.arcsinh(q)
    return 1 + max(1, int(np.ceil((np.log(4 / accuracy) - np.log(np.expm1(log_rho))) / log_rho)))


def chebyshev_nodes(low: float | None, high: float | None, players: int) -> tuple[np.ndarray, np.ndarray] | None:
    """(points, barycentric weights) of `node_count` for the interval; None if they are no fewer than the players, or it isn't finite."""
    if not players or not np.isfinite([low, high]).all() or (count := node_count((high - low) / 2)) >= players:
        return None
    angle = (2 * np.arange(count) + 1) * np.pi / (2 * count)
    return (low + high) / 2 + (high - low) / 2 * np.cos(angle), np.where(np.arange(count) % 2, -1.0, 1.0) * np.sin(angle)


def interpolate(points: np.ndarray, weights: np.ndarray, values: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Values [x, column] of the polynomial through `values` [point, column]."""
    gap = x[:, None] - points
    exact = gap == 0
    parts = weights / np.where(exact, 1.0, gap)
    hit = exact.any(axis=1)
    parts[hit] = exact[hit]
    return parts @ values / parts.sum(axis=1, keepdims=True)
