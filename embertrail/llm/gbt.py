"""Gradient-boosted trees in numpy: fitted on the driver from a bounded sample, flattened into node arrays for vectorised scoring."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Nodes of all trees in one run of arrays. A leaf points to itself. Scoring goes down all trees at once, one level a step."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int
    base: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for lo in range(0, len(x), 4096):
            part = x[lo : lo + 4096]
            node = np.repeat(self.roots[None, :], len(part), 0)
            rows = np.arange(len(part))[:, None]
            for _ in range(self.depth):
                node = np.where(part[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            out[lo : lo + 4096] += self.value[node].sum(1)
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, monotone: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 48, l2: float = 2.0, least: int = 8) -> Trees:
    """Logistic loss, second order. monotone[j]: +1 if the score may only rise with feature j, -1 only fall, 0 free.

    A constrained feature's split is taken only if the two leaf values stand in the right order, and below it both sides are held to
    their own side of the middle, so that the whole tree is monotone."""
    n, d = x.shape
    rate_pos = float(np.clip(y.mean() if n else 0.5, 1e-3, 1 - 1e-3))
    base = float(np.log(rate_pos / (1 - rate_pos)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.array([]) for j in range(d)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1) if n else np.zeros((0, d), int)
    nodes: list[list] = []  # feature, threshold, left, right, value
    roots, f = [], np.full(n, base)

    def grow(rows: np.ndarray, level: int, low: float, high: float, g: np.ndarray, h: np.ndarray) -> int:
        at = len(nodes)
        gs, hs = g[rows].sum(), h[rows].sum()
        value = float(np.clip(-gs / (hs + l2), low, high))
        nodes.append([0, 0.0, at, at, value * rate])
        if level == depth or len(rows) < 2 * least:
            return at
        best = (1e-6, -1, 0, 0.0)
        own = gs * gs / (hs + l2)
        for j in range(d):
            k = len(cuts[j])
            if not k:
                continue
            b = binned[rows, j]
            gl, hl, nl = (np.cumsum(np.bincount(b, w, k + 1))[:-1] for w in (g[rows], h[rows], None))
            gr, hr, nr = gs - gl, hs - hl, len(rows) - nl
            vl, vr = np.clip(-gl / (hl + l2), low, high), np.clip(-gr / (hr + l2), low, high)
            gain = gl * gl / (hl + l2) + gr * gr / (hr + l2) - own
            fine = (nl >= least) & (nr >= least) & (monotone[j] * (vr - vl) >= 0)
            gain = np.where(fine, gain, 0)
            c = int(gain.argmax())
            if gain[c] > best[0]:
                best = (float(gain[c]), j, c, float((vl[c] + vr[c]) / 2))
        _, j, c, mid = best
        if j < 0:
            return at
        go = binned[rows, j] <= c
        ll, lh, rl, rh = low, high, low, high
        if monotone[j] > 0:
            lh = rl = mid
        elif monotone[j] < 0:
            ll = rh = mid
        nodes[at][0], nodes[at][1] = j, float(cuts[j][c])
        nodes[at][2] = grow(rows[go], level + 1, ll, lh, g, h)
        nodes[at][3] = grow(rows[~go], level + 1, rl, rh, g, h)
        return at

    for _ in range(trees if n and 0 < y.sum() < n else 0):
        p = 1 / (1 + np.exp(-f))
        start = len(nodes)
        roots.append(grow(np.arange(n), 0, -np.inf, np.inf, p - y, np.maximum(p * (1 - p), 1e-6)))
        one = Trees(np.array([start]), *_arrays(nodes), depth, 0.0)
        f = f + one.raw(x)
    if not roots:
        nodes.append([0, 0.0, 0, 0, 0.0])
        roots = [0]
    return Trees(np.array(roots), *_arrays(nodes), depth, base)


def _arrays(nodes: list[list]) -> tuple[np.ndarray, ...]:
    feature, threshold, left, right, value = zip(*nodes, strict=True)
    return np.array(feature), np.array(threshold), np.array(left), np.array(right), np.array(value)
