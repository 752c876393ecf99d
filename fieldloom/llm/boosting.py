"""Gradient boosted trees for two classes, grown from sums over blocks of rows.

A block holds distinct rows: for each feature the place of its value among all values of that
feature (its cell), and how often the row is a negative and a positive example.  A tree grows by
levels: each block gives the gradient sums of every node and cell, the blocks' sums are added up
wherever the blocks are, and only the total decides.  Sums are integers, so neither the number
of blocks nor their order changes a tree.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np

Block = tuple[np.ndarray, np.ndarray]
#: A gradient of one, as an integer.
ONE = 1 << 24


@dataclass
class Trees:
    """Complete trees of one depth: a feature and a threshold for each inner node, a value for each leaf."""

    features: np.ndarray
    thresholds: np.ndarray
    values: np.ndarray
    base: float
    slope: float = 1.0
    offset: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for features, thresholds, values in zip(self.features, self.thresholds, self.values, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(int(np.log2(len(values)))):
                at = 2 * at + 1 + (x[rows, features[at]] > thresholds[at])
            out += values[at - (len(values) - 1)]
        return out

    def curve(self, raw: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * raw + self.offset, -30, 30)))

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Calibrated by a logistic curve over the trees' sum."""
        return self.curve(self.raw(x))


def cells_of(x: np.ndarray) -> list[np.ndarray]:
    """The values of each feature, ascending."""
    return [np.unique(x[:, f]) for f in range(x.shape[1])]


def joined(one: list[np.ndarray], other: list[np.ndarray]) -> list[np.ndarray]:
    return [np.union1d(a, b) for a, b in zip(one, other, strict=True)]


def coded(x: np.ndarray, cells: list[np.ndarray]) -> np.ndarray:
    """The cell of each value."""
    return np.stack([np.searchsorted(c, x[:, f]).astype(np.int32) for f, c in enumerate(cells)], axis=1)


def _node_sums(block: Block, trees: Trees, features: np.ndarray, cuts: np.ndarray, level: int, starts: np.ndarray) -> np.ndarray:
    """(examples, gradients, second gradients) of each node of a level and cell."""
    codes, times = block
    p = 1 / (1 + np.exp(-trees.raw(codes)))
    every = times.sum(axis=1)
    g = np.rint(p * ONE) * every - ONE * times[:, 1]
    h = np.rint(p * (1 - p) * ONE) * every
    at, rows = np.zeros(len(codes), np.int64), np.arange(len(codes))
    for _ in range(level):
        at = 2 * at + 1 + (codes[rows, features[at]] > cuts[at])
    places = ((at - (2**level - 1))[:, None] * starts[-1] + starts[:-1] + codes).ravel()
    sums = [np.bincount(places, np.repeat(v, codes.shape[1]), 2**level * starts[-1]) for v in (every, g, h)]
    return np.rint(np.stack(sums)).astype(np.int64).reshape(3, 2**level, -1)


def _best_split(sums: np.ndarray, cells: list[np.ndarray], starts: np.ndarray, penalty: float, least: float) -> tuple[int, float, float, np.ndarray]:
    """(feature, cut in cells, threshold, sums left of it) of a node; without a split all is left of infinity."""
    total = sums[:, starts[0] : starts[1]].sum(axis=1)
    whole = (total[1] / ONE) ** 2 / (total[2] / ONE + penalty)
    best, found = 0.0, (0, np.inf, np.inf, total)
    for f, values in enumerate(cells):
        own = sums[:, starts[f] : starts[f + 1]]
        held = np.flatnonzero(own[0])
        if len(held) < 2:
            continue
        left = np.cumsum(own[:, held[:-1]], axis=1)
        (left_g, left_h), (right_g, right_h) = left[1:] / ONE, (total[1:, None] - left[1:]) / ONE
        gain = left_g**2 / (left_h + penalty) + right_g**2 / (right_h + penalty) - whole
        gain[(left_h < least) | (right_h < least)] = 0
        i = int(gain.argmax())
        if gain[i] > best + 1e-9:
            best, found = float(gain[i]), (f, held[i] + 0.5, (float(values[held[i]]) + float(values[held[i + 1]])) / 2, left[:, i])
    return found


def boost_blocks(
    cells: list[np.ndarray], total: Callable[[Callable[[Block], np.ndarray]], np.ndarray],
    rounds: int = 40, depth: int = 3, rate: float = 0.3, penalty: float = 1.0, least: float = 1.0,
) -> Trees:
    """Second-order boosting of the log loss; ``total`` adds up a function's results over all blocks of coded rows."""
    starts = np.concatenate([[0], np.cumsum([len(c) for c in cells])])
    clean, right = total(lambda block: block[1].sum(axis=0))
    share = np.clip(right / (clean + right), 0.01, 0.99)
    inner, leaves = 2**depth - 1, 2**depth
    grown = Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), float(np.log(share / (1 - share))))
    thresholds = np.zeros((0, inner))
    for _ in range(rounds):
        features, cuts, real = np.zeros(inner, np.int64), np.full(inner, np.inf), np.full(inner, np.inf)
        held, split = np.zeros((3, inner + leaves), np.int64), np.zeros(inner + leaves, bool)
        split[0] = True  # of a node: that its parent has a split
        for level in range(depth):
            nodes = range(2**level - 1, 2 ** (level + 1) - 1)
            if split[list(nodes)].any():
                sums = total(lambda block, level=level: _node_sums(block, grown, features, cuts, level, starts))
            for node in nodes:
                left = held[:, node]
                if split[node]:
                    own = sums[:, node - nodes[0]]
                    held[:, node] = own[:, starts[0] : starts[1]].sum(axis=1)
                    features[node], cuts[node], real[node], left = _best_split(own, cells, starts, penalty, least)
                held[:, 2 * node + 1], held[:, 2 * node + 2] = left, held[:, node] - left
                split[2 * node + 1 : 2 * node + 3] = cuts[node] < np.inf
        values = -rate * (held[1, inner:] / ONE) / (held[2, inner:] / ONE + penalty)
        grown = replace(
            grown, features=np.vstack([grown.features, features]), thresholds=np.vstack([grown.thresholds, cuts]), values=np.vstack([grown.values, values])
        )
        thresholds = np.vstack([thresholds, real])
    return replace(grown, thresholds=thresholds)


def boost(x: np.ndarray, y: np.ndarray, **how) -> Trees:
    """The trees of one table in memory."""
    cells = cells_of(x)
    block = coded(x, cells), np.stack([y == 0, y == 1], axis=1).astype(np.int64)
    return boost_blocks(cells, lambda of: of(block), **how)


def fit_curve(trees: Trees, raw: np.ndarray, y: np.ndarray, times: np.ndarray) -> Trees:
    """Fit the logistic curve over the trees' sums, each of which occurs ``times``."""
    positives, n = (y * times).sum(), times.sum()
    if not 0 < positives < n:
        return trees
    slope, offset = 1.0, 0.0
    target = np.where(y == 1, (positives + 1) / (positives + 2), 1 / (n - positives + 2))
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(slope * raw + offset, -30, 30)))
        w, d = np.maximum(p * (1 - p), 1e-9) * times, (p - target) * times
        gradient = np.array([(d * raw).sum(), d.sum()])
        hessian = np.array([[(w * raw * raw).sum(), (w * raw).sum()], [(w * raw).sum(), w.sum()]]) + 1e-6 * np.eye(2)
        step = np.clip(np.linalg.solve(hessian, gradient), -1, 1)
        slope, offset = slope - step[0], offset - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return replace(trees, slope=float(max(slope, 1e-3)), offset=float(offset))


def calibrate(trees: Trees, x: np.ndarray, y: np.ndarray) -> Trees:
    """Fit the logistic curve over the trees' sum on rows that boosting did not see."""
    return fit_curve(trees, trees.raw(x), y, np.ones(len(y)))


def threshold_of(probabilities: np.ndarray, y: np.ndarray, precision: float, least: float = 0.5, times: np.ndarray | None = None) -> float:
    """The lowest threshold, not under ``least``, at and above which the precision holds; above 1 if none does."""
    order = np.argsort(-probabilities, kind="stable")
    falling = probabilities[order]
    every = np.cumsum((np.ones(len(y)) if times is None else times)[order])
    right = np.cumsum((y if times is None else y * times)[order]) / every
    # Equal probabilities are selected together.
    ok = np.flatnonzero((right >= precision) & np.append(falling[1:] < falling[:-1], len(y) > 0)[: len(y)])
    return max(least, float(falling[ok[-1]])) if len(ok) else 1.1
