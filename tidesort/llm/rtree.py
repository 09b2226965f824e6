"""A packed R-tree over count vectors, searched by the summed minima of coordinates."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

FAN = 16


@dataclass(frozen=True)
class Level:
    """Nodes of one level: both corners of what they hold, its least and largest size, the first child of each."""

    low: np.ndarray
    high: np.ndarray
    n_low: np.ndarray
    n_high: np.ndarray
    first: np.ndarray
    below: int  # children in all


def packed(points: np.ndarray, sizes: np.ndarray, fan: int = FAN) -> np.ndarray:
    """An order that puts like points together: slabs by size, tiles in them by the two most spread coordinates."""
    m = len(points)
    if m <= fan:
        return np.arange(m)
    spread = np.argsort(-points.var(axis=0), kind="stable")[:2]
    cuts = max(1, round((m / fan) ** (1 / 3)))
    tile, order, parts = np.zeros(m, np.int64), np.arange(m), 1
    for by in (sizes, *(points[:, d] for d in spread)):
        order = np.lexsort((by, tile))
        parts *= cuts
        tile[order] = np.arange(m) * parts // m
    return order


class CountTree:
    """Points in packed order and, above them, levels of nodes of ``FAN`` children, the leaves first.

    Two sets can share no more than the summed minima of their counts, and no more than the one's size less what the
    other surely lacks.  Both hold for a node through its corners.  A pair links when ``per * shared >= least * union``.
    """

    def __init__(self, points: np.ndarray, sizes: np.ndarray, least: int, per: int):
        self.order = packed(points, sizes)
        self.points, self.sizes, self.least, self.per = points[self.order], sizes[self.order], least, per
        self.levels: list[Level] = []
        low, high, n_low, n_high = self.points, self.points, self.sizes, self.sizes
        while True:
            first = np.arange(0, len(n_low), FAN)
            level = Level(np.minimum.reduceat(low, first), np.maximum.reduceat(high, first), np.minimum.reduceat(n_low, first), np.maximum.reduceat(n_high, first), first, len(n_low))
            self.levels.append(level)
            if len(first) == 1:
                break
            low, high, n_low, n_high = level.low, level.high, level.n_low, level.n_high
        self.label(np.arange(len(sizes)))

    def label(self, labels: np.ndarray) -> None:
        """Labels of the points, in packed order; nodes know the least and the largest below them."""
        self.labels, self.spans = labels, []
        a = b = labels
        for level in self.levels:
            a, b = np.minimum.reduceat(a, level.first), np.maximum.reduceat(b, level.first)
            self.spans.append((a, b))

    def near(self, point: np.ndarray, size: int, label: int) -> np.ndarray:
        """Places (in packed order) of the points of other labels whose bound allows a link."""
        both = self.per + self.least
        at = np.zeros(1, np.int64)
        for level, (a, b) in zip(reversed(self.levels), reversed(self.spans), strict=True):
            at = at[(a[at] != label) | (b[at] != label)]
            n_low, n_high = level.n_low[at], level.n_high[at]
            at = at[(self.per * n_high >= self.least * size) & (self.per * size >= self.least * n_low)]
            shared = np.minimum(level.high[at], point).sum(axis=1)
            at = at[both * shared >= self.least * (size + level.n_low[at])]
            lacks = np.maximum(level.low[at] - point, 0).sum(axis=1)
            at = at[self.per * level.n_high[at] >= self.least * size + both * lacks]
            if not len(at):
                return at
            at = (level.first[at][:, None] + np.arange(FAN)).ravel()
            at = at[at < level.below]
        at = at[self.labels[at] != label]
        shared = np.minimum(self.points[at], point).sum(axis=1)
        return at[both * shared >= self.least * (size + self.sizes[at])]
