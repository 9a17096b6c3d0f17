"""Binary trees grown level by level on gradient and Hessian histograms.

All trees of a block grow at once: one histogram per level and candidate feature holds every open
node of every tree. A forest is the case without regularisation: with weights w and labels y,
g = -w y and h = w make a leaf the weighted share of ones, and the gain half the weighted
decrease of the Gini impurity.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

BINS = 64  # bins per feature at most


@dataclass(frozen=True)
class Shape:
    """What limits a tree; the defaults limit nothing."""

    max_depth: int | None = None
    candidates: int | None = None  # features tried per node; more if none of them parts the rows
    min_split: float = 2.0  # weight of a node that may be split
    min_leaf: float = 1.0  # weight (sum of h) on either side
    l1: float = 0.0
    l2: float = 0.0
    least_gain: float = -1e-9  # also splits that gain nothing, as long as they part the rows


@dataclass
class Block:
    """Nodes of some trees; the first ``trees`` nodes are their roots. A leaf has feature -1, the
    right child follows the left one."""

    trees: int
    feature: np.ndarray
    cut: np.ndarray  # rows with a bin up to this go left
    left: np.ndarray
    value: np.ndarray
    gains: np.ndarray = field(repr=False)  # (trees, features): gain added up

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        """Value of the leaf each row meets in each tree: (trees, rows)."""
        at = np.repeat(np.arange(self.trees, dtype=np.int32)[:, None], len(bins), axis=1)
        rows = np.arange(len(bins))[None, :]
        while True:
            feature = self.feature[at]
            inner = feature >= 0
            if not inner.any():
                return self.value[at]
            right = bins[rows, np.maximum(feature, 0)] > self.cut[at]
            at = np.where(inner, self.left[at] + right, at)


def bin_cuts(x: np.ndarray, bins: int = BINS) -> list[np.ndarray]:
    """Per feature the values up to which a bin reaches: all distinct values, or ones that part the rows about equally."""
    out = []
    for column in x.T:
        values = np.unique(column)
        if len(values) > bins:
            values = np.unique(np.quantile(column, np.arange(1, bins) / bins, method="lower"))
        else:
            values = values[:-1]
        out.append(values)
    return out


def to_bins(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(c, column, side="left") for c, column in zip(cuts, x.T)], axis=1).astype(np.uint8)


def _shrunk(g: np.ndarray, l1: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0.0) if l1 else g


def grow(bins: np.ndarray, rows: np.ndarray, trees: np.ndarray, g: np.ndarray, h: np.ndarray, count: int, shape: Shape, rng: np.random.Generator) -> Block:
    """``count`` trees; sample i is row ``rows[i]`` in tree ``trees[i]`` with ``g[i]`` and ``h[i]`` > 0.

    A node tries features in an order of its own and stops after ``candidates`` of them once it has
    a split. The first greatest gain wins, of equal ones the lower cut.
    """
    width, n_features = int(bins.max(initial=0)) + 1, bins.shape[1]
    tried = min(shape.candidates or n_features, n_features)
    gains = np.zeros((count, n_features))
    parts: list[tuple[np.ndarray, ...]] = []
    at, owner, offset, level = trees.astype(np.int64), np.arange(count), 0, 0
    score = lambda gs, hs: _shrunk(gs, shape.l1) ** 2 / (hs + shape.l2)
    while True:
        size = len(owner)
        total_g, total_h = np.bincount(at, g, size), np.bincount(at, h, size)
        mixed = (total_g != 0) & (total_g != -total_h) if shape.l2 == 0 else np.ones(size, bool)
        open_ = (total_h >= shape.min_split) & mixed & (shape.max_depth is None or level < shape.max_depth) & (width > 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            value = np.where(total_h + shape.l2 > 0, -_shrunk(total_g, shape.l1) / (total_h + shape.l2), 0.0)
            own = np.where(total_h + shape.l2 > 0, score(total_g, total_h), 0.0)
        best, feature, cut = np.full(size, -np.inf), np.full(size, -1, np.int32), np.zeros(size, np.int32)
        order = rng.random((size, n_features)).argsort(axis=1) if tried < n_features else np.broadcast_to(np.arange(n_features), (size, n_features))
        for turn in range(n_features):
            asked = open_ & ((feature < 0) | (turn < tried))
            nodes = np.nonzero(asked)[0]
            if not len(nodes):
                break
            here = np.nonzero(asked[at])[0]
            node = at[here]
            code = (np.cumsum(asked) - 1)[node] * width + bins[rows[here], order[node, turn]]
            left_g, left_h = (np.bincount(code, v[here], len(nodes) * width).reshape(-1, width).cumsum(axis=1)[:, :-1] for v in (g, h))
            right_g, right_h = total_g[nodes, None] - left_g, total_h[nodes, None] - left_h
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = score(left_g, left_h) + score(right_g, right_h) - own[nodes, None]
            gain[(left_h < shape.min_leaf - 1e-9) | (right_h < shape.min_leaf - 1e-9)] = -np.inf
            top = (gain >= gain.max(axis=1, keepdims=True) - 1e-9).argmax(axis=1)  # gains that differ by rounding are equal
            gain = gain[np.arange(len(nodes)), top]
            better = (gain > best[nodes] + 1e-9) & (gain >= shape.least_gain)
            won = nodes[better]
            best[won], cut[won], feature[won] = gain[better], top[better], order[won, turn]
        split = feature >= 0
        left = np.where(split, offset + size + 2 * (np.cumsum(split) - 1), 0)
        parts.append((feature, cut, left, value))
        if not split.any():
            columns = [np.concatenate(c) for c in zip(*parts)]
            return Block(count, columns[0].astype(np.int16), columns[1].astype(np.uint8), columns[2].astype(np.int32), columns[3], gains)
        np.add.at(gains, (owner[split], feature[split]), best[split])
        stays = split[at]
        rows, g, h, at = rows[stays], g[stays], h[stays], at[stays]
        goes_right = bins[rows, feature[at]] > cut[at]
        at = left[at] - offset - size + goes_right
        owner, offset, level = np.repeat(owner[split], 2), offset + size, level + 1


def grow_forest(bins: np.ndarray, y: np.ndarray, count: int, shape: Shape, seeds: tuple[int, ...], bootstrap: bool = True) -> Block:
    """``count`` trees, each on a draw of its own with replacement (or all rows)."""
    n, rng = len(y), np.random.default_rng(seeds)
    if bootstrap:
        drawn = rng.integers(0, n, (count, n)) + np.arange(count)[:, None] * n
        weight = np.bincount(drawn.ravel(), minlength=count * n)
    else:
        weight = np.ones(count * n, np.int64)
    kept = np.nonzero(weight)[0]
    rows, w = kept % n, weight[kept].astype(float)
    return grow(bins, rows, kept // n, -w * y[rows], w, count, shape, rng)


def grow_boosted(
    bins: np.ndarray, y: np.ndarray, rounds: int, rate: float, shape: Shape, seeds: tuple[int, ...], subsample: float = 1.0, columns: float = 1.0
) -> list[Block]:
    """One tree a round on the gradients of the logistic loss; leaves are scaled by ``rate``.

    A round sees each row with chance ``subsample`` and a share ``columns`` of the features.
    """
    n, width, rng = len(y), bins.shape[1], np.random.default_rng(seeds)
    margin, out = np.zeros(n), []
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-margin))
        rows = np.nonzero(rng.random(n) < subsample)[0] if subsample < 1 else np.arange(n)
        chosen = np.sort(rng.permutation(width)[: max(1, int(columns * width))])
        part = bins[:, chosen]
        tree = grow(part, rows, np.zeros(len(rows), np.int64), (p - y)[rows], (p * (1 - p))[rows], 1, shape, rng)
        margin += rate * tree.leaves(part)[0]
        gains = np.zeros((1, width))
        gains[:, chosen] = tree.gains
        out.append(Block(1, np.where(tree.feature >= 0, chosen[np.maximum(tree.feature, 0)], -1).astype(np.int16), tree.cut, tree.left, rate * tree.value, gains))
    return out
