"""Shapley values of tree models, for features that the tree's own training rows stand in for where they are unknown."""

from __future__ import annotations

import math

import numpy as np


class Leaves:
    """A tree as its leaves: of each the value, and of each feature on its path the steps taken and their share of rows.

    With some features known, a leaf counts with the product over its features of 1 or 0 (known, the row takes these
    steps or not) or of the share of rows that take them (unknown). Such a product's Shapley values have a closed form.
    """

    def __init__(self, tree) -> None:
        self.paths: list[tuple[float, list[int], list[list[tuple[int, bool]]], np.ndarray]] = []
        if not len(tree.feature):
            return
        if len(tree.node_count) != len(tree.feature) or len(tree.leaf_count) != len(tree.leaf):
            raise ValueError("the tree doesn't say how many rows each of its nodes holds")
        open_ = [(0, {})]
        while open_:
            node, before = open_.pop()
            for child, left in ((tree.left[node], True), (tree.right[node], False)):
                held = tree.leaf_count[~child] if child < 0 else tree.node_count[child]
                feature = int(tree.feature[node])
                steps, part = before.get(feature, ([], 1.0))
                path = before | {feature: ([*steps, (node, left)], part * float(held) / float(tree.node_count[node]))}
                if child >= 0:
                    open_.append((int(child), path))
                else:
                    self.paths.append((float(tree.leaf[~child]), list(path), [s for s, _ in path.values()], np.array([p for _, p in path.values()])))


def contributions(tree, x: np.ndarray) -> np.ndarray:
    """(rows, features) Shapley values of one tree; they add up to its prediction less its expected value."""
    out = np.zeros(x.shape)
    if not len(tree.feature):
        return out
    left = np.stack([tree.goes_left(np.full(len(x), node), x) for node in range(len(tree.feature))])
    for value, features, steps, part in tree.leaves.paths:
        n = len(features)
        taken = np.stack([np.logical_and.reduce([left[node] == to for node, to in of]) for of in steps]).astype(float)
        weights = [math.factorial(k) * math.factorial(n - k - 1) / math.factorial(n) for k in range(n)]
        for i, feature in enumerate(features):
            # Coefficients of the product of (unknown + known t) over the other features: sets by their size.
            sets = np.zeros((n, len(x)))
            sets[0] = 1.0
            for j in range(n):
                if j != i:
                    sets[1:] = sets[1:] * part[j] + sets[:-1] * taken[j]
                    sets[0] *= part[j]
            out[:, feature] += value * (taken[i] - part[i]) * (np.array(weights) @ sets)
    return out
