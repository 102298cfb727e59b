"""Parsimony kernels as numpy operations over many characters at once.

A kernel has three steps: `leaf` makes states of observations, `merge` a parent
of two children, `finalize` a final state of an inner node. States are arrays
whose last axis is the characters, so a tree is walked once for all of them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from cladespark.operators.tcm import Tcm

INFINITE = np.int64(1) << 40


class Fitch:
    """Sets of states, one step for each change. `strict` finals use the parent's final set; else its preliminary one."""

    def __init__(self, strict: bool = False):
        self.strict = strict

    def merge(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        common = left & right
        return np.where(common != 0, common, left | right), (common == 0).astype(np.int64)

    def finalize(self, above: np.ndarray, own: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        third = (above | ((left | right) & own)) if self.strict else above
        return np.where((above & own) == above, above, np.where((left | right) == own, above | own, third))


class Interval:
    """Ranges (2, characters): additive and continuous characters."""

    def merge(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lo, hi = np.maximum(left[0], right[0]), np.minimum(left[1], right[1])
        # Where the ranges do not meet, the ends of the common part change places: it is the gap between them.
        return np.stack([np.minimum(lo, hi), np.maximum(lo, hi)]), np.where(lo > hi, lo - hi, 0)

    def finalize(self, above: np.ndarray, own: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        meet = lambda a, b: (b[0] <= a[1]) & (b[1] >= a[0])
        common = lambda a, b: np.stack([np.maximum(a[0], b[0]), np.minimum(a[1], b[1])])
        hull = lambda a, b: np.stack([np.minimum(a[0], b[0]), np.maximum(a[1], b[1])])
        closest = lambda a, b: np.where(a[1] < b[0], a[1], a[0])
        below = hull(left, right)
        chi = common(hull(below, own), above)
        near = closest(own, chi)
        reached = np.where(meet(chi, own), chi, np.stack([np.minimum(near, chi[1]), np.maximum(near, chi[0])]))
        mine, theirs = closest(own, above), closest(below, above)
        apart = np.stack([np.minimum(mine, theirs), np.maximum(mine, theirs)])
        shared = common(above, own)
        return np.where((shared == above).all(0), above, np.where(meet(below, above), reached, apart))


@dataclass
class Sankoff:
    """Least cost of each state (states, characters) under a cost matrix; a node's cost is the least of them."""

    tcm: Tcm

    def leaf(self, masks: np.ndarray) -> np.ndarray:
        bits = np.arange(self.tcm.n)[:, None]
        return np.where((masks[None] >> bits & 1).astype(bool), 0, INFINITE)

    def directed(self, child: np.ndarray) -> np.ndarray:
        """Least cost of the child's subtree for each state of the parent."""
        return np.minimum((self.tcm.array[:, :, None] + child[None]).min(1), INFINITE)

    def merge(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return np.minimum(self.directed(left) + self.directed(right), INFINITE)

    def arg_states(self, child: np.ndarray, parent: np.ndarray) -> np.ndarray:
        """States of a child (as flags) that are best for some of the parent's final states, ties kept."""
        total = self.tcm.array[:, :, None] + child[None]
        best = total == total.min(1, keepdims=True)
        return (best & parent[:, None, :]).any(0)

    def extra(self, costs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Costs above the node's least, and for each state the least cost to leave it for those."""
        above = costs - costs.min(0)
        return above, self.directed(above)


def flags_to_mask(flags: np.ndarray) -> np.ndarray:
    return (flags * (np.int64(1) << np.arange(len(flags)))[:, None]).sum(0)
