"""Direct optimization: alignment of two dynamic characters into a parent, and implied alignments.

A dynamic character is a list of elements (median, left, right) of masks, or
None where it is missing. In an element of a parent, left and right are the
children's sites; one of them is 0 where that child has a gap, both are 0
where the parent itself has one.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

from cladespark.operators.tcm import DENSE_SYMBOLS, Tcm

Element = tuple[int, int, int]
Dynamic = list[Element] | None
DIAGONAL, LEFT, UP = 0, 1, 2
#: Different sets whose costs are tabulated for a run of pairs, and cells of a row of all of them.
MOST_SETS, RUN_CELLS = 512, 1_000_000


def encode(sites: Sequence[int] | None) -> Dynamic:
    """An observed sequence of masks as a leaf."""
    return None if sites is None else [(int(s),) * 3 for s in sites]


def context(e: Element) -> str:
    """Which sides have a site: alignment, insertion (left alone), deletion (right alone) or gap."""
    return ("alignment" if e[2] else "insertion") if e[1] else ("deletion" if e[2] else "gap")


def _between(a: int, b: int) -> tuple[int, int]:
    """Median and cost of two sets as ranges from their first to their last symbol: what they share, else the gap between them."""
    low = max((a & -a).bit_length(), (b & -b).bit_length()) - 1
    high = min(a.bit_length(), b.bit_length()) - 1
    cost = max(0, low - high)
    low, high = min(low, high), max(low, high)
    return (1 << high + 1) - (1 << low), cost


class Aligner:
    """Pairwise alignment under a cost matrix whose last symbol is the gap.

    The cost of two sites is that of their median. Least cost wins; among equal
    ones a diagonal step goes before one along the longer character and that
    before one along the shorter; a diagonal step whose median is the gap is
    taken as one along the longer. Both sides are put in order first, so the
    cost does not depend on their order.
    """

    def __init__(self, tcm: Tcm):
        self.tcm, self.gap = tcm, 1 << (tcm.n - 1)
        self.linear = tcm.is_additive()
        self.table = tcm.dense() if tcm.n <= DENSE_SYMBOLS and not self.linear else None
        self.number = np.int64 if tcm.n <= 63 else object  # wider sets are Python's numbers
        self.into: dict[int, np.ndarray] = {}
        self.known: dict[tuple[int, int], tuple[int, int]] = {}

    def median(self, a: int, b: int) -> tuple[int, int]:
        if self.table is not None:
            return int(self.table[0][a, b]), int(self.table[1][a, b])
        if (a, b) not in self.known:
            if self.linear and a and b:
                self.known[a, b] = _between(a, b)
                return self.known[a, b]
            total = self._into(a) + self._into(b)
            least = total.min()
            self.known[a, b] = sum(1 << i for i in np.flatnonzero(total == least).tolist()), int(least)
        return self.known[a, b]

    def _into(self, a: int) -> np.ndarray:
        """Least cost from each symbol into a set."""
        if a not in self.into:
            self.into[a] = self.tcm.array[:, [j for j in range(self.tcm.n) if a >> j & 1]].min(1)
        return self.into[a]

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.table is not None:
            return self.table[0][np.ix_(a, b)], self.table[1][np.ix_(a, b)]
        found = [[self.median(int(x), int(y)) for y in b] for x in a]
        return np.array([[m for m, _ in r] for r in found], self.number).reshape(len(a), len(b)), np.array([[c for _, c in r] for r in found], np.int64).reshape(len(a), len(b))

    def matrix(self, shorter: Sequence[int], longer: Sequence[int]) -> tuple[int, np.ndarray]:
        """Cost of the alignment and the direction of each cell. Rows are vectorised: a running minimum stands for the steps along a row."""
        a, b, gap = np.array(shorter, self.number), np.array(longer, self.number), np.array([self.gap], self.number)
        median, cost = self._pairs(a, b)
        along, down = self._pairs(gap, b)[1][0], self._pairs(a, gap)[1][:, 0]
        run = np.concatenate([[0], np.cumsum(along)])
        arrows = np.full((len(a) + 1, len(b) + 1), LEFT, np.int8)
        arrows[1:, 0] = UP
        before = run.copy()
        for i in range(len(a)):
            diagonal, up = before[:-1] + cost[i], before[1:] + down[i]
            start = np.concatenate([[before[0] + down[i]], np.minimum(diagonal, up)])
            row = np.minimum.accumulate(start - run) + run
            left = row[:-1] + along
            at = np.where(diagonal == row[1:], np.where(median[i] == self.gap, LEFT, DIAGONAL), np.where(left == row[1:], LEFT, UP))
            arrows[i + 1, 1:] = at
            before = row
        return int(before[-1]), arrows

    def trace(self, shorter: Sequence[int], longer: Sequence[int], arrows: np.ndarray) -> list[Element]:
        i, j, out = len(shorter), len(longer), []
        while i or j:
            step = arrows[i, j]
            if step == LEFT:
                j -= 1
                out.append((self.median(self.gap, longer[j])[0], 0, longer[j]))
            elif step == UP:
                i -= 1
                out.append((self.median(shorter[i], self.gap)[0], shorter[i], 0))
            else:
                i, j = i - 1, j - 1
                out.append((self.median(shorter[i], longer[j])[0], shorter[i], longer[j]))
        return out[::-1]

    def without_gaps(self, character: list[Element]) -> tuple[list[int], dict[int, int]]:
        """Medians that are not the gap, and how many gaps stand before each of them (or the end)."""
        kept: list[int] = []
        gaps: dict[int, int] = {}
        for m, _, _ in character:
            if m == self.gap:
                gaps[len(kept)] = gaps.get(len(kept), 0) + 1
            else:
                kept.append(m)
        return kept, gaps

    def with_gaps(self, aligned: list[Element], left_gaps: dict[int, int], right_gaps: dict[int, int]) -> list[Element]:
        """Gaps of the two sides put back: those of the left as insertions, then those of the right as deletions."""
        left, right, out = 0, 0, []
        due_left, due_right = dict(left_gaps), dict(right_gaps)

        def put() -> None:
            out.extend([(self.gap, self.gap, 0)] * due_left.pop(left, 0))
            out.extend([(self.gap, 0, self.gap)] * due_right.pop(right, 0))

        for e in aligned:
            put()
            out.append(e)
            left += e[1] != 0
            right += e[2] != 0
        put()
        return out

    def align(self, a: Dynamic, b: Dynamic) -> tuple[int, Dynamic]:
        """Cost and parent of two characters. A missing side costs nothing and gives the other.

        If a side has nothing but gaps, the cost is 0 and the other side is deleted as a whole.
        """
        if a is None or b is None:
            return 0, b if a is None else a
        x, gaps_x = self.without_gaps(a)
        y, gaps_y = self.without_gaps(b)
        swapped = (len(x), x) > (len(y), y)
        if swapped:
            x, y, gaps_x, gaps_y = y, x, gaps_y, gaps_x
        if not y:
            return 0, None
        if not x:
            cost, aligned = 0, [(self.median(v, self.gap)[0], 0, v) for v in y]
        else:
            cost, arrows = self.matrix(x, y)
            aligned = self.trace(x, y, arrows)
        aligned = self.with_gaps(aligned, gaps_x, gaps_y)
        return cost, [(m, r, l) for m, l, r in aligned] if swapped else aligned

    def cost(self, a: Sequence[int] | None, b: Sequence[int] | None) -> int:
        """Cost of two observed sequences."""
        return self.align(encode(a), encode(b))[0]

    def costs(self, left: Sequence[Sequence[int]], right: Sequence[Sequence[int]]) -> np.ndarray:
        """Cost of each left sequence with its right one; all pairs of a run go through the recurrence together."""
        left, right = ([[s for s in x if s != self.gap] for x in side] for side in (left, right))
        sets = sorted({s for side in (left, right) for x in side for s in x})
        if len(sets) > MOST_SETS:
            return np.array([self.cost(x, y) for x, y in zip(left, right, strict=True)], np.int64)
        place = {s: k for k, s in enumerate(sets)}
        table = np.zeros((len(sets) + 1, len(sets) + 1), np.int64)
        for s, k in place.items():
            table[k, -1] = table[-1, k] = self.median(s, self.gap)[1]
            table[k, : k + 1] = table[: k + 1, k] = [self.median(s, t)[1] for t in sets[: k + 1]]
        out = np.zeros(len(left), np.int64)
        longest = 1 + max([1, *map(len, right)])
        for at in range(0, len(left), step := max(1, RUN_CELLS // longest)):
            xs, ys = left[at : at + step], right[at : at + step]
            n, m = (np.array([len(x) for x in side]) for side in (xs, ys))
            a, b = np.zeros((len(xs), max(1, n.max())), np.int64), np.zeros((len(ys), max(1, m.max())), np.int64)
            for codes, side in ((a, xs), (b, ys)):
                for k, x in enumerate(side):
                    codes[k, : len(x)] = [place[s] for s in x]
            run = np.concatenate([np.zeros((len(xs), 1), np.int64), np.cumsum(table[-1, b], 1)], 1)
            before, found = run, np.zeros(len(xs), np.int64)
            for i in range(a.shape[1]):
                down = table[a[:, i], -1][:, None]
                start = before + down
                start[:, 1:] = np.minimum(start[:, 1:], before[:, :-1] + table[a[:, i, None], b])
                before = np.minimum.accumulate(start - run, 1) + run
                done = n == i + 1
                found[done] = before[done, m[done]]
            out[at : at + step] = np.where((n > 0) & (m > 0), found, 0)
        return out

    def disambiguated(self, character: Dynamic) -> Dynamic:
        """One symbol for each site: the first one of its median, so that a site with one symbol keeps it."""
        if character is None:
            return None
        return [(v, v, v) for v in (m & -m for m, _, _ in character)]

    def implied(self, is_left: bool, parent_final: Dynamic, parent_context: Dynamic, own_context: Dynamic) -> Dynamic:
        """The child's sites in the columns of the parent's implied alignment."""
        if own_context is None:
            return parent_final
        gap, out, own, above = (self.gap, 0, 0), [], 0, 0
        for e in parent_final or []:
            if own >= len(own_context):
                out.append(gap)
                continue
            kind = context(e)
            if kind == "gap":
                out.append(e)
                continue
            if above >= len(parent_context or []):
                raise ValueError("the parent's context ends before its alignment")
            here = context(parent_context[above])
            above += 1
            mine = kind == "alignment" or (kind == "deletion" and here == "deletion" and not is_left) or (kind == "insertion" and here == "insertion" and is_left)
            out.append(own_context[own] if mine else gap)
            own += mine
        return out


def affine_cost(aligner: Aligner, a: Sequence[int], b: Sequence[int], opening: int) -> int:
    """Least cost of two gapless sequences when each run of gaps costs `opening` besides its sites (Gotoh, 1982)."""
    x, y = np.array(a, np.int64), np.array(b, np.int64)
    if not len(x) or not len(y):
        return 0
    cost = aligner._pairs(x, y)[1]
    gap = np.array([aligner.gap])
    along, down = aligner._pairs(gap, y)[1][0], aligner._pairs(x, gap)[1][:, 0]
    run = np.concatenate([[0], np.cumsum(along)])
    far = np.int64(1) << 50
    # Ends in a match, in a gap of the first sequence, in one of the second.
    match = np.concatenate([[0], np.full(len(y), far)])
    across = np.concatenate([[far], run[1:] + opening])
    below = np.full(len(y) + 1, far)
    for i in range(len(x)):
        best = np.minimum(np.minimum(match, across), below)
        below = np.minimum(np.minimum(match, across) + opening, below) + down[i]
        match = np.concatenate([[far], best[:-1] + cost[i]])
        start = np.concatenate([[far], np.minimum(match, below)[:-1] + opening + along])
        # A gap goes on along the row: a running minimum over where it began.
        across = np.minimum.accumulate(np.minimum(start - run, far)) + run
    return int(min(match[-1], across[-1], below[-1]))


def three_way(aligner: Aligner, a: Sequence[int], b: Sequence[int], c: Sequence[int]) -> tuple[int, list[tuple[int, int, int, int]]]:
    """Least cost of three sequences and the columns (median, a, b, c); a column costs what its median does.

    The table has as many cells as the product of the lengths, so this is for short sequences.
    """
    if aligner.gap in (*a, *b, *c):
        raise ValueError("sequences without gaps are expected")
    gap, known = aligner.gap, {}

    def column(x: int, y: int, z: int) -> tuple[int, int]:
        if (x, y, z) not in known:
            known[x, y, z] = aligner.tcm.median(x, y, z)
        return known[x, y, z]

    steps = [(i, j, k) for i in (1, 0) for j in (1, 0) for k in (1, 0) if i or j or k]
    best: dict[tuple[int, int, int], tuple[int, tuple[int, int, int] | None]] = {(0, 0, 0): (0, None)}
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            for k in range(len(c) + 1):
                if not (i or j or k):
                    continue
                found = None
                for s in steps:
                    before = best.get((i - s[0], j - s[1], k - s[2]))
                    if before is None:
                        continue
                    total = before[0] + column(a[i - 1] if s[0] else gap, b[j - 1] if s[1] else gap, c[k - 1] if s[2] else gap)[1]
                    if found is None or total < found[0]:
                        found = total, s
                best[i, j, k] = found
    at, out = (len(a), len(b), len(c)), []
    while best[at][1] is not None:
        s = best[at][1]
        x, y, z = (q[p - 1] if d else gap for q, p, d in zip((a, b, c), at, s, strict=True))
        out.append((column(x, y, z)[0], x, y, z))
        at = tuple(p - d for p, d in zip(at, s, strict=True))
    return best[len(a), len(b), len(c)][0], out[::-1]
