"""Distances in a hierarchy that every task holds: both ends of a pair climb, and descend where that meets fewer ids."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

#: Pairs searched at once, and ids met for them beyond which they are searched in halves.
PAIRS, MET = 512, 4_000_000


class Steps(NamedTuple):
    """The steps of one direction: those of node ``i`` lead to ``to[start[i]:start[i + 1]]``."""

    start: np.ndarray
    to: np.ndarray


class Hierarchy(NamedTuple):
    """Nodes 0 to ``n - 1``, numbered in any way, without loops and repeated edges."""

    n: int
    up: Steps
    down: Steps


def _steps(n: int, a: np.ndarray, b: np.ndarray) -> Steps:
    start = np.zeros(n + 1, np.int64)
    np.cumsum(np.bincount(a, minlength=n), out=start[1:])
    return Steps(start, b[np.argsort(a, kind="stable")].astype(np.int32))


def hierarchy(n: int, child: np.ndarray, parent: np.ndarray) -> Hierarchy:
    return Hierarchy(n, _steps(n, child, parent), _steps(n, parent, child))


def _fan(s: Steps, node: np.ndarray) -> np.ndarray:
    return s.start[node + 1] - s.start[node]


def _step(n: int, s: Steps, keys: np.ndarray) -> np.ndarray:
    """Where ``keys`` (pair * n + node) lead to, each once, in order."""
    pair, node = np.divmod(keys, n)
    fan = _fan(s, node)
    at = np.repeat(s.start[node] - np.cumsum(fan) + fan, fan) + np.arange(fan.sum())
    return np.unique(np.repeat(pair * n, fan) + s.to[at])


def _find(known: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where ``keys`` would stand in the ordered ``known``, and whether they do."""
    if not len(known):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return at, known[at] == keys


def _merge(keys: np.ndarray, steps: np.ndarray, new: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    both = np.concatenate([keys, new])
    order = np.argsort(both, kind="stable")
    return both[order], np.concatenate([steps, np.full(len(new), k, np.int32)])[order]


class _Side:
    """The ancestors of one end of all pairs: ordered keys, their fewest steps, and those met last."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys, self.steps, self.last = keys, np.zeros(len(keys), np.int32), keys

    def climb(self, h: Hierarchy, k: int) -> None:
        new = _step(h.n, h.up, self.last)
        self.last = new[~_find(self.keys, new)[1]]
        self.keys, self.steps = _merge(self.keys, self.steps, self.last, k)

    def only(self, n: int, stay: np.ndarray) -> None:
        keep = stay[self.keys // n]
        self.keys, self.steps, self.last = self.keys[keep], self.steps[keep], self.last[stay[self.last // n]]


def _lower(best: np.ndarray, n: int, side: _Side, keys: np.ndarray, steps: np.ndarray | int) -> None:
    at, hit = _find(side.keys, keys)
    np.minimum.at(best, keys[hit] // n, side.steps[at[hit]] + (steps if np.isscalar(steps) else steps[hit]))


def _descend(h: Hierarchy, own: _Side, other: _Side, best: np.ndarray, depth: np.ndarray, left: np.ndarray) -> None:
    """Lower ``best`` by the ways that end ``own`` climbs, then descends, to an ancestor of ``other``, up to ``depth`` steps.

    A pair whose steps would take more than its part of ``left`` is given up: its part is negative then.
    """
    n = h.n
    seen, front, k = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    while True:
        source = np.union1d(front, own.keys[own.steps == k])
        k += 1
        source = source[(depth[source // n] >= k) & (left[source // n] >= 0)]
        if not len(source):
            if not (depth >= k).any() or k > own.steps.max(initial=0):
                return
            front = source
            continue
        left -= np.bincount(source // n, _fan(h.down, source % n), len(left)).astype(np.int64)
        new = _step(n, h.down, source[left[source // n] >= 0])
        at, known = _find(own.keys, new)
        new = new[~(known & (own.steps[at] <= k))]
        new = new[~_find(seen, new)[1]]
        _lower(best, n, other, new, k)
        seen, front = np.union1d(seen, new), new


def distances(h: Hierarchy, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Fewest steps from each ``a`` up to a common ancestor and down to its ``b``; -1 where there is none.

    Both ends climb a step a round. Once they have met at ``d``, after ``k`` rounds, a shorter way has more than ``k``
    steps on one side and fewer than ``d - 1 - k`` on the other. Such ways are searched from the side of the few steps,
    whose ancestors are descended from until they meet the other side's, as long as that takes no more than twice the
    ids that the pair has met by climbing; otherwise the pair climbs on and tries again when these have doubled. All
    ways are exact; ids met for one pair are at most those of the hierarchy, and pairs are searched in halves where
    many together meet more than MET.
    """
    out = np.full(len(a), -1, np.int64)
    for at in range(0, len(a), PAIRS):
        _search(h, a[at : at + PAIRS], b[at : at + PAIRS], out[at : at + PAIRS])
    return out


def _search(h: Hierarchy, a: np.ndarray, b: np.ndarray, out: np.ndarray) -> None:
    n, m = h.n, len(a)
    far = np.iinfo(np.int32).max
    best = np.full(m, far, np.int64)
    best[a == b] = 0
    pair = np.arange(m, dtype=np.int64) * n
    left, right = _Side(pair + a), _Side(pair + b)
    open_, tried, k = best > 0, np.zeros(m, np.int64), 0
    left.only(n, open_)
    right.only(n, open_)
    while open_.any():
        k += 1
        left.climb(h, k)
        if m > 1 and len(left.keys) + len(right.keys) > MET:
            half = m // 2
            _search(h, a[:half], b[:half], out[:half])
            _search(h, a[half:], b[half:], out[half:])
            return
        _lower(best, n, right, left.last, k)
        right.climb(h, k)
        _lower(best, n, left, right.last, k)
        on = np.zeros((2, m), bool)
        for row, side in zip(on, (left, right), strict=True):
            row[side.last // n] = True
        open_ &= (best > k + 1) & on.any(axis=0)
        met = np.bincount(left.keys // n, minlength=m) + np.bincount(right.keys // n, minlength=m)
        depth = np.where(open_ & (best - 1 <= 2 * k + 1) & (met >= 2 * tried), best - 1 - k, 0)
        if (depth > 0).any():
            tried = np.where(depth > 0, met, tried)
            budget = 2 * met + 64
            _descend(h, right, left, best, np.where(on[0], depth, 0), budget)
            _descend(h, left, right, best, np.where(on[1], depth, 0), budget)
            open_ &= ~((depth > 0) & (budget >= 0))
        left.only(n, open_)
        right.only(n, open_)
    out[:] = np.where(best == far, -1, best)
