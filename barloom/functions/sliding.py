"""Ranks and quantiles of sliding windows: an order-statistic structure that rows enter
and leave at a cost that hardly grows with the window."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import numpy as np

#: Values in a run at most.
RUN = 256


class Sorted:
    """Values in order, in runs of up to RUN: a value's run is found by bisection on the
    runs' last values, its place by bisection in the run and the counts of those before."""

    def __init__(self):
        self.runs: list[list[float]] = []
        self.last: list[float] = []
        self.n = 0

    def add(self, x: float) -> None:
        self.n += 1
        if not self.runs:
            self.runs, self.last = [[x]], [x]
            return
        k = min(bisect_left(self.last, x), len(self.runs) - 1)
        run = self.runs[k]
        insort(run, x)
        if len(run) > RUN:
            half = len(run) // 2
            self.runs[k : k + 1] = [run[:half], run[half:]]
            self.last[k : k + 1] = [run[half - 1], run[-1]]
        else:
            self.last[k] = run[-1]

    def remove(self, x: float) -> None:
        k = bisect_left(self.last, x)
        run = self.runs[k]
        del run[bisect_left(run, x)]
        self.n -= 1
        if run:
            self.last[k] = run[-1]
        else:
            del self.runs[k], self.last[k]

    def below(self, x: float, equal: bool = False) -> int:
        """How many values are below x, or with ``equal`` at most x."""
        k = bisect_right(self.last, x) if equal else bisect_left(self.last, x)
        n = sum(map(len, self.runs[:k]))
        return n + ((bisect_right if equal else bisect_left)(self.runs[k], x) if k < len(self.runs) else 0)

    def at(self, place: int) -> float:
        for run in self.runs:
            if place < len(run):
                return run[place]
            place -= len(run)
        raise IndexError(place)


def _slide(x: np.ndarray, n: int, value) -> np.ndarray:
    """``value(window, x)`` for the last ``n`` entries at each; NaN entries are no values."""
    held, out = Sorted(), np.full(len(x), np.nan)
    for i, v in enumerate(x.tolist()):
        if i >= n and x[i - n] == x[i - n]:
            held.remove(float(x[i - n]))
        if v == v:
            held.add(v)
        if held.n:
            out[i] = value(held, v)
    return out


def quantile(x: np.ndarray, n: int, q: float) -> np.ndarray:
    """Of the last n entries, between neighbours in proportion."""

    def value(held: Sorted, v: float) -> float:
        at = (held.n - 1) * q
        low = int(at)
        a = held.at(low)
        return a if at == low else a + (held.at(low + 1) - a) * (at - low)

    return _slide(x, n, value)


def rank(x: np.ndarray, n: int) -> np.ndarray:
    """Share of the last n entries' values at or below the entry, ties as their mean
    rank; NaN where the entry is none."""
    return _slide(x, n, lambda held, v: (held.below(v) + (held.below(v, True) - held.below(v) + 1) / 2) / held.n if v == v else np.nan)
