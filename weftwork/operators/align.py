"""Alignment of two documents: line by line where their lines agree in number, else by the lengths of their sentences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftwork.functions.text import paragraphs, split_plain_sentences

#: What each further sentence of a run costs, and what a run without characters does.
FURTHER, NOTHING = 0.4, 10.0
#: Diagonals between two that are kept, at least; those between are computed anew on the way back, where the path may lie.
KEPT = 512
#: Cells to either side of the straight line in which a first path is looked for, and diagonals between two looks at its bound.
NEAR, LOOKS = 256, 64
#: Cells without a cost to either side of a diagonal's own.
_PAD = 3

_Row = tuple[int, np.ndarray]


def _part(row: _Row, a: int, b: int) -> np.ndarray:
    """Costs of cells a to b - 1 of a diagonal, infinite where it has none."""
    lo, x = row
    if lo <= a and b <= lo + len(x):
        return x[a - lo : b - lo]
    out = np.full(b - a, np.inf)
    first, end = max(a, lo), min(b, lo + len(x))
    if first < end:
        out[first - a : end - a] = x[first - lo : end - lo]
    return out


class _Lattice:
    """Least costs of aligning the first i source with the first j target sentences, a diagonal i + j at a time.

    Runs are one to one, one to two and two to one, so i lies between a third and two thirds of a diagonal. All of a diagonal
    depends on the three before it only: its cells are computed together. Logarithms are taken once a sentence and once a pair of
    neighbours, not once a cell.
    """

    def __init__(self, source: list[int], target: list[int]):
        self.n, self.m = len(source), len(target)
        self.zeros = not all(source) or not all(target)
        (self.a1, self.a2), (b1, b2) = self._logs(source), self._logs(target)
        self.b1, self.b2 = b1[::-1].copy(), b2[::-1].copy()  # j falls where i rises

    @staticmethod
    def _logs(lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Logarithms of the i-th sentence's length and of its length with the one before, by i from 1."""
        whole = np.concatenate([[0], np.cumsum(lengths)]).astype(np.float64)
        one, two = np.full(len(whole), -np.inf), np.full(len(whole), -np.inf)
        with np.errstate(divide="ignore"):
            one[1:], two[2:] = np.log(whole[1:] - whole[:-1]), np.log(whole[2:] - whole[:-2])
        return one, two

    def _bounds(self, d: int) -> tuple[int, int]:
        return max(1, d - self.m, -(-d // 3)), min(self.n, d - 1, 2 * d // 3)

    def _cost(self, s: np.ndarray, t: np.ndarray, further: float, before: np.ndarray) -> np.ndarray:
        out = s - t
        np.abs(out, out=out)
        if further:
            out += further
        if self.zeros:
            out[~np.isfinite(out)] = NOTHING
        out += before
        return out

    def diagonal(self, d: int, lo: int, hi: int, two: _Row, three: _Row, by: bool = False) -> tuple[_Row, np.ndarray | None]:
        """Costs of cells ``lo`` to ``hi`` of diagonal ``d``, and the run that ends in each (1: two to one, 2: one to two, 3: one to one)."""
        if hi < lo:
            return (lo, np.empty(0)), np.empty(0, np.int8)
        i, j = slice(lo, hi + 1), slice(self.m - d + lo, self.m - d + hi + 1)
        out = np.full(hi - lo + 1 + 2 * _PAD, np.inf)
        best = out[_PAD:-_PAD]
        with np.errstate(invalid="ignore"):
            first = self._cost(self.a2[i], self.b1[j], FURTHER, _part(three, lo - 2, hi - 1))
            second = self._cost(self.a1[i], self.b2[j], FURTHER, _part(three, lo - 1, hi))
            third = self._cost(self.a1[i], self.b1[j], 0.0, _part(two, lo - 1, hi))
        code = None
        if by:  # of equal costs the first in this order counts
            code = np.ones(hi - lo + 1, np.int8)
            code[second < first] = 2
            code[third < np.minimum(first, second)] = 3
        np.minimum(first, second, out=best)
        np.minimum(best, third, out=best)
        return (lo - _PAD, out), code

    def _possible(self, row: _Row, d: int, most: float) -> tuple[int, int] | None:
        """The first and the last cell of a diagonal through which a path of a cost of ``most`` may go."""
        i = np.arange(row[0], row[0] + len(row[1]))
        good = np.flatnonzero(row[1] + FURTHER * np.abs(2 * i - d - (self.n - self.m)) <= most)
        return (row[0] + int(good[0]), row[0] + int(good[-1])) if len(good) else None

    def _forward(self, most: float, near: int | None, kept: dict[int, list[_Row]] | None, step: int) -> float:
        """The least cost of all. Cells further than ``near`` from the straight line are left out, if it is given, and such as
        no path of a cost of ``most`` goes through: a path on from there has a run of unequal sides for each step aside."""
        none: _Row = (0, np.empty(0))
        last: list[_Row] = [none, none, (0, np.zeros(1))]
        if kept is not None:
            kept[0] = last
        low, high = 0, self.n
        for d in range(1, self.n + self.m + 1):
            lo, hi = self._bounds(d)
            if near is not None:
                middle = d * self.n // (self.n + self.m)
                lo, hi = max(lo, middle - near), min(hi, middle + near)
            lo, high = max(lo, low), high + 1
            row, _ = self.diagonal(d, lo, min(hi, high), last[1], last[0])
            last = [last[1], last[2], row]
            if d % LOOKS == 0 and most < np.inf:
                ends = [self._possible(x, d - 2 + k, most) for k, x in enumerate(last)]  # every path has a cell on one of the three
                if any(ends):
                    low, high = min(e[0] for e in ends if e), max(e[1] for e in ends if e) + 2
            if kept is not None and d % step == 0:
                kept[d] = last
        return float(_part(last[2], self.n, self.n + 1)[0])

    def runs(self) -> list[tuple[int, int]] | None:
        """(source, target) sentences of each run of the best alignment, None if there is none."""
        whole = self.n + self.m
        first = self._forward(np.inf, NEAR + whole // 256, None, 0)
        step = max(KEPT, int((24 * whole) ** 0.5))
        kept: dict[int, list[_Row]] = {}
        if not np.isfinite(self._forward(first * (1 + 1e-9) + 1e-9, None, kept, step)):
            return None
        out, i, d, base = [], self.n, whole, whole + 1
        rows: dict[int, tuple[int, np.ndarray]] = {}
        while d:
            if d <= base or d not in rows:
                base, rows, top, at = (d - 1) // step * step, {}, d, i
                last = kept[base]
                for x in range(base + 1, top + 1):
                    lo, hi = self._bounds(x)
                    left = top - x  # a run takes one or two of three or of two: what leads to the cell lies in a cone
                    lo, hi = max(lo, at - (2 * left + 2) // 3), min(hi, at - left // 3)
                    row, code = self.diagonal(x, lo, hi, last[1], last[0], by=True)
                    rows[x] = (lo, code)
                    last = [last[1], last[2], row]
            lo, code = rows[d]
            di, dj = ((2, 1), (1, 2), (1, 1))[code[i - lo] - 1]
            out.append((di, dj))
            i, d = i - di, d - di - dj
        return out[::-1]


def beads(source: list[int], target: list[int]) -> list[tuple[int, int, int, int]]:
    """(start, end, start, end) of aligned runs, by the lengths of the sentences; the first of equals counts.

    Texts of which one has over twice as many sentences have no such runs: their sentences are paired as far as they go.
    """
    n, m = len(source), len(target)
    runs = _Lattice(source, target).runs() if n and m and max(n, m) <= 2 * min(n, m) else None
    out, i, j = [], 0, 0
    for di, dj in runs if runs is not None else [(1, 1)] * min(n, m):
        out.append((i, i + di, j, j + dj))
        i, j = i + di, j + dj
    return out


def _align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for x in batches:
        rows = []
        for key, s, t, ss, ts in zip(x.pair_id, x.s_text, x.t_text, x.s_sents, x.t_sents):
            a, b = ([y.strip() for y in (z or "").splitlines() if y.strip()] for z in (s, t))
            if len(a) > 1 and len(a) == len(b):
                found = list(zip(a, b))
            else:
                ss, ts = list(ss if ss is not None else []), list(ts if ts is not None else [])
                found = [(" ".join(ss[i:j]), " ".join(ts[k:l])) for i, j, k, l in beads([*map(len, ss)], [*map(len, ts)])] if ss and ts else []
            rows += [(key, n, u, v) for n, (u, v) in enumerate(found)]
        yield pd.DataFrame(rows, columns=["pair_id", "place", "source", "target"])


def aligned(documents: DataFrame) -> DataFrame:
    """(pair_id, place, source, target) from (pair_id, s_text, t_text): one document pair is one row's work."""
    sents = lambda c: F.flatten(F.transform(paragraphs(F.coalesce(c, F.lit(""))), split_plain_sentences))
    ready = documents.select("pair_id", "s_text", "t_text", sents(F.col("s_text")).alias("s_sents"), sents(F.col("t_text")).alias("t_sents"))
    return ready.mapInPandas(_align, "pair_id long, place int, source string, target string")
