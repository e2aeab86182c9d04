"""Full-text search in one block of a memory, in numpy: the best units of each question by BM25, and word edit distances."""

from __future__ import annotations

from decimal import ROUND_HALF_EVEN, Decimal

import numpy as np

#: Parameters of BM25 and of the candidates' search.
K1, B, CANDIDATES, TERMS = 1.2, 0.75, 80, 12
#: Sums that differ by less may be equal once they are rounded to nine places.
_NEAR = 1e-8
#: Pairs of texts whose distances are counted at once hold so many words at most, unless one pair alone holds more.
_AT_ONCE = 1 << 17


def mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """64-bit numbers scattered."""
    x = (x.astype(np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(32))


def starts_of(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges that begin at ``starts``, one range after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


def sums(values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sum of the values of each of n rows; ``rows`` rises."""
    out = np.zeros(n, values.dtype)
    if len(rows):
        begin = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
        out[rows[begin]] = np.add.reduceat(values, begin)
    return out


class Block:
    """Units in order of id, by the terms ``known``, which rise and stand in ``df`` units of the whole memory.

    Terms of more than ``common`` units are common. Units of one length that have the same common terms equally often make a
    shape: by these terms they score the same.
    """

    def __init__(self, terms: np.ndarray, sizes: np.ndarray, known: np.ndarray, df: np.ndarray, n_docs: int, avgdl: float, common: float):
        self.known, self.n = known, len(sizes)
        at = np.minimum(np.searchsorted(known, terms), max(0, len(known) - 1))
        hit = known[at] == terms if len(known) else np.zeros(len(terms), bool)
        code, tf = np.unique(np.repeat(np.arange(self.n), sizes)[hit] * max(1, len(known)) + at[hit], return_counts=True)
        doc, term = np.divmod(code, max(1, len(known)))
        idf = np.log((n_docs - df + 0.5) / (df + 0.5))
        part = np.where(idf <= 0, 1e-6, idf)[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes[doc] / avgdl))
        self.common = df > common
        often = self.common[term]
        self.rare = self._postings(term[~often], doc[~often], part[~often])
        doc, term, tf, part = doc[often], term[often], tf[often], part[often]
        mark = sums(mixed(mixed(term, 1) + tf.astype(np.uint64), 2), doc, self.n) + mixed(sizes, 3)
        _, first, self.shape = np.unique(mark, return_index=True, return_inverse=True)
        self.by_shape = np.argsort(self.shape, kind="stable")
        self.members = np.bincount(self.shape, minlength=len(first))
        self.shape_starts = starts_of(self.members)
        stands = np.zeros(self.n, bool)
        stands[first] = True
        own = stands[doc]
        self.shapes = self._postings(term[own], self.shape[doc[own]], part[own])
        self._rare_part = np.zeros(self.n)

    def _postings(self, term: np.ndarray, what: np.ndarray, part: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        order = np.argsort(term, kind="stable")
        cuts = np.searchsorted(term[order], np.arange(1, len(self.known)))
        return list(zip(np.split(what[order], cuts), np.split(part[order], cuts)))

    def _cut(self, docs: np.ndarray, values: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((docs, -np.round(values, 9)))[:limit]
        return docs[order], values[order]

    def _best_by_shape(self, s: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
        there = np.flatnonzero(s > 0)
        if len(there) > limit:
            v = s[there]
            there = there[v >= np.partition(v, len(v) - limit)[len(v) - limit] - _NEAR]
        there = there[np.argsort(-s[there], kind="stable")]
        taken = np.minimum(self.members[there], limit)
        k = int(np.searchsorted(np.cumsum(taken), limit))
        if k < len(there):
            enough = s[there] >= s[there[k]] - _NEAR
            there, taken = there[enough], taken[enough]
        return self._cut(self.by_shape[ranges(self.shape_starts[there], taken)], np.repeat(s[there], taken), limit)

    def best(self, terms: np.ndarray, sizes: np.ndarray, limit: int = CANDIDATES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(how many, units, scores), the best ``limit`` of each question of these terms (places in ``known``), larger is better, then by id.

        A unit that shares no rare term with a question scores what its shape does, so the best by shapes, found once for all
        questions of the same common terms, and the units that share a rare term hold the best.
        """
        n, begin = len(sizes), starts_of(sizes)
        rows = np.repeat(np.arange(n), sizes)
        often = self.common[terms]
        mark = sums(mixed(terms[often], 5), rows[often], n)
        found: list = [None] * n
        before, s, near = None, None, None
        for q in np.argsort(mark, kind="stable"):
            own = terms[begin[q] : begin[q + 1]]
            c = self.common[own]
            if before is None or mark[q] != before:
                before, s = mark[q], np.zeros(len(self.members))
                for t in np.sort(own[c]):
                    what, part = self.shapes[t]
                    s[what] += part
                near = self._best_by_shape(s, limit)
            lists = [self.rare[t] for t in np.sort(own[~c])]
            lists = [x for x in lists if len(x[0])]
            if not lists:
                found[q] = near
                continue
            for what, part in lists:
                self._rare_part[what] += part
            docs = np.concatenate([x[0] for x in lists]) if len(lists) > 1 else lists[0][0]
            others = self._rare_part[near[0]] == 0  # the rest of the best by shapes have their full score below
            values = self._rare_part[docs]
            self._rare_part[docs] = 0
            values = values + s[self.shape[docs]]
            if len(near[0]) >= limit:
                good = values >= near[1][-1] - _NEAR
                docs, values = docs[good], values[good]
            if not len(docs):
                found[q] = near
                continue
            docs, first = np.unique(docs, return_index=True)
            found[q] = self._cut(np.concatenate((docs, near[0][others])), np.concatenate((values[first], near[1][others])), limit)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        return np.array([len(x[0]) for x in found]), np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])


def word_bits(words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Two sets of 64 bits for each text: the bits of its words, by two hashes."""
    rows, begin = np.repeat(np.arange(len(sizes)), sizes), starts_of(sizes)[:-1][sizes > 0]
    out = np.zeros((2, len(sizes)), np.uint64)
    if len(rows):
        for k in range(2):
            out[k, sizes > 0] = np.bitwise_or.reduceat(np.uint64(1) << (mixed(words, 7 + k) & np.uint64(63)), begin)
    return out


def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many words at least one text of each pair has that the other lacks, by their bits."""
    return np.maximum.reduce([np.bitwise_count(a & ~b) for k in range(2) for a, b in ((x[k], y[k]), (y[k], x[k]))])


def distances(x: np.ndarray, x_at: np.ndarray, nx: np.ndarray, y: np.ndarray, y_at: np.ndarray, ny: np.ndarray) -> np.ndarray:
    """Word edit distance of each pair of texts, given where their words begin in ``x`` and ``y`` and how many they are."""
    out = np.zeros(len(nx), np.int32)
    order = np.lexsort((ny, nx))
    begin = 0
    while begin < len(order):
        n = int(nx[order[begin]])
        end = min(int(np.searchsorted(nx[order], n, side="right")), begin + max(1, _AT_ONCE // max(1, n)))
        at = order[begin:end]
        end = begin + max(1, int(np.searchsorted(ny[at] * np.arange(1, len(at) + 1), _AT_ONCE)))
        at = order[begin:end]
        m = int(ny[at[-1]])
        cols = np.minimum(y_at[at] + np.arange(m)[:, None], max(0, len(y) - 1))  # what lies beyond a text's end is not read off
        ys = y[cols] if m else np.zeros((0, len(at)), y.dtype)
        row = np.repeat(ramp := np.arange(m + 1, dtype=np.int32)[:, None], len(at), 1)
        for i in range(n):
            new = np.empty_like(row)
            new[0] = i + 1
            np.minimum(row[1:] + 1, row[:-1] + (ys != x[x_at[at] + i]), out=new[1:])
            if m < len(at):
                for j in range(1, m + 1):
                    np.minimum(new[j], new[j - 1] + 1, out=new[j])
                row = new
            else:
                row = np.minimum.accumulate(new - ramp, axis=0) + ramp
        out[at] = row[ny[at], np.arange(len(at))]
        begin = end
    return out


def four_places(d: np.ndarray, longest: np.ndarray) -> np.ndarray:
    """1 - d / longest in ten-thousandths, halves to even."""
    both, place = np.unique(d.astype(np.int64) << 32 | longest.astype(np.int64), return_inverse=True)
    each = [int((Decimal(repr(1 - (b >> 32) / (b & 0xFFFFFFFF))) * 10000).quantize(Decimal(1), ROUND_HALF_EVEN)) if b & 0xFFFFFFFF else 10000 for b in both.tolist()]
    return np.array(each, np.int32)[place] if len(each) else np.zeros(0, np.int32)
