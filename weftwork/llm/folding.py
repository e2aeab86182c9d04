"""Skip-and-fold lookup over code points, and rolling polynomial hashes of what it leaves.

A code point that is no letter or digit is skipped; any other folds to its case-folded form. Texts go through the
table as the UTF-8 bytes of their Arrow buffer, whole batches at once; no canonical string is ever built.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

_TOP = 0x110000
_ONE = np.uint64(1)


def fold_char(ch: str) -> str:
    """What a character leaves: '' if it is skipped, else its case-folded letters and digits."""
    return "".join(x for x in ch.casefold() if x.isalnum()) if ch.isalnum() else ""


@lru_cache(1)
def fold_table() -> tuple[np.ndarray, dict[int, list[int]]]:
    """The table (0: skip), and the code points that fold to more than one."""
    table, many = np.zeros(_TOP, np.uint32), {}
    for cp in range(0x33480):
        if 0xD800 <= cp < 0xE000:
            continue
        f = fold_char(chr(cp))
        if f:
            table[cp] = ord(f[0])
            if len(f) > 1:
                many[cp] = [ord(x) for x in f]
    return table, many


def _mix(x: np.ndarray) -> np.ndarray:
    """splitmix64."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASES = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))
_SALTS = (np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    p = np.full(n + 1, base, np.uint64)
    p[0] = _ONE
    return np.cumprod(p, dtype=np.uint64)


def code_points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All code points of a string column, and where each row starts in them (one entry more than rows)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and n else np.zeros(0, np.uint8)
    lead = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=lead[1:])
    cps = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    return cps, lead[offsets - offsets[0]]


def folded_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two 64-bit polynomial hashes of each row's folded text, and its folded length. Null counts as ''."""
    table, many = fold_table()
    cps, starts = code_points(column)
    folded = table[cps]
    rare = np.flatnonzero(np.isin(cps, list(many))) if many and len(cps) and int(cps.max()) > 127 else []
    if len(rare):
        times = np.ones(len(cps), np.int64)
        times[rare] = [len(many[int(c)]) for c in cps[rare]]
        at = np.concatenate([[0], np.cumsum(times)])
        folded, starts = np.repeat(folded, times), at[starts]
        for i in rare:
            folded[at[i] : at[i + 1]] = many[int(cps[i])]
    kept = np.flatnonzero(folded)
    symbols = folded[kept].astype(np.uint64)
    bounds = np.searchsorted(kept, starts)
    lengths = np.diff(bounds)
    place = np.arange(len(kept)) - np.repeat(bounds[:-1], lengths)
    out = []
    for base, salt in zip(_BASES, _SALTS):
        values = _mix(symbols ^ salt) * _powers(base, int(lengths.max(initial=0)))[place]
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
        out.append(_mix(total[bounds[1:]] - total[bounds[:-1]] + lengths.astype(np.uint64)))
    return out[0], out[1], lengths


def text_hash(values: list[str], salt: np.uint64) -> np.ndarray:
    """A 64-bit hash for each of some short strings, such as language codes."""
    import xxhash

    known = {v: xxhash.xxh64_intdigest(v, seed=int(salt) & 0xFFFF) for v in set(values)}
    return np.array([known[v] for v in values], np.uint64)


def pair_keys(lang_a: list[str], a: pa.Array, lang_b: list[str], b: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes of the unordered pair of (language, folded text) sides, and whether both sides have any content."""
    a1, a2, na = folded_hashes(a)
    b1, b2, nb = folded_hashes(b)
    x1, y1 = _mix(a1 ^ text_hash(lang_a, _SALTS[0])), _mix(b1 ^ text_hash(lang_b, _SALTS[0]))
    x2, y2 = _mix(a2 ^ text_hash(lang_a, _SALTS[1])), _mix(b2 ^ text_hash(lang_b, _SALTS[1]))
    swap = (x1 > y1) | ((x1 == y1) & (x2 > y2))
    x1, y1 = np.where(swap, y1, x1), np.where(swap, x1, y1)
    x2, y2 = np.where(swap, y2, x2), np.where(swap, x2, y2)
    k1, k2 = _mix(x1 * np.uint64(3) + _mix(y1)), _mix(x2 * np.uint64(5) + _mix(y2))
    return k1.view(np.int64), k2.view(np.int64), (na > 0) & (nb > 0)


@lru_cache(65536)
def _folded(ch: str) -> str:
    return fold_char(ch)


def same_folded(a: str, b: str) -> bool:
    """Two-pointer comparison of what two texts leave, skipping on either side as it goes."""
    if a == b:
        return True
    i, j, na, nb = 0, 0, len(a), len(b)
    x = y = ""
    while True:
        while not x and i < na:
            x, i = _folded(a[i]), i + 1
        while not y and j < nb:
            y, j = _folded(b[j]), j + 1
        if not x or not y:
            return not x and not y
        if x[0] != y[0]:
            return False
        x, y = x[1:], y[1:]
