"""Words of many texts at once, as numpy arrays over the UTF-8 bytes of an Arrow column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose every output bit depends on every input bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(BASE))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: words between spaces; words of ASCII letters and bytes of other scripts
NOT_SPACE = ~_SPACE
LETTERS = np.zeros(256, bool)
LETTERS[65:91] = LETTERS[97:123] = LETTERS[128:] = True

_powers = [np.ones(1, _U), np.ones(1, _U)]


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        m = max(n, 1 << 16)
        for k, b in enumerate((BASE, INVERSE)):
            p = np.full(m, b, _U)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=_U)
    return _powers[0], _powers[1]


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and each row's first byte; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string()).fill_null("")
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return data, off - off[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about `most` bytes of text, so that the arrays below stay small; a text is never cut."""
    for b in batches:
        if not b.num_rows:
            continue
        _, off = utf8(b.column(column))
        i = 0
        while i < b.num_rows:
            j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
            yield b.slice(i, j - i)
            i = j


class Words:
    """Words of a column: `first` and `last` byte, `doc` row number, `hash` of the lower-cased (A-Z) word.

    `per_doc` has for each row the position of its first word; one entry more at the end.
    """

    def __init__(self, col: pa.Array, kind: np.ndarray = NOT_SPACE, prefixes: tuple[int, ...] = ()):
        data, off = utf8(col)
        n = len(data)
        self.rows = len(off) - 1
        if not n:
            self.first = self.last = self.doc = np.zeros(0, np.int64)
            self.hash, self.prefix = np.zeros(0, _U), [np.zeros(0, _U) for _ in prefixes]
            self.per_doc = np.zeros(self.rows + 1, np.int64)
            return
        inside = kind[data]
        before = np.empty(n, bool)
        before[0] = False
        before[1:] = inside[:-1]
        edges = off[1:-1]
        before[edges[edges < n]] = False
        self.first = np.flatnonzero(inside & ~before)
        after = np.empty(n, bool)
        after[-1] = False
        after[:-1] = inside[1:]
        after[edges[edges > 0] - 1] = False
        self.last = np.flatnonzero(inside & ~after) + 1
        self.per_doc = np.searchsorted(self.first, off)
        self.doc = np.repeat(np.arange(self.rows), np.diff(self.per_doc))
        power, inverse = _power_table(n + 1)
        total = np.empty(n + 1, _U)
        total[0] = 0
        np.cumsum(_BYTE[_LOWER[data]] * power[:n], out=total[1:])
        back, start = inverse[self.first], total[self.first]
        self.hash = mix((total[self.last] - start) * back)
        self.prefix = [mix((total[np.minimum(self.last, self.first + k)] - start) * back + _U(k)) for k in prefixes]


_MULTIPLIERS = mix(np.arange(101, 201, dtype=_U) * _U(BASE)) | _U(1)


def shingles(words: Words, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every run of `width` words; a row with fewer words has its whole sequence as one, with none no run."""
    n = np.diff(words.per_doc)
    h, start, stop = words.hash, words.per_doc[:-1], words.per_doc[1:]
    parts, rows = [], []
    if len(h) >= width:
        m = len(h) - width + 1
        s = np.zeros(m, _U)
        for k in range(width):
            s += h[k : k + m] * _MULTIPLIERS[k]
        same = words.doc[:m] == words.doc[width - 1 :]
        parts.append(mix(s[same]))
        rows.append(words.doc[:m][same])
    for i in np.flatnonzero((n > 0) & (n < width)):
        w = h[start[i] : stop[i]]
        parts.append(mix((w * _MULTIPLIERS[: len(w)]).sum(dtype=_U, keepdims=True) + _U(len(w))))
        rows.append(np.array([i]))
    if not parts:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    return np.concatenate(parts), np.concatenate(rows)


def distinct(values: np.ndarray, rows: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of every row in ascending order, one row after the other, and each row's first position (n_rows + 1)."""
    order = np.argsort(rows, kind="stable") if len(rows) and (np.diff(rows) < 0).any() else slice(None)
    values, cut = values[order], np.searchsorted(rows[order], np.arange(n_rows + 1))
    parts = []
    for i in range(n_rows):
        v = np.sort(values[cut[i] : cut[i + 1]])
        if len(v) > 1:
            keep = np.empty(len(v), bool)
            keep[0] = True
            np.not_equal(v[1:], v[:-1], out=keep[1:])
            v = v[keep]
        parts.append(v)
    first = np.zeros(n_rows + 1, np.int64)
    np.cumsum([len(v) for v in parts], out=first[1:])
    return (np.concatenate(parts) if parts else np.zeros(0, _U)), first
