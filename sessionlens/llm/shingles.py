"""Word shingles of whole Arrow string columns, as 64-bit hashes computed in numpy.

Words are runs of ASCII letters and digits and of all characters beyond ASCII; A-Z are lower-cased. A text of fewer words than a
shingle has, but not none, is one shingle of all its words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_rng = np.random.default_rng(20240117)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_INSIDE = np.array([0x30 <= c <= 0x39 or 0x41 <= c <= 0x5A or 0x61 <= c <= 0x7A or c >= 0x80 for c in range(256)])
_R = np.uint64(0x9E3779B97F4A7C15 | 1)
_R_INVERSE = np.uint64(pow(int(_R), -1, 2**64))
_STEP = 1 << 16


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.empty(n, dtype=np.uint64)
    out[0] = 1
    filled = 1
    while filled < n:
        more = min(filled, n - filled)
        out[filled : filled + more] = out[:more] * np.uint64(pow(int(base), filled, 2**64))
        filled += more
    return out


_UP, _DOWN = _powers(_R, _STEP), _powers(_R_INVERSE, _STEP)


def _power(low: np.ndarray, base: np.uint64, at: np.ndarray) -> np.ndarray:
    """base ** at, low holding its first _STEP powers."""
    high = at >> 16
    table = _powers(np.uint64(pow(int(base), _STEP, 2**64)), int(high.max()) + 1) if len(at) else np.ones(1, dtype=np.uint64)
    return low[at & (_STEP - 1)] * table[high]


def mix(x: np.ndarray) -> np.ndarray:
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_spans(column: pa.Array, inside: np.ndarray = _INSIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, begins, ends, starts): where the words of a string column without nulls are, and where each row's words begin (one more than rows).

    inside says which bytes words have.
    """
    column = column.cast(pa.large_string())
    rows = len(column)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + rows + 1]
    if not rows or offsets[-1] == offsets[0]:
        none = np.empty(0, dtype=np.int64)
        return np.empty(0, dtype=np.uint8), none, none, np.zeros(rows + 1, dtype=np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    held = np.concatenate([[False], inside[data], [False]])
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[offsets] = True  # words end with their row
    begins = np.flatnonzero(held[1:-1] & (~held[:-2] | cut[:-1]))
    ends = np.flatnonzero(held[1:-1] & (~held[2:] | cut[1:])) + 1
    return data, begins, ends, np.searchsorted(begins, offsets)


def span_hashes(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of bytes, A-Z lower-cased."""
    n = len(data)
    prefix = np.zeros(n + 1, dtype=np.uint64)
    value = _BYTE[data]
    for a in range(0, n, _STEP):
        value[a : a + _STEP] *= _UP[: min(_STEP, n - a)]
    if n > _STEP:
        high = _powers(np.uint64(pow(int(_R), _STEP, 2**64)), n // _STEP + 1)
        for k in range(1, n // _STEP + 1):
            value[k * _STEP : (k + 1) * _STEP] *= high[k]
    np.cumsum(value, out=prefix[1:])
    return mix((prefix[ends] - prefix[begins]) * _power(_DOWN, _R_INVERSE, begins) + (ends - begins).astype(np.uint64))


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of a string column without nulls, and where each row's words begin (one more than rows)."""
    data, begins, ends, starts = word_spans(column)
    return span_hashes(data, begins, ends), starts


_ODD = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(column: pa.Array, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of all rows in order, repeats included, and where each row's begin."""
    hashes, starts = word_hashes(column)
    counts = np.diff(starts)
    sizes = np.where(counts == 0, 0, np.maximum(counts - n + 1, 1))
    out_starts = np.concatenate([[0], np.cumsum(sizes)])
    total = int(out_starts[-1])
    row = np.repeat(np.arange(len(counts)), sizes)
    first = np.arange(total) - out_starts[row] + starts[row]
    end = starts[row + 1]
    padded = np.concatenate([hashes, np.zeros(n, dtype=np.uint64)])
    value = np.zeros(total, dtype=np.uint64)
    for k in range(n):
        value += np.where(first + k < end, padded[first + k] * _ODD[k], np.uint64(0))
    return mix(value), out_starts


def distinct_by_row(values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each row, and the new starts."""
    row = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    values = values.copy()
    edges = starts.tolist()
    for a, b in zip(edges, edges[1:]):
        values[a:b].sort()
    first = np.ones(len(values), dtype=bool)
    first[1:] = (values[1:] != values[:-1]) | (row[1:] != row[:-1])
    values, row = values[first], row[first]
    return values, np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(starts) - 1))])
