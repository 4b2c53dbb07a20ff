"""Words of Arrow text columns as numpy arrays, without a Python object per word.

A word is a run of bytes other than space and ``\\t \\n \\v \\f \\r``.  Words and runs of words
get 64-bit polynomial fingerprints from running sums, so every window of a text costs a few
vector operations, whatever its length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Texts are worked on in slices of about this many bytes; a longer text is a slice of its own.
SLICE_BYTES = 1 << 21

_rng = np.random.default_rng(20240901)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=U64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32
#: Lower case, with ASCII punctuation as space.
_PLAIN = _LOWER.copy()
for _c in range(128):
    if not chr(_c).isalnum():
        _PLAIN[_c] = 0x20
_BYTE_BASE, _WORD_BASE = 0x9E3779B97F4A7C17 | 3, 0xD6E8FEB86659FD93 | 3


class _Powers:
    """Powers of an odd base and of its inverse modulo 2^64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse, self.up, self.down = base, pow(base, -1, 1 << 64), np.ones(1, U64), np.ones(1, U64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            for name, base in (("up", self.base), ("down", self.inverse)):
                steps = np.full(size, base, U64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=U64))
        return self.up[:n], self.down[:n]


_byte_powers, _word_powers = _Powers(_BYTE_BASE), _Powers(_WORD_BASE)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finalizer: all output bits depend on all input bits."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _running(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = _word_powers(len(code) + 1)
    sums = np.zeros(len(code) + 1, U64)
    np.cumsum(code * up[: len(code)], out=sums[1:])
    return sums, down


def _of_runs(sums: np.ndarray, down: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    run = (sums[end] - sums[begin]) * down[begin]
    return mix(run + (end - begin).astype(U64) * U64(0xA24BAED4963EE407))


def spans(code: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Fingerprints of the runs [begin, end) of 64-bit codes."""
    return _of_runs(*_running(code), begin, end)


@dataclass
class Words:
    """Words of some texts: byte ranges in ``data``, fingerprints, and the first word of each text."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    code: np.ndarray

    def __post_init__(self):
        self._sums, self._down = _running(self.code)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def text(self) -> np.ndarray:
        """For each word, the number of its text."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def spans(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Fingerprints of the word runs [begin, end)."""
        return _of_runs(self._sums, self._down, begin, end)

    def windows(self, size: int) -> np.ndarray:
        """Starts of all windows of ``size`` words within one text."""
        n = len(self.code)
        if n < size:
            return np.zeros(0, np.int64)
        at = np.arange(n - size + 1)
        left = np.repeat(self.first[1:], self.counts)[: len(at)] - at
        return at[left >= size]

    def word_bytes(self, i: int) -> bytes:
        return self.data[self.starts[i]:self.ends[i]].tobytes()


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes of text."""
    return ranges(sizes_of(column), limit)


def sizes_of(column: pa.Array) -> np.ndarray:
    """Bytes of each text; a null has none."""
    return np.asarray(pc.fill_null(pc.binary_length(column), 0))


def ranges(sizes: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of about ``limit`` in sum, of one at least."""
    ends = np.cumsum(sizes)
    a = 0
    while a < len(sizes):
        base = ends[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield a, b
        a = b


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts one after the other, and the offsets; a null is an empty text."""
    column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, places, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(places, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def words_of(column: pa.Array, fold: str = "none") -> Words:
    """Words of a text column.

    ``fold``: ``none``; ``lower`` folds A-Z; ``plain`` also takes ASCII punctuation as space.
    """
    raw, offsets = text_bytes(column)
    if fold != "none":
        raw = (_LOWER if fold == "lower" else _PLAIN)[raw]
    n = len(raw)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = ~_SPACE[raw]
    opens, closes = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    edges = offsets[(offsets > 0) & (offsets < n)]
    opens[edges] = inside[1:-1][edges]
    closes[edges - 1] = inside[1:-1][edges - 1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    up, down = _byte_powers(n + 1)
    sums = np.zeros(n + 1, U64)
    np.cumsum(_BYTE[raw] * up[:n], out=sums[1:])
    code = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64)) if len(starts) else np.zeros(0, U64)
    return Words(raw, starts, ends, np.searchsorted(starts, offsets), code)


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as a Spark long."""
    return x.view(np.int64)
