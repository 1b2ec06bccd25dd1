"""Vectorised word scanning and rolling hashes over Arrow text columns.

Every text operator of this subpackage reads its rows as Arrow batches and
works on the UTF-8 bytes of many documents at once.  A chunk is a run of whole
documents of about ``CHUNK_BYTES`` bytes (one longer document is a chunk of its
own), so memory stays bounded whatever the batch size is.  Null texts count as
empty ones.
"""

from __future__ import annotations

import ctypes
import functools
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
#: Bytes that are hashed at a time: what is held besides the text is a few times this, however long it is.
SEGMENT_BYTES = 1 << 17

U64 = np.uint64
_MULT = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def _splitmix(x: int) -> int:
    x = (x + _MULT) & _MASK
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _MASK
    return x ^ (x >> 31)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, so that all bits of a hash are usable."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class _Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base | 1, pow(base | 1, -1, 1 << 64)
        self.up = self.down = np.ones(1, U64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            for name, b in (("up", self.base), ("down", self.inverse)):
                a = np.full(size, b, U64)
                a[0] = 1
                setattr(self, name, np.cumprod(a, dtype=U64))
        return self.up[:n], self.down[:n]


_BYTE_POWERS, _WORD_POWERS, _OTHER_POWERS = _Powers(_splitmix(101)), _Powers(_splitmix(202)), _Powers(_splitmix(303))
_BYTES = np.array([_splitmix(1000 + b) for b in range(256)], U64)
_FOLDED = np.array([_splitmix(1000 + (b + 32 if 65 <= b <= 90 else b)) for b in range(256)], U64)
#: A-Z to a-z, all other bytes unchanged.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

#: Bytes of ``[^\x20\x09-\x0D]``: everything but ASCII white space.
NON_SPACE = np.array([not (b == 32 or 9 <= b <= 13) for b in range(256)])
#: Bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` after lower-casing A-Z.
ALNUM = np.array([48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])


def text_column(column: pa.Array) -> pa.Array:
    """The column with nulls as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if not pa.types.is_binary(column.type) else b"")
    return column


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without nulls; no copy is made."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) for runs of whole documents."""
    data, offsets = buffers(column)
    n, at = len(column), 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        lo, hi = offsets[at], offsets[end]
        yield at, end, data[lo:hi], offsets[at : end + 1] - lo
        at = end


def scan(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of each maximal run of bytes of ``kind``; runs end with their document."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    word = kind[data]
    first = np.zeros(n + 1, bool)
    first[offsets[:-1]] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, word[:-1]
    before[first[:n]] = False
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, word[1:]
    ends_doc = offsets[1:] - 1
    after[ends_doc[ends_doc >= 0]] = False
    starts, ends = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool) -> np.ndarray:
    """A 64-bit hash of each word's bytes (``fold``: after lower-casing A-Z), by segments of whole words."""
    out, table, at = np.empty(len(starts), U64), _FOLDED if fold else _BYTES, 0
    while at < len(starts):
        first = int(starts[at])
        to = max(at + 1, int(np.searchsorted(ends, first + SEGMENT_BYTES, "right")))
        last = int(ends[to - 1])
        up, down = _BYTE_POWERS.get(last - first)
        sums = np.zeros(last - first + 1, U64)
        np.cumsum(table[data[first:last]] * up, dtype=U64, out=sums[1:])
        a, b = starts[at:to] - first, ends[at:to] - first
        out[at:to] = mix((sums[b] - sums[a]) * down[a] + (b - a).astype(U64))
        at = to
    return out


def windows(hashes: np.ndarray, doc: np.ndarray, length: int, other: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Rabin-Karp hashes of all windows of ``length`` words of one document: (first word, hash); ``other`` gives independent ones."""
    m = len(hashes)
    if m < length:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    up, down = (_OTHER_POWERS if other else _WORD_POWERS).get(m)
    sums = np.zeros(m + 1, U64)
    np.cumsum(hashes * up, dtype=U64, out=sums[1:])
    at = np.flatnonzero(doc[: m - length + 1] == doc[length - 1 :])
    return at, mix((sums[at + length] - sums[at]) * down[at])


def covered(at: np.ndarray, length: int, m: int) -> np.ndarray:
    """Which of m words lie in a window that starts at one of ``at``."""
    steps = np.zeros(m + 1, np.int32)
    np.add.at(steps, at, 1)
    np.add.at(steps, at + length, -1)
    return np.cumsum(steps[:m]) > 0


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start .. start + length - 1 of each run, one after the other."""
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def give_back() -> None:
    """Returns this process's free memory to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(run: Callable) -> Callable:
    """A batch function that gives its worker's free memory back at the end of each task: workers live on, and the next task may need other memory."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def settled(run: Callable) -> Callable:
    """A group function that gives its worker's free memory back between groups, at most every ``SETTLE_S`` seconds."""

    @functools.wraps(run)
    def wrapped(group):
        out = run(group)
        now = time.monotonic()
        if now - _settled[0] >= SETTLE_S:
            give_back()
            _settled[0] = time.monotonic()
        return out

    return wrapped


SETTLE_S = 0.1
_settled = [0.0]
