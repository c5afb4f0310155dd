"""Words of many texts at once: bounds and 64-bit hashes by whole-array arithmetic.

Texts come as an Arrow column of bytes. They are cut into pieces of about a MB,
always between texts, so memory is bounded by the longest text; arrays over a
piece take some 50 times its bytes.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 20


def byte_table(separators: bytes) -> np.ndarray:
    """True for bytes that belong to words."""
    table = np.ones(256, dtype=bool)
    table[np.frombuffer(separators, dtype=np.uint8)] = False
    return table


#: fixed values: the word classes of the contracts
SPACES = bytes([0x20, *range(0x09, 0x0E)])
NOT_ALNUM = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
SPACE_WORDS = byte_table(SPACES)
ALNUM_WORDS = byte_table(NOT_ALNUM)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def pieces(column: pa.Array, most: int = PIECE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, all bytes, offsets of the texts in them); a null is an empty text."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last
    release()


def release() -> None:
    """Gives memory that arrays have left behind back to the system: a Python worker stays while others need it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # only the GNU C library has it
        pass


def bounds(data: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the first word of every text (one more than texts)."""
    if not len(data):
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(len(offsets), dtype=np.int64)
    inside = word_bytes[data]
    edge = np.zeros(len(data), dtype=bool)
    cuts = offsets[:-1][offsets[:-1] < len(data)]
    edge[cuts] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:]
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_ODD = np.uint64(0x9E3779B97F4A7C15)
_STEP = 0xD1342543DE82EF95  # odd, so it has an inverse modulo 2**64
_BYTES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(step: int, n: int) -> np.ndarray:
    out = np.empty(n, dtype=np.uint64)
    if n:
        out[0] = 1
        have = 1
        while have < n:
            more = min(have, n - have)
            out[have : have + more] = out[:more] * np.uint64(pow(step, have, 1 << 64))
            have += more
    return out


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word's bytes: a polynomial in a fixed odd base, from prefix sums, then mixed."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    n = len(data) + 1
    up, down = _powers(_STEP, n), _powers(pow(_STEP, -1, 1 << 64), n)
    sums = np.zeros(n, dtype=np.uint64)
    np.cumsum(_BYTES[data] * up[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _ODD)


def code_points(data: np.ndarray) -> np.ndarray:
    """Number of code points before each byte, and the total at the end."""
    out = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out
