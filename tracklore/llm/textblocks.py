"""Words and hashes of many UTF-8 texts at once, over the bytes of an Arrow column.

A slice's hash chains a mixer over its 8-byte lanes, its length first, so that no algebra of
repeated parts (as in polynomials modulo 2**64) makes unlike slices equal; slices beyond
``LANES`` lanes take BLAKE2. ``equal_slices`` compares bytes. Words are runs of bytes outside
space and 09-0D.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_RNG = np.random.default_rng(20240229)
_ODD = _RNG.integers(1, 2**64, 64, dtype=np.uint64) | np.uint64(1)
#: Starting values of the independent hashes that ``slice_hashes`` can give.
_SEEDS = _RNG.integers(1, 2**64, 4, dtype=np.uint64)
#: Lanes of 8 bytes that are hashed together for all slices; longer slices one by one.
LANES = 32
#: Of a lane, its first k bytes.
_FIRST = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def lanes_of(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as one number; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))


def slice_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hash of data[start:end] for each pair, equal for equal bytes wherever they stand."""
    lanes, size = lanes_of(data), end - start
    out = mix(size.astype(np.uint64) ^ _SEEDS[seed])
    at = np.arange(len(size))
    for k in range(LANES):
        if not (at := at[size[at] > 8 * k] if k else at[size > 0]).size:
            return out
        lane = lanes[start[at] + 8 * k] & _FIRST[np.minimum(size[at] - 8 * k, 8)]
        out[at] = mix(out[at] ^ lane)
    for i in at[size[at] > 8 * LANES].tolist():
        raw = blake2b(data[start[i] : end[i]].tobytes(), digest_size=8, key=bytes([seed])).digest()
        out[i] = int.from_bytes(raw, "little")
    return out


def equal_slices(x: np.ndarray, x_start: np.ndarray, y: np.ndarray, y_start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether ``size`` bytes of x from x_start are those of y from y_start, for each triple.

    8 bytes follow the last slice of y.
    """
    out, at = np.ones(len(size), bool), np.flatnonzero(size > 0)
    left, right = lanes_of(x), np.ndarray(len(y) - 7, "<u8", y, strides=(1,))
    for k in range(LANES):
        if not at.size:
            return out
        i, j, mask = x_start[at] + 8 * k, y_start[at] + 8 * k, _FIRST[np.minimum(size[at] - 8 * k, 8)]
        out[at] = ((left[i] ^ right[j]) & mask) == 0
        at = at[out[at] & (size[at] > 8 * (k + 1))]
    for i in at.tolist():
        n = size[i]
        out[i] = np.array_equal(x[x_start[i] : x_start[i] + n], y[y_start[i] : y_start[i] + n])
    return out


class Block:
    """A few texts: their bytes end to end, and where each begins and ends."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        self.data, self.bounds = data, bounds

    def words(self, fold: bool = False) -> Words:
        return Words(self, fold)


class Words:
    """The words of a block: byte ranges, hashes, and each text's first word."""

    def __init__(self, block: Block, fold: bool):
        data, bounds = block.data, block.bounds
        data = _LOWER[data] if fold else data
        inside = ~SPACE[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[bounds] = True
        before = np.empty(len(data), bool)
        before[:1], before[1:] = False, inside[:-1]
        after = np.empty(len(data), bool)
        after[-1:], after[:-1] = False, inside[1:]
        self.data = data
        self.start = np.flatnonzero(inside & (~before | edge[:-1]))
        self.end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        #: Words of text i are first[i]:first[i + 1].
        self.first = np.searchsorted(self.start, bounds)
        self.hash = self.hashes(0)

    def hashes(self, seed: int) -> np.ndarray:
        """Hash of each word; those of different seeds are independent."""
        return slice_hashes(self.data, self.start, self.end, seed)


def combine(values: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """Order-dependent hash of each run of ``width`` values, at most 32 wide."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    odd = _ODD[32 * seed :]
    out = values[:n] * odd[0]
    for k in range(1, width):
        out = out + values[k : k + n] * odd[k]
    return mix(out)


def runs_inside(first: np.ndarray, width: int) -> np.ndarray:
    """Number of runs of ``width`` words in each text."""
    return np.maximum(np.diff(first) - width + 1, 0)


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and its len + 1 offsets; null counts as empty."""
    column = pc.fill_null(column, "")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def blocks(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, Block]]:
    """Row ranges of about ``most`` bytes, or of one longer text, with their bytes."""
    if not len(column):
        return
    data, at = column_bytes(column)
    start = 0
    while start < len(column):
        stop = max(start + 1, int(np.searchsorted(at, at[start] + most, side="right")) - 1)
        yield start, stop, Block(data[at[start] : at[stop]], at[start : stop + 1] - at[start])
        start = stop
