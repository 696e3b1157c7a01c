"""Text columns as flat byte arrays: word bounds and 64-bit hashes without a Python loop over words.

Hashes of byte ranges are polynomial: with S the running sum of T[byte] * P^position (mod 2^64), a range
hashes to (S[end] - S[start]) * P^-start, whatever its place in the buffer. `mix` spreads the bits.
"""

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 512 << 10

_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of words: all but white space; and digits, letters and everything outside ASCII.
NON_SPACE = ~_WHITE
WORD = np.zeros(256, bool)
WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_U = np.uint64


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """Finaliser of splitmix64 over uint64 values."""
    x = x + _U((0x9E3779B97F4A7C15 * (salt + 1)) & (2**64 - 1))
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class RangeHash:
    """Hashes of ranges of one buffer. Two instances with different `salt` are independent."""

    def __init__(self, data: np.ndarray, salt: int = 0):
        self.powers, self.inverse = _powers(len(data) + 1, salt)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_table(salt)[data] * self.powers[:-1][: len(data)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Equal for equal bytes; the length takes part, so that no range is like its prefix."""
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))

    def fixed(self, width: int) -> np.ndarray:
        """The hash of every window of `width` bytes, by its start."""
        return mix((self.sums[width:] - self.sums[:-width]) * self.inverse[: len(self.sums) - width])


_cache: dict = {}


def _table(salt: int) -> np.ndarray:
    if ("t", salt) not in _cache:
        _cache["t", salt] = mix(np.arange(256, dtype=np.uint64), 1000 + salt)
    return _cache["t", salt]


def _powers(n: int, salt: int):
    """Powers of an odd base and of its inverse mod 2^64, at least n of them; kept for the next buffers."""
    got = _cache.get(("p", salt))
    if got is None or len(got[0]) < n:
        size = (n // 65536 + 1) * 65536
        base = int(mix(np.array([salt], np.uint64), 77)[0]) | 1
        got = tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, b, np.uint64))]) for b in (base, pow(base, -1, 1 << 64)))
        if size <= 2 * SLICE_BYTES:  # 16 MB for each salt; the powers of a longer buffer are made anew
            _cache["p", salt] = got
    return got[0][:n], got[1][:n]


def as_binary(column: pa.Array) -> pa.Array:
    """Text as large binary; null is empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column, and the n + 1 offsets of its rows."""
    column = as_binary(column)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if offsets else np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Free memory goes back to the system: a Python worker outlives its task and waits for the next one with what it holds."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of whole rows of about `limit` bytes of text; a longer text is a run of its own. After the last one, memory is released."""
    yield from _slices(batches, text, limit)
    release()


def _slices(batches, text, limit):
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + limit, "right"))
            end = max(end, start + 1)
            yield batch.slice(start, end - start)
            start = end


def words(data: np.ndarray, bounds: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first): the words as byte ranges, and for each row the number of its first word."""
    inside = np.zeros(len(data) + 1, np.int8)
    inside[:-1] = kind[data]
    step = np.diff(inside, prepend=np.int8(0))
    cuts = bounds[1:-1]
    cuts = np.unique(cuts[(cuts > 0) & (cuts < len(data))])
    cuts = cuts[(inside[cuts] == 1) & (inside[cuts - 1] == 1)]  # a word that would run on into the next row
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    if len(cuts):
        start, end = np.sort(np.concatenate([start, cuts])), np.sort(np.concatenate([end, cuts]))
    return start, end, np.searchsorted(start, bounds)


def lower(data: np.ndarray) -> np.ndarray:
    return LOWER[data]


def row_of(first: np.ndarray) -> np.ndarray:
    """Row number of each item, from the rows' first items."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def runs(lengths: np.ndarray) -> np.ndarray:
    """0, 1, .. for each length, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)


def list_array(first: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values, kind))
