"""Vectorised word and byte hashing over Arrow string columns.

Every function works on the UTF-8 bytes of a slice of documents at once, so the
cost per byte is a few NumPy passes and no Python object is made per word.
A polynomial prefix sum modulo 2**64 gives the hash of any byte or word range
in constant time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_WORD_BASE = 0xC2B2AE3D27D4EB4F | 1
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _table(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of base and of its inverse modulo 2**64, for at least n places."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        up = np.full(size, base, U64)
        down = np.full(size, pow(base, -1, 1 << 64), U64)
        up[0] = down[0] = 1
        have = np.multiply.accumulate(up), np.multiply.accumulate(down)
        _powers[base] = have
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: spreads all bits."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the n + 1 offsets of a string or binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_binary())
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of rows of about ``most`` bytes of text; a longer text stands alone."""
    _, offsets = text_buffers(batch.column(column))
    at, n = 0, batch.num_rows
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield batch.slice(at, min(end, n) - at)
        at = min(end, n)


_WHITE = np.zeros(256, bool)
_WHITE[[0x20, 9, 10, 11, 12, 13]] = True


def words(data: np.ndarray, offsets: np.ndarray, white: np.ndarray = _WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each document its first word's number (n + 1 values)."""
    inside = ~white[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cut = offsets[1:-1]
    cut = cut[cut < len(data)]
    first[cut] = inside[cut]
    starts = np.flatnonzero(first)
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cut = cut[cut > 0] - 1
    last[cut] = inside[cut]
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def prefix(data: np.ndarray) -> np.ndarray:
    """Sums of (byte + 1) * base ** place, with a leading zero."""
    up, _ = _table(len(data) + 1, _BASE)
    out = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * up[: len(data)], out=out[1:])
    return out


def range_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The unmixed hash of each byte range."""
    _, down = _table(len(sums), _BASE)
    return (sums[ends] - sums[starts]) * down[starts]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix(range_hash(prefix(data), starts, ends) + (ends - starts).astype(U64))


def grams(values: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """The hash of each k consecutive values (the last k - 1 places have none)."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    base = (_WORD_BASE + 2 * seed * 0x9E3779B9) & (2**64 - 1)
    out = np.full(n, seed, U64)
    for j in range(k):
        out = out * U64(base) + values[j : j + n]
    return mix(out)


def sliding_min(values: np.ndarray, w: int) -> np.ndarray:
    """The minimum of each w consecutive values, by doubling."""
    n = len(values) - w + 1
    if n <= 0:
        return values[:0]
    cur, have = values, 1
    while have * 2 <= w:
        cur = np.minimum(cur[:-have], cur[have:])
        have *= 2
    rest = w - have
    return np.minimum(cur[: n], cur[rest : rest + n]) if rest else cur[:n]


def winnow(hashes: np.ndarray, valid: np.ndarray, w: int) -> np.ndarray:
    """Places that hold the minimum of some window of w hashes that are all valid.

    The window minimum is chosen by value alone, so all equal minima of a window
    are kept: equal windows choose equal places whatever stands around them.
    """
    n = len(hashes)
    if n < w:
        return np.zeros(0, np.int64)
    low = sliding_min(hashes, w)
    whole = np.concatenate([[0], np.cumsum(~valid)])
    low[(whole[w:] - whole[:-w]) > 0] = 0
    # a place is kept if the largest of the minima of the windows over it equals its own value
    pad = np.zeros(n + w - 1, U64)
    pad[w - 1 : w - 1 + len(low)] = low
    most = ~sliding_min(~pad, w)
    return np.flatnonzero((most == hashes) & (hashes > 0))


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True."""
    edge = np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
