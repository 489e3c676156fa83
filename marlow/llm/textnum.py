"""Whole Arrow text columns as numpy arrays: words, word hashes and rolling hashes without a Python object per word."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: A chunk holds whole documents of about so many bytes; a longer document is a chunk of its own.
CHUNK_BYTES = 1 << 20

#: Spans of more bytes are hashed one by one.
LONG = 512
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)  # masks of the first k bytes
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """The first n powers of the hash base, or of its inverse, modulo 2**64."""
    at = int(inverse)
    if len(_POWERS[at]) < n:
        grown = np.full(max(n, CHUNK_BYTES + 1), BASE_INVERSE if inverse else BASE, np.uint64)
        grown[0] = 1
        _POWERS[at] = np.multiply.accumulate(grown)
    return _POWERS[at][:n]


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and each row's offsets in them; a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.cast(pa.large_binary()) if column.null_count == 0 else column.fill_null("").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8, at[-1] - at[0], at[0]) if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def chunks(column: pa.Array, limit: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole rows, each of about ``limit`` bytes."""
    raw, at = utf8(column)
    row, n, limit = 0, len(at) - 1, limit or CHUNK_BYTES
    while row < n:
        end = max(row + 1, int(np.searchsorted(at, at[row] + limit, "right")) - 1)
        yield row, end, raw[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    """A-Z to a-z, all else as it is."""
    return np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw)


def words(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row offsets into them) of the maximal runs of bytes outside [\\x20\\x09-\\x0D] within each row."""
    full = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    edge = np.zeros(len(raw) + 1, bool)
    edge[at] = True  # a word never spans two rows
    before = np.empty(len(raw), bool)
    if len(raw):
        before[0] = False
        before[1:] = full[:-1]
    starts = np.flatnonzero(full & (~before | edge[:-1]))
    after = np.empty(len(raw), bool)
    if len(raw):
        after[-1] = False
        after[:-1] = full[1:]
    ends = np.flatnonzero(full & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, at)


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte span, mixed eight bytes at a time, so that no algebra of the bytes survives.

    Spans of one length up to eight bytes never share a hash; spans above ``LONG`` bytes go through BLAKE2b.
    """
    size = (ends - starts).astype(np.int64)
    out = mix(size.astype(np.uint64), salt + 1)
    if not len(size):
        return out
    padded = np.zeros((len(raw) + 15) // 8 * 8, np.uint8)
    padded[: len(raw)] = raw
    eights = np.lib.stride_tricks.as_strided(padded.view(np.uint64)[:1], (len(raw) + 1,), (1,))
    long = np.flatnonzero(size > LONG)
    todo, at = slice(None), starts
    left = size
    if len(long):
        todo = np.flatnonzero(size <= LONG)
        at, left = starts[todo], size[todo]
    while len(left):
        out[todo] = mix(out[todo] ^ (eights[at] & _FIRST[np.minimum(left, 8)]), salt + 2)
        more = np.flatnonzero(left > 8)
        todo = more if isinstance(todo, slice) else todo[more]
        at, left = at[more] + 8, left[more] - 8
    for i in long.tolist():
        digest = hashlib.blake2b(raw[starts[i] : ends[i]].tobytes(), digest_size=8, key=salt.to_bytes(8, "little")).digest()
        out[i] = np.frombuffer(digest, "<u8")[0]
    return out


def differ(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray, at: np.ndarray, until: np.ndarray) -> np.ndarray:
    """Which spans are not, byte for byte, their counterparts in ``other``."""
    size = ends - starts
    out = size != until - at
    same = np.flatnonzero(~out & (size > 0))
    n = size[same]
    stops = np.cumsum(n)
    step = np.arange(stops[-1] if len(stops) else 0)
    unequal = raw[np.repeat(starts[same] - (stops - n), n) + step] != other[np.repeat(at[same] - (stops - n), n) + step]
    if unequal.any():
        out[same] = np.add.reduceat(unequal, stops - n) > 0
    return out


def rolling(codes: np.ndarray, width: int, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of every ``width`` consecutive codes.

    The codes are mixed hashes themselves and ``width`` is small: a sum of powers only cancels for
    certain over spans of more than a thousand codes.
    """
    n = len(codes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * powers(len(codes)), out=sums[1:])
    return mix((sums[width:] - sums[:-width]) * powers(n, inverse=True), salt)
