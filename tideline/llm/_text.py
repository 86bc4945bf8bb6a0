"""Vectorised tokenising and hashing of Arrow string columns.

Everything works on the UTF-8 bytes of a chunk of whole documents at once, so the
cost per document is a few array slices and memory is bounded by the chunk size
(or by the longest single document).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once.
CHUNK_BYTES = 1_000_000

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def _table(of) -> np.ndarray:
    return np.array([of(b) for b in range(256)])


#: Bytes of the words ``[^\x20\x09-\x0D]+``.
NOT_SPACE = _table(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
#: Bytes of the words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of lower-cased text.
ALPHANUMERIC = _table(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
#: A-Z to a-z, other bytes as they are.
LOWER = _table(lambda b: b + 32 if 0x41 <= b <= 0x5A else b).astype(np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x = x * _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


class Powers:
    """Powers of the hash base and of its inverse, as long as the longest chunk so far."""

    size = 0
    up: np.ndarray
    down: np.ndarray

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > cls.size:
            cls.size = max(n, CHUNK_BYTES + 1)
            cls.up, cls.down = (np.multiply.accumulate(np.concatenate([np.ones(1, _U), np.full(cls.size - 1, b, _U)])) for b in (_BASE, _BASE_INVERSE))
        return cls.up[:n], cls.down[:n]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the bounds of its values; nulls are empty."""
    if pa.types.is_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, bounds, data = column.buffers()
    bounds = np.frombuffer(bounds, np.int64)[column.offset : column.offset + len(column) + 1] if bounds and len(column) else np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut between rows where the column passes ``most`` bytes. A row is never cut."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, bounds = utf8(batch.column(column))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + most, "right")) - 1)
            yield batch.slice(at, end - at)
            at = end


class Tokens:
    """The words of a chunk: ``start``/``end`` bytes, ``hash``, and where each document's words begin (``first``)."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, word: np.ndarray, lower: bool = True):
        self.data = data = LOWER[data] if lower and len(data) else data
        self.bounds = bounds
        inside = np.zeros(len(data) + 1, bool)
        inside[:-1] = word[data]
        before = np.zeros(len(data) + 1, bool)
        before[1:] = inside[:-1]
        cut = np.zeros(len(data) + 1, bool)
        cut[bounds] = True
        self.start = np.flatnonzero(inside & (~before | cut))
        self.end = np.flatnonzero(before & (~inside | cut))
        self.first = np.searchsorted(self.start, bounds)
        self.count = np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)

    def hashes(self, salt: int = 0) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        return spans(self.data, self.start, self.end, salt)


def spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of each span of bytes."""
    if not len(start):
        return np.zeros(0, _U)
    return spans_of(span_sums(data), start, end, salt)


def span_sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What `spans_of` needs of the bytes, for hashes of several lists of spans."""
    up, down = Powers.of(len(data) + 1)
    total = np.zeros(len(data) + 1, _U)
    np.cumsum((data.astype(_U) + _U(1)) * up[:-1], out=total[1:])
    return total, down


def spans_of(sums: tuple[np.ndarray, np.ndarray], start: np.ndarray, end: np.ndarray, salt: int = 0) -> np.ndarray:
    """The hashes of `spans`, from its sums."""
    total, down = sums
    return mix((total[end] - total[start]) * down[start] + _U(salt & (2**64 - 1)) + (end - start).astype(_U) * _U(0xD6E8FEB86659FD93))


#: Odd multipliers, one for each place in a window.
_PLACES = mix(np.arange(1, 65, dtype=_U)) | _U(1)


def windows(hashes: np.ndarray, count: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``size``-word windows in document order and the windows of each document.
    A document of fewer words, but not none, has one window: all its words."""
    n = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    out = np.zeros(int(n.sum()), _U)
    to = np.concatenate([[0], np.cumsum(n)])
    if len(hashes) >= size:
        rolled = np.zeros(len(hashes) - size + 1, _U)
        for j in range(size):
            rolled += hashes[j : len(hashes) - size + 1 + j] * _PLACES[j]
        long = np.repeat(count >= size, n)
        at = np.arange(len(out)) - np.repeat(to[:-1], n) + np.repeat(first[:-1], n)
        out[long] = rolled[at[long]]
    for d in np.flatnonzero((count > 0) & (count < size)):
        out[to[d]] = (hashes[first[d] : first[d + 1]] * _PLACES[: count[d]]).sum(dtype=_U) + _U(count[d])
    return mix(out), to


def lists(values: np.ndarray, count: np.ndarray, kind: pa.DataType = pa.int64()) -> pa.Array:
    """A list column from its values and the length of each list."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), pa.array(values, kind))
