"""Vectorised word and n-gram fingerprints over Arrow batches of UTF-8 text.

Words are maximal runs of bytes that are not ASCII white space, which is what
``[^\\x20\\x09-\\x0D]+`` means on UTF-8.  A ``WordGrid`` holds a quarter of a megabyte
of documents at a time, so memory stays bounded whatever the partition holds;
one document longer than the chunk limit is a chunk of its own.

Fingerprints are 64 bits wide.  They depend on the bytes alone: not on the
chunk, the partition or the executor, so recomputed tasks agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_U = np.uint64

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: Lower-cases A-Z and nothing else.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

#: Everything but digits, lower-case ASCII letters and non-ASCII bytes.
PUNCT = np.zeros(256, bool)
PUNCT[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit words so that every input bit moves every output bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_powers: list[np.ndarray] = []


def power_tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse; the tables only ever grow."""
    if not _powers or len(_powers[0]) < n:
        up, down = np.full(1 << max(19, int(n).bit_length()), _U(_BASE)), np.full(1 << max(19, int(n).bit_length()), _U(_BASE_INV))
        up[0] = down[0] = 1
        _powers[:] = np.cumprod(up), np.cumprod(down)
    return _powers


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit fingerprint of ``data[s:e]`` for each span; equal bytes agree anywhere."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + _U(1)) * up[: len(data)], out=sums[1:])
    raw = (sums[ends] - sums[starts]) * down[starts]
    return mix(raw + (ends - starts).astype(np.uint64) * _U(0xD6E8FEB86659FD93))


def within(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Fingerprints that agree only inside one document of a chunk."""
    return mix(h + doc.astype(np.uint64) * _U(0xA24BAED4963EE407))


class WordGrid:
    """The words of some documents: ``doc`` (index), ``start``, ``end``, ``hash``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, *, lower: bool = False, separators: np.ndarray = SPACE):
        if lower:
            data = LOWER[data]
        self.data, self.offsets = data, offsets
        n = len(data)
        inside = ~separators[data]
        begin = inside.copy()
        begin[1:] &= ~inside[:-1]
        stop = inside.copy()
        stop[:-1] &= ~inside[1:]
        cuts = offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < n)]
        begin[cuts] = inside[cuts]
        stop[cuts - 1] = inside[cuts - 1]
        self.inside = inside
        self.start = np.flatnonzero(begin)
        self.end = np.flatnonzero(stop) + 1
        self.first = np.searchsorted(self.start, offsets)  # of each document; one more at the end
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(self.counts)), self.counts)
        self._hash: np.ndarray | None = None

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            self._hash = span_hashes(self.data, self.start, self.end)
        return self._hash

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprints of the windows of ``k`` words inside one document, and the word index where each starts."""
        n = len(self.start) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        h = self.hash
        acc = h[:n].copy()
        for j in range(1, k):
            acc = acc * _U(0xFF51AFD7ED558CCD) + h[j : j + n]
        at = np.flatnonzero(self.doc[:n] == self.doc[k - 1 : k - 1 + n])
        return mix(acc[at]), at


def distinct(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(one span of each distinct content, the index into those for every span); contents are compared byte by byte."""
    _, first, inverse = np.unique(span_hashes(data, start, end), return_index=True, return_inverse=True)
    size, of = end - start, first[inverse]
    same = bool((size == size[of]).all())
    if same and len(size):
        step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        same = bool((data[np.repeat(start, size) + step] == data[np.repeat(start[of], size) + step]).all())
    if not same:  # two contents share a fingerprint
        seen: dict[bytes, int] = {}
        inverse = np.array([seen.setdefault(data[a:b].tobytes(), len(seen)) for a, b in zip(start.tolist(), end.tolist())])
        first = np.unique(inverse, return_index=True)[1]
    return first, inverse


def per_doc(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over the spans that ``offsets`` bound."""
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def chunks(batch: pa.RecordBatch | pa.Table, column: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, past the last row, bytes, offsets) of pieces of a binary column; null counts as empty."""
    col = batch.column(column)
    for piece, base in _flat(col):
        n = len(piece)
        bufs = piece.buffers()
        off = np.frombuffer(bufs[1], np.int32, n + 1, piece.offset * 4).astype(np.int64)
        data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
        if piece.null_count and np.any(np.diff(off)[np.asarray(piece.is_null())]):
            piece = pa.array([x or b"" for x in piece.to_pylist()], pa.binary())
            off = np.frombuffer(piece.buffers()[1], np.int32, n + 1).astype(np.int64)
            data = np.frombuffer(piece.buffers()[2], np.uint8)
        i = 0
        while i < n:
            j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
            yield base + i, base + j, data[off[i] : off[j]], off[i : j + 1] - off[i]
            i = j


def _flat(col: pa.Array | pa.ChunkedArray) -> Iterator[tuple[pa.Array, int]]:
    base = 0
    for piece in col.chunks if isinstance(col, pa.ChunkedArray) else [col]:
        yield piece.cast(pa.binary()) if piece.type != pa.binary() else piece, base
        base += len(piece)
