"""Vectorised byte-level text kernels shared by the corpus operators.

A word is a maximal run of bytes other than space and 0x09-0x0D; A-Z count as a-z. All functions take whole
texts; a caller hands over slices of an Arrow column of bounded bytes (see ``slices``), so memory follows the
slice and the longest single text, never the partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard

U = np.uint64
SLICE_BYTES = 1 << 20
_MULT = 0x9E3779B97F4A7C15
_WORD = np.ones(256, dtype=bool)
_WORD[[32, 9, 10, 11, 12, 13]] = False
_rng = np.random.default_rng(20240607)
_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)
_CODE[65:91] = _CODE[97:123]
_PRIME = int(_rng.integers(1 << 61, 1 << 62)) * 8 + 3
_PRIME_INV = pow(_PRIME, -1, 1 << 64)
_SHINGLE = _rng.integers(1, 1 << 63, 8, dtype=np.uint64) | U(1)
_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    have = _powers.get(str(base))
    if have is None or len(have) < n:
        have = np.full(n + 1, base % (1 << 64), dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if n <= 4 * SLICE_BYTES:
            _powers[str(base)] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def slices(texts: pa.Array | pa.ChunkedArray, most: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of consecutive rows of about ``most`` bytes; null counts as the empty text."""
    chunks = texts.chunks if isinstance(texts, pa.ChunkedArray) else [texts]
    row = 0
    for chunk in chunks:
        if not len(chunk):
            continue
        wide = chunk.cast(pa.large_binary()) if not pa.types.is_large_binary(chunk.type) else chunk
        if wide.null_count:
            wide = wide.fill_null(b"")
        offsets = np.frombuffer(wide.buffers()[1], dtype=np.int64)[wide.offset : wide.offset + len(wide) + 1]
        data = np.frombuffer(wide.buffers()[2], dtype=np.uint8) if wide.buffers()[2] else np.zeros(0, np.uint8)
        at = 0
        while at < len(wide):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
            yield row + at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
            at = to
        row += len(wide)


def word_bounds(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray = _WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text the index of its first word (one more entry at the end)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = kind[data]
    edge = np.empty(len(data) + 1, dtype=bool)
    edge[0], edge[-1] = True, True
    np.not_equal(inside[1:], inside[:-1], out=edge[1:-1])
    edge[offsets] = True
    at = np.flatnonzero(edge)
    keep = inside[at[:-1]]
    starts, ends = at[:-1][keep], at[1:][keep]
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, code: np.ndarray = _CODE) -> np.ndarray:
    """64-bit hashes of the byte ranges; equal ranges (up to A-Z) hash alike wherever they stand."""
    n = len(data)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(code[data] * _power(_PRIME, n), out=total[1:])
    return mix((total[ends] - total[starts]) * _power(_PRIME_INV, n + 1)[starts] + (ends - starts).astype(np.uint64) * U(_MULT))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and for each text the index of its first word."""
    starts, ends, first = word_bounds(data, offsets)
    return span_hashes(data, starts, ends), first


def shingles(hashes: np.ndarray, first: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of each text in order, and where each text's begin; a shorter text has its whole sequence."""
    counts = np.diff(first)
    n = len(hashes)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        out[: n - k] += hashes[k:] * _SHINGLE[k]
    own = np.repeat(np.arange(len(counts)), counts)
    keep = np.arange(n) + width <= first[1:][own]
    for d in np.flatnonzero((counts > 0) & (counts < width)):
        a, c = first[d], counts[d]
        out[a] = (hashes[a : a + c] * _SHINGLE[:c]).sum(dtype=np.uint64) ^ U(int(c) * _MULT % (1 << 64))
        keep[a] = True
    sizes = np.add.reduceat(np.append(keep, False).astype(np.int64), np.minimum(first[:-1], n)) * (counts > 0) if len(counts) else np.zeros(0, np.int64)
    return mix(out[keep]), np.concatenate([[0], np.cumsum(sizes)])


def distinct(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each text, and where each text's begin."""
    parts = [np.unique(values[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
    return (np.concatenate(parts) if parts else values[:0]), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value, byte by byte of their items, so that leading zeros take no room."""
    head = b"".join(x.dtype.str.encode().ljust(8) + len(x).to_bytes(8, "little") for x in arrays)
    planes = [np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T).tobytes() for x in arrays]
    return zstandard.ZstdCompressor(level=1).compress(b"".join([len(arrays).to_bytes(8, "little"), head, *planes]))


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, out = int.from_bytes(raw[:8], "little"), []
    at = 8 + 16 * n
    for i in range(n):
        kind, size = np.dtype(raw[8 + 16 * i : 16 + 16 * i].strip().decode()), int.from_bytes(raw[16 + 16 * i : 24 + 16 * i], "little")
        planes = np.frombuffer(raw, np.uint8, size * kind.itemsize, at).reshape(kind.itemsize, size)
        out.append(np.ascontiguousarray(planes.T).view(kind).ravel())
        at += size * kind.itemsize
    return out
