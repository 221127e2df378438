"""Vectorised text primitives over Arrow buffers: chunks of documents, words, position-independent hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 2 << 20  # bytes of text worked on at once; a longer document is a chunk of its own
_M = np.uint64(0x9E3779B97F4A7C15)
_MINV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_tables = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes of their texts on end, offsets of each text and the end). Null texts are empty."""
    for batch in batches:
        i = batch.schema.get_field_index(column)
        text = batch.column(i)
        if pa.types.is_large_string(text.type) or pa.types.is_large_binary(text.type):
            width = np.int64
        else:
            width = np.int32
        _, offsets, data = text.buffers()
        n = len(text)
        at = np.frombuffer(offsets, width, count=n + 1 + text.offset)[text.offset :].astype(np.int64) if n else np.zeros(1, np.int64)
        raw = np.frombuffer(data, np.uint8) if data is not None and len(data) else np.zeros(0, np.uint8)
        lo = 0
        while lo < n:
            hi = int(np.searchsorted(at, at[lo] + limit, side="right")) - 1
            hi = min(n, max(hi, lo + 1))
            yield batch.slice(lo, hi - lo), raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
            lo = hi


def lowered(raw: np.ndarray) -> np.ndarray:
    """A-Z lower-cased."""
    out = raw.copy()
    out[(raw >= 65) & (raw <= 90)] += 32
    return out


def words(raw: np.ndarray, at: np.ndarray, inside: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of every run of word bytes; none crosses a document. inside: which bytes are of words
    (default: all but blanks, 0x20 and 0x09-0x0D)."""
    if inside is None:
        inside = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = at[(at > 0) & (at < n)]
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(at, start, side="right") - 1


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse, kept up to a chunk's length."""
    if len(_tables[0]) < n:
        size = max(n, 1 << 16)
        both = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, m, np.uint64)])) for m in (_M, _MINV)]
        if size > 4 * CHUNK:
            return both[0], both[1]
        _tables[:] = both
    return _tables[0][:n], _tables[1][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    for _ in range(2):
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
    return x


class Spans:
    """Hashes of any stretch [s, e) of one byte array, equal for equal bytes wherever they stand."""

    def __init__(self, raw: np.ndarray):
        power, self.inverse = _powers(len(raw) + 1)
        self.prefix = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[:-1], out=self.prefix[1:])

    def __call__(self, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        return mixed((self.prefix[e] - self.prefix[s]) * self.inverse[s] + (e - s).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))

    def every(self, width: int) -> np.ndarray:
        """The hash of each stretch of that width, by its start."""
        n = max(0, len(self.prefix) - width)
        h = self.prefix[width : width + n] - self.prefix[:n]
        h *= self.inverse[:n]
        h += np.uint64(width * 0xC2B2AE3D27D4EB4F & (1 << 64) - 1)
        return mixed(h)


def crc_fold(ids: list, n: int) -> np.ndarray:
    """crc32 of each id's text modulo n; a null id counts as the empty text."""
    import zlib

    return np.fromiter((zlib.crc32(b"" if i is None else str(i).encode()) % n for i in ids), np.int64, len(ids))
