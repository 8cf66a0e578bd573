"""Words and hashes of whole Arrow columns of text, computed with numpy on the raw UTF-8 bytes.

Delimiters are single ASCII bytes, so cutting bytes equals cutting characters.
Null texts have no words.  Texts are taken in slices of bounded size, so memory
follows the slice (or one longest text), never the batch or the partition.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
BASE = U64(0x9E3779B97F4A7C15 | 1)
SLICE_BYTES = 2 << 20

_BYTES = np.arange(256)
SPACE = (_BYTES == 0x20) | ((_BYTES >= 0x09) & (_BYTES <= 0x0D))
NOT_ALNUM = (_BYTES < 0x30) | ((_BYTES >= 0x3A) & (_BYTES <= 0x60)) | ((_BYTES >= 0x7B) & (_BYTES <= 0x7F))
FOLD = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix64 finaliser)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_POWERS = np.ones(1, U64)
_INVERSES = np.ones(1, U64)
_INVERSE = U64(pow(int(BASE), -1, 1 << 64))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse to the powers 0..n-1, modulo 2**64."""
    global _POWERS, _INVERSES
    if len(_POWERS) < n:
        size = max(n, SLICE_BYTES + 1)
        ones = np.full(size, BASE)
        ones[0] = 1
        inverse = np.full(size, _INVERSE)
        inverse[0] = 1
        _POWERS, _INVERSES = np.multiply.accumulate(ones), np.multiply.accumulate(inverse)
    return _POWERS[:n], _INVERSES[:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[start:end] for many spans, from one running sum over the bytes."""
    powers, inverses = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * powers[: len(data)], out=sums[1:])
    raw = (sums[ends] - sums[starts]) * inverses[starts]
    return mix(raw + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


@dataclass
class Words:
    """Words of consecutive texts: byte spans in `data`, hashes, and where each text's words begin."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray  # len(texts) + 1 offsets into the words

    def __len__(self):
        return len(self.first) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        """The text each word belongs to."""
        return np.repeat(np.arange(len(self)), self.counts)


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string or binary column and each value's offsets in them; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not (pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)):
        column = column.cast(pa.large_binary() if pa.types.is_binary(column.type) else pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_large_binary(column.type) else "")
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    begin, end = (int(offsets[0]), int(offsets[-1])) if len(column) else (0, 0)
    data = np.frombuffer(data, np.uint8)[begin:end] if data is not None and end > begin else np.zeros(0, np.uint8)
    return data, offsets - begin


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose text together stays under `limit` bytes (or is a single row)."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.cumsum(sizes)
    at = 0
    while at < batch.num_rows:
        before = total[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(total, before + limit, "right")))
        yield batch.slice(at, stop - at)
        at = stop
    pa.default_memory_pool().release_unused()  # workers live on between stages


def words(column: pa.Array, delimiter: np.ndarray = SPACE, fold: bool = False, hashed: bool = True) -> Words:
    """Maximal runs of bytes that are no delimiter, for every text; `fold` lower-cases A-Z first."""
    data, offsets = raw(column)
    if fold:
        data = FOLD[data]
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(data, none, none, np.zeros(0, U64), np.zeros(len(offsets), np.int64))
    inside = ~delimiter[data]
    edge = np.zeros(n + 1, bool)  # a text may end inside a word
    edge[offsets] = True
    follows = np.zeros(n, bool)
    follows[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~follows | edge[:n]))
    stops = np.ones(n, bool)
    stops[:-1] = ~inside[1:] | edge[1:n]
    ends = np.flatnonzero(inside & stops) + 1
    hashes = span_hashes(data, starts, ends) if hashed else np.zeros(0, U64)
    return Words(data, starts, ends, hashes, np.searchsorted(starts, offsets))


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive values (crossing texts; callers keep those inside one)."""
    if len(hashes) < k:
        return np.zeros(0, U64)
    n = len(hashes) - k + 1
    out = np.zeros(n, U64)
    for i in range(k):
        out = (out ^ hashes[i : i + n]) * U64(0xFF51AFD7ED558CCD) + U64(i + 1)
        out ^= out >> U64(32)
    return mix(out)


def sliding_min(values: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values, by doubling."""
    if len(values) < w:
        return values[:0]
    out, have = values, 1
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... counts[i] of them, for every i, in one array."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(counts) - counts
    return np.arange(total) - np.repeat(before - starts, counts)


def strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, joiner: bytes | None = None) -> bytes:
    """The spans' bytes one after another, optionally each followed by a one-byte joiner."""
    if joiner is None:
        return data[ranges(starts, ends - starts)].tobytes()
    sizes = ends - starts + 1
    out = np.full(int(sizes.sum()), joiner[0], np.uint8)
    at = np.cumsum(sizes) - sizes
    out[ranges(at, ends - starts)] = data[ranges(starts, ends - starts)]
    return out.tobytes()
