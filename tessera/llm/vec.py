"""Vectorised UTF-8 tokenising and hashing over Arrow string columns.

Every function works on one block: the bytes of a few whole texts and their offsets. A block holds at
most ``MAX_DOCS`` texts and about ``BLOCK_BYTES`` bytes (a longer text is a block of its own), so memory
follows the longest text, not the Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 2 << 20
MAX_DOCS = 4096
U64 = np.uint64

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_R = 0x9E3779B97F4A7C15 | 1
_R_INV = pow(_R, -1, 1 << 64)
_POWERS = {_R: np.ones(1, U64), _R_INV: np.ones(1, U64)}

#: Word bytes of ``[^\x20\x09-\x0D]+``.
NON_SPACE = np.ones(256, bool)
NON_SPACE[[9, 10, 11, 12, 13, 32]] = False
#: Word bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
#: Lower-cases A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS[base]
    if len(have) < n:
        have = np.full(max(n, BLOCK_BYTES + 1), base, U64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if len(have) <= 4 * BLOCK_BYTES:
            _POWERS[base] = have
    return have[:n]


def text_blocks(column: pa.Array | pa.ChunkedArray, size: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows, about ``size`` bytes each; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        end = int(np.searchsorted(offs, offs[at] + (size or BLOCK_BYTES), "right")) - 1
        end = min(max(end, at + 1), at + MAX_DOCS, len(column))
        yield at, end, raw[offs[at] : offs[end]], offs[at : end + 1] - offs[at]
        at = end


def words(buf: np.ndarray, offs: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each text and the end); words never cross texts."""
    n = len(buf)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    inside = table[buf]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    edges = offs[(offs < n)]
    before[edges] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[offs[offs > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit hashes (xor-shift and multiply, twice)."""
    x = x ^ (x >> U64(31))
    x = x * U64(0x7FB5D329728EA185)
    x ^= x >> U64(27)
    x *= U64(0x81DADEF4BC2DD44D)
    x ^= x >> U64(33)
    return x


class SpanHasher:
    """64-bit hashes of byte spans of one buffer, from one prefix sum of a polynomial modulo 2^64."""

    def __init__(self, buf: np.ndarray):
        n = len(buf)
        self.prefix = np.zeros(n + 1, U64)
        np.cumsum(_BYTE[buf] * _powers(_R, n), out=self.prefix[1:])
        self.inverse = _powers(_R_INV, n + 1)

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.prefix[ends] - self.prefix[starts]) * self.inverse[starts] + (ends - starts).astype(U64))


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each byte span."""
    return SpanHasher(buf)(starts, ends)


def window_hashes(hashes: np.ndarray, first: np.ndarray, k: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of k consecutive words, first window of each text and the end).

    With ``short`` a text of fewer words, but not none, gives its whole sequence as one window.
    """
    counts = np.diff(first)
    n_windows = np.maximum(counts - k + 1, (counts > 0).astype(np.int64) if short else 0)
    begin = np.zeros(len(first), np.int64)
    np.cumsum(n_windows, out=begin[1:])
    at = np.repeat(first[:-1] - begin[:-1], n_windows) + np.arange(begin[-1])
    total = np.zeros(len(at), U64)
    size = np.minimum(np.repeat(counts, n_windows), k)
    for j in range(k):
        part = mix(hashes[np.minimum(at + j, max(len(hashes) - 1, 0))] + U64((0xD6E8FEB86659FD93 * (j + 1)) % 2**64)) if len(hashes) else total
        total += np.where(j < size, part, U64(0))
    return mix(total + size.astype(U64)), begin


def distinct_per_text(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 52-bit hashes of each text (a block has at most 4096 texts), and their offsets."""
    text = np.repeat(np.arange(len(first) - 1, dtype=U64), np.diff(first))
    key = np.sort((text << U64(52)) | (hashes >> U64(12)))
    if len(key):
        key = key[np.concatenate(([True], key[1:] != key[:-1]))]
    return key & U64((1 << 52) - 1), np.searchsorted(key, np.arange(len(first), dtype=U64) << U64(52)) if len(first) <= 4096 else np.append(np.searchsorted(key, np.arange(len(first) - 1, dtype=U64) << U64(52)), len(key))
