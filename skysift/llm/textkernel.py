"""Vectorised numpy kernels over Arrow string columns: byte chunks, words, rolling hashes.

Texts are handled as UTF-8 bytes. Words are the maximal runs of bytes other than 0x20 and 0x09-0x0D.
Hashes are polynomial prefix hashes modulo 2**64 over per-byte random codes, finished by an avalanche mix.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_RNG = np.random.default_rng(20240607)
CODES = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
LOWER_CODES = CODES.copy()
LOWER_CODES[65:91] = CODES[97:123]
BASE = U(0x9E3779B97F4A7C15)
BASE_INV = U(pow(int(BASE), -1, 2**64))
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True

_powers: dict[str, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """base**i (or its inverse) for i < n, kept between calls."""
    key = "inv" if inverse else "fwd"
    have = _powers.get(key)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), BASE_INV if inverse else BASE, dtype=np.uint64)
        steps[0] = 1
        have = _powers[key] = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


@dataclass
class Chunk:
    """Rows lo..hi of a batch: their bytes end to end, and n+1 offsets."""

    lo: int
    hi: int
    data: np.ndarray
    offs: np.ndarray


def chunks(col: pa.Array, most: int = 1 << 20) -> Iterator[Chunk]:
    """Cut a string column into runs of whole texts of about ``most`` bytes (one text may be longer). Null: empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    if len(col) == 0:
        return
    _, off_buf, data_buf = col.buffers()
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    offs = np.frombuffer(off_buf, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(data_buf, np.uint8) if data_buf is not None and offs[-1] > 0 else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(col):
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + most, "right")) - 1)
        hi = min(hi, len(col))
        yield Chunk(lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
        lo = hi


def word_bounds(c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends (exclusive) of words, and counts of words by row; words never cross rows."""
    n = len(c.data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = ~SPACE[c.data]
    cut = np.zeros(n + 1, bool)
    cut[c.offs] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | cut))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | cut))
    counts = np.diff(np.searchsorted(starts, c.offs))
    return starts, ends, counts


def prefix_hash(data: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """out[i] = hash sum of the first i bytes."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(codes[data] * powers(len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Position-free hash of bytes starts..ends."""
    return (prefix[ends] - prefix[starts]) * powers(len(prefix), inverse=True)[starts]


def word_hashes(c: Chunk, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    h = span_hash(prefix_hash(c.data, LOWER_CODES if lower else CODES), starts, ends)
    return mix(h + (ends - starts).astype(np.uint64) * U(0xD6E8FEB86659FD93))


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` consecutive items; len(words)-size+1 of them (runs may cross rows: mask them)."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = words[:n].copy()
    for k in range(1, size):
        h *= BASE
        h += words[k : n + k]
    return mix(h)
