"""Array operations on the bytes of many texts at once.

Texts arrive as Arrow columns, whose bytes already lie one after another. Everything here works on such a run of bytes
with numpy; no Python object is made per word. A *block* is a stretch of whole texts of about ``BLOCK`` bytes, so that
the arrays of one block stay small whatever the batch size is; a single longer text is a block of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK = 2 << 20
U = np.uint64

# Word separators: blank and \x09 to \x0D.
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
# ASCII capitals to small letters; other bytes stay.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_rng = np.random.default_rng(20240611)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=U) | U(1)  # one random odd number per byte value
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """``base ** i`` modulo 2**64 for i below n (kept per process, doubled when too short)."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        have = np.ones(size, U)
        have[1:] = U(base)
        have = np.multiply.accumulate(have)
        if size <= 8 * BLOCK:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers that spreads every bit over all others."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


def mix32(x: np.ndarray) -> np.ndarray:
    """A bijection on 32-bit numbers, that is a permutation of 0 .. 2**32 - 1."""
    x = x ^ (x >> np.uint32(16))
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


@dataclass
class Block:
    """Whole texts: their bytes, where each starts (one more entry than texts), and the first text's row in its batch."""

    data: np.ndarray
    starts: np.ndarray
    row: int

    def __len__(self) -> int:
        return len(self.starts) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.starts[i + 1]].tobytes()


def bounds(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and starts of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def blocks(column: pa.Array, size: int = BLOCK) -> Iterator[Block]:
    data, at = bounds(column)
    first, n = 0, len(at) - 1
    while first < n:
        last = int(np.searchsorted(at, at[first] + size, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield Block(data[at[first] : at[last]], at[first : last + 1] - at[first], first)
        first = last


def lower(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """``p`` with one entry more than bytes; ``span_hash`` reads the hash of any span from it."""
    p = np.zeros(len(data) + 1, U)
    np.cumsum(_BYTE[data] * _power(_BASE, len(data)), out=p[1:])
    return p


def span_hash(p: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes from start to end, alike for equal bytes wherever they lie."""
    return mix((p[end] - p[start]) * _power(_INVERSE, len(p))[start])


def word_spans(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and for each text the index of its first word (one entry more than texts)."""
    n = len(data)
    inside = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[starts] = True  # words never reach over the end of a text
    begins = np.flatnonzero(inside & (edge[:n] | np.concatenate(([True], ~inside[:-1])))) if n else np.zeros(0, np.int64)
    ends = np.flatnonzero(inside & (edge[1:] | np.concatenate((~inside[1:], [True])))) + 1 if n else np.zeros(0, np.int64)
    return begins, ends, np.searchsorted(begins, starts)


def word_hashes(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every lower-cased word, and per text the index of its first word."""
    data = lower(block.data)
    begins, ends, first = word_spans(data, block.starts)
    return span_hash(prefix_hash(data), begins, ends), first


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the distinct runs of ``size`` words, sorted; the whole sequence as one where there are fewer words."""
    if len(words) == 0:
        return words
    if len(words) < size:
        return np.array([_fold(words, len(words), 1)[0]], U)
    return np.unique(_fold(words, size, len(words) - size + 1))


def _fold(words: np.ndarray, size: int, n: int) -> np.ndarray:
    out = np.full(n, size, U)
    for i in range(size):
        out = mix(out * U(0x9FB21C651E98DF25) + words[i : i + n])
    return out


def as_long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))
