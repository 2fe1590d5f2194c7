"""Vectorised text primitives shared by the corpus operators.

Everything here works on the raw UTF-8 buffer of an Arrow string column, so a
batch of documents is handled by a fixed number of numpy passes and no Python
object is made per word.  A word is identified by a 64-bit hash of its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes handled at once; temporary arrays are about 60 bytes per text byte.
SLICE_BYTES = 1 << 19

_rng = np.random.default_rng(20240521)
#: One random odd-free 64-bit value per byte value, and odd multipliers by position.
BYTE_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = _rng.integers(1, 2**63, 1 << 14, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
GRAM_MULTIPLIERS = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def byte_table(word_bytes) -> np.ndarray:
    """256 booleans: which bytes belong to words."""
    table = np.zeros(256, bool)
    table[list(word_bytes)] = True
    return table


SPACES = (0x20, *range(0x09, 0x0E))
NOT_SPACE = byte_table(b for b in range(256) if b not in SPACES)
#: After folding: digits, a-z and every byte of a non-ASCII character.
ALNUM = byte_table(b for b in range(256) if b >= 0x80 or chr(b).isalnum())
SAME = np.arange(256, dtype=np.uint8)
LOWER_ASCII = SAME.copy()
LOWER_ASCII[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def position_multipliers(n: int) -> np.ndarray:
    global _powers
    while len(_powers) < n:
        more = np.random.default_rng(len(_powers)).integers(1, 2**63, len(_powers), dtype=np.uint64)
        _powers = np.concatenate([_powers, more * np.uint64(2) + np.uint64(1)])
    return _powers


def text_slices(column, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of these rows in the bytes); a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        end = min(end, n)
        own = offsets[first : end + 1] - offsets[first]
        yield first, end, data[offsets[first] : offsets[end]], own
        first = end


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, fold: np.ndarray = SAME):
    """Hash, byte start and byte end of every word, and the first word of each document (one more at the end)."""
    inside = is_word[data]
    n = len(data)
    if not n or not inside.any():
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, np.zeros(len(offsets), np.int64)
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    bounds = offsets[(offsets >= 0) & (offsets < n)]
    before[bounds] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[bounds[bounds > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    lengths = ends - starts
    own = fold[data[inside]]
    first = np.cumsum(lengths) - lengths
    position = np.arange(len(own)) - np.repeat(first, lengths)
    value = BYTE_VALUE[own]
    value *= position_multipliers(int(lengths.max()))[position]
    hashes = mix(np.add.reduceat(value, first) + lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return hashes, starts, ends, np.searchsorted(starts, offsets)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k consecutive words, over document borders too."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n] * GRAM_MULTIPLIERS[0]
    for i in range(1, k):
        out += hashes[i : i + n] * GRAM_MULTIPLIERS[i]
    return mix(out + np.uint64(k))


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All of range(start, start + count), one range after the other."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(starts - (np.cumsum(counts) - counts), counts)
    return np.arange(total) + shift


def code_points(data: np.ndarray) -> np.ndarray:
    """Which bytes begin a code point."""
    return (data & 0xC0) != 0x80
