"""Words and lines of whole Arrow text batches as numpy arrays, without a Python object per word.

A word is a run of bytes other than space, tab, \\n, \\v, \\f and \\r, as in the
pattern ``[^\\x20\\x09-\\x0D]+``; UTF-8 keeps those bytes for themselves, so working on
bytes is the same as working on characters. Hashes are 64 bits wide: a sum of
random values per byte, weighted with powers of an odd number, then mixed. Two
different words of one job share a hash with probability 2^-64 per pair.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20  # texts worked on at once; a longer text is a chunk of its own
_U = np.uint64
_P = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
_INV = pow(_P, -1, 1 << 64)
_rng = np.random.Generator(np.random.PCG64(20240531))
_EXACT = _rng.integers(1, 2**64 - 1, 256, dtype=np.uint64)
_LOWER = _EXACT.copy()
_LOWER[65:91] = _EXACT[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """1, base, base^2, ... modulo 2^64, at least n of them, kept for the next call."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 1)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 16 * CHUNK_BYTES:
            _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of ``h``."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A text column with null as the empty text."""
    array = batch.column(batch.schema.get_field_index(name))
    return array.fill_null("") if array.null_count else array


def raw(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary array and its n + 1 offsets."""
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    n, at = len(array), array.offset
    _, where, data = array.buffers()
    if not n or where is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[at:at + n + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]


def chunks(array: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of slices of about ``limit`` bytes; texts stay whole."""
    data, offsets = raw(array)
    row, n = 0, len(array)
    while row < n:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, data[offsets[row]:offsets[stop]], offsets[row:stop + 1] - offsets[row]
        row = stop


def word_spans(
    data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = _SPACE
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and n + 1 offsets of the texts' words.

    ``breaks`` marks the byte values that end a word.
    """
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~breaks[data]
    edge = np.empty(len(data) + 1, bool)  # before each byte: does a word break off here
    edge[0] = edge[-1] = True
    np.not_equal(solid[1:], solid[:-1], out=edge[1:-1])
    edge[offsets] = True
    starts = np.flatnonzero(solid & edge[:-1])
    ends = np.flatnonzero(solid & edge[1:]) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def line_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the \\n-split lines, and n + 1 offsets of the texts' lines.

    An empty text has one empty line, as ``split`` gives it.
    """
    breaks = np.flatnonzero(data == 10)
    per_text = np.searchsorted(breaks, offsets)
    counts = np.diff(per_text) + 1
    line_offsets = np.concatenate([[0], np.cumsum(counts)])
    starts = np.empty(line_offsets[-1], np.int64)
    ends = np.empty(line_offsets[-1], np.int64)
    first = np.zeros(len(starts), bool)
    first[line_offsets[:-1]] = True
    last = np.zeros(len(starts), bool)
    last[line_offsets[1:] - 1] = True
    starts[first], ends[last] = offsets[:-1], offsets[1:]
    starts[~first], ends[~last] = breaks + 1, breaks
    return starts, ends, line_offsets


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hashes of byte spans; with ``lower``, A-Z count as a-z."""
    n = len(data)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum((_LOWER if lower else _EXACT)[data] * _power(_P, n), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _power(_INV, n + 1)[starts] + (ends - starts).astype(np.uint64))


def pair_hashes(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hashes of ordered pairs of hashes."""
    return mix(left * _U(0xD6E8FEB86659FD93) + (right ^ (right >> _U(32))) * _U(0xA0761D6478BD642F))


def owners(offsets: np.ndarray) -> np.ndarray:
    """The text number of every item, from n + 1 offsets."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
