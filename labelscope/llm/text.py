"""Words of many texts at once, on the UTF-8 bytes of Arrow columns.

All separators are ASCII, so cutting bytes is the same as cutting code points. A chunk
holds about a quarter of a megabyte of text; a longer text is a chunk of its own, and costs
some forty bytes of memory for each of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from labelscope.llm.shared import mix

CHUNK_BYTES = 1 << 18

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Which bytes belong to words: all but white space; ASCII digits, letters and everything beyond ASCII.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
ALPHANUMERIC = np.zeros(256, dtype=bool)
ALPHANUMERIC[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

#: Two polynomial hashes: base and value of each byte.
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_VALUES = tuple(mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(k)) for k in (0xD1342543DE82EF95, 0xA0761D6478BD642F))
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """The first n powers of a base, modulo 2^64."""
    if len(_powers.get(base, ())) < n:
        steps = np.full(max(n, CHUNK_BYTES + 1), base, dtype=np.uint64)
        steps[0] = 1
        _powers[base] = np.cumprod(steps, dtype=np.uint64)
    return _powers[base][:n]


@dataclass
class Words:
    """Words of a chunk of texts; ``first[i]`` to ``first[i + 1]`` are those of text i."""

    data: np.ndarray  # bytes of the texts, A-Z lower-cased
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    offsets: np.ndarray  # of the texts in data

    def hashes(self, kind: int = 0) -> np.ndarray:
        """A 64-bit hash for each word; the two kinds are independent."""
        base, n = _BASES[kind], len(self.data) + 1
        total = np.zeros(n, dtype=np.uint64)
        np.cumsum(_VALUES[kind][self.data] * _power(base, n)[:-1], out=total[1:])
        back = _power(pow(base, -1, 1 << 64), n)[self.start]
        return mix((total[self.end] - total[self.start]) * back + (self.end - self.start).astype(np.uint64))

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts())


def chunks(texts: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of about a chunk; null texts are empty."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    if not len(texts):
        return
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, at, values = texts.buffers()
    offsets = np.frombuffer(at, dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(values, dtype=np.uint8) if values is not None else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, side="right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def words_of(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> Words:
    """The words of the texts of a chunk: maximal runs of the bytes ``inside``."""
    is_word = inside[data]
    begins = np.zeros(len(data) + 1, dtype=bool)
    begins[offsets] = True
    starts, ends = is_word.copy(), is_word.copy()
    if len(data):
        starts[1:] &= ~is_word[:-1] | begins[1:-1]
        ends[:-1] &= ~is_word[1:] | begins[1:-1]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return Words(_LOWER[data], start, end, np.searchsorted(start, offsets), offsets)


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash for each run of ``size`` hashes, by its first place."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = np.full(n, size, dtype=np.uint64)
    factor = 1
    for i in range(size):
        factor = factor * 0xD6E8FEB86659FD93 % (1 << 64)
        total += hashes[i : i + n] * np.uint64(factor)
    return mix(total)


def shingle_sets(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text, sorted, and where each text's begin. A text of fewer words is one shingle."""
    hashes = words.hashes()
    windows = window_hashes(hashes, size)
    counts = words.counts()
    sets = []
    for first, n in zip(words.first[:-1], counts, strict=True):
        if n >= size:
            sets.append(np.unique(windows[first : first + n - size + 1]))
        else:
            sets.append(window_hashes(hashes[first : first + n], int(n)) if n else windows[:0])
    sizes = np.array([len(x) for x in sets], dtype=np.int64)
    return np.concatenate(sets) if sets else windows[:0], np.concatenate([[0], np.cumsum(sizes)])


def distinct_keys(keys: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of one member, and the number, of each group of equal (key, check)."""
    if not len(keys):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    order = np.argsort(keys)
    new = np.r_[True, keys[order[1:]] != keys[order[:-1]]]
    differ = np.r_[False, checks[order[1:]] != checks[order[:-1]]]
    if (differ & ~new).any():  # two contents of one key
        order = np.lexsort((checks, keys))
        new = np.r_[True, (keys[order[1:]] != keys[order[:-1]]) | (checks[order[1:]] != checks[order[:-1]])]
    starts = np.flatnonzero(new)
    return order[starts], np.diff(np.r_[starts, len(order)])
