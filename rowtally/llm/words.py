"""Words of Arrow text columns as numpy arrays: spans, 64-bit hashes and hashes of word windows, without a Python step per word.

A word's hash is a polynomial over its UTF-8 bytes, a window's hash a polynomial over its words' hashes, both modulo 2**64
with an odd base (so that prefix sums give any span) and mixed afterwards.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_U = np.uint64
_BYTE_BASE, _WORD_BASE, _CHECK_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F
_POWERS: dict[tuple[int, bool], np.ndarray] = {}

BLANKS = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
NOT_BLANK = ~BLANKS
_CODE = np.arange(256)
LETTER_OR_DIGIT = (_CODE >= 0x80) | ((_CODE >= 0x30) & (_CODE <= 0x39)) | ((_CODE >= 0x41) & (_CODE <= 0x5A)) | ((_CODE >= 0x61) & (_CODE <= 0x7A))
LOWER = np.where((_CODE >= 0x41) & (_CODE <= 0x5A), _CODE + 32, _CODE).astype(np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(33))
    x *= _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


_BYTE_VALUE = mix((np.arange(256, dtype=np.uint64) + _U(1)) * _U(_BYTE_BASE))


def _powers(base: int, n: int, inverse: bool = False) -> np.ndarray:
    """base**0 .. base**(n-1), or their inverses, modulo 2**64; kept for the next batch."""
    known = _POWERS.get((base, inverse))
    if known is None or len(known) < n:
        size = 1 << max(16, (n - 1).bit_length())
        step = pow(base, -1, 1 << 64) if inverse else base
        known = np.ones(size, np.uint64)
        done = 1
        while done < size:
            known[done:2 * done] = known[:done] * _U(pow(step, done, 1 << 64))
            done *= 2
        _POWERS[base, inverse] = known
    return known[:n]


def _spans(values: np.ndarray, base: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _powers(base, len(values)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _powers(base, len(values) + 1, True)[starts])


@dataclass
class Words:
    """Words of some texts in order. ``bounds[i]:bounds[i + 1]`` are the words of text i."""

    hashes: np.ndarray
    bounds: np.ndarray
    prefixes: np.ndarray | None = None

    @property
    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts (word numbers over all texts) and hashes of the windows of n words that lie in one text."""
        room = np.maximum(np.diff(self.bounds) - n + 1, 0)
        ends = np.cumsum(room)
        starts = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.bounds[:-1] - (ends - room), room)
        return starts, self.hash_at(starts, n)

    def hash_at(self, starts: np.ndarray, n: int, base: int = _WORD_BASE) -> np.ndarray:
        return _spans(self.hashes, base, starts, starts + n)

    def check_at(self, starts: np.ndarray, n: int) -> np.ndarray:
        """A second hash, independent of the first, for windows that must not be confused."""
        return (self.hash_at(starts, n, _CHECK_BASE) >> _U(32)).astype(np.uint32)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes and the offsets of a text column; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def word_starts(data: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = word_bytes[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    at = offsets[:-1][np.diff(offsets) > 0]
    first[at] = inside[at]
    at = offsets[1:][np.diff(offsets) > 0] - 1
    last[at] = inside[at]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def _slices(offsets: np.ndarray, most: int):
    """Ranges of texts of about ``most`` bytes; a longer text stands alone."""
    i = 0
    while i < len(offsets) - 1:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, j
        i = j


def words(column: pa.Array, word_bytes: np.ndarray = NOT_BLANK, lower: bool = False, prefix: int = 0) -> Words:
    """Words are the longest runs of ``word_bytes``. With ``prefix``, also hashes of the words' first bytes."""
    data, offsets = utf8(column)
    hashes, heads, counts = [], [], []
    for i, j in _slices(offsets, 1 << 20):
        part, cuts = data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
        if lower:
            part = LOWER[part]
        starts, ends = word_starts(part, cuts, word_bytes)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE_VALUE[part] * _powers(_BYTE_BASE, len(part)), out=sums[1:])
        back = _powers(_BYTE_BASE, len(part) + 1, True)[starts]
        hashes.append(mix((sums[ends] - sums[starts]) * back))
        if prefix:
            heads.append(mix((sums[np.minimum(starts + prefix, ends)] - sums[starts]) * back))
        counts.append(np.diff(np.searchsorted(starts, cuts)))
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    bounds = np.concatenate([[0], np.cumsum(join(counts, np.int64))]).astype(np.int64)
    return Words(join(hashes, np.uint64), bounds, join(heads, np.uint64) if prefix else None)


def hash_words(texts: list[str]) -> np.ndarray:
    """The hash that ``words`` gives a word, for each of some single words."""
    return words(pa.array(texts, pa.string()), np.ones(256, bool)).hashes


def batches_of(batches, column: str, most: int):
    """Arrow batches cut so that the texts of each hold about ``most`` bytes."""
    for batch in batches:
        _, offsets = utf8(batch.column(column))
        for i, j in _slices(offsets, most):
            yield batch.slice(i, j - i)
