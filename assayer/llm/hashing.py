"""64-bit hashes of the words, shingles and lines of whole batches, without a Python object per word.

A word's hash is a polynomial over random values of its bytes, taken from one running sum per
batch: ``(sum up to its end - sum up to its start) / base**start`` modulo ``2**64``.
"""

from __future__ import annotations

import numpy as np

_RANDOM = np.random.default_rng(20240601)
_BASE = np.uint64(0x9E3779B97F4A7C15 & ~7 | 5)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_STEP = np.uint64(0xD6E8FEB86659FD93)
_BYTES = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = _BYTES.copy()
_LOWER[65:91] = _BYTES[97:123]
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = 1 << max(21, (n - 1).bit_length())
        _POWERS[:] = []
        for base in (_BASE, _INVERSE):
            row = np.full(size, base, np.uint64)
            row[0] = 1
            _POWERS.append(np.cumprod(row, dtype=np.uint64))
    return _POWERS[0], _POWERS[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of ``h`` over the whole word."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """Hash of each span of ``data``; spans ascend and do not overlap. Works through runs of about 2 MB."""
    out = np.zeros(len(starts), np.uint64)
    values, at = (_LOWER if lower else _BYTES), 0
    while at < len(starts):
        base = int(starts[at])
        stop = max(at + 1, int(np.searchsorted(ends, base + (1 << 21), "right")))
        run = data[base:int(ends[stop - 1])]
        power, inverse = _powers(len(run) + 1)
        sums = np.zeros(len(run) + 1, np.uint64)
        np.cumsum(values[run] * power[:len(run)], out=sums[1:])
        first, last = starts[at:stop] - base, ends[at:stop] - base
        out[at:stop] = (sums[last] - sums[first]) * inverse[first] + (last - first).astype(np.uint64)
        at = stop
    return mix(out)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+``, and how many words come before each text."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = ~_BLANK[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    after[:-1] = inside[1:]
    full = offsets[:-1][offsets[1:] > offsets[:-1]]
    before[full] = False
    after[full[1:] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def shingles(words: np.ndarray, counts: np.ndarray, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text.

    ``counts`` are the ``n + 1`` word offsets. A text with fewer than ``size`` words has its
    whole sequence as one shingle; one without words has none.
    """
    total = max(0, len(words) - size + 1)
    rows = np.zeros(total, np.uint64)
    factor = np.uint64(1)
    for j in range(size):
        rows += words[j:j + total] * factor
        factor = np.uint64(int(factor) * int(_STEP) & 0xFFFFFFFFFFFFFFFF)
    rows = mix(rows)
    out = []
    for first, last in zip(counts[:-1].tolist(), counts[1:].tolist()):
        if last - first >= size:
            one = np.sort(rows[first:last - size + 1])
            keep = np.ones(len(one), bool)
            np.not_equal(one[1:], one[:-1], out=keep[1:])
            out.append(one[keep])
        elif last > first:
            few = np.cumsum(words[first:last] * np.arange(1, 2 * (last - first), 2, dtype=np.uint64))[-1:]
            out.append(mix(few + np.uint64(last - first)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def word_shingles(data: np.ndarray, offsets: np.ndarray, size: int, lower: bool = True) -> list[np.ndarray]:
    """``shingles`` of the texts in ``data``."""
    starts, ends, counts = word_spans(data, offsets)
    return shingles(span_hashes(data, starts, ends, lower), counts, size)


class Permutations:
    """``count`` universal hash functions ``x -> a * x + b`` modulo ``2**32``, ``a`` odd, so each permutes the words."""

    def __init__(self, count: int, seed: int = 17):
        random = np.random.default_rng(seed)
        self.a = (random.integers(0, 1 << 31, (count, 1), dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
        self.b = random.integers(0, 1 << 32, (count, 1), dtype=np.uint32)

    def least(self, values: np.ndarray) -> np.ndarray:
        """The smallest value under each function over 64-bit ``values``; the largest word where there are none."""
        x = (values >> np.uint64(32)).astype(np.uint32)
        out = np.full(len(self.a), 0xFFFFFFFF, np.uint32)
        for at in range(0, len(x), 1024):
            np.minimum(out, (self.a * x[at:at + 1024] + self.b).min(axis=1), out=out)
        return out
