"""Hashes of what is left of texts after a few deletions, for many texts of one length at once.

A text's hash is the sum of its characters' values times powers of an odd base, modulo 2^64. With the
prefix sums of a text, every deletion adds one number that depends on its place and on how many
came before it, so a subsequence costs as many additions as it lacks characters.
"""

from __future__ import annotations

from itertools import combinations
from math import comb
from typing import Iterator

import numpy as np

WORD = 1 << 64
BASE = 0x9E3779B97F4A7C15   # odd, so that it has an inverse
BLOCK = 1 << 20             # hashes made at once
SHARED = 64                 # characters of a common beginning or end


def _mixed(values: np.ndarray) -> np.ndarray:
    values = values ^ (values >> np.uint64(30))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    values = values ^ (values >> np.uint64(27))
    values = values * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def _salt(kind: int, other: int) -> np.uint64:
    return _mixed(np.array([(kind * 0xD1B54A32D192ED03 + other * 0x8CB92BA72F3D8DD7 + BASE) % WORD], np.uint64))[0]


def _points(texts: list[str], width: int) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).reshape(len(texts), width)


def remaining(texts: list[str], k: int, start: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
    """``(numbers, hashes)`` of texts of one length after ``k`` deletions in ``start:stop``; of equal neighbours the first go."""
    length = len(texts[0])
    points = _points(texts, length)
    rank = [pow(BASE, i, WORD) for i in range(length)]
    values = _mixed(points.astype(np.uint64) + np.uint64(1)) * np.array(rank, np.uint64)
    sums = np.concatenate([np.zeros((len(texts), 1), np.uint64), np.cumsum(values, axis=1, dtype=np.uint64)], axis=1)
    back = [np.uint64(pow(BASE, -i, WORD)) for i in range(k + 1)]
    places = np.array(list(combinations(range(start, stop), k)), np.int64).reshape(comb(max(0, stop - start), k), k)
    hashes = np.repeat((sums[:, -1] * back[k])[:, None], len(places), axis=1)
    for s in range(k):
        gone = sums[:, :-1] * back[s] - sums[:, 1:] * back[s + 1]
        hashes += gone[:, places[:, s]]
    if not k:
        return np.arange(len(texts)), hashes[:, 0]
    equal = np.zeros(points.shape, bool)
    equal[:, start + 1:stop] = points[:, start + 1:stop] == points[:, start:stop - 1]
    kept = np.ones(hashes.shape, bool)
    for s in range(k):
        after = places[:, s] - 1 == places[:, s - 1] if s else np.zeros(len(places), bool)
        kept &= ~equal[:, places[:, s]] | after
    numbers, which = np.nonzero(kept)
    return numbers, hashes[numbers, which]


class Index:
    """Keys by which texts meet that agree after the deletions of ``plan``.

    The kind of a text is its length, or the negative length of one with the given prefix and suffix. ``plan``
    tells for every kind, by number of deletions, the kinds that may then agree. Two texts with the prefix
    and suffix keep both, so their deletions lie in between.
    """

    def __init__(self, plan: dict[int, dict[int, list[int]]], prefix: str = "", suffix: str = ""):
        self.plan, self.prefix, self.suffix = plan, prefix, suffix

    def kinds(self, texts: list[str]) -> list[int]:
        if not self.prefix and not self.suffix:
            return [len(t) for t in texts]
        fixed, prefix, suffix = len(self.prefix) + len(self.suffix), self.prefix, self.suffix
        return [-len(t) if len(t) >= fixed and t.startswith(prefix) and t.endswith(suffix) else len(t) for t in texts]

    def keys(self, texts: list[str], kinds: list[int], partners: set[int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """``(numbers, own, meets)`` in blocks: keys of a text, and the keys that the texts it may agree with have as their own; for ``partners`` only if given."""
        groups: dict[int, list[int]] = {}
        for i, kind in enumerate(kinds):
            groups.setdefault(kind, []).append(i)
        for kind, rows in sorted(groups.items()):
            for k, others in sorted(self.plan.get(kind, {}).items()):
                for inner in (True, False):
                    met = [o for o in others if (kind < 0 and o < 0) == inner and (partners is None or o in partners)]
                    if met:
                        yield from self._blocks(texts, np.array(rows), kind, k, met, inner)

    def _blocks(self, texts, rows, kind, k, met, inner):
        start, stop = (len(self.prefix), abs(kind) - len(self.suffix)) if inner else (0, abs(kind))
        step = max(1, BLOCK // max(1, comb(max(0, stop - start), k)))
        for at in range(0, len(rows), step):
            some = rows[at:at + step]
            numbers, hashes = remaining([texts[i] for i in some.tolist()], k, start, stop)
            for other in met:
                yield some[numbers], _mixed(hashes + _salt(kind, other)), _mixed(hashes + _salt(other, kind))


def gathered(blocks, column: int) -> tuple[np.ndarray, np.ndarray]:
    """``(keys, numbers)`` of one column of ``Index.keys``, in the order of keys."""
    parts = [(b[column], b[0]) for b in blocks]
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    keys, numbers = (np.concatenate(p) for p in zip(*parts))
    order = np.argsort(keys, kind="stable")
    return keys[order], numbers[order]


class Lookup:
    """Sorted keys, with a table of their first bits that turns most others away."""

    def __init__(self, keys: np.ndarray, numbers: np.ndarray):
        self.keys, self.numbers = keys, numbers
        self.shift = np.uint64(64 - max(10, (8 * len(keys)).bit_length()))
        self.table = np.zeros(1 << (64 - int(self.shift)), bool)
        self.table[keys >> self.shift] = True

    def near(self, numbers: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those that the table does not turn away."""
        some = np.flatnonzero(self.table[keys >> self.shift])
        return numbers[some], keys[some]

    def pairs(self, blocks: list[tuple[np.ndarray, np.ndarray]], most: int = 4 * BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``(number, found)`` once for each pair with equal keys, in order; all pairs of a number in one block of about ``most`` or fewer."""
        if not blocks:
            return
        numbers, keys = (np.concatenate(p) for p in zip(*blocks))
        low, high = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
        some = np.flatnonzero(high > low)
        some = some[np.argsort(numbers[some], kind="stable")]
        numbers, low, sizes = numbers[some], low[some], (high - low)[some]
        ends = np.flatnonzero(np.append(numbers[1:] != numbers[:-1], True)) + 1 if len(numbers) else numbers
        total = np.concatenate([[0], np.cumsum(sizes)])
        at = 0
        while at < len(numbers):
            fits = ends[(ends > at) & (total[ends] - total[at] <= most)]
            stop = int(fits[-1]) if len(fits) else int(ends[ends > at][0])
            n = sizes[at:stop]
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            pairs = np.unique((np.repeat(numbers[at:stop], n) << 32) | self.numbers[np.repeat(low[at:stop], n) + place])
            yield pairs >> 32, pairs & 0xFFFFFFFF
            at = stop


def common_start(texts: list[str], share: float) -> str:
    """The longest beginning, of ``SHARED`` characters at most, that ``share`` (over a half) of the texts have."""
    points = _points([t[:SHARED].ljust(SHARED, "\0") for t in texts], SHARED)
    middle = np.partition(points, len(texts) // 2, axis=0)[len(texts) // 2]
    held = np.logical_and.accumulate((points == middle) & (middle > 0), axis=1).mean(axis=0) >= share
    return "".join(map(chr, middle[:int(held.sum())]))
