"""String similarity scores on 0..100, as Arrow functions over candidate pairs.

The functions compare two texts that are already in normal form. They run only on pairs that a
join has produced; pairing is the job of ``operators.fuzzy``.
"""

from __future__ import annotations

import difflib
from functools import lru_cache
from typing import Callable

import pandas as pd
from pyspark.sql import Column, functions as F

from assayer.functions.phonetics import double_metaphone

SHORT = 128                 # characters of two texts whose blocks are found by substrings

def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence: equal ends are in it, then one machine-word step per character of ``b``."""
    start, most = 0, min(len(a), len(b))
    while start < most and a[start] == b[start]:
        start += 1
    end = 0
    while end < most - start and a[-1 - end] == b[-1 - end]:
        end += 1
    if start or end:
        return start + end + common_subsequence(a[start:len(a) - end], b[start:len(b) - end])
    if not a or not b:
        return 0
    where: dict[str, int] = {}
    for i, char in enumerate(a):
        where[char] = where.get(char, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for char in b:
        hit = row & where.get(char, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 100.0 if total == 0 else 200.0 * common_subsequence(a, b) / total


def block_ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    if 0 < total <= SHORT:
        return 2.0 * _matched(a, b) / total * 100
    return difflib.SequenceMatcher(None, a, b).ratio() * 100


def _matched(a: str, b: str) -> int:
    """Characters of the matching blocks that ``difflib`` finds in short texts: the longest, first in ``a``, then in ``b``; then left and right of it."""
    for size in range(min(len(a), len(b)), 0, -1):
        for i in range(len(a) - size + 1):
            j = b.find(a[i:i + size])
            if j >= 0:
                return size + _matched(a[:i], b[:j]) + _matched(a[i + size:], b[j + size:])
    return 0


def jaro_winkler(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used = [False] * len(b)
    first = []
    for i, char in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == char:
                used[j] = True
                first.append(char)
                break
    if not first:
        return 0.0
    second = [char for char, hit in zip(b, used) if hit]
    swaps = sum(x != y for x, y in zip(first, second)) // 2
    m = len(first)
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    if jaro > 0.7:
        prefix = 0
        for x, y in zip(a[:4], b[:4]):
            if x != y:
                break
            prefix += 1
        jaro += prefix * 0.1 * (1 - jaro)
    return jaro * 100


@lru_cache(maxsize=100_000)
def _codes(a: str) -> tuple[str, str]:
    return double_metaphone(a)


def metaphone(a: str, b: str) -> float:
    """100 for equal primary codes, 85 for a primary equal to a secondary, 70 for equal secondaries.

    An empty code (a text without letters) agrees with nothing.
    """
    (p1, s1), (p2, s2) = _codes(a), _codes(b)
    if p1 and p1 == p2:
        return 100.0
    if (p1 and p1 == s2) or (s1 and s1 == p2):
        return 85.0
    return 70.0 if s1 and s1 == s2 else 0.0


def combined(a: str, b: str) -> float:
    return 0.4 * ratio(a, b) + 0.4 * jaro_winkler(a, b) + 0.2 * metaphone(a, b)


SCORERS: dict[str, Callable[[str, str], float]] = {
    "ratio": ratio, "difflib": block_ratio, "jaro_winkler": jaro_winkler, "metaphone": metaphone, "combined": combined,
}


def score(algorithm: str, a: Column, b: Column, at_least: float = 0.0) -> Column:
    """Similarity of two text columns; null where either is null.

    A pair that cannot reach ``at_least`` may score 0: matching blocks are a common
    subsequence, so the cheap ratio bounds the block ratio.
    """
    scorer = SCORERS[algorithm]
    bounded = algorithm == "difflib" and at_least > 0

    @F.pandas_udf("double")
    def scored(left: pd.Series, right: pd.Series) -> pd.Series:
        def one(x, y):
            if x is None or y is None:
                return None
            return 0.0 if bounded and ratio(x, y) < at_least else scorer(x, y)
        return pd.Series([one(x, y) for x, y in zip(left, right)], dtype="float64")

    return scored(a, b)


def metaphone_codes(c: Column) -> Column:
    """Array of the one or two phonetic codes of a text."""

    @F.pandas_udf("array<string>")
    def codes(values: pd.Series) -> pd.Series:
        return values.map(lambda v: sorted({code for code in double_metaphone(v or "") if code}))

    return codes(c)
